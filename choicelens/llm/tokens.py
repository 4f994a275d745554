"""Token ids of whole texts by a public tokenizer, with each word encoded once.

The tokenizers library encodes chunks: white space and the word after it, its
closing symbols apart. A chunk starts where the library's own splitting always
starts a new piece, so the ids of a text are those of its chunks, laid end to
end. Numpy finds the chunks and their 64-bit hashes in the texts' bytes; a worker
keeps the ids of the chunks it has met by hash, and the library sees new chunks
only. When their number passes a bound, those met in one batch of texts only are
forgotten. Chunks beyond 64 bytes are kept by their bytes.
Texts with rare white space that the library treats in another way, with the
one letter that grows when lowered, or with the opening of a special token are
encoded in one go.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from choicelens.llm.textcols import pieces, segments, span_hashes, utf8
from choicelens.llm.workers import CACHES

# FIXED VALUES: a space, tab or line break always ends a piece; other white space is not relied on
_BREAK = np.zeros(256, bool)
_BREAK[list(b" \n\r\t")] = True
_ODD = np.zeros(256, bool)
_ODD[[0x0B, 0x0C, *range(0x1C, 0x20)]] = True
# white space of two and three bytes (U+0085, U+00A0; U+1680, U+2000-U+206F, U+3000), and U+0130, as first bytes of texts to encode whole
_ODD_PAIRS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe3\x80")
_GROWS = b"\xc4\xb0"
# the ASCII symbols (not ') after letters and digits, up to white space, are pieces apart
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[b for b in range(0x80) if chr(b).isalnum()]] = True
_LONG = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _pairs(buf: np.ndarray, pairs) -> np.ndarray:
    """Places of two-byte strings."""
    found = [np.flatnonzero((buf[:-1] == p[0]) & (buf[1:] == p[1])) for p in pairs]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def odd_places(buf: np.ndarray, drops_space: bool, specials: bool) -> np.ndarray:
    """Places that make a text one to encode whole."""
    if drops_space:
        found = [_pairs(buf, [_GROWS])]
    else:
        general = np.flatnonzero((buf[:-2] == 0xE2) & ((buf[1:-1] == 0x80) | (buf[1:-1] == 0x81)))
        third = buf[general + 2]
        # of U+2000 to U+207F: the spaces U+2000-U+200A, U+2028, U+2029, U+202F, U+205F
        general = general[np.where(buf[general + 1] == 0x80, (third <= 0x8A) | np.isin(third, (0xA8, 0xA9, 0xAF)), third == 0x9F)]
        found = [np.flatnonzero(_ODD[buf]), _pairs(buf, _ODD_PAIRS), general]
    if specials:
        found.append(_pairs(buf, [b"<|"]))
    return np.concatenate(found)


def chunks(buf: np.ndarray, off: np.ndarray, drops_space: bool):
    """Chunks of texts laid end to end: starts, ends, document."""
    a, b, doc = segments(~_BREAK[buf], off)
    # closing symbols: after the last other byte, if only letters and digits stand before
    cut = b.copy()
    at = np.flatnonzero(_SYMBOL[buf[b - 1]])
    while len(at):   # once for each symbol of the longest run, over the words that still end in one
        cut[at] -= 1
        at = at[cut[at] > a[at]]
        at = at[_SYMBOL[buf[cut[at] - 1]]]
    plain = _PLAIN[buf]
    # U+00C0 to U+00FF but the signs of times and division are letters
    accent = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7))
    plain[accent] = plain[accent + 1] = True
    other = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(~plain, out=other[1:])
    split = (cut > a) & (cut < b) & (other[cut] == other[a])
    if not drops_space:   # the white space before a word belongs to it
        before = off[doc]
        same = doc[1:] == doc[:-1]
        before[1:][same] = b[:-1][same]
        a = before
    starts = np.concatenate([a, cut[split]])
    ends = np.concatenate([np.where(split, cut, b), b[split]])
    of = np.concatenate([doc, doc[split]])
    if not drops_space:   # what follows the last word
        last_end = off[:-1].copy()
        last_end[doc] = b   # the last one stays
        rest = np.flatnonzero(last_end < off[1:])
        starts, ends, of = (np.concatenate(x) for x in ((starts, last_end[rest]), (ends, off[1:][rest]), (of, rest)))
    by = np.argsort(starts, kind="stable")
    return starts[by], ends[by], of[by]


class _Numbers(dict):
    """Chunk to number; a new chunk gets the next number."""

    next = 0

    def __missing__(self, key) -> int:
        self[key] = n = self.next
        self.next = n + 1
        return n


class ChunkEncoder:
    """Encodes texts; ``drops_space`` if the tokenizer discards white space.

    A special token's string in a text gives its id, as by the library, or with
    ``plain_specials`` is ordinary text.
    """

    def __init__(self, path: str, drops_space: bool, plain_specials: bool = False, keep: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.drops_space, self.specials, self.keep = drops_space, not plain_specials, keep
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.specials and not all(t.startswith("<|") for t in added):
            raise ValueError("special tokens of another form than <|...|>")
        # a tokenizer that lowers capitals sees them lowered; its vocabulary marks the ends of words
        letters = [chr(c) for c in range(65, 91)]
        self.lowers = drops_space and all(self.tokenizer.encode(c, add_special_tokens=False).ids ==
                                          self.tokenizer.encode(c.lower(), add_special_tokens=False).ids for c in letters)
        entries = self.tokenizer.get_vocab(False)
        self.ends = np.zeros(max(entries.values()) + 1, bool)
        self.ends[[i for e, i in entries.items() if e.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.known = _Numbers()
        self.ids, self.used, self.learned = np.zeros(1 << 16, np.uint32), 0, 0
        self.start, self.size, self.met = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Keep the chunks met in two batches or more, if they are less than half of the bound."""
        keys, at = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        often = np.flatnonzero(self.met[at] > 1)
        if len(often) > self.keep // 2:
            often = often[:0]
        ids, start, size, at = self.ids, self.start, self.size, at[often]
        self._reset()
        while len(at) > len(self.start):
            self.start, self.size, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.met))
        n = size[at]
        ends = np.cumsum(n)
        self.used, self.learned = int(ends[-1]) if len(at) else 0, len(at)
        self.ids = np.zeros(max(1 << 16, 2 * self.used), np.uint32)
        self.ids[:self.used] = ids[np.arange(self.used) + np.repeat(start[at] - ends + n, n)]
        self.start[:len(at)], self.size[:len(at)], self.met[:len(at)] = ends - n, n, 1
        self.known.update((keys[k], i) for i, k in enumerate(often.tolist()))

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, end to end, and their number each."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), n

    def _encoded_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of ASCII letters: many at a time, as an id that ends a word ends each."""
        lines = [" ".join(words[i:i + 64]) for i in range(0, len(words), 64)]
        ids, _ = self._encoded(lines)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(words):   # a splitting of its own
            return self._encoded(words)
        return ids, np.diff(ends, prepend=-1)

    def _learn(self, new: list[str]) -> None:
        """Encode chunks and keep their ids under the numbers that come next."""
        for lo in range(0, len(new), 4096):
            part = new[lo:lo + 4096]
            if self.lowers:
                word = np.fromiter((c.isascii() and c.isalpha() for c in part), bool, len(part))
                by = np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)])
                both = (self._encoded_words([part[i] for i in by[:word.sum()].tolist()]),
                        self._encoded([part[i] for i in by[word.sum():].tolist()]))
                ids, n = (np.concatenate(x) for x in zip(*both))
            else:
                by = np.arange(len(part))
                ids, n = self._encoded(part)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            at, to = self.learned, self.learned + len(n)
            while to > len(self.start):
                self.start, self.size, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.met))
            self.ids[self.used:self.used + len(ids)] = ids
            self.start[at + by], self.size[at + by] = self.used + np.cumsum(n) - n, n
            self.used, self.learned = self.used + len(ids), to

    def _numbers(self, buf: np.ndarray, a: np.ndarray, b: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Place of each chunk among the known ones; new ones are learned."""
        own = buf.tobytes()
        if self.lowers:
            buf = _LOWER[buf]
        raw = buf.tobytes()
        out = np.zeros(len(a), np.int64)
        long = (b - a > _LONG) | whole
        short = np.flatnonzero(~long)
        self.known.next = base = self.learned
        keys = span_hashes(buf, a[short], b[short]).tolist()
        out[short] = at = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        fresh = np.flatnonzero(at >= base)
        first = np.zeros(self.known.next - base, np.int64)
        first[at[fresh[::-1]] - base] = fresh[::-1]   # the first place of each new chunk
        new = [raw[i:j].decode() for i, j in zip(a[short[first]].tolist(), b[short[first]].tolist())]

        for i in np.flatnonzero(long).tolist():
            # a text to encode whole keeps its capitals, which tell a special token
            key = (own if whole[i] else raw)[a[i]:b[i]]
            out[i] = n = self.known[key]
            if n == base + len(new):
                new.append(key.decode())
        self._learn(new)
        self.met[at] += 1
        return out

    def encode_bytes(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts laid end to end (uint32) and their number per text."""
        if len(self.known) > self.keep:
            self._forget()
        n = len(off) - 1
        a, b, doc = chunks(buf, off, self.drops_space)
        odd = np.zeros(n, bool)
        odd[np.searchsorted(off, odd_places(buf, self.drops_space, self.specials), "right") - 1] = True
        whole = np.zeros(len(a), bool)
        if odd.any():
            keep, texts = ~odd[doc], np.flatnonzero(odd)
            a, b, doc = (np.concatenate(x) for x in ((a[keep], off[:-1][texts]), (b[keep], off[1:][texts]), (doc[keep], texts)))
            by = np.argsort(doc, kind="stable")
            a, b, doc, whole = a[by], b[by], doc[by], np.concatenate([np.zeros(int(keep.sum()), bool), np.ones(len(texts), bool)])[by]
        at = self._numbers(buf, a, b, whole)
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[at] - ends + size, size)]
        return ids, np.bincount(doc, weights=size, minlength=n).astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end (uint32) and their number per text (null: empty)."""
        buf, off = utf8(pa.array(texts, pa.large_string()))
        found = [self.encode_bytes(buf[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in pieces(off)]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def text_groups(texts: list[str | None], limit: int = 1 << 20):
    """Consecutive texts of about ``limit`` characters (one at least)."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < limit):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


_ENCODERS = CACHES.setdefault("encoders", {})


def encoder(path: str, drops_space: bool, plain_specials: bool = False) -> ChunkEncoder:
    """The worker process's encoder for a file."""
    key = path, drops_space, plain_specials
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(*key)
    return _ENCODERS[key]
