"""Alignment of two tokenizers over each distinct text.

1. Texts shuffle by their full string; each distinct one is encoded by both
   tokenizers once, with the number of documents that have it. Marking both
   kinds of token ends on the text's bytes gives the groups (cut where both end)
   and the links (each stretch between neighbouring ends lies in one token of
   either kind). Distinct id pairs and their numbers are staged beside the text's
   256-bit hash.
2. Pair counts: each task sums the multiplicities of its texts by pair, Spark the
   rest. A pair's row tells whether its count is the highest of its first id.
3. The counts go back to the texts in slices of at most ``slice_pairs`` pairs (the
   proven bound of a broadcast); a text's sums over all slices are added up.
4. Measures join the documents by the hash of their text.

Defined results: null and empty texts, and texts that either tokenizer does not
spell byte by byte, have no tokens (zeros, '' as hash); every row is a document,
repeated rows and ids included; very long texts are encoded whole; other columns
are kept, those named like an added column are replaced; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from choicelens.llm.carry import packed, unpacked
from choicelens.llm.staging import staged
from choicelens.llm.textcols import utf8
from choicelens.llm.tokens import encoder, text_groups
from choicelens.llm.workers import CACHES, released

MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_ALIGNED = ("key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "pairs binary, times binary")
_END, _COMMA, _BAR, _SEMICOLON = range(4)


def byte_level_alphabet() -> dict[str, int]:
    """Character of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Spelling:
    """Bytes of every id of a vocabulary, end to end."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[ids] - ends + size, size)]


class Aligner:
    """Encodes texts by a byte-level file (A, with a space before) and a piece model (B, which adds one)."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        self.a = encoder(byte_path, False, True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        letters = byte_level_alphabet()
        vocab = self.a.tokenizer.get_vocab(True)
        entries = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            entries[i] = bytes(letters[c] for c in token) if set(token) <= letters.keys() else token.encode()
        self.spell_a = Spelling(entries)
        piece = self.b.id_to_piece
        self.spell_b = Spelling([bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else
                                 piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())])
        self.width = len(self.spell_b.size)
        self.ids = max(len(entries), self.width)
        self.kind = "<u4" if len(entries) * self.width <= 1 << 32 else "<u8"
        digits = [b"%d" % i for i in range(self.ids)]
        self.parts = [d + end for end in (b"", b",", b"|", b";") for d in digits]

    def align(self, texts: list[str]):
        """Measures of each text: n_a, n_b, n_groups, n_links, groups_sha256, pairs, times."""
        buf, off = utf8(pa.array([" " + t for t in texts], pa.large_string()))
        size = np.diff(off)
        a, n_a = self.a.encode([" " + t for t in texts])
        found = self.b.encode(texts, num_threads=1)
        n_b = np.fromiter(map(len, found), np.int64, len(found))
        b = np.fromiter(chain.from_iterable(found), np.int64, int(n_b.sum()))
        a = a.astype(np.int64)
        ok = np.ones(len(texts), bool)
        text = np.arange(len(texts))
        for ids, n, spell in ((a, n_a, self.spell_a), (b, n_b, self.spell_b)):
            ok &= np.bincount(np.repeat(text, n), weights=spell.size[ids], minlength=len(texts)).astype(np.int64) == size
        for ids, n, spell in ((a, n_a, self.spell_a), (b, n_b, self.spell_b)):
            same = np.repeat(ok, size)
            differ = spell.of(ids[np.repeat(ok, n)]) != buf[same]
            ok[np.repeat(text, size)[same][differ]] = False
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        n_a, n_b, size = np.where(ok, n_a, 0), np.where(ok, n_b, 0), np.where(ok, size, 0)

        total = int(size.sum())
        ends = np.zeros(total + 1, np.uint8)
        ends[np.cumsum(self.spell_a.size[a])] = 1
        ends[np.cumsum(self.spell_b.size[b])] |= 2
        ends[0] = 0
        at = np.flatnonzero(ends)
        is_a, is_b = (ends[at] & 1).astype(np.int64), (ends[at] >> 1).astype(np.int64)
        both = is_a & is_b
        in_a, in_b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b
        doc = np.searchsorted(np.cumsum(size), at, "left")
        n_links = np.bincount(doc, minlength=len(texts))
        n_groups = np.bincount(doc, weights=both, minlength=len(texts)).astype(np.int64)

        # id pairs of each text with their number
        rows = len(self.spell_a.size) * self.width
        code, times = np.unique(doc * rows + a[in_a] * self.width + b[in_b], return_counts=True)
        cut = np.searchsorted(code, np.arange(len(texts) + 1) * rows)
        pairs, times = (code % rows).astype(self.kind), times.astype("<u4")

        # tokens in the order of the groups, first A's then B's, each with the sign that follows it
        group = np.cumsum(both) - both
        last_a, last_b = both[is_a > 0], both[is_b > 0]
        group_a, group_b = group[is_a > 0], group[is_b > 0]
        upto_a = np.cumsum(np.bincount(group_a, minlength=1))
        upto_b = np.cumsum(np.bincount(group_b, minlength=1))
        sign_b = np.where(last_b > 0, _SEMICOLON, _COMMA)
        n = np.cumsum(n_b)
        sign_b[n[ok & (n_b > 0)] - 1] = _END
        tokens = np.zeros(len(a) + len(b), np.int64)
        tokens[np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]] = \
            np.where(last_a > 0, _BAR, _COMMA) * self.ids + a
        tokens[np.arange(len(b)) + upto_a[group_b]] = sign_b * self.ids + b
        words = list(map(self.parts.__getitem__, tokens.tolist()))
        edge = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        hashes = [hashlib.sha256(b"".join(words[i:j])).hexdigest() if j > i else "" for i, j in zip(edge, edge[1:])]
        return (n_a, n_b, n_groups, n_links, hashes, [pairs[i:j].tobytes() for i, j in zip(cut, cut[1:])],
                [times[i:j].tobytes() for i, j in zip(cut, cut[1:])])


_ALIGNERS = CACHES.setdefault("aligners", {})


def _aligner(byte_path: str, piece_path: str) -> Aligner:
    """The worker process's aligner for two files."""
    if (byte_path, piece_path) not in _ALIGNERS:
        _ALIGNERS[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _ALIGNERS[byte_path, piece_path]


def aligned_texts(docs: DataFrame, byte_path: str, piece_path: str, text_col: str = "text") -> DataFrame:
    """One row for each distinct text: hash, documents, measures, and its id pairs (a * ids of B + b) with their number."""
    def run(batches):
        tool = _aligner(byte_path, piece_path)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for i, j in text_groups(texts):
                n_a, n_b, n_groups, n_links, hashes, pairs, times = tool.align(texts[i:j])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(1)[i:j], *map(pa.array, (n_a, n_b, n_groups, n_links)),
                     pa.array(hashes, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())],
                    [c.split()[0] for c in _ALIGNED.split(", ")])
    text = F.col(text_col).cast("string")
    return (docs.select(text.alias("text")).where("text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
            .select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text").mapInArrow(released(run, ("encoders", "aligners")), _ALIGNED))


def pair_counts(aligned: DataFrame, width: int, kind: str = "<u4", flush: int = 2_000_000) -> DataFrame:
    """(pair, n, best): documents that hold each id pair linked, and whether no pair of its A id has more."""
    def run(batches):
        def summed(held):
            pairs, copies = (np.concatenate(x) for x in zip(*held))
            kinds, at = np.unique(pairs, return_inverse=True)
            n = np.zeros(len(kinds), np.int64)
            np.add.at(n, at, copies)
            return kinds, n
        held, size = [], 0
        for batch in batches:
            for copies, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = np.frombuffer(x, kind)
                held.append((pairs, np.full(len(pairs), copies, np.int64)))
                size += len(pairs)
                if size >= flush:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size >= flush // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in held[0]], ["pair", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in summed(held)], ["pair", "n"])
    counted = (aligned.select("copies", "pairs").mapInArrow(released(run), "pair long, n long")
               .groupBy("pair").agg(F.sum("n").alias("n")))
    # an A id has at most as many pairs as B has ids
    one = Window.partitionBy(F.call_function("div", F.col("pair"), F.lit(width)))
    return counted.withColumn("best", F.col("n") == F.max("n").over(one))


def _sums(pairs, kind: str):
    """Task of step 3: each text's sums over the pairs of one slice."""
    def run(batches):
        code, n, best = pairs.value
        for batch in batches:
            keys, found, times = (batch.column(i).to_pylist() for i in range(3))
            own, count = (np.frombuffer(b"".join(x), k).astype(np.int64) for x, k in ((found, kind), (times, "<u4")))
            text = np.repeat(np.arange(len(keys)), [len(x) // np.dtype(kind).itemsize for x in found])
            at = np.minimum(np.searchsorted(code, own), max(0, len(code) - 1))
            hit = code[at] == own if len(code) else np.zeros(len(own), bool)
            at, count, text = at[hit], count[hit], text[hit]
            out = []
            for value in (best[at] * count, n[at] * count):
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, text, value)
                out.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *out], ["key", "n_best", "count_sum"])
    return run


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, text_col: str = "text",
                     slice_pairs: int = 4_000_000) -> DataFrame:
    """``docs`` without ``text_col``, with the measures of each text's alignment and ``groups_sha256``."""
    spark = docs.sparkSession
    tool = _aligner(byte_path, piece_path)
    width, kind = tool.width, tool.kind
    aligned = staged(aligned_texts(docs, byte_path, piece_path, text_col), "aligned")
    counts = staged(pair_counts(aligned, width, kind), "pair-counts")
    slices = max(1, math.ceil(counts.count() / slice_pairs))
    a_id = F.call_function("div", F.col("pair"), F.lit(width))
    own = None
    for i in range(slices):
        t = counts.where(F.pmod(F.xxhash64(a_id), F.lit(slices)) == i).orderBy("pair").toArrow()
        part = spark.sparkContext.broadcast(tuple(t[c].to_numpy().astype(np.int64) for c in ("pair", "n", "best")))
        sums = aligned.select("key", "pairs", "times").mapInArrow(_sums(part, kind), "key binary, n_best long, count_sum long")
        own = sums if own is None else own.unionByName(sums)
    own = own.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    measured = aligned.drop("pairs", "times", "copies").join(own, "key")
    rows = docs.select(packed(docs, text_col), F.unhex(F.sha2(F.col(text_col).cast("string"), 256)).alias("key"))
    joined = rows.join(measured, "key", "left")
    filled = joined.select("_in", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in MEASURES),
                           F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return filled.select(*unpacked(docs, *MEASURES, "groups_sha256", without=text_col))
