"""Removal of repeated byte strings across documents, first copy kept.

A byte goes if a 50-byte string that covers it also starts in a document with a
smaller id. A suffix array over all bytes is not needed to find these strings:

1. Sampling. Each 50-byte window has an anchor, the place of its least 16-byte
   hash, which depends on the window's bytes only. Consecutive windows with one
   anchor form a context (50 to 84 bytes, one for about 17 bytes of text).
2. Contexts are dealt by their anchor's hash, packed per task and destination.
   Equal contexts meet, locally first: all but those of the smallest id are
   removed as a whole. Anchors that only one document has are done with.
3. Where different contexts share an anchor, the bytes of the contexts of
   smallest id are fetched from the texts and dealt again.
4. Their windows are put in suffix order (to the depth of the window). In each
   run of common prefix 50, a window goes if the run's least id is below its own:
   just then the previous or next smaller id in that order exists, so a longest
   previous factor would reach 50. The array of these factors is not built.
5. Spans meet the texts again, are united and cut out.

An anchor met by very many different contexts is split: its contexts become
single windows dealt by their own bytes. Contexts of step 2 count as equal by 88
bits of two hashes, their bytes are not compared; windows of step 4 are.

Defined results: a null text is empty; texts below 50 bytes lose nothing; a null
id counts as smaller than any other; rows of one id never remove each other's
bytes, and repeated rows get equal results; very long texts are read whole;
other columns are kept as they are, but those named like an added column are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choicelens.llm.carry import packed, unpacked
from choicelens.llm.staging import staged
from choicelens.llm.textcols import mixed, pieces, span_hash, utf8
from choicelens.llm.workers import released

GRAM = 16
_TABLE = np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)
_NULL = -(1 << 63)
# a context is told apart by its anchor's hash (32 bits and the destination) and 56 bits of its content's
ENTRY_PLANES = {"c": 7, "lo": 4}
_BLOB = "kind int, part int, g binary, c binary, doc binary, row binary, lo binary, n binary"


def _powers(n: int) -> dict[int, np.uint64]:
    base, out = 0x9E3779B97F4A7C15, {}
    for k in range(1, n + 1):
        out[k] = np.uint64(pow(base, k, 1 << 64))
    return out


_P = _powers(64)


def _joined(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> np.ndarray:
    """Hashes of ``size_a + size_b`` bytes from those of its two parts."""
    n = max(0, min(len(a), len(b) - size_a))
    return a[:n] * _P[size_b] + b[size_a:size_a + n]


def contexts(buf: np.ndarray, off: np.ndarray, window: int):
    """Contexts of texts laid end to end: anchor hash, content hash, document, first window, further windows."""
    none = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint8),)
    n = len(buf)
    if n < window:
        return none
    h1 = _TABLE[buf]
    h2 = _joined(h1, h1, 1, 1)
    h4 = _joined(h2, h2, 2, 2)
    h8 = _joined(h4, h4, 4, 4)
    gram = _joined(h8, h8, 8, 8)
    full, size = gram, GRAM
    for h, k in ((gram, GRAM), (h8, 8), (h4, 4), (h2, 2), (h1, 1)):
        while size + k <= window:
            full = _joined(full, h, size, k)
            size += k
    key = mixed(gram)
    # a gram may not leave its document
    for back in range(1, GRAM):
        at = off[1:] - back
        at = at[(at >= off[:-1]) & (at < len(key))]
        key[at] = np.uint64(0xFFFFFFFFFFFFFFFF)
    packed = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)
    width, step = window - GRAM + 1, 1
    while 2 * step <= width:
        packed = np.minimum(packed[:-step], packed[step:])
        step *= 2
    if step < width:
        packed = np.minimum(packed[:len(packed) - (width - step)], packed[width - step:])
    anchor = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # windows that stay in one document
    inside = np.zeros(len(anchor) + 1, np.int64)
    long = (off[1:] - off[:-1]) >= window
    np.add.at(inside, off[:-1][long], 1)
    np.add.at(inside, off[1:][long] - window + 1, -1)
    place = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(place):
        return none
    a = anchor[place]
    first = np.concatenate([[True], a[1:] != a[:-1]])
    lo = place[first]
    hi = place[np.concatenate([first[1:], [True]])]
    g = key[a[first]]
    more = hi - lo
    c = mixed(mixed(full[lo]) + mixed(full[hi] ^ _P[3]) * _P[5] + more.astype(np.uint64))
    doc = np.searchsorted(off, lo, "right") - 1
    return g, c, doc, (lo - off[doc]).astype(np.uint32), more.astype(np.uint8)


def _bucket(doc: np.ndarray, row: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(doc ^ row, buckets)


def _bucket_col(buckets: int) -> Column:
    return F.pmod(F.col("_doc").bitwiseXOR(F.col("_row")), F.lit(buckets)).cast("int")


def _planes(a: np.ndarray, keep: int) -> bytes:
    """The ``keep`` low bytes of numbers, first bytes first: high bytes compress to little."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T[:keep].tobytes()


def _read_planes(col, kind, keep: int) -> np.ndarray:
    parts = []
    for x in col.to_pylist():
        a = np.zeros((len(x) // keep, np.dtype(kind).itemsize), np.uint8)
        a[:, :keep] = np.frombuffer(x, np.uint8).reshape(keep, -1).T
        parts.append(a.view(kind).ravel())
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _rows(kind: int, part: np.ndarray, planes: dict[str, int] | None = None, **cols: np.ndarray):
    """One row for each value of ``part``, with the columns' bytes (some as byte planes)."""
    planes = planes or {}
    if not len(part):
        return []
    by = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[by])) + 1
    out = []
    for ix in np.split(by, cut):
        out.append({"kind": kind, "part": int(part[ix[0]]),
                    **{k: _planes(v[ix], planes[k]) if k in planes else np.ascontiguousarray(v[ix]).tobytes()
                       for k, v in cols.items()}})
    return out


_BLOB_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()),
                         *((c, pa.binary()) for c in ("g", "c", "doc", "row", "lo", "n"))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _BLOB_ARROW)


def _read(col, kind) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in col.to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _prepared(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(packed(docs, text_col), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("_doc"),
                       F.xxhash64(F.lit(10), text).alias("_row"), text.cast("binary").alias("_text")).withColumn("_b", _bucket_col(buckets))


def _emit_contexts(window: int, parts: int, buckets: int, flush: int = 200_000):
    """Task of step 1: packed contexts by destination; local copies become spans (kind 0)."""
    def packed(held):
        g, c, doc, row, lo, more = (np.concatenate(x) for x in zip(*held))
        by = np.lexsort((doc, c, g))
        g, c, doc, row, lo, more = (x[by] for x in (g, c, doc, row, lo, more))
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = doc > least
        spans = _rows(0, _bucket(doc[gone], row[gone], buckets), doc=doc[gone], row=row[gone],
                      lo=lo[gone], n=more[gone].astype(np.int32) + window)
        keep = np.flatnonzero(~gone)
        keep = keep[np.lexsort((lo[keep], row[keep], doc[keep]))]  # near values next to each other compress well
        g, c, doc, row, lo, more = (x[keep] for x in (g, c, doc, row, lo, more))
        entries = _rows(1, (g % np.uint64(parts)).astype(np.int64), ENTRY_PLANES, g=(g // np.uint64(parts)).astype(np.uint32), c=c,
                        doc=doc, row=row, lo=lo, n=more)
        return _batch(spans + entries)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            buf, off = utf8(batch.column(2))
            for i, j in pieces(off, 1 << 18):
                g, c, doc, lo, more = contexts(buf[off[i]:off[j]], off[i:j + 1] - off[i], window)
                if len(g):
                    held.append((g, c, ids[i + doc], rows[i + doc], lo, more))
                    size += len(g)
                if size >= flush:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)
    return run


def _resolve(window: int, buckets: int, parts: int, hot: int):
    """Task of step 2: spans of equal contexts (kind 0), requests for the bytes of others (kind 1, hot 2)."""
    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        spans, t = (table.take(np.flatnonzero(kind == k)) for k in (0, 1))
        if not len(t):
            return spans
        counts = np.array([len(x) for x in t["n"].to_pylist()])
        part = np.repeat(t["part"].to_numpy().astype(np.uint64), counts)
        g = _read(t["g"], np.uint32).astype(np.uint64) * np.uint64(parts) + part
        c, lo = (_read_planes(t[k], kind, ENTRY_PLANES[k]) for k, kind in (("c", np.uint64), ("lo", np.uint32)))
        doc, row, more = _read(t["doc"], np.int64), _read(t["row"], np.int64), _read(t["n"], np.uint8)
        by = np.lexsort((doc, c, g))
        g, c, doc, row, lo, more = (x[by] for x in (g, c, doc, row, lo, more))
        new_g = np.concatenate([[True], g[1:] != g[:-1]])
        new_c = new_g | np.concatenate([[True], c[1:] != c[:-1]])
        least = doc[np.flatnonzero(new_c)][np.cumsum(new_c) - 1]
        gone = doc > least
        at_g = np.cumsum(new_g) - 1
        starts = np.flatnonzero(new_g)
        kinds = np.add.reduceat(new_c.astype(np.int64), starts)
        differ = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
        ask = ~gone & (kinds > 1)[at_g] & differ[at_g]
        crowd = ask & (np.add.reduceat(ask.astype(np.int64), starts) > hot)[at_g]
        out = _rows(0, _bucket(doc[gone], row[gone], buckets), doc=doc[gone], row=row[gone], lo=lo[gone],
                    n=more[gone].astype(np.int32) + window)
        for k, mask in ((1, ask & ~crowd), (2, crowd)):
            out += _rows(k, _bucket(doc[mask], row[mask], buckets), g=g[mask], doc=doc[mask], row=row[mask],
                         lo=lo[mask], n=more[mask])
        return pa.concat_tables([spans.select(_BLOB_ARROW.names).cast(_BLOB_ARROW), pa.Table.from_batches([_batch(out)])])
    return run


def _text_places(t: pa.Table):
    """Sorted (doc, row) of a group's texts with their place, and their bytes.

    Two texts of one id with one 64-bit hash would be taken for copies: they are
    compared, and such a pair (one in 10^9 runs with 200,000 rows an id) ends the job.
    """
    doc, row = t["_doc"].to_numpy(), t["_row"].to_numpy()
    by = np.lexsort((row, doc))
    buf, off = utf8(t["_text"])
    same = np.flatnonzero((doc[by[1:]] == doc[by[:-1]]) & (row[by[1:]] == row[by[:-1]]))
    for i, j in zip(by[same].tolist(), by[same + 1].tolist()):
        if not np.array_equal(buf[off[i]:off[i + 1]], buf[off[j]:off[j + 1]]):
            raise RuntimeError(f"two texts of id {doc[i]} have one hash; give their rows other ids")
    return doc, row, by, buf, off


def _find(doc, row, by, want_doc, want_row) -> np.ndarray:
    """Place of each wanted (doc, row) among a group's texts."""
    pair = np.dtype([("d", np.int64), ("r", np.int64)])
    have = np.empty(len(doc), pair)
    have["d"], have["r"] = doc[by], row[by]
    want = np.empty(len(want_doc), pair)
    want["d"], want["r"] = want_doc, want_row
    kinds, inv = np.unique(want, return_inverse=True)
    return by[np.searchsorted(have, kinds)][inv]


def _fetch(window: int, parts: int):
    """Task of step 3: the bytes of requested contexts, by destination (``c`` holds the bytes)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            doc, row, by, buf, off = _text_places(left)
            for kind in (1, 2):
                t = right.filter(pa.array(right["kind"].to_numpy() == kind))
                if not len(t):
                    continue
                g, d, r = _read(t["g"], np.uint64), _read(t["doc"], np.int64), _read(t["row"], np.int64)
                lo, more = _read(t["lo"], np.uint32).astype(np.int64), _read(t["n"], np.uint8).astype(np.int64)
                start = off[_find(doc, row, by, d, r)] + lo
                if kind == 2:  # single windows, dealt by their own bytes
                    of = np.repeat(np.arange(len(g)), more + 1)
                    o = np.arange(len(of)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
                    start, lo, d, r = start[of] + o, lo[of] + o, d[of], r[of]
                    more = np.zeros(len(of), np.int64)
                    g = span_hash(buf, start, start + window)
                    first = np.lexsort((d, g))  # one of each string and id, copies within this task are left to step 4
                    g, start, lo, d, r, more = (x[first] for x in (g, start, lo, d, r, more))
                size = more + window
                part = (mixed(g) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                for ix in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    s = size[ix]
                    at = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + np.repeat(start[ix], s)
                    out.append({"kind": 1, "part": int(part[ix[0]]), "c": buf[at].tobytes(), "doc": d[ix].tobytes(),
                                "row": r[ix].tobytes(), "lo": lo[ix].astype(np.uint32).tobytes(),
                                "n": more[ix].astype(np.uint8).tobytes()})
        return pa.Table.from_batches([_batch(out)])
    return run


def previous_factors(buf: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Which windows start in a smaller document too.

    Windows are put in suffix order (prefixes of ``window`` bytes). Within a run
    of common prefix ``window``, a smaller id stands before or after a suffix just
    if the run's least id is below its own, which one minimum a run tells.
    """
    if not len(at):
        return np.zeros(0, bool)
    words = []
    for k in range(0, window, 8):
        w = np.zeros(len(at), np.uint64)
        for j in range(min(8, window - k)):
            w |= buf[at + (k + j)].astype(np.uint64) << np.uint64(56 - 8 * j)
        words.append(w)
    order = np.lexsort(words[::-1])
    new = np.zeros(len(at), bool)
    new[0] = True
    for w in words:
        s = w[order]
        new[1:] |= s[1:] != s[:-1]
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.zeros(len(at), bool)
    out[order] = least < doc[order]
    return out


def _suffixes(window: int, buckets: int):
    """Task of step 4: spans of the windows with a longest previous factor of ``window`` or more."""
    none = pa.Table.from_batches([_batch([])])

    def run(t: pa.Table) -> pa.Table:
        doc, row, lo = _read(t["doc"], np.int64), _read(t["row"], np.int64), _read(t["lo"], np.uint32)
        more, buf = _read(t["n"], np.uint8).astype(np.int64), _read(t["c"], np.uint8)
        if not len(doc):
            return none
        size = more + window
        base = np.cumsum(size) - size
        of = np.repeat(np.arange(len(doc)), more + 1)
        o = np.arange(len(of)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
        hit = np.flatnonzero(previous_factors(buf, base[of] + o, doc[of], window))
        if not len(hit):
            return none
        # the windows of one context overlap, so those hit unite to one span
        e, o = of[hit], o[hit]
        first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        last = np.concatenate([first[1:], [len(e)]]) - 1
        e, a, b = e[first], o[first], o[last]
        return pa.Table.from_batches([_batch(_rows(0, _bucket(doc[e], row[e], buckets), doc=doc[e], row=row[e],
                                                   lo=lo[e] + a.astype(np.uint32), n=(b - a + window).astype(np.int32)))])
    return run


def _cut(as_text: bool):
    """Task of step 5: rows with the united spans and the bytes that stay."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, row, by, buf, off = _text_places(left)
        edge = np.zeros(len(buf) + 1, np.int32)
        texts = np.arange(len(doc))
        if len(right) and len(left):
            d, r = _read(right["doc"], np.int64), _read(right["row"], np.int64)
            lo, n = _read(right["lo"], np.uint32).astype(np.int64), _read(right["n"], np.int32)
            place = _find(doc, row, by, d, r)
            np.add.at(edge, off[place] + lo, 1)
            np.add.at(edge, off[place] + lo + n, -1)
            # repeated rows share the spans of the first of them
            s_doc, s_row = doc[by], row[by]
            new = np.concatenate([[True], (s_doc[1:] != s_doc[:-1]) | (s_row[1:] != s_row[:-1])])
            texts[by] = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        spans, kept = [], []
        for i in range(len(doc)):
            a, b = off[texts[i]], off[texts[i] + 1]
            mask, text = gone[a:b], buf[a:b]
            if mask.any():
                turn = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                spans.append(turn.reshape(-1, 2).tolist())
                kept.append(text[~mask].tobytes())
            else:
                spans.append([])
                kept.append(text.tobytes())
        if as_text:
            return pa.table({"_in": left["_in"], "kept_text": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())})
        return pa.table({"_in": left["_in"], "n_bytes": pa.array((off[1:] - off[:-1])[texts] if len(doc) else [], pa.int64()),
                         "removed_spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                         "kept_bytes": pa.array(kept, pa.binary())})
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                   bytes_per_part: int = 8 << 20, bytes_per_group: int = 4 << 20, hot: int = 50_000,
                   as_text: bool = False) -> DataFrame:
    """``docs`` without ``text_col``, with ``n_bytes``, ``removed_spans`` and ``kept_bytes``.

    Spans are [start, end) byte places of the UTF-8 text, united and in order.
    A task holds the anchors of ``bytes_per_part`` of text, or ``bytes_per_group``
    of texts (at least one text). ``as_text`` gives ``kept_text`` instead; what is left of a character that was
    cut through is dropped there.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts, groups = (max(1, math.ceil(total / size)) | 1 for size in (bytes_per_part, bytes_per_group))
    rows = _prepared(docs, id_col, text_col, groups)
    anchors = rows.select("_doc", "_row", "_text").mapInArrow(released(_emit_contexts(window, parts, groups)), _BLOB)
    # parts and groups are keys: a shuffle partition holds many, a task looks at one after another
    found = staged(anchors.groupBy("part").applyInArrow(_resolve(window, groups, parts, hot), _BLOB), "spans")
    texts = rows
    asked = found.where("kind > 0")
    bytes_of = texts.groupBy("_b").cogroup(asked.groupBy("part")).applyInArrow(_fetch(window, groups), _BLOB)
    more = bytes_of.groupBy("part").applyInArrow(_suffixes(window, groups), _BLOB)
    spans = found.where("kind = 0").unionByName(more)
    added = {"kept_text": T.StringType()} if as_text else \
        {"n_bytes": T.LongType(), "removed_spans": T.ArrayType(T.ArrayType(T.LongType())), "kept_bytes": T.BinaryType()}
    schema = T.StructType([rows.schema["_in"], *(T.StructField(c, k) for c, k in added.items())])
    return (texts.groupBy("_b").cogroup(spans.groupBy("part")).applyInArrow(_cut(as_text), schema)
            .select(*unpacked(docs, *added, without=text_col)))
