"""Line deduplication across documents with two Bloom filters.

1. Each task hashes the keys of its texts' lines (a line without outer white
   space, A-Z lowered) and sets the bits of the keys met once and of those met
   in more than one text. Both filters are cut into segments; a segment's bits
   from two tasks that set one bit both make it a twice-seen bit. Partial
   segments merge in two steps, so no task reads the bits of all tasks.
2. The twice-seen filter (``max_bits`` at most, the proven bound of what is
   collected and broadcast) tells each task which lines may be repeats. Only
   these leave their task: one row a key and flush, with the places it stands at.
3. Equal keys meet as whole byte strings; least and largest id confirm a repeat
   and give the document that keeps its lines. Places in other documents join
   that verdict and come back to their texts, which lose those lines.

The filter holds ``bits_per_line`` bits a line; beyond ``max_bits`` more lines
are suspected without need, up to all of them, and the result stays the same.

Defined results: a null or empty text is one empty line; keys shorter than
``min_chars`` code points never count; a null id is one document, smaller than
any other; rows of one id are one document, and repeated rows get equal
results; very long texts are read whole; other columns are kept, those named
like an added column are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choicelens.llm.carry import packed, unpacked
from choicelens.llm.staging import staged
from choicelens.llm.textcols import SPACE, pieces, span_hashes, utf8
from choicelens.llm.workers import released

_NULL = -(1 << 63)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PROBES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
SEGMENT_BITS = 22
_PARTIAL = "segment int, once binary, twice binary"
_SUSPECT = ("key binary, first long, last long, doc array<bigint>, k1 array<bigint>, k2 array<bigint>, "
            "line array<int>")


def lines(buf: np.ndarray, off: np.ndarray):
    """Lines of texts laid end to end: starts, ends, document, number within it (an empty text: one line)."""
    n = len(off) - 1
    cut = np.flatnonzero(buf == 10)
    ends = np.concatenate([off[1:], cut])
    order = np.argsort(ends, kind="stable")  # where a text ends at a next one's line break, its end comes first
    ends = ends[order]
    starts = np.zeros(len(ends), np.int64)
    starts[1:] = ends[:-1] + (order[:-1] >= n)
    doc = np.concatenate([np.arange(n), np.searchsorted(off, cut, "right") - 1])[order]
    first = np.searchsorted(doc, np.arange(n))
    return starts, ends, doc, np.arange(len(ends)) - first[doc]


def line_keys(buf: np.ndarray, off: np.ndarray, min_chars: int):
    """Keys of ``min_chars`` code points or more: lowered bytes, starts, ends, document, line number, hash."""
    low = _LOWER[buf]
    starts, ends, doc, number = lines(buf, off)
    solid = np.flatnonzero(~SPACE[buf])
    lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = np.flatnonzero(hi > lo)
    a, b = solid[lo[full]], solid[hi[full] - 1] + 1
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    long = points[b] - points[a] >= min_chars
    full, a, b = full[long], a[long], b[long]
    return low, a, b, doc[full], number[full], span_hashes(low, a, b)


def _bits(keys: np.ndarray, log_bits: int) -> np.ndarray:
    """The filter bits of each key, one row a probe."""
    return np.stack([(keys * p) >> np.uint64(64 - log_bits) for p in _PROBES])


def _pack(bits: np.ndarray, size: int) -> bytes:
    """Sorted bit numbers of a segment, or its bitmap where that is shorter."""
    if len(bits) * 4 < size // 8:
        return bits.astype("<u4").tobytes()
    full = np.zeros(size, np.uint8)
    full[bits] = 1
    return np.packbits(full, bitorder="little").tobytes()


def _unpack(data: bytes, size: int) -> np.ndarray:
    if len(data) == size // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))
    return np.frombuffer(data, "<u4").astype(np.int64)


def _partial_filters(log_bits: int, min_chars: int, flush: int = 1_000_000):
    """Task of step 1: once-seen and twice-seen bits by segment."""
    size = 1 << min(SEGMENT_BITS, log_bits)

    def segments(held):
        kinds, n = np.unique(np.concatenate(held), return_counts=True)
        rows: dict = {}
        for name, keys in (("once", kinds), ("twice", kinds[n > 1])):
            at = np.unique(_bits(keys, log_bits).ravel()).astype(np.int64)
            cuts = np.flatnonzero(np.diff(at // size)) + 1
            for part in np.split(at, cuts) if len(at) else []:
                rows.setdefault(int(part[0] // size), {"once": b"", "twice": b""})[name] = _pack(part % size, size)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(rows), pa.int32()), *(pa.array([r[k] for r in rows.values()], pa.binary()) for k in ("once", "twice"))],
            ["segment", "once", "twice"])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            buf, off = utf8(batch.column(0))
            for i, j in pieces(off):
                _, _, _, doc, _, key = line_keys(buf[off[i]:off[j]], off[i:j + 1] - off[i], min_chars)
                by = np.lexsort((key, doc))
                key, doc = key[by], doc[by]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])  # a text counts a key once
                held.append(key[new])
                count += int(new.sum())
                if count >= flush:
                    yield segments(held)
                    held, count = [], 0
        if count:
            yield segments(held)
    return run


def _merged(log_bits: int):
    """Partial segments to one row each: a bit set once in two of them is a twice-seen bit."""
    size = 1 << min(SEGMENT_BITS, log_bits)

    def run(batches):
        held: dict = {}
        for batch in batches:
            for segment, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                if segment not in held:
                    held[segment] = np.zeros(size, bool), np.zeros(size, bool)
                a, b = held[segment]
                new = _unpack(once, size)
                b[new[a[new]]] = True
                b[_unpack(twice, size)] = True
                a[new] = True
        for segment, (a, b) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int32()), *(pa.array([_pack(np.flatnonzero(x), size)], pa.binary()) for x in (a, b))],
                ["segment", "once", "twice"])
    return run


def twice_seen(docs: DataFrame, text_col: str = "text", min_chars: int = 10, bits_per_line: int = 16,
               max_bits: int = 1 << 31) -> tuple[int, bytes]:
    """Size (as a power of two) and bits of the filter of line keys that more than one row may have."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = docs.agg(F.sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    log_bits = max(16, min(max(1, n * bits_per_line - 1).bit_length(), max_bits.bit_length() - 1))
    size = 1 << min(SEGMENT_BITS, log_bits)
    segments = (1 << log_bits) // size
    merge = _merged(log_bits)
    partial = docs.select(text).mapInArrow(released(_partial_filters(log_bits, min_chars)), _PARTIAL)
    # many tasks' bits of a segment are merged in parts first
    some = partial.repartition("segment", F.pmod(F.xxhash64("once"), F.lit(16))).mapInArrow(merge, _PARTIAL)
    whole = some.repartition(segments, "segment").mapInArrow(merge, _PARTIAL)
    bits = bytearray((1 << log_bits) // 8)
    for r in whole.select("segment", "twice").toLocalIterator():
        full = np.zeros(size, np.uint8)
        full[_unpack(bytes(r["twice"]), size)] = 1
        bits[r["segment"] * size // 8:(r["segment"] + 1) * size // 8] = np.packbits(full, bitorder="little").tobytes()
    return log_bits, bytes(bits)


def _suspects(log_bits: int, twice, min_chars: int, flush: int = 100_000):
    """Task of step 2: lines whose key has all its bits in the twice-seen filter, one row a key."""
    def rows(held):
        first, last, at = [], [], []
        for x in held.values():
            cols = list(zip(*x))
            first.append(min(cols[0]))
            last.append(max(cols[0]))
            at.append(cols)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
             *(pa.array([c[i] for c in at], pa.list_(k)) for i, k in enumerate(kinds))],
            ["key", "first", "last", "doc", "k1", "k2", "line"])

    def run(batches):
        seen = np.frombuffer(twice.value, np.uint8)
        held, count = {}, 0
        for batch in batches:
            ids, k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            buf, off = utf8(batch.column(3))
            for i, j in pieces(off):
                low, a, b, doc, number, key = line_keys(buf[off[i]:off[j]], off[i:j + 1] - off[i], min_chars)
                bits = _bits(key, log_bits).astype(np.int64)
                hit = np.flatnonzero(((seen[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).all(axis=0))
                doc, raw = doc[hit] + i, low.tobytes()
                for x in zip(a[hit].tolist(), b[hit].tolist(), ids[doc].tolist(), k1[doc].tolist(), k2[doc].tolist(),
                             number[hit].tolist()):
                    held.setdefault(raw[x[0]:x[1]], []).append(x[2:])
                count += len(hit)
                if count >= flush:
                    yield rows(held)
                    held, count = {}, 0
        if held:
            yield rows(held)
    return run


def _cut(batches):
    """Texts without the lines whose numbers stand in the last column."""
    for batch in batches:
        texts, gone = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        kept = []
        for text, drop in zip(texts, gone):
            if drop:
                drop = set(drop)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
            kept.append(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x.count("\n") + 1 for x in texts], pa.int64()),
             pa.array([len(x or ()) for x in gone], pa.int64()), pa.array(kept, pa.string())],
            ["_in", "n_lines", "n_dropped", "kept_text"])


def repeated_lines(rows: DataFrame, min_chars: int, bits_per_line: int, max_bits: int) -> DataFrame:
    """(_doc, _k1, _k2, _lines): numbers of the lines that each text loses."""
    log_bits, bits = twice_seen(rows, "_text", min_chars, bits_per_line, max_bits)
    twice = rows.sparkSession.sparkContext.broadcast(bits)
    found = staged(rows.select("_doc", "_k1", "_k2", "_text")
                   .mapInArrow(released(_suspects(log_bits, twice, min_chars)), _SUSPECT), "suspects")
    # the least id keeps the lines; a key of one document only was a false alarm, or repeats within it
    keeps = (found.groupBy("key").agg(F.min("first").alias("keeps"), F.max("last").alias("_last"))
             .where("keeps < _last").select("key", "keeps"))
    places = (found.join(keeps, "key")
              .select("keeps", F.explode(F.arrays_zip("doc", "k1", "k2", "line")).alias("at"))
              .where("at.doc > keeps"))
    return (places.groupBy(F.col("at.doc").alias("_doc"), F.col("at.k1").alias("_k1"), F.col("at.k2").alias("_k2"))
            .agg(F.collect_set("at.line").alias("_lines")))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                        bits_per_line: int = 16, max_bits: int = 1 << 31) -> DataFrame:
    """``docs`` without ``text_col``, with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A text is told apart from others of its id by two seeded 64-bit hashes.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        packed(docs, text_col), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("_doc"),
        F.xxhash64(F.lit(1), text).alias("_k1"), F.xxhash64(F.lit(2), text).alias("_k2"), text.alias("_text"))
    gone = repeated_lines(rows, min_chars, bits_per_line, max_bits)
    both = rows.join(gone, ["_doc", "_k1", "_k2"], "left").select("_in", "_text", "_lines")
    added = {"n_lines": T.LongType(), "n_dropped": T.LongType(), "kept_text": T.StringType()}
    schema = T.StructType([rows.schema["_in"], *(T.StructField(c, k) for c, k in added.items())])
    return both.mapInArrow(released(_cut), schema).select(*unpacked(docs, *added, without=text_col))
