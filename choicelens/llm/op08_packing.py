"""Sequence packing by a configuration linear program.

Texts are encoded once into pieces of at most ``capacity`` tokens (a longer one
is cut into full pieces after a first, possibly shorter one); the pieces are
staged. Which lengths share a sequence depends on the length histogram only,
one row a length: the driver solves the covering program over configurations
(multisets of lengths that fit) by multiplicative weights. Each round prices
lengths by weight, finds the dearest configuration by a knapsack dynamic
program, takes a step and lowers the weights of what it covers. Amounts are
rounded down; what is left goes by best fit, longest first. Spark then numbers
the pieces of each length and looks up each one's place in the plan.

Defined results: null and empty texts are pieces with the end id alone; repeated
rows are pieces of their own; very long texts are cut, never dropped; other
columns are ignored; an empty table gives no sequences.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelens.llm.ranks import numbered
from choicelens.llm.staging import staged
from choicelens.llm.textcols import pieces, utf8
from choicelens.llm.tokens import encoder
from choicelens.llm.workers import released

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, drops_space: bool = False,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every text: doc_id, piece, start, length, ids_crc32 (and ``ids``, 32-bit little-endian)."""
    def run(batches):
        enc = encoder(path, drops_space)
        for batch in batches:
            docs_ = batch.column(0).to_pylist()
            buf, off = utf8(batch.column(1))
            for i, j in pieces(off):
                ids, n = enc.encode_bytes(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                rows, at = [], 0
                for d, size in zip(docs_[i:j], n.tolist()):
                    own = np.append(ids[at:at + size], np.uint32(end_id)).astype("<u4")
                    at += size
                    first = (len(own) - 1) % capacity + 1
                    cuts = [0, *range(first, len(own) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        raw = own[a:b].tobytes()
                        rows.append((d, k, a, b - a, zlib.crc32(raw), *([raw] if with_ids else [])))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(cols)])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run, ("encoders",)), _PIECE + (", ids binary" if with_ids else ""))


def knapsack(size: np.ndarray, value: np.ndarray, capacity: int) -> Counter:
    """Most valuable multiset of sizes within the capacity (dynamic program over capacities)."""
    worth = np.full(capacity + 1, -np.inf)
    worth[size] = value
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        v = worth[1:c + 1] + best[c - 1::-1]
        k = int(v.argmax())
        if v[k] > best[c - 1]:
            best[c], pick[c] = v[k], k + 1
        else:
            best[c] = best[c - 1]
    out: Counter = Counter()
    c = capacity
    while c > 0:
        if pick[c]:
            out[int(pick[c])] += 1
            c -= int(pick[c])
        else:
            c -= 1
    return out


def configurations(hist: dict[int, int], capacity: int, step: float = 0.1, rate: float = 0.3,
                   power: float = 1.1) -> list[tuple[dict[int, int], float]]:
    """Amounts of configurations that cover the histogram, by multiplicative weights.

    Lengths start priced by their size to the ``power`` (above 1, so that long ones
    go first and short ones are kept to fill up); covering a share s of a length's
    count multiplies its price by exp(-rate * s). A step covers at most the share
    ``step`` of any length it holds, and never more than what is open. Each step
    covers that share of some length, which bounds the steps by the lengths.
    """
    size = np.array(sorted(hist), np.int64)
    need = np.array([hist[s] for s in size], float)
    done, price = np.zeros(len(size)), (size / capacity) ** power
    place = {int(s): i for i, s in enumerate(size)}
    found: dict = {}
    for _ in range(len(size) * (math.ceil(1 / step) + 1)):
        open_ = done < 1 - 1e-9
        if not open_.any():
            break
        config = knapsack(size[open_], price[open_], capacity)
        at = np.array([place[s] for s in config])
        count = np.array(list(config.values()), float)
        amount = float((np.minimum(step, 1 - done[at]) * need[at] / count).min())
        key = tuple(sorted(config.items(), reverse=True))
        found[key] = found.get(key, 0.0) + amount
        gain = amount * count / need[at]
        done[at] += gain
        price[at] *= np.exp(-rate * gain)
    return [(dict(k), x) for k, x in found.items()]


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing; sequences as tuples of lengths, counted.

    Equal sequences are kept as one entry with their number. A step places as
    many copies of a length as there are sequences of the tightest room that
    still takes it, and as many in each as fit, so the steps grow with the
    number of lengths and rooms and not with the number of pieces.
    """
    room: dict[int, Counter] = {}
    mask, out = 0, Counter()

    def put(items, r, m):
        nonlocal mask
        if m and r:
            room.setdefault(r, Counter())[items] += m
            mask |= 1 << r
        elif m:
            out[items] += m

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            fit = mask >> s
            if not fit:
                # new sequences, filled with this length one after another
                k = capacity // s
                put((s,) * k, capacity - k * s, n // k)
                if n % k:
                    put((s,) * (n % k), capacity - n % k * s, 1)
                break
            r = s + (fit & -fit).bit_length() - 1
            items, have = room[r].popitem()
            if not room[r]:
                del room[r]
                mask &= ~(1 << r)
            # the tightest room stays the tightest while it takes the length
            k = r // s
            m = min(have, n // k)
            put(items + (s,) * k, r - k * s, m)
            n -= m * k
            if m < have and n:
                put(items + (s,) * n, r - n * s, 1)
                m, n = m + 1, 0
            put(items, r, have - m)
    for rest in room.values():
        out.update(rest)
    return out


def plan(hist: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of configurations that hold each length exactly as often as it occurs.

    The amounts of all configurations are rounded down; at most one of each
    configuration, and what rounding takes from its lengths, is left to best fit.
    """
    left = {s: n for s, n in hist.items() if n > 0}
    out: Counter = Counter()
    if capacity in left:
        out[(capacity,)] = left.pop(capacity)
    for config, x in sorted(configurations(left, capacity), key=lambda r: -r[1]) if left else []:
        m = min([int(x + 1e-9), *(left.get(s, 0) // a for s, a in config.items())])
        if m:
            out[tuple(s for s, a in sorted(config.items(), reverse=True) for _ in range(a))] += m
            for s, a in config.items():
                left[s] -= m * a
    out.update(best_fit({s: n for s, n in left.items() if n}, capacity))
    return [(dict(Counter(items)), m) for items, m in sorted(out.items())]


def pack(pieces: DataFrame, capacity: int = 1024, rows_per_part: int = 50_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. Lengths lie in 1 .. capacity.

    The plan has a row for each length of each configuration; configurations are
    bounded by the number of lengths, and so is the best-fit rest.
    """
    hist = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    base, rows = 0, []  # (length, first rank, sequence, count in one sequence, offset)
    rank: Counter = Counter()
    for config, m in plan(hist, capacity):
        offset = 0
        for s, a in sorted(config.items(), reverse=True):
            rows.append((s, rank[s], base, a, offset))
            rank[s] += a * m
            offset += a * s
        base += m
    assert rank == Counter({s: n for s, n in hist.items() if n})
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    key = (table[:, 0] << 48) + table[:, 1]
    parts = max(1, math.ceil(sum(hist.values()) / rows_per_part))
    order = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    ranked = numbered(pieces.withColumn("_key", order).withColumn("_part", F.pmod(F.shiftright("_key", 7), F.lit(parts))),
                      ["length"], "_key", "_part", "_slot").drop("_key", "_part")
    names = pieces.columns
    at_length = names.index("length")

    def place(batches):
        for batch in batches:
            size = batch.column(at_length).to_numpy()
            slot = batch.column(len(names)).to_numpy()
            t = table[np.searchsorted(key, (size << 48) + slot, "right") - 1]
            turn, spot = np.divmod(slot - t[:, 1], t[:, 3])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array(t[:, 2] + turn), pa.array(t[:, 4] + spot * size)],
                [*names, "sequence_id", "offset"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*names, "_slot").mapInArrow(released(place), schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, drops_space: bool = False,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, cut and pack all documents: one row a piece."""
    return pack(staged(token_pieces(docs, path, end_id, capacity, drops_space, id_col, text_col, with_ids), "pieces"),
                capacity)
