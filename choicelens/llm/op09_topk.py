"""Exact top-k inner-product search by columnar branch and bound.

Every component x becomes floor(scale * x); scores are integer inner products.
Candidates and queries are dealt into blocks of bounded size, and each pair of
blocks is searched in vertical layout: partial scores grow one block of
dimensions at a time, and candidates whose partial score plus the largest
score that their remaining mass allows (Cauchy-Schwarz) stays below the k-th
best sure score are compacted away.

Vectors with a component so large that integer sums could pass 62 bits take an
exact path beside it, on whole integers of any size.

Defined results: vectors that are null or hold a null or non-finite component
take no part. Vectors of different length are never compared. Repeated rows
(same id, same vector) are one query, and as candidates count once each, the
query's own row left out. Ties go to the smaller id. A score beyond a long ranks
by its true value and is given as the nearest long. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def vectors_of(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x array<double>, copies) of every vector that takes part (-0.0 as 0.0)."""
    x = F.col(vec_col)
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), x)
            .where(F.col("id").isNotNull() & F.col(vec_col).isNotNull() & fit)
            .select("id", F.transform(x, lambda v: v.cast("double") + F.lit(0.0)).alias("x"))
            .groupBy("id", "x").agg(F.count(F.lit(1)).alias("copies")))


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    col = table[column].combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def _whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of every component as Python integers."""
    by = Fraction(scale)
    out = np.empty(x.shape, object)
    out.flat = [math.floor(Fraction(v) * by) for v in x.ravel().tolist()]
    return out


def _beyond(score: int) -> bytes | None:
    """A key that orders scores beyond a long (None for others)."""
    if _LEAST < score <= _MOST:
        return None
    size = abs(score).to_bytes(-(-abs(score).bit_length() // 8), "big")
    key = len(size).to_bytes(4, "big") + size
    return key if score > 0 else bytes(255 - b for b in key)


def _own_copies(cand, ids, copies, query, own):
    """Copies of each candidate, less the query's own row."""
    return copies - ((ids == own) & (cand == query).all(axis=1))


def exact_topk(cand, ids, copies, query, own, k: int, scale: float):
    """Top k of whole-integer scores for each query: (query row, row, score) lists."""
    whole, out = _whole(cand, scale), []
    for i, q in enumerate(_whole(query, scale)):
        score = whole.dot(q) if len(q) else np.zeros(len(whole), object)
        rows = np.flatnonzero(_own_copies(cand, ids, copies, query[i], own[i]) > 0).tolist()
        for r in sorted(rows, key=lambda r: (-score[r], ids[r]))[:k]:
            out.append((i, r, int(score[r])))
    return out


def block_hits(cand, ids, copies, query, own, k: int, width: int, scale: float):
    """Each query's best rows of one block: query row, row, score, copies, key beyond a long.

    The columnar search sees the vectors whose sums stay below 62 bits, which
    are all in usual data; pairs with another vector are scored exactly.
    """
    d = max(1, cand.shape[1])
    with np.errstate(over="ignore"):
        low_c, low_q = np.floor(cand * scale), np.floor(query * scale)
    limit = math.sqrt(2.0**62 / d)
    small_c, small_q = (np.abs(x).max(axis=1, initial=0) < limit for x in (low_c, low_q))
    at_c, at_q = np.flatnonzero(small_c), np.flatnonzero(small_q)
    qi, ci, score, mult = block_topk(low_c[at_c], ids[at_c], copies[at_c], low_q[at_q], own[at_q], k, width,
                                     cand[at_c], query[at_q])
    out = [(at_q[qi], at_c[ci], score, mult, [None] * len(qi))]
    for rows_q, rows_c in ((small_q, ~small_c), (~small_q, np.ones(len(cand), bool))):
        rows_q, rows_c = np.flatnonzero(rows_q), np.flatnonzero(rows_c)
        if len(rows_q) and len(rows_c):
            hits = exact_topk(cand[rows_c], ids[rows_c], copies[rows_c], query[rows_q], own[rows_q], k, scale)
            qi, ci = (np.array([h[j] for h in hits], np.int64) for j in (0, 1))
            qi, ci = rows_q[qi], rows_c[ci]
            mult = copies[ci] - ((ids[ci] == own[qi]) & (cand[ci] == query[qi]).all(axis=1))
            out.append((qi, ci, np.array([min(max(h[2], _LEAST), _MOST) for h in hits], np.int64), mult,
                        [_beyond(h[2]) for h in hits]))
    return *(np.concatenate([o[j] for o in out]) for j in range(4)), [key for o in out for key in o[4]]


def block_topk(cand: np.ndarray, ids: np.ndarray, copies: np.ndarray, query: np.ndarray,
               own: np.ndarray, k: int, width: int, cand_x: np.ndarray, query_x: np.ndarray):
    """Top k rows of one candidate block for each query: (query row, row, score, copies).

    ``cand`` and ``query`` hold whole numbers whose sums stay below 2**62, the
    ``_x`` arrays the vectors themselves, which tell a query's own row.
    """
    n, d = cand.shape
    # doubles are exact, and faster, while no sum can pass 2**53
    top = float(np.abs(cand).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(d, 1)
    kind = np.float64 if top < 2.0**53 else np.int64
    order = np.argsort(-cand.astype(np.float64).var(axis=0), kind="stable") if n else np.arange(d)
    tall = np.ascontiguousarray(cand[:, order].T.astype(kind))
    wide = np.ascontiguousarray(query[:, order].astype(kind))
    cuts = [*range(0, d, width), d] if d else [0]

    def rest(a):  # norms of what follows each cut
        sq = np.cumsum((a.astype(np.float64) ** 2)[::-1], axis=0)[::-1]
        return [np.sqrt(sq[c]) if c < d else np.zeros(a.shape[1]) for c in cuts]
    c_rest, q_rest = rest(tall), rest(wide.T)
    out = []
    for lo in range(0, len(query), 256):
        q = wide[lo:lo + 256]
        first = q[:, :cuts[1]] @ tall[:cuts[1]] if d else np.zeros((len(q), n), kind)
        for i in range(len(q)):
            me = ids == own[lo + i]
            need = k + int(me.sum())
            score, alive = first[i], None
            for b in range(1, len(cuts) - 1):
                left = c_rest[b] if alive is None else c_rest[b][alive]
                slack = left * (q_rest[b][lo + i] * (1 + 1e-9)) + 1e-6
                if len(score) > need:
                    low = score - slack
                    sure = np.partition(low, len(low) - need)[len(low) - need]
                    keep = np.flatnonzero(score + slack >= sure)
                    if len(keep) < 0.75 * len(score):
                        score = score[keep]
                        alive = keep if alive is None else alive[keep]
                part = tall[cuts[b]:cuts[b + 1]]
                score = score + q[i, cuts[b]:cuts[b + 1]] @ (part if alive is None else part[:, alive])
            rows = np.arange(n) if alive is None else alive
            mult = copies[rows]
            if me.any():
                same = np.flatnonzero(me[rows])
                mult = mult.copy()
                mult[same] -= (cand_x[rows[same]] == query_x[lo + i]).all(axis=1)
                score, rows, mult = score[mult > 0], rows[mult > 0], mult[mult > 0]
            if len(score) > k:
                worst = np.partition(score, len(score) - k)[len(score) - k]
                best = np.flatnonzero(score >= worst)
                best = best[np.lexsort((ids[rows[best]], -score[best]))[:k]]
                score, rows, mult = score[best], rows[best], mult[best]
            out.append((np.full(len(rows), lo + i), rows, score.astype(np.int64), mult))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out))


def topk_inner_product(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id",
                       vec_col: str = "embedding", scale: float = 256.0, candidate_block: int = 8192,
                       query_block: int = 4096, width: int = 8) -> DataFrame:
    """Each query's ``k`` best rows: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the column ``id``. The stated query set meets
    all rows block by block: a task holds at most about one block of each.
    """
    rows = vectors_of(vectors, id_col, vec_col)
    n, m = (int(x or 0) for x in rows.agg(F.count(F.lit(1)), F.sum(is_query.cast("int"))).first())
    g, h = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(m / query_block))
    spread = F.xxhash64("id", "x")
    cand = (rows.withColumn("g", F.pmod(spread, F.lit(g)).cast("int"))
            .withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))))
    query = (rows.where(is_query).select("id", "x")
             .withColumn("h", F.pmod(spread, F.lit(h)).cast("int"))
             .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(g - 1)))))
    parts = [F.size("x").alias("d"), "g", "h"]
    cand = cand.select("id", "x", "copies", *parts)
    query = query.select("id", "x", F.xxhash64("id", "x").alias("qkey"), *parts)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], pa.binary() if c == "beyond" else pa.int64()) for c in names})
        ids, own = left["id"].to_numpy(), right["id"].to_numpy()
        qi, ci, score, mult, beyond = block_hits(_matrix(left, "x"), ids, left["copies"].to_numpy(),
                                                 _matrix(right, "x"), own, k, width, scale)
        cols = [own[qi], right["qkey"].to_numpy()[qi], ids[ci], score, np.minimum(mult, k)]
        return pa.table({**dict(zip(names, map(pa.array, cols))), "beyond": pa.array(beyond, pa.binary())})

    names = ["query_id", "qkey", "vec_id", "score", "copies", "beyond"]
    hits = (cand.groupBy("d", "g", "h").cogroup(query.groupBy("d", "g", "h"))
            .applyInArrow(search, "query_id long, qkey long, vec_id long, score long, copies long, beyond binary"))
    w = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id")
    return (hits.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
