"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Equal fingerprints are collapsed first. Two fingerprints within the radius of
each other have a common point within half the radius of both, so each emits
all variants in that half-ball, variants are shuffled, and pairs that collide
are verified by their bit distance.

At full width the half-ball of radius 4 on 64 bits holds 2,081 variants a
fingerprint. With ``segments=2`` (the default) the pigeonhole principle comes
first: a pair within 4 bits has one 32-bit half within 2 bits, so each half
emits its own half-ball (33 variants, 66 in all). ``segments=1`` is the plain
form; both give the same links.

Within a variant's bucket links are found as a spanning forest, never as all
pairs. Buckets beyond ``bucket_limit`` fingerprints are not compared pairwise:
their members emit the full-width half-ball instead, where any two members of a
bucket are within the radius by the triangle inequality, so a star to the
smallest member is exact and its cost linear.

Components: alternating large-star and small-star over the links, staged by
checkpoint() in the shared folder.

Defined results: null and empty texts have fingerprint zero, linked as any
other; rows with a null id have a fingerprint and a component but never name
one unless all its members' ids are null (component null); repeated rows give
a row each; very long texts are read whole; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelens.llm.carry import packed, unpacked
from choicelens.llm.workers import released

_XXH = partial(xxhash.xxh64_intdigest, seed=42)


def shingle_hashes(text: bytes, size: int = 4, block: int = 1 << 16):
    """XXH64 arrays of a lower-cased text's word shingles, in blocks."""
    w = text.lower().split()  # bytes: A-Z only, and white space 0x20, 0x09-0x0D
    if not w:
        return
    if len(w) < size:
        yield np.array([_XXH(b" ".join(w))], np.uint64)
        return
    for lo in range(0, len(w) - size + 1, block):
        part = w[lo:lo + block + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size))))
        yield np.fromiter(map(_XXH, shingles), np.uint64, len(part) - size + 1)


def fingerprint(text: bytes, size: int = 4) -> int:
    """Bits set in over half the shingle hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, size):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(doc_id, row, fp) of every row, all long; ``row`` is a hash of the text."""
    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint((t or "").encode("utf-8", "surrogatepass"), size)
                              for t in batch.column(2).to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))],
                                             ["doc_id", "row", "fp"])
    text = F.col(text_col).cast("string")
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
            .mapInArrow(released(run), "doc_id long, row long, fp long"))


def ball(width: int, radius: int) -> list[int]:
    """Masks of all bit flips within the radius."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fps: DataFrame, segments: int, radius: int) -> DataFrame:
    """(segment, variant, fp): the half-ball of every segment of every fingerprint."""
    width = 64 // segments
    masks = F.array(*(F.lit(_signed(m)).cast("long") for m in ball(width, (radius // segments + 1) // 2)))
    low = F.lit(_signed((1 << width) - 1)).cast("long")
    halves = F.array(*(F.struct(F.lit(s).alias("segment"),
                                F.shiftrightunsigned("fp", s * width).bitwiseAND(low).alias("part"))
                       for s in range(segments)))
    return (fps.select("fp", F.explode(halves).alias("h"))
            .select("fp", "h.segment", "h.part", F.explode(masks).alias("mask"))
            .select("segment", F.col("part").bitwiseXOR(F.col("mask")).alias("variant"), "fp"))


def forest(fp: np.ndarray, radius: int, block: int = 512):
    """Edges (as places) that join all of ``fp`` linked within the radius: a spanning forest."""
    n = len(fp)
    root = np.arange(n)
    a_out, b_out = [], []
    for lo in range(0, n, block):
        rows = fp[lo:lo + block]
        for at in range(lo, n, block):
            near = np.bitwise_count(rows[:, None] ^ fp[None, at:at + block]) <= radius
            if at == lo:
                near &= np.tri(len(rows), near.shape[1], -1, dtype=bool).T
            a, b = np.nonzero(near)
            a, b = a + lo, b + at
            while True:
                open_ = root[a] != root[b]
                a, b = a[open_], b[open_]
                if not len(a):
                    break
                ra, rb = root[a], root[b]
                high, lowest = np.maximum(ra, rb), np.minimum(ra, rb)
                pick = np.lexsort((lowest, high))
                first = pick[np.concatenate([[True], high[pick][1:] != high[pick][:-1]])]
                a_out.append(a[first])
                b_out.append(b[first])
                root[high[first]] = lowest[first]
                while True:
                    up = root[root]
                    if (up == root).all():
                        break
                    root = up
    return (np.concatenate(a_out), np.concatenate(b_out)) if a_out else (np.zeros(0, int), np.zeros(0, int))


def bucket_links(fps: DataFrame, segments: int, radius: int, bucket_limit: int) -> tuple[DataFrame, DataFrame]:
    """Verified links of all buckets up to the limit, and the members of larger ones."""
    from pyspark.sql import Window
    keyed = variants(fps, segments, radius).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("segment", "variant"))).where(F.col("n") > 1)

    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        t = pa.concat_tables(tables)
        seg, var, fp, n = (t[c].to_numpy() for c in ("segment", "variant", "fp", "n"))
        by = np.lexsort((fp, var, seg))
        seg, var, fp, n = seg[by], var[by], fp[by].view(np.uint64), n[by]
        start = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (var[1:] != var[:-1])]))
        size = np.diff(np.concatenate([start, [len(fp)]]))
        out_a, out_b = [], []
        two = start[size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        out_a.append(fp[near])
        out_b.append(fp[near + 1])
        for s, m in zip(start[size > 2], size[size > 2]):
            a, b = forest(fp[s:s + m], radius)
            out_a.append(fp[s + a])
            out_b.append(fp[s + b])
        # one link is met in several buckets
        links = np.unique(np.column_stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=0)
        links = np.ascontiguousarray(links)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy().view(np.int64)),
                                          pa.array(links[:, 1].copy().view(np.int64))], ["a", "b"])
    links = keyed.where(F.col("n") <= bucket_limit).mapInArrow(run, "a long, b long").distinct()
    return links, keyed.where(F.col("n") > bucket_limit).select("fp").distinct()


def ball_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links of the full-width half-balls: members of a bucket to its smallest."""
    v = variants(fps, 1, radius)
    least = v.groupBy("variant").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return (v.join(least, "variant").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b")).distinct())


def connected(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node reachable, by alternating large-star and small-star.

    ``edges`` (a, b) are links between different nodes; each round is staged by
    checkpoint(). Grouping is by aggregation (min), so a node with very many
    links costs no single task more than others.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    for _ in range(rounds):
        # large star: each node's larger neighbours to its smallest neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.where("u <> v").distinct().checkpoint()
        # small star: each node's smaller neighbours, and itself, to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
        changed = small.join(e, ["u", "v"], "left_anti").limit(1).count() or small.count() != e.count()
        e = small
        if not changed:
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4,
                    segments: int = 2, bucket_limit: int = 20_000) -> DataFrame:
    """(doc_id, row, fp, component_id, root) of every row; ``root`` names a component whose ids are all null too.

    The verified links cover distinct fingerprints only; copies are members of
    their fingerprint's class.
    """
    fps = fingerprints(docs, id_col, text_col, size).checkpoint()
    kinds = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links, crowded = bucket_links(kinds.select("fp"), segments, radius, bucket_limit)
    links = links.unionByName(ball_links(crowded, radius))
    roots = connected(links)
    kinds = kinds.join(roots, kinds["fp"] == roots["node"], "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = kinds.groupBy("root").agg(F.min("least").alias("component_id"))
    return (fps.join(kinds.join(names, "root").select("fp", "component_id", "root"), "fp")
            .select("doc_id", "row", "fp", "component_id", "root"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row of each component: that of the smallest id (null last), then text hash."""
    found = near_duplicates(docs, id_col, text_col, **params)
    none = F.lit((1 << 63) - 1)
    first = found.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", none).alias("_id"), F.col("row").alias("_row"))).alias("k"))
    keyed = docs.select(packed(docs), F.coalesce(F.col(id_col).cast("long"), none).alias("_id"),
                        F.xxhash64(F.col(text_col).cast("string")).alias("_row"))
    return (keyed.join(first.select("k.*").distinct(), ["_id", "_row"]).dropDuplicates(["_id", "_row"])
            .select(*unpacked(docs)))
