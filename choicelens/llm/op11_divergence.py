"""Source divergence audit over term frequencies.

Each task lowers letters and blanks separators of a text's bytes with one
``bytes.translate``, splits it with ``bytes.split`` and counts it with a
``Counter`` of its own; counts and document frequencies are summed by (language,
source) up to a bounded number of entries and leave as sparse rows. Spark sums
them in one shuffle by (language, term), keeps the terms in enough documents of
their language and gives every group smoothed integer rates. Two reports follow:
the divergence of each pair of sources, summed over all kept terms in blocks of
terms by tiles of sources, and each source's most typical terms.

Arithmetic is exact: p = 1 + floor(1e9 * (count + 2) / (N + 2 V)), and
f(p, q) = floor((p - q)^2 / (p + q)), with V kept terms and N of their
occurrences in the group.

Defined results: null text, language and source are ''; every row is a document,
repeated rows and ids included; empty texts have no terms but make their group
occur; very long texts are read whole; ties of a rank go to the smaller item in
UTF-8 order; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicelens.llm.staging import staged
from choicelens.llm.workers import released

# ASCII bytes outside A-Z and a-z separate terms; A-Z are lowered
TABLE = bytes(b if b >= 128 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
_ONE = 1 << 44  # a document, above the occurrences in one number
SCALE = 1_000_000_000


def _counts(flush: int = 400_000):
    """Task of the first pass: (lang, source, term, n, docs), and a row of term '' for each group met."""
    def rows(held):
        cols = ([], [], [], [], [])
        for (lang, source), terms in held.items():
            for c, values in zip(cols, ([lang] * len(terms), [source] * len(terms), terms, terms.values(), terms.values())):
                c.extend(values)
        both = np.array(cols[3], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()).cast(pa.string()),
             pa.array(both & (_ONE - 1)), pa.array(both >> 44)], ["lang", "source", "term", "n", "docs"])

    def run(batches):
        held: dict = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                terms = held.get((lang, source))
                if terms is None:
                    terms = held[lang, source] = {b"": 0}
                size -= len(terms)
                for term, n in Counter(text.encode().translate(TABLE).split()).items():
                    terms[term] = terms.get(term, 0) + n + _ONE
                size += len(terms)
                if size >= flush:
                    yield rows(held)
                    held, size = {}, 0
        if held:
            yield rows(held)
    return run


def kept_terms(docs: DataFrame, min_docs: int, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, n_lang, head): kept terms of each group, one row of term '' a group.

    ``head`` is 1 in one row of each kept term of a language.
    """
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, lang_col, source_col))
    found = docs.select(lang.alias("lang"), source.alias("source"), text.alias("text")).mapInArrow(
        released(_counts()), "lang string, source string, term string, n long, docs long")
    groups = found.repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return (groups.withColumns({"in_lang": F.sum("docs").over(term), "n_lang": F.sum("n").over(term),
                                "head": (F.col("source") == F.min("source").over(term)).cast("int")})
            .where((F.col("in_lang") >= min_docs) | (F.col("term") == ""))
            .select("lang", "source", "term", "n", "n_lang", F.when(F.col("term") == "", 0).otherwise(F.col("head")).alias("head")))


def rate(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 * (count + 2) / (total + 2 * kept)), exact; 1 where no term is kept."""
    top = (count + 2).cast("decimal(27,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = F.greatest(total + 2 * kept, F.lit(1)).cast("decimal(20,0)")
    part = F.call_function("div", top, below)
    return F.when(kept == 0, F.lit(1)).otherwise(part + 1).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); rates are below 2^30, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(tile: int):
    """Sums of f over a block's terms for the pairs of sources of two tiles."""
    def run(key, table):
        a, b = key[2].as_py(), key[3].as_py()
        at, rates = (table[c].to_numpy() for c in ("at", "rate"))
        words = table["term"].combine_chunks().dictionary_encode()
        mark = words.is_null().to_numpy(zero_copy_only=False)
        term = words.indices.fill_null(-1).to_numpy()
        sources = at[mark]
        base = np.zeros(2 * tile, np.int64)
        place = np.where(at // tile == a, at % tile, tile + at % tile)
        base[place[mark]] = rates[mark]
        kinds = len(words.dictionary)
        grid = np.repeat(base[None], kinds, axis=0)
        grid[term[~mark], place[~mark]] = rates[~mark]
        grid = np.ascontiguousarray(grid.T)
        left = np.sort(sources[sources // tile == a])
        right = left if a == b else np.sort(sources[sources // tile == b])
        out = []
        for g in left.tolist():
            p = grid[g % tile]
            for h in right[right > g].tolist() if a == b else right.tolist():
                q = grid[h % tile if a == b else tile + h % tile]
                out.append((g, h, int(((p - q) ** 2 // (p + q)).sum()), kinds))
        cols = list(zip(*out)) if out else [()] * 4
        return pa.table({"lang": pa.array([key[0].as_py()] * len(out), pa.string()),
                         **{c: pa.array(v, pa.int64()) for c, v in zip(("g", "h", "part", "seen"), cols)}})
    return run


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang",
                      source_col: str = "source", tile: int = 64, block_rows: int = 20_000) -> DataFrame:
    """(lang, source, part, item, value, rank): pair divergences and each group's ``top`` typical terms."""
    kept = staged(kept_terms(docs, min_docs, text_col, lang_col, source_col), "kept-terms")
    lang = Window.partitionBy("lang")
    # one row a group
    groups = (kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("head").alias("heads"))
              .withColumns({"v": F.sum("heads").over(lang), "total_lang": F.sum("total").over(lang),
                            "at": F.row_number().over(lang.orderBy("source")).cast("long") - 1,
                            "tiles": F.ceil(F.count(F.lit(1)).over(lang) / tile).cast("long")})
              .withColumn("base", rate(F.lit(0), F.col("total"), F.col("v"))))
    groups = staged(groups, "groups")
    rows = kept.where("term != '' AND n > 0").join(groups, ["lang", "source"]).withColumn(
        "rate", rate(F.col("n"), F.col("total"), F.col("v")))

    q = rate(F.col("n_lang"), F.col("total_lang"), F.col("v"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (rows.withColumn("q", q).where("rate > q")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     divergence(F.col("rate"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))

    # blocks of terms by pairs of tiles; every block has a row (no term) for each source of its tiles
    blocks = max(1, math.ceil(kept.count() / block_rows))
    own = (F.col("at") / tile).cast("long")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(
        F.least(t, own).alias("a"), F.greatest(t, own).alias("b"))))
    in_blocks = rows.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), "at", "rate", "term",
                            pairs.alias("t"))
    marks = (groups.select("lang", "at", F.col("base").alias("rate"), F.lit(None).cast("string").alias("term"), pairs.alias("t"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))))
    sums = (in_blocks.unionByName(marks).select("lang", "block", "t.a", "t.b", "at", "rate", "term")
            .groupBy("lang", "block", "a", "b").applyInArrow(_pair_sums(tile), "lang string, g long, h long, part long, seen long")
            .groupBy("lang", "g", "h").agg(F.sum("part").alias("summed"), F.sum("seen").alias("seen")))
    sums = sums.select("lang", F.explode(F.array(F.struct(F.col("g"), F.col("h")), F.struct(F.col("h").alias("g"), F.col("g").alias("h"))))
                       .alias("s"), "summed", "seen").select("lang", "s.g", "s.h", "summed", "seen")
    one = groups.select("lang", F.col("at").alias("g"), "source", "v", F.col("base").alias("p0"))
    other = groups.select("lang", F.col("at").alias("h"), F.col("source").alias("item"), F.col("base").alias("q0"))
    # terms that neither tile has count as many times the rate of no occurrence
    value = F.col("summed") + (F.col("v") - F.col("seen")) * divergence(F.col("p0"), F.col("q0"))
    pair = (sums.join(one, ["lang", "g"]).join(other, ["lang", "h"])
            .select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
            .withColumn("rank", F.row_number().over(best)))
    return pair.unionByName(terms)
