"""Quality rules with suffix-array repetition.

Every document's word sequence gets a suffix array (prefix doubling, refining
only what is still tied, for a whole batch of documents at once). The largest
common prefix of each suffix with its neighbours is the deepest
longest-common-prefix interval it lies in; the left-maximal ones are the
occurrences of maximal repeated substrings. Their spans are united, and a
document is rejected if they cover too large a fraction of its words or if the
longest repeat is too long for the document.

Defined results: a null or empty text has no words and fails the base rule;
very long texts are processed whole (memory grows with the single text);
repeated rows each get their own result; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelens.llm.textcols import SPACE, by_range, mixed, per_doc, pieces, segments, span_hash, utf8, words

# FIXED VALUES: the characters counted as symbols
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def suffix_array(symbol: np.ndarray, end: np.ndarray):
    """Suffix array and neighbour prefixes of many sequences laid end to end.

    ``symbol``: 64-bit symbols, equal only within one sequence. ``end``: for each
    place, where its sequence ends. Returns (order, lcp): suffixes in order and
    the common prefix of each with the one before it (0 for the first).
    """
    n = len(symbol)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, inv, count = np.unique(symbol, return_inverse=True, return_counts=True)
    # a rank is the first place of its group in the suffix order, so that
    # refining one group leaves all others alone
    rank = (np.cumsum(count) - count)[inv]
    levels, active, step = [rank], np.flatnonzero(count[inv] > 1), 1
    while len(active):
        nxt = active + step
        follow = np.full(len(active), -1, np.int64)
        inside = nxt < end[active]
        follow[inside] = rank[nxt[inside]]
        old = rank[active]
        by = np.argsort(old * (n + 1) + follow + 1, kind="stable")
        active, old, follow = active[by], old[by], follow[by]
        new_group = np.concatenate([[True], old[1:] != old[:-1]])
        new_part = new_group | np.concatenate([[True], follow[1:] != follow[:-1]])
        at = np.arange(len(active))
        group_at = np.maximum.accumulate(np.where(new_group, at, 0))
        part_at = np.maximum.accumulate(np.where(new_part, at, 0))
        rank = rank.copy()
        rank[active] = old + part_at - group_at
        levels.append(rank)
        alone = new_part & np.concatenate([new_part[1:], [True]])
        active, step = active[~alone], step * 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    tied = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b, size = order[tied], order[tied - 1], np.zeros(len(tied), np.int64)
    for power in range(len(levels) - 1, -1, -1):
        x, y = a + size, b + size
        ok = np.flatnonzero((x < end[a]) & (y < end[b]))
        same = ok[levels[power][x[ok]] == levels[power][y[ok]]]
        size[same] += 1 << power
    lcp[tied] = size
    return order, lcp


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in the union of spans."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def measure(buf: np.ndarray, off: np.ndarray, min_words: int) -> dict[str, np.ndarray]:
    """Per-document counts of one batch."""
    n = len(off) - 1
    solid = ~SPACE[buf]
    ws, we, wd = words(buf, off)
    total = np.bincount(wd, minlength=n)
    out = {"n_words": total, "word_chars": by_range(solid & ((buf & 0xC0) != 0x80), off),
           "n_symbols": by_range(SYMBOLS[buf], off)}
    # lines that hold a word, equal to an earlier line of the same document
    ls, le, ld = segments(buf != 10, off)
    run = np.concatenate([[0], np.cumsum(solid)])
    has = run[le] > run[ls]
    key = mixed(span_hash(buf, ls[has], le[has]) ^ mixed(ld[has].astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(ld[has], minlength=n) - np.bincount(ld[has][first], minlength=n)
    symbol = mixed(span_hash(buf, ws, we) ^ mixed(wd.astype(np.uint64) + np.uint64(1)))
    last = np.cumsum(total)[wd]
    order, lcp = suffix_array(symbol, last)
    deep = np.zeros(len(order), np.int64)
    deep[order] = np.maximum(lcp, np.concatenate([lcp[1:], [0]])) if len(order) else lcp
    three = np.flatnonzero(deep >= 3)
    out["n_repeat_words"] = per_doc(covered(three, np.full(len(three), 3), len(deep)), wd, n)
    before = np.concatenate([[0], deep[:-1]]) if len(deep) else deep
    start = last - total[wd]
    at = np.arange(len(deep))
    left_maximal = (deep >= min_words) & ((at == start) | (before <= deep))
    spot = np.flatnonzero(left_maximal)
    out["n_maximal_repeats"] = np.bincount(wd[spot], minlength=n)
    out["n_covered_words"] = per_doc(covered(spot, deep[spot], len(deep)), wd, n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, wd[spot], deep[spot])
    out["longest_repeat"] = longest
    return out


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           "n_maximal_repeats", "n_covered_words", "longest_repeat"]


def repetition_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_words: int = 8) -> DataFrame:
    """One row per document with the columns of ``COLUMNS`` (long)."""
    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column(1))
            found = {c: [] for c in COLUMNS}
            for i, j in pieces(off):
                part = measure(buf[off[i]:off[j]], off[i:j + 1] - off[i], min_words)
                for c in COLUMNS:
                    found[c].append(part[c])
            cols = [batch.column(0), *(pa.array(np.concatenate(found[c]).astype(np.int64)) for c in COLUMNS)] \
                if len(batch) else [batch.column(0), *(pa.array([], pa.int64()) for _ in COLUMNS)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *COLUMNS])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS))


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8,
                     max_covered: float = 0.30, max_longest: float = 0.15, floor_words: int = 50) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document.

    The method's verdict keeps a document if maximal repeats of ``min_words``
    words or more cover at most ``max_covered`` of its words and the longest is
    at most ``max_longest`` of them. Two plain copies cover twice their length;
    the second limit acts alone on runs that overlap themselves.
    """
    c = F.col
    base = (c("n_words") < floor_words) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    fine = ((c("n_covered_words") <= max_covered * c("n_words"))
            & (c("longest_repeat") <= max_longest * c("n_words")))
    return (repetition_counts(docs, id_col, text_col, min_words)
            .withColumn("base_failed", base).withColumn("kept", ~base & fine))
