"""Quality classifier: generalised additive model with pairwise interactions.

Each text becomes a row of numeric features, each feature a bin. Cyclic
gradient boosting visits the features in turn and adds a shallow tree's step
function to that feature's lookup table; then the pairs whose joint table best
explains what is left are boosted the same way with one cut on each side. A
score is the logistic of summed table entries, one vectorised lookup per table.

The model is fitted on the driver from the features of at most ``bound``
labelled rows (a documented parameter); features are computed by Spark.

Defined results: a null or empty text has all-zero features and is scored as
such; very long texts are read whole; repeated rows score alike; rows with null
ids are scored; without any labelled row (or with one class only) every score
is the smoothed share of label 1; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choicelens.llm.carry import packed, unpacked
from choicelens.llm.labels import held_out, training_sample
from choicelens.llm.op02_repetition import SYMBOLS
from choicelens.llm.textcols import SPACE, by_range, mixed, per_doc, pieces, segments, span_hash, utf8, words
from choicelens.llm.workers import released

FEATURES = ["log_words", "word_chars", "upper", "symbols", "digits", "stops", "shouts", "distinct", "repeat3",
            "dup_lines", "top_word", "line_words", "short_words", "non_ascii", "symbol_ends", "pipes"]


def _bytes_in(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER, _DIGIT = _bytes_in(bytes(range(65, 91))), _bytes_in(bytes(range(48, 58)))
_ALPHA = _UPPER | _bytes_in(bytes(range(97, 123))) | _bytes_in(bytes(range(128, 256)))
_STOP, _SHOUT, _PIPE = _bytes_in(b".,;:?"), _bytes_in(b"!"), _bytes_in(b"|")


def _distinct(key: np.ndarray, doc: np.ndarray, n: int):
    """Distinct keys and the largest count of one key, by document."""
    key = mixed(key ^ mixed(doc.astype(np.uint64) + np.uint64(1)))
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc[first], count)
    return np.bincount(doc[first], minlength=n), most


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Feature matrix (documents x FEATURES) of texts laid end to end."""
    n = len(off) - 1
    solid = ~SPACE[buf]
    ws, we, wd = words(buf, off)
    nw = np.bincount(wd, minlength=n)
    one = np.maximum(nw, 1)
    chars = by_range(solid & ((buf & 0xC0) != 0x80), off)
    some = np.maximum(chars, 1)
    h = span_hash(buf, ws, we)
    kinds, top = _distinct(h, wd, n)
    inner = np.flatnonzero(wd[2:] == wd[:-2]) if len(wd) > 2 else np.zeros(0, np.int64)
    step = np.uint64(0x9E3779B97F4A7C15)
    tri = (h[inner] * step + h[inner + 1]) * step + h[inner + 2]
    tri_kinds, _ = _distinct(tri, wd[inner], n)
    tri_all = np.maximum(np.bincount(wd[inner], minlength=n), 1)
    ls, le, ld = segments(buf != 10, off)
    run = np.concatenate([[0], np.cumsum(solid)])
    has = run[le] > run[ls]
    lines = np.bincount(ld[has], minlength=n)
    line_kinds, _ = _distinct(span_hash(buf, ls[has], le[has]), ld[has], n)
    size = we - ws
    letters = np.maximum(by_range(_ALPHA[buf] & ((buf & 0xC0) != 0x80), off), 1)
    end = buf[we - 1] if len(we) else np.zeros(0, np.uint8)
    # the share of repeated 3-word windows is 0 for fewer than three words
    return np.column_stack([
        np.log1p(nw), chars / one, by_range(_UPPER[buf], off) / letters, by_range(SYMBOLS[buf], off) / some,
        by_range(_DIGIT[buf], off) / some, by_range(_STOP[buf], off) / some, by_range(_SHOUT[buf], off) / some,
        kinds / one, np.where(tri_kinds > 0, 1 - tri_kinds / tri_all, 0.0), (lines - line_kinds) / np.maximum(lines, 1),
        top / one, nw / np.maximum(lines, 1), per_doc(size <= 3, wd, n) / one,
        by_range(buf >= 0xC0, off) / some, per_doc(SYMBOLS[end] | _SHOUT[end], wd, n) / one,
        by_range(_PIPE[buf], off) / one])


def text_features(column) -> np.ndarray:
    """Features of an Arrow text column, in pieces of bounded size."""
    buf, off = utf8(column)
    parts = [features(buf[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in pieces(off)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


class AdditiveModel:
    """Lookup tables per feature and per chosen pair of features."""

    def __init__(self, bins: int = 32, rounds: int = 200, pairs: int = 8, pair_rounds: int = 60,
                 rate: float = 0.1, min_rows: int = 20, cuts: int = 3):
        self.bins, self.rounds, self.n_pairs, self.pair_rounds = bins, rounds, pairs, pair_rounds
        self.rate, self.min_rows, self.cuts = rate, min_rows, cuts
        self.edges, self.tables, self.pairs = [], [], []
        self.start = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        cols = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]
        return np.column_stack(cols) if cols else np.zeros((len(x), 0), int)

    def _steps(self, g: np.ndarray, w: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Shallow tree on one feature's bins: the best cuts in turn, a Newton step per leaf."""
        leaf, out = [(0, len(g))], np.zeros(len(g))
        for _ in range(self.cuts):
            best = (1e-9, None, None)
            for a, b in leaf:
                if b - a < 2:
                    continue
                gs, hs, cs = np.cumsum(g[a:b]), np.cumsum(w[a:b]), np.cumsum(count[a:b])
                gain = (gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1)
                        - gs[-1] ** 2 / (hs[-1] + 1))
                gain[(cs[:-1] < self.min_rows) | (cs[-1] - cs[:-1] < self.min_rows)] = 0
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], (a, b), a + i + 1)
            if best[1] is None:
                break
            a, b = best[1]
            leaf.remove((a, b))
            leaf += [(a, best[2]), (best[2], b)]
        for a, b in leaf:
            out[a:b] = g[a:b].sum() / (w[a:b].sum() + 1)
        return self.rate * out

    @staticmethod
    def _quadrants(g: np.ndarray, w: np.ndarray):
        """Best cut on either side of a pair's joint table: (gain, table of steps)."""
        gs, hs = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(w, 0), 1)
        tg, th = gs[-1, -1], hs[-1, -1]
        r_g, r_h, c_g, c_h = gs[:-1, -1:], hs[:-1, -1:], gs[-1:, :-1], hs[-1:, :-1]
        a, ah = gs[:-1, :-1], hs[:-1, :-1]
        four = [(a, ah), (r_g - a, r_h - ah), (c_g - a, c_h - ah), (tg - r_g - c_g + a, th - r_h - c_h + ah)]
        gain = sum(x ** 2 / (h + 1) for x, h in four)
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        out = np.empty_like(g)
        for (rows, cols), (x, h) in zip([(slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
                                         (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))], four):
            out[rows, cols] = x[i, j] / (h[i, j] + 1)
        return float(gain[i, j] - tg ** 2 / (th + 1)), out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        n = len(y)
        share = (float(y.sum()) + 0.5) / (n + 1)
        self.start = float(np.log(share / (1 - share)))
        if n == 0 or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        b = self.binned(x)
        sizes = [len(e) + 1 for e in self.edges]
        self.tables = [np.zeros(s) for s in sizes]
        z = np.full(n, self.start)
        for _ in range(self.rounds):
            for f, s in enumerate(sizes):
                p = 1 / (1 + np.exp(-z))
                step = self._steps(np.bincount(b[:, f], y - p, s), np.bincount(b[:, f], p * (1 - p), s),
                                   np.bincount(b[:, f], minlength=s))
                self.tables[f] += step
                z += step[b[:, f]]
        p = 1 / (1 + np.exp(-z))

        def joint(i, j, v):
            return np.bincount(b[:, i] * sizes[j] + b[:, j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
        worth = sorted(((self._quadrants(joint(i, j, y - p), joint(i, j, p * (1 - p)))[0], i, j)
                        for i in range(len(sizes)) for j in range(i) if sizes[i] > 1 and sizes[j] > 1), reverse=True)
        self.pairs = [[i, j, np.zeros((sizes[i], sizes[j]))] for _, i, j in worth[:self.n_pairs]]
        for _ in range(self.pair_rounds):
            for i, j, t in self.pairs:
                p = 1 / (1 + np.exp(-z))
                _, step = self._quadrants(joint(i, j, y - p), joint(i, j, p * (1 - p)))
                t += self.rate * step
                z += self.rate * step[b[:, i], b[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        if self.tables:
            b = self.binned(x)
            for f, t in enumerate(self.tables):
                z += t[b[:, f]]
            for i, j, t in self.pairs:
                z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", bound: int = 20_000,
                id_col: str = "doc_id", text_col: str = "text", **params) -> AdditiveModel:
    """Fit on at most ``bound`` labelled documents outside the held-out fold.

    The sample's ids (``bound`` rows of 12 bytes at most) are broadcast, so no
    text is shuffled; only feature rows reach the driver, ``bound`` at most:
    repeated documents of one id give their first row by feature value.
    """
    sample = training_sample(labels, label_col, bound)
    rows = _plain(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")

    def run(batches):
        for batch in batches:
            x = text_features(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])
    found = (rows.mapInArrow(released(run), "doc_id long, label int, x array<double>")
             .groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r")).select("doc_id", "r.*").collect())
    found.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in found]).reshape(-1, len(FEATURES))
    return AdditiveModel(**params).fit(x, np.array([r["label"] for r in found], float))


def score_quality(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    def run(batches):
        for batch in batches:
            score = model.score(text_features(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"])
    rows = _plain(docs, id_col, text_col).mapInArrow(released(run), "doc_id long, score double, predicted int")
    return rows.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, model: AdditiveModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    rows = docs.select(packed(docs), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            keep = model.score(text_features(batch.column(1))) >= threshold
            yield batch.select([0]).filter(pa.array(keep))
    return rows.mapInArrow(released(run), T.StructType([rows.schema["_in"]])).select(*unpacked(docs))
