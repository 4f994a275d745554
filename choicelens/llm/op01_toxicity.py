"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over the whole corpus. A token that may
hide a word (symbols or digits among letters, runs of three or more of a
character, single characters in a row) becomes a lattice: digits and symbols
may stand for letters, runs may shrink, separators may vanish or end a word.
Viterbi decoding under the character model and the channel's costs restores it;
plain words restore to themselves. The restored words are scored by a lexicon
of words and word beginnings learned from labelled documents, counted by their
distinct contexts so that copies of one document count once, and a logistic
curve over the largest and the summed weight.

Defined results: null and empty texts have no word and get the curve's lowest
score; very long texts and tokens are read whole in linear time; repeated rows
score alike; rows with null ids are scored; without labels of both classes no
lexicon is learned and all documents get the smoothed share of label 1;
other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelens.llm.labels import held_out, training_sample
from choicelens.llm.tokens import text_groups

# FIXED VALUES: letters that digits and symbols are commonly written for
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
# FIXED VALUES: channel costs in nats
AS_LETTER, DROP, BREAK, SPACE_DROP, SHRINK, HALVE, LEET_DROP = 0.5, 1.5, 0.5, 0.3, 0.5, 6.0, 5.0

# character classes: 0 boundary, 1-26 a-z, then the Latin-1 letters, then any other letter
_LAST = 0x100
_OTHER = 27 + (_LAST - 0xDF)
SIZE = _OTHER + 1
CLASS = np.zeros(0x110000, np.uint8)
CLASS[[c for c in range(0x110000) if chr(c).isalpha()]] = _OTHER
CLASS[97:123] = np.arange(1, 27)
for _c in range(0xDF, _LAST):
    if CLASS[_c]:
        CLASS[_c] = 27 + _c - 0xDF

_RUN3 = re.compile(r"(.)\1\1", re.S)
_RUN = re.compile(r"(.)\1*", re.S)
_EDGE_RUN = re.compile(r"^(?:([^\w\s])\1{2,})+|(?:([^\w\s])\2{2,})+$")
_PUNCT = ".,;:!?()[]{}\"'«»…-–"


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of letter-class trigrams over every whole text, (SIZE, SIZE, SIZE)."""
    def run(batches):
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in text_groups(texts):
                part = "  ".join(["", *(t for t in texts[i:j] if t), ""]).lower()
                c = CLASS[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
                total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["g", "n"])
    rows = (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "g long, n long")
            .groupBy("g").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(SIZE**3, np.int64)
    if rows:
        out[[r["g"] for r in rows]] = [r["n"] for r in rows]
    return out.reshape(SIZE, SIZE, SIZE)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated from trigrams, bigrams and single letters."""
    c3 = counts.astype(np.float64)
    c3[:, 0, 0] = 0  # runs of blanks and symbols say nothing about words
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 0.5) / (c1.sum() + 0.5 * SIZE)
    p2 = (c2 + 2 * p1) / (c2.sum(1, keepdims=True) + 2)
    p3 = (c3 + 2 * p2[None]) / (c3.sum(2, keepdims=True) + 2)
    return np.log(p3).astype(np.float32)


class Decoder:
    """Restores tokens under a character model."""

    def __init__(self, logp: np.ndarray):
        self.logp = logp

    @staticmethod
    def plain(token: str) -> str | None:
        """The word of a token that hides nothing, else None."""
        core = token.strip(_PUNCT)
        if core.isalpha():
            return None if _RUN3.search(core) else core
        core = _EDGE_RUN.sub("", core).strip(_PUNCT)
        if not core or (core.isalpha() and not _RUN3.search(core)):
            return core
        return None

    def restore(self, token: str) -> list[str]:
        """Words of the best path through the token's lattice."""
        word = self.plain(token)
        if word is not None:
            return [word] if word else []
        return self.viterbi(_EDGE_RUN.sub("", token.strip(_PUNCT)))

    def viterbi(self, text: str) -> list[str]:
        logp = self.logp
        # state: the last two letter classes -> (score, (parent, character))
        states = {(0, 0): (0.0, None)}
        runs = [(m[1], len(m[0])) for m in _RUN.finditer(text)]
        for i, (s, size) in enumerate(runs):
            arcs = []  # (cost, emitted characters; "" drops, " " breaks)
            if s.isalpha():
                if size == 1:
                    arcs = [(0.0, s)]
                elif size == 2:
                    arcs = [(0.0, s * 2), (HALVE, s)]
                else:
                    arcs = [(SHRINK, s), (SHRINK, s * 2)]
            else:
                for letter in LEET.get(s, ""):
                    arcs.append((AS_LETTER, letter))
                    if size > 1:
                        arcs.append((AS_LETTER, letter * 2))
                spelt = 0 < i < len(runs) - 1 and self._lone(runs, i - 1) and self._lone(runs, i + 1)
                drop = SPACE_DROP if s.isspace() or spelt and s not in LEET else LEET_DROP if s in LEET else DROP
                arcs += [(drop, ""), (LEET_DROP if s in LEET else BREAK, " ")]
            after: dict = {}
            for (a, b), (score, trail) in states.items():
                for cost, out in arcs:
                    x, y, total, t = a, b, score - cost, trail
                    for ch in out:
                        c = 0 if ch == " " else int(CLASS[ord(ch)])
                        if not (c == 0 and y == 0):
                            total += float(logp[x, y, c])
                        x, y, t = (0, 0, (t, ch)) if c == 0 else (y, c, (t, ch))
                    best = after.get((x, y))
                    if best is None or total > best[0]:
                        after[(x, y)] = (total, t)
            states = after
        trail = max(((s + (float(logp[a, b, 0]) if b else 0.0), i, t) for i, ((a, b), (s, t)) in
                     enumerate(states.items())), key=lambda r: (r[0], -r[1]))[2]
        chars = []
        while trail is not None:
            trail, ch = trail
            chars.append(ch)
        return "".join(reversed(chars)).split()

    @staticmethod
    def _lone(runs: list, i: int) -> bool:
        """A single letter (or a character that may stand for one) between separators."""
        def letter(j):
            return 0 <= j < len(runs) and (runs[j][0].isalpha() or runs[j][0] in LEET)
        return letter(i) and runs[i][1] <= 2 and not letter(i - 1) and not letter(i + 1)

    def words(self, text: str) -> list[tuple[str, list[str]]]:
        """(token, restored words) of a text; three or more single characters in a row are one token."""
        tokens = text.lower().split()
        return [(t, self.restore(t)) for t in joined(tokens)]


def joined(tokens: list[str]) -> list[str]:
    """Tokens, with each row of three or more single letters or digits as one spaced token."""
    singles = [i for i, t in enumerate(tokens) if len(t) == 1]
    if len(singles) < 3:
        return tokens
    out, at, i = [], 0, 0
    while i < len(singles):
        j = i
        while j + 1 < len(singles) and singles[j + 1] == singles[j] + 1:
            j += 1
        if j - i >= 2:
            out += tokens[at:singles[i]]
            # one and the same character repeated is filler, not a spelt word
            row = tokens[singles[i]:singles[j] + 1]
            out += [" ".join(row)] if len(set(row)) > 1 else row
            at = singles[j] + 1
        i = j + 1
    return out + tokens[at:]


def parts(word: str) -> list[str]:
    """Lexicon entries of a word: itself and its beginnings of 4 to 6 letters."""
    return [word, *(f"{word[:k]}~" for k in (4, 5, 6) if len(word) > k)]


class Scorer:
    """Weights of tokens, kept by token up to a bounded number."""

    def __init__(self, decoder: Decoder, lexicon: dict[str, float], keep: int = 400_000):
        self.decoder, self.lexicon, self.keep, self.known = decoder, lexicon, keep, {}

    def weight(self, token: str) -> float:
        return max((self.lexicon.get(p, 0.0) for w in self.decoder.restore(token) for p in parts(w)), default=0.0)

    def measure(self, text: str | None) -> tuple[float, float]:
        """Largest and summed weight of a text's tokens."""
        if not text:
            return 0.0, 0.0
        tokens = joined(text.lower().split())
        values = list(map(self.known.get, tokens))
        if None in values:
            if len(self.known) > self.keep:
                self.known.clear()
            for i, v in enumerate(values):
                if v is None:
                    t = tokens[i]
                    v = self.known.get(t)
                    if v is None:
                        v = self.weight(t)
                        if len(t) < 64:
                            self.known[t] = v
                    values[i] = v
        hits = [v for v in values if v]
        return (max(hits), sum(hits)) if hits else (0.0, 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the constant is not shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - keep * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _inputs(m: np.ndarray) -> np.ndarray:
    return np.column_stack([m[:, 0], np.log1p(m[:, 1])])


class ToxicityModel:
    def __init__(self, logp: np.ndarray, lexicon: dict[str, float], curve: np.ndarray):
        self.logp, self.lexicon, self.curve = logp, lexicon, curve

    def scorer(self) -> Scorer:
        return Scorer(Decoder(self.logp), self.lexicon)

    def probability(self, m: np.ndarray) -> np.ndarray:
        z = self.curve[0] + _inputs(m) @ self.curve[1:]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", bound: int = 12_000,
                 min_contexts: int = 5, min_weight: float = 2.0, id_col: str = "doc_id",
                 text_col: str = "text") -> ToxicityModel:
    """Character model over all of ``docs``; lexicon and curve from at most ``bound`` labelled rows.

    The sample's ids are broadcast (``bound`` small rows); its texts are staged
    once in the shared checkpoint folder. The lexicon holds what occurs in at
    least ``min_contexts`` different contexts of documents labelled 1.
    """
    logp = language_model(trigram_counts(docs, text_col))
    sample = training_sample(labels, label_col, bound)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text").checkpoint()

    def contexts(batches):
        decoder = Decoder(logp)
        for batch in batches:
            entry, context = [], []
            for text in batch.column(0).to_pylist():
                found = [w for _, ws in decoder.words(text or "") for w in ws]
                for i, w in enumerate(found):
                    around = hash_pair(found[i - 1] if i else "", found[i + 1] if i + 1 < len(found) else "")
                    for p in parts(w):
                        entry.append(p)
                        context.append(around)
            yield pa.RecordBatch.from_arrays([pa.array(entry, pa.string()), pa.array(context, pa.int64())],
                                             ["entry", "context"])

    def counted(label: int) -> DataFrame:
        return rows.where(F.col("label") == label).select("text").mapInArrow(contexts, "entry string, context long")
    hot = {r[0]: r[1] for r in counted(1).distinct().groupBy("entry").count()
           .where(F.col("count") >= min_contexts).collect()}

    def others(batches):
        decoder = Decoder(logp)
        n: dict = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen = {p for _, ws in decoder.words(text or "") for w in ws for p in parts(w) if p in hot}
                for p in seen:
                    n[p] = n.get(p, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())],
                                         ["entry", "n"])
    cold = {r[0]: r[1] for r in rows.where(F.col("label") == 0).select("text")
            .mapInArrow(others, "entry string, n long").groupBy("entry").agg(F.sum("n")).collect()}
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    lexicon = {}
    for entry, count in hot.items():
        weight = math.log((count + 0.5) / (n1 + 1)) - math.log((cold.get(entry, 0) + 0.5) / (n0 + 1))
        if n0 and weight >= min_weight:
            lexicon[entry] = weight
    measured = _measured(rows.select("doc_id", "label", "text"), ToxicityModel(logp, lexicon, np.zeros(3)),
                         "doc_id long, label int, top double, total double").collect()
    m = np.array([[r["top"], r["total"]] for r in measured]).reshape(-1, 2)
    y = np.array([r["label"] for r in measured], float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    curve = _logistic(_inputs(m), y) if n0 and n1 else np.array([math.log(share / (1 - share)), 0.0, 0.0])
    return ToxicityModel(logp, lexicon, curve)


def hash_pair(a: str, b: str) -> int:
    """A stable 64-bit key of two words."""
    import xxhash
    return xxhash.xxh64_intdigest(f"{a}\0{b}") - (1 << 63)


def _measured(rows: DataFrame, model: ToxicityModel, schema: str) -> DataFrame:
    """The leading columns of ``rows`` (its last is the text) with largest and summed weight."""
    def run(batches):
        scorer = model.scorer()
        for batch in batches:
            m = np.array([scorer.measure(t) for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(-1, 2)
            cols = [*batch.columns[:-1], pa.array(m[:, 0]), pa.array(m[:, 1])]
            yield pa.RecordBatch.from_arrays(cols, [f"c{i}" for i in range(len(cols))])
    return rows.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    m = _measured(rows, model, "doc_id long, top double, total double")
    a, b, c = (float(x) for x in model.curve)
    z = F.lit(a) + F.lit(b) * F.col("top") + F.lit(c) * F.log1p("total")
    m = m.withColumn("score", 1 / (1 + F.exp(-z)))
    return m.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
