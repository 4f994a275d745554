"""Toxicity, repetition rules and quality on brute force, held-out rows and edge cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from choicelens.llm import op01_toxicity as tox
from choicelens.llm.op02_repetition import repetition_counts, repetition_rules, suffix_array
from choicelens.llm.op04_quality import AdditiveModel, FEATURES, fit_quality, keep_quality, score_quality
from conftest import SF01
from edge import edge_docs, empty_docs, texts

EMPTY_LABELS = "doc_id long, quality int, toxic int"


def test_repetition_equals_brute_force(spark):
    got = {}
    for r in repetition_counts(edge_docs(spark), min_words=4).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in texts():
        w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        if len(w) > 2000:
            continue
        grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        cover3 = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
        deep = [0] * len(w)
        for a in range(len(w)):
            for b in range(a + 1, len(w)):
                if w[a] != w[b]:
                    continue
                n = 0
                while b + n < len(w) and w[a + n] == w[b + n]:
                    n += 1
                deep[a], deep[b] = max(deep[a], n), max(deep[b], n)
        cover = {a + j for a, n in enumerate(deep) if n >= 4 for j in range(n)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        want = (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"),
                len(lines) - len(set(lines)), len(cover3), len(cover), max([n for n in deep if n >= 4], default=0))
        assert want in [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_covered_words,
                         r.longest_repeat) for r in got[i]], i
    assert sum(map(len, got.values())) == len(texts())


def test_suffix_array_orders_all_suffixes():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 3, 300).astype(np.uint64)
    order, lcp = suffix_array(s, np.full(300, 300))
    suffixes = [tuple(s[k:]) for k in order]
    assert suffixes == sorted(suffixes)
    for a, b, n in zip(suffixes, suffixes[1:], lcp[1:]):
        assert a[:n] == b[:n] and (len(a) == n or a[n] != b[n])


def test_repetition_verdict(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(200))), (2, " ".join([f"w{k}" for k in range(60)] * 2)),
            (3, "few words"), (4, None)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in repetition_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False)}
    assert repetition_rules(empty_docs(spark)).count() == 0


def test_repetition_limits_decide_alone(spark):
    def doc(copies, length, n=200, run=0):
        fill = [f"u{k}" for k in range(n - copies * length - run)]
        return " ".join([f"w{k}" for k in range(length)] + fill[:9] + [f"w{k}" for k in range(length)] * (copies - 1)
                        + fill[9:] + ["la"] * run)
    rows = [(1, doc(2, 38)), (2, doc(2, 20)), (3, doc(0, 0, run=36)), (4, doc(4, 16))]
    got = {r.doc_id: r for r in repetition_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r.base_failed for r in got.values())
    # coverage 0.38; 0.20; 0.18 with a longest repeat of 0.175; 0.32 with a longest of 0.16 or more
    assert {k: r.kept for k, r in got.items()} == {1: False, 2: True, 3: False, 4: False}
    assert got[3].n_covered_words <= 0.30 * got[3].n_words


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_quality(docs, fit_quality(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_edges(spark):
    docs = edge_docs(spark)
    none = spark.createDataFrame([], EMPTY_LABELS)
    model = fit_quality(docs, none)
    rows = score_quality(docs, model).collect()
    assert len(rows) == len(texts()) and {r.score for r in rows} == {0.5}
    some = spark.createDataFrame([(i, k % 2, 0) for k, (i, _) in enumerate(texts()) if i] + [(None, 1, 1), (1, None, None)], EMPTY_LABELS)
    model = fit_quality(docs, some, min_rows=1)
    rows = score_quality(docs, model).collect()
    assert len(rows) == len(texts()) and all(0 <= r.score <= 1 for r in rows)
    kept = keep_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.3 for r in rows)
    assert score_quality(empty_docs(spark), model).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    m = AdditiveModel().fit(x[:3000], y[:3000])
    assert np.mean((m.score(x[3000:]) > 0.5) == y[3000:]) > 0.95
    assert (2 in m.pairs[0][:2]) and (5 in m.pairs[0][:2])


@pytest.fixture(scope="module")
def decoder():
    counts = np.zeros((tox.SIZE,) * 3, np.int64)
    for w in ["idiot", "moron", "stupid", "worthless", "the", "loser", "seat", "soon", "better"] * 50:
        c = [0, 0, *(int(tox.CLASS[ord(ch)]) for ch in w), 0]
        for a, b, d in zip(c, c[1:], c[2:]):
            counts[a, b, d] += 1
    return tox.Decoder(tox.language_model(counts))


@pytest.mark.parametrize("noisy,word", [
    ("m0r0n", "moron"), ("i d i o t", "idiot"), ("stuuuupid", "stupid"), ("w0rthl3ss", "worthless"), ("l.o.s.e.r", "loser"),
    ("the$$$", "the"), ("idiot!!", "idiot"), ("better", "better"), ("soooon", "soon"), ("st*pid***", None), ("1d1ot", "idiot")])
def test_decoder_restores(decoder, noisy, word):
    got = [w for _, ws in decoder.words(noisy) for w in ws]
    assert got == [word] if word else got


def test_viterbi_is_the_best_path(decoder):
    """Against all paths of the lattice, for short tokens."""
    import itertools
    for token in ("m0r", "1d1", "t3a", "s.o"):
        options = []
        runs = list(token)
        for i, s in enumerate(runs):
            if s.isalpha():
                options.append([(0.0, s)])
                continue
            spelt = 0 < i < len(runs) - 1 and s not in tox.LEET
            arcs = [(tox.AS_LETTER, x) for x in tox.LEET.get(s, "")]
            arcs.append((tox.SPACE_DROP if spelt else tox.LEET_DROP if s in tox.LEET else tox.DROP, ""))
            arcs.append((tox.LEET_DROP if s in tox.LEET else tox.BREAK, " "))
            options.append(arcs)
        best = None
        for path in itertools.product(*options):
            a = b = 0
            score = -sum(c for c, _ in path)
            for ch in "".join(o for _, o in path):
                c = 0 if ch == " " else int(tox.CLASS[ord(ch)])
                if not (c == 0 and b == 0):
                    score += float(decoder.logp[a, b, c])
                a, b = (0, 0) if c == 0 else (b, c)
            score += float(decoder.logp[a, b, 0]) if b else 0.0
            if best is None or score > best[0] + 1e-9:
                best = (score, "".join(o for _, o in path).split())
        assert decoder.viterbi(token) == best[1]


def test_toxicity_held_out_and_edges(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    model = tox.fit_toxicity(docs, labels)
    rows = tox.score_toxicity(docs, model).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows if r.held_out]) > 0.93
    edge = tox.score_toxicity(edge_docs(spark), model).collect()
    assert len(edge) == len(texts()) and all(0 <= r.score <= 1 for r in edge)
    none = tox.fit_toxicity(empty_docs(spark), spark.createDataFrame([], EMPTY_LABELS))
    assert tox.score_toxicity(empty_docs(spark), none).count() == 0
    assert {r.score for r in tox.score_toxicity(edge_docs(spark), none).collect()} == {0.5}
