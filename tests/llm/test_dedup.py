"""SimHash components and substring removal against brute force."""

import hashlib
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from choicelens.llm import op03_simhash as sim
from choicelens.llm.op10_substrings import contexts, previous_factors, remove_repeats
from edge import edge_docs, empty_docs, prose, texts


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    grams = [b" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum((x >> b) & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    comp, fps = list(range(len(fps))), np.array(fps, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= radius) for f in fps]
    while True:
        new = [min(comp[j] for j in near[i]) for i in range(len(fps))]
        if new == comp:
            break
        comp = new
    least = {}
    for c, i in zip(comp, ids):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [least.get(c) for c in comp]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_components_of_edge_documents(spark):
    rows = [(i, t) for i, t in texts()]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(map(str, zip([i for i, _ in rows], map(signed, fps), brute_components([i for i, _ in rows], fps))))
    got = [(r.doc_id, r.fp, r.component_id) for r in sim.near_duplicates(edge_docs(spark)).collect()]
    assert sorted(map(str, got)) == want
    assert sim.near_duplicates(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("segments,limit", [(2, 20_000), (1, 20_000), (2, 3), (1, 3)])
def test_links_of_planted_fingerprints(spark, segments, limit):
    """Chains, crowds and lone fingerprints; hot buckets take the full-width path."""
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2**63, 60)]
    chain = int(rng.integers(0, 2**63))
    for _ in range(12):
        for b in rng.choice(64, 4, replace=False):
            chain ^= 1 << int(b)
        fps.append(chain)
    crowd = int(rng.integers(0, 2**63))
    fps += [crowd ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (40, 2))]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links, crowded = sim.bucket_links(df, segments, 4, limit)
    edges = links.unionByName(sim.ball_links(crowded, 4))
    roots = {r.node: r.root for r in sim.connected(edges).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(roots.get(signed(f), signed(f)), set()).add(f)
    comp = brute_components(list(range(len(fps))), fps)
    want = {}
    for f, c in zip(fps, comp):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_forest_is_linear_in_a_crowd():
    fp = np.arange(16, dtype=np.uint64)  # all within 4 bits
    a, b = sim.forest(np.tile(fp, 1), 4, block=5)
    assert len(a) == 15


def test_keep_first(spark):
    docs = edge_docs(spark)
    kept = sim.keep_first(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    want = {(c if c is not None else "none") for c in brute_components([i for i, _ in texts()], [brute_fingerprint(t) for _, t in texts()])}
    assert len(got) == len(want) and {g for g in got if g is not None} == {w for w in want if w != "none"}


def brute_removed(rows, window=50):
    """(id, text) -> (n_bytes, removed, spans, sha) by the definition."""
    key = {None: -1}
    seen = {}
    for i, t in rows:
        b, d = (t or "").encode(), key.get(i, i)
        for k in range(len(b) - window + 1):
            s = b[k:k + window]
            seen[s] = min(d, seen.get(s, d))
    out = []
    for i, t in rows:
        b, d = (t or "").encode(), key.get(i, i)
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if seen[b[k:k + window]] < d:
                gone[k:k + window] = True
        turns = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), turns, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def digest(df):
    return [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept_bytes), len(r.removed_spans),
             hashlib.sha256(bytes(r.kept_bytes)).hexdigest()) for r in df.collect()]


@pytest.mark.parametrize("hot,part", [(50_000, 16 << 20), (1, 20_000)])
def test_removal_of_edge_documents(spark, hot, part):
    got = digest(remove_repeats(edge_docs(spark), hot=hot, bytes_per_part=part))
    assert sorted(map(str, got)) == sorted(map(str, brute_removed(texts())))


@pytest.mark.parametrize("hot", [50_000, 1])
def test_removal_of_shared_passages(spark, hot):
    """Passages in different surroundings, overlapping matches from different documents, periodic texts."""
    p = [prose(100 + k, 14) for k in range(6)]
    rows = []
    for k in range(40):
        cut = k % 7
        rows.append((k, f"{prose(k, 9)} {p[k % 6][cut:]}{p[(k + 1) % 6][:60 + cut]} {prose(200 + k // 3, 12)}"))
    rows += [(50, "ab" * 100), (51, "b" + "ab" * 90), (52, p[0][:49]), (53, p[0][:50]), (54, p[0][:30] + p[1][:30]),
             (55, "ü" * 40 + p[2]), (56, p[2] + "ü" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(digest(remove_repeats(df, hot=hot, bytes_per_part=3000))) == sorted(brute_removed(rows))


def test_removal_as_text_and_empty(spark):
    docs = edge_docs(spark)
    out = remove_repeats(docs, as_text=True)
    assert set(out.columns) == set(docs.columns) - {"text"} | {"kept_text"}
    assert out.count() == len(texts())
    assert remove_repeats(empty_docs(spark)).count() == 0


def test_every_window_lies_in_one_context():
    buf = np.frombuffer((prose(1, 300) + "aaaa" * 50).encode(), np.uint8)
    off = np.array([0, 700, 700, 740, len(buf)])
    _, _, doc, lo, more = contexts(buf, off, 50)
    windows = sorted((int(d), int(a + k)) for d, a, m in zip(doc, lo, more) for k in range(m + 1))
    assert windows == [(d, k) for d in range(4) for k in range(int(off[d + 1] - off[d]) - 49)]


def test_previous_factors():
    buf = np.frombuffer(b"abcdefghijabcdefghijabcdefghix", np.uint8)
    at, doc = np.array([0, 10, 20, 1, 11]), np.array([3, 1, 0, 5, 5])
    assert previous_factors(buf, at, doc, 10).tolist() == [True, False, False, False, False]


def test_rows_of_one_id_keep_their_own_text(spark):
    """Many short texts without an id, or of one: 32 bits would confuse some of 200,000."""
    rng = np.random.default_rng(4)
    letters = rng.integers(97, 123, (200_000, 14)).astype(np.uint8)
    texts = [bytes(x).decode() for x in letters]
    df = spark.createDataFrame(pd.DataFrame({"doc_id": [None] * 100_000 + [7.0] * 100_000, "text": texts}))
    df = df.select(F.when(~F.isnan("doc_id"), F.col("doc_id").cast("long")).alias("doc_id"), "text").repartition(4)
    got = remove_repeats(df, as_text=True)
    assert got.select(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "kept_text") % 1_000_003)).first() == \
        df.select(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "text") % 1_000_003)).first()
