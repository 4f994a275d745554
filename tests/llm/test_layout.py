"""Token files, shards, mixing, packing and top-k search."""

import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from choicelens.llm import op05_token_files as tf
from choicelens.llm import op06_shards as sh
from choicelens.llm import op07_mixing as mx
from choicelens.llm import op08_packing as pk
from choicelens.llm.op09_topk import topk_inner_product
from choicelens.llm.queries import tokenizer_file
from edge import edge_docs, empty_docs, texts


def library(name, plain=False):
    """The library as it comes; ``plain``: special tokens' strings are ordinary text."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_file(name))
    t.encode_special_tokens = plain
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


TRICKY = ["a\n\n b  c  d\t\te \n", "  x", "don't 'LL x\x1cy", "\n\n\n", "É é ÍSTΣ <|endoftext|> a", "", "   ",
          "a  b  c", "日本語\r\n\r\nx", "​ x ­", "#$%&*** x*** ||"]


FILES = [("byte_bpe_50k.json", False, False), ("byte_bpe_50k.json", False, True), ("word_bpe_49k.json", True, False)]


@pytest.mark.parametrize("name,drops,plain", FILES)
def test_random_strings_encode_as_by_the_library(name, drops, plain):
    from choicelens.llm.tokens import ChunkEncoder
    r = random.Random(3)
    signs = [*"aAbéÉßİıſKΣσçŒ0192²½ \n\t-%')(.,'!_*#<|>\r\x0b\xa0\u2028\u200b\u0301\u0307漢字한글🙂ﬁ", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "  "]
    some = ["".join(r.choice(signs) for _ in range(r.randrange(1, 14))) for _ in range(20_000)]
    want, enc = library(name, plain), ChunkEncoder(tokenizer_file(name), drops, plain)
    ids, n = enc.encode(some)
    at = np.concatenate([[0], np.cumsum(n)])
    bad = [t for k, t in enumerate(some) if ids[at[k]:at[k + 1]].tolist() != want(t)]
    assert bad == []


@pytest.mark.parametrize("name,drops,plain", FILES)
def test_chunks_encode_as_whole_texts(name, drops, plain):
    from choicelens.llm.tokens import ChunkEncoder
    want = library(name, plain)
    enc = ChunkEncoder(tokenizer_file(name), drops, plain, keep=50)
    for group in (TRICKY, [t for _, t in texts()], TRICKY):
        ids, n = enc.encode(group)
        at = np.concatenate([[0], np.cumsum(n)])
        for k, t in enumerate(group):
            assert ids[at[k]:at[k + 1]].tolist() == want(t), t[:40]


def test_number_coding_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1001):
        v = rng.integers(0, 2 ** rng.choice([6, 8, 12, 16, 20, 24, 31, 32], max(n, 1))[:n]).astype(np.uint32) if n else np.zeros(0, np.uint32)
        control, data = tf.encode_numbers(v)
        assert len(control) == -(-n // 4)
        assert (tf.decode_numbers(control, data, n) == v).all()


def test_token_files_round_trip(spark):
    want = library("word_bpe_49k.json")
    docs = edge_docs(spark)
    for wide in (False, True):
        back = tf.token_files(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, block_tokens=500, wide=wide).collect()
        back.sort(key=lambda r: r.start)
        rows = [(r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in back]
        expect = [(i, want(t) + [1]) for i, t in texts()]
        assert sorted(map(str, rows)) == sorted(map(str, expect))
        assert [-1 if i is None else i for i, _ in rows] == sorted(-1 if i is None else i for i, _ in expect)
        assert [r.start for r in back] == np.concatenate([[0], np.cumsum([len(x) for _, x in rows])])[:-1].tolist()
    assert tf.token_files(empty_docs(spark), tokenizer_file("word_bpe_49k.json")).count() == 0


def test_hypergeometric_is_exact():
    good, total, drawn = 7, 20, 6
    p = [math.comb(good, k) * math.comb(total - good, drawn - k) / math.comb(total, drawn) for k in range(drawn + 1)]
    edges = np.cumsum(p)
    for k in range(drawn + 1):
        assert sh.hypergeometric(good, total, drawn, edges[k] - 1e-9) == k
    assert sh.hypergeometric(10**12, 3 * 10**12, 10**9, 0.5) == pytest.approx(10**9 / 3, rel=1e-4)


def test_matrix_sums_and_spread():
    m = np.array(sh.communication_matrix([5, 0, 40, 3, 52], [25, 25, 25, 25], 3))
    assert m.sum(1).tolist() == [5, 0, 40, 3, 52] and m.sum(0).tolist() == [25] * 4
    draws = [sh.communication_matrix([40, 60], [50, 50], s)[0][0] for s in range(400)]
    assert abs(np.mean(draws) - 20) < 0.6 and abs(np.var(draws) - 40 * .25 * 60 / 99) < 1.5


def test_shards_are_exact_and_gapless(spark):
    docs = edge_docs(spark)
    for per in (20_000, 3):
        out = sh.shuffle_into_shards(docs, 4, ["doc_id", "text"], rows_per_part=per)
        assert set(out.columns) == set(docs.columns) | {"slot"}
        rows = out.collect()
        assert sorted(str((r.doc_id, r["a.b"])) for r in rows) == sorted(str((r.doc_id, r["a.b"])) for r in docs.collect())
        slots = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
        assert sorted(map(len, slots.values())) == [4, 4, 5, 5]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sh.shuffle_into_shards(empty_docs(spark), 4, ["doc_id"]).count() == 0


def test_shards_are_uniform(spark):
    """Every place is as likely for a row as any other."""
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    rows = sh.shuffle_into_shards(df, 8, ["doc_id"], rows_per_part=100).collect()
    first = Counter(r.shard for r in rows if r.doc_id < 1000)
    assert all(abs(n - 125) < 50 for n in first.values())
    assert abs(np.corrcoef([r.doc_id for r in rows], [r.slot for r in rows])[0, 1]) < 0.08


def brute_counts(i, mean, seed=17):
    import hashlib
    parts = max(1, math.ceil(mean / mx.MEAN_LIMIT))
    m, out = mean / parts, []
    for part in range(parts):
        u = int(hashlib.md5(f"{seed}|{'' if i is None else i}|{part}".encode()).hexdigest()[:12], 16) / 2**48
        k, term = 0, math.exp(-m)
        cdf = term
        while cdf <= u:
            k += 1
            term *= m / k
            cdf += term
        out += [(part, c) for c in range(k)]
    return out


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_mixing_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mx, "BROADCAST_SOURCES", broadcast)
    docs = edge_docs(spark)
    weights = {"hot": 1.0, "s3": 40.0, "s6": 0.5, "absent": 2.0}
    got = mx.mix(docs, weights, epochs=3.0)
    assert set(got.columns) == set(docs.columns) | {"copy", "shuffle_key"}
    rows = docs.collect()
    size = Counter()
    for r in rows:
        size[r.source] += len((r.text or "").encode()) + 1
    total, given = sum(size.values()), sum(w for s, w in weights.items() if s in size)
    want = []
    for r in rows:
        mean = weights.get(r.source, 0.0) / given * total * 3.0 / size[r.source]
        want += [(r["a.b"], *x) for x in (brute_counts(r.doc_id, mean) if mean else [])]
    assert sorted((r["a.b"], r.part, r["copy"]) for r in got.collect()) == sorted(want)
    at = [(r.position, r.shuffle_key) for r in mx.positions(got, rows_per_part=5).collect()]
    assert sorted(p for p, _ in at) == list(range(len(want)))
    assert [k for _, k in sorted(at)] == sorted(k for _, k in at)


def test_mixing_reaches_its_targets(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x" * 99).alias("text"),
                                  F.when(F.col("id") < 5000, "big").otherwise("small").alias("source"))
    n = {r.source: r["count"] for r in mx.mix(df, {"big": 1.0, "small": 1.0}).groupBy("source").count().collect()}
    assert abs(n["big"] - 3000) < 200 and abs(n["small"] - 3000) < 200
    assert mx.mix(empty_docs(spark)).count() == 0
    keys = [r.shuffle_key for r in mx.in_shuffled_order(mx.mix(df)).select("shuffle_key").collect()]
    assert keys == sorted(keys)


def test_packing_of_edge_documents(spark):
    want = library("byte_bpe_50k.json")
    rows = pk.pack_documents(edge_docs(spark), tokenizer_file("byte_bpe_50k.json"), capacity=64, with_ids=True).collect()
    expect = []
    for i, t in texts():
        ids = want(t) + [2]
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        expect += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(str, expect)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == np.concatenate([[0], np.cumsum([n for _, n in s])])[:-1].tolist()
        assert sum(n for _, n in s) <= 64
    assert pk.pack_documents(empty_docs(spark), tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        size = np.unique(rng.integers(1, 12, 4))
        value = rng.random(len(size))
        got = pk.knapsack(size, value, 20)
        worth = dict(zip(size.tolist(), value))
        best = [0.0] * 21
        for c in range(1, 21):
            best[c] = max([best[c - 1], *(worth[s] + best[c - s] for s in worth if s <= c)])
        assert sum(s * a for s, a in got.items()) <= 20
        assert sum(worth[s] * a for s, a in got.items()) == pytest.approx(best[20])


def test_plan_is_complete_and_near_the_bound():
    rng = np.random.default_rng(4)
    hist = Counter(rng.integers(1, 1025, 30_000).tolist())
    plan = pk.plan(hist, 1024)
    held = Counter()
    for config, m in plan:
        assert sum(s * a for s, a in config.items()) <= 1024
        for s, a in config.items():
            held[s] += a * m
    assert held == hist
    bound = sum(s * n for s, n in hist.items()) / 1024
    assert sum(m for _, m in plan) <= 1.01 * bound + 1
    assert pk.plan({}, 1024) == []


def test_plan_of_a_dominant_length_does_not_grow_with_the_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    base = Counter([60] * 300 + rng.integers(1, 65, 600).tolist() + [40] * 900)
    fit, rest = pk.best_fit, []
    monkeypatch.setattr(pk, "best_fit", lambda c, capacity: rest.append(sum(c.values())) or fit(c, capacity))
    for times in (1, 1000):
        hist = Counter({s: n * times for s, n in base.items()})
        plan = pk.plan(hist, 64)
        held = Counter()
        for config, m in plan:
            assert sum(s * a for s, a in config.items()) <= 64
            for s, a in config.items():
                held[s] += a * m
        assert held == hist
    assert rest[1] < 1000 and len(plan) < 1000


def test_best_fit_by_counts_equals_piece_by_piece():
    rng = np.random.default_rng(6)
    for _ in range(60):
        counts = Counter(rng.choice(rng.integers(1, 65, 12), 200).tolist())
        open_ = []
        for s in sorted(counts.elements(), reverse=True):
            at = min((k for k, r in enumerate(open_) if r >= s), key=lambda k: open_[k], default=None)
            if at is None:
                open_.append(64 - s)
            else:
                open_[at] -= s
        got = pk.best_fit(counts, 64)
        assert sorted(64 - sum(x) for x in got.elements()) == sorted(open_)
        assert Counter(s for x in got.elements() for s in x) == counts
    assert pk.best_fit({700: 10**9, 40: 10**9}, 1024).total() >= 10**9


def brute_top(rows, k=5):
    ok = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
          if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, q in ok:
        if i % 50 or (i, q) in seen:
            continue
        seen.add((i, q))
        rest = list(ok)
        rest.remove((i, q))
        scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in rest if len(c) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("cb,qb", [(8192, 4096), (40, 3)])
def test_topk_against_brute_force(spark, cb, qb):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 24)).astype(np.float32)
    v[100:160] = v[100]  # ties
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)]
    rows += [(1000, None), (1050, [None] * 24), (1100, [float("nan")] * 24), (1150, [float("inf")] * 24), (1200, [0.5, 0.25]),
             (1201, [1.0, 1.0]), (1250, []), (150, rows[150][1]), (7, rows[7][1]), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = topk_inner_product(df.withColumn("score", F.lit("x")), F.col("id") % 50 == 0, candidate_block=cb, query_block=qb)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows)
    assert topk_inner_product(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_topk_of_large_components(spark):
    """Finite components of any size take part; scores beyond a long rank by their true value."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 6)) * 10.0 ** rng.integers(-2, 12, (120, 1))
    v[::7] = rng.normal(size=(18, 6)) * 1e30
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)]
    rows += [(200, [1e306] * 6), (250, [-1e306, 1.0, 0.0, -0.0, 2.0**19, 5e-324]), (300, [2.0**19] * 6), (301, [2.0**19] * 6),
             (300, [2.0**19] * 6), (350, [1e25, 0.0, 0.0, 0.0, 0.0, 0.0]), (351, [1e300, 0.0, 0.0, 0.0, 0.0, 0.0])]
    whole = {}
    for k, (i, x) in enumerate(rows):
        whole[k] = i, [math.floor(Fraction(c) * 256) for c in x]
    want, seen = [], set()
    for k, (i, q) in whole.items():
        if i % 50 or (i, tuple(q)) in seen:
            continue
        seen.add((i, tuple(q)))
        score = [(-sum(a * b for a, b in zip(q, y)), j) for m, (j, y) in whole.items() if m != k]
        want += [(i, r, j, max(min(-s, 2**63 - 1), -2**63)) for r, (s, j) in enumerate(sorted(score)[:5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk_inner_product(df, F.col("id") % 50 == 0, candidate_block=50, query_block=3)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_ids_beyond_16_bits_are_an_error(spark):
    docs = spark.createDataFrame([(1, "a word")], "doc_id long, text string")
    path = tokenizer_file("word_bpe_49k.json")
    assert tf.token_ids(docs, path, 70_000, True, wide=True).where("doc_id = 1").count() == 1
    with pytest.raises(Exception, match="16 bits"):
        tf.token_ids(docs, path, 70_000, True).collect()
