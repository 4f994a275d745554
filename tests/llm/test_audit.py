"""Divergence audit, tokenizer alignment and line deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from choicelens.llm.op11_divergence import source_divergence
from choicelens.llm.op12_alignment import MEASURES, Aligner, align_tokenizers
from choicelens.llm.op13_lines import drop_repeated_lines, line_keys, lines, twice_seen
from choicelens.llm.queries import table, tokenizer_file
from choicelens.llm.textcols import span_hashes, utf8
from conftest import SF001
from edge import SCHEMA, edge_docs, empty_docs, prose, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) with the awkward extra columns."""
    return spark.createDataFrame([(*r, None, "s", "p", "in", 1) for r in rows], SCHEMA).repartition(3)


# --- op11


def plain_divergence(rows, min_docs, top):
    docs = [((t or "").translate(LOWER), la or "", s or "") for _, t, la, s in rows]
    found = [(la, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)) for t, la, s in docs]
    seen = Counter((la, w) for la, _, ws in found for w in set(ws))
    kept = defaultdict(list)
    for (la, w), n in seen.items():
        if n >= min_docs:
            kept[la].append(w)
    count, groups, out = defaultdict(Counter), sorted({(la, s) for la, s, _ in found}), set()
    for la, s, ws in found:
        count[la, s].update(ws)
        count[la].update(ws)

    def rates(key, la):
        n = sum(count[key][w] for w in kept[la])
        return {w: 1 + 10**9 * (count[key][w] + 2) // (n + 2 * len(kept[la])) for w in kept[la]}

    def f(p, q):
        return (p - q) ** 2 // (p + q)
    p = {g: rates(g, g[0]) for g in groups}
    for la, s in groups:
        pairs = [(sum(f(p[la, s][w], p[la, o][w]) for w in kept[la]), o) for lb, o in groups if lb == la and o != s]
        for r, (v, o) in enumerate(sorted(pairs, key=lambda x: (-x[0], x[1].encode())), 1):
            out.add((la, s, "pair", o, v, r))
        q = rates(la, la)
        best = [(f(p[la, s][w], q[w]), w) for w in kept[la] if count[la, s][w] and p[la, s][w] > q[w]]
        for r, (v, w) in enumerate(sorted(best, key=lambda x: (-x[0], x[1].encode()))[:top], 1):
            out.add((la, s, "term", w, v, r))
    return out


@pytest.mark.parametrize("tile,block", [(64, 20_000), (2, 7)])
def test_divergence_equals_brute_force(spark, tile, block):
    r = random.Random(5)
    rows = [(i, prose(r.randrange(40), r.randrange(0, 60)), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "hot", "hot", None]))
            for i in range(150)]
    rows += [(1, None, "xx", "only"), (2, "", "xx", "other"), (None, "ÄÖ ß_Ab9Z\x00日本", "en", "a"), (7, "x" * 9000, "en", "b")]
    got = source_divergence(frame(spark, rows), min_docs=5, top=4, tile=tile, block_rows=block)
    assert {tuple(r) for r in got.collect()} == plain_divergence(rows, 5, 4)


def test_divergence_edges(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in edge_docs(spark).collect()]
    got = source_divergence(edge_docs(spark))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == plain_divergence(rows, 10, 10)
    assert source_divergence(empty_docs(spark)).count() == 0


# --- op12


def plain_alignment(rows):
    tool = Aligner(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    spell = [[v.data[s:s + n].tobytes() for s, n in zip(v.start, v.size)] for v in (tool.spell_a, tool.spell_b)]
    docs, count = [], Counter()
    for d, text in rows:
        ids = ([], [])
        if text:
            ids = whole.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
            if any(b"".join(map(v.__getitem__, x)) != (" " + text).encode() for v, x in zip(spell, ids)):
                ids = ([], [])
        spans = []
        for v, x in zip(spell, ids):
            at, own = 0, []
            for i in x:
                own.append((at, at + len(v[i]), i))
                at += len(v[i])
            spans.append(own)
        links, j = [], 0
        for a0, a1, a in spans[0]:
            while spans[1][j][1] <= a0:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < a1:
                links.append((a, spans[1][k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, at = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in own if at <= s and e <= c) for own in spans))
            at = c
        count.update(set(links))
        docs.append((d, len(ids[0]), len(ids[1]), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return sorted(((d, na, nb, g, len(x), sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x), h)
                   for d, na, nb, g, x, h in docs), key=str)


HARD = ["a", " ", "  two  spaces ", "tab\tand\nline\n\n", "<|endoftext|> quoted <s> </s> <0x41> <unk>", "▁ is a mark", "naïve Ünïcode ①② ﬁ",
        "日本語のテキスト🙂🙂", "ab" * 3000, "x\x00y", "​zero", "é decomposed", "İstanbul", "﻿bom", "1234567890 12,345.67 -- \"quoted\""]


@pytest.mark.parametrize("slice_pairs", [4_000_000, 300])
def test_alignment_equals_brute_force(spark, slice_pairs):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF001, "documents").limit(60).collect()]
    rows += [(d, t) for d, t in texts() if t is None or len(t) < 20_000] + [(1000 + i, t) for i, t in enumerate(HARD * 2)]
    got = align_tokenizers(frame(spark, [(*r, "en", "s") for r in rows]), tokenizer_file("byte_bpe_50k.json"),
                           tokenizer_file("piece_bpe_32k.model"), slice_pairs=slice_pairs)
    assert [c for c in got.columns if c not in MEASURES] == ["doc_id", "lang", "source", "n_chars", "shard", "part", "_in", "a.b", "groups_sha256"]
    own = sorted((tuple(r) for r in got.select("doc_id", *MEASURES, "groups_sha256").collect()), key=str)
    assert own == plain_alignment(rows)


def test_alignment_edges(spark):
    paths = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    assert align_tokenizers(empty_docs(spark), *paths).count() == 0
    got = align_tokenizers(edge_docs(spark), *paths)
    assert got.count() == len(texts())
    assert {r["n_a"] for r in got.where("doc_id IN (3, 4)").collect()} == {0}


# --- op13


def plain_lines(rows, min_chars=10):
    low = [[(x, x.strip(" \t\n\v\f\r").translate(LOWER)) for x in (t or "").split("\n")] for _, t in rows]
    ids = defaultdict(set)
    rank = [(d is not None, d) for d, _ in rows]
    for d, ls in zip(rank, low):
        for _, k in ls:
            if len(k) >= min_chars:
                ids[k].add(d)
    out = []
    for (d, _), me, ls in zip(rows, rank, low):
        kept = [x for x, k in ls if not (len(ids.get(k, ())) > 1 and me > min(ids[k]))]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    r = random.Random(9)
    pool = [prose(i, 6) for i in range(30)] + ["Short", "", "   ", "exactly10!", "nine char", "Ünïcödé10x", "ÜNÏCÖDÉ10x", " nbsp is no space "]
    rows = []
    for i in range(120):
        body = [r.choice(["", " ", "\t", "\v\f"]) + (x.upper() if r.random() < 0.2 else x) + r.choice(["", "\r", "  "])
                for x in r.choices(pool, k=r.randrange(0, 9))]
        rows.append((r.choice([i, i, i // 3, None]), "\n".join(body)))
    hot = [(i, "The one common line\nown line number %d" % i) for i in range(200, 500)]
    return rows + hot + [(-5, "The one common line\n\n"), (600, None), (601, ""), (602, "\n"), (603, "\n\n"), (604, "a" * 300_000 + "\n" + prose(3, 6))]


@pytest.mark.parametrize("bits", [16, 0])
def test_lines_equal_brute_force(spark, bits):
    rows = line_rows()
    # a filter of the least size suspects many lines without need; the result is the same
    got = drop_repeated_lines(frame(spark, [(*r, "en", "s") for r in rows]), bits_per_line=bits)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str) == plain_lines(rows)


def test_lines_keep_columns_and_edges(spark):
    got = drop_repeated_lines(edge_docs(spark))
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "shard", "part", "_in", "a.b", "n_lines", "n_dropped", "kept_text"]
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str) == plain_lines(texts())
    assert drop_repeated_lines(empty_docs(spark)).count() == 0


def test_line_helpers():
    docs = ["", "\n", "a\n\nb", "\n", "", "x\n"]
    buf, off = utf8(pa.array(docs))
    starts, ends, doc, number = lines(buf, off)
    raw = buf.tobytes()
    want = [(i, k, x.encode()) for i, t in enumerate(docs) for k, x in enumerate(t.split("\n"))]
    assert [(d, k, raw[a:b]) for a, b, d, k in zip(starts, ends, doc, number)] == want
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 4000).astype(np.uint8)
    a = r.integers(0, 3900, 3000)
    b = a + r.integers(0, 12, 3000)
    h = span_hashes(data, a, b)
    by = defaultdict(set)
    for x, y, k in zip(a, b, h):
        by[data[x:y].tobytes()].add(int(k))
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def test_filter_has_every_repeated_key(spark):
    docs = frame(spark, [(*r, "en", "s") for r in line_rows()]).repartition(7)
    log_bits, bits = twice_seen(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    seen = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
    from choicelens.llm.op13_lines import _bits
    rows = [t or "" for _, t in line_rows()]
    buf, off = utf8(pa.array(rows))
    _, _, _, doc, _, key = line_keys(buf, off, 10)
    n = Counter(k for k, _ in set(zip(key.tolist(), doc.tolist())))
    often = np.array([k for k, c in n.items() if c > 1], np.uint64)
    once = np.array([k for k, c in n.items() if c == 1], np.uint64)
    assert len(often) > 20 and seen[_bits(often, log_bits).astype(np.int64)].all()
    assert seen[_bits(once, log_bits).astype(np.int64)].all(axis=0).mean() < 0.1
