import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, docs, lowered, sentences, words_of
from pyspark.sql import functions as F

from reelsift.llm import ctw
from reelsift.llm.common import cuts


def train():
    return F.col("doc_id") % 5 != 1


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)


def brute(rows, depth):
    """log10 probabilities by the recursion itself, one context tree for each prefix of a byte."""
    line = lambda t: [255] * depth + list(lowered(t).encode()) + [255]
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def decisions(byte):
        node = 1
        for s in range(7, -1, -1):
            yield node, byte >> s & 1
            node = node * 2 + (byte >> s & 1)

    for i, t in rows:
        if i % 5 == 1:
            continue
        x = line(t)
        for k in range(depth, len(x)):
            for node, bit in decisions(x[k]):
                for d in range(depth + 1):
                    key = (tuple(x[k - d : k]), node)
                    counts[key][bit] += 1
                    if d:
                        children[tuple(x[k - d + 1 : k]), node].add(key)
    seen = {}

    def log_w(key):
        if key not in counts:
            return 0.0
        if key not in seen:
            e = log_kt(*counts[key])
            c = sum(map(log_w, children[key])) if len(key[0]) < depth else e
            seen[key] = (e, c, math.log(0.5) + max(e, c) + math.log(math.exp(e - max(e, c)) + math.exp(c - max(e, c))))
        return seen[key][2]

    def chance(context, node, bit, d=0):
        key = (tuple(context[len(context) - d :]), node)
        n = counts.get(key, [0, 0])
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth:
            return own
        log_w(key)
        e, c, _ = seen.get(key, (0.0, 0.0, 0.0))
        share = 1 / (1 + math.exp(min(c - e, 700)))
        return share * own + (1 - share) * chance(context, node, bit, d + 1)

    out = []
    for i, t in rows:
        x = line(t)
        total = sum(
            math.log(chance(x[k - depth : k], node, bit)) for k in range(depth, len(x)) for node, bit in decisions(x[k])
        )
        out.append((i, total / math.log(10)))
    return dict(out)


def base(rows):
    c = Counter()
    for i, t in rows:
        if i % 5 != 1:
            c.update([*words_of(lowered(t)), None])
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in rows:
        tokens = [*words_of(lowered(t)), None]
        score = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out[i] = (len(tokens), sum(c[w] > 0 for w in tokens), n, score)
    return out


@pytest.mark.parametrize(("depth", "frequent", "grams"), [(2, 1 << 16, 1 << 20), (4, 10, 0)])
def test_against_brute_force(spark, depth, frequent, grams):
    texts = [*sentences(40, size=25), None, "", " \n ", "ÉÜ İ", sentences(1, seed=9)[0].upper(), "zebra " * 50]
    rows = list(enumerate(texts))
    got = ctw.score(docs(spark, texts), train(), depth, frequent=frequent, broadcast_grams=grams).collect()
    want, words = brute(rows, depth), base(rows)
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        assert r["trained"] == (i % 5 != 1)
        assert r["score"] == pytest.approx(want[i], rel=1e-7)
        n, known, total, score = words[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)


def test_slices_hold_about_so_many_bytes():
    texts = pa.array(["a" * 30, None, "", "b" * 500, "c", "d" * 90, "e" * 20, None] * 3)
    got = cuts(texts, 100)
    assert [i for start, stop in got for i in range(start, stop)] == list(range(len(texts)))
    sizes = [sum(len(t or "") for t in texts[start:stop].to_pylist()) for start, stop in got]
    assert all(size <= 200 or 500 <= size < 600 for size in sizes) and sum(sizes) == 3 * 641
    assert cuts(texts[:0], 100) == [] and cuts(texts[1:3], 100) == [(0, 2)]


def test_kt_estimates():
    for a in (0, 1, 2, 9, 1000, 10**7):
        for b in (0, 1, 5, 10**6):
            got = ctw.log_kt(np.array([float(a)]), np.array([float(b)]))[0]
            assert got == pytest.approx(log_kt(a, b), rel=1e-9, abs=1e-9)


def test_scores_are_a_distribution(spark):
    """The chances of all last bytes after one context add up to one."""
    grams = spark.createDataFrame([((0x6162 << 8) + b, 3 if b in (99, 100) else 0) for b in range(256)], "gram long, n long")
    total = ctw.model(grams, 2).agg(F.sum(F.exp("log_p"))).first()[0]
    assert total == pytest.approx(1.0, abs=1e-9)


def test_beats_words_on_held_out_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = ctw.score(df, F.crc32(F.col("doc_id").cast("string")) % 5 != 1).filter(~F.col("trained"))
    ratio = held.agg(F.sum("score") / F.sum("base_score")).first()[0]
    assert ratio < 1


def test_edges(spark):
    assert ctw.score(docs(spark, []), train()).count() == 0
    nobody = ctw.score(docs(spark, ["ab", None]), F.lit(False), 2).collect()
    assert sorted(round(r["score"], 6) for r in nobody) == [round(-24 * math.log10(2), 6), round(-8 * math.log10(2), 6)]
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in nobody)
    odd = docs(spark, AWKWARD * 2).withColumns({"score": F.lit(1), "_train": F.lit(2), "gram": F.lit(3), "n": F.lit(4)})
    rows = ctw.score(odd, train(), 2).collect()
    assert len(rows) == 2 * len(AWKWARD)
    again = ctw.score(docs(spark, ["x", "x"], [None, None]), F.lit(True), 2).collect()
    assert len(again) == 2 and again[0]["score"] == again[1]["score"]
