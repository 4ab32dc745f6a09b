import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, DOCS, docs, sentences, table
from pyspark.sql import functions as F

from reelsift.llm import lexical
from reelsift.llm.lexical import Asked, Shard, search

ITEMS = "item_id long, text string"


def terms(text):
    upper = {chr(c): chr(c + 32) for c in range(65, 91)}
    return ["".join(upper.get(c, c) for c in t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(rows, items, k=50):
    """Every item against every document, one after the other."""
    counts = [(i, Counter(terms(t))) for i, t in rows]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    N, L = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counts:
            m = 100 - 50 + 50 * n * N // L
            score = sum(
                math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) & set(c)
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def run(spark, df, items, **options):
    return sorted(map(tuple, search(df, spark.createDataFrame(items, ITEMS), **options).collect()), key=repr)


def some(n, seed=3):
    texts = sentences(n, seed=seed, size=30)
    return texts + texts[: n // 4] + [t.upper() + "!-\x00x" for t in texts[: n // 5]] + AWKWARD


def asked(texts, n, seed=4):
    draw = random.Random(seed)
    return [(k, " ".join(draw.choice(texts).split()[: draw.randint(1, 9)] + ["nowhere"])) for k in range(n)]


@pytest.mark.parametrize("k", [1, 7, 50])
def test_against_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 60)  # several shards and rounds a task
    texts = some(300)
    items = asked(texts[:300], 25) + [(90, None), (91, ""), (92, "?!"), (3, texts[5]), (None, texts[5])]
    got = run(spark, docs(spark, texts), items, k=k)
    assert got == brute(list(enumerate(texts)), items, k)


def test_blocks_give_the_same(spark, monkeypatch):
    texts = some(150)
    items = asked(texts[:150], 20)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 6)
    assert run(spark, docs(spark, texts), items) == brute(list(enumerate(texts)), items)


def test_ties_repeated_and_missing_ids(spark):
    rows = [(9, "same text"), (2, "same text"), (2, "same text"), (None, "same text"), (1, "other words"), (0, None)]
    df = table(spark, [(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = run(spark, df, [(1, "same"), (2, "same same words")])
    assert got == brute(rows, [(1, "same"), (2, "same same words")])
    assert [r[2] for r in got if r[0] == 1] == [2, 2, 9, None] and [r[1] for r in got if r[0] == 1] == [1, 2, 3, 4]


def test_empty_tables_and_clashing_names(spark):
    some_docs, item = docs(spark, ["a b", "b c"]), [(1, "b")]
    assert run(spark, docs(spark, []), item) == [] and run(spark, docs(spark, [None, ""]), item) == []
    assert run(spark, some_docs, []) == [] and run(spark, some_docs, [(1, None)]) == []
    clash = some_docs.withColumns({"id": F.lit(5), "terms": F.lit("x"), "item": F.lit(1), "score": F.lit(0), "n": F.lit(1)})
    items = spark.createDataFrame(item, ITEMS).withColumns({"item": F.lit(7), "place": F.lit(1), "id": F.lit(2)})
    assert {r["doc_id"] for r in search(clash, items).collect()} == {0, 1}


def test_reading_stops_before_the_end():
    """A document far ahead of all others is found without reading the lists to their ends."""
    draw = np.random.default_rng(1)
    query = Asked(["a b c"])
    doc, term = (x.ravel() for x in np.meshgrid(np.arange(1000), np.arange(3)))
    impact = draw.integers(1, 300_000, 3000)
    impact[doc == 17] = 900_000
    shard = Shard(query, np.array([5, 6, 7]), doc, term, impact, 1000)
    ((item, found, scores),) = shard.best(1, np.zeros(1, np.int64))
    assert (item, found.tolist(), scores.tolist()) == (0, [17], [18 * 900_000])
    assert (shard.end - shard.next).sum() > 1500
    nothing = Shard(query, np.array([5, 6, 7]), doc, term, impact, 1000).best(1, np.full(1, 1 << 40))
    assert [f[1].tolist() for f in nothing] == [[]]
