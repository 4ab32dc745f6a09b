from collections import defaultdict

import numpy as np
from helpers import AWKWARD, SPACES, docs, lowered, sentences
from pyspark.sql import functions as F

from reelsift.llm.bloom import Bloom
from reelsift.llm.line_dedup import line_dedup


def brute(rows, least=10):
    key = lambda line: lowered(line.strip(SPACES))
    last = float("inf")
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(last if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = last if i is None else i
        stay = [x for x in lines if len(held[key(x)]) < 2 or min(held[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def run(df):
    got = line_dedup(df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    return sorted(map(tuple, got), key=repr)


def test_against_brute_force(spark):
    lines = sentences(60, size=12)
    texts = ["\n".join(lines[(k * 7 + j * j) % 60].upper() if j % 3 else "  " + lines[k % 60] + "\r" for j in range(k % 9)) for k in range(200)]
    texts += AWKWARD * 2
    ids = [*range(len(texts) - 3), None, None, 5]  # an id twice, and rows without id
    rows = list(zip(ids, texts, strict=True))
    assert run(docs(spark, texts, ids)) == brute(rows)


def test_hot_line_and_repeats_within_a_document(spark):
    hot = "this very line is everywhere"
    texts = [f"{hot}\n{hot}\nown line number {k}" for k in range(3000)]
    got = run(docs(spark, texts))
    assert sum(r[2] for r in got) == 2 * 2999
    assert got == brute(list(enumerate(texts)))


def test_empty_table_and_clashing_names(spark):
    empty = docs(spark, [])
    assert line_dedup(empty).count() == 0
    clash = docs(spark, ["a line of some length", "a line of some length"]).withColumns(
        {"h": F.lit(1), "key": F.lit("k"), "_id": F.lit(9), "digest": F.lit("d"), "n_lines": F.lit("mine"), "odd.name": F.lit(2)}
    )
    got = {r["doc_id"]: r for r in line_dedup(clash).collect()}
    assert got[1]["kept_text"] == "" and got[0]["n_lines"] == 1 and got[0]["odd.name"] == 2 and got[0]["_id"] == 9


def test_bloom_has_no_false_negatives():
    draw = np.random.default_rng(0)
    inside, outside = draw.integers(0, 1 << 63, (2, 50_000), dtype=np.uint64)
    bloom = Bloom(50_000)
    bloom.add(inside)
    assert bloom.has(inside).all() and bloom.has(outside).mean() < 0.01
