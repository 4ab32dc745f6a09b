import hashlib
import random

from helpers import AWKWARD, docs, lowered, sentences, words_of
from pyspark.sql import functions as F

from reelsift.llm.minhash import edited_likeness, fingerprint, fingerprints, likeness


def grams(text):
    w = words_of(lowered(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def edited(rows):
    """By id, null first, then text: each text with its last half from the next one."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out.append((i, t, t[: len(t) - half] + after[:half], after))
    return out


def test_estimates_likeness(spark):
    draw, pairs = random.Random(2), []
    for share in (0.0, 0.1, 0.3, 0.5, 0.8, 0.95):
        for _ in range(20):
            w = [str(draw.random()) for _ in range(600)]
            k = int(600 * share)
            pairs.append((" ".join(w), " ".join(w[:k] + [str(draw.random()) for _ in range(600 - k)])))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("x")).collect()
    errors = [r["x"] - jaccard(r["a"], r["b"]) for r in got]
    assert max(map(abs, errors)) < 0.15 and abs(sum(errors) / len(errors)) < 0.02


def test_sparse_texts_are_densified(spark):
    draw, pairs = random.Random(4), []
    for _ in range(200):
        w = [str(draw.random()) for _ in range(24)]
        pairs.append((" ".join(w), " ".join(w[:16] + [str(draw.random()) for _ in range(8)])))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("x")).collect()
    errors = [r["x"] - jaccard(r["a"], r["b"]) for r in got]
    assert abs(sum(errors) / len(errors)) < 0.04


def test_edited_texts_against_brute_force(spark):
    texts = [*sentences(300, size=50), *AWKWARD, *AWKWARD[:4]]
    draw = random.Random(6)
    ids = draw.sample(range(-10_000, 10**12), len(texts) - 4) + [None, None, 7, 7]
    got = edited_likeness(docs(spark, texts, ids)).collect()
    want = edited(list(zip(ids, texts, strict=True)))
    digest = lambda i, n, e: (i, n, hashlib.sha256(e.encode()).hexdigest())
    assert sorted((digest(r["doc_id"], r["n_chars"], r["edited_text"]) for r in got), key=repr) == sorted(
        (digest(i, len(t), e) for i, t, e, _ in want), key=repr
    )
    known = {(i, e): (t, after) for i, t, e, after in want}
    for r in got:
        t, after = known[r["doc_id"], r["edited_text"]]
        if len(grams(t)) > 20:
            assert abs(r["near_edited"] - jaccard(t, r["edited_text"])) < 0.3
        if t == after:
            assert r["near_next"] == 1.0
    by_text = {}
    for r, t in zip(got, (known[r["doc_id"], r["edited_text"]][0] for r in got), strict=True):
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"] and len(r["fingerprint"]) == 256


def test_many_ranges(spark, monkeypatch):
    from reelsift.llm import minhash

    monkeypatch.setattr(minhash, "RANGE_ROWS", 3)
    test_edited_texts_against_brute_force(spark)


def test_edges(spark):
    assert edited_likeness(docs(spark, [])).count() == 0
    (only,) = edited_likeness(docs(spark, ["abcd"])).collect()
    assert only["edited_text"] == "abab" and only["near_next"] == 1.0
    clash = docs(spark, [None, "", "a"]).withColumns({"fingerprint": F.lit(1), "_text": F.lit(2), "guest": F.lit(3)})
    rows = fingerprints(clash).collect()
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] != rows[2]["fingerprint"] and rows[2]["_text"] == 2
    assert edited_likeness(clash).count() == 3
