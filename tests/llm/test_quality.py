import math

import numpy as np
import pytest
import regex
from helpers import AWKWARD, docs, sentences, words_of
from pyspark.sql import functions as F

from reelsift.llm import quality
from reelsift.llm.quality import CLIP, CUT, fit, score


def brute_features(text):
    """One text's numbers, counted one by one."""
    t = text or ""
    n, words, lines = max(len(t), 1), words_of(t), t.split("\n")
    plain = ".,;:?()'\"-"
    is_letter = lambda c: regex.match(r"[\p{L}\p{N}]", c) is not None
    share = lambda test: math.sqrt(sum(map(test, t)) / n)
    count = max(len(words), 1)
    return [
        share(lambda c: regex.match(r"\p{Lu}", c) is not None),
        share(lambda c: not is_letter(c) and c not in plain and c not in " \t\n\x0b\f\r"),
        share(lambda c: regex.match(r"\p{N}", c) is not None),
        share(lambda c: c in ".,;:?"),
        math.sqrt(1 - len(set(lines)) / len(lines)),
        math.log1p(len(words)),
        len(set(words)) / count**0.9,
        math.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / count),
        math.sqrt(sum(any(not is_letter(c) and c not in plain for c in w) for w in words) / count),
        math.log1p(n / count),
    ]


def test_scores_against_brute_force(spark):
    df, labels = corpus(spark)
    model = fit(df, labels)
    texts = [r["text"] for r in df.collect()] + AWKWARD + ["same same same", "A1 b2!! (c)\nA1 b2!! (c)", "É È § 4½"]
    for r in score(docs(spark, texts), model).collect():
        z = [max(-CLIP, min(CLIP, (x - m) / s)) for x, m, s in zip(brute_features(r["text"]), model.mean, model.scale, strict=True)]
        strength = sum(a * w for a, w in zip(z, model.weight, strict=True))
        want = 1 / (1 + math.exp(model.cut - math.log(CUT / (1 - CUT)) - strength))
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == int(r["score"] >= CUT)


def test_weights_prefer_and_the_cut_is_the_quantile(spark):
    """No step improves the likelihood of the preferences, and as many are cut off as labels reject."""
    df, labels = corpus(spark)
    model, ridge = fit(df, labels, ridge=0.05), 0.05
    rows = df.join(labels, "doc_id").collect()
    x = np.array([brute_features(r["text"]) for r in rows])
    y = np.array([r["quality"] for r in rows])
    z = np.clip((x - model.mean) / model.scale, -CLIP, CLIP)
    good, bad = z[y == 1], z[y == 0]

    def likelihood(w):  # of all pairs; the model has seen some of them
        margins = (good @ w)[:, None] - (bad @ w)[None, :]
        return -np.log1p(np.exp(-margins)).mean() - ridge / 2 * (w @ w)

    w = np.array(model.weight)
    gains = [likelihood(w + step * d) - likelihood(w) for d in np.eye(len(w)) for step in (0.2, -0.2)]
    assert max(gains) < 0.002 and likelihood(w) > likelihood(0 * w) + 0.5
    predicted = [r["predicted"] for r in score(df, model).collect()]
    assert abs(predicted.count(0) - int((y == 0).sum())) <= 1


def corpus(spark, n=400):
    texts = [t.capitalize() + "." for t in sentences(n, size=80)]
    bad = [k % 5 == 0 for k in range(n)]
    texts = [" ".join(w.upper() + "!!" for w in t.split()) if b else t for t, b in zip(texts, bad, strict=True)]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(k, int(not b)) for k, b in enumerate(bad)], "doc_id long, quality int")
    return df, labels


def test_ranks_held_out_documents(spark):
    df, labels = corpus(spark)
    model = fit(df, labels.filter("doc_id % 4 <> 2"))
    got = score(df, model).join(labels, "doc_id").filter("doc_id % 4 = 2").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) > 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= CUT) for r in got)


def test_refits_alike_and_bounds_the_sample(spark):
    df, labels = corpus(spark)
    assert fit(df, labels) == fit(df.repartition(7), labels.repartition(3))
    small = fit(df, labels, max_per_class=20)
    assert small.weight and small != fit(df, labels)


def test_edges(spark):
    df, labels = corpus(spark, 100)
    model = fit(df, labels)
    odd = docs(spark, AWKWARD + AWKWARD).withColumns({"score": F.lit("mine"), "x": F.lit(1)})
    got = score(odd, model)
    rows = got.collect()
    assert len(rows) == 2 * len(AWKWARD) and all(r["score"] is not None for r in rows)
    assert dict(got.dtypes)["score"] == "double" and got.columns.count("score") == 1
    assert len({(r["text"], r["score"]) for r in rows}) == len(AWKWARD)
    assert score(docs(spark, []), model).count() == 0
    for none in (labels.limit(0), labels.filter("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        assert score(df, fit(df, none)).filter("predicted = 0").count() == 0
    twice = labels.union(labels.withColumn("quality", 1 - F.col("quality")))
    assert not fit(df, twice).weight  # an id with two labels counts as rejected


def test_all_labelled_documents_count(spark, monkeypatch):
    """Means, weights and cut are those of all rows, with more documents of a class than were once used."""
    from reelsift.llm import quality

    monkeypatch.setattr(quality, "_vector", lambda text: F.array(F.char_length(text).cast("double"), F.length(text) % 7 + F.lit(0.0)))
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.expr("repeat('a', int(id * 37 % 101) + int(id % 2) * 40)").alias("text"))
    labels = rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = fit(rows, labels)
    length = np.array([k * 37 % 101 + k % 2 * 40 for k in range(9000)], float)
    x = np.stack([length, length % 7], 1)
    assert model.mean == pytest.approx(tuple(x.mean(0)), abs=1e-9) and model.scale == pytest.approx(tuple(x.std(0)), abs=1e-9)
    strength = np.clip((x - model.mean) / model.scale, -CLIP, CLIP) @ model.weight
    ordered = np.sort(strength)
    assert ordered[4499] - 1e-9 <= model.cut <= ordered[4500] + 1e-9 and model.weight[0] > 0.5


@pytest.mark.parametrize(("small", "join"), [(100_000, "BroadcastHashJoin"), (0, "SortMergeJoin")])
def test_pairs_are_never_broadcast(spark, monkeypatch, small, join):
    plans, write = [], quality.materialise
    monkeypatch.setattr(quality, "SMALL_ROWS", small, raising=False)

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(quality, "materialise", noted)
    texts = sentences(60, seed=4)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(60)], "doc_id long, quality int")
    fit(docs(spark, texts, range(60)), labels)
    (plan,) = [x for x in plans if "zip_with" in x]
    (paired,) = [x for x in plan.splitlines() if "Join" in x]
    assert join in paired and "BuildLeft" not in paired
