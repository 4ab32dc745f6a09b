"""Quality scores learnt from preference pairs (Bradley-Terry).

A document's strength is linear in its features; the chance that one document is preferred to
another is the logistic function of the difference of their strengths. Scores are cut at the
quantile that leaves out the share of documents the training labels reject.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.llm.common import let, packed, ship, words
from reelsift.operators.skew import SMALL_ROWS, is_small, number_within
from reelsift.session import materialise

OUTPUTS = ("score", "predicted")
CUT = 0.7  # the score at the chosen quantile
CLIP = 6.0  # standard deviations
EXACT = "decimal(28,12)"  # sums of these are the same in any order
PLACE_ROWS = 4000  # documents of a class beyond which they are numbered in slices
UNIT = 2.0**30  # parts of one in which sums over pairs are counted


def features(text: Column) -> list[Column]:
    """Numbers that describe how a text is written; all are 0 for null and empty texts."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.char_length(t), F.lit(1))

    def share(pattern: str) -> Column:
        return F.sqrt(F.regexp_count(t, F.lit(pattern)) / n)

    def of_words(w: Column) -> Column:
        count = F.greatest(F.size(w), F.lit(1))
        stutters = F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1))))
        marked = F.size(F.filter(w, lambda x: x.rlike(r"[^\p{L}\p{N}.,;:?()'\"-]")))
        return F.array(
            F.log1p(F.size(w).cast("double")),
            F.size(F.array_distinct(w)) / F.pow(count.cast("double"), F.lit(0.9)),
            F.sqrt(stutters / count),
            F.sqrt(marked / count),
            F.log1p(n / count),
        )

    lines = F.split(t, "\n")
    return [
        share(r"\p{Lu}"),
        share(r"[^\p{L}\p{N}\s.,;:?()'\"-]"),
        share(r"\p{N}"),
        share(r"[.,;:?]"),
        F.sqrt(1 - F.size(F.array_distinct(lines)) / F.size(lines)),
        let(words(t), of_words),
    ]


def _vector(text: Column) -> Column:
    *plain, of_words = features(text)
    return F.concat(F.array(*plain), of_words)


@dataclass(frozen=True)
class QualityModel:
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weight: tuple[float, ...] = ()
    cut: float = 0.0

    def strength(self, vector: Column) -> Column:
        terms = ((z, w) for z, w in zip(self.standard(vector), self.weight, strict=True))
        return sum((z * w for z, w in terms), F.lit(0.0))

    def standard(self, vector: Column) -> list[Column]:
        """The features in standard deviations from their mean."""
        return [
            F.greatest(F.least((F.get(vector, F.lit(i)) - m) / s, F.lit(CLIP)), F.lit(-CLIP))
            for i, (m, s) in enumerate(zip(self.mean, self.scale, strict=True))
        ]

    def score(self, vector: Column) -> Column:
        """0 to 1; ``CUT`` at the quantile."""
        if not self.weight:
            return F.lit(1.0)
        return 1 / (1 + F.exp(F.lit(self.cut - float(np.log(CUT / (1 - CUT)))) - self.strength(vector)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_per_class: int | None = None,
    pairs_per_document: int = 8,
    ridge: float = 1e-3,
    seed: int = 7,
) -> QualityModel:
    """Learn from all documents with ``labels`` (doc_id, quality).

    Each document of the larger class is paired with ``pairs_per_document`` of the other, taken in turn from
    an order by hash, so all are in pairs. The features of labelled documents and the differences of pairs are
    written down; only sums reach the driver, once for each step of the weights. The sums are exact, so a model
    does not depend on how the rows lie. An id with two labels counts as rejected; rows without id or label are
    left out. Without both classes there is nothing to prefer, and the model accepts everything.
    ``max_per_class`` asks for fewer documents of either class, those with the least id hashes.
    """
    known = (
        labels.select(F.col("doc_id").alias("_of"), "quality")
        .dropna()
        .groupBy("_of")
        .agg(F.min("quality").alias("quality"))
    )
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return QualityModel()
    by_hash = F.xxhash64(F.lit(seed), "_of")
    if max_per_class is not None:
        first, second = (known.filter(F.col("quality") == q).orderBy(by_hash, "_of").limit(max_per_class) for q in (0, 1))
        known = first.union(second)
    texts, vector = packed(docs, (), _id="doc_id", _text="text"), _vector(F.col("_text")).alias("x")
    if is_small(known):
        rows = texts.join(F.broadcast(known), F.col("_id") == F.col("_of")).select("_of", "quality", vector)
    else:  # features are shuffled, not texts
        rows = texts.select("_id", vector).join(known, F.col("_id") == F.col("_of")).select("_of", "quality", "x")
    rows = materialise(rows)
    found = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not found.get(0) or not found.get(1):
        return QualityModel()
    model = _standard(rows)
    pairs = _pairs(rows, model, found, pairs_per_document, seed)
    model = replace(model, weight=_weights(pairs, len(model.mean), pairs_per_document * max(found.values()), ridge))
    return replace(model, cut=_quantile(rows, model, counts, found))


def _standard(rows: DataFrame) -> QualityModel:
    """Mean and standard deviation of the features ``x``."""
    size = rows.select(F.size("x")).first()[0]
    each = [F.get("x", F.lit(i)) for i in range(size)]
    sums = [F.sum(v.cast(EXACT)) for x in each for v in (x, x * x)]
    n, *total = rows.agg(F.count("*"), *sums).first()
    mean, square = ([float(t / n) for t in total[k::2]] for k in (0, 1))
    spread = [float(s / n - (t / n) ** 2) for t, s in zip(total[::2], total[1::2], strict=True)]
    return QualityModel(tuple(mean), tuple(max(max(v, 0.0) ** 0.5, 1e-6) for v in spread), (1.0,) * len(square))


def _pairs(rows: DataFrame, model: QualityModel, found: dict[int, int], each: int, seed: int) -> DataFrame:
    """``diff``: features of an accepted document less those of a rejected one, ``each`` pairs for all of the larger class."""
    by_hash = [F.xxhash64(F.lit(seed), "_of"), F.col("_of"), F.col("x")]
    placed = number_within(rows, ["quality"], by_hash, "_place", PLACE_ROWS)
    placed = materialise(placed.select("quality", (F.col("_place") - 1).alias("at"), F.array(*model.standard(F.col("x"))).alias("z")))
    many = max(found, key=lambda q: (found[q], q))
    few = 1 - many
    shifts = np.random.default_rng(seed).integers(0, found[few], each).tolist()
    turn = F.explode(F.array(*map(F.lit, shifts))).alias("_shift")
    left = placed.filter(F.col("quality") == many).select("at", F.col("z").alias("_many"), turn)
    left = left.select("_many", ((F.col("at") + F.col("_shift")) % found[few]).alias("at"))
    right = placed.filter(F.col("quality") == few).select("at", F.col("z").alias("_few"))
    # Spark takes the explode to give one row each, and would broadcast what it makes of a small table
    right = F.broadcast(right) if found[few] <= SMALL_ROWS else right.hint("merge")
    good, bad = ("_many", "_few") if many == 1 else ("_few", "_many")
    return materialise(left.join(right, "at").select(F.zip_with(good, bad, lambda g, b: g - b).alias("diff")))


def _weights(pairs: DataFrame, size: int, n: int, ridge: float) -> tuple[float, ...]:
    """Newton's steps on the logistic loss of the differences."""
    ship(pairs.sparkSession)
    w = np.zeros(size)
    place = np.triu_indices(size)
    for _ in range(50):
        sums = pairs.mapInArrow(_slopes(w), "k int, total long").groupBy("k").agg(F.sum(F.col("total").cast("decimal(38,0)")))
        total = {k: float(t) / UNIT / n for k, t in sums.collect()}
        values = np.array([total[k] for k in range(size + len(place[0]))])
        curve = np.zeros((size, size))
        curve[place] = values[size:]
        curve = curve + curve.T - np.diag(np.diag(curve)) + ridge * np.eye(size)
        step = np.linalg.solve(curve, values[:size] - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _slopes(w: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of slopes, then of curvatures, over the pairs of a batch. Terms are rounded one by one, so sums are exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).T
            margin = sum(x * v for x, v in zip(d, w, strict=True))  # in one order, unlike a product of matrices
            p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            bend = p * (1 - p)
            terms = [x * (1 - p) for x in d] + [d[i] * d[j] * bend for i in range(len(d)) for j in range(i, len(d))]
            totals = [int(np.rint(t * UNIT).astype(np.int64).sum()) for t in terms]
            kinds = pa.array(np.arange(len(totals), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([kinds, pa.array(totals, pa.int64())], ["k", "total"])

    return run


def _quantile(rows: DataFrame, model: QualityModel, counts: dict[int, int], found: dict[int, int]) -> float:
    """The strength between the documents that are left out and the others, as many as labels reject.

    Documents stand for all labels of their class. Strengths are dealt out by ranges, and the range that has the
    quantile is gone through in order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strength = model.strength(F.col("x")).alias("s")
    tally = (F.count_if(F.col("quality") == q).alias(f"n{q}") for q in (0, 1))
    levels = rows.select(strength, "quality").groupBy("s").agg(*tally)
    dealt = materialise(levels.repartitionByRange(parts, "s").withColumn("part", F.spark_partition_id()))
    share = {q: counts[q] / found[q] for q in (0, 1)}
    wanted = counts[0] - 1e-12 * (counts[0] + counts[1])
    before = {0: 0, 1: 0}
    slices = dealt.groupBy("part").agg(F.min("s").alias("low"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).orderBy("part").collect()
    for at, r in enumerate(slices):  # one row for each range
        after = {q: before[q] + r[f"n{q}"] for q in (0, 1)}
        if sum(after[q] * share[q] for q in (0, 1)) >= wanted or at == len(slices) - 1:
            break
        before = after
    running = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    upto = {q: before[q] + F.sum(f"n{q}").over(running) for q in (0, 1)}
    within = dealt.filter(F.col("part") == r["part"]).select(
        "s", "n0", "n1", upto[0].alias("u0"), upto[1].alias("u1"), F.lead("s").over(Window.orderBy("s")).alias("above")
    )
    reached = F.col("u0") * share[0] + F.col("u1") * share[1]
    hit = within.filter(reached >= wanted).orderBy("s").first() or within.orderBy(F.desc("s")).first()
    # equal strengths: the rejected come first
    last = hit["u0"] - (hit["n1"] == 0), hit["u1"] - (hit["n1"] > 0)
    if last[0] * share[0] + last[1] * share[1] >= wanted and hit["n0"] + hit["n1"] > 1:
        return hit["s"]
    following = slices[at + 1]["low"] if at + 1 < len(slices) else hit["s"]
    above = hit["above"] if hit["above"] is not None else following
    return (hit["s"] + above) / 2


def score(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``CUT`` on).

    One pass without a shuffle. Null texts score as empty ones. Columns named like an output give
    way to it; rows that repeat are scored alike.
    """
    rows = packed(docs, OUTPUTS, _text=text_col)
    scored = rows.select("_row", let(_vector(F.col("_text")), model.score).alias("score"))
    return scored.select("_row.*", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
