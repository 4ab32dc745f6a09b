"""From raw model output to categorised detections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift import schemas
from reelsift.functions import classes
from reelsift.functions.geometry import truncated
from reelsift.operators.skew import WINDOW_ROWS, broadcast_if_small, number_within
from reelsift.params import MODELS, Params


def det_normalise(raw: DataFrame, params: Params = Params()) -> DataFrame:
    """Keep confident detections, truncate coordinates, align labels, name the class."""
    schemas.require(raw, schemas.RAW, "raw detections")
    ident = classes.class_id(F.col("model_source"), F.col("label"), params.label_map)
    return (
        raw.filter(F.col("score") >= F.lit(params.confidence))
        .select(
            *schemas.FRAME_COLUMNS,
            "model_source",
            "det_seq",
            *(truncated(F.col(c)).alias(c) for c in schemas.BOX_COLUMNS),
            F.col("score").alias("confidence"),
            ident.alias("class_id"),
        )
        .withColumn("class_name", classes.class_name(F.col("model_source"), F.col("class_id")))
    )


def det_categorise(det: DataFrame) -> DataFrame:
    """Long form: one ``category`` per detection."""
    return det.withColumn("category", classes.category(F.col("class_id")))


def categorise_nested(frames: DataFrame) -> DataFrame:
    """Nested form: the ``detections`` array of each frame split into three, order kept."""

    def of(name: str) -> Column:
        return F.filter("detections", lambda d: classes.category(d["class_id"]) == name)

    return frames.withColumns({name: of(name) for name in classes.CATEGORIES})


def model_subset(det: DataFrame, models: Sequence[str]) -> DataFrame:
    return det.filter(F.col("model_source").isin(*models))


def class_map(det: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Category per class id, by the built-in rule or by a table ``(class_id, category)``.

    Ids missing from the table count as objects. The table is broadcast once counted as small,
    since few classes hold most detections and a shuffle by class would pile these up.
    """
    if mapping is None:
        return det_categorise(det)
    table = broadcast_if_small(mapping.select("class_id", "category").dropDuplicates(["class_id"]))
    return det.drop("category").join(table, "class_id", "left").fillna("object", ["category"])


def all_detections(
    per_model: Mapping[str, DataFrame], limit: int | None = WINDOW_ROWS
) -> DataFrame:
    """Bag union of the models' outputs, numbered in visiting order within each frame.

    Each table brings the order of its own model in ``det_seq``.
    """
    rank = {m: i for i, m in enumerate(MODELS)}
    tables = [
        df.withColumns({"model_source": F.lit(m), "_model": F.lit(rank[m])})
        for m, df in sorted(per_model.items(), key=lambda item: rank[item[0]])
    ]
    union = reduce(DataFrame.unionByName, tables).withColumnRenamed("det_seq", "_seq")
    order = [F.col("_model"), F.col("_seq")]
    return number_within(union, ["frame_key"], order, "det_seq", limit).drop("_model", "_seq")


def detection_stats(det: DataFrame, params: Params = Params(ensemble=True)) -> DataFrame:
    """Which models are loaded, which of these found nothing, and the votes a consensus needs."""
    models = sorted(params.active_models)
    nothing = [F.when(F.count_if(F.col("model_source") == m) == 0, m) for m in models]
    return det.agg(
        F.lit(len(models)).cast("bigint").alias("total_models"),
        F.lit(",".join(models)).alias("loaded_models"),
        F.concat_ws(",", *nothing).alias("silent_models"),
        F.lit(params.effective_threshold).alias("voting_threshold"),
    )
