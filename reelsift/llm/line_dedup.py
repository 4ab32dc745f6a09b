"""Drop lines that other documents hold too, keeping each line's first document.

Two Bloom filters per slice of the hash space, one of hashes seen once and one of hashes seen
twice, decide which lines may repeat. Only those travel on for exact confirmation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift.llm.bloom import Bloom
from reelsift.llm.common import BLANKS, LOWER, UPPER, ascii_lower, packed, parts, ship, strip
from reelsift.operators.skew import broadcast_if_small
from reelsift.session import materialise

OUTPUTS = ("n_lines", "n_dropped", "kept_text")
BUFFER = 1 << 19  # hashes a task combines before it sends them
SLICE_ROWS = 1 << 20  # combined hashes of one pair of filters, on average


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of a task, each once per buffer, and whether the buffer had it more than once."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n > 1)], ["h", "many"])

    held: list[np.ndarray] = []
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False))
        if sum(map(len, held)) >= BUFFER:
            yield flush(held)
            held = []
    if held:
        yield flush(held)


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of one slice that two buffers, or one buffer twice, have; rarely some others."""
    held = [
        (b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).to_numpy(zero_copy_only=False))
        for b in batches
        if b.num_rows
    ]
    if not held:
        return
    capacity = sum(len(h) for h, _ in held)
    once, twice = Bloom(capacity), Bloom(capacity)
    for hashes, many in held:
        h, first, n = np.unique(hashes, return_index=True, return_counts=True)
        again = (n > 1) | once.has(h)
        again[np.isin(h, hashes[many])] = True
        twice.add(h[again])
        once.add(h)
    found = np.unique(np.concatenate([h[twice.has(h)] for h, _ in held]))
    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])


def _without(text: pd.Series, drops: pd.Series) -> pd.DataFrame:
    """Texts without the lines whose key digest is in ``drops``."""
    table = str.maketrans(UPPER, LOWER)
    counts, kept = [], []
    for t, d in zip(text, drops, strict=True):
        if d is None or t is None:
            counts.append(0)
            kept.append(None)
            continue
        gone, lines = {bytes(x) for x in d}, t.split("\n")
        stay = [
            x for x in lines if hashlib.sha256(x.strip(BLANKS).translate(table).encode()).digest() not in gone
        ]
        counts.append(len(lines) - len(stay))
        kept.append("\n".join(stay))
    return pd.DataFrame({"n_dropped": counts, "kept": kept})


def _keys(min_chars: int) -> Column:
    """The distinct keys of a text's lines that are long enough."""
    lines = F.split(F.coalesce(F.col("_text"), F.lit("")), "\n", -1)
    long = F.filter(F.transform(lines, strip), lambda k: F.char_length(k) >= min_chars)
    return F.array_distinct(F.transform(long, ascii_lower))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line's key is the line without outer white space, A-Z lower-cased. Keys of ``min_chars`` code
    points or more that two documents hold lose their lines in all but the smallest id.

    Null or empty text is one empty line, and its ``kept_text`` is empty. Rows with one id are one
    document; rows without id are one document too, after all others. Repeats within a document stay.
    Empty tables give empty results, and input columns named like an output give way to it.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = packed(docs, OUTPUTS, _id=id_col, _text=text_col)
    keys = rows.select("_id", F.explode(_keys(min_chars)).alias("key"))

    combined = materialise(
        keys.select(F.xxhash64("key").alias("h")).mapInArrow(_combine, "h long, many boolean")
    )
    slices = parts(spark, combined.count(), SLICE_ROWS)
    suspects = materialise(combined.repartition(slices, "h").mapInArrow(_suspects, "h long"))

    lines = keys.select(
        "_id", F.xxhash64("key").alias("h"), F.unhex(F.sha2("key", 256)).alias("digest")
    )
    repeats = materialise(lines.join(broadcast_if_small(suspects), "h", "left_semi").drop("h"))
    held = repeats.groupBy("digest").agg(
        F.min("_id").alias("first"), F.max("_id").alias("last"), F.max(F.col("_id").isNull()).alias("nameless")
    )
    confirmed = held.filter((F.col("first") != F.col("last")) | F.col("first").isNotNull() & F.col("nameless"))
    drops = (
        repeats.join(broadcast_if_small(materialise(confirmed)), "digest")
        .filter(~F.col("_id").eqNullSafe(F.col("first")))
        .groupBy("_id")
        .agg(F.collect_set("digest").alias("drops"))
        .withColumnRenamed("_id", "_of")
    )

    joined = rows.join(drops, F.col("_id").eqNullSafe(F.col("_of")), "left")
    text = F.coalesce(F.col("_text"), F.lit(""))
    without = F.pandas_udf(_without, "n_dropped long, kept string")
    cut = joined.withColumn(
        "_cut", without(F.when(F.col("drops").isNotNull(), F.col("_text")), F.col("drops"))
    )
    return cut.select(
        "_row.*",
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        F.col("_cut.n_dropped").alias("n_dropped"),
        F.coalesce(F.col("_cut.kept"), text).alias("kept_text"),
    )
