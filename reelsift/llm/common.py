"""Text primitives and table helpers shared by the operators of this subpackage.

White space means ``[\\x20\\x09-\\x0D]`` throughout, and lower-casing touches A-Z alone.
"""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay. Plain ASCII takes the fast built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), "")


def column(df: DataFrame, name: str) -> Column:
    return df["`" + name.replace("`", "``") + "`"]


def packed(df: DataFrame, outputs: Sequence[str], **inputs: str) -> DataFrame:
    """``df`` as one struct ``_row`` beside renamed inputs, so that no name can clash.

    Columns named like one of ``outputs`` are left out: an operator's own results win.
    """
    taken = {name.lower() for name in outputs}
    kept = [column(df, c).alias(c) for c in df.columns if c.lower() not in taken]
    row = F.struct(*kept) if kept else F.struct(F.lit(None).alias("_"))
    return df.select(row.alias("_row"), *(column(df, c).alias(alias) for alias, c in inputs.items()))


def cuts(texts: pa.Array, size: int) -> list[tuple[int, int]]:
    """Where slices of ``texts`` of about ``size`` bytes start and stop; a longer text is one by itself."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = np.flatnonzero((ends[1:] // size != ends[:-1] // size) | (sizes[1:] > size)) + 1
    at = [0, *starts.tolist(), len(texts)] if len(texts) else [0]
    return list(zip(at, at[1:], strict=False))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, rows: int, rows_per_part: int) -> int:
    """Partitions that hold ``rows_per_part`` rows on average, at least the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_part))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once, for operators with Python functions."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    bundle = io.BytesIO()
    with zipfile.ZipFile(bundle, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}-{uuid.uuid4().hex[:8]}.zip"
    target.write_bytes(bundle.getvalue())
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
