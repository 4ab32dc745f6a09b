"""Frames from streams of single rows, complete as soon as all that was announced has arrived.

A detection job writes a row for each detection and, for each frame and source, one report that says how
many rows there are, also where there are none. Sources are the models and ``regions``. A frame with all
reports and rows comes out at once; ``nest_rows`` would wait until the watermark has passed it.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelsift import schemas
from reelsift.params import Params

REGIONS = "regions"  # the source of text regions
COMPLETE, EXPIRED, LATE = "complete", "expired", "late"
REPORTS = T.StructType(
    [*schemas.FRAMES.fields, T.StructField("source", T.StringType()), T.StructField("n_rows", T.IntegerType())]
)
_DETECTION = schemas.NESTED_DETECTION.names
_RECT = schemas.NESTED["regions"].dataType.elementType.names
_MEMBERS = T.StructType(
    [T.StructField("source", T.StringType()), *schemas.NESTED_DETECTION.fields, *schemas.NESTED["regions"].dataType.elementType.fields]
)
# Rows travel as plain numbers, so that pandas keeps their types: what is null is 0 and has its bit in ``_nulls``.
_RECT_OF = tuple(_RECT)
_NUMBERS = (*schemas.FRAME_COLUMNS, *(c for c in _DETECTION if c != "model_source"), *_RECT_OF)
_ID_NULLS = sum(1 << _NUMBERS.index(c) for c in ("frame_no", "frame_key"))
_COLUMNS = (*_NUMBERS, "model_source", "_nulls", "_kind", "_source", "_n_rows", "_millis")
_FOUND, _REGION, _REPORT, _OUT = range(4)  # kinds of rows; the last stands for a frame that is out
_SLICE = 256  # frames of a video, next to each other, that share a state
_TYPES = {
    "status": "string", **{c: "bigint" if c == "frame_key" else "int" for c in schemas.FRAME_COLUMNS}, "nulls": "int",
    "d0": "int", "dn": "int", "r0": "int", "rn": "int",
}
_FRAME_OUT = tuple(_TYPES)
_FOUND_OUT = {f.name: f.dataType.simpleString() for f in schemas.NESTED_DETECTION.fields}
_SLICE_OUT = ", ".join(
    f"{c} array<{t}>" for c, t in (_TYPES | _FOUND_OUT | dict.fromkeys(_RECT, "int") | {"d_nulls": "int", "r_nulls": "int"}).items()
)
KEPT_BATCHES = 2  # micro-batches whose state stays to start again from
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def long_rows(reports: DataFrame, detections: DataFrame, regions: DataFrame, time: str = "event_time") -> DataFrame:
    """The three kinds of rows as one table, all with the frame's ``time``. Streams or not."""

    def rows(df: DataFrame, source: Column, n_rows: Column, own: tuple[str, ...] = ()) -> DataFrame:
        rest = (F.col(f.name) if f.name in own else F.lit(None).cast(f.dataType).alias(f.name) for f in _MEMBERS[1:])
        return df.select(time, *schemas.FRAME_COLUMNS, source.alias("source"), n_rows.cast("int").alias("n_rows"), *rest)

    none = F.lit(None)
    return (
        rows(reports, F.col("source"), F.col("n_rows"))
        .unionByName(rows(detections, F.col("model_source"), none, tuple(_DETECTION)))
        .unionByName(rows(regions, F.lit(REGIONS), none, tuple(_RECT)))
    )


def _stored(rows: dict[str, np.ndarray]) -> bytes:
    """``rows`` for the state: the bytes of numbers by significance, names by their place in a list, compressed."""
    parts = {}
    for c, v in rows.items():
        if v.dtype == object:
            names = pa.array(v, pa.string(), from_pandas=True).dictionary_encode()
            parts[c] = names.dictionary.to_pylist(), names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        else:
            parts[c] = v.dtype.str, np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()
    raw = pickle.dumps(parts, protocol=5)
    return b"z" + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _restored(stored: bytes) -> dict[str, np.ndarray]:
    if stored[:1] != b"z":  # as it was stored before it was compressed
        return pickle.loads(stored)
    rows = {}
    raw = pa.decompress(stored[9:], int.from_bytes(stored[1:9], "little"), codec="zstd", asbytes=True)
    for c, (kind, v) in pickle.loads(raw).items():
        if isinstance(kind, str):
            width = np.dtype(kind).itemsize
            rows[c] = np.ascontiguousarray(np.frombuffer(v, np.uint8).reshape(width, len(v) // width).T).view(kind).ravel()
        else:
            rows[c] = np.array([*kind, None], object)[v]
    return rows


class _Gathering:
    """Frames of a slice of a video: the rows that have come until a frame goes out, and one row from then on.

    All frames of a slice that a micro-batch touches are handled at once, on arrays.
    """

    def __init__(self, sources: tuple[str, ...]) -> None:
        self.sources = sources

    def step(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [_restored(bytes(state.get[0]))] if state.exists else []
        parts = held + [{c: b[c].to_numpy() for c in _COLUMNS} for b in batches if len(b)]
        if not parts:
            return
        rows = {c: np.concatenate([p[c] for p in parts]) for c in _COLUMNS}
        identity = (rows["frame_key"], rows["frame_no"], rows["_nulls"] & _ID_NULLS)
        order = np.lexsort(identity)  # keeps the order of arrival within a frame
        rows = {c: v[order] for c, v in rows.items()}
        first = np.ones(len(order), bool)
        first[1:] = np.any([i[order][1:] != i[order][:-1] for i in identity], axis=0)
        of, start = np.cumsum(first) - 1, np.flatnonzero(first)
        n, kind = len(start), rows["_kind"]
        member, over = kind <= _REGION, rows["_millis"][start] < state.getCurrentWatermarkMs()
        out = np.bincount(of[kind == _OUT], minlength=n) > 0
        whole = self._complete(rows, of, n) & ~out
        late = out & (np.bincount(of[member], minlength=n) > 0)
        status = np.select([late, whole, over & ~out], [LATE, COMPLETE, EXPIRED], "")
        if (status != "").any():
            yield self._frames(rows, of, np.r_[start[1:], len(order)] - 1, status)
        kept = ~over[of] & np.where(out[of], kind == _OUT, np.where(whole[of], first, True))
        if not kept.any():
            if state.exists:
                state.remove()
            return
        rows = {c: v[kept] for c, v in rows.items()}
        rows["_kind"] = np.where(whole[of][kept], _OUT, rows["_kind"]).astype(np.int32)
        state.update((_stored(rows),))
        state.setTimeoutTimestamp(max(1, int(rows["_millis"].min())))

    def _complete(self, rows: dict[str, np.ndarray], of: np.ndarray, n: int) -> np.ndarray:
        """Whether all sources of a frame have reported and all their rows have come."""
        size = len(self.sources)
        known, wanted = np.zeros((n, size), bool), np.zeros((n, size), np.int64)
        told = (rows["_kind"] == _REPORT) & (rows["_source"] >= 0)
        known[of[told], rows["_source"][told]] = True
        wanted[of[told], rows["_source"][told]] = rows["_n_rows"][told]
        came = (rows["_kind"] <= _REGION) & (rows["_source"] >= 0)
        arrived = np.bincount(of[came] * size + rows["_source"][came], minlength=n * size).reshape(n, size)
        return (known & (arrived >= wanted)).all(axis=1)

    def _frames(self, rows: dict[str, np.ndarray], of: np.ndarray, last: np.ndarray, status: np.ndarray) -> pd.DataFrame:
        """Frames with a status as one row of arrays; a frame's members lie side by side in theirs."""
        sent = status != ""
        found, region = ((rows["_kind"] == k) & sent[of] for k in (_FOUND, _REGION))
        done = {"status": status[sent].astype(object), "nulls": rows["_nulls"][last][sent]}
        done |= {c: rows[c][last][sent] for c in _NUMBERS if c in _FRAME_OUT}
        for kind, chosen in (("d", found), ("r", region)):
            size = np.bincount(of[chosen], minlength=len(status))[sent]
            done |= {f"{kind}n": size.astype(np.int32), f"{kind}0": (np.cumsum(size) - size + 1).astype(np.int32)}
            done[f"{kind}_nulls"] = rows["_nulls"][chosen]
        done |= {c: rows[c][found] for c in _FOUND_OUT} | {c: rows[c][region] for c in _RECT_OF}
        return pd.DataFrame({c: [v] for c, v in done.items()})


def _packed(rows: DataFrame, sources: tuple[str, ...], time: str) -> DataFrame:
    """``rows`` as numbers without nulls, and the slice they belong to."""
    kinds = dict(rows.dtypes)
    nulls = (F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(_NUMBERS))
    is_region = F.coalesce(F.col("source") == REGIONS, F.lit(False))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, sources)), F.col("source")), F.lit(0)) - 1
    kind = F.when(F.col("n_rows").isNotNull(), _REPORT).when(is_region, _REGION).otherwise(_FOUND)
    return rows.select(
        time,
        F.col("video_id").alias("_video"),
        F.floor(F.col("frame_no") / _SLICE).alias("_slice"),
        *(F.coalesce(c, F.lit(0).cast(kinds[c])).alias(c) for c in _NUMBERS),
        "model_source",
        reduce(lambda a, b: a + b, nulls).alias("_nulls"),
        kind.alias("_kind"),
        place.cast("int").alias("_source"),
        F.coalesce("n_rows", F.lit(0)).alias("_n_rows"),
        F.coalesce(F.unix_millis(time), F.lit(0).cast("long")).alias("_millis"),
    )


def _unpacked(slices: DataFrame) -> DataFrame:
    """A row for each frame of ``slices``."""

    def real(x: Column, nulls: str, c: str) -> Column:
        number = F.coalesce(x[c], F.lit(float("nan"))) if c == "confidence" else x[c]  # pandas gives NaN as null
        return F.when(x[nulls].bitwiseAND(1 << _NUMBERS.index(c)) == 0, number).alias(c)

    def members(f: Column, kind: str, columns: tuple[str, ...]) -> Column:
        nulls = f"{kind}_nulls"
        parts = (F.slice(c, f[f"{kind}0"], f[f"{kind}n"]).alias(c) for c in (*columns, nulls))
        return F.transform(
            F.arrays_zip(*parts),
            lambda m: F.struct(*(real(m, nulls, c) if c in _NUMBERS else m[c].alias(c) for c in columns)),
        )

    def frame(f: Column) -> Column:
        return F.struct(
            *(real(f, "nulls", c) for c in schemas.FRAME_COLUMNS),
            members(f, "d", tuple(_DETECTION)).alias("detections"),
            members(f, "r", _RECT_OF).alias("regions"),
            f["status"].alias("status"),
        )

    return slices.select(F.inline(F.transform(F.arrays_zip(*_FRAME_OUT), frame)))


def gather_frames(
    rows: DataFrame, params: Params = Params(), time: str = "event_time", delay: str = "10 minutes"
) -> DataFrame:
    """Nested rows with ``status``, from a stream of ``long_rows``.

    ``complete`` frames have all rows that their models (and regions, where texts are looked for) reported.
    A frame is ``expired`` when rows more than ``delay`` later arrive first, and comes out with what there
    is. Rows that arrive for a frame which is out, but not that much too late, come out as ``late``; rows
    later still are left out and counted (``late_rows``). So a frame is ``complete`` or ``expired`` once.

    A frame holds its rows in state until it is complete, and one row until ``delay`` has passed. State is
    kept for each ``_SLICE`` frame numbers of a video, so a frame number should name few frames. A micro-batch
    reads and writes the states of the slices it has rows for. ``STATE_STORE`` keeps state out of the JVM's heap.
    """
    sources = (*params.active_models, *((REGIONS,) if params.text_gate_active else ()))
    timed = rows.withWatermark(time, delay)
    slices = (
        _packed(timed, sources, time)
        .groupBy("_video", "_slice")
        .applyInPandasWithState(_Gathering(sources).step, _SLICE_OUT, "rows binary", "append", GroupStateTimeout.EventTimeTimeout)
    )
    return _unpacked(slices)


@contextmanager
def state_store(spark: SparkSession, more: dict[str, str] | None = None) -> Iterator[None]:
    """Streams started within keep their state in ``STATE_STORE``, from their first start on.

    Of the states of earlier micro-batches only those of the last ``KEPT_BATCHES`` stay, unless it is set how many.
    ``more`` settings hold for as long.
    """
    keys = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE} | (more or {})
    if spark.conf.get("spark.sql.streaming.minBatchesToRetain", None) is None:
        keys["spark.sql.streaming.minBatchesToRetain"] = str(KEPT_BATCHES)
    was = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def late_rows(query: StreamingQuery) -> int:
    """Rows left out as too late, in the micro-batches still on record."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


# Python workers may not see the files of this package. So what this module defines travels in full, not by name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
