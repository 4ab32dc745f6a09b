"""Reconciling several models: IoU matching, first-fit groups, votes and consensus.

First-fit grouping visits the detections of a frame in ``det_seq`` order; a detection joins the
earliest founded group holding any match of its class, else it founds one. Groups never merge, so
this is not connected components. As groups are scanned in the order of their founders,

    gid(d) = min { gid(e) : e before d, same class, IoU(d, e) >= t },  or d itself if there is none.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsift import schemas
from reelsift.functions import classes
from reelsift.functions.geometry import Box, iou, truncated
from reelsift.operators.detections import model_subset
from reelsift.operators.graph import components
from reelsift.operators.skew import broadcast_if_small, split_large_groups
from reelsift.params import MODELS, Params
from reelsift.session import materialise

FOLD_ROWS = 512  # detections of one frame and class that are folded within a row
PAIR_ROWS = 1024  # ... that are compared without a spatial grid
VISIT_ROWS = 20_000_000  # ... that one task may visit one by one, keeping their distinct boxes
VISIT_TASKS = 4  # tasks of such visits for each shuffle partition, so that few large groups meet in one
COMPONENT_ROWS = 1_000_000  # detections connected by matches that one task may visit one by one
COMPONENT_LINKS = 2_000_000  # ... and matches between their distinct boxes

_GROUP = ["frame_key", "class_id"]
_BOX = [*_GROUP, *schemas.BOX_COLUMNS]
_TO_END = 2**31 - 1


# --- pairs -----------------------------------------------------------------------------------


def iou_pairs(
    det: DataFrame, params: Params = Params(ensemble=True), limit: int | None = PAIR_ROWS
) -> DataFrame:
    """Pairs of one frame and class whose IoU reaches the threshold, earlier detection first.

    An equi-join on frame and class with the IoU as residual condition. Where a group is large the
    join key also holds a grid cell, so only boxes of like place and size meet.
    """
    slim = det.select(*_GROUP, "det_seq", *schemas.BOX_COLUMNS)
    usual, large = split_large_groups(slim, _GROUP, limit)
    pairs = _matching(usual.join(_renamed(usual), _GROUP), params.iou_threshold)
    if large is not None:
        near = _grid_join(large, params.iou_threshold)
        pairs = pairs.unionByName(_matching(near, params.iou_threshold))
    return pairs


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: f"o_{c}" for c in df.columns if c not in _GROUP})


def _matching(joined: DataFrame, threshold: float) -> DataFrame:
    return (
        joined.filter(F.col("det_seq") < F.col("o_det_seq"))
        .withColumn("iou", iou(Box.named(), Box.named("o_")))
        .filter(F.col("iou") >= F.lit(threshold))
        .select(
            *_GROUP,
            F.col("det_seq").alias("det_seq_a"),
            F.col("o_det_seq").alias("det_seq_b"),
            "iou",
        )
    )


def _grid_join(boxes: DataFrame, threshold: float) -> DataFrame:
    """Candidates for IoU >= threshold: a superset of the matches, each ordered pair once.

    IoU >= t implies, per axis, that the sizes differ by a factor of at most 1/t and the starts by
    at most (1 - t) times the larger size. Each box is filed once, under its size levels (powers of
    ``base``) and the cell its start lies in; it looks itself up in the adjacent levels and all
    cells its partners may be filed in. The slack in ``base`` and reach absorbs rounding.
    """
    base = 1.01 / threshold

    def level(size: Column) -> Column:
        return F.floor(F.log(size.cast("double")) / F.lit(math.log(base))).cast("int")

    def cell_size(lvl: Column) -> Column:
        return F.pow(F.lit(base), lvl + 1)

    def lookups(start: Column, size: Column) -> Column:
        def cells(lvl: Column) -> Column:
            reach = F.greatest(size.cast("double"), cell_size(lvl)) * (1.01 - threshold) + 1
            first = F.floor((start - reach) / cell_size(lvl))
            last = F.floor((start + reach) / cell_size(lvl))
            return F.transform(F.sequence(first, last), lambda c: F.struct(lvl.alias("l"), c.alias("c")))

        near = F.array(level(size) - 1, level(size), level(size) + 1)
        return F.flatten(F.transform(near, cells))

    box = Box.named()
    wide, high = box.x2 - box.x1, box.y2 - box.y1
    solid = boxes.filter((wide > 0) & (high > 0))  # others have IoU 0 with everything
    filed = solid.withColumns({"_lx": level(wide), "_ly": level(high)}).withColumns(
        {
            "_cx": F.floor(box.x1 / cell_size(F.col("_lx"))),
            "_cy": F.floor(box.y1 / cell_size(F.col("_ly"))),
        }
    )
    searching = (
        _renamed(solid.withColumns({"_sx": lookups(box.x1, wide), "_sy": lookups(box.y1, high)}))
        .withColumn("_x", F.explode("o__sx"))
        .withColumn("_y", F.explode("o__sy"))
        .withColumns(
            {
                "_lx": F.col("_x.l"),
                "_cx": F.col("_x.c"),
                "_ly": F.col("_y.l"),
                "_cy": F.col("_y.c"),
            }
        )
        .drop("o__sx", "o__sy", "_x", "_y")
    )
    cell = ["_lx", "_cx", "_ly", "_cy"]
    return filed.join(searching, [*_GROUP, *cell]).drop(*cell)


# --- groups ----------------------------------------------------------------------------------


def vote_groups(
    det: DataFrame,
    params: Params = Params(ensemble=True),
    limit: int | None = FOLD_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Add ``gid``, the ``det_seq`` of the founder of each detection's group.

    The detections of a frame and class fit into a row almost always; there the recurrence is a
    fold over the sorted array, after one shuffle by frame that later steps per frame reuse. Larger
    groups are visited in order by a task each (``_group_in_order``), which finds no pairs. Groups beyond
    ``VISIT_ROWS``, and those that a lower ``limit`` leaves out, are solved by joins (``_group_large``).
    The result is the same. Sizes are taken from
    ``sized_by``, a table cheaper to count that holds all rows of ``det``, or from ``det`` itself.
    """
    usual, large = split_large_groups(det, _GROUP, limit, sized_by)
    grouped = _group_by_fold(usual, params.iou_threshold)
    for part, group in _by_size(large) if large is not None else ():
        grouped = grouped.unionByName(group(part, params.iou_threshold).select(*grouped.columns))
    return grouped.select(*det.columns, "gid")


def _by_size(large: DataFrame) -> list[tuple[DataFrame, Callable[[DataFrame, float], DataFrame]]]:
    """The parts of ``large`` that there are, and what solves each."""
    sizes = materialise(large.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("_rows")))
    visited = F.col("_rows").between(FOLD_ROWS + 1, VISIT_ROWS)
    kinds = ((sizes.filter(visited), _group_in_order), (sizes.filter(~visited), _group_large))
    return [
        (large.join(broadcast_if_small(keys.select(*_GROUP)), _GROUP, "left_semi"), group)
        for keys, group in kinds
        if not keys.isEmpty()
    ]


class _Visited:
    """The boxes of one frame and class visited so far, by size and place, with their groups.

    Most rows are decided in blocks (``groups``). Boxes of like size and place share a patch, which knows the hull
    of its boxes. Patches that hold boxes which match are connected, and no group of a connected component can be
    earlier than its first row. So a row that matches a box of that group, kept for its patch, is decided; hashes
    of patches may collide, as the box is compared in full. Other rows are visited one by one (``_group``): boxes
    are filed as in ``_grid_join``; cells and their chunks know their least group, so a box that has found a group
    is not compared with boxes of that group or later ones. A copy of a box is filed only if its group is an
    earlier one.
    """

    CHUNK = 1024
    BLOCK = 256, 16384  # rows decided at once: at first, and at most
    PAIRS = 20_000_000, 2000  # pairs of boxes and hulls compared to connect patches: at first, and for each row

    def __init__(self, threshold: float) -> None:
        self.threshold, self.base = threshold, 1.01 / threshold
        self.log = math.log(self.base)
        self.cells: dict[tuple, list] = {}  # filed rows x1, y1, x2, y2, gid, seq; their number; least group; that of chunks
        self.least: dict[bytes, int] = {}  # by box
        self.fine = max((2 * threshold / (1 + threshold)) ** -0.5, 1.02)  # boxes of one patch mostly match
        self.ids: dict[int, int] = {}  # patches by hash
        self.used, self.block, self.left = 0, self.BLOCK[0], self.PAIRS[0]
        self.kept: dict[int, list[np.ndarray]] = {}  # by patch, its boxes
        self.hull = np.empty((8, 0), np.int64)  # by patch: least x1, y1, width, height, greatest x2, y2, width, height
        self.part = np.empty(0, np.int64)  # ... its connected component
        self.first = np.empty(0, np.int64)  # ... by component, the first row
        self.seed = np.empty((5, 0), np.int64)  # ... a box and its group

    def groups(self, seq: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        """The groups of the next rows: their numbers, and x1, y1, x2, y2 as rows of an array."""
        gids, at = seq.copy(), 0
        solid = np.flatnonzero((boxes[2] > boxes[0]) & (boxes[3] > boxes[1]))
        while at < len(solid):
            some = solid[at : at + self.block]
            gids[some] = self._block(seq[some], np.ascontiguousarray(boxes[:, some]))
            at, self.block = at + self.block, min(2 * self.block, self.BLOCK[1])
        return gids

    def _block(self, seq: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        self.left += self.PAIRS[1] * len(seq)
        patch, least = self._patches(seq, boxes), self.least
        keys = np.ascontiguousarray(boxes.T).view(f"V{4 * boxes.itemsize}").ravel().tolist()
        new = [i for k, i in dict(zip(keys, range(len(keys)), strict=True)).items() if k not in least]
        self._connect(patch[new], boxes[:, new])
        floor = self.first[self.part[patch]]
        sure = (self.seed[4, patch] == floor) & self._near(self.seed[:4, patch], boxes)
        gids = np.where(sure, floor, seq)
        new = []
        for i, known in zip(np.flatnonzero(sure).tolist(), floor[sure].tolist(), strict=True):
            if least.get(keys[i], known + 1) > known:
                least[keys[i]] = known
                new.append(i)
        self._file(boxes[:, new], gids[new], seq[new])
        for i in np.flatnonzero(~sure).tolist():
            box, own, end = tuple(boxes[:, i].tolist()), patch[i], int(floor[i])
            known = end if self.seed[4, own] == end and self._near(self.seed[:4, own], boxes[:, i]) else least.get(keys[i])
            gid = self._group(int(seq[i]), box, known, end)
            gids[i] = gid
            if gid == end and self.seed[4, own] != end:
                self.seed[:, own] = (*box, gid)
            if gid < least.get(keys[i], gid + 1):
                least[keys[i]] = gid
                self._file(boxes[:, i : i + 1], gids[i : i + 1], seq[i : i + 1])
        return gids

    def _near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wide, high = np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), np.minimum(a[3], b[3]) - np.maximum(a[1], b[1])
        shared = np.maximum(wide, 0) * np.maximum(high, 0)
        area = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1])
        return (shared > 0) & (shared / np.maximum(area - shared, 1) >= self.threshold)

    def _patches(self, seq: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        """The patch of each row, after hulls have taken in the rows."""
        size = boxes[2:] - boxes[:2]
        level = np.floor(np.log(size) / math.log(self.fine)).astype(np.int64)
        place = np.floor(boxes[:2] / (self.fine**level * (1 - 1 / self.fine))).astype(np.int64)
        code = np.zeros(len(seq), np.uint64)
        for part in (*level, *place):
            code = (code ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        names, start, inverse = np.unique(code, return_index=True, return_inverse=True)
        patches = np.array([self.ids.setdefault(c, len(self.ids)) for c in names.tolist()])
        more = len(self.ids) - self.used
        if self.used + more > len(self.part):
            self._grow(2 * (self.used + more))
        fresh = patches >= self.used
        self.first[patches[fresh]] = seq[start[fresh]]
        self.used += more
        order = np.argsort(inverse, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(inverse))])[:-1]
        low = np.minimum.reduceat(np.concatenate([boxes[:2], size])[:, order], ends, axis=1)
        high = np.maximum.reduceat(np.concatenate([boxes[2:], size])[:, order], ends, axis=1)
        was = self.hull[:, patches]
        self.hull[:, patches] = np.concatenate([np.minimum(was[:4], low), np.maximum(was[4:], high)])
        return patches[inverse]

    def _grow(self, size: int) -> None:
        n = len(self.part)
        far = np.iinfo(np.int64).max
        blank = np.repeat(np.array([far] * 4 + [-far] * 4)[:, None], size - n, axis=1)
        self.hull = np.concatenate([self.hull, blank], axis=1)
        self.part = np.concatenate([self.part, np.arange(n, size) if self.left >= 0 else np.zeros(size - n, np.int64)])
        self.first = np.concatenate([self.first, np.full(size - n, far if self.left >= 0 else self.first[0])])
        self.seed = np.concatenate([self.seed, np.full((5, size - n), -1)], axis=1)

    def _connect(self, patch: np.ndarray, boxes: np.ndarray) -> None:
        """Keep boxes that are new, and join the components of patches that hold a match with one of them.

        Where so many patches lie apart that it takes too long, all are held to be connected, which is safe.
        """
        if self.left < 0 or not len(patch):
            return
        order = np.argsort(patch, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(patch[order]) > 0])
        fresh = dict(zip(patch[order][starts].tolist(), np.split(boxes[:, order], starts[1:], axis=1), strict=True))
        for p, some in fresh.items():
            self.kept.setdefault(p, []).append(some)
        touched, part = np.array(list(fresh)), self.part[: self.used]
        main = np.bincount(part).argmax()
        rest, inside = np.flatnonzero(part != main), part[touched] == main
        for some, others in ((touched[~inside], np.arange(self.used)), (touched[inside], rest)):
            step = max(1, 4_000_000 // max(len(others), 1))
            for k in range(0, len(some) if len(others) else 0, step):
                few = some[k : k + step]
                self.left -= len(few) * len(others)
                x, y = np.nonzero(self._may_match(self.hull[:, few, None], self.hull[:, None, others]))
                self._meet(few[x], others[y], fresh)
                if self.left < 0:
                    self.left = -math.inf
                    self.part[:], self.first[:] = 0, self.first.min()
                    self.kept.clear()
                    return

    def _meet(self, a: np.ndarray, b: np.ndarray, fresh: dict[int, np.ndarray]) -> None:
        """Join the components of patches ``a`` and ``b`` if new boxes of the one match boxes of the other."""
        a, b = (x[self.part[a] != self.part[b]] for x in (a, b))
        near = self._near(np.stack([self.kept[p][0][:, 0] for p in a.tolist()], 1), np.stack([self.kept[p][0][:, 0] for p in b.tolist()], 1)) if len(a) else []
        if np.any(near):
            self._join(np.unique(self.part[a[near]] * len(self.part) + self.part[b[near]]))
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            if self.part[p] != self.part[q] and self.left >= 0:
                self.kept[q] = [np.concatenate(self.kept[q], axis=1)]
                new, old = fresh[p], self.kept[q][0]
                self.left -= new.shape[1] * old.shape[1]
                if any(self._near(new[:, i, None], old).any() for i in range(new.shape[1])):
                    self._join(np.array([self.part[p] * len(self.part) + self.part[q]]))

    def _join(self, pairs: np.ndarray) -> None:
        """Join components, given as pairs ``x * len(self.part) + y``."""
        root = {x: x for x in np.unique(np.concatenate(np.divmod(pairs, len(self.part)))).tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x, y in zip(*(p.tolist() for p in np.divmod(pairs, len(self.part))), strict=True):
            root[find(x)] = find(y)
        moved = np.arange(len(self.part))
        for x in root:
            moved[x] = find(x)
            self.first[find(x)] = min(self.first[find(x)], self.first[x])
        self.part[: self.used] = moved[self.part[: self.used]]

    def _may_match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        spans = (np.minimum(a[4 + k], b[4 + k]) - np.maximum(a[k], b[k]) for k in (0, 1))
        wide, high = (np.minimum(s, np.minimum(a[6 + k], b[6 + k])) for k, s in enumerate(spans))
        shared = np.maximum(wide, 0) * np.maximum(high, 0).astype(float)
        return (shared > 0) & (shared * (1 + self.threshold) * (1 + 1e-9) >= self.threshold * (a[2] * a[3] + b[2] * b[3]))

    def _lookups(self, start: int, size: int, level: int) -> list[tuple[int, int]]:
        near = []
        for lvl in (level, level - 1, level + 1):
            cell = self.base ** (lvl + 1)
            reach = max(size, cell) * (1.01 - self.threshold) + 1
            near.extend((lvl, c) for c in range(math.floor((start - reach) / cell), math.floor((start + reach) / cell) + 1))
        return near

    def _group(self, seq: int, box: tuple, known: int | None, end: int) -> int:
        """The group of a row whose box is in group ``known`` already; none is earlier than ``end``."""
        best = seq if known is None else known
        if best == end:
            return best
        x1, y1, x2, y2 = box
        wide, high = x2 - x1, y2 - y1
        lx, ly = math.floor(math.log(wide) / self.log), math.floor(math.log(high) / self.log)
        cells, earlier, ys = self.cells, [], self._lookups(y1, high, ly)
        for x in self._lookups(x1, wide, lx):
            for y in ys:
                cell = cells.get((*x, *y))
                if cell is not None and cell[2] < best:
                    earlier.append(cell)
        earlier.sort(key=lambda c: c[2])
        for rows, n, first, chunks in earlier:
            if first >= best:
                break
            for k, of_chunk in enumerate(chunks):
                if of_chunk < best:
                    best = min(best, self._hit(rows[:, k * self.CHUNK : min(n, (k + 1) * self.CHUNK)], box, wide * high, best, seq))
                    if max(first, end) >= best:
                        break
        return best

    def _hit(self, rows: np.ndarray, box: tuple, area: int, best: int, seq: int) -> int:
        a1, b1, a2, b2, gid, since = rows
        x1, y1, x2, y2 = box
        wide, high = np.minimum(a2, x2) - np.maximum(a1, x1), np.minimum(b2, y2) - np.maximum(b1, y1)
        shared = np.maximum(wide, 0) * np.maximum(high, 0)
        near = (shared / ((a2 - a1) * (b2 - b1) + area - shared) >= self.threshold) & (shared > 0)
        hits = gid[near & (since < seq)]
        return int(hits.min()) if len(hits) else best

    def _file(self, boxes: np.ndarray, gids: np.ndarray, seq: np.ndarray) -> None:
        if not len(gids):
            return
        level = np.floor(np.log(boxes[2:] - boxes[:2]) / self.log).astype(np.int64)
        place = np.floor(boxes[:2] / self.base ** (level + 1.0)).astype(np.int64)
        keys = np.stack([level[0], place[0], level[1], place[1]])
        order = np.lexsort(keys)
        keys, rows = keys[:, order], np.concatenate([boxes, gids[None], seq[None]])[:, order]
        starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        for a, b in zip(starts, [*starts[1:], len(gids)], strict=True):
            self._add(tuple(keys[:, a].tolist()), rows[:, a:b])

    def _add(self, key: tuple, rows: np.ndarray) -> None:
        cell = self.cells.setdefault(key, [np.empty((6, 4), np.int64), 0, int(rows[4, 0]), []])
        held, n, first, chunks = cell
        end = n + rows.shape[1]
        if end > held.shape[1]:
            cell[0] = np.concatenate([held[:, :n], np.empty((6, 2 * end - n), np.int64)], axis=1)
        cell[0][:, n:end] = rows
        for k in range(n // self.CHUNK, (end - 1) // self.CHUNK + 1):
            own = int(cell[0][4, max(n, k * self.CHUNK) : min(end, (k + 1) * self.CHUNK)].min())
            if k == len(chunks):
                chunks.append(own)
            chunks[k] = min(chunks[k], own)
        cell[1], cell[2] = end, min(first, *chunks[n // self.CHUNK :])


def _group_in_order(det: DataFrame, threshold: float) -> DataFrame:
    """The same groups by visiting the detections of each frame and class in order.

    Rows pass through in batches; a task holds the distinct boxes of one frame and class. As visiting takes
    its time, groups are spread over many tasks however few their rows are.
    """
    tasks = VISIT_TASKS * int(det.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    det = det.select(*det.columns, F.col("det_seq").alias("gid"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, visited = None, _Visited(threshold)
        for batch in batches:
            frame, cls = (batch.column(c).to_numpy(zero_copy_only=False) for c in _GROUP)
            seq = batch.column("det_seq").to_numpy().astype(np.int64)
            boxes = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in schemas.BOX_COLUMNS])
            starts = np.flatnonzero(np.r_[True, (frame[1:] != frame[:-1]) | (cls[1:] != cls[:-1])]) if len(seq) else []
            for a, b in zip(starts, [*starts[1:], len(seq)], strict=True):
                if (frame[a], cls[a]) != group:
                    group, visited = (frame[a], cls[a]), _Visited(threshold)
                seq[a:b] = visited.groups(seq[a:b], boxes[:, a:b])
            last = batch.schema.get_field_index("gid")
            yield batch.set_column(last, batch.schema.field(last), pa.array(seq).cast(batch.schema.field(last).type))

    return det.repartition(tasks, *_GROUP).sortWithinPartitions(*_GROUP, "det_seq").mapInArrow(visit, det.schema)


def first_fit(members: Column, threshold: float, by_class: bool) -> Column:
    """Fold an array of detections in visiting order into an array of ``struct<gid, d>``.

    ``by_class`` compares classes too, for arrays that hold more than one.
    """
    def matches(earlier: Column, later: Column) -> Column:
        a, b = Box.field_of(earlier), Box.field_of(later)
        wide = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
        high = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
        shared = wide.cast("bigint") * high
        near = (wide > 0) & (high > 0) & (shared / (a.area + b.area - shared) >= F.lit(threshold))
        return (earlier["class_id"] == later["class_id"]) & near if by_class else near

    def labelled(gid: Column, d: Column) -> Column:
        return F.array(F.struct(gid.alias("gid"), d.alias("d")))

    def visit(done: Column, d: Column) -> Column:
        hits = F.filter(done, lambda e: matches(e["d"], d))
        first = F.array_min(F.transform(hits, lambda e: e["gid"]))
        return F.concat(done, labelled(F.coalesce(first, d["det_seq"]), d))

    # the first detection always founds a group, and often is the only one
    founder = F.get(members, F.lit(0))
    rest = F.slice(members, 2, F.greatest(F.size(members) - 1, F.lit(0)))
    return F.when(
        F.size(members) > 0, F.aggregate(rest, labelled(founder["det_seq"], founder), visit)
    )


def _group_by_fold(det: DataFrame, threshold: float) -> DataFrame:
    # frame_key leads the keys: it decides nearly every comparison when the aggregate has to sort
    frame = [c for c in schemas.FRAME_COLUMNS if c in det.columns and c != "frame_key"]
    keys = [*_GROUP, *frame]
    member = F.struct("det_seq", *(c for c in det.columns if c not in (*keys, "det_seq")))
    return (
        det.repartition("frame_key")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(member)).alias("_members"))
        .select(*keys, F.inline(first_fit(F.col("_members"), threshold, by_class=False)))
        .select(*keys, "gid", "d.*")
    )


def group_limit(det: DataFrame, limit: int = FOLD_ROWS) -> int | None:
    """What to pass as ``limit`` for ``det``: None when no frame and class has more rows than ``limit``.

    One pre-aggregated count. Take it once when a detection table is written, and runs over that
    table build their plans without a job.
    """
    largest = det.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows")).first()[0]
    return None if largest is None or largest <= limit else limit


def _group_large(det: DataFrame, threshold: float, component_rows: int | None = None) -> DataFrame:
    """The same groups for frames of any size.

    Copies of a box share their matches, so matches are found between distinct boxes, by joins. A
    group never leaves a connected component of these matches. A box without any other is done: its
    copies form one group. The components of a frame are independent, and a task visits the
    detections of one of them in order, each in constant time unless it brings an earlier founder.
    Only components of more than ``component_rows`` detections or ``COMPONENT_LINKS`` matches are left to
    ``_group_by_rounds``.
    """
    component_rows = COMPONENT_ROWS if component_rows is None else component_rows
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    solid = (wide > 0) & (high > 0)
    alone = det.filter(~solid).withColumn("gid", F.col("det_seq"))
    det = det.filter(solid)

    boxes = materialise(
        det.groupBy(*_BOX)
        .agg(F.min("det_seq").alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumn("box", F.monotonically_increasing_id())
    )
    meeting = _grid_join(boxes.select(*_BOX, "box"), threshold).filter(F.col("box") < F.col("o_box"))
    match = iou(Box.named(), Box.named("o_")) >= F.lit(threshold)
    links = materialise(meeting.filter(match).select("box", F.col("o_box").alias("to")))
    found = materialise(components(links.select(F.col("box").alias("a"), F.col("to").alias("b"))))
    placed = boxes.join(found.withColumnRenamed("node", "box"), "box", "left")
    linked = links.join(found.withColumnRenamed("node", "box"), "box")
    too_many = lambda df, size, limit: df.groupBy("root").agg(size.alias("_size")).filter(F.col("_size") > limit)
    by_rows = too_many(placed.filter("root IS NOT NULL"), F.sum("copies"), component_rows)
    giant = materialise(by_rows.union(too_many(linked, F.count("*"), COMPONENT_LINKS)).select("root").distinct())
    placed = materialise(placed.join(broadcast_if_small(giant.withColumn("giant", F.lit(True))), "root", "left"))

    at = broadcast_if_small(placed.select(*_BOX, "box", "first", "root", "giant"))
    rows = det.join(at, _BOX)
    single = rows.filter("root IS NULL").withColumn("gid", F.col("first")).select(*alone.columns)
    joined = rows.filter("root IS NOT NULL AND giant IS NULL").select(*det.columns, "box", "root")
    edges = linked.join(broadcast_if_small(giant), "root", "left_anti")
    output = T.StructType([*det.schema.fields, T.StructField("gid", det.schema["det_seq"].dataType)])
    visited = joined.groupBy("root").cogroup(edges.groupBy("root")).applyInPandas(_visit, output)
    done = alone.unionByName(single).unionByName(visited.select(*alone.columns))
    if giant.isEmpty():
        return done
    rest = rows.filter("giant").select(*det.columns)
    return done.unionByName(_group_by_rounds(rest, threshold))


def _visit(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Groups of one component: ``rows`` with their ``box``, and the pairs of boxes that match."""
    matching = defaultdict(list)
    for a, b in zip(links["box"].tolist(), links["to"].tolist(), strict=True):
        matching[a].append(b)
        matching[b].append(a)
    rows = rows.sort_values("det_seq")
    earliest: dict[int, int] = {}  # by box: the least group among the detections so far that match it
    told: dict[int, int] = {}  # by box: the least group among its own copies so far
    groups = []
    for seq, box in zip(rows["det_seq"].tolist(), rows["box"].tolist(), strict=True):
        gid = earliest.get(box, seq)
        if gid < told.get(box, gid + 1):
            told[box] = gid
            for other in (box, *matching[box]):
                if gid < earliest.get(other, gid + 1):
                    earliest[other] = gid
        groups.append(gid)
    return rows.drop(columns=["box", "root"]).assign(gid=groups)


def _group_by_rounds(det: DataFrame, threshold: float) -> DataFrame:
    """The same groups by joins alone, in as many rounds as the longest chain of matches has steps.

    Unrolled, the recurrence says: gid(d) is the smallest detection from which d can be reached by
    matches of ever later ``det_seq``; that one is always a founder, with no earlier match at all.
    Copies of a box share their matches, so the search runs over distinct boxes: a label
    ``(box, since, founder)`` says every copy of ``box`` after ``since`` is reached by ``founder``.
    A label passes to each matching box, there ``since`` its earliest reached copy. Per box only
    labels that improve on the earlier ones stay; rounds end when none is new.
    """
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    solid = (wide > 0) & (high > 0)
    alone = det.filter(~solid).withColumn("gid", F.col("det_seq"))
    det = det.filter(solid)

    boxes = materialise(
        det.groupBy(*_BOX)
        .agg(F.min("det_seq").alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumn("box", F.monotonically_increasing_id())
    )
    shape = boxes.select(*_BOX, "box", "first")
    meeting = _grid_join(shape, threshold).filter(F.col("box") != F.col("o_box"))
    match = iou(Box.named(), Box.named("o_")) >= F.lit(threshold)
    links = materialise(
        meeting.filter(match).select(
            "box", "first", F.col("o_box").alias("to"), F.col("o_first").alias("to_first")
        )
    )
    repeated = materialise(
        det.join(broadcast_if_small(boxes.filter(F.col("copies") > 1).select(*_BOX, "box")), _BOX)
        .select("box", "det_seq")
    )

    follower = links.filter(F.col("first") < F.col("to_first")).select(F.col("to").alias("box"))
    known = boxes.join(follower, "box", "left_anti").select(
        "box",
        (F.col("first") - 1).alias("since"),
        F.col("first").alias("founder"),
        F.col("first").alias("reached"),
    )
    known = fresh = materialise(known)
    rounds = 0
    while not fresh.isEmpty():
        offered = materialise(_news(_offers(fresh, links), known))
        at_first = offered.filter(F.col("since") < F.col("to_first"))
        between = broadcast_if_small(offered.filter(F.col("since") > F.col("to_first")))
        later_copy = (
            repeated.join(between, "box")
            .filter(F.col("det_seq") > F.col("since"))
            .groupBy(*offered.columns)
            .agg(F.min("det_seq").alias("reached"))
        )
        fresh = at_first.withColumn("reached", F.col("to_first")).unionByName(later_copy)
        fresh = materialise(fresh.drop("to_first"))
        known, rounds = known.unionByName(fresh), rounds + 1
        if rounds % 8 == 0:  # drops what newer labels cover, and ends the growth of the plan
            known = materialise(_improving(known))
    known = materialise(_improving(known))

    next_label = Window.partitionBy("box").orderBy("since")
    spans = (
        known.withColumn("until", F.coalesce(F.lead("since").over(next_label), F.lit(_TO_END)))
        .join(boxes.select(*_BOX, "box"), "box")
        .select(*_BOX, "since", "until", F.col("founder").alias("gid"))
    )
    reached = (
        det.join(broadcast_if_small(spans), _BOX)
        .filter((F.col("det_seq") > F.col("since")) & (F.col("det_seq") <= F.col("until")))
        .select(*alone.columns)
    )
    return alone.unionByName(reached)


def _offers(fresh: DataFrame, links: DataFrame) -> DataFrame:
    """Labels passed on to matching boxes, per box and founder the one that reaches it first."""
    return (
        fresh.join(links.select("box", "to", "to_first"), "box")
        .groupBy(F.col("to").alias("box"), "to_first", "founder")
        .agg(F.min("reached").alias("since"))
    )


def _news(offered: DataFrame, known: DataFrame) -> DataFrame:
    """The offers that no known label of the box already covers."""
    covering = known.select("box", F.col("founder").alias("_f"), F.col("since").alias("_s"))
    covered = (F.col("_f") <= F.col("founder")) & (F.col("_s") <= F.col("since"))
    return (
        offered.join(covering, "box", "left")
        .groupBy(*offered.columns)
        .agg(F.bool_or(covered).alias("_covered"))
        .filter(~F.coalesce("_covered", F.lit(False)))
        .drop("_covered")
    )


def _improving(labels: DataFrame) -> DataFrame:
    """Per box, the labels whose founder is earlier than that of every label with less ``since``."""
    before = (
        Window.partitionBy("box")
        .orderBy("since", "founder")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    best = F.min("founder").over(before)
    return (
        labels.withColumn("_best", best)
        .filter(F.col("_best").isNull() | (F.col("founder") < F.col("_best")))
        .drop("_best")
    )


# --- consensus -------------------------------------------------------------------------------


def consensus(
    grouped: DataFrame, params: Params = Params(ensemble=True), names: bool = True
) -> DataFrame:
    """Merge each group with enough distinct models into one detection.

    Truncated mean box, highest confidence, the founder's class and, where ``grouped`` has names, the
    founder's ``class_name``. Models are counted by flags, one per known model, so without ``names`` the
    aggregate is a plain hash aggregate of fixed-width buffers, and names come from the known lists.
    """
    own_names = names and "class_name" in grouped.columns
    model = F.col("model_source")
    flags = [F.max(F.when(model == m, 1).otherwise(0)).alias(f"_{m}") for m in MODELS]
    founder = F.col("det_seq") == F.col("gid")
    rank = F.array_position(F.array(*(F.lit(m) for m in MODELS)), model)
    frame = [c for c in schemas.FRAME_COLUMNS if c in grouped.columns]
    votes = reduce(add, (F.col(f"_{m}") for m in MODELS))
    voters = F.concat_ws(",", *(F.when(F.col(f"_{m}") == 1, m) for m in sorted(MODELS)))
    founder_model = F.get(F.array(*(F.lit(m) for m in MODELS)), F.col("_founder") - 1)
    return (
        grouped.groupBy("frame_key", "gid", "class_id", *(c for c in frame if c != "frame_key"))
        .agg(
            *(truncated(F.avg(c)).alias(c) for c in schemas.BOX_COLUMNS),
            F.max("confidence").alias("confidence"),
            F.max(F.when(founder, rank)).alias("_founder"),
            F.count(F.lit(1)).alias("members"),
            *flags,
            *([F.max(F.when(founder, F.col("class_name"))).alias("_name")] if own_names else []),
        )
        .withColumn("votes", votes)
        .filter(F.col("votes") >= F.lit(params.effective_threshold))
        .select(
            *frame,
            "gid",
            *schemas.BOX_COLUMNS,
            "confidence",
            "class_id",
            (F.col("_name") if own_names else classes.class_name(founder_model, F.col("class_id"))).alias("class_name"),
            F.concat(F.lit("ensemble("), voters, F.lit(")")).alias("model_source"),
            "votes",
            "members",
        )
    )


def ensemble(
    det: DataFrame,
    params: Params = Params(ensemble=True),
    limit: int | None = FOLD_ROWS,
    sized_by: DataFrame | None = None,
    names: bool = True,
) -> DataFrame:
    """Chosen models' detections to consensus detections; ``gid`` gives their order."""
    wanted = [*schemas.DETECTIONS.names, *(["class_name"] if names else [])]
    needed = [c for c in wanted if c in det.columns]
    chosen = model_subset(det.select(*needed), params.active_models)
    if sized_by is not None:
        sized_by = model_subset(sized_by, params.active_models)
    return consensus(vote_groups(chosen, params, limit, sized_by), params, names)
