"""Ranked lexical search without random access (NRA).

The documents of a shard are reached through one list of postings for each term, sorted by impact. All
lists are read in step, from the highest impacts down, and nothing is ever looked up by document. What
has been read of a document bounds its score from below; with the impacts that its other lists still
offer it is bounded from above. An item is read for until every document that can still be among its
first has a closed interval. Shards keep their best, whose last score lets the next shards stop early.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelsift.llm.common import packed, ship
from reelsift.operators.skew import broadcast_if_small
from reelsift.session import materialise

FIRST = 50
BLOCK_ITEMS, BLOCK_BYTES = 512, 1 << 18  # items that are searched for at once, on average
SHARD_BYTES, SHARD_DOCS = 1 << 25, 8192  # of the intervals of a shard
SLICE_BYTES = 1 << 22
ROUNDS = 8  # parts a shard's postings are read in
TESTED = 16  # times as many open documents as are asked for are tested list by list
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Letters, digits and what is not ASCII, in UTF-8; A-Z lower-cased."""
    return text.translate(_TERMS).split()


class Asked:
    """A block of items: their distinct terms, numbered."""

    def __init__(self, texts: list[str]) -> None:
        self.number: dict[bytes, int] = {}
        self.terms = [
            np.array(sorted({self.number.setdefault(t, len(self.number)) for t in terms_of(x.encode())}), np.int64)
            for x in texts
        ]
        self.items: list[list[int]] = [[] for _ in self.number]
        for item, terms in enumerate(self.terms):
            for t in terms.tolist():
                self.items[t].append(item)


def _profile(number: dict[bytes, int]):
    """Of each text the number of terms, and how often it has each term asked for."""

    def counted(ids: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
        words = [terms_of(t or b"") for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        term = np.fromiter((t for w in words for t in map(number.get, w, repeat(-1))), np.int64, sizes.sum())
        key = (np.repeat(np.arange(len(texts)), sizes) * len(number) + term)[term >= 0]
        key, times = np.unique(key, return_counts=True)
        ends = np.searchsorted(key, np.arange(len(texts) + 1) * len(number)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((key % len(number)).astype(np.int32), times)]
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes), *lists], ["id", "n", "terms", "times"])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.cumsum([0, *(x or 0 for x in pc.binary_length(b.column(1)).to_pylist())]) // SLICE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if z > a:
                    yield counted(b.column(0).slice(a, z - a), b.column(1).slice(a, z - a).to_pylist())

    return profile


class Shard:
    """Score intervals of some documents for all items of a block."""

    def __init__(self, asked: Asked, weights: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int) -> None:
        order = np.lexsort([-impact, term])
        self.asked, self.weights, self.doc, self.impact = asked, weights, doc[order], impact[order]
        ends = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.next, self.end = ends[:-1].copy(), ends[1:]
        self.low = np.zeros((len(asked.terms), docs), np.int64)
        unread = np.array([weights[t].sum() for t in asked.terms], np.int64)
        self.unread = np.repeat(unread[:, None], docs, axis=1)  # weight of the terms not read of a document
        self.seen = np.zeros((len(weights), docs), bool)

    def read(self, term: int, floor: int, items: list[int]) -> None:
        """The rest of a list down to impacts of ``floor``, for these items."""
        a, z = self.next[term], self.end[term]
        b = a + np.searchsorted(-self.impact[a:z], -floor, "right")
        if a == b:
            return
        docs, weight, of = self.doc[a:b], self.weights[term], np.array(items)
        at = np.ix_(of, docs)
        self.low[at] += weight * self.impact[a:b]
        self.unread[at] -= weight
        self.seen[term, docs] = True
        self.next[term] = b

    def best(self, k: int, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Item, documents and exact scores: all that may be among the first ``k``.

        ``floors`` has the least scores of interest. What scores less is left out.
        """
        steps = np.quantile(self.impact, np.arange(ROUNDS - 1, 0, -1) / ROUNDS).astype(np.int64).tolist() if len(self.impact) else []
        open_items, of_term = set(range(len(self.low))), self.asked.items
        for floor in (*steps, 0):
            for term, items in enumerate(of_term):
                if items and self.next[term] < self.end[term]:
                    self.read(term, floor, items)
            more = self.next < self.end
            offered = np.where(more, self.impact[np.minimum(self.next, len(self.impact) - 1)], 0) if len(self.impact) else np.zeros(len(more), np.int64)
            done = []
            for item in open_items:
                closed = self._closed(item, k, int(floors[item]), offered)
                if closed is not None:
                    done.append(item)
                    yield item, closed, self.low[item, closed]
            if done:
                open_items.difference_update(done)
                of_term = [[i for i in items if i in open_items] for items in of_term]

    def _closed(self, item: int, k: int, floor: int, offered: np.ndarray) -> np.ndarray | None:
        """The documents that may be among the first, if all their intervals are closed."""
        terms, low = self.asked.terms[item], self.low[item]
        if len(low) > k:
            floor = max(floor, int(np.partition(low, len(low) - k)[len(low) - k]))
        floor = max(floor, 1)
        most = int(offered[terms].max(initial=0))
        may = np.flatnonzero(low + most * self.unread[item] >= floor)
        if not most:
            return may
        if len(may) > TESTED * k:
            return None
        rest = (self.weights[terms] * offered[terms]) @ ~self.seen[np.ix_(terms, may)]
        may, rest = may[low[may] + rest >= floor], rest[low[may] + rest >= floor]
        return None if rest.any() else may


def _search(asked: Asked, weights: np.ndarray, texts: int, words: int, k: int, shard_docs: int):
    """The task's best documents for each item; ids keep their type."""

    def scored(ids: pa.Array, n: np.ndarray, lists: tuple, floors: np.ndarray) -> pa.Table:
        ends, term, times = lists
        m = 50 + 50 * n * texts // words
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        impact = 1_000_000_000 * times // (1000 * times + 20 * m[doc])
        found = list(Shard(asked, weights, doc, term, impact, len(n)).best(k, floors))
        item = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int32)
        at, score = (np.concatenate([np.zeros(0, np.int64), *(f[c] for f in found)]) for c in (1, 2))
        return pa.table({"item": item, "id": ids.take(pa.array(at)), "score": score})

    def kept(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The first ``k`` rows of each item, and the score of the last where there are so many."""
        rows = rows.take(pc.sort_indices(rows, [("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end"))
        item = rows["item"].to_numpy()
        place = np.arange(len(item)) - np.searchsorted(item, item)
        rows = rows.filter(pa.array(place < k))
        floors = np.zeros(len(asked.terms), np.int64)
        last = rows.filter(pa.array(place[place < k] == k - 1))
        floors[last["item"].to_numpy()] = last["score"].to_numpy()
        return rows, floors

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, floors = None, np.zeros(len(asked.terms), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, shard_docs):
                s = b.slice(at, shard_docs)
                ends = s.column(2).offsets.to_numpy().astype(np.int64)
                term, times = (s.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                found = scored(s.column(0), s.column(1).to_numpy(), (ends - ends[0], term, times), floors)
                best, floors = kept(found if best is None else pa.concat_tables([best, found]))
        if best is not None:
            yield from best.combine_chunks().to_batches()

    return search


def _of_block(docs: DataFrame, texts: list[str], k: int) -> DataFrame | None:
    """``item, id, score, place`` of the first documents, items by their number in ``texts``."""
    spark, asked = docs.sparkSession, Asked(texts)
    if not asked.number:
        return None
    kind = docs.schema["id"].dataType.simpleString()
    profiles = materialise(docs.mapInArrow(_profile(asked.number), f"id {kind}, n long, terms array<int>, times array<long>"))
    rows, filled, words = profiles.agg(F.count("*"), F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not filled:
        return None
    weights = np.zeros(len(asked.number), np.int64)
    for term, df in profiles.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # terms asked for
        weights[term] = math.floor(1000 * math.log((2 * filled + 2) / (2 * df + 1)))
    shard_docs = max(16, min(SHARD_DOCS, SHARD_BYTES // (16 * len(texts) + len(asked.number))))
    search = _search(asked, weights, filled, words, k, shard_docs)
    found = profiles.coalesce(-(-rows // shard_docs)).mapInArrow(search, f"item int, id {kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return materialise(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k))


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = FIRST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents for each item, of all documents.

    Scores are those of a saturating term frequency with the document's length, in whole numbers. They are
    exact, and equal ones come by ascending id, null last. Documents that score 0 are not given, so null and
    empty texts never are; null and empty items find nothing. Rows that share an id are documents of their
    own, rows of items with one text or id as well. Empty tables give no rows. Other columns are not read.

    Items are searched for in blocks, each of which reads all documents once. The terms of a block and
    their counts are all that is sent to the tasks.
    """
    spark = docs.sparkSession
    ship(spark)
    given = packed(items, (), item_id=item_col, text=item_text_col).select("item_id", "text").filter("text IS NOT NULL")
    texts = materialise(given.select("text").distinct())
    rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-rows // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    narrow = packed(docs, (), id=id_col, text=text_col).select("id", F.col("text").cast("string").cast("binary").alias("text"))
    kind = narrow.schema["id"].dataType
    out = spark.createDataFrame([], f"item_id {given.schema['item_id'].dataType.simpleString()}, rank int, doc_id {kind.simpleString()}, score long")
    for block in range(blocks):
        asked = [r["text"] for r in texts.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()]
        found = _of_block(narrow, asked, k)
        if found is None:
            continue
        numbered = spark.createDataFrame(list(enumerate(asked)), "item int, text string")
        named = given.join(F.broadcast(numbered), "text").select("item", "item_id")  # of BLOCK_BYTES
        ranked = broadcast_if_small(found).join(named, "item")
        out = out.unionByName(ranked.select("item_id", F.col("place").alias("rank"), F.col("id").alias("doc_id"), "score"))
    return out
