"""Find benchmark items in documents, re-parameterised ones too.

Numbers, names and units become typed placeholders. Windows of the resulting templates are joined
with those of the benchmark; within a window, what the item has alike must be alike in the document.

A text is read in three ways, as a capital tells a name only within a sentence and only in texts of
mixed case: with a word that begins a sentence as a word, with it as a name, and without names. A
window that matches in one way is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelsift.llm.bloom import Bloom
from reelsift.llm.common import packed, ship
from reelsift.operators.skew import broadcast_if_small
from reelsift.session import materialise

OUTPUTS = ("items", "cover", "contaminated")
WINDOW = 8  # template words
FEWEST = 5  # template words of an item that can be told from chance
COVER = 0.3  # share of an item's windows that a document must hold
FILTER_HASHES = 1 << 23  # of the filter sent to all tasks: 16 MB; more windows only let more through

KNOWN_WORDS = 250_000  # that a Python worker remembers from batch to batch
SLICE_BYTES = 1 << 22  # of texts handled at once; a longer text is handled by itself

WORD, NUMBER, UNIT, NAME = range(4)
PLACEHOLDER = {NUMBER: "<number>", UNIT: "<unit>", NAME: "<name>"}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…–—¿¡"
UNITS = frozenset(
    "mm cm m km mg g kg t ml cl l s sec min h ms hz khz mhz ghz w kw mw v a pa k kb mb gb tb "
    "inch inches foot feet yard yards mile miles ounce ounces pound pounds gallon gallons litre litres "
    "liter liters metre metres meter meters kilometre kilometres kilometer kilometers gram grams "
    "kilogram kilograms second seconds minute minutes hour hours day days week weeks month months "
    "year years degree degrees percent dollar dollars euro euros cent cents".split()
)
ORDINALS = ("st", "nd", "rd", "th")
NUMERIC = re.compile(r"[+-]?\d[\d.,:/]*")
GLUED = re.compile(r"([+-]?\d[\d.,:/]*?)([^\W\d_][^\W\d_/]*(?:/[^\W\d_]+)*)")  # 5kg, 10km/h, 3rd

WINDOWS = "id {}, at int, n int, template string, slots array<string>, h long"


def _parts(word: str) -> tuple[tuple[str, int, bool], ...]:
    """Bare words, what each may stand for, and whether a sentence ends after it. None for punctuation."""
    bare = word.strip(PUNCTUATION)
    low = bare.lower()
    low = word if low == word else low  # one string less to remember
    ends = word.rstrip("\"')]}»”’").endswith((".", "!", "?", ":"))
    if not bare:
        return (("", WORD, ends),)
    if NUMERIC.fullmatch(bare):
        return ((low, NUMBER, ends),)
    if glued := GLUED.fullmatch(low):
        if glued[2] in ORDINALS:
            return ((glued[1], NUMBER, ends),)
        unit = all(u in UNITS for u in glued[2].split("/"))
        return ((glued[1], NUMBER, False), (glued[2], UNIT if unit else WORD, ends))
    if low in UNITS:
        return ((low, UNIT, ends),)
    if len(bare) > 1 and bare[0].isupper() and bare[1:].islower():
        return ((low, NAME, ends),)
    return ((low, WORD, ends),)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, text) in slices of about ``SLICE_BYTES``."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1).tolist(), b.num_rows]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if stop > start:
                yield b.slice(start, stop - start)


class _Templates:
    """Templates of the texts of an Arrow array, as arrays over all their words."""

    known: dict[str, tuple[tuple[str, int, bool], ...]] = {}  # per Python worker

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = np.asarray(lists.offsets)
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        names = coded.dictionary.to_pylist()
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        info = [self.known.get(w) or self.known.setdefault(w, _parts(w)) for w in names]
        flat, counts = [p for parts in info for p in parts], np.array([len(parts) for parts in info], np.int64)
        del info, names
        bare = np.array([i[0] for i in flat], object)
        kinds = np.array([i[1] for i in flat], np.int8)
        ends = np.array([i[2] for i in flat], bool)
        hashes = np.array([xxhash.xxh64_intdigest(i[0]) for i in flat], np.uint64)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(texts)), np.diff(offsets))
        if len(flat) > len(counts):  # some words have two parts
            first, of = np.cumsum(counts) - counts, counts[code]
            nth = np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of)
            code, text = np.repeat(first[code], of) + nth, np.repeat(text, of)

        begins = np.ones(len(code), bool)  # a sentence begins with this word
        begins[1:] = ends[code[:-1]] | (text[1:] != text[:-1])
        wordy = np.array([bool(b) for b in bare], bool)[code] if len(code) else np.zeros(0, bool)
        code, text, begins = code[wordy], text[wordy], begins[wordy]  # bare punctuation is no word
        kind = kinds[code]
        after_number = np.zeros(len(code), bool)
        after_number[1:] = (kind[:-1] == NUMBER) & (text[1:] == text[:-1])
        kind[(kind == UNIT) & ~after_number] = WORD
        self.text, self.code, self.bare, self.hashes = text, code, bare, hashes
        self.readings = [np.where((kind == NAME) & no_name, WORD, kind) for no_name in (begins, False, True)]
        self.sizes = np.bincount(text, minlength=len(texts))

    def windows(self, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By reading: kinds of words, where windows of ``width`` words in one text begin, their hashes."""
        n = len(self.code) - width + 1
        if n <= 0:
            return
        whole = np.flatnonzero(self.text[:n] == self.text[width - 1 :])
        for kind in self.readings:
            key = self.hashes[self.code]
            for k in PLACEHOLDER:
                key[kind == k] = np.uint64(k)
            h = np.full(n, width, np.uint64)
            for i in range(width):
                h = h * np.uint64(0x9E3779B97F4A7C15) + key[i : i + n]
                h ^= h >> np.uint64(29)
            yield kind, whole, h[whole]

    def rows(self, ids: list, kind: np.ndarray, at: np.ndarray, width: int, hashes: np.ndarray) -> Iterator[tuple]:
        first = np.concatenate([[0], np.cumsum(self.sizes)])
        for p, h in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
            kinds = kind[p : p + width].tolist()
            bare = self.bare[self.code[p : p + width]].tolist()
            text = int(self.text[p])
            template = " ".join(PLACEHOLDER.get(k, b) for k, b in zip(kinds, bare, strict=True))
            slots = [f"{k}:{b}" for k, b in zip(kinds, bare, strict=True) if k != WORD]
            yield ids[text], p - int(first[text]), int(self.sizes[text]), template, slots, h


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "at", "n", "template", "slots", "h"]
    )


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of the items; one shorter window for an item with fewer words."""
    for b in batches:
        t, rows = _Templates(b.column(1)), []
        ids = b.column(0).to_pylist()
        for width in {min(WINDOW, int(s)) for s in t.sizes if s >= FEWEST}:
            for kind, at, h in t.windows(width):
                fits = np.minimum(t.sizes[t.text[at]], WINDOW) == width
                rows.extend(t.rows(ids, kind, at[fits], width, h[fits]))
        yield _batch(rows, b.column(0).type)


def _filter_of(capacity: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(capacity)
        for b in batches:
            bloom.add(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([bloom.bits.tobytes()], pa.binary())], ["bits"])

    return build


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``id, at, n, template, slots, h`` of the items (item_id, text), written down."""
    ship(benchmark.sparkSession)
    items = packed(benchmark, (), id="item_id", text="text").select("id", "text").filter("id IS NOT NULL")
    schema = WINDOWS.format(items.schema["id"].dataType.simpleString())
    return materialise(items.mapInArrow(_item_windows, schema).distinct())


def item_classes(windows: DataFrame, cover: float = COVER) -> tuple[DataFrame, DataFrame]:
    """Items with the same windows as one class: ``class, items`` and the windows of each class.

    ``pattern`` says of each slot of a window which is the first alike. Of ``total`` windows a document
    must have ``need``; so it has one of the ``total - need + 1`` that are in fewest classes. Those have
    ``seeks``; windows that many items share are not needed to find a candidate.
    """
    alike = windows.withColumn("pattern", F.transform("slots", lambda s: F.array_position("slots", s).cast("int")))
    own = F.transform(F.sort_array(F.collect_set(F.xxhash64("at", "template", "pattern"))), lambda h: h.cast("string"))
    named = materialise(alike.groupBy("id", "n").agg(F.md5(F.array_join(own, ",")).alias("class")))
    classes = named.groupBy("class", "n").agg(F.array_sort(F.collect_set("id")).alias("items"), F.min("id").alias("least"))
    total = F.greatest(F.col("n") - (WINDOW - 1), F.lit(1))
    first = materialise(classes.select("class", "n", F.col("least").alias("id")))
    each = alike.join(first, ["id", "n"]).select("class", F.col("at").alias("item_at"), total.alias("total"), "template", "pattern").distinct()
    each = materialise(each)
    shared = each.groupBy("template").agg(F.count_distinct("class").alias("shared"))
    places = each.join(shared, "template").groupBy("class", "item_at", "total").agg(F.max("shared").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("class").orderBy("shared", "item_at"))
    need = F.ceil(F.col("total") * F.lit(cover) - F.lit(1e-9))
    seeks = places.withColumn("seeks", rank <= F.col("total") - F.greatest(need, F.lit(1)) + 1).select("class", "item_at", "seeks")
    return materialise(classes.select("class", "items")), materialise(each.join(seeks, ["class", "item_at"]))


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER
) -> DataFrame:
    """``_id``, ``items`` (ids in order), ``cover`` (of the item held best) of documents that hold an item.

    A document holds an item if it has at least ``cover`` of the item's windows. It has a window if words
    are the same and numbers, names and units that are alike in the item's window are so in its own.

    Items shorter than ``FEWEST`` words cannot be told from chance and match nothing, nor do items
    without id. Null and empty texts hold nothing. Rows with one id are one document.
    """
    spark = docs.sparkSession
    windows = item_windows(benchmark)
    capacity = min(windows.count(), FILTER_HASHES)
    build = windows.select("h").coalesce(8).mapInArrow(_filter_of(capacity), "bits binary")
    bits = Bloom(capacity).bits
    for row in build.toLocalIterator():
        bits |= np.frombuffer(row["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(bits)
    shorter = sorted({min(r["n"], WINDOW) for r in windows.filter(F.col("n") < WINDOW).select("n").distinct().collect()})

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(capacity, sent.value)
        for b in _slices(batches):
            t, rows = _Templates(b.column(1)), []
            ids = b.column(0).to_pylist()
            for width in (*shorter, WINDOW):
                for kind, at, h in t.windows(width):
                    near = bloom.has(h)
                    rows.extend(t.rows(ids, kind, at[near], width, h[near]))
            if rows:
                yield _batch(rows, b.column(0).type)

    rows = packed(docs, (), id=id_col, text=text_col).select("id", "text")
    found = rows.mapInArrow(hits, WINDOWS.format(rows.schema["id"].dataType.simpleString()))
    classes, each = item_classes(windows, cover)
    found = materialise(found.select(F.col("id").alias("_id"), "template", "slots").distinct())
    seeking = broadcast_if_small(each.filter("seeks").select("class", "template").distinct())
    candidates = materialise(found.select("_id", "template").join(seeking, "template").select("_id", "class").distinct())
    wanted = candidates.withColumnRenamed("_id", "_of")
    near = found.join(wanted, F.col("_id").eqNullSafe(F.col("_of"))).drop("_of")
    same = F.forall(F.zip_with("pattern", "slots", lambda p, v: F.element_at("slots", p) == v), lambda x: x)
    held = (
        near.join(broadcast_if_small(each), ["class", "template"])
        .filter(same)
        .groupBy("_id", "class")
        .agg((F.count_distinct("item_at") / F.first("total")).alias("cover"))
        .filter(F.col("cover") >= cover)
    )
    named = held.join(broadcast_if_small(classes), "class").select("_id", "cover", F.explode("items").alias("item"))
    return named.groupBy("_id").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("cover").alias("cover"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """``docs`` with ``items``, ``cover`` and ``contaminated``; see ``leaks``. Their names win a clash."""
    found = broadcast_if_small(materialise(leaks(docs, benchmark, cover=cover)).withColumnRenamed("_id", "_of"))
    rows = packed(docs, OUTPUTS, _id="doc_id")
    return rows.join(found, F.col("_id").eqNullSafe(F.col("_of")), "left").select(
        "_row.*",
        F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"),
        F.coalesce("cover", F.lit(0.0)).alias("cover"),
        F.col("items").isNotNull().alias("contaminated"),
    )
