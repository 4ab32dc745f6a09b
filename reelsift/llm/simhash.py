"""SimHash near-duplicates found by one-wildcard segment variants.

Fingerprints that differ in two bits at most agree in one of two halves up to one bit. Each
half is therefore indexed once per bit position with that bit left out; equal variants join, and
whole fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelsift.llm.common import ascii_lower, let, packed, ship, words
from reelsift.llm.components import components
from reelsift.operators.skew import broadcast_if_small
from reelsift.session import materialise

OUTPUTS = ("fingerprint", "component_id")
HALF = 32
USUAL, USUAL_SHINGLES = 8, 1 << 18  # counted texts from which on a shingle comes last, and the most such shingles
USUAL_DOCS, USUAL_STEP = 50_000, 16  # texts counted at the least, beyond which one in so many is
HOT_HALF = 128  # fingerprints with one half in common from which on the other half is indexed too


def shingles(text: Column, width: int) -> Column:
    """Word n-grams of a text with repeats, space-joined; all words if there are fewer; none for none."""

    def grams(w: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(1), F.size(w) - (width - 1)),
            lambda i: F.concat_ws(" ", *(F.element_at(w, i + k) for k in range(width))),
        )
        return F.when(F.size(w) >= width, many).when(F.size(w) > 0, F.array(F.array_join(w, " ")))

    return let(words(text), grams)


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``copies``, ``fp`` (long): one row per id and different text.

    The 64 counts of a document are kept two to a long, so a shingle costs 32 additions in
    generated code, summed before the one shuffle. A text without words has fingerprint zero.
    """
    rows = packed(docs, (), _id=id_col, _text=text_col).select("_id", "_text", F.xxhash64("_text").alias("_of"))
    each = rows.select("_id", "_of", F.posexplode_outer(shingles(ascii_lower(F.col("_text")), width)).alias("at", "gram"))
    hashed = each.select("_id", "_of", "at", F.when(F.col("gram").isNotNull(), F.xxhash64("gram")).alias("h"))
    both = F.lit((1 << HALF) + 1)
    counted = hashed.groupBy("_id", "_of").agg(
        F.count("h").alias("n"),
        F.count_if(F.coalesce(F.col("at"), F.lit(0)) == 0).alias("copies"),
        *(F.sum(F.shiftright("h", i).bitwiseAND(both)).alias(f"s{i}") for i in range(HALF)),
    )

    def bit(i: int) -> Column:
        low = F.col(f"s{i % HALF}").bitwiseAND(F.lit((1 << HALF) - 1))
        count = low if i < HALF else F.shiftrightunsigned(f"s{i % HALF}", HALF)
        return F.when(count * 2 > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))

    fp = reduce(lambda a, b: a.bitwiseOR(b), (bit(i) for i in range(64)))
    return counted.select("_id", "copies", fp.alias("fp"))


def _half(fp: Column, side: Column) -> Column:
    low = fp.bitwiseAND(F.lit((1 << HALF) - 1))
    return F.when(side == 0, low).otherwise(F.shiftrightunsigned(fp, HALF))


def _one_bit_off(side: Column, place: Column) -> Column:
    """The key of a half without the bit at ``place``: side, place and the other 31 bits."""
    mask = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return F.struct((side * HALF + place).alias("slot"), F.col("half").bitwiseAND(mask).alias("rest"))


def links(prints: DataFrame, hot: int = HOT_HALF) -> DataFrame:
    """Pairs ``a`` < ``b`` of different fingerprints ``fp`` with at most two differing bits, once each.

    A half that more than ``hot`` fingerprints share would make a bucket of as many. There the other
    half joins in as well, together with its 32 one-bit changes: two halves at most two bits apart
    meet in one of these, and no bucket can hold more than 66 fingerprints.

    The index has 64 rows and more for each fingerprint, but Spark takes an explode to give one, so the join is
    told not to broadcast it.
    """
    places = F.explode(F.sequence(F.lit(0), F.lit(HALF - 1))).alias("place")
    halves = prints.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).withColumn(
        "half", _half(F.col("fp"), F.col("side"))
    )
    keyed = halves.select("fp", "side", "half", places).select(
        "fp", "side", _one_bit_off(F.col("side"), F.col("place")).alias("key")
    )
    crowded = materialise(halves.groupBy("side", "half").count().filter(F.col("count") > hot))
    sparse, dense = keyed.select("fp", "key"), None
    if not crowded.isEmpty():
        keys = crowded.select("side", "half", places).select(
            _one_bit_off(F.col("side"), F.col("place")).alias("key")
        )
        keys = broadcast_if_small(materialise(keys.distinct()))  # written, so that Spark knows its size
        sparse = keyed.join(keys, "key", "left_anti").select("fp", "key")
        other = _half(F.col("fp"), 1 - F.col("side"))
        flips = F.transform(
            F.sequence(F.lit(-1), F.lit(HALF - 1)),
            lambda i: F.when(i < 0, other).otherwise(
                other.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(i, F.lit(0))))
            ),
        )
        dense = keyed.join(keys, "key", "left_semi").select(
            "fp", F.explode(flips).alias("near"), "key"
        ).select("fp", F.struct("key.slot", "key.rest", "near").alias("key"))

    def pairs(index: DataFrame) -> DataFrame:
        left = index.select(F.col("fp").alias("a"), "key")
        right = index.select(F.col("fp").alias("b"), "key")
        off = F.col("a").bitwiseXOR(F.col("b"))
        low, high = off.bitwiseAND(F.lit((1 << HALF) - 1)), F.shiftrightunsigned(off, HALF)
        # of the slots a pair shares, only the first reports it
        first = (
            F.when(low == 0, F.lit(0))
            .when(F.bit_count(low) == 1, F.bit_count(low - 1))
            .when(high == 0, F.lit(HALF))
            .otherwise(HALF + F.bit_count(high - 1))
        )
        near = (F.col("a") < F.col("b")) & (F.bit_count(off) <= 2) & (F.col("key.slot") == first)
        return left.join(right.hint("merge"), "key").filter(near).select("a", "b")

    found = pairs(sparse)
    return found if dense is None else found.union(pairs(dense).distinct())


def simhash_components(
    docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``: the smallest id reachable over links.

    Equal fingerprints are one node, so copies cost one row each and no pairs. Null and empty texts
    and texts of white space have fingerprint zero and link like others. Null ids keep their row and
    never name a component, unless it has no other id: then it is null. Rows that repeat an id give
    a row each. Only ids and texts are read, so other columns cannot clash.
    """
    prints = materialise(fingerprints(docs, width, id_col, text_col))
    nodes = prints.groupBy("fp").agg(F.min("_id").alias("least"))
    found = components(links(nodes.select("fp")))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialise(rooted)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    each = prints.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.join(named, "fp").select(
        F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# --- near copies by likeness ---------------------------------------------------------------------


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """A hash for each word of all texts, A-Z lower-cased, and whose it is."""
    low = pc.ascii_lower(pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(low)
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    names = [w.encode() for w in coded.dictionary.to_pylist()]
    hashes = np.array([xxhash.xxh64_intdigest(w, 7) for w in names], np.uint64)
    real = np.array([bool(w) for w in names], bool)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    if len(code):
        owner, code = owner[real[code]], code[real[code]]
    return hashes[code], owner, len(texts)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _runs(word: np.ndarray, owner: np.ndarray, texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each text, of all its words if there are fewer; and whose."""
    sizes = np.bincount(owner, minlength=texts)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    padded = np.concatenate([word, np.zeros(width, np.uint64)])
    own = np.concatenate([owner, np.full(width, -1)])
    h = np.zeros(len(word), np.uint64)
    for k in range(width):
        inside = own[k : k + len(word)] == owner
        h = np.where(inside, _mixed(h + padded[k : k + len(word)] + np.uint64(1)), h)
    place = np.arange(len(word)) - first[owner]
    keep = (place <= sizes[owner] - width) | (place == 0)
    return h[keep], owner[keep]


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The different shingles of each text as hashes in order, and whose they are."""
    gram, of = _runs(*(found := _tokens(texts)), width)
    order = np.lexsort((gram, of))
    gram, of = gram[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (gram[1:] != gram[:-1])
    return gram[new], of[new], found[2]


def _lists(values: np.ndarray, of: np.ndarray, texts: int) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=texts))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _counted(width: int):
    """Shingles and in how many of the texts at hand each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram, n = np.unique(_sets(b.column(2), width)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], ["gram", "n"])

    return run


def _usual(rows: DataFrame, width: int) -> np.ndarray:
    """Shingles of many texts, sorted. Which they are decides how many texts meet, never which links are found."""
    step = max(1, min(USUAL_STEP, rows.count() // USUAL_DOCS))
    some = rows.filter(F.pmod(F.xxhash64("node"), F.lit(step)) == 0)
    counts = some.mapInArrow(_counted(width), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    most = counts.filter(F.col("n") >= USUAL).orderBy(F.desc("n"), "gram").limit(USUAL_SHINGLES).select("gram")
    return np.sort(most.toArrow().column(0).to_numpy().view(np.uint64))


def _describe(width: int, least: float, usual: np.ndarray):
    """Per text: how many different shingles it has, those it must share one of with any text alike, and all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 250):
                b = whole.slice(start, 250)
                gram, of, n = _sets(b.column(2), width)
                short = (gram >> np.uint64(32)).astype(np.uint32)
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (short[1:] != short[:-1])
                size = np.bincount(of, minlength=n)
                late = np.isin(gram, usual)
                order = np.lexsort((gram, late, of))
                at = np.arange(len(of)) - (np.cumsum(size) - size)[of]
                kept = at < (size - np.ceil(least * size - 1e-9).astype(np.int64) + 1)[of]
                none = np.flatnonzero(size == 0)  # texts without words share the shingle 0
                head, head_of = np.r_[gram[order][kept], np.zeros(len(none), np.uint64)], np.r_[of[kept], none]
                by_text = np.argsort(head_of, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        b.column(1),
                        pa.array(size.astype(np.int32)),
                        _lists(head[by_text].view(np.int64), head_of[by_text], n),
                        _lists(short[new].view(np.int32), of[new], n),
                    ],
                    ["_id", "node", "n", "heads", "grams"],
                )

    return run


def _alike(prints: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Those of the ``pairs`` ``a``, ``b`` whose sets of shingles are alike, written down."""
    pairs = materialise(pairs)
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = materialise(
        prints.join(broadcast_if_small(involved), "node", "left_semi").groupBy("node").agg(F.first("grams").alias("grams"))
    )
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("f")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("grams").alias("g")), "b"
    )
    common = F.size(F.array_intersect("f", "g"))
    return materialise(both.filter(common >= F.lit(least) * (F.size("f") + F.size("g") - common)).select("a", "b"))


def _may_be_alike(a: str, b: str, least: float) -> Column:
    """Whether two texts whose first common shingle is at ``at`` of ``n`` in each can share enough of them."""
    left = F.least(F.col(f"{a}n") - F.col(f"{a}at"), F.col(f"{b}n") - F.col(f"{b}at"))
    return left * (1 + least) + 1e-6 >= least * (F.col(f"{a}n") + F.col(f"{b}n"))


def _merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """The components ``found`` after ``more`` links ``a``, ``b``, which are taken between roots alone."""
    lifted = more
    for end in "ab":
        root = found.select(F.col("node").alias(end), F.col("root").alias("_to"))
        lifted = lifted.join(root, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    joined = materialise(components(lifted.select("a", "b").distinct()))
    onto = joined.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    moved = found.join(onto, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return moved.union(joined.join(found, "node", "left_anti").select("node", "root"))


def near_copies(
    docs: DataFrame,
    likeness_width: int = 5,
    least: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``component_id``: the smallest id reachable over texts of Jaccard likeness ``least`` or more.

    Likeness is that of the sets of ``likeness_width``-word shingles, verified for each link. Shingles have one
    order, by hash, those of many texts last. Of ``n`` shingles two texts alike share ``least * n`` at the least,
    so they share one of the first ``n - least * n + 1`` of each: no link is missed, however many texts there are.
    Of the texts that have such a shingle in common each meets the least, so a large group makes no pairs
    within. Where these do not all become one group, those of different groups meet each other too.

    Texts that are equal but for the case of A-Z are one node. Texts without words are alike. Null ids
    keep their row and never name a component that has another id.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = packed(docs, (), _id=id_col, _text=text_col).select(
        "_id", F.xxhash64(ascii_lower(F.coalesce("_text", F.lit("")))).alias("node"), "_text"
    )
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, node long, n int, heads array<bigint>, grams array<int>"
    usual = _usual(rows, likeness_width)
    prints = materialise(rows.mapInArrow(_describe(likeness_width, least, usual), schema))
    nodes = prints.groupBy("node").agg(F.min("_id").alias("least"), F.first("n").alias("n"), F.first("heads").alias("heads"))
    nodes = materialise(nodes)
    heads = nodes.select("node", "n", F.posexplode("heads").alias("at", "key"))
    own = F.struct("node", "n", "at")
    of_key = Window.partitionBy("key")
    met = heads.select("key", "node", "n", "at", F.min(own).over(of_key).alias("first"), F.max("node").over(of_key).alias("last"))
    met = materialise(met.filter(F.col("first.node") != F.col("last")).drop("last"))
    pairs = met.filter("node <> first.node").filter(_may_be_alike("", "first.", least))
    linked = _alike(prints, pairs.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct(), least)
    found = materialise(components(linked))
    rest = met.join(found, "node", "left").select("key", "node", "n", "at", "first", F.coalesce("root", "node").alias("root"))
    rest = rest.withColumn("low", F.min("root").over(of_key)).withColumn("high", F.max("root").over(of_key))
    rest = materialise(rest.filter("low <> high and node <> first.node").select("key", "node", "n", "at", "root"))
    if not rest.isEmpty():
        x, y = (rest.select("key", F.struct("node", "n", "at", "root").alias(c)) for c in "xy")
        apart = x.join(y, "key").filter("x.node < y.node and x.root <> y.root").filter(_may_be_alike("x.", "y.", least))
        more = _alike(prints, apart.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), least)
        found = _merged(found, more)
    rooted = materialise(
        nodes.select("node", "least").join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select(
            "node", "least", F.coalesce("root", "node").alias("root")
        )
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("node", "component_id")
    return prints.select("_id", "node").join(named, "node").select(F.col("_id").alias("doc_id"), "component_id")


def _others(found: DataFrame) -> DataFrame:
    """Ids that are not the least of their component, written down."""
    return materialise(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(broadcast_if_small(gone), docs["doc_id"] == F.col("_gone"), "left_anti")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id.

    Groups are those of SimHash. Two bits do not reach all texts that are alike, so the documents SimHash
    leaves are compared by their shingles too (``near_copies``).

    Documents without id stay. Rows with one id are one document and stay or go together.
    """
    gone = _others(simhash_components(docs))
    more = _others(near_copies(_without(docs, gone)))
    return _without(docs, gone.union(more))
