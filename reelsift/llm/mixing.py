"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is a stream of words in blocks of fixed length. Its target fixes how many blocks the
mix draws from it. These quotas are split recursively among the output shards: at every node the
left half of the shards gets a multivariate-hypergeometric share of the node's blocks. A source's
blocks are put in random order by a keyed permutation that needs no sort, so a shard's quota is a
stretch of that order and shards are disjoint. Rows are shuffled within their shard alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelsift.llm.common import BLANK_RUN, let, packed
from reelsift.operators.skew import broadcast_if_small, number_within
from reelsift.session import materialise

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SLICE_ROWS = 2_000  # rows of one source whose offsets one window adds up
ROUNDS = 24  # of the permutation


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _uniform(*key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(1 << 53))


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Where a keyed permutation of 0 … n-1 takes ``x``: swap-or-not (Hoang, Morris, Rogaway 2012)."""

    def swap(at: Column, r: Column) -> Column:
        pivot = F.pmod(F.xxhash64(*key, r), n)
        other = F.pmod(pivot - at, n)
        odd = F.xxhash64(*key, r, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(odd, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, swap)


def hypergeometric(pool: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``pool`` are among its ``good``, by inversion at ``u``.

    Sums the probabilities within 12 standard deviations of the mean; what lies beyond is below the
    precision of a double.
    """
    pool_, good_, draws_ = (c.cast("double") for c in (pool, good, draws))
    mean = draws_ * good_ / F.greatest(pool_, F.lit(1.0))
    spread = mean * (1 - good_ / F.greatest(pool_, F.lit(1.0))) * (pool_ - draws_) / F.greatest(pool_ - 1, F.lit(1.0))
    reach = F.ceil(12 * F.sqrt(F.greatest(spread, F.lit(0.0))) + 12)
    zero = F.lit(0).cast("long")
    least = F.greatest(zero, draws - (pool - good), F.floor(mean) - reach)
    most = F.least(good, draws, F.ceil(mean) + reach)

    def ratio(k: Column) -> Column:
        k = k.cast("double")
        return (good_ - k) * (draws_ - k) / ((k + 1) * (pool_ - good_ - draws_ + k + 1))

    def total(s: Column, k: Column) -> Column:
        w = s["w"] * ratio(k)
        return F.struct(w.alias("w"), (s["sum"] + w).alias("sum"))

    def pick(goal: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            w = s["w"] * ratio(k)
            return F.struct(
                w.alias("w"),
                (s["sum"] + w).alias("sum"),
                (s["x"] + (s["sum"] < goal).cast("long")).alias("x"),
            )

        first = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), least.alias("x"))
        return F.aggregate(F.sequence(least, most - 1), first, step, lambda s: s["x"])

    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"))
    drawn = let(F.aggregate(F.sequence(least, most - 1), start, total, lambda s: s["sum"]) * u, pick)
    return F.when(least >= most, least).otherwise(drawn)


def _split(node: Column, seed: int) -> Column:
    """The quotas that go to the left half of a node's shards, source by source."""
    lo, hi, quotas, left_blocks = (node[f] for f in ("lo", "hi", "quotas", "left_blocks"))
    whole = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)

    def draw(s: Column, i: Column) -> Column:
        good = F.get(quotas, i)
        u = _uniform(F.lit(seed), lo, hi, i)
        return let(
            hypergeometric(s["pool"], good, s["draws"], u),
            lambda x: F.struct(
                (s["pool"] - good).alias("pool"),
                (s["draws"] - x).alias("draws"),
                F.concat(s["left"], F.array(x)).alias("left"),
            ),
        )

    start = F.struct(
        whole.alias("pool"), left_blocks.alias("draws"), F.array().cast("array<bigint>").alias("left")
    )
    return F.aggregate(F.sequence(F.lit(0), F.size(quotas) - 1), start, draw, lambda s: s["left"])


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``shard``, ``quotas`` for one row ``quotas`` (array<long>, blocks by source).

    Shards get equal numbers of blocks, to one; a node holds one number per source.
    """
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
    nodes = quotas.select(
        F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "quotas", total.alias("all_blocks")
    )

    def before(shard: Column) -> Column:
        return F.floor(F.col("all_blocks") * shard / shards)

    depth = (shards - 1).bit_length()
    for _ in range(depth):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        nodes = nodes.select(
            "lo", "hi", mid.alias("mid"), "quotas", "all_blocks",
            (before(mid) - before(F.col("lo"))).alias("left_blocks"),
        )
        left = F.when(F.col("hi") - F.col("lo") > 1, _split(F.struct("lo", "hi", "quotas", "left_blocks"), seed))
        nodes = nodes.select("*", left.alias("left"))
        right = F.zip_with("quotas", "left", lambda q, x: q - x)
        halves = F.array(
            F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("quotas")),
            F.struct(F.col("mid").alias("lo"), "hi", right.alias("quotas")),
        )
        same = F.array(F.struct("lo", "hi", "quotas"))
        nodes = nodes.select(
            "all_blocks", F.explode(F.when(F.col("left").isNull(), same).otherwise(halves)).alias("n")
        ).select("all_blocks", "n.lo", "n.hi", "n.quotas")
    return nodes.select(F.col("lo").alias("shard"), "quotas")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, rows, source_size, nth, weight, target`` from ``_source, size``.

    Sources in order of code points, null last, weigh ``WEIGHTS`` in turn and share all words. No
    target exceeds ``MOST_REPEATS`` times its source; the excess is shared by weight again until none
    does. Only the common factor reaches the driver in each round.
    """
    sums = sizes.groupBy(F.col("_source").alias("source")).agg(
        F.count("*").alias("rows"), F.sum("size").alias("source_size")
    )
    ordered = number_within(
        materialise(sums).withColumn("_all", F.lit(0)), ["_all"], [F.col("source").asc_nulls_last()], "nth"
    )
    cycle = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    known = materialise(
        ordered.select(
            "source", "rows", "source_size", (F.col("nth") - 1).cast("int").alias("nth"),
            F.get(cycle, (F.col("nth") - 1) % len(WEIGHTS)).alias("weight"),
        )
    )
    most = F.col("source_size") * float(MOST_REPEATS)
    factor = -1.0
    while True:
        full = most <= F.lit(factor) * F.col("weight")
        rest, weight = known.agg(
            F.sum("source_size") - F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if not weight or rest / weight <= factor:
            break
        factor = rest / weight
    return known.withColumn("target", F.least(most, F.lit(max(factor, 0.0)) * F.col("weight")))


def _drawing_plan(sizes: DataFrame, block_words: int, shards: int, seed: int) -> DataFrame:
    """Per source how many blocks it has and gives, and where its shards' quotas end."""
    b = F.lit(block_words).cast("long")
    size, seeded = F.col("source_size"), F.lit(seed)
    base = source_targets(sizes).withColumns(
        {
            "wanted": F.least(F.round("target").cast("long"), size * MOST_REPEATS),
            "blocks": F.ceil(size / b).cast("long"),
            "slices": F.ceil(F.col("rows") / SLICE_ROWS),
        }
    )
    empty = F.col("blocks") == 0
    base = base.withColumns(
        {
            "epochs": F.when(empty, F.lit(0)).otherwise(F.floor(F.col("wanted") / F.greatest(size, F.lit(1)))).cast("long"),
            "lacking": F.col("blocks") * b - size,  # words the last block falls short of a full one
            "blocks_": F.greatest("blocks", F.lit(1)),
        }
    ).withColumn("rest", F.when(empty, F.lit(0)).otherwise(F.col("wanted") - F.col("epochs") * size).cast("long"))
    base = base.withColumn(
        "short_slot", permuted(F.col("blocks_") - 1, F.col("blocks_"), seeded, F.col("nth"), F.col("epochs"))
    )
    # slots that give words in the unfinished epoch
    plain = F.ceil(F.col("rest") / b)
    passed = F.ceil((F.col("rest") + F.col("lacking")) / b)
    used = F.when(plain <= F.col("short_slot"), plain).otherwise(F.greatest(passed, F.col("short_slot") + 1))
    base = base.withColumn("used", F.when(F.col("rest") > 0, used).otherwise(0).cast("long"))
    base = materialise(base.withColumn("quota", F.col("epochs") * F.col("blocks") + F.col("used")).drop("blocks_"))

    # one number per source: sources are what the mix is configured by
    quotas = base.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("nth", "quota"))), lambda x: x["quota"]).alias("quotas")
    ).filter(F.size("quotas") > 0)
    leaves = splitting_tree(quotas, shards, seed).select("shard", F.posexplode("quotas").alias("nth", "n"))
    upto = Window.partitionBy("nth").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        leaves.withColumn("end", F.sum("n").over(upto))
        .groupBy("nth")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    )
    return materialise(base.join(ends, "nth"))


def draws(
    docs: DataFrame,
    block_words: int = 1024,
    shards: int = 64,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """What the mix takes of each document, one row per stretch of words.

    ``doc_id, row, of, size, source, source_size, target`` and, null for documents that give nothing,
    ``shard, place`` (order within the shard), ``epoch``, ``first_word`` and ``words``. ``row``
    tells apart rows that repeat, and ``of`` is alike for rows with one id, source and text. The words of a source add up to its target, rounded; no document is
    taken more than ``MOST_REPEATS`` times. All is a function of the rows and ``seed``.

    Null and empty texts have size 0 and give nothing; null is a source of its own. Null ids take part.
    Offsets are summed in slices of a source, so a source with most rows is spread like others.
    """
    sizes = materialise(
        packed(docs, (), _id=id_col, _source=source_col, _text=text_col).select(
            "_id", "_source", word_count(F.col("_text")).alias("size"), _content_key().alias("of")
        )
    )
    plan = _drawing_plan(sizes, block_words, shards, seed)
    small = broadcast_if_small(plan)
    rows = sizes.join(small, F.col("_source").eqNullSafe(F.col("source"))).withColumn(
        "slice", F.pmod(F.xxhash64(F.lit(seed), "_id", "size"), F.col("slices"))
    )
    in_slice = Window.partitionBy("nth", "slice").orderBy("_id", "size", "of")
    so_far = in_slice.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("_id", "of", "size", "nth", "slice").withColumns(
        {"start": F.sum("size").over(so_far) - F.col("size"), "row": F.row_number().over(in_slice)}
    )
    earlier = Window.partitionBy("nth").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("nth", "slice")
        .agg(F.sum("size").alias("words_here"))
        .withColumn("before", F.coalesce(F.sum("words_here").over(earlier), F.lit(0)))
        .drop("words_here")
    )
    b = F.lit(block_words).cast("long")
    placed = (
        local.join(broadcast_if_small(materialise(offsets)), ["nth", "slice"])
        .join(small, "nth")
        .withColumn("start", F.col("start") + F.col("before"))
    )
    first, last = F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)
    pieces = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    # full epochs, then the unfinished one
    drawn = pieces.withColumn(
        "epoch", F.explode_outer(F.when(F.col("block").isNotNull() & (F.col("quota") > 0), F.sequence(F.lit(0).cast("long"), F.col("epochs"))))
    ).withColumn(
        "slot",
        F.when(F.col("epoch").isNotNull(), permuted(F.col("block"), F.col("blocks"), F.lit(seed), F.col("nth"), F.col("epoch"))),
    )
    block_start = F.col("block") * b
    length = F.least(b, F.col("source_size") - block_start)
    at = F.col("slot") * b - F.when(F.col("slot") > F.col("short_slot"), F.col("lacking")).otherwise(0)
    given = F.when(F.col("epoch") < F.col("epochs"), length).otherwise(
        F.greatest(F.lit(0), F.least(length, F.col("rest") - at))
    )
    begin = F.greatest(F.col("start"), block_start)
    end = F.least(F.col("start") + F.col("size"), block_start + given)
    taken = F.greatest(end - begin, F.lit(0))
    place = F.col("epoch") * F.col("blocks") + F.col("slot")
    some = drawn.withColumns({"_words": taken, "_place": place}).withColumn("_some", F.coalesce(F.col("_words") > 0, F.lit(False)))

    def where_taken(c: Column) -> Column:
        return F.when(F.col("_some"), c)

    return some.select(
        F.col("_id").alias("doc_id"), F.struct("slice", "row").alias("row"), "of", "size", "source", "source_size", "target",
        where_taken(F.size(F.filter("ends", lambda e: e <= F.col("_place")))).alias("shard"),
        where_taken(F.xxhash64(F.lit(seed), "nth", "_place")).alias("place"),
        where_taken(F.col("epoch")).alias("epoch"),
        where_taken(begin - F.col("start")).alias("first_word"),
        where_taken(F.col("_words")).alias("words"),
    )


def _content_key() -> Column:
    """Equal for rows with one id, source and text: 128 bits."""
    parts = (p for c in ("_id", "_source", "_text") for p in (F.col(c).isNull().cast("string"), F.col(c).cast("string")))
    return F.md5(F.concat_ws("\n", *parts))


def _by_row(found: DataFrame) -> DataFrame:
    """A row for each row of the documents, with what it gives as ``pieces``, in order.

    A document has a piece for each of its blocks and epochs.
    """
    piece = F.struct("shard", "place", "epoch", "first_word", "words")
    return found.groupBy("doc_id", "row", "of", "size", "source", "source_size", "target").agg(
        F.coalesce(F.sum("words"), F.lit(0)).alias("taken"),
        F.array_sort(F.collect_list(F.when(F.col("words").isNotNull(), piece))).alias("pieces"),
    )


def taken_words(docs: DataFrame, **options: object) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken, shards, places``, a row for each row of ``docs``.

    ``shards`` has ``shard:words`` for each shard that gets words, and ``places`` is a digest of where all of the
    row's pieces lie: shard, place in the shard, epoch, first word and words.
    """
    pieces = F.col("pieces")
    shards = F.array_sort(F.array_distinct(F.transform(pieces, lambda p: p["shard"])))

    def words_of(shard: Column) -> Column:
        own = F.filter(pieces, lambda p: p["shard"] == shard)
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, p: a + p["words"])

    line = lambda p: F.concat_ws(",", *(p[c].cast("string") for c in ("shard", "place", "epoch", "first_word", "words")))
    return _by_row(draws(docs, **options)).select(
        "doc_id", "size", "source", "source_size", "target", "taken",
        F.array_join(F.transform(shards, lambda s: F.concat_ws(":", s.cast("string"), words_of(s).cast("string"))), " ").alias("shards"),
        F.sha2(F.array_join(F.transform(pieces, line), "\n"), 256).alias("places"),
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object
) -> DataFrame:
    """The mix as text: a row for each piece, with the words drawn as its text.

    The columns of ``docs`` (of one of the rows where id, source and text are equal) and ``size, source_size,
    target, taken`` of the row, ``words`` of the piece, and its ``shard``, ``place`` and ``epoch``. A piece is a
    stretch of a document within a block; it is given once for each epoch that takes it. Reading a shard by
    ``place``, ``doc_id``, ``first_word`` gives its shuffled order.

    Each row of ``docs`` gives its own pieces, rows that share an id too.
    """
    outputs = ("size", "source_size", "target", "taken", "words", "shard", "place", "epoch", "first_word")
    found = draws(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).filter("words > 0")
    by_row = materialise(_by_row(found).select("of", "size", "source_size", "target", "taken", "pieces"))
    rows = packed(docs, outputs, _id=id_col, _source=source_col, _text=text_col).withColumn("of", _content_key())
    repeated = materialise(by_row.groupBy("of").count().filter("count > 1").select("of"))
    if not repeated.isEmpty():
        repeated = broadcast_if_small(repeated)
        once = rows.join(repeated, "of", "left_semi").groupBy("of").agg(F.first("_row").alias("_row"), F.first("_text").alias("_text"))
        rows = rows.join(repeated, "of", "left_anti").select("of", "_row", "_text").unionByName(once.select("of", "_row", "_text"))

    def cut(listed: Column) -> Column:
        text = lambda p: F.array_join(F.slice(listed, p["first_word"].cast("int") + 1, p["words"].cast("int")), " ")
        return F.transform("pieces", lambda p: F.struct(*(p[c].alias(c) for c in ("words", "shard", "place", "epoch", "first_word")), text(p).alias("_piece")))

    listed = F.array_remove(F.split("_text", BLANK_RUN), "")
    each = rows.join(by_row.hint("merge"), "of").withColumn("p", F.explode(let(listed, cut)))
    given = [F.col("p._piece").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in rows.schema["_row"].dataType.names]
    return each.select(*given, "size", "source_size", "target", "taken", "p.words", "p.shard", "p.place", "p.epoch", "p.first_word")


def write_mix(docs: DataFrame, path: str, **options: object) -> None:
    """``mixed``, one folder of Parquet per shard, in the shard's shuffled order."""
    (
        mixed(docs, **options)
        .repartition("shard", F.pmod("place", F.lit(16)))
        .sortWithinPartitions("shard", "place", options.get("id_col", "doc_id"), "first_word")
        .write.partitionBy("shard")
        .parquet(path)
    )
