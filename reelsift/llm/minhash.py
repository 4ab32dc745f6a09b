"""Document fingerprints by one-permutation MinHash.

The shingles of a text are hashed once; the leading bits of a hash choose its bin, and a bin keeps
its least hash. Empty bins borrow from filled ones by optimal densification (Shrivastava 2017), and
of every bin only the lowest bits are stored, packed. Chance agreements of so few bits are taken
off the likeness (Li and Koenig 2010).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelsift.llm.common import ascii_lower, let, packed, words

WIDTH = 5  # words of a shingle
BIN_BITS = 8
BINS = 1 << BIN_BITS
STORED = 4  # bits of each bin
PROBES = 8
PER_LONG = 64 // STORED
RANGE_ROWS = 5_000  # documents of one range of ids, on average
MOST_RANGES = 1 << 15  # boundaries that may reach the driver


def shingle_hashes(text: Column) -> Column:
    """A 64-bit hash for each run of ``WIDTH`` words, A-Z lower-cased; of all words if there are fewer."""

    def grams(h: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(h) - WIDTH),
            lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WIDTH))),
        )
        return F.when(F.size(h) >= WIDTH, runs).otherwise(F.array(F.xxhash64(h)))

    return let(F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w)), grams)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS)


def packed_bins(hashes: Column) -> Column:
    """``BINS`` times ``STORED`` bits as longs, for an array of hashes that is not empty.

    An empty bin takes the value of the first filled bin in a random order of its own, the same for
    all texts: ``PROBES`` hashed places, then all bins as a hash of both numbers ranks them.
    """
    low, filled = (1 << STORED) - 1, 1 << STORED

    def least(s: Column) -> Column:  # of each bin, from sorted hashes
        return F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1))))

    def in_order(h: Column) -> Column:
        return F.shiftleft(_bin(h), STORED + 1).bitwiseOR(h.bitwiseAND(F.lit(low))).bitwiseOR(F.lit(filled))

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, STORED + 1)

    def is_filled(x: Column) -> Column:
        return x.bitwiseAND(F.lit(filled)) != 0

    def densified(own: Column) -> Column:
        numbers = F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long"))
        empty = F.transform(F.array_except(numbers, F.transform(own, bin_of)), lambda e: F.shiftleft(e, STORED + 1))

        def lend(bins: Column) -> Column:  # bins, one after the other, empty ones without the flag
            def probe(x: Column) -> Column:
                def step(found: Column, t: Column) -> Column:
                    at = F.xxhash64(x, t).bitwiseAND(F.lit(BINS - 1)).cast("int")
                    return F.when(is_filled(found), found).otherwise(F.get(bins, at))

                return F.aggregate(F.sequence(F.lit(1), F.lit(PROBES)), x, step)

            def first_ranked(x: Column) -> Column:
                return F.array_min(
                    F.transform(own, lambda y: F.xxhash64(x, y.bitwiseAND(F.lit(~low))).bitwiseAND(F.lit(~low)).bitwiseOR(y.bitwiseAND(F.lit(low))))
                )

            def fill(x: Column) -> Column:
                return let(probe(x), lambda y: F.when(is_filled(y), y).otherwise(first_ranked(x)))

            return F.transform(bins, lambda x: F.when(is_filled(x), x).otherwise(fill(x)))

        return let(F.sort_array(F.concat(own, empty)), lend)

    def pack(bins: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)),
            lambda k: F.aggregate(
                F.slice(bins, k * PER_LONG + 1, PER_LONG),
                F.lit(0).cast("long"),
                lambda a, x: F.shiftleft(a, STORED).bitwiseOR(x.bitwiseAND(F.lit(low))),
            ),
        )

    own = F.transform(let(F.sort_array(hashes), least), in_order)
    return let(let(F.sort_array(own), densified), pack)


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text; null is like an empty text."""
    return packed_bins(shingle_hashes(F.coalesce(text, F.lit(""))))


def as_hex(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints' shingle sets, 0 to 1."""
    ones = F.lit(int("1" * PER_LONG, 16))

    def unlike(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(ones))

    different = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda n, d: n + d)
    chance = 1 / (1 << STORED)
    agreed = (1 - different / BINS - chance) / (1 - chance)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), agreed))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (hex). One pass without a shuffle; equal texts get equal ones."""
    rows = packed(docs, ("fingerprint",), _text=text_col)
    return rows.select("_row", as_hex(fingerprint(F.col("_text"))).alias("fingerprint")).select("_row.*", "fingerprint")


def _ranges(ids: DataFrame) -> list[int]:
    """The least id of each range of ids, in order: at most ``MOST_RANGES`` numbers."""
    count = ids.count()
    ranges = max(1, min(MOST_RANGES, -(-count // RANGE_ROWS)))
    least = ids.repartitionByRange(ranges, "_id").groupBy(F.spark_partition_id()).agg(F.min("_id").alias("_id"))
    return sorted(r["_id"] for r in least.select("_id").distinct().collect() if r["_id"] is not None)


def with_next(rows: DataFrame, *carried: str) -> DataFrame:
    """``rows`` (with ``_id``, ``_text``) and the ``carried`` columns of the next row as ``next_...``.

    By ascending id, null first, then text; after the last row comes the first. Rows are dealt to
    ranges of ids, and the row that begins a range is also sent to the range before it, so every
    row meets the next one in a single shuffle.
    """
    least = _ranges(rows.select("_id"))
    bounds = F.array(*(F.lit(x).cast("long") for x in least)) if least else F.array().cast("array<bigint>")
    n = len(least)
    steps = [1 << i for i in reversed(range(max(n, 1).bit_length()))]

    def search(bounds: Column) -> Column:  # how many bounds are at or below the id
        at = F.aggregate(
            F.array(*map(F.lit, steps)),
            F.lit(0),
            lambda a, s: a + F.when((a + s <= n) & (F.get(bounds, a + s - 1) <= F.col("_id")), s).otherwise(0),
        )
        own = F.greatest(at - 1, F.lit(0))
        begins = F.get(bounds, own).eqNullSafe(F.col("_id")) | F.col("_id").isNull()
        before = F.pmod(own - 1, F.lit(max(n, 1)))
        guest = F.struct(before.alias("range"), F.lit(True).alias("guest"))
        host = F.struct(own.alias("range"), F.lit(False).alias("guest"))
        return F.when(begins, F.array(host, guest)).otherwise(F.array(host))

    dealt = rows.withColumn("_to", F.explode(let(bounds, search)))
    # guests of the last range stand for what follows it, so all guests come last
    order = Window.partitionBy("_to.range").orderBy(
        F.col("_to.guest"), F.col("_id").asc_nulls_first(), F.col("_text").asc_nulls_first()
    )
    ahead = [F.lead(c).over(order).alias(f"next_{c.strip('_')}") for c in carried]
    return dealt.select("*", *ahead).filter(~F.col("_to.guest")).drop("_to")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of the texts with their last half replaced from the next document.

    ``doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next``. Null is
    an empty text. Next is by ascending id, null first and ties by text; after the last comes the first,
    so a single document is its own next. Other columns are not read.
    """
    rows = packed(docs, (), _id=id_col, _text=text_col).select("_id", F.coalesce("_text", F.lit("")).alias("_text"))
    printed = rows.select("_id", "_text", fingerprint(F.col("_text")).alias("_print"))
    paired = with_next(printed, "_text", "_print")
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)
    )
    texts = paired.select("_id", n.cast("long").alias("n_chars"), edited.alias("edited_text"), "_print", "next_print")
    both = texts.withColumn("_edited", fingerprint(F.col("edited_text")))
    return both.select(
        F.col("_id").alias("doc_id"),
        "n_chars",
        "edited_text",
        as_hex(F.col("_print")).alias("fingerprint"),
        as_hex(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_print"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("_print"), F.col("next_print")).alias("near_next"),
    )
