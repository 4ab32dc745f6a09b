"""Code lengths by context-tree weighting over bytes.

A byte is eight binary decisions. For each, a tree of contexts (the bytes before it, up to ``DEPTH``)
holds Krichevsky-Trofimov estimates, and the weighting mixes the trees of all depths. Trained on
one part of the corpus the mixture is a fixed function of a byte and the bytes before it, so it is
worked out once for each gram, and scoring adds up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import cuts, packed, parts, ship
from reelsift.session import materialise

DEPTH = 5  # bytes of context, at most 6
NEAR = 3  # last bytes of a context by which grams are dealt to tasks
SLICE_GRAMS = 1 << 16
SLICE_BYTES, FEW_BYTES = 1 << 22, 1 << 19  # of texts whose words, and whose grams, are handled at once
EDGE = 0xFF  # stands before and, once, after a text; no byte of UTF-8
BUFFER = 1 << 21  # grams whose counts a task combines at once
FREQUENT = 1 << 16  # words whose counts every task may hold
BROADCAST_GRAMS = 1 << 23  # grams whose code lengths every task may hold: 100 MB


def _lowered(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased, null as empty, in buffers of their own."""
    own = texts.take(pa.array(np.arange(len(texts))))
    return pc.ascii_lower(pc.fill_null(own.cast(pa.large_string()), ""))


def _tokens(low: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each has."""
    lists = pc.ascii_split_whitespace(low)
    flat, sizes = pc.list_flatten(lists), np.diff(np.asarray(lists.offsets))
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(low)), sizes)
    return flat.filter(pa.array(real)), np.bincount(owner[real], minlength=len(low))


def _grams(low: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end: the byte with ``depth`` bytes before it; and whose it is."""
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = low.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(low)), sizes)
    line = np.full(len(data) + depth * (len(low) + 1), EDGE, np.uint64)
    line[np.arange(len(data)) + depth * (owner + 1)] = data
    ends = np.cumsum(sizes) + depth * np.arange(1, len(low) + 1)
    coded = np.ones(len(line), bool)
    coded[:depth] = False
    for i in range(1, depth):  # of the edge bytes after a text only the first is coded
        coded[ends + i] = False
    gram = np.zeros(len(line) - depth, np.uint64)
    for i in range(depth + 1):
        gram = (gram << np.uint64(8)) | line[i : len(line) - depth + i]
    return gram[coded[depth:]].view(np.int64), np.repeat(np.arange(len(low)), sizes + 1)


def _summed(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(gram)
    gram = gram[order]
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    return gram[first], np.add.reduceat(n[order], first)


def _counted(depth: int):
    """Per task: grams with their counts in training texts, 0 where only other texts have them.

    Grams are sorted with the mark of training as their last bit, a buffer at a time. What buffers have
    in common is added up as long as it is at most ``BUFFER`` grams.
    """

    def different(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        code = np.concatenate(codes)
        code.sort()
        gram = code >> 1
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        return gram[first], np.add.reduceat(code & 1, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, size = [], 0
        gram, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            g, k = different(codes)
            return _summed(np.concatenate([gram, g]), np.concatenate([n, k]))

        for whole in batches:
            for start, stop in cuts(whole.column(0), FEW_BYTES):
                b = whole.slice(start, stop - start)
                found, owner = _grams(_lowered(b.column(0)), depth)
                codes.append(found << 1 | b.column(1).to_numpy(zero_copy_only=False)[owner])
                size += len(found)
                if size >= BUFFER:
                    gram, n = merged()
                    codes, size = [], 0
                    if len(gram) >= BUFFER:
                        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])
                        gram, n = gram[:0], n[:0]
        if codes:
            gram, n = merged()
        if len(gram):
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: words of training texts and their counts."""
    for b in batches:
        coded = pc.value_counts(_tokens(_lowered(b.column(0).filter(b.column(1))))[0])
        if len(coded):
            yield pa.RecordBatch.from_arrays([coded.field("values").cast(pa.string()), coded.field("counts")], ["word", "n"])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma of x > 0: Stirling's series at x + 8, and the recurrence back."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(reduce(lambda a, i: a * (x + i), range(1, 8), x))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    both = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - np.log(np.pi) - _log_gamma(zeros + ones + 1.0)
    return np.where(zeros + ones == 0, 0.0, both)


class _Tree:
    """The nodes of some grams' contexts, from ``depth`` bytes down to ``least`` bytes.

    A node is a context and the decisions made so far in the byte, led by a 1: one number, the
    decisions in its last eight bits. All contexts that share a node must be there.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray, depth: int, least: int) -> None:
        byte = gram & 255
        step = np.arange(7, -1, -1)
        bits = (byte[:, None] + 256) >> (step + 1)
        self.bit = (byte[:, None] >> step) & 1
        nodes = ((gram & ~255)[:, None] | bits).ravel()
        times = np.repeat(n, 8).astype(float)
        key, at = np.unique(nodes, return_inverse=True)
        ones = np.bincount(at, times * self.bit.ravel(), len(key))
        zeros = np.bincount(at, times, len(key)) - ones
        self.leaf, log_e = at.reshape(-1, 8), log_kt(zeros, ones)
        self.levels = [(key, zeros, ones, log_e, None, log_e)]  # the deepest first
        self.above = []  # a node's place in the level above
        for d in range(depth - 1, least - 1, -1):
            key, zeros, ones, _, _, log_w = self.levels[-1]
            key, at = np.unique(key & ((1 << (8 * (d + 1))) - 1), return_inverse=True)
            zeros, ones, children = (np.bincount(at, x, len(key)) for x in (zeros, ones, log_w))
            log_e = log_kt(zeros, ones)
            self.levels.append((key, zeros, ones, log_e, children, np.logaddexp(log_e, children) - np.log(2.0)))
            self.above.append(at)

    def log_p(self, left: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Log probabilities of the grams' last bytes, from what shorter contexts leave to the top level
        and the chance of a 0 they have gathered."""
        for k in range(len(self.levels) - 1, -1, -1):
            _, zeros, ones, log_e, children, _ = self.levels[k]
            used = left if children is None else left / (1 + np.exp(np.minimum(children - log_e, 700.0)))
            chance, left = chance + used * (zeros + 0.5) / (zeros + ones + 1.0), left - used
            if k:
                left, chance = left[self.above[k - 1]], chance[self.above[k - 1]]
        zero = chance[self.leaf]
        return np.log(np.where(self.bit == 0, zero, 1 - zero)).sum(1)


def model(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``gram``, ``log_p``: natural log probability of a gram's last byte after those before it.

    ``grams`` (gram, n) has all grams whose probability is wanted, with their counts in training. Grams
    are dealt by the last ``NEAR`` bytes of their contexts, so that every tree of longer contexts is whole
    in one task; a task holds ``SLICE_GRAMS`` on average. The trees of shorter contexts are few nodes,
    joined level by level.
    """
    near = min(NEAR, depth)
    ends = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << (8 * near)) - 1))
    slices = parts(grams.sparkSession, grams.count(), SLICE_GRAMS)
    dealt = grams.select("gram", "n", F.pmod(F.xxhash64(ends), F.lit(slices)).alias("slice"))

    def top_nodes(rows: pd.DataFrame) -> pd.DataFrame:
        tree = _Tree(rows["gram"].to_numpy(), rows["n"].to_numpy(), depth, near)
        key, zeros, ones, _, _, log_w = tree.levels[-1]
        return pd.DataFrame({"node": key, "zeros": zeros, "ones": ones, "log_w": log_w})

    nodes = dealt.groupBy("slice").applyInPandas(top_nodes, "node long, zeros double, ones double, log_w double")
    levels = [materialise(nodes)]

    def shortened(d: int) -> Column:
        return F.col("node").bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1))

    for d in range(near - 1, -1, -1):
        joined = levels[0].groupBy(shortened(d).alias("node")).agg(
            *(F.sum(c).alias(c) for c in ("zeros", "ones")), F.sum("log_w").alias("children")
        )
        levels.insert(0, materialise(joined.mapInPandas(_mixed, f"{LEVEL}, log_w double")))

    # from the root on: the weight left for longer contexts, and the chance of a 0 gathered so far
    path = levels[0].select("node", F.lit(1.0).alias("left"), F.lit(0.0).alias("chance"))
    for d in range(near):
        zero = (F.col("zeros") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
        used = F.col("left") / (1 + F.exp(F.least(F.col("children") - F.col("log_e"), F.lit(700.0))))
        here = levels[d].join(path, "node").select(
            F.col("node").alias("_up"), (F.col("left") - used).alias("left"), (F.col("chance") + used * zero).alias("chance")
        )
        path = levels[d + 1].select("node").join(here, shortened(d) == F.col("_up")).drop("_up")
    path = path.withColumn(
        "slice", F.pmod(F.xxhash64(F.shiftrightunsigned("node", 8)), F.lit(slices))
    )

    def lengths(rows: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        tree = _Tree(rows["gram"].to_numpy(), rows["n"].to_numpy(), depth, near)
        top = top.sort_values("node")
        log_p = tree.log_p(top["left"].to_numpy(), top["chance"].to_numpy()) if len(rows) else []
        return pd.DataFrame({"gram": rows["gram"], "log_p": log_p})

    return dealt.groupBy("slice").cogroup(path.groupBy("slice")).applyInPandas(lengths, "gram long, log_p double")


LEVEL = "node long, zeros double, ones double, children double, log_e double"


def _mixed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add a node's own evidence, and the mean of it and its children's."""
    for b in batches:
        log_e = log_kt(b["zeros"].to_numpy(), b["ones"].to_numpy())
        yield b.assign(log_e=log_e, log_w=np.logaddexp(log_e, b["children"].to_numpy()) - np.log(2.0))


class _Scorer:
    """What a task needs to score texts; rare words, and grams if there are many, are left to joins."""

    def __init__(self, depth: int, sent: object) -> None:
        self.depth, self.sent = depth, sent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, grams, log_p, log10_all, ends = self.sent.value
        words = pd.Index(known)
        for whole in batches:
            for start, stop in cuts(whole.column(1), SLICE_BYTES):
                b = whole.slice(start, stop - start)
                low = _lowered(b.column(1))
                flat, sizes = _tokens(low)
                n = len(low)
                owner = np.repeat(np.arange(n), sizes)
                coded = pc.dictionary_encode(flat)
                code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                at = words.get_indexer(coded.dictionary.to_pylist()) if len(code) else np.zeros(0, np.int64)
                term = np.where(at >= 0, np.log10(counts[at] + 0.5) - log10_all, 0.0)
                base = np.bincount(owner, term[code], n) + (np.log10(ends + 0.5) - log10_all)
                seen = np.bincount(owner, (at >= 0)[code], n).astype(np.int64) + int(ends > 0)
                rare = at[code] < 0
                rare_words = _listed(owner[rare], code[rare], n, lambda c: coded.dictionary.cast(pa.string()).take(pa.array(c)))
                total, left = np.zeros(n), []
                for first, last in cuts(low, FEW_BYTES):  # grams take many times the memory of their texts
                    few = low.slice(first, last - first)
                    gram, of = _grams(few, self.depth)
                    if grams is None:
                        left.append(_listed(of, gram, len(few), pa.array))
                    else:
                        different, of_gram = np.unique(gram, return_inverse=True)
                        total[first:last] = np.bincount(of, log_p[np.searchsorted(grams, different)][of_gram], len(few))
                        left.append(_listed(of[:0], gram[:0], len(few), pa.array))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(sizes + 1), pa.array(seen), pa.array(base), pa.array(total), rare_words, pa.concat_arrays(left)],
                    ["_key", "n_tokens", "n_known", "base", "log_p", "words", "grams"],
                )


def _listed(owner: np.ndarray, code: np.ndarray, n: int, name) -> pa.Array:
    """Per owner, its different codes by ``name`` and how often it has each."""
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(code)))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=n))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([name(code[first]), pa.array(times.astype(np.int64))], ["what", "times"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def score(
    docs: DataFrame,
    train: Column,
    depth: int = DEPTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent: int = FREQUENT,
    broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """``doc_id`` with log10 probabilities of its text: ``score``, and ``base_score`` of a word model.

    Both learn from rows for which ``train`` (a condition on ``docs``) holds, ``trained`` in the result.
    ``n_tokens, n_known, train_tokens`` count words and one end per text. The score is of all bytes of the text, A-Z lower-cased, and of its end.

    Grams and their counts come from all rows and are aggregated by gram. Tasks hold the code lengths
    of at most ``broadcast_grams`` grams, a counted number, else texts join them; likewise they hold the
    ``frequent`` most frequent words and join the rest. Null text is empty: only its end is coded.
    Without training rows every bit and word is as good as any other. Null and repeated ids give a row
    for each row. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    marked = docs.withColumn("_train", F.coalesce(train, F.lit(False)))
    rows = packed(marked, (), _id=id_col, _text=text_col, _train="_train").drop("_row")
    texts = rows.select("_text", "_train")

    counted = texts.mapInArrow(_counted(depth), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    lengths = materialise(model(materialise(counted), depth))

    words = texts.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialise(words)
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = rows.agg(F.count_if("_train")).first()[0]
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    log10_all = float(np.log10(tokens + 0.5 * (distinct + 1)))
    top = words.orderBy(F.desc("n"), "word").limit(frequent).toArrow().to_pandas()
    held = None, None
    if lengths.count() <= broadcast_grams:
        table = lengths.orderBy("gram").toArrow()  # in order, tasks need no index of their own
        held = table["gram"].to_numpy(), table["log_p"].to_numpy()
    known = top["word"].to_numpy(object), np.append(top["n"].to_numpy(np.int64), 0)
    scorer = _Scorer(depth, spark.sparkContext.broadcast((*known, *held, log10_all, ends)))
    keyed = rows.select(F.struct("_id", "_train", F.monotonically_increasing_id().alias("at")).alias("_key"), "_text")
    schema = (
        f"_key {keyed.schema['_key'].dataType.simpleString()}, n_tokens long, n_known long, base double, log_p double, "
        "words array<struct<what:string,times:bigint>>, grams array<struct<what:bigint,times:bigint>>"
    )
    done = materialise(keyed.mapInArrow(scorer, schema))  # keys are those of this written table

    def joined(lists: str, table: DataFrame, key: str, *sums: Column) -> DataFrame:
        each = done.select("_key.at", F.explode(lists).alias("x")).select("at", F.col("x.what").alias(key), "x.times")
        return each.join(table, key, "left").groupBy("at").agg(*sums)

    c, times = F.coalesce("n", F.lit(0)), F.col("times")
    rare = joined(
        "words", words, "word",
        F.sum(times * (F.log10(c + 0.5) - log10_all)).alias("rare_base"), F.sum(F.when(c > 0, times)).alias("rare_known"),
    )
    result = done.select("_key.*", "n_tokens", "n_known", "base", "log_p").join(rare, "at", "left")
    log_p = F.col("log_p")
    if held[0] is None:
        long_way = joined("grams", lengths, "gram", F.sum(times * F.col("log_p")).alias("all_log_p"))
        result, log_p = result.join(long_way, "at"), F.col("all_log_p")
    none = F.lit(0)
    return result.select(
        F.col("_id").alias("doc_id"),
        F.col("_train").alias("trained"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", none)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", none)).alias("base_score"),
        (log_p / float(np.log(10.0))).alias("score"),
    )
