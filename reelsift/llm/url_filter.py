"""Judging urls by rules and, where none fits, by the words of their host and path.

Names in hosts are run together, so Viterbi's algorithm splits each into its likeliest words under the
unigram counts of a corpus. Multinomial naive Bayes, which learns from the urls that rules have judged,
then weighs the host's words and the path's tokens.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import ascii_lower, packed, ship
from reelsift.session import materialise

OUTPUTS = ("host", "path", "rule", "score", "verdict")
LONGEST_WORD = 24
COUNTED_WORDS = 1 << 18  # distinct words a task holds before it sends their counts on
COMMON_KEYS = 10_000  # keys more frequent than all rows by this are fewer than this
UNITS = 1_000_000  # of a logarithm: whole numbers add up to the same in any order


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


# --- urls and rules --------------------------------------------------------------------------


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ``://``."""
    part = lambda k: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return ascii_lower(part(1)), part(2)


def fitting(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (of equal ones that with the longer host) and its verdict, or nulls.

    A rule fits its host and all subdomains where the path starts with the rule's. Rules are
    configuration: each row tries them in turn.
    """
    longest_first = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r))
    rule = verdict = F.lit(None).cast("string")
    for r in reversed(longest_first):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, r.host + r.path).otherwise(rule)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


# --- joins with hot keys ---------------------------------------------------------------------


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``table``, which has each ``key`` once and ``n``, its number of rows.

    Keys with more than a ``COMMON_KEYS``th of the rows are fewer than ``COMMON_KEYS``; these are sent to
    all tasks. No key of the others is hot.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    is_common = F.col("n") > total / COMMON_KEYS
    common, others = (F.broadcast(table.filter(is_common).drop("n")), table.filter(~is_common).drop("n"))
    rare = rows.join(common.select(key), key, "left_anti").join(others, key)
    return rows.join(common, key).unionByName(rare)


# --- splitting names -------------------------------------------------------------------------

_MARKUP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^<>]*>|&#?\w+;")
_WORD = re.compile(r"[^\W\d_]+")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "times"])

    held: Counter = Counter()
    for b in batches:
        for text in b.column(0):
            held.update(w for w in _WORD.findall(_MARKUP.sub(" ", text.as_py() or "").lower()) if len(w) <= LONGEST_WORD)
            if len(held) >= COUNTED_WORDS:
                yield flush(held)
                held.clear()
    if held:
        yield flush(held)


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """``word, times`` over all texts, markup left out; words are runs of letters, lower-cased."""
    ship(texts.sparkSession)
    narrow = packed(texts, (), text=text_col).select(F.col("text").cast("string"))
    counted = narrow.mapInArrow(_count_words, "word string, times long")
    return materialise(counted.groupBy("word").agg(F.sum("times").alias("times")))


def price(times: int | None, length: int, total: int) -> int:
    """Of a word: its negative log10 chance; words not counted are rarer the longer they are."""
    chance = times / total if times else 10 / (total * 10.0**length)
    return round(-UNITS * math.log10(chance))


def split_name(name: str, times: dict[tuple[int, int], int], total: int) -> list[str]:
    """The cheapest words that make up ``name``; ties: the fewest, then the longest last one.

    ``times`` has the counts of known words by where they begin and end.
    """
    best = [(0, 0, 0)]
    for end in range(1, len(name) + 1):
        ways = []
        for begin in range(max(0, end - LONGEST_WORD), end):
            cost, words, _ = best[begin]
            ways.append((cost + price(times.get((begin, end)), end - begin, total), words + 1, begin))
        best.append(min(ways))
    out, end = [], len(name)
    while end:
        begin = best[end][2]
        out.append(name[begin:end])
        end = begin
    return out[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name, words`` of distinct names of letters, under the counts of ``word_counts``."""
    total = max(counts.agg(F.sum("times")).first()[0] or 0, 10)
    size = F.char_length("name")
    at = F.sequence(F.lit(1), size)
    ends = lambda i: F.sequence(i, F.least(i + (LONGEST_WORD - 1), size))
    piece = lambda i, j: F.struct((i - 1).alias("begin"), j.alias("end"), F.substring("name", i, j - i + 1).alias("word"))
    pieces = F.flatten(F.transform(at, lambda i: F.transform(ends(i), lambda j: piece(i, j))))
    spread = materialise(names.select("name", F.explode(pieces).alias("p")).select("name", "p.*"))
    known = materialise(spread.groupBy("word").agg(F.count("*").alias("n")).join(counts, "word"))
    found = lookup(spread, known, "word").select("name", F.struct("begin", "end", "times").alias("k"))
    every = found.unionByName(names.select("name", F.lit(None).cast("struct<begin:int,end:int,times:bigint>").alias("k")))

    def split(name: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series(
            [split_name(n, {(k["begin"], k["end"]): k["times"] for k in ks}, total) for n, ks in zip(name, known, strict=True)]
        )

    words = F.pandas_udf(split, "array<string>")
    return materialise(every.groupBy("name").agg(F.collect_list("k").alias("k")).select("name", words("name", "k").alias("words")))


# --- judging ---------------------------------------------------------------------------------


def _names(host: Column) -> Column:
    return F.regexp_extract_all(F.lower(host), F.lit(r"\p{L}+"), F.lit(0))


def _path_tokens(path: Column) -> Column:
    """Runs of letters, lower-cased, and ``#`` for each number."""
    tokens = F.regexp_extract_all(F.lower(path), F.lit(r"\p{L}+|[0-9]+"), F.lit(0))
    return F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]"), "#").otherwise(t))


def _tokens(shapes: DataFrame, counts: DataFrame) -> DataFrame:
    """``shape, allowed, blocked, token, times``: words of the host and tokens of the path."""
    hosts = materialise(shapes.select("host").distinct().select("host", F.explode(_names(F.col("host"))).alias("name")))
    per_name = materialise(hosts.groupBy("name").agg(F.count("*").alias("n")))
    split = segmented(per_name.select("name"), counts).join(per_name, "name")
    of_host = (
        lookup(hosts, materialise(split), "name")
        .select("host", F.explode("words").alias("word"))
        .groupBy("host").agg(F.collect_list(F.concat(F.lit("h:"), "word")).alias("words"))
        .join(shapes.groupBy("host").agg(F.count("*").alias("n")), "host")
    )
    named = lookup(shapes.filter(F.size(_names(F.col("host"))) > 0), materialise(of_host), "host")
    bare = shapes.filter(F.size(_names(F.col("host"))) == 0).withColumn("words", F.array().cast("array<string>"))
    tokens = F.array_remove(F.split("path_tokens", " "), "")
    own = F.concat("words", F.transform(tokens, lambda t: F.concat(F.lit("p:"), t)))
    each = named.unionByName(bare).select("shape", "allowed", "blocked", F.explode(own).alias("token"))
    return each.groupBy("shape", "allowed", "blocked", "token").agg(F.count("*").alias("times"))


def _weights(tokens: DataFrame) -> DataFrame:
    """``token, weight, n``: log odds of block by token, for tokens in judged urls; counts and one each."""
    of = tokens.groupBy("token").agg(
        F.sum(F.col("times") * F.col("blocked")).alias("b"), F.sum(F.col("times") * F.col("allowed")).alias("a"), F.count("*").alias("n")
    )
    of = materialise(of.filter("a + b > 0"))
    blocked, allowed, kinds = of.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count("*")).first()
    odds = F.ln((F.col("b") + 1) / (blocked + kinds)) - F.ln((F.col("a") + 1) / (allowed + kinds))
    return materialise(of.select("token", F.round(odds * UNITS).cast("long").alias("weight"), "n"))


def judge(
    urls: DataFrame, counts: DataFrame, rules: Sequence[Rule], url_col: str = "url"
) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict`` (allow or block).

    Where a rule fits, the verdict is its own and there is no score. The others are judged by ``score``,
    the log odds of block in millionths, from what rules have judged: above 0 is block. Each token counts
    as often as it occurs; tokens that no judged url has do not count, and without any the classes'
    frequencies decide. Where rules have judged nothing, everything is allowed.

    Null urls and those without ``://`` have an empty host and path, and get the verdict of a url without
    tokens. Repeated rows stay, empty tables give empty results, and input columns named like an output
    give way to it.
    """
    rows = packed(urls, OUTPUTS, _url=url_col)
    host, path = parsed(F.col("_url").cast("string"))
    rows = rows.select("_row", host.alias("host"), path.alias("path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    rows = rows.select("_row", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    path_tokens = F.array_join(_path_tokens(F.col("path")), " ")
    narrow = rows.select("host", "ruled", path_tokens.alias("path_tokens"))
    key = F.concat_ws("\n", "host", "path_tokens").alias("shape")
    shapes = materialise(
        narrow.groupBy("host", "path_tokens")
        .agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
        .withColumn("shape", key)
    )
    allowed, blocked = shapes.agg(F.coalesce(F.sum("allowed"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    prior = round(UNITS * (math.log(blocked + 1) - math.log(allowed + 1)))
    tokens = materialise(_tokens(shapes, counts))
    weighed = lookup(tokens, _weights(tokens), "token").groupBy("shape").agg(F.sum(F.col("times") * F.col("weight")).alias("sum"))
    scores = materialise(
        shapes.join(weighed, "shape", "left").select("shape", (F.coalesce("sum", F.lit(0)) + prior).alias("score"), "n")
    )
    judged = lookup(rows.withColumn("shape", F.concat_ws("\n", "host", path_tokens)), scores, "shape")
    by_score = F.when(F.col("score") > 0, "block").otherwise("allow")
    return judged.select(
        "_row.*", "host", "path", "rule",
        F.when(F.col("ruled").isNull(), F.col("score")).alias("score"),
        F.coalesce("ruled", by_score).alias("verdict"),
    )
