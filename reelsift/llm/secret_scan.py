"""Secret scanning with a random forest that removes false positives.

Candidates are long runs of key-like characters. The forest sees a candidate's length, character
transitions, dictionary coverage, path and neighbouring words, and learns from labelled findings.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import ascii_lower, let, packed, words
from reelsift.session import materialise

LEAST = 16  # characters of a candidate
RUN = rf"[A-Za-z0-9_+/-]{{{LEAST},}}={{0,2}}"
KEY_WORDS = ("token", "secret", "key", "password", "passwd", "auth", "bearer", "credential", "apikey")
KNOWN = r"^(AKIA[0-9A-Z]{16}|gh[opsru]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"
HASHED = r"(commit|revision|sha-?(1|256|512)|md5|digest|checksum)"  # what names a hash
DICTIONARY = 2000  # most frequent letter triples of ordinary words
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
FEATURES = (
    "length", "switches", "digits", "upper", "naturalness", "coverage", "slashes", "path", "file", "key_before",
    "key_near", "assigned", "quoted",
)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, at, part, candidate, word, before, earlier, after``: each possible secret with its surroundings.

    ``at`` is the word's number in its text, ``part`` the candidate's in the word. Texts that are null or
    empty have none; repeated rows give repeated findings. Other columns are not read.
    """
    rows = packed(docs, (), _id=id_col, _text=text_col)

    def around(w: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            near = F.struct(
                i.alias("at"), x.alias("word"), F.get(w, i - 1).alias("before"), F.get(w, i - 2).alias("earlier"),
                F.get(w, i + 1).alias("after"),
            )
            return F.when((F.char_length(x) >= LEAST) & x.rlike(RUN), near)

        return F.filter(F.transform(w, one), lambda s: s.isNotNull())

    found = rows.select("_id", F.explode(let(words(F.col("_text")), around)).alias("x"))
    each = found.select("_id", "x.*", F.posexplode(F.regexp_extract_all("x.word", F.lit(RUN), 0)).alias("part", "candidate"))
    none = F.lit("")
    return each.select(
        F.col("_id").alias("doc_id"), "at", "part", "candidate", "word",
        *(F.coalesce(c, none).alias(c) for c in ("before", "earlier", "after")),
    )


def labelled(found: DataFrame) -> DataFrame:
    """``found`` with ``label``: 1 for secrets, 0 for others, null where the surroundings do not tell.

    Secrets are what is assigned to a key word, in quotes or not, follows ``Bearer``, or has the format of a
    known kind of key. Others are paths, plain words, runs without letters, and hashes that are called so.
    For corpora that come without labelled findings.
    """
    c, word = F.col("candidate"), F.col("word")
    tail = ascii_lower(F.concat_ws(" ", "earlier", "before", F.expr("substring_index(word, candidate, 1)")))
    keys = "|".join(KEY_WORDS)
    quoted = tail.rlike(rf"({keys})\W*[=:]\s*[\"']$")
    named = tail.rlike(rf"({keys})\W*[=:]\s*$|\bbearer\s+$")
    mixed = c.rlike("[0-9]") & c.rlike("[A-Za-z]")
    path = word.rlike("^(/|\\./|~/|[A-Za-z]:\\\\)") | word.contains("://") | c.startswith("/")
    plain = c.rlike("^[A-Za-z]?[a-z_/+-]*=*$|^[A-Z_/+-]*=*$|^[^A-Za-z]*$")
    hashed = c.rlike("^[0-9a-fA-F]{32,}$") & tail.rlike(rf"\b{HASHED}\W*$")
    secret = mixed & (quoted | c.rlike(KNOWN) | (named & ~path))
    return found.withColumn("label", F.when(secret, 1).when(path | plain | hashed, 0))


@dataclass(frozen=True)
class SecretModel:
    transitions: list[float] = field(default_factory=list)  # log chances of character pairs
    dictionary: list[str] = field(default_factory=list)
    forest: RandomForestClassificationModel | None = None


def _triples(text: Column) -> Column:
    low = ascii_lower(text)
    every = F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))
    )
    return F.array_distinct(F.filter(every, lambda t: t.rlike("^[a-z]{3}$")))


def _pairs(text: Column) -> Column:
    """Numbers of the pairs of neighbouring letters or digits."""
    low = F.regexp_replace(ascii_lower(text), "[^a-z0-9]", "")

    def number(i: Column) -> Column:
        return F.call_function("locate", F.substring(low, i, F.lit(1)), F.lit(ALPHABET)) - 1

    places = F.sequence(F.lit(1), F.greatest(F.char_length(low) - 1, F.lit(1)))
    pairs = F.transform(places, lambda i: number(i) * len(ALPHABET) + number(i + 1))
    return F.when(F.char_length(low) > 1, pairs).otherwise(F.array().cast("array<int>"))


def _learn_words(docs: DataFrame, text_col: str) -> tuple[list[float], list[str]]:
    """How letters follow each other in the words of ``docs``, and their most frequent triples."""
    word = docs.select(F.explode(words(F.col(text_col))).alias("w")).filter(F.char_length("w") < LEAST)
    counted = materialise(word.groupBy("w").agg(F.count("*").alias("n")))
    pairs = counted.select(F.explode(_pairs(F.col("w"))).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n"))
    n = {r["p"]: r["n"] for r in pairs.collect()}  # at most 36 x 36
    size = len(ALPHABET)
    chances = []
    for a in range(size):
        row = [n.get(a * size + b, 0) + 0.5 for b in range(size)]
        chances.extend(math.log(x / sum(row)) for x in row)
    triples = counted.select(F.explode(_triples(F.col("w"))).alias("t"), "n").groupBy("t").agg(F.sum("n").alias("n"))
    top = triples.orderBy(F.desc("n"), "t").limit(DICTIONARY).collect()
    return chances, [r["t"] for r in top]


def described(found: DataFrame, model: SecretModel) -> DataFrame:
    """``found`` with the columns ``FEATURES``."""
    c, word = F.col("candidate"), F.col("word")
    n = F.char_length(c).cast("double")
    start = F.expr("substring_index(word, candidate, 1)")
    context = F.concat_ws(" ", "before", start)
    key = "|".join(KEY_WORDS)
    switch = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
    chances = F.array(*map(F.lit, model.transitions)) if model.transitions else F.array(F.lit(0.0))
    known = F.array(*map(F.lit, model.dictionary)) if model.dictionary else F.array().cast("array<string>")

    def natural(p: Column) -> Column:
        return let(
            chances,
            lambda t: F.aggregate(p, F.lit(0.0), lambda a, i: a + F.coalesce(F.get(t, i), F.lit(0.0))),
        ) / F.greatest(F.size(p), F.lit(1))

    coverage = let(_triples(c), lambda t: F.size(F.array_intersect(t, known)) / F.greatest(F.size(t), F.lit(1)))
    values = {
        "length": F.log(n),
        "switches": F.regexp_count(c, F.lit(switch)) / n,
        "digits": F.regexp_count(c, F.lit("[0-9]")) / n,
        "upper": F.regexp_count(c, F.lit("[A-Z]")) / n,
        "naturalness": let(_pairs(c), natural),
        "coverage": F.when(F.size(_triples(c)) > 0, coverage).otherwise(0.0),
        "slashes": F.regexp_count(c, F.lit("/")) / n,
        "path": (word.rlike("^(/|\\./|~/|[A-Za-z]:\\\\)") | word.contains("://")),
        "file": word.rlike(r"\.[a-z]{2,4}\W*$"),
        "key_before": ascii_lower(context).rlike(key),
        "key_near": ascii_lower(F.concat_ws(" ", "earlier", "before", start, "after")).rlike(key),
        "assigned": context.rlike("[=:]\\s*[\"']?$"),
        "quoted": start.rlike("[\"']$"),
    }
    return found.withColumns({k: v.cast("double") for k, v in values.items()})


def fit(
    docs: DataFrame, findings: DataFrame, max_per_class: int = 5000, trees: int = 20, depth: int = 6,
    seed: int = 5, id_col: str = "doc_id", text_col: str = "text",
) -> SecretModel:
    """Learn from ``findings``: rows of ``candidates`` with ``label`` (1 secret, 0 false positive).

    At most ``max_per_class`` findings of either label are used, those with the least hashes; how
    ordinary words look is counted over all documents. Findings without label are left out. Without both labels there is nothing to tell apart, and every candidate counts.
    """
    by_hash = F.xxhash64(F.lit(seed), "doc_id", "at", "part")
    known = materialise(findings.dropna(subset=["label"]))
    classes = [known.filter(F.col("label") == k).orderBy(by_hash, "candidate").limit(max_per_class) for k in (0, 1)]
    sample = materialise(classes[0].union(classes[1]))
    if sample.select("label").distinct().count() < 2:
        return SecretModel()
    learnt = _learn_words(packed(docs, (), _text=text_col).select("_text"), "_text")
    rows = materialise(described(sample, SecretModel(*learnt)).select("label", *FEATURES))
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return SecretModel(*learnt, forest.fit(assembled))


def scan(found: DataFrame, model: SecretModel, least: float = 0.5) -> DataFrame:
    """``found`` with ``score``, the forest's belief, and ``is_secret`` from ``least`` on."""
    if model.forest is None:
        return found.withColumns({"score": F.lit(1.0), "is_secret": F.lit(True)})
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described(found, model))
    judged = model.forest.transform(assembled)
    score = vector_to_array("probability")[1]
    return judged.select(*found.columns, score.alias("score")).withColumn("is_secret", F.col("score") >= least)
