"""Small document tables with the awkward rows every operator must take."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    """Words split at white space, by hand."""
    out, word = [], ""
    for c in text or "":
        if c in SPACES:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, word] if word else out


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return table(spark, rows)


def sentences(n, seed=1, size=40):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdeéüß", k=draw.randint(1, 7))) for _ in range(300)]
    return [" ".join(draw.choices(vocabulary, k=draw.randint(1, size))) for _ in range(n)]


AWKWARD = [None, "", " \n\t ", "one", "One\n\none\r\nTWO words", "x" * 50_000, "a b " * 20_000, "İstanbul ÉTÉ straße\n" * 3]
