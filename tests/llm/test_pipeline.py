"""The registered queries and the pipeline, on the given tables and on rows of our own."""

from collections import Counter

import duckdb
import pytest
from helpers import AWKWARD, docs, sentences
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from reelsift.llm import queries
from reelsift.llm.common import words

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_all_are_registered():
    names = {f"op{n}_" for n in range(1, 14)}
    assert {q.split("_")[0] + "_" for q in queries.queries()} == names
    assert "pipeline" in entry.queries() and set(queries.queries()) < set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, spark, duck):
    got = queries.queries()[name](spark, SF_DIR)
    want = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_queries_without_sql_give_a_row_for_each_document(name, spark):
    got = queries.queries()[name](spark, SF_DIR)
    table, key = ("pages", "page_id") if "page_id" in got.columns else ("documents", "doc_id")
    ids = [r[0] for r in got.select(key).collect()]
    if not name.startswith("op5"):
        want = [r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect()]
        assert sorted(ids) == sorted(want)


def test_pipeline(spark, tmp_path):
    good = [f"{t.capitalize()} and some more words {k}." for k, t in enumerate(sentences(120, size=60))]
    item = "what is the colour of the sky when the evening sun goes down behind the old hills"
    texts = [*good, *(g.upper().replace(" ", "!! ") for g in good[:30]), good[3].replace(" ", "\n"), f"{good[7]} {item}", *AWKWARD]
    ids = [*range(len(texts) - 1), None]
    folder = str(tmp_path)
    docs(spark, texts, ids).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1) for k in range(120)] + [(k, 0) for k in range(120, 150)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    given = spark.read.parquet(f"{folder}/documents.parquet")
    now, kept = given, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{folder}/{k}")
        now = spark.read.parquet(f"{folder}/{k}")
        kept.append({r[0] for r in now.select("doc_id").collect()})
        if k < 4:
            assert now.dtypes == given.dtypes
    judged, cleaned, single, unleaked, mixed = kept
    assert not judged & set(range(120, 150)) and len(judged & set(range(120))) >= 118
    assert cleaned == judged
    copy, leak = 150, 151
    assert copy in cleaned and copy not in single and 3 in single
    assert leak in single and leak not in unleaked and len(single - unleaked) == 1
    assert mixed <= unleaked and now.filter("taken < 1 OR taken > 3 * size").count() == 0
    given_words = {r[0]: r[1] for r in now.groupBy("source").agg(F.sum(F.size(words(F.col("text"))))).collect()}
    targets = {r[0]: r[1] for r in now.select("source", "target").distinct().collect()}
    assert all(abs(given_words[s] - targets[s]) <= 0.5 + 1e-6 for s in targets)
    whole = corpus_pipeline.run(spark, folder)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, now.select(whole.columns).collect()))


def test_pipeline_takes_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    docs(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
