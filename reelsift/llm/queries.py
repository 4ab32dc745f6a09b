"""One registered query for each operator, over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsift.llm import (
    chat, ctw, decontaminate, lexical, line_dedup, minhash, mixing, periodic, quality, secret_scan, simhash,
    url_filter, warc,
)
from reelsift.llm.common import let, read, words
from reelsift.session import materialise

_registry: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build: Callable[[SparkSession, str], DataFrame]):
        _registry[name] = build
        if sql:
            _sql[name] = sql
        return build

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_registry)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def remainder(divisor: int):
    return F.crc32(F.col("doc_id").cast("string")) % divisor


@query("op1_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = minhash.edited_likeness(read(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", "near_edited", "near_next",
    )


@query("op2_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read(spark, sf_dir, "documents"))


LINES = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (
  SELECT key, min(doc_id) AS doc_id FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.doc_id AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op3_line_dedup", LINES)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown'
      ELSE regexp_replace(trim(role), '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') END AS role,
    regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') AS text FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS pos FROM turns),
participants AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'),
views AS (
  SELECT p.speaker, t.*, CASE WHEN role = speaker THEN '1' ELSE '0' END AS own,
    '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN role
      ELSE 'user name=' || role END || chr(10) AS head
  FROM placed t JOIN participants p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
ends AS (
  SELECT *, CAST(sum(length(head) + length(text) + 11) OVER (
    PARTITION BY conv_id, speaker ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM views)
SELECT conv_id, 0 AS part, speaker,
  count(*) AS n_turns, string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text,
  string_agg(own, '' ORDER BY pos) AS mask,
  string_agg((stop - 11 - length(text)) || ':' || stop, ' ' ORDER BY pos) FILTER (WHERE own = '1') AS spans
FROM ends GROUP BY conv_id, speaker
"""


@query("op4_chat_rotation", CHAT)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chat.rotations(read(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["begin"].cast("string"), s["end"].cast("string"))), " ")
    return done.withColumn("spans", spans)


@query("op5_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the findings in documents whose crc32 leaves a remainder other than 2."""
    docs = read(spark, sf_dir, "documents")
    found = materialise(secret_scan.candidates(docs))
    model = secret_scan.fit(docs, secret_scan.labelled(found).filter(remainder(4) != 2))
    scanned = secret_scan.scan(found, model).withColumn("held_out", remainder(4) == 2)
    return scanned.select("doc_id", "at", "part", "candidate", "held_out", "score", "is_secret")


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return decontaminate.decontaminate(docs, benchmark).select("doc_id", "items", "cover", "contaminated")


@query("op7_ctw")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ctw.score(read(spark, sf_dir, "documents"), remainder(5) != 1)
    return done.withColumn("held_out", ~F.col("trained")).drop("trained")


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels").filter(remainder(4) != 2))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")


PAGES = """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes,
    sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT html, min(page_id) AS first FROM sized GROUP BY html),
digits AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * CAST(i // 4 AS INTEGER), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31)::INTEGER, 1), '' ORDER BY i) AS payload_digest
  FROM sized, range(32) t(i) GROUP BY page_id)
SELECT s.page_id, CAST(s.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
  CASE WHEN f.first < s.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < s.page_id THEN f.first END AS refers_to
FROM sized s JOIN firsts f ON s.html = f.html JOIN digits d ON s.page_id = d.page_id
"""


@query("op9_warc", PAGES)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``docs`` in which the tail of every tenth text, by the crc32 of its id, repeats."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w, n):
        a = F.pmod(g, n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    def edited(w):
        return let(F.size(w), lambda n: F.when(n > 0, repeated(w, n)).otherwise(F.lit("")))

    return docs.withColumn("text", F.when(h % 10 == 0, let(words(F.col("text")), edited)).otherwise(F.col("text")))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = periodic.periodic_runs(with_planted_period(docs))
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    return done.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed_text").select(
        "doc_id", "n_runs",
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.col3")).alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


SEARCH = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
corpus AS (SELECT count(*) AS texts, CAST(sum(len(terms)) AS BIGINT) AS all_terms FROM docs WHERE len(terms) > 0),
items AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
spread AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM docs),
times AS (SELECT doc_id, n, term, count(*) AS tf FROM spread WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(texts) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM times, corpus GROUP BY term),
impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * texts) // all_terms)))) AS part
  FROM times JOIN weights USING (term), corpus),
scores AS (
  SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM items JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""


@query("op12_lexical_search", SEARCH)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


RULES = (  # as the query is asked for
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


@query("op13_url_filter")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are split by the words of all pages; what rules have judged teaches the rest."""
    pages = read(spark, sf_dir, "pages")
    counts = url_filter.word_counts(pages, "html")
    return url_filter.judge(pages.select("page_id", "url"), counts, RULES)
