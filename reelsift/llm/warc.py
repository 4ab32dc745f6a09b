"""Write pages as WARC archives and read archives back.

Writing: pages with equal payloads give one response record; the others revisit it.

Reading: tasks cut the archives wherever a record could begin, and state for each such place where
the record that begins there would end. A place is a record's true begin only if the chain of
these ends reaches it from the start of its file. Stretches whose ends follow each other directly
are one link; pointer jumping over the links takes a logarithmic number of rounds. What begins with a
record's magic inside a payload is not reached and stays part of that payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelsift.llm.common import packed
from reelsift.operators.skew import broadcast_if_small
from reelsift.session import materialise, scratch_path

MAGIC = "WARC/1."
BETWEEN = "\r\n\r\n"
CUT = BETWEEN + MAGIC
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Refers-To", "WARC-Payload-Digest")
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 of bytes, in upper-case base32: 40 bits at a time."""
    digest = F.sha1(payload)
    quarters = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*quarters), HEX32, BASE32)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _header(*fields: tuple[str, Column]) -> Column:
    """Header lines of a record; fields that are null are left out."""
    lines = [F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n")) for name, value in fields]
    return F.concat(F.lit(MAGIC + "1\r\n"), *(F.coalesce(x, F.lit("")) for x in lines), F.lit("\r\n"))


def records(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
) -> DataFrame:
    """``page_id`` and the WARC ``record`` of each page, as raw bytes held in a string column.

    Of equal payloads of ``least_bytes`` or more, that of the smallest id is a response and the rest
    revisit it. Null html is an empty payload, null urls are left out, and line ends in urls become
    spaces. Rows that repeat an id and its payload are alike in type. Rows without id are responses.
    """
    given = packed(pages, (), _id=id_col, _url=url_col, _html=html_col)
    payload = F.coalesce(F.col("_html"), F.lit("")).cast("binary")
    page = given.select("_id", "_url", payload.alias("payload")).withColumns(
        {"digest": sha1_base32(F.col("payload")), "bytes": F.octet_length("payload")}
    )
    digests = materialise(page.filter(F.col("bytes") >= least_bytes).select("_id", "digest", "bytes"))
    first = digests.groupBy("digest", "bytes").agg(F.min("_id").alias("first"), F.count("*").alias("n"))
    again = (
        digests.join(broadcast_if_small(materialise(first.filter("n > 1").drop("n"))), ["digest", "bytes"])
        .filter("_id <> first")
        .select(F.col("_id").alias("_of"), F.col("digest").alias("_digest"), "first")
        .distinct()
    )
    again = broadcast_if_small(materialise(again))
    typed = page.join(again, (F.col("_id") == F.col("_of")) & (F.col("digest") == F.col("_digest")), "left")

    revisit = F.col("first").isNotNull()
    http = F.lit(HTTP).cast("binary")
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    header = _header(
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", _record_id(F.col("_id"))),
        ("WARC-Target-URI", F.regexp_replace("_url", r"[\r\n]+", " ")),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Refers-To", _record_id(F.col("first"))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block)),
    )
    record = F.concat(header.cast("binary"), block).cast("string")
    return typed.select(F.col("_id").alias("page_id"), record.alias("record"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = 50_000, **options: object) -> None:
    """Archives below ``path``, one or more for each task, in Spark's own writer."""
    (
        records(pages, **options)
        .select("record")
        .write.option("lineSep", BETWEEN)
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def _field(head: Column, name: str) -> Column:
    value = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(value != "", value)


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every stretch between possible record begins: where it lies and what it would be."""
    text = spark.read.option("lineSep", CUT).text(path)
    place = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"),
        F.col("value").cast("binary").alias("raw"),
    )
    mark = F.lit(BETWEEN).cast("binary")
    head_end = F.position(mark, F.col("raw"))
    return place.withColumn("head_end", head_end).withColumn(
        "head", F.when(F.col("head_end") > 0, F.substring(F.col("raw"), F.lit(1), F.col("head_end") + 1).cast("string"))
    )


def _located(stretches: DataFrame) -> DataFrame:
    """Add ``start``: the byte of its file at which a stretch's record would begin.

    Stretches follow each other in a split and splits follow each other in a file, so a begin is the
    sum of the lengths before it, first by split.
    """
    cut, magic = len(CUT), len(MAGIC)
    split = Window.partitionBy("file", "block")
    so_far = split.orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    totals = stretches.groupBy("file", "block").agg(F.sum(F.col("size") + cut).alias("total"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("before", F.coalesce(F.sum("total").over(earlier), F.lit(0))).drop("total")
    begin = F.col("before") + F.sum(F.col("size") + cut).over(so_far) - F.col("size") - cut
    placed = stretches.join(broadcast_if_small(materialise(offsets)), ["file", "block"]).withColumn("begin", begin)
    # the first stretch has the magic in it; the others come after theirs
    return placed.withColumn("start", F.when(F.col("begin") == 0, F.lit(0)).otherwise(F.col("begin") - magic)).drop("before")


def _reached(candidates: DataFrame) -> DataFrame:
    """``file, start`` of the records that the chain of ends reaches from the start of their file."""
    by_start = Window.partitionBy("file").orderBy("start")
    linked = candidates.select("file", "start", "end").withColumn(
        "breaks", ~F.col("end").eqNullSafe(F.lead("start").over(by_start))
    )
    # a link is a run of candidates each of which ends where the next begins
    links = materialise(
        linked.withColumn(
            "link",
            F.coalesce(F.sum(F.col("breaks").cast("int")).over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
    )
    jumps = (
        links.filter("breaks")
        .select("file", "link", F.col("end").alias("start"))
        .join(links.select("file", "start", F.col("link").alias("to")), ["file", "start"])
        .select("file", "link", "to", F.col("start").alias("entry"))
    )
    jumps = materialise(jumps.filter("to > link"))
    reached = materialise(links.filter("start = 0").select("file", "link", F.col("start").alias("entry")))
    known = reached.count()
    while not jumps.isEmpty():
        onward = reached.join(jumps.withColumnRenamed("entry", "enter"), ["file", "link"]).select(
            "file", F.col("to").alias("link"), F.col("enter").alias("entry")
        )
        reached = materialise(reached.union(onward).distinct())
        now = reached.count()
        if now == known:
            break
        known = now
        further = jumps.select("file", F.col("link").alias("to"), F.col("to").alias("last"), F.col("entry").alias("enter"))
        jumps = materialise(
            jumps.drop("entry").join(further, ["file", "to"]).select("file", "link", F.col("last").alias("to"), F.col("enter").alias("entry"))
        )
    return links.join(broadcast_if_small(reached), ["file", "link"]).filter("start >= entry").select("file", "start")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The true records below ``path``: ``record_type, record_id, uri, refers_to, payload_digest`` (as
    stated), ``payload`` and ``payload_bytes``.

    The payload is what follows the HTTP header of the block, or the block where there is none. Files
    without any record give none; a chain that breaks off keeps the records before the break.
    """
    cut, magic = len(CUT), len(MAGIC)
    stretches = _candidates(spark, path)
    narrow = materialise(
        stretches.select(
            "file", "block", "nth", F.octet_length("raw").alias("size"), "head_end",
            _field(F.col("head"), "Content-Length").try_cast("long").alias("length"),
            _field(F.col("head"), "WARC-Type").alias("record_type"),
            _field(F.col("head"), "WARC-Record-ID").alias("record_id"),
            _field(F.col("head"), "WARC-Target-URI").alias("uri"),
            _field(F.col("head"), "WARC-Refers-To").alias("refers_to"),
            _field(F.col("head"), "WARC-Payload-Digest").alias("payload_digest"),
        )
    )
    located = _located(narrow)
    body = F.col("begin") + F.col("head_end") + len(BETWEEN) - 1  # where the block begins
    ended = located.withColumns(
        {"body": body, "end": F.when((F.col("head_end") > 0) & (F.col("length") >= 0), body + F.col("length") + len(BETWEEN))}
    )
    located = materialise(ended)
    true = _reached(located.filter("end IS NOT NULL")).withColumn("true", F.lit(True))
    marked = located.join(true, ["file", "start"], "left")
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("true"), F.struct("start", "body", "length")), ignorenulls=True).over(upto)
    owned = materialise(
        marked.withColumn("owner", owner)
        .filter(F.col("owner").isNotNull() & (F.col("begin") < F.col("owner.body") + F.col("owner.length") + len(BETWEEN) + magic))
        .drop("head_end", "end")
    )
    # a record that lies in one stretch is read where it is; the others, few, are put together
    place, named = ["file", "block", "nth"], ("record_type", "record_id", "uri", "refers_to", "payload_digest")
    inside = F.col("true") & (F.col("begin") + F.col("size") >= F.col("body") + F.col("length"))
    apart = materialise(marked.filter(~F.coalesce(inside, F.lit(False))).select(*place))
    alone = stretches.join(broadcast_if_small(apart), place, "left_anti")
    length = _field(F.col("head"), "Content-Length").cast("long")
    single = alone.select(
        *(_field(F.col("head"), name).alias(alias) for name, alias in zip(FIELDS, named, strict=True)),
        F.substring(F.col("raw"), (F.col("head_end") + len(BETWEEN)).cast("int"), length.cast("int")).alias("content"),
    )
    parts = owned.join(broadcast_if_small(apart), place, "left_semi")
    data = stretches.select(*place, "raw").join(broadcast_if_small(parts), place)
    raw = F.when(F.col("true"), F.col("raw")).otherwise(F.concat(F.lit(CUT).cast("binary"), F.col("raw")))
    at = F.when(F.col("true"), F.col("begin")).otherwise(F.col("begin") - cut)
    skip = F.greatest(F.lit(0), F.col("owner.body") - F.col("at"))
    keep = F.greatest(F.lit(0), F.col("owner.body") + F.col("owner.length") - F.col("at") - skip)
    pieces = data.withColumn("raw", raw).withColumn("at", at).withColumn(
        "piece", F.substring(F.col("raw"), (skip + 1).cast("int"), keep.cast("int"))
    )
    several = (
        pieces.groupBy("file", F.col("owner.start").alias("start"))
        .agg(
            *(F.max(F.when(F.col("true"), F.col(c))).alias(c) for c in named),
            F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("all"),
        )
        .select(*named, F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x["piece"])).alias("content"))
    )
    content = F.col("content")
    http = F.substring(content, 1, 5) == F.lit(b"HTTP/")
    end = F.position(F.lit(BETWEEN).cast("binary"), content)
    payload = F.when(http & (end > 0), F.substring(content, end + len(BETWEEN), F.octet_length(content))).otherwise(content)
    return single.unionByName(several).select(*named, payload.alias("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives of ``pages``, read them back, and state for each record what it is.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``; bytes and digest are those of the
    full payload, for revisits those of the response they refer to.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType

    def page(record_id: str) -> Column:
        return F.regexp_extract(record_id, "^<urn:page:(.*)>$", 1).try_cast(kind)

    found = materialise(
        read_archives(spark, path).select(
            page("record_id").alias("page_id"), "record_type", page("refers_to").alias("refers_to"),
            "payload_bytes", sha1_base32(F.col("payload")).alias("payload_digest"),
            F.regexp_replace("payload_digest", "^sha1:", "").alias("stated"),
        )
    )
    response = found.filter("record_type = 'response'").select(
        F.col("page_id").alias("_of"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")
    ).distinct()
    same = (F.col("refers_to") == F.col("_of")) & (F.col("stated") == F.col("_digest"))
    full = found.join(response, same, "left")
    revisit = F.col("record_type") == "revisit"
    return full.select(
        "page_id",
        F.when(revisit, F.col("_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
