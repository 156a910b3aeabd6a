"""WARC archives written and read by Spark, with record boundaries verified by their chain.

Writing: one record per page. Of pages with equal payloads the one with the largest id is a response, the others are revisits of it.
Reading: plain files are split anywhere, gzip files (as written here) are read by a task each; every occurrence of the magic starts a candidate record, also inside a payload. A candidate's header
gives the offset of its successor. A record is real if it is reached from the start of its file along these
offsets; the reachable ones are found by pointer jumping, in as many rounds as the logarithm of the longest chain.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope.llm.common import load, stage, staging_root

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Bytes from which equal payloads are stored once.
LEAST_BYTES = 1000
#: Broken-up records up to which their list is broadcast.
BROADCAST_ROWS = 50_000
#: Groups of equal payloads up to which their keepers are broadcast (about 25 MB); beyond it payloads are shuffled by digest.
BROADCAST_GROUPS = 200_000


def page_records(pages: DataFrame) -> DataFrame:
    """``pages`` as records: a column ``record`` with the header and the block, without the end mark."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).alias("n"), F.sha1(payload.cast("binary")).alias("digest"))
    groups = rows.where(F.col("n") >= LEAST_BYTES).groupBy("digest", "n").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
    groups = stage(groups.where("copies > 1").drop("copies"), "copies")
    few = groups.count() <= BROADCAST_GROUPS
    rows = rows.join(F.broadcast(groups) if few else groups, ["digest", "n"], "left")
    refers = F.when(F.col("page_id") < F.col("keeper"), F.col("keeper"))
    first = refers.isNull()
    block = F.when(first, F.col("payload")).otherwise("")

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))

    def optional(name: str, value: Column) -> Column:
        return F.when(value.isNull(), "").otherwise(line(name, F.coalesce(value.cast("string"), F.lit(""))))

    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(first, "response").otherwise("revisit")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        optional("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        optional("X-Page-Id", F.col("page_id")),
        optional("X-Refers-To-Page", refers),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("X-Payload-Length", F.col("n")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )
    return rows.select(record.alias("record"))


def write_archives(pages: DataFrame, folder: str, most_records: int = 20_000) -> None:
    """Write ``page_id, url, html`` as gzip archives of at most ``most_records`` records each.

    A null ``html`` is an empty payload. A page without an id is always a response. Repeated rows of a payload's largest id are all
    responses, since one page cannot refer to itself. Line breaks in an address become a space. Other columns are not read.
    """
    writer = page_records(pages).write.option("lineSep", END).option("maxRecordsPerFile", most_records).option("compression", "gzip")
    writer.text(folder)


def _field(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"(?:^|\r\n){name}: *([^\r]*)", 1), F.lit(""))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """A row for what stands before the first magic of a file, and one for each occurrence of the magic, in file order."""
    lines = spark.read.option("lineSep", MAGIC).text(folder)
    rows = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"),
        "value",
        F.octet_length("value").alias("n_bytes"),
        F.locate(END, F.col("value")).alias("head_chars"),
    )
    header = F.when(F.col("head_chars") > 0, F.substring("value", F.lit(1), F.col("head_chars") - 1))
    rows = rows.withColumn("header", header)
    rows = rows.withColumn("head_bytes", F.octet_length("header") + len(END)).withColumn("length", _field(F.col("header"), "Content-Length").try_cast("long"))
    content = F.substring(F.col("value").cast("binary"), F.col("head_bytes") + 1, F.col("length").cast("int"))
    return rows.select(
        "file",
        "block",
        "nth",
        "n_bytes",
        "head_bytes",
        "length",
        _field(F.col("header"), "WARC-Type").alias("record_type"),
        _field(F.col("header"), "X-Page-Id").try_cast("long").alias("page_id"),
        _field(F.col("header"), "X-Refers-To-Page").try_cast("long").alias("refers_to"),
        F.regexp_extract("header", r"WARC-Payload-Digest: *sha1:([^\r]*)", 1).alias("stated_digest"),
        _field(F.col("header"), "X-Payload-Length").try_cast("long").alias("stated_length"),
        F.when(F.col("head_bytes") + F.col("length") <= F.col("n_bytes"), F.sha1(content)).alias("own_digest"),
        "value",
    )


def _placed(rows: DataFrame) -> DataFrame:
    """Candidates with their offset ``at``, without what stands before the first magic of a file."""
    before = Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("at", F.sum(F.col("n_bytes") + len(MAGIC)).over(before) - len(MAGIC)).where("at IS NOT NULL")


def reachable(links: DataFrame) -> DataFrame:
    """Of ``file, at, next`` the ``file, at`` on the chain that starts at 0, by pointer jumping."""
    nodes = stage(links.select("file", "at", F.col("next").alias("jump"), (F.col("at") == 0).alias("reached")), "chain")
    count = nodes.where("reached").count()
    while True:
        marks = nodes.where("reached AND jump IS NOT NULL").select("file", F.col("jump").alias("at"), F.lit(True).alias("marked")).distinct()
        jumps = nodes.select("file", F.col("at").alias("jump"), F.col("jump").alias("onward"))
        nodes = nodes.join(marks, ["file", "at"], "left").join(jumps, ["file", "jump"], "left")
        nodes = stage(nodes.select("file", "at", F.col("onward").alias("jump"), (F.col("reached") | F.coalesce("marked", F.lit(False))).alias("reached")), "chain")
        now = nodes.where("reached").count()
        if now == count:
            return nodes.where("reached").select("file", "at")
        count = now


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The real records: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Length and digest of a response are those of the block that was read; a revisit has no block and states them. A file that does not start
    with a record has none. A record that is cut off by the end of its file has a digest of what is there.
    """
    narrow = stage(_placed(candidates(spark, folder).drop("value")), "offsets")
    onward = F.col("at") + len(MAGIC) + F.col("head_bytes") + F.col("length") + len(END)
    real = reachable(narrow.select("file", "at", onward.alias("next")))
    marked = narrow.join(real.withColumn("real", F.lit(True)), ["file", "at"], "left")
    records = marked.where("real").drop("real")
    broken = records.where("own_digest IS NULL AND length IS NOT NULL").select("file", "at")
    records = records.join(_gathered(spark, folder, marked, broken), ["file", "at"], "left") if broken.count() else records.withColumn("gathered", F.lit(None).cast("string"))
    response = F.col("record_type") != "revisit"
    return records.select(
        "page_id",
        F.when(response, F.col("length")).otherwise(F.col("stated_length")).alias("payload_bytes"),
        F.when(response, F.coalesce("own_digest", "gathered")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def _gathered(spark: SparkSession, folder: str, marked: DataFrame, broken: DataFrame) -> DataFrame:
    """Digests of records whose block holds the magic: the block is put together from the candidates inside it.

    Their texts are read again from the files that have such records, and found by their offsets.
    """
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.select("file", "at", F.last(F.when(F.col("real"), F.col("at")), ignorenulls=True).over(upto).alias("owner"))
    parts = stage(owned.join(broken.select("file", F.col("at").alias("owner")), ["file", "owner"], "left_semi"), "broken-records")
    few = parts.count() <= BROADCAST_ROWS
    files = parts.select("file").distinct()
    rows = candidates(spark, folder).select("file", "block", "nth", "n_bytes", "head_bytes", "length", "value")
    rows = _placed(rows.join(F.broadcast(files) if few else files, "file", "left_semi"))
    parts = rows.select("file", "at", "head_bytes", "length", "value").join(F.broadcast(parts) if few else parts, ["file", "at"])
    whole = parts.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "value", "head_bytes", "length"))).alias("parts"))
    first = F.element_at("parts", 1)
    text = F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC)
    content = F.substring(text.cast("binary"), first["head_bytes"] + 1, first["length"].cast("int"))
    return whole.select("file", F.col("owner").alias("at"), F.sha1(content).alias("gathered"))


def op7_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back from them."""
    folder = f"{staging_root(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(load(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder)
