"""WARC archives: writing with Spark's text writer, reading back with boundary-chain verification.

Archives are read in pieces cut at the magic line, in parallel and splittable. Every piece is a candidate record; its
headers give the offset where its successor must begin. Only candidates that the chain of successors reaches from the
start of the file are records; magic lines inside payloads are not reached. The chain is followed by pointer jumping:
each round doubles the length of every pointer, so a file of n records takes about log2(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from millwright.session import fresh_path, staged

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes or of a binary."""
    digest = F.sha1(payload)
    letters = []
    for at in range(1, 41, 5):  # five hex digits are four base32 letters
        value = F.conv(F.substring(digest, at, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1))
                    for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): pages whose payload a smaller page_id has refer to the smallest.

    Payloads under ``min_bytes`` never refer. A null html is an empty payload. Rows without page_id refer to the
    smallest page_id of their payload, if there is one; rows that repeat the smallest page_id are all responses.
    Only payloads that repeat are joined, narrow, so html moves only if these are too many to broadcast.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"),
                         base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    repeats = staged(pages.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                     .where((F.col("n") > 1) & (F.col("bytes") >= min_bytes)).select("digest", "first"), "repeats")
    return pages.join(repeats, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null; control characters cannot end it early."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\x00-\x1F]", " "),
                               F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the rows of ``with_revisits`` as WARC files, one per partition; revisits carry no payload.

    Records end with two line breaks, which is what the text writer puts between lines, so its output files are the
    archives and its commit protocol covers lost executors on any store.
    """
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(_HTTP + GAP), F.when(revisit, "").otherwise(F.col("payload")))
    record = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id"), F.lit(">"))),
        _line("WARC-Target-URI", F.col("url")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\n"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, _PROFILE)),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to"), F.lit(">"))),
        F.lit("Content-Length: "), F.octet_length(block), F.lit(GAP), block)
    pages.select(record.alias("value")).write.option("lineSep", GAP).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select("value", F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nr")))


def _offsets(pieces: DataFrame) -> DataFrame:
    """Adds ``offset``, where the piece's magic line begins: sums inside each split, then over a file's splits."""
    size = F.octet_length("value") + len(MAGIC) if "value" in pieces.columns else F.col("size")
    narrow = pieces.withColumn("size", size.cast("long"))
    inside = Window.partitionBy("file", "split").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)
    whole = narrow.groupBy("file", "split").agg(F.sum("size").alias("whole"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select("file", "split", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("base"))
    return (narrow.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(base, ["file", "split"])
            .withColumn("offset", F.col("base") + F.col("inside") - len(MAGIC)).drop("base", "inside", "size", "split"))


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)\r?$", 1), F.lit(""))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every magic line of the archives under ``path``, parsed as if a record began there.

    ``next`` is where its successor begins (null without a readable length). ``payload_bytes`` and ``payload_digest``
    are those of the payload where the piece holds all of it, else null.
    """
    head = F.substring_index("value", GAP, 1)
    raw = F.col("value").cast("binary")
    p = _pieces(spark, path)
    p = p.select("file", "split", "nr", "value", (F.octet_length("value") + len(MAGIC)).cast("long").alias("size"),
                 head.alias("head"))
    p = p.withColumn("length", _header("Content-Length").cast("long")).withColumn(
        "start", (F.octet_length("head") + len(GAP)).cast("long"))
    http = F.octet_length(F.substring_index("value", GAP, 2)).cast("long") + len(GAP)
    p = p.withColumn("from", F.when(http <= F.col("start") + F.col("length"), http))
    p = p.withColumn("payload_bytes", F.when(F.octet_length("value") >= F.col("start") + F.col("length"),
                                             F.col("start") + F.col("length") - F.col("from")))
    payload = F.substring(raw, F.col("from").cast("int") + 1, F.col("payload_bytes").cast("int"))
    p = p.select("file", "split", "nr", "size", "start", "length", "payload_bytes",
                 F.when(F.col("payload_bytes").isNotNull(), base32_sha1(payload)).alias("payload_digest"),
                 _header("WARC-Type").alias("type"), _header("WARC-Target-URI").alias("url"),
                 F.regexp_extract(F.coalesce(_header("WARC-Record-ID"), F.lit("")), r"<urn:page:(-?\d+)>", 1).alias("id"),
                 F.regexp_extract(F.coalesce(_header("WARC-Refers-To"), F.lit("")), r"<urn:page:(-?\d+)>", 1).alias("to"),
                 _header("WARC-Payload-Digest").alias("digest"))
    p = _offsets(p).where("offset >= 0")
    return p.withColumn("next", F.col("offset") + len(MAGIC) + F.col("start") + F.col("length") + len(GAP)).drop("nr")


def reachable(chain: DataFrame) -> DataFrame:
    """(file, offset) of the candidates of (file, offset, next) that the chain from offset 0 reaches.

    Pointers only lead forward, so pointers backwards (negative lengths) are dropped. A chain that breaks off, as in a
    truncated file, keeps what lies before the break.
    """
    state = staged(chain.select("file", "offset", F.when(F.col("next") > F.col("offset"), F.col("next")).alias("jump"),
                                (F.col("offset") == 0).alias("reached")), "chain")
    while not state.where("reached AND jump IS NOT NULL").isEmpty():
        ahead = state.select("file", F.col("offset").alias("jump"), F.col("jump").alias("further"),
                             F.lit(True).alias("there"))
        step = state.join(ahead, ["file", "jump"], "left")
        moved = step.select("file", "offset", F.col("further").alias("jump"), "reached", F.explode(
            F.when(F.col("reached") & F.coalesce("there", F.lit(False)), F.array(F.lit(False), F.lit(True)))
            .otherwise(F.array(F.lit(False)))).alias("target"), F.col("jump").alias("at"))
        state = staged(moved.groupBy("file", F.when(F.col("target"), F.col("at")).otherwise(F.col("offset")).alias("offset"))
                       .agg(F.max(F.when(~F.col("target"), F.col("jump"))).alias("jump"),
                            F.max("reached").alias("reached")), "chain")
    return state.where("reached").select("file", "offset")


def contents(spark: SparkSession, path: str, found: DataFrame, records: DataFrame) -> DataFrame:
    """(file, offset, payload: binary) of ``records`` (file, offset, start, length), put together from their pieces.

    ``found`` has all candidates, with ``reached``: a piece belongs to the last reached candidate at or before it.
    """
    upto = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = found.select("file", F.col("offset").alias("at"), F.last(F.when(F.col("reached"), F.col("offset")), True)
                         .over(upto).alias("offset"))
    members = owned.join(records.select("file", "offset", "start", "length"), ["file", "offset"])
    pieces = _offsets(_pieces(spark, path)).select("file", F.col("offset").alias("at"), "value")
    whole = (members.join(pieces, ["file", "at"]).groupBy("file", "offset", "start", "length")
             .agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts")))
    text = F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC)
    body = F.substring(text.cast("binary"), F.col("start").cast("int") + 1, F.col("length").cast("int"))
    skip = (F.octet_length(F.substring_index(body.cast("string"), GAP, 1)) + len(GAP)).cast("int")
    return whole.select("file", "offset", F.substring(body, skip + 1, F.col("length").cast("int")).alias("payload"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to) of the records under ``path``.

    Sizes and digests come from the payload bytes read; a revisit's come from the record it refers to. An empty folder
    gives no rows. A response whose bytes don't have the digest in its header fails the read.
    """
    found = staged(candidates(spark, path), "candidates")
    found = staged(found.join(reachable(found).withColumn("reached", F.lit(True)), ["file", "offset"], "left"), "marked")
    records = found.where("reached")
    split = records.where("payload_bytes IS NULL AND length IS NOT NULL")
    if not split.isEmpty():  # payloads that hold magic lines
        joined = contents(spark, path, found, split).select(
            "file", "offset", F.octet_length("payload").cast("long").alias("joined_bytes"),
            base32_sha1(F.col("payload")).alias("joined_digest"))
        records = staged(records.join(joined, ["file", "offset"], "left")
                         .withColumn("payload_bytes", F.coalesce("payload_bytes", "joined_bytes"))
                         .withColumn("payload_digest", F.coalesce("payload_digest", "joined_digest")), "records")
    named = F.regexp_replace("digest", "^sha1:", "")
    records = records.select(F.nullif("id", F.lit("")).cast("long").alias("page_id"), "url", F.col("type").alias("record_type"),
                             F.nullif("to", F.lit("")).cast("long").alias("refers_to"), "payload_bytes",
                             F.when((F.col("type") == "revisit") | (F.col("payload_digest") == named), named)
                             .otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("id"))))
                             .alias("payload_digest"))
    full = (records.where("record_type = 'response' AND page_id IS NOT NULL").groupBy("page_id")
            .agg(F.max("payload_bytes").alias("full_bytes")).withColumnRenamed("page_id", "refers_to"))
    return records.join(full, "refers_to", "left").select(
        "page_id", "url", "record_type", F.coalesce("full_bytes", "payload_bytes").alias("payload_bytes"),
        "payload_digest", "refers_to")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(with_revisits(pages, min_bytes), path)
    return read_archives(spark, path)
