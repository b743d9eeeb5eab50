"""Landing files to stored tables, with a ledger of what was loaded and a table of what was refused.

A load lists the folder, which reads no content, and takes the files that the ledger does not know by name, size and time. Their
lines are summed up to a checksum, so a file that was only copied or renamed is entered but not loaded again. Every row of the
others is read as text and cast column by column: rows that don't fit go to ``rejected_rows`` with their reasons, the rest to the
table, and both together with the ledger are one commit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from millwright.schemas import PRIMARY_KEYS, SCHEMAS
from millwright.session import staged
from millwright.sources.store import Store, Table
from millwright.sources.tables import SINGLE_LINE

_TEXT = StringType()
LEDGER = StructType([StructField("tbl", _TEXT), StructField("file", _TEXT), StructField("size", LongType()),
                     StructField("modified", TimestampType()), StructField("checksum", _TEXT), StructField("n_loaded", LongType()),
                     StructField("n_rejected", LongType()), StructField("same_as", _TEXT)])
REJECTED = StructType([StructField("tbl", _TEXT), StructField("file", _TEXT), StructField("record", _TEXT), StructField("reasons", _TEXT),
                       StructField("n", LongType())])
KEYS = {**PRIMARY_KEYS, "sensor_readings": ["asset_id", "ts"]}
_BAD = "__corrupt"


def open_landing(spark: SparkSession, root: str, names=tuple(KEYS), buckets: int = 16) -> Store:
    """The store of the landing tables ``names``, the ledger and the refused rows."""
    return Store(spark, root, [*[Table(n, SCHEMAS[n], tuple(KEYS[n]), buckets) for n in names],
                               Table("load_ledger", LEDGER, ("tbl", "file"), 1),
                               Table("rejected_rows", REJECTED, ("tbl", "file", "record"), buckets)])


def _listed(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """(file, size, modified) of ``<name>*.csv`` and ``.csv.gz``; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{name}*.csv*").option("recursiveFileLookup", True).load(directory)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", F.col("length").alias("size"),
                        F.col("modificationTime").alias("modified"))


def _checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, checksum): number of lines and the sum of their hashes, whatever their order."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_name").alias("file"), F.xxhash64("value").cast("decimal(38,0)").alias("h"))
    return lines.groupBy("file").agg(F.concat_ws(":", F.count("*").cast("string"), F.sum("h").cast("string")).alias("checksum"))


def read_checked(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    """Rows of landing files with their file, the cast columns, the record as JSON and ``reasons`` (empty: the row fits)."""
    schema = SCHEMAS[name]
    raw = StructType([*[StructField(f.name, StringType()) for f in schema], StructField(_BAD, StringType())])
    rows = (spark.read.schema(raw).option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", name not in SINGLE_LINE).option("nullValue", "").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", _BAD).csv(paths))
    rows = rows.select("*", F.col("_metadata.file_name").alias("file"))
    cast = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema}
    reasons: list[Column] = [F.when(F.col(_BAD).isNotNull(), F.lit("wrong number of columns"))]
    reasons += [F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in KEYS[name]]
    reasons += [F.when(F.col(c).isNotNull() & v.isNull(), F.lit(f"{c} is no {schema[c].dataType.simpleString()}")) for c, v in cast.items()]
    record = F.coalesce(F.col(_BAD), F.to_json(F.struct(*schema.fieldNames())))
    return rows.select("file", *[v.alias(c) for c, v in cast.items()], record.alias("record"), F.array_compact(F.array(*reasons)).alias("reasons"))


def _load_table(store: Store, batch, directory: str, name: str, known: DataFrame) -> DataFrame | None:
    """Write what is new for one table into the batch; returns its ledger rows."""
    spark, schema, keys = store.spark, SCHEMAS[name], KEYS[name]
    own = known.where(F.col("tbl") == name)
    listed = _listed(spark, directory, name).join(own.select("file", "size", "modified"), ["file", "size", "modified"], "left_anti")
    new = listed.collect()  # a row per file
    if not new:
        return None
    files = spark.createDataFrame([(r.file, r.size, r.modified) for r in new], "file STRING, size LONG, modified TIMESTAMP")
    files = files.join(_checksums(spark, [r.path for r in new]), "file", "left").withColumn("checksum", F.coalesce("checksum", F.lit("0")))
    # The same content again: loaded before under another name or time, or twice in this folder.
    before = own.groupBy("size", "checksum").agg(F.min("file").alias("before"))
    first = Window.partitionBy("size", "checksum").orderBy("file")
    files = files.join(before, ["size", "checksum"], "left").withColumn(
        "same_as", F.coalesce("before", F.when(F.row_number().over(first) > 1, F.first("file").over(first))))
    files = staged(files.select("file", "size", "modified", "checksum", "same_as"), "files")
    todo = {r.file for r in files.where("same_as IS NULL").select("file").collect()}
    counts = spark.createDataFrame([], "file STRING, n_loaded LONG, n_rejected LONG")
    if todo:
        rows = staged(read_checked(spark, [r.path for r in new if r.file in todo], name), "landed")
        fits = F.size("reasons") == 0
        # Of rows that share a key the first by file and content counts; a window of one key's rows.
        by_key = Window.partitionBy(*keys).orderBy("file", "record")
        good = rows.where(fits).withColumn("__nth", F.row_number().over(by_key))
        again = good.where("__nth > 1").withColumn("reasons", F.array(F.lit("repeats a key")))
        good, refused = good.where("__nth = 1"), rows.where(~fits).unionByName(again.drop("__nth"))
        good, refused = staged(good, "good"), staged(refused, "refused")
        batch.insert(name, good.select(*schema.fieldNames()))
        batch.insert("rejected_rows", refused.groupBy("file", "record").agg(
            F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))), "; ").alias("reasons"), F.count("*").alias("n"))
            .select(F.lit(name).alias("tbl"), "file", "record", "reasons", "n"))
        counts = good.select("file", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
            refused.select("file", F.lit(0).alias("l"), F.lit(1).alias("r"))).groupBy("file").agg(
            F.sum("l").alias("n_loaded"), F.sum("r").alias("n_rejected"))
    zero = F.lit(0).cast("long")
    return files.join(counts, "file", "left").select(
        F.lit(name).alias("tbl"), "file", "size", "modified", "checksum", F.coalesce("n_loaded", zero).alias("n_loaded"),
        F.coalesce("n_rejected", zero).alias("n_rejected"), "same_as")


def load_landing(store: Store, directory: str, names=None, label: str | None = None) -> DataFrame:
    """Load what is new in ``directory`` into the tables of ``store``; returns the ledger rows of this load.

    A key that is stored already gets the newly landed row. A run that dies leaves nothing visible; the next one takes its files.
    """
    names = [n for n in store.tables if n not in ("load_ledger", "rejected_rows")] if names is None else list(names)
    batch = store.batch(label)
    none = store.spark.createDataFrame([], LEDGER)
    if batch.done:
        return none
    known = staged(store.read("load_ledger"), "ledger")
    entries = [e for e in (_load_table(store, batch, directory, n, known) for n in names) if e is not None]
    if not entries:
        return none
    ledger = staged(reduce(DataFrame.unionByName, entries), "entries")
    batch.insert("load_ledger", ledger)
    batch.commit()
    return ledger
