"""Table sources and sinks: CSV landing files, parquet stages, appends, keyed updates and deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.schemas import RAW_TABLES, SCHEMAS
from millwright.session import fresh_path, staged

SEARCH_COLUMNS = ("card_id", "search_text", "card_type", "asset_id", "failure_mode", "outcome", "symptom_summary",
                  "action_taken", "source_type", "source_id", "source_excerpt", "author_name", "confidence",
                  "is_stale")

#: Landing tables without free text: no line breaks inside quotes, so their files can be split among tasks.
SINGLE_LINE = ("assets", "technicians", "spare_parts", "production_log", "sensor_readings")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_csv(spark: SparkSession, directory: str, name: str, schema=None) -> DataFrame:
    """Landing files ``<name>*.csv`` or ``.csv.gz``: header, quoted, empty is NULL, a bad row fails the load."""
    return (spark.read.schema(schema or SCHEMAS[name])
            .option("header", True).option("quote", '"').option("escape", '"').option("multiLine", name not in SINGLE_LINE)
            .option("nullValue", "").option("mode", "FAILFAST").option("enforceSchema", False)
            .option("pathGlobFilter", f"{name}*.csv*")
            .csv(directory))


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """The same CSV dialect as :func:`load_csv`."""
    (df.write.option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "")
     .option("emptyValue", "").option("compression", compression).csv(path))


def refresh_raw(spark: SparkSession, src: str, dst: str, names=RAW_TABLES) -> None:
    """Reload landing tables in full from CSV into parquet."""
    for name in names:
        cluster = ["asset_id", "ts"] if name == "sensor_readings" else None
        write_table(load_csv(spark, src, name), f"{dst}/{name}", cluster)


def write_table(df: DataFrame, path: str, cluster: list[str] | None = None) -> DataFrame:
    """Overwrite a stored table; with ``cluster`` it is range-partitioned and sorted, so row groups can be skipped.

    Range bounds cover every cluster column, so one hot leading key is spread over many files.
    """
    if cluster:
        df = df.repartitionByRange(*cluster).sortWithinPartitions(*cluster)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored table, or an empty frame of that schema when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # Known to be empty when planned, so a join with it moves nothing.
        return spark.range(1).limit(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def new_rows(df: DataFrame, stored: DataFrame, keys: list[str], seldom: list[str] | None = None) -> DataFrame:
    """Rows whose key is not stored yet; duplicates inside the batch collapse to one.

    Where wide rows seldom repeat, ``seldom`` names some of the keys: only rows that share a whole key with another have
    all rows of their ``seldom`` values compared; the others stay where they are. The batch is then read three times.
    """
    if seldom is None:
        once = df.dropDuplicates(keys)
    else:
        twice = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").select(
            *[F.col(c).alias(f"__{c}") for c in seldom]).distinct()
        twice = staged(twice, "repeated")
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in seldom]
        once = df.join(twice, same, "left_anti").unionByName(df.join(twice, same, "left_semi").dropDuplicates(keys))
    return once.join(stored.select(*keys), keys, "left_anti")


def append_new(df: DataFrame, path: str, keys: list[str], seldom: list[str] | None = None) -> DataFrame:
    """Append only rows with unseen keys and return the table."""
    spark = df.sparkSession
    stored = read_table(spark, path, df.schema)
    new_rows(df, stored, keys, seldom).write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def search_docs(cards: DataFrame) -> DataFrame:
    """The columns a search index reads."""
    return cards.select(*SEARCH_COLUMNS)


def refresh_search_docs(cards: DataFrame, path: str | None = None) -> DataFrame:
    """Replace the stored search copy. It is written to a new version path, so readers never see half a table."""
    spark = cards.sparkSession
    target = f"{path}/{fresh_path(spark, 'v').rsplit('/', 1)[1]}" if path else fresh_path(spark, "search_docs")
    docs = search_docs(cards)
    docs.write.parquet(target)
    return spark.read.schema(docs.schema).parquet(target)


def update_by_key(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """New version of ``df`` where non-NULL values of ``changes`` replace the stored ones for matching keys.

    A key that ``changes`` repeats and ``df`` holds fails the query: which change would count is undefined.
    """
    changed = [c for c in changes.columns if c not in keys]
    new = changes.groupBy(*keys).agg(F.count("*").alias("__times"), *[F.first(c).alias(f"__new_{c}") for c in changed])
    joined = df.join(new, keys, "left")
    once = F.when(F.col("__times") > 1, F.raise_error(F.lit("several changes of one key")))
    return joined.select(*[
        once.otherwise(F.coalesce(F.col(f"__new_{c}"), F.col(c))).alias(c) if c in changed else F.col(c)
        for c in df.columns])


def delete_by_key(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not listed."""
    return df.join(keys.distinct(), keys.columns, "left_anti")


def delete_like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose id does not match a LIKE pattern; NULL ids stay."""
    return df.filter(~F.coalesce(F.col(column).like(pattern), F.lit(False)))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, n) for every table."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def by_id(df: DataFrame, column: str, value) -> DataFrame:
    """Point lookup; the predicate reaches the scan."""
    return df.filter(F.col(column) == F.lit(value))
