"""Readings stored by day and hashed key, so that a slice of each key's own time opens only the folders it needs.

    <path>/slots=<n>/rows/stored_batch=<name>/stored_cell=<yyyy-MM-dd>.<slot>/part-*.parquet
    <path>/slots=<n>/newest/stored_batch=<name>/part-*.parquet      (key, newest time)

Day and slot are one partition column: keys that stopped at different times need different days, and two columns would be pruned as
a rectangle of all days and all slots. A batch counts once its newest times are written, which happens last; a batch of the same
name replaces its own folders, so one that died is run again. Rows of a hot key on one day are spread over tasks by time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millwright.functions.exprs import add_days
from millwright.session import staged
from millwright.sources.tables import read_table

_BATCH, _CELL = "stored_batch", "stored_cell"


@dataclass(frozen=True)
class DayTable:
    """``slots``: hash slots of the key per day; a table is read with the number it was written with."""

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    ts: str
    slots: int = 16

    def _folder(self, kind: str) -> str:
        return f"{self.path.rstrip('/')}/slots={self.slots}/{kind}"

    def _cell(self, day: Column) -> Column:
        """Rows without a time lie in a folder that no slice opens."""
        slot = F.pmod(F.xxhash64(self.key), F.lit(self.slots)).cast("string")
        return F.concat_ws(".", F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("none")), slot)

    def append(self, rows: DataFrame, batch: str) -> None:
        """Store ``rows`` as the batch of that name."""
        folder = f"{self._folder('rows')}/{_BATCH}={batch}"
        dealt = rows.select(*self.schema.fieldNames()).withColumn(_CELL, self._cell(F.col(self.ts)))
        dealt = dealt.repartitionByRange(_CELL, self.ts).sortWithinPartitions(_CELL, self.key, self.ts)
        dealt.write.mode("overwrite").partitionBy(_CELL).parquet(folder)
        stored = self.spark.read.schema(self.schema).parquet(folder).groupBy(self.key).agg(F.max(self.ts).alias(self.ts))
        stored.write.mode("overwrite").parquet(f"{self._folder('newest')}/{_BATCH}={batch}")

    def _summaries(self) -> DataFrame:
        narrow = StructType([self.schema[self.key], self.schema[self.ts], StructField(_BATCH, StringType())])
        return read_table(self.spark, self._folder("newest"), narrow)

    def newest(self) -> DataFrame:
        """(key, max_ts), from what was noted on writing: a row per key and batch is read, no readings."""
        return self._summaries().groupBy(self.key).agg(F.max(self.ts).alias("max_ts"))

    def read(self) -> DataFrame:
        return self._rows().select(*self.schema.fieldNames())

    def _rows(self) -> DataFrame:
        batches = [r[0] for r in self._summaries().select(_BATCH).distinct().collect()]  # a name per write
        layout = StructType([*self.schema.fields, StructField(_BATCH, StringType()), StructField(_CELL, StringType())])
        return read_table(self.spark, self._folder("rows"), layout).where(F.col(_BATCH).isin(batches) if batches else F.lit(False))

    def of_days(self, spans: DataFrame, first: str, last: str) -> DataFrame:
        """Rows of the folders that hold the days from ``first`` to ``last`` (columns of ``spans``) of its keys.

        The names of the folders wanted, at most one per day and slot, are listed on the driver, which lists the table's folders anyway.
        """
        days = spans.where(F.col(first) <= F.col(last)).withColumn("day", F.explode(F.sequence(F.to_date(first), F.to_date(last))))
        cells = [r[0] for r in days.select(self._cell(F.col("day")).alias(_CELL)).distinct().collect()]
        return self._rows().where(F.col(_CELL).isin(cells) if cells else F.lit(False)).select(*self.schema.fieldNames())

    def trailing(self, days: int) -> tuple[DataFrame, DataFrame]:
        """Rows of the folders that hold each key's last ``days`` days, and (key, max_ts)."""
        newest = staged(self.newest(), "newest")
        spans = newest.withColumn("oldest", add_days(F.col("max_ts"), -days))
        return self.of_days(spans, "oldest", "max_ts"), newest
