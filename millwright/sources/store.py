"""Keyed tables with merge on read, and one commit for what a batch changes in any of them.

A write leaves a piece: new rows, partial updates or tombstones of one table, dealt to hash buckets of the key.

    <root>/<table>/piece=<id>/bucket=<n>/part-*.parquet
    <root>/_commits/part-*.parquet          (seq, label, table, piece, bucket, merges, added, rows)

A piece counts once a commit lists it, and a commit is one file that Spark moves into place when its job has ended: what a
batch did to several tables appears together or not at all, and pieces of a batch that died stay unseen. Readers merge the
pieces of a bucket by key, newest first; buckets of which one piece of plain rows is left are scanned without a shuffle.
Compaction rewrites the buckets that have gathered pieces and leaves the others alone. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_COMMIT = "seq LONG, label STRING, table STRING, piece STRING, bucket INT, merges BOOLEAN, added BOOLEAN, rows LONG"
_OP = "__op"  # of a stored row: i (whole row), u (columns that are not null replace the stored ones), d (tombstone)


@dataclass(frozen=True)
class Table:
    name: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int = 16


@dataclass(frozen=True)
class Piece:
    """One bucket of one write. ``merges``: it holds updates or tombstones, so it means nothing without older rows."""

    piece: str
    bucket: int
    seq: int
    merges: bool


class Store:
    def __init__(self, spark: SparkSession, root: str, tables: Iterable[Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), {t.name: t for t in tables}

    # ------------------------------------------------------------ commits
    def log(self) -> list:
        """All commit rows in order. They are metadata: a row per written bucket, never per row of a table."""
        try:
            rows = self.spark.read.schema(_COMMIT).parquet(f"{self.root}/_commits").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        return sorted(rows, key=lambda r: r.seq)

    def has(self, label: str) -> bool:
        """Whether a batch of that label was committed."""
        return any(r.label == label for r in self.log())

    def pieces(self, table: str, upto: int | None = None, log: list | None = None) -> list[Piece]:
        """Live pieces of a table, oldest first, as of the commit ``upto`` (all)."""
        live = {}
        for r in self.log() if log is None else log:
            if r.table != table or upto is not None and r.seq > upto:
                continue
            if r.added:
                live[r.piece, r.bucket] = Piece(r.piece, r.bucket, r.seq, r.merges)
            else:
                live.pop((r.piece, r.bucket), None)
        return sorted(live.values(), key=lambda p: p.seq)

    # ------------------------------------------------------------ reading
    def _raw(self, table: Table, pieces: Sequence[Piece]) -> DataFrame:
        layout = StructType([*table.schema.fields, StructField(_OP, StringType()), StructField("piece", StringType()),
                             StructField("bucket", IntegerType())])
        if not pieces:
            return self.spark.createDataFrame([], layout)
        base = f"{self.root}/{table.name}"
        return self.spark.read.schema(layout).option("basePath", base).parquet(
            *[f"{base}/piece={p.piece}/bucket={p.bucket}" for p in pieces])

    def _merged(self, table: Table, pieces: Sequence[Piece]) -> DataFrame:
        """Newest state of every key of these pieces, by one aggregate over (bucket, key)."""
        seqs = {p.piece: p.seq for p in pieces}
        order = self.spark.createDataFrame(list(seqs.items()) or [("", 0)], "piece STRING, __seq LONG")
        rows = self._raw(table, pieces).join(F.broadcast(order), "piece")  # a row per write
        rest = [c for c in table.schema.fieldNames() if c not in table.keys]
        seq, whole = F.col("__seq"), F.col(_OP) == "i"
        last = lambda c: F.max(F.when((F.col(_OP) == "u") & F.col(c).isNotNull(), F.struct("__seq", F.col(c).alias("v"))))
        state = rows.groupBy("bucket", *table.keys).agg(
            F.max(F.when(whole, F.struct("__seq", *rest))).alias("__row"), F.max(F.when(F.col(_OP) == "d", seq)).alias("__gone"),
            *[last(c).alias(f"__u_{c}") for c in rest])
        state = state.where("__row IS NOT NULL AND (__gone IS NULL OR __gone < __row.__seq)")

        def value(c: str) -> Column:
            if c in table.keys:
                return F.col(c)
            newer = F.col(f"__u_{c}")["__seq"] > F.col("__row")["__seq"]
            return F.when(newer, F.col(f"__u_{c}")["v"]).otherwise(F.col("__row")[c]).alias(c)

        return state.select(*[value(c) for c in table.schema.fieldNames()])

    def read(self, name: str, upto: int | None = None) -> DataFrame:
        """Rows of a table, as of the commit ``upto`` (now)."""
        table, by = self.tables[name], {}
        for p in self.pieces(name, upto):
            by.setdefault(p.bucket, []).append(p)
        plain = [ps[0] for ps in by.values() if len(ps) == 1 and not ps[0].merges]
        mixed = [p for ps in by.values() if len(ps) > 1 or ps[0].merges for p in ps]
        rows = self._raw(table, plain).select(*table.schema.fieldNames())
        return rows.unionByName(self._merged(table, mixed)) if mixed else rows

    # ------------------------------------------------------------ writing
    def batch(self, label: str | None = None) -> Batch:
        """Changes that become visible together. A label that was committed before makes the batch do nothing."""
        return Batch(self, label, bool(label) and self.has(label))

    def compact(self, name: str, most: int = 1) -> list[int]:
        """Rewrite the buckets with more than ``most`` pieces, or with one that needs merging; returns their numbers."""
        table, by = self.tables[name], {}
        for p in self.pieces(name):
            by.setdefault(p.bucket, []).append(p)
        chosen = {b: ps for b, ps in by.items() if len(ps) > most or any(p.merges for p in ps)}
        if not chosen:
            return []
        old = [p for ps in chosen.values() for p in ps]
        batch = self.batch()
        batch._write(table, self._merged(table, old), "i")
        batch._changes += [(name, p.piece, p.bucket, p.merges, False, 0) for p in old]
        batch.commit()
        return sorted(chosen)


@dataclass
class Batch:
    store: Store
    label: str | None
    done: bool
    _changes: list = field(default_factory=list)

    def insert(self, name: str, rows: DataFrame) -> int:
        """New rows, or whole new versions of stored ones. Returns how many were written."""
        return self._write(self.store.tables[name], rows, "i")

    def update(self, name: str, changes: DataFrame) -> int:
        """Keys and some columns: values that are not null replace the stored ones; keys that are not stored do nothing."""
        return self._write(self.store.tables[name], changes, "u")

    def delete(self, name: str, keys: DataFrame) -> int:
        table = self.store.tables[name]
        return self._write(table, keys.select(*table.keys).distinct(), "d")

    def _write(self, table: Table, rows: DataFrame, op: str) -> int:
        """One task per bucket and one file per task; a key that repeats fails the write. Rows are counted while written."""
        if self.done:
            return 0
        unknown = set(rows.columns) - set(table.schema.fieldNames())
        if unknown or op == "i" and len(rows.columns) != len(table.schema):
            raise ValueError(f"{table.name} has other columns: {sorted(unknown) or rows.columns}")
        shaped = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                               for f in table.schema])
        bucket = F.pmod(F.xxhash64(*table.keys), F.lit(table.buckets)).cast("int")
        rest = [c for c in table.schema.fieldNames() if c not in table.keys]
        dealt = shaped.withColumn("bucket", bucket).repartition(table.buckets, "bucket")
        once = F.when(F.count("*") > 1, F.raise_error(F.lit(f"several rows of one key of {table.name}"))).otherwise(F.any_value(F.struct(F.lit(0), *rest)))
        one = dealt.groupBy("bucket", *table.keys).agg(once.alias("r")).select(
            *table.keys, *[F.col("r")[c].alias(c) for c in rest], F.lit(op).alias(_OP), "bucket")
        seen = Observation()
        one = one.observe(seen, F.count("*").alias("n"), *[F.max(F.col("bucket") == b).alias(f"b{b}") for b in range(table.buckets)])
        piece = uuid.uuid4().hex[:16]
        one.write.partitionBy("bucket").parquet(f"{self.store.root}/{table.name}/piece={piece}")
        figures = seen.get
        self._changes += [(table.name, piece, b, op != "i", True, figures["n"]) for b in range(table.buckets) if figures[f"b{b}"]]
        return figures["n"]

    def commit(self) -> int | None:
        """Make everything written visible. Returns the number of the commit's last change, or None if there was nothing to do."""
        if self.done:
            return None
        self.done = True
        log = self.store.log()
        start = log[-1].seq + 1 if log else 0
        # Writes keep their order; all buckets of one piece share a number.
        numbers = {piece: start + i for i, piece in enumerate(dict.fromkeys(c[1] for c in self._changes if c[4]))}
        end = max(numbers.values(), default=start)
        rows = [(numbers.get(piece, end) if added else end, self.label, table, piece, bucket, merges, added, n)
                for table, piece, bucket, merges, added, n in self._changes]
        rows = rows or [(start, self.label, "", "", 0, False, False, 0)]
        self.store.spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.store.root}/_commits")
        return end
