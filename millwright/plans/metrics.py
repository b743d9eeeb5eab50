"""A metric layer: tables, many-to-one relationships, facts, dimensions and metrics, queried by name or synonym.

Metrics that are measures can be stored as their parts (sums and counts) by some dimensions. A question is answered from the
smallest stored aggregate that has its metrics and dimensions, by adding up parts; only what none covers reads base tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millwright.functions.exprs import boundary_diff
from millwright.session import fresh_path

Expr = Callable[[], Column]


def _c(name: str) -> Expr:
    return lambda: F.col(name)


@dataclass(frozen=True)
class Measure:
    """An aggregate that parts add up to: the ``count`` or ``sum`` of a value, or its ``mean``, divided by ``per``."""

    kind: str
    value: Expr
    per: float = 1

    def __call__(self) -> Column:
        return self._scaled({"count": F.count, "sum": F.sum, "mean": F.avg}[self.kind](self.value()))

    def _scaled(self, found: Column) -> Column:
        return found if self.per == 1 else found / self.per

    def parts(self, name: str) -> dict[str, Column]:
        """What is stored for this measure, over rows."""
        found = {} if self.kind == "count" else {f"{name}__sum": F.sum(self.value())}
        return found if self.kind == "sum" else found | {f"{name}__n": F.count(self.value())}

    def combined(self, name: str) -> Column:
        """The measure over stored parts."""
        total, n = F.sum(f"{name}__sum"), F.coalesce(F.sum(f"{name}__n"), F.lit(0))
        return self._scaled({"count": n, "sum": total, "mean": F.try_divide(total, n)}[self.kind])


@dataclass(frozen=True)
class MetricModel:
    """``relationships``: (table, foreign key) to the referenced table, joined on its key.

    Facts and dimensions are row expressions of their table; metrics are aggregates over columns and facts. Public
    names are unique per table and written ``table.name``.
    """

    keys: dict[str, tuple]
    relationships: dict[tuple, str]
    facts: dict[str, dict[str, Expr]]
    dimensions: dict[str, dict[str, Expr]]
    metrics: dict[str, dict[str, Expr]]
    synonyms: dict[str, tuple] = field(default_factory=dict)


PLANT_MODEL = MetricModel(
    keys={"assets": ("asset_id",), "technicians": ("technician_id",), "oee_daily": ("asset_id", "oee_date"),
          "line_oee": ("line_id", "oee_date"), "work_orders": ("wo_id",), "spare_parts": ("part_id",)},
    relationships={("oee_daily", "asset_id"): "assets", ("work_orders", "asset_id"): "assets",
                   ("work_orders", "technician_id"): "technicians"},
    facts={
        "oee_daily": {"planned_min": _c("planned_min"), "run_min": _c("run_min"),
                      "oee_downtime_min": _c("downtime_min"), "total_count": _c("total_count"),
                      "good_count": _c("good_count"), "scrap_count": _c("scrap_count")},
        "work_orders": {"wo_downtime_min": _c("downtime_min"),
                        "repair_minutes": lambda: boundary_diff("minute", F.col("reported_at"), F.col("closed_at"))},
        "spare_parts": {"stock_qty": _c("stock_qty"), "reorder_point": _c("reorder_point"),
                        "lead_time_days": _c("lead_time_days")},
    },
    dimensions={
        "assets": {"asset_id": _c("asset_id"), "asset_type": _c("asset_type"), "asset_line_id": _c("line_id")},
        "technicians": {"full_name": _c("full_name"), "seniority": _c("seniority"),
                        "retiring_2027": _c("retiring_2027")},
        "oee_daily": {"oee_date": _c("oee_date"), "oee_line_id": _c("line_id")},
        "line_oee": {"line_id": _c("line_id"), "line_oee_date": _c("oee_date")},
        "work_orders": {"wo_type": _c("wo_type"), "failure_mode_code": _c("failure_mode_code"),
                        "reported_at": _c("reported_at"), "wo_asset_id": _c("asset_id")},
        "spare_parts": {"part_id": _c("part_id"), "description": _c("description")},
    },
    metrics={
        "oee_daily": {f"avg_{c}": Measure("mean", _c(c)) for c in ("oee", "availability", "performance", "quality")},
        "line_oee": {"avg_line_oee": Measure("mean", _c("oee"))},
        "work_orders": {"breakdowns": Measure("count", _c("wo_id")),
                        "total_downtime_min": Measure("sum", _c("wo_downtime_min")),
                        "mttr_hours": Measure("mean", _c("repair_minutes"), per=60)},
        "spare_parts": {"parts_below_reorder": Measure(
            "count", lambda: F.when(F.col("stock_qty") <= F.col("reorder_point"), 1))},
    },
    synonyms={"assets": ("machines", "equipment"), "technicians": ("techs", "maintenance staff"),
              "work_orders": ("jobs", "breakdowns", "repairs"), "spare_parts": ("spares", "inventory"),
              "technicians.full_name": ("technician", "technician name"),
              "line_oee.line_id": ("line", "production line"),
              "work_orders.failure_mode_code": ("downtime cause", "failure mode")},
)


def _with_dimensions(model: MetricModel, tables: dict[str, DataFrame], base: str, dims: list[tuple]) -> DataFrame:
    """Facts of the base table plus every wanted dimension, following many-to-one relationships only as needed."""
    facts = {n: e() for n, e in model.facts.get(base, {}).items() if n not in tables[base].columns}
    df = tables[base].withColumns({**facts, **{f"{t}__{d}": model.dimensions[t][d]() for t, d in dims if t == base}})
    for other in sorted({t for t, _ in dims if t != base}):
        links = [fk for (table, fk), target in model.relationships.items() if table == base and target == other]
        if not links:
            raise ValueError(f"{base} has no relationship to {other}")
        wanted = [model.dimensions[other][d]().alias(f"{t}__{d}") for t, d in dims if t == other]
        side = tables[other].select(F.col(model.keys[other][0]).alias("__key"), *wanted)
        df = df.join(side, df[links[0]] == side["__key"], "left").drop("__key")
    return df


def metric_query(model: MetricModel, tables: dict[str, DataFrame], metrics: list[str], dims: list[str],
                 where: Column | None = None) -> DataFrame:
    """Aggregate metrics by dimensions, all given as ``table.name``; result columns carry the bare names.

    ``where`` may use raw columns of the metric's table and dimensions as ``table__name``. Metrics of different
    tables are computed separately and merged on the dimensions.
    """
    wanted = [tuple(d.split(".", 1)) for d in dims]
    for t, d in wanted:
        if d not in model.dimensions.get(t, {}):
            raise ValueError(f"unknown dimension {t}.{d}")
    by_table: dict[str, list[str]] = {}
    for m in metrics:
        t, name = m.split(".", 1)
        if name not in model.metrics.get(t, {}):
            raise ValueError(f"unknown metric {m}")
        by_table.setdefault(t, []).append(name)
    groups = [F.col(f"{t}__{d}").alias(d) for t, d in wanted]
    names = [d for _, d in wanted]
    results = []
    for table, wanted_metrics in by_table.items():
        df = _with_dimensions(model, tables, table, wanted)
        df = df if where is None else df.filter(where)
        results.append(df.groupBy(*groups).agg(*[model.metrics[table][m]().alias(m) for m in wanted_metrics]))
    return _side_by_side(results, names)


def _side_by_side(results: list[DataFrame], names: list[str]) -> DataFrame:
    """Metrics of different tables in one row per group."""
    merged = results[0]
    for r in results[1:]:
        merged = merged.unionByName(r, allowMissingColumns=True)
    if len(results) == 1:
        return merged
    return merged.groupBy(*names).agg(*[F.max(c).alias(c) for c in merged.columns if c not in names])


# ---------------------------------------------------------------- names
def resolve(model: MetricModel, name: str, kind: str = "dimensions") -> str:
    """The public ``table.name`` of a dimension or metric (``kind``) that a user calls by that name or a synonym.

    ``jobs.mttr hours``, ``technician`` and ``work_orders.mttr_hours`` all work; case and underscores don't matter. A name that
    fits nothing, or several things, is a ValueError.
    """
    def plain(text: str) -> str:
        return " ".join(text.lower().replace("_", " ").split())

    asked, found = plain(name), []
    for table, names in getattr(model, kind).items():
        owners = {plain(t) for t in (table, *model.synonyms.get(table, ()))}
        for n in names:
            public = f"{table}.{n}"
            if asked == plain(public):
                return public
            calls = {plain(c) for c in (n, *model.synonyms.get(public, ()))}
            if asked in calls or asked in {f"{o}.{c}" for o in owners for c in calls}:
                found.append(public)
    if len(found) != 1:
        raise ValueError(f"{name} could be any of {found}" if found else f"nothing in {kind} is called {name}")
    return found[0]


# ---------------------------------------------------------------- stored aggregates
@dataclass(frozen=True)
class Aggregate:
    """Parts of the measures ``metrics`` of one table by ``dims`` (``table.name``), in so many stored rows."""

    table: str
    metrics: tuple[str, ...]
    dims: tuple[str, ...]
    frame: DataFrame
    rows: int

    def covers(self, table: str, metrics: Sequence[str], dims: Sequence[str]) -> bool:
        return self.table == table and set(metrics) <= set(self.metrics) and set(dims) <= set(self.dims)


def _smallest(aggregates: Sequence[Aggregate], table: str, metrics: Sequence[str], dims: Sequence[str]) -> Aggregate | None:
    return min((a for a in aggregates if a.covers(table, metrics, dims)), key=lambda a: a.rows, default=None)


def _flat(dim: str) -> str:
    return dim.replace(".", "__", 1)


def store_aggregate(model: MetricModel, tables: dict[str, DataFrame], table: str, metrics: Sequence[str], dims: Sequence[str],
                    stored: Sequence[Aggregate] = (), path: str | None = None) -> Aggregate:
    """Write the parts of ``metrics`` of ``table`` by ``dims``, from the smallest of ``stored`` that covers them or from the base
    tables. Rows are counted by the write itself. Metrics and dimensions may be called by synonyms."""
    chosen = [resolve(model, f"{table}.{m}", "metrics").split(".", 1)[1] for m in metrics]
    by = [resolve(model, d) for d in dims]
    measures = {m: model.metrics[table][m] for m in chosen}
    plain = [m for m, e in measures.items() if not isinstance(e, Measure)]
    if plain:
        raise ValueError(f"no parts add up to {plain}")
    source = _smallest(stored, table, chosen, by)
    if source is None:
        base = _with_dimensions(model, tables, table, [tuple(d.split(".", 1)) for d in by])
        parts = {n: e for m, measure in measures.items() for n, e in measure.parts(m).items()}
    else:
        base = source.frame
        parts = {n: F.sum(n) for m, measure in measures.items() for n in measure.parts(m)}
    frame = base.groupBy(*[F.col(_flat(d)) for d in by]).agg(*[e.alias(n) for n, e in parts.items()])
    path, seen = path or fresh_path(frame.sparkSession, f"aggregate-{table}"), Observation()
    frame.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return Aggregate(table, tuple(chosen), tuple(by), frame.sparkSession.read.schema(frame.schema).parquet(path), seen.get["n"])


def answer(model: MetricModel, tables: dict[str, DataFrame], aggregates: Sequence[Aggregate], metrics: Sequence[str],
           dims: Sequence[str], equal: dict[str, Sequence] | None = None, used: list | None = None) -> DataFrame:
    """``metrics`` by ``dims`` where the dimensions in ``equal`` have one of the values listed; null is never among them.

    Names may be synonyms. Each table's metrics come from its smallest aggregate that has them, the dimensions and those filtered
    by, or from base tables. ``used`` receives, per table, the aggregate taken or None.
    """
    by, kept = [resolve(model, d) for d in dims], {resolve(model, d): list(v) for d, v in (equal or {}).items()}
    by_table: dict[str, list[str]] = {}
    for m in metrics:
        table, name = resolve(model, m, "metrics").split(".", 1)
        by_table.setdefault(table, []).append(name)
    needed, results = list(dict.fromkeys([*by, *kept])), []
    groups = [F.col(_flat(d)).alias(d.split(".", 1)[1]) for d in by]
    for table, names in by_table.items():
        found = _smallest(aggregates, table, names, needed)
        if used is not None:
            used.append(found)
        rows = _with_dimensions(model, tables, table, [tuple(d.split(".", 1)) for d in needed]) if found is None else found.frame
        for dim, values in kept.items():
            rows = rows.where(F.col(_flat(dim)).isin(values))
        value = lambda m: model.metrics[table][m]() if found is None else model.metrics[table][m].combined(m)  # noqa: B023, E731
        results.append(rows.groupBy(*groups).agg(*[value(m).alias(m) for m in names]))
    return _side_by_side(results, [d.split(".", 1)[1] for d in by])
