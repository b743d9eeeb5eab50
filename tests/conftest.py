import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millwright.schemas import SCHEMAS  # noqa: E402
from millwright.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Rows as dicts to a frame; known tables get their schema, times may be ISO text."""
    def make(rows, schema):
        wanted = SCHEMAS.get(schema)
        if wanted is None:
            import pyspark.sql.functions as F
            names = [c.strip().split(" ", 1) for c in schema.split(",")]
            text = spark.createDataFrame([tuple(r) for r in rows], ", ".join(
                f"{n} {'STRING' if t in ('TIMESTAMP_NTZ', 'DATE') else t}" for n, t in names))
            return text.select(*[F.col(n).cast(t) if t in ("TIMESTAMP_NTZ", "DATE") else F.col(n) for n, t in names])
        kinds = {f.name: f.dataType.simpleString() for f in wanted}
        used = list(wanted.fieldNames())
        text = spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in used) for r in rows],
                                     ", ".join(f"{c} STRING" for c in used))
        return text.selectExpr(*[f"CAST({c} AS {kinds[c]}) AS {c}" for c in used])

    return make


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: tuple(str(x) for x in t))
