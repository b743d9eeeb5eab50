import duckdb
import pytest

from millwright.catalog.registry import ORACLES

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def database():
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
        yield con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_names_only_what_exists(database, name):
    """A fragment that was not yet defined when the text was composed is missing from it."""
    database.execute("EXPLAIN " + ORACLES[name])
