"""Each query against its SQL on DuckDB, and a stream that is stopped and started again against the batch."""

import math

import duckdb
import pandas as pd
import pytest

from loomlog.operators import state
from loomlog.plans.queries import ORACLES, QUERIES
from loomlog.sources.tables import kv_log_reordered
from loomlog.streaming import state_stream

from .conftest import SF


#: Queries whose tables at the tests' size are too small for a row.
SPARSE = {"log_compact"}


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "~"
        if isinstance(v, pd.Timestamp):
            return str(v.tz_localize(None))
        return f"{float(v):.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(SF)).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert (len(want) or name in SPARSE) and sorted(got) == sorted(want) and rows(got) == rows(want)
    else:
        assert len(got)


def test_the_history_query_finds_its_planted_reads(spark):
    got = QUERIES["lin_check"](spark, str(SF)).toPandas()
    assert set(got["verdict"]) <= {"Ok", "Illegal"} and (got["verdict"] == "Ok").mean() > 0.9


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    log = kv_log_reordered(spark, str(SF)).select("shard", "client_id", "idx", "seq", "op", "key", "val").toPandas().sort_values("idx")
    third = len(log) // 3
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        log[k * third : (k + 1) * third if k < 2 else None].to_parquet(tmp_path / f"in/{k}.parquet", index=False)
        schema = spark.read.parquet(str(tmp_path / "in")).schema
        state_stream.run_available(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out")).where("accepted").select("idx").toPandas()["idx"]
    want = state.accepted(kv_log_reordered(spark, str(SF))).where("accepted").select("idx").toPandas()["idx"]
    assert sorted(got) == sorted(want)
