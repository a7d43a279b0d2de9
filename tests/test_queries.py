"""Every registered query against its SQL counterpart, and the shape of its plan."""

import duckdb
import pytest

import __spark_entry__ as entry
from holdfast.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return found


def plain(frame):
    names = sorted(frame.columns)
    rows = frame[names].astype(object).where(frame[names].notna(), None).values.tolist()
    return names, sorted(repr([int(v) if isinstance(v, float) and v == int(v) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, db, name):
    assert plain(registry.QUERIES[name](spark, SF).toPandas()) == plain(db.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("factor, fails", [(1000, False), (10**10, True)])
def test_checked_sums_of_large_keys(spark, tmp_path, factor, fails):
    # products beyond a long: the saturated sum stays at the largest number, the exact one fails as its SQL does
    duckdb.execute(f"COPY (SELECT i * {factor} AS o_orderkey, ['F', 'O', 'P'][i % 3 + 1] AS o_orderstatus FROM range(1, 900) t(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet')")
    run, sql = lambda: registry.QUERIES["d14_checked_sums"](spark, str(tmp_path)).toPandas(), lambda: own.execute(registry.ORACLES["d14_checked_sums"]).df()
    if fails:
        with pytest.raises(Exception, match="a counter is out of range"):
            run()
        with pytest.raises(duckdb.Error):
            sql()
    else:
        assert plain(run()) == plain(sql())


def test_latest_replication_keeps_the_later_event(spark, db):
    # location_1 has two rows of scan_1, of events 100030 and 5; one thread takes the SQL's rows in their order, several in any
    got = registry.QUERIES["e05_latest_replication"](spark, SF).toPandas()
    assert got.set_index("destination_id").status["location_1"] == "verified"
    threads = db.execute("SELECT current_setting('threads')").fetchone()[0]
    db.execute("SET threads = 1")
    try:
        assert plain(got) == plain(db.execute(registry.ORACLES["e05_latest_replication"]).df())
    finally:
        db.execute(f"SET threads = {threads}")


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"k31_attachment_plan", "k39_metadata_independence", "k51_rebuild_equivalence"}))
def test_no_query_multiplies_tables(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_needed_columns_only(spark):
    text = plan(registry.QUERIES["k14_due_for_verification"](spark, SF))
    assert "l_extendedprice" not in text and "l_discount" not in text


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
