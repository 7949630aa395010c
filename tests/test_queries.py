"""Every registered query against its SQL, run by DuckDB on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIR = os.environ.get("LATTICA_TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, duck, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql})")
    assert [TYPES[dict(df.dtypes)[c]] for c in columns] == [str(d[1]) for d in result.description]
    assert got == sorted(repr(r) for r in result.fetchall())


def test_plans_hold_no_cross_join(spark):
    for name in ("hybrid_results", "vector_search", "text_relations", "graph_reachable", "visible_documents"):
        plan = entry_module.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_filters_reach_the_scan(spark):
    plan = entry_module.queries()["vector_search_visible"](spark, SF_DIR)
    text = entry_module.queries()["pending_page"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in text and plan.columns
    narrow = entry_module.queries()["audit_by_day"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in narrow


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["request_id", "rank", "result_type", "hit_id", "content", "score"]


def test_graph_search_lists_nodes_neighbours_and_relations(spark):
    rows = entry_module.queries()["graph_search"](spark, SF_DIR).collect()
    assert {r.kind for r in rows} == {"node", "relation"}
    assert any(r.hit_id.startswith("doc:") for r in rows) and any(r.hit_id.startswith(("source:", "lang:")) for r in rows if r.kind == "node")


def test_stream_counts_every_event_whatever_the_order_of_files(spark, tmp_path):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    events.repartition(7, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    want = sorted(map(tuple, entry_module.queries()["audit_by_day"](spark, SF_DIR).collect()))
    assert sorted(map(tuple, entry_module.queries()["audit_by_day_stream"](spark, str(tmp_path)).select("day", "event_type", "events").collect())) == want


def test_no_text_in_the_joins_of_the_queue(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("pending_page", "verify_stats", "queue_stats", "live_chunk_totals"):
            plan = entry_module.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan()
            node = plan.toString()
            lines = node.split("\n")
            for i, line in enumerate(lines):
                if "Exchange hashpartitioning" in line:
                    below = next(x for x in lines[i + 1 :] if "Project" in x or "Filter" in x or "FileScan" in x)
                    assert " text#" not in below.split("[", 1)[-1].split(" AS ")[0] or "Project" not in below, (name, below[:200])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
