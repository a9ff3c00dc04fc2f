"""What plans must and must not hold."""

import os

import pytest

from docloom import compile_pipeline
from docloom.plans import catalog

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    df = compile_pipeline(spark.read.parquet(f"{SMALL}/lineitem.parquet"), [{"$match": {"l_quantity": {"$gte": 25}}}, {"$group": {"_id": "$l_returnflag", "n": {"$sum": 1}}}])
    text = plan(df)
    assert "GreaterThanOrEqual(l_quantity" in text
    schema = text.split("ReadSchema: ")[1].splitlines()[0]
    assert "l_quantity" in schema and "l_returnflag" in schema and "l_tax" not in schema


@needs_data
def test_lookup_and_unwind_make_a_plain_join(spark):
    text = plan(catalog.flagship(spark, SMALL))
    assert "collect_list" not in text and ("HashJoin" in text or "SortMergeJoin" in text)


@needs_data
def test_top_k_is_one_operator(spark):
    text = plan(compile_pipeline(spark.read.parquet(f"{SMALL}/orders.parquet"), [{"$sort": {"o_totalprice": -1}}, {"$limit": 3}]))
    assert "TakeOrderedAndProject" in text


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_python_in_plans(spark, name):
    if name in ("count", "coll_stats"):
        return
    text = plan(catalog.QUERIES[name](spark, SMALL))
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


@needs_data
def test_queries_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    plain = lambda rows, names, order: sorted(repr(tuple(r[names.index(n)] for n in order)) for r in rows)
    for name, sql in catalog.ORACLES.items():
        df = catalog.QUERIES[name](spark, SMALL)
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        order = sorted(names)
        assert sorted(df.columns) == order, name
        assert plain([tuple(r) for r in df.collect()], df.columns, order) == plain(found.fetchall(), names, order), name


def test_lookup_and_walk_start_from_every_row(spark, tmp_path):
    customers, parts = 450, 130
    orders = [(k, 1 + (k * 7) % 400, float((k * 37) % 101)) for k in range(900)]
    nations = {k: (k * 3 + 1) % 60 for k in range(60)}
    put = lambda name, rows, ddl: spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("customer", [(k,) for k in range(1, customers + 1)], "c_custkey long")
    put("orders", orders, "o_orderkey long, o_custkey long, o_totalprice double")
    put("part", [(k,) for k in range(1, parts + 1)], "p_partkey long")
    put("nation", [*nations.items()], "n_nationkey int, n_regionkey int")
    prices = {}
    for _, c, p in orders:
        prices.setdefault(c, []).append(p)
    got = {r.c_custkey: (r.n, r.best) for r in catalog.QUERIES["lookup_pipeline"](spark, str(tmp_path)).collect()}
    assert got == {c: (min(2, len(prices.get(c, []))), max(prices.get(c, []), default=None)) for c in range(1, customers + 1)}

    def walk(at):
        seen = []
        while at in nations and at not in seen:
            seen.append(at)
            at = nations[at]
        return len(seen), len(seen) - 1

    got = {r.p_partkey: (r.n, r.deepest) for r in catalog.QUERIES["graph_lookup"](spark, str(tmp_path)).collect()}
    assert got == {p: walk(p // 2) for p in range(1, parts + 1)}
