import random

from tessera.operators import graph

EDGES = "from_id long, to_id long, kind string, part int"


def brute(edges, start):
    depth, out, frontier = 0, {}, set(start)
    while frontier:
        depth += 1
        frontier = {a for a, b, *_ in edges if b in frontier and a is not None} - set(out) - set(start)
        out |= dict.fromkeys(frontier, depth)
    return out


def test_reach(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60), "import", 1) for _ in range(70)] + [(1000 + i, 7, "call", 1) for i in range(300)] + [(None, 7, "x", 1), (3, None, "x", 1)]
    edges += edges[:20]
    df = spark.createDataFrame(edges, EDGES).repartition(3)
    start = [7, 12]
    want = brute(edges, start)
    tables = {t.name for t in spark.catalog.listTables()}
    for most in (0, 1, 2):
        got = {r.symbol_id: r.depth for r in graph.reach(df, spark.createDataFrame([(s,) for s in start], "symbol_id long"), most).where("symbol_id is not null").collect()}
        assert got == {k: d for k, d in want.items() if not most or d <= most}
    assert {t.name for t in spark.catalog.listTables()} == tables
    assert graph.reach(df.limit(0), df.select("from_id").toDF("symbol_id")).collect() == []


def test_a_hop_does_not_shuffle_the_edges(spark):
    edges = spark.createDataFrame([(i, i // 2, "x", 1) for i in range(1, 500)], EDGES)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        laid, name = graph.reverse_edges(edges)
        step = graph.hop(spark.createDataFrame([(0,), (1,)], "symbol_id long"), laid, ["symbol_id", "part"])
        assert sorted(r.symbol_id for r in step.collect()) == [1, 2, 3]
        plan = step._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
        (scan,) = (i for i, line in enumerate(plan) if "Scan parquet" in line)
        assert "Bucketed: true" in plan[scan]
        depth = plan[scan].index("Scan")
        above = []  # operators on the way from the scan to the root
        for line in reversed(plan[:scan]):
            at = len(line) - len(line.lstrip(" :+-*(0123456789)"))
            if at < depth:
                above.append(line)
                depth = at
        join = next(i for i, line in enumerate(above) if "Join" in line)
        assert not any("Exchange" in line for line in above[:join])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {name}")


def test_no_found_symbols_are_broadcast(spark):
    edges = spark.createDataFrame([(i, i // 2, "x", 1) for i in range(1, 500)], EDGES)
    symbols = edges.selectExpr("from_id as symbol_id", "'f' as path", "'n' as name")
    found = graph.impact(symbols, edges, 0)
    assert [tuple(r) for r in found.select("n_symbols", "min_depth").collect()] == [(499, 1)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    step = graph.hop(edges.selectExpr("from_id as symbol_id"), edges.selectExpr("to_id as symbol_id", "from_id as next_id"), ["symbol_id"])
    step.collect()
    assert "Broadcast" not in step._jdf.queryExecution().executedPlan().toString()
