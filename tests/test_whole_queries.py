"""Queries over all rows against brute force on a small fixture."""

from seqgraph.plans import catalog


def test_directed_queries_take_all_orders(spark, tmp_path):
    orders = [(k, (k * 7) % 19) for k in range(1, 25)]
    spark.createDataFrame([(i,) for i in range(20)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    edges = {(c % 20, (k * 13 + c) % 20) for k, c in orders}
    nodes = {x for e in edges for x in e}
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= more
    run = lambda name: {tuple(r) for r in catalog.QUERIES[f"{name}_whole"](spark, str(tmp_path)).collect()}
    assert run("g8_neighbors") == {(n, sum(a == n for a, _ in edges), sum(b == n for _, b in edges)) for n in nodes}
    assert run("g11_strong_components") == {(n, min([m for m in nodes if (n, m) in reach and (m, n) in reach] + [n])) for n in nodes}
    assert run("g12_in_cycle") == {(n, (n, n) in reach) for n in nodes}


def test_reads_of_one_name_keep_their_own_parts(spark, tmp_path):
    """Turn 101 of conversation 1 has the name of turn 1 of conversation 2."""
    rows = [(1, 101, "ab" * 45), (2, 1, "gt" * 80), (2, 1, "gt" * 80)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(tuple(r) for r in catalog.QUERIES["r2_patched"](spark, str(tmp_path)).collect())
    assert got == [(201, "a" + "CA" * 35 + "ca" * 9 + "c")] + 2 * [(201, "g" + "TG" * 65 + "tg" * 14 + "t")]
