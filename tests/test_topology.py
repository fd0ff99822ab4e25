"""Bubbles, chains and chain positions against plain searches on small random graphs."""

import random

import pytest

from seqgraph.operators import topology


def graph(r, n, m):
    """Rings, self-loops, nested bubbles and tips among n nodes."""
    edges = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
    for k in range(0, n - 5, 6):
        kind = r.randrange(3)
        if kind == 0:
            edges |= {(k, k + 1), (k, k + 2), (k + 1, k + 3), (k + 2, k + 3), (k + 3, k)}
        elif kind == 1:
            edges |= {(k, k + 1), (k + 1, k + 2), (k + 2, k), (k + 2, k + 2)}
        else:
            edges |= {(k, k + 1), (k + 1, k + 2), (k + 1, k + 3), (k + 2, k + 4), (k + 3, k + 4), (k, k + 4), (k + 4, k + 5), (k + 5, k)}
    return edges


def plain_bubble(start, out, into, aside):
    """The first node that all ways from start meet at, and what lies between: nodes are taken one by one."""
    ready, done, open_ = [start], [], {start}
    while ready:
        v = ready.pop()
        open_.discard(v)
        done.append(v)
        if not out[v] - aside - {v}:
            return None
        for u in out[v] - aside - {v}:
            if u == start:
                return None
            open_.add(u)
            if all(w in done for w in into[u] - aside - {u}) and u not in ready:
                ready.append(u)
        if len(open_) == 1 and ready == list(open_):
            return None if start in out[ready[0]] else (ready[0], set(done) - {start})
    return None


def plain_chains(nodes, out, into):
    def reach(a, way):
        got, todo = set(), list(way[a])
        while todo:
            x = todo.pop()
            if x not in got:
                got.add(x)
                todo += way[x]
        return got

    ahead = {a: reach(a, out) for a in nodes}
    cyclic = {a for a in nodes if a in ahead[a]}
    fore = {a for a in nodes if a not in cyclic and not ahead[a] & cyclic}
    back = {a for a in nodes if a not in cyclic and not reach(a, into) & cyclic}
    pairs = [(a, b) for a in nodes for b in out[a] if a in fore or b in back]
    for a in fore | back:
        near = ((out[a] if a in back else set()) | (into[a] if a in fore else set())) - {a}
        if len(near) == 1:
            pairs.append((a, *near))
    tips = fore | back
    spurs = {a for a in nodes - tips if len(out[a] - tips - {a}) == 1 and out[a] - tips - {a} == into[a] - tips - {a}}
    pairs += [(a, *(out[a] - tips - {a})) for a in spurs]
    bubbles = {}
    for a in nodes:
        found = plain_bubble(a, out, into, tips | spurs)
        if found:
            bubbles[a] = found
            pairs += [(a, found[0]), *((a, x) for x in (found[1] if a not in tips | spurs else ()))]
    top = {a: a for a in nodes}
    for a, b in pairs:
        x, y = sorted((top[a], top[b]))
        top = {k: x if v == y else v for k, v in top.items()}
    return top


def ways(edges):
    nodes = {x for e in edges for x in e}
    out, into = {x: set() for x in nodes}, {x: set() for x in nodes}
    for a, b in edges:
        out[a].add(b)
        into[b].add(a)
    return nodes, out, into


@pytest.fixture(scope="module")
def many():
    """Sixty graphs side by side, 40 nodes apart."""
    r = random.Random(7)
    return {(a + 40 * k, b + 40 * k) for k in range(60) for a, b in graph(r, r.randint(4, 24), r.randint(2, 30))}


def test_superbubbles(spark, many):
    nodes, out, into = ways(many)
    want = {a: found for a in nodes if (found := plain_bubble(a, out, into, set()))}
    bubbles, inner = topology.superbubbles(spark.createDataFrame(sorted(many), "src long, dst long"))
    assert {r.start: r.finish for r in bubbles.collect()} == {a: f for a, (f, _) in want.items()}
    got = {}
    for r in inner.collect():
        got.setdefault(r.start, set()).add(r.node)
    assert got == {a: x for a, (_, x) in want.items() if x} and got


def test_chains(spark, many):
    want = plain_chains(*ways(many))
    got = {r.node: r.chain for r in topology.chains(spark.createDataFrame(sorted(many), "src long, dst long")).collect()}
    assert got == want


def test_a_ring_is_one_chain(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1)], "src long, dst long")
    assert {r.chain for r in topology.chains(df).collect()} == {1}


def test_a_self_loop_inside_a_bubble(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (2, 2), (4, 5)], "src long, dst long")
    bubbles, inner = topology.superbubbles(df)
    assert {(r.start, r.finish) for r in bubbles.collect()} == {(1, 4), (4, 5)}
    assert {(r.start, r.node) for r in inner.collect()} == {(1, 2), (1, 3)}
    empty = topology.superbubbles(df.limit(0))
    assert empty[0].count() == empty[1].count() == 0


def reach(nodes, way):
    out = {}
    for a in nodes:
        got, todo = set(), list(way[a])
        while todo:
            x = todo.pop()
            if x not in got:
                got.add(x)
                todo += way[x]
        out[a] = got
    return out


def test_components_tips_and_levels(spark, many):
    """Random knots, and beside them a long path into a ring, a chain of bubbles, and a path that splits and meets again."""
    long = {(10_000 + k, 10_001 + k) for k in range(70)} | {(10_070, 10_040)}
    row = {e for k in range(9) for a in [20_000 + 4 * k] for e in ((a, a + 1), (a, a + 2), (a + 1, a + 4), (a + 2, a + 3), (a + 3, a + 4))}
    edges = {(a % 400 + 7, b % 400 + 7) for a, b in many if a < 2400} | {e for e in many if e[0] >= 400} | long | row | {(30_000, 30_001), (30_001, 30_000), (30_005, 30_005)}
    nodes, out, into = ways(edges)
    ahead, back = reach(nodes, out), reach(nodes, into)
    cyclic = {a for a in nodes if a in ahead[a]}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = {r.node: (r.forward_tip, r.backward_tip) for r in topology.tips(df).collect()}
    assert got == {a: (a not in cyclic and not ahead[a] & cyclic, a not in cyclic and not back[a] & cyclic) for a in nodes}
    component = {a: min((ahead[a] & back[a]) | {a}) for a in nodes}
    scc = topology.strong_components(df)
    assert {r.node: r.component for r in scc.collect()} == component
    level = dict.fromkeys(component.values(), 0)
    for _ in level:
        for a, b in edges:
            if component[a] != component[b]:
                level[component[b]] = max(level[component[b]], level[component[a]] + 1)
    assert {r.node: r.level for r in topology.component_order(df, scc).collect()} == {a: level[c] for a, c in component.items()}


def test_positions_are_those_of_the_first_way_found(spark, many):
    edges = {e for e in many if e[0] < 1200} | {(5000 + k, 5001 + k) for k in range(40)} | {(5020, 4990), (4990, 4995)}
    nodes, out, into = ways(edges)
    chain = topology.chains(spark.createDataFrame(sorted(edges), "src long, dst long"))
    of = {r.node: r.chain for r in chain.collect()}
    size = {a: a % 7 + 1 for a in nodes}
    want = {c: (0, 0) for c in set(of.values())}
    moves = {}
    for a, b in edges:
        if of[a] == of[b] and a != b:
            moves.setdefault(a, []).append((b, size[a]))
            moves.setdefault(b, []).append((a, -size[a]))
    todo = sorted(want)
    while todo:
        new = {}
        for a in todo:
            for b, d in moves.get(a, []):
                way = (want[a][0] + 1, want[a][1] + d)
                if b not in want or way < want[b]:
                    new[b] = want[b] = way
        todo = sorted(new)
    lengths = spark.createDataFrame(sorted(size.items()), "node long, len int")
    got = {r.node: r.chain_pos for r in topology.chain_positions(spark.createDataFrame(sorted(edges), "src long, dst long"), chain, lengths).collect()}
    assert got == {a: p for a, (_, p) in want.items()}


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    """Rounds are counted by the tables that list ranking writes: they follow the logarithm of the path."""
    from pyspark.sql import functions as F

    from seqgraph.operators import paths

    count, kept = [], paths.saved
    monkeypatch.setattr(paths, "saved", lambda df, name="table": count.append(name) or kept(df, name))
    n = 20_000
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    lengths = spark.range(n).select(F.col("id").alias("node"), F.lit(3).alias("len"))
    chain = spark.range(n).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("chain"))
    got = topology.chain_positions(edges, chain, lengths)
    assert got.where("chain_pos = 3 * node").count() == n
    assert topology.tips(edges).where("forward_tip and backward_tip").count() == n
    assert topology.component_order(edges, topology.strong_components(edges)).where("level = node").count() == n
    assert count.count("ranks") <= 4 * 20
