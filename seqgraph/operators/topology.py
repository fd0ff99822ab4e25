"""Graph analytics on directed edges ``(src, dst)``: components, tips, bubbles, chains and chain coordinates.

Each is a loop of joins over DataFrames whose state is written to the shared folder after each round. Unbranched paths, and
nodes with one way in and one out, are taken together first (`paths`): the loops run as often as what is left is deep, not
as it is large; ``max_rounds`` stops a loop that does not end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqgraph.checkpoints import saved
from seqgraph.operators.components import connected_components
from seqgraph.operators.paths import list_ranks, reduced

UNROLLED = 3  # steps of a loop between two writes of its state


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def core_edges(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Edges whose end can reach a cycle: ends without an edge out are peeled off until none is left."""
    now, size = saved(edges.select("src", "dst").distinct(), "peel"), -1
    for _ in range(max_rounds):
        count = now.count()
        if count == size:
            return now
        size = count
        for _ in range(UNROLLED):
            now = now.join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        now = saved(now.select("src", "dst"), "peel")
    raise RuntimeError("the graph is too deep")


def tips(edges: DataFrame) -> DataFrame:
    """``(node, forward_tip, backward_tip)``: nodes that reach no cycle, and nodes that no cycle reaches."""
    small, names, layers = reduced(_ones(edges), nodes_of(edges))
    ahead = core_edges(small).select(F.col("src").alias("node"), F.lit(False).alias("forward_tip")).distinct()
    behind = core_edges(_turned(small)).select(F.col("src").alias("node"), F.lit(False).alias("backward_tip")).distinct()
    found = names.join(ahead, "node", "left").join(behind, "node", "left")
    found = saved(found.select("node", F.coalesce("forward_tip", F.lit(True)).alias("forward_tip"), F.coalesce("backward_tip", F.lit(True)).alias("backward_tip")), "tips")
    for layer in reversed(layers):
        # what a passed node reaches, the node behind it does; what reaches it, reaches the one before
        way = layer.passed.join(found.select(F.col("node").alias("behind"), "forward_tip"), "behind").join(found.select(F.col("node").alias("before"), "backward_tip"), "before")
        heads = found.union(way.select("node", "forward_tip", "backward_tip"))
        found = saved(layer.groups.join(heads.withColumnRenamed("node", "head"), "head").select("node", "forward_tip", "backward_tip"), "tips")
    return found


def _ones(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct().withColumn("d", F.lit(1).cast("long"))


def strong_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(node, component)``: the smallest node of each strongly connected component.

    Unbranched ways are contracted, and what cannot lie on a cycle is peeled off. Then, again and again, each node takes
    the smallest node that reaches it; those that the smallest one is reached from in turn, within one such colour, are
    its component.
    """
    small, names, layers = reduced(_ones(edges), nodes_of(edges))
    rough = saved(_strong_components(small, names, max_rounds), "scc-found")
    found = saved(rough.join(in_cycle(small, rough), "node"), "scc-found")
    for layer in reversed(layers):
        # a passed node lies on a cycle where the nodes beside it do so together
        end = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"{name}_c"), F.col("cyclic").alias(f"{name}_y"))  # noqa: B023, E731
        on = F.expr("before_c = behind_c and before_y")
        way = layer.passed.join(end("before"), "before").join(end("behind"), "behind").select("node", F.when(on, F.col("before_c")).otherwise(F.col("node")).alias("component"), on.alias("cyclic"))
        heads = found.select("node", "component", "cyclic").union(way).withColumnRenamed("node", "head")
        found = saved(layer.groups.join(heads, "head").select("node", F.when(F.col("cyclic"), F.col("component")).otherwise(F.col("node")).alias("component"), "cyclic"), "scc-found")
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))


def _strong_components(edges: DataFrame, names: DataFrame, max_rounds: int) -> DataFrame:
    every = saved(names, "scc-nodes")
    live = saved(_turned(core_edges(_turned(core_edges(edges)))).select("src", "dst").where("src <> dst"), "scc")
    done = []
    for _ in range(max_rounds):
        if not live.head(1):
            break
        colour = _least_reaching(nodes_of(live).withColumn("c", F.col("node")), live, max_rounds)
        inner = live.join(colour.select(F.col("node").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst").where("a = b").select("src", "dst", "a")
        inner = saved(inner, "scc")
        reached = saved(colour.where("node = c").select("node", "c"), "scc")
        size = -1
        while (count := reached.count()) != size:
            size = count
            for _ in range(UNROLLED):
                back = reached.join(inner, (F.col("node") == F.col("dst")) & (F.col("c") == F.col("a"))).select(F.col("src").alias("node"), "c")
                reached = reached.union(back).distinct()
            reached = saved(reached, "scc")
        done.append(reached.withColumnRenamed("c", "component"))
        gone = reached.select("node")
        live = live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        live = saved(_turned(core_edges(_turned(core_edges(live)))).select("src", "dst"), "scc")
    found = done[0] if done else every.limit(0).withColumn("component", F.col("node"))
    for d in done[1:]:
        found = found.union(d)
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _least_reaching(labels: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """``(node, c)``: the smallest label that reaches each node."""
    now = saved(labels, "label")
    mark = None
    for _ in range(max_rounds):
        for _ in range(UNROLLED):
            step = now.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "c")
            now = now.union(step).groupBy("node").agg(F.min("c").alias("c"))
        now = saved(now, "label")
        told = now.agg(F.sum("c")).first()[0]
        if told == mark:
            return now
        mark = told
    raise RuntimeError("the graph is too deep")


def component_order(edges: DataFrame, components: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``(node, component, level)``: the longest way to a component from one without ways in; no edge lowers it."""
    a = components.select(F.col("node").alias("src"), F.col("component").alias("a"))
    b = components.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    dag = saved(_ones(edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))), "dag")
    names = components.select(F.col("component").alias("node")).distinct()
    small, left, layers = reduced(dag, names)
    level = saved(left.select("node", F.lit(0).cast("long").alias("level")), "level")
    mark = None
    for _ in range(max_rounds):
        for _ in range(UNROLLED):
            step = level.join(small, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("level") + F.col("d")).alias("level"))
            level = level.union(step).groupBy("node").agg(F.max("level").alias("level"))
        level = saved(level, "level")
        told = level.agg(F.sum("level")).first()[0]
        if told == mark:
            break
        mark = told
    else:
        raise RuntimeError("the components are not free of cycles")
    for layer in reversed(layers):
        way = layer.passed.join(level.withColumnRenamed("node", "before"), "before").select("node", (F.col("level") + F.col("d")).alias("level"))
        heads = level.union(way).withColumnRenamed("node", "head")
        level = saved(layer.groups.join(heads, "head").select("node", (F.col("level") + F.col("d")).alias("level")), "level")
    return components.join(level.withColumnRenamed("node", "component"), "component").select("node", "component", F.col("level").cast("int").alias("level"))


def in_cycle(edges: DataFrame, components: DataFrame) -> DataFrame:
    """``(node, cyclic)``: in a component of two or more, or with an edge to itself."""
    size = components.groupBy("component").agg(F.count("*").alias("size"))
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop")).distinct()
    return components.join(size, "component").join(loops, "node", "left").select("node", ((F.col("size") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic"))


def unique_neighbors(edges: DataFrame, tip: DataFrame) -> DataFrame:
    """``(tip, neighbor)`` of tips that have one single neighbour, other than themselves, in their direction."""
    flags = tip.select(F.col("node").alias("n"), "forward_tip", "backward_tip")
    plain = edges.where("src <> dst")
    # a forward tip hangs on what leads to it, a backward tip on what it leads to
    fore = plain.join(flags.where("forward_tip").select(F.col("n").alias("dst")), "dst").select(F.col("dst").alias("tip"), F.col("src").alias("nb"))
    back = plain.join(flags.where("backward_tip").select(F.col("n").alias("src")), "src").select(F.col("src").alias("tip"), F.col("dst").alias("nb"))
    return fore.union(back).groupBy("tip").agg(F.count_distinct("nb").alias("k"), F.min("nb").alias("neighbor")).where("k = 1").drop("k")


def cycle_spurs(edges: DataFrame, tip: DataFrame) -> DataFrame:
    """``(node, neighbor)``: nodes on cycles whose single non-tip neighbour ahead is also the single one behind."""
    plain = tip.where("not forward_tip and not backward_tip").select("node")
    inner = edges.where("src <> dst").join(plain.withColumnRenamed("node", "src"), "src", "left_semi").join(plain.withColumnRenamed("node", "dst"), "dst", "left_semi")
    ahead = inner.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("k"), F.min("dst").alias("a")).where("k = 1").drop("k")
    behind = inner.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("k"), F.min("src").alias("b")).where("k = 1").drop("k")
    return ahead.join(behind, "node").where("a = b").select("node", F.col("a").alias("neighbor"))


def superbubbles(edges: DataFrame, ignorable: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(start, finish)`` of sub-graphs with one way in and one way out, and ``(start, node)`` of what lies inside.

    All nodes start a walk at once; a lone successor without other parents is a bubble with nothing inside. A seen node
    is visited when all that leads to it has been; a start ends where one single node is open, and fails at a dead end
    or back at itself. Edges from a node to itself are left out. Nodes of ``ignorable`` are not walked to and do not
    count as parents; where they start, their bubble has no inside. A node that leads only to itself or to such nodes is
    a dead end, so that no result depends on the order of visits. Each round visits a node more of each live start, so
    the loop ends.
    """
    every = saved(edges.select("src", "dst").distinct(), "bubble-edges")
    none = ignorable.select("node").distinct() if ignorable is not None else every.limit(0).select(F.col("src").alias("node"))
    walk = every.where("src <> dst").join(none.withColumnRenamed("node", "dst"), "dst", "left_anti").join(none.select(F.col("node").alias("src"), F.lit(0).alias("own")), "src", "left").select("src", "dst", F.coalesce("own", F.lit(1)).alias("own"))
    walk = saved(walk, "bubble-edges")
    out = walk.select(F.col("src").alias("node")).distinct()
    fan = walk.groupBy(F.col("dst").alias("node")).agg(F.sum("own").alias("parents"))
    state = saved(walk.select(F.col("src").alias("start"), F.col("src").alias("node")).distinct(), "bubble")
    found, inside = [], []
    while state.head(1):
        steps = state.join(walk, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), "own")
        failed = state.join(out, "node", "left_anti").select("start").union(steps.where("node = start").select("start")).distinct()
        seen = steps.groupBy("start", "node").agg(F.sum("own").alias("k")).join(state, ["start", "node"], "left_anti").join(failed, "start", "left_anti")
        open_ = saved(seen.join(fan, "node").withColumn("ready", F.col("k") == F.col("parents")), "bubble")
        sizes = open_.groupBy("start").agg(F.count("*").alias("open"), F.sum(F.col("ready").cast("int")).alias("ready_n"), F.min("node").alias("finish"))
        ends = saved(sizes.where("open = 1 and ready_n = 1").select("start", "finish").join(every.select(F.col("src").alias("finish"), F.col("dst").alias("start")), ["start", "finish"], "left_anti"), "bubble")
        found.append(ends)
        inside.append(state.join(ends, "start", "left_semi").where("node <> start").join(none.withColumnRenamed("node", "start"), "start", "left_anti").select("start", "node"))
        go = sizes.where("ready_n > 0 and open > 1").select("start")
        state = saved(state.join(go, "start", "left_semi").union(open_.where("ready").join(go, "start", "left_semi").select("start", "node")), "bubble")
    bubbles, inner = found[0] if found else edges.limit(0).toDF("start", "finish"), inside[0] if inside else edges.limit(0).toDF("start", "node")
    for f, i in zip(found[1:], inside[1:], strict=True):
        bubbles, inner = bubbles.union(f), inner.union(i)
    return bubbles, inner


def chains(edges: DataFrame) -> DataFrame:
    """``(node, chain)``: nodes joined by edges of tips, lone neighbours, cycle spurs, and bubbles with their insides.

    Tips and spurs, all found before any bubble, stand aside when bubbles are looked for.
    """
    edges = saved(edges.select("src", "dst").distinct(), "chain-edges")
    tip = saved(tips(edges), "chain-tips")
    spurs = saved(cycle_spurs(edges, tip), "chain-spurs")
    fore, back = tip.where("forward_tip").select(F.col("node").alias("src")), tip.where("backward_tip").select(F.col("node").alias("dst"))
    links = edges.join(fore, "src", "left_semi").select("src", "dst").union(edges.join(back, "dst", "left_semi").select("src", "dst"))
    links = links.union(unique_neighbors(edges, tip)).union(spurs)
    aside = tip.where("forward_tip or backward_tip").select("node").union(spurs.select("node"))
    bubbles, inner = superbubbles(edges, aside)
    own = nodes_of(edges).select(F.col("node").alias("src"), F.col("node").alias("dst"))
    return connected_components(links.union(bubbles).union(inner).union(own)).withColumnRenamed("component", "chain")


def chain_positions(edges: DataFrame, chain: DataFrame, lengths: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``(node, chain, chain_pos)``: bases from the chain's smallest node along edges within the chain, first way found.

    Nodes behind the root get positions below 0. The least of the ways found in one round is taken.
    """
    a = chain.select(F.col("node").alias("src"), F.col("chain").alias("a"))
    b = chain.select(F.col("node").alias("dst"), F.col("chain").alias("b"))
    size = lengths.select("node", "len")
    inner = edges.join(a, "src").join(b, "dst").where("a = b and src <> dst").select("src", "dst").distinct().join(size.withColumnRenamed("node", "src"), "src")
    moves = inner.select("src", "dst", F.col("len").cast("long").alias("d")).union(inner.select("dst", "src", (-F.col("len")).cast("long")))
    moves = saved(moves.groupBy("src", "dst").agg(F.min("d").alias("d")), "moves")
    # nodes with two neighbours lie between stations; an arc out of one comes behind the arc from its other neighbour
    roots = chain.where("node = chain").select(F.col("node").alias("src"))
    between = moves.groupBy("src").agg(F.count("*").alias("k")).where("k = 2").drop("k").join(roots, "src", "left_anti")
    prior = moves.join(between, "src").select("src", F.col("dst").alias("other"))
    links = moves.join(prior, "src", "left").where("other is null or other <> dst").select(F.struct("src", "dst").alias("node"), F.when(F.col("other").isNotNull(), F.struct(F.col("other").alias("src"), F.col("src").alias("dst"))).alias("to"), "d")
    ranks, _ = list_ranks(links)
    first = moves.select(F.struct("src", "dst").alias("end"), F.col("d").alias("first_d"))
    ways = saved(ranks.join(first, "end").select(F.col("end.src").alias("src"), F.col("node.dst").alias("dst"), F.struct((F.col("n") + 1).alias("hops"), (F.col("d") + F.col("first_d")).alias("d")).alias("w")), "ways")
    midst = between.withColumnRenamed("src", "dst")
    leaps = saved(ways.join(midst, "dst", "left_anti").groupBy("src", "dst").agg(F.min("w").alias("w")), "leaps")
    way = lambda w: F.struct((F.col("way.hops") + F.col(f"{w}.hops")).alias("hops"), (F.col("way.pos") + F.col(f"{w}.d")).alias("pos")).alias("way")
    now = chain.where("node = chain").select("node", "chain", F.struct(F.lit(0).cast("long").alias("hops"), F.lit(0).cast("long").alias("pos")).alias("way"))
    mark = None
    for _ in range(max_rounds):
        for _ in range(UNROLLED):
            step = now.join(leaps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "chain", way("w"))
            now = now.union(step).groupBy("node", "chain").agg(F.min("way").alias("way"))
        now = saved(now, "positions")
        told = tuple(now.agg(F.count("*"), F.sum("way.hops"), F.sum("way.pos")).first())
        if told == mark:
            break
        mark = told
    else:
        raise RuntimeError("the chains are too long")
    # what lies between, from the stations on both sides
    inside = ways.join(midst, "dst").select(F.col("src").alias("node"), F.col("dst").alias("between"), "w")
    return now.select("node", "chain", "way").union(now.join(inside, "node").select(F.col("between").alias("node"), "chain", way("w"))).groupBy("node", "chain").agg(F.min("way").alias("way")).select("node", "chain", F.col("way.pos").alias("chain_pos"))
