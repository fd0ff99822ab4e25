"""Extension of anchors to scored alignments by an edit wavefront over nodes.

A state is ``(aln_id, side, onode_id, off, rpos, e)``: with ``e`` edits, ``rpos`` bases of the side's query are aligned up
to base ``off`` of a node. Nodes are cut in pieces of ``PIECE`` bases. In a round, all alignments take the states that enter a
piece, as one row a piece, through all edits there (`fronts`); joins come only where a front leaves its piece. What enters
too far ahead of an alignment's last state waits, so that paths of different depth meet, and a state that others have
reached as cheaply falls out. The number of rounds follows the pieces on a path, not the edits.

Entries into pieces and the entries before them are a table of pointers. An end is traced back by pointer jumping, and
the steps within each piece of its path follow from the texts between two pointers: states carry neither steps nor path.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgraph.checkpoints import forget, saved
from seqgraph.functions.sequences import CODES, error_cost, iupac_match, revcomp
from seqgraph.operators import fronts
from seqgraph.operators.intervals import merged as merged_spans

WINDOW = 256
PIECE = 1024
REACH = 256
SLICE = fronts.SLICE
STATE = ("aln_id", "side", "onode_id", "off", "rpos", "e", "ops", "path")
FORWARD, BACKWARD = 1, 0


def anchor_starts(anchors: DataFrame) -> DataFrame:
    """Two start states for each anchor ``(aln_id, read_id, onode_id, onode_len, off, read_pos, match_len, seq)``.

    Offsets are those of the anchor's first base. The forward side begins behind the anchor; the backward one, on the
    other strand, behind its first base. Adds ``query``, what is left of the read on that side.
    """
    fore = anchors.select("aln_id", F.lit(FORWARD).alias("side"), "onode_id", (F.col("off") + F.col("match_len")).alias("off"), F.expr("substring(seq, int(read_pos + match_len + 1))").alias("query"))
    back = anchors.select("aln_id", F.lit(BACKWARD).alias("side"), F.col("onode_id").bitwiseXOR(F.lit(1)).alias("onode_id"), (F.col("onode_len") - F.col("off")).alias("off"), revcomp(F.expr("substring(seq, 1, int(read_pos))")).alias("query"))
    return fore.union(back).select("aln_id", "side", "onode_id", F.col("off").cast("long").alias("off"), "query")


def restarts(reads: DataFrame, spans: DataFrame, stride: int) -> DataFrame:
    """``(read_id, start, end, point)``: what no span ``(read_id, start, end)`` of a read covers, and where to try again there.

    The point lies ``stride`` bases behind the last covered one; intervals that end before it, and the read's last base,
    are left out. A read without a span has none: its first try begins at its first base.
    """
    one = merged_spans(spans.where("start < end or start = 0").select("read_id", "start", "end"), ["read_id"])
    behind = F.lead("start").over(W.partitionBy("read_id").orderBy("start"))
    gaps = one.withColumn("next", behind).join(reads.select("read_id", "len"), "read_id").select("read_id", F.col("end").alias("start"), F.coalesce("next", "len").cast("long").alias("end"), "len")
    return gaps.withColumn("point", F.col("start") + stride).where("point < end and point < len - 1").drop("len")


def free_anchors(reads: DataFrame, onodes: DataFrame, stride: int = 0, errors: int = 2, base: int = 3, points: DataFrame | None = None) -> DataFrame:
    """Anchors without seeds: every place of the graph that equals one of the first ``errors + 1`` blocks of ``base``
    bases (an equi-join on them), so a read with a wrong first base has anchors too. With ``stride`` the same again at
    each multiple of it, with ``points`` ``(read_id, point)`` there instead. Reads shorter than a block have none.
    """
    places = onodes.where(F.col("len") >= base).select("onode_id", F.col("len").alias("onode_len"), F.explode(F.sequence(F.lit(0), F.col("len") - base)).alias("off"), "seq")
    index = places.select("onode_id", "onode_len", F.col("off").cast("long").alias("off"), F.expr(f"substring(seq, off + 1, {base})").alias("b"))
    first = F.sequence(F.lit(0), F.col("len") - base, F.lit(stride)) if stride > 0 else F.array(F.lit(0))
    begun = reads.where(F.col("len") >= base).select("read_id", "seq", F.explode(first).alias("w"))
    if points is not None:
        begun = reads.join(points, "read_id").select("read_id", "seq", F.col("point").alias("w"))
    blocks = begun.select("read_id", "seq", F.explode(F.array(*(F.col("w") + base * i for i in range(errors + 1)))).alias("p"))
    blocks = blocks.where(F.col("p") + base <= F.length("seq")).distinct().withColumn("b", F.expr(f"substring(seq, p + 1, {base})"))
    return blocks.join(index, "b").select(F.concat_ws(":", "read_id", "p", "onode_id", "off").alias("aln_id"), "read_id", "onode_id", "off", F.col("p").cast("long").alias("read_pos"), F.lit(base).alias("match_len"), "onode_len", "seq")


def equal_run(a: Column, b: Column) -> Column:
    """Length of the common beginning of two strings; ambiguous bases are equal where they share a base."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y) | iupac_match(x, y), F.lit(False)))
    plain = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(plain).cast("long")


def furthest(states: DataFrame) -> DataFrame:
    """The state with the most read on each diagonal of a node."""
    order = W.partitionBy("aln_id", "side", "onode_id", F.col("off") - F.col("rpos")).orderBy(F.desc("rpos"), "e", "ops")
    return states.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def slide(states: DataFrame, queries: DataFrame, onodes: DataFrame, oedges: DataFrame, max_hops: int = 256) -> DataFrame:
    """Advances states over equal bases, across node ends, until none moves; where all rest, at no cost.

    After each ``max_hops`` hops it is checked that they are no more than bases and nodes allow, else an error tells of
    a cycle of nodes that their overlaps cover.
    """
    nodes = onodes.select("onode_id", F.col("seq").alias("nseq"), F.col("len").alias("nlen"))
    rest, now, hops = None, states, 0
    while True:
        both = now.join(nodes, "onode_id").join(queries, ["aln_id", "side"])
        run = equal_run(F.expr(f"substring(query, int(rpos + 1), {WINDOW})"), F.expr(f"substring(nseq, int(off + 1), {WINDOW})"))
        moved = both.withColumn("run", run)
        moved = moved.select("aln_id", "side", "onode_id", (F.col("off") + F.col("run")).alias("off"), (F.col("rpos") + F.col("run")).alias("rpos"), "e", F.concat("ops", F.repeat(F.lit("="), F.col("run").cast("int"))).alias("ops"), "path", F.when((F.col("run") == WINDOW), 2).when((F.col("off") + F.col("run") == F.col("nlen")) & (F.col("rpos") + F.col("run") < F.length("query")), 1).otherwise(0).alias("more"))
        moved = saved(moved, "slide")
        here = moved.where("more < 2").drop("more")
        rest = here if rest is None else rest.union(here)
        over = moved.where("more = 1").join(oedges.select(F.col("src").alias("onode_id"), "dst", "overlap"), "onode_id")
        over = over.select("aln_id", "side", F.col("dst").alias("onode_id"), F.col("overlap").cast("long").alias("off"), "rpos", "e", "ops", F.concat("path", F.array("dst")).alias("path"))
        now = moved.where("more = 2").drop("more").select(*STATE).union(over)
        if not now.head(1):
            return rest
        now, hops = furthest(now), hops + 1
        if hops % max_hops == 0 and hops > queries.agg(F.max(F.length("query"))).first()[0] + onodes.count():
            raise RuntimeError("states run round a cycle of nodes without bases of their own")


def within_band(states: DataFrame, bandwidth: int) -> DataFrame:
    """Drops states with over ``bandwidth`` edits more than the least of their read slice."""
    least = F.min("e").over(W.partitionBy("aln_id", "side", F.floor(F.col("rpos") / SLICE)))
    return states.withColumn("least", least).where(F.col("e") <= F.col("least") + bandwidth).drop("least")


def within_budget(states: DataFrame, cells: int) -> DataFrame:
    """At most ``cells`` states of a read slice, fewest edits first; a negative number keeps all."""
    if cells < 0:
        return states
    order = W.partitionBy("aln_id", "side", F.floor(F.col("rpos") / SLICE)).orderBy("e", F.desc("rpos"), "onode_id", "off")
    return states.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cells).drop("r")


def closed_spans(slices: DataFrame, offsets: DataFrame) -> DataFrame:
    """``(aln_id, side, onode_id, closed)``: spans of a side's query that ``(read_id, onode_id, slice)`` forbids on a node.

    ``offsets`` is ``(aln_id, side, read_id, shift)``: the forward side goes up from ``shift`` in the read, the backward one
    goes down from it, on the nodes' other strand.
    """
    fore = F.col("side") == FORWARD
    start = F.when(fore, F.col("slice") - F.col("shift")).otherwise(F.col("shift") - F.col("slice") - SLICE)
    node = F.when(fore, F.col("onode_id")).otherwise(F.col("onode_id").bitwiseXOR(F.lit(1)))
    told = offsets.join(slices, "read_id").select("aln_id", "side", node.alias("onode_id"), F.struct(start.cast("long").alias("start"), (start + SLICE).cast("long").alias("end")).alias("s"))
    return told.where("s.end > 0").groupBy("aln_id", "side", "onode_id").agg(F.sort_array(F.collect_list("s")).alias("closed"))


def alive(states: DataFrame, drop: float, cost: float, fraction: float = 1.0, edits: int = 1) -> DataFrame:
    """States at most ``drop`` below their side's best score ``top`` that a perfect rest of the query could lift over a
    ``fraction`` of it; to go on takes ``edits``: one behind equal bases, none where a state enters a node."""
    return states.where((F.col("x") >= F.col("top") - drop) & (F.col("qlen") - (F.col("e") + edits) * F.lit(cost) > F.lit(fraction) * F.col("top")))


def scored(states: DataFrame, identity: float) -> DataFrame:
    return states.withColumn("x", F.col("rpos") - F.col("e") * F.lit(error_cost(identity) / 100))


def pieces(onodes: DataFrame) -> DataFrame:
    """``(onode_id, part, nseq, n0, nend)``: each node in pieces of ``PIECE`` bases."""
    parts = onodes.select("onode_id", "seq", "len", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(len - 1) div {PIECE}")))).alias("part"))
    return parts.select("onode_id", F.col("part").cast("long").alias("part"), F.expr(f"substring(seq, int(part * {PIECE} + 1), {PIECE})").alias("nseq"), (F.col("part") * PIECE).cast("long").alias("n0"), F.least(F.col("len"), (F.col("part") + 1) * PIECE).cast("long").alias("nend"))


def placed(states: DataFrame, onodes: DataFrame) -> DataFrame:
    """Adds the length of the node and the piece of each state; a state behind the last base is in the last piece."""
    known = states.join(onodes.select("onode_id", F.col("len").cast("long").alias("nlen")), "onode_id")
    return known.withColumn("part", F.expr(f"(case when off = nlen and off > 0 then off - 1 else off end) div {PIECE}"))


ENTRY = ("aln_id", "side", "onode_id", "off", "rpos", "e", "hop")
FROM = ("from_node", "from_off", "from_rpos", "from_e", "from_hop", "fresh")


def undercut(states: DataFrame, seen: DataFrame) -> DataFrame:
    """States that no other one at the same place, new or seen, has reached with as few edits or could by insertions."""
    every = states.withColumn("old", F.lit(0)).unionByName(seen.withColumn("old", F.lit(-1)), allowMissingColumns=True)
    order = W.partitionBy("aln_id", "side", "onode_id", "off").orderBy("rpos", "e", "old", "hop", *FROM[:-2]).rowsBetween(W.unboundedPreceding, -1)
    return every.withColumn("low", F.min(F.col("e") - F.col("rpos")).over(order)).where("old = 0 and (low is null or low > e - rpos)").drop("old", "low")


def explored(starts: DataFrame, onodes: DataFrame, oedges: DataFrame, params, closed: tuple[DataFrame, DataFrame] | None = None, fraction: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the starts reach: ``(ends, entries, queries)``.

    ``ends`` is ``(aln_id, side, onode_id, slice, off, rpos, e, x, from_off, from_rpos, from_e, from_hop)``, the state of best
    score of each piece of a node and slice of the query, and the starts themselves; ``entries`` are the pointers, ``queries``
    the sides' texts. ``closed`` are the slices and offsets of `closed_spans`: on such a node a front stops at the border.

    States fall out when they are out of the band, over the budget, more than the X-drop below the side's best score, or
    when even a perfect rest of the query could not reach a ``fraction`` of it.
    """
    cost = error_cost(params.identity) / 100
    queries = saved(starts.groupBy("aln_id", "side").agg(F.first("query").alias("query")).withColumn("qlen", F.length("query")), "query")
    lengths = onodes.select(F.col("onode_id").alias("dst"))
    edges = oedges.join(lengths, "dst", "left_semi").select(F.col("src").alias("onode_id"), "dst", F.col("overlap").cast("long").alias("overlap"))
    texts = saved(pieces(onodes), "pieces")
    spans = saved(closed_spans(*closed), "closed") if closed else None
    none = [F.lit(None).cast(t).alias(c) for c, t in zip(FROM, ("long", "long", "long", "int", "int", "boolean"), strict=True)]
    first = starts.select("aln_id", "side", "onode_id", "off", F.lit(0).cast("long").alias("rpos"), F.lit(0).alias("e"), F.lit(0).alias("hop"), *none, F.lit(0.0).alias("top")).distinct()
    front = saved(placed(first, onodes), "front")
    ends = [front.select("aln_id", "side", "onode_id", F.lit(0).cast("long").alias("slice"), "off", "rpos", "e", F.lit(0.0).alias("x"), F.col("off").alias("from_off"), F.col("rpos").alias("from_rpos"), F.col("e").alias("from_e"), F.col("hop").alias("from_hop"))]
    ahead = F.col("rpos") > F.min("rpos").over(W.partitionBy("aln_id", "side")) + REACH
    entries, seen = [], []
    while front.head(1):
        dealt = front.withColumn("ahead", ahead)
        now = saved(dealt.where("not ahead").drop("ahead"), "entries")
        row = now.groupBy("aln_id", "side", "onode_id", "part").agg(F.collect_list(F.struct("off", "rpos", "e", "hop")).alias("entries"), F.min("rpos").alias("q0"), F.max("rpos").alias("q1"), F.max("top").alias("top"))
        row = row.join(texts, ["onode_id", "part"]).join(queries, ["aln_id", "side"])
        # more insertions than these would be below the X-drop
        most = F.col("q1") - F.col("q0") + F.col("nend") - F.col("n0") + F.ceil((F.col("nend") - F.col("n0") + F.lit(params.drop)) / F.lit(max(cost - 1, 0.01))) + 8
        row = row.withColumn("query", F.expr("query").substr((F.col("q0") + 1).cast("int"), most.cast("int")))
        row = row.join(spans, ["aln_id", "side", "onode_id"], "left") if spans is not None else row
        points = saved(row.drop("part", "q1").mapInArrow(partial(fronts.advanced, drop=params.drop, cost=cost, band=params.bandwidth, fraction=fraction), f"aln_id {dict(starts.dtypes)['aln_id']}, {fronts.POINT}"), "points")
        out = points.where(F.col("kind") == fronts.EXIT).drop("kind", "slice", "x")
        parts = [points.where(F.col("kind") == fronts.END).drop("kind")]
        tops = now.select("aln_id", "side", F.col("top").alias("x")).union(parts[0].select("aln_id", "side", "x")).groupBy("aln_id", "side").agg(F.max("x").alias("top"))
        begun = {"from_node": F.col("onode_id"), "hop": F.col("from_hop") + 1}
        told = placed(out.withColumns(begun), onodes)
        inner = told.where("off < nlen").withColumn("fresh", F.lit(False))
        over = told.where("off = nlen").drop("nlen", "part").join(edges, "onode_id").withColumn("onode_id", F.col("dst")).withColumn("off", F.col("overlap")).withColumn("fresh", F.lit(True)).drop("dst", "overlap")
        new = inner.drop("nlen", "part").unionByName(over).select(*ENTRY, *FROM)
        waits = dealt.where("ahead").select(*ENTRY, *FROM)
        seen.append(now.select(*ENTRY, *FROM))
        more = undercut(waits.unionByName(new), reduce(DataFrame.union, seen)).join(tops, ["aln_id", "side"]).join(queries.select("aln_id", "side", "qlen"), ["aln_id", "side"])
        more = within_budget(within_band(alive(scored(more, params.identity), params.drop, cost, fraction, 0).drop("x", "qlen"), params.bandwidth), params.cells_per_slice)
        last, front = front, saved(placed(more, onodes), "front")
        entries.append(now)
        ends += parts
        if len(entries) > 1:
            forget(last)
        if len(seen) == 8:
            # what lies before all of an alignment's states is not met again
            low = front.groupBy("aln_id", "side").agg(F.min("rpos").alias("low"))
            seen = [saved(reduce(DataFrame.union, seen).join(low, ["aln_id", "side"]).where("rpos >= low").drop("low"), "seen")]
    return reduce(DataFrame.unionByName, ends), reduce(DataFrame.unionByName, (e.select(*ENTRY, *FROM) for e in entries)), queries


def by_score() -> tuple[Column, ...]:
    """The better of two ends first: of equal scores fewer edits, then more of the read."""
    return F.desc("x"), F.asc("e"), F.desc("rpos"), F.asc("onode_id"), F.asc("off")


def best_ends(ends: DataFrame) -> DataFrame:
    """The end of best score of each side; ties take fewer edits, then more of the read."""
    order = W.partitionBy("aln_id", "side").orderBy(*by_score())
    return ends.withColumn("rank", F.row_number().over(order)).where("rank = 1")


def end_points(ends: DataFrame, oedges: DataFrame, clusters: DataFrame, max_traces: int, fraction: float) -> DataFrame:
    """Ends to trace, with ``rank`` from 1 within a side: the best one, and local maxima that could be alignments as well.

    ``ends`` holds scores x by ``(aln_id, side, onode_id, slice)``; ``clusters`` is ``(aln_id, side, read_id, cluster, shift,
    ahead)`` with a cluster's place in its read's order, the side's begin in the read, and whether it goes up. A local
    maximum is above 0, not below the slice before on its node nor a neighbour's there or in its slice, and above the slice
    behind on its node. It must reach a fraction of its slice's best, and of half the slice's best over earlier clusters
    of the read. At most ``max_traces`` stay in a slice, and those go that lie on the way (behind a twentieth of it) to an
    end of which they do not reach the fraction.
    """
    key = ["aln_id", "side", "onode_id", "slice"]
    order = W.partitionBy(*key).orderBy(*by_score())
    cells = ends.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    score = cells.where("x > 0").select(*key, "x")
    beside = oedges.select("src", "dst").distinct()
    # (node, slice) whose score is compared with that of (to, to_slice), and whether an equal one is too much
    near = [score.select("aln_id", "side", F.col("onode_id").alias("to"), (F.col("slice") + d).alias("to_slice"), "x", F.lit(d < 0).alias("tie")) for d in (1, -1)]
    for mine, other, d in (("src", "dst", 0), ("src", "dst", 1), ("dst", "src", 0), ("dst", "src", -1)):
        near.append(score.join(beside.select(F.col(mine).alias("onode_id"), F.col(other).alias("to")), "onode_id").select("aln_id", "side", "to", (F.col("slice") + d).alias("to_slice"), "x", F.lit(False)))
    higher = reduce(DataFrame.union, near).groupBy("aln_id", "side", F.col("to").alias("onode_id"), F.col("to_slice").alias("slice")).agg(F.max("x").alias("above"), F.max(F.when(F.col("tie"), F.col("x"))).alias("level"))
    best = cells.where("x > 0").join(clusters, ["aln_id", "side"])
    best = best.withColumn("top", F.max("x").over(W.partitionBy("aln_id", "side", "slice")))
    base = F.col("slice") * SLICE
    best = best.withColumn("place", F.floor(F.when(F.col("ahead"), F.col("shift") + base).otherwise(F.col("shift") - base - 1) / SLICE))
    before = F.max("top").over(W.partitionBy("read_id", "side", "place").orderBy("cluster").rangeBetween(W.unboundedPreceding, -1))
    tops = best.withColumn("before", F.coalesce(before, F.lit(0.0)))
    some = tops.where((F.col("x") >= fraction * F.col("top")) & (F.col("x") >= fraction * 0.5 * F.col("before")))
    some = some.join(higher, key, "left").where("coalesce(above <= x, true) and coalesce(level < x, true)").drop("above", "level")
    some = some.withColumn("r", F.row_number().over(W.partitionBy("aln_id", "side", "slice").orderBy(*by_score()))).where(F.col("r") <= max_traces)
    way = some.select("aln_id", "side", F.col("x").alias("way_x"), F.col("slice").alias("to"), (F.ceil(F.col("rpos") * 0.05 / SLICE) + 1).alias("from"))
    on_way = (F.col("s.aln_id") == F.col("w.aln_id")) & (F.col("s.side") == F.col("w.side")) & (F.col("s.slice") >= F.col("w.from")) & (F.col("s.slice") < F.col("w.to")) & (F.col("s.x") < fraction * F.col("w.way_x"))
    some = some.alias("s").join(way.alias("w"), on_way, "left_anti").select(*cells.columns)
    every = some.unionByName(best_ends(cells).drop("rank")).dropDuplicates(key)
    return every.withColumn("rank", F.row_number().over(W.partitionBy("aln_id", "side").orderBy(*by_score())))


def traced_ends(ends: DataFrame, entries: DataFrame, queries: DataFrame, onodes: DataFrame) -> DataFrame:
    """Adds ``ops`` and ``path`` to ends with a ``rank``.

    The entries on each end's path are found by pointer jumping: after n joins, all up to 2**n - 1 before the end.
    """
    at = lambda *c: F.struct(*(F.col(x).alias(n) for x, n in zip(c, ("node", "off", "rpos", "e", "hop"), strict=True)))
    own = ["aln_id", "side"]
    jump = saved(entries.where("from_node is not null").select(*own, at("onode_id", "off", "rpos", "e", "hop").alias("at"), at("from_node", "from_off", "from_rpos", "from_e", "from_hop").alias("to")).distinct(), "jump")
    met = saved(ends.select(*own, "rank", at("onode_id", "from_off", "from_rpos", "from_e", "from_hop").alias("at")), "met")
    while True:
        more = met.join(jump, [*own, "at"]).select(*own, "rank", F.col("to").alias("at"))
        grown = saved(met.union(more).distinct(), "met")
        if grown.count() == met.count():
            break
        ahead = saved(jump.join(jump.select(*own, F.col("at").alias("to"), F.col("to").alias("next")), [*own, "to"]).select(*own, "at", F.col("next").alias("to")), "jump")
        forget(met, jump)
        met, jump = grown, ahead
    how = entries.select(*own, at("onode_id", "off", "rpos", "e", "hop").alias("at"), F.coalesce("fresh", F.lit(True)).alias("fresh")).groupBy(*own, "at").agg(F.max("fresh").alias("fresh"))
    order = W.partitionBy(*own, "rank").orderBy("at.hop")
    last = ends.select(*own, "rank", F.col("off").alias("end_off"), F.col("rpos").alias("end_rpos"))
    path = met.join(how, [*own, "at"]).join(last, [*own, "rank"]).withColumn("next", F.lead("at").over(order)).withColumn("next_fresh", F.lead("fresh").over(order))
    path = path.join(onodes.select(F.col("onode_id").alias("node"), "seq", "len"), path["at.node"] == F.col("node")).join(queries, own)
    # a piece ends where the next one begins, and a node's last piece with the node
    to_off = F.when(F.col("next").isNull(), F.col("end_off")).when(F.col("next_fresh"), F.col("len")).otherwise(F.col("next.off"))
    to_rpos = F.coalesce("next.rpos", "end_rpos")
    cut = lambda text, a, b: F.col(text).substr((F.col(a) + 1).cast("int"), (b - F.col(a)).cast("int"))
    parts = path.select(*own, "rank", F.col("at.hop").alias("hop"), F.when(F.col("fresh") | (F.col("at.hop") == 0), F.col("node")).alias("node"), cut("query", "at.rpos", to_rpos).alias("query"), cut("seq", "at.off", to_off).alias("nseq"))
    kind = dict(ends.dtypes)["aln_id"]
    told = parts.mapInArrow(fronts.stepped, f"aln_id {kind}, side int, rank int, hop int, node long, ops string")
    held = F.array_sort(F.collect_list(F.struct("hop", "ops", "node")))
    whole = told.groupBy(*own, "rank").agg(held.alias("h")).select(*own, "rank", F.array_join(F.transform("h", lambda x: x["ops"]), "").alias("ops"), F.filter(F.transform("h", lambda x: x["node"]), lambda n: n.isNotNull()).alias("path"))
    return ends.join(whole, [*own, "rank"])


def extend(starts: DataFrame, onodes: DataFrame, oedges: DataFrame, params, closed: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(aln_id, side, onode_id, off, rpos, e, ops, path, x)``: the end of best score of each side, at least its start.

    ``closed`` are the slices and offsets of `closed_spans`.
    """
    ends, entries, queries = explored(starts, onodes, oedges, params, closed)
    return traced_ends(saved(best_ends(ends), "ends"), entries, queries, onodes).select(*STATE, "x")


def variants(sides: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sides and anchors for an alignment of both best sides, and one for each other end with the best side across.

    The others get an ``aln_id`` of their own: that of the anchor, the side (- or +) and the end's rank.
    """
    name = F.concat_ws("", F.col("aln_id").cast("string"), F.when(F.col("side") == FORWARD, "+").otherwise("-"), "rank")
    others = sides.where("rank > 1").withColumn("own", name)
    across = sides.where("rank = 1").join(others.select("aln_id", (1 - F.col("side")).alias("side"), "own"), ["aln_id", "side"])
    every = sides.where("rank = 1").unionByName(others.withColumn("aln_id", F.col("own")).drop("own")).unionByName(across.withColumn("aln_id", F.col("own")).drop("own"))
    more = anchors.join(others.select("aln_id", "own"), "aln_id").withColumn("aln_id", F.col("own")).drop("own")
    return every, anchors.unionByName(more)


def merged(sides: DataFrame, anchors: DataFrame, onodes: DataFrame, identity: float) -> DataFrame:
    """One alignment for each anchor from its two sides.

    ``(aln_id, read_id, read_start, read_end, edits, xscore, ops, path, path_start, path_end_off)`` with ``path`` an array
    of oriented nodes from the left end to the right one.
    """
    left = sides.where(f"side = {BACKWARD}").select("aln_id", F.col("rpos").alias("lr"), F.col("e").alias("le"), F.col("ops").alias("lops"), F.reverse(F.transform("path", lambda n: n.bitwiseXOR(F.lit(1)))).alias("lpath"), F.col("off").alias("loff"), F.col("onode_id").alias("lend"))
    right = sides.where(f"side = {FORWARD}").select("aln_id", F.col("rpos").alias("rr"), F.col("e").alias("re"), F.col("ops").alias("rops"), F.col("path").alias("rpath"), F.col("off").alias("roff"))
    both = anchors.join(left, "aln_id").join(right, "aln_id").join(onodes.select(F.col("onode_id").alias("lend"), F.col("len").alias("llen")), "lend")
    edits = F.col("le") + F.col("re")
    start, end = F.col("read_pos") - F.col("lr"), F.col("read_pos") + F.col("match_len") + F.col("rr")
    return both.select(
        "aln_id", "read_id", start.alias("read_start"), end.alias("read_end"), edits.alias("edits"), ((100 * (end - start) - error_cost(identity) * edits) / F.lit(100.0)).alias("xscore"),
        F.concat(F.reverse("lops"), F.repeat(F.lit("="), F.col("match_len").cast("int")), F.col("rops")).alias("ops"), F.concat("lpath", F.slice("rpath", 2, F.size("rpath"))).alias("path"), (F.col("llen") - F.col("loff")).alias("path_start"), F.col("roff").alias("path_end_off"),
    )


def trace(alns: DataFrame) -> DataFrame:
    """``(aln_id, step, op)`` of each step of an alignment."""
    return alns.select("aln_id", F.posexplode_outer(F.split("ops", "")).alias("step", "op")).where("op is not null")


def distinct_starts(alns: DataFrame) -> DataFrame:
    """Of alignments of a read that begin at one place of read and graph, the best."""
    order = W.partitionBy("read_id", "read_start", F.element_at("path", 1), "path_start").orderBy(F.desc("xscore"), "aln_id")
    return alns.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def cancelled(alns: DataFrame, identity: float) -> DataFrame:
    """An insertion next to a deletion is one mismatch: the two edits become one."""
    ops = F.regexp_replace(F.regexp_replace("ops", "ID", "X"), "DI", "X")
    edits = F.length(F.regexp_replace(ops, "=", ""))
    return alns.withColumn("ops", ops).withColumn("edits", edits).withColumn("xscore", (100 * (F.col("read_end") - F.col("read_start")) - error_cost(identity) * F.col("edits")) / F.lit(100.0))


def start_clip(alns: DataFrame, identity: float) -> DataFrame:
    """Adds ``clip_steps``: steps before the suffix of best score; 0 where the whole is best."""
    cost = error_cost(identity) / 100
    value = lambda op: F.when(op == "=", 1.0).when(op == "D", -cost).otherwise(1.0 - cost)
    order = W.partitionBy("aln_id").orderBy(F.desc("step"))
    suffix = trace(alns).withColumn("s", F.round(F.sum(value(F.col("op"))).over(order.rowsBetween(W.unboundedPreceding, 0)), 6))
    first = suffix.groupBy("aln_id").agg(F.min_by("step", F.struct(-F.col("s"), F.col("step"))).alias("clip_steps"))
    return alns.join(first, "aln_id", "left").withColumn("clip_steps", F.coalesce("clip_steps", F.lit(0)))


def trimmed(alns: DataFrame, onodes: DataFrame, oedges: DataFrame, identity: float, first: Column, last: Column) -> DataFrame:
    """Alignments cut to their steps from ``first`` (from 0) up to ``last``, with places, path, edits and score of the rest.

    Alignments of which no base of the graph is left are dropped. Columns beside those of an alignment stay as they are.
    """
    bases = lambda ops, no: F.length(F.regexp_replace(ops, no, "")).cast("long")
    cut = alns.withColumn("_gone", F.col("ops").substr(F.lit(1), first.cast("int"))).withColumn("ops", F.col("ops").substr((first + 1).cast("int"), (last - first).cast("int")))
    cut = cut.withColumn("read_start", F.col("read_start") + bases(F.col("_gone"), "D")).withColumn("read_end", F.col("read_start") + bases(F.col("ops"), "D")).withColumn("edits", F.length(F.regexp_replace("ops", "=", "")))
    cut = cut.withColumn("xscore", (100 * (F.col("read_end") - F.col("read_start")) - error_cost(identity) * F.col("edits")) / F.lit(100.0)).withColumn("_from", F.col("path_start") + bases(F.col("_gone"), "I"))
    steps = cut.select("aln_id", "_from", (F.col("_from") + bases(F.col("ops"), "I")).alias("_to"), F.posexplode("path").alias("at", "onode_id"))
    least = oedges.groupBy(F.col("src").alias("prev"), F.col("dst").alias("onode_id")).agg(F.min("overlap").alias("overlap"))
    order = W.partitionBy("aln_id").orderBy("at")
    told = steps.withColumn("prev", F.lag("onode_id").over(order)).join(onodes.select("onode_id", "len"), "onode_id").join(least, ["prev", "onode_id"], "left").withColumn("o", F.coalesce("overlap", F.lit(0)))
    told = told.withColumn("upto", F.sum(F.col("len") - F.col("o")).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("base", F.col("upto") - F.col("len") + F.col("o"))
    kept = told.where("base < _to and upto > _from and _to > _from").groupBy("aln_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "onode_id"))), lambda x: x["onode_id"]).alias("path"), F.min_by(F.col("_from") - F.col("base") + F.col("o"), "at").alias("path_start"), F.max_by(F.col("_to") - F.col("base") + F.col("o"), "at").alias("path_end_off"))
    return cut.drop("path", "path_start", "path_end_off").join(kept, "aln_id").select(*alns.columns)


def ambiguous_end(alns: DataFrame, margin: float) -> DataFrame:
    """Adds ``sure_steps``: steps that an alignment shares with all others of its read from one start whose score lies
    within ``margin``; all of them where there is no such rival, or where the margin is negative."""
    one = alns.select("aln_id", "read_id", "read_start", F.element_at("path", 1).alias("first"), "path_start", "xscore", "ops")
    key = ["read_id", "read_start", "first", "path_start"]
    rivals = one.alias("a").join(one.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]).where((F.col("a.aln_id") != F.col("b.aln_id")) & (F.abs(F.col("a.xscore") - F.col("b.xscore")) <= margin))
    common = rivals.groupBy("a.aln_id").agg(F.min(equal_steps(F.col("a.ops"), F.col("b.ops"))).alias("sure_steps"))
    return alns.join(common, "aln_id", "left").withColumn("sure_steps", F.coalesce("sure_steps", F.length("ops").cast("long")))


def equal_steps(a: Column, b: Column) -> Column:
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("long")


def agreement(onodes: DataFrame, oedges: DataFrame) -> DataFrame:
    """``(src, dst, overlap, src_len, head, tail)``: how many of an overlap's bases are equal in both nodes, from its first
    base on and from its last one back."""
    seqs = lambda name: onodes.select(F.col("onode_id").alias(name), F.col("seq").alias(f"{name}_seq"), F.col("len").alias(f"{name}_len"))
    both = oedges.where("overlap > 0").groupBy("src", "dst").agg(F.max("overlap").alias("overlap")).join(seqs("src"), "src").join(seqs("dst"), "dst")
    a, b = F.expr("right(src_seq, overlap)"), F.expr("left(dst_seq, overlap)")
    return both.select("src", "dst", "overlap", "src_len", equal_run(a, b).alias("head"), equal_run(F.reverse(a), F.reverse(b)).alias("tail"))


def normalised_ends(alns: DataFrame, onodes: DataFrame, oedges: DataFrame) -> DataFrame:
    """Ends within bases that two nodes share move to the node that has more of the path, over chains of overlaps.

    An end no further than its node's overlap with the node before moves there where the bases up to it are equal, and
    again from there; then likewise a start that only reaches into the overlap with the node behind. One node stays.
    """
    order = W.partitionBy("aln_id").orderBy("at")
    steps = alns.select("aln_id", F.posexplode("path").alias("at", "dst")).withColumn("src", F.lag("dst").over(order))
    told = steps.join(agreement(onodes, oedges), ["src", "dst"], "left").where("at > 0")
    held = told.groupBy("aln_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("overlap", F.lit(0)).cast("long").alias("o"), F.col("src_len").cast("long").alias("l"), "head", "tail"))).alias("h"))
    both = alns.join(held, "aln_id", "left").withColumn("h", F.coalesce("h", F.array().cast("array<struct<at:int,o:bigint,l:bigint,head:bigint,tail:bigint>>")))

    def moved(first: Column, rows: Column, shared, place) -> Column:
        start = F.struct(F.lit(0).alias("n"), first.cast("long").alias("at"), F.lit(True).alias("go"))

        def step(s, x):
            on = F.coalesce(s["go"] & (x["o"] > 0) & shared(s["at"], x), F.lit(False))
            return F.struct((s["n"] + on.cast("int")).alias("n"), F.when(on, place(s["at"], x)).otherwise(s["at"]).alias("at"), on.alias("go"))

        return F.aggregate(rows, start, step)

    both = both.withColumn("_end", moved(F.col("path_end_off"), F.reverse("h"), lambda at, x: (at <= x["o"]) & (at <= x["head"]), lambda at, x: x["l"] - x["o"] + at))
    both = both.withColumn("path", F.expr("slice(path, 1, size(path) - _end.n)")).withColumn("path_end_off", F.col("_end.at").cast(alns.schema["path_end_off"].dataType))
    both = both.withColumn("_start", moved(F.col("path_start"), F.expr("slice(h, 1, size(path) - 1)"), lambda at, x: (at >= x["l"] - x["o"]) & (x["l"] - at <= x["tail"]), lambda at, x: at - x["l"] + x["o"]))
    both = both.withColumn("path", F.expr("slice(path, _start.n + 1, size(path))")).withColumn("path_start", F.col("_start.at").cast(alns.schema["path_start"].dataType))
    return both.select(*alns.columns)


def described(alns: DataFrame, reads: DataFrame, onodes: DataFrame, oedges: DataFrame) -> DataFrame:
    """Adds what a GAF line and a check need: path text and length, path_end, matches, block_len, read_len, graph_seq."""
    steps = alns.select("aln_id", F.posexplode("path").alias("step", "onode_id"))
    order = W.partitionBy("aln_id").orderBy("step")
    least = oedges.groupBy(F.col("src").alias("prev"), F.col("dst").alias("onode_id")).agg(F.min("overlap").alias("overlap"))
    named = steps.withColumn("prev", F.lag("onode_id").over(order)).join(onodes.select("onode_id", "name", "is_rev", "seq"), "onode_id").join(least, ["prev", "onode_id"], "left")
    part = F.struct("step", F.concat(F.when(F.col("is_rev"), "<").otherwise(">"), "name").alias("t"), F.expr("substring(seq, coalesce(overlap, 0) + 1)").alias("s"), F.coalesce("overlap", F.lit(0)).alias("o"))
    held = F.array_sort(F.collect_list(part))
    whole = named.groupBy("aln_id").agg(F.array_join(F.transform(held, lambda x: x["t"]), "").alias("path_text"), F.array_join(F.transform(held, lambda x: x["s"]), "").alias("path_seq"), F.element_at(F.transform(held, lambda x: F.length(x["s"]) + 0 * x["o"]), -1).alias("last_len"), F.element_at(F.transform(held, lambda x: x["o"]), -1).alias("last_overlap"))
    out = alns.join(whole, "aln_id").join(reads.select("read_id", "seq", F.col("len").alias("read_len")), "read_id")
    end = F.length("path_seq") - F.col("last_len") + F.col("path_end_off") - F.col("last_overlap")
    count = lambda pattern: F.length(F.regexp_replace("ops", pattern, ""))
    return out.withColumn("path_len", F.length("path_seq")).withColumn("path_end", end).withColumn("matches", count("[^=]")).withColumn("block_len", F.length("ops")).withColumn("graph_seq", F.expr("substring(path_seq, int(path_start + 1), int(path_end - path_start))")).drop("last_len", "last_overlap", "path_seq")


def violations(described_: DataFrame) -> DataFrame:
    """Alignments whose steps do not lead from read to graph, or whose edits are not those stored."""
    runs = F.regexp_extract_all("ops", F.lit("=+|I+|D+|[^=ID]+"), F.lit(0))
    count = lambda op: F.length(F.replace("ops", F.lit(op), F.lit("")))

    def step(acc, x):
        op, n = F.left(x, F.lit(1)), F.length(x)
        ours, theirs = F.substring(acc["seq"], acc["r"] + 1, n), F.substring(acc["graph_seq"], acc["g"] + 1, n)
        known = (F.length(ours) == n) & F.rlike(ours, F.lit(f"^[{CODES}{CODES.lower()}]*$"))
        same = F.coalesce(known & ((ours == theirs) | (equal_run(ours, theirs) == n)), F.lit(False))
        return F.struct((acc["r"] + F.when(op == "D", 0).otherwise(n)).cast("int").alias("r"), (acc["g"] + F.when(op == "I", 0).otherwise(n)).cast("int").alias("g"), (acc["ok"] & ((op != "=") | same)).alias("ok"), acc["seq"].alias("seq"), acc["graph_seq"].alias("graph_seq"))

    # the texts go along in the state: a filter that is pushed down would spell them anew for each run
    sound = F.aggregate(runs, F.struct(F.col("read_start").cast("int").alias("r"), F.lit(0).alias("g"), F.lit(True).alias("ok"), F.col("seq").alias("seq"), F.col("graph_seq").alias("graph_seq")), step, lambda acc: acc["ok"])
    wrong = ~sound | (count("=") != F.col("edits")) | (count("D") != F.col("read_end") - F.col("read_start")) | (count("I") != F.length("graph_seq"))
    return described_.where(wrong)


def corrected(described_: DataFrame) -> DataFrame:
    """``(read_id, start, end, corrected)``: the graph's bases under each alignment."""
    return described_.select("read_id", F.col("read_start").cast("long").alias("start"), F.col("read_end").cast("long").alias("end"), F.col("graph_seq").alias("corrected"))
