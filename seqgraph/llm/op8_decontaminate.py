"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units of a text become typed placeholders, so a question whose values were changed keeps its
template. Windows of ``n`` template words are hash-joined between documents and benchmark; an item of fewer words is one
window of its own length. Windows with fewer than ``literals`` ordinary words say little alone and are left out, unless
an item has no other: then all its windows must be there, with the item's own values. In mid-sentence an opening word may
look like a name, so such items and those of one window are sought in that form too. Joined windows of one document,
item and shift form a match. Its slots are then compared: one value of the item must stand for one value in the document
all along, and two values for two, or the match is dropped as chance. Items of fewer than ``least_words`` words are too
short to tell a leak from common speech and are left out.

The benchmark's windows are broadcast only when their count is under ``broadcast_rows``; beyond it both sides are
shuffled by the window's hash, and a bit map of fixed size keeps most of the documents' other windows out of the shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgraph.checkpoints import saved
from seqgraph.llm.common import table

# Units of measure, and what a number and a name in mid-sentence look like. Repeats are possessive: they find
# the same, and a run of any length takes no depth of the stack.
UNITS = "mm cm m km mg g kg t ml l s ms min h hour hours minute minutes second seconds day days week weeks month months year years mile miles inch inches foot feet yard yards pound pounds ounce ounces dollar dollars euro euros cent cents percent degree degrees".split()
NUMBER = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*+"
NAME = r"(?<=[\p{Ll}\p{Nd},;]\x20)\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)*+"
UNIT = r"(?<=\x200\x20)\x20?(?:" + "|".join(UNITS) + r")(?![\p{L}\p{Nd}])"
GAP = r"[^\p{L}\p{Nd}]+"


def numbered(text: Column) -> Column:
    return F.regexp_replace(text, NUMBER, " 0 ")


def named(text: Column) -> Column:
    return F.regexp_replace(numbered(text), NAME, " 1 ")


def template(text: Column) -> Column:
    """Lower-case words with 0 for a number, 1 for a name and 2 for a unit after a number."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(named(text), UNIT, " 2 ")), GAP), "")


def with_windows(rows: DataFrame, n: int) -> DataFrame:
    """Adds ``wins``: the hash of each run of ``n`` of the words in ``words``; none for fewer words.

    The words' hashes are a column of their own, used more than once, so that the optimizer computes them once a row
    and does not move them into the function that runs for each window.
    """
    rows = rows.withColumn("codes", F.transform("words", lambda w: F.xxhash64(w)))
    count = F.size("codes") - n + 1
    wins = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice("codes", i, n)))).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("wins", wins).drop("codes")


def slots(rows: DataFrame, key: str, words: str = "words") -> DataFrame:
    """``(key, at, kind, value)`` of each number, name and unit: the k-th placeholder of a kind is its pattern's k-th match."""
    text = F.coalesce("text", F.lit(""))

    def of(kind: str, values: Column) -> DataFrame:
        at = F.filter(F.transform(words, lambda w, i: F.when(w == kind, i)), lambda i: i.isNotNull())
        return rows.select(key, F.lit(kind).alias("kind"), F.explode(F.arrays_zip(at.alias("at"), values.alias("value"))).alias("s")).select(key, "s.at", "kind", "s.value")

    every = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return of("0", every(text, NUMBER)).union(of("1", every(numbered(text), NAME))).union(of("2", F.transform(every(named(text), UNIT), F.trim)))


def literal_windows(n: int, literals: int) -> Column:
    """Whether each window of ``words`` holds so many ordinary words."""
    m = F.least(F.lit(n), F.size("words"))
    return F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.size(F.filter(F.slice("words", i, m), lambda w: ~w.isin("0", "1", "2"))) >= literals)


def bits(keys: DataFrame, log2: int) -> Column:
    """A bit for each hash modulo 2**log2, in one literal array of 64-bit words."""
    at = F.col("h").bitwiseAND(F.lit((1 << log2) - 1))
    words = keys.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(h & 63))")).alias("b"))
    out = [0] * (1 << (log2 - 6))
    for r in words.toLocalIterator():
        out[r.w] = r.b
    return F.from_json(F.lit(json.dumps(out)), "array<bigint>")


def is_marked(marks: Column, log2: int) -> Column:
    at = (F.shiftright(F.col("h").bitwiseAND(F.lit((1 << log2) - 1)), 6) + 1).cast("int")
    return F.getbit(F.element_at(marks, at), F.col("h").bitwiseAND(F.lit(63)).cast("int")) == 1


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 8, literals: int = 5, least_windows: int = 1, broadcast_rows: int = 1 << 20, map_log2: int = 23, least_words: int = 2) -> DataFrame:
    """``(doc_id, item_id, shift, n_windows, coverage, n_slots, n_changed)`` for each consistent match.

    ``coverage`` is the share of the item's windows. Null texts and texts without words match nothing. Rows of docs with
    one id count as one document; rows of a null id are ignored. Two items with one text both match; an item of fewer
    than ``least_words`` words matches none. An empty table on either side gives no row.
    """
    # each step is written: words are used many times over, and the optimizer would compute them as often
    items = benchmark.where("text is not null").select(F.struct("item_id", F.lit(0).alias("form")).alias("item"), "text").withColumn("words", template(F.col("text")))
    items = saved(items, "op8-items").where(F.size("words") >= max(1, least_words))
    items = saved(items.withColumn("plain", literal_windows(n, literals)).withColumn("strict", ~F.exists("plain", lambda x: x)), "op8-items")
    inner = items.where((F.size("words") <= n) | F.col("strict")).select(F.struct("item.item_id", F.lit(1).alias("form")).alias("item"), F.concat(F.lit("x "), "text").alias("text"), F.col("words").alias("usual"))
    inner = saved(inner.withColumn("words", template(F.col("text"))), "op8-items").withColumn("words", F.slice("words", 2, F.size("words"))).where("words <> usual").select("item", "text", "words")
    inner = saved(inner, "op8-items").withColumn("plain", literal_windows(n, literals)).withColumn("strict", ~F.exists("plain", lambda x: x))
    items = saved(items.union(inner).withColumn("m", F.least(F.lit(n), F.size("words"))), "op8-items")
    lengths = sorted(r.m for r in items.select("m").distinct().collect())  # at most n numbers
    if not lengths:
        lengths = [n]

    def of_length(rows: DataFrame, m: int, *kept: str) -> DataFrame:
        return with_windows(rows, m).select(*kept, F.lit(m).alias("m"), F.posexplode_outer("wins").alias("at", "h")).where("h is not null")

    parts = None
    for m in lengths:
        own = of_length(items.where(F.col("m") == m), m, "item", F.size("words").alias("size"), "strict", "plain").where("strict or element_at(plain, at + 1)").drop("plain")
        parts = own if parts is None else parts.union(own)
    parts = saved(parts.distinct(), "op8-parts")
    few = parts.count() <= broadcast_rows
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    words = docs.select("doc_id", template(F.col("text")).alias("words"))
    marks = None if few else bits(parts.select("h"), map_log2)
    there = None
    for m in lengths:
        own = of_length(words, m, "doc_id").withColumnRenamed("at", "pos").drop("m")
        own = own if few else own.where(is_marked(marks, map_log2))
        there = own if there is None else there.union(own)
    hits = there.join(F.broadcast(parts) if few else parts, "h").groupBy("doc_id", "item", (F.col("pos") - F.col("at")).alias("shift"), "size", "m", "strict").agg(F.count_distinct("at").alias("n_windows"), F.min("at").alias("first"), F.max("at").alias("last"))
    enough = F.when(F.col("strict"), F.col("n_windows") == F.col("size") - F.col("m") + 1).otherwise(F.col("n_windows") >= least_windows)
    hits = saved(hits.where(enough), "op8-hits")

    wanted = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("words", template(F.col("text")))
    own = slots(wanted, "doc_id").distinct().withColumnRenamed("value", "doc_value").withColumnRenamed("at", "doc_at")
    theirs = slots(items.join(hits.select("item").distinct(), "item", "left_semi"), "item").distinct()
    pairs = hits.join(theirs, "item").where(F.col("at").between(F.col("first"), F.col("last") + F.col("m") - 1)).withColumn("doc_at", F.col("at") + F.col("shift")).join(own, ["doc_id", "doc_at", "kind"])
    pairs = pairs.groupBy("doc_id", "item", "shift").agg(F.count_distinct("kind", "value").alias("n_slots"), F.count_distinct("kind", "value", "doc_value").alias("n_pairs"), F.count_distinct("kind", "doc_value").alias("n_values"), F.count_distinct(F.when(F.col("value") != F.col("doc_value"), F.struct("kind", "value"))).alias("n_changed"))
    told = hits.join(pairs, ["doc_id", "item", "shift"], "left").where((F.coalesce((F.col("n_pairs") == F.col("n_slots")) & (F.col("n_pairs") == F.col("n_values")), F.lit(True))) & (~F.col("strict") | (F.coalesce("n_changed", F.lit(0)) == 0)))
    return told.select("doc_id", "item.item_id", "shift", "n_windows", F.round(F.col("n_windows") / (F.col("size") - F.col("m") + 1), 6).alias("coverage"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("n_changed", F.lit(0)).alias("n_changed"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontaminate": op8_decontaminate}
SQL: dict = {}
