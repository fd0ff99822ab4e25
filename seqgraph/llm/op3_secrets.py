"""Secret scan with character Markov models, in DataFrame functions only.

Base spans come from three fixed patterns. The method adds spans: two first-order character models, one of random
strings and one of ordinary identifiers, are trained from labelled samples (values of base spans against plain words of
texts without any, alone and joined in the ways that names in programs, paths, dates and rulers are written), and each
long token that touches no base span is scored by the log-likelihood ratio of the two.

Each text is scanned in its row: there is no shuffle, and what is sent to the tasks is one table of 128 x 128 numbers.
Training reads all documents.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgraph.checkpoints import saved
from seqgraph.llm.common import table

# The patterns of the base spans and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = {"assign": (ASSIGN, 2, 12), "access": (ACCESS, 0, 18), "hex": (r"[0-9a-f]{16,}", 0, 16)}
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"[A-Za-z_][A-Za-z0-9_]{5,}"
RULES = "=-_/+"
SPAN = "struct<start:int,kind:int,end:int,value:string>"
BASE, ADDED, CANDIDATES = "secret spans: base", "secret spans: added", "secret spans: candidates"
NAMES = ["assign", "access", "hex", "markov"]


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def before(values: Column, op, start: int) -> Column:
    """For each place of an array of longs, ``op`` over the values before it, from ``start``.

    Arrays grow by one in a copy, so the array is cut in runs of about the root of its length; each is gone through by
    itself, and then what lies before each run: the cost grows with length to the power of 3/2.
    """
    none = F.array().cast("array<bigint>")

    def through(a: Column) -> Column:
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(a, F.struct(F.lit(start).cast("long").alias("at"), none.alias("out")), step)

    def whole(a: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(a))).cast("int")
        runs = F.transform(F.sequence(F.lit(1), F.size(a), size), lambda i: through(F.slice(a, i, size)))
        return let(runs, lambda r: F.flatten(F.zip_with(r, through(F.transform(r, lambda x: x["at"]))["out"], lambda x, first: F.transform(x["out"], lambda v: op(v, first)))))

    return let(values, lambda a: F.when(F.size(a) == 0, none).otherwise(whole(a)))


def found(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """All leftmost non-overlapping matches whose ``group`` has ``least`` characters, with code-point places."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.slice(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value")), 1, F.size(whole))
    length = lambda x: (F.length(x["gap"]) + F.length(x["whole"])).cast("long")
    one = lambda x, at: F.struct((at + F.length(x["gap"])).cast("int").alias("start"), F.lit(kind).alias("kind"), (at + length(x)).cast("int").alias("end"), x["value"].alias("value"))
    every = let(steps, lambda s: F.zip_with(F.filter(s, lambda x: x["whole"].isNotNull()), before(F.transform(s, length), lambda a, b: a + b, 0), one))
    return F.when(F.rlike(text, F.lit(pattern)), F.filter(every, lambda x: F.length(x["value"]) >= least)).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds the column BASE: the spans of the three patterns by place, then kind."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn(BASE, F.array_sort(F.concat(*(found(text, p, group, least, k) for k, (p, group, least) in enumerate(KINDS.values())))))


def joined(words: DataFrame, groups: int = 1024) -> DataFrame:
    """``(label, v, c)``: identifiers as programs write them, made of three words each of ``(v, c)``.

    A word's neighbours are the next ones of its hash group, and its hash gives the numbers. All words are taken in all
    forms. ``c`` is the sum of the words' counts.
    """
    held = words.groupBy(F.pmod(F.xxhash64("v"), F.lit(groups)).alias("g")).agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("held"))
    of = lambda i: F.element_at("held", (F.pmod(i, F.size("held")) + 1).cast("int"))
    three = held.select(F.explode(F.transform("held", lambda _, i: F.struct(of(i).alias("a"), of(i + 1).alias("b"), of(i + 2).alias("d")))).alias("t"))
    a, b, d = (F.col(f"t.{x}.v") for x in "abd")
    number = lambda seed, below: F.pmod(F.xxhash64(a, F.lit(seed)), F.lit(below))
    two = lambda seed, below: F.lpad(number(seed, below).cast("string"), 2, "0")
    day = F.date_format(F.date_add(F.to_date(F.lit("1990-01-01")), number(1, 16_000).cast("int")), "yyyy-MM-dd")
    forms = [
        F.lower(F.concat_ws("_", a, b, d)), F.upper(F.concat_ws("_", a, b, d)), F.lower(F.concat_ws("-", a, b, d)), F.concat_ws("/", a, b, d), F.concat(F.initcap(a), F.initcap(b), F.initcap(d)),
        F.concat(F.lower(a), F.lit("_"), F.lower(b), F.lit("_v"), number(2, 100).cast("string")), F.concat(F.lower(a), number(3, 2_000).cast("string"), F.lit("/"), b, F.lit("-"), number(4, 100).cast("string")),
        F.concat(day, F.lit("T"), two(5, 24), F.lit("-"), two(6, 60), F.lit("-"), two(7, 60), F.lit("Z")),
    ]
    return three.select(F.lit(0).alias("label"), F.explode(F.array(*forms)).alias("v"), (F.col("t.a.c") + F.col("t.b.c") + F.col("t.d.c")).alias("c"))


def fit(docs: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of ASCII characters, random over ordinary, as 128 * first + second.

    From the words of all rows. Without words of either label all ratios are 0, and the method adds nothing.
    """
    docs = base_spans(docs.select("text").where("text is not null"))
    labelled = lambda values, label: F.transform(values, lambda v: F.struct(F.lit(label).alias("label"), v.alias("v")))
    values = F.when(F.size(BASE) > 0, labelled(F.transform(BASE, lambda b: b["value"]), 1)).otherwise(labelled(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0)), 0))
    words = saved(docs.select(F.explode(values).alias("x")).groupBy("x.label", "x.v").agg(F.count("*").alias("c")), "op3-words")  # used twice
    # an identifier counts a ninth of its words' counts, so that the forms weigh in proportion to the words
    words = words.withColumn("c", F.col("c") * 9).union(joined(words.where("label = 0").select("v", "c")))
    places = words.where("length(v) > 1").select("label", "v", "c", F.explode(F.sequence(F.lit(1), F.length("v") - 1)).alias("i"))
    code = lambda i: F.ascii(F.substring("v", i, F.lit(1)))
    pairs = places.select("label", "c", (code(F.col("i")) * 128 + code(F.col("i") + 1)).alias("p"))
    counts = {(r.label, r.p): r.c for r in pairs.groupBy("label", "p").agg((F.sum("c") / 9).alias("c")).collect()}
    return ratios(counts)


def ratios(counts: dict[tuple[int, int], float]) -> list[float]:
    """From counts by (label, pair). Pairs that a label lacks fall back on its single characters: those of random
    strings are taken as half even over the 96 printable ones, so characters that the texts lack cost little. Rulers
    of one sign are ordinary."""
    if {k for k, _ in counts} != {0, 1}:
        return [0.0] * 128 * 128
    counts = counts | {}
    plain = sum(c for (label, _), c in counts.items() if label == 0)
    for x in map(ord, RULES):
        counts[0, x * 129] = counts.get((0, x * 129), 0) + plain // 200
    rows, after, total = ([0] * 128, [0] * 128), ([0] * 128, [0] * 128), [0, 0]
    for (label, pair), c in counts.items():
        rows[label][pair // 128] += c
        after[label][pair % 128] += c
        total[label] += c

    def p(label: int, pair: int) -> float:
        single = (after[label][pair % 128] + 1) / (total[label] + 96)
        back, weight = ((single + 1 / 96) / 2, 200) if label else (single, 10)
        return (counts.get((label, pair), 0) + weight * back) / (rows[label][pair // 128] + weight)

    return [round(math.log(p(1, x) / p(0, x)), 6) for x in range(128 * 128)]


def scan(docs: DataFrame, model: list[float], least_mean: float = 2.0, least_sum: float = 25.0) -> DataFrame:
    """Adds the columns BASE and ADDED: spans of the patterns, and of tokens that the models find random.

    A token is added if its ratio is at least ``least_sum`` in total and ``least_mean`` a pair, and it overlaps no base
    span. A null text is an empty one and has no span.
    """
    docs = base_spans(docs)
    text = F.coalesce("text", F.lit(""))
    ratio = F.from_json(F.lit(json.dumps(model)), "array<double>")

    def random(span: Column) -> Column:
        codes = F.transform(F.split(span["value"], ""), lambda x: F.ascii(x))
        n = F.length(span["value"])
        total = F.aggregate(F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1), lambda a, b: F.element_at(ratio, a * 128 + b + 1)), F.lit(0.0), lambda acc, x: acc + x)
        return total >= F.greatest(F.lit(least_sum), least_mean * (n - 1))

    # by place, base spans before a candidate of the same one: it touches none if those before it have ended, and the next one begins behind it
    far = 1 << 31
    ends = lambda m: before(F.transform(m, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0).cast("long")), F.greatest, 0)
    starts = lambda m: F.reverse(before(F.reverse(F.transform(m, lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(far).cast("long"))), F.least, far))
    free = lambda m: let(ends(m), lambda e: let(starts(m), lambda s: F.filter(m, lambda x, i: (x["kind"] == 3) & (F.get(e, i) <= x["start"]) & (F.get(s, i) >= x["end"]))))
    apart = F.when(F.size(BASE) == 0, F.col(CANDIDATES)).otherwise(let(F.array_sort(F.concat(BASE, CANDIDATES)), free))
    return docs.withColumn(CANDIDATES, found(text, CANDIDATE, 0, 16, 3)).withColumn(ADDED, F.filter(apart, random)).drop(CANDIDATES)


def told(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, NAMES)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


def report(docs: DataFrame, model: list[float]) -> DataFrame:
    """A row for each row of docs: counts and places of its spans."""
    docs = scan(docs.select("doc_id", "text"), model)
    count = lambda k: F.size(F.filter(BASE, lambda s: s["kind"] == k)).cast("long")
    return docs.select("doc_id", *(count(k).alias(f"n_{n}") for k, n in enumerate(KINDS)), F.sha2(told(F.col(BASE)), 256).alias("base_sha256"), told(F.array_sort(F.concat(BASE, ADDED))).alias("spans"), F.size(ADDED).cast("long").alias("n_markov"))


def redact(docs: DataFrame, model: list[float], mark: str = "[secret]") -> DataFrame:
    """Replaces all spans in ``text`` by ``mark``; rows, other columns and texts without spans stay as they are."""
    kept = docs.columns
    docs = scan(docs, model)
    reach = lambda m: before(F.transform(m, lambda x: x["end"].cast("long")), F.greatest, 0)  # noqa: E731  where the spans before one end
    gap = lambda x, e: F.when(x["start"] >= e, F.concat(F.substring(F.col("text"), (e + 1).cast("int"), (x["start"] - e).cast("int")), F.lit(mark))).otherwise("")
    rest = lambda m: F.substring(F.col("text"), F.array_max(F.transform(m, lambda x: x["end"])) + 1, F.length("text"))
    masked = let(F.array_sort(F.concat(BASE, ADDED)), lambda m: F.concat(F.array_join(F.zip_with(m, reach(m), gap), ""), rest(m)))
    return docs.withColumn("text", F.when(F.size(BASE) + F.size(ADDED) > 0, masked).otherwise(F.col("text"))).select(*kept)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return report(docs, fit(docs))


QUERIES = {"op3_secrets": op3_secrets}
SQL: dict = {}
