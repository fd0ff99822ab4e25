"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Card numbers (Luhn), phone numbers, social security numbers, IPv4 addresses, dates and the local parts of e-mail
addresses are found by one pattern and validated. Each is replaced by a keyed permutation within its own format, so one
value has one pseudonym in all documents, two values never share one, and separators and lengths stay.

The permutation is a Feistel network over an array of symbols: in each round one half is shifted, symbol by symbol, by
SHA-256 of key, round and the other half. It works for any length and radix: digits (10), address bytes (256), letters
and digits (36). A card's check digit is computed anew, so valid numbers map to valid ones. A date is its day in a cycle of 400
years, 146097 = 189 * 773 days, permuted as a pair of residues, so that every pseudonym is a real day.

All work happens within the row of a text; nothing is shuffled, collected or broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgraph.llm.common import table

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"
ISO = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
SLASHED = r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)"
NATIONAL = r"(?<![\d+(-])(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?!-?\d)"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"
PATTERN = "|".join((EMAIL, ADDRESS, ISO, SLASHED, SOCIAL, PHONE, NATIONAL, CARD))
KINDS = ("email", "address", "date", "social", "phone", "card")
CYCLE, PARTS, FIRST_DAY = 146097, (189, 773), "1800-01-01"


def shift(key: str, tweak: str, round_: Column, other: Column, i: Column, radix: int) -> Column:
    told = F.concat_ws("|", F.lit(key), F.lit(tweak), round_.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","), i.cast("string"))
    return (F.conv(F.substring(F.sha2(told, 256), 1, 12), 16, 10).cast("long") % radix).cast("int")


def permuted(symbols: Column, radix: int, key: str, tweak: str) -> Column:
    """Keyed permutation of all arrays of this length over 0 .. radix - 1."""
    none = F.array().cast("array<int>")
    own = F.transform(symbols, lambda x, i: ((x + shift(key, tweak + "/place", F.lit(0), none, i, radix)) % radix).cast("int"))

    def both(whole: Column) -> Column:
        half = (F.size(whole) / 2).cast("int")
        return F.struct(F.slice(whole, 1, half).alias("a"), F.slice(whole, half + 1, F.size(whole)).alias("b"))

    def step(acc: Column, r: Column) -> Column:
        return F.struct(acc["b"].alias("a"), F.transform(acc["a"], lambda x, i: ((x + shift(key, tweak, r, acc["b"], i, radix)) % radix).cast("int")).alias("b"))

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    start = F.aggregate(F.array(own), F.struct(none.alias("a"), none.alias("b")), lambda acc, x: both(x))
    return F.aggregate(rounds, start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def digits(value: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(value, r"\D", ""), ""), lambda x: x.cast("int"))


def refilled(value: Column, symbols: Column, places: str) -> Column:
    """``value`` with its characters of class ``places`` replaced by the symbols, one by one, as digits of base 36."""
    fill = F.transform(symbols, lambda x: F.lower(F.conv(x.cast("string"), 10, 36)))
    step = lambda acc, c: F.struct(F.when(F.rlike(c, F.lit(places)), acc["k"] + 1).otherwise(acc["k"]).alias("k"), F.concat(acc["out"], F.when(F.rlike(c, F.lit(places)), F.element_at(acc["fill"], acc["k"] + 1)).otherwise(c)).alias("out"), acc["fill"].alias("fill"))
    return F.aggregate(F.split(value, ""), F.struct(F.lit(0).alias("k"), F.lit("").alias("out"), fill.alias("fill")), step, lambda acc: acc["out"])


def luhn_sum(symbols: Column) -> Column:
    """Luhn sum of digits whose last is not doubled."""
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    return F.aggregate(F.transform(F.reverse(symbols), lambda x, i: F.when(i % 2 == 1, twice(x)).otherwise(x)), F.lit(0), lambda a, x: a + x)


def day(value: Column) -> Column:
    """The date that value is, or null."""
    return F.when(F.rlike(value, F.lit(f"^{ISO}$")), F.try_to_date(value, "yyyy-MM-dd")).when(F.rlike(value, F.lit(f"^{SLASHED}$")), F.coalesce(F.try_to_date(value, "dd/MM/yyyy"), F.try_to_date(value, "MM/dd/yyyy")))


def kind_of(value: Column) -> Column:
    """The kind of a match, or null if it is not valid."""
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    found = lambda p: F.rlike(value, F.lit(f"^(?:{p})$"))
    return (
        F.when(F.contains(value, F.lit("@")), "email")
        .when(found(ADDRESS), F.when(F.forall(octets, lambda x: x <= 255), "address"))
        .when(found(ISO) | found(SLASHED), F.when(day(value).isNotNull(), "date"))
        .when(found(SOCIAL), F.when(~F.rlike(value, F.lit(r"^(?:000|666|9)|-00-|-0000$")), "social"))
        .when(F.startswith(value, F.lit("+")), F.when(F.size(digits(value)).between(8, 15), "phone"))
        .when(found(NATIONAL), "phone")
        .when(luhn_sum(digits(value)) % 10 == 0, "card")
    )


def card_within(value: Column) -> Column:
    """``(before, card, behind)`` of the first run of digit groups that is a valid card number, the longest there; or null."""
    at = F.sequence(F.lit(1), F.length(value))
    gap = lambda i: ~F.rlike(F.substring(value, i, F.lit(1)), F.lit(r"^\d$"))
    starts = F.filter(at, lambda i: ~gap(i) & ((i == 1) | gap(i - 1)))
    ends = F.reverse(F.filter(at, lambda i: ~gap(i) & ((i == F.length(value)) | gap(i + 1))))
    part = lambda i, j: F.struct(F.substring(value, F.lit(1), i - 1).alias("before"), F.substring(value, i, j - i + 1).alias("card"), F.substring(value, j + 1, F.length(value)).alias("behind"))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(ends, lambda j: j - i >= 12), lambda j: part(i, j))))
    return F.get(F.filter(parts, lambda p: (F.size(digits(p["card"])) >= 13) & (luhn_sum(digits(p["card"])) % 10 == 0)), F.lit(0))


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    code = F.regexp_extract(value, r"^\+\d{1,3}(?=\D)|^\+\d", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    alnum = F.transform(F.split(F.regexp_replace(F.lower(local), "[^a-z0-9]", ""), ""), lambda c: F.conv(c, 36, 10).cast("int"))
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    body = permuted(F.slice(digits(value), 1, F.size(digits(value)) - 1), 10, key, "card")
    card = F.aggregate(F.array(body), F.array().cast("array<int>"), lambda acc, b: F.concat(b, F.array(((10 - luhn_sum(F.concat(b, F.array(F.lit(0)))) % 10) % 10).cast("int"))))
    index = F.pmod(F.date_diff(day(value), F.lit(FIRST_DAY).cast("date")), F.lit(CYCLE))
    mixed = lambda acc, r: F.struct(
        ((acc["a"] + shift(key, "date", 2 * r, F.array(acc["b"]), F.lit(0), PARTS[0])) % PARTS[0]).cast("int").alias("a"), acc["b"].alias("b")
    )
    other = lambda acc, r: F.struct(acc["a"].alias("a"), ((acc["b"] + shift(key, "date", 2 * r + 1, F.array(acc["a"]), F.lit(0), PARTS[1])) % PARTS[1]).cast("int").alias("b"))
    turns = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), lambda r: F.array(2 * r, 2 * r + 1)))
    step = lambda acc, r: F.when(r % 2 == 0, mixed(acc, r)).otherwise(other(acc, r))
    moved = F.aggregate(turns, F.struct((index % PARTS[0]).cast("int").alias("a"), (index / PARTS[0]).cast("int").alias("b")), step, lambda acc: acc["a"] + PARTS[0] * acc["b"])
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), moved)
    date = F.when(F.contains(value, F.lit("/")), F.when(F.try_to_date(value, "dd/MM/yyyy").isNotNull(), F.date_format(moved, "dd/MM/yyyy")).otherwise(F.date_format(moved, "MM/dd/yyyy"))).otherwise(F.date_format(moved, "yyyy-MM-dd"))
    return (
        F.when(kind == "email", F.concat(refilled(local, permuted(alnum, 36, key, "email"), "[A-Za-z0-9]"), F.lit("@"), domain))
        .when(kind == "address", F.array_join(F.transform(permuted(octets, 256, key, "address"), lambda x: x.cast("string")), "."))
        .when(kind == "date", date)
        .when(kind == "social", refilled(value, permuted(digits(value), 10, key, "social"), r"\d"))
        .when(kind == "phone", F.concat(code, refilled(rest, permuted(digits(rest), 10, key, "phone"), r"\d")))
        .when(kind == "card", refilled(value, card, r"\d"))
        .otherwise(value)
    )


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """Replaces ``text`` and adds ``n_<kind>`` for each kind; a column of docs of that name is replaced.

    Null, empty and clean texts stay as they are, with counts of 0; repeated rows stay. A number that is not valid (a
    failed check digit, an octet over 255, no real day) is left alone, but for a card number that is some of its digit groups. A slashed date is dd/MM/yyyy, or
    MM/dd/yyyy where only that is a day; pseudonyms of the two may coincide. A social security number's pseudonym has the
    format of one but need not be in use.
    """
    kept = [c for c in docs.columns if c not in {f"n_{k}" for k in KINDS}]
    # every alternative of the pattern has an @ or a digit, which is far cheaper to look for
    values = F.when(F.rlike("text", F.lit("[@0-9]")) & F.rlike("text", F.lit(PATTERN)), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumn("private values", values)
    docs = docs.withColumn("private kinds", F.transform("private values", kind_of))
    inner = F.zip_with("private values", "private kinds", lambda v, k: F.when(k.isNull() & F.rlike(v, F.lit(f"^{CARD}$")), card_within(v)))
    docs = docs.withColumn("private cards", inner)
    docs = docs.withColumn("private kinds", F.zip_with("private kinds", "private cards", lambda k, c: F.coalesce(k, F.when(c.isNotNull(), "card"))))
    docs = docs.withColumn("private pairs", F.zip_with("private values", "private cards", lambda v, c: F.struct(v.alias("v"), c.alias("c"))))
    told = lambda p, k: F.concat(F.coalesce(p["c"]["before"], F.lit("")), pseudonym(F.coalesce(p["c"]["card"], p["v"]), k, key), F.coalesce(p["c"]["behind"], F.lit("")))
    swapped = F.zip_with("private pairs", "private kinds", told)
    joined = F.array_join(F.flatten(F.zip_with(F.split("text", PATTERN, -1), swapped, lambda gap, v: F.array(gap, F.coalesce(v, F.lit(""))))), "")
    text = F.when(F.size(F.array_compact("private kinds")) > 0, joined).otherwise(F.col("text"))
    of = lambda kind: F.size(F.filter("private kinds", lambda x: x == kind))
    counts = [of(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return docs.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in kept), *counts)


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold personal data, with their pseudonymised texts."""
    done = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key="corpus-2024")
    return done.where(" + ".join(f"n_{k}" for k in KINDS) + " > 0")


QUERIES = {"op2_pseudonyms": op2_pseudonyms}
SQL: dict = {}
