import random

from seqgraph.llm.common import fold
from seqgraph.llm.op1_language_id import Profiles, fit, grams, identify, ranked


def texts(seed, n):
    r = random.Random(seed)
    parts = {"en": ["the", "tion", "and", "ing", "er"], "de": ["sch", "ung", "keit", "ä", "der"], "fr": ["eau", "é", "que", "la", "oi"]}
    return [(i, " ".join("".join(r.choices(p, k=2)) for _ in range(30)), lang) for i, (lang, p) in enumerate(r.choices(list(parts.items()), k=n))]


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(texts(1, 400), "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(docs, fit(docs.where(fold("doc_id", 5) != 0))).collect()}
    held = [r for r in docs.collect() if got[r.doc_id].held_out]
    assert len(held) > 40
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 .. 34", None), (4, "the and", "en"), (4, "the and", "en"), (None, "der sch", "de"), (6, "x" * 200_000, None), (7, "𝒳 字 ß", "fr")]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = identify(docs, fit(docs)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 3, 4)} == {1: "und", 2: "und", 3: "und", 4: "en"}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    empty = docs.limit(0)
    assert identify(empty, fit(empty)).count() == 0
    assert {r.lang_pred for r in identify(docs, fit(empty)).collect()} == {"und"}


def test_distance_is_out_of_place():
    import numpy as np

    p = Profiles([("a", 5, 0), ("a", 7, 1), ("b", 7, 0)], top=3)
    codes = np.array([1, 5, 7, 7, 1])
    own = ranked(*grams(codes), 3).tolist()
    want = {}
    for lang, ranks in {"a": {5: 0, 7: 1}, "b": {7: 0}}.items():
        want[lang] = sum(abs(ranks[g] - i) if g in ranks else 3 for i, g in enumerate(own))
    lang, score = p.best(codes)
    assert lang == min(want, key=want.get)
    assert abs(score - (1 - want[lang] / (3 * len(own)))) < 1e-12


def test_profiles_learn_from_every_labelled_row(spark, monkeypatch):
    """A language of one row is learned wherever that row lies, also where n-grams are added up in many parts."""
    import seqgraph.llm.op1_language_id as op1
    from pyspark.sql import functions as F

    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("the and").alias("text"), F.lit("en").alias("lang"))
    (last,) = docs.orderBy(F.desc(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)))).select("doc_id").first()
    own = F.col("doc_id") == last
    docs = docs.withColumn("text", F.when(own, "sch ung").otherwise(F.col("text"))).withColumn("lang", F.when(own, "de").otherwise(F.col("lang")))
    assert fit(docs).langs == ["de", "en"]
    rows = spark.createDataFrame(texts(4, 60), "doc_id long, text string, lang string")
    counted = sorted(map(tuple, rows.select("lang", "text").mapInArrow(op1._count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c")).collect()))
    monkeypatch.setattr(op1, "HELD", 100)
    batches = list(op1._count([op1.pa.RecordBatch.from_pylist([r.asDict() for r in rows.select("lang", "text").collect()])]))
    parts = {}
    for b in batches:
        for x in b.to_pylist():
            parts[x["lang"], x["gram"]] = parts.get((x["lang"], x["gram"]), 0) + x["c"]
    assert len(batches) > 20 and sorted((*k, c) for k, c in parts.items()) == counted


def test_least_scores_count_every_labelled_row(spark):
    from seqgraph.llm.op1_language_id import least_scores

    r = random.Random(6)
    rows = [(r.choice(["en", "de"]), r.choice(["en", "en", "de"]), r.random()) for _ in range(30_000)] + [(None, "en", 0.0), ("fr", "en", 0.0)]
    got = least_scores(spark.createDataFrame(rows, "lang string, lang_pred string, score double"))
    assert set(got) == {"en", "de"}
    for lang, score in got.items():
        right = sorted(s for a, b, s in rows if a == b == lang)
        assert abs(score / 0.8 - right[-(-len(right) // 100) - 1]) <= 1e-4 + 1e-12
