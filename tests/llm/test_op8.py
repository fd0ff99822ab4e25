import random

from seqgraph.llm.op8_decontaminate import contaminated

WORDS = [f"{a}{b}" for a in ("lo", "mi", "ter", "ban", "qu") for b in ("ra", "den", "ik", "ost", "ulm", "e")]


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def prose(r, k):
    return " ".join(r.choices(WORDS, k=k))


def test_verbatim_and_reparameterised(spark):
    r = random.Random(1)
    items = [(i, prose(r, 20)) for i in range(20)]
    items[0] = (0, "a shop where Anna Berg sells 12 kg of apples and later, Anna Berg sells 12 kg of pears each")
    docs = [(100 + i, prose(r, 200)) for i in range(40)]
    docs += [(i, prose(r, 50) + ". " + t + " " + prose(r, 50)) for i, t in items]
    docs += [(50, "Here a shop where Carl sells 7.5 miles of apples and later, Carl sells 7.5 miles of pears each")]
    docs += [(51, "Here a shop where Carl sells 7 kg of apples and later, Dora sells 9 kg of pears each")]
    d, b = tables(spark, docs, items)
    got = contaminated(d, b).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(i, i) for i in range(20)} | {(50, 0)}
    assert next(x for x in got if x.doc_id == 50).n_changed == 3
    assert next(x for x in got if x.doc_id == 0).n_changed == 0
    shuffled = contaminated(d, b, broadcast_rows=0).collect()
    assert sorted(shuffled) == sorted(got)


def test_windows_equal_brute_force(spark):
    r = random.Random(5)
    items = [(i, prose(r, r.randint(5, 15))) for i in range(15)]
    docs = []
    for d in range(150):
        w = prose(r, 30).split()
        k = r.randrange(15)
        part = items[k][1].split()
        a = r.randrange(len(part))
        w[10:10] = part[a : a + r.randint(6, 10)]
        docs.append((d, " ".join(w)))
    want = set()
    for d, t in docs:
        w = t.split()
        for k, x in items:
            v = x.split()
            m = min(8, len(v))
            have = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
            if any(tuple(v[i : i + m]) in have for i in range(len(v) - m + 1)):
                want.add((d, k))
    assert {(x.doc_id, x.item_id) for x in contaminated(*tables(spark, docs, items)).collect()} == want
    assert want


def test_short_and_dense_items(spark):
    items = [(1, "What is the capital of France?"), (2, "What is 12 times 7 plus 9?"), (3, "Add 3 km, 4 km, 5 km and 6 km"), (4, "Name it"), (5, "12 15 18 21 24 27 30 33 36 40")]
    docs = [(1, "he asked: What is the capital of France? and left"), (2, "so, What is 12 times 7 plus 9? he said"), (3, "now Add 3 km, 4 km, 5 km and 6 km to it"), (4, "please Name it now"), (5, "row 12 15 18 21 24 27 30 33 36 40 end"), (12, "so, What is 13 times 7 plus 9? he said"), (13, "now Add 3 km, 4 km, 5 km and 7 km to it"), (23, "now Add 3 miles, 4 miles, 5 miles and 6 miles to it"), (14, "please Name that"), (15, "row 12 15 18 21 24 27 30 33 36 41 end"), (11, "What is the colour of France?")]
    d, b = tables(spark, docs, items)
    got = contaminated(d, b).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(i, i) for i in range(1, 6)}
    assert sorted(contaminated(d, b, broadcast_rows=0).collect()) == sorted(got)
    assert sorted(contaminated(d, b, broadcast_rows=0, map_log2=7).collect()) == sorted(got)


def test_edges(spark):
    d, b = tables(spark, [(1, None), (None, "x"), (2, ""), (3, "1 2 3 4 5 6 7 8 9 10"), (4, "w " * 50_000), (4, "w " * 9)], [(1, None), (None, "w w w w w w w w"), (2, "1 2 3 4 5 6 7 8 9"), (3, "short")])
    d = d.selectExpr("*", "1 as item_id", "2 as h", "3 as pos")
    got = contaminated(d, b).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(4, None), (3, 2)}
    assert sorted(contaminated(d, b, broadcast_rows=0).collect(), key=str) == sorted(got, key=str)
    assert contaminated(d.limit(0), b).count() == 0
    assert contaminated(d, b.limit(0)).count() == 0


def test_single_words_and_values_that_fall_together(spark):
    items = [(1, "Yes"), (2, "a shop sells 12 apples and 5 pears and 300 plums and keeps 12 jars on the long shelf")]
    of = lambda *v: "here a shop sells {} apples and {} pears and {} plums and keeps {} jars on the long shelf now".format(*v)
    docs = [(1, "Yes he said yes"), (2, of(12, 5, 300, 12)), (3, of(40, 6, 70, 40)), (4, of(77, 77, 77, 77)), (5, of(40, 6, 70, 41)), (6, of(5, 12, 300, 5))]
    d, b = tables(spark, docs, items)
    assert {(x.doc_id, x.item_id) for x in contaminated(d, b).collect()} == {(2, 2), (3, 2), (6, 2)}
    assert {(x.doc_id, x.item_id) for x in contaminated(d, b, least_words=1).collect()} == {(1, 1), (2, 2), (3, 2), (6, 2)}


def test_long_runs_of_names_and_numbers(spark):
    """A run is one value however long it is: a repeated group that backtracks overflows the stack and ends the executor."""
    item = "a shop where Anna Berg sells 12 apples to each of the guests at noon"
    docs = [(1, "he met " + "Anna Berg " * 20_000 + "there"), (2, "of " + "1.2," * 20_000 + "3 " + item), (3, "here a shop where " + "Carl Ek " * 20_000 + "sells " + "7:5/" * 20_000 + "1 apples to each of the guests at noon")]
    got = contaminated(*tables(spark, docs, [(1, item)])).collect()
    assert {(x.doc_id, x.n_slots, x.n_changed) for x in got} == {(2, 2, 0), (3, 2, 2)}
