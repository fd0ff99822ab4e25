import random

import numpy as np

from seqgraph.llm.op4_chunk_dedup import GEAR, LEAST, MASK, MOST, cuts, deduplicated, gear, repeated_runs


def prose(r, k):
    return " ".join("".join(r.choices("abcdefghijklmnopé", k=r.randint(2, 9))) for _ in range(k))


def brute_cuts(b):
    out, last = [], 0
    for i in range(len(b)):
        cut = False
        if i >= 15:
            h = 0
            for x in b[i - 15 : i + 1]:
                h = (h << 1) + int(GEAR[x]) & 0xFFFFFFFF
            cut = h & int(MASK) == 0
        if i + 1 - last == MOST or i + 1 == len(b) or cut and i + 1 - last >= LEAST:
            out.append(i + 1)
            last = i + 1
    return out


def test_cuts_equal_brute_force():
    r = random.Random(1)
    for k in (0, 1, 3, 40, 400):
        raw = prose(r, k).encode()
        assert cuts(np.frombuffer(raw, np.uint8)) == brute_cuts(raw)
    raw = b"a" * 1000
    assert cuts(np.frombuffer(raw, np.uint8)) == brute_cuts(raw)
    assert len(gear(np.zeros(0, np.uint8))) == 0


def test_repeats_equal_brute_force(spark):
    r = random.Random(2)
    passages = [prose(r, 60) for _ in range(5)]
    docs = []
    for d in range(120):
        t = prose(r, r.randint(0, 150))
        if d % 4 == 0:
            t = t + " " + passages[d % 5] + " " + prose(r, 30)
        docs.append((d, t))
    df = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, start int, h int")
    got = {(x.doc_id, x.start, x.stop, x.first_doc_id) for x in repeated_runs(df, least_bytes=1, map_log2=20).collect()}
    where: dict = {}
    parts = {}
    for d, t in docs:
        raw, last = t.encode(), 0
        for c in brute_cuts(raw):
            parts.setdefault(d, []).append((last, c, raw[last:c]))
            where.setdefault(raw[last:c], set()).add(d)
            last = c
    want = set()
    for d, ps in parts.items():
        run = None
        for a, b, x in ps:
            if len(where[x]) > 1:
                if run and run[1] == a:
                    run[1] = b
                else:
                    if run:
                        want.add((d, *run))
                    run = [a, b, min(where[x])]
        if run:
            want.add((d, *run))
    assert got == want
    flagged = {x.doc_id for x in repeated_runs(df).collect()}
    assert flagged == {d for d in range(120) if d % 4 == 0}
    texts = {x.doc_id: x.text for x in deduplicated(df.select("doc_id", "text")).collect()}
    assert all(texts[d] == t for d, t in docs if d % 4)
    assert sum(len(t) for t in texts.values()) < sum(len(t) for _, t in docs) - 20 * 150


def test_edges(spark):
    t = prose(random.Random(3), 80)
    rows = [(1, None), (2, ""), (None, t), (3, t), (3, t), (4, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeated_runs(df).count() == 0
    assert {x.doc_id for x in repeated_runs(df.union(spark.createDataFrame([(9, "intro. " + t)], df.schema))).collect()} == {3, 9}
    assert repeated_runs(df.limit(0)).count() == 0
    assert deduplicated(df).count() == len(rows)


def test_every_repeated_passage_survives_exactly_once(spark):
    r = random.Random(4)
    a, b, c = (prose(r, 80) for _ in range(3))
    gap = lambda: " " + prose(r, 40) + " "
    docs = [(1, gap() + a + gap()), (5, gap() + a + b + gap()), (7, gap() + c + gap() + c + gap()), (9, gap() + b + a + gap()), (11, gap() + c + a + gap())]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    texts = "\n".join(x.text for x in deduplicated(df).collect())
    for passage in (a, b, c):  # chunks at its edges differ with their surroundings
        raw = passage.encode()
        inner = [raw[i:j].decode("utf-8", "ignore") for i, j in zip(brute_cuts(raw)[2:-3], brute_cuts(raw)[3:-2], strict=True)]
        assert inner and [texts.count(x) for x in inner] == [1] * len(inner)
