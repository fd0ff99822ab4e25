import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from seqgraph.llm import op13_lexical_search as op13
from seqgraph.llm.op13_lexical_search import Shared, search

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [bytes(c + 32 if 65 <= c < 91 else c for c in w) for w in WORD.findall((text or "").encode())]


def brute(docs, items, k=10):
    found = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    N, L = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(w for _, c in found for w in c)
    wanted: dict = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, ws in wanted.items():
        rows = []
        for d, c in found:
            m = 10 + 90 * sum(c.values()) * N // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in ws if c[w])
            if score > 0 and d is not None:
                rows.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(rows)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def tables():
    r = random.Random(4)
    words = [f"W{i}" if i % 3 else f"é{i}字" for i in range(150)]
    pick = lambda n: " ".join(r.choices(words, [1 / (i + 1) for i in range(150)], k=n)) + r.choice(["", ".", " a-b"])
    docs = [(i, pick(r.randint(0, 120))) for i in range(300)] + [(i, t) for i, t in zip(range(300, 306), [None, "", " .. ", "x" * 4000, "a\x00b W1", "W1 " * 20000])]
    docs += [(400 + i, docs[5][1]) for i in range(90)] + [(None, docs[6][1]), (None, docs[7][1]), docs[8], docs[8], docs[8]]
    items = [(i, pick(r.randint(1, 40))) for i in range(25)] + [(30, None), (31, ""), (32, "absent"), (33, docs[5][1]), (3, "W1 w140"), (None, "W1 W2")]
    return docs, items


@pytest.mark.parametrize("block_terms", [1 << 16, 150])
def test_rows_equal_brute_force(spark, tables, block_terms):
    docs, items = tables
    d = spark.createDataFrame([(*x, 1, "y", 2) for x in docs], "doc_id long, text string, score int, rank string, n int")
    i = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, search(d, i, block_terms=block_terms).collect()))
    assert got == brute(docs, items)
    assert len({(x[0], x[1]) for x in got}) == len(got)


def test_empty_tables(spark, tables):
    docs, items = tables
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert search(d.limit(0), i).count() == search(d, i.limit(0)).count() == 0
    assert search(d, i.limit(0)).dtypes == search(d, i).dtypes


def test_a_task_of_many_documents_is_trimmed(spark, tables, monkeypatch):
    monkeypatch.setattr(op13, "CELLS", 3000)
    docs, items = tables
    d = [(j, docs[j % 300][1]) for j in range(6000)]
    counted = op13.search(spark.createDataFrame(d, "doc_id long, text string").coalesce(1), spark.createDataFrame(items[:6], "item_id long, text string"), k=3)
    assert sorted(map(tuple, counted.collect())) == brute(d, items[:6], 3)


@pytest.mark.parametrize("seed", range(8))
def test_shared_sums_equal_plain_ones_with_fewer_additions(seed):
    r = random.Random(seed)
    lists = [r.sample(range(40), r.randint(0, 25)) for _ in range(30)] + [list(range(0, 40, 2))] * 3
    shared = Shared(lists, 40)
    leaves = np.random.default_rng(seed).integers(0, 1000, (40, 5))
    assert (shared.sums(leaves) == np.array([leaves[x].sum(0) for x in lists])).all()
    plain = sum(max(0, len(x) - 1) for x in lists)
    own = len(shared.pairs) + sum(max(0, x - 1) for x in np.diff(shared.at))
    assert own < 0.8 * plain
    assert np.diff(shared.at)[-3:].tolist() == [1, 1, 1]
