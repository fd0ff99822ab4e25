import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from seqgraph.llm.op7_gru_lm import STATE, WORDS, Gru, Lexicon, scored


def corpus(seed=1, n=400):
    r = random.Random(seed)
    kinds = [[f"{k}{i}" for i in range(40)] for k in "abc"]
    out = []
    for d in range(n):
        w = r.choice(kinds)
        t = r.choices(w, weights=range(1, 41), k=r.randint(0, 80))
        if r.random() < 0.3:
            t.append(f"Rare{r.randrange(10**6)}")
        out.append((d, " ".join(t)))
    return out


def brute(rows):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    c = Counter()
    for d, t in rows:
        if not held[d]:
            c.update(split(t))
            c["\0end"] += 1
    n, v = sum(c.values()), len(c)
    out = {}
    for d, t in rows:
        w = [*split(t), "\0end"]
        out[d] = (held[d], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    return out


def test_base_equals_brute_force_and_model_beats_it(spark):
    rows = corpus()
    df = spark.createDataFrame([(*x, 1, 0.5) for x in rows], "doc_id long, text string, h int, score double")
    want = brute(rows)
    got = scored(df, head=60).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert abs(r.base_score - w[4]) < 1e-6 * max(1, abs(w[4]))
        assert r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 5
    again = {r.doc_id: r for r in scored(df, head=10**6).collect()}  # all counts in the table, none by the join
    assert all(abs(again[r.doc_id].base_score - r.base_score) < 1e-6 * max(1, abs(r.base_score)) and again[r.doc_id].n_known == r.n_known for r in got)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "w " * 40_000), (5, "z" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = scored(df.union(spark.createDataFrame([(None, "x")], df.schema))).collect()
    assert len(got) == 7 and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1} and {r.n_tokens for r in got if r.doc_id == 4} == {40_001}
    assert scored(df.limit(0)).count() == 0
    lone = scored(spark.createDataFrame([(None, "x y")], df.schema)).collect()
    assert lone[0].held_out and lone[0].n_known == 0 and lone[0].train_tokens == 0


def small_model():
    r = np.random.default_rng(3)
    lexicon = Lexicon(np.arange(3000), r.integers(1, 100, 3000), 100_000, 3000)
    model = Gru(lexicon, seed=5)
    return model, r


def test_probabilities_sum_to_one_and_windows_carry_state():
    model, r = small_model()
    h = r.standard_normal((1, STATE)).astype(np.float32)
    every = model.output(np.repeat(h, WORDS + 1, 0), np.arange(WORDS + 1))
    assert abs(np.exp(every).sum() - 1) < 1e-3
    docs = [r.integers(0, WORDS + 1, k).astype(np.int32) for k in (1, 5, 64, 65, 300, 0, 130)]
    got = model.score(docs)
    for d, x in zip(docs, got, strict=True):
        h, last, total = np.zeros((1, STATE), np.float32), np.zeros(1, np.int32), 0.0
        for y in d:
            h = model.step(last, h)[3]
            total += float(model.output(h, np.array([y]))[0])
            last = np.array([y])
        assert abs(total - x) < 1e-3 * max(1, abs(total))


def test_gradients_match_differences():
    model, r = small_model()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, y = r.integers(0, WORDS + 1, (6, 4)), r.integers(0, WORDS + 1, (6, 4))
    fresh = np.zeros((6, 4), bool)
    fresh[3, 1] = True
    h = r.standard_normal((4, STATE))
    grad, _, loss = model.gradients(x, y, fresh, h)
    for k, w in model.w.items():
        places = [tuple(r.integers(0, s) for s in w.shape) for _ in range(4)] + ([(int(x[2, 0]), 5), (int(x[4, 3]), 20)] if k == "G" else [])
        for p in places:
            old = w[p]
            w[p] = old + 1e-5
            up = model.gradients(x, y, fresh, h)[2]
            w[p] = old - 1e-5
            down = model.gradients(x, y, fresh, h)[2]
            w[p] = old
            assert abs((up - down) / 2e-5 - grad[k][p]) < 1e-4 * max(1, abs(grad[k][p])), (k, p)


def test_fit_learns_from_every_training_document(spark, monkeypatch):
    import seqgraph.llm.op7_gru_lm as op7

    rows = [(d, f"own{d} the end of it") for d in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = op7.count_words(df)
    for repeated, shard in ((op7.REPEATED, op7.SHARD), (0, 1)):  # all in each round, or a share in each and many shards
        monkeypatch.setattr(op7, "REPEATED", repeated)
        monkeypatch.setattr(op7, "SHARD", shard)
        _, model = op7.fit(df, counts, head=10**6)
        lexicon = Lexicon(*(np.array(x) for x in zip(*[(r.h, r.c) for r in counts.collect()], strict=True)), 18_000, 3005)
        start = Gru(lexicon).w["G"]
        own = lexicon(np.concatenate([t for *_, t, _ in op7._tokens(op7.pa.array([f"own{d}" for d in range(3000)]))]))[0]
        own = np.unique(own[(own > 0) & (own < lexicon.words)])
        assert len(own) > 2000 and (model.w["G"][own] != start[own]).any(1).mean() > 0.95  # the last word of a lane has no next one


def test_words_grow_with_the_counted_words():
    sizes = [Lexicon(np.arange(n), np.full(n, 2), 2 * n, n).words for n in (3000, 500_000, 3_000_000)]
    assert sizes[0] == WORDS < sizes[1] < sizes[2]


def test_one_rule_of_learning_for_all_sizes(spark, monkeypatch):
    """What is learned does not turn on a number of tokens."""
    import seqgraph.llm.op7_gru_lm as op7

    df = spark.createDataFrame(corpus(4, 200), "doc_id long, text string")
    counts = op7.count_words(df).cache()
    _, usual = op7.fit(df, counts, head=10**6)
    monkeypatch.setattr(op7, "REPEATED", 0)
    _, other = op7.fit(df, counts, head=10**6)
    assert all((usual.w[k] == other.w[k]).all() for k in usual.w)
