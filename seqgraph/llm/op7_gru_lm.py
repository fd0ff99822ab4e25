"""Scoring with a gated recurrent language model whose output softmax is factored by class.

Tokens are the words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case, and one end for each text. All words are counted over
the whole training fold (a shuffle of word hashes). The most frequent ones, the end among them, are the model's words, in
classes by frequency: ``CLASSES * MEMBERS`` of them, or four times the root of the number of distinct words where that is
more. A further class stands for all other words and spreads its probability by their counts, with 0.1 added, so the
model gives every text a probability. A token's probability is that of its class
given the state, times that of the word within its class.

The network is fitted by truncated backpropagation in numpy on all training documents: each task streams its shard in
blocks of bounded size, the shards grow in number with the root of the tokens, and their weights are averaged after each
round, by eights. Each round takes its share of the documents by a hash of the id, at any size of the input, so that every
document is learned from once. Scoring walks a document
in windows of ``WINDOW`` steps and carries the state from one to the next, so the whole text is scored whatever its
length.

What is broadcast is of fixed size: the weights, and the counts of at most ``HEAD`` frequent words. The counts of all
other words reach their tokens by a join on the word.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgraph.checkpoints import saved
from seqgraph.llm.common import U, blocks, fold, mix, table, word_hashes

STATE, CLASSES, MEMBERS = 16, 32, 64
WORDS = CLASSES * MEMBERS
WINDOW, LANES = 64, 1024
ROWS = 2048  # steps whose probabilities are computed together
HEAD = 1 << 19
REPEATED = 1 << 22  # no rule reads it: a test sets it, and shows that what is learned does not depend on it
SHARD = 1 << 20
TEXT = 1 << 21  # bytes of a training block
END = int(mix(np.array([0x5EED], U)).astype(np.int64)[0])


def _tokens(texts: pa.Array):
    """(first row, end row, words and ends as hashes, first token of each row) of each block."""
    for i, j, data, at in blocks(texts, TEXT):
        h, first = word_hashes(data, at)
        out = np.full(len(h) + j - i, END, np.int64)
        count = np.diff(first)
        edge = np.concatenate(([0], np.cumsum(count + 1)))
        keep = np.ones(len(out), bool)
        keep[edge[1:] - 1] = False
        out[keep] = h.astype(np.int64)
        yield i, j, out, edge


def _count(batches):
    for batch in batches:
        for _, _, tokens, _ in _tokens(batch.column("text")):
            h, c = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.astype(np.int64))], ["h", "c"])


def grid(distinct: int) -> tuple[int, int]:
    """Classes and their members for so many distinct words."""
    side = math.ceil(math.sqrt(4 * math.sqrt(distinct)))
    return (side, side) if side * side > WORDS else (CLASSES, MEMBERS)


class Lexicon:
    """Counts of the frequent words by hash, and which of them are the model's words."""

    def __init__(self, h: np.ndarray, c: np.ndarray, total: int, distinct: int):
        self.classes, self.members = grid(distinct)
        self.words = self.classes * self.members
        best = np.lexsort((h, -c, h != END))[: self.words]  # the end comes first
        slot = np.full(len(h), self.words, np.int32)
        slot[best] = np.arange(len(best), dtype=np.int32)
        order = np.argsort(h)
        self.keys, self.counts, self.slots = h[order], c[order], slot[order]
        self.own = np.zeros(self.words)
        self.own[: len(best)] = c[best]
        self.total, self.distinct = total, distinct
        self.mass = total + 0.1 * (distinct + 1)
        self.rest = max(self.mass - float((self.own[: len(best)] + 0.1).sum()), 0.1)

    def __call__(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot (``words``: none) and count (-1: not in the table) of each token."""
        some, back = np.unique(tokens, return_inverse=True)
        if not len(self.keys):
            return np.full(len(tokens), self.words, np.int32), np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        known = self.keys[at] == some
        return np.where(known, self.slots[at], self.words).astype(np.int32)[back], np.where(known, self.counts[at], -1)[back]


def sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-x)
    e += 1
    return np.reciprocal(e, out=e)


class Gru:
    """Gates read a table row for the last word and the state; see the module text for the output."""

    def __init__(self, lexicon: Lexicon, seed: int = 1):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        self.classes, self.members, self.words = lexicon.classes, lexicon.members, lexicon.words
        own = (lexicon.own + 0.1).reshape(self.classes, self.members)
        self.w = {"G": f(self.words + 1, 3 * STATE), "U": f(STATE, 2 * STATE), "N": f(STATE, STATE), "A": f(STATE, self.classes + 1), "a": np.log(np.append(own.sum(1), lexicon.rest)).astype(np.float32), "B": f(self.classes, STATE, self.members), "b": np.log(own).astype(np.float32)}
        self.w["A"] *= 0.1
        self.w["B"] *= 0.1
        self.w["a"] -= self.w["a"].max()
        self.w["b"] -= self.w["b"].max(1, keepdims=True)

    def step(self, x: np.ndarray, h: np.ndarray):
        g = self.w["G"][x]
        zr = h @ self.w["U"]
        zr += g[:, : 2 * STATE]
        zr = sigmoid(zr)
        z, r = zr[:, :STATE], zr[:, STATE:]
        n = (r * h) @ self.w["N"]
        n += g[:, 2 * STATE :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return z, r, n, new

    def output(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None):
        """Natural log probability of each next slot, and with ``grad`` the gradient of their negated sum by h."""
        k = np.where(y < self.words, y // self.members, self.classes)
        order = np.argsort(k.astype(np.int16) if self.classes < 1 << 15 else k, kind="stable")  # rows of one class lie side by side
        h, k, m = h[order], k[order], y[order] % self.members
        rows = np.arange(len(y))
        ones = np.ones(max(self.classes + 1, self.members, min(len(y), ROWS)), h.dtype)  # sums as products
        A, out, dh = self.w["A"], np.empty(len(y), h.dtype), np.empty_like(h)
        for i in range(0, len(y), ROWS):  # what a pass makes stays in the cache
            part = slice(i, i + ROWS)
            own = h[part]
            e = own @ A
            e += self.w["a"]
            out[part] = e[rows[: len(own)], k[part]]
            np.exp(e, out=e)
            s = e @ ones[: self.classes + 1]
            out[part] -= np.log(s)
            if grad is not None:
                s = 1 / s
                grad["A"] += (own * s[:, None]).T @ e
                grad["a"] += s @ e
                dh[part] = (e @ A.T) * s[:, None]
        edge = np.searchsorted(k, np.arange(self.classes + 2))
        if grad is not None:
            dh -= A.T[k]
            some = np.flatnonzero(np.diff(edge))
            grad["A"][:, some] -= np.add.reduceat(h, edge[some]).T
            grad["a"] -= np.diff(edge)
        spans = [(c, i, min(i + ROWS, last)) for c, (first, last) in enumerate(zip(edge[:-2].tolist(), edge[1:-1].tolist(), strict=True)) for i in range(first, last, ROWS)]
        for c, i, j in spans:
            B = self.w["B"][c]
            e = h[i:j] @ B
            e += self.w["b"][c]
            own = e[rows[: j - i], m[i:j]]
            np.exp(e, out=e)
            s = e @ ones[: self.members]
            out[i:j] += own - np.log(s)
            if grad is not None:
                e *= (1 / s)[:, None]
                e[rows[: j - i], m[i:j]] -= 1
                grad["B"][c] += h[i:j].T @ e
                grad["b"][c] += ones[: j - i] @ e
                dh[i:j] += e @ B.T
        back = np.empty_like(order)
        back[order] = rows
        return (out[back], dh[back]) if grad is not None else out[back]

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each list of slots, in windows that hand on their state."""
        total = np.zeros(len(docs))
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        for lane in range(0, len(order), LANES):
            own = order[lane : lane + LANES]
            length = np.array([len(docs[i]) for i in own])
            h = np.zeros((len(own), STATE), np.float32)
            last = np.zeros(len(own), np.int32)
            for t in range(0, int(length[0]), WINDOW):
                live = int((length > t).sum())
                y = np.zeros((live, WINDOW), np.int32)
                for k in range(live):
                    part = docs[own[k]][t : t + WINDOW]
                    y[k, : len(part)] = part
                states, who, what = [], [], []
                for s in range(min(WINDOW, int(length[0]) - t)):
                    n = int(np.searchsorted(-length[:live], -(t + s), "left"))  # longer than t + s
                    h[:n] = self.step(last[:n], h[:n])[3]
                    last[:n] = y[:n, s]
                    states.append(h[:n].copy())
                    who.append(np.arange(n))
                    what.append(y[:n, s])
                got = self.output(np.concatenate(states), np.concatenate(what))
                total[np.array(own[:live])] += np.bincount(np.concatenate(who), got, live)
        return total

    def gradients(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Of one window (steps x lanes): ``fresh`` marks where a text begins; gradients end at the window's start."""
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        kept = []
        for t in range(len(x)):
            if fresh[t].any():
                h = np.where(fresh[t][:, None], np.zeros_like(h), h)
            before = h
            z, r, n, h = self.step(x[t], h)
            kept.append((before, z, r, n, h))
        before, z, r, n, hs = (np.stack(v) for v in zip(*kept, strict=True))  # hs: before a fresh start hides them
        logp, dhs = self.output(hs.reshape(-1, STATE), y.reshape(-1), grad)
        dhs = dhs.reshape(hs.shape)
        by_z, by_n, by_r = (before - n) * z * (1 - z), (1 - z) * (1 - n * n), before * r * (1 - r)
        dh = np.zeros_like(h)
        dgs = np.empty((*x.shape, 3 * STATE), h.dtype)
        for t in range(len(x) - 1, -1, -1):
            dh += dhs[t]
            dn = dh * by_n[t]
            drh = dn @ self.w["N"].T
            dzr = dgs[t, :, : 2 * STATE]
            np.multiply(dh, by_z[t], out=dzr[:, :STATE])
            np.multiply(drh, by_r[t], out=dzr[:, STATE:])
            dgs[t, :, 2 * STATE :] = dn
            dh *= z[t]
            drh *= r[t]
            dh += drh
            dh += dzr @ self.w["U"].T
            if fresh[t].any():
                dh[fresh[t]] = 0
        flat = dgs.reshape(-1, 3 * STATE)
        grad["N"] += (r * before).reshape(-1, STATE).T @ flat[:, 2 * STATE :]
        grad["U"] += before.reshape(-1, STATE).T @ flat[:, : 2 * STATE]
        order = np.argsort(x.reshape(-1), kind="stable")
        some, first = np.unique(x.reshape(-1)[order], return_index=True)
        grad["G"][some] = np.add.reduceat(flat[order], first)
        return grad, h, -float(logp.sum())

    def train(self, docs: list[np.ndarray], adam: dict, window: int = 32, rate: float = 0.02) -> None:
        """One pass: texts are laid end to end in lanes, and a lane's state is carried over windows within a text.

        ``adam`` keeps the moments from one block of a shard to the next; rows of words that a window lacks wait.
        """
        line = np.concatenate(docs)
        fresh = np.zeros(len(line), bool)
        fresh[np.cumsum([0, *map(len, docs[:-1])])] = True
        lanes = max(1, min(len(line) // window, max(8, min(256, len(line) // 1024))))
        steps = -(-len(line) // lanes)
        # the last lane is filled up with ends: no token is left out
        fill = lanes * steps - len(line)
        y = np.append(line, np.zeros(fill, line.dtype)).reshape(lanes, steps).T
        fresh = np.append(fresh, np.ones(fill, bool)).reshape(lanes, steps).T.copy()
        fresh[0] = True
        x = np.vstack((np.zeros((1, lanes), y.dtype), y[:-1]))
        x[fresh] = 0
        if not adam:
            adam |= {"n": 0, "m": {k: np.zeros_like(v) for k, v in self.w.items()}, "v": {k: np.zeros_like(v) for k, v in self.w.items()}}
        h = np.zeros((lanes, STATE), np.float32)
        for t in range(0, steps, window):
            grad, h, _ = self.gradients(x[t : t + window], y[t : t + window], fresh[t : t + window], h)
            size = len(x[t : t + window]) * lanes
            adam["n"] += 1
            n = adam["n"]
            for k, g in grad.items():
                at = np.unique(x[t : t + window]) if k == "G" else slice(None)
                g = g[at] / np.float32(size)
                m = adam["m"][k][at] = adam["m"][k][at] * np.float32(0.9) + np.float32(0.1) * g
                v = adam["v"][k][at] = adam["v"][k][at] * np.float32(0.99) + np.float32(0.01) * g * g
                self.w[k][at] -= (rate / (1 + n / 400) * m / (1 - 0.9**n) / (np.sqrt(v / (1 - 0.99**n)) + 1e-5)).astype(np.float32)


def _train(batches, sent):
    """A row for the whole shard: its tokens and its weights."""
    lexicon, model = sent.value
    model.w = {k: w.copy() for k, w in model.w.items()}
    adam: dict = {}
    n = 0
    for batch in batches:
        for _, _, tokens, edge in _tokens(batch.column("text")):
            model.train(np.split(lexicon(tokens)[0], edge[1:-1]), adam)
            n += len(tokens)
    if n:
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "n": n, "weights": [w.astype(np.float32).tobytes() for w in model.w.values()]}])


def _averaged(frame: pd.DataFrame) -> pd.DataFrame:
    """Of up to eight shards, by their tokens."""
    frame = frame.sort_values("part")
    total = int(frame["n"].sum())
    mean = lambda ws: sum(np.frombuffer(w, np.float32) * np.float32(n / total) for w, n in zip(ws, frame["n"], strict=True))
    weights = [mean(ws).astype(np.float32).tobytes() for ws in zip(*frame["weights"], strict=True)]
    return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // 8], "n": [total], "weights": [weights]})


def _score(batches, sent):
    lexicon, model = sent.value
    part, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        docs, base, spread, known, rows, tails, times = [], [], [], [], [], [], []
        for i, j, tokens, edge in _tokens(batch.column("text")):
            slots, counts = lexicon(tokens)
            who = np.repeat(np.arange(j - i), np.diff(edge))
            value = np.where(counts >= 0, np.log10(np.maximum(counts, 0) + 0.1), 0.0)
            base.append(np.bincount(who, value, j - i))
            # the class of all other words spreads by counts; those outside the table come by the join
            spread.append(np.bincount(who, np.where(slots == lexicon.words, value - np.log10(lexicon.rest), 0.0), j - i))
            known.append(np.bincount(who, counts > 0, j - i).astype(np.int64))
            docs += np.split(slots, edge[1:-1])
            out = counts < 0
            pair = np.stack((who[out] + i, tokens[out]), 1)
            if len(pair):
                pair, c = _unique_pairs(pair)
                rows.append(pair[:, 0])
                tails.append(pair[:, 1])
                times.append(c)
        n = len(docs)
        if not n:
            continue
        model_part = model.score(docs) / np.log(10) + np.concatenate(spread)
        keys = part * (1 << 36) + row + np.arange(n)
        row += n
        none = np.zeros(0, np.int64)
        tail_rows = np.concatenate([none, *rows])
        k = len(tail_rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(keys), pa.array(keys[tail_rows])]),
                pa.concat_arrays([batch.column("doc_id"), pa.nulls(k, batch.schema.field("doc_id").type)]),
                pa.concat_arrays([batch.column("held_out"), pa.nulls(k, pa.bool_())]),
                pa.concat_arrays([pa.array([len(d) for d in docs], pa.int64()), pa.array(np.concatenate([none, *times]), pa.int64())]),
                pa.concat_arrays([pa.array(np.concatenate(known)), pa.nulls(k, pa.int64())]),
                pa.concat_arrays([pa.array(np.concatenate(base)), pa.nulls(k, pa.float64())]),
                pa.concat_arrays([pa.array(model_part), pa.nulls(k, pa.float64())]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.concatenate([none, *tails]), pa.int64())]),
            ],
            ["row", "doc_id", "held_out", "n", "known", "base", "model", "h"],
        )


def _unique_pairs(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    pair = pair[order]
    new = np.concatenate(([True], (pair[1:] != pair[:-1]).any(1)))
    at = np.flatnonzero(new)
    return pair[at], np.diff(np.append(at, len(pair)))


def count_words(texts: DataFrame) -> DataFrame:
    """``(h, c)``: how often each token occurs in all rows of ``text``; a null text is only an end."""
    return texts.select("text").mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, at_most: int) -> pd.DataFrame:
    """The words over a count that ``at_most`` words pass; always the end."""
    steps = counts.groupBy("c").agg(F.count("*").alias("n"))
    least, held = 1, 0
    for r in sorted(steps.where("c > 1").collect(), key=lambda r: -r.c) + steps.where("c = 1").collect():
        held += r.n
        if held > at_most:
            least = r.c + 1
            break
    got = [(r.h, r.c) for r in counts.where((F.col("c") >= least) | (F.col("h") == END)).toLocalIterator()]
    return pd.DataFrame(got, columns=["h", "c"], dtype="int64")


def fit(training: DataFrame, counts: DataFrame, rounds: int = 4, head: int = HEAD) -> tuple[Lexicon, Gru]:
    spark = training.sparkSession
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    some = frequent(counts, head)
    lexicon = Lexicon(some["h"].to_numpy(np.int64), some["c"].to_numpy(np.int64), int(total), int(distinct))
    model = Gru(lexicon)
    texts = training.where("text is not null")
    shards = max(1, math.ceil(4 * math.sqrt(int(total) / rounds / SHARD)))
    fields = "part long, n long, weights array<binary>"
    for i in range(rounds):
        sent = spark.sparkContext.broadcast((lexicon, model))
        share = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == i)
        got, left = share.select("text").coalesce(shards).mapInArrow(partial(_train, sent=sent), fields), shards
        while left > 8:
            got, left = got.groupBy(F.expr("part div 8").alias("eight")).applyInPandas(_averaged, fields), math.ceil(left / 8)
        rows = sorted(got.collect(), key=lambda r: r.part)
        if rows:
            total_n = sum(r.n for r in rows)
            model.w = {k: np.sum([np.frombuffer(r.weights[j], np.float32).reshape(w.shape) * np.float32(r.n / total_n) for r in rows], axis=0, dtype=np.float32) for j, (k, w) in enumerate(model.w.items())}
        sent.unpersist()
    return lexicon, model


def scored(docs: DataFrame, parts: int = 10, **how) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row for each row of docs.

    Learns from rows outside fold 0 of ``parts``. A null text is an empty one: its end is its only token. Repeated rows
    are scored each; other columns are ignored. Without training rows all words are new, and the scores follow from
    V = N = 0. No rows give no result.
    """
    spark = docs.sparkSession
    # a task has one core: more BLAS threads would take the others' time for nothing
    spark.sparkContext.environment.setdefault("OMP_NUM_THREADS", "1")
    docs = docs.select("doc_id", (fold("doc_id", parts) == 0).alias("held_out"), "text")
    training = docs.where(~F.col("held_out"))
    counts = saved(count_words(training), "op7-counts")
    lexicon, model = fit(training, counts, **how)
    sent = spark.sparkContext.broadcast((lexicon, model))
    kind = dict(docs.dtypes)["doc_id"]
    rows = saved(docs.mapInArrow(partial(_score, sent=sent), f"row long, doc_id {kind}, held_out boolean, n long, known long, base double, model double, h long"), "op7-rows")
    value = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))
    tail = rows.where("h is not null").select("row", "h", "n").join(counts, "h", "left").groupBy("row").agg(F.sum(value * F.col("n")).alias("t"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum("n").alias("m"))
    rows = rows.where("h is null").drop("h").join(tail, "row", "left").na.fill(0, ["t", "k", "m"])
    return rows.select("doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.col("k")).alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"), (F.col("base") + F.col("t") - F.col("n") * float(np.log10(lexicon.mass))).alias("base_score"), (F.col("model") + F.col("t")).alias("score"))


def op7_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


QUERIES = {"op7_gru_lm": op7_gru_lm}
SQL: dict = {}
