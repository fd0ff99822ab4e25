"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (n = 1 to 3, words padded with one blank), best
first. A document is given to the language whose profile has the least out-of-place distance to the document's own
ranked list: the sum of rank differences, with a fixed penalty for n-grams that the profile lacks.

Profiles are counted over the whole texts of all labelled documents; what is broadcast is ``top`` n-grams for each
language. Every whole text is ranked and compared.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqgraph.llm.common import blocks, fold, table

TOP = 300
HELD = 1 << 20  # n-grams of texts that are held before they are added up
BLANK = 1  # stands for all between two words; no letter has this code


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or BLANK."""
    out = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _rows(texts: pa.Array):
    """(row, codes of its letters with single blanks around words) for each row that has a letter, else (row, None)."""
    table_ = _letters()
    for i, _, data, at in blocks(texts):
        raw = data.tobytes()
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            codes = table_[np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)]
            codes = np.concatenate(([BLANK], codes, [BLANK])).astype(np.int64)
            keep = codes != BLANK
            keep[1:] |= keep[:-1]
            keep[0] = True
            codes = codes[keep]
            yield i + k, codes if len(codes) > 2 else None


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as integers of 21 bits a letter, and their counts; a lone blank is none."""
    two = codes[:-1] << 21 | codes[1:]
    three = two[:-1] << 21 | codes[2:]
    return np.unique(np.concatenate((codes[codes != BLANK], two, three)), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, best first; ties by n-gram."""
    if len(keys) > 4 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.argsort(-counts, kind="stable")][:top]  # keys are sorted


def _summed(found: dict[str, list]):
    for lang, parts in found.items():
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], ["lang", "gram", "c"])


def _count(batches):
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        found: dict[str, list] = {}
        held = 0
        for i, codes in _rows(batch.column("text")):
            if codes is not None:
                found.setdefault(langs[i], []).append(own := grams(codes))
                held += len(own[0])
                if held > HELD:
                    yield from _summed(found)
                    found, held = {}, 0
        yield from _summed(found)


class Profiles:
    """Rank of each profile n-gram for each language, ``top`` where a language lacks it."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int = TOP):
        self.top = top
        self.langs = sorted({r[0] for r in rows})
        self.keys = np.array(sorted({r[1] for r in rows}), np.int64)
        self.ranks = np.full((len(self.langs), len(self.keys)), top, np.int64)
        for lang, gram, rank in rows:
            self.ranks[self.langs.index(lang), np.searchsorted(self.keys, gram)] = rank

    def best(self, codes: np.ndarray | None) -> tuple[str, float]:
        if codes is None or not self.langs:
            return "und", 0.0
        own = ranked(*grams(codes), self.top)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        away = np.abs(self.ranks[:, at] - np.arange(len(own)))
        lacks = (self.keys[at] != own) | (self.ranks[:, at] == self.top)
        distance = np.where(lacks, self.top, away).sum(1)
        k = int(distance.argmin())
        return self.langs[k], float(1 - distance[k] / (self.top * len(own)))


def _predict(batches, profiles):
    for batch in batches:
        found = [profiles.value.best(codes) for _, codes in _rows(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names, "lang_pred", "score"])


def fit(labelled: DataFrame, top: int = TOP) -> Profiles:
    """Profiles from the columns text and lang of all rows; rows without text or language teach nothing."""
    labelled = labelled.where("lang is not null and text is not null")
    counts = labelled.select("lang", "text").mapInArrow(_count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    order = W.partitionBy("lang").orderBy(F.desc("c"), "gram")
    return Profiles([(r.lang, r.gram, r.r - 1) for r in counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).select("lang", "gram", "r").collect()], top)


def predicted(docs: DataFrame, profiles) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to docs, replacing columns of these names; ``profiles`` is a broadcast of `fit`.

    ``score`` is 1 less the mean out-of-place distance as a share of the penalty. A null text, a text without letters,
    and any text where no profile was learned give ``und`` and 0. Ties go to the first language in alphabetic order.
    """
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(partial(_predict, profiles=profiles), schema)


def least_scores(told: DataFrame, quantile: float = 0.01, slack: float = 0.8, steps: int = 10_000) -> dict[str, float]:
    """For each language the score under which a text is not taken for it: ``slack`` times a low quantile of the scores
    of right predictions, over all labelled rows of ``lang``, ``lang_pred`` and ``score``, from their counts by
    ``1 / steps`` of score. Without any there is none."""
    right = told.where("lang_pred = lang").groupBy("lang", F.floor(F.col("score") * steps).alias("step")).agg(F.count("*").alias("c"))
    own = W.partitionBy("lang")
    upto = right.select("lang", "step", F.sum("c").over(own.orderBy("step")).alias("upto"), F.sum("c").over(own).alias("every"))
    return {r.lang: r.step / steps * slack for r in upto.where(F.col("upto") >= quantile * F.col("every")).groupBy("lang").agg(F.min("step").alias("step")).collect()}


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, a row for each row of ``docs``; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return predicted(rows, sent).drop("text")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs.where(fold("doc_id", 5) != 0)))


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict = {}
