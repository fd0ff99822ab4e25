import random
import uuid
import zlib

import numpy as np
import pandas as pd
import pytest

from seqgraph.llm.op12_sharding import OVERHEAD, dealt, keyed, ordered, sharded, splitters_of, write_shards

SCHEMA = "doc_id long, text string, shard string, size int, k1 string"


def sizes(rows, shards=24):
    out = [0] * shards
    for r in rows:
        out[r.shard] += r.size
    return out


def check(docs, rows, shards=24):
    """Each row once with its own figures; slots gapless; no shard strays further than a range or its largest row."""
    of = lambda d, t: (d, len((t or "").encode()) + OVERHEAD, zlib.crc32((t or "").encode()), "bytes", None)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((of(d, t) for d, t in docs), key=key) == sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows), key=key)
    slots: dict = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < shards for s in slots)


def test_law_of_bytes_with_hot_groups(spark):
    r = random.Random(1)
    docs = [(i, "".join(r.choices("abé ", k=r.randint(0, 300)))) for i in range(3000)]
    docs += [(3000 + i, "the same text of many " * 9) for i in range(2500)] + [(9000 + i, None if i % 2 else "") for i in range(2500)] + [(12000, "long " * 3000)]
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA).repartition(5)
    rows = sharded(df).collect()
    check(docs, rows)
    found = sizes(rows)
    mean = sum(found) / 24
    assert max(abs(x - mean) for x in found) < mean / 20
    # texts of few copies are in one shard each
    where: dict = {}
    for x in rows:
        where.setdefault(x.text_crc32, set()).add(x.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 2
    assert len(where[zlib.crc32(b"the same text of many " * 9)]) > 5


def test_null_ids_repeats_and_empty_tables(spark):
    docs = [(None, "a b"), (None, None), (None, "a b"), (1, ""), (1, ""), *[(7, "again and again")] * 400, (-5, "é" * 50000)]
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA)
    check(docs, sharded(df).collect())
    assert sharded(df.limit(0)).count() == 0
    assert sharded(df.limit(0)).dtypes == sharded(df).dtypes
    named = spark.createDataFrame([(f"d{i % 5}", "x" * i) for i in range(60)], "doc_id string, text string")
    rows = sharded(named, 5).collect()
    check([(f"d{i % 5}", "x" * i) for i in range(60)], rows, 5)
    assert max(sizes(rows, 5)) - min(sizes(rows, 5)) < 68


def test_ranges_hold_their_share(spark):
    r = random.Random(2)
    docs = [(i, "".join(r.choices("abc", k=r.randint(1, 60)))) for i in range(4000)] + [(5000 + i, "copy") for i in range(3000)] + [(9000, "x" * 30000)]
    rows = keyed(spark.createDataFrame(docs, "doc_id long, text string"))
    n, total = rows.count(), sum(len(t) + 8 for _, t in docs)
    splitters, counts = splitters_of(rows, n, total, 100)
    assert counts["n"].sum() == n and counts["size"].sum() == total
    over = counts[(counts["size"] > 2 * total / 100) | (counts["n"] > 4 * n / 100)]
    assert over["n"].tolist() == [1]
    assert list(splitters) == sorted(splitters)
    assert len(splitters) < 400


def test_keys_order_as_numbers():
    keys = np.array([[-(1 << 63), 0, 0], [-1, 5, -5], [-1, 5, 5], [0, -9, 0], [0, 0, 0], [0, 0, 1 << 40], [(1 << 63) - 1, 0, 0]], np.int64)
    assert (np.argsort(ordered(keys), kind="stable") == np.arange(len(keys))).all()


@pytest.mark.parametrize("seed", range(5))
def test_dealt_levels_what_can_be_levelled(seed):
    r = np.random.default_rng(seed)
    size = np.concatenate([r.integers(1, 200, 500), r.integers(5000, 90000, 7)])
    counts = pd.DataFrame({"n": np.concatenate([r.integers(1, 9, 500), np.ones(7, int)]), "size": size})
    shard, base = dealt(counts, 6, 200)
    load = np.bincount(shard, size, 6)
    alone = np.sort(size)[-7:]
    assert load.max() <= max(size.sum() / 6 + 200, alone[-1], alone[0] + alone[1])
    for s in range(6):
        own = np.flatnonzero(shard == s)
        assert (base[own] == np.cumsum(counts["n"].to_numpy()[own]) - counts["n"].to_numpy()[own]).all()


def test_written_shards_hold_whole_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 40}", "x", i, None) for i in range(300)], SCHEMA)
    path = str(tmp_path / uuid.uuid4().hex)
    write_shards(docs, path, 4)
    back = spark.read.parquet(path)
    assert sorted(tuple(r.row) for r in back.collect()) == sorted(map(tuple, docs.collect()))
    assert back.groupBy("shard").count().count() == 4
