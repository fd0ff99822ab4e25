import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from seqgraph.llm.op11_resample import composed, features, resampled

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text, longest=2, buckets=10000):
    raw = (text or "").encode()
    words = WORD.findall(bytes(c + 32 if 65 <= c < 91 else c for c in raw))
    return len(words), sorted(zlib.crc32(b" ".join(words[i : i + k])) % buckets for k in range(1, longest + 1) for i in range(len(words) - k + 1))


def brute(docs, target):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    found = [(d, *plain(x)) for d, x in docs]
    for _, _, f in found:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, plain(x)[1], 1)
    S, T = int(s.sum()), int(t.sum())
    rows = []
    for d, n, f in found:
        w = sum(math.floor(1000 * math.log((int(t[b]) + 1) * (S + 10000) / ((int(s[b]) + 1) * (T + 10000)))) for b in f) // max(1, len(f))
        h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), w, None if d is None else w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for k, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


ODD = [None, "", " \n", "A", "Éa éA ß", "x" * 5000, "a-b_c d\x00e", "12 12 12", "a  b", "字 字字", "z" * 70 + " b"]


def test_crc_of_parts():
    r = random.Random(3)
    a = [r.randbytes(r.randint(0, 40)) for _ in range(300)]
    b = [r.randbytes(r.choice([0, 1, 2, 7, 300, 5000])) for _ in range(300)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    assert (composed(crc(a), crc(b), np.array([len(x) for x in b])) == crc([x + y for x, y in zip(a, b)])).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAb zé1.\n\x00{", max_size=30)), max_size=8), st.integers(1, 4))
def test_features_equal_spelled_ones(texts, longest):
    got = [(n, sorted(f.tolist())) for n, f in features(pa.array(texts, pa.string()), longest=longest)]
    assert got == [plain(t, longest) for t in texts]


def test_rows_equal_brute_force(spark):
    r = random.Random(1)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 5))) for _ in range(90)]
    text = lambda n: " ".join(r.choices(words, k=n))
    docs = [(i, t) for i, t in enumerate(ODD + [text(r.randint(0, 60)) for _ in range(400)])]
    docs += [(None, text(30)), (None, text(30)), docs[50], docs[50], docs[50], (60, docs[61][1])] + [(1000 + i, docs[55][1]) for i in range(200)]
    target = [text(25), None, "", text(9)]
    df = spark.createDataFrame([(*d, 1, 2.0, "x") for d in docs], "doc_id long, text string, rank int, score double, c string")
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = sorted((tuple(x) for x in resampled(df, aim).collect()), key=repr)
    assert got == brute(docs, target)
    assert resampled(df.limit(0), aim).count() == 0
    assert sorted((tuple(x) for x in resampled(df, aim.limit(0)).collect()), key=repr) == brute(docs, [])


def test_a_target_draws_what_is_like_it(spark):
    r = random.Random(2)
    like, other = ([f"{a}{i}" for i in range(60)] for a in "ab")
    docs = spark.createDataFrame([(i, " ".join(r.choices(like if i % 4 == 0 else other, k=60))) for i in range(400)], "doc_id long, text string")
    aim = spark.createDataFrame([(0, " ".join(r.choices(like, k=400)))], "item_id long, text string")
    drawn = [x.doc_id for x in resampled(docs, aim).where("rank is not null").collect()]
    assert len(drawn) == 100
    assert sum(d % 4 == 0 for d in drawn) >= 50  # by chance 25
