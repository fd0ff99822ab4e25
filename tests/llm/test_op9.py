import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqgraph.llm.op9_packing import WordIds, best_fit, pack, packed_documents, pieces, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "A<|endoftext|>b c", "it's  O'Neil x y  café 12345 !!??", "𝒳 字字 ß́ é", "\x1c\x85 a\tb\nc", "ΑΣ ΟΔΟΣ ς", "<|startoftext|>", "x" * 9000, "ab " * 6000]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    words = ["".join(r.choices("abcdeéßstü.,!'’0123", k=r.randint(1, 9))) for _ in range(500)]
    return [(i, t) for i, t in enumerate(ODD + [" ".join(r.choices(words, k=r.randint(0, 900))) for _ in range(300)])]


def test_ids_equal_whole_texts_and_round_trip(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    t = Tokenizer.from_file(PATH)
    cut = pieces(df, PATH, with_ids=True)
    packed = pack(cut).collect()
    seqs = {r.sequence_id: r.ids for r in sequences(pack(cut)).collect()}
    whole: dict = {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.piece)):
        assert seqs[r.sequence_id][r.offset : r.offset + r.length] == r.ids
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.start == len(whole.setdefault(r.doc_id, []))
        whole[r.doc_id] += r.ids
    assert whole == {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in docs}


def test_sequences_are_gapless_and_few(spark, docs):
    df = spark.createDataFrame([(*d, 1, 2) for d in [*docs, docs[5], docs[5]]], "doc_id long, text string, piece int, sequence_id int")
    rows = packed_documents(df).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(by) <= total / 2048 * 1.02 + 1
    assert packed_documents(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_equals_plain_search(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, offsets = best_fit(np.array(lengths, np.int64), 16)
    left: list[int] = []
    for i, x in enumerate(lengths):
        fits = [c for c in left if c >= x]
        tight = min(fits) if fits else 16
        assert 16 - offsets[i] == tight
        if fits:
            assert left[bins[i]] == tight
            left[bins[i]] -= x
        else:
            assert bins[i] == len(left)
            left.append(16 - x)


def test_a_worker_holds_few_words_and_forgets_none_it_needs():
    r = random.Random(3)
    often = ["".join(r.choices("abcdeéß", k=5)) for _ in range(100)]
    texts = ODD + [" ".join([w for _ in range(1500) for w in (r.choice(often), "".join(r.choices("abcdefghijklmno'", k=11)))]) for _ in range(40)]
    assert WordIds(PATH).bound <= 1 << 18  # 2 ** 21 took an executor of the pipeline over its memory
    t = Tokenizer.from_file(PATH)
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for bound in (0, 150, 4000, 30_000):
        words, held = WordIds(PATH, bound), 0
        for k in range(0, len(texts), 5):
            got = dict(words(pa.array(texts[k : k + 5])))
            assert [got[i].tolist() for i in range(5)] == want[k : k + 5]
            held = max(held, len(words.keys))
            assert (np.diff(words.keys.astype(object)) > 0).all() and len(words.ids) == words.size.sum()
        assert held <= max(bound, bound // 2 + 7700)  # a batch has 7,600 words at most


def test_batches_are_bounded_by_bytes_and_the_setting_is_put_back(spark, monkeypatch):
    from seqgraph.llm import op9_packing

    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", spark.sparkContext.accumulator(0)
    own = op9_packing._pieces

    def watched(batches, **args):
        def seen():
            for b in batches:
                most.add(max(0, b.num_rows - 400))
                yield b

        yield from own(seen(), **args)

    monkeypatch.setattr(op9_packing, "_pieces", watched)
    df = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 5000) as text")  # 20 to 30 kB each
    before = spark.conf.get(key, None)
    assert packed_documents(df).select("doc_id").distinct().count() == 3000
    assert most.value == 0 and spark.conf.get(key, None) == before


def test_words_go_to_the_tokenizer_by_their_parts():
    r, words = random.Random(4), WordIds(PATH)
    runs = ["".join(r.choices("abcdeéß", k=6)) for _ in range(50)]
    forms = [str, str.upper, str.capitalize, "{}.".format, "({},".format, "{}'s".format, "{}'LL!".format, "'{}'".format, "{}-17".format, "$$${}%%%".format]
    texts = [" ".join(f(x.replace("ß", "ss") if f is str.upper else x) for x in r.sample(runs, 50) for f in forms) for _ in range(20)]
    t = Tokenizer.from_file(PATH)
    assert [ids.tolist() for _, ids in words(pa.array(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(words.keys) < 250  # 50 runs, those with É or ss again, and few signs; the distinct words are ten times as many as the runs


SOME = st.text(st.sampled_from([*"aAsStTrReEvVlLmMdDhHiIKxX09_!.,-<|>/$ \n\t\x00\x1c\x7f\x85\xa0", *"éÉßÀÿÞ×÷ñ²½ªºµŸİſΣσ字٣’ﬁ", "\u0301", "\u0331", "\u0307", "\u200b", "\u212a", "\U0001d4b3"]), max_size=30)


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH), WordIds(PATH)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(SOME, max_size=6))
def test_parts_equal_whole_texts(plain, texts):
    tokenizer, words = plain
    got = dict(words(pa.array(texts, pa.string())))
    assert [got[i].tolist() for i in range(len(texts))] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("change", [{"normalizer": None}, {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}])
def test_other_tokenizers_get_whole_words(tmp_path, change):
    with open(PATH, encoding="utf-8") as f:
        told = json.load(f) | change
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(told, f)
    texts = ["Don't DON'T don't, (CAFÉ) café 17", "x1y2 X1Y2's $$a%% a", ""]
    t, got = Tokenizer.from_file(path), dict(WordIds(path)(pa.array(texts)))
    assert [got[i].tolist() for i in range(3)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
