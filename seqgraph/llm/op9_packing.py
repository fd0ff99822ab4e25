"""Best-fit-decreasing packing of tokenised documents into sequences.

Tokenising runs in Arrow tasks: the distinct words of a block go to the tokenizer once, and a document's ids are
gathered from them. This equals tokenising whole texts because the tokenizer never joins characters across white space.
Where the tokenizer lower-cases and cuts words as the default one does, words of ASCII and Latin-1 letters are cut as it
cuts them, into runs of letters, single digits, runs of signs and endings such as 's, and only distinct parts go to it.
Texts that hold a special token's string are encoded whole. A worker keeps a bounded table of words, and texts come in
batches bounded by bytes, so its memory does not follow the number of distinct words or the length of the texts.

Only the pieces' lengths are shuffled. They are dealt by hash into groups of about ``group_rows`` pieces, whose number
grows with the input; in each group best-fit decreasing runs with a segment tree over remaining capacities, so that a
piece finds the tightest open sequence in logarithmic time. A group wastes at most its last few sequences.
"""

from __future__ import annotations

import json
import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgraph.checkpoints import saved
from seqgraph.llm.common import blocks, lowered, ragged, small_batches, span_hashes, table, word_bounds

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
_WORKER: dict = {}
#: What a tokenizer does before its merges where ``parts`` cuts words as it does.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUT = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_LETTER, _DIGIT, _SIGN, _UNCUT = 1, 2, 3, 4
_KIND = np.full(256, _UNCUT, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER


def parts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts of words that ``_CUT`` finds, for each row the index of its first part, which parts
    are of words left uncut, and the bytes with A-Z in lower case outside these.

    Words with other characters than ASCII signs, digits, letters and the letters from U+00C0 to U+00FF are left uncut.
    """
    starts, ends, first = word_bounds(data, at)
    if not len(starts):
        return starts, ends, first, np.zeros(0, bool), data
    n = len(data)
    low, kind, begins = lowered(data), _KIND[data], np.zeros(n, bool)
    begins[starts] = True
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs of times and division
    kind[lead] = kind[lead + 1] = _LETTER
    odd = np.flatnonzero(kind == _UNCUT)
    if len(odd):
        uncut = np.searchsorted(odd, ends) > np.searchsorted(odd, starts)
        inside = ragged(starts[uncut], (ends - starts)[uncut])
        kind[inside], low[inside] = _UNCUT, data[inside]
    cut = begins.copy()
    cut[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    cut &= kind != 0
    p = np.flatnonzero((low == 39) & cut & (kind == _SIGN))
    if len(p):
        after = np.concatenate((np.where(begins | (kind != _LETTER), 0, low), np.zeros(2, np.uint8)))
        one, two = after[p + 1], after[p + 2]
        short = (one == 115) | (one == 116) | (one == 109) | (one == 100)  # s, t, m, d
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)  # re, ve, ll
        cut[p[short | long] + 1] = False
        behind = np.concatenate((p[short] + 2, p[long] + 3))
        behind = behind[behind < n]
        cut[behind[kind[behind] != 0]] = True
    at_word = np.flatnonzero(begins[found := np.flatnonzero(cut)])
    till = np.append(found[1:], n)
    till[np.append(at_word[1:], len(found)) - 1] = ends
    return found, till, np.searchsorted(found, at), kind[found] == _UNCUT, low


class WordIds:
    """Ids of words, or of their ``parts``, by their hash, kept over the blocks of a worker.

    Where a block would bring them over ``bound`` words, only those stay that came again in a later block since the last
    cut, and none if these fill over half of it. The new words of a block that does not fit then are forgotten after it. So
    a worker holds ``bound`` words at most between blocks, and within a block those of the block beside them.
    """

    def __init__(self, path: str, bound: int = 1 << 18):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = next(iter(self.tokenizer.get_added_tokens_decoder().items()))
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        suffix = told["model"].get("end_of_word_suffix")
        self.cuts = bool(suffix) and [(told.get(k) or {}).get(v) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))] == [_NORMAL, _CUT]
        if self.cuts:
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # the tokens that end a part
            self.last[[i for w, i in told["model"]["vocab"].items() if w.endswith(suffix)]] = True
        self.bound = bound
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)

    def cut(self) -> None:
        keep = self.again
        if 2 * int(keep.sum()) > self.bound:
            return self.clear()
        self.ids = self.ids[ragged(self.at[keep], self.size[keep])]
        self.keys, self.size = self.keys[keep], self.size[keep]
        self.at, self.again = np.cumsum(self.size) - self.size, np.zeros(len(self.keys), bool)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted keys, and which of them are new."""
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return place, self.keys[place] != keys if len(self.keys) else np.ones(len(keys), bool)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encoded(self, words: list[bytes], uncut: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word). Parts are joined by a space and end in a token of their own kind; words by
        a special token, which the tokenizer never merges with its neighbours."""
        name, text = self.mark[0], self.mark[1].content if uncut else " "
        ids = self.whole(text.join([b.decode("utf-8", "replace") for b in words]))
        if not uncut:
            lengths = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
            if len(lengths) != len(words) or lengths.sum() != len(ids):
                return self.encoded(words, True)
            return ids, lengths
        edge = np.concatenate(([-1], np.flatnonzero(ids == name), [len(ids)]))
        assert len(edge) == len(words) + 1
        return ids[ids != name], np.diff(edge) - 1

    def learn(self, keys: np.ndarray, words: list[bytes], cut: int) -> None:
        """Adds words, of which the first ``cut`` are parts."""
        lengths, found = [], []
        for a, b, uncut in ((0, cut, False), (cut, len(words), True)):
            for i in range(a, b, 2000):
                ids, size = self.encoded(words[i : min(b, i + 2000)], uncut)
                lengths.append(size)
                found.append(ids)
        size = np.concatenate([self.size, *lengths])
        self.ids = np.concatenate([self.ids, *found])
        at = np.concatenate((self.at, len(self.ids) - sum(map(len, found)) + np.cumsum(size[len(self.size) :]) - size[len(self.size) :]))
        again = np.concatenate((self.again, np.zeros(len(keys), bool)))
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size, self.again = keys[order], at[order], size[order], again[order]

    def __call__(self, texts: pa.Array):
        """(row, ids) of each row."""
        for i, _, data, at in blocks(texts):
            raw = data.tobytes()
            if self.cuts:
                starts, ends, first, uncut, low = parts(data, at)
            else:
                starts, ends, first = word_bounds(data, at)
                uncut, low = np.ones(len(starts), bool), data
            hashes = span_hashes(low, starts, ends)
            odd = np.zeros(len(at) - 1, bool)
            for s in self.special:
                k = raw.find(s)
                while k >= 0:
                    odd[np.searchsorted(at, k, "right") - 1] = True
                    k = raw.find(s, k + 1)
            if odd.any():
                keep = ~np.repeat(odd, np.diff(first))
                fits = hashes[keep]
            else:
                keep, fits = None, hashes
            keys, one, back = np.unique(fits, return_index=True, return_inverse=True)
            where = np.flatnonzero(keep)[one] if keep is not None else one
            place, new = self.look_up(keys)
            self.again[place[~new]] = True
            held = None
            if new.any():
                if len(self.keys) + int(new.sum()) > self.bound:
                    self.cut()
                    place, new = self.look_up(keys)
                held = self.keys, self.at, self.size, self.ids, self.again
                fresh = np.flatnonzero(new)
                fresh = fresh[np.argsort(uncut[where[fresh]], kind="stable")]
                w = where[fresh]
                self.learn(keys[fresh], [raw[a:b] for a, b in zip(starts[w].tolist(), ends[w].tolist(), strict=True)], int((~uncut[w]).sum()))
                place = np.searchsorted(self.keys, keys)
            size = self.size[place][back]
            ids = self.ids[ragged(self.at[place][back], size)]
            if held and len(self.keys) > self.bound:
                self.keys, self.at, self.size, self.ids, self.again = held
            total = np.concatenate(([0], np.cumsum(size)))
            counts = np.diff(first)
            counts[odd] = 0
            edge = total[np.concatenate(([0], np.cumsum(counts)))]
            for k in range(len(at) - 1):
                yield i + k, self.whole(raw[at[k] : at[k + 1]].decode("utf-8", "replace")) if odd[k] else ids[edge[k] : edge[k + 1]]


def word_ids(path: str) -> WordIds:
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def _pieces(batches, path: str, capacity: int, with_ids: bool):
    encode = word_ids(path)
    for batch in batches:
        names = batch.column("doc_id")
        out: list[tuple] = []
        kept: list[np.ndarray] = []
        for i, ids in encode(batch.column("text")):
            ids = np.append(ids, np.uint32(0)).astype("<u4")
            for piece, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                out.append((i, piece, start, len(part), zlib.crc32(part.tobytes())))
                if with_ids:
                    kept.append(part.astype(np.int32))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        arrays = [names.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])]
        if with_ids:
            at = np.concatenate(([0], np.cumsum([len(k) for k in kept]))).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int32))))
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each document's ids and an id 0, cut only beyond ``capacity``.

    A null text is an empty one: a single id 0. Repeated rows stay apart; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(partial(_pieces, path=path, capacity=capacity, with_ids=with_ids), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, given in descending order, by a segment tree over remaining capacities.

    A leaf is a remaining capacity and holds the open sequences that have it; an inner node counts them. The tightest
    fit is the leftmost leaf that is not empty at or right of the length, one way up and down the tree.
    """
    leaves = 1 << capacity.bit_length()
    tree = [0] * (2 * leaves)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, count = [0] * len(lengths), [0] * len(lengths), 0

    def add(leaf: int, by: int) -> None:
        node = leaf + leaves
        while node:
            tree[node] += by
            node >>= 1

    for i, length in enumerate(lengths.tolist()):
        node = length + leaves
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            node = node + 1 if node > 1 else 0
            while 0 < node < leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        if node:
            left = node - leaves
            bins[i] = open_[left].pop()
            add(left, -1)
        else:
            left, bins[i] = capacity, count
            count += 1
        offsets[i] = capacity - left
        if left > length:
            open_[left - length].append(bins[i])
            add(left - length, 1)
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def _pack(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    bins, offsets = best_fit(frame["length"].to_numpy(), capacity)
    return frame.assign(sequence_id=frame["pack_group"].to_numpy(np.int64) << 32 | bins, offset=offsets).drop(columns="pack_group")


def pack(cut: DataFrame, capacity: int = CAPACITY, group_rows: int = 16_384) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; the pieces of a sequence lie one after the other from 0.

    Full pieces are sequences of their own. The rest is dealt at random, by hash, into ``ceil(rows / group_rows)``
    groups, each packed in a task of bounded size. No piece gives no sequence.
    """
    groups = max(1, -(-cut.count() // group_rows))
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(groups)))
    fields = ", ".join(f"{n} {t}" for n, t in cut.dtypes)
    return dealt.groupBy("pack_group").applyInPandas(partial(_pack, capacity=capacity), f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the ids of each sequence, from packed pieces that carry ``ids``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` with their places; ``path`` is a tokenizer file, by default the public 49k word vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with small_batches(docs.sparkSession):
        cut = saved(pieces(docs, path, capacity), "op9-pieces")
    return pack(cut, capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
SQL: dict = {}
