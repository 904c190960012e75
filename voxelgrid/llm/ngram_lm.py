"""A bigram language model in Elias-Fano tries, fitted and queried in shards.

Words are 64-bit hashes. A shard holds the bigrams of the words that hash to it, as a trie read
from the word to its contexts: level 1 has the shard's words, level 2 under each word its
contexts. Both levels and the pointers between them are monotone sequences in Elias-Fano
form; the probabilities beside level 2 are quantised. A shard's trie is a file in the
shared folder, mapped by the task that queries it; a context is found by a successor search
within its word's range.

Probabilities are smoothed by a Dirichlet prior on the unigrams: with base probability b,
p(w | u) = (c(u w) + m b(w)) / (c(u) + m). Its logarithm is a difference of a term that needs
only the counts of w and of the pair, and one that needs only the count of u; every token
therefore is looked up in one shard, and no counts travel between shards.

Words that would fill a good part of a shard are frequent, and so are words and pairs with a
great share of all tokens. Their counts are handed to all tasks, at most ``MOST_FREQUENT`` words
and ``MOST_PAIRS`` pairs (16 and 24 bytes each); other bigrams of frequent words are dealt over
shards by context. So no shard gathers more of a word than ``FREQUENT`` tokens (beyond
``MOST_FREQUENT * FREQUENT`` training tokens, their share), or of a pair than its share.

Contracts
* null text is empty: one token, the end.
* training rows are given by a column; null there means training.
* a text's words are never cut or left out; an unknown word has count 0.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import shared_folder, tasks_for, written

_U = np.uint64
START, END = _U(0x51A2_7E0F_93C4_D865), _U(0xE94D_3B16_0A7F_C258)
#: Prior weight m of the smoothing.
PRIOR = 100.0
TOKENS_PER_SHARD = 2_000_000
#: A word with more training tokens than this is frequent.
FREQUENT = TOKENS_PER_SHARD // 32
#: Bounds on the number of frequent words, and of frequent pairs.
MOST_FREQUENT = 1 << 20
MOST_PAIRS = 1 << 12
#: Text whose distinct words one task counts.
COUNTED_BYTES = 256 << 20
CHUNK_BYTES = 6 << 20
CONTEXT_BITS = 40
CODES = 65535


#: Place of the k-th set bit of each byte, first bit first.
_SELECT = np.array([[*(p for p in range(8) if b >> p & 1), *[0] * (8 - b.bit_count())] for b in range(256)], np.uint8)


class EliasFano:
    """A monotone sequence of 64-bit integers: low bits in whole bytes, high bits in unary.

    The high bits stay packed, as mapped from the file. Beside them a directory has the numbers
    of ones and of zeros before each 64 of them (as large as they), from which one is selected.
    """

    def __init__(self, n: int, low_bytes: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bytes, self.low = n, low_bytes, low
        self.high = high.view(np.uint64) if len(high) else np.zeros(1, np.uint64)
        ones = np.bitwise_count(self.high)
        small = np.uint32 if 64 * len(ones) < 2**32 else np.uint64
        self.ones_before, self.zeros_before = np.zeros(len(ones) + 1, small), np.zeros(len(ones) + 1, small)
        np.cumsum(ones, out=self.ones_before[1:])
        np.cumsum(64 - ones, out=self.zeros_before[1:])
        self.zeros = 64 * len(ones) - n

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros((0, 0), np.uint8), np.zeros(0, np.uint8))
        spread = max(1, int(values[-1]) // n)
        low_bytes = min(7, -(-spread.bit_length() // 8))
        low = np.ascontiguousarray(values).view(np.uint8).reshape(n, 8)[:, :low_bytes]
        top = (values >> _U(8 * low_bytes)).astype(np.int64)
        bits = np.zeros((int(top[-1]) + n + 64) // 64 * 64, np.uint8)
        bits[top + np.arange(n)] = 1
        return cls(n, low_bytes, np.ascontiguousarray(low), np.packbits(bits, bitorder="little"))

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Places of the k-th ones, or zeros, which must exist."""
        before = self.ones_before if one else self.zeros_before
        block = np.searchsorted(before, k.astype(before.dtype), "right") - 1
        k = k - before[block].astype(np.int64)
        word = self.high[block] if one else ~self.high[block]
        # byte by byte: sums of the ones up to each byte of a word, side by side in one integer
        counts = np.bitwise_count(word.view(np.uint8).reshape(-1, 8)).view(_U).ravel()
        sums = counts * _U(0x0101010101010101)
        least = ((_U(0x80) | k.astype(_U)) * _U(0x0101010101010101)) - sums
        byte = np.bitwise_count(least & _U(0x8080808080808080)).astype(np.int64)
        k = k - ((sums << _U(8)) >> (8 * byte).astype(_U) & _U(0xFF)).astype(np.int64)
        part = (word >> (8 * byte).astype(_U) & _U(0xFF)).astype(np.int64)
        return 64 * block + 8 * byte + _SELECT[part, k]

    def low_at(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros((len(i), 8), np.uint8)
        out[:, : self.low_bytes] = self.low[i]
        return out.view(np.uint64).ravel()

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        top = self._select(np.asarray(i, np.int64), True) - i
        return (top.astype(_U) << _U(8 * self.low_bytes)) | self.low_at(i)

    def _ended(self, top: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``top``."""
        out = np.where(top > 0, self.n, 0)
        inside = np.flatnonzero((top > 0) & (top <= self.zeros))
        out[inside] = self._select(top[inside] - 1, False) - (top[inside] - 1)
        return out

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Position of the first value of at least ``x`` in [first, last), or ``last``."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        top = np.minimum(x >> _U(8 * self.low_bytes), _U(self.zeros)).astype(np.int64)
        lo, hi = self._ended(top), self._ended(top + 1)
        if first is not None:
            lo, hi = np.clip(lo, first, last), np.clip(hi, first, last)
        want = x & _U((1 << (8 * self.low_bytes)) - 1)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.low_at(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return lo


class Trie:
    """One shard: words with counts, and each word's contexts with quantised log values."""

    FIELDS = ("word_low", "word_high", "counts", "pointer_low", "pointer_high", "context_low", "context_high", "codes")

    def __init__(self, head: dict, arrays: dict[str, np.ndarray]):
        self.head, self.counts, self.codes = head, arrays["counts"], arrays["codes"]
        for name in ("word", "pointer", "context"):
            n, low_bytes = head[name]
            setattr(self, name, EliasFano(n, low_bytes, arrays[f"{name}_low"].reshape(n, low_bytes), arrays[f"{name}_high"]))

    @staticmethod
    def build(words: np.ndarray, contexts: np.ndarray, frequent: np.ndarray, given: np.ndarray, base) -> tuple[dict, dict]:
        """From the training bigrams. ``given``: counts of frequent words, whose bigrams lie in many shards."""
        key = (words, contexts)
        order = np.lexsort((key[1], key[0]))
        words, contexts = words[order], contexts[order]
        new_word = np.concatenate([[True], words[1:] != words[:-1]]) if len(words) else np.zeros(0, bool)
        new_pair = new_word | np.concatenate([[True], contexts[1:] != contexts[:-1]]) if len(words) else new_word
        w_at, p_at = np.flatnonzero(new_word), np.flatnonzero(new_pair)
        level1 = words[w_at]
        counts = np.diff(np.concatenate([w_at, [len(words)]])).astype(np.int64)
        at = _place(frequent, level1)
        counts[at >= 0] = given[at[at >= 0]]
        pairs = np.diff(np.concatenate([p_at, [len(words)]]))
        rank = np.cumsum(new_word)[p_at] - 1
        level2 = (rank.astype(_U) << _U(CONTEXT_BITS)) | contexts[p_at]
        values = np.log10(pairs + PRIOR * 10.0 ** base(counts[rank])) if len(p_at) else np.zeros(0)
        least, most = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        codes = np.round((values - least) / max(most - least, 1e-12) * CODES).astype(np.uint16)
        ef = {
            "word": EliasFano.build(level1),
            "pointer": EliasFano.build(np.searchsorted(p_at, np.concatenate([w_at, [len(words)]])).astype(_U)),
            "context": EliasFano.build(level2),
        }
        head = {k: (e.n, e.low_bytes) for k, e in ef.items()} | {"least": least, "most": most}
        arrays = {"counts": counts, "codes": codes}
        for k, e in ef.items():
            arrays |= {f"{k}_low": e.low, f"{k}_high": e.high.view(np.uint8)}
        return head, arrays

    @classmethod
    def write(cls, uri: str, head: dict, arrays: dict[str, np.ndarray]) -> None:
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        head = head | {"arrays": [(k, arrays[k].dtype.str, arrays[k].size) for k in cls.FIELDS]}
        text = json.dumps(head).encode()
        text += b" " * (-(len(text) + 8) % 8)
        temporary = f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        with fs.open_output_stream(temporary) as f:
            f.write(len(text).to_bytes(8, "little") + text)
            for k in cls.FIELDS:
                data = np.ascontiguousarray(arrays[k]).tobytes()
                f.write(data + b"\0" * (-len(data) % 8))
        fs.move(temporary, path)

    @classmethod
    def open(cls, uri: str) -> "Trie":
        """Maps a local file; another store's file is read."""
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        if isinstance(fs, pyarrow.fs.LocalFileSystem):
            source = np.memmap(path, np.uint8, "r")
        else:
            with fs.open_input_file(path) as f:
                source = np.frombuffer(f.read(), np.uint8)
        at = 8 + int.from_bytes(source[:8].tobytes(), "little")
        head = json.loads(source[8:at].tobytes())
        arrays = {}
        for k, dtype, n in head["arrays"]:
            size = np.dtype(dtype).itemsize * n
            arrays[k] = source[at : at + size].view(dtype)
            at += size + -size % 8
        return cls(head, arrays)

    def lookup(self, words: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the words (0: unknown here), and the pairs' log values (nan: unseen)."""
        value = np.full(len(words), np.nan)
        if not self.word.n:
            return np.zeros(len(words), np.int64), value
        order = np.argsort(words)  # near each other in the trie, near in time
        counts = np.empty(len(words), np.int64)
        counts[order], value[order] = self._in_order(words[order], contexts[order])
        return counts, value

    def _in_order(self, words: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value = np.full(len(words), np.nan)
        at = self.word.successor(words)
        safe = np.minimum(at, self.word.n - 1)
        known = (at < self.word.n) & (self.word.get(safe) == words)
        counts = np.where(known, self.counts[safe], 0)
        w = safe[known]
        first, last = self.pointer.get(w).astype(np.int64), self.pointer.get(w + 1).astype(np.int64)
        want = (w.astype(_U) << _U(CONTEXT_BITS)) | contexts[known]
        p = self.context.successor(want, first, last)
        hit = p < last
        hit[hit] = self.context.get(p[hit]) == want[hit]
        step = (self.head["most"] - self.head["least"]) / CODES
        found = np.flatnonzero(known)[hit]
        value[found] = self.head["least"] + self.codes[p[hit]] * step
        return counts, value


def _tokens(column):
    """(first row, bounds, words, contexts) of each chunk of rows; every row ends in END."""
    data, offsets = _text.arrow_bytes(column)
    for a, z in _text.slices(data, offsets, CHUNK_BYTES):
        hashes, bounds = _text.hash_words(data, offsets[a : z + 1])
        ends = bounds[1:] + np.arange(1, z - a + 1)
        w = np.empty(len(hashes) + z - a, _U)
        is_end = np.zeros(len(w), bool)
        is_end[ends - 1] = True
        w[~is_end] = hashes
        w[is_end] = END
        u = np.empty_like(w)
        u[1:] = w[:-1]
        starts = np.concatenate([[0], ends])
        u[starts[:-1]] = START
        yield a, starts, w, u


def _bytes(planes: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(planes.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _longs(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def _shard_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return (((hashes >> _U(40)) * _U(n)) >> _U(24)).astype(np.int32)


def _least(n: int, frequent: int, pairs: int) -> int:
    """More tokens than this make a word frequent, of ``n`` training tokens. It grows with ``n``."""
    return min(max(frequent, n // MOST_FREQUENT), n // pairs)


def _unigrams(docs: DataFrame, shards: int, dear: int, pairs: int) -> tuple[int, int, np.ndarray, np.ndarray, int]:
    """Training tokens, distinct ones, frequent words in order with their counts, and all tokens."""

    def count(batches):
        for b in batches:
            train = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, starts, w, _ in _tokens(b.column(0)):
                mask = np.repeat(train[a : a + len(starts) - 1], np.diff(starts))
                words, n = np.unique(w[mask], return_counts=True)
                shard = _shard_of(words, shards)
                cuts = np.searchsorted(shard, np.arange(shards + 1))  # hashes are sorted, and so are shards
                rows = [(-1, b"", int(len(w)).to_bytes(8, "little"))]
                rows += [(int(s), words[cuts[s] : cuts[s + 1]].tobytes(), n[cuts[s] : cuts[s + 1]].astype(np.uint32).tobytes()) for s in np.flatnonzero(np.diff(cuts))]
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([max(x, 0) for x in c[0]], pa.int32()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.binary())], names=["shard", "words", "counts"])

    def total(batches):
        words, counts, every = [], [], 0
        for b in batches:
            for w, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if w:
                    words.append(np.frombuffer(w, _U))
                    counts.append(np.frombuffer(n, np.uint32).astype(np.int64))
                else:
                    every += int.from_bytes(n, "little")
        if not words and not every:
            return
        kinds, back = np.unique(np.concatenate(words) if words else np.zeros(0, _U), return_inverse=True)
        sums = np.bincount(back, np.concatenate(counts) if words else None, len(kinds)).astype(np.int64) if words else np.zeros(0, np.int64)
        most = np.flatnonzero(sums > _least(int(sums.sum()), dear, pairs))  # a superset: a shard has a part of the tokens
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *kinds[most].view(np.int64).tolist()], pa.int64()), pa.array([int(sums.sum()), *sums[most].tolist()], pa.int64()), pa.array([len(kinds)] + [0] * len(most), pa.int64()), pa.array([every] + [0] * len(most), pa.int64())],
            names=["word", "n", "kinds", "every"],
        )

    rows = docs.select("text", "train").mapInArrow(count, "shard int, words binary, counts binary")
    found = written(rows.repartitionById(shards, F.col("shard")).mapInArrow(total, "word long, n long, kinds long, every long"))
    n, v, every = (int(x or 0) for x in found.where("word is null").agg(F.sum("n"), F.sum("kinds"), F.sum("every")).first())
    # fewer than MOST_FREQUENT words, or MOST_PAIRS: their counts add up to n at most
    hot = found.where("word is not null").where(F.col("n") > _least(n, dear, pairs)).select("word", "n").toArrow()
    frequent, counts = hot["word"].to_numpy().astype(np.int64).view(_U), hot["n"].to_numpy().astype(np.int64)
    order = np.argsort(frequent)
    return n, v, frequent[order], counts[order], every


def _frequent_pairs(docs: DataFrame, frequent: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, words and counts of frequent pairs, by key; both of their words are frequent (or the context is the start)."""
    side = len(frequent) + 1

    def count(batches):
        for b in batches:
            train = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, starts, w, u in _tokens(b.column(0)):
                mask = np.repeat(train[a : a + len(starts) - 1], np.diff(starts))
                wi, ui = _place(frequent, w), np.where(u == START, side - 1, _place(frequent, u))
                own = mask & (wi >= 0) & (ui >= 0)
                pair, times = np.unique(wi[own] * side + ui[own], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(times, pa.int64())], names=["pair", "n"])

    if not len(frequent):
        return np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64)
    rows = docs.select("text", "train").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = rows.where(F.col("n") > least).toArrow()
    names, pair = np.concatenate([frequent, [START]]), found["pair"].to_numpy().astype(np.int64)
    words = names[pair // side]
    keys = _pair_key(words, names[pair % side])
    order = np.argsort(keys)
    return keys[order], words[order], found["n"].to_numpy().astype(np.int64)[order]


def _place(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train: str, folder: str | None = None, frequent_from: int = FREQUENT, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Fits the model on the rows where column ``train`` is not false, and scores all rows.

    Returns id, train, n_tokens, n_known, train_tokens, base_score and score. The tries stay in ``folder``.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(train), F.lit(True)).alias("train"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    tasks = tasks_for(spark)
    size = docs.agg(F.count(F.when(F.col("train"), 1)).alias("ends"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    ends = size.ends
    n, v, frequent, given_counts, every = _unigrams(docs, max(tasks, math.ceil((size.bytes or 0) / COUNTED_BYTES)), frequent_from, most_pairs)
    hot, hot_words, hot_counts = _frequent_pairs(docs, frequent[given_counts > n // most_pairs], n // most_pairs)
    shards = max(tasks, math.ceil(every / TOKENS_PER_SHARD))
    z = math.log10(n + v + 1)

    def base(counts):
        return np.log10(counts + 1.0) - z

    def context_term(counts):
        return -np.log10(counts + PRIOR)

    hot_word_counts = given_counts[_place(frequent, hot_words)]
    hot_base = base(hot_word_counts)
    hot_value = np.log10(hot_counts + PRIOR * 10.0**hot_base) + np.where(hot_words == END, 0, context_term(hot_word_counts))

    def deal(batches):
        partition, number = TaskContext.get().partitionId(), 0
        for b in batches:
            is_train = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, starts, w, u in _tokens(b.column(2)):
                rows = len(starts) - 1
                chunk = partition << 24 | number
                number += 1
                doc = np.repeat(np.arange(rows), np.diff(starts))
                h = _place(hot, _pair_key(w, u))
                own = np.flatnonzero(h >= 0)
                sums = np.zeros((3, rows))
                if len(own):
                    sums[0] += np.bincount(doc[own], hot_base[h[own]], rows)
                    sums[1] += np.bincount(doc[own], minlength=rows)
                    sums[2] += np.bincount(doc[own], hot_value[h[own]], rows)
                sums[2] += context_term(ends)
                train_bits = is_train[a : a + rows]
                yield _row(chunk, -1, a, rows, b, starts, train_bits, sums)
                rest = np.flatnonzero(h < 0)
                w, u, doc = w[rest], u[rest], doc[rest]
                shard = _shard_of(np.where(_place(frequent, w) >= 0, _pair_key(w, u), w), shards)
                order2 = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order2], np.arange(shards + 1))
                out = []
                for s in np.flatnonzero(np.diff(cuts)):
                    o = order2[cuts[s] : cuts[s + 1]]
                    out.append((chunk, int(s), _packed(w[o], u[o], doc[o], rows, train_bits)))
                for at in range(0, len(out), 64):
                    c3 = list(zip(*out[at : at + 64], strict=True))
                    yield _batch(c3)

    def _batch(c3):
        return pa.RecordBatch.from_arrays([pa.array(c3[0], pa.int64()), pa.array(c3[1], pa.int32()), pa.array(c3[2], pa.binary())], names=["chunk", "shard", "data"])

    def _row(chunk, shard, a, rows, b, starts, train_bits, sums):
        ids = pa.RecordBatch.from_arrays([b.column(0).slice(a, rows), pa.array(train_bits), pa.array(np.diff(starts), pa.int64())], names=["id", "train", "n"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ids.schema) as s:
            s.write_batch(ids)
        return _batch(([chunk], [shard], [rows.to_bytes(8, "little") + sums.tobytes() + sink.getvalue().to_pybytes()]))

    def answer(batches):
        shard, blobs = 0, []
        while batches:
            b = batches.pop()
            if b.num_rows:
                shard = b.column(1)[0].as_py()
                blobs += zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)
        if not blobs:
            return
        n_all = sum(int(np.frombuffer(d, np.int64, 4)[3]) for _, d in blobs)
        w, u, is_train = np.empty(n_all, _U), np.empty(n_all, _U), np.empty(n_all, bool)
        at, placed = 0, []
        for k, (chunk, data) in enumerate(blobs):
            w1, u1, counts1, train1 = _unpacked(data)
            blobs[k] = None
            z_ = at + len(w1)
            w[at:z_], u[at:z_], is_train[at:z_] = w1, u1, np.repeat(train1, counts1)
            placed.append((chunk, at, counts1.astype(np.uint32)))
            at = z_
        uri = f"{folder}/{shard:06d}.trie"
        Trie.write(uri, *Trie.build(w[is_train], u[is_train], frequent, given_counts, base))
        trie = Trie.open(uri)
        _, first, back = np.unique(_pair_key(w, u), return_index=True, return_inverse=True)
        w, u = w[first], u[first]
        counts, value = trie.lookup(w, u)
        del trie
        given = _place(frequent, w)
        counts = np.where(given >= 0, given_counts[given] if len(frequent) else 0, counts)
        b_ = base(counts)
        value = np.where(np.isnan(value), np.log10(PRIOR) + b_, value) + np.where(w == END, 0, context_term(counts))
        for chunk, at, counts1 in placed:
            rows = len(counts1)
            doc = np.repeat(np.arange(rows), counts1)
            i = back[at : at + len(doc)]
            sums = [np.bincount(doc, x, rows) for x in (b_[i], value[i], counts[i] > 0)]
            yield _batch(([chunk], [shard], [rows.to_bytes(8, "little") + sums[0].tobytes() + sums[1].astype(np.float32).tobytes() + sums[2].astype(np.uint32).tobytes()]))

    def combine(batches):
        chunks: dict[int, list] = {}
        for b in batches:
            for chunk, shard, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
                rows = int.from_bytes(data[:8], "little")
                one = chunks.setdefault(chunk, [np.zeros((3, rows)), None])
                if shard < 0:
                    one[0] += np.frombuffer(data, np.float64, 3 * rows, 8).reshape(3, rows)
                    one[1] = data[8 + 24 * rows :]
                else:
                    one[0][0] += np.frombuffer(data, np.float64, rows, 8)
                    one[0][2] += np.frombuffer(data, np.float32, rows, 8 + 8 * rows)
                    one[0][1] += np.frombuffer(data, np.uint32, rows, 8 + 12 * rows)
        for sums, head in chunks.values():
            ids = pa.ipc.open_stream(head).read_all().combine_chunks().to_batches()[0] if len(sums[0]) else None
            if ids is not None:
                yield pa.RecordBatch.from_arrays(
                    [*ids.columns, pa.array(np.round(sums[1]).astype(np.int64)), pa.array(np.full(len(sums[0]), n)), pa.array(sums[0]), pa.array(sums[2])],
                    names=["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = "chunk long, shard int, data binary"
    dealt = docs.mapInArrow(deal, kind)
    # heads of chunks go straight to the last step; they ride along as rows of their own shard
    asked = dealt.withColumn("to", F.when(F.col("shard") < 0, F.pmod(F.xxhash64("chunk"), F.lit(shards)).cast("int")).otherwise(F.col("shard")))

    def answer_all(batches):
        heads, rest = [], []
        for b in batches:
            b = b.select(["chunk", "shard", "data"])
            is_head = pa.compute.less(b.column(1), 0)
            heads.append(b.filter(is_head))
            rest.append(b.filter(pa.compute.invert(is_head)))
        yield from (h for h in heads if h.num_rows)
        yield from answer(rest)

    answered = asked.repartitionById(shards, F.col("to")).mapInArrow(answer_all, kind)
    out = answered.withColumn("to", F.pmod(F.xxhash64("chunk"), F.lit(shards)).cast("int")).repartitionById(shards, F.col("to")).select("chunk", "shard", "data")
    return out.mapInArrow(combine, f"id {id_type}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _pair_key(w: np.ndarray, u: np.ndarray) -> np.ndarray:
    return _text.mix((w * _U(0x9E3779B97F4A7C15)) ^ (u & _U((1 << CONTEXT_BITS) - 1)))


def _packed(w: np.ndarray, u: np.ndarray, doc: np.ndarray, rows: int, train: np.ndarray) -> bytes:
    """Bigrams of a chunk for one shard: distinct words and contexts, and places in these by document."""
    words, wi = np.unique(w, return_inverse=True)
    contexts, ui = np.unique(u & _U((1 << CONTEXT_BITS) - 1), return_inverse=True)
    counts = np.bincount(doc, minlength=rows)
    head = np.array([rows, len(words), len(contexts), len(w)], np.int64).tobytes()
    small = lambda x, most: x.astype(np.uint16 if most < 65536 else np.uint32).tobytes()
    return head + np.packbits(train).tobytes() + small(counts, int(counts.max())) + b"\0" + words.tobytes() + _bytes(contexts, CONTEXT_BITS // 8) + small(wi, len(words)) + small(ui, len(contexts))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows, words, contexts, n = np.frombuffer(data, np.int64, 4).tolist()
    at = 32
    train = np.unpackbits(np.frombuffer(data, np.uint8, -(-rows // 8), at), count=rows).astype(bool)
    at += -(-rows // 8)
    rest = 8 * words + CONTEXT_BITS // 8 * contexts + n * ((2 if words < 65536 else 4) + (2 if contexts < 65536 else 4)) + 1
    width = (len(data) - at - rest) // rows
    counts = np.frombuffer(data[at : at + width * rows], np.uint16 if width == 2 else np.uint32)
    at += width * rows + 1
    w = np.frombuffer(data[at : at + 8 * words], _U)
    at += 8 * words
    u = _longs(data[at : at + CONTEXT_BITS // 8 * contexts], CONTEXT_BITS // 8)
    at += CONTEXT_BITS // 8 * contexts
    kind = np.uint16 if words < 65536 else np.uint32
    wi = np.frombuffer(data[at : at + n * kind().itemsize], kind)
    at += n * kind().itemsize
    ui = np.frombuffer(data[at:], np.uint16 if contexts < 65536 else np.uint32)
    return w[wi], u[ui], counts, train
