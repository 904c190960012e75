"""Token ids in Arrow IPC files of equal-length sequences.

A shard holds the ids of a range of documents one after the other, cut into sequences of a
fixed length. Its file has record batches of two fixed-size-list columns, ``tokens`` and
``mask`` (false only on the padding of a shard's last sequence), so that any sequence is a
zero-copy slice of the mapped file. An index file beside it has each document's place.

Contracts
* documents are written in ascending id order, null ids first; rows of one id by a hash of
  their text, then by their ids' bytes. Null or empty texts have the end id alone.
* shards follow from the bytes of all texts. An id (or null) that has more rows than a shard
  takes is cut by the hash, so only rows equal in id and text must lie together.
* files appear under their names only when complete, so a retried task cannot leave halves.
* extra columns of the input are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._store import shared_folder, tasks_for, written
from ._worker import kept

SEQUENCE = 2048
BATCH_ROWS = 64
#: Text of a shard, on average.
SHARD_BYTES = 256 << 20
SLICE_BYTES = 12 << 20
#: Chunks known to a worker, at some 25 bytes each; the pool is emptied when it is full.
KEPT_CHUNKS = 3_000_000
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_SIMPLE = regex.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


class Encoder:
    """The tokenizers library over distinct chunks between white space.

    A vocabulary with word ends and a lower-casing normaliser never joins tokens across white
    space, so equal chunks (A-Z folded) have equal ids wherever they stand. Chunks are found
    and compared as hashes; the ids of known ones lie in one pool. Chunks of plain letters,
    perhaps with marks behind, are encoded many at a time: a token whose string has the word
    end closes a piece, which tells the chunks apart again.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if max(vocab.values()) < 65536 else np.dtype("<u4")
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for s, i in vocab.items() if s.endswith(suffix)]] = True
        self.by_chunk = bool(suffix) and "Lowercase" in repr(self.library.normalizer)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.dtype)

    def _whole(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        pieces = np.zeros(len(chunks), np.int64)
        for i, c in enumerate(chunks):
            if c.isascii():
                w = c.rstrip(_MARKS)
                if w.isalpha():
                    pieces[i] = 1 + (len(w) < len(c))
            elif m := _SIMPLE.fullmatch(c):
                pieces[i] = 1 + bool(m[2])
        simple = np.flatnonzero(pieces)
        ids = np.array(self.library.encode(" ".join([chunks[i] for i in simple]), add_special_tokens=False).ids, np.int64)
        closes = np.flatnonzero(self.ends[ids]) + 1
        size = np.zeros(len(chunks), np.int64)
        if len(closes) == pieces.sum():
            size[simple] = np.diff(np.concatenate([[0], closes[np.cumsum(pieces[simple]) - 1]])) if len(simple) else 0
        else:
            pieces[:], simple, ids = 0, simple[:0], ids[:0]
        rest = np.flatnonzero(pieces == 0)
        more = self._whole([chunks[i] for i in rest])
        size[rest] = [len(x) for x in more]
        order = np.concatenate([simple, rest])
        start = np.empty(len(chunks), np.int64)
        start[order] = np.cumsum(size[order]) - size[order] + len(self.pool)
        self.pool = np.concatenate([self.pool, ids.astype(self.dtype), *more])
        keys, at, size = np.concatenate([self.keys, keys]), np.concatenate([self.at, start]), np.concatenate([self.size, size])
        order = np.argsort(keys)
        self.keys, self.at, self.size = keys[order], at[order], size[order]

    def encode(self, column: pa.Array, end_id: int) -> list[bytes]:
        """Packed ids of each row, with the end id behind."""
        end = np.array([end_id], self.dtype)
        if not self.by_chunk:
            return [x.tobytes() + end.tobytes() for x in self._whole(column.to_pylist())]
        data, offsets = _text.arrow_bytes(column)
        hashes, bounds, first, last = _text.placed_words(data, offsets)
        if len(self.keys) > KEPT_CHUNKS:
            self._clear()
        kinds, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        new = kinds[np.isin(kinds, self.keys, assume_unique=True, invert=True)] if len(self.keys) else kinds
        if len(new):
            where = where[np.searchsorted(kinds, new)]
            raw = data.tobytes()
            self._learn(new, [raw[a:z].decode() for a, z in zip(first[where].tolist(), last[where].tolist(), strict=True)])
        kind = np.searchsorted(self.keys, kinds)[back]
        size = self.size[kind]
        stop = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[kind] - stop + size, size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        cuts = np.concatenate([[0], stop])[bounds]
        out = [ids[a:z].tobytes() + end.tobytes() for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for t in self.added:  # such a string in a text is one token, in its own case only
            for i in np.flatnonzero(pa.compute.match_substring(column, t).fill_null(False).to_numpy(zero_copy_only=False)):
                out[i] = self._whole([column[i].as_py()])[0].tobytes() + end.tobytes()
        return out


def _encoder(path: str) -> Encoder:
    return kept(("encoder", path), lambda: Encoder(path))


def shard_of(ids: pa.Array, hashes: np.ndarray, cuts: np.ndarray, null_shards: int) -> np.ndarray:
    """Shards of rows. Shard k after those of null ids ends with id ``cuts[k]``; a cut that
    repeats belongs to an id with more rows than a shard, whose rows are dealt by their hashes."""
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    first, last = np.searchsorted(cuts, values, "left"), np.searchsorted(cuts, values, "right")
    null = ids.is_null().to_numpy(zero_copy_only=False)
    first = np.where(null, 0, first + null_shards)
    parts = np.where(null, null_shards, np.maximum(last - first + null_shards, 1))
    part = (hashes.astype(np.int64) >> 32) + (1 << 31)  # the upper half, from 0
    return (first + (part * parts >> 32)).astype(np.int32)


def _encoded(docs: DataFrame, path: str, end_id: int, cuts: np.ndarray, null_shards: int) -> DataFrame:
    def run(batches):
        encoder = _encoder(path)
        for b in batches:
            offsets = _text.arrow_bytes(b.column(1))[1]
            shard = pa.array(shard_of(b.column(0), b.column(2).to_numpy(zero_copy_only=False), cuts, null_shards))
            for a, z in _text.slices(None, offsets, SLICE_BYTES):
                packed = pa.array(encoder.encode(b.column(1).slice(a, z - a), end_id), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), packed, shard.slice(a, z - a), b.column(2).slice(a, z - a)], names=["id", "ids", "shard", "h"])

    return docs.mapInArrow(run, "id long, ids binary, shard int, h long")


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, path: str, folder: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Writes the files and returns (shard, n_docs, n_tokens), read back from a written table."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = docs.agg(F.count("*").alias("rows"), F.count("id").alias("ids"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    shards = shards or max(tasks_for(spark), math.ceil((size.bytes or 0) / SHARD_BYTES))
    null_shards = min(size.rows - size.ids, math.ceil((size.rows - size.ids) * shards / max(1, size.rows)))
    main = max(1, shards - null_shards)
    cuts = np.sort(np.array(docs.approxQuantile("id", [k / main for k in range(1, main)], 1 / (4 * main)) if main > 1 else [], np.float64).astype(np.int64))
    rows = _encoded(docs.withColumn("h", F.xxhash64("text")), path, end_id, cuts, null_shards)
    rows = rows.repartitionById(null_shards + len(cuts) + 1, F.col("shard")).sortWithinPartitions(F.col("id").asc_nulls_first(), "h", "ids").drop("h")

    def run(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        dtype = np.dtype("<u2") if pa_type(path) == pa.uint16() else np.dtype("<u4")
        schema = pa.schema([("tokens", pa.list_(pa.field("item", pa.uint16() if dtype.itemsize == 2 else pa.uint32(), False), sequence)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), sequence))])
        key = None
        ids, counts, held, size, total = [], [], [], 0, 0
        attempt = uuid.uuid4().hex
        sink = writer = None
        block = sequence * BATCH_ROWS

        def put(tokens: np.ndarray, real: int) -> None:
            values = pa.FixedSizeListArray.from_arrays(pa.array(tokens), type=schema.field(0).type)
            mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(tokens)) < real), type=schema.field(1).type)
            writer.write_batch(pa.RecordBatch.from_arrays([values, mask], schema=schema))

        for b in batches:
            for id_, packed, shard_ in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if key is None:
                    key = shard_
                    sink = fs.open_output_stream(f"{base}/.{key:06d}-{attempt}")
                    writer = pa.ipc.new_file(sink, schema)
                tokens = np.frombuffer(packed.as_buffer(), dtype)
                ids.append(id_)
                counts.append(len(tokens))
                held.append(tokens)
                size += len(tokens)
                total += len(tokens)
                if size >= block:
                    one = np.concatenate(held)
                    for at in range(0, size - size % block, block):
                        put(one[at : at + block], block)
                    held, size = [one[size - size % block :]], size % block
        if key is None:
            return
        if size:
            one = np.concatenate([*held, np.zeros(-size % sequence, dtype)])
            put(one, size)
        writer.close()
        sink.close()
        fs.move(f"{base}/.{key:06d}-{attempt}", f"{base}/{key:06d}.arrow")
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        index = pa.table({"id": pa.array(ids, pa.int64()), "start": starts, "n_tokens": pa.array(counts, pa.int64())})
        with fs.open_output_stream(f"{base}/.{key:06d}-{attempt}") as f, pa.ipc.new_file(f, index.schema) as w:
            w.write_table(index)
        fs.move(f"{base}/.{key:06d}-{attempt}", f"{base}/{key:06d}.index.arrow")
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64())], names=["shard", "n_docs", "n_tokens"])

    return written(rows.mapInArrow(run, "shard int, n_docs long, n_tokens long"))


def pa_type(path: str) -> pa.DataType:
    """The width of ids that a tokenizer file needs."""
    return pa.uint16() if _encoder(path).dtype.itemsize == 2 else pa.uint32()


class Shard:
    """Random access to one shard; a local file is mapped and its sequences are not copied."""

    def __init__(self, folder: str, shard: int):
        fs, base = _open(folder)
        name = f"{base}/{shard:06d}"
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        self.source = pa.memory_map(f"{name}.arrow") if local else fs.open_input_file(f"{name}.arrow")
        self.file = pa.ipc.open_file(self.source)
        self.sequence = self.file.schema.field("tokens").type.list_size
        with fs.open_input_file(f"{name}.index.arrow") as f:
            self.index = pa.ipc.open_file(f).read_all()

    def block(self, k: int) -> np.ndarray:
        return self.file.get_batch(k).column(0).values.to_numpy(zero_copy_only=True)

    def sequences(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and mask of sequence ``k``."""
        batch, row = self.file.get_batch(k // BATCH_ROWS), k % BATCH_ROWS
        return batch.column(0)[row].values.to_numpy(), batch.column(1)[row].values.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        size, parts = self.sequence * BATCH_ROWS, []
        while n > 0:
            k, at = divmod(start, size)
            one = self.block(k)[at : at + n]
            parts.append(one)
            start, n = start + len(one), n - len(one)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def read_tokens(shards: DataFrame, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids) from the files; start counts the ids of all documents before."""
    # a row per shard; the running sum is over shards, not documents
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    placed = placed.repartition(max(1, tasks_for(shards.sparkSession)), "shard")

    def run(batches):
        for b in batches:
            for key, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(folder, key)
                ids, starts, counts = (shard.index.column(c).to_numpy(zero_copy_only=False) if c != "id" else shard.index.column(c) for c in ("id", "start", "n_tokens"))
                ids = ids.combine_chunks()
                for at in range(0, len(counts), 500):
                    some = [shard.tokens(int(s), int(n)).astype("<u4").tobytes() for s, n in zip(starts[at : at + 500], counts[at : at + 500], strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(some)), pa.array(starts[at : at + 500] + base, pa.int64()), pa.array(counts[at : at + 500], pa.int64()), pa.array(some, pa.binary())], names=["id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def token_folder(docs: DataFrame) -> str:
    """A folder of its own for the files, shared by driver and executors."""
    return shared_folder(docs.sparkSession)


