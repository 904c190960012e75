"""Byte-level BPE encoding and decoding.

A pre-token's bytes form a doubly linked list of symbols. A priority queue holds the merge
rank and place of each adjacent pair; the least is popped, entries whose pair has changed
since are skipped as stale, and a merge relinks the list and pushes the two new pairs. Equal
pre-tokens are merged once and kept in a table of bounded size. Decoding concatenates the
byte strings of the vocabulary.

Contracts
* null text encodes to no ids and decodes to the empty text.
* strings of added tokens (``<|endoftext|>``) in a text become their id, as the library does.
* ids are packed in a binary column as little-endian unsigned 32-bit integers.
* all other columns pass through; a column that has the output's name is replaced.
* rows stand for themselves: repeated rows and ids give repeated results, empty tables none.
"""

from __future__ import annotations

import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._worker import kept

#: Bytes of pre-tokens kept per worker, about; the table is emptied when it is full.
KEPT_BYTES = 64 << 20
#: Bytes of an entry beside its characters and ids, and characters from which a pre-token is not kept.
ENTRY_BYTES, LONG_WORD = 200, 1000
#: Characters from which a text's pre-tokens are not listed at once.
LONG_TEXT = 1_000_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class is the same in all Unicode versions in use; others ask the library.
_SETTLED = regex.compile(r"[\x00-՗ -⁣⁰ⁱ⁴-₎₠-₿℀-↉←-⏿─-➿　-】ぁ-ゖァ-ヺー一-龥가-힣！-ﾾ]*+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class _Words(dict):
    """Packed ids of pre-tokens, merged when first asked for."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.room = merge, KEPT_BYTES

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.merge(word.encode()), "<u4").tobytes()
        if len(word) < LONG_WORD:
            self.room -= ENTRY_BYTES + len(word) + len(ids)
            if self.room < 0:
                self.clear()
                self.room = KEPT_BYTES
            self[word] = ids
        return ids


class Bpe:
    """A byte-level BPE model read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        characters = byte_characters()
        of_character = {c: b for b, c in enumerate(characters)}
        self.first = [vocab[c] for c in characters]
        self.width = max([*vocab.values(), *added.values()]) + 1
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] * self.width + vocab[b]] = (rank, vocab[a + b])
        self.strings: list[bytes] = [b""] * self.width
        for s, i in chain(vocab.items(), added.items()):
            self.strings[i] = bytes(of_character[c] for c in s) if all(c in of_character for c in s) else s.encode()
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pattern = regex.compile(PATTERN)
        self.words = _Words(self.merge)
        self._library = None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        symbols = [self.first[b] for b in word]
        n = len(symbols)
        if n < 2:
            return symbols
        merges, width = self.merges, self.width
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            m = merges.get(symbols[i] * width + symbols[i + 1])
            if m is not None:
                queue.append((m[0], i, m[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, merged = heapq.heappop(queue)
            j = after[i]
            if j >= n or symbols[i] < 0:
                continue
            m = merges.get(symbols[i] * width + symbols[j])
            if m is None or m[0] != rank:
                continue
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get(merged * width + symbols[k])
                if m is not None:
                    heapq.heappush(queue, (m[0], i, m[1]))
            k = before[i]
            if k >= 0:
                m = merges.get(symbols[k] * width + merged)
                if m is not None:
                    heapq.heappush(queue, (m[0], k, m[1]))
        return [s for s in symbols if s >= 0]

    def _pieces(self, text: str):
        if _SETTLED.fullmatch(text):
            if len(text) < LONG_TEXT:
                return self.pattern.findall(text)
            return (m.group() for m in self.pattern.finditer(text))
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:z] for _, (a, z) in self._library.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text."""
        if not text:
            return b""
        if self.special is None or not self.special.search(text):
            return b"".join(map(self.words.__getitem__, self._pieces(text)))
        out = []
        for part in self.special.split(text):
            if part in self.added:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            elif part:
                out.append(b"".join(map(self.words.__getitem__, self._pieces(part))))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """Text of packed ids; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")


def load(path: str) -> Bpe:
    """The model of a file, kept by the worker process across tasks."""
    return kept(("bpe", path), lambda: Bpe(path))


def _with_columns(df: DataFrame, source: str, outs: dict[str, T.DataType], make) -> DataFrame:
    schema = T.StructType([f for f in df.schema if f.name not in outs] + [T.StructField(k, v) for k, v in outs.items()])
    kinds = [pa.binary() if isinstance(v, T.BinaryType) else pa.string() for v in outs.values()]

    def run(batches):
        one = make()
        for b in batches:
            values = list(zip(*(one(x.as_py()) for x in b.column(b.schema.get_field_index(source))), strict=True)) or [()] * len(outs)
            names = [n for n in b.schema.names if n not in outs]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), *map(pa.array, values, kinds)], names=[*names, *outs])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, *, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Adds the packed ids of ``text_col``. ``path`` is read on each worker."""

    def make():
        model = load(path)
        return lambda text: (model.encode(text),)

    return _with_columns(df, text_col, {out: T.BinaryType()}, make)


def decode(df: DataFrame, path: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of packed ids."""

    def make():
        model = load(path)
        return lambda ids: (model.decode(ids),)

    return _with_columns(df, ids_col, {out: T.StringType()}, make)


def encode_and_decode(df: DataFrame, path: str, *, text_col: str = "text", ids_out: str = "ids", decoded_out: str = "decoded") -> DataFrame:
    """Adds the packed ids and the text that they decode to, in one pass of one worker for each task."""

    def make():
        model = load(path)

        def both(text):
            ids = model.encode(text)
            return ids, model.decode(ids)

        return both

    return _with_columns(df, text_col, {ids_out: T.BinaryType(), decoded_out: T.StringType()}, make)
