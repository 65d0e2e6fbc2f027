"""Encoding a corpus with a public byte-level BPE tokenizer (problem 8).

The encoder is this module's own: text is cut into pieces by the vocabulary's
pattern, each piece starts as a doubly linked list of single bytes, and a priority
queue of merge ranks repeatedly joins the best adjacent pair; queue entries whose
symbols have changed since are stale and skipped.  Decoding concatenates the
vocabulary's byte strings.

Most running words repeat, so the ids of a blank-delimited chunk and of a piece are
memoised a worker (bounded tables, cleared when full: only speed depends on them).
Ids leave Python as one Arrow list array a batch, without per-id objects.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sondhan.session import spread

# Fixed value: how byte-level vocabularies of this family cut text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNKS = r" ?\S+|\s+(?!\S)|\s+"
TABLE = 400_000
#: Chunks and pieces of more characters are merged afresh each time: a table of TABLE entries of up to so many is a bounded number of bytes.
MEMO_CHARACTERS = 200
OUT_TOKENS = 1_000_000


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a vocabulary of the public tokenizers on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= MEMO_CHARACTERS:
            if len(self) >= TABLE:
                self.clear()
            self[key] = value
        return value


class ByteBpe:
    """Encoder and decoder over a file of base64 byte strings with their ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}
        self.words = {rank: word for word, rank in self.ranks.items()}
        self._pieces, self._chunks = regex.compile(PIECES), regex.compile(CHUNKS)
        self._piece, self.chunk = _Memo(self._merge), _Memo(self._chunk)

    def _merge(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        n, ranks = len(raw), self.ranks
        symbol: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, raw[i : i + 2]) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, joined = heapq.heappop(queue)
            j = after[i] if symbol[i] is not None else n
            if j >= n or symbol[i] + symbol[j] != joined:
                continue  # stale: one side was merged meanwhile
            symbol[i], symbol[j], after[i] = joined, None, after[j]
            if after[j] < n:
                before[after[j]] = i
                pair = joined + symbol[after[j]]
                if (r := ranks.get(pair)) is not None:
                    heapq.heappush(queue, (r, i, pair))
            if before[i] >= 0:
                pair = symbol[before[i]] + joined
                if (r := ranks.get(pair)) is not None:
                    heapq.heappush(queue, (r, before[i], pair))
        return np.array([ranks[s] for s in symbol if s is not None], np.int32).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self._piece.__getitem__, self._pieces.findall(chunk)))

    def encode_bytes(self, text: str | None) -> bytes:
        """Little-endian int32 ids; nothing for a null or empty text."""
        return b"".join(map(self.chunk.__getitem__, self._chunks.findall(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode(self, ids) -> str:
        return b"".join(self.words[int(i)] for i in ids).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def load(path: str | None) -> ByteBpe:
    """The worker's copy of a vocabulary; without a path the worker's own installation is asked for it."""
    path = path or default_vocabulary()
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids array<int>), one row a row of ``df``.

    Null and empty texts give an empty list; texts are encoded whole, without special
    tokens, and strings that look like special tokens are ordinary text.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            parts, sizes, start = [], [], 0
            keys, texts = batch.column(0), batch.column(1)
            for row, value in enumerate(texts):
                parts.append(bpe.encode_bytes(value.as_py()))
                sizes.append(len(parts[-1]) // 4)
                if sum(map(len, parts)) >= 4 * OUT_TOKENS if row % 64 == 63 else row == len(texts) - 1:
                    yield _lists(keys.slice(start, row + 1 - start), sizes, parts)
                    parts, sizes, start = [], [], row + 1
            if parts:
                yield _lists(keys.slice(start), sizes, parts)

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def _lists(keys: pa.Array, sizes: list[int], parts: list[bytes]) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    flat = pa.Array.from_buffers(pa.int32(), int(sum(sizes)), [None, pa.py_buffer(b"".join(parts))])
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, flat)], ["key", "ids"])


def count_tokens(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n_tokens int), 0 for null and empty texts."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n = pa.array([len(bpe.encode_bytes(t)) // 4 for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], ["key", "n_tokens"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, n_tokens int")


def decode(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(key, text): the texts again; null ids give null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = pa.array([None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["key", "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def pieces_of(text: str) -> list[str]:
    """The pieces a text is cut into, for tests of the two-level cut."""
    return list(itertools.chain.from_iterable(regex.findall(PIECES, c) for c in regex.findall(CHUNKS, text)))
