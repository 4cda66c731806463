"""Byte-level byte-pair encoding of whole corpora with a public vocabulary.

A text is split by the vocabulary's pattern; each piece's bytes are the nodes
of a doubly linked list, and a priority queue holds the ranks of the adjacent
pairs. The lowest rank is merged, its neighbours' new pairs are pushed, and
entries whose pair no longer stands are skipped when popped. Ids of pieces seen
before come from a bounded memo, so in running text the queue works on new
words only. Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public vocabularies lie; a parameter of every operator here.
TOKENIZER_DIR = "/opt/tokenizers"
DEFAULT_VOCABULARY = "byte_bpe_50k"
#: Pieces remembered by a worker, and the longest piece worth it.
MEMO_PIECES = 250_000
MEMO_LENGTH = 40
#: Documents a result batch holds at most.
OUT_ROWS = 512

# The public pattern's contractions and white space.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACE = r"\t-\r \x85\xa0  -     　"
_PATTERN = regex.compile(rf"{_CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The same for texts of ASCII alone, where the plain engine is twice as fast.
_ASCII = re.compile(rf"{_CONTRACTIONS}| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def rank_file(name: str = DEFAULT_VOCABULARY, folder: str = TOKENIZER_DIR) -> bytes:
    """The rank file of a vocabulary (``<name>.tiktoken``), read on the driver;
    a vocabulary has a fixed size, so it may be sent to every executor."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


class Encoder:
    """Text to ids and back for one rank file."""

    def __init__(self, ranks_text: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_text.splitlines() if line)}
        self.strings = {r: s for s, r in self.ranks.items()}
        self._bytes = [self.ranks[bytes([i])] for i in range(256)]
        self._pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self._pairs[left << 20 | right] = rank
        self.memo = _Memo(self)
        self.counts = _Counts(self.memo)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece of the pattern."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        ids = [self._bytes[b] for b in piece]
        n = len(ids)
        shift = max(16, n.bit_length())
        low = (1 << shift) - 1
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = self._pairs.get
        queue = []
        for i in range(n - 1):
            rank = pair(ids[i] << 20 | ids[i + 1])
            if rank is not None:
                queue.append(rank << shift | i)
        heapify(queue)
        while queue:
            entry = heappop(queue)
            at, rank = entry & low, entry >> shift
            left = ids[at]
            other = following[at]
            if left < 0 or other >= n or pair(left << 20 | ids[other]) != rank:
                continue  # stale: one of the two was merged since
            ids[at], ids[other] = rank, -1
            after = following[at] = following[other]
            if after < n:
                before[after] = at
                new = pair(rank << 20 | ids[after])
                if new is not None:
                    heappush(queue, new << shift | at)
            prior = before[at]
            if prior >= 0:
                new = pair(ids[prior] << 20 | rank)
                if new is not None:
                    heappush(queue, new << shift | prior)
        return [i for i in ids if i >= 0]

    @staticmethod
    def pieces(text: str) -> list[str]:
        return (_ASCII if text.isascii() else _PATTERN).findall(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.pieces(text)))) if text else []

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode(errors="replace")


class _Memo(dict):
    """piece -> ids, emptied when full; long pieces are merged each time."""

    def __init__(self, encoder: Encoder):
        self._encoder = encoder

    def __missing__(self, piece: str) -> Sequence[int]:
        ids = tuple(self._encoder.merge(piece.encode()))
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class _Counts(dict):
    """piece -> number of ids, emptied when full, like the memo it asks."""

    def __init__(self, memo: _Memo):
        self._memo = memo

    def __missing__(self, piece: str) -> int:
        count = len(self._memo[piece])
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = count
        return count


_encoders: dict[bytes, Encoder] = {}


def worker_encoder(ranks_text: bytes) -> Encoder:
    """One encoder a Python worker and vocabulary; workers are used again."""
    if ranks_text not in _encoders:
        _encoders.clear()
        _encoders[ranks_text] = Encoder(ranks_text)
    return _encoders[ranks_text]


def encode_corpus(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id, ``ids`` ARRAY<INT>) of every row, without special tokens; their
    strings in a text are ordinary text. A null or empty text has the empty
    list. One row for each input row, repeated ids too; no shuffle; other
    columns are ignored.
    """
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(vocabulary, folder))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    values_type = pa.list_(pa.field("element", pa.int32(), nullable=False))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(ranks.value)
        ids_of, pieces = encoder.memo.__getitem__, encoder.pieces
        for batch in batches:
            for lo in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(lo, OUT_ROWS)
                flat, ends = array("i"), [0]
                for text in part.column(1).to_pylist():
                    if text:
                        flat.extend(chain.from_iterable(map(ids_of, pieces(text))))
                    ends.append(len(flat))
                values = pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values).cast(values_type)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id, ``text``) of encoded rows: the vocabulary's strings, concatenated.
    An empty or null list gives the empty text."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(vocabulary, folder))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(ranks.value)
        for batch in batches:
            texts = [encoder.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, schema)
