"""Evaluation texts leaking into a corpus: pigeonhole pieces, Myers distance.

Every run of ``window`` words of a test item is a passage that may have leaked.
With an error budget of e words it is cut into e + 1 pieces, at least one of
which stands unchanged in any copy with at most e word edits. The pieces' exact
hits in a document are found by number: words become ids of the items' own
vocabulary, and piece fingerprints are looked up in a sorted array. Around each
hit Myers' bit-parallel algorithm, over words, gives the passage's distance.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.mail import text_parts
from pathloom.runtime import cut_lineage

#: Characters of test items sent to the executors at once, about; larger sets go
#: in blocks. A word and the gap after it are two characters at least.
BLOCK_CHARS = 16_000_000
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


def myers_best(pattern: Sequence[int], text: Iterable[int]) -> int:
    """Smallest edit distance of ``pattern`` to any stretch of ``text``; symbols
    are integers, each a bit vector over the pattern."""
    m = len(pattern)
    masks: dict[int, int] = defaultdict(int)
    for i, symbol in enumerate(pattern):
        masks[symbol] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for symbol in text:
        eq = masks.get(symbol, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus) & full, plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full  # a stretch may begin anywhere
        plus, minus = down | ~(xv | up) & full, up & xv
        best = min(best, score)
    return best


class ItemIndex:
    """The pieces of a block of test items."""

    def __init__(self, items: Sequence[tuple[object, str]], window: int, max_edits: int):
        if window < max_edits + 1:
            raise ValueError("a passage needs a word for each piece")
        self.window, self.max_edits = window, max_edits
        self.vocabulary: dict[str, int] = {}
        self.items = []
        for key, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text or "")]
            if len(ids) >= window:
                self.items.append((key, ids))
        cuts = [window * i // (max_edits + 1) for i in range(max_edits + 2)]
        self.pieces = list(zip(cuts, cuts[1:]))  # of a passage: (from, to)
        self.size = min(b - a for a, b in self.pieces)
        found = []
        for n, (_, ids) in enumerate(self.items):
            prints = self.fingerprints(np.array(ids, dtype=np.uint64))
            found += [(int(p), n, at) for at, p in enumerate(prints)]
        found.sort()
        self.prints = np.array([f[0] for f in found], dtype=np.uint64)
        self.places = [f[1:] for f in found]

    def fingerprints(self, ids: np.ndarray) -> np.ndarray:
        """Of each run of ``size`` words, by its start."""
        runs = max(0, len(ids) - self.size + 1)
        out = np.zeros(runs, dtype=np.uint64)
        for i in range(self.size):
            out = (out ^ ids[i : i + runs]) * _MIX
            out ^= out >> np.uint64(29)
        return out

    def search(self, text: str) -> dict[int, int]:
        """item number -> smallest distance of one of its passages, where within the budget."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words(text)], dtype=np.uint64)
        if len(ids) < self.size:
            return {}
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        starts = np.flatnonzero(unknown[self.size :] == unknown[: -self.size])
        if not len(starts):
            return {}
        prints = self.fingerprints(ids)[starts]
        lo = np.searchsorted(self.prints, prints)
        hit = lo < len(self.prints)
        hit[hit] = self.prints[lo[hit]] == prints[hit]
        best: dict[int, int] = {}
        doc = ids.tolist()
        for start, at in zip(starts[hit].tolist(), lo[hit].tolist()):
            mark = self.prints[at]
            while at < len(self.prints) and self.prints[at] == mark:
                n, place = self.places[at]
                at += 1
                item = self.items[n][1]
                if best.get(n) == 0 or item[place : place + self.size] != doc[start : start + self.size]:
                    continue
                for cut, _ in self.pieces:
                    begin = place - cut
                    if begin < 0 or begin + self.window > len(item):
                        continue
                    lo_doc = max(0, start - cut - self.max_edits)
                    region = doc[lo_doc : start - cut + self.window + self.max_edits]
                    distance = myers_best(item[begin : begin + self.window], region)
                    if distance <= self.max_edits and distance < best.get(n, self.max_edits + 1):
                        best[n] = distance
        return best


def _blocks(items: DataFrame, item_id: str, item_text: str, block_chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of a bounded size, by hash of the id; a longer item is a block of its own."""
    rows = items.select(F.col(item_id).alias("k"), F.col(item_text).alias("t")).dropna().distinct()
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    for i in range(n):
        block: list[tuple] = []
        size = 0
        for r in rows.filter(F.pmod(F.xxhash64("k"), F.lit(n)) == i).toLocalIterator():
            if block and size + len(r["t"]) > block_chars:
                yield block
                block, size = [], 0
            block.append((r["k"], r["t"]))
            size += len(r["t"])
        if block:
            yield block


_indexes: dict[str, ItemIndex] = {}


def worker_index(name: str, sent, window: int, max_edits: int) -> ItemIndex:
    """One index a Python worker and block; workers are used again."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = ItemIndex(sent.value, window, max_edits)
    return _indexes[name]


def decoded_parts(documents: DataFrame, doc_id: str, doc_text: str) -> DataFrame:
    """(id, ``parts``): the decoded text parts of each mail."""
    schema = T.StructType([T.StructField(doc_id, documents.schema[doc_id].dataType), T.StructField("parts", T.ArrayType(T.StringType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                parts = pa.array([text_parts(t) for t in part.column(1).to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), parts], names=schema.names)

    return documents.select(doc_id, doc_text).mapInArrow(run, schema)


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    window: int = 12,
    max_edits: int = 1,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, ``edits``) of each document with a passage of ``window``
    consecutive words of the item, changed by at most ``max_edits`` word edits,
    in one of its text parts; ``edits`` is the smallest number found.

    Documents are mails: parts are decoded as in ``mail.text_parts``. Each test
    item is searched in every document; there is no shuffle of documents, and
    items beyond a bounded block are searched in further passes over the parts,
    which are then decoded once. Null or empty
    texts and items shorter than a passage have no leak. Repeated documents
    have equal rows, which come once; equal items are each reported.
    """
    spark = documents.sparkSession
    schema = T.StructType([documents.schema[doc_id], items.schema[item_id], T.StructField("edits", T.IntegerType())])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    key_type = _arrow(items, item_id)
    blocks = _blocks(items, item_id, item_text, block_chars)
    first, second = next(blocks, []), next(blocks, None)
    source, decode = documents.select(doc_id, doc_text), True
    if second is not None:  # further blocks read the decoded parts, which are written once
        source, decode = cut_lineage(decoded_parts(documents, doc_id, doc_text)), False
    result = None
    for block in chain([first], [] if second is None else [second], blocks):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            index = worker_index(name, sent, window, max_edits)
            for batch in batches:
                places, keys, edits = [], [], []
                for i, held in enumerate(batch.column(1)):
                    best: dict[int, int] = {}
                    for part in text_parts(held.as_py()) if decode else held.as_py():
                        for n, d in index.search(part).items():
                            best[n] = min(d, best.get(n, d))
                    for n, d in best.items():
                        places.append(i)
                        keys.append(index.items[n][0])
                        edits.append(d)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array(keys, key_type), pa.array(edits, pa.int32())], names=schema.names)

        found = source.mapInArrow(run, schema)
        result = found if result is None else result.unionByName(found)
    return result.groupBy(doc_id, item_id).agg(F.min("edits").alias("edits"))


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
