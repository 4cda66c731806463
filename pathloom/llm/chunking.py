"""Long mails in pieces under a token limit, cut at natural boundaries.

A mail's structure is parsed to a tree: MIME parts hold messages (quoted ones
inside those that quote them), messages hold sections under headings,
paragraphs and HTML blocks, list items (deeper ones inside shallower), lines,
sentences, words and tokens. The tree is kept as a level for each place between
two tokens: a node is a longest stretch without a boundary of its level or
above. Packing is bottom-up: whole siblings are merged while they fit; only a
node over the limit is opened, and its leftovers stay in it. Each later piece
begins with the last tokens of the one before, and its own tokens fill what is
left of the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pathloom.llm.bpe import DEFAULT_VOCABULARY, TOKENIZER_DIR, Encoder, rank_file, worker_encoder

LIMIT, OVERLAP = 512, 64
#: Levels of a boundary, lowest first. Those with several tiers are nested: the
#: first tier is the outermost, and the highest.
TOKEN, WORD, SENTENCE, LINE = range(4)
ITEM, ITEM_TIERS = 4, 4
PARAGRAPH = ITEM + ITEM_TIERS
HEADING, HEADING_TIERS = PARAGRAPH + 1, 6
MESSAGE, MESSAGE_TIERS = HEADING + HEADING_TIERS, 5
PART, PART_TIERS = MESSAGE + MESSAGE_TIERS, 4
KINDS = [(TOKEN, "token"), (WORD, "word"), (SENTENCE, "sentence"), (LINE, "line"), (ITEM, "item"), (PARAGRAPH, "paragraph"), (HEADING, "heading"), (MESSAGE, "message"), (PART, "part")]
_LOWEST, _NAMES = np.array([low for low, _ in KINDS]), np.array([name for _, name in KINDS])

_SENTENCE = re.compile(r"[.!?…][\"'”’)\]]*(?=\s)|[。！？]")
_PARAGRAPH = re.compile(r"\n(?:[>|: \t\r]*\n)+")
_BLOCK_END = re.compile(r"</(?:p|div|ul|ol|table|blockquote|pre|h[1-6])>", re.I)
_BLOCK_LINE = re.compile(r"<br ?/?>|</t[dh]>", re.I)
_BLOCK_ITEM = re.compile(r"<(?:li|tr|dt)\b", re.I)
_BLOCK_HEADING = re.compile(r"<h([1-6])\b", re.I)
_QUOTE = r"[>| \t]*"
#: List items (bullets, numbers, letters) and headings (marked or underlined) of plain text.
_ITEM = re.compile(rf"^({_QUOTE})(?:[-*+•–]|\(?(?:\d{{1,3}}|[a-zA-Z])[.)])[ \t]+(?=\S)", re.M)
_HASHES = re.compile(rf"^{_QUOTE}(#{{1,6}})[ \t]+\S", re.M)
_UNDERLINED = re.compile(rf"^{_QUOTE}[^\s>|][^\n]{{0,98}}\n{_QUOTE}(=|-)\2{{2,}}[ \t]*\r?$".replace(r"\2", r"\1"), re.M)
#: Lines that begin a message: separators, attributions, quoted headers.
_MESSAGE = re.compile(
    r"^(?:[-_=*> |]*(?:original message|forwarded message|urspr[^\n]{1,3}ngliche nachricht|weitergeleitete nachricht)[-_=* ]*\r?$"
    r"|[> |]*(?:from|von): [^\n]*(?=\n[> |]*(?:sent|date|to|gesendet|datum|an|subject|betreff):)"
    r"|[> |]*(?:on|am|le) [^\n]*(?:wrote|schrieb|écrit)[^\n]*:\r?$)",
    re.I | re.M,
)
_BOUNDARY = re.compile(r"boundary=(?:\"([^\"\n]+)\"|([^\s;]+))", re.I)


def _tier(base: int, tiers: int, depth: int) -> int:
    return base + tiers - 1 - min(depth, tiers - 1)


def _marks(text: str) -> Iterator[tuple[int, Iterable[int]]]:
    """(level, character places) of the text's boundaries; a place may come under several levels."""
    yield SENTENCE, [m.end() for m in _SENTENCE.finditer(text)]
    plain = text.isascii()
    yield LINE, np.flatnonzero(np.frombuffer(text.encode("ascii" if plain else "utf-32-le", "surrogatepass"), np.uint8 if plain else np.uint32) == 10) + 1
    for m in _ITEM.finditer(text):
        yield _tier(ITEM, ITEM_TIERS, len(m[1].replace("\t", "    ").replace(">", "").replace("|", "")) // 2), [m.start()]
    yield PARAGRAPH, [m.end() for m in _PARAGRAPH.finditer(text)]
    for m in _HASHES.finditer(text) if "#" in text else ():
        yield _tier(HEADING, HEADING_TIERS, len(m[1]) - 1), [m.start()]
    for m in _UNDERLINED.finditer(text) if "===" in text or "---" in text else ():
        yield _tier(HEADING, HEADING_TIERS, 0 if m[1] == "=" else 1), [m.start()]
    if "<" in text:
        yield LINE, [m.end() for m in _BLOCK_LINE.finditer(text)]
        yield _tier(ITEM, ITEM_TIERS, 0), [m.start() for m in _BLOCK_ITEM.finditer(text)]
        yield PARAGRAPH, [m.end() for m in _BLOCK_END.finditer(text)]
        for m in _BLOCK_HEADING.finditer(text):
            yield _tier(HEADING, HEADING_TIERS, int(m[1]) - 1), [m.start()]
    for m in _MESSAGE.finditer(text):
        quoted = len(m[0]) - len(m[0].lstrip("> |\t"))
        yield _tier(MESSAGE, MESSAGE_TIERS, m[0][:quoted].count(">")), [m.start()]
    for depth, name in enumerate(dict.fromkeys(a or b for a, b in _BOUNDARY.findall(text)) if "oundary=" in text or "OUNDARY=" in text else ()):
        line = re.compile(rf"^--{re.escape(name)}", re.M)
        yield _tier(PART, PART_TIERS, depth), [m.start() for m in line.finditer(text)]


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character places and the levels of the boundaries before them; words and
    tokens have no entry, and a place may have several."""
    levels, places = zip(*((level, np.asarray(at, np.int64)) for level, at in _marks(text)))
    return np.concatenate(places), np.repeat(levels, list(map(len, places)))


def pack(counts: np.ndarray, levels: np.ndarray, limit: int, first_limit: int) -> list[tuple[int, int]]:
    """Ranges of units that together are all of them, each of at most ``limit``
    tokens (the one from 0: ``first_limit``), or a single unit. counts: tokens of
    each unit; levels: of the boundary before each unit. A range is one node, or
    whole siblings.
    """
    ends = np.concatenate(([0], np.cumsum(counts)))
    n = len(counts)

    def room(lo: int) -> int:
        return limit if lo else first_limit

    out: list[tuple[int, int]] = []
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo == 1 or ends[hi] - ends[lo] <= room(lo):
            out.append((lo, hi))
            continue
        inner = levels[lo + 1 : hi]
        cuts = np.concatenate(([lo], lo + 1 + np.flatnonzero(inner == inner.max()), [hi]))
        at = ends[cuts]
        k, last, made = 0, len(cuts) - 1, []
        while k < last:
            # As many whole children from here as fit; a child over the limit alone, to be opened.
            upto = int(np.searchsorted(at, at[k] + room(int(cuts[k])), side="right")) - 1
            upto = max(upto, k + 1)
            made.append((int(cuts[k]), int(cuts[upto])))
            k = upto
        todo += reversed(made)
    return out


def _kinds(levels: np.ndarray) -> list[str]:
    return _NAMES[np.searchsorted(_LOWEST, levels, side="right") - 1].tolist()


class Chunker:
    def __init__(self, encoder: Encoder, limit: int, overlap: int):
        self.encoder, self.limit, self.overlap = encoder, limit, overlap
        self.strings = encoder.strings

    def pieces(self, text: str) -> list[tuple[int, int, int, str | None, str]]:
        """(first token, tokens, tokens repeated, kind of the boundary it begins
        at, text) of each piece, in order."""
        words = self.encoder.pieces(text)
        found = list(map(self.encoder.counts.__getitem__, words))
        total = sum(found)
        if total <= self.limit:
            return [(0, total, 0, None, text)]
        counts = np.array(found, np.int64)
        starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
        levels = np.full(len(words), WORD, np.int64)
        places, values = boundaries(text)
        at = np.searchsorted(starts[:-1], places)
        inside = at < len(words)
        np.maximum.at(levels, at[inside], values[inside])
        fresh = self.limit - self.overlap
        parts: dict[int, list[int]] = {}  # ids of the units that are parts of a word
        if counts.max() > fresh:
            counts, levels, words, starts, parts = self._parted(counts, levels, words, fresh)
        ends = np.concatenate(([0], np.cumsum(counts)))
        packed = pack(counts, levels, fresh, self.limit)
        kinds = _kinds(levels[[lo for lo, _ in packed]])
        at = [0, *[hi for _, hi in packed]]
        first, place = dict(zip(at, ends[at].tolist())), dict(zip(at, starts[at].tolist()))  # of each cut: its token and its character
        out = []
        for n, (lo, hi) in enumerate(packed):
            own = first[hi] - first[lo]
            back = min(self.overlap, first[lo], max(0, self.limit - own)) if n else 0
            repeated = self._before(text, words, parts, ends, starts, lo, back)
            out.append((first[lo] - back, own + back, back, kinds[n] if n else None, repeated + text[place[lo] : place[hi]]))
        return out

    def _before(self, text: str, words: list[str], parts: dict[int, list[int]], ends: np.ndarray, chars: np.ndarray, lo: int, back: int) -> str:
        """The text of the ``back`` tokens before unit ``lo``, without the bytes
        of a character that began earlier."""
        begin = int(ends[lo]) - back
        at = max(0, lo - back)  # a unit has a token at least
        at += int(np.searchsorted(ends[at : lo + 1], begin, side="right")) - 1
        inside = begin - int(ends[at])
        if not inside:
            return text[chars[at] : chars[lo]]
        ids = parts[at] if at in parts else self.encoder.memo[words[at]]
        part = self.encoder.decode_bytes(ids[inside:]).decode(errors="ignore")
        return part + text[chars[at + 1] : chars[lo]]

    def _parted(self, counts: np.ndarray, levels: np.ndarray, words: list[str], most: int):
        """Words over the limit, such as encoded attachments, as runs of whole
        characters; the units' counts, levels, texts and character places, and
        the ids of those that are parts."""
        new: tuple[list, list, list] = [], [], []
        parts: dict[int, list[int]] = {}
        for count, level, word in zip(counts.tolist(), levels.tolist(), words):
            if count <= most:
                for column, value in zip(new, (count, level, word)):
                    column.append(value)
                continue
            ids, cuts = self.encoder.memo[word], [0]
            for i in range(1, len(ids)):
                if i - cuts[-1] >= most // 4 and self.strings[ids[i]][0] & 0xC0 != 0x80:
                    cuts.append(i)
            for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], count])):
                if len(cuts) > 1:
                    parts[len(new[0])] = ids[a:b]
                for column, value in zip(new, (b - a, TOKEN if k else level, word if len(cuts) == 1 else self.encoder.decode(ids[a:b]))):
                    column.append(value)
        starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, new[2]), np.int64, len(new[2])))))
        return np.array(new[0]), np.array(new[1]), new[2], starts, parts


def split_documents(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    vocabulary: str = DEFAULT_VOCABULARY,
    folder: str = TOKENIZER_DIR,
) -> DataFrame:
    """The pieces of each text, in order: id, ``piece_no`` from 0,
    ``start_token`` in the text's ids, ``n_tokens`` (at most ``limit``),
    ``overlap_tokens`` (the last ``overlap`` of the piece before; 0 in the
    first), ``cut`` (the kind of the boundary that its own tokens begin at; null
    in the first) and ``piece``, its text.

    Without the repeated tokens the pieces are the text, whole and in order.
    Cuts are at part, message, section, paragraph, item, line or sentence ends
    where there are any, else between words, else between characters: a piece
    is one node of the tree or whole siblings. A text within the limit is one
    piece; a null or empty text has none. Where one character takes more tokens
    than the limit leaves beside the overlap, its piece repeats fewer. Where the repeated tokens begin
    inside a character, its bytes are left out of ``piece``. Repeated rows give
    repeated pieces; other columns are ignored. No shuffle.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than the limit")
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(vocabulary, folder))
    numbers = ["piece_no", "start_token", "n_tokens", "overlap_tokens"]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(n, T.IntegerType()) for n in numbers], T.StructField("cut", T.StringType()), T.StructField("piece", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker(worker_encoder(ranks.value), limit, overlap)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                places, rows = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    if text:
                        for n, piece in enumerate(chunker.pieces(text)):
                            places.append(i)
                            rows.append((n, *piece))
                columns = list(zip(*rows)) or [()] * 6
                arrays = [part.column(0).take(pa.array(places, pa.int64())), *[pa.array(c, pa.int32()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)
