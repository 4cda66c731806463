import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import bpe, chunking

pytestmark = pytest.mark.skipif(not os.path.exists(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"), reason="no vocabulary here")
DOCS = "doc_id long, text string, piece string"


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.rank_file())


def check(encoder, text, limit, overlap):
    """Pieces are under the limit, repeat the tokens before, and are the text."""
    ids = encoder.encode(text)
    pieces = chunking.Chunker(encoder, limit, overlap).pieces(text)
    end = 0
    whole = ""
    for n, (start, count, back, _, piece) in enumerate(pieces):
        assert count <= limit
        assert start + back == end and back == (min(overlap, end, limit - (count - back)) if n else 0)
        repeated = encoder.decode_bytes(ids[start:end]).decode(errors="ignore")
        assert piece.startswith(repeated)
        whole += piece[len(repeated) :]
        end = start + count
    assert end == len(ids) and whole == text
    return pieces


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n>已éx", max_size=400), st.integers(5, 40), st.integers(0, 4))
def test_any_text(encoder, text, limit, overlap):
    if text:
        check(encoder, text, limit, overlap)


def test_long_words_and_characters_of_several_tokens(encoder):
    check(encoder, "已完描片" * 900, 512, 64)
    check(encoder, "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo" * 400, 512, 64)
    check(encoder, "x" * 20_000 + " end", 512, 64)


def test_natural_boundaries_are_preferred(encoder):
    part = "One short sentence here. " * 8
    text = "\n\n".join([part] * 12)
    ids = encoder.encode(text)
    for start, count, _, _, _ in check(encoder, text, 150, 10)[:-1]:
        assert encoder.decode(ids[: start + count]).endswith("\n\n")
    message = "Hello there.\n" * 10 + "-----Original Message-----\n" + "Older text here.\n" * 10
    pieces = check(encoder, message, 60, 5)
    cuts = [len(encoder.decode(encoder.encode(message)[: s + n])) for s, n, *_ in pieces]
    assert message.index("-----Original") in cuts


MAIL = """From: a@b.c
Content-Type: multipart/mixed; boundary="xx"

--xx
Content-Type: text/plain

# Results
Intro line one. Second sentence here.
- first item with some words
  - nested item with words
- second item with words
## Details
More words in the details section, and more of them. And more.

Closing paragraph of the section.
-----Original Message-----
> On Monday X wrote:
> Quoted words go on and on here.
>> From: deeper
>> Date: today
>> Deeper words.
--xx
Content-Type: text/html

<h1>Title</h1><p>One block.</p><ul><li>alpha<li>beta</ul>
--xx--
"""


def test_the_tree_of_a_mail():
    levels: dict[int, int] = {}
    for place, level in zip(*(a.tolist() for a in chunking.boundaries(MAIL))):
        levels[place] = max(level, levels.get(place, 0))
    kinds = {p: next(n for low, n in reversed(chunking.KINDS) if level >= low) for p, level in levels.items()}
    at = lambda s: kinds.get(MAIL.index(s))
    assert [at(s) for s in ("--xx\n", "# Results", "- first", "  - nested", "## Details", "Closing", "-----Orig", "> On Monday", "<h1>", "<ul>", "<li>beta", " Second sentence")] == ["part", "heading", "item", "item", "heading", "paragraph", "message", "message", "heading", "paragraph", "item", "sentence"]
    assert levels[MAIL.index("# Results")] > levels[MAIL.index("## Details")] > levels[MAIL.index("Closing")]
    assert levels[MAIL.index("- first")] > levels[MAIL.index("  - nested")]


def test_pieces_are_whole_siblings():
    """A piece that begins below some boundary doesn't run over it: all boundaries
    inside a piece of several nodes are no higher than those at its ends."""
    rng = np.random.default_rng(7)
    for _ in range(200):
        n = int(rng.integers(2, 120))
        counts, levels = rng.integers(1, 9, n), rng.integers(0, 6, n)
        for a, b in chunking.pack(counts, levels, 20, 25):
            inside = levels[a + 1 : b].max(initial=-1)
            assert inside <= (levels[a] if a else 9) and inside <= (levels[b] if b < n else 9)


def test_pieces_encode_within_the_limit(encoder):
    rng = np.random.default_rng(3)
    words = ["word", "Größe", "2024-05-01", "x@y.org", "已完", "re:", "--", "ab" * 40]
    for _ in range(20):
        text = "".join(str(rng.choice(words)) + str(rng.choice([" ", " ", ". ", "\n", "\n\n", "\n> "])) for _ in range(1500))
        for *_, piece in check(encoder, text, 512, 64):
            assert len(encoder.encode(piece)) <= 512


def test_pack_is_whole_and_within_the_limit():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 200))
        counts, levels = rng.integers(1, 9, n), rng.integers(0, 6, n)
        ranges = chunking.pack(counts, levels, 20, 25)
        assert [r[0] for r in ranges] == [0, *[r[1] for r in ranges[:-1]]] and ranges[-1][1] == n
        assert all(counts[a:b].sum() <= (20 if a else 25) for a, b in ranges)


def test_table(spark):
    rows = [(1, None, ""), (2, "", ""), (3, "short", ""), (4, "word " * 2000, ""), (4, "word " * 2000, "")]
    df = spark.createDataFrame(rows, DOCS)
    got = chunking.split_documents(df).toPandas()
    assert sorted(got.doc_id.unique()) == [3, 4]
    assert list(got[got.doc_id == 3].piece) == ["short"]
    assert (got.n_tokens <= 512).all() and (got[got.piece_no > 0].overlap_tokens == 64).all()
    assert got[got.doc_id == 4].groupby("piece_no").size().eq(2).all()
    assert chunking.split_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chunking.split_documents(df, limit=10, overlap=10)
