import base64
import quopri
import random

import pytest

from conftest import rows
from pathloom.llm import leakage
from pathloom.llm.mail import text_parts

DOCS = "doc_id long, text string, edits int"
ITEMS = "item_id long, text string"
RNG = random.Random(5)
VOCABULARY = ["w%03d" % i for i in range(400)]
ITEM = [" ".join(RNG.choice(VOCABULARY) for _ in range(60)) for _ in range(6)]


def leaked(word_lists, item, n):
    runs = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
    return any(tuple(w[i : i + n]) in runs for w in word_lists for i in range(len(w) - n + 1))


def encoded(text, kind):
    head = "From: a@b\nContent-Type: {}; charset=utf-8\nContent-Transfer-Encoding: {}\n\n"
    if kind == "base64":
        return head.format("text/plain", "base64") + base64.encodebytes(text.encode()).decode()
    if kind == "qp":
        return head.format("text/plain", "quoted-printable") + quopri.encodestring(text.encode()).decode()
    if kind == "html":
        return head.format("text/html", "8bit") + "<p>" + text.replace(" ", " <b>", 3).replace(" w", "&#32;w") + "</p>"
    return text


@pytest.mark.parametrize("kind", ["plain", "base64", "qp", "html"])
def test_parts_are_decoded(spark, kind):
    passage = " ".join(ITEM[0].split()[10:22])
    df = spark.createDataFrame([(1, encoded("Grüße, " + passage + " bye", kind), 0)], DOCS)
    items = spark.createDataFrame(list(enumerate(ITEM)), ITEMS)
    assert rows(leakage.find_leaks(df, items)) == [(1, 0, 0)]


def test_multipart_digest_and_attachments():
    mail = (
        'From: a\nContent-Type: multipart/mixed; boundary="=_x"\n\npreamble\n--=_x\nContent-Type: text/plain\n\none\n'
        "--=_x\nContent-Type: application/octet-stream\nContent-Transfer-Encoding: base64\n\nb25l\n"
        "--=_x\nContent-Type: message/rfc822\n\nFrom: b\nContent-Type: text/html\n\n<style>p{}</style>tw<b>o</b><br>three &amp; four\n--=_x--\nend"
    )
    assert [p.split() for p in text_parts(mail)] == [["one"], ["two", "three", "&", "four"]]
    assert text_parts("") == text_parts(None) == []
    assert text_parts("no headers here") == ["no headers here"]
    assert [p.strip() for p in text_parts("From: a\nContent-Type: multipart/mixed\n\nno boundary")] == ["no boundary"]


def test_parts_nested_to_any_depth(spark):
    passage, depth = " ".join(ITEM[1].split()[3:16]), 300
    mail = "From: a\n\n" + passage
    for _ in range(depth):
        mail = "From: b\nContent-Type: message/rfc822\n\n" + mail
    for i in range(60):
        mail = f'From: c\nContent-Type: multipart/mixed; boundary="b{i}"\n\n--b{i}\n{mail}\n--b{i}--\n'
    assert [p.strip() for p in text_parts(mail)] == [passage]
    assert rows(leakage.find_leaks(spark.createDataFrame([(1, mail, 0)], DOCS), spark.createDataFrame(list(enumerate(ITEM)), ITEMS))) == [(1, 1, 0)]


def test_myers_equals_dynamic_programming():
    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    rng = random.Random(2)
    for _ in range(400):
        p, t = [rng.randint(0, 3) for _ in range(rng.randint(1, 15))], [rng.randint(0, 3) for _ in range(rng.randint(0, 30))]
        assert leakage.myers_best(p, t) == plain(p, t)


def test_against_brute_force(spark):
    rng = random.Random(9)
    docs = []
    for i in range(150):
        words = [rng.choice(VOCABULARY) for _ in range(30)]
        item = ITEM[rng.randrange(6)].split()
        at, n = rng.randrange(40), rng.choice([5, 10, 11, 12, 13, 20])
        part = item[at : at + n]
        if rng.random() < 0.3 and len(part) > 6:
            part[len(part) // 2] = "changed"
        docs.append((i, " ".join(words[:10] + part + words[10:]), 0))
    df, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(list(enumerate(ITEM)), ITEMS)
    want = sorted(((i, k) for i, t, _ in docs for k, item in enumerate(ITEM) if leaked([leakage.words(t)], item.split(), 12)), key=repr)
    found = leakage.find_leaks(df, items)
    assert rows(found.filter("edits = 0").select("doc_id", "item_id")) == want
    one_off = " ".join(ITEM[2].split()[5:17][:6] + ["zz"] + ITEM[2].split()[5:17][7:])
    assert rows(leakage.find_leaks(spark.createDataFrame([(1, one_off, 0)], DOCS), items)) == [(1, 2, 1)]


def test_edges(spark):
    items = spark.createDataFrame([(1, ITEM[0]), (2, ITEM[0]), (3, "too short"), (4, None), (None, ITEM[1]), (5, "")], ITEMS)
    docs = spark.createDataFrame([(1, ITEM[0], 0), (1, ITEM[0], 0), (2, None, 0), (3, "", 0), (4, "x " * 100_000 + ITEM[0], 0)], DOCS)
    want = [(1, 1, 0), (1, 2, 0), (4, 1, 0), (4, 2, 0)]
    assert rows(leakage.find_leaks(docs, items)) == want
    assert rows(leakage.find_leaks(docs, items, block_chars=300)) == want
    assert leakage.find_leaks(docs.limit(0), items).count() == 0
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0
