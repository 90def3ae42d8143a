"""Formats of phones and dates, and what stands next to them."""

import re

from tests.llm.test_llm import docs_of
from vitrina.llm import pii


def changed(spark, texts):
    rows = pii.pseudonymise(docs_of(spark, texts), "key").orderBy("doc_id").collect()
    return [r.text for r in rows], [r.n_private for r in rows]


def shape(text):
    return re.sub(r"\d", "9", text)


def test_formats_are_replaced_and_linked(spark):
    texts = [
        "at 2024-01-05T10:00:00Z done", "on 2024-01-05, done", "born 12/25/1999.", "born 25/12/1999.", "call 5551234567 now",
        "call 555-123-4567 now", "call +49 30 1234567.", "call +49301234567.", "call +49 (30) 123-4567.", "call +33 1 23 45 67 89",
        "call +15551234567 now",
    ]
    got, counts = changed(spark, texts)
    assert counts == [1] * len(texts) and all(a != b and shape(a) == shape(b) for a, b in zip(texts, got))
    assert got[0][3:13] == got[1][3:13] and got[0].endswith("T10:00:00Z done")
    month, day, year = got[2][5:15].split("/")
    assert got[3][5:15] == f"{day}/{month}/{year}"
    digits = [re.sub(r"\D", "", text) for text in got]
    assert digits[4] == digits[5] == digits[10][1:] and digits[10][0] == "1"
    assert digits[6] == digits[7] == digits[8] and digits[6].startswith("49") and digits[9].startswith("33")


def test_neighbours_hide_none(spark):
    card, texts = "4111 1111 1111 1111", []
    for other in ("2024-01-05T10:00:00Z", "5551234567", "+49 30 1234567", "12/25/1999"):
        texts += [f"{other} {card}", f"{card} {other}"]
    got, counts = changed(spark, [*texts, card])
    plain = got.pop()
    assert counts == [2] * len(texts) + [1] and plain != card and all(plain in text for text in got)
    assert all(other not in text for text, other in zip(got, (t.replace(card, "").strip() for t in texts)))


def test_others_stay(spark):
    texts = [
        "seconds 1700000000 since", "32/13/1999", "13/32/1999", "2024-13-05T10:00:00Z", "a+49 30 1234567", "sum +49 30 12", "id x5551234567",
        "55512345678", "2024-01-05Tea",
    ]
    assert changed(spark, texts) == (texts, [0] * len(texts))


def test_world_numbers_are_permuted(spark):
    texts = [f"+44{k:06d}" for k in range(3000)]
    got, _ = changed(spark, texts)
    assert len(set(got)) == len(texts) and all(re.fullmatch(r"\+44\d{6}", text) for text in got)
