"""Numbers in a phone number's place: lists and counts stay, grouped numbers go."""

import random

import pytest

from auricle.llm import pii


def test_number_lists_stay(spark):
    r = random.Random(1)
    phone = lambda: f"+1 {r.randrange(200, 999)} {r.randrange(200, 999)} {r.randrange(1000, 9999)}"
    lists = ["1234567", "2024 2025 2026", "10 20 30 40", "192 168 1 1", "1999 2004 2016"]
    grouped = ["555 0123 987", "(415) 555-0199", "030 1234 5678", "01 42 68 53 00", "4155550123"]
    texts = [f"please call {phone()} today" for _ in range(40)] + [f"please call {x} today" for x in lists + grouped]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][s.start : s.stop] for s in r.all_spans if s.kind == 4] for r in pii.find_personal_data(spark, docs).collect()}
    assert [found[40 + i] for i in range(len(lists))] == [[]] * len(lists)
    assert [found[45 + i] for i in range(len(grouped))] == [[x] for x in grouped]
    kept = {r.doc_id: r.text for r in pii.redact_personal_data(spark, docs).collect()}
    assert [kept[40 + i] for i in range(len(lists))] == texts[40:45]


@pytest.mark.parametrize(("number", "want"), [("1 2 3", True), ("5 10 15", True), ("2001 1998 2020", True), ("020 7946 0958", False), ("+44 20 7946 0958", False), ("4111 1111 1111 1112", False), ("12 34", False), ("90 80 70", True), ("1234567", True), ("0000000", True), ("4432087", False)])
def test_number_list(number, want):
    assert pii.number_list(number) is want
