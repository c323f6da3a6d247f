import re

import pytest
from helpers import MESSY, empty, messy
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and P.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text("a.@-é 1", max_size=30), st.text("0123456789.+ ()-", max_size=45), st.lists(st.sampled_from(["4111 1111 1111 1111", "1.2.3.256", "9.9.9.9", "+1 (555) 555-0100", "a@b.c", ".", " ", "0"]), max_size=6).map("".join)))
def test_base_spans_are_those_of_the_patterns(text):
    assert P.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    assert P.base_spans("a" * 200_000) == []
    assert P.base_spans("1" * 200_000) == []
    assert P.base_spans("+1" + "(" * 100_000) == []
    assert P.base_spans("a" * 100_000 + "@b.c") == [("email", 0, 100_004)]


def corpus(spark):
    rows = [(i, f"filler{i} falcon calls agent{i} at boss@corp.example.org about weather{i}") for i in range(4)]
    rows += [(10 + i, f"the weather{i} about town is common and agent{i} walks {i}") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_a_word_that_only_stands_near_an_entity_discloses_it(spark):
    rows = {r.doc_id: r for r in P.find_personal_data(corpus(spark)).collect()}
    text = {r.doc_id: r.text for r in corpus(spark).collect()}
    told = {text[d][s.start : s.end]: s.kind for d, r in rows.items() for s in r.added}
    assert told["falcon"] == "remove"
    assert "common" not in told and not any(w.startswith(("agent", "weather")) for w in told)
    clean = {r.doc_id: r.text for r in P.sanitise(corpus(spark)).collect()}
    assert "falcon" not in clean[0] and "<email>" in clean[0]
    assert clean[10] == text[10]


def test_a_name_far_from_the_address_is_taken_out_wherever_it_stands(spark):
    far = " ".join(f"of{k}" for k in range(100))
    rows = [(i, f"Dear Zebedee one{i} {far} two{i} write to me@home.example.org {far} as zebedee three{i}") for i in range(3)]
    rows += [(10 + i, f"{far} and {far} so on {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in P.sanitise(df).collect()}
    assert all("zebedee" not in clean[i].lower() and "<email>" in clean[i] and f"one{i}" in clean[i] and far in clean[i] for i in range(3))
    assert clean[10] == rows[3][1]


@pytest.mark.parametrize("joint, n, near, words, action", [(5, 5, 50, 10_000, "remove"), (4, 8, 50, 10_000, "generalise"), (4, 400, 50, 10_000, None)])
def test_shares_of_information(spark, joint, n, near, words, action):
    from pyspark.sql import functions as F

    rows = [("e", "t", i) for i in range(joint)] + [("e", f"o{i}", 0) for i in range(near - joint)]
    frame = spark.createDataFrame(rows, "entity string, term string, place long")
    counts = spark.createDataFrame([("t", n)], "term string, n long")
    got = P.disclosures(frame, counts, words).filter(F.col("term") == "t").collect()
    assert [r.action for r in got] == ([action] if action else [])


def test_nulls_repeats_and_clashing_columns(spark):
    rows = P.find_personal_data(messy(spark)).collect()
    assert len(rows) == len(MESSY)
    assert sorted((s.kind, s.start) for r in rows if r.doc_id == 5 for s in r.base) == [("email", 13), ("phone", 29)]
    assert all(not r.base and not r.added for r in rows if r.doc_id != 5)
    assert P.find_personal_data(empty(spark)).collect() == []
    assert P.sanitise(messy(spark)).columns == messy(spark).columns
    assert P.sanitise(messy(spark)).count() == len(MESSY)
