from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from entitylake.functions import markup
from entitylake.functions import text as X
from entitylake.functions.binding import keep_if, let, record


def values(spark, expression, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.x for r in df.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_name_key(spark):
    cases = {
        "The Beatles": "beatles", "AC/DC": "acdc", "Björk": "bjrk", "椎名林檎": "",
        "Earth, Wind & Fire": "earth wind  fire", "The The": "the", "A-ha": "aha",
        " The X": "the x", "An  Horse": "horse", "THEM": "them", None: None,
    }
    assert values(spark, X.name_key, list(cases)) == list(cases.values())


def test_variant_key(spark):
    cases = {
        "Foo (live) bar": "foobar", "Help! (2009 remaster)": "help!", "(Intro)": "", " A ": "a",
        "X (a) (b)": "x", "Open (paren": "open (paren", "A (x) B": "ab", "N (a\nb)": "n (a\nb)",
    }
    assert values(spark, X.variant_key, list(cases)) == list(cases.values())


def test_label_key(spark):
    assert values(spark, X.label_key, [" Original Members "]) == ["original_members"]


def test_strip_knows_all_white_space(spark):
    assert values(spark, X.strip, [" \t a b　\n", "\x1fx\x1c", "", None]) == ["a b", "x", "", None]
    assert values(spark, X.squeeze, ["a  \n b "]) == ["a b"]


def test_tokens(spark):
    got = values(spark, X.tokens, ["The U2, r.e.m. AND-metal_rock 1990's", "", "a b", None])
    assert got == [["the", "and", "metal", "rock", "1990"], [], [], None]


def test_words(spark):
    got = values(spark, X.words, ["R.E.M. isn't U2 Björk—椎名!", "..."])
    assert got == [["r.e.m", "isn't", "u2", "björk", "椎名"], []]


@pytest.mark.parametrize("text", ["", "x", "b a b c b a", "z " * 500 + "y " * 3])
def test_term_counts_equal_a_counter(spark, text):
    got = values(spark, lambda v: X.term_counts(F.filter(F.split(v, " "), lambda t: t != "")), [text])[0]
    assert {r.term: r.tf for r in got} == Counter(text.split())


def test_clock(spark):
    assert values(spark, X.clock_seconds, ["3:45", "1:02:03", "?:??", "", "0:07", "x1:10", None]) == [225, 62, None, None, 7, None, None]
    assert values(spark, X.clock_text, [225.0, 0.0, None, 59.9, 3600.5], "double") == ["3:45", "?", "?", "0:59", "60:00"]


def test_match_groups(spark):
    def groups(v):
        return X.match_groups(v, r"(?s)<(a)\s+x=\"(\d)\">(?:\((no|ok)\))?.*?</\1>", 3)

    assert values(spark, groups, ['..<a x="1">(ok) </a><a x="2"></a>', '<a x="7">\n</a>', "none"]) == [
        ["a", "1", "ok"], ["a", "7", ""], None,
    ]


def test_groups_beyond_nine(spark):
    pattern = "".join(f"(.)" for _ in range(12))
    assert values(spark, lambda v: X.match_groups(v, pattern, 12), ["abcdefghijkl"]) == [list("abcdefghijkl")]


def test_literal_words_are_not_patterns(spark):
    words = ["a.b", "c+", "(x)", "d-e", "$", "^"]
    assert values(spark, lambda v: X.contains_any(v, words), ["azb", "a.b", "c+", "(x)", "d-e", "a$", "plain"]) == [
        False, True, True, True, True, True, False,
    ]
    assert values(spark, lambda v: X.starts_with_any(v, ["{{", "|"]), ["{{a", "|x", "a{{", ""]) == [True, True, False, False]


def test_long_junk_does_not_exhaust_the_stack(spark):
    n = 200_000
    assert len(values(spark, X.words, ["a." * n + "b"])[0][0]) == 2 * n + 1
    assert values(spark, lambda v: F.size(X.tokens(v)), ["ab " * n + "abc"]) == [1]
    box = "{{Infobox x\n| genre = " + "y" * n + "\n}}"
    field = markup.infobox_fields(F.lit(box), whole_templates=True)
    assert spark.range(1).select(F.length(field["genre"][0]).alias("n")).first().n == n


def test_count_of(spark):
    assert values(spark, lambda v: X.count_of(v, "{{"), ["{{a}} {{b", "{{{", ""]) == [2, 1, 0]


def test_let_evaluates_once(spark):
    # The value is random: two evaluations would differ.
    x = let(F.rand(), lambda v: v - v)
    assert {r.d for r in spark.range(50).select(x.alias("d")).collect()} == {0.0}


def test_keep_if_keeps_names_and_drops_rows(spark):
    df = spark.range(4).select(keep_if(record(a=F.col("id"), b=F.col("id") * 2), lambda r: r["b"] > 2))
    assert df.columns == ["a", "b"] and [tuple(r) for r in df.collect()] == [(2, 4), (3, 6)]
