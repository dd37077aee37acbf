from skein.llm import abstracts as A
from skein.llm.components import components
from tests.conftest import tuples
from tests.test_functions import column


def test_identifiers(spark):
    assert column(spark, ["10.1/AB.c", "doi:10.1/x", "https://r.example/10.91/y.v2", "N/A", "", None], A.doi) == ["10.1/ab.c", "10.1/x", "10.91/y.v2", None, None, None]
    assert column(spark, ["PMC12", "pmc 12", " 12", "null", "-", None, "12.0"], A.pmcid) == ["PMC12", "PMC12", "PMC12", None, None, None, "PMC12"]
    assert column(spark, ["PMID: 7", "0", "7", "x", None], A.pmid) == ["7", None, "7", None, None]


def test_titles(spark):
    assert column(spark, ["A <i>b</i>: C.", "a B, c", "...", None], A.title_key) == ["abc", "abc", None, None]


def test_own_text(spark):
    texts = ["<p>A  b.</p>", "A b. (c) The Press.", "A b. Copyright by X; all rights reserved. This article is protected by copyright.", "A b...", "A &amp; b [truncated]", "A cut wo Published under an open licence by Y.", None, ""]
    assert column(spark, texts, A.own_text) == ["Ab.", "Ab.", "Ab.", "Ab", "A&b", "Acutwo", None, ""]


def test_notices_of_any_number_and_length(spark):
    many = "A b. " + "Further reproduction prohibited. " * 20 + "[truncated] All rights reserved."
    long = "A b. Copyright 2020 by J. Smith, see www.press.example/a.b for " + "terms and " * 100 + "more."
    got = column(spark, [many, long, "A b … © 2020 P. Q. Press. (truncated)", "© Press", "This work is long. It ends here."], A.own_text)
    assert got == ["Ab.", "Ab.", "Ab", "", "Thisworkislong.Itendshere."]


def test_components(spark):
    links = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "d"), (6, "d"), (6, "d"), (7, None), (None, "a")]
    assert tuples(components(spark.createDataFrame(links, "node long, key string"))) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    chain = [(i, str(k)) for i in range(1, 120) for k in (i, i + 1)]
    assert {r["component"] for r in components(spark.createDataFrame(chain, "node long, key string")).collect()} == {1}
    assert components(spark.createDataFrame([], "node long, key string")).count() == 0
