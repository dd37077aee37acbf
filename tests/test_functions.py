import hashlib
import random

from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.functions import text as T
from tests.conftest import tuples


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_identifiers(spark):
    assert column(spark, ["https://doi.org/10.1/X", "DOI: 10.1/x", "", None], S.normalize_doi) == ["10.1/x", "10.1/x", None, None]


def test_paper_id_order(spark):
    rows = [("10.1/A", "pmc1", "2", "t"), (None, "pmc1", "2", "t"), ("", "", "2", "t"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "d string, c string, m string, t string")
    got = [r[0] for r in df.select(S.paper_id(F.col("d"), F.col("c"), F.col("m"), F.col("t"))).collect()]
    assert got == ["10.1/a", "PMC1", "PMID:2", "hash:" + hashlib.sha1(b"").hexdigest()[:16]]


def test_names(spark):
    assert column(spark, ["The  NF-κB_x ", "(IL-6)", "Alzheimer’s disease", None, "a"], S.normalize_name) == ["nf-kappab x", "il-6", "alzheimer's disease", None, "a"]
    assert column(spark, ["alzheimer's-disease", "il 6"], S.match_key) == ["alzheimers disease", "il 6"]
    assert column(spark, ["inhibits", "Binds to", "Up-regulates", "x" * 41, "novel one", None], S.normalize_relation) == ["INHIBITS", "BINDS", "UPREGULATES", "ASSOCIATED_WITH", "NOVEL_ONE", ""]
    assert column(spark, ["gene", "PROTEIN", "thing", None], S.normalize_type) == ["Gene", "Protein", "Other", "Other"]
    assert column(spark, ["ok", "x", "results", "12-3", "y" * 81], S.valid_entity) == [True, False, False, False, False]


def test_merge_guards(spark):
    pairs = [("il-6", "il-8"), ("tnf alpha", "tnf alpha receptor"), ("ros", "rose"), ("flavanols", "flavanol")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(S.merge_blocked(F.col("a"), F.col("b"))).collect()] == [True, True, True, False]


def test_years_and_measures(spark):
    assert column(spark, ["2020-01", "1800", "2200", "abcd", None, "1999"], S.clean_year) == [2020, None, None, None, None, 1999]
    one = spark.range(1)
    r = one.select(S.edge_strength(F.lit(0.9), F.lit(1)), S.edge_cost(F.lit(0.9), F.lit(1)), S.edge_strength(F.lit(0.5), F.lit(3)), S.edge_cost(F.lit(0.5), F.lit(3))).first()
    assert [round(x, 3) for x in r] == [0.9, 0.155, 1.049, 0.322]


def test_json_answers(spark):
    raw = ['```json\n{"triplets": [{"subject": "a"}]}\n```', 'Sure: {"triplets": []} done', "none", None]
    got = column(spark, raw, lambda c: S.parse_payload(c, "struct<triplets:array<struct<subject:string>>>"))
    assert got[0]["triplets"][0]["subject"] == "a" and got[1]["triplets"] == [] and got[2] is None and got[3] is None


def test_clean_text(spark):
    raw = "1\nIntro\n\nThis inhibi-\ntion [1, 2] was (Smith et al., 2020) seen at https://x.y today .\n# Methods\nWe did a@b.cd it.\n12\n"
    long = "Text line here.\n" * 10 + "References\nGone.\n"
    got = column(spark, [raw, long, None, "", "\r\n \r", "x", "  ﬁne\u00a0words\u2028in  lines"], T.clean_text)
    assert got[0] == "Intro\n\nThis inhibition was seen at today.\n\n# Methods\n\nWe did it."
    assert "Gone" not in got[1] and got[2:] == [None, "", "", "", "fine words in lines"]
    assert "Gone" in column(spark, [long], lambda c: T.clean_text(c, strip_references=False))[0]
    assert column(spark, ["12", "ab", "# a", "", "1.2 (3.4) 5", "a real line", "x"], T.is_noise) == [True, True, False, False, True, False, True]


def test_sections(spark):
    texts = ["Lead.\n\n## 2. Results\n\nFound it.\n\nMore.\n\nReferences\n\nNo.\n\nDiscussion\n\nNo.", "Methods:\nBelow the name.\n\nEnd.", "", None, "Abstract\n\nResults", "No heading"]
    got = [x if x is None else [tuple(r) for r in x] for x in column(spark, texts, T.split_sections)]
    assert got == [[("body", "Lead."), ("results", "Found it.\n\nMore.")], [("methods", "Below the name.\n\nEnd.")], [], None, [], [("body", "No heading")]]


def test_chunks(spark):
    small = lambda c: T.chunk(c, limit=18, overlap=9)
    assert column(spark, ["Aaa bbb. Ccc ddd. Eee fff.", "", "Aaa. Aaa. Aaa.", "y" * 40], small) == [["Aaa bbb. Ccc ddd.", "Ccc ddd. Eee fff."], [], ["Aaa. Aaa. Aaa."], ["y" * 18, "y" * 18, "y" * 4]]
    many = "\n\n".join(f"{n}\n\n" + "Word and more words here. " * 10 for n in ("Methods", "Abstract"))
    assert [c["section"] for c in column(spark, [many], T.build_chunks(most=1))[0]] == ["abstract"]
    every = column(spark, [many, None, "short"], T.build_chunks())
    assert [(c["index"], c["section"]) for c in every[0]] == [(0, "methods"), (1, "abstract")] and every[1] is None and every[2] == []


def test_chunks_against_plain_search(spark):
    rng = random.Random(3)
    texts = [" ".join(("Word" + "x" * rng.randint(0, 30)) + "." for _ in range(rng.randint(1, 40))) for _ in range(30)]
    for text, got in zip(texts, column(spark, texts, lambda c: T.chunk(c, limit=90, overlap=30))):
        words, want, a = text.split(" "), [], 0
        size = lambda x: sum(len(w) + 1 for w in x)
        for i in range(len(words)):
            if i > a and size(words[a : i + 1]) > 90:
                want.append(" ".join(words[a:i]))
                a = next(j for j in range(a, i + 1) if size(words[j:i]) <= 31)
        assert got == [*want, " ".join(words[a:])]


def test_supporting_sentence(spark):
    text = "Cocoa is sweet. Curcumin inhibits NF-kB in cells."
    rows = [("curcumin  inhibits", text, "a", "b"), ("", text, "curcumin", "nf-kb"), (None, text, "zinc", "gold"), ("x", None, "a", "b")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, t string, a string, b string")
    got = [r["o"] for r in df.select("i", T.find_snippet("s", "t", "a", "b").alias("o")).orderBy("i").collect()]
    assert got == ["curcumin inhibits", "Curcumin inhibits NF-kB in cells.", "", ""]


def test_markup(spark):
    assert column(spark, ["A <i>b</i> &amp; c", None, " &lt;x&gt; ", "a<br>b"], T.strip_markup) == ["A b & c", "", "<x>", "a b"]


def test_highlight_and_snippet(spark):
    assert T.highlight("a cocoa <b> cocoa butter", ["cocoa", "cocoa butter"]) == 'a <mark data-entity="cocoa">cocoa</mark> &lt;b&gt; <mark data-entity="cocoa butter">cocoa butter</mark>'
    text = "x" * 300 + " cocoa " + "y" * 300
    df = spark.createDataFrame([(text, ["cocoa"])], "t string, w array<string>")
    got = df.select(S.snippet_around(F.col("t"), F.col("w"))).first()[0]
    assert got.startswith("…") and got.endswith("…") and "cocoa" in got and len(got) <= 282


def test_jaro_winkler():
    assert round(T.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert T.jaro_winkler("", "a") == 0.0 and T.jaro_winkler("a", "a") == 1.0


def test_reading_order():
    block = lambda x0, y0, x1, t: {"x0": x0, "y0": y0, "x1": x1, "y1": y0 + 10, "text": t}
    blocks = [block(320, 50, 580, "right"), block(20, 60, 280, "left"), block(20, 10, 580, "title"), block(20, 200, 580, "bar"), block(20, 220, 280, "left 2"), block(320, 215, 580, "right 2")]
    assert [b["text"] for b in T.order_blocks(blocks, 600)] == ["title", "left", "right", "bar", "left 2", "right 2"]
    assert T.block_markdown("Mate-\nrials and methods:") == "## Materials And Methods"


def test_split_values_stay(spark):
    df = spark.createDataFrame([("a", None)], "t string, u string")
    assert tuples(df.select(T.clean_text("u").alias("c"))) == [(None,)]
