import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators import extraction as X
from skein.operators import graph as G
from skein.sources import files, papers
from skein.streaming import flows
from tests.conftest import tuples
from tests.test_graph import ROWS, STATEMENTS


def test_stream_equals_batch(spark, tmp_path):
    data = [(s, r, o, c, p, y, i, None, None, None, None, None) for i, (s, r, o, c, p, y) in enumerate(STATEMENTS + STATEMENTS[:3])]
    for k in range(3):
        spark.createDataFrame(data[k::3], ROWS).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    schema = spark.createDataFrame([], ROWS).schema
    stream = flows.landing(spark, str(tmp_path / "in" / "*"), schema, 1)
    flows.keep_relations(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    key = ("source", "type", "target", "support", "first_year")
    kept = tuples(G.relations(flows.read_relations(spark, str(tmp_path / "t"))), *key)
    assert kept == tuples(G.relations(G.relation_papers(G.insert_rows(spark.createDataFrame(data, ROWS)))), *key)
    flows.keep_relations(stream, str(tmp_path / "t"), str(tmp_path / "c2")).awaitTermination()
    assert tuples(G.relations(flows.read_relations(spark, str(tmp_path / "t"))), *key) == kept
    assert flows.read_relations(spark, str(tmp_path / "none")) is None
    (tmp_path / "broken" / "current").mkdir(parents=True)
    (tmp_path / "broken" / "current" / "part-0.json").write_text('{"bucket": 0, "version": 7}')
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        flows.read_relations(spark, str(tmp_path / "broken"))


def test_admissions_of_a_long_history(spark):
    t0, rng = datetime(2024, 1, 1), random.Random(2)
    rows, t = [], 0.0
    for i in range(3000):
        t += rng.choice([1, 5, 20, 70, 4000])
        rows.append(("hot" if i % 3 else None, t0 + timedelta(seconds=t), i))
    df = spark.createDataFrame(rows, "k string, ts timestamp, i int")
    got = {r["i"]: r["admitted"] for r in flows.admissions(df, "k", "ts", 60.0, 2, order="i").collect()}
    for key in ("hot", None):
        own = [r for r in rows if r[0] == key]
        want, _ = flows.admit([(r[1] - t0).total_seconds() for r in own], [], 60.0, 2)
        assert [got[r[2]] for r in own] == want


def test_admission(spark):
    assert flows.admit([0, 1, 2, 3, 60, 60.5, 61.5], [], 60, 3)[0] == [True, True, True, False, False, True, True]
    t0 = datetime(2024, 1, 1)
    times = [0, 1, 2, 3, 60, 60.5, 61.5, 500]
    df = spark.createDataFrame([("u", t0 + timedelta(seconds=s)) for s in times] + [("v", t0)], "k string, ts timestamp")
    got = flows.admissions(df, "k", "ts", 60.0, 3).orderBy("k", "ts").collect()
    assert [r["admitted"] for r in got] == [True, True, True, False, False, True, True, True, True]


def test_admission_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([("u", t0 + timedelta(seconds=s)) for s in (0, 1, 2, 3)], "k string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = flows.admission_stream(flows.landing(spark, str(tmp_path / "in"), df.schema), "k", "ts", 60.0, 3)
    out.writeStream.format("memory").queryName("admitted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert [r["admitted"] for r in spark.table("admitted").orderBy("ts").collect()] == [True, True, True, False]


def test_versioned_snapshot():
    now, version, built = [0.0], [1], []
    v = flows.Versioned(lambda: built.append(1) or len(built), lambda: version[0], 300, lambda: now[0])
    assert (v.get(), v.get()) == (1, 1)
    version[0] = 2
    assert v.get() == 2
    now[0] = 301.0
    assert v.get() == 3
    v.invalidate()
    assert v.get() == 4
    assert [flows.backoff(n) for n in (0, 1, 9)] == [2, 4, 60] and flows.backoff(0, 7) == 7


EPMC = {"resultList": {"result": [
    {"title": "A <i>b</i> &amp; c", "doi": "https://doi.org/10.1/X", "pmid": "1", "pubYear": "2020", "abstractText": "<p>t</p>", "journalTitle": "J", "authorString": "Aaa B."},
    {"title": "none"},
    {"title": "p", "pmcid": "PMC3", "fullTextUrlList": {"fullTextUrl": [{"documentStyle": "html", "url": "h"}, {"documentStyle": "pdf", "availability": "Free", "url": "u.pdf"}]}},
]}, "nextCursorMark": "*"}
PUBMED = """<S><PubmedArticle><MedlineCitation><PMID>9</PMID><Article><ArticleTitle>T <i>x</i></ArticleTitle><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>1999 Jan</MedlineDate></PubDate></JournalIssue></Journal>
<Abstract><AbstractText>one</AbstractText><AbstractText>two</AbstractText></Abstract><AuthorList>%s</AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pmc">PMC7</ArticleId></ArticleIdList></PubmedData></PubmedArticle></S>""" % (
    "<Author><LastName>Aaa</LastName><Initials>B</Initials></Author>" * 10
)
S2 = {"data": [{"title": "t", "externalIds": {"PubMedCentral": "5"}, "openAccessPdf": {"url": "p"}, "year": 2021, "authors": [{"name": "A B"}]}, {"title": "no pdf"}]}


def test_sources(spark, tmp_path):
    for name, pages in {"europe_pmc": [json.dumps(EPMC)], "pubmed": [json.dumps({"esearchresult": {"idlist": ["9"]}}), PUBMED], "semantic_scholar": [json.dumps(S2)]}.items():
        (tmp_path / name).mkdir()
        for i, p in enumerate(pages):
            (tmp_path / name / f"{i}").write_text(p)
    papers.register(spark)
    read = lambda n: {r["paper_id"]: r for r in papers.search(spark, n, "q", replay=str(tmp_path / n)).collect()}
    e = read("europe_pmc")
    assert set(e) == {"10.1/x", "PMC3"} and e["10.1/x"]["title"] == "A b & c" and e["10.1/x"]["year"] == 2020 and e["PMC3"]["pdf_url"] == "u.pdf"
    p = read("pubmed")["PMC7"]
    assert (p["title"], p["year"], p["abstract"], p["authors"].count("Aaa B")) == ("T x", 1999, "one two", 8)
    assert list(read("semantic_scholar")) == ["PMC5"]
    with pytest.raises(ValueError):
        papers.register(spark, "unknown")


def test_replay_of_several_queries_and_pages(spark, tmp_path):
    item = lambda i: {"title": f"t{i}", "doi": f"10.1/{i}", "abstractText": "x"}
    page = lambda ids, cursor: json.dumps({"resultList": {"result": [item(i) for i in ids]}, "nextCursorMark": cursor})
    for q, pages in enumerate([[page([1, 2], "b"), page([3], "b")], [page([4], "c"), page([5, 6], "d")]]):
        (tmp_path / str(q)).mkdir()
        for i, p in enumerate(pages):
            (tmp_path / str(q) / str(i)).write_text(p)
    assert tuples(papers.search(spark, "europe_pmc", "first\nsecond", limit=3, replay=str(tmp_path)), "doi") == [(f"10.1/{i}",) for i in range(1, 7)]


def test_limits_and_fallbacks():
    asked = []

    def fetch(url, params):
        asked.append((url, params))
        if "offset" in params and params["offset"]:
            raise papers.urllib.error.HTTPError(url, 500, "busy", {}, None)
        return json.dumps({"data": [{"paperId": str(i), "openAccessPdf": {"url": "u"} if i % 2 else None} for i in range(6)], "next": 6}).encode()

    assert len(list(papers.items(papers.SERVICES["semantic_scholar"], "q", 2, fetch))) == 2 and len(asked) == 1
    assert len(list(papers.items(papers.SERVICES["semantic_scholar"], "q", 20, fetch))) == 3  # an error after the first page ends it


def test_downloads(spark, tmp_path):
    df = spark.createDataFrame([("a/b", "good"), ("c", "bad"), ("d", None), ("e", "none"), ("f", "good")], "paper_id string, pdf_url string")
    (tmp_path / "f.pdf").write_bytes(b"%PDF" + b"x" * 2000)

    def fetch(url):
        if url == "none":
            raise OSError("gone")
        return b"%PDF-1" if url == "good" else b"<html>"

    got = {r["paper_id"]: (r["path"], r["problem"]) for r in papers.download_pdfs(df, str(tmp_path), fetch).collect()}
    assert got == {"a/b": (f"{tmp_path}/a_b.pdf", None), "c": (None, "no PDF"), "d": (None, "no address"), "e": (None, "not fetched: gone"), "f": (f"{tmp_path}/f.pdf", None)}
    assert (tmp_path / "a_b.pdf").read_bytes() == b"%PDF-1" and (tmp_path / "f.pdf").stat().st_size == 2004


def test_graph_object(spark, tmp_path):
    nodes = spark.createDataFrame([("b", "Food"), ("a", "Gene"), ("c", "Other")], "name string, type string")
    pairs = spark.createDataFrame([("b", "a", 2000), ("a", "c", None)], "u string, v string, year int")
    files.write_graph_object(nodes, pairs, str(tmp_path / "o"))
    (found,) = (tmp_path / "o").glob("part-*.json")
    assert json.loads(found.read_text()) == {"names": ["a", "b", "c"], "types": ["Gene", "Food", "Other"], "pairs": [[0, 2], [1, 0]], "years": [None, 2000]}
    n, p = files.read_graph_json(spark, str(found))
    assert tuples(n) == tuples(nodes) and {tuple(r) for r in p.collect()} == {("a", "c", None), ("b", "a", 2000)}


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "Gene"), ("b", "Food")], "name string, type string")
    pairs = spark.createDataFrame([("a", "b", 2000), ("b", "a", None)], "u string, v string, year int")
    files.write_graph_json(nodes, pairs, str(tmp_path / "g"))
    n, p = files.read_graph_json(spark, str(tmp_path / "g"))
    assert tuples(n) == tuples(nodes) and {tuple(r) for r in p.collect()} == {("a", "b", 2000), ("b", "a", None)}
    (tmp_path / "g.json").write_text(json.dumps({"names": ["a", "b"], "types": ["Gene", "Food"], "pairs": [[0, 1]], "years": [None]}))
    n, p = files.read_graph_json(spark, str(tmp_path / "g.json"))
    assert tuples(n) == tuples(nodes) and [tuple(r) for r in p.collect()] == [("a", "b", None)]


def test_text_files(spark, tmp_path):
    (tmp_path / "x.md").write_text("# a\n\nb")
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "y.pdf").write_bytes(b"no")
    assert tuples(files.read_markdown(spark, str(tmp_path))) == [("x", "# a\n\nb")]
    assert {r["path"][-5:]: r["problem"] for r in files.read_pdfs(spark, str(tmp_path)).collect()} == {"x.pdf": None, "y.pdf": "no PDF"}


def test_documents_and_margins(spark):
    page = lambda n: (600, 800, [{"x0": 20, "y0": 5, "x1": 580, "y1": 15, "text": f"Journal {n}"}, {"x0": 20, "y0": 100, "x1": 580, "y1": 120, "text": f"Body {n} doi 10.1234/ab."}])
    d = files.document([page(i) for i in range(3)])
    assert d["markdown"] == "\n\n".join(f"Body {i} doi 10.1234/ab." for i in range(3)) and d["doi"] == "10.1234/ab" and d["n_pages"] == 3
    blocks = spark.createDataFrame([("d", p, 800.0, b["y0"] * 1.0, b["y1"] * 1.0, b["text"]) for p in range(3) for b in page(p)[2]], "doc string, page int, height double, y0 double, y1 double, text string")
    assert tuples(X.repeated_margins(blocks)) == [("d", "journal #")]
    assert X.repeated_margins(blocks.where("page < 2")).count() == 0


def test_chat_history(spark):
    from skein.plans.retrieval import chat_history

    turns = spark.createDataFrame([("c", i, "system" if i == 9 else "user", "x" * 2000) for i in range(10)], "conv_id string, turn int, role string, content string")
    got = chat_history(turns)
    assert [r["turn"] for r in got.orderBy("turn").collect()] == [3, 4, 5, 6, 7, 8] and got.select(F.max(F.length("content"))).first()[0] == 1500


def test_admission_of_null_keys_and_times(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(None, t0, 1), (None, t0 + timedelta(seconds=1), 2), ("u", None, 3), ("u", t0, 4), ("u", t0, 5)], "k string, ts timestamp, i int")
    got = {r["i"]: r["admitted"] for r in flows.admissions(df, "k", "ts", 60.0, 1, order="i").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert flows.admissions(df.limit(0), "k", "ts").count() == 0
