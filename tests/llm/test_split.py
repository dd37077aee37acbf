from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm.split import pieces, split_texts
from tests.conftest import tuples


def check(text, limit, overlap):
    spans = pieces(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for a, b in spans:
        assert a < b <= a + limit or text == ""
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= overlap
    return spans


LINES = st.sampled_from(["# Head", "## Sub head", "2. Methods", "ABSTRACT", "Results:", "Title\n=====", "- item one two", "1. point", "| a | b |", "|---|---|", "```", "code line", "", "Some words. More words here! And so on", "x" * 70, "wörter ohne ende", "a\r\nb"])


@settings(max_examples=300, deadline=None)
@given(st.lists(LINES, max_size=40), st.integers(20, 120), st.integers(0, 15))
def test_pieces_tile_any_text(lines, limit, overlap):
    check("\n".join(lines), limit, overlap)


def test_long_texts_and_walls():
    check("A" * 1_000_000, 2500, 250)
    check("word " * 100_000, 2500, 250)
    check("\n".join("#" * (i % 6 + 1) + " h" for i in range(5000)), 2500, 250)


def test_natural_boundaries():
    section = lambda n: f"## Part {n}\n\n" + "This is a sentence of some length. " * 10 + "\n\n"
    text = "".join(section(i) for i in range(20))
    spans = check(text, 1000, 100)
    starts = [text[a:b] for a, b in spans[1:]]
    assert all(s.startswith(("This", "##")) for s in starts)
    ends = [text[:b].rstrip() for _, b in spans]
    assert all(e.endswith(".") for e in ends)


def test_rows(spark):
    long = "One two three. " * 20
    df = spark.createDataFrame([(1, long, 5), (2, None, 6), (3, "", 7), (4, "x" * 100, 8), (1, long, 5)], "k int, t string, piece int")
    out = split_texts(df, "t", limit=100, overlap=10)
    assert {r["k"] for r in out.collect()} == {1}
    whole = {}
    for a, b, p in set(tuples(out, "from_char", "to_char", "piece_text")):
        assert p == long[a:b]
        whole[a] = b
    assert min(whole) == 0 and max(whole.values()) == len(long)
    assert split_texts(df.limit(0), "t").count() == 0


def test_code_points(spark):
    text = "😀ü " * 60
    out = split_texts(spark.createDataFrame([(text,)], "t string"), "t", limit=50, overlap=5).orderBy("piece").collect()
    assert all(r["piece_text"] == text[r["from_char"] : r["to_char"]] for r in out) and out[-1]["to_char"] == len(text)
