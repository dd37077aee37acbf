import random

from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm.spans import shared_runs
from tests.conftest import tuples


def brute(docs, span):
    """Runs by comparing every window of every document with all others."""
    where = {}
    for d, t in docs:
        for s in range(len(t or "") - span + 1):
            where.setdefault(t[s : s + span], set()).add(d)
    out = []
    for d, t in {x for x in docs}:
        run = None
        for s in range(len(t or "") - span + 1):
            if len(where[t[s : s + span]]) > 1:
                if run and s <= run[1]:
                    run[1] = s + span
                else:
                    if run:
                        out.append((d, *run))
                    run = [s, s + span]
        if run:
            out.append((d, *run))
    return sorted(out)


def test_against_brute_force(spark):
    for seed in range(4):
        rng = random.Random(seed)
        text = lambda n: "".join(rng.choice("ab cd") for _ in range(n))
        base = [text(120) for _ in range(4)]
        docs = []
        for d in range(40):
            parts = []
            for _ in range(rng.randint(0, 4)):
                b = rng.choice(base)
                a = rng.randint(0, 60)
                parts += [b[a : a + rng.randint(10, 110)], text(rng.randint(0, 12))]
            docs.append((d, "".join(parts)))
        df = spark.createDataFrame(docs, "d long, t string")
        for k in (8, 20):
            assert tuples(shared_runs(df, "d", "t", span=30, k=k)) == brute(docs, 30)


def test_partner_of_part_of_a_shared_edge(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400))
    docs = [(1, long), (2, long), (3, "zz" + long[150:200] + "qq"), (4, "xx" + long[170:230]), (5, None), (6, ""), (7, "short")]
    df = spark.createDataFrame(docs, "d long, t string")
    assert tuples(shared_runs(df, "d", "t", span=40, k=20)) == brute(docs, 40)


def test_repeats_inside_one_document_do_not_count(spark):
    t = "abcdefghij klmnopqrst uvwxyz 0123456789 " * 10
    df = spark.createDataFrame([(1, t), (1, t)], "d long, t string")
    assert shared_runs(df, "d", "t", span=60, k=30).count() == 0
    runs = spark.createDataFrame([(1, "a" * 500), (2, "b" + "a" * 200)], "d long, t string")
    assert tuples(shared_runs(runs, "d", "t", span=60, k=30)) == [(1, 0, 500), (2, 1, 201)]
    assert shared_runs(df.limit(0), "d", "t").count() == 0


def test_hot_boilerplate_and_code_points(spark):
    rng = random.Random(2)
    note = "This notice stands in very many documents 😀 and is longer than the span that counts here."
    docs = [(d, "".join(rng.choice("abcdé") for _ in range(50)) + note) for d in range(300)]
    df = spark.createDataFrame(docs, "d long, t string")
    got = tuples(shared_runs(df, "d", "t", span=50, k=25))
    assert got == brute(docs, 50) and len(got) == 300


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=0, max_size=40), min_size=1, max_size=6))
def test_small_alphabets(spark, texts):
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "d long, t string")
    assert tuples(shared_runs(df, "d", "t", span=8, k=4)) == brute(docs, 8)
