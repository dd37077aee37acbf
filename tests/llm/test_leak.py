import random

from skein.llm.leak import Index, leaks, lightest, overlap, words
from tests.conftest import tuples

FILL = "the sample was stored at some degrees and read by staff who did not see the group".split()
SHAPES = ["the {0} gradient collapses once {1} arrives", "{0} fibres survive {2} cycles without {1}", "a second {0} pulse erases {1} memory", "night feeding delays {0} release past {1}"]


def made(rng):
    noun = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    return "True or false: " + ", ".join(s.format(noun(), noun(), rng.randint(2, 99)) for s in rng.sample(SHAPES, 3)) + "?"


def corpus():
    rng = random.Random(9)
    items = [(i, made(rng)) for i in range(60)]
    fill = lambda n: " ".join(rng.choice(FILL) for _ in range(n))
    docs, want = [], set()
    for d, (i, t) in enumerate(items):
        w = t.split()
        k = len(w)
        kinds = {
            0: t.upper(), 1: " ".join(w[: k * 2 // 3]), 2: " ".join(w[k // 2 :]) + " " + fill(60) + " " + " ".join(w[: k // 2]),
            3: "<b>" + t.replace(" ", " <i>", 1).replace(" ", "</i> ", 2) + "</b>", 4: " ".join(x if j % 9 else "changed" for j, x in enumerate(w)), 5: t.replace(" ", "\n").replace("e", "e­", 2),
            6: " ".join(w[: k // 3]), 7: made(rng), 8: " ".join(rng.sample(w, k)), 9: "",
        }
        docs.append((d, fill(rng.randint(0, 200)) + " " + kinds[d % 10] + " " + fill(rng.randint(0, 200))))
        if d % 10 < 6:
            want.add((d, i))
    return docs, items, want


def test_against_all_pairs(spark):
    docs, items, want = corpus()
    index = Index([(i, words(t)) for i, t in items])
    plain = {(d, i) for d, t in docs for i, _ in items if overlap(index.words[i], words(t), index.weight[i])[0] >= 0.5}
    assert plain == want
    ddf, idf = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i long, t string")
    assert set(tuples(leaks(ddf, idf, "d", "t", "i", "t"), "d", "i")) == want
    assert set(tuples(leaks(ddf, idf, "d", "t", "i", "t", index_chars=3000), "d", "i")) == want


def test_nulls_empty_and_repeats(spark):
    docs, items, _ = corpus()
    ddf = spark.createDataFrame([docs[0], docs[0], (99, None), (98, ""), (None, docs[0][1])], "d long, t string")
    idf = spark.createDataFrame([*items, (200, None), (201, ""), items[0]], "i long, t string")
    assert tuples(leaks(ddf, idf, "d", "t", "i", "t"), "d", "i") == [(0, 0)]
    assert leaks(ddf.limit(0), idf, "d", "t", "i", "t").count() == 0
    assert leaks(ddf, idf.limit(0), "d", "t", "i", "t").count() == 0


def test_very_long_document(spark):
    docs, items, _ = corpus()
    text = " ".join(FILL * 20_000) + " " + items[3][1]
    out = leaks(spark.createDataFrame([(1, text)], "d long, t string"), spark.createDataFrame(items, "i long, t string"), "d", "t", "i", "t")
    assert tuples(out, "d", "i") == [(1, 3)]


def test_words():
    assert words("A&amp;B <b>bo</b>ld<br>x gra-\ndient “Q” ﬁne") == ["a", "b", "bold", "x", "gradient", "q", "fine"]
    assert words(None) == [] and words("") == []


def test_retrieval_against_all_scores():
    docs, items, _ = corpus()
    for block in (1, 3, 8, 100):
        index = Index([(i, words(t)) for i, t in items], block=block)
        for _, t in docs:
            terms = set(words(t)) & index.top.keys()
            for level in (0, 1):
                least = index.thresholds[level][0]
                every = {o for o, w in enumerate(index.weight) if sum(w[x] for x in terms if x in w) >= least[o]}
                near = {o for o in every if sum(index.weight[o][x] for x in terms if x in index.weight[o]) > least[o] + 1e-6}
                assert near <= set(index.retrieve(terms, level)) <= every


def test_long_items_and_bounds():
    rng = random.Random(1)
    own = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(30_000)]
    index = Index([(1, own), (2, own[:40])])  # quick, because its time grows with the words only
    assert index.candidates(own[7_000:23_000]) >= {0} and index.candidates(own[:25]) == {1}
    weight = {w: 1.0 + hash(w) % 7 for w in own}
    for size in (1, 2, 5, 30):
        assert abs(lightest(own[:60], weight, size) - min(sum(weight[w] for w in set(own[a : a + size])) for a in range(61 - size))) < 1e-9


def test_answers(spark):
    docs, items, _ = corpus()
    ddf = spark.createDataFrame([(1, items[0][1] + " Answer: B, as said."), (2, items[1][1] + " nothing else")], "d long, t string")
    idf = spark.createDataFrame([(i, t, "B") for i, t in items], "i long, t string, a string")
    out = leaks(ddf, idf, "d", "t", "i", "t", "a")
    assert tuples(out, "d", "i", "answer_held") == [(1, 0, True), (2, 1, False)] and all(r["overlap"] == 1.0 for r in out.collect())
