import random
import time

import numpy as np

from skein.llm.truncated import BANDS, PREFIX_BANDS, Bands, Hashes, _scan, align, shingles, truncated, words

SENTENCES = [f"Sample {i} of the group was read by method {i % 7} and gave a value of {i * 3}." for i in range(40)]
FULL = [" ".join(SENTENCES[i : i + 8]) for i in range(0, 32)]


def reasons(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    return {r["k"]: r["reason"] for r in truncated(df, "k", "t").collect()}


def test_reasons(spark):
    whole = FULL[0]
    texts = [*FULL, *[f"{t} Keywords: one, two" for t in FULL[:6]], whole + " The samp", whole + " Sample [truncated]", whole + " Sample &am", "<p>" + whole + "</p>", whole[:-20], whole + " (c) The Press.", None, "", "   ", whole[:-1] + "…", "Untergang"]
    got = reasons(spark, texts)
    n = len(FULL)
    assert all(got[i] is None for i in range(n + 6))
    assert got[n + 6] == "copy" and got[n + 7] == "copy" and got[n + 8] in ("markup", "copy") and got[n + 9] is None
    assert got[n + 10] == "copy" and got[n + 11] is None and got[n + 15] in ("marked", "copy") and got[n + 16] == "closing"
    assert not {n + 12, n + 13, n + 14} & set(got)


def test_alignment():
    text = " ".join(SENTENCES[:12])
    cut = text[: text.index("Sample 11 of") + 30]
    assert align(cut, text) == "cut"
    assert align(" ".join(SENTENCES[:10]), text) == "whole"
    assert align(" ".join(SENTENCES[:3]), text) == "whole"
    words = text.split()
    slip = [*words[:60], "slip", *words[61:70]]
    assert align(" ".join(slip), text) == "cut"  # one changed word among the last ones
    assert align(" ".join([*words[:70], words[70][:2]]), text) == "cut" and align(text, text) == "near"
    assert align(" ".join(reversed(words)), text) is None and align("a " * 5000, "a " * 9000) == "cut"
    assert align(text[:-15].rstrip(), text) == "cut"
    assert align("other words that are not there at all.", text) is None


def test_whole_sentences_are_no_cut(spark):
    text = " ".join(SENTENCES[:12])
    got = reasons(spark, [text, " ".join(SENTENCES[:11])])
    assert got == {0: None, 1: None}


def test_empty_repeats_and_hot_copies(spark):
    df = spark.createDataFrame([], "k long, t string")
    assert truncated(df, "k", "t").count() == 0
    text = " ".join(SENTENCES[:12])
    got = reasons(spark, [text] * 200 + [text[:-9]] * 200)
    assert all(got[i] is None for i in range(200)) and all(got[i] == "copy" for i in range(200, 400))


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, FULL[0], "x", True)], "k long, body string, plain string, cut boolean")
    assert truncated(df, "k", "body").columns == ["k", "cut", "reason"]


def sentence(rng):
    return " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(rng.randint(8, 14))).capitalize() + "."


def test_recall_of_copies_by_share_kept(spark):
    rng = random.Random(4)
    whole = [" ".join(sentence(rng) for _ in range(12)) for _ in range(60)]
    texts, cuts = list(whole), {}
    for i, t in enumerate(whole):
        share = rng.choice([0.95, 0.8, 0.65, 0.5, 0.4, 0.3])
        part = t[: int(share * len(t))]
        while part[-1] in " ." or t[len(part)] in " .":
            part = part[:-1]
        if i % 3 == 0:  # a slip, now and then near the end
            words = part.split()
            words[rng.choice([-3, -9, len(words) // 2])] = "slip"
            part = " ".join(words)
        cuts[len(texts)] = share
        texts.append(part)
        texts.append(t + " " + sentence(rng))  # longer than the text that it was cut from
    got = reasons(spark, texts)
    assert sum(got[k] == "copy" for k in cuts) >= 0.9 * len(cuts)
    assert all(got[k] is None for k in range(len(whole)))


def test_longest_text_of_a_bucket_is_no_copy(spark):
    rng = random.Random(8)
    opening = " ".join(sentence(rng) for _ in range(4))
    full = opening + " " + " ".join(sentence(rng) for _ in range(8))
    others = [opening + " " + " ".join(sentence(rng) for _ in range(20 + i)) for i in range(9)]  # begin alike and are longer
    part = full[: int(0.8 * len(full))].rsplit(" ", 1)[0].rstrip(".") + " bad"
    part = part.rsplit(" ", 1)[0]
    got = reasons(spark, [*others, full, part])
    assert got[10] == "copy" and all(got[i] is None for i in range(10))


def test_closing_words_with_a_full_stop(spark):
    rng = random.Random(2)
    texts = [f"{sentence(rng)} It was seen by Doe et al. in {i}.{i} of the samples. {sentence(rng)}" for i in range(40)]
    cut = [f"{sentence(rng)} {sentence(rng)[:-1]} by Doe et al.", f"{sentence(rng)} {sentence(rng)[:-1]} in 24."]
    got = reasons(spark, texts + cut)
    assert all(got[i] is None for i in range(40)) and got[40] == got[41] == "closing"


def test_bands_of_many_texts_at_once_are_those_of_each(spark):
    rng = random.Random(5)
    texts = [" ".join(str(rng.randint(0, 30)) for _ in range(n)) for n in (1, 2, 4, 5, 15, 16, 17, 31, 32, 33, 300, 64, 3)]
    taken = [words(t) for t in texts]
    s, n = shingles(taken, Hashes())
    buckets, place, asks = Bands().of(s, n)
    for i, t in enumerate(taken):
        one, m = shingles([t], Hashes())
        alone, _, asking = Bands().of(one, m)
        assert m[0] == n[i] == max(1, len(t) - 4) and np.array_equal(one, s[n[:i].sum() :][: n[i]])
        assert sorted(zip(alone, asking)) == sorted(zip(buckets[place == i], asks[place == i]))
        levels = sum(16 << k <= len(t) for k in range(9))
        assert len(alone) == BANDS + PREFIX_BANDS * levels and asking.sum() == BANDS + PREFIX_BANDS * (levels > 0)
    assert words("Σ_a·b İ x-1 中文 É.") == [x.encode() for x in ("σ", "a", "b", "i", "x", "1", "中文", "é")]


def test_one_long_word_takes_no_square_time(spark):
    df = spark.createDataFrame([(1, "a" * 60_000 + " B."), (2, "It ends. 2.5 (3.1 of. A")], "k long, body string")
    began = time.monotonic()
    rows = _scan(df).where("kind = 1").collect()
    assert time.monotonic() - began < 15 and [sum(r[x] for r in rows) for x in "bc"] == [4, 14]
