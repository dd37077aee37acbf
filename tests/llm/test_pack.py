import os
import random

import numpy as np
import pytest

from skein.llm import queries as Q
from skein.llm.pack import _Counts, best_fit, fill_containers, load_encoding, token_count
from tests.conftest import tuples

TOKENIZER = f"{Q.TOKENIZERS}/byte_bpe_50k.tiktoken"
needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")


def test_best_fit_against_plain_search():
    rng = random.Random(1)
    for _ in range(50):
        sizes = np.array([rng.randint(1, 40) for _ in range(rng.randint(1, 60))])
        bins, fill = best_fit(sizes, 40)
        assert (np.bincount(bins, sizes) == fill).all() and fill.max() <= 40
        rooms = []
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
            if fits:
                rooms[min(fits)[1]] -= s
            else:
                rooms.append(40 - s)
        assert len(rooms) == len(fill)


@pytest.mark.parametrize(("per_task", "waste"), [(10, 1.1), (100_000, 1.02)])  # ten items a task leave best fit little choice
def test_every_item_whole_in_one_container(spark, per_task, waste):
    rng = random.Random(2)
    data = [(i, rng.randint(1, 60) if i % 50 else rng.randint(101, 450)) for i in range(1, 801)] + [(900, 0), (901, 100), (902, None), (None, 5)]
    out = fill_containers(spark.createDataFrame(data, "k long, n int"), "k", "n", capacity=100, per_task=per_task).collect()
    by_item, by_bin = {}, {}
    for r in out:
        by_item.setdefault(r["k"], []).append((r["part"], r["from_unit"], r["to_unit"]))
        by_bin.setdefault(r["container"], []).append((r["to_unit"] - r["from_unit"], r["fill"]))
    want = {k: max(n, 1) for k, n in data if k is not None and n is not None}
    assert set(by_item) == set(want)
    for k, parts in by_item.items():
        parts.sort()
        assert parts[0][1] == 0 and parts[-1][2] == want[k] and all(a[2] == b[1] for a, b in zip(parts, parts[1:]))
        assert len(parts) == -(-want[k] // 100)
    for members in by_bin.values():
        assert sum(n for n, _ in members) == members[0][1] <= 100
    assert len(by_bin) <= waste * sum(want.values()) / 100 + 2


def test_items_that_never_share(spark):
    out = fill_containers(spark.createDataFrame([(i, 60) for i in range(500)], "k long, n int"), "k", "n", capacity=100, per_task=50)
    assert out.select("container").distinct().count() == 500
    assert fill_containers(spark.createDataFrame([], "k long, n int"), "k", "n").count() == 0


@needs_tokenizer
def test_token_counts_equal_the_tokenizer(spark):
    enc = load_encoding(TOKENIZER)
    counts = _Counts(enc)
    rng = random.Random(4)
    parts = ["word", " ", "  ", "\n", "\n\n", "\t", "µ", "don't", "3.14", "ünï", "A", "😀", ".", "x" * 50, " \n ", " "]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert counts.of(t) == len(enc.encode_ordinary(t)), repr(t)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "two words")], "k int, t string")
    assert tuples(df.select("k", token_count(df["t"], TOKENIZER).alias("n"))) == [(1, None), (2, 0), (3, 2)]
