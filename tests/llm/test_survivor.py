import itertools
import random

from pyspark.sql import functions as F

from skein.llm import queries as Q
from skein.llm.survivor import Bundle, survivors
from tests.conftest import tuples


def test_best_of_each_bundle(spark):
    data = [(1, "a", None, 2, 10), (1, "b", "x", 1, 5), (1, "c", None, 1, 9), (None, "n", "y", 3, 1), (1, "b", "x", 1, 5)]
    df = spark.createDataFrame(data, "g int, v string, w string, trust int, at int")
    bundles = [Bundle("v", ("v",), F.col("v").isNotNull(), (-F.col("trust"), F.col("at"))), Bundle("w", ("w",), F.col("w").isNotNull(), (-F.col("trust"),))]
    out = survivors(df, ["g"], bundles)
    assert {(r["g"], r["v"], r["w"]) for r in out.collect()} == {(1, "c", "x"), (None, "n", "y")}
    assert survivors(df.limit(0), ["g"], bundles).count() == 0


def test_branch_and_bound_against_enumeration(spark):
    rng = random.Random(7)
    data = [(g, rng.choice(["s1", "s2", None]), rng.choice(["z1", "z2", "z3", None]), rng.choice(["c1", "c2"]), rng.randint(1, 9), rng.randint(1, 9), rng.randint(1, 9)) for g in range(25) for _ in range(rng.randint(1, 9))]
    df = spark.createDataFrame(data, "g int, street string, zip string, city string, ts int, tz int, tc int")
    bundles = [Bundle(n, (n,), F.col(n).isNotNull(), (F.col(t),), F.col(t)) for n, t in (("street", "ts"), ("zip", "tz"), ("city", "tc"))]
    deps = (("street", "zip"), ("zip", "city"))
    got = {r["g"]: (r["street"], r["zip"], r["city"]) for r in survivors(df, ["g"], bundles, deps).collect()}
    for g in range(25):
        own = [r for r in data if r[0] == g]
        trust = [{v: max([r[4 + i] for r in own if r[1 + i] == v], default=0) for v in {r[1 + i] for r in own} - {None}} for i in range(3)]
        together = lambda c, i: None in c[i : i + 2] or any(r[1 + i : 3 + i] == c[i : i + 2] for r in own)
        allowed = [c for c in itertools.product(*[{None, *t} for t in trust]) if together(c, 0) and together(c, 1)]
        worth = lambda c: sum(trust[i].get(v, 0) for i, v in enumerate(c))
        assert got[g] in allowed and worth(got[g]) == max(map(worth, allowed))


RECORDS = "rec_id long, title string, doi string, pmid string, pmcid string, year int, abstract string, source string, fetched_at timestamp"


def test_paper_groups(spark):
    data = [
        (1, "A b", "10.1/X", None, None, 2000), (2, "c", "doi:10.1/x", "PMID: 5", None, 2001), (3, "d", None, "5", "PMC 7", 2001), (4, "e", "N/A", None, "pmc7", 0),
        (5, "<i>A</i> B.", "-", None, None, 2000), (6, "Untitled", "none", None, None, 2000), (7, "untitled.", None, None, None, 2000), (8, "A b", None, None, None, 9999), (9, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, None, None, None) for r in data], RECORDS)
    assert tuples(Q.paper_groups(df)) == [(i, 1) for i in (1, 2, 3, 4, 5)]


def test_stock_titles_by_years(spark):
    data = [(i, "Notes of the month", None, None, None, 2000 + i // 2) for i in range(10)]
    assert Q.paper_groups(spark.createDataFrame([(*r, None, None, None) for r in data], RECORDS)).count() == 0


def test_stock_titles_by_shares(spark):
    # One paper of many copies, some with a mistyped year; unrelated papers of one year; copies of which one has a slip.
    data = [(i, "A paper", None, None, None, 2000 if i < 20 else 1981 + i) for i in range(25)]
    data += [(30 + i, "Notes of the month", None, str(501 + i // 2) if i < 4 else None, f"PMC{i}" if 3 < i < 6 else None, 2000) for i in range(8)]
    data += [(40 + i, "Another paper", None, "700" if i else "701", None, 2000) for i in range(4)]
    got = tuples(Q.paper_groups(spark.createDataFrame([(*r, None, None, None) for r in data], RECORDS)))
    assert got == [(i, 0) for i in range(20)] + [(30, 30), (31, 30), (32, 32), (33, 32)] + [(40 + i, 40) for i in range(4)]


def test_bound_by_one_bundle_and_hot_group(spark):
    # b and c both depend on a; a value's trust may come from another record than the one it stands in with a.
    data = [(1, "a1", "b1", None, 1, 1, 0), (1, "a2", None, "c2", 5, 0, 1), (1, None, "b1", None, 0, 9, 0), (1, "a2", "b2", None, 1, 3, 0)]
    data += [(2, f"a{i % 3}", f"b{i % 5}", f"c{i % 7}", i % 4, i % 6, i % 8) for i in range(4000)]
    df = spark.createDataFrame(data, "g int, a string, b string, c string, ta int, tb int, tc int")
    bundles = [Bundle(n, (n,), F.col(n).isNotNull(), (), F.col(f"t{n}")) for n in "abc"]
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in survivors(df, ["g"], bundles, (("a", "b"), ("a", "c"))).collect()}
    assert got[1] == ("a1", "b1", None) or got[1] == (None, "b1", "c2")
    assert got == {r["g"]: (r["a"], r["b"], r["c"]) for r in survivors(df.unionByName(df), ["g"], bundles, (("a", "b"), ("a", "c"))).collect()}
    assert survivors(df.limit(0), ["g"], bundles, (("a", "b"),)).count() == 0


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "x", 2, "s")], "g int, v string, t int, c string")
    out = survivors(df.withColumn("sum", F.lit(1)).withColumn("m_v", F.lit(1)), ["g"], [Bundle("v", ("v", "c"), F.col("v").isNotNull(), (), F.col("t"))])
    assert [tuple(r) for r in out.collect()] == [(1, "x", "s")]
