import itertools
import random

from skein.llm.names import _candidates, _nodes, agree, lcs_ratio, parse, subsequence_keys, variant_pairs, variants
from tests.conftest import tuples

PERSON = ["Hufuhenaze LM", "Lena-Maria Hufuhenaze", "lena-maria hufuhenaze", "Hufuhenaze, Lena-Maria", "HUFUHENAZE LM", "L. M. Hufuhenaze", "Hufuhenaez LM", "Hufuhenaze, L. M.", "Lena Maria Hufuhenaze", "Hufuhenaze Lena-Maria", "Lena-Maria Hufuhen4ze MD"]
OTHER = ["Hufuhenaze H", "Harald Hufuhenaze", "Hufuhenaze, Harald"]
BOB = ["Gazaguyufo RB", "Robert B. Gazaguyufo", "Bob B. Gazaguyufo", 'Gazaguyufo, Robert "Bob"', "de Gazaguyufo, Robert B.", "deGazaguyufo, R. B."]
GROUP = ["Northern Ageing Cohort Consortium", "Northern Aging Cohort Consortium", "Consortium Northern Ageing Cohort", "The Northern Ageing Cohort Consort."]
HELP = ["Harald B. Xxxxxx", "Lena-Maria C. Yyyyyy", "Robert D. Zzzzzz"]


def found(spark, names):
    return {tuple(sorted(p)) for p in tuples(variant_pairs(variants(spark.createDataFrame([(n,) for n in names], "name string"), "name")))}


def test_clusters(spark):
    want = {tuple(sorted(p)) for c in (PERSON, OTHER, BOB, GROUP) for p in itertools.combinations(c, 2)}
    assert found(spark, PERSON + OTHER + BOB + GROUP + HELP) == want


def test_ambiguous_initial_links_none(spark):
    names = ["Fuzadupolu TA", "Timothy A. Fuzadupolu", "Fuzadupolu TC", "Thomas C. Fuzadupolu", "Fuzadupolu T"]
    assert found(spark, names) == {("Fuzadupolu TA", "Timothy A. Fuzadupolu"), ("Fuzadupolu TC", "Thomas C. Fuzadupolu")}


def test_titles_and_initials():
    assert parse("William Ziyuroduje MD")["family"] == "" and parse("William Ziyuroduje MD")["words"] == "William Ziyuroduje"
    assert parse("Yuvozilifi MD")["initials"] == "MD" and parse("Subejoreza JR")["initials"] == "JR"
    assert parse("KIZA TITIZA E") | {} == parse("Kiza-Titiza E") | {}
    assert parse("M. B. Kovokizoso")["initials"] == "MB" and parse("VAN RODINEZELO VC")["family"] == "rodinezelo"


def test_nulls_empty_and_odd_values(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("?",), ("A",), ("x" * 5000,), ("A",)], "name string")
    out = variants(df, "name")
    assert {r["name"] for r in out.collect()} == {"?", "A", "x" * 5000}
    assert variants(df.limit(0), "name").count() == 0


def test_typos_in_many_families(spark):
    rng = random.Random(3)
    syllables = [c + v for c in "bdfghjklmnprstvwyz" for v in "aeiou"]
    names, want = [], set()
    for i in range(120):
        family = "".join(rng.sample(syllables, 5)).capitalize()
        k = rng.randrange(1, 9)
        typo = rng.choice([family[:k] + family[k + 1 :], family[:k] + family[k + 1] + family[k] + family[k + 2 :], family[:k] + family[k] + family[k:]])
        initial = chr(65 + i % 26)
        pair = sorted({f"{family} {initial}", f"{typo}, {initial}."})
        names += pair
        want.add(tuple(pair))
    assert want == found(spark, names)


def test_common_suffixes_get_longer(spark):
    names = [f"Ab{i:04d}cdefgh".translate(str.maketrans("0123456789", "klmnopqrst")) + " A" for i in range(60)]
    df = spark.createDataFrame([(n,) for n in [*names, names[7].replace("cdef", "cdfe")]], "name string")
    linked = variant_pairs(variants(df, "name", most=10))
    assert tuple(sorted((names[7], names[7].replace("cdef", "cdfe")))) in set(tuples(linked))


def test_ratio():
    assert lcs_ratio("abcd", "abdc") == 0.75 and lcs_ratio("", "a") == 0.0 and lcs_ratio("abc", "abc") == 1.0


def test_keys_against_brute_force():
    rng = random.Random(11)
    for ratio in (0.8, 0.9):
        near = 0
        for _ in range(20000):
            letters = rng.choice(["ab", "abcde", "abcdefghijklmnopqrstuvwxyz"])
            a = "".join(rng.choice(letters) for _ in range(rng.randint(3, 10)))
            b = a
            for _ in range(rng.randint(1, 4)):
                i = rng.randrange(len(b) + 1)
                b = b[:i] + rng.choice(["", rng.choice(letters)]) + b[i + rng.randint(0, 1) :]
            if lcs_ratio(a, b) >= ratio:
                near += 1
                assert subsequence_keys(a, ratio) & subsequence_keys(b, ratio), (a, b)
        assert near > 2000
    a, b = "abcdefghijklmnopqrstuvwxyz" * 2, "bcdefgijklmopqrstuvwxyza" * 2
    assert lcs_ratio(a, b) >= 0.9 and subsequence_keys(a, 0.9) & subsequence_keys(b, 0.9)


def test_slips_wherever_they_stand(spark):
    pairs = [("Johanson A", "Johansson A"), ("Petersen B", "Peterssen B"), ("Smith C", "Smyth C"), ("Meier D", "Meyer D"), ("Kolobefto, Isabella H.", "Kotobefeto, Isabella")]
    assert found(spark, [n for p in pairs for n in p]) == set(pairs)


def test_every_pair_of_near_families(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(3, 10))).capitalize() + " A" for _ in range(150)})
    family = lambda n: n.split()[0].lower()
    near = [(a, b) for a, b in itertools.combinations(names, 2) if lcs_ratio(family(a), family(b)) >= 0.8]
    for most in (200, 2):
        entity = {r["name"]: r["entity"] for r in variants(spark.createDataFrame([(n,) for n in names], "name string"), "name", most=most).collect()}
        assert near and all(entity[a] == entity[b] for a, b in near)


def test_given_names_of_other_initials_and_common_blocks(spark):
    names = ["Catherine Xuvofabe", "Xuvofabe, Katherine", "Daniel Xuvofabe", "Xuvofabe, M. Brigitte", "Brigitte Xuvofabe", "Xuvofabe, Norman", "Xuvofabe, Daniel"]
    want = {("Catherine Xuvofabe", "Xuvofabe, Katherine"), ("Daniel Xuvofabe", "Xuvofabe, Daniel"), ("Brigitte Xuvofabe", "Xuvofabe, M. Brigitte")}
    common = [f"Ab{i:04d}cdefgh".translate(str.maketrans("0123456789", "klmnopqrst")) + " A" for i in range(60)]
    slip = (common[7], common[7].replace("k", "x", 1).replace("fg", "gf"))  # near, but of neither one beginning nor one end
    assert lcs_ratio(*(n.split()[0].lower() for n in slip)) >= 0.8
    for most in (200, 10):
        entity = {r["name"]: r["entity"] for r in variants(spark.createDataFrame([(n,) for n in [*names, *common, slip[1]]], "name string"), "name", most=most).collect()}
        assert entity[slip[0]] == entity[slip[1]]
        assert {tuple(sorted(p)) for p in itertools.combinations(names, 2) if entity[p[0]] == entity[p[1]]} == want


def test_candidates_are_all_that_agree_and_few_of_a_hot_family(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    givens = sorted({"".join(rng.choice("bdfglmnrstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))).capitalize() for _ in range(300)})
    names = [f"Hotfamily, {'L' + g.lower()}" for g in givens] + [f"Hotfamily, {'L' + g.lower()} {rng.choice('ABC')}." for g in givens]
    names += ["Hotfamily L", "Hotfamily LA", "Hotfamily LAB", "Hotfamely LB", "Hotfamily", "Catherine Hotfamily", "Katherine Hotfamily", "Bob Hotfamily", "Robert A. Hotfamely", "Hotfamily RA", "The Hot Group", "Hot Group"]
    nodes = _nodes(spark.createDataFrame([(n,) for n in names], "name string"), "name").withColumn("node", F.xxhash64("family", "given", "initials")).drop("name").distinct()
    rows = nodes.collect()
    met = set(tuples(_candidates(nodes, 50)))
    parts = lambda r: (r["family"], r["given"], r["initials"], r["formal"])
    want = {tuple(sorted((a["node"], b["node"]))) for a, b in itertools.combinations(rows, 2) if a["family"] and b["family"] and agree(*parts(a), *parts(b))}
    assert want <= met and len(met) < 40 * len(rows)


def test_short_forms_learned_from_who_bears_them(spark):
    rng = random.Random(12)
    family = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(5)).capitalize()
    names, want = [], set()
    for i in range(80):
        f, m = family(), "BCDE"[i % 4]
        first, second = ("Quorvin", "Zat") if i < 6 else (family(), family())
        pair = (f"{first} {m}. {f}", f"{second} {m}. {f}")
        names += pair
        if i < 6:
            want.add(tuple(sorted(pair)))
    # The first pair of names is met six times, each of the others once.
    assert found(spark, names) == want
