import pytest

from skein.operators.packed import ESCAPE, MARK, STOP, unpack_rows
from tests.conftest import tuples

CASES = {
    "Aaa BC, Ddd E.": ["Aaa BC", "Ddd E"],
    "Aaaa, B. C., de Ddd, E., & Fff-Ggg, H. I.": ["Aaaa, B. C.", "de Ddd, E.", "Fff-Ggg, H. I."],
    "Aaaa, Bbbb C.; Dddd, Eeee": ["Aaaa, Bbbb C.", "Dddd, Eeee"],
    "Anna B. Cccc, Dddd Eeee, F. Gggg and Hhhh Iiii MD": ["Anna B. Cccc", "Dddd Eeee", "F. Gggg", "Hhhh Iiii MD"],
    '"Aaaa, Bbb ""Bee""", Ccc DE , "Ffff, Ggg"': ['Aaaa, Bbb "Bee"', "Ccc DE", "Ffff, Ggg"],
    "Aaa BC；；Ddd E； ": ["Aaa BC", "Ddd E"],
    "Aaa BC || Ddd E|Fff G": ["Aaa BC", "Ddd E", "Fff G"],
    "Aaa BC \nDdd E\r\nFff G\tHhh I": ["Aaa BC", "Ddd E", "Fff G", "Hhh I"],
    "Anna Bbbb / Cccc Dddd; Eeee F. Gggg": ["Anna Bbbb", "Cccc Dddd", "Eeee F. Gggg"],
    "Aaa BC, Ddd E, et al.": ["Aaa BC", "Ddd E"],
    "Aaa BC; Ddd E et al": ["Aaa BC", "Ddd E"],
    "Northern Ageing Cohort Consortium, Aaa BC": ["Northern Ageing Cohort Consortium", "Aaa BC"],
    "Gut and Barrier Network; Aaa BC and Southern Gut Barrier Network": ["Gut and Barrier Network", "Aaa BC", "Southern Gut Barrier Network"],
    "Aaa BC, Northern Cohort Consort.": ["Aaa BC", "Northern Cohort Consort."],
    "Aaaa, B.": ["Aaaa, B."],
    "Aaaa B.": ["Aaaa B"],
    " Aaa B ": ["Aaa B"],
    "AAAA, Bbbb;CCCC, Dddd": ["AAAA, Bbbb", "CCCC, Dddd"],
    ";;  ; ": [],
    "": [],
    'Aaa "Bee" Ccc; Ddd E': ['Aaa "Bee" Ccc', "Ddd E"],
    f"A{MARK}0{STOP}aa BC; D{MARK}{ESCAPE} E": [f"A{MARK}0{STOP}aa BC", f"D{MARK}{ESCAPE} E"],
}


def test_lists(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "k int, packed string")
    got = {}
    for k, pos, value in tuples(unpack_rows(df, "packed"), "k", "pos", "value"):
        got.setdefault(k, []).append((pos, value))
    for k, want in enumerate(CASES.values()):
        assert got.get(k, []) == list(enumerate(want, 1)), list(CASES)[k]


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 7, "x"), (2, "Aaa B, Ccc D", 8, "y"), (2, "Aaa B, Ccc D", 8, "y")], "k int, packed string, pos int, value string")
    out = unpack_rows(df, "packed")
    assert tuples(out, "k", "pos", "value") == [(2, 1, "Aaa B"), (2, 1, "Aaa B"), (2, 2, "Ccc D"), (2, 2, "Ccc D")]
    assert sorted(out.columns) == ["k", "packed", "pos", "value"]
    assert unpack_rows(df.limit(0), "packed").count() == 0


def test_very_long_list(spark):
    many = "; ".join(f"Name{i}, A." for i in range(5000)) + '; "' + "x" * 100_000 + ', Y."'
    out = unpack_rows(spark.createDataFrame([(many,)], "packed string"), "packed")
    assert out.count() == 5001 and out.where("pos = 5001").first()["value"] == "x" * 100_000 + ", Y."


@pytest.mark.parametrize("sep", [";", "|", "\t", "\n", "；"])
def test_round_trip_of_quoted_values(spark, sep):
    values = [f'Na{sep}me {i}, "Q" A{i}.' for i in range(20)]
    packed = sep.join('"' + v.replace('"', '""') + '"' for v in values)
    out = unpack_rows(spark.createDataFrame([(packed,)], "packed string"), "packed")
    assert [v for _, v in tuples(out, "pos", "value")] == values


def test_pathological_texts_end_soon(spark):
    n = 50_000
    odd = [" " * n, '"' * n, "x" * n, "x " * n, "," * n, "A, " * (n // 4), '"' + '""' * n + '"', ", " * n + "and", "a" + "\n" * n, " " * n + "x"]
    df = spark.createDataFrame(list(enumerate(odd)), "k int, packed string")
    got = {}
    for k, value in tuples(unpack_rows(df, "packed").select("k", "value")):
        got.setdefault(k, []).append(value)
    assert 0 not in got and got[2] == ["x" * n] and got[9] == ["x"] and got[6] == ['"' * n]


def test_parts_of_any_length(spark):
    long, initials = "X" + "x" * 20_000, "A. " * 5_000
    texts = [f"{long}, B. C.; Ddd E", f"Aaaa, {initials}", f"{long} {long}, {long}", "van " * 5_000 + "Aaaa, B.", "a " * 10_000 + ", B.", "Aaaa," + " " * 50_000 + "B."]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in unpack_rows(df, "t").orderBy("k", "pos").collect():
        got.setdefault(r["k"], []).append(r["value"])
    assert got[0] == [f"{long}, B. C.", "Ddd E"] and got[1] == [f"Aaaa, {initials.strip()}"] and got[2] == [f"{long} {long}, {long}"]
    assert got[3] == [("van " * 5_000 + "Aaaa, B.")] and got[4] == ["a " * 9_999 + "a", "B"] and got[5] == ["Aaaa," + " " * 50_000 + "B."]
