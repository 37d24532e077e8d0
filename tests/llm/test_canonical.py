from __future__ import annotations

import random
import string

import pytest

from quaymill.llm.canonical import map_to_canonical, readings

NAMES = [(1, "Kezvengam Salai", None), (2, "Vaijor Gate", None), (3, "Undrahinoor West", None), (4, "Undrahinoor East", None), (5, "Hinosk Nagar I", None), (6, "Hinosk Nagar II", None), (7, "Belchokulam", "Pernanund Pallam"), (8, "Entevserthidal", "மோனோனழபேட்டை"), (9, "Perambur", None), (10, "Ago", None), (11, None, None)]
CASES = [
    ("kezvengam salai", 1), ("Kezvengam S alai", 1), ("KEZVENGAM  SALAI METRO STATION†* (AFC 2253)", 1), ("kez.vengam-salai", 1), ("Kezvegam Salay", 1), ("Kezvxgxm Salyi", -1),
    ("AFC1042 Sri Vaijor Gate - Gate 1187", 2), ("Vaijor Gate 3", -1), ("Vaijor Gat e", 2), ("Váijor Gāte [1880]", 2), ("Vaijor Gate, array 1670", 2),
    ("Undrahinoor", -1), ("Undrahinoor (W)", 3), ("EAST Undrahinor", 4), ("undrahinoorwest", 3), ("Undrahinoor North", -1), ("Undrahinoor West MS", 3),
    ("Hinosk Nagar 2", 6), ("HinoskNagar - 1", 5), ("Hinosk Nagar", -1), ("Hinosk Nagar III", -1), ("Hinosk Nagar II[2]", 6), ("Hinosk Nagar¹ 1", 5),
    ("pernanund palam", 7), ("மோனோனழபேட்டை-Metro", 8), ("மோனோனழ", -1), ("Perambur Market", -1), ("Perambur Mkt", -1), ("Perambur stn.", 9), ("agó", 10), ("Ag", 10), ("", -1), ("  ", -1), ("†*", -1), ("metro station", -1), ("x" * 30000, -1),
]


def test_known_cases(spark):
    entries = spark.createDataFrame([(e, 1) for e, _ in CASES] * 2 + [(None, 1)], "entry string, value int")
    names = spark.createDataFrame(NAMES + NAMES[:3], "ref_id int, station string, alias string")
    got = {r["entry"]: r["ref_id"] for r in map_to_canonical(entries, "entry", names, "ref_id", ["station", "alias"]).collect()}
    assert got == dict(CASES)


def _lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_against_brute_force(spark):
    """No pair within two changes is lost by prefixes and filters, short names included."""
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcmxy") for _ in range(n))
    refs = [(k, word(rnd.choice([1, 2, 3, 4, 5, 8, 12])), None) for k in range(60)]
    entries = set()
    for _ in range(500):
        w = list(rnd.choice(refs)[1])
        for _ in range(rnd.choice([0, 1, 2, 3])):
            k, i = rnd.choice("ids"), rnd.randrange(len(w) + 1)
            w[i : i + (k != "i")] = [] if k == "d" else [rnd.choice("abcmxy")]
        entries.add("".join(w))
    entries = {e for e in entries if e and e not in ("ms",)}
    want = {}
    for e in entries:
        d, r = min((_lev(e, n), k) for k, n, _ in refs)
        want[e] = d if d <= 2 else None
    got = map_to_canonical(spark.createDataFrame([(e,) for e in entries], "entry string"), "entry", spark.createDataFrame(refs, "ref int, a string, b string"), "ref", ["a", "b"])
    by = {k: n for k, n, _ in refs}
    for r in got.collect():
        d = None if r["ref"] == -1 else _lev(r["entry"], by[r["ref"]])
        assert d == want[r["entry"]], r


def test_nothing(spark):
    none = spark.createDataFrame([], "entry string")
    names = spark.createDataFrame(NAMES, "ref_id int, station string, alias string")
    assert map_to_canonical(none, "entry", names, "ref_id", ["station", "alias"]).count() == 0
    one = spark.createDataFrame([("Perambur",)], "entry string")
    assert [tuple(r) for r in map_to_canonical(one, "entry", names.limit(0), "ref_id", ["station"]).collect()] == [("Perambur", -1)]


@pytest.mark.parametrize("text", [None, "", string.punctuation, "S", "N E W S", "a" * 5000 + " n", "​", "I I I I I I"])
def test_readings_never_fail(text):
    assert isinstance(readings(text), list)


def test_blanks_after_most_letters(spark):
    cases = [("Kezve n g am s ala i", 1), ("U n drah i n oor W e s t", 3), ("U n drah i n oor w", 3), ("U n drah i n oor w est", 3), ("S i v i n w e s e n", 12), ("S i v i n w e s e n II", 13), ("n s e w " * 5000, -1)]
    entries = spark.createDataFrame([(e,) for e, _ in cases], "entry string")
    names = spark.createDataFrame([*NAMES, (12, "Sivinwesen", None), (13, "Sivinwesen 2", None)], "ref_id int, station string, alias string")
    got = {r["entry"]: r["ref_id"] for r in map_to_canonical(entries, "entry", names, "ref_id", ["station", "alias"]).collect()}
    assert got == dict(cases)


def test_wording_is_an_argument(spark):
    import re

    from quaymill.llm.canonical import Wording

    cities = Wording(qualifiers={"upper": "upper", "up": "upper", "lower": "lower"}, doubtful=frozenset(), dropped=frozenset({"city", "of"}), notes=re.compile(r"\(\w\w\)"))
    names = spark.createDataFrame([(1, "Upper Norwood"), (2, "Lower Norwood"), (3, "Bexley")], "id int, name string")
    said = spark.createDataFrame([("City of Bexley (UK)",), ("Up. Norwod",), ("Norwood",), ("Lower Norwood",), (None,), ("North Bexley",)], "e string")
    got = {r["e"]: r["id"] for r in map_to_canonical(said, "e", names, "id", ["name"], cities).collect()}
    assert got == {"City of Bexley (UK)": 3, "Up. Norwod": 1, "Norwood": -1, "Lower Norwood": 2, "North Bexley": -1}
