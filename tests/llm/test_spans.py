from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quaymill.llm import spans
from quaymill.llm.spans import MIN_RUN, anchors, repeated_units, shared_pairs, shared_runs, shared_share, units


def _brute(docs):
    where = {}
    for i, t in docs:
        for p in range(len(t or "") - MIN_RUN + 1):
            where.setdefault(t[p : p + MIN_RUN], set()).add(i)
    pairs, chars = set(), {}
    for i, t in docs:
        hit = np.zeros(len(t or "") + 1, int)
        for p in range(len(t or "") - MIN_RUN + 1):
            m = where[t[p : p + MIN_RUN]]
            if len(m) > 1:
                hit[p] += 1
                hit[p + MIN_RUN] -= 1
                pairs |= {(i, j) for j in m if i < j}
        chars[i] = int((np.cumsum(hit)[:-1] > 0).sum())
    return pairs, chars


def _check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("doc", F.lit("clash")).withColumn("digest", F.lit(1))
    around, copies = anchors(df, "doc_id", "text")
    pairs, chars = _brute(docs)
    got = [tuple(r) for r in shared_pairs(shared_runs(around), copies).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    shares = {r["doc"]: r["shared_chars"] for r in shared_share(df, "doc_id", "text", around, copies).collect()}
    assert shares == chars
    text = dict(docs)
    for r in shared_runs(around).collect():
        assert text[r["a"]][r["a_from"] : r["a_to"]] == text[r["b"]][r["b_from"] : r["b_to"]] and r["a_to"] - r["a_from"] >= MIN_RUN
    return pairs


def _words(rnd, n):
    return "".join(rnd.choice("abcde \nக்ழ\U0001f687") for _ in range(n))


def test_runs_of_every_length_around_the_limit(spark):
    rnd = random.Random(8)
    docs, n = [], 0
    for k in range(60):
        run = _words(rnd, MIN_RUN - 30 + k)
        for _ in range(2):
            docs.append((n, _words(rnd, rnd.randrange(0, 300)) + "<" + run + ">" + _words(rnd, rnd.randrange(0, 300))))
            n += 1
            run = run if k % 3 else run + "!"
    assert 25 < len(_check(spark, docs)) < 45


def test_copies_repeats_and_odd_texts(spark):
    rnd = random.Random(1)
    long = _words(rnd, 4000)
    docs = [(1, None), (2, ""), (3, "x"), (4, long), (5, long), (6, "new " + long[100:400]), (7, long.upper()), (8, long[:MIN_RUN]), (9, long[: MIN_RUN - 1]), (10, "a" * 2000), (11, "b" + "a" * 500), (12, "ab" * 400), (13, "x" + "ab" * 100 + "tail" * 40), (14, long), (15, long[:2000] * 2), (16, "ba" * 90)]
    _check(spark, docs)


def test_a_passage_in_a_third_of_all(spark):
    rnd = random.Random(2)
    notice = _words(rnd, 260)
    docs = [(i, _words(rnd, 200) + (notice if i % 3 == 0 else "") + _words(rnd, 100)) for i in range(90)]
    assert len(_check(spark, docs)) == 30 * 29 // 2


def test_a_text_longer_than_a_chunk(monkeypatch):
    rnd = random.Random(3)
    text = _words(rnd, 9000)
    whole = dict(zip(*(x.tolist() for x in reversed(units(text)))))
    monkeypatch.setattr(spans, "CHUNK", 2000)
    parts = dict(zip(*(x.tolist() for x in reversed(units(text)))))
    assert set(whole) <= set(parts) and all(parts[p] == h for p, h in whole.items())


def test_no_texts(spark):
    _check(spark, [(1, None)])
    df = spark.createDataFrame([], "doc_id bigint, text string")
    around, copies = anchors(df, "doc_id", "text")
    assert shared_pairs(shared_runs(around), copies).count() == 0 and shared_share(df, "doc_id", "text", around, copies).count() == 0


def test_repeated_lines_keep_the_earliest(spark):
    line = "This very line stands in more than one of the records here."
    docs = [(1, f"first\n{line}\n", 3), (2, f"{line.upper()}\nother", 1), (3, f"{line}  \n{line}", None), (4, None, 0), (5, "", 0), (6, "short\nshort", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, at int").withColumn("unit", F.lit("clash"))
    got = sorted((r["doc"], r["offset"], r["kept"], r["first_doc"]) for r in repeated_units(df, "doc_id", "text", ["at"]).collect())
    n = len(line)
    assert got == [(1, 6, False, 2), (2, 0, True, 2), (3, 0, False, 2), (3, n + 3, False, 2)]


def _periodic(seed, cases=150):
    """Pairs of texts that share a passage of a short period, which goes on for up to a period, or for long, in the second."""
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    docs = []
    for i in range(cases):
        unit = word(rnd.randint(1, 37))
        n, at = len(unit), rnd.randrange(len(unit))
        run = (unit * 200)[at : at + rnd.randint(150, 154)]
        far = 400 if i % 5 == 0 else n - 1
        left, right = rnd.randint(0, far), rnd.randint(0, far)
        more = (unit * 600)[at + n * 400 - n * (left // n + 1) + (n - left % n) :][: left] + run + (unit * 600)[(at + len(run)) % n :][:right]
        docs += [(2 * i, word(90) + run + word(90)), (2 * i + 1, word(90) + more + word(90))]
    return docs


def test_runs_of_short_period(spark):
    _check(spark, _periodic(3))
    _check(spark, [(1, "x" * 900), (2, "y" + "x" * 150 + "z"), (3, "ab" * 500), (4, "c" + "ab" * 76 + "d"), (5, "-" * 149), (6, "+" + "ab" * 300)])
