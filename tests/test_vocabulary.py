"""Vocabularies as tables against direct search."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import vocabulary as V


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 11))) for _ in range(150)} | {"Äöü", "", "ab cd"})
    names = ["".join(rnd.choice("abcdE") for _ in range(rnd.randint(0, 11))) for _ in range(150)] + ["ÄÖU", "ABCD", " abcd", "zzzzzzzzzzz"]
    return words, names + names[:40]


def frames(spark, words, names):
    return (spark.createDataFrame([(w,) for w in [*words, None]], "word string"),
            spark.createDataFrame([(i, n) for i, n in enumerate([*names, None])], "id long, name string"))


@pytest.mark.parametrize("limited", [False, True])
def test_nearest_is_the_brute_force_answer(spark, texts, limited):
    words, names = texts
    w, n = frames(spark, words, names)
    got = {r["name"]: (r["edits"], r["word"]) for r in V.nearest_words(n, "name", w, 3, V.near_enough if limited else None).collect()}
    want = {}
    for name in set(names):
        near = [(e, word) for word in words if (e := edits(name.lower(), word.lower())) <= 3
                and (not limited or e <= max(1, max(len(name), len(word)) // 3))]
        if near:
            want[name] = min(near, key=lambda x: (x[0], x[1].encode()))
    assert got == want


def test_unlisted_rows_and_their_fixes(spark, texts):
    words, names = texts
    w, n = frames(spark, words, names)
    found = V.check_vocabulary(n, "name", w, ["id"], doc="id", fixes=True).collect()
    assert sorted(int(r["row_key"]) for r in found) == [i for i, x in enumerate(names) if x not in words]
    for r in found:
        assert r["doc_key"] == r["row_key"]
        fixes = r["fixes"]
        name = names[int(r["row_key"])].strip(" ")
        assert bool(fixes) == any(edits(name.lower(), x.lower()) <= 3 for x in words)
        for f in fixes:
            assert f["value"] in words and f["speculative"] == (f["value"].lower() != name.lower())


def test_empty_tables(spark, texts):
    w, n = frames(spark, *texts)
    assert V.check_vocabulary(n, "name", w.limit(0), ["id"]).count() == n.where("name is not null").count()
    assert V.check_vocabulary(n.limit(0), "name", w, ["id"]).count() == 0
    assert V.suggest(n, "name", w.limit(0)).where("suggestion is not null").count() == 0
    assert V.suggest(n.limit(0), "name", w).count() == 0


def test_a_full_filter_only_lets_more_rows_through(spark, monkeypatch, texts):
    w, n = frames(spark, *texts)
    want = sorted(r["row_key"] for r in V.check_vocabulary(n, "name", w, ["id"]).collect())
    monkeypatch.setattr(V, "FILTER_WORDS", 1)
    assert sorted(r["row_key"] for r in V.check_vocabulary(n, "name", w, ["id"]).collect()) == want


def test_white_space_and_columns_of_other_names(spark):
    words = V.vocabulary(spark.createDataFrame([("red  bolt",), ("red bolt",)], "x string"), "x", "collapse")
    assert [r["word"] for r in words.collect()] == ["red bolt"]
    df = spark.createDataFrame([(1, " red   bolt ", "kept"), (2, "bolt", "kept")], "id long, value string, word string")
    assert [r["row_key"] for r in V.check_vocabulary(df, "value", words, ["id"], white_space="collapse").collect()] == ["2"]
    df = df.select("word", F.col("value").alias("edits"))
    assert V.suggest(df, "edits", words).columns == ["edits", "word", "suggestion"]


def test_lengths_out_of_reach(spark, monkeypatch):
    """No neighbourhood is made of a text that is longer or shorter than every text of the other side by more than the edits."""
    made, whole = set(), V._neighbourhood

    def seen(df, text, edits):
        made.update((r[0], edits) for r in df.select(text).collect())
        return whole(df, text, edits)

    monkeypatch.setattr(V, "_neighbourhood", seen)
    names = spark.createDataFrame([("bolt no 1234567",), ("bo",), ("bol",), ("Bolts",), (None,)], "name string")
    words = spark.createDataFrame([("bolts",), ("a very long word",)], "word string")
    got = {r["name"]: (r["word"], r["edits"]) for r in V.nearest_words(names, "name", words, edits=2).collect()}
    assert got == {"Bolts": ("bolts", 0), "bol": ("bolts", 2)}
    assert not {t for t, _ in made} & {"bo"} and ("bol", 1) not in made and ("bol", 2) in made and ("a very long word", 0) not in made
