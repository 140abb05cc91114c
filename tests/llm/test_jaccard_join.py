import random

import pytest

from tests.llm import brute
from trajspark.llm import components, jaccard_join, registry


def expected(rows):
    sets = [brute.shingles(t) for _, t in rows]
    roots = brute.components(sets)
    least: dict = {}
    for (i, _), root in zip(rows, roots, strict=True):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    return sorted(((i, len(s), least.get(r)) for (i, _), s, r in zip(rows, sets, roots, strict=True)), key=str)


def got(df):
    return sorted((tuple(r) for r in jaccard_join.link(df).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(60))
    passage = [word() for _ in range(30)]
    rows: list = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 9, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy[len(copy) // 2 : len(copy) // 2] = passage
            if rng.random() < 0.2:
                copy = [w.upper() for w in copy[: 1 + int(len(copy) * 0.9)]]
            rows.append(rng.choice([" ", "\n", "\t "]).join(copy))
    rows += ["", " \n", None, "one two", "ONE two", "one", "a b c d e", "A B C D E f"]
    rng.shuffle(rows)
    return [(1000 - 3 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == expected(rows)


def test_shuffled_texts_and_no_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(jaccard_join, "HOT", 1)
    monkeypatch.setattr(jaccard_join, "BLOCK", 50)
    rows = corpus(4)
    rows += [rows[0], (rows[1][0], "quite another text with its own words"), (None, rows[2][1]), (None, "z y x w v u")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as component_id", "2 as n")
    assert got(df) == expected(rows)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 100), (60, 60)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(i, 1) for i in range(1, 41)] + [(50, 50), (100, 50)]


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in registry.QUERIES["op5_jaccard_join"](spark, sf).collect()), key=str) == expected(rows)
