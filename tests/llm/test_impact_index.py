import math
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from tests.test_entry import views
from trajspark.llm import impact_index, registry


def brute_force(docs, items, k=50):
    """Scores of all documents for every item, one by one; docs: (doc_id, text), items: (item_id, text)."""
    counted = [(i, Counter(brute.words(t, brute.ALNUM))) for i, t in docs]
    df = Counter(t for _, c in counted for t in c)
    total, whole = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    queries = {}
    for i, t in items:
        if i is not None and t is not None:
            queries.setdefault(i, set()).update(brute.words(t, brute.ALNUM))
    out = []
    for item, terms in queries.items():
        found = []
        for i, c in counted:
            score = 0
            for t in terms & c.keys():
                m = 100 - 50 + (50 * sum(c.values()) * total) // whole
                score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


ODD = [(1, "the cat sat"), (9, "the cat sat"), (9, "the cat sat"), (None, "The CAT sat"), (None, None), (4, None), (5, ""), (2, "... !!"), (6, "É é 日本 cat_2"), (7, "dog " * 70_000 + "cat"), (3, "the the the cat"), (8, "a\x00b the")]
ITEMS = [(1, "The cat"), (1, "dog"), (2, ""), (3, None), (None, "cat"), (4, "nothing known"), (5, "É 日本 2 the"), (6, "the"), (7, "the cat sat dog a b é 2")]


@pytest.mark.parametrize("block,query_bytes,together,share", [(4096, 8 << 20, 256, 2048), (3, 5, 2, 1)])
def test_odd_rows(spark, monkeypatch, block, query_bytes, together, share):
    for name, value in {"BLOCK_DOCS": block, "QUERY_BYTES": query_bytes, "TOGETHER": together, "BLOCKS_A_SHARE": share}.items():
        monkeypatch.setattr(impact_index, name, value)
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS `a.b`", "3 AS item_id").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for k in (2, 50):
        assert sorted(map(tuple, impact_index.search(docs, items, k).collect()), key=str) == brute_force(ODD, ITEMS, k)
    assert impact_index.search(docs.limit(0), items).count() == 0
    assert impact_index.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    named = impact_index.search(docs, items.selectExpr("cast(item_id AS string) AS item_id", "text"), 1)
    assert {(r.item_id, r.doc_id) for r in named.collect()} == {(str(a), c) for a, _, c, _ in brute_force(ODD, ITEMS, 1)}


@pytest.mark.parametrize("seed", range(3))
def test_sums_and_descent(seed):
    rng = np.random.default_rng(seed)
    impact = rng.integers(0, 1 << 12, (7, 200)) * (rng.random((7, 200)) < 0.4)
    term, doc = np.nonzero(impact)
    part = impact_index.slices_of(term * 4 + doc // 64, (doc % 64).astype(np.uint64), impact[term, doc], 28).reshape(-1, 7, 4)
    total = np.zeros((16, 2, 4), np.uint64)
    for column in ([0, 6], [1, 5], [2], [3]):
        impact_index.add(total, part, np.array(column))
    bits = np.unpackbits(total.view(np.uint8), axis=2, bitorder="little")[:, :, :200].astype(np.int64)
    sums = (bits << np.arange(16)[:, None, None]).sum(0)
    assert (sums == np.stack([impact[:4].sum(0), impact[5:].sum(0)])).all()
    for k in (1, 5, 50, 300):
        found = np.unpackbits(impact_index.best(total, k).view(np.uint8), axis=1, bitorder="little")[:, :200]
        for r in (0, 1):
            assert np.flatnonzero(found[r]).tolist() == sorted(i for i in np.lexsort((np.arange(200), -sums[r]))[:k] if sums[r][i])


def test_query_equals_sql_and_brute_force(spark, sf):
    got = sorted(map(tuple, registry.QUERIES["op11_impact_index"](spark, sf).collect()), key=str)
    assert got == sorted(views(sf).execute(registry.ORACLES["op11_impact_index"]).fetchall(), key=str)
    rows = lambda t, i: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect()]
    assert got == brute_force(rows("documents", "doc_id"), rows("benchmark", "item_id"))
