import re
from itertools import permutations

import pytest

from tests.llm import brute
from tests.test_entry import views
from trajspark.llm import filter_audit, registry

LONG = " ".join(f"word{i}" for i in range(60))
ODD = [
    (5, LONG, "a"), (3, LONG, "a"), (3, LONG, None), (9, LONG, ""), (None, LONG, "a"), (None, None, None), (4, None, "a"), (6, "", "a"),
    (7, LONG + " #", "b"), (7, "SHOUT " * 80, "b"), (8, "SHOUT " * 80, "b"), (2, "x y\x1cz Ω\x0b" * 40, "b"), (1, "A" * 200_000, "b"), (10, LONG + " ퟿ É" * 30, "b"),
]
LABELS = [(3, 1, 0), (3, 0, 1), (9, None, 1), (None, 1, 1), (8, 1, None), (77, 1, 1), (4, 0, 1)]


def brute_force(docs, labels):
    """Every order run one by one over all rows."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows = []
    for i, text, part in docs:
        t = text or ""
        w = brute.SPACED.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        rows.append((part or "", {k for k, bad in fails.items() if bad}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            live = [r for r in rows if r[0] == part]
            for step, k in enumerate(order, 1):
                gone = [r for r in live if k in r[1]]
                failing = sum(r[0] == part and k in r[1] for r in rows)
                live = [r for r in live if k not in r[1]]
                out[part, order, step] = [len(live), len(gone), failing - len(gone), sum(r[0] == part and r[1] == {k} for r in rows), sum(r[2] for r in gone), sum(r[3] for r in gone), 0]
    for (part, order, step), row in out.items():
        row[-1] = sum(x[1] for (p, o, s), x in out.items() if p == part and o[s - 1] == order[step - 1])
    return {(*k, *v) for k, v in out.items()}


@pytest.mark.parametrize("buffer", [8 << 20, 300])
def test_odd_rows(spark, monkeypatch, buffer):
    monkeypatch.setattr(filter_audit, "BUFFER_BYTES", buffer)
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string").selectExpr("*", "1 AS part", "2 AS mask", "3 AS `a.b`").repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    assert {tuple(r) for r in got.collect()} == brute_force(ODD, LABELS)
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).count() == 0


def test_texts_of_one_fingerprint(monkeypatch):
    """Different texts whose fingerprints clash, dealt to several buffers."""
    monkeypatch.setattr(filter_audit, "BUFFER_BYTES", 1)
    rows = [(3, "p", "one", 5), (2, "p", "two", 5), (1, "q", "one", 5), (4, "p", "two", 5), (3, "p", "one", 5)]
    routed = sorted((key, row) for key, row in filter_audit._read(rows) if len(row) == 5)
    settled = [row for _, row in filter_audit._read(rows) if len(row) == 4]
    found = sorted((i, part, bool(mask & 16), n) for i, part, mask, n, *_ in [*settled, *filter_audit._met(routed)])
    assert found == [(1, "q", False, 1), (2, "p", False, 1), (3, "p", True, 1), (3, "p", True, 1), (4, "p", True, 1)]


def test_copies_are_routed_once(monkeypatch):
    """A text that fills the table is routed once for a reading task, its other rows without text."""
    routed = [row for _, row in filter_audit._read((i, "p", LONG, 1) for i in range(1000))]
    assert sum(len(r) == 5 for r in routed) == 1 and sum(len(r) == 4 for r in routed) == 999
    for same in (5, None):  # rows of one id, rows without one
        keys = [key for key, row in filter_audit._read([(1, "p", LONG, 1), *((same, "p", LONG, 1) for _ in range(999))]) if len(row) == 4]
        assert len(set(keys)) == len(keys) == 999


def test_query_equals_sql(spark, sf):
    got = registry.QUERIES["op13_filter_audit"](spark, sf)
    want = views(sf).execute(registry.ORACLES["op13_filter_audit"]).fetchall()
    assert {tuple(r) for r in got.collect()} == set(want) and len(want) == 600 * spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct().count()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert set(want) == brute_force(docs, labels)
