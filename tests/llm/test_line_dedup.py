import random

import duckdb
import pytest

from tests.llm import brute
from trajspark.llm import line_dedup, registry


def plain(rows, size=line_dedup.PASSAGE_WORDS):
    """Rows of (id, text) without null ids or repeats: {id: (text, removed spans, removed words)}, place by place."""
    first, out = {}, {}
    said = {i: list(brute.SPACED.finditer(t or "")) for i, t in rows}
    word = {i: [m.group().translate(brute.FOLD) for m in ms] for i, ms in said.items()}
    for i, _ in sorted(rows):
        for at in range(len(word[i]) - size + 1):
            first.setdefault(tuple(word[i][at : at + size]), (i, at))
    for i, text in rows:
        gone = set()
        for at in range(len(word[i]) - size + 1):
            doc, place = first[tuple(word[i][at : at + size])]
            if doc != i or at >= place + size:
                gone |= set(range(at, at + size))
        spans, kept, upto = [], "", 0
        for k, m in enumerate(said[i]):
            if k in gone:
                kept += text[upto : m.start()] if k - 1 not in gone else ""
                upto = said[i][k + 1].start() if k + 1 < len(said[i]) else len(text)
                if k - 1 in gone:
                    spans[-1] = (spans[-1][0], m.end())
                else:
                    spans.append(m.span())
        out[i] = (None if text is None else kept + text[upto:], spans, len(gone))
    return out


def got(df, **options):
    return {r.doc_id: (r.text, [tuple(s) for s in r.removed_spans], r.n_removed) for r in line_dedup.dedup(df, **options).collect()}


def corpus(seed, size):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdé") + str(rng.randrange(90))
    passages = [[word() for _ in range(n)] for n in (size - 1, size, size + 1, size + 8, 3 * size)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.choice([0, 3, size, 40, 150]))]
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if rng.random() < 0.2 else w for w in rng.choice(passages)]
        if rng.random() < 0.2:
            words = [rng.choice(["la", "lo"])] * rng.choice([size, 2 * size, 3 * size + 5])
        rows.append((i, "".join(rng.choice(["", " ", "\n"]) if not k else rng.choice([" ", " ", "\n", "\t ", "😀 "]) + w for k, w in enumerate(["", *words]))))
    rows += [(100 + i, rows[rng.randrange(60)][1]) for i in range(15)] + [(200, None), (201, ""), (202, " \n ")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 16), (2, 20), (3, 51)])
def test_equals_brute_force(spark, seed, size):
    rows = corpus(seed, size)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "doc_id as n_removed", "'k' as id", "1 as at", "2 as `a.b`")
    out = line_dedup.dedup(df, passage_words=size)
    assert out.columns == ["doc_id", "text", "id", "at", "a.b", "n_removed", "removed_spans"]
    assert got(df, passage_words=size) == plain(rows, size)
    assert sum(n for *_, n in plain(rows, size).values()) > 20 * size


def test_nulls_ties_and_empty(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    rows = [(None, a), (7, f"x {a}"), (7, f"x {a}"), (7, f"y\n{a}\nz"), (8, None), (None, b), (9, f"{b} {b}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.text) for r in line_dedup.dedup(df).collect()), key=str)
    sevens = sorted(t for i, t in found if i == 7)
    assert sevens in (["x ", "x ", f"y\n{a}\nz"], [f"x {a}", f"x {a}", "y\nz"])
    assert sorted(str(t) for i, t in found if i is None) == ["", ""] and (8, None) in found and (9, f"{b} ") in found
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    part = long.split(" ")[1000:90_000]
    rows = [(1, long), (2, " ".join(["start", *part, "end"])), (3, " ".join(["la"] * 200_000))]
    out = got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out[1] == (long, [], 0) and out[2] == ("start end", [(6, len(rows[1][1]) - 4)], 89_000)
    assert out[3][0].split() == ["la"] * 51 and out[3][2] == 199_949


def test_query_equals_sql_and_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = {r.doc_id: (r.text, r.removed_offsets, r.n_removed) for r in registry.QUERIES["op6_line_dedup"](spark, sf).collect()}
    assert found == {i: (t, ",".join(f"{a}-{b}" for a, b in s), n) for i, (t, s, n) in plain(rows).items()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert {i: (t, s, n) for i, t, n, s in con.execute(f"select doc_id, text, n_removed, removed_offsets from ({registry.ORACLES['op6_line_dedup']})").fetchall()} == found
    assert sum(n for *_, n in found.values()) > 0


def test_memory_of_a_task_is_bounded_by_small_slices():
    """Texts of a batch are hashed half a megabyte at a time; the last pass, which cuts, hashes nothing."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import types as T

    from trajspark.llm import kernels

    class Docs:
        schema = T.StructType([T.StructField("id", T.LongType())])

        def mapInArrow(self, emit, kinds):  # noqa: N802
            return emit

    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(300)) for _ in range(2_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["id", "hash", "text"])
    kernels._powers.cache_clear()
    tracemalloc.start()
    rows = sum(b.num_rows for b in line_dedup._index(Docs(), line_dedup.PASSAGE_WORDS)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 40 << 20
