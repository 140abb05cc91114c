import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from trajspark.llm import kernels, registry, suffix_decontam


def _rows(seed, n=60):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma", "délta", "x1", "zz"]
    text = lambda k: " ".join(rng.choice(vocab) + rng.choice(["", ",", "!"]) for _ in range(k))
    items = [(i, text(rng.choice([0, 1, 3, 12, 13, 20, 40]))) for i in range(12)] + [(99, None), (98, "--")]
    docs = []
    for i in range(n):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            whole = (rng.choice(items)[1] or "").upper()
            parts += [whole[rng.randrange(1 + len(whole) // 2) :], text(rng.randrange(40))]
        docs.append((i, " ".join(parts)))
    return docs + [(n, None), (n + 1, ""), (0, docs[0][1])], items


@pytest.mark.parametrize("block", [suffix_decontam.BLOCK_BYTES, 120])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_decontam, "BLOCK_BYTES", block)
    docs, items = _rows(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in suffix_decontam.mark(df, bench).collect())
    assert got == sorted((i, *brute.decontam(t, items)) for i, t in docs)


def test_longest_match_and_removal(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, "a b " + " ".join(f"w{i}" for i in range(4, 25)) + " c"), (2, "clean words only"), (3, item)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'extra' as items")
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    got = {r.doc_id: r for r in suffix_decontam.mark(df, bench).collect()}
    assert tuple(got[1].longest) == ("q", 2, 21) and got[1].hit_spans == [2, 23] and got[2].longest is None
    assert tuple(got[3].longest) == ("q", 0, 30)
    kept = suffix_decontam.decontaminate(df, bench)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [2]


def test_every_copy_has_its_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(30))
    part = " ".join(f"w{i}" for i in range(4, 25))
    docs = [(1, item), (2, f"a b {part} c"), (3, f"x {item}"), (4, f"{part} {part}")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([("r", item), ("q", item)], "item_id string, text string")
    got = {r.doc_id: tuple(r.longest) for r in suffix_decontam.mark(df, bench).collect()}
    assert got == {1: ("q", 0, 30), 2: ("q", 2, 21), 3: ("q", 1, 30), 4: ("q", 0, 21)}


def _longest(text, items, window=13):
    doc, found = brute.words(text, brute.ALNUM), []
    for item_id, body in items:
        item = brute.words(body, brute.ALNUM)
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k]:
                    k += 1
                if k >= min(window, len(item)):
                    found.append((-k, i, str(item_id)))
    return min(found, default=None)


@pytest.mark.parametrize(("block", "window"), [(suffix_decontam.BLOCK_BYTES, 13), (120, 13), (120, 1)])
def test_longest_equals_brute_force(spark, monkeypatch, block, window):
    monkeypatch.setattr(suffix_decontam, "BLOCK_BYTES", block)
    docs, items = _rows(6, 25)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.longest and (-r.longest.words, r.longest.place, r.longest.item_id)) for r in suffix_decontam.mark(df, bench, window=window).collect()]
    assert sorted(got, key=str) == sorted(((i, _longest(t, items, window)) for i, t in docs), key=str)


def test_suffix_array_sorts_suffixes():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 3, 200)
    order = suffix_decontam.suffix_array(text, 200)
    assert [text[i:].tolist() for i in order] == sorted(text[i:].tolist() for i in range(200))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert suffix_decontam.mark(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in suffix_decontam.mark(one, bench).collect()] == [(2, 0, False)]


def test_query_equals_brute_force(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.QUERIES["op8_suffix_decontam"](spark, sf).collect()
    assert len(got) == len(docs)
    windows = set()
    for _, body in items:
        w = brute.words(body, brute.ALNUM)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    for r in got:
        doc = brute.words(docs[r.doc_id], brute.ALNUM)
        if r.n_hit or any(tuple(doc[i : i + 13]) in windows for i in range(len(doc))):
            n, hit, found = brute.decontam(docs[r.doc_id], items)
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), brute.sha(",".join(found)), hit > 0 and 20 * hit >= n)
        else:
            assert (r.n_words, r.n_items, r.contaminated) == (len(doc), 0, False)
    assert sum(r.n_hit > 0 for r in got) > 0


def test_shards_are_hashed_by_pieces(monkeypatch):
    seen, whole = [], kernels.word_hashes
    monkeypatch.setattr(kernels, "word_hashes", lambda raw, *spans: seen.append(len(raw)) or whole(raw, *spans))
    texts = [f"alpha beta {i} gamma " * 1000 for i in range(100)]
    block = suffix_decontam.Block.of(["q"], ["beta gamma"], 13)
    seen.clear()
    known, counts = block.known(pa.RecordBatch.from_arrays([pa.array([*texts, None, ""])], ["text"]), "text")
    assert sum(seen) == sum(map(len, texts)) and max(seen) <= suffix_decontam.HASHED_BYTES
    assert counts.tolist() == [4000] * 100 + [0, 0] and np.count_nonzero(known) == 200_000 and known[:4].astype(bool).tolist() == [False, True, False, True]


def test_freed_memory_goes_back_when_a_task_ends(monkeypatch):
    trims = []
    monkeypatch.setattr(kernels.ctypes, "CDLL", lambda name: type("C", (), {"malloc_trim": staticmethod(trims.append)}))
    task = kernels.trimmed(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(task) == 2 and not trims
    assert list(task) == [3] and trims == [0]
