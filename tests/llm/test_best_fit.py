import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trajspark.llm import best_fit, registry


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(registry.WORD_BPE)
    own.no_padding()
    own.no_truncation()
    return own


def expected_pieces(library, docs, capacity):
    out = []
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(-(-len(ids) // capacity)):
            own = ids[k * capacity : (k + 1) * capacity]
            out.append((doc_id, k, k * capacity, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return out


def check_packing(rows, capacity):
    """Every sequence is gapless from 0 and no longer than the capacity; gives their number."""
    found = {}
    for r in rows:
        found.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in found.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(found)


def plain_best_fit(lengths, capacity):
    """Each item goes to the bin that it leaves least in, by trying all."""
    left = []
    for n in lengths:
        fits = [(r, i) for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_equals_a_plain_search(seed):
    lengths = np.sort(np.random.default_rng(seed).integers(1, 101, 300))[::-1]
    bins, places, totals = best_fit.best_fit(lengths, 100)
    assert sorted(100 - totals) == plain_best_fit(lengths, 100)
    for b in range(len(totals)):
        own = np.flatnonzero(bins == b)
        assert places[own].tolist() == [0, *np.cumsum(lengths[own])[:-1]] and lengths[own].sum() == totals[b]


ODD = [(1, None, "x"), (2, "", "x"), (2, "twice the id", "x"), (None, "no id", "x"), (7, "again and again " * 900, None), (7, "again and again " * 900, "y"), (8, "<|endoftext|> café 日本", "y")]


@pytest.mark.parametrize("chunk,fan", [(1 << 16, 16), (3, 2)])
def test_odd_rows_and_rounds(library, spark, chunk, fan):
    df = spark.createDataFrame(ODD, "doc_id long, text string, `sequence_id` string").withColumnRenamed("sequence_id", "a.b").selectExpr("*", "'z' AS sequence_id", "0 AS item", "0 AS bin", "0 AS length")
    got = best_fit.pack(df, registry.WORD_BPE, 1, 64, chunk=chunk, fan=fan).collect()
    key = lambda r: (r[0] is not None, r[0], *r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected_pieces(library, [r[:2] for r in ODD], 64), key=key)
    check_packing(got, 64)
    assert best_fit.pack(df.limit(0), registry.WORD_BPE).count() == 0


def test_underfull_bins_meet_up_the_tree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    whole = best_fit.pack(docs, registry.WORD_BPE).collect()
    parts = best_fit.pack(docs, registry.WORD_BPE, chunk=12, fan=4).collect()
    least = -(-sum(r.length for r in whole) // best_fit.CAPACITY)
    assert least <= check_packing(whole, best_fit.CAPACITY) <= least * 1.02 + 1
    assert check_packing(parts, best_fit.CAPACITY) <= least * 1.06 + 1


def test_no_two_underfull_bins_fit_together(spark):
    df = spark.range(400).selectExpr("id AS doc_id", "repeat('word ', cast(10 + id % 50 as int)) AS text")
    got = best_fit.pack(df, registry.WORD_BPE, 1, 100, chunk=40, fan=4).groupBy("sequence_id").sum("length").toDF("s", "n").collect()
    least, second = sorted(r.n for r in got)[:2]
    assert least + second > 100 * (1 - best_fit.SLACK)


def test_query(library, spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = registry.QUERIES["op12_best_fit"](spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(expected_pieces(library, docs, 4096))
    check_packing(rows, 4096)


def test_columns_are_encoded_as_the_library_does(library):
    own, dice = best_fit.WordEncoder(registry.WORD_BPE), np.random.default_rng(5)
    latin = [chr(c) for c in range(256)]
    often = [*"aest'.,1 \n", "'S", "'ll", "\x1c", "\x85", "\xa0", "\xb2", "\xdf", "<|", "<|endoftext|>", "\u0130", "e\u0301", "\u65e5"]
    texts = ["", None, " ", "\xa0", "\x00", "".join(latin), " ".join(latin), *(f"a{c}b{c}1{c}{c}'s" for c in latin)]
    texts += ["".join(dice.choice(often[:top], 30)) for top in (10, 15, 17, len(often)) for _ in range(100)]
    wanted = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for own.most_words in (350_000, 350_000, 10):
        for kind in (pa.string(), pa.large_string()):
            column = pa.array(["before", *texts], kind).slice(1)
            assert own.encode_column(column) == wanted
    assert own.encode_column(pa.array([], pa.string())) == []


def test_known_words_cost_little():
    """A word that is known takes under two thirds of the time that Python takes to split, look up and join."""
    own, dice = best_fit.WordEncoder(registry.WORD_BPE), np.random.default_rng(6)
    words = ["".join(dice.choice([*"etaoinsh"], 6)) for _ in range(20_000)]
    texts = [" ".join(dice.choice(words, 600)) + "." for _ in range(600)]
    column = pa.array(texts)

    def least(function, given):
        took = []
        for _ in range(5):
            start = time.process_time()
            function(given)
            took.append(time.process_time() - start)
        return min(took)

    assert own.encode_column(column) == own.encode_all(texts)
    assert least(own.encode_column, column) < least(own.encode_all, texts) * 2 / 3
