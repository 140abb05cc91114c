"""Ranked lexical search over a bit-sliced impact index.

The impact of a term in a document is its weight times a saturated term frequency,
an integer. Documents are dealt in blocks; a block holds, for each of its terms and
each bit of an impact, a bitmap over its documents. The scores of a query are the
sum of its terms' impacts: their bitmaps are added slice by slice with a carry, for
all documents of the block and many queries at once. The best documents are found by
descending from the most significant slice of the sums, and ties by the document order.

Terms are runs of ASCII letters, digits and non-ASCII bytes, with A-Z in lower case,
known by 64-bit hashes. The first pass reads every whole text and writes postings
of the queries' terms by blocks, with each document's length; from them come the
number of documents, of terms, and how many documents have a term. The second pass
slices the impacts of each block and ranks. Every task keeps the best ``k`` of a
query; those of all tasks are ranked by windows, salted if there are many.

Queries are taken in blocks of at most ``QUERY_BYTES`` of text, which go to all tasks;
further blocks take further passes. All documents are ranked for every query.

Defined results: null and empty texts have no terms; a null item id or text gives no
query; texts of equal item id are one query of all their terms; rows of equal doc_id are
ranked row by row; null doc_ids come last among ties; very long texts are indexed
whole; a term of any number of documents is no matter; further columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.llm import kernels, scratch

K = 50
#: Text of the queries of one pass.
QUERY_BYTES = 8 << 20
#: Documents of a block; bitmaps have a bit for each.
BLOCK_DOCS = 4096
#: Queries whose sums are held at once.
TOGETHER = 256
#: Blocks whose best documents meet in one window task.
BLOCKS_A_SHARE = 2048


@dataclass
class Queries:
    """Some items: sorted hashes of their terms, and each item's terms as ids into them."""

    names: list
    vocab: np.ndarray
    terms: list[np.ndarray]

    @classmethod
    def of(cls, names: list, texts: list[str]) -> Queries:
        raw, offsets = kernels.buffers(pa.array(texts, pa.string()))
        starts, ends, counts = kernels.word_spans(raw, offsets, kernels.ALNUM)
        vocab, ids = np.unique(kernels.word_hashes(raw, starts, ends), return_inverse=True)
        return cls(names, vocab, [np.unique(own) for own in np.split(ids, np.cumsum(counts)[:-1])])


def query_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Queries]:
    """Items in the order of their ids, in blocks that don't part equal ids."""
    names: list = []
    texts: list[str] = []
    held = 0
    rows = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).where("i is not null and t is not null").orderBy("i")
    for row in rows.toLocalIterator():
        if names and names[-1] == row.i:
            texts[-1] += " " + row.t
        else:
            if held > QUERY_BYTES:
                yield Queries.of(names, texts)
                names, texts, held = [], [], 0
            names.append(row.i)
            texts.append(row.t)
        held += len(row.t)
    if names:
        yield Queries.of(names, texts)


_BLOCK = T.StructType([T.StructField("id", T.ArrayType(T.LongType())), T.StructField("n", T.ArrayType(T.LongType())), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("term", "df", "doc", "tf"))])


def postings(docs: DataFrame, vocab: np.ndarray) -> DataFrame:
    """Blocks of (doc_id, text): ids and lengths of the documents, in the order of ids; different terms with their df, and doc and tf of all postings, by term."""

    def block(ids: pa.Array, counts: np.ndarray, at: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids.fill_null(0).to_numpy() if ids.null_count else ids.to_numpy(), kind="stable")
        if ids.null_count:
            null = ids.is_null().to_numpy(zero_copy_only=False)
            order = np.concatenate([order[~null[order]], np.flatnonzero(null)])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pair, tf = np.unique(at * len(order) + place[doc], return_counts=True)
        term, df = np.unique(pair // len(order), return_counts=True)
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.RecordBatch.from_arrays([one(ids.take(pa.array(order)), pa.int64()), one(counts[order], pa.int64()), one(term, pa.int32()), one(df, pa.int32()), one(pair % len(order), pa.int32()), one(tf, pa.int32())], [f.name for f in _BLOCK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def whole() -> pa.RecordBatch:
            ids, counts, at, doc = zip(*held, strict=True)
            rows = np.cumsum([0, *map(len, ids)])
            return block(pa.concat_arrays(ids), np.concatenate(counts), np.concatenate(at), np.concatenate([d + r for d, r in zip(doc, rows, strict=False)]))

        for batch in batches:
            for part in kernels.slices(batch):
                for from_row in range(0, part.num_rows, BLOCK_DOCS):
                    own = part.slice(from_row, BLOCK_DOCS)
                    if held and sum(len(h[0]) for h in held) + own.num_rows > BLOCK_DOCS:
                        yield whole()
                        held.clear()
                    raw, offsets = kernels.buffers(own.column("text"))
                    starts, ends, counts = kernels.word_spans(raw, offsets, kernels.ALNUM)
                    hashes = kernels.word_hashes(raw, starts, ends)
                    at = np.minimum(np.searchsorted(vocab, hashes), len(vocab) - 1)
                    known = np.flatnonzero(vocab[at] == hashes)
                    held.append((own.column("doc_id"), counts, at[known], np.repeat(np.arange(own.num_rows), counts)[known]))
        if held:
            yield whole()

    return docs.mapInArrow(run, _BLOCK)


def slices_of(key: np.ndarray, bit: np.ndarray, impact: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps of the impacts' bits, (bits, size) words: ``key`` is each impact's word, ascending, ``bit`` its place there."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    out = np.zeros((int(impact.max()).bit_length(), size), np.uint64)
    for s in range(len(out)):
        out[s, key[first]] = np.bitwise_or.reduceat(((impact >> s) & 1).astype(np.uint64) << bit, first)
    return out


def add(total: np.ndarray, part: np.ndarray, where: np.ndarray) -> None:
    """Add bitmaps ``part[:, where]`` (bits, terms, words) to the sums (bits, queries, words) of the first queries."""
    n = len(where)
    carry = np.zeros((n, total.shape[2]), np.uint64)
    for s in range(len(total)):
        own = total[s, :n]
        if s < len(part):
            new = part[s][where]
            either = own ^ new
            new &= own
            np.bitwise_xor(either, carry, out=own)
            carry &= either
            carry |= new
        else:
            if not carry.any():
                break
            over = own & carry
            own ^= carry
            carry = over


def best(total: np.ndarray, k: int) -> np.ndarray:
    """Bitmaps (queries, words) of the ``k`` highest sums above 0 (bits, queries, words); of equal ones the first."""
    count = lambda x: np.bitwise_count(x).sum(1, dtype=np.int64)[:, None]
    sure, tied = np.zeros_like(total[0]), np.bitwise_or.reduce(total, 0)
    for level in total[::-1]:
        higher = tied & level
        n = count(sure | higher)
        sure = np.where(n <= k, sure | higher, sure)
        tied = np.where(n > k, higher, np.where(n < k, tied & ~level, np.uint64(0)))
    left = k - count(sure)
    bits = np.unpackbits(tied.view(np.uint8), axis=1, bitorder="little")
    bits &= np.cumsum(bits, axis=1, dtype=np.int32) <= left
    return sure | np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


class Ranker:
    """The best ``k`` of every query over the blocks seen."""

    def __init__(self, queries: Queries, weight: np.ndarray, documents: int, length: int, k: int):
        self.queries, self.weight, self.documents, self.length, self.k = queries, weight, documents, length, k
        # queries of many terms first: those that still have terms are the first ones at any time
        self.order = sorted(range(len(queries.names)), key=lambda q: -len(queries.terms[q]))
        self.found = [np.zeros(0, np.int64)] * 4  # query, score, null id, id

    def take(self, ids: pa.Array, n: np.ndarray, term: np.ndarray, df: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> None:
        words = -(-len(n) // 64)
        m = 50 + 50 * n * self.documents // self.length
        impact = np.repeat(self.weight[term], df) * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        here = np.full(len(self.weight) + 1, -1)
        here[term] = np.arange(len(term))
        for start in range(0, len(self.order), TOGETHER):
            own = self.order[start : start + TOGETHER]
            mine = [x[x >= 0] for x in (here[self.queries.terms[q]] for q in own)]
            used = np.unique(np.concatenate(mine))
            if not len(used):
                continue
            at = np.full(len(term), -1)
            at[used] = np.arange(len(used))
            kept = np.flatnonzero((np.repeat(at, df) >= 0) & (impact > 0))
            if not len(kept):
                continue
            key = np.repeat(at, df)[kept] * words + doc[kept] // 64
            part = slices_of(key, (doc[kept] % 64).astype(np.uint64), impact[kept], len(used) * words).reshape(-1, len(used), words)
            longest = np.array([len(x) for x in mine])
            by = np.argsort(-longest, kind="stable")
            grid = np.full((len(own), longest.max()), -1)
            for r, q in enumerate(by):
                grid[r, : longest[q]] = at[mine[q]]
            top = np.zeros(len(used), np.int64)
            np.maximum.at(top, key // words, impact[kept])
            total = np.zeros((int(max(top[x[x >= 0]].sum() for x in grid)).bit_length(), len(own), words), np.uint64)
            for column in grid.T:
                add(total, part, column[column >= 0])
            bits = np.unpackbits(best(total, self.k).view(np.uint8), axis=1, bitorder="little")
            row, place = np.nonzero(bits)
            score = np.zeros(len(row), np.int64)
            for s, level in enumerate(total):
                score |= (((level[row, place // 64] >> (place % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64)) << s
            chosen = ids.take(pa.array(place))
            self._keep(np.array(own)[by[row]], score, chosen.is_null().to_numpy(zero_copy_only=False).astype(np.int64), chosen.fill_null(0).to_numpy())

    def _keep(self, *new: np.ndarray) -> None:
        query, score, null, doc_id = (np.concatenate(x) for x in zip(self.found, new, strict=True))
        order = np.lexsort((doc_id, null, -score, query))
        query = query[order]
        first = np.searchsorted(query, query)
        kept = order[np.arange(len(order)) - first < self.k]
        self.found = [np.concatenate(x)[kept] for x in zip(self.found, new, strict=True)]


def _ranked(index: DataFrame, queries: Queries, weight: np.ndarray, documents: int, length: int, k: int, name: T.DataType) -> DataFrame:
    """(item_id, doc_id, score): each task's best of every query."""
    schema = T.StructType([T.StructField("item_id", name), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(queries, weight, documents, length, k)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, *rest = (batch.column(c)[i].values for c in _BLOCK.names)
                ranker.take(ids, *(x.to_numpy().astype(np.int64) for x in rest))
        query, score, null, doc_id = ranker.found
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array([queries.names[q] for q in query]), pa.array(doc_id, mask=null > 0), pa.array(score)], schema.names)

    return index.mapInArrow(run, schema)


def search(df: DataFrame, items: DataFrame, k: int = K, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score above 0 for each item."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    name = items.schema[item_id].dataType
    out, shares = None, 1
    with scratch.temporary(spark) as kept:
        for queries in query_blocks(items, item_id, item_text):
            if not len(queries.vocab):
                continue
            index = scratch.write_out(postings(docs, queries.vocab), "postings")
            sums = lambda c, f: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + f(x))
            documents, length, blocks = index.agg(F.sum(sums("n", lambda x: (x > 0).cast("long"))), F.sum(sums("n", lambda x: x)), F.count("*")).first()
            if not length:
                continue
            known = index.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df")).toPandas()
            df_of = np.zeros(len(queries.vocab), np.int64)
            df_of[known["term"].to_numpy(np.int64)] = known["df"].to_numpy(np.int64)
            weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df_of + 1))).astype(np.int64)
            found = _ranked(index, queries, weight, documents, length, k, name)
            found = scratch.write_out(found, "ranked")
            kept.append(found)
            out = found if out is None else out.unionByName(found)
            shares = max(shares, -(-blocks // BLOCKS_A_SHARE))
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", name), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    best_first = F.desc("score"), F.asc_nulls_last("doc_id")
    if shares > 1:
        share = F.pmod(F.xxhash64("doc_id"), F.lit(shares))
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", share).orderBy(*best_first))).where(F.col("rank") <= k)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best_first))).where(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH t AS (
  SELECT row, doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)
), f AS (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT row, count(*) AS n FROM t GROUP BY 1), whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len),
q AS (
  SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM benchmark WHERE item_id IS NOT NULL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, whole WHERE term IN (SELECT term FROM q) GROUP BY term, docs
), s AS (
  SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN len USING (row), whole GROUP BY ALL
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0
) WHERE rank <= 50
"""
