"""Stupid-backoff scores of texts under an n-gram model of the whole corpus.

The n-gram count table is partitioned by hash range. Documents are dealt to chunks
by hash; a chunk lists its distinct words and pairs with their counts, cut by hash
range. A range sums all lists into its part of the table and joins it back to them:
the counts in other chunks, in the order of the lists, return to their chunks. A second
round does the same for longer n-grams, but lists only those whose pairs all occur in
other chunks: the rest can't occur there. Then the documents' exploded n-grams look up
their counts and the log scores are summed per document. An n-gram is sent once a
chunk, however frequent it is, so no key is hot.

A document is left out of the counts it is scored by. Word i has, for the longest
history of up to order - 1 words in the text, the score count(history, word) /
count(history) if the first is positive, else ``ALPHA`` times that of the history
without its first word; at last count(word) / N, and half a count for words unseen.
A history is counted as an n-gram of its own.

Words are runs of anything but space, tab, LF, VT, FF, CR; A-Z are lower-cased.
Defined results: null or empty text has no words, log score 0 and a null mean;
copies are scored from each other, repeated rows too; a very long text is a chunk's
bulk or more, never cut; other columns pass through, whatever their names, columns named
as outputs are replaced. N-grams are known by 64-bit hashes. A list of c chunks and r
ranges has c * r pieces: beyond some terabytes these get small, down to an n-gram each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.llm import kernels

ORDER = 3
ALPHA = 0.4
#: Text of a chunk and n-grams of a hash range, about; both are what a task holds.
CHUNK_BYTES = 7 << 20
RANGE_ROWS = 2_000_000
#: Bits of an n-gram's hash: of n different ones, each shares its hash with another at odds of n / 2^64.
KEY_BITS = 64
#: Stands for the number of all words.
_TOTAL = np.uint64(0)
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def ngrams(words: np.ndarray, counts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length 1..order: places of the last word, and hashes, of n-grams within a text."""
    start = np.repeat(np.cumsum(counts) - counts, counts)
    place = np.arange(len(words))
    out = []
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(words), np.uint64)
        for k in range(1, order + 1):
            if k > 1:
                before = np.concatenate([[np.uint64(0)], rolled[:-1]])
                rolled = before * _BASE + words
            else:
                rolled = words.copy()
            inside = place - start >= k - 1
            out.append((place[inside], np.maximum(kernels.mix(rolled[inside] + np.uint64(k)) >> np.uint64(64 - KEY_BITS), np.uint64(1))))
    return out


def pack(values: np.ndarray) -> bytes:
    """Numbers by planes of bytes, entropy-coded: small ones take few bits."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and words per text."""
    parts, counts = [], []
    at, edges = 0, kernels.buffers(text)[1]
    while at < len(text):
        upto = max(at + 1, int(np.searchsorted(edges, edges[at] + kernels.SLICE_BYTES, side="right")) - 1)
        raw, offsets = kernels.buffers(text[at:upto])
        starts, ends, n = kernels.word_spans(raw, offsets, kernels.SPACED)
        parts.append(kernels.word_hashes(raw, starts, ends))
        counts.append(n)
        at = upto
    return (np.concatenate(parts), np.concatenate(counts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


Listed = tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]


def _listed(grams: list[tuple[np.ndarray, np.ndarray]], total: int | None = None) -> Listed:
    """Distinct hashes of all given orders, sorted; their counts; places and indices by order. With total: _TOTAL comes first."""
    first = [np.full(1, _TOTAL)] if total is not None else [np.zeros(0, np.uint64)]
    keys, index, times = np.unique(np.concatenate(first + [h for _, h in grams]), return_inverse=True, return_counts=True)
    if total is not None:
        times[0] = total
    cuts = np.cumsum([len(first[0])] + [len(h) for _, h in grams])
    return keys, times, [(p, index[a:b]) for (p, _), a, b in zip(grams, cuts[:-1], cuts[1:], strict=True)]


def _asked(words: int, short: Listed, others: np.ndarray, long: Listed) -> np.ndarray:
    """Which of the long n-grams' keys may occur in other chunks: all of their pairs do."""
    place, index = short[2][1]
    pair = np.zeros(words, bool)
    pair[place] = others[index] > 0
    run = pair.copy()
    asked = np.zeros(len(long[0]), bool)
    for place, index in long[2]:
        run = run & np.concatenate([[False], pair[:-1]])
        pair = np.concatenate([[False], pair[:-1]])
        asked[index[run[place]]] = True
    return asked


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(ranges)) >> np.uint64(32)


def log_scores(n: np.ndarray, listed: list[tuple[np.ndarray, np.ndarray]], total: np.ndarray, alpha: float) -> np.ndarray:
    """Log score of every word. total: corpus counts of the listed n-grams."""
    words = int(n.sum())
    doc = np.repeat(np.arange(len(n)), n)
    others = (total[0] - np.repeat(n, n)).astype(np.float64)
    left = []  # by order: counts without the own document, by place of the last word; -1: no such n-gram
    for place, index in listed:
        count = np.full(words, -1, np.int64)
        _, back, own = np.unique(doc[place] * np.int64(len(total)) + index, return_inverse=True, return_counts=True)
        count[place] = total[index] - own[back]
        left.append(count)
    score = np.log(np.where(left[0] > 0, left[0], 0.5)) - np.log(np.maximum(others, 0.5))
    for k in range(1, len(left)):
        history = np.concatenate([np.full(1, -1), left[k - 1][:-1]])
        seen, able = left[k] > 0, left[k] >= 0
        ratio = np.log(np.where(seen, left[k], 1)) - np.log(np.where(seen, np.maximum(history, 1), 1))
        score = np.where(seen, ratio, np.where(able, score + np.log(alpha), score))
    return score


def score(df: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """Add n_words, log_score (natural log, summed over words) and mean_log_score to every row."""
    own = ["n_words", "log_score", "mean_log_score"]
    spark = df.sparkSession
    columns = [c for c in df.columns if c not in own]
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 6 * order // RANGE_ROWS)
    chunk = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text}`"), F.spark_partition_id()), F.lit(int(chunks))).cast("int")
    dealt = df.select(F.struct(*(F.col(f"`{c}`") for c in columns if c != text)).alias("row"), F.col(f"`{text}`").alias("text"), chunk.alias("chunk"))
    lists, counts = "chunk int, range int, keys binary, counts binary", "chunk int, range int, totals binary"

    def body(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, Listed, list]:
        words, n = _words(docs.column("text").combine_chunks() if docs.num_rows else pa.array([], pa.string()))
        grams = ngrams(words, n, order)
        return words, n, _listed(grams[:2], len(words)), grams[2:]

    def pieces(chunk: int, keys: np.ndarray, times: np.ndarray) -> pa.Table:
        edge = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))
        filled = np.flatnonzero(np.diff(edge))
        part = [slice(edge[r], edge[r + 1]) for r in filled]
        gaps = [np.diff(keys[p], prepend=np.uint64(0)) for p in part]
        return pa.table({"chunk": pa.array([chunk] * len(part), pa.int32()), "range": pa.array(filled, pa.int32()), "keys": pa.array([pack(g) for g in gaps], pa.binary()), "counts": pa.array([pack(times[p].astype(np.uint32)) for p in part], pa.binary())})

    def joined(answers: pa.Table, long: bool) -> np.ndarray:
        """Counts in other chunks, in the order of the list."""
        rows = zip(*(answers.column(c).to_pylist() for c in ("long", "range", "totals")), strict=True)
        parts = sorted((r, x) for of, r, x in rows if of == long)
        return np.concatenate([unpack(x, np.int64) for _, x in parts]) if parts else np.zeros(0, np.int64)

    def ask(key, docs):
        _, _, short, _ = body(docs)
        return pieces(key[0].as_py(), *short[:2])

    def ask_long(key, docs, answers):
        words, _, short, grams = body(docs)
        long = _listed(grams)
        asked = _asked(len(words), short, joined(answers, False), long)
        return pieces(key[0].as_py(), long[0][asked], long[1][asked])

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        every = np.concatenate(keys)
        times = np.concatenate([unpack(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        by = np.argsort(every)
        head = np.flatnonzero(np.concatenate([[True], every[by][1:] != every[by][:-1]]))
        total = np.add.reduceat(times[by], head)
        found = np.empty(len(every), np.int64)
        found[by] = np.repeat(total, np.diff(np.append(head, len(by))))
        found -= times  # most n-grams are nowhere else, and zeros compress
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "totals": pa.array([pack(x) for x in np.split(found, cuts)], pa.binary())})

    def settle(docs: pa.Table, answers: pa.Table) -> pa.Table:
        words, n, short, grams = body(docs)
        others = joined(answers, False)
        total, listed = others + short[1], list(short[2])
        if grams:
            long = _listed(grams)
            asked = _asked(len(words), short, others, long)
            more = long[1].astype(np.int64)
            more[asked] += joined(answers, True)
            listed += [(place, index + len(total)) for place, index in long[2]]
            total = np.concatenate([total, more])
        scored = log_scores(n, listed, total, alpha)
        edge = np.concatenate([[0], np.cumsum(n)])
        summed = np.array([scored[a:b].sum() for a, b in zip(edge[:-1], edge[1:], strict=True)], float)
        mean = np.divide(summed, n, out=np.zeros(len(n)), where=n > 0)
        return pa.table({"row": docs.column("row"), "text": docs.column("text"), "n_words": pa.array(n, pa.int64()), "log_score": pa.array(summed, pa.float64()), "mean_log_score": pa.array(mean, pa.float64(), mask=n == 0)})

    def table_of(asked: DataFrame, long: bool) -> DataFrame:
        return asked.groupBy("range").applyInArrow(answer, counts).withColumn("long", F.lit(long))

    answers = table_of(dealt.groupBy("chunk").applyInArrow(ask, lists), False)
    if order > 2:
        answers = answers.union(table_of(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask_long, lists), True))
    schema = T.StructType([dealt.schema["row"], dealt.schema["text"], T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("mean_log_score", T.DoubleType())])
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(settle, schema)
    return out.select(*(F.col("text").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in columns), *own)


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents)
), g AS (
  SELECT doc_id, i, word AS g1, lag(word) OVER o || ' ' || word AS g2, lag(word, 2) OVER o || ' ' || lag(word) OVER o || ' ' || word AS g3,
    lag(word) OVER o AS h1, lag(word, 2) OVER o || ' ' || lag(word) OVER o AS h2
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), d AS (
  SELECT doc_id, gram, count(*) AS own FROM (
    SELECT doc_id, unnest([g1, g2, g3]) AS gram FROM g) WHERE gram IS NOT NULL GROUP BY ALL
), c AS (SELECT *, sum(own) OVER (PARTITION BY gram) - own AS rest FROM d
), n AS (SELECT doc_id, n_words, sum(n_words) OVER () - n_words AS others FROM (SELECT doc_id, count(*) AS n_words FROM g GROUP BY 1)
), s AS (
  SELECT g.doc_id, n_words, CASE
    WHEN c3.rest > 0 THEN ln(c3.rest) - ln(k2.rest)
    ELSE (CASE WHEN g3 IS NULL THEN 0 ELSE ln(0.4) END) + CASE
      WHEN c2.rest > 0 THEN ln(c2.rest) - ln(k1.rest)
      ELSE (CASE WHEN g2 IS NULL THEN 0 ELSE ln(0.4) END) + ln(CASE WHEN c1.rest > 0 THEN c1.rest ELSE 0.5 END) - ln(greatest(others, 0.5)) END END AS p
  FROM g JOIN n USING (doc_id) JOIN c c1 ON c1.doc_id = g.doc_id AND c1.gram = g1
    LEFT JOIN c c2 ON c2.doc_id = g.doc_id AND c2.gram = g2 LEFT JOIN c c3 ON c3.doc_id = g.doc_id AND c3.gram = g3
    LEFT JOIN c k1 ON k1.doc_id = g.doc_id AND k1.gram = h1 LEFT JOIN c k2 ON k2.doc_id = g.doc_id AND k2.gram = h2
)
SELECT doc_id, count(p) AS n_words, round(coalesce(sum(p), 0), 3) AS log_score, round(avg(p), 4) AS mean_log_score
FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id
"""
