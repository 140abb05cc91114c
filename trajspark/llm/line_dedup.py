"""Substring deduplication by hashing paragraphs of ``passage_words`` words at every word.

Words are runs of anything but space, tab, LF, VT, FF, CR; A-Z are lower-cased. Every
paragraph (so many words on end, whatever lines they stand in) is a unit. Digests are
grouped over all documents; the occurrence that ranks first, by (id, text hash, place),
stays and every word of any other occurrence goes, with its place in the original text
kept. An occurrence in the document of the first one goes only if it doesn't overlap it.

Not every paragraph travels:

1. Texts of the same words are one class. Its first text stands for it; in the others
   all paragraphs are repeated.
2. Of the ``SAMPLE``-word hashes in a paragraph the least is its sample, so equal
   paragraphs have equal samples: some five samples for a hundred words, grouped by hash.
3. Only paragraphs that hold a sample met at two places are hashed, grouped and joined
   with the first occurrence. Both joins are of written tables, so that adaptive
   execution splits a hot digest.

Defined results: null text stays null and an id of null ranks last; a text of fewer
words than a passage is left alone; a document may lose all words; white space behind a
removed passage goes with it; rows that are alike in id and text are one document
repeated and fare alike; other columns pass through, except that columns named as
outputs are replaced. Very long texts are a slice of their own. Paragraphs are known by
64-bit hashes, texts of a class by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.llm import kernels, scratch

#: Passages of over 50 words.
PASSAGE_WORDS = 51
#: Words of a sample.
SAMPLE = 12
#: Bytes of text that are worked on at a time: hashes and their sums take some fifty times as much.
SLICE = 1 << 19
#: Rows and places of a table that is sent to all tasks at most (a few ten MB); beyond, texts are shuffled to it.
BROADCAST_ROWS, BROADCAST_PLACES = 1 << 18, 1 << 22

_SALT = np.uint64(0x5851F42D4C957F2D)


def _least(values: np.ndarray, width: int, use) -> np.ndarray:
    """``use`` (np.minimum or np.maximum) over each ``width`` values on end; shorter by width - 1."""
    span, out = 1, values
    while 2 * span <= width:
        out = use(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return use(out[:-rest], out[rest:]) if rest else out


def samples(words: np.ndarray, counts: np.ndarray, passage: int) -> np.ndarray:
    """Places (in ``words``) of the samples of all passages within a text."""
    grams = passage - SAMPLE + 1
    if len(words) < passage:
        return np.zeros(0, np.int64)
    place = np.arange(len(words) - SAMPLE + 1)
    hashed = np.maximum(kernels.run_hashes(words, place, place + SAMPLE), np.uint64(1))
    least = _least(hashed, grams, np.minimum)
    room = np.repeat(np.cumsum(counts), counts)[: len(least)] - np.arange(len(least))
    least = np.where(room >= passage, least, np.uint64(0))
    edge = np.zeros(grams - 1, np.uint64)
    return np.flatnonzero(_least(np.concatenate([edge, least, edge]), grams, np.maximum) == hashed)


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, words per text) of a slice."""
    raw, offsets = kernels.buffers(text)
    starts, ends, counts = kernels.word_spans(raw, offsets, kernels.SPACED)
    return kernels.word_hashes(raw, starts, ends), counts


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _index(docs: DataFrame, passage: int) -> DataFrame:
    """(id, hash, class, n, digest, at) of texts of a passage's words or more; samples only where the task first meets the class."""

    @kernels.trimmed
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in kernels.slices(batch, limit=SLICE):
                words, counts = _words(part.column("text"))
                edge = np.cumsum(counts)
                with np.errstate(over="ignore"):
                    sides = [kernels.run_hashes(words ^ salt, edge - counts, edge) + counts.astype(np.uint64) for salt in (np.uint64(0), _SALT)]
                packed = np.stack([s.astype(">u8") for s in sides], axis=1).tobytes()
                classes = [packed[i : i + 16] for i in range(0, len(packed), 16)]
                long = counts >= passage
                new = np.array([ok and not (k in seen or seen.add(k)) for ok, k in zip(long, classes, strict=True)], bool)
                at = samples(words, counts, passage)
                owner = np.searchsorted(edge, at, side="right")
                at, owner = at[new[owner]], owner[new[owner]]
                digest = kernels.run_hashes(words, at, at + SAMPLE).view(np.int64)
                made = np.bincount(owner, minlength=len(counts))
                rows = pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("hash"), pa.array(classes, pa.binary()), pa.array(counts, pa.int64()), _lists(digest, made, pa.int64()), _lists((at - (edge - counts)[owner]), made, pa.int32())],
                    ["id", "hash", "class", "n", "digest", "at"],
                )
                yield rows.filter(pa.array(long))

    kinds = T.StructType([docs.schema["id"], T.StructField("hash", T.LongType()), T.StructField("class", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("digest", T.ArrayType(T.LongType())), T.StructField("at", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(emit, kinds)


def _paragraphs(docs: DataFrame, passage: int) -> DataFrame:
    """(id, hash, digest, at): the paragraphs that hold a sample at one of the places in the column ``at``."""

    @kernels.trimmed
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, limit=SLICE):
                words, counts = _words(part.column("text"))
                edge = np.cumsum(counts)
                held = part.column("at")
                owner = np.repeat(np.arange(len(counts)), held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                at = held.flatten().to_numpy().astype(np.int64) + (edge - counts)[owner]
                # A sample at p is in the paragraphs that begin at p - (passage - SAMPLE) to p.
                delta = np.zeros(len(words) + 1, np.int64)
                np.add.at(delta, np.maximum(at - (passage - SAMPLE), (edge - counts)[owner]), 1)
                np.add.at(delta, np.maximum(np.minimum(at + 1, edge[owner] - passage + 1), (edge - counts)[owner]), -1)
                begin = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
                made = np.bincount(np.searchsorted(edge, begin, side="right"), minlength=len(counts))
                place = begin - np.repeat(edge - counts, made)
                digest = kernels.run_hashes(words, begin, begin + passage).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("hash"), _lists(digest, made, pa.int64()), _lists(place, made, pa.int32())], ["id", "hash", "digest", "at"])

    kinds = T.StructType([docs.schema["id"], T.StructField("hash", T.LongType()), T.StructField("digest", T.ArrayType(T.LongType())), T.StructField("at", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(emit, kinds)


def _checked(asked: DataFrame, places: str) -> DataFrame:
    """A written table of documents with a list of ``places``, marked to be sent to all tasks if it is small, so that texts needn't be shuffled to it."""
    rows, n = asked.agg(F.count("*"), F.coalesce(F.sum(F.size(places)), F.lit(0))).first()
    return F.broadcast(asked) if rows <= BROADCAST_ROWS and n <= BROADCAST_PLACES else asked


def _runs(at: Column, width: int) -> list[Column]:
    """begin and end of the runs of words that stretches of ``width`` words at the given places cover; what touches is one run."""
    none = F.array(F.lit(None).cast("int"))
    ahead, behind = F.concat(at, none), F.concat(none, at)
    apart = lambda x, p: x.isNull() | p.isNull() | (x > p + width)
    begin = F.zip_with(ahead, behind, lambda x, p: F.when(apart(x, p), x))
    end = F.zip_with(ahead, behind, lambda x, p: F.when(apart(x, p), p + width))
    return [F.array_compact(begin).alias("begin"), F.array_compact(end).alias("end")]


def _met_again(placed: DataFrame, *place: str) -> DataFrame:
    """(digest, first): digests met at two places or more, and the first place."""
    where = F.struct(*place)
    return placed.groupBy("digest").agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first <> last").select("digest", "first")


def repeated(df: DataFrame, id_col: str = "doc_id", text: str = "text", passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """(id, hash, whole, begin, end): documents with repeated passages; whole: all of it; else the runs of words that such passages cover."""
    with scratch.temporary(df.sparkSession) as kept:
        found = scratch.write_out(_repeated(df, id_col, text, passage_words), "passage-repeated")
        kept.append(found)
    return found


def _repeated(df: DataFrame, id_col: str, text: str, passage_words: int) -> DataFrame:
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text}`").alias("hash"), F.col(f"`{text}`").alias("text"))
    index = scratch.write_out(_index(docs, passage_words), "passage-samples")
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "hash")
    classes = scratch.write_out(index.groupBy("class").agg(F.min(rank).alias("first"), F.max(rank).alias("last")), "passage-classes")
    copies = index.join(classes.where("first <> last").select("class", "first"), "class").where(rank != F.col("first")).select("id", "hash").distinct()
    sampled = index.select("class", F.explode(F.arrays_zip("digest", "at")).alias("s")).select("class", "s.digest", "s.at")
    flagged = scratch.write_out(_met_again(sampled, "class", "at").select("digest"), "passage-flagged")
    places = sampled.join(flagged, "digest").groupBy("class").agg(F.collect_set("at").alias("at"))
    asked = scratch.write_out(places.join(classes, "class").select(F.col("first.id").alias("_i"), F.col("first.hash").alias("_h"), "at"), "passage-asked")
    wanted = docs.join(_checked(asked, "at"), F.col("id").eqNullSafe(F.col("_i")) & (F.col("hash") == F.col("_h"))).select("id", "hash", "text", "at")
    found = scratch.write_out(_paragraphs(wanted, passage_words), "passage-paragraphs")
    placed = found.select(F.col("id").isNull().alias("no_id"), "id", "hash", F.explode(F.arrays_zip("digest", "at")).alias("s")).select("no_id", "id", "hash", "s.digest", "s.at")
    first = scratch.write_out(_met_again(placed, "no_id", "id", "hash", "at"), "passage-first")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("hash") == F.col("first.hash"))
    again = placed.join(first, "digest").where(~same | (F.col("at") >= F.col("first.at") + passage_words))
    starts = again.groupBy("id", "hash").agg(F.array_sort(F.collect_set("at")).alias("at"))
    none = F.array().cast("array<int>")
    return starts.select("id", "hash", F.lit(False).alias("whole"), *_runs(F.col("at"), passage_words)).union(copies.select("id", "hash", F.lit(True), none, none))


def dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """``df`` with repeated passages taken from its text, n_removed (words) and removed_spans

    (start and end of each run of removed words in the original text, in code points,
    the white space behind it not included).
    """
    own = ["n_removed", "removed_spans"]
    base = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in own))
    gone = repeated(base, id_col, text, passage_words)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    kept = base.columns
    packed = base.select(F.struct(*(F.col(f"`{c}`") for c in kept if c != text)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text}`").alias("hash"), F.col(f"`{text}`").alias("text"))
    found = packed.join(_checked(gone.select(F.col("id").alias("_i"), F.col("hash").alias("_h"), "whole", "begin", "end"), "begin"), F.col("id").eqNullSafe(F.col("_i")) & (F.col("hash") == F.col("_h")), "left").select("row", "text", "whole", "begin", "end")

    @kernels.trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, limit=SLICE):
                raw, offsets = kernels.buffers(part.column("text"))
                starts, ends, counts = kernels.word_spans(raw, offsets, kernels.SPACED)
                edge = np.cumsum(counts)
                whole, begin, end, body = part.column("whole").to_pylist(), part.column("begin"), part.column("end"), part.column("text")
                texts, number, places = [], [], []
                for r in range(part.num_rows):
                    if whole[r] is None:
                        texts.append(body[r].as_py())
                        number.append(0)
                        places.append([])
                        continue
                    low, high = edge[r] - counts[r], edge[r]
                    delta = np.zeros(counts[r] + 1, np.int64)
                    delta[0 if whole[r] else begin[r].values.to_numpy()] += 1
                    delta[counts[r] if whole[r] else end[r].values.to_numpy()] -= 1
                    out = np.concatenate([[False], np.cumsum(delta[:-1]) > 0, [False]]).astype(np.int8)
                    a, b = np.flatnonzero(np.diff(out) == 1), np.flatnonzero(np.diff(out) == -1)
                    lead = np.concatenate([[0], np.cumsum((raw[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80)])
                    places.append([{"start": int(x), "end": int(y)} for x, y in zip(lead[starts[low + a] - offsets[r]], lead[ends[low + b - 1] - offsets[r]], strict=True)])
                    number.append(int((b - a).sum()))
                    following = np.append(starts[low:high], offsets[r + 1])
                    edges = np.concatenate([[offsets[r]], np.stack([following[a], following[b]], 1).ravel(), [offsets[r + 1]]])
                    texts.append(b"".join(raw[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)).decode())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array(number, pa.int64()), pa.array(places, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["row", "text", *own])

    kinds = T.StructType([found.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", spans)])
    return found.mapInArrow(cut, kinds).select(*(F.col("text").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in kept), *own)


#: Over documents, whose doc_id has no null and no repeats.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS parts, regexp_extract(text, '^[\x20\x09-\x0D]*') AS head FROM documents
), w AS (
  SELECT doc_id, head, parts, list_transform(parts, lambda x: translate(regexp_replace(x, '[\x20\x09-\x0D]+', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM d
), p AS (
  SELECT doc_id, beg, array_to_string(ws[beg:beg + {words} - 1], ' ') AS unit FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {words} + 2)) AS beg FROM w WHERE len(ws) >= {words})
), f AS (
  SELECT doc_id, beg, first_value(doc_id) OVER o AS d0, first_value(beg) OVER o AS a0 FROM p WINDOW o AS (PARTITION BY unit ORDER BY doc_id, beg)
), g AS (
  SELECT DISTINCT doc_id, unnest(range(beg, beg + {words})) AS i FROM f WHERE doc_id <> d0 OR beg >= a0 + {words}
), e AS (
  SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM w
), k AS (
  SELECT e.*, g.i IS NOT NULL AS gone, length(head) + coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY e.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
    coalesce(lag(g.i IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY e.i), false) AS before, coalesce(lead(g.i IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY e.i), false) AS behind
  FROM e JOIN w USING (doc_id) LEFT JOIN g ON g.doc_id = e.doc_id AND g.i = e.i
), t AS (
  SELECT doc_id, string_agg(part, '' ORDER BY i) FILTER (NOT gone) AS rest, count(*) FILTER (gone) AS n,
    string_agg(CASE WHEN gone AND NOT before THEN CAST(place AS BIGINT) || '-' ELSE '' END
      || CASE WHEN gone AND NOT behind THEN CAST(place + length(regexp_replace(part, '[\x20\x09-\x0D]+$', '')) AS BIGINT) || ',' ELSE '' END, '' ORDER BY i) AS spans
  FROM k GROUP BY doc_id
)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN head || coalesce(rest, '') END AS text, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(rtrim(spans, ','), '') AS removed_offsets
FROM d LEFT JOIN t USING (doc_id)
"""
