"""Filter interaction audit by a fingerprint-routed RDD.

Five filters judge every whole text; their outcomes are the bits of a mask. Rows
are routed by the xxhash of their text to partitions that hold, for each
fingerprint, a collision chain: the full text of each different text and the
minimum id seen. Copies with a larger id are non-minimum ids and leave at once.
``combineByKey`` then merges, for each part of the corpus, vectors of counts by
mask, from which every order of the filters is worked out.

Copies that meet in the task that reads them are settled there: one row a text
and buffer is routed with its text, the others as a few numbers, dealt evenly. So
a text of any number of copies reaches its partition at most once for every
``BUFFER_BYTES`` read. Routed rows are sorted by fingerprint (on disk, if need be),
and a task holds one chain at a time.

Filters, on words (runs of anything but space, tab, line feed, VT, FF, CR):
A fewer than 50 words; B under 65 % different words; C over 5 % A-Z; D any of
``#$%&*|``; E the text is that of a smaller id, removed or not.

Defined results: null text counts as empty (and fails A); a null part counts as the
empty string; a null id is neither smaller nor larger than any, so such rows never
fail E; rows of equal id and text don't make each other fail E; several labels of an
id count as the highest of each kind, labels of null ids are ignored, a missing or
null label counts for neither; very long texts are judged whole; other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS = 50
#: Texts held by a reading task to find copies among them.
BUFFER_BYTES = 8 << 20
#: Text of a routed partition, if no text were a copy; their number follows from all texts' bytes.
ROUTED_BYTES = 32 << 20

_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"
_E = 1 << 4
_SLIM = "doc_id long, part string, mask int, salt int"
_RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failed(text: str) -> int:
    """Mask of the filters A to D that a text fails (bit 0: A)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    tests = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < 65 * len(words),
        100 * (len(raw) - len(raw.translate(None, _UPPER))) > 5 * len(text),
        len(raw.translate(None, _SYMBOLS)) < len(raw),
    )
    return sum(1 << k for k, bad in enumerate(tests) if bad)


class Chain:
    """Different texts of one fingerprint, each with its mask, minimum id and the rows that have it."""

    def __init__(self):
        self.links: list[list] = []  # text, mask, minimum id, {part: rows}

    def add(self, text: str, mask: int | None, doc_id: int, part: str, rows: int) -> Iterator[tuple[int, str, int, int]]:
        """Take in rows; gives (id, part, mask, rows) of those that are known now not to be the minimum."""
        for link in self.links:
            if link[0] == text:
                break
        else:
            link = [text, failed(text) if mask is None else mask, doc_id, {}]
            self.links.append(link)
        if doc_id > link[2]:
            yield doc_id, part, link[1] | _E, rows
            return
        if doc_id < link[2]:
            yield from ((link[2], p, link[1] | _E, n) for p, n in link[3].items())
            link[2], link[3] = doc_id, {}
        link[3][part] = link[3].get(part, 0) + rows

    def settled(self) -> Iterator[tuple[int, str, int, int, int]]:
        """(id, part, mask, rows, 0) of the minimum ids, when all rows have been seen."""
        return ((doc_id, part, mask, rows, 0) for _, mask, doc_id, part, rows in self.rest())

    def rest(self) -> Iterator[tuple[str, int, int, str, int]]:
        """(text, mask, id, part, rows) of the minimum ids."""
        for text, mask, doc_id, parts in self.links:
            for part, rows in parts.items():
                yield text, mask, doc_id, part, rows


def _read(rows: Iterable[tuple[int | None, str, str, int]]) -> Iterator[tuple[int, tuple]]:
    """From (id, part, text, fingerprint): (key, (id, part, mask, rows)) of settled rows, keyed evenly, and (fingerprint, (text, mask, id, part, rows)) of the others."""
    chains: dict[int, Chain] = {}
    held = settled = 0
    for doc_id, part, text, fingerprint in rows:
        if doc_id is None:
            settled += 1
            yield fingerprint + settled, (None, part, failed(text), 1)
            continue
        chain = chains.setdefault(fingerprint, Chain())
        before = len(chain.links)
        for row in chain.add(text, None, doc_id, part, 1):
            settled += 1
            yield row[0] + settled, row
        if len(chain.links) > before:
            held += len(text) + 200
        if held > BUFFER_BYTES:
            yield from ((f, link) for f, c in chains.items() for link in c.rest())
            chains, held = {}, 0
    yield from ((f, link) for f, c in chains.items() for link in c.rest())


def _met(routed: Iterable[tuple[int, tuple]]) -> Iterator[tuple[int | None, str, int, int, int]]:
    """(id, part, mask, rows, salt) of all rows of a partition that is sorted by fingerprint; salt spreads null ids, others have 0."""
    chain, at = Chain(), None
    for key, row in routed:
        if len(row) == 4:
            yield *row, key % 1024 if row[0] is None else 0
            continue
        if key != at:
            yield from chain.settled()
            chain, at = Chain(), key
        text, mask, doc_id, part, n = row
        yield from ((*settled, 0) for settled in chain.add(text, mask, doc_id, part, n))
    yield from chain.settled()


def masks(df: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """(doc_id, part, mask, salt): of every row the filters that it fails; salt spreads null ids, others have 0."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.col(f"`{doc_id}`").cast("long"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")), body, F.xxhash64(body)).rdd
    held = df.agg(F.sum(F.octet_length(body))).first()[0] or 0
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // ROUTED_BYTES))
    routed = rows.mapPartitions(_read).repartitionAndSortWithinPartitions(n, partitionFunc=lambda key: key)
    slim = routed.mapPartitions(_met).flatMap(lambda r: (r[:3] + r[4:] for _ in range(r[3])))
    return df.sparkSession.createDataFrame(slim, _SLIM, verifySchema=False)


def _vector(seen: tuple[int, int, int]) -> np.ndarray:
    return _merge(np.zeros((3, 32), np.int64), seen)


def _merge(vector: np.ndarray, seen: tuple[int, int, int]) -> np.ndarray:
    mask, good, toxic = seen
    vector[0, mask] += 1
    vector[1, mask] += good
    vector[2, mask] += toxic
    return vector


def counts(labelled: DataFrame) -> RDD:
    """(part, vector) from (part, mask, good, toxic): rows, good and toxic ones by mask."""
    return labelled.rdd.map(lambda r: (r[0], (r[1], r[2], r[3]))).combineByKey(_vector, _merge, np.add)


def report(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """The result rows of a part, for all orders of the filters."""
    every = np.arange(32)
    fails = [(every >> k) & 1 == 1 for k in range(5)]
    size = np.bitwise_count(every)
    # in the orders of five filters, each of those that a row fails is met first equally often
    shapley = [int((vector[0] * (120 // np.maximum(size, 1)))[f].sum()) for f in fails]
    for order in permutations(range(5)):
        gone = np.zeros(32, bool)
        for step, k in enumerate(order, 1):
            here, before = fails[k] & ~gone, int(vector[0][fails[k] & gone].sum())
            gone |= fails[k]
            removed, good, toxic = (int(v[here].sum()) for v in vector)
            yield part, "".join(FILTERS[i] for i in order), step, int(vector[0][~gone].sum()), removed, before, int(vector[0][1 << k]), good, toxic, shapley[k]


def audit(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source", label_id: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """One row for each part, order of the five filters and step: what the step's filter removes there and why."""
    flag = lambda c: F.coalesce(F.max((F.col(f"`{c}`") == 1).cast("int")), F.lit(0))
    known = labels.select(F.col(f"`{label_id}`").cast("long").alias("doc_id"), f"`{good}`", f"`{toxic}`").where("doc_id is not null").groupBy("doc_id").agg(flag(good).alias("good"), flag(toxic).alias("bad"))
    labelled = masks(df, text, doc_id, part).join(known.withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left").select("part", "mask", F.coalesce("good", F.lit(0)), F.coalesce("bad", F.lit(0)))
    return df.sparkSession.createDataFrame(counts(labelled).flatMap(lambda x: report(*x)), _RESULT, verifySchema=False)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY 1
), m AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
    || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS mask,
    count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k), o AS (
  SELECT p.k || q.k || r.k || s.k || t.k AS filter_order FROM letter p, letter q, letter r, letter s, letter t
  WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5
), s AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS k, n, good, bad, mask,
    contains(mask, substr(filter_order, step, 1)) AS fails,
    translate(mask, substr(filter_order, 1, step - 1), '') <> mask AS gone
  FROM m, o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, k, sum(CASE WHEN fails OR gone THEN 0 ELSE n END) AS kept,
    sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = k THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails AND NOT gone THEN bad ELSE 0 END) AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM r
"""
