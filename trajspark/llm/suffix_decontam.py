"""Benchmark decontamination with suffix arrays over the training documents.

Every slice of documents is a shard: its words become a suffix array, in which
each suffix of each benchmark item is found by binary search. That gives for each
window of an item the range of suffixes that start with it, hence every
occurrence; those of consecutive windows at consecutive places join to verbatim
matches, of which each document has its longest. Documents are never shuffled:
shards are searched where they are read.

Only runs of words that the benchmark knows can match, so a shard's array holds
those runs alone; this drops no match. Benchmarks are sent to the executors in
blocks of at most ``BLOCK_BYTES`` of text; further blocks take further passes.

Words are runs of ASCII letters, digits and non-ASCII bytes, with A-Z in lower
case. Defined results: null or empty text has no words and no hits; a null
item_id or item text gives no item; items of equal id count once; repeated rows
and ids are judged row by row; a very long text is a shard of its own; words are known
by 64-bit hashes; columns named as outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.llm import kernels, scratch

WINDOW = 13
#: Benchmark text in one pass.
BLOCK_BYTES = 8 << 20
#: Text of one suffix array.
SHARD_BYTES = 2 << 20
#: Text of a shard that is hashed at a time: hashing takes some fifty bytes for one of text.
HASHED_BYTES = 1 << 19

_STATE = "hit_spans", "items", "longest", "n_hit"


@dataclass
class Block:
    """Some benchmark items: sorted word hashes, items as ids into them, window starts."""

    names: list[str]
    vocab: np.ndarray
    words: np.ndarray
    item: np.ndarray
    end: np.ndarray
    window_at: np.ndarray
    window_size: np.ndarray

    @classmethod
    def of(cls, names: list[str], texts: list[str], window: int) -> Block:
        raw, offsets = kernels.buffers(pa.array(texts, pa.string()))
        starts, ends, counts = kernels.word_spans(raw, offsets, kernels.ALNUM)
        vocab, words = np.unique(kernels.word_hashes(raw, starts, ends), return_inverse=True)
        item = np.repeat(np.arange(len(texts)), counts)
        stop = np.cumsum(counts)
        end = np.repeat(stop, counts)
        size = np.minimum(window, counts)[item] if len(item) else np.zeros(0, np.int64)
        at = np.flatnonzero(np.arange(len(item)) + size <= end)
        return cls(names, vocab, words.astype(np.int64) + 1, item, end, at, size[at])

    def known(self, part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The benchmark's ids of the words of a shard, 0 for others, and the number of words per text."""
        known, counts = [], []
        for piece in kernels.slices(part, text, HASHED_BYTES):
            raw, offsets = kernels.buffers(piece.column(text))
            starts, ends, n = kernels.word_spans(raw, offsets, kernels.ALNUM)
            hashes = kernels.word_hashes(raw, starts, ends)
            i = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1) if len(self.vocab) else None
            known.append(np.zeros(len(hashes), np.int64) if i is None else np.where(self.vocab[i] == hashes, i + 1, 0))
            counts.append(n)
        return np.concatenate(known), np.concatenate(counts)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts in the order of their first ``depth`` words or more (prefix doubling)."""
    n, rank, step = len(text), text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order


def _common(text: np.ndarray, at: np.ndarray, words: np.ndarray, query: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words that text[at:] and words[query:query + size] have in common, pair by pair."""
    found = np.zeros(len(at), np.int64)
    live = np.flatnonzero((at >= 0) & (at < len(text)) & (size > 0))
    k = 0
    while len(live):
        same = text[at[live] + k] == words[query[live] + k]
        live = live[same]
        found[live] = k = k + 1
        live = live[(at[live] + k < len(text)) & (size[live] > k)]
    return found


def bisect(text: np.ndarray, order: np.ndarray, words: np.ndarray, query: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
    """Where words[query:query + size] goes in the suffix array; ``after``: behind all suffixes that start with it."""
    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(order), np.int64)
    while len(live := np.flatnonzero(low < high)):
        middle = (low[live] + high[live]) // 2
        at, q, n = order[middle], query[live], size[live]
        same = _common(text, at, words, q, n)
        whole = same == n
        left = np.where(at + same < len(text), text[np.minimum(at + same, len(text) - 1)], -1)
        right = words[np.minimum(q + same, len(words) - 1)]
        up = np.where(whole, after, left < right)
        low[live[up]] = middle[up] + 1
        high[live[~up]] = middle[~up]
    return low


def search(known: np.ndarray, doc: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of windows in one shard: word place, window size, item, and the verbatim matches they join to: place, item, words.

    known: the benchmark's ids of the shard's words, 0 for others; doc: their texts.
    """
    none = (np.zeros(0, np.int64),) * 6
    if not len(block.window_at) or not len(known):
        return none
    least = int(block.window_size.min())
    cut = np.flatnonzero((known == 0) | np.concatenate([[True], doc[1:] != doc[:-1]]))
    run = np.zeros(len(known), np.int64)
    run[cut] = 1
    run = np.cumsum(run)
    length = np.bincount(run[known > 0], minlength=int(run[-1]) + 1)
    place = np.flatnonzero((known > 0) & (length[run] >= least))
    if not len(place):
        return none
    gap = np.concatenate([[0], np.cumsum(run[place][1:] != run[place][:-1])])
    text = np.zeros(len(place) + int(gap[-1]) + 1, np.int64)
    where = np.full(len(text), -1, np.int64)
    spot = np.arange(len(place)) + gap
    text[spot], where[spot] = known[place], place
    order = suffix_array(text, int((block.end - np.arange(len(block.end))).max()))

    every = np.arange(len(block.words))
    rest = block.end - every
    low = bisect(text, order, block.words, every, rest, after=False)
    before = np.where(low > 0, order[np.maximum(low - 1, 0)], -1)
    behind = np.where(low < len(order), order[np.minimum(low, len(order) - 1)], -1)
    a, b = _common(text, before, block.words, every, rest), _common(text, behind, block.words, every, rest)
    live = np.maximum(a, b)[block.window_at] >= block.window_size
    start, size = block.window_at[live], block.window_size[live]
    if not len(start):
        return none
    first = bisect(text, order, block.words, start, size, after=False)
    count = bisect(text, order, block.words, start, size, after=True) - first
    spread = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    found, size, window = where[order[spread]], np.repeat(size, count), np.repeat(start, count)
    item = block.item[window]
    return found, size, item, *_matches(found, size, item, window, doc)


def _matches(place: np.ndarray, size: np.ndarray, item: np.ndarray, window: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of occurrences that go on by a word in document and item alike: place, item, words."""
    by = np.lexsort((place, place - window))
    p, w, k = place[by], window[by], item[by]
    new = np.concatenate([[True], (np.diff(p) != 1) | (np.diff(w) != 1) | (np.diff(k) != 0) | (np.diff(doc[p]) != 0)])
    first = np.flatnonzero(new)
    return p[first], k[first], size[by[first]] + np.diff(np.append(first, len(p))) - 1


def _union(spans: np.ndarray) -> np.ndarray:
    """Disjoint [start, end) spans that cover the same words, in order."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])
    return np.stack([spans[new, 0], reach[last]], axis=1)


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int) -> Iterator[Block]:
    names: list[str] = []
    texts: list[str] = []
    held = 0
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    for row in rows.toLocalIterator():
        if texts and held + len(row.t) > BLOCK_BYTES:
            yield Block.of(names, texts, window)
            names, texts, held = [], [], 0
        names.append(row.i)
        texts.append(row.t)
        held += len(row.t)
    yield Block.of(names, texts, window)


@kernels.any_names
def mark(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add what the benchmark and each document share.

    Columns: n_words, hit_spans (word places, first and end in turn, that
    occurrences of windows cover), n_hit (words in them), items (ids of items with
    occurring windows, sorted), n_items, longest (item, word place in the text and
    words of the document's longest verbatim match of a window or more, null if none;
    of equally long ones the first in the text, then of the least item id),
    contaminated (a twentieth of the words or more).
    """
    own = ["n_words", "n_items", "contaminated", *_STATE]
    out = df.drop(*own)
    best = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("place", T.LongType()), T.StructField("words", T.LongType())])
    kept = out.columns
    schema = T.StructType([*(out.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField(_STATE[0], T.ArrayType(T.LongType())), T.StructField(_STATE[1], T.ArrayType(T.StringType())), T.StructField(_STATE[2], best), T.StructField(_STATE[3], T.LongType())])
    best_arrow = pa.struct([("item_id", pa.string()), ("place", pa.int64()), ("words", pa.int64())])

    def run(block: Block, again: bool):
        @kernels.trimmed
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in kernels.slices(batch, text, SHARD_BYTES):
                    known, counts = block.known(part, text)
                    n, base = part.num_rows, np.concatenate([[0], np.cumsum(counts)])
                    doc = np.repeat(np.arange(n), counts)
                    place, size, item, best_place, best_item, best_words = search(known, doc, block)
                    spans: dict[int, list[np.ndarray]] = {}
                    names: dict[int, set[str]] = {}
                    if again:
                        for r, (s, x) in enumerate(zip(part.column(_STATE[0]).to_pylist(), part.column(_STATE[1]).to_pylist(), strict=True)):
                            if s:
                                spans[r], names[r] = [np.array(s, np.int64).reshape(-1, 2)], set(x)
                    longest = part.column(_STATE[2]).to_pylist() if again else [None] * n
                    by = np.argsort(doc[place], kind="stable") if len(place) else place
                    edges = np.searchsorted(doc[place][by], np.arange(n + 1)) if len(place) else np.zeros(n + 1, np.int64)
                    for r in np.flatnonzero(np.diff(edges)):
                        mine = by[edges[r] : edges[r + 1]]
                        at = place[mine] - base[r]
                        spans.setdefault(int(r), []).append(np.stack([at, at + size[mine]], axis=1))
                        names.setdefault(int(r), set()).update(block.names[k] for k in np.unique(item[mine]))
                    owner, top = doc[best_place], np.zeros(n, np.int64)
                    np.maximum.at(top, owner, best_words)
                    for j in np.flatnonzero(best_words == top[owner]):
                        r = int(owner[j])
                        new = {"item_id": block.names[best_item[j]], "place": int(best_place[j] - base[r]), "words": int(best_words[j])}
                        if longest[r] is None or (-new["words"], new["place"], new["item_id"]) < (-longest[r]["words"], longest[r]["place"], longest[r]["item_id"]):
                            longest[r] = new
                    covered = [_union(np.concatenate(spans[r])) if r in spans else np.zeros((0, 2), np.int64) for r in range(n)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(part.column(c) for c in kept),
                            pa.array(counts, pa.int64()),
                            pa.array([x.ravel() for x in covered], pa.list_(pa.int64())),
                            pa.array([sorted(names.get(r, ())) for r in range(n)], pa.list_(pa.string())),
                            pa.array(longest, best_arrow),
                            pa.array([int((x[:, 1] - x[:, 0]).sum()) for x in covered], pa.int64()),
                        ],
                        [f.name for f in schema],
                    )

        return of

    for i, block in enumerate(_blocks(benchmark, item_id, item_text, window)):
        out = (scratch.write_out(out, "decontam") if i else out).mapInArrow(run(block, i > 0), schema)
    return out.withColumns({"n_items": F.size("items").cast("long"), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})


def decontaminate(df: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The rows of ``df`` that aren't contaminated, with their own columns only."""
    return mark(df, benchmark, **names).where("not contaminated").select(*(F.col(f"`{c}`") for c in df.columns))
