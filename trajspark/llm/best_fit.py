"""Best-fit packing of token sequences by hierarchical residual packing.

Every text becomes ids and an end id, cut into pieces of at most ``capacity``
tokens. Pieces are dealt by hash into groups of about ``CHUNK``; each group is
packed best fit, longest first. Bins that are full but for ``SLACK`` tokens are
done; the others are items of the next round, in which ``FAN`` groups meet, and
so on up a tree to one group. Texts and ids never leave the task that reads
them: rounds move a few numbers a piece, later ones only what is underfull.

A group hands on its ``CHUNK // FAN`` emptiest underfull bins at most, so no group
ever outgrows ``CHUNK``; bins beyond that are done as they are (all pieces stay).
As pieces are dealt by hash, groups are alike: where one has that many bins that
nothing fits into, the others have no small ones left either.

Defined results: null text counts as empty, and an empty text is one piece, the
end id; strings of special tokens in a text become those tokens; a text of any
length is cut whole; repeated rows and ids (null too) are packed row by row; other
columns are ignored, whatever their names; an empty table gives no rows. The
numbers of sequences follow how the input is read, their count hardly does.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from trajspark.llm import bpe_trie, kernels, scratch

CAPACITY = 4096
#: Items of a group at most (on average, in the first round).
CHUNK = 1 << 16
#: Groups that meet in a round.
FAN = 16
#: Free tokens of a bin that counts as full, as a share of the capacity.
SLACK = 1 / 64
#: Underfull bins whose places are broadcast at most (24 bytes each); more are joined by shuffle.
BROADCAST_BINS = 200_000
#: Bytes of text in a slice: each looks its different words up in a table built of all that are known.
SLICE_BYTES = 8 << 20
#: Strings that take the library's whole way at once.
ASK_AT_ONCE = 50_000
_GROUP_BITS = 22


class _Known:
    """Strings and their ids, as columns; ``ask`` gives the ids and their counts of new strings."""

    def __init__(self, ask: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.ask = ask
        self.clear()

    def clear(self) -> None:
        self.seen = pa.array([""], pa.large_string())  # splitting gives empty strings too
        self.first, self.count, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def _numbered(self, strings: pa.Array) -> np.ndarray:
        """Places of different ``strings`` in ``seen``, where new ones are added."""
        found = pc.index_in(strings, self.seen)
        new = strings.filter(found.is_null())
        at = found.fill_null(-1).to_numpy()
        if len(new):
            ids, count = self.ask(new)
            at = np.where(at < 0, len(self.seen) - 1 + np.cumsum(at < 0), at)
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.flat = np.concatenate([self.flat, ids])
            self.seen = pa.concat_arrays([self.seen, new])
        return at

    def encode(self, split: pa.ListArray) -> list[bytes]:
        """Ids of each list of strings."""
        strings = split.flatten().dictionary_encode()
        at = self._numbered(strings.dictionary)[strings.indices.to_numpy()]
        count = self.count[at]
        ends = np.cumsum(count)
        place = np.arange(count.sum())
        place += np.repeat(self.first[at] - (ends - count), count)
        ids = self.flat[place].tobytes()
        bounds = 4 * np.concatenate([[0], ends])[split.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


class WordEncoder(bpe_trie.TrieEncoder):
    """The library's model asked once for each word: faster than the walk where most words are new.

    Texts are split, and their words looked up, as Arrow columns: Python sees a word when it
    is new, not each time it occurs. Texts with code points above 255 or special tokens are
    split at white space first, which nothing that the library composes or matches goes across.
    """

    most_words = 350_000
    #: Texts (and then chunks) whose words can't be told by a pattern of Latin letters.
    OTHER = r"<\||[^\x00-\xff]"

    def __init__(self, path: str):
        super().__init__(path)
        self.model = Tokenizer.from_file(path).model
        self.marks = self.latin.pattern.partition("|")[2]  # the pattern but for runs of letters, which stand between its other matches
        self.levels = {b: c for b, c in enumerate(self.byte_chars) if b != 32}
        self.by_word, self.by_chunk = _Known(self._ask_words), _Known(self._ask_chunks)

    def _walk(self, words: set[str]) -> None:
        ask, known = self.model.tokenize, self.words
        for word in words:
            known[word] = b"".join(t.id.to_bytes(4, "little") for t in ask(word))

    def _ask_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ask, ids, count = self.model.tokenize, [], []
        for word in " ".join(words.to_numpy(zero_copy_only=False)).encode("utf-8").decode("latin-1").translate(self.levels).split(" "):
            own = [t.id for t in ask(word)]
            ids += own
            count.append(len(own))
        return np.array(ids, "<u4"), np.array(count, np.int64)

    def _ask_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        def whole(rest: pa.Array) -> list[bytes]:
            return [x for i in range(0, len(rest), ASK_AT_ONCE) for x in self.encode_all(rest[i : i + ASK_AT_ONCE].to_pylist())]

        ids = self._encoded(chunks, whole)
        return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)

    def _encoded(self, texts: pa.Array, otherwise: Callable[[pa.Array], list[bytes]]) -> list[bytes]:
        """Ids of ``texts``, by their words or ``otherwise``."""
        other = pc.match_substring_regex(texts, self.OTHER)
        plain = pc.replace_substring_regex(pc.utf8_lower(texts.filter(pc.invert(other))), r"[\x85\xa0]", " ")
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, self.marks, r" \0 "))
        ids = iter(self.by_word.encode(words)), iter(otherwise(texts.filter(other)))
        return [next(ids[x]) for x in other.to_pylist()]

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Ids as ``encode_all`` has them, of a column of texts."""
        for known in (self.by_word, self.by_chunk):
            if len(known.seen) > self.most_words:
                known.clear()
        return self._encoded(texts.cast(pa.large_string()).fill_null(""), lambda rest: self.by_chunk.encode(pc.ascii_split_whitespace(rest)))

    def forget(self) -> None:
        super().forget()
        self.by_word.clear()
        self.by_chunk.clear()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(df: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text's ids and the end id, cut after each ``capacity``."""
    base = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([base.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("ids_crc32", T.LongType())])
    end, width = end_id.to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        try:
            for batch in batches:
                for part in kernels.slices(batch, limit=SLICE_BYTES):
                    ids = [x + end for x in own.encode_column(part.column("text"))]
                    size = np.array([len(x) // 4 for x in ids], np.int64)
                    made = -(-size // capacity)
                    row = np.repeat(np.arange(len(ids)), made)
                    piece = np.arange(len(row)) - np.repeat(np.cumsum(made) - made, made)
                    crc = [zlib.crc32(memoryview(x)[at : at + width]) for x in ids for at in range(0, len(x), width)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(np.minimum(capacity, size[row] - piece * capacity), pa.int32()), pa.array(crc, pa.int64())],
                        [f.name for f in schema],
                    )
        finally:
            own.forget()

    return base.mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each item's bin and place in it, and the bins' totals; items in the order given go where they leave least."""
    bins, places, totals = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    with_left: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: there is a bin with r tokens left
    for i, n in enumerate(lengths.tolist()):
        fits = some >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            own = with_left[left].pop()
            if not with_left[left]:
                some ^= 1 << left
        else:
            left, own = capacity, len(totals)
            totals.append(0)
        bins[i], places[i] = own, capacity - left
        totals[own] += n
        left -= n
        if left:
            with_left[left].append(own)
            some |= 1 << left
    return bins, places, np.array(totals, np.int64)


def _packed(items: DataFrame, level: int, capacity: int, carry: int) -> DataFrame:
    """Pack each ``group`` of items (item, length): adds bin, offset, total (of the bin) and open (it goes on to the next round)."""
    schema = T.StructType([*items.schema, T.StructField("bin", T.LongType()), T.StructField("offset", T.IntegerType()), T.StructField("total", T.IntegerType()), T.StructField("open", T.BooleanType())])
    full = capacity * (1 - SLACK)

    def run(table: pa.Table) -> pa.Table:
        length, item = (table.column(c).to_numpy().astype(np.int64) for c in ("length", "item"))
        order = np.lexsort((item, -length))
        table = table.take(pa.array(order))
        own, place, totals = best_fit(length[order], capacity)
        under = np.flatnonzero(totals < full)
        goes_on = np.zeros(len(totals), bool)
        goes_on[under[np.argsort(totals[under], kind="stable")[:carry]]] = True
        group = table.column("group")[0].as_py()
        bins = (level << 58) | (group << _GROUP_BITS) | own
        return pa.Table.from_arrays([*table.columns, pa.array(bins, pa.int64()), pa.array(place, pa.int32()), pa.array(totals[own], pa.int32()), pa.array(goes_on[own])], [f.name for f in schema])

    return items.groupBy("group").applyInArrow(run, schema)


def pack(df: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece, in sequences of at most ``capacity`` tokens."""
    if not 0 < chunk < 1 << _GROUP_BITS - 2:
        raise ValueError("chunk is out of range")
    with scratch.temporary(df.sparkSession) as kept:
        cut = scratch.write_out(pieces(df, path, end_id, capacity, text, doc_id).withColumn("item", F.monotonically_increasing_id()), "pieces")
        groups = max(1, -(-cut.count() // chunk))
        level = 0
        placed = [scratch.write_out(_packed(cut.withColumn("group", F.pmod(F.xxhash64("item"), F.lit(groups))), level, capacity, chunk // fan if groups > 1 else 0), "packed")]
        while groups > 1:
            groups, level = -(-groups // fan), level + 1
            under = placed[-1].where("open and offset = 0").select(F.col("bin").alias("item"), F.col("total").alias("length"), F.expr(f"group div {fan}").alias("group"))
            placed.append(scratch.write_out(_packed(under, level, capacity, chunk // fan if groups > 1 else 0), "packed"))
        moved = None  # where the bins that went on have come to
        for own in reversed(placed[1:]):
            moved = _resolved(own, moved).select(F.col("item").alias("bin"), "sequence_id", F.col("at").alias("moved"))
        if moved is not None:
            moved = scratch.write_out(moved, "moved")
        kept += [placed[0], moved]
    return _resolved(placed[0], moved).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("at").cast("long").alias("offset"))


def _resolved(placed: DataFrame, moved: DataFrame | None) -> DataFrame:
    """Add sequence_id and at: the last bin that an item is in, and the place there."""
    if moved is None:
        return placed.withColumns({"sequence_id": F.col("bin"), "at": F.col("offset")})
    few = moved.count() <= BROADCAST_BINS
    both = placed.join((F.broadcast(moved) if few else moved).withColumnRenamed("sequence_id", "last"), "bin", "left")
    return both.withColumns({"sequence_id": F.coalesce("last", "bin"), "at": F.col("offset") + F.coalesce("moved", F.lit(0))})
