"""Training-order materialisation of token ids in binary shards.

1. Texts are tokenised where they are read and packed, each followed by the end
   token, into sequences of ``length`` tokens; the last of a partition is filled up
   with end tokens. Counts per partition give every sequence a global index.
2. A keyed Feistel permutation on the next even number of bits, walked along its
   cycles until it falls below the number of sequences, maps index to slot: a
   bijection that any reader can compute, in both directions, without a table.
3. Slots are dealt in ranges to shards. A shard file holds its sequences in slot
   order at a fixed stride: ``length`` ids and a zero, as little-endian unsigned
   16-bit numbers. So slot s starts at byte (s mod per_shard) * stride of shard
   s div per_shard, and reading can resume anywhere.

Files are written by Spark's committer into the shared folder, so lost executors
and retries leave no partial shard. Between the steps ids travel compressed.

Defined results: null text counts as empty and gives an end token only; rows are
packed in the order of the input, so equal input files and splits give equal shards;
a very long text fills as many sequences as it takes; ids that aren't whole numbers
are null in the manifest; vocabularies beyond 65,536 ids are refused; repeated rows are packed again; other columns are ignored. An empty table gives no shards.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import kernels, scratch

LENGTH = 2048
PER_SHARD = 4096
ROUNDS = 6
KEY = 0x51_7C_C1_B7_27_22_0A_95
#: Texts that are tokenised before sequences are passed on.
_FLUSH = 1 << 20


class Permutation:
    """Keyed bijection of range(n)."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [np.uint64(int(kernels.mix(np.array([(key + 0x9E3779B97F4A7C15 * r) % (1 << 64)], np.uint64))[0])) for r in range(1, rounds + 1)]

    def _network(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (kernels.mix(right ^ k) & self.mask)
        return (right << self.half) | left  # halves swapped, so that reversed keys invert it

    def _walk(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        out = self._network(x.astype(np.uint64), keys)
        while len(far := np.flatnonzero(out >= np.uint64(self.n))):
            out[far] = self._network(out[far], keys)
        return out.astype(np.int64)

    def slots(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys)

    def indices(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


_TOKENIZERS: dict = {}


def tokenizer(path: str, pattern: str):
    """A tiktoken encoding from a file of ranks, one a worker process."""
    if path not in _TOKENIZERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _TOKENIZERS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _TOKENIZERS[path]


def sequences(df: DataFrame, path: str, pattern: str, end: int, length: int, id_col: str, text: str) -> DataFrame:
    """(part, k, ids, doc_ids): packed sequences, the k-th of an input partition, with the ids of their documents."""

    if end > 0xFFFF:
        raise ValueError("shards hold 16-bit ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = tokenizer(path, pattern), TaskContext.get().partitionId()
        held = np.zeros(0, np.uint16)
        owners = np.zeros(0, np.int64)  # of the held ids, by row of names
        names: list = []
        k = 0

        def cut(upto: int) -> pa.RecordBatch:
            nonlocal held, owners, names, k
            n = upto // length
            ids = [held[i * length : (i + 1) * length].tobytes() for i in range(n)]
            docs = [[names[j] for j in np.unique(owners[i * length : (i + 1) * length])] for i in range(n)]
            out = pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(k, k + n), pa.int64()), pa.array(ids, pa.binary()), pa.array(docs, pa.list_(pa.int64()))], ["part", "k", "ids", "doc_ids"])
            held, owners, k = held[upto:], owners[upto:], k + n
            first = int(owners[0]) if len(owners) else len(names)
            names, owners = names[first:], owners - first
            return out

        for batch in batches:
            for piece in kernels.slices(batch, text, _FLUSH):
                found = [held]
                sizes = []
                for t in piece.column(text).to_pylist():
                    ids = own.encode_ordinary(t or "")
                    ids.append(end)
                    found.append(np.array(ids, np.uint16))
                    sizes.append(len(ids))
                held = np.concatenate(found)
                owners = np.concatenate([owners, np.repeat(np.arange(len(names), len(names) + len(sizes)), sizes)])
                names += piece.column(id_col).to_pylist()
                if len(held) >= length:
                    yield cut(len(held) // length * length)
        if len(held):
            rest = length - len(held)
            held = np.append(held, np.full(rest, end, np.uint16))
            owners = np.append(owners, np.full(rest, owners[-1]))
            yield cut(length)

    return df.select(F.col(id_col).try_cast("long").alias(id_col), text).mapInArrow(run, "part int, k long, ids binary, doc_ids array<long>")


def materialise(
    df: DataFrame, path: str, pattern: str, end: int, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, id_col: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, str, int]:
    """Write the shards; (manifest, their folder, number of sequences).

    manifest: slot, shard, byte_offset, doc_ids, sha256 (of the ids) of every sequence.
    """
    spark = df.sparkSession
    table = scratch.write_out(sequences(df, path, pattern, end, length, id_col, text), "sequences")
    counts = table.groupBy("part").agg(F.count("*").alias("n"))
    # Two numbers an input partition, whatever it holds, come to the driver.
    size = counts.orderBy("part").toPandas()
    starts = np.zeros(int(size["part"].max()) + 1 if len(size) else 0, np.int64)
    starts[size["part"]] = size["n"].cumsum() - size["n"]
    total = int(size["n"].sum())
    order = Permutation(total, key)

    def place(part: pa.RecordBatch) -> np.ndarray:
        return order.slots(starts[part.column("part").to_numpy()] + part.column("k").to_numpy()) if part.num_rows else np.zeros(0, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)

        def pack() -> pa.RecordBatch:
            rows = [(s, np.array([x for x, _ in v], np.int64).tobytes(), packer.compress(b"".join(b for _, b in v))) for s, v in held.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "slots", "packed"])

        held: dict[int, list[tuple[int, bytes]]] = {}
        size = 0
        for batch in batches:
            for slot, ids in zip(place(batch).tolist(), batch.column("ids").to_pylist(), strict=True):
                held.setdefault(slot // per_shard, []).append((slot, ids))
                size += len(ids)
            if size > 32 << 20:
                yield pack()
                held, size = {}, 0
        if held:
            yield pack()

    def assemble(rows: pa.Table) -> pa.Table:
        import zstandard

        opener = zstandard.ZstdDecompressor()
        slots = np.concatenate([np.frombuffer(x, np.int64) for x in rows.column("slots").to_pylist()])
        data = np.concatenate([np.frombuffer(opener.decompress(x), np.uint16) for x in rows.column("packed").to_pylist()]).reshape(-1, length)
        by = np.argsort(slots)
        return pa.table({"shard": pa.array(slots[by] // per_shard), "slot": pa.array(slots[by]), "record": pa.array([x.tobytes() for x in data[by]], pa.binary())})

    folder = scratch.new_path(spark, "shards")
    dealt = table.select("part", "k", "ids").mapInArrow(deal, "shard long, slots binary, packed binary")
    records = dealt.groupBy("shard").applyInArrow(assemble, "shard long, slot long, record binary").sortWithinPartitions("shard", "slot")
    records.select(F.col("record").cast("string").alias("value"), "shard").write.partitionBy("shard").option("lineSep", "\u0000\u0000").text(folder)

    def list_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = place(batch)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard), pa.array(slot % per_shard * (2 * length + 2)), batch.column("doc_ids"), batch.column("sha256")], ["slot", "shard", "byte_offset", "doc_ids", "sha256"])

    manifest = table.select("part", "k", "doc_ids", F.sha2("ids", 256).alias("sha256")).mapInArrow(list_slots, "slot long, shard long, byte_offset long, doc_ids array<long>, sha256 string")
    return manifest, folder, total


def read_shards(spark: SparkSession, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD, first_slot: int = 0) -> DataFrame:
    """(slot, ids) from ``first_slot`` on, read back from the files; earlier shards aren't opened."""
    stride = 2 * length + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)
                slots = shard * per_shard + np.arange(len(data))
                keep = slots >= first_slot
                yield pa.RecordBatch.from_arrays([pa.array(slots[keep]), pa.array([x[:-2].tobytes() for x in data[keep]], pa.binary())], ["slot", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.where(F.col("shard") >= first_slot // per_shard).select(F.col("shard").cast("long"), "content").mapInArrow(run, "slot long, ids binary")
