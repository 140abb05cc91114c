"""Self-join of texts on the Jaccard similarity of word n-grams, by grouped prefixes.

1. Shingles get a total order: rare ones by hash, frequent ones (found by counts in
   blocks of documents, at most ``HOT``) last, the most frequent at the very end.
   The order decides the work only; any order gives the same links.
2. A document's prefix is the part of its ordered set that any partner must share
   a shingle with. Documents of identical prefix and size are one group, texts of
   identical sets one class.
3. Groups post their prefix shingles, packed, to buckets by shingle. Shingles of a
   single group end there.
4. Each class is verified against a star centre, and against the first class of its
   own group. The centre of a shingle is the holder whose shingles have the most
   holders in sum, as the text that others were copied from; a class takes the
   centre of most of its shingles. This joins copies without listing their pairs.
5. Group pairs that aren't joined yet meet where they share a shingle among the
   first n - overlap + 1 of either, the overlap being what sets of these two sizes
   need: the smaller one's share of that is a seventh of its set, not a quarter, so
   edited copies that are unlike each other don't meet by the text they come from.
   Pairs are filtered by what their places leave to share and by what their whole
   prefixes share, then expand to member classes of different components and are
   verified. So every link between components is found, and the components are exact.

Words are runs of anything but space, tab, LF, VT, FF, CR; A-Z are lower-cased.
Defined results: a text without words, or null, has an empty set and is linked with
nothing: its component is its own id; a text of fewer words than ``width`` has its
sequence as only shingle; a very long text is a slice of its own; shingles are known
by 64-bit hashes and sets by 128 bits, words aren't compared again; repeated rows and ids are rows of their own; a null id
never names a component unless no other id is in it. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.llm import components as cc
from trajspark.llm import kernels, scratch

WIDTH, PERCENT = 5, 75
#: Shingles that are ordered by count, at most (8 bytes each go to the driver and to all executors).
HOT = 1 << 19
#: Bytes of text that are hashed at a time; postings of several such pieces are packed together.
SLICE = 1 << 19
#: Shingles that are counted together in a task.
BLOCK = 2_000_000
#: Bytes of postings in a bucket, about.
BUCKET_BYTES = 8 << 20
#: Classes whose keys are sent to all executors, at most (8 bytes each); beyond, a shuffle picks their texts.
BROADCAST_KEYS = 1 << 20

_A, _B = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def need(n, percent: int):
    """Shingles of a set of ``n`` that a linked partner must have."""
    return (percent * n + 99) // 100


def sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted text by text, and how many each text has."""
    raw, offsets = kernels.buffers(text)
    starts, ends, counts = kernels.word_spans(raw, offsets, kernels.SPACED)
    hashes, made = kernels.shingle_hashes(kernels.word_hashes(raw, starts, ends), counts, width)
    owner = np.repeat(np.arange(len(made)), made)
    edge = np.concatenate([[0], np.cumsum(made)]).tolist()
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if b - a > 1:
            hashes[a:b].sort()
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[first], np.bincount(owner[first], minlength=len(made))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
        edge = np.concatenate([[0], np.cumsum(counts)])
        return total[edge[1:]] - total[edge[:-1]]


def keys(hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """16 bytes that stand for each set."""
    with np.errstate(over="ignore"):
        a, b = (kernels.mix(_sums(kernels.mix(hashes ^ x), counts) + counts.astype(np.uint64)) for x in (_A, _B))
    packed = np.stack([a, b], axis=1).tobytes()
    return [packed[i : i + 16] for i in range(0, len(packed), 16)]


def prefixes(hashes: np.ndarray, counts: np.ndarray, hot: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix shingles text by text, how many, and the key of each (prefix, size)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    token, rank = hot
    if len(token) and len(hashes):
        at = np.minimum(np.searchsorted(token, hashes), len(token) - 1)
        place = np.where(token[at] == hashes, rank[at], 0)
        hashes = hashes[np.argsort(owner * np.int64(len(token) + 1) + place, kind="stable")]
    size = np.where(counts > 0, counts - need(counts, percent) + 1, 0)
    edge = np.concatenate([[0], np.cumsum(counts)])[:-1]
    take = np.arange(len(hashes)) - np.repeat(edge, counts) < np.repeat(size, counts)
    prefix = hashes[take]
    with np.errstate(over="ignore"):
        group = kernels.mix(_sums(kernels.mix(prefix), size) ^ kernels.mix(counts.astype(np.uint64)))
    return prefix, size, group


def _frequent(docs: DataFrame, width: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """The ``HOT`` most counted shingles (sorted) with their ranks, and the number of shingles of all texts."""

    @kernels.trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            again = n > 1
            return pa.RecordBatch.from_arrays([pa.array(np.append(token[again].view(np.int64), 0)), pa.array(np.append(n[again], total), pa.int64()), pa.array(np.append(np.zeros(again.sum(), bool), True))], ["token", "n", "is_total"])

        held: list[np.ndarray] = []
        seen: set[bytes] = set()
        total = size = 0
        for batch in batches:
            for part in kernels.slices(batch, limit=SLICE):
                hashes, counts = sets(part.column("text"), width)
                total += len(hashes)
                own = keys(hashes, counts)
                new = np.array([not (k in seen or seen.add(k)) for k in own], bool)
                held.append(hashes[np.repeat(new, counts)])
                size += len(held[-1])
                if size > BLOCK:
                    yield flush()
                    held, size, total = [], 0, 0
                    seen.clear()
        if held:
            yield flush()

    counted = docs.select("text").mapInArrow(count, "token long, n long, is_total boolean").groupBy("token", "is_total").agg(F.sum("n").alias("n"))
    counted = scratch.write_out(counted, "shingle-counts")
    total = counted.where("is_total").agg(F.sum("n")).first()[0] or 0
    # The least count that at most HOT shingles reach; counts of many shingles are few numbers.
    sizes = counted.where("not is_total").groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("n")).collect()
    least, held = 1 << 62, 0
    for row in sizes:
        held += row.m
        if held > HOT:
            break
        least = row.n
    top = counted.where((~F.col("is_total")) & (F.col("n") >= least)).select("token", "n").toArrow()
    token, n = (top.column(c).to_numpy() for c in ("token", "n"))
    order = np.lexsort((token, n))[::-1]
    token = token[order].view(np.uint64)
    by_token = np.argsort(token)
    return (token[by_token], (len(token) - np.arange(len(token)))[by_token]), int(total)


def _postings(docs: DataFrame, hot, width: int, percent: int, buckets: int) -> DataFrame:
    """(token, g, n, at, df): prefix shingles that two groups or more have, their places, and how many have them."""

    @kernels.trimmed
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch):
                each = []
                for piece in kernels.slices(part, limit=SLICE):
                    hashes, own = sets(piece.column("text"), width)
                    each.append((*prefixes(hashes, own, hot.value, percent), own))
                prefix, size, group, counts = (np.concatenate(x) for x in zip(*each, strict=True))
                _, one = np.unique(group, return_index=True)
                keep = np.zeros(len(group), bool)
                keep[one] = True
                keep &= counts > 0
                take = np.repeat(keep, size)
                token, owner = prefix[take], np.repeat(np.cumsum(keep) - 1, size)[take].astype(np.uint32)
                place = (np.arange(len(prefix)) - np.repeat(np.cumsum(size) - size, size))[take].astype(np.uint32)
                bucket = (kernels.mix(token) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
                g, n = group[keep], counts[keep].astype(np.uint32)
                rows = []
                for b in np.flatnonzero(np.diff(edge)):
                    mine = order[edge[b] : edge[b + 1]]
                    used, at = np.unique(owner[mine], return_inverse=True)
                    rows.append((int(b), token[mine].tobytes(), at.astype(np.uint32).tobytes(), place[mine].tobytes(), g[used].tobytes(), n[used].tobytes()))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "token", "owner", "place", "g", "n"])

    def meet(table: pa.Table) -> pa.Table:
        token, owner, place, g, n = [], [], [], [], []
        base = 0
        for t, o, p, k, m in zip(*(table.column(c).to_pylist() for c in ("token", "owner", "place", "g", "n")), strict=True):
            token.append(np.frombuffer(t, np.uint64))
            owner.append(np.frombuffer(o, np.uint32).astype(np.int64) + base)
            place.append(np.frombuffer(p, np.uint32))
            g.append(np.frombuffer(k, np.uint64))
            n.append(np.frombuffer(m, np.uint32))
            base += len(g[-1])
        token, owner, place, g, n = (np.concatenate(x) for x in (token, owner, place, g, n))
        own = g[owner]
        order = np.lexsort((own, token))
        token, own, place, n = token[order], own[order], place[order], n[owner][order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
        token, own, place, n = token[new], own[new], place[new], n[new]
        head = np.ones(len(token), bool)
        head[1:] = token[1:] != token[:-1]
        at = np.cumsum(head) - 1
        df = np.bincount(at)[at]
        shared = df > 1
        return pa.table({"token": token[shared].view(np.int64), "g": own[shared].view(np.int64), "n": n[shared].astype(np.int64), "at": place[shared].astype(np.int64), "df": df[shared]})

    packed = docs.select("text").mapInArrow(emit, "bucket int, token binary, owner binary, place binary, g binary, n binary")
    return packed.groupBy("bucket").applyInArrow(meet, "token long, g long, n long, at long, df long")


def _members(docs: DataFrame, hot, width: int, percent: int) -> DataFrame:
    """(id, n, sig, g) of every row; sig and g are null for empty sets."""
    id_type = docs.schema["id"].dataType.simpleString()

    @kernels.trimmed
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, limit=SLICE):
                hashes, counts = sets(part.column("text"), width)
                _, _, group = prefixes(hashes, counts, hot.value, percent)
                empty = counts == 0
                sig = pa.array([None if e else k for k, e in zip(keys(hashes, counts), empty, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts, pa.int64()), sig, pa.array(group.view(np.int64), mask=empty)], ["id", "n", "sig", "g"])

    return docs.select("id", "text").mapInArrow(emit, f"id {id_type}, n long, sig binary, g long")


def _texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sig, text), one row for each class in ``wanted`` (sig)."""
    spark = docs.sparkSession
    few = wanted.count() <= BROADCAST_KEYS
    chosen = None
    if few:
        own = wanted.select(F.substring("sig", 1, 8).alias("k")).toPandas()["k"]
        chosen = spark.sparkContext.broadcast(np.unique(np.frombuffer(b"".join(map(bytes, own)), np.uint64)))

    @kernels.trimmed
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, limit=SLICE):
                hashes, counts = sets(part.column("text"), width)
                sig = keys(hashes, counts)
                keep = counts > 0
                if chosen is not None:
                    keep &= np.isin(np.frombuffer(b"".join(sig), np.uint64)[::2], chosen.value)
                kept = np.flatnonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array([sig[i] for i in kept], pa.binary()), part.column("text").take(pa.array(kept))], ["sig", "text"])

    found = docs.select("text").mapInArrow(emit, "sig binary, text string")
    return found.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("text").alias("text"))


def _verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the class pairs (a, b) that are similar enough."""
    wanted = scratch.write_out(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct(), "wanted")
    texts = scratch.write_out(_texts(docs, wanted, width), "texts")

    @kernels.trimmed
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "ta", SLICE):
                (x, nx), (y, ny) = sets(part.column("ta"), width), sets(part.column("tb"), width)
                row = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)])
                both = np.concatenate([x, y])
                order = np.lexsort((both, row))
                both, row = both[order], row[order]
                twice = np.flatnonzero((both[1:] == both[:-1]) & (row[1:] == row[:-1]))
                common = np.bincount(row[twice], minlength=len(nx))
                linked = pa.array(np.flatnonzero(100 * common >= percent * (nx + ny - common)))
                yield pa.RecordBatch.from_arrays([part.column("a").take(linked), part.column("b").take(linked)], ["a", "b"])

    left = pairs.join(texts.select(F.col("sig").alias("a"), F.col("text").alias("ta")), "a")
    return left.join(texts.select(F.col("sig").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb").mapInArrow(check, "a binary, b binary")


def _overlap(x: Column, y: Column, percent: int) -> Column:
    """Shingles that linked sets of x and y shingles share at least."""
    return F.floor((percent * (x + y) + (99 + percent)) / (100 + percent))


def _may_link(x: Column, y: Column, shared: Column, percent: int) -> Column:
    """Whether sets of x and y shingles can be linked if their prefixes share ``shared``."""
    small, large = F.least(x, y), F.greatest(x, y)
    overlap = _overlap(x, y, percent)
    return (100 * small >= percent * large) & (shared >= overlap - F.floor((percent * large + 99) / 100) + 1)


def link(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row; component_id: the least id that links reach."""
    with scratch.temporary(df.sparkSession) as kept:
        members, named = _named(df, id_col, text, width, percent)
        named = scratch.write_out(named, "named")
        kept += [members, named]
    out = members.where("sig is not null").join(named, "sig").select("id", "n", "component_id")
    alone = members.where("sig is null").select("id", "n", F.col("id").alias("component_id"))
    return out.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _named(df: DataFrame, id_col: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, sig, g) of every row, and (sig, component_id) of every class."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    frequent, total = _frequent(docs, width)
    hot = spark.sparkContext.broadcast(frequent)
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(floor, int(total * (100 - percent) / 100 * 16 / BUCKET_BYTES))
    posted = scratch.write_out(_postings(docs, hot, width, percent, buckets), "postings")
    members = scratch.write_out(_members(docs, hot, width, percent), "members")
    classes = scratch.write_out(members.where("sig is not null").groupBy("g", "sig", "n").agg(F.min("id").alias("id")), "classes")

    # Stars: the centre that shares most shingles, and the first class of the own group.
    # Only promising stars of three groups or more: step 5 finds the links that they leave out.
    first = classes.groupBy("g").agg(F.min("sig").alias("b"), F.min("n").alias("m"), F.count("*").alias("size"))
    common = posted.where("df > 2").select("token", "g", "df")
    known = common.groupBy("g").agg(F.sum("df").alias("known"))
    centres = common.join(known, "g").groupBy("token").agg(F.max(F.struct("known", "g"))["g"].alias("centre"))
    near = common.join(centres, "token").where("g <> centre").groupBy("g", "centre").agg(F.count("*").alias("c")).groupBy("g").agg(F.max("c").alias("c"), F.max_by("centre", F.struct("c", "centre")).alias("centre"))
    across = classes.join(near, "g").select(F.col("sig").alias("a"), "n", "c", F.col("centre").alias("g")).join(first.select("g", "b", "m"), "g")
    across = across.where(_may_link(F.col("n"), F.col("m"), 2 * F.col("c"), percent)).select("a", "b")
    within = classes.join(first.where("size > 1"), "g").where("sig <> b").select(F.col("sig").alias("a"), "b")
    stars = scratch.write_out(across.union(within), "star-pairs")
    linked = scratch.write_out(_verified(docs, stars, width, percent), "star-links")
    joined = cc.components(linked).withColumnsRenamed({"node": "sig"})

    # The rest: pairs of groups, or of classes in a group, that aren't of one component yet.
    by_class = scratch.write_out(classes.join(joined, "sig", "left").select("g", "sig", "n", "id", F.coalesce("root", "sig").alias("root")), "joined")
    by_group = by_class.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    placed = scratch.write_out(posted.select("token", "g", "n", "at").join(by_group, "g"), "placed")
    open_ = placed.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("token")
    rest = placed.join(open_, "token", "left_semi")
    # The smaller set (or of equal ones that of the smaller key) is the left one; it needs no partner beyond this part of its prefix.
    x, y = rest.where(F.col("at") <= F.col("n") - _overlap(F.col("n"), F.col("n"), percent)).alias("x"), rest.alias("y")
    overlap = _overlap(F.col("x.n"), F.col("y.n"), percent)
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.g") < F.col("y.g")))
    apart = (F.col("x.low") != F.col("y.low")) | (F.col("x.low") != F.col("x.high")) | (F.col("y.low") != F.col("y.high"))
    near = (100 * F.col("x.n") >= percent * F.col("y.n")) & (F.col("x.at") <= F.col("x.n") - overlap) & (F.col("y.at") <= F.col("y.n") - overlap)
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & ordered & apart & near)
    shared = met.groupBy(F.col("x.g").alias("ga"), F.col("y.g").alias("gb"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.count("*").alias("c"), F.max("x.at").alias("i"), F.max("y.at").alias("j"))
    left = F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) - 1
    met = scratch.write_out(shared.where(F.col("c") + left >= _overlap(F.col("na"), F.col("nb"), percent)).select("ga", "gb", "na", "nb"), "met")
    # What whole prefixes share tells more; the tokens that only one group has can be left out.
    asked = met.select(F.col("ga").alias("g")).union(met.select("gb")).distinct()
    held = scratch.write_out(posted.join(asked, "g", "left_semi").groupBy("g").agg(F.collect_list("token").alias("tokens")), "held")
    both = met.join(held.select(F.col("g").alias("ga"), F.col("tokens").alias("x")), "ga").join(held.select(F.col("g").alias("gb"), F.col("tokens").alias("y")), "gb")
    groups = both.where(_may_link(F.col("na"), F.col("nb"), F.size(F.array_intersect("x", "y")), percent)).select("ga", "gb")
    split = by_group.where("low <> high").select(F.col("g").alias("ga"), F.col("g").alias("gb"))
    one = by_class.select(F.col("g").alias("ga"), F.col("sig").alias("a"), F.col("root").alias("ra"))
    two = by_class.select(F.col("g").alias("gb"), F.col("sig").alias("b"), F.col("root").alias("rb"))
    pairs = groups.union(split).join(one, "ga").join(two, "gb").where((F.col("ra") != F.col("rb")) & ((F.col("ga") != F.col("gb")) | (F.col("a") < F.col("b")))).select("a", "b")
    pairs = scratch.write_out(pairs, "rest-pairs")
    if pairs.take(1):
        more = scratch.write_out(_verified(docs, pairs, width, percent), "rest-links")
        if more.take(1):
            joined = cc.components(linked.union(more)).withColumnsRenamed({"node": "sig"})
            by_class = classes.join(joined, "sig", "left").select("sig", "id", F.coalesce("root", "sig").alias("root"))
    least = by_class.groupBy("root").agg(F.min("id").alias("component_id"))
    return members, by_class.join(least, "root").select("sig", "component_id")
