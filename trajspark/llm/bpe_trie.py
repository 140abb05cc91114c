"""BPE encoding by prefix-sharing trie traversal, and decoding.

The last token of the encoding of a prefix determines the whole encoding: token
``t`` ends the encoding of prefix ``p`` exactly when ``t`` is a suffix of ``p`` and
the pair (last token of the rest, ``t``) survives the merges on its own. The trie of
the distinct words is walked depth first, which is their sorted order, with these
last-token states on the path: a prefix that many words share is encoded once.

Defined results: null text counts as empty; an empty text has no tokens and
decodes to ""; strings of special tokens in a text become those tokens; all
other columns pass through, except columns named as the outputs, which are
replaced. Rows are handled one by one, so repeated rows and ids are no matter.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trajspark.llm import kernels

#: Encoded words and judged token pairs kept in a task; each cache starts anew beyond it.
CACHE_WORDS = 200_000
CACHE_PAIRS = 200_000
END = "</w>"


def _latin_pattern() -> re.Pattern:
    """The library's split pattern for texts of code points below 256."""
    kind = {c: unicodedata.category(chr(c))[0] for c in range(256)}
    white = [*range(9, 14), 32, 0x85, 0xA0]
    every = lambda codes: "".join(f"\\x{c:02x}" for c in codes)
    letters, digits = every(c for c in kind if kind[c] == "L"), every(c for c in kind if kind[c] == "N")
    return re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^{every(white)}{letters}{digits}]+")


def _byte_chars() -> list[str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the rest moves to 256 and on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, moved = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + moved))
        moved += b not in plain
    return out


class TrieEncoder:
    """Encodes and decodes with a tokenizer file of the ``word_bpe`` kind."""

    most_words = CACHE_WORDS

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ids: dict[str, int] = model["vocab"]
        self.id_bytes = {t: i.to_bytes(4, "little") for t, i in self.ids.items()}
        self.rank = {m: i for i, m in enumerate(merges)}
        self.reach: dict[str, int] = {}  # by the last three symbols and the mark: symbols of the longest token that ends so
        for token in self.ids:
            body = token.removesuffix(END)
            if len(body) > 2:
                ends = token[len(body) - 3 :]
                self.reach[ends] = max(self.reach.get(ends, 0), len(body))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in (self.ids | self.special).items():
            self.names[i] = token
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        self.latin = _latin_pattern()
        self.byte_chars = _byte_chars()
        self.words: dict[str, bytes] = {}  # by byte-level text
        self.plain_words: dict[str, bytes] = {}  # by Latin text
        self.pairs: dict[tuple[str, str], bool] = {}
        self.made_of = {a + b: (a, b) for a, b in merges}
        self.spines: tuple[dict[str, list], dict[str, list]] = ({}, {})

    def _merged(self, symbols: list[str]) -> list[str]:
        """Plain merging: the lowest rank first, leftmost first."""
        while len(symbols) > 1:
            rank, i = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    @staticmethod
    def _symbols(token: str) -> list[str]:
        body = token.removesuffix(END)
        return [*body[:-1], token[len(body) - 1 :]] if body else [token]

    def _spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """Parts of ``token`` that are at its edge (side 0: left, 1: right) as merging goes on, each with the rank of the merge that takes it up; [] if merging doesn't make the token."""
        if (known := self.spines[side].get(token)) is None:
            known, part, taken = [], token, math.inf
            if self._merged(self._symbols(token)) == [token]:
                known.append((part, taken))
                while part in self.made_of:
                    taken = self.rank[self.made_of[part]]
                    part = self.made_of[part][side]
                    known.append((part, taken))
                known.reverse()
            self.spines[side][token] = known
        return known

    def _stays(self, left: str, right: str) -> bool:
        """Whether tokens ``left`` ("" for none) and ``right`` stay apart and whole.

        Both grow at their touching edges in order of rank; they stay apart if no
        two parts that touch at some time merge before either is taken up.
        """
        b = self._spine(right, 0)
        if not left or not b:
            return bool(b)
        a, rank = self._spine(left, 1), self.rank
        i = j = 0
        while True:
            (x, x_taken), (y, y_taken) = a[i], b[j]
            across = rank.get((x, y))
            if across is not None and across < x_taken and across <= y_taken:
                return False
            if x_taken == math.inf and y_taken == math.inf:
                return True
            if x_taken <= y_taken:
                i += 1
            else:
                j += 1

    def _walk(self, words: set[str]) -> None:
        """Encode ``words`` (byte-level text) in the depth-first order of their trie, which is their sorted order.

        The path holds for every prefix the token that ends it and the ids up to there; a
        word goes on from the prefix that it shares with the one before, so no node is built.
        """
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        ids, pairs, reach, stays, done = self.id_bytes, self.pairs, self.reach, self._stays, self.words
        before, path = "", [("", b"")]  # path[i]: the token that ends the prefix of i symbols, and the ids of the prefix
        for word in sorted(words):
            end = len(word) - 1  # the last symbol is marked, so it is shared with no other word
            depth, most = 0, min(end, len(before) - 1)
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del path[depth + 1 :]
            while depth <= end:
                depth += 1
                first = 0
                if depth > 2:
                    first = depth - reach.get(word[depth - 3 : depth] if depth <= end else word[depth - 3 :] + END, 2)
                for start in range(first if first > 0 else 0, depth):
                    token = word[start:depth] if depth <= end else word[start:] + END
                    if token in ids:
                        left, known = path[start]
                        pair = (left, token)
                        if (apart := pairs.get(pair)) is None:
                            apart = pairs[pair] = stays(left, token)
                        if apart:
                            path.append((token, known + ids[token]))
                            break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
            done[word] = path[-1][1]
            before = word

    def _pieces(self, text: str) -> tuple[dict[str, bytes], list[str]]:
        """Words of a text without special tokens, and the cache that knows them."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            normal = self.normalizer.normalize_str(text)
            return self.words, [p for p, _ in self.pre_tokenizer.pre_tokenize_str(normal)]
        return self.plain_words, self.latin.findall(text.lower())

    def _byte_level(self, piece: str) -> str:
        return "".join(self.byte_chars[b] for b in piece.encode("utf-8"))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, a string of bytes a text."""
        parts: list[list[tuple[dict[str, bytes], list[str]] | bytes]] = []
        for text in texts:
            row: list[tuple[dict[str, bytes], list[str]] | bytes] = []
            for part in self.split_special.split(text or "") if self.split_special and "<|" in (text or "") else [text or ""]:
                if part in self.special:
                    row.append(self.special[part].to_bytes(4, "little"))
                elif part:
                    row.append(self._pieces(part))
            parts.append(row)
        if len(self.words) > self.most_words or len(self.plain_words) > self.most_words:
            self.words.clear()
            self.plain_words.clear()
        asked = [part for row in parts for part in row if not isinstance(part, bytes)]
        plain = set().union(*(pieces for cache, pieces in asked if cache is self.plain_words)) - self.plain_words.keys()
        fresh = {p: self._byte_level(p) for p in plain}
        levels = set().union(*(pieces for cache, pieces in asked if cache is self.words))
        self._walk(levels.union(fresh.values()) - self.words.keys())
        for piece, level in fresh.items():
            self.plain_words[piece] = self.words[level]
        return [b"".join(part if isinstance(part, bytes) else b"".join(map(part[0].__getitem__, part[1])) for part in row) for row in parts]

    def forget(self) -> None:
        """Free the caches: workers outlive tasks, and the next one may be another operator's."""
        for cache in (self.words, self.plain_words, self.pairs):
            cache.clear()

    def decode_all(self, ids: list[bytes]) -> list[str]:
        """Token strings joined by a space, as a file without a decoder has it."""
        get = self.names.__getitem__
        return [" ".join(map(get, memoryview(x).cast("I"))) for x in ids]


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder a worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


@kernels.any_names
def encode_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (binary, unsigned 32-bit), ``n_tokens`` and ``decoded`` to every row.

    ``path`` is the tokenizer file, present on every executor.
    """
    kept = [c for c in df.columns if c not in ("ids", "n_tokens", "decoded")]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])

    @kernels.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        try:
            for batch in batches:
                for part in kernels.slices(batch, text):
                    ids = own.encode_all(part.column(text).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in kept), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(own.decode_all(ids), pa.string())],
                        [*kept, "ids", "n_tokens", "decoded"],
                    )
        finally:
            own.forget()

    return df.select(*kept).mapInArrow(run, schema) if text in kept else df.mapInArrow(run, schema)
