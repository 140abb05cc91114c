import itertools
import random

import pytest
from tokenizers import Tokenizer

from tests.llm import brute
from trajspark.llm import bpe_trie, registry

ODD = ["<|endoftext|> hi<|startoftext|>you", "İstanbul ǅ ΑΣ Σ", "don't I'LL we've \x1c\x85 a\xa0b", "日本語", "😀 ½²ª", "", None, "a" * 3000, "\0 x \0\0abc", "<| x <|endoftext", "é ﬁ ẞ", "\n\t ", "x퟿", "aaaa aaab baaa"]


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(registry.WORD_BPE)
    own.no_padding()
    own.no_truncation()
    return own


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return b"".join(i.to_bytes(4, "little") for i in ids), library.decode(ids, skip_special_tokens=False)


def test_equals_the_library(library, spark, sf):
    rng = random.Random(3)
    texts = [*ODD, *("".join(chr(rng.choice([*range(32, 127), *range(160, 400), 0x2019, 0x3042])) for _ in range(60)) for _ in range(300))]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    own = bpe_trie.TrieEncoder(registry.WORD_BPE)
    ids = own.encode_all(texts)
    assert list(zip(ids, own.decode_all(ids), strict=True)) == [expected(library, t) for t in texts]
    assert own.encode_all(texts) == ids


def test_dataframe_form(library, spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(0, "again", "y"), (None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe_trie.encode_decode(df, registry.WORD_BPE)
    assert got.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    for r in got.collect():
        assert (bytes(r.ids), r.decoded) == expected(library, r.text) and r.n_tokens == len(r.ids) // 4
    assert bpe_trie.encode_decode(df.limit(0), registry.WORD_BPE).count() == 0


def test_query(library, spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.QUERIES["op9_bpe_trie"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids, decoded = expected(library, docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, brute.sha(ids), brute.sha(decoded))


def test_words_that_share_prefixes_and_ends_equal_the_library():
    parts = ["que", "ment", "zu", "ing", "a", "b", "tion", "heit", "</w>", "é", "supercali"]
    texts = [*("".join(p) for n in (1, 2, 3) for p in itertools.product(parts, repeat=n)), "", "a aa aaa aaaa ab abc abcd", "zzzzqqqq" * 9]
    own, library = bpe_trie.TrieEncoder(registry.WORD_BPE), Tokenizer.from_file(registry.WORD_BPE)
    want = [b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert own.encode_all(texts) == want and not hasattr(own, "longest")
    assert own.reach["ing"] >= 3 and all(n > 2 for n in own.reach.values())
