import hashlib

import numpy as np
import public_tokenizers
import pytest

from trajspark.llm import registry, training_order


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection(n):
    order = training_order.Permutation(n, 99)
    slots = order.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert order.indices(slots).tolist() == list(range(n))
    if n > 100:
        assert abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.1 and slots.tolist() != training_order.Permutation(n, 98).slots(np.arange(n)).tolist()


def test_shards_hold_every_token_once(spark):
    texts = ["one two three", "", None, "ça va\n", "x" * 400, "repeat", "repeat"]
    df = spark.createDataFrame([(i % 6, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, part int").repartition(2)
    manifest, folder, total = training_order.materialise(df, registry.RANKS, public_tokenizers.PATTERN, registry.RANKS_END, length=8, per_shard=5)
    rows = {r.slot: r for r in manifest.collect()}
    back = {r.slot: bytes(r.ids) for r in training_order.read_shards(spark, folder, 8, 5).collect()}
    assert sorted(rows) == sorted(back) == list(range(total))
    assert all(hashlib.sha256(back[s]).hexdigest() == r.sha256 and (r.shard, r.byte_offset) == (s // 5, s % 5 * 18) for s, r in rows.items())
    later = training_order.read_shards(spark, folder, 8, 5, first_slot=7).collect()
    assert sorted(r.slot for r in later) == list(range(7, total))
    own = training_order.tokenizer(registry.RANKS, public_tokenizers.PATTERN)
    order = training_order.Permutation(total, training_order.KEY)
    stream = np.concatenate([np.frombuffer(back[s], np.uint16) for s in order.slots(np.arange(total)).tolist()]).tolist()
    said, text = [], []
    for i in stream:
        if i == registry.RANKS_END:
            said.append(own.decode(text))
            text = []
        else:
            text.append(i)
    assert not text and sorted(s for s in said if s) == sorted(t for t in texts if t) and len(said) >= len(texts)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    manifest, _, total = training_order.materialise(df, registry.RANKS, public_tokenizers.PATTERN, registry.RANKS_END)
    assert total == 0 and manifest.count() == 0


def test_query(spark, sf):
    got = registry.QUERIES["op2_training_order"](spark, sf).collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and {d for r in got for d in r.doc_ids} == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
