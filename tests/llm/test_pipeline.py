import corpus_pipeline
from tests.llm import brute
from tests.llm.test_line_dedup import plain
from tokenizers import Tokenizer
from trajspark.llm import registry, weak_quality


def test_run_equals_plain_stages(spark, sf):
    docs = {r.doc_id: r.text for r in weak_quality.classify(spark.read.parquet(f"{sf}/documents.parquet")).where("kept").collect()}
    ids = sorted(docs)
    roots = brute.components([brute.shingles(docs[i]) for i in ids])
    docs = {i: docs[i] for k, i in enumerate(ids) if roots[k] == k}
    docs = {i: t for i, (t, *_) in plain(docs.items()).items()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = set()
    for i, text in docs.items():
        n, hit, _ = brute.decontam(text, items)
        if hit and 20 * hit >= n:
            bad.add(i)
    own = Tokenizer.from_file(registry.WORD_BPE)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == docs.keys() - bad and len(docs) > len(got) - len(bad)
    for i, r in got.items():
        want = own.encode(docs[i], add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(k.to_bytes(4, "little") for k in want) and r.n_tokens == len(want)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    assert [n for n, _ in corpus_pipeline.STAGES][:2] == ["quality_classifier", "ngram_jaccard_join"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_one_row_of_a_component_stays(spark, sf):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    near = a.replace("a39", "z")
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "w"), (2, a, "x"), (1, b, "x"), (0, b, "x"), (None, near, "x"), (None, c, "x"), (None, c, "y"), (None, d, "x"), (7, None, "x"), (7, None, "x"), (None, "", "x"), (None, "", "x")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], spark.read.parquet(f"{sf}/documents.parquet").schema)
    got = sorted(((r.doc_id, r.text, r.source) for r in dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, sf).collect()), key=str)
    want = [(1, a, "w"), (0, b, "x"), (None, c, "x"), (None, d, "x"), (7, None, "x"), (7, None, "x"), (None, "", "x"), (None, "", "x")]
    assert got == sorted(want, key=str)
