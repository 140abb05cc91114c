"""Columns of any name pass through; tables of blocks that run side by side stay apart."""

import threading

import pytest

from trajspark.llm import bpe_trie, html_mincut, registry, scratch, suffix_decontam, weak_quality

TEXT = "some words of a plain text that goes on for a while. " * 3


@pytest.mark.parametrize("name", ["a.b", "a`b", "x.y`z"])
def test_odd_names_pass_through(spark, name):
    df = spark.createDataFrame([(1, TEXT, 7), (2, None, 8)], ["doc_id", "text", name])
    items = spark.createDataFrame([(5, TEXT)], "item_id long, text string")
    for out in (bpe_trie.encode_decode(df, registry.WORD_BPE), weak_quality.classify(df), suffix_decontam.mark(df, items), suffix_decontam.decontaminate(df.limit(0), items) if "`" not in name else df):
        assert out.columns[:3] == ["doc_id", "text", name]
        assert {(r[0], r[2]) for r in out.collect()} <= {(1, 7), (2, 8)}
    pages = df.withColumnRenamed("text", "html")
    assert [(r[0], r[2], r["text"] != "") for r in html_mincut.extract(pages).orderBy("doc_id").collect()] == [(1, 7, True), (2, 8, False)]


def test_the_text_itself_may_have_an_odd_name(spark):
    df = spark.createDataFrame([(1, TEXT)], ["doc_id", "body.text"])
    assert bpe_trie.encode_decode(df, registry.WORD_BPE, text="body.text").first().n_tokens > 10
    assert html_mincut.extract(df, "body.text").first().text == TEXT.strip()


def test_blocks_of_two_threads_stay_apart(spark):
    inside, done, found = threading.Event(), threading.Event(), {}

    def other():
        with scratch.temporary(spark):
            found["table"] = scratch.write_out(spark.range(3), "mine")
            inside.set()
            done.wait(60)
            found["rows"] = found["table"].count()

    thread = threading.Thread(target=other)
    with scratch.temporary(spark):
        thread.start()
        assert inside.wait(60)
    done.set()
    thread.join(60)
    assert found["rows"] == 3
