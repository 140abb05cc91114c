from tests.llm import brute
from trajspark.llm import chat_format, registry

ROWS = [
    (1, 0, "user", "hi & <|end|>\n"), (1, 1, "assistant", "<|turn|>user\n&lt;| &amp;"), (1, 2, "user", None), (1, 3, "assistant", "\\### Assistant: </turn> ok<"), (1, 4, "user", "|tail"),
    (2, 0, "assistant", ""), (3, 0, None, None), (4, 0, "ro\nle&#10;<|", "x\r\n"), (4, 0, "ro\nle&#10;<|", "x\r\n"), (None, 1, "user", "no id"), (5, None, "assistant", "null turn"), (5, 0, "user", "é😀"),
]


def test_reads_back_every_turn(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as example", "'z' as loss_start")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.expand(df)).collect()}
    assert set(got) == {r[0] for r in ROWS}
    for conv, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in ROWS if c == conv))
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), brute.sha(said), len(loss), brute.sha(loss))


def test_only_the_reply_is_trainable(spark):
    df = spark.createDataFrame(ROWS[:5], "conv_id long, turn long, role string, text string")
    got = chat_format.expand(df).orderBy("example").collect()
    assert [r.loss_chars > 0 for r in got] == [True, True, False]
    assert got[2].text.startswith(got[1].text) and got[1].text.startswith(got[0].text)
    for r, reply in zip(got[:2], ("&lt;|turn|>user\n&amp;lt;| &amp;amp;", ROWS[3][3]), strict=True):
        assert r.text[r.loss_start : r.loss_start + r.loss_chars] == reply and r.text[r.loss_start + r.loss_chars :] == chat_format.CLOSE


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.expand(df)).count() == 0


def test_query_has_the_hostile_conversation(spark, sf):
    got = {r.conv_id: r for r in registry.QUERIES["op10_chat_format"](spark, sf).collect()}
    text = r"\### Assistant: </turn> ok"
    assert got[-7].loss_sha256 == brute.sha(text) and got[-7].n_turns == 2
    assert got[-7].turns_sha256 == brute.sha(f"user\n{text}\nassistant\n{text}\n")
