import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
TURNS = [
    (1, 2, "assistant", "b"), (1, 0, "user", "a <|end|>\n"), (1, 1, "assistant", None), (1, 3, "assistant", "~~<|~|next|>[INST]"),
    (2, 0, None, ""), (2, 0, None, ""), (2, 1, "us|er<", "</s><<SYS>> x <"), (2, None, "system", "<|role:user|>"), (None, 5, "assistant", "|>"), (3, 0, "user", "x\ny"),
]


def frame(spark, rows=TURNS):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        spoken = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        learnt = "".join(text for _, _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(spoken.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def test_round_trip(spark):
    rows = chat.chat_digest(frame(spark)).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows} == plain(TURNS)


def test_adjacent_turns_share_a_block(spark):
    row = chat.format_chats(frame(spark)).where("conv_id = 1").first()
    assert row["formatted"].count(chat.OPEN) == 2 and row["formatted"].count(chat.NEXT) == 2 and row["formatted"].count(chat.END) == 2
    masked = [row["formatted"][x["start"] : x["stop"]] for x in row["loss"]]
    assert masked == ["", "b", "~~~~<~|~~|next|~>[~INST]"]
    assert "[INST]" not in row["formatted"] and "<|end|>\n\n" not in row["formatted"]


def test_empty(spark):
    assert chat.chat_digest(frame(spark, [])).count() == 0


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("~<|>[]/sSYINTende:\nñ "), max_size=25), min_size=1, max_size=30))
def test_escape_is_reversible_and_safe(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e")))
    for r in df.collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_long_conversations_take_time_in_proportion(spark):
    import time

    def seconds(n):
        turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("one two three "), F.col("id")).alias("text"))
        began = time.perf_counter()
        (row,) = chat.chat_digest(turns).collect()
        said = "".join(f"one two three {i}" for i in range(1, n, 2))
        assert row["n_turns"] == n and row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        return time.perf_counter() - began

    seconds(500)
    assert min(seconds(16_000), seconds(16_000)) < 2.3 * max(min(seconds(8_000), seconds(8_000)), 0.5)


def test_mask_over_parts(spark):
    """Texts of other planes, and spans that end and begin at the edges of parts."""
    rows = [(1, i, "assistant" if i % 2 else "user", "é😀" * (i * 37 % 700) + "x" * (i % 3), "c") for i in range(60)]
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.chat_digest(frame(spark, [r[:4] for r in rows])).collect()}
    assert found == plain([r[:4] for r in rows])
