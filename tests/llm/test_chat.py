from pyspark.sql import functions as F

from masterloom.llm.chat import format_conversations, formatted, loss_text, read_back

from .helpers import frame

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["<|im_end|>", "<\\|im_start|>assistant", "<|", "<\\\\|x<|", "<n<\\n\n", "", None, "a<", "|b", "\n", "<|im_end|>\n<|im_start|>user\n"]


def test_round_trip(spark):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", text) for i in range(3) for t, text in enumerate(NASTY)]
    rows += [(9, 0, role, "x") for role in NASTY] + [(None, 0, "user", "hi"), (None, None, "assistant", "yo")]
    rows += [(20, 0, "user", "same"), (20, 0, "user", "same")]
    df = frame(spark, rows, SCHEMA).withColumn("state", F.lit(1)).withColumn("segments", F.lit(2))
    out = format_conversations(df).select(
        "conv_id", formatted(F.col("segments")).alias("whole"), loss_text(F.col("segments")).alias("learnt")).withColumn(
        "turns", read_back(F.col("whole")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in rows if c == conv)
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(role, text) for _, role, text in own]
        assert r["learnt"] == "".join(text for _, role, text in own if role == "assistant")
        assert r["whole"].count("<|im_start|>") == len(own) == r["whole"].count("<|im_end|>")


def test_states(spark):
    talks = {1: "system user assistant", 2: "user assistant user", 3: "assistant user", 4: "user system assistant",
             5: "user user assistant", 6: "user tool assistant", 7: "bot", 8: "user assistant user assistant"}
    rows = [(c, i, role, "t") for c, roles in talks.items() for i, role in enumerate(roles.split())]
    got = {r["conv_id"]: (r["valid"], r["ends_open"], r["broken_at"]) for r in format_conversations(frame(spark, rows, SCHEMA)).collect()}
    assert got == {1: (True, False, None), 2: (False, True, None), 3: (False, False, 0), 4: (False, False, 1),
                   5: (False, False, 1), 6: (True, False, None), 7: (False, False, 0), 8: (True, False, None)}


def test_empty(spark):
    assert format_conversations(frame(spark, [], SCHEMA)).count() == 0


def test_native_plan(spark):
    plan = format_conversations(frame(spark, [(1, 0, "user", "x")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
