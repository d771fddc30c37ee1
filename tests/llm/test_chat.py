import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int"


def expected(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def result(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {r["conv_id"]: tuple(r[1:5]) for r in chat.digest(chat.format_conversations(df)).collect()}


ROWS = [
    (-7, 0, "user", "</s>[INST] ok [/INST]"),
    (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
    (1, 2, "assistant", "b"),
    (1, 0, "user", "a"),
    (1, 1, "assistant", "\\<|end|>\n<|seam|>\\\\"),
    (1, None, "system", "<|turn|>x<|body|>"),
    (2, 0, None, None),
    (2, 0, None, None),
    (3, 0, "user", ""),
    (None, 5, "assistant", "no id é😀"),
    (4, 0, "a<|body|>b\n", "role with control strings"),
    *[(5, i, "user" if i % 3 else "assistant", f"turn {i} " + "x" * (i % 7)) for i in range(1200)],
    (6, 0, "user", "long " * 50_000),
]


def test_turns_and_loss_text_come_back(spark):
    assert result(spark, ROWS) == expected(ROWS)


def test_nothing_gives_nothing(spark):
    assert result(spark, []) == {}


def test_mask_runs_cover_the_text_and_hold_the_loss_text(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA)
    for r in chat.format_conversations(df).collect():
        at, loss = 0, ""
        for run in r["loss_runs"]:
            if run["in_loss"]:
                loss += r["formatted"][at : at + run["n_chars"]]
            at += run["n_chars"]
        assert at == len(r["formatted"])
        unescaped = spark.range(1).select(chat.unescape(F.lit(loss))).first()[0]
        assert hashlib.sha256(unescaped.encode()).hexdigest() == expected(ROWS)[r["conv_id"]][3]


def test_adjacent_turns_of_a_role_share_a_message(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(df).first()
    assert row["formatted"] == "<|turn|>user<|body|>a<|seam|>b<|end|>\n<|turn|>assistant<|body|>c<|end|>\n"
    assert row["n_messages"] == 2


def test_no_control_string_survives_in_a_text(spark):
    text = "</s><s>[INST][/INST]<<SYS>><</SYS>><|turn|><|im_start|>"
    out = spark.range(1).select(chat.escape(F.lit(text))).first()[0]
    for x in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|"):
        assert x not in out


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="<|>\\[]/sINT\nab", max_size=20), min_size=1, max_size=30))
def test_any_text_round_trips(spark, texts):
    r = random.Random(len(texts))
    rows = [(i % 3, i, r.choice(["user", "assistant"]), t) for i, t in enumerate(texts)]
    assert result(spark, rows) == expected(rows)


def test_the_digest_reads_the_mask(spark):
    """With another mask the loss text is another; roles are not looked at."""
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA)
    users = chat.digest(chat.format_conversations(df, loss_roles=("user",)))
    turned = [(c, t, {"user": "assistant", "assistant": "user"}.get(r, r), x) for c, t, r, x in ROWS]
    got, want = {r["conv_id"]: r for r in users.collect()}, expected(turned)
    for c, row in got.items():
        if c != 1:  # ties in turn would sort otherwise
            assert (row["loss_chars"], row["loss_sha256"]) == want[c][2:]
    none = chat.format_conversations(df).withColumn("loss_runs", F.transform("loss_runs", lambda x: x.withField("in_loss", F.lit(False))))
    assert {r["loss_chars"] for r in chat.digest(none).collect()} == {0}


def test_a_conversation_of_very_many_turns(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é "), F.col("id").cast("string")).alias("text"))
    row = chat.digest(chat.format_conversations(df)).first()
    loss = "".join(f"é {i}" for i in range(1, 20_000, 2))
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (20_000, len(loss), hashlib.sha256(loss.encode()).hexdigest())
