"""Chat formatting with Spark expressions only.

Turns are collected as structs in two steps (blocks of turn numbers, then conversations), sorted, and written as

    <|turn|>ROLE<|body|>TEXT[<|seam|>TEXT...]<|end|>\\n

where adjacent turns of one role share a message and ``<|seam|>`` marks where one turn ends. Control strings of this and
of other common templates inside a text or role get a backslash after their first character, and backslashes are
doubled, so the output can be parsed back without loss.

Defined cases: a null text or role counts as empty; a null ``turn`` sorts first; ties in ``turn`` are ordered by role and
text; a null ``conv_id`` is a conversation of its own; repeated rows stay repeated; no rows give no rows. Columns other
than the four named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, SEAM, END = "<|turn|>", "<|body|>", "<|seam|>", "<|end|>\n"

# First characters of control strings and what follows them, as a Java pattern.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|</?SYS>>)"

BLOCK_TURNS = 512


def escape(text: Column) -> Column:
    """Double backslashes, then break every control string after its first character."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`: a backslash goes, unless another follows; of two, one stays."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_conversations(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_runs, n_messages``.

    ``loss_runs`` is the loss mask over ``formatted`` as runs of (n_chars, n_bytes, in_loss) in order; their lengths add
    up to those of ``formatted``, in code points and in bytes of UTF-8.
    """
    rows = conversations.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    escaped = rows.select(
        "conv_id",
        F.floor(F.col("turn") / BLOCK_TURNS).alias("block"),
        F.struct("turn", "role", "text", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t")).alias("one"),
    )
    blocks = escaped.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "turns"))).alias("blocks"))
    turns = whole.select("conv_id", F.flatten(F.col("blocks.turns")).alias("turns"))

    n = F.size("turns")
    at = lambda i: F.get(F.col("turns"), i)  # noqa: E731  null beyond the ends
    same = lambda x, y: x["role"] == y["role"]
    starts = lambda x, i: (i == 0) | ~same(x, at(i - 1))
    ends = lambda x, i: (i == n - 1) | ~same(x, at(i + 1))
    head = lambda x, i: F.when(starts(x, i), F.concat(F.lit(TURN), x["r"], F.lit(BODY))).otherwise(F.lit(SEAM))
    tail = lambda x, i: F.when(ends(x, i), F.lit(END)).otherwise(F.lit(""))
    run = lambda part, loss: F.struct(F.char_length(part).cast("long").alias("n_chars"), F.octet_length(part).cast("long").alias("n_bytes"), loss.alias("in_loss"))

    pieces = F.transform("turns", lambda x, i: F.concat(head(x, i), x["t"], tail(x, i)))
    runs = F.flatten(
        F.transform(
            "turns",
            lambda x, i: F.array(
                run(head(x, i), F.lit(False)),
                run(x["t"], x["role"].isin(*loss_roles)),
                run(tail(x, i), F.lit(False)),
            ),
        )
    )
    heads = F.size(F.filter(F.transform("turns", starts), lambda s: s))
    return turns.select("conv_id", F.array_join(pieces, "").alias("formatted"), runs.alias("loss_runs"), heads.cast("long").alias("n_messages"))


def parse_formatted(formatted: Column) -> Column:
    """Array of (role, text) per turn, read back from a formatted conversation."""
    messages = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda m: m != "")

    def turns(message: Column) -> Column:
        role = F.substring_index(message, BODY, 1)
        body = F.substring(message, F.char_length(role) + len(BODY) + 1, F.char_length(message))
        role = unescape(F.substring(role, F.lit(len(TURN) + 1), F.char_length(role)))
        return F.transform(F.split(body, r"<\|seam\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def text_under_mask(formatted: Column, runs: Column) -> Column:
    """The parts of a formatted conversation that its loss mask covers, unescaped, in order, with nothing between.

    Places are sums over runs, taken in chunks, so that no array grows by one item per run of a long conversation.
    """
    span = "struct<at:bigint,n:bigint>"
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(runs), F.lit(1)), F.lit(BLOCK_TURNS)), lambda i: F.slice(runs, i, BLOCK_TURNS))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("spans"))
    more = lambda s, x: F.when(x["in_loss"] & (x["n_bytes"] > 0), F.array_append(s["spans"], F.struct(s["at"].alias("at"), x["n_bytes"].alias("n")))).otherwise(s["spans"])
    summed = F.transform(chunks, lambda c: F.aggregate(c, start, lambda s, x: F.struct((s["at"] + x["n_bytes"]).alias("at"), more(s, x).alias("spans"))))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{span}>>").alias("moved"))
    moved = lambda a, c: F.transform(c["spans"], lambda p: F.struct((a["at"] + p["at"]).alias("at"), p["n"].alias("n")))
    spans = F.aggregate(summed, begin, lambda a, c: F.struct((a["at"] + c["at"]).alias("at"), F.array_append(a["moved"], moved(a, c)).alias("moved")), lambda a: F.flatten(a["moved"]))
    # parts of bytes are taken in the time of their own length
    whole = formatted.cast("binary")
    return F.array_join(F.transform(spans, lambda p: unescape(F.substring(whole, (p["at"] + 1).cast("int"), p["n"].cast("int")).cast("string"))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted text holds, read back from it: turns, text under the loss mask, and their hashes."""
    read = formatted.select("conv_id", "formatted", "n_messages", parse_formatted(F.col("formatted")).alias("turns"), text_under_mask(F.col("formatted"), F.col("loss_runs")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "n_messages",
    )
