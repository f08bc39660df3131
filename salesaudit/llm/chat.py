"""Conversations as training text with a loss mask, read back by a parser. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template: fixed values.
START, END, LINE = "<|im_start|>", "<|im_end|>", "<|line|>"
LEARNED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    r"""``text`` with one more backslash between each ``<`` and ``|`` that only backslashes part.

    No ``<|`` is left, so nothing in it can be taken for a mark.
    """
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def rendered(role: Column, text: Column) -> Column:
    """One turn in the template. It is escaped only where the plain form would be read as something else."""
    simple = _turn(role, text)
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    safe = _turn(F.replace(escaped(role), F.lit("\n"), F.lit(LINE)), escaped(text))
    return F.when(F.coalesce(source == spoken(parsed(simple)), F.lit(False)), simple).otherwise(safe)


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text: role, text, and the lengths of the head and of the text as it stands.

    A turn is START, a role, a line end, a text, END, a line end. Where that
    grammar is not met the fields of the turn are NULL.
    """
    bodies = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda body, i: i > 0)

    def read(body: Column) -> Column:
        line = F.instr(body, "\n")
        rest = F.substring(body, line + 1, F.length(body))
        text = F.substring_index(rest, END, 1)
        whole = (line > 0) & (rest == F.concat(text, F.lit(END + "\n")))
        role = F.substring(body, F.lit(1), line - 1)
        return F.struct(
            F.when(whole, unescaped(F.replace(role, F.lit(LINE), F.lit("\n")))).alias("role"),
            F.when(whole, unescaped(text)).alias("text"),
            F.when(whole, line + len(START)).alias("head_chars"),
            F.when(whole, F.length(text)).alias("text_chars"),
        )

    return F.transform(bodies, read)


def spoken(turns: Column) -> Column:
    """Role and text alone of each parsed turn."""
    return F.transform(turns, lambda turn: F.struct(turn["role"].alias("role"), turn["text"].alias("text")))


def format_conversations(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: its id, formatted, turns, loss_runs, identical.

    formatted is the text to train on; turns (role, text) and loss_runs are read
    back from it. loss_runs has a run per turn, in code points of formatted: so
    many to skip, then so many that count in the loss (the text of an
    assistant's turn), then so many of a text that does not count.
    identical tells whether the turns read back equal the source, which the
    escaping ensures.

    Turns are ordered by ``turn``, then role and text; rows repeated are turns of
    their own. NULL texts and roles are empty, NULL ids one conversation. Other
    columns are not read. A conversation is one row and must fit into one.
    """
    words, name = (F.coalesce(F.col(column).cast("string"), F.lit("")) for column in (text, role))
    turns = rows.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), name.alias("role"), words.alias("text")
    ).withColumn("rendered", rendered(F.col("role"), F.col("text")))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("source"))
    joined = whole.select(
        "conv_id",
        F.array_join(F.transform("source", lambda x: x["rendered"]), "").alias("formatted"),
        F.transform("source", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
    )
    read = joined.withColumn("read", parsed(F.col("formatted")))
    after = len(END) + 1

    def run(x: Column, i: Column) -> Column:
        # What follows a text that counts is skipped with the next turn's head.
        learned = x["role"] == LEARNED_ROLE
        skipped = x["head_chars"] + F.when(i > 0, after).otherwise(0)
        return F.struct(
            skipped.alias("skip"),
            F.when(learned, x["text_chars"]).otherwise(0).alias("learn"),
            F.when(learned, 0).otherwise(x["text_chars"]).alias("unlearned"),
        )

    return read.select(
        "conv_id",
        "formatted",
        spoken(F.col("read")).alias("turns"),
        F.transform("read", run).alias("loss_runs"),
        (spoken(F.col("read")) == F.col("source")).alias("identical"),
    )


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, all from what was read back."""
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learned = F.filter("turns", lambda x: x["role"] == LEARNED_ROLE)
    loss = F.array_join(F.transform(learned, lambda x: x["text"]), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )
