"""Chat formatting in Spark expressions: conversations as marked text with a loss mask, and back.

The turns of a conversation are collected as structs and sorted; runs of adjacent turns of one role
are cut out of the sorted array and merged under one header; everything is joined to

    <|im_start|>ROLE\\nTEXT<|im_next|>TEXT<|im_end|>\\n

where <|im_next|> parts the merged turns, so that none is lost. No control string can come from the
data: `<`, backslashes and `|` in a text or role get one backslash more, which reading takes away
again, and a line feed within a role is <|im_line|>.

The loss mask is a run-length code in code points, one entry a turn: `skip` characters without loss
(marks, headers, turns of other roles), then `take` characters with loss. What follows the last entry
has none.

Cases: a null text or role counts as empty. Turns are ordered by turn (nulls first), then role, then
text, so that ties and repeated rows have a place; each row is a turn. Rows without conv_id are one
conversation. An empty table gives an empty result; other columns play no part. A conversation is one
value, and so is bounded by what a value can hold (2 GB); all steps are linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEXT, LINE = "<|im_start|>", "<|im_end|>", "<|im_next|>", "<|im_line|>"


def escaped(text: Column) -> Column:
    """The text without control strings: every `<`, backslashes, `|` has a backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def pieces(text: Column, mark: str) -> Column:
    """What stands between the marks; empty pieces stay."""
    return F.split(text, mark.replace("|", r"\|"), -1)


def collected(turns: DataFrame) -> DataFrame:
    """conv_id and its sorted turns (turn, role, text), escaped."""
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(LINE))
    row = F.struct("turn", role.alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"))
    return turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))


def merged(turns: Column) -> Column:
    """Runs of adjacent turns of one role: role, texts."""
    n = F.size(turns)
    same = lambda i: F.get(turns, i).getField("role") == F.get(turns, i - 1).getField("role")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~same(i))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n))
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(turns, a).getField("role").alias("role"), F.transform(F.slice(turns, a + 1, b - a), lambda t: t.getField("text")).alias("texts")))


def formatted(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted (the marked text), n_runs, and loss: the mask of the texts of one role."""
    runs = collected(turns).select("conv_id", merged(F.col("turns")).alias("runs"))
    laid = lambda r: F.concat(F.lit(START), r.getField("role"), F.lit("\n"), F.array_join(r.getField("texts"), NEXT), F.lit(END + "\n"))

    def spans(run: Column, k: Column) -> Column:
        before = F.length(run.getField("role")) + len(START) + 1 + F.when(k > 0, len(END) + 1).otherwise(0)
        mark = lambda i: F.when(i == 0, before).otherwise(len(NEXT))
        size = lambda x: F.when(run.getField("role") == learn, F.length(x)).otherwise(0)
        return F.transform(run.getField("texts"), lambda x, i: F.struct((mark(i) + F.length(x) - size(x)).alias("skip"), size(x).alias("take")))

    return runs.select("conv_id", F.array_join(F.transform("runs", laid), "").alias("formatted"), F.size("runs").alias("n_runs"), F.flatten(F.transform("runs", spans)).alias("loss"))


def parsed(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation, from its text alone."""
    runs = F.slice(pieces(text, START), F.lit(2), F.greatest(F.size(pieces(text, START)) - 1, F.lit(0)))

    def turns(run: Column) -> Column:
        role = F.substring_index(run, "\n", 1)
        body = F.substring(run, F.length(role) + 2, F.length(run) - F.length(role) - 1 - len(END + "\n"))
        return F.transform(pieces(body, NEXT), lambda x: F.struct(unescaped(F.replace(role, F.lit(LINE), F.lit("\n"))).alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(runs, turns))


def under_mask(turns: Column, loss: Column) -> Column:
    """All text under the mask, in order, nothing between."""
    return F.array_join(F.zip_with(turns, loss, lambda t, m: F.when(m.getField("take") > 0, t.getField("text")).otherwise("")), "")


def digests(made: DataFrame) -> DataFrame:
    """What a reader gets from formatted conversations: turns and loss text, as counts and digests."""
    read = made.select("conv_id", "formatted", "n_runs", "loss", parsed(F.col("formatted")).alias("turns"))
    read = read.select("conv_id", "turns", "n_runs", F.length("formatted").cast("long").alias("formatted_chars"), under_mask(F.col("turns"), F.col("loss")).alias("loss_text"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
        F.col("n_runs").cast("long").alias("n_runs"),
    )
