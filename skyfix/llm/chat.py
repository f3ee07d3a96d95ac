r"""Chat formatting with prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, its text alone trainable
(`loss_start`, `loss_end`, in characters of `formatted`). A conversation that doesn't end with an assistant turn also gives its whole
text once as an example without a target, so that the output holds every turn.

The template wraps a turn in markers made of `<` and `[`; texts can't contain these once escaped (`\` as `\e`, `<` as `\l`, `[` as `\s`,
and in names of other roles `>` as `\g`), so control strings in texts stay text, and the output is read back without loss.

Defined results: null texts and roles are empty; rows of a conversation are ordered by turn (nulls first), ties by role and text,
and repeated rows are turns of their own; a row without a conv_id belongs to nothing and is a conversation of its own. Other columns are never read. Empty input, empty output.
An example holds its whole context, as the method says, so the output grows with the square of a conversation's turns; a conversation
is one row of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's markers for known roles.
MARKERS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<r:", ">", "</r>")
TURN = r"\[INST\][^\[<]*\[/INST\]|<s>[^\[<]*</s>|<<SYS>>[^\[<]*<</SYS>>|<r:[^>]*>[^\[<]*</r>"
REPLY = "assistant"


def _swap(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _swap(c, [("\\", "\\e"), ("<", "\\l"), ("[", "\\s")])


def unescape(c: Column) -> Column:
    return _swap(c, [("\\l", "<"), ("\\s", "["), ("\\g", ">"), ("\\e", "\\")])


def _opening(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), _swap(escape(role), [(">", "\\g")]), F.lit(OTHER[1]))
    for name, (a, _) in MARKERS.items():
        out = F.when(role == name, F.lit(a)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(OTHER[2])
    for name, (_, b) in MARKERS.items():
        out = F.when(role == name, F.lit(b)).otherwise(out)
    return out


def expand(turns: DataFrame) -> DataFrame:
    """Examples: conv_id, position (of the last turn, from 0), formatted, loss_start, loss_end (equal: nothing to train on)."""
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    open_, close = _opening(role), _closing(role)
    part = F.struct(F.col("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("plain"), F.concat(open_, text, close).alias("text"), F.length(open_).alias("opening"), F.length(close).alias("closing"))
    rows = turns.select("conv_id", part.alias("part"))
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    whole = whole.unionByName(rows.where("conv_id is null").select("conv_id", F.array("part").alias("parts")))
    targets = F.expr(f"filter(sequence(0, size(parts) - 1), i -> parts[i].role = '{REPLY}' or i = size(parts) - 1)")
    each = whole.select("conv_id", "parts", F.explode(targets).alias("position"))
    upto = F.slice("parts", F.lit(1), F.col("position") + 1)
    last = F.expr("parts[position]")
    rows = each.select("conv_id", "position", F.array_join(F.transform(upto, lambda p: p["text"]), "").alias("formatted"), last["opening"].alias("opening"), last["closing"].alias("closing"), F.length(last["text"]).alias("size"), (last["role"] == REPLY).alias("target"))
    total = F.length("formatted")
    end = F.when(F.col("target"), total - F.col("closing")).otherwise(total)
    start = F.when(F.col("target"), total - F.col("size") + F.col("opening")).otherwise(total)
    return rows.select("conv_id", "position", "formatted", start.alias("loss_start"), end.alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""

    def turn(t: Column) -> Column:
        other = F.substring_index(F.substring(t, len(OTHER[0]) + 1, 1 << 30), OTHER[1], 1)
        role, opening, closing = unescape(other), F.length(other) + len(OTHER[0]) + len(OTHER[1]), F.lit(len(OTHER[2]))
        for name, (a, b) in MARKERS.items():
            mine = F.startswith(t, F.lit(a))
            role, opening, closing = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, F.lit(len(a))).otherwise(opening), F.when(mine, F.lit(len(b))).otherwise(closing)
        return F.struct(role.alias("role"), unescape(F.substring(t, opening + 1, F.length(t) - opening - closing)).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def digests(examples: DataFrame) -> DataFrame:
    """Read back from examples, per conversation (an example without a conv_id is one): n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    loss = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    rows = examples.select("conv_id", "position", "formatted", F.struct("position", loss.alias("text")).alias("loss"))
    held = rows.where("conv_id is not null").groupBy("conv_id").agg(F.max_by("formatted", "position").alias("formatted"), F.sort_array(F.collect_list("loss")).alias("losses"), F.sum(F.length("formatted").cast("long")).alias("formatted_chars"))
    held = held.unionByName(rows.where("conv_id is null").select("conv_id", "formatted", F.array("loss").alias("losses"), F.length("formatted").cast("long").alias("formatted_chars")))
    held = held.select("conv_id", read_turns(F.col("formatted")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["text"]), "").alias("loss"), "formatted_chars")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return held.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
