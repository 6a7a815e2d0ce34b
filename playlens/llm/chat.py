"""Chat formatting [native]: a grammar round trip.

A conversation is rendered as one string of turns

    open role mid text close        (default: "[INST] " " [/INST] " "</s>")

The loss mask is kept as run lengths, one (head, body, tail, in_loss) per turn.
``parse`` reads the string back by the grammar alone: the close mark ends a
turn, the first mid mark ends the role. Text or role that holds a control
string would be read back wrongly, so it is escaped, at the lowest of three
levels whose rendering reads back identical:

    0  as it is
    1  a backslash after the first character of each control string
    2  one more backslash also in what looks like an escaped control string

Unescaping takes one backslash out. Level 2 is reversible for every text (each
``c0 \\* rest`` gets one backslash more and loses it again), so the search ends.
The control strings of a template must not overlap one another, which the
constructor checks. The rendered conversation is parsed as a whole and compared
with the source once more (``round_trip_ok``).

Everything is DataFrame functions; no Python runs on the executors. A
conversation is one output string, so its turns meet in one row: that is the
operator's result and bounds its memory.

Nulls: a null text or role is an empty string, a null turn sorts first, a null
conversation id is a conversation of its own. Tied turns are ordered by role,
then text, and repeated rows are kept. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    open: str = "[INST] "
    mid: str = " [/INST] "
    close: str = "</s>"
    #: Further strings that must not appear unescaped inside texts.
    reserved: tuple[str, ...] = ("<s>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = self.controls()
        for a in marks:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"control string {a!r}: two characters or more, no backslash")
            for b in marks:
                if a is not b and a in b:
                    raise ValueError(f"{a!r} is part of {b!r}")
                if any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))):
                    raise ValueError(f"the end of {a!r} begins {b!r}")

    def controls(self) -> list[str]:
        return list(dict.fromkeys(x.strip() for x in (self.open, self.mid, self.close, *self.reserved)))


def _spots(t: ChatTemplate, before: str, between: str) -> str:
    """A pattern for the place behind the first character of a control string:
    ``before`` is taken there, ``between`` may lie before the rest."""
    heads: dict[str, list[str]] = {}
    for c in t.controls():
        heads.setdefault(c[0], []).append(re.escape(c[1:]))
    return "|".join(f"(?<={re.escape(h)}){before}(?={between}(?:{'|'.join(rests)}))" for h, rests in heads.items())


def escape(text: Column, level: int, t: ChatTemplate) -> Column:
    """``text`` at an escape level (0, 1 or 2)."""
    if level == 0:
        return text
    return F.regexp_replace(text, _spots(t, "", "" if level == 1 else r"\\*"), r"\\")


def unescape(text: Column, t: ChatTemplate) -> Column:
    """One backslash out of every escaped control string."""
    return F.regexp_replace(text, _spots(t, r"\\", r"\\*"), "")


def render_turn(role: Column, text: Column, t: ChatTemplate) -> Column:
    """One turn from an already escaped role and text."""
    return F.concat(F.lit(t.open), role, F.lit(t.mid), text, F.lit(t.close))


def _raw_turns(rendered: Column, t: ChatTemplate) -> Column:
    """The turns as they stand, still escaped: array of (head, role, text); head
    is the number of characters before the text. The string behind the last close
    mark is kept as a turn without role if it isn't empty."""
    pieces = F.split(rendered, re.escape(t.close), -1)
    turns = F.filter(pieces, lambda p, i: (i < F.size(pieces) - 1) | (p != ""))

    def read(p: Column) -> Column:
        at = F.locate(t.mid, p, len(t.open) + 1)
        ok = p.startswith(t.open) & (at > 0)
        head = at + F.lit(len(t.mid) - 1)
        return F.struct(
            F.when(ok, head).otherwise(0).alias("head"),
            F.when(ok, F.substring(p, F.lit(len(t.open) + 1), at - F.lit(len(t.open) + 1))).alias("role"),
            F.when(ok, F.substring(p, head + 1, F.length(p))).otherwise(p).alias("text"))

    return F.transform(turns, read)


def parse(rendered: Column, t: ChatTemplate) -> Column:
    """array<struct<role, text>> read back from a rendered conversation."""
    return F.transform(_raw_turns(rendered, t), lambda x: F.struct(
        unescape(x["role"], t).alias("role"), unescape(x["text"], t).alias("text")))


def loss_mask(rendered: Column, t: ChatTemplate) -> Column:
    """Run lengths over the rendered string: array<struct<head, body, tail, in_loss>>."""
    return F.transform(_raw_turns(rendered, t), lambda x: F.struct(
        x["head"].alias("head"), F.length(x["text"]).alias("body"), F.lit(len(t.close)).alias("tail"),
        F.coalesce(unescape(x["role"], t).isin(*t.loss_roles), F.lit(False)).alias("in_loss")))


def loss_texts(rendered: Column, mask: Column, t: ChatTemplate) -> Column:
    """The unescaped texts that the mask covers, in order, taken from the string
    by the run lengths. Turns are cut at the close mark first, so the work follows
    the length of the string and not its square."""
    cut = F.zip_with(F.split(rendered, re.escape(t.close), -1), mask, lambda p, m: F.struct(
        F.substring(p, m["head"] + 1, m["body"]).alias("text"), F.coalesce(m["in_loss"], F.lit(False)).alias("keep")))
    return F.transform(F.filter(cut, lambda x: x["keep"]), lambda x: unescape(x["text"], t))


def format_conversations(turns: DataFrame, template: ChatTemplate | None = None, conv: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv`` column, formatted, loss_mask, n_turns,
    escaped_turns (turns above level 0), round_trip_ok."""
    t = template or ChatTemplate()
    src = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"),
                       F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    source = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")))

    def at(level: int) -> Column:
        return render_turn(escape(F.col("role"), level, t), escape(F.col("text"), level, t), t)

    level = F.lit(2)
    for n in (1, 0):
        level = F.when(parse(at(n), t) == source, n).otherwise(level)
    per_turn = src.withColumn("level", level)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "level")),
                           lambda a, b: _order(a, b, ("turn", "role", "text")))
    conv_rows = per_turn.groupBy("conv").agg(ordered.alias("ts"))

    def whole(lowest: int) -> Column:
        def one(x: Column) -> Column:
            lv = F.greatest(x["level"], F.lit(lowest))
            pick = [F.when(lv == n, render_turn(escape(x["role"], n, t), escape(x["text"], n, t), t)) for n in (0, 1, 2)]
            return F.coalesce(*pick)
        return F.array_join(F.transform(F.col("ts"), one), "")

    want = F.transform(F.col("ts"), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    first = conv_rows.withColumn("f0", whole(0)).withColumn("ok0", parse(F.col("f0"), t) == want)
    done = first.withColumn("formatted", F.when(F.col("ok0"), F.col("f0")).otherwise(whole(2)))
    return done.select(
        F.col("conv").alias(conv), "formatted", loss_mask(F.col("formatted"), t).alias("loss_mask"),
        F.size("ts").cast("long").alias("n_turns"),
        F.size(F.filter("ts", lambda x: x["level"] > 0)).cast("long").alias("escaped_turns"),
        (parse(F.col("formatted"), t) == want).alias("round_trip_ok"))


def _order(a: Column, b: Column, keys: tuple[str, ...]) -> Column:
    """-1, 0 or 1 for two structs by ``keys``, nulls first."""
    out = F.lit(0)
    for k in reversed(keys):
        x, y = a[k], b[k]
        out = (F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1)
                .when(x < y, -1).when(x > y, 1).otherwise(out))
    return out


def digests(formatted: DataFrame, template: ChatTemplate | None = None, conv: str = "conv_id") -> DataFrame:
    """Digest columns read back from the formatted strings."""
    t = template or ChatTemplate()
    back = formatted.select(conv, "formatted", "loss_mask", parse(F.col("formatted"), t).alias("turns"),
                            loss_texts(F.col("formatted"), F.col("loss_mask"), t).alias("texts"),
                            "escaped_turns", "round_trip_ok")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.col("texts"), "")
    return back.select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "escaped_turns", "round_trip_ok")
