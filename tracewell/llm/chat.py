r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are context, only that reply is
trainable. Turns after a conversation's last reply, or of one without replies, make a last example of context
alone, so that each conversation can be read back from its last example.

The template marks a turn as ``<|turn|>role<|text|>text<|end|>``. In roles and texts ``\`` becomes ``\s``,
``<`` becomes ``\l`` and ``[`` becomes ``\k``, so no control string, of this template or of another that uses
such brackets, can occur in them. Every backslash then starts one of the three, so the way back is exact.

Defined results: rows sort by turn, then role and text, nulls first; a null text or role is empty; rows with a
null conv_id form one conversation; equal rows are turns of their own; an empty table gives no examples;
further columns are ignored. A conversation is the unit that its examples quote, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\k"))


def escape(text: Column) -> Column:
    for plain, marked in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: Column) -> Column:
    for plain, marked in reversed(ESCAPES):
        text = F.replace(text, F.lit(marked), F.lit(plain))
    return text


def render(turn: Column) -> Column:
    return F.concat(F.lit(TURN), escape(turn["role"]), F.lit(TEXT), escape(turn["text"]), F.lit(END))


def format_examples(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), context, target (null: context only), formatted, mask_start, mask_end.

    ``formatted`` is context + target; code points from mask_start to mask_end are trainable.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    shown = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), render(t).alias("shown"))).alias("turns"))
    reply = F.filter(
        F.transform("turns", lambda t, i: F.when((t["role"] == "assistant") | (i == F.size("turns") - 1), i)), lambda i: i.isNotNull()
    )
    each = shown.select("conv_id", "turns", F.posexplode(reply).alias("example", "at"))
    is_reply = F.element_at("turns", F.col("at") + 1)["role"] == "assistant"
    head = F.concat(F.lit(TURN), escape(F.lit("assistant")), F.lit(TEXT))
    last = F.element_at("turns", F.col("at") + 1)["shown"]
    before = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("at")), lambda t: t["shown"]), "")
    each = each.select(
        "conv_id",
        "example",
        F.when(is_reply, F.concat(before, head)).otherwise(F.concat(before, last)).alias("context"),
        F.when(is_reply, F.expr(f"substring(element_at(turns, at + 1).shown, {len(TURN + 'assistant' + TEXT) + 1})")).alias("target"),
    )
    formatted = F.concat("context", F.coalesce("target", F.lit("")))
    start = F.length("context").cast("long")
    end = F.when(F.col("target").isNull(), start).otherwise(start + F.length("target") - len(END))
    return each.select("conv_id", "example", "context", "target", formatted.alias("formatted"), start.alias("mask_start"), end.alias("mask_end"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example: array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda p: p != "")
    return F.transform(
        F.transform(pieces, lambda p: F.split(F.substr(p, F.lit(len(TURN) + 1)), r"<\|text\|>", -1)),
        lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")),
    )


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted examples: turns, trainable text and sizes."""
    loss = unescape(F.expr("substring(formatted, cast(mask_start + 1 as int), cast(mask_end - mask_start as int))"))
    each = examples.select("conv_id", "example", "formatted", loss.alias("loss"))
    per = each.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    per = per.withColumn("turns", read_turns(F.col("whole")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


PROBE = "</s>[INST] ok [/INST]"

ORACLE = f"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'),
sized as (
  select *, 2 * (length(role) + length(text)) + {len(TURN + TEXT + END)}
            - length(regexp_replace(role, '[\\\\<\\[]', '', 'g')) - length(regexp_replace(text, '[\\\\<\\[]', '', 'g')) as shown,
         row_number() over (partition by conv_id order by turn nulls first, role, text) as k,
         count(*) over (partition by conv_id) as n from rows_),
cum as (select *, sum(shown) over (partition by conv_id order by k rows unbounded preceding) as until from sized)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
       sum(until) filter (role = 'assistant' or k = n)::bigint as formatted_chars
from cum group by conv_id
"""
