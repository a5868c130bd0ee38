"""Preference formatting: one prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: id and its turns in order, repeated rows once; null ids are left out."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return turns.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.array_sort(F.collect_set(one)).alias("turns"))


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("none")), F.lit("|>\n"))


def _render(turn: Column) -> Column:
    return F.concat(_head(turn["role"]), F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>\n"))


def _spans(turns: Column, trained_role: str) -> Column:
    """Half-open character ranges of the trained text (with its end mark) in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        body = acc["at"] + F.length(_head(t["role"]))
        end = acc["at"] + F.length(_render(t))
        mine = F.array(F.struct(body.alias("start"), (end - 1).alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"].eqNullSafe(F.lit(trained_role)), F.concat(acc["spans"], mine)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected", trained_role: str = "assistant") -> DataFrame:
    """pairs with prompt_turns, prompt, chosen_text, rejected_text, chosen_spans, rejected_spans, equal appended.

    The prompt is the longest prefix of turns (role and text, nulls equal) that both conversations share,
    rendered once. Each completion is the rest; its spans say which characters are trained on: the text and end
    mark of trained_role's turns. Everything else, the prompt included, is masked. A null or empty conversation
    shares nothing; equal conversations have empty completions. Null roles render as "none", null texts as empty. `equal`
    marks pairs whose completions are the same text, which teach no preference: equal conversations, and partners whose
    replies are alike. Extra columns stay, whatever their names, except that those called as a new one are replaced.
    Built of array functions only; a row needs its two conversations and nothing else.
    """
    none = F.expr(f"cast(array() as {TURNS})")
    new = ["prompt_turns", "prompt", "chosen_text", "rejected_text", "chosen_spans", "rejected_spans", "equal"]
    keep = [c for c in pairs.columns if c not in new]
    # the caller's columns travel as one, so that no name of theirs meets a name used here
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    df = pairs.select(row.alias("row"), F.coalesce(F.col(f"`{chosen_col}`"), none).alias("c"), F.coalesce(F.col(f"`{rejected_col}`"), none).alias("r"))
    same = F.zip_with("c", "r", lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    df = df.withColumn("same", same).withColumn("at", F.array_position("same", F.lit(False)).cast("int"))
    df = df.withColumn("prompt_turns", F.when(F.col("at") > 0, F.col("at") - 1).otherwise(F.size("same")))
    cut = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    df = df.withColumn("prompt", F.array_join(F.transform(F.slice("c", F.lit(1), F.col("prompt_turns")), _render), ""))
    for side, c in (("chosen", "c"), ("rejected", "r")):
        df = df.withColumn("rest", cut(c)).withColumn(f"{side}_text", F.array_join(F.transform("rest", _render), "")).withColumn(f"{side}_spans", _spans(F.col("rest"), trained_role))
    df = df.withColumn("equal", F.col("chosen_text") == F.col("rejected_text"))
    return df.select(*[F.col("row")[c].alias(c) for c in keep], *new)


def with_partner_replies(turns: DataFrame, id_col: str = "conv_id", trained_role: str = "assistant") -> DataFrame:
    """Preference pairs from single conversations: id, chosen, rejected.

    Chosen is the conversation. Rejected stops before its last reply by trained_role and answers with the last
    reply of the partner conversation (ids 2k and 2k + 1 are partners), a reply to something else. Without a
    partner or a partner's reply, it just stops there; a conversation without a reply is its own rejected one.
    """
    convs = conversations(turns, id_col).withColumn("_key", F.col(id_col).cast("long"))
    replies = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"].eqNullSafe(F.lit(trained_role)))
    convs = convs.withColumn("last", F.coalesce(F.array_max(replies), F.lit(0)))
    reply = F.when(F.col("last") > 0, F.element_at("turns", F.greatest("last", F.lit(1))))
    other = convs.select(F.col("_key").bitwiseXOR(F.lit(1)).alias("_partner"), reply.alias("reply"))
    both = convs.join(other, F.col("_key") == F.col("_partner"), "left")
    before = F.slice("turns", F.lit(1), F.greatest(F.col("last") - 1, F.lit(0)))
    rejected = F.when(F.col("last") == 0, F.col("turns")).when(F.col("reply").isNull(), before).otherwise(F.concat(before, F.array("reply")))
    return both.select(id_col, F.col("turns").alias("chosen"), rejected.alias("rejected"))
