"""Conversation texts, summaries and records from exchanges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import exchange_text, json_object, typed_field


def ordered_text(order: list[str], text: Column, sep: str) -> Column:
    """Texts of a group in order, nulls skipped, joined."""
    items = F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct(*order, text.alias("t")))))
    return F.array_join(F.transform(items, lambda x: x["t"]), sep)


def conversations(exchanges: DataFrame, newest: int | None = 1500) -> DataFrame:
    """One row for each conversation: text, first title and start; newest N of each user.

    Conversations whose text is null or has one character at most are dropped.
    """
    first = F.min(F.struct("date", "time", "turn", "title"))
    c = exchanges.groupBy("user_id", "conversation_id").agg(
        ordered_text(["date", "time", "turn"], exchange_text(), "\n\n").alias("text"), first.alias("f")
    )
    c = c.where(F.length("text") > 1).select(
        "user_id", "conversation_id", "text", F.col("f.title").alias("title"), F.col("f.date").alias("start_date"), F.col("f.time").alias("start_time")
    )
    if newest is None:
        return c
    w = Window.partitionBy("user_id").orderBy(F.desc("start_date"), F.desc("start_time"), "conversation_id")
    return c.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= newest).drop("_n")


def questions(exchanges: DataFrame) -> DataFrame:
    """Questions of each conversation in time order, as an array."""
    q = F.sort_array(F.collect_list(F.when(F.col("question").isNotNull(), F.struct("date", "time", "turn", "question"))))
    return exchanges.groupBy("user_id", "conversation_id").agg(F.transform(q, lambda x: x["question"]).alias("questions"))


def summary_prompt(text: Column, title: Column) -> Column:
    """Prompt that asks for a JSON object {summary, is_sensitive}; null if the text is null."""
    return F.concat(
        F.lit("Summarise the conversation below in at most three sentences and say whether it is sensitive.\n"),
        F.lit("Answer with a JSON object with the keys summary (string) and is_sensitive (boolean).\n\nTITLE: "),
        F.coalesce(title, F.lit("No title")), F.lit("\n\n"), text,
    )


def parse_summary(completion: Column) -> Column:
    """struct(summary, is_sensitive) if both are there with their types, else null."""
    s, b = typed_field(completion, "summary", "string"), typed_field(completion, "is_sensitive", "boolean")
    return F.when(s.isNotNull() & b.isNotNull(), F.struct(s.alias("summary"), b.alias("is_sensitive")))


def parse_category(completion: Column, default: str = "practical") -> Column:
    return F.coalesce(F.lower(F.get_json_object(json_object(completion), "$.category")), F.lit(default))


def messages_text(messages: str, me: str, name: str) -> Column:
    """Lines 'sender at date time: content' of an array of message structs."""
    return F.array_join(
        F.transform(messages, lambda m: F.concat(F.when(m["from"] == me, name).otherwise(m["from"]), F.lit(" at "), m["date"], F.lit(" "), m["time"], F.lit(": "), m["content"])),
        "\n",
    )


def summary_records(convs: DataFrame, qs: DataFrame) -> DataFrame:
    """Conversations with a summary, a date text, a category and their questions."""
    date = F.when(F.col("start_date").isNull(), "Unknown").otherwise(F.concat(F.col("start_date").cast("string"), F.lit(" "), F.substring("start_time", 1, 5)))
    c = convs.where("summary is not null").withColumn("date_text", F.coalesce(date, F.lit("Unknown"))).withColumn("category", F.coalesce("category", F.lit("practical")))
    return c.join(qs, ["user_id", "conversation_id"], "left").withColumn("questions", F.coalesce("questions", F.array().cast("array<string>")))


def row_limit(df: DataFrame, order: list[str], rows: int = 50) -> DataFrame:
    """The first ``rows`` rows, for sub-sampled runs."""
    return df.orderBy(*order).limit(rows)
