"""Chat exports, per-user tables and JDBC tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MESSAGE = "struct<id: string, author: struct<role: string, name: string>, create_time: double, content: struct<content_type: string, parts: array<string>>, status: string, weight: double>"
#: Both shapes of an export: a message tree (mapping) or a message list (chat_messages).
EXPORT_SCHEMA = (
    f"id string, conversation_id string, title string, create_time double, update_time double, current_node string, "
    f"mapping map<string, struct<id: string, parent: string, children: array<string>, message: {_MESSAGE}>>, "
    "uuid string, name string, created_at string, updated_at string, "
    "chat_messages array<struct<uuid: string, text: string, sender: string, created_at: string, updated_at: string, "
    "content: array<struct<start_timestamp: string, stop_timestamp: string, type: string, text: string>>>>"
)


def read_exports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Conversations of all users' exports ``.../<user>/<provider>/latest.json``, any shape.

    Folders may be named ``key=value``.  With ``lines`` a file holds one conversation a line,
    so that Spark can split it: the form for archives in bulk.
    """
    return with_owner(spark.read.schema(EXPORT_SCHEMA).option("multiLine", not lines).json(path))


def with_owner(raw: DataFrame) -> DataFrame:
    """Add user_id, provider (from the file's path) and shape."""
    owner = lambda i: F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)/(?:[^/=]+=)?([^/=]+)/[^/]+$", i)
    return raw.select(*[c for c in raw.columns if c not in ("user", "user_id", "provider")], owner(1).alias("user_id"), owner(2).alias("provider")).withColumn("shape", shape_of())


def shape_of() -> Column:
    """'tree', 'list' or 'unknown', from the keys of each row."""
    tree = F.col("mapping").isNotNull() & F.coalesce("conversation_id", "id").isNotNull()
    return F.when(tree, "tree").when(F.col("chat_messages").isNotNull() & F.col("uuid").isNotNull(), "list").otherwise("unknown")


def choose_provider(uploads: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Rows of the first provider, by rank, that each user has."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col("provider")], F.lit(len(ranks)))
    w = Window.partitionBy("user_id").orderBy("_rank", "provider")
    return uploads.withColumn("_rank", rank).withColumn("_n", F.dense_rank().over(w)).where("_n = 1").drop("_rank", "_n")


def tree_exchanges(convs: DataFrame) -> DataFrame:
    """Each user node of a message tree with its newest assistant child (first of ties)."""
    nodes = convs.where("shape = 'tree'").select("user_id", F.coalesce("id", "conversation_id").alias("conversation_id"), "title", "mapping", F.explode("mapping").alias("node_id", "node"))
    m = F.col("node.message")
    nodes = nodes.where((m["author"]["role"] == "user") & (F.coalesce(m["create_time"], F.lit(0.0)) != 0) & m["content"].isNotNull())
    kids = F.transform(F.coalesce("node.children", F.array().cast("array<string>")), lambda c, i: F.struct(F.element_at("mapping", c)["message"].alias("m"), i.alias("i")))
    kids = F.filter(kids, lambda k: k["m"]["author"]["role"] == "assistant")
    best = F.array_max(F.transform(kids, lambda k: F.struct(F.coalesce(k["m"]["create_time"], F.lit(0.0)).alias("t"), (-k["i"]).alias("p"), F.array_join(k["m"]["content"]["parts"], "\n").alias("text"))))
    ts = F.timestamp_seconds(m["create_time"])
    return nodes.select(
        "user_id", "conversation_id", "title", F.to_date(ts).alias("date"), F.date_format(ts, "HH:mm:ss").alias("time"),
        F.array_join(m["content"]["parts"], "\n").alias("question"), F.coalesce(best["text"], F.lit("")).alias("answer"),
    )


def list_exchanges(convs: DataFrame) -> DataFrame:
    """Each human message of a message list that an assistant message follows directly."""
    rows = convs.where("shape = 'list'").select("user_id", F.col("uuid").alias("conversation_id"), F.col("name").alias("title"), "chat_messages")
    both = F.zip_with(
        F.slice("chat_messages", 1, F.greatest(F.size("chat_messages") - 1, F.lit(0))),
        F.slice("chat_messages", 2, F.greatest(F.size("chat_messages"), F.lit(0))),
        lambda a, b: F.struct(a.alias("q"), b.alias("a")),
    )
    rows = rows.select("user_id", "conversation_id", "title", F.explode(both).alias("x")).where("x.q.sender = 'human' and x.a.sender = 'assistant'")
    ts = F.to_timestamp("x.q.created_at")
    return rows.select("user_id", "conversation_id", "title", F.to_date(ts).alias("date"), F.date_format(ts, "HH:mm:ss").alias("time"), F.col("x.q.text").alias("question"), F.col("x.a.text").alias("answer"))


def exchanges(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exchanges, rejects): empty strings become null; users without an exchange and rows of
    unknown shape are rejected, the others go on."""
    from ..functions.text import empty_to_null

    out = tree_exchanges(convs).unionByName(list_exchanges(convs))
    out = out.withColumns({c: empty_to_null(F.col(c)) for c in ("title", "question", "answer")})
    empty = convs.select("user_id").distinct().join(out.select("user_id").distinct(), "user_id", "left_anti").withColumn("reason", F.lit("no exchange"))
    odd = convs.where("shape = 'unknown'").select("user_id", F.lit("unknown shape").alias("reason"))
    return out, empty.unionByName(odd)


def ordered(rows: DataFrame, by: tuple[str, ...] = ("conversation_id", "date", "time")) -> DataFrame:
    """Exchanges in the order of a sink, with their position in the conversation (from 1)."""
    w = Window.partitionBy(by[0]).orderBy(*by[1:], "question")
    return rows.withColumn("position", F.row_number().over(w)).orderBy(by[0], "position")


def already_loaded(rows: DataFrame, served: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Rows whose key the serving table has."""
    return rows.join(served.select(key), key, "left_semi")


def of_known_users(rows: DataFrame, users: DataFrame, removed: DataFrame, key: str = "user_id") -> DataFrame:
    """Materialised rows of the users there are, without those that were removed."""
    return rows.join(users.select(key), key, "left_semi").join(removed.select(key), key, "left_anti")


def active_partitions(materialised: DataFrame, current: DataFrame, key: str = "user_id") -> DataFrame:
    return materialised.select(key).intersect(current.select(key))


def redact_exports(convs: DataFrame) -> DataFrame:
    """Redact the message texts of both shapes and nothing else."""
    from ..functions.text import redact

    tree = F.transform_values(
        "mapping",
        lambda _, n: n.withField("message", F.when(n["message"]["content"].isNotNull(), n["message"].withField("content.parts", F.transform(n["message"]["content"]["parts"], redact))).otherwise(n["message"])),
    )
    items = F.transform(
        "chat_messages",
        lambda m: m.withField("text", redact(m["text"])).withField("content", F.transform(m["content"], lambda c: c.withField("text", redact(c["text"])))),
    )
    return convs.withColumn("mapping", tree).withColumn("chat_messages", items)


def duplicate_uploads(uploads: DataFrame, content: str = "content") -> DataFrame:
    """Uploads whose bytes another user uploaded too, by MD5."""
    h = uploads.withColumn("md5", F.md5(content))
    shared = h.groupBy("md5").agg(F.min("user_id").alias("lo"), F.max("user_id").alias("hi")).where("lo <> hi").select("md5")
    return h.join(shared, "md5", "left_semi")


def partition_diff(listed: DataFrame, processed: DataFrame, key: str = "user_id") -> DataFrame:
    """Keys to add (listed only) and to delete (processed only)."""
    a, b = listed.select(key).distinct(), processed.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("action", F.lit("add")).unionByName(b.join(a, key, "left_anti").withColumn("action", F.lit("delete")))


def write_by_user(df: DataFrame, path: str) -> None:
    """One partition for each user; only the users in ``df`` are overwritten."""
    df.write.partitionBy("user_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_user(spark: SparkSession, path: str, user_id: object) -> DataFrame:
    return spark.read.parquet(path).where(F.col("user_id") == user_id)


def poll_uploads(spark: SparkSession, path: str, schema: str = EXPORT_SCHEMA, lines: bool = False) -> DataFrame:
    """Stream of newly arrived export files; a trigger of 30 seconds polls for them."""
    return spark.readStream.schema(schema).option("multiLine", not lines).json(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A directory of messenger exports: datetime, role, content."""
    raw = spark.read.schema("datetime string, role string, content string").option("multiLine", True).json(path)
    return raw.withColumn("datetime", F.to_timestamp("datetime"))


def read_jdbc(spark: SparkSession, url: str, query_table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=query_table, **options).load()


def write_jdbc(df: DataFrame, url: str, target: str, batch: int = 1000, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=target, batchsize=str(batch), **options).mode("append").save()
