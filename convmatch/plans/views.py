"""The test tables as the inputs of the operators, in Spark and as SQL common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import shared_root


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_vec(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "embeddings").where("embedding is not null").selectExpr(
        "vec_id % 20 as user_id", "vec_id as conversation_id", "cast(embedding as array<double>) as v", "cast(label as bigint) as label"
    )


USER_VEC = """user_vec AS (SELECT vec_id % 20 AS user_id, vec_id AS conversation_id, CAST(embedding AS DOUBLE[]) AS v,
  CAST(label AS BIGINT) AS label FROM embeddings WHERE embedding IS NOT NULL)"""

SIMS = f"""{USER_VEC},
sampled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (conversation_id * 7919) % 1000003, conversation_id) AS n
  FROM user_vec) WHERE n <= 100),
best AS (SELECT a.user_id, b.user_id AS other_id, a.conversation_id, max(list_inner_product(a.v, b.v)) AS s
  FROM sampled a JOIN user_vec b ON a.user_id <> b.user_id GROUP BY ALL),
sims AS (SELECT user_id, other_id, avg(s) AS similarity FROM best GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(similarity, 9) DESC, other_id) AS rank FROM sims) WHERE rank <= 5)"""

MEMBERS = f"""{SIMS},
both_users AS (SELECT user_id AS current_user_id, rank - 1 AS match_group_id, unnest([user_id, other_id]) AS user_id FROM top),
newest AS (SELECT * FROM user_vec QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY conversation_id DESC) <= 1500),
members AS (SELECT b.current_user_id, b.match_group_id, b.user_id, u.conversation_id, u.label, u.v FROM both_users b JOIN newest u USING (user_id)),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY current_user_id ORDER BY match_group_id, label) - 1 AS cluster_id FROM members)"""

CATEGORY = "CASE label % 4 WHEN 0 THEN 'research' WHEN 1 THEN 'humanistic' WHEN 2 THEN 'practical' ELSE 'coding' END"

SIDES = f"""{MEMBERS},
sides AS (SELECT current_user_id, match_group_id, cluster_id, min({CATEGORY}) AS category,
  count(*) FILTER (WHERE user_id = current_user_id) AS n1, count(*) FILTER (WHERE user_id <> current_user_id) AS n2 FROM numbered GROUP BY ALL),
balanced AS (SELECT *, round(abs(ln(n1::DOUBLE / n2)), 9) AS imbalance, 1.0::DOUBLE / (n1 + n2) AS magnitude FROM sides WHERE n1 > 0 AND n2 > 0)"""


def exchanges(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w)).withColumn("title", F.substring(F.first("text").over(w), 1, 40))
    base = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return c.where("role = 'user' and next_role = 'assistant'").select(
        (F.col("conv_id") % 20).alias("user_id"), F.col("conv_id").alias("conversation_id"), "turn", "title",
        F.date_format(base, "yyyy-MM-dd").alias("date"), F.date_format(base, "HH:mm:ss").alias("time"), F.col("text").alias("question"), "answer",
    )


EXCHANGES = """exchanges AS (SELECT conv_id % 20 AS user_id, conv_id AS conversation_id, turn, title,
  strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time, text AS question, answer FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer, substr(first_value(text) OVER w, 1, 40) AS title,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 60) AS ts
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"""


def users(spark: SparkSession, sf: str) -> DataFrame:
    first = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("created_at"))
    c = t(spark, sf, "customer").selectExpr("c_custkey as id", "c_name as name", "c_mktsegment = 'HOUSEHOLD' as sensitive_matching")
    return c.join(first, "id", "left")


USERS = """users AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment = 'HOUSEHOLD' AS sensitive_matching,
  (SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS created_at FROM customer)"""


def matches(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").selectExpr("o_orderkey as match_id", "o_custkey as owner", "o_totalprice as score", "o_orderstatus = 'F' as viewed")


def pivot(spark: SparkSession, sf: str) -> DataFrame:
    o, n = t(spark, sf, "orders"), t(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n"))
    return o.join(F.broadcast(n)).select(F.explode(F.array(F.col("o_custkey"), (F.col("o_custkey") + 7) % F.col("n"))).alias("user_id"), F.col("o_orderkey").alias("match_id"))


MATCHES = """matches AS (SELECT o_orderkey AS match_id, o_custkey AS owner, o_totalprice AS score, o_orderstatus = 'F' AS viewed FROM orders),
pivot_rows AS (SELECT o_custkey AS user_id, o_orderkey AS match_id FROM orders UNION ALL
  SELECT (o_custkey + 7) % (SELECT count(*) FROM customer), o_orderkey FROM orders)"""


def paths(spark: SparkSession, sf: str) -> DataFrame:
    line = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("path_no"))
    return line.agg(F.min("l_linestatus").alias("category"), F.min("l_discount").alias("balance"), (F.max("l_returnflag") == "R").alias("sensitive"), F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))


PATHS = """paths AS (SELECT l_orderkey AS match_id, l_linenumber AS path_no, min(l_linestatus) AS category, min(l_discount) AS balance,
  max(l_returnflag) = 'R' AS sensitive, min(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY ALL)"""
