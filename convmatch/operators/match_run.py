"""The whole way from users' vectors to the rows of the serving tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import assemble, cluster, paths, scoring, serving, similarity

GROUP = ["current_user_id", "match_group_id"]
CATEGORY_ASK = "Name the category of the conversations below: research, humanistic, practical or coding.\nAnswer with a JSON object with the key category.\n\n"


def clustered_members(top: DataFrame, vectors: DataFrame, dimensions: int = 100, least: int = 5) -> DataFrame:
    """Members of every match with cluster_id: one reduction for all vectors, density clusters
    in each match group, numbers over a user's groups.  ``vectors``: user_id, conversation_id, v."""
    reduced, _ = cluster.reduce_dimensions(vectors, "v", dimensions)
    members = cluster.match_members(top, reduced.select("user_id", "conversation_id", "v", "reduced"))
    labels = cluster.density_clusters(members, GROUP, "conversation_id", "reduced", least).drop("strength")
    return cluster.number_clusters(members.join(labels, [*GROUP, "conversation_id"]))


def categories(members: DataFrame, scorer: scoring.Scorer, sample: int = 10) -> DataFrame:
    """Category of every cluster from a prompt of at most ``sample`` numbered summaries."""
    by = [*GROUP, "cluster_id"]
    w = Window.partitionBy(*by).orderBy(similarity.sample_order(F.col("conversation_id")), "conversation_id", "user_id")
    some = members.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= sample)
    line = F.concat(F.col("_i").cast("string"), F.lit(". "), F.coalesce("summary", F.lit("No summary")))
    asked = some.groupBy(*by).agg(F.concat(F.lit(CATEGORY_ASK), assemble.ordered_text(["_i"], line, "\n")).alias("prompt"))
    return scoring.complete(asked, "prompt", scorer).select(*by, assemble.parse_category(F.col("answer")).alias("category"))


def match_run(vectors: DataFrame, summaries: DataFrame, questions: DataFrame, categorise: scoring.Scorer, connect: scoring.Scorer, save: paths.saver, k: int = 5, total: int = paths.MAX_PATHS, candidates: int | None = None) -> dict[str, DataFrame]:
    """Match all users and discover their paths.

    ``vectors``: user_id, conversation_id, v.  ``summaries``: user_id, conversation_id, title,
    summary, date_text.  ``questions``: user_id, conversation_id, questions.  With
    ``candidates`` users are compared through inverted lists, else all pairs.

    Returns the tables ``matches`` (u1, u2, score), ``paths`` (lists of conversation ids, both
    users, valid), ``user_paths`` (two rows a valid path) and ``errors``.
    """
    if candidates is None:
        top = similarity.top_users(similarity.user_similarity(vectors), k)
    else:
        top = similarity.candidate_top_users(vectors, k, candidates=candidates)
    top = save(top.select("user_id", "other_id", "similarity", "match_group_id"))
    members = clustered_members(top, vectors).join(summaries, ["user_id", "conversation_id"], "left").drop("reduced")
    members = save(members)
    members = members.join(categories(members, categorise), [*GROUP, "cluster_id"], "left").withColumn("category", F.coalesce("category", F.lit("practical")))
    rows = paths.with_questions(paths.rows_of_sides(members), questions)
    rows = save(rows.select(*GROUP, "cluster_id", "category", "row_idx", "user_id", "conversation_id", "mine", "title", "summary", "date_text", "questions", "v"))
    found, errors = paths.discover_paths(rows, lambda d: scoring.complete(d, "prompt", connect, error="error"), save, total=total, with_errors=True)
    served, _ = paths.to_conversations(paths.drop_repeated_ids(found, GROUP), rows, GROUP)
    served = save(serving.valid_paths(served, users=("current_user_id", "other_user_id")))
    pair = top.withColumn("_k", serving.pair_key("user_id", "other_id")).groupBy("_k").agg(F.max("similarity").alias("score"))
    return {
        "matches": pair.select(F.col("_k")[0].alias("u1"), F.col("_k")[1].alias("u2"), "score"),
        "paths": served,
        "user_paths": serving.user_paths(served.where("valid"), "current_user_id", "other_user_id").select("user_id", "path_id", "side"),
        "errors": errors,
    }
