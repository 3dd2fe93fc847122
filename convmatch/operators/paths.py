"""Path discovery: a round loop over all users and match groups at once, and its parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.repair import repair_json
from ..functions.text import json_object
from .balance import fit_scaler, imbalance, matched_distance, scaled_sum
from .tables import saver

# fixed values: ratios, limits, the keys of an answer and the default title
CATEGORY_RATIOS = {"research": 0.4, "humanistic": 0.4, "practical": 0.2, "coding": 0.0}
MAX_PATHS, MAX_CALLS = 10, 200
DEFAULT_TITLE = "Serendipitous Connection"

ANSWER = (
    "path_title string, common_indices array<bigint>, user1_unique_indices array<bigint>, user2_unique_indices array<bigint>, "
    "common_background string, is_sensitive boolean"
)
PATH_SCHEMA = (
    "path_id string, current_user_id bigint, other_user_id bigint, match_group_id int, cluster_id bigint, category string, path_seq bigint, title string, "
    "common array<bigint>, user1 array<bigint>, user2 array<bigint>, len_user1 int, len_user2 int, background string, is_sensitive boolean"
)

ERROR_SCHEMA = "current_user_id bigint, match_group_id int, cluster_id bigint, category string, round int, reason string"


def parse_answer(answer: Column) -> Column:
    """Three disjoint id lists of an answer, sorted and distinct; ``ok`` if none is empty."""
    a = F.from_json(json_object(answer), ANSWER)
    lists = lambda c: F.sort_array(F.array_distinct(F.coalesce(c, F.array().cast("array<bigint>"))))
    common = lists(a["common_indices"])
    u1 = F.array_except(lists(a["user1_unique_indices"]), common)
    u2 = F.array_except(F.array_except(lists(a["user2_unique_indices"]), common), u1)
    return F.struct(
        F.coalesce(a["path_title"], F.lit(DEFAULT_TITLE)).alias("title"), common.alias("common"), u1.alias("user1"), u2.alias("user2"),
        a["common_background"].alias("background"), F.coalesce(a["is_sensitive"], F.lit(False)).alias("is_sensitive"),
        ((F.size(common) > 0) & (F.size(u1) > 0) & (F.size(u2) > 0)).alias("ok"),
    )


def quota(ratio: Column, total: int = MAX_PATHS) -> Column:
    return F.ceil(F.round(ratio * total, 9)).cast("long")


def one_shot_quota(clusters: DataFrame, ratios: DataFrame, by: list[str], score: str, total: int = MAX_PATHS) -> DataFrame:
    """Best clusters of each category up to its quota, then ``total`` of each group."""
    c = clusters.join(F.broadcast(ratios), "category").where("ratio > 0")  # the caller's table of categories
    w = Window.partitionBy(*by, "category").orderBy(score, "cluster_id")
    c = c.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= quota(F.col("ratio"), total))
    g = Window.partitionBy(*by).orderBy(F.desc("ratio"), "category", "_n")
    return c.withColumn("path_seq", F.row_number().over(g)).where(F.col("path_seq") <= total).drop("_n")


def side_text(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Text block of each side: ID, title, date and summary of its conversations, and their
    questions where ``rows`` has a column of them."""
    line = F.concat(F.lit("ID: "), F.col("row_idx").cast("string"), F.lit("\nTitle: "), F.coalesce("title", F.lit("No title")), F.lit("\nDate: "), F.coalesce("date_text", F.lit("Unknown")), F.lit("\nSummary: "), F.coalesce("summary", F.lit("No summary")))
    if "questions" in rows.columns:
        asked = F.filter("questions", lambda q: F.length(q) > 0)
        line = F.concat(line, F.when(F.size(asked) > 0, F.concat(F.lit("\nQuestions Asked:\n  - "), F.array_join(asked, "\n  - "))).otherwise(""))
    items = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n\n").alias("block"))


PATH_ASK = (
    "Find what connects the two users below and name the conversations by ID.\nAnswer with a JSON object with the keys path_title, common_indices, "
    "user1_unique_indices, user2_unique_indices, common_background and is_sensitive.\n\nUSER 1\n"
)


def path_prompt(block1: Column, block2: Column) -> Column:
    """Prompt of both sides' blocks; null if either is null."""
    return F.concat(F.lit(PATH_ASK), block1, F.lit("\n\nUSER 2\n"), block2)


def with_questions(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Add the questions of each conversation; an empty list where there are none."""
    keys = ["user_id", "conversation_id"]
    return rows.join(questions.select(*keys, "questions"), keys, "left").withColumn("questions", F.coalesce("questions", F.array().cast("array<string>")))


def drop_repeated_ids(paths: DataFrame, by: list[str]) -> DataFrame:
    """First use of an id in a group wins: by path, then common, user1, user2, then place."""
    lists = F.array(*[F.struct(F.lit(i).alias("l"), F.col(c).alias("ids")) for i, c in enumerate(("common", "user1", "user2"))])
    items = paths.select(*by, "path_seq", F.explode(lists).alias("x")).select(*by, "path_seq", "x.l", F.posexplode("x.ids").alias("pos", "id"))
    w = Window.partitionBy(*by, "id").orderBy("path_seq", "l", "pos")
    first = items.withColumn("_n", F.row_number().over(w)).where("_n = 1")

    def ids(i: int) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("l") == i, F.struct("pos", "id")))), lambda x: x["id"])

    back = first.groupBy(*by, "path_seq").agg(ids(0).alias("common"), ids(1).alias("user1"), ids(2).alias("user2"))
    none = F.array().cast("array<bigint>")
    return paths.drop("common", "user1", "user2").join(back, [*by, "path_seq"], "left").withColumns({c: F.coalesce(c, none) for c in ("common", "user1", "user2")})


def to_conversations(paths: DataFrame, members: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(paths with conversation ids in the lists, ids that no member has)."""
    names = ("common", "user1", "user2")
    lists = F.array(*[F.struct(F.lit(i).alias("l"), F.col(c).alias("ids")) for i, c in enumerate(names)])
    items = paths.select(*by, "path_seq", F.explode(lists).alias("x")).select(*by, "path_seq", "x.l", F.posexplode("x.ids").alias("pos", "row_idx"))
    got = items.join(members.select(*by, "row_idx", "conversation_id"), [*by, "row_idx"], "left")

    def ids(i: int) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("l") == i, F.struct("pos", "conversation_id")))), lambda x: x["conversation_id"])

    back = got.groupBy(*by, "path_seq").agg(*[ids(i).alias(c) for i, c in enumerate(names)])
    return paths.drop(*names).join(back, [*by, "path_seq"], "left"), got.where("conversation_id is null").select(*by, "path_seq", "row_idx")


def rows_of_sides(members: DataFrame) -> DataFrame:
    """row_idx of every member by current user, and its side; one-sided clusters are dropped."""
    w = Window.partitionBy("current_user_id").orderBy("cluster_id", "user_id", "conversation_id")
    m = members.withColumn("row_idx", F.row_number().over(w) - 1).withColumn("mine", F.col("user_id") == F.col("current_user_id"))
    c = Window.partitionBy("current_user_id", "match_group_id", "cluster_id")
    return m.withColumn("_a", F.bool_or("mine").over(c)).withColumn("_b", F.bool_or(~F.col("mine")).over(c)).where("_a and _b").drop("_a", "_b")


def discover_paths(rows: DataFrame, scorer: Callable[[DataFrame], DataFrame], save: saver, ratios: dict[str, float] | None = None, total: int = MAX_PATHS, budget: int = MAX_CALLS, retries: int = 2, with_errors: bool = False):
    """Greedy path discovery for all users and match groups, round by round.

    ``rows`` (current_user_id, match_group_id, cluster_id, category, row_idx, user_id,
    conversation_id, mine, title, summary, date_text, and v, the vectors).  Each round chooses, for
    every match group, the cluster with the lowest score, asks ``scorer`` (adds ``answer`` to rows
    with ``prompt``), parses, takes every named id out of the group's pool, also those of rejected
    answers, and goes on until quotas, the budget of calls per user, or clusters end.  A
    cluster is asked again at most ``retries`` times without gain.

    The score is the sum of the scaled imbalance and, where there are vectors, the scaled distance
    of the optimal matching of both sides.  Scaling is fitted once for each category, on what
    earlier categories left; both metrics are made anew only where the pool changed.  A round writes
    two tables, the answers and the clusters' state, so a lost executor repeats one round.

    A match group whose call fails does not stop the others: it is tried again like a rejected
    answer.  With ``with_errors`` returns (paths, errors): current_user_id, match_group_id,
    cluster_id, category, round and reason of every call that failed (the scorer's ``error``
    column, if it adds one) or whose answer was rejected.
    """
    spark = rows.sparkSession
    group = ["current_user_id", "match_group_id"]
    one = [*group, "cluster_id"]
    rows = save(rows)
    metrics = ["imbalance", "dist"] if "v" in rows.columns else ["imbalance"]

    def measured(pool: DataFrame, with_distance: DataFrame | None = None) -> DataFrame:
        """Sizes of the clusters in ``pool`` and the distance of those in ``with_distance``, or of all."""
        sizes = pool.groupBy(*one).agg(F.count_if("mine").alias("n1"), F.count_if(~F.col("mine")).alias("n2"))
        if "dist" not in metrics:
            return sizes
        near = pool if with_distance is None else pool.join(with_distance, one, "left_semi")
        return sizes.join(matched_distance(near.select(*one, "mine", "v"), one, "mine"), one, "left")

    start = rows.groupBy(*one).agg(F.min("category").alias("category"), F.min(F.when(~F.col("mine"), F.col("user_id"))).alias("other_user_id"))
    zero = {c: F.lit(0).cast("long") for c in ("tries", "total", "n", "calls")}
    state = save(start.join(measured(rows), one).withColumns(zero).withColumn("imbalance", imbalance(F.nullif("n1", F.lit(0)), F.nullif("n2", F.lit(0)))))
    told: list[DataFrame] = []

    def answers() -> DataFrame:
        return spark.read.schema(told[0].schema).parquet(*[x._folder for x in told])

    def following(new: DataFrame, old: DataFrame) -> DataFrame:
        out = save(new)
        save.drop(old)
        return out

    for category, ratio in sorted((ratios or CATEGORY_RATIOS).items(), key=lambda x: (-x[1], x[0])):
        if ratio <= 0:
            continue
        want = -(-round(ratio * total * 1e9) // 10**9)
        own = (F.col("category") == category) & (F.col("n1") > 0) & (F.col("n2") > 0)
        scaler = fit_scaler(state.where(own), group, metrics)
        names = [c for c in scaler.columns if c not in group]
        state = following(state.drop(*names).join(scaler, group, "left").withColumn("n", zero["n"]), state)
        for turn in range(total * (retries + 1)):
            live = state.where(own & (F.col("tries") <= retries) & (F.col("total") < total) & (F.col("n") < want))
            best = Window.partitionBy(*group).orderBy(F.round(scaled_sum(metrics), 9), "cluster_id")
            left = Window.partitionBy("current_user_id").orderBy("match_group_id")
            chosen = live.withColumn("_n", F.row_number().over(best)).where("_n = 1")
            chosen = chosen.withColumn("_n", F.row_number().over(left)).where(F.col("_n") + F.col("calls") <= budget)
            used = answers().select(*group, F.explode(F.concat("common", "user1", "user2")).alias("row_idx")).distinct() if told else None
            pool = rows.join(used, [*group, "row_idx"], "left_anti") if told else rows
            sides = side_text(pool.join(chosen.select(*one), one, "left_semi"), [*one, "mine"], ["row_idx"])
            both = sides.groupBy(*one).agg(F.max(F.when(F.col("mine"), F.col("block"))).alias("b1"), F.max(F.when(~F.col("mine"), F.col("block"))).alias("b2"))
            asked = scorer(both.select(*one, path_prompt(F.col("b1"), F.col("b2")).alias("prompt")))
            why = F.col("error") if "error" in asked.columns else F.lit(None).cast("string")
            whole = F.coalesce(repair_json("answer")["json"], "answer")  # a cut-off answer tells what it can
            got = asked.withColumn("a", parse_answer(whole)).select(*one, why.alias("reason"), "a.*")
            got = save(got.join(chosen.select(*one, "other_user_id", "category", F.col("total").alias("path_seq")), one).withColumn("round", F.lit(turn)))
            if got.isEmpty():
                save.drop(got)
                break
            told.append(got)
            named = got.select(*group, F.explode(F.concat("common", "user1", "user2")).alias("row_idx")).distinct()
            changed = rows.join(named, [*group, "row_idx"], "left_semi").select(*one).distinct()
            rest = rows.join(changed, one, "left_semi").join(answers().select(*group, F.explode(F.concat("common", "user1", "user2")).alias("row_idx")).distinct(), [*group, "row_idx"], "left_anti")
            fresh = changed.join(measured(rest), one, "left").select(*one, *[F.col(c).alias(f"_{c}") for c in ("n1", "n2", *metrics[1:])], F.lit(True).alias("_changed"))
            gain = got.groupBy(*group).agg(F.count_if("ok").alias("_gain"))
            tried = got.select(*one, F.when(F.col("ok"), 0).otherwise(1).alias("_tried"))
            called = got.groupBy("current_user_id").agg(F.count(F.lit(1)).alias("_called"))
            nxt = state.join(fresh, one, "left").join(tried, one, "left").join(gain, group, "left").join(called, "current_user_id", "left")
            plus = {c: F.col(c) + F.coalesce(d, F.lit(0)) for c, d in (("tries", "_tried"), ("total", "_gain"), ("n", "_gain"), ("calls", "_called"))}
            size = {c: F.when(F.col("_changed"), F.coalesce(f"_{c}", F.lit(0))).otherwise(F.col(c)) for c in ("n1", "n2")}
            apart = {c: F.when(F.col("_changed"), F.col(f"_{c}")).otherwise(F.col(c)) for c in metrics[1:]}
            nxt = nxt.withColumns(plus | size | apart).select(*state.columns).withColumn("imbalance", imbalance(F.nullif("n1", F.lit(0)), F.nullif("n2", F.lit(0))))
            state = following(nxt, state)
    if not told:
        paths, errors = spark.createDataFrame([], PATH_SCHEMA), spark.createDataFrame([], ERROR_SCHEMA)
        return (paths, errors) if with_errors else paths
    every = answers()
    seq = F.col("path_seq")
    key = F.sha2(F.concat_ws("|", *one, seq), 256)
    paths = every.where("ok").select(
        key.alias("path_id"), "current_user_id", "other_user_id", "match_group_id", F.col("cluster_id").cast("long"), "category", "path_seq", "title",
        "common", "user1", "user2", (F.size("user1") + F.size("common")).alias("len_user1"), (F.size("user2") + F.size("common")).alias("len_user2"), "background", "is_sensitive",
    )
    errors = every.where("not ok").select(*one, "category", "round", F.coalesce("reason", F.lit("rejected answer")).alias("reason"))
    return (paths, errors) if with_errors else paths
