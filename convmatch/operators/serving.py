"""Merges and relational queries of the serving tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .versions import Snapshot, Versions


def insert_if_absent(target: DataFrame, source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``target`` and the first source row (by ``order``) of every key that it lacks."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = source.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], keep: tuple[str, ...] = (), null_safe: bool = False) -> DataFrame:
    """Source values win, but for columns in ``keep``; with ``null_safe`` nulls do not win.

    One full outer join on the keys; source keys must be unique.
    """
    t, s = target.alias("t"), source.alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    hit = F.col(f"s.{keys[0]}").isNotNull()

    def pick(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"t.{c}", f"s.{c}").alias(c)
        if c in keep:
            return F.when(F.col(f"t.{keys[0]}").isNotNull(), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
        new = F.coalesce(f"s.{c}", f"t.{c}") if null_safe else F.col(f"s.{c}")
        return F.when(hit, new).otherwise(F.col(f"t.{c}")).alias(c)

    return t.join(s, on, "full_outer").select(*[pick(c) for c in target.columns])


def replace_links(links: DataFrame, touched: DataFrame, parent: str, child: str, children: str) -> DataFrame:
    """Links of untouched parents, and the exploded lists of the touched ones."""
    new = touched.select(parent, F.explode(children).alias(child)).distinct()
    return links.join(touched.select(parent).distinct(), parent, "left_anti").unionByName(new.select(*links.columns))


def pair_key(a: str, b: str) -> Column:
    return F.array_sort(F.array(a, b))


def queue_finish(users: DataFrame, now: Column, parallel: int = 8, serial: int = 2, order: tuple[str, ...] = ("created_at", "user_id"), blocks: int = 64) -> DataFrame:
    """Position and expected minutes of users in line.

    end_i = max(end_{i-1}, remaining_i) + serial, in closed form a running maximum.  The line
    is cut into ranges; each range is numbered and scanned for itself, and only its count and
    its maximum meet those of the ranges before, so no task holds the whole line.
    """
    first = F.col(order[0]).cast("timestamp")
    bounds = users.agg(F.percentile_approx(F.unix_micros(first), [i / blocks for i in range(1, blocks)], 10_000).alias("_b"))
    # one row; equal times fall into one range
    q = users.join(F.broadcast(bounds)).withColumn("_block", F.size(F.filter("_b", lambda x: x < F.unix_micros(first)))).drop("_b")
    w = Window.partitionBy("_block").orderBy(*order)
    waited = (F.unix_timestamp(now) - F.unix_timestamp("created_at")) / 60
    q = q.withColumn("_n", F.row_number().over(w)).withColumn("_r", F.greatest(F.lit(0.0), parallel - waited) - serial * (F.col("_n") - 1))
    q = q.withColumn("_r", F.max("_r").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ends = q.groupBy("_block").agg(F.count(F.lit(1)).alias("_c"), F.max("_r").alias("_m")).withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    ends = ends.withColumn("_p", F.max(F.col("_m") - serial * F.col("_o")).over(before)).select("_block", "_o", "_p")
    q = q.join(F.broadcast(ends), "_block").withColumn("position", F.col("_n") + F.col("_o"))
    top = F.greatest(F.col("_r") - serial * F.col("_o"), F.col("_p"))
    return q.withColumn("finish", serial * F.col("position") + top).drop("_block", "_n", "_r", "_o", "_p")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def swap_tables(staged: dict[str, DataFrame], root: str) -> Snapshot:
    """Write every table and publish all in one version, from any number of writers: readers of
    :func:`current_table`, or of the snapshot they took, see all new tables or none."""
    versions = Versions(next(iter(staged.values())).sparkSession, root)
    paths = {name: [versions.stage(name, df)] for name, df in staged.items()}
    return versions.update(lambda base: {"tables": paths})


def current_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version that was published last."""
    return Versions(spark, root).current().table(name)


def valid_paths(paths: DataFrame, lists: tuple[str, ...] = ("common", "user1", "user2"), users: tuple[str, ...] = ("user1_id", "user2_id")) -> DataFrame:
    """Add ``valid``: no id list is null or empty and both users are there."""
    ok = F.lit(True)
    for c in lists:
        ok = ok & F.coalesce(F.size(c) > 0, F.lit(False))
    for c in users:
        ok = ok & F.col(c).isNotNull()
    return paths.withColumn("valid", ok)


def upsert_feedback(target: DataFrame, source: DataFrame) -> DataFrame:
    """Feedback (user_id, path_id, score) merged by user and path; scores other than -1, 0 and
    1 are left out."""
    return upsert(target, source.where(F.col("score").isin(-1, 0, 1)), ["user_id", "path_id"])


def unviewed_matches(pivot: DataFrame, matches: DataFrame) -> DataFrame:
    """user_id and the number of matches that were not viewed; ``pivot``: user_id, match_id."""
    new = matches.where("not viewed").select("match_id")
    return pivot.distinct().join(new, "match_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def matches_of_users(pivot: DataFrame, matches: DataFrame) -> DataFrame:
    """Each user's matches with their place by score."""
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "match_id")
    d = pivot.distinct().join(matches.select("match_id", "score"), "match_id")
    return d.withColumn("place", F.row_number().over(w).cast("long")).select("user_id", "match_id", "score", "place")


def nested_matches(matches: DataFrame, pivot: DataFrame, paths: DataFrame) -> DataFrame:
    """match_id, its users in order, and its paths by balance as structs (balance, path_no)."""
    p = paths.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("balance", "path_no"))).alias("paths"))
    u = pivot.distinct().groupBy("match_id").agg(F.sort_array(F.collect_list("user_id")).alias("users"))
    return matches.select("match_id").join(u, "match_id", "left").join(p, "match_id", "left")


def visible_paths(paths: DataFrame, pivot: DataFrame, matches: DataFrame, users: DataFrame) -> DataFrame:
    """Paths that are not sensitive, or whose match's other users all accept sensitive ones."""
    u = users.select(F.col("id").alias("user_id"), "sensitive_matching")
    o = pivot.distinct().join(matches.select("match_id", "owner"), "match_id").where("user_id <> owner").join(u, "user_id", "left")
    o = o.groupBy("match_id").agg(F.bool_and(F.coalesce("sensitive_matching", F.lit(False))).alias("_ok"))
    return paths.join(o, "match_id", "left").where(~F.col("sensitive") | F.coalesce("_ok", F.lit(True))).drop("_ok")


def mark_viewed(matches: DataFrame, seen: DataFrame) -> DataFrame:
    """``viewed`` set for the match_ids in ``seen``."""
    hit = seen.select("match_id").distinct().withColumn("_hit", F.lit(True))
    return matches.join(hit, "match_id", "left").withColumn("viewed", F.coalesce("_hit", "viewed")).drop("_hit")


def sorted_matches(matches: DataFrame) -> DataFrame:
    return matches.orderBy(F.desc("score"), "match_id")


def match_of_pair(pivot: DataFrame) -> DataFrame:
    """The two users of every match, as one aggregate instead of a self-join."""
    return pivot.groupBy("match_id").agg(F.min("user_id").alias("u1"), F.max("user_id").alias("u2")).where("u1 < u2")


def user_paths(paths: DataFrame, user1: str, user2: str) -> DataFrame:
    """Each path as two rows, one for either user: user_id and side (1, 2) added."""
    two = F.array(*[F.struct(F.col(c).alias("user_id"), F.lit(i).cast("long").alias("side")) for i, c in enumerate((user1, user2), 1)])
    return paths.withColumn("_x", F.explode(two)).select(*paths.columns, "_x.*")
