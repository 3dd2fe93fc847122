"""Queries on exports written from the test tables, on scoring, and on whole records of paths."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assemble, balance, cluster, graph, match_run, paths, scoring, series, serving, versions
from ..sources import archives, exports
from ..streaming import live
from . import queries_match as M
from . import views
from .queries_match import GROUP, IDS, ROWS, _ids, _members
from .queries_text import CONVS
from .queries_text import QUERIES as QUERY_TEXT
from .views import EXCHANGES, MEMBERS, PATHS, t

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def folder(spark) -> str:
    return f"{views.shared_root(spark)}/convmatch-{uuid.uuid4().hex}"


def archive(spark, sf: str) -> str:
    """Exports written from ``conversations``, one conversation a line: even ids as message
    trees, odd ids as message lists, ids divisible by 7 in an unknown shape."""
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    name = lambda n: F.concat(F.lit("t"), n.cast("string"))
    at = lambda x: F.lit(1704067200) + F.col("conv_id") * 3600 + x["turn"] * 60
    none = F.lit(None).cast("string")

    def node(x):
        author = F.struct(x["role"].alias("role"), none.alias("name"))
        content = F.struct(F.lit("text").alias("content_type"), F.array(F.substring(x["text"], 1, 5), x["text"].substr(F.lit(6), F.length(x["text"]))).alias("parts"))
        message = F.struct(name(x["turn"]).alias("id"), author.alias("author"), at(x).cast("double").alias("create_time"), content.alias("content"))
        kids = F.when(x["role"] == "user", F.array(name(x["turn"] + 1), name(x["turn"] + 2))).otherwise(F.array().cast("array<string>"))
        return F.struct(name(x["turn"]), F.struct(name(x["turn"]).alias("id"), none.alias("parent"), kids.alias("children"), message.alias("message")))

    def item(x):
        sender = F.when(x["role"] == "user", "human").otherwise(x["role"])
        return F.struct(x["text"].alias("text"), sender.alias("sender"), F.date_format(F.timestamp_seconds(at(x)), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))

    i, known, tree = F.col("conv_id").cast("string"), F.col("conv_id") % 7 != 0, F.col("conv_id") % 2 == 0
    rows = c.select(
        (F.col("conv_id") % 20).alias("user"), F.when(tree, "openai").otherwise("anthropic").alias("provider"),
        F.when(known & tree, i).alias("conversation_id"), F.when(tree, "tree").otherwise("list").alias("title"),
        F.when(known & tree, F.map_from_entries(F.transform("m", node))).alias("mapping"),
        F.when(known & ~tree, i).alias("uuid"), F.lit("list").alias("name"), F.when(known & ~tree, F.transform("m", item)).alias("chat_messages"),
    )
    path = folder(spark)
    rows.write.partitionBy("user", "provider").json(path)
    return path


def _archive(spark, sf):
    return exports.read_exports(spark, archive(spark, sf), lines=True)


SHAPE = "CASE WHEN conv_id % 7 = 0 THEN 'unknown' WHEN conv_id % 2 = 0 THEN 'tree' ELSE 'list' END"
OWNED = f"""owned AS (SELECT DISTINCT conv_id, (conv_id % 20)::VARCHAR AS user_id, CASE WHEN conv_id % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider, {SHAPE} AS shape FROM conversations)"""
CLOCK = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(a.conv_id * 3600 + a.turn * 60)"
PARTS = "substr({0}.text, 1, 5) || chr(10) || substr({0}.text, 6)"
TREE = f"""tree AS (SELECT a.conv_id, a.turn, strftime({CLOCK}, '%Y-%m-%d') AS date, strftime({CLOCK}, '%H:%M:%S') AS time, {PARTS.format('a')} AS question,
    CASE WHEN c.role = 'assistant' THEN {PARTS.format('c')} WHEN b.role = 'assistant' THEN {PARTS.format('b')} ELSE '' END AS answer
  FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn + 2
  WHERE a.role = 'user' AND a.conv_id % 2 = 0 AND a.conv_id % 7 <> 0)"""
LIST = f"""list AS (SELECT a.conv_id, a.turn, strftime({CLOCK}, '%Y-%m-%d') AS date, strftime({CLOCK}, '%H:%M:%S') AS time, a.text AS question, b.text AS answer
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant' AND a.conv_id % 2 = 1 AND a.conv_id % 7 <> 0)"""


def _dated(df):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("s1_s3_scan_exports", f"WITH {OWNED} SELECT user_id, provider, shape, count(*) AS n FROM owned GROUP BY ALL")
def s1(spark, sf):
    return _archive(spark, sf).groupBy("user_id", "provider", "shape").agg(F.count(F.lit(1)).alias("n"))


@query("x1_x3_tree_exchanges", f"WITH {TREE} SELECT (conv_id % 20)::VARCHAR AS user_id, conv_id::VARCHAR AS conversation_id, date, time, question, answer FROM tree")
def x1(spark, sf):
    return _dated(exports.tree_exchanges(_archive(spark, sf))).drop("title")


@query("x4_list_exchanges", f"WITH {LIST} SELECT (conv_id % 20)::VARCHAR AS user_id, conv_id::VARCHAR AS conversation_id, date, time, question, answer FROM list")
def x4(spark, sf):
    return _dated(exports.list_exchanges(_archive(spark, sf))).drop("title")


@query("x6_ordered_exchanges", f"""WITH {TREE}, {LIST}, e AS (SELECT conv_id, turn, question FROM tree UNION ALL SELECT conv_id, turn, question FROM list)
  SELECT conv_id::VARCHAR AS conversation_id, question, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM e""")
def x6(spark, sf):
    return exports.ordered(exports.exchanges(_archive(spark, sf))[0]).select("conversation_id", "question", F.col("position").cast("long").alias("position"))


@query("x8_rejects", f"""WITH {OWNED}, {TREE}, {LIST}, good AS (SELECT conv_id % 20 AS u FROM tree UNION SELECT conv_id % 20 FROM list)
  SELECT user_id, 'unknown shape' AS reason FROM owned WHERE shape = 'unknown' UNION ALL SELECT DISTINCT user_id, 'no exchange' FROM owned WHERE user_id::BIGINT NOT IN (SELECT u FROM good)""")
def x8(spark, sf):
    return exports.exchanges(_archive(spark, sf))[1]


@query("r6_r7_redacted_exports", f"""WITH {LIST}, {TREE}, e AS (SELECT * FROM list UNION ALL SELECT * FROM tree)
  SELECT conv_id::VARCHAR AS conversation_id, time, regexp_replace(regexp_replace(question, '\\b{X.EMAIL}\\b', '[redacted email]', 'g'), '\\b{X.PHONE}\\b', '[redacted phone]', 'g') AS question FROM e""")
def r6(spark, sf):
    return exports.exchanges(exports.redact_exports(_archive(spark, sf)))[0].select("conversation_id", "time", "question")


@query("r7_bulk_archives", f"""WITH {LIST}, {TREE}, e AS (SELECT * FROM list UNION ALL SELECT * FROM tree)
  SELECT (conv_id % 20)::VARCHAR AS user_id, conv_id::VARCHAR AS conversation_id, date, time, nullif(question, '') AS question, nullif(answer, '') AS answer FROM e""")
def r7(spark, sf):
    lines = spark.read.text(archive(spark, sf)).select("*", F.expr("from_json(value, 'conversation_id string, uuid string')").alias("c"))
    rows = lines.select("user", "provider", F.col("value").alias("item"), F.coalesce("c.conversation_id", "c.uuid", F.lit("")).alias("key"))
    path = folder(spark)
    archives.write_archives(rows, path, ["key"])
    return _dated(exports.exchanges(archives.read_archives(spark, path)[0])[0]).drop("title")


@query("s4_user_tables", f"WITH {EXCHANGES} SELECT user_id, conversation_id, turn, CASE WHEN user_id % 2 = 0 THEN 'new' ELSE answer END AS answer FROM exchanges")
def s4(spark, sf):
    e, path = views.exchanges(spark, sf).select("user_id", "conversation_id", "turn", "answer"), folder(spark)
    exports.write_by_user(e, path)
    exports.write_by_user(e.where("user_id % 2 = 0").withColumn("answer", F.lit("new")), path)
    return spark.read.schema(e.schema).parquet(path)


@query("s10_polled_uploads", f"WITH {OWNED} SELECT user_id, provider, shape FROM owned")
def s10(spark, sf):
    path, out = archive(spark, sf), folder(spark)
    new = exports.with_owner(exports.poll_uploads(spark, f"{path}/*/*", lines=True)).select("user_id", "provider", "shape")
    new.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(new.schema).parquet(out)


@query("c6_row_limit", f"WITH {CONVS} SELECT user_id, conversation_id FROM convs ORDER BY user_id, conversation_id LIMIT 50")
def c6(spark, sf):
    return assemble.row_limit(assemble.conversations(views.exchanges(spark, sf), None), ["user_id", "conversation_id"]).select("user_id", "conversation_id")


def _head(prompts: list[str]) -> list[str]:
    """A scorer whose answers SQL can give too."""
    return [f"{len(p)}:{p[:30]}" for p in prompts]


@query("c9_f7_results_by_key", f"WITH {CONVS} SELECT conversation_id, length(text) || ':' || substr(text, 1, 30) AS answer FROM convs")
def c9(spark, sf):
    return scoring.complete(assemble.conversations(views.exchanges(spark, sf), None), "text", _head).select("conversation_id", "answer")


@query("f1_embed_batches", "SELECT doc_id, length(text)::DOUBLE AS e0, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS e1 FROM documents")
def f1(spark, sf):
    embedder = lambda texts: [[float(len(x)), float(x.count("e"))] for x in texts]
    d = scoring.embed(t(spark, sf, "documents").select("doc_id", "text"), "text", embedder)
    return d.select("doc_id", F.col("embedding")[0].alias("e0"), F.col("embedding")[1].alias("e1"))


@query("f2_prompt_sequence", f"""WITH {CONVS}, a AS (SELECT conversation_id, length(text) || ':' || substr(text, 1, 30) AS a FROM convs)
  SELECT conversation_id, a || '|' || (length(a) + 7) || ':' || substr('Again: ' || a, 1, 30) AS completions FROM a""")
def f2(spark, sf):
    c = scoring.complete_sequence(assemble.conversations(views.exchanges(spark, sf), None), [F.col("text"), lambda a: F.concat(F.lit("Again: "), a)], _head)
    return c.select("conversation_id", F.array_join("completions", "|").alias("completions"))


@query("r5_redactions_by_document", f"""WITH d AS (SELECT doc_id, text, regexp_replace(text, '\\b{X.EMAIL}\\b', '[redacted email]', 'g') AS m FROM documents)
  SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '\\b{X.EMAIL}\\b'), lambda x: 'email ' || x), '|') AS mails,
    array_to_string(list_transform(regexp_extract_all(m, '\\b{X.PHONE}\\b'), lambda x: 'phone ' || x), '|') AS phones FROM d""")
def r5(spark, sf):
    found = lambda kind: F.array_join(F.transform(F.filter("r", lambda x: x["kind"] == kind), lambda x: F.concat(x["kind"], F.lit(" "), x["content"])), "|")
    d = t(spark, sf, "documents").select("doc_id", X.redactions(F.col("text")).alias("r"))
    return d.select("doc_id", found("email").alias("mails"), found("phone").alias("phones"))


@query("k8_membership", f"WITH {MEMBERS} SELECT {IDS}, user_id, conversation_id, round(v[1], 6) AS e0, round(v[64], 6) AS e63 FROM numbered")
def k8(spark, sf):
    m = cluster.membership(_members(spark, sf), views.user_vec(spark, sf))
    return _ids(m, "user_id", "conversation_id", F.round(F.col("embedding")[0], 6).alias("e0"), F.round(F.col("embedding")[63], 6).alias("e63"))


@query("g5_cluster_heads", f"""WITH {MEMBERS} SELECT {IDS}, arg_min({views.CATEGORY}, (user_id, conversation_id)) AS category, arg_min(conversation_id, (user_id, conversation_id)) AS conversation_id FROM numbered GROUP BY ALL""")
def g5(spark, sf):
    m = _members(spark, sf).withColumn("category", M.category())
    return _ids(cluster.cluster_heads(m, [*GROUP, "cluster_id"], ["user_id", "conversation_id"], ["category", "conversation_id"]), "category", "conversation_id")


QUESTIONS = f"""{ROWS}, {EXCHANGES}, asked AS (SELECT user_id, conversation_id, string_agg(question, '\n  - ' ORDER BY date, time, turn) AS questions FROM exchanges WHERE length(question) > 0 GROUP BY ALL),
  two AS (SELECT *, user_id = current_user_id AS mine FROM (SELECT *, bool_or(user_id = current_user_id) OVER c AS a, bool_or(user_id <> current_user_id) OVER c AS b FROM idx WINDOW c AS (PARTITION BY {IDS})) WHERE a AND b),
  lines AS (SELECT two.*, {M.BLOCK} || coalesce('\nQuestions Asked:\n  - ' || questions, '') AS line FROM two LEFT JOIN asked USING (user_id, conversation_id)),
  blocks AS (SELECT {IDS}, mine, string_agg(line, chr(10) || chr(10) ORDER BY row_idx) AS block FROM lines GROUP BY ALL)"""


def _rows(spark, sf):
    rows = paths.rows_of_sides(_members(spark, sf))
    return paths.with_questions(rows, assemble.questions(views.exchanges(spark, sf)))


@query("p2_sides_with_questions", f"WITH {QUESTIONS} SELECT {IDS}, row_idx, mine, coalesce(questions, '') AS questions FROM two LEFT JOIN asked USING (user_id, conversation_id)")
def p2(spark, sf):
    return _ids(_rows(spark, sf), F.col("row_idx").cast("long").alias("row_idx"), "mine", F.array_join("questions", "\n  - ").alias("questions"))


@query("p3_side_text_with_questions", f"WITH {QUESTIONS} SELECT {IDS}, mine, block FROM blocks")
def p3(spark, sf):
    return M._side_text(_rows(spark, sf))


@query("p4_path_prompt", f"""WITH {QUESTIONS} SELECT {IDS}, '{paths.PATH_ASK}' || max(block) FILTER (WHERE mine) || '\n\nUSER 2\n' || max(block) FILTER (WHERE NOT mine) AS prompt FROM blocks GROUP BY ALL""")
def p4(spark, sf):
    by = [*GROUP, "cluster_id"]
    both = M._side_text(_rows(spark, sf)).groupBy(*by).agg(F.max(F.when(F.col("mine"), F.col("block"))).alias("a"), F.max(F.when(~F.col("mine"), F.col("block"))).alias("b"))
    return _ids(both, paths.path_prompt(F.col("a"), F.col("b")).alias("prompt"))


@query("p5_production_quota", f"""WITH {views.SIDES}, ratios(category, ratio) AS (VALUES ('research', 0.4), ('humanistic', 0.4), ('practical', 0.2), ('coding', 0.0)),
  a AS (SELECT *, row_number() OVER (PARTITION BY current_user_id, match_group_id, category ORDER BY imbalance, cluster_id) AS n FROM balanced JOIN ratios USING (category) WHERE ratio > 0),
  b AS (SELECT *, row_number() OVER (PARTITION BY current_user_id, match_group_id ORDER BY ratio DESC, category, n) AS path_seq FROM a WHERE n <= ceil(ratio * 10))
  SELECT {IDS}, category, path_seq FROM b WHERE path_seq <= 10""")
def p5(spark, sf):
    ratios = spark.createDataFrame(list(paths.CATEGORY_RATIOS.items()), "category string, ratio double")
    return _ids(paths.one_shot_quota(M._balanced(spark, sf), ratios, GROUP, "imbalance"), "category", F.col("path_seq").cast("long").alias("path_seq"))


@query("p7_production_budget", f"WITH {views.SIDES} SELECT {IDS} FROM (SELECT *, row_number() OVER (PARTITION BY current_user_id ORDER BY match_group_id, cluster_id) AS n FROM balanced) WHERE n <= 200")
def p7(spark, sf):
    w = Window.partitionBy("current_user_id").orderBy("match_group_id", "cluster_id")
    return _ids(M._balanced(spark, sf).withColumn("n", F.row_number().over(w)).where(F.col("n") <= paths.MAX_CALLS))


@query("g1_production_sample", f"WITH {MEMBERS} SELECT {IDS}, conversation_id FROM (SELECT *, row_number() OVER (PARTITION BY {IDS} ORDER BY (conversation_id * 7919) % 1000003, conversation_id) AS n FROM numbered) WHERE n <= 10")
def g1(spark, sf):
    w = Window.partitionBy(*GROUP, "cluster_id").orderBy(M.similarity.sample_order(F.col("conversation_id")), "conversation_id")
    return _ids(_members(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 10"), "conversation_id")


@query("b6_weighted_sum", f"WITH {views.SIDES} SELECT {IDS}, round(2 * imbalance + 0.5 * magnitude, 6) AS score FROM balanced")
def b6(spark, sf):
    return _ids(M._balanced(spark, sf), F.round(balance.weighted_sum({"imbalance": 2.0, "magnitude": 0.5}), 6).alias("score"))


@query("b4_matched_distance")
def b4(spark, sf):
    m = _members(spark, sf).withColumn("side", F.col("user_id") == F.col("current_user_id")).withColumn("cluster_id", F.col("cluster_id").cast("long"))
    return balance.matched_distance(m.select(*GROUP, "cluster_id", "side", "v"), [*GROUP, "cluster_id"], "side")


@query("h1_relationships", f"WITH {M.GEO} SELECT DISTINCT src, dst FROM edges")
def h1(spark, sf):
    rows = M._geo(spark, sf).groupBy(F.col("src").alias("node")).agg(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"))).alias("rel"))
    return graph.nodes_and_edges(rows, "node", "rel")[1]


@query("k12_message_clusters")
def k12(spark, sf):
    e = t(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return cluster.message_clusters(e, ["user_id", "day"], "event_id", "ts", "props")


@query("m5_sessions_by_gap_and_count")
def m5(spark, sf):
    """Change points of (gap, count), the count of equal messages in a run."""
    runs = series.collapse_runs(t(spark, sf, "events"), ["user_id"], ["event_type"], ["ts", "event_id"], "ts")
    g = series.gaps(runs.withColumn("day", F.to_date("start")), ["user_id", "day"], ["start", "run_id"], "start")
    return series.change_sessions(g, ["user_id", "day"], ["start", "run_id"], ["gap", "n"], "run_id")


@query("z1_distinct_contents", """WITH s AS (SELECT conv_id, turn, string_agg(role || chr(0) || text, chr(1)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS m FROM conversations)
  SELECT conv_id, count(DISTINCT m) AS contents, count(*) AS snapshots FROM s GROUP BY conv_id""")
def z1(spark, sf):
    """Snapshots and different content hashes of each conversation."""
    s = QUERY_TEXT["z1_content_hash"](spark, sf)
    return s.groupBy("conv_id").agg(F.count_distinct("hash").alias("contents"), F.count(F.lit(1)).alias("snapshots"))


def _path_rows(spark, sf):
    return views.paths(spark, sf).select((F.col("match_id") * 10 + F.col("path_no")).alias("path_id"), "match_id", "path_no", "category", "balance", "part", "supp")


@query("d9_upsert_paths", f"""WITH {PATHS} SELECT match_id * 10 + path_no AS path_id, category, CASE WHEN path_no % 2 = 0 THEN balance + 1 ELSE balance END AS balance FROM paths WHERE path_no <> 2 OR match_id % 2 = 0""")
def d9(spark, sf):
    p = _path_rows(spark, sf)
    new = p.where("path_no % 2 = 0 and (path_no <> 2 or match_id % 2 = 0)").withColumn("balance", F.col("balance") + 1)
    return serving.upsert(p.where("path_no <> 2"), new, ["path_id"], keep=("category",)).select("path_id", "category", "balance")


@query("d5_valid_paths_of_both", f"""WITH {PATHS} SELECT match_id * 10 + path_no AS path_id, part % 3 <> 0 AND supp % 5 <> 0 AND supp % 7 <> 0 AND path_no <> 4 AS valid FROM paths""")
def d5(spark, sf):
    none = F.array().cast("array<bigint>")
    p = _path_rows(spark, sf).select(
        "path_id", F.when(F.col("part") % 3 != 0, F.array("part")).otherwise(none).alias("common"), F.when(F.col("supp") % 5 != 0, F.array("supp")).alias("user1"),
        F.when(F.col("supp") % 7 != 0, F.array("supp", "part")).otherwise(none).alias("user2"), F.col("part").alias("user1_id"), F.when(F.col("path_no") != 4, F.col("supp")).alias("user2_id"),
    )
    return serving.valid_paths(p).select("path_id", "valid")


@query("d13_swapped_tables", "SELECT o_orderkey, o_totalprice + 1 AS price FROM orders")
def d13(spark, sf):
    root, o = folder(spark), t(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    serving.swap_tables({"orders": o, "prices": o.select("price")}, root)
    serving.swap_tables({"orders": o.withColumn("price", F.col("price") + 1), "prices": o.select("price")}, root)
    return serving.current_table(spark, root, "orders")


@query("d20_feedback_upsert", """SELECT o_custkey AS user_id, o_orderkey AS path_id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 - 2 BETWEEN -1 AND 1 THEN o_orderkey % 5 - 2 ELSE 0 END AS score
  FROM orders WHERE o_orderkey % 3 <> 0 OR (o_orderkey % 2 = 0 AND o_orderkey % 5 - 2 BETWEEN -1 AND 1)""")
def d20(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("path_id"))
    zero = F.lit(0).cast("long")
    return serving.upsert_feedback(o.where("path_id % 3 <> 0").withColumn("score", zero), o.where("path_id % 2 = 0").withColumn("score", F.col("path_id") % 5 - 2))



@query("z8_live_hits")
def z8(spark, sf):
    """Conversations with odd ids come as a stream over the even ones: each one's hits among other users'."""
    c = t(spark, sf, "conversations").groupBy(F.col("conv_id").alias("conversation_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    c = c.select(
        (F.col("conversation_id") % 20).alias("user_id"), "conversation_id", F.concat(F.lit("talk "), F.col("conversation_id").cast("string")).alias("title"),
        F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), F.timestamp_seconds("conversation_id").alias("ts"),
    )
    root = folder(spark)
    c.where("conversation_id % 2 = 1").write.parquet(f"{root}/arrivals")
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    served = scoring.embed(c.where("conversation_id % 2 = 0").withColumn("_t", text), "_t", scoring.hashed_words).select(*live.COLUMNS, "embedding")
    states = spark.createDataFrame([], "conversation_id long, status string, content_hash long")
    tables = live.LiveTables(versions.Versions(spark, f"{root}/tables"), scoring.hashed_words)
    tables.start(served, states, dim=64)
    tables.run(spark.readStream.schema(c.schema).parquet(f"{root}/arrivals"), f"{root}/checkpoint").awaitTermination()
    return tables.hits().select("q_id", "rank", "c_id", "c_user", F.round("distance", 6).alias("distance"), "meets")


def _category_of(prompts: list[str]) -> list[str]:
    """A rule in place of a model: the category by the number of summaries that are named."""
    names = ("research", "humanistic", "practical")
    return [f'{{"category": "{names[p.count(chr(10)) % 3]}"}}' for p in prompts]


@query("e2e_match_run")
def e2e(spark, sf):
    """From vectors and exchanges to user_paths rows, with the built-in rules as scorers."""
    v = views.user_vec(spark, sf).select("user_id", "conversation_id", "v")
    talk = v.select("user_id", "conversation_id", F.lit(None).cast("string").alias("title"), F.concat(F.lit("talk "), F.col("conversation_id").cast("string")).alias("summary"), F.lit(None).cast("string").alias("date_text"))
    save = paths.saver(spark, views.shared_root(spark))
    return match_run.match_run(v, talk, assemble.questions(views.exchanges(spark, sf)), _category_of, scoring.first_ids_path, save)["user_paths"]
