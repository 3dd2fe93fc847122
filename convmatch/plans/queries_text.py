"""Queries on texts, exchanges, exports, series and streams' batch twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import periods
from ..functions import text as X
from ..functions.repair import repair_json
from ..operators import assemble, scoring, series
from ..sources import exports
from ..streaming import snapshots
from .views import EXCHANGES, exchanges, t

QUERIES: dict = {}
ORACLE_SQL: dict = {}
B = r"(^|[^A-Za-z0-9_])"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _sql_entropy(w: str) -> str:
    chars = f"string_split({w}, '')"
    share = f"(len(list_filter({chars}, lambda y: y = x))::DOUBLE / len({chars}))"
    return f"list_sum(list_transform(list_distinct({chars}), lambda x: -{share} * log2({share})))"


def _letters(column: str) -> str:
    return f"regexp_replace({column}, '[0-9]', '', 'g')"


@query("s2_provider_choice", """SELECT user_id, doc_id, provider FROM (SELECT source AS user_id, doc_id, lang AS provider,
  dense_rank() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, lang) AS n FROM documents) WHERE n = 1""")
def s2(spark, sf):
    d = t(spark, sf, "documents").selectExpr("source as user_id", "doc_id", "lang as provider")
    return exports.choose_provider(d, {"fr": 0, "en": 1})


@query("s5_duplicate_uploads", """SELECT source AS user_id, doc_id, md5(text) AS md5 FROM documents
  WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1)""")
def s5(spark, sf):
    d = t(spark, sf, "documents").selectExpr("source as user_id", "doc_id", "text as content")
    return exports.duplicate_uploads(d).select("user_id", "doc_id", "md5")


@query("s6_already_loaded", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def s6(spark, sf):
    return exports.already_loaded(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels"), "doc_id")


@query("s7_partition_diff", """SELECT c_custkey AS user_id, 'add' AS action FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)
  UNION ALL SELECT DISTINCT o_custkey, 'delete' FROM orders WHERE o_orderkey % 9 = 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def s7(spark, sf):
    return exports.partition_diff(t(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), t(spark, sf, "orders").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("user_id")))


@query("s8_drop_removed_users", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')")
def s8(spark, sf):
    gone = t(spark, sf, "customer").where("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("o_custkey"))
    known = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return exports.of_known_users(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), known, gone, "o_custkey")


@query("s9_active_partitions", "SELECT DISTINCT o_custkey AS user_id FROM orders INTERSECT SELECT c_custkey FROM customer")
def s9(spark, sf):
    return exports.active_partitions(t(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")), t(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")))


@query("x4_list_pairing", f"WITH {EXCHANGES} SELECT user_id, conversation_id, turn, question, answer FROM exchanges")
def x4(spark, sf):
    return exchanges(spark, sf).select("user_id", "conversation_id", "turn", "question", "answer")


@query("x5_dates_and_times", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time,
  strftime(make_timestamp(1700000000000000 + event_id * 1000000), '%Y-%m-%d %H:%M:%S') AS of_epoch FROM events""")
def x5(spark, sf):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    ts = F.to_timestamp(iso)
    return t(spark, sf, "events").select(
        "event_id", F.date_format(ts, "yyyy-MM-dd").alias("date"), F.date_format(ts, "HH:mm:ss").alias("time"),
        F.date_format(F.timestamp_seconds(F.col("event_id") + 1700000000), "yyyy-MM-dd HH:mm:ss").alias("of_epoch"),
    )


@query("x7_empty_to_null", "SELECT conv_id, turn, nullif(CASE WHEN role = 'system' THEN '' ELSE text END, '') AS text FROM conversations")
def x7(spark, sf):
    c = t(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.empty_to_null(F.when(F.col("role") == "system", "").otherwise(F.col("text"))).alias("text"))


@query("x8_users_without_exchange", f"""WITH {EXCHANGES} SELECT DISTINCT conv_id AS conversation_id FROM conversations
  WHERE conv_id NOT IN (SELECT conversation_id FROM exchanges)""")
def x8(spark, sf):
    c = t(spark, sf, "conversations").select(F.col("conv_id").alias("conversation_id")).distinct()
    return c.join(exchanges(spark, sf), "conversation_id", "left_anti")


@query("x9_url_ids", "SELECT page_id, nullif(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2), '') AS id FROM pages")
def x9(spark, sf):
    return t(spark, sf, "pages").select("page_id", X.conversation_id(F.col("url"), "/[a-z]{2}/([0-9]+)").alias("id"))


@query("r1_redact_email", rf"SELECT doc_id, regexp_replace(text, '\b{X.EMAIL}\b', '[redacted email]', 'g') AS text FROM documents")
def r1(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.redact_email(F.col("text")).alias("text"))


@query("r2_redact_phone", rf"""SELECT doc_id, regexp_replace(regexp_replace(text, '\b{X.EMAIL}\b', '[redacted email]', 'g'),
  '\b{X.PHONE}\b', '[redacted phone]', 'g') AS text FROM documents""")
def r2(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.redact_phone(X.redact_email(F.col("text"))).alias("text"))


@query("r3_entropy", f"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+')) AS word FROM documents)
  SELECT word, round({_sql_entropy('word')}, 6) AS bits FROM w WHERE length(word) > 0""")
def r3(spark, sf):
    """Every different word of all documents."""
    words = t(spark, sf, "documents").select(F.explode(F.split("text", r"[ \t\n\x0b\f\r]+")).alias("word")).where(F.length("word") > 0).distinct()
    return words.select("word", F.round(X.entropy(F.col("word")), 6).alias("bits"))


@query("r3_word_entropy")
def r3_words(spark, sf):
    """Every word of every document, in its place."""
    return t(spark, sf, "documents").select("doc_id", X.word_entropies("text").alias("bits"))


@query("r4_redact_secrets", f"""WITH w AS (SELECT doc_id, text, regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+') AS ws FROM documents),
  h AS (SELECT *, list_transform(ws, lambda s: length(s) >= 23 AND {_sql_entropy('s')} > 4.5) AS hit FROM w)
  SELECT doc_id, CASE WHEN list_contains(hit, true) THEN array_to_string(list_transform(ws, lambda s, i: CASE WHEN hit[i] THEN '[redacted high entropy]' ELSE s END), ' ')
  ELSE text END AS text FROM h""")
def r4(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.redact_secrets(F.col("text")).alias("text"))


@query("r5_redaction_report", rf"""SELECT source, sum(len(regexp_extract_all(text, '\b{X.EMAIL}\b')))::BIGINT AS n_email,
  sum(len(regexp_extract_all(regexp_replace(text, '\b{X.EMAIL}\b', '[redacted email]', 'g'), '\b{X.PHONE}\b')))::BIGINT AS n_phone FROM documents GROUP BY source""")
def r5(spark, sf):
    d = t(spark, sf, "documents").select("source", *X.redaction_counts(F.col("text")))
    return d.groupBy("source").agg(F.sum("n_email").alias("n_email"), F.sum("n_phone").alias("n_phone"))


@query("r8_compression_ratio")
def r8(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.round(X.compression_ratio("text"), 6).alias("ratio"))


@query("r9_username_rule", """SELECT c_custkey, regexp_full_match(c_name, '[A-Za-z0-9_]{3,20}') AS ok,
  count(*) OVER (PARTITION BY c_name) > 1 AS taken FROM customer""")
def r9(spark, sf):
    c = t(spark, sf, "customer")
    twice = c.groupBy("c_name").agg((F.count(F.lit(1)) > 1).alias("taken"))
    return c.select("c_custkey", "c_name", X.username_ok(F.col("c_name")).alias("ok")).join(twice, "c_name").select("c_custkey", "ok", "taken")


LINE = "date || ' at ' || time || chr(10) || ' QUESTION: ' || question || chr(10) || ' ANSWER: ' || answer"
CONVS = f"""{EXCHANGES}, lines AS (SELECT *, {LINE} AS line FROM exchanges),
convs AS (SELECT * FROM (SELECT user_id, conversation_id, string_agg(line, chr(10) || chr(10) ORDER BY date, time, turn) AS text,
  arg_min(title, (date, time, turn)) AS title, arg_min(date, (date, time, turn)) AS start_date, arg_min(time, (date, time, turn)) AS start_time
  FROM lines GROUP BY ALL) WHERE length(text) > 1)"""


@query("c1_exchange_text", f"WITH {EXCHANGES} SELECT conversation_id, turn, {LINE} AS line FROM exchanges")
def c1(spark, sf):
    return exchanges(spark, sf).select("conversation_id", "turn", X.exchange_text().alias("line"))


@query("c2_c4_conversations", f"WITH {CONVS} SELECT user_id, conversation_id, text, title, start_date, start_time FROM convs")
def c2(spark, sf):
    return assemble.conversations(exchanges(spark, sf), None)


@query("c5_newest_conversations", f"""WITH {CONVS} SELECT user_id, conversation_id, start_date FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY start_date DESC, start_time DESC, conversation_id) AS n FROM convs) WHERE n <= 3""")
def c5(spark, sf):
    return assemble.conversations(exchanges(spark, sf), 3).select("user_id", "conversation_id", "start_date")


@query("c7_summary_prompt", f"""WITH {CONVS} SELECT conversation_id, 'Summarise the conversation below in at most three sentences and say whether it is sensitive.' || chr(10) ||
  'Answer with a JSON object with the keys summary (string) and is_sensitive (boolean).' || chr(10) || chr(10) || 'TITLE: ' || coalesce(title, 'No title') || chr(10) || chr(10) || text AS prompt FROM convs""")
def c7(spark, sf):
    return assemble.conversations(exchanges(spark, sf), None).select("conversation_id", assemble.summary_prompt(F.col("text"), F.col("title")).alias("prompt"))


@query("c8_typed_completion", "SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def c8(spark, sf):
    v = F.try_variant_get(F.try_parse_json(X.json_object(F.col("props"))), "$.k", "variant")
    return t(spark, sf, "events").select("event_id", F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(F.try_parse_json(X.json_object(F.col("props"))), "$.k", "bigint")).alias("k"))


@query("c8_repaired_completion", """SELECT event_id, CASE WHEN event_id % 6 < 5 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 6 < 5 THEN event_type END AS kind, CASE WHEN event_id % 6 = 5 THEN 'no object' END AS reason FROM events""")
def c8_repaired(spark, sf):
    """Completions broken in five ways by their id, and refusals."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    broken = [
        F.concat(F.lit('{"k": '), k, F.lit(', "kind": "'), kind),  # cut off
        F.concat(F.lit("{'k': "), k, F.lit(", 'kind': '"), kind, F.lit("'}")),  # quotes
        F.concat(F.lit("Sure:\n```json\n{k: "), k, F.lit(',\n kind: "'), kind, F.lit('",}\n```')),  # keys and commas
        F.concat(F.lit('{"k": '), k, F.lit(' // a count\n, "kind": '), kind, F.lit("} Done.")),  # comments and bare words
        F.concat(F.lit('{"kind": "'), kind, F.lit('" "ids": [1, 2}, "k": '), k, F.lit("}")),  # no comma, open list
        F.lit("I cannot answer that."),
    ]
    text = F.element_at(F.array(*broken), (F.col("event_id") % 6 + 1).cast("int"))
    r = t(spark, sf, "events").select("event_id", repair_json(text).alias("r"))
    return r.select("event_id", F.get_json_object("r.json", "$.k").cast("long").alias("k"), F.get_json_object("r.json", "$.kind").alias("kind"), "r.reason")


@query("c10_invalid_removed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def c10(spark, sf):
    return t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_anti")


@query("c11_raw_qa_text", f"""WITH {EXCHANGES} SELECT conversation_id, string_agg('Q: ' || question || chr(10) || 'A: ' || answer, chr(10) ORDER BY turn) AS text FROM exchanges GROUP BY 1""")
def c11(spark, sf):
    qa = F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), F.col("answer"))
    return exchanges(spark, sf).groupBy("conversation_id").agg(assemble.ordered_text(["turn"], qa, "\n").alias("text"))


@query("c12_messages_text", """SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Ada' ELSE role END || ' at 2024-01-01 ' || lpad(turn::VARCHAR, 2, '0') || ': ' || text, chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY 1""")
def c12(spark, sf):
    c = t(spark, sf, "conversations")
    m = F.struct("turn", F.when(F.col("role") == "user", "me").otherwise(F.col("role")).alias("from"), F.lit("2024-01-01").alias("date"), F.lpad(F.col("turn").cast("string"), 2, "0").alias("time"), F.col("text").alias("content"))
    return c.groupBy("conv_id").agg(F.sort_array(F.collect_list(m)).alias("m")).select("conv_id", assemble.messages_text("m", "me", "Ada").alias("text"))


@query("c13_daily_transcript", """SELECT user_id, strftime(ts, '%Y-%m-%d') AS date, string_agg(event_type || ': ' || props, chr(10) ORDER BY ts, event_id) AS text
  FROM events GROUP BY 1, 2""")
def c13(spark, sf):
    e = t(spark, sf, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return e.agg(assemble.ordered_text(["ts", "event_id"], F.concat("event_type", F.lit(": "), "props"), "\n").alias("text"))


@query("c14_questions", f"WITH {EXCHANGES} SELECT user_id, conversation_id, string_agg(question, '|' ORDER BY date, time, turn) AS questions FROM exchanges GROUP BY ALL")
def c14(spark, sf):
    return assemble.questions(exchanges(spark, sf)).withColumn("questions", F.array_join("questions", "|"))


@query("c15_summary_records", f"""WITH {CONVS}, q AS (SELECT user_id, conversation_id, count(*) AS n_questions FROM exchanges GROUP BY ALL)
  SELECT conversation_id, substr(text, 1, 20) AS summary, start_date || ' ' || substr(start_time, 1, 5) AS date_text, 'practical' AS category, n_questions
  FROM convs JOIN q USING (user_id, conversation_id) WHERE conversation_id % 3 <> 0""")
def c15(spark, sf):
    e = exchanges(spark, sf)
    c = assemble.conversations(e, None).withColumn("summary", F.when(F.col("conversation_id") % 3 != 0, F.substring("text", 1, 20))).withColumn("category", F.lit(None).cast("string"))
    return assemble.summary_records(c, assemble.questions(e)).select("conversation_id", "summary", "date_text", "category", F.size("questions").cast("long").alias("n_questions"))


@query("t1_relevance_period", """WITH p AS (SELECT o_orderkey, l_linenumber, l_partkey, o_orderdate::DATE AS sd, (CASE WHEN o_orderkey % 2 = 0 THEN l_shipdate ELSE o_orderdate END)::DATE AS ed,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':00:00' END AS st,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE lpad((l_linenumber % 24)::VARCHAR, 2, '0') || ':00:00' END AS et
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
  SELECT o_orderkey, l_linenumber, l_partkey, CASE
    WHEN sd = ed AND st IS NULL AND et IS NULL THEN sd::VARCHAR
    WHEN sd = ed AND st = et THEN sd::VARCHAR || ' at ' || st
    WHEN sd = ed AND st IS NOT NULL AND et IS NOT NULL THEN sd::VARCHAR || ' from ' || st || ' to ' || et
    WHEN sd = ed THEN sd::VARCHAR || ' at ' || coalesce(st, et)
    ELSE sd::VARCHAR || coalesce(' at ' || st, '') || ' to ' || ed::VARCHAR || coalesce(' at ' || et, '') END AS period FROM p""")
def t1(spark, sf):
    o, li = t(spark, sf, "orders"), t(spark, sf, "lineitem")
    p = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    hour = lambda c: F.when(F.col(c) % 3 == 0, None).otherwise(F.concat(F.lpad((F.col(c) % 24).cast("string"), 2, "0"), F.lit(":00:00")))
    end = F.when(F.col("o_orderkey") % 2 == 0, F.col("l_shipdate")).otherwise(F.col("o_orderdate"))
    return p.select("o_orderkey", "l_linenumber", "l_partkey", periods.relevance_period(F.to_date("o_orderdate"), hour("o_orderkey"), F.to_date(end), hour("l_linenumber")).alias("period"))


@query("t2_time_validity", r"""SELECT event_id, regexp_full_match(s, '([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') AS ok FROM
  (SELECT event_id, lpad((event_id % 30)::VARCHAR, 2, '0') || ':' || lpad((event_id % 70)::VARCHAR, 2, '0') || ':00' AS s FROM events)""")
def t2(spark, sf):
    pad = lambda n: F.lpad((F.col("event_id") % n).cast("string"), 2, "0")
    return t(spark, sf, "events").select("event_id", periods.time_ok(F.concat(pad(30), F.lit(":"), pad(70), F.lit(":00"))).alias("ok"))


@query("t3_range_text", """SELECT conv_id, CASE WHEN count(DISTINCT r) = 0 THEN 'Unknown' WHEN count(DISTINCT r) = 1 THEN min(r) ELSE 'from ' || min(r) || ' to ' || max(r) END AS span
  FROM (SELECT conv_id, CASE WHEN turn % 2 = 0 THEN role END AS r FROM conversations) GROUP BY 1""")
def t3(spark, sf):
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_agg(F.when(F.col("turn") % 2 == 0, F.col("role"))).alias("r"))
    return c.select("conv_id", periods.range_text(F.col("r")).alias("span"))


@query("t4_date_time", """SELECT event_id, strftime(coalesce(try_cast('2024-01-' || lpad((event_id % 40)::VARCHAR, 2, '0') || ' 10:00:00' AS TIMESTAMP), ts), '%Y-%m-%d %H:%M:%S') AS at FROM events""")
def t4(spark, sf):
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("event_id") % 40).cast("string"), 2, "0"))
    return t(spark, sf, "events").select("event_id", F.date_format(periods.date_time(day, F.lit("10:00:00"), F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("m1_collapse_runs", """WITH e AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_id FROM e)
  SELECT user_id, run_id::BIGINT AS run_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM r GROUP BY user_id, run_id, event_type""")
def m1(spark, sf):
    return series.collapse_runs(t(spark, sf, "events"), ["user_id"], ["event_type"], ["ts", "event_id"], "ts").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("m2_hourly", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS total FROM events GROUP BY 1")
def m2(spark, sf):
    return series.hourly(t(spark, sf, "events"), "ts").withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query("m3_all_hourly_filled", """WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS total FROM events GROUP BY 1),
  g AS (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour)
  SELECT strftime(g.hour, '%Y-%m-%d %H') AS hour, coalesce(total, 0) AS total FROM g LEFT JOIN h ON g.hour = h.hour""")
def m3_all(spark, sf):
    return series.hourly(t(spark, sf, "events"), "ts", fill=True).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query("m4_gaps", """SELECT event_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS since_start_us,
  coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS gap_us FROM events""")
def m4(spark, sf):
    return series.gaps(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "ts").select("event_id", F.round(F.col("since_start") * 1e6).cast("long").alias("since_start_us"), F.round(F.col("gap") * 1e6).cast("long").alias("gap_us"))


@query("m5_gap_sessions", """WITH g AS (SELECT event_id, user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
  SELECT event_id, (sum(CASE WHEN gap > 3600e6 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session FROM g""")
def m5(spark, sf):
    return series.gap_sessions(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "ts", 3600).select("event_id", "session")


@query("m5_change_sessions")
def m5b(spark, sf):
    g = series.gaps(t(spark, sf, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"], ["ts", "event_id"], "ts")
    return series.change_sessions(g, ["user_id", "day"], ["ts", "event_id"], ["gap"], "event_id")


@query("f3_context", "SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN string_agg(text, '|' ORDER BY turn) ELSE arg_max(text, turn) END AS context FROM conversations GROUP BY conv_id")
def f3(spark, sf):
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("turns"))
    return c.select("conv_id", F.array_join(scoring.context("turns", F.col("conv_id") % 2 == 0), "|").alias("context"))


LOG = "calls AS (SELECT event_type AS model, event_id % 2000 AS input_tokens, CAST(json_extract(props, '$.k') AS BIGINT) AS output_tokens, value FROM events)"


def _log(spark, sf):
    return t(spark, sf, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 2000).alias("input_tokens"), F.get_json_object("props", "$.k").cast("long").alias("output_tokens"), "value")


@query("f4_call_costs", f"WITH {LOG} SELECT model, round(sum(input_tokens * 0.15 / 1e6 + output_tokens * 0.6 / 1e6), 6) AS cost FROM calls GROUP BY model")
def f4(spark, sf):
    log = _log(spark, sf)
    prices = log.select("model").distinct().withColumn("input_cpm", F.lit(0.15)).withColumn("output_cpm", F.lit(0.6))
    return scoring.call_costs(log, prices).withColumn("cost", F.round("cost", 6))


@query("f5_call_metrics", f"WITH {LOG} SELECT model, round(avg(value), 6) AS mean_duration, round(avg(input_tokens), 6) AS mean_in, round(avg(output_tokens), 6) AS mean_out, count(*) FILTER (WHERE value IS NULL) AS remaining FROM calls GROUP BY model")
def f5(spark, sf):
    return _log(spark, sf).groupBy("model").agg(F.round(F.avg("value"), 6).alias("mean_duration"), F.round(F.avg("input_tokens"), 6).alias("mean_in"), F.round(F.avg("output_tokens"), 6).alias("mean_out"), F.count_if(F.col("value").isNull()).alias("remaining"))


@query("f6_embedding_cost", f"WITH {LOG} SELECT model, round(sum(input_tokens) * 0.01 / 1e6, 9) AS cost FROM calls GROUP BY model")
def f6(spark, sf):
    return _log(spark, sf).groupBy("model").agg(F.round(F.sum("input_tokens") * 0.01 / 1e6, 9).alias("cost"))


@query("f1_embeddings")
def f1(spark, sf):
    return scoring.tfidf_embedding(t(spark, sf, "documents").select("doc_id", "text"), "text", 64).select("doc_id", "embedding")


@query("f2_completions")
def f2(spark, sf):
    c = assemble.conversations(exchanges(spark, sf), None).withColumn("prompt", assemble.summary_prompt(F.col("text"), F.col("title")))
    return scoring.complete_sequence(c, [F.col("prompt"), lambda a: F.concat(F.lit("Shorten: "), a)], scoring.lead_sentence).select("conversation_id", "completions")


def _snapshots(spark, sf):
    c = t(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn("messages", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(w)).withColumn("title", F.lit("chat"))


@query("z1_content_hash")
def z1(spark, sf):
    return _snapshots(spark, sf).select("conv_id", "turn", snapshots.content_hash("messages").alias("hash"))


@query("z2_changed", """SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
  WHERE p IS NULL OR p <> event_type""")
def z2(spark, sf):
    return snapshots.changed(t(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id")


Z_GAP = "(SELECT event_id, row_number() OVER w AS n, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query("z3_debounce", f"SELECT event_id FROM {Z_GAP} WHERE gap IS NULL OR gap > 600e6")
def z3(spark, sf):
    return snapshots.settled(t(spark, sf, "events"), "user_id", "ts", ["ts", "event_id"], 600).select("event_id")


@query("z4_initial_snapshot", f"SELECT event_id FROM {Z_GAP} WHERE n = 1 OR gap IS NULL OR gap > 600e6")
def z4(spark, sf):
    return snapshots.settled_or_first(t(spark, sf, "events"), "user_id", "ts", ["ts", "event_id"], 600).select("event_id")


@query("z5_ready", "SELECT conv_id, turn, role = 'assistant' AND length(text) > 1 AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) >= 2 AS ready FROM conversations")
def z5(spark, sf):
    return _snapshots(spark, sf).select("conv_id", "turn", snapshots.ready("messages", "title").alias("ready"))


STATE = """last AS (SELECT conv_id AS conversation_id, max(turn)::VARCHAR AS content_hash FROM conversations GROUP BY 1),
states AS (SELECT conversation_id, CASE conversation_id % 4 WHEN 0 THEN 'processing' WHEN 1 THEN 'error' WHEN 2 THEN 'completed' ELSE 'idle' END AS status,
  CASE WHEN conversation_id % 8 < 4 THEN content_hash ELSE 'old' END AS content_hash FROM last WHERE conversation_id % 5 <> 0)"""


def _states(spark, sf):
    last = t(spark, sf, "conversations").groupBy(F.col("conv_id").alias("conversation_id")).agg(F.max("turn").cast("string").alias("content_hash"))
    status = F.when(F.col("conversation_id") % 4 == 0, "processing").when(F.col("conversation_id") % 4 == 1, "error").when(F.col("conversation_id") % 4 == 2, "completed").otherwise("idle")
    states = last.where(F.col("conversation_id") % 5 != 0).select("conversation_id", status.alias("status"), F.when(F.col("conversation_id") % 8 < 4, F.col("content_hash")).otherwise("old").alias("content_hash"))
    return last, states


@query("z6_process_gate", f"""WITH {STATE} SELECT l.conversation_id, CASE WHEN s.status IS NULL THEN true WHEN s.status = 'processing' THEN false
  WHEN s.status IN ('error', 'completed') AND s.content_hash = l.content_hash THEN false ELSE true END AS go FROM last l LEFT JOIN states s USING (conversation_id)""")
def z6(spark, sf):
    last, states = _states(spark, sf)
    return snapshots.should_process(last, states).select("conversation_id", "go")


@query("z7_state_update", f"""WITH {STATE}, new AS (SELECT conversation_id, 'completed' AS status, CASE WHEN conversation_id % 2 = 0 THEN content_hash END AS content_hash FROM last WHERE conversation_id % 3 = 0)
  SELECT conversation_id, coalesce(n.status, s.status) AS status, coalesce(n.content_hash, s.content_hash) AS content_hash FROM states s FULL JOIN new n USING (conversation_id)""")
def z7(spark, sf):
    from ..operators.serving import upsert

    last, states = _states(spark, sf)
    new = last.where("conversation_id % 3 = 0").select("conversation_id", F.lit("completed").alias("status"), F.when(F.col("conversation_id") % 2 == 0, F.col("content_hash")).alias("content_hash"))
    return upsert(states, new, ["conversation_id"], null_safe=True)
