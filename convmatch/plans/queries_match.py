"""Queries on vectors, clusters, balance, paths, graphs and serving tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import auction, balance, cluster, graph, paths, scoring, serving, similarity, vector_index, versions
from . import views
from .views import MATCHES, MEMBERS, PATHS, SIDES, SIMS, USER_VEC, USERS, t, user_vec

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


def neighbours_by_id(spark, sf):
    """Each vector beside the one with the next id: an equi join."""
    a = user_vec(spark, sf)
    b = a.select((F.col("conversation_id") - 1).alias("conversation_id"), F.col("v").alias("w"))
    return a.join(b, "conversation_id")


NEXT = f"{USER_VEC}, pairs AS (SELECT a.conversation_id, a.v, b.v AS w FROM user_vec a JOIN user_vec b ON b.conversation_id = a.conversation_id + 1)"


@query("v1_inner_cosine", f"WITH {NEXT} SELECT conversation_id, round(list_inner_product(v, w), 6) AS ip, round(list_cosine_similarity(v, w), 6) AS cos FROM pairs")
def v1(spark, sf):
    return neighbours_by_id(spark, sf).select("conversation_id", F.round(V.inner("v", "w"), 6).alias("ip"), F.round(V.cosine("v", "w"), 6).alias("cos"))


@query("v2_euclid", f"WITH {NEXT} SELECT conversation_id, round(list_distance(v, w), 6) AS d FROM pairs")
def v2(spark, sf):
    return neighbours_by_id(spark, sf).select("conversation_id", F.round(V.euclid("v", "w"), 6).alias("d"))


@query("v3_normalise", f"WITH {USER_VEC} SELECT conversation_id, round(v[1] * 3 / sqrt(list_inner_product(v, v) * 9), 6) AS x0, 1.0::DOUBLE AS norm FROM user_vec")
def v3(spark, sf):
    d = user_vec(spark, sf).withColumn("v", F.transform("v", lambda x: x * 3)).withColumn("n", V.normalised("v"))
    return d.select("conversation_id", F.round(F.col("n")[0], 6).alias("x0"), F.round(V.norm("n"), 6).alias("norm"))


@query("v4_centroid", f"""WITH {USER_VEC}, long AS (SELECT user_id, unnest(range(1, len(v) + 1)) AS pos, unnest(v) AS x FROM user_vec)
  SELECT user_id, pos - 1 AS pos, round(avg(x), 6) AS x FROM long GROUP BY ALL""")
def v4(spark, sf):
    c = V.centroid(user_vec(spark, sf), ["user_id"])
    return c.select("user_id", F.posexplode("centroid").alias("p", "x")).select("user_id", F.col("p").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("v5_valid_vectors", f"WITH {USER_VEC} SELECT conversation_id FROM user_vec WHERE len(v) = 64")
def v5(spark, sf):
    return user_vec(spark, sf).where(V.valid("v", 64)).select("conversation_id")


def _knn_inputs(spark, sf, every):
    u = user_vec(spark, sf)
    q = u.where(F.col("conversation_id") % every == 0).select(F.col("conversation_id").alias("q_id"), F.col("user_id").alias("q_user"), "v")
    return q, u.select(F.col("conversation_id").alias("c_id"), F.col("user_id").alias("c_user"), "v")


@query("v6_nearest", f"""WITH {USER_VEC}, s AS (SELECT a.conversation_id AS q_id, b.conversation_id AS c_id, list_inner_product(a.v, b.v) AS score
  FROM user_vec a JOIN user_vec b ON a.conversation_id <> b.conversation_id WHERE a.conversation_id % 50 = 0)
  SELECT q_id, rank, c_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, c_id) AS rank FROM s) WHERE rank <= 30""")
def v6(spark, sf):
    q, c = _knn_inputs(spark, sf, 50)
    return similarity.nearest(q, c, 30).select("q_id", F.col("rank").cast("long").alias("rank"), "c_id", F.round("score", 6).alias("score"))


@query("v7_lsh_nearest")
def v7(spark, sf):
    """Approximate neighbours by random projections: candidates share a bucket, then exact."""
    q, c = _knn_inputs(spark, sf, 50)
    return similarity.bucket_nearest(q, c, 30).withColumn("d", F.round("d", 6))


@query("v7_index_nearest")
def v7_index(spark, sf):
    """Approximate neighbours by cosine through a kept index: half of the vectors built, half inserted."""
    u = user_vec(spark, sf).select(F.col("conversation_id").alias("id"), F.col("user_id").alias("user"), "v")
    home = versions.Versions(spark, f"{views.shared_root(spark)}/index-{uuid.uuid4().hex}")
    vector_index.VectorIndex.build(home, u.where("id % 2 = 0"))
    index = vector_index.VectorIndex.insert(home, u.where("id % 2 = 1"))
    q, _ = _knn_inputs(spark, sf, 50)
    return index.search(q, 30).select("q_id", "rank", "c_id", F.round("score", 6).alias("score"))


@query("v8_user_similarity", f"WITH {SIMS} SELECT user_id, other_id, round(similarity, 6) AS similarity FROM sims")
def v8(spark, sf):
    return similarity.user_similarity(user_vec(spark, sf)).withColumn("similarity", F.round("similarity", 6))


def _top(spark, sf):
    return similarity.top_users(similarity.user_similarity(user_vec(spark, sf)))


@query("v10_top_users", f"WITH {SIMS} SELECT user_id, other_id, rank, rank - 1 AS match_group_id, round(similarity, 6) AS similarity FROM top")
def v10(spark, sf):
    return _top(spark, sf).select("user_id", "other_id", F.col("rank").cast("long").alias("rank"), F.col("match_group_id").cast("long").alias("match_group_id"), F.round("similarity", 6).alias("similarity"))


@query("v10_candidate_users")
def v10_candidates(spark, sf):
    """v10_top_users through inverted lists: only candidate pairs of users are compared."""
    return similarity.candidate_top_users(user_vec(spark, sf)).select("user_id", "other_id", "rank", "match_group_id", F.round("similarity", 6).alias("similarity"))


KNN_OTHER = f"""{USER_VEC}, s AS (SELECT a.conversation_id AS q_id, b.conversation_id AS c_id, b.user_id AS c_user, 1 - list_inner_product(a.v, b.v) AS distance
  FROM user_vec a JOIN user_vec b ON a.user_id <> b.user_id WHERE a.conversation_id % 10 = 0),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, c_id) AS rank FROM s) WHERE rank <= 5)"""


def _knn(spark, sf):
    q, c = _knn_inputs(spark, sf, 10)
    return similarity.nearest(q, c, 5, other_users=True).withColumn("distance", 1 - F.col("score"))


@query("v13_serving_knn", f"WITH {KNN_OTHER} SELECT q_id, rank, c_id, c_user, round(distance, 6) AS distance FROM knn")
def v13(spark, sf):
    return _knn(spark, sf).select("q_id", F.col("rank").cast("long").alias("rank"), "c_id", "c_user", F.round("distance", 6).alias("distance"))


@query("v14_rescaled", f"WITH {KNN_OTHER} SELECT q_id, c_id, round(CASE WHEN 1 - (distance - 0.2) >= 0.5 THEN (1 - (distance - 0.2) - 0.5) * 2 ELSE 0 END, 6) AS scaled FROM knn")
def v14(spark, sf):
    return _knn(spark, sf).select("q_id", "c_id", F.round(V.scaled(F.col("distance") - 0.2), 6).alias("scaled"))


@query("v15_mixed_threshold", f"""WITH {KNN_OTHER}, m AS (SELECT *, bool_or(distance <= 0.6) OVER (PARTITION BY q_id) AS any_within FROM knn)
  SELECT q_id, c_id, distance <= 0.6 AS meets FROM m WHERE NOT any_within OR distance <= 0.6""")
def v15(spark, sf):
    return similarity.mixed_threshold(_knn(spark, sf), "q_id", "distance", 0.6).select("q_id", "c_id", "meets")


@query("v16_by_user", f"WITH {KNN_OTHER} SELECT q_id, c_user, count(*) AS n, string_agg(c_id::VARCHAR, ',' ORDER BY distance, c_id) AS ids, bool_or(distance <= 0.6) AS any_above FROM knn GROUP BY ALL")
def v16(spark, sf):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("distance", "c_id"))), lambda x: x["c_id"].cast("string")), ",")
    return _knn(spark, sf).groupBy("q_id", "c_user").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"), F.bool_or(F.col("distance") <= 0.6).alias("any_above"))


@query("v17_reuse_embedding", """SELECT d.doc_id, s.text IS NOT NULL AND s.text = d.text AS reuse FROM documents d
  LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'old' END AS text FROM documents WHERE doc_id % 3 = 0) s USING (doc_id)""")
def v17(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "text")
    stored = d.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("old").alias("text"))
    return scoring.reusable(d, stored, "doc_id", "text").select("doc_id", "reuse")


@query("v18_bands", f"""WITH {NEXT} SELECT conversation_id, CASE WHEN s > 0.85 THEN 'very similar' WHEN s > 0.7 THEN 'similar' WHEN s > 0.5 THEN 'somewhat similar' ELSE 'different' END AS band
  FROM (SELECT conversation_id, list_cosine_similarity(v, w) + 0.5 AS s FROM pairs)""")
def v18(spark, sf):
    return neighbours_by_id(spark, sf).select("conversation_id", V.band(V.cosine("v", "w") + 0.5).alias("band"))


def _members(spark, sf):
    return cluster.number_clusters(cluster.match_members(_top(spark, sf), user_vec(spark, sf)))


def category():
    r = F.col("label") % 4
    return F.when(r == 0, "research").when(r == 1, "humanistic").when(r == 2, "practical").otherwise("coding")


def _sides(spark, sf):
    m = _members(spark, sf)
    mine = F.col("user_id") == F.col("current_user_id")
    return m.groupBy("current_user_id", "match_group_id", "cluster_id").agg(F.min(category()).alias("category"), F.count_if(mine).alias("n1"), F.count_if(~mine).alias("n2"))


def _balanced(spark, sf):
    return _sides(spark, sf).where("n1 > 0 and n2 > 0").withColumn("imbalance", F.round(balance.imbalance(F.col("n1"), F.col("n2")), 9)).withColumn("magnitude", balance.magnitude(F.col("n1"), F.col("n2"), True))


IDS = "current_user_id, match_group_id, cluster_id"
GROUP = ["current_user_id", "match_group_id"]


def _ids(df, *more):
    return df.select("current_user_id", F.col("match_group_id").cast("long").alias("match_group_id"), F.col("cluster_id").cast("long").alias("cluster_id"), *more)


@query("k7_cluster_numbers", f"WITH {MEMBERS} SELECT {IDS}, user_id, conversation_id FROM numbered")
def k7(spark, sf):
    return _ids(_members(spark, sf), "user_id", "conversation_id")


@query("k10_cluster_sizes", f"WITH {MEMBERS} SELECT {IDS}, count(*) AS n FROM numbered GROUP BY ALL")
def k10(spark, sf):
    return _ids(_members(spark, sf).groupBy(*GROUP, "cluster_id").agg(F.count(F.lit(1)).alias("n")), "n")


@query("k11_representatives", f"""WITH {USER_VEC}, long AS (SELECT user_id, label, unnest(range(1, len(v) + 1)) AS pos, unnest(v) AS x FROM user_vec),
  m AS (SELECT user_id, label, pos, avg(x) AS x FROM long GROUP BY ALL), c AS (SELECT user_id, label, list(x ORDER BY pos) AS c FROM m GROUP BY ALL),
  n AS (SELECT user_id, count(*) AS n FROM user_vec GROUP BY ALL),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY round(list_cosine_similarity(v, c), 9) DESC, conversation_id) AS r FROM user_vec JOIN c USING (user_id, label) JOIN n USING (user_id))
  SELECT user_id, conversation_id FROM p WHERE n <= 10 OR r = 1""")
def k11(spark, sf):
    return cluster.representatives(user_vec(spark, sf), 10).select("user_id", "conversation_id")


@query("k1_pca")
def k1(spark, sf):
    out, _ = cluster.reduce_dimensions(user_vec(spark, sf), "v")
    return out.select("conversation_id", "reduced")


@query("k2_explained_variance")
def k2(spark, sf):
    _, shares = cluster.reduce_dimensions(user_vec(spark, sf), "v", 64)
    return spark.createDataFrame(cluster.explained_variance(shares), "components long, share double")


@query("k3_ward")
def k3(spark, sf):
    m = cluster.match_members(_top(spark, sf), user_vec(spark, sf))
    return cluster.ward_clusters(m, GROUP, "conversation_id", "v", k=4)


@query("k4_size_capped")
def k4(spark, sf):
    m = cluster.match_members(_top(spark, sf), user_vec(spark, sf))
    return cluster.ward_clusters(m, GROUP, "conversation_id", "v", max_items=20)


@query("k5_density")
def k5(spark, sf):
    m = cluster.match_members(_top(spark, sf), user_vec(spark, sf))
    return cluster.density_clusters(m, GROUP, "conversation_id", "v")


@query("g2_numbered_block", f"""WITH {MEMBERS}, n AS (SELECT *, row_number() OVER (PARTITION BY {IDS} ORDER BY conversation_id, user_id) AS i FROM numbered)
  SELECT {IDS}, string_agg(i || '. conversation ' || conversation_id, chr(10) ORDER BY i) AS block FROM n GROUP BY ALL""")
def g2(spark, sf):
    w = Window.partitionBy(*GROUP, "cluster_id").orderBy("conversation_id", "user_id")
    m = _members(spark, sf).withColumn("i", F.row_number().over(w))
    line = F.concat(F.col("i").cast("string"), F.lit(". conversation "), F.col("conversation_id").cast("string"))
    from ..operators.assemble import ordered_text

    return _ids(m.groupBy(*GROUP, "cluster_id").agg(ordered_text(["i"], line, "\n").alias("block")), "block")


@query("g3_parse_category", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'practical' ELSE lower(event_type) END AS category FROM events")
def g3(spark, sf):
    from ..operators.assemble import parse_category

    c = F.when(F.col("event_id") % 3 == 0, "no json").otherwise(F.concat(F.lit('```json {"category": "'), F.upper("event_type"), F.lit('"} ```')))
    return t(spark, sf, "events").select("event_id", parse_category(c).alias("category"))


@query("g4_join_category", """SELECT doc_id, coalesce(CASE source WHEN 'src1' THEN 'research' WHEN 'src2' THEN 'coding' END, 'practical') AS category FROM documents""")
def g4(spark, sf):
    given = t(spark, sf, "documents").where("source in ('src1', 'src2')").select("source", F.when(F.col("source") == "src1", "research").otherwise("coding").alias("category")).distinct()
    return t(spark, sf, "documents").select("doc_id", "source").join(given, "source", "left").select("doc_id", F.coalesce("category", F.lit("practical")).alias("category"))


@query("b1_b5_balance", f"""WITH {SIDES} SELECT {IDS}, category, n1, n2, round(CASE WHEN n1 = 0 OR n2 = 0 THEN 9999.9 ELSE abs(ln(n1::DOUBLE / n2)) END, 6) AS imbalance,
  round(1.0 / (n1 + n2), 6) AS magnitude FROM sides""")
def b1(spark, sf):
    d = _sides(spark, sf)
    n1, n2 = F.col("n1"), F.col("n2")
    empty = (n1 == 0) | (n2 == 0)
    imb = F.when(~empty, balance.imbalance(F.when(n1 > 0, n1), F.when(n2 > 0, n2)))
    return _ids(d, "category", "n1", "n2", F.round(balance.finite(imb, empty), 6).alias("imbalance"), F.round(balance.magnitude(n1, n2, True), 6).alias("magnitude"))


@query("b4_distance", f"""WITH {MEMBERS}, x AS (SELECT a.current_user_id, a.match_group_id, a.cluster_id, a.conversation_id, max(list_inner_product(a.v, b.v)) AS s
    FROM numbered a JOIN numbered b USING (current_user_id, match_group_id, cluster_id) WHERE a.user_id = a.current_user_id AND b.user_id <> b.current_user_id GROUP BY ALL)
  SELECT {IDS}, round(1 - avg(s), 6) AS dist FROM x GROUP BY ALL""")
def b4(spark, sf):
    m = _members(spark, sf)
    by = [*GROUP, "cluster_id"]
    mine = m.where("user_id = current_user_id").select(*by, "conversation_id", "v")
    rest = m.where("user_id <> current_user_id").groupBy(*by).agg(F.collect_list("v").alias("others"))  # one user's rows of a cluster
    best = F.array_max(F.transform("others", lambda o: V.inner("v", o)))
    return _ids(mine.join(rest, by).groupBy(*by).agg((1 - F.avg(best)).alias("d")), F.round("d", 6).alias("dist"))


@query("v9_optimal_matching")
def v9(spark, sf):
    m = _members(spark, sf).withColumn("side", F.col("user_id") == F.col("current_user_id")).withColumn("cluster_id", F.col("cluster_id").cast("long"))
    return similarity.matched_similarity(m.select(*GROUP, "cluster_id", "side", "v"), [*GROUP, "cluster_id"], "side").withColumn("similarity", F.round("similarity", 6))


@query("v9_auction_matching")
def v9_auction(spark, sf):
    m = cluster.match_members(_top(spark, sf), user_vec(spark, sf)).withColumn("side", F.col("user_id") == F.col("current_user_id"))
    return auction.auction_matching(m.select(*GROUP, "side", "v"), GROUP, "side", gap=0.005)


Z = "CASE WHEN stddev_pop({0}) OVER g > 1e-12 THEN ({0} - avg({0}) OVER g) / stddev_pop({0}) OVER g ELSE 0 END"
SCALED = f"""{SIDES}, scaled AS (SELECT *, {Z.format('imbalance')} AS zi, {Z.format('magnitude')} AS zm FROM balanced WINDOW g AS (PARTITION BY current_user_id, match_group_id))"""


def _scaled(spark, sf):
    return _balanced(spark, sf).withColumn("zi", balance.z_score("imbalance", GROUP)).withColumn("zm", balance.z_score("magnitude", GROUP))


@query("b7_z_scores", f"WITH {SCALED} SELECT {IDS}, round(zi, 6) AS zi, round(zm, 6) AS zm FROM scaled")
def b7(spark, sf):
    return _ids(_scaled(spark, sf), r6("zi"), r6("zm"))


@query("b8_refitted_scaler", f"""WITH {SIDES}, f AS (SELECT current_user_id, match_group_id, avg(imbalance) AS m, stddev_pop(imbalance) AS s FROM balanced GROUP BY ALL)
  SELECT {IDS}, round(CASE WHEN s > 1e-12 THEN (abs(ln((n1 + 1)::DOUBLE / n2)) - m) / s ELSE 0 END, 6) AS score FROM balanced JOIN f USING (current_user_id, match_group_id)""")
def b8(spark, sf):
    b = _balanced(spark, sf)
    scaler = balance.fit_scaler(b, GROUP, ["imbalance"])
    later = b.withColumn("imbalance", balance.imbalance(F.col("n1") + 1, F.col("n2")))
    return _ids(balance.apply_scaler(later, scaler, GROUP, ["imbalance"]), r6("score"))


@query("b9_member_scores", f"WITH {SCALED} SELECT n.current_user_id, n.match_group_id, n.cluster_id, n.conversation_id, n.user_id, round(zi + zm, 6) AS score FROM numbered n LEFT JOIN scaled s USING (current_user_id, match_group_id, cluster_id)")
def b9(spark, sf):
    s = _scaled(spark, sf).select(*GROUP, "cluster_id", (F.col("zi") + F.col("zm")).alias("score"))
    return _ids(_members(spark, sf).join(s, [*GROUP, "cluster_id"], "left"), "conversation_id", "user_id", r6("score"))


@query("b10_user_pairs", f"""WITH {USER_VEC}, c AS (SELECT label, user_id, count(*) AS n FROM user_vec GROUP BY ALL)
  SELECT a.label, a.user_id AS u1, b.user_id AS u2, round(abs(ln(a.n::DOUBLE / b.n)), 6) AS imbalance FROM c a JOIN c b ON a.label = b.label AND a.user_id < b.user_id""")
def b10(spark, sf):
    c = user_vec(spark, sf).groupBy("label", "user_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = c.select("label", F.col("user_id").alias("u1"), F.col("n").alias("n1")), c.select("label", F.col("user_id").alias("u2"), F.col("n").alias("n2"))
    return a.join(b, "label").where("u1 < u2").select("label", "u1", "u2", F.round(balance.imbalance(F.col("n1"), F.col("n2")), 6).alias("imbalance"))


@query("b11_by_category", f"WITH {SIDES} SELECT category, round(avg(imbalance), 6) AS imbalance, round(avg(magnitude), 6) AS magnitude, count(*) AS n FROM balanced GROUP BY ALL")
def b11(spark, sf):
    return _balanced(spark, sf).groupBy("category").agg(F.round(F.avg("imbalance"), 6).alias("imbalance"), F.round(F.avg("magnitude"), 6).alias("magnitude"), F.count(F.lit(1)).alias("n"))


@query("b12_correlation", f"WITH {SIDES} SELECT round(corr(imbalance, magnitude), 6) AS c_im, round(corr(imbalance, n1), 6) AS c_i1, round(corr(magnitude, n2), 6) AS c_m2 FROM balanced")
def b12(spark, sf):
    return _balanced(spark, sf).agg(F.round(F.corr("imbalance", "magnitude"), 6).alias("c_im"), F.round(F.corr("imbalance", "n1"), 6).alias("c_i1"), F.round(F.corr("magnitude", "n2"), 6).alias("c_m2"))


@query("b13_histogram", """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
  SELECT o_orderstatus, CAST(least(floor((o_totalprice - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n,
  ((200 * sum(round(o_totalprice * 100)::HUGEINT) + count(*)) // (2 * count(*)))::DOUBLE / 10000 AS mean FROM orders, e GROUP BY ALL""")
def b13(spark, sf):
    return balance.histogram(t(spark, sf, "orders"), "o_totalprice", ["o_orderstatus"]).withColumn("mean", F.round("mean", 4).cast("double"))


@query("b14_ten_best", f"WITH {SIDES} SELECT {IDS}, round(imbalance, 6) AS imbalance FROM balanced WHERE category <> 'coding' ORDER BY balanced.imbalance, {IDS} LIMIT 10")
def b14(spark, sf):
    return _ids(_balanced(spark, sf).where("category <> 'coding'").orderBy("imbalance", *GROUP, "cluster_id").limit(10), r6("imbalance"))


ROWS = f"{MEMBERS}, idx AS (SELECT *, row_number() OVER (PARTITION BY current_user_id ORDER BY cluster_id, user_id, conversation_id) - 1 AS row_idx FROM numbered)"


@query("p1_row_index", f"WITH {ROWS} SELECT {IDS}, row_idx, user_id, conversation_id FROM idx")
def p1(spark, sf):
    w = Window.partitionBy("current_user_id").orderBy("cluster_id", "user_id", "conversation_id")
    return _ids(_members(spark, sf).withColumn("row_idx", (F.row_number().over(w) - 1).cast("long")), "row_idx", "user_id", "conversation_id")


@query("p2_sides", f"""WITH {ROWS} SELECT {IDS}, row_idx, user_id = current_user_id AS mine FROM (SELECT *, bool_or(user_id = current_user_id) OVER c AS a, bool_or(user_id <> current_user_id) OVER c AS b
  FROM idx WINDOW c AS (PARTITION BY {IDS})) WHERE a AND b""")
def p2(spark, sf):
    return _ids(paths.rows_of_sides(_members(spark, sf)), F.col("row_idx").cast("long").alias("row_idx"), "mine")


BLOCK = """'ID: ' || row_idx || chr(10) || 'Title: No title' || chr(10) || 'Date: Unknown' || chr(10) || 'Summary: talk ' || conversation_id"""


def _side_text(rows):
    r = rows.select("*", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("date_text"), F.concat(F.lit("talk "), F.col("conversation_id").cast("string")).alias("summary"))
    return _ids(paths.side_text(r, [*GROUP, "cluster_id", "mine"], ["row_idx"]), "mine", "block")


@query("p3_all_side_text", f"""WITH {ROWS} SELECT {IDS}, user_id = current_user_id AS mine, string_agg({BLOCK}, chr(10) || chr(10) ORDER BY row_idx) AS block FROM (SELECT *, bool_or(user_id = current_user_id) OVER c AS a,
  bool_or(user_id <> current_user_id) OVER c AS b FROM idx WINDOW c AS (PARTITION BY {IDS})) WHERE a AND b GROUP BY ALL""")
def p3_all(spark, sf):
    return _side_text(paths.rows_of_sides(_members(spark, sf)))


@query("p6_greedy_choice", f"WITH {SIDES} SELECT {IDS} FROM (SELECT *, row_number() OVER (PARTITION BY current_user_id, match_group_id ORDER BY imbalance, cluster_id) AS n FROM balanced) WHERE n = 1")
def p6(spark, sf):
    w = Window.partitionBy(*GROUP).orderBy("imbalance", "cluster_id")
    return _ids(_balanced(spark, sf).withColumn("n", F.row_number().over(w)).where("n = 1"))


ANSWERS = """answers AS (SELECT event_id, [event_id % 5, event_id % 7, event_id % 5] AS c, [event_id % 7, event_id % 3 + 10] AS a, [event_id % 3 + 10, event_id % 4 + 11] AS b FROM events)"""
PARSED = f"""{ANSWERS}, parsed AS (SELECT event_id, list_sort(list_distinct(c)) AS common, list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(c, x))) AS user1, b, c FROM answers),
done AS (SELECT event_id, common, user1, list_sort(list_filter(list_distinct(b), lambda x: NOT list_contains(c, x) AND NOT list_contains(user1, x))) AS user2 FROM parsed)"""


def _answers(spark, sf):
    e = F.col("event_id")
    lists = F.struct(F.lit("t").alias("path_title"), F.array(e % 5, e % 7, e % 5).alias("common_indices"), F.array(e % 7, e % 3 + 10).alias("user1_unique_indices"), F.array(e % 3 + 10, e % 4 + 11).alias("user2_unique_indices"))
    answer = F.concat(F.lit("```json\n"), F.to_json(lists), F.lit("\n```"))
    return t(spark, sf, "events").select("event_id", "user_id", paths.parse_answer(answer).alias("p")).select("event_id", "user_id", "p.*")


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


@query("p9_parse_answer", f"""WITH {PARSED} SELECT event_id, array_to_string(common, ',') AS common, array_to_string(user1, ',') AS user1, array_to_string(user2, ',') AS user2,
  len(common) > 0 AND len(user1) > 0 AND len(user2) > 0 AS ok FROM done""")
def p9(spark, sf):
    return _answers(spark, sf).select("event_id", _joined("common"), _joined("user1"), _joined("user2"), "ok")


@query("p13_drop_repeated_ids", f"""WITH {PARSED}, u AS (SELECT event_id % 100 AS g, event_id, common, user1, user2 FROM done),
  items AS (SELECT g, event_id, 0 AS l, unnest(range(len(common))) AS pos, unnest(common) AS id FROM u UNION ALL
    SELECT g, event_id, 1, unnest(range(len(user1))), unnest(user1) FROM u UNION ALL SELECT g, event_id, 2, unnest(range(len(user2))), unnest(user2) FROM u),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY event_id, l, pos) AS n FROM items) WHERE n = 1)
  SELECT u.g, u.event_id AS path_seq, coalesce(string_agg(id::VARCHAR, ',' ORDER BY pos) FILTER (WHERE l = 0), '') AS common,
    coalesce(string_agg(id::VARCHAR, ',' ORDER BY pos) FILTER (WHERE l = 1), '') AS user1, coalesce(string_agg(id::VARCHAR, ',' ORDER BY pos) FILTER (WHERE l = 2), '') AS user2
  FROM u LEFT JOIN f ON u.event_id = f.event_id GROUP BY ALL""")
def p13(spark, sf):
    p = _answers(spark, sf).select((F.col("event_id") % 100).alias("g"), F.col("event_id").alias("path_seq"), "common", "user1", "user2")
    return paths.drop_repeated_ids(p, ["g"]).select("g", "path_seq", _joined("common"), _joined("user1"), _joined("user2"))


@query("p14_to_conversations", f"""WITH {PARSED} SELECT event_id AS path_seq, array_to_string(list_transform(common, lambda x: x * 100), ',') AS common, array_to_string(list_transform(user1, lambda x: x * 100), ',') AS user1,
  array_to_string(list_transform(user2, lambda x: x * 100), ',') AS user2 FROM done""")
def p14(spark, sf):
    p = _answers(spark, sf).select(F.lit(0).alias("g"), F.col("event_id").alias("path_seq"), "common", "user1", "user2")
    ids = p.select(F.explode(F.concat("common", "user1", "user2")).alias("row_idx")).distinct().select(F.lit(0).alias("g"), "row_idx", (F.col("row_idx") * 100).alias("conversation_id"))
    return paths.to_conversations(p, ids, ["g"])[0].select("path_seq", _joined("common"), _joined("user1"), _joined("user2"))


@query("p11_discover_paths")
def p11(spark, sf):
    from ..operators.scoring import complete, first_ids_path

    m = _members(spark, sf).withColumn("category", category())
    rows = paths.rows_of_sides(m).select(
        *GROUP, "cluster_id", "category", "row_idx", "user_id", "conversation_id", "mine", F.lit(None).cast("string").alias("title"),
        F.concat(F.lit("talk "), F.col("conversation_id").cast("string")).alias("summary"), F.lit(None).cast("string").alias("date_text"), "v",
    )
    return paths.discover_paths(rows, lambda d: complete(d, "prompt", first_ids_path), paths.saver(spark, views.shared_root(spark)))


def _geo(spark, sf):
    s, n = t(spark, sf, "supplier"), t(spark, sf, "nation")
    a = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    return a.unionByName(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst")))


GEO = "edges AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


@query("h1_h2_graph", f"WITH {GEO} SELECT DISTINCT src AS node FROM edges UNION SELECT dst FROM edges")
def h2(spark, sf):
    rows = _geo(spark, sf).groupBy(F.col("src").alias("node")).agg(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"))).alias("rel"))
    return graph.nodes_and_edges(rows, "node", "rel")[0].select("node")


@query("h3_neighbours", "SELECT p_partkey AS node, coalesce((SELECT string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) FROM lineitem WHERE l_partkey = p_partkey), '') AS out FROM part")
def h3(spark, sf):
    e = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").cast("string").alias("dst"))
    n = t(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    return graph.neighbours(n, "node", e).withColumn("out", F.array_join("out", ","))


@query("h4_known_edges", "SELECT s_suppkey AS src, n_nationkey AS dst, s_acctbal AS src_x, n_regionkey::DOUBLE AS dst_x FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def h4(spark, sf):
    s, n = t(spark, sf, "supplier"), t(spark, sf, "nation")
    # one table of nodes: nations have negative ids
    nation = lambda c: (-1 - F.col(c)).cast("long")
    nodes = s.select(F.col("s_suppkey").cast("long").alias("node"), F.col("s_acctbal").cast("double").alias("x")).unionByName(n.select(nation("n_nationkey").alias("node"), F.col("n_regionkey").cast("double").alias("x")))
    e = graph.known_edges(s.select(F.col("s_suppkey").cast("long").alias("src"), nation("s_nationkey").alias("dst")), nodes, "node", ["x"])
    return e.select("src", (-1 - F.col("dst")).alias("dst"), "src_x", "dst_x")


@query("h5_shortest_path", f"""WITH {GEO}, p AS (SELECT 's1' AS s, dst AS n FROM edges WHERE src = 's1')
  SELECT 0 AS step, 's1' AS node UNION ALL SELECT 1, n FROM p UNION ALL SELECT 2, dst FROM edges JOIN p ON src = n""")
def h5(spark, sf):
    e = _geo(spark, sf)
    goal = e.where("src = 's1'").select(F.col("dst").alias("src")).join(e, "src").first()["dst"]
    return graph.shortest_path(e, "s1", goal, paths.saver(spark, views.shared_root(spark)))


def _merge(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.round(F.col("o_totalprice") + 1, 2))


@query("d1_insert_if_absent", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice ELSE round(o_totalprice + 1, 2) END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def d1(spark, sf):
    a, b = _merge(spark, sf)
    return serving.insert_if_absent(a, b, ["o_orderkey"], ["o_custkey"])


@query("d2_upsert", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice + 1, 2) ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def d2(spark, sf):
    a, b = _merge(spark, sf)
    return serving.upsert(a, b, ["o_orderkey"], keep=("o_custkey",))


@query("d3_already_embedded", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 3 = 0)")
def d3(spark, sf):
    """Documents without a stored vector; every third vector is stored, as in v17_reuse_embedding."""
    stored = t(spark, sf, "embeddings").where("embedding is not null and vec_id % 3 = 0").select(F.col("vec_id").alias("doc_id"))
    return t(spark, sf, "documents").select("doc_id").join(stored, "doc_id", "left_anti")


@query("d4_skip_empty", "SELECT conv_id, turn FROM conversations WHERE length(text) > 0")
def d4(spark, sf):
    return t(spark, sf, "conversations").where(F.length("text") > 0).select("conv_id", "turn")


@query("d5_valid_paths", f"WITH {PATHS} SELECT match_id, path_no, supp % 3 <> 0 AS valid FROM paths")
def d5(spark, sf):
    p = views.paths(spark, sf).withColumn("ids", F.when(F.col("supp") % 3 != 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    return p.select("match_id", "path_no", (F.col("ids").isNotNull() & (F.size("ids") > 0)).alias("valid"))


@query("d6_match_of_pair", f"WITH {MATCHES} SELECT a.match_id, a.user_id AS u1, b.user_id AS u2 FROM pivot_rows a JOIN pivot_rows b ON a.match_id = b.match_id AND a.user_id < b.user_id")
def d6(spark, sf):
    return serving.match_of_pair(views.pivot(spark, sf))


@query("d7_upsert_match", f"WITH {SIMS} SELECT least(user_id, other_id) AS u1, greatest(user_id, other_id) AS u2, round(max(similarity), 6) AS score FROM top GROUP BY ALL")
def d7(spark, sf):
    top = _top(spark, sf).withColumn("k", serving.pair_key("user_id", "other_id"))
    return top.groupBy("k").agg(F.max("similarity").alias("s")).select(F.col("k")[0].alias("u1"), F.col("k")[1].alias("u2"), F.round("s", 6).alias("score"))


@query("d8_pivot_rows", f"WITH {MATCHES} SELECT user_id, match_id FROM pivot_rows")
def d8(spark, sf):
    return views.pivot(spark, sf)


@query("d10_user_paths", f"WITH {PATHS} SELECT match_id, path_no, unnest([part, supp]) AS user_id, unnest([1, 2])::BIGINT AS side FROM paths")
def d10(spark, sf):
    return serving.user_paths(views.paths(spark, sf), "part", "supp").select("match_id", "path_no", "user_id", "side")


@query("d11_upsert_two_keys", f"""WITH {PATHS} SELECT match_id, path_no, CASE WHEN path_no % 2 = 0 THEN 'new' ELSE category END AS category FROM paths WHERE match_id % 3 <> 0 OR path_no % 2 = 0""")
def d11(spark, sf):
    p = views.paths(spark, sf).select("match_id", "path_no", "category")
    return serving.upsert(p.where("match_id % 3 <> 0"), p.where("path_no % 2 = 0").withColumn("category", F.lit("new")), ["match_id", "path_no"])


@query("d12_replace_links", f"""WITH {PATHS} SELECT match_id, part AS child FROM (SELECT DISTINCT match_id, part FROM paths WHERE match_id % 2 = 0) UNION ALL
  SELECT match_id, x FROM (SELECT DISTINCT match_id, unnest([match_id, match_id + 1]) AS x FROM paths WHERE match_id % 2 = 1)""")
def d12(spark, sf):
    p = views.paths(spark, sf)
    links = p.select("match_id", F.col("part").alias("child")).distinct()
    touched = p.where("match_id % 2 = 1").select("match_id").distinct().withColumn("list", F.array(F.col("match_id"), F.col("match_id") + 1))
    return serving.replace_links(links, touched, "match_id", "child", "list")


@query("d14_unviewed", f"WITH {MATCHES} SELECT user_id, count(DISTINCT match_id) AS n FROM pivot_rows JOIN matches USING (match_id) WHERE NOT viewed GROUP BY 1")
def d14(spark, sf):
    return serving.unviewed_matches(views.pivot(spark, sf), views.matches(spark, sf))


@query("d15_matches_of_users", f"WITH {MATCHES} SELECT p.user_id, m.match_id, m.score, row_number() OVER (PARTITION BY p.user_id ORDER BY m.score DESC, m.match_id) AS place FROM (SELECT DISTINCT * FROM pivot_rows) p JOIN matches m USING (match_id)")
def d15(spark, sf):
    return serving.matches_of_users(views.pivot(spark, sf), views.matches(spark, sf))


@query("d16_nested_matches", f"""WITH {MATCHES}, {PATHS}, p AS (SELECT match_id, count(*) AS n_paths, string_agg(path_no::VARCHAR, ',' ORDER BY balance, path_no) AS paths FROM paths GROUP BY 1),
  u AS (SELECT match_id, string_agg(user_id::VARCHAR, ',' ORDER BY user_id) AS users FROM (SELECT DISTINCT * FROM pivot_rows) GROUP BY 1)
  SELECT match_id, users, coalesce(n_paths, 0) AS n_paths, coalesce(paths, '') AS paths FROM matches LEFT JOIN u USING (match_id) LEFT JOIN p USING (match_id)""")
def d16(spark, sf):
    d = serving.nested_matches(views.matches(spark, sf), views.pivot(spark, sf), views.paths(spark, sf))
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    return d.select("match_id", text("users", lambda x: x.cast("string")).alias("users"), F.coalesce(F.size("paths"), F.lit(0)).cast("long").alias("n_paths"), F.coalesce(text("paths", lambda x: x["path_no"].cast("string")), F.lit("")).alias("paths"))


@query("d17_sensitive_filter", f"""WITH {MATCHES}, {PATHS}, {USERS}, o AS (SELECT p.match_id, bool_and(coalesce(u.sensitive_matching, false)) AS ok FROM (SELECT DISTINCT * FROM pivot_rows) p JOIN matches m USING (match_id)
  LEFT JOIN users u ON u.id = p.user_id WHERE p.user_id <> m.owner GROUP BY 1) SELECT match_id, path_no FROM paths LEFT JOIN o USING (match_id) WHERE NOT sensitive OR coalesce(ok, true)""")
def d17(spark, sf):
    return serving.visible_paths(views.paths(spark, sf), views.pivot(spark, sf), views.matches(spark, sf), views.users(spark, sf)).select("match_id", "path_no")


QUEUE = f"{USERS}, line AS (SELECT id AS user_id, created_at FROM users WHERE created_at IS NOT NULL AND id % 3 <> 0)"


def _queue(spark, sf):
    return views.users(spark, sf).where("created_at is not null and id % 3 <> 0").select(F.col("id").alias("user_id"), F.col("created_at").cast("timestamp").alias("created_at"))


@query("d18_queue", f"WITH {QUEUE} SELECT user_id, row_number() OVER (ORDER BY created_at, user_id) AS position FROM line")
def d18(spark, sf):
    return serving.queue_finish(_queue(spark, sf), F.lit("2000-01-01").cast("timestamp")).select("user_id", F.col("position").cast("long").alias("position"))


@query("d19_queue_finish", f"""WITH {QUEUE}, q AS (SELECT user_id, row_number() OVER (ORDER BY created_at, user_id) AS p, greatest(0, 8 - (epoch(TIMESTAMP '1992-01-01 00:10:00') - epoch(created_at::TIMESTAMP)) / 60) AS r FROM line)
  SELECT user_id, round(2 * p + max(r - 2 * (p - 1)) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING), 6) AS finish FROM q""")
def d19(spark, sf):
    return serving.queue_finish(_queue(spark, sf), F.lit("1992-01-01 00:10:00").cast("timestamp")).select("user_id", r6("finish"))


@query("d20_feedback", """SELECT o_custkey AS user_id, o_orderkey AS path_id, o_orderkey % 5 - 2 AS score, o_orderkey % 5 - 2 BETWEEN -1 AND 1 AS valid FROM orders""")
def d20(spark, sf):
    s = F.col("o_orderkey") % 5 - 2
    return t(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("path_id"), s.alias("score"), s.isin(-1, 0, 1).alias("valid"))


@query("d21_mark_viewed", f"WITH {MATCHES} SELECT match_id, viewed OR match_id % 7 = 0 AS viewed FROM matches")
def d21(spark, sf):
    m = views.matches(spark, sf)
    return serving.mark_viewed(m, m.where("match_id % 7 = 0")).select("match_id", "viewed")


@query("d22_sorted_matches", f"WITH {MATCHES} SELECT match_id, score FROM matches ORDER BY score DESC, match_id")
def d22(spark, sf):
    return serving.sorted_matches(views.matches(spark, sf).select("match_id", "score"))


@query("d23_pair_fetch", f"WITH {USER_VEC} SELECT a.conversation_id AS c1, b.conversation_id AS c2, 'Compare ' || a.conversation_id || ' and ' || b.conversation_id AS prompt FROM user_vec a JOIN user_vec b ON b.conversation_id = a.conversation_id + 21 WHERE a.user_id % 2 = 0")
def d23(spark, sf):
    u = user_vec(spark, sf)
    pair = u.where("user_id % 2 = 0").select(F.col("conversation_id").alias("c1"), (F.col("conversation_id") + 21).alias("c2"))
    own = u.select(F.col("conversation_id").alias("c2"))
    return pair.join(own, "c2").select("c1", "c2", F.concat(F.lit("Compare "), F.col("c1").cast("string"), F.lit(" and "), F.col("c2").cast("string")).alias("prompt"))


@query("d24_constraints", """SELECT 'orders_without_customer' AS rule, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL
  SELECT 'repeated_lines', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'null_names', count(*) FROM customer WHERE c_name IS NULL""")
def d24(spark, sf):
    o = serving.orphans(t(spark, sf, "orders"), "o_custkey", t(spark, sf, "customer"), "c_custkey").agg(F.lit("orders_without_customer").alias("rule"), F.count(F.lit(1)).alias("n"))
    twice = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(F.lit("repeated_lines").alias("rule"), F.count(F.lit(1)).alias("n"))
    return o.unionByName(twice).unionByName(t(spark, sf, "customer").where("c_name is null").agg(F.lit("null_names").alias("rule"), F.count(F.lit(1)).alias("n")))
