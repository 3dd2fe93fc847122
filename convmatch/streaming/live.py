"""Live updates: changed conversations are embedded, upserted and matched with other users'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import scoring, serving, similarity
from ..operators.vector_index import VectorIndex
from ..operators.versions import Snapshot, Versions, newest
from .snapshots import content_hash, ready, run_live, should_process

NEIGHBOURS, LIMIT = 5, 0.2
COLUMNS = ["user_id", "conversation_id", "title", "messages"]


def embedded_changes(latest: DataFrame, served: DataFrame, states: DataFrame, embedder: scoring.Embedder) -> DataFrame:
    """The snapshots of ``latest`` to be taken in: COLUMNS, content_hash, embedding and error.

    Snapshots that are not ready, in process, or done with the same content are left out; of the
    others a vector is kept where the served messages are the same and made anew elsewhere.
    """
    new = latest.select(*COLUMNS).where(ready("messages", "title")).withColumn("content_hash", content_hash("messages"))
    new = should_process(new, states, "conversation_id").where("go").drop("go")
    new = new.withColumn("_text", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"))
    old = served.select("conversation_id", content_hash("messages").alias("_h"), F.col("embedding").alias("_e"))
    new = new.join(old, "conversation_id", "left").withColumn("_same", F.coalesce(F.col("_h") == F.col("content_hash"), F.lit(False)) & F.col("_e").isNotNull())
    kept = new.where("_same").withColumn("embedding", F.col("_e")).withColumn("error", F.lit(None).cast("string"))
    return kept.unionByName(scoring.embed(new.where("not _same"), "_text", embedder)).select(*COLUMNS, "content_hash", "embedding", "error")


def status_of(done: DataFrame) -> DataFrame:
    return done.select("conversation_id", F.when(F.col("error").isNull(), "completed").otherwise("error").alias("status"), "content_hash")


def live_update(latest: DataFrame, served: DataFrame, states: DataFrame, embedder: scoring.Embedder, k: int = NEIGHBOURS, limit: float = LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One micro-batch over whole tables: (served, states, hits) after the snapshots in ``latest``.

    ``latest`` and ``served``: user_id, conversation_id, title, messages (and embedding in
    ``served``); ``states``: conversation_id, status, content_hash.  Hits are the ``k`` nearest
    conversations of other users; where some lie within ``limit``, only those.
    """
    done = embedded_changes(latest, served, states, embedder)
    good = done.where("error is null").select(*COLUMNS, "embedding")
    after = serving.upsert(served.select(*COLUMNS, "embedding"), good, ["conversation_id"])
    queries = good.select(F.col("conversation_id").alias("q_id"), F.col("user_id").alias("q_user"), F.col("embedding").alias("v"))
    others = after.where("embedding is not null").select(F.col("conversation_id").alias("c_id"), F.col("user_id").alias("c_user"), F.col("embedding").alias("v"))
    hits = similarity.nearest(queries, others, k, other_users=True).withColumn("distance", 1 - F.col("score"))
    return after, serving.upsert(states, status_of(done), ["conversation_id"]), similarity.mixed_threshold(hits, "q_id", "distance", limit)


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conversation_id").alias("id"), F.col("user_id").alias("user"), F.col("embedding").alias("v"))


class LiveTables:
    """Served conversations, their states, hits and vector index in one :class:`Versions` folder.

    A micro-batch appends a segment to each table and publishes all of them in one version, under
    the number of its epoch: a batch that was published before its stream was restarted is not
    made again, and one that was lost on the way left nothing to be seen.  Only the rows of the
    batch's conversations are read of the served ones; neighbours come from the index.
    """

    def __init__(self, versions: Versions, embedder: scoring.Embedder, k: int = NEIGHBOURS, limit: float = LIMIT, probes: int | None = None, writer: str = "live") -> None:
        self.versions, self.embedder, self.k, self.limit, self.probes, self.writer = versions, embedder, k, limit, probes, writer

    def start(self, served: DataFrame, states: DataFrame, dim: int | None = None) -> None:
        """Publish what is there before the stream: ``served`` with embeddings (``dim`` numbers) and ``states``."""
        VectorIndex.build(self.versions, _vectors(served), dim=dim)
        first = F.lit(0).alias("_segment")
        tables = {
            "served": [self.versions.stage("served", served.select(*COLUMNS, "embedding", first))],
            "states": [self.versions.stage("states", states.select("conversation_id", "status", "content_hash", first))],
        }
        self.versions.update(lambda base: {"tables": tables})

    def handle(self, latest: DataFrame, epoch: int) -> None:
        """Take in one micro-batch: the latest snapshot of each of its conversations."""
        self.versions.update(lambda base: self._change(base, latest, epoch))

    def _change(self, base: Snapshot, latest: DataFrame, epoch: int) -> dict | None:
        if base.commits.get(self.writer, -1) >= epoch:
            return None
        v, segment = self.versions, base.meta["segments"]
        ids = latest.select("conversation_id").distinct()

        def now(name: str) -> DataFrame:
            return newest(base.table(name).join(ids, "conversation_id", "left_semi"), "conversation_id").drop("_segment")

        path = v.stage("done", embedded_changes(latest, now("served"), now("states"), self.embedder))
        done = Snapshot(v.spark, tables={"done": [path]}).table("done")
        good = done.where("error is null")
        index = VectorIndex.open(base).added(v, _vectors(good), segment)
        queries = good.select(F.col("conversation_id").alias("q_id"), F.col("user_id").alias("q_user"), F.col("embedding").alias("v"))
        hits = index.search(queries, self.k, other_users=True, probes=self.probes).withColumn("distance", 1 - F.col("score"))
        this = F.lit(segment).alias("_segment")
        new = {
            "served": good.select(*COLUMNS, "embedding", this),
            "states": status_of(done).select("*", this),
            "hits": similarity.mixed_threshold(hits, "q_id", "distance", self.limit).select("*", this),
        }
        appended = {name: [*base.tables.get(name, []), v.stage(name, df)] for name, df in new.items()}
        return {"tables": index.tables | appended, "commit": (self.writer, epoch), "meta": {"segments": segment + 1}}

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Follow a stream of snapshots (COLUMNS and ts)."""
        return run_live(stream, self.handle, checkpoint)

    def served(self) -> DataFrame:
        return newest(self.versions.current().table("served"), "conversation_id").drop("_segment")

    def states(self) -> DataFrame:
        return newest(self.versions.current().table("states"), "conversation_id").drop("_segment")

    def hits(self) -> DataFrame:
        """The hits of each conversation's last change."""
        schema = "q_id long, q_user long, rank int, c_id long, c_user long, score double, distance double, meets boolean, _segment int"
        rows = self.versions.current().table("hits", schema)
        last = rows.groupBy("q_id").agg(F.max("_segment").alias("_segment"))
        return rows.join(last, ["q_id", "_segment"]).drop("_segment")

    def compact(self) -> None:
        """One segment of every table in place of all."""
        VectorIndex.compact(self.versions)

        def change(base: Snapshot) -> dict:
            tables = {n: [self.versions.stage(n, newest(base.table(n), "conversation_id").withColumn("_segment", F.lit(0)))] for n in ("served", "states")}
            return {"tables": tables}

        self.versions.update(change)
