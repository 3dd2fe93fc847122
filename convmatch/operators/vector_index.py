"""An approximate nearest-neighbour index that is kept: inverted lists with residual codes.

Vectors are scaled to unit length, so that inner products are cosines.  Centres are fitted on a
bounded sample; each vector is in the list of its nearest centre, as a byte a dimension of
what it differs from the centre by.  A query meets the lists of its nearest centres only, by codes,
and the best of them by their vectors.  The number of lists grows with the root of the rows, and
so does the work of a query.

The index is a set of tables in a :class:`~.versions.Versions` folder.  Inserts append segments; a
vector that comes again replaces its former row, which is named in ``gone``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import similarity
from .versions import Snapshot, Versions

CODES = "list int, id long, user long, scale float, code binary, _segment int"
VECTORS = "id long, user long, v array<float>, _segment int"
GONE = "id long, _segment int"
#: Centres are held by every task: at most so many bytes of them.
CENTRE_BYTES = 64 << 20


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """``vectors`` (id, user, v) at unit length; null, zero and non-finite ones and those of
    another length are left out."""
    v = vectors.select(F.col("id").cast("long").alias("id"), F.col("user").cast("long").alias("user"), F.col("v").cast("array<double>").alias("v"))
    v = v.where("id is not null and v is not null and size(v) > 0" + (f" and size(v) = {dim}" if dim else ""))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    v = v.withColumn("_n", norm).where("_n > 0 and _n < double('infinity')")
    return v.select("id", "user", F.transform("v", lambda x: (x / F.col("_n")).cast("float")).alias("v"))


def fit_centres(vectors: DataFrame, lists: int, sample: int = 50_000, seed: int = 7) -> np.ndarray:
    """Unit centres of at most ``lists`` lists, by k-means on about ``sample`` of ``vectors`` (:func:`usable`)."""
    n = vectors.count()
    some = vectors if n <= sample else vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    model = KMeans(k=max(2, lists), maxIter=10, initSteps=2, seed=seed, featuresCol="_v").fit(some.select(array_to_vector("v").alias("_v")))
    c = np.array(model.clusterCenters())
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def lists_for(rows: int, dim: int) -> int:
    """As many lists as the root of the rows, as far as their centres may be held."""
    return max(1, min(int(np.sqrt(rows)), CENTRE_BYTES // (8 * dim)))


class VectorIndex:
    """The index of one pinned version.  ``codes``, ``vectors`` and ``gone`` are its tables."""

    def __init__(self, spark: SparkSession, centres: np.ndarray, probes: int, tables: dict[str, list[str]]) -> None:
        self.spark, self.centres, self.probes, self.tables = spark, centres, probes, tables
        self._pinned = Snapshot(spark, tables=tables)

    # -- building and opening

    @classmethod
    def build(cls, versions: Versions, vectors: DataFrame, recall: float = 0.95, k: int = 30, lists: int | None = None, dim: int | None = None) -> VectorIndex:
        """Fit, code and publish ``vectors`` (id, user, v).

        As many lists are probed as give ``recall`` of the ``k`` nearest, measured exactly on at
        most 200 of the vectors against all.  ``dim`` is the vectors' length, by default the longest's;
        to start without vectors it has to be given.
        """
        spark = vectors.sparkSession
        dim = dim or vectors.where("v is not null").select(F.max(F.size("v"))).first()[0] or 1
        first = Snapshot(spark, tables={"v": [versions.stage("vectors", usable(vectors, dim).withColumn("_segment", F.lit(0)))]})
        unit = first.table("v", VECTORS)
        rows = unit.count()
        centres = fit_centres(unit, lists or lists_for(rows, dim)) if rows > 1 else np.eye(1, dim)
        probes = _probes(unit, rows, centres, recall, k)
        index = cls(spark, centres, probes, {"vectors": first.tables["v"], "gone": []})
        index.tables["codes"] = [versions.stage("codes", index._coded(unit))]
        index.tables["centres"] = [versions.stage("centres", spark.createDataFrame(pd.DataFrame({"list": range(len(centres)), "centre": centres.tolist()}), "list int, centre array<double>"))]
        versions.update(lambda base: {"tables": index.tables, "meta": {"probes": probes, "segments": 1}})
        return cls.open(versions.current())

    @classmethod
    def open(cls, snapshot: Snapshot) -> VectorIndex:
        rows = snapshot.table("centres").orderBy("list").select("centre").toPandas()  # CENTRE_BYTES at most
        names = ("codes", "vectors", "gone", "centres")
        return cls(snapshot.spark, np.stack(rows["centre"].to_numpy()), snapshot.meta["probes"], {n: list(snapshot.tables.get(n, [])) for n in names})

    def _coded(self, unit: DataFrame) -> DataFrame:
        """Codes of :func:`usable` vectors with their segment."""
        c = self.centres

        def run(frames):
            for pdf in frames:
                if not len(pdf):
                    continue
                v = np.stack(pdf["v"].to_numpy()).astype(float)
                at = (v @ c.T).argmax(1)
                rest = v - c[at]
                scale = np.abs(rest).max(1) / 127
                code = np.rint(rest / np.maximum(scale, 1e-30)[:, None]).astype(np.int8)
                yield pd.DataFrame({"list": at.astype("int32"), "id": pdf["id"], "user": pdf["user"], "scale": scale.astype("float32"), "code": [x.tobytes() for x in code], "_segment": pdf["_segment"]})

        # the rows of a list lie together, so that a reader of few lists skips most of the file
        return unit.mapInPandas(run, CODES).sortWithinPartitions("list")

    # -- reading

    def live(self, name: str, schema: str) -> DataFrame:
        """The rows of a table that no later segment replaced."""
        rows = self._pinned.table(name, schema)
        return rows.join(self._pinned.table("gone", GONE), ["id", "_segment"], "left_anti") if self.tables["gone"] else rows

    def search(self, queries: DataFrame, k: int = 30, other_users: bool = False, probes: int | None = None, wider: int = 4, with_work: bool = False) -> DataFrame:
        """q_id, q_user, rank, c_id, c_user, score (cosine): about the ``k`` nearest of each query
        (q_id, q_user, v), nearest first, ties to the smaller id.

        A query does not meet its own id, with ``other_users`` nor its own user's rows.  ``wider * k``
        candidates by codes are judged by their vectors.  Queries without a usable vector
        have no rows.  With ``with_work`` also ``met``, the codes that the query met.
        """
        c, probes = self.centres, min(probes or self.probes, len(self.centres))
        q = usable(queries.select(F.col("q_id").alias("id"), F.col("q_user").alias("user"), "v"), c.shape[1]).select(F.col("id").alias("q_id"), F.col("user").alias("q_user"), "v")

        def probe(frames):
            for pdf in frames:
                if len(pdf):
                    s = np.stack(pdf["v"].to_numpy()).astype(float) @ c.T
                    at = np.argsort(-s, axis=1, kind="stable")[:, :probes]
                    yield pdf.loc[pdf.index.repeat(probes)].assign(list=at.ravel().astype("int32"))

        asked = q.mapInPandas(probe, "q_id long, q_user long, v array<float>, list int")
        codes = self.live("codes", CODES)
        # a list is dealt in blocks of codes, each of which meets blocks of the list's queries
        sizes = codes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / similarity.BLOCK).cast("int").alias("_b"))
        sizes = sizes.join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / similarity.BLOCK).cast("int").alias("_q")), "list")
        sizes = F.broadcast(sizes)  # a row a list: no more than the centres, which every task holds
        left = asked.join(sizes, "list").withColumn("_q", F.pmod(F.xxhash64("q_id"), "_q").cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
        right = codes.join(sizes, "list").withColumn("_b", F.pmod(F.xxhash64("id"), "_b").cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_q") - 1)))
        want = wider * k

        def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            empty = pd.DataFrame({"q_id": [], "q_user": [], "id": [], "near": [], "_met": []})
            if not len(a) or not len(b):
                return empty
            qs = np.stack(a["v"].to_numpy()).astype(np.float32)
            code = np.frombuffer(b"".join(b["code"]), dtype=np.int8).reshape(len(b), -1).astype(np.float32)
            s = (qs @ c[key[0]].astype(np.float32))[:, None] + (qs @ code.T) * b["scale"].to_numpy()[None]
            ids, users = b["id"].to_numpy(), b["user"].to_numpy()
            bad = ids[None] == a["q_id"].to_numpy()[:, None]
            if other_users:
                bad |= users[None] == a["q_user"].to_numpy()[:, None]
            s[bad] = -np.inf
            top = np.argpartition(-s, want - 1, axis=1)[:, :want] if len(b) > want else np.broadcast_to(np.arange(len(b)), s.shape)
            row = np.repeat(np.arange(len(a)), top.shape[1])
            at, score = top.ravel(), s[row, top.ravel()]
            keep = score > -np.inf
            row, at = row[keep], at[keep]
            # the work of a query is counted once a block, with its first candidate
            first = np.r_[True, row[1:] != row[:-1]] if len(row) else row
            return pd.DataFrame({"q_id": a["q_id"].to_numpy()[row], "q_user": a["q_user"].to_numpy()[row], "id": ids[at], "near": score[keep].astype(float), "_met": np.where(first, len(b), 0)})

        near = left.groupBy("list", "_q", "_b").cogroup(right.groupBy("list", "_q", "_b")).applyInPandas(meet, "q_id long, q_user long, id long, near double, _met long")
        by = Window.partitionBy("q_id", "q_user")
        near = near.withColumn("met", F.sum("_met").over(by)).withColumn("_n", F.row_number().over(by.orderBy(F.desc("near"), "id"))).where(F.col("_n") <= want)
        vectors = self.live("vectors", VECTORS).select("id", F.col("user").alias("c_user"), F.col("v").alias("w"))
        judged = near.select("q_id", "q_user", "id", "met").join(vectors, "id").join(q, ["q_id", "q_user"])
        score = F.aggregate(F.zip_with("v", "w", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        judged = judged.select("q_id", "q_user", F.col("id").alias("c_id"), "c_user", score.alias("score"), "met")
        out = judged.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "c_id"))).where(F.col("rank") <= k)
        return out.select("q_id", "q_user", "rank", "c_id", "c_user", "score", *(["met"] if with_work else []))

    # -- changing

    def added(self, versions: Versions, vectors: DataFrame, segment: int) -> VectorIndex:
        """The index with ``vectors`` (id, user, v; an id once) as segment ``segment``: written, not
        yet published.  ``tables`` of the result is what to publish."""
        new = usable(vectors, self.centres.shape[1]).withColumn("_segment", F.lit(segment))
        path = versions.stage("vectors", new)
        new = Snapshot(self.spark, tables={"v": [path]}).table("v", VECTORS)
        codes = versions.stage("codes", self._coded(new))
        old = self.live("vectors", VECTORS).select("id", "_segment").join(new.select("id"), "id", "left_semi")
        gone = versions.stage("gone", old)
        tables = self.tables | {"vectors": [*self.tables["vectors"], path], "codes": [*self.tables["codes"], codes], "gone": [*self.tables["gone"], gone]}
        return VectorIndex(self.spark, self.centres, self.probes, tables)

    @staticmethod
    def insert(versions: Versions, vectors: DataFrame, commit: tuple[str, int] | None = None) -> VectorIndex:
        """Insert or replace ``vectors`` (id, user, v) and publish; a ``commit`` (writer, batch) that
        was published before is not made again."""

        def change(base: Snapshot) -> dict | None:
            if commit and base.commits.get(commit[0], -1) >= commit[1]:
                return None
            segment = base.meta["segments"]
            return {"tables": VectorIndex.open(base).added(versions, vectors, segment).tables, "commit": commit, "meta": {"segments": segment + 1}}

        return VectorIndex.open(versions.update(change))

    @staticmethod
    def compact(versions: Versions) -> VectorIndex:
        """One segment in place of all, without the replaced rows; results stay as they are."""

        def change(base: Snapshot) -> dict:
            index = VectorIndex.open(base)
            zero = F.lit(0).alias("_segment")
            codes = index.live("codes", CODES).drop("_segment").select("*", zero).repartition("list").sortWithinPartitions("list")
            vectors = index.live("vectors", VECTORS).drop("_segment").select("*", zero)
            return {"tables": {"codes": [versions.stage("codes", codes)], "vectors": [versions.stage("vectors", vectors)], "gone": []}}

        return VectorIndex.open(versions.update(change))


def _probes(unit: DataFrame, rows: int, centres: np.ndarray, recall: float, k: int, sample: int = 200) -> int:
    """The fewest lists that hold ``recall`` of the ``k`` nearest of a sample of the vectors."""
    if rows < 2:
        return 1
    v = unit.select("id", "user", F.col("v").cast("array<double>").alias("v"))
    some = v.orderBy(F.xxhash64("id"), "id").limit(sample)
    q = some.select(F.col("id").alias("q_id"), F.col("user").alias("q_user"), "v")
    best = similarity.nearest(q, v.select(F.col("id").alias("c_id"), F.col("user").alias("c_user"), "v"), k)
    pairs = best.select("q_id", "c_id").join(q.select("q_id", "v"), "q_id").join(v.select(F.col("id").alias("c_id"), F.col("v").alias("w")), "c_id").select("v", "w").toPandas()  # sample * k rows
    if not len(pairs):
        return 1
    s = np.stack(pairs["v"].to_numpy()) @ centres.T
    own = (np.stack(pairs["w"].to_numpy()) @ centres.T).argmax(1)
    place = (s > s[np.arange(len(s)), own][:, None]).sum(1)  # lists before the neighbour's own
    return int(np.sort(place)[int(np.ceil(recall * len(place))) - 1]) + 1
