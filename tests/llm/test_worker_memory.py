"""What Python workers keep beside the memory of other stages."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from convmatch.llm import packing
from convmatch.llm.common import in_arrow, table
from convmatch.llm.queries import vocabulary


def idle_mb(spark):
    """MB of their own that the workers hold, by process; many short tasks go round all of them."""

    def look(batches):
        for _ in batches:
            pass
        import os

        own = sum(map(int, re.findall(r"\nPrivate_Dirty:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())))
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64()), pa.array([own / 1024])], ["pid", "mb"])

    rows = spark.range(0, 64, 1, 64).mapInArrow(look, "pid long, mb double").collect()
    return {r["pid"]: r["mb"] for r in rows}


def test_workers_give_back_what_a_task_has_freed(spark):
    def fill(batches):
        import convmatch.llm.common as kept

        for b in batches:
            # between what the task frees lies little that outlives it, as an encoder does
            blocks = []
            for _ in range(2_000):
                blocks.append(np.ones(8_000))
                kept.__dict__.setdefault("_of_this_test", []).append(np.ones(200))
            del blocks
            yield b

    def held(use):
        use(spark.range(0, 8, 1, 8)).write.format("noop").mode("overwrite").save()
        return max(idle_mb(spark).values())

    kept = held(lambda df: df.mapInArrow(fill, "id long"))
    given = held(lambda df: in_arrow(df, fill, "id long"))
    assert given < 100 < kept


def test_stages_run_one_worker_a_task(spark, sf, monkeypatch):
    plans = []

    def seen(df, write=packing.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(packing, "written", seen)
    docs = table(spark, sf, "documents")
    packing.pack_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), 2048, 0, max_docs=256)
    assert [len(re.findall(r"MapInArrow\b", p.split("== Initial Plan ==")[0])) for p in plans] == [1]


def test_places_of_pieces_as_before(spark, sf):
    docs = table(spark, sf, "documents").repartition(3, "doc_id")
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    one = packing.token_pieces(docs, ranks, with_places=True)
    two = packing.numbered(packing.token_pieces(docs, ranks))
    assert one.columns == two.columns and one.dtypes == two.dtypes
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    ranked = one.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_place").alias("d"), F.max("_place").alias("m"))
    assert ranked.where("n <> d or m <> n - 1").isEmpty()
