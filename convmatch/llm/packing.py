"""Best-fit packing of token sequences into bins with several capacities."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, in_arrow, written

_encodings: dict[str, object] = {}
#: Weights of the residual tokens, documents and attention cost in the choice of a bin, each a
#: share of its capacity.
WEIGHTS = (1.0, 1.0, 1.0)


def _encoding(ranks_file: str):
    """A byte-level BPE encoder, built once in each worker.

    The ranks file holds the same vocabulary as the tokenizer's JSON file and gives the same
    ids, several times faster.  The marker text of the JSON file's one special token is
    encoded as that token, as the JSON tokenizer does.
    """
    if ranks_file not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[ranks_file] = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)}
        )
    return _encodings[ranks_file]


def token_pieces(docs: DataFrame, ranks_file: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, with_places: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32 (and ids;
    and :func:`numbered` in the same pass, so that a task has one worker).

    A document is its text's ids and ``end_id``.  Only longer documents are cut: the first
    piece takes the remainder, all others are full, so just one piece needs company.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks_file).encode_to_numpy
        for batch in batches:
            doc, piece, start, length, crc, kept = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text or "", allowed_special="all"), end_id).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    doc.append(doc_id)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        kept.append(ids[a:b].astype(np.int32))
            cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32())] + [pa.array(x, pa.int64()) for x in (start, length, crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    rows = columns(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text")
    if with_places:
        return in_arrow(rows, lambda batches: _with_places(run(batches)), schema + _PLACES)
    return in_arrow(rows, run, schema)


#: What numbering adds to a schema.
_PLACES = ", _task int, _place long"


def _with_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add _task and _place (see :func:`numbered`) to a task's pieces."""
    seen: dict[int, int] = {}
    task = TaskContext.get().partitionId()
    for batch in batches:
        length, which, n = np.unique(batch.column(batch.schema.names.index("length")).to_numpy(), return_inverse=True, return_counts=True)
        place = np.empty(batch.num_rows, dtype=np.int64)
        place[np.argsort(which, kind="stable")] = np.arange(batch.num_rows) - np.repeat(np.cumsum(n) - n, n)
        place += np.array([seen.get(x, 0) for x in length.tolist()], dtype=np.int64)[which]
        for x, c in zip(length.tolist(), n.tolist()):
            seen[x] = seen.get(x, 0) + c
        cols = [*batch.columns, pa.array(np.full(batch.num_rows, task, dtype=np.int32)), pa.array(place)]
        yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "_task", "_place"])


def plan_bins(
    counts: dict[int, int],
    capacity: int,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    choose: str = "norm",
) -> list[tuple[int, int, int, int, int, int]]:
    """Vector best-fit decreasing over a histogram of lengths.

    A bin has residual tokens, documents and attention cost (sum of squared lengths); a limit
    of None is not counted.  Items come longest first.  Among the open bins with room under
    every limit, ``choose="norm"`` takes the one whose weighted residual after placing has
    the least norm, ``"dot"`` the one whose weighted dot product of demand and residual is
    largest; if none has room a bin is opened.  Bins in the same state are handled together
    as runs of bin numbers, so the work depends on the number of distinct lengths and not on
    the number of items.

    Returns runs (length, first rank, items, first bin, items per bin, offset in the bin):
    the items of that length with these ranks fill consecutive bins.
    """
    if choose not in ("norm", "dot"):
        raise ValueError("choose must be 'norm' or 'dot'")
    full = [capacity, max_docs, max_attention]
    used = [i for i, x in enumerate(full) if x is not None]
    size = np.array([full[i] for i in used], dtype=float)
    w = np.array([weights[i] for i in used], dtype=float)
    groups: dict[tuple[int, ...], list[list[int]]] = {}  # residual -> runs [first bin, bins, offset]
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = tuple((length, 1, length * length)[i] for i in used)
        if any(a > full[i] for a, i in zip(need, used)):
            raise ValueError(f"an item of {length} tokens fits no bin")
        demand = np.array(need) / size

        def most(state: tuple[int, ...]) -> int:
            return min(r // n for r, n in zip(state, need))

        def put(state: tuple[int, ...], run: list[int], per_bin: int) -> None:
            """Place ``per_bin`` items into each bin of the run, which leaves the pool."""
            nonlocal left, rank
            first, n, offset = run
            whole = min(n, left // per_bin)
            rest = left - whole * per_bin if whole < n else 0
            for start, k, m in ((first, whole, per_bin), (first + whole, 1 if 0 < rest < per_bin else 0, rest)):
                if k:
                    runs.append((length, rank, k * m, start, m, offset))
                    rank += k * m
                    left -= k * m
                    after = tuple(r - m * x for r, x in zip(state, need))
                    groups.setdefault(after, []).append([start, k, offset + m * length])
                    first, n = start + k, n - k
            if n:
                groups.setdefault(state, []).append([first, n, offset])

        while left:
            states = list(groups)
            open_bins = np.array(states, dtype=float).reshape(-1, len(used))
            fits = np.flatnonzero((open_bins >= need).all(1))
            if not len(fits):
                break
            states = [states[i] for i in fits]
            residual = open_bins[fits] / size
            score = (w * (residual - demand) ** 2).sum(1) if choose == "norm" else -(w * residual * demand).sum(1)
            if choose == "norm":
                # a bin that has just taken an item is the best for the next one
                order = np.argsort(score, kind="stable")
            else:
                order = np.argsort(score, kind="stable")[:1]
            for i in order:
                state = states[i]
                per_bin = most(state) if choose == "norm" else 1
                pool = groups.pop(state)
                while pool and left:
                    put(state, pool.pop(), per_bin)
                if pool:
                    groups.setdefault(state, []).extend(pool)
                if not left:
                    break
        if left:
            fresh = tuple(full[i] for i in used)
            per_bin = most(fresh)
            need_bins = -(-left // per_bin)
            put(fresh, [bins, need_bins, 0], per_bin)
            bins += need_bins
        groups = {s: r for s, r in groups.items() if r}
    return runs


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``_task`` and ``_place``, the rank among the task's pieces of that length.

    To be written before use, so that a repeated task cannot number anew.
    """
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]
    return in_arrow(pieces, _with_places, ", ".join(kinds) + _PLACES)


def pack_pieces(
    pieces: DataFrame,
    capacity: int = 2048,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    choose: str = "norm",
) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length, ...).

    Only the histogram of lengths (at most ``capacity`` rows) reaches the driver, which makes
    the plan of :func:`plan_bins`; every piece then finds its place from its rank among the
    pieces of its length: the number that its task gave it, after those of the tasks before.
    No row is sorted or dealt by length alone, so no task holds a whole length, whatever ids
    and lengths repeat.  The plan is broadcast: it has at most one row a length, with a run
    for each kind of bin that the length went into, and does not grow with the pieces.
    """
    spark, names = pieces.sparkSession, [n for n in pieces.columns if n not in ("_task", "_place")]
    rows = written(pieces if "_place" in pieces.columns else numbered(pieces))
    sizes = rows.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_length: dict[int, list[tuple]] = {}
    for length, rank, items, first, per_bin, offset in plan_bins(counts, capacity, max_docs, max_attention, weights, choose):
        by_length.setdefault(length, []).append((rank, rank + items, first, per_bin, offset))
    plan = spark.createDataFrame(
        list(by_length.items()),
        "length long, runs array<struct<lo: long, hi: long, first: long, per_bin: long, at: long>>",
    )
    r = F.col("_rank")
    run = F.filter("runs", lambda x: (x["lo"] <= r) & (r < x["hi"]))[0]
    return (
        rows.join(offsets, ["length", "_task"])
        .withColumn("_rank", F.col("_before") + F.col("_place"))
        .join(F.broadcast(plan), "length")
        .withColumn("_run", run)
        .select(
            *[F.col(c) for c in names],
            (F.col("_run.first") + F.floor((r - F.col("_run.lo")) / F.col("_run.per_bin"))).cast("long").alias("sequence_id"),
            (F.col("_run.at") + F.pmod(r - F.col("_run.lo"), F.col("_run.per_bin")) * F.col("length")).cast("long").alias("offset"),
        )
    )


def pack_documents(
    docs: DataFrame,
    ranks_file: str,
    capacity: int = 2048,
    end_id: int = 0,
    with_ids: bool = False,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    choose: str = "norm",
) -> DataFrame:
    """Tokenize and pack ``docs``: one row for each piece.

    A sequence holds ``capacity`` tokens, ``max_docs`` pieces (default: ``capacity``) and an
    attention cost, the sum of squared lengths, of ``max_attention`` (default: ``capacity``
    squared).  The defaults are what tokens alone allow, so they make no more sequences, but
    all three residuals choose the bin.

    Null text counts as empty (its one token is ``end_id``); repeated rows are packed once
    each, null doc_ids too; documents longer than ``capacity``, however long, are cut; an empty table gives no
    rows; other columns are not read.  The pieces are written once, so texts are tokenized once.
    """
    limits = (max_docs or capacity, max_attention or capacity * capacity)
    return pack_pieces(token_pieces(docs, ranks_file, capacity, end_id, with_ids, with_places=True), capacity, *limits, weights, choose)
