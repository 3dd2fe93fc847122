"""A Merkle manifest of a table: append logs in postorder, one for each language and one above.

The nodes of a tree are written to its log as they complete: a leaf when it is appended, an
inner node right after its last child.  Leaf ``i`` therefore stands at ``i`` plus the number of
inner nodes complete before it, and the node of a level at its last leaf's place plus its level;
positions need no pointer and no index.

A builder takes an aligned run of ``fan_out ** levels`` nodes of one tree and writes their whole
subtree.  The roots of the runs are the next tier's nodes, so each tier has a few thousandths of
the rows of the one below, until a tree is one node.  Proofs go the other way: a run's siblings
are addressed in its own log, and what stands above the run comes down with the run's root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def node_digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def leaf_place(i: int, fan_out: int) -> int:
    """Where leaf ``i`` of a log stands."""
    at, whole = i, i // fan_out
    while whole:
        at += whole
        whole //= fan_out
    return at


def node_place(level: int, j: int, leaves: int, fan_out: int) -> int:
    """Where node ``j`` of a level stands in the log of a tree of ``leaves`` leaves."""
    return leaf_place(min((j + 1) * fan_out**level, leaves) - 1, fan_out) + level


def append_log(leaves: list[str], fan_out: int, height: int) -> list[str]:
    """The postorder log of a tree of ``height`` levels above its leaves."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(height)]

    def close(level: int) -> None:
        digest = node_digest(open_[level])
        open_[level] = []
        log.append(digest)
        if level + 1 < height:
            open_[level + 1].append(digest)

    for leaf in leaves:
        log.append(leaf)
        if height:
            open_[0].append(leaf)
        level = 0
        while level < height and len(open_[level]) == fan_out:
            close(level)
            level += 1
    for level in range(height):
        if open_[level]:
            close(level)
    return log


def siblings(log: list[str], i: int, leaves: int, fan_out: int, height: int) -> list[list[str]]:
    """For each level, the other nodes of the run of leaf ``i``'s ancestor, left and right apart."""
    out = []
    n = leaves
    for level in range(height):
        first = i - i % fan_out
        run = range(first, min(first + fan_out, n))
        digest = [log[node_place(level, j, leaves, fan_out)] for j in run]
        out.append([digest[: i - first], digest[i - first + 1 :]])
        i, n = i // fan_out, -(-n // fan_out)
    return out


def fold(leaf: str, proof: list[list[str]]) -> str:
    """The root that ``leaf`` leads to with the siblings of a proof."""
    for left, right in proof:
        leaf = node_digest([*left, leaf, *right])
    return leaf


def height_of(n: int, fan_out: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // fan_out), h + 1
    return h


_PROOF = "array<array<array<string>>>"
_PROOF_ARROW = pa.list_(pa.list_(pa.list_(pa.string())))


class Forest:
    """Trees over ``nodes`` (tree, i, n, digest): node ``i`` of ``n`` of its tree.

    ``logs`` holds a written table a tier, (tree, run, runs, leaves, height, log); ``roots`` is
    (tree, digest).
    """

    def __init__(self, nodes: DataFrame, fan_out: int, levels: int) -> None:
        self.fan_out, self.levels, self.span = fan_out, levels, fan_out**levels
        self.logs: list[DataFrame] = []
        while True:
            log = written(self._built(nodes))
            self.logs.append(log)
            if log.where("runs > 1").isEmpty():
                break
            nodes = log.select("tree", F.col("run").alias("i"), F.col("runs").alias("n"), F.element_at("log", -1).alias("digest"))
        self.roots = self.logs[-1].select("tree", F.element_at("log", -1).alias("digest"))

    def _built(self, nodes: DataFrame) -> DataFrame:
        span, fan_out, levels = self.span, self.fan_out, self.levels

        def close(tree: str, r: int, n: int, held: list[str]) -> pa.RecordBatch:
            # a tree of one run is as high as its nodes need, a run of a larger tree as high as all
            height = levels if n > span else height_of(n, fan_out)
            cols = [pa.array([tree], pa.string()), *(pa.array([x], pa.int64()) for x in (r, -(-n // span), len(held), height))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([append_log(held, fan_out, height)], pa.list_(pa.string()))], names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = None, []
            for b in batches:
                for tree, r, n, digest in zip(*(c.to_pylist() for c in b.columns)):
                    if (tree, r, n) != key:
                        if key is not None:
                            yield close(*key, held)
                        key, held = (tree, r, n), []
                    held.append(digest)
            if key is not None:
                yield close(*key, held)

        names = ["tree", "run", "runs", "leaves", "height", "log"]
        rows = nodes.select("tree", F.expr(f"i div {span}").alias("run"), "i", "n", "digest").repartition("tree", "run").sortWithinPartitions("tree", "run", "i")
        return rows.select("tree", "run", "n", "digest").mapInArrow(run, "tree string, run long, runs long, leaves long, height long, log array<string>")

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """The lowest logs with ``above``, the siblings over each run: from the tier over it to
        the tree's root, and then those of ``above`` (tree, proof)."""
        rows = self.logs[-1]
        rows = rows.withColumn("above", F.array().cast(_PROOF)) if above is None else rows.join(above.withColumnRenamed("proof", "above"), "tree")
        for log in reversed(self.logs[:-1]):
            down = self.paths(rows).select("tree", F.col("i").alias("run"), F.col("proof").alias("above"))
            rows = log.join(down, ["tree", "run"])
        return rows

    def paths(self, rows: DataFrame) -> DataFrame:
        """(tree, i, proof) for each lowest node of the logs of :meth:`proofs`."""
        span, fan_out = self.span, self.fan_out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for tree, r, leaves, height, log, above in zip(*(c.to_pylist() for c in b.columns)):
                    made = [siblings(log, i, leaves, fan_out, height) + above for i in range(leaves)]
                    cols = [pa.array([tree] * leaves, pa.string()), pa.array(range(r * span, r * span + leaves), pa.int64()), pa.array(made, _PROOF_ARROW)]
                    yield pa.RecordBatch.from_arrays(cols, ["tree", "i", "proof"])

        return rows.select("tree", "run", "leaves", "height", "log", "above").mapInArrow(run, f"tree string, i long, proof {_PROOF}")


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def _leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[_field(F.col(f"`{n}`")) for n in ("doc_id", "source", "lang", "n_chars")], _field(text)), 256)


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows``, a written table, with _i, the gapless place in its tree by ``order``, and _n, the tree's rows.

    The rows are dealt by ranges of (tree, order, place in the table), so that neither a large
    tree nor a row with many repeats comes to one task; the counts of the parts say where each
    starts.
    """
    by = [tree, *order, "_tie"]
    dealt = written(rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(tree).orderBy("_part")  # a row for each part of the tree
    starts = counts.select(
        tree, "_part", (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(tree)).alias("_n")
    )
    place = Window.partitionBy(tree, "_part").orderBy(*order, "_tie")
    ranked = dealt.withColumn("_place", F.row_number().over(place)).join(starts, [tree, "_part"])
    return ranked.withColumn("_i", (F.col("_before") + F.col("_place") - 1).cast("long")).drop("_part", "_place", "_before", "_tie")


def manifest(docs: DataFrame, fan_out: int = 8, levels: int = 4, tampered_every: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``.

    A row's leaf is the digest of its doc_id, source, lang, n_chars and text.  The leaves of a
    language form a tree, and the subroots, in the order of the languages, one above.  Every row
    is proved: its leaf is folded with its siblings to a root.  Where ``tampered_every`` divides
    the crc32 of doc_id, the leaf is taken from the text with A-Z lower-cased, and so the proof
    fails unless the text has no such letter.

    Null fields are told from empty ones.  A null lang is a language of its own, the first; a null
    doc_id comes first in its language and is never tampered with; rows of equal doc_id follow
    their leaves, repeated rows come one after the other, each with its own place and proof.  Very
    long texts are hashed whole; other columns are not read; an empty table gives no rows.
    """
    if fan_out < 2 or levels < 1:
        raise ValueError("fan_out must be 2 or more and levels positive")
    rows = columns(docs, "doc_id", "source", "lang", "n_chars", "text")
    touched = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % tampered_every == 0
    # a tree's name: languages in bytewise order, null before all
    tree = F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit(""))
    lowered = F.when(touched, _leaf(F.translate("text", _UPPER, _LOWER)))
    leaves = written(rows.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), _leaf(F.col("text")).alias("leaf"), lowered.alias("changed")))
    placed = numbered(leaves, "tree", ["doc_id", "leaf"])
    forest = Forest(placed.select("tree", F.col("_i").alias("i"), F.col("_n").alias("n"), F.col("leaf").alias("digest")), fan_out, levels)
    subroots = numbered(forest.roots.withColumn("all", F.lit("")), "all", ["tree"])
    over = Forest(subroots.select(F.lit("").alias("tree"), F.col("_i").alias("i"), F.col("_n").alias("n"), "digest"), fan_out, levels)
    # from the root down: the proof of every subroot, then of every run, then of every row
    root = F.broadcast(over.roots.select(F.lit("").alias("all"), F.col("digest").alias("root")))  # one row
    named = subroots.join(root, "all").select(F.col("_i").alias("i"), "tree", F.col("digest").alias("subroot"), "root")
    above = written(over.paths(over.proofs()).select("i", "proof").join(named, "i").drop("i"))
    runs = forest.proofs(above.select("tree", "proof")).join(above.drop("proof"), "tree")
    ours = placed.select("tree", F.expr(f"_i div {forest.span}").alias("run"), "_i", "doc_id", "leaf", "changed")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return ours.groupBy("tree", "run").cogroup(runs.groupBy("tree", "run")).applyInArrow(_proving(fan_out, forest.span), schema)


def _proving(fan_out: int, span: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The proofs of a run's rows, ``span`` at most, from its log."""

    def run(rows: pa.Table, logs: pa.Table) -> pa.Table:
        r = logs.to_pylist()[0]
        rest = "".join(d for left, right in r["above"] for d in (*left, *right))
        proof, folded = [], []
        for i, leaf, changed in zip(*(rows.column(c).to_pylist() for c in ("_i", "leaf", "changed"))):
            near = siblings(r["log"], i % span, r["leaves"], fan_out, r["height"])
            proof.append(node_digest([*(d for left, right in near for d in (*left, *right)), rest]))
            folded.append(fold(leaf if changed is None else changed, near + r["above"]))
        n = len(folded)
        return pa.table({
            "doc_id": rows.column("doc_id"), "leaf": rows.column("leaf"), "subroot": pa.array([r["subroot"]] * n, pa.string()), "root": pa.array([r["root"]] * n, pa.string()),
            "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == r["root"] for f in folded], pa.bool_()),
        })

    return run


def oracle(depth: int = 8) -> str:
    """DuckDB SQL with the rows of :func:`manifest` over ``documents``: trees of ``8 ** depth`` leaves
    at most.  A level of a tree that is one node already stays as it is."""

    def field(c: str) -> str:
        return f"coalesce(cast(octet_length(encode(cast({c} as varchar))) as varchar) || ':' || cast({c} as varchar), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    table = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))"
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)), lambda s, c: xor(s >> 8, t.codes[(xor(s, c) & 255) + 1])), 4294967295)"
    parts = [
        f"t as (select {table} as codes)",
        f"l as (select doc_id, coalesce('l' || lang, '') as tree, {leaf('text')} as leaf, case when doc_id is not null and {crc} % 3 = 0 then {leaf(f'translate(text, {_UPPER!r}, {_LOWER!r})')} end as changed from documents, t)",
        "p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i from l)",
        "a0 as (select tree, i, count(*) over (partition by tree) as n, leaf as d from p)",
    ]

    def climb(name: str) -> None:
        for k in range(depth):
            parts.append(f"{name}r{k} as (select tree, i // 8 as i, any_value(n) as n, list(d order by i) as r from {name}{k} group by all)".replace("group by all", "group by tree, i // 8"))
            parts.append(f"{name}{k + 1} as (select tree, i, (n + 7) // 8 as n, case when n > 1 then sha256(array_to_string(r, '')) else r[1] end as d from {name}r{k})")

    climb("a")
    parts.append(f"b0 as (select '' as tree, row_number() over (order by tree) - 1 as i, count(*) over () as n, d, tree as lang_tree from a{depth})")
    climb("b")
    parts.append("f0 as (select p.*, coalesce(changed, leaf) as f, '' as proof, i as j from p)")

    def descend(name: str, start: int) -> None:
        for k in range(depth):
            left, right = "array_to_string(r[1:j % 8], '')", "array_to_string(r[j % 8 + 2:], '')"
            parts.append(
                f"f{start + k + 1} as (select f{start + k}.* replace (case when n > 1 then sha256({left} || f || {right}) else f end as f, case when n > 1 then proof || {left} || {right} else proof end as proof, j // 8 as j) "
                f"from f{start + k} join {name}r{k} on {name}r{k}.tree = f{start + k}.{'tree' if name == 'a' else 'top'} and {name}r{k}.i = j // 8)"
            )

    descend("a", 0)
    parts.append(f"f{depth + 1} as (select f{depth}.* replace (b0.i as j), b0.d as subroot, '' as top from f{depth} join b0 on b0.lang_tree = f{depth}.tree)")
    descend("b", depth + 1)
    return "with " + ", ".join(parts) + (
        f" select doc_id, leaf, subroot, b{depth}.d as root, sha256(proof) as proof_sha256, f as folded_root, f = b{depth}.d as verified from f{2 * depth + 1}, b{depth}"
    )
