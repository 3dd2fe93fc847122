"""Exact near-duplicate join on word n-grams: a size-aware heavy-light Jaccard join.

A document's set holds the 64-bit hashes of its distinct shingles.  Sets are met by size:

* Small sets (up to ``small`` shingles) enumerate their subsets: two sets whose Jaccard
  similarity reaches the threshold t share a subset of each size from ceil(t * larger) up to
  their overlap, so each set lists its subsets of sizes ceil(t * n) to n.
* Large sets scan inverted lists: each lists its first n - ceil(t * n) + 1 shingles in one
  order for all sets, and similar sets have a shingle in common there.

The boundary is chosen by cost in each run (``subset_boundary``): the numbers of sets by size
and the share of list entries that meet others are counted first, over all documents.  Sets
near the boundary do both, so that a pair across it meets in the lists.

The order of shingles is light before heavy, then by hash.  Heavy are the shingles found in
most documents, at most ``max_heavy`` of them; so a phrase that many documents share seldom
leads a list.  All documents are counted: every shingle near the front of the hash order, and
of the others those that one batch of rows holds twice.  Any order gives the same result.

Equal sets are one set.  Within a list, not all pairs are made.  First each set meets the
list's centre, the set with the least share of light shingles (what most copies have in
common); what links joins one component.  Then only sets of different components meet:
all such pairs of a short list, and in a long list the sets that did not join the centre's
component against the rest.  A pair that both rounds leave out is in one component already.
A list's shingle stands at some place of each set's order; if it is a pair's first common
shingle, the overlap is at most what either set has from there on, and where that is too
little the pair does not meet in this list.  So edited copies, whose own light shingles come
first, do not meet in the lists of the passage they were copied from.
Before texts are read, a pair must pass an exact lower bound of its sets' difference (counts
of shingles by hash class), and only pairs that pass are counted shingle by shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, components, discard, in_arrow, key_doc_id, row_key, sifted, written
from .substring_dedup import zipped
from .wordhash import batches_of_texts, mix, text_word_hashes, window_hashes, word_hashes

_CLASSES = 64
#: Sizes from here on are counted as one: their subsets are never listed.
_MANY = 64
#: Pairs of one set that are compared in one task, about.
_PAIRS = 512


def overlap_needed(a: int, b: int, percent: int) -> int:
    """Least overlap of sets of sizes a and b at which 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def least_subset(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def subsets(n: int, percent: int) -> int:
    return sum(math.comb(n, c) for c in range(least_subset(n, percent), n + 1))


def subset_boundary(sizes: dict[int, int], met: float, percent: int, most: int = 4096) -> int:
    """The boundary of least cost, for ``sizes[n]`` sets of size n.

    A subset costs one key.  An entry of an inverted list costs one row, and four more with
    the share ``met`` that the list holds others (it is written again, looks up its centre and
    is compared).  Sets with more than ``most`` subsets always use the lists.
    """
    best, least, s = 0, None, 0
    while s == 0 or subsets(s, percent) <= most:
        from_lists = least_subset(s + 1, percent)
        cost = sum(c * subsets(n, percent) for n, c in sizes.items() if 0 < n <= s)
        cost += sum(c * _prefix(n, percent) * (1 + 4 * met) for n, c in sizes.items() if n >= from_lists)
        if least is None or cost < least:
            best, least = s, cost
        s += 1
    return best


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of a text's word hashes; of fewer words, the whole sequence."""
    if len(words) == 0:
        return np.empty(0, dtype=np.uint64)
    return np.unique(window_hashes(words, min(k, len(words))))


def _set_key(s: np.ndarray) -> int:
    """A 64-bit hash of a set; sizes are compared beside it."""
    if len(s) == 0:
        return 0
    with np.errstate(over="ignore"):
        x = np.array([(mix(s)).sum(dtype=np.uint64) + (mix(s * np.uint64(3)) >> np.uint64(1)).sum(dtype=np.uint64) * np.uint64(31) + np.uint64(len(s))])
        return int(mix(x).view(np.int64)[0])


def _light_first(s: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The set in the join's order; ``heavy`` holds sorted 32-bit tokens."""
    h = _is_heavy(s, heavy)
    return np.concatenate([s[~h], s[h]]) if h.any() else s


def _is_heavy(s: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if len(heavy) == 0:
        return np.zeros(len(s), dtype=bool)
    tok = _token(s)
    return heavy[np.searchsorted(heavy, tok).clip(0, len(heavy) - 1)] == tok


def _token(s: np.ndarray) -> np.ndarray:
    return (mix(s) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _prefix(n: int, percent: int) -> int:
    return n - least_subset(n, percent) + 1


def _sets(batch: pa.RecordBatch, column: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for lo, hi, buf, offsets in batches_of_texts(batch.column(column)):
        h, at = text_word_hashes(buf, offsets, lower=True)
        for i in range(hi - lo):
            yield lo + i, shingle_set(h[at[i] : at[i + 1]], k)


def ngram_links(docs: DataFrame, k: int = 4, percent: int = 85, short: int = 24, max_heavy: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(members, links): members are doc_id, n_shingles, _set, _n for every row; links are
    pairs (a, b) of doc_ids that connect every component of similar documents."""
    spark = docs.sparkSession
    base = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), "text")

    def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often shingles (size -1: all but the rarest, -2: the listed ones) and sizes occur."""
        for b in batches:
            first, rest, sizes = [], [], []
            for _, s in _sets(b, 0, k):
                if len(s):
                    sizes.append(min(len(s), _MANY))
                    cut = max(1, int(_prefix(len(s), percent) * 1.25))
                    first.append(_token(s[:cut]))
                    rest.append(_token(s[cut:]))
            for toks, least in ((first, 1), (rest, 2)):
                if toks:
                    tok, n = np.unique(np.concatenate(toks), return_counts=True)
                    tok, n = tok[n >= least], n[n >= least]
                    yield pa.RecordBatch.from_arrays([pa.array(tok), pa.array(np.full(len(tok), -1, dtype=np.int32)), pa.array(n)], ["_t", "_size", "_c"])
            if sizes:
                size, n = np.unique(np.append(sizes, -2), return_counts=True)
                n[0] = sum(map(len, first))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(size), dtype=np.int32)), pa.array(size.astype(np.int32)), pa.array(n)], ["_t", "_size", "_c"])

    counted = in_arrow(base.select("text"), count_rows, "_t int, _size int, _c long").groupBy("_t", "_size").agg(F.sum("_c").alias("_c"))
    counted = written(counted.where("_size <> -1 or _c > 1"))
    sizes = {r["_size"]: r["_c"] for r in counted.where("_size <> -1").collect()}  # one row a size up to _MANY
    entries = sizes.pop(-2, 0)
    shared = counted.where("_size = -1").agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    small = subset_boundary(sizes, min(1.0, shared / max(1, entries)), percent)
    # a large set can be similar to sets down to this size, which scan the lists as well
    least_listed = least_subset(small + 1, percent)
    top = counted.where((F.col("_size") == -1) & (F.col("_c") > short)).orderBy(F.desc("_c"), "_t").limit(max_heavy).select("_t").toArrow().column(0)
    heavy = spark.sparkContext.broadcast(np.sort(top.to_numpy()).astype(np.int32))  # 4 bytes * max_heavy at most
    discard(counted)

    def listed_tokens(s: np.ndarray, heavy: np.ndarray) -> np.ndarray:
        return _token(_light_first(s, heavy)[: _prefix(len(s), percent)])

    def posting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hv = heavy.value
        for b in batches:
            ids, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
            rows, sets = [], []
            for i, s in _sets(b, 2, k):
                n, key = len(s), _set_key(s)
                # listed shingles come first, so that their index is their place in the order
                parts = [listed_tokens(s, hv)] if n >= least_listed else []
                if 0 < n <= small:
                    keys = []
                    for c in range(least_subset(n, percent), n + 1):
                        for sub in combinations(s.tolist(), c):
                            x = sum(sub) + 0x9E3779B97F4A7C15 * c
                            keys.append(mix(np.array([x & (2**64 - 1)], dtype=np.uint64)))
                    parts.append(_token(np.concatenate(keys)))
                light = n - int(_is_heavy(s, hv).sum())
                rank = (int(1000 * light / max(1, n)) << 53) | ((key >> 11) & (2**53 - 1))
                sketch = np.bincount((s & np.uint64(_CLASSES - 1)).astype(np.int64), minlength=_CLASSES).clip(0, 255).astype(np.uint8).tobytes()
                rows.append((ids[i], ths[i], n, key, sketch, rank))
                t = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
                sets.append(t)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                        pa.array([r[4] for r in rows], pa.binary()), pa.array([r[5] for r in rows], pa.int64()),
                        pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(t) for t in sets])].astype(np.int32), np.concatenate(sets)),
                    ],
                    ["_id", "_th", "_n", "_set", "_sketch", "_rank", "_tokens"],
                )

    schema = "_id long, _th long, _n long, _set long, _sketch binary, _rank long, _tokens array<int>"
    rows = written(in_arrow(base.select("_id", "_th", "text"), posting_rows, schema))
    members = written(rows.select(key_doc_id().alias("doc_id"), "_n", "_set"))
    # one row for each distinct set: its least document stands for it
    sets = written(
        rows.where("_n > 0")
        .groupBy("_set", "_n")
        .agg(F.min(F.struct(key_doc_id().isNull().alias("void"), "_id", "_th")).alias("r"), F.min("_sketch").alias("_sketch"), F.min("_rank").alias("_rank"), F.count(F.lit(1)).alias("_rows"))
        .select("_set", "_n", "_sketch", "_rank", F.col("r._id").alias("_id"), F.col("r._th").alias("_th"), "_rows")
    )
    # a set of one row needs no choice, so its list of tokens is not dealt
    alone, copied = sifted(rows.where("_n > 0"), sets.where("_rows > 1"), ["_set", "_n"])
    postings = alone.unionByName(copied.join(sets.select("_set", "_n", "_id", "_th"), ["_set", "_n", "_id", "_th"], "left_semi"))
    postings = postings.select("_set", "_n", "_rank", F.posexplode("_tokens").alias("_at", "_t"))
    listed = F.when(F.col("_n") >= least_listed, F.col("_n") - F.ceil(percent * F.col("_n") / 100) + 1).otherwise(0)
    # what a set has from a shingle's place on: the most it can share with a set that it first meets there
    postings = postings.withColumn("_rest", F.when(F.col("_at") < listed, F.col("_n") - F.col("_at")).otherwise(F.col("_n"))).drop("_at")
    # the rank names the centre: a light share and 53 bits of the set's hash
    lists = postings.groupBy("_t").agg(F.count(F.lit(1)).alias("_c"), F.min("_rank").alias("_least"), F.max("_rank").alias("_most"))
    lists = lists.where("_c > 1 and _least <> _most").select("_t", "_c", "_least")
    centres = sets.select(F.col("_rank").alias("_least"), F.col("_set").alias("_centre")).dropDuplicates(["_least"])
    # one row a list, not one a posting, looks up its centre
    live = written(postings.select("_set", "_n", "_rest", "_t").join(lists.join(centres, "_least").drop("_least"), "_t"))
    discard(rows)

    sized = sets.select("_set", "_n", "_sketch")

    def pairs_of(a: str, b: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).where("_a <> _b").distinct()

    def difference_fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            x = np.frombuffer(b"".join(b.column(4).to_pylist()), dtype=np.uint8).reshape(-1, _CLASSES).astype(np.int16)
            y = np.frombuffer(b"".join(b.column(5).to_pylist()), dtype=np.uint8).reshape(-1, _CLASSES).astype(np.int16)
            n = b.column(2).to_numpy() + b.column(3).to_numpy()
            need = -(-percent * n // (100 + percent))
            fits = np.abs(x - y).sum(1) <= n - 2 * need
            yield b.filter(pa.array(fits)).select([0, 1])

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (_a, _b) of sets that are similar."""
        x = sized.select(F.col("_set").alias("_a"), F.col("_n").alias("_na"), F.col("_sketch").alias("_ka"))
        y = sized.select(F.col("_set").alias("_b"), F.col("_n").alias("_nb"), F.col("_sketch").alias("_kb"))
        near = pairs.join(x, "_a").join(y, "_b").where(F.least("_na", "_nb") * 100 >= F.greatest("_na", "_nb") * percent)
        near = in_arrow(near.select("_a", "_b", "_na", "_nb", "_ka", "_kb"), difference_fits, "_a long, _b long")
        near = written(near)
        # a pair meets at the set with more pairs, which is dealt to several tasks if these are many
        uses = near.select(F.explode(F.array("_a", "_b")).alias("_set")).groupBy("_set").agg(F.count(F.lit(1)).alias("_uses"))
        met = near.join(uses.withColumnsRenamed({"_set": "_a", "_uses": "_ua"}), "_a").join(uses.withColumnsRenamed({"_set": "_b", "_uses": "_ub"}), "_b")
        met = met.withColumn("_hub", F.expr("if(_ua >= _ub, _a, _b)")).withColumn("_set", F.expr("if(_ua >= _ub, _b, _a)"))
        parts = F.ceil(F.greatest("_ua", "_ub") / _PAIRS)
        met = met.select("_hub", F.pmod(F.xxhash64("_set"), parts).cast("int").alias("_part"), "_set")
        sent = met.withColumn("_first", F.lit(0)).unionByName(met.select("_hub", "_part", F.col("_hub").alias("_set"), F.lit(1).alias("_first")).distinct())
        sent = written(sent.join(sets.select("_set", "_id", "_th"), "_set"))
        # texts without a pair are not dealt; of rows that repeat a key one is read
        texts = zipped(sifted(base, sent, ["_id", "_th"])[1]).dropDuplicates(["_id", "_th"])

        def count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows of one hub and part lie side by side, the hub's own text first."""
            unzip = zstandard.ZstdDecompressor().decompress
            held = None
            for b in batches:
                pairs = []
                for hub, x, own, z in zip(*(c.to_pylist() for c in b.columns)):
                    s = shingle_set(word_hashes(unzip(z), lower=True), k)
                    if own:
                        held = s
                        continue
                    both = len(np.intersect1d(s, held, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(held) - both):
                        pairs.append((min(hub, x), max(hub, x)))
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["_a", "_b"])

        dealt = texts.join(sent, ["_id", "_th"]).repartition("_hub", "_part").sortWithinPartitions("_hub", "_part", F.desc("_first"))
        out = written(in_arrow(dealt.select("_hub", "_set", "_first", "_z"), count_shingles, "_a long, _b long"))
        discard(near, sent)
        return out

    first = verified(pairs_of("_set", "_centre", live.where("_set <> _centre")))
    label = written(components(first.select(F.col("_a").alias("a"), F.col("_b").alias("b")), spark))
    tagged = live.join(label.withColumnRenamed("node", "_set"), "_set", "left").withColumn("_k", F.coalesce("component", "_set")).drop("component")
    middle = label.select(F.col("node").alias("_centre"), F.col("component").alias("_ck"))
    tagged = written(tagged.join(middle, "_centre", "left").withColumn("_ck", F.coalesce("_ck", "_centre")).select("_t", "_c", "_set", "_n", "_rest", "_k", "_ck"))
    discard(live, label)

    def enough(overlap: Column, a: Column, b: Column) -> Column:
        """Whether sets of sizes a and b with this overlap are similar."""
        return overlap * (100 + percent) >= (a + b) * percent

    left = tagged.where(F.col("_c") > short).where("_k <> _ck")
    grouped = (
        tagged.where(F.col("_c") <= short)
        .groupBy("_t")
        .agg(F.collect_list(F.struct("_n", "_rest", "_set", "_k")).alias("m"), F.min("_k").alias("lo"), F.max("_k").alias("hi"))
        .where("lo <> hi")
    )
    met = F.transform(
        "m",
        lambda x: F.transform(
            F.filter("m", lambda y: (x["_set"] < y["_set"]) & (x["_k"] != y["_k"]) & enough(F.least(x["_rest"], y["_rest"]), x["_n"], y["_n"])),
            lambda y: F.struct(x["_set"].alias("x"), y["_set"].alias("y")),
        ),
    )
    near = grouped.select(F.explode(F.flatten(met)).alias("p")).select("p.x", "p.y")
    # long lists: sizes are met class by class, four classes to a ratio of the threshold; a set
    # visits the classes whose least size its rest suffices for
    step = math.log(100 / percent) / 4
    size_class = F.floor(F.log(F.col("_n").cast("double")) / step).cast("int")
    least_size = F.exp(F.col("_sc") * step) * (1 - 1e-9)
    # and a long list is dealt in blocks, each of which meets what is left of the others
    blocks = F.ceil(F.col("_c") / 1024).cast("int")
    one = left.select("_t", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"), F.col("_set").alias("x"), F.col("_k").alias("kx"), F.col("_n").alias("nx"), F.col("_rest").alias("rx"), F.sequence(size_class - 5, size_class + 5).alias("_sc")).withColumn("_sc", F.explode("_sc"))
    one = one.where(enough(F.least(F.col("rx").cast("double"), least_size * math.exp(step) + 1), F.col("nx"), least_size))
    rest = tagged.where(F.col("_c") > short).select("_t", F.pmod(F.xxhash64("_set"), blocks).cast("int").alias("_block"), F.col("_set").alias("y"), F.col("_k").alias("ky"), F.col("_n").alias("ny"), F.col("_rest").alias("ry"), size_class.alias("_sc"))
    far = one.join(rest, ["_t", "_sc", "_block"]).where((F.col("kx") != F.col("ky")) & enough(F.least("rx", "ry"), F.col("nx"), F.col("ny"))).select("x", "y")
    second = verified(pairs_of("x", "y", near.unionByName(far)))

    rep = sets.where(key_doc_id().isNotNull()).select("_set", "_id")
    links = first.unionByName(second).join(rep.select(F.col("_set").alias("_a"), F.col("_id").alias("a")), "_a").join(rep.select(F.col("_set").alias("_b"), F.col("_id").alias("b")), "_b").select("a", "b")
    same = members.where("_n > 0 and doc_id is not null").join(sets.where(key_doc_id().isNotNull()).select("_set", "_n", "_id"), ["_set", "_n"]).where("doc_id <> _id").select(F.col("doc_id").alias("a"), F.col("_id").alias("b"))
    return members, links.unionByName(same)


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``.

    A document's set holds its distinct ``k``-word shingles after A-Z are lowered; a text of
    fewer words is one shingle, a null text or one without words has none and links with
    nothing.  Documents link when 100 * intersection >= ``percent`` * union; component_id is
    the smallest doc_id reachable.  Rows that repeat a doc_id are one node; rows with a null
    doc_id link nothing and have a null component.  An empty table gives no rows; other columns
    are not read; very long texts are hashed in pieces and counted whole.
    """
    members, links = ngram_links(docs, k, percent)
    group = components(links, docs.sparkSession)
    return members.join(group, members["doc_id"] == group["node"], "left").select(
        "doc_id", F.col("_n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all columns, of which each group of near copies keeps one.

    The document with the least doc_id of each component stays, and of rows that repeat its
    doc_id the one with the least text hash; rows with a null doc_id stay, and so do texts
    without a word.  Very long texts are compared whole; an empty table gives no rows; columns of
    any name pass.
    """
    found = near_duplicates(docs, k, percent).where("doc_id is not null")
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col("doc_id").cast("long").alias("_gone"))
    again = written(columns(docs, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_gone")))
    # rows that neither go nor repeat a doc_id pass without being dealt
    plain, rest = sifted(packed, gone.unionByName(again), ["_gone"])
    kept = rest.join(gone, "_gone", "left_anti")
    repeats = written(kept.join(again, "_gone", "left_semi"))
    once = repeats.withColumn("_h", F.xxhash64("_row.text", "_row")).groupBy("_gone").agg(F.min_by("_row", "_h").alias("_row"))
    out = plain.select("_row").unionByName(kept.join(again, "_gone", "left_anti").select("_row")).unionByName(once.select("_row"))
    return out.select(*[F.col("_row").getField(n).alias(n) for n in names])
