"""Repeated passages: suffix automata of reference shards and matching statistics.

A window is a run of ``window`` consecutive words of one document.  Every word that lies in
a window whose words also start anywhere else is removed.

The corpus is its own reference and grows without a bound, so its automata are not sent to
every task; each window is routed to the shard that holds all its occurrences instead:

1. Every window has an anchor, its ``k``-gram with the least hash (leftmost of equals).
   Equal windows have equal anchors, and consecutive windows mostly share one: about one
   anchor for each 14 words.  The words of an anchor's windows are its segment.  Anchors and
   hashes of segments are written once; anchors found once (a partial aggregate) end here.
2. Equal segments are counted by hash, and one of each is cut out of its document.
3. A shard holds all segments of a run of anchors, ``shard_words`` words of them or one
   anchor's.  It has one suffix automaton, with the number of occurrences of every state.
   Each of its segments is streamed for its matching statistics; where the match is
   ``window`` words or longer, the state that holds the last ``window`` words tells how often
   they occur.
4. The repeated windows return to the places of their segments, and the documents drop the
   covered words.

An anchor with more than ``hot`` different segments is split: each window is a segment of
its own, routed by the window's hash too, so that no shard grows with the corpus.  A segment
with more than a thousandth of all places is joined with them by broadcast: of such segments
there are a thousand at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, in_arrow, key_doc_id, row_key, sifted, written
from .wordhash import batches_of_texts, mix, sliding_argmin, span_hashes, text_word_hashes, window_hashes


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with occurrences of every state."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def add(self, words: list, weight: int) -> None:
        """Add a sequence that occurs ``weight`` times."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                count[q] += weight
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                count.append(weight)
                link.append(0)
                p = last
                while p != -1 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p == -1:
                    last = cur
                    continue
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[cur] = q
                    last = cur
                    continue
            else:
                cur, p = -1, last
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            count.append(0)
            link.append(link[q])
            while p != -1 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            link[q] = clone
            if cur >= 0:
                link[cur] = clone
                last = cur
            else:
                last = clone
                count[clone] += weight

    def close(self) -> None:
        """Pass the occurrences on to the suffixes' states."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def matches(self, words: list, window: int) -> Iterator[tuple[int, int]]:
        """(end, occurrences) for each place where the last ``window`` words are matched."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        state, have = 0, 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                have = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                have += 1
            if have >= window:
                while length[link[state]] >= window:
                    state = link[state]
                    have = length[state]
                yield i + 1, count[state]


def segment_hash(segment: bytes) -> int:
    # never 0, which stands for an anchor's own segment
    return int.from_bytes(hashlib.blake2b(segment, digest_size=8).digest(), "little", signed=True) or 1


def repeated_windows(segments: list[tuple[bytes, int]], window: int) -> list[int]:
    """For each (text, occurrences), the bits of the windows that occur twice or more."""
    automaton = SuffixAutomaton()
    words = [t.split() for t, _ in segments]
    for w, (_, n) in zip(words, segments):
        automaton.add(w, n)
    automaton.close()
    out = []
    for w in words:
        bits = 0
        for end, n in automaton.matches(w, window):
            if n > 1:
                bits |= 1 << (end - window)
        out.append(bits)
    return out


def anchor_length(window: int, k: int) -> int:
    """``k``, or what lets the windows of one anchor be counted in 56 bits."""
    if window < 1 or k < 1:
        raise ValueError("window and k must be positive")
    return max(min(k, window), window - 55)


def anchors_of(h: np.ndarray, at: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchors of joined texts, text ``i`` with the word hashes ``h[at[i] : at[i + 1]]``.

    Returns text, anchor (32 bits), first and last window start, and hash of the segment.
    """
    place = sliding_argmin(window_hashes(h, k), window - k + 1)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.flatnonzero(text[: len(place)] == text[window - 1 : window - 1 + len(place)])  # windows in one text
    if len(start) == 0:
        none = np.empty(0, dtype=np.int64)
        return none, none.astype(np.int32), none, none, none
    gram, doc = place[start], text[start]
    first = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])])
    lo, hi = start[first], start[np.r_[first[1:], len(start)] - 1]
    code = mix(window_hashes(h, k)[gram[first]]) >> np.uint64(32)
    doc = doc[first]
    return doc, code.astype(np.uint32).view(np.int32), lo - at[doc], hi - at[doc], span_hashes(h, lo, hi + window).view(np.int64)


def _word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    from .wordhash import word_spans

    buf = np.frombuffer(text, dtype=np.uint8)
    return word_spans(buf) if len(buf) else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))


def repeated_spans(base: DataFrame, texts: DataFrame, window: int, k: int, hot: int, shard_words: int) -> DataFrame:
    """(_id, _th, _spans): first words and bits of the repeated windows, by row key.

    ``base``: _id, _th, text.  ``texts``: the same rows :func:`zipped`.
    """
    k = anchor_length(window, k)

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, _, buf, offsets in batches_of_texts(b.column(2)):
                h, at = text_word_hashes(buf, offsets)
                own, a, first, last, sh = anchors_of(h, at, window, k)
                cols = [a, ids[lo + own], ths[lo + own], first * 64 + (last - first), sh]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["_a", "_id", "_th", "_s", "_sh"])

    anchors = written(in_arrow(base.select("_id", "_th", "text"), anchor_rows, "_a int, _id long, _th long, _s long, _sh long"))
    # the places of a segment come together early where it is a copy
    kinds = anchors.groupBy("_a", "_sh").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("_id", "_th", "_s")).alias("_r"))
    kinds = written(kinds.join(kinds.groupBy("_a").agg(F.sum("_c").alias("_all"), F.count(F.lit(1)).alias("_kinds")).where("_all > 1"), "_a").drop("_all"))
    is_hot = F.col("_kinds") > hot
    wanted = kinds.select("_r._id", "_r._th", F.struct("_a", "_sh", "_c", "_r._s", is_hot.alias("_hot")).alias("x"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        names = ["_a", "_sub", "_sh", "_j", "_c", "_seg"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            out: list[tuple] = []
            for z, hits in zip(b.column(0), b.column(1)):
                text = unzip(z.as_py())
                starts, ends = _word_places(text)
                for hit in hits.as_py():
                    first = hit["_s"] >> 6
                    last = first + (hit["_s"] & 63)
                    for i, (s, e) in enumerate([(s, s) for s in range(first, last + 1)] if hit["_hot"] else [(first, last)]):
                        seg = b" ".join(text[starts[s] : ends[e + window - 1]].split())
                        out.append((hit["_a"], segment_hash(seg) if hit["_hot"] else 0, hit["_sh"], i, hit["_c"], seg))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def cut(those: DataFrame) -> DataFrame:
        # of rows that repeat a key one is cut: they lie side by side after the join
        near = texts.join(those.groupBy("_id", "_th").agg(F.collect_list("x").alias("_hits")), ["_id", "_th"]).dropDuplicates(["_id", "_th"])
        return in_arrow(near.select("_z", "_hits"), segments, "_a int, _sub long, _sh long, _j int, _c long, _seg binary")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (_a, _sub): a group of rows is never parted between two shards."""
        key, held, words = None, [], 0

        def close() -> pa.RecordBatch:
            hit = [(a, sub, sh, bits) for (a, sub, sh, _, _), bits in zip(held, repeated_windows([(h[3], h[4]) for h in held], window)) if bits]
            cols = list(zip(*hit)) if hit else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["_a", "_sub", "_sh", "_bits"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:2] != key:
                    key = row[:2]
                    if words >= shard_words:
                        yield close()
                        held, words = [], 0
                held.append(row)
                words += row[3].count(b" ") + 1
        if held:
            yield close()

    def judged(rows: DataFrame) -> DataFrame:
        dealt = rows.select("_a", "_sub", "_sh", "_seg", "_c").repartition("_a", "_sub").sortWithinPartitions("_a", "_sub")
        return in_arrow(dealt, shards, "_a int, _sub long, _sh long, _bits long")

    found = judged(cut(wanted.where("not x._hot"))).select("_a", "_sh", "_bits")
    if not kinds.where(is_hot).isEmpty():
        # equal windows of different segments are one before they meet
        single = cut(wanted.where("x._hot"))
        windows = judged(single.groupBy("_a", "_sub", "_seg").agg(F.sum("_c").alias("_c")).withColumn("_sh", F.lit(0).cast("long")))
        back = single.select("_a", "_sub", "_sh", "_j").join(windows.select("_a", "_sub").distinct(), ["_a", "_sub"])
        found = found.unionByName(back.groupBy("_a", "_sh").agg(F.bit_or(F.expr("shiftleft(1L, _j)")).alias("_bits")))
    found = found.dropDuplicates(["_a", "_sh"]).join(kinds.select("_a", "_sh", "_c"), ["_a", "_sh"])
    found = written(found)
    often = max(1, anchors.count() // 1000)
    places = anchors.select("_a", "_sh", "_id", "_th", F.shiftright("_s", 6).cast("int").alias("_at"))
    few, many = found.where(F.col("_c") <= often).drop("_c"), found.where(F.col("_c") > often).drop("_c")
    met = places.join(few, ["_a", "_sh"]).unionByName(places.join(F.broadcast(many), ["_a", "_sh"]))
    return met.groupBy("_id", "_th").agg(F.collect_set(F.struct("_at", "_bits")).alias("_spans"))


def zipped(base: DataFrame) -> DataFrame:
    """``base`` with the text compressed, so that it moves in fewer bytes: _id, _th, _z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = [pack((t or "").encode()) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], ["_id", "_th", "_z"])

    rows = in_arrow(base.select("_id", "_th", "text"), run, "_id long, _th long, _z binary")
    # said here, so that inner and outer joins read one and the same shuffle
    return rows.where("_id is not null and _th is not null")


def covered_words(n: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a repeated window."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for s in spans or ():
        bits, at = s["_bits"], s["_at"]
        while bits:
            low = (bits & -bits).bit_length() - 1
            run = (~(bits >> low) & ((bits >> low) + 1)).bit_length() - 1  # consecutive windows
            edge[at + low] += 1
            edge[at + low + run - 1 + window] -= 1
            bits &= ~(((1 << run) - 1) << low)
    return np.cumsum(edge)[:n] > 0


def remove_repeats(docs: DataFrame, window: int = 35, k: int = 8, hot: int = 1000, shard_words: int = 20_000, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs`` (and the kept text).

    The kept text is the kept words joined by one space.  Null and empty texts have no word.
    Exact copies of a document of ``window`` words or more remove each other whole, and so do
    repeated rows; shorter documents have no window and stay.  An empty table gives no rows.
    Any ``window`` of one word or more will do; very long texts are hashed in pieces, and
    columns other than doc_id and text are not read.
    """
    base = columns(docs, "doc_id", "text").select(*row_key(), "text")
    texts = zipped(base)
    spans = repeated_spans(base, texts, window, k, hot, shard_words)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for b in batches:
            n_words, removed, sha, kept_text = [], [], [], []
            for z, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = unzip(z).split()
                gone = covered_words(len(words), s, window)
                n_words.append(len(words))
                removed.append(int(gone.sum()))
                kept = b" ".join([w for w, g in zip(words, gone) if not g] if s else words)
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_text.append(kept.decode())
            cols = [b.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array(kept_text, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = texts.join(spans, ["_id", "_th"], "left").select(key_doc_id().alias("doc_id"), "_z", "_spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return in_arrow(rows, finish, schema)


def remove_known(docs: DataFrame, reference: DataFrame, window: int = 35, shard_words: int = 20_000, max_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: ``docs`` without the passages of ``reference`` (text).

    Every word goes that lies in a run of ``window`` words which also stands in a reference
    text, such as a benchmark's.  The reference is dealt into shards of about ``shard_words`` words,
    which are broadcast; a task builds a shard's automaton once and streams its documents
    through all of them for their matching statistics.

    The reference may have ``max_bytes`` bytes of text, which is checked; a larger one raises
    ValueError, and belongs into one table with the documents for :func:`remove_repeats`.  Null
    and empty texts, of either side, have no word; repeated rows are treated alike; very long
    texts are streamed whole; other columns are not read; an empty table gives no rows, an
    empty reference removes nothing.
    """
    if window < 1:
        raise ValueError("window must be positive")
    known = columns(reference, "text").where("text is not null")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > max_bytes:
        raise ValueError(f"a reference of {size} bytes is not broadcast, {max_bytes} at most")
    shards: list[list[bytes]] = []
    room = 0
    for r in known.select("text").distinct().toLocalIterator():
        text = b" ".join(r["text"].encode().split())
        n = text.count(b" ") + 1 if text else 0
        if n < window:
            continue
        if room <= 0:
            shards.append([])
            room = shard_words
        shards[-1].append(text)
        room -= n
    sent = docs.sparkSession.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for shard in sent.value:
            automata.append(SuffixAutomaton())
            for text in shard:
                automata[-1].add(text.split(), 1)
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = (text or "").encode().split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for a in automata:
                    for end, _ in a.matches(words, window):
                        edge[end - window] += 1
                        edge[end] -= 1
                gone = np.cumsum(edge)[: len(words)] > 0
                kept = b" ".join(w for w, g in zip(words, gone) if not g).decode()
                out.append((doc_id, len(words), int(gone.sum()), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds)], ["doc_id", "n_words", "n_removed", "kept_text"])

    rows = columns(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text")
    return in_arrow(rows, run, "doc_id long, n_words long, n_removed long, kept_text string")


def drop_repeats(docs: DataFrame, window: int = 35, k: int = 8, hot: int = 1000, shard_words: int = 20_000) -> DataFrame:
    """``docs``, all columns, with repeated passages cut out of the texts.

    A text that loses words becomes its kept words joined by one space (n_chars, if there, is
    set to its length); others stay as they are.  Every row stays, also one left empty.  Rows that
    repeat a (doc_id, text) lose all their windows, very long texts are cut whole, and an empty table
    gives no rows.
    """
    names = docs.columns
    base = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), "doc_id", "text").select(
        "_row", *row_key(), "text"
    )
    spans = written(repeated_spans(base.drop("_row"), zipped(base), window, k, hot, shard_words))
    # rows without a repeated window pass without being dealt
    whole, rest = sifted(base, spans, ["_id", "_th"])
    rows = rest.drop("text").join(spans, ["_id", "_th"], "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s:
                    words = text.encode().split()
                    gone = covered_words(len(words), s, window)
                    text = b" ".join([w for w, g in zip(words, gone) if not g]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *b.columns[2:]], ["text", *b.schema.names[2:]])

    others = [n for n in names if n != "text"]
    flat = rows.select(F.col("_row.text").alias("text"), "_spans", *[F.col("_row").getField(n).alias(n) for n in others])
    kinds = ["text string"] + [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    whole = whole.select(F.col("_row.text").alias("text"), *[F.col("_row").getField(n).alias(n) for n in others])
    done = whole.unionByName(in_arrow(flat, finish, ", ".join(kinds)))
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return done.select(*[F.col(f"`{n}`") for n in names])
