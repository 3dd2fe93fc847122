"""Encoding and decoding with a SentencePiece BPE model, exactly, by backtracking.

Instead of replaying merges from the characters up, the encoder walks the word from left
to right.  An Aho-Corasick automaton over the vocabulary gives the longest piece at each
place; a piece is taken if it is compatible with the piece before it, that is if BPE over
the two pieces' joined characters gives back exactly these two.  If none fits, the place is
marked in a bitfield of failed positions and the walk steps back to the previous piece's
next shorter prefix.  The BPE encoding is the only sequence of pieces whose neighbours are
all compatible, so the walk ends at it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns

_SPACE = "▁"


class PieceCodec:
    """Encoder and decoder of one model file of type BPE with an identity normaliser."""

    def __init__(self, model_file: str, cached_words: int = 1_000_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only BPE models with an identity normaliser that keeps white space")
        self.dummy_prefix = spec.add_dummy_prefix
        self.kinds = [p.type for p in model.pieces]
        self.pieces = [p.piece for p in model.pieces]
        self.rank = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.unk = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.unk_surface = model.trainer_spec.unk_surface if model.trainer_spec.HasField("unk_surface") else " ⁇ "
        self.bos, self.eos = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.tree = ahocorasick.Automaton()
        for piece in self.rank:
            self.tree.add_word(piece, piece)
        self.tree.make_automaton()
        # the longest piece that is a proper prefix of a piece, in the vocabulary
        self.shorter = {}
        for piece in self.rank:
            cut = len(piece) - 1
            while cut and piece[:cut] not in self.rank:
                cut -= 1
            self.shorter[piece] = piece[:cut] or None
        self.made = {p: len(p) == 1 or self._replay(p) == [p] for p in self.rank}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.cached_words = cached_words

    def _replay(self, text: str) -> list[str]:
        """BPE merges over the characters of a short text, best score first, leftmost first."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r[0] < best):
                    best, at = r[0], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= self.cached_words:
                self.pairs.clear()
            known = self.pairs[left, right] = self._replay(left + right) == [left, right]
        return known

    def longest(self, text: str) -> list[str | None]:
        """The longest piece that starts at each place, from the automaton's matches."""
        best: list[str | None] = [None] * len(text)
        for end, piece in self.tree.iter(text):  # by end, longest first
            at = end - len(piece) + 1
            best[at] = piece  # a later end is a longer piece
        return best

    def _known(self, text: str) -> list[str]:
        """Pieces of a run of characters that all are pieces themselves."""
        best, n = self.longest(text), len(text)
        failed = bytearray(n // 8 + 1)  # bitfield of positions from which no compatible way on exists
        out: list[str] = []
        at, piece = 0, best[0]
        while True:
            prev = out[-1] if out else None
            took = False
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and self.made[piece] and (prev is None or self.compatible(prev, piece)):
                    took = True
                    break
                piece = self.shorter[piece]
            if took:
                out.append(piece)
                at += len(piece)
                if at == n:
                    return out
                piece = best[at]
            else:
                if not out:
                    return self._replay(text)
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(last)
                piece = self.shorter[last]

    def _word(self, text: str) -> bytes:
        ids: list[int] = []
        run = ""
        for c in text:
            if c in self.rank:
                run += c
                continue
            if run:
                ids += [self.rank[p][1] for p in self._known(run)]
                run = ""
            ids += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unk]
        if run:
            ids += [self.rank[p][1] for p in self._known(run)]
        return np.asarray(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers.

        No piece holds a space mark after another character, so a word with the marks
        before it is encoded on its own; words are kept in a cache of bounded size.
        """
        if not text:
            return np.asarray([self.bos, self.eos], dtype="<u4").tobytes()
        if self.dummy_prefix:
            text = " " + text
        words = text.replace(_SPACE, " ").split(" ")
        out = [np.asarray([self.bos], dtype="<u4").tobytes()]
        if words[0]:
            out.append(self.lookup(words[0]))
        marks = 1
        cache = self.cache
        for w in words[1:-1] if len(words) > 2 else []:
            if not w:
                marks += 1
                continue
            w = _SPACE * marks + w
            marks = 1
            ids = cache.get(w)
            out.append(ids if ids is not None else self.lookup(w))
        if len(words) > 1:
            out.append(self.lookup(_SPACE * marks + words[-1]))
        out.append(np.asarray([self.eos], dtype="<u4").tobytes())
        return b"".join(out)

    def lookup(self, word: str) -> bytes:
        ids = self.cache.get(word)
        if ids is None:
            if len(self.cache) >= self.cached_words:
                self.cache.clear()
            ids = self._word(word)
            if len(word) <= 64:
                self.cache[word] = ids
        return ids

    def decode(self, ids: bytes) -> str:
        """Text of ids: marks become spaces, the dummy prefix goes, bytes are joined."""
        out: list[str] = []
        raw = bytearray()
        first = self.dummy_prefix
        pieces, of_byte, kinds = self.surface, self.of_byte, self.kinds
        for i in np.frombuffer(ids, dtype="<u4").tolist():
            kind = kinds[i]
            if kind == 6:
                raw.append(of_byte[i])
                continue
            if raw:
                out.append(_bytes_text(bytes(raw)))
                raw.clear()
                first = False
            if kind == 3:
                continue
            if kind == 2:
                out.append(self.unk_surface)
                first = False
                continue
            piece = pieces[i]
            if first:
                piece = piece.removeprefix(" ")
                first = False
            out.append(piece)
        if raw:
            out.append(_bytes_text(bytes(raw)))
        return "".join(out)

    @property
    def surface(self) -> list[str]:
        if not hasattr(self, "_surface"):
            self._surface = [p.replace(_SPACE, " ") for p in self.pieces]
        return self._surface


def _bytes_text(raw: bytes) -> str:
    """UTF-8 text; each byte that is in no valid character gives one replacement mark."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """The codec of a model file, built once in each worker."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def encode_documents(docs: DataFrame, model_file: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text; with ``with_ids`` also the ids and the decoded text.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256.  Null text counts as empty (begin
    and end ids only, decoded to the empty text); repeated rows give repeated results; an
    empty table gives none; very long texts are encoded whole; other columns are not read.  One pass without a shuffle; a worker keeps at most a million
    cached words, whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            n, a, b, ids_out, text_out = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = c.encode(text or "")
                back = c.decode(ids)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    ids_out.append(np.frombuffer(ids, dtype="<u4").astype(np.int32))
                    text_out.append(back)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(text_out, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = columns(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(run, schema + (", ids array<int>, decoded string" if with_ids else ""))
