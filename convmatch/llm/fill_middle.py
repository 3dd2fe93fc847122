"""Fill-in-the-middle texts by rotating blocks in place.

A text is cut into prefix, middle and suffix between tokens (``[A-Za-z]+|[^A-Za-z]``).  The
sentinels are inserted at the cuts of one buffer, and the blocks exchanged by three reversals:
reversing ``xy`` whole, then each part, gives ``yx`` without a second buffer.  The same
rotation with the lengths the other way round leads back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def rotate(buf: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange the neighbouring blocks [lo, mid) and [mid, hi) of ``buf`` by three reversals."""
    for a, b in ((lo, mid), (mid, hi), (lo, hi)):
        part = memoryview(buf)[a:b]
        part[:] = bytes(part[::-1])
        part.release()


def token_ends(text: bytes) -> np.ndarray:
    """Byte offsets where the tokens of a UTF-8 text end, with 0 before the first."""
    buf = np.frombuffer(text, dtype=np.uint8)
    if len(buf) == 0:
        return np.zeros(1, dtype=np.int64)
    letter = _LETTER[buf]
    starts = (buf & 0xC0) != 0x80  # code points
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return np.append(np.flatnonzero(starts), len(buf))


def code_points(text: bytes | bytearray) -> int:
    buf = np.frombuffer(text, dtype=np.uint8)
    return int(np.count_nonzero((buf & 0xC0) != 0x80))


def cuts_of(doc_id: int | None, seed: int, tokens: int, plain_percent: int, spm_percent: int) -> tuple[int, int, str]:
    """First and second cut, in tokens, and the form that a text with sentinels' room takes."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (tokens + 1), h[1] % (tokens + 1)))
    form = "plain" if h[2] % 100 >= 100 - plain_percent else "spm" if h[3] % 100 < spm_percent else "psm"
    return a, b, form


def transform(text: bytes, first: int, second: int, form: str) -> bytearray:
    """``text`` cut at the byte offsets ``first`` and ``second``, its blocks in the order of ``form``."""
    buf = bytearray(text)
    if form == "plain":
        return buf
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buf[at:at] = mark
    middle, suffix = first + 3, second + 6
    rotate(buf, middle if form == "psm" else 0, suffix, len(buf))
    return buf


def restore(output: bytes | bytearray, form: str) -> bytearray:
    """The text that :func:`transform` made ``output`` from."""
    buf = bytearray(output)
    if form == "plain":
        return buf
    # a psm text is prefix, suffix, middle and an spm text suffix, prefix, middle: what stands
    # before the rotated blocks and where they part is where the sentinels are
    if form == "psm":
        lo, mid = buf.index(SUFFIX), buf.index(MIDDLE)
        rotate(buf, lo, mid, len(buf))
        middle, suffix = lo, lo + len(buf) - mid
    else:
        mid = buf.index(PREFIX)
        rotate(buf, 0, mid, len(buf))
        suffix = len(buf) - mid
        middle = buf.index(MIDDLE)
    for at in (suffix, middle, 0):
        del buf[at : at + 3]
    return buf


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, with_text: bool = False) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 (and output).

    ``n`` tokens; the cuts and the form follow from ``seed`` and doc_id alone.  The text is rebuilt
    from output and form, and its digest returned beside the output's; with ``with_text`` the
    output itself is the last column.

    A null text is an empty one; empty texts and those with a sentinel in them stay plain.  A
    null doc_id is hashed as an empty string.  Repeated rows come out alike, one each; a very long
    text is cut whole, in its row's task; other columns are not read; an empty table gives
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = (t or "").encode()
                ends = token_ends(text)
                n = len(ends) - 1
                a, z, form = cuts_of(doc_id, seed, n, plain_percent, spm_percent)
                if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    form = "plain"
                first, second = int(ends[a]), int(ends[z])
                made = transform(text, first, second, form)
                back = restore(made, form)
                sizes = (None, None) if form == "plain" else (code_points(text[:first]), code_points(text[first:second]))
                row = (doc_id, n, form, *sizes, hashlib.sha256(made).hexdigest(), hashlib.sha256(back).hexdigest())
                out.append((*row, made.decode()) if with_text else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] + ["output"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.string()] * with_text
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    rows = columns(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(run, schema + (", output string" if with_text else ""))


def oracle() -> str:
    """DuckDB SQL with the rows of :func:`fill_in_middle` over ``documents``."""
    hash4 = ", ".join(f"cast('0x' || substr(h, {8 * i + 1}, 8) as ubigint) as h{i + 1}" for i in range(4))
    return f"""
    with t as (
        select doc_id, coalesce(text, '') as s, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h,
               regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u
        from documents
    ), c as (select *, cast(len(u) as bigint) as n, {hash4} from t),
    d as (
        select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as z,
               case when s = '' or contains(s, '<P>') or contains(s, '<S>') or contains(s, '<M>') or h3 % 100 >= 90 then 'plain'
                    when h4 % 100 < 20 then 'spm' else 'psm' end as form
        from c
    ), e as (
        select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:z], '') as m, array_to_string(u[z + 1:], '') as x
        from d
    )
    select doc_id, n, form,
           case when form = 'plain' then null else cast(length(p) as bigint) end as prefix_chars,
           case when form = 'plain' then null else cast(length(m) as bigint) end as middle_chars,
           sha256(case form when 'plain' then s when 'psm' then '<P>' || p || '<S>' || x || '<M>' || m
                  else '<S>' || x || '<P>' || p || '<M>' || m end) as output_sha256,
           sha256(p || m || x) as restored_sha256
    from e"""
