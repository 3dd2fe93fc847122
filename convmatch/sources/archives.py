"""Zip archives of chat exports: members ``<user>/<provider>/conversations.json``, each one JSON array."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .exports import EXPORT_SCHEMA, shape_of

CHUNK = 1 << 20
_SPACE = re.compile(r"[\s,]*")


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def array_items(source: io.TextIOBase, chunk: int = CHUNK) -> Iterator[str]:
    """The items of one JSON array as texts, read piece by piece: no more than one item and one piece
    is held (of a long item, up to twice its length).  Raises ValueError where the array breaks off."""
    decoder, buffer = json.JSONDecoder(), ""
    while not buffer and (piece := source.read(chunk)):
        buffer = piece.lstrip("\ufeff \t\r\n")
    if not buffer.startswith("["):
        raise ValueError("no JSON array")
    at, more = 1, chunk
    while True:
        at = _SPACE.match(buffer, at).end()
        if buffer[at : at + 1] == "]":
            return
        try:
            if at == len(buffer):
                raise ValueError("the array breaks off")
            _, end = decoder.raw_decode(buffer, at)
            if end == len(buffer) and buffer[at] not in "{[\"":
                raise ValueError("the array breaks off")  # a number may go on
        except ValueError:
            piece = source.read(more)
            if not piece:
                raise
            buffer, at, more = buffer[at:] + piece, 0, max(chunk, 2 * (len(buffer) - at))
            continue
        yield buffer[at:end]
        at, more = end, chunk


class Member(InputPartition):
    def __init__(self, archive: str, name: str | None, error: str | None = None) -> None:
        self.archive, self.name, self.error = archive, name, error


class ZipReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Member]:
        """A partition for each JSON member; of an archive only its list of members is read."""
        from pyarrow import fs

        files, root = _files(self.path)
        info = files.get_file_info(root)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for path in sorted(f.path for f in found if f.is_file and f.path.endswith(".zip")):
            try:
                with files.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    out += [Member(path, n) for n in z.namelist() if n.endswith(".json")]
            except (zipfile.BadZipFile, ValueError) as e:  # of a file shorter than a zip's end, ValueError
                out.append(Member(path, None, str(e)))
        return out

    def read(self, partition: Member | None):
        if partition is None:  # there is no archive
            return
        path, name = partition.archive, partition.name
        if name is None:
            yield path, None, None, None, partition.error
            return
        files, _ = _files(self.path)
        n = 0
        with files.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            try:
                with z.open(name) as raw:
                    for item in array_items(io.TextIOWrapper(raw, encoding="utf-8", errors="replace")):
                        yield path, name, n, item, None
                        n += 1
            except (ValueError, zipfile.BadZipFile) as e:  # the items before are whole
                yield path, name, n, None, str(e)


class ZipExports(DataSource):
    """``spark.read.format("zip_exports").load(path)``: a row for each item of each member."""

    @classmethod
    def name(cls) -> str:
        return "zip_exports"

    def schema(self) -> str:
        return "archive string, member string, position long, item string, error string"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options["path"])


def read_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(conversations with user_id, provider and shape; rejects) of all archives under ``path``.

    Rejects (archive, member, position, reason): broken archives, members that are not one whole array, and
    items that are no object.  The items of a broken array before the break are kept.
    """
    spark.dataSource.register(ZipExports)
    raw = spark.read.format("zip_exports").load(path)
    parsed = raw.withColumn("c", F.from_json("item", EXPORT_SCHEMA))
    is_object = F.coalesce(F.col("item").startswith("{"), F.lit(False))
    owner = lambda i: F.regexp_extract("member", r"([^/=]+)/(?:[^/=]+=)?([^/=]+)/[^/]+$", i)
    good = parsed.where(is_object).select("c.*", owner(1).alias("user_id"), owner(2).alias("provider")).withColumn("shape", shape_of())
    bad = raw.where(~is_object).select("archive", "member", "position", F.coalesce("error", F.lit("no object")).alias("reason"))
    return good, bad


def write_archives(rows: DataFrame, path: str, order: list[str], archives: int = 8) -> int:
    """Write ``rows`` (user, provider, item: a JSON text, and ``order``) as archives of members in that order; how many.

    Rows go by ranges of (user, provider, order), so a user with many rows spans several archives.
    A task streams its rows into one file, which gets its name when it is whole.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, files_root = TaskContext.get(), _files(path)
        files, root = files_root
        files.create_dir(root, recursive=True)
        draft, done = f"{root}/_draft-{task.taskAttemptId()}", f"{root}/part-{task.partitionId():05d}.zip"
        last, member, n = None, None, 0
        with files.open_output_stream(draft) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for pdf in frames:
                for user, provider, item in zip(pdf["user"], pdf["provider"], pdf["item"]):
                    if (user, provider) != last:
                        if member is not None:
                            member.write(b"]")
                            member.close()
                        last, member = (user, provider), z.open(f"{user}/{provider}/conversations.json", "w", force_zip64=True)
                        member.write(b"[")
                    else:
                        member.write(b",\n")
                    member.write(item.encode())
                    n += 1
            if member is not None:
                member.write(b"]")
                member.close()
        if n:
            files.move(draft, done)
        else:
            files.delete_file(draft)
        yield pd.DataFrame({"n": [int(n > 0)]})

    keys = ["user", "provider", *order]
    parts = rows.repartitionByRange(archives, *keys).sortWithinPartitions(*keys).select(F.col("user").cast("string"), "provider", "item")
    return parts.mapInPandas(write, "n long").agg(F.sum("n")).first()[0]
