"""ZIP archives by their directories: members are listed, dealt over tasks, read as streams or laid out as plain files."""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.sources.ranges import located, opened, spread
from estatelens.storage import checkpointed, scratch

#: What a damaged, encrypted or unknown archive or member raises.
DAMAGE = (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError, KeyError, struct.error, UnicodeError)
MAGIC = b"PK\x03\x04"
#: A task reads members of about this many packed bytes, and hands on texts of about as many bytes at once.
TASK_BYTES, BATCH_BYTES = 32 << 20, 8 << 20
#: A larger member is no row.
MOST_TEXT = 1 << 30
_MEMBERS = {"file": pa.string(), "member": pa.string(), "offset": pa.int64(), "packed": pa.int64(), "size": pa.int64(), "error": pa.string()}
_MEMBERS_SQL = "file string, member string, offset long, packed long, size long, error string"


def made(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    """A batch of rows with columns of these names and types."""
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


def list_members(files: DataFrame, suffixes: tuple[str, ...], loose: tuple[str, ...] = ()) -> DataFrame:
    """file, member, offset, packed, size, error: the members with these suffixes of every archive among files (path, length).

    Only an archive's directory is read. offset says where a member begins, packed how many bytes it takes there. An archive
    is known by its first bytes or a .zip suffix; one that can't be read gives a row with the error. Other files with one of
    the `loose` suffixes give a row without offset; the rest none.
    """

    def of(path: str, length: int) -> Iterator[tuple]:
        name = path.rsplit("/", 1)[-1].lower()
        try:
            with opened(path) as file:
                if file.read(4) != MAGIC and not name.endswith(".zip"):
                    if name.endswith(loose) and loose:
                        yield path, path.rsplit("/", 1)[-1], None, length, length, None
                    return
                with zipfile.ZipFile(file) as box:
                    for inside in box.infolist():
                        if inside.filename.lower().endswith(suffixes):
                            yield path, inside.filename, inside.header_offset, inside.compress_size, inside.file_size, None
        except DAMAGE as error:
            yield path, None, None, None, None, f"not a ZIP: {error}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch["path"].to_pylist(), batch["length"].to_pylist(), strict=True):
                yield made(list(of(path, length)), _MEMBERS)

    return spread(files.select("path", "length")).mapInArrow(work, _MEMBERS_SQL)


def dealt(members: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """members in tasks of about task_bytes packed bytes, by file and offset, so that an archive is spread over many tasks."""
    known = checkpointed(members)
    total = known.agg(F.sum("packed")).first()[0] or 0
    return known.repartitionByRange(max(1, -(-total // task_bytes)), "file", "offset").sortWithinPartitions("file", "offset")


def one_a_task(members: DataFrame, most: int = 10_000, task_bytes: int = 4 << 20) -> DataFrame:
    """members for tasks that stream one each; small ones share tasks of about task_bytes packed bytes, and there are no more than `most` tasks."""
    known = checkpointed(members)
    total, n = known.agg(F.sum("packed"), F.count(F.lit(1))).first()
    spread_ = max(-(-(total or 0) // task_bytes), known.sparkSession.sparkContext.defaultParallelism)
    return known.repartitionByRange(max(1, min(most, n, spread_)), "file", "member")


class _Archives:
    """The archive that was asked for last stays open."""

    def __init__(self) -> None:
        self.path, self.file, self.box = None, None, None

    def member(self, path: str, offset: int) -> BinaryIO:
        if path != self.path:
            self.close()
            self.file = opened(path)
            self.path, self.box = path, zipfile.ZipFile(self.file)
            self.by_offset = {x.header_offset: x for x in self.box.infolist()}
        return self.box.open(self.by_offset[offset])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path = self.file = self.box = None


def read_texts(members: DataFrame) -> DataFrame:
    """file, member, text (UTF-8, bad bytes replaced), error of the rows of list_members; a row with an error keeps it."""
    types = {"file": pa.string(), "member": pa.string(), "text": pa.string(), "error": pa.string()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives, rows, size = _Archives(), [], 0

        def text(row: dict) -> tuple[str | None, str | None]:
            if row["error"]:
                return None, row["error"]
            if row["size"] > MOST_TEXT:
                return None, f"larger than {MOST_TEXT} bytes"
            try:
                with opened(row["file"]) if row["offset"] is None else archives.member(row["file"], row["offset"]) as stream:
                    return stream.read().decode("utf-8", "replace"), None
            except DAMAGE as error:
                return None, f"unreadable member: {error}"

        for batch in batches:
            for row in batch.to_pylist():
                found, error = text(row)
                rows.append((row["file"], row["member"], found, error))
                size += len(found or "")
                if size >= BATCH_BYTES:
                    yield made(rows, types)
                    rows, size = [], 0
        archives.close()
        yield made(rows, types)

    return members.mapInArrow(work, "file string, member string, text string, error string")


def laid_out(spark: SparkSession, members: DataFrame, kind: str) -> tuple[str, DataFrame]:
    """Writes each member as a file of its own into a new shared folder, where Spark can read it in ranges; returns the folder
    and (file, member, name, error), name being that of the file written, null where there is an error.

    A member is written under a draft name and renamed when it is whole, so a repeated task does no harm. Prefixes of element
    names are cut off on the way (a member is taken for XML).
    """
    folder = scratch(spark, kind)
    types = {"file": pa.string(), "member": pa.string(), "name": pa.string(), "error": pa.string()}

    def written(row: dict, archives: _Archives) -> tuple:
        where, path = located(folder)
        name = hashlib.sha256(f"{row['file']}\0{row['member']}".encode()).hexdigest()[:40] + ".xml"
        draft = f"{path}/_drafts/{uuid4().hex}"
        try:
            where.create_dir(f"{path}/_drafts", recursive=True)
            with archives.member(row["file"], row["offset"]) as stream, where.open_output_stream(draft) as out:
                for block in without_prefixes(stream):
                    out.write(block)
            where.move(draft, f"{path}/{name}")
        except DAMAGE as error:
            return row["file"], row["member"], None, f"unreadable member: {error}"
        return row["file"], row["member"], name, None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives()
        for batch in batches:
            for row in batch.to_pylist():
                yield made([(row["file"], row["member"], None, row["error"]) if row["error"] else written(row, archives)], types)
        archives.close()

    return folder, checkpointed(members.mapInArrow(work, "file string, member string, name string, error string"))


def without_prefixes(stream: BinaryIO, block_bytes: int = 1 << 22) -> Iterator[bytes]:
    """The stream with the prefix of its root element's name cut from all element names; unchanged if the root has none."""
    held, mark = b"", None
    while block := stream.read(block_bytes):
        held += block
        if mark is None:
            root = held.find(b"<", _after_head(held))
            if root < 0 or b">" not in held[root:]:
                continue
            name = held[root + 1 :].split(b">", 1)[0].split(None, 1)[0].rstrip(b"/")
            mark = name.split(b":", 1)[0] + b":" if b":" in name else b""
        if not mark:
            yield held
            held = b""
            continue
        cut = held.rfind(b"<")  # a tag may go on in the next block
        cut = len(held) if cut < 0 else cut
        yield held[:cut].replace(b"<" + mark, b"<").replace(b"</" + mark, b"</")
        held = held[cut:]
    yield held.replace(b"<" + mark, b"<").replace(b"</" + mark, b"</") if mark else held


def _after_head(data: bytes) -> int:
    """Where an XML text goes on after its declaration, comments and document type."""
    at = 0
    while (at := data.find(b"<", at)) >= 0 and data[at + 1 : at + 2] in (b"?", b"!"):
        end = data.find(b"-->", at) if data.startswith(b"<!--", at) else data.find(b">", at)
        if end < 0:
            return len(data)
        at = end + 1
    return len(data) if at < 0 else at
