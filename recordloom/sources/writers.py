"""Spark data sources for results that are files of their own: workbooks, and one file for each record.

Tasks write what they have under a temporary folder beside the target, each
attempt in its own place, and say where. Only when all tasks are done are these
parts put where readers look; a task that dies, or a job that fails, leaves
nothing there. No row passes the driver.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes that are copied, or compressed, at a time.
COPY = 1 << 20


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, local or an address that pyarrow knows (hdfs, s3, gs), and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Part(WriterCommitMessage):
    """A run of one member's rows, compressed, in a task's file."""

    member: str
    first: int
    file: str
    at: int
    packed: int
    size: int
    crc: int


@dataclass
class Parts(WriterCommitMessage):
    parts: list[Part] = field(default_factory=list)


class _Staging(DataSourceWriter):
    """A writer with a temporary folder of this job beside its target."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.job = uuid.uuid4().hex

    def folder(self) -> tuple[fs.FileSystem, str, str]:
        system, target = place(self.path)
        head, tail = os.path.split(target.rstrip("/"))
        return system, target, f"{head}/.{tail}-{self.job}"

    def clear(self) -> None:
        system, _, temporary = self.folder()
        if system.get_file_info(temporary).type != fs.FileType.NotFound:
            system.delete_dir(temporary)

    def abort(self, messages) -> None:
        self.clear()


def combined(crc: int, other: int, size: int) -> int:
    """The checksum of two texts one after the other, from those of each and the second's length."""
    with_zeros = zeros = 0
    with_zeros, left = crc, size
    while left:
        n = min(left, COPY)
        with_zeros, zeros, left = zlib.crc32(bytes(n), with_zeros), zlib.crc32(bytes(n), zeros), left - n
    return with_zeros ^ other ^ zeros


class WorkbookWriter(_Staging):
    """Writes rows (member, n, xml), sorted by member and n in each task, into the members of one archive.

    Tasks compress their rows so that parts of a member can follow one another;
    the commit copies them into the archive, and adds the heads and tails.
    """

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        import json

        self.heads = {m: tuple(x) for m, x in json.loads(options["members"]).items()}

    def write(self, iterator: Iterator) -> Parts:
        system, _, temporary = self.folder()
        out, stream, name, at = Parts(), None, f"{temporary}/{uuid.uuid4().hex}", 0
        packer = None
        try:
            for row in iterator:
                if stream is None:
                    system.create_dir(temporary, recursive=True)
                    stream = system.open_output_stream(name, compression=None)
                if not out.parts or out.parts[-1].member != row.member:
                    if packer:
                        at += self._put(stream, out.parts[-1], packer.flush(zlib.Z_FULL_FLUSH))
                    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
                    out.parts.append(Part(row.member, row.n, name, at, 0, 0, 0))
                data, part = row.xml.encode(), out.parts[-1]
                part.size, part.crc = part.size + len(data), zlib.crc32(data, part.crc)
                at += self._put(stream, part, packer.compress(data))
            if packer:
                self._put(stream, out.parts[-1], packer.flush(zlib.Z_FULL_FLUSH))
        finally:
            if stream:
                stream.close()
        return out

    @staticmethod
    def _put(stream, part: Part, data: bytes) -> int:
        stream.write(data)
        part.packed += len(data)
        return len(data)

    def commit(self, messages) -> None:
        system, target, temporary = self.folder()
        runs: dict[str, list[Part]] = {m: [] for m in self.heads}
        for message in messages:
            for part in message.parts if message else []:
                runs[part.member].append(part)
        system.create_dir(temporary, recursive=True)
        whole, at, listed = f"{temporary}/whole", 0, []
        with system.open_output_stream(whole, compression=None) as out:
            for member, parts in runs.items():
                parts.sort(key=lambda p: p.first)
                head, tail = (x.encode() for x in self.heads[member])
                ends = [self._packed(x) for x in (head, tail)]
                size, crc = len(head), zlib.crc32(head)
                for part in parts:
                    size, crc = size + part.size, combined(crc, part.crc, part.size)
                size, crc = size + len(tail), combined(crc, zlib.crc32(tail), len(tail))
                packed = sum(map(len, ends)) + sum(p.packed for p in parts) + 2
                if max(size, packed, at) >= 1 << 32:
                    raise ValueError("a workbook of 4 GB or more can't be written")
                name = member.encode()
                common = struct.pack("<HHHHHIIIHH", 20, 0, 8, 0, 33, crc, packed, size, len(name), 0)
                out.write(b"PK\x03\x04" + common + name)
                out.write(ends[0])
                for part in parts:
                    self._copy(system, part, out)
                out.write(ends[1] + b"\x03\x00")  # an empty last block
                listed.append(b"PK\x01\x02" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, at) + name)
                at += 30 + len(name) + packed
            out.write(b"".join(listed))
            out.write(b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(listed), len(listed), sum(map(len, listed)), at, 0))
        system.move(whole, target)
        self.clear()

    @staticmethod
    def _packed(data: bytes) -> bytes:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        return packer.compress(data) + packer.flush(zlib.Z_FULL_FLUSH)

    @staticmethod
    def _copy(system: fs.FileSystem, part: Part, out) -> None:
        with system.open_input_file(part.file) as source:
            source.seek(part.at)
            left = part.packed
            while left:
                data = source.read(min(left, COPY))
                out.write(data)
                left -= len(data)


@dataclass
class Written(WriterCommitMessage):
    folder: str


class RecordWriter(_Staging):
    """Writes each row (folder, name, body) as the file ``path``/folder/name, which replaces one of that name."""

    def write(self, iterator: Iterator) -> Written:
        system, _, temporary = self.folder()
        own, made = f"{temporary}/{uuid.uuid4().hex}", set()
        for row in iterator:
            inside = f"{own}/{row.folder}"
            if inside not in made:
                system.create_dir(inside, recursive=True)
                made.add(inside)
            with system.open_output_stream(f"{inside}/{row.name}", compression=None) as out:
                out.write(row.body.encode())
        return Written(own if made else "")

    def commit(self, messages) -> None:
        system, target, _ = self.folder()
        made = set()
        for own in (m.folder for m in messages if m and m.folder):
            for info in system.get_file_info(fs.FileSelector(own, recursive=True)):
                if info.type == fs.FileType.File:
                    final = f"{target}/{info.path[len(own) :].lstrip('/')}"
                    if (folder := os.path.dirname(final)) not in made:
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                    system.move(info.path, final)
        self.clear()


class Workbook(DataSource):
    """Options: path, and members, a JSON object of each member's head and tail."""

    @classmethod
    def name(cls) -> str:
        return "recordloom_workbook"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(self.options)


class Records(DataSource):
    """Option: path."""

    @classmethod
    def name(cls) -> str:
        return "recordloom_records"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return RecordWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbook)
    spark.dataSource.register(Records)
