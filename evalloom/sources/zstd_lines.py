"""Data source ``zstd_lines``: JSON-lines archives in zstandard frames that several tasks read, and a sink that writes them.

The sink ends a frame after every ``frame_bytes`` of whole lines and a file with the published seek table, so a reader knows every frame
from the last bytes of a file. Archives of other writers have no table: their frames are found by walking the block headers, which
reads a few bytes of each block. Frames next to each other make a partition of about ``split_bytes``; every frame is read once. In a file
without a seek table a line may cross frames, so such a file is cut only where a frame begins after a line feed.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# fixed values of the frame and seek-table formats
FRAME_MAGIC = 0xFD2FB528
SKIP_MAGIC, SKIP_MASK = 0x184D2A50, 0xFFFFFFF0
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEK_FOOTER_MAGIC = 0x8F92EAB1
DICTIONARY_BYTES = (0, 1, 2, 4)
CONTENT_BYTES = (0, 2, 4, 8)

FRAME_BYTES = 1 << 20  # of text in one frame
SPLIT_BYTES = 16 << 20  # of compressed text in one partition
BATCH_LINES = 4096
READ_BYTES = 1 << 20
SUFFIX = ".jsonl.zst"


@dataclass
class Stretch(InputPartition):
    """Bytes ``start`` to ``stop`` of a file: whole frames that begin and end with whole lines."""

    path: str
    start: int
    stop: int


def seek_table(source: pa.NativeFile, size: int) -> list[tuple[int, int]] | None:
    """``(start, stop)`` of the frames listed in the seek table at the end of a file; None without a table."""
    if size < 17:
        return None
    number, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
    width = 12 if flags & 0x80 else 8
    length = number * width + 9
    if magic != SEEK_FOOTER_MAGIC or size < length + 8:
        return None
    head = struct.unpack("<II", source.read_at(8, size - length - 8))
    if head != (SEEK_TABLE_MAGIC, length):
        return None
    entries, at, out = source.read_at(number * width, size - length), 0, []
    for i in range(number):
        packed = struct.unpack_from("<I", entries, i * width)[0]
        out.append((at, at + packed))
        at += packed
    return out


def frame_end(source: pa.NativeFile, at: int) -> tuple[int, bool]:
    """Byte after the frame at ``at``, by its block headers, and whether it holds text."""
    magic, more = struct.unpack("<II", source.read_at(8, at).ljust(8, b"\0"))
    if magic & SKIP_MASK == SKIP_MAGIC:
        return at + 8 + more, False
    if magic != FRAME_MAGIC:
        raise ValueError(f"no zstandard frame at byte {at}")
    flags = more & 0xFF
    single = flags >> 5 & 1
    content = CONTENT_BYTES[flags >> 6] or single
    at += 5 + (1 - single) + DICTIONARY_BYTES[flags & 3] + content
    while True:
        header = int.from_bytes(source.read_at(3, at), "little")
        at += 3 + (1 if header >> 1 & 3 == 1 else header >> 3)
        if header & 1:
            return at + 4 * (flags >> 2 & 1), True


def walked_frames(source: pa.NativeFile, size: int) -> list[tuple[int, int]]:
    out, at = [], 0
    while at < size:
        stop, text = frame_end(source, at)
        if text:
            out.append((at, stop))
        at = stop
    return out


def ends_line(source: pa.NativeFile, frame: tuple[int, int]) -> bool:
    """True if the text of a frame ends with a line feed."""
    source.seek(frame[0])
    last, left = b"", frame[1] - frame[0]
    stream = zstandard.ZstdDecompressor().decompressobj()
    while left > 0:
        part = source.read(min(READ_BYTES, left))
        left -= len(part)
        last = (stream.decompress(part) or last)[-1:]
    return last in (b"\n", b"")


def stretches(path: str, source: pa.NativeFile, size: int, split_bytes: int) -> Iterator[Stretch]:
    """Partitions of a file: frames in order, closed at about ``split_bytes`` where a line ends."""
    frames = seek_table(source, size)
    listed = frames is not None
    if not listed:
        frames = walked_frames(source, size) if size > split_bytes else [(0, size)] if size else []
    start = None
    for number, (a, b) in enumerate(frames):
        start = a if start is None else start
        last = number + 1 == len(frames)
        if last or (b - start >= split_bytes and (listed or ends_line(source, (a, b)))):
            yield Stretch(path, start, b)
            start = None


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Stretch]:
        system, base = pafs.FileSystem.from_uri(self.path)
        found = system.get_file_info(base)
        files = [found] if found.is_file else [
            f for f in system.get_file_info(pafs.FileSelector(base, recursive=True)) if f.is_file and f.path.endswith((".zst", ".zstd"))
        ]
        out: list[Stretch] = []
        for file in sorted(files, key=lambda f: f.path):
            with system.open_input_file(file.path) as source:
                out.extend(stretches(file.path, source, file.size, self.split))
        return out or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = pafs.FileSystem.from_uri(self.path)
        lines, rest = [], b""
        with system.open_input_file(partition.path) as source:
            source.seek(partition.start)
            for text in frame_texts(source, partition.stop - partition.start):
                *whole, rest = (rest + text).split(b"\n")
                lines += whole
                while len(lines) >= BATCH_LINES:
                    yield batch_of(lines[:BATCH_LINES])
                    lines = lines[BATCH_LINES:]
        if rest:
            lines.append(rest)
        if lines:
            yield batch_of(lines)


def batch_of(lines: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines], pa.string())], ["value"])


def frame_texts(source: pa.NativeFile, left: int) -> Iterator[bytes]:
    """Text of the next ``left`` bytes, piece by piece, over any number of frames."""
    unpack = zstandard.ZstdDecompressor()
    stream = unpack.decompressobj()
    while left > 0:
        data = source.read(min(READ_BYTES, left))
        left -= len(data)
        while data:
            text = stream.decompress(data)
            if text:
                yield text
            if not stream.eof:
                break
            data, stream = stream.unused_data, unpack.decompressobj()


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class LineWriter(DataSourceArrowWriter):
    """A file per task under a name that no other attempt has; it gets its suffix, and so is seen by readers, when the job commits."""

    def __init__(self, options: dict):
        self.path, self.frame = options["path"], int(options.get("frame_bytes", FRAME_BYTES))
        self.level = int(options.get("level", 3))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = pafs.FileSystem.from_uri(self.path)
        system.create_dir(base, recursive=True)
        name, rows, sizes, held, length = f"{base}/{uuid.uuid4().hex}", 0, [], [], 0
        squeeze = zstandard.ZstdCompressor(level=self.level, write_checksum=True)
        with system.open_output_stream(name, compression=None) as out:
            def close() -> None:
                text = b"".join(held)
                packed = squeeze.compress(text)
                out.write(packed)
                sizes.append((len(packed), len(text)))

            for batch in iterator:
                for line in batch.column(0).to_pylist():
                    if line is None:
                        continue
                    if "\n" in line:
                        raise ValueError("a line holds a line feed")
                    held.append(line.encode() + b"\n")
                    length += len(held[-1])
                    rows += 1
                    if length >= self.frame:
                        close()
                        held, length = [], 0
            if held:
                close()
            table = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEK_FOOTER_MAGIC)
            out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(table)) + table)
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            if message is not None and message.rows:
                system.move(message.path, message.path + SUFFIX)
            elif message is not None:
                system.delete_file(message.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            if message is not None:
                system.delete_file(message.path)


class ZstdLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zstd_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> LineWriter:
        if overwrite:
            raise ValueError("zstd_lines only appends")
        return LineWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZstdLines)
