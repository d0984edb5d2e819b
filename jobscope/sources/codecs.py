"""Decoding of files in the lz4 block and snappy stream framings.

These framings are not readable by Spark's text source.  One file is one
record; its blocks are decompressed one by one inside the task by pyarrow, and
lines are handed on in batches.  A file that is damaged, or still being written,
gives the lines before the damage and then one line that is no event, which
log validation counts as corrupt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Suffixes, magic numbers and header layouts of the two public framings.
FRAMED_SUFFIXES = (".lz4", ".snappy")
LZ4_MAGIC = b"LZ4Block"
LZ4_HEADER = 21
LZ4_STORED = 0x10
SNAPPY_MAGIC = b"\x82SNAPPY\x00"
SNAPPY_HEADER = 16

#: What stands for the part of a file that can't be decoded.  It is no JSON.
DAMAGED = "\ufffd damaged file"
LINES_AT_ONCE = 4096
#: A block of either framing holds far less; a greater length is damage.
MOST_BLOCK_BYTES = 1 << 28
LINE_END = re.compile(rb"\r\n|\r|\n")


class DamagedFile(ValueError):
    """The bytes do not follow the framing."""


def lz4_blocks(data: memoryview) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        head = data[at:at + LZ4_HEADER]
        if len(head) < LZ4_HEADER or head[:8] != LZ4_MAGIC:
            raise DamagedFile("not an lz4 block stream")
        packed = int.from_bytes(head[9:13], "little")
        plain = int.from_bytes(head[13:17], "little")
        body = data[at + LZ4_HEADER:at + LZ4_HEADER + packed]
        if len(body) < packed or plain > MOST_BLOCK_BYTES:
            raise DamagedFile("cut off inside a block")
        if plain and head[8] & 0xF0 == LZ4_STORED:
            yield bytes(body)
        elif plain:
            yield pa.decompress(bytes(body), decompressed_size=plain, codec="lz4_raw", asbytes=True)
        at += LZ4_HEADER + packed


def _varint(data: memoryview) -> int:
    value = shift = 0
    for byte in data[:5]:
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value
        shift += 7
    raise DamagedFile("no length")


def snappy_blocks(data: memoryview) -> Iterator[bytes]:
    if data[:len(SNAPPY_MAGIC)] != SNAPPY_MAGIC:
        raise DamagedFile("not a snappy block stream")
    at = SNAPPY_HEADER
    while at < len(data):
        if data[at:at + len(SNAPPY_MAGIC)] == SNAPPY_MAGIC:
            at += SNAPPY_HEADER
            continue
        size = int.from_bytes(data[at:at + 4], "big")
        body = data[at + 4:at + 4 + size]
        if at + 4 + size > len(data) or (plain := _varint(body)) > MOST_BLOCK_BYTES:
            raise DamagedFile("cut off inside a block")
        yield pa.decompress(bytes(body), decompressed_size=plain, codec="snappy", asbytes=True)
        at += 4 + size


def file_lines(path: str, data: bytes | memoryview) -> Iterator[str]:
    """The lines of a file, as far as it can be decoded, then ``DAMAGED`` if there is more of it."""
    blocks = (lz4_blocks if path.lower().endswith(".lz4") else snappy_blocks)(memoryview(data).cast("B"))
    rest, damaged = b"", False
    while True:
        try:
            block = next(blocks, None)
        except (DamagedFile, pa.ArrowException, OSError):
            block, damaged = None, True
        if block is None:
            break
        rest += block
        # a carriage return at the end may be half of a line end
        whole = len(rest) - 1 if rest.endswith(b"\r") else len(rest)
        *lines, tail = LINE_END.split(rest[:whole])
        rest = tail + rest[whole:]
        yield from (line.decode("utf-8", errors="replace") for line in lines)
    yield from (line.decode("utf-8", errors="replace") for line in LINE_END.split(rest) if line)
    if damaged:
        yield DAMAGED


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            path, at, held = path.as_py(), 0, []
            for line in file_lines(path, content.as_buffer()):
                held.append(line)
                if len(held) == LINES_AT_ONCE:
                    yield _batch(path, at, held)
                    at, held = at + len(held), []
            if held:
                yield _batch(path, at, held)


def _batch(path: str, at: int, lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(lines), pa.string()), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.string())],
        names=["path", "at", "value"])


def decode_framed_files(files: DataFrame) -> DataFrame:
    """``path, name, at, value`` of the lines of framed files, given their ``path`` and ``content``."""
    from jobscope.sources.eventlog import base_name, is_event_file

    lines = (
        files.where(is_event_file(base_name(F.col("path")))).select("path", "content")
        .mapInArrow(_decode, "path string, at bigint, value string")
    )
    return lines.where(F.col("value").rlike(r"\S")).select("path", base_name(F.col("path")).alias("name"), "at", "value")
