"""Reader and writer of packed vector files.

Layout, little-endian: magic "TQLM", version, count and bytes per vector (each u32), then, zstd-compressed from version 2 on, dimension
u32, bits u8 and count records of a 36-byte id padded with zeros, a float32 norm and the packed codes.
"""

from __future__ import annotations

import os
import struct

import zstandard
from pyspark.sql import DataFrame, SparkSession

MAGIC, ID_BYTES = b"TQLM", 36


def parse(data: bytes) -> tuple[int, int, list[tuple[str, float, bytes]]]:
    """(dimension, bits, [(id, norm, codes)]). ValueError for anything else."""
    if data[:4] != MAGIC or len(data) < 16:
        raise ValueError("no vector file")
    version, count, width = struct.unpack_from("<III", data, 4)
    body = data[16:] if version == 1 else zstandard.ZstdDecompressor().decompressobj().decompress(data[16:])
    dim, bits = struct.unpack_from("<IB", body)
    if width != 4 + -(-dim * bits // 8) or len(body) < 5 + count * (ID_BYTES + width):
        raise ValueError("vector file is damaged")
    out = []
    for k in range(count):
        at = 5 + k * (ID_BYTES + width)
        name = body[at : at + ID_BYTES].rstrip(b"\0").decode()
        out.append((name, struct.unpack_from("<f", body, at + ID_BYTES)[0], body[at + ID_BYTES + 4 : at + ID_BYTES + width]))
    return dim, bits, out


def build(dim: int, bits: int, rows: list[tuple[str, float, bytes]], version: int = 2) -> bytes:
    """The bytes of a vector file. Ids of more than 36 bytes are refused."""
    body = bytearray(struct.pack("<IB", dim, bits))
    for name, norm, codes in rows:
        raw = name.encode()
        if len(raw) > ID_BYTES:
            raise ValueError(f"id of more than {ID_BYTES} bytes")
        body += raw.ljust(ID_BYTES, b"\0") + struct.pack("<f", norm) + bytes(codes)
    packed = bytes(body) if version == 1 else zstandard.ZstdCompressor().compress(bytes(body))
    return MAGIC + struct.pack("<III", version, len(rows), 4 + -(-dim * bits // 8)) + packed


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, norm, codes) of one file; files of this kind fit in memory by their format."""
    with open(path, "rb") as f:
        return spark.createDataFrame([(n, v, bytearray(c)) for n, v, c in parse(f.read())[2]], "id string, norm float, codes binary")


def write(index: DataFrame, path: str, dim: int, bits: int) -> None:
    """Write an index (id, norm, codes) to one file, by way of a temporary one beside it."""
    rows = [(r.id, r.norm, bytes(r.codes)) for r in index.orderBy("id").toLocalIterator()]
    with open(path + ".tmp", "wb") as f:
        f.write(build(dim, bits, rows))
    os.replace(path + ".tmp", path)
