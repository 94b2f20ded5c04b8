"""Byte formats: framed log records with a Castagnoli checksum, and length-prefixed pairs."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# The reversed Castagnoli polynomial, the record frame (length, checksum, type), the largest record.
CASTAGNOLI = 0x82F63B78
FRAME = struct.Struct("<IIB")
MOST = 64 << 20


def _table() -> list[int]:
    rows = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (CASTAGNOLI if k & 1 else 0)
        rows.append(k)
    return rows


_TABLE = _table()


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for octet in data:
        crc = crc >> 8 ^ _TABLE[(crc ^ octet) & 0xFF]
    return crc ^ 0xFFFFFFFF


def frame(kind: int, data: bytes) -> bytes:
    return FRAME.pack(len(data), crc32c(bytes([kind]) + data), kind) + data


def valid_prefix(log: bytes) -> tuple[list[tuple[int, bytes]], int]:
    """The records up to the first torn or damaged one, and the length of their bytes."""
    records, at = [], 0
    while at + FRAME.size <= len(log):
        size, crc, kind = FRAME.unpack_from(log, at)
        data = log[at + FRAME.size : at + FRAME.size + size]
        if size > MOST or len(data) < size or crc32c(bytes([kind]) + data) != crc:
            break
        records.append((kind, data))
        at += FRAME.size + size
    return records, at


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def encode_pairs(pairs: Iterable[tuple[bytes, bytes]]) -> bytes:
    return b"".join(_varint(len(x)) + x for pair in pairs for x in pair)


def decode_pairs(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0

    def field() -> bytes:
        nonlocal at
        size = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise ValueError("damaged pairs")
            octet = data[at]
            at += 1
            size |= (octet & 0x7F) << shift
            shift += 7
            if octet < 0x80:
                break
        if len(data) - at < size:
            raise ValueError("damaged pairs")
        at += size
        return data[at - size : at]

    while at < len(data):
        yield field(), field()


#: Pairs of an image at most: a shard of any size is many images.
PAIRS = 1024


def packed(state: DataFrame) -> DataFrame:
    """state (shard, key, value) as images of pairs (shard, pairs binary), of one shard and at most PAIRS pairs each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for shard, part in t.groupby("shard"):
                for lo in range(0, len(part), PAIRS):
                    few = part.iloc[lo : lo + PAIRS]
                    image = encode_pairs((k.encode(), v.encode()) for k, v in zip(few["key"], few["value"], strict=True))
                    yield pd.DataFrame({"shard": [shard], "pairs": [image]})

    return state.select("shard", "key", "value").sortWithinPartitions("shard").mapInPandas(run, "shard int, pairs binary")


def unpacked(images: DataFrame) -> DataFrame:
    """(shard, key, value) of images (shard, pairs); a damaged one raises ValueError."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for shard, image in zip(t["shard"], t["pairs"], strict=True):
                pairs = list(decode_pairs(bytes(image)))
                yield pd.DataFrame({"shard": [shard] * len(pairs), "key": [k.decode() for k, _ in pairs], "value": [v.decode() for _, v in pairs]})

    return images.mapInPandas(run, "shard int, key string, value string")
