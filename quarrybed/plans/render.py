"""Files of the formats that sources read, made from rows: hex expressions, and encoders where a layout has to be worked out."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import omf
from ..sources.binary import parsed


def le16(c: Column) -> Column:
    """A little-endian word as hex digits."""
    v = c.cast("int")
    return F.format_string("%02X%02X", v.bitwiseAND(255), F.shiftright(v, 8).bitwiseAND(255))


def le32(c: Column) -> Column:
    v = c.cast("bigint")
    return F.concat(le16(v.bitwiseAND(0xFFFF)), le16(F.shiftright(v, 16)))


def text(c: Column | str) -> Column:
    return F.hex(F.encode(F.lit(c) if isinstance(c, str) else c, "UTF-8"))


def filled(n: Column | int, byte: str = "00") -> Column:
    return F.expr(f"repeat('{byte}', {n})") if isinstance(n, int) else F.repeat(F.lit(byte), n.cast("int"))


def files(df: DataFrame, path: Column, *parts: Column) -> DataFrame:
    """path, content of hex parts."""
    return df.select(path.cast("string").alias("path"), F.unhex(F.concat(*parts)).alias("content"))


def text_files(df: DataFrame, path: Column, *parts: Column) -> DataFrame:
    return df.select(path.cast("string").alias("path"), F.encode(F.concat(*parts), "ISO-8859-1").alias("content"))


def in_order(order: list[Column], value: Column) -> Column:
    """The values of a group, joined in order."""
    held = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("v"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(held)), lambda x: x["v"]), "")


def encoded(df: DataFrame, path: Column, columns: list[str], encode) -> DataFrame:
    """path, content where encode(values) makes a file of a row's columns."""
    import json

    packed = df.select(path.cast("string").alias("path"), F.encode(F.to_json(F.struct(*columns)), "UTF-8").alias("content"))
    return parsed(packed, lambda raw: [(encode(json.loads(raw)),)], "content binary")


# ---------------------------------------------------------------- object modules


def record(kind: int, body: bytes) -> bytes:
    return struct.pack("<BH", kind, len(body) + 1) + body + b"\0"


def counted_name(name: str) -> bytes:
    raw = name.encode()
    return bytes([len(raw)]) + raw


def object_module(name: str, code: bytes, fixed_at: int, public: str, public_at: int) -> bytes:
    """A module of one code segment, with a word at fixed_at that the linker fills in."""
    out = record(omf.THEADR, counted_name(name)) + record(omf.LNAMES, b"\0" + counted_name("_TEXT") + counted_name("CODE"))
    out += record(omf.SEGDEF, b"\x28" + struct.pack("<H", len(code)) + b"\x02\x03\x01")
    out += record(omf.PUBDEF, b"\0\x01" + counted_name(public) + struct.pack("<H", public_at) + b"\0")
    out += record(omf.LEDATA, b"\x01\0\0" + code)
    out += record(omf.FIXUPP, bytes([0xC4 | fixed_at >> 8, fixed_at & 255, 0x56, 1]))
    return out + record(omf.MODEND, b"\0")


# ---------------------------------------------------------------- FAT12 volumes

SECTOR, FOLDER = 512, 0x10
#: Clusters that twelve bits can number: 2 to 0xFEF.
MOST_CLUSTERS = 0xFEE


class Fat12Writer:
    """A volume of one-sector clusters: files in the root and in one folder."""

    def __init__(self):
        self.next, self.links, self.data = 2, {}, b""

    def store(self, content: bytes) -> int:
        """The first cluster of the content's chain."""
        n = max(1, -(-len(content) // SECTOR))
        first = self.next
        if first + n > MOST_CLUSTERS + 2:
            raise ValueError("more clusters than FAT12 can number; use more volumes")
        for c in range(first, first + n):
            self.links[c] = c + 1 if c + 1 < first + n else 0xFFF
        self.next += n
        self.data += content.ljust(n * SECTOR, b"\0")
        return first

    def entry(self, name: str, attribute: int, content: bytes) -> bytes:
        stem, _, ext = name.partition(".")
        size = 0 if attribute & FOLDER else len(content)
        return stem.ljust(8).encode() + ext.ljust(3).encode() + bytes([attribute]) + bytes(14) + struct.pack("<HI", self.store(content), size)

    def volume(self, root: list[bytes]) -> bytes:
        fat = bytearray(-(-(self.next * 3 // 2 + 2) // SECTOR) * SECTOR)
        for c, v in self.links.items():
            at = c * 3 // 2
            word = fat[at] | fat[at + 1] << 8
            fat[at : at + 2] = struct.pack("<H", word & 0x000F | v << 4 if c & 1 else word & 0xF000 | v)
        entries = -(-len(root) // 16) * 16
        boot = bytearray(SECTOR)
        struct.pack_into("<HBHBHHBH", boot, 11, SECTOR, 1, 1, 1, entries, 0, 0xF8, len(fat) // SECTOR)
        return bytes(boot) + bytes(fat) + b"".join(root).ljust(entries * 32, b"\0") + self.data


def fat12_volume(root: list[tuple[str, bytes]], folder: str, inside: list[tuple[str, bytes]]) -> bytes:
    w = Fat12Writer()
    rows = [w.entry(n, 0, c) for n, c in root]
    held = b"".join(w.entry(n, 0, c) for n, c in inside)
    return w.volume([*rows, w.entry(folder, FOLDER, held)])
