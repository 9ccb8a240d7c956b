"""Object modules and libraries in the Intel/Microsoft OMF format: modules, segments with masks, publics."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from .binary import parsed

#: Record types of the format (the low bit marks 32-bit forms).
THEADR, LHEADR, MODEND, PUBDEF, LNAMES, SEGDEF, FIXUPP, LEDATA, LIDATA, LIBHDR, LIBEND = 0x80, 0x82, 0x8A, 0x90, 0x96, 0x98, 0x9C, 0xA0, 0xA2, 0xF0, 0xF1
#: Bytes that a fixup of each location type covers.
LOCATION_BYTES = {0: 1, 1: 2, 2: 2, 3: 4, 4: 1, 5: 2, 9: 4, 11: 6, 13: 4}


def records(data: bytes, at: int = 0):
    """(type, body, next position) of consecutive records."""
    while at + 3 <= len(data):
        kind, size = struct.unpack_from("<BH", data, at)
        if size == 0 or at + 3 + size > len(data):
            return
        yield kind, data[at + 3 : at + 2 + size], at + 3 + size
        at += 3 + size


class Reader:
    def __init__(self, body: bytes):
        self.body, self.at = body, 0

    def more(self) -> bool:
        return self.at < len(self.body)

    def u8(self) -> int:
        self.at += 1
        return self.body[self.at - 1]

    def u16(self) -> int:
        self.at += 2
        return struct.unpack_from("<H", self.body, self.at - 2)[0]

    def number(self, wide: bool) -> int:
        if not wide:
            return self.u16()
        self.at += 4
        return struct.unpack_from("<I", self.body, self.at - 4)[0]

    def index(self) -> int:
        a = self.u8()
        return (a & 0x7F) << 8 | self.u8() if a & 0x80 else a

    def frame(self, method: int) -> None:
        """Skip what a frame method is followed by: an index, a frame number, or nothing."""
        if method < 3:
            self.index()
        elif method == 3:
            self.at += 2

    def name(self) -> str:
        n = self.u8()
        self.at += n
        return self.body[self.at - n : self.at].decode("latin-1")


class Module:
    """name, segments {index: [name, class, data, mask]}, publics [(segment, offset, name)], start (segment, offset)."""

    def __init__(self, name: str):
        self.name, self.segments, self.publics, self.start = name, {}, [], None
        self._names = [""]
        self._last: tuple[int, int, int] | None = None

    def feed(self, kind: int, body: bytes) -> None:
        r, wide = Reader(body), bool(kind & 1)
        base = kind & 0xFE
        if base == LNAMES:
            while r.more():
                self._names.append(r.name())
        elif base == SEGDEF:
            acbp = r.u8()
            if acbp >> 5 == 0:
                r.at += 3
            size = r.number(wide) or (0x10000 if acbp & 2 else 0)
            name, kind_ = self._names[r.index()], self._names[r.index()]
            self.segments[len(self.segments) + 1] = [name, kind_, bytearray(size), bytearray(size)]
        elif base == PUBDEF:
            r.index()
            seg = r.index()
            if not seg:
                r.u16()
            while r.more():
                name, off = r.name(), r.number(wide)
                r.index()
                self.publics.append((seg, off, name))
        elif base == LEDATA:
            seg, off = r.index(), r.number(wide)
            self._put(seg, off, body[r.at :])
        elif base == LIDATA:
            seg, off = r.index(), r.number(wide)
            data = b""
            while r.more():
                data += self._iterated(r, wide)
            self._put(seg, off, data)
        elif base == FIXUPP and self._last:
            self._fixups(r, wide)
        elif base == MODEND and r.more() and r.u8() & 0x40 and r.more():
            fix = r.u8()
            if not fix & 0x80:
                r.frame(fix >> 4 & 7)
            target = None if fix & 0x08 else r.index()
            self.start = (target, r.number(wide) if not fix & 0x04 else 0)

    def _put(self, seg: int, off: int, data: bytes) -> None:
        if seg in self.segments:
            _, _, held, mask = self.segments[seg]
            n = max(0, min(len(data), len(held) - off))
            held[off : off + n] = data[:n]
            mask[off : off + n] = b"\1" * n
            self._last = (seg, off, len(data))

    def _iterated(self, r: Reader, wide: bool) -> bytes:
        times, blocks = r.number(wide), r.u16()
        if blocks:
            inner = b"".join(self._iterated(r, wide) for _ in range(blocks))
        else:
            n = r.u8()
            inner = r.body[r.at : r.at + n]
            r.at += n
        return inner * times

    def _fixups(self, r: Reader, wide: bool) -> None:
        seg, off, _ = self._last
        mask = self.segments[seg][3]
        while r.more():
            a = r.u8()
            if not a & 0x80:  # a thread definition, of a frame or a target
                if a & 0x40:
                    r.frame(a >> 2 & 7)
                elif (a >> 2 & 7) < 4:
                    r.index()
                continue
            where = (a & 3) << 8 | r.u8()
            n = LOCATION_BYTES.get(a >> 2 & 15, 2)
            at = off + where
            mask[at : at + n] = bytes(len(mask[at : at + n]))
            fix = r.u8()
            if not fix & 0x80:
                r.frame(fix >> 4 & 7)
            if not fix & 0x08:
                r.index()
            if not fix & 0x04:
                r.number(wide)


def modules(data: bytes) -> list[Module]:
    """The modules of a library or a single object file."""
    out: list[Module] = []
    page, at = 1, 0
    if data[:1] == bytes([LIBHDR]) and len(data) >= 3:
        page = struct.unpack_from("<H", data, 1)[0] + 3
        at = page
    here: Module | None = None
    while at < len(data):
        moved = False
        for kind, body, nxt in records(data, at):
            at, moved = nxt, True
            if kind in (THEADR, LHEADR):
                here = Module(Reader(body).name())
            elif kind == LIBEND:
                return out
            elif here is not None:
                here.feed(kind, body)
                if kind & 0xFE == MODEND:
                    out.append(here)
                    here = None
                    at = -(-at // page) * page
                    break
        if not moved:
            break
    return out


def parse_segments(data: bytes) -> list[tuple]:
    return [
        (m.name, i, name, kind, len(held), bytes(held), "".join("1" if x else "0" for x in mask), sum(mask))
        for m in modules(data)
        for i, (name, kind, held, mask) in m.segments.items()
    ]


def segments(files: DataFrame) -> DataFrame:
    """One row for each segment of each module, with its bytes and which of them are fixed."""
    return parsed(files, parse_segments, "module string, segment int, name string, class string, size int, data binary, mask string, fixed_bytes int")


def publics(files: DataFrame) -> DataFrame:
    return parsed(files, lambda c: [(m.name, s, o, n) for m in modules(c) for s, o, n in m.publics], "module string, segment int, off bigint, name string")


def code_signatures(segs: DataFrame) -> DataFrame:
    """Signatures (name, module, bytes, mask) of code segments, for sources.signatures."""
    from pyspark.sql import functions as F

    code = segs.where(F.upper("class").contains("CODE") & (F.col("fixed_bytes") > 0))
    return code.select("name", "module", F.lower(F.hex("data")).alias("bytes"), "mask")
