"""Random access to the stored members of ZIP archives: central directory, ZIP64, no extraction."""

from __future__ import annotations

import struct
from typing import NamedTuple

from rowfield.llm.store import read_at

_END = struct.Struct("<4sHHHHIIH")
_LOCATOR = struct.Struct("<4sIQI")
_END64 = struct.Struct("<4sQHHIIQQQQ")
_ENTRY = struct.Struct("<4sHHHHHHIIIHHHHHII")
_LOCAL = struct.Struct("<4sHHHHHIIIHH")
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


class Member(NamedTuple):
    name: str
    method: int
    size: int
    stored_size: int
    header: int
    crc: int


def directory(file) -> list[Member]:
    """The members that the central directory lists, in its order. file: seek, read, size."""
    size = file.size()
    tail = read_at(file, max(0, size - _END.size - _MAX16), min(size, _END.size + _MAX16))
    at = len(tail) - _END.size
    while at >= 0 and not (tail[at : at + 4] == b"PK\x05\x06" and _END.unpack_from(tail, at)[7] == len(tail) - at - _END.size):
        at = tail.rfind(b"PK\x05\x06", 0, at + 3)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, length, start, _ = _END.unpack_from(tail, at)
    end = size - len(tail) + at
    if _MAX16 in (count,) or _MAX32 in (length, start):
        mark, _, where, _ = _LOCATOR.unpack(read_at(file, end - _LOCATOR.size, _LOCATOR.size))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        mark, _, _, _, _, _, _, count, length, start = _END64.unpack(read_at(file, where, _END64.size))
        if mark != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
    raw, at, out = read_at(file, start, length), 0, []
    for _ in range(count):
        mark, _, _, flags, method, _, _, crc, stored, plain, n_name, n_extra, n_comment, _, _, _, header = _ENTRY.unpack_from(raw, at)
        if mark != b"PK\x01\x02":
            raise ValueError("broken central directory")
        at += _ENTRY.size
        name = raw[at : at + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        plain, stored, header = _wide(raw[at + n_name : at + n_name + n_extra], plain, stored, header)
        at += n_name + n_extra + n_comment
        out.append(Member(name, method, plain, stored, header, crc))
    return out


def _wide(extra: bytes, *values: int) -> list[int]:
    """Values of all ones are in the ZIP64 extra field, in this order."""
    at, out = 0, list(values)
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            place = at + 4
            for i, v in enumerate(out):
                if v == _MAX32:
                    (out[i],) = struct.unpack_from("<Q", extra, place)
                    place += 8
        at += 4 + length
    return out


def data_offset(file, member: Member) -> int:
    """Where the bytes of a stored member begin; the local header's own lengths count."""
    if member.method:
        raise ValueError(f"{member.name} is compressed by method {member.method}; only stored members have ranges")
    mark, *_, n_name, n_extra = _LOCAL.unpack(read_at(file, member.header, _LOCAL.size))
    if mark != b"PK\x03\x04":
        raise ValueError("broken local header")
    return member.header + _LOCAL.size + n_name + n_extra
