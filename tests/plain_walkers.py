"""Plain readers of one byte string, which the lock-step ones are held against."""

from __future__ import annotations


def rtcp_parts(data: bytes) -> list[tuple]:
    """(idx, bytes) of the packets back to back in a datagram, while four octets are left; the last may be cut short."""
    parts, at = [], 0
    while len(data) - at >= 4:
        size = 4 * (int.from_bytes(data[at + 2 : at + 4], "big") + 1)
        parts.append((len(parts), data[at : at + size]))
        at += size
    return parts


def sdes_items(data: bytes) -> list[tuple]:
    """(chunk, ssrc, type, text) of a source description's items; each chunk ends with a zero octet, on a 32-bit boundary."""
    items, at = [], 4
    end = min(len(data), 4 * (int.from_bytes(data[2:4], "big") + 1)) if len(data) >= 4 else 0
    for chunk in range(data[0] & 31 if data else 0):
        if end - at < 4:
            break
        ssrc = int.from_bytes(data[at : at + 4], "big")
        at += 4
        while at < end and data[at]:
            size = data[at + 1] if at + 1 < end else 0
            items.append((chunk, ssrc, data[at], data[at + 2 : min(end, at + 2 + size)].decode("utf-8", "replace")))
            at += 2 + size
        at += 4 - at % 4
    return items


def red_blocks(data: bytes) -> list[tuple]:
    """(idx, pt, ts_offset, bytes) of a redundant payload: older blocks first, the primary one last with offset 0."""
    heads, at = [], 0
    while at < len(data) and data[at] & 128:
        if at + 4 > len(data):
            return []
        word = int.from_bytes(data[at : at + 4], "big")
        heads.append((word >> 24 & 127, word >> 10 & 0x3FFF, word & 0x3FF))
        at += 4
    if at >= len(data):
        return []
    primary = data[at] & 127
    at += 1
    blocks = []
    for pt, offset, size in heads:
        blocks.append((len(blocks), pt, offset, data[at : at + size]))
        at += size
    blocks.append((len(blocks), primary, 0, data[at:]))
    return blocks


def h264_nals(data: bytes) -> list[tuple]:
    """(idx, nal_type, start, end, bytes) of an H.264 payload: single units, STAP-A/B, MTAP16/24, and pieces of FU-A/B."""
    if not data:
        return []
    kind = data[0] & 31
    if kind in (24, 25, 26, 27):
        at = 1 if kind == 24 else 3
        skip = {24: 0, 25: 0, 26: 3, 27: 4}[kind]
        found = []
        while at + 2 <= len(data):
            size = int.from_bytes(data[at : at + 2], "big")
            unit = data[at + 2 + skip : at + 2 + size] if skip else data[at + 2 : at + 2 + size]
            if not unit:
                break
            found.append((len(found), unit[0] & 31, True, True, unit))
            at += 2 + size
        return found
    if kind in (28, 29):
        if len(data) < 2:
            return []
        start, end = bool(data[1] & 128), bool(data[1] & 64)
        body = data[2 if kind == 28 else 4 :]
        return [(0, data[1] & 31, start, end, (bytes([data[0] & 0xE0 | data[1] & 31]) if start else b"") + body)]
    return [(0, kind, True, True, data)]


def interleaved(data: bytes) -> list[tuple]:
    """(idx, channel, offset, bytes) of a connection's bytes: `$` frames with their channel; channel -1 for text between them.

    A `$` opens a frame only where one may start: at the beginning, after a frame, or after a message's blank line and body."""
    parts, at = [], 0
    while at < len(data):
        if data[at] == 0x24:
            if at + 4 > len(data):
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            parts.append((len(parts), data[at + 1], at, data[at + 4 : at + 4 + size]))
            at += 4 + size
            continue
        head = data.find(b"\r\n\r\n", at)
        stop = len(data) if head < 0 else head + 4
        if head >= 0:
            for line in data[at:head].split(b"\r\n"):
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    stop = min(len(data), stop + int(value))
        parts.append((len(parts), -1, at, data[at:stop]))
        at = stop
    return parts
