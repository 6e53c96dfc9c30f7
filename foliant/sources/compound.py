"""Compound files (the container of version-5 documents): a reader and a writer, 512-byte sectors, in plain Python."""

from __future__ import annotations

import struct

_MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
_END, _FREE, _FAT = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD
_CUTOFF, _MINI = 4096, 64


def _chain(table: tuple[int, ...] | list[int], at: int) -> list[int]:
    out = []
    while at < len(table):
        out.append(at)
        if len(out) > len(table):
            raise ValueError("sector chain runs in a circle")
        at = table[at]
    return out


def read(data: bytes) -> dict[str, bytes]:
    """Streams by path, in path order; raises ValueError for what isn't a compound file."""
    if data[:8] != _MAGIC or len(data) < 512:
        raise ValueError("not a compound file")
    size = 1 << struct.unpack_from("<H", data, 30)[0]
    first_dir, first_mini, first_difat = struct.unpack_from("<I", data, 48)[0], struct.unpack_from("<I", data, 60)[0], struct.unpack_from("<I", data, 68)[0]
    sector = lambda n: data[size * (n + 1) : size * (n + 2)]
    difat = list(struct.unpack_from("<109I", data, 76))
    while first_difat < _FAT:
        more = struct.unpack(f"<{size // 4}I", sector(first_difat))
        difat += more[:-1]
        first_difat = more[-1]
    fat = [x for n in difat if n < _FAT for x in struct.unpack(f"<{size // 4}I", sector(n).ljust(size, b"\xff"))]
    whole = lambda n: b"".join(map(sector, _chain(fat, n)))
    directory = whole(first_dir)
    minifat_bytes = whole(first_mini)
    minifat = struct.unpack(f"<{len(minifat_bytes) // 4}I", minifat_bytes)
    entries = []
    for at in range(0, len(directory) - 127, 128):
        e = directory[at : at + 128]
        n = struct.unpack_from("<H", e, 64)[0]
        entries.append((e[: max(0, n - 2)].decode("utf-16-le"), e[66], *struct.unpack_from("<3I", e, 68), *struct.unpack_from("<IQ", e, 116)))
    mini = whole(entries[0][5])
    out: dict[str, bytes] = {}
    todo = [(entries[0][4], "")]
    seen = set()
    while todo:
        at, folder = todo.pop()
        if at >= len(entries) or at in seen:
            continue
        seen.add(at)
        name, kind, left, right, child, start, length = entries[at]
        length &= 0xFFFFFFFF
        todo += [(left, folder), (right, folder)]
        if kind == 1:
            todo.append((child, f"{folder}/{name}"))
        elif kind == 2:
            body = b"".join(mini[_MINI * n : _MINI * (n + 1)] for n in _chain(minifat, start)) if length < _CUTOFF else whole(start)
            out[f"{folder}/{name}"] = body[:length]
    return dict(sorted(out.items()))


def write(streams: dict[str, bytes]) -> bytes:
    """A compound file of the streams, by path. Folders come from the paths."""
    nodes: list[dict] = [{"name": "Root Entry", "kind": 5, "kids": {}}]
    for path, body in sorted(streams.items()):
        at = 0
        *folders, leaf = path.strip("/").split("/")
        for f in folders:
            if f not in nodes[at]["kids"]:
                nodes[at]["kids"][f] = len(nodes)
                nodes.append({"name": f, "kind": 1, "kids": {}})
            at = nodes[at]["kids"][f]
        nodes[at]["kids"][leaf] = len(nodes)
        nodes.append({"name": leaf, "kind": 2, "kids": {}, "body": body})
    for n in nodes:
        n |= {"left": _FREE, "right": _FREE, "child": _FREE, "start": _END if n["kind"] == 2 else 0, "size": len(n.get("body", b""))}

    def tree(ids: list[int]) -> int:
        if not ids:
            return _FREE
        m = len(ids) // 2
        nodes[ids[m]] |= {"left": tree(ids[:m]), "right": tree(ids[m + 1 :])}
        return ids[m]

    for n in nodes:
        n["child"] = tree([i for _, i in sorted(n["kids"].items(), key=lambda kv: (len(kv[0].encode("utf-16-le")), kv[0].upper()))])
    fat: list[int] = []
    sectors: list[bytes] = []

    def put(body: bytes) -> int:
        if not body:
            return _END
        start, count = len(fat), -(-len(body) // 512)
        fat.extend([*range(start + 1, start + count), _END])
        sectors.extend(body[i : i + 512].ljust(512, b"\0") for i in range(0, len(body), 512))
        return start

    mini, minifat = bytearray(), []
    for n in nodes:
        body = n.get("body", b"")
        if len(body) >= _CUTOFF:
            n["start"] = put(body)
        elif body:
            n["start"], count = len(minifat), -(-len(body) // _MINI)
            minifat.extend([*range(n["start"] + 1, n["start"] + count), _END])
            mini += body.ljust(count * _MINI, b"\0")
    nodes[0] |= {"start": put(bytes(mini)), "size": len(mini)}
    first_mini = put(struct.pack(f"<{len(minifat)}I", *minifat).ljust(-(-len(minifat) * 4 // 512) * 512, b"\xff"))
    raw = b"".join(
        (n["name"].encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB3I16xI8x8xIQ", 2 * len(n["name"]) + 2, n["kind"], 1, n["left"], n["right"], n["child"], 0, n["start"], n["size"]) for n in nodes
    )
    blank = bytes(68) + struct.pack("<3I", _FREE, _FREE, _FREE) + bytes(48)
    first_dir = put(raw + blank * (-len(nodes) % 4))
    n_fat = n_difat = 0
    while True:  # the table holds its own sectors too
        want = -(-(len(fat) + n_fat + n_difat) // 128)
        extra = -(-max(0, want - 109) // 127)
        if (want, extra) == (n_fat, n_difat):
            break
        n_fat, n_difat = want, extra
    at = len(fat)
    fat += [_FAT] * n_fat + [0xFFFFFFFC] * n_difat
    table = struct.pack(f"<{n_fat * 128}I", *fat, *[_FREE] * (n_fat * 128 - len(fat)))
    places = [*range(at, at + n_fat)]
    difat = b""
    for i in range(n_difat):
        part = places[109 + 127 * i : 109 + 127 * (i + 1)]
        difat += struct.pack("<128I", *part, *[_FREE] * (127 - len(part)), at + n_fat + i + 1 if i + 1 < n_difat else _END)
    n_mini = -(-len(minifat) * 4 // 512)
    head = _MAGIC + bytes(16) + struct.pack("<5H6x9I", 0x3E, 3, 0xFFFE, 9, 6, 0, n_fat, first_dir, 0, _CUTOFF, first_mini if minifat else _END, n_mini, at + n_fat if n_difat else _END, n_difat)
    head += struct.pack("<109I", *places[:109], *[_FREE] * (109 - len(places[:109])))
    return head + b"".join(sectors) + table + difat
