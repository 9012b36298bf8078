"""A reader for the common part of HDF5 files, written from the published file format specification, and a small writer.

Read: superblocks 0 to 3, both kinds of object headers, groups by symbol table or compact links, contiguous, compact and chunked
(version 1 B-tree) datasets, the deflate, shuffle and checksum filters, numbers, enumerations, fixed and variable strings, attributes.
Not read: dense link storage, the chunk indexes of later library versions, compound types.

Only the byte ranges that are asked for are read, so tasks can read parts of one file side by side.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

MAGIC = b"\x89HDF\r\n\x1a\n"
NOWHERE = 0xFFFFFFFFFFFFFFFF


def open_file(path: str):
    """A readable, seekable file: local, or of any file system that pyarrow knows by URI."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path)
        return system.open_input_file(place)
    return open(path.removeprefix("file://"), "rb")


@dataclass
class Kind:
    """A datatype: a numpy type, or strings kept elsewhere."""

    dtype: np.dtype
    variable: bool = False
    text: bool = False
    names: dict[int, str] | None = None


@dataclass
class Node:
    """A group or a dataset."""

    file: File
    attrs: dict = field(default_factory=dict)
    links: dict[str, int] = field(default_factory=dict)
    shape: tuple[int, ...] | None = None
    kind: Kind | None = None
    layout: tuple | None = None
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)

    def __contains__(self, name: str) -> bool:
        return name in self.links

    def __getitem__(self, path: str) -> Node:
        node = self
        for part in filter(None, path.split("/")):
            if part not in node.links:
                raise KeyError(f"there is no {part!r} in the file; it has {sorted(node.links)}")
            node = self.file.node(node.links[part])
        return node

    @property
    def is_dataset(self) -> bool:
        return self.layout is not None

    def read(self, low: int = 0, high: int | None = None) -> np.ndarray:
        """Rows low to high along the first axis, all of it for a scalar."""
        shape = self.shape or ()
        whole = not shape
        n = 1 if whole else shape[0]
        high = n if high is None else min(high, n)
        inner = tuple(shape[1:])
        raw = self.file.rows(self, low, max(low, high), inner)
        out = self.file.decode(raw, self.kind)
        out = out.reshape(() if whole else (max(0, high - low), *inner))
        return out


class File:
    def __init__(self, path: str) -> None:
        self.f = open_file(path)
        self.heaps: dict[int, dict[int, bytes]] = {}
        at = 0
        while self.bytes(at, 8) != MAGIC:
            at = 512 if at == 0 else at * 2
            if at > 1 << 26:
                raise ValueError(f"{path} isn't an HDF5 file")
        version = self.bytes(at + 8, 1)[0]
        if version < 2:
            self.o, self.l = self.bytes(at + 13, 2)
            if (self.o, self.l) != (8, 8):
                raise ValueError("files of other than 8-byte addresses aren't read")
            entry = at + 24 + (4 if version == 1 else 0) + 4 * 8
            self.root_at = struct.unpack("<Q", self.bytes(entry + 8, 8))[0]
        else:
            if tuple(self.bytes(at + 9, 2)) != (8, 8):
                raise ValueError("files of other than 8-byte addresses aren't read")
            self.root_at = struct.unpack("<Q", self.bytes(at + 12 + 24, 8))[0]
        self.root = self.node(self.root_at)

    def __getitem__(self, path: str) -> Node:
        return self.root[path]

    def __contains__(self, path: str) -> bool:
        return path in self.root

    def bytes(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    # object headers
    def messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        head = self.bytes(at, 16)
        if head[:4] == b"OHDR":
            flags = head[5]
            start = at + 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(self.bytes(start, width), "little")
            blocks = [(start + width, size)]
            while blocks:
                begin, size = blocks.pop(0)
                data, p = self.bytes(begin, size), 0
                step = 4 + (2 if flags & 4 else 0)
                while p + step <= len(data):
                    kind, n = data[p], int.from_bytes(data[p + 1 : p + 3], "little")
                    body = data[p + step : p + step + n]
                    p += step + n
                    if kind == 0x10:
                        to, length = struct.unpack("<QQ", body[:16])
                        blocks.append((to + 4, length - 8))
                    else:
                        yield kind, body
        else:
            count, size = struct.unpack("<H4xI", head[2:12])
            blocks = [(at + 16, size)]
            while blocks and count > 0:
                begin, size = blocks.pop(0)
                data, p = self.bytes(begin, size), 0
                while p + 8 <= len(data) and count > 0:
                    kind, n = struct.unpack("<HH", data[p : p + 4])
                    body = data[p + 8 : p + 8 + n]
                    p += 8 + n
                    count -= 1
                    if kind == 0x10:
                        blocks.append(struct.unpack("<QQ", body[:16]))
                    else:
                        yield kind, body

    def node(self, at: int) -> Node:
        node = Node(self)
        for kind, body in self.messages(at):
            if kind == 0x01:
                node.shape = self.space(body)
            elif kind == 0x03:
                node.kind = self.type(body)[0]
            elif kind == 0x08:
                node.layout = self.placement(body)
            elif kind == 0x0B:
                node.filters = self.pipeline(body)
            elif kind == 0x0C:
                name, value = self.attribute(body)
                node.attrs[name] = value
            elif kind == 0x11:
                tree, heap = struct.unpack("<QQ", body[:16])
                node.links |= self.symbols(tree, heap)
            elif kind == 0x06:
                link = self.link(body)
                if link:
                    node.links[link[0]] = link[1]
            elif kind == 0x02:
                flags = body[1]
                heap = struct.unpack("<Q", body[2 + (8 if flags & 1 else 0) :][:8])[0]
                if heap != NOWHERE:
                    raise ValueError("groups of dense link storage aren't read")
        return node

    def space(self, body: bytes) -> tuple[int, ...]:
        version, rank = body[0], body[1]
        at = 8 if version == 1 else 4
        return struct.unpack(f"<{rank}Q", body[at : at + 8 * rank])

    def type(self, body: bytes) -> tuple[Kind, int]:
        """The datatype and the number of bytes that describe it."""
        family, bits, size = body[0] & 15, int.from_bytes(body[1:4], "little"), struct.unpack("<I", body[4:8])[0]
        order = ">" if bits & 1 else "<"
        if family == 0:
            return Kind(np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")), 12
        if family == 1:
            return Kind(np.dtype(f"{order}f{size}")), 20
        if family == 3:
            return Kind(np.dtype(f"S{size}"), text=True), 8
        if family == 8:
            base, used = self.type(body[8:])
            names, p, n = [], 8 + used, bits & 0xFFFF
            for _ in range(n):
                end = body.index(b"\0", p)
                names.append(body[p:end].decode())
                p = end + 1 if body[0] >> 4 >= 3 else p + (end - p) // 8 * 8 + 8
            values = np.frombuffer(body[p : p + n * size], base.dtype)
            return Kind(base.dtype, names=dict(zip(values.tolist(), names))), p + n * size
        if family == 9:
            base, used = self.type(body[8:])
            return Kind(np.dtype("V16"), variable=True, text=bits & 15 == 1), 8 + used
        raise ValueError(f"values of type class {family} aren't read")

    def placement(self, body: bytes) -> tuple:
        version, way = body[0], body[1]
        if version not in (3, 4):
            raise ValueError(f"layouts of version {version} aren't read")
        if way == 0:
            n = struct.unpack("<H", body[2:4])[0]
            return ("compact", body[4 : 4 + n])
        if way == 1:
            return ("contiguous", *struct.unpack("<QQ", body[2:18]))
        if version == 4:
            raise ValueError("the chunk indexes of later library versions aren't read")
        rank = body[2]
        return ("chunked", struct.unpack("<Q", body[3:11])[0], struct.unpack(f"<{rank}I", body[11 : 11 + 4 * rank])[:-1])

    def pipeline(self, body: bytes) -> list[tuple[int, tuple[int, ...]]]:
        version, n = body[0], body[1]
        p, out = 8 if version == 1 else 2, []
        for _ in range(n):
            which = struct.unpack("<H", body[p : p + 2])[0]
            p += 2
            named = 0
            if version == 1 or which >= 256:
                named = struct.unpack("<H", body[p : p + 2])[0]
                p += 2
            _, count = struct.unpack("<HH", body[p : p + 4])
            p += 4 + (-(-named // 8) * 8 if version == 1 else named)
            out.append((which, struct.unpack(f"<{count}I", body[p : p + 4 * count])))
            p += 4 * count + (4 if version == 1 and count % 2 else 0)
        return out

    def attribute(self, body: bytes) -> tuple[str, object]:
        version = body[0]
        n_name, n_type, n_space = struct.unpack("<HHH", body[2:8])
        p = 9 if version == 3 else 8
        up = (lambda x: -(-x // 8) * 8) if version == 1 else (lambda x: x)
        name = body[p : p + n_name].split(b"\0")[0].decode()
        p += up(n_name)
        kind = self.type(body[p : p + n_type])[0]
        p += up(n_type)
        shape = self.space(body[p : p + n_space])
        p += up(n_space)
        n = int(np.prod(shape)) if shape else 1
        value = self.decode(body[p : p + n * kind.dtype.itemsize], kind)
        return name, value.reshape(shape) if shape else value[0]

    def link(self, body: bytes) -> tuple[str, int] | None:
        flags, p = body[1], 2
        hard = True
        if flags & 8:
            hard = body[p] == 0
            p += 1
        p += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
        width = 1 << (flags & 3)
        n = int.from_bytes(body[p : p + width], "little")
        name = body[p + width : p + width + n].decode()
        return (name, struct.unpack("<Q", body[p + width + n :][:8])[0]) if hard else None

    def symbols(self, tree: int, heap: int) -> dict[str, int]:
        size, _, names_at = struct.unpack("<QQQ", self.bytes(heap + 8, 24))
        names, out, stack = self.bytes(names_at, size), {}, [tree]
        while stack:
            at = stack.pop()
            head = self.bytes(at, 24)
            if head[:4] == b"TREE":
                n = struct.unpack("<H", head[6:8])[0]
                body = self.bytes(at + 24, 8 + 16 * n)
                stack += [struct.unpack("<Q", body[8 + 16 * i : 16 + 16 * i])[0] for i in range(n)]
            else:
                n = struct.unpack("<H", head[6:8])[0]
                body = self.bytes(at + 8, 40 * n)
                for i in range(n):
                    offset, to = struct.unpack("<QQ", body[40 * i : 40 * i + 16])
                    out[names[offset : names.index(b"\0", offset)].decode()] = to
        return out

    # values
    def chunks(self, at: int, rank: int) -> Iterator[tuple[int, int, tuple[int, ...], int]]:
        """(bytes, filters left out, place of the first value, address) of every chunk."""
        if at == NOWHERE:
            return
        head = self.bytes(at, 24)
        level, n = head[5], struct.unpack("<H", head[6:8])[0]
        key = 8 + 8 * (rank + 1)
        body = self.bytes(at + 24, (key + 8) * n + key)
        for i in range(n):
            p = i * (key + 8)
            size, mask = struct.unpack("<II", body[p : p + 8])
            place = struct.unpack(f"<{rank}Q", body[p + 8 : p + 8 + 8 * rank])
            child = struct.unpack("<Q", body[p + key : p + key + 8])[0]
            if level:
                yield from self.chunks(child, rank)
            else:
                yield size, mask, place, child

    def unfilter(self, data: bytes, node: Node, mask: int) -> bytes:
        for i in range(len(node.filters) - 1, -1, -1):
            which, _ = node.filters[i]
            if mask >> i & 1:
                continue
            if which == 1:
                data = zlib.decompress(data)
            elif which == 2:
                size = node.kind.dtype.itemsize
                n = len(data) // size
                data = np.frombuffer(data[: n * size], np.uint8).reshape(size, n).T.tobytes() + data[n * size :]
            elif which == 3:
                data = data[:-4]
            else:
                raise ValueError(f"filter {which} isn't known")
        return data

    def rows(self, node: Node, low: int, high: int, inner: tuple[int, ...]) -> bytes:
        size = node.kind.dtype.itemsize
        row = size * int(np.prod(inner, dtype=np.int64))
        way = node.layout[0]
        if way == "compact":
            return node.layout[1][low * row : high * row]
        if way == "contiguous":
            if node.layout[1] == NOWHERE:
                return b"\0" * ((high - low) * row)
            return self.bytes(node.layout[1] + low * row, (high - low) * row)
        _, tree, chunk = node.layout
        out = np.zeros((high - low, *inner), node.kind.dtype)
        for n, mask, place, at in self.chunks(tree, len(chunk)):
            if place[0] >= high or place[0] + chunk[0] <= low:
                continue
            block = np.frombuffer(self.unfilter(self.bytes(at, n), node, mask), node.kind.dtype)[: int(np.prod(chunk))].reshape(chunk)
            a, b = max(low, place[0]), min(high, place[0] + chunk[0])
            ends = [min(c, s - p) for c, s, p in zip(chunk[1:], inner, place[1:])]
            out[(slice(a - low, b - low), *(slice(p, p + e) for p, e in zip(place[1:], ends)))] = block[(slice(a - place[0], b - place[0]), *(slice(0, e) for e in ends))]
        return out.tobytes()

    def heap(self, at: int) -> dict[int, bytes]:
        if at not in self.heaps:
            size = struct.unpack("<Q", self.bytes(at + 8, 8))[0]
            data, p, found = self.bytes(at, size), 16, {}
            while p + 16 <= size:
                index, _, n = struct.unpack("<HH4xQ", data[p : p + 16])
                if index == 0:
                    break
                found[index] = data[p + 16 : p + 16 + n]
                p += 16 + -(-n // 8) * 8
            if len(self.heaps) > 64:
                self.heaps.clear()
            self.heaps[at] = found
        return self.heaps[at]

    def decode(self, raw: bytes, kind: Kind) -> np.ndarray:
        if kind.variable:
            out = []
            for n, at, index in struct.iter_unpack("<IQI", raw):
                value = self.heap(at)[index][:n] if at else b""
                out.append(value.decode("utf-8", "replace") if kind.text else value)
            found = np.empty(len(out), object)
            found[:] = out
            return found
        values = np.frombuffer(raw, kind.dtype)
        if kind.text:
            return np.array([v.decode("utf-8", "replace") for v in values.tolist()], object)
        if kind.names and {n.upper() for n in kind.names.values()} <= {"TRUE", "FALSE"}:
            return values == next(v for v, n in kind.names.items() if n.upper() == "TRUE")
        return values


class Writer:
    """Groups, contiguous or deflated datasets of numbers and fixed strings, attributes: what a count matrix needs."""

    def __init__(self, path: str) -> None:
        self.f = open(path, "wb")
        self.f.write(b"\0" * 96)

    def put(self, data: bytes) -> int:
        self.f.seek(0, 2)
        self.f.write(b"\0" * (-self.f.tell() % 8))
        at = self.f.tell()
        self.f.write(data)
        return at

    def type(self, dtype: np.dtype) -> bytes:
        size = dtype.itemsize
        if dtype.kind in "iu":
            return struct.pack("<BBBBIHH", 0x10, 8 if dtype.kind == "i" else 0, 0, 0, size, 0, 8 * size)
        if dtype.kind == "f":
            place = (31, 23, 8, 0, 23, 127) if size == 4 else (63, 52, 11, 0, 52, 1023)
            return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, place[0], 0, size, 0, 8 * size, *place[1:5], place[5])
        return struct.pack("<BBBBI", 0x13, 0x10 | 1, 0, 0, size)

    def space(self, shape: tuple[int, ...]) -> bytes:
        return struct.pack("<BBBB4x", 1, len(shape), 0, 0) + struct.pack(f"<{len(shape)}Q", *shape)

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHB3x", kind, -(-len(m) // 8) * 8, 0) + m + b"\0" * (-len(m) % 8) for kind, m in messages)
        return self.put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body)

    def attributes(self, attrs: dict) -> list[tuple[int, bytes]]:
        out, up = [], lambda b: b + b"\0" * (-len(b) % 8)
        for name, value in attrs.items():
            value = np.asarray(value)
            value = np.char.encode(value, "utf-8") if value.dtype.kind == "U" else value
            value = value.astype(f"S{max(1, value.dtype.itemsize)}") if value.dtype.kind == "S" else value
            key, kind, space = name.encode() + b"\0", self.type(value.dtype), self.space(value.shape)
            out.append((0x0C, struct.pack("<BBHHH", 1, 0, len(key), len(kind), len(space)) + up(key) + up(kind) + up(space) + value.tobytes()))
        return out

    def dataset(self, value: np.ndarray, attrs: dict | None = None, chunk: int = 0) -> int:
        value = np.ascontiguousarray(value)
        if value.dtype.kind in "UO":
            value = np.char.encode(value.astype(str), "utf-8")
        messages = [(0x01, self.space(value.shape)), (0x03, self.type(value.dtype))]
        if chunk and value.size:
            steps = range(0, value.shape[0], chunk)
            rank, keys = value.ndim, []
            for at in steps:
                part = np.zeros((chunk, *value.shape[1:]), value.dtype)
                part[: len(value[at : at + chunk])] = value[at : at + chunk]
                data = zlib.compress(part.tobytes(), 4)
                keys.append(struct.pack("<II", len(data), 0) + struct.pack(f"<{rank + 1}Q", at, *[0] * rank) + struct.pack("<Q", self.put(data)))
            last = struct.pack("<II", 0, 0) + struct.pack(f"<{rank + 1}Q", len(keys) * chunk, *[0] * rank)
            tree = self.put(b"TREE" + struct.pack("<BBHQQ", 1, 0, len(keys), NOWHERE, NOWHERE) + b"".join(keys) + last)
            messages.append((0x0B, struct.pack("<BB6x", 1, 1) + struct.pack("<HHHHII", 1, 0, 1, 1, 4, 0)))
            messages.append((0x08, struct.pack("<BBBQ", 3, 2, rank + 1, tree) + struct.pack(f"<{rank + 1}I", chunk, *value.shape[1:], value.dtype.itemsize)))
        else:
            messages.append((0x08, struct.pack("<BBQQ", 3, 1, self.put(value.tobytes()) if value.size else NOWHERE, value.nbytes)))
        return self.header(messages + self.attributes(attrs or {}))

    def group(self, members: dict[str, int], attrs: dict | None = None) -> int:
        names, entries = b"\0" * 8, []
        for name in sorted(members):
            entries.append(struct.pack("<QQII16x", len(names), members[name], 0, 0))
            names += name.encode() + b"\0"
            names += b"\0" * (-len(names) % 8)
        snod = self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(entries)) + b"".join(entries))
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NOWHERE, self.put(names)))
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NOWHERE, NOWHERE) + struct.pack("<QQQ", 0, snod, max(0, len(names) - 8)))
        return self.header([(0x11, struct.pack("<QQ", tree, heap)), *self.attributes(attrs or {})])

    def close(self, root: int) -> None:
        self.f.seek(0, 2)
        end = self.f.tell()
        self.f.seek(0)
        self.f.write(MAGIC + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 512, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, end, NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0))
        self.f.close()
