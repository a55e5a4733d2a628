"""What a GeoTIFF file says: directories of tiles, how tiles are stored, and where they lie on the earth.

Reading needs only ranges of a file: the directories, then the tiles wanted. Classic and big files of either byte order
are read, in tiles or strips, bands together or apart, without compression or by deflate, with either predictor.
Files are written in tiles with bands apart, directories first, smallest overview first."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, unescape

import numpy as np

from ..operators.grid import Grid

# Fixed values of the format: tags, field types (code, bytes) and compression schemes.
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 254, 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, EXTRA, SAMPLE_FORMAT = 322, 323, 324, 325, 338, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34264, 34735, 42112, 42113
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
PLAIN, DEFLATE = (1,), (8, 32946)
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072

ReadAt = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Level:
    """One image of a file: the full one or an overview."""

    width: int
    height: int
    tile_width: int
    tile_height: int
    dtype: str
    samples: int
    apart: bool
    compression: int
    predictor: int
    order: str
    offsets: tuple[int, ...] = ()
    counts: tuple[int, ...] = ()

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_height)

    def tiles(self, window: tuple[int, int, int, int] | None = None) -> Iterator[tuple[int, int, int]]:
        """(number, tile row, tile column) of the tiles that meet (first row, past the last, first column, past the last)."""
        r0, r1, c0, c1 = window or (0, self.height, 0, self.width)
        r0, r1, c0, c1 = max(r0, 0), min(r1, self.height), max(c0, 0), min(c1, self.width)
        if r0 >= r1 or c0 >= c1:
            return
        for r in range(r0 // self.tile_height, (r1 - 1) // self.tile_height + 1):
            for c in range(c0 // self.tile_width, (c1 - 1) // self.tile_width + 1):
                yield r * self.across + c, r, c

    def decode(self, data: bytes) -> np.ndarray:
        """(rows, columns, samples) of a stored tile; strips end with the image."""
        if self.compression in DEFLATE:
            data = zlib.decompress(data)
        elif self.compression not in PLAIN:
            raise ValueError(f"compression {self.compression} is not read; deflate or none is")
        w, n = self.tile_width, 1 if self.apart else self.samples
        kind = np.dtype(self.dtype)
        stored = kind.newbyteorder(self.order)
        h = len(data) // (w * n * kind.itemsize)
        data = data[: h * w * n * kind.itemsize]
        if self.predictor == 3:
            x = np.frombuffer(data, np.uint8).reshape(h, -1, n)
            x = np.add.accumulate(x, axis=1, dtype=np.uint8).reshape(h, kind.itemsize, w * n)
            return np.ascontiguousarray(x.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(h, w, n).astype(kind)
        x = np.frombuffer(data, stored).reshape(h, w, n).astype(kind)
        return np.add.accumulate(x, axis=1, dtype=kind) if self.predictor == 2 else x

    def read(self, read_at: ReadAt, number: int, bands: list[int]) -> np.ndarray | None:
        """(rows, columns, bands) of a tile, or None where the file leaves it out; bands apart are read alone."""
        tile_row = number // self.across
        rows = min(self.tile_height, self.height - tile_row * self.tile_height)
        cols = min(self.tile_width, self.width - number % self.across * self.tile_width)
        if not self.apart:
            return self.decode(read_at(self.offsets[number], self.counts[number]))[:rows, :cols, bands] if self.counts[number] else None
        parts = []
        for b in bands:
            at = b * self.across * self.down + number
            parts.append(self.decode(read_at(self.offsets[at], self.counts[at]))[:rows, :cols, 0] if self.counts[at] else None)
        held = next((p for p in parts if p is not None), None)
        return None if held is None else np.stack([np.full(held.shape, np.nan) if p is None else p for p in parts], axis=2)


@dataclass(frozen=True)
class Raster:
    """A file: its levels, largest first, and what holds for all of them."""

    levels: tuple[Level, ...]
    names: tuple[str, ...]
    grid: Grid | None
    nodata: float | None
    scale: tuple[float, ...] = ()
    offset: tuple[float, ...] = ()

    @property
    def scaled(self) -> bool:
        return any(s != 1 for s in self.scale) or any(o != 0 for o in self.offset)


def _entries(read_at: ReadAt, at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    """Tags of a directory, and where the next one is."""
    n = struct.unpack(f"{order}{'Q' if big else 'H'}", read_at(at, 8 if big else 2))[0]
    head, size, room = (8, 20, 8) if big else (2, 12, 4)
    raw = read_at(at + head, n * size + room)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack(f"{order}HH{'Q' if big else 'I'}", raw[k * size : k * size + size - room])
        if kind not in FIELDS:
            continue
        width = struct.calcsize(f"={FIELDS[kind]}") * count
        value = raw[k * size + size - room : (k + 1) * size]
        if width > room:
            value = read_at(struct.unpack(f"{order}{'Q' if big else 'I'}", value)[0], width)
        tags[tag] = (value[:width].rstrip(b"\0").decode("utf-8", "replace"),) if kind == 2 else struct.unpack(f"{order}{count}{FIELDS[kind]}", value[:width])
    return tags, struct.unpack(f"{order}{'Q' if big else 'I'}", raw[n * size :])[0]


def _level(tags: dict[int, tuple], order: str) -> Level:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    kinds = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
    kind = (one(SAMPLE_FORMAT, 1), one(BITS, 1))
    if kind not in kinds or len(set(tags.get(BITS, (1,)))) > 1:
        raise ValueError(f"samples of format {kind[0]} with {tags.get(BITS)} bits are not read")
    width, height, tiled = tags[WIDTH][0], tags[HEIGHT][0], TILE_WIDTH in tags
    shape = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    where = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    return Level(width, height, *shape, kinds[kind], one(SAMPLES, 1), one(PLANAR, 1) == 2, one(COMPRESSION, 1), one(PREDICTOR, 1), order, *where)


def _grid(tags: dict[int, tuple], level: Level) -> Grid | None:
    if PIXEL_SCALE in tags and TIEPOINT in tags:
        (sx, sy), (i, j, _, x, y, _) = tags[PIXEL_SCALE][:2], tags[TIEPOINT][:6]
        a, e, c, f = sx, -sy, x - i * sx, y + j * sy
    elif TRANSFORM in tags:
        m = tags[TRANSFORM]
        if m[1] or m[4]:
            raise ValueError("turned grids are not read")
        a, e, c, f = m[0], m[5], m[3], m[7]
    else:
        return None
    keys = tags.get(GEO_KEYS, ())
    code = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    if code.get(RASTER_TYPE) == 2:  # the point given is a pixel's centre
        c, f = c - a / 2, f - e / 2
    epsg = code.get(PROJECTED) or code.get(GEOGRAPHIC)
    return Grid(f"EPSG:{epsg}" if epsg else "", a, e, c, f, level.width, level.height)


def parse(read_at: ReadAt) -> Raster:
    """The directories of a file. Masks and thumbnails that are no overview of the first image are left out."""
    head = read_at(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    at = struct.unpack(f"{order}Q", head[8:16])[0] if magic == 43 else struct.unpack(f"{order}I", head[4:8])[0]
    levels, first = [], None
    while at:
        tags, at = _entries(read_at, at, order, magic == 43)
        if first is None:
            first = tags
        elif tags.get(SUBFILE, (0,))[0] != 1:
            continue
        levels.append(_level(tags, order))
    n = levels[0].samples
    names, scale, offset = [f"band_{k + 1}" for k in range(n)], [1.0] * n, [0.0] * n
    for attrs, value in re.findall(r"<Item ([^>]*)>([^<]*)</Item>", (first.get(METADATA) or ("",))[0]):
        at_sample = re.search(r'sample="(\d+)"', attrs)
        role = re.search(r'role="(\w+)"', attrs)
        if at_sample and role and int(at_sample[1]) < n:
            k = int(at_sample[1])
            if role[1] == "description":
                names[k] = unescape(value)
            elif role[1] == "scale":
                scale[k] = float(value)
            elif role[1] == "offset":
                offset[k] = float(value)
    nodata = float(first[NODATA][0]) if first.get(NODATA) and first[NODATA][0].strip() else None
    return Raster(tuple(sorted(levels, key=lambda v: -v.width)), tuple(names), _grid(first, levels[0]), nodata, tuple(scale), tuple(offset))


def encode(block: np.ndarray, level: int = 6) -> bytes:
    """A tile of one band, by deflate with the predictor of its kind: 2 for integers, 3 for floats."""
    h, w = block.shape
    if block.dtype.kind == "f":
        planes = np.ascontiguousarray(block.astype(block.dtype.newbyteorder(">"))).view(np.uint8).reshape(h, w, block.dtype.itemsize).transpose(0, 2, 1).reshape(h, -1)
        out = planes.copy()
        out[:, 1:] -= planes[:, :-1]
    else:
        out = block.astype(block.dtype.newbyteorder("<"))
        out[:, 1:] -= block[:, :-1]
    return zlib.compress(out.tobytes(), level)


@dataclass
class Directory:
    """What a file to be written says before its tiles. ``shapes`` are the levels, largest first, as (width, height)."""

    shapes: list[tuple[int, int]]
    names: list[str]
    dtype: str
    tile: int
    grid: Grid
    nodata: float
    scale: float = 1.0
    offset: float = 0.0
    sizes: dict[tuple[int, int, int], int] = field(default_factory=dict)  # (level, band, tile) to bytes

    def _tags(self, k: int, big: bool) -> dict[int, tuple[int, tuple | bytes]]:
        """Tag to (field type, values) of a level; offsets are filled in later."""
        width, height = self.shapes[k]
        n, kind = len(self.names), np.dtype(self.dtype)
        tiles = -(-width // self.tile) * -(-height // self.tile)
        wide = 16 if big else 4
        tags = {
            SUBFILE: (4, (1 if k else 0,)), WIDTH: (4, (width,)), HEIGHT: (4, (height,)), BITS: (3, (8 * kind.itemsize,) * n), COMPRESSION: (3, (8,)), PHOTOMETRIC: (3, (1,)), SAMPLES: (3, (n,)),
            PLANAR: (3, (2,)), PREDICTOR: (3, (3 if kind.kind == "f" else 2,)), TILE_WIDTH: (3, (self.tile,)), TILE_HEIGHT: (3, (self.tile,)), TILE_OFFSETS: (wide, (0,) * (tiles * n)),
            TILE_COUNTS: (wide, tuple(self.sizes.get((k, b, t), 0) for b in range(n) for t in range(tiles))), SAMPLE_FORMAT: (3, ({"u": 1, "i": 2, "f": 3}[kind.kind],) * n),
            NODATA: (2, f"{self.nodata:g}".encode() + b"\0"),
        }
        if n > 1:
            tags[EXTRA] = (3, (0,) * (n - 1))
        if k == 0:
            g = self.grid
            if g.e < 0 < g.a:
                tags |= {PIXEL_SCALE: (12, (g.a, -g.e, 0.0)), TIEPOINT: (12, (0.0, 0.0, 0.0, g.c, g.f, 0.0))}
            else:
                tags[TRANSFORM] = (12, (g.a, 0.0, 0.0, g.c, 0.0, g.e, 0.0, g.f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))
            if code := re.fullmatch(r"EPSG:(\d+)", g.crs):
                flat = 4000 <= int(code[1]) < 5000
                tags[GEO_KEYS] = (3, (1, 1, 0, 3, MODEL_TYPE, 0, 1, 2 if flat else 1, RASTER_TYPE, 0, 1, 1, GEOGRAPHIC if flat else PROJECTED, 0, 1, int(code[1])))
            items = [f'<Item name="DESCRIPTION" sample="{b}" role="description">{escape(name)}</Item>' for b, name in enumerate(self.names)]
            if (self.scale, self.offset) != (1.0, 0.0):
                items += [f'<Item name="{role.upper()}" sample="{b}" role="{role}">{v!r}</Item>' for b in range(n) for role, v in (("scale", self.scale), ("offset", self.offset))]
            tags[METADATA] = (2, f"<GDALMetadata>{''.join(items)}</GDALMetadata>".encode() + b"\0")
        return dict(sorted(tags.items()))

    def head(self) -> bytes:
        """All bytes before the first tile. Tiles then follow by level, smallest first, band and number."""
        big = sum(self.sizes.values()) > 3 << 30
        word, entry, room, start = ("Q", 20, 8, 16) if big else ("I", 12, 4, 8)
        levels = [self._tags(k, big) for k in range(len(self.shapes))]
        count = struct.calcsize("<Q" if big else "<H")
        size = lambda kind, v: len(v) if kind == 2 else struct.calcsize(f"={FIELDS[kind]}") * len(v)
        need = [count + entry * len(tags) + room + sum(-(-s // 8) * 8 for kind, v in tags.values() if (s := size(kind, v)) > room) for tags in levels]
        begins = [start + sum(-(-n // 8) * 8 for n in need[:k]) for k in range(len(need) + 1)]
        at = begins[-1]
        for k in reversed(range(len(levels))):
            kind, counts = levels[k][TILE_COUNTS]
            places = []
            for n in counts:
                places.append(at if n else 0)
                at += n
            levels[k][TILE_OFFSETS] = (kind, tuple(places))
        out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, begins[0]) if big else struct.pack("<2sHI", b"II", 42, begins[0]))
        for k, tags in enumerate(levels):
            out += b"\0" * (begins[k] - len(out))
            body, extra, beyond = bytearray(struct.pack(f"<{'Q' if big else 'H'}", len(tags))), bytearray(), begins[k] + count + entry * len(tags) + room
            for tag, (kind, v) in tags.items():
                data = v if kind == 2 else struct.pack(f"<{len(v)}{FIELDS[kind]}", *v)
                body += struct.pack(f"<HH{word}", tag, kind, len(v))
                if len(data) > room:
                    body += struct.pack(f"<{word}", beyond + len(extra))
                    extra += data + b"\0" * (-len(data) % 8)
                else:
                    body += data + b"\0" * (room - len(data))
            out += body + struct.pack(f"<{word}", begins[k + 1] if k + 1 < len(levels) else 0) + extra
        return bytes(out) + b"\0" * (begins[-1] - len(out))
