"""Import and export of binary map sets: a header chunk, an optional layout chunk, and one image chunk a map.

An image is cut into square blocks, each a quadtree of cells whose values go through a 16-slot palette that lives as long
as the block. A block is decoded whole, into a square array: the result is a table of runs, so there is no use for single
pixels here. Spark reads files as binary rows; an index pass finds their images, which are then dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values of the format
IMAGE = b"GI01"
LAYOUT = b"LAYO"
VERSION_BYTES = 16
#: First number of each length of an unsigned and of a signed number.
UNSIGNED = (0, 252, 508, 66044, 16843260)
SIGNED = (0, 124, 380, 65916, 16843132)
RAW, SIZED, PACKED = 0, 1, 2
MIXED, VALUES, MONO = 0, 1, 2
#: By palette mode of a run cell: slots, bits of the first index, bits of each later step.
RUN_MODES = ((2, 1, 0), (3, 2, 1), (5, 3, 2), (16, 0, 4))
#: By side: bits of a short run's count, its least count, bits of its values.
SHORT_RUNS = {8: (3, 2, 2), 16: (3, 2, 2), 32: (4, 4, 3), 64: (4, 4, 4), 128: (4, 4, 4), 256: (5, 4, 4)}
#: Bits and least value of a row edge's step.
EDGE_STEPS = ((2, -1), (3, -3), (4, -7))
EDGE_COUNT_BITS, EDGE_LEAST = 5, 2
PACK_WINDOW = 256


class Bits:
    """Reads bits from the first of each byte on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.bit = data, at * 8

    def take(self, n: int) -> int:
        end = self.bit + n
        if end > len(self.data) * 8:
            raise ValueError("the data ends within a value")
        whole = int.from_bytes(self.data[self.bit // 8 : -(-end // 8)], "big")
        self.bit = end
        return (whole >> (-end % 8)) & ((1 << n) - 1)

    def many(self, count: int, n: int) -> np.ndarray:
        """count numbers of n bits each."""
        end = self.bit + count * n
        if end > len(self.data) * 8:
            raise ValueError("the data ends within a value")
        at = self.bit // 8
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, -(-end // 8) - at, at))[self.bit % 8 :][: count * n]
        self.bit = end
        return bits.reshape(count, n) @ (1 << np.arange(n - 1, -1, -1))

    def _number(self, lead: int, top: int, bases: tuple[int, ...]) -> int:
        if lead < bases[1]:
            return lead
        size = top - lead + 1
        return bases[size] + self.take(8 * size)

    def unsigned(self) -> int:
        return self._number(self.take(8), 255, UNSIGNED)

    def unsigneds(self, count: int) -> list[int]:
        at = self.bit // 8
        short = self.data[at : at + count]
        if self.bit % 8 == 0 and len(short) == count and max(short, default=0) < UNSIGNED[1]:  # a byte each
            self.bit += 8 * count
            return list(short)
        return [self.unsigned() for _ in range(count)]

    def signed(self) -> int:
        negative = self.take(1)
        v = self._number(self.take(7), 127, SIGNED)
        return -v if negative else v

    def align(self) -> None:
        self.bit = -(-self.bit // 8) * 8

    def bytes(self, n: int) -> bytes:
        at = self.bit // 8
        if self.bit % 8 or at + n > len(self.data):
            raise ValueError("the data ends within a chunk")
        self.bit += 8 * n
        return self.data[at : at + n]


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> BitWriter:
        self.value, self.n = (self.value << n) | (value & ((1 << n) - 1)), self.n + n
        return self

    def _number(self, v: int, top: int, bits: int, bases: tuple[int, ...]) -> BitWriter:
        size = max(k for k in range(5) if v >= bases[k])
        if size == 0:
            return self.put(v, bits)
        return self.put(top - size + 1, bits).put(v - bases[size], 8 * size)

    def unsigned(self, v: int) -> BitWriter:
        if not 0 <= v <= UNSIGNED[4] + 0xFFFFFFFF:
            raise ValueError(f"{v} has no unsigned form")
        return self._number(v, 255, 8, UNSIGNED)

    def signed(self, v: int) -> BitWriter:
        return self.put(int(v < 0), 1)._number(abs(v), 127, 7, SIGNED)

    def done(self) -> bytes:
        pad = -self.n % 8
        return (self.value << pad).to_bytes((self.n + pad) // 8, "big")


def unpack(data: bytes) -> bytes:
    """Literal runs and copies from a window of 256 bytes that starts as zeros."""
    src, out = Bits(data), bytearray(PACK_WINDOW)
    try:
        while True:
            if src.take(1):
                back, n = src.take(8), src.take(4) + 2
                at = len(out) - PACK_WINDOW + back
                for k in range(n):  # a copy may read what it writes
                    out.append(out[at + k])
            else:
                n = src.take(4) + 1
                there = min(n, (len(data) * 8 - src.bit) // 8)
                out += src.take(8 * there).to_bytes(there)
                if there < n:
                    raise ValueError("the data ends within a literal run")
    except ValueError:  # the padding of the last byte
        return bytes(out[PACK_WINDOW:])


def pack(data: bytes) -> bytes:
    """The longest copy at each place, else a literal."""
    w, full, i, literals = BitWriter(), bytes(PACK_WINDOW) + data, 0, bytearray()

    def flush() -> None:
        for k in range(0, len(literals), 16):
            part = literals[k : k + 16]
            w.put(0, 1).put(len(part) - 1, 4).put(int.from_bytes(part), 8 * len(part))
        literals.clear()

    while i < len(data):
        end = i + PACK_WINDOW
        n, at, longer = 0, 0, full.find(data[i : i + 3], i, end) if len(data) - i > 2 else -1
        # a longer copy starts no earlier than a shorter one, and none is where there is no shorter one
        while longer >= 0:
            n, at = max(n + 1, 3), longer
            longer = full.find(data[i : i + n + 1], at, end) if n < min(17, len(data) - i) else -1
        if n:
            flush()
            w.put(1, 1).put(at - i, 8).put(n - 2, 4)
            i += n
        else:
            literals.append(data[i])
            i += 1
    flush()
    return w.done()


def scan_cells(side: int, mode: int) -> np.ndarray:
    """Row-major cells in the order of a run cell's scan."""
    grid = np.arange(side * side).reshape(side, side)
    if mode in (0, 1):
        rows = grid.copy()
        rows[1::2] = rows[1::2, ::-1]
        return (rows[:, ::-1] if mode == 1 else rows).ravel()
    walk = grid[::-1] if mode == 3 else grid
    walk = walk.copy()
    flipped = (np.arange(side) % 2 == 1)[:: -1 if mode == 3 else 1]
    walk[flipped] = walk[flipped, ::-1]
    # positions run along columns
    return ((walk % side) * side + walk // side).ravel()


class BlockDecoder:
    """One block: its palette goes from cell to cell."""

    def __init__(self, src: Bits, delta: bool):
        self.src, self.delta, self.slots = src, delta, [0] * 16

    def update(self, table: int, width: int) -> None:
        chosen = [k for k in range(width) if table >> (width - 1 - k) & 1]
        new = [self.slots[k] + self.src.signed() if self.delta else self.src.unsigned() for k in chosen]
        for k, v in zip(chosen, new):
            self.slots[k] = v

    def square(self, side: int) -> np.ndarray:
        head = self.src.take(8)
        kind, sub, low = head >> 6, head >> 4 & 3, head & 15
        if kind == 0:
            return self.container(side, sub, low)
        if kind == 1:
            return self.plain(side, sub, low)
        if kind == 2:
            return self.runs(side, sub, low)
        raise ValueError("a cell's kind is reserved")

    def container(self, side: int, kind: int, table: int) -> np.ndarray:
        if kind == 3 or (kind == MIXED and table & 1) or (kind == MONO and table & 7):
            raise ValueError("a container's header is not valid")
        if kind == MONO:
            self.update(table, 4)
            return np.full((side, side), self.slots[0], np.int64)
        mask = self.src.take(8)
        self.update(table, 4)
        held = self.slots[:4]
        out, half = np.zeros((side, side), np.int64), side // 2
        for q in range(4):
            index = mask >> (6 - 2 * q) & 3
            part = self.square(half) if kind == MIXED and index == 3 else held[index]
            y, x = q // 2 * half, q % 2 * half
            out[y : y + half, x : x + half] = part
        return out

    def plain(self, side: int, sub: int, low: int) -> np.ndarray:
        if sub == 3:
            if low:
                raise ValueError("a plain cell's spare bits are set")
            v = self.src.unsigneds(side * side)
        else:
            if sub == 2:
                self.update(self.src.take(12) << 4 | low, 16)
            else:
                if low >> (2, 4)[sub]:
                    raise ValueError("a plain cell's spare bits are set")
                self.update(low, (2, 4)[sub])
            v = np.array(self.slots, np.int64)[self.src.many(side * side, 1 << sub)]
        return np.array(v, np.int64).reshape(side, side)

    def runs(self, side: int, sub: int, low: int) -> np.ndarray:
        slots, first_bits, step_bits = RUN_MODES[sub]
        coding, mode = low >> 2, low & 3
        first, table, extra = self.src.take(first_bits), self.src.take(slots), self.src.take(4)
        if coding == 3 or first >= slots or extra > (0, 7, 14)[coding]:
            raise ValueError("a run cell's header is not valid")
        self.update(table, slots)
        out, at, index, last = np.zeros(side * side, np.int64), 0, first, None
        order = scan_cells(side, mode)
        top = -1
        for count in self.counts(side, coding, extra):
            if count <= 0 or at + count > side * side:
                raise ValueError("a cell's runs do not fill it")
            if sub == 3:
                index = self.src.take(4)
            elif last is not None:
                index = (index + 1 + self.src.take(step_bits)) % slots
            last, top = index, max(top, index)
            out[order[at : at + count]] = self.slots[index]
            at += count
        if at != side * side or not ((0, 3, 4, 6)[sub] <= top + 1 <= (2, 3, 5, 16)[sub]):
            raise ValueError("a cell's runs do not fill it or do not fit its palette")
        return out.reshape(side, side)

    def counts(self, side: int, coding: int, extra: int) -> Iterator[int]:
        """Run lengths; each is given out before the bits of its palette step are read, but tokens hold several at once."""
        src, total, cells = self.src, 0, side * side
        if coding == 0:
            while total < cells:
                n = src.unsigned()
                total += n
                yield n
            return
        given, n_runs = 0, src.unsigned() - 1
        if n_runs < (0 if coding == 1 else 1):
            raise ValueError("a cell has too few runs")
        reduce = extra % 5 + 1 if coding == 2 and extra % 5 else None
        while given < n_runs:
            if coding == 2 and reduce and given == 0:
                token = [src.unsigned()]
            elif src.take(1) == 0:
                token = [src.take(reduce) + 1 if reduce else src.unsigned()]
            elif coding == 1:
                bits, least, value_bits = SHORT_RUNS[side]
                token = [src.take(value_bits + (extra & 3)) + 1 for _ in range(src.take(bits + (extra >> 2 & 1)) + least)]
            else:
                bits, least = EDGE_STEPS[extra // 5]
                n = src.take(EDGE_COUNT_BITS) + EDGE_LEAST
                token = [src.unsigned()]
                while len(token) < n:
                    token.append(2 * side - token[-1] + src.take(bits) + least)
            given += len(token)
            if given > n_runs:
                raise ValueError("a token holds more runs than are left")
            for n in token:
                total += n
                yield n
        yield cells - total


def decode_block(src: Bits, side: int) -> np.ndarray:
    head = src.take(8)
    way = head >> 4 & 3
    if head & 0x4F or way == 3:
        raise ValueError("a block's header is not valid")
    if way == RAW:
        out = BlockDecoder(src, head >> 7 == 1).square(side)
        src.align()
        return out
    body = src.bytes(src.unsigned())
    return BlockDecoder(Bits(unpack(body) if way == PACKED else body), head >> 7 == 1).square(side)


def decode_image(data: bytes) -> np.ndarray:
    """The codes of an image chunk's data, row 0 southernmost; what fills up edge blocks is cut off."""
    src = Bits(data)
    width, height, side = src.unsigned(), src.unsigned(), 1 << src.take(8)
    across, up = -(-width // side), -(-height // side)
    out = np.zeros((up * side, across * side), np.int64)
    for b in range(across * up):
        y, x = b // across * side, b % across * side
        out[y : y + side, x : x + side] = decode_block(src, side)
    return out[:height, :width]


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    src = Bits(data)
    while src.bit < len(data) * 8:
        name = src.bytes(4)
        yield name, src.bytes(src.unsigned())


def decode_set(data: bytes, max_maps: int | None = None) -> dict:
    """unit_x, unit_y, metadata and maps: (west, south, codes) in storage order."""
    parts = chunks(data)
    _, head = next(parts)
    src = Bits(head, VERSION_BYTES)
    unit_x, unit_y = src.unsigned(), src.unsigned()
    metadata = src.bytes(src.unsigned()).decode() or None
    n = src.unsigned()
    if max_maps is not None and n > max_maps:
        raise ValueError(f"{n} maps; {max_maps} are allowed")
    origins = [(src.signed(), src.signed()) for _ in range(n)]
    images = [decode_image(body) for name, body in parts if name != LAYOUT and _image(name)]
    if len(images) != n:
        raise ValueError("the header's maps are not the file's images")
    return {"unit_x": unit_x, "unit_y": unit_y, "metadata": metadata, "maps": [(w, s, c) for (w, s), c in zip(origins, images)]}


def _image(name: bytes) -> bool:
    if name != IMAGE:
        raise ValueError(f"an unknown chunk: {name!r}")
    return True


# ---- writing


def encode_square(codes: np.ndarray) -> bytes:
    """A block's cell: one value, or plain values through a palette of 2, 4 or 16, or as they are."""
    values = np.unique(codes)
    w = BitWriter()
    if len(values) == 1:
        return w.put(MONO << 4 | 8, 8).unsigned(int(values[0])).done()
    if len(values) > 16:
        w.put(1 << 6 | 3 << 4, 8)
        if 0 <= values[0] and values[-1] < UNSIGNED[1]:
            return w.done() + codes.astype(np.uint8).tobytes()
        return w.done() + b"".join(BitWriter().unsigned(int(v)).done() for v in codes.ravel())
    sub = 0 if len(values) <= 2 else 1 if len(values) <= 4 else 2
    width = (2, 4, 16)[sub]
    table = ((1 << len(values)) - 1) << (width - len(values))
    w.put(1 << 6 | sub << 4 | table & 15, 8)
    if sub == 2:
        w.put(table >> 4, 12)
    for v in values:
        w.unsigned(int(v))
    bits = 1 << sub
    indexes = np.searchsorted(values, codes.ravel())
    flags = (indexes[:, None] >> np.arange(bits - 1, -1, -1) & 1).astype(np.uint8)
    return w.put(int.from_bytes(np.packbits(flags).tobytes()) >> -flags.size % 8, flags.size).done()


def encode_block(codes: np.ndarray) -> bytes:
    """The smallest of the three ways, the simpler on ties."""
    body = encode_square(codes)
    packed = pack(body)
    ways = [bytes([RAW << 4]) + body] if len(body) < 16 else []
    ways += [bytes([k << 4]) + BitWriter().unsigned(len(x)).done() + x for k, x in ((SIZED, body), (PACKED, packed))]
    return min(ways, key=len)


def encode_image(codes: np.ndarray, side: int = 64) -> bytes:
    """A chunk's data; edge blocks are filled up with zeros."""
    if side & (side - 1):
        raise ValueError("a block's side is a power of two")
    height, width = codes.shape
    up, across = -(-height // side), -(-width // side)
    full = np.zeros((up * side, across * side), np.int64)
    full[:height, :width] = codes
    head = BitWriter().unsigned(width).unsigned(height).put(side.bit_length() - 1, 8).done()
    return head + b"".join(encode_block(full[y : y + side, x : x + side]) for y in range(0, up * side, side) for x in range(0, across * side, side))


def chunk(name: bytes, data: bytes) -> bytes:
    return name + BitWriter().unsigned(len(data)).done() + data


def encode_set(maps: list[tuple[int, int, np.ndarray]], unit_x: int, unit_y: int, *, header: bytes, version: bytes, metadata: str | None = None, side: int = 64) -> bytes:
    """maps: (west, south, codes) in storage order. header and version are the tags that a reader of the files expects."""
    text = (metadata or "").encode()
    w = BitWriter().unsigned(unit_x).unsigned(unit_y).unsigned(len(text))
    body = version.ljust(VERSION_BYTES, b"\0") + w.done() + text
    w = BitWriter().unsigned(len(maps))
    for west, south, _ in maps:
        w.signed(west).signed(south)
    return chunk(header, body + w.done()) + b"".join(chunk(IMAGE, encode_image(c, side)) for _, _, c in maps)


def decode_single(data: bytes, decode: bool = True) -> dict:
    """A file of one map, whose header holds its place: the same result as decode_set; without decode its image's data."""
    (_, head), *rest = chunks(data)
    src = Bits(head, VERSION_BYTES)
    unit_x, unit_y, west, south = src.unsigned(), src.unsigned(), src.signed(), src.signed()
    metadata = src.bytes(src.unsigned()).decode() or None
    images = [body for name, body in rest if name != LAYOUT and _image(name)]
    if len(images) != 1 or src.bit != len(head) * 8:
        raise ValueError("a file of one map has one image and nothing else")
    return {"unit_x": unit_x, "unit_y": unit_y, "metadata": metadata, "maps": [(west, south, decode_image(images[0]) if decode else images[0])]}


def encode_single(west: int, south: int, codes: np.ndarray, unit_x: int, unit_y: int, *, header: bytes, version: bytes, metadata: str | None = None, side: int = 64) -> bytes:
    text = (metadata or "").encode()
    w = BitWriter().unsigned(unit_x).unsigned(unit_y).signed(west).signed(south).unsigned(len(text))
    return chunk(header, version.ljust(VERSION_BYTES, b"\0") + w.done() + text) + chunk(IMAGE, encode_image(codes, side))


def join_sets(*sets: dict) -> dict:
    """Maps of all, those of earlier ones first; the units must agree."""
    if len({(s["unit_x"], s["unit_y"]) for s in sets}) != 1:
        raise ValueError("the sets' units differ")
    return sets[0] | {"maps": [m for s in sets for m in s["maps"]]}


# ---- Spark

RUN_ROWS = "file string, unit_x long, unit_y long, map_ord long, west long, south long, width long, height long, y long, x0 long, len long, code long"


IMAGE_ROWS = "file string, unit_x long, unit_y long, metadata string, map_ord long, west long, south long, width long, height long, image binary"


def image_rows(data: bytes, file: str, max_maps: int | None = None) -> list[tuple]:
    """The images of a map set, not decoded: chunk lengths lead from one to the next."""
    parts = chunks(data)
    _, head = next(parts)
    src = Bits(head, VERSION_BYTES)
    unit_x, unit_y = src.unsigned(), src.unsigned()
    metadata = src.bytes(src.unsigned()).decode() or None
    n = src.unsigned()
    if max_maps is not None and n > max_maps:
        raise ValueError(f"{n} maps; {max_maps} are allowed")
    origins = [(src.signed(), src.signed()) for _ in range(n)]
    images = [body for name, body in parts if name != LAYOUT and _image(name)]
    if len(images) != n:
        raise ValueError("the header's maps are not the file's images")
    rows = []
    for k, ((west, south), body) in enumerate(zip(origins, images)):
        size = Bits(body)
        rows.append((file, unit_x, unit_y, metadata, k, west, south, size.unsigned(), size.unsigned(), body))
    return rows


#: Images and files of about so many bytes, and runs of so many rows, are one batch from or to Python.
BATCH_BYTES, BATCH_RUNS = 4 << 20, 1 << 16


def _image_table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in IMAGE_ROWS.split(", ")])


def _indexed(files: DataFrame, images: Callable[[bytes, str], list[tuple]]) -> DataFrame:
    """IMAGE_ROWS that images() makes of each of files (path, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for part in parts:
            for file, data in zip(part["path"], part["content"]):
                rows += images(bytes(data), file)
                size += len(data)
                if size >= BATCH_BYTES:
                    yield _image_table(rows)
                    rows, size = [], 0
        if rows:
            yield _image_table(rows)

    return files.select("path", "content").mapInPandas(run, IMAGE_ROWS)


def index_images(files: DataFrame, max_maps: int | None = None) -> DataFrame:
    """IMAGE_ROWS of files (path, content): what an indexed reader holds. Filter it, and only those images are decoded."""
    return _indexed(files, lambda data, file: image_rows(data, file, max_maps))


def decode_images(images: DataFrame) -> DataFrame:
    """RUN_ROWS of indexed images. Images are dealt over tasks, however many lie in one file."""
    schema = RUN_ROWS
    of_image = ["file", "unit_x", "unit_y", "map_ord", "west", "south", "width", "height"]

    def table(rows: list[tuple], found: list[np.ndarray]) -> pd.DataFrame:
        n = [f.shape[1] for f in found]
        whole = {c: np.repeat(np.array([r[k] for r in rows], object if c == "file" else np.int64), n) for k, c in enumerate(of_image)}
        return pd.DataFrame(whole | dict(zip(("y", "x0", "len", "code"), np.concatenate(found, 1))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, found, n = [], [], 0
        for part in parts:
            for r in part.itertuples():
                codes = decode_image(bytes(r.image))
                if not codes.size:
                    continue
                new = np.ones(codes.shape, bool)
                new[:, 1:] = codes[:, 1:] != codes[:, :-1]
                y, x0 = np.nonzero(new)
                size = np.diff(np.append(y * r.width + x0, codes.size))
                rows.append(tuple(getattr(r, c) for c in of_image))
                found.append(np.stack([y, x0, size, codes[y, x0]]))
                n += len(y)
                if n >= BATCH_RUNS:
                    yield table(rows, found)
                    rows, found, n = [], [], 0
        if rows:
            yield table(rows, found)

    n = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return images.repartition(n, "file", "map_ord").mapInPandas(run, schema)


def decode_singles(files: DataFrame) -> DataFrame:
    """RUN_ROWS of files (path, content) of one map each."""

    def one(data: bytes, file: str) -> list[tuple]:
        s = decode_single(data, decode=False)
        west, south, image = s["maps"][0]
        size = Bits(image)
        return [(file, s["unit_x"], s["unit_y"], s["metadata"], 0, west, south, size.unsigned(), size.unsigned(), image)]

    return decode_images(_indexed(files, one))


def painted(width: int, height: int, y: np.ndarray, x0: np.ndarray, n: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A map's codes out of its runs, 0 where there is none; what lies past its edges is cut."""
    a, z = np.clip(x0, 0, width), np.clip(x0 + n, 0, width)
    size = np.where((y >= 0) & (y < height), np.maximum(z - a, 0), 0)
    ends = np.cumsum(size)
    cell = np.repeat(y * width + a - (ends - size), size) + np.arange(ends[-1])
    codes = np.zeros(height * width, np.int64)
    codes[cell] = np.repeat(code, size)
    return codes.reshape(height, width)


def write_map_sets(runs: DataFrame, maps: DataFrame, unit_x: int, unit_y: int, *, header: bytes, version: bytes, per_file: int = 16, side: int = 64, single: bool = False) -> DataFrame:
    """(path, content): map sets of per_file maps each in order of map_ord; with single, a file of one map each. Maps without runs aren't written.

    A map's row sorts before its runs, so nothing is joined and a task holds one file's rows and a batch. (A join takes the
    runs for fewer bytes than the maps that they are exploded from, and broadcasts them.)
    """
    per_file = 1 if single else per_file
    file = F.expr(f"map_ord div {per_file}").alias("file")
    heads = maps.select(file, "map_ord", F.lit(0).alias("kind"), *[F.col(c).cast("bigint").alias(k) for c, k in zip(("west", "south", "width", "height"), "abcd")])
    rows = runs.select(file, "map_ord", F.lit(1).alias("kind"), *[F.col(c).cast("bigint").alias(k) for c, k in zip(("y", "x0", "len", "code"), "abcd")])
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = heads.unionByName(rows).repartition(n, "file").sortWithinPartitions("file", "map_ord", "kind", "a", "b")

    def encode(t: dict[str, np.ndarray]) -> bytes | None:
        own, starts = [], np.flatnonzero(np.diff(t["map_ord"], prepend=t["map_ord"][0] - 1))
        for a, z in zip(starts, np.append(starts[1:], len(t["map_ord"]))):
            if t["kind"][a] or z - a == 1:
                continue
            west, south, width, height = (int(t[k][a]) for k in "abcd")
            own.append((west, south, painted(width, height, *(t[k][a + 1 : z] for k in "abcd"))))
        if not own:
            return None
        if single:
            return encode_single(*own[0], unit_x, unit_y, header=header, version=version, side=side)
        return encode_set(own, unit_x, unit_y, header=header, version=version, side=side)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        paths, contents = [], []

        def close() -> None:
            nonlocal held
            if held:
                number = held[0]["file"][0]
                data = encode({c: np.concatenate([h[c] for h in held]) for c in held[0]})
                held = []
                if data is not None:
                    paths.append(f"{number:010d}")
                    contents.append(data)

        for part in parts:
            t = {c: part.column(c).to_numpy() for c in part.schema.names}
            starts = np.flatnonzero(np.diff(t["file"])) + 1
            for a, z in zip(np.append(0, starts), np.append(starts, part.num_rows)):
                if held and held[0]["file"][0] != t["file"][a]:
                    close()
                if a < z:
                    held.append({c: v[a:z] for c, v in t.items()})
            if sum(map(len, contents)) >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                paths, contents = [], []
        close()
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    return dealt.mapInArrow(run, "path string, content binary")


def read_map_files(spark: SparkSession, path: str, max_maps: int | None = None) -> DataFrame:
    """Runs of every map of every file under path, with the map's place."""
    return decode_images(index_images(spark.read.format("binaryFile").load(path), max_maps))
