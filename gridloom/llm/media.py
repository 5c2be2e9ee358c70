"""Media columns: progressive JPEG files that hold bytes in their coefficients, and full-resolution RGB tensors.

`encode` writes each text's bytes as quantised DCT coefficients (the unit of the format that a JPEG keeps without loss)
of a three-component image with halved chroma: a spectral-selection and successive-approximation script of nine scans.
`decode` reads any Huffman-coded progressive JPEG of 8 bits: it adds up the scans in coefficient arrays, inverts the
transform in numpy, upsamples the chroma and gives the RGB tensor; and from the coefficients the bytes.

Null texts count as empty. A payload is the UTF-8 bytes and spaces (byte 32) up to a positive multiple of 192, so no
file is empty. Rows are independent: equal texts give equal files, an empty table an empty table. A null file decodes to
nulls; a file that can't be read raises ValueError. A kept column with the name of a new one is handed on as `<name>_before`.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.base import apart, kept_schema, slices, with_columns

UNIT, PAD = 192, 32
MCU = 384  # bytes in a unit of four luma and two chroma blocks

#: Value k of a block, in the order of the scans, stands at this place of its 8 x 8 matrix.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: The inverse transform's matrix in whole numbers, 2^11 to one; products and sums stay exact in float64.
BASIS = np.array([[np.rint(2048 * np.sqrt((1 if k else 0.5) / 4) * np.cos((2 * x + 1) * k * np.pi / 16)) for x in range(8)] for k in range(8)])

#: Table class and id -> symbols in order, all codes of a table of one length: DC sizes, one AC first symbol, AC run ends.
TABLES = {(0, 0): (4, list(range(12))), (1, 0): (1, [0x07]), (1, 1): (4, [n << 4 for n in range(15)])}
#: Components, first and last coefficient, high and low bit, AC table of each scan.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1, 0), ((0,), 1, 5, 0, 1, 0), ((0,), 6, 63, 0, 1, 0), ((1,), 1, 63, 0, 1, 0), ((2,), 1, 63, 0, 1, 0), ((0, 1, 2), 0, 0, 1, 0, 0), ((0,), 1, 63, 1, 0, 1), ((1,), 1, 63, 1, 0, 1), ((2,), 1, 63, 1, 0, 1)]

_BYTE = np.arange(256)
#: A byte's coefficient: 128..255 or -255..-128, never small, so that every AC value has one size.
VALUE = np.where(_BYTE >= 128, _BYTE, _BYTE - 255).astype(np.int16)
_HALF = np.abs(VALUE) >> 1
#: A byte's AC code in the first scans: the one-bit code of (run 0, size 7), then 7 bits of value.
AC_CODE = np.where(VALUE > 0, _HALF, 127 - _HALF).astype(np.uint8)
LOW_BIT = (np.abs(VALUE) & 1).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _tables() -> bytes:
    body = b""
    for (kind, at), (length, symbols) in TABLES.items():
        counts = bytes(len(symbols) if n == length else 0 for n in range(1, 17))
        body += bytes([kind << 4 | at]) + counts + bytes(symbols)
    return _segment(0xC4, body)


HEAD = b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64)
TABLE_SEGMENT = _tables()
SCAN_HEADS = [_segment(0xDA, bytes([len(c)]) + b"".join(bytes([i + 1, t]) for i in c) + bytes([lo, hi, ah << 4 | al])) for c, lo, hi, ah, al, t in SCRIPT]


def _packed(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bits of values, each in so many bits, one after the other."""
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1])
    which = np.repeat(np.arange(len(values)), lengths)
    return ((values[which] >> (ends[which] - 1 - at)) & 1).astype(np.uint8)


def _closed(bits: np.ndarray) -> bytes:
    """Entropy-coded bytes: filled up with ones, 0 after each 255."""
    if len(bits) % 8:
        bits = np.append(bits, np.ones(-len(bits) % 8, np.uint8))
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _dc_first(dc: np.ndarray) -> bytes:
    """The first DC scan of values in the order of the scan (four luma, two chroma for each unit)."""
    half = dc.astype(np.int64) >> 1
    diff = half.copy()
    luma = half[:, :4].reshape(-1)
    diff[:, :4] = np.diff(luma, prepend=0).reshape(-1, 4)
    diff[1:, 4:] -= half[:-1, 4:]
    flat = diff.reshape(-1)
    size = np.frexp(np.abs(flat).astype(np.float64))[1].astype(np.int64)
    value = np.where(flat >= 0, flat, flat + (1 << size) - 1)
    return _closed(_packed(size << size | value, size + 4))


def _run_ends(blocks: int) -> list[tuple[int, int, int]]:
    """(blocks, bits, length) of the symbols that end so many blocks."""
    out = []
    while blocks:
        n = min(blocks, 32767)
        size = n.bit_length() - 1
        out.append((n, size << size | (n - (1 << size)), 4 + size))
        blocks -= n
    return out


def _ac_refine(low: np.ndarray) -> bytes:
    """The refining AC scan of blocks whose values are all known to be nonzero: run ends and a bit for each value."""
    bits, start = [], 0
    for n, value, length in _run_ends(len(low)):
        bits += [_packed(np.array([value]), np.array([length])), low[start : start + n].reshape(-1)]
        start += n
    return _closed(np.concatenate(bits))


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes([PAD]) * (-len(raw) % UNIT if raw else UNIT)


def write_jpeg(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload; a comment keeps its length."""
    units = -(-len(payload) // MCU)
    high = -(-units // 4095)
    wide = -(-units // high)
    raw = np.full(high * wide * MCU, PAD, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    mcu = raw.reshape(high, wide, 6, 64)
    luma = mcu[:, :, :4].reshape(high, wide, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    blocks = [luma, mcu[:, :, 4].reshape(-1, 64), mcu[:, :, 5].reshape(-1, 64)]
    frame = struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    dc = VALUE[mcu[:, :, :, 0].reshape(-1, 6)]
    data = [_dc_first(dc)]
    codes = [AC_CODE[b] for b in blocks]  # below 128: no byte needs stuffing
    data += [codes[c[0]][:, lo : hi + 1].tobytes() for c, lo, hi, *_ in SCRIPT[1:5]]
    data += [_closed((dc & 1).astype(np.uint8).reshape(-1))]
    data += [_ac_refine(LOW_BIT[b[:, 1:]]) for b in blocks]
    out = [HEAD, _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xC2, frame), TABLE_SEGMENT]
    for head, scan in zip(SCAN_HEADS, data, strict=True):
        out += [head, scan]
    return b"".join([*out, b"\xff\xd9"])


class _Bits:
    """An entropy-coded segment: windows of 16 bits at any place, single bits as an array."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8
        self.end = 8 * (len(self.data) - 8)

    def windows(self, at: np.ndarray) -> np.ndarray:
        first, r = at >> 3, np.frombuffer(self.data, np.uint8)
        wide = (r[first].astype(np.uint32) << 16) | (r[first + 1].astype(np.uint32) << 8) | r[first + 2]
        return (wide >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF

    def window(self, at: int) -> int:
        if at > self.end:
            raise ValueError("the scan ends early")
        i, d = at >> 3, self.data
        return (d[i] << 16 | d[i + 1] << 8 | d[i + 2]) >> (8 - (at & 7)) & 0xFFFF

    def take(self, at: int, n: int) -> int:
        return self.window(at) >> (16 - n) if n else 0

    def array(self, at: int, n: int) -> np.ndarray:
        if at + n > self.end:
            raise ValueError("the scan ends early")
        first = at >> 3
        return np.unpackbits(np.frombuffer(self.data, np.uint8, (at + n + 7 >> 3) - first, first))[at & 7 : (at & 7) + n]


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit window: code length << 8 | symbol; 0 where no code begins."""
    table, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


@lru_cache(maxsize=64)
def _by_byte(size: int, al: int) -> np.ndarray:
    """The coefficients in the last `size` bits of each byte."""
    bits = np.arange(256) & ((1 << size) - 1)
    return (np.where(bits >> (size - 1), bits, bits - ((1 << size) - 1)) << al).astype(np.int32)


_LOOKUPS: dict[bytes, tuple[np.ndarray, list[int]]] = {}


def _signed(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


class Jpeg:
    """The coefficient arrays of a progressive file: for each component (block rows, block columns, 64) in scan order."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, tuple[np.ndarray, list[int]]] = {}
        self.comment, self.restart, at = b"", 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker")
            marker = data[at + 1]
            if marker == 0xD9:
                return
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self._quant(body)
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                end = _MARKER.search(data, at)
                if end is None:
                    raise ValueError("no end of file")
                self._scan(body, data[at : end.start()])
                at = end.start()
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("not a progressive Huffman-coded file")

    def _quant(self, body: bytes) -> None:
        while body:
            wide, n = (">H", 128) if body[0] >> 4 else (">B", 64)
            self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], np.dtype(wide.replace("H", "u2").replace("B", "u1"))).astype(np.int64)
            body = body[1 + n :]

    def _frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if bits != 8:
            raise ValueError("only 8 bits a sample")
        self.ids = [body[6 + 3 * i] for i in range(n)]
        self.sampling = [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)]
        self.uses = [body[8 + 3 * i] for i in range(n)]
        self.most = (max(h for h, _ in self.sampling), max(v for _, v in self.sampling))
        self.units = (-(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1])))
        self.coefs = [np.zeros((self.units[1] * v, self.units[0] * h, 64), np.int32) for h, v in self.sampling]

    def _huffman(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            key = body[1 : 17 + n]
            if key not in _LOOKUPS:
                if len(_LOOKUPS) > 64:
                    _LOOKUPS.clear()
                table = _lookup(key[:16], key[16:])
                _LOOKUPS[key] = table, table.tolist()
            self.tables[body[0]] = _LOOKUPS[key]
            body = body[17 + n :]

    def _scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        which = [self.ids.index(body[1 + 2 * i]) for i in range(n)]
        dc, ac = [body[2 + 2 * i] >> 4 for i in range(n)], body[2] & 15
        lo, hi, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if n == 1:  # blocks of the component alone, row by row, without those that only fill up units
            c, (h, v) = which[0], self.sampling[which[0]]
            rows, cols = -(-self.height * v // (8 * self.most[1])), -(-self.width * h // (8 * self.most[0]))
            places = [self.coefs[c][:rows, :cols]]
            per = [1]
        else:
            places, per = [], []
            for c in which:
                h, v = self.sampling[c]
                places.append(self.coefs[c].reshape(self.units[1], v, self.units[0], h, 64).transpose(0, 2, 1, 3, 4))
                per.append(h * v)
        flat = [p.reshape(-1, k, 64) for p, k in zip(places, per, strict=True)]  # copies where the order differs
        units = len(flat[0])
        step = self.restart or units
        parts = re.split(rb"\xff[\xd0-\xd7]", data) if self.restart else [data]
        for k, start in enumerate(range(0, units, step)):
            bits, now = _Bits(parts[k]), [f[start : start + step] for f in flat]
            if lo == 0:
                (self._dc_refine if ah else self._dc_first)(bits, now, [self.tables.get(t) for t in dc], al)
            else:
                (self._ac_refine if ah else self._ac_first)(bits, now[0][:, 0], self.tables[16 | ac], lo, hi, al)
        for p, f in zip(places, flat, strict=True):
            if not np.shares_memory(p, f):
                p[...] = f.reshape(p.shape)

    @staticmethod
    def _dc_first(bits: _Bits, flat: list[np.ndarray], tables: list, al: int) -> None:
        turns = [(c, tables[c][1]) for c, f in enumerate(flat) for _ in range(f.shape[1])]
        out, before, at = [[] for _ in flat], [0] * len(flat), 0
        window = bits.window
        for _ in range(len(flat[0])):
            for c, look in turns:
                code = look[window(at)]
                size, at = code & 255, at + (code >> 8)
                if size:
                    value = window(at) >> (16 - size)
                    before[c] += value if value >> (size - 1) else value - (1 << size) + 1
                    at += size
                out[c].append(before[c])
        for f, values in zip(flat, out, strict=True):
            f[:, :, 0] = np.array(values).reshape(f.shape[:2]) << al

    @staticmethod
    def _dc_refine(bits: _Bits, flat: list[np.ndarray], tables: list, al: int) -> None:
        per = sum(f.shape[1] for f in flat)
        found = bits.array(0, per * len(flat[0])).reshape(-1, per).astype(np.int32)
        at = 0
        for f in flat:
            f[:, :, 0] |= found[:, at : at + f.shape[1]] << al
            at += f.shape[1]

    @staticmethod
    def _ac_first(bits: _Bits, flat: np.ndarray, tables: tuple[np.ndarray, list[int]], lo: int, hi: int, al: int) -> None:
        table, look = tables
        wide, blocks = hi - lo + 1, len(flat)
        code = look[bits.window(0)]
        length, size = code >> 8, code & 15
        # if every place of this stride holds this symbol, the stride is proven from the first place on
        if code & 255 == size and 0 < size and length + size == 8 and wide * blocks * 8 <= bits.end:
            seen = np.frombuffer(bits.data, np.uint8, wide * blocks)
            if (table[::256][seen] == code).all():
                flat[:, lo : hi + 1] = _by_byte(size, al)[seen].reshape(blocks, wide)
                return
        elif code & 255 == size and 0 < size and length + size <= 16 and wide * blocks * (length + size) <= bits.end:
            seen = bits.windows(np.arange(wide * blocks) * (length + size))
            if (table[seen] == code).all():
                value = ((seen >> (16 - length - size)) & ((1 << size) - 1)).astype(np.int32)
                value = np.where(value >> (size - 1), value, value - ((1 << size) - 1))
                flat[:, lo : hi + 1] = (value << al).reshape(blocks, wide)
                return
        at, block, skip = 0, 0, 0
        while block < blocks:
            k = lo
            while k <= hi:
                code = look[bits.window(at)]
                at += code >> 8
                run, size = (code >> 4) & 15, code & 15
                if size:
                    k += run
                    flat[block, k] = _signed(bits.take(at, size), size) << al
                    at, k = at + size, k + 1
                elif run == 15:
                    k += 16
                else:
                    skip = (1 << run) - 1 + bits.take(at, run)
                    at += run
                    break
            block += 1 + skip
            skip = 0

    @staticmethod
    def _ac_refine(bits: _Bits, flat: np.ndarray, tables: tuple[np.ndarray, list[int]], lo: int, hi: int, al: int) -> None:
        look = tables[1]

        def correct(values: np.ndarray, at: int) -> int:
            """Adds a bit to the values (a view) that are not zero; the place after the bits."""
            known = values != 0
            n = int(np.count_nonzero(known))
            if n:
                more = bits.array(at, n).astype(np.int32) << al
                if n == values.size:
                    values += np.where(values > 0, 1, -1) * more.reshape(values.shape)
                else:
                    values[known] += np.sign(values[known]) * more
            return at + n

        at, block, blocks, k = 0, 0, len(flat), lo
        while block < blocks:
            code = look[bits.window(at)]
            at += code >> 8
            run, size = (code >> 4) & 15, code & 15
            if size == 0 and run < 15:
                ended = (1 << run) + bits.take(at, run)
                at = correct(flat[block, k : hi + 1], at + run)
                at = correct(flat[block + 1 : block + ended, lo : hi + 1], at)
                block, k = block + ended, lo
                continue
            value = 0
            if size:
                value = (1 if bits.take(at, 1) else -1) << al
                at += 1
            zeros = np.flatnonzero(flat[block, k : hi + 1] == 0)
            stop = k + int(zeros[run]) if run < len(zeros) else hi + 1
            at = correct(flat[block, k:stop], at)
            if stop <= hi and value:
                flat[block, stop] = value
            k = stop + 1
            if k > hi:
                block, k = block + 1, lo

    def rgb(self) -> np.ndarray:
        """The (height, width, 3) tensor; each chroma sample covers the pixels that it stands for."""
        planes = []
        for coef, q, (h, v) in zip(self.coefs, self.uses, self.sampling, strict=True):
            rows, cols = coef.shape[:2]
            natural = np.zeros((rows * cols, 64))
            natural[:, ZIGZAG] = coef.reshape(-1, 64) * self.quant[q]
            half = (natural.reshape(-1, 8) @ BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
            full = (np.ascontiguousarray(half).reshape(-1, 8) @ BASIS).reshape(rows, cols, 8, 8).transpose(0, 3, 1, 2)
            plane = np.clip(np.floor(full.reshape(rows * 8, cols * 8) / 4194304 + 0.5) + 128, 0, 255).astype(np.int32)
            planes.append(plane.repeat(self.most[1] // v, axis=0).repeat(self.most[0] // h, axis=1)[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        out = np.empty((*y.shape, 3), np.uint8)
        for c, plane in enumerate((y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16))):
            out[:, :, c] = np.clip(plane, 0, 255)
        return out

    def payload(self) -> bytes | None:
        """The bytes that `write_jpeg` put in; null for a file without its comment."""
        if len(self.comment) != 8 or self.sampling != [(2, 2), (1, 1), (1, 1)]:
            return None
        luma, cb, cr = self.coefs
        rows, cols = cb.shape[:2]
        mcu = np.empty((rows, cols, 6, 64), np.int32)
        mcu[:, :, :4] = luma.reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows, cols, 4, 64)
        mcu[:, :, 4], mcu[:, :, 5] = cb, cr
        return np.where(mcu > 0, mcu, mcu + 255).astype(np.uint8).tobytes()[: struct.unpack(">Q", self.comment)[0]]


def features(rgb: np.ndarray) -> list[int]:
    """Height, width, the sum of each channel, and counts of the pixels by eighths of their green values."""
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return [*rgb.shape[:2], *map(int, sums), *map(int, np.bincount(rgb[:, :, 1].reshape(-1) >> 5, minlength=8))]


def encode(df: DataFrame, text: str = "text", media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) and `media`: a progressive JPEG that holds the bytes of `text`."""
    names = apart(df.columns, [media])
    df, keep, text = df.withColumnsRenamed(names), [names[c] for c in (df.columns if keep is None else keep)], names[text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text):
                yield with_columns(part, keep, **{media: pa.array([write_jpeg(payload_of(t)) for t in texts], pa.binary())})

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, kept_schema(df, keep, (media, "binary")))


def decode(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default), `payload` (the bytes of `encode`, else null), `height`, `width`, `rgb` and `features`."""
    made = ("payload", "height", "width", "rgb", "features")
    names = apart(df.columns, made)
    df, keep, media = df.withColumnsRenamed(names), [names[c] for c in (df.columns if keep is None else keep)], names[media]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, files in slices(batch, media, 2 << 20):
                rows = []
                for data in files:
                    if data is None:
                        rows.append((None,) * 5)
                        continue
                    jpeg = Jpeg(data)
                    rgb = jpeg.rgb()
                    rows.append((jpeg.payload(), jpeg.height, jpeg.width, rgb.tobytes(), features(rgb)))
                types = (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
                columns = zip(*rows, strict=True)
                yield with_columns(part, keep, **{name: pa.array(list(c), t) for name, c, t in zip(made, columns, types, strict=True)})

    schema = kept_schema(df, keep, *zip(made, ("binary", "int", "int", "binary", "array<bigint>"), strict=True))
    return df.select(*dict.fromkeys([*keep, media])).mapInArrow(run, schema)
