"""Media columns: progressive JPEG, written and read in numpy.

Reading follows the scans of a progressive file: each one adds a band of coefficients (spectral selection) or one more
bit of them (successive approximation) to the coefficient arrays of the components; the inverse transform is one
matrix product over all blocks, chroma is upsampled to full resolution, and the result is an RGB tensor.

``pack`` stores bytes losslessly in such a file. The unit is the quantised coefficient, which JPEG's entropy coding
keeps exactly: the upper seven bits of a byte choose one of the 128 values of size category 7 (64 to 127 and their
negatives), the lowest bit is its refinement; 64 coefficients are a block, and blocks are laid over the luma grid and
then the two chroma grids (4:2:0). Since all values have one size category, every code has the same length, and numpy
packs and unpacks whole scans at once. Scans of any other file take the bit reader, which reads all progressive
Huffman streams with 8-bit samples.

Defined cases: null text is empty, and an empty text is one block of zeros; equal texts give equal values; other
columns pass through ``decode_media``, whatever their names; null media, and media that are truncated, corrupt or no
progressive JPEG, give null height, width and tensor; empty tables and repeated rows need nothing special; a text of any length is stored whole, as long as the image's sides fit JPEG's 65,535 (about 6 GB).
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, with_columns

BLOCK = 64
#: Horizontal and vertical sampling of Y, Cb, Cr, and their blocks in an MCU of 16 x 16 pixels.
SAMPLING = ((2, 2), (1, 1), (1, 1))
#: Bands of the first AC scans of each component.
BANDS = (((1, 5), (6, 63)), ((1, 63),), ((1, 63),))
_MARKER = re.compile(b"\xff[^\x00\xff\xd0-\xd7]")


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


def _inverse() -> np.ndarray:
    """64 coefficients in zigzag order -> 64 samples, as one matrix."""
    u, x = np.mgrid[:8, :8]
    basis = np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    return np.kron(basis, basis)[zigzag()].astype(np.float32)


INVERSE = _inverse()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(kind: int, slot: int, symbol: int) -> bytes:
    """A Huffman table with one code, the single bit 0."""
    return _segment(0xC4, bytes([kind << 4 | slot, 1, *[0] * 15, symbol]))


def _sos(parts, low: int, high: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(parts), *(x for c in parts for x in (c + 1, 0)), low, high, ah << 4 | al]))


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits (a multiple of 8 or padded with ones) to bytes with 00 after each FF."""
    if pad := -bits.size % 8:
        bits = np.concatenate((bits.ravel(), np.ones(pad, np.uint8)))
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def pack(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold ``payload`` (a positive multiple of 64 bytes)."""
    blocks = len(payload) // BLOCK
    mcus = -(-blocks // 6)
    across = isqrt(mcus - 1) + 1
    down = -(-mcus // across)
    data = np.zeros((6 * across * down, BLOCK), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    one = across * down
    comps = (data[: 4 * one], data[4 * one : 5 * one], data[5 * one :])
    top = [c >> 1 for c in comps]  # the code 0 and seven bits: a byte each, and never FF
    frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(SAMPLING))
    out = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(payload)), _segment(0xDB, b"\x00" + b"\x01" * 64), _segment(0xC2, frame)]
    # DC, all but the last bit: a restart after each block keeps the differences of one size
    out += [_one_code(0, 0, 7), _segment(0xDD, b"\x00\x01")]
    for k, c in enumerate(top):
        cells = np.full((len(c), 3), 0xFF, np.uint8)
        cells[:, 0], cells[:, 2] = c[:, 0], 0xD0 + np.arange(len(c)) % 8
        body = cells.tobytes()
        out += [_sos([k], 0, 0, 0, 1), body[:-2]]
    out += [_segment(0xDD, b"\x00\x00"), _one_code(1, 0, 7)]
    for k, c in enumerate(top):
        for low, high in BANDS[k]:
            out += [_sos([k], low, high, 0, 1), c[:, low : high + 1].tobytes()]
    out.append(_one_code(1, 0, 0))
    for k, c in enumerate(comps):
        out += [_sos([k], 0, 0, 1, 0), _stuffed(c[:, 0] & 1)]
        bits = c & 1
        bits[:, 0] = 0  # the code of "end of block", then a correction bit for each coefficient
        out += [_sos([k], 1, 63, 1, 0), _stuffed(bits)]
    return b"".join(out) + b"\xff\xd9"


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        code = at = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.only = (next(iter(self.codes))[0], symbols[0]) if len(symbols) == 1 else None


class Bits:
    """Reads one restart interval bit by bit."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def one(self) -> int:
        self.at += 1
        if self.at > len(self.bits):
            raise ValueError("the scan ends early")
        return self.bits[self.at - 1]

    def many(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.one()
        return value

    def signed(self, n: int) -> int:
        value = self.many(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.one()
            if (found := table.codes.get((length, code))) is not None:
                return found
        raise ValueError("no such Huffman code")


class Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.ident, self.h, self.v, self.table = ident, h, v, table


class Progressive:
    """The state of one file: tables, components and the coefficients gathered so far (blocks x 64, zigzag order)."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[int, Huffman] = {}
        self.restart, self.comments = 0, []
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while at < len(data):
            marker = data[at + 1]
            if marker == 0xD9:
                return
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDA:
                end = found.start() if (found := _MARKER.search(data, at)) else len(data)
                self.scan(body, data[at:end])
                at = end
            elif marker == 0xC2:
                self.frame(body)
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = Huffman(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xFE:
                self.comments.append(body)
            elif marker in (0xC0, 0xC1, 0xC3):
                raise ValueError("not a progressive file")
        raise ValueError("the file ends early")

    def frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if bits != 8 or n not in (1, 3):
            raise ValueError("only 8-bit samples of one or three components")
        self.comps = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        self.hmax, self.vmax = max(c.h for c in self.comps), max(c.v for c in self.comps)
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.comps:
            c.wide, c.tall = self.across * c.h, self.down * c.v  # with the padding of whole MCUs
            c.own_wide = -(-(-(-self.width * c.h // self.hmax)) // 8)
            c.own_tall = -(-(-(-self.height * c.v // self.vmax)) // 8)
            c.coef = np.zeros((c.wide * c.tall, BLOCK), np.int32)

    def scan(self, body: bytes, coded: bytes) -> None:
        n = body[0]
        parts = [(next(c for c in self.comps if c.ident == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(n)]
        low, high, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if n == 1 and self.even(parts[0], coded, low, high, ah, al):
            return
        if n == 1:
            c = parts[0][0]
            units = [[(0, y * c.wide + x)] for y in range(c.own_tall) for x in range(c.own_wide)]
        else:
            units = [[(k, (y * c.v + j) * c.wide + x * c.h + i) for k, (c, _) in enumerate(parts) for j in range(c.v) for i in range(c.h)] for y in range(self.down) for x in range(self.across)]
        pieces = re.split(b"\xff[\xd0-\xd7]", coded) if self.restart else [coded]
        step = self.restart or len(units)
        for k, piece in enumerate(pieces):
            self.interval(parts, units[k * step : (k + 1) * step], Bits(piece.replace(b"\xff\x00", b"\xff")), low, high, ah, al)

    def even(self, part, coded: bytes, low: int, high: int, ah: int, al: int) -> bool:
        """A scan whose codes all have one length: whole arrays at once. False if it isn't such a scan."""
        c, tables = part
        if (c.wide, c.tall) != (c.own_wide, c.own_tall):
            return False
        n, dc = len(c.coef), low == 0
        if dc and ah:
            if self.restart:
                return False
            bits = np.unpackbits(self.enough(coded, n), count=n)
            c.coef[:, 0] |= bits.astype(np.int32) << al
            return True
        table = self.huffman[(tables >> 4) if dc else 16 | tables & 15]
        if not table.only:
            return False
        length, symbol = table.only
        if dc:
            if self.restart != 1 or length + symbol > 8:
                return False
            raw = np.frombuffer(re.sub(b"\xff[\x00\xd0-\xd7]", lambda m: b"\xff" if m[0][1] == 0 else b"", coded), np.uint8)
            if len(raw) != n:
                return False
            c.coef[:, 0] = self.valued(raw >> (8 - length - symbol), symbol) << al
            return True
        if self.restart:
            return False
        band = high - low + 1
        raw = self.enough(coded, n * (length + (band if ah else 8 * band - length)))
        if not ah and 0 < symbol and length + symbol == 8:
            c.coef[:, low : high + 1] = self.valued(raw[: n * band], symbol).reshape(n, band) * (1 << al)
            return True
        if ah and symbol == 0 and c.coef[:, low : high + 1].all():
            bits = np.unpackbits(raw, count=n * (length + band)).reshape(n, length + band)[:, length:].astype(np.int32) << al
            now = c.coef[:, low : high + 1]
            c.coef[:, low : high + 1] = np.where(now > 0, now + bits, now - bits)
            return True
        return False

    @staticmethod
    def enough(coded: bytes, bits: int) -> np.ndarray:
        """The bytes of a scan that has at least so many bits."""
        raw = np.frombuffer(coded.replace(b"\xff\x00", b"\xff"), np.uint8)
        if 8 * raw.size < bits:
            raise ValueError("the scan ends early")
        return raw

    @staticmethod
    def valued(raw: np.ndarray, size: int) -> np.ndarray:
        """Values of a size category from their bits, the low ones of ``raw``."""
        value = raw.astype(np.int32) & ((1 << size) - 1)
        return np.where(value >> (size - 1), value, value - (1 << size) + 1)

    def interval(self, parts, units, bits: Bits, low: int, high: int, ah: int, al: int) -> None:
        before, run = [0] * len(parts), 0
        for unit in units:
            for k, block in unit:
                c, tables = parts[k]
                coef = c.coef[block]
                if low == 0:
                    if ah:
                        coef[0] |= bits.one() << al
                    else:
                        before[k] += bits.signed(bits.symbol(self.huffman[tables >> 4]))
                        coef[0] = before[k] << al
                else:
                    table = self.huffman[16 | tables & 15]
                    run = (self.refine if ah else self.first)(coef, table, bits, low, high, al, run)

    @staticmethod
    def first(coef, table, bits: Bits, low: int, high: int, al: int, run: int) -> int:
        if run:
            return run - 1
        at = low
        while at <= high:
            zeros, size = divmod(bits.symbol(table), 16)
            if size:
                at += zeros
                coef[at] = bits.signed(size) * (1 << al)
                at += 1
            elif zeros == 15:
                at += 16
            else:
                return (1 << zeros) + bits.many(zeros) - 1
        return 0

    @staticmethod
    def refine(coef, table, bits: Bits, low: int, high: int, al: int, run: int) -> int:
        at, bit = low, 1 << al

        def correct(k: int) -> None:
            if bits.one():
                coef[k] += bit if coef[k] > 0 else -bit

        while not run and at <= high:
            zeros, size = divmod(bits.symbol(table), 16)
            if not size and zeros < 15:
                run = (1 << zeros) + bits.many(zeros)
                break
            new = (bit if bits.one() else -bit) if size else 0
            while at <= high:
                if coef[at]:
                    correct(at)
                elif zeros:
                    zeros -= 1
                else:
                    break
                at += 1
            if new:
                coef[at] = new
            at += 1
        if run:
            for k in range(at, high + 1):
                if coef[k]:
                    correct(k)
            return run - 1
        return 0

    def payload(self) -> bytes:
        """The bytes that ``pack`` has stored."""
        note = next(c for c in self.comments if c.startswith(b"payload="))
        units = np.concatenate([c.coef for c in self.comps])
        large = np.abs(units)
        large[:, 0] = units[:, 0]  # DC refinement adds the bit in two's complement, AC refinement to the magnitude
        low, high = large & 1, large >> 1
        high[:, 1:] *= np.where(units[:, 1:] < 0, -1, 1)
        if not ((np.abs(high) >= 64) & (np.abs(high) < 128)).all():
            raise ValueError("coefficients aren't those of a stored payload")
        data = (np.where(high < 0, high + 127, high) << 1 | low).astype(np.uint8)
        return data.tobytes()[: int(note[8:])]

    def rgb(self) -> np.ndarray:
        """height x width x 3, 8 bits, at full resolution."""
        planes = []
        for c in self.comps:
            q = self.quant[c.table]
            samples = (c.coef * q).astype(np.float32) @ INVERSE
            samples += 128
            np.rint(samples, out=samples)
            np.clip(samples, 0, 255, out=samples)
            plane = samples.reshape(c.tall, c.wide, 8, 8).swapaxes(1, 2).reshape(c.tall * 8, c.wide * 8)
            if (c.v, c.h) != (self.vmax, self.hmax):
                plane = plane.repeat(self.vmax // c.v, axis=0).repeat(self.hmax // c.h, axis=1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][..., None], 3, axis=2).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
        out = np.empty((*y.shape, 3), np.uint8)
        for k, plane in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
            np.rint(plane, out=plane)
            out[..., k] = np.clip(plane, 0, 255, out=plane)
        return out


def padded(data: bytes) -> bytes:
    return data + bytes(BLOCK * max(1, -(-len(data) // BLOCK)) - len(data))


def pack_texts(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with the text's UTF-8 bytes, padded, as a progressive JPEG in column ``media``."""
    docs = docs.drop(media)
    at = docs.columns.index(text)
    packed = lambda columns: [pa.array([pack(padded((t or "").encode())) for t in columns[at].to_pylist()], pa.binary())]
    return with_columns(docs, lambda: packed, 64, **{media: "binary"})


def tensor(data: bytes | None) -> np.ndarray | None:
    """The picture of a file; none if it can't be read."""
    try:
        return None if data is None else Progressive(data).rgb()
    except (ValueError, LookupError, AttributeError, StopIteration, struct.error):  # what broken segments lead to
        return None


def decode_media(rows: DataFrame, media: str = "media") -> DataFrame:
    """``rows`` with height, width and tensor (row-major RGB bytes) of the JPEG in column ``media``."""
    rows = rows.drop("height", "width", "tensor")
    at = rows.columns.index(media)

    def decoded(columns):
        out = [tensor(d) for d in columns[at].to_pylist()]
        sides = [pa.array([None if o is None else o.shape[k] for o in out], pa.int32()) for k in (0, 1)]
        return [*sides, pa.array([None if o is None else o.tobytes() for o in out], pa.binary())]

    return with_columns(rows, lambda: decoded, 16, height="int", width="int", tensor="binary")


def media_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored, read back and described; the tensors themselves stay on the workers."""
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                out = []
                for text in part.column(1).to_pylist():
                    data = (text or "").encode()
                    media = pack(padded(data))
                    image = Progressive(media)
                    back, rgb = image.payload(), image.rgb()
                    mean = rgb.reshape(-1, 3).sum(0, dtype=np.int64).tolist()
                    feature = f"{image.height}x{image.width}:{mean[0]}:{mean[1]}:{mean[2]}:{zlib.crc32(rgb):08x}"
                    out.append((len(data), len(back), sha(back), zlib.crc32(back[-BLOCK:]), len(media), sha(media), feature))
                cols = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
