"""Progressive JPEG in numpy: coefficient arrays to files and back.

The decoder reads spectral-selection and successive-approximation scans
(Huffman-coded, interleaved DC, single-component AC, end-of-band runs) into one
coefficient array for each component, applies an inverse transform to all
blocks at once, repeats chroma samples up to full resolution and returns an
RGB tensor.  Scans whose code tables hold a single symbol have a fixed layout
of bits and are read as arrays; all other scans are read bit by bit.

The writer takes coefficient arrays of any values that the format allows.  For
*payloads* it uses the 256 coefficient values of magnitude category 8, which
are exactly those that eight magnitude bits stand for: byte b is the value b
from 128 up and b - 255 below.  Their scans have such fixed layouts.

Image geometry is 4:2:0 with three components: an MCU of 16 x 16 pixels has
four Y blocks, one Cb and one Cr.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np


def zigzag() -> np.ndarray:
    """Natural index of each coefficient in scan order."""
    cells = sorted(
        ((r, c) for r in range(8) for c in range(8)),
        key=lambda rc: (rc[0] + rc[1], rc[0] if (rc[0] + rc[1]) % 2 else rc[1]),
    )
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()


def cosine_basis() -> np.ndarray:
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return basis.astype(np.float32)


BASIS = cosine_basis()


# ---------------------------------------------------------------- code tables


@dataclass
class Codes:
    """A canonical Huffman table: code lengths' counts, symbols in order."""

    counts: list[int]
    symbols: list[int]
    lookup: dict[tuple[int, int], int] = field(init=False)
    code_of: dict[int, tuple[int, int]] = field(init=False)

    def __post_init__(self) -> None:
        self.lookup, self.code_of = {}, {}
        code = k = 0
        for length, n in enumerate(self.counts, 1):
            for _ in range(n):
                self.lookup[length, code] = self.symbols[k]
                self.code_of[self.symbols[k]] = (code, length)
                code += 1
                k += 1
            code <<= 1

    @classmethod
    def even(cls, symbols: list[int]) -> Codes:
        """All symbols with codes of one length; the code of ones stays free."""
        length = max(1, len(symbols).bit_length())
        return cls([len(symbols) if n == length else 0 for n in range(1, 17)], symbols)

    def segment(self, kind: int, number: int) -> bytes:
        body = bytes([kind << 4 | number, *self.counts, *self.symbols])
        return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


# ---------------------------------------------------------------- bits


class BitWriter:
    def __init__(self) -> None:
        self.value = self.n = 0
        self.out = bytearray()

    def put(self, value: int, n: int) -> None:
        self.value = self.value << n | value
        self.n += n
        while self.n >= 8:
            self.n -= 8
            self.out.append(self.value >> self.n & 255)
        self.value &= (1 << self.n) - 1

    def bytes(self) -> bytes:
        if self.n:
            self.put((1 << (8 - self.n)) - 1, 8 - self.n)
        return bytes(self.out)


class BitReader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.value, self.n = data, 0, 0, 0

    def get(self, n: int) -> int:
        while self.n < n:
            byte = self.data[self.at] if self.at < len(self.data) else 255
            self.at += 1
            self.value = self.value << 8 | byte
            self.n += 8
        self.n -= n
        out = self.value >> self.n
        self.value &= (1 << self.n) - 1
        return out

    def symbol(self, codes: Codes) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.get(1)
            found = codes.lookup.get((length, code))
            if found is not None:
                return found
        raise ValueError("no such code")


def stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def extended(bits: int, size: int) -> int:
    """The value that ``size`` magnitude bits stand for."""
    return bits if size and bits >> (size - 1) else bits - (1 << size) + 1


# ---------------------------------------------------------------- geometry


@dataclass
class Frame:
    """Size in pixels; blocks are held MCU-aligned, row by row."""

    width: int
    height: int
    #: (identifier, horizontal and vertical sampling, quantisation table)
    parts: list[tuple[int, int, int, int]]

    @property
    def most(self) -> tuple[int, int]:
        return max(p[1] for p in self.parts), max(p[2] for p in self.parts)

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = self.most
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def shape(self, k: int) -> tuple[int, int]:
        """Rows and columns of blocks, filled up to whole MCUs."""
        across, down = self.mcus
        return down * self.parts[k][2], across * self.parts[k][1]

    def own(self, k: int) -> tuple[int, int]:
        """Rows and columns of blocks that a scan of one component has."""
        h, v = self.most
        wide = -(-self.width * self.parts[k][1] // h)
        high = -(-self.height * self.parts[k][2] // v)
        return -(-high // 8), -(-wide // 8)

    def interleaved(self) -> list[tuple[int, np.ndarray]]:
        """For each block of an MCU: component, and block indices by MCU."""
        across, down = self.mcus
        out = []
        for k, (_, h, v, _) in enumerate(self.parts):
            cols = self.shape(k)[1]
            for y in range(v):
                for x in range(h):
                    rows = np.arange(down)[:, None] * v + y
                    out.append((k, (rows * cols + np.arange(across) * h + x).ravel()))
        return out


# ---------------------------------------------------------------- writing


def header(frame: Frame, comment: bytes) -> bytes:
    q = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([1] * 64)
    parts = b"".join(struct.pack(">BBB", i, h << 4 | v, t) for i, h, v, t in frame.parts)
    sof = struct.pack(">HBHHB", 8 + len(parts), 8, frame.height, frame.width, len(frame.parts))
    com = b"\xff\xfe" + struct.pack(">H", len(comment) + 2) + comment
    return b"\xff\xd8" + com + q + b"\xff\xc2" + sof + parts


def scan(ids: list[int], start: int, end: int, high: int, low: int, data: bytes) -> bytes:
    parts = b"".join(bytes([i, 0]) for i in ids)
    head = struct.pack(">HB", 6 + len(parts), len(ids)) + parts + bytes([start, end, high << 4 | low])
    return b"\xff\xda" + head + stuffed(data)


def dc_first(frame: Frame, coefficients: list[np.ndarray], low: int) -> bytes:
    """Differences of shifted DC values, MCU by MCU, written as arrays."""
    blocks = frame.interleaved()
    per_mcu = np.stack([coefficients[k][at, 0].astype(np.int64) >> low for k, at in blocks], axis=1)
    values = per_mcu.ravel()
    diff = np.empty_like(values)
    which = np.array([k for k, _ in blocks] * len(per_mcu))
    for k in range(len(frame.parts)):
        own = np.flatnonzero(which == k)
        diff[own] = np.diff(values[own], prepend=0)
    size = np.zeros(len(diff), np.int64)
    left = np.abs(diff)
    while left.any():
        size += left > 0
        left >>= 1
    # twelve sizes share codes of four bits, in order
    code = size
    raw = np.where(diff < 0, diff + (1 << size) - 1, diff)
    return packed_bits((code << size) | raw, 4 + size)


def packed_bits(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """The low bits of each value in a row, filled up with ones."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    owner = np.repeat(np.arange(len(values)), lengths)
    place = ends[owner] - 1 - np.arange(total)
    bits = (values[owner] >> place & 1).astype(np.uint8)
    return np.packbits(np.concatenate([bits, np.ones(-total % 8, np.uint8)])).tobytes()


DC_SIZES = Codes.even(list(range(12)))


def band_runs(blocks: int) -> list[int]:
    """End-of-band runs that cover so many blocks, each below 2^15."""
    full, rest = divmod(blocks, 32767)
    return [32767] * full + ([rest] if rest else [])


def payload_shape(n_blocks: int) -> Frame:
    """A nearly square 4:2:0 frame with room for so many blocks."""
    mcus = max(1, -(-n_blocks // 6))
    across = int(np.ceil(np.sqrt(mcus)))
    down = -(-mcus // across)
    if max(across, down) * 16 > 65535:
        raise ValueError("the payload does not fit one image")
    return Frame(16 * across, 16 * down, [(1, 2, 2, 0), (2, 1, 1, 0), (3, 1, 1, 0)])


def payload_blocks(frame: Frame) -> list[tuple[int, int, int]]:
    """(component, first block, blocks) in the order in which payload goes."""
    out, at = [], 0
    for k in range(3):
        rows, cols = frame.shape(k)
        out.append((k, at, rows * cols))
        at += rows * cols
    return out


def encode_payload(payload: bytes, comment: bytes = b"") -> bytes:
    """A progressive JPEG whose coefficients are the payload's bytes.

    Scans: DC without its lowest bit; the AC bands 1-5 and 6-63 of each
    component without theirs; the DC bits; the AC bits of each component.
    """
    if len(payload) % 64:
        raise ValueError("payloads come in blocks of 64 bytes")
    n = len(payload) // 64
    frame = payload_shape(n)
    room = sum(c for _, _, c in payload_blocks(frame))
    raw = np.zeros((room, 64), np.uint8)
    raw[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    parts = [raw[at : at + c] for _, at, c in payload_blocks(frame)]
    out = [header(frame, comment), DC_SIZES.segment(0, 0)]
    values = [np.where(p[:, :1] < 128, p[:, :1].astype(np.int16) - 255, p[:, :1]) for p in parts]
    out.append(scan([1, 2, 3], 0, 0, 0, 1, dc_first(frame, values, 1)))
    out.append(Codes.even([0x07]).segment(1, 0))
    for k, p in enumerate(parts):
        for a, b in ((1, 5), (6, 63)):
            # one bit of code and seven of magnitude make each coefficient a byte
            out.append(scan([k + 1], a, b, 0, 1, (p[:, a : b + 1] >> 1).tobytes()))
    dc = np.stack([values[k][at, 0] & 1 for k, at in frame.interleaved()], axis=1).ravel()
    out.append(scan([1, 2, 3], 0, 0, 1, 0, packed_bits(dc, np.ones(len(dc), np.int64))))
    for k, p in enumerate(parts):
        ac = p[:, 1:]
        out.append(ac_refinement(k + 1, np.where(ac < 128, 1 - (ac & 1), ac & 1).astype(np.uint8)))
    return b"".join([*out, b"\xff\xd9"])


def ac_refinement(part: int, bits: np.ndarray) -> bytes:
    """Correction bits of coefficients that are all nonzero, behind end-of-band
    runs; the table has the runs' sizes only."""
    runs = band_runs(len(bits))
    sizes = sorted({r.bit_length() - 1 for r in runs})
    codes = Codes.even([s << 4 for s in sizes])
    pieces: list[np.ndarray] = []
    at = 0
    for r in runs:
        s = r.bit_length() - 1
        code, length = codes.code_of[s << 4]
        head = code << s | (r - (1 << s))
        pieces.append(np.array([head >> k & 1 for k in range(length + s - 1, -1, -1)], np.uint8))
        pieces.append(bits[at : at + r].ravel())
        at += r
    total = sum(map(len, pieces))
    pieces.append(np.ones(-total % 8, np.uint8))
    data = np.packbits(np.concatenate(pieces)).tobytes()
    return codes.segment(1, 0) + scan([part], 1, 63, 1, 0, data)


# ---------------------------------------------------------------- reading


class Decoder:
    """Reads a progressive file; ``coefficients`` are in scan order by block."""

    def __init__(self, data: bytes, arrays: bool = True) -> None:
        self.arrays = arrays
        self.codes: dict[tuple[int, int], Codes] = {}
        self.quantisation: dict[int, np.ndarray] = {}
        self.comment = b""
        self.interval = 0  # units between restarts, if there are any
        self.frame: Frame | None = None
        self.coefficients: list[np.ndarray] = []
        self._read(data)

    def _read(self, data: bytes) -> None:
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        at = 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("a marker was expected")
            marker = data[at + 1]
            if marker == 0xD9:
                return
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self._quantisation(body)
            elif marker == 0xC4:
                self._tables(body)
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xDA:
                end, first, parts = at, at, []
                while True:
                    end = data.index(b"\xff", end)
                    if data[end + 1] == 0:  # a stuffed byte
                        end += 2
                    elif self.interval and 0xD0 <= data[end + 1] <= 0xD7:  # a restart
                        parts.append(data[first:end])
                        first = end = end + 2
                    else:
                        break
                parts.append(data[first:end])
                for k, part in enumerate(parts):
                    units = slice(k * self.interval, (k + 1) * self.interval) if self.interval else slice(None)
                    self._scan(body, part.replace(b"\xff\x00", b"\xff"), units)
                at = end
            elif marker == 0xDD:
                (self.interval,) = struct.unpack(">H", body)
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError(f"unsupported segment {marker:#x}")

    def _quantisation(self, body: bytes) -> None:
        while body:
            wide, number = body[0] >> 4, body[0] & 15
            n = 128 if wide else 64
            self.quantisation[number] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
            body = body[1 + n :]

    def _tables(self, body: bytes) -> None:
        while body:
            counts = list(body[1:17])
            n = sum(counts)
            self.codes[body[0] >> 4, body[0] & 15] = Codes(counts, list(body[17 : 17 + n]))
            body = body[17 + n :]

    def _frame(self, body: bytes) -> None:
        _, height, width, n = struct.unpack_from(">BHHB", body)
        parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        self.frame = Frame(width, height, parts)
        for k in range(n):
            rows, cols = self.frame.shape(k)
            self.coefficients.append(np.zeros((rows * cols, 64), np.int16))

    def _scan(self, body: bytes, data: bytes, units: slice) -> None:
        """One scan's data between restarts, for that stretch of its units."""
        n = body[0]
        ids = [p[0] for p in self.frame.parts]
        which = [ids.index(body[1 + 2 * k]) for k in range(n)]
        tables = [body[2 + 2 * k] for k in range(n)]
        start, end, shift = body[1 + 2 * n : 4 + 2 * n]
        high, low = shift >> 4, shift & 15
        if start == 0:
            self._dc(which, tables, high, low, data, units)
            return
        k, codes = which[0], self.codes[1, tables[0] & 15]
        rows, cols = self.frame.own(k)
        at = (np.arange(rows)[:, None] * self.frame.shape(k)[1] + np.arange(cols)).ravel()[units]
        if high == 0:
            if not (self.arrays and self._ac_even(k, at, codes, start, end, low, data)):
                self._ac_first(k, at, codes, start, end, low, data)
        elif not (self.arrays and self._ac_bits(k, at, codes, start, end, low, data)):
            self._ac_refine(k, at, codes, start, end, low, data)

    def _dc(self, which: list[int], tables: list[int], high: int, low: int, data: bytes, units: slice) -> None:
        if len(which) == 1:
            rows, cols = self.frame.own(which[0])
            at = (np.arange(rows)[:, None] * self.frame.shape(which[0])[1] + np.arange(cols)).ravel()
            blocks = [(which[0], at)]
        else:
            blocks = [(k, at) for k, at in self.frame.interleaved() if k in which]
        blocks = [(k, at[units]) for k, at in blocks]
        n = len(blocks) * len(blocks[0][1])
        if high:
            bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n).reshape(-1, len(blocks))
            for c, (k, at) in enumerate(blocks):
                self.coefficients[k][at, 0] |= bits[:, c].astype(np.int16) << low
            return
        table = {k: self.codes[0, t >> 4] for k, t in zip(which, tables)}
        order = [k for k, _ in blocks]
        if all(table[k] is table[order[0]] for k in order):
            diff = self._even_diffs(table[order[0]], n, data)
        else:
            diff = None
        if diff is None:
            reader, found = BitReader(data), []
            for _ in range(n // len(order)):
                for k in order:
                    size = reader.symbol(table[k])
                    found.append(extended(reader.get(size), size))
            diff = np.array(found, np.int64)
        per_mcu = diff.reshape(-1, len(order))
        for k in set(order):
            columns = [c for c, x in enumerate(order) if x == k]
            values = np.cumsum(per_mcu[:, columns].ravel()).reshape(-1, len(columns)) << low
            for c, own in zip(columns, values.T):
                self.coefficients[k][blocks[c][1], 0] = own

    @staticmethod
    def _even_diffs(codes: Codes, n: int, data: bytes) -> np.ndarray | None:
        """Differences where all codes have one length."""
        lengths = {length for length, _ in codes.lookup}
        if len(lengths) != 1:
            return None
        (length,) = lengths
        size_of = [codes.lookup.get((length, c), 0) for c in range(1 << length)]
        bits = int.from_bytes(data, "big") if len(data) <= 64 else None
        out = [0] * n
        at, total = 0, 8 * len(data)
        for k in range(n):
            if bits is None:
                first = at >> 3
                window = int.from_bytes(data[first : first + 5].ljust(5, b"\xff"), "big")
                left = 40 - (at & 7)
            else:
                window, left = bits, total - at
            size = size_of[window >> (left - length) & ((1 << length) - 1)]
            if size:
                raw = window >> (left - length - size) & ((1 << size) - 1)
                out[k] = raw if raw >> (size - 1) else raw - (1 << size) + 1
            at += length + size
        return np.array(out, np.int64)

    def _ac_even(self, k, at, codes, start, end, low, data) -> bool:
        """One symbol of run 0: every coefficient is a code bit and its bits."""
        if len(codes.symbols) != 1 or codes.code_of[codes.symbols[0]][1] != 1:
            return False
        run, size = codes.symbols[0] >> 4, codes.symbols[0] & 15
        if run or size != 7:
            return False
        n = len(at) * (end - start + 1)
        raw = np.frombuffer(data, np.uint8, n).astype(np.int16)
        value = np.where(raw & 64, raw, raw - 127) * np.int16(1 << low)
        self.coefficients[k][at, start : end + 1] = value.reshape(len(at), -1)
        return True

    def _ac_bits(self, k, at, codes, start, end, low, data) -> bool:
        """Only end-of-band runs, over coefficients that are all nonzero."""
        if any(s & 15 for s in codes.symbols):
            return False
        block = self.coefficients[k][at, start : end + 1]
        if not block.all():
            return False
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        width, done, here = end - start + 1, 0, 0
        fixed = np.empty(block.shape, np.uint8)
        while done < len(at):
            code = 0
            for length in range(1, 17):
                code = code << 1 | int(bits[here])
                here += 1
                symbol = codes.lookup.get((length, code))
                if symbol is not None:
                    break
            s = symbol >> 4
            run = 1 << s
            for b in bits[here : here + s]:
                s -= 1
                run += int(b) << s
            here += symbol >> 4
            fixed[done : done + run] = bits[here : here + run * width].reshape(run, width)
            here += run * width
            done += run
        step = fixed.astype(np.int16) << low
        self.coefficients[k][at, start : end + 1] = np.where(block < 0, block - step, block + step)
        return True

    def _ac_first(self, k, at, codes, start, end, low, data) -> None:
        reader, skip, coefficients = BitReader(data), 0, self.coefficients[k]
        for b in at:
            if skip:
                skip -= 1
                continue
            z = start
            while z <= end:
                symbol = reader.symbol(codes)
                run, size = symbol >> 4, symbol & 15
                if size:
                    z += run
                    coefficients[b, z] = extended(reader.get(size), size) * (1 << low)
                    z += 1
                elif run == 15:
                    z += 16
                else:
                    skip = (1 << run) + reader.get(run) - 1
                    break

    def _ac_refine(self, k, at, codes, start, end, low, data) -> None:
        reader, skip, coefficients = BitReader(data), 0, self.coefficients[k]
        step = 1 << low

        def correct(b: int, z: int) -> None:
            if reader.get(1):
                coefficients[b, z] += step if coefficients[b, z] > 0 else -step

        for b in at:
            z = start
            while not skip and z <= end:
                symbol = reader.symbol(codes)
                zeros, size = symbol >> 4, symbol & 15
                value = 0
                if size:
                    value = step if reader.get(1) else -step
                elif zeros < 15:
                    skip = (1 << zeros) + reader.get(zeros)
                    break
                while z <= end:
                    if coefficients[b, z]:
                        correct(b, z)
                    elif zeros:
                        zeros -= 1
                    else:
                        coefficients[b, z] = value
                        z += 1
                        break
                    z += 1
            if skip:
                for rest in range(z, end + 1):
                    if coefficients[b, rest]:
                        correct(b, rest)
                skip -= 1

    def planes(self) -> list[np.ndarray]:
        """Samples of each component at its own resolution, MCU-aligned."""
        out = []
        for k, c in enumerate(self.coefficients):
            table = self.quantisation[self.frame.parts[k][3]]
            natural = np.empty((len(c), 64), np.float32)
            natural[:, ZIGZAG] = c * table
            blocks = BASIS.T @ natural.reshape(-1, 8, 8) @ BASIS
            rows, cols = self.frame.shape(k)
            plane = blocks.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * cols)
            out.append(np.clip(np.rint(plane + 128), 0, 255))
        return out

    def rgb(self) -> np.ndarray:
        """The full-resolution tensor, ``[row, column, 3]`` of bytes."""
        h, v = self.frame.most
        full = []
        for plane, (_, hk, vk, _) in zip(self.planes(), self.frame.parts):
            wide = np.repeat(np.repeat(plane, v // vk, axis=0), h // hk, axis=1)
            full.append(wide[: self.frame.height, : self.frame.width])
        if len(full) == 1:
            full = [full[0], np.full_like(full[0], 128), np.full_like(full[0], 128)]
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        tensor = np.empty((*y.shape, 3), np.uint8)
        # fixed values: the conversion of the file interchange format
        for c, plane in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
            tensor[:, :, c] = np.clip(np.rint(plane), 0, 255)
        return tensor

    def payload(self, n: int) -> bytes:
        """The first n bytes of a file from :func:`encode_payload`."""
        values = np.concatenate(self.coefficients)
        return np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()[:n]


def decode(data: bytes) -> np.ndarray:
    """RGB tensor of a progressive JPEG."""
    return Decoder(data).rgb()
