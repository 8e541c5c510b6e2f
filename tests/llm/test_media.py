import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from tests.llm.edge import edge_documents, empty_documents
from tesserql.llm import jpeg, media


def slow_inverse(block):
    """An 8x8 inverse transform by its defining sum."""
    out = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            for v in range(8):
                for u in range(8):
                    scale = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
                    out[y, x] += (
                        scale * block[v, u]
                        * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
                    )
    return out


@pytest.mark.parametrize("blocks", [1, 2, 6, 7, 40])
def test_payload_round_trip_in_both_readers(blocks):
    payload = os.urandom(64 * blocks)
    data = jpeg.encode_payload(payload, b"note")
    by_array, by_bit = jpeg.Decoder(data), jpeg.Decoder(data, arrays=False)
    assert by_array.payload(len(payload)) == by_bit.payload(len(payload)) == payload
    assert by_array.comment == b"note"


def test_long_runs_span_many_blocks():
    payload = bytes(range(256)) * 60_000
    image = jpeg.Decoder(jpeg.encode_payload(payload))
    assert image.payload(len(payload)) == payload


def sparse_file(rng):
    """A grey image with zero runs, both refinements and end-of-band runs."""
    frame = jpeg.Frame(24, 16, [(1, 1, 1, 0)])
    n = 6
    values = np.zeros((n, 64), np.int64)
    for b in range(n):
        if b not in (2, 3):
            for z in rng.sample(range(64), 9):
                values[b, z] = rng.choice([-9, -3, -2, -1, 1, 2, 3, 14])
    w = jpeg.BitWriter()
    shifted = np.sign(values) * (np.abs(values) >> 1)
    before = 0
    sizes = jpeg.DC_SIZES
    for b in range(n):
        d = int(values[b, 0] >> 1) - before
        before += d
        size = abs(d).bit_length()
        w.put(*sizes.code_of[size])
        if size:
            w.put(d if d > 0 else d + (1 << size) - 1, size)
    dc = jpeg.scan([1], 0, 0, 0, 1, w.bytes())
    symbols = [r << 4 | s for r in range(16) for s in range(5) if s or r == 15 or r < 4]
    codes = jpeg.Codes.even(symbols)
    w = jpeg.BitWriter()
    skip = 0

    def flush():
        nonlocal skip
        if skip:
            s = skip.bit_length() - 1
            w.put(*codes.code_of[s << 4])
            if s:
                w.put(skip - (1 << s), s)
        skip = 0

    for b in range(n):
        run = 0
        for z in range(1, 64):
            v = int(shifted[b, z])
            if v == 0:
                run += 1
                continue
            flush()
            while run > 15:
                w.put(*codes.code_of[0xF0])
                run -= 16
            size = abs(v).bit_length()
            w.put(*codes.code_of[run << 4 | size])
            w.put(v if v > 0 else v + (1 << size) - 1, size)
            run = 0
        if run:
            skip += 1
    flush()
    first = codes.segment(1, 0) + jpeg.scan([1], 1, 63, 0, 1, w.bytes())
    w = jpeg.BitWriter()
    for b in range(n):
        w.put(int(values[b, 0]) & 1, 1)
    dc_bits = jpeg.scan([1], 0, 0, 1, 0, w.bytes())
    w = jpeg.BitWriter()
    for b in range(n):
        run, pending = 0, []
        new = [z for z in range(1, 64) if abs(values[b, z]) == 1]
        last = new[-1] if new else 0
        for z in range(1, last + 1):
            v = int(values[b, z])
            if abs(v) > 1:
                pending.append(abs(v) & 1)
                continue
            if v == 0:
                run += 1
                if run == 16:
                    w.put(*codes.code_of[0xF0])
                    for bit in pending:
                        w.put(bit, 1)
                    run, pending = 0, []
                continue
            w.put(*codes.code_of[run << 4 | 1])
            w.put(int(v > 0), 1)
            for bit in pending:
                w.put(bit, 1)
            run, pending = 0, []
        if last < 63:
            w.put(*codes.code_of[0])
        for z in range(last + 1, 64):
            if abs(values[b, z]) > 1:
                w.put(abs(int(values[b, z])) & 1, 1)
    second = jpeg.scan([1], 1, 63, 1, 0, w.bytes())
    data = jpeg.header(frame, b"") + sizes.segment(0, 0) + dc + first + dc_bits + second + b"\xff\xd9"
    return data, values


def test_general_scans():
    rng = random.Random(5)
    for _ in range(20):
        data, values = sparse_file(rng)
        assert (jpeg.Decoder(data).coefficients[0] == values).all()


def test_restart_intervals():
    """Predictions and end-of-band runs begin anew at each restart marker."""
    rng = random.Random(9)
    frame = jpeg.Frame(40, 8, [(1, 1, 1, 0)])
    dc = [rng.randrange(-200, 200) for _ in range(5)]
    codes = jpeg.Codes.even([0, 0x10, 0x01, 0xF0])
    starts, bands = [], []
    for at in (0, 2, 4):
        w, before = jpeg.BitWriter(), 0
        for v in dc[at : at + 2]:
            d, before = v - before, v
            w.put(*jpeg.DC_SIZES.code_of[abs(d).bit_length()])
            if d:
                w.put(d if d > 0 else d + (1 << abs(d).bit_length()) - 1, abs(d).bit_length())
        starts.append(jpeg.stuffed(w.bytes()))
        w = jpeg.BitWriter()  # the first block of each stretch holds one coefficient
        w.put(*codes.code_of[0x01])
        w.put(1, 1)
        w.put(*codes.code_of[0x00 if at == 4 else 0x10])
        if at < 4:
            w.put(0, 1)  # a run of two: the rest of this block, and the next
        bands.append(jpeg.stuffed(w.bytes()))

    def joined(parts):
        return b"".join(p + (b"" if k == len(parts) - 1 else bytes([0xFF, 0xD0 + k])) for k, p in enumerate(parts))

    data = (
        jpeg.header(frame, b"") + b"\xff\xdd\x00\x04\x00\x02" + jpeg.DC_SIZES.segment(0, 0)
        + jpeg.scan([1], 0, 0, 0, 0, b"") + joined(starts)
        + codes.segment(1, 0) + jpeg.scan([1], 1, 63, 0, 0, b"") + joined(bands) + b"\xff\xd9"
    )
    for arrays in (True, False):
        found = jpeg.Decoder(data, arrays=arrays).coefficients[0]
        assert found[:, 0].tolist() == dc
        assert found[:, 1].tolist() == [1, 0, 1, 0, 1] and not found[:, 2:].any()


def test_inverse_transform_and_chroma():
    data = jpeg.encode_payload(os.urandom(64 * 6))
    image = jpeg.Decoder(data)
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = image.coefficients[1][0]
    slow = np.clip(np.rint(slow_inverse(block.reshape(8, 8)) + 128), 0, 255)
    assert np.abs(image.planes()[1] - slow).max() <= 1
    y, cb, cr = image.planes()
    blue = np.clip(np.rint(y + 1.772 * (np.kron(cb, np.ones((2, 2))) - 128)), 0, 255)
    assert (image.rgb()[:, :, 2] == blue).all() and image.rgb().shape == (16, 16, 3)


def test_frames(spark):
    docs = edge_documents(spark)
    rows = media.read_payloads(media.store_texts(docs)).collect()
    want = []
    for d in docs.collect():
        data = (d.text or "").encode()
        payload = data + bytes(-len(data) % 64) if data else bytes(64)
        want.append((d.doc_id or 0, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    got = [(r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows]
    assert sorted(got) == sorted(want)
    same = [r for r in rows if r.doc_id in (1, 5)]
    assert len(same) == 3 and len({(r.media_sha256, r.feature, r.media_bytes) for r in same}) == 1
    stored = {}
    for r in media.store_texts(docs).collect():
        image = jpeg.Decoder(bytes(r.media), arrays=False)  # bit by bit
        pixels = image.rgb().reshape(-1, 3).astype(float)
        stats = " ".join(f"{m:.1f}/{s:.1f}" for m, s in zip(pixels.mean(axis=0), pixels.std(axis=0)))
        shape = image.rgb().shape
        stored.setdefault(r.doc_id, []).append((len(r.media), hashlib.sha256(r.media).hexdigest(), f"{shape[1]}x{shape[0]} {stats}"))
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.media_bytes, r.media_sha256, r.feature))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in stored.items()}
    tensors = media.decode_column(media.store_texts(docs)).collect()
    assert all(len(t.rgb) == t.height * t.width * 3 for t in tensors) and len(tensors) == 11
    assert media.read_payloads(media.store_texts(empty_documents(spark))).collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert media.decode_column(none).collect()[0].rgb is None and media.read_payloads(none).collect() == []
