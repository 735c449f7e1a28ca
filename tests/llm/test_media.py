from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from plumbline.llm import media, webp


def picture(rng, h, w, colours=None):
    if colours:
        return rng.choice(rng.integers(0, 2**32, colours, dtype=np.uint32), (h, w))
    base = np.cumsum(np.cumsum(rng.integers(-2, 3, (h, w, 4)), 0), 1) + 128
    p = np.ascontiguousarray((base % 256).astype(np.uint8)).view("<u4")[..., 0].astype(np.uint32)
    p[h // 2 :] = p[: h - h // 2]  # something to refer back to
    return p


@pytest.mark.parametrize("h,w", [(1, 1), (1, 7), (9, 1), (13, 10), (24, 33)])
def test_round_trips(h, w):
    rng = np.random.default_rng(h * 100 + w)
    for p in (picture(rng, h, w), picture(rng, h, w, 2), picture(rng, h, w, 4), picture(rng, h, w, 13), picture(rng, h, w, 40)):
        blocks = (-(-h // 4), -(-w // 4))
        modes = rng.integers(0, 14, blocks)
        colour = rng.integers(0, 2**24, blocks)
        for transforms in ([], [(webp.SUBTRACT_GREEN,)], [(webp.PREDICTOR, modes, 2)], [(webp.CROSS_COLOUR, colour, 2)],
                           [(webp.PREDICTOR, modes, 2), (webp.CROSS_COLOUR, colour, 2), (webp.SUBTRACT_GREEN,)], [(webp.PALETTE,)] * (len(np.unique(p)) <= 256)):
            for cache, refs in ((0, False), (0, True), (5, False), (11, True)):
                assert (webp.decode(webp.encode(p, transforms, cache, refs)) == p).all()
        meta = rng.integers(0, 3, blocks)
        assert (webp.decode(webp.encode(p, [], 3, True, meta, 2)) == p).all()


def test_every_predictor():
    rng = np.random.default_rng(1)
    p = picture(rng, 12, 11)
    for mode in range(14):
        assert (webp.decode(webp.encode(p, [(webp.PREDICTOR, np.full((3, 3), mode), 2)])) == p).all()


def test_predictions():
    left, top, right, corner = [10, 20, 30, 40], [50, 0, 255, 7], [1, 2, 3, 4], [11, 100, 200, 9]
    at = lambda m: webp._predict(m, left, top, right, corner)
    assert at(0) == [0, 0, 0, 255] and at(5) == [27, 5, 135, 14] and at(7) == [30, 10, 142, 23] and at(10) == [17, 30, 122, 14]
    assert at(11) == left or at(11) == top
    assert at(12) == [49, 0, 85, 38] and at(13) == [39, 0, 113, 30]


def test_a_stream_made_by_hand():
    """One pixel with simple codes, laid out bit by bit after the format's description."""
    bits = [(0x2F, 8), (0, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)]
    for s in (77, 33, 200, 255):
        bits += [(1, 1), (0, 1), (1, 1), (s, 8)]
    bits += [(1, 1), (0, 1), (0, 1), (0, 1)]
    value = at = 0
    for x, n in bits:
        value |= x << at
        at += n
    body = value.to_bytes(-(-at // 8), "little")
    assert webp.decode(webp._file(body)).tolist() == [[255 << 24 | 33 << 16 | 77 << 8 | 200]]


@pytest.mark.parametrize("bad", [b"", b"RIFF", b"x" * 60, webp.encode(np.zeros((3, 3), np.uint32) + 5)[:22], webp.encode_samples(np.arange(256, dtype=np.uint8).reshape(4, 64))[:200]])
def test_broken_files(bad):
    with pytest.raises(webp.Broken):
        webp.decode(bad)


def test_samples_agree_with_the_general_encoder():
    rng = np.random.default_rng(2)
    for colours in (1, 2, 3, 50, 64, 65, 256):
        x = rng.integers(0, colours, (40, 64)).astype(np.uint8)
        p = webp.decode(webp.encode_samples(x))
        assert ((p >> 8 & 255) == x).all() and (p >> 24 == 255).all()
        general = webp.encode(np.uint32(0xFF000000) | x.astype(np.uint32) << 8)
        assert (webp.decode(general) == p).all()


def test_columns(spark, monkeypatch):
    monkeypatch.setattr(media, "IMAGE_BYTES", 1 << 13)
    rng = random.Random(8)
    texts = [None, "", "a", "x" * 64, "y" * 65, "é😀" * 500, "\0\0", "z" * 300_000] + ["".join(rng.choices("abc déß\n", k=rng.randrange(20_000))) for _ in range(20)]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(None, "a", None)], "doc_id long, text string, feature string")
    got = media.media_columns(df, keep_media=True).collect()
    for t, r in zip([*texts, "a"], got):
        raw = (t or "").encode()
        full = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert media.read_back(bytes(r.media), len(full))[0] == full and r.feature
    assert tuple(got[-1])[1:] == tuple(got[2])[1:]
    assert media.media_columns(df.limit(0)).collect() == []


def test_stored_files_have_prefix_codes_and_references(monkeypatch):
    """Payloads of texts: codes of several lengths, copies, a palette where few values occur; well below the payload's size."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    seen = {"general": 0, "copies": 0}
    real = webp._green

    def counted(bits, green, far, width, n):
        seen["general"] += green.only is None and len(set((green.packed & 15).tolist())) > 1
        seen["copies"] += green.only is None and int(green.packed.max()) >> 4 > 255
        return real(bits, green, far, width, n)

    monkeypatch.setattr(webp, "_green", counted)
    size = full = 0
    for t in texts:
        data, _ = media.payload(t)
        kept = media.stored(data)
        assert media.read_back(kept, len(data))[0] == data
        size, full = size + len(kept), full + len(data)
    assert seen["general"] > 0.9 * len(texts) and seen["copies"] > 0.5 * len(texts) and size < 0.55 * full


def test_green_streams_agree_with_the_pixel_by_pixel_reader(monkeypatch):
    rng = random.Random(9)
    words = ["alpha", "beta ", "gamma, ", "de", "\n", "0123456789" * 3]
    for k in range(60):
        raw = "".join(rng.choices(words, k=rng.randrange(1, 400))).encode() + bytes(rng.randrange(256) for _ in range(k % 7))
        x = np.frombuffer(raw.ljust(-(-len(raw) // 64) * 64, b"\0"), np.uint8).reshape(-1, 64)
        data = webp.encode_samples(x)
        fast = webp.decode(data)
        monkeypatch.setattr(webp, "STREAM", 1 << 30)
        assert (webp.decode(data) == fast).all() and ((fast >> 8 & 255) == x).all()
        monkeypatch.setattr(webp, "STREAM", 32)
        monkeypatch.setattr(webp, "BLOCK", 50)
        assert (webp.decode(data) == fast).all() and webp.encode_samples(x) == data
        monkeypatch.setattr(webp, "BLOCK", 1 << 16)


def test_a_stream_of_copies_near_and_over_itself():
    """References the writer doesn't make: near ones by the table of places, read by both readers."""
    p = np.uint32(0xFF000000) | (np.arange(40 * 30, dtype=np.uint32).reshape(30, 40) % 7 << 8)
    data = webp.encode(p, references=True)
    assert (webp.decode(data) == p).all()
    for cut in range(30, len(data), 7):
        try:
            webp.decode(data[:cut])
        except webp.Broken:
            pass
