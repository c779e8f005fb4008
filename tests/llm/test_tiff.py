import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from loomspan.llm import tiff


@pytest.mark.parametrize("n", [0, 1, 63, 64, 700, 9000])
def test_round_trip(n):
    rng = random.Random(n)
    for data in (os.urandom(n), bytes(rng.choice(b"ab") for _ in range(n)), b"a" * n):
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
        assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
        x = np.frombuffer(tiff.payload_of(data), np.uint8).reshape(-1, 64)
        for how in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
            for predictor, tile, order in ((1, 0, "<"), (2, 0, ">"), (1, 16, ">"), (2, 64, "<")):
                made = tiff.write([x[i : i + 37] for i in range(0, len(x), 37)], how, predictor, 10, tile, order)
                pages = list(tiff.pages_of(made))
                assert b"".join(p["pixels"] for p in pages) == x.tobytes() and len(pages) == -(-len(x) // 37)


def test_known_packbits():
    # The example of the format's description.
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")
    assert tiff.packbits_decode(packed) == bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA")


def test_known_lzw():
    # The example of the format's description: codes of 9 bits.
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(packed) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == packed


def entry(data: bytes, tag: int, count: int | None = None, value: int | None = None) -> bytes:
    """The file with another count or value of a tag of its first directory."""
    import struct

    out = bytearray(data)
    (at,) = struct.unpack_from("<I", out, 4)
    (n,) = struct.unpack_from("<H", out, at)
    for i in range(n):
        place = at + 2 + 12 * i
        if struct.unpack_from("<H", out, place)[0] == tag:
            if count is not None:
                struct.pack_into("<I", out, place + 4, count)
            if value is not None:
                struct.pack_into("<I" if struct.unpack_from("<H", out, place + 2)[0] == 4 else "<H", out, place + 8, value)
    return bytes(out)


def test_malformed_files(spark):
    """Each gives rows with an error and ends no job."""
    page = np.arange(80, dtype=np.uint8).reshape(8, 10)
    strips, tiles = tiff.write([page], tiff.DEFLATE, rows=4), tiff.write([page], tiff.LZW, tile=16)
    wide = entry(entry(strips, 256, value=1 << 30), 257, value=1 << 30)
    bad = [entry(strips, 278, value=0), entry(tiles, 322, value=0), entry(tiles, 323, value=0), wide, entry(entry(tiles, 256, value=1 << 31), 257, value=1 << 31), entry(strips, 277, value=0)]
    bad += [entry(strips, 273, count=0), entry(strips, 279, count=1, value=3), entry(strips, 258, value=9), entry(strips, 273, count=1 << 31), entry(entry(strips, 256, value=0), 257, value=0)]
    bad += [strips[:k] for k in range(0, len(strips), 7)]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bad)] + [(1000, bytearray(entry(strips, 259, count=0)))], "id long, data binary")
    got = tiff.tiff_pages(rows).collect()
    assert {r.id for r in got} == set(range(len(bad))) | {1000}
    # Of a file cut within the last link, the page is whole.
    assert all(r.error and r.pixels is None for r in got if r.id < 1000 and len(bad[r.id]) < len(strips) - 4)
    assert {r.id for r in got if r.error} == set(range(len(bad)))
    # A bad link after a good page: the page, and an error with the next page's number.
    good = bytearray(tiff.write([page, page], tiff.NONE))
    import struct

    (at,) = struct.unpack_from("<I", good, 4)
    struct.pack_into("<I", good, at + 2 + 12 * struct.unpack_from("<H", good, at)[0], 1 << 30)
    assert [(p["page"], "error" in p) for p in tiff.pages_of(bytes(good))] == [(0, False), (1, True)]


def test_bombs_are_not_decoded():
    import zlib

    bomb = zlib.compress(bytes(1 << 26))
    assert len(tiff.expand(bomb, tiff.DEFLATE, 100)) == 100 and len(tiff.expand(bytes([129, 0] * 100000), tiff.PACKBITS, 100)) < 400


def test_sixteen_bits_with_predictor():
    import struct

    x = np.array([[1, 300, 299], [65535, 0, 7]], np.uint16)
    raw = np.diff(x, axis=1, prepend=np.uint16(0)).astype("<u2").tobytes()
    tags = {0: ("<",), 256: (3,), 257: (2,), 258: (16,), 259: (1,), 273: (0,), 278: (2,), 279: (len(raw),), 317: (2,)}
    assert (tiff.page_samples(raw, tags)[:, :, 0] == x).all() and struct.calcsize("<H") == 2


def test_pages_and_errors(spark):
    good = tiff.write([np.zeros((3, 4), np.uint8), np.full((2, 5), 9, np.uint8)], tiff.LZW)
    loop = bytearray(good)
    rows = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"GIF89a..")), (4, bytearray(good[:40])), (5, loop), (1, bytearray(good))], "id long, data binary")
    got = tiff.tiff_pages(rows).collect()
    assert sorted((r.id, r.page, r.width, r.height) for r in got if r.error is None) == [(1, 0, 4, 3)] * 2 + [(1, 1, 5, 2)] * 2 + [(5, 0, 4, 3), (5, 1, 5, 2)]
    assert {r.id for r in got if r.error} == {3, 4}


def test_query(docs, corpus, empty, odd):
    got = {r.doc_id: r for r in tiff.text_media(docs).collect()}
    for i, text in corpus:
        raw = (text or "").encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(m := tiff.store(payload)), hashlib.sha256(m).hexdigest())
    assert tiff.text_media(empty).collect() == [] and tiff.text_media(odd).count() == 6
