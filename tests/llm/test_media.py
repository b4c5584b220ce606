import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from cairn.llm import media as M
from cairn.llm.queries import op10_media


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (64, 64), (3, 4, 3), (7, 5, 3)])
def test_formats(shape):
    x = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (M.decode(M.write_bmp(x)) == x).all()
    if x.ndim == 2:
        assert (M.decode(M.write_pgm(x)) == x).all()
        text = b"P2 # a comment\n%d %d\n255\n" % (shape[1], shape[0]) + b" ".join(b"%d" % v for v in x.ravel())
        assert (M.decode(text) == x).all()
        bits = (x > 127).astype(np.uint8)
        p4 = b"P4\n%d %d\n" % (shape[1], shape[0]) + np.packbits(bits, axis=1).tobytes()
        p1 = b"P1\n%d %d\n" % (shape[1], shape[0]) + b" ".join(b"%d" % v for v in bits.ravel())
        assert (M.decode(p4) == (1 - bits) * 255).all() and (M.decode(p1) == (1 - bits) * 255).all()
    else:
        assert (M.decode(b"P6\n%d %d\n255\n" % (shape[1], shape[0]) + x.tobytes()) == x).all()
    wide = (np.arange(6).reshape(2, 3) * 1000).astype(">u2")
    assert (M.decode(b"P5 3 2 65535\n" + wide.tobytes()) == wide).all()


def test_resize():
    x = np.random.default_rng(2).integers(0, 256, (12, 10)).astype(float)
    assert np.allclose(M.resize(x, 4, 5), x.reshape(4, 3, 5, 2).mean((1, 3)))
    big = M.resize(np.kron(x, np.ones((7, 9))), 12, 10)
    assert np.allclose(big, x)
    third = M.resize(x, 7, 3)  # by repeating every pixel until the edges meet
    assert np.allclose(third, np.kron(x, np.ones((7, 3))).reshape(7, 12, 3, 10).mean((1, 3)))
    assert np.isclose(M.resize(np.ones((1, 64)), 16, 16), 1).all()


def plain_means(x, height, width):
    """Each target pixel's mean by weights of the rows and columns that it covers, without an integral image."""
    def weights(n, m):
        lo, hi = np.arange(m)[:, None] * n / m, (np.arange(m)[:, None] + 1) * n / m
        return np.clip(np.minimum(hi, np.arange(n) + 1) - np.maximum(lo, np.arange(n)), 0, None) / (n / m)

    return weights(x.shape[0], height) @ x.astype(float) @ weights(x.shape[1], width).T


def plain_hash(x):
    small = np.round(plain_means(x, 8, 9), 6)
    bits = "".join(str(int(small[i, j + 1] > small[i, j])) for i in range(8) for j in range(8))
    return f"{int(bits, 2):016x}"


def test_query(spark, sf_dir):
    docs = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in op10_media(spark, sf_dir).collect():
        raw = docs[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        head = b"P5\n64 %d\n255\n" % (len(payload) // 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        x = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        assert r["feature"] == f"{plain_hash(x)}:{hashlib.sha256(M.npy(np.round(np.round(plain_means(x, 16, 16), 6)).astype(np.uint8))).hexdigest()}"
        assert (r["media_bytes"], r["media_sha256"]) == (len(head) + len(payload), hashlib.sha256(head + payload).hexdigest())


def test_edges(spark):
    image = M.write_pgm(np.arange(64, dtype=np.uint8).reshape(8, 8))
    df = spark.createDataFrame([(1, image, "a"), (2, None, "b"), (3, b"junk", "c"), (4, b"BM", "d"), (5, b"P5 9 9 255\n", "e")], "id int, media binary, height string")
    got = {r["id"]: r for r in M.featurize(df).collect()}
    assert got[1]["height"] == 8 and np.load(io.BytesIO(got[1]["tile"])).shape == (16, 16)
    assert all(got[i]["payload"] is None and got[i]["dhash"] is None for i in (2, 3, 4, 5))
    assert M.featurize(df.limit(0)).count() == 0
    stored = M.store_payload(spark.createDataFrame([(1, bytearray(64), "x"), (2, None, "y"), (3, bytearray(64), "z")], "id int, payload binary, media string")).collect()
    assert stored[1]["media"] is None and stored[0]["media"] == stored[2]["media"]
    deep = b"P5 2 2 65535\n" + np.array([[0, 65535], [65535, 300]], ">u2").tobytes()
    low = b"P2 2 1 100\n 100 50"
    wide = {r["id"]: np.load(io.BytesIO(r["tile"])) for r in M.featurize(spark.createDataFrame([(1, deep), (2, low)], "id int, media binary"), tile=2).collect()}
    assert wide[1].tolist() == [[0, 255], [255, 1]] and wide[2].tolist() == [[255, 128]] * 2


def test_broken_headers(spark):
    """Sizes of 0 or far too large, maxima out of range and samples over them are unreadable, and no job fails."""
    bad = [b"P5 1 1 0 x", b"P5 99999999999999999999 1 255\nx", b"P2 1 1 255\n999999999999999999999999", b"P5 0 0 255\n", b"P5 0 3 255\n", b"P2 1 1 70000\n5", b"P2 1 1 9\n10", b"P2 1 1 9\n-1", b"P4 0 0\n", b"P1 99999 99999999\n1", b"P5 3 3\nabcdefghi"]
    bad.append(struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54, 0, 0, 54, 40, 0, 0, 1, 24, 0, 0, 0, 0, 0, 0))
    bad.append(struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54, 0, 0, 54, 40, 2**31 - 1, 2**31 - 1, 1, 24, 0, 0, 0, 0, 0, 0))
    good = [b"P2 1 1 65535\n65535", b"P5 1 1 1\n\x01"]
    rows = list(enumerate([*bad, *good]))
    got = {r["id"]: r for r in M.featurize(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert all(got[i]["payload"] is None and got[i]["tile"] is None and got[i]["height"] is None for i in range(len(bad)))
    assert all(got[len(bad) + i]["height"] == 1 for i in range(2))
