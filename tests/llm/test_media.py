import hashlib
import zlib

import numpy as np
import pytest

from ledgerloom.llm import media


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 40_000])
def test_round_trip(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    payload = media.padded(data)
    assert len(payload) % 576 == 0 and len(payload) > 0
    assert media.png_decode(media.png_encode(payload)).tobytes() == payload


def test_every_filter_type():
    image = np.random.default_rng(1).integers(0, 256, (10, 6), dtype=np.int64)
    lines = np.zeros((10, 7), np.uint8)
    for y in range(10):
        lines[y, 0] = kind = y % 5
        for x in range(6):
            a, b, c = (image[y, x - 1] if x else 0), (image[y - 1, x] if y else 0), (image[y - 1, x - 1] if x and y else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[y, x + 1] = (image[y, x] - [0, a, b, (a + b) // 2, near][kind]) % 256
    assert (media._unfilter(lines, 6) == image).all()


def test_damage_is_found():
    png = bytearray(media.png_encode(media.padded(b"abc")))
    for at in (0, 20, 45, len(png) - 2):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            media.png_decode(bytes(bad))
    with pytest.raises(ValueError):
        media.png_decode(bytes(png[:-5]))


def test_query_against_plain(spark, tmp_path):
    rows = [(1, "abc", "x"), (2, None, "y"), (3, "", "y"), (3, "", "y"), (4, "é\U0001f600" * 9000, None), (5, "abc", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op3_media(spark, str(tmp_path)).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    for i, text, _ in rows:
        raw = (text or "").encode()
        payload = media.padded(raw)
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.png_encode(payload)).hexdigest() and len(r.feature) == 16
    assert by[1].feature == by[5].feature


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert media.digest(media.encode(empty, "text"), "media.png").count() == 0
    df = spark.createDataFrame([(b"\x00" * 576, "keep")], "media binary, png string")
    out = media.decode(media.encode(df, "media", to="m"), "m.png").first()
    assert out.payload == b"\x00" * 576 and out.png == "keep"


def test_lenient_reading(spark):
    df = spark.createDataFrame([(b"broken",), (None,)], "m binary")
    assert [r.digest.feature for r in media.digest(df, "m", strict=False).collect()] == [None, None]
