import math
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import color as C
from pagemill.functions.names import parse, parse_name
from pagemill.operators import lz


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_lz_round_trip(text):
    assert lz.decompress(lz.compress(text)) == text


def test_lz_known_and_bad(spark):
    assert lz.compress("") == "Q" and lz.decompress("Q") == "" and lz.compress("a") == "IZA" and lz.compress("aaaa") == "IY5A"
    for word in "The Times 03/Jan/2009 Chancellor on brink of second bailout for banks".split() + ["😀𝄞x", "é" * 5000, "".join(map(chr, range(1000)))]:
        assert lz.decompress(lz.compress(word).replace("+", " ")) == word
    for bad in ("", "!", "I", "é", lz.compress("hello world")[:-4]):
        with pytest.raises(lz.CodecError):
            lz.decompress(bad)
    df = spark.createDataFrame([("abcabc",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(lz.lz_decompress(lz.lz_compress(F.col("t"))).alias("x")).collect()] == ["abcabc", "", None]
    assert df.select(lz.try_lz_decompress(F.lit("!")).alias("x")).first().x is None


def png(w, h, pixels, color=2, way=0):
    rows = b"".join(bytes([way]) + bytes(v for p in pixels[y * w : (y + 1) * w] for v in p) for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_colours(spark):
    assert C.dominant(png(4, 1, [(255, 0, 0)] * 3 + [(0, 0, 250)])) == [[255.0, 0.0, 0.0], [0.0, 0.0, 250.0]]
    assert C.dominant(png(2, 1, [(1, 2, 3, 0)] * 2, color=6), True) == [[1.0, 2.0, 3.0]] and C.dominant(b"P6 1 1 255\n\x0a\x14\x1e") == [[10.0, 20.0, 30.0]]
    assert C.dominant(png(4, 1, [(255, 0, 0)] * 3 + [(0, 0, 250)]), small_bucket=0.5) == [[255.0, 0.0, 0.0]]
    bmp = b"BM" + b"\0" * 8 + struct.pack("<IIii", 54, 40, 1, 1) + struct.pack("<HH", 1, 24) + b"\0" * 24 + b"\x03\x02\x01\0"
    assert C.dominant(bmp) == [[1.0, 2.0, 3.0]]
    for bad in (b"", b"junk", b"\x89PNG\r\n\x1a\n123", b"BM"):
        with pytest.raises(C.ImageLoadError):
            C.dominant(bad)
    df = spark.createDataFrame([(bytearray(b"junk"),), (None,)], "d binary")
    assert [r.p for r in df.select(C.palette(F.col("d"), lenient=True).alias("p")).collect()] == [None, None]
    rgb = [(255, 0, 0), (0, 0, 0), (255, 255, 255), (128, 128, 128), (18, 52, 86), (254.6, 300.0, -4.0)]
    rows = spark.createDataFrame([tuple(map(float, x)) for x in rgb], "r double, g double, b double").select("*", C.rgb_hex(F.col("r"), F.col("g"), F.col("b")).alias("x"), C.rgb_hsl(F.col("r"), F.col("g"), F.col("b")).alias("y")).collect()
    assert [r.x for r in rows] == ["#ff0000", "#000000", "#ffffff", "#808080", "#123456", "#ffff00"]
    assert rows[0].y == [0.0, 100.0, 50.0] and rows[1].y == [0.0, 0.0, 0.0] and rows[3].y[1] == 0.0 and math.isclose(rows[4].y[0], 210.0, abs_tol=1e-4)


def test_decoded_images(spark, tmp_path):
    from pagemill.sources.tables import read_decoded_images

    (tmp_path / "a.png").write_bytes(png(4, 1, [(255, 0, 0)] * 3 + [(0, 0, 250)]))
    r = read_decoded_images(spark, str(tmp_path)).select("width", C.decoded_palette(F.col("pixels"), F.col("channels")).alias("p")).first()
    assert r.width == 4 and r.p == [[255.0, 0.0, 0.0], [0.0, 0.0, 250.0]]


def test_names(spark):
    assert parse("Dr. Elizabeth Johannes von Hassskov Jr.") == {"honorific_prefix": "Dr.", "given_name": "Elizabeth", "middle_name": "Johannes", "middle_initials": "J", "surname": "von Hassskov", "generational_suffix": "Jr."}
    assert parse("Hassskov, Liz J.") == {"given_name": "Liz", "middle_initials": "J", "surname": "Hassskov"}
    assert parse("J. Doe") == {"surname": "Doe"} and parse("JOHN MCDOE, PhD") == {"given_name": "John", "surname": "McDoe", "honorific_suffix": "PhD"}
    assert parse("Wi1liam Osth0lm")["given_name"] == "Wi1liam"
    for bad in ("", "n/a", "12 34", "Anna 12", "Redukete ApS", "kundeservice", "Foo & Co.", "a@b.c d", ", ,", "X"):
        assert parse(bad) is None, bad
    df = spark.createDataFrame([("Anna Berg",), (None,), ("",)], "n string").select(parse_name(F.col("n")).alias("p"))
    assert [r.p and r.p.surname for r in df.collect()] == ["Berg", None, None]
