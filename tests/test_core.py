"""Acceptance cases of the raster operators on small arrays."""

import math
import random
import struct
import zlib
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainfield.functions import expression as ex
from grainfield.operators import defects, denoise, histogram, mosaic, noise, ranges, shapes, tone
from grainfield.params import BOUNDS, Parameters
from grainfield.sources import raw, sinks


def frame(spark, codes, frame="f", width=None):
    codes = np.asarray(codes)
    img = codes if codes.ndim == 2 else codes.reshape(-1, width or len(codes))
    y, x = np.indices(img.shape)
    import pandas as pd

    got = spark.createDataFrame(pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "code": img.ravel().astype(int)}))
    return got.select(F.lit(frame).alias("frame"), F.lit("mono").alias("plane"), F.col("y").cast("int"), F.col("x").cast("int"), F.col("code").cast("int"))


def meta(spark, w, h, black, white):
    return spark.createDataFrame([("f", "mono", w, h, black, white)], "frame string, plane string, width int, height int, black int, white int")


def ends(spark, codes, black, white, options=ranges.RangeOptions(), p=Parameters()):
    s = frame(spark, codes)
    cdf = histogram.cumulative(histogram.histogram(s)).cache()
    at = ranges.automatic_ends(cdf, meta(spark, len(codes), 1, black, white), options, p=p)
    row = ranges.range_report(cdf, ranges.strengthened(cdf, at, options, p)).first()
    cdf.unpersist()
    return row


def test_manual_percentiles(spark):
    got = ends(spark, np.arange(10000), 100, 9000, ranges.RangeOptions(0.8, 1.2))
    assert (got.lower, got.upper) == (80, 9879)
    assert got.clipped_dark_percent == pytest.approx(0.8) and got.clipped_light_percent == pytest.approx(1.2)


def test_ties(spark):
    got = ends(spark, np.repeat(np.arange(100), 10), 0, 200, ranges.RangeOptions(1.5, 2.5))
    assert (got.lower, got.upper) == (1, 97)
    assert got.clipped_dark_percent == pytest.approx(1) and got.clipped_light_percent == pytest.approx(2)


def test_calibration_bounds(spark):
    got = ends(spark, np.arange(10000), 1000, 9000)
    assert (got.lower, got.upper) == (1000, 9000)
    assert got.below_black_percent == pytest.approx(10) and got.above_white_percent == pytest.approx(9.99)


def test_clip_strength_keeps_a_span(spark):
    codes = [100] * 98 + [0, 200]
    got = ends(spark, codes, 0, 1000, ranges.RangeOptions(clip_strength=9))
    assert (got.lower, got.upper) == (99.5, 100.5)
    assert any("span" in w for w in got.warnings)


def test_constant_image(spark):
    got = ends(spark, [5000] * 64, 0, 10000)
    assert (got.lower, got.upper) == (0, 10000) and got.warnings


def test_both_manual_ends_tied_is_an_error(spark):
    with pytest.raises(Exception, match="no usable range"):
        ends(spark, [100] * 98 + [0, 200], 0, 1000, ranges.RangeOptions(2.0, 2.0))


def test_strength_is_monotone(spark):
    codes = np.arange(0, 65536, 16)
    lows = [ends(spark, codes, 0, 65535, ranges.RangeOptions(clip_strength=s)).clipped_dark_percent for s in (1, 5, 9)]
    assert lows[0] == 0 and lows == sorted(lows) and lows[-1] == pytest.approx(1, abs=0.1)


@pytest.mark.parametrize("bad", [{"clip_strength": 0}, {"dark": 100.0}, {"dark": 60.0, "light": 40.0}, {"light": -1.0}])
def test_range_options(bad):
    with pytest.raises(ValueError):
        ranges.RangeOptions(**bad)


def test_tail_knee_finds_planted_outliers(spark):
    ramp = np.arange(1000, 11000)
    s = frame(spark, np.concatenate([ramp, [0] * 10, [65535] * 10]))
    cdf = histogram.cumulative(histogram.histogram(s))
    low, high = (ranges.tail_knee(cdf, h).first() for h in (False, True))
    assert low.accepted and high.accepted and low.knee >= 1000 and high.knee <= 11000
    plain = ranges.tail_knee(histogram.cumulative(histogram.histogram(frame(spark, ramp))), False).first()
    assert not plain.accepted and plain.knee == 1000


def test_coherent_tails(spark):
    img = np.tile(np.linspace(2000, 9000, 64).astype(int), (64, 1))
    img[10:30, 10:30], img[5, 50] = 400, 10
    s = frame(spark, img)
    bounds = spark.createDataFrame([("f", "mono", 1000.0)], "frame string, plane string, bound double")
    got = ranges.protected_tail(s, bounds, histogram.cumulative(histogram.histogram(s)), False).first()
    assert got.bound == 400 and got.coherent > 100


def test_empty_samples(spark):
    none = frame(spark, [1, 2]).where("code < 0")
    cdf = histogram.cumulative(histogram.histogram(none))
    assert cdf.count() == 0 and ranges.manual_range(cdf, 1, 1).count() == 0
    with_null = frame(spark, [1, 2]).withColumn("code", F.lit(None).cast("int"))
    assert histogram.histogram(with_null).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=12))
def test_conservative_median(spark, values):
    s = sorted(values)
    a, b = s[(len(s) - 1) // 2], s[len(s) // 2]
    m = a if abs(a) <= abs(b) else b
    mad = sorted(abs(v - m) for v in s)[(len(s) - 1) // 2] * 1.4826
    row = spark.createDataFrame([(values,)], "v array<int>").withColumn("m", histogram.nearer_zero_median(F.col("v"))).withColumn("d", histogram.conservative_mad(F.col("v"), F.col("m"))).first()
    assert row.m == m and row.d == pytest.approx(mad)


# Expressions.

PRECEDENCE = {
    "2^-3 + +x": lambda x: 2**-3 + x,
    "x^2^3": lambda x: x**8,
    "-2^2 + x": lambda x: -4 + x,
    "2^3^2*x": lambda x: 512 * x,
    "-x^2": lambda x: -(x**2),
    "7.5 % 2 * x": lambda x: 1.5 * x,
    "(1 - x) / 2 - -x": lambda x: (1 - x) / 2 + x,
    "min(1, 0/0) + x": lambda x: 1 + x,
    "max(0/0, 2) + x": lambda x: 2 + x,
    "round(.5) + round(-2.5) + x": lambda x: 1 - 3 + x,
    "signum(0) + signum(-0) + sign(0) + x": lambda x: x,
}


@pytest.mark.parametrize("text", PRECEDENCE)
def test_precedence(spark, text):
    xs = [i / 50 for i in range(51)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(ex.compiled(text, F.col("x"))).collect()
    assert [r[0] for r in got] == pytest.approx([PRECEDENCE[text](x) for x in xs], rel=2e-12, abs=1e-15)


@pytest.mark.parametrize("text", ["", "1 +", "x x", "(x", "x)", "foo(x)", "y", "sqrt()", "pow(x)", "clamp(x,1)", "1e999", "1e-", "x $ 2", "min()", "2 ** 3", ",", "+" * 16385 + "x", "(" * 129 + "x" + ")" * 129, "^".join("2" * 300), "1..2"])
def test_malformed(spark, text):
    with pytest.raises(ex.ExpressionError):
        ex.compiled(text, F.col("x"))


def test_parser_fuzz(spark):
    random.seed(987654321)
    for _ in range(400):
        text = "".join(random.choice("x0123456789.+-*/%^(),episnqrt ") for _ in range(random.randrange(40)))
        try:
            ex.compiled(text, F.col("x"))
        except ex.ExpressionError:
            pass


@pytest.mark.parametrize("text", ["sqrt(-1 - x)", "ln(0*x)", "1/(x-x)", "exp(1000 + x)", "(-1)^.5 + x", "clamp(x,2,1)"])
def test_non_finite_is_an_error(spark, text):
    with pytest.raises(Exception, match="non-finite"):
        spark.createDataFrame([(0.5,)], "x double").select(ex.finite(ex.compiled(text, F.col("x")))).collect()


def test_policies(spark):
    rows = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 1.5, 2.0)], "y double")
    got = rows.select(ex.clipped(F.col("y")), ex.scaled(F.col("y"), F.lit(-1.0), F.lit(2.0)), ex.wrapped(F.col("y"))).collect()
    assert [r[0] for r in got] == [0, 0, 0.5, 1, 1, 1]
    assert [r[1] for r in got] == pytest.approx([0, 1 / 3, 0.5, 2 / 3, 5 / 6, 1])
    assert [r[2] for r in got] == [0, 0, 0.5, 1, 0.5, 0]
    wide = spark.createDataFrame([(v,) for v in (-1e308, 0.0, 1e308)], "y double").select(ex.scaled(F.col("y"), F.lit(-1e308), F.lit(1e308))).collect()
    assert [r[0] for r in wide] == [0, 0.5, 1]
    tiny = spark.range(1).select(ex.wrapped(F.lit(-1e-20))).first()
    assert tiny[0] == 1.0


def test_tone_bands():
    assert ex.tone_bands([(0.5, 0.9, 0.1), (0.0, 0.3, 0.4)]) == "srgb_band(srgb_band(x,0.0,0.3,0.4),0.5,0.9,0.1)"
    with pytest.raises(ex.ExpressionError):
        ex.tone_bands([(0.0, 0.5, 1.0), (0.4, 0.9, 1.0)])


# Parameters.


def test_parameters():
    assert len(BOUNDS) == 88 and Parameters().auto_cap == 0.02 and Parameters().jpeg_optimize_huffman is True
    for bad in ({"auto_cap": 0.5}, {"tail_steps": 1.5}, {"tone_cap_min": 4.0}, {"coherent_neighbors": 9}, {"noise_haar_lag_small": 3}):
        with pytest.raises(ValueError):
            replace(Parameters(), **bad)


# Noise.


def normals(n, seed=1234567):
    rng = np.random.default_rng(seed)
    return rng.normal(size=n)


def test_flat_noise(spark):
    img = np.clip(np.round(8000 + 20 * normals(256 * 256)), 0, 16383).astype(int).reshape(256, 256)
    got = noise.estimates(frame(spark, img), meta(spark, 256, 256, 0, 16383)).first()
    assert 16 < got.dark_sigma < 24 and 16 < got.light_sigma < 24


def test_noise_model_recovers_shot_and_read(spark):
    y, x = np.indices((512, 1024))
    s = 32 + 12000 * ((x // 16) / 63) ** 2
    img = np.clip(np.round(1023 + s + normals(s.size).reshape(s.shape) * np.sqrt(3 * s + 900)), 0, 16383).astype(int)
    codes = img.reshape(32, 16, 64, 16).transpose(0, 2, 1, 3).reshape(-1, 16, 16)
    m = noise
    import pandas as pd

    p = Parameters()
    rows = spark.createDataFrame(pd.DataFrame({"frame": "f", "plane": "mono", "py": np.repeat(np.arange(32), 64), "px": np.tile(np.arange(64), 32), "codes": [c.ravel().tolist() for c in codes]}))
    f = m.measured(rows, meta(spark, 1024, 512, 1023, 16383)).toPandas().sort_values(["py", "px"])
    got = m.estimate(*[f[c].to_numpy(float) for c in ("signal", "variance", "correlation", "texture", "growth")], None, False, p)
    assert got["resolved"] and got["model"][0] == pytest.approx(3, rel=0.15) and got["model"][1] == pytest.approx(900, rel=0.25)


def test_small_image_has_no_estimate(spark):
    got = noise.estimates(frame(spark, np.full((8, 8), 5)), meta(spark, 8, 8, 0, 100)).first()
    assert got.dark_sigma is None and not got.resolved and got.notes


def test_normal_quantile():
    for f, z in ((0.05, -1.644853626951473), (0.25, -0.6744897501960817), (0.5, 0), (0.9, 1.2815515655446004)):
        assert noise.normal_quantile(f) == pytest.approx(z, abs=3e-9)


# Tone.


@pytest.mark.parametrize("power", [0.2, 4])
def test_tone_curve_is_monotone(spark, power):
    codes = np.round((np.arange(4096) / 4095) ** power * 65535).astype(int)
    s = frame(spark, codes)
    hist = histogram.histogram(s)
    cdf = histogram.cumulative(hist)
    flat = ranges.automatic_ends(cdf, meta(spark, 4096, 1, 0, 65535))
    fitted = tone.best_exposure(tone.midtones(cdf, flat), noise.no_noise())
    got = tone.tone_curves(tone.smoothed(tone.dense(tone.density(hist, fitted))), fitted, noise.no_noise()).first()
    c = np.array(got.curve)
    slopes = np.diff(c) * 1024
    assert len(c) == 1025 and c[0] == 0 and c[-1] == 1 and 0.25 <= got.exposure <= 64
    assert slopes.min() >= 0.5125 - 1e-6 and slopes.max() <= 2.5 + 1e-6


def test_lookup_of_a_constant_image(spark):
    for code, expected in ((5000, 32768), (0, 0), (20000, 65535)):
        hist = histogram.histogram(frame(spark, [code] * 4))
        at = ranges.automatic_ends(histogram.cumulative(hist), meta(spark, 4, 1, 0, 10000)).withColumns({"exposure": F.lit(1.0), "curve": F.array().cast("array<double>")})
        assert tone.lookup_table(hist, at).first().out == expected


# Denoising.


def test_denoise_flattens_noise_and_keeps_edges(spark):
    clean = np.full((96, 96), 2000)
    clean[:, 48:] = 9000
    img = np.clip(np.round(clean + 30 * normals(clean.size).reshape(clean.shape)), 1, 16000).astype(int)
    variance = np.full(65536, 900.0, np.float32)
    whole = denoise.reduced(img, variance, 1.0, 16383, denoise.scales_for(96, 96))
    flat = np.s_[20:76, 8:36]
    assert ((whole - clean)[flat] ** 2).mean() < 0.3 * ((img - clean)[flat] ** 2).mean()
    assert whole[:, 52:].mean() - whole[:, :44].mean() > 0.99 * 7000
    bins = F.array(F.struct(F.lit(0.0).alias("signal"), F.lit(30.0).alias("sigma"), F.lit(48).alias("patches")))
    none = F.struct(F.lit(30.0).alias("dark_sigma"), F.lit(None).cast(noise.MODEL).alias("model"), F.lit(False).alias("resolved"), bins.alias("bins"))
    m = meta(spark, 96, 96, 0, 16383)
    tiled = denoise.denoised(frame(spark, img), m, m.select("frame", "plane", none.alias("noise")), 1.0, tile=40).toPandas()
    got = np.zeros((96, 96))
    got[tiled["y"], tiled["x"]] = tiled["value"]
    assert np.abs(got - whole).max() < 0.01


def test_denoise_guards(spark):
    s = frame(spark, np.full((4, 4), 7))
    with pytest.raises(ValueError):
        denoise.denoised(s, None, None, 3.0)
    assert denoise.denoised(s, None, None, 0.0).where("value != code").count() == 0


# Colour.


def test_mosaic(spark):
    img = np.array([[1, 2, 1, 2, 9], [3, 4, 3, 4, 9], [9, 9, 9, 9, 9]])
    got = mosaic.cells(mosaic.split(frame(spark, img))).orderBy("x").collect()
    assert [(r.R, r.G1, r.G2, r.B) for r in got] == [(1, 2, 3, 4)] * 2
    assert mosaic.split(frame(spark, img), keep=("R", "B")).select("plane").distinct().count() == 2


def test_colours_against_numpy(spark):
    rng = np.random.default_rng(5)
    px = rng.integers(0, 65536, (64, 3))
    px[:4] = px[:4, :1]
    rows = spark.createDataFrame([tuple(map(int, p)) for p in px], "r int, g int, b int")
    mix = mosaic.mixed_channels(F.col("r"), F.col("g"), F.col("b"), None, 120.0)
    got = np.array([tuple(r) for r in rows.select(*mix).collect()])
    assert (got == np.where((px == px[:, :1]).all(1)[:, None], px, px[:, [2, 0, 1]])).all()  # a third of a turn permutes channels
    strong = np.array([tuple(r) for r in rows.select(*mosaic.max_color(F.col("r"), F.col("g"), F.col("b"), 1.0)).collect()])
    assert strong.min() >= 0 and strong.max() <= 65535 and (strong[:4] == px[:4]).all()
    assert mosaic.max_color(F.col("r"), F.col("g"), F.col("b"), 0.0) is not None
    with pytest.raises(ValueError):
        mosaic.reordered((F.col("r"), F.col("g"), F.col("b")), "rrg")


def test_orientations(spark):
    img = np.arange(6).reshape(2, 3)
    for o in range(1, 9):
        s = mosaic.oriented(frame(spark, img), F.lit(3), F.lit(2), o).toPandas()
        want = raw.gathered(img, o)
        got = np.zeros_like(want)
        got[s["y"], s["x"]] = s["code"]
        assert (got == want).all(), o


# Files.


@pytest.mark.parametrize("bits,big", [(12, False), (14, True), (16, False), (16, True)])
def test_dng_round_trip(spark, tmp_path, bits, big):
    img = np.random.default_rng(1).integers(0, 1 << bits, (5, 7))
    tags = {"make": (2, ("Maker",)), "black": (4, (10,)), "white": (4, ((1 << bits) - 1,)), "noise": (12, (1e-4, 1e-6)), "orientation": (3, (6,))}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.DNG").write_bytes(raw.written(img, bits, big, tags))
    (tmp_path / "b.dng").write_bytes(b"not a raw file")
    read = raw.frames(spark, [str(tmp_path)]).cache()
    bad = read.where("error is not null").collect()
    assert len(bad) == 1 and bad[0].frame.endswith("b.dng")
    good = read.where("error is null").first()
    assert good.meta.make == "Maker" and good.meta.black == 10 and good.meta.profile == [1e-4, 1e-6]
    assert np.array_equal(np.array(good.rows), raw.gathered(img, 6))
    assert raw.samples(read).count() == 35
    assert [r.ordinal for r in raw.discovered(spark, [str(tmp_path)]).orderBy("path").collect()] == [0, 1]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200))
def test_decoder_fuzz(data):
    for blob in (data, b"II*\0\x08\0\0\0" + data):
        try:
            raw.decode(blob)
        except raw.RawError:
            pass


def test_png_and_files(spark, tmp_path):
    gray = np.random.default_rng(2).integers(0, 65536, (9, 4))
    assert np.array_equal(sinks.read_png(sinks.png(gray)), gray)
    colour = np.random.default_rng(2).integers(0, 65536, (3, 4, 3))
    assert np.array_equal(sinks.read_png(sinks.png(colour, srgb=True)), colour)
    made = sinks.rendered_png(frame(spark, gray), "code").select(F.lit("auto/x.png").alias("name"), F.col("png").alias("content"))
    assert sinks.write_files(made, str(tmp_path)).first().bytes > 50
    with pytest.raises(Exception, match="FileExists"):
        sinks.write_files(made, str(tmp_path)).collect()
    assert np.array_equal(sinks.read_png((tmp_path / "auto" / "x.png").read_bytes()), gray)


def test_exif(spark):
    about = {"make": "Maker", "model": "M", "lens": "35 mm", "iso": 640, "exposure": {"n": 1, "d": 250}, "f_number": {"n": 28, "d": 10}, "focal": 35.5}
    for channels in (1, 3):
        blob = sinks.exif(about, 40, 30, channels, srgb=channels == 3)
        outer, after = raw._directory(blob, struct.unpack_from("<I", blob, 4)[0], "<")
        inner, _ = raw._directory(blob, outer["exif"][0], "<")
        assert (outer["make"], outer["model"], outer["width"], outer["height"], outer["orientation"], after) == (("Maker",), ("M",), (40,), (30,), (1,), 0)
        assert outer["bits"] == (16,) * channels and outer["samples"] == (channels,) and outer["photometric"] == (1 if channels == 1 else 2,)
        assert (inner["iso"], inner["exposure"], inner["f_number"], inner["focal"], inner["lens"]) == ((640,), ((1, 250),), ((28, 10),), ((35500, 1000),), ("35 mm",))
    nothing = sinks.exif({"iso": 102400, "make": "", "exposure": {"n": 1, "d": 0}}, 1, 1)
    outer, _ = raw._directory(nothing, 8, "<")
    assert "make" not in outer and not {"iso", "exposure", "focal"} & set(raw._directory(nothing, outer["exif"][0], "<")[0])

    gray = np.arange(12).reshape(3, 4)
    images = sinks.rendered_png(frame(spark, gray, "a").unionAll(frame(spark, gray + 1, "b")), "code")
    about = spark.createDataFrame([("a", "Maker", 100)], "frame string, make string, iso int")
    got = {r["frame"]: bytes(r["png"]) for r in sinks.described(images, about).collect()}
    assert np.array_equal(sinks.read_png(got["a"]), gray) and np.array_equal(sinks.read_png(got["b"]), gray + 1)
    at = {k: v.index(b"eXIf") for k, v in got.items()}
    tags = {k: raw._directory(got[k][i + 4 :], 8, "<")[0] for k, i in at.items()}
    assert tags["a"]["make"] == ("Maker",) and "make" not in tags["b"] and tags["b"]["width"] == (4,)
    for k, i in at.items():
        size = struct.unpack_from(">I", got[k], i - 4)[0]
        assert zlib.crc32(got[k][i : i + 4 + size]) == struct.unpack_from(">I", got[k], i + 4 + size)[0] and i < got[k].index(b"IDAT")


def test_plane_levels_like_least_squares():
    rng = np.random.default_rng(5)
    values, mask = rng.normal(size=(14, 17)) + np.indices((14, 17))[1], rng.random((14, 17)) < 0.6
    mask[:, 12:] = False
    got = defects.plane_levels(values, mask, 2.0)
    y, x = np.nonzero(mask)
    for cy, cx in ((0, 0), (6, 7), (13, 4), (9, 11)):
        dy, dx = y - cy, x - cx
        w = np.exp(-(dy**2 + dx**2) / 8.0) * (np.abs(dy) <= 6) * (np.abs(dx) <= 6)
        design = np.stack([np.ones(len(y)), dy, dx], axis=1)
        want = np.linalg.lstsq(design * np.sqrt(w)[:, None], values[mask] * np.sqrt(w), rcond=None)[0][0]
        assert got[cy, cx] == pytest.approx(want)
    assert np.isnan(got[5, 16]) and np.isnan(defects.plane_levels(values, np.zeros_like(mask), 2.0)).all()
    line = np.zeros((14, 17), bool)
    line[7] = True  # a line of cells doesn't fix a plane
    assert np.isnan(defects.plane_levels(values, line, 2.0)).all()


def test_thickness():
    box = np.zeros((12, 12), bool)
    box[3:8, 2:9] = True
    assert [defects.thickness(box, n) for n in (1, 9)] == [1, 3]
    assert defects.thickness(np.ones((3, 9), bool), 9) == 2 and defects.thickness(np.zeros((3, 3), bool), 9) == 0


def test_broad_levels(spark):
    import pandas as pd

    rng = np.random.default_rng(6)
    h, w = 162, 203  # the last tiles are cut
    y, x = np.indices((h, w))
    ramp = np.exp(-1 - 0.002 * x + 0.001 * y)
    shade = 1 - 0.02 * (np.hypot(y - 80, x - 100) < 16)
    img = ramp * shade * (1 + rng.normal(0, 0.001, (h, w)))
    cells = spark.createDataFrame(pd.DataFrame({"frame": 1, "py": y.ravel(), "px": x.ravel(), "v": img.ravel()}))
    rough = (y < 20) & (x < 20)
    flags = spark.createDataFrame(pd.DataFrame({"frame": 1, "y": y.ravel(), "x": x.ravel(), "value": 0.0, "smooth": ~rough.ravel()}))
    got = defects.broad_levels(cells, flags).toPandas().set_index(["y", "x"])
    assert len(got) == 41 * 51
    assert got.loc[(20, 25), "value"] == pytest.approx(math.log(0.98), abs=0.004)
    assert abs(got.loc[(20, 45), "value"]) < 0.002 and abs(got.loc[(40, 50), "value"]) < 0.002
    assert not got.loc[(1, 1), "smooth"] and got.loc[(1, 1), "value"] == 0 and got.loc[(30, 30), "smooth"]
    assert got.loc[(3, 40), "level"] == pytest.approx(math.log(img[12:16, 160:164].mean()))
    assert defects.broad_levels(cells.limit(0), flags).count() == 0
    assert not defects.broad_levels(cells, flags.limit(0)).where("smooth").count()


def fiber(h=180, w=220, noise=0.0015):
    """A preview with a curved dark thread on a slope."""
    rng = np.random.default_rng(8)
    y, x = np.indices((h, w))
    path = np.abs(y - 90 - 6 * np.sin((x - 85) / 14)) < 2
    shadow = np.where(path & (x > 85) & (x < 125), 0.12, 0.0)
    soft = defects.gaussian(shadow, 0.8)
    return np.exp(-1 - 0.001 * x - soft + rng.normal(0, noise, (h, w))), soft


def test_irregular_shapes(spark):
    import pandas as pd

    img, soft = fiber()
    got = shapes.shapes_of(img)
    assert 1 <= len(got) <= 3
    best = max(got, key=lambda g: sum(g["gain"]))
    assert abs(best["x"] - 105) < 4 and abs(best["y"] - 90) < 6 and 0.1 < best["amplitude"] < 0.2
    # The gain undoes the shadow.
    gain = np.array(best["gain"]).reshape(best["side"], best["side"])
    at = [((y, x), defects.bilinear(gain, np.array([(x - best["left"]) / best["spacing"]]), np.array([(y - best["top"]) / best["spacing"]]))[0]) for y, x in zip(*np.nonzero(soft > 0.08), strict=True)]
    assert np.median([abs(g - soft[k]) for k, g in at]) < 0.02
    assert not shapes.shapes_of(np.exp(-1 + np.random.default_rng(9).normal(0, 0.0015, (180, 220))))
    y, x = np.indices(img.shape)
    cells = spark.createDataFrame(pd.DataFrame({"frame": 3, "py": y.ravel(), "px": x.ravel(), "v": img.ravel()}))
    rows = shapes.shapes(cells).collect()
    assert [(r.frame, r.side) for r in rows] == [(3, g["side"]) for g in got] and rows[0].gain == pytest.approx(got[0]["gain"])
    assert not shapes.shapes(cells.limit(0)).collect()


def test_regions_of_peaks():
    score = np.zeros((40, 60))
    score[10, 10:30] = 0.01
    score[10, 20] = 0.03
    score[30, 5:8] = 0.05
    peaks = np.array([(0.05, 30, 6), (0.03, 10, 20), (0.01, 10, 12)])
    assert shapes.proposals(score, peaks) == [(10, 10, 20, 1)]


def test_sharpened_spots(spark):
    side = 9
    y, x = np.indices((side, side))
    dot = (np.hypot(y - 4, x - 4) <= 2) * 0.1
    far = dot.copy()
    far[0, 0] = 0.1
    row = lambda sx, sy, s, depth, gain: ({"x": sx, "y": sy, "sigma": s, "depth": depth}, {"left": 10.0, "top": 20.0, "spacing": 1.0, "side": side, "gain": gain})
    rows = [row(14.0, 24.0, 3.0, 1.0, dot.ravel().tolist()), row(16.0, 24.0, 3.0, 1.0, dot.ravel().tolist()), row(14.0, 24.0, 3.0, 0.1, (5 * dot).ravel().tolist()),
            row(20.0, 30.0, 1.0, 9.0, far.ravel().tolist()), row(14.0, 24.0, 3.0, 1.0, [0.0] * 81), row(14.0, 24.0, 3.0, 1.0, [])]
    kinds = "spot struct<x:double,y:double,sigma:double,depth:double>, shape struct<left:double,top:double,spacing:double,side:int,gain:array<double>>"
    got = spark.createDataFrame(rows, kinds).select(shapes.sharpened().alias("s")).collect()
    assert [r.s for r in got] == [True, False, False, False, False, False]


# Many frames.


def dust_scene(k, h=240, w=320):
    y, x = np.indices((h, w)).astype(float)
    log = -1.2 + (0.1 + 0.05 * k) * x / w - (0.3 - 0.1 * k) * y / h + 0.2 * np.sin(k + x / 40) * np.cos(k + y / 50)
    log -= 0.25 * np.exp(-((x - 40 - 60 * k) ** 2 + (y - 60) ** 2) / 32)
    for px, py in ((180.5, 150.5), (260.5, 90.5)):
        log -= 0.3 * np.exp(-((x - px) ** 2 + (y - py) ** 2) / (2 * 3.0**2))
    return np.clip(np.round(np.exp(log) * 60000), 0, 65535).astype(int)


def test_recurring_dust(spark):
    scenes = {f"f{k}": dust_scene(k) for k in range(4)}
    s = None
    for n, img in scenes.items():
        one = frame(spark, img, n)
        s = one if s is None else s.unionByName(one)
    m = spark.createDataFrame([(n, 320, 240, 0, 65535) for n in scenes], "frame string, width int, height int, black int, white int")
    cells = defects.preview(s, m).cache()
    size = spark.createDataFrame([(n, 160, 120) for n in scenes], "frame string, pw int, ph int")
    order = spark.createDataFrame([(n, "g", k) for k, n in enumerate(scenes)], "frame string, geometry string, ordinal long")
    seen = defects.distinct_views(order.join(defects.signature(cells, size), "frame"))
    found = defects.candidates(cells).join(order, "frame").join(seen.select("frame", "view"), "frame").join(size, "frame").cache()
    spots = defects.confirmed_spots(found).cache()
    at = sorted((round(r.x), round(r.y)) for r in spots.collect())
    assert at == [(90, 75), (130, 45)]
    plan = defects.planned(found.where("frame = 'f0'"), spots)
    gains = defects.gain_rows(plan, F.lit(2)).cache()
    target = s.where("frame = 'f0'")
    fixed = defects.applied(target, gains, m).toPandas()
    got = np.zeros((240, 320), int)
    got[fixed["y"], fixed["x"]] = fixed["fixed"]
    changed = got != scenes["f0"]
    assert 100 < changed.sum() < 0.1 * got.size
    y, x = np.nonzero(changed)
    assert (np.minimum(np.hypot(x - 180, y - 150), np.hypot(x - 260, y - 90)) < 40).all()
    # Most of the dip is gone at its centre.
    assert got[150, 180] / scenes["f0"][150, 180] > 1.2
    same = defects.applied(target, gains, m, 0.0)
    assert same.where("fixed != code").count() == 0


def test_stacks(spark):
    v = spark.createDataFrame([(k, "g", k, [math.cos(k * 0.5), math.sin(k * 0.5)]) for k in range(12)], "frame long, geometry string, ordinal long, signature array<double>")
    pool = defects.neighbour_pool(v, v)
    row = pool.where("target = 5").orderBy("place").collect()
    assert [r.frame for r in row] == sorted((k for k in range(12) if k != 5), key=lambda k: (abs(k - 5), k))
    sets = defects.stack_sets(pool)
    side = 40
    grid = spark.range(side * side).select((F.col("id") / side).cast("int").alias("y"), (F.col("id") % side).cast("int").alias("x"))
    dark = F.when((F.col("y") == 19) & F.col("x").between(10, 13), -0.05).otherwise(0.001) + F.col("frame") * 1e-5
    res = v.select("frame").crossJoin(grid).withColumns({"value": dark, "smooth": F.lit(True)})
    stack = defects.stacked(sets.where("target = 5"), res)
    assert stack.where("set = 0").count() == side * side
    (found,) = defects.regions(stack.where("set = 0")).collect()
    assert (found.cells, found.left, found.top, found.width, found.height) == (4, 0, 7, 26, 25) and found.y == pytest.approx(19) and found.x == pytest.approx(11.5)
    assert sum(found.near) > 4 and sum(found.quiet) > 400 and found.noise < 1e-3 and found.depth == pytest.approx(-0.05, abs=1e-3)
    assert not defects.regions(stack.limit(0)).collect()


def stack_of(spark, median, views=8):
    import pandas as pd

    y, x = np.indices(median.shape)
    got = pd.DataFrame({"target": 1, "set": 0, "y": y.ravel(), "x": x.ravel(), "median": median.ravel(), "spread": 0.002, "n": views})
    return spark.createDataFrame(got).select("target", F.col("set").cast("int"), F.col("y").cast("int"), F.col("x").cast("int"), "median", "spread", F.col("n").cast("int"))


def test_regions_on_flat_ground_only(spark):
    y, x = np.indices((90, 90))
    disc = lambda cy, cx, r: np.hypot(y - cy, x - cx) <= r
    noise = np.random.default_rng(4).normal(0, 0.0005, (90, 90))
    at = lambda f, **k: sorted((round(r.x), round(r.y)) for r in defects.regions(stack_of(spark, f, **k.pop("stack", {})), **k).collect())
    spots = disc(30, 30, 3) | disc(0, 60, 3) | disc(60, 60, 9)
    assert at(noise - 0.03 * spots) == [(30, 30)]  # at the edge; too thick
    assert at(noise - 0.03 * spots, broad=True) == [(60, 60)]  # too small
    assert at(noise - 0.03 * (disc(45, 45, 3) | (abs(y - 70) < 2) & (x > 10) & (x < 70)), broad=True) == []  # a band
    assert at(noise - 0.03 * disc(30, 30, 3), stack={"views": 2}) == []
    ((cx, cy),) = at(10 * noise - 0.03 * disc(30, 30, 3))
    assert math.hypot(cx - 30, cy - 30) <= 1.5 and at(30 * noise - 0.03 * disc(30, 30, 3)) == []


def test_contrast_of_views(spark):
    import pandas as pd

    y, x = np.indices((60, 160))
    shade = np.zeros((60, 160))
    for k in range(6):
        shade -= 0.04 * (np.hypot(y - 30, x - 15 - 25 * k) <= 2.5)
    found = defects.regions(stack_of(spark, shade)).cache()
    assert found.count() == 6
    frames = {1: (1.0, 1.0), 2: (0.9, 1.0), 3: (2.0, 1.0), 4: (1.1, 0.0), 5: (1.2, 1.0)}
    res = spark.createDataFrame(pd.concat([pd.DataFrame({"frame": k, "y": y.ravel(), "x": x.ravel(), "value": depth * shade.ravel() + 0.01, "smooth": bool(smooth)}) for k, (depth, smooth) in frames.items()]))
    got = defects.contrasts(found, res).cache()
    assert {r.frame: round(r.contrast, 6) for r in got.collect()} == {k: depth for k, (depth, smooth) in frames.items() if smooth}
    assert [r.frame for r in defects.alike(got).orderBy("frame").collect()] == [2, 5]
    assert not defects.contrasts(found.where("region < 4"), res).count()


def test_residuals_of_a_slope(spark):
    import pandas as pd

    h, w = 100, 120
    y, x = np.indices((h, w))
    rng = np.random.default_rng(7)
    img = np.exp(-1 - 0.004 * x + rng.normal(0, 0.002, (h, w))) * (1 - 0.3 * (np.hypot(y - 40, x - 50) < 4))
    img[60:, 80:] *= np.exp(rng.normal(0, 0.2, (40, 40)))
    img[20, 100] = 1.0
    cells = spark.createDataFrame(pd.DataFrame({"frame": 1, "py": y.ravel(), "px": x.ravel(), "v": img.ravel()}))
    got = defects.residuals(cells).toPandas().set_index(["y", "x"])
    assert got.loc[(40, 50), "value"] == pytest.approx(math.log(0.7), abs=0.02)
    # Neither a halo around the dip nor a bias at the slope's edge.
    ring = [got.loc[(40 + j, 50 + i), "value"] for j in (-7, 0, 7) for i in (-7, 0, 7) if j or i]
    assert abs(np.mean(ring)) < 0.005 and abs(got.loc[(slice(10, 30), slice(0, 3)), "value"].mean()) < 0.01
    assert got.loc[(20, 20), "smooth"] and not got.loc[(80, 100), "smooth"] and not got.loc[(20, 100), "smooth"]
