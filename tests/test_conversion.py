import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfield.operators import defects, histogram, mosaic, ranges, tone
from grainfield.params import Parameters
from grainfield.plans.conversion import Settings, analyzed, coloured, rendered, repaired, switched
from grainfield.sources import raw, sinks
from tests.test_core import dust_scene, frame, meta


def test_settings_rules(spark):
    for bad in ({"hue": 10.0}, {"color": True, "white_balance": (2.0, 1.0, 1.5), "natural_color": True}, {"function": "x", "tone_bands": ((0, 0.5, 0.1),)}, {"policy": "cut"}, {"function": "x +"}, {"formats": ()}, {"green": "g3"}, {"noise_reduction_level": 3.0}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert Settings(both=True).modes() == ("auto", "best") and Settings(optimize=False).modes() == ("auto",)


def test_conversion_of_a_ramp(spark):
    img = np.tile(np.linspace(1100, 16000, 64).astype(int), (48, 1)) + np.random.default_rng(3).integers(-20, 21, (48, 64))
    s, m = frame(spark, img), meta(spark, 64, 48, 1023, 16383)
    report = analyzed(s, m).first()
    assert 1023 <= report.lower < 1400 and 15500 < report.upper <= 16383 and report.dynamic_range.method
    got = rendered(s, m, Settings(both=True, function="x^2", policy="clip"))
    by = {r.mode: r for r in got.groupBy("mode").agg(F.count("*").alias("n"), F.min("out").alias("lo"), F.max("out").alias("hi")).collect()}
    assert set(by) == {"auto", "best"} and all(r.n == 48 * 64 and r.lo >= 0 and r.hi <= 65535 for r in by.values())
    pairs = got.where("mode = 'auto'").select("code", "out").distinct().orderBy("code").collect()
    assert all(a.out <= b.out for a, b in zip(pairs, pairs[1:], strict=False))


def test_policy_holds_after_denoising(spark):
    img = np.tile(np.linspace(1100, 16000, 48).astype(int), (48, 1)) + np.random.default_rng(3).integers(-20, 21, (48, 48))
    s, m = frame(spark, img), meta(spark, 48, 48, 1023, 16383)
    outs = {}
    for policy in ("clip", "scale", "wrap"):
        got = rendered(s, m, Settings(optimize=False, function="2*x - .5", policy=policy, noise_reduction=True))
        outs[policy] = got.agg(F.min("out").alias("lo"), F.max("out").alias("hi"), F.count_if(F.col("out") == 0).alias("zeros")).first()
    assert outs["scale"].lo == 0 and outs["scale"].hi == 65535 and outs["scale"].zeros < 200
    assert outs["clip"].zeros > 400 and outs["wrap"].zeros < 200


def test_the_tail_margin_is_the_noise_at_the_tail(spark):
    img = np.tile(np.linspace(2000, 9000, 64).astype(int), (64, 1))
    img[10:30, 10:30] = 400
    s = frame(spark, img)
    bounds = spark.createDataFrame([("f", "mono", 1000.0, 25.0)], "frame string, plane string, bound double, s double")
    cdf = histogram.cumulative(histogram.histogram(s))
    p = Parameters()
    got = ranges.protected_tail(s, bounds, cdf, False, lambda v: F.col("s") * v / 400).first()
    assert got.bound == max(400 - p.coherent_noise_margin * 25, 400)  # no further than the least code
    lifted = s.unionByName(frame(spark, [[10]]).withColumns({"y": F.lit(64), "x": F.lit(0)}))
    got = ranges.protected_tail(lifted, bounds, histogram.cumulative(histogram.histogram(lifted)), False, lambda v: F.col("s") * v / 400).first()
    assert got.bound == 400 - p.coherent_noise_margin * 25


def bayer(h=40, w=48, seed=5):
    rng = np.random.default_rng(seed)
    y, x = np.indices((h, w))
    scale = np.where((y % 2 == 0) & (x % 2 == 0), 0.5, np.where((y % 2 == 1) & (x % 2 == 1), 0.7, 1.0))
    return (200 + scale * (1000 + 200 * (x // 2)) + rng.integers(0, 9, (h, w))).astype(int)


def colour_meta(spark, h=40, w=48):
    kind = "frame string, width int, height int, cfa string, blacks array<double>, whites array<int>, profile array<double>"
    return spark.createDataFrame([("f", w, h, "RGGB", [200.0], [16383], None)], kind)


def test_colour_images(spark):
    s, m = frame(spark, bayer()), colour_meta(spark)
    plain = coloured(s, m, Settings(color=True, optimize=False)).toPandas().sort_values(["y", "x"])
    assert len(plain) == 20 * 24 and plain[["r", "g", "b"]].to_numpy().max() <= 65535
    # The planes are each stretched to their own range, so a gray ramp stays about gray.
    assert np.abs(plain["r"] - plain["g"]).median() < 4000
    ratios = coloured(s, m, Settings(color=True, optimize=False, color_ratios=True)).toPandas().sort_values(["y", "x"])
    assert ratios["r"].mean() / ratios["g"].mean() == pytest.approx(0.5 * plain["r"].mean() / plain["g"].mean(), rel=0.05)
    # The chain has one order: mixing comes before reordering.
    mixed = coloured(s, m, Settings(color=True, optimize=False, channel_mix=[[0, 1, 0], [0, 1, 0], [1, 0, 0]], channel_order="bgr")).toPandas().sort_values(["y", "x"])
    differ = ~((plain["r"] == plain["g"]) & (plain["g"] == plain["b"])).to_numpy()
    assert (mixed["r"].to_numpy()[differ] == plain["r"].to_numpy()[differ]).all() and (mixed["b"].to_numpy()[differ] == plain["g"].to_numpy()[differ]).all()
    gray = coloured(s, m, Settings(color=True, optimize=False, black_and_white=True)).toPandas()
    assert (gray["r"] == gray["g"]).all() and (gray["g"] == gray["b"]).all()
    one_green = coloured(s, m, Settings(color=True, optimize=False, green="g2", natural_color=True, both=True))
    assert one_green.groupBy("mode").count().count() == 2
    with pytest.raises(ValueError):
        coloured(s, m, Settings())


def test_levels_by_plane(spark):
    kind = "frame string, width int, height int, cfa string, blacks array<double>, whites array<int>, profile array<double>"
    rows = [("a", 10, 8, "GBRG", [1.0, 2.0, 3.0, 4.0], [100, 200, 300, 400], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), ("b", 6, 6, "RGGB", [7.0], [90], [0.5, 0.25])]
    got = {(r.frame, r.plane): (r.black, r.white, list(r.profile), r.width, r.height) for r in mosaic.plane_levels(spark.createDataFrame(rows, kind)).collect()}
    assert got["a", "G1"] == (1, 100, [3, 4], 5, 4) and got["a", "B"] == (2, 200, [5, 6], 5, 4) and got["a", "R"] == (3, 300, [1, 2], 5, 4) and got["a", "G2"] == (4, 400, [3, 4], 5, 4)
    assert got["b", "B"] == (7, 90, [0.5, 0.25], 3, 3) and len(got) == 8


def test_patterns_at_odd_crops():
    img = np.arange(48).reshape(6, 8) + 100
    for x0, y0, cfa, blacks in ((0, 0, "RGGB", [1, 2, 3, 4]), (1, 0, "GRBG", [2, 1, 4, 3]), (0, 1, "GBRG", [3, 4, 1, 2]), (1, 1, "BGGR", [4, 3, 2, 1])):
        tags = {"photometric": (3, (32803,)), "cfa": (1, (0, 1, 1, 2)), "black_dim": (3, (2, 2)), "black": (4, (1, 2, 3, 4)), "white": (4, (4000,)), "crop_origin": (4, (x0, y0)), "crop_size": (4, (4, 4))}
        got = raw.decode(raw.written(img, 16, False, tags))
        assert (got.meta["cfa"], got.meta["blacks"]) == (cfa, blacks) and (got.codes == img[y0 : y0 + 4, x0 : x0 + 4]).all()


def test_malformed_files_are_rows(spark, tmp_path):
    img = np.full((300, 4), 7)
    good = raw.written(img)
    (tmp_path / "good.dng").write_bytes(good)
    for name, tags in {"text": {"width": (2, ("x",))}, "strips": {"counts": (4, (1, 2))}, "bits": {"bits": (3, ())}, "cfa": {"cfa": (1, (0, 0, 1, 2))}}.items():
        (tmp_path / f"{name}.dng").write_bytes(raw.written(img, 16, False, tags))
    (tmp_path / ".hidden.dng").write_bytes(good)
    (tmp_path / "odd[1].dng").write_bytes(good)
    read = raw.frames(spark, [str(tmp_path)], band=128).cache()
    failed = {r.frame.rsplit("/", 1)[-1] for r in read.where("error is not null").collect()}
    assert failed == {"text.dng", "strips.dng", "bits.dng", "cfa.dng"}
    assert read.where("frame like '%good.dng'").count() == 3 and raw.samples(read).count() == 2 * 1200 and raw.metadata(read).count() == 2
    assert raw.samples(read).where("frame like '%good.dng'").agg(F.max("y")).first()[0] == 299
    row = raw.outcome(read).first()
    assert (row.files, row.failed, row.status) == (6, 4, 1)
    # A path that exists is itself; a pattern that meets nothing is an error, whatever else is named.
    assert raw.discovered(spark, [str(tmp_path / "odd[1].dng")]).count() == 1
    assert raw.discovered(spark, [str(tmp_path / "g*.dng"), str(tmp_path / "good.dng")]).count() == 1
    for bad in (["nothing*.dng"], ["good.dng", "G*.dng"], ["*/good.dng"]):
        with pytest.raises(FileNotFoundError):
            raw.discovered(spark, [str(tmp_path / b) for b in bad])


def test_format_switches():
    assert switched([]) == ("png",) and switched(["all", "no-png", "none", "jxl", "jpg"]) == ("jpg", "jxl") and switched(["no-png", "png"]) == ("png",)
    with pytest.raises(ValueError):
        switched(["bmp"])


def test_report_fields(spark):
    img = np.tile(np.linspace(1100, 16000, 256).astype(int), (256, 1)) + np.random.default_rng(3).integers(-20, 21, (256, 256))
    got = analyzed(frame(spark, img), meta(spark, 256, 256, 1023, 16383), Settings(dark=0.5, clip_strength=3)).first().asDict()
    assert got["requested_dark_percent"] == 0.5 and got["requested_light_percent"] is None and got["clip_strength"] == 3 and got["dark_coherent_samples"] == 0
    assert len(got) >= 24 and got["estimated_snr_span_stops"] > 5


def test_mapping_samples(spark):
    at = spark.createDataFrame([("f", "mono", 3.0, [])], "frame string, plane string, exposure double, curve array<double>")
    got = tone.mapping_samples(at).orderBy("i").collect()
    assert len(got) == 19 and got[9].value == pytest.approx(0.75) and got[9].text == "0.50->0.75000"


def test_repair_of_recurring_dust(spark):
    scenes = {f"f{k}": dust_scene(k) for k in range(4)}
    s = None
    for n, img in scenes.items():
        s = frame(spark, img, n) if s is None else s.unionByName(frame(spark, img, n))
    m = spark.createDataFrame([(n, 320, 240, 0, 65535, "g", k) for k, n in enumerate(scenes)], "frame string, width int, height int, black int, white int, geometry string, ordinal long")
    fixed = repaired(s, m).where("frame = 'f1'").toPandas()
    got = np.zeros((240, 320), int)
    got[fixed["y"], fixed["x"]] = fixed["code"]
    changed = got != scenes["f1"]
    assert got[150, 180] / scenes["f1"][150, 180] > 1.2 and 100 < changed.sum() < 0.1 * got.size
    assert repaired(s, m, Settings(dust_strength=0.0)) is s


def test_geometries(spark):
    rows = [("a", [0, 0, 100, 80]), ("b", [0, 0, 99, 80]), ("c", [0, 0, 100, 79]), ("d", [0, 0, 98, 80]), ("e", [1, 0, 100, 80])]
    df = spark.createDataFrame([(f, "M", "N", 100, 80, c) for f, c in rows], "frame string, make string, model string, raw_width int, raw_height int, crop array<int>")
    got = {r.frame: r.geometry for r in defects.geometries(df).collect()}
    assert got["a"] == got["b"] == got["c"] and len({got["a"], got["d"], got["e"]}) == 3


def test_coverage(spark):
    places = spark.createDataFrame([("f", 0, float(x), 10.0) for x in range(0, 400, 5)] + [("g", 0, 5.0, 10.0)], "frame string, region int, x double, y double")
    spots = spark.createDataFrame([("f", 100.0, 10.0, 4.0), ("f", 300.0, 60.0, 40.0)], "frame string, x double, y double, sigma double")
    want = sorted(("f", float(x)) for x in range(0, 400, 5) if not (abs(x - 100) <= 14 or np.hypot(x - 300, 50) <= 140)) + [("g", 5.0)]
    assert sorted((r.frame, r.x) for r in defects.uncovered(places, spots).collect()) == want
    got = {r.frame: (r.cells, r.covered) for r in defects.overlap(places, spots).collect()}
    assert got == {"f": (80, 80 - len(want) + 1), "g": (1, 0)}


def test_published_batches_and_json_lines(spark, tmp_path):
    files = spark.createDataFrame([("a.bin", b"x"), ("b/c.bin", b"yy")], "name string, content binary")
    assert sinks.published(files, str(tmp_path / "out")).agg(F.sum("bytes")).first()[0] == 3
    for bad in (files.unionAll(files), files.unionAll(spark.createDataFrame([("z", None)], "name string, content binary"))):
        with pytest.raises(ValueError):
            sinks.published(bad, str(tmp_path / "more"))
    sinks.json_lines(spark.range(50).select((-F.col("id")).alias("ordinal"), "id", F.lit(None).cast("int").alias("n")), str(tmp_path / "lines"))
    got = [line for f in sorted((tmp_path / "lines").glob("part-*")) for line in f.read_text().splitlines()]
    assert got == [f'{{"id":{k},"n":null}}' for k in range(49, -1, -1)]


def test_saved_calibration(spark, tmp_path):
    spots = spark.createDataFrame([("g", 0, 1.0, 2.0)], "geometry string, spot int, x double, y double")
    stacks = spark.range(400).select(F.col("id").alias("ordinal"), F.lit("g").alias("geometry"), F.lit(0.5).alias("value"))
    sinks.save_calibration(spots, stacks, str(tmp_path / "c"), True)
    back, near = sinks.load_calibration(spark, str(tmp_path / "c"), (100, 200))
    assert back.collect() == spots.collect() and near.count() == 101
    assert all("bucket=3" not in f and "bucket=2" not in f for f in near.select("_metadata.file_path").distinct().toPandas()["file_path"])
