"""Conversion of frames: settings, their rules, and the lazy plan from samples to rendered values and reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expression as ex
from ..operators import defects, denoise, histogram, mosaic, noise, ranges, tone
from ..operators.histogram import KEYS
from ..params import Parameters
from ..sources.shared import cut

#: Formats in order, each with the name of its switch.
FORMATS = ("png", "jpg", "heic", "avif", "j2k", "jxl")
#: Formats that can be written here.
WRITTEN = ("png",)


def switched(switches: list[str]) -> tuple[str, ...]:
    """The formats that switches leave on, in the order of `FORMATS`: `png` is on from the start, the last switch of a
    format wins (`jpg`, `no-jpg`), and `all` and `none` stand for a switch of each."""
    on = {f: f == "png" for f in FORMATS}
    for s in switches:
        name, value = (s[3:], False) if s.startswith("no-") else (s, True)
        if name in ("all", "none"):
            on = dict.fromkeys(FORMATS, name == "all")
        elif name in on:
            on[name] = value
        else:
            raise ValueError(f"no format {s!r}")
    return tuple(f for f in FORMATS if on[f])


@dataclass(frozen=True)
class Settings:
    """What a conversion does. Rules between options are checked here, before any input is read."""

    color: bool = False
    channels: bool = False
    green: str = "ga"
    channel_order: str | None = None
    channel_mix: list[list[float]] | None = None
    hue: float = 0.0
    color_ratios: bool = False
    white_balance: tuple[float, float, float] | None = None
    black_and_white: bool = False
    natural_color: bool = False
    natural_color_level: float = 1.0
    max_color: bool = False
    max_color_level: float = 1.0
    dust_strength: float = 1.0
    noise_reduction: bool = False
    noise_reduction_level: float = 1.0
    dark: float | None = None
    light: float | None = None
    clip_strength: int = 1
    function: str | None = None
    tone_bands: tuple[tuple[float, float, float], ...] = ()
    policy: str = "clip"
    optimize: bool = True
    both: bool = False
    srgb: bool = False
    formats: tuple[str, ...] = ("png",)
    analyze: bool = False
    parameters: Parameters = field(default_factory=Parameters)

    def __post_init__(self) -> None:
        colour = (self.channels, self.channel_order, self.channel_mix, self.hue, self.color_ratios, self.white_balance, self.natural_color, self.max_color, self.black_and_white)
        checks = (
            (self.color or not any(colour), "colour options need colour"),
            (self.green in ("g1", "g2", "ga"), "green is g1, g2 or ga"),
            (sum(map(bool, (self.color_ratios, self.white_balance, self.natural_color))) <= 1, "colour ratios, white balance and natural colour exclude each other"),
            (not (self.analyze and (self.channel_mix or self.hue or self.natural_color or self.max_color)), "analysis renders nothing"),
            (not (self.function and self.tone_bands), "a function and tone bands exclude each other"),
            (self.policy in ("clip", "scale", "wrap"), "the policy is clip, scale or wrap"),
            (0 <= self.natural_color_level <= 2 and 0 <= self.max_color_level <= 2, "colour levels are within 0..2"),
            (0 <= self.dust_strength <= 2 and 0 <= self.noise_reduction_level <= 2, "strengths are within 0..2"),
            (bool(self.formats) or self.analyze, "at least one format is needed"),
            (set(self.formats) <= set(FORMATS), f"formats are {', '.join(FORMATS)}"),
            (not (self.channel_mix and self.black_and_white), "a channel mix and the black-and-white preset exclude each other"),
        )
        for fine, what in checks:
            if not fine:
                raise ValueError(what)
        ranges.RangeOptions(self.dark, self.light, self.clip_strength)
        if text := self.expression():
            ex.compiled(text, F.lit(0.5), self.parameters)

    def expression(self) -> str | None:
        return ex.tone_bands(list(self.tone_bands)) if self.tone_bands else self.function

    def modes(self) -> tuple[str, ...]:
        return ("auto", "best") if self.both else ("best",) if self.optimize else ("auto",)


def analyzed(samples: DataFrame, meta: DataFrame, settings: Settings = Settings(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The selected range with noise and dynamic range, one row per key.

    Knees need noise and tails need knees; each is a small table by key that the next step joins.
    """
    p, options = settings.parameters, ranges.RangeOptions(settings.dark, settings.light, settings.clip_strength)
    # Written once: small tables by key or code that several steps read; samples are scanned once for each.
    cdf = cut(histogram.cumulative(histogram.histogram(samples, keys), keys))
    est = cut(noise.estimates(samples, meta, p, keys).select(*keys, noise.as_struct().alias("noise"), F.col("light_sigma")))
    with_noise = cdf.join(est.select(*keys, F.col("noise.dark_sigma").alias("dark_sigma"), "light_sigma"), list(keys), "left")
    found = {}
    for name, high, manual in (("dark", False, options.dark), ("light", True, options.light)):
        sigma = with_noise.groupBy(*keys).agg(F.first(f"{name}_sigma").alias("sigma"))
        knee = ranges.tail_knee(cdf, high, None, p, keys).join(sigma, list(keys))
        # The noise of a tail may widen the least span that the knee search asks for.
        caps = cdf.groupBy(*keys).agg(histogram.tail_value(p.auto_cap, high).alias("cap"), (F.max("code") if high else F.min("code")).alias("end"))
        knee = knee.join(caps, list(keys))
        fine = F.col("accepted") & (F.abs(F.col("cap") - F.col("end")) >= F.greatest(F.lit(p.tail_noise_sigma) * F.coalesce("sigma", F.lit(0.0)), F.lit(p.tail_min_span)))
        knee = knee.select(*keys, F.when(fine, F.col("knee")).otherwise(F.col("end").cast("double")).alias("bound"), F.when(fine, F.col("knee_percent")).otherwise(0.0).alias("percent"))
        if manual is None:
            # The margin of a tail is the noise at its own value.
            at = knee.select(*keys, "bound").join(est.select(*keys, "noise"), list(keys), "left").join(meta.select(*keys, F.col("black").alias("level")), list(keys))
            noise_of = lambda value: noise.sigma_at(F.col("noise"), F.greatest(value - F.col("level"), F.lit(0.0)))
            kept = ranges.protected_tail(samples, at, cdf, high, noise_of, p, keys)
            knee = knee.withColumnRenamed("bound", "b0").join(kept, list(keys)).withColumn("bound", F.when(F.col("percent") > 0, F.col("bound")).otherwise(F.col("b0")))
            knee = knee.withColumn("coherent", F.when(F.col("percent") > 0, F.col("coherent")).otherwise(0))
        else:
            knee = knee.withColumn("coherent", F.lit(0))
        found[name] = knee.select(*keys, F.col("bound").alias(f"{name}_knee"), F.col("percent").alias(f"{name}_percent"), F.col("coherent").cast("long").alias(f"{name}_coherent_samples"))
    knees = cut(found["dark"].join(found["light"], list(keys)))
    levels = meta.select(*keys, "black", "white").join(est.select(*keys, "noise"), list(keys), "left")
    ends = ranges.automatic_ends(cdf, levels.select(*keys, "black", "white"), options, None, knees, p, keys)
    floored = ends.join(est.select(*keys, "noise"), list(keys), "left")
    if options.dark is None:
        floor = F.col("black") + F.coalesce(noise.signal_for_snr(F.col("noise"), p.dark_snr, p), F.lit(0.0))
        cap = cdf.groupBy(*keys).agg(histogram.tail_value(p.auto_cap, False).alias("cap"))
        raised = F.greatest("lower", F.least(floor, F.col("cap").cast("double")))
        floored = floored.join(cap, list(keys)).withColumn("lower", F.when(raised < F.col("upper"), raised).otherwise(F.col("lower"))).drop("cap")
    chosen = ranges.strengthened(cdf, floored.drop("noise"), options, p, keys)
    report = ranges.range_report(cdf, chosen, keys).join(est.select(*keys, "noise"), list(keys), "left")
    report = report.join(knees.select(*keys, "dark_coherent_samples", "light_coherent_samples"), list(keys))
    at = noise.dynamic_range(F.col("noise"), F.col("black"), F.col("lower"), F.least("upper", "white"), F.col("constant"), p)
    span, sigma = F.col("upper") - F.col("lower"), F.col("noise.dark_sigma")
    weak = F.array(F.lit("The selected range is small against the noise; stretching makes noise visible."))
    return report.withColumns({
        "clip_strength": F.lit(options.clip_strength), "requested_dark_percent": F.lit(options.dark).cast("double"), "requested_light_percent": F.lit(options.light).cast("double"),
        "estimated_snr_span_stops": F.when(sigma > 0, F.log2(F.greatest(span / sigma, F.lit(1.0)))), "dynamic_range": at,
        "warnings": F.when(span < p.noise_warning_sigmas * sigma, F.concat("warnings", weak)).otherwise(F.col("warnings")),
    })


def rendered(samples: DataFrame, meta: DataFrame, settings: Settings = Settings(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Samples with `mode` and `out` (16 bits). Both modes share one analysis; functions run once per code."""
    p = settings.parameters
    report = cut(analyzed(samples, meta, settings, keys))
    hist = cut(histogram.histogram(samples, keys))
    cdf = histogram.cumulative(hist, keys)
    text = settings.expression()
    function: Callable[[Column], Column] | None = (lambda x: ex.compiled(text, x, p)) if text else None
    own = [*keys, "black", "lower", "upper", "noise"]
    out = None
    for mode in settings.modes():
        mid = tone.midtones(cdf, report.select(*own), p, keys)
        if mode == "best":
            fitted = cut(tone.best_exposure(mid, F.col("noise"), p, keys))
            curves = tone.tone_curves(tone.smoothed(tone.dense(tone.density(hist, fitted, p, keys), p, keys), p, keys), fitted, F.col("noise"), p, keys)
        else:
            curves = mid.withColumns({"exposure": F.lit(1.0), "curve": F.array().cast("array<double>")})
        curves = cut(curves)
        table = cut(tone.lookup_table(hist, curves, function, settings.policy, settings.srgb, p, keys))
        if settings.noise_reduction:
            levels = report.select(*keys, "noise")
            values = denoise.denoised(samples, meta, levels, settings.noise_reduction_level, keys=keys)
            x = tone.mapped(ranges.normalized(F.col("value").cast("double"), F.col("lower"), F.col("upper")), F.col("exposure"), F.col("curve"), p)
            got = values.join(curves, list(keys)).select(*keys, "y", "x", "code", x.alias("v0"))
            got = got.withColumn("v", ex.finite(function(F.col("v0"))) if function else F.col("v0"))
            if settings.policy == "scale":
                ends = got.groupBy(*keys).agg(F.min("v").alias("v_low"), F.max("v").alias("v_high"))
                got = got.join(ends, list(keys)).withColumn("v", ex.scaled(F.col("v"), F.col("v_low"), F.col("v_high")))
            else:
                got = got.withColumn("v", (ex.clipped if settings.policy == "clip" else ex.wrapped)(F.col("v")))
            shown = ex.srgb_encode(F.col("v")) if settings.srgb else F.col("v")
            one = got.withColumn("out", F.round(shown * 65535).cast("int")).select(*keys, "y", "x", "code", "out")
        else:
            one = tone.apply_table(samples, table, keys).select(*keys, "y", "x", "code", "out")
        one = one.withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    assert out is not None
    return out


def coloured(samples: DataFrame, meta: DataFrame, settings: Settings) -> DataFrame:
    """`frame, mode, y, x, r, g, b` (16 bits) of mosaic frames, a row per cell. `meta` has `frame, width, height, cfa, blacks,
    whites` and `profile`.

    Each plane has its own analysis and rendering. Then, in this order: planes are combined and scaled (by raw ratios,
    by white balance, or by what makes neutral cells neutral), channels mixed, hue turned, colours strengthened,
    channels reordered. With `channels`, `rendered` of the planes is what is asked for beside this.
    """
    if not settings.color:
        raise ValueError("a colour image needs the colour option")
    keep = mosaic.green_planes(settings.green)
    levels = cut(mosaic.plane_levels(meta))
    wanted = mosaic.PLANES if settings.color_ratios or settings.natural_color else keep
    planes = mosaic.split(samples, meta.select("frame", "cfa"), wanted)
    seen = rendered(planes.where(F.col("plane").isin(*keep)), levels, settings)
    cells = seen.groupBy("frame", "mode", "y", "x").agg(*[F.max(F.when(F.col("plane") == p, F.col("out"))).alias(p) for p in mosaic.PLANES])
    first, second = ("G2", None) if settings.green == "g2" else ("G1", "G2" if settings.green == "ga" else None)
    bits = dict.fromkeys(mosaic.PLANES, 16)
    factors = None
    if settings.color_ratios:
        black = levels.groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct("plane", "black"))).alias("black_of"))
        ratios = mosaic.raw_ratios(planes.join(black, "frame"), F.col("black_of")[F.col("plane")])
        cells = cells.join(ratios.select("frame", *[f"factor_{c}" for c in "rgb"]), "frame")
        factors = tuple(F.col(f"factor_{c}") for c in "rgb")
    elif settings.white_balance:
        factors = tuple(F.lit(float(f)) for f in mosaic.balance_factors(settings.white_balance))
    r, g, b = mosaic.combined(F.col("R"), F.col(first), F.col(second) if second else None, F.col("B"), bits, factors)
    rgb = cells.select("frame", "mode", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"))
    if settings.natural_color:
        raw = mosaic.cells(planes).join(_by_plane(levels, "black"), "frame").join(_by_plane(levels, "white"), "frame")
        at = lambda v, k: (F.col(v) - F.col("black_of")[k]) / (F.col("white_of")[k] - F.col("black_of")[k])
        signal = {p: at(p, p) for p in mosaic.PLANES}
        gains = settings.white_balance or (1.0, 1.0, 1.0)
        mask = raw.select("frame", "y", "x", mosaic.neutral(signal["R"], signal["G1"], signal["G2"], signal["B"], F.lit(0.0), F.lit(1.0), gains).alias("neutral"))
        found = None
        for mode in settings.modes():
            one = rgb.where(F.col("mode") == mode).join(mask, ["frame", "y", "x"])
            scales = cut(mosaic.natural_color(one, settings.natural_color_level).select("frame", *[F.coalesce(f"factor_{c}", F.lit(1.0)).alias(f"factor_{c}") for c in "rgb"]))
            one = one.join(scales, "frame").select("frame", "mode", "y", "x", *[F.round(F.col(c) * F.col(f"factor_{c}")).cast("int").alias(c) for c in "rgb"])
            found = one if found is None else found.unionByName(one)
        rgb = found
    named = lambda cols: rgb.select("frame", "mode", "y", "x", *[c.alias(n) for c, n in zip(cols, "rgb", strict=True)])
    of = lambda: tuple(F.col(c) for c in "rgb")
    matrix = mosaic.LUMA if settings.black_and_white else settings.channel_mix
    if matrix or settings.hue:
        rgb = named(mosaic.mixed_channels(*of(), matrix, settings.hue))
    if settings.max_color:
        rgb = named(mosaic.max_color(*of(), settings.max_color_level, srgb=settings.srgb))
    if settings.channel_order:
        rgb = named(mosaic.reordered(of(), settings.channel_order))
    return rgb


def _by_plane(levels: DataFrame, what: str) -> DataFrame:
    return levels.groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct("plane", F.col(what).cast("double")))).alias(f"{what}_of"))


def repaired(samples: DataFrame, meta: DataFrame, settings: Settings = Settings(), spots: DataFrame | None = None) -> DataFrame:
    """Samples (one plane) with recurring dips filled at `dust_strength`: previews, views, candidates, votes over all frames of
    a geometry, a plan per frame, and its gain. `meta` has `frame, width, height, black, white, geometry, ordinal`. `spots` are
    those of a saved calibration in place of the frames' own votes. All candidates are found before any sample changes."""
    if settings.dust_strength == 0:
        return samples
    cells = cut(defects.preview(samples, meta))
    step = defects.preview_step(F.col("width"), F.col("height"))
    size = meta.select("frame", "geometry", "ordinal", F.floor(F.col("width") / step).cast("int").alias("pw"), F.floor(F.col("height") / step).cast("int").alias("ph"), step.alias("step"))
    views = defects.distinct_views(size.select("frame", "geometry", "ordinal").join(defects.signature(cells, size), "frame"))
    found = defects.candidates(cells).join(size, "frame").join(views.select("frame", "view"), "frame")
    found = cut(found)
    plan = defects.planned(found, spots if spots is not None else defects.confirmed_spots(found))
    gains = None
    for k in sorted(r[0] for r in size.select("step").distinct().collect()):
        one = defects.gain_rows(plan.where(F.col("step") == k), F.lit(k))
        gains = one if gains is None else gains.unionByName(one)
    if gains is None:
        return samples
    fixed = defects.applied(samples, gains, meta, settings.dust_strength)
    return fixed.withColumn("code", F.col("fixed")).select(*samples.columns)
