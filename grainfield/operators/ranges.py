"""Range selection: percentile clipping, tail knees, coherent tails and clip strength.

Everything but the coherent tails works on cumulative histograms, one row per frame, plane and occupied code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import Parameters
from .histogram import KEYS, percent_where, tail_value


@dataclass(frozen=True)
class RangeOptions:
    dark: float | None = None
    light: float | None = None
    clip_strength: int = 1

    def __post_init__(self) -> None:
        if not 1 <= self.clip_strength <= 9:
            raise ValueError("clip strength must be within 1..9")
        for p in (self.dark, self.light):
            if p is not None and not 0 <= p < 100:
                raise ValueError("a percentage must be within 0..100")
        if (self.dark or 0) + (self.light or 0) >= 100:
            raise ValueError("percentages must add up to less than 100")


def manual_range(cdf: DataFrame, dark: float, light: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Both ends at tail values, and the percentages clipped there."""
    ends = cdf.groupBy(*keys).agg(tail_value(dark / 100, False).alias("lower"), tail_value(light / 100, True).alias("upper"))
    clipped = cdf.join(ends, list(keys)).groupBy(*keys, "lower", "upper")
    return clipped.agg(percent_where(F.col("code") < F.col("lower")).alias("clipped_dark"), percent_where(F.col("code") > F.col("upper")).alias("clipped_light"))


def normalized(value: Column, lower: Column, upper: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - lower) / (upper - lower)))


def tail_knee(cdf: DataFrame, high: bool, sigma: Column | None = None, p: Parameters = Parameters(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Where a tail bends: `knee`, `knee_percent`, `score` (the best, 0 if none is positive) and `accepted`.

    A histogram row holds the ranks cum - n .. cum - 1. It is paired with the steps whose rank may be among them
    and filtered by the exact rank, so that the search takes about one row per step and per code of the tail.
    """
    cap, steps = p.auto_cap, p.tail_steps
    outer, inner = F.col("high" if high else "low"), F.col("inner")
    inner_of = cdf.groupBy(*keys).agg(tail_value(cap, high).alias("inner"), F.first("low").alias("lo"), F.first("high").alias("hi"), F.first("total").alias("t"))
    before = (F.col("total") - F.col("cum")) if high else (F.col("cum") - F.col("n"))
    tail = cdf.withColumn("before", before).where(F.col("before") <= F.lit(cap) * F.col("total"))
    scale = F.lit(float(steps)) / (F.lit(cap) * F.col("total"))
    first = F.greatest(F.lit(1), (F.floor(F.col("before") * scale) - 1).cast("int"))
    last = F.least(F.lit(steps - 1), (F.ceil((F.col("before") + F.col("n")) * scale) + 1).cast("int"))
    count = F.floor(F.lit(cap) * F.col("i") / F.lit(float(steps)) * F.col("total"))
    steps_at = tail.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("i")).where((count >= F.col("before")) & (count < F.col("before") + F.col("n")))
    scored = steps_at.join(inner_of.select(*keys, "inner"), list(keys)).withColumn("span", F.abs(inner - outer).cast("double")).where("span > 0")
    score = F.abs(F.col("code") - outer) / F.col("span") - F.col("i") / F.lit(float(steps))
    best = scored.withColumn("score", score).where("score > 0").groupBy(*keys).agg(F.max(F.struct("score", (-F.col("i")).alias("j"), "code")).alias("b"))
    out = inner_of.join(best, list(keys), "left")
    end = F.col("hi" if high else "lo")
    least = F.greatest(F.lit(p.tail_noise_sigma) * F.coalesce(sigma if sigma is not None else F.lit(0.0), F.lit(0.0)), F.lit(p.tail_min_span))
    accepted = (F.abs(inner - end) >= least) & (F.coalesce("b.score", F.lit(0.0)) >= p.tail_knee_score)
    return out.select(
        *keys, F.coalesce("b.score", F.lit(0.0)).alias("score"), F.coalesce(accepted, F.lit(False)).alias("accepted"),
        F.when(accepted, F.col("b.code")).otherwise(end).cast("double").alias("knee"),
        F.when(accepted, F.lit(cap) * -F.col("b.j") / F.lit(float(steps)) * 100).otherwise(0.0).alias("knee_percent"),
    )


def supported_tail(samples: DataFrame, bounds: DataFrame, high: bool, p: Parameters = Parameters(), keys: tuple[str, ...] = KEYS, every: bool = False) -> DataFrame:
    """Tail centres with enough neighbours in the same tail: `y, x, value` with value the mean of the two middle
    neighbours. `bounds` has `bound` by key; only tail samples take part in the join of neighbours. Centres lie on the sampling
    grid of `coherent_samples`, or are `every` tail sample."""
    r = p.coherent_radius
    beyond = (lambda c: F.col(c) > F.col("bound")) if high else (lambda c: F.col(c) < F.col("bound"))
    size = samples.groupBy(*keys).agg(F.max("x").alias("xm"), F.max("y").alias("ym"), F.count("*").alias("area"))
    at = samples.join(bounds, list(keys)).where(beyond("code")).join(size, list(keys))
    step = F.lit(1) if every else F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("area") / F.lit(float(p.coherent_samples)))).cast("int"))
    inside = (F.col("x") >= r) & (F.col("x") <= F.col("xm") - r) & (F.col("y") >= r) & (F.col("y") <= F.col("ym") - r)
    centres = at.withColumn("step", step).where(inside & ((F.col("x") - r) % F.col("step") == 0) & ((F.col("y") - r) % F.col("step") == 0))
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy or dx])
    wanted = centres.select(*keys, "bound", F.col("y").alias("cy"), F.col("x").alias("cx"), F.explode(around).alias("d"))
    wanted = wanted.select(*keys, "bound", "cy", "cx", (F.col("cy") + F.col("d.dy")).alias("y"), (F.col("cx") + F.col("d.dx")).alias("x"))
    met = wanted.join(samples.select(*keys, "y", "x", "code"), [*keys, "y", "x"]).groupBy(*keys, "cy", "cx").agg(
        F.sum(beyond("code").cast("int")).alias("support"), F.sort_array(F.collect_list("code")).alias("v")
    )
    middle = ((2 * r + 1) ** 2 - 1) // 2
    return met.where((F.size("v") == 2 * middle) & (F.col("support") >= p.coherent_neighbors)).select(
        *keys, F.col("cy").alias("y"), F.col("cx").alias("x"), ((F.get("v", F.lit(middle - 1)) + F.get("v", F.lit(middle))) * 0.5).alias("value")
    )


def protected_tail(samples: DataFrame, bounds: DataFrame, cdf: DataFrame, high: bool, sigma: Callable[[Column], Column] | None = None, p: Parameters = Parameters(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """`bound` moved outwards to keep coherent tails, and the number of samples that support it. `sigma` gives the noise at a
    code, from columns of `bounds`; the tail's own value moves by a margin of it."""
    found = supported_tail(samples, bounds, high, p, keys)
    f = 1 - p.coherent_tail_fraction if high else p.coherent_tail_fraction
    ranked = found.groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias("v"))
    ends = cdf.groupBy(*keys).agg(F.min("code").alias("lo"), F.max("code").alias("hi"))
    value = F.col("tail_value")
    margin = F.lit(p.coherent_noise_margin) * F.coalesce(sigma(value) if sigma is not None else F.lit(0.0), F.lit(0.0))
    moved = F.greatest(F.least(value + margin, F.col("hi")), F.col("bound")) if high else F.least(F.greatest(value - margin, F.col("lo")), F.col("bound"))
    n = F.coalesce(F.size("v"), F.lit(0))
    out = bounds.join(ends, list(keys)).join(ranked, list(keys), "left").withColumn("n", F.when(F.col("v").isNull(), 0).otherwise(n))
    out = out.withColumn("tail_value", F.get("v", F.floor((F.size("v") - 1) * F.lit(f)).cast("int")))
    return out.select(*keys, F.when(F.col("n") >= p.coherent_min_support, moved).otherwise(F.col("bound")).cast("double").alias("bound"), F.col("n").cast("long").alias("coherent"))


def automatic_ends(cdf: DataFrame, meta: DataFrame, options: RangeOptions = RangeOptions(), floor: Column | None = None, knees: DataFrame | None = None, p: Parameters = Parameters(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """`lower`, `upper`, knee percentages and `warnings` before clip strength.

    `meta` has `black` and `white` by key. `floor` is the signal above black at the dark SNR. `knees` (dark, light
    and their percentages) takes the place of the knees found here, for instance after protection of tails.
    """
    if knees is None:
        dark = tail_knee(cdf, False, None, p, keys).select(*keys, F.col("knee").alias("dark_knee"), F.col("knee_percent").alias("dark_percent"))
        light = tail_knee(cdf, True, None, p, keys).select(*keys, F.col("knee").alias("light_knee"), F.col("knee_percent").alias("light_percent"))
        knees = dark.join(light, list(keys))
    caps = cdf.groupBy(*keys).agg(
        tail_value(p.auto_cap, False).alias("dark_cap"), tail_value(p.auto_cap, True).alias("light_cap"), F.min("code").alias("lo"), F.max("code").alias("hi"),
        *([tail_value(options.dark / 100, False).alias("dark_end")] if options.dark is not None else []),
        *([tail_value(options.light / 100, True).alias("light_end")] if options.light is not None else []),
    )
    at = caps.join(meta, list(keys)).join(knees, list(keys))
    black, white, lo, hi = (F.col(c).cast("double") for c in ("black", "white", "lo", "hi"))
    noise_floor = black + (F.coalesce(floor, F.lit(0.0)) if floor is not None else F.lit(0.0))
    auto_dark, auto_light = options.dark is None, options.light is None
    lower = F.greatest(black, F.least(F.greatest("dark_knee", noise_floor), F.col("dark_cap").cast("double"))) if auto_dark else F.col("dark_end").cast("double")
    upper = F.least(white, F.greatest("light_knee", F.col("light_cap").cast("double"))) if auto_light else F.col("light_end").cast("double")
    at = at.withColumns({"l0": lower, "u0": upper, "constant": lo == hi})
    collapsed = ~F.col("constant") & (F.col("l0") >= F.col("u0")) & F.lit(auto_dark or auto_light)
    at = at.withColumn("collapsed", collapsed)
    l1 = F.when(F.col("collapsed") & F.lit(auto_dark), F.greatest(black, lo)).otherwise(F.col("l0"))
    u1 = F.when(F.col("collapsed") & F.lit(auto_light), F.least(white, hi)).otherwise(F.col("u0"))
    at = at.withColumns({"l1": l1, "u1": u1})
    back = F.col("constant") | (F.col("collapsed") & (F.col("l1") >= F.col("u1")) & F.lit(auto_dark and auto_light))
    at = at.withColumns({"lower": F.when(back, black).otherwise(F.col("l1")), "upper": F.when(back, white).otherwise(F.col("u1"))})
    warned = F.array_compact(
        F.array(
            F.when(F.col("constant"), F.lit("Constant image: its black and white levels are the range.")),
            F.when(F.col("collapsed"), F.lit("Automatic ends met; they are back at the observed range.")),
        )
    )
    wrong = F.raise_error(F.lit("clipping leaves no usable range"))
    return at.select(
        *keys, "black", "white", "lo", "hi", "constant",
        F.when(F.col("lower") < F.col("upper"), F.col("lower")).otherwise(wrong.cast("double")).alias("lower"), "upper",
        (F.col("dark_percent") if auto_dark else F.lit(0.0)).alias("dark_percent"), (F.col("light_percent") if auto_light else F.lit(0.0)).alias("light_percent"),
        warned.alias("warnings"),
    )


def strengthened(cdf: DataFrame, ends: DataFrame, options: RangeOptions, p: Parameters = Parameters(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """`ends` with automatic ends moved inwards by clip strength; ties keep a least span."""
    if options.clip_strength <= 1:
        return ends
    blend = (options.clip_strength - 1) / 8
    both = cdf.join(ends.select(*keys, "lower", "upper", "dark_percent", "light_percent"), list(keys))
    now = both.groupBy(*keys, "lower", "upper", "dark_percent", "light_percent").agg(
        percent_where(F.col("code") < F.col("lower")).alias("dark_now"), percent_where(F.col("code") > F.col("upper")).alias("light_now")
    )

    def target(current: str, knee: str) -> Column:
        clamped = F.least(F.greatest(F.lit(p.strength_target_base) + F.lit(p.strength_knee_weight) * F.col(knee), F.lit(p.strength_target_min)), F.lit(p.strength_target_max))
        return F.col(current) + F.lit(blend) * (F.greatest(clamped, F.col(current)) - F.col(current))

    now = now.select(*keys, "dark_now", "light_now", target("dark_now", "dark_percent").alias("dark_to"), target("light_now", "light_percent").alias("light_to"))
    got = cdf.join(now, list(keys)).groupBy(*keys, "dark_now", "light_now", "dark_to", "light_to").agg(
        tail_value(F.col("dark_to") / 100, False).alias("dark_q"), tail_value(F.col("light_to") / 100, True).alias("light_q")
    )
    at = ends.join(got, list(keys))
    usable = ~F.col("constant") & (F.col("hi") > F.col("lower")) & (F.col("lo") < F.col("upper"))
    lower, upper = F.col("lower"), F.col("upper")
    l2 = F.when(F.col("dark_to") <= F.col("dark_now"), lower).otherwise(F.greatest(lower, F.col("dark_q").cast("double"))) if options.dark is None else lower
    u2 = F.when(F.col("light_to") <= F.col("light_now"), upper).otherwise(F.least(upper, F.col("light_q").cast("double"))) if options.light is None else upper
    at = at.withColumns({"l2": l2, "u2": u2, "least": F.least(upper - lower, F.lit(p.tied_span)), "usable": usable})
    tied = F.col("usable") & (F.col("l2") >= F.col("u2"))
    half = F.col("least") * 0.5
    centre = F.least(F.greatest((F.col("l2") + F.col("u2")) * 0.5, lower + half), upper - half)
    if options.dark is None and options.light is None:
        l3, u3 = centre - half, centre + half
    elif options.dark is None:
        l3, u3 = upper - F.col("least"), F.col("u2")
    else:
        l3, u3 = F.col("l2"), lower + F.col("least")
    note = F.array(F.lit("Clip strength met tied codes; a least span is kept."))
    at = at.withColumns({"tied": tied, "l3": F.when(tied, l3).otherwise(F.col("l2")), "u3": F.when(tied, u3).otherwise(F.col("u2"))})
    return at.select(
        *keys, "black", "white", "lo", "hi", "constant", F.when(F.col("usable"), F.col("l3")).otherwise(lower).alias("lower"), F.when(F.col("usable"), F.col("u3")).otherwise(upper).alias("upper"),
        "dark_percent", "light_percent", F.when(F.col("tied"), F.concat("warnings", note)).otherwise(F.col("warnings")).alias("warnings"),
    )


def range_report(cdf: DataFrame, ends: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Everything about a selected range that a histogram tells, one row per key."""
    by = [*keys, *[c for c in ends.columns if c not in (*keys, "warnings", "lo", "hi")]]
    at = cdf.join(ends.drop("lo", "hi"), list(keys))
    code, lower, upper = F.col("code"), F.col("lower"), F.col("upper")
    p = F.col("n") / F.col("total")
    out = at.groupBy(*by).agg(
        F.first("warnings").alias("warnings"), F.min("code").alias("observed_min"), F.max("code").alias("observed_max"),
        percent_where(code < lower).alias("clipped_dark_percent"), percent_where(code > upper).alias("clipped_light_percent"),
        percent_where(code < F.col("black")).alias("below_black_percent"), percent_where(code > F.col("white")).alias("above_white_percent"),
        F.count("*").alias("occupied_codes"), F.count_if((code >= lower) & (code <= upper)).alias("retained_codes"), (-F.sum(p * F.log2(p))).alias("histogram_entropy_bits"),
    )
    return out.withColumns({"white_level_bits": F.log2(F.col("white") + 1.0), "retained_span_bits": F.log2(upper - lower + 1.0)})
