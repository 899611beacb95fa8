"""The photographic tone curve: exposure search, density, bounded equalisation and lookup tables.

Curves are fitted from histograms: a row per frame and plane, with arrays of `tone_bins` values. Samples meet a
curve through a lookup table of the codes that occur, so that functions run once per code and not per sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expression import finite, srgb_decode, srgb_encode
from ..params import Parameters
from .histogram import KEYS, quantile
from .noise import sigma_at
from .ranges import normalized


def expose(x: Column, exposure: Column) -> Column:
    return exposure * x / (1.0 + (exposure - 1.0) * x)


def display_noise(x: Column, exposure: Column, lower: Column, upper: Column, black: Column, noise: Column) -> Column:
    """Noise of a normalized value on an sRGB display; null without a noise estimate."""
    span = upper - lower
    y = expose(x, exposure)
    slope = F.when(y <= 0.0031308, F.lit(12.92)).otherwise(F.lit(1.055 / 2.4) * F.pow(y, F.lit(1 / 2.4 - 1)))
    return sigma_at(noise, lower + span * x - black) / span * exposure / F.pow(1.0 + (exposure - 1.0) * x, F.lit(2.0)) * slope


def midtones(cdf: DataFrame, ranges: DataFrame, p: Parameters = Parameters(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """`ranges` with normalized `shadow`, `median` and `highlight`, and whether the frame is `constant`."""
    q = cdf.groupBy(*keys).agg(
        quantile(p.tone_shadow_quantile).alias("qs"), quantile(p.tone_midtone_quantile).alias("qm"), quantile(p.tone_highlight_quantile).alias("qh"), (F.min("code") == F.max("code")).alias("constant")
    )
    at = lambda c: normalized(F.col(c).cast("double"), F.col("lower"), F.col("upper"))
    return ranges.drop("constant").join(q, list(keys)).withColumns({"shadow": at("qs"), "median": at("qm"), "highlight": at("qh")}).drop("qs", "qm", "qh")


def exposure_scores(mid: DataFrame, noise: Column, p: Parameters = Parameters()) -> DataFrame:
    """A row per exposure candidate: `i`, `exposure`, `score`."""
    steps = -int(-(p.tone_max_exposure_ev - p.tone_min_exposure_ev) * p.tone_exposure_steps // 1)
    ev = F.least(F.lit(p.tone_min_exposure_ev) + F.col("i") / F.lit(float(p.tone_exposure_steps)), F.lit(p.tone_max_exposure_ev))
    at = mid.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("exposure", F.pow(F.lit(2.0), ev))
    e = F.col("exposure")
    encoded = lambda c: srgb_encode(expose(F.col(c), e))
    over = lambda c, least, tolerance: F.pow(F.greatest(c - least, F.lit(0.0)) / tolerance, F.lit(2.0))
    grain = F.coalesce(display_noise(F.col("median"), e, F.col("lower"), F.col("upper"), F.col("black"), noise), F.lit(0.0))
    score = (
        F.pow((encoded("median") - p.tone_target_midtone) / p.tone_midtone_tolerance, F.lit(2.0))
        + p.tone_contrast_weight * over(F.lit(p.tone_target_contrast) - (encoded("highlight") - encoded("shadow")), F.lit(0.0), p.tone_contrast_tolerance)
        + p.tone_noise_weight * over(grain, F.lit(p.tone_noise_threshold), p.tone_noise_tolerance)
    )
    return at.withColumn("score", score)


def best_exposure(mid: DataFrame, noise: Column, p: Parameters = Parameters(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """`mid` with `exposure`: the first of the lowest scores, with the bias; 1 for constant frames."""
    best = exposure_scores(mid, noise, p).groupBy(*keys).agg(F.min(F.struct("score", "i", "exposure")).alias("b"))
    bias = 2.0**p.tone_exposure_bias
    active = ~F.col("constant") & F.lit(p.optimize_strength > 0)
    return mid.join(best, list(keys)).withColumn("exposure", F.when(active, F.col("b.exposure") * bias).otherwise(1.0)).drop("b")


def density(hist: DataFrame, fitted: DataFrame, p: Parameters = Parameters(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Samples per bin of displayed brightness (codes strictly inside the range): `bin`, `n`; occupied bins only."""
    at = hist.join(fitted.select(*keys, "lower", "upper", "exposure"), list(keys)).where((F.col("code") > F.col("lower")) & (F.col("code") < F.col("upper")))
    z = srgb_encode(expose(normalized(F.col("code").cast("double"), F.col("lower"), F.col("upper")), F.col("exposure")))
    return at.groupBy(*keys, F.least(F.floor(z * p.tone_bins), F.lit(p.tone_bins - 1)).cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def dense(bins: DataFrame, p: Parameters = Parameters(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A row per key and bin, `v` its number of samples (0 where there are none)."""
    every = bins.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(p.tone_bins - 1))))
    return every.join(bins, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("v"))


def smoothed(rows: DataFrame, p: Parameters = Parameters(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Binomial smoothing over bins with replicated ends, `tone_smoothing_passes` times."""
    kernel = [1.0]
    for _ in range(2 * p.tone_smoothing_radius):
        kernel = [a + b for a, b in zip([0.0, *kernel], [*kernel, 0.0], strict=True)]
    by = Window.partitionBy(*keys).orderBy("bin")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for _ in range(p.tone_smoothing_passes):
        taps = []
        for k, w in enumerate(kernel):
            off = k - p.tone_smoothing_radius
            at = F.lag("v", -off).over(by) if off < 0 else F.lead("v", off).over(by) if off else F.col("v")
            end = F.first("v").over(whole) if off < 0 else F.last("v").over(whole)
            taps.append((F.coalesce(at, end) if off else at) * F.lit(w / 4.0**p.tone_smoothing_radius))
        total = taps[0]
        for t in taps[1:]:
            total = total + t
        rows = rows.withColumn("v", total)
    return rows


def tone_curves(smooth: DataFrame, fitted: DataFrame, noise: Column, p: Parameters = Parameters(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """`fitted` with `curve array<double>` of tone_bins + 1 values from 0 to 1 (empty without density). `smooth` has the
    smoothed density by `bin`.

    Weights are the density over its mean to a power, plus a prior; a scale found by bisection makes weights that are
    kept within slope_min and a cap by noise add up to the number of bins; the curve is their running sum, blended
    with the diagonal. A sum that misses 1 is an error.
    """
    n, strength = p.tone_bins, p.tone_contrast_strength
    if strength == 0:
        return fitted.withColumn("curve", F.array().cast("array<double>"))
    mean = F.avg("v").over(Window.partitionBy(*keys))
    at = smooth.withColumn("mean", mean).where("mean > 0").join(fitted.where(~F.col("constant")), list(keys))
    weight = F.lit(p.tone_density_prior) + F.pow(F.col("v") / F.col("mean"), F.lit(p.tone_density_power))
    y, e = srgb_decode((F.col("bin") + 0.5) / n), F.col("exposure")
    grain = F.coalesce(display_noise(y / (e - (e - 1.0) * y), e, F.col("lower"), F.col("upper"), F.col("black"), noise), F.lit(0.0))
    cap = F.least(F.greatest(F.lit(p.tone_noise_target) / F.greatest(grain, F.lit(1e-9)), F.lit(p.tone_cap_min)), F.lit(p.tone_cap_max))
    lists = at.select(*keys, F.struct("bin", weight.alias("w"), cap.alias("c")).alias("wc")).groupBy(*keys).agg(F.sort_array(F.collect_list("wc")).alias("wc"))
    slope = lambda w, c, s: F.least(F.greatest(s * w, F.lit(p.tone_slope_min)), c)
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(p.tone_solver_upper).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) * 0.5
        much = F.aggregate("wc", F.lit(0.0), lambda a, x: a + slope(x["w"], x["c"], middle)) > n
        return F.struct(F.when(much, s["lo"]).otherwise(middle).alias("lo"), F.when(much, middle).otherwise(s["hi"]).alias("hi"))

    solved = lists.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(p.tone_solver_iterations)), start, halve))
    # Rows again: what follows takes the scale as a value and not as an expression to repeat.
    rows = solved.select(*keys, ((F.col("s.lo") + F.col("s.hi")) * 0.5).alias("scale"), F.explode("wc").alias("x")).select(*keys, "scale", "x.*")
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*keys, "bin", F.sum(slope(F.col("w"), F.col("c"), F.col("scale")) / n).over(upto).alias("sum"))
    blended = F.when(F.col("bin") == n - 1, F.lit(1.0)).otherwise((1 - strength) * (F.col("bin") + 1) / F.lit(float(n)) + strength * F.col("sum"))
    curves = rows.groupBy(*keys).agg(F.max("sum").alias("total"), F.sort_array(F.collect_list(F.struct("bin", blended.alias("v")))).alias("c"))
    wrong = F.raise_error(F.lit("the tone curve did not converge: more solver iterations or a smaller solver bound are needed")).cast("array<double>")
    curve = F.concat(F.array(F.lit(0.0)), F.transform("c", lambda x: x["v"]))
    curves = curves.select(*keys, F.when(F.abs(F.col("total") - 1) <= 1e-8, curve).otherwise(wrong).alias("curve"))
    return fitted.join(curves, list(keys), "left").withColumn("curve", F.coalesce("curve", F.array().cast("array<double>")))


def mapped(x: Column, exposure: Column, curve: Column, p: Parameters = Parameters(), optimized: bool = True) -> Column:
    """A normalized value through exposure and curve, by linear interpolation between its points."""
    linear = expose(x, exposure)
    bins = F.size(curve) - 1
    position = srgb_encode(linear) * bins
    index = F.least(F.floor(position), bins - 1).cast("int")
    t = position - index
    curved = srgb_decode(F.get(curve, index) * (1 - t) + F.get(curve, index + 1) * t)
    out = F.when(F.size(curve) < 2, linear).otherwise(curved)
    if optimized and p.optimize_strength == 0:
        out = x
    elif optimized and p.optimize_strength < 1:
        out = (1 - p.optimize_strength) * x + p.optimize_strength * out
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(out)


def mapping_samples(fitted: DataFrame, p: Parameters = Parameters(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The mapping at the interior points of `mapping_steps` equal steps: `i, x, value`, and `text` at the parameters' decimals."""
    x = F.col("i") / F.lit(float(p.mapping_steps))
    at = fitted.select(*keys, "exposure", "curve", F.explode(F.sequence(F.lit(1), F.lit(p.mapping_steps - 1))).alias("i")).withColumn("x", x)
    at = at.withColumn("value", mapped(F.col("x"), F.col("exposure"), F.col("curve"), p))
    text = F.format_string(f"%.{p.mapping_input_decimals}f->%.{p.mapping_output_decimals}f", "x", "value")
    return at.select(*keys, "i", "x", "value", text.alias("text"))


def lookup_table(hist: DataFrame, fitted: DataFrame, function=None, policy: str = "clip", srgb: bool = False, p: Parameters = Parameters(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A row per code that occurs: `value` (0..1 before the transfer) and `out` (16 bits).

    `function` maps a column to a column; values it gives that aren't finite are an error, others outside 0..1 are
    treated by `policy` (clip, scale or wrap)."""
    from ..functions.expression import clipped, scaled, wrapped

    at = hist.join(fitted, list(keys))
    x = mapped(normalized(F.col("code").cast("double"), F.col("lower"), F.col("upper")), F.col("exposure"), F.col("curve"), p)
    at = at.select(*keys, "code", "n", x.alias("x"))
    y = at.withColumn("y", finite(function(F.col("x"))) if function else F.col("x"))
    if policy == "scale":
        ends = y.groupBy(*keys).agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
        y = y.join(ends, list(keys)).withColumn("value", scaled(F.col("y"), F.col("y0"), F.col("y1"))).drop("y0", "y1")
    else:
        y = y.withColumn("value", {"clip": clipped, "wrap": wrapped}[policy](F.col("y")))
    shown = srgb_encode(F.col("value")) if srgb else F.col("value")
    return y.withColumn("out", F.round(shown * 65535).cast("int"))


def apply_table(samples: DataFrame, table: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Samples with the `out` of their code. The join's side is chosen by the table's size as Spark measures it; a hot code can be
    split, since either side has an exchange of its own."""
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return samples.join(table.select(*keys, "code", "out").repartition(parts), [*keys, "code"])


def to_eight_bits(out: Column, from_srgb: bool, to_srgb: bool) -> Column:
    """8-bit codes from quantized 16-bit codes, converted between transfers."""
    v = out / 65535.0
    if from_srgb != to_srgb:
        v = srgb_encode(v) if to_srgb else srgb_decode(v)
    return F.round(v * 255).cast("int")
