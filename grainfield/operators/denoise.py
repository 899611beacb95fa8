"""Multiscale denoising: an a-trous pyramid with a Wiener share per band.

Frames are cut into square tiles with a halo that covers the filters' reach, so that a frame of any size is handled
in tasks of one tile; interiors come out the same as from the whole frame.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .histogram import KEYS
from .noise import sigma_at

KERNEL = np.array([1, 4, 6, 4, 1]) / 16
MAX_SCALES = 4


def scales_for(width: int, height: int) -> int:
    return sum(1 for k in range(MAX_SCALES) if all((4 << j) < min(width, height) for j in range(k + 1)))


def halo_for(scales: int) -> int:
    """Samples that a result may depend on beyond its own: the detail filters, and the energy filter of the last."""
    return 2 * sum(1 << k for k in range(scales)) + 2 * (1 << max(0, scales - 1))


def band_variances(scales: int) -> list[float]:
    """Variance of unit white noise in each band: the squared norm of the difference of successive 2-D kernels."""
    out, before = [], np.array([1.0])
    for k in range(scales):
        step = 1 << k
        spaced = np.zeros(4 * step + 1)
        spaced[::step] = KERNEL
        after = np.convolve(before, spaced)
        cross = float((before * after[2 * step : 2 * step + len(before)]).sum())
        out.append(max(0.0, float((before**2).sum()) ** 2 + float((after**2).sum()) ** 2 - 2 * cross**2))
        before = after
    return out


def _smooth(x: np.ndarray, step: int) -> np.ndarray:
    for axis in (1, 0):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (2 * step, 2 * step)
        wide = np.pad(x, pad, mode="reflect")
        n = x.shape[axis]
        x = sum(w * np.take(wide, range(k * step, k * step + n), axis=axis) for k, w in enumerate(KERNEL.astype(np.float32))).astype(np.float32)
    return x


def reduced(codes: np.ndarray, variance: np.ndarray, level: float, white: int, scales: int) -> np.ndarray:
    """A raster (or tile) with noise reduced; `variance` is by code. Zeros and codes from `white` up stay."""
    now = codes.astype(np.float32)
    out = now.copy()
    for k, factor in enumerate(band_variances(scales)):
        low = _smooth(now, 1 << k)
        detail = now - low
        energy = _smooth(detail * detail, 1 << k)
        noise = variance[np.clip(low, 0, 65535).astype(np.int64)] * np.float32(factor * level * level)
        out -= np.clip(noise / np.maximum(energy, np.float32(1e-12)), 0, 1) * detail
        now = low
    return np.where((codes == 0) | (codes >= white), codes.astype(np.float32), np.clip(out, 0, 65535))


def denoised(samples: DataFrame, meta: DataFrame, noise: DataFrame, level: float = 1.0, tile: int = 512, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """`samples` with `value` (float), the denoised code. `meta` has `width, height, black, white`; `noise` has a noise
    struct `noise` by key. Level 0, frames of sides up to 4, and frames without a noise estimate come out unchanged.
    """
    if not 0 <= level <= 2:
        raise ValueError("the noise reduction level is within 0..2")
    if level == 0:
        return samples.withColumn("value", F.col("code").cast("float"))
    at = samples.join(meta.select(*keys, "width", "height", "black", "white"), list(keys))
    halo = halo_for(MAX_SCALES)
    # Every tile whose halo reaches a sample; its own tile is the home.
    near = lambda v, n: F.sequence(
        F.floor(F.greatest(v - halo, F.lit(0)) / tile).cast("int"), F.floor(F.least(v + halo, n - 1) / tile).cast("int")
    )
    put = at.withColumn("ty", F.explode(near(F.col("y"), F.col("height")))).withColumn("tx", F.explode(near(F.col("x"), F.col("width"))))
    # A sparse table of sigma every 64 codes gives the variance of each code by interpolation.
    grid = list(range(0, 65536, 64)) + [65535]
    curve = noise.join(meta.select(*keys, "black"), list(keys)).select(
        *keys, F.transform(F.array(*[F.lit(float(g)) for g in grid]), lambda c: F.pow(sigma_at(F.col("noise"), F.greatest(c - F.col("black"), F.lit(0.0))), F.lit(2.0))).alias("curve")
    )
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*keys).schema)
    names = list(keys)

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({c: [] for c in (*names, "y", "x", "code", "value")})
        ty, tx = key[-2], key[-1]
        y0, x0 = int(left["y"].min()), int(left["x"].min())
        h, w = int(left["y"].max()) - y0 + 1, int(left["x"].max()) - x0 + 1
        codes = np.zeros((h, w), np.int64)
        codes[left["y"] - y0, left["x"] - x0] = left["code"]
        first = left.iloc[0]
        scales = scales_for(int(first["width"]), int(first["height"]))
        known = not right.empty and right.iloc[0]["curve"] is not None and not any(v is None or v != v for v in right.iloc[0]["curve"])
        value = codes.astype(np.float32)
        if known and scales and min(h, w) > 4 << (scales - 1):
            variance = np.interp(np.arange(65536), grid, np.array(right.iloc[0]["curve"], float)).astype(np.float32)
            if variance.any():
                value = reduced(codes, variance, level, int(first["white"]), scales)
        own = left[(left["y"] // tile == ty) & (left["x"] // tile == tx)]
        out = own[[*names, "y", "x", "code"]].copy()
        out["value"] = value[own["y"] - y0, own["x"] - x0]
        return out

    own = [*keys, "ty", "tx"]
    tiles = put.select(*own).distinct().join(curve, list(keys)).select(*[F.col(c).alias(f"of_{c}") for c in own], "curve")
    return put.groupBy(*own).cogroup(tiles.groupBy(*[f"of_{c}" for c in own])).applyInPandas(one, f"{head}, y int, x int, code int, value float")
