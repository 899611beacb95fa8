"""Recurring defects over many frames: previews, views, candidate dips, votes, plans and gain.

Per-frame work (a preview has at most about 2048 cells a side) runs in Arrow groups of one frame; what joins frames is
relational: equal geometry, near ordinals, near places. Greedy steps depend on a total order and stay within one
geometry or one target.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .histogram import conservative_mad, nearer_zero_median

SIMILAR, MIN_VIEWS, REACH, POOL, STACK = 0.985, 3, 128, 64, 24
MAX_LOG_GAIN, MAX_FIT_ERROR, CHANCE = 2 * math.log(2), 0.02, 0.01
GRID_W, GRID_H = 16, 12
SIGMAS = (0.7, 1.2, 2.0, 3.2, 5.0, 8.0, 12.0, 18.0)
PATCH_SIDE = 33


def geometries(meta: DataFrame) -> DataFrame:
    """`meta` with `geometry`: frames of one camera, raster size and crop corner whose crops differ by a row or column at most, as
    halved planes do, are alike. It is named after the largest crop that takes them in. `meta` has `make, model, raw_width,
    raw_height, crop` (x, y, width, height)."""
    own = ["make", "model", "raw_width", "raw_height"]
    at = meta.withColumns({f"_c{i}": F.get("crop", F.lit(i)) for i in range(4)})
    sizes = at.select(*own, *[f"_c{i}" for i in range(4)]).distinct()
    # A size goes with the one that is larger by one in either direction, where that occurs.
    grown = sizes.select(*own, "_c0", "_c1", (F.col("_c2") - 0).alias("w"), (F.col("_c3") - 0).alias("h"))
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)]))
    near = sizes.withColumn("s", steps).select(*own, *[f"_c{i}" for i in range(4)], (F.col("_c2") + F.col("s.dx")).alias("w"), (F.col("_c3") + F.col("s.dy")).alias("h"))
    named = near.join(grown, [*own, "_c0", "_c1", "w", "h"]).groupBy(*own, *[f"_c{i}" for i in range(4)]).agg(F.max(F.struct("w", "h")).alias("g"))
    name = F.concat_ws("/", *own, F.concat_ws(",", "_c0", "_c1", "g.w", "g.h"))
    return at.join(named, [*own, *[f"_c{i}" for i in range(4)]]).withColumn("geometry", name).select(*meta.columns, "geometry")


def preview_step(width: Column, height: Column) -> Column:
    """The even block size for which the long side has about 2048 blocks or fewer."""
    return (F.ceil(F.ceil(F.greatest(width, height) / 2048) / 2) * 2).cast("int")


def preview(samples: DataFrame, meta: DataFrame, key: str = "frame", side: int | None = None) -> DataFrame:
    """Block means above black as shares of the span: `py, px, v`. `meta` has `width, height, black, white`. `side` is the
    block size of all frames; without it, `preview_step` gives one by frame."""
    step = F.lit(side) if side else preview_step(F.col("width"), F.col("height"))
    at = samples.join(meta.select(key, "black", "white", step.alias("step")), key)
    block = at.groupBy(key, F.floor(F.col("y") / F.col("step")).cast("int").alias("py"), F.floor(F.col("x") / F.col("step")).cast("int").alias("px"), "black", "white")
    mean = (F.sum(F.col("code").cast("long")) / F.count("*") - F.col("black")) / (F.col("white") - F.col("black"))
    return block.agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)).alias("v")).drop("black", "white")


def signature(cells: DataFrame, size: DataFrame, key: str = "frame") -> DataFrame:
    """A unit vector of mean logarithms over a 16 x 12 grid, without their mean. `size` has `pw` and `ph`."""
    at = cells.join(size.select(key, "pw", "ph"), key)
    part = lambda v, n, parts: (F.ceil(parts * (v + 1) / n) - 1).cast("int")
    cell = part(F.col("py"), F.col("ph"), GRID_H) * GRID_W + part(F.col("px"), F.col("pw"), GRID_W)
    means = at.groupBy(key, cell.alias("cell")).agg(F.avg(F.log(F.greatest("v", F.lit(0.001)))).alias("m"))
    every = means.select(key).distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(GRID_W * GRID_H - 1))))
    whole = Window.partitionBy(key)
    rows = every.join(means, [key, "cell"], "left").withColumn("m", F.coalesce("m", F.lit(0.0))).withColumn("c", F.col("m") - F.avg("m").over(whole))
    rows = rows.withColumn("s", F.col("c") / F.greatest(F.sqrt(F.sum(F.col("c") * F.col("c")).over(whole)), F.lit(1e-12)))
    got = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("cell", "s"))).alias("g"))
    return got.select(key, F.transform("g", lambda x: x["s"]).alias("signature"))


def similarity(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def same_view(a: Column, b: Column, least: float = SIMILAR) -> Column:
    return (a == b) | (similarity(a, b) > least)


def top_peaks(peaks: DataFrame, width: Column, height: Column, keys: list[str], most: int = 800, per_tile: int = 16) -> DataFrame:
    """Peaks (`score, y, x`) among the first of their frame or of their tile."""
    order = [F.col("score").desc(), "y", "x"]
    tile = (F.floor(F.col("y") * GRID_H / height) * GRID_W + F.floor(F.col("x") * GRID_W / width)).cast("int")
    ranked = peaks.withColumn("tile", tile)
    ranked = ranked.withColumns({"rank": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), "tile_rank": F.row_number().over(Window.partitionBy(*keys, "tile").orderBy(*order))})
    return ranked.where((F.col("rank") <= most) | (F.col("tile_rank") <= per_tile))


# Candidates of one preview, in NumPy.


class _Fitter:
    """Least squares of a quadratic background and a Gaussian dip of unit width on a disc of radius 4."""

    def __init__(self) -> None:
        g = np.arange(-8, 9) * 0.5
        y, x = (v.ravel() for v in np.meshgrid(g, g, indexing="ij"))
        disc = x * x + y * y <= 16
        self.x, self.y = x[disc], y[disc]
        r2 = self.x**2 + self.y**2
        quad = np.stack([np.ones_like(r2), self.x, self.y, self.x**2, self.x * self.y, self.y**2], 1)
        self.dip = -np.exp(-0.5 * r2)
        self.basis = np.concatenate([quad, self.dip[:, None]], 1)
        self.solve = np.linalg.pinv(self.basis)
        self.ring = r2 >= 6.25
        self.quad = quad
        self.solve_ring = np.linalg.pinv(quad[self.ring])

    def fit(self, img: np.ndarray, x: float, y: float, s: float):
        """(amplitude, rms, ring rms, background) or None."""
        h, w = img.shape
        if x < 4 * s or y < 4 * s or x + 4 * s >= w or y + 4 * s >= h:
            return None
        v = bilinear(img, x + self.x * s, y + self.y * s)
        if (v < 0.0007).any() or (v >= 0.97).any():
            return None
        logs = np.log(v)
        c = self.solve @ logs
        a = c[6]
        if not 0.012 <= a < MAX_LOG_GAIN:
            return None
        rms = float(np.sqrt(((logs - self.basis @ c) ** 2).mean()))
        rest = logs - a * self.dip
        back = self.solve_ring @ rest[self.ring]
        ring = float(np.sqrt(((rest - self.quad @ back)[self.ring] ** 2).mean()))
        if rms >= min(MAX_FIT_ERROR, max(0.25 * a, 0.002)) or ring >= MAX_FIT_ERROR:
            return None
        return float(a), rms, ring, back


def quality(fit) -> float:
    """Amplitude over what the fit leaves: the order in which candidates are taken."""
    return fit[0] / max(fit[1], 1e-9)


def bilinear(img: np.ndarray, x, y) -> np.ndarray:
    h, w = img.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    tx, ty = x - x0, y - y0
    return (img[y0, x0] * (1 - tx) + img[y0, x1] * tx) * (1 - ty) + (img[y1, x0] * (1 - tx) + img[y1, x1] * tx) * ty


def smoothed(img: np.ndarray, x, y, step: float) -> np.ndarray:
    """Samples averaged lightly with those `step` away."""
    taps = [(-1, 0.2), (0, 0.6), (1, 0.2)]
    return sum(wa * wb * bilinear(img, x + a * step, y + b * step) for a, wa in taps for b, wb in taps)


def reached(open_: np.ndarray, y: int, x: int) -> list[tuple[int, int]]:
    """The open cells connected with (y, x) over eight neighbours; they are closed on the way."""
    h, w = open_.shape
    todo, own = [(y, x)], []
    open_[y, x] = False
    while todo:
        y, x = todo.pop()
        own.append((y, x))
        for j in range(max(y - 1, 0), min(y + 2, h)):
            for i in range(max(x - 1, 0), min(x + 2, w)):
                if open_[j, i]:
                    open_[j, i] = False
                    todo.append((j, i))
    return own


def darkness(img: np.ndarray, sigma: float) -> np.ndarray:
    """How much darker a small box is than a large one around it, relative to the large; 0 near edges and extremes."""
    h, w = img.shape
    margin = math.ceil(4 * sigma) + 2
    out = np.zeros_like(img)
    if min(h, w) <= 2 * margin + 2:
        return out
    total = np.pad(img.astype(float), ((1, 0), (1, 0))).cumsum(0).cumsum(1)

    def mean(r: int) -> np.ndarray:
        a, b = margin - r, margin + r + 1
        hh, ww = h - 2 * margin, w - 2 * margin
        s = total[b : b + hh, b : b + ww] + total[a : a + hh, a : a + ww] - total[a : a + hh, b : b + ww] - total[b : b + hh, a : a + ww]
        return s / (2 * r + 1) ** 2

    back, small = mean(round(3 * sigma)), mean(max(1, math.floor(sigma + 0.5)))
    fine = (back > 0.001) & (back < 0.97)
    out[margin : h - margin, margin : w - margin] = np.where(fine, (back - small) / np.where(fine, back, 1), 0)
    return out


def peaks_of(score: np.ndarray, sigma: float, least: float = 0.008) -> np.ndarray:
    """(score, y, x) of cells above `least` that no cell within the radius exceeds (of equals the first in row order)."""
    r = max(1, int(sigma))
    wide = np.pad(score, r, constant_values=-np.inf)
    ys, xs = np.nonzero(score > least)
    v = score[ys, xs]
    top = np.ones(len(ys), bool)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if (dy or dx) and top.any():
                i = np.nonzero(top)[0]
                other = wide[ys[i] + r + dy, xs[i] + r + dx]
                before = dy < 0 or (dy == 0 and dx < 0)
                top[i] = (other < v[i]) if before else (other <= v[i])
    out = np.stack([v[top], ys[top], xs[top]], 1)
    return out[np.lexsort((out[:, 2], out[:, 1], -out[:, 0]))]


def candidates_of(img: np.ndarray, most: int = 400) -> list[dict]:
    """Compact dips of a preview, the best fits first, none overlapping a better one."""
    fitter = _Fitter()
    h, w = img.shape
    found = []
    for sigma in SIGMAS:
        per_tile: dict[int, int] = {}
        for rank, (_, y, x) in enumerate(peaks_of(darkness(img, sigma), sigma)):
            tile = int(y * GRID_H // h) * GRID_W + int(x * GRID_W // w)
            per_tile[tile] = per_tile.get(tile, 0) + 1
            if (rank < 800 or per_tile[tile] <= 16) and (fit := fitter.fit(img, x, y, sigma)):
                found.append((x, y, sigma, fit))
    found.sort(key=lambda f: (-quality(f[3]), f[1], f[0], f[2]))
    chosen: list[dict] = []
    for x, y, s, fit in found:
        if any(math.hypot(x - c["x"], y - c["y"]) <= 2 * max(s, c["sigma"]) for c in chosen):
            continue
        for f in (0.1, 0.05, 0.025):  # a local search over place and width
            for px, py, ps in ((x - 5 * f, y, s), (x + 5 * f, y, s), (x, y - 5 * f, s), (x, y + 5 * f, s), (x, y, s * (1 - f)), (x, y, s * (1 + f))):
                better = fitter.fit(img, px, py, ps)
                if better and quality(better) > quality(fit):
                    x, y, s, fit = px, py, ps, better
        chosen.append({"x": float(x), "y": float(y), "sigma": float(s), "amplitude": fit[0], "fit_error": fit[1], "gain": _gain(img, x, y, s, fit).ravel().tolist()})
        if len(chosen) == most:
            break
    return chosen


def _gain(img: np.ndarray, x: float, y: float, s: float, fit) -> np.ndarray:
    """Log gain on a square grid of side PATCH_SIDE over 3.5 widths: background less the lightly smoothed signal."""
    u = np.linspace(-3.5, 3.5, PATCH_SIDE)
    v, u = np.meshgrid(u, u, indexing="ij")
    back = sum(c * b for c, b in zip(fit[3], (1.0, u, v, u * u, u * v, v * v), strict=True))
    seen = smoothed(img, x + u * s, y + v * s, min(0.2 * s, 1.0))
    taper = np.clip(3.5 - np.hypot(u, v), 0, 1)
    return np.clip(back - np.log(np.maximum(seen, 0.0007)) - 0.5 * fit[2], 0, min(2 * fit[0], MAX_LOG_GAIN)) * taper * taper * (3 - 2 * taper)


CANDIDATE = "x double, y double, sigma double, amplitude double, fit_error double, gain array<double>"


def candidates(cells: DataFrame, key: str = "frame") -> DataFrame:
    """Candidates of each frame from its preview cells (`py, px, v`)."""
    kind = cells.select(key).schema[0].dataType.simpleString()

    def one(f: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((int(f["py"].max()) + 1, int(f["px"].max()) + 1))
        img[f["py"], f["px"]] = f["v"]
        got = pd.DataFrame(candidates_of(img), columns=[c.split()[0] for c in CANDIDATE.split(", ")])
        got.insert(0, key, f[key].iloc[0])
        return got

    return cells.groupBy(key).applyInPandas(one, f"`{key}` {kind}, {CANDIDATE}")


def match_radius(a, b):
    return np.maximum(0.375 * (a + b), 0.75)


def distinct_views(frames: DataFrame, least: float = SIMILAR) -> DataFrame:
    """`frame, geometry, view` from `frame, geometry, ordinal, signature`: in order, the first earlier representative
    of the same view, or a new view."""
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ordinal")
        first: list[np.ndarray] = []
        views = []
        for s in f["signature"]:
            s = np.asarray(s, float)
            same = next((i for i, o in enumerate(first) if np.array_equal(s, o) or float(s @ o) > least), len(first))
            if same == len(first):
                first.append(s)
            views.append(same)
        return pd.DataFrame({"frame": f["frame"], "geometry": f["geometry"], "view": views})

    return frames.groupBy("geometry").applyInPandas(one, f"frame {kinds['frame']}, geometry {kinds['geometry']}, view int")


SPOT = "spot int, x double, y double, sigma double, images int, views int, depth double, log_chance double"


def confirmed_spots(observed: DataFrame, chance: float = CHANCE, min_views: int = MIN_VIEWS) -> DataFrame:
    """Spots of each geometry from candidates with `frame, geometry, ordinal, view, pw, ph`.

    Candidates in order of fit error join the nearest cluster whose first member lies within the match radius, one
    vote per frame. A cluster stays with `min_views` views or more if that many would hardly meet by chance,
    given how densely candidates lie around it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in observed.schema}

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["fit_error", "ordinal", "y", "x"]).reset_index(drop=True)
        x, y, s = (f[c].to_numpy(float) for c in ("x", "y", "sigma"))
        frame, view = f["ordinal"].to_numpy(), f["view"].to_numpy()
        n_views, n_images = len(np.unique(view)), len(np.unique(frame))
        seeds: list[int] = []
        members: list[list[int]] = []
        for i in range(len(f)):
            if seeds:
                k = np.array(seeds)
                d = np.hypot(x[k] - x[i], y[k] - y[i])
                d = np.where(d <= match_radius(s[k], s[i]), d, np.inf)
                j = int(d.argmin())
                if np.isfinite(d[j]):
                    if frame[i] not in frame[members[j]]:
                        members[j].append(i)
                    continue
            seeds.append(i)
            members.append([i])
        out = []
        w, h = float(f["pw"].max()), float(f["ph"].max())
        for i, m in zip(seeds, members, strict=True):
            seen = len(np.unique(view[m]))
            if seen < min_views or n_views < min_views:
                continue
            area = (min(x[i] + w / 8, w) - max(x[i] - w / 8, 0)) * (min(y[i] + h / 8, h) - max(y[i] - h / 8, 0))
            near = (np.abs(x - x[i]) <= w / 8) & (np.abs(y - y[i]) <= h / 8)
            p = float((np.pi * match_radius(s[i], s[near]) ** 2).sum() / (n_images * area))
            k, n = seen - 1, n_views - 1
            log_chance = math.log(max(1, len(f))) + math.log(math.comb(n, k)) + k * math.log(min(1.0, max(p, 5e-324)))
            if log_chance > math.log(chance):
                continue
            depth = np.sort([sum(f["gain"][q]) * (7 * s[q] / (PATCH_SIDE - 1)) ** 2 for q in m])
            out.append((x[m].mean(), y[m].mean(), s[i], len(m), seen, depth[len(m) // 2], log_chance))
        got = pd.DataFrame(out, columns=["x", "y", "sigma", "images", "views", "depth", "log_chance"])
        got.insert(0, "spot", range(len(got)))
        got.insert(0, "geometry", f["geometry"].iloc[0])
        return got

    return observed.groupBy("geometry").applyInPandas(one, f"geometry {kinds['geometry']}, {SPOT}")


def planned(targets: DataFrame, spots: DataFrame) -> DataFrame:
    """Candidates of target frames that a confirmed spot of their geometry accounts for, each with its first spot."""
    s = spots.select("geometry", "spot", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("sigma").alias("ss"))
    reach = F.greatest(0.375 * (F.col("ss") + F.col("sigma")), F.lit(0.75))
    met = targets.join(s, "geometry").where(F.hypot(F.col("sx") - F.col("x"), F.col("sy") - F.col("y")) <= reach)
    first = Window.partitionBy("frame", "x", "y", "sigma").orderBy("spot")
    return met.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k", "sx", "sy", "ss")


def gain_rows(patches: DataFrame, step: Column) -> DataFrame:
    """Log gain per sensor sample from patches: bilinear within each, added where patches overlap."""
    p = patches.withColumn("step", step).withColumns({
        "spacing": 7 * F.col("sigma") / (PATCH_SIDE - 1) * F.col("step"),
        "ox": (F.col("x") - 3.5 * F.col("sigma") + 0.5) * F.col("step") - 0.5, "oy": (F.col("y") - 3.5 * F.col("sigma") + 0.5) * F.col("step") - 0.5,
    })
    span = (PATCH_SIDE - 1) * F.col("spacing")
    over = lambda o: F.sequence(F.ceil(F.greatest(F.col(o), F.lit(0.0))).cast("int"), F.greatest(F.floor(F.col(o) + span), F.lit(0)).cast("int"))
    at = p.withColumn("sy", F.explode(over("oy"))).withColumn("sx", F.explode(over("ox")))
    u, v = (F.col("sx") - F.col("ox")) / F.col("spacing"), (F.col("sy") - F.col("oy")) / F.col("spacing")
    i, j = F.least(F.floor(u), F.lit(PATCH_SIDE - 2)), F.least(F.floor(v), F.lit(PATCH_SIDE - 2))
    g = lambda a, b: F.get("gain", (b * PATCH_SIDE + a).cast("int"))
    tx, ty = u - i, v - j
    value = (g(i, j) * (1 - tx) + g(i + 1, j) * tx) * (1 - ty) + (g(i, j + 1) * (1 - tx) + g(i + 1, j + 1) * tx) * ty
    rows = at.select("frame", F.col("sy").cast("int").alias("y"), F.col("sx").cast("int").alias("x"), value.alias("g"))
    return rows.groupBy("frame", "y", "x").agg(F.sum("g").alias("log_gain")).where("log_gain != 0")


def corrected(code: Column, log_gain: Column, black: Column, white: Column, strength: float = 1.0) -> Column:
    """A code with its log gain applied: black and white stay, nothing passes white."""
    if not 0 <= strength <= 2:
        raise ValueError("the correction strength is within 0..2")
    gain = F.exp(F.least(F.greatest(log_gain * strength, F.lit(-0.25)), F.lit(MAX_LOG_GAIN)))
    value = F.round(F.least(black + (code - black) * gain, white)).cast("int")
    return F.when(log_gain.isNull() | (log_gain == 0) | (code <= black) | (code >= white) | F.lit(strength == 0), code).otherwise(value)


def applied(samples: DataFrame, gains: DataFrame, meta: DataFrame, strength: float = 1.0) -> DataFrame:
    """Samples with `fixed`, the corrected code."""
    at = samples.join(meta.select("frame", "black", "white"), "frame").join(gains, ["frame", "y", "x"], "left")
    return at.withColumn("fixed", corrected(F.col("code"), F.col("log_gain"), F.col("black").cast("double"), F.col("white").cast("double"), strength))


# Neighbours of a target and stacks of their residuals.


def neighbour_pool(targets: DataFrame, frames: DataFrame, most: int = POOL, reach: int = REACH, least: float = SIMILAR) -> DataFrame:
    """For each target its nearest frames of one geometry by ordinal (ties: the earlier), each of another view than the
    target and the frames before it: `target, frame, place, earlier`. Rows are `frame, geometry, ordinal, signature`.

    Ordinals are joined by buckets of `reach`, so that each target meets a bounded number of frames.
    """
    bucket = lambda c: F.floor(F.col(c) / reach)
    t = targets.select(F.col("frame").alias("target"), "geometry", F.col("ordinal").alias("at"), F.col("signature").alias("own"), F.explode(F.array(*[bucket("ordinal") + k for k in (-1, 0, 1)])).alias("b"))
    f = frames.select("frame", "geometry", "ordinal", "signature", bucket("ordinal").alias("b"))
    near = t.join(f, ["geometry", "b"]).where(F.abs(F.col("ordinal") - F.col("at")) <= reach)
    near = near.where(~same_view(F.col("signature"), F.col("own"), least)).select("target", "frame", "ordinal", "at", "signature")
    kind = {x.name: x.dataType.simpleString() for x in near.schema}

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(d=(g["ordinal"] - g["at"]).abs()).sort_values(["d", "ordinal"])
        kept: list[int] = []
        seen: list[np.ndarray] = []
        for k, s in enumerate(g["signature"]):
            s = np.asarray(s, float)
            if not any(np.array_equal(s, o) or float(s @ o) > least for o in seen):
                seen.append(s)
                kept.append(k)
            if len(kept) == most:
                break
        g = g.iloc[kept]
        return pd.DataFrame({"target": g["target"], "frame": g["frame"], "place": range(len(g)), "earlier": g["ordinal"] < g["at"]})

    return near.groupBy("target").applyInPandas(one, f"target {kind['target']}, frame {kind['frame']}, place int, earlier boolean")


def stack_sets(pool: DataFrame, views: int = STACK, min_views: int = MIN_VIEWS) -> DataFrame:
    """Nearest views of both sides and of either, and the nearer half of each: `target, set, frame`; sets with too few
    views, and sets equal to one before them, are left out."""
    sides = [("nearest", F.lit(True)), ("before", F.col("earlier")), ("after", ~F.col("earlier"))]
    parts = []
    for k, (name, test) in enumerate(sides):
        ranked = pool.where(test).withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy("place")))
        for half, n in ((0, views), (1, views // 2)):
            parts.append(ranked.where(F.col("r") <= n).select("target", "frame", F.lit(2 * k + half).alias("set")))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    lists = every.groupBy("target", "set").agg(F.sort_array(F.collect_list("frame")).alias("frames")).where(F.size("frames") >= min_views)
    first = Window.partitionBy("target", "frames").orderBy("set")
    return lists.withColumn("k", F.row_number().over(first)).where("k = 1").select("target", "set", F.explode("frames").alias("frame"))


def stacked(sets: DataFrame, residuals: DataFrame) -> DataFrame:
    """Per target, set and cell: median nearer zero, spread and number of smooth values. `residuals` has
    `frame, y, x, value, smooth`; a set has at most `STACK` frames, which bounds each list."""
    met = sets.join(residuals.where("smooth"), "frame").groupBy("target", "set", "y", "x").agg(F.array_sort(F.collect_list("value")).alias("v"))
    met = met.withColumn("median", nearer_zero_median(F.col("v")))
    return met.select("target", "set", "y", "x", "median", conservative_mad(F.col("v"), F.col("median")).alias("spread"), F.size("v").alias("n"))


def gaussian(img: np.ndarray, sigma: float, odd: bool = False) -> np.ndarray:
    """Separable Gaussian blur reaching three widths; beyond an edge its value goes on, or with `odd` the mirror image through it."""
    r = max(1, math.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        wide = np.pad(img, pad, mode="reflect", reflect_type="odd") if odd and img.shape[axis] > 1 else np.pad(img, pad, mode="edge")
        img = sum(w * np.take(wide, range(i, i + img.shape[axis]), axis=axis) for i, w in enumerate(k))
    return img


def _fifth(v: np.ndarray) -> float:
    return float(np.sort(v)[len(v) // 5]) if len(v) else 0.0


def _grain(value: np.ndarray, level: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """What grain alone gives each place: the lower fifth of the counted values of its octave of brightness (`level` is a logarithm), or
    of the nearest octave that has 20, or of all."""
    octave = np.clip(np.floor(level / math.log(2) + 11), 0, 11).astype(int)
    known = {o: _fifth(value[counted & (octave == o)]) for o in range(12) if (counted & (octave == o)).sum() >= 20}
    rest = _fifth(value[counted])
    return np.array([known[min(known, key=lambda g: (abs(g - o), g))] if known else rest for o in range(12)])[octave]


#: Residual maps: detail below this doesn't level its surroundings; side of a texture tile; tolerated texture in grains and at least.
DARK, TILE, GRAINS, TEXTURE = -0.03, 16, 1.8, 0.012


def residuals(cells: DataFrame, sigma: float = 16.0, key: str = "frame") -> DataFrame:
    """High-passed logarithms of a preview in steps of 1/2048 (at most 8 either way), levelled again without what is dark, so that a
    deep dip has no bright halo, and whether a cell is `smooth`: neither black nor clipped, in surroundings whose texture (the
    median detail of tiles) isn't beyond grain. Cells that are missing are black."""
    kind = cells.select(key).schema[0].dataType.simpleString()

    def one(f: pd.DataFrame) -> pd.DataFrame:
        h, w = int(f["py"].max()) + 1, int(f["px"].max()) + 1
        img = np.zeros((h, w))
        img[f["py"], f["px"]] = f["v"]
        logs = np.log(np.maximum(img, 0.0007))
        high = logs - gaussian(logs, sigma, odd=True)
        kept = (high >= DARK).astype(float)
        weight = gaussian(kept, sigma)
        high = high - np.where(weight > 0.05, gaussian(high * kept, sigma) / np.maximum(weight, 0.05), 0)
        fine = np.sort(_tiles(np.abs(high - gaussian(high, 1.5, odd=True)), TILE), axis=2)  # NaN last
        middle = (~np.isnan(fine)).sum(axis=2, keepdims=True) // 2
        texture = 1.4826 * np.take_along_axis(fine, middle, axis=2)[:, :, 0]
        limit = np.maximum(GRAINS * _grain(texture, np.nanmean(_tiles(logs, TILE), axis=2), np.ones_like(texture, bool)), TEXTURE)
        y, x = (v.ravel() for v in np.indices((h, w)))
        at = (x + 0.5) / TILE - 0.5, (y + 0.5) / TILE - 0.5
        smooth = (img.ravel() >= 0.0007) & (img.ravel() < 0.97) & (bilinear(texture, *at) <= bilinear(limit, *at))
        value = np.clip(np.round(high.ravel() * 2048), -16383, 16383) / 2048
        return pd.DataFrame({key: f[key].iloc[0], "y": y, "x": x, "value": value, "smooth": smooth})

    return cells.groupBy(key).applyInPandas(one, f"`{key}` {kind}, y int, x int, value double, smooth boolean")


def plane_levels(values: np.ndarray, mask: np.ndarray, sigma: float) -> np.ndarray:
    """The level at each cell of the plane through the masked cells around it, with Gaussian weights; NaN where they carry
    less than a fiftieth of the weight or don't spread enough in both directions to fix a plane."""
    r = math.ceil(3 * sigma)
    d = np.arange(-r, r + 1)
    k = np.exp(-0.5 * (d / sigma) ** 2)
    k /= k.sum()

    def moment(img: np.ndarray, *orders: int) -> np.ndarray:
        for axis, order in enumerate(orders):
            wide = np.pad(img, [(r, r) if a == axis else (0, 0) for a in (0, 1)])
            img = sum(w * np.take(wide, range(i, i + img.shape[axis]), axis=axis) for i, w in enumerate(k * d**order))
        return img

    middle = values[mask].mean() if mask.any() else 0.0
    powers = [(0, 0), (0, 1), (1, 0)]
    ones, signal = mask.astype(float), np.where(mask, values - middle, 0.0)
    seen: dict[tuple[int, int], np.ndarray] = {}
    normal = np.empty((*mask.shape, 3, 3))
    for i, a in enumerate(powers):
        for j, b in enumerate(powers):
            order = (a[0] + b[0], a[1] + b[1])
            if order not in seen:
                seen[order] = moment(ones, *order)
            normal[..., i, j] = seen[order]
    s = np.maximum(seen[0, 0], 1e-12)
    mx, my = seen[0, 1] / s, seen[1, 0] / s
    extent = (seen[0, 2] / s - mx * mx) * (seen[2, 0] / s - my * my) - (seen[1, 1] / s - mx * my) ** 2
    fixed = (seen[0, 0] > 0.02) & (extent > (0.15 * sigma * sigma) ** 2)
    out = np.full(mask.shape, np.nan)
    if fixed.any():
        right = np.stack([moment(signal, *a) for a in powers], axis=-1)[fixed]
        out[fixed] = np.linalg.solve(normal[fixed], right[..., None])[:, 0, 0] + middle
    return out


def thickness(mask: np.ndarray, most: int) -> int:
    """How many erosions by the four neighbours empty a mask, at most `most`; what lies beyond its border is outside."""
    depth = 0
    while depth < most and mask.any():
        wide = np.pad(mask, 1)
        mask = mask & wide[:-2, 1:-1] & wide[2:, 1:-1] & wide[1:-1, :-2] & wide[1:-1, 2:]
        depth += 1
    return depth


def _tiles(img: np.ndarray, side: int) -> np.ndarray:
    """`(rows, columns, side * side)` of an image; NaN where tiles reach beyond it."""
    h, w = (-(-n // side) * side for n in img.shape)
    wide = np.full((h, w), np.nan)
    wide[: img.shape[0], : img.shape[1]] = img
    return wide.reshape(h // side, side, w // side, side).swapaxes(1, 2).reshape(h // side, w // side, side * side)


#: Broad levels: cells a side, background's width, largest step from it in the background, tolerated range in grains and at least.
BROAD, BROAD_SIGMA, BROAD_BOUND, BROAD_GRAINS, BROAD_RANGE = 4, 12.0, 0.006, 3.0, 0.03


def broad_levels(cells: DataFrame, residuals: DataFrame, key: str = "frame") -> DataFrame:
    """Levels of `BROAD` x `BROAD` preview cells: `key, y, x, level` (log of the mean), `value` (level over a plane of the smooth cells around
    it, in steps of 1/2048; 0 where none can be fixed), `smooth`. `cells` is a preview, `residuals` that of the same frames.

    A cell is smooth where three quarters of its preview cells are, and their range about their own plane isn't beyond grain. The
    background is fitted three times, twice without what is off the one before. Preview cells that are missing aren't smooth."""
    kind = cells.select(key).schema[0].dataType.simpleString()

    def one(f: pd.DataFrame) -> pd.DataFrame:
        h, w = int(f["py"].max()) + 1, int(f["px"].max()) + 1
        img, flag = np.full((h, w), 0.0007), np.zeros((h, w))
        img[f["py"], f["px"]], flag[f["py"], f["px"]] = f["v"], f["smooth"]
        v, flags = _tiles(img, BROAD), _tiles(flag, BROAD)
        here = ~np.isnan(v)
        n = here.sum(axis=2)
        logs = np.log(np.maximum(v, 0.0007))
        flat = logs - np.nanmean(logs, axis=2, keepdims=True)
        for at in np.indices((h, w)).astype(float):
            c = _tiles(at, BROAD)
            c -= np.nanmean(c, axis=2, keepdims=True)
            square = np.nansum(c * c, axis=2)
            # Rows and columns of a cell are orthogonal, so that one slope doesn't change the other.
            flat = flat - c * (np.nansum(c * logs, axis=2) / np.where(square > 0, square, 1))[..., None]
        span = np.nanmax(flat, axis=2) - np.nanmin(flat, axis=2)
        level = np.log(np.maximum(np.nanmean(v, axis=2), 0.0007))
        share = np.nansum(flags, axis=2) / n
        smooth = (share >= 0.75) & (span <= np.maximum(BROAD_GRAINS * _grain(span, level, share == 1), BROAD_RANGE))
        base = plane_levels(level, smooth, BROAD_SIGMA)
        for _ in range(2):
            base = plane_levels(level, smooth & (np.abs(level - base) <= BROAD_BOUND), BROAD_SIGMA)
        smooth &= ~np.isnan(base)
        value = np.where(smooth, np.clip(np.round((level - base) * 2048), -16383, 16383) / 2048, 0.0)
        y, x = (i.ravel() for i in np.indices(level.shape))
        return pd.DataFrame({key: f[key].iloc[0], "y": y, "x": x, "level": level.ravel(), "value": value.ravel(), "smooth": smooth.ravel()})

    flags = residuals.select(key, F.col("y").alias("py"), F.col("x").alias("px"), "smooth")
    met = cells.select(key, "py", "px", "v").join(flags, [key, "py", "px"], "left").withColumn("smooth", F.coalesce("smooth", F.lit(False)))
    return met.groupBy(key).applyInPandas(one, f"`{key}` {kind}, y int, x int, level double, value double, smooth boolean")


#: Regions: margin of their window, cells of one in residual maps and in broad levels.
MARGIN, AREA, BROAD_AREA = 12, (3, 1000), (30, 4000)
REGION = "region int, cells int, x double, y double, depth double, noise double, left int, top int, width int, height int, median array<double>, near array<boolean>, quiet array<boolean>"


def _grown(mask: np.ndarray, reach: int) -> np.ndarray:
    """Cells within about `reach` of a mask."""
    wide, (h, w) = np.pad(mask, reach), mask.shape
    steps = [(j, i) for j in range(-reach, reach + 1) for i in range(-reach, reach + 1) if j * j + i * i <= reach * reach + 1]
    return np.logical_or.reduce([wide[reach + j : reach + j + h, reach + i : reach + i + w] for j, i in steps])


def _disc_like(core: np.ndarray, across: int, down: int) -> bool:
    """Whether a region fills its box as a disc does; what views share of scenery leaves bands and wisps."""
    thin, long = sorted((across, down))
    return core.sum() >= 0.55 * across * down and thickness(core, max(core.shape)) >= 0.3 * thin and long <= 2 * thin


def regions(stack: DataFrame, seed: tuple[float, float] = (-0.008, -6.0), grow: tuple[float, float] = (-0.004, -3.0), broad: bool = False) -> DataFrame:
    """Dark regions of stacks on flat surroundings: cells beyond `grow` (as median, and median over its error) that are connected
    over 8 neighbours with a cell beyond `seed`, each seen by `MIN_VIEWS` frames. Columns `target, set` and `REGION`: place, depth,
    noise of the surroundings, and the window with its median (0 where unseen), the region's vicinity and its quiet cells, row by row.

    Left out are regions beyond `AREA` or at the edge of what the stack has seen, thick ones (with `broad`: beyond `BROAD_AREA`, and those
    unlike discs), and those with noisy or too few surroundings."""
    kind = {f.name: f.dataType.simpleString() for f in stack.schema}
    least, most = BROAD_AREA if broad else AREA

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f[f["n"] >= MIN_VIEWS]
        h, w = (int(f[c].max()) + 1 if len(f) else 0 for c in ("y", "x"))
        median, seen, open_, seeds = np.zeros((h, w)), *(np.zeros((h, w), bool) for _ in range(3))
        score = f["median"] / (np.maximum(f["spread"], 0.002) / np.sqrt(f["n"]))
        median[f["y"], f["x"]], seen[f["y"], f["x"]] = f["median"], True
        open_[f["y"], f["x"]] = (f["median"] < grow[0]) & (score < grow[1])
        seeds[f["y"], f["x"]] = (f["median"] < seed[0]) & (score < seed[1])
        out: list[tuple] = []
        for y, x in zip(*np.nonzero(seeds & open_), strict=True):
            if not open_[y, x]:
                continue
            own = np.array(reached(open_, int(y), int(x)))
            (top, left), (bottom, right) = own.min(axis=0), own.max(axis=0)
            if not least <= len(own) <= most or min(top, left) < 2 or right + 3 > w or bottom + 3 > h:
                continue
            y0, x0 = max(top - MARGIN, 0), max(left - MARGIN, 0)
            window = np.s_[y0 : bottom + MARGIN + 1, x0 : right + MARGIN + 1]
            m, core = median[window], np.zeros_like(seen[window])
            core[own[:, 0] - y0, own[:, 1] - x0] = True
            if not (_disc_like(core, right - left + 1, bottom - top + 1) if broad else thickness(core, 7) <= 6):
                continue
            near = _grown(core, 2)
            around = np.sort(m[~near & seen[window]])
            if len(around) < 8:
                continue
            low, high = around[(len(around) - 1) // 2], around[len(around) // 2]
            noise = 1.4826 * np.sort(np.abs(around - (low if abs(low) <= abs(high) else high)))[(len(around) - 1) // 2]
            depth = median[own[:, 0], own[:, 1]]
            quiet = ~_grown(core, 5) & (np.abs(m) <= max(3 * noise, 0.006))
            if noise > max(0.004, min(-0.2 * depth.min(), 0.012)) or quiet.sum() < 16:
                continue
            cy, cx = (own * depth[:, None]).sum(axis=0) / depth.sum()
            out.append((len(out), len(own), cx, cy, depth.min(), noise, x0, y0, m.shape[1], m.shape[0], m.ravel().tolist(), near.ravel().tolist(), quiet.ravel().tolist()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in REGION.split(", ")])

    def keyed(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        got = one(f)
        got.insert(0, "set", key[1])
        got.insert(0, "target", key[0])
        return got

    return stack.groupBy("target", "set").applyInPandas(keyed, f"target {kind['target']}, set int, {REGION}")


def contrasts(found: DataFrame, residuals: DataFrame, least: int = 5) -> DataFrame:
    """How deep frames show the shadows of a stack, next to the stack: `target, set, frame, contrast, regions`. `contrast` is the (upper)
    median slope of a frame's values over the shadows (medians below 0 in a region's vicinity, 0 elsewhere in its window) of
    regions that are deep and whose quiet cells are smooth there by nine tenths; frames with fewer than `least` such regions have no row."""
    place = F.posexplode(F.arrays_zip("median", "near", "quiet"))
    cells = found.where("depth <= -0.015").select("target", "set", "region", "left", "top", "width", place.alias("i", "c"))
    cells = cells.select(
        "target", "set", "region", (F.col("top") + F.floor(F.col("i") / F.col("width"))).cast("int").alias("y"), (F.col("left") + F.col("i") % F.col("width")).alias("x"),
        F.when(F.col("c.near"), F.least("c.median", F.lit(0.0))).otherwise(0.0).alias("shadow"), F.col("c.quiet").alias("quiet"),
    )
    seen = cells.join(residuals.select("frame", "y", "x", "value", "smooth"), ["y", "x"]).groupBy("target", "set", "region", "frame").agg(
        F.coalesce(F.regr_slope("value", "shadow"), F.lit(0.0)).alias("slope"), F.count_if("quiet").alias("ring"), F.count_if(F.col("quiet") & F.col("smooth")).alias("flat")
    )
    met = seen.where("flat * 10 >= ring * 9").groupBy("target", "set", "frame").agg(F.array_sort(F.collect_list("slope")).alias("s"))
    return met.where(F.size("s") >= least).select("target", "set", "frame", F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("contrast"), F.size("s").alias("regions"))


def alike(contrast: DataFrame, views: int = STACK) -> DataFrame:
    """`target, frame`: the `views` frames (nearest first by id) that show shadows about as deep as their target does, judged by a target's set
    with the most regions; none where the target itself shows them by a fifth or less."""
    own = contrast.where("frame = target and contrast > 0.2").groupBy("target").agg(F.max_by(F.struct("set", "contrast"), F.struct("regions", -F.col("set"))).alias("own"))
    met = contrast.join(own, "target").where((F.col("set") == F.col("own.set")) & (F.col("frame") != F.col("target")) & (F.col("contrast") / F.col("own.contrast")).between(0.7, 1.43))
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.abs(F.col("frame") - F.col("target")), "frame"))
    return met.withColumn("_place", rank).where(F.col("_place") <= views).select("target", "frame")


def uncovered(found: DataFrame, patches: DataFrame, key: str = "frame", widths: float = 3.5, block: float = 64.0) -> DataFrame:
    """Places `x, y` without a patch (`x, y, sigma`) of their `key` within `widths` of its widths: a spatial anti-join, by blocks
    that each patch is given for all that it reaches."""
    names = found.columns
    near = lambda c, r: F.sequence(F.floor((F.col(c) - r) / block).cast("long"), F.floor((F.col(c) + r) / block).cast("long"))
    reach = widths * F.col("sigma")
    p = patches.select(F.col(key).alias("_k"), F.col("x").alias("_cx"), F.col("y").alias("_cy"), reach.alias("_reach"), F.explode(near("x", reach)).alias("_bx"), near("y", reach).alias("_by"))
    p = p.withColumn("_by", F.explode("_by"))
    at = found.withColumns({"_fx": F.floor(F.col("x") / block).cast("long"), "_fy": F.floor(F.col("y") / block).cast("long")})
    met = (at[key] == p["_k"]) & (at["_fx"] == p["_bx"]) & (at["_fy"] == p["_by"]) & (F.hypot(F.col("_cx") - at["x"], F.col("_cy") - at["y"]) <= F.col("_reach"))
    return at.join(p, met, "left_anti").select(*names)


def overlap(found: DataFrame, patches: DataFrame, key: str = "frame", widths: float = 3.5) -> DataFrame:
    """How many of the places of each `key` and `region` a patch covers: `key, region, cells, covered`."""
    rest = uncovered(found, patches, key, widths).groupBy(key, "region").agg(F.count("*").alias("rest"))
    every = found.groupBy(key, "region").agg(F.count("*").alias("cells"))
    return every.join(rest, [key, "region"], "left").select(key, "region", "cells", (F.col("cells") - F.coalesce("rest", F.lit(0))).alias("covered"))
