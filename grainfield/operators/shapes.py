"""Irregular dips: dark shapes of any outline, enclosed by a plain background, and their match with compact spots.

A support (a disc or a rectangle, by its two radii) is judged by its rim alone: a quadratic through the rim is the background, what
lies below it is the shape. Many supports are judged in one NumPy call; a frame's preview is one Arrow group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .defects import GRID_H, GRID_W, MAX_FIT_ERROR, MAX_LOG_GAIN, PATCH_SIDE, SIGMAS, bilinear, candidates_of, darkness, peaks_of, reached, smoothed

#: Widest support, scales at which regions are proposed, and the extents in cells that a region may have.
WIDEST, PROPOSED, EXTENTS = 18.0, (1.2, 5.0), (8, 90)


class _Support:
    """Points at half steps over [-4, 4] in both directions, within a disc or a square, with the rim's least squares."""

    def __init__(self, square: bool) -> None:
        y, x = (v.ravel() for v in np.mgrid[-4:4.5:0.5, -4:4.5:0.5])
        inside = np.maximum(abs(x), abs(y)) <= 4 if square else np.hypot(x, y) <= 4
        self.x, self.y = x[inside], y[inside]
        self.rim = np.maximum(abs(self.x), abs(self.y)) >= 3.5 if square else np.hypot(self.x, self.y) >= 2.5
        self.quad = np.stack(_powers(self.x, self.y), axis=1)
        self.solve = np.linalg.pinv(self.quad[self.rim])


def _powers(u, v) -> list:
    return [np.ones_like(u), u, v, u * u, u * v, v * v]


SUPPORTS = {square: _Support(square) for square in (False, True)}


#: No support.
NONE = pd.DataFrame({c: [] for c in ("x", "y", "rx", "ry", "amplitude", "rms", "ring", "back", "square")})


def enclosed(img: np.ndarray, x, y, rx, ry, square: bool) -> pd.DataFrame:
    """The supports around (x, y) with radii rx, ry (a unit of the grid; the support is four of them) that enclose a dark
    shape, in their order: `x, y, rx, ry, amplitude, rms, ring, back`. Their rim has to be plain, nothing in them much brighter than
    the background, and at least four points clearly darker."""
    x, y, rx, ry = (np.asarray(v, float).ravel() for v in np.broadcast_arrays(x, y, rx, ry))
    g, (h, w) = SUPPORTS[square], img.shape
    fits = (x >= 4 * rx) & (y >= 4 * ry) & (x + 4 * rx < w) & (y + 4 * ry < h)
    x, y, rx, ry = x[fits], y[fits], rx[fits], ry[fits]
    if not len(x):
        return NONE
    seen = bilinear(img, x[:, None] + rx[:, None] * g.x, y[:, None] + ry[:, None] * g.y)
    plain = ((seen >= 0.0007) & (seen < 0.97)).all(axis=1)
    logs = np.log(np.maximum(seen, 0.0007))
    back = logs[:, g.rim] @ g.solve.T
    shadow = back @ g.quad.T - logs
    amplitude = shadow.max(axis=1, initial=0)
    ring = np.sqrt((shadow[:, g.rim] ** 2).mean(axis=1))
    bright = np.sqrt((np.minimum(shadow, 0) ** 2).mean(axis=1))
    least = np.maximum(4 * ring, 0.004)
    fine = (
        plain & (amplitude >= 0.02) & (amplitude < MAX_LOG_GAIN) & (ring < np.minimum(MAX_FIT_ERROR, 0.1 * amplitude)) & (bright <= 1.5 * np.maximum(ring, 0.0005))
        & (shadow[:, g.rim].max(axis=1, initial=0) <= least) & ((shadow > np.maximum(least, 0.15 * amplitude)[:, None]).sum(axis=1) >= 4)
    )
    if not fine.any():
        return NONE
    columns = {"x": x, "y": y, "rx": rx, "ry": ry, "amplitude": amplitude, "rms": np.maximum(ring, bright), "ring": ring}
    return pd.DataFrame({k: v[fine] for k, v in columns.items()} | {"back": list(back[fine]), "square": square})


def _quality(fits: pd.DataFrame) -> pd.Series:
    return fits["amplitude"] / np.maximum(fits["rms"], 0.001)


def proposals(score: np.ndarray, peaks: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (left, top, width, height) of the regions above a quarter of a peak, each cell in the region of the first peak that
    reaches it. Regions of under four cells, or of other extents than `EXTENTS`, are left out."""
    free, out = np.ones(score.shape, bool), []
    for v, y, x in peaks:
        y, x = int(y), int(x)
        if not free[y, x]:
            continue
        before = free & (score > max(0.25 * v, 0.002))
        before[y, x] = True
        at = np.array(reached(before, y, x))
        free[at[:, 0], at[:, 1]] = False
        (top, left), (height, width) = at.min(axis=0), np.ptp(at, axis=0) + 1
        if len(at) >= 4 and EXTENTS[0] <= max(height, width) <= EXTENTS[1]:
            out.append((int(left), int(top), int(width), int(height)))
    return out


def _around(img: np.ndarray, box: tuple[int, int, int, int]) -> list[pd.DataFrame]:
    """Supports of a region: the first rectangle, by shift and padding, that encloses it, and the best disc or ellipse of the smallest size."""
    left, top, width, height = box
    cx, cy, extent = left + (width - 1) / 2, top + (height - 1) / 2, max(width, height)
    shifts = sorted(((dx, dy) for dx in (-0.5, 0, 0.5) for dy in (-0.5, 0, 0.5)), key=lambda s: (abs(s[0]) + abs(s[1]), s[1] != 0, s))
    pads = np.arange(4, 12.5, 0.5)
    dx, dy = np.repeat(np.array(shifts), len(pads), axis=0).T
    pad = np.tile(pads, len(shifts))
    out = [enclosed(img, cx + dx, cy + dy, (width + 2 * pad) / 8, (height + 2 * pad) / 8, True)[:1]]
    own = (max(width / extent, 0.35), max(height / extent, 0.35))
    axes, off = np.array([own, (1, 0.5), (0.5, 1), (1, 1)]), np.array([(u, v) for u in (0, -0.75, 0.75) for v in (0, -0.75, 0.75)])
    size, most = extent / 4, min(extent / 2, WIDEST)
    while size <= most:
        r = size * axes[:, None, :] + 0 * off
        at = np.array([cx, cy]) + off * r
        found = enclosed(img, at[..., 0], at[..., 1], r[..., 0], r[..., 1], False)
        if len(found):
            out.append(found.loc[[_quality(found).idxmax()]])
            break
        size = min(size * 1.125, most) if size < most else math.inf
    return out


def _refined(img: np.ndarray, fit: pd.Series) -> pd.Series:
    """A search over place and size around a support, in steps that get smaller."""
    for f in (0.1, 0.05, 0.025):
        x, y = fit["x"] + 5 * f * np.array([-1, 1, 0, 0, 0, 0]), fit["y"] + 5 * f * np.array([0, 0, -1, 1, 0, 0])
        grow = 1 + f * np.array([0, 0, 0, 0, -1, 1])
        found = enclosed(img, x, y, fit["rx"] * grow, fit["ry"] * grow, bool(fit["square"]))
        if len(found) and _quality(found).max() > _quality(fit.to_frame().T).iloc[0]:
            fit = found.loc[_quality(found).idxmax()]
    return fit


def _patch(img: np.ndarray, fit: pd.Series) -> dict:
    """Log gain of a shape on a square grid, kept where it is connected with the shape's middle, and half a step beyond."""
    size, reach = max(fit["rx"], fit["ry"]), 4.0 if fit["square"] else 3.5
    side = max(PATCH_SIDE, math.ceil(4 * reach * size) + 1)
    at = np.linspace(-reach * size, reach * size, side)
    dy, dx = np.meshgrid(at, at, indexing="ij")
    u, v = dx / fit["rx"], dy / fit["ry"]
    back = sum(c * b for c, b in zip(fit["back"], _powers(u, v), strict=True))
    seen = smoothed(img, fit["x"] + dx, fit["y"] + dy, min(0.2 * size, 0.5))
    taper = np.clip(reach - (np.maximum(abs(u), abs(v)) if fit["square"] else np.hypot(u, v)), 0, 1)
    gain = np.clip(back - np.log(np.maximum(seen, 0.0007)) - 0.5 * fit["ring"], 0, min(2 * fit["amplitude"], MAX_LOG_GAIN)) * taper * taper * (3 - 2 * taper)
    dark = gain > max(3 * fit["ring"], 0.05 * fit["amplitude"])
    weight = np.zeros_like(gain)
    if dark.any():
        ys, xs = np.nonzero(dark)
        first = np.argmin((ys - side // 2) ** 2 + (xs - side // 2) ** 2)
        own = np.array(reached(dark.copy(), int(ys[first]), int(xs[first])))
        for share, r in ((0.5, 2), (1.0, 1)):
            for j in range(-r, r + 1):
                for i in range(-r, r + 1):
                    y, x = np.clip(own[:, 0] + j, 0, side - 1), np.clip(own[:, 1] + i, 0, side - 1)
                    weight[y, x] = np.maximum(weight[y, x], share)
    return {"left": fit["x"] + at[0], "top": fit["y"] + at[0], "spacing": at[1] - at[0], "side": side, "gain": gain * weight}


def shapes_of(img: np.ndarray, most: int = 400) -> list[dict]:
    """Irregular dips of a preview, the best enclosed first. A shape whose gain lies by more than four fifths within three widths of
    compact dips or of better shapes isn't new. Compact dips and shapes together are `most` at most, compact ones first."""
    h, w = img.shape
    found: list[pd.DataFrame] = []
    for sigma in SIGMAS:
        score = darkness(img, sigma)
        peaks = peaks_of(score, sigma)
        tile = pd.Series((peaks[:, 1] * GRID_H // h) * GRID_W + peaks[:, 2] * GRID_W // w, dtype=float)
        peaks = peaks[((np.arange(len(peaks)) < 800) | (tile.groupby(tile).cumcount() < 16)).to_numpy(bool)] if len(peaks) else peaks
        if sigma in PROPOSED:
            found += [s for box in proposals(score, peaks) for s in _around(img, box)]
        left, size = peaks, sigma
        while len(left):  # the smallest support of each peak
            got = enclosed(img, left[:, 2], left[:, 1], size, size, False)
            found.append(got)
            done = set(zip(got["x"], got["y"], strict=True))
            left = left[[(x, y) not in done for _, y, x in left]] if size < WIDEST else left[:0]
            size = min(2 * size, WIDEST)
    found = [f for f in found if len(f)]
    if not found:
        return []
    every = pd.concat(found, ignore_index=True)
    every["q"] = -_quality(every)
    taken = [(c["x"], c["y"], c["sigma"]) for c in candidates_of(img, most)]
    out: list[dict] = []
    for _, start in every.sort_values(["q", "y", "x", "rx", "ry", "square"], kind="stable").iterrows():
        if len(taken) >= most:
            break
        fit = _refined(img, start)
        p = _patch(img, fit)
        gain = np.where(p["gain"] > 0.1 * p["gain"].max(), p["gain"], 0)
        j, i = np.nonzero(gain)
        g, x, y = gain[j, i], p["left"] + i * p["spacing"], p["top"] + j * p["spacing"]
        free = np.ones(len(g), bool)
        for cx, cy, s in taken:
            free &= np.hypot(x - cx, y - cy) > 3 * s
        if not len(g) or g[free].sum() < 0.2 * g.sum():
            continue
        size = max(fit["rx"], fit["ry"])
        cx, cy = (x * g).sum() / g.sum(), (y * g).sum() / g.sum()
        taken.append((cx, cy, size))
        out.append({"x": cx, "y": cy, "sigma": size, "amplitude": fit["amplitude"], "fit_error": fit["rms"], "square": bool(fit["square"]), **p, "gain": p["gain"].ravel().tolist()})
    return out


SHAPE = "x double, y double, sigma double, amplitude double, fit_error double, square boolean, left double, top double, spacing double, side int, gain array<double>"


def shapes(cells: DataFrame, key: str = "frame") -> DataFrame:
    """Irregular dips of each frame from its preview cells (`py, px, v`): the gain's middle, size and fit, and its log gain on a grid
    of `side` x `side` points from (`left`, `top`) in steps of `spacing`, in preview cells."""
    kind = cells.select(key).schema[0].dataType.simpleString()

    def one(f: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((int(f["py"].max()) + 1, int(f["px"].max()) + 1))
        img[f["py"], f["px"]] = f["v"]
        got = pd.DataFrame(shapes_of(img), columns=[c.split()[0] for c in SHAPE.split(", ")])
        got.insert(0, key, f[key].iloc[0])
        return got

    return cells.groupBy(key).applyInPandas(one, f"`{key}` {kind}, {SHAPE}")


def sharpened(spot: str = "spot", shape: str = "shape") -> Column:
    """Whether a shape may be a compact spot seen sharper: all of its gain above a tenth of the most is near the spot, its middle is the
    spot's, and it takes no more than three times the spot's light. `spot` has `x, y, sigma, depth`, `shape` the columns of `shapes`."""
    s, p = (lambda c: F.col(f"{spot}.{c}")), (lambda c: F.col(f"{shape}.{c}"))
    place = F.transform(
        p("gain"),
        lambda g, i: F.struct(g.alias("g"), (p("left") + (i % p("side")) * p("spacing") - s("x")).alias("x"), (p("top") + F.floor(i / p("side")) * p("spacing") - s("y")).alias("y")),
    )
    core = F.filter(place, lambda c: c["g"] > 0.1 * F.array_max(p("gain")))
    total = lambda f: F.aggregate(core, F.lit(0.0), lambda a, c: a + f(c))
    weight = total(lambda c: c["g"])
    middle = F.hypot(total(lambda c: c["g"] * c["x"]), total(lambda c: c["g"] * c["y"])) / weight
    light = F.aggregate(p("gain"), F.lit(0.0), lambda a, g: a + F.greatest(g, F.lit(0.0))) * p("spacing") * p("spacing")
    near = F.forall(core, lambda c: F.hypot(c["x"], c["y"]) <= F.greatest(3 * s("sigma"), s("sigma") + 8))
    return F.coalesce((F.size(core) > 0) & near & (middle <= F.greatest(0.25 * s("sigma"), F.lit(1.5))) & (light <= 3 * F.greatest(s("depth"), F.lit(0.5))), F.lit(False))
