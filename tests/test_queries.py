"""Each query with SQL gives the rows of its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from grainfield import queries
from grainfield.params import Parameters
from grainfield.sources import sinks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, them):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(None if r[i] is None else repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in them], key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    got = queries.QUERIES[name](spark, SF)
    want = sql.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


# Queries that SQL can't express, held against models in NumPy.


def events():
    got = duckdb.sql(f"select event_id // 100 as y, event_id % 100 as x, cast(round(value * 100) as int) as code from '{SF}/events.parquet'").df()
    return got


def test_noise_model(spark):
    row = queries.q_noise_model(spark, SF).first()
    assert row.patches_examined == 0 and row.dark_sigma is None and not row.resolved  # ten rows hold no patch


def srgb(x):
    return np.where(x <= 0.0031308, 12.92 * x, 1.055 * np.power(np.maximum(x, 1e-300), 1 / 2.4) - 0.055)


def linear(v):
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def model_curve(codes):
    """Range, exposure, curve and table of one frame, with the defaults and without noise."""
    codes = np.sort(codes)
    n = len(codes)
    lower, upper = float(codes[min(int(0.01 * n), n - 1)]), float(codes[max(0, n - 1 - int(0.01 * n))])
    at = lambda f: np.clip((codes[int(f * (n - 1))] - lower) / (upper - lower), 0, 1)
    e = 2.0 ** np.minimum(-2 + np.arange(65) / 8, 6)
    expose = lambda x, e: e * x / (1 + (e - 1) * x)
    s, m, t = (srgb(expose(at(f), e)) for f in (0.1, 0.5, 0.9))
    best = e[np.argmin(((m - 0.43) / 0.15) ** 2 + 0.15 * (np.maximum(0.6 - (t - s), 0) / 0.4) ** 2)]
    p = Parameters()
    best *= 2.0**p.tone_exposure_bias
    inner = codes[(codes > lower) & (codes < upper)]
    z = srgb(expose((inner - lower) / (upper - lower), best))
    v = np.bincount(np.minimum((z * 1024).astype(int), 1023), minlength=1024).astype(float)
    for _ in range(p.tone_smoothing_passes):
        w = np.pad(v, 2, mode="edge")
        v = sum(k * w[i : i + 1024] for i, k in enumerate(np.array([1, 4, 6, 4, 1]) / 16))
    weight = p.tone_density_prior + (v / v.mean()) ** p.tone_density_power
    cap = np.full(1024, p.tone_cap_max)
    lo, hi = 0.0, p.tone_solver_upper
    for _ in range(p.tone_solver_iterations):
        middle = (lo + hi) / 2
        lo, hi = (lo, middle) if np.clip(middle * weight, p.tone_slope_min, cap).sum() > 1024 else (middle, hi)
    total = np.cumsum(np.clip((lo + hi) / 2 * weight, p.tone_slope_min, cap)) / 1024
    curve = np.concatenate([[0], (1 - p.tone_contrast_strength) * np.arange(1, 1025) / 1024 + p.tone_contrast_strength * total])
    curve[-1] = 1
    x = np.clip((codes - lower) / (upper - lower), 0, 1)
    position = srgb(expose(x, best)) * 1024
    i = np.minimum(position.astype(int), 1023)
    mapped = linear(curve[i] * (1 - (position - i)) + curve[i + 1] * (position - i))
    mapped = (1 - p.optimize_strength) * x + p.optimize_strength * mapped
    mapped = np.where(x <= 0, 0, np.where(x >= 1, 1, mapped))
    return best, curve, dict(zip(codes.tolist(), np.floor(srgb(mapped) * 65535 + 0.5).astype(int).tolist(), strict=True))


@pytest.fixture(scope="module")
def by_type():
    got = duckdb.sql(f"select event_type, cast(round(value * 100) as int) as code from '{SF}/events.parquet'").df()
    return {k: model_curve(g["code"].to_numpy()) for k, g in got.groupby("event_type")}


def test_tone_curve(spark, by_type):
    got = queries.q_tone_curve(spark, SF).toPandas()
    assert len(got) == 1025 * len(by_type)
    for k, g in got.groupby("frame"):
        best, curve, _ = by_type[k]
        assert g["exposure"].iloc[0] == pytest.approx(best) and np.abs(g.sort_values("i")["v"].to_numpy() - curve).max() < 1e-9


def test_tone_lut_and_png(spark, by_type):
    got = queries.q_tone_lut(spark, SF).toPandas()
    want = np.array([by_type[f][2][c] for f, c in zip(got["frame"], got["code"], strict=True)])
    assert len(got) == 1000 and (np.abs(got["out"] - want) <= 1).all() and (got["out"] == want).mean() > 0.999
    image = sinks.read_png(bytes(queries.q_png(spark, SF).first().png))
    e = events()
    table = model_curve(e["code"].to_numpy())[2]
    assert all(abs(image[y, x] - table[c]) <= 1 for y, x, c in e[["y", "x", "code"]].itertuples(index=False)) and image.size == 1000


def test_denoise_of_a_table(spark):
    got = queries.q_denoise(spark, SF).toPandas()
    want = events().sort_values(["y", "x"])["code"].to_numpy()
    # Without an estimate of the noise nothing changes.
    assert (got.sort_values(["y", "x"])["code"].to_numpy() == want).all() and (got["value"] == got["code"]).all()


def vectors():
    got = duckdb.sql(f"select vec_id, label, embedding from '{SF}/embeddings.parquet' order by vec_id").df()
    return [(int(i), lab, np.array(e, float)) for i, lab, e in got.itertuples(index=False) if e is not None]


def test_distinct_views(spark):
    first, want = {}, {}
    for i, lab, e in vectors():
        seen = first.setdefault(lab, [])
        k = next((n for n, o in enumerate(seen) if np.array_equal(o, e) or float(e @ o) > 0.3), len(seen))
        if k == len(seen):
            seen.append(e)
        want[i] = k
    assert {r.frame: r.view for r in queries.q_distinct_views(spark, SF).collect()} == want


def test_stack_sets(spark):
    them = vectors()
    want = set()
    for i, lab, e in them:
        near = sorted((abs(j - i), j, o) for j, la, o in them if la == lab and j != i and abs(j - i) <= 128 and not (np.array_equal(o, e) or float(o @ e) > 0.985))
        pool = []
        for _, j, o in near:
            if len(pool) < 64 and not any(np.array_equal(o, q) or float(o @ q) > 0.985 for _, q in pool):
                pool.append((j, o))
        ids, known = [j for j, _ in pool], []
        for k, side in enumerate((ids, [j for j in ids if j < i], [j for j in ids if j > i])):
            for half, n in ((0, 24), (1, 12)):
                one = sorted(side[:n])
                if len(one) >= 3 and one not in known:
                    known.append(one)
                    want |= {(i, 2 * k + half, j) for j in one}
    assert {(r.target, r.set, r.frame) for r in queries.q_stack_sets(spark, SF).collect()} == want


def test_planted_dust(spark):
    got = queries.q_candidates(spark, SF).toPandas()
    for k in range(4):
        own = got[got["frame"] == k]
        for x, y in ((90, 75), (130, 45)):
            assert (np.hypot(own["x"] - x, own["y"] - y) < 1.5).sum() == 1
    left = queries.q_residuals(spark, SF).where("frame = 0").toPandas()
    darkest = left.sort_values("value").head(40)
    assert len(left) == 120 * 160 and (np.minimum.reduce([np.hypot(darkest["x"] - x, darkest["y"] - y) for x, y in ((90, 75), (130, 45), (20, 30))]) < 6).all()


def test_broad_levels_and_shapes_of_dust(spark):
    got = queries.q_broad_levels(spark, SF).toPandas()
    assert (got.groupby("frame").size() == 30 * 40).all() and got.loc[~got["smooth"], "value"].eq(0).all() and np.isfinite(got["level"]).all()
    # Compact spots aren't shapes as well: what is left of gain beyond three of their widths is little.
    spots, found = queries.q_candidates(spark, SF).toPandas(), queries.q_shapes(spark, SF).toPandas()
    for s in found.itertuples():
        near = spots[spots["frame"] == s.frame]
        assert (np.hypot(near["x"] - s.x, near["y"] - s.y) > 1.5).all() or s.sigma > 2 * near["sigma"].min()


def test_regions_of_dust(spark):
    got = queries.q_regions(spark, SF).toPandas()
    for x, y in ((90, 75), (130, 45)):
        assert (np.hypot(got["x"] - x, got["y"] - y) < 2).sum() == 1
    assert (got["cells"] >= 3).all() and (got["depth"] < -0.008).all()
    seen = queries.q_contrasts(spark, SF).toPandas()
    assert sorted(seen["frame"]) == list(range(4)) and seen["contrast"].between(0.5, 2).all()


def test_every_query_is_tested():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {f"q_{n}" for n in ("noise_model", "tone_curve", "tone_lut", "png", "denoise", "distinct_views", "stack_sets", "candidates", "residuals", "broad_levels", "shapes", "regions", "contrasts")}


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
