"""Embedding near-dedup: an exact metric range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, spread

#: Angles are compared with this much to spare, so that rounding drops no copy; the cosine itself decides.
SLACK = 1e-7


def _unit(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    # Scaled by the largest component first: squares of huge or tiny ones stay finite and above zero.
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _pivots(classes: DataFrame, n: int, radius: float) -> np.ndarray:
    """At most `n` unit vectors at least 2 * radius apart, taken in the order of a hash of their id from
    a sample of 4 * n (zeros after their last component, to the longest of them)."""
    rows = classes.orderBy(F.xxhash64("id"), "id").limit(4 * n).select("v").collect()
    dim = max((len(r[0]) for r in rows), default=1)
    out: list[np.ndarray] = []
    for x in _unit([r[0] for r in rows], dim):
        if all(np.arccos(np.clip(x @ p, -1, 1)) >= 2 * radius for p in out):
            out.append(x)
        if len(out) == n:
            break
    return np.array(out).reshape(-1, dim)


def _cells(classes: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """A row for each class and cell it takes part in: own (its nearest pivot), and every earlier cell that may
    hold a vector within `radius`.

    If w lies in cell j and within r of v, then d(v, pj) <= d(w, pj) + r <= d(w, pi) + r <= d(v, pi) + 2r. On the
    sphere the same is sharper: the cap of radius r around v must reach the bisector of pi and pj.
    """
    dim = pivots.shape[1]
    gaps = np.maximum(0, 2 - 2 * (pivots @ pivots.T))

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = radius + SLACK
        for batch in them:
            if not len(batch):
                continue
            vs = batch.column("v").to_pylist()
            x = _unit(vs, max(dim, max(map(len, vs))))[:, :dim]
            for at in range(0, len(x), 1024):
                near = x[at : at + 1024] @ pivots.T
                own = near.argmax(axis=1)
                best = near[np.arange(len(own)), own][:, None]
                angle, least = np.arccos(np.clip(near, -1, 1)), np.arccos(np.clip(best, -1, 1))
                diff = best - near
                reach = np.sqrt(np.maximum(0, gaps[own] - diff**2)) * np.sin(r) - np.cos(r) * diff >= -SLACK
                sent = (angle - least <= 2 * r) & reach & (np.arange(near.shape[1]) < own[:, None])
                sent[np.arange(len(own)), own] = True
                i, cell = np.nonzero(sent)
                got = batch.slice(at, 1024).take(pa.array(i))
                yield pa.RecordBatch.from_arrays(
                    [*got.columns, pa.array(cell, pa.int32()), pa.array(own[i] == cell)], names=["label", "id", "m", "v", "cell", "own"]
                )

    return classes.select("label", "id", "m", "v").mapInArrow(batches, "label string, id long, m long, v array<double>, cell int, own boolean")


def _linked(limit: float):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        base = rows["base"].to_numpy()
        dim = max(map(len, rows["v"]))
        x, ids, m = _unit(list(rows["v"]), dim), rows["id"].to_numpy(), rows["m"].to_numpy()
        size = rows["v"].map(len).to_numpy()
        b, p = np.nonzero(base)[0], np.nonzero(~base)[0]
        within = bool(rows["inner"].iloc[0])
        other = np.concatenate([b, p]) if within else p
        links, low = np.zeros(len(rows), np.int64), ids.copy()
        hit = (x[b] @ x[other].T >= limit) & (size[b][:, None] == size[other])
        if within:
            hit[np.arange(len(b)), np.arange(len(b))] = False
        links[b] += hit @ m[other]
        links[p] += m[b] @ hit[:, len(other) - len(p) :]
        most = np.iinfo(np.int64).max
        while len(b) and len(other):  # the smallest id of each component within the block
            before = low.copy()
            low[b] = np.minimum(low[b], np.where(hit, low[other], most).min(axis=1))
            low[other] = np.minimum(low[other], np.where(hit, low[b][:, None], most).min(axis=0))
            if (low == before).all():
                break
        return pd.DataFrame({"id": ids, "links": links, "low": low})

    return block


def near_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, block: int = 2048, pivots: int | None = None
) -> DataFrame:
    """One row per row of `rows`: `vec_id`, `n_links` (other rows linked directly), `component_id` (smallest id
    reachable by links, its own included; long), `kept` (vec_id = component_id).

    Rows of one label that isn't null are linked at a cosine of `cosine` (above 0) or more, in double precision. A vector
    that is null, empty or zero, or has a null or non-finite component, has no link; nor have vectors of different
    lengths. Rows with one id are counted one by one and share a component where one of them is linked. A null id
    has no link, a null component and is kept. An empty table gives an empty one. Other columns are not read.

    Equal vectors are one class that counts its rows. Each class belongs to the cell of its nearest pivot (at most
    512, from a sample of four times as many) and is copied to earlier cells within reach. Cells join apart, in
    blocks of about `block` vectors a side, so that no cell has to fit a task. A block returns for each
    vector its links and the smallest id connected to it there, not the pairs.
    """
    radius = acos(cosine)
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    src = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size("v") > 0) & ~bad & F.exists(v, lambda x: x != 0)
    src = src.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit(1), "label", "v")})
    classes = cut(src.where("fine").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("v").alias("v")))
    n = classes.count()
    if not n:
        return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(vec_id).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    parts = cut(_cells(classes, _pivots(classes, pivots or min(512, max(8, ceil(sqrt(n / 32)))), radius), radius))

    # Blocks of a cell: its own vectors by s, all that meet them by q.
    cell = ["label", "cell"]
    sizes = parts.groupBy(*cell).agg(F.ceil(F.count_if("own") / block).cast("int").alias("ns"), F.ceil(F.count("*") / block).cast("int").alias("nq")).where("ns > 0")
    placed = parts.join(spread(sizes), cell).withColumns({"s0": F.pmod(F.xxhash64("id"), "ns").cast("int"), "q0": F.pmod(F.xxhash64("id", F.lit(1)), "nq").cast("int")})
    as_base = placed.where("own").select(*cell, F.col("s0").alias("s"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"), "id", "m", "v", F.lit(True).alias("base"))
    last = F.when(F.col("own"), F.col("s0")).otherwise(F.col("ns"))
    as_probe = placed.where(last > 0).select(*cell, F.explode(F.sequence(F.lit(0), last - 1)).alias("s"), F.col("q0").alias("q"), "id", "m", "v", F.lit(False).alias("base"))
    met = as_base.unionByName(as_probe).withColumn("inner", F.col("q") == 0)
    got = met.groupBy(*cell, "s", "q").applyInPandas(_linked(cosine), "id long, links long, low long")
    got = cut(got.groupBy("id", "low").agg(F.sum("links").alias("links")))
    links = got.groupBy("id").agg(F.sum("links").alias("links"))
    tied = src.where("fine").select("id", "h1", "h2").join(spread(classes.select("h1", "h2", F.col("id").alias("b"))), ["h1", "h2"]).where("id != b").select(F.col("id").alias("a"), "b")
    comp = cut(components(got.where("id != low").select(F.col("id").alias("a"), F.col("low").alias("b")).unionByName(tied)))
    named = classes.select("h1", "h2", "id", "m").join(links, "id", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = src.select("id", "h1", "h2", "fine").join(spread(named).withColumn("fine", F.lit(True)), ["h1", "h2", "fine"], "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")).join(comp, "id", "left")
    out = out.select(F.col("id").alias("vec_id"), "n_links", F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
