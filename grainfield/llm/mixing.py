"""Mixing sources to target weights: iterative proportional fitting, then sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, others, quoted, spare


def _value(c: str) -> Column:
    """A column's value as a string; null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(quoted(c)).cast("string")), F.lit("null"))


def softened(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares `(value, share)` of a dimension: its token shares to a power below 1."""
    by = cells.groupBy(F.col(dim).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("p"))
    return by.select("value", (F.col("p") / by.agg(F.sum("p")).scalar()).alias("share"))


def _goal(cells: DataFrame, dim: str, given: DataFrame | None, power: float) -> DataFrame:
    """Targets of a dimension: those given, where a row with a null value stands for all values that aren't named, which share
    it like `softened`; without any, `softened`."""
    soft = softened(cells, dim, power)
    if given is None:
        return soft
    named = given.where("value is not null")
    rest = soft.join(named, "value", "left_anti")
    spread_ = given.where("value is null").agg(F.sum("share")).scalar()
    return named.unionByName(rest.select("value", (F.col("share") / rest.agg(F.sum("share")).scalar() * spread_).alias("share"))).where("share is not null")


def _attainable(cells: DataFrame, dim: str, goal: DataFrame, size: float) -> DataFrame:
    """`goal` with shares of `size` that the tokens of `cells` allow: a value whose share is more than its tokens gets these,
    and the others share what is left in their proportions. Only two sums a round come to the driver."""
    by = cut(cells.groupBy(dim).agg(F.sum(F.when(F.col("weight") > 0, F.col("tokens")).otherwise(0)).alias("most")).join(goal, dim))
    scale = size
    while True:
        full = F.col("share") * scale >= F.col("most")
        got = by.agg(F.sum(F.when(full, F.col("most"))).alias("m"), F.sum(F.when(~full, F.col("share"))).alias("s")).first()
        if not got["s"]:
            return by.select(dim, (F.col("most") / size).alias("share"))
        more = (size - (got["m"] or 0)) / got["s"]
        if more <= scale * (1 + 1e-12):
            return by.select(dim, (F.least(F.col("share") * scale, F.col("most")) / size).alias("share"))
        scale = more


#: Cells up to this number are raked in one task, which spares the rounds their jobs; more are shuffled.
SMALL_CELLS = 1 << 18


def _in_one_task(at: DataFrame, goals: dict[str, DataFrame], tolerance: float, most: int, rate: float | None) -> DataFrame:
    """`at` with the `weight` that the rounds of `rake` end with."""
    goal = {d: f"_goal{i}" for i, d in enumerate(goals)}
    whole, names = at, at.columns
    for d, g in goals.items():
        whole = whole.join(g.withColumnRenamed("share", goal[d]), d, "left")

    def rounds(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(them)
        rows = pd.concat(got) if got else pd.DataFrame()
        if rows.empty:
            return
        tokens, w = rows["tokens"].to_numpy(float), rows["weight"].to_numpy(float)
        size, cap = tokens.sum() * (1.0 if rate is None else rate), np.inf if rate is None else tokens
        dims = []
        for d, g in goal.items():
            code, values = pd.factorize(rows[d])
            want = np.zeros(len(values))
            want[code] = rows[g].fillna(0.0).to_numpy(float) * size
            dims.append((code, want))
        for _ in range(most if size else 0):
            before = np.minimum(w, cap)
            for code, want in dims:
                s = np.bincount(code, np.minimum(w, cap), len(want))
                w = w * np.divide(want, s, out=np.zeros(len(want)), where=s > 0)[code]
            some = before > 0
            if not some.any() or np.abs(np.minimum(w, cap)[some] / before[some] - 1).max() < tolerance:
                break
        yield rows[names].assign(weight=w)

    return whole.coalesce(1).mapInPandas(rounds, at.schema)


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-6, most: int = 1000, rate: float | None = None) -> DataFrame:
    """`cells` (a row per combination, with `tokens`) with `weight`: tokens scaled until the shares of each
    dimension's values are its targets'. Values without a target, and targets without a value, count as a share
    of zero and as absent; the other targets are brought to a sum of 1. Targets that no weights can meet end
    after `most` rounds at the last fit; `gap` is the largest difference that is left between a value's share and
    its target, the same in all rows. Only totals, the gap and the largest change come to the driver.

    With `rate`, `cells` are a fit's, and `held` is added: the tokens of a sample of `rate` times all tokens, in no cell
    more than its own. What a cell or a value lacks goes to the others, in proportion to their targets."""
    start = F.col("tokens").cast("double") if rate is None else F.col("weight") * F.lit(rate)
    at = cut(cells.withColumn("weight", start))
    sums = at.agg(F.count("*").alias("n"), F.sum(F.col("tokens").cast("double")).alias("s")).first()
    whole = (sums["s"] or 0.0) * (1.0 if rate is None else rate)
    held = F.col("weight") if rate is None else F.least(F.col("weight"), F.col("tokens").cast("double"))
    goals = {}
    for dim, t in targets.items():
        known = t.join(cells.select(F.col(dim).alias("value")).distinct(), "value", "left_semi")
        goals[dim] = cut(known.select(F.col("value").alias(dim), (F.col("share") / known.agg(F.sum("share")).scalar()).alias("share")))
        if rate is not None and whole:
            goals[dim] = cut(_attainable(at, dim, goals[dim], whole))
    small = sums["n"] <= SMALL_CELLS
    if small:
        at = cut(_in_one_task(at, goals, tolerance, most, rate))
    for _ in range(most if whole and not small else 0):
        step = at.withColumn("before", held)
        for dim, goal in goals.items():
            total = step.groupBy(dim).agg(F.sum(held).alias("s")).join(goal, dim, "left")
            factor = F.when(F.col("s") > 0, F.coalesce("share", F.lit(0.0)) * whole / F.col("s")).otherwise(0.0)
            step = step.join(total.select(dim, factor.alias("f")), dim).withColumn("weight", F.col("weight") * F.col("f")).drop("f")
        step = cut(step)
        change = step.where("before > 0").agg(F.max(F.abs(held / F.col("before") - 1))).first()[0]
        at = step.drop("before")
        if (change or 0) < tolerance:
            break
    gap = 0.0
    for dim, goal in goals.items() if whole else ():
        got = at.groupBy(dim).agg((F.sum(held) / F.lit(whole)).alias("got")).join(goal, dim, "full")
        gap = max(gap, got.agg(F.max(F.abs(F.coalesce("got", F.lit(0.0)) - F.coalesce("share", F.lit(0.0))))).first()[0] or 0.0)
    at = at.withColumn("gap", F.lit(gap))
    return at if rate is None else at.withColumn("held", held)


def mixed(docs: DataFrame, dims: list[str], tokens: str, targets: dict[str, DataFrame] | None = None, power: float = 0.8, doc_id: str = "doc_id", seed: int = 1, rate: float | None = None) -> DataFrame:
    """`docs` with `weight`, `probability`, `gap` (double) and `selected` (boolean) added, replacing columns so called, in
    upper or lower case.

    Token weights of the cells of `dims` are raked to `targets` (by dimension `(value, share)`; values as strings after
    a "=", or "null", and a null value for all that aren't named), for dimensions without them to token shares to the `power`. weight is the
    factor on a document's tokens. gap is the largest difference between a share in the sample's expectation and its attainable target.
    probability is that of a sample of `rate` times all tokens (above 0, at most 1), raked to the same targets with no
    document taken more than once: cells that are too small for their share are kept whole, and the others
    make up for them, so that no cell's weight sets the size of the sample. By default `rate` is what input and raked
    tokens have in common, cell by cell; a lower rate comes nearer to the targets. The draw is a hash of id and `seed`: the
    same at every run, and rows with one id, or with none, share it. Null values are a value of their own; null, zero
    or negative tokens count as 1. An empty table gives an empty one.
    """
    made = ["weight", "probability", "gap", "selected"]
    rest = others(docs, *made)
    n = F.greatest(F.coalesce(F.col(quoted(tokens)).cast("long"), F.lit(1)), F.lit(1))
    keys = {spare(docs, f"_d{i}"): d for i, d in enumerate(dims)}
    base = docs.select(*[F.col(quoted(c)) for c in rest], *[_value(d).alias(k) for k, d in keys.items()])
    cells = cut(docs.select(*[_value(d).alias(k) for k, d in keys.items()], n.alias("tokens")).groupBy(*keys).agg(F.sum("tokens").alias("tokens")))
    goals = {k: cut(_goal(cells, k, (targets or {}).get(d), power)) for k, d in keys.items()}
    fit = cut(rake(cells, goals).drop("gap").withColumn("factor", F.col("weight") / F.col("tokens")))
    if rate is None:
        rate = fit.agg(F.sum(F.least(F.col("weight"), F.col("tokens").cast("double"))) / F.sum("tokens")).first()[0] or 1.0
    fit = rake(fit, goals, rate=rate)
    fit = cut(fit.select(*keys, F.col("factor").alias("weight"), (F.col("held") / F.col("tokens")).alias("probability"), "gap"))
    draw = F.shiftrightunsigned(F.xxhash64(F.col(quoted(doc_id)), F.lit(seed)), 11) / F.lit(float(1 << 53))
    out = base.join(fit, list(keys)).withColumn("selected", draw < F.col("probability"))
    return out.select(*[F.col(quoted(c)) for c in rest], *made)


#: Share of all tokens that the queries' sample keeps.
RATE = 0.5

#: Target shares of the queries' mixture, by language and topic; a null value stands for all others. Sources are open-ended:
#: theirs are token shares to a power.
TARGETS = {
    "lang": {"=en": 0.4, "=de": 0.2, "=fr": 0.2, "=es": 0.15, None: 0.05},
    "topic": {"=prose": 0.75, "=table": 0.1, "=records": 0.05, "=shouting": 0.05, None: 0.05},
}


def targets(spark: SparkSession) -> dict[str, DataFrame]:
    """`TARGETS` as tables `(value, share)`."""
    return {d: spark.createDataFrame(list(t.items()), "value string, share double") for d, t in TARGETS.items()}


#: Patterns of the kinds of text that serve as topics, in this order.
TOPICS = (("table", r"(\|[^|\n]*){3}"), ("records", r"[0-9]{6}"), ("shouting", r"[A-Z]{4,}"), ("notes", r"[%$&#*]{3}"))


def with_topic(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `topic` (a kind of text) and `tokens` (words between ASCII white space), replacing columns so called."""
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    topic = F.coalesce(*[F.when(t.rlike(p), F.lit(name)) for name, p in TOPICS], F.lit("prose"))
    return docs.withColumns({"topic": topic, "tokens": F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")})
