"""Secret scans: candidates by pattern, judged by who owns them over the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread

#: Kinds in order with their pattern, the group that holds the value, and its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: A whole run of the value alphabet with a digit and a letter; what is bare in it is looked up as well: the run without dots at
#: its end, and what comes after its last `=` or `/`.
BARE = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9+/_.=-]*[A-Za-z])[A-Za-z0-9+/_.=-]{12,}"
KINDS = [k for k, *_ in BASE] + ["reuse"]


def _matches(text: Column, pattern: str, group: int) -> Column:
    """All matches of a pattern, leftmost first: code points since the match before, length, value."""
    gaps = F.split(text, pattern, -1)
    each = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    got = F.transform(each, lambda m, i: F.struct(i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), F.length(m["all"]).alias("len"), m["value"].alias("value")))
    return F.when(text.rlike(pattern), got)


def candidates(docs: DataFrame, doc_id: str, text: str, repository: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """The documents by a row number, without texts; and a row per match of a base pattern or bare run with its
    span in code points (end exclusive), the value's hash and whether it looks live."""
    t = F.coalesce(F.col(text), F.lit(""))
    patterns = [(k, p, g) for k, p, g, _ in BASE] + [("reuse", BARE, 0)]
    scanned = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"),
        *[_matches(t, p, g).alias(k) for k, p, g in patterns],
    )
    scanned = cut(scanned.withColumn("row", F.monotonically_increasing_id()))
    per_kind = [scanned.where(F.size(k) > 0).select("row", "repository", "owner", F.lit(k).alias("kind"), F.explode(k).alias("m")) for k, *_ in patterns]
    rows = per_kind[0]
    for x in per_kind[1:]:
        rows = rows.unionByName(x)
    # Where a match starts: all gaps and matches before it in its row.
    upto = Window.partitionBy("row", "kind").orderBy("m.i")
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(upto)
    least = {k: n for k, _, _, n in BASE}
    spans = rows.select("row", "repository", "owner", "kind", (end - F.col("m.len")).alias("start"), end.alias("end"), F.col("m.value").alias("value"))
    bare = spans.where("kind = 'reuse'")
    spans = spans.where("kind != 'reuse'").unionByName(_bare(bare))
    spans = spans.where(F.length("value") >= F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in least.items()], F.lit(12)))
    return scanned.select("row", "doc_id"), spans.select(
        "row", "repository", "owner", "kind", "start", "end", F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(1), "value").alias("h2"),
        (F.size(F.array_distinct(F.split("value", ""))) >= 8).alias("mixed"),
    )


def _bare(runs: DataFrame) -> DataFrame:
    """The values that a bare run may hold, each with its own span."""
    kept = F.regexp_replace("value", r"\.+$", "")
    from_sign = [F.length("kept") - F.length(F.substring_index("kept", sign, -1)) for sign in ("=", "/")]
    at = runs.withColumn("kept", kept).withColumn("skip", F.explode(F.array_distinct(F.array(F.lit(0), *from_sign))))
    value = F.substring("kept", F.col("skip") + 1, F.length("kept"))
    out = at.select("row", "repository", "owner", "kind", (F.col("start") + F.col("skip")).alias("start"), (F.col("start") + F.length("kept")).alias("end"), value.alias("value"))
    return out.where(F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "repository", owner: str = "owner", max_owners: int = 2, max_repositories: int = 4) -> DataFrame:
    """One row per row of `docs`: `doc_id` and `spans array<struct<start, place, kind, end, verdict>>`, sorted.

    Base spans are the matches of `BASE`. The corpus decides on each value: distinct repositories and owners that
    hold it as a base match are counted; with more than `max_owners` owners or `max_repositories` repositories it is an `example`, copied
    widely, else `live` if it has eight different characters, else `weak`. Live values found bare elsewhere, outside
    base spans and each within no other, are added as kind `reuse`: a bare run of the value alphabet as a whole, without dots at
    its end, or what comes after its last `=` or `/`, with a digit and a letter. Base spans always stay. Null texts have no spans; a null repository or
    owner counts as one that is unknown, together with other nulls. Repeated rows are rows of the result
    each. Empty tables give empty ones. Other columns are not read.
    """
    base_docs, spans = candidates(docs, doc_id, text, repository, owner)
    spans = cut(spans)
    unknown = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    held = spans.where(F.col("kind") != "reuse").groupBy("h1", "h2", unknown("owner"), unknown("repository")).agg(F.max("mixed").alias("mixed"))
    by_owner = held.groupBy("h1", "h2", "owner").agg(F.count("*").alias("repositories"), F.max("mixed").alias("mixed"))
    owned = by_owner.groupBy("h1", "h2").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.max("mixed").alias("mixed"))
    judged = owned.select("h1", "h2", "n_owners", "n_repositories", F.when((F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories), "example").when(F.col("mixed"), "live").otherwise("weak").alias("verdict"))
    met = spans.join(spread(judged), ["h1", "h2"]).where((F.col("kind") != "reuse") | (F.col("verdict") == "live"))
    place = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    one = F.struct("start", place.alias("place"), "kind", "end", "verdict")
    per_row = met.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("s"))
    base = F.filter("s", lambda x: x["kind"] != "reuse")
    free = F.filter("s", lambda x: (x["kind"] != "reuse") | ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    # Of the values of one run the longest, which begins first.
    widest = F.filter("free", lambda x: (x["kind"] != "reuse") | ~F.exists(F.col("free"), lambda o: (o["kind"] == "reuse") & (o["start"] < x["start"]) & (o["end"] >= x["end"])))
    per_row = per_row.withColumn("base", base).withColumn("free", free).select("row", widest.alias("spans"))
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint,verdict:string>>")
    return base_docs.join(per_row, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
