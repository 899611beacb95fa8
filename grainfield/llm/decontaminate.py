"""Benchmark decontamination: winnowed fingerprints joined, hits extended to windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import array_bit, bitmap, bitmap_size, byte_text, cut, spread


def words_of(text: Column) -> Column:
    """Maximal runs of digits, letters and non-ASCII characters, as byte texts."""
    return F.filter(F.split(byte_text(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", -1), lambda w: w != "")


def _grams(hashes: Column, k: int) -> Column:
    """Hash of each k consecutive elements, by 0-based position."""
    at = F.when(F.size(hashes) >= k, F.sequence(F.lit(0), F.size(hashes) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))


def _selected(grams: Column, p: Column, w: int) -> Column:
    """Whether winnowing keeps position p: its gram is the least of some window of w grams."""
    if w == 1:
        return F.lit(True)
    first, last = F.greatest(F.lit(0), p - (w - 1)), F.least(p, F.size(grams) - w)
    return (F.size(grams) >= w) & F.exists(F.sequence(first, F.greatest(first, last)), lambda s: F.array_min(F.slice(grams, s + 1, w)) == F.get(grams, p))


def _schemes(items: DataFrame, window: int, k: int) -> list[tuple[int, int, int]]:
    """(window, gram, grams in a winnowing window) for the full window, and for each shorter item
    length that occurs: at most `window - 1` numbers come to the driver."""
    short = [r[0] for r in items.where((F.col("n") > 0) & (F.col("n") < window)).select("n").distinct().collect()]
    return [(window, k, window - k + 1)] + [(n, n, 1) for n in sorted(short)]


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, gram: int = 6, share: int = 20
) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `n_words`, `n_hit` (long), `items array<string>` (sorted ids of
    the items with a window in the text), `contaminated` (n_hit > 0 and share * n_hit >= n_words).

    A window is `window` consecutive words of an item, or a whole item of fewer; words inside any occurrence
    of a window are hit. Null text has no words and no window. Rows are judged one by one, whatever their
    doc_id, null or repeated. Null item ids give windows that hit
    but are not listed. Empty tables give no rows, or no hits. Other columns are not read.

    Of each `window - gram + 1` consecutive grams the least is a fingerprint, so that every span of `window`
    words shares one with its equal. A document's fingerprints are first held against a bitmap of the
    items' (a bound on size, not on rows), then joined with them; what meets is extended to the windows
    around it, and these are compared word by word. Items enter by distinct windows, so that a window of
    many items meets a document once.
    """
    bench = cut(items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("w")).withColumn("n", F.size("w")))
    base = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("w"))
    wide = base.withColumn("hw", F.transform("w", lambda x: F.xxhash64(x)))
    found, prints, windows = [], [], []
    for n, k, w in _schemes(bench, window, gram):
        mine = (F.col("n") >= window) if n == window else (F.col("n") == n)
        own = bench.where(mine).withColumn("g", _grams(F.transform("w", lambda x: F.xxhash64(x)), k))
        kept = own.select(F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda p: _selected(F.col("g"), p, w)), lambda p: F.get("g", p))).alias("fp")).distinct()
        kept = cut(kept)
        bits = bitmap_size(kept.count())
        prints.append(kept.withColumn("scheme", F.lit(n)))
        windows.append(
            own.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda s: F.array_join(F.slice("w", s + 1, n), " "))).alias("win")).distinct()
        )
        g, bm = f"g{n}", f"bm{n}"
        wide = wide.withColumn(g, _grams(F.col("hw"), k)).withColumn(bm, cut(bitmap(kept, bits)).scalar())
        maybe = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda p: array_bit(F.col(bm), F.get(F.col(g), p), bits))
        maybe = F.when(F.size(g) > 0, maybe).otherwise(F.array().cast("array<int>"))
        found.append(
            F.transform(
                F.filter(maybe, lambda p: _selected(F.col(g), p, w)),
                lambda p: F.struct(
                    F.lit(n).alias("scheme"),
                    F.get(F.col(g), p).alias("fp"),
                    F.greatest(F.lit(0), p - (n - k)).alias("at"),
                    F.slice("w", F.greatest(F.lit(0), p - (n - k)) + 1, F.least(p, F.lit(n - k)) + n).alias("around"),
                ),
            )
        )
    # Written once, so that a row keeps its number.
    scanned = cut(wide.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("long").alias("n_words"), F.concat(*found).alias("found")))
    hits = scanned.select("row", F.explode("found").alias("x")).select("row", "x.*")
    both = prints[0]
    for x in prints[1:]:
        both = both.unionByName(x)
    met = hits.join(spread(both), ["scheme", "fp"], "left_semi")
    # Extension: every window that holds the fingerprint, as words with its place.
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("around") - F.col("scheme")))
    near = met.select("row", "scheme", F.explode(F.transform(F.filter(starts, lambda s: s + F.col("scheme") <= F.size("around")), lambda s: F.struct((F.col("at") + s).alias("at"), F.array_join(F.slice("around", s + 1, F.col("scheme")), " ").alias("win")))).alias("x"))
    near = near.select("row", "scheme", "x.at", "x.win").distinct()
    wins = windows[0]
    for x in windows[1:]:
        wins = wins.unionByName(x)
    wins = cut(wins.distinct())
    same = cut(near.join(wins.select("win").distinct().transform(spread), "win", "left_semi"))
    # Hit words: each window's words up to where the next window begins.
    spans = same.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("scheme")).alias("to")))).alias("s"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    union = F.aggregate("s", zero, lambda a, x: F.struct(F.greatest(a["end"], x["to"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(a["end"], x["at"]))).alias("n")))["n"]
    n_hit = spans.select("row", union.cast("long").alias("n_hit"))
    listed = (
        same.select("row", "win").distinct().join(spread(wins.where("item is not null")), "win").select("row", "item").distinct()
        .groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    out = scanned.drop("found").join(n_hit, "row", "left").join(listed, "row", "left")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
