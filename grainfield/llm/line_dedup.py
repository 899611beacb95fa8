"""Line dedup: keys of lines counted over documents, and lines dropped by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_text, others, quoted, spread

#: ASCII white space that a key loses at its ends.
SPACE = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def kept_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """`docs` with `text` reduced, and `n_lines`, `n_dropped` (long) added.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Lines of a key
    with `min_chars` code points or more, held by `min_docs` documents or more, stay only in the smallest
    id that holds it. Null text is one empty line. Rows with one id are one document: a line goes or stays
    in all of them, and each row is a row of the result. Rows with a null id keep their lines and are not
    counted. An empty table gives an empty one. Further columns pass through, but for any that are
    called `n_lines` or `n_dropped`, in upper or lower case, which are replaced.

    Keys are compared by two 64-bit hashes. Only hashes and positions are shuffled for counting; each text
    moves once, to meet its dropped positions.
    """
    columns = others(docs, "n_lines", "n_dropped")
    own = [F.col(quoted(c)) for c in columns if c.lower() != text.lower()]
    whole = F.coalesce(F.col(quoted(text)), F.lit(""))
    base = docs.select(F.col(quoted(doc_id)).alias("_id"), whole.alias("_text"), F.struct(F.lit(0), *own).alias("_row"))
    keyed = base.where("_id is not null").select(
        "_id",
        F.xxhash64("_text").alias("_th"),
        F.posexplode(F.arrays_zip(_lines(byte_text(F.col("_text"))).alias("k"), _lines(F.col("_text")).alias("line"))).alias("pos", "x"),
    )
    key = F.btrim("x.k", F.lit(SPACE))
    lines = (
        keyed.where(F.length(F.btrim("x.line", F.lit(SPACE))) >= min_chars)
        .select("_id", "_th", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))
    )
    if min_docs <= 2:
        held = lines.groupBy("h1", "h2").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).where("first != last")
    else:
        held = lines.select("h1", "h2", "_id").distinct().groupBy("h1", "h2").agg(F.min("_id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    dropped = (
        lines.join(spread(held.select("h1", "h2", "first")), ["h1", "h2"]).where("_id != first")
        .groupBy("_id", "_th").agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    )
    return _reassembled(base.withColumn("_th", F.xxhash64("_text")), dropped, text, columns)


def _reassembled(base: DataFrame, dropped: DataFrame, text: str, columns: list[str]) -> DataFrame:
    met = base.join(dropped, ["_id", "_th"], "left").withColumn("_lines", _lines(F.col("_text")))
    # The runs of lines between dropped positions; runs of no line go, runs of one empty line stay.
    k, drops = F.size("drops"), F.col("drops")
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(drops, i - 1) + 1)
    stop = lambda i: F.when(i == k, F.size("_lines")).otherwise(F.get(drops, i))
    runs = F.filter(F.sequence(F.lit(0), k), lambda i: stop(i) > begin(i))
    kept = F.array_join(F.transform(runs, lambda i: F.array_join(F.slice("_lines", begin(i) + 1, stop(i) - begin(i)), "\n")), "\n")
    out = met.select(
        "_row",
        F.when(drops.isNull(), F.col("_text")).otherwise(kept).alias("_kept"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return out.select(
        *[F.col("_kept").alias(c) if c.lower() == text.lower() else F.col(f"_row.{quoted(c)}") for c in columns],
        "n_lines",
        F.when(F.col("n_dropped") < 0, F.lit(0)).otherwise(F.col("n_dropped")).cast("long").alias("n_dropped"),
    )
