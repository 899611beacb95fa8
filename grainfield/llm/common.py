"""Shared pieces of the training-data operators: tables, byte-level folding,
lineage cuts, bounded bitmaps and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column's name for `F.col`, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def others(df: DataFrame, *made: str) -> list[str]:
    """The columns of `df` but for those called as one that is made, in upper or lower case."""
    taken = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in taken]


def spare(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or a local one
    where the session names none (tests on one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="grainfield-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back. Lost executors
    then never cause more than the current step to run again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/grainfield/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt out evenly. Between an aggregate and a join on the same key this
    gives the join an exchange on either side, so that adaptive execution can
    split the partition of a hot key."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def byte_text(text: Column) -> Column:
    """Text (null: empty) with one character per UTF-8 byte, A-Z lower-cased.

    Lower-casing also moves some lead bytes (0xC0-0xDE to 0xE0-0xFE). A moved
    two-byte or four-byte sequence keeps its number of continuation bytes, so
    different texts stay different; the result serves as a key, not as text.
    Bytes below 0x80 keep their meaning: ASCII white space and punctuation split
    it where they split the text.
    """
    return F.lower(F.decode(F.coalesce(text, F.lit("")).cast("binary"), "ISO-8859-1"))


def array_bit(bitmap: Column, h: Column, bits: int) -> Column:
    """Whether the bit of hash `h` is set in a bitmap of `bits` bits."""
    word = F.get(bitmap, F.shiftrightunsigned(h, 6).bitwiseAND(bits // 64 - 1).cast("int"))
    return F.getbit(word, h.bitwiseAND(63).cast("int")) == 1


def bitmap_size(n: int, least: int = 1 << 14, most: int = 1 << 26) -> int:
    """Bits for `n` keys: 64 or more a key, a power of two, at most 8 MB. More keys
    only let more rows through the filter; a join decides after it."""
    return min(most, max(least, 1 << max(0, (64 * n - 1)).bit_length()))


def bitmap(hashes: DataFrame, bits: int) -> DataFrame:
    """One row with `bitmap array<long>` of the one long column of `hashes`. Its size
    is `bits`, whatever the number of rows."""
    h = F.col(hashes.columns[0])
    words = (
        hashes.groupBy(F.shiftrightunsigned(h, 6).bitwiseAND(bits // 64 - 1).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(`{}` & 63 as int))".format(hashes.columns[0]))).alias("v"))
    )
    every = hashes.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("w"), "left")
    return every.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0).cast("long")).alias("v")))), lambda x: x["v"]).alias("bitmap")
    )


#: Edges up to this number (16 bytes each) are connected in one task; more are shuffled.
SMALL_EDGES = 1 << 20


def _connected(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of edges, and for each the smallest id that it is connected with. Roots with a smaller root at the other end
    of an edge move below the smallest such, until no edge has two roots."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return ids, ids[root]


def _connected_batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_connected` over all the edges `(u, v)` of a task."""
    found = list(them)
    u, v = (np.concatenate([np.empty(0, np.int64), *[x.column(i).to_numpy() for x in found]]) for i in (0, 1))
    ids, low = _connected(u, v)
    for k in range(0, len(ids), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 10_000]), pa.array(low[k : k + 10_000])], names=["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges (a long, b long)`: rows `(id, component)` for
    every id in an edge, component being the smallest id reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014) over an
    edge table; only counts come to the driver. Null ends and loops are ignored.
    A table of `SMALL_EDGES` or fewer is connected by one task instead, to the
    same result: the many small steps would each leave the driver a plan.
    """
    e = cut(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    if e.count() <= SMALL_EDGES:
        return e.coalesce(1).mapInArrow(_connected_batches, "id long, component long")
    state = None
    while True:
        # Large star: every neighbour above u goes to u's smallest neighbour.
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(spread(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e = cut(large)
        # Small star: u and its neighbours below go to the smallest of them.
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        joined = e.join(spread(low), "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        e = cut(small.distinct())
        # A star forest: each u has one v, and no v is a u.
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not now["n"] or state == (now["n"], now["h"]):
            break
        state = (now["n"], now["h"])
    pairs = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return pairs.unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
