"""MinHash near-dedup with tensored banding."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import array_bit, bitmap, bitmap_size, components, cut, spread
from .shingles import WordHashes, minhashes, shingle_set


#: Longs of a parity sketch.
SKETCH = 8
_PARITY = [f"k{i}" for i in range(SKETCH)]


def groups_for(similarity: float, rows: int, miss: float) -> int:
    """The least number m of minhash collections of `rows` hashes for which a pair at `similarity`
    agrees in fewer than two (so meets in none of the m(m-1)/2 tables) with probability below `miss`."""
    p, m = similarity**rows, 2
    while sum(comb(m, i) * p**i * (1 - p) ** (m - i) for i in (0, 1)) > miss:
        m += 1
    return m


def _signed(x: np.ndarray) -> list[int]:
    return x.astype(np.uint64).view(np.int64).tolist()


def _class(s: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit hash, as two longs."""
    whole = xxhash.xxh3_128_intdigest(s.tobytes())
    return (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)


def _signatures(docs: DataFrame, k: int, groups: int, rows: int) -> DataFrame:
    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240229)
        a = rng.integers(1, 2**63, groups * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, groups * rows, dtype=np.uint64)
        words = WordHashes()
        for batch in them:
            n, c1, c2, bands = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k, words)
                n.append(len(s))
                x, y = _class(s)
                c1.append(x)
                c2.append(y)
                bands.append(_signed(_folded(minhashes(s, a, b).reshape(groups, rows))) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "n", "c1", "c2", "bands"],
            )

    return docs.mapInArrow(batches, "id long, n long, c1 long, c2 long, bands array<long>")


def _folded(m: np.ndarray) -> np.ndarray:
    """One hash for each row of minhashes."""
    out = np.zeros(len(m), np.uint64)
    for j in range(m.shape[1]):
        out = (out ^ m[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in them:
            sets = [shingle_set(t.as_py(), k, words) for t in batch.column(1)]
            c1, c2 = zip(*map(_class, sets), strict=True) if sets else ((), ())
            sets = [s.view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "c1", "c2", "s"])

    return docs.mapInArrow(batches, "id long, c1 long, c2 long, s array<long>")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each pair `(rep, l)` with `linked`, the sizes `n` and `d` of rep's set and of its difference from l's, `e`:
    as many elements of that difference as any link that matters must share (see `near_duplicates`), and a sketch of
    the whole difference: for each of 64 * `SKETCH` bits, whether an odd number of elements fall on it."""
    left = sets.select(F.col("id").alias("rep"), F.col("s").alias("x"))
    right = sets.select(F.col("id").alias("l"), F.col("s").alias("y"))
    both = pairs.select("rep", "l").join(left, "rep").join(right, "l").select("rep", "l", "x", "y")
    delta = (100 - percent) / (100 + percent)

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            linked, n, d, e, sketch = [], [], [], [], []
            for x, y in zip(_arrays(batch.column(2)), _arrays(batch.column(3)), strict=True):
                # What l lacks comes first, then what rep lacks: one order for all that differ from l.
                differ = np.concatenate([x[~_within(x, y)], y[~_within(y, x)]])
                size, both_n = len(differ), len(x) + len(y)
                is_linked = 100 * (both_n - size) >= percent * (both_n + size)
                shared = size * (1 - delta) / 2 if is_linked else (size - delta * both_n) / (1 + delta)
                linked.append(is_linked)
                n.append(len(x))
                d.append(size)
                odd = np.bincount((differ >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) % 2
                sketch.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                e.append(differ[: size - max(1, ceil(shared - 1e-9)) + 1].view(np.int64))
            ends = np.cumsum([0, *map(len, e)]).astype(np.int32)
            flat = np.concatenate(e) if e else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *map(pa.array, np.array(sketch, np.int64).reshape(-1, SKETCH).T)], names=["rep", "l", "linked", "n", "d", "e", *_PARITY])

    return both.mapInArrow(batches, "rep long, l long, linked boolean, n long, d long, e array<long>, " + ", ".join(f"{k} long" for k in _PARITY))


def _arrays(lists: pa.ListArray) -> Iterator[np.ndarray]:
    values, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    return (values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


def _within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which elements of x are in y; both are sorted."""
    if not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, rows: int = 3, miss: float = 1e-5) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `n_shingles`, `component_id` (long), `kept`.

    Two ids are linked if 100 * |intersection| >= percent * |union| of their sets of `words`-word shingles;
    component_id is the smallest id reachable, kept says that it is the row's own. Null and empty texts have
    an empty set and no link. Rows with one id and different texts are one vertex. A null id has no link, a
    null component and is kept. An empty table gives an empty one. Other columns are not read.

    `groups` collections of `rows` minhashes give groups * (groups - 1) / 2 tables, each keyed by a pair of
    collections; a pair of sets at the threshold meets in one of them but for a chance of `miss`. Equal sets are
    one class, which has a number and the smallest of its ids. Only collection values that two classes share take part, and tables are formed from these.

    A table key may hold a great many classes, so its pairs are not formed. Each class is compared on full sets with the
    leader of its key, the most popular class there, and the difference of the two sets is taken. Let classes x
    and y of one key differ from its leader l by X and Y. They differ from each other by the symmetric difference of X and Y, which
    for a link is at most delta * (|x| + |y|), delta = (100 - percent) / (100 + percent). If both are linked to l they are
    connected already. Else that bound forces X and Y to share elements: (|X| - delta * (|x| + |l|)) / (1 + delta) at
    least for the one not linked to l, (1 - delta) / 2 * |X| for a linked one. So two that are linked meet in an element among the
    first |X| - shared + 1 and |Y| - shared + 1 of one order. Classes that are not connected yet and meet there, with
    enough elements from there on, are compared by their sketches: the bits in which these differ are at most the
    elements in which the sets do, and near their number. Only pairs whose sketches allow a link are formed, and compared on full sets.
    """
    groups = groups_for(percent / 100, rows, miss)
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("t"))
    sigs = cut(_signatures(src, words, groups, rows))
    full = sigs.where("n > 0 and id is not null")
    reps = full.groupBy("c1", "c2").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()))

    led = cut(_leaders(_tables(reps)))

    # The set of a class comes from a row of its smallest id; that id's other texts have other classes.
    ids = led.select("rep").unionByName(led.select(F.col("l").alias("rep"))).distinct()
    ids = cut(ids.join(spread(reps.select("rep", "c1", "c2", "least")), "rep"))
    bits = bitmap_size(ids.count())
    some = src.where("id is not null").withColumn("bm", cut(bitmap(ids.select(F.xxhash64("least").alias("h")), bits)).scalar()).where(array_bit(F.col("bm"), F.xxhash64("id"), bits))
    sets = _sets(some.select("id", "t").join(spread(ids), F.col("id") == F.col("least"), "left_semi"), words)
    sets = sets.join(spread(ids), ["c1", "c2"]).where(F.col("id") == F.col("least")).select(F.col("rep").alias("id"), "s")
    sets = cut(sets.dropDuplicates(["id"]))

    star = cut(_compared(led, sets, percent))
    edges = star.where("linked").select(F.col("rep").alias("a"), F.col("l").alias("b"))
    comp = cut(components(edges))
    rest = cut(_differing_alike(star, comp, percent))
    edges = edges.unionByName(_compared(rest, sets, percent).where("linked").select(F.col("rep").alias("a"), F.col("l").alias("b")))
    # Ids with several texts tie their classes together.
    several = full.groupBy("id").agg(F.min(F.struct("c1", "c2")).alias("p"), F.max(F.struct("c1", "c2")).alias("q")).where("p != q").select("id")
    of = cut(full.select("id", "c1", "c2").join(spread(several), "id", "left_semi").join(spread(reps.select("c1", "c2", "rep")), ["c1", "c2"]).select("id", "rep"))
    tied = of.join(spread(of.groupBy("id").agg(F.min("rep").alias("a"))), "id").select("a", F.col("rep").alias("b"))
    comp = cut(components(edges.unionByName(tied)))
    # A component is named by the smallest id of its classes.
    held = cut(comp.withColumnRenamed("id", "rep").join(spread(reps.select("rep", "least")), "rep"))
    lows = held.groupBy("component").agg(F.min("least").alias("name"))
    named = reps.select("c1", "c2", "rep", "least").join(spread(held.select("rep", "component").join(spread(lows), "component")), "rep", "left")
    named = named.select("c1", "c2", F.coalesce("name", "least").alias("component"))
    out = sigs.join(spread(named).withColumn("linked", F.lit(True)), ["c1", "c2"], "left")
    component = F.when(F.col("id").isNotNull(), F.when((F.col("n") > 0) & F.col("linked"), F.col("component")).otherwise(F.col("id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _tables(reps: DataFrame) -> DataFrame:
    """A row `(key, rep, rank)` for each class and table in which it may meet another: collections whose value two classes
    share, in pairs. The lower the rank, the more classes share its values: it is the one that others were copied from."""
    own = reps.select("rep", F.posexplode("bands").alias("g", "v"))
    shared = own.groupBy("g", "v").agg(F.count("*").alias("m")).where("m > 1")
    mine = own.join(spread(shared), ["g", "v"]).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("g", "v"))).alias("x"), F.sum("m").alias("pop")).where(F.size("x") > 1)
    pairs_of = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("x") - 2),
            lambda i: F.transform(F.slice("x", i + 2, F.size("x")), lambda y: F.xxhash64(F.get("x", i)["g"], F.get("x", i)["v"], y["g"], y["v"])),
        )
    )
    return mine.select("rep", (-F.col("pop")).alias("rank"), F.explode(pairs_of).alias("key"))


def _leaders(tables: DataFrame) -> DataFrame:
    """The distinct pairs `(rep, l)` of a class and the leader of one of its keys."""
    tables = cut(tables)
    first = tables.groupBy("key").agg(F.min(F.struct("rank", "rep")).alias("p"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi")
    return tables.join(spread(first.select("key", F.col("p.rep").alias("l"))), "key").where("rep != l").select("rep", "l").distinct()


def _differing_alike(star: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs `(rep, l)` of classes that aren't connected, share a leader, and whose differences from it share enough."""
    at = star.join(spread(comp.withColumnRenamed("id", "rep")), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    at = cut(at)
    open_ = at.groupBy("l").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("l")
    each = at.join(spread(open_), "l").select("rep", "comp", "linked", "n", "d", *_PARITY, F.posexplode("e").alias("p", "x"), "l")
    each = cut(each.select(F.xxhash64("l", "x").alias("key"), "rep", "comp", "linked", "n", "d", "p", *_PARITY))
    alive = each.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    each = cut(each.join(spread(alive), "key"))
    other = cut(each.select("key", *[F.col(c).alias(f"o_{c}") for c in ("rep", "comp", "linked", "n", "d", "p", *_PARITY)]))
    most = (100 - percent) / (100 + percent) * (F.col("n") + F.col("o_n")) + 1e-9
    need = F.col("d") + F.col("o_d") - most
    enough = 2 * F.least(F.col("d") - F.col("p"), F.col("o_d") - F.col("o_p")) >= need
    fits = 100 * F.least("n", "o_n") >= percent * F.greatest("n", "o_n")
    odd = sum(F.bit_count(F.col(k).bitwiseXOR(F.col(f"o_{k}"))) for k in _PARITY)
    bits = 64 * SKETCH
    usual = bits / 2 * (1 - F.pow(F.lit(1 - 2 / bits), most)) + 6 * F.sqrt(bits / 4 * (1 - F.pow(F.lit(1 - 4 / bits), most)))
    enough = enough & (odd <= most) & (odd <= usual)
    met = each.join(spread(other), "key").where((F.col("rep") < F.col("o_rep")) & (F.col("comp") != F.col("o_comp")) & ~(F.col("linked") & F.col("o_linked")) & enough & fits)
    return met.select("rep", F.col("o_rep").alias("l")).distinct()
