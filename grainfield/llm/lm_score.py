"""LM scoring: stupid backoff from n-gram count tables partitioned by hash."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted
from .shingles import WordHashes, mix

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _packed(x: np.ndarray) -> bytes:
    """Bytes of an array, those of equal significance together."""
    flat = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T if len(x) else np.empty(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat).tobytes())


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).reshape(-1) if len(flat) else np.empty(0, kind)


#: N-grams, repeated ones included, that a share of the range of hashes stands for: they bound the memory of its task.
SHARE_GRAMS = 1 << 22

_CHUNK = "chunk long, ids binary, lengths binary, words binary, places binary, n_words long"


def _chunked(chunk_words: int, them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as rows of about `chunk_words` words: the distinct words' hashes, and each word's place among them."""
    hashes, me, made = WordHashes(), TaskContext.get().partitionId(), 0
    names = [c.split()[0] for c in _CHUNK.split(", ")]

    def chunk(ids: list[int | None], docs: list[np.ndarray]) -> pa.RecordBatch:
        words = np.concatenate(docs)
        distinct, place, counts = np.unique(words, return_inverse=True, return_counts=True)
        # Frequent words first, so that most places are small numbers.
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        steps = np.diff(distinct[order], prepend=np.uint64(0))
        row = ((me << 32) + made, _packed(np.array([[i or 0 for i in ids], [i is None for i in ids]], np.int64).reshape(-1)), _packed(np.array([len(d) for d in docs], np.int64)), _packed(steps), _packed(rank[place]), len(words))
        kinds = [pa.int64(), *[pa.binary()] * 4, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    ids: list[int | None] = []
    docs: list[np.ndarray] = []
    held = 0
    for batch in them:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            w = (text.as_py() or b"").lower().split()
            ids.append(i)
            docs.append(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)))
            held += len(w)
            if held >= chunk_words:
                yield chunk(ids, docs)
                ids, docs, held, made = [], [], 0, made + 1
    if ids:
        yield chunk(ids, docs)


def _words(words: bytes, places: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(words, np.uint64), dtype=np.uint64)[_unpacked(places, np.uint32)]


def _grams(words: np.ndarray, lengths: np.ndarray, order: int, bits: int) -> list[np.ndarray]:
    """For each n the hashes of the n-grams that start at each word, and where a document has no such n-gram, 0."""
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(words))
    out, gram = [], np.zeros(len(words), np.uint64)
    for n in range(1, order + 1):
        gram = mix(gram[: len(words) - n + 1] * _GOLDEN + words[n - 1 :]) if n <= len(words) else gram[:0]
        whole = np.zeros(len(words), np.uint64)
        whole[: len(gram)] = np.where(left[: len(gram)] >= n, np.maximum(gram >> np.uint64(64 - bits), np.uint64(1)), np.uint64(0))
        out.append(whole)
    return out


def _table(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a chunk, in order, and how often each occurs."""
    every = np.concatenate(grams)
    return np.unique(every[every > 0], return_counts=True)


_ENTRIES = "share int, model boolean, chunk long, first int, grams binary, counts binary"


def _sent(order: int, bits: int, shares: int, model: bool, them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's table, cut into equal shares of the range of hashes."""
    names = [c.split()[0] for c in _ENTRIES.split(", ")]
    kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    for batch in them:
        for key, lengths, words, places in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            g, c = _table(_grams(_words(words, places), _unpacked(lengths, np.int64), order, bits))
            bounds = np.searchsorted(g, np.array([(s << bits) // shares for s in range(1, shares)], np.uint64))
            rows = []
            for s, (a, b) in enumerate(zip([0, *bounds], [*bounds, len(g)], strict=True)):
                if b > a:
                    rows.append((s, model, key, int(a), _packed(np.diff(g[a:b], prepend=np.uint64(0))), _packed(c[a:b].astype(np.uint32))))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)


def _counting(model_apart: bool):
    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        return _counted(model_apart, rows)

    return counted


def _counted(model_apart: bool, rows: pd.DataFrame) -> pd.DataFrame:
    """One share of the range of hashes: its count table, joined with the chunks' n-grams. A chunk gets totals for
    those that it can't count by itself."""
    grams = [np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in rows["grams"]]
    counts = np.concatenate([_unpacked(x, np.uint32) for x in rows["counts"]]).astype(np.int64)
    sizes = [len(g) for g in grams]
    in_model = np.repeat(rows["model"].to_numpy(), sizes)
    table, back = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(back, counts * in_model, len(table)).astype(np.int64)
    told = (total > 0) if model_apart else (np.bincount(back, minlength=len(table)) > 1)
    ends, out = np.cumsum([0, *sizes]), []
    for k, (chunk, first, model) in enumerate(zip(rows["chunk"], rows["first"], rows["model"], strict=True)):
        own = back[ends[k] : ends[k + 1]]
        i = np.nonzero(told[own])[0]
        if len(i) and not (model and model_apart):
            out.append((chunk, _packed(np.diff(i + first, prepend=0).astype(np.int32)), _packed(total[own[i]])))
    return pd.DataFrame(out, columns=["chunk", "at", "totals"])


def _scored(order: int, bits: int, alpha: float, own: bool, leave_out: bool, them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document of a chunk the sum of logarithms, and how many words stand over the corpus' words. `own`: the
    chunk is part of the model, so n-grams without a total are those that no other chunk has."""
    for batch in them:
        for k in range(len(batch)):
            ids, lengths, words, places = (batch.column(c)[k].as_py() for c in range(1, 5))
            ids, lengths = _unpacked(ids, np.int64), _unpacked(lengths, np.int64)
            grams = _grams(_words(words, places), lengths, order, bits)
            table, total = _table(grams)
            total = total.astype(np.int64) if own else np.zeros(len(table), np.int64)
            for at, t in zip(batch.column(5)[k].as_py() or [], batch.column(6)[k].as_py() or [], strict=True):
                total[np.cumsum(_unpacked(at, np.int32))] = _unpacked(t, np.int64)
            n_all = int(lengths.sum())
            doc = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
            at = np.arange(n_all) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            found = []
            for g in grams:
                some = np.nonzero(g)[0]
                f = np.zeros(n_all, np.int64)
                f[some] = total[np.searchsorted(table, g[some])]
                if leave_out and len(some):
                    by = some[np.lexsort((doc[some], g[some]))]
                    new = np.concatenate([[True], (g[by][1:] != g[by][:-1]) | (doc[by][1:] != doc[by][:-1])])
                    run = np.cumsum(new) - 1
                    f[by] -= np.bincount(run)[run]
                found.append(f)
            logs, over, open_ = np.zeros(n_all), np.zeros(n_all, bool), np.ones(n_all, bool)
            for n in range(order, 0, -1):
                # The n-gram that ends at a word starts n - 1 words before.
                ends = np.zeros(n_all, np.int64)
                if n <= n_all:
                    ends[n - 1 :] = found[n - 1][: n_all - n + 1]
                hit = open_ & (at >= n - 1) & (ends > 0)
                if n > 1:
                    # A context without a count is a hash that met another's.
                    hit[n - 1 :] &= found[n - 2][: n_all - n + 1] > 0
                i = np.nonzero(hit)[0]
                logs[i] = np.log(ends[i]) + (order - n) * np.log(alpha)
                if n > 1:
                    logs[i] -= np.log(found[n - 2][i - n + 1])
                over[i] = n == 1
                open_[i] = False
            # Words that the model lacks: a count of one, one step below.
            logs[open_], over[open_] = order * np.log(alpha), True
            by_doc = lambda x: np.bincount(doc, x, len(lengths))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[: len(lengths)], mask=ids[len(lengths) :] > 0), pa.array(lengths), pa.array(by_doc(logs).astype(float)), pa.array(by_doc(over).astype(np.int64))], names=["doc_id", "n_words", "logs", "over"]
            )


def stupid_backoff(
    docs: DataFrame, model: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", order: int = 3, alpha: float = 0.4, shares: int | None = None, chunk_words: int = 1 << 20, leave_out: bool = False
) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `n_words` (long), `log_score` and `per_word` (double; null without words).

    log_score is the sum over words of log S(w | the order - 1 words before) where S is count(n-gram) / count(context)
    if the n-gram is in the model, else alpha * S with a shorter context, and count(w) / words of the model at the
    end, where a first word has one alpha for each word that it lacks. A word that the model lacks takes a count of 1 and one
    more alpha. The model counts the texts of `model`, by default `docs` itself, the scored one included, or with
    `leave_out` all others: then n-grams found nowhere else back off. Words are runs between ASCII white space, A-Z
    lower-cased. Null texts have none. Rows are scored one by one whatever their id, null or repeated; an empty table gives
    an empty one, an empty model counts as one word. Other columns are not read.

    Chunks of documents send their distinct n-grams with their counts to equal shares of the range of hashes, packed, so that even the most
    frequent n-gram is one entry per chunk. A share's count table is joined with the chunks' n-grams, and totals
    go back to the chunks, which sum their documents. There are as many shares as the number of words asks for, so that neither a chunk nor a
    share grows with the corpus. Hashes have so many bits that an n-gram takes another's
    count with a chance below one in a million.
    """
    if model is not None and leave_out:
        raise ValueError("the scored text isn't part of a model of its own")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    def chunks(df: DataFrame, key: str | None) -> DataFrame:
        of = F.monotonically_increasing_id() if key is None else F.col(quoted(key)).cast("long")
        return cut(df.select(of.alias("doc_id"), F.col(quoted(text)).cast("binary").alias("t")).mapInArrow(partial(_chunked, chunk_words), _CHUNK))

    mine = chunks(docs, doc_id)
    theirs = mine if model is None else chunks(model, None)
    total = max(1, theirs.agg(F.sum("n_words")).first()[0] or 0)
    bits = min(64, total.bit_length() + 20)
    shares = shares or max(parts, -(-order * total // SHARE_GRAMS))
    sent = lambda df, model: df.select("chunk", "lengths", "words", "places").mapInArrow(partial(_sent, order, bits, shares, model), _ENTRIES)
    entries = sent(theirs, True) if model is None else sent(theirs, True).unionByName(sent(mine, False))
    back = entries.groupBy("share").applyInPandas(_counting(model is not None), "chunk long, at binary, totals binary")
    back = back.groupBy("chunk").agg(F.collect_list("at").alias("at"), F.collect_list("totals").alias("totals"))
    both = mine.join(back, "chunk", "left").select("chunk", "ids", "lengths", "words", "places", "at", "totals")
    per_doc = cut(both.mapInArrow(partial(_scored, order, bits, alpha, model is None, leave_out), "doc_id long, n_words long, logs double, over long"))
    some = F.col("n_words") > 0
    others = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)) if leave_out else F.lit(total)
    score = F.col("logs") - F.col("over") * F.log(others.cast("double"))
    out = per_doc.select("doc_id", "n_words", F.when(some, score).alias("log_score"))
    return out.withColumn("per_word", F.when(some, F.col("log_score") / F.col("n_words")))
