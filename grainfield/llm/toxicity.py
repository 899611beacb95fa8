"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import others, quoted

_WORD = re.compile(r"\w+")
_CACHE_WORDS = 1 << 19
#: Standard deviation of the factors at the start.
SPREAD = 0.3

class _Terms(dict):
    """The terms of a word: the word, and its first four letters if it has more."""

    def __init__(self, dims: int, at: dict[int, int] | None = None) -> None:
        super().__init__()
        self.dims, self.at = dims, at

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        ids = [xxhash.xxh3_64_intdigest(raw, 1) % self.dims]
        if len(word) > 4:
            ids.append(xxhash.xxh3_64_intdigest(word[:4].encode("utf-8", "surrogatepass"), 2) % self.dims)
        if self.at is not None:
            ids = [self.at[x] for x in ids if x in self.at]
        self[word] = out = tuple(ids)
        return out


def _features(text: str | None, terms: _Terms) -> np.ndarray:
    """Distinct terms of a text."""
    return np.array(sorted({t for w in set(_WORD.findall((text or "").lower())) for t in terms[w]}), np.int64)


@dataclass(frozen=True)
class FactorizationMachine:
    """Terms (hashes, sorted) with a weight and a factor row each."""

    dims: int
    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """Probabilities for documents given as positions in `terms`."""
        flat, starts, n = _ragged(docs)
        return _sigmoid(_margin(self.bias, self.weights, self.factors, flat, starts, n)[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _ragged(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(d) for d in docs], np.int64)
    return (np.concatenate(docs) if len(docs) else np.empty(0, np.int64)), np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n


def _sums(values: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros((len(n), *values.shape[1:]), values.dtype)
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(values, starts[some], axis=0)
    return out


def _margin(bias, weights, factors, flat, starts, n):
    """bias + sum of weights + sum over pairs of factor products, divided by the number of terms."""
    v = factors[flat]
    s, q = _sums(v, starts, n), _sums(v * v, starts, n)
    scale = 1 / np.maximum(1, n)
    return bias + _sums(weights[flat], starts, n) + 0.5 * ((s * s - q).sum(axis=1)) * scale, s, v, scale


def train(
    docs: list[np.ndarray], labels: np.ndarray, dims: int, rank: int = 8, epochs: int = 12, rate: float = 2.0, sparse: float = 12.0, factor_rate: float = 0.3, decay: float = 0.03, seed: int = 7
) -> FactorizationMachine:
    """A machine fitted in batches to the log loss. Every term that the documents hold takes part, whether it goes with the
    label by itself or not: pairs may. Weights follow the regularized leader (FTRL-proximal) with an L1 penalty of
    `sparse`, so that the many terms of single documents don't learn these by heart; factors follow Adagrad and start
    large enough for pairs to be seen from the first step."""
    terms = np.unique(np.concatenate(docs) if docs else np.empty(0, np.int64)).astype(np.int64)
    at = [np.searchsorted(terms, d) for d in docs]
    rng = np.random.default_rng(seed)
    rate_1 = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(rate_1 / (1 - rate_1)))
    size = len(terms)
    w, v = np.zeros(size), rng.normal(0, SPREAD, (size, rank))
    lead, gw, gv, gb = np.zeros(size), np.full(size, 1.0), np.full((size, rank), 1.0), 1.0
    for _ in range(epochs if len(docs) else 0):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), 128):
            some = order[k : k + 128]
            flat, starts, n = _ragged([at[i] for i in some])
            used, inv = np.unique(flat, return_inverse=True)
            margin, s, vf, scale = _margin(bias, w[used], v[used], inv, starts, n)
            err = _sigmoid(margin) - labels[some]
            each = np.repeat(err, n)
            dw = np.bincount(inv, each, len(used))
            before = np.sqrt(gw[used])
            gw[used] += dw * dw
            after = np.sqrt(gw[used])
            lead[used] += dw - (after - before) / rate * w[used]
            w[used] = -np.sign(lead[used]) * np.maximum(0, np.abs(lead[used]) - sparse) * rate / after
            pair = (np.repeat(s, n, axis=0) - vf) * (each * np.repeat(scale, n))[:, None]
            dv = np.stack([np.bincount(inv, pair[:, j], len(used)) for j in range(rank)], axis=1) + decay * np.bincount(inv, minlength=len(used))[:, None] * v[used]
            gv[used] += dv * dv
            v[used] -= factor_rate * dv / np.sqrt(gv[used])
            gb += float(err.sum()) ** 2
            bias -= rate * float(err.sum()) / np.sqrt(gb)
    return FactorizationMachine(dims, terms, bias, w, v)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 12_000, dims: int = 1 << 18) -> FactorizationMachine:
    """A machine learned from the labelled rows that are not held out.

    At most about `max_rows` of them, taken by a hash of their id, meet in one task, as terms and not as
    texts; this bound holds at every size. Only the machine comes to the driver, whose memory is for plans. Null ids and labels are left out; a document with several labels
    has the largest. No labelled rows give a machine without terms, which scores next to 0 throughout: nothing is
    called toxic unseen.
    """
    y = labels.select(F.col(quoted(doc_id)).alias("_id"), F.col(quoted(label)).alias("y"))
    y = y.where("_id is not null and y is not null").where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("y").cast("int").alias("y"))
    n = y.count()
    share = min(1.0, max_rows / max(1, n))
    some = y.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    rows = docs.select(F.col(quoted(doc_id)).alias("_id"), F.col(quoted(text)).alias("t")).join(F.broadcast(some), "_id").select("_id", "t", "y")

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(dims)
        for batch in them:
            got = [_features(t.as_py(), terms) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in got], pa.int64()), batch.column("y"), pa.array(got, pa.list_(pa.int32()))], names=["h", "y", "x"])

    def trained(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(found) if (found := list(them)) else None
        if got is None or not got.num_rows:
            return
        # The same order whatever the partitions: by a hash of the terms.
        x = [part[a:b] for c in got.column("x").chunks for part, ends in [(c.values.to_numpy(), c.offsets.to_numpy())] for a, b in zip(ends, ends[1:], strict=False)]
        y_ = got.column("y").to_numpy()
        order = np.lexsort((y_, got.column("h").to_numpy()))
        m = train([x[i] for i in order], (y_[order] > 0).astype(np.float64), dims)
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), *[pa.array([v.tobytes()], pa.binary()) for v in (m.terms, m.weights, m.factors)]], names=["bias", "terms", "weights", "factors"])

    terms = rows.mapInArrow(batches, "h long, y int, x array<int>")
    got = terms.repartition(1).mapInArrow(trained, "bias double, terms binary, weights binary, factors binary").toArrow()
    if not got.num_rows:
        return FactorizationMachine(dims, np.empty(0, np.int64), -35.0, np.empty(0), np.empty((0, 1)))
    flat = lambda name, kind: np.frombuffer(got.column(name)[0].as_py(), kind)
    weights = flat("weights", np.float64)
    return FactorizationMachine(dims, flat("terms", np.int64), got.column("bias")[0].as_py(), weights, flat("factors", np.float64).reshape(len(weights), -1))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def scored(docs: DataFrame, machine: FactorizationMachine, text: str = "text") -> DataFrame:
    """`docs` with `score double` added, of the whole text alone; null texts score like empty ones. A column
    called `score`, in upper or lower case, is replaced, other columns pass through."""
    rest = others(docs, "score")
    df = docs.select(*[F.col(quoted(c)) for c in rest])
    schema = StructType([*df.schema.fields, StructField("score", DoubleType())])
    at_text = [c.lower() for c in rest].index(text.lower())

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(machine.dims, {int(t): i for i, t in enumerate(machine.terms)})
        for batch in them:
            got: list[np.ndarray] = []
            for k in range(0, len(batch), 512):
                got.append(machine.scores([_features(t.as_py(), terms) for t in batch.column(at_text).slice(k, 512)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got) if got else [], pa.float64())], names=[*rest, "score"])

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(batches, schema)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **fit_options) -> DataFrame:
    """`docs` with `held_out boolean`, `score double` (0 to 1) and `predicted int` added (replacing columns so
    called, in upper or lower case). `held_out` is null for a null id. Every row is scored; an empty table gives an empty one."""
    machine = fit(docs, labels, doc_id, text, **fit_options)
    out = scored(docs.select(*[F.col(quoted(c)) for c in others(docs, "held_out", "predicted")]), machine, text)
    return out.withColumns({"held_out": held_out(F.col(quoted(doc_id))), "predicted": (F.col("score") >= 0.5).cast("int")})
