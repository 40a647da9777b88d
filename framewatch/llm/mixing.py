"""Mixing to target weights with soft domain membership.

A linear classifier over hashed words, fitted to a labelled table, gives every
document a posterior over domains. Nonnegative rates per document are then fitted
by projected gradient least squares so that the expected tokens of each domain
(rate x tokens x posterior, summed over all documents) meet their targets. A
gradient step needs only the totals by domain: each task folds the steps since the
rates were last written into its documents' rates, sums, and sends a row for each
domain; the driver holds as many numbers as there are domains.
"""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from framewatch.llm.common import kept, slices, texts, widened
from framewatch.llm.words import Words, mix, words

#: Labelled rows that the classifier is fitted to (in expectation).
SAMPLE = 3000
#: Hashed features: words and word endings share these buckets.
BUCKETS = 1 << 14
EPOCHS, RATE, RIDGE = 60, 0.3, 1e-3
#: Gradient steps at most, the distance from a target (as a share of it) that is near enough.
STEPS, TOLERANCE = 200, 1e-3


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray  # bucket x domain
    bias: np.ndarray


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two buckets of each word: by its hash and by its first and last bytes with its length."""
    size = w.ends - w.starts
    shape = w.data[w.starts].astype(np.uint64) if len(size) else np.zeros(0, np.uint64)
    shape = shape * np.uint64(256) + (w.data[w.ends - 1].astype(np.uint64) if len(size) else shape)
    shape = shape * np.uint64(16) + np.minimum(size, 15).astype(np.uint64)
    mask = np.uint64(BUCKETS - 1)
    return (w.hashes & mask).astype(np.int64), (mix(shape + np.uint64(1 << 40)) & mask).astype(np.int64)


def logits(w: Words, model_weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Mean of the features' weights over the words of each text, and the bias; an empty text has the bias alone."""
    a, b = features(w)
    total = np.zeros((len(a) + 1, len(bias)))
    np.cumsum(model_weights[a] + model_weights[b], axis=0, out=total[1:])
    n = np.maximum(1, np.diff(w.offsets))[:, None]
    return (total[w.offsets[1:]] - total[w.offsets[:-1]]) / n + bias


def softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def sparse(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each text (bucket), their shares of its words, and where each text's begin: BUCKETS at most, however long it is."""
    w = words(column)
    row = np.concatenate([w.row_of_word()] * 2)
    key, times = np.unique(row * BUCKETS + np.concatenate(features(w)), return_counts=True)
    row = key // BUCKETS
    return (key % BUCKETS).astype(np.int32), (times / np.maximum(1, np.diff(w.offsets))[row]).astype(np.float32), np.searchsorted(row, np.arange(len(column) + 1))


def train(bucket: np.ndarray, value: np.ndarray, offsets: np.ndarray, target: np.ndarray, domains: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the softmax by Adam on the sparse features of some texts."""
    row = np.repeat(np.arange(len(target)), np.diff(offsets))
    used, bucket = np.unique(bucket, return_inverse=True)
    by_bucket = np.argsort(bucket, kind="stable")
    bucket_cut = np.searchsorted(bucket[by_bucket], np.arange(len(used)))
    full = np.diff(offsets) > 0
    weights, bias = np.zeros((len(used), domains), np.float32), np.log((np.bincount(target, minlength=domains) + 0.5) / (len(target) + 0.5 * domains))
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    hot = np.eye(domains)[target]
    value = value[:, None]
    for step in range(1, EPOCHS + 1):
        x = np.zeros((len(target), domains), np.float32)
        if len(row):
            x[full] = np.add.reduceat(weights[bucket] * value, offsets[:-1][full], axis=0)
        error = ((softmax(x + bias) - hot) / len(target)).astype(np.float32)
        grad = RIDGE * weights / len(target)
        if len(row):
            grad += np.add.reduceat((error[row] * value)[by_bucket], bucket_cut, axis=0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        weights -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        bias -= 2.0 * error.sum(axis=0)
    every = np.zeros((BUCKETS, domains))
    every[used] = weights
    return every, bias


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Classifier:
    """A classifier from (text, domain, doc_id) rows; rows with a null domain are left out. About ``sample`` of them, by a hash, are used, in one task, which gets a bounded number of features a row."""
    known = labelled.filter(F.col("domain").isNotNull())
    counts = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
    domains = sorted(counts)
    if not domains:
        return Classifier([], np.zeros((BUCKETS, 0)), np.zeros(0))
    n = sum(counts.values())
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", "domain"), F.lit(1 << 20)) * F.lit(n) < F.lit(sample << 20)).select("text", "domain", F.lit(1).alias("one"))

    number = {d: i for i, d in enumerate(domains)}

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bucket, value, offsets = sparse(texts(batch.column("text")))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (bucket, value)]
            yield pa.RecordBatch.from_arrays([batch.column("one"), pa.array([number[d] for d in batch.column("domain").to_pylist()], pa.int32()), *lists], names=["one", "target", "bucket", "value"])

    def learn(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        bucket, value = (part.column(c).combine_chunks() for c in ("bucket", "value"))
        offsets = np.concatenate([[0], np.cumsum(bucket.value_lengths().to_numpy())])
        found = train(bucket.flatten().to_numpy(), value.flatten().to_numpy(), offsets, part.column("target").to_numpy(), len(domains))
        return pa.table({"w": pa.array([pickle.dumps(found)], pa.binary())})

    got = chosen.mapInArrow(reduced, "one int, target int, bucket array<int>, value array<float>").groupBy("one").applyInArrow(learn, "w binary").collect()
    if not got:
        share = np.array([counts[d] for d in domains], float)
        return Classifier(domains, np.zeros((BUCKETS, len(domains))), np.log(share / share.sum()))
    return Classifier(domains, *pickle.loads(got[0].w))


def posteriors(docs: DataFrame, model: Classifier, keys: list[str]) -> DataFrame:
    """``keys``, n_tokens and ``posterior`` (one number per domain, in the model's order) of every whole text; a null text counts as empty."""
    rows = docs.select(*dict.fromkeys([*keys, "text"]))
    schema = widened(docs.select(*keys), n_tokens="long").add("posterior", ArrayType(DoubleType()))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        d = len(model.domains)
        for batch in slices(batches, "text"):
            w = words(texts(batch.column("text")))
            p = softmax(logits(w, model.weights, model.bias)) if d else np.zeros((batch.num_rows, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * d, pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(np.diff(w.offsets)), lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def rates(p: np.ndarray, steps: list[np.ndarray], begin: np.ndarray) -> np.ndarray:
    """Rates after the steps: each goes down the gradient and back to nonnegative."""
    r = begin.copy()
    for s in steps:
        r = np.maximum(0.0, r - p @ s)
    return r


def _moved(steps: list[np.ndarray], d: int):
    """Rows with their rates after the steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array(rates(_matrix(batch, d), steps, batch.column("rate").to_numpy()))
            yield batch.set_column(batch.schema.get_field_index("rate"), "rate", new)

    return run


def solve(table: DataFrame, targets: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, np.ndarray]:
    """``table`` (n_tokens, posterior, rate, more) with rates that bring the expected tokens by domain to ``targets``, and the totals that they reach.

    Least squares of (total - target) / sqrt(mass of the domain) in the metric of
    tokens; posteriors sum to 1, so a step of 1 never overshoots. Targets that no
    nonnegative rates meet are met as nearly as ``steps`` steps come, with a warning.
    Each pass takes all steps anew from the posteriors, reads no other column and
    writes nothing; rows are gone through once more in the end.
    """
    d = len(targets)

    def totals(table: DataFrame, taken: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(d)
            for batch in batches:
                p = _matrix(batch, d)
                total += (rates(p, taken, batch.column("rate").to_numpy()) * batch.column("n_tokens").to_numpy()) @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(total)], names=["d", "x"])

        got = np.zeros(d)
        for r in table.select("n_tokens", "posterior", "rate").mapInArrow(run, "d int, x double").groupBy("d").agg(F.sum("x").alias("x")).collect():
            got[r.d] = r.x
        return got

    taken: list[np.ndarray] = []
    now = mass = totals(table, taken)
    near = lambda: (np.abs(now - targets) <= tolerance * np.maximum(targets, 1)).all()
    for _ in range(steps):
        if near():
            break
        taken.append((now - targets) / np.maximum(mass, 1e-9))
        now = totals(table, taken)
    if not near():
        warnings.warn(f"expected tokens {now.tolist()} stay off the targets {targets.tolist()} after {steps} steps", stacklevel=2)
    return table.mapInArrow(_moved(taken, d), table.schema), now


def mix_to_targets(docs: DataFrame, model: Classifier, weights: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """``keys`` (by default all columns), n_tokens, posterior, rate, domain, gap for every document.

    ``weights``: share of all tokens that each domain should have; a domain
    without one keeps what is left in proportion to its mass. The total stays as it
    is. domain is the likeliest (null if none was learned), gap the greatest distance
    of a domain's expected tokens from its target, as a share of it (0 without
    domains). A column of ``docs`` with one of these names is kept with ``in_``
    before it. A null text is empty: it has no tokens, the posterior of the bias,
    and a rate as any other. Repeated rows each have a row.
    """
    own = ("n_tokens", "posterior", "rate", "domain", "gap")
    keys = list(keys or docs.columns)
    for name in own:
        if name in keys:
            free = f"in_{name}"
            while free in docs.columns:
                free = f"in_{free}"
            docs, keys = docs.withColumnRenamed(name, free), [free if k == name else k for k in keys]
    table = kept(posteriors(docs, model, keys).withColumn("rate", F.lit(1.0)), "posteriors")
    d = len(model.domains)
    gap = 0.0
    if d:
        sums = table.select("n_tokens", F.posexplode("posterior").alias("d", "p")).groupBy("d").agg(F.sum(F.col("n_tokens") * F.col("p")).alias("x")).collect()
        mass = np.zeros(d)
        for r in sums:
            mass[r.d] = r.x
        want = np.array([weights.get(x, np.nan) for x in model.domains])
        free = np.isnan(want)
        left = max(0.0, 1 - np.nansum(want))
        want[free] = left * mass[free] / max(mass[free].sum(), 1e-9)
        targets = want * mass.sum()
        table, reached = solve(table, targets)
        gap = float((np.abs(reached - targets) / np.maximum(targets, 1)).max())
    names = F.array(*map(F.lit, model.domains)).cast("array<string>")
    return table.withColumn("domain", F.get(names, (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))).withColumn("gap", F.lit(gap))


def labelled_domains(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, text, domain) of about ``size`` labelled documents; the domain is the language and the labelled quality. That many ids are broadcast.

    Rows without a language or a label are left out; of several labels of a doc_id the greatest counts.
    """
    known = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_q"))
    n = known.count()
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * F.lit(n) < F.lit(size << 20))
    return docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.concat("lang", F.when(F.col("_q") == 1, "/good").otherwise("/poor")).alias("domain"))


def even_languages(domains: list[str], poor: float = 0.1) -> dict[str, float]:
    """Equal shares for all languages, ``poor`` of each for its poor texts (where it has both)."""
    langs = sorted({d.rpartition("/")[0] for d in domains})
    out = {}
    for d in domains:
        lang, _, kind = d.rpartition("/")
        both = f"{lang}/good" in domains and f"{lang}/poor" in domains
        out[d] = (1 / len(langs)) * ((poor if kind == "poor" else 1 - poor) if both else 1)
    return out
