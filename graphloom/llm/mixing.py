"""Mixing sources to target weights: soft memberships and fitted document rates.

A softmax classifier of hashed words, trained on a labelled table, gives every document posteriors over
domains. Document rates (how often a document is to be seen) are then fitted by projected-gradient least
squares: the expected tokens of each domain, rates times tokens times posteriors summed over all
documents, are brought to the target weights. At the optimum all rates follow from the gradient of the
domains' sums, one number per domain, by one projected step from 1; Newton steps look for that gradient,
each by a pass over the table that returns sums per domain and per two domains. No rate is stored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import blocks, hash_spans, judged, marked, sampled, select, stored

#: Hash places of words, and of the shapes of words (signs, capitals and length).
FEATURES = 1 << 12
SHAPES = 1 << 9
#: Documents whose features are held at once.
_ROWS = 512


@dataclass(frozen=True)
class Classifier:
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray
    scale: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.scale) @ self.weights + self.bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


_KIND = np.zeros(256, np.uint64)
_KIND[[*range(97, 123)]] = 1
_KIND[[*range(65, 91)]] = 2
_KIND[[*range(48, 58)]] = 3
_KIND[[*range(128, 256)]] = 4
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 5


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of each block, their words, and the square roots of the shares of hashed words and word shapes."""
    for block in (b for at in range(0, len(column), _ROWS) for b in blocks(column.slice(at, _ROWS))):
        start, end, doc = block.words()
        n = block.n
        count = np.bincount(doc, minlength=n)
        x = np.zeros((n, FEATURES + SHAPES), np.float32)
        if len(start):
            word = (hash_spans(block.data, start, end) % np.uint64(FEATURES)).astype(np.int64)
            first, last = _KIND[block.data[start]], _KIND[block.data[end - 1]]
            size = np.minimum(end - start, 12).astype(np.uint64)
            shape = ((first * np.uint64(6) + last) * np.uint64(13) + size).astype(np.int64) % SHAPES
            flat = np.bincount(doc * FEATURES + word, minlength=n * FEATURES).reshape(n, FEATURES)
            x[:, :FEATURES] = np.sqrt(flat / np.maximum(count, 1)[:, None])
            flat = np.bincount(doc * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
            x[:, FEATURES:] = np.sqrt(flat / np.maximum(count, 1)[:, None])
        yield n, count, x


def train(documents: DataFrame, marks: DataFrame, per_domain: int = 1_000, ridge: float = 1e-3, steps: int = 300) -> Classifier:
    """Fit the classifier to the ``documents`` (doc_id, text) whose domain ``marks`` (doc_id, mark) tells.

    At most ``per_domain`` documents of each domain, taken by the hash of their id, are the sample that the
    driver holds; the prior of each domain is its share of all marked documents. Null domains and texts are
    left out. Without marked documents there is one domain, "all".
    """
    known = marked(documents, marks.select("doc_id", F.col("mark").cast("string").alias("mark")))
    sizes = {r["mark"]: r["n"] for r in known.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sampled(documents, known, {d: per_domain for d in sorted(sizes)})
    found = np.array(rows["mark"].to_pylist(), str)
    domains = sorted(set(found.tolist()))
    if not domains:
        return Classifier(["all"], np.zeros((FEATURES + SHAPES, 1), np.float32), np.zeros(1), np.ones(FEATURES + SHAPES, np.float32))
    y = np.searchsorted(domains, found).tolist()
    sets = [x for _, _, x in features(rows["text"])]
    x, y = np.concatenate(sets), np.array(y)
    prior = np.array([sizes[d] for d in domains], float)
    prior /= prior.sum()
    # Sampled rows count for as many as they stand for.
    cost = (prior / np.bincount(y, minlength=len(domains)))[y]
    scale = 1 / np.sqrt((x**2).mean(axis=0) + 1e-4)
    scale = (scale / np.sqrt(((x * scale) ** 2).sum(axis=1).mean())).astype(np.float32)
    x *= scale
    w, b = _softmax(x, y, cost, len(domains), ridge, steps)
    return Classifier(domains, w, b, scale)


def _softmax(x: np.ndarray, y: np.ndarray, cost: np.ndarray, k: int, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights by accelerated gradient steps."""
    w, b = np.zeros((x.shape[1], k), np.float32), np.zeros(k)
    ahead_w, ahead_b, momentum = w, b, 1.0
    target = np.eye(k)[y]
    rate = 1 / (0.5 * float((cost * ((x**2).sum(axis=1) + 1)).sum()) + ridge)
    for _ in range(steps):
        z = x @ ahead_w + ahead_b
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        error = ((p - target) * cost[:, None]).astype(np.float32)
        new_w = ahead_w - rate * (x.T @ error + ridge * ahead_w)
        new_b = ahead_b - rate * error.sum(axis=0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / after
        ahead_w, ahead_b = new_w + np.float32(pull) * (new_w - w), new_b + pull * (new_b - b)
        w, b, momentum = new_w, new_b, after
    return w, b


def memberships(documents: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, n_tokens (words) and posteriors (one number per domain) of every row; whole texts are read."""
    sent = documents.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_tokens", pa.int64()), ("posteriors", pa.list_(pa.float64()))])
        for batch in batches:
            at = 0
            for n, count, x in features(batch.column(2)):
                p = sent.value.posteriors(x).astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(count), lists], schema=schema)
                at += n

    narrow = select(documents, "doc_id", "text")
    keyed = narrow.select(narrow.doc_id.cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return keyed.mapInArrow(run, "doc_id long, key long, n_tokens long, posteriors array<double>")


@dataclass(frozen=True)
class Fit:
    """What turns a document's posteriors into its rate: projected steps with these gradients, starting from 1."""

    gradients: np.ndarray
    step: float
    ridge: float
    lower: float
    upper: float

    def rates(self, posteriors: np.ndarray) -> np.ndarray:
        r = np.clip(np.ones(len(posteriors)), self.lower, self.upper)
        for g in self.gradients:
            r = np.clip(r - self.step * (posteriors @ g + self.ridge * (r - 1)), self.lower, self.upper)
        return r


def _posteriors(batch: pa.RecordBatch, column: int, k: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def fit_rates(
    laid: DataFrame, domains: list[str], targets: Mapping[str, float], lower: float = 0.0, upper: float = 10.0,
    total: float | None = 1.0, ridge: float = 1e-3, steps: int = 40, tolerance: float = 1e-3,
) -> Fit:
    """Least squares for rates between ``lower`` and ``upper``, none negative.

    Minimises the squared distance of the domains' expected tokens (as shares of all tokens) from
    ``total`` times the target weights, plus ``ridge`` (above 0) times the token-weighted squared distance
    of rates from 1. A ``total`` of None is the least, up to ``upper``, at which no domain has to lose tokens.

    A gradient fits if it is that of the rates it gives. Newton steps, shortened where they go too far, bring
    it there: they scale with the mass of each domain, so rare ones arrive with the others. They stop when the
    projected gradient of no rate is off by more than ``tolerance`` times ``ridge``, which bounds the token-weighted
    distance of all rates from their optimum by ``tolerance``. Each pass sums k * k + k + 1 numbers on the
    executors; should ``steps`` passes not do, there is a warning.
    """
    if ridge <= 0:
        raise ValueError("ridge is above 0")
    k = len(domains)
    tokens, *mass = laid.agg(F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * F.col("posteriors")[j]) for j in range(k)]).first()
    tokens = float(tokens or 0) or 1.0
    wanted = np.array([max(0.0, targets.get(d, 0.0)) for d in domains], float)
    wanted /= wanted.sum() or 1.0
    if total is None:
        need = [(m or 0.0) / tokens / w for m, w in zip(mass, wanted) if w]
        total = min(upper, max([1.0, *need]))
    wanted *= total
    narrow = laid.select("n_tokens", "posteriors")

    def fitted(gradient: np.ndarray) -> Fit:
        # A step of 1 / ridge leads to clip(1 - posteriors @ gradient / ridge) from anywhere.
        return Fit(gradient[None, :], 1 / ridge, ridge, lower, upper)

    def tried(gradient: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, slope and curvature of the dual, which is least at the gradient that fits."""
        fit = fitted(gradient)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = np.zeros(k + k * k + 1)
            for batch in batches:
                n, p = batch.column(0).to_numpy(), _posteriors(batch, 1, k)
                r = fit.rates(p)
                free = (r > lower) & (r < upper)
                got[:k] += (n * r) @ p
                got[k:-1] += ((n[free, None] * p[free]).T @ p[free]).ravel() / ridge
                got[-1] += n @ (r * (p @ gradient) + ridge / 2 * (r - 1) ** 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got))), pa.array(got)], names=["place", "part"])

        parts = narrow.mapInArrow(sums, "place long, part double").groupBy("place").agg(F.sum("part").alias("part")).collect()
        now = np.zeros(k + k * k + 1)
        for row in parts:
            now[row["place"]] = row["part"] / tokens
        value = gradient @ gradient / 2 + wanted @ gradient - now[-1]
        return float(value), gradient + wanted - now[:k], np.eye(k) + now[k:-1].reshape(k, k)

    at = np.zeros(k)
    value, slope, curve = tried(at)
    way, length = -np.linalg.solve(curve, slope), 1.0
    for _ in range(steps):
        if np.abs(slope).max() <= tolerance * ridge:
            break
        ahead = at + length * way
        there, rise, bend = tried(ahead)
        down, after = float(way @ slope), float(way @ rise)
        # Where values differ by rounding alone, the slope tells.
        level = abs(after) <= abs(down) / 2 and there <= value + 1e-12 * (1 + abs(value))
        if there <= value + 1e-4 * length * down or level:
            at, value, slope, curve = ahead, there, rise, bend
            way, length = -np.linalg.solve(curve, slope), 1.0
        else:
            length *= min(0.5, max(0.1, down / (down - after)))
    if (off := float(np.abs(slope).max())) > tolerance * ridge:
        warnings.warn(f"rates are not at their optimum after {steps} passes: a gradient is off by {off:.2g}", stacklevel=2)
    return fitted(at)


def _copies(rate, *seed) -> F.Column:
    """The rate as a whole number: one more than its integer part with the probability of the rest, decided by a hash."""
    chance = F.pmod(F.xxhash64(*seed, F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("int")


def document_rates(
    documents: DataFrame, marks: DataFrame, targets: Mapping[str, float], lower: float = 0.0, upper: float = 10.0,
    total: float | None = 1.0,
) -> DataFrame:
    """doc_id, n_tokens, posteriors, rate and copies of every row, for ``targets`` (domain: weight).

    ``marks`` (doc_id, mark) tells the domains of some documents. Posteriors are in alphabetical order of the
    domains; a target of an unknown domain is left out. copies is the rate as a whole number, rounded up or down by a
    hash of doc_id and text, so that a row that is computed again gets the same. Null and empty texts have
    no tokens. Repeated rows have equal results. Other columns are ignored; an empty table gives an empty
    result.
    """
    classifier = train(documents, marks)
    laid = stored(memberships(documents, classifier), "memberships")
    fit = fit_rates(laid, classifier.domains, targets, lower, upper, total)
    k = len(classifier.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rate = pa.array(fit.rates(_posteriors(batch, 3, k)))
                yield pa.RecordBatch.from_arrays([*batch.columns, rate], names=["doc_id", "key", "n_tokens", "posteriors", "rate"])

    rated = laid.mapInArrow(run, "doc_id long, key long, n_tokens long, posteriors array<double>, rate double")
    return rated.select("doc_id", "n_tokens", "posteriors", "rate", _copies(F.col("rate"), "doc_id", "key").alias("copies"))


def mixed(
    documents: DataFrame, marks: DataFrame, targets: Mapping[str, float], lower: float = 0.0, upper: float = 10.0,
    total: float | None = 1.0,
) -> DataFrame:
    """All rows of ``documents``, each as often as ``document_rates`` says, with all their columns.

    The rate of a row follows from its text, so no row is joined with its rate and nothing is shuffled.
    """
    classifier = train(documents, marks)
    laid = stored(memberships(documents, classifier), "memberships")
    fit = fit_rates(laid, classifier.domains, targets, lower, upper, total)

    def judge(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        for n, _, x in features(texts):
            yield n, pa.array(fit.rates(classifier.posteriors(x).astype(np.float64)))

    rated, (doc_id, text) = judged(documents, judge, "double")
    copies = _copies(F.col("verdict"), F.col(doc_id).cast("long"), F.xxhash64(text))
    often = rated.withColumn("copies", copies).filter("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), "copies")))
    return often.drop("verdict", "copies").toDF(*documents.columns)


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and mark (toxic, low_quality or good) by the labels of each document."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality").when(F.col("quality") == 1, "good")
    return select(labels, "doc_id", "quality", "toxic").select("doc_id", domain.alias("mark"))
