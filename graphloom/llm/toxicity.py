"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel compares two spans of a sentence by their common subsequences of ``LENGTH`` bytes (a mark at
either end of a span counts as one), each weighted by decay to the power of the stretch it covers, so an
insult with a gap or an inserted character stays close to the insult. Sentences take the label of their document; which span makes a
sentence of a toxic document toxic is not labelled, so training alternates between choosing the worst
span of each such sentence and fitting the machine to them. Landmarks make the machine a linear one:
its landmark weights fold into one weight per subsequence, and a span is scored without landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import blocks, hash_spans, judged, marked, mix, sampled, select

LENGTH = 4
STRETCH = 7
DECAY = 0.75
#: Signs put into known insults to train on gapped forms.
GAPS = b"-*._"
#: A token of more bytes is looked at in windows of this size, half a window apart.
WINDOW = 24
#: As many tokens of one or two bytes in a row are also read as one word.
SPELLED = 4

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?\"'()[]{}<>|*#%$&_-~/\\")] = True
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[list(b".!?\n")] = True
#: A document is judged by so many of its worst spans, their margins cut to this stretch.
WORST = 3
LEAST, MOST = -1.0, 1.5
#: Spans whose subsequences are laid out at once, in scoring and against landmarks, and rows added to a fit at once.
_SCORED, _COMPARED, _FITTED = 4_000, 256, 4_096
#: Where training starts: a span is taken for toxic if it is so many times as common under the label.
_CLEAR = 10
_STEPS = [d for d in combinations(range(1, STRETCH), LENGTH - 1)]


@dataclass
class Spans:
    """Spans of a block of documents: where their bytes are in ``data``, and document and sentence of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    sentence: np.ndarray
    hash: np.ndarray

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def _stripped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without up to three punctuation bytes at either end."""
    start, end = start.copy(), end.copy()
    for _ in range(3):
        start += (end > start) & _PUNCTUATION[data[np.minimum(start, len(data) - 1)]]
        end -= (end > start) & _PUNCTUATION[data[np.maximum(end - 1, 0)]]
    return start, end


def spans(column: pa.Array) -> Iterator[tuple[int, int, Spans]]:
    """First row, rows and spans of each block: words in lower case, windows of long ones, spelled-out words."""
    for block in blocks(pc.utf8_lower(column.cast(pa.large_string()))):
        data = block.data
        start, end, doc = block.words()
        if not len(start):
            none = np.zeros(0, np.int64)
            yield block.first, block.n, Spans(data, none, none, none, none, none.astype(np.uint64))
            continue
        # A sentence ends after a word with such a sign at its end, at a line break and with its document.
        ends = _SENTENCE_END[data[end - 1]]
        breaks = np.concatenate(([0], np.cumsum(data == 10)))
        ends[:-1] |= (breaks[start[1:]] > breaks[end[:-1]]) | (doc[1:] != doc[:-1])
        sentence = np.cumsum(ends) - ends
        parts = []
        tokens = _stripped(data, start, end)
        short = tokens[1] - tokens[0] <= WINDOW
        parts.append((tokens[0][short], tokens[1][short], doc[short], sentence[short]))
        if not short.all():
            low, high, of, at = tokens[0][~short], tokens[1][~short], doc[~short], sentence[~short]
            n = -(-(high - low - WINDOW) // (WINDOW // 2)) + 1
            owner = np.repeat(np.arange(len(low)), n)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            a = low[owner] + k * (WINDOW // 2)
            b = np.minimum(a + WINDOW, high[owner])
            for odd in (0, 1):  # windows of one kind do not overlap
                pick = k % 2 == odd
                parts.append((a[pick], b[pick], of[owner[pick]], at[owner[pick]]))
        hashes = [hash_spans(data, p[0], p[1]) for p in parts]
        data, parts, hashes = _spelled(data, tokens, doc, sentence, parts, hashes)
        s, e, d, q = (np.concatenate([p[i] for p in parts]) for i in range(4))
        full = e > s
        yield block.first, block.n, Spans(data, s[full], e[full], d[full], q[full], np.concatenate(hashes)[full])


def _spelled(data, tokens, doc, sentence, parts, hashes):
    """Add the words that runs of very short tokens spell, written behind the block's bytes."""
    start, end = tokens
    tiny = (end - start <= 2) & (end > start)
    # A run ends with its document.
    border = np.concatenate(([True], doc[1:] != doc[:-1], [True]))
    solid = np.concatenate(([False], tiny, [False]))
    opens = np.flatnonzero(tiny & (border[:-1] | ~solid[:-2]))
    shuts = np.flatnonzero(tiny & (border[1:] | ~solid[2:])) + 1
    long = np.flatnonzero(shuts - opens >= SPELLED)
    words, of, at = [], [], []
    for i in long.tolist():
        run = range(opens[i], shuts[i])
        for a in range(run.start, run.stop, SPELLED * 2):  # pieces of a long run overlap by half
            b = min(a + SPELLED * 4, run.stop)
            words.append(b"".join(data[start[k] : end[k]].tobytes() for k in range(a, b)))
            of.append(doc[a])
            at.append(sentence[a])
    if not words:
        return data, parts, hashes
    size = np.array([len(w) for w in words])
    low = len(data) + np.cumsum(size) - size
    data = np.concatenate((data, np.frombuffer(b"".join(words), np.uint8)))
    more = (low, low + size, np.array(of), np.array(at))
    return data, [*parts, more], [*hashes, hash_spans(data, more[0], more[1])]


def _marked(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans alone, one after the other, each with a mark before and behind it."""
    size = end - start + 2
    high = np.cumsum(size)
    low = high - size
    own = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(own)) - low[own] - 1
    inside = (at >= 0) & (at < (end - start)[own])
    out = np.ones(len(own), np.uint8)
    out[inside] = data[(start[own] + at)[inside]]
    return out, low, high


def subsequences(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Span, subsequence (four bytes in one number) and weight of every subsequence occurrence."""
    data, start, end = _marked(data, start, end)
    n = np.maximum(end - start - LENGTH + 1, 0)
    own = np.repeat(np.arange(len(start)), n)
    at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + start[own]
    rest = end[own] - at
    owners, keys, weights = [], [], []
    for steps in _STEPS:
        ok = rest > steps[-1]
        p = at[ok]
        key = data[p].astype(np.uint32)
        for d in steps:
            key = (key << np.uint32(8)) | data[p + d]
        owners.append(own[ok])
        keys.append(key)
        weights.append(np.full(len(p), DECAY ** (steps[-1] + 1 - LENGTH), np.float32))
    return np.concatenate(owners), np.concatenate(keys), np.concatenate(weights)


def _merged(own: np.ndarray, key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal subsequences of a span put together."""
    if not len(own):
        return own, key, weight
    code = (own.astype(np.uint64) << np.uint64(32)) | key
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return own[order][first], key[order][first], np.add.reduceat(weight[order], first)


@dataclass
class Model:
    """Weight of every subsequence that a landmark has, and the numbers that make a margin a probability."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float
    landmarks: list[str]

    def margins(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Margin of every span, never under the bias: a span that shares nothing toxic has the bias."""
        out = np.full(len(start), self.bias, np.float32)
        for a in range(0, len(start), _SCORED):
            own, key, weight = subsequences(data, start[a : a + _SCORED], end[a : a + _SCORED])
            n = min(_SCORED, len(start) - a)
            maybe = self._filter[(key * np.uint32(2654435761)) >> np.uint32(14)]
            at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == key[maybe]
            total = np.bincount(own[maybe][hit], weights=weight[maybe][hit] * self.weights[at[hit]], minlength=n)
            good = total > 0
            keep = good[own]
            own, key, weight = _merged(own[keep], key[keep], weight[keep])
            norm = np.sqrt(np.bincount(own, weights=weight.astype(np.float64) ** 2, minlength=n))
            out[a : a + n][good] = total[good] / norm[good] + self.bias
        return out

    def __post_init__(self):
        self._filter = np.zeros(1 << 18, bool)
        self._filter[(self.keys * np.uint32(2654435761)) >> np.uint32(14)] = True

    def probability(self, worst: np.ndarray) -> np.ndarray:
        """From the margins of each document's worst spans (documents × ``WORST``)."""
        return 1 / (1 + np.exp(-np.clip(worst @ self.slopes + self.shift, -60, 60)))


def worst_margins(doc: np.ndarray, span: np.ndarray, margin: np.ndarray, n: int) -> np.ndarray:
    """The ``WORST`` largest margins of different spans of each document, from ``LEAST`` to ``MOST``."""
    out = np.full((n, WORST), LEAST)
    some = np.flatnonzero(margin > LEAST)
    some = some[np.lexsort((span[some], -margin[some], doc[some]))]
    new = np.ones(len(some), bool)
    new[1:] = (span[some[1:]] != span[some[:-1]]) | (doc[some[1:]] != doc[some[:-1]])
    some = some[new]
    own = doc[some]
    rank = np.arange(len(some)) - np.searchsorted(own, own)
    top = rank < WORST
    out[own[top], rank[top]] = np.minimum(margin[some[top]], MOST)
    return out


def _laid(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Span, subsequence and weight, the weights of a span making a vector of length 1."""
    size = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum(size)
    own, key, weight = _merged(*subsequences(data, end - size, end))
    norm = np.sqrt(np.bincount(own, weights=weight.astype(np.float64) ** 2, minlength=len(words)))
    return own, key, weight / np.maximum(norm, 1e-9)[own]


class Landmarks:
    """Spans that others are compared with; ``table`` has their subsequences (``keys`` × landmarks)."""

    def __init__(self, spans: list[bytes]):
        own, key, weight = _laid(spans)
        self.keys, place = np.unique(key, return_inverse=True)
        self.table = np.zeros((len(self.keys), len(spans)), np.float32)
        self.table[place, own] = weight
        value, vector = np.linalg.eigh(self.kernel(spans).astype(np.float64))
        #: The inverse square root of the landmarks' own kernel makes kernel rows Nyström features.
        self.root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T

    def kernel(self, units: list[bytes]) -> np.ndarray:
        """Normalised kernel of units and landmarks."""
        out = np.zeros((len(units), self.table.shape[1]), np.float32)
        for low in range(0, len(units), _COMPARED):
            own, key, weight = _laid(units[low : low + _COMPARED])
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            own, at, weight = own[hit], at[hit], weight[hit].astype(np.float32)
            if len(own):
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                rows = self.table[at]
                rows *= weight[:, None]
                out[low + own[first]] = np.add.reduceat(rows, first, axis=0)
        return out

    def features(self, kernel: np.ndarray) -> np.ndarray:
        return (kernel @ self.root).astype(np.float32)


def _support_vectors(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss and bias ``LEAST``, by Newton steps.

    With that bias a span that shares nothing with a landmark is a certain negative.
    """
    w = np.zeros(x.shape[1])
    hold = np.diag(np.full(x.shape[1], ridge))
    for _ in range(rounds):
        square, pull = hold.copy(), np.zeros(x.shape[1])
        for low in range(0, len(x), _FITTED):
            xi, yi, ci = x[low : low + _FITTED].astype(np.float64), y[low : low + _FITTED], cost[low : low + _FITTED]
            inside = yi * (xi @ w + LEAST) < 1
            xi, yi, ci = xi[inside], yi[inside], ci[inside]
            square += xi.T @ (xi * ci[:, None])
            pull += xi.T @ (ci * (yi - LEAST))
        new = np.linalg.solve(square, pull)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


@dataclass(frozen=True)
class Training:
    """``positive`` and ``negative``: documents of each label in the sample, taken by the hash of their id.

    Their texts have ``sample_bytes`` together at most, and none an eighth of that: the driver holds them.
    Half of the ``landmarks`` are the spans most tied to the label, half are others.
    """

    positive: int = 1_000
    negative: int = 2_000
    sample_bytes: int = 16_000_000
    landmarks: int = 128
    ridge: float = 1e-4
    rounds: int = 5


def train(documents: DataFrame, marks: DataFrame, settings: Training = Training()) -> Model:
    """Fit the machine to a bounded sample of ``documents`` (doc_id, text) marked 0 or 1 by ``marks`` (doc_id, mark).

    The sample has at most ``settings.positive`` and ``settings.negative`` documents and
    ``settings.sample_bytes`` of text, whatever the size of the tables; it is what the driver holds. Null marks and texts are left out. Without a document of either
    mark every text gets the share of positive ones (0.5 without any) as its score.
    """
    known = marked(documents, marks.select("doc_id", F.col("mark").cast("int").alias("mark")))
    rows = sampled(documents, known, {1: settings.positive, 0: settings.negative}, settings.sample_bytes)
    marks_of = np.array(rows["mark"].to_pylist(), np.int64)
    taken = [rows["text"].filter(pa.array(marks_of == y)).combine_chunks() for y in (1, 0)]
    label = np.concatenate([np.full(len(t), y) for t, y in zip(taken, (1, 0))])
    share = float(label.mean()) if len(label) else 0.5
    plain = Model(np.zeros(1, np.uint32), np.zeros(1), LEAST, np.zeros(WORST), float(np.log((share + 1e-3) / (1 - share + 1e-3))), [])
    if not 0 < label.sum() < len(label):
        return plain

    # Distinct spans, and which of them each sentence has.
    names: dict[int, int] = {}
    units: list[bytes] = []
    unit, sentence, doc = [], [], []
    sentences = 0
    text = pa.concat_arrays([t.combine_chunks() if isinstance(t, pa.ChunkedArray) else t for t in (x.cast(pa.large_string()) for x in taken)])
    for first, _, found in spans(text):
        distinct, at, where = np.unique(found.hash, return_index=True, return_inverse=True)
        place = np.empty(len(distinct), np.int64)
        for i, h in enumerate(distinct.tolist()):
            k = names.setdefault(h, len(names))
            if k == len(units):
                units.append(found.data[found.start[at[i]] : found.end[at[i]]].tobytes())
            place[i] = k
        unit.append(place[where])
        sentence.append(found.sentence + sentences)
        doc.append(found.doc + first)
        sentences += int(found.sentence.max(initial=-1)) + 1
    unit, sentence, doc = np.concatenate(unit), np.concatenate(sentence), np.concatenate(doc)
    usable = np.array([len(u) >= LENGTH for u in units])
    keep = usable[unit]
    unit, sentence, doc = unit[keep], sentence[keep], doc[keep]
    if not len(unit):
        return plain

    pair = np.unique(doc.astype(np.int64) * len(units) + unit)
    in_positive = np.bincount(pair % len(units), weights=label[pair // len(units)] == 1, minlength=len(units))
    in_negative = np.bincount(pair % len(units), weights=label[pair // len(units)] == 0, minlength=len(units))
    n_pos, n_neg = label.sum(), (label == 0).sum()
    odds = np.log((in_positive + 0.25) / (n_pos + 0.5)) - np.log((in_negative + 0.25) / (n_neg + 0.5))
    tied = in_positive * np.maximum(odds, 0) * usable
    half = settings.landmarks // 2
    best = np.argsort(-tied, kind="stable")[:half]
    best = best[tied[best] > 0]
    rest = np.flatnonzero(usable & (in_negative > 0))
    rest = rest[np.argsort(mix(rest.astype(np.uint64)), kind="stable")][:half]
    chosen = list(dict.fromkeys([*best.tolist(), *rest.tolist()]))
    marks = Landmarks([units[i] for i in chosen])

    score = np.where(in_positive > 2, odds - np.log(_CLEAR), -1.0)
    # Fitting starts from the spans that are like a landmark tied to the label, common, or clear.
    near = []
    for at in range(0, len(units), _SCORED):
        like = marks.kernel(units[at : at + _SCORED])[:, : len(best)].max(axis=1, initial=0) > 0.1
        near.append(at + np.flatnonzero(like | (in_negative[at : at + _SCORED] > 5) | (score[at : at + _SCORED] > 0)))
    near = np.concatenate(near)
    size = np.array([len(u) for u in units])
    low = np.cumsum(size) - size
    data = np.frombuffer(b"".join(units), np.uint8)
    # Gapped forms of clear spans: a sign put into them. All forms of a span cost half as much as the span.
    gapped, gap_cost = [], []
    for i in best[score[best] > 0].tolist():
        forms = [units[i][:k] + bytes([sign]) + units[i][k:] for k, sign in zip(range(1, len(units[i])), GAPS * len(units[i]))]
        gapped += forms
        gap_cost += [in_positive[i] / 2 / len(forms)] * len(forms)
    stretched = marks.features(marks.kernel(gapped)) if gapped else np.zeros((0, len(chosen)), np.float32)

    # Negative spans: all of sentences of documents without the label. Positive: the worst of each sentence.
    toxic = label[doc] == 1
    t_unit, t_sentence, t_doc = unit[toxic], sentence[toxic], doc[toxic]
    place = np.full(len(units), -1)
    mapped = np.zeros((0, len(chosen)), np.float32)
    w = np.zeros(len(chosen))
    for _ in range(settings.rounds):
        order = np.lexsort((-score[t_unit], t_sentence))
        lead = order[np.concatenate(([True], t_sentence[order][1:] != t_sentence[order][:-1]))]
        worst = t_unit[lead]
        by_doc = np.full(len(label), -np.inf)
        np.maximum.at(by_doc, t_doc[lead], score[worst])
        taken = worst[(score[worst] > 0) | (score[worst] >= by_doc[t_doc[lead]])]
        positive, times = np.unique(taken, return_counts=True)
        new = np.setdiff1d(np.concatenate((near, positive)), np.flatnonzero(place >= 0))
        place[new] = len(mapped) + np.arange(len(new))
        mapped = np.concatenate([mapped, *(marks.features(marks.kernel([units[i] for i in new[k : k + _SCORED].tolist()])) for k in range(0, len(new), _SCORED))])
        negative = np.flatnonzero((place >= 0) & usable & (in_negative > 0))
        x = np.concatenate((mapped[place[positive]], stretched, mapped[place[negative]]))
        y = np.concatenate((np.ones(len(positive) + len(gapped)), -np.ones(len(negative))))
        # A span costs what the documents cost that it would put on the wrong side.
        cost = np.concatenate((2 * times, gap_cost, in_negative[negative])) / len(label)
        w = _support_vectors(x, y, cost, settings.ridge)
        # All spans are scored; those of documents without the label that are no clear negatives join the fit.
        score = Model(marks.keys, marks.table @ (marks.root @ w), LEAST, np.zeros(WORST), 0.0, []).margins(data, low, low + size)
        near = np.flatnonzero(usable & (in_negative > 0) & (score > LEAST / 2))

    folded = marks.table @ (marks.root @ w)
    used = np.flatnonzero(folded)
    names = [units[i].decode("utf-8", "replace") for i in chosen]
    model = Model(marks.keys[used], folded[used], LEAST, np.zeros(WORST), 0.0, names)
    return _calibrated(model, worst_margins(doc, unit, score[unit], len(label)), label)


def _calibrated(model: Model, worst: np.ndarray, label: np.ndarray) -> Model:
    """Slopes, none under 0, and shift of the logistic curve that fits the labels of the sample, by Newton steps."""
    active = np.ones(WORST, bool)
    while True:
        x = np.concatenate((worst[:, active], np.ones((len(worst), 1))), axis=1)
        theta = np.zeros(x.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -60, 60)))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(len(theta)), x.T @ (label - p) - 1e-2 * theta)
            theta = theta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        if (theta[:-1] >= 0).all():
            break
        active[np.flatnonzero(active)[theta[:-1] < 0]] = False
    model.slopes = np.zeros(WORST)
    model.slopes[active] = theta[:-1]
    model.shift = float(theta[-1])
    return model


class Scorer:
    """Scores texts; margins of spans that it has met are kept in a table of fixed size."""

    SIZE = 1 << 20

    def __init__(self, model: Model):
        self.model = model
        self.known, self.margin_of = np.zeros(self.SIZE, np.uint64), np.full(self.SIZE, LEAST, np.float32)

    def scores(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[str | None]]]:
        """First row, rows, probabilities and worst spans of each block."""
        for first, n, found in spans(texts):
            distinct, at, where = np.unique(found.hash, return_index=True, return_inverse=True)
            slot = (distinct & np.uint64(self.SIZE - 1)).astype(np.int64)
            margin = self.margin_of[slot]
            new = np.flatnonzero(self.known[slot] != distinct)
            margin[new] = self.model.margins(found.data, found.start[at[new]], found.end[at[new]])
            self.known[slot[new]], self.margin_of[slot[new]] = distinct[new], margin[new]
            each = margin[where]
            p = self.model.probability(worst_margins(found.doc, where, each, n))
            worst: list[str | None] = [None] * n
            bad = np.flatnonzero(each > LEAST)
            for i in bad[np.lexsort((found.start[bad], -each[bad], found.doc[bad]))].tolist():
                d = int(found.doc[i])
                if worst[d] is None:
                    worst[d] = found.text(i)
            yield first, n, p, worst


def score(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= ``threshold``) and worst (the span with the largest margin).

    Whole texts are read. Null and empty texts have the lowest score and no worst span. Repeated rows have
    equal results; other columns are ignored; an empty table gives an empty result.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("worst", pa.string())])
        scorer = Scorer(sent.value)
        for batch in batches:
            for first, n, p, worst in scorer.scores(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(worst, pa.string())],
                    schema=schema,
                )

    narrow = select(documents, "doc_id", "text")
    ddl = "doc_id long, score double, predicted int, worst string"
    return narrow.withColumn("doc_id", narrow.doc_id.cast("long")).mapInArrow(run, ddl)


def accepted(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """All columns of the documents whose score is under ``threshold``, under the names they have.

    Each row is judged by its whole text alone: repeated rows stay or go together, and null and empty texts
    have the lowest score. Null doc_ids are rows like others, columns whose names clash are carried by their
    places, and an empty table gives an empty one.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    kept: list[Scorer] = []  # one for each task

    def judge(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        if not kept:
            kept.append(Scorer(sent.value))
        for _, n, p, _ in kept[0].scores(texts):
            yield n, pa.array(p)

    scored, _ = judged(documents, judge, "double")
    return scored.filter(F.col("verdict") < threshold).drop("verdict").toDF(*documents.columns)


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_marks(labels: DataFrame) -> DataFrame:
    """doc_id and mark (labels.toxic) of the labels that training may see."""
    return select(labels, "doc_id", "toxic").filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("mark"))
