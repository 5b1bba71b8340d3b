"""Operators that judge each document by itself: cleaning, toxicity, mixing, fingerprints."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, fingerprints, mixing, quality, toxicity
from tests.llm.data import documents, empty, texts, words


def plain_cleaning(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    triples = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    covered = {i + j for i in range(len(found) - 2) if triples[tuple(found[i : i + 3])] > 1 for j in range(3)}
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_cleaning_equals_plain(spark):
    got = quality.clean_lines(documents(spark)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(texts()) + 3
    for i, text in enumerate(texts()):
        r = by_id[i * 3]
        counts = plain_cleaning(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts, text
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.kept and r.base_failed)
    assert quality.clean_lines(empty(spark)).count() == 0


def test_cleaning_rejects_by_line(spark):
    good = " ".join(words(30, 1)) + ".\n" + " ".join(words(40, 2)) + ".\n" + " ".join(words(30, 3)) + "."
    menu = "\n".join(["Home", "About us", "News | Shop | Help | Login"] * 8) + "\n" + " ".join(words(20, 4)) + "."
    some = good + "\nHome\nAll rights reserved by the owner of it."
    rows = spark.createDataFrame([(1, good), (2, menu), (3, some)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.clean_lines(rows).collect()}
    assert got[1].kept and got[1].clean_text == good and got[1].n_lines_removed == 0
    assert not got[2].kept
    assert got[3].kept and got[3].clean_text == good


def test_cleaning_does_not_look_at_neighbours(spark):
    filler = " ".join(words(60, 1)) + ".\n"
    halves = [filler + "and what they said was re", "ad more of it than they had to.\n" + filler, filler + "so please click", " here they stand and look.\n" + filler]
    inside = [filler * 2 + "Spread more joy in all that you do.", filler * 2 + "Now read more of it in all that you do."]
    for texts_ in (halves, inside, [x + "x" for x in inside]):
        rows = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").coalesce(1)
        together = {r.doc_id: tuple(r) for r in quality.clean_lines(rows).collect()}
        for i in range(len(texts_)):
            (alone,) = quality.clean_lines(rows.where(F.col("doc_id") == i)).collect()
            assert tuple(alone) == together[i]
    lines = {r.doc_id: r.n_lines_removed for r in quality.clean_lines(spark.createDataFrame(list(enumerate(inside)), "doc_id long, text string")).collect()}
    assert lines[1] == lines[0] + 1  # "spread more" is no phrase


def test_blocks_cut_at_documents():
    column = pa.array(texts())
    whole = next(common.blocks(column, size=1 << 30))
    found = [b.text(i) for b in common.blocks(column, size=50) for i in range(b.n)]
    assert found == [t or "" for t in texts()] == [whole.text(i) for i in range(whole.n)]
    for b in common.blocks(column.slice(3, 9), size=100):
        start, end, doc = b.words()
        for i in range(b.n):
            mine = [b.data[s:e].tobytes().decode() for s, e in zip(start[doc == i], end[doc == i])]
            assert mine == re.findall(r"[^\x20\x09-\x0D]+", texts()[3 + b.first + i] or "")


def test_hashes_are_of_the_bytes_alone():
    data = np.frombuffer(b"abc abd abc  abcabc", np.uint8)
    start, end = np.array([0, 4, 8, 13, 16]), np.array([3, 7, 11, 16, 19])
    h = common.hash_spans(data, start, end)
    assert h[0] == h[2] == h[3] == h[4] != h[1]
    assert (common.hash_spans(data, start, end, block=4) == h).all()


INSULTS = ["blockhead", "nitwit", "dunderhead", "scoundrel"]


def toxic_corpus(n: int) -> list[tuple[int, str, int]]:
    rows = []
    for i in range(n):
        w = words(60, 1_000 + i, 3_000)
        w[20] += "."
        toxic = i % 5 == 0
        if toxic:
            w[10], w[40] = INSULTS[i // 5 % 4], INSULTS[i // 5 * 3 % 4]
        rows.append((i, " ".join(w), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def machine(spark):
    rows = spark.createDataFrame(toxic_corpus(600), "doc_id long, text string, label int")
    return toxicity.train(rows, toxicity.training_marks(rows.withColumnRenamed("label", "toxic")))


def test_toxicity_held_out(spark, machine):
    rows = toxic_corpus(600)
    truth = {d: y for d, _, y in rows}
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, label int"), machine).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 100
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right >= 0.97 * len(held)


def test_toxicity_tolerates_gaps(machine):
    def margin(text: str) -> float:
        found = next(toxicity.spans(pa.array([text])))[2]
        return float(machine.margins(found.data, found.start, found.end).max(initial=machine.bias))

    plain = margin("w1 w2 w3")
    for form in ("blockhead", "BLOCKHEAD!", "block-head", "bl*ockhead", "b l o c k h e a d", "dunder_head", "blockkhead"):
        assert margin(f"w1 {form} w2") > plain + 0.5, form


def test_toxicity_edges(spark, machine):
    got = toxicity.score(documents(spark), machine).collect()
    assert len(got) == len(texts()) + 3 and all(0 <= r.score <= 1 for r in got)
    lowest = {r.score for r in got if r.doc_id in (0, 3, 6)}
    assert len(lowest) == 1
    assert toxicity.score(empty(spark), machine).count() == 0
    kept = toxicity.accepted(documents(spark), machine)
    assert kept.columns == documents(spark).columns and kept.count() == sum(r.predicted == 0 for r in got)
    nothing = toxicity.train(documents(spark), spark.createDataFrame([(1, None)], "doc_id long, mark int"))
    assert {round(r.score, 3) for r in toxicity.score(documents(spark), nothing).collect()} == {0.5}


def plain_kernel(a: bytes, b: bytes) -> float:
    def vector(span: bytes) -> Counter:
        span, out = b"\x01" + span + b"\x01", Counter()
        for places in combinations(range(len(span)), toxicity.LENGTH):
            stretch = places[-1] - places[0] + 1
            if stretch <= toxicity.STRETCH:
                out[bytes(span[p] for p in places)] += toxicity.DECAY ** (stretch - toxicity.LENGTH)
        return out

    x, y = vector(a), vector(b)
    size = sum(v * v for v in x.values()) ** 0.5 * sum(v * v for v in y.values()) ** 0.5
    return sum(v * y[k] for k, v in x.items()) / size


def test_kernel_and_margins_equal_plain():
    marks = [b"blockhead", b"dunder", b"aaaaaaa", b"w1w2w3"]
    units = [b"block-head", b"blockhead", b"aaaa", b"thunder", b"zzzzzz", "größe".encode(), *(w.encode() * 3 for w in words(600, 3))]
    laid = toxicity.Landmarks(marks)
    want = np.array([[plain_kernel(u, m) for m in marks] for u in units])
    assert np.allclose(laid.kernel(units), want, atol=1e-5)
    assert np.allclose(laid.root @ laid.kernel(marks) @ laid.root, np.eye(len(marks)), atol=1e-3)

    w = np.array([0.9, -0.2, 0.4, 0.1])
    model = toxicity.Model(laid.keys, laid.table @ (laid.root @ w), -1.0, np.zeros(3), 0.0, [])
    end = np.cumsum([len(u) for u in units])
    got = model.margins(np.frombuffer(b"".join(units), np.uint8), end - [len(u) for u in units], end)
    assert np.allclose(got, np.maximum(want @ laid.root @ w, 0) - 1, atol=1e-5)


def test_samples_are_bounded_in_bytes(spark):
    rows = [(i, "x" * (5_000 if i % 7 == 0 else 100)) for i in range(300)] + [(900, None), (901, ""), (5, "again")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = table.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("mark"))
    for most, bound in (({0: 1_000, 1: 1_000}, 8_000), ({0: 20, 1: 10}, 10**9)):
        taken = common.sampled(table, common.marked(table, marks), most, bound)
        size = sum(map(len, taken["text"].to_pylist()))
        assert size <= bound and taken.num_rows <= sum(most.values())
        assert bound > 8_000 or (size > bound - 200 and max(map(len, taken["text"].to_pylist())) <= bound // 8)
        assert set(taken["mark"].to_pylist()) == {0, 1}
    assert common.sampled(empty(spark), common.marked(empty(spark), marks), {0: 5}, 100).num_rows == 0


def test_spelled_words_end_with_their_document():
    """A text has the same spans alone and between texts that end and start with short tokens."""
    text = "they said you are a t o t a l f o o l"
    some = ["so it is I", text, "I am he", text, "It is so", "a b", "c d e f g h"]

    def found(column: list[str]) -> list[list[bytes]]:
        out = [[] for _ in column]
        for first, _, s in toxicity.spans(pa.array(column)):
            for a, b, d in zip(s.start, s.end, s.doc):
                out[first + d].append(s.data[a:b].tobytes())
        return [sorted(x) for x in out]

    assert found(some) == [found([t])[0] for t in some]
    assert any(b"fool" in w for w in found([text])[0])


def test_mixing_reaches_targets(spark):
    rows = [(i, " ".join(f"{'abc'[i % 10 // 4]}{k}" for k in words(50, i, 50)), "abc"[i % 10 // 4]) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    marks = table.select("doc_id", F.col("domain").alias("mark"))
    got = mixing.document_rates(table, marks, {"a": 1, "b": 1, "c": 2}, upper=10.0).collect()
    total = sum(r.n_tokens for r in got)
    share = [sum(r.n_tokens * r.rate * r.posteriors[j] for r in got) / total for j in range(3)]
    assert np.allclose(share, [0.25, 0.25, 0.5], atol=0.01)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 and abs(sum(r.posteriors) - 1) < 1e-6 for r in got)
    assert np.mean([max(range(3), key=lambda j: r.posteriors[j]) == r.doc_id % 10 // 4 for r in got]) > 0.95
    more = mixing.mixed(table.select("doc_id", "text"), marks, {"a": 1, "b": 1, "c": 2}, lower=1.0, total=None)
    counts = Counter(r.doc_id for r in more.collect())
    assert set(counts) == set(range(400)) and max(counts.values()) > 1


def test_mixing_of_rare_domains(spark):
    """Rates are at their optimum for domains of any share: 0.2 % and 1 % of the tokens, posteriors hard or soft."""
    wanted, ridge = np.array([0.9, 0.08, 0.02]), 1e-3
    names, targets = ["good", "low_quality", "toxic"], dict(zip(["good", "low_quality", "toxic"], [0.9, 0.08, 0.02]))
    for rare, mixed, total in ((2, False, 1.0), (10, False, 1.0), (2, True, 1.0), (2, True, None), (2, False, None)):
        own = np.repeat([0, 1, 2], [1000 - 50 - rare, 50, rare])
        p = np.eye(3)[own]
        if mixed:
            p = 0.8 * p + 0.2 * np.random.default_rng(1).dirichlet(np.ones(3) / 2, 1000)
        n = np.full(1000, 50) + (np.arange(1000) % 3 if mixed else 0)
        laid = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, posteriors array<double>")
        low = 0.0 if total else 1.0
        fit = mixing.fit_rates(laid, names, targets, low, 4.0, total)
        rates, mass = fit.rates(p), n @ p / n.sum()
        goal = wanted * (total or min(4.0, max(1.0, *(mass / wanted))))
        gradient = (n * rates) @ p / n.sum() - goal
        assert np.allclose(rates, np.clip(1 - p @ gradient / ridge, low, 4.0), atol=1e-3)
        if not mixed:
            assert np.allclose(rates, np.clip((ridge + goal) / (ridge + mass), low, 4.0)[own], atol=1e-3)


def test_mixing_rates_equal_plain_projection():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(3), 50)
    fit = mixing.Fit(rng.normal(0, 0.2, (7, 3)), 0.5, 0.01, 0.2, 3.0)
    for row, rate in zip(p, fit.rates(p)):
        r = 1.0
        for g in fit.gradients:
            r = min(3.0, max(0.2, r - 0.5 * (row @ g + 0.01 * (r - 1))))
        assert abs(r - rate) < 1e-12


def test_mixing_edges(spark):
    labelled = spark.createDataFrame([(9, "a"), (18, "b"), (0, "b"), (21, None), (None, "a"), (7, "a")], "doc_id long, mark string")
    got = mixing.document_rates(documents(spark), labelled, {"a": 1, "b": 1, "unknown": 5})
    assert got.count() == len(texts()) + 3
    assert mixing.document_rates(empty(spark), labelled, {"a": 1}).count() == 0
    assert mixing.document_rates(documents(spark), labelled.limit(0), {"a": 1}).count() == len(texts()) + 3
    assert mixing.mixed(documents(spark), labelled, {"a": 1, "b": 1}, lower=1.0).columns == documents(spark).columns


def test_fingerprints_equal_plain(spark):
    docs = documents(spark)
    bands = fingerprints.Bands(low_share=0.0, high_share=0.5)
    lexicon = fingerprints.lexicon(docs, bands)
    counts = Counter(w for t in [r.text for r in docs.collect()] for w in set(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))))
    assert len(lexicon) == sum(2 <= n <= 0.5 * docs.count() for n in counts.values())
    got = fingerprints.compare_neighbours(docs, lexicon, bands).collect()
    assert len(got) == docs.count()
    order = sorted(((-(1 << 63) if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()))
    edited = Counter()
    for (key, text), (_, after) in zip(order, order[1:] + order[:1]):
        edited[(None if key < 0 else key, hashlib.sha256((text[: len(text) - len(text) // 2] + after[: len(text) // 2]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == edited
    prints = {}
    for r in got:
        prints.setdefault(dict(order).get(r.doc_id, r.doc_id), set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for t, p in prints.items() if isinstance(t, str))
    alone = fingerprints.fingerprints(docs, lexicon, bands)
    assert {(r.doc_id, r.fingerprint) for r in alone.collect()} == {(r.doc_id, r.fingerprint) for r in got}


def test_fingerprints_over_many_runs(spark, monkeypatch):
    rows = [(i, " ".join(words(40, i // 2))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    lexicon = fingerprints.lexicon(docs)
    one = {tuple(r) for r in fingerprints.compare_neighbours(docs, lexicon).collect()}
    monkeypatch.setattr(fingerprints, "RUN_DOCS", 7)
    assert {tuple(r) for r in fingerprints.compare_neighbours(docs, lexicon).collect()} == one
    near = {r[0]: r[6] for r in one}
    assert all(near[i] == 1.0 for i in range(0, 60, 2)) and np.mean([near[i] for i in range(1, 60, 2)]) < 0.3
    assert fingerprints.compare_neighbours(empty(spark), lexicon).count() == 0
    single = spark.createDataFrame([(5, "abcd ef")], "doc_id long, text string")
    r = fingerprints.compare_neighbours(single, lexicon).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdabc").hexdigest()
