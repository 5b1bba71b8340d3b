"""Near duplicates and repeated passages against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import components, partenum, substrings
from tests.llm.data import documents, empty, words


def plain_sets(rows):
    out = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append((doc_id, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def plain_components(rows) -> Counter:
    sets = plain_sets(rows)
    big = (1 << 63) - 1
    parent = {d if d is not None else big: d if d is not None else big for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a if a is not None else big), root(b if b is not None else big)))
                parent[q] = p
    real = lambda v: None if v == big else v
    return Counter((d, len(s), real(root(d if d is not None else big)) if s else d) for d, s in sets)


def found(df) -> Counter:
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def edited(base: list[str], n: int, rng: random.Random) -> list[str]:
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.random()}"
    return out


def test_near_duplicates_of_awkward_rows(spark):
    docs = documents(spark)
    assert found(partenum.near_duplicates(docs)) == plain_components([(r.doc_id, r.text) for r in docs.collect()])
    assert partenum.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [64, 3])
def test_near_duplicates_equal_plain(spark, monkeypatch, hot):
    """Chains of edits, groups at the threshold, and a passage in many documents, whose buckets are hot."""
    monkeypatch.setattr(partenum, "HOT", hot)
    rng = random.Random(5)
    passage = words(40, 77)
    rows = []
    for g in range(6):
        base = words(rng.choice([8, 30, 90, 200]), g)
        for _ in range(12):
            rows.append(edited(base, rng.randrange(0, max(2, len(base) // 18)), rng))
        for _ in range(5):
            base = edited(base, max(1, len(base) // 60), rng)
            rows.append(base)
    for k in range(40):
        rows.append(words(12, 500 + k) + passage + words(rng.randrange(1, 12), 900 + k))
    rng.shuffle(rows)
    table = [(i, " ".join(w)) for i, w in enumerate(rows)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    want = plain_components(table)
    assert len({c for _, _, c in want}) < len(want) - 20
    assert found(partenum.near_duplicates(docs)) == want


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 400), st.floats(0, 1), st.floats(0, 1), st.integers(0, 1 << 30))
def test_alike_sets_share_signatures(size, part, side, seed):
    """The guarantee, with slack to spare: alike sets share signatures in more than ``slack`` first-level partitions."""
    rng = np.random.default_rng(seed)
    bands = partenum.Bands()
    a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
    gone = int(part * len(a) / 4)
    new = int(side * gone)
    b = np.unique(np.concatenate((a[gone - new :], rng.integers(0, 1 << 63, new, dtype=np.uint64))))
    common = len(np.intersect1d(a, b))
    if not len(b) or 100 * common < 80 * (len(a) + len(b) - common) or np.array_equal(a, b):
        return
    assert partenum.least_differences(partenum.sketch(a), partenum.sketch(b)) <= len(a) + len(b) - 2 * common
    shared = np.intersect1d(partenum.signatures(a, bands), partenum.signatures(b, bands))
    band = Counter((shared >> np.uint64(56)).tolist())
    assert any(n > bands.schemes[k][3] for k, n in band.items())


def test_sizes_that_can_be_alike_are_in_one_band():
    bands = partenum.Bands()
    for n in range(1, 3_000):
        own = set(bands.of(n))
        assert all(low <= n <= high for low, high in (bands.edges[k] for k in own))
        for m in range(n, min(3_000, n * 100 // 80) + 1, max(1, n // 40)):
            assert own & set(bands.of(m)), (n, m)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(400, k) for k in range(401, 450)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    assert {(r.node, r.component) for r in got.collect()} == {(x, root(x)) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_repeats(rows, threshold: int) -> Counter:
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    starts = defaultdict(list)
    for k, (_, w) in enumerate(split):
        for i in range(len(w) - threshold + 1):
            starts[tuple(w[i : i + threshold])].append((k, i))
    gone = defaultdict(set)
    for places in starts.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + threshold))
    out = Counter()
    for k, (d, w) in enumerate(split):
        kept = " ".join(x for i, x in enumerate(w) if i not in gone[k])
        out[(d, len(w), len(gone[k]), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def removed(df) -> Counter:
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_repeats_of_awkward_rows(spark):
    docs = documents(spark)
    assert removed(substrings.remove_repeats(docs)) == plain_repeats([(r.doc_id, r.text) for r in docs.collect()], 35)
    assert substrings.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("threshold, seed", [(6, 3), (10, 4), (35, 8)])
def test_repeats_equal_plain(spark, threshold, seed):
    rng = random.Random(threshold)
    passages = [words(rng.randrange(threshold - 2, threshold * 2), 50 + k) for k in range(6)]
    rows = []
    for i in range(60):
        w = words(rng.randrange(0, 60), 1_000 + i, 30 if i % 3 else 3)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w = w[:at] + rng.choice(passages) + w[at:]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(100, rows[3][1]), (101, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.remove_repeats(docs, threshold, seed)
    assert removed(got) == plain_repeats(rows, threshold)
    for r in got.collect():
        assert hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text)).encode()).hexdigest() == r.kept_sha256


def test_texts_without_repeats_keep_their_columns(spark):
    passage = " ".join(words(40, 3))
    rows = [(1, f"Start here.\n{passage} and the end.", "en", 0), (2, f"{passage}", "fr", 0), (3, "a  b\nc", "de", 0), (4, None, "es", 0), (5, f"x {passage}\n", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r for r in substrings.without_repeats(docs).collect()}
    assert set(got) == {1, 3, 4, 5}
    assert got[1].text == "Start here.\nand the end." and got[1].lang == "en" and got[1].n_chars == 24
    assert got[3].text == "a  b\nc" and got[5].text == "x "
    assert got[4].text is None and got[4].n_chars == 0 and got[4].lang == "es"
    clash = documents(spark)
    kept = substrings.without_repeats(clash)
    assert kept.columns == clash.columns
    assert sum(r.text is None for r in kept.select("text").collect()) == sum(r.text is None for r in clash.select("text").collect()) > 0


def test_rows_without_id_link_by_their_texts_only(spark):
    a, b = " ".join(words(80, 31)), " ".join(words(80, 32))
    rows = [(1, a), (None, a), (None, b), (2, b), (None, "quite another text of nine words in all here"), (None, None)]
    got = partenum.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    named = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert named == {1: 1, 2: 2} and len(got) == len(rows)
    assert sorted((r.component_id or 0) for r in got if r.doc_id is None) == [0, 0, 1, 2]
