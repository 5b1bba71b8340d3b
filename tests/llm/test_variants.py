"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from graphloom.llm import variants
from tests.llm.data import documents, empty, texts

SCHEMA = "doc_id long, text string, DOC_ID string, word string, n long, root string"


def plain_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    form = {}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, others in near.items():
        top = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= 10 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def rows_of(seed: int, n_docs: int):
    rng = random.Random(seed)
    base = ["".join(rng.choice("enatiérÉßxz") for _ in range(rng.randrange(7, 13))) for _ in range(40)]
    base += ["anagramm", "managram", "margaman", "aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "ÿ" * 7, "Àbcdefg×÷h"]
    rows = []
    for d in range(n_docs):
        out = []
        for _ in range(rng.randrange(60)):
            w = base[min(int(rng.expovariate(0.15)), len(base) - 1)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "e", "n", "xq", w[at] * 2]) + w[at + 1 :]
            out.append(w.title() if rng.random() < 0.2 else w)
        rows.append((d if d % 9 else None, rng.choice([" ", "-", ", "]).join(out), "x", "y", 1, "z"))
    return rows + [rows[1], (7, None, "x", "y", 1, "z"), (8, "", "x", "y", 1, "z")]


def got(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(variants.damaged_words(frame)).collect()}


def test_variants_equal_all_pairs(spark):
    rows = rows_of(3, 260)
    words = plain_words([r[:2] for r in rows])
    frame = spark.createDataFrame(rows, SCHEMA)
    found = got(frame)
    want = plain(words)
    assert len(want) > 300 and any(f for _, f, *_ in want)
    assert found == want


def test_any_number_of_levels_and_held_pairs(spark, monkeypatch):
    words = plain_words([r[:2] for r in rows_of(4, 120)])
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    want = {(w, sum(one_edit(w, v) for v in words)) for w in words}
    for levels in (1, 2, 6):
        near = {r.word: r.n_near for r in variants.near_words(frame, levels).collect()}
        assert {(w, near.get(w, 0)) for w in words} == want
    monkeypatch.setattr(variants, "HELD", 7)
    letters = variants._letters([w for w in words if len(w) == 9], 9)
    found = {tuple(sorted((a, b))) for _, x, y in variants.near_pairs(letters, letters[:0], letters[:0]) for a, b in zip(x, y)}
    nine = [w for w in words if len(w) == 9]
    assert found == {(a, b) for a in range(len(nine)) for b in range(a + 1, len(nine)) if one_edit(nine[a], nine[b])}


def test_chains_lead_to_their_root(spark):
    rows = [("abcdefg", 2), ("abcdefgh", 30), ("abcdefghi", 400), ("abcdefghij", 5_000), ("abcdefghijk", 60_000), ("zzzzzzz", 2)]
    out = {r.word: (r.form, r.root) for r in variants.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert out["abcdefg"] == ("abcdefgh", "abcdefghijk") and out["abcdefghijk"] == (None, "abcdefghijk") and out["zzzzzzz"] == (None, "zzzzzzz")


def test_awkward_texts(spark):
    words = plain_words([(i * 3, t) for i, t in enumerate(texts())] + [(None, "a text without an id, of nine words here"), (18, texts()[6]), (33, texts()[11])])
    assert got(documents(spark)) == plain(words)
    assert variants.variants(variants.damaged_words(empty(spark))).count() == 0
    long = ["e" * 5_000, "e" * 5_001, "n" + "e" * 4_999, "e" * 1_500_000]
    frame = spark.createDataFrame([(w, 2) for w in long], "word string, n long")
    near = [r.n_near for r in sorted(variants.variants(frame).collect(), key=lambda r: (len(r.word), r.word))]
    assert near == [2, 1, 1, 0]
