"""Spelling variants: words one edit apart, found in tries over the words' letter-group counts.

A word becomes a vector: how often it has a letter of each group, group after group. Two words of one edit differ
by a surplus of one at most and a deficit of one at most in these counts. Vectors are arranged as a trie, one
level a group; a depth-first search walks it with that budget, and the words of the leaves it reaches are verified.

The trie is dealt out by length and first counts. A word is stored in its own part and visits the parts that its
budget can reach, so no part is compared with another and a part is as small as ``levels`` makes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import select, stored

#: Letters counted together, the most telling first; all letters not named here form one more group.
LETTER_GROUPS = ("e", "n", "a", "t", "i", "o", "r", "h", "s", "u", "l", "c", "d", "bfgmp", "jkqvwxyz")
#: Words in an average part of the trie that the number of dealt levels aims at.
PART_WORDS = 4_000
#: Steps of a search, and pairs of words, that are held at once.
HELD = 400_000
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_GROUP = np.full(256, len(LETTER_GROUPS), np.uint8)
for _i, _letters in enumerate(LETTER_GROUPS):
    _GROUP[np.frombuffer(_letters.encode(), np.uint8)] = _i
_N = len(LETTER_GROUPS) + 1


# ------------------------------------------------------------------ words


def damaged_words(documents: DataFrame, every: int = 31, shortest: int = 7, least: int = 2) -> DataFrame:
    """word and n: letter runs of all texts, some with one letter taken out, that have ``shortest`` letters and occur ``least`` times.

    Runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased. Where ``every`` divides h, the crc32 of ``<doc_id>:<run>``, the
    letter h % length is deleted. A null doc_id counts as an empty one, a null text as no text.
    """
    docs = select(documents, "doc_id", "text").filter("text is not null")
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.explode(F.regexp_extract_all(F.translate("text", _CAPITALS, _SMALL), F.lit("[a-z\\u00C0-\\u00FF]+"), F.lit(0))).alias("run"),
    ).filter(F.length("run") >= shortest)
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    rest = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, rest).otherwise(F.col("run"))
    named = runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= shortest)
    return named.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


# ------------------------------------------------------------------ parts of the trie


def _letters(words: pa.Array | pd.Series, length: int) -> np.ndarray:
    """One row of letter codes for each word; all have ``length`` letters, each of one byte in Latin-1."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, length)


def _vectors(letters: np.ndarray, groups: int = _N) -> np.ndarray:
    found = _GROUP[letters]
    return np.stack([(found == g).sum(axis=1, dtype=np.int32) for g in range(groups)], axis=1)


def _packed(counts: np.ndarray) -> np.ndarray:
    """The first counts as one number; counts beyond 1,023 share a part, which the search tells apart again."""
    key = np.zeros(len(counts), np.int64)
    for k in range(counts.shape[1]):
        key = key * 1024 + np.minimum(counts[:, k], 1023)
    return key


def dealt(words: DataFrame, levels: int) -> DataFrame:
    """Rows (length, part, home, word, n): each word in its own part, and in those that it has to visit.

    A word looks for words of its length that have one letter more of an earlier and one less of a later group, and for
    words one letter shorter: each pair is met once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("word"), batch.column("n")
            sizes = pa.compute.utf8_length(words).to_numpy()
            for length in np.unique(sizes):
                at = np.flatnonzero(sizes == length)
                taken, times = words.take(pa.array(at)), n.take(pa.array(at))
                counts = _vectors(_letters(taken.to_pylist(), int(length)), levels)
                steps = [(0, True, None, None)]  # difference of the length, own part, group with more, group with fewer
                steps += [(0, False, up, None) for up in range(levels)]
                steps += [(0, False, up, down) for up in range(levels) for down in range(up + 1, levels)]
                steps += [(1, False, None, None), *((1, False, None, down) for down in range(levels))]
                emitted: list[tuple[int, np.ndarray]] = []
                for shorter, home, up, down in steps:
                    moved = counts.copy()
                    if up is not None:
                        moved[:, up] += 1
                    if down is not None:
                        moved[:, down] -= 1
                    ok = (moved >= 0).all(axis=1) & (moved.sum(axis=1) <= length - shorter)
                    key = _packed(moved)
                    for was, other in emitted:  # counts beyond what a key tells apart: one visit is enough
                        ok &= (key != other) | (was != shorter)
                    emitted.append((shorter, np.where(ok, key, -1)))
                    index = pa.array(np.flatnonzero(ok))
                    size = np.full(len(index), length - shorter, np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(size), pa.array(key[ok]), pa.array(np.full(len(index), home)), taken.take(index), times.take(index)],
                        names=["length", "part", "home", "word", "n"],
                    )

    return words.select("word", "n").mapInArrow(run, "length int, part long, home boolean, word string, n long")


class Trie:
    """Distinct count vectors in order; a level's nodes are numbered, a child is found by its parent and count."""

    def __init__(self, vectors: np.ndarray):
        self.rows, self.leaf = np.unique(vectors, axis=0, return_inverse=True)
        self.leaf = self.leaf.ravel()
        self.base = int(self.rows.max(initial=0)) + 3
        node, self.levels = np.zeros(len(self.rows), np.int64), []
        for k in range(self.rows.shape[1]):
            keys, node = np.unique(node * self.base + self.rows[:, k], return_inverse=True)
            node = node.ravel().astype(np.int64)
            self.levels.append(keys)

    def reach(self, vectors: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(vector, leaf) pairs: budget 2 has a surplus and, after it, a deficit of one; budget 1 the deficit alone."""
        if not len(self.rows):
            return
        stack = [(0, np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.full(len(vectors), budget, np.int8))]
        while stack:
            k, q, node, left = stack.pop()
            if not len(q):
                continue
            if k == len(self.levels):
                done = left != 1  # a surplus without its deficit, or a word as long as the leaf's
                yield q[done], node[done]
                continue
            if len(q) > HELD:
                half = len(q) // 2
                stack += [(k, q[half:], node[half:], left[half:]), (k, q[:half], node[:half], left[:half])]
                continue
            keys, count = self.levels[k], vectors[q, k]
            parts = []
            for change, may, then in ((0, None, None), (1, 2, 1), (-1, 1, 0)):
                some = np.arange(len(q)) if may is None else np.flatnonzero(left == may)
                wanted = count[some] + change
                ok = wanted >= 0 if change < 0 else wanted < self.base
                some = some[ok]
                key = node[some] * self.base + wanted[ok]
                child = np.searchsorted(keys, key)
                hit = child < len(keys)
                hit[hit] = keys[child[hit]] == key[hit]
                some, child = some[hit], child[hit]
                parts.append((q[some], child, left[some] if then is None else np.full(len(some), then, np.int8)))
            stack.append((k + 1, *(np.concatenate(c) for c in zip(*parts))))


def _halves(letters: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the first letters, or the others, are equal."""

    def numbered(part: np.ndarray) -> np.ndarray:
        if not part.shape[1]:
            return np.zeros(len(part), np.int64)
        rows = np.ascontiguousarray(part).view([("", f"V{part.shape[1]}")]).ravel()
        return np.unique(rows, return_inverse=True)[1].ravel()

    return numbered(letters[:, :first]), numbered(letters[:, first:])


def _expanded(a: np.ndarray, b: np.ndarray, groups_a, groups_b) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of words of pairs of vectors, some at a time."""
    (order_a, start_a, size_a), (order_b, start_b, size_b) = groups_a, groups_b
    total = np.cumsum(size_a[a] * size_b[b])
    low = 0
    while low < len(a):
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + 4 * HELD, "right")))
        x, y = a[low:high], b[low:high]
        each = size_a[x] * size_b[y]
        at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        x, y = np.repeat(x, each), np.repeat(y, each)
        yield order_a[start_a[x] + at // size_b[y]], order_b[start_b[y] + at % size_b[y]]
        low = high


def _grouped(leaf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.bincount(leaf, minlength=n)
    return np.argsort(leaf, kind="stable"), np.cumsum(size) - size, size


def near_pairs(home: np.ndarray, same: np.ndarray, longer: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pairs of rows one edit apart: (0, home, home), (1, same, home) and (2, longer, home)."""
    trie = Trie(_vectors(home))
    at_home = _grouped(trie.leaf, len(trie.rows))
    length = home.shape[1]
    first = length // 2
    head, tail = _halves(np.concatenate([home, same]), first)
    for kind, asking, budget in ((0, home, 2), (1, same, 2), (2, longer, 1)):
        if not len(asking):
            continue
        if kind == 2:
            own = np.concatenate([home, asking[:, :length]])
            heads = _halves(own, first)[0]
            tails = _halves(np.concatenate([home[:, first:], asking[:, first + 1 :]]), 0)[1]
            head_h, head_q, tail_h, tail_q = heads[: len(home)], heads[len(home) :], tails[: len(home)], tails[len(home) :]
        else:
            skip = 0 if kind == 0 else len(home)
            head_h, tail_h, head_q, tail_q = head[: len(home)], tail[: len(home)], head[skip:], tail[skip:]
        vectors, number = np.unique(_vectors(asking), axis=0, return_inverse=True)
        of_vector = _grouped(number.ravel(), len(vectors))
        for q, leaf in trie.reach(vectors, budget):
            for a, b in _expanded(q, leaf, of_vector, at_home):
                # One edit leaves the letters before or after the middle as they are.
                alike = (head_q[a] == head_h[b]) | (tail_q[a] == tail_h[b])
                if kind == 0:
                    alike &= (trie.leaf[a] != trie.leaf[b]) | (a < b)
                a, b = a[alike], b[alike]
                step = max(1, 8_000_000 // length)
                for low in range(0, len(a), step):
                    x, y = a[low : low + step], b[low : low + step]
                    if kind == 2:
                        begin = np.cumprod(asking[x, :length] == home[y], axis=1, dtype=np.uint8).sum(axis=1)
                        end = np.cumprod((asking[x, 1:] == home[y])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1)
                        ok = begin.astype(int) + end >= length
                    else:
                        ok = (asking[x] != home[y]).sum(axis=1) == 1
                    yield kind, x[ok], y[ok]


def _near_of_part(part: pd.DataFrame) -> pd.DataFrame:
    """Per word of a part that has near words in it: their number and the most frequent of them, ties to the least."""
    length = int(part["length"].iloc[0])
    sizes = part["word"].str.len()
    tables = [part[part["home"]], part[~part["home"] & (sizes == length)], part[sizes > length]]
    words = np.concatenate([t["word"].to_numpy(object) for t in tables])
    n = np.concatenate([t["n"].to_numpy() for t in tables])
    start = np.cumsum([0, *map(len, tables)])
    letters = [_letters(t["word"], length + (i == 2)) for i, t in enumerate(tables)]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for kind, a, b in near_pairs(*letters):
        left.append(a + start[kind])
        right.append(b)
    a, b = np.concatenate(left), np.concatenate(right)
    word, near = np.concatenate([a, b]), np.concatenate([b, a])
    place = np.empty(len(words), np.int64)
    place[np.argsort(words)] = np.arange(len(words))
    order = np.lexsort((place[near], -n[near], word))
    word, near = word[order], near[order]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([first, [len(word)]]))
    return pd.DataFrame({"word": words[word[first]], "n_near": times, "best_n": n[near[first]], "best": words[near[first]]})


def near_words(words: DataFrame, levels: int | None = None) -> DataFrame:
    """word, n_near, best and best_n of each word (word, n; distinct, Latin-1 letters) that has near words.

    ``best`` is the near word of largest n, the least in code-point order among equals.
    """
    if levels is None:
        # Each dealt count tells about three values apart, the length about eight.
        levels, parts, n = 4, 8 * 3**4, words.count()
        while n > parts * PART_WORDS and levels < 6:
            levels, parts = levels + 1, parts * 3
    found = dealt(words, levels).groupBy("length", "part").applyInPandas(_near_of_part, "word string, n_near long, best_n long, best string")
    # At most one row for each part that a word is in or visits.
    gathered = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.collect_list(F.struct((-F.col("best_n")).alias("m"), "best")).alias("all"))
    return gathered.select("word", "n_near", F.array_min("all").alias("top")).select("word", "n_near", "top.best", (-F.col("top.m")).alias("best_n"))


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table (word, n) of distinct words.

    ``form`` is the near word of largest n if that n is ``times`` the word's own at least, else null; ``root`` is where
    the forms lead to, the word itself without one. Words without near words have n_near 0. An empty table gives an empty one.
    """
    kept = stored(select(words, "word", "n").select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(kept).withColumnRenamed("word", "w")
    joined = kept.join(near, F.col("word") == F.col("w"), "left")
    is_form = F.col("best_n") >= times * F.col("n")
    forms = stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    # Every step multiplies n, so chains are short; each round doubles how far they are followed.
    links = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = links.select(F.col("word").alias("mid"), F.col("root").alias("further"))
        followed = stored(links.join(on, F.col("root") == F.col("mid"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        links = followed.select("word", "root")
        if followed.filter("moved").isEmpty():
            break
    roots = links.withColumnRenamed("word", "w")
    out = forms.join(roots, F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
