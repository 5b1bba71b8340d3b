"""Quality rules: line-first cleaning.

Every line of a text is judged by itself; lines that fail are taken out, and a document that
loses too much of its text by that is rejected. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import BLANK, Block, blocks, hash_spans, select, windows

#: Phrases of lines that frame a text and do not belong to it.
BOILERPLATE = [
    "all rights reserved",
    "cookie policy",
    "accept cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "click here",
    "read more",
    "share this",
    "sign up for",
    "subscribe to our",
    "lorem ipsum",
    "skip to content",
    "back to top",
]

#: Characters counted as symbols, and those that a sentence may end with.
SYMBOLS = "#*$%&|<>"
TERMINAL = ".!?:;\"')…”»"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Last byte of each sign that may end a sentence (the last byte of a larger character is enough to tell it here).
_TERMINAL = np.zeros(256, bool)
_TERMINAL[[c.encode()[-1] for c in TERMINAL]] = True
_START = np.array([b < 0x80 or b >= 0xC0 for b in range(256)])

OUTPUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
    ("n_lines", pa.int64()), ("n_lines_removed", pa.int64()), ("n_words_removed", pa.int64()), ("clean_text", pa.string()),
])


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the document rule.

    A line with a word fails if: it has more than ``symbols_per_word`` symbols per word; more than
    ``upper_share`` of its ASCII letters are capitals and it has ``shouting_words`` words or more; it
    has fewer than ``short_words`` words and no sign that ends a sentence (navigation); one word makes
    up more than ``same_word_share`` of ``same_words`` words or more; it has a phrase of
    ``BOILERPLATE`` as whole words; or it equals an earlier line. A document is rejected if more than ``lost_share``
    of its words are in failed lines.
    """

    symbols_per_word: float = 0.5
    upper_share: float = 0.5
    shouting_words: int = 4
    short_words: int = 4
    same_word_share: float = 0.4
    same_words: int = 10
    lost_share: float = 0.5
    min_words: int = 50
    repeat_share: float = 0.5


def _lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every line of the block's non-empty documents."""
    breaks = np.flatnonzero(block.data == 10)
    filled = np.flatnonzero(block.offsets[1:] > block.offsets[:-1])
    starts = np.concatenate((block.offsets[filled], breaks + 1))
    docs = np.concatenate((filled, np.searchsorted(block.offsets, breaks, "right") - 1))
    # A text that ends with a line break has an empty last line; it starts where the next document does.
    order = np.lexsort((docs, starts))
    starts, docs = starts[order], docs[order]
    ends = np.sort(np.concatenate((breaks, block.offsets[filled + 1])))
    return starts, ends, docs


def _count(index: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, minlength=n)


def measure(block: Block, rules: LineRules) -> dict[str, np.ndarray]:
    """Counts and verdicts for every document of a block, and the spans of its failed lines."""
    data, n = block.data, block.n
    w_start, w_end, w_doc = block.words()
    w_hash = hash_spans(data, w_start, w_end)
    n_words = _count(w_doc, n)
    solid = ~BLANK[data]
    out = {
        "n_words": n_words,
        "word_chars": block.per_document(solid & _START[data]),
        "n_symbols": block.per_document(_SYMBOL[data]),
    }

    # Words in three-word windows that occur twice or more in their document.
    h, first = windows(w_hash, w_doc, 3)
    order = np.lexsort((h, w_doc[first]))
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        a, b = order[1:], order[:-1]
        twin = (h[a] == h[b]) & (w_doc[first[a]] == w_doc[first[b]])
        same[a[twin]] = True
        same[b[twin]] = True
    edge = np.zeros(len(w_doc) + 1, np.int64)
    np.add.at(edge, first[same], 1)
    np.add.at(edge, first[same] + 3, -1)
    out["n_repeat_words"] = np.bincount(w_doc, weights=np.cumsum(edge)[:-1] > 0, minlength=n).astype(np.int64)

    l_start, l_end, l_doc = _lines(block)
    n_lines = len(l_start)
    w_line = np.searchsorted(l_start, w_start, "right") - 1
    l_words = _count(w_line, n_lines)
    used = l_words > 0
    # Equal lines: the earlier of two is the one that comes first in the document.
    l_hash = hash_spans(data, l_start, l_end)
    pick = np.flatnonzero(used)
    order = pick[np.lexsort((pick, l_hash[pick], l_doc[pick]))]
    again = np.zeros(n_lines, bool)
    a, b = order[1:], order[:-1]
    again[a[(l_hash[a] == l_hash[b]) & (l_doc[a] == l_doc[b])]] = True
    out["n_dup_lines"] = _count(l_doc[again], n)

    def per_line(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return total[l_end] - total[l_start]

    symbols, upper, letters = per_line(_SYMBOL[data]), per_line(_UPPER[data]), per_line(_LETTER[data])
    last = np.zeros(n_lines, np.int64)
    last[w_line] = w_end - 1  # words are in order: the last one of each line stays
    ends_well = np.zeros(n_lines, bool)
    ends_well[used] = _TERMINAL[data[last[used]]]
    # How often the most frequent word of each line occurs.
    order = np.lexsort((w_hash, w_line))
    common = np.zeros(n_lines, np.int64)
    if len(order):
        new = np.ones(len(order), bool)
        new[1:] = (w_hash[order[1:]] != w_hash[order[:-1]]) | (w_line[order[1:]] != w_line[order[:-1]])
        run = np.flatnonzero(new)
        np.maximum.at(common, w_line[order[run]], np.diff(np.concatenate((run, [len(order)]))))
    framed = np.zeros(n_lines, bool)
    # Each document by itself: a phrase lies in one document, and its edges are judged inside it.
    raw, offsets = data.tobytes(), block.offsets.tolist()
    at = [low + m.start() for low, high in zip(offsets, offsets[1:]) for m in _PHRASES.finditer(raw[low:high])]
    framed[np.searchsorted(l_start, np.array(at, np.int64), "right") - 1] = True

    failed = used & (
        (symbols > rules.symbols_per_word * l_words)
        | ((upper > rules.upper_share * letters) & (l_words >= rules.shouting_words))
        | ((l_words < rules.short_words) & ~ends_well)
        | ((common > rules.same_word_share * l_words) & (l_words >= rules.same_words))
        | framed
        | again
    )
    lost = np.bincount(l_doc[failed], weights=l_words[failed], minlength=n).astype(np.int64)
    out["n_lines"], out["n_lines_removed"], out["n_words_removed"] = _count(l_doc[used], n), _count(l_doc[failed], n), lost
    out["base_failed"] = (n_words < rules.min_words) | (out["n_repeat_words"] > rules.repeat_share * n_words)
    out["kept"] = ~out["base_failed"] & ~(lost > rules.lost_share * n_words)
    out["_bad"] = np.flatnonzero(failed)
    out["_lines"] = (l_start, l_end, l_doc)
    return out


#: The phrases as whole words; bytes of larger characters count as letters.
_PHRASES = re.compile(rb"(?<![A-Za-z0-9\x80-\xff])(?:" + "|".join(map(re.escape, BOILERPLATE)).encode() + rb")(?![A-Za-z0-9\x80-\xff])", re.IGNORECASE)


def _cleaned(block: Block, found: dict) -> list[str]:
    """Each text without its failed lines."""
    l_start, l_end, l_doc = found["_lines"]
    bad = set(found["_bad"].tolist())
    whole = np.ones(block.n, bool)
    whole[l_doc[found["_bad"]]] = False
    bounds = np.searchsorted(l_doc, np.arange(block.n + 1))
    raw = block.data.tobytes()
    out = []
    for i in range(block.n):
        if whole[i]:
            out.append(block.text(i))
            continue
        good = [k for k in range(bounds[i], bounds[i + 1]) if k not in bad]
        out.append(b"\n".join(raw[l_start[k] : l_end[k]] for k in good).decode("utf-8", "replace"))
    return out


def clean_lines(documents: DataFrame, rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """Judge every document line by line.

    Returns one row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_lines (lines with a word), n_lines_removed, n_words_removed and, unless
    ``with_text`` is off, clean_text (the text without its failed lines).

    Null and empty texts have no word: all counts are 0, base_failed is true, clean_text is empty.
    Repeated rows and null doc_ids give one result each. Texts of any length are read whole. Other
    columns are ignored. An empty table gives an empty result.
    """
    schema = OUTPUT if with_text else pa.schema(list(OUTPUT)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = measure(block, rules)
                columns = {"doc_id": batch.column(0).slice(block.first, block.n)}
                columns |= {k: pa.array(v) for k, v in found.items() if k[0] != "_"}
                if with_text:
                    columns["clean_text"] = pa.array(_cleaned(block, found), pa.string())
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    kinds = {"int64": "long", "bool": "boolean", "string": "string"}
    ddl = ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema)
    narrow = select(documents, "doc_id", "text")
    return narrow.withColumn("doc_id", narrow.doc_id.cast("long")).mapInArrow(run, ddl)
