"""Token ids of whole texts, with every distinct word encoded once per worker.

A byte-pair tokenizer cuts a text at blanks before it merges, so the ids of a text are the ids of
its words one after the other. ``Encoder`` asks the tokenizers library for each word only when it
is new; texts in which a cut at blanks could matter are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from unicodedata import is_normalized

from tokenizers import Tokenizer

from graphloom.llm.common import trim

#: Words kept per generation; at most two generations are held.
KNOWN_WORDS = 150_000
_AROUND = re.compile(r"\s \s")
_OTHER_BLANKS = [chr(n) for n in range(0x3001) if chr(n).isspace() and chr(n) not in " \n"]
#: A sign between a letter or number and a blank is a piece of its own; so is a line break between other characters.
_SIGN = re.compile(r"(?<=[A-Za-z0-9])([.,!?;:])(?=[ \n]|$)")
_BREAK = re.compile(r"(?<=\S)\n(?=\S)")
_ENCODERS: dict[tuple, Encoder] = {}


def _byte_characters() -> dict[int, str]:
    """How byte-level models show bytes: printable Latin-1 characters as they are, the others in order from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


def _blanks_matter(text: str) -> bool:
    """Whether a blank stands at an end or beside another one (or a zero character is taken)."""
    if "  " in text or "\0" in text or text[:1] == " " or text[-1:] == " ":
        return True
    if " \n" in text or any(c in text for c in _OTHER_BLANKS):
        return _AROUND.search(text) is not None
    return False


_SHOWN = _byte_characters()


class Encoder:
    """``encode`` gives the ids of texts as little-endian unsigned 32-bit bytes.

    ``plain_specials`` treats the strings of special tokens as ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.added = [t["content"] for t in told["added_tokens"]]
        self.mode = self._mode(told)
        self.piece = self.tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _mode(told: dict) -> str:
        """How texts may be cut at blanks: a blank opens the next word, or is dropped; otherwise they are not cut."""
        normalizer, first = told.get("normalizer"), told.get("pre_tokenizer") or {}
        if normalizer is None and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space"):
            return "opens"
        steps = first.get("pretokenizers", [])
        kinds = [n["type"] for n in (normalizer or {}).get("normalizers", [])]
        if steps and steps[0]["type"] == "Split" and steps[0].get("invert") and set(kinds) <= {"NFC", "Replace", "Lowercase"}:
            return "dropped"
        return "whole"

    @classmethod
    def of(cls, path: str, plain_specials: bool = False) -> Encoder:
        """One encoder per worker process."""
        key = (path, plain_specials)
        if key not in _ENCODERS:
            _ENCODERS[key] = cls(path, plain_specials)
        return _ENCODERS[key]

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _cut(self, text: str) -> list[str] | None:
        """The words of a text under the keys they are known by; None if it must be encoded whole.

        Signs behind words are words of their own. Where a blank opens a word, a word without one is known with
        a zero character before it; where blanks are dropped, case is as well, and A-Z become small at once.
        """
        if any(a in text for a in self.added):
            return None
        if self.mode == "dropped":
            small = text.encode().lower().decode()
            return _SIGN.sub(r" \1", small).replace("\n", " ").split(" ")
        if self.mode == "opens" and not _blanks_matter(text):
            if "\n" in text:
                alone = not ("\n\n" in text or " \n" in text or "\n " in text or text[0] == "\n" or text[-1] == "\n")
                alone = alone and not any(c in text for c in _OTHER_BLANKS)
                text = text.replace("\n", " \0\n \0") if alone else _BREAK.sub(" \0\n \0", text)
            return ("\0" + _SIGN.sub(" \0\\1", text)).split(" ")
        return None

    def _ask(self, words: list[str]) -> list[bytes]:
        """Ids of words; words of letters alone are one piece that the model takes without the steps before it."""
        opens = self.mode == "opens"
        out: list[bytes] = [b""] * len(words)
        odd = []
        for i, word in enumerate(words):
            bare, blank = (word[1:], "") if opens and word[:1] == "\0" else (word, " " if opens else "")
            if bare.isalpha() and (opens or bare.isascii() or (bare == bare.lower() and is_normalized("NFC", bare))):
                shown = bare if bare.isascii() else bare.encode().decode("latin-1").translate(_SHOWN)
                out[i] = array("I", [t.id for t in self.piece("Ġ" + shown if blank else shown)]).tobytes()
            else:
                odd.append((i, blank + bare))
        for (i, _), ids in zip(odd, self.whole([text for _, text in odd])):
            out[i] = ids
        return out

    def _learn(self, words: set[str]) -> None:
        """Add ``words`` to the known ones."""
        known, older = self.words, self.older
        known.update([(w, older[w]) for w in words if w in older])
        ask = [w for w in words if w not in older]
        known.update(zip(ask, self._ask(ask)))

    def forget(self) -> None:
        """Drop the known words, at the end of a task: the worker goes on to other work."""
        self.words, self.older = {}, {}
        trim()

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(t) for t in texts]
        out: list[bytes] = [b""] * len(texts)
        odd = [i for i, words in enumerate(cut) if words is None]
        for i, ids in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = ids
        if len(self.words) > KNOWN_WORDS:
            self.older, self.words = self.words, {}
        known = self.words
        new: set[str] = set()
        for words in cut:
            if words is not None:
                new.update(words)
        new.difference_update(known)
        if new:
            self._learn(new)
        for i, words in enumerate(cut):
            if words is not None:
                out[i] = b"".join(map(known.__getitem__, words))
        return out
