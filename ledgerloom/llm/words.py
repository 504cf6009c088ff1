"""Tokens of whole texts through the words of a text.

The vocabulary's normaliser turns white space into one blank and its splitter drops it, so no token spans ASCII
white space, and special strings hold none: cutting there is safe. A text's tokens are those of its words in order.
A word of plain Latin letters, digits and ASCII signs is cut further into the splitter's own pieces, which the
library's merges then encode; any other word (other scripts, combining marks, special strings) goes through the
whole library. Bounded tables keep what words and pieces gave, each made when it is first looked up. A vocabulary file with another normaliser or splitter, or with
special strings that aren't named below, is used through the library alone, text by text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable

#: Words, and pieces, that a worker keeps before it starts that table anew; from the table before, what still occurs is taken over.
KEPT = 200_000
#: Bytes of text that are encoded together.
BATCH_BYTES = 1_000_000
#: Words whose pieces do not depend on normalisation, if they hold no "<|", as special strings do.
PLAIN = re.compile(r"[!-~À-įı-ſ]{1,200}")
#: The splitter's pattern over such words in lower case.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")

#: The normaliser, splitter and special strings that the above holds for, as vocabulary files state them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
SPECIAL = {"<|startoftext|>", "<|endoftext|>"}


def by_words(path: str) -> bool:
    """Whether a vocabulary file's tokens are those of its words."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    return said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == SPLITTER and {t["content"] for t in said["added_tokens"]} <= SPECIAL


def byte_letters() -> dict[int, str]:
    """For str.translate of Latin-1: the letter by which a byte-level vocabulary shows each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Table(dict):
    """A bounded table of what ``make`` gives for a key, filled by look-ups."""

    def __init__(self, make: Callable, old: dict | None = None):
        self.make, self.old = make, old or {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def renewed(self) -> Table:
        """This table, or where it is full a new one that takes over from it what still occurs."""
        if len(self) <= KEPT:
            return self
        self.old = {}
        return Table(self.make, self)


class Words:
    """word -> what ``of`` makes of lists of ids (with numbers: how many they are), parts put together by ``join``."""

    def __init__(self, path: str, join: Callable, numbers: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.join, self.numbers = Tokenizer.from_file(path), join, numbers
        self.whole.no_truncation()
        self.whole.no_padding()
        self.merges = self.whole.model.tokenize  # the merges alone: no normaliser, no splitter
        self.letters, self.by_words = byte_letters(), by_words(path)
        self.words, self.pieces = Table(self.of_word), Table(self.of_piece)

    def of(self, ids: list[int]) -> object:
        return len(ids) if self.numbers else array("I", ids).tobytes()

    def encode_pieces(self, new: list[str]) -> None:
        for p in new:
            found = self.merges(p if p.isascii() else p.encode().decode("latin-1").translate(self.letters))
            self.pieces[p] = len(found) if self.numbers else array("I", [t.id for t in found]).tobytes()

    def of_piece(self, piece: str) -> object:
        self.encode_pieces([piece])
        return self.pieces[piece]

    def of_word(self, word: bytes) -> object:
        if word.isalpha() and len(word) <= 200:  # ASCII letters alone are one piece
            return self.pieces[word.lower().decode()]
        s = word.decode("utf-8", "replace")
        if PLAIN.fullmatch(s) and "<|" not in s:
            return self.join(map(self.pieces.__getitem__, PIECES.findall(s.lower())))
        return self.of(self.whole.encode_batch_fast([s], add_special_tokens=False)[0].ids)

    def look_up(self, texts: list[bytes]) -> tuple[list[list[bytes]], dict]:
        """The words of each text, and a table that gives each of them, by its ``__getitem__``."""
        if not self.by_words:
            found = self.whole.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [[t] for t in texts], {t: self.of(e.ids) for t, e in zip(texts, found)}
        self.words, self.pieces = self.words.renewed(), self.pieces.renewed()
        return [t.split() for t in texts], self.words


_OPEN: dict[tuple, Words] = {}


def counts(path: str) -> Words:
    """Of this worker: words to their number of tokens."""
    if ("n", path) not in _OPEN:
        _OPEN["n", path] = Words(path, sum, True)
    return _OPEN["n", path]


def ids(path: str) -> Words:
    """Of this worker: words to their ids, as little-endian unsigned 32-bit integers."""
    if ("ids", path) not in _OPEN:
        _OPEN["ids", path] = Words(path, b"".join, False)
    return _OPEN["ids", path]


def by_bytes(texts: Iterable[bytes], most: int = BATCH_BYTES) -> Iterable[list[bytes]]:
    """Lists of texts of about equal bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held
