"""Cuts of a text at which byte-level and piece tokenizers both start anew, and ids that are remembered between the cuts.

A position between a character other than white space and a space is such a cut: the pattern of a byte-level tokenizer never
matches across it, and a vocabulary of pieces without a space behind another character never merges across it. A text
is then the concatenation of units, and what was worked out for a unit can be remembered: units repeat as words do.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers
import regex

#: White space before a space or at the end: such a text is cut by the careful pattern.
ODD = re.compile(r"\s |\s\Z")
ODD_ASCII = [c + " " for c in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"]
CUT = re.compile(r"(?<=\S)(?= (?!\Z))")
#: A longer unit is not remembered: few of them repeat, and their length has no bound.
LONGEST = 256
#: Characters whose classes are the same in every Unicode version: the pattern is applied here, others go to the library.
SAFE = re.compile("[\n\x20-\x7e\xa1-ɏ]*").fullmatch
#: One of these behind a word is a pre-token of its own.
MARKS = frozenset(".,;:!?")


def units(text: str) -> tuple[str, list[str]]:
    """The first unit of ``text``, and the others without the space that each of them starts with."""
    odd = text[-1:].isspace() or any(map(text.__contains__, ODD_ASCII)) if text.isascii() else ODD.search(text)
    parts = CUT.split(text) if odd else text.split(" ")
    return parts[0], [p[1:] for p in parts[1:]] if odd else parts[1:]


class Memo(dict):
    """What ``work`` gives for a key, kept in two generations of at most ``room`` keys; the older goes when the younger is full."""

    def __init__(self, room: int, work: Callable):
        super().__init__()
        self.room, self.work, self.old = room, work, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        if len(key) <= LONGEST:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class UnitTokenizer:
    """Ids of whole texts by the tokenizers library, asked once per distinct pre-token.

    For a byte-level tokenizer of the public pattern the library's model gets each pre-token alone; any other tokenizer gets whole texts.
    With ``special`` the strings of special tokens are those tokens, as the library does by default, else they are plain text.
    """

    def __init__(self, spec: str, special: bool = True, room: int = 700_000):
        read = json.loads(spec)
        before = read.get("pre_tokenizer") or {}
        self.spec, self.as_tokens, self.room, self.tool = spec, special, room, None
        self.special = [t["content"] for t in read.get("added_tokens", [])] if special else []
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not read.get("normalizer") and read["model"].get("type") == "BPE"
        self._load()
        self.dtype = np.dtype("<u2" if self.tool.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("model", "find", "letters", "spaced", "bare")} | {"tool": None}

    def _load(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for one task
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_str(self.spec)
        self.tool.encode_special_tokens = not self.as_tokens
        self.model, self.find = self.tool.model, regex.compile(public_tokenizers.PATTERN).findall
        self.letters = {b: c for c, b in byte_values().items()}
        self.spaced = Memo(self.room, lambda part: self._unit(" " + part))
        self.bare = Memo(self.room // 10, self._unit)

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        if unit.isascii() and unit[1:].isalpha() and unit[0] == " ":
            return self._bytes([t.id for t in self.model.tokenize("Ġ" + unit[1:])])
        if not SAFE(unit):
            return self._bytes(self.tool.encode(unit, add_special_tokens=False).ids)
        if unit[-1:] in MARKS and unit[0] == " " and unit[1:-1].isalpha():
            return self.spaced[unit[1:-1]] + self.bare[unit[-1]]
        pieces = [unit] if unit[:1] == " " and unit[1:].isalpha() else self.find(unit)
        if len(pieces) == 1:
            return self._bytes([t.id for t in self.model.tokenize(unit.encode().decode("latin-1").translate(self.letters))])
        return b"".join([self.spaced[p[1:]] if p[0] == " " else self.bare[p] for p in pieces])

    def payload(self, text: str) -> bytes:
        """The ids of a text as little-endian bytes."""
        if self.tool is None:
            self._load()
        if not self.cuts or any(map(text.__contains__, self.special)):
            return self._bytes(self.tool.encode(text, add_special_tokens=False).ids)
        first, rest = units(text)
        return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))


def byte_values() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
