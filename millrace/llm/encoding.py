"""Exact tokenisation with a memory of words already seen.

A byte-pair encoder works on each pre-token alone. Cutting a text only where no
pre-token can cross gives units whose ids simply follow each other, and most units of
a corpus repeat; so the tokenizer runs once for each new unit.
"""

from __future__ import annotations

import os
import re
from array import array

#: Units kept for each Python worker; about 200 bytes each.
MAX_UNITS = 1_500_000
#: Longer units are encoded anew each time.
MAX_UNIT_CHARS = 64

_SPACED = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Letters whose lower case and composed form are a letter again, and marks that are no letters.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
_WORD = re.compile(f"([{_LETTERS}]+)([{_MARKS}]*)")
_SPACED_WORD = re.compile(f"(\n?)( ?[{_LETTERS}]+)([{_MARKS}]*)")


def _byte_characters() -> dict[int, int]:
    """The character that byte-level models use for each byte: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + k for k, b in enumerate(others)}


_BYTES = _byte_characters()


class _Uncuttable(Exception):
    pass


class _Units(dict):
    """Ids of units. A plain word with marks is put together from its pre-tokens; the model alone encodes a letter run."""

    def __init__(self, tokenizer, keeps_space: bool):
        super().__init__()
        self.tokenizer, self.model, self.keeps_space = tokenizer, tokenizer.model, keeps_space

    def __missing__(self, unit: str) -> bytes:
        ids = self._spaced(unit) if self.keeps_space else self._plain(unit)
        if ids is None:
            ids = array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
        if len(unit) <= MAX_UNIT_CHARS:
            self[unit] = ids
        return ids

    def _letters(self, run: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(_BYTES))]).tobytes()

    def _plain(self, unit: str) -> bytes | None:
        if (m := _WORD.fullmatch(unit)) is None:
            return None
        run, marks = m.groups()
        lower = run.lower()
        if marks or lower != run:
            return self[lower] + (self[marks] if marks else b"")
        return self._letters(run)

    def _spaced(self, unit: str) -> bytes | None:
        if (m := _SPACED_WORD.fullmatch(unit)) is None:
            if unit[-1].isspace() and unit.strip(" \n"):
                # White space other than blank or line feed before a cut could join what follows.
                raise _Uncuttable
            return None
        feed, run, marks = m.groups()
        if feed or marks:
            return (self[feed] if feed else b"") + self[run] + (self[marks] if marks else b"")
        return self._letters(run)


#: Texts on which a tokenizer must agree with its units put together, else it encodes whole texts.
PROBES = (
    "Plain words, and more of them; CamelCase UPPER lower.  Two blanks\n\nand lines\n next!",
    " leading and trailing ", "it's don't we'll I'm", "été Ünïcode ÀÉ naïve:", "a1 b22 333 4,444.5", "x\ty\r\nz\x0b\x0c", "日本語 text🙂 🙂 нет", "e\u0301 \u0301x \u3000 \xa0y",
    "<|endoftext|> [SEP] [UNK] </s> <s>", "http://a.b/c?d=e&f=g_h-i", "((nested) [brackets] {x}) \"q\" 'r'", "\n \n\n  \n", "...!!!???", "word.word,word;word:word", "A" * 70 + " " + "b" * 70,
)


class Encoder:
    """``encode(text)``: the ids of ``tokenizers`` as little-endian unsigned 32-bit integers.

    Units fit tokenizers that part texts at blanks, dropping them or (``keeps_space``)
    joining them to what follows. One that disagrees on ``PROBES`` gets whole texts.
    ``max_units`` are kept: fewer take less memory and more time.
    """

    def __init__(self, path: str, keeps_space: bool, max_units: int = MAX_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space, self.max_units = keeps_space, max_units
        self.units = _Units(self.tokenizer, keeps_space)
        self.cut = True
        self.cut = all(self.encode(t) == self.whole(t) for t in PROBES)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.cut:
            return self.whole(text)
        if len(self.units) > self.max_units:
            self.units.clear()
        if not self.keeps_space:
            return b"".join(map(self.units.__getitem__, text.replace("\n", " ").split(" "))) if text else b""
        try:
            return b"".join(map(self.units.__getitem__, _SPACED.findall(text)))
        except _Uncuttable:
            return self.whole(text)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keeps_space: bool, max_units: int = MAX_UNITS) -> Encoder:
    """One encoder for each Python worker and vocabulary file."""
    if (path, keeps_space) not in _ENCODERS:
        _ENCODERS[path, keeps_space] = Encoder(path, keeps_space, max_units)
    _ENCODERS[path, keeps_space].max_units = max_units
    return _ENCODERS[path, keeps_space]
