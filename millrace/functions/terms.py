"""Many fixed terms sought in each text at once.

An Aho-Corasick automaton reads a text once, however many terms there are: its trie has
a link from each node to the longest other prefix of a term that ends there, so all terms
that end at a character are known when it is read. It is built once in each Python worker
from the terms, which Spark sends there with the function. Texts stay in their Arrow batch
and become Python strings one at a time.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

PAIRS = "array<struct<source: string, target: string>>"


class Terms:
    """``in_text(text)``: the numbers of the terms that a text holds, ascending."""

    def __init__(self, terms: Sequence[str], any_case: bool):
        import ahocorasick

        self.any_case, self.automaton = any_case, ahocorasick.Automaton()
        numbers: dict[str, list[int]] = {}
        for k, term in enumerate(terms):
            numbers.setdefault(term.lower() if any_case else term, []).append(k)
        self.everywhere = numbers.pop("", [])
        for term, where in numbers.items():
            self.automaton.add_word(term, where)
        self.filled = bool(numbers)
        if self.filled:
            self.automaton.make_automaton()

    def in_text(self, text: str) -> list[int]:
        found = set(self.everywhere)
        if self.filled:
            for _, where in self.automaton.iter(text.lower() if self.any_case else text):
                found.update(where)
        return sorted(found)


_BUILT: dict[tuple[tuple[str, ...], bool], Terms] = {}


def built(terms: Sequence[str], any_case: bool) -> Terms:
    """The automaton of these terms, one for each worker; the last few are kept."""
    key = (tuple(terms), any_case)
    if key not in _BUILT:
        if len(_BUILT) > 8:
            _BUILT.clear()
        _BUILT[key] = Terms(terms, any_case)
    return _BUILT[key]


class Found:
    """Lists of glossary pairs, held as the pairs' numbers until they are all there."""

    def __init__(self) -> None:
        self.numbers, self.ends = array("i"), array("i", [0])

    def add(self, numbers: Iterable[int]) -> None:
        self.numbers.extend(numbers)
        self.ends.append(len(self.numbers))

    def lists(self, pairs: Sequence[tuple[str, str]]) -> pa.ListArray:
        which = pa.array(np.frombuffer(self.numbers, np.int32))
        columns = [pa.array([p[k] for p in pairs], pa.string()).take(which) for k in (0, 1)]
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(self.ends, np.int32)), pa.StructArray.from_arrays(columns, ["source", "target"]))


def terms_in(text: Column, glossary: Sequence[tuple[str, str]]) -> Column:
    """``source, target`` of each glossary pair whose source the text holds in any case, in the glossary's order; null has none."""
    pairs = [tuple(p) for p in glossary]

    def find(texts: pa.Array) -> pa.Array:
        terms, found = built([s for s, _ in pairs], True), Found()
        for t in texts:
            found.add(() if (own := t.as_py()) is None else terms.in_text(own))
        return found.lists(pairs)

    return arrow_udf(find, PAIRS)(text) if pairs else F.array().cast(PAIRS)


def terms_kept(source: Column, output: Column, glossary: Sequence[tuple[str, str]]) -> Column:
    """``required, missing``: pairs whose source is in ``source`` in any case, and those of them whose target is not in ``output`` in that case."""
    pairs = [tuple(p) for p in glossary]
    kind = f"required {PAIRS}, missing {PAIRS}"

    def find(sources: pa.Array, outputs: pa.Array) -> pa.Array:
        wanted, given = built([s for s, _ in pairs], True), built([t for _, t in pairs], False)
        found, missing = Found(), Found()
        for s, o in zip(sources, outputs, strict=True):
            required = wanted.in_text(s.as_py() or "")
            there = set(given.in_text(o.as_py() or "")) if required else set()
            found.add(required)
            missing.add(k for k in required if k not in there)
        return pa.StructArray.from_arrays([found.lists(pairs), missing.lists(pairs)], ["required", "missing"])

    if not pairs:
        return F.struct(F.array().cast(PAIRS).alias("required"), F.array().cast(PAIRS).alias("missing"))
    return arrow_udf(find, kind)(source, output)
