"""Fill-in-middle: documents cut at two of their units and put in another order.

A unit is a match of a pattern. A lazy match iterator goes over a text twice: the first
pass counts the units, the second is advanced to the ends of prefix and middle. No list
of units exists at any time, so beside the text itself a long one needs no more memory
than a short one.

Where a document is cut, and which form it takes, follows from a hash of its id alone:
a task that runs again, on any machine, gives the same rows.

Defined results: a null text is an empty one; an empty text, or one that holds a mark, stays
plain; a null id draws as the text ``null``; repeated rows are cut alike; whole texts
count, however long; no rows give no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

#: Letters together, every other character by itself.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 documents, how many stay plain, and how many of the others have their suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20


def count_units(unit: re.Pattern[str], text: str) -> int:
    """How often ``unit`` matches, with one match alive at a time."""
    numbers = count()
    deque(zip(unit.finditer(text), numbers, strict=False), maxlen=0)
    # zip asks for a match before it asks for a number
    return next(numbers)


def ends_of(unit: re.Pattern[str], text: str, low: int, high: int) -> tuple[int, int]:
    """Where unit number ``low`` and unit number ``high`` end, counted from 1; 0 is the text's begin."""
    matches = unit.finditer(text)
    first = next(islice(matches, low - 1, None)).end() if low else 0
    return first, next(islice(matches, high - low - 1, None)).end() if high > low else first


def draws(id_: Column, seed: str, n: int = 4) -> list[Column]:
    """``n`` unsigned 32-bit numbers, the leading digit groups of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def fill_in_middle(
    docs: DataFrame, seed: str = "1", unit: str = UNIT, marks: tuple[str, str, str] = MARKS, plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document. Texts are shuffled only if they come in fewer partitions than there are cores.

    The first two draws, modulo ``n + 1``, are the ranks of the two cuts; the third decides
    between plain and cut, the fourth between ``psm`` (prefix, suffix, middle) and ``spm``.
    """
    if len(set(marks)) != 3 or any(a != b and a in b for a in marks for b in marks):
        raise ValueError("three marks are wanted, none inside another")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, (p, s, m) = re.compile(unit, re.DOTALL), marks
        for batch in batches:
            rows = []
            ids, texts, *drawn = batch.columns
            for text, *h in zip(texts, *(c.to_pylist() for c in drawn), strict=True):
                text = text.as_py() or ""
                n = count_units(pattern, text)
                if not text or h[2] % 100 >= 100 - plain_percent or any(x in text for x in marks):
                    rows.append((n, "plain", None, None, text))
                    continue
                a, b = ends_of(pattern, text, *sorted((h[0] % (n + 1), h[1] % (n + 1))))
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                psm = h[3] % 100 >= suffix_first_percent
                output = f"{p}{prefix}{s}{suffix}{m}{middle}" if psm else f"{s}{suffix}{p}{prefix}{m}{middle}"
                rows.append((n, "psm" if psm else "spm", a, b - a, output))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(draws(F.col(f"`{id_col}`"), seed))))
    return spread(rows).mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from what was made of it, and nothing else.

    No mark lies in a cut text, and none begins with the end of another, so the first place
    where the second and third mark are found is where they were put.
    """
    p, s, m = marks
    rest = lambda text, mark: F.substring(text, F.position(F.lit(mark), text) + F.lit(len(mark)), F.length(text))
    upto = lambda text, mark: F.substring(text, F.lit(1), F.position(F.lit(mark), text) - F.lit(1))

    def parts(lead: str, second: str) -> tuple[Column, Column, Column]:
        after = rest(output, lead)
        return upto(after, second), upto(rest(after, second), m), rest(rest(after, second), m)

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def digests(cut: DataFrame) -> DataFrame:
    """Digests of each output and of the text rebuilt from it."""
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
