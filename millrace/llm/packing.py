"""Hierarchical packing of documents into training sequences of several lengths.

Each document is cut into full windows of the longest tier; what remains is routed to
the shortest tier that holds it. Each tier is packed; gaps in longer windows are filled
from shorter tiers, whole pieces first, then by cutting one piece. What is left at the
end of a chunk is laid out in windows whose lengths are powers of two, so no window has
padding. Windows of one tier form step groups with equal token counts, balanced by their
attention cost.

Packing runs inside each input partition without a shuffle: memory is bounded by a
chunk of ``CHUNK_TOKENS`` tokens, and a task that runs again gives the same rows.

Defined results: a null or empty text is a document of its end id alone; a null id is
kept; repeated rows are documents of their own; a long text fills as many windows as it
needs; no rows give no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import MAX_UNITS, encoder

TIERS = (256, 512, 1024, 2048)
#: Remainders wait for their tiers until so many tokens are held.
CHUNK_TOKENS = 1 << 20
#: Tokens of a step group.
STEP_TOKENS = 8 * 2048

#: A piece: document (index in the chunk), first token, length. A window: pieces in order.
Piece = tuple[int, int, int]


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Pool:
    """Pieces of one tier by length: the longest that fits is found by bisection."""

    def __init__(self) -> None:
        self.lengths: list[int] = []
        self.by: dict[int, deque[Piece]] = {}

    def add(self, p: Piece) -> None:
        if p[2] not in self.by:
            bisect.insort(self.lengths, p[2])
            self.by[p[2]] = deque()
        self.by[p[2]].append(p)

    def take(self, most: int | None = None) -> Piece | None:
        k = len(self.lengths) if most is None else bisect.bisect_right(self.lengths, most)
        if not k:
            return None
        n = self.lengths[k - 1]
        p = self.by[n].popleft()
        if not self.by[n]:
            del self.by[n], self.lengths[k - 1]
        return p


def pack_chunk(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Windows ``(tier, pieces)`` for documents of these lengths; each token lies in one piece.

    >>> pack_chunk([3000, 1096])
    [(2048, [(0, 0, 2048)]), (2048, [(1, 0, 1096), (0, 2048, 952)])]
    """
    longest, windows = tiers[-1], []
    pools = {t: _Pool() for t in tiers}
    tier_of = lambda n: next(t for t in tiers if n <= t)
    for d, n in enumerate(lengths):
        for at in range(0, n - n % longest, longest):
            windows.append((longest, [(d, at, longest)]))
        if n % longest:
            pools[tier_of(n % longest)].add((d, n - n % longest, n % longest))
    left: list[Piece] = []
    for k in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[k], tiers[k::-1]
        while (first := pools[tier].take()) is not None:
            window, gap = [first], tier - first[2]
            while gap:
                piece = next((p for t in below if (p := pools[t].take(gap)) is not None), None)
                if piece is None:  # nothing fits whole: cut the shortest tier's longest piece
                    piece = next((p for t in reversed(below) if (p := pools[t].take()) is not None), None)
                    if piece is None:
                        break
                    d, at, n = piece
                    piece = (d, at, gap)
                    pools[tier_of(n - gap)].add((d, at + gap, n - gap))
                window.append(piece)
                gap -= piece[2]
            if gap:
                left += window
            else:
                windows.append((tier, window))
    size = sum(p[2] for p in left)
    queue = deque(left)
    for width in _powers(size):
        window, gap = [], width
        while gap:
            d, at, n = queue.popleft()
            if n > gap:
                queue.appendleft((d, at + gap, n - gap))
                n = gap
            window.append((d, at, n))
            gap -= n
        windows.append((width, window))
    return windows


def step_groups(windows: list[tuple[int, list[Piece]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each window: windows of one tier, equal tokens in every full
    group, and attention cost (sum of squared piece lengths) dealt out in snake order."""
    group, base = [0] * len(windows), 0
    by_tier: dict[int, list[int]] = {}
    for k, (tier, _) in enumerate(windows):
        by_tier.setdefault(tier, []).append(k)
    for tier in sorted(by_tier, reverse=True):
        own = sorted(by_tier[tier], key=lambda k: (-sum(p[2] ** 2 for p in windows[k][1]), k))
        n = -(-len(own) // max(1, step_tokens // tier))
        for j, k in enumerate(own):
            lap, at = divmod(j, n)
            group[k] = base + (at if lap % 2 == 0 else n - 1 - at)
        base += n
    return group


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context long, step_group long"


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, max_units: int = MAX_UNITS) -> DataFrame:
    """One row for each piece: ``SCHEMA``, and ``ids`` if ``keep_ids``.

    A null text is empty: such a document is its end id. Repeated rows are packed each
    for itself; a null id stays null. ``sequence_id`` is the partition in the upper bits
    and a count in the lower; ``step_group`` likewise. ``max_units`` bounds what each
    Python worker remembers of units already encoded; the rows don't depend on it.
    """
    end = struct.pack("<I", end_id)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(tokenizer_path, True, max_units), TaskContext.get().partitionId() << 36
        held: list[tuple[int | None, bytes]] = []
        tokens = n_windows = n_groups = 0

        def flush() -> pa.RecordBatch:
            nonlocal tokens, n_windows, n_groups
            windows = pack_chunk([len(x) // 4 for _, x in held], tiers)
            groups = step_groups(windows)
            rows: list[tuple] = []
            for w, (context, pieces) in enumerate(windows):
                at = 0
                for d, start, n in pieces:
                    doc_id, ids = held[d]
                    rows.append((doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, base + n_windows + w, at, context, base + n_groups + groups[w]) + ((np.frombuffer(ids[4 * start : 4 * (start + n)], "<u4").astype(np.int64),) if keep_ids else ()))
                    at += n
            n_windows += len(windows)
            n_groups += max(groups, default=-1) + 1
            held.clear()
            tokens = 0
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[:9]] + [pa.array(c, pa.list_(pa.int64())) for c in cols[9:]]
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * keep_ids)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py() or "") + end
                held.append((doc_id, ids))
                tokens += len(ids) // 4
                if tokens >= CHUNK_TOKENS:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(pack, SCHEMA + ", ids array<long>" * keep_ids)
