"""Near-duplicate join on word n-grams: chosen-path similarity join.

Documents are sets of hashed n-grams of words. In each of several runs a document
chooses some of its n-grams by a hash that all documents share, and goes to the node of
each chosen one; two documents of Jaccard similarity at least ``threshold`` meet in
``1`` node on average in each run. The number of runs follows from the target recall and
the chance of fewer than two meetings, so pairs that meet but once need not be compared:
documents that met others only once, and nodes of two that are the only one of theirs, go.
Nodes of few documents are compared pair by pair, exactly. Larger ones are split again
by n-grams sampled for that node, until they are small or stop shrinking. A node whose
documents are linked to each other or would stay together, as a sample of them shows
before any row is made for the others, is compared in blocks; what its documents have met already in a larger node isn't compared
again (``_roles``). A pair that meets in several nodes is counted in the first of them, so
links are counted once although no list of pairs is ever made: each comparison gives, for
each document, its number of links and one edge to its group.

Counting all links within a group of m different texts that are alike takes m * m / 2
comparisons, and each of its sets goes to m / ``NODE_DOCS`` blocks. ``keep_one`` needs
classes only and compares such a group with one pivot.

Rows with equal texts are one class: only its smallest doc_id takes part.

Defined results: documents with equal texts are linked to each other whatever their
length; fewer words than ``n`` make one n-gram of what there is; a text without words
is linked to its copies alone; a null text or id has no links and is a class of its
own (class_id = doc_id); repeated rows are copies and each gives a row; no rows give no
rows; whole texts count, however long; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, staged

N, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.9999
#: Largest node, or side of a block, that is compared pair by pair: documents and n-grams.
NODE_DOCS, NODE_GRAMS = 1000, 2_000_000
#: Levels of splitting, mean number of shared n-grams chosen at each, and the share of a node's documents that may stay together.
LEVELS, CHOSEN, DENSE = 4, 2.0, 0.8
#: Documents of a large node that are looked at, and the share of linked pairs among them from which the node isn't split.
PROBED, DENSE_LINKS = 48, 0.5
#: Words whose hashes a worker keeps.
MAX_WORDS = 1 << 18

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well spread results."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < MAX_WORDS and len(word) <= 64:
            self[word] = h
        return h


_WORDS = _Words()


def grams(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words."""
    words = text.encode("utf-8", "surrogatepass").split()  # U+0020, U+0009 to U+000D
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = _mix(h * _GOLD + w[k : len(w) - size + 1 + k])
    return np.unique(h)


def _limit(share: float) -> np.uint64:
    return np.uint64(min(share, 1.0) * float(2**64 - 2**11))


def root_nodes(g: np.ndarray, runs: int, threshold: float) -> np.ndarray:
    """Nodes that a set goes to at first: for each run, those of its chosen n-grams."""
    seeds = _mix(np.arange(1, runs + 1, dtype=np.uint64) * _GOLD)
    h = _mix(g[None, :] ^ seeds[:, None])
    run, at = np.nonzero(h <= _limit(1 / threshold / len(g)))
    return np.unique(_mix(h[run, at] + seeds[run]))


def child_nodes(g: np.ndarray, node: int, threshold: float) -> np.ndarray:
    seed = _mix(np.array([node], np.uint64) ^ _GOLD)
    h = _mix(g ^ seed)
    return _mix(h[h <= _limit(CHOSEN / threshold / len(g))] + seed)


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _meetings(arrays: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two of the arrays of distinct numbers share."""
    m = len(arrays)
    flat = np.concatenate(arrays)
    owner = np.repeat(np.arange(m), [len(a) for a in arrays])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    used, column = np.unique(column, return_inverse=True)
    out = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = max(256, 8_000_000 // m)
    for lo in range(0, len(used), step):
        a, b = np.searchsorted(column, [lo, lo + step])
        part = np.zeros((m, min(step, len(used) - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out


def linked_pairs(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two sets have a Jaccard similarity of at least ``threshold``; none with itself."""
    sizes = np.array([len(s) for s in sets], np.int64)
    linked = _meetings(sets) * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-3 / 4
    linked &= (sizes > 0)[:, None] & (sizes > 0)[None, :]
    np.fill_diagonal(linked, False)
    return linked


def compare(sets: list[np.ndarray], side: np.ndarray, copies: np.ndarray, earlier: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """``(links, group)`` of each set: links to sets that didn't meet it in an earlier
    node, copies counted; and the smallest index of its group (its own without links).

    ``side``: 0 and 1 for the sides of a block pair, else all 0; with both sides only
    pairs across count.
    """
    m = len(sets)
    linked = linked_pairs(sets, threshold)
    if side.any():
        linked &= side[:, None] != side[None, :]
    group = np.arange(m)
    if not linked.any():
        return np.zeros(m, np.int64), group
    fresh = linked
    if any(map(len, earlier)):
        fresh = linked & (_meetings(earlier) == 0)
    links = fresh @ copies
    while True:
        low = np.where(linked, group[None, :], m).min(axis=1)
        new = np.minimum(group, low)
        new = new[new]
        if (new == group).all():
            return links, group
        group = new


def _compare_pair(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common * (1 + threshold) >= threshold * (len(a) + len(b)) - 1e-3 / 4


def runs_for(target_recall: float) -> int:
    """Runs after which a pair at the threshold has met less than twice with a chance of at most ``1 - target_recall``."""
    runs = 1
    while math.exp(-runs) * (1 + runs) > 1 - target_recall:
        runs += 1
    return runs


def _children(g: np.ndarray, parents: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    made = [child_nodes(g, p & (2**64 - 1), threshold) for p in parents]
    return np.concatenate(made).view(np.int64), np.repeat(np.array(parents, np.int64), [len(m) for m in made])


def _with_set(docs: DataFrame, n: int) -> DataFrame:
    """``key, copies, size, grams, homes, large, probes`` from all but ``size, grams`` and ``text``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sets = [grams(t.as_py(), n) for t in part.column(5)]
                offsets = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(s) for s in sets], out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), _long(np.concatenate(sets))), part.column(2), part.column(3), part.column(4)],
                    names=["key", "copies", "size", "grams", "homes", "large", "probes"],
                )

    schema = "key binary, copies long, size long, grams array<long>, homes array<long>, large array<long>, probes array<long>"
    return docs.select("key", "copies", "homes", "large", "probes", "text").mapInArrow(read, schema)


def _small(docs: str, grams_: str):
    return (F.col(docs) <= NODE_DOCS) & (F.col(grams_) <= NODE_GRAMS)


def _homes(members: DataFrame, threshold: float, meetings: int = 2) -> DataFrame:
    """Nodes that are to be compared: ``node, docs, grams, times``. Small nodes with the same
    documents are one: the smallest stands for all ``times``. Of nodes of two documents go those
    whose sizes can't agree, and those that aren't one of ``meetings`` of their two documents."""
    hashes = [F.bit_xor(F.xxhash64("key")).alias("a"), F.sum(F.xxhash64("key", F.lit(1)).bitwiseAND((1 << 40) - 1)).alias("b")]
    nodes = members.groupBy("node").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("grams"), F.min("size").alias("low"), F.max("size").alias("high"), *hashes)
    nodes = nodes.where((F.col("docs") > 2) | (F.col("docs") == 2) & (F.col("low") >= threshold * F.col("high") - 1e-6))
    same = nodes.groupBy("docs", "grams", "a", "b", F.when(~_small("docs", "grams"), F.col("node")).alias("own")).agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("times"))
    return same.where((F.col("docs") > 2) | (F.col("times") >= meetings)).select("node", "docs", "grams", "times")


def _resolve(rows: DataFrame, n: int, threshold: float, target_recall: float, counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key`` of all rows that take part, and for each key ``copy_of, label,
    class_id, n_links``; ``label`` names the class even where ids repeat. Without
    ``counted`` only the classes hold, and dense groups cost less: see ``_roles``."""
    runs = runs_for(target_recall)
    whole = rows.where("doc_id is not null and text is not null").withColumn("key", F.unhex(F.md5("text")))
    ids = staged(whole.select("doc_id", "key"), "join-ids")
    classes = staged(ids.groupBy("key").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("copies")), "join-classes")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            for lo in range(0, batch.num_rows, 1024):
                keys, nodes, sizes = [], [], []
                for key, text in zip(batch.column(0).slice(lo, 1024).to_pylist(), batch.column(1).slice(lo, 1024), strict=True):
                    if key in seen:
                        continue
                    seen.add(key)
                    g = grams(text.as_py(), n)
                    if len(g):
                        own = root_nodes(g, runs, threshold)
                        keys += [key] * len(own)
                        nodes.append(own)
                        sizes.append(np.full(len(own), len(g), np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), _long(np.concatenate(nodes)), pa.array(np.concatenate(sizes))], names=["key", "node", "size"])

    members = staged(whole.select("key", "text").mapInArrow(choose, "key binary, node long, size long").dropDuplicates(["node", "key"]), "join-members")
    homes = staged(_homes(members, threshold), "join-homes")
    at_home = members.join(homes, "node").select("key", F.struct("node", "docs", F.col("grams").alias("node_grams")).alias("h"), "times", "size")
    # Who met others only once has met no one twice.
    own = staged(at_home.groupBy("key").agg(F.collect_list("h").alias("homes"), F.sum("times").alias("times"), F.first("size").alias("size")).where("times > 1").select("key", "size", "homes"), "join-own")
    dropped(members, homes)
    nodes_of = lambda test: F.transform(F.filter("homes", test), lambda h: h["node"])
    is_small = lambda h: (h["docs"] <= NODE_DOCS) & (h["node_grams"] <= NODE_GRAMS)
    firsts = classes.join(own, "key").select("key", "copies", "copy_of", nodes_of(is_small).alias("homes"), nodes_of(lambda h: ~is_small(h)).alias("large"), nodes_of(lambda h: ~is_small(h) & _sampled(F.col("key"), h["node"], h["docs"], h["node_grams"])).alias("probes"))
    texts = whole.join(firsts, (whole.doc_id == firsts.copy_of) & (whole.key == firsts.key)).select(firsts.key, "copies", "homes", "large", "probes", "text")
    sets = staged(_with_set(texts, n), "join-sets")
    large = staged(own.select("key", "size", F.inline(F.filter("homes", lambda h: ~is_small(h)))), "join-large")
    placed, pivots = _split_large(large, sets, threshold)
    roles, stars = _roles(placed, pivots, sets, threshold, counted)
    found = staged(_compared(placed, roles, sets, threshold, counted), "join-found")
    if stars is not None:
        found = found.unionByName(stars)
    labels = _components(found.where("key <> other").select("key", "other"))
    dropped(own, sets, large)
    degree = found.groupBy("key").agg(F.sum("links").alias("links"))
    nodes = classes.join(degree, "key", "left").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    nodes = staged(nodes, "join-nodes")
    smallest = nodes.groupBy("label").agg(F.min("copy_of").alias("class_id"))
    return ids, nodes.join(smallest, "label").select("key", "copy_of", "label", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, copy_of, n_links`` for each row of ``docs``.

    ``class_id``: the smallest doc_id of all that are linked, also by way of others;
    ``copy_of``: the smallest doc_id with the same text; ``n_links``: other documents
    that are copies of this one or similar to it.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ids, nodes = _resolve(rows, n, threshold, target_recall)
    linked = ids.join(nodes, "key").select("doc_id", "class_id", "copy_of", "n_links")
    alone = rows.where("doc_id is null or text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def _split_large(large: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame | None, DataFrame | None]:
    """``key, node, docs, size, whole``: members of the nodes that large nodes end in (``whole``:
    too large for one comparison), and ``node, pivot`` of such nodes; None without any.

    ``large``: ``key, size, node, docs, node_grams``. A node most of whose documents are linked
    to each other or stay together in one child is left whole, and one whose children
    would have as many pairs as it has. A sample of its documents shows that before rows
    are made for all of them; what the sample missed is seen from the children. The
    others are split; their children are compared if small and split again if not, up to
    ``LEVELS`` times.
    """
    final = pivots = None
    add = lambda rows, more: more if rows is None else rows.unionByName(more)
    ends = lambda rows, whole: rows.select("key", "node", "docs", "size", F.lit(whole).alias("whole"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, parents, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = g.values.to_numpy().view(np.uint64)
                made, of = _children(own, parents, threshold)
                if len(made):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(made), pa.binary()), pa.array(made), pa.array(of), pa.array(np.full(len(made), len(own), np.int64))], names=["key", "node", "parent", "size"])

    for level in range(LEVELS):
        if large.isEmpty():
            return final, pivots
        if level == 0:
            some = sets.where(F.size("probes") > 0).select(F.explode("probes").alias("node"), "key", "grams")
        else:
            # Written first, so that their size is known: a small table is broadcast, and the sets aren't shuffled.
            some = staged(large.where(_sampled(*map(F.col, ("key", "node", "docs", "node_grams")))).select("key", "node"), "join-some")
            some = some.join(sets.where(F.size("large") > 0).select("key", "grams"), "key").select("node", "key", "grams")
        probed = staged(_probed(some, threshold), "join-probed")
        pivots = add(pivots, probed.select("node", "pivot"))
        dense = probed.where((F.col("share") >= DENSE_LINKS) | (F.col("most") >= DENSE) | (F.col("pairs") >= 1)).select("node")
        final = add(final, ends(large.join(dense, "node", "left_semi"), True))
        large = large.join(dense, "node", "left_anti")
        asked = staged(large.groupBy("key").agg(F.collect_list("node").alias("parents")), "join-asked")
        made = sets.where(F.size("large") > 0).select("key", "grams").join(asked, "key").select("key", "parents", "grams").mapInArrow(choose, "key binary, node long, parent long, size long")
        made = staged(made.dropDuplicates(["node", "key"]), "join-split")
        counts = made.groupBy("node", "parent").agg(F.count(F.lit(1)).alias("docs"))
        parents = large.groupBy("node").agg(F.first("docs").alias("all")).withColumnRenamed("node", "parent")
        parents = counts.groupBy("parent").agg(F.max("docs").alias("most"), F.sum(_pairs("docs")).alias("pairs")).join(parents, "parent", "right")
        parents = staged(parents.withColumn("dense", F.coalesce((F.col("most") >= DENSE * F.col("all")) | (F.col("pairs") >= _pairs("all")), F.lit(False))), "join-dense")
        final = add(final, ends(large.join(parents.where("dense").select(F.col("parent").alias("node")), "node", "left_semi"), True))
        made_apart = made.join(parents.where("not dense").select("parent"), "parent", "left_semi").drop("parent")
        nodes = _homes(made_apart, threshold, 1).drop("times").withColumnRenamed("grams", "node_grams")
        children = staged(made_apart.join(nodes, "node").select("key", "size", "node", "docs", "node_grams"), "join-children")
        dropped(made)
        final = add(final, ends(children.where(_small("docs", "node_grams")), False))
        large = children.where(~_small("docs", "node_grams"))
    return add(final, ends(large, True)), pivots


def _pairs(docs: str) -> Column:
    return F.col(docs) * (F.col(docs) - 1)


def _sampled(key: Column, node: Column, docs: Column, node_grams: Column) -> Column:
    """True for about ``PROBED`` documents of a node, or two at least of very long ones."""
    most = F.least(F.lit(PROBED), F.floor(F.lit(NODE_GRAMS) * docs / node_grams))
    return F.pmod(F.xxhash64(key, node), docs) < F.greatest(most, F.lit(2))


def _probed(some: DataFrame, threshold: float) -> DataFrame:
    """``node, share, most, pairs, pivot`` from sampled ``node, key, grams``: the share of
    linked pairs, of the documents that stay with another in the fullest child, of the
    pairs that meet in children (more than 1 if they meet in several), and the document
    with most links. What it says decides how a node is dealt with, not what is found
    there."""

    def probe(table: pa.Table) -> pa.Table:
        node, keys = table.column("node")[0].as_py(), table.column("key").to_pylist()
        sets = [g.values.to_numpy().view(np.uint64) for g in table.column("grams")]
        links, m = linked_pairs(sets, threshold).sum(axis=1), len(keys)
        _, docs = np.unique(np.concatenate([child_nodes(g, node & (2**64 - 1), threshold) for g in sets]), return_counts=True)
        all_pairs = max(m * (m - 1), 1)
        most = float(docs.max(initial=1) - 1) / max(m - 1, 1)
        best = min(range(m), key=lambda k: (-links[k], keys[k]))
        shares = {"share": float(links.sum()) / all_pairs, "most": most, "pairs": float((docs * (docs - 1)).sum()) / all_pairs}
        return pa.table({"node": pa.array([node]), **{k: pa.array([v]) for k, v in shares.items()}, "pivot": pa.array([keys[best]], pa.binary())})

    return some.groupBy("node").applyInArrow(probe, "node long, share double, most double, pairs double, pivot binary")


def _blocks(docs: str, grams_: str):
    return F.greatest(F.ceil(F.col(docs) / NODE_DOCS), F.ceil(F.col(grams_) / NODE_GRAMS)).cast("int")


def _roles(placed: DataFrame | None, pivots: DataFrame | None, sets: DataFrame, threshold: float, counted: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """``key, node, docs, b, upto, known`` of the members of nodes left whole: the member's
    block, the number of blocks, the first ones, that it meets, and the class that links to
    pivots put it in; and these links.

    A group of near copies fills about one node in each run, with nearly the same members
    in all. Its members are compared with each other in one of them only: each node has
    the largest node of most of its members as its reference, and there only documents
    that have another largest node are compared, with all. Without ``counted``, documents
    that pivots put in one class needn't meet at all: in each node the most frequent such
    class is left alone if it is larger than what the reference settles, and only the others
    are compared with all. A document is compared with the pivot of its largest node, and
    a node's pivot with that of its reference.
    """
    if placed is None:
        return None, None
    largest = F.min(F.struct((-F.col("docs")).alias("order"), "node"))["node"].alias("main")
    whole = placed.where("whole").dropDuplicates(["node", "key"]).groupBy("key").agg(F.first("size").alias("size"), largest, F.collect_list(F.struct("node", "docs")).alias("nodes"))
    whole = staged(whole, "join-whole")
    if whole.isEmpty():
        return None, None
    votes = whole.select("main", F.explode("nodes.node").alias("node")).groupBy("node", "main").agg(F.count(F.lit(1)).alias("n"))
    reference = votes.groupBy("node").agg(F.max(F.struct("n", "main"))["main"].alias("reference"))
    first = staged(pivots.groupBy("node").agg(F.min("pivot").alias("pivot")), "join-pivots")
    leads = first.join(reference, "node").select(F.col("pivot").alias("key"), F.col("reference").alias("node"))
    held = sets.where(F.size("large") > 0).select("key", "grams")
    at_pivot = first.join(held.select(F.col("key").alias("pivot"), F.col("grams").alias("pivot_grams")), "pivot")
    asked = whole.select("key", F.col("main").alias("node")).unionByName(leads).join(at_pivot, "node").join(held, "key")
    shared = F.size(F.array_intersect("grams", "pivot_grams"))
    near = shared * (1 + threshold) >= threshold * (F.size("grams") + F.size("pivot_grams")) - 1e-3 / 4
    stars = staged(asked.where(near).select("key", F.lit(0).cast("long").alias("links"), F.col("pivot").alias("other")), "join-stars")
    known = _components(stars.where("key <> other").select("key", "other")).withColumnRenamed("label", "known")
    rows = staged(whole.join(known, "key", "left").select("key", "size", "main", "known", F.inline("nodes")), "join-roles")
    cells = rows.groupBy("node", "main", "known").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"))
    most = lambda of: F.struct(*(F.sum(c).over(Window.partitionBy("node", of)).alias(c) for c in ("n", "grams")), F.col(of).alias("of"))
    cells = cells.select("node", "n", "grams", most("main").alias("met"), F.when(F.col("known").isNotNull(), most("known")).alias("alike"))
    nodes = cells.groupBy("node").agg(F.sum("n").alias("n"), F.sum("grams").alias("grams"), F.max("met").alias("met"), F.max("alike").alias("alike"))
    nodes = nodes.withColumn("met", F.when(F.col("met.of") != F.col("node"), F.col("met")))
    settling = lambda of, c: F.coalesce(F.col(f"{of}.{c}"), F.lit(0))
    by_class = F.lit(not counted) & (settling("alike", "n") >= settling("met", "n"))
    old, old_grams = (F.when(by_class, settling("alike", c)).otherwise(settling("met", c)) for c in ("n", "grams"))
    nodes = nodes.select("node", F.when(by_class, F.col("alike.of")).alias("class"), F.when(~by_class, F.col("met.of")).alias("reference"), old.alias("old"), old_grams.alias("old_grams"), (F.col("n") - old).alias("new"), (F.col("grams") - old_grams).alias("new_grams"))
    nodes = nodes.where("new > 0").select("node", "class", "reference", _blocks("new", "new_grams").alias("first"), _blocks("old", "old_grams").alias("rest"))
    rows = rows.join(nodes, "node").withColumn("settled", F.coalesce(F.col("known") == F.col("class"), F.col("main") == F.col("reference"), F.lit(False)))
    own = F.when(F.col("settled"), F.col("first") + F.pmod(F.xxhash64("key"), F.col("rest"))).otherwise(F.pmod(F.xxhash64("key"), F.col("first")))
    upto = F.when(F.col("settled"), F.col("first")).otherwise(F.col("first") + F.col("rest"))
    return rows.select("key", "node", "docs", own.cast("int").alias("b"), upto.cast("int").alias("upto"), "known"), stars


def _compared(placed: DataFrame | None, roles: DataFrame | None, sets: DataFrame, threshold: float, counted: bool) -> DataFrame:
    """``key, links, other``: for each node and document with links there, their number
    and the key of one member of its group, or its own key where ``roles`` knows that both
    are of one class. ``placed`` and ``roles``: the nodes of documents that were in large
    ones, besides their small ones. Without ``counted``, rows that join no classes are left out."""
    at = lambda node, docs, b, upto: F.struct((-docs).alias("order"), node.alias("node"), b.alias("b"), upto.alias("upto"))
    zero, one = F.lit(0), F.lit(1)
    small = F.transform("homes", lambda x: at(x, zero.cast("long"), zero, one))
    no_class = F.lit(None).cast("binary").alias("known")
    rows = sets.where("size(large) = 0").select("key", "copies", "grams", no_class, small.alias("nodes"))
    if placed is not None:
        more = placed.where("not whole").dropDuplicates(["node", "key"]).select("key", at(F.col("node"), zero.cast("long"), zero, one).alias("at"), no_class)
        if roles is not None:
            more = more.unionByName(roles.select("key", at(F.col("node"), F.col("docs"), F.col("b"), F.col("upto")).alias("at"), "known"))
        held = sets.where("size(large) > 0").join(more.groupBy("key").agg(F.collect_list("at").alias("more"), F.max("known").alias("known")), "key", "left")
        rows = rows.unionByName(held.select("key", "copies", "grams", "known", F.concat(small, F.coalesce("more", F.array().cast(more.schema["at"].dataType.simpleString().join(("array<", ">"))))).alias("nodes")))
    # Nodes left whole come first, the largest before the others, so that a reference comes before the nodes that refer to it.
    rows = rows.select("key", "copies", "grams", "known", F.sort_array("nodes").alias("nodes"))
    rows = rows.select("key", "copies", "grams", "known", F.transform("nodes", lambda x: x["node"]).alias("homes"), F.posexplode("nodes").alias("place", "at"))
    rows = rows.withColumn("x", F.explode(F.sequence(zero, F.col("at.upto") - 1)))
    rows = rows.select(F.col("at.node").alias("node"), F.least("at.b", "x").alias("i"), F.greatest("at.b", "x").alias("j"), F.col("at.b").alias("b"), "key", "copies", "grams", F.slice("homes", one, F.col("place")).alias("earlier"), "known")
    rows = rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, int, bytes]] = []
        held: list[tuple] = []
        at: tuple | None = None

        def add(row: tuple, n: int, low: tuple) -> None:
            other = row[0] if row[5] is not None and row[5] == low[5] else low[0]
            if n and counted or other != row[0]:
                out.append((row[0], n, other))

        def close() -> None:
            _, i, j = at
            unique = list({r[0]: r for r in held}.values())
            if len(unique) < 2:
                return
            sets_ = [r[2] for r in unique]
            earlier = [r[3] for r in unique]
            if len(unique) == 2:
                x, y = unique
                if (i == j or x[4] != y[4]) and _compare_pair(x[2], y[2], threshold):
                    first = not len(np.intersect1d(earlier[0], earlier[1], assume_unique=True))
                    low = min(unique, key=lambda r: r[0])
                    add(x, y[1] if first else 0, low)
                    add(y, x[1] if first else 0, low)
                return
            side = np.zeros(len(unique), np.int8) if i == j else np.array([r[4] == j for r in unique], np.int8)
            if i != j and (side.all() or not side.any()):
                return
            n_links, group = compare(sets_, side, np.array([r[1] for r in unique], np.int64), earlier, threshold)
            for k, row in enumerate(unique):
                add(row, int(n_links[k]), unique[group[k]])

        for batch in batches:
            nodes, i_, j_, b_ = (batch.column(k).to_numpy() for k in range(4))
            keys, copies = batch.column(4).to_pylist(), batch.column(5).to_numpy()
            grams_, homes, known = batch.column(6), batch.column(7), batch.column(8).to_pylist()
            g_at, h_at = grams_.offsets.to_numpy(), homes.offsets.to_numpy()
            g_all, h_all = grams_.values.to_numpy().view(np.uint64), homes.values.to_numpy()
            for k in range(batch.num_rows):
                here = (int(nodes[k]), int(i_[k]), int(j_[k]))
                if here != at:
                    if at is not None:
                        close()
                        if len(out) >= 10_000:
                            yield _found(out)
                            out = []
                    at, held = here, []
                held.append((keys[k], int(copies[k]), g_all[g_at[k] : g_at[k + 1]].copy(), h_all[h_at[k] : h_at[k + 1]].copy(), int(b_[k]), known[k]))
        if at is not None:
            close()
        if out:
            yield _found(out)

    return rows.mapInArrow(run, "key binary, links long, other binary")


def _found(out: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
    a, b, c = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["key", "links", "other"])


def _components(edges: DataFrame) -> DataFrame:
    """``key, label``: the smallest key that edges lead to. Labels spread to neighbours and
    then jump to their own label's label, until nothing changes."""
    edges = staged(edges.unionByName(edges.select(F.col("other").alias("key"), F.col("key").alias("other"))).distinct(), "join-edges")
    labels = staged(edges.groupBy("key").agg(F.least(F.min("other"), F.col("key")).alias("label")), "join-labels")
    while True:
        near = edges.join(labels.select(F.col("key").alias("other"), "label"), "other").groupBy("key").agg(F.min("label").alias("near"))
        spread = labels.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("far"))
        new = staged(spread.join(jump, "label", "left").select("key", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "join-labels")
        labels = new.select("key", "label")
        if new.where("old <> label").isEmpty():
            return labels


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """The rows of ``docs`` of which one document of each class stays: that with the
    smallest doc_id (of several texts under it, that of the smallest digest), once. Rows
    with a null id or text all stay."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    _, nodes = _resolve(rows, n, threshold, target_recall, counted=False)
    first = nodes.groupBy("label").agg(F.min(F.struct("copy_of", "key")).alias("f")).select(F.col("f.copy_of").alias("id"), "f.key")
    # The rows are one column here, so that their names can't clash with others.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    named = docs.where("doc_id is not null and text is not null").select(row, F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5("text")).alias("key"))
    kept = named.join(first, ["id", "key"]).dropDuplicates(["id", "key"]).select("row.*")
    return kept.unionByName(docs.where("doc_id is null or text is null"))
