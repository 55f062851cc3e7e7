"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule votes to keep (1), to reject (-1) or abstains (0). What the rules' votes say
about the unseen quality is estimated by expectation-maximisation over the counts of
vote patterns. A document is good, or junk of one of several kinds: one kind for each
rule, which that rule tends to reject. For good documents and for each kind, the chances
of the three votes of each rule are estimated, and the share of each. Rules that vote
alike count less (``independence``). A document is kept if its posterior probability of
being good reaches ``threshold`` and it passes the base rules; so one reject vote of a
rule that proves unreliable drops nothing, and abstentions that are usual for junk only
count against a document.

There are at most 3 ** len(RULES) vote patterns whatever the size of the corpus; only
their counts reach the driver.

Defined results: a null text has no words; a document without words fails the base
rules; whole texts count, however long; repeated rows are judged each for itself, so ties
and copies share a verdict; no rows give no rows; other columns pass through unread,
whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT, staged

SYMBOLS = "#*$%&|<>"
HELD = "counts"
#: Prior belief: rejecting votes on a good document, and the votes of the rule that a kind of junk is named for (reject, abstain, keep).
FALSE_REJECTS, JUNK_VOTES, GOOD_SHARE = 0.002, (0.8, 0.15, 0.05), 0.9
#: How many documents a prior belief counts for, as a share of all: on good documents, on a kind's own rule, on its other rules.
BELIEF_GOOD, BELIEF_OWN, BELIEF_OTHER, BELIEF_LEAST = 0.2, 0.01, 0.05, 2.0
#: Steps at most, and the change of all posteriors below which the estimate has converged.
MOST_STEPS, TOLERANCE = 2000, 1e-7


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_SPLIT), "")


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows all of whose hashes differ are all different, which settles most
    documents. Otherwise the windows themselves are sorted, each with its place behind
    a line feed (which no word holds), so equal windows are neighbours.
    """
    place = lambda s: F.substring_index(s, "\n", -1).cast("int")
    window = lambda s: F.substring_index(s, "\n", 1)

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.coalesce(window(x) == window(F.get(s, k)), F.lit(False))
        hits = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(hits, place))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, k - 1)))), F.lit(0), lambda a, b: a + b)

    keyed = F.sort_array(F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.concat(F.get(words, i + 2), F.lit("\n"), i.cast("string")))))
    # let: a one-element array names a value that several expressions use
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(keyed, lambda s: let(repeated(s), covered)))


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row``, all columns of ``docs`` as one, and a struct column of counts; ``text`` is read whole."""
    text = F.col("text")
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    df = df.withColumn("words", _words(text))
    words = F.col("words")
    df = df.withColumn(
        "hashes",
        F.when(F.size(words) >= 3, F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    joined = F.array_join(words, "")
    counts = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        (F.octet_length(text) - F.octet_length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(words, F.col("hashes")).cast("long").alias("n_repeat_words"),
        (F.octet_length(text) - F.octet_length(_without(text, "!"))).cast("long").alias("n_exclaims"),
        (F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long").alias("n_capitals"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
    )
    return df.select("row", counts.alias(HELD))


@dataclass(frozen=True)
class Rule:
    """Votes reject above ``bad`` of ``value`` and keep below ``good``; abstains between, and where the value is null."""

    name: str
    value: str
    good: float
    bad: float

    def vote(self, held: str = HELD) -> Column:
        v = F.expr(self.value.replace("q.", f"{held}."))
        return F.coalesce(F.when(v > self.bad, -1).when(v < self.good, 1), F.lit(0)).alias(self.name)


RULES = (
    Rule("symbols", "q.n_symbols / nullif(q.n_words, 0)", 0.05, 0.2),
    Rule("repeats", "q.n_repeat_words / nullif(q.n_words, 0)", 0.2, 0.4),
    Rule("exclaims", "q.n_exclaims / nullif(q.n_words, 0)", 0.1, 0.3),
    Rule("capitals", "q.n_capitals / nullif(q.word_chars, 0)", 0.1, 0.2),
    Rule("dup_lines", "q.n_dup_lines / nullif(q.n_lines, 0)", 0.3, 0.6),
    Rule("word_length", "abs(ln(q.word_chars / nullif(q.n_words, 0) / 5.5))", 0.6, 1.0),
    Rule("short", "50 / nullif(q.n_words, 0)", 0.7, 1.0),
    Rule("variety", "1 - q.n_distinct_words / nullif(least(q.n_words, 400), 0)", 0.75, 0.9),
)


def base_failed(held: str = HELD) -> Column:
    n, r = F.col(f"{held}.n_words"), F.col(f"{held}.n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


Votes = tuple[int, ...]


@dataclass(frozen=True)
class Model:
    """``shares``: of good documents and of each kind of junk. ``chances[k][j]``: of votes
    -1, 0 and 1 of rule j in them. ``weights[j]``: how much of rule j's votes counts for the
    kinds of other rules."""

    shares: tuple[float, ...]
    chances: tuple[tuple[tuple[float, float, float], ...], ...]
    weights: tuple[float, ...]

    def evidence(self, k: int, j: int) -> tuple[float, float, float]:
        """What each vote of rule j says for kind k against good, in log odds. A kind's own rule counts in full."""
        weight = 1.0 if k == j + 1 else self.weights[j]
        return tuple(weight * math.log(self.chances[k][j][v] / self.chances[0][j][v]) for v in range(3))

    def odds(self, k: int) -> float:
        return math.log(self.shares[k] / self.shares[0])

    def responsibilities(self, votes: Votes) -> list[float]:
        against = [0.0] + [self.odds(k) + sum(self.evidence(k, j)[v + 1] for j, v in enumerate(votes)) for k in range(1, len(self.shares))]
        most = max(against)
        scaled = [math.exp(x - most) for x in against]
        return [x / sum(scaled) for x in scaled]

    def posterior(self, votes: Votes) -> float:
        return self.responsibilities(votes)[0]

    def posterior_column(self, votes: list[Column]) -> Column:
        junk = F.lit(0.0)
        for k in range(1, len(self.shares)):
            says = [F.element_at(F.array(*map(F.lit, self.evidence(k, j))), v + 2) for j, v in enumerate(votes)]
            junk = junk + F.exp(F.least(F.lit(700.0), sum(says, F.lit(self.odds(k)))))
        return 1 / (1 + junk)


def independence(patterns: dict[Votes, int]) -> tuple[float, ...]:
    """A weight for each rule: one over the sum of its correlations, without their signs,
    with all rules, itself included. Of two rules that always vote alike each counts a half."""
    votes = np.array(list(patterns), float)
    counts = np.array(list(patterns.values()), float)
    centred = votes - (counts @ votes) / max(counts.sum(), 1)
    cov = (centred * counts[:, None]).T @ centred
    spread = np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
    alike = np.abs(np.where(spread > 0, cov / np.where(spread > 0, spread, 1), 0))
    np.fill_diagonal(alike, 1)
    return tuple(float(x) for x in 1 / alike.sum(axis=0))


def expectation_maximisation(patterns: dict[Votes, int], steps: int = MOST_STEPS, tolerance: float = TOLERANCE) -> Model:
    """Fit ``Model`` to the counts of vote patterns; stops when no posterior changes by more than ``tolerance``.

    The prior beliefs hold no chance fast: each is a number of imagined documents, a fixed
    share of all there are, and as many real ones outweigh it.
    """
    n, total = len(next(iter(patterns), ())), float(sum(patterns.values()))
    votes = list(patterns)
    counts = np.array([patterns[v] for v in votes], float)
    cast = np.array([[[float(v[j] == x - 1) for x in range(3)] for j in range(n)] for v in votes]).reshape(len(votes), n, 3)
    overall = (np.einsum("p,pjx->jx", counts, cast) + BELIEF_LEAST / 3) / (total + BELIEF_LEAST)
    belief = np.empty((n + 1, n, 3))
    kept = overall[:, 1:] / overall[:, 1:].sum(axis=1, keepdims=True)
    belief[0] = np.concatenate([np.full((n, 1), FALSE_REJECTS), (1 - FALSE_REJECTS) * kept], axis=1) * max(BELIEF_GOOD * total, BELIEF_LEAST)
    belief[1:] = overall * max(BELIEF_OTHER * total, BELIEF_LEAST)
    for j in range(n):
        belief[j + 1, j] = np.array(JUNK_VOTES) * max(BELIEF_OWN * total, BELIEF_LEAST)
    share = np.array([GOOD_SHARE] + [(1 - GOOD_SHARE) / n] * n) * BELIEF_LEAST if n else np.array([BELIEF_LEAST])

    def model(chances: np.ndarray, shares: np.ndarray) -> Model:
        return Model(tuple((shares / shares.sum()).tolist()), tuple(tuple(map(tuple, c)) for c in (chances / chances.sum(axis=2, keepdims=True)).tolist()), weights)

    weights = independence(patterns)
    now, before = model(belief, share), None
    for _ in range(steps):
        of = np.array([now.responsibilities(v) for v in votes])
        if before is not None and np.abs(of - before).max() <= tolerance:
            break
        before = of
        held = of * counts[:, None]
        now = model(belief + np.einsum("pk,pjx->kjx", held, cast), share + held.sum(axis=0))
    return now


def fit(features: DataFrame, rules: tuple[Rule, ...] = RULES, held: str = HELD) -> Model:
    """The model of what passes the base rules; what fails them needs no vote."""
    rows = features.where(~base_failed(held)).select(*(r.vote(held) for r in rules)).groupBy(*(r.name for r in rules)).count().collect()
    return expectation_maximisation({tuple(r[x.name] for x in rules): r["count"] for r in rows} or {(0,) * len(rules): 0})


def kept_column(model: Model, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, held: str = HELD) -> Column:
    return ~base_failed(held) & (model.posterior_column([r.vote(held) for r in rules]) >= threshold)


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``posterior`` and ``kept`` of every document."""
    features = with_features(docs.select(F.col("doc_id"), F.col(f"`{text_col}`").alias("text")))
    features = staged(features.select(F.col("row.doc_id").alias("doc_id"), HELD), "quality")
    model = fit(features, rules)
    return features.select("doc_id", f"{HELD}.*", base_failed().alias("base_failed"), model.posterior_column([r.vote() for r in rules]).alias("posterior"), kept_column(model, rules, threshold).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns."""
    features = staged(with_features(docs, text_col), "quality-rows")
    return features.where(kept_column(fit(features, rules), rules, threshold)).select("row.*")
