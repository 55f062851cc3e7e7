"""Secret scans with a random forest that removes false findings; DataFrame expressions only.

Candidates are long runs of key characters with a digit, and values assigned to a word
such as ``password``. Each gets features of its length, character transitions,
dictionary coverage, path and neighbouring words. A forest trained from labelled
findings scores them, and is itself a column expression: nothing but the labelled
findings, at most ``LABELLED`` rows, reaches the driver.

Everything happens inside a row, without a shuffle. Texts without a candidate are told
apart by one regular expression.

Defined results: a null or empty text has no findings and stays as it is; each occurrence
is a finding; rows that repeat are scanned each for itself, so they share their findings
(ties have no effect on each other); whole texts count, however long; no rows give no rows;
other columns are kept, whatever their names. A word is masked where it was found: equal
characters in other words stay, unless they are found themselves.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPLIT, staged

#: Labelled findings that a forest is fitted on, at most.
LABELLED = 4000
TREES, DEPTH, LEAST, CUTS = 15, 6, 5, 24
THRESHOLD = 0.5
MASK = "[SECRET]"

_RUN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{16,}={0,2}"
# Names that values are assigned to, words of other uses of long tokens, and words of placeholders and paths.
KEY_NAMES = "password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential|client[_-]?secret"
OTHER_NAMES = "sha1|sha256|md5|commit|checksum|digest|uuid|guid|hash|etag|revision|rev|version|build|id|isbn|phone|order|invoice|trace|request"
DICTIONARY = "example|sample|test|dummy|placeholder|your|here|insert|change|default|token|secret|password|value|user|admin|name|config|index|image|static|asset|version|release|notes|final|report|draft|data|file|page|home|docs|download|content|upload|media|public|build|chapter|section|table|figure|model|train|html|http|https|www|com|org|json|xml|png|jpg|pdf|the|and|for|with|from|this|that"
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur"
# Blanks that don't part words, and what ends a value: a quote, a comma, a brace, a semicolon, such a blank or the next field of a query string.
_HARD_BLANK = r"\u00A0\u2000-\u200A\u202F\u3000"
_VALUE = rf"(?:(?!&[A-Za-z0-9_.~%-]+=)[^\x22',}};{_HARD_BLANK}]){{6,}}+"
_ASSIGNED = rf"(?i)(?:{KEY_NAMES})[\x22']?[{_HARD_BLANK}]*[:=]{{1,2}}[{_HARD_BLANK}]*[\x22']?({_VALUE})"
# The password of a login in an address.
_LOGIN = r"://[^\x20\x09-\x0D:/@]*:([^\x20\x09-\x0D:/@]{6,})@"

#: What may stand between a key name and the value.
SCHEMES = "bearer|basic|digest|negotiate"
# How keys of common services begin.
PREFIXES = "AKIA|ASIA|AIza|gh[oprsu]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|eyJ|MII[CEGJ]"

FEATURES = ("length", "digits", "uppers", "others", "switches", "pairs", "distinct", "dictionary", "path", "key_name", "other_name", "assigned", "quoted", "hex", "uuid", "repeats", "prefix")


def _candidates(words: Column) -> Column:
    """``word_index, candidate, word, before, after`` of each candidate, in order."""
    none = F.lit("")
    near = lambda i: F.coalesce(F.get(words, i), none)

    def of_word(w: Column, i: Column) -> Column:
        runs = F.regexp_extract_all(w, F.lit(_RUN), F.lit(0))
        inside = F.concat(F.regexp_extract_all(w, F.lit(_ASSIGNED), F.lit(1)), F.regexp_extract_all(w, F.lit(_LOGIN), F.lit(1)))
        sign, scheme = r"(?:^|[A-Za-z\x22'])[:=]{1,2}$", near(i - 1).rlike(rf"^[\x22']?(?i:{SCHEMES})$")
        named = near(i - 1).rlike(sign) & F.concat_ws(" ", near(i - 2), near(i - 1)).rlike(rf"(?i)(?:{KEY_NAMES})")
        named = named | scheme & near(i - 2).rlike(sign) & F.concat_ws(" ", near(i - 3), near(i - 2)).rlike(rf"(?i)(?:{KEY_NAMES})")
        first = F.when(named, F.regexp_extract_all(w, F.lit(rf"^[\x22']?({_VALUE})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
        # No value lies inside a longer run: a run that begins with it ends with it, and is found already.
        found = F.concat(runs, F.filter(F.concat(first, inside), lambda v: ~v.rlike(f"^(?:(?:{_RUN})|(?i:{SCHEMES}))$")))
        before = F.concat_ws(" ", near(i - 3), near(i - 2), near(i - 1))
        return F.transform(found, lambda c: F.struct(i.cast("long").alias("word_index"), c.alias("candidate"), w.alias("word"), before.alias("before"), near(i + 1).alias("after")))

    return F.flatten(F.transform(words, of_word))


def _features(f: Column) -> dict[str, Column]:
    c, word, before = f["candidate"], f["word"], f["before"]
    n = F.length(c).cast("double")
    count = lambda pattern: n - F.length(F.regexp_replace(c, pattern, ""))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    low = F.lower(c)
    pairs = F.size(F.regexp_extract_all(low, F.lit(f"(?={PAIRS.replace(' ', '|')})"), F.lit(0)))
    lead = F.split_part(word, c, F.lit(1))
    context = F.concat_ws(" ", before, lead)
    yes = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return {
        "length": n,
        "digits": count("[0-9]") / n,
        "uppers": count("[A-Z]") / n,
        "others": count("[^A-Za-z0-9]") / n,
        "switches": (F.length(kinds) - 1) / n,
        "pairs": pairs / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "dictionary": (n - F.length(F.regexp_replace(low, f"(?:{DICTIONARY})", ""))) / n,
        "path": yes(word.rlike(r"://|^[./~]|/[^/]+/|\.[a-z]{2,4}(?:[^a-z]|$)|^data:")),
        "key_name": yes(context.rlike(rf"(?i)(?:{KEY_NAMES})")),
        "other_name": yes(context.rlike(rf"(?i)(?:^|[^a-z])(?:{OTHER_NAMES})(?:[^a-z]|$)")),
        "assigned": yes(context.rlike(rf"[:=]{{1,2}}[{_HARD_BLANK}]*[\x22']?$")),
        "quoted": yes(lead.rlike(r"[\x22']$")),
        "hex": yes(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "uuid": yes(c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")),
        "repeats": (n - F.length(F.regexp_replace(c, r"(.)\1{2,}", "$1"))) / n,
        "prefix": yes(c.rlike(f"^(?:{PREFIXES})")),
    }


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however the optimizer moves and copies projections."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def may_have_candidates(text: Column) -> Column:
    """True for each text with a candidate, and for others: a run, a login, or a key name and a sign of assignment anywhere."""
    return text.rlike(_RUN) | text.rlike(_LOGIN) | (text.rlike("[:=]") & text.rlike(rf"(?i)(?:{KEY_NAMES})"))


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and the array column ``__candidates``: ``word_index, candidate`` and the features."""
    text = F.col(f"`{text_col}`")
    words = F.when(may_have_candidates(text), F.array_remove(F.split(text, WORD_SPLIT), "")).otherwise(F.array().cast("array<string>"))
    describe = lambda f: F.struct(f["word_index"].alias("word_index"), f["candidate"].alias("candidate"), *(v.alias(k) for k, v in _features(f).items()))
    return docs.withColumn("__candidates", _let(words, lambda w: F.transform(_candidates(w), describe)))


@dataclass(frozen=True)
class Forest:
    """Trees are nested tuples ``(feature, cut, below, above)``; a leaf is a share of secrets."""

    trees: tuple

    def score(self, row: dict[str, float] | Column) -> float | Column:
        """Mean share over the trees: a number for a row of numbers, a column for a struct."""
        total = sum((self._walk(t, row) for t in self.trees[1:]), self._walk(self.trees[0], row))
        return total / len(self.trees)

    def _walk(self, tree, row):
        if not isinstance(tree, tuple):
            return F.lit(tree) if isinstance(row, Column) else tree
        name, cut, below, above = tree
        if isinstance(row, Column):
            return F.when(row[name] <= cut, self._walk(below, row)).otherwise(self._walk(above, row))
        return self._walk(below if row[name] <= cut else above, row)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 1) -> Forest:
    """Trees on bootstrap samples; each split takes the best cut by Gini impurity of a random half of the features."""
    rng = np.random.default_rng(seed)

    def grow(rows: np.ndarray, left: int):
        share = float(y[rows].mean())
        if not left or share in (0.0, 1.0) or len(rows) < 2 * LEAST:
            return round(share, 4)
        best = None
        for j in rng.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]:
            v = x[rows, j]
            edges = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1)))
            for cut in (edges[1:] + edges[:-1]) / 2:
                low = v <= cut
                n = int(low.sum())
                if min(n, len(rows) - n) < LEAST:
                    continue
                a, b = y[rows[low]].mean(), y[rows[~low]].mean()
                gini = n * a * (1 - a) + (len(rows) - n) * b * (1 - b)
                if best is None or gini < best[0] - 1e-12:
                    best = (gini, int(j), float(cut), low)
        if best is None or best[0] >= len(rows) * share * (1 - share) - 1e-9:
            return round(share, 4)
        _, j, cut, low = best
        return (FEATURES[j], cut, grow(rows[low], left - 1), grow(rows[~low], left - 1))

    return Forest(tuple(grow(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)))


def train(labelled: DataFrame, limit: int = LABELLED) -> Forest:
    """A forest from ``text, is_secret``: snippets whose candidates have been judged.

    Of more than ``limit`` candidates, those with the smallest hashes are used.
    """
    rows = with_candidates(labelled).select(F.col("is_secret").cast("int").alias("y"), F.inline_outer("__candidates")).where("candidate is not null")
    rows = rows.orderBy(F.xxhash64("candidate", "word_index"), "candidate").limit(limit).collect()
    if not rows:
        raise ValueError("no labelled finding has a candidate")
    return fit_forest(np.array([[r[k] for k in FEATURES] for r in rows], float), np.array([r.y for r in rows], float))


class _Written:
    """Parts of the snippets that ``labelled_findings`` writes, drawn from one generator of random numbers."""

    WORDS = "the report with of and data from this that page table model into over under after before between river market garden letter".split()
    KEYS = "token TOKEN secret password api_key access_key client_secret auth pwd private_key".split()
    PLAIN = "YOUR_API_KEY_HERE_0000 xxxxxxxxxxxxxxxx1234 example_token_value_01 0000000000000000 change_this_secret_1 placeholder 1234567890123456 <your-token-here> default_password_1 required disabled optional string undefined localhost changeme process.env.TOKEN os.environ[0] ${PASSWORD} expired missing enabled".split()

    def __init__(self, seed: str):
        self.rng = random.Random(seed)

    def of(self, *choices: str) -> str:
        return self.rng.choice(choices)

    def word(self) -> str:
        return self.of(*self.WORDS)

    def hex(self, n: int) -> str:
        return self.rng.randbytes(n).hex()[:n]

    def mixed(self, n: int) -> str:
        return "".join(self.rng.choices(string.ascii_letters + string.digits, k=n))

    def number(self, most: int) -> str:
        return str(self.rng.randrange(most))

    def hash(self) -> str:
        return self.of(self.hex(40), self.hex(32), self.hex(64), self.hex(40).upper())

    def uuid(self) -> str:
        return "-".join(map(self.hex, (8, 4, 4, 4, 12)))

    def names(self) -> str:
        return "_".join([self.word(), self.word(), self.word(), self.number(2000)])

    def bare(self) -> str:
        """Keys that their beginnings give away. The beginnings are put together here, so that no line of this file looks like a key."""
        return self.of(
            "gh" + "p_" + self.mixed(36), "AK" + "IA" + self.mixed(16).upper(), "AK" + "IA" + self.hex(16).upper(), "sk" + "-" + self.mixed(40), "xo" + "xb-" + "".join(self.rng.choices(string.digits, k=12)) + "-" + self.mixed(24),
            "ey" + "J0" + self.mixed(30) + ".ey" + "J1" + self.mixed(36) + ".0" + self.mixed(43), "MI" + "IEv0" + self.mixed(58),
        )

    def short(self) -> str:
        """As people make them up: a word, numbers, a sign, capitals; six characters at least."""
        w, n = self.word(), self.rng.randrange(8, 16)
        made = self.of(w + self.number(9999), w.capitalize() + self.number(99) + self.of("!", "#", "x", "$", "_"), w[:3] + self.number(999) + self.word().capitalize(), w.translate(str.maketrans("aeio", "4310")) + self.number(99) + self.mixed(4), self.mixed(n))
        return (made + "7k27k2")[: max(6, len(made))]

    def value(self) -> str:
        n = self.rng.randrange(10, 41)
        return self.of(self.hash(), self.hex(n), self.hex(n), self.hex(n).upper(), self.mixed(n), self.mixed(n), self.bare(), self.bare(), self.short(), self.short(), self.short())

    def query_key(self) -> str:
        return f"https://{self.word()}.example.com/{self.word()}/{self.word()}?{self.of('page=2&', 'v=1&', '', '')}{self.of(*self.KEYS)}={self.of(self.mixed(20), self.hex(24), self.number(10**9) + self.hex(10), self.mixed(32))}"

    def login(self) -> str:
        return f"{self.of('postgres', 'mysql', 'amqp', 'https', 'redis', 'mongodb')}://{self.word()}:{self.of(self.short(), self.mixed(14), self.hex(20))}@{self.of('db', 'localhost:5432', 'host.example.com')}/{self.word()}"

    def secret(self) -> str:
        key, v = self.of(*self.KEYS), self.value()
        return self.of(f'{key} = "{v}"', f'{key}: "{v}"', f"{key}={v}", f"{key}: {v}", f"Authorization: Bearer {v}", f'"{key}":"{v}",', f"{key} is {self.mixed(36)}", self.bare(), self.of("use ", "see ", "( ", '"', "key ") + self.bare(), f"{self.word()}={self.bare()}", self.query_key(), self.login())

    def other(self) -> str:
        key, digits = self.of(*self.KEYS), "".join(self.rng.choices(string.digits, k=18))
        page = f"https://www.example.com/{self.word()}/{self.names()}{self.of('.html', '.png', '/', '.pdf')}"
        return self.of(
            self.of("commit ", "sha1: ", "md5 = ", "checksum ", "etag: ", "digest=", "revision ") + self.hash(), self.of("id ", "uuid: ", "request ", "trace=", "order ") + self.uuid(), page, page + self.of("?page=", "?id=", "?build=", "?order=") + self.of(self.hex(20), digits, self.names()),
            self.of("/usr/share/", "./", "docs/", "~/") + f"{self.names()}/{self.word()}{self.number(99)}.json", self.of("phone ", "card ", "invoice ", "order id = ", "isbn ", "") + digits, key + self.of(" = ", "=", ": ") + self.of(*self.PLAIN, self.word(), self.word() + self.word()),
            self.names(), f"{self.word()}-{self.word()}-{self.word()}-{self.word()}-{self.number(30)}", f"{self.word()}{self.number(99999)}{self.word()}{self.number(99999)}{self.word()}", f"{self.of('build ', 'version ', 'rev ')}{self.number(2000)}-{self.hex(16)}",
            key + self.of(" of commit ", " request uuid: ", " page ") + self.of(self.hash(), self.uuid(), page), self.of("the token ", "a secret ", "password reset ") + self.of(self.names(), f"docs/{self.names()}.json", digits), self.hash(),
        )

    def snippet(self, is_secret: bool) -> tuple[str, int]:
        return " ".join([self.word(), self.word(), self.secret() if is_secret else self.other(), self.word(), self.word()]), int(is_secret)


def labelled_findings(spark: SparkSession, n: int = 3000, seed: str = "labelled") -> DataFrame:
    """``text, is_secret``: ``n`` snippets written by rule, half of them secrets of usual forms, half
    look-alikes (check sums, identifiers, paths, numbers, placeholders, long names)."""
    written = _Written(seed)
    rows = [written.snippet(k % 2 == 0) for k in range(min(n, LABELLED))]
    return staged(spark.createDataFrame(rows, "text string, is_secret int"), "labelled")


def with_findings(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """``docs`` and ``__findings``: ``word_index, candidate, score`` of each candidate."""
    scored = F.transform("__candidates", lambda f: F.struct(f["word_index"].alias("word_index"), f["candidate"].alias("candidate"), forest.score(f).alias("score")))
    return with_candidates(docs, text_col).withColumn("__findings", scored).drop("__candidates")


def scan(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``doc_id, word_index, candidate_sha256, length, score, is_secret`` of each candidate; ``word_index`` counts from 0."""
    rows = with_findings(docs.select("doc_id", F.col(f"`{text_col}`").alias("text")), forest).select("doc_id", F.inline_outer("__findings")).where("candidate is not null")
    return rows.select("doc_id", "word_index", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").cast("long").alias("length"), F.round("score", 6).alias("score"), (F.round("score", 6) >= threshold).alias("is_secret"))


def _masked_word(piece: Column, candidate: Column) -> Column:
    """``piece`` with ``MASK`` for ``candidate`` where it is a run or an assigned value of its own."""
    run, quoted = "[A-Za-z0-9_+/-]", F.regexp_replace(candidate, r"([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])", r"\\$1")
    blank = r"[\x20\x09-\x0D]"
    as_run = F.concat(F.lit(f"(?<!{run})"), quoted, F.lit(f"(?:(?<==)|(?!{run}))"))
    as_value = F.concat(F.lit(rf"(?:(?<=[:=\x22'{_HARD_BLANK}])|(?<={blank})|^)"), quoted, F.lit(rf"(?=$|[\x22',}};@{_HARD_BLANK}]|&[A-Za-z0-9_.~%-]+=)"))
    return F.regexp_replace(piece, F.concat(as_run, F.lit("|"), as_value), F.lit(MASK))


def mask(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with each found secret replaced by ``MASK`` in its word, longest first, and
    ``n_chars`` anew where there is such a column and the text has changed."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    df = with_findings(docs.select(row, F.col(f"`{text_col}`").alias("text")), forest)
    text = F.col("text")
    # Each piece is a word and the blanks before it, so the piece of a word has the word's place.
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    found = lambda f: F.sort_array(F.transform(F.filter(f, lambda x: F.round(x["score"], 6) >= threshold), lambda x: F.struct(x["word_index"].cast("int").alias("at"), (-F.length(x["candidate"])).alias("n"), x["candidate"].alias("c"))))
    masked = lambda p, s, at: F.aggregate(F.array_distinct(F.filter(s, lambda x: x["at"] == at)), F.get(p, at), lambda t, x: _masked_word(t, x["c"]))
    between = lambda p, lo, hi: F.array_join(F.slice(p, lo + 1, hi - lo), "")

    def parts(p: Column, s: Column, at: Column) -> Column:
        lead = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(at, k - 1) + 1)
        heads = F.transform(at, lambda x, k: F.concat(between(p, lead(k), x), masked(p, s, x)))
        return F.concat(F.array_join(heads, ""), between(p, F.element_at(at, -1) + 1, F.size(p)))

    changed = lambda s: _let(pieces, lambda p: _let(F.array_distinct(s["at"]), lambda at: parts(p, s, at)))
    df = df.select("row", _let(found(F.col("__findings")), lambda s: F.when(F.size(s) > 0, changed(s))).alias("masked"))
    new, n = F.coalesce("masked", F.col(f"row.`{text_col}`")), F.length("masked")
    out = [new if c == text_col else F.coalesce(n.cast(docs.schema[c].dataType), F.col("row.n_chars")) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return df.select(*(x.alias(c) for x, c in zip(out, docs.columns, strict=True)))
