"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The training texts' tokens become postings (term, row, position), written in segments, one
for each task, that are sorted by term. A phrase of the test set is looked up from its
rarest term on, by the counts of the index: that term's postings are candidates; those stay
that have the second rarest in reach; for what is left, the other terms' postings in reach
are fetched, and their positions, less their offsets in the phrase, have to meet. All of
them meeting in one place is an exact occurrence; all within a few words more than the phrase
has, in any order, is a proximity match.

Terms that no test text has are not in the index, as no phrase asks for them. Postings are
dealt by term only where a rare term is looked up (or not at all, if the phrases are few
enough to be sent to them), else by row and place: a common word is no hot key.

Defined results: whole texts count, ``A-Z`` lower-cased; a null text has no words; repeated
rows of documents are judged each for itself; rows of the test set with one id are one
item, a null id is an item named ``null``, an item without words has no phrases; a null
document id is kept; no rows give no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, staged

#: What parts words, once A to Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a phrase, and how many more a proximity match may span.
PHRASE_WORDS, SLOP = 10, 2
#: Tables of at most so many (narrow) rows are broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 300_000
#: Positions of a document lie in stretches of so many, for joins by nearness.
STRETCH = 64


def words(text: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    # lower() is faster than translate() and changes the same letters where all are ASCII
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), GAP), "")


def sent(table: DataFrame) -> DataFrame:
    """``table`` (narrow, staged), to be broadcast if it is small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def terms_of(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, term``: a number for each distinct word of ``texts``."""
    return staged(texts.select(F.explode(words(F.col(f"`{text_col}`"))).alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()), "terms")


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``row, doc_id, term, pos`` of the words of ``docs`` that are in ``terms``, and for
    each row of ``docs`` one with null ``term`` whose ``pos`` is its number of words.

    With ``terms_of(docs)`` every token is in the index.
    """
    texts = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    tokens = rows.select("row", "doc_id", F.posexplode(F.array_append("words", F.lit(None).cast("string"))).alias("pos", "token"))
    postings = tokens.join(sent(terms), F.col("token") == F.col("word"), "left").where("term is not null or token is null")
    return staged(postings.select("row", "doc_id", "term", "pos").sortWithinPartitions("term", "row", "pos"), "index")


def phrases_of(texts: DataFrame, size: int = PHRASE_WORDS, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``phrase, words`` of all distinct phrases of ``size`` words (shorter texts are one phrase), and ``phrase, item``."""
    items = texts.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("item"), words(F.col(f"`{text_col}`")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    found = items.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, F.lit(size)))).alias("words")).distinct()
    found = staged(found, "windows")
    distinct = staged(found.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    return distinct, staged(found.join(distinct, "words").select("phrase", "item"), "phrase-items")


def plans(phrases: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """``phrase, size, rarest`` (array of ``n, offset, term``, the rarest first) and ``needs`` (``term, times``) of the
    phrases whose words all occur in the index."""
    counts = staged(index.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    spread = phrases.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("offset", "word")).join(terms, "word").join(counts, "term")
    whole = spread.groupBy("phrase", "size").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("rarest")).where(F.size("rarest") == F.col("size"))
    own = F.transform("rarest", lambda x: x["term"])
    needs = F.transform(F.array_distinct(own), lambda t: F.struct(t.alias("term"), F.size(F.filter(F.col("rarest"), lambda x: x["term"] == t)).alias("times")))
    return staged(whole.withColumn("needs", needs), "plans")


def _stretches(p: Column, reach: Column) -> Column:
    return F.sequence(F.floor((p - reach) / STRETCH), F.floor((p + reach) / STRETCH))


def matches(index: DataFrame, plan: DataFrame, slop: int = SLOP) -> DataFrame:
    """``phrase, row, start, size, exact``: one row for each place of a phrase's rarest term from which the
    phrase is found; ``start`` is the phrase's first word there, if ``exact``.

    What is not exact is a proximity match: all its words, as often as the phrase has them,
    in any order within ``size + slop`` words.
    """
    postings = index.where("term is not null").select("row", "term", "pos")
    first, second = F.get("rarest", F.lit(0)), F.get("rarest", F.lit(1))
    asked = plan.select("phrase", "size", first["term"].alias("t1"), first["offset"].alias("o1"), second["term"].alias("t2"))
    reach = F.col("size") - 1 + slop
    found = postings.join(sent(asked), F.col("term") == F.col("t1")).select("phrase", "size", "row", F.col("pos").alias("p"), "o1", "t2")
    found = staged(found, "rarest")

    # the second rarest term in reach
    near = found.where("t2 is not null").select("*", F.explode(_stretches(F.col("p"), reach)).alias("stretch"))
    seconds = asked.select("t2").where("t2 is not null").distinct()
    others = postings.join(sent(staged(seconds, "second-terms")), F.col("term") == F.col("t2"), "left_semi")
    others = others.select(F.col("row").alias("row2"), F.col("term").alias("term2"), F.col("pos").alias("q"), F.floor(F.col("pos") / STRETCH).alias("stretch2"))
    meet = (F.col("row") == F.col("row2")) & (F.col("t2") == F.col("term2")) & (F.col("stretch") == F.col("stretch2")) & (F.col("p") != F.col("q")) & (F.abs(F.col("p") - F.col("q")) <= reach)
    # a place near a border of stretches asks twice
    near = near.join(others, meet, "left_semi").drop("stretch").distinct()
    left = staged(near.unionByName(found.where("t2 is null")), "two-rarest")

    # all terms in reach of what is left
    asked = left.join(sent(plan.select("phrase", "needs")), "phrase").select("phrase", "row", "p", "size", F.explode("needs.term").alias("t"))
    asked = asked.select("*", F.explode(_stretches(F.col("p"), reach)).alias("stretch"))
    rows = sent(staged(left.select(F.col("row").alias("wanted")).distinct(), "wanted"))
    there = postings.join(rows, F.col("row") == F.col("wanted"), "left_semi").select(F.col("row").alias("row2"), F.col("term").alias("term2"), F.col("pos").alias("q"), F.floor(F.col("pos") / STRETCH).alias("stretch2"))
    meet = (F.col("row") == F.col("row2")) & (F.col("t") == F.col("term2")) & (F.col("stretch") == F.col("stretch2")) & (F.abs(F.col("p") - F.col("q")) <= reach)
    # at most 2 * reach + 1 places
    gathered = asked.join(there, meet).groupBy("phrase", "row", "p").agg(F.collect_set(F.struct(F.col("t").alias("term"), "q")).alias("found"))
    both = gathered.join(sent(plan), "phrase")
    begin = F.col("p") - F.get("rarest", F.lit(0))["offset"]
    exact = F.forall("rarest", lambda x: F.array_contains(F.col("found"), F.struct(x["term"].alias("term"), (begin + x["offset"]).alias("q"))))
    span = F.col("size") + slop
    covers = lambda s: F.forall(F.col("needs"), lambda w: F.size(F.filter(F.col("found"), lambda g: (g["term"] == w["term"]) & (g["q"] >= s) & (g["q"] < s + span))) >= w["times"])
    close = F.exists("found", lambda f: (f["q"] <= F.col("p")) & (f["q"] > F.col("p") - span) & covers(f["q"]))
    judged = both.select("phrase", "row", begin.alias("start"), "size", exact.alias("exact"), F.when(exact, F.lit(True)).otherwise(close).alias("close"))
    return staged(judged.where("close").drop("close"), "matches")


def hit_words(found: DataFrame) -> DataFrame:
    """``row, n_hit``: words inside any exact occurrence, each counted once."""
    spans = found.where("exact").groupBy("row", "start").agg(F.max("size").alias("size"))
    # one document's occurrences, in their order
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    return spans.select("row", new.alias("new")).groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))


def hit_items(found: DataFrame, phrase_items: DataFrame) -> DataFrame:
    """``row, n_items, items, n_near_items``: items with exact occurrences, their ids in order of text, and items with any match."""
    pairs = found.groupBy("row", "phrase").agg(F.max("exact").alias("exact")).join(sent(phrase_items), "phrase")
    pairs = pairs.groupBy("row", "item").agg(F.max("exact").alias("exact"))
    items = F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item"))))
    return pairs.groupBy("row").agg(F.count_if("exact").alias("n_items"), items.alias("items"), F.count(F.lit(1)).alias("n_near_items"))


def contamination(docs: DataFrame, tests: DataFrame, size: int = PHRASE_WORDS, slop: int = SLOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, n_near_items, contaminated`` of every document."""
    terms = terms_of(tests, item_text_col)
    index = build_index(docs, terms, id_col, text_col)
    phrases, phrase_items = phrases_of(tests, size, item_col, item_text_col)
    found = matches(index, plans(phrases, terms, index), slop)
    base = index.where("term is null").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    judged = base.join(hit_words(found), "row", "left").join(hit_items(found, phrase_items), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    none = F.array().cast("array<string>")
    return judged.select("doc_id", "n_words", n_hit.alias("n_hit"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_items", "n_near_items")), F.coalesce("items", none).alias("items"), (n_hit > 0).alias("contaminated"))
