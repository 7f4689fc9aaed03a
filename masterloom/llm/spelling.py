"""Spelling variants: words one edit apart, found by a relational trie frontier.

Words are kept in tries, one for each length and direction. A search state is (word, position
in the word, node, edits); a node is the prefix that leads to it. Level by level, the states
at one depth are joined with the edge table of that depth: a state that has used its edit
follows the edge of its own letter, one that hasn't takes each greater letter as a
replacement, or leaves its own letter out and goes on in the trie of words shorter by one.
Inserts are the same links seen from the other word. Terminal states are neighbours.

What keeps the frontier small: a word's edit lies in its second half, forwards or backwards,
so a state starts at the node of its first half; its states without an edit lie on the
word's own path and need no join; edges are looked up by the two letters that follow as
well, so a state that would die within two levels isn't made. Edges of a node are at most one
per letter, and states are never gathered, so no prefix is too frequent. Each level is a
written table, and levels end with the longest word. Words of more than ``LONG`` letters
take all of what follows, as a hash, for the letters looked up: one level, then verified.

A word's *form* is its most frequent neighbour (ties: first in code-point order), if that
is at least ``times`` as frequent; its *root* is where following forms ends. Counts grow by
that factor at each step, so rounds are few.

Defined cases: texts that are null have no words; words must be distinct in the table given,
those that are null are left out; words without a neighbour are their own root; no words, no
rows; other columns don't matter. A word of L letters above ``LONG`` costs L hashes of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import own_columns

LONG = 40
TIMES = 10
SHORTEST, LEAST = 7, 2
LETTERS = "A-Za-zÀ-ÿ"
HELD = 200_000

# (doc_id, words) -> the words to count in their place.
Change = Callable[[str, list[str]], list[str]]


def _counter(shortest: int, change: Change | None):
    run = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def emit(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                # Lower-casing bytes changes A-Z only.
                own = Counter(run.findall((text.as_py() or b"").lower().decode()))
                words = change(doc_id.as_py() or "", list(own)) if change else own
                for word, n in zip(words, own.values()):
                    if len(word) >= shortest:
                        total[word] += n
                if len(total) > HELD:
                    yield emit(total)
                    total.clear()
        yield emit(total)

    return count


def count_words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, change: Change | None = None) -> DataFrame:
    """(word, n): the runs of letters of whole texts of ``docs`` (doc_id, text), lower-cased
    (A-Z only), of at least ``shortest`` letters and ``least`` occurrences. ``change`` may
    rewrite the distinct words of a document, one for one."""
    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("string"), F.col("text").cast("string").cast("binary"))
    # Counts are summed per task before they are shuffled.
    parts = own.mapInArrow(_counter(shortest, change), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _near_by_levels(keys: DataFrame) -> DataFrame:
    """(side, word, other) of words of at most ``LONG`` letters, by the trie frontier."""
    at = lambda text, k: F.substring(text, k + 1, 1)
    shortest, longest = keys.agg(F.min("start"), F.max("size")).first()
    found = keys.select("side", F.col("key").alias("word"), F.col("key").alias("other")).limit(0)
    frontier = None
    for depth in range(shortest or 0, longest or 0):
        here = keys.where(F.col("start") <= depth).where(F.col("size") > depth).withColumns({
            "path": F.left("key", F.lit(depth)), "letter": at("key", depth), "after": at("key", depth + 1)})
        edges = here.groupBy("side", "size", "path", F.substring("key", depth + 2, 2).alias("look")).agg(
            F.collect_set("letter").alias("letters"))
        replacing = here.select("side", "size", F.col("key").alias("word"), F.lit(depth).alias("pos"), "path", F.lit(0).alias("edits"))
        # Of equal letters in a row the last is left out, as any gives the same word.
        shorter = here.where((F.col("letter") != F.col("after")) & (F.col("after") != "")).select(
            "side", (F.col("size") - 1).alias("size"), F.col("key").alias("word"), F.lit(depth + 1).alias("pos"), "path",
            F.lit(1).alias("edits"))
        states = replacing.unionByName(shorter)
        if frontier is not None:
            states = states.unionByName(frontier.where(F.length("path") < F.col("size")))
        states = states.withColumns({
            "letter": F.substr("word", F.col("pos") + 1, F.lit(1)), "look": F.substr("word", F.col("pos") + 2, F.lit(2))})
        taken = F.when(F.col("edits") == 1, F.filter("letters", lambda x: x == F.col("letter"))).otherwise(
            F.filter("letters", lambda x: x > F.col("letter")))
        frontier = states.join(edges, ["side", "size", "path", "look"]).select(
            "side", "size", "word", (F.col("pos") + 1).alias("pos"), "path", F.explode(taken).alias("letter")).select(
            "side", "size", "word", "pos", F.concat("path", "letter").alias("path"), F.lit(1).alias("edits"))
        frontier = written(frontier, "trie_level")
        found = found.unionByName(frontier.where(F.length("path") == F.col("size")).select("side", "word", F.col("path").alias("other")))
    return found


def _near_long(words: DataFrame) -> DataFrame:
    """(word, other) where word has more than ``LONG`` letters."""
    size = F.length("word")
    holes = words.where(size > LONG).select("word", size.alias("size"), F.explode(F.sequence(F.lit(1), size)).alias("pos")).withColumns({
        "letter": F.substr("word", F.col("pos"), F.lit(1)),
        "head": F.xxhash64(F.left("word", F.col("pos") - 1)), "tail": F.xxhash64(F.substr("word", F.col("pos") + 1))})
    other = holes.select("size", "pos", "head", "tail", F.col("letter").alias("other_letter"), F.col("word").alias("other"))
    replaced = holes.join(other, ["size", "pos", "head", "tail"]).where(F.col("letter") < F.col("other_letter"))
    whole = words.where(size >= LONG).select(F.xxhash64("word").alias("whole"), F.col("word").alias("other"))
    shorter = holes.withColumn("whole", F.xxhash64(F.concat(F.left("word", F.col("pos") - 1), F.substr("word", F.col("pos") + 1))))
    both = replaced.select("word", "other").unionByName(shorter.join(whole, "whole").select("word", "other"))
    return both.distinct().where(F.levenshtein("word", "other", 1) == 1)


def near_words(words: DataFrame) -> DataFrame:
    """(word, other) for all words of a written table (word) that differ by exactly one letter
    inserted, deleted or replaced; both ways."""
    size = F.length("word")
    short = words.where(size <= LONG).select("word", size.alias("size"))
    keys = short.select(F.lit(0).alias("side"), F.col("word").alias("key"), "size", F.floor(F.col("size") / 2).cast("int").alias("start")).unionByName(
        short.select(F.lit(1).alias("side"), F.reverse("word").alias("key"), "size", F.ceil(F.col("size") / 2).cast("int").alias("start")))
    keys = written(keys, "trie_keys")
    # Words without their last letter are at the end of the shorter trie at once.
    cut = keys.select("side", F.col("key").alias("word"), F.left("key", F.col("size") - 1).alias("other"))
    turned = lambda name: F.when(F.col("side") == 1, F.reverse(name)).otherwise(F.col(name)).alias(name)
    cut = cut.select(turned("word"), turned("other")).join(words.select(F.col("word").alias("other")), "other", "left_semi")
    found = _near_by_levels(keys).select(turned("word"), turned("other"))
    pairs = found.unionByName(cut).unionByName(_near_long(words))
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct()


def spelling_groups(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """One row per word of ``counts`` (word, n): word, n, n_near (words one edit away), form
    and form_n (null if no neighbour is frequent enough) and root."""
    words = written(own_columns(counts, "word", "n").where(F.col("word").isNotNull()), "words")
    others = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = near_words(words).join(others, "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best"))
    own = words.join(best, "word", "left")
    rich = -F.col("best.n") >= times * F.col("n")
    near = written(own.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(rich, F.col("best.form")).alias("form"), F.when(rich, -F.col("best.n")).alias("form_n")), "near_words")

    forms = near.where("form IS NOT NULL").select(F.col("word").alias("at"), F.col("form").alias("to"))
    moving = near.where("form IS NOT NULL").select("word", F.col("form").alias("at"))
    ended = near.select("word", F.col("word").alias("root")).limit(0)
    while True:
        stepped = written(moving.join(forms, "at", "left"), "forms")
        ended = ended.unionByName(stepped.where("to IS NULL").select("word", F.col("at").alias("root")))
        moving = stepped.where("to IS NOT NULL").select("word", F.col("to").alias("at"))
        if moving.isEmpty():
            break
    return near.join(ended, "word", "left").withColumn("root", F.coalesce("root", "word"))
