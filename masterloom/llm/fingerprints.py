"""I-Match fingerprints over randomised lexicon subsets.

A term belongs to the lexicon if its inverse document frequency over the whole
table lies in a band: neither so common that every text has it nor so rare that
one edit changes everything. A text's fingerprint is a row of signatures: the
first hashes all its distinct lexicon terms in sorted order (classic I-Match),
the others hash what random subsets of the lexicon leave of them. Subsets keep from
a half down to 1/4096 of the terms; one that leaves more than ``FEW`` terms of a
text, which any edit would change, gives no signature. So texts of any length have
signatures of a few terms each, and the share that two texts have in common falls
gradually as they differ.

Everything runs in the row: terms are hashed, made distinct and looked up in a
lexicon that is a constant of the plan. The lexicon's size is proven: terms with a
document frequency of at least ``rarest`` times the number of documents are at most
the mean number of distinct terms divided by ``rarest``; of these, the terms with
the ``LEXICON`` smallest hashes are kept. Only term counts are shuffled.

Defined cases: null is the empty text; a text without lexicon terms is
fingerprinted by all its terms, one without any term by its characters, so equal
texts always agree and different ones hardly ever; repeated rows and ids are rows of
their own; an empty table has an empty lexicon and no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_columns

RAREST, COMMONEST = 0.001, 0.1
LEXICON = 1 << 18
CELLS = 1 << 14
ROWS, HALVINGS, FEW = 6, 12, 4
NOT_TERM = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct terms: lower-cased runs of letters and digits."""
    hashed = F.transform(F.split(F.lower(text), NOT_TERM), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(hashed), F.xxhash64(F.lit("")))


def _cell(term: Column) -> Column:
    return (F.pmod(term, F.lit(CELLS)) + 1).cast("int")


def lexicon(docs: DataFrame, text: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> Column:
    """The lexicon as a constant: an array of cells, each an array of term hashes.

    The counts cover every document. Partial counts leave each task, then one
    narrow row per term; at most ``LEXICON`` terms are gathered.
    """
    read = docs.select(terms(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("terms"))
    n = docs.agg(F.count("*")).first()[0]
    df = read.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = df.where((F.col("df") >= max(2.0, rarest * n)) & (F.col("df") <= max(2.0, commonest * n)))
    kept = band.select("term").orderBy("term").limit(LEXICON)
    cells = kept.groupBy(_cell(F.col("term")).alias("cell")).agg(F.collect_list("term").alias("terms"))
    every = docs.sparkSession.range(1, CELLS + 1).select(F.col("id").cast("int").alias("cell"))
    filled = every.join(cells, "cell", "left").select(
        "cell", F.coalesce("terms", F.array().cast("array<long>")).alias("terms"))
    gathered = filled.agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("cell", "terms"))), lambda c: c["terms"]))).first()[0]
    return F.from_json(F.lit(gathered), "array<array<bigint>>")  # folded once, when the plan is made


def signatures(df: DataFrame, text: str, words: Column, name: str) -> DataFrame:
    """Append ``name``, the array of signatures of the text column: one of all its
    lexicon terms, then one per subset; null where a subset leaves no or many terms.

    Each of ``ROWS`` rows of subsets halves the lexicon ``HALVINGS`` times, by one
    bit of a hash of the term after the other, so every list is filtered from the
    one before and a text of n terms costs 2n tests a row.
    """
    found, chosen = f"_{name}_t", f"_{name}_c"
    known = F.filter(found, lambda t: F.array_contains(F.element_at(words, _cell(t)), t))
    fallback = F.when(F.size(found) > 0, F.col(found)).otherwise(F.array(F.xxhash64(F.lit("text"), F.col(text))))
    kept = [F.col(f"`{c}`") for c in df.columns]
    # One select per step: each list is made once and read by all that follows.
    out = df.select(*kept, terms(F.col(text)).alias(found)).select(*kept, found, known.alias(chosen)).select(
        *kept, F.sort_array(F.when(F.size(chosen) > 0, F.col(chosen)).otherwise(fallback)).alias(chosen))
    lists = [f"_{name}_{i}" for i in range(ROWS)]
    out = out.select(*kept, F.array(F.hash(chosen)).alias(name), *[F.col(chosen).alias(x) for x in lists])

    def halved(x: str, row: int, bit: int) -> Column:
        return F.filter(x, lambda t: F.shiftright(F.xxhash64(t, F.lit(row)), bit).bitwiseAND(F.lit(1)) == 0)

    for bit in range(HALVINGS):
        out = out.select(*kept, name, *[halved(x, i, bit).alias(x) for i, x in enumerate(lists)])
        signs = [F.when(F.size(x).between(1, FEW), F.hash(x)) for x in lists]
        out = out.select(*kept, F.concat(name, F.array(*signs)).alias(name), *lists)
    return out.drop(*lists)


def written_out(signs: Column) -> Column:
    """The fingerprint as a string of hexadecimal words; ``-`` for none."""
    word = lambda s: F.coalesce(F.lower(F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), F.lit("-"))
    return F.array_join(F.transform(signs, word), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures among those that either text has."""
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(
        F.coalesce(x == y, F.lit(False))))
    told = F.filter(both, lambda x: x.isNotNull())
    return F.size(F.filter(told, lambda x: x)) / F.size(told)


def with_next(df: DataFrame, order: str, carried: list[str], buckets: int = 100) -> DataFrame:
    """Append ``next_<c>`` for each carried column: its value in the next row by
    the long ``order`` (null first, ties by the carried columns); the last row gets
    the first row's.

    Rows are cut into ``buckets`` x ``buckets`` ranges by approximate percentiles,
    so each row moves once and no task holds more than some ranges. The first rows
    of a range also go to the range before, as its end; which rows these are is a
    table of at most one id per range.
    """
    low = -(1 << 63)
    keyed = df.withColumn("_o", F.coalesce(F.col(order).cast("long"), F.lit(low)))
    n = buckets * buckets
    bounds = keyed.agg(F.percentile_approx("_o", [i / n for i in range(1, n)], 5 * n)).first()[0] or []
    bounds = sorted(set(bounds))
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)] or [[0]]
    heads = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
    fine = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    value = F.col("_o")
    upto = lambda xs: F.size(F.filter(xs, lambda b: b <= value))
    group = upto(heads)
    keyed = keyed.withColumn("_g", group).withColumn(
        "_b", F.when(F.col("_g") == 0, F.lit(0)).otherwise(
            (F.col("_g") - 1) * step + upto(F.element_at(fine, F.greatest("_g", F.lit(1))))))
    # First id of each range, and the range before it; the first goes to the last.
    firsts = keyed.groupBy("_b").agg(F.min("_o").alias("_o"))
    around = Window.partitionBy(F.lit(0)).orderBy("_b")
    whole = Window.partitionBy(F.lit(0))
    firsts = firsts.select("_o", F.coalesce(F.lag("_b").over(around), F.max("_b").over(whole)).alias("_before"))
    sent = keyed.join(F.broadcast(firsts), "_o", "left").withColumn(
        "_to", F.explode(F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("end"))))
                         .otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("end")),
                                            F.struct(F.col("_before").alias("b"), F.lit(1).alias("end"))))))
    inside = Window.partitionBy("_to.b").orderBy("_to.end", "_o", *carried)
    return (
        sent.withColumns({f"next_{c}": F.lead(c).over(inside) for c in carried})
        .where("_to.end = 0").drop("_o", "_g", "_b", "_before", "_to"))


def fingerprints(docs: DataFrame, words: Column | None = None) -> DataFrame:
    """doc_id, text (null becomes empty) and ``signs`` of every row of ``docs``.
    ``words`` is the lexicon; by default that of ``docs``."""
    read = own_columns(docs, "doc_id", "text").select(
        "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return signatures(read, "text", lexicon(docs) if words is None else words, "signs")
