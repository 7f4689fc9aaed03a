import random
import re
from collections import Counter
from zlib import crc32

from masterloom.llm.query_spelling import misspelt
from masterloom.llm.spelling import LONG, count_words, near_words, spelling_groups

from .helpers import clashing, frame, odd_documents

WORDS = "word string, n long"


def one_edit(a, b):
    """Whether two words differ by exactly one letter inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(counts):
    words, out = sorted(counts), {}
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root)
    return out


def grouped(spark, counts):
    rows = spelling_groups(clashing(frame(spark, list(counts.items()), WORDS).withColumnRenamed("n", "m")).drop("n").withColumnRenamed("m", "n"))
    assert set(rows.columns) == {"word", "n", "n_near", "form", "form_n", "root"}
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(8)
    counts = {}
    for _ in range(40):
        base = "".join(rng.choice("aabeé") for _ in range(rng.randrange(1, 10)))
        for _ in range(6):
            k = rng.randrange(len(base) + 1)
            word = rng.choice([base, base[:k] + rng.choice("abéÿ") + base[k:], base[:k] + base[k + 1:], base[:k] + "e" + base[k + 1:]])
            if word:
                counts[word] = 10 ** rng.randrange(5) * rng.randrange(1, 4)
    # Chains of forms, ties of frequency, the same word in runs of one letter.
    counts |= {"kettenglied": 1, "kettengliedx": 10, "kettengliedxy": 100, "kettengliedxyz": 1000, "aaaaaaa": 5, "aaaaaaaa": 50,
               "aaaaaaaaa": 50, "tieword": 1, "tiewore": 10, "tieworf": 10}
    got = grouped(spark, counts)
    assert got == brute(counts)
    assert got["kettenglied"][4] == "kettengliedxyz" and got["tieword"][2] == "tiewore"


def test_long_words(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefg") for _ in range(3000))
    edge = base[:LONG]
    counts = {base: 100, base[:-1]: 3, "x" + base: 3, base[:1500] + "x" + base[1501:]: 3, base[:9] + base[10:]: 3, base[::-1]: 7,
              edge: 40, edge + "x": 3, edge[1:]: 3, "x" + edge[1:]: 2, base[:LONG + 2]: 5, "a" * 200: 9, "a" * 201: 9, "a" * 203: 9}
    assert grouped(spark, counts) == brute(counts)


def test_counts_of_words(spark):
    docs = frame(spark, [*odd_documents(), (50, "Éclairs ÉCLAIRS éclairs eclairs×eclairs", "fr", "a", 1), (51, "éclairs " * 3, "fr", "a", 1)])
    want = Counter()
    for row in docs.collect():
        text = (row["text"] or "").translate({c: c + 32 for c in range(65, 91)})
        own = Counter(re.findall("[A-Za-zÀ-ÿ]+", text))
        for run, n in own.items():
            key = crc32(f"{'' if row['doc_id'] is None else row['doc_id']}:{run}".encode())
            word = run[:key % len(run)] + run[key % len(run) + 1:] if key % 31 == 0 else run
            want[word] += n
    want = {w: n for w, n in want.items() if n >= 2 and len(w) >= 7}
    got = {r["word"]: r["n"] for r in count_words(clashing(docs).repartition(3), change=misspelt).collect()}
    assert got == want and {"Éclairs", "éclairs", "eclairs"} & set(got)


def test_empty_and_null(spark):
    none = frame(spark, [], "doc_id long, text string")
    assert count_words(none).count() == 0 and spelling_groups(count_words(none)).count() == 0
    got = spelling_groups(frame(spark, [(None, 5), ("alone", 2)], WORDS)).collect()
    assert [(r["word"], r["n_near"], r["form"], r["root"]) for r in got] == [("alone", 0, None, "alone")]


def test_pairs_go_both_ways(spark):
    words = frame(spark, [("wordone",), ("wordome",), ("wordon",), ("unlike",)], "word string")
    got = {(r["word"], r["other"]) for r in near_words(words).collect()}
    want = {("wordone", "wordome"), ("wordone", "wordon")}
    assert got == want | {(b, a) for a, b in want}
