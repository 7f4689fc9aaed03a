"""Compatibility decomposition (NFKD) as native columns.

Characters that become one other are translated; those that become several are looked up,
Hangul syllables are computed; then runs of combining marks are put in canonical order.
Only texts that hold such characters come to the later steps. The tables are made from the
character data of the running Python.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3
LEADS, VOWELS, TAILS = 19, 21, 28


@cache
def _tables() -> dict:
    single, several, marks = {}, {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.combining(char):
            marks[char] = unicodedata.combining(char)
        if HANGUL_FIRST <= code <= HANGUL_LAST or 0xD800 <= code <= 0xDFFF:
            continue
        plain = unicodedata.normalize("NFKD", char)
        if plain != char:
            (single if len(plain) == 1 else several)[char] = plain
    listed = lambda table: "\x01".join(f"{k}\x02{v}" for k, v in table.items())
    return {
        "from": "".join(single), "to": "".join(single.values()), "several": listed(several),
        "marks": listed({k: f"{v:03d}" for k, v in marks.items()}),
    }


def _map(listed: str) -> Column:
    return F.str_to_map(F.lit(listed), F.lit("\x01"), F.lit("\x02"))


def _jamo(syllable: Column) -> Column:
    """The two or three letters of a Hangul syllable."""
    number = F.ascii(syllable) - HANGUL_FIRST

    def letter(first: int, count: int, place: Column) -> Column:
        return F.substr(F.lit("".join(map(chr, range(first, first + count)))), (place + 1).cast("int"), F.lit(1))

    tail = number % TAILS
    return F.concat(
        letter(0x1100, LEADS, F.floor(number / (VOWELS * TAILS))),
        letter(0x1161, VOWELS, F.floor(number % (VOWELS * TAILS) / TAILS)),
        F.when(tail > 0, letter(0x11A8, TAILS - 1, tail - 1)).otherwise(""))


def _expanded(text: Column) -> Column:
    several = _map(_tables()["several"])

    def plain(c: Column) -> Column:
        return (F.when(c <= "\x7f", c).when(c.between(chr(HANGUL_FIRST), chr(HANGUL_LAST)), _jamo(c))
                .otherwise(F.coalesce(F.try_element_at(several, c), c)))

    return F.array_join(F.transform(F.split(text, ""), plain), "")


def _ordered(text: Column) -> Column:
    """Stable sort of each run of combining marks by their classes."""
    classes = _map(_tables()["marks"])
    no_run = F.array().cast("array<struct<class:string,place:int,mark:string>>")
    marked = F.transform(F.split(text, ""), lambda c: F.struct(c.alias("c"), F.try_element_at(classes, c).alias("class")))

    def flushed(acc: Column) -> Column:
        return F.concat(acc["out"], F.array_join(F.transform(F.array_sort(acc["run"]), lambda m: m["mark"]), ""))

    def step(acc: Column, x: Column) -> Column:
        entry = F.struct(x["class"].alias("class"), F.size(acc["run"]).alias("place"), x["c"].alias("mark"))
        return F.when(x["class"].isNull(), F.struct(F.concat(flushed(acc), x["c"]).alias("out"), no_run.alias("run"))).otherwise(
            F.struct(acc["out"].alias("out"), F.array_append(acc["run"], entry).alias("run")))

    return F.aggregate(marked, F.struct(F.lit("").alias("out"), no_run.alias("run")), step, flushed)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that stands in the plan, and is computed, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nfkd(text: Column) -> Column:
    """Full NFKD of a text."""
    translated = F.translate(text, _tables()["from"], _tables()["to"])
    expanded = _let(translated, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), _expanded(t)).otherwise(t))
    return _let(expanded, lambda t: F.when(t.rlike(r"[^\x00-\x7F]{2}"), _ordered(t)).otherwise(t))
