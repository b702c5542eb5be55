"""Text functions as column expressions; null counts as empty text."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a listing (Dutch, French, English).
STOP_WORDS = (
    "de het een en van in op met voor te aan is of bij uit door naar dit deze die dat er ook als zeer ruime ruim mooie mooi gelegen nabij "
    "le la les un une des du et dans sur avec pour au aux ce cette tres belle beau situe situee the and with for this that "
    "koop huur vendre louer sale rent verkoop woning immo"
).split()
#: Legal forms dropped from an agency's name.
LEGAL_FORMS = "bv bvba nv sa sprl srl comm va cvba vzw asbl sc scs gcv eenmanszaak bvbaa".split()
#: White space as browsers see it.
SPACE = r"[\s   -     　﻿]+"


@functools.cache
def _folding() -> tuple[str, str]:
    """Characters whose decomposition starts with a Latin letter or a digit, and that letter."""
    found = []
    for point in range(0x80, sys.maxunicode + 1):
        c = chr(point)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M")).lower()
        if base != c and len(base) == 1 and base.isascii() and base.isalnum():
            found.append((c, base))
    return "".join(c for c, _ in found), "".join(b for _, b in found)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normalize_text(c: Column) -> Column:
    """Accents and case folded, everything but letters a-z and digits one space."""
    source, target = _folding()
    folded = F.lower(F.translate(text_or_empty(c), source, target))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"\p{M}+", ""), "[^a-z0-9]+", " "))


def normalize_key(c: Column) -> Column:
    return F.replace(normalize_text(c), F.lit(" "), F.lit(""))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalize_text(c), " "), lambda t: t != "")


def content_tokens(c: Column) -> Column:
    stop = F.array(*map(F.lit, dict.fromkeys(STOP_WORDS)))
    return F.filter(tokens(c), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    return token_jaccard(F.array_distinct(content_tokens(a)), F.array_distinct(content_tokens(b)))


def token_jaccard(x: Column, y: Column) -> Column:
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein; of texts over 256 characters the longer one's length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 256, longest).otherwise(F.levenshtein(a, b))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of the normalised texts; 0 if either is empty."""
    return normal_similarity(normalize_text(a), normalize_text(b))


def normal_similarity(x: Column, y: Column) -> Column:
    """``similarity`` of texts that are normalised already."""
    longest = F.greatest(F.length(x), F.length(y))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - edit_distance(x, y) / longest))


def description_similarity(a: Column, b: Column) -> Column:
    head = lambda c: F.substring(text_or_empty(c), 1, 240)
    return F.greatest(jaccard(a, b), similarity(head(a), head(b)))


def truncate_text(c: Column, limit: int) -> Column:
    """Cut at a word's end if that keeps over 0.6 of the limit, with an ellipsis."""
    cut = F.substring(c, 1, limit)
    last = F.length(cut) - F.instr(F.reverse(cut), " ")
    at_word = F.when((F.instr(cut, " ") > 0) & (last > 0.6 * limit), cut.substr(F.lit(1), last)).otherwise(cut)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(at_word), F.lit("…")))


def agency_name(c: Column) -> Column:
    forms = F.array(*map(F.lit, LEGAL_FORMS))
    return F.array_join(F.filter(tokens(c), lambda t: ~F.array_contains(forms, t)), " ")


def clean(c: Column) -> Column:
    """White space collapsed and trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, SPACE, " ")), F.lit(""))


def name_key(c: Column) -> Column:
    """Sorted tokens of more than one letter; null without any."""
    return F.nullif(F.array_join(F.array_sort(F.filter(tokens(c), lambda t: F.length(t) > 1)), " "), F.lit(""))


def is_poorer_name(current: Column, new: Column) -> Column:
    """The new name's tokens are some, not all, of the current one's."""
    x, y = F.array_distinct(tokens(current)), F.array_distinct(tokens(new))
    return (F.size(F.array_except(y, x)) == 0) & (F.size(y) < F.size(x))


def first_contained(c: Column, needles: list[str]) -> Column:
    """The first needle that the text contains, or null."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, needles)), lambda n: F.contains(c, n)), F.lit(1))


def label_number(c: Column) -> Column:
    """1234567 as 1.234.567."""
    return F.translate(F.format_number(c, 0), ",", ".")
