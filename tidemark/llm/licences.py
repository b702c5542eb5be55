"""Licence scan by canonical digests, with DataFrame functions only.

A text is brought to a canonical form (lower case, copyright lines dropped,
equivalent spellings made one, punctuation and white space reduced to single
spaces) and hashed. The digests of entire texts, of a document, of each of its
paragraphs and of each of its lines, are hash-joined to the digests of known licence
texts and notices. No step of the canonical form looks across a line's end, so a
document is brought to it once, line by line, and its paragraphs and itself are its
lines put together. The known table is a fixed part of this package, which bounds the
broadcast.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import licence_texts
from tidemark.llm.common import text_key

#: Fixed values: (licence, text) of notices of one line.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
)

#: Spellings that count as the same.
EQUIVALENT = (("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("http://", "https://"), ("v. ", "version "), (" v2", " version 2"), (" v3", " version 3"))

COPYRIGHT_LINE = r"(?m)^[^\n]*(copyright|©|\(c\)) [^\n]*[0-9]{4}[^\n]*$|^[^\n]*all rights reserved[^\n]*$"
#: Without one of these a text has no copyright line.
COPYRIGHT_SIGNS = ("copyright ", "© ", "(c) ", "all rights reserved")
NOT_WORD = r"[^\p{L}\p{N}]+"
#: What parts paragraphs, and the end of licences that have an appendix.
BLANK_LINES, END_OF_TERMS = r"\r?\n(?:[ \t\r]*\n)+", "END OF TERMS AND CONDITIONS"
#: BLANK_LINES without a group, for which Java takes a stack frame a line; the line that stands for blank ones, what a
#: text's own such characters become; and what is no word, mark or line's end.
ANY_BLANK_LINES, MARK, NO_MARK, NOT_WORD_IN_LINE = r"\r?\n[ \t\r\n]*\n", "\x01", "\x02", r"[^\p{L}\p{N}\n\x01]+"
WHOLE, LINE, PARAGRAPH = 0, 1, 2


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): notices, and licences with and without a title and an appendix."""
    out = [*KNOWN, *licence_texts.NOTICES]
    for licence, titles, text in licence_texts.WHOLE:
        body, end, _ = text.partition(END_OF_TERMS)
        out += [(licence, f"{title}\n\n{t}") for t in dict.fromkeys((text, body + end)) for title in ("", *titles)]
    return out


def evened(low: Column) -> Column:
    """A text in lower case without copyright lines, equivalent spellings made one."""
    has_sign = functools.reduce(Column.__or__, [low.contains(sign) for sign in COPYRIGHT_SIGNS])
    out = F.when(has_sign, F.regexp_replace(low, COPYRIGHT_LINE, " ")).otherwise(low)
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical(text: Column) -> Column:
    """Canonical form; may be empty."""
    return F.trim(F.regexp_replace(evened(F.lower(text)), NOT_WORD, " "))


def canonical_parts(rows: DataFrame) -> DataFrame:
    """(doc_id, key, kind, form): canonical forms of each text, of its lines with a word, and of its paragraphs of several such lines."""
    marked = F.regexp_replace(F.replace("text", F.lit(MARK), F.lit(NO_MARK)), ANY_BLANK_LINES, f"\n{MARK}\n")
    low = rows.select("doc_id", text_key().alias("key"), F.lower(marked).alias("low"))
    forms = low.select("doc_id", "key", F.split(F.regexp_replace(evened(F.col("low")), NOT_WORD_IN_LINE, " "), "\n").alias("lines"))
    lines = forms.select("doc_id", "key", F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: x != "").alias("lines"))
    paragraphs = F.transform(F.split(F.array_join("lines", "\n"), MARK), lambda p: F.trim(p, F.lit("\n")))
    several = F.filter(paragraphs, lambda p: p.contains("\n"))  # others are lines
    words = lines.select("doc_id", "key", F.array_remove("lines", MARK).alias("lines"), several.alias("several"))
    of_kind = lambda kind: lambda form: F.struct(F.lit(kind).alias("kind"), form.alias("form"))
    parts = F.concat(F.array(of_kind(WHOLE)(F.array_join("lines", " "))), F.transform("lines", of_kind(LINE)), F.transform("several", lambda p: of_kind(PARAGRAPH)(F.replace(p, F.lit("\n"), F.lit(" ")))))
    return words.select("doc_id", "key", F.explode(parts).alias("part")).select("doc_id", "key", "part.*")


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, digest of its canonical text, licence of the whole text (null if none is
    known), n_license_lines and licenses (ids of its lines and of its paragraphs of several lines,
    distinct, sorted, comma-joined; empty without any).

    Null text counts as empty. Rows of one id and one text get the same result, each its own row; a null
    id is a document like others. Very long texts are taken whole, line by line. An empty table gives an
    empty result. Further columns, whatever their names, aren't looked at. A known text without a word is
    found as a whole text only.
    ``known`` (license_id, text) replaces the built-in table; it's broadcast, so keep it small.
    """
    spark = docs.sparkSession
    table = known if known is not None else spark.createDataFrame(known_texts(), "license_id string, text string")
    table = table.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = canonical_parts(rows).select("doc_id", "key", "kind", F.sha2("form", 256).alias("digest"))
    is_whole, is_line = F.col("kind") == WHOLE, F.col("kind") == LINE
    hits = parts.join(F.broadcast(table), "digest", "left").where(is_whole | F.col("license_id").isNotNull())
    # Rows that repeat an id and its text would count each other's lines: their number tells how often.
    found = hits.groupBy("doc_id", "key").agg(
        F.count_if(is_whole).alias("copies"), F.max(F.when(is_whole, F.col("digest"))).alias("digest"), F.max(F.when(is_whole, F.col("license_id"))).alias("license_id"),
        F.count_if(is_line).alias("lines"), F.array_join(F.array_sort(F.collect_set(F.when(~is_whole, F.col("license_id")))), ",").alias("licenses"),
    )
    out = found.select("doc_id", "digest", "license_id", (F.col("lines") / F.col("copies")).cast("long").alias("n_license_lines"), "licenses", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return out.drop("_copy")


def oracle_sql() -> str:
    """The same for DuckDB over ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def digest(text: str) -> str:
        form = f"regexp_replace(lower({text}), {quote(COPYRIGHT_LINE)}, ' ', 'g')"
        for a, b in EQUIVALENT:
            form = f"replace({form}, {quote(a)}, {quote(b)})"
        return f"sha256(trim(regexp_replace({form}, {quote(NOT_WORD)}, ' ', 'g')))"

    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in dict.fromkeys(known_texts()))
    return f"""
    WITH known AS (SELECT {digest('text')} AS digest, min(license_id) AS license_id FROM (VALUES {values}) t(license_id, text) GROUP BY 1),
    d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    parts AS (SELECT doc_id, true AS is_line, unnest(string_split(text, chr(10))) AS part FROM d
      UNION ALL SELECT doc_id, false, part FROM (SELECT doc_id, unnest(regexp_split_to_array(text, {quote(BLANK_LINES)})) AS part FROM d) WHERE contains(trim(part, ' ' || chr(9) || chr(13) || chr(10)), chr(10))),
    hits AS (SELECT doc_id, count(*) FILTER (is_line) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS licenses
             FROM (SELECT doc_id, is_line, {digest('part')} AS digest FROM parts WHERE part <> '') JOIN known USING (digest) GROUP BY 1),
    whole AS (SELECT doc_id, {digest('text')} AS digest FROM d)
    SELECT w.doc_id, w.digest, k.license_id, coalesce(h.n, 0)::BIGINT AS n_license_lines, coalesce(h.licenses, '') AS licenses
    FROM whole w LEFT JOIN hits h USING (doc_id) LEFT JOIN known k USING (digest)
    """
