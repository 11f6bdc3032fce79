"""Licence notices in texts: lines and windows of words compared to templates by the Dice coefficient over word bigrams.

A text and a template are normalised alike: A-Z in lower case, everything but ASCII letters and digits as a word
boundary. With n and m distinct bigrams, a Dice coefficient of at least t needs m t / (2 - t) <= n <= m (2 - t) / t,
so a line or window is only compared to the templates whose bounds its size lies in. Windows run across line ends, as
notices are wrapped, and begin and end at bigrams of their template. A match has at least m t / (2 - t) of its
template's bigrams, which most documents don't have of any and are passed over. All of it is SQL over a row's own
arrays: nothing is shuffled, joined or handed to Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Licence notices by SPDX id. A licence may have several.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License, see the LICENSE file for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work has been dedicated to the public domain under the CC0 1.0 Universal dedication."),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """The normalised words of a template."""
    kept = "".join(c if c in LOWER + "0123456789" else " " for c in text.translate(str.maketrans(UPPER, LOWER)))
    return kept.split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def telling_words(found: list[str], least: int) -> set[str]:
    """Words of a template, the longest first, that are in so many of its bigrams that any ``least`` hold one."""
    words, open_pairs = set(), [b.split() for b in found]
    for word in sorted({w for b in open_pairs for w in b}, key=lambda w: (-len(w), w)):
        if len(open_pairs) < least:
            break
        words.add(word)
        open_pairs = [b for b in open_pairs if word not in b]
    return words


def words_sql(text: str) -> str:
    """The normalised words of a text, as SQL; of a text without words, one empty word."""
    return f"split(trim(regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ')), ' ')"


def pairs_sql(words: str) -> str:
    """The bigrams of an array of words in order, as SQL."""
    return f"zip_with(slice({words}, 1, greatest(size({words}) - 1, 0)), slice({words}, 2, greatest(size({words}) - 1, 0)), (a, b) -> concat(a, ' ', b))"


def step(df: DataFrame, keep: str, **columns: str) -> DataFrame:
    """Columns by name and SQL behind the kept ones. The generator makes each value once; as projections, the
    optimizer would move them into the lambda functions that use them."""
    values = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return df.selectExpr(*filter(None, keep.split()), f"inline(array(struct({values})))")


def scan(documents: DataFrame, threshold: float = THRESHOLD, templates=None) -> DataFrame:
    """(doc_id, line_no, licence, template_no, dice, n_bigrams): for each line, counted from 0, that reaches the
    threshold and for each window of words that does, its best template; ties of lines go to the smallest number.

    Of windows, the best that don't overlap count, each at the line that it begins in: those within a line only where
    the line itself has no match, and those across line ends unless a line that they touch matches as well or better;
    they stand for the lines they touch. Null, empty and one-word texts have no bigrams and match nothing. Repeated
    rows give repeated matches, and a null doc_id stays null. The threshold counts in whole hundredths.
    """
    templates, t = TEMPLATES if templates is None else templates, round(threshold * 100)
    known = [(number, found) for number, (_, text) in enumerate(templates) if (found := bigrams_of(text))]
    array = lambda found: f"array({', '.join(map(quoted, found))})"
    every = list(dict.fromkeys(b for _, found in known for b in found))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not known:
        return texts.limit(0).selectExpr("doc_id", "0L line_no", "'' licence", "0 template_no", "0D dice", "0L n_bigrams")
    # A match has at least m t / (2 - t) of its template's m bigrams, and most texts don't have that many of any.
    some = {w for _, found in known for w in telling_words(found, -(-len(found) * t // (200 - t)))}
    worded = step(texts.where("text is not null"), "doc_id text", words=words_sql("text"))
    here = step(worded.where(f"arrays_overlap(words, {array(sorted(some))})"), "doc_id text words", here=f"array_intersect({pairs_sql('words')}, {array(every)})").where("size(here) > 0")
    listed = ", ".join(f"named_struct('number', {number}, 'm', {len(found)}, 'least', {-(-len(found) * t // (200 - t))}, 'longest', {len(found) * (200 - t) // t}, 'bigrams', {array(found)})" for number, found in known)
    near = step(here, "doc_id text words", near=f"filter(array({listed}), x -> size(array_intersect(here, x.bigrams)) >= x.least)").where("size(near) > 0")
    lined = step(near, "doc_id words near", by_line=f"transform(split(text, '\\n'), line -> filter({words_sql('line')}, w -> w <> ''))", pairs=pairs_sql("words"))
    # The line of each word, the distinct bigrams of each line, and where each template's bigrams are.
    placed = step(
        lined,
        "doc_id pairs",
        line_of="flatten(transform(by_line, (x, i) -> array_repeat(i, size(x))))",
        line_pairs=f"transform(by_line, x -> array_distinct({pairs_sql('x')}))",
        near="transform(near, x -> named_struct('number', x.number, 'm', x.m, 'least', x.least, 'longest', x.longest, 'bigrams', x.bigrams, 'hits', filter(transform(pairs, (p, i) -> if(array_contains(x.bigrams, p), i, -1)), i -> i >= 0)))",
    )
    # size bounds: m t / (2 - t) <= n <= m (2 - t) / t
    dice_of_line = f"if(size(p) * {200 - t} >= x.m * {t} and size(p) * {t} <= x.m * {200 - t}, 2D * size(array_intersect(p, x.bigrams)) / (size(p) + x.m), 0D)"
    best_of_line = f"array_max(filter(transform(near, x -> named_struct('dice', {dice_of_line}, 'less', -x.number, 'n', size(p))), x -> x.dice >= {threshold}))"
    within = "slice(pairs, first + 1, last - first + 1)"
    window = f"named_struct('number', x.number, 'm', x.m, 'first', first, 'last', last, 'n', size(array_distinct({within})), 'shared', size(array_intersect({within}, x.bigrams)))"
    matched = step(
        placed,
        "doc_id line_of",
        lines=f"filter(transform(line_pairs, (p, i) -> named_struct('line', i, 'best', if(size(p) > 0, {best_of_line}, null))), x -> x.best is not null)",
        windows=f"flatten(transform(near, x -> flatten(transform(x.hits, (first, a) -> transform(filter(slice(x.hits, a + x.least, x.longest), last -> last - first < x.longest), last -> {window})))))",
    )
    # Best first; of equal windows the larger template tells more.
    ordered = step(
        matched,
        "doc_id lines",
        windows=f"array_sort(transform(filter(windows, x -> x.shared * 200 >= {t} * (x.n + x.m)), x -> named_struct('less', -2D * x.shared / (x.n + x.m), 'less_m', -x.m, 'number', x.number, 'first', x.first, 'last', x.last, 'n', x.n, 'begin', line_of[x.first], 'end', line_of[x.last + 1])))",
    )
    touched = "filter(lines, y -> y.line between x.begin and x.end)"
    free = step(ordered, "doc_id lines", windows=f"filter(windows, x -> size({touched}) = 0 or x.begin < x.end and array_max(transform({touched}, y -> y.best.dice)) < -x.less)")
    taken = step(free, "doc_id lines", taken="aggregate(windows, slice(windows, 1, 0), (found, x) -> if(exists(found, y -> x.first <= y.last + 1 and y.first <= x.last + 1), found, concat(found, array(x))))")
    rows = "concat(transform(taken, x -> named_struct('line_no', x.begin, 'template_no', x.number, 'dice', -x.less, 'n', x.n)), transform(filter(lines, x -> not exists(taken, y -> x.line between y.begin and y.end)), x -> named_struct('line_no', x.line, 'template_no', -x.best.less, 'dice', x.best.dice, 'n', x.best.n)))"
    licences = array([licence for licence, _ in templates])
    return taken.selectExpr("doc_id", f"inline({rows})").selectExpr("doc_id", "cast(line_no as bigint) line_no", f"element_at({licences}, template_no + 1) licence", "template_no", "dice", "cast(n as bigint) n_bigrams")


def oracle(threshold: float = THRESHOLD) -> str:
    """The same over DuckDB's view documents."""
    rows = ", ".join(f"({n}, {quoted(licence)}, [{', '.join(map(quoted, bigrams_of(text)))}])" for n, (licence, text) in enumerate(TEMPLATES))
    return f"""
WITH templates(template_no, licence, bigrams) AS (VALUES {rows}),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE text IS NOT NULL),
worded AS (
  SELECT doc_id, line_no, string_split(trim(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM lines),
sized AS (
  SELECT doc_id, line_no, list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) AS bigrams FROM worded WHERE len(words) > 1),
scored AS (
  SELECT doc_id, line_no, licence, template_no, len(s.bigrams) AS n,
         2.0::DOUBLE * len(list_intersect(s.bigrams, t.bigrams)) / (len(s.bigrams) + len(t.bigrams)) AS dice
  FROM sized s JOIN templates t ON list_has_any(s.bigrams, t.bigrams))
SELECT doc_id, line_no::BIGINT AS line_no, licence, template_no::INTEGER AS template_no, dice, n::BIGINT AS n_bigrams
FROM scored WHERE dice >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, template_no) = 1
"""
