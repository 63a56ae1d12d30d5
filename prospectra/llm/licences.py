"""Operator 6, licence scans: Dice coefficient of word bigrams between normalised text and licence templates.

Candidates of a text are its lines, its blocks between blank lines, the whole text, and, wherever it has a template's first
two words one after the other, as many words from there as the template has: a notice may stand beside other words, or run
over lines and comment signs. Candidates that are equal when normalised count once. Normalised: lower case, everything but
a-z and 0-9 becomes one space. A template can reach the threshold t only for candidates with
between t/(2-t) and (2-t)/t times its bigrams; others are not compared. A match has a Dice coefficient of t or more, so
it holds at least t/(2-t) of a template's bigrams: texts without any of the words that so many bigrams can't do without
are passed over (nothing is lost by it).
No Python runs on executors; nothing is shuffled but the matches.

Null, empty and one-word texts have no bigrams and no matches; a repeated line counts once. Very long texts are read whole.
Rows with the same key count as one document. Empty tables stay empty. Columns other than key and text take no part.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

THRESHOLD = 0.8

# Wording of public licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}


def normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(w: str) -> Column:
    """Distinct bigrams of an array of words; none for fewer than two words."""
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda x, y: F.concat(x, F.lit(" "), y)))


def normal_words(text: str) -> list[str]:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def plain_bigrams(text: str) -> list[str]:
    w = normal_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def anchors(grams: list[list[str]], threshold: float) -> list[str] | None:
    """Strings of which each match has at least one, long words if possible; None if there are no such strings."""
    out: set[str] = set()
    for g in filter(None, grams):
        least = math.ceil(threshold * len(g) / (2 - threshold) - 1e-9)
        left = [set(x.split()) for x in g]
        for w in sorted(set().union(*left), key=lambda x: (-len(x), x)):
            if len(left) < least:
                break
            out.add(w)
            left = [x for x in left if w not in x]
        if len(left) >= least:
            return None
    return sorted(w for w in out if not any(x != w and x in w for x in out))


def licence_scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(key, licence, dice, n_matches): for each document and template with a match, the best coefficient and the number of matching candidates."""
    grams = {k: plain_bigrams(v) for k, v in (templates or TEMPLATES).items()}
    low = min(threshold / (2 - threshold) * len(g) for g in grams.values())
    t = C.clean(text)
    needed = anchors(list(grams.values()), threshold)
    # As an array of one text, which makes its lower case once only.
    may = lambda x: F.exists(F.array(F.lower(x)), lambda y: reduce(or_, (F.contains(y, F.lit(w)) for w in needed), F.lit(False))) if needed is not None else F.lit(True)
    docs = docs.where(may(t))
    docs = docs.withColumn("__all", F.split(normal(t), " "))

    def windows(w: list[str]) -> Column:
        """Where the template's first two words stand, as many words as it has."""
        at = F.sequence(F.lit(1), F.greatest(F.size("__all") - 1, F.lit(1)))
        starts = F.filter(at, lambda i: (F.get("__all", i - 1) == w[0]) & (F.get("__all", i) == w[1]))
        return F.transform(starts, lambda i: F.array_join(F.slice("__all", i, F.lit(len(w))), " "))

    plain = [w for w in map(normal_words, (templates or TEMPLATES).values()) if len(w) > 1]
    # A candidate with fewer spaces than the least bigrams allowed cannot match: tested before the normal form is made.
    parts = F.filter(F.array_distinct(F.concat(F.split(t, "\n"), F.split(t, "\n[ \t\r]*\n"))), lambda c: (F.length(c) >= 2 * low) & may(c))
    found = F.concat(F.transform(parts, normal), F.array(F.array_join("__all", " ")), *(windows(w) for w in plain))
    rows = docs.select(F.col(key).alias("__key"), F.explode(F.array_distinct(found)).alias("__c"))
    rows = rows.select("__key", F.split("__c", " ").alias("__w")).where(F.size("__w") > low).withColumn("__g", bigrams("__w"))
    rows = rows.withColumn("__n", F.size("__g")).where(F.col("__n") >= low)
    n = F.col("__n")
    found = []
    for name, g in grams.items():
        both = F.size(F.array_intersect("__g", F.array(*map(F.lit, g))))
        dice = 2 * both / (n + len(g))
        fits = n.between(threshold / (2 - threshold) * len(g), (2 - threshold) / threshold * len(g))
        found.append(F.when(fits, F.when(dice >= threshold, F.struct(F.lit(name).alias("licence"), dice.alias("dice")))))
    rows = rows.select("__key", F.explode(F.array_compact(F.array(*found))).alias("m"))
    return rows.groupBy(F.col("__key").alias(key), F.col("m.licence").alias("licence")).agg(F.round(F.max("m.dice"), 6).alias("dice"), F.count("*").alias("n_matches"))


def licence_sql(threshold: float = THRESHOLD) -> str:
    """The same for DuckDB."""
    rows = ", ".join("('{}', [{}])".format(k, ", ".join(f"'{g}'" for g in plain_bigrams(v))) for k, v in TEMPLATES.items())
    starts = {tuple(w[:2]) + (len(w),) for w in map(normal_words, TEMPLATES.values())}
    firsts = ", ".join(f"('{x}', '{y}', {n})" for x, y, n in sorted(starts))
    may = " OR ".join(f"contains(lower(t), '{x}')" for x in sorted({x for x, _, _ in starts}))
    return f"""
WITH templates(licence, tg) AS (VALUES {rows}),
firsts(x, y, n) AS (VALUES {firsts}),
whole AS (SELECT doc_id, coalesce(text, '') AS t, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
windows AS (SELECT doc_id, t, list(array_to_string(w[i:i + n - 1], ' ')) AS found FROM (SELECT doc_id, t, w, unnest(range(1, len(w))) AS i FROM whole
  WHERE {may}) JOIN firsts ON w[i] = x AND w[i + 1] = y GROUP BY doc_id, t),
parts AS (SELECT whole.doc_id, unnest(list_distinct(list_concat(list_concat(list_concat(string_split(whole.t, chr(10)),
  string_split_regex(whole.t, '\\n[ \\t\\r]*\\n')), [whole.t]), coalesce(found, [])))) AS part
  FROM whole LEFT JOIN windows ON whole.doc_id = windows.doc_id AND whole.t = windows.t),
ws AS (SELECT DISTINCT doc_id, list_filter(string_split(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM parts),
gs AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM ws WHERE len(w) > 1),
scored AS (SELECT doc_id, licence, 2.0 * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice FROM gs, templates
  WHERE len(g) BETWEEN {threshold / (2 - threshold)} * len(tg) AND {(2 - threshold) / threshold} * len(tg))
SELECT doc_id, licence, round(max(dice), 6) AS dice, count(*) AS n_matches FROM scored WHERE dice >= {threshold} GROUP BY doc_id, licence"""
