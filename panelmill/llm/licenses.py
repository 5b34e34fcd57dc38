"""License scans: MinHash bands over overlapping windows retrieve templates, containment verifies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle, and the share of a template's shingles that a text has to hold.
SHINGLE, CONTAINED = 5, 0.8
#: Shingles of a window; a template takes the widest that it fills. Windows overlap by half at least.
WIDTHS = (1, 2, 4, 8)
#: Bands of one row: sets of similarity J collide with probability 1 - (1 - J) ** BANDS. A text window
#: that starts a quarter of its width beside the template's has J = 0.6 and collides in all but one
#: case of a million.
BANDS = 16
WORD = "([\\p{L}\\p{N}]+)"

# Notices of public licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License"),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation"),
    ("LGPL-notice", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("BSD-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met"),
    ("ISC-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0-deed", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, wherever the optimiser moves the expression."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column) -> Column:
    """Hashes of all runs of five lower-cased words; none for shorter or null texts."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(1))

    def hashes(w: Column) -> Column:
        run = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), run)).otherwise(none)

    return _let(words, hashes)


def band_keys(hashes: Column, width: int, stride: int) -> Column:
    """Keys of all bands of all windows: the band and its smallest hash. One window if there is less."""
    def band(j: Column) -> Column:
        smallest = lambda s: F.array_min(F.transform(F.slice(hashes, s, F.lit(width)), lambda x: F.xxhash64(x, j)))
        starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - width + 1, F.lit(1)), F.lit(stride))
        return F.transform(starts, lambda s: F.xxhash64(F.lit(width), j, smallest(s)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band))


@dataclass
class Index:
    """Templates in the form the scan looks them up; grows with the templates only."""

    anchors: list[int]
    bands: dict[int, list[int]]
    shingles: list[list[int]]
    names: list[str]


def index(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> Index:
    """Bands of every window of each template. Templates need five words or more."""
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(text).alias("text")) for i, (_, text) in enumerate(templates)])
    table = spark.range(1).select(F.inline(rows)).select("i", shingles(F.col("text")).alias("h"))
    n = F.size("h")
    width = F.lit(WIDTHS[0])
    for w in WIDTHS[1:]:
        width = F.when(n >= w, w).otherwise(width)
    keys = F.lit(None)
    for w in WIDTHS:
        keys = F.when(F.col("width") == w, band_keys(F.col("h"), w, 1)).otherwise(keys)
    # The shingles that are the smallest of some window in some band; no other text shingle can collide.
    starts = F.sequence(F.lit(1), F.size("h") - F.col("width") + 1)
    least = lambda s, j: F.array_min(F.transform(F.slice("h", s, F.col("width")), lambda x: F.struct(F.xxhash64(x, j).alias("m"), x.alias("x"))))["x"]
    anchors = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.transform(starts, lambda s: least(s, j))))
    found = table.withColumn("width", width).where(n > 0).select("i", "h", keys.alias("keys"), anchors.alias("anchors"))
    found = found.orderBy("i").collect()
    if len(found) < len(templates):
        raise ValueError("a template has fewer than five words")
    bands: dict[int, list[int]] = {}
    for row in found:
        for key in dict.fromkeys(row["keys"]):
            bands.setdefault(key, []).append(row["i"])
    return Index(
        sorted({a for row in found for a in row["anchors"]}), bands,
        [list(dict.fromkeys(row["h"])) for row in found], [name for name, _ in templates],
    )


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def scan(docs: DataFrame, known: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses in every whole text: the id, license, containment, shingles and first_word, per find.

    A find is a template of which the text holds 80 % or more of the distinct shingles; `shingles` of
    them, the first at word `first_word` (from 1). Null and empty texts have none; rows that repeat an
    id are scanned each. Everything happens within the row: texts without any shingle that could win
    a band skip the bands, the others look up the bands of all their windows.
    """
    text = F.col(text_col)
    rows = docs.where(F.arrays_overlap(shingles(text), _longs(known.anchors)))
    table = F.create_map(*[c for k, v in known.bands.items() for c in (F.lit(k).cast("long"), F.array(*[F.lit(i) for i in v]))])

    def found(h: Column) -> Column:
        keys = F.concat(*[band_keys(h, w, max(1, w // 2)) for w in WIDTHS])
        hit = F.array_intersect(keys, _longs(list(known.bands)))
        return F.array_distinct(F.flatten(F.transform(hit, lambda k: F.element_at(table, k))))

    row = _let(shingles(text), lambda h: F.struct(h.alias("h"), found(h).alias("found")))
    rows = rows.select(F.col(id_col).alias("id"), row.alias("r"))
    rows = rows.select("id", F.col("r.h").alias("h"), F.explode_outer("r.found").alias("i")).where("i is not null")
    own = F.element_at(F.array(*[_longs(s) for s in known.shingles]), F.col("i") + 1)
    name = F.element_at(F.array(*[F.lit(n) for n in known.names]), F.col("i") + 1)
    rows = rows.select("id", name.alias("license"), "h", own.alias("own"))
    rows = rows.withColumn("shingles", F.size(F.array_intersect("own", "h")).cast("long"))
    rows = rows.withColumn("containment", F.col("shingles") / F.size("own")).where(F.col("containment") >= CONTAINED)
    first = F.array_position(F.transform("h", lambda x: F.array_contains(F.col("own"), x)), True)
    return rows.select(F.col("id").alias(id_col), "license", "containment", "shingles", first.alias("first_word"))


def scan_sql(templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """DuckDB: exact containment of every template in every document, without bands."""
    quoted = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in templates)
    words = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+')"
    return f"""
WITH t AS (SELECT license, {words.format("text")} AS w FROM (VALUES {quoted}) v(license, text)),
ts AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS s FROM t, unnest(range(1, len(w) - 3)) u(i)),
total AS (SELECT license, count(*) AS m FROM ts GROUP BY 1),
d AS (SELECT doc_id, {words.format("text")} AS w FROM documents),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d),
ds AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s, min(i) AS i FROM dp GROUP BY 1, 2)
SELECT doc_id, license, count(*) / m::DOUBLE AS containment, count(*) AS shingles, min(i) AS first_word
FROM ds JOIN ts USING (s) JOIN total USING (license) GROUP BY doc_id, license, m HAVING count(*) / m::DOUBLE >= {CONTAINED}"""
