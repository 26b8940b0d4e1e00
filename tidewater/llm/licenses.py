"""License scans: MinHash bands over overlapping windows find templates, exact containment verifies them. DataFrame expressions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.shared import stored
from tidewater.llm.shingles import WORDS

# Notices, and the standard texts' wording.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}
#: Share of a template's shingles that a document must hold.
CONTAINMENT = 0.8
#: Windows in shingles and their stride in texts; templates have one at every place. Templates too short to hold an
#: aligned window wherever they start (WINDOW + STRIDE - 1 shingles) are found by windows of one shingle.
WINDOW, STRIDE = 16, 8
#: Bands of one row: windows with Jaccard similarity s meet with probability 1 - (1 - s) ** BANDS; for 0.8: 0.99994.
BANDS = 6
#: Most numbers (keys and shingles) of all templates that go into the plan as constants; beyond it templates are joined.
INLINE_NUMBERS = 20_000

_LONGS = "array<bigint>"


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Each band's point; the hash nearest to it (least after exclusive or) is the window's MinHash.
_POINTS = [_long((0x9E3779B97F4A7C15 * (2 * b + 1)) % (1 << 64)) for b in range(BANDS)]


def with_hashes(df: DataFrame, text: str, widths: list[int], *keep: str) -> DataFrame:
    """The columns `keep`, and for each width w the hashes of all runs of w words as _h<w>, none for a shorter text.

    Words are lower-case runs of letters and digits; punctuation separates them.
    """
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    words = F.when(F.col("_plain") == "", F.array().cast("array<string>")).otherwise(F.split("_plain", " "))
    frame = df.select(*keep, plain.alias("_plain")).select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("_words"))
    return frame.select(*keep, *(F.expr(runs_of("_words", w)).alias(f"_h{w}") for w in widths))


def runs_of(words: str, n: int) -> str:
    run = ", ".join(f"{words}[i + {k}]" for k in range(n))
    return f"CASE WHEN size({words}) >= {n} THEN transform(sequence(0, size({words}) - {n}), i -> xxhash64({run})) ELSE CAST(array() AS {_LONGS}) END"


def _window(hashes: str, start: str) -> str:
    """The band keys of the window at `start`."""
    least = (", ".join(f"{hashes}[{start} + {k}] ^ {p}L" for k in range(WINDOW)) for p in _POINTS)
    return f"array({', '.join(f'xxhash64({b}, least({x}))' for b, x in enumerate(least))})"


def with_keys(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """`df` with the band keys of windows of the column `hashes`, STRIDE apart, as `name`; the last window ends with it.

    The least of each block of STRIDE hashes is found once for each band, and a window is two blocks, so the work follows
    the number of hashes. No window is cut out as an array of its own: Spark copies the whole array for each.
    """
    assert WINDOW == 2 * STRIDE
    rest = df.columns
    least = (", ".join(f"{hashes}[{STRIDE} * j + {k}] ^ {p}L" for k in range(STRIDE)) for p in _POINTS)
    blocks = f"transform(sequence(0, size({hashes}) DIV {STRIDE} - 1), j -> array({', '.join(f'least({x})' for x in least)}))"
    pairs = ", ".join(f"xxhash64({b}, least(_blocks[j][{b}], _blocks[j + 1][{b}]))" for b in range(BANDS))
    aligned = f"flatten(transform(sequence(0, size(_blocks) - 2), j -> array({pairs})))"
    last = f"CASE WHEN size({hashes}) % {STRIDE} = 0 THEN CAST(array() AS {_LONGS}) ELSE {_window(hashes, f'size({hashes}) - {WINDOW}')} END"
    some = f"size({hashes}) >= {WINDOW}"
    return df.select(*rest, F.expr(f"CASE WHEN {some} THEN {blocks} END").alias("_blocks")).select(
        *rest, F.expr(f"CASE WHEN {some} THEN concat({aligned}, {last}) ELSE CAST(array() AS {_LONGS}) END").alias(name)
    )


def template_table(spark: SparkSession, templates: dict[str, str] | DataFrame) -> DataFrame:
    """(license, width, banded, shingles, keys) of the templates, a dict or a frame (license, text).

    A template of fewer than five words is one shingle of its own width. A template that is too short for a window has its
    shingles as keys. Null and blank templates fail the job: they would match everything or nothing.
    """
    if isinstance(templates, dict):
        if any(not t.strip() for t in templates.values()):
            raise ValueError("a template must have words")
        listed = F.array(*(F.struct(F.lit(k).alias("license"), F.lit(t).alias("text")) for k, t in sorted(templates.items())))
        rows = F.explode(listed.cast("array<struct<license string, text string>>"))
        templates = spark.range(1).select(rows.alias("r")).select("r.license", "r.text")
    widths = list(range(1, WORDS + 1))
    hashed = with_hashes(templates, "text", widths, "license")
    width = "CASE " + " ".join(f"WHEN size(_h{w}) > 0 THEN {w}" for w in reversed(widths)) + " ELSE CAST(raise_error('a template must have words') AS int) END"
    shingles = "CASE width " + " ".join(f"WHEN {w} THEN _h{w}" for w in widths) + " END"
    hashed = hashed.withColumn("width", F.expr(width)).select("license", "width", F.expr(shingles).alias("_h"))
    banded = F.size("_h") >= WINDOW + STRIDE - 1
    keys = f"CASE WHEN size(_h) >= {WINDOW + STRIDE - 1} THEN flatten(transform(sequence(0, size(_h) - {WINDOW}), s -> {_window('_h', 's')})) ELSE _h END"
    return hashed.select("license", "width", banded.alias("banded"), F.array_distinct("_h").alias("shingles"), F.array_distinct(F.expr(keys)).alias("keys"))


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, containment: float = CONTAINMENT, inline: int = INLINE_NUMBERS) -> DataFrame:
    """(doc_id, license, n_shingles, n_found, containment): the templates of which a row holds enough shingles.

    The bands of a text's windows retrieve the templates, and for those found the share of the template's shingles in the
    whole text is counted exactly. Templates of up to `inline` numbers are constants of the plan: one pass over the texts, in
    which a row's keys are held against the templates' before anything is multiplied, and only matches are shuffled, to
    make them distinct. Larger tables are joined by shuffles, with the same rows.

    A null or empty text, and one without letters or digits, matches nothing; long texts are taken whole, in time that
    follows their length; repeated rows give one row for each template; rows without a doc_id give rows with none; ties
    can't be, as every match is given; other columns are not read, whatever their names; an empty table gives no rows.
    """
    table = stored(template_table(docs.sparkSession, TEMPLATES if templates is None else templates), "templates")
    sizes = table.groupBy("width", "banded").agg(F.sum(F.size("shingles") + F.size("keys")).alias("n")).collect()  # ten rows at most
    widths, kinds = sorted({r.width for r in sizes}), sorted((r.width, r.banded) for r in sizes)
    frame = with_hashes(docs, "text", widths, "doc_id")
    banded = any(b for _, b in kinds)
    frame = with_keys(frame, f"_h{WORDS}", "_bands") if banded else frame
    of_width = lambda w: "CASE " + w + " " + " ".join(f"WHEN {k} THEN _h{k}" for k in widths) + " END"
    if sum(r.n for r in sizes) <= inline:
        counted = _by_constants(frame, table, kinds, of_width)
    else:
        counted = _by_joins(frame, table, kinds, of_width)
    share = F.col("n_found") / F.col("n_shingles")
    return counted.where(share >= containment).distinct().withColumn("containment", share)


def _constant(numbers: list[int]) -> str:
    """An array of longs that Spark folds into one constant."""
    return f"CAST(split('{','.join(map(str, numbers))}', ',') AS {_LONGS})" if numbers else f"CAST(array() AS {_LONGS})"


def _by_constants(frame: DataFrame, table: DataFrame, kinds: list[tuple[int, bool]], of_width: Callable[[str], str]) -> DataFrame:
    """(doc_id, license, n_shingles, n_found) of all templates that share a key with a text."""
    rows = table.orderBy("license").collect()  # as many numbers as the caller has allowed
    if not rows:
        return frame.select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("license", "string"), ("n_shingles", "long"), ("n_found", "long")))).where("false")
    wanted = {(w, b): sorted({k for r in rows if (r.width, r.banded) == (w, b) for k in r["keys"]}) for w, b in kinds}
    hits = ", ".join(f"array_intersect({'_bands' if b else f'_h{w}'}, {_constant(keys)})" for (w, b), keys in wanted.items())
    hashes = [c for c in frame.columns if c.startswith("_h")]
    frame = frame.select("doc_id", *hashes, F.expr(f"concat({hits})").alias("_hits"))
    own = lambda of: f"array({', '.join(_constant(of(r)) for r in rows)})"
    # Not by a filter: Spark would move it below and so repeat all that the keys are made of.
    found = f"CASE WHEN size(_hits) = 0 THEN CAST(array() AS array<int>) ELSE filter(sequence(0, {len(rows) - 1}), t -> arrays_overlap(_hits, {own(lambda r: r['keys'])}[t])) END"
    frame = frame.select("doc_id", *hashes, F.expr(found).alias("_found"))
    n_found = f"size(array_intersect({of_width(f'{_constant([r.width for r in rows])}[t]')}, {own(lambda r: r.shingles)}[t]))"
    frame = frame.select("doc_id", F.expr(f"explode(transform(_found, t -> struct(t, CAST({n_found} AS bigint) AS n)))").alias("_of"))
    names = F.array(*(F.lit(r.license) for r in rows))
    n_shingles = F.expr(f"{_constant([len(r.shingles) for r in rows])}[_of.t]")
    return frame.select("doc_id", F.get(names, F.col("_of.t")).alias("license"), n_shingles.alias("n_shingles"), F.col("_of.n").alias("n_found"))


def _by_joins(frame: DataFrame, table: DataFrame, kinds: list[tuple[int, bool]], of_width: Callable[[str], str]) -> DataFrame:
    """The same for templates of any number: keys are joined, then the texts' hashes with what was found, all by shuffles.

    The hashes are written with a number of their own for each row first, so that rows can be told apart. A key that many
    texts share is split in the joins by Spark, as the templates' side of it is small.
    """
    rows = stored(frame.withColumn("_row", F.monotonically_increasing_id()), "license-hashes")
    singles = sorted({w for w, b in kinds if not b})
    keys = ", ".join([*(f"_h{w}" for w in singles), *(["_bands"] if any(b for _, b in kinds) else [])])
    keyed = rows.select("_row", F.explode(F.array_distinct(F.expr(f"concat({keys})"))).alias("key"))
    found = keyed.join(table.select("license", F.explode("keys").alias("key")), "key").select("_row", "license").distinct()
    joined = rows.drop("_bands").join(found, "_row").join(table.select("license", "width", "shingles"), "license")
    n_found = F.expr(f"size(array_intersect({of_width('width')}, shingles))").cast("long")
    return joined.select("doc_id", "license", F.size("shingles").cast("long").alias("n_shingles"), n_found.alias("n_found"))
