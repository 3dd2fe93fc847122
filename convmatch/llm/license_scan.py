"""Licence notices in texts: Dice coefficient over word bigrams, DataFrame functions only."""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns

#: Common one-line notices (fixed values).
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Use of this source code is governed by a BSD 2-Clause license.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Names by which a sentence or a tag may call a licence (fixed values).
ALIASES = {
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "CC-BY-4.0": ("CC BY 4.0 License",),
    "CC0-1.0": ("CC0 1.0 Universal License",),
    "GPL-2.0": ("GNU GPL v2", "GNU General Public License v2.0"),
    "GPL-3.0": ("GNU GPL v3", "GNU General Public License v3.0"),
    "ISC": ("ISC License",),
    "LGPL-3.0": ("GNU LGPL v3", "GNU Lesser General Public License v3.0"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License 2.0",),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
}
LEAST_DICE = 0.8
#: A size band ends where the next one starts, at this ratio.
_BAND = 1.25


def default_templates() -> list[tuple[str, str]]:
    """The notices, sentences and tags by name, and the licence texts and longer notices that come
    with the package."""
    named = [(k, f"{verb} under the {n}") for k, names in ALIASES.items() for n in names for verb in ("licensed", "released", "available", "distributed")]
    tags = [(k, f"SPDX-License-Identifier: {k}") for k in ALIASES]
    files = sorted((Path(__file__).parent / "licenses").glob("*.txt"))
    return [*NOTICES.items(), *named, *tags, *((f.stem.removesuffix(".notice"), f.read_text(encoding="utf-8")) for f in files)]


def normalised(text: str) -> str:
    return "".join(c if "a" <= c <= "z" or "0" <= c <= "9" else " " for c in text.lower())


def bigrams_of(text: str) -> list[str]:
    w = normalised(text).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def _grams(templates: list[tuple[str, str]] | None) -> list[tuple[str, list[str], list[str]]]:
    """Licence, distinct bigrams and words of each template of two words or more."""
    given = default_templates() if templates is None else templates
    return [(name, g, normalised(text).split()) for name, text in given if (g := bigrams_of(text))]


def _probes(grams: list[tuple[str, list[str], list[str]]], ratio: float) -> dict[str, list[tuple[int, int, int]]]:
    """Bigrams of which every match holds one: where they stand in which templates (template,
    place, words of the template)."""
    out: dict[str, list[tuple[int, int, int]]] = {}
    for t, (_, g, words) in enumerate(grams):
        need = math.ceil(len(g) / ratio - 1e-9)
        own = set(sorted(g, key=lambda x: (-len(x), x))[: len(g) - need + 1])
        for o, pair in enumerate(zip(words, words[1:])):
            if (p := " ".join(pair)) in own:
                out.setdefault(p, []).append((t, o, len(words)))
    return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """Parts of texts like a licence template: doc_id, license, n_units, n_windows, best_dice.

    A unit is a line, a paragraph (of several), or the whole text where it has several lines.  A
    window has as many words as a template and lies anywhere in the text, where a probe bigram
    stands at the place that it has in the template; so a licence is found inside longer lines,
    paragraphs and texts.  Letters are lowered and all but a-z and 0-9 become one blank.  A
    unit matches if the Dice coefficient of its distinct word bigrams with a template's is
    ``least`` or more, a window if its own template's is.  A unit counts for the template it is
    most like, and so do the windows that start at one word (of equals the last by name).

    Two sets of sizes a and b can reach t only if (2-t)/t * min >= max, and they then share
    t/(2-t) of each at least; so of any third and one more of a template's bigrams a match holds
    one.  These probes are the bigrams of each template's longest words.  Texts without one end
    there, in a set lookup for each bigram.  What is left meets the templates of its size
    band: a table of them, of the size of the templates times the bands within their bounds.

    n_units and n_windows count the matches of a document and licence, best_dice is their highest
    (6 decimals).  Documents without a match give no row; null and empty texts have no unit; rows
    that repeat a doc_id are counted together; texts of any length are read whole; other
    columns are not read; an empty table gives no rows.
    """
    grams = _grams(templates)
    spark = docs.sparkSession
    if not grams:
        return spark.createDataFrame([], "doc_id long, license string, n_units long, n_windows long, best_dice double")
    ratio = (2 - least) / least
    probes = _probes(grams, ratio)
    low, high = min(len(g) for _, g, _ in grams) / ratio, max(len(g) for _, g, _ in grams) * ratio

    def band(n: float) -> int:
        return math.floor(math.log(n) / math.log(_BAND))

    by_band: dict[int, list[tuple[int, str, list[str]]]] = {}
    for t, (name, g, _) in enumerate(grams):
        # one band more on either side, so that no rounding parts a unit from its template
        for b in range(band(max(1.0, len(g) / ratio)) - 1, band(len(g) * ratio) + 2):
            by_band.setdefault(b, []).append((t, name, g))
    table = spark.createDataFrame(list(by_band.items()), "band int, templates array<struct<t: int, license: string, tg: array<string>>>")
    # one row; both tables are bounded by the caller's templates
    places = spark.createDataFrame([(probes,)], "probes map<string, array<struct<t: int, o: int, m: int>>>")

    def words_of(u: Column) -> Column:
        return F.split(F.trim(F.regexp_replace(F.lower(u), "[^a-z0-9]+", " ")), " ")

    def pairs_of(w: Column) -> Column:
        return F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))

    def made(c: Column) -> Column:
        # an explode hands its rows on ready made: what follows does not evaluate the expression again
        return F.explode_outer(F.array(c))

    d = columns(docs, "doc_id", "text").where("text is not null").select(F.col("doc_id").cast("long"), "text", made(words_of(F.col("text"))).alias("w"))
    d = d.select("doc_id", "text", "w", made(pairs_of(F.col("w"))).alias("p"))
    hit = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.get("p", i).isin(*sorted(probes)))
    d = d.select("doc_id", "text", "w", "p", made(F.when(F.size("p") > 0, hit)).alias("at")).where(F.size("at") > 0)
    d = d.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(places))
    lines, parts = F.split("text", "\n"), F.split("text", r"\n[ \t]*\n")
    none = F.array().cast("array<string>")
    units = F.concat(lines, F.when(F.size(parts) > 1, parts).otherwise(none), F.when(F.size(lines) > 1, F.array("text")).otherwise(none))
    unit = F.transform(units, lambda u, i: F.struct((-1 - i).alias("start"), F.lit(-1).alias("t"), words_of(u).alias("w")))
    laid = F.flatten(F.transform("at", lambda i: F.transform(F.element_at("probes", F.get("p", i)), lambda x: F.struct((i - x["o"]).alias("start"), x["t"].alias("t"), x["m"].alias("m")))))
    window = F.transform(
        F.array_distinct(laid),
        lambda x: F.struct(F.greatest(x["start"], F.lit(0)).alias("start"), x["t"].alias("t"), F.slice("w", F.greatest(x["start"], F.lit(0)) + 1, x["m"] + F.least(x["start"], F.lit(0))).alias("w")),
    )
    d = d.select("doc_id", "row", F.explode_outer(F.concat(unit, window)).alias("x")).select("doc_id", "row", "x.start", "x.t", made(F.array_distinct(pairs_of(F.col("x.w")))).alias("g"))
    n = F.size("g")
    d = d.where((n >= low - 1e-9) & (n <= high + 1e-9)).withColumn("band", F.floor(F.log(n.cast("double")) / math.log(_BAND)).cast("int"))

    def dice(t: Column) -> Column:
        fits = (n * ratio >= F.size(t["tg"]) - 1e-9) & (F.size(t["tg"]) * ratio >= n - 1e-9) & ((F.col("t") < 0) | (t["t"] == F.col("t")))
        return F.when(fits, 2.0 * F.size(F.array_intersect("g", t["tg"])) / (n + F.size(t["tg"])))

    scored = F.transform("templates", lambda t: F.struct(dice(t).alias("dice"), t["license"].alias("license")))
    best = F.array_max(F.filter(scored, lambda s: s["dice"] >= least))
    hits = d.join(F.broadcast(table), "band").select("doc_id", "row", "start", made(best).alias("s")).where("s is not null")
    hits = hits.groupBy("doc_id", "row", "start").agg(F.max("s").alias("s"))
    return hits.groupBy("doc_id", F.col("s.license").alias("license")).agg(
        F.count_if(F.col("start") < 0).alias("n_units"), F.count_if(F.col("start") >= 0).alias("n_windows"), F.round(F.max("s.dice"), 6).alias("best_dice")
    )


def oracle(templates: list[tuple[str, str]] | None = None, least: float = LEAST_DICE) -> str:
    """The same result in DuckDB's SQL: every unit against every template of fitting size, and the
    windows of every probe."""
    grams = _grams(templates)
    rows = ", ".join("({}, '{}', [{}])".format(t, k, ", ".join(f"'{x}'" for x in g)) for t, (k, g, _) in enumerate(grams))
    places = ", ".join(f"('{p}', {t}, {o}, {m})" for p, at in _probes(grams, (2 - least) / least).items() for t, o, m in at)
    return f"""
    WITH t(t, license, tg) AS (VALUES {rows}),
    probes(p, t, o, m) AS (VALUES {places}),
    docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents WHERE text IS NOT NULL),
    lines AS (SELECT row, doc_id, text, string_split(text, chr(10)) AS l, regexp_split_to_array(text, '\n[ \t]*\n') AS p FROM docs),
    units AS (
      SELECT row, doc_id, unnest(list_concat(l, CASE WHEN len(p) > 1 THEN p ELSE [] END, CASE WHEN len(l) > 1 THEN [text] ELSE [] END)) AS u FROM lines),
    whole AS (SELECT row, doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM docs),
    pairs AS (SELECT row, doc_id, unnest(range(1, len(w))) AS i, w FROM whole WHERE len(w) >= 2),
    laid AS (SELECT DISTINCT row, doc_id, t, i - 1 - o AS s, m FROM pairs JOIN probes ON p = w[i] || ' ' || w[i + 1]),
    cut AS (SELECT row, doc_id, t, greatest(s, 0) AS start, w[greatest(s, 0) + 1 : s + m] AS w FROM laid JOIN whole USING (row, doc_id)),
    words AS (
      SELECT row, doc_id, -1 AS t, -row_number() OVER () AS start, string_split(trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units
      UNION ALL SELECT row, doc_id, t, start, w FROM cut),
    grams AS (
      SELECT row, doc_id, t, start, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g
      FROM words WHERE len(w) >= 2),
    near AS (
      SELECT row, doc_id, start, license, g, tg FROM grams JOIN t
      ON len(g) * {2 - least} >= len(tg) * {least} - 1e-6 AND len(tg) * {2 - least} >= len(g) * {least} - 1e-6 AND (grams.t < 0 OR grams.t = t.t)),
    hits AS (SELECT row, doc_id, start, license, 2.0 * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice FROM near),
    best AS (SELECT *, row_number() OVER (PARTITION BY row, start ORDER BY dice DESC, license DESC) AS r FROM hits WHERE dice >= {least})
    SELECT doc_id, license, count(*) FILTER (WHERE start < 0) AS n_units, count(*) FILTER (WHERE start >= 0) AS n_windows, round(max(dice), 6) AS best_dice
    FROM best WHERE r = 1 GROUP BY doc_id, license"""
