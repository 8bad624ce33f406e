"""License scans: diagonal voting.

Every rolling word k-gram hash of a document is joined to the places where that hash stands in the license
templates. A match at word p of the document and word q of a template votes for the diagonal p - q: an
undisturbed copy puts all its votes on one, and no two copies share one. Votes are gathered by diagonal, and each
diagonal is merged with its neighbours (a word was added or left out), whatever else of the template stands
in the text; a place of the template counts once. Templates are a fixed list, so their side of the join is
broadcast; documents never meet each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagix.llm.common import table

WORD_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Phrase and label.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Label and notice, from the public texts of the licenses.
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
]
#: Words in a k-gram: short ones for phrases, longer ones for notices.
K_PHRASE, K_NOTICE = 2, 4
#: Diagonals that differ by so many words at most are neighbours.
SLACK = 3
#: The share of a notice's k-grams that a span needs.
COVERAGE = 0.8


def words_of(text: str | Column) -> Column:
    """The words of a text in lower case; null: none. No other letter than A-Z gets in lower case a letter of the base phrases."""
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    # A gap at either end leaves an empty string there, and nowhere else.
    return F.array_remove(F.split(low, WORD_GAP), "")


def _pairs(words: str) -> Column:
    """Hashes of all two-word runs; the last entry, of one word, is of no use."""
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _fours(pairs: str) -> Column:
    """Hashes of all four-word runs, from those of two words; the last three entries are of no use."""
    return F.zip_with(pairs, F.slice(pairs, 3, F.greatest(F.size(pairs) - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b, F.lit(4)))


def templates(spark: SparkSession, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row for each k-gram of each template: hash, template, label, base, n_grams, at, gram."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = [(i, label, text, True) for i, (text, label) in enumerate(phrases)] + [(len(phrases) + i, label, text, False) for i, (label, text) in enumerate(notices)]
    values = ", ".join(f"({i}, {quote(label)}, {quote(text)}, {str(base).lower()})" for i, label, text, base in rows)
    t = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, label, text, base)").withColumn("words", words_of("text")).withColumn("p", _pairs("words")).withColumn("f", _fours("p"))
    k = F.when(F.col("base") | (F.size("words") < K_NOTICE), F.lit(K_PHRASE)).otherwise(F.lit(K_NOTICE))
    t = t.withColumn("k", k).withColumn("n_grams", F.size("words") - F.col("k") + 1)
    t = t.select("template", "label", "base", "k", "n_grams", "words", F.posexplode(F.when(F.col("k") == K_PHRASE, F.col("p")).otherwise(F.col("f"))).alias("at", "hash"))
    return t.where("at < n_grams").select("hash", "template", "label", "base", "k", "n_grams", "at", F.slice("words", F.col("at") + 1, F.col("k")).alias("gram"))


def license_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """Verified diagonals and one row of its own (template -1) for each document, by the document's row number.

    Returns row, doc_id, template, label, base, n_grams, diagonal, places (of the template, that voted for it) and
    start, the first word; in the document's own row that is its number of words.
    """
    known = templates(docs.sparkSession) if known is None else known
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words_of(text).alias("words"))
    rows = rows.withColumn("p", _pairs("words")).withColumn("f", _fours("p"))
    # One array holds the two-word hashes, the four-word hashes and, last, a mark that every document has.
    every = rows.select("row", "doc_id", "words", F.concat("p", "f", F.array(F.lit(0).cast("long"))).alias("hashes"))
    grams = every.select("row", "doc_id", "words", F.posexplode("hashes").alias("i", "hash"))
    mark = known.sparkSession.sql("SELECT 0L AS hash, -1 AS template, CAST(NULL AS STRING) AS label, false AS base, 0 AS k, 0 AS n_grams, 0 AS at, CAST(array() AS array<string>) AS gram")
    n = F.size("words")
    hits = grams.join(F.broadcast(known.unionByName(mark)), "hash")
    hits = hits.withColumn("place", F.when(F.col("template") < 0, n).when(F.col("i") < n, F.col("i")).otherwise(F.col("i") - n))
    # Hashes name the candidates; the words decide.
    hits = hits.where((F.col("template") >= 0) | (F.col("i") == 2 * n)).where((F.col("template") < 0) | (F.slice("words", F.col("place") + 1, F.greatest("k", F.lit(1))) == F.col("gram")))
    return (
        hits.groupBy("row", "doc_id", "template", "label", "base", "n_grams", (F.col("place") - F.col("at")).alias("diagonal"))
        .agg(F.collect_set("at").alias("places"), F.min("place").alias("start"))
    )


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", coverage: float = COVERAGE, slack: int = SLACK) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    Base: places where all words of a phrase stand consecutively. labels adds those of notices of which a
    diagonal and its neighbours (slack words to either side) hold at least the share coverage of the k-grams.
    score is the largest such share over all templates, found or not (0 without any vote). Of notices that
    overlap all labels stand. Null and empty texts have no words, no labels ('') and score 0; texts of any
    length are read to their ends; repeated rows stay repeated; ids may be null. Extra columns are not read,
    whatever their names. An empty table gives an empty one.
    """
    spans = license_spans(docs, doc_id, text)
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    near = F.flatten(F.collect_list("places").over(by_diagonal.rangeBetween(-slack, slack)))
    merged = F.when(F.col("base"), F.size("places")).otherwise(F.size(F.array_distinct(near)))
    share = F.when(F.col("template") >= 0, merged / F.greatest("n_grams", F.lit(1))).otherwise(0.0)
    found = spans.withColumn("share", share)
    whole = F.col("base") & (F.size("places") == F.col("n_grams"))
    kept = whole | (~F.col("base") & (F.col("template") >= 0) & (F.col("share") >= coverage))
    found = found.withColumn("kept", kept)
    # Diagonals of one copy count as one span.
    last = F.last(F.when(F.col("kept"), F.col("diagonal")), ignorenulls=True).over(by_diagonal.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("first_of_span", F.col("kept") & (F.col("base") | last.isNull() | (F.col("diagonal") - last > slack)))
    kept = F.col("kept")
    named = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return found.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("template") < 0, F.col("start"))).cast("long").alias("n_words"),
        F.sum(whole.cast("long")).alias("n_base"),
        F.min(F.when(whole, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("start"))).cast("long").alias("last_word"),
        named(whole).alias("base_labels"),
        named(kept).alias("labels"),
        F.max("share").alias("score"),
        F.sum(F.col("first_of_span").cast("long")).alias("n_spans"),
    ).drop("row")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _values() -> str:
    rows = [(label, True, phrase) for phrase, label in PHRASES] + [(label, False, notice) for label, notice in NOTICES]
    return ", ".join("({}, '{}', {}, '{}')".format(i, label, str(base).lower(), text.replace("'", "''")) for i, (label, base, text) in enumerate(rows))


_SPLIT = "regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: DuckDB SQL for op1_license_scan: k-grams are joined by their words.
OP1_SQL = f"""
WITH t AS (SELECT template, label, base, {_SPLIT} AS w FROM (VALUES {_values()}) v(template, label, base, text)),
tk AS (SELECT *, CASE WHEN base OR len(w) < {K_NOTICE} THEN {K_PHRASE} ELSE {K_NOTICE} END AS k FROM t),
g AS (SELECT template, label, base, k, len(w) - k + 1 AS n_grams, i AS pl, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c, w[i + 4] AS d FROM (SELECT *, unnest(range(len(w))) AS i FROM tk) WHERE i < len(w) - k + 1),
doc AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
p AS (SELECT doc_id, i, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c, w[i + 4] AS d FROM (SELECT *, unnest(range(len(w))) AS i FROM doc)),
hit AS (
  SELECT doc_id, template, label, base, k, n_grams, pl, i FROM p JOIN g ON g.k = 2 AND p.a = g.a AND p.b = g.b
  UNION ALL SELECT doc_id, template, label, base, k, n_grams, pl, i FROM p JOIN g ON g.k = 4 AND p.a = g.a AND p.b = g.b AND p.c = g.c AND p.d = g.d),
diag AS (SELECT doc_id, template, label, base, n_grams, i - pl AS diagonal, count(*) AS votes, min(i) AS start FROM hit GROUP BY doc_id, template, label, base, n_grams, i - pl),
near AS (SELECT d.doc_id, d.template, d.diagonal, count(DISTINCT h.pl) AS votes FROM diag d JOIN hit h ON h.doc_id = d.doc_id AND h.template = d.template AND abs(h.i - h.pl - d.diagonal) <= {SLACK} GROUP BY d.doc_id, d.template, d.diagonal),
found AS (SELECT d.*, CASE WHEN base THEN d.votes ELSE near.votes END / n_grams::double AS share FROM diag d JOIN near USING (doc_id, template, diagonal)),
good AS (SELECT *, base AND votes = n_grams AS whole, (base AND votes = n_grams) OR (NOT base AND share >= {COVERAGE}) AS kept FROM found),
marked AS (SELECT *, kept AND (base OR NOT EXISTS (SELECT 1 FROM good o WHERE o.kept AND o.doc_id = g.doc_id AND o.template = g.template AND g.diagonal - o.diagonal BETWEEN 1 AND {SLACK})) AS opens FROM good g),
r AS (SELECT doc_id, count(*) FILTER (whole) AS n_base, min(start) FILTER (whole) AS first_word, max(start) FILTER (whole) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kept) AS labels, max(share) AS score, count(*) FILTER (opens) AS n_spans
  FROM marked GROUP BY doc_id)
SELECT doc.doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::double) AS score, coalesce(n_spans, 0)::bigint AS n_spans
FROM doc LEFT JOIN r USING (doc_id)
"""
