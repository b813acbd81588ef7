"""License scan by diagonal voting.

Every window of three words of every text is hashed and joined to the places where the templates hold that window; the
words themselves are then compared, so a hash match alone never counts. A match votes for its diagonal (place in the text
minus place in the template). Votes are added up per diagonal, neighbouring diagonals (words put in or left out) are
merged, and a merged run is verified: by the share of the template's different places that lie on diagonals at most
``DRIFT`` apart, the best such stretch of the run. A window that a text repeats counts once.

The template side is broadcast: it is a parameter of at most ``MOST_GRAMS`` windows, checked. Texts stream past it
without a shuffle; what is shuffled is one row a document and one a voted diagonal, combined before the exchange.

Null and empty texts have no words; texts of one or two words have no window. A very long text is scanned whole; what it
keeps is one row a voted diagonal. Repeated rows are scanned one by one. The
scan reads doc_id and text only, so further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
MOST_GRAMS = 20_000
# Phrases whose places count one by one, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Openings and notices of public licenses: fixed values, the wording is the licenses' own.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files the software to deal in the software without restriction including without limitation "
           "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
           "the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
           "public license as published by the free software foundation",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "all-rights-reserved": "all rights reserved",
}
NAMES = {"gpl-notice": "gpl"}
ENOUGH = 0.6
NEAR = 3
DRIFT = 12


def words_of(text: Column) -> Column:
    # The Kelvin sign is the one letter outside ASCII whose lower case is an ASCII letter; any other word letter will do.
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ā")))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_rows(phrases=PHRASES, templates=TEMPLATES) -> list[tuple[str, str, bool, int, int]]:
    """gram, template, whether it is a phrase, place, number of the template's windows."""
    rows = []
    for text, name, base in [(t, f"base:{n}", True) for t, n in phrases.items()] + [(t, n, False) for n, t in templates.items()]:
        words = text.split()
        if len(words) < K:
            raise ValueError(f"a template has at least {K} words: {text!r}")
        rows += [(" ".join(words[i : i + K]), name, base, i, len(words) - K + 1) for i in range(len(words) - K + 1)]
    if len(rows) > MOST_GRAMS:
        raise ValueError(f"{len(rows)} template windows; they are broadcast, so at most {MOST_GRAMS}")
    return rows


def votes(spark: SparkSession, docs: DataFrame, **templates) -> DataFrame:
    """row, doc_id, n_words, template, is_base, windows, diagonal, votes, lo, hi (first and last matched window of the
    text); one row without template for the windows of a text that match nothing."""
    rows = spark.createDataFrame(template_rows(**templates), "t_gram string, template string, is_base boolean, place int, windows int")
    rows = F.broadcast(rows.withColumn("t_hash", F.xxhash64("t_gram")))
    ws = F.col("ws")
    grams = F.when(F.size(ws) >= K, F.transform(
        F.sequence(F.lit(0), F.size(ws) - K), lambda i: F.concat_ws(" ", *(F.get(ws, i + j) for j in range(K)))))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("ws"))
    texts = texts.select("row", "doc_id", F.size(ws).cast("long").alias("n_words"), grams.alias("grams"))
    found = texts.select("row", "doc_id", "n_words", F.posexplode_outer("grams").alias("at", "gram"))
    found = found.join(rows, (F.xxhash64("gram") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left")
    # all windows that match nothing become one row of their text
    at = F.when(F.col("template").isNotNull(), F.col("at"))
    return found.groupBy("row", "doc_id", "n_words", "template", "is_base", "windows", (at - F.col("place")).alias("diagonal")).agg(
        F.count("template").alias("votes"), F.min(at).alias("lo"), F.max(at).alias("hi"),
        F.collect_set("place").alias("places"))


def spans(voted: DataFrame) -> DataFrame:
    """Runs of neighbouring diagonals with the share of the template that they cover."""
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    run = voted.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= NEAR, 0).otherwise(1))
    run = run.withColumn("run", F.sum("new").over(by))
    stretch = Window.partitionBy("row", "template", "run").orderBy("diagonal").rangeBetween(0, DRIFT)
    run = run.withColumn("covered", F.size(F.array_distinct(F.flatten(F.collect_list("places").over(stretch)))))
    return run.groupBy("row", "doc_id", "n_words", "template", "is_base", "run").agg(
        F.min("diagonal").alias("diagonal"), F.min("lo").alias("first"), (F.max("hi") + K - 1).alias("last"),
        F.max("votes").alias("best"), F.max("windows").alias("windows"), F.sum("votes").alias("votes"), F.max("covered").alias("covered"),
        F.sum(F.when(F.col("votes") == F.col("windows"), 1).otherwise(0)).alias("whole"),
        F.min(F.when(F.col("votes") == F.col("windows"), F.col("diagonal"))).alias("whole_first"),
        F.max(F.when(F.col("votes") == F.col("windows"), F.col("diagonal"))).alias("whole_last"),
    ).withColumn("score", F.when(F.col("windows") > 0, F.col("covered") / F.col("windows")).otherwise(0.0))


def report(spark: SparkSession, docs: DataFrame, **templates) -> DataFrame:
    """One row per document: words, places of the phrases, labels and the best share of a template."""
    found = spans(votes(spark, docs, **templates))
    base = F.col("is_base")
    label = F.regexp_replace("template", "^base:", "")
    for template, name in NAMES.items():
        label = F.when(label == template, name).otherwise(label)
    joined = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, label))), ",")
    whole = base & (F.col("whole") > 0)
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.when(base, F.col("whole"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("whole_first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("whole_last"))).cast("long").alias("last_word"),
        joined(whole).alias("base_labels"), joined(whole | (~base & (F.col("score") >= ENOUGH))).alias("labels"),
        F.round(F.max(F.when(whole, 1.0).when(base, 0.0).otherwise(F.col("score"))), 9).alias("score"),
    ).drop("row")


def sql(source: str = "documents") -> str:
    """The report as DuckDB SQL."""
    rows = ", ".join(f"('{g}', '{t}', {str(b).lower()}, {i}, {n})" for g, t, b, i, n in template_rows())
    label = "CASE regexp_replace(template, '^base:', '') " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NAMES.items())
    label += " ELSE regexp_replace(template, '^base:', '') END"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH t(gram, template, is_base, place, windows) AS (VALUES {rows}),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {source}),
g AS (SELECT rid, unnest(range(0, len(w) - 2)) AS pos, w FROM d WHERE len(w) >= 3),
v AS (SELECT rid, template, is_base, windows, pos - place AS diagonal, count(*) AS votes, list(place) AS places
      FROM g JOIN t ON t.gram = w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] GROUP BY ALL),
r AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {NEAR} THEN 0 ELSE 1 END AS fresh FROM v WINDOW o AS (PARTITION BY rid, template ORDER BY diagonal)),
q AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run FROM r),
p AS (SELECT *, len(list_distinct(flatten(list(places) OVER (PARTITION BY rid, template, run ORDER BY diagonal
        RANGE BETWEEN CURRENT ROW AND {DRIFT} FOLLOWING)))) AS covered FROM q),
s AS (SELECT rid, template, is_base, max(covered) / max(windows) AS score, count_if(votes = windows) AS whole,
        min(CASE WHEN votes = windows THEN diagonal END) AS a, max(CASE WHEN votes = windows THEN diagonal END) AS z
      FROM p GROUP BY rid, template, is_base, run),
f AS (SELECT rid, sum(whole) FILTER (is_base) AS n_base, min(a) FILTER (is_base) AS first_word, max(z) FILTER (is_base) AS last_word,
        string_agg(DISTINCT {label}, ',' ORDER BY {label}) FILTER (is_base AND whole > 0) AS base_labels,
        string_agg(DISTINCT {label}, ',' ORDER BY {label}) FILTER (is_base AND whole > 0 OR NOT is_base AND score >= {ENOUGH}) AS labels,
        max(CASE WHEN is_base AND whole > 0 THEN 1.0 WHEN is_base THEN 0.0 ELSE score END) AS score FROM s GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 9)::DOUBLE AS score
FROM d LEFT JOIN f USING (rid)"""
