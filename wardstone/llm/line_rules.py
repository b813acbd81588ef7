"""Quality rules, line first: lines that fail a rule go, then documents that lost too much of their text.

Only DataFrame functions. One pass over the documents, no shuffle: every figure of a text is an expression over its own
words and lines. Three-word windows are compared by a 64-bit hash inside one text; they are sorted, not compared in
pairs, so that a very long text costs n log n.

Null text: no words, fails the base rule. Rows are judged one by one, so repeated rows get equal verdicts; extra columns
are kept, whatever their names, because the operator's own columns live in one struct until the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone.session import cut_lineage
from wardstone.llm.columns import any_names

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# Marks that prose uses sparingly: a line made of them is decoration, shouting or a broken table.
MARKS = "!?#*$%&|<>~^_=+@"
# Wording of page furniture; a line that holds one of these is not part of the text.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "log in to", "powered by",
    "privacy policy", "read more", "sign up for", "skip to content", "subscribe to", "terms of service", "terms of use",
)


@dataclass(frozen=True)
class Rules:
    """``min_words``: of a text. ``repeat_percent``: words in repeated three-word windows a text may have at most.
    ``mark_percent``: marks among the visible characters of a line. ``nav_words``: words there must be for each ``|``.
    ``lost_percent``: visible characters a text may lose with its failed lines."""

    min_words: int = 50
    repeat_percent: int = 50
    mark_percent: int = 10
    nav_words: int = 5
    lost_percent: int = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACES, ""))


def how_many(text: Column, signs: str) -> Column:
    rest = text
    for sign in signs:
        rest = F.replace(rest, F.lit(sign), F.lit(""))
    return F.length(text) - F.length(rest)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_fails(line: Column, rules: Rules) -> Column:
    """Punctuation, navigation and boilerplate rules of one line; lines without a word never fail."""
    n_words = F.size(words_of(line))
    punctuation = how_many(line, MARKS) * 100 > visible_length(line) * rules.mark_percent
    navigation = how_many(line, "|") * rules.nav_words > n_words
    low = F.lower(line)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | low.contains(phrase)
    return (n_words > 0) & (punctuation | navigation | boilerplate)


def measure(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """``docs`` plus the struct ``_rules``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean), cleaned (the text without failed lines), n_failed_lines."""
    t = F.coalesce(F.col(text), F.lit(""))
    words, grams = F.col("_words"), F.col("_grams")
    step = docs.withColumn("_words", words_of(t))
    # an index below zero cannot occur: the sequence is only built for three words or more
    step = step.withColumn("_grams", F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
            F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ))
    # (hash, place) in order of hash: a window is repeated if its neighbour has the same hash
    step = step.withColumn("_sorted", F.when(
        F.size(F.array_distinct(grams)) < F.size(grams),
        F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    ordered = F.col("_sorted")
    step = step.withColumn("_places", F.sort_array(F.transform(
        F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))
                 | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["i"],
    )))
    places = F.col("_places")
    repeated = F.aggregate(
        F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))),
        F.lit(0), lambda a, b: a + b,
    )
    step = step.withColumn("_lines", F.filter(F.split(t, "\n"), has_word))
    lines = F.col("_lines")
    step = step.withColumn("_stay", F.filter(F.split(t, "\n"), lambda line: ~line_fails(line, rules)))
    stay = F.array_join(F.col("_stay"), "\n")
    base = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        how_many(t, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"),
        stay.alias("cleaned"),
        visible_length(stay).cast("long").alias("left_chars"),
        (F.size(F.split(t, "\n")) - F.size(F.col("_stay"))).cast("long").alias("n_failed_lines"),
    )
    step = step.withColumn("_rules", base)
    r = F.col("_rules")
    failed = (r["n_words"] < rules.min_words) | (100 * r["n_repeat_words"] > rules.repeat_percent * r["n_words"])
    lost = 100 * (r["word_chars"] - r["left_chars"]) > rules.lost_percent * r["word_chars"]
    step = step.withColumn("_rules", r.withField("base_failed", failed).withField("kept", ~failed & ~lost))
    return step.drop("_words", "_grams", "_sorted", "_places", "_lines", "_stay")


def report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: the base figures and the verdict."""
    r = F.col("_rules")
    return measure(docs.select("doc_id", "text"), rules).select(
        "doc_id", *(r[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        r["base_failed"].alias("base_failed"), r["kept"].alias("kept"), r["n_failed_lines"].alias("n_failed_lines"),
    )


@any_names
def keep_clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, without their failed lines; ``n_chars`` follows the text where it is a column."""
    r = F.col("_rules")
    text = F.when(r["kept"], r["cleaned"]).alias("text")
    # written first: a filter on the verdict would be pushed below the arrays, which were then built again for every word
    out = measure(docs, rules).select(*(text if c == "text" else F.col(c) for c in docs.columns), r["kept"].alias("_kept"))
    out = cut_lineage(out).where("_kept").drop("_kept")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def sql(rules: Rules = Rules(), source: str = "documents") -> str:
    """The report as DuckDB SQL."""
    sp, any_line = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    count = lambda e, signs: f"(length({e}) - length(regexp_replace({e}, '[{_class(signs)}]', '', 'g')))"
    fails = (
        f"(regexp_matches(l, '{any_line}') AND ({count('l', MARKS)} * 100 > "
        f"length(regexp_replace(l, '{sp}', '', 'g')) * {rules.mark_percent} "
        f"OR {count('l', '|')} * {rules.nav_words} > len(regexp_extract_all(l, '{any_line}+')) "
        + "".join(f"OR contains(lower(l), '{p}') " for p in BOILERPLATE) + "))"
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {source}),
w AS (SELECT rid, regexp_extract_all(t, '{any_line}+') AS w,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{any_line}')) AS ls,
        string_split(t, chr(10)) AS al,
        list_filter(string_split(t, chr(10)), lambda l: NOT {fails}) AS stay FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM g),
p AS (SELECT rid, least(3, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 3)) AS c FROM h WHERE n > 1),
r AS (SELECT rid, sum(c) AS c FROM p GROUP BY rid),
m AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
        CAST({count('d.t', SYMBOLS)} AS BIGINT) AS n_symbols,
        CAST(len(w.ls) - len(list_distinct(w.ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.c, 0) AS BIGINT) AS n_repeat_words,
        length(regexp_replace(array_to_string(w.stay, chr(10)), '{sp}', '', 'g')) AS left_chars,
        CAST(len(w.al) - len(w.stay) AS BIGINT) AS n_failed_lines
      FROM d JOIN w USING (rid) LEFT JOIN r USING (rid)),
v AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT 100 * (word_chars - left_chars) > {rules.lost_percent} * word_chars AS kept, n_failed_lines
FROM v"""


def _class(signs: str) -> str:
    return "".join("\\" + s for s in signs)
