"""Line dedup by overlapping windows of three lines: repeated windows are found over the whole corpus and the lines of
their later occurrences go.

Only DataFrame functions. A window is three consecutive lines with a visible character, compared without outer blanks;
blank lines stand outside all windows and stay. The order of occurrences is (doc_id, text hash, line): nulls first; rows
that agree in doc_id and text are one document, so a repeated row is not removed as a copy of itself.

Shuffles: 24 bytes a window to find the first occurrence (combined before the exchange, so that a window of a third of
all documents is one row a task), the same rows again to find the others, and lines of those documents that lose some.
The second join is an inner sort-merge join: Spark splits its hot keys. Documents with fewer than three lines, null or
empty texts are returned as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from wardstone.llm.columns import any_names

BLANK = r"^[\x20\x09-\x0D]*|[\x20\x09-\x0D]*$"


def _key(text):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_key, h1, h2 and the numbers of the three lines of every window."""
    lines = F.filter(
        F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
                    lambda line, i: F.struct(i.alias("no"), F.regexp_replace(line, BLANK, "").alias("line"))),
        lambda x: x["line"] != "",
    )
    ls = F.col("ls")

    def window(i):
        a, b, c = F.get(ls, i), F.get(ls, i + 1), F.get(ls, i + 2)
        return F.struct(
            F.xxhash64(a["line"], b["line"], c["line"]).alias("h1"),
            F.xxhash64(c["line"], F.lit(3), b["line"], a["line"]).alias("h2"),
            a["no"].alias("a"), b["no"].alias("b"), c["no"].alias("c"),
        )

    found = docs.select("doc_id", _key(text).alias("text_key"), lines.alias("ls")).where(F.size(ls) >= 3)
    return found.select("doc_id", "text_key", F.explode(
        F.transform(F.sequence(F.lit(0), F.size(ls) - 3), window)).alias("w")).select("doc_id", "text_key", "w.*")


def later_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the sorted numbers of the lines that go, for documents that lose any."""
    found = windows(docs)
    at = F.struct("doc_id", "text_key", "a")
    first = found.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where(
        ~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    later = found.join(first, ["h1", "h2"]).where(~at.eqNullSafe(F.col("first")))
    covered = later.select("doc_id", "text_key", F.explode(F.array("a", "b", "c")).alias("no")).distinct()
    return covered.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("no")).alias("_gone"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the remaining text, plus the struct ``_lines``: n_lines, n_removed, n_spans (runs of removed line
    numbers)."""
    gone = later_lines(docs).withColumnsRenamed({"doc_id": "_id", "text_key": "_text_key"})
    joined = docs.withColumn("_key", _key("text")).join(
        gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text_key")), "left")
    joined = joined.withColumn("_split", F.split(F.col("text"), "\n"))
    lines, removed = F.col("_split"), F.col("_gone")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed), lambda i: F.get(lines, i))
    n_removed = F.coalesce(F.size(removed), F.lit(0))
    spans = F.size(F.filter(removed, lambda x, i: (i == 0) | (F.get(removed, i - 1) != x - 1)))
    joined = joined.withColumn("_lines", F.struct(
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(removed.isNull(), 0).otherwise(n_removed).cast("long").alias("n_removed"),
        F.when(removed.isNull(), 0).otherwise(spans).cast("long").alias("n_spans"),
    )).withColumn("_text", F.when(removed.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return joined.select(*(F.col("_text").alias("text") if c == "text" else F.col(c) for c in docs.columns), "_lines")


@any_names
def without_later_lines(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts; those of which nothing is left go. ``n_chars`` follows."""
    out = dedup(docs).where((F.col("_lines.n_removed") == 0) | (F.trim("text") != "")).drop("_lines")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select("doc_id", "_lines.*", "text")


def sql(source: str = "documents") -> str:
    """The report as DuckDB SQL, for tables whose doc_id is unique."""
    blank = r"^[\x20\x09-\x0D]*|[\x20\x09-\x0D]*$"
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM {source} WHERE text IS NOT NULL),
s AS (SELECT doc_id, no, regexp_replace(line, '{blank}', '', 'g') AS line FROM l),
v AS (SELECT doc_id, no AS a, line AS la, lead(no) OVER o AS b, lead(line) OVER o AS lb,
        lead(no, 2) OVER o AS c, lead(line, 2) OVER o AS lc FROM s WHERE line <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
f AS (SELECT *, row_number() OVER (PARTITION BY la, lb, lc ORDER BY doc_id, a) AS nth FROM v WHERE c IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest([a, b, c]) AS no FROM f WHERE nth > 1),
q AS (SELECT doc_id, no, lag(no) OVER (PARTITION BY doc_id ORDER BY no) AS before FROM g),
n AS (SELECT doc_id, count(*) AS n_removed, sum(CASE WHEN before = no - 1 THEN 0 ELSE 1 END) AS n_spans FROM q GROUP BY doc_id),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY no) AS text FROM l ANTI JOIN g USING (doc_id, no) GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(n.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n.n_spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM {source} d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""
