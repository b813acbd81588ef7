"""Profiling, splitting, imputing and scaling the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import Tables, query
from wardstone.operators import prep, profile
from wardstone.operators.quantiles import exact_quantiles
from wardstone.plans import profiling

# Documents with their labels; most documents have none, which makes NULLs.
LABELLED_SQL = """d AS (
  SELECT doc_id, lang, source, n_chars, quality, toxic, CASE WHEN n_chars % 5 <> 0 THEN n_chars END AS some_chars,
    CASE WHEN doc_id % 3 = 0 THEN CAST(length(text) AS DOUBLE) / 7 END AS third_length, CAST(lang = 'en' AS INT) AS english,
    CAST(NULL AS DOUBLE) AS nothing
  FROM documents LEFT JOIN labels USING (doc_id))"""
NUMERIC = ["n_chars", "quality", "toxic", "some_chars", "third_length", "english", "nothing"]


def labelled(t: Tables):
    chars = F.col("n_chars")
    return t("documents").join(t("labels"), "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic", F.when(chars % 5 != 0, chars).alias("some_chars"),
        F.when(F.col("doc_id") % 3 == 0, F.length("text").cast("double") / 7).alias("third_length"),
        F.when(F.col("lang") == "en", 1).otherwise(0).alias("english"), F.lit(None).cast("double").alias("nothing"),
    )


@query("table_shape", "SELECT count(*) AS n_rows, 6 AS n_columns FROM orders")
def _shape(t: Tables):
    return profile.shape(t("orders"))


@query("value_counts", f"WITH {LABELLED_SQL} SELECT quality, count(*) AS n FROM d WHERE quality IS NOT NULL GROUP BY quality")
def _counts(t: Tables):
    return profile.frequencies(labelled(t), ["quality"]).select(F.col("value").cast("int").alias("quality"), "n")


@query(
    "column_finder",
    """SELECT 'c_mktsegment' AS column_name, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2
       UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY 2""",
)
def _finder(t: Tables):
    customer = t("customer")
    return profile.frequencies(customer, profile.find_columns(customer, ["SEGMENT", "nation"]))


@query(
    "flag_check",
    f"""WITH {LABELLED_SQL} SELECT 'english' AS column_name, 1 AS present, CAST(sum(english) AS DOUBLE) AS total, avg(english) * 100 AS percent FROM d
        UNION ALL SELECT 'toxic', 1, CAST(sum(toxic) AS DOUBLE), avg(toxic) * 100 FROM d UNION ALL SELECT 'toxicity', 0, NULL, NULL""",
)
def _flags(t: Tables):
    return profile.flag_totals(labelled(t), ["english", "toxic", "toxicity"])


@query("similar_columns", "SELECT column_name, count(n) AS n FROM (SELECT 'toxic' AS column_name, toxic AS n FROM labels) GROUP BY 1")
def _similar(t: Tables):
    labels = t("labels")
    return labels.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in profile.find_columns(labels, ["TOX"])]))
    ).groupBy("column_name").agg(F.count("n").alias("n"))


@query(
    "leading_columns",
    """SELECT position, column_name, count(*) AS n_rows FROM (SELECT unnest([1, 2, 3]) AS position, unnest(['l_orderkey', 'l_partkey', 'l_suppkey']) AS column_name FROM lineitem)
       GROUP BY ALL""",
)
def _columns(t: Tables):
    lines = t("lineitem")
    rows = lines.groupBy().agg(F.count(F.lit(1)).alias("n_rows"))
    return profiling.report(lines)["leading_columns"].where("position <= 3").join(rows)


@query(
    "null_audit",
    f"WITH {LABELLED_SQL}, n AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_missing, (count(*) - count({c})) / count(*) * 100 AS pct_missing FROM d" for c in NUMERIC
    ) + ") SELECT * FROM n WHERE n_missing > 0",
)
def _nulls(t: Tables):
    return profile.null_audit(labelled(t), NUMERIC, digits=None)


@query(
    "drop_sparse_columns",
    f"WITH {LABELLED_SQL} SELECT doc_id, n_chars, some_chars, english FROM d",
)
def _sparse(t: Tables):
    docs = labelled(t)
    out = profile.too_sparse(docs, NUMERIC, 50)
    return docs.select("doc_id", *profile.columns_except(docs.select(*NUMERIC), out))


@query(
    "event_rate",
    "SELECT l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS events, avg(CAST(l_returnflag = 'R' AS INT)) * 100 AS percent FROM lineitem GROUP BY 1",
)
def _rate(t: Tables):
    returned = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return t("lineitem").groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(returned).alias("events"), (F.avg(returned) * 100).alias("percent")
    )


@query(
    "class_ratio",
    f"""WITH {LABELLED_SQL} SELECT count(*) FILTER (WHERE quality = 0) AS n_negative, count(*) FILTER (WHERE quality = 1) AS n_positive,
        count(*) FILTER (WHERE quality = 0) / count(*) FILTER (WHERE quality = 1) AS ratio FROM d""",
)
def _ratio(t: Tables):
    return profile.class_ratio(labelled(t), "quality")


@query(
    "class_weights",
    """SELECT l_returnflag, sum(CASE WHEN l_returnflag = 'R' THEN (SELECT count(*) FILTER (WHERE l_returnflag <> 'R') / count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem) ELSE 1 END) AS weight
       FROM lineitem GROUP BY 1""",
)
def _weights(t: Tables):
    lines = t("lineitem").withColumn("label", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    ratio = profile.class_ratio(lines, "label").first().ratio
    return prep.class_weights(lines, "label", ratio).groupBy("l_returnflag").agg(F.sum("weight").alias("weight"))


@query(
    "exact_medians",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({p} AS DOUBLE) AS prob, quantile_cont({c}, {p}) AS value FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for p in (0.25, 0.5)
    ),
)
def _medians(t: Tables):
    return exact_quantiles(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], (0.25, 0.5))


@query(
    "bracketed_medians",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(0.5 AS DOUBLE) AS prob, quantile_cont({c}, 0.5) AS value FROM lineitem" for c in ("l_extendedprice", "l_quantity")
    ),
)
def _bracketed(t: Tables):
    """The same in many rounds of few bins."""
    return exact_quantiles(t("lineitem"), ["l_extendedprice", "l_quantity"], (0.5,), bins=4, few=50)


def split_sql(source: str, label: str, key: str, seed, quotas: str) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5(CAST({key} AS VARCHAR) || '|{seed}'), {key}) AS nth FROM {source}),
sizes AS (SELECT {label} AS lb, count(*) AS n FROM {source} GROUP BY 1), {quotas}"""


# Quotas: a fifth of all rows, rounded up, shared out by largest remainder.
_QUOTAS = """want AS (SELECT ceil(sum(n) * 0.2) AS w, sum(n) AS total FROM sizes),
parts AS (SELECT lb, n, floor(n * w / total) AS base, n * w / total - floor(n * w / total) AS rest, w FROM sizes, want),
quota AS (SELECT lb, base + CAST(row_number() OVER (ORDER BY rest DESC, n DESC, CAST(lb AS VARCHAR)) <= w - sum(base) OVER () AS INT) AS q FROM parts)"""


@query(
    "stratified_split",
    f"""WITH {split_sql('orders', 'o_orderstatus', 'o_orderkey', 42, _QUOTAS)}
        SELECT o_orderkey, o_orderstatus, CAST(nth <= q AS INT) AS is_test FROM ranked JOIN quota ON lb = o_orderstatus""",
)
def _split(t: Tables):
    orders = t("orders").select("o_orderkey", "o_orderstatus")
    return prep.stratified_split(orders, "o_orderstatus", "o_orderkey", 0.2, 42)


@query(
    "nested_split",
    f"""WITH {split_sql('orders', 'o_orderstatus', 'o_orderkey', 42, _QUOTAS)},
        train AS (SELECT o_orderkey, o_orderstatus FROM ranked JOIN quota ON lb = o_orderstatus WHERE nth > q),
        {split_sql('train', 'o_orderstatus', 'o_orderkey', '42-calibration', _QUOTAS).replace('ranked AS', 'ranked2 AS').replace('sizes', 'sizes2').replace('want', 'want2').replace('parts', 'parts2').replace('quota AS', 'quota2 AS')}
        SELECT o_orderkey, o_orderstatus, CAST(nth <= q AS INT) AS is_calibration FROM ranked2 JOIN quota2 ON lb = o_orderstatus""",
)
def _nested(t: Tables):
    orders = t("orders").select("o_orderkey", "o_orderstatus")
    train = prep.stratified_split(orders, "o_orderstatus", "o_orderkey", 0.2, 42).where("is_test = 0").drop("is_test")
    return prep.stratified_split(train, "o_orderstatus", "o_orderkey", 0.2, "42-calibration", flag="is_calibration")


@query(
    "stratified_folds",
    """SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|7'), o_orderkey) - 1) % 5 AS INT) AS fold
       FROM orders""",
)
def _folds(t: Tables):
    return prep.folds(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 5, 7)


@query(
    "temporal_split",
    """SELECT o_orderkey, year(o_orderdate) || ' - ' || (year(o_orderdate) + 2) AS year_group, CAST(year(o_orderdate) + 2 > 1999 AS INT) AS is_test FROM orders""",
)
def _temporal(t: Tables):
    year = F.year("o_orderdate")
    orders = t("orders").select("o_orderkey", F.concat(year.cast("string"), F.lit(" - "), (year + 2).cast("string")).alias("year_group"))
    return prep.temporal_split(orders, "year_group", 1999)


@query(
    "column_kinds",
    f"WITH {LABELLED_SQL} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(coalesce(bool_and({c} IN (0, 1)), TRUE) AS INT) AS is_binary FROM d" for c in NUMERIC
    ),
)
def _kinds(t: Tables):
    docs = labelled(t)
    continuous, binary = prep.column_kinds(docs, NUMERIC)
    named = [(c, int(c in binary)) for c in [*continuous, *binary]]
    return docs.groupBy().agg(F.count(F.lit(1)).alias("_n")).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(b).alias("is_binary")) for c, b in named]))
    )


CONTINUOUS, BINARY = ["n_chars", "some_chars", "third_length"], ["quality", "toxic", "english", "nothing"]
_FILLED_SQL = ", ".join(
    [f"CAST(coalesce({c}, (SELECT median({c}) FROM d WHERE doc_id % 4 <> 0)) AS DOUBLE) AS {c}" for c in CONTINUOUS]
    + [f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in BINARY]
)


@query(
    "impute_and_scale",
    f"WITH {LABELLED_SQL}, f AS (SELECT doc_id, {_FILLED_SQL} FROM d) SELECT doc_id, "
    + ", ".join(
        f"{c}, coalesce(({c} - (SELECT avg({c}) FROM f WHERE doc_id % 4 <> 0)) / NULLIF((SELECT stddev_pop({c}) FROM f WHERE doc_id % 4 <> 0), 0), 0) AS z_{c}"
        for c in CONTINUOUS + BINARY
    ) + " FROM f",
)
def _impute(t: Tables):
    docs = labelled(t).select("doc_id", *NUMERIC)
    fitted = prep.fit_prep(docs.where("doc_id % 4 <> 0"), CONTINUOUS, BINARY)
    return fitted.scale(fitted.impute(docs)).select("doc_id", *fitted.columns, *[f"z_{c}" for c in fitted.columns])


@query(
    "fitted_preparation",
    f"WITH {LABELLED_SQL}, f AS (SELECT doc_id, {_FILLED_SQL} FROM d WHERE doc_id % 4 <> 0) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {int(c in BINARY)} AS is_binary, "
        + (f"(SELECT CAST(median({c}) AS DOUBLE) FROM d WHERE doc_id % 4 <> 0)" if c in CONTINUOUS else "CAST(0 AS DOUBLE)")
        + f" AS fill, avg({c}) AS mean, stddev_pop({c}) AS sd FROM f" for c in CONTINUOUS + BINARY
    ),
)
def _fitted(t: Tables):
    return prep.fit_prep(labelled(t).where("doc_id % 4 <> 0"), CONTINUOUS, BINARY).table(t.spark)


@query(
    "reconcile_columns",
    "SELECT doc_id, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic, CAST(0 AS DOUBLE) AS spam, CAST(0 AS DOUBLE) AS clean FROM labels",
)
def _reconcile(t: Tables):
    return prep.reconcile(t("labels"), ["quality", "toxic", "spam", "clean"], keep=["doc_id"])[0]


@query(
    "assembled_vector",
    f"WITH {LABELLED_SQL}, f AS (SELECT doc_id, {_FILLED_SQL} FROM d) SELECT doc_id, some_chars AS second, english AS sixth, 7 AS width, toxic AS picked_first, n_chars AS picked_second FROM f",
)
def _vector(t: Tables):
    from pyspark.ml.functions import vector_to_array

    docs = labelled(t)
    fitted = prep.fit_prep(docs.where("doc_id % 4 <> 0"), CONTINUOUS, BINARY)
    picked = prep.slice_features(fitted.matrix(docs, ["doc_id"]), "raw", ["toxic", "n_chars"], "picked")
    x, p = vector_to_array("raw"), vector_to_array("picked")
    return picked.select(
        "doc_id", x[1].alias("second"), x[5].alias("sixth"), F.size(x).alias("width"), p[0].alias("picked_first"), p[1].alias("picked_second")
    )


@query(
    "contiguous_folds",
    """WITH c AS (SELECT o_orderstatus AS label, count(*) AS n, min(o_orderkey) AS head FROM orders GROUP BY 1),
s AS (SELECT label, n, sum(n) OVER (ORDER BY head) - n AS start FROM c),
runs AS (SELECT label, i, sum((start + n - i + 4) // 5 - (start - i + 4) // 5) OVER (PARTITION BY label ORDER BY i) AS upto
  FROM s, range(5) f(i)),
r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rank FROM orders)
SELECT o_orderkey, o_orderstatus, CAST((SELECT count(*) FROM runs WHERE label = o_orderstatus AND upto < rank) AS INT) AS fold FROM r""",
)
def _contiguous(t: Tables):
    rows = t("orders").select("o_orderkey", "o_orderstatus")
    return prep.contiguous_folds(rows, "o_orderstatus", "o_orderkey", 5, per_part=4000)
