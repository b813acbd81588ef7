"""Scans, predicates, joins, aggregates and windows over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import Tables, query
from wardstone.functions import (
    age_at, any_of, burden, class_column, combined_label, days_between, died_between, died_within, either_label, encode,
    hours_between, level_band, night_flag, round_half_away, safe_ratio, shift, threshold_flags,
)
from wardstone.operators.assemble import assemble, attrition, cohort, row_counts, zero_fill
from wardstone.operators.assessment import assessment_summary, assessment_times
from wardstone.operators.balance import balance
from wardstone.operators.codesets import code_flags, spread_to_entities
from wardstone.operators.profile import item_report
from wardstone.operators.rules import CodeRule, FeatureRule, OrdinalRule, TextClass, ThresholdRule
from wardstone.operators.scores import ordinal_scores, sum_of_parts
from wardstone.operators.sequence import entity_sequence, ever_flag, first_value
from wardstone.operators.windowed import windowed_features, within_window
from wardstone.session import scratch_path
from wardstone.sources import load_tables, read_csv, read_optional, write_csv

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
EVENT_TYPES = ("signup", "purchase", "view", "click", "error")


def first_events(t: Tables):
    """Anchor of each user: the time of the first event."""
    return t("events").groupBy("user_id").agg(F.min("ts").alias("anchor"))


FIRST_DAY_RULES = (
    *[FeatureRule(f"{kind}_mean", "avg", (kind,), window=(0, 24)) for kind in EVENT_TYPES],
    *[FeatureRule(f"{kind}_max", "max", (kind,), window=(0, 24)) for kind in EVENT_TYPES],
    *[FeatureRule(f"{kind}_min", "min", (kind,), window=(0, 24)) for kind in EVENT_TYPES],
    FeatureRule("view_sd", "stddev", ("view",), window=(0, 24)),
    FeatureRule("n_day", "count", EVENT_TYPES, window=(0, 24)),
    FeatureRule("n_half_day", "count", EVENT_TYPES, window=(0, 12)),
    FeatureRule("any_error_day", "any", ("error",), window=(0, 24)),
    FeatureRule("high_value_ever", "any", EVENT_TYPES, where=(">=", 50)),
    FeatureRule("mid_views_ever", "count", ("view",), valid=(5, 25)),
    FeatureRule("spend_ever", "sum", ("purchase",)),
)
FIRST_DAY_FLAGS = (
    ThresholdRule("busy_day", (("n_day", ">=", 4),)),
    ThresholdRule("odd_views", (("view_min", "<", 2), ("view_max", ">", 40))),
)
_DAY = "FILTER (WHERE event_type = '{0}' AND ts <= anchor + INTERVAL 24 HOUR)"


@query(
    "first_day_features",
    "WITH a AS (SELECT user_id, min(ts) AS anchor FROM events GROUP BY user_id), f AS (SELECT user_id, "
    + ", ".join(
        f"{fn}(value) {_DAY.format(k)} AS {k}_{suffix}"
        for fn, suffix in (("avg", "mean"), ("max", "max"), ("min", "min")) for k in EVENT_TYPES
    )
    + f""", stddev_samp(value) {_DAY.format('view')} AS view_sd,
  count(*) FILTER (WHERE ts <= anchor + INTERVAL 24 HOUR) AS n_day,
  count(*) FILTER (WHERE ts <= anchor + INTERVAL 12 HOUR) AS n_half_day,
  CAST(count(*) {_DAY.format('error')} > 0 AS INT) AS any_error_day,
  CAST(count(*) FILTER (WHERE value >= 50) > 0 AS INT) AS high_value_ever,
  count(*) FILTER (WHERE event_type = 'view' AND value BETWEEN 5 AND 25) AS mid_views_ever,
  sum(value) FILTER (WHERE event_type = 'purchase') AS spend_ever
  FROM events JOIN a USING (user_id) GROUP BY user_id),
u AS (SELECT c_custkey AS user_id, c_mktsegment FROM customer)
SELECT u.user_id, c_mktsegment, f.* EXCLUDE (user_id, any_error_day, high_value_ever, n_day, n_half_day, mid_views_ever),
  coalesce(any_error_day, 0) AS any_error_day, coalesce(high_value_ever, 0) AS high_value_ever, coalesce(n_day, 0) AS n_day,
  coalesce(n_half_day, 0) AS n_half_day, coalesce(mid_views_ever, 0) AS mid_views_ever,
  CAST(coalesce(n_day, 0) >= 4 AS INT) AS busy_day,
  CAST(coalesce(view_min < 2, FALSE) OR coalesce(view_max > 40, FALSE) AS INT) AS odd_views
FROM u LEFT JOIN f USING (user_id)""",
)
def _first_day(t: Tables):
    features = windowed_features(
        t("events"), first_events(t), FIRST_DAY_RULES, on="user_id", entity="user_id", time="ts", anchor_time="anchor",
        item="event_type", value="value",
    )
    users = t("customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    wide = zero_fill(
        assemble(users, [features], "user_id"),
        ["any_error_day", "high_value_ever", "n_day", "n_half_day", "mid_views_ever"],
    )
    return wide.withColumns(threshold_flags(FIRST_DAY_FLAGS))


@query("scan_row_counts", " UNION ALL ".join(f"SELECT '{n}' AS tbl, count(*) AS n FROM {n}" for n in GIVEN))
def _row_counts(t: Tables):
    return row_counts(load_tables(t.spark, t.base, GIVEN, register=True))


@query(
    "csv_round_trip",
    """SELECT c_nationkey, count(*) AS n, sum(c_acctbal) AS balance, min(c_name) AS first_name, max(c_mktsegment) AS last_segment
       FROM customer GROUP BY c_nationkey""",
)
def _csv(t: Tables):
    path = scratch_path(t.spark, "customer-csv")
    write_csv(t("customer"), path)
    back = read_csv(t.spark, path, t("customer").schema)
    return back.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("balance"), F.min("c_name").alias("first_name"),
        F.max("c_mktsegment").alias("last_segment"),
    )


@query("optional_source", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _optional(t: Tables):
    found = read_optional(t.spark, f"{t.base}/second_cohort.parquet", fmt="parquet")
    source = found if found is not None else read_optional(t.spark, f"{t.base}/orders.parquet", fmt="parquet")
    return source.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pushed_filters",
    """SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem
       WHERE l_linestatus = 'O' AND l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 5 AND 30 AND l_shipdate IS NOT NULL
       GROUP BY l_returnflag""",
)
def _filters(t: Tables):
    return (
        t("lineitem")
        .where(
            (F.col("l_linestatus") == "O") & F.col("l_returnflag").isin("A", "R") & F.col("l_quantity").between(5, 30)
            & F.col("l_shipdate").isNotNull()
        )
        .groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    )


@query(
    "text_predicates",
    """SELECT p_brand, count(*) FILTER (WHERE p_name LIKE 'small%') AS small_start, count(*) FILTER (WHERE p_name LIKE '%bolt%') AS bolts,
         count(*) FILTER (WHERE p_name ILIKE '%RING%') AS rings, count(*) FILTER (WHERE lower(p_type) LIKE '%promo%') AS promos,
         count(*) FILTER (WHERE p_type >= 'LARGE' AND p_type < 'PROMO') AS between_types
       FROM part GROUP BY p_brand""",
)
def _predicates(t: Tables):
    name, kind = F.col("p_name"), F.col("p_type")
    return t("part").groupBy("p_brand").agg(
        F.count_if(name.startswith("small")).alias("small_start"), F.count_if(name.contains("bolt")).alias("bolts"),
        F.count_if(name.ilike("%RING%")).alias("rings"), F.count_if(F.lower(kind).contains("promo")).alias("promos"),
        F.count_if((kind >= "LARGE") & (kind < "PROMO")).alias("between_types"),
    )


@query("distinct_keys", "SELECT DISTINCT l_suppkey FROM lineitem")
def _distinct(t: Tables):
    return t("lineitem").select("l_suppkey").distinct()


@query(
    "window_join_bounds",
    """SELECT e.user_id, count(*) FILTER (WHERE ts BETWEEN anchor AND anchor + INTERVAL 24 HOUR) AS closed_day,
         count(*) FILTER (WHERE ts > anchor + INTERVAL 12 HOUR) AS after_half, count(*) FILTER (WHERE ts <= anchor + INTERVAL 12 HOUR) AS up_to_half
       FROM events e JOIN (SELECT user_id, min(ts) AS anchor FROM events GROUP BY 1) a ON a.user_id = e.user_id
       WHERE ts BETWEEN anchor AND anchor + INTERVAL 72 HOUR GROUP BY e.user_id""",
)
def _window_join(t: Tables):
    rows = within_window(t("events").select("user_id", "ts"), first_events(t), "user_id", "ts", "anchor", 0, 72)
    half, day = shift(F.col("anchor"), hours=12), shift(F.col("anchor"), hours=24)
    return rows.groupBy("user_id").agg(
        F.count_if(F.col("ts") <= day).alias("closed_day"), F.count_if(F.col("ts") > half).alias("after_half"),
        F.count_if(F.col("ts") <= half).alias("up_to_half"),
    )


@query(
    "window_on_coarser_key",
    """WITH s AS (SELECT o_custkey * 2 AS visit, o_custkey, o_orderdate AS anchor, o_orderkey FROM orders
                  UNION ALL SELECT o_custkey * 2 + 1, o_custkey, o_orderdate + INTERVAL 60 DAY, o_orderkey FROM orders)
       SELECT s.o_orderkey, s.visit % 2 AS later, max(l_quantity) FILTER (WHERE l_linenumber <= 3) AS low_line_max,
         min(l_quantity) FILTER (WHERE l_linenumber > 3) AS high_line_min, count(*) AS n
       FROM lineitem l JOIN s ON s.o_orderkey = l.l_orderkey
       WHERE l_shipdate BETWEEN s.anchor AND s.anchor + INTERVAL 365 DAY GROUP BY ALL""",
)
def _coarser(t: Tables):
    orders = t("orders").select("o_orderkey", F.col("o_orderdate").alias("anchor"))
    visits = orders.withColumn("later", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "anchor", F.when(F.col("later") == 1, shift(F.col("anchor"), days=60)).otherwise(F.col("anchor"))
    ).withColumn("visit", F.struct("o_orderkey", "later"))
    rules = (
        FeatureRule("low_line_max", "max", (1, 2, 3), window=(0, 24 * 365)),
        FeatureRule("high_line_min", "min", (4, 5, 6, 7), window=(0, 24 * 365)),
        FeatureRule("n", "count", tuple(range(1, 8)), window=(0, 24 * 365)),
    )
    lines = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = windowed_features(
        lines, visits, rules, on="o_orderkey", entity="visit", time="l_shipdate", anchor_time="anchor",
        item="l_linenumber", value="l_quantity",
    )
    return out.select("visit.*", "low_line_max", "high_line_min", "n")


@query(
    "star_assembly",
    """WITH q AS (SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1),
            r AS (SELECT DISTINCT l_orderkey, 1 AS returned FROM lineitem WHERE l_returnflag = 'R'),
            d AS (SELECT l_orderkey, max(l_discount) AS discount_max FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
       SELECT o_orderkey, n_name, c_mktsegment, quantity, coalesce(returned, 0) AS returned, discount_max
       FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
         LEFT JOIN q ON q.l_orderkey = o_orderkey LEFT JOIN r ON r.l_orderkey = o_orderkey LEFT JOIN d ON d.l_orderkey = o_orderkey""",
)
def _star(t: Tables):
    lines = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    base = (
        t("orders").select("o_orderkey", "o_custkey")
        .join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), "o_custkey")
        .join(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
        .select("o_orderkey", "n_name", "c_mktsegment")
    )
    # One aggregation gives all three feature tables: they differ only in which rows they take.
    features = lines.groupBy("o_orderkey").agg(
        F.sum("l_quantity").alias("quantity"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"),
        F.max(F.when(F.col("l_quantity") > 25, F.col("l_discount"))).alias("discount_max"),
    )
    return zero_fill(assemble(base, [features], "o_orderkey"), ["returned"])


@query(
    "fanout_counts",
    """WITH a AS (SELECT user_id, ts, event_type, event_type IN ('error', 'purchase') AS gate,
                    CASE WHEN contains(props, '1') THEN 'positive' WHEN contains(props, '2') THEN 'negative'
                         WHEN contains(props, '3') THEN 'unable' ELSE 'other' END AS said FROM events),
            s AS (SELECT user_id, min(ts) AS anchor FROM events GROUP BY user_id)
       SELECT a.user_id, count(DISTINCT a.ts) AS n_assessments, count(*) FILTER (WHERE a.said = 'positive') AS n_positive,
         count(*) FILTER (WHERE a.said = 'negative') AS n_negative, count(*) FILTER (WHERE a.said = 'unable') AS n_unable,
         coalesce(max(CAST(g.said = 'positive' AS INT)), 0) AS ever_positive,
         CAST(count(*) FILTER (WHERE g.said = 'positive' AND g.ts <= anchor + INTERVAL 48 HOUR) > 0 AS INT) AS prevalent_48h,
         CAST(count(*) FILTER (WHERE g.said = 'positive' AND g.ts > anchor + INTERVAL 48 HOUR) > 0 AS INT) AS incident_48h,
         min(date_diff('microsecond', anchor, g.ts)) FILTER (WHERE g.said = 'positive') / 3.6e9 AS hours_to_first_positive
       FROM a JOIN s USING (user_id) LEFT JOIN a g ON g.user_id = a.user_id AND g.gate GROUP BY a.user_id""",
)
def _fanout(t: Tables):
    classes = (TextClass("positive", ("1",)), TextClass("negative", ("2",)), TextClass("unable", ("3",)))
    times = assessment_times(
        t("events"), entity="user_id", item="event_type", time="ts", text="props", gate_items=("error", "purchase"),
        all_items=EVENT_TYPES, classes=classes,
    )
    return assessment_summary(
        times, first_events(t), entity="user_id", time="ts", anchor_time="anchor", cuts=(48,)
    ).drop("outcome", "screened")


@query(
    "two_sided_balance",
    """WITH a AS (SELECT l_orderkey, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
            r AS (SELECT l_orderkey, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
       SELECT coalesce(a.l_orderkey, r.l_orderkey) AS l_orderkey, coalesce(a.v, 0) AS gained, coalesce(r.v, 0) AS lost,
         coalesce(a.v, 0) - coalesce(r.v, 0) AS net, CAST(coalesce(a.v, 0) - coalesce(r.v, 0) > 20 AS INT) AS net_high
       FROM a FULL JOIN r ON a.l_orderkey = r.l_orderkey""",
)
def _balance(t: Tables):
    lines = t("lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    return balance(
        lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"), entity="l_orderkey",
        gain="l_quantity", loss="l_quantity", threshold=20,
    )


@query(
    "sum_of_minima",
    """WITH m AS (SELECT user_id, min(value) FILTER (WHERE event_type = 'view') AS a, min(value) FILTER (WHERE event_type = 'error') AS b,
                    min(value) FILTER (WHERE event_type = 'signup') AS c FROM events GROUP BY user_id)
       SELECT user_id, coalesce(a, 4) + coalesce(b, 5) + coalesce(c, 6) AS total FROM m
       WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL""",
)
def _minima(t: Tables):
    rules = [FeatureRule(kind, "min", (kind,)) for kind in ("view", "error", "signup")]
    parts = windowed_features(t("events"), None, rules, entity="user_id", item="event_type", value="value")
    total = sum_of_parts([("view", 4), ("error", 5), ("signup", 6)])
    return parts.select("user_id", total.alias("total")).where(F.col("total").isNotNull())


@query("exists_flag", "SELECT DISTINCT user_id, 1 AS had_error FROM events WHERE event_type = 'error' AND value > 30")
def _exists(t: Tables):
    return ever_flag(t("events"), "user_id", "had_error", (F.col("event_type") == "error") & (F.col("value") > 30))


@query(
    "semi_join_filter",
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
)
def _semi(t: Tables):
    pending = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").select("c_custkey", "c_name").join(pending, "c_custkey", "left_semi")


@query(
    "first_value_in_range",
    """SELECT user_id, value AS first_value, CAST(value <= 8 AS INT) AS low_start FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS nth FROM events
         WHERE event_type = 'click' AND value BETWEEN 3 AND 15) WHERE nth = 1""",
)
def _first_value(t: Tables):
    wanted = (F.col("event_type") == "click") & F.col("value").between(3, 15)
    return first_value(t("events"), "user_id", "ts", "value", where=wanted).withColumn(
        "low_start", F.when(F.col("first_value") <= 8, 1).otherwise(0)
    )


@query(
    "entity_sequence",
    """SELECT o_orderkey, o_custkey, row_number() OVER w AS seq, CAST(row_number() OVER w = 1 AS INT) AS is_first,
         count(*) OVER (PARTITION BY o_custkey) AS n_per_entity, CAST(row_number() OVER w > 1 AS INT) AS has_prior
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def _sequence(t: Tables):
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return entity_sequence(orders, "o_custkey", "o_orderdate", ["o_orderkey"]).drop("o_orderdate")


@query(
    "hot_entity_sequence",
    """SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq,
         count(*) OVER (PARTITION BY event_type) AS n_per_entity FROM events""",
)
def _hot_sequence(t: Tables):
    """Few entities with very many rows each: ranks come from many tasks per entity."""
    events = t("events").select("event_id", "event_type", "ts")
    return entity_sequence(events, "event_type", "ts", ["event_id"]).select("event_id", "event_type", "seq", "n_per_entity")


@query(
    "item_report_top",
    """SELECT p_partkey, p_name, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey
       WHERE p_name ILIKE '%GEAR%' AND l_quantity > 10 GROUP BY ALL ORDER BY n DESC, p_partkey LIMIT 10""",
)
def _item_report(t: Tables):
    lines = t("lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return item_report(
        lines, t("part"), item="p_partkey", label="p_name", pattern="%GEAR%", where=F.col("l_quantity") > 10, k=10
    )


BRAND_RULES = (
    CodeRule("teens", ("Brand#1",)),
    CodeRule("picked", codes=("Brand#3", "Brand#22", "Brand#25")),
    CodeRule("middle", ranges=(("Brand#12", "Brand#17"),)),
    CodeRule("mixed", ("Brand#2",), ("Brand#4",), (("Brand#6", "Brand#8"),)),
)


def _codes(t: Tables):
    brands = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return t("lineitem").select("l_orderkey", "l_partkey").join(brands, "l_partkey")


_CODE_COLUMNS = """CAST(bool_or(p_brand LIKE 'Brand#1%') AS INT) AS teens, CAST(bool_or(p_brand IN ('Brand#3', 'Brand#22', 'Brand#25')) AS INT) AS picked,
  CAST(bool_or(p_brand >= 'Brand#12' AND p_brand < 'Brand#17') AS INT) AS middle,
  CAST(bool_or(p_brand LIKE 'Brand#2%' OR p_brand = 'Brand#4' OR (p_brand >= 'Brand#6' AND p_brand < 'Brand#8')) AS INT) AS mixed"""


@query("code_flags_all_keys", f"SELECT l_orderkey, {_CODE_COLUMNS} FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def _code_flags(t: Tables):
    return code_flags(_codes(t), BRAND_RULES, key="l_orderkey", code="p_brand", only_matches=False)


@query(
    "code_flags_to_customers",
    f"""WITH f AS (SELECT l_orderkey, {_CODE_COLUMNS} FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
        SELECT o_custkey AS visit, f.* EXCLUDE (l_orderkey) FROM orders JOIN f ON l_orderkey = o_orderkey
        WHERE teens + picked + middle + mixed > 0""",
)
def _code_bridge(t: Tables):
    flags = code_flags(_codes(t), BRAND_RULES, key="l_orderkey", code="p_brand")
    bridge = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("visit"))
    return spread_to_entities(flags, bridge, "l_orderkey", "visit")


@query(
    "codes_without_dots",
    """SELECT p_partkey, CAST(replace(p_brand, '#', '.') LIKE 'Brand.1%' AS INT) AS dotted FROM part WHERE p_brand LIKE 'Brand#1%'""",
)
def _dots(t: Tables):
    parts = t("part").withColumn("code", F.replace("p_brand", F.lit("#"), F.lit("")))
    return code_flags(parts, [CodeRule("dotted", ("Brand.1",))], key="p_partkey", code="code", normalise=True)


@query(
    "ordered_text_classes",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'yes') THEN 'positive' WHEN contains(lower(text), 'no') THEN 'negative'
         WHEN regexp_matches(lower(text), 'unable|language|barrier') THEN 'unable' ELSE 'other' END AS said,
         CASE WHEN contains(text, 'The') OR contains(text, 'And') THEN 1 WHEN lang = 'fr' THEN 2 ELSE 5 END AS code FROM documents""",
)
def _text_classes(t: Tables):
    said = (TextClass("positive", ("yes",)), TextClass("negative", ("no",)), TextClass("unable", ("unable", "language", "barrier")))
    code = F.when(encode("text", (TextClass(1, ("The", "And")),), 0) == 1, 1).otherwise(
        encode("lang", (TextClass(2, equals=("fr",)),), 5)
    )
    return t("documents").select("doc_id", class_column("text", said, "other", fold_case=True).alias("said"), code.alias("code"))


PRICE_SCORES = (
    OrdinalRule("price_points", (("o_totalprice", ">=", 400000, 4), ("o_totalprice", ">=", 250000, 3), ("o_totalprice", ">=", 100000, 2), ("o_totalprice", ">=", 50000, 1))),
    OrdinalRule("mixed_points", (("is_urgent", "=", 1, 4), ("lines", "<", 2, 3), ("lines", "<", 4, 1))),
    OrdinalRule("ratio_points", (("price_per_line", "<", 30000, 4), ("price_per_line", "<", 60000, 2))),
)


@query(
    "ordinal_scores",
    """WITH w AS (SELECT o_orderkey, o_totalprice, CAST(o_orderpriority = '1-URGENT' AS INT) AS urgent, n FROM orders
                  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1) ON l_orderkey = o_orderkey)
       SELECT *, price_points + mixed_points + ratio_points AS total, CAST(price_points + mixed_points + ratio_points >= 8 AS INT) AS severe FROM (
         SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 4 WHEN o_totalprice >= 250000 THEN 3 WHEN o_totalprice >= 100000 THEN 2 WHEN o_totalprice >= 50000 THEN 1 ELSE 0 END AS price_points,
           CASE WHEN urgent = 1 THEN 4 WHEN n < 2 THEN 3 WHEN n < 4 THEN 1 ELSE 0 END AS mixed_points,
           CASE WHEN o_totalprice / n < 30000 THEN 4 WHEN o_totalprice / n < 60000 THEN 2 ELSE 0 END AS ratio_points FROM w)""",
)
def _scores(t: Tables):
    lines = (
        t("lineitem").where("l_returnflag <> 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    orders = t("orders").select(
        "o_orderkey", "o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("is_urgent")
    )
    wide = assemble(orders, [lines], "o_orderkey").withColumn("price_per_line", safe_ratio(F.col("o_totalprice"), F.col("lines")))
    scored = ordinal_scores(wide, PRICE_SCORES, "total").withColumns(
        threshold_flags([ThresholdRule("severe", (("total", ">=", 8),))])
    )
    return scored.select("o_orderkey", *[r.name for r in PRICE_SCORES], "total", "severe")


@query(
    "flag_composites",
    """WITH f AS (SELECT l_orderkey, max(CAST(l_returnflag = 'A' AS INT)) AS a, max(CAST(l_returnflag = 'N' AS INT)) AS n,
                    max(CAST(l_returnflag = 'R' AS INT)) AS r FROM lineitem GROUP BY 1),
            w AS (SELECT o_orderkey, coalesce(a, 0) AS a, coalesce(n, 0) AS n, coalesce(r, 0) AS r FROM orders LEFT JOIN f ON l_orderkey = o_orderkey)
       SELECT o_orderkey, greatest(a, r) AS any_a_r, a + n + r AS burden, 'A' || CASE a WHEN 1 THEN '+' ELSE '-' END || '/N' || CASE n WHEN 1 THEN '+' ELSE '-' END
           || '/R' || CASE r WHEN 1 THEN '+' ELSE '-' END AS label,
         CASE WHEN a = 1 AND (n = 1 OR r = 1) THEN 'Both' WHEN a = 1 THEN 'A Only' WHEN n = 1 OR r = 1 THEN 'Other Only' ELSE 'Neither' END AS grouping
       FROM w""",
)
def _composites(t: Tables):
    rules = [FeatureRule(f"has_{x.lower()}", "any", (x,)) for x in "ANR"]
    flags = windowed_features(
        t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), None, rules, entity="o_orderkey", item="l_returnflag"
    )
    names = [r.name for r in rules]
    wide = assemble(t("orders").select("o_orderkey"), [flags], "o_orderkey")
    return wide.select(
        "o_orderkey", any_of(["has_a", "has_r"]).alias("any_a_r"), burden(names).alias("burden"),
        combined_label(list(zip(names, "ANR"))).alias("label"),
        either_label(["has_a"], ["has_n", "has_r"], ("Both", "A Only", "Other Only", "Neither")).alias("grouping"),
    )


@query(
    "time_functions",
    """SELECT event_id, year(ts) AS year_no, hour(ts) AS hour_no, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 3.6e9 AS hours,
         date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 8.64e10 AS days, ts + INTERVAL 30 DAY AS plus_30d, ts + INTERVAL 1 YEAR AS plus_1y,
         CAST(hour(ts) >= 20 OR hour(ts) < 6 AS INT) AS at_night, 40 + year(ts) - 1995 AS age,
         CASE WHEN user_id % 90 < 65 THEN 0 WHEN user_id % 90 < 75 THEN 1 WHEN user_id % 90 < 85 THEN 2 ELSE 3 END AS age_band
       FROM events""",
)
def _time(t: Tables):
    ts, start = F.col("ts"), F.lit("2024-01-01").cast("timestamp_ntz")
    return t("events").select(
        "event_id", F.year(ts).alias("year_no"), F.hour(ts).alias("hour_no"), hours_between(start, ts).alias("hours"),
        days_between(start, ts).alias("days"), shift(ts, days=30).alias("plus_30d"), shift(ts, years=1).alias("plus_1y"),
        night_flag(ts).alias("at_night"), age_at(F.lit(40), F.lit(1995), ts).alias("age"),
        level_band(F.col("user_id") % 90, (65, 75, 85)).alias("age_band"),
    )


@query(
    "event_after_anchor",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 10 DAY AS INT) AS during,
         CAST(CAST(l_shipdate AS DATE) <= o_orderdate + INTERVAL 30 DAY AS INT) AS by_30d, CAST(CAST(l_shipdate AS DATE) <= o_orderdate + INTERVAL 90 DAY AS INT) AS by_90d,
         CAST(CAST(l_shipdate AS DATE) <= o_orderdate + INTERVAL 1 YEAR AS INT) AS by_1y
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def _after(t: Tables):
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    joined = lines.join(t("orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    start, happened = F.col("o_orderdate"), F.to_date("l_shipdate")
    return joined.select(
        F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey",
        died_between(F.col("l_shipdate"), start, shift(start, days=10)).alias("during"),
        died_within(happened, start, days=30).alias("by_30d"), died_within(happened, start, days=90).alias("by_90d"),
        died_within(happened, start, years=1).alias("by_1y"),
    )


@query(
    "rounding_and_units",
    """SELECT user_id, CAST(round(CAST(avg(value) AS DECIMAL(30, 10)), 1) AS DOUBLE) AS mean_1, CAST(round(CAST(stddev_samp(value) AS DECIMAL(30, 10)), 2) AS DOUBLE) AS sd_2,
         max(CASE WHEN event_type = 'view' THEN value * 9.0 / 5.0 + 32 WHEN event_type = 'click' THEN value END) AS common_unit_max,
         sum(value) / NULLIF(count(*) FILTER (WHERE event_type = 'error'), 0) AS per_error
       FROM events GROUP BY user_id""",
)
def _rounding(t: Tables):
    value = F.col("value")
    rule = FeatureRule("common_unit_max", "max", ("view", "click"), convert={"view": "{v} * 9.0D / 5.0D + 32"})
    units = windowed_features(t("events"), None, [rule], entity="user_id", item="event_type", value="value")
    sums = t("events").groupBy("user_id").agg(
        round_half_away(F.avg(value), 1).alias("mean_1"), round_half_away(F.stddev_samp(value), 2).alias("sd_2"),
        safe_ratio(F.sum(value), F.count_if(F.col("event_type") == "error")).alias("per_error"),
    )
    return assemble(sums, [units], "user_id")


@query(
    "cohort_and_attrition",
    """WITH w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders), c AS (
         SELECT count(*) AS a, count(*) FILTER (WHERE o_orderstatus <> 'P') AS b, count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_totalprice >= 50000) AS c,
           count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_totalprice >= 50000 AND nth = 1) AS d FROM w)
       SELECT 0 AS step_no, 'all orders' AS step, a AS n, 0 AS removed FROM c UNION ALL SELECT 1, 'settled', b, a - b FROM c
       UNION ALL SELECT 2, 'large', c, b - c FROM c UNION ALL SELECT 3, 'first order', d, c - d FROM c""",
)
def _attrition(t: Tables):
    steps = {
        "settled": F.col("o_orderstatus") != "P", "large": F.col("o_totalprice") >= 50000, "first order": F.col("seq") == 1,
    }
    return attrition(entity_sequence(t("orders"), "o_custkey", "o_orderdate", ["o_orderkey"]), steps, "all orders")


@query(
    "cohort_filter",
    """SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders)
       WHERE nth = 1 AND o_totalprice >= 50000""",
)
def _cohort_filter(t: Tables):
    steps = {"first order": F.col("is_first") == 1, "large": F.col("o_totalprice") >= 50000}
    sequenced = entity_sequence(t("orders"), "o_custkey", "o_orderdate", ["o_orderkey"])
    return cohort(sequenced, steps).select("o_orderkey", "o_totalprice")
