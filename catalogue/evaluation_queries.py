"""Metrics over a deterministic score of every line item."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from catalogue.registry import Tables, query
from wardstone.functions import round_columns
from wardstone.operators import ensemble, evaluate, explain, isotonic, linear
from wardstone.operators.explain import attribution_ranking, linear_attribution
from wardstone.plans import rulebook as rules

# A score with many ties and a label that depends on it a little.
SCORED_SQL = """s AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, CAST(l_returnflag = 'R' AS INT) AS label,
    ((l_orderkey * 31 + l_partkey * 7 + CAST(l_quantity AS BIGINT) * 3 + CASE WHEN l_returnflag = 'R' THEN 120 ELSE 0 END) % 1009) / 1024.0 AS score,
    ((l_partkey * 13 + l_suppkey * 5 + CASE WHEN l_returnflag = 'R' THEN 40 ELSE 0 END) % 211) / 256.0 AS other
  FROM lineitem)"""


def scored(t: Tables):
    returned = F.col("l_returnflag") == "R"
    mix = F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_quantity").cast("long") * 3
    second = F.col("l_partkey") * 13 + F.col("l_suppkey") * 5
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity",
        F.when(returned, 1).otherwise(0).alias("label"),
        (((mix + F.when(returned, 120).otherwise(0)) % 1009) / F.lit(1024.0)).alias("score"),
        (((second + F.when(returned, 40).otherwise(0)) % 211) / F.lit(256.0)).alias("other"),
    )


def curve_sql(by: str = "", score: str = "score", source: str = "s") -> str:
    """Counts per distinct score with running sums from the highest score down."""
    keys, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""g AS (SELECT {keys}{score} AS score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM {source} GROUP BY {keys}{score}),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER ({part}) AS n_pos, sum(neg) OVER ({part}) AS n_neg,
    lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
  FROM g WINDOW w AS ({part} ORDER BY score DESC))"""


_AUROC = "sum(neg * (tp - pos / 2.0)) / (max(n_pos) * max(n_neg))"
_AP = "sum(pos * tp / (tp + fp)) / max(n_pos)"


@query("auroc", f"WITH {SCORED_SQL}, {curve_sql('l_linestatus')} SELECT l_linestatus, {_AUROC} AS auroc FROM c GROUP BY l_linestatus")
def _auroc(t: Tables):
    return evaluate.auroc(scored(t), "score", "label", ["l_linestatus"])


@query(
    "average_precision",
    f"WITH {SCORED_SQL}, {curve_sql('l_linestatus')} SELECT l_linestatus, {_AP} AS average_precision FROM c GROUP BY l_linestatus",
)
def _ap(t: Tables):
    return evaluate.average_precision(scored(t), "score", "label", ["l_linestatus"])


@query("brier_score", f"WITH {SCORED_SQL} SELECT l_linestatus, avg((score - label) ** 2) AS brier FROM s GROUP BY l_linestatus")
def _brier(t: Tables):
    return evaluate.brier(scored(t), "score", "label", ["l_linestatus"])


@query(
    "ranking_many_scores",
    f"""WITH {SCORED_SQL}, f AS (SELECT label, score * 1000 + l_orderkey / 1048576.0 AS fine FROM s), {curve_sql('', 'fine', 'f')}
        SELECT CAST(sum(pos + neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS n_pos, {_AUROC} AS auroc, {_AP} AS average_precision FROM c""",
)
def _many(t: Tables):
    """Nearly one distinct score per row, cut into intervals of about a thousand scores."""
    fine = scored(t).select("label", (F.col("score") * 1000 + F.col("l_orderkey") / F.lit(1048576.0)).alias("fine"))
    return evaluate.ranking_metrics(fine, "fine", "label", per_part=1000)


@query(
    "roc_points",
    f"""WITH {SCORED_SQL}, {curve_sql()} SELECT score AS threshold, fp / n_neg AS fpr, tp / n_pos AS tpr FROM c
        WHERE NOT coalesce(pos = next_pos AND neg = next_neg AND tp + fp > pos + neg, FALSE)
        UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0""",
)
def _roc(t: Tables):
    return evaluate.roc_points(scored(t), "score", "label", per_part=100)


@query(
    "precision_recall_points",
    f"""WITH {SCORED_SQL}, {curve_sql()} SELECT score AS threshold, tp / (tp + fp) AS precision, tp / n_pos AS recall, n_pos / (n_pos + n_neg) AS baseline FROM c
        UNION ALL SELECT NULL, 1, 0, avg(label) FROM s""",
)
def _pr(t: Tables):
    return evaluate.pr_points(scored(t), "score", "label")


@query(
    "reliability_table",
    f"""WITH {SCORED_SQL}, b AS (SELECT *, (SELECT count(*) FROM range(1, 10) e(k) WHERE s.score > k * 0.1::DOUBLE) AS bin FROM s)
        SELECT bin, count(*) AS n, avg(score) AS mean_predicted, avg(label) AS observed FROM b GROUP BY bin""",
)
def _reliability(t: Tables):
    return evaluate.reliability(scored(t), "score", "label")


_MASKS_SQL = """m AS (SELECT 'open' AS subgroup, s.* FROM s WHERE l_linestatus = 'O' UNION ALL SELECT 'filled', s.* FROM s WHERE l_linestatus = 'F'
  UNION ALL SELECT 'small', s.* FROM s WHERE l_quantity < 3 UNION ALL SELECT 'none', s.* FROM s WHERE l_quantity < 0)"""


def masks():
    return {
        "open": F.col("l_linestatus") == "O", "filled": F.col("l_linestatus") == "F", "small": F.col("l_quantity") < 3,
        "none": F.col("l_quantity") < 0,
    }


@query(
    "subgroup_metrics",
    f"""WITH {SCORED_SQL}, {_MASKS_SQL}, {curve_sql('subgroup', 'score', 'm')},
        a AS (SELECT subgroup, sum(pos + neg) AS n, sum(pos) AS n_events, {_AUROC} AS first_auroc, {_AP} AS first_ap FROM c GROUP BY subgroup),
        {curve_sql('subgroup', 'other', 'm').replace('g AS', 'g2 AS', 1).replace('c AS (', 'c2 AS (', 1).replace('FROM g ', 'FROM g2 ')},
        b AS (SELECT subgroup, {_AUROC} AS second_auroc, {_AP} AS second_ap FROM c2 GROUP BY subgroup)
        SELECT subgroup, CAST(n AS BIGINT) AS n, CAST(n_events AS BIGINT) AS n_events, first_auroc, first_ap, second_auroc, second_ap, n_events / n * 100 AS prevalence_pct
        FROM a JOIN b USING (subgroup) WHERE n_events >= 10""",
)
def _subgroups(t: Tables):
    return evaluate.subgroup_metrics(scored(t), {"first": "score", "second": "other"}, "label", masks())


@query(
    "subgroup_roc",
    f"""WITH {SCORED_SQL}, {_MASKS_SQL}, {curve_sql('subgroup', 'score', 'm')}
        SELECT subgroup, score AS threshold, fp / n_neg AS fpr, tp / n_pos AS tpr FROM c
        WHERE n_pos >= 10 AND NOT coalesce(pos = next_pos AND neg = next_neg AND tp + fp > pos + neg, FALSE)
        UNION ALL SELECT DISTINCT subgroup, CAST('inf' AS DOUBLE), 0, 0 FROM c WHERE n_pos >= 10""",
)
def _subgroup_roc(t: Tables):
    return evaluate.subgroup_roc(scored(t), "score", "label", masks(), per_part=200)


@query(
    "model_comparison",
    f"""WITH {SCORED_SQL}, u AS (SELECT 'first' AS model, label, score FROM s UNION ALL SELECT 'second', label, other FROM s),
        {curve_sql('model', 'score', 'u')}, r AS (SELECT model, sum(pos + neg) AS n, sum(pos) AS p, {_AUROC} AS auroc, {_AP} AS pr_auc FROM c GROUP BY model)
        SELECT model, 'all lines' AS cohort, CAST(n AS BIGINT) AS n, CAST(p AS BIGINT) AS n_positive, auroc, pr_auc,
          (SELECT avg((score - label) ** 2) FROM u WHERE u.model = r.model) AS brier FROM r""",
)
def _comparison(t: Tables):
    return evaluate.summary(scored(t), {"first": "score", "second": "other"}, "label", "all lines")


@query(
    "published_digits",
    f"""WITH {SCORED_SQL}, {curve_sql('l_linestatus')}, r AS (SELECT l_linestatus, {_AUROC} AS auroc, {_AP} AS pr_auc FROM c GROUP BY l_linestatus)
        SELECT l_linestatus, CAST(round(CAST(auroc AS DECIMAL(30, 10)), 3) AS DOUBLE) AS auroc, CAST(round(CAST(pr_auc AS DECIMAL(30, 10)), 3) AS DOUBLE) AS pr_auc FROM r""",
)
def _published(t: Tables):
    metrics = evaluate.ranking_metrics(scored(t), "score", "label", ["l_linestatus"])
    named = metrics.select("l_linestatus", "auroc", F.col("average_precision").alias("pr_auc"))
    return round_columns(named, rules.PUBLISHED_DIGITS)


@query("bootstrap_interval")
def _bootstrap(t: Tables):
    return evaluate.bootstrap_interval(scored(t), "score", "label", n=1000)


@query(
    "percentile_interval",
    "SELECT count(l_discount) AS n, quantile_cont(l_discount, 0.025) AS lo, quantile_cont(l_discount, 0.975) AS hi FROM lineitem",
)
def _percentiles(t: Tables):
    """The exact interval of a column, through the bracketed quantiles that any number of rows can have."""
    from wardstone.operators.quantiles import exact_quantiles

    lines = t("lineitem")
    edges = exact_quantiles(lines, ["l_discount"], (0.025, 0.975))
    pick = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    n = lines.agg(F.count("l_discount")).first()[0]
    return edges.agg(F.lit(n).alias("n"), pick(0.025).alias("lo"), pick(0.975).alias("hi"))


COEFS = {"l_quantity": 0.25, "l_discount": -8.0, "l_tax": 4.0}
MEANS = {"l_quantity": 25.5, "l_discount": 0.05, "l_tax": 0.04}


@query(
    "linear_attribution",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS n, avg(abs({w!r}::DOUBLE * ({c} - {MEANS[c]!r}::DOUBLE))) AS mean_abs, "
        f"max({w!r}::DOUBLE * ({c} - {MEANS[c]!r}::DOUBLE)) AS largest FROM lineitem" for c, w in COEFS.items()
    ),
)
def _linear(t: Tables):
    parts = linear_attribution(t("lineitem"), "l_orderkey", COEFS, MEANS)
    return parts.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("attribution")).alias("mean_abs"), F.max("attribution").alias("largest")
    )


@query(
    "attribution_ranking",
    "SELECT feature, mean_abs FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(abs({w!r}::DOUBLE * ({c} - {MEANS[c]!r}::DOUBLE))) AS mean_abs FROM lineitem" for c, w in COEFS.items()
    ) + ") ORDER BY mean_abs DESC LIMIT 2",
)
def _ranking(t: Tables):
    return attribution_ranking(linear_attribution(t("lineitem"), "l_orderkey", COEFS, MEANS), 2)


# A given ensemble over three columns of a line item: (tree, node, feature, cut, left, right, value, weight).
COLUMNS = ("l_quantity", "l_discount", "l_tax")
GIVEN = ensemble.node_table([
    (0, 0, 0, 24.0, 1, 2, 0.0, 800.0), (0, 1, 1, 0.05, 3, 4, 0.0, 300.0), (0, 2, 0, 40.0, 5, 6, 0.0, 500.0),
    (0, 3, -1, 0.0, -1, -1, 0.5, 100.0), (0, 4, 2, 0.03, 7, 8, 0.0, 200.0), (0, 5, -1, 0.0, -1, -1, -0.25, 400.0),
    (0, 6, -1, 0.0, -1, -1, 1.0, 100.0), (0, 7, -1, 0.0, -1, -1, -1.0, 50.0), (0, 8, -1, 0.0, -1, -1, 0.125, 150.0),
    (1, 0, 2, 0.04, 1, 2, 0.0, 800.0), (1, 1, -1, 0.0, -1, -1, 0.25, 200.0), (1, 2, 0, 30.0, 3, 4, 0.0, 600.0),
    (1, 3, -1, 0.0, -1, -1, -0.5, 150.0), (1, 4, 1, 0.02, 5, 6, 0.0, 450.0), (1, 5, -1, 0.0, -1, -1, 0.75, 225.0),
    (1, 6, -1, 0.0, -1, -1, -0.125, 225.0), (2, 0, 1, 0.07, 1, 2, 0.0, 800.0), (2, 1, -1, 0.0, -1, -1, 0.5, 600.0),
    (2, 2, -1, 0.0, -1, -1, -0.375, 200.0),
])


def tree_sql(tree: int, known: Sequence[int]) -> str:
    """What a given tree yields where only the ``known`` features may be looked at: at the others both branches count by
    their weights."""
    nodes = {r.node: r for r in GIVEN[GIVEN["tree"] == tree].itertuples()}

    def say(at: int) -> str:
        n = nodes[at]
        if n.left < 0:
            return repr(n.value)
        left, right = say(n.left), say(n.right)
        if n.feature in known:
            return f"CASE WHEN {COLUMNS[n.feature]} <= {n.cut} THEN {left} ELSE {right} END"
        return f"({left} * {nodes[n.left].weight / n.weight} + {right} * {nodes[n.right].weight / n.weight})"

    return f"CAST({say(0)} AS DOUBLE)"


def _shapley_sql(feature: int) -> str:
    """All coalitions of the other two features, by their weights."""
    a, b = (f for f in range(3) if f != feature)
    gain = lambda s: " + ".join(f"({tree_sql(t, (*s, feature))} - {tree_sql(t, s)})" for t in range(3))
    return f"(({gain(())}) / 3 + ({gain((a,))}) / 6 + ({gain((b,))}) / 6 + ({gain((a, b))}) / 3)"


def _vectors(t: Tables):
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")).alias("line")
    returned = F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label")
    return t("lineitem").select(key, returned, *COLUMNS, array_to_vector(F.array(*COLUMNS)).alias("x"))


_STAGES = ", ".join(f"struct_pack(round := {k + 1}, score := {' + '.join(tree_sql(t, (0, 1, 2)) for t in range(k + 1))})" for k in range(3))


@query(
    "staged_auroc",
    f"""WITH s AS (SELECT label, e.round AS round, e.score AS score FROM (
  SELECT CAST(l_returnflag = 'R' AS INT) AS label, unnest([{_STAGES}]) AS e FROM lineitem)), {curve_sql('round')}
SELECT CAST(round AS INT) AS round, round({_AUROC}, 9) AS auroc FROM c GROUP BY round""",
)
def _staged(t: Tables):
    """AUROC of a given ensemble after each of its trees."""
    out = ensemble.staged_auroc(GIVEN, _vectors(t), "x", "label")
    return out.select("round", F.round("auroc", 9).alias("auroc"))


@query(
    "given_tree_attribution",
    " UNION ALL ".join(
        f"SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) AS line, '{c}' AS feature, round({_shapley_sql(i)}, 9) + 0 AS attribution FROM lineitem"
        for i, c in enumerate(COLUMNS)
    ),
)
def _given_attribution(t: Tables):
    """Shapley values of a given ensemble; the SQL goes through all coalitions of features."""
    out = explain.path_attribution(GIVEN, _vectors(t), "x", COLUMNS, "line")
    return out.select("line", "feature", (F.round("attribution", 9) + F.lit(0.0)).alias("attribution"))


@query(
    "attribution_points",
    f"""WITH a AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) AS line, l_discount, round({_shapley_sql(1)}, 9) + 0 AS attribution FROM lineitem)
SELECT line, 'l_discount' AS feature, l_discount AS value,
  round((l_discount - min(l_discount) OVER ()) / (max(l_discount) OVER () - min(l_discount) OVER ()), 9) + 0 AS share, attribution FROM a""",
)
def _points(t: Tables):
    """The table of a bee-swarm: attributions next to the values they belong to."""
    lines = _vectors(t)
    parts = explain.path_attribution(GIVEN, lines, "x", COLUMNS, "line")
    out = explain.attribution_points(parts, lines, "line", ["l_discount"])
    return out.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in ("share", "attribution")})


@query(
    "isotonic_calibration",
    f"""WITH {SCORED_SQL}, g AS (SELECT score, sum(label) AS pos, count(*) AS n FROM s GROUP BY score),
c AS (SELECT score, pos, n, sum(pos) OVER w AS p, sum(n) OVER w AS m, row_number() OVER w AS i FROM g WINDOW w AS (ORDER BY score)),
m AS (SELECT a.i AS a, b.i AS b, (b.p - a.p + a.pos) / CAST(b.m - a.m + a.n AS DOUBLE) AS mean FROM c a JOIN c b ON a.i <= b.i),
least AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS low FROM m)
SELECT score, max(low) AS calibrated FROM least JOIN c ON c.i = b GROUP BY score""",
)
def _isotonic(t: Tables):
    """The calibrated value of every score; the SQL is the greatest of the least means of runs around it."""
    rows = scored(t)
    curve = isotonic.Calibration.of(isotonic.isotonic_blocks(rows, "score", "label", per_part=50))
    return rows.select("score").distinct().select("score", curve(F.col("score")).alias("calibrated"))


_GIVEN_FITS = [([0.01, -2.0, 3.0], -1.0), ([0.0, 0.0, 0.0], -0.5), ([-0.02, 0.0, 1.5], 0.25)]
_MARGIN = lambda w, b: f"({' + '.join(f'{x} * {c}' for x, c in zip(w, COLUMNS))} + {b})"


@query(
    "fit_gradients",
    " UNION ALL ".join(
        f"""SELECT {f} AS fold, {m} AS model, {j} AS feature,
  round(avg((1 / (1 + exp(-{_MARGIN(w, b)})) - CAST(l_returnflag = 'R' AS INT)) * {x}), 7) + 0 AS gradient
FROM lineitem WHERE l_linenumber % 2 <> {f}"""
        for f in range(2) for m, (w, b) in enumerate(_GIVEN_FITS) for j, x in enumerate((*COLUMNS, "1.0"))
    ),
)
def _gradients(t: Tables):
    """Mean gradients of given fits over the rows outside their folds: what the certificates of a path rest on."""
    fold = (F.col("l_linenumber") % 2).alias("fold")
    rows = t("lineitem").select(fold, F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"), array_to_vector(F.array(*COLUMNS)).alias("x"))
    fits = [linear.Linear(np.array(w), b) for w, b in _GIVEN_FITS]
    out = linear.gradients(rows, "x", "label", "fold", {0: fits, 1: fits})
    return out.withColumn("gradient", F.round("gradient", 7) + F.lit(0.0))
