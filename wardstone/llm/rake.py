"""Mixing sources to target weights by iterative proportional fitting.

Only DataFrame functions. Tokens are added up per cell (source, language, topic); the cell weights are then raked: in
turn, each margin is scaled to its target, for a fixed number of sweeps. Cells give their tokens at most: what a full cell
cannot give is asked of the others of its category, and targets are within what a category has, so the budget is met;
where the margins contradict each other in what is left, ``margins_reached`` shows by how much. A document is taken with the probability that
its cell's weight asks for, decided by a hash of its id, so that a run repeats.

Documents are read once for the cells and once for the sample, in which they meet their cell's probability by a join on
the cell: the cell side is aggregated, the document side is narrow until Spark has split hot cells. Cells come from
``groupBy``, which combines before the exchange, and are raked with windows over the small cell table; no cell table,
margin or document passes the driver. Very long texts only add to their cell's tokens.

Null source, language or topic is a category of its own. A document without words weighs nothing and is taken with its
cell's probability (0 where the whole cell is empty). Null ids are decided by the text. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstone.llm.line_rules import words_of
from wardstone.session import cut_lineage
from wardstone.llm.columns import any_names

MARGINS = ("source", "lang", "topic")
FILLS = 8
# A text's topic is the first of these whose wording it holds; the rest is "general".
TOPICS = {
    "licence": ("license", "licence", "rights reserved", "copyright"),
    "contact": ("@", "http://", "https://", "www."),
    "table": (" | ",),
}


@dataclass(frozen=True)
class Mix:
    """``targets``: of a margin, the share each category shall have; a margin without an entry gets its own shares to
    the power ``temper``, made to add up to one. ``budget``: tokens to take, as a share of all. ``sweeps``: over all
    margins."""

    targets: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    temper: float = 0.7
    budget: float = 0.8
    sweeps: int = 12
    seed: str = "mix-1"


def topic_of(text: Column) -> Column:
    low, found = F.lower(F.coalesce(text, F.lit(""))), F
    for name, phrases in TOPICS.items():
        test = F.lit(False)
        for phrase in phrases:
            test = test | low.contains(phrase)
        found = found.when(test, name)
    return found.otherwise("general")


def n_tokens(text: Column) -> Column:
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("long")


def draw(seed: str) -> Column:
    """A number in [0, 1) from the document's id."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(seed + "|"), name)), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**12))


def _category(margin: str) -> Column:
    return F.coalesce(F.col(margin), F.lit("(none)"))


def _with_cells(docs: DataFrame) -> DataFrame:
    cell = F.struct(_category("source").alias("source"), _category("lang").alias("lang"), topic_of(F.col("text")).alias("topic"))
    return docs.withColumn("_cell", cell).withColumn("_tokens", n_tokens(F.col("text")))


def margin_targets(cells: DataFrame, margin: str, mix: Mix) -> DataFrame:
    """margin, own, target: tokens that each category has and shall have, all together ``budget`` of the corpus. No
    category can give more than it has: what one lacks goes to the others by their shares, again and again."""
    own = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("own"))
    if margin in mix.targets:
        wanted = F.create_map(*(F.lit(x) for kv in mix.targets[margin].items() for x in kv)) if mix.targets[margin] else None
        share = F.lit(0.0) if wanted is None else F.coalesce(wanted[F.col(margin)], F.lit(0.0)).cast("double")
    else:
        share = F.pow("own", F.lit(mix.temper))
    # where a share is given, nothing else can fill up what its category lacks
    out, every = own.withColumns({"share": share, "target": F.lit(0.0)}), Window.partitionBy()
    for _ in range(FILLS):
        open_share = F.when(F.col("target") < F.col("own"), F.col("share")).otherwise(0.0)
        left = F.lit(mix.budget) * F.sum("own").over(every) - F.sum("target").over(every)
        more = F.coalesce(left * open_share / F.nullif(F.sum(open_share).over(every), F.lit(0.0)), F.lit(0.0))
        out = out.withColumn("target", F.least(F.col("own"), F.col("target") + more))
    return out.select(margin, "own", "target")


def raked(cells: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with their weight, tokens at most. To lower a margin's category all its
    cells are scaled; to raise it only those that are not full, up to their tokens, and later sweeps share out what is
    still missing. A category without target gets no weight."""
    cells = cut_lineage(cells)
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m in MARGINS:
        out = out.join(margin_targets(cells, m, mix).select(m, F.col("target").alias(f"to_{m}")), m)
    for sweep in range(mix.sweeps):
        for m in MARGINS:
            own, w, to = Window.partitionBy(m), F.col("weight"), F.col(f"to_{m}")
            full = F.col("weight") >= F.col("tokens")
            now, fixed = F.sum("weight").over(own), F.sum(F.when(full, w).otherwise(0.0)).over(own)
            less = F.coalesce(to / F.nullif(now, F.lit(0.0)), F.lit(0.0))
            more = F.coalesce((to - fixed) / F.nullif(now - fixed, F.lit(0.0)), F.lit(1.0))
            factor = F.when(to <= now, less).when(full, 1.0).otherwise(more)
            out = out.withColumn("weight", F.least(F.col("tokens").cast("double"), w * factor))
        if sweep % 3 == 2:
            out = cut_lineage(out)
    return out.select(*MARGINS, "tokens", "weight")


def margins_reached(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(margin, category, own, target, expected): tokens of each category, asked for, and expected in the sample."""
    cells = cut_lineage(cell_tokens(_with_cells(docs)))
    weights = cut_lineage(raked(cells, mix))
    found = None
    for m in MARGINS:
        got = weights.groupBy(m).agg(F.sum("weight").alias("expected")).join(margin_targets(cells, m, mix), m)
        got = got.select(F.lit(m).alias("margin"), F.col(m).alias("category"), "own", "target", "expected")
        found = got if found is None else found.union(got)
    return found


def cell_tokens(placed: DataFrame) -> DataFrame:
    return placed.groupBy("_cell").agg(F.sum("_tokens").alias("tokens")).select("_cell.*", "tokens")


def calibrated(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``docs`` plus the struct ``_mix``: source, lang, topic, n_tokens, probability, sampled."""
    placed = _with_cells(docs)
    odds = raked(cell_tokens(placed), mix).select(
        F.struct(*MARGINS).alias("_cell"),
        F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") / F.col("tokens"))).otherwise(0.0).alias("_odds"),
    )
    joined = placed.join(odds, "_cell")
    return joined.select(*docs.columns, F.struct(
        *(F.col("_cell")[m].alias(m) for m in MARGINS), F.col("_tokens").alias("n_tokens"),
        F.col("_odds").alias("probability"), (draw(mix.seed) < F.col("_odds")).alias("sampled"),
    ).alias("_mix"))


@any_names
def sample(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    return calibrated(docs, mix).where("_mix.sampled").drop("_mix")


def report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per document: its cell, its probability and whether it is taken."""
    out = calibrated(docs.select("doc_id", "text", "source", "lang"), mix)
    m = F.col("_mix")
    return out.select("doc_id", *(m[c].alias(c) for c in MARGINS), m["n_tokens"].alias("n_tokens"),
                      F.round(m["probability"], 8).alias("probability"), m["sampled"].alias("sampled"))


def sql(mix: Mix = Mix(), source: str = "documents") -> str:
    """The report as DuckDB SQL, sweep by sweep, for a mix without given targets."""
    topic = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(text), '{p}')" for p in phrases) + f" THEN '{name}'"
        for name, phrases in TOPICS.items()) + " ELSE 'general' END"
    steps, last = [], "w0"
    for i in range(mix.sweeps):
        for m in MARGINS:
            steps.append(f"""w{i}_{m} AS MATERIALIZED (SELECT * REPLACE (least(tokens, weight * CASE
  WHEN to_{m} <= now THEN coalesce(to_{m} / nullif(now, 0), 0) WHEN weight >= tokens THEN 1 ELSE coalesce((to_{m} - fixed) / nullif(now - fixed, 0), 1) END)
  AS weight) FROM (SELECT * EXCLUDE (now, fixed), sum(weight) OVER (PARTITION BY {m}) AS now,
    sum(CASE WHEN weight >= tokens THEN weight ELSE 0 END) OVER (PARTITION BY {m}) AS fixed FROM {last}))""")
            last = f"w{i}_{m}"
    fills = []
    for m in MARGINS:
        fills.append(f"t_{m}_0 AS (SELECT {m}, CAST(sum(tokens) AS DOUBLE) AS own, pow(sum(tokens), {mix.temper}) AS share, 0.0::DOUBLE AS target FROM c0 GROUP BY {m})")
        for i in range(FILLS):
            open_share = "CASE WHEN target < own THEN share ELSE 0 END"
            fills.append(
                f"t_{m}_{i + 1} AS MATERIALIZED (SELECT {m}, own, share, least(own, target + coalesce(({mix.budget} * sum(own) OVER () - sum(target) OVER ()) "
                f"* {open_share} / nullif(sum({open_share}) OVER (), 0), 0)) AS target FROM t_{m}_{i})")
    targets = ",\n".join(fills)
    joined = " ".join(f"JOIN (SELECT {m}, target AS to_{m} FROM t_{m}_{FILLS}) USING ({m})" for m in MARGINS)
    draws = f"CAST('0x' || substr(md5('{mix.seed}|' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 12) AS BIGINT) / pow(16, 12)"
    steps_sql = ",\n".join(steps)
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, {topic} AS topic,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens, {draws} AS u FROM {source}),
c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS weight
        FROM d GROUP BY source, lang, topic),
{targets},
w0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS now, 0.0::DOUBLE AS fixed FROM c0 {joined}),
{steps_sql},
p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, weight / tokens) ELSE 0 END AS odds FROM {last})
SELECT doc_id, source, lang, topic, n_tokens, round(odds, 8) AS probability, u < odds AS sampled
FROM d JOIN p USING (source, lang, topic)"""
