"""From an analytic table to a model matrix: splits, column kinds, imputation, scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame, functions as F

from wardstone.functions import sqltext
from wardstone.functions.sqltext import literal, name, number_or_null
from wardstone.operators.ordered import PER_PART, bucket_by_points, ranked, split_points
from wardstone.operators.quantiles import exact_quantiles


def shuffle_key(key: str, seed: int | str) -> Column:
    """A reproducible shuffle order: the md5 of ``key|seed``."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def _shuffled_rank(df: DataFrame, label: str, key: str, seed, digits: int) -> DataFrame:
    """Rank within the label in shuffled order. The leading hex digits of the hash are the buckets, so that a label
    held by most rows is still ranked by many tasks. Of more than three digits, the last three number the buckets of a
    group, so that no task orders all buckets of such a label either."""
    hashed = df.withColumn("_order", shuffle_key(key, seed))
    order = [F.col("_order").asc(), F.col(key).asc()]
    coarse = (lambda bucket: F.substring(bucket, 1, digits - 3)) if digits > 3 else None
    return ranked(hashed, [label], order, F.substring("_order", 1, digits), "_rank", "_size", coarse).drop("_order")


def _digits(rows: int, per_bucket: int = 250_000) -> int:
    """Hex digits that leave about ``per_bucket`` rows to a bucket."""
    digits = 1
    while 16**digits * per_bucket < rows:
        digits += 1
    return digits


def quotas(sizes: Mapping, fraction: float) -> dict:
    """Test rows per label: the total is rounded up and shared out by largest remainder."""
    total = sum(sizes.values())
    if not total:
        return dict.fromkeys(sizes, 0)
    wanted = -int(-(total * fraction) // 1)
    exact = {k: n * wanted / total for k, n in sizes.items()}
    out = {k: int(x) for k, x in exact.items()}
    by_remainder = sorted(exact, key=lambda k: (-(exact[k] - out[k]), -sizes[k], str(k)))
    for k in by_remainder[: wanted - sum(out.values())]:
        out[k] += 1
    return out


def stratified_split(
    df: DataFrame, label: str, key: str, fraction: float = 0.2, seed: int | str = 42, flag: str = "is_test",
    digits: int | None = None,
) -> DataFrame:
    """Mark an exact share of each label: ``flag`` is 1 for the held-out rows.

    Reads the label counts first (one row per label); the quotas then are constants of the plan.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    take = quotas(sizes, fraction)
    chain = F.when(F.lit(False), F.lit(0))  # an empty table has no label
    for value, quota in take.items():
        test = F.col(label).isNull() if value is None else F.col(label) == value
        chain = chain.when(test, F.lit(quota))
    out = _shuffled_rank(df, label, key, seed, digits or _digits(sum(sizes.values())))
    return out.withColumn(flag, F.when(F.col("_rank") <= chain.otherwise(F.lit(0)), 1).otherwise(0)).drop("_rank", "_size")


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int | str = 42, fold: str = "fold",
          digits: int | None = None) -> DataFrame:
    """Number ``k`` stratified folds 0..k-1 of equal size, up to one row per label."""
    out = _shuffled_rank(df, label, key, seed, digits or _digits(df.count()))
    return out.withColumn(fold, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_size")


def contiguous_folds(df: DataFrame, label: str, order: str, k: int = 5, fold: str = "fold", per_part: int = PER_PART) -> DataFrame:
    """Number ``k`` stratified folds without a shuffle: along ``order``, a unique number, each label's rows fall into
    ``k`` runs. Labels one after the other, by their first row, are dealt to the folds in turn, which gives the lengths
    of the runs; so folds differ by one row at most in all and per label.

    Rows are ranked in intervals of ``order``, never in one task; one row per label comes to the driver.
    """
    labels = df.groupBy(label).agg(F.min(order).alias("first"), F.count("*").alias("n")).orderBy("first").collect()
    before, chain = 0, F.lit(None).cast("int")
    for r in labels:
        dealt = lambda i, upto: (upto - i + k - 1) // k  # places below ``upto`` that are i modulo k
        ends, total = [], 0
        for i in range(k):
            total += dealt(i, before + r.n) - dealt(i, before)
            ends.append(total)
        number = F.lit(0)
        for end in ends[:-1]:
            number = number + F.when(F.col("_rank") > end, 1).otherwise(0)
        chain = F.when(F.col(label).eqNullSafe(F.lit(r[0])), number).otherwise(chain)
        before += r.n
    placed = bucket_by_points(df, order, split_points(df, order, per_part, unique=True), "_part")
    out = ranked(placed, [label], [F.col(order).asc()], F.col("_part"), "_rank", "_size")
    return out.withColumn(fold, chain.cast("int")).drop("_rank", "_size", "_part")


def group_end(year_group: str) -> Column:
    """Last year of a group written ``from - to``."""
    return F.regexp_extract(F.col(year_group), r"(\d{4})\s*$", 1).cast("int")


def temporal_split(df: DataFrame, year_group: str, last_train_year: int, flag: str = "is_test") -> DataFrame:
    """Split on a year group written ``from - to``: 1 if the group ends after ``last_train_year``."""
    return df.withColumn(flag, F.when(group_end(year_group) > last_train_year, 1).otherwise(0))


def column_kinds(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """(continuous, binary): binary columns hold nothing but 0, 1 and NULL. One aggregation, one row back."""
    found = df.agg(
        *[
            sqltext.column(f"max(CASE WHEN {number_or_null(c)} NOT IN (0D, 1D) THEN 1 END)", f"_{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    binary = [c for i, c in enumerate(columns) if found[i] is None]
    return [c for c in columns if c not in set(binary)], binary


def reconcile(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """The wanted columns as doubles, zero where the table lacks them, and the names that were lacking."""
    lacking = [c for c in columns if c not in df.columns]
    picked = [f"{'0D' if c in lacking else number_or_null(c)} AS {name(c)}" for c in columns]
    return df.selectExpr(*map(name, keep), *picked), lacking


def class_weights(df: DataFrame, label: str, ratio: float, weight: str = "weight") -> DataFrame:
    return df.withColumn(weight, F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))


@dataclass(frozen=True)
class Prep:
    """Fitted imputation and scaling; a few numbers per column, applied as column expressions."""

    continuous: list[str]
    binary: list[str]
    fills: dict[str, float]
    means: dict[str, float]
    sds: dict[str, float]

    @property
    def columns(self) -> list[str]:
        return [*self.continuous, *self.binary]

    def only(self, names: Sequence[str]) -> Prep:
        """The same numbers for some of the columns."""
        kept = set(names)
        return replace(self, continuous=[c for c in self.continuous if c in kept], binary=[c for c in self.binary if c in kept])

    def _filled(self, c: str) -> str:
        return f"coalesce({number_or_null(c)}, {literal(self.fills[c])})"

    def _scaled(self, c: str, filled: str) -> str:
        return f"({filled} - {literal(self.means[c])}) / {literal(self.sds[c] or 1.0)}"

    def impute(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: sqltext.column(self._filled(c)) for c in self.columns})

    def scale(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        """Standardised copies of imputed columns."""
        return df.withColumns({prefix + c: sqltext.column(self._scaled(c, name(c))) for c in self.columns})

    def matrix(self, df: DataFrame, keep: Sequence[str], raw: str = "raw", scaled: str = "scaled") -> DataFrame:
        """``keep`` plus the imputed and the scaled features as vectors, in column order."""
        filled = df.selectExpr(
            *map(name, keep),
            *[f"{self._filled(c)} AS {name(c)}" for c in self.columns],
            *[f"{self._scaled(c, self._filled(c))} AS {name('z_' + c)}" for c in self.columns],
        )
        for inputs, output in ((self.columns, raw), ([f"z_{c}" for c in self.columns], scaled)):
            filled = VectorAssembler(inputCols=inputs, outputCol=output).transform(filled)
        return filled.select(*keep, raw, scaled)

    def table(self, spark) -> DataFrame:
        rows = [(c, int(c in self.binary), self.fills[c], self.means[c], self.sds[c]) for c in self.columns]
        return spark.createDataFrame(rows, "feature string, is_binary int, fill double, mean double, sd double")


def fit_prep(train: DataFrame, continuous: Sequence[str], binary: Sequence[str]) -> Prep:
    """Medians, means and population deviations of the training rows; binary columns are filled with 0,
    a continuous column without any value too."""
    medians = {r.feature: r.value for r in exact_quantiles(train, continuous, (0.5,)).collect()} if continuous else {}
    fills = {c: float(medians.get(c, 0.0)) for c in continuous} | {c: 0.0 for c in binary}
    columns = [*continuous, *binary]
    filled = {c: f"coalesce({number_or_null(c)}, {literal(fills[c])})" for c in columns}
    # long rows: one aggregate of two functions; hundreds of them on a wide row make code that is only interpreted
    values = train.select(sqltext.column(f"posexplode(array({', '.join(filled.values())}))").alias("c", "v")) if columns else None
    found = values.groupBy("c").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).collect() if columns else []
    means, sds = dict.fromkeys(columns), dict.fromkeys(columns)  # no rows: no numbers
    for r in found:
        means[columns[r.c]], sds[columns[r.c]] = r["mean"], r["sd"]
    return Prep(list(continuous), list(binary), fills, means, sds)


def slice_features(df: DataFrame, vector: str, names: Sequence[str], output: str) -> DataFrame:
    """Pick features of an assembled vector by name, in the given order."""
    prefix = "z_" if vector == "scaled" else ""
    return VectorSlicer(inputCol=vector, outputCol=output, names=[prefix + n for n in names]).transform(df)
