"""Regression metrics and residual reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET = "lap_time_delta_s"
PREDICTED = "predicted"


def metrics(
    scored: DataFrame, by: list[str] | None = None, target: str = TARGET, predicted: str = PREDICTED
) -> DataFrame:
    """MAE, RMSE, R2 and row counts over rows with target and prediction, one aggregate.

    R2 is null where the target does not vary.
    """
    usable = F.col(target).isNotNull() & F.col(predicted).isNotNull()
    y = F.when(usable, F.col(target))
    r = y - F.col(predicted)
    n = F.count(r)
    spread = F.nullif(n * F.var_pop(y), F.lit(0.0))
    return scored.groupBy(*(by or [])).agg(
        F.avg(F.abs(r)).alias("mae"),
        F.sqrt(F.avg(r * r)).alias("rmse"),
        (1.0 - F.sum(r * r) / spread).alias("r2"),
        n.alias("n_samples"),
        F.count_if(~usable).alias("n_dropped"),
    )


def evaluate(scored: DataFrame, target: str = TARGET, predicted: str = PREDICTED):
    """The metrics as a row; an error when no row can be scored."""
    row = metrics(scored, None, target, predicted).first()
    if row.n_samples == 0:
        raise ValueError("no rows with both target and prediction")
    return row


def with_residual(scored: DataFrame, target: str = TARGET, predicted: str = PREDICTED) -> DataFrame:
    """Rows with target and prediction, and their difference."""
    return scored.filter(F.col(target).isNotNull() & F.col(predicted).isNotNull()).withColumn(
        "residual", F.col(target) - F.col(predicted)
    )


def residual_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    return (
        with_residual(scored)
        .groupBy(*by)
        .agg(
            F.avg("residual").alias("mean_residual"),
            F.stddev_samp("residual").alias("std_residual"),
            F.count("residual").alias("n_rows"),
        )
    )


def worst_residuals(scored: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The n largest residuals by size; `keys` settle ties."""
    return with_residual(scored).orderBy(F.abs("residual").desc(), *keys).limit(n)


def valid_rows(df: DataFrame) -> DataFrame:
    """Valid laps, or everything where no validity flag exists."""
    return df.filter("is_valid_lap") if "is_valid_lap" in df.columns else df


def training_rows(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows a fit may use: nothing required is null, and the lap is valid."""
    return valid_rows(df.dropna(subset=required))


def comparison(scored_by_model: dict[str, DataFrame], target: str = TARGET, predicted: str = PREDICTED) -> DataFrame:
    """Metrics per model over stacked predictions."""
    stacked = None
    for name, df in scored_by_model.items():
        one = df.select(F.lit(name).alias("model"), target, predicted)
        stacked = one if stacked is None else stacked.unionByName(one)
    return metrics(stacked, ["model"], target, predicted)
