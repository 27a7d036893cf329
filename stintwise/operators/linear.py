"""Least-squares wear models: per compound, with a pooled fit as fallback.

A fit is one pass of sums over the training rows, grouped by compound (and circuit, where
circuits must be counted), so it combines before it shuffles and its result is a few rows.
Scoring joins those rows back, broadcast because their size was checked, and falls back to
the pooled coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.operators.evaluate import PREDICTED, TARGET, training_rows
from stintwise.operators.lookup import join_pinned, pin_small
from stintwise.schema import require_columns
from stintwise.settings import DEFAULTS, Settings

COMPOUND, AGE, CIRCUIT = "tire_compound", "tire_age_laps", "circuit"
CIRCUIT_FEATURES = ("avg_corner_speed_kph", "track_temp_c")


@dataclass(frozen=True)
class Fit:
    """Coefficients per compound. `own` has one row per fitted compound, `pooled` holds the
    values for every other; `stats` the training statistics of the inputs."""

    own: DataFrame
    pinned: bool
    pooled: dict[str, float | None]
    names: tuple[str, ...]
    stats: dict[str, dict[str, float]] = field(default_factory=dict)

    def coefficients(self) -> DataFrame:
        return self.own.select(COMPOUND, *self.names)

    def attach(self, rows: DataFrame) -> DataFrame:
        """Rows with their coefficients, named as in `names`, and `has_own_fit`."""
        own = self.own.select(COMPOUND, *[F.col(n).alias(f"_own_{n}") for n in self.names])
        joined = join_pinned(rows, own.withColumn("_own", F.lit(True)), self.pinned, [COMPOUND])
        return joined.select(
            *rows.columns,
            *[F.coalesce(f"_own_{n}", F.lit(self.pooled[n]).cast("double")).alias(n) for n in self.names],
            F.coalesce("_own", F.lit(False)).alias("has_own_fit"),
        )


def _collect_fit(coefs: DataFrame, names: tuple[str, ...], s: Settings, stats=None) -> Fit:
    """Split a coefficient table into own fits and the pooled row."""
    small, pinned = pin_small(coefs, s)
    pooled = small.filter("is_pooled").first()
    own = small.filter(~F.col("is_pooled")).drop("is_pooled")
    values = {n: (pooled[n] if pooled is not None else None) for n in names}
    return Fit(own, pinned, values, names, stats or {})


# --- polynomials of tire age -------------------------------------------------------------


def _moments(rows: DataFrame, by: list[str], inputs: dict[str, Column]) -> DataFrame:
    """n, the means and the centred products (divided by n) of `inputs` per group: one pass, combined
    before it shuffles."""
    names = list(inputs)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        *[F.avg(c).alias(f"m_{n}") for n, c in inputs.items()],
        *[F.covar_pop(inputs[a], inputs[b]).alias(f"s_{a}{b}") for a, b in pairs],
    )


def _pooled_moments(cells: DataFrame, names: list[str]) -> DataFrame:
    """The moments of all rows from those of their groups: what lies within groups, and between
    their means. The laps are not read again."""
    every = Window.partitionBy()  # a row per group
    n = F.col("n_rows").cast("double")
    share = n / F.sum(n).over(every)
    means = cells.withColumns({f"_a_{k}": F.sum(F.col(f"m_{k}") * share).over(every) for k in names} | {"_share": share})
    off = lambda k: F.col(f"m_{k}") - F.col(f"_a_{k}")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return means.agg(
        F.sum("n_rows").alias("n_rows"),
        *[F.first(f"_a_{k}").alias(f"m_{k}") for k in names],
        *[F.sum(F.col("_share") * (F.col(f"s_{a}{b}") + off(a) * off(b))).alias(f"s_{a}{b}") for a, b in pairs],
    ).filter("n_rows > 0")


def polynomial_coefficients(train: DataFrame, degree: int) -> DataFrame:
    """b0, b1 (and b2) per compound and pooled, from centred moments in one pass over the laps;
    the pooled ones are merged from the compounds'."""
    if degree not in (1, 2):
        raise ValueError("degree must be 1 or 2")
    rows = training_rows(train, [TARGET, AGE, COMPOUND])
    x = F.col(AGE).cast("double")
    inputs = {"x": x, "y": F.col(TARGET)} if degree == 1 else {"x": x, "q": x * x, "y": F.col(TARGET)}
    cells = _moments(rows, [COMPOUND], inputs)
    pooled = _pooled_moments(cells, list(inputs)).withColumns({COMPOUND: F.lit(None).cast("string"), "is_pooled": F.lit(True)})
    moments = cells.withColumn("is_pooled", F.lit(False)).unionByName(pooled)
    c = F.col
    if degree == 1:
        slopes = {"b1": c("s_xy") / F.nullif(c("s_xx"), F.lit(0.0))}
    else:
        det = F.nullif(c("s_xx") * c("s_qq") - c("s_xq") * c("s_xq"), F.lit(0.0))
        slopes = {"b1": (c("s_xy") * c("s_qq") - c("s_qy") * c("s_xq")) / det, "b2": (c("s_qy") * c("s_xx") - c("s_xy") * c("s_xq")) / det}
    fitted = moments.withColumns(slopes)
    b0 = c("m_y") - c("b1") * c("m_x") - (c("b2") * c("m_q") if degree == 2 else F.lit(0.0))
    out = fitted.select(COMPOUND, "is_pooled", "n_rows", b0.alias("b0"), *slopes)
    # Too few rows, or an age that never varies, leave a compound without its own fit.
    return out.filter((F.col("n_rows") >= degree + 1) & F.col("b1").isNotNull())


def fit_per_group(df: DataFrame, by: list[str]) -> DataFrame:
    """Straight-line fits of every group and compound at once; groups that cannot be fitted
    stay, flagged."""
    x, y = F.col(AGE).cast("double"), F.col(TARGET)
    fitted = training_rows(df, [TARGET, AGE, COMPOUND]).groupBy(*by, COMPOUND).agg(
        F.count("*").alias("n_rows"), F.regr_intercept(y, x).alias("b0"), F.regr_slope(y, x).alias("b1")
    )
    return fitted.withColumn("is_fitted", (F.col("n_rows") >= 2) & F.col("b1").isNotNull())


def fit_polynomial(train: DataFrame, degree: int = 1, s: Settings = DEFAULTS) -> Fit:
    require_columns(train, (COMPOUND, AGE, TARGET))
    names = ("b0", "b1", "b2")[: degree + 1]
    fit = _collect_fit(polynomial_coefficients(train, degree), names, s)
    if fit.pooled["b0"] is None and fit.own.isEmpty():
        raise ValueError(f"not enough rows to fit degree {degree}")
    return fit


def predict_polynomial(fit: Fit, df: DataFrame) -> DataFrame:
    require_columns(df, (COMPOUND, AGE))
    a = F.col(AGE).cast("double")
    value = F.col(fit.names[-1])
    for name in reversed(fit.names[:-1]):
        value = value * a + F.col(name)
    return fit.attach(df).withColumn(PREDICTED, value).drop(*fit.names)


def fitted_curve(fit: Fit, train: DataFrame, points: int = 50) -> DataFrame:
    """Predictions at evenly spaced ages between each compound's youngest and oldest lap."""
    span = (
        training_rows(train, [TARGET, AGE, COMPOUND])
        .groupBy(COMPOUND)
        .agg(F.min(AGE).cast("double").alias("lo"), F.max(AGE).cast("double").alias("hi"))
    )
    steps = span.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    age = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(points - 1)
    return predict_polynomial(fit, steps.withColumn(AGE, age).drop("lo", "hi"))


# --- design-matrix fits ------------------------------------------------------------------


def feature_stats(rows: DataFrame, columns, s: Settings = DEFAULTS) -> dict[str, dict[str, float]]:
    """Mean, sample deviation (1 where it vanishes), min and max of each column, one pass."""
    row = feature_stats_row(rows, columns, s).first()
    return {c: {k: row[f"{c}_{k}"] for k in ("mean", "std", "lo", "hi")} for c in columns}


def feature_stats_row(rows: DataFrame, columns, s: Settings = DEFAULTS) -> DataFrame:
    aggs = []
    for c in columns:
        std = F.stddev_samp(c)
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            F.when(std > s.min_std, std).otherwise(1.0).alias(f"{c}_std"),
            F.min(c).cast("double").alias(f"{c}_lo"),
            F.max(c).cast("double").alias(f"{c}_hi"),
        ]
    return rows.agg(*aggs)


def standardised(c: str, stats: dict) -> Column:
    return (F.col(c) - F.lit(stats[c]["mean"])) / F.lit(stats[c]["std"])


def gram(rows: DataFrame, design: dict[str, Column], s: Settings = DEFAULTS, ranged: tuple[str, ...] = ()) -> DataFrame:
    """Sums of products of the design columns and the target, per compound and pooled.

    Summed by (compound, circuit) first, which also counts circuits without a distinct
    aggregate over the rows. Columns: n_rows, n_circuits, g_i_j (i <= j), h_i, and lo_c and hi_c
    of each column of `ranged`.
    """
    x = list(design.values())
    k = len(x)
    y = F.col(TARGET)
    cells = rows.groupBy(COMPOUND, CIRCUIT).agg(
        F.count("*").alias("n"),
        *[F.sum(x[i] * x[j]).alias(f"g_{i}_{j}") for i in range(k) for j in range(i, k)],
        *[F.sum(x[i] * y).alias(f"h_{i}") for i in range(k)],
        *[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in ranged for n, f in (("lo", F.min), ("hi", F.max))],
    )
    sums = [c for c in cells.columns if c[:2] in ("g_", "h_")]
    return cells.rollup(COMPOUND).agg(
        F.grouping(COMPOUND).cast("boolean").alias("is_pooled"),
        F.sum("n").cast("long").alias("n_rows"),
        F.count_distinct(CIRCUIT).alias("n_circuits"),
        *[F.sum(c).alias(c) for c in sums],
        *[f(f"{n}_{c}").alias(f"{n}_{c}") for c in ranged for n, f in (("lo", F.min), ("hi", F.max))],
    )


# Sums are taken about these places, near the middle of what occurs, so that moving them to the
# means, which are known only afterwards, loses few digits. Results do not depend on them.
ORIGIN = {AGE: 0.0, "avg_corner_speed_kph": 150.0, "track_temp_c": 35.0}


def plain_gram(rows: DataFrame, features: tuple[str, ...], s: Settings = DEFAULTS) -> DataFrame:
    """The Gram sums of 1, age, age x feature and feature before anything is standardised: one pass,
    from which both the statistics and every standardised Gram follow."""
    age = F.col(AGE).cast("double") - ORIGIN[AGE]
    f = [F.col(c).cast("double") - ORIGIN.get(c, 0.0) for c in features]
    columns = [F.lit(1.0), age, *[age * x for x in f], *f]
    return gram(rows, {str(i): c for i, c in enumerate(columns)}, s, (AGE, *features))


def plain_stats(pooled, features: tuple[str, ...], s: Settings = DEFAULTS) -> dict[str, dict[str, float]]:
    """The values of `feature_stats` for age and the features, from the pooled row of `plain_gram`."""
    out = {}
    for c, i in zip((AGE, *features), (1, *range(2 + len(features), 2 + 2 * len(features)))):
        n, total, lo, hi = pooled["n_rows"], pooled[f"g_0_{i}"], pooled[f"lo_{c}"], pooled[f"hi_{c}"]
        varies = n > 1 and lo < hi
        std = np.sqrt(max(0.0, pooled[f"g_{i}_{i}"] - total * total / n) / (n - 1)) if varies else 0.0
        out[c] = {"mean": ORIGIN.get(c, 0.0) + total / n, "std": float(std) if std > s.min_std else 1.0, "lo": lo, "hi": hi}
    return out


def standardising(stats: dict, features: tuple[str, ...], scaled_age: bool) -> np.ndarray:
    """The matrix that turns the columns of `plain_gram` into 1, age, age x z(feature), z(feature)."""
    k = len(features)
    t = np.zeros((2 + 2 * k, 2 + 2 * k))
    m, w = (stats[AGE]["mean"], stats[AGE]["std"]) if scaled_age else (0.0, 1.0)
    m -= ORIGIN[AGE]
    t[0, 0] = 1.0
    t[1, :2] = -m / w, 1.0 / w
    for i, f in enumerate(features):
        c, v = stats[f]["mean"] - ORIGIN.get(f, 0.0), stats[f]["std"]
        product, single = 2 + i, 2 + k + i
        t[single, [0, single]] = -c / v, 1.0 / v
        t[product, [0, 1, product, single]] = m * c / (w * v), -c / (w * v), 1.0 / (w * v), -m / (w * v)
    return t


def solve(grams: DataFrame, names: tuple[str, ...], alphas: tuple[float, ...] = (0.0,), change: np.ndarray | None = None) -> DataFrame:
    """Coefficients of each Gram row at each penalty; the first column is never penalised. With
    `change` the columns are turned by that matrix first.

    The systems are as wide as the design. A singular one takes its minimum-norm solution.
    """
    k = len(names)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                g = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        g[i, j] = g[j, i] = getattr(row, f"g_{i}_{j}")
                h = np.array([getattr(row, f"h_{i}") for i in range(k)])
                if change is not None:
                    g, h = change @ g @ change.T, change @ h
                for alpha in alphas:
                    ridge = np.diag([0.0] + [alpha] * (k - 1))
                    beta = np.linalg.pinv(g + ridge, rcond=1e-12, hermitian=True) @ h
                    out.append((getattr(row, COMPOUND), row.is_pooled, row.n_rows, row.n_circuits, alpha, *beta))
            yield pd.DataFrame(out, columns=[COMPOUND, "is_pooled", "n_rows", "n_circuits", "alpha", *names])

    schema = f"{COMPOUND} string, is_pooled boolean, n_rows long, n_circuits long, alpha double, " + ", ".join(
        f"{n} double" for n in names
    )
    return grams.mapInPandas(batches, schema)


@dataclass(frozen=True)
class CircuitModel:
    """Wear rate that depends on circuit conditions: intercept, age, age x feature, feature."""

    fit: Fit
    scaled_age: bool
    alpha: float = 0.0

    @property
    def stats(self):
        return self.fit.stats


NAMES = ("intercept", "age", "age_x_speed", "age_x_temp", "speed", "temp")


def circuit_design(stats: dict, scaled_age: bool) -> dict[str, Column]:
    age = standardised(AGE, stats) if scaled_age else F.col(AGE).cast("double")
    z = [standardised(f, stats) for f in CIRCUIT_FEATURES]
    columns = [F.lit(1.0), age, age * z[0], age * z[1], z[0], z[1]]
    return dict(zip(NAMES, columns))


def circuit_training(train: DataFrame) -> DataFrame:
    require_columns(train, (COMPOUND, AGE, TARGET, CIRCUIT, *CIRCUIT_FEATURES))
    return training_rows(train, [TARGET, AGE, COMPOUND, *CIRCUIT_FEATURES])


def has_enough(s: Settings = DEFAULTS) -> Column:
    return (F.col("n_rows") >= s.min_rows_own_fit) & (F.col("n_circuits") >= s.min_circuits_own_fit)


def circuit_gram(train: DataFrame, stats: dict, scaled_age: bool, s: Settings = DEFAULTS) -> DataFrame:
    return gram(circuit_training(train), circuit_design(stats, scaled_age), s)


def fit_circuit_models(
    train: DataFrame, alphas: tuple[float, ...] | None = None, s: Settings = DEFAULTS
) -> list[CircuitModel]:
    """One model per penalty, all from the same Gram sums, in one pass over the rows; without
    penalties, plain least squares on unscaled age. A compound on too few rows or circuits takes
    the pooled fit."""
    if alphas is not None and any(a < 0 for a in alphas):
        raise ValueError("a penalty must not be negative")
    scaled = alphas is not None
    grams, _ = pin_small(plain_gram(circuit_training(train), CIRCUIT_FEATURES, s), s)
    pooled = grams.filter("is_pooled").first()
    if pooled is None or not pooled.n_rows:
        raise ValueError("no usable training rows")
    if pooled.n_circuits < s.min_circuits_own_fit:
        raise ValueError(f"{pooled.n_circuits} circuits in training, need {s.min_circuits_own_fit}")
    stats = plain_stats(pooled, CIRCUIT_FEATURES, s)
    change = standardising(stats, CIRCUIT_FEATURES, scaled)
    solved = solve(grams.filter(F.col("is_pooled") | has_enough(s)), NAMES, alphas if scaled else (0.0,), change)
    kept, _ = pin_small(solved, s)
    return [
        CircuitModel(_collect_fit(kept.filter(F.col("alpha") == a), NAMES, s, stats), scaled, a)
        for a in (alphas if scaled else (0.0,))
    ]


def fit_circuit_aware(train: DataFrame, s: Settings = DEFAULTS) -> CircuitModel:
    return fit_circuit_models(train, None, s)[0]


def fit_ridge(train: DataFrame, alpha: float = 1.0, s: Settings = DEFAULTS) -> CircuitModel:
    return fit_circuit_models(train, (alpha,), s)[0]


def predict_circuit(model: CircuitModel, df: DataFrame) -> DataFrame:
    """Adds `predicted`, null where an input is missing, and `has_own_fit`."""
    require_columns(df, (COMPOUND, AGE, *CIRCUIT_FEATURES))
    design = circuit_design(model.stats, model.scaled_age)
    attached = model.fit.attach(df.withColumns({f"_x_{n}": c for n, c in design.items()}))
    value = sum((F.col(n) * F.col(f"_x_{n}") for n in NAMES), F.lit(0.0))
    return attached.withColumn(PREDICTED, value).select(*df.columns, "has_own_fit", PREDICTED)


def predict_ridge_sweep(models: list[CircuitModel], df: DataFrame) -> DataFrame:
    """Every row scored at every penalty, `alpha`; the models share their statistics.

    The coefficients of all penalties travel as one array per compound, so the rows are
    joined once."""
    first = models[0]
    design = circuit_design(first.stats, first.scaled_age)

    def bundle(pick) -> Column:
        return F.array(*[F.struct(F.lit(m.alpha).alias("alpha"), *pick(m)) for m in models])

    own = None
    for i, m in enumerate(models):
        part = m.fit.own.select(COMPOUND, F.struct(*NAMES).alias(f"_m{i}"))
        own = part if own is None else own.join(part, COMPOUND, "full")
    pooled = [F.struct(*[F.lit(m.fit.pooled[n]).alias(n) for n in NAMES]) for m in models]
    rows = df.withColumns({f"_x_{n}": c for n, c in design.items()})
    joined = join_pinned(rows, own, first.fit.pinned, [COMPOUND])
    each = bundle(lambda m: [F.coalesce(F.col(f"_m{models.index(m)}"), pooled[models.index(m)]).alias("b")])
    value = sum((F.col("_e.b")[n] * F.col(f"_x_{n}") for n in NAMES), F.lit(0.0))
    return joined.withColumn("_e", F.explode(each)).select(
        *df.columns, F.col("_e.alpha").alias("alpha"), value.alias(PREDICTED)
    )


def is_extrapolating(model: CircuitModel) -> Column:
    """A circuit feature lies outside its training range."""
    outside = F.lit(False)
    for f in CIRCUIT_FEATURES:
        lo, hi = model.stats[f]["lo"], model.stats[f]["hi"]
        outside = outside | F.coalesce((F.col(f) < lo) | (F.col(f) > hi), F.lit(False))
    return outside


def extrapolation_summary(model: CircuitModel, df: DataFrame) -> DataFrame:
    """How many rows lie outside the training range, and how far: one row per feature."""
    aggs = []
    for f in CIRCUIT_FEATURES:
        lo, hi = model.stats[f]["lo"], model.stats[f]["hi"]
        out = F.when((F.col(f) < lo) | (F.col(f) > hi), F.col(f))
        aggs.append(
            F.struct(
                F.lit(f).alias("feature"), F.lit(lo).alias("train_lo"), F.lit(hi).alias("train_hi"),
                F.count(out).alias("n_outside"), F.min(out).alias("outside_lo"), F.max(out).alias("outside_hi"),
            )
        )
    return df.agg(F.array(*aggs).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def effective_rate(model: CircuitModel, df: DataFrame, out: str = "rate_s_per_lap") -> DataFrame:
    """Seconds per lap at the row's compound and circuit conditions."""
    z = [standardised(f, model.stats) for f in CIRCUIT_FEATURES]
    rate = F.col("age") + F.col("age_x_speed") * z[0] + F.col("age_x_temp") * z[1]
    if model.scaled_age:
        rate = rate / F.lit(model.stats[AGE]["std"])
    return model.fit.attach(df).withColumn(out, rate).select(*df.columns, out)


SINGLE = ("intercept", "age_std", "age_std_x_f", "f_std")


def fit_single_feature(train: DataFrame, feature: str, s: Settings = DEFAULTS) -> DataFrame:
    """Per compound: intercept, z(age), z(age)·z(feature), z(feature), with age scaled by the
    compound's own mean and population deviation. No pooled fallback.

    Fitted on unscaled age and converted: the two designs span the same space.
    """
    table, _ = pin_small(plain_gram(circuit_training(train), (feature,), s), s)
    pooled = table.filter("is_pooled").first()
    if pooled is None or not pooled.n_rows:
        raise ValueError("no usable training rows")
    stats = plain_stats(pooled, (feature,), s)
    grams = table.filter(~F.col("is_pooled") & has_enough(s))
    scale = grams.select(
        COMPOUND,
        (F.col("g_0_1") / F.col("n_rows")).alias("age_mean"),
        F.sqrt(F.greatest(F.col("g_1_1") / F.col("n_rows") - F.pow(F.col("g_0_1") / F.col("n_rows"), 2), F.lit(0.0))).alias("age_scale"),
    )
    raw = solve(grams, ("r0", "r1", "r2", "r3"), change=standardising(stats, (feature,), False)).join(F.broadcast(scale), COMPOUND)
    m, w = F.col("age_mean"), F.col("age_scale")
    return raw.select(
        COMPOUND,
        "n_rows",
        m,
        w,
        F.lit(stats[feature]["mean"]).alias("f_mean"),
        F.lit(stats[feature]["std"]).alias("f_scale"),
        (F.col("r0") + F.col("r1") * m).alias("intercept"),
        (F.col("r1") * w).alias("age_std"),
        (F.col("r2") * w).alias("age_std_x_f"),
        (F.col("r3") + F.col("r2") * m).alias("f_std"),
    )


def predict_single_feature(coefs: DataFrame, feature: str, df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    table, pinned = pin_small(coefs.drop("n_rows"), s)
    u = F.coalesce((F.col(AGE) - F.col("age_mean")) / F.nullif("age_scale", F.lit(0.0)), F.lit(0.0))  # one age: no slope
    f = (F.col(feature) - F.col("f_mean")) / F.col("f_scale")
    value = F.col("intercept") + F.col("age_std") * u + F.col("age_std_x_f") * u * f + F.col("f_std") * f
    joined = join_pinned(df, table, pinned, [COMPOUND])
    return joined.withColumn(PREDICTED, value).select(*df.columns, PREDICTED)


def compound_means(train: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return training_rows(train, [TARGET]).groupBy(COMPOUND).agg(F.avg(TARGET).alias(PREDICTED))


def predict_compound_mean(train: DataFrame, df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The trivial model: a compound's mean delta; unseen compounds stay null."""
    table, pinned = pin_small(compound_means(train, s).filter(F.col(COMPOUND).isNotNull()), s)
    return join_pinned(df, table, pinned, [COMPOUND])
