"""Batch answers about stint life: default conditions, strategy reports, wear curves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.functions.laps import fuel_load_at_age
from stintwise.operators import forest as RF
from stintwise.operators import life
from stintwise.operators import linear as M
from stintwise.operators.lookup import join_pinned, pin_small
from stintwise.settings import DEFAULTS, Settings
from stintwise.sources.dataset import export_lookups

COMPOUNDS = ("SOFT", "MEDIUM", "HARD")  # fixed values: what a request compares by default
LEVELS = ("pair", "circuit", "compound", "all")


def default_table(df: DataFrame, numeric: list[str], boolean: list[str]) -> DataFrame:
    """Usual value of each input per circuit and compound, per circuit, per compound and
    overall: the mean of a number, the commoner value of a flag (a tie is false).

    All laps count, valid or not. The rows are summed once, by (circuit, compound); the
    other levels come from those sums.
    """
    cells = df.groupBy("circuit", "tire_compound").agg(
        F.count("*").alias("n_rows"),
        *[F.sum(c).alias(f"_s_{c}") for c in numeric],
        *[F.count(c).alias(f"_n_{c}") for c in numeric],
        *[F.sum(F.when(F.col(c), 1).when(~F.col(c), -1)).alias(f"_v_{c}") for c in boolean],
    )
    grouped = cells.cube("circuit", "tire_compound").agg(
        F.grouping_id().alias("_g"),
        F.sum("n_rows").cast("long").alias("n_rows"),
        *[(F.sum(f"_s_{c}") / F.nullif(F.sum(f"_n_{c}"), F.lit(0))).alias(c) for c in numeric],
        *[(F.sum(f"_v_{c}") > 0).alias(c) for c in boolean],
    )
    level = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("_g").cast("int") + 1)
    return grouped.withColumn("level", level).drop("_g")


def with_defaults(
    requests: DataFrame, table: DataFrame, features: list[str], s: Settings = DEFAULTS
) -> DataFrame:
    """Requests with every feature: the request's own value where it has one, else the
    default of circuit and compound, else of the circuit; a circuit never seen falls to the
    compound and then to everything."""
    small, pinned = pin_small(table, s)
    values = F.struct(*features)

    def level(name: str, on: list[str]) -> DataFrame:
        return small.filter(F.col("level") == name).select(*on, values.alias(f"_{name}"))

    out = requests
    for name, on in (("pair", ["circuit", "tire_compound"]), ("circuit", ["circuit"]), ("compound", ["tire_compound"])):
        out = join_pinned(out, level(name, on), pinned, on)
    overall = small.filter(F.col("level") == "all").select(*features).first()
    types = {f.name: f.dataType for f in table.schema.fields}
    last = F.struct(*[F.lit(overall[c] if overall else None).cast(types[c]).alias(c) for c in features])
    chosen = F.coalesce("_pair", "_circuit", "_compound", last)
    out = out.withColumn("_d", chosen)
    given = set(requests.columns)
    return out.withColumns(
        {c: F.coalesce(F.col(c), F.col("_d")[c]) if c in given else F.col("_d")[c] for c in features}
    ).drop("_pair", "_circuit", "_compound", "_d")


def per_compound(requests: DataFrame, compounds=COMPOUNDS) -> DataFrame:
    """One row per request and compound, with its position in the request's list."""
    listed = F.col("compounds") if "compounds" in requests.columns else F.array(*map(F.lit, compounds))
    return requests.select("*", F.posexplode(listed).alias("pos", "tire_compound")).drop("compounds")


def circuit_report(
    model: M.CircuitModel, requests: DataFrame, defaults: DataFrame, s: Settings = DEFAULTS
) -> DataFrame:
    """Life, rate and caveats per request and compound from a circuit-aware model.

    Requests: request_id, circuit, track_temp_c, threshold_s, and optionally
    avg_corner_speed_kph to override the circuit's usual value.
    """
    asked = with_defaults(per_compound(requests), defaults, ["avg_corner_speed_kph"], s)
    asked = M.effective_rate(model, asked).withColumn("is_extrapolating", M.is_extrapolating(model))
    keys = ["request_id", "tire_compound"]
    scored = M.predict_circuit(model, life.sweep(asked, keys, life.half_lap_ages(s)))
    scored = scored.withColumn("used_global_fallback", ~F.col("has_own_fit"))
    keep = ("circuit", "pos", "rate_s_per_lap", "used_global_fallback", "is_extrapolating")
    out = life.crossing(scored, keys, F.col("threshold_s"), keep)
    return out.withColumnRenamed("tire_compound", "compound")


def forest_requests(
    model: RF.ForestModel, requests: DataFrame, defaults: DataFrame, s: Settings = DEFAULTS
) -> DataFrame:
    """Requests per compound with every input of the forest but the age. The request's
    track temperature and `wet` flag win over the defaults."""
    spec = model.spec
    fixed = {"tire_compound", "circuit", M.AGE, "fuel_load_estimate_kg"}
    needed = [c for c in spec.features if c not in fixed]
    asked = per_compound(requests)
    if "wet" in asked.columns and "is_raining" in needed:
        asked = asked.withColumn("is_raining", F.col("wet"))
    return with_defaults(asked, defaults, needed, s)


def age_inputs(model: RF.ForestModel, s: Settings = DEFAULTS) -> dict:
    """Inputs that follow from the swept age."""
    if "fuel_load_estimate_kg" in model.spec.features:
        return {"fuel_load_estimate_kg": lambda age: fuel_load_at_age(age, s)}
    return {}


def known_circuits(defaults: DataFrame) -> DataFrame:
    return defaults.filter((F.col("level") == "circuit") & F.col("circuit").isNotNull()).select("circuit")


def split_known(requests: DataFrame, defaults: DataFrame, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Requests for circuits the training data has, and the rejected rest."""
    seen, pinned = pin_small(known_circuits(defaults), s)
    flagged = join_pinned(requests, seen.withColumn("_known", F.lit(True)), pinned, ["circuit"])
    return flagged.filter("_known").drop("_known"), flagged.filter(F.col("_known").isNull()).drop("_known")


def wear_curves(
    model: RF.ForestModel, requests: DataFrame, defaults: DataFrame, s: Settings = DEFAULTS
) -> DataFrame:
    """One row per request, compound and whole age: rounded delta and thin-evidence flag."""
    known, _ = split_known(requests, defaults, s)
    asked = forest_requests(model, known, defaults, s)
    keys = ["request_id", "tire_compound"]
    swept = life.sweep(asked, keys, life.whole_lap_ages(s), age_inputs(model, s))
    scored = RF.predict_with_support(model, swept, s)
    return scored.withColumn("delta_s", F.round(M.PREDICTED, 3))


def curve_summary(curves: DataFrame) -> DataFrame:
    """Per request and compound: first age at the threshold, durable, sparse evidence."""
    keep = ("circuit", "track_temp_c", "threshold_s")
    return life.first_age_at(
        curves, ["request_id", "tire_compound"], F.col("threshold_s"), "low_support", keep
    ).withColumnRenamed("tire_compound", "compound")


def forest_report(
    model: RF.ForestModel, requests: DataFrame, defaults: DataFrame, s: Settings = DEFAULTS
) -> DataFrame:
    """Strategy report from the forest: crossing on half laps, support judged at age 1."""
    asked = forest_requests(model, requests, defaults, s)
    keys = ["request_id", "tire_compound"]
    by_age = age_inputs(model, s)
    lives = life.estimate_life(
        asked, keys, lambda d: RF.predict_forest(model, d), F.col("threshold_s"), by_age, ("circuit", "pos"), s
    )
    fresh = asked.withColumn(M.AGE, F.lit(1.0))
    for name, fn in by_age.items():
        fresh = fresh.withColumn(name, fn(F.col(M.AGE)))
    support = RF.leaf_support(model, fresh, keys, s)
    return lives.join(support, keys, "left").withColumnsRenamed(
        {"tire_compound": "compound", "low_support": "is_extrapolating"}
    )


def predictions_at(
    model: RF.ForestModel, requests: DataFrame, defaults: DataFrame, ages: list[int], s: Settings = DEFAULTS
) -> DataFrame:
    """Defaults in use and predictions at chosen ages, per request and compound."""
    asked = forest_requests(model, requests, defaults, s)
    at = F.array(*[F.lit(float(a)) for a in ages])
    return RF.predict_forest(
        model, life.sweep(asked, ["request_id", "tire_compound"], at, age_inputs(model, s))
    )


def max_age_by_circuit(df: DataFrame) -> DataFrame:
    return df.groupBy("circuit").agg(F.max(M.AGE).alias("max_age_laps"))


def beyond_observed(curves: DataFrame, ceilings: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Marks curve ages no lap of the circuit ever reached."""
    table, pinned = pin_small(ceilings, s)
    return join_pinned(curves, table, pinned, ["circuit"]).withColumn(
        "beyond_observed_age", F.coalesce(F.col(M.AGE) > F.col("max_age_laps"), F.lit(False))
    )


@dataclass(frozen=True)
class Exported:
    """What a scoring job reads instead of the laps."""

    model: RF.ForestModel
    defaults: DataFrame
    circuits: DataFrame
    max_age: DataFrame


def export_model(model: RF.ForestModel, records: DataFrame, path: str) -> None:
    """The model with the defaults of its inputs, the circuits it has seen and their oldest
    ages. The model's settings are written last, so a folder that loads is whole."""
    inputs = [c for c in model.spec.continuous if c not in (M.AGE, "fuel_load_estimate_kg")]
    export_lookups(records, default_table(records, inputs, list(model.spec.boolean)), path)
    RF.save(model, f"{path}/model")


def load_export(spark: SparkSession, path: str) -> Exported:
    read = {n: spark.read.parquet(f"{path}/{n}") for n in ("defaults", "circuits", "max_age")}
    return Exported(RF.load(spark, f"{path}/model"), **read)
