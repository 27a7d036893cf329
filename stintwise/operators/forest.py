"""Random-forest wear model, with the training evidence behind each prediction.

The inputs are encoded by Spark ML and the trees grown over sums by cell (`growth`); their nodes are
kept as a table (`nodes`), by which rows are scored, leaf support is looked up and shallower or
smaller forests are compared without fitting them.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.operators import growth as G
from stintwise.operators import nodes as N
from stintwise.operators.evaluate import PREDICTED, TARGET, metrics, training_rows
from stintwise.operators.lookup import settle
from stintwise.schema import require_columns
from stintwise.settings import DEFAULTS, Settings

# The default inputs, and those of the exported model.
CATEGORICAL = ("tire_compound", "circuit")
CONTINUOUS = ("tire_age_laps", "track_temp_c", "air_temp_c", "fuel_load_estimate_kg")
BOOLEAN = ("is_raining",)
EXPORT_CONTINUOUS = (
    "tire_age_laps", "track_temp_c", "air_temp_c",
    "avg_braking_decel_ms2", "peak_braking_decel_ms2", "avg_throttle_pct",
)
MAX_DEPTH = 30  # deepest tree Spark ML grows; stands for "no limit"


@dataclass(frozen=True)
class ForestSpec:
    categorical: tuple[str, ...] = CATEGORICAL
    continuous: tuple[str, ...] = CONTINUOUS
    boolean: tuple[str, ...] = BOOLEAN
    trees: int = 300
    depth: int | None = 10
    min_leaf: int = 5
    seed: int = 42
    bins: int = 64  # thresholds per input: every whole age and every fuel step has its own
    memory_mb: int = 512  # sums that a task holds in one pass over the rows

    @property
    def features(self) -> tuple[str, ...]:
        return self.categorical + self.continuous + self.boolean


@dataclass(frozen=True)
class ForestModel:
    spec: ForestSpec
    encoder: PipelineModel
    nodes: DataFrame  # as `nodes.node_table`, with the training rows that end at each
    parts: list[N.Pass]  # the same, as tasks read it

    @property
    def leaf_rows(self) -> DataFrame:
        """Training rows per (tree, leaf)."""
        leaves = self.nodes.filter(F.col("left").isNull())
        return leaves.select("tree", F.col("node").alias("leaf"), F.col("rows").alias("leaf_rows"))


def _numbers(df: DataFrame, spec: ForestSpec) -> DataFrame:
    """The inputs under private names, nulls replaced: rows that lack one are masked later."""
    return df.withColumns(
        {f"_in_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in spec.categorical}
        | {f"_in_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in spec.continuous + spec.boolean}
    )


def _stages(spec: ForestSpec) -> list:
    """Categories seen in training become indicator columns; an unseen one sets none, since
    the extra "unknown" slot is the one the encoder drops."""
    cats = [f"_in_{c}" for c in spec.categorical]
    index = [f"_ix_{c}" for c in spec.categorical]
    hot = [f"_hot_{c}" for c in spec.categorical]
    rest = [f"_in_{c}" for c in spec.continuous + spec.boolean]
    return [
        StringIndexer(inputCols=cats, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=hot + rest, outputCol="_vector"),
        RandomForestRegressor(
            featuresCol="_vector",
            labelCol=TARGET,
            predictionCol=PREDICTED,
            numTrees=spec.trees,
            maxDepth=spec.depth or MAX_DEPTH,
            minInstancesPerNode=spec.min_leaf,
            maxBins=spec.bins,
            maxMemoryInMB=spec.memory_mb,
            featureSubsetStrategy="all",
            seed=spec.seed,
        ),
    ]


def training_frame(train: DataFrame, spec: ForestSpec) -> DataFrame:
    require_columns(train, (*spec.features, TARGET))
    rows = training_rows(train, [*spec.features, TARGET])
    return _numbers(rows, spec).select(*[f"_in_{c}" for c in spec.features], TARGET)


def dealt(frame: DataFrame) -> DataFrame:
    """The rows of a fit, evenly over all cores and written: every input's thresholds are found in them."""
    return settle(frame.repartition(frame.sparkSession.sparkContext.defaultParallelism))


def encode(encoder: PipelineModel, rows: DataFrame, keep: list) -> DataFrame:
    """`keep` with the inputs as the vector of a fit and as the array of the node table."""
    return encoder.transform(rows).select(*keep, "_vector", vector_to_array("_vector").alias(N.FEATURES))


def drawn(frame: DataFrame, spec: ForestSpec) -> tuple[PipelineModel, G.Design, DataFrame]:
    """The encoder of the rows, their bins, and what each tree of the forest draws of them."""
    encoder = Pipeline(stages=_stages(spec)[:-1]).fit(frame)
    indexed = encoder.stages[0].transform(frame)
    labels = {f"_ix_{c}": len(seen) for c, seen in zip(spec.categorical, encoder.stages[0].labelsArray)}
    design = G.design(indexed, labels, [f"_in_{c}" for c in spec.continuous + spec.boolean], TARGET, spec.bins)
    return encoder, design, G.drawn_sums(indexed, design, TARGET, spec.trees, spec.seed)


def fitted(frame: DataFrame, spec: ForestSpec, support: bool = True) -> tuple[PipelineModel, DataFrame]:
    encoder, design, sums = drawn(frame, spec)
    return encoder, G.grow(sums, design, spec.trees, spec.depth or MAX_DEPTH, spec.min_leaf, support)


def fit_forest(train: DataFrame, spec: ForestSpec = ForestSpec(), s: Settings = DEFAULTS) -> ForestModel:
    """Fit, and count the training rows in every leaf."""
    encoder, table = fitted(dealt(training_frame(train, spec)), spec)
    return ForestModel(spec, encoder, table, N.runs(table))


def is_complete(spec: ForestSpec) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in spec.features])


def predict_with_support(model: ForestModel, df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Adds `predicted`, `avg_leaf_rows`, the mean number of training rows in the leaves a row falls
    in, and whether that is too few. A row that lacks an input stays, with nulls. One projection:
    the rows do not move."""
    require_columns(df, model.spec.features)
    whole = is_complete(model.spec)
    rows = encode(model.encoder, _numbers(df, model.spec), [*df.columns, whole.alias("_whole")])
    scored = N.score(rows, model.parts)
    value = lambda c: F.when(F.col("_whole"), c)
    return scored.select(
        *df.columns,
        value(F.col("_value")).alias(PREDICTED),
        value(F.col("_rows")).alias("avg_leaf_rows"),
        value(F.col("_rows") < s.min_leaf_support).alias("low_support"),
    )


def predict_forest(model: ForestModel, df: DataFrame) -> DataFrame:
    """Adds `predicted`; a row that lacks an input stays, with a null prediction."""
    return predict_with_support(model, df).drop("avg_leaf_rows", "low_support")


def leaf_support(model: ForestModel, df: DataFrame, keys: list[str], s: Settings = DEFAULTS) -> DataFrame:
    """`keys`, `avg_leaf_rows` and `low_support` of the rows that lack no input."""
    scored = predict_with_support(model, df.filter(is_complete(model.spec)), s)
    return scored.select(*keys, "avg_leaf_rows", "low_support")


def importances(model: ForestModel) -> DataFrame:
    """Importance per source feature; the indicators of a category are summed."""
    spec = model.spec
    owner = [c for c, seen in zip(spec.categorical, model.encoder.stages[0].labelsArray) for _ in seen]
    owner += list(spec.continuous + spec.boolean)
    names = model.nodes.sparkSession.createDataFrame(list(enumerate(owner)), "feature int, name string")
    values = names.join(N.importance_by_feature(model.nodes), "feature", "left")
    summed = values.groupBy(F.col("name").alias("feature")).agg(F.sum(F.coalesce("importance", F.lit(0.0))).alias("importance"))
    return summed.orderBy(F.col("importance").desc(), "feature")


def side_by_side(jobs: list, at_once: int = 3) -> list:
    """Results of independent fits, a few at a time: what the driver does between the passes of
    one leaves the cluster to the others."""
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def tune(
    train: DataFrame, validation: DataFrame, grid: dict[str, list], spec: ForestSpec = ForestSpec()
) -> list[tuple[ForestSpec, float]]:
    """Validation R2 of every combination of `grid`.

    Depths and numbers of trees need no fit of their own: the deepest and largest forest ends
    earlier in the tree, or after fewer trees. So there is one fit for each combination of the
    other settings. Its first trees are a forest of that size, but not the one that a fit of that
    size draws from the same seed.
    """
    depths = [d or MAX_DEPTH for d in grid.get("depth", [spec.depth])]
    counts = list(grid.get("trees", [spec.trees]))
    others = {k: v for k, v in grid.items() if k not in ("depth", "trees")}
    largest = replace(spec, depth=max(depths), trees=max(counts))
    trials = [replace(largest, **dict(zip(others, combo))) for combo in product(*others.values())]
    frame = dealt(training_frame(train, spec))
    # Trials that draw and bin alike read the same sums.
    ready = {}
    for t in trials:
        if (t.bins, t.seed) not in ready:
            ready[t.bins, t.seed] = drawn(frame, t)
    encoder = ready[trials[0].bins, trials[0].seed][0]
    fits = side_by_side([lambda t=t: G.grow(*ready[t.bins, t.seed][:0:-1], t.trees, t.depth, t.min_leaf, False) for t in trials])
    tested = encode(encoder, _numbers(validation.filter(is_complete(spec)), spec), [TARGET])
    shapes = list(product(depths, counts))
    found = {}
    for trial, table in zip(trials, fits):
        sent = N.runs(table)
        values = N.score_shorter(tested, sent, depths, counts)
        each = values.select(TARGET, F.posexplode("_values").alias("shape", PREDICTED))
        for row in metrics(each, ["shape"]).collect():  # a row per depth and number of trees
            depth, trees = shapes[row["shape"]]
            found[replace(trial, depth=depth, trees=trees)] = row["r2"]
        for part in sent:
            part.release()
    chosen = [replace(spec, **dict(zip(grid, combo))) for combo in product(*grid.values())]
    return [(c, found[replace(c, depth=c.depth or MAX_DEPTH)]) for c in chosen]


def depth_metrics(train: DataFrame, validation: DataFrame, depths: list[int], spec: ForestSpec) -> DataFrame:
    """Validation metrics at each of `depths`, and the training rows. One fit, the deepest: the
    shallower forests are the same trees ended earlier. Rows that lack an input count as dropped."""
    frame = dealt(training_frame(train, spec))
    encoder, table = fitted(frame, replace(spec, depth=max(depths)), False)
    rows = encode(encoder, _numbers(validation, spec), [TARGET, is_complete(spec).alias("_whole")])
    sent = N.runs(table)
    scored = settle(N.score_shorter(rows, sent, depths, [spec.trees]).select(TARGET, "_whole", "_values"))
    for part in sent:
        part.release()
    n = F.lit(frame.count()).alias("n_training")
    each = [
        metrics(scored.withColumn(PREDICTED, F.when(F.col("_whole"), F.get("_values", i)))).select("*", F.lit(depth).alias("depth"), n)
        for i, depth in enumerate(depths)
    ]
    return reduce(DataFrame.unionByName, each)


def best(results: list[tuple[ForestSpec, float]]) -> ForestSpec:
    return max(results, key=lambda r: r[1])[0]


def fold_r2(df: DataFrame, fold_by: dict[str, list[str]], folds: int = 3, spec: ForestSpec = ForestSpec()) -> dict[str, float]:
    """Mean cross-validated R2 by name, with folds drawn over the columns named: whole races keep a
    race on one side, single laps let the model see the stints it is tested on. Every fold's
    rows are encoded and fitted apart from the ones it is tested on; all fits read one frame."""
    rows = training_rows(df, [*spec.features, TARGET])
    fold = lambda by: F.pmod(F.xxhash64(F.lit(spec.seed), *by), F.lit(folds)).cast("int")
    parts = {f"_fold_{name}": fold(by) for name, by in fold_by.items()}
    frame = dealt(_numbers(rows, spec).select(*[f"_in_{c}" for c in spec.features], TARGET, *[c.alias(n) for n, c in parts.items()]))

    def one(column: str, k: int) -> float:
        encoder, table = fitted(frame.filter(F.col(column) != k), spec, False)
        held = encode(encoder, frame.filter(F.col(column) == k), [TARGET])
        return metrics(N.score(held, N.runs(table)).withColumnRenamed("_value", PREDICTED)).first()["r2"]

    values = side_by_side([lambda c=c, k=k: one(c, k) for c in parts for k in range(folds)])
    return {name: sum(values[i * folds : (i + 1) * folds]) / folds for i, name in enumerate(fold_by)}


VERSION = 2


def save(model: ForestModel, path: str) -> None:
    """Encoder, nodes and settings under one folder, for scoring jobs that do not refit. The
    settings come last: a folder without them is not a model."""
    spark = model.nodes.sparkSession
    model.encoder.write().overwrite().save(f"{path}/encoder")
    model.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    settings = json.dumps({"version": VERSION, "spec": asdict(model.spec)})
    spark.createDataFrame([(settings,)], "settings string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load(spark: SparkSession, path: str, spec: ForestSpec | None = None) -> ForestModel:
    """The model that `save` wrote; an error where it was fitted with another spec than asked for."""
    stored = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
    if stored["version"] != VERSION:
        raise ValueError(f"stored model has version {stored['version']}, not {VERSION}")
    found = ForestSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in stored["spec"].items()})
    if spec is not None and spec != found:
        raise ValueError(f"stored model was fitted with {found}")
    nodes = spark.read.parquet(f"{path}/nodes")
    return ForestModel(found, PipelineModel.load(f"{path}/encoder"), nodes, N.runs(nodes))
