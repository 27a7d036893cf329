"""Race-level train/test splits. A race is never on both sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stintwise.operators.lookup import pin_small
from stintwise.schema import SESSION, require_columns
from stintwise.settings import DEFAULTS, Settings


def race_keys(df: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    require_columns(df, keys)
    return df.select(*keys).distinct()


def holdout_count(n_races: int, share: float) -> int:
    """Held-out races, rounded half to even; both sides keep at least one."""
    if n_races < 2:
        raise ValueError(f"need at least 2 races to split, found {n_races}")
    return max(1, min(round(n_races * share), n_races - 1))


def at_or_after(keys: list[str], values: list) -> Column:
    """Lexicographic (keys) >= (values) as plain comparisons, which prune partitions. A null
    comes before every value, as in ascending order, so the condition is never null."""

    def compared(key: str, value) -> tuple[Column, Column, Column]:
        c = F.col(key)
        if value is None:
            return c.isNotNull(), c.isNull(), F.lit(True)
        v = F.lit(value)
        return F.coalesce(c > v, F.lit(False)), F.coalesce(c == v, F.lit(False)), F.coalesce(c >= v, F.lit(False))

    *head, last = [compared(k, v) for k, v in zip(keys, values)]
    return reduce(lambda acc, x: x[0] | (x[1] & acc), reversed(head), last[2])


def split_chronological(
    df: DataFrame, share: float = 0.2, keys: list[str] = SESSION, s: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """The most recent races are the test side. Finds the first test race, then both sides
    are filters on the race key, so nothing is joined. Rows with a null in the key belong to the
    race so keyed, which is on one side like any other."""
    races, _ = pin_small(race_keys(df, keys), s)
    n = races.count()
    first_test = races.orderBy(*keys).offset(n - holdout_count(n, share)).first()
    is_test = at_or_after(keys, list(first_test))
    return df.filter(~is_test), df.filter(is_test)


def chronological_rank(df: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """Races numbered in time order: rank within the season plus the races of earlier
    seasons, so no task orders more than a season's races or the list of seasons."""
    races = race_keys(df, keys)
    season, rest = keys[0], keys[1:]
    earlier = Window.orderBy(season).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        races.groupBy(season)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    in_season = F.row_number().over(Window.partitionBy(season).orderBy(*rest))
    return (
        races.withColumn("_rank", in_season)
        .join(before, season)
        .select(*keys, (F.col("_rank") + F.col("_before")).alias("race_rank"))
    )


def split_random(
    df: DataFrame, share: float = 0.2, seed: int = 0, keys: list[str] = SESSION, s: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """Races in an order drawn from the seed; the first ones are the test side."""
    races, _ = pin_small(race_keys(df, keys), s)
    n_test = holdout_count(races.count(), share)
    named = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys])
    test_keys, _ = pin_small(races.orderBy(F.md5(named), *keys).limit(n_test), s)
    return split_by_keys(df, test_keys, keys, listed=False), split_by_keys(df, test_keys, keys)


def split_by_keys(df: DataFrame, race: DataFrame, keys: list[str] = SESSION, listed: bool = True) -> DataFrame:
    """Rows of the listed races, or of all others; a null key part equals a null key part."""
    k = race.select(*[F.col(c).alias(f"_k_{c}") for c in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    return df.join(k, same, "left_semi" if listed else "left_anti")


def split_by_season(df: DataFrame, train_seasons: list[int], test_seasons: list[int]) -> tuple[DataFrame, DataFrame]:
    train = df.filter(F.col("season").isin(train_seasons))
    test = df.filter(F.col("season").isin(test_seasons))
    for name, side, seasons in (("train", train, train_seasons), ("test", test, test_seasons)):
        if side.isEmpty():
            raise ValueError(f"no rows for {name} seasons {seasons}")
    return train, test


def uncovered_compounds(train: DataFrame, test: DataFrame, column: str = "tire_compound") -> DataFrame:
    """Compounds of the test side that training never saw."""
    def distinct(side):
        return side.select(column).filter(F.col(column).isNotNull()).distinct()

    return distinct(test).join(distinct(train), column, "left_anti")


def unseen_values(train: DataFrame, query: DataFrame, columns: list[str]) -> DataFrame:
    """Category values per feature that occur in the query rows and not in training."""
    def long(side):
        pairs = F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
        )
        return side.select(pairs.alias("p")).select("p.*").filter(F.col("value").isNotNull()).distinct()

    return long(query).join(long(train), ["feature", "value"], "left_anti")


def split_summary(train: DataFrame, test: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """Races and laps on each side, one row. Laps are counted per race first."""
    def side(df, name):
        per_race = df.groupBy(*keys).agg(F.count("*").alias("laps"))
        return per_race.select(F.lit(name).alias("side"), "laps")

    both = side(train, "train").unionByName(side(test, "test"))
    is_test = F.col("side") == "test"
    return both.agg(
        F.count_if(~is_test).alias("train_races"),
        F.count_if(is_test).alias("test_races"),
        F.coalesce(F.sum(F.when(~is_test, F.col("laps"))), F.lit(0)).cast("long").alias("train_laps"),
        F.coalesce(F.sum(F.when(is_test, F.col("laps"))), F.lit(0)).cast("long").alias("test_laps"),
    )


def seen_and_unseen(train: DataFrame, test: DataFrame, column: str = "circuit") -> DataFrame:
    """Values of the test side, flagged by whether training has them."""
    seen = train.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("in_train", F.lit(True))
    asked = test.select(column).filter(F.col(column).isNotNull()).distinct()
    return asked.join(seen, column, "left").withColumn("in_train", F.coalesce("in_train", F.lit(False)))
