"""Exact quantiles of columns of any length, without sorting one in one task.

The range of values is cut into cells and counted; each wanted rank falls into one cell, which
is cut again, until a cell holds one value or few enough rows to look at. All ranks of all columns
are cut in the same aggregate, whose result has at most CELLS rows for each of them. Infinite values
are counted apart, so that the cells have a width.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1024
FEW = 10_000


@dataclass
class Bracket:
    """The n rows of a column in [lo, hi], and the wanted ranks among them, counted from its first."""

    column: int
    lo: float
    hi: float
    n: int
    ranks: list[tuple[int, int]]  # (rank in the column, rank in the bracket)

    @property
    def width(self) -> float:
        return self.hi / CELLS - self.lo / CELLS

    @property
    def can_be_cut(self) -> bool:
        return self.n > FEW and self.lo < self.hi and self.lo + self.width > self.lo

    def holds(self) -> Column:
        return (F.col("c") == self.column) & F.col("x").between(self.lo, self.hi)

    def cell(self) -> Column:
        return F.least(F.floor((F.col("x") - self.lo) / self.width), F.lit(CELLS - 1))


def exact_quantiles(df: DataFrame, c: str, probs: list[float]) -> list[float | None]:
    """Quantiles interpolated linearly between neighbouring ranks; nulls and NaN do not count."""
    return quantiles(df, [c], probs)[c]


def quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """The quantiles of several columns, from the same passes over the rows."""
    entries = F.array(*[F.struct(F.lit(i).alias("c"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("x")) for i, c in enumerate(columns)])
    x = df.select(F.explode(F.filter(entries, lambda e: e["x"].isNotNull())).alias("e")).select("e.*")
    finite = F.when(F.abs("x") < math.inf, F.col("x"))
    seen = x.groupBy("c").agg(
        F.count_if(F.col("x") == -math.inf).alias("below"), F.count(finite).alias("n"), F.count("*").alias("all"), F.min(finite).alias("lo"), F.max(finite).alias("hi")
    )
    known = {r["c"]: r for r in seen.collect()}  # a row per column
    at: dict[tuple[int, int], float] = {}
    open_ = []
    for i, r in known.items():
        wanted = {f(p * (r["all"] - 1)) for p in probs for f in (math.floor, math.ceil)}
        inside = {k for k in wanted if r["below"] <= k < r["below"] + r["n"]}
        at |= {(i, k): -math.inf if k < r["below"] else math.inf for k in wanted - inside}
        if inside:
            open_.append(Bracket(i, r["lo"], r["hi"], r["n"], [(k, k - r["below"]) for k in sorted(inside)]))
    at |= _found(x, open_)
    return {c: [_between(at, i, p, known[i]["all"]) if i in known else None for p in probs] for i, c in enumerate(columns)}


def _between(at: dict, column: int, p: float, n: int) -> float:
    pos = p * (n - 1)
    a, b = at[column, math.floor(pos)], at[column, math.ceil(pos)]
    return a if a == b else a + (b - a) * (pos - math.floor(pos))


def _counted(x: DataFrame, brackets: list[Bracket], key) -> dict[int, list]:
    """(lo, hi, n) of the cells of each bracket, in order. `key` names a bracket's cells."""
    number = reduce(lambda w, b: w.when(b[1].holds(), b[0]), enumerate(brackets), F.when(F.lit(False), 0))
    cell = reduce(lambda w, b: w.when(F.col("b") == b[0], key(b[1])), enumerate(brackets), F.when(F.lit(False), F.lit(None)))
    rows = x.withColumn("b", number).filter("b is not null").groupBy("b", cell.alias("cell")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    out: dict[int, list] = {i: [] for i in range(len(brackets))}
    for r in rows.orderBy("b", "cell").collect():  # CELLS, or FEW, a bracket at most
        out[r["b"]].append(r)
    return out


def _parts(bracket: Bracket, cells: list) -> list[Bracket]:
    """The cells that a bracket's ranks fall in."""
    out, before, left = [], 0, list(bracket.ranks)
    for r in cells:
        here = [(k, rank - before) for k, rank in left if rank < before + r["n"]]
        left = left[len(here) :]
        before += r["n"]
        if here:
            out.append(Bracket(bracket.column, r["lo"], r["hi"], r["n"], here))
    return out


def _found(x: DataFrame, brackets: list[Bracket]) -> dict[tuple[int, int], float]:
    """The value of every wanted rank."""
    while any(b.can_be_cut for b in brackets):
        wide = [b for b in brackets if b.can_be_cut]
        cells = _counted(x, wide, Bracket.cell)
        brackets = [b for b in brackets if not b.can_be_cut] + [p for i, b in enumerate(wide) for p in _parts(b, cells[i])]
    single = [b for b in brackets if b.lo == b.hi]
    mixed = [b for b in brackets if b.lo < b.hi]
    if mixed:
        # One value a cell: few rows are left, or so few values that no cell between them can be cut.
        values = _counted(x, mixed, lambda b: F.col("x"))
        single += [p for i, b in enumerate(mixed) for p in _parts(b, values[i])]
    return {(b.column, k): b.lo for b in single for k, _ in b.ranks}
