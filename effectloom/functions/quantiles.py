"""Exact quantiles and order statistics in two scans, whatever the size.

The first scan is one aggregate: per column a count and a mergeable quantile
sketch, read at a grid of ranks.  Two grid points bracket each wanted rank with a
wide margin over the sketch's error.  The second scan counts exactly what lies
below and between the brackets and lists the values inside with their counts, a
fixed small share of the rows.  If the list is short it settles the ranks;
otherwise it is written as a table and narrowed there by histogram passes, so the
input is not read again.  Should a rank lie outside its bracket, the scan is
repeated with a wider one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import written

GRID = 512
ACCURACY = 4096  # sketch error: n / ACCURACY ranks, an eighth of a grid step
CELLS = 1024
LISTED = 50_000
INF = float("inf")


def number(col: str) -> Column:
    """The column as a double; NaN counts as missing."""
    return F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))


@dataclass
class Sketch:
    """Non-null rows of a column and its values at GRID + 1 evenly spaced ranks, nearly."""
    n: int
    grid: list[float]

    def bracket(self, rank: int, steps: int) -> tuple[float, float]:
        at = rank / max(1, self.n - 1) * (len(self.grid) - 1)
        low, high = math.floor(at) - steps, math.ceil(at) + steps
        return self.grid[low] if low > 0 else -INF, self.grid[high] if high < len(self.grid) - 1 else INF


def sketch_of(v: Column, grid: int = GRID) -> Column:
    """Aggregate to put beside others; `read_sketch` reads it."""
    return F.struct(F.count(v).alias("n"), F.percentile_approx(v, [i / grid for i in range(grid + 1)], ACCURACY).alias("grid"))


def read_sketch(row) -> Sketch:
    return Sketch(row["n"], list(row["grid"] or []))


@dataclass
class _Part:
    """An interval of the listed values (of one column and zone) that holds wanted ranks; below: rows before it."""
    zone: int
    lo: float
    hi: float
    below: int
    ranks: list[int]


def _narrow(table: DataFrame, work: list[_Part], cells: int, listed: int) -> dict[int, dict[int, float]]:
    """zone -> rank -> value, over a table (zone, v, n) of finite values; every round is one pass for all intervals."""
    answers: dict[int, dict[int, float]] = {}
    short: list[tuple[_Part, int]] = []
    v = F.col("v")
    while work:
        place, todo = F.lit(None).cast("struct<part:int,cell:int>"), []
        for part in work:
            width = (part.hi / 2 - part.lo / 2) / cells  # halves: the width of wide intervals does not overflow
            if part.lo == part.hi:
                answers.setdefault(part.zone, {}).update({r: part.lo for r in part.ranks})
            elif part.lo / 2 + width <= part.lo / 2 or part.hi / 2 - width >= part.hi / 2:
                short.append((part, 0))  # too narrow for cells: few distinct doubles
            else:
                cell = F.least(F.lit(cells - 1), F.floor((v / 2 - F.lit(part.lo / 2)) / F.lit(width)).cast("int"))
                place = F.when((F.col("zone") == part.zone) & v.between(part.lo, part.hi), F.struct(F.lit(len(todo)).alias("part"), cell.alias("cell"))).otherwise(place)
                todo.append(part)
        if not todo:
            break
        found = (table.select(place.alias("p"), "v", "n").filter("p IS NOT NULL").groupBy("p.part", "p.cell")
                 .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("part", "cell").collect())
        work = []
        for i, part in enumerate(todo):
            start = part.below
            for row in (r for r in found if r["part"] == i):
                here = [r for r in part.ranks if start <= r < start + row["n"]]
                if here:
                    inner = _Part(part.zone, row["lo"], row["hi"], start, here)
                    if row["values"] <= listed and row["lo"] != row["hi"]:
                        short.append((inner, row["values"]))
                    else:
                        work.append(inner)
                start += row["n"]
    for part, _ in short:
        start = part.below
        for row in table.filter((F.col("zone") == part.zone) & v.between(part.lo, part.hi)).groupBy("v").agg(F.sum("n").alias("n")).orderBy("v").collect():
            answers.setdefault(part.zone, {}).update({r: row["v"] for r in part.ranks if start <= r < start + row["n"]})
            start += row["n"]
    return answers


def _from_rows(rows: list, ranks: dict[int, tuple[int, list[int]]]) -> dict[int, dict[int, float]]:
    """Values of ranks (zone -> (rows below, ranks)) from collected rows (zone, v, n)."""
    out: dict[int, dict[int, float]] = {}
    start = {z: below for z, (below, _) in ranks.items()}
    for zone, v, n in sorted((r["zone"], r["v"], r["n"]) for r in rows if r["zone"] in ranks):
        out.setdefault(zone, {}).update({r: v for r in ranks[zone][1] if start[zone] <= r < start[zone] + n})
        start[zone] += n
    return out


def _from_table(found: DataFrame, ranks: dict[int, tuple[int, list[int]]], cells: int, listed: int) -> dict[int, dict[int, float]]:
    """The same from a table (zone, v, n)."""
    finite = F.when(F.abs("v") < INF, F.col("v"))
    ends = found.groupBy("zone").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("v") == -INF, F.col("n"))), F.lit(0)).alias("low"),
                                     F.coalesce(F.sum(F.when(F.col("v") == INF, F.col("n"))), F.lit(0)).alias("high"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    out, work = {}, []
    for row in ends.collect():
        below, wanted = ranks.get(row["zone"], (0, []))
        got = {r: -INF for r in wanted if r < below + row["low"]} | {r: INF for r in wanted if r >= below + row["n"] - row["high"]}
        out[row["zone"]] = got
        if rest := [r for r in wanted if r not in got]:
            work.append(_Part(row["zone"], row["lo"], row["hi"], below + row["low"], rest))
    for zone, got in _narrow(found.filter(F.abs("v") < INF), work, cells, listed).items():
        out[zone] |= got
    return out


def ranked(df: DataFrame, values: dict[str, Column], ranks: dict[str, list[int]], sketches: dict[str, Sketch], cells: int = CELLS,
           listed: int = LISTED, steps: int = 2) -> dict[tuple[str, int], float]:
    """Order statistics (column, 0-based rank) of non-null values; one scan unless a sketch was wrong."""
    names = [c for c in values if ranks[c]]
    # zones: column i owns the numbers from i * most on; odd ones are inside a bracket and listed
    most = 2 * max((len(ranks[c]) for c in names), default=0) + 2
    places, inside, brackets = [], 0.0, {}
    for i, c in enumerate(names):
        merged: list[list[float]] = []
        for lo, hi in sorted(sketches[c].bracket(r, steps) for r in ranks[c]):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(hi, merged[-1][1])
            else:
                merged.append([lo, hi])
        brackets[c] = merged
        inside += sketches[c].n * min(1.0, len(ranks[c]) * (2 * steps + 1) / (len(sketches[c].grid) - 1))
        v, zone = values[c], F.lit(i * most + 2 * len(merged))
        for k in range(len(merged) - 1, -1, -1):
            zone = F.when(v < merged[k][0], F.lit(i * most + 2 * k)).when(v <= merged[k][1], F.lit(i * most + 2 * k + 1)).otherwise(zone)
        places.append(F.when(v.isNotNull(), F.struct(zone.alias("zone"), v.alias("v"))))
    if not names:
        return {}
    one = df.select((places[0] if len(places) == 1 else F.explode(F.array_compact(F.array(*places)))).alias("p")).filter("p IS NOT NULL")
    found = one.select("p.zone", F.when(F.col("p.zone") % 2 == 1, F.col("p.v")).alias("v")).groupBy("zone", "v").agg(F.count(F.lit(1)).alias("n"))
    few = inside <= listed
    if few:
        rows = found.collect()
        count: dict[int, int] = {}
        for r in rows:
            count[r["zone"]] = count.get(r["zone"], 0) + r["n"]
    else:
        found = written(found, "ranks")
        count = {r["zone"]: r["n"] for r in found.groupBy("zone").agg(F.sum("n").alias("n")).collect()}
    wanted: dict[int, tuple[int, list[int]]] = {}
    missed: dict[str, list[int]] = {}
    for i, c in enumerate(names):
        start = 0
        for zone in range(i * most, i * most + 2 * len(brackets[c]) + 1):
            n = count.get(zone, 0)
            here = [r for r in ranks[c] if start <= r < start + n]
            if here and zone % 2 == 1:
                wanted[zone] = (start, here)
            elif here:
                missed[c] = missed.get(c, []) + here
            start += n
    got = _from_rows(rows, wanted) if few else _from_table(found.filter("v IS NOT NULL"), wanted, cells, listed)
    out = {(c, r): got[zone][r] for i, c in enumerate(names) for zone, (_, here) in wanted.items() if zone // most == i for r in here}
    if missed:
        out |= ranked(df, {c: values[c] for c in missed}, missed, sketches, cells, listed, steps * 16)
    return out


def sketched(df: DataFrame, values: dict[str, Column], grid: int = GRID) -> dict[str, Sketch]:
    row = df.agg(*[sketch_of(v, grid).alias(f"s{i}") for i, v in enumerate(values.values())]).first()
    return {c: read_sketch(row[f"s{i}"]) for i, c in enumerate(values)}


def order_statistics(df: DataFrame, col: str, ranks: list[int], cells: int = CELLS, listed: int = LISTED, grid: int = GRID) -> list[float]:
    values = {col: number(col)}
    got = ranked(df, values, {col: sorted(set(ranks))}, sketched(df, values, grid), cells, listed)
    return [got[col, r] for r in ranks]


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], sketches: dict[str, Sketch] | None = None, cells: int = CELLS,
                    listed: int = LISTED, grid: int = GRID) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column, ignoring nulls and NaN.

    sketches: those of the same columns, if an earlier aggregate has taken them.
    """
    if not wanted:
        return {}
    values = {c: number(c) for c in wanted}
    sketches = sketches or sketched(df, values, grid)
    places = {c: [(sketches[c].n - 1) * q for q in wanted[c]] for c in wanted if sketches[c].n}
    got = ranked(df, values, {c: sorted({r for h in places.get(c, []) for r in (math.floor(h), math.ceil(h))}) for c in wanted}, sketches, cells, listed)
    out: dict[str, list[float | None]] = {c: [None] * len(wanted[c]) for c in wanted if c not in places}
    for c, at in places.items():
        ends = [(h - math.floor(h), got[c, math.floor(h)], got[c, math.ceil(h)]) for h in at]
        out[c] = [lo if lo == hi or part == 0 else lo + part * (hi - lo) for part, lo, hi in ends]
    return out


def median(df: DataFrame, col: str, **kw) -> float | None:
    return exact_quantiles(df, {col: [0.5]}, **kw)[col][0]
