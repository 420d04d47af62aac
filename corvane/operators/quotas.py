"""Samples with quotas: what each cell gives is settled on the small table of cells' counts, then one pass over the rows takes the first of each cell."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a plan, which is made on the driver.
CELLS = 100_000


def water_filled(available: dict, targets: dict, total: int | None = None) -> dict:
    """What each bucket gives: its target where it has so many, and what others lack spread evenly over those that have more, up to `total` (the sum of
    targets) or all there is. Steps that don't go into all go to the first buckets in order."""
    total = sum(targets.values()) if total is None else total
    given = {b: min(available.get(b, 0), t) for b, t in targets.items()}
    lack = total - sum(given.values())
    while lack > 0 and (open_ := [b for b in targets if given[b] < available.get(b, 0)]):
        step = max(1, lack // len(open_))
        for b in open_:
            more = min(step, available.get(b, 0) - given[b], lack)
            given[b] += more
            lack -= more
    return given


def margins(available: dict[tuple, int], rows: dict, columns: dict) -> dict[tuple, int]:
    """Quotas of cells (row, column) whose sums meet as much as possible of both margins, none above what is available: a greatest integral flow from rows over
    cells to columns, by shortest augmenting paths in order of the margins."""
    flow = dict.fromkeys(available, 0)
    left, right = dict(rows), dict(columns)
    cells = {r: [c for c in columns if available.get((r, c))] for r in rows}
    back = {c: [r for r in rows if available.get((r, c))] for c in columns}
    while True:
        parent: dict = {("r", r): None for r, n in left.items() if n > 0}
        todo, end = deque(parent), None
        while todo and end is None:
            side, x = todo.popleft()
            near = [("c", c) for c in cells[x] if flow[x, c] < available[x, c]] if side == "r" else [("r", r) for r in back[x] if flow[r, x] > 0]
            for y in near:
                if y not in parent:
                    parent[y] = (side, x)
                    if y[0] == "c" and right[y[1]] > 0:
                        end = y
                        break
                    todo.append(y)
        if end is None:
            return flow
        path = [end]
        while parent[path[-1]]:
            path.append(parent[path[-1]])
        path = [x for _, x in reversed(path)]
        steps = [((path[i], path[i + 1]), 1) if i % 2 == 0 else ((path[i + 1], path[i]), -1) for i in range(len(path) - 1)]
        n = min([left[path[0]], right[path[-1]], *(available[k] - flow[k] if way > 0 else flow[k] for k, way in steps)])
        for k, way in steps:
            flow[k] += way * n
        left[path[0]] -= n
        right[path[-1]] -= n


def _counts(rows: DataFrame, *by: str) -> list:
    out = rows.groupBy(*by).count().limit(CELLS + 1).collect()
    if len(out) > CELLS:
        raise ValueError(f"more than {CELLS} cells in a plan of quotas")
    return out


def _order(key: str, seed: str) -> list[Column]:
    return [F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), F.col(key)]


def taken(rows: DataFrame, by: list[str], quotas: dict[tuple, int], key: str, seed: str) -> DataFrame:
    """The first rows of each cell, in the seed's order, as many as its quota."""
    plan = [(*k, n) for k, n in quotas.items() if n > 0]
    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.select(*by).dtypes)
    table = F.broadcast(rows.sparkSession.createDataFrame(plan, f"{kinds}, _quota int"))  # CELLS rows at most
    most = max((n for *_, n in plan), default=0)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*_order(key, seed)))
    return rows.withColumn("_n", place).where(F.col("_n") <= most).join(table, by).where("_n <= _quota").drop("_n", "_quota")


def two_margins(rows: DataFrame, row: str, column: str, row_targets: dict, column_targets: dict, key: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """A sample whose counts meet both margins as far as rows allow, and its report: axis, value, target, taken, deficit."""
    wanted = rows.where(F.col(row).isin(*row_targets) & F.col(column).isin(*column_targets))
    available = {(r[row], r[column]): r["count"] for r in _counts(wanted, row, column)}
    quotas = margins(available, row_targets, column_targets)
    report = []
    for axis, targets, i in ((row, row_targets, 0), (column, column_targets, 1)):
        for value, target in targets.items():
            n = sum(q for k, q in quotas.items() if k[i] == value)
            report.append((axis, str(value), target, n, target - n))
    return taken(wanted, [row, column], quotas, key, seed), rows.sparkSession.createDataFrame(report, "axis string, value string, target int, taken int, deficit int")


def redistributed(rows: DataFrame, bucket: str, targets: dict, key: str, seed: str) -> DataFrame:
    """A sample with each bucket's target where it has so many rows; what some lack is taken evenly from others."""
    available = {r[bucket]: r["count"] for r in _counts(rows.where(F.col(bucket).isin(*targets)), bucket)}
    return taken(rows, [bucket], {(b,): n for b, n in water_filled(available, targets).items()}, key, seed)


def round_robin(rows: DataFrame, bucket: str, kind: str, page: str, targets: dict, key: str, seed: str) -> DataFrame:
    """Of each bucket as many rows as its target, its kinds taking turns in order, no page twice in a bucket: n, the turn of each row. A kind's row whose page is
    taken goes, and the next kind has its turn.

    A bucket takes no more pages than its target, so of each kind's pages only the first twice as many can matter: these are few, and their turns are taken
    bucket by bucket.
    """
    wanted = rows.where(F.col(bucket).isin(*targets))
    first = F.row_number().over(Window.partitionBy(bucket, kind, page).orderBy(*_order(key, seed)))
    pages = wanted.withColumn("_p", first).where("_p = 1").drop("_p")
    place = F.row_number().over(Window.partitionBy(bucket, kind).orderBy(*_order(key, seed)))
    some = pages.withColumn("_n", place).where(F.col("_n") <= 2 * max(targets.values(), default=0))

    def turns(frame: pd.DataFrame) -> pd.DataFrame:
        queues = [list(x.index) for _, x in frame.sort_values([kind, "_n"]).groupby(kind, sort=True)]
        target, seen, picks, at = targets[frame[bucket].iloc[0]], set(), [], [0] * len(queues)
        turn = 0
        while len(picks) < target and any(at[i] < len(q) for i, q in enumerate(queues)):
            i = turn % len(queues)
            turn += 1
            if at[i] < len(queues[i]):
                row = queues[i][at[i]]
                at[i] += 1
                if frame.at[row, page] not in seen:
                    seen.add(frame.at[row, page])
                    picks.append(row)
        out = frame.loc[picks].drop(columns="_n")
        return out.assign(n=range(1, len(picks) + 1))

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return some.groupBy(bucket).applyInPandas(turns, f"{kinds}, n int")
