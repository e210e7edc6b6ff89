"""Problem 3: a sample whose cells have given shares, with floors, and the cells that can't be met.

Method: every record of a target cell gets the inclusion probability that makes the cells' expected counts equal their
wanted counts, found by Newton iterations on the dual of exponential tilting, bounded by 1; the iterations see only the
cells' counts, aggregated distributedly. A cell's gap is what its moment lacks at the end. Goals may overlap:
calibrated_margins() holds the shares of single categories. The pivotal method then draws the sample: within hash chunks of a cell first, which
leave one undecided record at most, then among those. Wanted counts are whole, so each cell gets exactly its count.

Cases: rows with a null id take no part; of rows with the same id the least categories count; a null category equals
no target; a null permille or floor is 0; without records every target with a wanted row has a gap.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

CATEGORIES = ("source_type", "aspect", "dataset_tier")
#: Targets that may be held by the driver; records of one sampling chunk.
TARGETS, CHUNK = 100_000, 50_000
#: Overlapping constraints whose Hessian the driver may hold.
MARGINS = 2_000


@dataclass(frozen=True)
class CalibratedSample:
    """sample: id, target_id; report: target_id, available, wanted, gap (wanted rows that there are not), probability."""

    sample: DataFrame
    report: DataFrame


def category(value: Column) -> Column:
    """Trimmed, in lower case, with - and blanks read as _."""
    return F.regexp_replace(F.lower(F.regexp_replace(value, r"^\s+|\s+$", "")), r"[-\s]", "_")


def tilt(counts: Sequence[int], members: Sequence[Sequence[int]], goals: Sequence[float], base: float, steps: int = 200, tol: float = 1e-12) -> list[float]:
    """Inclusion probabilities min(1, base * exp(sum of the lambdas of the cell's constraints)) whose moments meet the goals.

    counts: records of each cell; members: for each cell the constraints that it counts for; goals: wanted moment of each
    constraint. Newton's method on the dual sum_c counts_c phi(u_c) - sum_j goals_j lambda_j, whose gradient is the gap of
    the moments; a step is halved until the dual falls. Without overlap the Hessian is diagonal. A goal that can't be met
    drives its cells to probability 1, and its gap is what is left.
    """
    import numpy as np

    if not len(counts):
        return []
    n, want, at = np.asarray(counts, float), np.asarray(goals, float), np.asarray(members, int).reshape(len(counts), -1)
    if at.shape[1] > 1 and len(want) > MARGINS:
        raise ValueError(f"more than {MARGINS} overlapping constraints")
    top = -math.log(base)
    off = np.isin(at, np.flatnonzero(want <= 0)).any(axis=1) | (n <= 0)
    n = np.where(off, 0.0, n)

    def sums(v):
        out = np.zeros(len(want))
        for k in range(at.shape[1]):
            np.add.at(out, at[:, k], v)
        return out

    def dual(lam):
        u = lam[at].sum(axis=1)
        phi = np.where(u < top, base * np.exp(np.minimum(u, top)), 1.0 + u - top)
        return float(n @ phi - want @ lam)

    def probabilities(lam):
        return np.minimum(1.0, base * np.exp(np.minimum(lam[at].sum(axis=1), top)))

    lam = np.zeros(len(want))
    for _ in range(steps):
        p = probabilities(lam)
        gradient = sums(n * p) - want
        curve = np.where(p < 1.0, n * p, 0.0)
        # a saturated constraint has no curvature and so no step of its own
        open_ = (sums(curve) > 0) & (want > 0)
        if not open_.any() or np.max(np.abs(gradient[open_]) / want[open_]) < tol:
            break
        step = np.zeros(len(want))
        if at.shape[1] == 1:
            step[open_] = -gradient[open_] / sums(curve)[open_]
        else:
            one = np.zeros((len(n), len(want)))
            for k in range(at.shape[1]):
                one[np.arange(len(n)), at[:, k]] += 1.0
            hessian = one.T @ (one * curve[:, None])
            step[open_] = -np.linalg.lstsq(hessian[np.ix_(open_, open_)], gradient[open_], rcond=1e-12)[0]
        step = np.clip(step, -8.0, 8.0)
        size, here = 1.0, dual(lam)
        while size > 1e-6 and dual(lam + size * step) > here + 1e-4 * size * float(gradient @ step) + 1e-12 * abs(here):
            size /= 2
        if at.shape[1] == 1:
            # constraints don't touch each other: each takes its own step, undone by clipping only
            size = 1.0
        lam = lam + size * step
    return [0.0 if o else float(x) for o, x in zip(off, probabilities(lam), strict=True)]


def calibrated_sample(
    df: DataFrame, targets: DataFrame, id_col: str = "text_id", categories: Sequence[str] = CATEGORIES, target_id: str = "target_id",
    share: str = "target_permille", floor: str = "min_rows", fraction: int = 5, seed: int = 42,
) -> CalibratedSample:
    """A sample of a fraction-th of the distinct ids, dealt to the targets' cells by their permille, floors fixed first."""
    spark = df.sparkSession
    names = [f"c{k}" for k in range(len(categories))]
    own = df.where(df[id_col].isNotNull()).select(df[id_col].alias("id"), *[category(df[c]).alias(n) for c, n in zip(categories, names, strict=True)])
    rows = stored(own.groupBy("id").agg(F.min(F.struct(*names)).alias("s")).select("id", "s.*"), "cells")
    goal, counted, available, wanted = _cells(rows, targets, categories, names, target_id, share, floor, fraction)
    probability = tilt(available, [[k] for k in range(len(counted))], wanted, 1 / fraction)
    id_type = targets.schema[target_id].dataType.simpleString()
    report = spark.createDataFrame(
        [(r["target"], n, w, max(0, w - round(n * p)), p) for r, n, w, p in zip(counted, available, wanted, probability, strict=True)],
        f"target_id {id_type}, available long, wanted long, gap long, probability double",
    )
    in_cells = rows.join(F.broadcast(goal.select("target", *names)), names).join(F.broadcast(report.select(F.col("target_id").alias("target"), "probability", "available")), "target")
    units = in_cells.select("id", "target", "probability", F.xxhash64("id", F.lit(seed)).alias("h"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.ceil(F.col("available") / CHUNK)).alias("chunk"))
    key = rows.schema["id"].dataType.simpleString()
    shape = f"id {key}, target {id_type}, probability double, h long"
    first = stored(units.groupBy("target", "chunk").applyInPandas(lambda pdf: _pivotal(pdf, False), shape), "drawn")
    # one record for each chunk of CHUNK records is left undecided
    last = first.where("probability > 0 AND probability < 1").groupBy("target").applyInPandas(lambda pdf: _pivotal(pdf, True), shape)
    sample = first.where("probability >= 1").unionByName(last.where("probability >= 1")).select("id", F.col("target").alias("target_id"))
    return CalibratedSample(sample, report)


def _cells(rows: DataFrame, targets: DataFrame, categories: Sequence[str], names: Sequence[str], target_id: str, share: str, floor: str, fraction: int):
    """The targets as a table and as rows on the driver, with the records of their cells and the wanted ones."""
    size = rows.count() // fraction
    goal = targets.select(F.col(target_id).alias("target"), *[category(targets[c]).alias(n) for c, n in zip(categories, names, strict=True)], F.coalesce(share, F.lit(0)).alias("share"), F.coalesce(floor, F.lit(0)).alias("least"))
    goal = goal.where("target IS NOT NULL").distinct()
    if goal.count() > TARGETS:
        raise ValueError(f"more than {TARGETS} targets")
    cells = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    counted = goal.join(cells, list(names), "left").select("target", *names, "share", "least", F.coalesce("n", F.lit(0)).alias("n")).orderBy("target").collect()
    return goal, counted, [r["n"] for r in counted], [max(r["least"], -(-r["share"] * size // 1000)) for r in counted]


def calibrated_margins(
    df: DataFrame, targets: DataFrame, id_col: str = "text_id", categories: Sequence[str] = CATEGORIES, target_id: str = "target_id",
    share: str = "target_permille", floor: str = "min_rows", fraction: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """(margins: category, value, wanted, expected, gap; cells: target_id, available, probability).

    Only the margins of the targets are held, each value of each category alone: wanted is what the targets of that value
    ask for and can have, and the probabilities that meet all margins at once are as near to uniform as they can be. The
    margins overlap in every cell, so they come from Newton steps with the full Hessian.
    """
    spark = df.sparkSession
    names = [f"c{k}" for k in range(len(categories))]
    own = df.where(df[id_col].isNotNull()).select(df[id_col].alias("id"), *[category(df[c]).alias(n) for c, n in zip(categories, names, strict=True)])
    rows = stored(own.groupBy("id").agg(F.min(F.struct(*names)).alias("s")).select("id", "s.*"), "cells")
    _, counted, available, wanted = _cells(rows, targets, categories, names, target_id, share, floor, fraction)
    place: dict[tuple[int, str | None], int] = {}
    members = [[place.setdefault((k, r[n]), len(place)) for k, n in enumerate(names)] for r in counted]
    goals = [0] * len(place)
    for own_members, n, w in zip(members, available, wanted, strict=True):
        for j in own_members:
            goals[j] += min(n, w)
    probability = tilt(available, members, goals, 1 / fraction)
    reached = [0.0] * len(place)
    for own_members, n, p in zip(members, available, probability, strict=True):
        for j in own_members:
            reached[j] += n * p
    margins = [(categories[k], value, goals[j], round(reached[j], 3), max(0.0, round(goals[j] - reached[j], 3))) for (k, value), j in place.items()]
    id_type = targets.schema[target_id].dataType.simpleString()
    cells = [(r["target"], n, p) for r, n, p in zip(counted, available, probability, strict=True)]
    return (
        spark.createDataFrame(margins, "category string, value string, wanted bigint, expected double, gap double"),
        spark.createDataFrame(cells, f"target_id {id_type}, available bigint, probability double"),
    )


def _pivotal(pdf, final: bool):
    """Sequential pivotal method in the order of hashes: probabilities meet in pairs until one at most is undecided."""
    import numpy as np

    pdf = pdf.sort_values(["h", "id"], kind="stable").reset_index(drop=True)
    p = pdf["probability"].to_numpy(float).copy()
    p[p > 1 - 1e-9] = 1.0
    draws = np.random.default_rng((int(pdf["h"].iloc[0]) & 0x7FFFFFFFFFFFFFFF, len(pdf), int(final))).random(2 * len(p) + 1)
    open_at = -1
    for k in range(len(p)):
        if not 0.0 < p[k] < 1.0:
            continue
        if open_at < 0:
            open_at = k
            continue
        a, b = p[open_at], p[k]
        s = a + b
        if s < 1.0 - 1e-12:
            if draws[k] * s < a:
                p[open_at], p[k] = s, 0.0
            else:
                p[open_at], p[k], open_at = 0.0, s, k
        else:
            s = max(0.0, s - 1.0)
            if draws[k] * (2.0 - a - b) < 1.0 - b:
                p[open_at], p[k], open_at = 1.0, s, k
            else:
                p[k], p[open_at] = 1.0, s
        if open_at >= 0 and not 1e-9 < p[open_at] < 1 - 1e-9:
            p[open_at] = round(p[open_at])
            open_at = -1
    if final and open_at >= 0:
        p[open_at] = 1.0 if draws[-1] < p[open_at] else 0.0
    pdf["probability"] = p
    return pdf.loc[pdf["probability"] > 0, ["id", "target", "probability", "h"]]
