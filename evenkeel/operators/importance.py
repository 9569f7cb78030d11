"""How much features matter to a model of the outcome: by L1 coefficients and by permutation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.package import ship
from ..sources.tabular import materialize
from . import ranking as R
from .batch_fit import BatchFit, Design, _matrix, _scaled
from .splits import hash_rank, hash_uniform


def l1_importance(
    parts: DataFrame, key: str, cats: list[str], nums: list[str], y: str, penalties: list[float] = (0.1, 0.03, 0.01, 0.003, 0.001), folds: int = 5, seed: int = 0
) -> tuple[dict[str, float], float]:
    """({feature: sum of the absolute coefficients of its columns}, penalty) of an L1 logistic fit on the training rows.

    Columns are standardised.  The penalty is the one of least mean loss on held-out folds (by a hash of
    ``key``), the larger of equal ones.  All penalties and folds are fitted together, one scan a step.
    """
    rows = parts.withColumn("_fold", F.floor(hash_uniform(F.col(key), seed) * folds).cast("int"))
    names = [f"{k}/{i}" for k in range(folds) for i in range(len(penalties))]
    whole = [f"all/{i}" for i in range(len(penalties))]
    design = Design(rows, dict.fromkeys([*names, *whole], {}), cats, nums, [key, y, "split", "_fold"])
    l1 = {n: penalties[int(n.rpartition("/")[2])] for n in [*names, *whole]}
    fit = BatchFit(design, y, reg=0.0, tolerance=1e-8, l1=l1, hold={n: int(n.partition("/")[0]) for n in names}, fold="_fold")
    if fit.fits[whole[0]] is None:
        raise ValueError("the training rows have one class")
    scored = fit.score(design.rows.filter("split = 'train'"), [y, "_fold"])
    held = scored.filter(F.split_part("candidate", F.lit("/"), F.lit(1)) == F.col("_fold").cast("string"))
    p = F.least(F.greatest("p_event", F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = held.groupBy(F.split_part("candidate", F.lit("/"), F.lit(2)).cast("int").alias("i")).agg(F.avg(-F.when(F.col(y) == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("loss"))
    best = min(loss.collect(), key=lambda r: (round(r.loss, 12), -penalties[r.i])).i
    beta = fit.fits[f"all/{best}"]
    at = {c: j for j, c in enumerate(design.columns[f"all/{best}"])}
    return {f: float(sum(abs(beta[at[c]]) for c in own)) for f, own in design.blocks[f"all/{best}"].items()}, penalties[best]


def permutation_importance(parts: DataFrame, key: str, cats: list[str], nums: list[str], y: str, on: str = "val", repeats: int = 3, seed: int = 0) -> DataFrame:
    """(feature, importance, sd): by how much the AUROC on split ``on`` falls when a feature's values change rows.

    Each row is given a donor, the row of its rank in another hash order (``key`` is a number), and a feature's
    columns are taken from the donor, one feature at a time, all in one pass over the joined rows.  Mean and
    deviation are over ``repeats`` orders.
    """
    design = Design(parts, {"model": {}}, cats, nums, [key, y, "split"])
    fit = BatchFit(design, y)
    beta = fit.fits["model"]
    if beta is None:
        raise ValueError("the training rows have one class")
    rows = materialize(design.rows.filter(F.col("split") == on).select(key, y, "x"), "permuted")
    base = R.auroc(fit.score(rows, [y]), [], y, "p_event").first().auroc
    mean, sd, width, cols, blocks = fit.mean, fit.sd, design.width, design.columns["model"], design.blocks["model"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, other = _matrix(b, "x", width), _matrix(b, "z", width)
            for f, own in blocks.items():
                mixed = x.copy()
                mixed[:, own] = other[:, own]
                p = 1 / (1 + np.exp(-(_scaled(mixed, cols, mean, sd) @ beta)))
                yield pa.RecordBatch.from_arrays([pa.array([f] * b.num_rows), b.column(0), b.column(1), pa.array(p)], ["feature", "repeat", "y", "p_event"])

    ship(parts.sparkSession)
    out = None
    mine = hash_rank(rows, [], key, seed)
    for i in range(repeats):
        donor = hash_rank(rows, [], key, seed + i + 1).select("rank", F.col("x").alias("z"))
        pair = mine.join(donor, "rank").select(F.lit(i).alias("repeat"), F.col(y).cast("int").alias("y"), "x", "z")
        out = pair if out is None else out.unionByName(pair)
    scored = materialize(out.mapInArrow(run, "feature string, repeat int, y int, p_event double"), "scored")
    per = R.auroc(scored, ["feature", "repeat"], "y", "p_event").withColumn("fall", F.lit(base) - F.col("auroc"))
    return per.groupBy("feature").agg(F.avg("fall").alias("importance"), F.stddev_pop("fall").alias("sd"))
