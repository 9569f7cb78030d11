"""Design-based inference from PSU totals; rows outside the domain stay in the design with value 0."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.special import t_ppf
from ..sources.package import ship
from ..sources.tabular import materialize

DESIGN = ["stratum", "psu"]


def rate_cells(groups: list[str], y: str, grp: str) -> Column:
    """array<rate> of the rates whose denominator a (group, outcome) cell belongs to."""
    pos = F.col(y) == 1
    known = F.col(grp).isin(groups)
    own = lambda kind: F.concat(F.lit(f"{kind}:"), F.col(grp))
    parts = [F.when(pos, "TPR").otherwise("FPR"), F.when(known, own("SR")), F.when(known, F.when(pos, own("TPR")).otherwise(own("FPR")))]
    return F.filter(F.array(*parts), lambda r: r.isNotNull())


def rate_names(groups: list[str]) -> list[str]:
    return ["TPR", "FPR", *[f"{k}:{g}" for k in ("SR", "TPR", "FPR") for g in groups]]


def psu_totals(df: DataFrame, groups: list[str], models: dict[str, Column], in_domain: Column, y: str = "y", grp: str = "seg", w: str = "w") -> DataFrame:
    """(model, stratum, psu, rate) num, den: every PSU of the design, 0 outside the domain.

    One scan: rows are summed into (PSU, group, outcome) cells with a column per model, and only the cells
    are spread over rates and models.
    """
    weight = F.when(in_domain, F.col(w)).otherwise(0.0)
    qs = {f"_q{i}": q.cast("double") for i, q in enumerate(models.values())}
    base = df.select(*DESIGN, F.col(grp).cast("string").alias("_g"), F.col(y).alias("_y"), weight.alias("_w"), *[q.alias(n) for n, q in qs.items()])
    cells = base.groupBy(*DESIGN, "_g", "_y").agg(F.sum("_w").alias("_w"), *[F.sum(F.col("_w") * F.col(n)).alias(n) for n in qs])
    per = cells.select(*DESIGN, "_w", *qs, F.explode(rate_cells(groups, "_y", "_g")).alias("rate"))
    per = per.groupBy(*DESIGN, "rate").agg(F.sum("_w").alias("_w"), *[F.sum(n).alias(n) for n in qs])
    # a PSU without a row of some cell still counts, with zeros
    grid = cells.select(*DESIGN).distinct().select(*DESIGN, F.explode(F.array(*[F.lit(r) for r in rate_names(groups)])).alias("rate"))
    wide = grid.join(per, [*DESIGN, "rate"], "left")
    zero = F.lit(0.0)
    nums = F.array(*[F.struct(F.lit(m).alias("model"), F.coalesce(n, zero).alias("num")) for m, n in zip(models, qs, strict=True)])
    out = wide.select(*DESIGN, "rate", F.coalesce("_w", zero).alias("den"), F.inline(nums))
    return out.select("model", *DESIGN, "rate", "num", "den")


def rates(totals: DataFrame) -> DataFrame:
    """(model, rate) value and den."""
    out = totals.groupBy("model", "rate").agg(F.sum("num").alias("n"), F.sum("den").alias("den"))
    return out.select("model", "rate", ratio(F.col("n"), F.col("den")).alias("value"), "den")


def taylor_scores(totals: DataFrame) -> DataFrame:
    """(model, stratum, psu, rate) t: PSU totals of the influence w (q - rate) / den."""
    both = totals.join(rates(totals).withColumnRenamed("den", "_all"), ["model", "rate"])
    t = ratio(F.col("num") - F.col("value") * F.col("den"), F.col("_all"), 0.0)
    return both.select("model", *DESIGN, "rate", t.alias("t"))


def taylor_covariance(scores: DataFrame) -> DataFrame:
    """(model, rate_a, rate_b) cov: sum over strata of n/(n-1) times the centred cross products."""
    per = Window.partitionBy("model", "stratum", "rate")
    c = scores.select("model", *DESIGN, "rate", (F.col("t") - F.avg("t").over(per)).alias("c"), F.count("*").over(per).alias("n"))
    a, b = c.alias("a"), c.alias("b")
    on = (F.col("a.model") == F.col("b.model")) & (F.col("a.stratum") == F.col("b.stratum")) & (F.col("a.psu") == F.col("b.psu")) & (F.col("a.rate") <= F.col("b.rate"))
    scale = F.col("a.n") / F.nullif(F.col("a.n") - 1, F.lit(0))
    pairs = a.join(b, on).select(F.col("a.model").alias("model"), F.col("a.rate").alias("rate_a"), F.col("b.rate").alias("rate_b"), (scale * F.col("a.c") * F.col("b.c")).alias("x"))
    return pairs.groupBy("model", "rate_a", "rate_b").agg(F.sum("x").alias("cov"))


def taylor_variance(scores: DataFrame) -> DataFrame:
    """(model, rate) var: the diagonal of the covariance, without the join."""
    per = scores.groupBy("model", "stratum", "rate").agg(F.count("*").alias("n"), F.var_samp("t").alias("v"))
    # n/(n-1) times the centred sum of squares is n times the sample variance
    return per.groupBy("model", "rate").agg(F.sum(F.col("n") * F.col("v")).alias("var"))


def degrees_of_freedom(df: DataFrame) -> int:
    """PSUs minus strata; a stratum with one PSU makes the design not estimable."""
    row = df.select(*DESIGN).distinct().groupBy("stratum").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("df"), F.min("n").alias("least")).first()
    if row.least is None or row.least < 2:
        raise ValueError("a stratum has one PSU: NOT_ESTIMABLE")
    return int(row.df)


def bands(totals: DataFrame, critical: float) -> DataFrame:
    """(model, rate) value, se, lo, hi clipped to [0, 1]."""
    totals = materialize(totals, "totals")
    out = rates(totals).join(taylor_variance(taylor_scores(totals)), ["model", "rate"])
    se = F.sqrt(F.greatest(F.col("var"), F.lit(0.0)))
    out = out.select("model", "rate", "value", F.when(F.col("value").isNotNull(), se).alias("se"))
    return out.withColumn("lo", F.greatest(F.col("value") - critical * F.col("se"), F.lit(0.0))).withColumn("hi", F.least(F.col("value") + critical * F.col("se"), F.lit(1.0)))


def bonferroni_t(alpha: float, slots: int, df: int) -> float:
    return t_ppf(1 - alpha / (2 * slots), df)


def gap_projection(band: DataFrame) -> DataFrame:
    """(model) intervals of the DP and EO gaps from simultaneous bands; null unless every rate is estimable."""
    kind = F.split("rate", ":").getItem(0)
    groups = band.filter(F.col("rate").contains(":")).withColumn("kind", kind)
    ok = F.count("value") == F.count("*")
    per = groups.groupBy("model", "kind").agg(
        F.when(ok, F.greatest(F.max("lo") - F.min("hi"), F.lit(0.0))).alias("glo"), F.when(ok, F.least(F.max("hi") - F.min("lo"), F.lit(1.0))).alias("ghi")
    )
    lo = {k: F.max(F.when(F.col("kind") == k, F.col("glo"))) for k in ("SR", "TPR", "FPR")}
    hi = {k: F.max(F.when(F.col("kind") == k, F.col("ghi"))) for k in ("SR", "TPR", "FPR")}
    both = lo["TPR"].isNotNull() & lo["FPR"].isNotNull()
    return per.groupBy("model").agg(
        lo["SR"].alias("dp_lo"), hi["SR"].alias("dp_hi"),
        F.when(both, F.greatest(lo["TPR"], lo["FPR"])).alias("eo_lo"), F.when(both, F.greatest(hi["TPR"], hi["FPR"])).alias("eo_hi"),
    )


def taylor_ba(totals: DataFrame, critical: float, centre: float = 0.5) -> DataFrame:
    """(model) balanced accuracy TPR/2 - FPR/2 + ``centre`` with its interval; pass ``centre`` 0 for differences."""
    totals = materialize(totals.filter(F.col("rate").isin("TPR", "FPR")), "totals")
    scores = taylor_scores(totals)
    sign = F.when(F.col("rate") == "TPR", 0.5).otherwise(-0.5)
    one = scores.groupBy("model", *DESIGN).agg(F.sum(sign * F.col("t")).alias("t")).withColumn("rate", F.lit("BA"))
    var = taylor_variance(one).select("model", "var")
    value = rates(totals).filter(F.col("rate").isin("TPR", "FPR")).groupBy("model").agg(F.when(F.count("value") == 2, F.sum(sign * F.col("value")) + centre).alias("ba"))
    out = value.join(var, "model").withColumn("se", F.sqrt(F.greatest(F.col("var"), F.lit(0.0)))).drop("var")
    lo, hi = F.col("ba") - critical * F.col("se"), F.col("ba") + critical * F.col("se")
    if centre:
        lo, hi = F.greatest(lo, F.lit(0.0)), F.least(hi, F.lit(1.0))
    return out.withColumn("lo", lo).withColumn("hi", hi)


def bootstrap_factors(design: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, stratum, psu) factor: n-1 PSUs drawn with replacement, n/(n-1) times the count.

    The draw is an arithmetic hash of (replicate, stratum, draw), shared with SQL engines.  PSUs that a
    replicate did not draw have no row.
    """
    psus = design.select(*DESIGN).distinct()
    numbered = psus.withColumn("i", F.row_number().over(Window.partitionBy("stratum").orderBy("psu")) - 1)
    sizes = psus.groupBy("stratum").agg(F.count("*").alias("n")).filter("n > 1")
    draws = sizes.select("stratum", "n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    draws = draws.select("stratum", "n", "replicate", F.explode(F.sequence(F.lit(1), F.col("n").cast("int") - 1)).alias("draw"))
    h = (F.col("replicate").cast("long") * 7919 + F.col("stratum") * 104729 + F.col("draw") * 1299709 + F.lit(seed) * 15485863) % 1000003
    h = (h * h + F.col("draw") * 31 + F.col("replicate")) % 1000003
    draws = draws.withColumn("i", F.floor(h * F.col("n") / 1000003))
    counts = draws.groupBy("replicate", "stratum", "i", "n").agg(F.count("*").alias("c"))
    out = counts.join(numbered, ["stratum", "i"])
    return out.select("replicate", *DESIGN, (F.col("n") / (F.col("n") - 1) * F.col("c")).alias("factor"))


#: Numbers of a dense table of PSU totals that go to every executor, 8 bytes each.
MATRIX_CELLS = 16_000_000


def bootstrap_metrics(totals: DataFrame, factors: DataFrame, cells: int = MATRIX_CELLS) -> DataFrame:
    """(replicate, model) ba, dp, eo: factors times PSU totals, a distributed matrix product.

    What is replicated are PSU totals, never rows.  Their size is checked: up to ``cells`` numbers are sent
    to the executors as a matrix, which each block of replicates multiplies; beyond that it is a join.
    """
    totals = materialize(totals, "totals")
    size = totals.agg(F.count_distinct(*DESIGN).alias("p"), F.count_distinct("model", "rate").alias("c")).first()
    if 2 * size.p * size.c <= cells:
        return _matrix_metrics(totals, factors)
    return _joined_metrics(totals, factors)


def _matrix_metrics(totals: DataFrame, factors: DataFrame) -> DataFrame:
    spark = totals.sparkSession
    ship(spark)
    table = totals.toArrow().to_pandas()
    psus = {k: i for i, k in enumerate(sorted(set(zip(table.stratum, table.psu, strict=True))))}
    models, names = sorted(set(table.model)), sorted(set(table.rate))
    num, den = np.zeros((2, len(psus), len(models), len(names)))
    at = ([psus[k] for k in zip(table.stratum, table.psu, strict=True)], table.model.map({m: i for i, m in enumerate(models)}).to_numpy(), table.rate.map({r: i for i, r in enumerate(names)}).to_numpy())
    num[at], den[at] = table.num.to_numpy(), table.den.to_numpy()
    shared = spark.sparkContext.broadcast((psus, models, names, num.reshape(len(psus), -1), den.reshape(len(psus), -1)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        psus, models, names, num, den = shared.value
        kind = np.array([r.split(":")[0] if ":" in r else "" for r in names])
        rest = pd.DataFrame()
        for part in [*parts, None]:
            if part is not None:
                rest = pd.concat([rest, part])
            if not len(rest):
                continue
            open_ = -1 if part is None else rest.replicate.iloc[-1]  # the last replicate may go on
            block, rest = rest[rest.replicate != open_], rest[rest.replicate == open_]
            ids = block.replicate.unique()
            if not len(ids):
                continue
            f = np.zeros((len(ids), len(psus)))
            f[pd.Index(ids).get_indexer(block.replicate), [psus[k] for k in zip(block.stratum, block.psu, strict=True)]] = block.factor
            with np.errstate(invalid="ignore", divide="ignore"):
                v = ((f @ num) / (f @ den)).reshape(len(ids), len(models), len(names))
            gap = {k: v[:, :, kind == k].max(2) - v[:, :, kind == k].min(2) for k in ("SR", "TPR", "FPR")}
            ba = (v[:, :, names.index("TPR")] + 1 - v[:, :, names.index("FPR")]) / 2
            yield pd.DataFrame(
                {"replicate": np.repeat(ids, len(models)), "model": models * len(ids), "ba": ba.ravel(), "dp": gap["SR"].ravel(), "eo": np.maximum(gap["TPR"], gap["FPR"]).ravel()}
            )

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = factors.repartition(n, "replicate").sortWithinPartitions("replicate")
    out = dealt.mapInPandas(run, "replicate int, model string, ba double, dp double, eo double")
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("ba", "dp", "eo")})


def _joined_metrics(totals: DataFrame, factors: DataFrame) -> DataFrame:
    # a row a PSU and model, with all its rates: the join makes replicates x PSUs x models rows
    wide = totals.groupBy("model", *DESIGN).agg(F.collect_list(F.struct("rate", "num", "den")).alias("r"))
    long = factors.join(wide, DESIGN).select("replicate", "model", "factor", F.inline("r"))
    per = long.groupBy("replicate", "model", "rate").agg(ratio(F.sum(F.col("factor") * F.col("num")), F.sum(F.col("factor") * F.col("den"))).alias("v"))
    kind = F.split("rate", ":").getItem(0)
    per = per.withColumn("kind", F.when(F.col("rate").contains(":"), kind))
    gap = {k: F.max(F.when(F.col("kind") == k, F.col("v"))) - F.min(F.when(F.col("kind") == k, F.col("v"))) for k in ("SR", "TPR", "FPR")}
    one = {r: F.max(F.when(F.col("rate") == r, F.col("v"))) for r in ("TPR", "FPR")}
    # a gap needs all rates of its kind; one whose PSUs are not drawn has no row
    rates = totals.select("rate").distinct().filter(F.col("rate").contains(":")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    n = {r.kind: r.n for r in rates.collect()}  # a row a kind
    whole = {k: F.count(F.when(F.col("kind") == k, F.col("v"))) == n.get(k, 0) for k in gap}
    out = per.groupBy("replicate", "model").agg(
        ((one["TPR"] + 1 - one["FPR"]) / 2).alias("ba"), F.when(whole["SR"], gap["SR"]).alias("dp"), F.when(whole["TPR"] & whole["FPR"], F.greatest(gap["TPR"], gap["FPR"])).alias("eo")
    )
    return out.select(F.col("replicate").cast("int").alias("replicate"), "model", "ba", "dp", "eo")


def bootstrap_inference(replicates: DataFrame, points: DataFrame, metrics: list[str], total: int, df: int, alpha: float = 0.05) -> DataFrame:
    """(model, metric) point, se, interval, status: valid if 95 % of the replicates are finite."""
    long = replicates.select("model", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])))
    got = long.groupBy("model", "metric").agg(F.stddev_samp("v").alias("se"), F.count("v").alias("finite"))
    pts = points.select("model", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("point")) for m in metrics])))
    out = pts.join(got, ["model", "metric"], "left")
    ok = F.coalesce(F.col("finite") >= 0.95 * total, F.lit(False)) & F.col("point").isNotNull()
    crit = t_ppf(1 - alpha / 2, df)
    return out.select(
        "model", "metric", "point", "finite", F.when(ok, F.col("se")).alias("se"), F.when(ok, F.col("point") - crit * F.col("se")).alias("lo"),
        F.when(ok, F.col("point") + crit * F.col("se")).alias("hi"), F.when(ok, "VALID").otherwise("NOT_ESTIMABLE").alias("status"),
    )


def point_metrics(totals: DataFrame) -> DataFrame:
    """(model) ba, dp, eo of the sample itself."""
    ones = totals.select(*DESIGN).distinct().select(F.lit(0).alias("replicate"), *DESIGN, F.lit(1.0).alias("factor"))
    return bootstrap_metrics(totals, ones).drop("replicate")


def bootstrap_paired(replicates: DataFrame, ref: str, metric: str) -> DataFrame:
    """(model) se and mean of the paired replicate differences against a reference model."""
    a = replicates.filter(F.col("model") == ref).select("replicate", F.col(metric).alias("a"))
    d = replicates.filter(F.col("model") != ref).join(a, "replicate").withColumn("d", F.col("a") - F.col(metric))
    return d.groupBy("model").agg(F.stddev_samp("d").alias("se"), F.avg("d").alias("mean"), F.count("d").alias("n"))


def holm_adjust(df: DataFrame, family: list[str], p: str, key: str) -> DataFrame:
    """Adds ``p_holm``: step-down within the family; null counts as 1."""
    rows = df.withColumn("_p", F.coalesce(p, F.lit(1.0)))
    w = Window.partitionBy(*family).orderBy("_p", key)
    n = F.count("*").over(Window.partitionBy(*family))
    rows = rows.withColumn("_s", F.least(F.lit(1.0), F.col("_p") * (n - F.row_number().over(w) + 1)))
    return rows.withColumn("p_holm", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_p", "_s")


def simultaneous_intervals(replicates: DataFrame, points: DataFrame, alpha: float, df_of) -> DataFrame:
    """(label) point, se, ordinary and simultaneous intervals from joint replicates (replicate, label, v).

    The simultaneous critical value is the "higher" quantile of the largest standardised deviation.
    """
    labels = points.agg(F.count("*").alias("m"))
    whole = replicates.groupBy("replicate").agg(F.count("v").alias("k")).crossJoin(F.broadcast(labels)).filter("k = m")  # one row
    good = replicates.join(whole.select("replicate"), "replicate")
    stats = good.groupBy("label").agg(F.stddev_samp("v").alias("se"), F.avg("v").alias("mean"))
    z = good.join(stats, "label").withColumn("z", F.when(F.col("se") > 0, F.abs(F.col("v") - F.col("mean")) / F.col("se")).otherwise(0.0))
    worst = z.groupBy("replicate").agg(F.max("z").alias("z"))
    ranked = worst.agg(F.sort_array(F.collect_list("z")).alias("zs"))  # a value per replicate
    n = F.size("zs")
    crit = ranked.select(F.element_at("zs", F.least(F.ceil((n - 1) * (1 - alpha) - 1e-12).cast("int") + 1, n)).alias("empirical"), (n - 1).alias("df"))
    row = crit.first()
    ordinary = df_of(row.df)
    both = max(row.empirical, ordinary)
    out = points.join(stats.select("label", "se"), "label")
    return out.select("label", "point", "se", *[(F.col("point") + s * c * F.col("se")).alias(n) for n, s, c in (("lo", -1, ordinary), ("hi", 1, ordinary), ("sim_lo", -1, both), ("sim_hi", 1, both))])


def max_abs_projection(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys) interval of the largest absolute disparity over a family."""
    inside = (F.col("lo") <= 0) & (F.col("hi") >= 0)
    return rows.groupBy(*keys).agg(
        F.max(F.abs("point")).alias("point"), F.max(F.when(inside, 0.0).otherwise(F.least(F.abs("lo"), F.abs("hi")))).alias("lo"), F.max(F.greatest(F.abs("lo"), F.abs("hi"))).alias("hi")
    )


def tolerance_class(lo: Column, hi: Column, delta: float) -> Column:
    return F.when((lo >= -delta) & (hi <= delta), "WITHIN").when((lo > delta) | (hi < -delta), "EXCEEDS").otherwise("INSUFFICIENT")


def scope_state(rows: DataFrame, keys: list[str], state: str) -> DataFrame:
    """(keys, state): the worst state, EXCEEDS before INSUFFICIENT before WITHIN."""
    order = F.when(F.col(state) == "EXCEEDS", 3).when(F.col(state) == "INSUFFICIENT", 2).when(F.col(state) == "WITHIN", 1)
    return rows.groupBy(*keys).agg(F.max_by(state, order).alias("state"))


def precision_diagnostics(rows: DataFrame, delta: float) -> DataFrame:
    """Half width, margin, smallest and largest compatible effect, and what the interval rules out."""
    lo, hi, point = F.col("lo"), F.col("hi"), F.col("point")
    largest = F.greatest(F.abs(lo), F.abs(hi))
    inside = (lo <= 0) & (hi >= 0)
    says = F.when(largest <= delta, "RULES_OUT_ABOVE_DELTA").when((lo > delta) | (hi < -delta), "RULES_OUT_WITHIN_TOLERANCE").otherwise("CROSSES_A_BOUNDARY")
    return rows.withColumns(
        {
            "half_width": (hi - lo) / 2,
            "margin": F.greatest(point - lo, hi - point),
            "smallest": F.when(inside, 0.0).otherwise(F.least(F.abs(lo), F.abs(hi))),
            "largest": largest,
            "statement": says,
        }
    )


def tradeoff_class(gap: Column, low: Column, high: Column, other_worse: Column, tol: float = 0.0) -> Column:
    """Five labels from the change of the gap and of both groups' performance."""
    narrowed, better = gap < -tol, low > tol
    return (
        F.when((low < -tol) & (high < -tol), "ALL_GROUPS_WORSE")
        .when(narrowed & better & other_worse, "TARGET_O_IMPROVED_OTHER_O_WORSENED")
        .when(narrowed & better, "GAP_NARROWED_DISADVANTAGED_GROUP_IMPROVED")
        .when(narrowed & (high < -tol) & ~better, "GAP_NARROWED_BY_ADVANTAGED_GROUP_LOSS")
        .otherwise("NO_PREDECLARED_IMPROVEMENT_PATTERN")
    )


def select_constrained(candidates: DataFrame, keys: list[str], tau: float) -> DataFrame:
    """(keys) best balanced accuracy with EO within ``tau``; else the boundary candidate; else NOT_ESTIMABLE."""
    known = F.col("ba").isNotNull() & F.col("eo").isNotNull()
    fits = F.coalesce(known & (F.col("eo") <= tau), F.lit(False))
    rows = candidates.withColumn("_f", fits).withColumn("_k", known)
    w = Window.partitionBy(*keys).orderBy(
        F.desc("_f"), F.desc("_k"), F.when(F.col("_f"), -F.col("ba")).otherwise(F.col("eo")), F.when(F.col("_f"), F.col("eo")).otherwise(-F.col("ba")), "complexity", "candidate"
    )
    best = rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    status = F.when(F.col("_f"), "FEASIBLE").when(F.col("_k"), "NO_FEASIBLE_CONFIGURATION").otherwise("NOT_ESTIMABLE")
    shown = {c: F.when(F.col("_k"), F.col(c)) for c in ("candidate", "ba", "eo")}
    return best.select(*keys, *[v.alias(c) for c, v in shown.items()], status.alias("status"))


def aggregate_seeds(rows: DataFrame, keys: list[str], seeds: int, metrics: list[str]) -> DataFrame:
    """(keys) mean over seeds if all are there and VALID, else null with an INCOMPLETE status."""
    out = rows.groupBy(*keys).agg(F.count_distinct("seed").alias("_n"), F.count_if(F.col("status") != "VALID").alias("_bad"), *[F.avg(m).alias(m) for m in metrics])
    status = F.when(F.col("_n") < seeds, "INCOMPLETE_SEEDS").when(F.col("_bad") > 0, "INCOMPLETE_INVALID").otherwise("VALID")
    out = out.withColumn("status", status)
    return out.withColumns({m: F.when(F.col("status") == "VALID", F.col(m)) for m in metrics}).drop("_n", "_bad")


def seed_summary(rows: DataFrame, keys: list[str], v: str) -> DataFrame:
    """(keys) mean, sd, min, max over seeds; null if any is not finite."""
    whole = F.count(v) == F.count("*")
    return rows.groupBy(*keys).agg(*[F.when(whole, f(v)).alias(n) for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))])
