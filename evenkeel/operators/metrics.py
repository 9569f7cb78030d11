"""Group-fairness and utility metrics from one rate table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_attr, ratio, unpivot

RATES = ("TPR", "FPR", "PPV", "NPV", "ACC", "PPOS", "FDR", "FOR", "FNR", "TNR")
#: Gap name -> the rates whose largest difference it is.
GAPS = {
    "SP": ("PPOS",), "EOpp": ("TPR",), "EO": ("TPR", "FPR"), "CUAE": ("PPV", "NPV"), "OAE": ("ACC",), "FDRP": ("FDR",), "FORP": ("FOR",),
    "FNRB": ("FNR",), "FPRB": ("FPR",), "NPVP": ("NPV",), "PPVP": ("PPV",),
}


def rate_columns(undefined: float | None = 0.0) -> dict[str, Column]:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    pairs = {
        "TPR": (tp, tp + fn), "FPR": (fp, fp + tn), "PPV": (tp, tp + fp), "NPV": (tn, tn + fn), "ACC": (tp + tn, n), "PPOS": (tp + fp, n),
        "FDR": (fp, tp + fp), "FOR": (fn, tn + fn), "FNR": (fn, tp + fn), "TNR": (tn, fp + tn),
    }
    return {k: ratio(a, b, undefined) for k, (a, b) in pairs.items()}


def counts(y: Column, q: Column, w: Column | None = None) -> list[Column]:
    """tp, tn, fp, fn of a decision in [0, 1], weighted if asked."""
    w = F.lit(1) if w is None else w
    return [
        F.sum(w * q * y).alias("tp"),
        F.sum(w * (1 - q) * (1 - y)).alias("tn"),
        F.sum(w * q * (1 - y)).alias("fp"),
        F.sum(w * (1 - q) * y).alias("fn"),
    ]


def confusion_rates(
    df: DataFrame, attrs: list[str], y: str = "y", pred: str = "yhat", classes: tuple[int, ...] = (0, 1), undefined: float | None = 0.0
) -> DataFrame:
    """(attr, grp, cls) one-vs-rest counts and rates; ``undefined`` where a denominator is 0."""
    long = by_attr(df, attrs, [y, pred]).groupBy("attr", "grp", y, pred).agg(F.count("*").alias("n"))
    long = long.withColumn("cls", F.explode(F.array(*[F.lit(c) for c in classes])))
    hit, said = (F.col(y) == F.col("cls")).cast("int"), (F.col(pred) == F.col("cls")).cast("int")
    return long.groupBy("attr", "grp", "cls").agg(*counts(hit, said, F.col("n"))).withColumns(rate_columns(undefined))


def pair_gaps(rates: DataFrame, keys: list[str], of: tuple[str, ...], group: str = "grp") -> DataFrame:
    """Absolute differences of each unordered pair of groups: (keys, grp_a, grp_b, d_*)."""
    a, b = rates.alias("a"), rates.alias("b")
    on = F.col(f"a.{group}") < F.col(f"b.{group}")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, on).select(
        *[F.col(f"a.{k}").alias(k) for k in keys],
        F.col(f"a.{group}").alias("grp_a"),
        F.col(f"b.{group}").alias("grp_b"),
        *[F.abs(F.col(f"a.{r}") - F.col(f"b.{r}")).alias(f"d_{r}") for r in of],
    )


def gap(rates: DataFrame, name: str, eo: str = "max") -> DataFrame:
    """(attr, value): per pair the largest over classes, then the mean over pairs.

    ``eo`` says whether equalised odds takes the larger of both differences or their sum.
    """
    of = GAPS[name]
    d = [F.col(f"d_{r}") for r in of]
    one = d[0] if len(d) == 1 else (d[0] + d[1] if name == "EO" and eo == "sum" else F.greatest(*d))
    pairs = pair_gaps(rates, ["attr", "cls"], of).withColumn("v", one)
    return pairs.groupBy("attr", "grp_a", "grp_b").agg(F.max("v").alias("v")).groupBy("attr").agg(F.avg("v").alias("value"))


def score_balance(df: DataFrame, attrs: list[str], y: str = "y", score: str = "p1") -> DataFrame:
    """(attr, value): gap of the mean score given the true class, largest over classes, mean over pairs."""
    means = by_attr(df, attrs, [y, score]).groupBy("attr", "grp", F.col(y).alias("cls")).agg(F.avg(score).alias("m"))
    pairs = pair_gaps(means, ["attr", "cls"], ("m",))
    return pairs.groupBy("attr", "grp_a", "grp_b").agg(F.max("d_m").alias("v")).groupBy("attr").agg(F.avg("v").alias("value"))


def acc_metrics(df: DataFrame, keys: list[str], y: str = "y", pred: str = "yhat", weighted: bool = False) -> DataFrame:
    """accuracy, f1, recall, precision: of class 1, or weighted by class size."""
    one = df.groupBy(*keys, y, pred).agg(F.count("*").alias("n")).withColumn("cls", F.explode(F.array(F.lit(0), F.lit(1))))
    hit, said = (F.col(y) == F.col("cls")).cast("int"), (F.col(pred) == F.col("cls")).cast("int")
    per = one.groupBy(*keys, "cls").agg(*counts(hit, said, F.col("n")))
    per = per.withColumns(
        {
            "accuracy": ratio(F.expr("tp + tn"), F.expr("tp + tn + fp + fn"), 0.0),
            "recall": ratio(F.col("tp"), F.expr("tp + fn"), 0.0),
            "precision": ratio(F.col("tp"), F.expr("tp + fp"), 0.0),
            "f1": ratio(2 * F.col("tp"), F.expr("2 * tp + fp + fn"), 0.0),
            "support": F.expr("tp + fn"),
        }
    )
    names = ("accuracy", "f1", "recall", "precision")
    if not weighted:
        return per.filter("cls = 1").select(*keys, *names)
    return per.groupBy(*keys).agg(*[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support"), 0.0).alias(m) for m in names])


def all_gaps(df: DataFrame, attrs: list[str], y: str = "y", pred: str = "yhat", score: str = "p1") -> DataFrame:
    """(attr, metric, value) of all thirteen gaps from one rate table."""
    rates = confusion_rates(df, attrs, y, pred)
    used = tuple(dict.fromkeys(r for of in GAPS.values() for r in of))
    pairs = pair_gaps(rates, ["attr", "cls"], used)
    one = {n: F.greatest(*[F.col(f"d_{r}") for r in of]) if len(of) > 1 else F.col(f"d_{of[0]}") for n, of in GAPS.items()}
    worst = pairs.groupBy("attr", "grp_a", "grp_b").agg(*[F.max(c).alias(n) for n, c in one.items()])
    wide = worst.groupBy("attr").agg(*[F.avg(n).alias(n) for n in GAPS])
    out = unpivot(wide, list(GAPS), "metric", "value", ["attr"]).withColumn("value", F.col("value").cast("double"))
    balance = score_balance(df, attrs, y, score)
    for name in ("BNC", "BPC"):
        out = out.unionByName(balance.select("attr", F.lit(name).alias("metric"), "value"))
    return out


def group_metrics(df: DataFrame, attrs: list[str], y: str = "y", pred: str = "yhat") -> DataFrame:
    """(attr, grp) counts, prevalence, selection rate, TPR, FPR and PPV; null where undefined."""
    long = by_attr(df, attrs, [y, pred]).filter(F.col("grp").isNotNull())
    per = long.groupBy("attr", "grp").agg(F.count("*").alias("n"), F.sum(y).alias("positives"), F.sum(pred).alias("selected"), *counts(F.col(y), F.col(pred)))
    r = rate_columns(None)
    return per.select(
        "attr", "grp", "n", "positives", (F.col("n") - F.col("positives")).alias("negatives"), "selected",
        ratio(F.col("positives"), F.col("n")).alias("prevalence"), r["PPOS"].alias("selection_rate"), r["TPR"].alias("tpr"),
        r["FPR"].alias("fpr"), r["PPV"].alias("ppv"),
    )


def fairness_gaps(groups: DataFrame) -> DataFrame:
    """(attr) DP, EOpp, FPR gap and EO over the groups where a rate is defined (two or more)."""

    def spread(c: str) -> Column:
        return F.when(F.count(c) >= 2, F.max(c) - F.min(c))

    return groups.groupBy("attr").agg(spread("selection_rate").alias("dp"), spread("tpr").alias("eopp"), spread("fpr").alias("fpr_gap")).withColumn(
        "eo", F.greatest("eopp", "fpr_gap")
    )


def pairwise_differences(groups: DataFrame) -> DataFrame:
    """(attr, grp_a, grp_b) absolute differences of four rates."""
    return pair_gaps(groups, ["attr"], ("selection_rate", "tpr", "fpr", "ppv"))


def group_coverage(groups: DataFrame, expected: DataFrame) -> DataFrame:
    """(attr) expected and observed groups and pairs, and which expected ones are missing."""
    seen = groups.select("attr", "grp").distinct().withColumn("seen", F.lit(1))
    both = expected.join(seen, ["attr", "grp"], "full")
    return both.join(expected.withColumn("wanted", F.lit(1)), ["attr", "grp"], "left").groupBy("attr").agg(
        F.count("wanted").alias("expected"),
        F.count(F.when(F.col("wanted").isNotNull(), F.col("seen"))).alias("observed"),
        F.expr("count(wanted) * (count(wanted) - 1) div 2").alias("expected_pairs"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("seen").isNull(), F.col("grp")))), ",").alias("missing"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("wanted").isNull(), F.col("grp")))), ",").alias("unexpected"),
    )


def app_fairness(df: DataFrame, expected: DataFrame, attrs: list[str], y: str = "y", pred: str = "yhat") -> DataFrame:
    """(attr) DP, EOpp and EO as max minus min over expected groups, with a status for each."""
    groups = group_metrics(df, attrs, y, pred)
    both = expected.join(groups, ["attr", "grp"], "left")
    agg = both.groupBy("attr").agg(
        F.count("*").alias("wanted"),
        F.count("n").alias("observed"),
        F.min("positives").alias("least_pos"),
        F.min("negatives").alias("least_neg"),
        *[(F.max(c) - F.min(c)).alias(f"g_{c}") for c in ("selection_rate", "tpr", "fpr")],
    )
    common = F.when(F.col("wanted") < 2, "SINGLE_GROUP").when(F.col("observed") < F.col("wanted"), "MISSING_EXPECTED_GROUPS")
    dp_status = common.otherwise("VALID")
    opp_status = common.when(F.col("least_pos") == 0, "MISSING_POSITIVE").otherwise("VALID")
    eo_status = common.when(F.col("least_pos") == 0, "MISSING_POSITIVE").when(F.col("least_neg") == 0, "MISSING_NEGATIVE").otherwise("VALID")
    return agg.select(
        "attr",
        F.when(dp_status == "VALID", F.col("g_selection_rate")).alias("dp"),
        dp_status.alias("dp_status"),
        F.when(opp_status == "VALID", F.col("g_tpr")).alias("eopp"),
        opp_status.alias("eopp_status"),
        F.when(eo_status == "VALID", F.greatest("g_tpr", "g_fpr")).alias("eo"),
        eo_status.alias("eo_status"),
    )


def weighted_confusion(df: DataFrame, keys: list[str], y: str = "y", q: str = "p1", w: str = "w") -> DataFrame:
    """Survey-weighted rates of hard or fractional decisions; null where undefined."""
    per = df.groupBy(*keys).agg(*counts(F.col(y), F.col(q), F.col(w)))
    r = rate_columns(None)
    return per.select(
        *keys, r["PPOS"].alias("sr"), r["TPR"].alias("tpr"), r["TNR"].alias("tnr"), r["FPR"].alias("fpr"), ((r["TPR"] + r["TNR"]) / 2).alias("ba"),
        r["PPV"].alias("ppv"), r["NPV"].alias("npv"), r["ACC"].alias("accuracy"),
    )


def kish(w: Column) -> Column:
    """Kish effective sample size of the positive weights."""
    w = F.when(w > 0, w)
    return ratio(F.pow(F.sum(w), 2), F.sum(w * w))


def survey_fairness(df: DataFrame, expected: DataFrame, attrs: list[str], y: str = "y", q: str = "p1", w: str = "w") -> DataFrame:
    """(attr) gaps of the weighted rates; null unless every expected group is estimable."""
    long = by_attr(df, attrs, [y, q, w])
    per = long.groupBy("attr", "grp").agg(*counts(F.col(y), F.col(q), F.col(w)), F.count("*").alias("n"), kish(F.col(w)).alias("ess"))
    r = rate_columns(None)
    per = expected.join(per, ["attr", "grp"], "left").withColumns({"sr": r["PPOS"], "tpr": r["TPR"], "fpr": r["FPR"]})

    def spread(c: str) -> Column:
        return F.when(F.count(c) == F.count("*"), F.max(c) - F.min(c))

    out = per.groupBy("attr").agg(
        spread("sr").alias("dp"),
        spread("tpr").alias("eopp"),
        spread("fpr").alias("fpr_gap"),
        F.min("n").alias("least_n"),
        F.min("ess").alias("least_ess"),
        F.count("*").alias("groups"),
    )
    both = F.col("eopp").isNotNull() & F.col("fpr_gap").isNotNull()
    return out.withColumn("eo", F.when(both, F.greatest("eopp", "fpr_gap"))).withColumn(
        "status", F.when(both & F.col("dp").isNotNull(), "ESTIMABLE").otherwise("NOT_ESTIMABLE")
    )


def evaluation_comparison(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Before, after and their difference in long form; a side may lack a key."""
    a = unpivot(before, values, "metric", "v", keys).withColumnRenamed("v", "before")
    b = unpivot(after, values, "metric", "v", keys).withColumnRenamed("v", "after")
    out = a.join(b, [*keys, "metric"], "full")
    out = out.withColumns({c: F.col(c).cast("double") for c in ("before", "after")})
    return out.withColumn("delta", F.col("after") - F.col("before"))


def top_delta(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
