"""Feature transforms and the state that records them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quantile_cuts, running

#: The largest finite 32-bit float.
FLOAT32_MAX = 3.4028234663852886e38


def power(x: Column, p: Column | float) -> Column:
    """Sign-preserving power."""
    return F.signum(x) * F.pow(F.abs(x), F.lit(p) if isinstance(p, (int, float)) else p)


def log_transform(x: Column, base: float) -> Column:
    return F.abs(F.ln(F.abs(x) + 1e-5) / F.ln(F.lit(float(base)))) * F.signum(x)


def arcsin_transform(x: Column, low: Column, high: Column, p: float) -> Column:
    """Rescaled to [-1, 1], arcsine, then the sign-preserving power."""
    unit = F.when(high > low, 2 * (x - low) / F.nullif(high - low, F.lit(0.0)) - 1).otherwise(0.0)
    return power(F.asin(F.least(F.greatest(unit, F.lit(-1.0)), F.lit(1.0))), p)


def multi_beta(x: Column, stream: Column, k: int, kind: str) -> Column:
    """t1: the k-th power; t2: product of the first k powers; t3: their sum."""
    if kind == "t1":
        return power(x, F.get(stream, F.lit(k - 1)))
    first = F.slice(stream, 1, k)
    if kind == "t2":
        return F.aggregate(first, F.lit(1.0), lambda acc, p: acc * power(x, p))
    return F.aggregate(first, F.lit(0.0), lambda acc, p: acc + power(x, p))


def beta_mix(a: Column, b: Column, alpha: float) -> Column:
    return alpha * a + (1 - alpha) * b


def exponent_stream(mode: str, length: int = 10, up_to: int = 1999) -> Column:
    """d4A: odd integers from 3; d4B: their reciprocals; official: both, interleaved, up to a limit."""
    odd = F.sequence(F.lit(3), F.lit(2 * length + 1 if mode != "official" else up_to), F.lit(2))
    if mode == "d4A":
        return F.transform(odd, lambda i: i.cast("double"))
    if mode == "d4B":
        return F.transform(odd, lambda i: 1.0 / i)
    return F.flatten(F.transform(odd, lambda i: F.array(i.cast("double"), 1.0 / i)))


def overflows(largest: Column, p: Column | float) -> Column:
    """Whether any power leaves the 32-bit float range, from the cached largest magnitude."""
    p = F.lit(p) if isinstance(p, (int, float)) else p
    return F.when(largest > 0, p * F.ln(largest) > F.ln(F.lit(FLOAT32_MAX))).otherwise(F.lit(False))


def merge_categories(x: Column, mapping: Column) -> Column:
    """All keys at once; keys are text, so 3 and '3' are the same."""
    return F.coalesce(F.try_element_at(mapping, x.cast("string")), x.cast("string"))


def compose_mapping(old: Column, new: Column) -> Column:
    """The old mapping, then the new one on its results; what was merged stays merged."""
    followed = F.transform_values(old, lambda k, v: F.coalesce(F.try_element_at(new, v), v))
    return F.map_concat(followed, F.map_filter(new, lambda k, v: ~F.map_contains_key(old, k)))


def apply_state(df: DataFrame, state: dict, keep: list[str] = ()) -> DataFrame:
    """One select for a whole state: {feature: "dropped" | {"power": p} | {"merge": {old: new}}}."""
    cols = []
    for c in df.columns:
        change = None if c in keep else state.get(c)
        if change == "dropped":
            continue
        if isinstance(change, dict) and "power" in change:
            cols.append(power(F.col(c), change["power"]).alias(c))
        elif isinstance(change, dict):
            pairs = [x for k, v in change["merge"].items() for x in (F.lit(str(k)), F.lit(str(v)))]
            cols.append(merge_categories(F.col(c), F.create_map(*pairs)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(cols)


def validity_check(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature) nulls, infinities and distinct values, with a status."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("string").try_cast("double")
        aggs.append(F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(F.abs(x) == float("inf")).alias("n_inf"), F.count_distinct(c).alias("n_distinct")))
    out = df.agg(F.array(*aggs).alias("r")).select(F.inline("r"))
    status = F.when(F.col("n_null") > 0, "NULLS").when(F.col("n_inf") > 0, "INFINITE").when(F.col("n_distinct") < 2, "COLLAPSED").otherwise("VALID")
    return out.withColumn("status", status)


def rebin_r1(cell: DataFrame, most: int = 5) -> DataFrame:
    """(attr, feature, grp_a, grp_b, rank, src, dst, gap): merge the i-th highest share gap into the i-th lowest."""
    share = cell.withColumn("p", F.col("sw") / F.sum("sw").over(Window.partitionBy("attr", "grp", "feature")))
    groups = share.select("attr", "feature", "grp").distinct()
    a, b = groups.alias("a"), groups.alias("b")
    on = (F.col("a.attr") == F.col("b.attr")) & (F.col("a.feature") == F.col("b.feature")) & (F.col("a.grp") < F.col("b.grp"))
    pairs = a.join(b, on).select("a.attr", "a.feature", F.col("a.grp").alias("grp_a"), F.col("b.grp").alias("grp_b"))
    side = F.inline(F.array(F.struct(F.col("grp_a").alias("grp"), F.lit(-1.0).alias("sign")), F.struct(F.col("grp_b").alias("grp"), F.lit(1.0).alias("sign"))))
    key = ["attr", "feature", "grp_a", "grp_b"]
    diff = pairs.select(*key, side).join(share, ["attr", "feature", "grp"]).groupBy(*key, "category").agg(F.round(F.sum(F.col("sign") * F.col("p")), 12).alias("diff"))
    down = Window.partitionBy(*key).orderBy(F.desc("diff"), "category")
    up = Window.partitionBy(*key).orderBy("diff", F.desc("category"))
    ranked = diff.withColumns({"hi": F.row_number().over(down), "lo": F.row_number().over(up)})
    src = ranked.select(*key, F.col("hi").alias("rank"), F.col("category").alias("src"), F.col("diff").alias("ds"))
    dst = ranked.select(*key, F.col("lo").alias("rank"), F.col("category").alias("dst"), F.col("diff").alias("dd"))
    out = src.join(dst, [*key, "rank"]).filter((F.col("src") != F.col("dst")) & (F.col("rank") <= most))
    return out.select(*key, "rank", "src", "dst", F.abs(F.col("ds") - F.col("dd")).alias("gap"))


def rebin_r2(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst): the second-rarest category into the rarest."""
    w = Window.partitionBy(*keys).orderBy("n", "category")
    ranked = counts.withColumn("r", F.row_number().over(w)).filter("r <= 2")
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("r") == 2, F.col("category"))).alias("src"), F.max(F.when(F.col("r") == 1, F.col("category"))).alias("dst")).filter("src is not null")


def rebin_target_r1(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, gap): the categories of largest and smallest count gap between y = 1 and y = 0."""
    gap = counts.groupBy(*keys, "category").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(-F.col("n"))).alias("g"))
    out = gap.groupBy(*keys).agg(F.max(F.struct("g", "category")).alias("hi"), F.min(F.struct("g", "category")).alias("lo"))
    return out.select(*keys, F.col("hi.category").alias("src"), F.col("lo.category").alias("dst"), (F.col("hi.g") - F.col("lo.g")).alias("gap"))


def rebin_target_adjacent(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, high, diff, rank): neighbours in positive rate, closest first."""
    rate = counts.groupBy(*keys, "category").agg((F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("r"))
    rate = rate.withColumn("r", F.round("r", 12))
    w = Window.partitionBy(*keys).orderBy("r", "category")
    out = rate.withColumns({"low": F.lag("category").over(w), "was": F.lag("r").over(w)}).filter("low is not null")
    out = out.select(*keys, "low", F.col("category").alias("high"), F.round(F.col("r") - F.col("was"), 12).alias("diff"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("diff", "low")))


def average_rank(df: DataFrame, col: str, key: str) -> DataFrame:
    """(key, rank) with ties averaged, from a count per distinct value."""
    known = df.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    points = running(known, [], "v", {"n": F.lit(1)}, cuts=quantile_cuts(known, "v"))
    points = points.select(F.col("v"), (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))
    return df.select(key, F.col(col).cast("double").alias("v")).join(points, "v").select(key, "rank")


def transform_audit(df: DataFrame, key: str, before: str, after: str, grp: str) -> DataFrame:
    """(spearman, gap_before, gap_after): rank correlation, and the widest difference of group means."""
    a = average_rank(df, before, key).withColumnRenamed("rank", "ra")
    b = average_rank(df, after, key).withColumnRenamed("rank", "rb")
    corr = a.join(b, key).agg(F.corr("ra", "rb").alias("spearman"))
    means = df.groupBy(grp).agg(F.avg(before).alias("mb"), F.avg(after).alias("ma"))
    gaps = means.agg((F.max("mb") - F.min("mb")).alias("gap_before"), (F.max("ma") - F.min("ma")).alias("gap_after"))
    return corr.crossJoin(gaps)  # one row each


def state_equivalence(a: DataFrame, b: DataFrame) -> DataFrame:
    """(feature, equal): states (feature, kind, power) equal up to float tolerance, same keys."""
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, F.col("x.feature") == F.col("y.feature"), "full")
    near = F.abs(F.col("x.power") - F.col("y.power")) <= 1e-9 + 1e-7 * F.abs(F.col("y.power"))
    same = (F.col("x.kind") == F.col("y.kind")) & ((F.col("x.power").isNull() & F.col("y.power").isNull()) | near)
    return both.select(F.coalesce("x.feature", "y.feature").alias("feature"), F.coalesce(same, F.lit(False)).alias("equal"))


def replay_states(trace: list[tuple[str, str, object]]) -> list[dict]:
    """States 0 to K of accepted steps: merges compose on the state before, powers restart, drops are final."""
    states: list[dict] = [{}]
    for feature, kind, value in trace:
        state = dict(states[-1])
        if state.get(feature) == "dropped":
            pass
        elif kind == "drop":
            state[feature] = "dropped"
        elif kind == "power":
            state[feature] = {"power": value}
        else:
            old = state.get(feature, {}).get("merge", {})
            followed = {k: value.get(v, v) for k, v in old.items()}
            state[feature] = {"merge": followed | {k: v for k, v in value.items() if k not in followed}}
        states.append(state)
    return states


def merge_review_flags(mapping: DataFrame) -> DataFrame:
    """(feature, target) of a merge table (feature, code, target): what a reviewer should see."""
    per = mapping.groupBy("feature", "target").agg(
        F.count("*").alias("codes"), F.min("code").alias("lo"), F.max("code").alias("hi"), F.count_if(F.col("code") < 0).alias("missing"), F.count_if(F.col("code") >= 0).alias("substantive")
    )
    targets = mapping.groupBy("feature").agg(F.count_distinct("target").alias("targets"))
    return per.join(targets, "feature").select(
        "feature", "target", "codes", ((F.col("missing") > 0) & (F.col("substantive") > 0)).alias("missing_pooled"),
        (F.col("hi") - F.col("lo") + 1 != F.col("codes")).alias("non_contiguous"), (F.col("targets") == 1).alias("all_collapsed"),
    )
