"""Study level: candidate grids, contrasts between selections, and whole methods on one arm."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_of, by_attr, ratio
from ..sources.tabular import materialize
from . import geometry as G
from . import inference as I
from . import learners as L
from . import metrics as M
from . import prep as P
from . import ranking as R
from . import reductions as D
from . import search as S
from . import thresholds as T
from .batch_fit import BatchFit, Design, utilities
from .neighbours import nearest
from .splits import stratified_split
from .transforms import apply_state, rebin_target_adjacent


def with_id(df: DataFrame, parts: list[str], name: str) -> DataFrame:
    """Adds a stable id: SHA-256 of the parts, joined."""
    return df.withColumn(name, F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in parts]), 256))


def candidate_grid(dimensions: list[DataFrame], parts: list[str]) -> DataFrame:
    """The product of small dimension tables with an id per row."""
    return with_id(reduce(lambda a, b: a.crossJoin(b), dimensions), parts, "candidate_id")  # registered dimensions


def contrast_family(groups: DataFrame, endpoints: list[str], methods: list[str]) -> DataFrame:
    """(attr, grp, endpoint, method, contrast_id): every group against the rest, per endpoint and method."""
    spark = groups.sparkSession
    e, m = spark.createDataFrame([(x,) for x in endpoints], "endpoint string"), spark.createDataFrame([(x,) for x in methods], "method string")
    out = groups.select("attr", "grp").distinct().crossJoin(e).crossJoin(m)  # registered dimensions
    return with_id(out, ["attr", "grp", "endpoint", "method"], "contrast_id")


def contrast_registry(selections: DataFrame, condition: list[str], method: str, reference: str) -> DataFrame:
    """(condition, reference, comparison, family): pairs of selections under the same condition; primary ones hold the reference."""
    a, b = selections.alias("a"), selections.alias("b")
    on = all_of([F.col(f"a.{c}") == F.col(f"b.{c}") for c in condition] + [F.col(f"a.{method}") != F.col(f"b.{method}")])
    pair = a.join(b, on).filter((F.col(f"a.{method}") == reference) | ((F.col(f"b.{method}") != reference) & (F.col(f"a.{method}") < F.col(f"b.{method}"))))
    family = F.when(F.col(f"a.{method}") == reference, "primary").otherwise("secondary")
    return pair.select(*[F.col(f"a.{c}").alias(c) for c in condition], F.col(f"a.{method}").alias("reference"), F.col(f"b.{method}").alias("comparison"), family.alias("family"))


def join_contrast(registry: DataFrame, results: DataFrame, condition: list[str], method: str, values: list[str]) -> DataFrame:
    """Both sides' values and their differences for each registered contrast."""
    def side(name: str) -> DataFrame:
        return results.select(*condition, F.col(method).alias(name), *[F.col(v).alias(f"{v}_{name}") for v in values])

    out = registry.join(side("reference"), [*condition, "reference"], "left").join(side("comparison"), [*condition, "comparison"], "left")
    return out.withColumns({f"d_{v}": F.col(f"{v}_comparison") - F.col(f"{v}_reference") for v in values})


def projection_mean(bands: DataFrame, keys: list[str]) -> DataFrame:
    """(keys) mean of the seeds' interval bounds; null if one is missing."""
    whole = (F.count("lo") == F.count("*")) & (F.count("hi") == F.count("*"))
    return bands.groupBy(*keys).agg(F.when(whole, F.avg("lo")).alias("lo"), F.when(whole, F.avg("hi")).alias("hi"))


def projection_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys) the interval of a difference of two intervals, inside [-1, 1]."""
    both = a.alias("a").join(b.alias("b"), keys)
    return both.select(*keys, F.greatest(F.col("a.lo") - F.col("b.hi"), F.lit(-1.0)).alias("lo"), F.least(F.col("a.hi") - F.col("b.lo"), F.lit(1.0)).alias("hi"))


def rank_protected_auto(df: DataFrame, candidates: list[str], nums: list[str], k: int) -> DataFrame:
    """(attr, worst, rank): each column in turn as the protected one, the top k by largest concentration.

    All columns are one batch, with the column's name as a group key.
    """
    cat = [G.div_cat(G.cells(df, [a], [c for c in candidates if c != a])) for a in candidates]
    g = reduce(DataFrame.unionByName, cat).unionByName(G.div_num(G.moments(df, candidates, nums)))
    worst = G.embed(G.distances(g, ["attr"]), ["attr"]).groupBy("attr").agg(F.max("dphi").alias("worst"))
    return worst.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("worst"), "attr"))).filter(F.col("rank") <= k)  # a row per column


def nearest_other_group(df: DataFrame, attr: str, a: str, b: str, cols: list[str]) -> DataFrame:
    """(g): mean distance to the nearest row of the other group over any number of features; exact.

    Equal points of a group are one, with their count.  Rows with a null do not count; without rows in both
    groups it is null.  See ``neighbours.nearest``.
    """
    x = F.array(*[F.col(c).cast("double") for c in cols])
    rows = df.filter(F.col(attr).cast("string").isin(a, b)).select(F.col(attr).cast("string").alias("o"), x.alias("x"))
    points = rows.filter(~F.exists("x", lambda v: v.isNull())).groupBy("o", "x").agg(F.count("*").cast("double").alias("label"))
    points = materialize(points.withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.col("row")), "points")
    found = None
    for mine, other in ((a, b), (b, a)):
        near = nearest(points.filter(F.col("o") == mine), points.filter(F.col("o") == other), len(cols), 1, False)
        found = near if found is None else found.unionByName(near)
    both = points.join(found, "row").select(F.col("label").alias("n"), F.get("near", F.lit(0))["d"].alias("d"))
    return both.agg(ratio(F.sum(F.col("d") * F.col("n")), F.sum("n")).alias("g"))


def evaluate_predictions(df: DataFrame, attrs: list[str], y: str = "y", pred: str = "yhat", score: str = "p1") -> DataFrame:
    """(scope, metric, value): utility and gaps in one long table."""
    one = df.withColumn("_all", F.lit("all"))
    utility = R.utility_metrics(one, ["_all"], y, score, pred)
    gaps = M.fairness_gaps(M.group_metrics(df, attrs, y, pred))

    def long(frame: DataFrame, scope: str, names: list[str]) -> DataFrame:
        return frame.select(F.col(scope).alias("scope"), F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))

    return long(utility, "_all", ["auroc", "ap", "ba", "f1", "accuracy"]).unionByName(long(gaps, "attr", ["dp", "eopp", "fpr_gap", "eo"]))


def one_hot(df: DataFrame, fit: DataFrame, cats: list[str], most: int = 1000) -> tuple[DataFrame, list[str]]:
    """``df`` with a 0/1 column for each level of ``fit``, for a missing and for an unknown value, and their names."""
    if not cats:
        return df, []
    vocab = P.vocabulary(fit, cats).orderBy("feature", "pos").limit(most + 1).collect()
    if len(vocab) > most:
        raise ValueError(f"more than {most} levels")
    cols: dict[str, Column] = {}
    for c in cats:
        mine = [r for r in vocab if r.feature == c]
        x, known = F.col(c).cast("string"), [r.level for r in mine if r.level not in ("MISSING", "UNKNOWN")]
        for r in mine:
            hit = x.isNull() if r.level == "MISSING" else ~x.isin(known) if r.level == "UNKNOWN" else x == r.level
            cols[f"{c}_{r.pos}"] = F.coalesce(hit, F.lit(False)).cast("double")
    return df.withColumns(cols), list(cols)


def scored_split(parts: DataFrame, state: dict, cats: list[str], nums: list[str], keep: list[str], y: str) -> DataFrame:
    """Validation and test rows with ``p_event`` of a logistic fit on the training rows, after ``state``, categories one-hot."""
    t = apply_state(parts.select(*keep, *cats, *nums), state, keep)
    train = t.filter("split = 'train'")
    t, hot = one_hot(t, train, [c for c in cats if c in t.columns])
    used = [*[c for c in nums if c in t.columns], *hot]
    if not used:
        t, used = t.withColumn("_one", F.lit(1.0)), ["_one"]
    return L.fit_score(t.filter("split <> 'train'"), t.filter("split = 'train'"), used, y, "lr")


def validation_utility(parts: DataFrame, state: dict, cats: list[str], nums: list[str], keep: list[str], y: str) -> float:
    """Balanced accuracy on the validation rows at its best threshold there; 0 where there is none."""
    return utilities(parts.filter("split <> 'test'"), {"now": state}, cats, nums, keep, y)["now"][0] or 0.0


def enhancements(m: S.Mitigation, cats: list[str], nums: list[str], powers: list[float], pairs: int = 2) -> list[tuple[str, dict]]:
    """(feature, change): other powers of the numeric features, and merges of the ``pairs`` neighbours in target rate."""
    out: list[tuple[str, dict]] = []
    for f in nums:
        if m.state.get(f) != "dropped":
            out += [(f, {"power": p}) for p in [1.0, *powers] if p != m.state.get(f, {}).get("power", 1.0)]
    for f in cats:
        if m.state.get(f) == "dropped":
            continue
        now = m.state.get(f, {}).get("merge", {})
        cell = S.merge_cells(m.cell.filter((F.col("feature") == f) & (F.col("attr") == m.y)), f, now)
        near = rebin_target_adjacent(cell.withColumn("y", F.col("grp").cast("int")), ["feature"]).orderBy("rank").limit(pairs).collect()
        out += [(f, {"merge": S.compose(now, r.low, r.high)}) for r in near]
    return out


def enhance_step(
    parts: DataFrame, m: S.Mitigation, cats: list[str], nums: list[str], keep: list[str], y: str, powers: list[float], slack: float = 0.0, least_gain: float = 1e-6
) -> tuple[list[tuple], tuple | None]:
    """((feature, change, distance, utility, gain, reason) of each candidate, the accepted (feature, change, divergences)).

    A candidate may not raise its feature's distance over epsilon plus ``slack`` for any attribute, must leave
    two values, and is ranked by utility, the balanced accuracy on the validation rows at its own best threshold;
    the best is accepted if it gains ``least_gain`` on the state as it is.  Distances of a feature's candidates
    are one batch; the state as it is and all feasible candidates are fitted together, one scan a Newton step.
    """
    tried: list[list] = []
    every = enhancements(m, cats, nums, powers)
    for f in dict.fromkeys(x for x, _ in every):
        changes = [c for x, c in every if x == f]
        g, _, valid = m.divergences(f, changes)
        states = {i: m.g | {f: g[i]} for i in range(len(changes)) if valid[i] and g[i]}
        far: dict[int, float] = {}
        for i, _, x, d in m.distances(states, f) if states else []:
            if x == f:
                far[i] = max(d, far.get(i, 0.0))
        for i, c in enumerate(changes):
            d = far.get(i)
            reason = "not valid" if d is None else "over epsilon and slack" if d > m.epsilon + slack else ""
            tried.append([f, c, d, None, None, reason, g[i]])
    asked = {str(k): m.state | {t[0]: t[1]} for k, t in enumerate(tried) if not t[5]}
    found = utilities(parts.filter("split <> 'test'"), {"": m.state} | asked, cats, nums, keep, y) if asked else {}
    base = found.get("", (None, ""))[0] or 0.0
    for k, t in enumerate(tried):
        if t[5]:
            continue
        utility, status = found[str(k)]
        if utility is None:
            t[5] = status
        else:
            t[3:5] = utility, utility - base
            t[5] = "no gain" if utility < base + least_gain else ""
    good = [t for t in tried if not t[5]]
    best = max(good, key=lambda t: round(t[3], 12), default=None)
    rows = [(f, json.dumps(c, sort_keys=True), d, u, gain, reason or ("accepted" if t is best else "lower gain")) for t in tried for f, c, d, u, gain, reason, _ in [t]]
    return rows, None if best is None else (best[0], best[1], best[6])


def enhance(parts: DataFrame, m: S.Mitigation, cats: list[str], nums: list[str], keep: list[str], y: str, powers: list[float], slack: float = 0.0, rounds: int = 2) -> list[tuple]:
    """Alternates an enhancement with the mitigation of what it moved, until none gains or ``rounds`` are done.

    A round whose state has a lower utility after mitigation than before is taken back.  The audit rows have
    the round before them.
    """
    audit: list[tuple] = []
    for i in range(rounds):
        rows, best = enhance_step(parts, m, cats, nums, keep, y, powers, slack)
        audit += [(i, *r) for r in rows]
        if best is None:
            break
        state, g = m.state, m.g
        m._take(*best)
        m.run()
        found = utilities(parts.filter("split <> 'test'"), {"before": state, "after": m.state}, cats, nums, keep, y)
        before, after = (found[k][0] or 0.0 for k in ("before", "after"))
        if after < before:
            m.state, m.g = state, g
            audit.append((i, best[0], json.dumps(best[1], sort_keys=True), None, after, after - before, "taken back"))
            break
    return audit


def checkpoint_metrics(parts: DataFrame, states: list[dict], attrs: list[str], cats: list[str], nums: list[str], keep: list[str], y: str, cut: float = 0.5, weight: str | None = None) -> DataFrame:
    """(state, accuracy, dp, eo) on the validation rows of each state of a search, all fitted together.

    A row is decided by its probability against ``cut``.  ``dp`` and ``eo`` are means over attributes of the
    spread of the selection rate, and of the larger spread of TPR and FPR, over groups.
    """
    design = Design(parts, {str(i): s for i, s in enumerate(states)}, cats, nums, [*keep, *([weight] if weight else [])])
    fit = BatchFit(design, y, weight)
    scored = fit.score(design.rows.filter("split = 'val'"), [y, *attrs])
    scored = scored.select(F.col("candidate").cast("int").alias("state"), *attrs, F.col(y).cast("int").alias("y"), (F.col("p_event") >= cut).cast("int").alias("q"))
    scored = materialize(scored, "scored")
    accuracy = scored.groupBy("state").agg(F.avg((F.col("y") == F.col("q")).cast("double")).alias("accuracy"))
    per = by_attr(scored, attrs, ["state", "y", "q"]).filter("grp is not null").groupBy("state", "attr", "grp")
    per = per.agg(F.avg("q").alias("sr"), ratio(F.sum(F.col("q") * F.col("y")), F.sum("y")).alias("tpr"), ratio(F.sum(F.col("q") * (1 - F.col("y"))), F.sum(1 - F.col("y"))).alias("fpr"))
    gap = {c: F.max(c) - F.min(c) for c in ("sr", "tpr", "fpr")}
    by_attribute = per.groupBy("state", "attr").agg(gap["sr"].alias("dp"), F.greatest(gap["tpr"], gap["fpr"]).alias("eo"))
    return accuracy.join(by_attribute.groupBy("state").agg(F.avg("dp").alias("dp"), F.avg("eo").alias("eo")), "state")


def pareto_checkpoint(metrics: DataFrame, tau: float = 0.02, by: str = "eo") -> DataFrame:
    """(state): the one of least ``by`` among those whose accuracy is that of state 0 less ``tau`` or more; ties go to the first."""
    first = metrics.agg(F.max(F.when(F.col("state") == 0, F.col("accuracy"))).alias("_a"))
    ok = metrics.crossJoin(F.broadcast(first)).filter(F.col("accuracy") >= F.col("_a") - tau - 1e-12)  # one row
    return ok.agg(F.min_by("state", F.struct(F.coalesce(F.round(by, 12), F.lit(float("inf"))), "state")).alias("state"))


#: Methods of an arm.
METHODS = ("unmitigated", "reweighing", "thresholds", "reductions", "bm", "bm_ae", "bm_pareto")


def arm_decisions(
    df: DataFrame, key: str, attr: str, attrs: list[str], cats: list[str], nums: list[str], y: str, methods: list[str] = METHODS, carry: list[str] = (),
    powers: list[float] = (3.0, 1 / 3, 5.0, 1 / 5), weight: str | None = None, eps: float = 0.02, **options,
) -> DataFrame:
    """Test rows with the decision of each method in a column of its name: key, y, attrs, ``carry``, methods.

    Splits are stratified by the outcome.  All fits but those of the reductions are logistic on the columns of a
    state; "unmitigated", "bm" (the end of the mitigation search on the training rows), "bm_ae" (then
    alternating enhancement) and "bm_pareto" (the search's state of least EO on the validation rows without
    losing accuracy) are fitted together and decide at their threshold of best balanced accuracy on the
    validation rows; "reweighing" likewise, with rows weighted so that ``attr`` and the outcome are independent;
    "thresholds" equalises the unmitigated scores' odds over ``attr`` on the validation rows, and "reductions"
    is the exponentiated gradient for equalised odds over ``attr``: their decisions are probabilities.
    ``weight`` goes to the search and the fits; ``options`` go to the search.
    """
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"no method {sorted(unknown)}")
    extra = [c for c in dict.fromkeys([*carry, *([weight] if weight else [])]) if c not in (key, y, *attrs)]
    keep = [key, y, *attrs, "split", *extra]
    parts = materialize(stratified_split(df, [y], key).select(*keep, *[c for c in (*cats, *nums) if c not in keep]), "split")
    states: dict[str, dict] = {"unmitigated": {}}
    if {"bm", "bm_ae", "bm_pareto"} & set(methods):
        search = S.Mitigation(parts.filter("split = 'train'"), attrs, cats, nums, y, list(powers), **{"mode": "next", "weight": weight} | options)
        search.run()
        states["bm"] = search.state
        if "bm_pareto" in methods:
            best = pareto_checkpoint(checkpoint_metrics(parts, search.states, attrs, cats, nums, keep[:-len(extra)] if extra else keep, y, weight=weight)).first().state
            states["bm_pareto"] = search.states[best]
        if "bm_ae" in methods:
            enhance(parts, search, cats, nums, keep, y, list(powers)[:2], rounds=1)
            states["bm_ae"] = search.state
    states = {m: s for m, s in states.items() if m in methods or m == "unmitigated"}
    design = Design(parts, states, cats, nums, keep)
    out = BatchFit(design, y, weight).scores(design.rows, [*keep, "x"])
    if "reweighing" in methods:
        train = design.rows.filter("split = 'train'").withColumn("_w", F.lit(1.0) if weight is None else F.col(weight).cast("double"))
        factor = F.broadcast(L.reweighing(train, attr, y, "_w"))  # groups x outcomes
        fair = Design(parts.join(factor, [attr, y], "left").withColumn("_w", F.coalesce("factor", F.lit(0.0)) * (F.lit(1.0) if weight is None else F.col(weight))), {"reweighing": {}}, cats, nums, [*keep, "_w"])
        out = out.join(BatchFit(fair, y, "_w").scores(fair.rows, [key]), key)
        states["reweighing"] = {}
    out = materialize(out, "scored")
    val = out.filter("split = 'val'")
    decided = {}
    for m in states:
        if m in methods:
            cut = R.threshold_search_ba(val, [], y, f"p_{m}").first().threshold
            decided[m] = (F.col(f"p_{m}") >= cut).cast("double")
    test = out.filter("split = 'test'").withColumns(decided)
    if "thresholds" in methods:
        test = T.group_decision(test, materialize(T.group_threshold_eo(val, attr, y, "p_unmitigated"), "policy"), attr, "p_unmitigated", "thresholds")
    if "reductions" in methods:
        cols = [f"x{i}" for i in design.columns["unmitigated"]]
        wide = {f"x{i}": F.get("x", F.lit(i)) for i in design.columns["unmitigated"]}
        game = D.ExponentiatedGradient(out.filter("split = 'train'").withColumns(wide), cols, y, attr, eps=eps, rounds=4)
        test = test.withColumns(wide).withColumn("reductions", game.mix.decision(cols))
    return test.select(key, y, *attrs, *carry, *[m for m in METHODS if m in methods])


def arm_inference(decisions: DataFrame, methods: list[str], groups: list[str], y: str, attr: str, weight: str, replicates: int = 200, alpha: float = 0.05) -> DataFrame:
    """(method, metric, value, taylor_lo, taylor_hi, boot_lo, boot_hi) of balanced accuracy, DP and EO gaps for all methods.

    The rows carry ``stratum`` and ``psu``.  PSU totals of all methods are one scan; both interval methods
    run on them once.  Gaps of the linearised method are projections of simultaneous bands.
    """
    totals = materialize(I.psu_totals(decisions, groups, {m: F.col(m) for m in methods}, F.lit(True), y, attr, weight), "totals")
    df = I.degrees_of_freedom(decisions)
    band = I.bands(totals, I.bonferroni_t(alpha, len(methods) * (2 + 3 * len(groups)), df))
    gaps = I.gap_projection(band)
    ba = I.taylor_ba(totals, I.bonferroni_t(alpha, 1, df)).select("model", F.col("lo").alias("ba_lo"), F.col("hi").alias("ba_hi"))
    flat = gaps.join(ba, "model")
    names = ("ba", "dp", "eo")
    taylor = flat.select("model", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"{n}_lo").alias("taylor_lo"), F.col(f"{n}_hi").alias("taylor_hi")) for n in names])))
    points = materialize(I.point_metrics(totals), "points")
    reps = I.bootstrap_metrics(totals, I.bootstrap_factors(decisions, replicates))
    boot = I.bootstrap_inference(reps, points, list(names), replicates, df, alpha)
    boot = boot.select("model", "metric", F.col("point").alias("value"), F.col("lo").alias("boot_lo"), F.col("hi").alias("boot_hi"))
    out = boot.join(taylor, ["model", "metric"], "full")
    return out.select(F.col("model").alias("method"), "metric", "value", "taylor_lo", "taylor_hi", "boot_lo", "boot_hi")


AUDIT = "round int, feature string, change string, d double, utility double, gain double, reason string"


def benchmark(
    df: DataFrame, key: str, attrs: list[str], cats: list[str], nums: list[str], y: str, method: str, powers: list[float] = (3.0, 1 / 3, 5.0, 1 / 5), **options
) -> DataFrame:
    """(method, scope, metric, value) on the test split: split, transform or not, fit, threshold on validation, evaluate.

    ``method`` is "unmitigated", "bm" (the state of the mitigation search on the training rows) or "bm_ae"
    (then alternating enhancement on training and validation rows).  Categories, merged or not, enter the fit
    one-hot.  ``options`` go to the search.
    """
    keep = [key, y, *attrs, "split"]
    parts = materialize(stratified_split(df, [y], key).select(*keep, *cats, *nums), "split")
    state: dict = {}
    if method != "unmitigated":
        search = S.Mitigation(parts.filter("split = 'train'"), attrs, cats, nums, y, list(powers), **{"mode": "next"} | options)
        state = search.run()
        if method == "bm_ae":
            enhance(parts, search, cats, nums, keep, y, list(powers)[:2], rounds=1)
            state = search.state
    scored = materialize(scored_split(parts, state, cats, nums, keep, y), "scored")
    cut = R.threshold_search_ba(scored.filter("split = 'val'"), [], y, "p_event").first().threshold
    test = scored.filter("split = 'test'").withColumn("yhat", (F.col("p_event") >= cut).cast("int"))
    return evaluate_predictions(test, attrs, y, "yhat", "p_event").withColumn("method", F.lit(method))
