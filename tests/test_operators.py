"""Small hand-computed cases, and brute force where SQL has no twin."""

import collections
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from greengrain.functions import boosting, exprs, fits, ranks, staging
from greengrain.functions.ordered import exact_quantiles, row_numbers, weighted_quantiles
from greengrain.operators import assortment as so
from greengrain.operators import audit, kmeans, network, pairs
from greengrain.operators import calendar as cal
from greengrain.operators import elasticity as el
from greengrain.operators import scenario as sc
from greengrain.sources import checks, mart, rules


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_weekly_tail_is_taken_after_days_are_added(spark):
    facts = spark.createDataFrame([(0, 0, 100.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 100.0)], "scenario int, day int, p double")
    r = sc.weekly_risk(facts, F.col("p"), risk=1.0).first()
    assert (r.expected, r.lower_tail, r.objective) == (100.0, 100.0, 100.0)


def test_lower_tail(spark):
    df = spark.createDataFrame([(v,) for v in (10.0, -5.0, 3.0, -1.0)], "v double")
    assert df.agg(sc.tail_mean("v", 0.5)).first()[0] == -3.0


def test_change_violation(spark):
    plan = spark.createDataFrame([("A", 0, 0.55), ("A", 1, 0.70), ("A", 2, 0.65), ("B", 0, 0.25), ("B", 1, 0.3), ("B", 2, 0.2)],
                                 "category_name string, day int, markup double")
    bounds = spark.createDataFrame([("A", 0.5, 0.1), ("B", 0.2, 0.1)], "category_name string, markup_reference double, markup_change double")
    assert sc.change_violation(plan, bounds).first()[0] == pytest.approx(0.05)


def test_goodwill_and_accounting(spark):
    df = spark.createDataFrame([(12.0, 6.0, 10.0, 10.0, 0.0)], "demand double, cost double, price double, order_qty double, loss_rate double")
    r = sc.account(df, 0.1).first()
    assert (r.sales, r.goodwill) == (10.0, pytest.approx(0.8)) and r.operating == pytest.approx(40.0)


def test_wrong_sign_falls_back_to_pooled(spark):
    est = spark.createDataFrame([("A", 0.27, -0.245, 0.1, 0.1), ("B", -0.5, -0.245, 0.1, -0.2)],
                                "category_name string, elasticity_raw double, pooled_elasticity double, bootstrap_se double, ci_upper double")
    used = dict(rows(el.shrink(est), "category_name", "elasticity_used"))
    assert used["A"] == pytest.approx(-0.245) and -0.5 <= used["B"] <= -0.245


def test_bound_hits(spark):
    plan = spark.createDataFrame([("A", 0.70), ("A", 0.65), ("B", 1.20), ("B", 1.10)], "category_name string, markup double")
    bounds = spark.createDataFrame([("A", 0.70), ("B", 1.20)], "category_name string, markup_high double")
    assert sc.bound_hits(plan, bounds).first().upper_bound_hits == 2


def test_posterior_share(spark):
    shares = spark.createDataFrame([("A", "x", 1.0, 0.5), ("B", "x", 9.0, 0.25), ("C", "x", 0.0, 0.25)],
                                   "sku_code string, category_name string, share_qty double, long_share double")
    kappas = spark.createDataFrame([("x", 10.0)], "category_name string, kappa double")
    assert dict(rows(so.posterior_shares(shares, kappas), "sku_code", "eb_share"))["C"] == pytest.approx(0.125)


def test_plan_outcomes(spark):
    rows_ = spark.createDataFrame([(0, "A", "x", 20.0, 4.0), (1, "A", "x", 5.0, 6.0)],
                                  "scenario int, sku_code string, category_name string, demand double, cost double")
    facts = so.plan_facts(rows_.select("*", F.lit(10.0).alias("price"), F.lit(10.0).alias("order_qty"), F.lit(0.2).alias("loss_rate")))
    assert rows(facts, "scenario", "sales", "profit") == [(0, 8.0, 40.0), (1, 5.0, -10.0)]
    demand = spark.createDataFrame([(0, "x", 20.0), (1, "x", 5.0)], "scenario int, category_name string, category_demand double")
    loss = [r.service_loss for r in so.scenario_outcomes(facts, demand).orderBy("scenario").collect()]
    assert loss == [pytest.approx(0.6), pytest.approx(0.0)]


def test_representatives_keep_both_ends(spark):
    d = spark.createDataFrame([(i, "x", float(i)) for i in range(6)], "scenario int, category_name string, category_demand double")
    got = [r[0] for r in rows(so.representatives(d, 3), "scenario")]
    assert got[0] == 0 and got[-1] == 5 and len(got) == 3


def test_set_overlap(spark):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "k string")
    assert network.set_overlap(df("A", "B"), df("B", "C"), ["k"]).first().jaccard == pytest.approx(1 / 3)
    assert network.set_overlap(df(), df(), ["k"]).first().jaccard == 1.0


def test_base_scenario_needs_five_packages(spark):
    five = ["anonymous_basket", "batch_loss_quality", "inventory_stockout", "promotion_display_traffic", "supplier_quote_fulfillment"]
    held = [("a", p) for p in five] + [("b", p) for p in audit.PACKAGES] + [("c", "weather_calendar")]
    sets = audit.package_sets(spark.createDataFrame(held, "o string, p string"), "o", "p")
    best = audit.minimum_portfolios(sets).where("scenario = 'base_core'").collect()
    assert len(best) == 1 and list(best[0].packages) == five and best[0].deletion_minimal


def test_bh_matches_the_definition(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.uniform(size=200), 2)
    df = spark.createDataFrame([(i, "g", float(v)) for i, v in enumerate(p)], "i int, g string, p_value double")
    got = [r.q_value for r in pairs.fdr(df, ["g"]).orderBy("i").collect()]
    want = [min(1.0, min(v * len(p) / np.sum(p <= v) for v in p[p >= x])) for x in p]
    assert got == pytest.approx(want)


def test_hot_group_quantiles_and_ranks(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([np.round(rng.normal(size=3000), 1), rng.normal(size=2000)])
    df = spark.createDataFrame([("g", i, float(x), float(1 + i % 3)) for i, x in enumerate(v)], "g string, i int, v double, w double")
    q = exact_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    assert [q.a, q.b, q.c] == pytest.approx(list(np.quantile(v, [0.1, 0.5, 0.99])))
    placed = row_numbers(df, ["g"], "v", ["i"]).orderBy("rn").select("rn", "i").collect()
    assert [r.rn for r in placed] == list(range(1, 5001)) and [r.i for r in placed] == list(np.lexsort((np.arange(5000), v)))
    order = np.argsort(v, kind="stable")
    w = (1 + np.arange(5000) % 3)[order].astype(float)
    want = np.interp([0.1, 0.5, 0.9], (np.cumsum(w) - w / 2) / w.sum(), v[order])
    got = weighted_quantiles(df, ["g"], "v", "w", ["i"], {"a": 0.1, "b": 0.5, "c": 0.9}).first()
    assert [got.a, got.b, got.c] == pytest.approx(list(want))


def plain_spearman(x, y):
    """Average ranks by counting, then Pearson."""
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    a, b = rank(x), rank(y)
    a, b = a - a.mean(), b - b.mean()
    scale = math.sqrt((a * a).sum() * (b * b).sum())
    return (a * b).sum() / scale if scale else 0.0


def series(spark, values, group="g"):
    rows = [(group, e, [None if v is None or math.isnan(v) else float(v) for v in x]) for e, x in values.items()]
    return spark.createDataFrame(rows, "g string, e string, series array<double>")


def test_rank_correlation_uses_common_days_only(spark):
    x = [1.0, 2.0, None, 4.0, 3.0] * 10
    y = [2.0, None, 5.0, 8.0, 6.0] * 10
    df = series(spark, {"a": x, "b": y})
    r = pairs.rank_correlation(df, "e").first()
    assert (r.source, r.target, r.n_days) == ("a", "b", 30) and r.r == pytest.approx(1.0)
    assert pairs.rank_correlation(df, "e", min_days=31).count() == 0


def test_blocks_hold_every_pair_once(spark):
    """Series with gaps and ties in blocks of three: all pairs, with their p value and interval, as one by one."""
    rng = np.random.default_rng(4)
    values = {f"e{i}": np.where(rng.random(70) < (0.1 if i % 2 else 0.0), np.nan, rng.integers(0, 9, 70)).tolist() for i in range(11)}
    values["flat"] = [1.0] * 70
    df = series(spark, values).unionByName(series(spark, {"e1": values["e1"], "other": values["e2"]}, "h"))
    got = pairs.rank_correlation(df, "e", ["g"], p_values=True, interval={"min_abs_r": None, "reps": 60}, block=3).collect()
    assert len(got) == 12 * 11 // 2 + 1 and len({(r.g, r.source, r.target) for r in got}) == len(got)
    starts = ranks.block_starts(pairs.SEED, 60, 10)
    for r in got:
        x, y = (np.array(values[{"other": "e2"}.get(e, e)]) for e in (r.source, r.target))
        seen = np.isfinite(x) & np.isfinite(y)
        x, y, n = x[seen], y[seen], int(seen.sum())
        want = plain_spearman(x, y)
        assert r.source < r.target and r.n_days == n and r.r == pytest.approx(want, abs=1e-12)
        assert r.p_value == pytest.approx(ranks.student_p(want, n), abs=1e-12)
        days = (starts[:, :-(-n // 7), None] % (n - 6) + np.arange(7)).reshape(60, -1)[:, :n]
        draws = [plain_spearman(x[d], y[d]) for d in days]
        assert [r.ci_lower, r.ci_upper] == pytest.approx(list(np.percentile(draws, [2.5, 97.5])), abs=1e-12)
        assert r.same_sign == pytest.approx(np.mean(np.sign(draws) == np.sign(want)))
    gated = pairs.rank_correlation(df.where("g = 'g'"), "e", interval={"min_abs_r": 0.2, "reps": 60}, block=3).collect()
    assert all((abs(r.r) >= 0.2) == (r.ci_lower is not None) for r in gated)


def test_two_thousand_series(spark):
    """Many entities: every pair once, and some of them against the plain version."""
    rng = np.random.default_rng(5)
    values = rng.normal(size=(2000, 40)).round(1)
    df = spark.createDataFrame([(f"s{i:04d}", v.tolist()) for i, v in enumerate(values)], "e string, series array<double>").repartition(4)
    found = pairs.rank_correlation(df, "e", block=256)
    total, distinct = found.agg(F.count(F.lit(1)), F.count_distinct("source", "target")).first()
    assert total == distinct == 2000 * 1999 // 2
    for r in found.where("source = 's0007' and target < 's0040'").collect():
        assert r.r == pytest.approx(plain_spearman(values[7], values[int(r.target[1:])]), abs=1e-12)


def test_day_bits_match_the_days(spark):
    rng = np.random.default_rng(6)
    values = {f"e{i}": [None if rng.random() < 0.2 else float(rng.integers(0, 3)) for _ in range(150)] for i in range(4)}
    got = {(r.source, r.target): (r.both_days, r.either_days) for r in pairs.active_overlap(series(spark, values), "e").collect()}
    for (a, b), found in got.items():
        seen = [(x, y) for x, y in zip(values[a], values[b]) if x is not None and y is not None]
        assert found == (sum(x > 0 and y > 0 for x, y in seen), sum(x > 0 or y > 0 for x, y in seen))
    assert len(got) == 6


def test_most_rows_share_a_value(spark):
    """One value on 90 % of the rows: exact positions, and no range holds more than a part of them."""
    from greengrain.functions import ordered
    rows = [("g", 5.0 if i % 10 else float(i % 7), f"name{i * 7919 % 5000:05d}") for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, v double, name string")
    old, ordered.RANGE_ROWS = ordered.RANGE_ROWS, 100
    try:
        got = ordered.row_numbers(df, ["g"], "v", ["name"]).collect()
        ranged = ordered.with_range(df, ["g"], "v", 100).groupBy("_range").agg(F.count_distinct("v").alias("k"), F.count(F.lit(1)).alias("n")).collect()
    finally:
        ordered.RANGE_ROWS = old
    want = {n: k for k, (_, _, n) in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}
    assert {r.name: r.rn for r in got} == want and all(r.n == 5000 for r in got)
    assert max((r.n for r in ranged if r.k > 1), default=0) < 500


def test_band_is_filled(spark):
    """Two small orders take the minimum, the others share the rest; a band below all minimum orders keeps them."""
    rows = [("a", s, b, 20.0) for s, b in (("s1", 0.1), ("s2", 0.2), ("s3", 3.0), ("s4", 6.0))] + [("b", "s1", 4.0, 1.0), ("b", "s2", 1.0, 1.0)]
    got = so.fill_band(spark.createDataFrame(rows, "v string, sku_code string, base_order double, total double"), ["v"]).collect()
    assert {(r.v, r.sku_code): round(r.order_qty, 9) for r in got} == {
        ("a", "s1"): 2.5, ("a", "s2"): 2.5, ("a", "s3"): 5.0, ("a", "s4"): 10.0, ("b", "s1"): 2.5, ("b", "s2"): 2.5}


def test_ledger_quality(spark):
    rows = [("c", "p", "2020-01-01", 1.0, False, 2.0), ("c", "p", "2020-01-01", 1.0, False, 2.0), ("c", "q", "2020-01-02", 3.0, True, 2.0),
            ("c", "q", "2020-01-03", 1.0, False, 90.0), ("c", "r", "2020-01-03", 2.0, False, 3.0), ("unknown", "x", "2020-01-03", 1.0, False, None)]
    lines = spark.createDataFrame(rows, "category_name string, sku string, date string, quantity double, is_return boolean, price double")
    got = {r.category_name: r for r in checks.ledger_quality(lines).collect()}
    c = got["c"]
    assert (c.row_count, c.returns, c.duplicate_lines, c.zero_sale_cost_pairs, c.q1, c.q3, c.outliers) == (5, 1, 1, 1, 2.0, 3.0, 1)
    assert got["unknown"].row_count == got["unknown"].null_prices == 1


def test_many_starts_find_separate_groups(spark):
    """Three far groups, several starts and two replicates: the best start finds them, however the rows are blocked."""
    rng = np.random.default_rng(7)
    points = [(g, f"e{i:03d}", *(np.array([i % 3 * 50.0, -(i % 3) * 30.0]) + rng.normal(size=2))) for g in (0, 1) for i in range(60)]
    df = spark.createDataFrame([(g, e, float(a), float(b)) for g, e, a, b in points], "grp int, e string, a double, b double")
    groups = spark.createDataFrame([(0, 3), (1, 2)], "grp int, k int")
    cost = {}
    for rows in (1000, 7):
        blocks = kmeans.blocks_of(df, "e", ["a", "b"], groups, rows)
        best = kmeans.best_start(kmeans.fit(blocks, 8), 8)
        found = kmeans.labels(blocks, best, "e").where("grp = 0").collect()
        assert len(found) == 60 and len({(int(r.e[1:]) % 3, r.cluster_id) for r in found}) == 3
        cost[rows] = {r.grp: r.cost for r in best.collect()}
    x = np.array([p[2:] for p in points if p[0] == 0])
    want = sum(((x[i::3] - x[i::3].mean(axis=0)) ** 2).sum() for i in range(3))
    assert cost[1000][0] == pytest.approx(want) and cost[7] == pytest.approx(cost[1000]) and cost[1000][1] > 1000


def test_boosting_splits_at_the_best_place():
    """One tree of two leaves against every cut tried one by one; more rounds fit better."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 3)).round(2)
    y = np.where(x[:, 1] > 0.3, 4.0, -1.0) + rng.normal(size=120) / 10
    model = boosting.Trees(rounds=1, step=1.0, leaves=2, least=5, ridge=0.0, bins=1000).fit(x, y)
    best = min((((y[m] - y[m].mean()) ** 2).sum() + ((y[~m] - y[~m].mean()) ** 2).sum())
               for f in range(3) for cut in np.unique(x[:, f])[:-1] for m in [x[:, f] <= cut] if 5 <= m.sum() <= 115)
    assert ((y - model.predict(x)) ** 2).sum() == pytest.approx(best)
    errors = [((y - boosting.Trees(rounds=n).fit(x, y).predict(x)) ** 2).mean() for n in (1, 20, 200)]
    assert errors[0] > errors[1] > errors[2]


def test_missing_interval_is_not_clear(spark):
    df = spark.createDataFrame([(0.5, None, None), (0.5, 0.2, 0.7), (0.5, -0.1, 0.7), (0.2, None, None), (-0.4, -0.6, -0.1)],
                               "r double, lo double, hi double")
    got = [r[0] for r in df.select(pairs.strength("r", "lo", "hi")).collect()]
    assert got == ["retained", "clear", "retained", "weak", "clear"]


def test_all_pairs_once(spark):
    df = spark.createDataFrame([(f"e{i:02d}", [float(i)]) for i in range(23)], "e string, series array<double>")
    found = pairs.entity_pairs(df, "e").select("source", "target").collect()
    assert len(found) == len(set(found)) == 23 * 22 // 2


def test_student_p():
    # t distribution with 10 degrees of freedom: P(|t| > 2.228139) = 0.05
    t, n = 2.2281388519649385, 12
    assert ranks.student_p(t / math.sqrt(t * t + n - 2), n) == pytest.approx(0.05, abs=1e-9)
    assert ranks.student_p(0.0, 50) == pytest.approx(1.0, abs=1e-9)


def test_fits_recover_parameters():
    rng = np.random.default_rng(3)
    by = {f[0]: f for f in fits.fit_all(rng.gamma(3.0, 2.0, 20000))}
    assert by["Gamma"][1] == pytest.approx(3.0, rel=0.05) and by["Gamma"][2] == pytest.approx(2.0, rel=0.05)
    assert min(by.values(), key=lambda f: f[4])[0] == "Gamma"
    by = {f[0]: f for f in fits.fit_all(5.0 * rng.weibull(1.7, 20000))}
    assert by["Weibull"][1] == pytest.approx(1.7, rel=0.05) and by["Weibull"][2] == pytest.approx(5.0, rel=0.05)
    assert fits.gamma_cdf(1.0, np.array([1.0]))[0] == pytest.approx(1 - math.exp(-1))


def test_span_calendar_keeps_outside_null(spark):
    d = lambda i: dt.date(2024, 1, i)
    df = spark.createDataFrame([("a", d(2), 1.0), ("a", d(4), 2.0), ("b", d(1), 1.0), ("b", d(5), 1.0)], "e string, date date, q double")
    got = [r.q for r in cal.span_calendar(df, "e", "q").where("e = 'a'").orderBy("date").collect()]
    assert got == [None, 1.0, 0.0, 2.0, None]


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "source string, target string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "n string")
    assert rows(network.components(edges, nodes, "n"), "n", "community") == [
        ("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f")]


def test_demand_level_has_no_cap(spark):
    got = spark.createDataFrame([(12.0,), (20.0,), (-30.0,), (None,)], "x double").select(exprs.level_from_log("x")).collect()
    assert [r[0] for r in got] == [pytest.approx(math.expm1(12)), pytest.approx(math.expm1(20)), 0.0, None]


def test_fixed_keeps_large_values(spark):
    got = spark.createDataFrame([(1e13,), (1e300,), (-2.5e-7,), (1.23456789,)], "x double").select(exprs.fixed("x")).collect()
    assert [r[0] for r in got] == [1e13, 1e300, 0.0, 1.234568]


LEDGER = "date date, sku long, is_return boolean, quantity double, amount double, discount double, loss double"


def test_mart_keeps_weights_and_unknown_skus(spark):

    day = dt.date(2024, 1, 1)
    rows = [(day, 1, False, 0.396, 2.5, 0.1, 0.02)] * 3 + [(day, 2, False, 2.0, 4.0, 0.0, 0.0)]
    sums = mart.daily_sku_sums(spark.createDataFrame(rows, LEDGER))
    known = spark.createDataFrame([(1, "c", "i", "s", 1.25)], "sku long, category_name string, item_name string, sku_name string, unit_cost double")
    got = {r["category_name"]: r for r in mart.roll_up(mart.attach_dimension(sums, known), ["category_name"]).collect()}
    assert got["c"]["gross_sales_qty"] == 1.188 and got["c"]["gross_revenue"] == 6.75 and got["c"]["wholesale_price"] == pytest.approx(1.25)
    assert got["unknown"]["gross_sales_qty"] == 2.0 and got["unknown"]["wholesale_price"] is None
    with pytest.raises(Exception, match="decimal places"):
        mart.daily_sku_sums(spark.createDataFrame([(day, 1, False, 0.3961, 2.5, 0.1, 0.02)], LEDGER)).collect()


def test_information_score_against_definition():

    rng = np.random.default_rng(2)
    x = rng.normal(size=300).round(1)
    for y in (rng.normal(size=300), x ** 2 + rng.normal(size=300) / 5, x):
        n, best = 300, 0.0
        place = lambda v: np.array([(v < a).sum() + ((v == a).sum() - 1) / 2 for a in v])
        px, py = place(x), place(y)
        for a in range(2, 13):
            for b in range(2, 13):
                if a * b > int(n ** 0.6):
                    continue
                cell = list(zip((px * a / n).astype(int).clip(max=a - 1), (py * b / n).astype(int).clip(max=b - 1)))
                h = lambda keys: -sum(c / n * math.log(c / n) for c in collections.Counter(keys).values())
                best = max(best, (h([i for i, _ in cell]) + h([j for _, j in cell]) - h(cell)) / math.log(min(a, b)))
        assert ranks.information_score(x, y) == pytest.approx(min(best, 1.0), abs=1e-9)


def test_ungrouped_order_without_a_key(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("v"), "id")
    got = row_numbers(df, [], "v", ["id"])
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()
    rows = sorted((r["v"], r["id"], r["rn"]) for r in got.collect())
    assert [r[2] for r in rows] == list(range(1, 1001))


def test_no_local_folder_off_a_single_machine():
    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(Fake)


def test_rules_find_planted_violations(spark):
    """Every kind of rule with a known number of violations, and none on the clean tables."""
    c = F.col
    plan = spark.createDataFrame([("a", 1, 0.5, 2.0, 3.0, 0.4), ("b", 1, 1.5, 2.0, 5.0, -0.1), ("c", 2, None, 2.0, 4.0, 1.2)],
                                 "k string, d int, markup double, cost double, price double, p double")
    ref = spark.createDataFrame([("a", 1, 3.0), ("a", 1, 3.2), ("b", 1, 4.9), ("d", 1, 1.0)], "k string, d int, price double")
    pair = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("a", "c")], "source string, target string")
    own = [rules.within("bounds", "markup", 0.0, 1.0), rules.identity("price", c("price"), c("cost") * (1 + c("markup"))), rules.probability("chance", "p"),
           rules.known("known", "markup", "price"), rules.Keys("subset", ("k", "d"), "ref"), rules.Keys("same", ("k", "d"), "ref", both=True),
           rules.Grid("in_grid", ("k", "d"), "price", "ref")]
    got = rules.compiled({"plan": plan, "ref": ref, "pair": pair, "names": plan}, {"plan": own, "pair": [rules.Pairs("pairs", (), "names", "k")]})
    # pairs: (b, c) is missing, (b, a) is turned round, (a, c) stands twice
    assert {r.check: r.violations for r in got.collect()} == {
        "bounds": 1, "price": 0, "chance": 2, "known": 1, "subset": 1, "same": 2, "in_grid": 2, "pairs": 3}
    assert all(r.passed == (r.violations == 0) for r in got.collect())


def test_weekly_profits(spark):
    """Penalty once a week: markups .6 and .7 against .5 at weight 10 cost 0.5; goodwill lowers the other two."""
    facts = spark.createDataFrame([("m", s, d, 100.0 * (s == d), 1.0) for s in (0, 1) for d in (0, 1)],
                                  "model string, scenario int, day int, operating double, goodwill double")
    plan = spark.createDataFrame([("m", "A", 0.6), ("m", "A", 0.7)], "model string, category_name string, markup double")
    bounds = spark.createDataFrame([("A", 0.5)], "category_name string, markup_reference double")
    penalty = sc.reference_penalty(plan, bounds, ["model"], weight=10.0)
    got = {r.measure: (r.expected, r.lower_tail) for r in sc.weekly_profits(facts, penalty, ["model"]).collect()}
    assert got == {"operating": (100.0, 100.0), "service_adjusted": (98.0, 98.0), "regularized": (97.5, 97.5)}


def test_overall_accuracy_is_weighted(spark):
    scores = spark.createDataFrame([("A", 1, 0.1, 3.0, 0.5, 0.2), ("B", 3, 0.5, 1.0, 0.5, 0.6)],
                                   "category_name string, n long, wape double, rmse double, r2 double, naive_wape double")
    r = el.with_overall(scores).where("category_name = 'overall'").first()
    assert (r.n, round(r.wape, 9), round(r.rmse ** 2, 9), r.r2, round(r.naive_wape, 9)) == (4, 0.4, 3.0, None, 0.5)
