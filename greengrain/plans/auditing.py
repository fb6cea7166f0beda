"""Queries of the evidence audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from greengrain.functions.exprs import fixed
from greengrain.functions.staging import stage
from greengrain.operators import audit, pairs
from greengrain.operators import elasticity as el
from greengrain.operators import scenario as sc
from greengrain.plans import assortment_plan as ap
from greengrain.plans import category_plan as cp
from greengrain.plans import fitting
from greengrain.plans.profiling import fixed_cols, fx_cols
from greengrain.plans.registry import part, query
from greengrain.plans.relationships import item_scores
from greengrain.sources import tables

# An order stands for an owner of data packages; a brand belongs to one package by its number.
part("holdings", "select distinct l_orderkey as owner, list_extract(" + str(audit.PACKAGES) + """,
    cast(1 + cast(substr(p_brand, 7) as integer) % 7 as integer)) as package_id from lineitem join part on p_partkey = l_partkey""")
part("package_sets", "select packages, count(*) as owners from (select owner, list_sort(list(package_id)) as packages from holdings group by 1) group by 1")
part("needs", "select * from (values " + ", ".join(
    f"('{s}', '{r}', {i}, {alt})" for s, rs in audit.SCENARIOS.items() for r in rs for i, alt in enumerate(audit.REQUIREMENTS[r])) + ") v(scenario, capability, alt, need)")
part("portfolios", """
    with f as (select s.packages, s.owners, n.scenario, bool_and(n.met) as ok, bool_and(n.met) as keep from package_sets s,
        lateral (select scenario, capability, bool_or(list_has_all(s.packages, need)) as met from needs group by 1, 2) n group by 1, 2, 3),
    ok as (select packages, owners, scenario, len(packages) as portfolio_size from f where ok),
    best as (select * from ok where portfolio_size = (select min(portfolio_size) from ok o where o.scenario = ok.scenario)),
    cut as (select b.scenario, b.packages, d.p, bool_and(n.met) as still from best b, lateral (select unnest(b.packages) as p) d,
        lateral (select scenario, capability, bool_or(list_has_all(list_filter(b.packages, lambda x: x <> d.p), need)) as met from needs group by 1, 2) n
        where n.scenario = b.scenario group by 1, 2, 3)
    select b.scenario, b.portfolio_size, b.packages, b.owners, not bool_or(c.still) as deletion_minimal
    from best b join cut c on c.scenario = b.scenario and c.packages = b.packages group by 1, 2, 3, 4""")


def holdings(spark, sf):
    number = F.substring("p_brand", 7, 10).cast("int")
    parts = tables.read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.element_at(
        F.array(*[F.lit(p) for p in audit.PACKAGES]), 1 + number % 7).alias("package_id"))
    lines = tables.read(spark, sf, "lineitem").select(
        "l_partkey", F.col("l_orderkey").alias("owner"))
    return lines.join(parts, "l_partkey").select("owner", "package_id").distinct()


@query("q02_coverage_matrix", "select package_id, count(*) as holders, " + ", ".join(
    f"cast(package_id in ({', '.join(repr(p) for p, c in audit.COVERAGE.items() if k in c)}) as integer) as {k}" for k in audit.CAPABILITIES)
    + " from holdings group by package_id")
def q02(spark, sf):
    return audit.coverage_matrix(holdings(spark, sf).groupBy("package_id").agg(F.count(F.lit(1)).alias("holders")))


@query("q03_minimum_portfolios", """
    select scenario, cast(portfolio_size as integer) as portfolio_size, array_to_string(packages, '|') as package_ids, owners, deletion_minimal from portfolios""")
def q03(spark, sf):
    sets = audit.package_sets(holdings(spark, sf), "owner", "package_id")
    return audit.minimum_portfolios(sets).select("scenario", "portfolio_size", F.array_join("packages", "|").alias("package_ids"),
                                                 "owners", "deletion_minimal")


@query("q04_priority_tiers", """
    with p as (select distinct scenario, unnest(packages) as package_id from portfolios), n as (select count(distinct scenario) as n from p)
    select package_id, count(*) as scenarios, bool_or(scenario = 'base_core') as in_base, cast(floor(count(*) / cast(any_value(n.n) as double) * 1e6 + 0.5) / 1e6 as double) as inclusion_rate,
      cast(case when count(*) = any_value(n.n) then 1 when bool_or(scenario = 'base_core') then 2 else 3 end as integer) as tier from p, n group by 1""")
def q04(spark, sf):
    sets = audit.package_sets(holdings(spark, sf), "owner", "package_id")
    return audit.priority_tiers(stage(audit.minimum_portfolios(sets), "portfolios")).select(
        "package_id", "scenarios", "in_base", *fixed_cols("inclusion_rate"), "tier")


@query("q01_gap_metrics")
def q01(spark, sf):
    """The 13 gap metrics from the tables of the other parts; the distribution rows have no SQL twin."""
    a = ap.build(spark, sf)
    m = a.category
    facts = stage(sc.plan_facts(m.drawn, m.model, a.base_plan), "facts")
    forecasts = stage(cp.two_forecasts(spark, sf).where("model is not null and naive is not null"), "forecasts")
    levels = forecasts.select("actual", cp.to_level(F.col("model")).alias("forecast"))
    scored = item_scores(spark, sf)
    sweep = sc.grid_plan(m.drawn, m.model, m.bounds, goodwill=[0.0, 0.05, 0.10, 0.20]).groupBy("goodwill_ratio").agg(F.sum("order_qty").alias("q"))
    e, _, best = ap.frontier(spark, sf, a)
    variants = stage(ap.sensitivity(a, best), "variants")
    outcomes = e.outcomes.where(F.col("k") == best)
    fits = fitting.d04(spark, sf).where("best_distribution <> 'insufficient'")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    clear = pairs.strength("r", "ci_lower", "ci_upper") == "clear"
    active = a.daily.groupBy("sku_code").agg(F.count_if(F.col("gross_sales_qty") > 0).alias("d"))
    covered = a.cand.select("sku_code").join(active, "sku_code", "left")
    w = F.sum(F.abs(F.col("actual") - F.col("forecast"))) / F.sum("actual")
    cost = F.exp("logw") - F.exp("logw_lag7")
    spread = lambda df, c: df.agg((F.max(c) - F.min(c)).alias("v"))
    rows = [
        ("G01", "share", fits.agg(share(F.col("fit_conclusion") == "parametric_accepted").alias("v"))),
        ("G02", "share", scored.where("period = 'all'").agg(share(clear).alias("v"))),
        ("G03", "share", levels.agg(w.alias("v"))),
        ("G04", "share", m.state.where("cost_residual is not null").agg((F.sum(F.abs(cost)) / F.sum(F.exp("logw"))).alias("v"))),
        ("G05", "share", el.interval_coverage(m.state, "demand_residual").agg(F.avg("coverage").alias("v"))),
        ("G06", "share", m.theta.agg(share(F.col("ci_upper") < 0).alias("v"))),
        ("G07", "share", facts.agg(share(sc.is_stockout("demand", "available")).alias("v"))),
        ("G08", "share", facts.agg((F.sum("sales") / F.sum("demand")).alias("v"))),
        ("G09", "qty per week", spread(sweep, "q")),
        ("G10", "share", covered.agg(share(F.col("d") >= 90).alias("v"))),
        ("G11", "share", spread(variants, "service_loss")),
        ("G12", "currency per day", spread(variants, "expected_profit")),
        ("G13", "currency per day", outcomes.agg(sc.tail_mean("profit").alias("v"))),
    ]
    out = None
    for gap, unit, df in rows:
        one = df.select(F.lit(gap).alias("gap_id"), F.lit(unit).alias("unit"), fixed("v").alias("metric_value"))
        out = one if out is None else out.unionByName(one)
    return out
