"""The category pricing chain: price response, forecasts, scenarios, and plans judged on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greengrain.functions.exprs import fixed, level_from_log, sales_year
from greengrain.functions.staging import stage
from greengrain.operators import elasticity as el
from greengrain.operators import learners, pairs
from greengrain.operators import scenario as sc
from greengrain.operators.calendar import lag_of, rolling
from greengrain.plans.profiling import day, fixed_cols, fx_cols
from greengrain.plans.registry import fx, part, query
from greengrain.sources import rules, tables

CAT = el.CAT

part("prep", """
    select category_name, date, is_history, gross_sales_qty, gross_revenue, net_sales_qty, active_sku_count, available_sku_count,
      case when is_history then coalesce(price_a, price_b) end as price, case when is_history then coalesce(cost_a, cost_b) end as cost,
      case when is_history then coalesce(loss_a, loss_b) end as loss,
      case when is_history then ln(1 + gross_sales_qty) end as logq,
      case when is_history then ln(greatest(coalesce(price_a, price_b), 1e-6)) end as logp,
      case when is_history then ln(greatest(coalesce(cost_a, cost_b), 1e-6)) end as logw
    from (select e.category_name, d.date, d.date <= m.last as is_history,
        case when d.date <= m.last then coalesce(f.gross_sales_qty, 0) end as gross_sales_qty,
        case when d.date <= m.last then coalesce(f.gross_revenue, 0) end as gross_revenue,
        case when d.date <= m.last then coalesce(f.net_sales_qty, 0) end as net_sales_qty,
        case when d.date <= m.last then coalesce(f.active_sku_count, 0) end as active_sku_count,
        case when d.date <= m.last then coalesce(f.available_sku_count, 0) end as available_sku_count,
        last_value(f.gross_weighted_avg_price ignore nulls) over past as price_a, first_value(f.gross_weighted_avg_price ignore nulls) over later as price_b,
        last_value(f.wholesale_price ignore nulls) over past as cost_a, first_value(f.wholesale_price ignore nulls) over later as cost_b,
        last_value(f.loss_rate_pct ignore nulls) over past as loss_a, first_value(f.loss_rate_pct ignore nulls) over later as loss_b
      from (select distinct category_name from cat_day) e
      cross join (select max(date) as last from cat_day) m
      cross join (select cast(unnest(generate_series((select min(date) from cat_day),
          (select max(date) from cat_day) + interval 7 day, interval 1 day)) as date) as date) d
      left join cat_day f on f.category_name = e.category_name and f.date = d.date
      window past as (partition by e.category_name order by d.date rows between unbounded preceding and current row),
             later as (partition by e.category_name order by d.date rows between current row and unbounded following))""")


def prepared(spark, sf, daily: DataFrame | None = None) -> DataFrame:
    return stage(el.prepare(tables.category_day(spark, sf) if daily is None else daily), "prepared")


@query("e01_prepared_frame", f"""
    select category_name, cast(date as varchar) as date, is_history, active_sku_count, available_sku_count,
      {fx_cols('gross_sales_qty', 'gross_revenue', 'net_sales_qty', digits=4)}, {fx_cols('price', 'cost', 'loss', 'logq', 'logp', 'logw')} from prep""")
def e01(spark, sf):
    return el.prepare(tables.category_day(spark, sf)).select(
        CAT, day(), "is_history", "active_sku_count", "available_sku_count",
        *fixed_cols("gross_sales_qty", "gross_revenue", "net_sales_qty", digits=4),
        fixed("gross_weighted_avg_price").alias("price"), fixed("wholesale_price").alias("cost"),
        fixed("loss_rate_pct").alias("loss"), *fixed_cols("logq", "logp", "logw"))


def _feature_sql(name: str) -> str:
    w = "over (partition by category_name order by date)"
    fixed_forms = {
        "dow_sin": "sin(2 * pi() * (isodow(date) - 1) / 7)", "dow_cos": "cos(2 * pi() * (isodow(date) - 1) / 7)",
        "doy_sin": "sin(2 * pi() * dayofyear(date) / 365.25)", "doy_cos": "cos(2 * pi() * dayofyear(date) / 365.25)",
        "month_sin": "sin(2 * pi() * month(date) / 12)", "month_cos": "cos(2 * pi() * month(date) / 12)",
        "trend": "(row_number() over (partition by category_name order by date) - 1) / cast(greatest(1, count(*) over (partition by category_name) - 1) as double)"}
    if name in fixed_forms:
        return fixed_forms[name]
    base, _, kind = name.partition("_")
    src = "active_sku_count" if base == "active" else base
    if kind.startswith("lag"):
        return f"lag({src}, {kind[3:]}) {w}"
    if kind[:2] in ("ma", "sd"):
        length, shift = (int(p) for p in kind[2:].split("_s"))
        frame = f"over (partition by category_name order by date rows between {shift + length - 1} preceding and {shift} preceding)"
        f = "avg" if kind[:2] == "ma" else "stddev_samp"
        return f"case when count({src}) {frame} = {length} then {f}({src}) {frame} end"
    return name


FEATURES = list(dict.fromkeys(el.RESPONSE_FEATURES + el.DEMAND_FEATURES + el.COST_FEATURES))
part("feat", "select category_name, date, is_history, logq, logp, logw, active_sku_count, price, cost, gross_sales_qty, " + ", ".join(
    f"{_feature_sql(n)} as {n}" for n in FEATURES if n != "logw") + " from prep")


@query("e02_feature_tables", f"select category_name, cast(date as varchar) as date, is_history, {fx_cols(*FEATURES)} from feat")
def e02(spark, sf):
    return el.features(prepared(spark, sf)).select(CAT, day(), "is_history", *fixed_cols(*FEATURES))


@query("e03_time_folds", f"""
    select category_name, cast(date as varchar) as date, cast(row_no as integer) as row, cast(fold as integer) as fold,
      case when fold > 0 then n - (6 - fold) * size end as train_rows
    from (select *, case when row_no < n - 5 * size then 0 else (row_no - (n - 5 * size)) // size + 1 end as fold
          from (select category_name, date, row_number() over (partition by category_name order by date) - 1 as row_no,
                  count(*) over (partition by category_name) as n, count(*) over (partition by category_name) // 6 as size
                from feat where is_history and {' and '.join(f'{n} is not null' for n in el.RESPONSE_FEATURES + ['logq', 'logp'])}))""")
def e03(spark, sf):
    out = el.folds(el.features(prepared(spark, sf)), el.RESPONSE_FEATURES + ["logq", "logp"])
    return out.select(CAT, day(), "row", "fold", "train_rows")


@query("e04_crossfit_residuals")
def e04(spark, sf):
    hats = response_hats(spark, sf)
    return hats.select(CAT, day(), "fold", fixed(F.col("logq") - F.col("logq_hat")).alias("ry"),
                       fixed(F.col("logp") - F.col("logp_hat")).alias("rx"))


def response_hats(spark, sf):
    base = el.features(prepared(spark, sf))
    folded = el.folds(base, el.RESPONSE_FEATURES + ["logq", "logp"])
    return learners.crossfit(folded, el.RESPONSE_FEATURES, ["logq", "logp"])


part("resid", """
    select category_name, date, logp - avg(logp) over (partition by category_name, date_trunc('month', date)) as rx,
      logq - avg(logq) over (partition by category_name, date_trunc('month', date)) as ry
    from prep where is_history""")
part("slope", """
    select category_name, count(*) as n, sum(rx * ry) / sum(rx * rx) as elasticity_raw, stddev_samp(rx) as price_residual_sd,
      any_value(pooled) as pooled_elasticity
    from resid, (select sum(rx * ry) / sum(rx * rx) as pooled from resid) group by category_name""")


@query("e05_residual_slope", f"""
    select category_name, n, {fx_cols('elasticity_raw', 'price_residual_sd', 'pooled_elasticity')} from slope""")
def e05(spark, sf):
    return el.slopes(el.demeaned_residuals(prepared(spark, sf))).select(
        CAT, "n", *fixed_cols("elasticity_raw", "price_residual_sd", "pooled_elasticity"))


part("slope_boot", """
    with s as (select *, row_number() over (partition by category_name order by date) - 1 as i,
                 count(*) over (partition by category_name) as n from resid),
    sizes as (select category_name, max(n) as n, cast(ceil(max(n) / 7.0) as bigint) as blocks from s group by 1),
    d as (select category_name, rep, blk, n, ('0x' || substr(md5('2023:' || rep || ':' || blk), 1, 8))::bigint % (n - 6) as st
          from (select category_name, n, unnest(range(0, blocks)) as blk from sizes), (select unnest(range(0, 400)) as rep)),
    p as (select category_name, rep, st + o as i from d, (select unnest(range(0, 7)) as o) where blk * 7 + o < n),
    r as (select category_name, rep, sum(rx * ry) / sum(rx * rx) as slope from p join s using (category_name, i) group by 1, 2)
    select category_name, stddev_samp(slope) as bootstrap_se, quantile_cont(slope, 0.025) as ci_lower,
      quantile_cont(slope, 0.975) as ci_upper from r group by 1""")


@query("e06_slope_bootstrap", f"select category_name, {fx_cols('bootstrap_se', 'ci_lower', 'ci_upper')} from slope_boot")
def e06(spark, sf):
    return el.slope_bootstrap(el.demeaned_residuals(prepared(spark, sf))).select(
        CAT, *fixed_cols("bootstrap_se", "ci_lower", "ci_upper"))


part("theta", """
    select *, least(greatest(case when elasticity_raw >= 0 then pooled_elasticity else elasticity_shrunk end, -3.0), -0.05) as elasticity_used,
      elasticity_raw >= 0 as pooled_fallback,
      case when ci_upper < 0 then 'negative_interval_below_zero' when elasticity_raw < 0 then 'negative_interval_crosses_zero'
           else 'nonnegative_pooled' end as identification_label
    from (select *, w * elasticity_raw + (1 - w) * pooled_elasticity as elasticity_shrunk
      from (select *, tau2 / (tau2 + pow(bootstrap_se, 2)) as w
        from (select s.*, b.bootstrap_se, b.ci_lower, b.ci_upper,
                greatest(var_samp(elasticity_raw) over () - avg(pow(bootstrap_se, 2)) over (), 0.0001) as tau2
              from slope s join slope_boot b on b.category_name = s.category_name)))""")


def estimate_theta(prep) -> DataFrame:
    residuals = el.demeaned_residuals(prep)
    return el.shrink(el.slopes(residuals).join(el.slope_bootstrap(residuals), CAT))


@query("e07_shrinkage", f"""
    select category_name, {fx_cols('tau2', 'elasticity_shrunk', 'elasticity_used')}, {fx('w')} as shrinkage_weight, pooled_fallback from theta""")
def e07(spark, sf):
    return estimate_theta(prepared(spark, sf)).select(
        CAT, *fixed_cols("tau2", "elasticity_shrunk", "elasticity_used", "shrinkage_weight"), "pooled_fallback")


@query("p10_identification", "select category_name, identification_label from theta")
def p10(spark, sf):
    return estimate_theta(prepared(spark, sf)).select(CAT, "identification_label")


part("state", """
    select *, alpha - alpha_lag7 as demand_residual, logw - logw_lag7 as cost_residual
    from (select *, lag(alpha, 7) over (partition by category_name order by date) as alpha_lag7,
            lag(logw, 7) over (partition by category_name order by date) as logw_lag7
          from (select f.*, t.elasticity_used, f.logq - t.elasticity_used * f.logp as alpha
                from feat f join theta t on t.category_name = f.category_name))""")


def demand_state(prep, theta) -> DataFrame:
    return el.demand_state(prep, theta)


@query("e08_demand_state", f"""
    select category_name, cast(date as varchar) as date, {fx_cols('alpha', 'alpha_lag7', 'demand_residual', 'cost_residual', digits=5)} from state""")
def e08(spark, sf):
    prep = prepared(spark, sf)
    return demand_state(prep, estimate_theta(prep)).select(
        CAT, day(), *fixed_cols("alpha", "alpha_lag7", "demand_residual", "cost_residual", digits=5))


def forecast_state(spark, sf):
    """Model features with the price-free demand state."""
    prep = prepared(spark, sf)
    return stage(el.demand_state(el.features(prep), stage(estimate_theta(prep), "theta")), "state")


def cost_level(logw):
    return F.exp(logw)


def out_of_fold(state):
    """Out-of-fold forecasts of demand state and log cost next to the naive ones, with the blend weight of each category.

    Demand: (category, date, actual, model, naive, price_part, blend_weight); cost the same without the price part.
    """
    demand = learners.crossfit(el.folds(state, [*el.DEMAND_FEATURES, "alpha", "alpha_lag7", "logp", "logq"]), el.DEMAND_FEATURES, ["alpha"])
    known = state.select(CAT, "date", F.expm1("logq").alias("actual"), F.col("alpha_lag7").alias("naive"),
                         (F.col("logp") * F.col("elasticity_used")).alias("price_part"))
    demand = stage(demand.join(known, [CAT, "date"]).withColumnRenamed("alpha_hat", "model"), "demand_folds")
    cost = learners.crossfit(el.folds(state, [*el.COST_FEATURES, "logw", "logw_lag7"]), el.COST_FEATURES, ["logw"])
    known = state.select(CAT, "date", F.exp("logw").alias("actual"), F.col("logw_lag7").alias("naive"))
    cost = stage(cost.join(known, [CAT, "date"]).withColumnRenamed("logw_hat", "model"), "cost_folds")
    return (demand.join(el.blend_weight(demand, "actual", "model", "naive", to_level).select(CAT, "blend_weight"), CAT),
            cost.join(el.blend_weight(cost, "actual", "model", "naive", cost_level).select(CAT, "blend_weight"), CAT))


def blend(weight, model, naive):
    return F.col(weight) * F.col(model) + (1 - F.col(weight)) * F.col(naive)


@query("e09_forecasts")
def e09(spark, sf):
    """Seven days ahead: fits on all history, blended by the weights that were best out of fold."""
    state = forecast_state(spark, sf)
    weights = [df.select(CAT, F.col("blend_weight").alias(name)).distinct() for df, name in zip(out_of_fold(state), ("demand_weight", "cost_weight"))]
    future, history = state.where(~F.col("is_history")), state.where(F.col("is_history"))
    alpha = learners.fit_predict(history, future, el.DEMAND_FEATURES, "alpha")
    cost = learners.fit_predict(history, future, el.COST_FEATURES, "logw")
    out = future.join(alpha, [CAT, "date"]).join(cost, [CAT, "date"]).join(weights[0], CAT).join(weights[1], CAT)
    return out.select(CAT, day(), fixed(blend("demand_weight", "alpha_hat", "alpha_lag7")).alias("alpha_forecast"),
                      fixed(F.exp(blend("cost_weight", "logw_hat", "logw_lag7"))).alias("cost_forecast"), "demand_weight", "cost_weight")


@query("e11_blend_accuracy")
def e11_blend(spark, sf):
    """Accuracy of the blended demand and cost forecasts out of fold, per category and over all."""
    demand, cost = out_of_fold(forecast_state(spark, sf))
    out = None
    for name, rows, level in (("demand", demand, to_level), ("cost", cost, cost_level)):
        seen = rows.select(CAT, "actual", level(blend("blend_weight", "model", "naive")).alias("forecast"), level(F.col("naive")).alias("naive"))
        one = el.with_overall(el.accuracy(seen, "actual", "forecast", "naive")).withColumn("series", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("series", CAT, "n", *fixed_cols("wape", "rmse", "r2", "naive_wape"))


@query("z01_blend_residuals")
def z01_blend(spark, sf):
    """The joint pool of the blend's out-of-fold residuals: winsorized and centered, days that all categories have."""
    demand, cost = out_of_fold(forecast_state(spark, sf))
    logq = demand.select(CAT, "date", (F.col("alpha") - blend("blend_weight", "model", "naive")).alias("demand_residual"))
    logw = cost.select(CAT, "date", (F.col("logw") - blend("blend_weight", "model", "naive")).alias("cost_residual"))
    return sc.residual_pool(logq.join(logw, [CAT, "date"])).select(CAT, day(), *fixed_cols("e", "u"))


part("two_forecasts", """
    select category_name, date, exp(logq) - 1 as actual, logp * elasticity_used as price_part,
      logq_ma28_s7 - elasticity_used * logp_lag7 as model, alpha_lag7 as naive
    from state where is_history""")


def two_forecasts(spark, sf):
    """A slow and a fast forecast of the price-free demand level, on history rows."""
    prep = prepared(spark, sf)
    state = el.demand_state(prep, estimate_theta(prep))
    state = state.withColumn("logq_ma28_s7", rolling("logq", CAT, 28, 7)).withColumn("logp_lag7", lag_of("logp", 7, CAT))
    state = state.where("is_history")
    return state.select(CAT, "date", F.expm1("logq").alias("actual"),
                        (F.col("logp") * F.col("elasticity_used")).alias("price_part"),
                        (F.col("logq_ma28_s7") - F.col("elasticity_used") * F.col("logp_lag7")).alias("model"),
                        F.col("alpha_lag7").alias("naive"))


SQL_LEVEL = "case when ({0}) is not null then greatest(0, exp(least(greatest({0}, -700), 700)) - 1) end"


def to_level(alpha):
    return level_from_log(alpha + F.col("price_part"))


@query("e10_blend_weight", f"""
    select category_name, w as blend_weight, wape as blend_wape from (
      select *, row_number() over (partition by category_name order by wape, w) as rn from (
        select category_name, w, {fx("sum(abs(actual - " + SQL_LEVEL.format('w * model + (1 - w) * naive + price_part') + ")) / sum(abs(actual))", 9)} as wape
        from two_forecasts, (select unnest(range(0, 21)) / 20.0 as w) where model is not null and naive is not null and actual is not null
        group by 1, 2)) where rn = 1""")
def e10(spark, sf):
    return el.blend_weight(two_forecasts(spark, sf), "actual", "model", "naive", to_level)


part("levels", f"""
    select category_name, date, actual, {SQL_LEVEL.format('model + price_part')} as forecast, {SQL_LEVEL.format('naive + price_part')} as naive
    from two_forecasts where model is not null and naive is not null""")


@query("e11_accuracy", f"""
    select category_name, count(*) as n, {fx('sum(abs(actual - forecast)) / sum(abs(actual))')} as wape,
      {fx('sqrt(avg(pow(actual - forecast, 2)))')} as rmse, {fx('1 - sum(pow(actual - forecast, 2)) / (count(*) * var_pop(actual))')} as r2,
      {fx('sum(abs(actual - naive)) / sum(abs(actual))')} as naive_wape from levels group by 1
    union all select 'overall', cast(sum(n) as bigint), {fx('sum(wape * n) / sum(n)')}, {fx('sqrt(sum(mse * n) / sum(n))')}, null, {fx('sum(naive_wape * n) / sum(n)')}
    from (select category_name, count(*) as n, sum(abs(actual - forecast)) / sum(abs(actual)) as wape, avg(pow(actual - forecast, 2)) as mse,
            sum(abs(actual - naive)) / sum(abs(actual)) as naive_wape from levels group by 1)""")
def e11(spark, sf):
    rows = two_forecasts(spark, sf).where(F.col("model").isNotNull() & F.col("naive").isNotNull()).select(
        CAT, "actual", to_level(F.col("model")).alias("forecast"), to_level(F.col("naive")).alias("naive"))
    return el.with_overall(el.accuracy(rows, "actual", "forecast", "naive")).select(
        CAT, "n", *fixed_cols("wape", "rmse", "r2", "naive_wape"))


part("cover", """
    with r as (select category_name, demand_residual as e, row_number() over (partition by category_name order by date) as rn,
                 greatest(1, floor(0.7 * count(*) over (partition by category_name))) as split from state where demand_residual is not null),
    q as (select category_name, quantile_cont(e, 0.1) as q10, quantile_cont(e, 0.9) as q90 from r where rn <= split group by 1)
    select r.category_name, any_value(q10) as q10, any_value(q90) as q90, count(*) as n_test,
      count_if(e between q10 and q90) / cast(count(*) as double) as coverage
    from r join q on q.category_name = r.category_name where rn > split group by 1""")


@query("e12_interval_coverage", f"select category_name, {fx_cols('q10', 'q90', digits=5)}, n_test, {fx_cols('coverage')} from cover")
def e12(spark, sf):
    prep = prepared(spark, sf)
    return el.interval_coverage(demand_state(prep, estimate_theta(prep)), "demand_residual").select(
        CAT, *fixed_cols("q10", "q90", digits=5), "n_test", *fixed_cols("coverage"))


@query("e13_cost_plus", f"""
    select category_name, period, count(m) as n, {fx('avg(m)')} as mean_markup, {fx('case when count(m) > 2 then regr_slope(logq, m) end')} as slope, {fx('case when count(m) > 2 then corr(logq, m) end')} as r
    from (select category_name, year(date) - (case when month(date) < 7 then 1 else 0 end) as period, price / cost - 1 as m, logq
          from prep where is_history) group by 1, 2""")
def e13(spark, sf):
    return el.cost_plus(prepared(spark, sf), sales_year("date")).withColumns(
        {c: F.when(F.col("n") > 2, F.col(c)) for c in ("slope", "r")}).select(
        CAT, "period", "n", *fixed_cols("mean_markup", "slope", "r"))


part("loss", """
    select category_name, coalesce(sum(l * w) / nullif(sum(w), 0), quantile_cont(l, 0.5)) as loss_rate
    from (select category_name, least(greatest(loss, 0), 95) / 100 as l, greatest(gross_sales_qty, 0) as w,
            row_number() over (partition by category_name order by date desc) as rn from prep where is_history)
    where rn <= 30 group by 1""")


@query("a07_loss_rate", f"select category_name, {fx('loss_rate')} as loss_rate from loss")
def a07(spark, sf):
    return el.loss_rates(prepared(spark, sf)).select(CAT, *fixed_cols("loss_rate"))


QUANTILES = ["markup_p05", "markup_p50", "markup_p90", "markup_p95", "markup_p99", "change_p90", "order_p99"]
part("hist_q", """
    select category_name, quantile_cont(m, 0.05) as markup_p05, quantile_cont(m, 0.5) as markup_p50, quantile_cont(m, 0.9) as markup_p90,
      quantile_cont(m, 0.95) as markup_p95, quantile_cont(m, 0.99) as markup_p99, quantile_cont(c, 0.9) as change_p90,
      quantile_cont(o, 0.99) as order_p99
    from (select *, abs(m - lag(m) over (partition by category_name order by date)) as c
          from (select category_name, date, price / cost - 1 as m,
                  gross_sales_qty / (1 - least(greatest(loss / 100, 0), 0.95)) as o,
                  row_number() over (partition by category_name order by date desc) as rn from prep where is_history) where rn <= 365)
    group by 1""")


@query("a08_history_quantiles", f"select category_name, {fx_cols(*QUANTILES)} from hist_q")
def a08(spark, sf):
    return el.history_quantiles(prepared(spark, sf)).select(CAT, *fixed_cols(*QUANTILES))


# ---------------------------------------------------------------- scenarios

part("pool", """
    with k as (select category_name, date, demand_residual as e, cost_residual as u from state
               where demand_residual is not null and cost_residual is not null),
    c as (select * from k where date in (select date from k group by date having count(*) = (select count(distinct category_name) from state))),
    q as (select category_name, quantile_cont(e, 0.01) as el, quantile_cont(e, 0.99) as eh, quantile_cont(u, 0.01) as ul, quantile_cont(u, 0.99) as uh
          from c group by 1),
    w as (select c.category_name, c.date, least(greatest(e, el), eh) as e, least(greatest(u, ul), uh) as u from c join q on q.category_name = c.category_name)
    select category_name, date, e - avg(e) over (partition by category_name) as e, u - avg(u) over (partition by category_name) as u from w""")
part("starts", """
    select date, row_number() over (order by date) - 1 as start_no
    from (select date, lead(date, 6) over (order by date) as fin from (select distinct date from pool)) where date_diff('day', date, fin) = 6""")
part("scen", """
    select s.scenario, o.day, p.category_name, p.e, p.u
    from (select scenario, ('0x' || substr(md5('2023:' || scenario), 1, 8))::bigint % (select count(*) from starts) as start_no
          from (select unnest(range(0, 600)) as scenario)) s
    join starts t on t.start_no = s.start_no cross join (select unnest(range(0, 7)) as day) o
    join pool p on p.date = t.date + cast(o.day as integer)""")
part("model", """
    select t.category_name, date_diff('day', (select max(date) from prep where is_history), t.date) - 1 as day, t.date,
      t.alpha_lag7 as alpha_future, exp(t.logw_lag7) as cost_future, t.elasticity_used, l.loss_rate
    from state t join loss l on l.category_name = t.category_name where not t.is_history""")


@dataclass
class CategoryModel:
    """Written intermediate tables of the chain; each is small and read several times."""
    theta: DataFrame
    state: DataFrame
    pool: DataFrame
    drawn: DataFrame
    model: DataFrame
    bounds: DataFrame


def build(spark, sf, upto: str = "bounds", daily: DataFrame | None = None) -> CategoryModel:
    """The chain up to a step, from the category table `daily` where the caller has it already."""
    prep = prepared(spark, sf, daily)
    theta = stage(estimate_theta(prep), "theta")
    state = stage(demand_state(prep, theta), "state")
    pool = stage(sc.residual_pool(state), "pool")
    if upto == "pool":
        return CategoryModel(theta, state, pool, None, None, None)
    drawn = stage(sc.draw_weeks(pool), "scenarios")
    if upto == "drawn":
        return CategoryModel(theta, state, pool, drawn, None, None)
    loss = el.loss_rates(prep)
    last = prep.where("is_history").select(F.max("date")).scalar()
    model = stage(state.where(~F.col("is_history")).join(loss, CAT).select(
        CAT, (F.datediff("date", last) - 1).alias("day"), "date", F.col("alpha_lag7").alias("alpha_future"),
        F.exp("logw_lag7").alias("cost_future"), "elasticity_used", "loss_rate"), "model")
    bounds = stage(sc.decision_bounds(el.history_quantiles(prep), theta, loss,
                                      model.select(CAT, "day", "alpha_future", "cost_future"), drawn), "bounds")
    return CategoryModel(theta, state, pool, drawn, model, bounds)


@query("z01_residual_pool", f"select category_name, cast(date as varchar) as date, {fx_cols('e', 'u', digits=5)} from pool")
def z01(spark, sf):
    return build(spark, sf, "pool").pool.select(CAT, day(), *fixed_cols("e", "u", digits=5))


@query("t06_common_dates", """
    select cast(date as varchar) as date from cat_day group by date
    having count(distinct category_name) = (select count(distinct category_name) from cat_day)""")
def t06(spark, sf):
    daily = tables.category_day(spark, sf)
    # the daily table has one row per date and category
    every = daily.agg(F.count_distinct(CAT)).scalar()
    return daily.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == every).select(day())


@query("z02_scenarios", f"select scenario, cast(day as integer) as day, category_name, {fx_cols('e', 'u', digits=5)} from scen")
def z02(spark, sf):
    return build(spark, sf, "drawn").drawn.select("scenario", "day", CAT, *fixed_cols("e", "u", digits=5))


part("pool_series", "select 'demand:' || category_name as s, date as k, e as v from pool union all select 'cost:' || category_name, date, u from pool")
part("scen_series", "select 'demand:' || category_name as s, scenario * 10 + day as k, e as v from scen union all select 'cost:' || category_name, scenario * 10 + day, u from scen")


@query("z03_correlation_drift", f"""
    select {fx('max(case when source like \'demand%\' and target like \'demand%\' then abs(r1 - r2) end)', 5)} as demand_drift,
      {fx('max(abs(r1 - r2))', 5)} as joint_drift
    from (select a.s as source, b.s as target, corr(a.v, b.v) as r1 from pool_series a join pool_series b on a.k = b.k and a.s < b.s group by 1, 2)
    join (select a.s as source, b.s as target, corr(a.v, b.v) as r2 from scen_series a join scen_series b on a.k = b.k and a.s < b.s group by 1, 2)
    using (source, target)""")
def z03(spark, sf):
    m = build(spark, sf, "drawn")
    return sc.correlation_drift(m.pool, m.drawn).select(*fixed_cols("demand_drift", "joint_drift", digits=5))


part("bounds", """
    with b as (select h.*, t.ci_upper, t.elasticity_used, l.loss_rate, greatest(0, markup_p05) as markup_low
               from hist_q h join theta t on t.category_name = h.category_name join loss l on l.category_name = h.category_name),
    c as (select *, greatest(markup_low + 0.05, case when ci_upper < 0 then markup_p95 else markup_p90 end) as markup_high from b),
    cap as (select c.category_name, quantile_cont(greatest(0, exp(m.alpha_future + c.elasticity_used * ln(m.cost_future * (1 + c.markup_low)) + s.e) - 1)
              / (1 - c.loss_rate), 0.99) as cap
            from scen s join model m on m.category_name = s.category_name and m.day = s.day join c on c.category_name = s.category_name group by 1)
    select c.category_name, markup_low, least(greatest(markup_p50, markup_low), markup_high) as markup_reference, markup_high,
      greatest(0.04, change_p90) as markup_change, greatest(order_p99 * 1.25, cap * 1.10, 1) as order_upper, loss_rate
    from c join cap on cap.category_name = c.category_name""")
BOUNDS = ["markup_low", "markup_reference", "markup_high", "markup_change", "order_upper", "loss_rate"]


@query("a09_decision_bounds", f"select category_name, {fx_cols(*BOUNDS, digits=5)} from bounds")
def a09(spark, sf):
    return build(spark, sf).bounds.select(CAT, *fixed_cols(*BOUNDS, digits=5))


part("base_resp", f"""
    select s.scenario, s.day, s.category_name, b.markup_reference as markup, m.cost_future * (1 + b.markup_reference) as price,
      {SQL_LEVEL.format('m.alpha_future + m.elasticity_used * ln(m.cost_future * (1 + b.markup_reference)) + s.e')} as demand,
      m.cost_future * exp(s.u) as cost, m.loss_rate
    from scen s join model m on m.category_name = s.category_name and m.day = s.day join bounds b on b.category_name = s.category_name""")
part("base_plan", """
    select category_name, day, any_value(markup) as markup, quantile_cont(demand, 0.5) / (1 - any_value(loss_rate)) as order_qty
    from base_resp group by 1, 2""")
part("base_facts", """
    select *, price * sales - cost * order_qty as operating, 0.10 * greatest(0, price - cost) * greatest(0, demand - available) as goodwill
    from (select *, least(demand, available) as sales from
      (select r.*, p.order_qty, (1 - r.loss_rate) * p.order_qty as available
       from base_resp r join base_plan p on p.category_name = r.category_name and p.day = r.day))""")


@query("z04_demand_and_cost", f"""
    select scenario, cast(day as integer) as day, category_name, {fx_cols('demand', 'cost', digits=4)} from base_resp""")
def z04(spark, sf):
    m = build(spark, sf)
    rows = sc.respond(m.drawn.join(m.model, [CAT, "day"]).join(
        m.bounds.select(CAT, F.col("markup_reference").alias("markup")), CAT))
    return rows.select("scenario", "day", CAT, *fixed_cols("demand", "cost", digits=4))


def baseline(spark, sf):
    m = build(spark, sf)
    plan = stage(sc.baseline_plan(m.drawn, m.model, m.bounds), "baseline")
    return m, plan, sc.plan_facts(m.drawn, m.model, plan)


FACTS = ["demand", "available", "sales", "operating", "goodwill"]


@query("z05_profit_accounting", f"""
    select scenario, cast(day as integer) as day, category_name, {fx_cols(*FACTS, digits=3)} from base_facts""")
def z05(spark, sf):
    return baseline(spark, sf)[2].select("scenario", "day", CAT, *fixed_cols(*FACTS, digits=3))


@query("j10_scenario_decision_join", f"""
    select day, category_name, count(*) as n, {fx('avg(price)', 4)} as price, {fx('avg(order_qty)', 4)} as order_qty,
      {fx('avg(demand)', 4)} as demand from base_facts group by 1, 2""")
def j10(spark, sf):
    facts = baseline(spark, sf)[2]
    return facts.groupBy(F.col("day").cast("long").alias("day"), CAT).agg(
        F.count(F.lit(1)).alias("n"), *[fixed(F.avg(c), 4).alias(c) for c in ("price", "order_qty", "demand")])


part("week_net", "select scenario, sum(operating) as op, sum(operating - goodwill) as net from base_facts group by 1")
part("bad_weeks", """
    select scenario from (select scenario, row_number() over (order by net, scenario) as rn, count(*) over () as n from week_net)
    where rn <= greatest(1, ceil(n * 0.1))""")
SUMMARY = ["expected_demand", "expected_sales", "expected_unsold", "expected_profit", "expected_goodwill", "worst_week_profit",
           "stockout_probability"]


@query("z06_plan_summary", f"""
    select day, category_name, {fx('avg(demand)', 4)} as expected_demand, {fx('avg(sales)', 4)} as expected_sales,
      {fx('avg(order_qty - sales)', 4)} as expected_unsold, {fx('avg(operating)', 4)} as expected_profit,
      {fx('avg(goodwill)', 4)} as expected_goodwill,
      {fx('avg(case when scenario in (select scenario from bad_weeks) then operating end)', 4)} as worst_week_profit,
      {fx('avg(case when demand > available + 1e-9 then 1.0 else 0.0 end)', 4)} as stockout_probability
    from base_facts group by 1, 2""")
def z06(spark, sf):
    return sc.plan_summary(baseline(spark, sf)[2]).select(F.col("day").cast("long").alias("day"), CAT, *fixed_cols(*SUMMARY, digits=4))


def tail_sql(v: str, n: str, key: str, src: str) -> str:
    """(key, mean, tail, std) of v per key in src."""
    return f"""select {key}, avg({v}) as expected, avg(case when rn <= greatest(1, ceil(0.1 * n)) then {v} end) as lower_tail,
      stddev_samp({v}) as std from (select *, row_number() over (partition by {key} order by {v}) as rn,
      count(*) over (partition by {key}) as n from {src}) group by {key}"""


@query("a10_lower_tail_mean", f"""
    select category_name, {fx('expected', 4)} as expected, {fx('lower_tail', 4)} as lower_tail from ({tail_sql('operating', 'n', 'category_name', 'base_facts')})""")
def a10(spark, sf):
    return baseline(spark, sf)[2].groupBy(CAT).agg(
        fixed(F.avg("operating"), 4).alias("expected"), fixed(sc.tail_mean("operating"), 4).alias("lower_tail"))


part("week_risk", f"select * from ({tail_sql('net', 'n', 'g', '(select 1 as g, scenario, net from week_net)')})")


@query("a11_weekly_risk", f"""
    select g as risk, {fx_cols('expected', 'lower_tail', 'std', digits=4)}, {fx('(1 - g) * expected + g * lower_tail', 4)} as objective
    from (select expected, lower_tail, std from week_risk), (values (0.0::double), (0.25), (0.5)) r(g)""")
def a11(spark, sf):
    facts = baseline(spark, sf)[2]
    risk = sc.weekly_risk(facts, F.col("operating") - F.col("goodwill")).drop("objective")
    return risk.withColumn("risk", F.explode(F.array(F.lit(0.0), F.lit(0.25), F.lit(0.5)))).select(
        "risk", *fixed_cols("expected", "lower_tail", "std", digits=4),
        fixed((1 - F.col("risk")) * F.col("expected") + F.col("risk") * F.col("lower_tail"), 4).alias("objective"))


@query("z07_daily_and_weekly", f"""
    select cast(day as bigint) as day, {fx_cols('expected', 'lower_tail', 'std', digits=4)} from ({tail_sql('net', 'n', 'day',
      '(select day, scenario, sum(operating - goodwill) as net from base_facts group by 1, 2)')})
    union all select -1, {fx_cols('expected', 'lower_tail', 'std', digits=4)} from week_risk""")
def z07(spark, sf):
    facts = stage(baseline(spark, sf)[2], "facts")
    net = F.col("operating") - F.col("goodwill")
    daily = sc.weekly_risk(facts, net, ["day"])
    weekly = sc.weekly_risk(facts, net).withColumn("day", F.lit(-1))
    return daily.unionByName(weekly).select(F.col("day").cast("long").alias("day"),
                                            *fixed_cols("expected", "lower_tail", "std", digits=4))


@query("z08_baseline_plan", f"""
    select cast(day as integer) as day, category_name, {fx_cols('markup', 'order_qty', digits=4)} from base_plan""")
def z08(spark, sf):
    return baseline(spark, sf)[1].select("day", CAT, *fixed_cols("markup", "order_qty", digits=4))


def grid_sql(goodwill: str, weights: str) -> str:
    return f"""
    with cells as (select m.*, b.markup_reference, b.order_upper,
        (case when m.day = 0 then greatest(markup_low, markup_reference - markup_change) else markup_low end) as lo,
        (case when m.day = 0 then least(markup_high, markup_reference + markup_change) else markup_high end) as hi
      from model m join bounds b on b.category_name = m.category_name),
    priced as (select s.scenario, c.*, k.k, lo + (hi - lo) * k.k / 6 as markup, c.cost_future * (1 + lo + (hi - lo) * k.k / 6) as price,
        {SQL_LEVEL.format('c.alpha_future + c.elasticity_used * ln(c.cost_future * (1 + (lo + (hi - lo) * k.k / 6))) + s.e')} as demand,
        c.cost_future * exp(s.u) as cost
      from scen s join cells c on c.category_name = s.category_name and c.day = s.day cross join (select unnest(range(0, 7)) as k) k),
    levels as (select category_name, day, k, unnest(quantile_cont(demand, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) as lev from priced group by 1, 2, 3),
    acc as (select p.*, least(l.lev / (1 - loss_rate), order_upper) as q from priced p
            join levels l on l.category_name = p.category_name and l.day = p.day and l.k = p.k),
    net as (select category_name, day, markup, q, markup_reference, price * least(demand, (1 - loss_rate) * q) - cost * q as op,
              greatest(0, price - cost) * greatest(0, demand - (1 - loss_rate) * q) as gw from acc),
    gnet as (select *, op - g * gw as net from net, (values {goodwill}) v(g)),
    stat as (select category_name, day, markup, q, markup_reference, g, avg(net) as mean,
               avg(case when rn <= ceil(0.1 * n) then net end) as tail
             from (select *, row_number() over (partition by category_name, day, markup, q, g order by net) as rn,
                     count(*) over (partition by category_name, day, markup, q, g) as n from gnet) group by all),
    score as (select *, floor((0.75 * mean + 0.25 * tail - w * pow(markup - markup_reference, 2)) * 1e6 + 0.5) / 1e6 as score
              from stat, (values {weights}) v(w))
    select * from (select *, row_number() over (partition by category_name, day, g, w order by score desc, markup, q) as rn from score) where rn = 1"""


part("grid_best", grid_sql("(0.10::double)", "(80.0::double)"))
part("grid_sweep", grid_sql("(0.0::double), (0.05), (0.10), (0.20)", "(0.0::double), (50.0), (80.0), (500.0)"))


@query("z09_grid_plan", f"""
    select day, category_name, {fx('markup', 4)} as markup, {fx('q', 4)} as order_qty, {fx('score', 3)} as score from grid_best""")
def z09(spark, sf):
    m = build(spark, sf)
    return sc.grid_plan(m.drawn, m.model, m.bounds).select(
        F.col("day").cast("long").alias("day"), CAT, *fixed_cols("markup", "order_qty", digits=4), fixed("score", 3).alias("score"))


@query("z10_sensitivity_sweep", f"""
    select g as goodwill_ratio, w as penalty_weight, count(*) as decisions, {fx('sum(q)', 3)} as weekly_order,
      {fx('avg(markup)', 5)} as mean_markup, {fx('sum(score)', 2)} as total_score from grid_sweep group by 1, 2""")
def z10(spark, sf):
    m = build(spark, sf)
    plan = sc.grid_plan(m.drawn, m.model, m.bounds, goodwill=[0.0, 0.05, 0.10, 0.20], weights=[0.0, 50.0, 80.0, 500.0])
    return plan.groupBy("goodwill_ratio", "penalty_weight").agg(
        F.count(F.lit(1)).alias("decisions"), fixed(F.sum("order_qty"), 3).alias("weekly_order"),
        fixed(F.avg("markup"), 5).alias("mean_markup"), fixed(F.sum("score"), 2).alias("total_score"))


def optimized(spark, sf):
    m = build(spark, sf)
    plan = stage(sc.grid_plan(m.drawn, m.model, m.bounds).select(CAT, "day", "markup", "order_qty"), "plan")
    return m, plan


@query("w08_change_violation", f"""
    select {fx('greatest(0, max(abs(markup - before) - markup_change))', 5)} as violation
    from (select g.markup, b.markup_change, coalesce(lag(g.markup) over (partition by g.category_name order by g.day), b.markup_reference) as before
          from grid_best g join bounds b on b.category_name = g.category_name)""")
def w08(spark, sf):
    m, plan = optimized(spark, sf)
    return sc.change_violation(plan, m.bounds).select(*fixed_cols("violation", digits=5))


@query("z11_bound_hits", """
    select count_if(abs(g.markup - b.markup_high) <= 1e-6) as upper_bound_hits, count(*) as decisions
    from grid_best g join bounds b on b.category_name = g.category_name""")
def z11(spark, sf):
    m, plan = optimized(spark, sf)
    return sc.bound_hits(plan, m.bounds)


part("grid_facts", f"""
    select s.scenario, s.day, s.category_name, g.q as order_qty, m.cost_future * (1 + g.markup) as price,
      {SQL_LEVEL.format('m.alpha_future + m.elasticity_used * ln(m.cost_future * (1 + g.markup)) + s.e')} as demand,
      m.cost_future * exp(s.u) as cost, (1 - m.loss_rate) * g.q as available
    from scen s join model m on m.category_name = s.category_name and m.day = s.day
    join grid_best g on g.category_name = s.category_name and g.day = s.day""")


def _model_row(name: str, facts: str) -> str:
    return f"""
    select '{name}' as model, (select sum(oq) from (select any_value(order_qty) as oq from {facts} group by category_name, day)) as total_order,
      avg(op) as expected, avg(case when rn <= ceil(0.1 * n) then op end) as lower_tail
    from (select *, row_number() over (order by op) as rn, count(*) over () as n
          from (select scenario, sum(price * least(demand, available) - cost * order_qty) as op from {facts} group by 1))"""


part("comparison", _model_row("baseline", "base_facts") + " union all " + _model_row("plan", "grid_facts"))


@query("z12_model_comparison", f"""
    select c.model, {fx('c.total_order', 3)} as total_order, {fx('c.expected', 3)} as expected, {fx('c.lower_tail', 3)} as lower_tail,
      {fx('c.expected / b.expected', 5)} as profit_ratio
    from comparison c, (select expected from comparison where model = 'baseline') b""")
def z12(spark, sf):
    m, plan = optimized(spark, sf)
    base = stage(sc.baseline_plan(m.drawn, m.model, m.bounds), "baseline")
    both = (base.withColumn("model", F.lit("baseline"))
            .unionByName(plan.select(*base.columns).withColumn("model", F.lit("plan"))))
    facts = sc.plan_facts(m.drawn, m.model, both)
    risk = sc.weekly_risk(facts, F.col("operating"), ["model"])
    orders = both.groupBy("model").agg(F.sum("order_qty").alias("total_order"))
    out = stage(risk.join(orders, "model"), "comparison")
    reference = out.where(F.col("model") == "baseline").select("expected").scalar()
    return out.select("model", *fixed_cols("total_order", "expected", "lower_tail", digits=3),
                      fixed(F.col("expected") / reference, 5).alias("profit_ratio"))


part("plan_penalty", """
    select 'baseline' as model, 80.0 * sum(pow(p.markup - b.markup_reference, 2)) as penalty from base_plan p join bounds b using (category_name)
    union all select 'plan', 80.0 * sum(pow(g.markup - b.markup_reference, 2)) from grid_best g join bounds b using (category_name)""")
part("week_profits", """
    with f as (select 'baseline' as model, scenario, price, cost, demand, available, order_qty from base_facts
               union all select 'plan', scenario, price, cost, demand, available, order_qty from grid_facts),
    w as (select model, scenario, sum(price * least(demand, available) - cost * order_qty) as op,
            sum(0.10 * greatest(0, price - cost) * greatest(0, demand - available)) as goodwill from f group by 1, 2)
    select model, scenario, 'operating' as measure, op as profit from w
    union all select model, scenario, 'service_adjusted', op - goodwill from w
    union all select model, scenario, 'regularized', op - goodwill - penalty from w join plan_penalty using (model)""")


def both_plans(spark, sf):
    """Model tables, and the baseline and the chosen plan told apart by `model`."""
    m, plan = optimized(spark, sf)
    base = stage(sc.baseline_plan(m.drawn, m.model, m.bounds), "baseline")
    return m, base.withColumn("model", F.lit("baseline")).unionByName(plan.select(*base.columns).withColumn("model", F.lit("plan")))


@query("z07_weekly_profits", f"""
    select split_part(k, '|', 1) as model, split_part(k, '|', 2) as measure, {fx_cols('expected', 'lower_tail', 'std', digits=3)},
      {fx('0.75 * expected + 0.25 * lower_tail', 3)} as objective
    from ({tail_sql('profit', 'n', 'k', "(select model || '|' || measure as k, scenario, profit from week_profits)")})""")
def z07_profits(spark, sf):
    m, both = both_plans(spark, sf)
    facts = sc.plan_facts(m.drawn, m.model, both)
    out = sc.weekly_profits(facts, sc.reference_penalty(both, m.bounds, ["model"]), ["model"])
    return out.select("model", "measure", *fixed_cols("expected", "lower_tail", "std", "objective", digits=3))


part("plan_rules", """
    with p as (select g.day, g.category_name, g.markup, g.q, b.markup_low, b.markup_high, b.order_upper, b.markup_reference, b.markup_change
               from grid_best g join bounds b using (category_name)),
    s as (select category_name, day, avg(demand) as demand, avg(least(demand, available)) as sales, avg(order_qty - least(demand, available)) as unsold,
            avg(case when demand > available + 1e-9 then 1.0 else 0.0 end) as prob, any_value(order_qty) as q, any_value(price) as price from grid_facts group by 1, 2)
    select (select count_if(markup < markup_low - 1e-9 or markup > markup_high + 1e-9) from p) as markup_in_bounds,
      (select count_if(q < -1e-9 or q > order_upper + 1e-9) from p) as order_in_bounds,
      (select count_if(day = 0 and abs(markup - markup_reference) > markup_change + 1e-9) from p) as first_day_change,
      (select count_if(abs(unsold - (q - sales)) > 1e-6) from s) as unsold_is_order_less_sales,
      (select count_if(sales > demand + 1e-9) from s) as sales_below_demand,
      (select count_if(prob < -1e-9 or prob > 1 + 1e-9) from s) as stockout_probability,
      (select count_if(s.price is null or s.demand is null or s.sales is null) from s) as finite_values,
      (select count_if(abs(s.price - m.cost_future * (1 + p.markup)) > 1e-6) from s join p using (category_name, day) join model m using (category_name, day)) as price_identity,
      (select count(*) from (select category_name, day from p except select category_name, day from model))
        + (select count(*) from (select category_name, day from model except select category_name, day from p)) as plan_is_complete""")


@query("v02_decision_rules", """
    select "table", check_name as "check", violations::bigint as violations, violations = 0 as passed from (unpivot plan_rules on
      markup_in_bounds, order_in_bounds, first_day_change, unsold_is_order_less_sales, sales_below_demand, stockout_probability, finite_values, price_identity, plan_is_complete
      into name check_name value violations)
    join (select unnest(['markup_in_bounds', 'order_in_bounds', 'first_day_change', 'plan_is_complete', 'unsold_is_order_less_sales', 'sales_below_demand',
        'stockout_probability', 'finite_values', 'price_identity']) as check_name,
      unnest(['plan', 'plan', 'plan', 'plan', 'summary', 'summary', 'summary', 'summary', 'summary']) as "table") using (check_name)""")
def v02_decisions(spark, sf):
    """Bounds, identities and completeness of the chosen plan and its summary, declared as rules."""
    m, plan = optimized(spark, sf)
    limits = m.bounds.select(CAT, "markup_low", "markup_high", "order_upper", "markup_reference", "markup_change")
    c = F.col
    made = sc.plan_summary(sc.plan_facts(m.drawn, m.model, plan)).join(plan, [CAT, "day"]).join(
        m.model.select(CAT, "day", "cost_future"), [CAT, "day"]).withColumn("price", c("cost_future") * (1 + c("markup")))
    plan_rules = [
        rules.within("markup_in_bounds", "markup", c("markup_low"), c("markup_high")), rules.within("order_in_bounds", "order_qty", 0.0, c("order_upper")),
        rules.Row("first_day_change", (c("day") == 0) & (F.abs(c("markup") - c("markup_reference")) > c("markup_change") + rules.TOLERANCE)),
        rules.Keys("plan_is_complete", (CAT, "day"), "model", both=True)]
    summary_rules = [
        rules.identity("unsold_is_order_less_sales", c("expected_unsold"), c("order_qty") - c("expected_sales")),
        rules.Row("sales_below_demand", c("expected_sales") > c("expected_demand") + rules.TOLERANCE),
        rules.probability("stockout_probability", "stockout_probability"), rules.known("finite_values", "price", "expected_demand", "expected_sales"),
        rules.identity("price_identity", c("price"), c("cost_future") * (1 + c("markup")))]
    return rules.compiled({"plan": plan.join(limits, CAT), "summary": stage(made, "summary"), "model": m.model}, {"plan": plan_rules, "summary": summary_rules})


@query("r16_day_similarity", f"""
    select a.day as source, b.day as target, {fx('corr(a.q, b.q)', 5)} as r
    from (select 'day' || day as day, category_name, order_qty as q from base_plan) a
    join (select 'day' || day as day, category_name, order_qty as q from base_plan) b on a.category_name = b.category_name and a.day < b.day
    group by 1, 2""")
def r16(spark, sf):
    plan = baseline(spark, sf)[1].withColumn("date", F.concat(F.lit("day"), F.col("day")))
    return pairs.pearson(plan, "date", [CAT], "order_qty").select("source", "target", fixed("r", 5).alias("r"))


@query("j07_metric_join", f"""
    select s.category_name, {fx('s.elasticity_raw')} as elasticity_raw, {fx('l.loss_rate')} as loss_rate, {fx('h.markup_p50')} as markup_p50
    from slope s join loss l on l.category_name = s.category_name join hist_q h on h.category_name = s.category_name""")
def j07(spark, sf):
    prep = prepared(spark, sf)
    out = (el.slopes(el.demeaned_residuals(prep)).join(el.loss_rates(prep), CAT, "inner")
           .join(el.history_quantiles(prep), CAT, "inner"))
    return out.select(CAT, *fixed_cols("elasticity_raw", "loss_rate", "markup_p50"))
