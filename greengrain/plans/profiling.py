"""Queries of the sales-profiling part: calendar, profile and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from greengrain.functions.exprs import (clip, elastic_response, fixed, level_from_log, log_price, log_qty, markup,
                                        ratio, sales_year, season_of, tenth, tenth_down, tenth_up)
from greengrain.operators import calendar, profile
from greengrain.plans.registry import fx, part, query
from greengrain.sources import tables

QTY = "gross_sales_qty"


def _daily_sql(keys: str, extra: str = "") -> str:
    return f"""
    select date, {keys}{extra},
      count(distinct case when sku_gross > 0 then sku end) as active_sku_count,
      count(distinct sku) as available_sku_count,
      cast(sum(case when flag <> 'R' then q else 0 end) as double) as gross_sales_qty,
      cast(sum(case when flag = 'R' then q else 0 end) as double) as return_qty,
      cast(sum(case when flag <> 'R' then q else 0 end) as double)
        - cast(sum(case when flag = 'R' then q else 0 end) as double) as net_sales_qty,
      cast(sum(case when flag <> 'R' then rev else 0 end) as double) as gross_revenue,
      cast(sum(case when flag <> 'R' then rev else 0 end) as double)
        / nullif(cast(sum(case when flag <> 'R' then q else 0 end) as double), 0) as gross_weighted_avg_price,
      cast(sum(qcost) as double) / nullif(cast(sum(q) as double), 0) as wholesale_price,
      100 * cast(sum(qloss) as double) / nullif(cast(sum(q) as double), 0) as loss_rate_pct
    from lines group by date, {keys}"""


part("lines", """
    select cast(l.l_shipdate as date) as date, p.p_type as category_name, p.p_brand as item_name,
      p.p_type || '/' || p.p_brand as product, p.p_name as sku_name, l.l_partkey as sku,
      l.l_returnflag as flag, cast(l.l_quantity as decimal(12,2)) as q,
      cast(l.l_extendedprice as decimal(12,2)) * (cast(1 as decimal(3,2)) - cast(l.l_discount as decimal(3,2))) as rev,
      cast(l.l_quantity as decimal(12,2)) * cast(p.p_retailprice as decimal(12,2)) as qcost,
      cast(l.l_quantity as decimal(12,2)) * cast(l.l_tax as decimal(3,2)) as qloss,
      sum(case when l.l_returnflag <> 'R' then l.l_quantity else 0 end)
        over (partition by l.l_partkey, cast(l.l_shipdate as date)) as sku_gross
    from lineitem l join part p on l.l_partkey = p.p_partkey""")
part("cat_day", _daily_sql("category_name"))
part("item_day", _daily_sql("item_name"))
part("product_day", _daily_sql("category_name, product").replace("category_name, product", "category_name, product as sku_code", 1))
part("sku_day", _daily_sql("sku, sku_name, category_name, item_name").replace(
    "sku, sku_name, category_name, item_name", "cast(sku as varchar) as sku_code, sku_name, category_name, item_name", 1))


def _dense(name: str, source: str, entity: str) -> None:
    part(name, f"""
    select e.{entity}, d.date, coalesce(f.gross_sales_qty, 0.0) as qty
    from (select distinct {entity} from {source}) e
    cross join (select cast(unnest(generate_series((select min(date) from {source}), (select max(date) from {source}),
                interval 1 day)) as date) as date) d
    left join {source} f on f.{entity} = e.{entity} and f.date = d.date""")


_dense("cat_dense", "cat_day", "category_name")
_dense("item_dense", "item_day", "item_name")
_dense("product_dense", "product_day", "sku_code")

SEASON_SQL = ("case when month between 3 and 5 then 'spring' when month between 6 and 8 then 'summer' "
              "when month between 9 and 11 then 'autumn' else 'winter' end")


def _monthly(name: str, dense: str, entity: str) -> None:
    part(name, f"""
    select *, coalesce(avg_daily_sales / nullif(avg(avg_daily_sales) over (partition by {entity}), 0), 0) as seasonal_index
    from (select {entity}, month, avg(qty / days) as avg_daily_sales,
            coalesce(avg(case when year_qty > 0 then qty / year_qty end), 0) as sales_proportion,
            avg(active / days) as active_rate
          from (select *, sum(qty) over (partition by {entity}, sales_year) as year_qty
                from (select {entity}, year(date) - (case when month(date) < 7 then 1 else 0 end) as sales_year,
                        month(date) as month, sum(qty) as qty, count_if(qty > 0) as active, count(*) as days
                      from {dense} group by 1, 2, 3))
          group by {entity}, month)""")


_monthly("cat_month", "cat_dense", "category_name")
_monthly("item_month", "item_dense", "item_name")
_monthly("product_month", "product_dense", "sku_code")

PROFILE_COLS = ["avg_daily_sales", "sales_proportion", "active_rate", "seasonal_index"]
FX_PROFILE = ", ".join(f"{fx(c)} as {c}" for c in PROFILE_COLS)


def day(c: str = "date"):
    return F.col(c).cast("string").alias(c)


def fixed_cols(*names: str, digits: int = 6):
    return [fixed(n, digits).alias(n) for n in names]


def fx_cols(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{fx(n, digits)} as {n}" for n in names)


# ---------------------------------------------------------------- projections

@query("p01_activity", f"""
    select sku_code, record_days, cast(first_date as varchar) as first_date, cast(last_date as varchar) as last_date,
      sales_days, span_days, {fx_cols('total_qty', 'coverage')},
      span_days >= 1500 as pass_span, sales_days >= 15 as pass_sales_days, total_qty >= 400 as pass_total_qty,
      reason = '' as included, case when reason = '' then 'included' else reason end as selection_reason
    from (select *, record_days / nullif(cast(span_days as double), 0) as coverage,
            concat_ws(';', case when span_days < 1500 then 'span' end, case when sales_days < 15 then 'sales_days' end,
                      case when total_qty < 400 then 'total_qty' end) as reason
          from (select sku_code, count(*) as record_days, min(case when gross_sales_qty > 0 then date end) as first_date,
                  max(case when gross_sales_qty > 0 then date end) as last_date,
                  count_if(gross_sales_qty > 0) as sales_days, sum(gross_sales_qty) as total_qty,
                  coalesce(date_diff('day', min(case when gross_sales_qty > 0 then date end),
                     max(case when gross_sales_qty > 0 then date end)) + 1, 0) as span_days
                from sku_day group by sku_code))""")
def p01(spark, sf):
    # SKUs are sparse here (about 20 sale days each), so the thresholds are lower than the defaults
    out = profile.activity(tables.sku_day(spark, sf), "sku_code", QTY, 1500, 15, 400.0)
    return out.select("sku_code", "record_days", day("first_date"), day("last_date"), "sales_days", "span_days",
                      *fixed_cols("total_qty", "coverage"), "pass_span", "pass_sales_days", "pass_total_qty",
                      "included", "selection_reason")


@query("p02_calendar_features", f"""
    select category_name, cast(date as varchar) as date,
      {fx('sin(2 * pi() * (isodow(date) - 1) / 7)')} as dow_sin, {fx('cos(2 * pi() * (isodow(date) - 1) / 7)')} as dow_cos,
      {fx('sin(2 * pi() * dayofyear(date) / 365.25)')} as doy_sin, {fx('cos(2 * pi() * dayofyear(date) / 365.25)')} as doy_cos,
      {fx('sin(2 * pi() * month(date) / 12)')} as month_sin, {fx('cos(2 * pi() * month(date) / 12)')} as month_cos,
      {fx('(row_number() over (partition by category_name order by date) - 1) / cast(greatest(1, count(*) over (partition by category_name) - 1) as double)')} as trend
    from cat_dense""")
def p02(spark, sf):
    dense = calendar.dense_calendar(tables.category_day(spark, sf), "category_name", [QTY])
    out = calendar.calendar_features(dense, "category_name")
    return out.select("category_name", day(), *fixed_cols(
        "dow_sin", "dow_cos", "doy_sin", "doy_cos", "month_sin", "month_cos", "trend"))


@query("p03_season_labels", f"""
    select season, sales_year, count(*) as sku_days, {fx('sum(gross_sales_qty)')} as qty
    from (select *, {SEASON_SQL.replace('month', 'month(date)')} as season,
            year(date) - (case when month(date) < 7 then 1 else 0 end) as sales_year from sku_day)
    group by season, sales_year""")
def p03(spark, sf):
    labelled = tables.sku_day(spark, sf).select(
        season_of(F.month("date")).alias("season"), sales_year("date").alias("sales_year"), QTY)
    return labelled.groupBy("season", "sales_year").agg(
        F.count(F.lit(1)).alias("sku_days"), fixed(F.sum(QTY)).alias("qty"))


@query("p04_log_transforms", f"""
    select sku_code, cast(date as varchar) as date, {fx('ln(1 + greatest(gross_sales_qty, 0))')} as logq,
      {fx('case when gross_weighted_avg_price is not null then ln(greatest(gross_weighted_avg_price, 1e-6)) end')} as logp,
      {fx('greatest(0, exp(least(greatest(ln(1 + gross_sales_qty) + 1 , -700), 700)) - 1)', 4)} as level
    from sku_day""")
def p04(spark, sf):
    return tables.sku_day(spark, sf).select(
        "sku_code", day(), fixed(log_qty(QTY)).alias("logq"),
        fixed(log_price("gross_weighted_avg_price")).alias("logp"),
        fixed(level_from_log(log_qty(QTY) + 1.0), 4).alias("level"))


@query("p05_markup", f"""
    select sku_code, cast(date as varchar) as date,
      {fx('gross_weighted_avg_price / nullif(wholesale_price, 0) - 1')} as markup from sku_day""")
def p05(spark, sf):
    return tables.sku_day(spark, sf).select(
        "sku_code", day(), fixed(markup("gross_weighted_avg_price", "wholesale_price")).alias("markup"))


@query("p06_winsorize", f"""
    select category_name, cast(date as varchar) as date, {fx('c - avg(c) over (partition by category_name)')} as centered
    from (select d.category_name, d.date, least(greatest(qty, lo), hi) as c
          from cat_dense d join (select category_name, quantile_cont(qty, 0.01) as lo, quantile_cont(qty, 0.99) as hi
                                 from cat_dense group by 1) q on q.category_name = d.category_name)""")
def p06(spark, sf):
    dense = calendar.dense_calendar(tables.category_day(spark, sf), "category_name", [QTY])
    return (calendar.winsorized(dense, "category_name", {QTY: "centered"})
            .select("category_name", day(), *fixed_cols("centered")))


@query("p07_price_steps", f"""
    select sku_code, cast(date as varchar) as date, {fx('floor(wholesale_price * 1.2 * 10 + 0.5) / 10')} as price,
      {fx('ceil(wholesale_price * 1.1 * 10 - 1e-9) / 10')} as lowest,
      {fx('floor(wholesale_price * 1.5 * 10 + 1e-9) / 10')} as highest
    from sku_day""")
def p07(spark, sf):
    cost = F.col("wholesale_price")
    return tables.sku_day(spark, sf).select(
        "sku_code", day(), fixed(tenth(cost * 1.2)).alias("price"),
        fixed(tenth_up(cost * 1.1)).alias("lowest"), fixed(tenth_down(cost * 1.5)).alias("highest"))


@query("p08_elastic_response", f"""
    select category_name, cast(date as varchar) as date,
      {fx('pow(gross_weighted_avg_price / wholesale_price, -0.8)')} as response
    from cat_day where gross_weighted_avg_price > 0""")
def p08(spark, sf):
    return (tables.category_day(spark, sf).where(F.col("gross_weighted_avg_price") > 0)
            .select("category_name", day(), fixed(elastic_response(
                "gross_weighted_avg_price", "wholesale_price", F.lit(-0.8))).alias("response")))


# ---------------------------------------------------------------- calendars and windows

@query("j01_dense_calendar", f"""
    select item_name, cast(date as varchar) as date, {fx('qty')} as gross_sales_qty from item_dense""")
def j01(spark, sf):
    return (calendar.dense_calendar(tables.item_day(spark, sf), "item_name", [QTY])
            .select("item_name", day(), *fixed_cols(QTY)))


part("product_span", """
    select d.sku_code, d.date, case when d.date between s.a and s.b then d.qty end as qty
    from product_dense d left join (select sku_code, min(date) as a, max(date) as b from product_day
                                    where gross_sales_qty > 0 group by 1) s on s.sku_code = d.sku_code""")


@query("j02_span_calendar", f"""
    select sku_code, cast(date as varchar) as date, {fx('qty')} as gross_sales_qty from product_span""")
def j02(spark, sf):
    return (calendar.span_calendar(tables.product_day(spark, sf), "sku_code", QTY)
            .select("sku_code", day(), *fixed_cols(QTY)))


@query("j03_future_rows", f"""
    select e.category_name, cast(d.date as varchar) as date, d.date <= m.last as is_history,
      {fx('case when d.date <= m.last then coalesce(f.gross_sales_qty, 0) end')} as gross_sales_qty
    from (select distinct category_name from cat_day) e
    cross join (select min(date) as first, max(date) as last from cat_day) m
    cross join (select cast(unnest(generate_series((select min(date) from cat_day),
        (select max(date) from cat_day) + interval 7 day, interval 1 day)) as date) as date) d
    left join cat_day f on f.category_name = e.category_name and f.date = d.date""")
def j03(spark, sf):
    return (calendar.dense_calendar(tables.category_day(spark, sf), "category_name", [QTY], extra_days=7)
            .select("category_name", day(), "is_history", *fixed_cols(QTY)))


def _item_log(spark, sf):
    dense = calendar.dense_calendar(tables.item_day(spark, sf), "item_name", [QTY])
    return dense.withColumn("logq", log_qty(QTY))


LAGS = (1, 7, 14, 21, 28, 56)


@query("w01_lags", f"""
    select item_name, cast(date as varchar) as date,
      {', '.join(fx(f'lag(ln(1 + qty), {k}) over (partition by item_name order by date)') + f' as logq_lag{k}' for k in LAGS)}
    from item_dense""")
def w01(spark, sf):
    return _item_log(spark, sf).select("item_name", day(), *[
        fixed(calendar.lag_of("logq", k, "item_name")).alias(f"logq_lag{k}") for k in LAGS])


def _roll_sql(f: str, length: int, shift: int) -> str:
    frame = f"over (partition by item_name order by date rows between {shift + length - 1} preceding and {shift} preceding)"
    return f"case when count(logq) {frame} = {length} then {f}(logq) {frame} end"


@query("w02_rolling", f"""
    select item_name, cast(date as varchar) as date, {fx(_roll_sql('avg', 7, 1))} as ma7_s1,
      {fx(_roll_sql('avg', 28, 1))} as ma28_s1, {fx(_roll_sql('stddev_samp', 28, 1))} as sd28_s1,
      {fx(_roll_sql('avg', 7, 7))} as ma7_s7, {fx(_roll_sql('stddev_samp', 28, 7))} as sd28_s7
    from (select *, ln(1 + qty) as logq from item_dense)""")
def w02(spark, sf):
    roll = calendar.rolling
    return _item_log(spark, sf).select(
        "item_name", day(), fixed(roll("logq", "item_name", 7, 1)).alias("ma7_s1"),
        fixed(roll("logq", "item_name", 28, 1)).alias("ma28_s1"),
        fixed(roll("logq", "item_name", 28, 1, "std")).alias("sd28_s1"),
        fixed(roll("logq", "item_name", 7, 7)).alias("ma7_s7"),
        fixed(roll("logq", "item_name", 28, 7, "std")).alias("sd28_s7"))


@query("w03_fill", f"""
    select item_name, cast(date as varchar) as date, {fx('coalesce(a, b)')} as price
    from (select item_name, date,
            last_value(p ignore nulls) over (partition by item_name order by date
              rows between unbounded preceding and current row) as a,
            first_value(p ignore nulls) over (partition by item_name order by date
              rows between current row and unbounded following) as b
          from (select d.item_name, d.date, f.gross_weighted_avg_price as p from item_dense d
                left join item_day f on f.item_name = d.item_name and f.date = d.date))""")
def w03(spark, sf):
    dense = calendar.dense_calendar(tables.item_day(spark, sf), "item_name", [QTY],
                                    keep=["gross_weighted_avg_price"])
    return dense.select("item_name", day(), fixed(
        calendar.fill_gaps("gross_weighted_avg_price", "item_name")).alias("price"))


part("item_detrended", """
    select item_name, date, qty, ln(1 + qty) - avg(ln(1 + qty)) over (partition by item_name, date_trunc('month', date)) as x
    from item_dense""")


@query("w04_month_demean", f"""
    select item_name, cast(date as varchar) as date, {fx('x')} as detrended from item_detrended""")
def w04(spark, sf):
    dense = calendar.dense_calendar(tables.item_day(spark, sf), "item_name", [QTY])
    return dense.select("item_name", day(),
                        fixed(calendar.month_demeaned_log(QTY, "item_name")).alias("detrended"))


@query("w05_daily_share", f"""
    select sku_code, cast(date as varchar) as date,
      {fx('gross_sales_qty / nullif(sum(gross_sales_qty) over (partition by date), 0)', 9)} as share
    from sku_day""")
def w05(spark, sf):
    return (calendar.daily_share(tables.sku_mart(spark, sf), QTY)
            .select("sku_code", day(), *fixed_cols("share", digits=9)))


@query("w07_change_quantile", f"""
    select category_name, {fx('quantile_cont(c, 0.9)')} as change_quantile, count(c) as n_changes
    from (select category_name, abs(m - lag(m) over (partition by category_name order by date)) as c
          from (select category_name, date, gross_weighted_avg_price / wholesale_price - 1 as m from cat_day
                where gross_weighted_avg_price is not null))
    group by category_name""")
def w07(spark, sf):
    marked = (tables.category_day(spark, sf).where(F.col("gross_weighted_avg_price").isNotNull())
              .withColumn("markup", markup("gross_weighted_avg_price", "wholesale_price")))
    return (calendar.change_quantile(marked, "category_name", "markup")
            .select("category_name", *fixed_cols("change_quantile"), "n_changes"))


@query("w10_last_rows", f"""
    select sku_code, cast(date as varchar) as date, {fx('gross_sales_qty')} as gross_sales_qty
    from (select *, row_number() over (partition by sku_code order by date desc) as rn from sku_day) where rn <= 5""")
def w10(spark, sf):
    return calendar.last_rows(tables.sku_day(spark, sf), "sku_code", 5).select("sku_code", day(), *fixed_cols(QTY))


part("item_decomposed", """
    select *, x - trend - weekly - yearly as residual
    from (select *, avg(x - trend - weekly) over (partition by item_name, dayofyear(date)) as yearly
      from (select *, avg(x - trend) over (partition by item_name, isodow(date)) as weekly
        from (select item_name, date, ln(1 + qty) as x, avg(ln(1 + qty)) over (partition by item_name order by date
                rows between 182 preceding and 182 following) as trend from item_dense)))""")


@query("w16_decompose", f"""
    select item_name, cast(date as varchar) as date, {fx_cols('trend', 'weekly', 'yearly', 'residual')}
    from item_decomposed""")
def w16(spark, sf):
    return (calendar.decompose(_item_log(spark, sf), "item_name", "logq")
            .select("item_name", day(), *fixed_cols("trend", "weekly", "yearly", "residual")))


# ---------------------------------------------------------------- profiles

@query("a01_monthly_profile", f"select category_name, month, {FX_PROFILE} from cat_month")
def a01(spark, sf):
    return (profile.monthly_profile(tables.category_day(spark, sf), "category_name", QTY)
            .select("category_name", "month", *fixed_cols(*PROFILE_COLS)))


@query("a01_monthly_profile_products", f"select sku_code, month, {FX_PROFILE} from product_month")
def a01_products(spark, sf):
    return (profile.monthly_profile(tables.product_day(spark, sf), "sku_code", QTY)
            .select("sku_code", "month", *fixed_cols(*PROFILE_COLS)))


@query("a02_seasonal_profile", f"""
    select item_name, season, {FX_PROFILE}
    from (select item_name, {SEASON_SQL} as season, avg(avg_daily_sales) as avg_daily_sales,
            sum(sales_proportion) as sales_proportion, avg(active_rate) as active_rate,
            avg(seasonal_index) as seasonal_index
          from item_month group by 1, 2)""")
def a02(spark, sf):
    monthly = profile.monthly_profile(tables.item_day(spark, sf), "item_name", QTY)
    return profile.seasonal_profile(monthly, "item_name").select("item_name", "season", *fixed_cols(*PROFILE_COLS))


@query("a03_peaks", f"""
    select p.item_name, p.month as peak_month, {fx('p.seasonal_index')} as peak_month_index,
      {SEASON_SQL.replace('month', 'p.month')} as peak_season, {fx('s.hi / (s.lo + 1e-12)', 4)} as season_concentration
    from (select *, row_number() over (partition by item_name order by floor(seasonal_index * 1e9 + 0.5) desc, month) as rn from item_month) p
    join (select item_name, max(sh) as hi, min(sh) as lo
          from (select item_name, {SEASON_SQL} as season, sum(sales_proportion) as sh from item_month group by 1, 2)
          group by 1) s on s.item_name = p.item_name
    where p.rn = 1""")
def a03(spark, sf):
    monthly = profile.monthly_profile(tables.item_day(spark, sf), "item_name", QTY)
    return profile.peaks(monthly, "item_name").select(
        "item_name", "peak_month", *fixed_cols("peak_month_index"), "peak_season",
        *fixed_cols("season_concentration", digits=4))


@query("a04_index_table", "select item_name, " + ", ".join(
    fx(f"max(case when month = {m} then seasonal_index end)") + f" as month_{m}" for m in range(1, 13))
    + " from item_month group by item_name")
def a04(spark, sf):
    monthly = profile.monthly_profile(tables.item_day(spark, sf), "item_name", QTY)
    return profile.index_table(monthly, "item_name").select(
        "item_name", *fixed_cols(*[f"month_{m}" for m in range(1, 13)]))


@query("a05_zero_inflation", f"""
    select sku_code, count(qty) as n_days, {fx('count_if(qty <= 0) / cast(count(qty) as double)')} as zero_share,
      {fx('avg(qty)')} as mean_qty, {fx('quantile_cont(qty, 0.5)')} as median_qty, {fx('stddev_pop(qty)')} as std_qty,
      {fx('avg(pow(z, 3))', 4)} as skewness, count_if(qty > 0) as n_positive,
      {fx('avg(case when qty > 0 then qty end)')} as positive_mean,
      {fx('quantile_cont(case when qty > 0 then qty end, 0.5)')} as positive_median,
      {fx('stddev_pop(case when qty > 0 then qty end)')} as positive_std
    from (select sku_code, qty, (qty - avg(qty) over (partition by sku_code))
            / nullif(stddev_pop(qty) over (partition by sku_code), 0) as z from product_dense)
    group by sku_code""")
def a05(spark, sf):
    dense = calendar.dense_calendar(tables.product_day(spark, sf), "sku_code", [QTY])
    return profile.zero_inflation(dense, "sku_code", QTY).select(
        "sku_code", "n_days", *fixed_cols("zero_share", "mean_qty", "median_qty", "std_qty"),
        *fixed_cols("skewness", digits=4), "n_positive",
        *fixed_cols("positive_mean", "positive_median", "positive_std"))


@query("a06_distinct_counts", """
    select sku_code, count(distinct date) as distinct_date,
      count(distinct gross_weighted_avg_price) as distinct_gross_weighted_avg_price
    from sku_day group by sku_code""")
def a06(spark, sf):
    return profile.distinct_counts(tables.sku_mart(spark, sf), "sku_code", ["date", "gross_weighted_avg_price"])


@query("a15_box_stats", f"""
    select d.category_name, {fx('any_value(q1)')} as q1, {fx('any_value(median)')} as median, {fx('any_value(q3)')} as q3,
      count(*) as n, {fx('min(case when v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then v end)')} as whisker_low,
      {fx('max(case when v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then v end)')} as whisker_high,
      count_if(not (v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))) as outliers
    from (select category_name, log10(1 + gross_sales_qty) as v from sku_day where gross_sales_qty > 0) d
    join (select category_name, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3
          from (select category_name, log10(1 + gross_sales_qty) as v from sku_day where gross_sales_qty > 0)
          group by 1) q on q.category_name = d.category_name
    group by d.category_name""")
def a15(spark, sf):
    return profile.box_stats(tables.sku_mart(spark, sf), "category_name", QTY).select(
        "category_name", *fixed_cols("q1", "median", "q3"), "n", *fixed_cols("whisker_low", "whisker_high"), "outliers")


FEATURES = [f"prop_month_{m}" for m in range(1, 13)] + [f"active_month_{m}" for m in range(1, 13)]
part("product_features_raw", "select sku_code, " + ", ".join(
    [f"max(case when month = {m} then sales_proportion end) as prop_month_{m}" for m in range(1, 13)]
    + [f"max(case when month = {m} then active_rate end) as active_month_{m}" for m in range(1, 13)])
    + " from product_month group by sku_code")
part("product_features", "select sku_code, " + ", ".join(
    f"coalesce(({n} - avg({n}) over ()) / nullif(stddev_pop({n}) over (), 0), 0) as {n}" for n in FEATURES)
    + " from product_features_raw")


@query("c01_cluster_features", f"select sku_code, {fx_cols(*FEATURES)} from product_features")
def c01(spark, sf):
    monthly = profile.monthly_profile(tables.product_day(spark, sf), "sku_code", QTY)
    return profile.cluster_features(monthly, "sku_code").select("sku_code", *fixed_cols(*FEATURES))
