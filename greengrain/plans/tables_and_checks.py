"""Queries over sources, sinks, data-quality rules, and the plain table operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from greengrain.functions.exprs import fixed, markup, ratio
from greengrain.functions.staging import shared_folder, stage
from greengrain.operators import network, profile
from greengrain.plans import category_plan as cp
from greengrain.plans.profiling import QTY, day, fixed_cols, fx_cols
from greengrain.plans.registry import fx, part, query
from greengrain.plans.relationships import detrended, whole_ranks
from greengrain.sources import checks, files, rules, tables

MEASURES = ["gross_sales_qty", "return_qty", "net_sales_qty", "gross_revenue", "gross_weighted_avg_price", "wholesale_price", "loss_rate_pct"]


def _path(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("s01_read_csv", f"select sku_code, cast(date as varchar) as date, {fx_cols('gross_sales_qty', 'gross_revenue')} from sku_day")
def s01(spark, sf):
    path = _path(spark, "sku_csv")
    files.write_csv(tables.sku_day(spark, sf).select("sku_code", "date", QTY, "gross_revenue"), path)
    back = files.read_csv(spark, path, f"sku_code string, date date, {QTY} double, gross_revenue double")
    return back.select("sku_code", day(), *fixed_cols(QTY, "gross_revenue"))


@query("s02_column_subset", "select l_orderkey, l_quantity from lineitem")
def s02(spark, sf):
    return tables.read(spark, sf, "lineitem").select("l_orderkey", "l_quantity")


@query("s03_read_json", f"""
    select category_name, count(*) as days, {fx('sum(gross_sales_qty)', 4)} as total_qty from cat_day group by 1""")
def s03(spark, sf):
    path = _path(spark, "summary_json")
    (tables.category_day(spark, sf).groupBy("category_name").agg(
        F.count(F.lit(1)).alias("days"), fixed(F.sum(QTY), 4).alias("total_qty")).write.json(path))
    return files.read_json(spark, path, "category_name string, days long, total_qty double", multi_line=False)


@query("s04_write_parquet", f"select category_name, cast(date as varchar) as date, {fx_cols(*MEASURES, digits=4)} from cat_day")
def s04(spark, sf):
    path = _path(spark, "category_parquet")
    files.write_parquet(tables.category_day(spark, sf), path, ["category_name"])
    return spark.read.parquet(path).select("category_name", day(), *fixed_cols(*MEASURES, digits=4))


@query("s05_summary_record", f"""
    select 'sales' as section, 'rows' as key, cast(count(*) as double) as value from sku_day
    union all select 'sales', 'total_qty', {fx('sum(gross_sales_qty)', 3)} from sku_day
    union all select 'sales', 'returned_qty', {fx('sum(return_qty)', 3)} from sku_day
    union all select 'categories', category_name, {fx('sum(gross_sales_qty)', 3)} from cat_day group by category_name""")
def s05(spark, sf):
    daily = tables.sku_mart(spark, sf)
    sums = daily.agg(F.count(F.lit(1)).cast("double").alias("rows"), fixed(F.sum(QTY), 3).alias("total_qty"),
                     fixed(F.sum("return_qty"), 3).alias("returned_qty"))
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit("sales").alias("section"), F.lit(k).alias("key"), F.col(k).alias("value"))
                                           for k in ("rows", "total_qty", "returned_qty")])).alias("r")).select("r.*")
    per = daily.groupBy("category_name").agg(fixed(F.sum(QTY), 3).alias("value"))
    return rows.unionByName(per.select(F.lit("categories").alias("section"), F.col("category_name").alias("key"), "value"))


for name, src, entity, fn in (("sku", "sku_day", "sku_code", tables.sku_day), ("item", "item_day", "item_name", tables.item_day),
                              ("category", "cat_day", "category_name", tables.category_day)):
    counts = "" if name == "sku" else "active_sku_count, available_sku_count, "

    def _mart(spark, sf, fn=fn, entity=entity, name=name):
        extra = [] if name == "sku" else ["active_sku_count", "available_sku_count"]
        return fn(spark, sf).select(entity, day(), *extra, *fixed_cols(*MEASURES, digits=5))

    query(f"s06_{name}_day", f"select {entity}, cast(date as varchar) as date, {counts}{fx_cols(*MEASURES, digits=5)} from {src}")(_mart)


@query("s07_data_quality", f"""
    with l as (select coalesce(p_type, 'unknown') as category_name, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_returnflag, l_extendedprice / nullif(l_quantity, 0) as price
               from lineitem left join part on l_partkey = p_partkey),
    q as (select category_name, quantile_cont(price, 0.25) as q1, quantile_cont(price, 0.75) as q3 from l group by 1),
    again as (select category_name, sum(k - 1)::bigint as duplicate_lines from (select category_name, count(*) as k from l
        group by category_name, l_partkey, l_shipdate, l_quantity, price, l_returnflag having count(*) > 1) group by 1),
    unsold as (select category_name, count(*) as zero_sale_cost_pairs from (select category_name, l_partkey, l_shipdate from l group by 1, 2, 3
        having sum(case when l_returnflag <> 'R' then l_quantity else 0 end) = 0) group by 1)
    select l.category_name, count(*) as row_count, count_if(l_returnflag = 'R') as returns, count_if(price is null) as null_prices,
      count_if(price <= 0.1) as low_prices, count_if(price < q1 - 1.5 * (q3 - q1) or price > q3 + 1.5 * (q3 - q1)) as outliers,
      {fx('any_value(q1)')} as q1, {fx('any_value(q3)')} as q3, coalesce(any_value(duplicate_lines), 0) as duplicate_lines,
      coalesce(any_value(zero_sale_cost_pairs), 0) as zero_sale_cost_pairs
    from l join q on q.category_name = l.category_name left join again on again.category_name = l.category_name
    left join unsold on unsold.category_name = l.category_name group by 1""")
def s07(spark, sf):
    return checks.ledger_quality(ledger_lines(spark, sf)).select(
        "category_name", "row_count", "returns", "null_prices", "low_prices", "outliers", *fixed_cols("q1", "q3"), "duplicate_lines", "zero_sale_cost_pairs")


def ledger_lines(spark, sf):
    """Ledger lines with the category of their product, `unknown` where the product is not known."""
    lines = tables.read(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("sku"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("quantity"),
        (F.col("l_returnflag") == "R").alias("is_return"), ratio("l_extendedprice", "l_quantity").alias("price"))
    parts = tables.read(spark, sf, "part").select(F.col("p_partkey").alias("sku"), F.col("p_type").alias("category_name"))
    return lines.join(parts, "sku", "left").na.fill({"category_name": "unknown"})


@query("s08_scenario_supplement", f"""
    select r.category_name, cast(cast(m.last + cast(d as integer) as date) as varchar) as date,
      {fx_cols('q10', 'q50', 'q90', 'c10', 'c50', 'c90')}
    from (select category_name, quantile_cont(gross_sales_qty, 0.1) as q10, quantile_cont(gross_sales_qty, 0.5) as q50, quantile_cont(gross_sales_qty, 0.9) as q90,
            quantile_cont(wholesale_price, 0.1) as c10, quantile_cont(wholesale_price, 0.5) as c50, quantile_cont(wholesale_price, 0.9) as c90
          from cat_day where date > (select max(date) from cat_day) - 30 group by 1) r,
      (select max(date) as last from cat_day) m, (select unnest(range(1, 8)) as d)""")
def s08(spark, sf):
    daily = tables.category_day(spark, sf)
    last = daily.select(F.max("date")).scalar()
    recent = daily.where(F.col("date") > F.date_sub(last, 30)).groupBy("category_name").agg(
        F.percentile(QTY, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"),
        F.percentile("wholesale_price", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("c"))
    dates = F.explode(F.sequence(F.date_add(last, 1), F.date_add(last, 7), F.expr("interval 1 day")))
    return recent.withColumn("date", dates).select("category_name", day(), *[
        fixed(F.col(k)[i]).alias(f"{k}{p}") for k in "qc" for i, p in enumerate((10, 50, 90))])


@query("v01_table_rules", f"""
    select count(*) as row_count, (select count(*) from (select 1 from sku_day group by date, sku_code having count(*) > 1)) as duplicate_keys,
      cast(min(date) as varchar) as first_date, cast(max(date) as varchar) as last_date, count_if(gross_sales_qty < 0) as neg_gross_sales_qty,
      count_if(gross_weighted_avg_price < 0) as neg_gross_weighted_avg_price, count_if(gross_sales_qty is null) as null_gross_sales_qty,
      count_if(gross_weighted_avg_price is null) as null_gross_weighted_avg_price from sku_day""")
def v01(spark, sf):
    daily = checks.require_columns(tables.sku_day(spark, sf), ["date", "sku_code", QTY])
    # nearly every key is one row, so rows are dealt as they are, to as many tasks as the ledger asks for
    daily = daily.select("date", "sku_code", QTY, "gross_weighted_avg_price").repartition(tables.line_tasks(spark, sf), "date", "sku_code")
    out = checks.table_rules(daily, ["date", "sku_code"], [QTY, "gross_weighted_avg_price"])
    return out.select("row_count", "duplicate_keys", day("first_date"), day("last_date"), *[
        f"{p}_{c}" for p in ("neg", "null") for c in (QTY, "gross_weighted_avg_price")])


part("v02_counts", """
    select count_if(sales > demand + 1e-9) as sales_above_demand, count_if(sales > available + 1e-9) as sales_above_stock, count_if(demand < 0) as negative_demand,
      count_if(order_qty < 0) as negative_order, count_if(abs(price - cost0 * (1 + markup)) > 1e-6) as price_identity
    from (select f.*, m.cost_future as cost0 from base_facts f join model m on m.category_name = f.category_name and m.day = f.day)""")


@query("v02_plan_rules", """select check_name as "check", violations = 0 as passed, violations from (unpivot v02_counts on
      sales_above_demand, sales_above_stock, negative_demand, negative_order, price_identity into name check_name value violations)""")
def v02(spark, sf):
    facts = cp.baseline(spark, sf)[2]
    c = F.col
    return checks.stack(facts, {
        "sales_above_demand": c("sales") > c("demand") + 1e-9, "sales_above_stock": c("sales") > c("available") + 1e-9,
        "negative_demand": c("demand") < 0, "negative_order": c("order_qty") < 0,
        "price_identity": F.abs(c("price") - c("cost_future") * (1 + c("markup"))) > 1e-6})


@query("v03_reconcile", f"""
    select category_name, cast(date as varchar) as date, {fx('s', 4)} as fine_total, {fx('gross_sales_qty', 4)} as coarse_total, abs(s - gross_sales_qty) <= 1e-6 as passed
    from cat_day join (select category_name, date, sum(gross_sales_qty) as s from sku_day group by 1, 2) using (category_name, date)""")
def v03(spark, sf):
    out = checks.reconcile(tables.sku_day(spark, sf), tables.category_day(spark, sf), ["category_name", "date"], QTY)
    return out.select("category_name", day(), *fixed_cols("fine_total", "coarse_total", digits=4), "passed")


@query("v04_shares_sum", "select sku_code, abs(sum(sales_proportion) - 1) <= 1e-9 as passed from product_month group by 1")
def v04(spark, sf):
    monthly = profile.monthly_profile(tables.product_day(spark, sf), "sku_code", QTY)
    return checks.shares_sum_to_one(monthly, ["sku_code"], "sales_proportion").select("sku_code", "passed")


@query("v05_missing_keys", """
    select category_name, cast(date as varchar) as date from (select category_name, date from cat_day where return_qty > 0
      except select category_name, date from cat_day where gross_sales_qty > 0)""")
def v05(spark, sf):
    daily = tables.category_day(spark, sf)
    return checks.missing_keys(daily.where("return_qty > 0"), daily.where(F.col(QTY) > 0), ["category_name", "date"]).select(
        "category_name", day())


@query("v06_completeness", "select sku_code, count(*) as found, cast(1 as bigint) as copies, count(*) = 12 as passed from product_month group by 1")
def v06(spark, sf):
    monthly = profile.monthly_profile(tables.product_day(spark, sf), "sku_code", QTY)
    return checks.completeness(monthly, "sku_code", "month", 12)


@query("v06_set_rules", """
    with sold as (select distinct category_name, date from cat_day where gross_sales_qty > 0), back as (select distinct category_name, date from cat_day where return_qty > 0),
    cats as (select distinct category_name as c from cat_day),
    one(tab, check_name, violations) as (
      select 'returns', 'returned_days_sold', (select count(*) from (select * from back except select * from sold))
      union all select 'returns', 'same_days', (select count(*) from (select * from back except select * from sold)) + (select count(*) from (select * from sold except select * from back))
      union all select 'pairs', 'all_pairs', (select count(*) * (count(*) - 1) // 2 from cats) - (select count(*) from cat_spearman where period = 'all')
      union all select 'shares', 'twelve_months', (select count(*) from (select category_name, month from (select distinct category_name from cat_day), (select unnest(range(1, 13)) as month)
          except select category_name, month from cat_month)))
    select tab as "table", check_name as "check", violations::bigint as violations, violations = 0 as passed from one""")
def v06_sets(spark, sf):
    """Set rules: membership, equality both ways, all pairs, a full grid of months."""
    daily = tables.category_day(spark, sf)
    names = daily.select("category_name").distinct()
    ready = {"returns": daily.where("return_qty > 0"), "sales": daily.where(F.col(QTY) > 0), "categories": names,
             "pairs": whole_ranks(detrended(spark, sf, "category_name"), "category_name"),
             "shares": profile.monthly_profile(daily, "category_name", QTY), "grid": names.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))}
    days = ("category_name", "date")
    return rules.compiled(ready, {
        "returns": [rules.Keys("returned_days_sold", days, "sales"), rules.Keys("same_days", days, "sales", both=True)],
        "pairs": [rules.Pairs("all_pairs", (), "categories", "category_name")],
        "shares": [rules.Keys("twelve_months", ("category_name", "month"), "grid", both=True)]})


@query("v07_monotone", """
    select category_name, count_if(step < -1e-9) as wrong_steps, count(*) as variants, count_if(step < -1e-9) = 0 as passed
    from (select category_name, q - lag(q) over (partition by category_name order by y) as step
          from (select category_name, year(date) as y, sum(gross_sales_qty) as q from cat_day group by 1, 2)) group by 1""")
def v07(spark, sf):
    yearly = tables.category_day(spark, sf).groupBy("category_name", F.year("date").alias("y")).agg(F.sum(QTY).alias("q"))
    return checks.monotone(yearly, "y", "q", ["category_name"])


@query("p12_string_helpers", """
    select category_name, string_agg(item, ';' order by item) as items, string_agg(item || ':' || n, ';' order by item) as composition
    from (select category_name, item_name as item, count(*) as n from sku_day group by 1, 2) group by 1""")
def p12(spark, sf):
    counts = tables.sku_day(spark, sf).groupBy("category_name", "item_name").agg(F.count(F.lit(1)).alias("n"))
    names = F.array_sort(F.collect_list(F.struct("item_name", "n")))
    packed = counts.groupBy("category_name").agg(names.alias("a"))
    return packed.select("category_name", F.array_join(F.transform("a", lambda x: x["item_name"]), ";").alias("items"),
                         F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["item_name"], x["n"])), ";").alias("composition"))


part("active", "select sku_code from sku_day group by 1 having sum(gross_sales_qty) >= 500")


@query("j05_semi_join", f"select sku_code, cast(date as varchar) as date, {fx('gross_sales_qty')} as gross_sales_qty from sku_day where sku_code in (select sku_code from active)")
def j05(spark, sf):
    daily = tables.sku_mart(spark, sf)
    keep = profile.activity(daily, "sku_code", QTY, 0, 0, 500.0).where("included").select("sku_code")
    return daily.join(keep, "sku_code", "left_semi").select("sku_code", day(), *fixed_cols(QTY))


@query("j06_lookup_join", "select sku_code, cast(date as varchar) as date, p_name, p_size from sku_day left join part on cast(p_partkey as varchar) = sku_code")
def j06(spark, sf):
    lookup = tables.read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("sku_code"), "p_name", "p_size")
    return tables.sku_day(spark, sf).join(lookup, "sku_code", "left").select("sku_code", day(), "p_name", "p_size")


part("sku_totals", "select sku_code, any_value(category_name) as category_name, sum(gross_sales_qty) as qty, sum(gross_revenue) as revenue from sku_day group by 1")


@query("t01_multi_key_sort", f"select sku_code, category_name, {fx_cols('qty', 'revenue', digits=4)} from sku_totals order by category_name, qty desc, sku_code")
def t01(spark, sf):
    return tables.sku_totals(spark, sf).orderBy("category_name", F.desc("qty"), "sku_code").select(
        "sku_code", "category_name", *fixed_cols("qty", "revenue", digits=4))


@query("t02_top_n", f"""
    select sku_code, {fx('qty', 4)} as qty, {fx('revenue', 4)} as revenue from sku_totals order by qty desc, floor(revenue * 1e4 + 0.5) desc, sku_code limit 33""")
def t02(spark, sf):
    best = tables.sku_totals(spark, sf).orderBy(F.desc("qty"), F.desc(fixed("revenue", 4)), "sku_code").limit(33)
    return best.select("sku_code", *fixed_cols("qty", "revenue", digits=4))


@query("t05_union", """
    select 'category' as level, category_name as entity, count(*) as days from cat_day group by 2
    union all select 'item', item_name, count(*) from item_day group by 2""")
def t05(spark, sf):
    one = lambda df, level, c: df.groupBy(F.col(c).alias("entity")).agg(F.count(F.lit(1)).alias("days")).withColumn("level", F.lit(level))
    return one(tables.category_day(spark, sf), "category", "category_name").unionByName(one(tables.item_day(spark, sf), "item", "item_name"))


@query("t07_set_jaccard", f"""
    select c.category_name, count(a.sku) as both, count(*) as either, {fx('count(a.sku) / cast(count(*) as double)')} as jaccard
    from (select distinct category_name, sku_code from sku_day where gross_sales_qty > 0 or return_qty > 0) c
    left join (select sku_code as sku from sku_day where gross_sales_qty > 0 intersect select sku_code from sku_day where return_qty > 0) a on a.sku = c.sku_code group by 1""")
def t07(spark, sf):
    daily = tables.sku_mart(spark, sf)
    out = network.set_overlap(daily.where(F.col(QTY) > 0), daily.where("return_qty > 0"), ["sku_code"], ["category_name"])
    return out.select("category_name", "both", "either", *fixed_cols("jaccard"))


@query("t08_distinct_attributes", "select distinct sku_code, sku_name, category_name, item_name from sku_day")
def t08(spark, sf):
    return tables.sku_day(spark, sf).select("sku_code", "sku_name", "category_name", "item_name").dropDuplicates()
