"""Relationship tables of four levels: categories, products inside a category, cluster sums, products inside a cluster."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from greengrain.functions.exprs import fixed, ratio
from greengrain.functions.staging import stage
from greengrain.operators import calendar, pairs, profile
from greengrain.plans.fitting import monthly as product_monthly
from greengrain.plans.fitting import peak_labels
from greengrain.plans.profiling import QTY, SEASON_SQL, fixed_cols, fx_cols
from greengrain.plans.registry import part, query
from greengrain.plans.relationships import STRENGTH_SQL, dense, with_whole_interval
from greengrain.sources import tables

GROUP = ["group_name"]
KEYS = ["group_name", "source", "target", "period"]


def relation_table(daily, index, level):
    """The four indicators of all pairs inside each group, in long form.

    `daily` is (group_name, entity, date, qty), NULL where an entity is not observed; `index` is (group_name, entity, month,
    seasonal_index). q values are taken over one level, group and period; intervals are drawn for pairs that are strong
    over the whole range.
    """
    month = Window.partitionBy("group_name", "entity", F.trunc("date", "month"))
    logged = F.when(F.col("qty").isNotNull(), F.log1p(F.greatest("qty", F.lit(0.0))))
    total = daily.groupBy("group_name", "date").agg(F.sum("qty").alias("_total"))
    frames = {"sales": daily.withColumn("x", fixed(logged - F.avg(logged).over(month), 9)),
              "share": daily.join(total, ["group_name", "date"]).withColumn("x", ratio("qty", "_total"))}
    blocks = []
    for name, frame in frames.items():
        series = pairs.packed(pairs.by_period(frame), ["group_name", "entity", "period"], "x")
        scored = stage(with_whole_interval(series, "entity", GROUP, p_values=True, block=16), "scored")
        scored = pairs.fdr(scored, ["group_name", "period"])
        blocks.append(scored.select(*KEYS, F.lit(name).alias("indicator"), F.col("r").alias("value"), "ci_lower", "ci_upper",
                                    "p_value", "q_value", pairs.strength("r", "ci_lower", "ci_upper").alias("strength")))
    empty = F.lit(None).cast("double")
    plain = lambda df, name, value: df.select(
        *KEYS[:3], F.lit(pairs.WHOLE).alias("period"), F.lit(name).alias("indicator"), F.col(value).alias("value"),
        *(empty.alias(c) for c in ("ci_lower", "ci_upper", "p_value", "q_value")), F.lit(None).cast("string").alias("strength"))
    blocks.append(plain(pairs.index_correlation(index, "entity", within=GROUP), "seasonal_index", "r"))
    packed = pairs.packed(daily, ["group_name", "entity"], "qty")
    blocks.append(plain(pairs.active_overlap(packed, "entity", GROUP), "active_days", "jaccard"))
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out.select(F.lit(level).alias("level"), "*")


def category_level(spark, sf):
    daily = stage(dense(spark, sf, "category_name"), "category_dense")
    index = profile.monthly_profile(daily, "category_name", QTY)
    group = F.lit("").alias("group_name")
    return (daily.select(group, F.col("category_name").alias("entity"), "date", F.col(QTY).alias("qty")),
            index.select(group, F.col("category_name").alias("entity"), "month", "seasonal_index"))


def grouped_products(spark, sf, groups, month):
    """Products with their group; the days outside a product's own span are unobserved."""
    span = calendar.span_calendar(tables.product_day(spark, sf), "sku_code", QTY)
    daily = stage(span.join(groups, "sku_code").select("group_name", F.col("sku_code").alias("entity"), "date", F.col(QTY).alias("qty")), "grouped")
    index = month.join(groups, "sku_code").select("group_name", F.col("sku_code").alias("entity"), "month", "seasonal_index")
    return daily, index


def product_categories(spark, sf):
    return tables.product_day(spark, sf).select("sku_code", F.col("category_name").alias("group_name")).distinct()


def product_clusters(month):
    """Products by their peak season, the cluster label that SQL can say too."""
    return stage(peak_labels(month).withColumnRenamed("label", "group_name"), "product_clusters")


def cluster_level(daily, index):
    """Sums of a cluster's members per day, unobserved days as 0, and the mean of their seasonal indices."""
    sums = daily.groupBy(F.lit("").alias("group_name"), F.col("group_name").alias("entity"), "date").agg(
        F.coalesce(F.sum("qty"), F.lit(0.0)).alias("qty"))
    means = index.groupBy(F.lit("").alias("group_name"), F.col("group_name").alias("entity"), "month").agg(
        F.avg("seasonal_index").alias("seasonal_index"))
    return stage(sums, "cluster_sums"), means


def levels(spark, sf, only=None):
    """(level, daily, index) of the wanted levels."""
    wanted = only or ["category", "within_category", "cluster", "within_cluster"]
    if "category" in wanted:
        yield "category", *category_level(spark, sf)
    if wanted == ["category"]:
        return
    month = product_monthly(spark, sf)
    if "within_category" in wanted:
        yield "within_category", *grouped_products(spark, sf, product_categories(spark, sf), month)
    if "cluster" in wanted or "within_cluster" in wanted:
        daily, index = grouped_products(spark, sf, product_clusters(month), month)
        if "cluster" in wanted:
            yield "cluster", *cluster_level(daily, index)
        if "within_cluster" in wanted:
            yield "within_cluster", daily, index


SHOWN = ["level", *KEYS, "indicator", "strength"]


def shown(spark, sf, level, *numbers):
    (made,) = levels(spark, sf, [level])
    return relation_table(*made[1:], level).select(*SHOWN, *fixed_cols(*numbers))


@query("r06_relationship_table")
def r06(spark, sf):
    """All levels with Student p and q values, which SQL cannot say."""
    out = None
    for level, daily, index in levels(spark, sf):
        one = relation_table(daily, index, level)
        out = one if out is None else out.unionByName(one)
    return out.select(*SHOWN, *fixed_cols("value", "ci_lower", "ci_upper", "p_value", "q_value"))


# (name, level, daily rows, seasonal index rows); the daily rows are g, e, date, qty
part("lv_a_day", "select '' as g, category_name as e, date, qty from cat_dense")
part("lv_a_month", "select '' as g, category_name as e, month, seasonal_index from cat_month")
part("lv_b_day", "select split_part(sku_code, '/', 1) as g, sku_code as e, date, qty from product_span")
part("lv_b_month", "select split_part(sku_code, '/', 1) as g, sku_code as e, month, seasonal_index from product_month")
part("lv_d_day", "select label as g, sku_code as e, date, qty from product_span join labels_s using (sku_code)")
part("lv_d_month", "select label as g, sku_code as e, month, seasonal_index from product_month join labels_s using (sku_code)")
part("lv_c_day", "select '' as g, g as e, date, coalesce(sum(qty), 0.0) as qty from lv_d_day group by g, date")
part("lv_c_month", "select '' as g, g as e, month, avg(seasonal_index) as seasonal_index from lv_d_month group by g, month")

PERIODS_SQL = f"""join (values ('all'), ('spring'), ('summer'), ('autumn'), ('winter')) p(period)
          on p.period = 'all' or p.period = {SEASON_SQL.replace('month', 'month(d.date)')}"""


def level_sql(name: str, level: str) -> str:
    """Parts and the query text of one level."""
    day, month = f"lv_{name}_day", f"lv_{name}_month"
    part(f"lv_{name}_sales", f"""
        select g, e, date, p.period, floor((x - m) * 1e9 + 0.5) / 1e9 as x
        from (select g, e, date, ln(1 + qty) as x, avg(ln(1 + qty)) over (partition by g, e, date_trunc('month', date)) as m
              from {day}) d {PERIODS_SQL}""")
    part(f"lv_{name}_share", f"""
        select g, e, date, p.period, x from (select *, qty / nullif(sum(qty) over (partition by g, date), 0) as x from {day}) d {PERIODS_SQL}""")
    rank = ("rank() over (partition by g, source, target, period order by {0}) + "
            "(count(*) over (partition by g, source, target, period, {0}) - 1) / 2.0")
    ranked = """
            rank() over (partition by g, source, target, rep order by {0}) + (count(*) over (partition by g, source, target, rep, {0}) - 1) / 2.0"""
    for kind in ("sales", "share"):
        source, found = f"lv_{name}_{kind}", f"lv_{name}_{kind}_r"
        part(found, f"""
            select g, source, target, period, count(*) as n_days, coalesce(nullif(corr(rx, ry), 'nan'::double), 0) as r
            from (select g, source, target, period, {rank.format('x')} as rx, {rank.format('y')} as ry
                  from (select a.g, a.e as source, b.e as target, a.period, a.x, b.x as y from {source} a
                        join {source} b on a.g = b.g and a.date = b.date and a.period = b.period and a.e < b.e
                        where a.x is not null and b.x is not null))
            group by g, source, target, period having count(*) >= 30""")
        part(f"lv_{name}_{kind}_ci", f"""
            with use as (select g, source, target from {found} where period = 'all' and abs(r) >= 0.30),
            series as (select u.g, u.source, u.target, a.x, b.x as y,
                    row_number() over (partition by u.g, u.source, u.target order by a.date) - 1 as i, count(*) over (partition by u.g, u.source, u.target) as n
                from use u join {source} a on a.g = u.g and a.e = u.source and a.period = 'all'
                join {source} b on b.g = u.g and b.e = u.target and b.period = 'all' and b.date = a.date where a.x is not null and b.x is not null),
            shape as (select distinct n, cast(ceil(n / 7.0) as bigint) as blocks from series),
            picked as (select n, rep, blk * 7 + o as pos, s + o as i from
                (select rep, blk, n, ('0x' || substr(md5('20230907:' || rep || ':' || blk), 1, 8))::bigint % (n - 6) as s
                 from (select unnest(range(0, 200)) as rep), (select unnest(range(0, blocks)) as blk, n from shape)),
                (select unnest(range(0, 7)) as o) where blk * 7 + o < n),
            drawn as (select g, source, target, rep, x, y from picked join series using (n, i)),
            ranked as (select g, source, target, rep, {ranked.format('x')} as rx, {ranked.format('y')} as ry from drawn),
            reps as (select g, source, target, rep, coalesce(nullif(corr(rx, ry), 'nan'::double), 0) as r from ranked group by 1, 2, 3, 4)
            select g, source, target, 'all' as period, quantile_cont(r, 0.025) as ci_lower, quantile_cont(r, 0.975) as ci_upper
            from reps group by 1, 2, 3""")
    unit = f"""select g, e, month, coalesce((seasonal_index - avg(seasonal_index) over (partition by g, e))
        / nullif(stddev_pop(seasonal_index) over (partition by g, e), 0), 0) as z from {month}"""
    part(f"lv_{name}_all", " union all ".join(
        f"""select g, source, target, period, '{kind}' as indicator, r as value, ci_lower, ci_upper, {STRENGTH_SQL} as strength
            from lv_{name}_{kind}_r left join lv_{name}_{kind}_ci using (g, source, target, period)""" for kind in ("sales", "share")) + f"""
        union all select a.g, a.e, b.e, 'all', 'seasonal_index', sum(a.z * b.z) / 12, null, null, null
            from ({unit}) a join ({unit}) b on a.g = b.g and a.month = b.month and a.e < b.e group by 1, 2, 3
        union all select a.g, a.e, b.e, 'all', 'active_days',
            coalesce(count_if(a.qty > 0 and b.qty > 0 and a.qty is not null and b.qty is not null)
              / cast(nullif(count_if((a.qty > 0 or b.qty > 0) and a.qty is not null and b.qty is not null), 0) as double), 0), null, null, null
            from {day} a join {day} b on a.g = b.g and a.date = b.date and a.e < b.e group by 1, 2, 3""")
    return f"""select '{level}' as level, g as group_name, source, target, period, indicator, strength, {fx_cols('value', 'ci_lower', 'ci_upper')}
        from lv_{name}_all"""


@query("r06_categories", level_sql("a", "category"))
def r06_a(spark, sf):
    return shown(spark, sf, "category", "value", "ci_lower", "ci_upper")


@query("r06_within_category", level_sql("b", "within_category"))
def r06_b(spark, sf):
    return shown(spark, sf, "within_category", "value", "ci_lower", "ci_upper")


@query("r06_cluster_sums", level_sql("c", "cluster"))
def r06_c(spark, sf):
    return shown(spark, sf, "cluster", "value", "ci_lower", "ci_upper")


@query("r06_within_cluster", level_sql("d", "within_cluster"))
def r06_d(spark, sf):
    return shown(spark, sf, "within_cluster", "value", "ci_lower", "ci_upper")
