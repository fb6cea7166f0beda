"""Queries of distribution fits and seasonal clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from greengrain.functions.exprs import fixed
from greengrain.functions.staging import stage
from greengrain.operators import calendar, clusters, distributions, kmeans, profile
from greengrain.plans.profiling import FEATURES, QTY, fixed_cols, fx_cols
from greengrain.plans.registry import fx, part, query
from greengrain.sources import tables

FIT = ["parameter_1", "parameter_2", "log_likelihood", "aic"]


def candidates(spark, sf):
    return distributions.candidate_fits(tables.product_day(spark, sf), "sku_code", QTY)


part("positive", "select sku_code, count(*) as n, avg(gross_sales_qty) as m, stddev_pop(gross_sales_qty) as s, avg(ln(gross_sales_qty)) as lm, stddev_pop(ln(gross_sales_qty)) as ls from product_day where gross_sales_qty > 0 group by 1 having count(*) >= 30")


@query("d01_normal_lognormal", f"""
    select sku_code, distribution, cast(n as integer) as n_positive, {fx_cols(*FIT, digits=4)} from (
      select *, 4 - 2 * log_likelihood as aic from (
        select sku_code, 'Normal' as distribution, n, m as parameter_1, s as parameter_2, -n / 2.0 * (ln(2 * pi() * s * s) + 1) as log_likelihood from positive
        union all select sku_code, 'Lognormal', n, ls, exp(lm), -n / 2.0 * (ln(2 * pi() * ls * ls) + 1) - n * lm from positive))""")
def d01(spark, sf):
    return candidates(spark, sf).where(F.col("distribution").isin("Normal", "Lognormal")).select(
        "sku_code", "distribution", "n_positive", *fixed_cols(*FIT, digits=4))


@query("d02_gamma_weibull")
def d02(spark, sf):
    return candidates(spark, sf).where(F.col("distribution").isin("Gamma", "Weibull")).select(
        "sku_code", "distribution", "n_positive", *fixed_cols(*FIT))


@query("d03_ks_distance")
def d03(spark, sf):
    return candidates(spark, sf).select("sku_code", "distribution", *fixed_cols("ks_statistic", "ks_p_value"))


@query("d04_best_fit")
def d04(spark, sf):
    daily = tables.product_day(spark, sf)
    summary = profile.zero_inflation(calendar.dense_calendar(daily, "sku_code", [QTY]), "sku_code", QTY)
    out = distributions.best_fit(distributions.candidate_fits(daily, "sku_code", QTY), summary, "sku_code")
    return out.select("sku_code", "n_days", *fixed_cols("zero_share", "best_aic", "delta_aic_second", "best_ks_p"),
                      "best_distribution", "fit_conclusion")


PROTO = ", ".join(f"('{n}', {i}, {m})" for i, (n, m) in enumerate(clusters.PROTOTYPES.items()))
part("labels_c", f"""
    select sku_code, label from (select *, row_number() over (partition by sku_code order by cost, place) as rn from (
      select p.sku_code, v.label, v.place, floor(sum(pow(p.x - (case when list_contains(v.months, p.month) then 1.0 / len(v.months) else 0 end), 2)) * 1e9 + 0.5) as cost
      from (select sku_code, month, coalesce(sales_proportion / nullif(sum(sales_proportion) over (partition by sku_code), 0), 1.0 / 12) as x from product_month) p,
        (values {PROTO}) v(label, place, months) group by 1, 2, 3)) where rn = 1""")


def monthly(spark, sf):
    return stage(profile.monthly_profile(tables.product_day(spark, sf), "sku_code", QTY), "monthly")


@query("c06_seasonal_label", "select sku_code, label from labels_c")
def c06(spark, sf):
    return clusters.seasonal_label(monthly(spark, sf), "sku_code")


# Numbers of clusters, starts per fit and replicates of the year bootstrap.
CLUSTER_SIZES, STARTS, YEAR_DRAWS, CLUSTERS = list(range(2, 9)), 100, 100, 5


def numbered(spark, sizes):
    """(grp, k) of groups 0.. with the given numbers of clusters."""
    return spark.createDataFrame(list(enumerate(sizes)), "grp int, k int")


def fitted(features, sizes, starts=STARTS):
    """Blocks and final state of k-means for every (grp, k)."""
    blocks = kmeans.blocks_of(features, "sku_code", FEATURES, sizes)
    return blocks, kmeans.fit(blocks, starts)


@query("c02_kmeans_by_size")
def c02(spark, sf):
    features = stage(profile.cluster_features(monthly(spark, sf), "sku_code"), "features")
    groups = numbered(spark, CLUSTER_SIZES)
    each = features.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(len(CLUSTER_SIZES) - 1))))
    _, state = fitted(each, groups)
    return kmeans.best_start(state, STARTS).select("k", *fixed_cols("cost"))


part("labels_s", f"""
    select sku_code, case when month between 3 and 5 then 'spring' when month between 6 and 8 then 'summer' when month between 9 and 11 then 'autumn' else 'winter' end as label
    from (select *, row_number() over (partition by sku_code order by floor(seasonal_index * 1e9 + 0.5) desc, month) as rn from product_month) where rn = 1""")


def peak_labels(m):
    return profile.peaks(m, "sku_code").select("sku_code", F.col("peak_season").alias("label"))


part("long_f", "select sku_code, label, f.name, f.value from (unpivot product_features on " + ", ".join(FEATURES) + " into name name value value) f join labels_s using (sku_code)")
part("center_c", "select label, name, avg(value) as c from long_f group by 1, 2")
part("size_c", "select label, count(*) as n from labels_s group by 1")
part("within_c", "select sku_code, label, sum(pow(value - c, 2)) as d2 from long_f join center_c using (label, name) group by 1, 2")


@query("c03_cluster_quality", f"""
    select (select count(*) from size_c) as clusters, (select min(n) from size_c) as smallest,
      {fx('(select avg(case when a is null then 0 else (b - a) / greatest(a, b) end) from (select sku_code, max(case when own = other then d end) as a, min(case when own <> other then d end) as b from (select x.sku_code, x.label as own, y.label as other, avg(x.d) as d from (select a.sku_code, a.label, b.sku_code as o, b.label as ol, sqrt(sum(pow(a.value - b.value, 2))) as d from long_f a join long_f b on a.name = b.name and a.sku_code <> b.sku_code group by 1, 2, 3, 4) x join labels_s y on y.sku_code = x.o group by 1, 2, 3) group by 1))', 5)} as silhouette,
      {fx('((select sum(n * pow(c - g, 2)) from center_c join size_c using (label) join (select name, avg(value) as g from long_f group by 1) using (name)) / ((select count(*) from size_c) - 1)) / ((select sum(d2) from within_c) / ((select sum(n) from size_c) - (select count(*) from size_c)))', 4)} as calinski_harabasz,
      {fx('(select avg(r) from (select l, max(r) as r from (select a.label as l, b.label as m, (any_value(sa.s) + any_value(sb.s)) / sqrt(sum(pow(a.c - b.c, 2))) as r from center_c a join center_c b on a.name = b.name and a.label <> b.label join (select label, avg(sqrt(d2)) as s from within_c group by 1) sa on sa.label = a.label join (select label, avg(sqrt(d2)) as s from within_c group by 1) sb on sb.label = b.label group by 1, 2) group by 1))', 5)} as davies_bouldin""")
def c03(spark, sf):
    m = monthly(spark, sf)
    out = clusters.quality(profile.cluster_features(m, "sku_code"), peak_labels(m), "sku_code", FEATURES, "label")
    return out.select("clusters", "smallest", *fixed_cols("silhouette", digits=5), *fixed_cols("calinski_harabasz", digits=4), *fixed_cols("davies_bouldin", digits=5))


@query("c04_rand_index", f"""
    with t as (select l.label as a, case when p.month between 3 and 5 then 'spring' when p.month between 6 and 8 then 'summer' when p.month between 9 and 11 then 'autumn' else 'winter' end as b
               from labels_c l join (select sku_code, month from (select *, row_number() over (partition by sku_code order by floor(seasonal_index * 1e9 + 0.5) desc, month) as rn from product_month) where rn = 1) p on p.sku_code = l.sku_code),
    c as (select a, b, count(*) as n from t group by 1, 2),
    s as (select (select sum(n * (n - 1) / 2.0) from c) as both_, (select sum(n * (n - 1) / 2.0) from (select sum(n) as n from c group by a)) as l,
            (select sum(n * (n - 1) / 2.0) from (select sum(n) as n from c group by b)) as r, (select sum(n) from c) as total)
    select {fx('(both_ - l * r / (total * (total - 1) / 2.0)) / ((l + r) / 2 - l * r / (total * (total - 1) / 2.0))', 5)} as ari from s""")
def c04(spark, sf):
    m = monthly(spark, sf)
    return clusters.rand_index(clusters.seasonal_label(m, "sku_code"), profile.peaks(m, "sku_code"), "sku_code", "label", "peak_season").select(
        fixed("ari", 5).alias("ari"))


@query("c04_year_bootstrap")
def c04_boot(spark, sf):
    """Replicates 0.. of the year bootstrap against the labels of all years, all in the same jobs."""
    daily = tables.product_day(spark, sf)
    totals = stage(profile.month_totals(daily, "sku_code", QTY), "month_totals")
    base = profile.cluster_features(monthly(spark, sf), "sku_code").withColumn("grp", F.lit(YEAR_DRAWS))
    again = profile.cluster_features(clusters.year_samples(totals, "sku_code", YEAR_DRAWS), "sku_code", ["grp"])
    blocks, state = fitted(stage(again.unionByName(base), "features"), numbered(spark, [CLUSTERS] * (YEAR_DRAWS + 1)))
    found = stage(kmeans.labels(blocks, kmeans.best_start(state, STARTS), "sku_code"), "labels")
    whole = F.col("grp") == YEAR_DRAWS
    rows = clusters.rand_index(found.where(whole), found.where(~whole), "sku_code", "cluster_id", "cluster_id", ["grp"])
    return rows.select(F.col("grp").alias("rep"), *fixed_cols("ari"))


@query("c05_balanced_clusters")
def c05(spark, sf):
    features = profile.cluster_features(monthly(spark, sf), "sku_code").withColumn("grp", F.lit(0))
    blocks, state = fitted(stage(features, "features"), numbered(spark, [CLUSTERS]))
    best = kmeans.best_start(state, STARTS, min_size=5)
    return kmeans.labels(blocks, best, "sku_code").join(best.select("grp", "smallest"), "grp").select(
        "sku_code", "cluster_id", F.col("smallest").alias("smallest_cluster"))


SHARES = [f"{s}_share" for s in ("spring", "summer", "autumn", "winter")] + [f"share_month_{m}" for m in range(1, 13)]
part("profile_c", "select label, " + ", ".join(
    [f"sum(case when month in {m} then sales_proportion end) / count(distinct sku_code) as {s}_share" for s, m in
     (("spring", (3, 4, 5)), ("summer", (6, 7, 8)), ("autumn", (9, 10, 11)), ("winter", (12, 1, 2)))]
    + [f"avg(case when month = {m} then sales_proportion end) as share_month_{m}" for m in range(1, 13)])
    + " from product_month join labels_s using (sku_code) group by 1")


@query("c07_cluster_profiles", f"""
    select p.label, m.members, m.first_names, {fx_cols(*SHARES)} from profile_c p
    join (select label, count(*) as members, array_to_string(list_sort(list(sku_code))[1:5], ';') as first_names from labels_s group by 1) m on m.label = p.label""")
def c07(spark, sf):
    m = monthly(spark, sf)
    labels = stage(peak_labels(m), "labels")
    return clusters.cluster_profiles(m, labels, "sku_code", "label").select("label", "members", "first_names", *fixed_cols(*SHARES))
