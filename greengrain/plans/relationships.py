"""Queries over entity pairs and the networks built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from greengrain.functions.exprs import correlation_p, fixed, log_qty
from greengrain.functions.staging import stage
from greengrain.operators import calendar, network, pairs, profile
from greengrain.plans.profiling import QTY, SEASON_SQL, day, fixed_cols, fx_cols
from greengrain.plans.registry import fx, part, query
from greengrain.sources import tables


def dense(spark, sf, level):
    source = {"category_name": tables.category_day, "item_name": tables.item_day,
              "sku_code": tables.product_day}[level]
    return calendar.dense_calendar(source(spark, sf), level, [QTY])


def detrended(spark, sf, level):
    """Detrended values to nine digits: equal days must tie however their month mean was added up."""
    return dense(spark, sf, level).withColumn("x", fixed(calendar.month_demeaned_log(QTY, level), 9))


def shares(spark, sf, level):
    return calendar.daily_share(dense(spark, sf, level), QTY).withColumn("x", F.col("share"))


def period_ranks(df, entity, value="x", **how):
    """Rank correlations of all pairs in the whole range and in each season."""
    series = pairs.packed(pairs.by_period(df), [entity, "period"], value)
    return pairs.rank_correlation(series, entity, ["period"], **how)


def whole_ranks(df, entity, value="x", **how):
    return pairs.rank_correlation(pairs.packed(df, [entity], value), entity, **how)


def pair_scores(found):
    return found.select("source", "target", "period", "n_days", *fixed_cols("r"))


for level, short in (("category_name", "cat"), ("item_name", "item")):
    part(f"{short}_detr_p", f"""
        select {level} as e, date, p.period, floor((ln(1 + qty) - avg(ln(1 + qty)) over
            (partition by {level}, p.period, date_trunc('month', date))) * 1e9 + 0.5) / 1e9 as x
        from {short}_dense d join (values ('all'), ('spring'), ('summer'), ('autumn'), ('winter')) p(period)
          on p.period = 'all' or p.period = {SEASON_SQL.replace('month', 'month(d.date)')}""")
    part(f"{short}_share_p", f"""
        select {level} as e, date, p.period, qty / nullif(sum(qty) over (partition by date, p.period), 0) as x
        from {short}_dense d join (values ('all'), ('spring'), ('summer'), ('autumn'), ('winter')) p(period)
          on p.period = 'all' or p.period = {SEASON_SQL.replace('month', 'month(d.date)')}""")


def spearman_sql(source: str) -> str:
    rank = ("rank() over (partition by source, target, period order by {0}) + "
            "(count(*) over (partition by source, target, period, {0}) - 1) / 2.0")
    return f"""
    select source, target, period, count(*) as n_days, coalesce(corr(rx, ry), 0) as r
    from (select source, target, period, {rank.format('x')} as rx, {rank.format('y')} as ry
          from (select a.e as source, b.e as target, a.period, a.x, b.x as y from {source} a
                join {source} b on a.date = b.date and a.period = b.period and a.e < b.e
                where a.x is not null and b.x is not null))
    group by source, target, period having count(*) >= 30"""


part("item_spearman", spearman_sql("item_detr_p"))
part("cat_spearman", spearman_sql("cat_detr_p"))
part("item_share_spearman", spearman_sql("item_share_p"))


def sql_p(r: str, n: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs(0.5 * ln((1 + {r}) / (1 - {r})) * sqrt({n} - 3)) / sqrt(2)))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    return f"({poly}) * exp(-pow(0.5 * ln((1 + {r}) / (1 - {r})) * sqrt({n} - 3), 2) / 2)"


@query("j04_same_day_pairs", f"""
    select a.category_name as source, b.category_name as target, cast(a.date as varchar) as date,
      {fx('a.gross_sales_qty')} as x, {fx('b.gross_sales_qty')} as y
    from cat_day a join cat_day b on a.date = b.date and a.category_name < b.category_name""")
def j04(spark, sf):
    return (pairs.same_day_pairs(tables.category_day(spark, sf), "category_name", QTY)
            .select("source", "target", day(), *fixed_cols("x", "y")))


PRODUCT_UNIT = """
    select sku_code, month, coalesce((seasonal_index - avg(seasonal_index) over (partition by sku_code))
      / nullif(stddev_pop(seasonal_index) over (partition by sku_code), 0), 0) as z from product_month"""
part("product_index_pairs", f"""
    select a.sku_code as source, b.sku_code as target, sum(a.z * b.z) / 12 as r
    from ({PRODUCT_UNIT}) a join ({PRODUCT_UNIT}) b on a.month = b.month and a.sku_code < b.sku_code group by 1, 2""")


def product_index_pairs(spark, sf):
    monthly = profile.monthly_profile(tables.product_day(spark, sf), "sku_code", QTY)
    return pairs.index_correlation(monthly, "sku_code")


@query("r01_index_correlation", f"select source, target, {fx('r')} as r from product_index_pairs")
def r01(spark, sf):
    return product_index_pairs(spark, sf).select("source", "target", *fixed_cols("r"))


@query("r02_detrended_spearman", f"select source, target, period, n_days, {fx('r')} as r from item_spearman")
def r02(spark, sf):
    return pair_scores(period_ranks(detrended(spark, sf, "item_name"), "item_name"))


@query("r02_student_p")
def r02_p(spark, sf):
    found = period_ranks(detrended(spark, sf, "item_name"), "item_name", p_values=True)
    return found.select("source", "target", "period", fixed("p_value").alias("p_value"))


@query("r03_share_spearman", f"select source, target, period, n_days, {fx('r')} as r from item_share_spearman")
def r03(spark, sf):
    return pair_scores(period_ranks(shares(spark, sf, "item_name"), "item_name"))


part("product_overlap", """
    select a.sku_code as source, b.sku_code as target, count_if(a.qty > 0 and b.qty > 0) as both_days,
      count_if(a.qty > 0 or b.qty > 0) as either_days,
      coalesce(count_if(a.qty > 0 and b.qty > 0) / cast(nullif(count_if(a.qty > 0 or b.qty > 0), 0) as double), 0) as jaccard
    from product_span a join product_span b on a.date = b.date and a.sku_code < b.sku_code
    where a.qty is not null and b.qty is not null group by 1, 2""")


def product_overlap(spark, sf):
    span = calendar.span_calendar(tables.product_day(spark, sf), "sku_code", QTY)
    return pairs.active_overlap(pairs.packed(span, ["sku_code"], QTY), "sku_code")


@query("r04_active_overlap", f"""
    select source, target, both_days, either_days, {fx('jaccard')} as jaccard from product_overlap""")
def r04(spark, sf):
    return product_overlap(spark, sf).select("source", "target", "both_days", "either_days", *fixed_cols("jaccard"))


def boot_sql(source: str, found: str, gate: float) -> str:
    """Bootstrap intervals over the whole range of the pairs in `found` with |r| >= gate, and the share of draws with the sign of r."""
    return f"""
    with use as (select source, target, r as whole from {found} where period = 'all' and abs(r) >= {gate}),
    series as (select u.source, u.target, a.x, b.x as y,
                      row_number() over (partition by u.source, u.target order by a.date) - 1 as i, count(*) over (partition by u.source, u.target) as n
                    from use u join {source} a on a.e = u.source and a.period = 'all' join {source} b on b.e = u.target and b.period = 'all' and b.date = a.date
                    where a.x is not null and b.x is not null),
    shape as (select distinct n, cast(ceil(n / 7.0) as bigint) as blocks from series),
    picked as (select n, rep, blk * 7 + o as pos, s + o as i from
                 (select rep, blk, n, ('0x' || substr(md5('20230907:' || rep || ':' || blk), 1, 8))::bigint % (n - 6) as s
                  from (select unnest(range(0, 200)) as rep), (select unnest(range(0, blocks)) as blk, n from shape))
                 , (select unnest(range(0, 7)) as o) where blk * 7 + o < n),
    drawn as (select source, target, rep, x, y from picked join series using (n, i)),
    ranked as (select source, target, rep,
        rank() over (partition by source, target, rep order by x) + (count(*) over (partition by source, target, rep, x) - 1) / 2.0 as rx,
        rank() over (partition by source, target, rep order by y) + (count(*) over (partition by source, target, rep, y) - 1) / 2.0 as ry
        from drawn),
    reps as (select source, target, rep, coalesce(corr(rx, ry), 0) as r from ranked group by 1, 2, 3)
    select source, target, quantile_cont(r, 0.025) as ci_lower, quantile_cont(r, 0.975) as ci_upper,
      avg(case when sign(r) = sign(whole) then 1.0 else 0.0 end) as same_sign from reps join use using (source, target) group by 1, 2"""


STRENGTH_SQL = """case when abs(r) >= 0.30 and coalesce(ci_lower > 0 or ci_upper < 0, false) then 'clear'
        when abs(r) >= 0.15 and abs(r) < 0.30 then 'weak' else 'retained' end"""
part("cat_boot", boot_sql("cat_detr_p", "cat_spearman", 0))
part("item_boot", boot_sql("item_detr_p", "item_spearman", 0.30))


@query("r05_block_bootstrap", f"""
    select b.source, b.target, {fx('s.r')} as r, {fx_cols('ci_lower', 'ci_upper')}
    from cat_boot b join cat_spearman s on s.source = b.source and s.target = b.target and s.period = 'all'""")
def r05(spark, sf):
    found = whole_ranks(detrended(spark, sf, "category_name"), "category_name", interval={"min_abs_r": None})
    return found.select("source", "target", *fixed_cols("r", "ci_lower", "ci_upper"))


@query("w06_average_rank", f"""
    select item_name, cast(date as varchar) as date, {fx('''rank() over (partition by item_name order by qty)
      + (count(*) over (partition by item_name, qty) - 1) / 2.0''')} as avg_rank from item_dense""")
def w06(spark, sf):
    return (pairs.average_rank(dense(spark, sf, "item_name"), ["item_name"], QTY)
            .select("item_name", day(), *fixed_cols("avg_rank")))


@query("w12_bin_labels", """
    select item_name, cast(date as varchar) as date, """ + ", ".join(
    f"cast(least(floor((r - 1) * {b} / n), {b - 1}) as integer) as bin_{b}" for b in (2, 5, 12)) + """
    from (select *, rank() over (partition by item_name order by qty)
            + (count(*) over (partition by item_name, qty) - 1) / 2.0 as r,
            count(*) over (partition by item_name) as n from item_dense)""")
def w12(spark, sf):
    ranked = pairs.average_rank(dense(spark, sf, "item_name"), ["item_name"], QTY)
    return ranked.select("item_name", day(), *[
        pairs.bin_label("avg_rank", ["item_name"], b).alias(f"bin_{b}") for b in (2, 5, 12)])


@query("w13_normal_scores")
def w13(spark, sf):
    base = calendar.decompose(dense(spark, sf, "item_name").withColumn("logq", log_qty(QTY)), "item_name", "logq")
    return (pairs.normal_scores(base, ["item_name"], "residual")
            .select("item_name", day(), *fixed_cols("score")))


part("item_p", f"select *, {sql_p('r', 'n_days')} as p_value from item_spearman")
part("item_q", """
    select *, least(1, min(p_value * n / rn) over (partition by period order by rn rows between current row and unbounded following)) as q_value
    from (select *, row_number() over (partition by period order by p_value) as rn, count(*) over (partition by period) as n from item_p)""")


def item_scores(spark, sf):
    """Scores of item pairs per period; pairs strong over the whole range have a bootstrap interval there."""
    series = pairs.packed(pairs.by_period(detrended(spark, sf, "item_name")), ["item_name", "period"], "x")
    return stage(with_whole_interval(series, "item_name").withColumn("p_normal", correlation_p("r", "n_days")), "item_scores")


def with_whole_interval(series, entity, within=(), **how):
    """Rank correlations per period; the interval is drawn for the whole range alone."""
    series = stage(series, "series")
    whole = F.col("period") == pairs.WHOLE
    keys = [*within, "period"]
    strong = pairs.rank_correlation(series.where(whole), entity, keys, interval={"min_abs_r": 0.30}, **how)
    rest = pairs.rank_correlation(series.where(~whole), entity, keys, **how)
    return strong.unionByName(rest, allowMissingColumns=True)


@query("w11_fdr", f"select source, target, period, {fx_cols('p_value', 'q_value', digits=5)} from item_q")
def w11(spark, sf):
    scored = item_scores(spark, sf).select("source", "target", "period", F.col("p_normal").alias("p_value"))
    return pairs.fdr(scored, ["period"]).select("source", "target", "period", *fixed_cols("p_value", "q_value", digits=5))


@query("p11_strength", f"""
    select source, target, period, {STRENGTH_SQL} as strength
    from item_spearman s left join (select 'all' as period, * from item_boot) using (source, target, period)""")
def p11(spark, sf):
    return item_scores(spark, sf).select("source", "target", "period", pairs.strength("r", "ci_lower", "ci_upper").alias("strength"))


CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("r07_symmetric_matrix", "select row, " + ", ".join(
    f"{fx(f'''max(case when c = '{c}' then r end)''')} as {c.lower()}" for c in CATEGORIES) + """
    from (select source as row, target as c, r from cat_spearman where period = 'all'
          union all select target, source, r from cat_spearman where period = 'all'
          union all select category_name, category_name, 1.0 from (select distinct category_name from cat_day))
    group by row""")
def r07(spark, sf):
    daily = detrended(spark, sf, "category_name")
    found = whole_ranks(daily, "category_name")
    names = tables.read(spark, sf, "part").select(F.col("p_type").alias("category_name")).distinct()
    wide = pairs.symmetric_matrix(found, "r", names, "category_name", CATEGORIES)
    return wide.select("row", *[fixed(c).alias(c.lower()) for c in CATEGORIES])


part("item_raw_p", "select item_name as e, date, 'all' as period, qty as x from item_dense")
part("item_resid_p", "select item_name as e, date, 'all' as period, floor(residual * 1e9 + 0.5) / 1e9 as x from item_decomposed")
part("item_raw_spearman", spearman_sql("item_raw_p"))
part("item_resid_spearman", spearman_sql("item_resid_p"))


@query("r08_raw_and_residual_rank", f"""
    select a.source, a.target, {fx('a.r')} as r_raw, {fx('b.r')} as r_residual
    from item_raw_spearman a join item_resid_spearman b on a.source = b.source and a.target = b.target""")
def r08(spark, sf):
    base = dense(spark, sf, "item_name").withColumn("logq", log_qty(QTY))
    split = calendar.decompose(base, "item_name", "logq").withColumn("residual", fixed("residual", 9))
    one = lambda v, name: whole_ranks(split, "item_name", v).select(
        "source", "target", fixed("r").alias(name))
    return one(QTY, "r_raw").join(one("residual", "r_residual"), ["source", "target"])


def mic_sql(source: str, key: str) -> str:
    rank = f"rank() over (partition by {key} order by {{0}}) + (count(*) over (partition by {key}, {{0}}) - 1) / 2.0"
    return f"""
    with r as (select {key}, {rank.format('x')} as rx, {rank.format('y')} as ry, count(*) over (partition by {key}) as n from {source}),
    g as (select bx, b_y as by_ from (select unnest(range(2, 13)) as bx), (select unnest(range(2, 13)) as b_y)),
    c as (select {key}, bx, by_, least(floor((rx - 1) * bx / n), bx - 1) as lx, least(floor((ry - 1) * by_ / n), by_ - 1) as ly,
            count(*) as k, any_value(n) as n
          from r, g where bx <= floor(greatest(4, floor(pow(n, 0.6))) / 2) and by_ <= floor(greatest(4, floor(pow(n, 0.6))) / bx)
          group by all),
    m as (select {key}, bx, by_, k / cast(n as double) as p,
            sum(k) over (partition by {key}, bx, by_, lx) / cast(n as double) as px,
            sum(k) over (partition by {key}, bx, by_, ly) / cast(n as double) as py from c)
    select {key}, least(1, greatest(0, max(s))) as score
    from (select {key}, sum(p * ln(p / (px * py))) / ln(least(any_value(bx), any_value(by_))) as s from m group by {key}, bx, by_)
    group by {key}"""


part("cat_resid", """
    select category_name as e, date, floor((x - trend - weekly - yearly) * 1e9 + 0.5) / 1e9 as x from
      (select *, avg(x - trend - weekly) over (partition by category_name, dayofyear(date)) as yearly from
        (select *, avg(x - trend) over (partition by category_name, isodow(date)) as weekly from
          (select category_name, date, ln(1 + qty) as x, avg(ln(1 + qty)) over (partition by category_name order by date
             rows between 182 preceding and 182 following) as trend from cat_dense)))""")
part("cat_resid_pairs", """
    select a.e as source, b.e as target, a.date, a.x, b.x as y from cat_resid a join cat_resid b on a.date = b.date and a.e < b.e""")
part("cat_mic", mic_sql("cat_resid_pairs", "source, target"))


def residual_series(spark, sf, level):
    split = calendar.decompose(dense(spark, sf, level).withColumn("logq", log_qty(QTY)), level, "logq")
    return stage(pairs.packed(split.withColumn("residual", fixed("residual", 9)), [level], "residual"), "residual_series")


@query("r09_information_score", f"select source, target, {fx('score')} as score from cat_mic")
def r09(spark, sf):
    series = residual_series(spark, sf, "category_name")
    return (pairs.information_scores(pairs.entity_pairs(series, "category_name"), ["source", "target"])
            .select("source", "target", *fixed_cols("score")))


NULL_DRAWS = 2000
part("cat_shifted", f"""
    with s as (select e, date, x, row_number() over (partition by e order by date) - 1 as i from cat_resid),
    k as (select e, row_number() over (order by ('0x' || substr(md5(e), 1, 8))::bigint, e) - 1 as k,
            (select count(distinct e) from s) as cnt, (select max(i) + 1 from s) as n from (select distinct e from s)),
    d as (select d, ('0x' || substr(md5('20230907:' || d || ':a'), 1, 8))::bigint % cnt as a,
            ('0x' || substr(md5('20230907:' || d || ':b'), 1, 8))::bigint % (cnt - 1) as b0,
            least(14, greatest(1, n // 4)) + ('0x' || substr(md5('20230907:' || d || ':s'), 1, 8))::bigint % (n - 2 * least(14, greatest(1, n // 4)) + 1) as shift, n
          from (select unnest(range(0, {NULL_DRAWS})) as d), (select any_value(cnt) as cnt, any_value(n) as n from k))
    select cast(d.d as varchar) as draw, sa.i, sa.x, sb.x as y, d.shift
    from d join k ka on ka.k = d.a join k kb on kb.k = d.b0 + (case when d.b0 >= d.a then 1 else 0 end)
    join s sa on sa.e = ka.e join s sb on sb.e = kb.e and sb.i = (sa.i - d.shift + d.n) % d.n""")
part("cat_null_mic", mic_sql("cat_shifted", "draw"))


@query("r10_null_scores", f"""
    select draw, {fx('score')} as score, {fx('(select quantile_cont(score, 0.99) from cat_null_mic)')} as threshold from cat_null_mic""")
def r10(spark, sf):
    null = null_scores(spark, sf)
    return null.select("draw", *fixed_cols("score")).withColumn(
        "threshold", fixed(null.select(F.percentile("score", F.lit(0.99))).scalar()))


def null_scores(spark, sf, series=None):
    if series is None:
        series = residual_series(spark, sf, "category_name")
    return stage(pairs.information_scores(
        pairs.shifted_pairs(series, "category_name", NULL_DRAWS), ["draw"]), "null_scores")


part("cat_resid_p", "select e, date, 'all' as period, x from cat_resid")
part("cat_resid_spearman", spearman_sql("cat_resid_p"))


@query("r11_edge_table", f"""
    select m.source, m.target, {fx('m.score')} as score, {fx('s.r')} as weight,
      m.score >= t.t as is_candidate, m.score >= t.t and abs(s.r) > 0.000001 as is_edge,
      case when s.r > 0 then 'complement' else 'substitute' end as association_type
    from cat_mic m join cat_resid_spearman s on s.source = m.source and s.target = m.target,
      (select quantile_cont(score, 0.99) as t from cat_null_mic) t""")
def r11(spark, sf):
    series = residual_series(spark, sf, "category_name")
    both = pairs.entity_pairs(series, "category_name")
    keys = ["source", "target"]
    scored = pairs.information_scores(both, keys).join(
        pairs.rank_correlation(series, "category_name").select(*keys, F.col("r").alias("weight")), keys)
    cut = null_scores(spark, sf, series).select(F.percentile("score", F.lit(0.99))).scalar()
    out = network.edge_table(scored, "weight", F.col("score") >= cut)
    return out.select(*keys, *fixed_cols("score", "weight"), "is_candidate", "is_edge", "association_type")


# ---------------------------------------------------------------- networks of items

EDGES = 40
part("item_all", "select source, target, r from item_spearman where period = 'all'")
part("item_cut", f"select abs(r) as cut from item_all order by abs(r) desc limit 1 offset {EDGES - 1}")
part("item_edges", "select source, target, r from item_all where abs(r) >= (select cut from item_cut)")


def item_pairs(spark, sf):
    daily = detrended(spark, sf, "item_name")
    return stage(whole_ranks(daily, "item_name"), "item_pairs")


def item_names(spark, sf):
    return tables.read(spark, sf, "part").select(F.col("p_brand").alias("item_name")).distinct()


def item_edges(scored):
    return stage(scored.where(F.abs("r") >= network.kth_largest(scored, F.abs("r"), EDGES)), "item_edges")


part("item_ends", "select source as item_name, r from item_edges union all select target, r from item_edges")


@query("r12_node_metrics", f"""
    select item_name, degree, {fx('w')} as weighted_degree, rn as core_rank, rn <= 10 as is_core_node
    from (select n.item_name, count(e.r) as degree, coalesce(sum(abs(e.r)), 0) as w,
            row_number() over (order by coalesce(sum(abs(e.r)), 0) desc, count(e.r) desc, n.item_name) as rn
          from (select distinct p_brand as item_name from part) n left join item_ends e on e.item_name = n.item_name group by 1)""")
def r12(spark, sf):
    out = network.node_metrics(item_edges(item_pairs(spark, sf)), item_names(spark, sf), "item_name", "r")
    return out.select("item_name", "degree", *fixed_cols("weighted_degree"), "core_rank", "is_core_node")


@query("r13_components", """
    with recursive walk(a, b) as (
      select item_name, item_name from (select distinct p_brand as item_name from part)
      union
      select w.a, case when e.source = w.b then e.target else e.source end
      from walk w join item_edges e on e.source = w.b or e.target = w.b),
    found as (select a as item_name, min(b) as community from walk group by a)
    select community, count(*) as node_count, string_agg(item_name, ',' order by item_name) as members from found group by community
    """)
def r13(spark, sf):
    scored = item_pairs(spark, sf)
    found = network.components(item_edges(scored), item_names(spark, sf), "item_name")
    return found.groupBy("community").agg(
        F.count(F.lit(1)).alias("node_count"),
        F.array_join(F.array_sort(F.collect_list("item_name")), ",").alias("members"))


# Cuts of the null scores and of the stability; the main one is the second of each.
NULL_CUTS, STABLE_CUTS = (0.975, 0.99, 0.995), (0.60, 0.70, 0.80)
part("cat_resid_boot", boot_sql("cat_resid_p", "cat_resid_spearman", 0))
part("cat_cuts", "select " + ", ".join(f"quantile_cont(score, {c}) as q{i}" for i, c in enumerate(NULL_CUTS)) + " from cat_null_mic")


@query("r14_threshold_sensitivity", f"""
    with e as (select score, same_sign, abs(r) > 0.000001 as linked from cat_mic join cat_resid_spearman using (source, target) join cat_resid_boot using (source, target)),
    o as ({" union all ".join(
        [f"select 'null_quantile' as parameter, '{c}' as value, q{i} as threshold, q{i} as cut, {STABLE_CUTS[1]} as stable, q1 from cat_cuts" for i, c in enumerate(NULL_CUTS)]
        + [f"select 'stability', '{c:.2f}', {c}, q1, {c}, q1 from cat_cuts" for c in STABLE_CUTS])}),
    m as (select o.*, linked and score >= cut and same_sign >= stable as chosen, linked and score >= q1 and same_sign >= {STABLE_CUTS[1]} as base from e cross join o)
    select parameter, value, {fx('any_value(threshold)')} as threshold, count_if(chosen) as edge_count,
      {fx('case when count_if(chosen or base) = 0 then 1.0 else count_if(chosen and base) / cast(count_if(chosen or base) as double) end')} as jaccard
    from m group by 1, 2""")
def r14(spark, sf):
    series = residual_series(spark, sf, "category_name")
    keys = ["source", "target"]
    weights = pairs.rank_correlation(series, "category_name", interval={"min_abs_r": None}).select(*keys, "r", "same_sign")
    scored = stage(pairs.information_scores(pairs.entity_pairs(series, "category_name"), keys).join(weights, keys), "scored")
    null = null_scores(spark, sf, series)
    cuts = [null.select(F.percentile("score", F.lit(c))).scalar() for c in NULL_CUTS]
    edges = lambda cut, stable: (F.abs("r") > 1e-6) & (F.col("score") >= cut) & (F.col("same_sign") >= stable)
    options = [("null_quantile", str(c), cut, edges(cut, STABLE_CUTS[1])) for c, cut in zip(NULL_CUTS, cuts)]
    options += [("stability", f"{c:.2f}", F.lit(c), edges(cuts[1], c)) for c in STABLE_CUTS]
    return network.sensitivity(scored, edges(cuts[1], STABLE_CUTS[1]), options).select(
        "parameter", "value", *fixed_cols("threshold"), "edge_count", *fixed_cols("jaccard"))


part("item_raw_cut", f"select abs(r) as cut from item_raw_spearman order by abs(r) desc limit 1 offset {EDGES - 1}")


@query("r15_equal_density", f"""
    select {fx('(select cut from item_raw_cut)')} as threshold, count(a) as baseline_edges, count(b) as final_edges,
      {fx('count(case when a = 1 and b = 1 then 1 end) / cast(count(*) as double)')} as jaccard
    from (select 1 as a, source, target from item_raw_spearman where abs(r) >= (select cut from item_raw_cut))
    full outer join (select 1 as b, source, target from item_edges) using (source, target)""")
def r15(spark, sf):
    final = item_edges(item_pairs(spark, sf))
    raw = stage(whole_ranks(dense(spark, sf, "item_name"), "item_name", QTY), "raw_pairs")
    cut = network.kth_largest(raw, F.abs("r"), EDGES)
    baseline = raw.where(F.abs("r") >= cut)
    overlap = network.set_overlap(baseline, final, ["source", "target"])
    return overlap.select(
        fixed(cut).alias("threshold"), baseline.select(F.count(F.lit(1))).scalar().alias("baseline_edges"),
        final.select(F.count(F.lit(1))).scalar().alias("final_edges"), *fixed_cols("jaccard"))


part("item_top", """
    select side, place, source, target, r, 'all' as period
    from (select *, case when r > 0 then 'positive' else 'negative' end as side,
            row_number() over (partition by r > 0 order by abs(r) desc, source, target) as place
          from item_all where r <> 0)
    where (side = 'positive' and place <= 7) or (side = 'negative' and place <= 3)""")
part("item_top_boot", boot_sql("item_detr_p", "item_top", 0))


@query("t03_top_pairs_by_sign", f"""
    select side, place, source, target, {fx_cols('r', 'ci_lower', 'ci_upper')} from item_top join item_top_boot using (source, target)""")
def t03(spark, sf):
    series = stage(pairs.packed(detrended(spark, sf, "item_name"), ["item_name"], "x"), "series")
    top = stage(network.top_by_sign(pairs.rank_correlation(series, "item_name"), "r"), "top_pairs")
    # at most ten pairs: their intervals come from the cells of the items they name
    named = top.select(F.explode(F.array("source", "target")).alias("item_name")).distinct()
    found = pairs.rank_correlation(series.join(named, "item_name", "left_semi"), "item_name", interval={"min_abs_r": None})
    return (top.join(found.select("source", "target", "ci_lower", "ci_upper"), ["source", "target"])
            .select("side", "place", "source", "target", *fixed_cols("r", "ci_lower", "ci_upper")))


@query("t04_equal_density_threshold", f"""
    select {fx('(select cut from item_cut)')} as kth_largest, {fx('(select quantile_cont(abs(r), 0.95) from item_all)')} as fallback""")
def t04(spark, sf):
    scored = item_pairs(spark, sf)
    return scored.groupBy().agg(
        fixed(F.max(network.kth_largest(scored, F.abs("r"), EDGES))).alias("kth_largest"),
        fixed(F.max(network.kth_largest(scored, F.abs("r"), 0))).alias("fallback"))


# ---------------------------------------------------------------- views of product pairs

part("product_meta", "select distinct sku_code, category_name from product_day")


@query("j11_within_group_pairs", f"""
    select 'within_category' as level, a.category_name as group_name, source, target, {fx('r')} as r
    from product_index_pairs p join product_meta a on a.sku_code = p.source join product_meta b on b.sku_code = p.target
    where a.category_name = b.category_name""")
def j11(spark, sf):
    daily = tables.product_day(spark, sf)
    monthly = profile.monthly_profile(daily, "sku_code", QTY).join(
        daily.select("sku_code", F.col("category_name").alias("group_name")).distinct(), "sku_code")
    found = pairs.index_correlation(monthly, "sku_code", within=["group_name"])
    return found.select(F.lit("within_category").alias("level"), "group_name", "source", "target", *fixed_cols("r"))


part("product_edges", """
    select p.source, p.target, p.r, a.category_name as ca, b.category_name as cb, o.jaccard
    from (select * from product_index_pairs where abs(r) >= 0.5) p
    join product_meta a on a.sku_code = p.source join product_meta b on b.sku_code = p.target
    join product_overlap o on o.source = p.source and o.target = p.target""")


@query("a14_category_edges", f"""
    select least(ca, cb) || '--' || greatest(ca, cb) as category_pair, count(*) as edge_count,
      count_if(r > 0) as positive_edges, count_if(r < 0) as negative_edges,
      {fx('avg(abs(r))')} as mean_abs_weight, {fx('avg(jaccard)')} as mean_stability
    from product_edges group by 1""")
def a14(spark, sf):
    daily = tables.product_day(spark, sf)
    meta = daily.select("sku_code", "category_name").distinct()
    monthly = profile.monthly_profile(daily, "sku_code", QTY)
    top = pairs.index_correlation(monthly, "sku_code").where(F.abs("r") >= 0.5)
    span = calendar.span_calendar(daily, "sku_code", QTY)
    known = pairs.overlap_of(stage(top, "strong_pairs"), pairs.packed(span, ["sku_code"], QTY), "sku_code")
    named = (known.join(meta.select(F.col("sku_code").alias("source"), F.col("category_name").alias("source_category")), "source")
             .join(meta.select(F.col("sku_code").alias("target"), F.col("category_name").alias("target_category")), "target"))
    return network.category_edges(named, "r", "jaccard").select(
        "category_pair", "edge_count", "positive_edges", "negative_edges", *fixed_cols("mean_abs_weight", "mean_stability"))
