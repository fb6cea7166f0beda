"""The SKU assortment chain: candidates, shares, price grids and plans of a given size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from greengrain.functions.exprs import fixed
from greengrain.functions.ordered import weighted_quantiles
from greengrain.functions.staging import stage
from greengrain.operators import assortment as so
from greengrain.operators import network, profile
from greengrain.operators import scenario as sc
from greengrain.plans import category_plan as cp
from greengrain.plans.profiling import day, fixed_cols, fx_cols
from greengrain.plans.registry import fx, part, query
from greengrain.plans.relationships import product_index_pairs
from greengrain.sources import tables

CAT, SKU, QTY = so.CAT, so.SKU, so.QTY
SIZES = list(range(27, 34))
SIZE_SQL = "(select k from chosen_size)"

part("tgt", "select cast(max(date) + 1 as date) as target from product_day")
part("cand", """
    select sku_code, any_value(category_name) as category_name, sum(gross_sales_qty) as recent_qty, count(*) as recent_days,
      sum(gross_revenue) as recent_revenue, sum(gross_revenue) / sum(gross_sales_qty) as reference_price,
      max_by(wholesale_price, date) as latest_cost, sum(loss_rate_pct * gross_sales_qty) / sum(gross_sales_qty) / 100 as loss_rate
    from product_day, tgt where date between target - 7 and target - 1 and gross_sales_qty > 0 group by sku_code""")
CAND = ["recent_qty", "recent_revenue", "reference_price", "latest_cost", "loss_rate"]


@query("k01_candidates", f"select sku_code, category_name, recent_days, {fx_cols(*CAND)} from cand")
def k01(spark, sf):
    daily = tables.product_day(spark, sf)
    return so.candidates(daily, so.target_date(daily)).select(SKU, CAT, "recent_days", *fixed_cols(*CAND))


@query("j09_latest_price", f"""
    select sku_code, {fx('max_by(gross_weighted_avg_price, date)')} as latest, cast(max(date) as varchar) as latest_date
    from product_day, tgt where date between target - 30 and target - 1 and gross_weighted_avg_price is not null group by sku_code""")
def j09(spark, sf):
    daily = tables.product_day(spark, sf)
    return so.latest_price(daily, so.target_date(daily), "gross_weighted_avg_price", 30).select(
        SKU, *fixed_cols("latest"), day("latest_date"))


part("cand_cost", """
    select c.*, c.latest_cost * m.cost_future / r.recent_cost as predicted_cost
    from cand c join (select category_name, sum(gross_sales_qty * wholesale_price) / sum(gross_sales_qty) as recent_cost
                      from product_day, tgt where date between target - 7 and target - 1 and gross_sales_qty > 0 group by 1) r
      on r.category_name = c.category_name
    join model m on m.category_name = c.category_name and m.day = 0""")


@dataclass
class Assortment:
    """Written tables that every step of the chain starts from."""
    daily: DataFrame
    target: object
    cand: DataFrame
    theta: DataFrame
    bounds: DataFrame
    category_demand: DataFrame
    nominal_order: DataFrame
    category: cp.CategoryModel
    base_plan: DataFrame


def build(spark, sf) -> Assortment:
    categories, daily = tables.category_and_product_day(spark, sf)
    m = cp.build(spark, sf, daily=categories)
    base = stage(sc.baseline_plan(m.drawn, m.model, m.bounds), "baseline")
    first = F.col("day") == 0
    rows = sc.respond(m.drawn.where(first).join(m.model, [CAT, "day"]).join(base.where(first), [CAT, "day"]))
    category_demand = stage(rows.select("scenario", CAT, F.col("demand").alias("category_demand"), "u"), "category_demand")
    target = so.target_date(daily)
    cand = so.predicted_cost(so.candidates(daily, target), daily, target, m.model.where(first))
    shares = shares_of(daily, cand, target)
    cand = stage(cand.join(shares.drop(CAT), SKU), "candidates")
    return Assortment(daily, target, cand, m.theta, m.bounds, category_demand,
                      base.where(first).agg(F.sum("order_qty").alias("nominal")), m, base)


def shares_of(daily, cand, target):
    cand = stage(cand, "candidates")
    kappas = so.select_kappa(so.validation_rows(daily, cand, target), cand)
    return so.posterior_shares(so.base_shares(daily, cand, target), kappas)


@query("p09_predicted_cost", f"select sku_code, category_name, {fx_cols('latest_cost', 'predicted_cost', digits=5)} from cand_cost")
def p09(spark, sf):
    categories, daily = tables.category_and_product_day(spark, sf)
    m = cp.build(spark, sf, daily=categories)
    target = so.target_date(daily)
    out = so.predicted_cost(so.candidates(daily, target), daily, target, m.model.where("day = 0"))
    return out.select(SKU, CAT, *fixed_cols("latest_cost", "predicted_cost", digits=5))


part("shares", """
    select sku_code, category_name, share_qty,
      case when sum(share_qty) over c > 0 then share_qty / sum(share_qty) over c else 1.0 / count(*) over c end as recent_share,
      case when sum(long_qty) over c > 0 then long_qty / sum(long_qty) over c else 1.0 / count(*) over c end as long_share
    from (select k.sku_code, k.category_name,
            coalesce(sum(case when h.date between target - 7 and target - 1 then greatest(h.gross_sales_qty, 0) end), 0) as share_qty,
            coalesce(sum(case when h.date between target - 1095 and target - 8 and isodow(h.date) = isodow(target) then greatest(h.gross_sales_qty, 0) end), 0) as long_qty
          from cand k cross join tgt left join product_day h on h.sku_code = k.sku_code group by 1, 2)
    window c as (partition by category_name)""")


@query("k02_base_shares", f"select sku_code, category_name, {fx_cols('share_qty', 'recent_share', 'long_share')} from shares")
def k02(spark, sf):
    daily = tables.product_day(spark, sf)
    target = so.target_date(daily)
    return so.base_shares(daily, so.candidates(daily, target), target).select(
        SKU, CAT, *fixed_cols("share_qty", "recent_share", "long_share"))


part("valid_rows", """
    select h.category_name, v.valid_date, h.sku_code, sum(case when h.date = v.valid_date then h.gross_sales_qty else 0 end) as observed,
      sum(case when h.date between v.valid_date - 7 and v.valid_date - 1 then h.gross_sales_qty else 0 end) as recent,
      sum(case when h.date between v.valid_date - 365 and v.valid_date - 8 then h.gross_sales_qty else 0 end) as prior,
      count_if(h.date between v.valid_date - 365 and v.valid_date - 8) as prior_rows
    from product_day h join (select cast(target - cast(7 * k as integer) as date) as valid_date from tgt, (select unnest(range(1, 13)) as k)) v
      on h.date between v.valid_date - 7 and v.valid_date
      or (h.date between v.valid_date - 365 and v.valid_date - 8 and isodow(h.date) = isodow(v.valid_date))
    where h.sku_code in (select sku_code from cand) group by 1, 2, 3""")


@query("j08_interval_join", f"""
    select category_name, cast(valid_date as varchar) as valid_date, sku_code, {fx_cols('observed', 'recent', 'prior')}, prior_rows from valid_rows""")
def j08(spark, sf):
    daily = tables.product_day(spark, sf)
    target = so.target_date(daily)
    return so.validation_rows(daily, so.candidates(daily, target), target).select(
        CAT, day("valid_date"), SKU, *fixed_cols("observed", "recent", "prior"), "prior_rows")


part("kappa", """
    with t as (select category_name, valid_date, sum(observed) as o, sum(recent) as r, sum(prior) as p, sum(prior_rows) as pr from valid_rows group by 1, 2),
    n as (select category_name, count(*) as n from cand group by 1),
    u as (select t.*, n.n from t join n on n.category_name = t.category_name where o > 0 and pr > 0),
    s as (select v.category_name, k.kappa, sum(-v.observed * ln(greatest(coalesce((v.recent + k.kappa * z.prior_share) / nullif(u.r + k.kappa, 0), z.prior_share), 1e-12))) as loss
          from valid_rows v join u on u.category_name = v.category_name and u.valid_date = v.valid_date,
            lateral (select case when u.p > 0 then v.prior / u.p else 1.0 / u.n end as prior_share) z,
            (values (0.0::double), (2.5), (5.0), (10.0), (20.0), (40.0), (80.0)) k(kappa)
          where v.observed > 0 group by 1, 2),
    w as (select category_name, sum(o) as weight, count(*) as records from u group by 1),
    best as (select s.category_name, s.kappa, w.records, row_number() over (partition by s.category_name
               order by floor(s.loss / w.weight * 1e9 + 0.5), s.kappa) as rn from s join w on w.category_name = s.category_name)
    select n.category_name, coalesce(b.records, 0) as records, case when b.records >= 3 then b.kappa else 10.0 end as kappa
    from n left join best b on b.category_name = n.category_name and b.rn = 1""")


@query("k03_shrinkage_choice", "select category_name, records, cast(kappa as double) as kappa from kappa")
def k03(spark, sf):
    daily = tables.product_day(spark, sf)
    target = so.target_date(daily)
    cand = stage(so.candidates(daily, target), "candidates")
    return so.select_kappa(so.validation_rows(daily, cand, target), cand)


part("eb", """
    select *, raw / sum(raw) over (partition by category_name) as eb_share
    from (select s.*, k.kappa, coalesce((s.share_qty + k.kappa * s.long_share) / nullif(sum(s.share_qty) over (partition by s.category_name) + k.kappa, 0), s.long_share) as raw
          from shares s join kappa k on k.category_name = s.category_name)""")


@query("k04_posterior_shares", f"select sku_code, category_name, cast(kappa as double) as kappa, {fx_cols('eb_share')} from eb")
def k04(spark, sf):
    daily = tables.product_day(spark, sf)
    target = so.target_date(daily)
    out = shares_of(daily, so.candidates(daily, target), target)
    return out.select(SKU, CAT, "kappa", *fixed_cols("eb_share"))


part("share_pool", """
    select date, sku_code, category_name, sum(gross_sales_qty) as q from product_day, tgt
    where date between target - 1095 and target - 8 and isodow(date) = isodow(target) and sku_code in (select sku_code from cand) group by 1, 2, 3""")
part("share_draw", """
    with d as (select date, row_number() over (order by date) - 1 as date_no from (select distinct date from share_pool))
    select scenario, d.date from (select unnest(range(0, 600)) as scenario) s
    join d on d.date_no = ('0x' || substr(md5('2023:share:' || s.scenario), 1, 8))::bigint % (select count(*) from d)""")
part("share_scen", """
    with obs as (select d.scenario, e.sku_code, e.category_name, e.eb_share, t.day_qty, coalesce(p.q, 0) as q, count(*) over (partition by d.scenario, e.category_name) as n
                 from share_draw d cross join eb e
                 left join (select date, category_name, sum(q) as day_qty from share_pool group by 1, 2) t on t.date = d.date and t.category_name = e.category_name
                 left join share_pool p on p.date = d.date and p.sku_code = e.sku_code),
    mixed as (select *, h, h * (case when day_qty > 0 then q / day_qty else 1.0 / n end) + (1 - h) * eb_share as m
              from obs, (values (0.25::double), (0.5), (0.75)) v(h))
    select h, scenario, sku_code, category_name, m / sum(m) over (partition by h, scenario, category_name) as share from mixed""")


@query("k05_share_scenarios", f"select scenario, sku_code, {fx('share')} as share from share_scen where h = 0.5")
def k05(spark, sf):
    a = build(spark, sf)
    return so.share_scenarios(a.daily, a.cand, a.target, sc.SCENARIOS).select("scenario", SKU, *fixed_cols("share"))


part("price_hist", """
    select sku_code, category_name, date, gross_sales_qty as w, gross_weighted_avg_price as p, gross_weighted_avg_price / wholesale_price - 1 as m
    from product_day, tgt where date between target - 365 and target - 1 and gross_sales_qty > 0 and gross_weighted_avg_price > 0 and wholesale_price > 0""")


def quantile_sql(src: str, key: str) -> str:
    """Weighted quantiles row by row: neighbours around each probability and a straight line between."""
    return f"""
    with pos as (select {key}, m, (sum(w) over (partition by {key} order by m, date, sku_code rows unbounded preceding) - w / 2) / sum(w) over (partition by {key}) as spot
                 from {src}),
    q as (select p.{key}, v.name, v.prob, max(case when spot <= prob then spot end) as la, max_by(m, spot) filter (where spot <= prob) as lm,
            min(case when spot >= prob then spot end) as ra, min_by(m, spot) filter (where spot >= prob) as rm
          from pos p, (values ('q10', 0.1::double), ('q30', 0.3), ('q50', 0.5), ('q70', 0.7), ('q90', 0.9)) v(name, prob) group by 1, 2, 3)
    select {key}, name, case when la is null then rm when ra is null then lm when ra = la then lm
      else lm + (rm - lm) * (prob - la) / (ra - la) end as value from q"""


part("sku_wq", quantile_sql("price_hist", "sku_code"))
part("cat_wq", quantile_sql("price_hist", "category_name"))


@query("w09_weighted_quantiles", "select category_name, " + ", ".join(
    fx(f"max(case when name = '{n}' then value end)") + f" as {n}" for n in so.GRID_PROBS) + " from cat_wq group by 1")
def w09(spark, sf):
    daily = tables.product_day(spark, sf)
    target = so.target_date(daily)
    hist = daily.where(F.col("date").between(F.date_sub(target, 365), F.date_sub(target, 1)) & (F.col(QTY) > 0)).select(
        SKU, CAT, "date", F.col(QTY).alias("w"), (F.col("gross_weighted_avg_price") / F.col("wholesale_price") - 1).alias("m"))
    return weighted_quantiles(hist, [CAT], "m", "w", ["date", SKU], so.GRID_PROBS).select(CAT, *fixed_cols(*so.GRID_PROBS))


part("grid", """
    with s as (select sku_code, count(distinct date) as history_days, count(distinct p) as history_prices from price_hist group by 1),
    b as (select c.sku_code, c.category_name, c.predicted_cost as cost, coalesce(history_days, 0) as history_days, coalesce(history_prices, 0) as history_prices,
            coalesce(history_days, 0) >= 30 and coalesce(history_prices, 0) >= 5 as enough, markup_low, markup_reference, markup_high,
            ceil(c.predicted_cost * (1 + markup_low) * 10 - 1e-9) / 10 as lo0, floor(c.predicted_cost * (1 + markup_high) * 10 + 1e-9) / 10 as hi0
          from cand_cost c join bounds o on o.category_name = c.category_name left join s on s.sku_code = c.sku_code),
    e as (select *, case when hi0 < lo0 then floor(cost * (1 + (markup_low + markup_high) / 2) * 10 + 0.5) / 10 else lo0 end as lo,
            case when hi0 < lo0 then floor(cost * (1 + (markup_low + markup_high) / 2) * 10 + 0.5) / 10 else hi0 end as hi from b),
    r as (select e.*, coalesce(sq.value, cq.value) as m from e join cat_wq cq on cq.category_name = e.category_name
            left join sku_wq sq on sq.sku_code = e.sku_code and sq.name = cq.name and e.enough),
    first as (select distinct sku_code, least(greatest(floor(cost * (1 + least(greatest(m, markup_low), markup_high)) * 10 + 0.5) / 10, lo), hi) as price from r),
    few as (select sku_code from first group by 1 having count(*) < 3),
    backup as (select distinct e.sku_code, least(greatest(floor(cost * (1 + m) * 10 + 0.5) / 10, lo), hi) as price
               from e, lateral (select unnest([markup_low, markup_reference, markup_high]) as m) x where e.sku_code in (select sku_code from few)),
    allp as (select * from first where sku_code not in (select sku_code from few) union all select * from backup)
    select e.sku_code, e.category_name, e.cost as predicted_cost, history_days, history_prices, a.price, a.price / e.cost - 1 as markup,
      case when enough then 'sku_history' else 'category_fallback' end as grid_source,
      row_number() over (partition by e.sku_code order by a.price) as price_level
    from e join allp a on a.sku_code = e.sku_code""")


def grid_of(a: Assortment) -> DataFrame:
    return stage(so.price_grid(a.daily, a.cand, a.bounds, a.target), "price_grid")


@query("k06_price_grid", f"""
    select sku_code, category_name, cast(price_level as integer) as price_level, {fx_cols('price', 'markup', digits=4)}, grid_source, history_days, history_prices from grid""")
def k06(spark, sf):
    a = build(spark, sf)
    return so.price_grid(a.daily, a.cand, a.bounds, a.target).select(
        SKU, CAT, "price_level", *fixed_cols("price", "markup", digits=4), "grid_source", "history_days", "history_prices")


part("near", """
    select sku_code, price, price_level from (select g.*, row_number() over (partition by g.sku_code order by floor(abs(g.price - m.med) * 1e6 + 0.5), price_level) as rn
      from grid g join (select sku_code, quantile_cont(price, 0.5) as med from grid group by 1) m on m.sku_code = g.sku_code) where rn = 1""")


@query("j12_nearest_price", f"select sku_code, cast(price_level as integer) as price_level, {fx('price', 4)} as price from near")
def j12(spark, sf):
    return so.nearest_price(grid_of(build(spark, sf))).select(SKU, "price_level", *fixed_cols("price", digits=4))


part("cat_dem", """
    select r.scenario, r.category_name, r.demand as category_demand, s.u from base_resp r
    join scen s on s.scenario = r.scenario and s.day = r.day and s.category_name = r.category_name where r.day = 0""")
part("alt_demand", """
    select s.scenario, g.sku_code, g.category_name, g.price_level, g.price,
      s.share * d.category_demand * pow(g.price / c.reference_price, t.elasticity_used) as demand
    from (select * from share_scen where h = 0.5) s join grid g on g.sku_code = s.sku_code join cand c on c.sku_code = s.sku_code
    join cat_dem d on d.scenario = s.scenario and d.category_name = s.category_name join theta t on t.category_name = s.category_name""")


def alternative_demand(a, grid):
    shares = so.share_scenarios(a.daily, a.cand, a.target, sc.SCENARIOS)
    return so.sku_demand(shares, a.category_demand, grid.select(SKU, CAT, "price_level", "price"), a.cand, a.theta)


@query("k07_sku_demand", f"""
    select sku_code, cast(price_level as integer) as price_level, count(*) as n, {fx('avg(demand)', 4)} as mean_demand,
      {fx('max(demand)', 4)} as max_demand from alt_demand group by 1, 2""")
def k07(spark, sf):
    a = build(spark, sf)
    return alternative_demand(a, grid_of(a)).groupBy(SKU, "price_level").agg(
        F.count(F.lit(1)).alias("n"), fixed(F.avg("demand"), 4).alias("mean_demand"), fixed(F.max("demand"), 4).alias("max_demand"))


@query("k08_sku_cost", f"""
    select d.scenario, c.sku_code, {fx('c.predicted_cost * exp(d.u)', 4)} as cost from cand_cost c join cat_dem d on d.category_name = c.category_name""")
def k08(spark, sf):
    a = build(spark, sf)
    return sku_costs(a).select("scenario", SKU, *fixed_cols("cost", digits=4))


def sku_costs(a):
    return a.category_demand.join(a.cand.select(SKU, CAT, "predicted_cost"), CAT).select(
        "scenario", SKU, (F.col("predicted_cost") * F.exp("u")).alias("cost"))


@query("k09_order_upper", f"""
    select a.sku_code, {fx('greatest(2.5, 1.2 * quantile_cont(d, 0.99) / (1 - any_value(c.loss_rate)))', 4)} as order_upper
    from (select sku_code, scenario, max(demand) as d from alt_demand group by 1, 2) a join cand c on c.sku_code = a.sku_code group by 1""")
def k09(spark, sf):
    a = build(spark, sf)
    return so.order_upper(alternative_demand(a, grid_of(a)), a.cand).select(SKU, *fixed_cols("order_upper", digits=4))


# ---------------------------------------------------------------- plans of a given size

part("ranked", """
    select c.*, e.eb_share, n.price, n.price_level, greatest(2.5, c.recent_qty / 7 / (1 - c.loss_rate)) as base_order,
      row_number() over (order by c.recent_qty desc, floor(e.eb_share * 1e9 + 0.5) desc, c.sku_code) as place
    from cand_cost c join eb e on e.sku_code = c.sku_code join near n on n.sku_code = c.sku_code""")
part("k_plans", f"""
    select k.k, r.sku_code, r.category_name, r.price, r.loss_rate, r.predicted_cost,
      greatest(2.5, r.base_order * (select sum(order_qty) from base_plan where day = 0) / sum(r.base_order) over (partition by k.k)) as order_qty
    from (select unnest(range({SIZES[0]}, {SIZES[-1] + 1})) as k) k join ranked r on r.place <= k.k""")


def ranked_candidates(a, prices, k):
    best = so.top_sellers(a.cand.join(prices, SKU), k, [F.desc("recent_qty"), F.desc(fixed("eb_share", 9))])
    return best.withColumn("base_order", F.greatest(F.lit(so.MIN_ORDER), F.col("recent_qty") / 7 / (1 - F.col("loss_rate"))))


def sized_plans(a, ranked, sizes):
    """One plan per size: the best sellers at their middle price, orders scaled to the nominal total."""
    per = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sizes]))).where(F.col("place") <= F.col("k"))
    totals = per.groupBy("k").agg(F.sum("base_order").alias("_all"))
    nominal = a.nominal_order.select("nominal").scalar()
    return per.join(totals, "k").select(
        "k", SKU, CAT, "price", "price_level", "loss_rate", "predicted_cost",
        F.greatest(F.lit(so.MIN_ORDER), F.col("base_order") * nominal / F.col("_all")).alias("order_qty"))


part("plan_demand", """
    select p.k, a.scenario, a.sku_code, a.category_name, a.demand, p.price, p.order_qty, p.loss_rate, p.predicted_cost * exp(d.u) as cost
    from k_plans p join alt_demand a on a.sku_code = p.sku_code and a.price = p.price
    join cat_dem d on d.scenario = a.scenario and d.category_name = a.category_name""")
part("k_facts", """
    select *, least(greatest(demand, 0), order_qty * (1 - loss_rate)) as sales,
      least(greatest(demand, 0), order_qty * (1 - loss_rate)) * price - cost * order_qty as profit from plan_demand""")
part("k_outcomes", """
    select k, scenario, sum(profit) as profit,
      1 - sum(1 - greatest(0, category_demand - served) / greatest(category_demand, 1e-9)) / (select count(distinct category_name) from cat_dem) as service_loss
    from (select f.k, f.scenario, f.category_name, sum(f.sales) as served, sum(f.profit) as profit, any_value(d.category_demand) as category_demand
          from k_facts f join cat_dem d on d.scenario = f.scenario and d.category_name = f.category_name group by 1, 2, 3) group by 1, 2""")
part("k_eval", """
    select k, avg(service_loss) as service_loss, avg(profit) as expected_profit, avg(case when rn <= ceil(0.1 * n) then profit end) as lower_tail
    from (select *, row_number() over (partition by k order by profit) as rn, count(*) over (partition by k) as n from k_outcomes) group by 1""")


@dataclass
class Evaluated:
    chain: Assortment
    plans: DataFrame
    facts: DataFrame
    outcomes: DataFrame


def evaluated(spark, sf, sizes=SIZES, chain: Assortment | None = None) -> Evaluated:
    a = chain or build(spark, sf)
    prices = so.nearest_price(grid_of(a))
    plans = stage(sized_plans(a, ranked_candidates(a, prices, max(sizes)), sizes), "plans")
    chosen = plans.select(SKU, CAT, "price").distinct()
    # the response is needed at one price per planned SKU only
    shares = so.share_scenarios(a.daily, a.cand, a.target, sc.SCENARIOS).join(chosen.select(SKU), SKU, "left_semi")
    demand = so.sku_demand(shares, a.category_demand, chosen, a.cand, a.theta).withColumn(
        "_unit", F.exp("u")).select("scenario", SKU, "demand", "_unit")
    rows = plans.join(demand, SKU).withColumn("cost", F.col("predicted_cost") * F.col("_unit"))
    facts = stage(so.plan_facts(rows), "plan_facts")
    outcomes = stage(so.scenario_outcomes(facts, a.category_demand.select("scenario", CAT, "category_demand"), ["k"]), "outcomes")
    return Evaluated(a, plans, facts, outcomes)


part("chosen_size", """
    select k from k_eval where service_loss <= (select min(service_loss) from k_eval) + 1e-8
    order by 0.75 * expected_profit + 0.25 * lower_tail desc, k limit 1""")


def chosen_size(frontier):
    """The size with the best risk-adjusted profit among those of the lowest service loss, the smallest one on a tie."""
    lowest = frontier.select(F.min("service_loss")).scalar()
    return frontier.where(F.col("service_loss") <= lowest + 1e-8).select(
        F.max_by("k", F.struct("risk_adjusted", -F.col("k")))).scalar()


def frontier(spark, sf, chain: Assortment | None = None):
    """All sizes, their scores written once, and the chosen size as a scalar."""
    e = evaluated(spark, sf, SIZES, chain)
    table = stage(so.evaluate(e.outcomes, ["k"]), "frontier")
    return e, table, chosen_size(table)


def final(spark, sf, chain: Assortment | None = None) -> Evaluated:
    """The plan of the chosen size."""
    e, _, best = frontier(spark, sf, chain)
    only = lambda df: df.where(F.col("k") == best)
    return Evaluated(e.chain, only(e.plans), only(e.facts), only(e.outcomes))


@query("k10_plan_outcomes", f"select k, scenario, {fx('profit', 3)} as profit, {fx('service_loss', 5)} as service_loss from k_outcomes where k = {SIZE_SQL}")
def k10(spark, sf):
    return final(spark, sf).outcomes.select("k", "scenario", fixed("profit", 3).alias("profit"), fixed("service_loss", 5).alias("service_loss"))


@query("k11_baseline_plan", f"""
    select sku_code, category_name, place, {fx('price', 4)} as price, {fx('base_order', 4)} as order_qty from ranked where place <= {SIZE_SQL}""")
def k11(spark, sf):
    e, _, best = frontier(spark, sf)
    a = e.chain
    return ranked_candidates(a, so.nearest_price(grid_of(a)), max(SIZES)).where(F.col("place") <= best).select(
        SKU, CAT, "place", fixed("price", 4).alias("price"), fixed("base_order", 4).alias("order_qty"))


@query("k12_size_frontier", f"""
    select k, {fx('service_loss', 5)} as service_loss, {fx_cols('expected_profit', 'lower_tail', digits=3)}, {fx('0.75 * expected_profit + 0.25 * lower_tail', 3)} as risk_adjusted,
      k = (select k from chosen_size) as chosen
    from k_eval""")
def k12(spark, sf):
    _, table, best = frontier(spark, sf)
    return table.select("k", fixed("service_loss", 5).alias("service_loss"), *fixed_cols("expected_profit", "lower_tail", "risk_adjusted", digits=3),
                        (F.col("k") == best).alias("chosen"))


@query("a12_best_per_group", f"""
    select category_name, sku_code, {fx('recent_revenue')} as recent_revenue from
      (select *, row_number() over (partition by category_name order by recent_revenue desc, sku_code) as rn from cand) where rn = 1""")
def a12(spark, sf):
    daily = tables.product_day(spark, sf)
    cand = so.candidates(daily, so.target_date(daily))
    first = F.min(F.struct((-F.col("recent_revenue")).alias("less"), SKU)).alias("b")
    return cand.groupBy(CAT).agg(first).select(CAT, f"b.{SKU}", fixed(-F.col("b.less")).alias("recent_revenue"))


# The variants as (name, risk weight, elasticity scale, weight of observed days, order factor).
VARIANTS = [("baseline", 0.25, 1.0, 0.5, 1.0), ("risk_weight_0.00", 0.0, 1.0, 0.5, 1.0), ("risk_weight_0.50", 0.5, 1.0, 0.5, 1.0),
            ("elasticity_scale_0.80", 0.25, 0.8, 0.5, 1.0), ("elasticity_scale_1.20", 0.25, 1.2, 0.5, 1.0),
            ("history_weight_0.25", 0.25, 1.0, 0.25, 1.0), ("history_weight_0.75", 0.25, 1.0, 0.75, 1.0),
            ("order_factor_0.850", 0.25, 1.0, 0.5, 0.85), ("order_factor_0.925", 0.25, 1.0, 0.5, 0.925)]
part("variants", "select * from (values " + ", ".join(
    f"('{v}', {r}::double, {e}::double, {h}::double, {o}::double)" for v, r, e, h, o in VARIANTS) + ") v(variant, risk, scale, hist, factor)")
part("v_demand", """
    select v.variant, v.risk, s.scenario, s.sku_code, s.category_name, v.factor,
      s.share * d.category_demand * pow(n.price / c.reference_price, t.elasticity_used * v.scale) as demand, n.price, c.loss_rate,
      c.predicted_cost * exp(d.u) as cost
    from variants v join share_scen s on s.h = v.hist join cand_cost c on c.sku_code = s.sku_code join near n on n.sku_code = s.sku_code
    join cat_dem d on d.scenario = s.scenario and d.category_name = s.category_name join theta t on t.category_name = s.category_name""")
part("v_pick", f"""
    select variant, sku_code, factor, mean_demand / (1 - loss_rate) as base_order
    from (select *, row_number() over (partition by variant order by floor(mean_demand * 1e6 + 0.5) desc, sku_code) as place
          from (select variant, sku_code, any_value(factor) as factor, any_value(loss_rate) as loss_rate, avg(demand) as mean_demand from v_demand group by 1, 2))
    where place <= {SIZE_SQL}""")
part("v_scale", f"""
    select variant, min_by(s, rn) filter (s * base_order >= {so.MIN_ORDER}) as scale
    from (select *, (nominal * factor - {so.MIN_ORDER} * (rn - 1)) / rest as s
          from (select variant, base_order, factor, (select sum(order_qty) from base_plan where day = 0) as nominal,
                  row_number() over (partition by variant order by base_order, sku_code) as rn,
                  sum(base_order) over (partition by variant order by base_order, sku_code rows between current row and unbounded following) as rest from v_pick))
    group by 1""")
part("v_plan", f"""
    select p.variant, p.sku_code, p.factor, greatest({so.MIN_ORDER}, coalesce(s.scale, 0) * p.base_order) as order_qty from v_pick p join v_scale s using (variant)""")
part("v_outcomes", """
    select variant, scenario, any_value(risk) as risk, sum(profit) as profit,
      1 - sum(1 - greatest(0, category_demand - served) / greatest(category_demand, 1e-9)) / (select count(distinct category_name) from cat_dem) as service_loss
    from (select d.variant, d.scenario, d.category_name, any_value(d.risk) as risk, sum(least(d.demand, p.order_qty * (1 - d.loss_rate))) as served,
            sum(least(d.demand, p.order_qty * (1 - d.loss_rate)) * d.price - d.cost * p.order_qty) as profit, any_value(c.category_demand) as category_demand
          from v_demand d join v_plan p on p.variant = d.variant and p.sku_code = d.sku_code
          join cat_dem c on c.scenario = d.scenario and c.category_name = d.category_name group by 1, 2, 3) group by 1, 2""")
part("v_eval", """
    select variant, avg(service_loss) as service_loss, avg(profit) as expected_profit, avg(case when rn <= ceil(0.1 * n) then profit end) as lower_tail, any_value(risk) as risk
    from (select *, row_number() over (partition by variant order by profit) as rn, count(*) over (partition by variant) as n from v_outcomes) group by 1""")


@query("k13_plan_sensitivity", f"""
    select e.variant, {fx('e.service_loss', 5)} as service_loss, {fx_cols('expected_profit', 'lower_tail', digits=3)},
      {fx('(1 - risk) * expected_profit + risk * lower_tail', 3)} as risk_adjusted, {fx('j.jaccard', 5)} as jaccard, {fx('j.total', 4)} as total_order,
      {fx('j.nominal * (1 - 0.0005)', 4)} as band_low, {fx('j.nominal * (1 + 0.0005)', 4)} as band_high,
      j.total between j.nominal * (1 - 0.0005) and j.nominal * (1 + 0.0005) as inside
    from v_eval e join (select v.variant, sum(v.order_qty) as total, any_value(v.factor) * (select sum(order_qty) from base_plan where day = 0) as nominal,
        count(b.sku_code) / cast(count(*) + (select count(*) from v_plan where variant = 'baseline') - count(b.sku_code) as double) as jaccard
      from v_plan v left join (select sku_code from v_plan where variant = 'baseline') b on b.sku_code = v.sku_code group by 1) j on j.variant = e.variant""")
def k13(spark, sf):
    e, _, best = frontier(spark, sf)
    return sensitivity(e.chain, best)


def sensitivity(a: Assortment, size) -> DataFrame:
    """Every variant plans `size` products and orders inside its own band around factor x the nominal order."""
    prices = so.nearest_price(grid_of(a))
    shares = so.share_scenarios(a.daily, a.cand, a.target, sc.SCENARIOS, weights=[0.25, 0.5, 0.75])
    table = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(r).alias("risk"), F.lit(e).alias("scale"), F.lit(h).alias("h"),
                               F.lit(o).alias("factor")) for v, r, e, h, o in VARIANTS])
    per = shares.withColumn("v", F.explode(F.filter(table, lambda x: x["h"] == F.col("h")))).select("*", "v.variant", "v.risk", "v.scale", "v.factor")
    demand = so.sku_demand(per.drop("h", "v"), a.category_demand, a.cand.select(SKU, CAT).join(prices, SKU), a.cand, a.theta, F.col("scale"))
    demand = stage(demand.join(a.cand.select(SKU, "loss_rate", "predicted_cost"), SKU).withColumn(
        "cost", F.col("predicted_cost") * F.exp("u")), "variant_demand")
    means = demand.groupBy("variant", "risk", "factor", SKU, "loss_rate").agg(F.avg("demand").alias("mean_demand"))
    place = F.row_number().over(Window.partitionBy("variant").orderBy(F.desc(fixed("mean_demand")), SKU))
    nominal = a.nominal_order.select("nominal").scalar()
    picked = means.withColumn("place", place).where(F.col("place") <= size).select(
        "variant", SKU, "factor", (F.col("mean_demand") / (1 - F.col("loss_rate"))).alias("base_order"), (nominal * F.col("factor")).alias("total"))
    plan = stage(so.fill_band(picked, ["variant"]), "variant_plan")
    facts = so.plan_facts(demand.join(plan.select("variant", SKU, "order_qty"), ["variant", SKU]))
    outcomes = so.scenario_outcomes(facts, a.category_demand.select("scenario", CAT, "category_demand"), ["variant", "risk"])
    scored = so.evaluate(outcomes, ["variant", "risk"], F.col("risk"))
    base = plan.where(F.col("variant") == "baseline").select(SKU)
    copies = base.withColumn("variant", F.explode(F.array(*[F.lit(v[0]) for v in VARIANTS])))
    overlap = network.set_overlap(plan, copies, [SKU], ["variant"])
    orders = plan.groupBy("variant").agg(F.sum("order_qty").alias("total_order"), F.first("total").alias("total"))
    orders = orders.withColumns({"band_low": F.col("total") * (1 - so.BAND), "band_high": F.col("total") * (1 + so.BAND)})
    return scored.join(overlap.select("variant", "jaccard"), "variant").join(orders, "variant").select(
        "variant", fixed("service_loss", 5).alias("service_loss"), *fixed_cols("expected_profit", "lower_tail", "risk_adjusted", digits=3),
        fixed("jaccard", 5).alias("jaccard"), *fixed_cols("total_order", "band_low", "band_high", digits=4),
        F.col("total_order").between(F.col("band_low"), F.col("band_high")).alias("inside"))


part("reps", """
    select scenario, place from (select scenario, row_number() over (order by floor(total * 1e6 + 0.5), scenario) - 1 as place, count(*) over () as n
      from (select scenario, sum(category_demand) as total from cat_dem group by 1))
    where place in (select cast(round_even(i * 599 / 59.0, 0) as bigint) from (select unnest(range(0, 60)) as i))""")


@query("w15_representatives", "select scenario, cast(place as integer) as place from reps")
def w15(spark, sf):
    a = build(spark, sf)
    return so.representatives(a.category_demand, 60)


part("folds6", f"""
    select scenario, profit, service_loss, cast(i // 100 + 1 as bigint) as fold
    from (select *, row_number() over (order by scenario) - 1 as i from k_outcomes where k = {SIZE_SQL})""")


@query("w14_scenario_folds", f"""
    select fold, count(*) as scenario_count, {fx('1 - avg(service_loss)', 5)} as satisfaction, {fx('avg(profit)', 3)} as expected_profit,
      {fx('avg(case when rn <= ceil(0.1 * n) then profit end)', 3)} as lower_tail
    from (select *, row_number() over (partition by fold order by profit) as rn, count(*) over (partition by fold) as n from folds6) group by 1""")
def w14(spark, sf):
    folded = so.contiguous_folds(final(spark, sf).outcomes, "scenario")
    return so.evaluate(folded, ["fold"]).join(folded.groupBy("fold").agg(F.count(F.lit(1)).alias("scenario_count")), "fold").select(
        "fold", "scenario_count", fixed(1 - F.col("service_loss"), 5).alias("satisfaction"),
        *fixed_cols("expected_profit", "lower_tail", digits=3))


@query("k14_generalization", f"""
    select {fx('f.l', 5)} as full_loss, {fx('r.l', 5)} as representative_loss, {fx('abs(f.l - r.l)', 5)} as gap, abs(f.l - r.l) <= 0.03 as gap_passed,
      {fx('s.sd', 5)} as fold_std, s.sd <= 0.05 as fold_passed
    from (select avg(service_loss) as l from k_outcomes where k = {SIZE_SQL}) f,
      (select avg(service_loss) as l from k_outcomes where k = {SIZE_SQL} and scenario in (select scenario from reps)) r,
      (select stddev_samp(m) as sd from (select fold, 1 - avg(service_loss) as m from folds6 group by 1)) s""")
def k14(spark, sf):
    e = final(spark, sf)
    chosen = so.representatives(e.chain.category_demand, 60).withColumn("_rep", F.lit(True))
    base = so.contiguous_folds(e.outcomes, "scenario").join(chosen.select("scenario", "_rep"), "scenario", "left")
    folds = base.groupBy("fold").agg(F.avg("service_loss").alias("m"))
    one = base.agg(F.avg("service_loss").alias("f"), F.avg(F.when(F.col("_rep"), F.col("service_loss"))).alias("r"))
    out = one.withColumn("sd", folds.select(F.stddev_samp("m")).scalar()).withColumn("g", F.abs(F.col("f") - F.col("r")))
    return out.select(fixed("f", 5).alias("full_loss"), fixed("r", 5).alias("representative_loss"), fixed("g", 5).alias("gap"),
                      (F.col("g") <= 0.03).alias("gap_passed"), fixed("sd", 5).alias("fold_std"), (F.col("sd") <= 0.05).alias("fold_passed"))


@query("k15_final_plan", f"""
    select sku_code, any_value(category_name) as category_name, {fx('any_value(price)', 4)} as price, {fx('any_value(order_qty)', 4)} as order_qty,
      {fx('avg(demand)', 4)} as expected_demand, {fx('avg(sales)', 4)} as expected_sales, {fx('avg(profit)', 4)} as expected_profit,
      {fx('avg(case when rn <= ceil(0.1 * n) then profit end)', 4)} as lower_tail,
      {fx('avg(case when demand > order_qty * (1 - loss_rate) + 1e-9 then 1.0 else 0.0 end)', 4)} as stockout_probability
    from (select *, row_number() over (partition by sku_code order by profit) as rn, count(*) over (partition by sku_code) as n from k_facts where k = {SIZE_SQL}) group by 1""")
def k15(spark, sf):
    facts = final(spark, sf).facts
    names = ["price", "order_qty", "expected_demand", "expected_sales", "expected_profit", "lower_tail", "stockout_probability"]
    return facts.groupBy(SKU).agg(
        F.first(CAT).alias(CAT), F.first("price").alias("price"), F.first("order_qty").alias("order_qty"),
        F.avg("demand").alias("expected_demand"), F.avg("sales").alias("expected_sales"), F.avg("profit").alias("expected_profit"),
        sc.tail_mean("profit").alias("lower_tail"),
        F.avg(F.when(sc.is_stockout("demand", "available"), 1.0).otherwise(0.0)).alias("stockout_probability")).select(
        SKU, CAT, *fixed_cols(*names, digits=4))


@query("p13_order_band", f"""
    select k, {fx('total', 4)} as total, {fx('nominal * (1 - 0.0005)', 4)} as band_low, {fx('nominal * (1 + 0.0005)', 4)} as band_high,
      total between nominal * (1 - 0.0005) and nominal * (1 + 0.0005) as inside
    from (select k, sum(order_qty) as total, (select sum(order_qty) from base_plan where day = 0) as nominal from k_plans group by 1)""")
def p13(spark, sf):
    a = build(spark, sf)
    plans = sized_plans(a, ranked_candidates(a, so.nearest_price(grid_of(a)), max(SIZES)), SIZES)
    nominal = a.nominal_order.select("nominal").scalar()
    out = plans.groupBy("k").agg(F.sum("order_qty").alias("total")).withColumn("low", nominal * (1 - so.BAND)).withColumn("high", nominal * (1 + so.BAND))
    return out.select("k", fixed("total", 4).alias("total"), fixed("low", 4).alias("band_low"), fixed("high", 4).alias("band_high"),
                      F.col("total").between(F.col("low"), F.col("high")).alias("inside"))


@query("a13_category_summary", f"""
    select d.category_name, (select count(*) from cand c where c.category_name = d.category_name) as candidates, coalesce(max(f.n), 0) as selected,
      {fx('avg(d.category_demand)', 4)} as expected_demand, {fx('avg(coalesce(f.sales, 0))', 4)} as expected_sales,
      {fx('avg(greatest(0, d.category_demand - coalesce(f.sales, 0)))', 4)} as expected_unmet,
      {fx('1 - avg(greatest(0, d.category_demand - coalesce(f.sales, 0)) / greatest(d.category_demand, 1e-9))', 5)} as satisfaction,
      {fx('coalesce(max(f.orders), 0)', 4)} as order_qty, {fx('avg(coalesce(f.profit, 0))', 4)} as expected_profit
    from cat_dem d left join (select scenario, category_name, count(*) as n, sum(sales) as sales, sum(order_qty) as orders, sum(profit) as profit
      from k_facts where k = {SIZE_SQL} group by 1, 2) f on f.scenario = d.scenario and f.category_name = d.category_name group by 1""")
def a13(spark, sf):
    e = final(spark, sf)
    per = e.facts.groupBy("scenario", CAT).agg(F.count(F.lit(1)).alias("n"), F.sum("sales").alias("sales"),
                                               F.sum("order_qty").alias("orders"), F.sum("profit").alias("profit"))
    full = e.chain.category_demand.join(per, ["scenario", CAT], "left").na.fill(0)
    unmet = F.greatest(F.lit(0.0), F.col("category_demand") - F.col("sales"))
    out = full.groupBy(CAT).agg(
        F.max("n").alias("selected"), F.avg("category_demand").alias("expected_demand"), F.avg("sales").alias("expected_sales"),
        F.avg(unmet).alias("expected_unmet"), (1 - F.avg(unmet / F.greatest(F.col("category_demand"), F.lit(1e-9)))).alias("satisfaction"),
        F.max("orders").alias("order_qty"), F.avg("profit").alias("expected_profit"))
    sizes = e.chain.cand.groupBy(CAT).agg(F.count(F.lit(1)).alias("candidates"))
    return out.join(sizes, CAT).select(CAT, "candidates", "selected", *fixed_cols("expected_demand", "expected_sales", "expected_unmet", digits=4),
                                       fixed("satisfaction", 5).alias("satisfaction"), *fixed_cols("order_qty", "expected_profit", digits=4))


@query("k16_candidate_diagnostics", """
    select a.included, count(*) as candidates, (select count(*) from product_index_pairs where source in (select sku_code from cand) and target in (select sku_code from cand)) as pairs_covered,
      (select count_if(abs(r) >= 0.3) from product_index_pairs where source in (select sku_code from cand) and target in (select sku_code from cand)) as strong_pairs
    from cand c left join (select sku_code, count_if(gross_sales_qty > 0) >= 90 and sum(gross_sales_qty) >= 100 as included from product_day group by 1) a
      on a.sku_code = c.sku_code group by 1""")
def k16(spark, sf):
    daily = tables.product_day(spark, sf)
    cand = stage(so.candidates(daily, so.target_date(daily)).select(SKU), "candidates")
    active = profile.activity(daily, SKU, QTY, min_span=0).select(SKU, "included")
    found = product_index_pairs(spark, sf)
    side = lambda name: cand.select(F.col(SKU).alias(name))
    covered = found.join(side("source"), "source", "left_semi").join(side("target"), "target", "left_semi")
    counts = stage(covered.agg(F.count(F.lit(1)).alias("pairs_covered"), F.count_if(F.abs("r") >= 0.3).alias("strong_pairs")), "counts")
    out = cand.join(active, SKU, "left").groupBy("included").agg(F.count(F.lit(1)).alias("candidates"))
    return out.select("included", "candidates", counts.select("pairs_covered").scalar().alias("pairs_covered"),
                      counts.select("strong_pairs").scalar().alias("strong_pairs"))
