"""SKU candidates, shares, price grids, and assortment plans judged on scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greengrain.functions.exprs import clip, draw, elastic_response, fixed, markup, ratio, tenth, tenth_down, tenth_up
from greengrain.functions.ordered import weighted_quantiles
from greengrain.operators.scenario import RISK, tail_mean

CAT, SKU, QTY = "category_name", "sku_code", "gross_sales_qty"
MIN_ORDER = 2.5
BAND = 0.0005
KAPPAS = (0.0, 2.5, 5.0, 10.0, 20.0, 40.0, 80.0)
GRID_PROBS = {"q10": 0.10, "q30": 0.30, "q50": 0.50, "q70": 0.70, "q90": 0.90}


def target_date(daily: DataFrame) -> Column:
    """The day after the last day of the table, as a scalar."""
    return daily.select(F.date_add(F.max("date"), 1)).scalar()


def candidates(daily: DataFrame, target: Column, days: int = 7) -> DataFrame:
    """SKUs sold in the last days: volume, reference price, latest cost and loss fraction."""
    recent = daily.where(F.col("date").between(F.date_sub(target, days), F.date_sub(target, 1)) & (F.col(QTY) > 0))
    return recent.groupBy(SKU).agg(
        F.max_by(CAT, "date").alias(CAT), F.sum(QTY).alias("recent_qty"), F.count(F.lit(1)).alias("recent_days"),
        F.sum("gross_revenue").alias("recent_revenue"),
        ratio(F.sum("gross_revenue"), F.sum(QTY)).alias("reference_price"),
        F.max_by("wholesale_price", "date").alias("latest_cost"),
        (ratio(F.sum(F.col("loss_rate_pct") * F.col(QTY)), F.sum(QTY)) / 100.0).alias("loss_rate"))


def latest_price(daily: DataFrame, target: Column, value: str, days: int) -> DataFrame:
    """Last known value of each SKU inside the window."""
    window = daily.where(F.col("date").between(F.date_sub(target, days), F.date_sub(target, 1)) & F.col(value).isNotNull())
    return window.groupBy(SKU).agg(F.max_by(value, "date").alias("latest"), F.max("date").alias("latest_date"))


def predicted_cost(cand: DataFrame, daily: DataFrame, target: Column, forecast: DataFrame, days: int = 7) -> DataFrame:
    """Scale each SKU's latest cost by its category's forecast against the category's recent cost."""
    week = daily.where(F.col("date").between(F.date_sub(target, days), F.date_sub(target, 1)) & (F.col(QTY) > 0))
    recent = week.groupBy(CAT).agg(ratio(F.sum(F.col(QTY) * F.col("wholesale_price")), F.sum(QTY)).alias("recent_cost"))
    return (cand.join(recent, CAT).join(forecast.select(CAT, "cost_future"), CAT)
            .withColumn("predicted_cost", F.col("latest_cost") * F.col("cost_future") / F.col("recent_cost"))
            .drop("recent_cost", "cost_future"))


def comparable(target: Column, back: int = 1095) -> Column:
    """Same weekday as the target, from `back` to 8 days before it."""
    return (F.col("date").between(F.date_sub(target, back), F.date_sub(target, 8))
            & (F.weekday("date") == F.weekday(target)))


def normalized(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """value / its total over `keys`, or equal parts when the total is 0.

    Totals are aggregated and joined back, so a hot key is never gathered in one task.
    """
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"), F.count(F.lit(1)).alias("_n"))
    return (df.join(totals, keys)
            .withColumn(name, F.when(F.col("_total") > 0, F.col(value) / F.col("_total")).otherwise(1.0 / F.col("_n")))
            .drop("_total", "_n"))


def base_shares(daily: DataFrame, cand: DataFrame, target: Column) -> DataFrame:
    """Recent and long-run shares of each candidate inside its category."""
    recent = F.col("date").between(F.date_sub(target, 7), F.date_sub(target, 1))
    seen = daily.join(cand.select(SKU), SKU, "left_semi").groupBy(SKU).agg(
        F.sum(F.when(recent, F.greatest(F.col(QTY), F.lit(0.0)))).alias("_recent"),
        F.sum(F.when(comparable(target), F.greatest(F.col(QTY), F.lit(0.0)))).alias("_long"))
    full = cand.select(SKU, CAT).join(seen, SKU, "left").na.fill(0.0)
    full = normalized(full, [CAT], "_recent", "recent_share")
    return normalized(full, [CAT], "_long", "long_share").select(
        SKU, CAT, F.col("_recent").alias("share_qty"), "recent_share", "long_share")


def validation_rows(daily: DataFrame, cand: DataFrame, target: Column, weeks: int = 12) -> DataFrame:
    """Quantities that each validation day sees: itself, its last 7 days, and its year of same weekdays.

    Validation days are the target's weekday in the last `weeks` weeks. The interval join is
    turned round: each fact row is expanded to the few validation days it can serve.
    """
    facts = daily.join(cand.select(SKU), SKU, "left_semi").where(
        F.col("date").between(F.date_sub(target, 7 * weeks + 365), F.date_sub(target, 1)))
    day = F.explode(F.sequence(F.date_sub(target, 7 * weeks), F.date_sub(target, 7), F.expr("interval 7 day")))
    seen = facts.select(SKU, CAT, "date", F.greatest(F.col(QTY), F.lit(0.0)).alias("q"), day.alias("valid_date"))
    gap = F.datediff("valid_date", "date")
    recent, prior = gap.between(1, 7), gap.between(8, 365) & (F.weekday("date") == F.weekday("valid_date"))
    return seen.where((gap == 0) | recent | prior).groupBy(CAT, "valid_date", SKU).agg(
        F.sum(F.when(gap == 0, F.col("q")).otherwise(0.0)).alias("observed"),
        F.sum(F.when(recent, F.col("q")).otherwise(0.0)).alias("recent"),
        F.sum(F.when(prior, F.col("q")).otherwise(0.0)).alias("prior"), F.count_if(prior).alias("prior_rows"))


def select_kappa(rows: DataFrame, cand: DataFrame, min_records: int = 3, default: float = 10.0) -> DataFrame:
    """Shrinkage strength per category with the lowest weighted one-day log loss."""
    totals = rows.groupBy(CAT, "valid_date").agg(
        F.sum("observed").alias("o_all"), F.sum("recent").alias("r_all"), F.sum("prior").alias("p_all"),
        F.sum("prior_rows").alias("p_rows"))
    size = cand.groupBy(CAT).agg(F.count(F.lit(1)).alias("n_skus"))
    usable = totals.where((F.col("o_all") > 0) & (F.col("p_rows") > 0)).join(size, CAT)
    scored = rows.where(F.col("observed") > 0).join(usable, [CAT, "valid_date"])
    prior = F.when(F.col("p_all") > 0, F.col("prior") / F.col("p_all")).otherwise(1.0 / F.col("n_skus"))
    scored = scored.withColumn("_prior", prior).withColumn("kappa", F.explode(F.array(*[F.lit(k) for k in KAPPAS])))
    posterior = F.coalesce((F.col("recent") + F.col("kappa") * F.col("_prior"))
                           / F.nullif(F.col("r_all") + F.col("kappa"), F.lit(0.0)), F.col("_prior"))
    # weight o_all times share observed / o_all leaves the observed quantity
    loss = -F.col("observed") * F.log(F.greatest(posterior, F.lit(1e-12)))
    weight = usable.groupBy(CAT).agg(F.sum("o_all").alias("_weight"), F.count(F.lit(1)).alias("records"))
    scores = scored.groupBy(CAT, "kappa").agg(F.sum(loss).alias("_loss")).join(weight, CAT)
    best = scores.groupBy(CAT, "records").agg(
        F.min(F.struct(fixed(F.col("_loss") / F.col("_weight"), 9).alias("score"), "kappa")).alias("b"))
    return size.select(CAT).join(best, CAT, "left").select(
        CAT, F.coalesce("records", F.lit(0)).alias("records"),
        F.when(F.col("records") >= min_records, F.col("b.kappa")).otherwise(F.lit(default)).alias("kappa"))


def posterior_shares(shares: DataFrame, kappas: DataFrame) -> DataFrame:
    """Recent quantities shrunk toward the long-run share, adding up to 1 per category."""
    joined = shares.join(kappas.select(CAT, "kappa"), CAT)
    totals = joined.groupBy(CAT).agg(F.sum("share_qty").alias("_recent"))
    raw = joined.join(totals, CAT).withColumn("_raw", F.coalesce(
        (F.col("share_qty") + F.col("kappa") * F.col("long_share")) / F.nullif(F.col("_recent") + F.col("kappa"), F.lit(0.0)),
        F.col("long_share")))
    return normalized(raw, [CAT], "_raw", "eb_share").drop("_raw", "_recent")


def share_scenarios(daily: DataFrame, shares: DataFrame, target: Column, scenarios: int, weights: list[float] = (0.5,),
                    seed: int = 2023) -> DataFrame:
    """Draw whole comparable days and mix their shares with the posterior, one block per weight."""
    pool = (daily.join(shares.select(SKU), SKU, "left_semi").where(comparable(target))
            .groupBy("date", SKU, CAT).agg(F.sum(F.greatest(F.col(QTY), F.lit(0.0))).alias("q")))
    by_date = Window.partitionBy(F.lit(1)).orderBy("date")  # at most one row per comparable day
    dates = pool.select("date").distinct().withColumn("date_no", F.row_number().over(by_date) - 1)
    count = dates.select(F.count(F.lit(1))).scalar()
    drawn = daily.sparkSession.range(scenarios).select(
        F.col("id").alias("scenario"), (draw(seed, F.lit("share"), F.col("id")) % count).alias("date_no")).join(dates, "date_no")
    sizes = shares.groupBy(CAT).agg(F.count(F.lit(1)).alias("n_skus"))
    day_totals = pool.groupBy("date", CAT).agg(F.sum("q").alias("day_qty"))
    # the observed part is sparse; candidates missing on a drawn day keep only their posterior part
    spread = shares.join(sizes, CAT).select(SKU, CAT, "eb_share", "n_skus")
    rows = _every_scenario(drawn, spread)
    mixed = (rows.join(day_totals, ["date", CAT], "left").join(pool, ["date", SKU, CAT], "left")
             .withColumn("_obs", F.when(F.col("day_qty") > 0, F.coalesce("q", F.lit(0.0)) / F.col("day_qty"))
                         .otherwise(1.0 / F.col("n_skus")))
             .withColumn("h", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
             .withColumn("_mixed", F.col("h") * F.col("_obs") + (1 - F.col("h")) * F.col("eb_share")))
    return normalized(mixed, ["h", "scenario", CAT], "_mixed", "share").select("h", "scenario", SKU, CAT, "share")


def _every_scenario(drawn: DataFrame, spread: DataFrame) -> DataFrame:
    """Every candidate in every scenario: the drawn dates travel as one array of parameter size."""
    packed = drawn.agg(F.collect_list(F.struct("scenario", "date"))).scalar()
    return (spread.withColumn("d", F.explode(packed))
            .select(SKU, CAT, "eb_share", "n_skus", F.col("d.scenario").alias("scenario"), F.col("d.date").alias("date")))


def price_grid(daily: DataFrame, priced: DataFrame, bounds: DataFrame, target: Column, min_days: int = 30,
               min_prices: int = 5, days: int = 365) -> DataFrame:
    """Price choices per candidate at observed markup quantiles, in steps of 0.1.

    Sparse SKUs use the quantiles of their category; fewer than three distinct prices fall
    back to the low, reference and high markup of the category.
    """
    hist = daily.where(F.col("date").between(F.date_sub(target, days), F.date_sub(target, 1)) & (F.col(QTY) > 0)
                       & (F.col("gross_weighted_avg_price") > 0) & (F.col("wholesale_price") > 0)).select(
        SKU, CAT, "date", F.col(QTY).alias("w"), F.col("gross_weighted_avg_price").alias("p"),
        markup("gross_weighted_avg_price", "wholesale_price").alias("m"))
    per_sku = hist.groupBy(SKU).agg(F.count_distinct("date").alias("history_days"),
                                    F.count_distinct("p").alias("history_prices"))
    own = weighted_quantiles(hist.join(priced.select(SKU), SKU, "left_semi"), [SKU], "m", "w", ["date", SKU], GRID_PROBS)
    whole = weighted_quantiles(hist, [CAT], "m", "w", ["date", SKU], GRID_PROBS)
    pack = lambda df, key, name: df.select(key, F.array(*GRID_PROBS).alias(name))
    rows = (priced.select(SKU, CAT, "predicted_cost").join(per_sku, SKU, "left").join(pack(own, SKU, "_own"), SKU, "left")
            .join(pack(whole, CAT, "_cat"), CAT).join(bounds.select(CAT, "markup_low", "markup_reference", "markup_high"), CAT))
    rows = rows.na.fill({"history_days": 0, "history_prices": 0})
    enough = (F.col("history_days") >= min_days) & (F.col("history_prices") >= min_prices)
    rows = rows.withColumn("grid_source", F.when(enough, "sku_history").otherwise("category_fallback"))
    rows = rows.withColumn("_m", F.when(enough, F.col("_own")).otherwise(F.col("_cat")))
    cost, low, high = F.col("predicted_cost"), F.col("markup_low"), F.col("markup_high")
    rows = rows.withColumn("_lo", tenth_up(cost * (1 + low))).withColumn("_hi", tenth_down(cost * (1 + high)))
    middle = tenth(cost * (1 + (low + high) / 2))
    crossed = F.col("_hi") < F.col("_lo")
    rows = rows.withColumn("_a", F.when(crossed, middle).otherwise(F.col("_lo"))).withColumn(
        "_b", F.when(crossed, middle).otherwise(F.col("_hi")))
    price = lambda m: F.least(F.greatest(tenth(cost * (1 + F.least(F.greatest(m, low), high))), F.col("_a")), F.col("_b"))
    first = F.array_distinct(F.transform("_m", price))
    backup = F.array_distinct(F.array(price(low), price(F.col("markup_reference")), price(high)))
    rows = rows.withColumn("_prices", F.when(F.size(first) >= 3, first).otherwise(backup))
    out = rows.select(SKU, CAT, "predicted_cost", "grid_source", "history_days", "history_prices",
                      F.posexplode("_prices").alias("_pos", "price"))
    return out.withColumn("price_level", F.col("_pos") + 1).withColumn(
        "markup", F.col("price") / F.col("predicted_cost") - 1).drop("_pos")


def nearest_price(grid: DataFrame) -> DataFrame:
    """The grid price nearest to the SKU's median grid price; the lower level on a tie."""
    middle = grid.groupBy(SKU).agg(F.percentile("price", F.lit(0.5)).alias("_median"))
    return grid.join(middle, SKU).groupBy(SKU).agg(F.min_by(
        F.struct("price", "price_level"),
        F.struct(fixed(F.abs(F.col("price") - F.col("_median"))).alias("gap"), "price_level")).alias("b")).select(
        SKU, F.col("b.price").alias("price"), F.col("b.price_level").alias("price_level"))


def sku_demand(share_rows: DataFrame, category_demand: DataFrame, prices: DataFrame, cand: DataFrame,
               theta: DataFrame, scale: Column | float = 1.0) -> DataFrame:
    """Demand per scenario and price row: share x category demand x price response."""
    s = scale if isinstance(scale, Column) else F.lit(scale)
    table = prices.join(cand.select(SKU, "reference_price"), SKU).join(theta.select(CAT, "elasticity_used"), CAT)
    response = elastic_response("price", "reference_price", F.col("elasticity_used") * s)
    return (share_rows.join(table, [SKU, CAT]).join(category_demand, ["scenario", CAT])
            .withColumn("demand", F.col("share") * F.col("category_demand") * response)
            .drop("reference_price", "elasticity_used"))


def order_upper(demand: DataFrame, cand: DataFrame, safety: float = 1.20, minimum: float = MIN_ORDER) -> DataFrame:
    """Largest sensible order per SKU from the top demand over its prices in each scenario."""
    top = demand.groupBy(SKU, "scenario").agg(F.max("demand").alias("d"))
    high = top.groupBy(SKU).agg(F.percentile("d", F.lit(0.99)).alias("p99"))
    return high.join(cand.select(SKU, "loss_rate"), SKU).select(
        SKU, F.greatest(F.lit(minimum), F.lit(safety) * F.col("p99") / (1 - F.col("loss_rate"))).alias("order_upper"))


def top_sellers(cand: DataFrame, k: int, by: list[Column]) -> DataFrame:
    """The k best candidates with their place; limit() keeps k rows per task before ordering."""
    best = cand.orderBy(*by, SKU).limit(k)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by, SKU)))


def fill_band(plan: DataFrame, keys: list[str], minimum: float = MIN_ORDER) -> DataFrame:
    """Orders in proportion to base_order that add up to `total`, none below the minimum.

    Small orders take the minimum and the rest is shared by the others: in rising order, the first row whose scaled
    order reaches the minimum starts those that are scaled. A plan has at most as many rows as products. Where even
    minimum orders exceed the total, all of them stay at the minimum.
    """
    rising = Window.partitionBy(*keys).orderBy("base_order", SKU)
    rest = F.sum("base_order").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = plan.withColumn("_rn", F.row_number().over(rising)).withColumn(
        "_s", (F.col("total") - F.lit(minimum) * (F.col("_rn") - 1)) / rest)
    reaches = F.when(F.col("_s") * F.col("base_order") >= minimum, F.col("_rn"))
    scale = F.coalesce(F.min_by("_s", reaches).over(Window.partitionBy(*keys)), F.lit(0.0))
    return rows.withColumn("order_qty", F.greatest(F.lit(minimum), scale * F.col("base_order"))).drop("_rn", "_s")


def plan_facts(demand: DataFrame) -> DataFrame:
    """Sales and profit of scenario rows with demand, cost, price, order_qty and loss_rate."""
    out = demand.withColumn("available", F.col("order_qty") * (1 - F.col("loss_rate")))
    out = out.withColumn("sales", F.least(F.greatest(F.col("demand"), F.lit(0.0)), F.col("available")))
    return out.withColumn("profit", F.col("sales") * F.col("price") - F.col("cost") * F.col("order_qty"))


def scenario_outcomes(facts: DataFrame, category_demand: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Profit and service loss per scenario: unmet share of demand, averaged over all categories.

    Categories without a planned SKU count as fully unmet.
    """
    served = facts.groupBy(*keys, "scenario", CAT).agg(F.sum("sales").alias("served"), F.sum("profit").alias("profit"))
    categories = category_demand.select(F.count_distinct(CAT)).scalar()
    both = served.join(category_demand, ["scenario", CAT])
    met = 1 - F.greatest(F.lit(0.0), F.col("category_demand") - F.col("served")) / F.greatest(F.col("category_demand"), F.lit(1e-9))
    return both.groupBy(*keys, "scenario").agg(
        F.sum("profit").alias("profit"), F.sum(met).alias("_met")).select(
        *keys, "scenario", "profit", (1 - F.col("_met") / categories).alias("service_loss"))


def evaluate(outcomes: DataFrame, keys: list[str] = (), risk: Column | float = RISK) -> DataFrame:
    r = risk if isinstance(risk, Column) else F.lit(risk)
    aggs = [F.avg("service_loss").alias("service_loss"), F.avg("profit").alias("expected_profit"),
            tail_mean("profit").alias("lower_tail")]
    out = outcomes.groupBy(*keys).agg(*aggs) if keys else outcomes.agg(*aggs)
    return out.withColumn("risk_adjusted", (1 - r) * F.col("expected_profit") + r * F.col("lower_tail"))


def representatives(category_demand: DataFrame, count: int) -> DataFrame:
    """Scenarios at evenly spaced places of total demand, both ends included."""
    totals = category_demand.groupBy("scenario").agg(F.sum("category_demand").alias("total"))
    one = Window.partitionBy(F.lit(1))  # one row per scenario
    placed = totals.withColumn("place", F.row_number().over(one.orderBy(fixed("total"), "scenario")) - 1)
    placed = placed.withColumn("n", F.count(F.lit(1)).over(one))
    wanted = F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda i: F.bround(i * (F.col("n") - 1) / F.lit(max(1, count - 1)), 0).cast("int")))
    return placed.where(F.array_contains(wanted, F.col("place").cast("int"))).select("scenario", "place")


def contiguous_folds(df: DataFrame, order: str, folds: int = 6) -> DataFrame:
    """Fold 1..folds over consecutive positions; the first folds take the remainder."""
    one = Window.partitionBy(F.lit(1))  # one row per scenario
    out = df.withColumn("_i", F.row_number().over(one.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(one))
    small, extra = F.floor(F.col("_n") / folds), F.col("_n") % folds
    head = extra * (small + 1)
    fold = F.when(F.col("_i") < head, F.floor(F.col("_i") / (small + 1))).otherwise(extra + F.floor((F.col("_i") - head) / small))
    return out.withColumn("fold", fold + 1).drop("_i", "_n")
