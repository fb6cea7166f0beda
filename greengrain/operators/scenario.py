"""Jointly resampled scenarios and the accounting of price and order plans on them.

Scenario tables are long: (scenario, day, category). Their size is scenarios x days x
categories, set by parameters and by the number of categories, not by the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greengrain.functions.exprs import clip, draw, fixed, level_from_log
from greengrain.operators.calendar import winsorized
from greengrain.operators.elasticity import CAT, SEED
from greengrain.operators.pairs import pearson

SCENARIOS = 600
DAYS = 7
TAIL = 0.10
GOODWILL = 0.10
PENALTY = 80.0
RISK = 0.25


def is_stockout(demand: str, available: str) -> Column:
    """An order made from a demand value gives that value back only up to rounding: not a stock-out."""
    return F.col(demand) > F.col(available) + 1e-9


def tail_mean(value: Column | str, p: float = TAIL) -> Column:
    """Mean of the worst ceil(p n) values of a group of scenarios (its size is the scenario count)."""
    v = F.col(value) if isinstance(value, str) else value
    ordered = F.array_sort(F.collect_list(v))
    k = F.greatest(F.lit(1), F.ceil(F.count(v) * F.lit(p))).cast("int")
    return F.aggregate(F.slice(ordered, F.lit(1), k), F.lit(0.0), lambda s, x: s + x) / k


def residual_pool(state: DataFrame) -> DataFrame:
    """Dates on which every category has both residuals, winsorized and centered per category."""
    known = state.where(F.col("demand_residual").isNotNull() & F.col("cost_residual").isNotNull())
    categories = state.select(F.count_distinct(CAT)).scalar()
    dates = known.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == categories)
    common = known.join(dates.select("date"), "date", "left_semi").select(CAT, "date", "demand_residual", "cost_residual")
    return winsorized(common, CAT, {"demand_residual": "e", "cost_residual": "u"}).select(CAT, "date", "e", "u")


def week_starts(pool: DataFrame, days: int = DAYS) -> DataFrame:
    """Numbered first dates of complete runs of `days` consecutive dates.

    The windows run over the distinct dates of the pool, at most one row per calendar day.
    """
    by_date = Window.partitionBy(F.lit(1)).orderBy("date")
    dates = pool.select("date").distinct().withColumn("_end", F.lead("date", days - 1).over(by_date))
    whole = dates.where(F.datediff("_end", "date") == days - 1)
    return whole.select("date", (F.row_number().over(by_date) - 1).alias("start_no"))


def draw_weeks(pool: DataFrame, scenarios: int = SCENARIOS, days: int = DAYS, seed: int = SEED) -> DataFrame:
    """Draw whole weeks with replacement; all categories of a day stay together."""
    starts = week_starts(pool, days)
    count = starts.select(F.count(F.lit(1))).scalar()
    drawn = pool.sparkSession.range(scenarios).select(
        F.col("id").alias("scenario"), (draw(seed, F.col("id")) % count).alias("start_no"))
    day = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    dated = (drawn.join(starts, "start_no").withColumn("day", day)
             .select("scenario", "day", F.expr("date_add(date, day)").alias("date")))
    return dated.join(pool, "date").select("scenario", "day", CAT, "e", "u")


def correlation_drift(pool: DataFrame, drawn: DataFrame) -> DataFrame:
    """Largest change of a correlation between pool and scenarios, demand only and with cost."""
    def series(df: DataFrame, keys: list[str]) -> DataFrame:
        both = F.explode(F.array(F.struct(F.lit("demand").alias("k"), F.col("e").alias("v")),
                                 F.struct(F.lit("cost").alias("k"), F.col("u").alias("v"))))
        return df.withColumn("_s", both).select(
            F.concat_ws(":", F.col("_s.k"), CAT).alias("series"), *keys, F.col("_s.v").alias("v"))

    before = pearson(series(pool, ["date"]), "series", ["date"], "v")
    after = pearson(series(drawn, ["scenario", "day"]), "series", ["scenario", "day"], "v")
    diff = before.join(after.withColumnRenamed("r", "r2"), ["source", "target"])
    gap = F.abs(F.col("r") - F.col("r2"))
    demand = F.col("source").startswith("demand") & F.col("target").startswith("demand")
    return diff.agg(F.max(F.when(demand, gap)).alias("demand_drift"), F.max(gap).alias("joint_drift"))


def decision_bounds(history: DataFrame, theta: DataFrame, loss: DataFrame, future: DataFrame,
                    drawn: DataFrame) -> DataFrame:
    """Markup range, reference and daily change, and the largest sensible order per category."""
    base = history.join(theta.select(CAT, "ci_upper", "elasticity_used"), CAT).join(loss, CAT)
    base = base.withColumn("markup_low", F.greatest(F.lit(0.0), "markup_p05"))
    upper = F.when(F.col("ci_upper") < 0, F.col("markup_p95")).otherwise(F.col("markup_p90"))
    base = base.withColumn("markup_high", F.greatest(F.col("markup_low") + 0.05, upper))
    base = base.withColumn("markup_reference", clip("markup_p50", F.col("markup_low"), F.col("markup_high")))
    base = base.withColumn("markup_change", F.greatest(F.lit(0.04), "change_p90"))
    cheap = drawn.join(future, [CAT, "day"]).join(base.select(CAT, "markup_low", "loss_rate", "elasticity_used"), CAT)
    log_demand = (F.col("alpha_future") + F.col("elasticity_used")
                  * F.log(F.col("cost_future") * (1 + F.col("markup_low"))) + F.col("e"))
    need = F.greatest(F.lit(0.0), F.expm1(log_demand)) / (1 - F.col("loss_rate"))
    cap = cheap.groupBy(CAT).agg(F.percentile(need, F.lit(0.99)).alias("_cap"))
    return base.join(cap, CAT).withColumn(
        "order_upper", F.greatest(F.col("order_p99") * 1.25, F.col("_cap") * 1.10, F.lit(1.0))).select(
        CAT, "markup_low", "markup_reference", "markup_high", "markup_change", "order_upper", "loss_rate",
        "elasticity_used")


def respond(rows: DataFrame) -> DataFrame:
    """Demand and cost of scenario rows with alpha_future, cost_future, elasticity_used, markup, e and u."""
    out = rows.withColumn("price", F.col("cost_future") * (1 + F.col("markup")))
    log_demand = F.col("alpha_future") + F.col("elasticity_used") * F.log("price") + F.col("e")
    return (out.withColumn("demand", level_from_log(log_demand))
            .withColumn("cost", F.col("cost_future") * F.exp("u")))


def account(rows: DataFrame, goodwill: Column | float = GOODWILL) -> DataFrame:
    """Sales, operating profit and lost goodwill of rows with demand, cost, price, order_qty, loss_rate.

    The order is paid for before loss; only what is left after loss can be sold.
    """
    ratio_ = goodwill if isinstance(goodwill, Column) else F.lit(goodwill)
    out = rows.withColumn("available", (1 - F.col("loss_rate")) * F.col("order_qty"))
    out = out.withColumn("sales", F.least("demand", "available"))
    out = out.withColumn("operating", F.col("price") * F.col("sales") - F.col("cost") * F.col("order_qty"))
    return out.withColumn("goodwill", ratio_ * F.greatest(F.lit(0.0), F.col("price") - F.col("cost"))
                          * F.greatest(F.lit(0.0), F.col("demand") - F.col("available")))


def plan_facts(drawn: DataFrame, model: DataFrame, plan: DataFrame, goodwill: float = GOODWILL) -> DataFrame:
    """Join scenarios, the model table (CAT, day) and the plan (CAT, day, markup, order_qty), and account."""
    return account(respond(drawn.join(model, [CAT, "day"]).join(plan, [CAT, "day"])), goodwill)


def weekly_risk(facts: DataFrame, profit: Column, keys: list[str] = (), risk: float = RISK) -> DataFrame:
    """Days are added up inside each scenario before the tail is taken."""
    week = facts.groupBy(*keys, "scenario").agg(F.sum(profit).alias("week"))
    measures = [F.avg("week").alias("expected"), tail_mean("week").alias("lower_tail"),
                F.stddev_samp("week").alias("std")]
    out = week.groupBy(*keys).agg(*measures) if keys else week.agg(*measures)
    return out.withColumn("objective", (1 - risk) * F.col("expected") + risk * F.col("lower_tail"))


def worst_weeks(facts: DataFrame, profit: Column, p: float = TAIL) -> DataFrame:
    """Scenarios whose weekly profit is among the worst ceil(p n)."""
    week = facts.groupBy("scenario").agg(F.sum(profit).alias("week"))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))  # one row per scenario
    order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("week", "scenario"))
    return (week.withColumn("_k", F.ceil(n * F.lit(p))).withColumn("_rn", order)
            .where(F.col("_rn") <= F.greatest(F.lit(1), "_k")).select("scenario"))


def plan_summary(facts: DataFrame, penalty_weight: float = PENALTY) -> DataFrame:
    """Expectations, stock-out probability and worst-week contribution per (day, category)."""
    net = F.col("operating") - F.col("goodwill")
    # the penalty is the same in every scenario, so it does not change which weeks are worst
    bad = worst_weeks(facts, net).withColumn("_bad", F.lit(True))
    marked = facts.join(bad, "scenario", "left")
    return marked.groupBy("day", CAT).agg(
        F.avg("demand").alias("expected_demand"), F.avg("sales").alias("expected_sales"),
        F.avg(F.col("order_qty") - F.col("sales")).alias("expected_unsold"),
        F.avg("operating").alias("expected_profit"), F.avg("goodwill").alias("expected_goodwill"),
        F.avg(F.when(F.col("_bad"), F.col("operating"))).alias("worst_week_profit"),
        F.avg(F.when(is_stockout("demand", "available"), 1.0).otherwise(0.0)).alias("stockout_probability"))


def reference_penalty(plan: DataFrame, bounds: DataFrame, keys: list[str] = (), weight: float = PENALTY) -> DataFrame:
    """Weekly charge for moving markups away from their reference, once per plan."""
    gap = F.col("markup") - F.col("markup_reference")
    return plan.join(bounds.select(CAT, "markup_reference"), CAT).groupBy(*keys).agg(
        (F.lit(weight) * F.sum(gap * gap)).alias("penalty"))


def weekly_profits(facts: DataFrame, penalties: DataFrame, keys: list[str]) -> DataFrame:
    """Weekly operating, service-adjusted (less goodwill) and regularized profit (less the penalty, once a week) per key.

    `penalties` holds one `penalty` per key: it is the same in every scenario, so it lowers a week's profit by a constant.
    """
    week = facts.groupBy(*keys, "scenario").agg(F.sum("operating").alias("_op"), F.sum(F.col("operating") - F.col("goodwill")).alias("_net"))
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), c.alias("profit")) for n, c in (
        ("operating", F.col("_op")), ("service_adjusted", F.col("_net")), ("regularized", F.col("_net") - F.col("penalty")))]))
    rows = week.join(penalties, keys).select(*keys, "scenario", named.alias("m")).select(*keys, "scenario", "m.measure", "m.profit")
    return weekly_risk(rows, F.col("profit"), [*keys, "measure"])


def baseline_plan(drawn: DataFrame, model: DataFrame, bounds: DataFrame) -> DataFrame:
    """Reference markup every day, and the median demand at that price as the order."""
    priced = respond(drawn.join(model, [CAT, "day"]).join(
        bounds.select(CAT, F.col("markup_reference").alias("markup")), CAT))
    return priced.groupBy(CAT, "day").agg(
        F.first("markup").alias("markup"),
        (F.percentile("demand", F.lit(0.5)) / (1 - F.first("loss_rate"))).alias("order_qty"))


def grid_plan(drawn: DataFrame, model: DataFrame, bounds: DataFrame, markups: int = 7, orders: int = 7,
              goodwill: list[float] = (GOODWILL,), weights: list[float] = (PENALTY,), risk: float = RISK) -> DataFrame:
    """Best (markup, order) cell per day and category, for every goodwill ratio and penalty weight.

    Markups are evenly spaced in the bounds (narrowed to one daily change on the first
    day); orders are demand quantiles at that markup, capped by the order bound. Cells are
    scored by mean and lower tail over scenarios; ties take the lower markup, then order.
    """
    step = F.explode(F.sequence(F.lit(0), F.lit(markups - 1))).alias("m_no")
    first = F.col("day") == 0
    low = F.when(first, F.greatest("markup_low", F.col("markup_reference") - F.col("markup_change"))).otherwise(F.col("markup_low"))
    high = F.when(first, F.least("markup_high", F.col("markup_reference") + F.col("markup_change"))).otherwise(F.col("markup_high"))
    cells = model.join(bounds.drop("loss_rate", "elasticity_used"), CAT).withColumn("_low", low).withColumn("_high", high)
    cells = cells.select("*", step).withColumn(
        "markup", F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("m_no") / (markups - 1))
    priced = respond(drawn.join(cells, [CAT, "day"]))
    probs = [(i + 1) / (orders + 1) for i in range(orders)]
    levels = priced.groupBy(CAT, "day", "m_no").agg(
        F.percentile("demand", F.array(*[F.lit(p) for p in probs])).alias("_levels"))
    priced = priced.join(levels, [CAT, "day", "m_no"]).select("*", F.explode("_levels").alias("_level"))
    ordered = priced.withColumn("order_qty", F.least(F.col("_level") / (1 - F.col("loss_rate")), F.col("order_upper")))
    key = [CAT, "day", "markup", "order_qty"]
    # all goodwill ratios share one scenario pass: the charge is linear in the ratio
    unit = account(ordered, 1.0)
    stats = unit.groupBy(*key, "markup_reference").agg(*[
        F.struct(F.avg(F.col("operating") - g * F.col("goodwill")).alias("mean"),
                 tail_mean(F.col("operating") - g * F.col("goodwill")).alias("tail"), F.lit(float(g)).alias("goodwill_ratio")).alias(f"g{i}")
        for i, g in enumerate(goodwill)])
    out = stats.withColumn("s", F.explode(F.array(*[F.col(f"g{i}") for i in range(len(goodwill))])))
    out = out.withColumn("penalty_weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    gap = F.col("markup") - F.col("markup_reference")
    out = out.withColumn("score", fixed((1 - risk) * F.col("s.mean") + risk * F.col("s.tail")
                                        - F.col("penalty_weight") * gap * gap))
    best = F.max_by(F.struct("markup", "order_qty", "score"), F.struct(F.col("score"), -F.col("markup"), -F.col("order_qty")))
    return (out.groupBy(F.col("s.goodwill_ratio").alias("goodwill_ratio"), "penalty_weight", CAT, "day")
            .agg(best.alias("b")).select("goodwill_ratio", "penalty_weight", CAT, "day", "b.*"))


def change_violation(plan: DataFrame, bounds: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Largest excess of a first-day or day-to-day markup change over its limit, at least 0."""
    per = Window.partitionBy(*keys, CAT).orderBy("day")
    moved = plan.join(bounds.select(CAT, "markup_reference", "markup_change"), CAT)
    before = F.coalesce(F.lag("markup").over(per), F.col("markup_reference"))
    excess = moved.withColumn("_x", F.abs(F.col("markup") - before) - F.col("markup_change"))
    worst = F.greatest(F.lit(0.0), F.max("_x")).alias("violation")
    return excess.groupBy(*keys).agg(worst) if keys else excess.agg(worst)


def bound_hits(plan: DataFrame, bounds: DataFrame, keys: list[str] = (), tolerance: float = 1e-6) -> DataFrame:
    """Decisions that sit on their category's upper markup bound."""
    hit = F.abs(F.col("markup") - F.col("markup_high")) <= tolerance
    joined = plan.join(bounds.select(CAT, "markup_high"), CAT)
    return joined.groupBy(*keys).agg(F.count_if(hit).alias("upper_bound_hits"), F.count(F.lit(1)).alias("decisions"))
