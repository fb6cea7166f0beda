"""Evidence audit: which data packages cover which requirements, and in what order to get them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Data packages, and for each capability the alternative package sets that meet it.
PACKAGES = ["inventory_stockout", "batch_loss_quality", "supplier_quote_fulfillment", "promotion_display_traffic",
            "anonymous_basket", "weather_calendar", "competitor_price"]
REQUIREMENTS = {
    "latent_demand": [["inventory_stockout"]],
    "price_response": [["inventory_stockout", "promotion_display_traffic"]],
    "dynamic_loss": [["batch_loss_quality"]],
    "supply_cost": [["supplier_quote_fulfillment"]],
    "assortment_substitution": [["inventory_stockout", "anonymous_basket"]],
    "external_demand": [["promotion_display_traffic"], ["weather_calendar"]],
    "realized_validation": [["inventory_stockout", "batch_loss_quality", "supplier_quote_fulfillment"]],
    "weather_context": [["weather_calendar"]],
    "competitive_context": [["competitor_price"]],
}
CORE = ["latent_demand", "price_response", "dynamic_loss", "supply_cost", "assortment_substitution", "external_demand",
        "realized_validation"]
# The scenarios by the requirements they ask for.
SCENARIOS = {
    "base_core": CORE,
    "forecast_strict": CORE + ["weather_context"],
    "market_strict": CORE + ["competitive_context"],
    "assortment_light": [r for r in CORE if r != "assortment_substitution"],
    "cost_light": [r for r in CORE if r not in ("supply_cost", "realized_validation")],
    "loss_light": [r for r in CORE if r not in ("dynamic_loss", "realized_validation")],
    "identification_only": ["latent_demand", "price_response", "assortment_substitution"],
}
# What each package contributes to directly.
COVERAGE = {
    "inventory_stockout": ["latent_demand", "price_response", "assortment_substitution", "realized_validation"],
    "batch_loss_quality": ["dynamic_loss", "realized_validation"],
    "supplier_quote_fulfillment": ["supply_cost", "realized_validation"],
    "promotion_display_traffic": ["price_response", "external_demand"],
    "anonymous_basket": ["assortment_substitution"],
    "weather_calendar": ["external_demand"],
    "competitor_price": ["competitive_context"],
}
CAPABILITIES = ["latent_demand", "price_response", "dynamic_loss", "supply_cost", "assortment_substitution", "external_demand",
                "realized_validation", "competitive_context"]


def scenario_table() -> Column:
    """The scenarios as an array of (scenario, requirements); a requirement is a list of package sets."""
    alternatives = lambda r: F.array(*[F.array(*[F.lit(p) for p in a]) for a in REQUIREMENTS[r]])
    return F.array(*[F.struct(F.lit(s).alias("scenario"), F.array(*[alternatives(r) for r in needs]).alias("needs"))
                     for s, needs in SCENARIOS.items()])


def feasible(needs: Column, packages: Column) -> Column:
    """Every requirement has an alternative that the package set contains."""
    return F.forall(needs, lambda options: F.exists(options, lambda a: F.size(F.array_except(a, packages)) == 0))


def package_sets(holdings: DataFrame, owner: str, package: str) -> DataFrame:
    """Distinct package sets with the number of owners; a set is bounded by the package catalog."""
    sets = holdings.select(owner, package).distinct().groupBy(owner).agg(F.array_sort(F.collect_list(package)).alias("packages"))
    return sets.groupBy("packages").agg(F.count(F.lit(1)).alias("owners"))


def minimum_portfolios(sets: DataFrame) -> DataFrame:
    """Per scenario all feasible sets of the smallest feasible size, with a deletion-minimal flag."""
    long = sets.withColumn("s", F.explode(scenario_table())).select(
        "s.*", "packages", "owners", F.size("packages").alias("portfolio_size"))
    long = long.where(feasible(F.col("needs"), F.col("packages")))
    smallest = long.groupBy("scenario").agg(F.min("portfolio_size").alias("portfolio_size"))
    minimal = F.forall("packages", lambda p: ~feasible(F.col("needs"), F.array_remove(F.col("packages"), p)))
    return long.join(smallest, ["scenario", "portfolio_size"]).select(
        "scenario", "portfolio_size", "packages", "owners", minimal.alias("deletion_minimal"))


def priority_tiers(portfolios: DataFrame) -> DataFrame:
    """Tier 1 in every scenario, tier 2 in the base scenario, tier 3 otherwise."""
    packages = portfolios.select("scenario", F.explode("packages").alias("package_id"))
    counts = packages.groupBy("package_id").agg(
        F.count_distinct("scenario").alias("scenarios"), F.max(F.col("scenario") == "base_core").alias("in_base"))
    total = portfolios.select(F.count_distinct("scenario")).scalar()
    return counts.withColumn("inclusion_rate", F.col("scenarios") / total).withColumn(
        "tier", F.when(F.col("scenarios") == total, 1).when(F.col("in_base"), 2).otherwise(3))


def coverage_matrix(holders: DataFrame) -> DataFrame:
    """Package x capability 0/1 matrix with the holders of each package."""
    columns = [F.col("package_id").isin([p for p, c in COVERAGE.items() if k in c]).cast("int").alias(k) for k in CAPABILITIES]
    return holders.select("package_id", "holders", *columns)
