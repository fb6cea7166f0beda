"""Seasonal clusters of entities: assignment, quality, stability and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greengrain.functions.exprs import draw, ratio, season_of
from greengrain.functions.staging import stage
from greengrain.operators.pairs import entity_pairs

# The months of each seasonal prototype.
PROTOTYPES = {"spring": [3, 4, 5], "early_summer": [5, 6, 7], "summer_autumn": [8, 9, 10],
              "winter": [11, 12, 1, 2], "year_round": list(range(1, 13))}


def seasonal_label(monthly: DataFrame, entity: str) -> DataFrame:
    """Nearest month prototype of the normalized 12-month share profile."""
    total = F.sum("sales_proportion")
    squares = F.sum(F.col("sales_proportion") * F.col("sales_proportion"))
    sums = monthly.groupBy(entity).agg(total.alias("_t"), squares.alias("_q"), *[
        F.sum(F.when(F.col("month").isin(m), F.col("sales_proportion")).otherwise(0.0)).alias(f"_{n}") for n, m in PROTOTYPES.items()])
    flat = F.col("_t") <= 0
    # |profile - prototype|^2 = |profile|^2 - 2 <profile, prototype> + 1 / months
    def cost(name: str, months: list[int]) -> Column:
        square = F.when(flat, 1.0 / 12).otherwise(F.col("_q") / F.nullif(F.col("_t") * F.col("_t"), F.lit(0.0)))
        inner = F.when(flat, 1.0 / 12).otherwise(ratio(f"_{name}", "_t") / len(months))
        return square - 2 * inner + 1.0 / len(months)
    options = F.array(*[F.struct(F.floor(cost(n, m) * 1e9 + 0.5).alias("cost"), F.lit(i).alias("place"), F.lit(n).alias("label"))
                        for i, (n, m) in enumerate(PROTOTYPES.items())])
    return sums.select(entity, F.array_min(options)["label"].alias("label"))


def quality(features: DataFrame, labels: DataFrame, entity: str, names: list[str], label: str) -> DataFrame:
    """Silhouette, Calinski-Harabasz, Davies-Bouldin and the smallest cluster of a labelling."""
    rows = features.join(labels.select(entity, label), entity).select(entity, label, F.array(*names).alias("v"))
    rows = stage(rows, "labelled")
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x)
    payload = rows.select(entity, F.struct(label, "v").alias("p"))
    pairs = entity_pairs(payload, entity, "p").withColumn("d", F.sqrt(square(F.col("x.v"), F.col("y.v"))))
    ends = F.explode(F.array(F.struct(F.col("source").alias("e"), F.col(f"x.{label}").alias("own"), F.col(f"y.{label}").alias("other")),
                             F.struct(F.col("target").alias("e"), F.col(f"y.{label}").alias("own"), F.col(f"x.{label}").alias("other"))))
    per = pairs.select(ends.alias("t"), "d").groupBy("t.e", "t.own", "t.other").agg(F.avg("d").alias("d"))
    ab = per.groupBy("e", "own").agg(F.max(F.when(F.col("own") == F.col("other"), F.col("d"))).alias("a"),
                                     F.min(F.when(F.col("own") != F.col("other"), F.col("d"))).alias("b"))
    silhouette = ab.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")))).scalar()
    dims = range(len(names))
    centers = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("v")[i]) for i in dims]).alias("c"))
    grand = rows.agg(F.array(*[F.avg(F.col("v")[i]) for i in dims])).scalar()
    spread = rows.join(centers, label).withColumn("d2", square(F.col("v"), F.col("c"))).groupBy(label).agg(
        F.first("n").alias("n"), F.first("c").alias("c"), F.sum("d2").alias("w"), F.avg(F.sqrt("d2")).alias("s")).withColumn("g", grand)
    spread = stage(spread.withColumn("between", F.col("n") * square(F.col("c"), F.col("g"))), "centers")
    gaps = entity_pairs(spread.select(label, F.struct("c", "s").alias("p")), label, "p").select(
        "source", "target", ((F.col("x.s") + F.col("y.s")) / F.sqrt(square(F.col("x.c"), F.col("y.c")))).alias("r"))
    worst = gaps.select(F.explode(F.array("source", "target")).alias("e"), "r").groupBy("e").agg(F.max("r").alias("r"))
    out = spread.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("clusters"), F.min("n").alias("smallest"),
                     F.sum("between").alias("b"), F.sum("w").alias("w"))
    return out.select("clusters", "smallest", silhouette.alias("silhouette"),
                      ratio(F.col("b") * (F.col("n") - F.col("clusters")), F.col("w") * (F.col("clusters") - 1)).alias("calinski_harabasz"),
                      worst.agg(F.avg("r")).scalar().alias("davies_bouldin"))


def rand_index(left: DataFrame, right: DataFrame, entity: str, a: str, b: str, group: list[str] = ()) -> DataFrame:
    """Adjusted Rand index of two labellings from their contingency counts, per group of the right one."""
    cells = left.select(entity, F.col(a).alias("_a")).join(right.select(*group, entity, F.col(b).alias("_b")), entity)
    counts = cells.groupBy(*group, "_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    choose = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    one = F.lit(0).alias("_one")
    side = lambda k, name: counts.groupBy(*group, k).agg(F.sum("n").alias("n")).groupBy(*group, one).agg(F.sum(choose("n")).alias(name))
    both = counts.groupBy(*group, one).agg(F.sum(choose("n")).alias("both"), F.sum("n").alias("total"))
    out = both.join(side("_a", "l"), [*group, "_one"]).join(side("_b", "r"), [*group, "_one"])
    expected = F.col("l") * F.col("r") / choose("total")
    return out.select(*group, F.coalesce(ratio(F.col("both") - expected, (F.col("l") + F.col("r")) / 2 - expected), F.lit(1.0)).alias("ari"))


def year_samples(month_totals: DataFrame, entity: str, reps: int, seed: int = 20230907) -> DataFrame:
    """Month shares and active rates of whole complete sales years drawn with replacement, for every replicate `grp`."""
    years = month_totals.groupBy("sales_year").agg(F.count_distinct("month").alias("m"), (F.sum("days") / F.count_distinct(entity)).alias("d"))
    whole = years.where((F.col("m") == 12) & (F.col("d") >= 365)).select("sales_year")
    packed = whole.agg(F.array_sort(F.collect_list("sales_year"))).scalar()  # one number per complete year
    drawn = whole.sparkSession.range(reps).select(F.col("id").cast("int").alias("grp"), F.posexplode(packed).alias("i", "_y"), packed.alias("all"))
    drawn = drawn.select("grp", F.col("all")[(draw(seed, F.col("grp"), F.col("i")) % F.size("all")).cast("int")].alias("sales_year"))
    picked = drawn.groupBy("grp", "sales_year").agg(F.count(F.lit(1)).alias("copies"))
    totals = month_totals.groupBy(entity, "sales_year").agg(F.sum("qty").alias("year_qty"))
    rows = month_totals.join(totals, [entity, "sales_year"]).join(picked, "sales_year")
    share = F.coalesce(F.col("qty") / F.nullif(F.col("year_qty"), F.lit(0.0)), F.lit(0.0))
    return rows.groupBy("grp", entity, "month").agg(
        (F.sum(share * F.col("copies")) / F.sum("copies")).alias("sales_proportion"),
        (F.sum(F.col("active_days") / F.col("days") * F.col("copies")) / F.sum("copies")).alias("active_rate"))


def cluster_profiles(monthly: DataFrame, labels: DataFrame, entity: str, label: str) -> DataFrame:
    """Members, first five names, season shares and month shares of each cluster."""
    rows = monthly.join(labels.select(entity, label), entity)
    members = _members(labels, entity, label)
    n = F.count_distinct(entity)
    season = [(F.sum(F.when(season_of("month") == s, F.col("sales_proportion"))) / n).alias(f"{s}_share")
              for s in ("spring", "summer", "autumn", "winter")]
    month = [F.avg(F.when(F.col("month") == m, F.col("sales_proportion"))).alias(f"share_month_{m}") for m in range(1, 13)]
    return rows.groupBy(label).agg(*season, *month).join(members, label)


def _members(labels: DataFrame, entity: str, label: str) -> DataFrame:
    """Counts and the first five names; each name round keeps one value per cluster, never a list of members."""
    out = labels.groupBy(label).agg(F.count(F.lit(1)).alias("members"), F.min(entity).alias("_n0"))
    left = labels
    for i in range(1, 5):
        seen = out.select(label, F.col(f"_n{i - 1}").alias("_last"))
        left = left.join(seen, label).where(F.col(entity) > F.col("_last")).drop("_last")
        out = out.join(left.groupBy(label).agg(F.min(entity).alias(f"_n{i}")), label, "left")
    return out.select(label, "members", F.concat_ws(";", *[f"_n{i}" for i in range(5)]).alias("first_names"))
