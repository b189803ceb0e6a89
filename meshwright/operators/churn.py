"""History of changes: churn, files that change together, and risk where it meets the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.runtime import Workspace


def churn(commits: DataFrame) -> DataFrame:
    """(file, churn): commits that touch a file; a file named twice in a commit counts once."""
    return commits.select("commit_id", "file").dropna().distinct().groupBy("file").agg(F.count(F.lit(1)).alias("churn"))


def cochange(commits: DataFrame, *, least: int = 2, most_files: int = 30) -> DataFrame:
    """(a, b, together): files a < b that change in the same commits, of commits of 2 to 30 files."""
    ws = Workspace(commits.sparkSession, "cochange")
    lists = commits.select("commit_id", "file").dropna().distinct().groupBy("commit_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 2) & (F.col("n") <= most_files))
    kept = commits.select("commit_id", "file").dropna().distinct().join(lists.select("commit_id"), "commit_id", "left_semi")
    fs = ws.write(kept.groupBy("commit_id").agg(F.sort_array(F.collect_list("file")).alias("fs")).select("fs"), "lists")
    tails = F.transform("fs", lambda f, i: F.struct(f.alias("a"), F.slice(F.col("fs"), i + 2, F.size("fs")).alias("bs")))
    two = fs.select(F.explode(tails).alias("x")).select("x.a", F.explode("x.bs").alias("b"))
    return two.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= least)


def hotspots(churned: DataFrame, mass: DataFrame) -> DataFrame:
    """(file, churn, mass, risk, urgency): what changes often and much depends on it; orange from
    half of the greatest risk on. ``mass``: (file, mass)."""
    both = churned.join(mass.where("mass > 0"), "file").withColumn("risk", F.round(F.col("churn") * F.col("mass"), 2))
    top = both.agg(F.max("risk")).first()[0] or 0.0
    return both.select("file", "churn", F.round("mass", 2).alias("mass"), "risk", F.when(F.col("risk") >= F.lit(float(top) / 2), "orange").otherwise("green").alias("urgency"))


def tied_percentiles(values: DataFrame, value: str) -> DataFrame:
    """(file, value, percentile): the mean rank of equal values over the number of rows.

    Ranks come from the counts of each value, so only distinct values are put in order.
    """
    per = values.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = values.count()
    place = per.withColumn("upto", upto).select(value, ((F.col("upto") - F.col("n") + 1 + F.col("upto")) / 2 / F.lit(float(max(1, total)))).alias("percentile"))
    return values.join(place, value).select("file", F.col(value).alias("value"), "percentile")


def converge(lenses: dict[str, DataFrame]) -> DataFrame:
    """(file, score, n_lenses, <lens>...): geometric mean of a file's percentiles over the lenses
    that see it, for files that two lenses or more see. A lens: (file, value)."""
    ranked = [tied_percentiles(df, "value").select("file", F.col("percentile").alias(name)) for name, df in lenses.items()]
    both = reduce(lambda a, b: a.join(b, "file", "full"), ranked)
    names = list(lenses)
    seen = reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("int") for n in names])
    product = reduce(lambda a, b: a * b, [F.coalesce(n, F.lit(1.0)) for n in names])
    out = both.withColumn("n_lenses", seen).where("n_lenses >= 2").withColumn("score", F.round(F.pow(product, F.lit(1.0) / F.col("n_lenses")), 4))
    return out.select("file", "score", "n_lenses", *[F.round(n, 3).alias(n) for n in names])
