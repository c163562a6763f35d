"""Series against surveys, and classifiers against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.series import by_time, surrounded


def survey_match(series: DataFrame, surveys: DataFrame, by: list[str], date: str, value: str, survey_date: str, survey_value: str, min_days: int = 3, max_days: int = 10) -> DataFrame:
    """series with `survey`: NULL if the closest survey is farther than max_days; its value if it is less than min_days away, also
    where no survey follows; else one interpolated by days between the surveys around the date, NULL where one of them is missing."""
    points = surveys.where(F.col(survey_value).isNotNull() & F.col(survey_date).isNotNull()).groupBy(*by, F.col(survey_date).alias("_t")).agg(F.min(survey_value).alias("_v"))
    own = surrounded(series, points, by, F.col(date), by_time(F.col("_t"))).withColumnsRenamed({"_before": "_b", "_after": "_a"})
    days = lambda c: F.floor((F.unix_micros(F.col(f"{c}._t").cast("timestamp")) - F.unix_micros(F.col("_t").cast("timestamp"))) / 86_400_000_000)
    gap_b, gap_a = F.abs(days("_b")), F.abs(days("_a"))
    least = F.least(gap_b, gap_a)
    closest = F.when(F.coalesce(gap_b <= gap_a, gap_b.isNotNull()), F.col("_b._v")).otherwise(F.col("_a._v"))
    ordinal = lambda c: F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))
    x, x0, x1 = ordinal(F.col("_t")), ordinal(F.col("_b._t")), ordinal(F.col("_a._t"))
    between = F.col("_b._v") + F.try_divide((x - x0) * (F.col("_a._v") - F.col("_b._v")), (x1 - x0).cast("double"))
    found = F.when(least > max_days, None).when(least < min_days, closest).otherwise(between)
    return own.select("_row.*", found.alias("survey"))


def error_statistics(df: DataFrame, by: list[str], estimate: str, truth: str, least: int = 0) -> DataFrame:
    """Slope and R2 of the estimate on the truth; RMSE, mean, population deviation and 90 % quantile of errors, of groups of at least
    `least` pairs. Survey comparisons ask for eight."""
    own = df.where(F.col(estimate).isNotNull() & F.col(truth).isNotNull()).withColumn("_e", F.col(estimate) - F.col(truth))
    return own.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(estimate, truth).alias("slope"), F.regr_r2(estimate, truth).alias("r2"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.avg("_e").alias("mean_error"), F.stddev_pop("_e").alias("std_error"), F.percentile(F.abs("_e"), 0.9).alias("q90"),
    ).where(F.col("n") >= least)


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Density in bins of `width` from the smallest value; the largest falls into the last bin."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    bins = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / width)).cast("long")
    own = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    bin_ = F.least(F.floor((F.col(value) - F.col("lo")) / width).cast("long"), bins - 1)
    return own.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n_bin"), (F.count(F.lit(1)) / (F.max("n") * width)).alias("density"))


def normality(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, deviation, population skewness and excess kurtosis, and D'Agostino's K2 of both with its chance `p` under a normal
    distribution (two degrees of freedom); K2 is NULL below 20 values, where its approximation doesn't hold."""
    own = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"))
    n, g1, g2 = F.col("n").cast("double"), F.col("skewness"), F.col("kurtosis")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n**2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta - 1))
    of_skewness = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.log(F.sqrt(w2)))
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (g2 + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(spread)
    third = 6 * (n**2 - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / third * (2 / third + F.sqrt(1 + 4 / third**2))
    root = F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))
    of_kurtosis = (1 - 2 / (9 * a) - root) / F.sqrt(2 / (9 * a))
    k2 = F.when(F.col("n") >= 20, of_skewness**2 + of_kurtosis**2)
    return own.withColumn("k2", k2).withColumn("p", F.exp(-F.col("k2") / 2))


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    counts = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def by_mission(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("satname").agg(F.median(value).alias("median"), F.count(value).alias("n"))


def class_shares(df: DataFrame, by: list[str], label: str, classes: list[int]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.avg((F.col(label) == k).cast("int")).alias(f"share_{k}") for k in classes))


def subsample(df: DataFrame, by: str, key: str, n: int, salt: int = 7919) -> DataFrame:
    """n rows of each class (a sampling operator) in the order of an arithmetic hash of a whole-number key, which any engine can
    repeat; ranks are cut before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.pmod(F.col(key) * salt + 13, F.lit(1_000_003)), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """n and the share of rows whose prediction is right."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy"))
