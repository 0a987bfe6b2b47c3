"""Combinatorial purged cross-validation as relations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day_groups(frame: DataFrame, n_groups: int = 8) -> DataFrame:
    """day, grp: days in order, cut into groups of as equal size as can be, the first ones larger. A table of days."""
    days = frame.select("day").distinct()
    return days.withColumn("grp", F.ntile(n_groups).over(Window.orderBy("day")) - 1)


def partitions(spark, n_groups: int = 8, k_test: int = 2) -> DataFrame:
    """path_id, grp: the test groups of each partition."""
    rows = [(i, g) for i, c in enumerate(combinations(range(n_groups), k_test)) for g in c]
    return spark.createDataFrame(rows, "path_id int, grp int")


def paths_per_partition(n_groups: int = 8, k_test: int = 2) -> int:
    """How many whole paths the partitions make: C(n, k) k / n."""
    import math

    return math.comb(n_groups, k_test) * k_test // n_groups


def split(samples: DataFrame, days: DataFrame, parts: DataFrame, horizon_min: int, embargo_mult: float = 3.0) -> DataFrame:
    """path_id, ts, day, role of samples (ts, day): test, purged, embargoed or train.

    A sample's label runs from ts over horizon_min. Purged are training samples whose label meets a test group's span,
    embargoed those that start within embargo_mult * horizon_min after it. The spans are a table of groups, so the interval
    join has it on the small side.
    """
    grouped = samples.join(F.broadcast(days), "day")  # a row for each day
    span = grouped.groupBy("grp").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    tests = parts.join(span, "grp")
    minutes = lambda c, k: c + F.make_dt_interval(mins=F.lit(int(k)))
    every = grouped.join(F.broadcast(parts.select("path_id").distinct()))  # each sample once for each partition
    spans = tests.groupBy("path_id").agg(F.collect_list(F.struct("grp", "lo", "hi")).alias("spans"))
    e = every.join(F.broadcast(spans), "path_id")
    end = minutes(F.col("ts"), horizon_min)
    inside = F.exists("spans", lambda s: s["grp"] == F.col("grp"))
    meets = F.exists("spans", lambda s: (F.col("ts") <= minutes(s["hi"], horizon_min)) & (end >= s["lo"]))
    after = F.exists("spans", lambda s: (F.col("ts") > s["hi"]) & (F.col("ts") <= minutes(s["hi"], horizon_min * (1 + embargo_mult))))
    role = F.when(inside, "test").when(meets, "purged").when(after, "embargoed").otherwise("train")
    return e.select("path_id", "ts", "day", role.alias("role"))


def removed(samples: DataFrame, days: DataFrame, embargo_min: int, bin_min: int = 1440) -> DataFrame:
    """grp, ts, end, role: what each test group takes out of training, of samples (ts, end, day) whose labels end at a time of their own.

    A group's span runs from its first sample to the last end of its labels. Purged are samples of other groups whose label meets the span,
    embargoed those that begin within embargo_min after it. Both are points in intervals, cut into bins that are joined by equality: the label holds the
    group's first time, or the sample begins between that and the end of the embargo. So only rows that lose their
    place are made, whatever the number of partitions. A label without an end, or one that ends before it begins, ends where it begins.
    """
    bin_of = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (bin_min * 60_000_000))
    x = samples.select("ts", F.greatest("ts", "end").alias("end"), "day").join(F.broadcast(days), "day")  # a row for each day
    span = x.groupBy("grp").agg(F.min("ts").alias("lo"), F.max("end").alias("hi"))
    span = span.withColumnRenamed("grp", "test").withColumn("late", F.col("hi") + F.make_dt_interval(mins=F.lit(embargo_min)))
    reach = x.withColumn("bin", F.explode(F.sequence(bin_of(F.col("ts")), bin_of(F.col("end")))))
    left = reach.join(span.withColumn("bin", bin_of(F.col("lo"))), "bin").where("ts < lo and end >= lo and grp <> test").withColumn("role", F.lit("purged"))
    tail = span.withColumn("bin", F.explode(F.sequence(bin_of(F.col("lo")), bin_of(F.col("late")))))
    # Groups are runs of days, so of other groups only what begins behind the test group's last day can lie here.
    right = x.withColumn("bin", bin_of(F.col("ts"))).join(tail, "bin").where("ts >= lo and ts <= late and grp <> test")
    right = right.withColumn("role", F.when(F.col("ts") <= F.col("hi"), "purged").otherwise("embargoed"))
    out = left.unionByName(right, allowMissingColumns=True)
    return out.select(F.col("test").alias("grp"), "ts", "end", "role")


def training(samples: DataFrame, days: DataFrame, parts: DataFrame, gone: DataFrame, path_id: int) -> DataFrame:
    """The training samples of one partition: those of other groups that none of its test groups takes out."""
    test = F.broadcast(parts.where(F.col("path_id") == path_id).select("grp"))  # the groups of a partition
    x = samples.join(F.broadcast(days), "day").join(test, "grp", "left_anti")
    return x.join(gone.join(test, "grp", "left_semi").select("ts").distinct(), "ts", "left_anti")
