"""Collection of telemetry as a stream of files: daily rows, kill records and alerts, each written once.

A micro-batch writes to folders that its id names and overwrites them, and it counts as known only what batches before it have
written. So a batch that is run again, after a crash between two of its writes or by force, leaves the same rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewick.operators import monitor

DAILY = (
    "hypothesis_id string, day date, bars_recorded long, trades long, net_pnl_points double, slippage_ticks_avg double, rejections long, kill_metric_daily double, guard_blocks map<string,bigint>, "
    "bars_expected int, gross_pnl_points double"
)
KILLS = "hypothesis_id string, day date, value double"
ALERTS = "hypothesis_id string, day date, alert string, reason string"


class Collector:
    """Writes to out/daily, out/kills and out/alerts, a folder batch=<id> for each micro-batch. Pass `collect` to foreachBatch.

    Rows are telemetry with hypothesis_id. A hypothesis's day is collected from the first batch that brings it; a day that is there already is left out,
    rows without a time too. A hypothesis is killed once. Of a batch without rows nothing is written.
    """

    def __init__(self, spark: SparkSession, out: str, calendar: DataFrame, costs: dict, modeled_slippage: float, window_days: int, threshold: float, aggregation: str = "median", above: bool = True):
        self.spark, self.out, self.calendar, self.costs = spark, out.rstrip("/"), calendar, costs
        self.slippage, self.kill, self.aggregation = modeled_slippage, (window_days, threshold, aggregation, above), aggregation

    def table(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """What all batches have written, or those before one."""
        try:
            found = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.out}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], f"{schema}, batch long")
        found = found if before is None else found.where(F.col("batch") < before)
        return found.drop("batch")

    def daily(self, before: int | None = None) -> DataFrame:
        return self.table("daily", DAILY, before)

    def kills(self, before: int | None = None) -> DataFrame:
        return self.table("kills", KILLS, before)

    def alerts(self, before: int | None = None) -> DataFrame:
        return self.table("alerts", ALERTS, before)

    def write(self, rows: DataFrame, name: str, schema: str, batch: int) -> DataFrame:
        columns = [c.strip().split(" ")[0] for c in schema.split(", ")]
        path = f"{self.out}/{name}/batch={batch}"
        rows.select(*columns).coalesce(1).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def collect(self, rows: DataFrame, batch: int) -> None:
        spark = self.spark
        rows = rows.where("bar_time is not null").withColumn("day", F.to_date("bar_time"))
        new = monitor.daily_summary(rows, self.calendar, self.costs, self.aggregation)
        new = self.write(monitor.collect_day(new, self.daily(batch)), "daily", DAILY, batch)
        self.write(monitor.alerts(new, self.slippage), "alerts", ALERTS, batch)
        # Only hypotheses of this batch can have died; their days so far are a row each.
        some = new.select("hypothesis_id").distinct()
        days = self.daily(batch).join(some, "hypothesis_id", "left_semi").unionByName(new)
        dead = monitor.first_kills(monitor.kill_states(days, *self.kill))
        self.write(dead.join(self.kills(batch), "hypothesis_id", "left_anti"), "kills", KILLS, batch)
        spark.catalog.refreshByPath(self.out)

    def run(self, rows: DataFrame, checkpoint: str) -> None:
        """Collects all that is there, from where the checkpoint left off."""
        rows.writeStream.foreachBatch(self.collect).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
