"""Command line: data, genesis, verify, report, collect. Exit code 0 done, 1 refused, 2 wrong input."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidewick.operators import ledger, monitor, prep
from tidewick.plans.formula import FormulaError
from tidewick.session import session
from tidewick.sources import bars, files


def data(spark, a) -> int:
    parts = {"WIN": prep.stitch([files.read_market_csv(spark, p) for p in a.win])}
    parts |= {r: files.read_market_csv(spark, p) for r, p in (x.split("=", 1) for x in a.ref)}
    named = [x.select(F.lit(s).alias("symbol"), "ts", "open", "high", "low", "close", F.col("tick_volume").alias("trades"), F.col("real_volume").alias("volume")) for s, x in parts.items()]
    refs = tuple(s for s in parts if s != "WIN")
    frame = bars.build_frame(reduce(lambda x, y: x.unionByName(y), named), refs=refs, session=tuple(a.session))
    found, lost = prep.gaps(frame).count(), [r for r in (prep.alignment(frame, *refs).collect() if refs else []) if r.lag != 0 and abs(r["corr"]) >= prep.MIN_CORR]
    print(prep.quality(frame).first().asDict(), "gaps", found, "out of step", [r.symbol for r in lost])
    if (found or lost) and not a.force:
        return 1
    files.write_calendar(prep.calendar(frame), f"{a.out}/calendar")
    research, held = prep.split_holdout(frame, a.holdout_months)
    files.save_frame(research, f"{a.out}/research")
    files.save_frame(held, f"{a.out}/holdout")
    print(prep.data_hash(research, ("close", "high", "low", "volume", "trades", *(f"ref_{r}" for r in refs))).first().data_hash)
    return 0


def verify(spark, a) -> int:
    row = ledger.verify_chain(ledger.Ledger(spark, a.ledger).rows()).first()
    print(row.asDict())
    return 0 if row.ok else 1


def genesis(spark, a) -> int:
    row = ledger.Ledger(spark, a.ledger).append({"kind": "genesis", "trial_id": "genesis", "config_hash": a.config_hash, "data_hash": a.data_hash, "ts": a.at})
    print(row["row_hash"])
    return 0


def report(spark, a) -> int:
    rows = ledger.Ledger(spark, a.ledger).rows()
    print(ledger.session_report(rows, a.var_sr).first().asDict())
    for r in ledger.attempts(rows, a.session).orderBy("trial").toLocalIterator():
        print(r.asDict())
    return 0


def collect(spark, a) -> int:
    """A day's telemetry files become daily rows, kill states and alerts, written as Parquet and JSON; days already there stay."""
    rows = files.read_telemetry(spark, a.telemetry).withColumns({"hypothesis_id": F.lit(a.hypothesis), "day": F.to_date("bar_time")})
    new = monitor.daily_summary(rows, files.read_calendar(spark, a.calendar), files.load_costs(a.costs))
    try:
        new = monitor.collect_day(new, spark.read.parquet(f"{a.out}/daily"))
    except AnalysisException:
        pass  # nothing was collected before
    files.append_alerts(monitor.alerts(new, a.slippage), f"{a.out}/alerts")
    new.write.mode("append").parquet(f"{a.out}/daily")
    states = monitor.kill_states(spark.read.parquet(f"{a.out}/daily"), a.window, a.threshold)
    for r in monitor.first_kills(states).toLocalIterator():  # one for each hypothesis
        print(r.asDict())
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewick", description=__doc__)
    sub = p.add_subparsers(required=True)
    d = sub.add_parser("data")
    d.add_argument("--win", nargs="+", required=True)
    d.add_argument("--ref", nargs="*", default=[], help="SYMBOL=file")
    d.add_argument("--session", nargs=2, type=int, default=(540, 1080))
    d.add_argument("--holdout-months", type=int, default=6)
    d.add_argument("--out", required=True)
    d.add_argument("--force", action="store_true")
    d.set_defaults(run=data)
    v = sub.add_parser("verify")
    v.add_argument("--ledger", required=True)
    v.set_defaults(run=verify)
    g = sub.add_parser("genesis")
    for name in ("--ledger", "--config-hash", "--data-hash", "--at"):
        g.add_argument(name, required=True)
    g.set_defaults(run=genesis)
    r = sub.add_parser("report")
    r.add_argument("--ledger", required=True)
    r.add_argument("--session", default="")
    r.add_argument("--var-sr", type=float, default=0.6)
    r.set_defaults(run=report)
    c = sub.add_parser("collect")
    for name in ("--telemetry", "--calendar", "--costs", "--hypothesis", "--out"):
        c.add_argument(name, required=True)
    c.add_argument("--slippage", type=float, default=1.0)
    c.add_argument("--window", type=int, default=5)
    c.add_argument("--threshold", type=float, required=True)
    c.set_defaults(run=collect)
    a = p.parse_args(argv)
    try:
        return a.run(session(), a)
    except (FormulaError, ledger.LedgerError, AnalysisException, OSError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
