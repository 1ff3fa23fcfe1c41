"""``python -m tianguis analyze --targets t.json --source captures/ --end 2026-09-30``: contracts as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tianguis.plans.analysis import analyze, contracts, trace
from tianguis.schema import TARGET
from tianguis.sources.files import Source, fetch_all, read_listings, read_rates


def read_targets(spark: SparkSession, text: str):
    """Targets from JSON, a file's after @: one object or a list; each needs a name."""
    given = json.loads(open(text[1:], encoding="utf-8").read() if text.startswith("@") else text)
    names = [f.split(" ")[0] for f in TARGET.split(", ")]
    rows = []
    for k, t in enumerate(given if isinstance(given, list) else [given]):
        if not t.get("name"):
            raise ValueError(f"target {k} has no name")
        t = {"target_id": str(k), "keywords": [], "exclude_keywords": [], "provinces": [], **t}
        t["quantity"] = None if t.get("quantity") is None else float(t["quantity"])
        rows.append(tuple(t.get(n) for n in names))
    return spark.createDataFrame(rows, TARGET)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tianguis")
    p.add_argument("command", choices=["analyze"])
    p.add_argument("--targets", required=True, help="JSON, or @file")
    p.add_argument("--source", action="append", required=True, help="path[:source_id]; may be repeated")
    p.add_argument("--end", required=True)
    p.add_argument("--start")
    p.add_argument("--history", help="read captures from this time on, for the series")
    p.add_argument("--rates")
    p.add_argument("--convert-to")
    p.add_argument("--cost", help="amount:currency")
    p.add_argument("--out", help="folder for contracts and trace; contracts go to standard output without it")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("tianguis").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    targets = read_targets(spark, a.targets)

    def source(text):
        path, _, own = text.partition(":")
        return Source(own or path, lambda s, since, until: read_listings(s, path, own or None, since=since, until=until))

    rows, status = fetch_all(spark, [source(t) for t in a.source], targets, a.history, a.end)
    cost = (float(a.cost.split(":")[0]), a.cost.split(":")[1]) if a.cost else None
    rates = read_rates(spark, a.rates) if a.rates else None
    result = analyze(targets, rows, analysis_end=a.end, analysis_start=a.start, rates_table=rates, convert_to=a.convert_to, reference_cost=cost, source_status=status)
    out = contracts(result)
    if a.out:
        out.write.mode("overwrite").json(f"{a.out}/contracts")
        trace(result).write.mode("overwrite").json(f"{a.out}/trace")
    else:
        for r in out.orderBy(F.col("target_id")).toLocalIterator():
            print(json.dumps({"target_id": r.target_id, "analysis_id": r.analysis_id, **json.loads(r.contract)}, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
