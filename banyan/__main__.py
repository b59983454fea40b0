"""Commands: translate one text, evaluate a file of pairs, export a table.

python -m banyan translate bn2en "text" [--fast] [--roundtrip_engine NAME]
python -m banyan evaluate bn2en pairs.jsonl results [--rows N] [--baseline_engine NAME]
python -m banyan export rows.jsonl table
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import evaluate
from .plans.translate import Options, panel, translate
from .sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="banyan")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("translate")
    t.add_argument("direction", choices=("bn2en", "en2bn"))
    t.add_argument("text")
    t.add_argument("--fast", action="store_true")
    t.add_argument("--roundtrip_engine", choices=Options().engines, default=Options().roundtrip_engine)
    e = sub.add_parser("evaluate")
    e.add_argument("direction", choices=("bn2en", "en2bn"))
    e.add_argument("pairs")
    e.add_argument("results")
    e.add_argument("--rows", type=int)
    e.add_argument("--baseline_engine", choices=Options().engines, help="adds the mode baseline, by this engine alone")
    x = sub.add_parser("export")
    x.add_argument("rows")
    x.add_argument("table")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("banyan").getOrCreate()
    if a.command == "translate":
        rows = translate(spark.createDataFrame([(1, a.text)], "id long, text string"), a.direction, Options(roundtrip_engine=a.roundtrip_engine), fast_mode=a.fast)
        r = panel(rows, a.fast).first()
        print(r.final, r.panel, sep="\n\n")
    elif a.command == "evaluate":
        baseline = Options(roundtrip_engine=a.baseline_engine) if a.baseline_engine else None
        names = ("full", "single", "baseline") if baseline else ("full", "single")
        evaluate.run(spark, a.pairs, a.direction, a.results, max_rows=a.rows, names=names, baseline=baseline).show(truncate=False)
    else:
        sinks.export_table(spark.read.json(a.rows), a.table)


if __name__ == "__main__":
    main()
