"""Command line: write a configuration, analyse coordinate files, track their cages."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from latticework.operators.reports import select_targets, target_events
from latticework.session import PRESETS, Config, Session
from latticework.shipping import ship
from latticework.sources.files import split_failed, write_tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="latticework", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    init = commands.add_parser("init", help="write the default configuration")
    init.add_argument("path")
    for name in ("analyze", "track"):
        sub = commands.add_parser(name)
        sub.add_argument("input", help="file, folder or glob that Spark can read")
        sub.add_argument("output", help="folder for the tables; it must not exist")
        sub.add_argument("--config", help="YAML or JSON file")
        sub.add_argument("--pattern", help="names of files within a folder")
        sub.add_argument("--recursive", action="store_true")
        sub.add_argument("--mode", choices=("auto", "oo", "hbond"))
        sub.add_argument("--preset", choices=tuple(PRESETS))
        sub.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="a setting, as JSON or text; may be repeated")
        sub.add_argument("--keep-going", action="store_true", help="report frames that can't be read instead of failing")
        sub.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    sub.add_argument("--target", default="all", help="all, a track such as t12, or a cage type")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "init":
        with open(args.path, "x", encoding="utf-8") as file:
            file.write(Config().resolved())
        return 0
    given = dict(x.partition("=")[::2] for x in args.set)
    overrides = {k: _value(v) for k, v in given.items()} | ({"mode": args.mode} if args.mode else {})
    config = Config.load(Path(args.config).read_text(encoding="utf-8") if args.config else "", args.preset, **overrides)
    spark = SparkSession.builder.appName("latticework").getOrCreate()
    ship(spark)
    session = Session(spark, config)
    atoms, failed = split_failed(session.read_frames(args.input, pattern=args.pattern, recursive=args.recursive, lenient=args.keep_going))
    tables = session.analyze(atoms)
    if args.command == "track":
        tables = session.track(tables, atoms)
        tables["observations"] = select_targets(tables["observations"], args.target)
        tables["events"] = target_events(tables["events"], tables["observations"])
    else:
        tables |= {f"report_{n}": t for n, t in session.report(tables, atoms, failed if args.keep_going else None).items()}
    tables["config"] = spark.createDataFrame(config.rows(), "key string, value string")
    write_tables(tables, args.output, args.format)
    return 0


def _value(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return text


if __name__ == "__main__":
    raise SystemExit(main())
