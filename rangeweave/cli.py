"""``python -m rangeweave.cli PATH create-topic NAME | publish NAME KEY VALUE | consume NAME [--start] [--count] [--group]``."""

from __future__ import annotations

import argparse
import sys

from rangeweave.api import ConsumerConfig, StoragePolicy, connect


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rangeweave")
    top.add_argument("path")
    sub = top.add_subparsers(dest="command", required=True)
    create = sub.add_parser("create-topic")
    create.add_argument("name")
    create.add_argument("--retention-ms", type=int)
    create.add_argument("--fixed", action="store_true")
    publish = sub.add_parser("publish")
    publish.add_argument("name")
    publish.add_argument("key")
    publish.add_argument("value")
    consume = sub.add_parser("consume")
    consume.add_argument("name")
    consume.add_argument("--start", choices=["earliest", "latest"], default="latest")
    consume.add_argument("--count", type=int, default=0, help="0: no limit")
    consume.add_argument("--group")
    return top


def run(spark, arguments: list[str], out=sys.stdout) -> int:
    args = parser().parse_args(arguments)
    log = connect(spark, args.path)
    if args.command == "create-topic":
        done = log.create_topic(args.name, StoragePolicy(args.retention_ms, partition_strategy="Fixed" if args.fixed else "AutoSplit"))
        print("created" if done else "exists", file=out)
    elif args.command == "publish":
        at = log.append(args.name, spark.createDataFrame([(0, args.key.encode(), args.value.encode())], "seq long, key binary, value binary")).first()
        print(f"range {at.range_id} entry {at.entry_id}", file=out)
    else:
        rows = log.read_log(args.name, config=ConsumerConfig(start=args.start, group=args.group)).orderBy("range_id", "entry_id", "batch_offset")
        rows = rows.limit(args.count) if args.count else rows
        for r in rows.toLocalIterator():
            print(f"{bytes(r.key).decode(errors='replace')}\t{bytes(r.value).decode(errors='replace')}", file=out)
    return 0


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.exit(run(SparkSession.builder.appName("rangeweave").getOrCreate(), sys.argv[1:]))
