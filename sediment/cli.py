"""Command line: backup, list, restore, info, verify, delete, migrate, benchmark."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from sediment.config import BackupOptions, ChunkConfig, SimilarityConfig
from sediment.errors import SedimentError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sediment", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, args in {
        "backup": ["path", "store"], "list": ["store"], "restore": ["store", "dest"], "info": ["store"],
        "verify": ["store"], "delete": ["store", "name"], "migrate": ["source", "store"], "benchmark": ["path"],
    }.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        if name in ("backup", "benchmark"):
            p.add_argument("--chunk-size", type=int, default=32768)
            p.add_argument("--threshold", type=float, default=0.7)
            p.add_argument("--level", type=int, default=3)
            p.add_argument("--force", action="store_true")
        if name in ("restore", "verify"):
            p.add_argument("--file")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sediment").getOrCreate()
    try:
        return run(args, spark)
    except SedimentError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    from sediment.operators import manifest as m
    from sediment.plans import backup as b
    from sediment.session import scratch_path
    from sediment.sources.files import read_files
    from sediment.sources.store import ChunkStore

    def show(rows) -> None:
        for r in rows.toLocalIterator():
            print(json.dumps(r.asDict(), default=str))

    store = ChunkStore(spark, args.store if "store" in args else scratch_path(spark, "benchmark"))
    if args.command in ("backup", "benchmark"):
        options = BackupOptions(ChunkConfig.from_chunk_size(args.chunk_size), SimilarityConfig(args.threshold), args.level, args.force)
        began = time.time()
        stats = b.backup(read_files(spark, args.path), store, options)
        show(stats)
        if args.command == "benchmark":
            size = stats.agg({"source_size": "sum"}).first()[0] or 0
            print(json.dumps({"seconds": round(time.time() - began, 3), "mb_per_s": round(size / 1e6 / (time.time() - began), 3)}))
    elif args.command == "list":
        show(m.list_files(store.manifests()))
    elif args.command == "info":
        show(m.store_info(store.manifests()))
    elif args.command == "restore":
        print(b.restore(store, args.dest, args.file))
    elif args.command == "verify":
        report, errors = b.verify(store, args.file)
        show(report)
        show(errors)
        return 0 if report.first()["ok"] else 1
    elif args.command == "delete":
        b.delete_file(store, args.name)
    elif args.command == "migrate":
        print(json.dumps(b.migrate(ChunkStore(spark, args.source), store)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
