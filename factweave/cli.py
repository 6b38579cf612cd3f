"""Command line: ``python -m factweave.cli generate|run|demo``."""

from __future__ import annotations

import argparse
import sys
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import SparkSession

from factweave.operators.narrate import ProviderError
from factweave.plans.run import BAD_INPUT, RunConfig, run
from factweave.plans.spec import RegistryError, SourceSpec, load_registry, shop_registry
from factweave.sources.cells import SourceError, load_cells, write_cells_csv
from factweave.sources.digest import source_digest
from factweave.sources.synthetic import SHOP, generate_cells


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="factweave", description="Checked weekly reports from daily cells.")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("generate", "run", "demo"):
        p = sub.add_parser(name)
        p.add_argument("--as-of", type=date.fromisoformat, default=date(2024, 8, 15))
        p.add_argument("--out", required=True)
        if name != "run":
            p.add_argument("--seed", type=int, default=7)
            p.add_argument("--days", type=int, default=550)
        else:
            p.add_argument("--source", required=True)
            p.add_argument("--registry")
            p.add_argument("--brief")
            p.add_argument("--dims", default=",".join(SHOP.dims))
        if name != "generate":
            p.add_argument("--max-retries", type=int, default=2)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("factweave").getOrCreate()
    try:
        if args.command in ("generate", "demo"):
            cells = generate_cells(spark, args.as_of - timedelta(days=args.days), args.as_of - timedelta(days=1), seed=args.seed)
            if args.command == "generate":
                write_cells_csv(cells, args.out, SHOP)
                return 0
            return run(cells, shop_registry(*SHOP.dims), SHOP, RunConfig(args.as_of, args.out, max_retries=args.max_retries))
        spec = SourceSpec(dims=tuple(args.dims.split(",")))
        registry = load_registry(args.registry) if args.registry else shop_registry(*spec.dims)
        brief = Path(args.brief).read_text(encoding="utf-8") if args.brief else ""
        return run(load_cells(spark, args.source, spec), registry, spec, RunConfig(args.as_of, args.out, brief, args.max_retries), source_sha256=source_digest(spark, args.source))
    except (SourceError, RegistryError, ProviderError, OSError, UnicodeDecodeError) as e:
        print(f"factweave: {e}", file=sys.stderr)
        return BAD_INPUT


if __name__ == "__main__":
    sys.exit(main())
