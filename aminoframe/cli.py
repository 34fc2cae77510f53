"""The command line: list, describe, init-config, validate-config, compute.

Exit codes: 0 done, 2 usage or configuration, 3 data or files, 4 anything else.
"""

from __future__ import annotations

import argparse
import json
import sys
import traceback
from pathlib import Path

from . import __version__
from .config import default_config, load_config, validate_config
from .errors import IdColumnError, SequenceError
from .operators import REGISTRY
from .provenance import RunRecord


class Usage(Exception):
    pass


def _chosen(args: argparse.Namespace) -> list[str]:
    """Sorted names of all, of families and of single descriptors."""
    names = set(REGISTRY) if args.all else {n for n, c in REGISTRY.items() if c.family in args.family} | set(args.descriptor)
    if unknown := sorted(names - set(REGISTRY)) + sorted(set(args.family) - {c.family for c in REGISTRY.values()}):
        raise Usage(f"unknown descriptors: {', '.join(unknown)}")
    return sorted(names)


def _list(args: argparse.Namespace) -> None:
    shown = {n: c for n, c in sorted(REGISTRY.items()) if not args.family or c.family in args.family}
    for family in sorted({c.family for c in shown.values()}):
        print(family)
        for name, cls in shown.items():
            if cls.family == family:
                print(f"  {name:28} {(cls.__doc__ or '').strip().splitlines()[0] if cls.__doc__ else ''}")
    if not shown:
        print("No descriptors registered.")


def _describe(args: argparse.Namespace) -> None:
    if args.name not in REGISTRY:
        raise Usage(f"unknown descriptor: {args.name}")
    cls = REGISTRY[args.name]
    columns = cls().columns()
    print(f"{cls.name} ({cls.family})\n{(cls.__doc__ or '').strip()}\n\nParameters:")
    for key, p in cls.parameters().items():
        print(f"  {key}: {p.annotation} = {p.default!r}")
    print(f"\nColumns ({len(columns)}):\n  " + "\n  ".join(f"{cls.name}_{c}" for c in columns))


def _init(args: argparse.Namespace) -> None:
    names = _chosen(args)
    if not names:
        raise Usage("name descriptors with --all, -d or -f")
    text = default_config(names)
    if args.output:
        Path(args.output).write_text(text, encoding="utf-8")
        print(f"Config written to {args.output}")
    else:
        sys.stdout.write(text)


def _validate(args: argparse.Namespace) -> int:
    issues = validate_config(args.config)
    if args.json:
        print(json.dumps([{"path": i.path, "message": i.message} for i in issues]))
    else:
        print("\n".join(f"{i.path or '(file)'}: {i.message}" for i in issues) or "The configuration is valid.")
    return 2 if issues else 0


def _compute(args: argparse.Namespace) -> None:
    if args.config:
        if args.all or args.descriptor or args.family:
            raise Usage("--config stands alone, without --all, -d or -f")
        try:
            given = load_config(args.config)
        except ValueError as e:
            raise Usage(str(e)) from e
    else:
        given = {n: {} for n in _chosen(args)}
        if not given:
            raise Usage("name descriptors with --config, --all, -d or -f")
    parameters = {n: REGISTRY[n].defaults() | p for n, p in given.items()}
    record = RunRecord("compute", {"descriptors": parameters, "seq_col": args.seq_col, "id_col": args.id_col})
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException
    from pyspark.sql import Observation, SparkSession
    from pyspark.sql import functions as F

    from .plans.engine import compute, make
    from .sources.tables import read_sequences, write_table

    spark = SparkSession.builder.appName("aminoframe").config("spark.ui.showConsoleProgress", str(not args.no_progress).lower()).getOrCreate()
    try:
        rows = read_sequences(spark, args.input, args.seq_col, args.id_col)
        result = compute(rows, make(given, given))
        counted, n = Observation(), F.count(F.lit(1)).alias("n_rows")
        write_table(result.observe(counted, n), args.output, single_file=not args.parts)
        n_rows = counted.get["n_rows"]
    except IdColumnError as e:
        raise Usage(str(e)) from e
    except (PySparkException, Py4JJavaError) as e:
        raise SequenceError(f"{args.input}: {str(e)[:300]}") from e
    record.took(spark, args.input)
    record.made(spark, args.output, n_rows, len(result.columns) - 1)
    record.keep(spark)
    print(f"{n_rows} records, {len(result.columns) - 1} features: {args.output}")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="aminoframe", description="Numeric features of protein sequences, computed by Spark.")
    parser.add_argument("--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)

    def selectors(p: argparse.ArgumentParser) -> None:
        p.add_argument("--all", action="store_true")
        p.add_argument("-d", "--descriptor", action="append", default=[])
        p.add_argument("-f", "--family", action="append", default=[])

    p = commands.add_parser("list")
    p.add_argument("-f", "--family", action="append", default=[])
    p.set_defaults(run=_list)
    p = commands.add_parser("describe")
    p.add_argument("name")
    p.set_defaults(run=_describe)
    p = commands.add_parser("init-config")
    selectors(p)
    p.add_argument("-o", "--output")
    p.set_defaults(run=_init)
    p = commands.add_parser("validate-config")
    p.add_argument("config")
    p.add_argument("--json", action="store_true")
    p.set_defaults(run=_validate)
    p = commands.add_parser("compute")
    p.add_argument("input")
    selectors(p)
    p.add_argument("--config")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--seq-col", default="sequence")
    p.add_argument("--id-col", default="id")
    p.add_argument("--parts", action="store_true", help="write a folder of part files instead of one file")
    p.add_argument("--no-progress", action="store_true")
    p.set_defaults(run=_compute)
    return parser


def main(argv: list[str] | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return args.run(args) or 0
    except Usage as e:
        print(f"Error: {e}", file=sys.stderr)
        return 2
    except (SequenceError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 3
    except Exception:
        traceback.print_exc()
        return 4


if __name__ == "__main__":
    sys.exit(main())
