"""Commands: normalize and validate folders of JSON documents."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from thicket.operators.events import write_events
from thicket.operators.order import registry_report
from thicket.operators.validate import first_violation
from thicket.plans.normalize import normalize
from thicket.plans.staging import send_modules
from thicket.sources import documents as D


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="thicket", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("normalize", help="merge, deduplicate, prune and order")
    one.add_argument("--in", "--input", dest="source", required=True)
    one.add_argument("--out", "--output", dest="target")
    one.add_argument("--emit-events", metavar="PATH", nargs="?", const="-", help="print the log, or write it to PATH, one JSON object a line")
    one.add_argument("--backup", action="store_true", help="copy the input first; needed to write over it")
    one.add_argument("--dry-run", action="store_true", help="write nothing but the log")
    two = commands.add_parser("validate", help="check schemas and invariants")
    two.add_argument("--in", "--input", dest="source", required=True)
    return top


def _checked(spark: SparkSession, source: str):
    docs = D.read_documents(spark, source)
    wrong = D.schema_violations(docs).orderBy("doc_id", "place").limit(20).collect()
    if wrong:
        raise SystemExit("\n".join(f"{r.doc_id}: {r.path}: {r.error}" for r in wrong))
    return docs


def run(spark: SparkSession, args: list[str]) -> int:
    given = parser().parse_args(args)
    send_modules(spark)
    if given.command == "validate":
        docs = _checked(spark, given.source)
        nodes = D.flatten(docs).withColumns({"new_parent": F.col("parent_id"), "position": F.col("child_pos")})
        bad = first_violation(nodes).orderBy("doc_id").limit(20).collect()
        if bad:
            raise SystemExit("\n".join(f"{r.doc_id}: {r.rule} at {r.label}" for r in bad))
        print("schemas: valid\ninvariants: hold")
        return 0
    if not given.dry_run:
        if not given.target:
            raise SystemExit("normalize needs --out unless --dry-run is given")
        if D.same_place(spark, given.source, given.target) and not given.backup:
            raise SystemExit("to write over the input, give --backup")
    source = given.source
    if given.backup:
        source = D.backup(spark, source)  # what is read must not be what is written
        print(source, file=sys.stderr)
    docs = _checked(spark, source)
    result = normalize(D.flatten(docs))
    if given.emit_events == "-":
        for r in result.events.orderBy("doc_id", "seq").select("payload").toLocalIterator():
            print(r["payload"])
    elif given.emit_events:
        write_events(result.events, given.emit_events)
    if not given.dry_run:
        D.write_documents(D.nest(docs, result.nodes), given.target, D.qualified(spark, source))
    for r in registry_report(result.registry).orderBy("doc_id", "place").toLocalIterator():
        print(f"{r['doc_id']}: {r['line']}", file=sys.stderr)
    total = result.stats.groupBy().sum().first().asDict()
    print(", ".join(f"{k[4:-1]}={v or 0}" for k, v in total.items()), file=sys.stderr)
    return 0


def main() -> None:
    sys.exit(run(SparkSession.builder.appName("thicket").getOrCreate(), sys.argv[1:]))


if __name__ == "__main__":
    main()
