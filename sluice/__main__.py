"""Command line: check and plan pipelines, run their tasks, report, reset.

Exit status: 0 done, 1 a task failed, 2 the command can't be used so.
"""

from __future__ import annotations

import argparse
import sys
import uuid
from collections.abc import Sequence

from sluice.plans import graph
from sluice.plans.spec import Pipeline, SpecError, load_all


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sluice", description=__doc__)
    parser.add_argument("--pipelines", help="folder of pipeline documents")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("validate-metadata", help="check every pipeline document")
    for name, text in (("plan", "show tasks"), ("run", "run tasks"), ("report", "report on a run"), ("reset", "forget a table's validation")):
        own = sub.add_parser(name, help=text)
        own.add_argument("--pipeline", required=True)
        if name in ("run", "reset"):
            own.add_argument("--table", required=name == "reset")
        if name in ("run", "report"):
            own.add_argument("--run-id", default=None if name == "report" else uuid.uuid4().hex, required=name == "report")
        if name == "run":
            own.add_argument("--stage", choices=(graph.EXTRACT, graph.VALIDATE))
            own.add_argument("--threshold", type=float, help="accept a batch with up to this share of invalid rows")
        if name == "reset":
            own.add_argument("--yes", action="store_true", help="really delete")
    return parser


def _tasks(args: argparse.Namespace, pipeline: Pipeline) -> int:
    from sluice.audit import Entry
    from sluice.extract import run_extract
    from sluice.layout import Settings
    from sluice.runner import reset, run_pipeline, run_report
    from sluice.session import session
    from sluice.streaming.validate import run_validate

    spark, settings = session(f"sluice {pipeline.name}"), Settings.from_env()
    entries: list[Entry] = []
    if args.command == "reset":
        for path in reset(spark, pipeline, args.table, settings):
            print(f"deleted {path}")
    elif args.command == "report":
        entries.append(run_report(spark, pipeline, args.run_id, settings))
    elif args.table:
        feed = pipeline.feeds[args.table]
        if args.stage != graph.VALIDATE:
            entries.append(run_extract(spark, pipeline, feed, args.run_id, settings))
        if args.stage != graph.EXTRACT and all(e.healthy for e in entries):
            entries += run_validate(spark, pipeline, feed, args.run_id, settings, threshold=args.threshold)
    else:
        entries += [e for done in run_pipeline(spark, pipeline, args.run_id, settings, threshold=args.threshold).values() for e in done.entries]
    for entry in entries:
        print(entry.line())
    return 0 if all(e.healthy for e in entries) else 1


def main(argv: Sequence[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        found = load_all(args.pipelines)
        if args.command == "validate-metadata":
            for p in found.values():
                print(f"{p.name}: {len(p.feeds)} table(s), {sum(len(f.rules) for f in p.feeds.values())} rule(s)")
            return 0
        if args.pipeline not in found:
            print(f"no pipeline '{args.pipeline}', only {', '.join(found)}", file=sys.stderr)
            return 2
        pipeline = found[args.pipeline]
        if args.command == "plan":
            for name, task in graph.schedule(pipeline).items():
                print(f"{name} <- {', '.join(task['after']) or '-'}\n    {task['command']}")
            return 0
        if getattr(args, "table", None) and args.table not in pipeline.feeds:
            print(f"no table '{args.table}', only {', '.join(pipeline.feeds)}", file=sys.stderr)
            return 2
        if args.command == "reset" and not args.yes:
            print("reset deletes silver, quarantine and the checkpoint of the table; add --yes", file=sys.stderr)
            return 2
    except SpecError as fault:
        print(fault, file=sys.stderr)
        return 1
    return _tasks(args, pipeline)


if __name__ == "__main__":
    sys.exit(main())
