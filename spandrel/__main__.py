"""python -m spandrel COMMAND [options]: the entry points of spandrel.plans.api on a folder."""

from __future__ import annotations

import argparse
import importlib
import sys


def _function(name: str):
    """What package.module:function names."""
    module, _, attribute = name.partition(":")
    try:
        return getattr(importlib.import_module(module), attribute)
    except (ImportError, AttributeError) as error:
        raise argparse.ArgumentTypeError(f"no such function: {name}") from error


def _ask(candidates: list) -> list[str]:
    """The targets that the user names, by number."""
    for k, (path, reasons) in enumerate(candidates, 1):
        print(f"{k}. {path} ({', '.join(reasons)})")
    picked = {int(x) for x in input("Which (numbers)? ").replace(",", " ").split() if x.isdigit()}
    return [path for k, (path, _) in enumerate(candidates, 1) if k in picked]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spandrel")
    parser.add_argument("--root", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("plan", "update"):
        c = commands.add_parser(name)
        c.add_argument("--base")
        c.add_argument("--head", default="HEAD")
        c.add_argument("--budget", type=int)
        c.add_argument("--json", action="store_true")
        c.add_argument("--target")
        c.add_argument("--write", action="store_true")
        c.add_argument("--strict", action="store_true", help="refuse a document that has warnings")
        c.add_argument("--all", action="store_true", help="every target, where there are several")
        c.add_argument("--model", type=_function, help="package.module:function, from a prompt to a text")
    c = commands.add_parser("check")
    c.add_argument("target")
    c.add_argument("--since", default="HEAD~5")
    c.add_argument("--prove", action="store_true", help="parse each changed source")
    c.add_argument("--directory", default="", help="only what changed below it counts")
    c = commands.add_parser("score")
    c.add_argument("--style", choices=("text", "markdown", "json"), default="text")
    c.add_argument("--min", type=int, default=0)
    for name in ("readme", "api", "diagram", "annotate"):
        c = commands.add_parser(name)
        c.add_argument("--name", default="project")
        c.add_argument("--model", type=_function)
        c.add_argument("--strict", action="store_true")
    c = commands.add_parser("watch")
    c.add_argument("--target", default="README.md")
    c.add_argument("--name", default="project")
    c.add_argument("--once", action="store_true", help="only what is there now")
    c = commands.add_parser("changelog")
    c.add_argument("version")
    c.add_argument("--since", required=True)
    c.add_argument("--model", type=_function)
    c.add_argument("--strict", action="store_true")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from spandrel.operators import annotate, generate, parse, score
    from spandrel.plans import api
    from spandrel.sources import files

    spark = SparkSession.builder.appName("spandrel").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.command in ("plan", "update"):
            config = api.Config.load(args.root, budget=args.budget)
            if args.command == "update":
                for path, content in api.update(spark, args.root, args.base, args.head, args.target, args.model, args.write, config, args.strict, every=args.all, choose=_ask if sys.stdin.isatty() else None).items():
                    print(path if args.write else content)
                return 0
            plan = api.plan(spark, args.root, args.base, args.head, config)
            if args.json:
                for piece in plan.json_parts():
                    sys.stdout.write(piece)
                print()
                return 0
            print(api.describe(plan, files.read_documentation(spark, args.root, config.output_dir).select("path")))
        elif args.command == "check":
            row, code = api.check(spark, args.root, args.target, args.since, prove=args.prove, directory=args.directory)
            print(row["message"])
            return code
        elif args.command == "score":
            scores = api.score_folder(spark, args.root).cache()
            if args.style == "json":
                print(score.report(scores, args.style).first().report)
            else:
                for row in generate.placed(score.report_fragments(scores, args.style)).orderBy("position").toLocalIterator():
                    print(row.text)
            return int(scores.where("is_total").first().coverage < args.min)
        elif args.command == "watch":
            import uuid

            from spandrel.sources import shared
            from spandrel.streaming import watch

            config = api.Config.load(args.root)
            again = lambda rows, number: api.regenerate_readme(spark, args.root, args.target, args.name)
            # a watch begins anew each time; what is there at the start is no change, unless that is all that is asked for
            state = f"{shared.folder(spark)}/watch-{uuid.uuid4().hex}"
            watch.watch(spark, args.root, again, state, once=args.once, existing=args.once, include=list(config.include), exclude=list(config.exclude), attempts=watch.ATTEMPTS).awaitTermination()
        elif args.command == "annotate":
            lost = parse.undocumented_functions(api.analyze_folder(spark, args.root))
            config = api.Config.load(args.root)
            sources = files.read_sources(spark, args.root, list(config.include), list(config.exclude))
            out = annotate.annotate(sources, lost, api.generate_comments(spark, args.root, args.model, config))
            for row in out.join(lost.select("path").distinct(), "path", "left_semi").toLocalIterator():
                print(row.content)
        else:
            more = {"version": args.version, "since": args.since} if args.command == "changelog" else {"name": args.name}
            print(api.generate_document(spark, args.root, args.command, args.model, strict=args.strict, **more))
    except api.PlanError as error:
        print(f"{error.code}: {error}", file=sys.stderr)
        return 1
    except ValueError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
