"""Commands: check, format, rules, explain, baseline, init, schema, hotspots, debt, trend, serve.

Exit codes: 0 well, 1 findings (or debt) over the limit, 2 wrong use or failure, 3 files that ``format --check`` would change.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from tessera import config as cfg
from tessera import rules as known
from tessera.operators.findings import SEVERITIES, SPELLINGS


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("check", "baseline"):
        p = sub.add_parser(name)
        p.add_argument("path", nargs="?", default=".")
        p.add_argument("--format", choices=("console", "json", "sarif"), default="console")
        p.add_argument("--fail-on", choices=SEVERITIES[1:], default="error")
        p.add_argument("--no-baseline", action="store_true")
        p.add_argument("--output")
    for name, flags in (("format", ()), ("hotspots", ("days", "top")), ("debt", ("days", "top")), ("trend", ("limit",)), ("serve", ())):
        p = sub.add_parser(name)
        p.add_argument("path", nargs="?", default=".")
        for flag in flags:
            p.add_argument(f"--{flag}", type=int, default={"days": 180, "top": 20, "limit": 20}[flag])
    sub.choices["format"].add_argument("--check", action="store_true")
    sub.choices["debt"].add_argument("--fail-over", type=lambda x: int(x.removesuffix("d")))
    sub.add_parser("rules").add_argument("--format", choices=("console", "json"), default="console")
    sub.add_parser("explain").add_argument("rule")
    sub.add_parser("schema")
    sub.add_parser("init").add_argument("--force", action="store_true")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if args.command == "rules":
        if args.format == "json":
            print(json.dumps([dict(zip(("id", "category", "severity", "scope", "title"), r, strict=True)) for r in sorted(known.TABLE)], indent=2))
        else:
            print("\n".join(f"{r[0]:9} {r[2]:12} {r[3]:10} {r[1]:16} {r[4]}" for r in sorted(known.TABLE)))
        return 0
    if args.command == "explain":
        row = next((r for r in known.TABLE if r[0].lower() == args.rule.lower()), None)
        if row is None:
            print(f"unknown rule '{args.rule}'" + cfg.did_you_mean(args.rule, known.CATEGORIES), file=sys.stderr)
            return 2
        print(f"{row[0]} {row[4]}\ncategory {row[1]}, severity {row[2]}\nto suppress: lens-ignore[{row[0]}] on the line or the one before, or lens-ignore-file[{row[0]}]")
        return 0
    if args.command == "schema":
        print(json.dumps(cfg.schema(known.CATEGORIES, SEVERITIES), indent=2))
        return 0
    if args.command == "init":
        try:
            cfg.scaffold(".", known.CATEGORIES, SEVERITIES, args.force)
        except FileExistsError as e:
            print(f"{e} exists; --force replaces it", file=sys.stderr)
            return 2
        return 0
    try:
        return {"format": lay_out, "hotspots": insight, "debt": insight, "trend": insight, "serve": serve}.get(args.command, analyse)(args)
    except Exception as e:  # the exit code tells callers
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tessera").getOrCreate()


def serve(args: argparse.Namespace) -> int:
    from tessera.session import Session

    Session(session(), args.path).serve(sys.stdin, sys.stdout)
    return 0


def lay_out(args: argparse.Namespace) -> int:
    """Formats the SQL files; with --check it tells which ones would change."""
    from tessera.parse import nodes
    from tessera.sources import files as src

    spark, root = session(), Path(args.path).resolve()
    files = src.read_workspace(spark, str(root), tuple(cfg.load(args.path).exclude)).where("language = 'sql'")
    changed = files.join(nodes.sql_layouts(files), "file_id").where("changed").select("path", "formatted", "inline_comments").orderBy("path")
    n = 0
    for r in changed.toLocalIterator():
        n += 1
        print(f"{r.path}{' (has comments inside statements)' if r.inline_comments else ''}")
        if not args.check:
            (root / r.path).write_text(r.formatted, encoding="utf-8")
    return 3 if args.check and n else 0


def insight(args: argparse.Namespace) -> int:
    """Hotspots, debt or trend of a repository, as tab-separated rows."""
    from pyspark.sql import functions as F

    from tessera.operators import code_rules, insights
    from tessera.parse import nodes
    from tessera.sources import files as src
    from tessera.sources import commits, git

    spark, config, root = session(), cfg.load(args.path), Path(args.path).resolve()
    now = F.current_timestamp()
    top = git.repository_root(str(root)) or str(root)
    below = os.path.relpath(root, os.path.realpath(top)).replace(os.sep, "/")
    at_root = lambda name: name if below == "." else f"{below}/{name}"
    changed = commits.changes(spark, top)
    # paths are told from the folder that was asked for
    touched = changed.select("hash", "ts", F.col("file") if below == "." else F.when(F.col("file").startswith(f"{below}/"), F.substring("file", len(below) + 2, 1 << 20)).alias("file")).where("file is not null")
    saved = config.baseline or cfg.BASELINE
    if args.command == "trend":
        own = commits.followed(changed).where(F.col("file") == at_root(saved)).select("hash", "ts", "blob")
        text = commits.texts(own.select("blob").distinct(), top).withColumnRenamed("blob", "_blob")
        rows = own.join(text, F.col("blob") == F.col("_blob")).select(F.col("hash").alias("revision"), F.col("ts").alias("at"), "text")
        out = insights.summarised(insights.selected(rows, args.limit))
        for r in out.orderBy("at").collect():
            print(f"{r.at:%Y-%m-%d}\t{r.revision[:8]}\t{r.total}\t{r.delta:+d}\t{json.dumps(r.by_rule, sort_keys=True)}")
        return 0
    recent = insights.churn(touched, now - F.expr(f"interval {args.days} days"))
    if args.command == "hotspots":
        files = src.read_workspace(spark, str(root), tuple(config.exclude)).where("language = 'csharp'")
        score = code_rules.complexity(nodes.csharp_nodes(files)).groupBy("file_id").agg(F.sum("score").alias("complexity"))
        ranked = insights.hotspots(score.join(files.select("file_id", F.col("path").alias("file")), "file_id").select("file", "complexity"), recent, args.top)
        for r in ranked.collect():
            print(f"{r.score}\t{r.complexity}\t{r.churn}\t{r.file}")
        return 0
    entries, message = cfg.read_entries(root / saved)
    if message:
        print(message, file=sys.stderr)
    rows = spark.createDataFrame([(e["fingerprint"], e.get("ruleId"), e.get("file")) for e in entries], "fingerprint string, rule_id string, file string")
    own = commits.followed(changed).where(F.col("file") == at_root(saved))
    text = commits.texts(own.select(F.explode(F.array("old_blob", "blob")).alias("blob")).distinct(), top)
    needles = rows.select("fingerprint", F.lit(at_root(saved)).alias("file"), F.col("fingerprint").alias("needle"))
    since = commits.introduced(commits.pickaxe(own, needles, text))
    churn = rows.join(recent, "file").select("fingerprint", "churn")
    debts = insights.debt(rows, since, churn, now)
    for r in insights.ranked(debts, args.top).withColumn("age", insights.format_age(F.col("age_days"))).collect():
        print(f"{r.score}\t{r.age}\t{r.churn}\t{r.rule_id}\t{r.file}")
    return int(args.fail_over is not None and not insights.over_age(debts, args.fail_over).isEmpty())


def analyse(args: argparse.Namespace) -> int:
    from tessera import engine
    from tessera.operators import reports
    from tessera.sources import files as src

    spark = session()
    config = cfg.load(args.path)
    for m in cfg.validate(config, known.CATEGORIES, SEVERITIES, SPELLINGS):
        print(m, file=sys.stderr)
    saved = Path(args.path) / (config.baseline or cfg.BASELINE)
    accepted = None
    if args.command == "check" and not args.no_baseline:
        prints, message = cfg.read_baseline(saved)
        if message:
            print(message, file=sys.stderr)
        accepted = spark.createDataFrame([(x,) for x in prints], "fingerprint string") if prints else None
    result = engine.check(src.read_workspace(spark, str(Path(args.path).resolve()), tuple(config.exclude)), config, accepted)
    if args.command == "baseline":
        rows = [r.value for r in reports.baseline_rows(result.findings).toLocalIterator()]
        saved.write_text("[" + ",\n ".join(rows) + "]\n", encoding="utf-8")
        return 0
    out = open(args.output, "w", encoding="utf-8") if args.output else sys.stdout
    if args.format == "sarif":
        out.writelines(reports.sarif(result.findings, {r[0]: r[4] for r in known.TABLE}))
    elif args.format == "json":
        out.writelines(reports.report(result.findings, result.baselined, result.skipped, result.diagnostics))
    else:
        out.writelines(line + "\n" for line in reports.console(result.findings, result.baselined.count(), result.failed))
    if args.output:
        out.close()
    return reports.exit_code(result.findings, args.fail_on)


if __name__ == "__main__":
    sys.exit(main())
