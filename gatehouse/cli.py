"""Command line: ``qualify``, ``repair``, ``audit`` and ``list``.  Exit 0: passes, 1: fails, 2: cannot be judged."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gatehouse.operators import audits, screens
from gatehouse.operators.repair import AGENTS, repair, trajectory
from gatehouse.plans import registry
from gatehouse.sources import readers


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gatehouse")
    sub = top.add_subparsers(dest="command", required=True)
    q = sub.add_parser("qualify")
    q.add_argument("artifact")
    q.add_argument("-m", "--modality")
    q.add_argument("--json", action="store_true")
    for option in ("--ligand-resname", "--chain-a", "--chain-b"):
        q.add_argument(option)
    r = sub.add_parser("repair")
    r.add_argument("sequence")
    r.add_argument("-m", "--modality", choices=sorted(AGENTS), default="dna")
    r.add_argument("--rounds", type=int, default=8)
    r.add_argument("--clear", action="append", default=[])
    r.add_argument("--json", action="store_true")
    a = sub.add_parser("audit")
    a.add_argument("what", choices=["screen", "single-cell", "leakage"])
    a.add_argument("--input", required=True, help="a count table, a screen summary, or for leakage a table of pairs or of classified texts")
    a.add_argument("--benchmark", choices=["pairs", "classes"], default="pairs", help="leakage: columns a, b, label, a_seq, b_seq, or id, text, label")
    a.add_argument("--seeds", type=int, default=1)
    a.add_argument("--json", action="store_true")
    sub.add_parser("list")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "list":
        print("\n".join([*(f"{g.modality}: {' '.join(g.extensions)}" for g in registry.GATES.values()), "audit: screen, single-cell, leakage"]))
        return 0
    if args.command == "repair":
        done, reason, steps = repair(args.sequence.upper(), *AGENTS[args.modality], args.rounds, tuple(args.clear))
        rows = [{"round": s.round, "fired": s.fired, "score": s.score} for s in steps]
        print(json.dumps({"stop_reason": reason, "artifact": done, "steps": rows}) if args.json else f"{trajectory(steps, reason)}\n{done}")
        return int(reason != "converged")
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if args.command == "qualify":
            opts = {k: v for k, v in vars(args).items() if k in ("ligand_resname", "chain_a", "chain_b") and v}
            result = registry.qualify(spark, args.artifact, args.modality, **opts)
            for row in result.to_json().toLocalIterator():
                item = json.loads(row["json"])
                print(row["json"] if args.json else f"{'PASS' if item['ok'] else 'FAIL'} {item['name']} {[r['contract'] for r in item['reasons']]}")
            if result.batch is not None:
                for reason in result.batch.first()["reasons"]:
                    print(json.dumps({"set": reason.asDict()}) if args.json else f"SET {reason['contract']}")
            return int(not result.verdict().first()["ok"])
        if args.what == "leakage":
            header = spark.read.text(args.input).first()
            if header is None:
                raise readers.SourceError(f"empty table: {args.input}")
            table = spark.read.csv(args.input, header=True, sep="\t" if "\t" in header[0] else ",")
            needed = ["a", "b", "label", "a_seq", "b_seq"] if args.benchmark == "pairs" else ["id", "text", "label"]
            if missing := [c for c in needed if c not in table.columns]:
                raise readers.SourceError(f"no column {', '.join(missing)} in {args.input}")
            report = audits.leakage_report(table, args.benchmark, args.seeds).first().asDict()
            print(json.dumps(report) if args.json else "\n".join(f"{k}: {v}" for k, v in report.items()))
            return 0
        if args.what == "single-cell":
            print(screens.single_cell_audit(readers.user_screen(spark, args.input).where("not is_control")).toJSON().first())
            return 0
        guides = screens.guide_stats(readers.counts(spark, args.input))
        controls = F.lower("gene").isin(readers.CONTROL_TARGETS)  # without controls the band is unbounded
        report = screens.reliability(guides, screens.dispersion_limit(guides), screens.null_band(guides, controls))
        for line in report.toJSON().toLocalIterator():
            print(line)
        return 0
    except (registry.QualifyError, readers.SourceError, PySparkException) as e:
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
