"""Command line: python -m ferrymass generate cost|marginal and solve classical|quantum, over Parquet tables."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrymass.api import SolverConfig, solve
from ferrymass.sources import generate


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ferrymass", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    made = commands.add_parser("generate", help="write a cost or a marginal").add_subparsers(dest="kind_of", required=True)
    cost = made.add_parser("cost")
    cost.add_argument("--n", type=int, required=True)
    cost.add_argument("--marginals", type=int, default=2)
    cost.add_argument("--kind", choices=("euclidean", "weak-coulomb", "strong-coulomb"), default="euclidean")
    cost.add_argument("--diagonal-penalty", type=float, default=1e6)
    marginal = made.add_parser("marginal")
    marginal.add_argument("--n", type=int, required=True)
    marginal.add_argument("--loc", action="append", type=float, default=[])
    marginal.add_argument("--scale", action="append", type=float, default=[])
    marginal.add_argument("--lower", type=float, default=-5.0)
    marginal.add_argument("--upper", type=float, default=5.0)
    solved = commands.add_parser("solve", help="solve problems given as tables").add_subparsers(dest="problem", required=True)
    for name, kinds in (("classical", ("shannon", "quadratic")), ("quantum", ("quadratic", "von_neumann"))):
        one = solved.add_parser(name)
        one.add_argument("--cost", required=True, help="Parquet table: (problem, i, j, c) or i0, i1, ...; packed rows for quantum problems")
        one.add_argument("--marginal", action="append", default=[], help="Parquet table (problem, axis's index, mass); once for each marginal")
        one.add_argument("--regularizer", choices=kinds, default=kinds[0])
        one.add_argument("--epsilon", type=float, required=True)
        one.add_argument("--tolerance", type=float, default=1e-8)
        one.add_argument("--max-iterations", type=int, default=50_000)
    for leaf in (cost, marginal, *solved.choices.values()):
        leaf.add_argument("--output", required=True, help="folder of the result")
    return top


def _solve(spark: SparkSession, args: argparse.Namespace) -> dict:
    config = SolverConfig(args.epsilon, args.tolerance, args.max_iterations)
    began = time.perf_counter()
    result = solve(spark.read.parquet(args.cost), [spark.read.parquet(m) for m in args.marginal], config, args.problem, args.regularizer)
    told = [c for c in ("problem", "error", "iterations", "status") if c in result.columns]
    metadata = {k: getattr(args, k) for k in ("problem", "regularizer", "epsilon", "tolerance", "max_iterations")}
    result.write.mode("overwrite").parquet(f"{args.output}/coupling")
    written = spark.read.parquet(f"{args.output}/coupling")
    diagnostics = written.select(*told).distinct().withColumn("metadata", F.lit(json.dumps(metadata, sort_keys=True)))
    diagnostics.write.mode("overwrite").parquet(f"{args.output}/diagnostics")
    ended = spark.read.parquet(f"{args.output}/diagnostics").groupBy("status").count().collect()
    return {"output": args.output, "problems": {str(r["status"]): r["count"] for r in ended}, "elapsed_seconds": time.perf_counter() - began}


def _generate(spark: SparkSession, args: argparse.Namespace) -> dict:
    out: DataFrame
    if args.kind_of == "cost":
        out = generate.cost_tensor(spark, args.n, args.marginals, args.kind, args.diagonal_penalty)
    else:
        out = generate.gaussian_marginal(spark, args.n, args.loc or [0.0], args.scale or [1.0], args.lower, args.upper)
    out.write.mode("overwrite").parquet(args.output)
    return {"output": args.output, "rows": args.n ** getattr(args, "marginals", 1)}


def main(argv: list[str] | None = None) -> dict:
    """Runs one command, prints its summary as a line of JSON and returns it."""
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("ferrymass").getOrCreate()
    summary = _solve(spark, args) if args.command == "solve" else _generate(spark, args)
    print(json.dumps(summary, sort_keys=True))
    return summary


if __name__ == "__main__":
    main()
