"""The six commands on files: python -m labelweave neten|pcc|prop|tune|pred|report --help."""

from __future__ import annotations

import argparse
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.operators import similarity
from labelweave.plans import commands, tuning
from labelweave.sources import tsv


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="labelweave", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        one = sub.add_parser(name, help=text)
        one.add_argument("--out", required=True, help="folder for the results")
        return one

    one = command("neten", "denoise a network")
    one.add_argument("--network", required=True)
    one = command("pcc", "correlate all rows, or all columns, of a matrix")
    one.add_argument("--matrix", required=True)
    one.add_argument("--columns", action="store_true")
    spread = argparse.ArgumentParser(add_help=False)
    spread.add_argument("--networks", required=True, help="files, comma-separated")
    spread.add_argument("--labels", required=True, help="matrix of training genes x labels")
    spread.add_argument("--genes", required=True, help="test genes, one a line")
    spread.add_argument("--header", action="store_true", help="the first line of --genes is a header")
    spread.add_argument("--method", choices=("rwr", "dlp"), default="rwr")
    spread.add_argument("--alpha", type=float, default=0.2)
    spread.add_argument("--relative", action="store_true", help="divide by the walk without restart")
    spread.add_argument("--complete", action="store_true", help="complete each network by the mean of all")
    for name, text in (("prop", "propagate labels over networks"), ("tune", "choose settings and predict"), ("pred", "predict with fixed settings")):
        one = sub.add_parser(name, help=text, parents=[spread])
        one.add_argument("--out", required=True, help="folder for the results")
        if name == "prop":
            one.add_argument("--prior", help="square matrix of similarities between genes")
            continue
        one.add_argument("--folds", type=int, default=2)
        one.add_argument("--objective", type=int, choices=range(1, 7), default=1)
        one.add_argument("--cut", type=int, default=3)
        one.add_argument("--neighbours", type=int, default=0, help="correct by so many neighbours")
        one.add_argument("--beta", type=float, default=1.0)
        one.add_argument("--trim", action="store_true")
        one.add_argument("--regularised", action="store_true", help="project labels by regularised correlation")
        one.add_argument("--refill", action="store_true", help="keep features that a fold lacks, as zeros")
        one.add_argument("--verbose", action="store_true", help="write measures, relations and training scores too")
        if name == "tune":
            one.add_argument("--auto-beta", action="store_true")
            one.add_argument("--per-label", action="store_true")
            one.add_argument("--oversample", type=float, default=0.0)
            one.add_argument("--k", type=float, nargs=3, default=(0.1, 0.9, 1), metavar=("LOW", "HIGH", "STEPS"))
            one.add_argument("--lam", type=float, nargs=3, default=(0.0, 0.2, 8), metavar=("LOW", "HIGH", "STEPS"))
        else:
            one.add_argument("--k", type=int, default=None)
            one.add_argument("--lam", type=float, default=0.1)
    one = command("report", "measure predictions")
    one.add_argument("--truth", required=True)
    one.add_argument("--scores", required=True)
    one.add_argument("--cut", type=int, default=3)
    return top


def _labels(spark: SparkSession, path: str) -> DataFrame:
    return tsv.read_matrix(spark, path).select(F.col("row").alias("gene"), F.col("col").alias("label"), F.col("value").alias("y"))


def _table(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, sep="\t", header=True, mode="overwrite")


def _results(found: tuning.Tuned, labels: DataFrame, out: str, verbose: bool) -> None:
    """The predictions; with verbose also measures, settings, thresholds, label relations, order, and training scores raw and calibrated."""
    tsv.write_matrix(found.predictions, f"{out}/test.prob", "gene", "label", "p")
    if not verbose:
        return
    for name in ("measures", "areas", "chosen", "thresholds", "order"):
        _table(getattr(found, name), f"{out}/{name}")
    relation = similarity.label_relationship(labels)
    for name in ("positive", "negative"):
        tsv.write_matrix(relation, f"{out}/{name}.relation", "k", "j", name)
    for name, column in (("train.raw", "raw"), ("train.prob", "p"), ("train.label", "y")):
        tsv.write_matrix(found.train, f"{out}/{name}", "gene", "label", column)


def main(spark: SparkSession, words: list[str] | None = None) -> None:
    args = parser().parse_args(words)
    if args.command == "neten":
        tsv.write_network(commands.neten(tsv.read_network(spark, args.network)), f"{args.out}/network")
    elif args.command == "pcc":
        cells = tsv.read_matrix(spark, args.matrix)
        rows = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("c")).select("row", F.col("c.value").alias("x"))
        _table(commands.pcc(rows, args.columns), f"{args.out}/correlation")
    elif args.command == "report":
        truth = _labels(spark, args.truth)
        scores = _labels(spark, args.scores).withColumnRenamed("y", "p")
        each, whole = commands.report(truth.join(scores, ["gene", "label"]), args.cut)
        _table(each, f"{args.out}/labels"), _table(whole, f"{args.out}/overall")
    else:
        networks = [tsv.read_network(spark, path) for path in args.networks.split(",")]
        labels, genes = _labels(spark, args.labels), tsv.read_ids(spark, args.genes, args.header).select("gene")
        options = {"method": args.method, "alpha": args.alpha, "relative": args.relative, "complete": args.complete}
        if args.command == "prop":
            if args.prior:
                cells = tsv.read_matrix(spark, args.prior)
                options["prior"] = cells.select(F.col("col").alias("src"), F.col("row").alias("dst"), F.col("value").alias("w"))
            stack = commands.prop(networks, labels, labels.select("gene").union(genes), **options)
            tsv.write_matrix(tuning.as_features(stack), f"{args.out}/features", "gene", "feature", "x")
            return
        shared = {"folds": args.folds, "objective": args.objective, "cut": args.cut, "neighbours": args.neighbours, "trim": args.trim, "regularised": args.regularised, "refill": args.refill, "log_beta": math.log10(args.beta), "propagation": options}
        if args.command == "tune":
            (k_low, k_high, k_steps), (lam_low, lam_high, lam_steps) = args.k, args.lam
            grid = {"k_low": k_low, "k_high": k_high, "k_steps": int(k_steps), "lam_low": lam_low, "lam_high": lam_high, "lam_steps": int(lam_steps)}
            settings = tuning.Settings(**shared, **grid, auto_beta=args.auto_beta, per_label=args.per_label, oversample=args.oversample)
            found = commands.tune(networks, labels, genes, settings)
        else:
            found = commands.pred(networks, labels, genes, args.k, args.lam, tuning.Settings(**shared))
        _results(found, labels, args.out, args.verbose)


if __name__ == "__main__":
    main(SparkSession.builder.appName("labelweave").getOrCreate())
