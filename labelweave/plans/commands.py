"""The six commands: each takes tables (or paths, through sources.tsv) and gives tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from labelweave.operators import metrics, network, similarity
from labelweave.plans import tuning


def neten(edges: DataFrame) -> DataFrame:
    """The network (src, dst, w), denoised: each edge once."""
    return network.enhance(edges)


def pcc(rows: DataFrame, columns: bool = False) -> DataFrame:
    """Correlation of all pairs of rows (row, x), or of all pairs of columns."""
    return similarity.pearson_columns(rows) if columns else similarity.pearson_rows(rows)


def prop(networks: list[DataFrame], labels: DataFrame, genes: DataFrame, **options) -> DataFrame:
    """Features (gene, net_id, label, x) of genes; options as for tuning.propagated()."""
    return tuning.propagated(networks, labels, genes, **options)


def report(cells: DataFrame, cut: int = 3) -> tuple[DataFrame, DataFrame]:
    """Counts, F1 and area of each label, and the row of overall scores."""
    each = metrics.confusion(cells, 0.5).join(metrics.aupr(cells), "label")
    return each, metrics.report(cells, cut)


def tune(networks: list[DataFrame], labels: DataFrame, test_genes: DataFrame, settings: tuning.Settings | None = None) -> tuning.Tuned:
    """Settings chosen by nested folds, and calibrated predictions of the test genes."""
    return tuning.tuned(networks, labels, test_genes, settings)


def pred(networks: list[DataFrame], labels: DataFrame, test_genes: DataFrame, k: int | None = None, lam: float = 0.1, settings: tuning.Settings | None = None) -> tuning.Tuned:
    """Calibrated predictions of the test genes with a fixed dimension (all labels, if none is given) and penalty."""
    names = labels.where("y = 1").select("label").distinct().count()
    return tuning.tuned(networks, labels, test_genes, settings, [(k or names, lam)])
