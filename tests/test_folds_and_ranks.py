"""Orders over whole tables, second-order stratification and coupled oversampling, against plain Python."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.operators import metrics, ranking, sampling, scaling


def test_rows_are_numbered_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 5), k) for k in range(500)] + [(None, 500), (3, 501)]
    df = spark.createDataFrame(rows, "v int, id long").repartition(7)
    got = {r["id"]: r["n"] for r in ranking.numbered(df, F.desc("v"), "id").collect()}
    assert got == {i: k for k, (v, i) in enumerate(sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -99), r[1])))}
    assert ranking.numbered(df.limit(0), "id").count() == 0


def test_a_label_of_one_score_is_split(spark):
    rows = spark.range(8000).select(F.col("id").alias("gene"), F.lit("a").alias("label"), (F.col("id") % 10 == 0).cast("double").alias("y"), F.when(F.col("id") % 2 == 0, 0.37).otherwise(F.rand(1)).alias("p"))
    ranked = metrics.ranked(rows)
    assert ranked.groupBy("_range").count().agg(F.max("count")).first()[0] < 8000 / 8
    own = sorted(((-r["p"], r["gene"]), r["rn"]) for r in ranked.select("gene", "p", "rn").collect())
    assert [r for _, r in own] == list(range(1, 8001))


def test_ranking_reads_its_source_once(spark, tmp_path):
    spark.range(500).select(F.col("id").alias("gene"), (F.col("id") % 3).cast("string").alias("label"), (F.col("id") % 2).cast("double").alias("y"), (F.pmod(F.xxhash64("id"), F.lit(97)) / 97).alias("p")).write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")
    for made in (scaling.quantile_norm(cells), metrics.ag_threshold(cells), metrics.cost_aupr(cells), metrics.aupr(cells), scaling.rank_scale(cells.withColumn("t", F.lit(0.5)))):
        assert made._jdf.queryExecution().executedPlan().toString().count("FileScan") == 0  # what is left reads ranks from the checkpoint folder


def _plain_reserve(rows, counts, folds, least):
    """rows: gene -> labels. The rule, one row at a time."""
    demand = {x: 1.0 + (least * folds - n) / folds if n < least * folds else 0.0 for x, n in counts.items()}
    by_fold = {x: dict.fromkeys(range(folds), demand[x]) for x in counts}
    placed = {}
    order = [x for _, x in sorted((-d, x) for x, d in demand.items())]
    for x in order:
        if demand[x] <= 0:
            break
        for gene in sorted(rows):
            if gene not in placed and x in rows[gene]:
                most = max(by_fold[x].values())
                fold = min(f for f in range(folds) if by_fold[x][f] == most)
                placed[gene] = fold
                for other in rows[gene]:
                    by_fold[other][fold] -= 1.0
                    if other != x:
                        demand[other] -= 1.0 / folds
    return placed


def _plain_folds(rows, folds, least):
    """(set, fold) -> rows, and the reserve, dealing one row at a time."""
    counts = collections.Counter(x for names in rows.values() for x in names)
    seen, rarity = set(), {}
    for x in sorted(counts):
        again = counts[x] in seen
        seen.add(counts[x])
        rarity[x] = max(counts.values()) / (counts[x] + again)
    pairs = lambda names: [(a, b) for a in sorted(names) for b in sorted(names) if a <= b]
    want = [collections.Counter() for _ in range(folds)]
    for names in rows.values():
        for e in pairs(names):
            for f in range(folds):
                want[f][e] += 1 / folds
    placed = _plain_reserve(rows, counts, folds, least)
    room = [len(rows) / folds] * folds
    for gene in placed:
        for f in range(folds):
            room[f] -= 1 / folds
            for e in pairs(rows[gene]):
                want[f][e] -= 1
    left = collections.Counter(tuple(sorted(names)) for gene, names in rows.items() if gene not in placed and names)
    for names in rows.values():
        if names:
            left.setdefault(tuple(sorted(names)), 0)
    out = collections.Counter()
    for names in sorted(left, key=lambda s: (-round(sum(rarity[x] for x in s), 9), left[s], s)):
        first = sorted(names, key=lambda x: (-rarity[x], x))[:2]
        e = (min(first), max(first))
        for _ in range(left[names]):
            most = max(want[f][e] for f in range(folds))
            tied = [f for f in range(folds) if want[f][e] >= most - 1e-9]
            fold = max(tied, key=lambda f: (room[f], -f))
            out[names, fold] += 1
            room[fold] -= 1
            for own in pairs(names):
                want[fold][own] -= 1
    return out, placed


@pytest.mark.parametrize("seed, folds, least", [(1, 3, 2), (2, 2, 4), (3, 5, 1)])
def test_folds_follow_the_rule_row_by_row(spark, seed, folds, least):
    rng = random.Random(seed)
    shares = {"a": 0.5, "b": 0.3, "c": 0.25, "d": 0.03, "e": 0.02}
    rows = {k: {x for x, s in shares.items() if rng.random() < s} for k in range(240)}
    cells = spark.createDataFrame([(k, x, float(x in names)) for k, names in rows.items() for x in shares], "gene long, label string, y double")
    got = {r["gene"]: r["fold"] for r in sampling.stratified_folds(cells, folds, least=least, rounds=40).collect()}
    want, placed = _plain_folds(rows, folds, least)
    assert {g: f for g, f in got.items() if g in placed} == placed
    assert collections.Counter((tuple(sorted(rows[g])), f) for g, f in got.items() if rows[g] and g not in placed) == +want
    assert set(got) >= {g for g, names in rows.items() if names}
    few = {r["gene"]: r["fold"] for r in sampling.stratified_folds(cells, folds, least=least, rounds=3).collect()}
    for x in shares:
        own = [sum(x in rows[g] and f == k for g, f in few.items()) for k in range(folds)]
        assert max(own) - min(own) <= 4 and (min(own) > 0 or sum(own) < folds), (x, own)


def test_folds_of_nothing_and_of_negatives(spark):
    cells = spark.createDataFrame([(k, "a", 0.0) for k in range(9)], "gene long, label string, y double")
    assert sampling.stratified_folds(cells, 3).count() == 0 and sampling.stratified_folds(cells.limit(0), 3).count() == 0
    more = cells.unionByName(spark.createDataFrame([(100, "a", 1.0)], cells.schema))
    got = sampling.stratified_folds(more, 3, negatives=6.0).collect()
    assert len(got) == 7 and collections.Counter(r["fold"] for r in got if r["gene"] != 100) == {0: 2, 1: 2, 2: 2}


def test_picks_equal_one_row_after_another():
    rng = np.random.default_rng(4)
    for _ in range(200):
        folds = int(rng.integers(1, 6))
        want, room, n = rng.integers(-3, 9, folds) / rng.integers(1, 4), rng.integers(0, 30, folds) / 2, int(rng.integers(0, 40))
        left, free, got = want.copy(), room.astype(float), np.zeros(folds, int)
        for _ in range(n):
            tied = np.flatnonzero(left >= left.max() - 1e-9)
            f = tied[np.argmax(free[tied])]
            got[f] += 1
            left[f] -= 1
            free[f] -= 1
        assert (sampling.picks(want, room, n) == got).all()


def test_oversampling_demands_are_coupled(spark):
    rng = random.Random(6)
    y = [[1.0, float(k < 30), float(k < 7), float(2 <= k < 9), float(k in (50, 51, 52))] for k in range(60)]
    rows = spark.createDataFrame([(k, [rng.random() for _ in range(3)], v) for k, v in enumerate(y)], "gene long, x array<double>, y array<double>")
    made = [r["y"] for r in sampling.synthetic_rows(rows, list("abcde"), ratio=0.8, neighbours=3).collect()]
    sums = [sum(v[j] for v in y) for j in range(5)]
    demand = sampling.oversampling_demand(dict(enumerate(sums)), 0.8)
    assert set(demand) == {2, 3, 4}
    # Label by label: the most demanding one gets the rows that it lacks, and each lowers the demand of all that it has.
    at = 0
    while demand:
        label = max(demand, key=lambda x: (demand[x], -x))
        n = int(demand.pop(label))
        own, at = made[at : at + max(0, n)], at + max(0, n)
        assert all(v[label] == 1 for v in own)
        for other in demand:
            demand[other] -= sum(v[other] for v in own)
    assert at == len(made)
    alone = [int(1 + 0.8 * sum(sums) / 5 - s) for s in sums[2:]]
    assert len(made) < sum(alone)
