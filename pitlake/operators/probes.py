"""Leakage probes, injected defects and invariance audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.functions.scalars import leaks_target, zero_cost
from pitlake.operators.overlap import overlapping


def _found(df: DataFrame, probe: str, item: Column, severity: str = "hard") -> DataFrame:
    return df.select(F.lit(probe).alias("probe"), F.lit(severity).alias("severity"), item.cast("string").alias("item"))


def target_leak(features: DataFrame) -> DataFrame:
    """(policy, feature, target) rows whose feature names the target."""
    return _found(features.where(leaks_target(F.col("feature"), F.col("target"))), "target_leakage", F.concat_ws(":", "policy", "feature"))


def normaliser_leak(folds: DataFrame, fitted: DataFrame, row: str) -> DataFrame:
    """Test rows of a fold that the normaliser was fitted on."""
    test = folds.where("role = 'test'").select("fold", F.col(row).alias("__row"))
    return _found(test.join(fitted.select(F.col(row).alias("__row")).distinct(), "__row", "left_semi"), "full_sample_normalization", F.concat_ws(":", "fold", "__row"))


def unpurged(intervals: DataFrame, tests: DataFrame) -> DataFrame:
    """As training rows of each fold, all rows before its test block that end at its first start or later; an earlier end meets no test row."""
    bounds = tests.groupBy("fold").agg(F.min("pos").alias("__tp"), F.min("start").alias("__ts"))
    naive = intervals.join(F.broadcast(bounds), (F.col("pos") < F.col("__tp")) & (F.col("end") >= F.col("__ts")))
    return naive.select("fold", F.lit("train").alias("role"), "pos", "start", "end")


def overlap_leak(folds: DataFrame, row: str, width: int) -> DataFrame:
    """Training rows whose closed label interval meets one of the fold's test rows."""
    columns = ["fold", row, "start", "end"]
    train, test = folds.where("role = 'train'").select(*columns), folds.where("role = 'test'").select(*columns)
    return _found(overlapping(train, test, ["fold"], "start", "end", width), "temporal_overlap", F.concat_ws(":", "fold", row))


def perturbation_leak(before: DataFrame, after: DataFrame, row: str, tolerance: float = 0.0) -> DataFrame:
    """Predictions (row, prediction) that a change of the future alone moved by more than the tolerance, or that are on one side only."""
    b, a = before.select(row, F.col("prediction").alias("__b")), after.select(row, F.col("prediction").alias("__a"))
    moved = F.coalesce(F.abs(F.col("__a") - F.col("__b")) > tolerance, ~(F.col("__a").isNull() & F.col("__b").isNull()))
    return _found(b.join(a, row, "full").where(moved), "lookahead_perturbation", F.col(row))


def survivorship_leak(full: DataFrame, evaluated: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Symbols of the start that are not evaluated."""
    return _found(full.select(symbol).distinct().join(evaluated.select(symbol).distinct(), symbol, "left_anti"), "survivorship", F.col(symbol))


def zero_cost_leak(configs: DataFrame) -> DataFrame:
    """configurations (name, maker, taker, slippage) that charge nothing."""
    return _found(configs.where(zero_cost(F.col("maker"), F.col("taker"), F.col("slippage"))), "zero_cost_execution", F.col("name"))


def audit(*found: DataFrame) -> DataFrame:
    """All violations in one frame."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def raise_if_hard(found: DataFrame) -> None:
    """Stop at the first hard violation."""
    first = found.where("severity = 'hard'").limit(1).collect()
    if first:
        raise ValueError(f"leakage: {first[0]['probe']} at {first[0]['item']}")


def verdicts(cases: dict[str, DataFrame]) -> DataFrame:
    """For each injected defect, whether its probe caught it and by how many items."""
    out = None
    for defect, found in cases.items():
        row = found.agg(F.count("*").alias("evidence"), F.first("probe").alias("probe")).select(F.lit(defect).alias("defect"), F.col("evidence"), (F.col("evidence") > 0).alias("caught"))
        out = row if out is None else out.unionByName(row)
    return out


def shift_labels(rows: DataFrame, order: list[Column], label: str, bucket: Column) -> DataFrame:
    """Every label replaced by the next row's in the whole order, 0 at the end; must be caught."""
    from pitlake.operators.numbering import number

    placed = number(rows, order, bucket, "__i")
    nxt = placed.select((F.col("__i") - 1).alias("__i"), F.col(label).alias("__n"))
    return placed.join(nxt, "__i", "left").withColumn(label, F.coalesce("__n", F.lit(0.0))).drop("__i", "__n")


def invariant(frame: DataFrame, mutate: Callable[[DataFrame], DataFrame], query: Callable[[DataFrame], DataFrame], known: Column) -> DataFrame:
    """Rows of query(frame), up to what was known, that a mutation of later input changes: none if the query looks back only."""
    a, b = query(frame).where(known), query(mutate(frame)).where(known)
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def scenarios(frame: DataFrame, variants: dict[str, Callable[[DataFrame], DataFrame]], query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The query under each predeclared variant of its input, with a scenario column."""
    out = None
    for name, change in variants.items():
        got = query(change(frame)).withColumn("scenario", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def reconcile(computed: DataFrame, expected: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Status of each computed value: ok, mismatch beyond the tolerance, or missing expectation."""
    e = expected.select(key, F.col(value).alias("__want"))
    delta = F.abs(F.col(value) - F.col("__want"))
    status = F.when(F.col("__want").isNull(), "missing").when(delta > tolerance, "mismatch").otherwise("ok")
    return computed.join(e, key, "left").select(key, delta.alias("delta"), status.alias("status"))


def _tree(rows: DataFrame, by: Column, order: str) -> DataFrame:
    """One level: the hash of each group's hashes in order, with its count."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("h").alias("h")))), lambda s: s["h"]), "")
    return rows.groupBy(by.alias("g")).agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n"))


def content_hash(rows: DataFrame, order: list[Column], bucket: Column, fan: int = 4096) -> DataFrame:
    """One hash of all rows in order: of each bucket's rows, then of `fan` buckets at a time, twice, then of what is left.

    bucket is a whole number that does not fall along the order; no level gathers more than a bucket or fan hashes while
    there are fewer than fan cubed buckets."""
    line = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    leaf = rows.select(F.struct(*order).alias("o"), bucket.cast("long").alias("b"), line.alias("h"), F.lit(1).alias("n"))
    level = _tree(leaf, F.col("b"), "o")
    for _ in range(2):
        level = _tree(level, F.floor(F.col("g") / fan), "g")
    return _tree(level, F.lit(0), "g").select(F.col("h").alias("hash"), F.col("n").alias("rows"))
