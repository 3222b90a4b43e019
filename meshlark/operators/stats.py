"""Weighted regressions, metrics, folds, sensitivity indices and independence tests as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.operators.ordered import ordered_sum


def instruments(df: DataFrame, least_f: float = 10.0) -> DataFrame:
    """Rows (group, bx, sx, by, sy, f) that are usable: strong, finite, with positive errors."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = finite("f") & (F.col("f") >= least_f) & finite("bx") & (F.abs("bx") > 1e-12) & finite("by") & finite("sy") & (F.col("sy") > 0) & finite("sx") & (F.col("sx") > 0)
    return df.filter(ok)


def causal_regressions(df: DataFrame, group: str) -> DataFrame:
    """Inverse-variance weighted slope, its error, Cochran's Q and Egger's line for each group, from one pass of sums."""
    w = 1 / (F.col("sy") * F.col("sy"))
    sums = df.groupBy(group).agg(
        F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * F.col("bx")).alias("wx"), F.sum(w * F.col("by")).alias("wy"),
        F.sum(w * F.col("bx") * F.col("by")).alias("wxy"), F.sum(w * F.col("bx") * F.col("bx")).alias("wxx"), F.sum(w * F.col("by") * F.col("by")).alias("wyy"),
    ).filter("n >= 2")
    ivw = F.col("wxy") / F.col("wxx")
    var = F.col("wxx") / F.col("w") - F.pow(F.col("wx") / F.col("w"), F.lit(2.0))
    cov = F.col("wxy") / F.col("w") - F.col("wx") * F.col("wy") / (F.col("w") * F.col("w"))
    egger = F.when(var > 1e-12, cov / var).otherwise(ivw)
    alpha = F.when(var > 1e-12, F.col("wy") / F.col("w") - egger * F.col("wx") / F.col("w")).otherwise(0.0)
    q = F.greatest(F.lit(0.0), F.col("wyy") - ivw * F.col("wxy"))
    return sums.select(group, "n", ivw.alias("ivw"), F.sqrt(1 / F.col("wxx")).alias("ivw_se"), q.alias("q"), egger.alias("egger"), alpha.alias("egger_intercept"))


def weighted_median(df: DataFrame, group: str, value: str, weight: str, tie: Sequence[str] = ()) -> DataFrame:
    """The first value at which the running share of weight reaches one half."""
    order = Window.partitionBy(group).orderBy(value, *tie)
    run = df.withColumn("_run", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(weight).over(Window.partitionBy(group)))
    return run.filter(F.col("_run") >= 0.5 * F.col("_all")).groupBy(group).agg(F.min(value).alias("median"))


def regression_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: n, Pearson's r, RMSE, MAE and R squared."""
    d = F.col(guess) - F.col(truth)
    out = df.agg(F.count("*").alias("n"), F.corr(truth, guess).alias("r"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), (1 - F.sum(d * d) / (F.var_pop(truth) * F.count("*"))).alias("r2"))
    return out


def ordinal_correlation(df: DataFrame, key: str, truth: str, guess: str) -> DataFrame:
    """Spearman's correlation of ordinal ranks; ties are ordered by ``key``."""
    ones = df.select(key, truth, guess).withColumn("_one", F.lit(1))
    ranked = ordered_sum(ordered_sum(ones, [truth, key], "_one", "_r1"), [guess, key], "_one", "_r2")
    return ranked.agg(F.corr(F.col("_r1").cast("double"), F.col("_r2").cast("double")).alias("rho"))


def classification_metrics(df: DataFrame, truth: Column, score: str, threshold: float) -> DataFrame:
    """One row: confusion counts, derived rates and the area under the ROC curve.

    The area comes from counts for each distinct score and their running sums, not from pairs.
    """
    by_score = df.withColumn("_t", truth.cast("int")).groupBy(score).agg(F.sum("_t").alias("pos"), F.sum(1 - F.col("_t")).alias("neg"))
    run = ordered_sum(by_score, [score], "neg", "upto")
    total = run.agg(
        F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.sum(F.when(F.col(score) >= threshold, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col(score) >= threshold, F.col("neg")).otherwise(0)).alias("fp"),
    )
    sens, spec, prec = F.col("tp") / F.greatest("p", F.lit(1)), (F.col("n") - F.col("fp")) / F.greatest("n", F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    f1 = 2 * prec * sens / F.greatest(F.lit(1e-6), prec + sens)
    auc = F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).otherwise(0.5)
    return total.select(auc.alias("auc"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"), sens.alias("sensitivity"), spec.alias("specificity"), f1.alias("f1"))


def group_fold(group: Column, folds: int) -> Column:
    """A fold for each group, by arithmetic that any engine repeats."""
    return F.pmod(F.pmod(group.cast("bigint"), F.lit(1000003)) * 7919 + 104729, F.lit(1000003)) % folds


def z_scores(df: DataFrame, feature: str, condition: str, value: str, control: str) -> DataFrame:
    """Mean of each (condition, feature) against the control's mean and standard deviation of that feature."""
    base = df.filter(F.col(condition) == control).groupBy(feature).agg(F.avg(value).alias("m0"), F.stddev_pop(value).alias("s0"))
    own = df.filter(F.col(condition) != control).groupBy(condition, feature).agg(F.avg(value).alias("m"))
    return own.join(base, feature).select(condition, feature, ((F.col("m") - F.col("m0")) / (F.col("s0") + 1e-3)).alias("z"))


def sobol(samples: DataFrame, model, names: Sequence[str]) -> DataFrame:
    """First-order and total indices from two sample matrices: columns a_<name> and b_<name>; ``model`` maps columns to a column."""
    a, b = [F.col(f"a_{n}") for n in names], [F.col(f"b_{n}") for n in names]
    out = samples.withColumn("fa", model(*a)).withColumn("fb", model(*b))
    for i, n in enumerate(names):
        out = out.withColumn(f"f_{n}", model(*[b[j] if i == j else a[j] for j in range(len(names))]))
    var = F.var_pop("fa")
    rows = [F.struct(F.lit(n).alias("name"), (F.avg(F.col("fb") * (F.col(f"f_{n}") - F.col("fa"))) / var).alias("first"), (0.5 * F.avg(F.pow(F.col("fa") - F.col(f"f_{n}"), F.lit(2.0))) / var).alias("total")) for n in names]
    return out.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def hsic_features(x: Column, waves: Sequence[tuple[float, float]]) -> list[Column]:
    return [F.cos(x * F.lit(w) + F.lit(b)) * F.lit((2.0 / len(waves)) ** 0.5) for w, b in waves]


def hsic(df: DataFrame, x: Column, y: Column, waves: Sequence[tuple[float, float]]) -> DataFrame:
    """Squared norm of the cross-covariance of random Fourier features of two columns."""
    one, two = hsic_features(x, waves), hsic_features(y, waves)
    out = df.select(*[c.alias(f"x{i}") for i, c in enumerate(one)], *[c.alias(f"y{j}") for j, c in enumerate(two)])
    total = F.lit(0.0)
    for i in range(len(one)):
        for j in range(len(two)):
            c = F.covar_pop(f"x{i}", f"y{j}")
            total = total + c * c
    return out.agg(total.alias("hsic"))
