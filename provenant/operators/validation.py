"""Agreement between a judge and human raters, and reliability of the scoring matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..sources.durable import durable
from . import dims
from .literal import literal

AXES = "QI SP SD ST ASF".split()


def votes(evaluated: DataFrame) -> DataFrame:
    """task, human_labels, judge_label, c: each different set of labels once."""
    return evaluated.groupBy("task", "human_labels", "judge_label").agg(F.count("*").alias("c"))


def _majority_cells(voted: DataFrame) -> DataFrame:
    return voted.where(F.size("human_labels") > 0).groupBy("task", S.majority(F.col("human_labels")).alias("a"), F.col("judge_label").alias("b")).agg(F.sum("c").alias("c"))


def _rater_cells(voted: DataFrame) -> DataFrame:
    each = voted.select("task", "judge_label", "c", F.posexplode("human_labels").alias("rater", "a"))
    return each.groupBy("task", "rater", "a", F.col("judge_label").alias("b")).agg(F.sum("c").alias("c"))


def confusion(evaluated: DataFrame) -> DataFrame:
    """task, a (majority of the raters), b (judge), c of rows task, human_labels, judge_label."""
    return _majority_cells(votes(evaluated))


def rater_confusion(evaluated: DataFrame) -> DataFrame:
    """The same for each rater's place; raters may be missing in some rows."""
    return _rater_cells(votes(evaluated))


def _mean_kappa(cells: DataFrame) -> DataFrame:
    per = S.kappa(cells, ["task", "rater"]).where("classes > 1")
    return per.groupBy("task").agg(F.avg("kappa").alias("kappa_pair"))


def kappa_pair(evaluated: DataFrame) -> DataFrame:
    """task, kappa_pair: mean of the judge's kappas with each rater who used more than one class."""
    return _mean_kappa(durable(rater_confusion(evaluated)))


def judge_kappa(evaluated: DataFrame, replicates: int = 1000) -> DataFrame:
    """A row a task: n, raw agreement, kappa with its bootstrap interval, mean pairwise kappa, balanced accuracy.

    The facts are read once, for the votes; all statistics read cells that are kept.
    """
    voted = durable(votes(evaluated))
    cells = durable(_majority_cells(voted))
    cons = S.kappa(cells, ["task"]).select("task", "n", F.col("agreement").alias("raw_agr"), F.col("kappa").alias("kappa_cons"))
    order = literal(evaluated.sparkSession, [*enumerate(AXES)], "ord int, task string")
    out = order.join(cons, "task").join(S.bootstrap_kappa(cells, "task", replicates), "task", "left")
    return out.join(_mean_kappa(durable(_rater_cells(voted))), "task", "left").join(S.balanced_accuracy(cells, ["task"]), "task", "left")


def ratings(cells: DataFrame) -> DataFrame:
    """grp, cell, rater, score of rows grp, cell, annotator_scores."""
    return cells.select("grp", "cell", F.posexplode("annotator_scores").alias("rater", "score"))


def medians2(cells: DataFrame) -> DataFrame:
    """cells with twice the median of their scores, an integer."""
    s = F.array_sort("annotator_scores")
    n = F.size("annotator_scores")
    return cells.withColumn("med2", F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1))


def mean_deviation(cells: DataFrame) -> DataFrame:
    """grp, mad: mean over cells of the mean distance of scores from the cell's median."""
    dist = F.aggregate("annotator_scores", F.lit(0).cast("long"), lambda a, x: a + F.abs(2 * x - F.col("med2")))
    return medians2(cells).groupBy("grp").agg(F.avg(dist / (2 * F.size("annotator_scores"))).alias("mad"))


def consensus_pearson(cells: DataFrame) -> DataFrame:
    """grp, pearson_r of the medians with the designed scores, over cells that have one."""
    rows = medians2(cells).where("design IS NOT NULL").select("grp", F.col("med2").cast("long"), F.col("design").cast("long"))
    return S.pearson(rows, ["grp"], "med2", "design").withColumnRenamed("r", "pearson_r")


def with_design(cells: DataFrame, which: str, row: str, col: str) -> DataFrame:
    """cells with the matrix's score, null without one (30 or 60 literal rows: broadcast)."""
    m = dims.matrix(cells.sparkSession, which).toDF("_r", "_c", "design")
    return cells.join(F.broadcast(m), (F.col(row) == F.col("_r")) & (F.col(col) == F.col("_c")), "left").drop("_r", "_c")


def matrix_validation(cells: DataFrame) -> DataFrame:
    """grp, n, k, icc, lo, hi, pearson_r, mad of rows grp, cell, annotator_scores, design.

    The interval needs quantiles of F: a Python function over one row a group.
    """
    base = S.icc(ratings(cells), ["grp"])

    def interval(batches):
        for pdf in batches:
            ends = [S.icc_interval(r.msr, r.msc, r.mse, int(r.n), int(r.k)) for r in pdf.itertuples()]
            yield pdf.assign(lo=[e[0] for e in ends], hi=[e[1] for e in ends])[["grp", "n", "k", "icc", "lo", "hi"]]

    out = base.mapInPandas(interval, "grp string, n long, k long, icc double, lo double, hi double")
    return out.join(consensus_pearson(cells), "grp", "left").join(mean_deviation(cells), "grp", "left")
