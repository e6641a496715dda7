"""Evidence gates, answers rescued by evidence, threshold grids and the choice of a policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visgauge.functions.boxes import area
from visgauge.functions.stats import f1, present, ratio


@dataclass(frozen=True)
class Gate:
    """What a detection must reach to count as evidence; None: no such bound. Shares of the image for areas."""

    score: float = 0.3
    promotion: float = 0.5
    mask_score: float | None = None
    least_area: float = 0.0
    most_area: float = 1.0

    def __post_init__(self) -> None:
        bounds = [self.score, self.promotion, self.least_area, self.most_area, *([] if self.mask_score is None else [self.mask_score])]
        if not all(0 <= b <= 1 for b in bounds) or self.promotion < self.score or self.most_area < self.least_area:
            raise ValueError("bounds lie between 0 and 1, promotion not below score, and least_area not above most_area")


def rejections(score: Column, box: Column, gate: Gate, mask_score: Column | None = None) -> Column:
    """The reasons, in order, for which a detection is no evidence; an empty array for evidence."""
    share = area(box)
    reasons = {"low_score": score < gate.score, "small_area": share < gate.least_area, "large_area": share > gate.most_area}
    if gate.mask_score is not None and mask_score is not None:
        reasons["low_mask_score"] = F.coalesce(mask_score < gate.mask_score, F.lit(True))
    return present(reasons)


def rescue(answers: DataFrame, evidence: DataFrame, key: str, answer: str, gate: Gate) -> DataFrame:
    """answers with accepted (pieces of evidence), strongest score, final_answer and status.

    evidence: key, score of accepted detections. A `no` becomes `yes` if a score reaches gate.promotion; a `yes` always
    stays, as no evidence is no evidence of absence. Other answers are an error.
    """
    best = evidence.groupBy(key).agg(F.count(F.lit(1)).alias("accepted"), F.max("score").alias("strongest"))
    df = answers.join(best, key, "left").withColumns({"accepted": F.coalesce("accepted", F.lit(0)), "strongest": F.round(F.coalesce("strongest", F.lit(0.0)), 6)})
    no, yes, some = F.col(answer) == "no", F.col(answer) == "yes", F.col("accepted") > 0
    raised = no & some & (F.col("strongest") >= gate.promotion)
    # The names of the states.
    status = (
        F.when(raised, "promoted_by_localized_evidence")
        .when(no & some, "negative_preserved_below_promotion_threshold")
        .when(no, "negative_preserved_without_evidence")
        .when(yes & some, "positive_supported_by_localized_evidence")
        .when(yes, "positive_preserved_without_evidence")
        .otherwise(F.raise_error(F.lit("an answer is neither yes nor no")))
    )
    return df.withColumns({"final_answer": F.when(raised, "yes").otherwise(F.col(answer)), "status": status})


def rescue_by_review(answers: DataFrame, reviews: DataFrame, key: str, answer: str) -> DataFrame:
    """As rescue, but a `no` becomes `yes` only by a review (key, rank, review) that says just yes; the first such
    candidate by rank is confirmed."""
    said = F.lower(F.trim(F.col("review")))
    seen = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("reviews"), F.min(F.when(said == "yes", F.col("rank"))).alias("confirmed"), F.count_if(~said.isin("yes", "no")).alias("unclear"))
    df = answers.join(seen, key, "left").withColumns({"reviews": F.coalesce("reviews", F.lit(0)), "unclear": F.coalesce("unclear", F.lit(0))})
    no = F.col(answer) == "no"
    raised = no & F.col("confirmed").isNotNull()
    status = F.when(raised, "promoted").when(no & (F.col("reviews") == 0), "kept_without_candidates").when(no & (F.col("unclear") > 0), "kept_unclear").when(no, "kept_rejected").otherwise("kept_positive")
    return df.withColumns({"final_answer": F.when(raised, "yes").otherwise(F.col(answer)), "status": status})


def consensus(first: Column, second: Column) -> Column:
    """struct(forced, selective, status): the second answer, else the first, is forced; the selective one needs both."""
    status = F.when(first.isNull() & second.isNull(), "none").when(second.isNull(), "first_only").when(first.isNull(), "second_only").when(first == second, "agree").otherwise("disagree")
    return F.struct(F.coalesce(second, first).alias("forced"), F.when(first == second, first).alias("selective"), status.alias("status"))


def grid(spark: SparkSession, **axes: list[float]) -> DataFrame:
    """All combinations of the values of each axis, with candidate numbers in their order: small by construction."""
    rows = [()]
    for values in axes.values():
        rows = [(*r, float(v)) for r in rows for v in values]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ", ".join(["candidate int", *(f"{a} double" for a in axes)]))


def _rates(sums: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp, None), ratio(tp, tp + fn, None)
    return sums.withColumns({"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": F.round(precision, 6), "recall": F.round(recall, 6), "f1": f1(precision, recall)})


def sweep(df: DataFrame, candidates: DataFrame, predicted: Column, target: Column) -> DataFrame:
    """Binary metrics of every candidate of a grid over all rows, for any rule: each row is tried with each candidate.
    sweep_thresholds does the same for rules that are thresholds, at a cost that does not grow with the candidates."""
    rows = df.withColumn("_t", target).crossJoin(candidates).withColumn("_p", predicted)
    sums = rows.groupBy(*candidates.columns).agg(*[F.count_if(F.expr(e)).alias(n) for n, e in {"tp": "_p and _t", "fp": "_p and not _t", "tn": "not _p and not _t", "fn": "not _p and _t"}.items()])
    return _rates(sums)


def sweep_thresholds(df: DataFrame, candidates: DataFrame, values: dict[str, Column], axes: dict[str, list[float]], target: Column) -> DataFrame:
    """Binary metrics of every candidate of a grid, where a row is predicted if each of its values reaches the threshold
    of its axis; a null value reaches none, a null target counts as false.

    Each row is counted once, in the cell of the number of thresholds that its values reach on each axis. Candidates are
    then sums over the cells, which are as many as the grid has, whatever the number of rows.
    """
    steps = {a: sorted({float(x) for x in found}) for a, found in axes.items()}

    def reached_by(value: Column, found: list[float]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(x) for x in found]), lambda x: F.coalesce(value >= x, F.lit(False))))

    cells = [reached_by(values[a], found).alias(f"_{a}") for a, found in steps.items()]
    counted = df.select(*cells, F.coalesce(target, F.lit(False)).alias("_t")).groupBy(*[f"_{a}" for a in steps]).agg(F.count_if("_t").alias("_yes"), F.count_if(~F.col("_t")).alias("_no"))
    reached = F.lit(True)
    for a, found in steps.items():
        reached = reached & (F.col(f"_{a}") >= F.array_position(F.array(*[F.lit(x) for x in found]), F.col(a)))
    tried = candidates.crossJoin(counted).withColumn("_p", reached)
    sums = tried.groupBy(*candidates.columns).agg(*[F.sum(F.when(F.col("_p") == p, F.col(c)).otherwise(F.lit(0))).alias(n) for n, p, c in (("tp", True, "_yes"), ("fp", True, "_no"), ("tn", False, "_no"), ("fn", False, "_yes"))])
    return _rates(sums)


def judge(policies: DataFrame, baseline: Column) -> DataFrame:
    """policies (policy_id, accuracy, f1, precision, helped, harmed) with reasons against each, eligible and chosen.

    A policy must be more accurate than the baseline, have no lower F1, and help more often than it harms. Among those
    the order is accuracy, F1, precision, fewer harms, and name; if there is none, the baseline is chosen. The policies
    are a small table; the baseline's row is joined to each.
    """
    base = policies.where(baseline).select(F.col("accuracy").alias("_a"), F.col("f1").alias("_f"), F.col("policy_id").alias("_base"))
    df = policies.crossJoin(F.broadcast(base))
    reasons = present({"accuracy_not_improved": F.col("accuracy") <= F.col("_a"), "f1_decreased": F.col("f1") < F.col("_f"), "net_not_positive": F.col("helped") <= F.col("harmed")})
    df = df.withColumn("reasons", F.when(F.col("policy_id") == F.col("_base"), F.array(F.lit("baseline"))).otherwise(reasons)).withColumn("eligible", F.size("reasons") == 0)
    key = F.struct("accuracy", "f1", "precision", (-F.col("harmed")).alias("h"))
    best = df.where("eligible").groupBy().agg(F.max(key).alias("_k")).crossJoin(F.broadcast(base.select("_base")))
    top = df.where("eligible").withColumn("_key", key)
    tied = top.join(F.broadcast(best.select("_k")), F.col("_key") == F.col("_k")).agg(F.min("policy_id").alias("_best"))
    out = df.crossJoin(F.broadcast(tied))
    return out.withColumn("chosen", F.col("policy_id") == F.coalesce("_best", "_base")).drop("_a", "_f", "_base", "_best")
