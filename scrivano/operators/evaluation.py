"""Evaluation: labelled cases, judges and thresholds, as counts and rates over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores at which a judge flags an edit, and from which it passes one.
FLAG_AT, PASS_FROM = 2, 4
CRITERIA = ("faithfulness", "meaning_preservation", "writing_quality", "job_relevance")
#: Labels of edits that are let through, the second one after a confirmation.
ACCEPT = ("accept", "accept_confirm")


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """A rate of counts, of one at least."""
    return F.round(part / F.greatest(whole, F.lit(1)), digits)


def labelled_metrics(rows: DataFrame) -> DataFrame:
    """cases, agreement, claims, claims_blocked, claim_block_rate, grounded, grounded_rejected, false_rejection_rate.

    rows: expected, actual (codes), claim (whether the edit makes an unsupported or inflated claim).  A claim is blocked if
    it is rejected, or let through after a confirmation alone; an edit is grounded if its label lets it through.
    """
    claim, grounded = F.coalesce("claim", F.lit(False)), F.col("expected").isin(*ACCEPT)
    n = rows.agg(
        F.count("*").alias("cases"), F.count_if(F.col("expected") == F.col("actual")).alias("agreed"),
        F.count_if(claim).alias("claims"), F.count_if(claim & (F.col("actual") != "accept")).alias("claims_blocked"),
        F.count_if(grounded).alias("grounded"), F.count_if(grounded & ~F.col("actual").isin(*ACCEPT)).alias("grounded_rejected"),
    )
    return n.select(
        "*", rate(F.col("agreed"), F.col("cases")).alias("agreement"), rate(F.col("claims_blocked"), F.col("claims")).alias("claim_block_rate"),
        rate(F.col("grounded_rejected"), F.col("grounded")).alias("false_rejection_rate"),
    )


def calibration_cases(cases: DataFrame, blocks: DataFrame) -> DataFrame:
    """Cases (case_id, document, locator, original) whose locator stands in one block of their document alone, and whose original stands there once."""
    held = cases.where("locator is not null and locator <> ''").join(blocks.select("document", "text"), "document").where(F.col("text").contains(F.col("locator")))
    one = held.groupBy("case_id").agg(F.count("*").alias("n"), F.first("text").alias("text"), F.first("original").alias("original")).where("n = 1")
    times = (F.length("text") - F.length(F.replace("text", "original", F.lit("")))) / F.length("original")  # without overlaps
    return one.where((F.length("original") > 0) & (times == 1)).select("case_id", "text")


def judged(scores: DataFrame) -> DataFrame:
    """scores (CRITERIA, unsupported_claims array) with flagged and passed."""
    claims = F.size(F.coalesce("unsupported_claims", F.array().cast("array<string>"))) > 0
    low = (F.col(CRITERIA[0]) <= FLAG_AT) | (F.col(CRITERIA[1]) <= FLAG_AT) | claims
    passed = ~claims & (F.col(CRITERIA[0]) >= PASS_FROM) & (F.col(CRITERIA[1]) >= PASS_FROM)
    return scores.withColumns({"flagged": low, "passed": passed})


def judge_calibration(rows: DataFrame) -> DataFrame:
    """cases, errors, score, fabrications, recall, clean, false_alarm_rate; rows: fabricated, flagged (null where the judge failed).

    A judge's error is no finding about recall, but it is no right answer either.
    """
    seen = F.col("flagged").isNotNull()
    bad, good = seen & F.col("fabricated"), seen & ~F.col("fabricated")
    n = rows.agg(
        F.count("*").alias("cases"), F.count_if(~seen).alias("errors"), F.count_if(seen & (F.col("flagged") == F.col("fabricated"))).alias("right"),
        F.count_if(bad).alias("fabrications"), F.count_if(bad & F.col("flagged")).alias("caught"), F.count_if(good).alias("clean"), F.count_if(good & F.col("flagged")).alias("alarms"),
    )
    return n.select("*", rate(F.col("right"), F.col("cases")).alias("score"), rate(F.col("caught"), F.col("fabrications")).alias("recall"), rate(F.col("alarms"), F.col("clean")).alias("false_alarm_rate"))


def judge_live(rows: DataFrame) -> DataFrame:
    """judged_edits, pass_share and the mean of each criterion to two places, all null without edits."""
    return rows.agg(F.count("*").alias("judged_edits"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("pass_share"), *(F.round(F.avg(c), 2).alias(c) for c in CRITERIA))


def live_metrics(attempts: DataFrame) -> DataFrame:
    """Runs of a model: shares of runs that gave a valid reply, edits proposed, accepted and rejected, and the upper median of latencies.

    attempts: valid, proposed, accepted, latency_ms.
    """
    n = F.count("*")
    sums = attempts.agg(
        n.alias("runs"), rate(F.count_if("valid"), n).alias("valid_rate"), F.coalesce(F.sum("proposed"), F.lit(0)).alias("proposed"), F.coalesce(F.sum("accepted"), F.lit(0)).alias("accepted"),
        rate(F.coalesce(F.sum("accepted"), F.lit(0)), F.coalesce(F.sum("proposed"), F.lit(0))).alias("acceptance_rate"),
    )
    middle = upper_medians(attempts.withColumn("all", F.lit(0)), "all", "latency_ms")
    return sums.withColumn("all", F.lit(0)).join(middle, "all", "left").withColumnRenamed("upper_median", "latency_ms").drop("all")


#: Ranges that a group's values are cut into, and how exactly.
RANGES, ACCURACY = 256, 10_000


def upper_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, upper_median: the element at n div 2 of a group's sorted values, not interpolated; nulls don't count.

    Distinct values are counted first.  Near quantiles cut them into ranges, whose counts name the range that holds the place;
    only its values are put in order, so a group of any size is sorted nowhere as a whole.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    counts = rows.groupBy("g", "v").agg(F.count("*").alias("n"))
    cuts = counts.groupBy("g").agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], ACCURACY).alias("cuts"))
    placed = counts.join(cuts, "g").withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    sizes = placed.groupBy("g", "part").agg(F.sum("n").alias("rows"))
    order = Window.partitionBy("g").orderBy("part")
    before = sizes.select("g", "part", (F.sum("rows").over(order) - F.col("rows")).alias("before"), "rows", F.floor(F.sum("rows").over(Window.partitionBy("g")) / 2).alias("place"))
    held = before.where("before <= place AND place < before + rows")
    own = placed.join(held.select("g", "part", "before", "place"), ["g", "part"])
    upto = own.select("g", "v", "place", (F.col("before") + F.sum("n").over(Window.partitionBy("g").orderBy("v"))).alias("upto"))
    return upto.where("upto > place").groupBy(F.col("g").alias(group)).agg(F.min("v").alias("upper_median"))


def passes_threshold(score: Column, least: float | None) -> Column:
    """Whether a run's score meets the least one asked for; without a score it does not."""
    return F.lit(True) if least is None else F.coalesce(score >= least, F.lit(False))


def detections(cases: DataFrame, keys: list[str]) -> DataFrame:
    """By keys: true and false positives and negatives, and their rates.  cases: faulty, flagged."""
    f, hit = F.col("faulty"), F.col("flagged")
    n = cases.groupBy(*keys).agg(F.count_if(f & hit).alias("tp"), F.count_if(f & ~hit).alias("fn"), F.count_if(~f & hit).alias("fp"), F.count_if(~f & ~hit).alias("tn"))
    return n.select("*", rate(F.col("fn"), F.col("tp") + F.col("fn")).alias("miss_rate"), rate(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_alarm_rate"))
