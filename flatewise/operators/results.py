"""Benchmark results: normalising, ordered de-duplication, statistics of trials, comparison, guards, tallies, pivots.

Result tables have one row per measurement. Where order matters (de-duplication, last one wins), it is a column given by
the source, never the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import planning as P

#: Guards as a rule table: against whom, which metric, at least or at most what ratio, and where (fixed values).
COMPRESSION_GUARDS = (("pigz", "speed", "ge", 0.95, 0), ("pigz", "size", "le", 1.005, 9))
DECOMPRESSION_GUARDS = (("pigz", 1.0, False), ("gzip", 1.0, True), ("rapidgzip", 0.99, False), ("igzip", 0.90, True))
CV_STABLE, MIN_TRIALS = 0.05, 3
#: Student's t beyond which a slowdown counts (fixed value).
T_CRITICAL = 2.0


def normalised(rows: DataFrame, path: str = "path") -> DataFrame:
    """Defaults for what a result may lack: tool, level, threads, speed (from speed_mbps or speed), size, data_type."""
    have = set(rows.columns)
    one = lambda names, default: F.coalesce(*[F.col(c) for c in names if c in have], F.lit(default))
    return rows.withColumns(
        {
            "tool": P.canonical_tool(one(["tool"], "unknown")), "level": one(["level"], 0), "threads": one(["threads"], 1),
            "speed": one(["speed_mbps", "speed"], 0.0), "size": one(["output_size", "size"], 0), "trials": one(["trials"], 0), "cv": one(["cv"], 1.0),
            "data_type": F.coalesce(*([F.col("data_type")] if "data_type" in have else []), P.data_type_of(F.col(path)) if path in have else F.lit("unknown")),
        }
    )


def result_kind(rows: DataFrame) -> Column:
    """What a row measures, by what it has: decompression (a source or decompressor), validation (a cell's success or
    correctness), compression (a level and threads), else unknown."""
    has = lambda c: F.col(c).isNotNull() if c in rows.columns else F.lit(False)
    return F.when(has("source") | has("decompressor"), "decompression").when(has("success") | has("correct"), "validation").when(has("level") & has("threads"), "compression").otherwise("unknown")


def distinct_levels(rows: DataFrame) -> DataFrame:
    return rows.select("level").where("level is not null").distinct().orderBy("level")


def deduplicated(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """One row per key by a fold in order of arrival: a later row replaces the kept one if it has more trials or,
    failing that, a lower cv. The outcome depends on the order, so it is a fold and not a maximum."""
    rest = [c for c in rows.columns if c not in keys]
    kind = F.struct(F.col(arrival), *[F.col(c) for c in rest if c != arrival])

    def keep(best: Column, row: Column) -> Column:
        more = F.coalesce(row["trials"], F.lit(0)) > F.coalesce(best["trials"], F.lit(0))
        steadier = F.coalesce(row["cv"], F.lit(1.0)) < F.coalesce(best["cv"], F.lit(1.0))
        return F.when(more | steadier, row).otherwise(best)

    ordered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(kind)).alias("rows"))
    best = F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), F.element_at("rows", 1), keep)
    return ordered.select(*keys, best.alias("best")).select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest])


def trial_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    got = rows.groupBy(*keys).agg(F.count(value).alias("trials"), F.median(value).alias("median"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"))
    return got.withColumn("cv", F.when(F.col("mean") > 0, F.col("stdev") / F.col("mean")).otherwise(0.0))


def robust_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median and stdev after dropping values above twice the median, unless fewer than half of them remain.

    One shuffle for the medians, one that deals out each key's values for the median of what remains; the rest are sums."""
    times = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v_"))
    medians = times.groupBy(*keys).agg(F.median("v_").alias("mid"), F.count("*").alias("n"))
    low = F.col("v_") <= 2 * F.col("mid")
    both = times.join(medians, keys)
    got = both.groupBy(*keys).agg(
        F.first("n").alias("n_trials"), F.count_if(low).alias("n_low"), F.first("mid").alias("mid"), F.stddev_samp("v_").alias("sd_all"),
        F.median(F.when(low, F.col("v_"))).alias("mid_low"), F.stddev_samp(F.when(low, F.col("v_"))).alias("sd_low"),
    )
    every = F.col("n_low") < F.floor(F.col("n_trials") / 2)
    pick = lambda a, b, name: F.when(every, F.col(a)).otherwise(F.col(b)).alias(name)
    got = got.select(*keys, "n_trials", pick("n_trials", "n_low", "n_kept"), pick("mid", "mid_low", "median"), F.coalesce(pick("sd_all", "sd_low", "x"), F.lit(0.0)).alias("stdev"))
    stable = (F.col("n_trials") >= MIN_TRIALS) & ((F.col("median") == 0) | (F.col("stdev") / F.when(F.col("median") != 0, F.col("median")) <= CV_STABLE))
    return got.withColumn("stable", F.coalesce(stable, F.lit(False)))


def converged_at(rows: DataFrame, keys: list[str], order: str, value: str, target: float, least: int = 5) -> DataFrame:
    """The first number of trials, from least on, at which the cv of all trials so far is below target; null if never."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("n", F.count(value).over(so_far)).withColumn("cv", F.stddev_samp(value).over(so_far) / F.avg(value).over(so_far))
    return running.groupBy(*keys).agg(F.min(F.when((F.col("n") >= least) & (F.col("cv") < target), F.col("n"))).alias("converged_at"), F.count(value).alias("n_trials"))


def welch(own: DataFrame, other: DataFrame, keys: list[str], value: str, allowance: float) -> DataFrame:
    """keys, ok, overhead_percent, t, df: whether own is not slower than other by more than allowance per cent, by medians
    and their approximate standard errors."""
    side = lambda df, s: df.groupBy(*keys).agg(F.median(value).alias(f"med_{s}"), F.stddev_samp(value).alias(f"sd_{s}"), F.count(value).alias(f"n_{s}"))
    both = side(own, "a").join(side(other, "b"), keys)
    va, vb = F.col("sd_a") * F.col("sd_a") / F.col("n_a"), F.col("sd_b") * F.col("sd_b") / F.col("n_b")
    se = F.sqrt(va + vb)
    few = (F.col("n_a") < 2) | (F.col("n_b") < 2)
    flat = se < 1e-9
    over = (F.col("med_a") / F.col("med_b") - 1) * 100
    shifted = F.col("med_a") - F.col("med_b") - F.col("med_b") * allowance / 100
    ok = F.when(few, False).when(flat, over <= allowance).otherwise(shifted / se < T_CRITICAL)
    t = F.when(few | flat, 0.0).otherwise((F.col("med_a") - F.col("med_b")) / se)
    df = F.when(few, 1.0).when(flat, 0.0).otherwise((va + vb) * (va + vb) / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1)))
    return both.select(*keys, ok.alias("ok"), F.when(few, 0.0).otherwise(over).alias("overhead_percent"), t.alias("t"), df.alias("df"))


def pivoted(rows: DataFrame, keys: list[str], tools: list[str], value: str, arrival: str) -> DataFrame:
    """One column per tool; of repeated rows the last to arrive wins."""
    return rows.groupBy(*keys).pivot("tool", tools).agg(F.max_by(value, arrival))


def _latest(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    got = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("r"))
    return got.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def compression_guards(rows: DataFrame, own: str, arrival: str) -> DataFrame:
    """Guard rows of a tool against its baselines (inner join on level, threads, data type); rows with an error are left out."""
    keys = ["level", "threads", "data_type"]
    good = rows if "error" not in rows.columns else rows.where("error is null")
    last = _latest(good, [*keys, "tool"], arrival)
    mine = last.where(F.col("tool") == own).select(*keys, F.col("speed").alias("own_speed"), F.col("size").alias("own_size"))
    out = None
    for other, metric, sense, threshold, from_level in COMPRESSION_GUARDS:
        theirs = last.where(F.col("tool") == other).select(*keys, F.col(metric).cast("double").alias("other"))
        pair = mine.join(theirs, keys).where((F.col("other") > 0) & (F.col("level") >= from_level)).withColumn("own", F.col(f"own_{metric}").cast("double"))
        ratio = F.col("own") / F.col("other")
        passed = ratio >= threshold if sense == "ge" else ratio <= threshold
        part = pair.select(*keys, F.lit(f"{metric}_vs_{other}").alias("metric"), "own", "other", ratio.alias("ratio"), F.lit(threshold).alias("threshold"), passed.alias("passed"))
        out = part if out is None else out.unionByName(part)
    return out


def decompression_guards(rows: DataFrame, own: str, arrival: str, spark: SparkSession) -> DataFrame:
    """One join with the rule table; rules for one thread only apply there; failed rows don't take part."""
    keys = ["source", "threads", "data_type"]
    good = rows if "status" not in rows.columns else rows.where("status is null or status <> 'fail'")
    last = _latest(good.withColumn("tool", P.canonical_tool(F.col("tool"))), [*keys, "tool"], arrival)
    rules = spark.createDataFrame(COMPARATORS, "tool string, threshold double, single_only boolean")
    mine = last.where(F.col("tool") == own).select(*keys, F.col("speed").alias("own"))
    theirs = last.join(F.broadcast(rules), "tool").where("threads = 1 or not single_only").where("speed > 0").select(*keys, "tool", "threshold", F.col("speed").alias("other"))
    ratio = F.col("own") / F.col("other")
    return mine.join(theirs, keys).select(*keys, F.concat(F.lit("speed_vs_"), F.col("tool")).alias("metric"), "own", "other", ratio.alias("ratio"), "threshold", (ratio >= F.col("threshold")).alias("passed"))


COMPARATORS = list(DECOMPRESSION_GUARDS)


def tally(guards: DataFrame) -> DataFrame:
    """n_guards, n_passed, all_passed, exit_code. No guards at all is a failure, not a pass."""
    got = guards.agg(F.count("*").alias("n_guards"), F.count_if("passed").alias("n_passed"))
    good = (F.col("n_guards") > 0) & (F.col("n_guards") == F.col("n_passed"))
    return got.select("n_guards", "n_passed", good.alias("all_passed"), F.when(good, 0).otherwise(1).alias("exit_code"))


def against(rows: DataFrame, own: str, others: list[str], keys: list[str], value: str) -> DataFrame:
    """Left lookup of each competitor: own value, competitor's, difference in per cent, and a word for it."""
    mine = rows.where(F.col("tool") == own).groupBy(*keys).agg(F.max(value).alias("own"))
    out = None
    for other in others:
        theirs = rows.where(F.col("tool") == other).groupBy(*keys).agg(F.max(value).alias("other"))
        diff = P.difference_percent(F.col("own"), F.col("other"))
        part = mine.join(theirs, keys, "left").select(*keys, F.lit(other).alias("competitor"), "own", "other", diff.alias("diff_percent"), F.when(diff.isNull(), "-").otherwise(P.verdict(diff)).alias("verdict"))
        out = part if out is None else out.unionByName(part)
    return out


def with_baseline(rows: DataFrame) -> DataFrame:
    """The tool a row is compared with: gzip on one thread, pigz on more."""
    return rows.withColumn("baseline", F.when(F.col("threads") == 1, "gzip").otherwise("pigz"))


#: From each level on: allowed growth of the size, in per cent, of benchmark runs; and allowed loss of time and growth of
#: size in validation (fixed values).
SIZE_ALLOWANCES = ((0, 8.0), (6, 2.0), (9, 0.5), (10, -3.0))
VALIDATION_ALLOWANCES = ((0, 2.0, 8.0), (7, 5.0, 2.0), (9, 5.0, 0.5))


def _by_level(rows: DataFrame, ladder: tuple, columns: list[str]) -> DataFrame:
    """rows with a ladder's values by range join: each step reaches to the next."""
    ends = [*(step[0] for step in ladder[1:]), 1 << 30]
    table = [(step[0], end, *step[1:]) for step, end in zip(ladder, ends)]
    ranges = rows.sparkSession.createDataFrame(table, ", ".join(["low_ int", "high_ int", *(f"{c} double" for c in columns)]))
    return rows.join(F.broadcast(ranges), (F.col("level") >= F.col("low_")) & (F.col("level") < F.col("high_"))).drop("low_", "high_")


def allowances(rows: DataFrame) -> DataFrame:
    """time_allowance and size_allowance of benchmark runs, by level and size."""
    return _by_level(rows, SIZE_ALLOWANCES, ["size_allowance"]).withColumn("time_allowance", P.time_allowance(F.col("level"), F.col("size_mb")))


def validation_allowances(rows: DataFrame) -> DataFrame:
    """time_allowed and size_allowed of validation, by level."""
    return _by_level(rows, VALIDATION_ALLOWANCES, ["time_allowed", "size_allowed"])


def cells(spark: SparkSession, levels: list[int], threads: list[int], tools: list[str]) -> DataFrame:
    """The validation matrix: every level, thread count, compressor and decompressor."""
    each = lambda values, name: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    rows = spark.range(1, numPartitions=1).select(each(levels, "level")).select("level", each(threads, "threads"))
    return rows.select("level", "threads", each(tools, "compressor")).select("level", "threads", "compressor", each(tools, "decompressor"))


def first_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def fastest(rows: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(name, value).alias("fastest"), F.max(value).alias("peak"))
