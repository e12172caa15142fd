"""Plans over films: shots, intervals, spoken lines on film time, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds kept free at the end of a film, and the least span.
END, LEAST = 0.5, 0.5


def shots_from_cuts(cuts: DataFrame, durations: DataFrame) -> DataFrame:
    """(filename, t, dur): from each cut, and from 0, to the next one or the film's end."""
    edges = durations.select("filename", F.lit(0.0).alias("t")).union(cuts.select("filename", F.col("t").cast("double"))).distinct()
    end = F.lead("t").over(Window.partitionBy("filename").orderBy("t"))
    return edges.withColumn("end", end).join(durations, "filename").select("filename", "t", (F.coalesce("end", "duration") - F.col("t")).alias("dur"))


def interval_plan(durations: DataFrame, budget: int) -> DataFrame:
    """budget equal slices of each film, by midpoint and span."""
    cut = durations.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(budget - 1))))
    return cut.select("filename", "i", ((F.col("i") + 0.5) * F.col("duration") / budget).alias("t"), (F.col("duration") / budget).alias("span"))


def clamp_plan(plan: DataFrame, durations: DataFrame) -> DataFrame:
    at = F.greatest(F.lit(0.0), F.least(F.col("t"), F.col("duration") - END))
    return plan.join(durations, "filename").withColumn("t", at).withColumn("span", F.greatest(F.lit(LEAST), "span")).drop("duration")


def offset_utterances(lines: DataFrame, step: float = 30.0) -> DataFrame:
    """Lines of slice i, timed from its start, on film time; those without text or length go."""
    kept = lines.where((F.col("t1") > F.col("t0")) & (F.trim("text") != ""))
    return kept.withColumn("t0", F.col("i") * step + F.col("t0")).withColumn("t1", F.col("i") * step + F.col("t1")).drop("i")


def newest_first(media: DataFrame, k: int) -> DataFrame:
    """The k newest rows; unknown times last, the later of equals first. Spark keeps k rows a partition."""
    order = (F.col("mtime").desc_nulls_last(), F.col("row_id").desc())
    return media.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


# Seconds a point, least and most points of each preset; what a point costs; points that come in one reply; where frames are taken.
PRESETS = {"eco": (60.0, 4, 32), "balanced": (30.0, 8, 128), "detailed": (15.0, 12, 256), "ultra": (5.0, 16, 1024), "ultraPro": (2.5, 24, 2048)}
DEFAULT, SECONDS_A_POINT, BYTES_A_POINT, REPLY, FRAMES = "balanced", (3, 5), 52 * 1024, 16, (0.2, 0.5, 0.8)


def segment_budget(duration: Column, preset: str = DEFAULT) -> Column:
    """Points of a film: one every few seconds, within the preset's bounds; the least number if the length is unknown."""
    target, least, most = PRESETS.get(preset, PRESETS[DEFAULT])
    n = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(duration / target)))
    return F.when(duration > 0, n).otherwise(least).cast("int")


def enrichment_cost(durations: DataFrame) -> DataFrame:
    """For each preset the points of all films of known length, minutes from low to high, and bytes. One pass, five sums."""
    known = durations.where("duration > 0")
    sums = known.agg(*(F.coalesce(F.sum(segment_budget(F.col("duration"), p)), F.lit(0)).cast("long").alias(p) for p in PRESETS))
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(p).alias("preset"), F.col(p).alias("segments")) for p in PRESETS))).alias("r")).select("r.*")
    low, high = SECONDS_A_POINT
    return rows.select("preset", "segments", (F.col("segments") * low / 60).alias("minutes_low"), (F.col("segments") * high / 60).alias("minutes_high"), (F.col("segments") * BYTES_A_POINT).alias("disk_bytes"))


def sample_shots(shots: DataFrame, durations: DataFrame, preset: str = DEFAULT) -> DataFrame:
    """(filename, t, dur) of shot middles -> as many as the budget has, the nearest unused
    one to the middle of each equal slice. A choice depends on those before it, so a film's shots are one group."""
    rows = shots.join(durations, "filename").withColumn("budget", segment_budget(F.col("duration"), preset))
    return rows.groupBy("filename").applyInPandas(_sampled, "filename string, t double, dur double")


def _sampled(rows):
    import numpy as np

    rows = rows.sort_values(["t", "dur"], kind="stable")
    t, n, duration = rows["t"].to_numpy(float), int(rows["budget"].iloc[0]), float(rows["duration"].iloc[0])
    free, chosen = np.ones(len(t), bool), []
    for i in range(n):
        far = np.where(free, np.abs(t - (i + 0.5) * duration / n), np.inf)
        at = int(far.argmin())
        if np.isfinite(far[at]):
            free[at] = False
            chosen.append(at)
    return rows.iloc[sorted(chosen)][["filename", "t", "dur"]].astype({"t": float, "dur": float})


def segment_plan(cuts: DataFrame, durations: DataFrame, preset: str = DEFAULT) -> DataFrame:
    """(filename, t, span): the middles of a film's shots, those of a sample if there are
    more than the budget, or equal slices where there are no cuts; within the film."""
    known = durations.where("duration > 0").withColumn("budget", segment_budget(F.col("duration"), preset))
    inside = cuts.join(known.select("filename"), "filename", "left_semi")
    films = inside.select("filename").distinct()
    spans = shots_from_cuts(inside, known.select("filename", "duration").join(films, "filename", "left_semi"))
    shots = spans.select("filename", (F.col("t") + F.col("dur") / 2).alias("t"), "dur")
    many = shots.groupBy("filename").agg(F.count("*").alias("n")).join(known, "filename").where("n > budget").select("filename")
    few = shots.join(many, "filename", "left_anti")
    some = sample_shots(shots.join(many, "filename", "left_semi"), known.select("filename", "duration"), preset)
    slices = known.join(films, "filename", "left_anti").withColumn("i", F.explode(F.expr("sequence(0, budget - 1)")))
    slices = slices.select("filename", ((F.col("i") + 0.5) * F.col("duration") / F.col("budget")).alias("t"), (F.col("duration") / F.col("budget")).alias("dur"))
    plan = few.union(some).union(slices).withColumnRenamed("dur", "span")
    return clamp_plan(plan, known.select("filename", "duration"))


def parse_cut_log(logs: DataFrame) -> DataFrame:
    """(filename, log) -> filename, boundaries (sorted, once each), duration: the last clock reading of the log."""
    cuts = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("log", F.lit(r"pts_time:([0-9.]+)"), F.lit(1)), lambda x: x.cast("double"))))
    clocks = F.regexp_extract_all("log", F.lit(r"time=(\d+:\d+:\d+(?:\.\d+)?)"), F.lit(1))
    hms = F.split(F.element_at(clocks, -1), ":")
    seconds = hms[0].cast("double") * 3600 + hms[1].cast("double") * 60 + hms[2].cast("double")
    return logs.select("filename", cuts.alias("boundaries"), F.when(F.size(clocks) > 0, seconds).alias("duration"))


def refine_cuts(coarse: DataFrame, refined: DataFrame) -> DataFrame:
    """(filename, t) and (filename, t, at), cuts found around the coarse cut t -> filename, t: for each coarse cut the nearest found one, or itself."""
    near = refined.groupBy("filename", "t").agg(F.min_by("at", F.struct(F.abs(F.col("at") - F.col("t")).alias("d"), F.col("at").alias("a"))).alias("at"))
    return coarse.join(near, ["filename", "t"], "left").select("filename", F.coalesce("at", "t").alias("t")).distinct()


def frame_times(durations: DataFrame) -> DataFrame:
    """Three places of each film, within it."""
    times = F.array(*(F.greatest(F.lit(0.0), F.least(F.col("duration") - END, F.col("duration") * f)) for f in FRAMES))
    return durations.select("filename", F.posexplode(F.when(F.col("duration") > END, times).otherwise(F.array(F.lit(0.0)))).alias("i", "t"))


def truncated_scenes(segments: DataFrame, preset: str = DEFAULT, per_reply: int = REPLY) -> DataFrame:
    """Films with fewer points than planned, all within less than half of the time."""
    per = segments.groupBy("filename").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max_by(F.col("t") + F.col("dur") / 2, "t").alias("duration"), F.count("*").alias("actual"))
    per = per.where("duration > 0").withColumn("planned", segment_budget(F.col("duration"), preset))
    return per.where((F.col("planned") > per_reply) & (F.col("actual") < F.col("planned")) & (F.col("last") - F.col("first") < F.col("duration") * 0.5)).select("filename", "planned", "actual", "duration")
