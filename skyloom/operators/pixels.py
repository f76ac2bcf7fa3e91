"""Image operators over long pixel tables ``(image_id, x, y, v)``: scaling, binning, background.

Everything is grouped by ``image_id``; histograms have at most 65,002 bins an image, and iterations
run on them, never on pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_BIN = 65001


def finite(c: str = "v"):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))


def normalised(pixels: DataFrame, native_range: float = 4096.0, target: float = 20000.0, floor: float = 100.0) -> DataFrame:
    """Pixels of a narrow range are stretched so that the 99.9th percentile of a strided sample is ``target``."""
    span = pixels.groupBy("image_id").agg(
        F.min(F.when(finite(), F.col("v"))).alias("lo"), F.max(F.when(finite(), F.col("v"))).alias("hi"), F.count("*").alias("n"), (F.max("x") + 1).alias("w"))
    span = span.withColumn("stride", F.greatest(F.floor(F.col("n") / 200000), F.lit(1)))
    filled = pixels.join(span, "image_id").withColumn("v", F.when(F.col("lo").isNull(), 0.0).when(finite(), F.col("v")).otherwise(F.col("lo")))
    place = F.col("y").cast("long") * F.col("w") + F.col("x")
    sample = filled.where(place % F.col("stride") == 0)
    ranked = sample.select("image_id", "v", F.row_number().over(Window.partitionBy("image_id").orderBy("v")).alias("rn"), F.count("*").over(Window.partitionBy("image_id")).alias("m"))
    top = ranked.where(F.col("rn") - 1 == F.least(F.floor(F.col("m") * 0.999), F.col("m") - 1)).select("image_id", F.col("v").alias("p999"))
    met = filled.join(top, "image_id")
    stretch = (F.col("hi") - F.col("lo") < native_range) & (F.col("p999") > F.col("lo"))
    scale = target / (F.col("p999") - F.col("lo"))
    return met.select("image_id", "x", "y", F.when(stretch, F.col("v") * scale + (floor - F.col("lo") * scale)).otherwise(F.col("v")).alias("v"))


def binned(pixels: DataFrame, factor: int) -> DataFrame:
    """Means of square blocks; blocks that the frame's edge cuts are dropped."""
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    whole = pixels.join(size, "image_id").where((F.col("x") < F.floor(F.col("w") / factor) * factor) & (F.col("y") < F.floor(F.col("h") / factor) * factor))
    keys = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("x", "y")]
    return whole.groupBy("image_id", *keys).agg(F.avg("v").alias("v"))


def debayered(pixels: DataFrame) -> DataFrame:
    """The four phases of a colour filter are scaled to the brightest, by their means in the middle of the frame."""
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    phase = (F.col("x") % 2 + 2 * (F.col("y") % 2)).alias("phase")
    rows = pixels.join(size, "image_id").select("*", phase)
    inside = lambda c, n: (F.col(c) >= F.floor(F.col(n) / 4)) & (F.col(c) <= F.least(F.floor(F.col(n) * 3 / 4), F.col(n) - 1))
    means = rows.where(inside("x", "w") & inside("y", "h")).groupBy("image_id", "phase").agg(F.avg("v").alias("m"))
    by = Window.partitionBy("image_id")
    sound = (F.count("*").over(by) == 4) & (F.min("m").over(by) > 0) & (F.max("m").over(by) < float("inf"))
    factor = means.select("image_id", "phase", F.when(sound, F.max("m").over(by) / F.col("m")).otherwise(1.0).alias("f"))
    return rows.join(factor, ["image_id", "phase"], "left").select("image_id", "x", "y", F.when(F.col("f") != 1.0, F.rint(F.col("v") * F.col("f"))).otherwise(F.col("v")).alias("v"))


def binning(scale, width, height):
    """Automatic binning for a pixel scale (arc seconds), so that both sides keep two pixels."""
    wanted = F.when(scale < 1, F.least(F.lit(16), F.greatest(F.lit(1), F.round(1 / scale)))).otherwise(F.lit(1))
    return F.greatest(F.lit(1), F.least(wanted, F.floor(F.least(width, height) / 2))).cast("long")


def histogram(pixels: DataFrame, top: int = TOP_BIN) -> DataFrame:
    """Counts of truncated values 0..top; values that aren't finite are skipped, negative ones are 0."""
    bin_ = F.greatest(F.lit(0), F.when(F.col("v") > 0, F.floor("v")).otherwise(0)).cast("long").alias("bin")
    return pixels.where(finite()).select("image_id", bin_).where(F.col("bin") <= top).groupBy("image_id", "bin").agg(F.count("*").alias("n"))


def clipped_mean(hist: DataFrame, rounds: int = 6, upper: int = TOP_BIN, tolerance: float = 0.1) -> DataFrame:
    """Mean and deviation of a histogram, clipped above at two deviations until both settle."""
    state = hist.select("image_id").distinct().select("image_id", F.lit(0.0).alias("mean"), F.lit(0.0).alias("sd"), F.lit(float(upper)).alias("hi"), F.lit(False).alias("done"))
    for k in range(rounds):
        sums = hist.join(state.select("image_id", "hi"), "image_id").where(F.col("bin") <= F.col("hi")).groupBy("image_id").agg(
            F.sum("n").cast("double").alias("t"), F.sum(F.col("bin") * F.col("n")).cast("double").alias("s"), F.sum(F.col("bin") * F.col("bin") * F.col("n")).cast("double").alias("q"))
        mean = F.col("s") / F.col("t")
        sd = F.sqrt(F.when(F.col("t") > 1, F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("t")) / (F.col("t") - 1))).otherwise(0.0))
        new = state.join(sums, "image_id").withColumn("m2", mean).withColumn("s2", sd)
        settled = F.lit(k > 0) & (F.abs(F.col("m2") - F.col("mean")) < tolerance) & (F.abs(F.col("s2") - F.col("sd")) < tolerance)
        hi = F.when(F.col("s2") > 0, F.least(F.lit(float(upper)), F.floor(F.col("m2") + 2 * F.col("s2") + 0.5))).otherwise(F.col("hi"))
        keep = lambda old, fresh: F.when(F.col("done"), F.col(old)).otherwise(fresh)
        state = new.select("image_id", keep("mean", F.col("m2")).alias("mean"), keep("sd", F.col("s2")).alias("sd"), keep("hi", hi).alias("hi"), (F.col("done") | settled).alias("done"))
    return state.select("image_id", "mean", "sd")


def background_mode(hist: DataFrame, pixels_per_image: DataFrame) -> DataFrame:
    """The mode below the mean (ties: the lowest value, 0 excluded), or the mean if it is far above."""
    sums = hist.groupBy("image_id").agg(F.sum(F.col("bin") * F.col("n")).alias("s")).join(pixels_per_image, "image_id")
    mean = sums.select("image_id", F.floor(F.col("s") / F.col("n_pixels")).cast("double").alias("mean"))
    below = hist.join(mean, "image_id").where((F.col("bin") >= 1) & (F.col("bin") <= F.col("mean")))
    mode = below.groupBy("image_id").agg(F.max(F.struct("n", (-F.col("bin")).alias("b")))["b"].alias("b")).select("image_id", (-F.col("b")).cast("double").alias("mode"))
    met = mean.join(mode, "image_id", "left")
    return met.select("image_id", F.when(F.col("mean") == 0, 0.0).when(F.col("mean") > 1.5 * F.coalesce("mode", F.lit(0.0)), F.col("mean")).otherwise(F.col("mode")).alias("background"))


def noise(pixels: DataFrame, background: DataFrame, rounds: int = 7) -> DataFrame:
    """Deviation about the background on a sparse grid, clipped at three deviations until it settles to 5 %."""
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    step = F.greatest(F.lit(1), F.round(F.col("h") / 71)).cast("long")
    step = step + (step % 2 == 0).cast("long")
    met = pixels.join(size, "image_id").withColumn("step", step).join(background, "image_id")
    on = lambda c, n: (F.col(c) >= 15) & (F.col(c) <= F.col(n) - 16) & ((F.col(c) - 15) % F.col("step") == 0)
    sample = met.where(on("x", "w") & on("y", "h") & (F.col("v") < 2 * F.col("background")) & (F.col("v") != 0)).select("image_id", (F.col("v") - F.col("background")).alias("d"))
    # the grid has about 71 rows whatever the image, so its values fit in one row; rounds run inside an expression
    grid = sample.groupBy("image_id").agg(F.collect_list("d").alias("d"))

    def step_(state, k):
        near = F.filter("d", lambda x: (k == 0) | (F.abs(x) <= 3 * state["sd"]))
        total = F.aggregate(near, F.lit(0.0), lambda s, x: s + x * x)
        new = F.when(F.size(near) > 0, F.sqrt(total / F.size(near))).otherwise(0.0)
        return F.when(state["done"], state).otherwise(F.struct(new.alias("sd"), (F.abs(state["sd"] - new) < 0.05 * new).alias("done")))

    start = F.struct(F.lit(1e9).alias("sd"), F.lit(False).alias("done"))
    settled = grid.select("image_id", F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step_)["sd"].alias("noise"))
    return background.select("image_id").join(settled, "image_id", "left").select("image_id", F.coalesce("noise", F.lit(0.0)).alias("noise"))


def star_levels(hist: DataFrame, background: DataFrame, noise_: DataFrame, max_stars: int = 500) -> DataFrame:
    """The levels above which 6 and 24 times ``max_stars`` pixels lie, over the background."""
    met = hist.join(background, "image_id").where((F.col("bin") >= F.floor(F.col("background") + 1)) & (F.col("bin") < TOP_BIN))
    above = met.withColumn("above", F.sum("n").over(Window.partitionBy("image_id").orderBy(F.desc("bin"))))
    raw = above.groupBy("image_id").agg(*[F.max(F.when(F.col("above") >= k * max_stars, F.col("bin"))).alias(f"raw{k}") for k in (6, 24)])
    all_ = background.join(noise_, "image_id").join(raw, "image_id", "left")
    floor = F.greatest(3.5 * F.col("noise"), F.lit(1.0))
    level = lambda k: F.greatest(floor, F.coalesce(F.col(f"raw{k}"), F.lit(0)) - F.col("background") - 1, F.lit(0.0))
    return all_.select("image_id", "background", "noise", level(6).alias("star_level"), level(24).alias("star_level2"))


def background(pixels: DataFrame, max_stars: int = 500) -> DataFrame:
    """B03-B05 in one: one row an image."""
    hist = histogram(pixels)
    mode = background_mode(hist, pixels.groupBy("image_id").agg(F.count("*").alias("n_pixels")))
    return star_levels(hist, mode, noise(pixels, mode), max_stars)


def binned_size(width: Column, height: Column, bin_: Column) -> tuple[Column, Column]:
    """The size of an image after binning."""
    b = F.greatest(bin_, F.lit(1))
    return F.floor(width / b).cast("long"), F.floor(height / b).cast("long")
