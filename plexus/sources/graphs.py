"""Graph files as DataFrames.  Files are read as text by Spark's own readers, so any store serves.

All loaders return ``(src, dst, w)`` unless they say otherwise, drop self loops and malformed lines,
and leave ids as they are; ``dense_ids`` renumbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexus.functions import synth_weight
from plexus.operators.graph import normalise, symmetric
from plexus.operators.sorting import rank_all, top_by_count

# Hubs kept of a transfer file, the clamp of its weights, the rating of no trust at all.
TRANSFER_HUBS, WEIGHT_CLAMP, FULL_RATING = 5000, 20, 11


def _lines(spark: SparkSession, path: str, comments: str) -> DataFrame:
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("line")).filter((line != "") & ~F.substring(line, 1, 1).isin(*comments))


def _fields(lines: DataFrame, pattern: str = r"[\s,]+") -> DataFrame:
    return lines.select(F.split("line", pattern).alias("f"))


def _long(at: int) -> Column:
    return F.expr(f"try_cast(get(f, {at}) as bigint)")


def _double(at: int) -> Column:
    return F.expr(f"try_cast(get(f, {at}) as double)")


def snap(spark: SparkSession, path: str) -> DataFrame:
    """Edge list ``u v``, ``#`` comments; both directions at weight 1, duplicates kept."""
    e = _fields(_lines(spark, path, "#")).select(_long(0).alias("u"), _long(1).alias("v"), F.lit(1).cast("long").alias("w"))
    return symmetric(e.filter("u is not null and v is not null and u <> v"))


def snap_road(spark: SparkSession, path: str) -> DataFrame:
    """Road network as ``u v``: undirected edges ``(u, v, w)`` of weight 1, each once."""
    return normalise(snap(spark, path).select(F.col("src").alias("u"), F.col("dst").alias("v"), "w"))


def snap_weighted(spark: SparkSession, path: str) -> DataFrame:
    """Undirected edges ``(u, v, w)`` of ``u v [w [time]]``: the least ``|w|`` of parallels, and a
    weight made from the ends where there is none or it is 0."""
    e = _fields(_lines(spark, path, "#%")).select(_long(0).alias("u"), _long(1).alias("v"), F.abs(_double(2)).alias("given"))
    low, high = F.least("u", "v"), F.greatest("u", "v")
    w = F.when(F.coalesce(F.col("given"), F.lit(0.0)) > 0, F.col("given")).otherwise(synth_weight(low, high))
    return normalise(e.filter("u is not null and v is not null").select("u", "v", w.alias("w")))


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate matrix, 1-based, ``real``, ``integer`` or ``pattern``; off-diagonal entries as
    ``(u, v, w)`` from 0, duplicates kept, pattern entries with a weight made from the ends."""
    lines = _lines(spark, path, "%")
    e = _fields(lines).withColumn("at", F.monotonically_increasing_id())
    first = e.agg(F.min("at")).first()[0]
    body = e.filter(F.col("at") != F.lit(-1 if first is None else first)).select((_long(0) - 1).alias("u"), (_long(1) - 1).alias("v"), _double(2).alias("w"))
    return body.filter("u is not null and v is not null and u <> v").select("u", "v", F.coalesce("w", synth_weight(F.least("u", "v"), F.greatest("u", "v"))).alias("w"))


def signed_trust(spark: SparkSession, path: str, undirected: bool = True) -> DataFrame:
    """Ratings ``source,target,rating,time`` without a header.

    Undirected: ``(u, v, w)`` with ``w = max(1, 11 - |rating|)``, least of parallels.  Directed:
    ``(src, dst, w)`` with the rating itself as weight.
    """
    rows = spark.read.schema("src long, dst long, rating int, time double").csv(path).filter("src is not null and dst is not null and src <> dst")
    if not undirected:
        return rows.select("src", "dst", F.col("rating").cast("long").alias("w"))
    w = F.greatest(F.lit(1), FULL_RATING - F.abs("rating")).cast("long")
    return normalise(rows.select(F.col("src").alias("u"), F.col("dst").alias("v"), w.alias("w")))


def transfers(spark: SparkSession, path: str | list[str], hubs: int = TRANSFER_HUBS) -> DataFrame:
    """Token transfers between the ``hubs`` busiest addresses as ``(src, dst, w)`` with addresses.

    A line's first two ``0x`` fields are sender and receiver, its last field is the value; fields
    part at comma, semicolon or tab.  The weight is ``-round(log10 value)`` within 20 of zero, and 20
    for a value that is not positive.  Lines that start with ``block`` are headers.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter(~F.col("line").startswith("block") & (F.col("line") != ""))
    fields = F.split(F.regexp_replace("line", '"', ""), r"\s*[,;\t]\s*")
    ends = F.filter("f", lambda x: x.startswith("0x"))
    rows = lines.select(fields.alias("f")).filter(F.size("f") >= 7).select(
        F.lower(F.get(ends, F.lit(0))).alias("src"), F.lower(F.get(ends, F.lit(1))).alias("dst"), F.expr("try_cast(element_at(f, -1) as double)").alias("value")
    ).filter("src is not null and dst is not null and value is not null")
    busy = top_by_count(rows.select("src").union(rows.select("dst")), "src", hubs).select("src")
    kept = rows.filter("src <> dst").join(busy, "src", "left_semi").join(busy.withColumnRenamed("src", "dst"), "dst", "left_semi")
    power = F.greatest(F.lit(-WEIGHT_CLAMP), F.least(F.lit(WEIGHT_CLAMP), -F.round(F.log10("value"))))
    return kept.select("src", "dst", F.when(F.col("value") > 0, power).otherwise(WEIGHT_CLAMP).cast("long").alias("w"))


def exchange_transfers(spark: SparkSession, path: str) -> DataFrame:
    """Transfers ``src,dst,amount`` with the number of digits of the amount's whole part as weight."""
    rows = spark.read.schema("src string, dst string, amount string").csv(path, header=True).filter("src is not null and dst is not null and src <> dst")
    return rows.select("src", "dst", F.length(F.regexp_extract("amount", r"^\d+", 0)).cast("long").alias("w"))


def grid_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cells ``(id, x, y, cost)`` and edges ``(src, dst, w)`` of a grid map file.

    ``.`` and ``G`` cost 1, ``S`` costs 2, all else is blocked.  A cell joins its eight neighbours,
    diagonally only if both cells beside the step are free, at the mean cost straight and at
    1.41421356 times the greater cost diagonally.
    """
    lines = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r", "").alias("value"))
    body = lines.select(F.split(F.regexp_extract("value", r"(?s)\nmap\s*\n(.*)$", 1), "\n").alias("rows"))
    rows = body.select(F.posexplode("rows").alias("y", "line")).filter("line <> ''")
    cells = rows.select("y", F.posexplode(F.filter(F.split("line", ""), lambda c: c != "")).alias("x", "c")).select(
        "x", "y", F.when(F.col("c").isin(".", "G"), 1.0).when(F.col("c") == "S", 2.0).alias("cost")
    ).filter("cost is not null")
    width = (cells.agg(F.max("x")).first()[0] or 0) + 1
    cells = cells.select((F.col("y").cast("long") * width + F.col("x")).alias("id"), "x", "y", "cost")
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])).alias("s")
    moved = cells.select("id", "x", "y", "cost", steps).select("id", "cost", "x", "y", (F.col("x") + F.col("s.dx")).alias("tx"), (F.col("y") + F.col("s.dy")).alias("ty"))
    there = cells.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("id").alias("dst"), F.col("cost").alias("there"))
    reached = moved.join(there, ["tx", "ty"])
    side = cells.select(F.col("x").alias("ax"), F.col("y").alias("ay"))
    straight = reached.filter("tx = x or ty = y").select(F.col("id").alias("src"), "dst", ((F.col("cost") + F.col("there")) / 2).alias("w"))
    diagonal = (
        reached.filter("tx <> x and ty <> y").join(side, (F.col("ax") == F.col("tx")) & (F.col("ay") == F.col("y")), "left_semi")
        .join(side, (F.col("ax") == F.col("x")) & (F.col("ay") == F.col("ty")), "left_semi")
        .select(F.col("id").alias("src"), "dst", (F.greatest("cost", "there") * 1.41421356).alias("w"))
    )
    return cells, straight.union(diagonal)


def scenarios(spark: SparkSession, path: str, per_bucket: int | None = None) -> DataFrame:
    """Scenario lines ``(bucket, map, w, h, sx, sy, gx, gy, opt)``, evenly sampled in each bucket."""
    rows = spark.read.schema("bucket int, map string, w int, h int, sx int, sy int, gx int, gy int, opt double").csv(path, sep="\t").filter("gy is not null")
    if per_bucket is None:
        return rows
    order = Window.partitionBy("bucket").orderBy("opt", "sx", "sy", "gx", "gy")
    placed = rows.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("bucket")))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / per_bucket))
    return placed.filter((F.col("i") % step == 0) & (F.col("i") / step < per_bucket)).drop("i", "n")


def transactions(spark: SparkSession, features: str, classes: str, edges: str, n_features: int = 94, buckets: int = 16) -> tuple[DataFrame, DataFrame]:
    """Labelled transactions ``(id, step, x, label, bucket)`` and their edges ``(src, dst, w)``.

    ``x`` is the mean of the first features; label 1 is illicit, 0 licit; unknown ones and edges that
    touch them are left out.  ``bucket`` is the quantile of ``x``, and every node gets a self loop of
    0.10 beside its out-edges, which share the rest.
    """
    wide = spark.read.csv(features).toDF(*[f"c{i}" for i in range(len(spark.read.csv(features).columns))])
    n = min(n_features, len(wide.columns) - 2)
    mean = sum(F.expr(f"try_cast(c{i + 2} as double)") for i in range(n)) / n
    rows = wide.select(F.expr("try_cast(c0 as bigint)").alias("id"), F.expr("try_cast(try_cast(c1 as double) as int)").alias("step"), mean.alias("x")).filter("id is not null")
    label = spark.read.csv(classes).toDF("id", "class").select(F.expr("try_cast(id as bigint)").alias("id"), F.expr("case class when '1' then 1 when '2' then 0 end").alias("label"))
    known = rows.join(label.filter("label is not null and id is not null"), "id")
    cuts = known.stat.approxQuantile("x", [i / buckets for i in range(1, buckets)], 0.0005)
    bucket = F.lit(0)
    for c in cuts:
        bucket = bucket + (F.col("x") > F.lit(c)).cast("int")
    known = known.withColumn("bucket", bucket)
    ends = spark.read.csv(edges).toDF("src", "dst").select(F.expr("try_cast(src as bigint)").alias("src"), F.expr("try_cast(dst as bigint)").alias("dst"))
    inner = ends.filter("src <> dst").distinct().join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi")
    degree = inner.groupBy("src").agg(F.count("*").alias("n"))
    out = inner.join(degree, "src").select("src", "dst", (F.lit(0.9) / F.col("n")).alias("w"))
    own = known.select(F.col("id").alias("src"), F.col("id").alias("dst")).join(degree, "src", "left").select("src", "dst", F.when(F.col("n").isNull(), 1.0).otherwise(0.1).alias("w"))
    return known, out.union(own)


def stochastic(edges: DataFrame) -> DataFrame:
    """``(i, j, p)``: every distinct edge without loops at one over its source's degree."""
    e = edges.select(F.col("src").alias("i"), F.col("dst").alias("j")).filter("i <> j").distinct()
    return e.join(e.groupBy("i").agg(F.count("*").alias("n")), "i").select("i", "j", (1 / F.col("n")).alias("p"))


def dense_ids(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with ids from 0 in the order of the old ones, and the table ``(old, id)``."""
    old = edges.select(F.col("src").alias("old")).union(edges.select(F.col("dst").alias("old"))).distinct()
    names = rank_all(old, [F.col("old")], "id").select("old", (F.col("id") - 1).alias("id"))
    a, b = (names.select(F.col("old").alias(c), F.col("id").alias(f"{c}_id")) for c in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "w"), names


FORMATS = {"snap": snap, "snap_road": snap_road, "snap_weighted": snap_weighted, "matrix_market": matrix_market, "signed_trust": signed_trust, "transfers": transfers}


def load(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Load by format name, or by the file's ending."""
    if kind is None:
        kind = "matrix_market" if path.endswith(".mtx") else "signed_trust" if path.endswith(".csv") else "snap_weighted"
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target):
        raise FileNotFoundError(path)
    return FORMATS[kind](spark, path)


def write_results(results: DataFrame, path: str) -> None:
    """Benchmark rows as CSV with a header."""
    results.write.mode("overwrite").csv(path, header=True)
