"""Command line: define, assess, cluster, recluster, version."""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, Timers, log_to
from .operators.balance import tendency
from .operators.classify import curve_classify, density_split, halving, shrinking
from .operators.stats import b_cubed
from .sources.files import read_points, write_points

VERSION = "0.1"


def load(spark: SparkSession, config: Config) -> DataFrame:
    """Points with a numeric row id (the line number); the id of the file stays beside it."""
    rows, bad = read_points(spark, config.input, config.data)
    for r in bad.groupBy("reason").count().collect():
        logging.getLogger("curveloom").warning("%d lines left out: %s", r["count"], r.reason)
    return rows.select(F.col("line_no").alias("id"), "coords", F.col("category").alias("label"), F.col("id").alias("name"))


def assess(spark: SparkSession, config: Config) -> DataFrame:
    return tendency(load(spark, config), config.index.outlier_size)


def cluster(spark: SparkSession, config: Config, again: bool = False) -> tuple[DataFrame, float | None]:
    """Labelled points, and their B-Cubed score against the categories read if those group the points. ``again`` starts from the initial classes."""
    points = load(spark, config).cache()
    size = points.agg(F.max(F.size("coords")).alias("d"), F.max(F.array_max("coords")).alias("m"), F.count_distinct("label").alias("k"), F.count("*").alias("n")).first()
    i, c, d = config.index, config.classifier, config.density
    bits = i.bits if i.bits > 0 else max(1, int(size.m).bit_length())
    rounds = max(1, (i.max_trials + i.parallel_trials // 2) // i.parallel_trials)
    labels, s = curve_classify(
        points, size.d, bits, i.outlier_size, i.noise_skip, c.neighbors, c.outlier_factor, c.merge_distance or None, exact=c.exact_distance,
        start=points.select("id", "label") if again else None, trials=i.parallel_trials, rounds=rounds, strategy=shrinking if i.strategy == "shrinking" else halving,
    )
    if not d.skip:
        parts = density_split(points.drop("label").join(labels, "id"), size.d, bits, s, d.window, int(s * d.radius_factor), d.mergeable_shrinkage, d.unmergeable_fraction)
        several = parts.groupBy("label").agg(F.count_distinct("part").alias("k"))
        labels = parts.join(several, "label").select("id", F.when(F.col("k") > 1, F.concat_ws("-", F.col("label").cast("string"), F.col("part").cast("string"))).otherwise(F.col("label").cast("string")).alias("label"))
    score = None
    if size.k and size.k < size.n:
        score = b_cubed(points.select("id", "label"), labels.select("id", "label")).first().f
    return points.drop("label").join(labels.withColumn("category", F.col("label").cast("string")), "id"), score


COMMANDS = ["help", "version", "define", "assess", "cluster", "recluster"]


def command(text: str) -> str:
    """The command that a text names: in full or by its first letter, in any case, with any dashes before it; anything else is help."""
    name = text.lstrip("-").lower()
    return next((c for c in COMMANDS if name in (c, c[0])), "help")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="curveloom", description=__doc__, add_help=False)
    p.add_argument("command", help="help, version, define, assess, cluster or recluster; the first letter will do")
    p.add_argument("config", nargs="?")
    p.add_argument("input", nargs="?")
    p.add_argument("output", nargs="?")
    given = list(sys.argv[1:] if argv is None else argv)
    what = command(given[0]) if given else "help"
    if what == "help":
        p.print_help()
        return 0
    if what == "version":
        print(VERSION)
        return 0
    a = p.parse_args([what, *given[1:]])
    if not a.config:
        p.error("a configuration file is needed")
    if what == "define":
        Config().write(a.config)
        return 0
    config = Config.read(a.config)
    config = replace(config, input=a.input or config.input, output=replace(config.output, path=a.output or config.output.path))
    log_to(config.output)
    spark, timers = SparkSession.builder.getOrCreate(), Timers()
    with timers.stage(what):
        if what == "assess":
            print(assess(spark, config).first().asDict())
            return 0
        out, score = cluster(spark, config, again=what == "recluster")
        dims = out.agg(F.max(F.size("coords"))).first()[0]
        write_points(out.select(F.coalesce("name", F.col("id").cast("string")).alias("id"), "category", "coords", F.col("id").alias("line_no")), config.output.path, dims, (config.output.id_name, config.output.category_name), config.output.header)
    if score is not None:
        logging.getLogger("curveloom").info("B-Cubed %.4f: %s", score, "accepted" if score >= config.acceptable_b_cubed else "not accepted")
    timers.log()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
