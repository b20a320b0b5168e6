"""Association study in restartable stages: links, controls, fits of both in parts, p-values.

    python jobs/association_study.py --tables DIR --out DIR [--config FILE] [--stages cis,ctrl,...]

Stages: counts, links, controls, cis, ctrl, pvalues; without --stages all of them. Fits are made and
written by parts of the links; a run that broke is started again and makes what is missing. The
result is OUT/pvalues, partitioned by chromosome. Running again with the same tables and settings
writes nothing and gives the same rows; changed tables or settings make every stage anew.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.binning import combined_label
from spanloom.operators.pvalues import fdr_threshold
from spanloom.plans import jobs
from spanloom.plans.inputs import Inputs
from spanloom.plans.stages import Stages

log = logging.getLogger("spanloom.association_study")
STAGES = ("counts", "links", "controls", "cis", "ctrl", "pvalues")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "association_study.json")
#: What says how the work is cut into writes, not what it is.
PACE = ("parts_at_a_time",)


def settings(spark: SparkSession, path: str) -> dict:
    """A config file, read through Spark, so its path may be remote."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def parted(links: DataFrame, n: int) -> DataFrame:
    """Links of a second feature stay together, so that its counts are sent to few parts."""
    return links.withColumn("part", F.pmod(F.xxhash64(F.col("y_id"), F.pmod(F.xxhash64("x_id"), F.lit(2))), F.lit(n)).cast("int"))


def run(spark: SparkSession, tables: str, out: str, config: dict, stages: tuple[str, ...] = STAGES) -> DataFrame | None:
    """Runs the stages named, in order, over the tables of a folder; returns the p-values if they are among them."""
    if unknown := set(stages) - set(STAGES):
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    t, bins, n_parts, pace = Inputs(spark, tables), jobs.Bins.parse(config["bins"]), int(config["parts"]), int(config["parts_at_a_time"])
    made_of = {k: v for k, v in config.items() if k not in PACE}
    s = Stages(spark, out, made_of, [f"{tables.rstrip('/')}/{name}.parquet" for name in ("lineitem", "orders", "customer")])
    n_cells = t.n_cells()

    if "counts" in stages:
        s.whole("x", t.x)
        s.whole("y", t.y)
    if "links" in stages:
        chrom = t.peaks().select(F.col("peak_id").alias("x_id"), "chrom")
        s.whole("links", lambda: jobs.generate_links(t.peaks(), t.genes(), config["distance"], config["bin_width"]).join(chrom, "x_id"))
    if "controls" in stages:
        x, y = s.read("x"), s.read("y")
        held: list = []

        def controls() -> tuple:
            if not held:
                held.append(jobs.generate_controls(x, y, n_cells, bins, config["seed"], config["strict"]))
            return held[0]

        s.whole("x_bins", lambda: controls()[1])
        if not bins.one_sided:
            s.whole("y_bins", lambda: controls()[2])
        s.whole("controls", lambda: controls()[0])

        def grouped() -> DataFrame:
            links, xb = s.read("links"), s.read("x_bins")
            yb = None if bins.one_sided else s.read("y_bins")
            if yb is None:
                links = links.withColumn("grp", F.col("link_id"))
            else:
                a, b = xb.select(F.col("feature_id").alias("x_id"), F.col("bin").alias("_xb")), yb.select(F.col("feature_id").alias("y_id"), F.col("bin").alias("_yb"))
                links = links.join(a, "x_id").join(b, "y_id").withColumn("grp", combined_label(F.col("_xb"), F.col("_yb"))).drop("_xb", "_yb")
            return parted(jobs.with_shortfall(links, xb, yb, bins), n_parts)

        s.whole("grouped_links", grouped)
        s.whole("control_links", lambda: parted(jobs.control_links(s.read("grouped_links"), s.read("controls"), bins), n_parts))
    for stage, work in (("cis", "grouped_links"), ("ctrl", "control_links")):
        if stage in stages:
            x, y = s.read("x"), s.read("y")
            s.in_parts(stage, s.read(work), lambda some, x=x, y=y: jobs.fit(some, x, y, n_cells, config["method"]), pace)
    if "pvalues" in stages:
        out_rows = s.whole("pvalues", lambda: jobs.p_values(s.read("cis").drop("part"), s.read("ctrl").drop("part"), "grp"), "chrom")
        found = fdr_threshold(out_rows, "stud", config["target"]).first()
        log.info("statistic at false discovery rate %s: %s", config["target"], found["t_star"])
        return out_rows
    return None


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--tables", required=True, help="folder with lineitem, orders and customer")
    p.add_argument("--out", required=True, help="folder of the study")
    p.add_argument("--config", default=CONFIG)
    p.add_argument("--stages", default=",".join(STAGES))
    a = p.parse_args()
    logging.basicConfig(format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("spanloom").setLevel(logging.INFO)
    spark = SparkSession.builder.appName("association study").getOrCreate()
    try:
        run(spark, a.tables, a.out, settings(spark, a.config), tuple(a.stages.split(",")))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
