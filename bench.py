"""Headline timings: prints one JSON line.

Per objective: median seconds of one value-and-gradient evaluation on a loaded
batch, after a warm-up.  Per optimizer: seconds and Spark jobs per iteration.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from gradloom.functions import losses as L
from gradloom.operators import gradients as G
from gradloom.operators.batches import BatchCycle
from gradloom.plans import objectives as O
from gradloom.plans import optimizers as M
from gradloom.plans.linesearch import Backtracking
from gradloom.session import build_session
from gradloom.suite import base as B
from gradloom.suite.ranking import ranking_model

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


class Timings(dict):
    """Reports every entry on stderr as it comes in."""

    def __setitem__(self, name, value):
        super().__setitem__(name, value)
        print(f"{name} {value:.3f}", file=sys.stderr, flush=True)


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def evaluation(model, x) -> float:
    times = []
    for n in range(REPEATS + 1):
        started = time.perf_counter()
        _, grad = model.value_grad(x)
        sink(grad)
        if n:
            times.append(time.perf_counter() - started)
        model.tidy()
    return statistics.median(times)


def iteration(spark, method, model, x) -> tuple[float, float]:
    """Seconds and jobs per iteration, the first one left out."""
    stamps, tracker, group = [], spark.sparkContext.statusTracker(), f"bench-{time.time()}"
    spark.sparkContext.setJobGroup(group, "bench")
    for state in method.iterations(model, x):
        if not stamps or state.iteration > stamps[-1][0]:
            stamps.append((state.iteration, time.perf_counter(), len(tracker.getJobIdsForGroup(group))))
    spark.sparkContext.setJobGroup("", "")
    first, last = stamps[1 if len(stamps) > 2 else 0], stamps[-1]
    steps = max(last[0] - first[0], 1)
    return (last[1] - first[1]) / steps, (last[2] - first[2]) / steps


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            # Input files are small: split them over all cores.
            "spark.sql.files.maxPartitionBytes": "2m",
            "spark.sql.files.openCostInBytes": "1m",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, extra = Timings(), Timings()
    dim = B.dim(spark, SF_DIR)
    x = B.w0(spark, SF_DIR).persist()
    reg = BatchCycle(B.ex_reg(spark, SF_DIR), B.fea(spark, SF_DIR))
    binary = BatchCycle(B.ex_bin(spark, SF_DIR), B.fea(spark, SF_DIR))

    started = time.perf_counter()
    reg.next()
    seconds["batch_load"] = time.perf_counter() - started

    seconds["linear_l2_eval"] = evaluation(O.linear_l2(reg, dim), x)
    seconds["linear_quantile_eval"] = evaluation(O.linear_quantile(reg, dim, 0.3), x)
    seconds["linear_binlog_eval"] = evaluation(O.LinearModel(binary, dim, L.LOGISTIC), x)

    targets = G.wide_targets(B.ex_multi(spark, SF_DIR), B.CLASSES)
    softmax = O.linear_softmax(BatchCycle(targets, B.fea_emb(spark, SF_DIR)), B.EMBED_DIM, B.CLASSES)
    seconds["linear_softmax_eval"] = evaluation(softmax, B.m0(spark, SF_DIR))

    ranking = ranking_model(spark, SF_DIR)
    seconds["fm_pair_ranking_eval"] = evaluation(ranking, B.rank_v(spark, SF_DIR))

    dual = O.TransportDual(B.ot_pair(spark, SF_DIR), B.EPS)
    seconds["ot_dual_eval"] = evaluation(dual, B.pot0(spark, SF_DIR).withColumnRenamed("p", "v"))

    runs = {
        "lbfgs_l2_iteration": (M.LBFGS(5, max_iter=5, max_search=30), O.linear_l2(reg, dim), x),
        "lbfgs_softmax_iteration": (M.LBFGS(5, max_iter=4, max_search=30), softmax, B.m0(spark, SF_DIR)),
        "owlqn_l2_iteration": (
            M.OWLQN(5, lambda idx: F.when(idx < 100, 1e-4).otherwise(0.0), max_iter=3, lower_fun_tolerance=1.0),
            O.linear_l2(reg, dim),
            x,
        ),
        "ot_lbfgs_iteration": (
            M.LBFGS(5, search=Backtracking(wolfe=False, strong_wolfe=False), base_step=100.0, max_iter=4),
            dual,
            dual.zero_potentials(),
        ),
    }
    for name, (method, model, start) in runs.items():
        seconds[name], extra[f"{name.removesuffix('_iteration')}_jobs"] = iteration(spark, method, model, start)

    model = O.linear_l2(reg, dim)
    _, grad = model.value_grad(x)
    line = model.line(x.join(grad, "idx").select("idx", F.col("v").alias("x"), (-F.col("g")).alias("d")))
    line.probe([0.0])
    started = time.perf_counter()
    line.probe([0.1 * i for i in range(8)])
    extra["line_probes_per_second"] = 8 / (time.perf_counter() - started)
    line.close()

    print(
        json.dumps(
            {
                "metric": "sum of median seconds: objective evaluations and optimizer iterations",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                **{k: round(v, 2) for k, v in extra.items()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
