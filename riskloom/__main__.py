"""Command-line jobs for real credit files (``spark-submit -m riskloom ...`` or ``python -m riskloom``).

    python -m riskloom convert  --raw DIR --out DIR            (CSV -> Parquet, once)
    python -m riskloom features --raw DIR --out DIR [--format csv|parquet]
    python -m riskloom build    --raw DIR --out DIR [--format csv|parquet] [--buckets N]
    python -m riskloom eda      --raw DIR --out DIR [--format csv|parquet]
    python -m riskloom train    --raw DIR --out DIR [--format csv|parquet] [--model lr|gbt] [--features DIR]

``build`` writes what ``features`` writes as a committed build: unchanged inputs are not computed again, an interrupted
job leaves the last build, and the tables have the same buckets. ``train --features DIR`` trains on the tables that
``features --out DIR`` or ``build --out DIR`` wrote, and reads no raw history.

The session comes from ``SparkSession.builder.getOrCreate()`` so that the
cluster's own settings (master, executors, ``spark.checkpoint.dir``) apply.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .session import apply_cluster_settings, ensure_defaults
from .sources import readers, sinks


class _Sources:
    """Raw sources under the attribute names the plans use."""

    def __init__(self, spark: SparkSession, raw_dir: str, frames: readers.Sources):
        self.spark = spark
        self.sf_dir = raw_dir
        self.frames = frames

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in self.__dict__.get("frames", ()):
            raise AttributeError(name)
        return self.frames[name]


def _features(spark, src, out):
    paths = sinks.build_features(spark, src.frames, out)
    for name, path in paths.items():
        print(f"{name}: {path}")


def _build(spark, src, out, buckets):
    from .plans.build import TABLES
    from .sources.committed import Build, fingerprint

    prints = {name: fingerprint(spark, path) for name, path in src.frames.paths.items()}
    with Build(spark, out) as build:
        made = build.run(TABLES, src.frames, prints, buckets)
        for table in TABLES:
            print(f"{table.name}: {build.path(table.name)}{'' if table.name in made else ' (unchanged)'}")


def _eda(spark, src, out):
    from .plans import eda

    app = src.application
    results = {
        "quantile_bins": eda.all_quantile_bins(app),
        "family_bins": eda.family_bins(app),
        "children_bins": eda.children_bins(app),
        "hour_bands": eda.hour_band_rates(app),
        "category_rates": eda.category_rates(app),
        "missing_rates": eda.missing_rates(app),
        "target_distribution": eda.target_distribution(app),
    }
    for name, df in results.items():
        sinks.write_table(df.coalesce(1), f"{out.rstrip('/')}/eda/{name}")  # small summaries: one file each
        print(f"eda/{name}")


def _train(spark, src, out, model: str):
    from .operators import metrics
    from .operators import model as ml
    from .plans import modeling

    if model == "lr":
        table, fit = modeling.lr_fit(src)
        splits = ["train", "validation", "test"]
    else:
        table, fit = modeling.tree_fit(src)
        splits = ["train", "validation"]
    report = ml.evaluate(fit, table, splits)
    scored = ml.score(fit.model, ml.prepare(table.where(F.col("split") == "validation"), fit.features, fit.medians))
    base = out.rstrip("/")
    sinks.write_table(report.coalesce(1), f"{base}/{model}/auc")
    sinks.write_table(metrics.threshold_sweep(scored, "score", ml.LABEL).coalesce(1), f"{base}/{model}/threshold_sweep")
    fit.model.write().overwrite().save(f"{base}/{model}/model")
    report.show()


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="riskloom")
    ap.add_argument("job", choices=["convert", "features", "build", "eda", "train"])
    ap.add_argument("--raw", required=True, help="folder with the seven raw files")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--model", default="lr", choices=["lr", "gbt"])
    ap.add_argument("--features", help="folder of a finished features or build job to train on")
    ap.add_argument("--buckets", type=int, help="buckets of the tables of a build (unset: those of the last one, else the shuffle partitions)")
    ap.add_argument("--cluster-defaults", action="store_true",
                    help="apply the suggested large-cluster settings the session leaves unset")
    args = ap.parse_args(argv)

    spark = ensure_defaults(SparkSession.builder.appName(f"riskloom-{args.job}").getOrCreate())
    if args.cluster_defaults:
        apply_cluster_settings(spark)
    report: dict[str, list] = {}
    src = _Sources(spark, args.raw, readers.Sources(spark, args.raw, args.format, report))
    src.features_dir = args.features
    if args.job == "convert":
        for name, path in sinks.convert_sources(src.frames, args.out).items():
            print(f"{name}: {path}")
    elif args.job == "features":
        _features(spark, src, args.out)
    elif args.job == "build":
        _build(spark, src, args.out, args.buckets)
    elif args.job == "eda":
        _eda(spark, src, args.out)
    else:
        _train(spark, src, args.out, args.model)
    for name, cells in report.items():
        for column, n in cells:
            print(f"{name}.{column}: {n} cells cannot be read as the declared type and are null")


if __name__ == "__main__":
    main()
    sinks.clear_scratch(SparkSession.getActiveSession())  # the job's results are written by now
