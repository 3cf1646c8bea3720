"""The corpus run: read, cluster, assemble, describe, each step a table that is replaced when it is complete.

    python -m strandframe.plans.corpus settings.yaml [more.yaml ...] [key=value ...]
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, corpus
from ..sources import stores
from . import config


@dataclass
class Read:
    source: str
    path: str
    enabled: bool = True
    first: int | None = None


@dataclass
class Cluster:
    enabled: bool = True
    thresholds: list[float] = field(default_factory=lambda: [0.9, 0.5])
    coverage: float = clustering.COVERAGE
    resume: bool = False


@dataclass
class Assemble:
    enabled: bool = True
    scores: str | None = None
    on_missing_scores: str = "error"


@dataclass
class Describe:
    enabled: bool = True
    quantiles: list[float] = field(default_factory=lambda: [0.05, 0.95])


@dataclass
class Settings:
    name: str
    output: str
    read: Read
    cluster: Cluster = field(default_factory=Cluster)
    assemble: Assemble = field(default_factory=Assemble)
    describe: Describe = field(default_factory=Describe)


def check(settings: Settings) -> Settings:
    """Settings whose steps go together; an error otherwise."""
    if settings.assemble.on_missing_scores not in ("error", "skip"):
        raise ValueError("on_missing_scores is error or skip")
    if settings.cluster.enabled and not settings.cluster.thresholds:
        raise ValueError("a cascade needs thresholds")
    stores.reader(settings.read.source)
    return settings


def _read(spark: SparkSession, s: Settings) -> None:
    rows = stores.reader(s.read.source)(spark, s.read.path, s.name.upper())
    stores.replace(rows if s.read.first is None else stores.first_records(rows, ["sequence_id"], s.read.first), f"{s.output}/base")


def _cluster(spark: SparkSession, s: Settings) -> None:
    out = clustering.cascade(spark.read.parquet(f"{s.output}/base"), s.cluster.thresholds, f"{s.output}/rounds", s.cluster.resume, coverage=s.cluster.coverage)
    stores.replace(out, f"{s.output}/clusters")


def _scores(spark: SparkSession, s: Settings) -> DataFrame | None:
    return spark.read.parquet(s.assemble.scores) if s.assemble.scores else None


def _assemble(spark: SparkSession, s: Settings) -> None:
    out = corpus.assemble(spark.read.parquet(f"{s.output}/base"), spark.read.parquet(f"{s.output}/clusters"), s.name, _scores(spark, s), s.assemble.on_missing_scores)
    stores.write_assembled(out, f"{s.output}/assembled")


def _describe(spark: SparkSession, s: Settings) -> None:
    table = spark.read.parquet(f"{s.output}/assembled")
    levels = [c for c in table.columns if c.startswith("cluster_rep_at_")]
    said = corpus.statistics(table, "score" if "score" in table.columns else None).first().asDict()
    said["length_quantiles"] = {str(r["quantile"]): r["value"] for r in corpus.quantiles(table, "sequence_length", s.describe.quantiles).collect()}
    said["clusters"] = {r["level"]: {"clusters": r["clusters"], "reduction": r["reduction"]} for r in corpus.clusters_found(table, levels, exact=False).collect()}
    stores.write_json(spark, f"{s.output}/statistics.json", said)


#: Steps in their order, whatever the settings' order.
STEPS: list[tuple[str, Callable[[SparkSession, Settings], None]]] = [("read", _read), ("cluster", _cluster), ("assemble", _assemble), ("describe", _describe)]


def run(spark: SparkSession, settings: Settings) -> list[str]:
    """Runs the enabled steps; their names. What ran, and with which settings, is in the run's manifest."""
    check(settings)
    done = []
    for name, step in STEPS:
        if getattr(settings, name).enabled:
            step(spark, settings)
            done.append(name)
            stores.add_to_manifest(spark, f"{settings.output}/manifest.json", steps={name: {"settings": vars(getattr(settings, name))}})
    return done


def assembled(spark: SparkSession, settings: Settings) -> DataFrame:
    return spark.read.parquet(f"{settings.output}/assembled").withColumn("dataset_id", F.col("dataset_id").cast("string"))


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), config.parse(config.from_arguments(sys.argv[1:]), Settings))
