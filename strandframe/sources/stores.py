"""Folders as stores: tables that appear whole or not at all, manifests, prepared sources, splits, and what cleans up."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import h60, key
from ..operators.curriculum import split as cluster_split
from ..operators.ranges import numbered
from ..staging import file_system
from . import sequences

#: Readers of sequence files by source.
READERS: dict[str, Callable[[SparkSession, str, str], DataFrame]] = {
    "uniref": lambda spark, path, prefix: sequences.fasta(spark, path, prefix), "mgnify": lambda spark, path, prefix: sequences.fasta(spark, path, prefix, strip_header=True),
    "bfd": sequences.alignment, "oas": lambda spark, path, prefix: sequences.paired_files(spark, path, prefix),
}


def reader(name: str) -> Callable[[SparkSession, str, str], DataFrame]:
    if name not in READERS:
        raise NotImplementedError(f"no reader of {name}")
    return READERS[name]


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table's writer finished."""
    fs, p = file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def replace(df: DataFrame, path: str, partition_by: list[str] | None = None, rows_per_file: int | None = None) -> None:
    """Writes a table beside its place and moves it there when it is complete, so readers see the old or the new one."""
    spark = df.sparkSession
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(staged)
    promote(spark, staged, path)


def promote(spark: SparkSession, staged: str, path: str) -> None:
    """Puts a complete folder in the place of another one; an incomplete one is an error and stays where it is."""
    if not complete(spark, staged):
        raise ValueError(f"{staged} is not complete")
    fs, new = file_system(spark, staged)
    _, old = file_system(spark, path)
    _, aside = file_system(spark, f"{path}.replaced-{uuid.uuid4().hex}")
    there = fs.exists(old)
    if there:
        fs.rename(old, aside)
    if not fs.rename(new, old):
        raise OSError(f"{path} could not be put in place")
    if there:
        fs.delete(aside, True)


def sweep(spark: SparkSession, folder: str, hours: float = 24, now: float | None = None) -> list[str]:
    """Removes what writers that never finished left in a folder, if it is older than some hours; its names."""
    fs, p = file_system(spark, folder)
    limit, out = ((time.time() if now is None else now) - 3600 * hours) * 1000, []
    for status in fs.listStatus(p) if fs.exists(p) else []:
        name = status.getPath().getName()
        if (".staged-" in name or ".replaced-" in name) and status.getModificationTime() < limit:
            fs.delete(status.getPath(), True)
            out.append(name)
    return sorted(out)


def read_json(spark: SparkSession, path: str) -> dict | None:
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Writes beside the place and renames."""
    fs, p = file_system(spark, path)
    _, new = file_system(spark, f"{path}.staged-{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    stream.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
    stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(new, p)


def merged(old: dict, new: dict) -> dict:
    """new over old, sections within sections."""
    out = dict(old)
    for k, v in new.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def add_to_manifest(spark: SparkSession, path: str, **sections: object) -> dict:
    """Merges sections into a run's manifest; what it then says."""
    value = merged(read_json(spark, path) or {}, sections)
    write_json(spark, path, value)
    return value


def identity(value: object) -> str:
    """A hash that equal settings share, whatever the order of their keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def reserve(spark: SparkSession, folder: str, settings: dict, overwrite: bool = False) -> str:
    """A run's folder, named by its settings; an error where it exists, unless it may be overwritten."""
    path = f"{folder}/run-{identity(settings)[:12]}"
    fs, p = file_system(spark, path)
    if fs.exists(p):
        if not overwrite:
            raise FileExistsError(path)
        fs.delete(p, True)
    fs.mkdirs(p)
    write_json(spark, f"{path}/settings.json", settings)
    return path


def publish(spark: SparkSession, table: DataFrame, folder: str, fit: dict, test: dict) -> str:
    """A baseline's rows under the identities of what it was fitted and tested on, with their number and hash; a folder that is complete is not written again."""
    from ..operators.alignment import identity as content

    path = f"{folder}/fit-{identity(fit)[:12]}/test-{identity(test)[:12]}"
    if not complete(spark, f"{path}/rows"):
        replace(table, f"{path}/rows")
        seen = content(spark.read.parquet(f"{path}/rows"), *table.columns).first()
        write_json(spark, f"{path}/identity.json", {"fit": fit, "test": test, "rows": seen.n, "sha256": seen.identity, "columns": table.columns})
    return path


def published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a published baseline; an error where they are not those that were published."""
    from ..operators.alignment import identity as content

    said, rows = read_json(spark, f"{path}/identity.json"), spark.read.parquet(f"{path}/rows")
    seen = content(rows, *said["columns"]).first()
    if (seen.n, seen.identity) != (said["rows"], said["sha256"]):
        raise ValueError(f"{path} has changed since it was published")
    return rows


def prepared_columns(table: DataFrame, sequence: str, score: str, clusters: list[str]) -> DataFrame:
    """sequence, score, cluster columns by name and the length (counted where there is no column for it): the same columns give the same table, in whatever order they are named."""
    n = F.col("sequence_length") if "sequence_length" in table.columns else F.length(sequence)
    return table.select(sequence, score, *sorted(set(clusters)), n.cast("int").alias("sequence_length"))


def export(table: DataFrame, path: str, cluster: str, modulus: int = 20, score: str = "score") -> None:
    """A prepared source: tables `train` and `validation`, split by cluster, and meta.json with what they were split by."""
    parts = cluster_split(table, cluster, modulus)
    for name in ("train", "validation"):
        replace(parts.filter(F.col("split") == name).drop("split"), f"{path}/{name}")
    write_json(table.sparkSession, f"{path}/meta.json", {"split_column": cluster, "val_holdout_modulus": modulus, "score": score, "columns": table.columns})


def load(spark: SparkSession, path: str, kind: str = "prepared", cluster: str | None = None, modulus: int | None = None) -> DataFrame:
    """A source as one table: a folder or file of Parquet, or a prepared one with its `split`, which has to have been split as asked. Hubs are out of reach."""
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind != "prepared":
        raise NotImplementedError(f"no source of the kind {kind}")
    meta = read_json(spark, f"{path}/meta.json")
    if meta is None:
        raise FileNotFoundError(f"{path}/meta.json")
    for name, asked, said in (("split_column", cluster, meta["split_column"]), ("val_holdout_modulus", modulus, meta["val_holdout_modulus"])):
        if asked is not None and asked != said:
            raise ValueError(f"{path} was prepared with {name} {said}, not {asked}")
    read = lambda name: spark.read.parquet(f"{path}/{name}").withColumn("split", F.lit(name))
    return read("train").unionByName(read("validation"))


def test_split(splits: DataFrame, name: str) -> DataFrame:
    """One named split as `test`; an error where there is none."""
    out = splits.filter(F.col("split") == name)
    if out.isEmpty():
        raise ValueError(f"no split {name}")
    return out.withColumn("split", F.lit("test"))


def fixed_splits(splits: DataFrame, names: tuple[str, ...] = ("train", "validation", "test"), revision: str | None = None) -> DataFrame:
    """splits that has all the named ones; a revision, where there is one, has to be pinned (40 hexadecimal digits)."""
    if revision is not None and (len(revision) != 40 or set(revision) - set("0123456789abcdef")):
        raise ValueError("a revision has to be a whole commit hash")
    found = {r[0] for r in splits.select("split").distinct().collect()}  # a few names
    if missing := [n for n in names if n not in found]:
        raise ValueError(f"splits are missing: {', '.join(missing)}")
    return splits.filter(F.col("split").isin(*names))


def edition(units: DataFrame, wanted: int, known: tuple[int, ...] = (14, 15, 16)) -> DataFrame:
    """Development rows, and of the test rows those of one edition; test rows of other than known editions are an error."""
    if wanted not in known:
        raise ValueError(f"no edition {wanted}")
    if not units.filter((F.col("split") == "test") & ~F.coalesce(F.col("edition").isin(*known), F.lit(False))).isEmpty():
        raise ValueError("test rows of unknown editions")
    return units.filter((F.col("split") != "test") | (F.col("edition") == wanted))


def roles(splits: DataFrame, names: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """splits with their role (train, validation, test, or a name for refitting) by the split's name; a required role, or one that was renamed, has to be there."""
    found = {r[0] for r in splits.select("split").distinct().collect()}
    if missing := [f"{role} ({name})" for role, name in names.items() if name not in found and (role in required or name != role)]:
        raise ValueError(f"splits are missing: {', '.join(missing)}")
    role = F.coalesce(*(F.when(F.col("split") == name, F.lit(r)) for r, name in names.items()))
    return splits.withColumn("split", role).filter("split is not null")


def carve_validation(splits: DataFrame, id_column: str, fraction: float, seed: str) -> DataFrame:
    """splits in which a share of train, exactly round(n fraction) rows in hash order and at least one, is validation; unchanged where there is one."""
    if not splits.filter("split = 'validation'").isEmpty():
        return splits
    train = splits.filter("split = 'train'")
    most = max(1, round(train.count() * fraction))
    dealt = numbered(train.withColumn("_h", h60(key(seed, F.col(id_column)))), ["_h", id_column], "_n")
    carved = dealt.withColumn("split", F.when(F.col("_n") < most, "validation").otherwise("train")).select(*splits.columns)
    return carved.unionByName(splits.filter("split <> 'train'"))


def first_records(table: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first records of a source, for a trial run."""
    return table.orderBy(*order).limit(most)


def bucket(id_column: Column, n: int, i: int) -> Column:
    """Whether an id belongs to bucket i of n; buckets are a partition of the ids."""
    return F.pmod(F.xxhash64(id_column), F.lit(n)) == i


def write_fasta(table: DataFrame, path: str, records_per_file: int, id_column: str = "sequence_id", sequence: str = "sequence") -> None:
    """Sequences as FASTA files of at most so many records."""
    table.select(F.concat(F.lit(">"), F.col(id_column), F.lit("\n"), F.col(sequence)).alias("value")).write.option("maxRecordsPerFile", records_per_file).text(path)


def write_assembled(table: DataFrame, path: str, rows: int = 100_000) -> None:
    """The assembled table by dataset, in files of at most so many rows."""
    replace(table, path, ["dataset_id"] if "dataset_id" in table.columns else None, rows)


def plot_data(table: DataFrame, value: str, clusters: list[str], bins: int = 50) -> dict[str, DataFrame]:
    """What plots are drawn from: the histogram, linear and by logarithm of the counts, the box and bars of the clusters' reduction."""
    from ..operators import corpus

    h = corpus.histogram(table, value, bins)
    return {"histogram": h, "histogram_log": h.withColumn("n", F.when(F.col("n") > 0, F.log10("n"))), "box": corpus.box(table, value), "bars": corpus.clusters_found(table, clusters)}
