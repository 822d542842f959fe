"""Dataset descriptors and cached label tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.operators import version


@dataclass(frozen=True)
class Dataset:
    """Where the splits of a dataset are, and the names of its classes."""

    splits: dict[str, list[str]]
    names: dict[int, str]
    root: str = ""
    extra: dict = field(default_factory=dict)

    @classmethod
    def of(cls, spec: dict, exists: Callable[[str], bool] = lambda path: True) -> Dataset:
        """From a parsed descriptor: train, val and names are required; names may be a list; paths are joined to the root.

        A path that begins with ../ and doesn't exist is taken without it.
        """
        missing = [k for k in ("train", "val", "names") if k not in spec]
        if missing:
            raise ValueError(f"a dataset descriptor needs {missing}")
        names = spec["names"] if isinstance(spec["names"], dict) else dict(enumerate(spec["names"]))
        if any(not isinstance(k, int) for k in names):
            raise ValueError("class ids are integers")
        root = str(spec.get("path") or "").rstrip("/")

        def full(p: str) -> str:
            if p.startswith("../") and not exists(f"{root}/{p}" if root else p):
                p = p[3:]
            return p if not root or p.startswith("/") or "://" in p else f"{root}/{p}"

        listed = lambda v: [v] if isinstance(v, str) else list(v)
        splits = {k: [full(p) for p in listed(spec[k])] for k in ("train", "val", "test") if spec.get(k)}
        return cls(splits, {int(k): str(v) for k, v in names.items()}, root, {k: v for k, v in spec.items() if k not in ("train", "val", "test", "names", "path")})

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Dataset:
        """From a YAML file anywhere Spark can read; needs the yaml package."""
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("the yaml package is missing: parse the descriptor elsewhere and use Dataset.of") from e
        return cls.of(yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]), lambda p: there(spark, p))

    def classes(self, spark: SparkSession) -> DataFrame:
        """class_id, class_name: one row per class."""
        return spark.createDataFrame(sorted(self.names.items()), "class_id long, class_name string")


def there(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists in the store that path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def content_key(files: DataFrame) -> str:
    """A key of files(path, content) that changes with any byte or name."""
    return version.fingerprint(version.manifest(files)).first()["fingerprint"] or "empty"


def cached(spark: SparkSession, key: str, folder: str, build) -> DataFrame:
    """The table that build() makes, kept as Parquet under its key; a changed key builds anew."""
    path = f"{folder}/{key}"
    try:
        return spark.read.parquet(path)
    except Exception as e:  # not there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def label_boxes(files: DataFrame) -> DataFrame:
    """path, line_no, class_id, cx, cy, w, h, valid of the lines of label files(path, content); lines of spaces only are left out."""
    line = files.select("path", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    t = line.withColumn("t", F.split(F.trim("line"), r"\s+"))
    number = lambda i: F.get("t", F.lit(i)).try_cast("double")
    inside = [F.coalesce(number(i).between(0, 1), F.lit(False)) for i in range(1, 5)]
    valid = (F.size("t") == 5) & F.get("t", F.lit(0)).rlike("^[0-9]+$") & inside[0] & inside[1] & inside[2] & inside[3]
    return t.select("path", "line_no", F.when(valid, F.get("t", F.lit(0)).try_cast("long")).alias("class_id"), *(F.when(valid, number(i)).alias(c) for i, c in enumerate(("cx", "cy", "w", "h"), 1)), valid.alias("valid"))


class LabelCache:
    """Parsed files, kept below a folder and brought up to date by what changed.

    Files are told apart by path and digest.  A refresh writes an index (path,
    digest, segment, and whether the path was known before) of what is there now
    and parses new and changed files into a segment of their own; the version
    counts once its row of counts is written, so a refresh that breaks off leaves
    the one before.  A segment holds a path once at most, so rows need no digest.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def versions(self) -> list:
        """version, files, parsed, removed, kept of each refresh, in order."""
        if not there(self.spark, f"{self.folder}/versions"):
            return []
        return sorted(self.spark.read.parquet(f"{self.folder}/versions").collect(), key=lambda r: r["version"])

    def version(self) -> int:
        """The latest version; -1 before the first."""
        return max((r["version"] for r in self.versions()), default=-1)

    def index(self) -> DataFrame:
        v = self.version()
        if v < 0:
            return self.spark.createDataFrame([], "path string, digest binary, segment int, known boolean")
        return self.spark.read.parquet(f"{self.folder}/index/{v}")

    def refresh(self, files: DataFrame, parse) -> dict[str, int]:
        """Counts of files, parsed, kept and removed; parse turns files(path, content) into rows that carry path."""
        before = self.versions()
        v = before[-1]["version"] + 1 if before else 0
        now = files.select("path", F.unhex(F.sha2("content", 256)).alias("digest"))
        if before:
            old = self.index().select("path", F.col("digest").alias("__old"), F.col("segment").alias("__segment"))
            both = now.join(old, "path", "left")
            segment = F.when(F.col("digest") == F.col("__old"), F.col("__segment")).otherwise(v)
            found = both.select("path", "digest", segment.cast("int").alias("segment"), F.col("__segment").isNotNull().alias("known"))
        else:
            found = now.withColumns({"segment": F.lit(v), "known": F.lit(False)})
        found.write.mode("overwrite").parquet(f"{self.folder}/index/{v}")
        index = self.spark.read.parquet(f"{self.folder}/index/{v}")
        n = index.agg(F.count("*").alias("files"), F.count_if(F.col("segment") == v).alias("parsed"), F.count_if("known").alias("known")).first()
        counts = {"files": n["files"], "parsed": n["parsed"], "removed": (before[-1]["files"] if before else 0) - n["known"], "kept": n["files"] - n["parsed"]}
        if n["parsed"] < n["files"]:
            fresh = index.where(F.col("segment") == v).select("path")
            files = files.join(fresh, "path", "left_semi") if n["parsed"] else files.limit(0)
        parse(files).write.mode("overwrite").parquet(f"{self.folder}/segments/segment={v}")
        self.spark.createDataFrame([(v, *counts.values())], "version int, " + ", ".join(f"{c} long" for c in counts)).write.mode("append").parquet(f"{self.folder}/versions")
        return counts

    def rows(self) -> DataFrame:
        """The parsed rows of the files that are there now; a segment of which no file has gone is taken as it is."""
        rows, index = self.spark.read.parquet(f"{self.folder}/segments"), self.index()
        left = {r["segment"]: r["n"] for r in index.groupBy("segment").agg(F.count("*").alias("n")).collect()}  # a row for each segment
        whole = [r["version"] for r in self.versions() if left.get(r["version"], 0) == r["parsed"]]
        part = sorted(set(left) - set(whole))
        out = rows.where(F.col("segment").isin(whole))
        if part:
            here = index.where(F.col("segment").isin(part)).select("path", "segment")
            out = out.unionByName(rows.where(F.col("segment").isin(part)).join(here, ["path", "segment"], "left_semi").select(rows.columns))
        return out.drop("segment")
