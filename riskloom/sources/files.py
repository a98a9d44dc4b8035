"""Repository files, targets, language statistics and documentation."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions import paths
from riskloom.operators.filters import is_key_file
from riskloom.session import setting, ship_package


_TASK_BYTES = 64 << 20      # read by one task of a scan


def scan_files(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """Files below `root/<repo>/...` with path, hash and size; `unreadable_files` tells those that can't be read.

    Without content only the listing is read; the bytes are not. Links are followed as the file system's listing does, so a
    linked file is a file of its own under the link's name. `inventory` adds the folders. The listing, made here, takes some
    tasks a core for each level of folders, where Spark would take one a folder; so does the reading, or a task for 64 MB if that is more.
    """
    tasks = str(4 * spark.sparkContext.defaultParallelism)
    with setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", tasks):
        listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                  .option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(root))
    # Spark takes a file for 4 MB at least, so small ones would come 32 to a task.
    n_bytes = int(str(listed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    listed = listed.coalesce(max(int(tasks), n_bytes // _TASK_BYTES + 1))
    scheme = r"^[a-z0-9]+:/+"
    full = F.regexp_replace(F.col("path"), scheme, "/")
    below = paths.relative_path(full, re.sub(scheme, "/", root).rstrip("/"))
    base = listed.select(
        F.regexp_extract(below, r"^([^/]*)/", 1).alias("repo"), F.regexp_replace(below, r"^[^/]*/", "").alias("path"),
        F.lit("file").alias("type"), F.col("length").alias("size"), "content")
    if not with_content:
        return base.drop("content")
    return base.select("repo", "path", "type", "size", F.sha2("content", 256).alias("sha"),
                       F.col("content").cast("string").alias("content"))


def write_files(files: DataFrame, root: str) -> int:
    """Writes every row's content to `root/<repo>/<path>`, and gives the number of rows. Executors reach `root` by pyarrow's file systems.

    A file is written beside its place and moved there, so a repeated task replaces it by the same one. Rows that share a place leave
    one file. A row without repo, path or content, or with a path that leaves its repository, is an error.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        made, parents = None, set()
        for frame in frames:
            for repo, path, content in zip(frame["repo"], frame["path"], frame["content"]):
                if None in (repo, path, content) or "/" in repo or {"", ".", ".."} & {repo, *path.split("/")}:
                    raise ValueError(f"no file can be written for {repo!r}, {path!r}")
                place = f"{base}/{repo}/{path}"
                folder = place.rsplit("/", 1)[0]
                if folder != made:
                    parent = folder.rsplit("/", 1)[0]
                    store.create_dir(folder, recursive=parent not in parents)     # looked up from the root once a parent
                    if len(parents) >= 100_000:
                        parents.clear()
                    parents.add(parent)
                    made = folder
                beside = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(content.encode())
                store.move(beside, place)
            yield pd.DataFrame({"n": [len(frame)]})

    ship_package(files.sparkSession)
    return files.select("repo", "path", "content").mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def unreadable_files(spark: SparkSession, root: str) -> DataFrame:
    """(repo, path, size, reason) of the files that are listed but can't be read."""
    read = scan_files(spark, root).where(F.col("sha").isNotNull()).select("repo", "path")
    return scan_files(spark, root, with_content=False).join(read, ["repo", "path"], "left_anti").select(
        "repo", "path", "size", F.lit("unreadable").alias("reason"))


def spread(files: DataFrame, keys=("repo", "path")) -> DataFrame:
    """Give every core a share of a scan that has fewer splits than the session has cores.

    For small inputs in one file with one row group. A large scan has more splits than cores and
    is left as it is, without a shuffle. Call it on a plain scan.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    if files.isStreaming or files.rdd.getNumPartitions() >= cores:
        return files
    return files.repartition(cores, *keys)


def inventory(files: DataFrame) -> DataFrame:
    """Listing of a files table: every file with its hash, and a row for every folder above one."""
    listed = files.select("repo", "path", "type", "size", F.sha2(F.col("content").cast("binary"), 256).alias("sha"))
    return listed.unionByName(folders(files).select(
        "repo", "path", F.lit("dir").alias("type"), F.lit(0).cast("bigint").alias("size"),
        F.lit(None).cast("string").alias("sha")))


def folders(files: DataFrame) -> DataFrame:
    """(repo, path) of every folder above a file."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.where(F.col("path").contains("/")).select("repo", F.explode(above).alias("path")).distinct()


def test_directories(files: DataFrame) -> DataFrame:
    return folders(files).where(F.lower("path").contains("test"))


def key_contents(files: DataFrame, max_size: int = 10_000) -> DataFrame:
    """The listing with the content of marker files only; of all others just the entry is kept."""
    wanted = is_key_file(F.col("path"), F.col("size"), max_size)
    return files.select("repo", "path", "type", "size", F.when(wanted, F.col("content")).alias("content"))


def scan_targets(spark: SparkSession, path: str) -> DataFrame:
    """Repositories out of a list file, one URL per line; blank lines and `#` comments are skipped."""
    return parse_targets(spark.read.text(path), "value")


def parse_targets(df: DataFrame, column: str) -> DataFrame:
    url = F.trim(F.col(column))
    return (df.select(url.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))
            .withColumn("r", paths.parse_repo_url(F.col("url"))).select("url", "r.owner", "r.name", "r.valid"))


def scan_language_stats(df: DataFrame) -> DataFrame:
    """(repo, language, bytes, total) from one map of language sizes per repository."""
    rows = df.select("repo", F.explode("languages").alias("language", "bytes"))
    return rows.withColumn("total", F.sum("bytes").over(Window.partitionBy("repo")))   # one row per language


def doc_insights(files: DataFrame) -> DataFrame:
    """Content of the read-me files, with a fixed relevance."""
    return (files.where(F.lower(paths.base_name(F.col("path"))) == "readme.md")
            .select("repo", F.col("path").alias("source"), "content", F.lit(0.8).alias("relevance")))
