"""File-tree source: listing, skip reasons, parser choice, reading and change status."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.scalars import basename, first_dot_extension, last_dot_extension

MAX_FILE_BYTES = 1_048_576
#: Directories that are never entered (others starting with a dot aren't either).
IGNORED_DIRECTORIES = (
    "node_modules .git .svn .hg dist build out .turbo .next .nuxt .output coverage .nyc_output __pycache__ "
    ".pytest_cache .mypy_cache target .gradle .idea .vscode vendor .bundle Pods DerivedData"
).split()
#: Extensions (from the first dot of a name) that are never read.
IGNORED_EXTENSIONS = (
    ".json .yaml .yml .toml .xml .csv .tsv .md .mdx .txt .rst .pdf .png .jpg .jpeg .gif .svg .ico .webp .woff .woff2 "
    ".ttf .eot .otf .mp4 .mp3 .wav .avi .mov .zip .tar .gz .rar .7z .exe .dll .so .dylib .class .pyc .lock .env "
    ".min.js .min.css .d.ts .map"
).split()
#: Extensions (from the last dot, case kept) of each language.
LANGUAGE_EXTENSIONS = {
    "typescript": [".ts", ".tsx"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "python": [".py", ".pyw"],
    "java": [".java"],
}


def exclude_regex(glob: str) -> str | None:
    """An exclude glob as an unanchored regular expression; None if it isn't a valid one.

    Dots are escaped, then ** and then * are replaced one after the other, so the star that
    ** leaves behind is replaced once more.
    """
    pattern = glob.replace(".", r"\.").replace("**", ".*").replace("*", "[^/]*")
    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern


def skip_reason(path: Column, size: Column, max_bytes: int = MAX_FILE_BYTES, exclude: tuple[str, ...] = ()) -> Column:
    """Why a file is not indexed, or null; the first reason that holds counts."""
    name, extension = basename(path), first_dot_extension(path)
    out = (
        F.when(F.startswith(name, F.lit(".")), "hidden_file")
        .when(extension.isin(*IGNORED_EXTENSIONS), "ignored_extension")
        .when(F.endswith(name, F.lit(".d.ts")), "declaration_file")
        .when(size > max_bytes, "too_large")
        .when(size == 0, "empty_file")
    )
    patterns = [p for p in map(exclude_regex, exclude) if p is not None]
    if patterns:
        out = out.when(path.rlike("|".join(f"(?:{p})" for p in patterns)), "exclude_pattern")
    return out


def language_of(path: Column) -> Column:
    extension, out = last_dot_extension(path), None
    for language, known in LANGUAGE_EXTENSIONS.items():
        out = (F if out is None else out).when(extension.isin(*known), language)
    return out


def in_ignored_directory(relative: Column) -> Column:
    """Whether a directory above the file starts with a dot or is never entered."""
    above = F.slice(F.split(relative, "/"), F.lit(1), F.size(F.split(relative, "/")) - 1)
    return F.exists(above, lambda d: F.startswith(d, F.lit(".")) | d.isin(*IGNORED_DIRECTORIES))


#: The size of a directory that is to be entered, among the entries of its parent.
ENTERED = -1


def entries(fs: pafs.FileSystem, base: str, folder: str) -> Iterator[tuple[str, str, int | None]]:
    """(path, relative, bytes) of one directory's entries; a directory has ENTERED, or null if it is pruned."""
    try:
        found = fs.get_file_info(pafs.FileSelector(folder))
    except OSError:
        yield folder, folder[len(base) + 1 :] + "/", None
        return
    for entry in sorted(found, key=lambda e: e.path):
        relative = entry.path[len(base) + 1 :]
        if entry.type == pafs.FileType.Directory:
            pruned = entry.base_name.startswith(".") or entry.base_name in IGNORED_DIRECTORIES
            yield entry.path, relative + "/", None if pruned else ENTERED
        elif entry.type == pafs.FileType.File:
            yield entry.path, relative, entry.size


def walk_below(fs: pafs.FileSystem, base: str, folder: str, deep: bool) -> Iterator[tuple[str, str, int | None]]:
    """The files in ``folder``, and below it if ``deep``, with pruned directories of null bytes.

    Directories are listed without entering the pruned ones; Spark's own listing would enter
    them and would leave out names that start with an underscore.
    """
    todo = [folder]
    while todo:
        for path, relative, size in entries(fs, base, todo.pop()):
            if size != ENTERED:
                yield path, relative, size
            elif deep:
                todo.append(path)


def listed(spark: SparkSession, root: str, wide: int = 64) -> DataFrame:
    """(path, relative, size_bytes) of ``walk``, listed by tasks.

    The driver goes down level by level only until it knows ``wide`` directories; it holds their
    names and no files. Tasks list the files of those above and walk all below the last ones.
    """
    fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root.rstrip("/"))
    schema = "path string, relative string, size_bytes long"
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)
    if info.type == pafs.FileType.File:
        return spark.createDataFrame([(base, info.base_name, info.size)], schema)
    above, level = [], [base]
    while level and len(above) + len(level) < wide:
        above += level
        level = [p for folder in level for p, _, size in entries(fs, base, folder) if size == ENTERED]
    dealt = [(p, False) for p in above] + [(p, True) for p in level]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs = pafs.FileSystem.from_uri(root)[0] if "://" in root else pafs.LocalFileSystem()
        for batch in batches:
            for folder, deep in zip(batch["folder"], batch["deep"]):
                found = walk_below(fs, base, folder, deep)
                while rows := list(islice(found, 10_000)):
                    out = pd.DataFrame(rows, columns=["path", "relative", "size_bytes"])
                    yield out.assign(size_bytes=out["size_bytes"].astype("Int64"))

    n = max(1, min(len(dealt), spark.sparkContext.defaultParallelism))
    folders = spark.createDataFrame(dealt, "folder string, deep boolean")
    return folders.repartition(n, "folder").mapInPandas(run, schema)


def classified(listing: DataFrame, max_bytes: int = MAX_FILE_BYTES, exclude: tuple[str, ...] = ()) -> DataFrame:
    """A listing (path, relative, size_bytes) with extension, language and skip_reason.

    A row of null bytes is a directory that was not entered; a file below such a directory, in
    listings that did enter it, has the same reason.
    """
    size = F.col("size_bytes")
    reason = F.when(size.isNull() | in_ignored_directory(F.col("relative")), "ignored_directory").otherwise(
        skip_reason(F.col("path"), size, max_bytes, exclude)
    )
    language = F.when(size.isNotNull(), language_of(F.col("path")))
    return listing.withColumns(
        {"extension": first_dot_extension(F.col("path")), "language": language, "skip_reason": reason}
    )


def scan(
    spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES, exclude: tuple[str, ...] = ()
) -> DataFrame:
    """(path, relative, size_bytes, extension, language, skip_reason) of every file below ``root``.

    A missing root raises. A pruned directory is one row of reason ignored_directory.
    """
    return classified(listed(spark, root), max_bytes, exclude)


def with_text(files: DataFrame, root: str) -> DataFrame:
    """``files`` with text added: each task reads its own files, as UTF-8. One that can't be read has null."""
    remote = "://" in root

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs = pafs.FileSystem.from_uri(root)[0] if remote else pafs.LocalFileSystem()
        for batch in batches:
            texts = []
            for path in batch["path"]:
                try:
                    with fs.open_input_stream(path) as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                except OSError:
                    texts.append(None)
            yield batch.assign(text=texts)

    n = max(1, files.sparkSession.sparkContext.defaultParallelism)
    dealt = files.repartition(n, "path")
    return dealt.mapInPandas(run, T.StructType(files.schema.fields + [T.StructField("text", T.StringType())]))


def scan_summary(files: DataFrame) -> DataFrame:
    """(reason, files, extensions): counts and sorted extensions by skip reason; kept files have a null reason."""
    return files.groupBy(F.col("skip_reason").alias("reason")).agg(
        F.count(F.lit(1)).alias("files"), F.sort_array(F.collect_set("extension")).alias("extensions")
    )


def scan_totals(files: DataFrame) -> DataFrame:
    """One row: files scanned, skipped and kept; directories that weren't entered are no files."""
    of = files.where(F.col("size_bytes").isNotNull())
    skipped = F.count("skip_reason")
    scanned = F.count(F.lit(1))
    return of.agg(scanned.alias("scanned"), skipped.alias("skipped"), (scanned - skipped).alias("kept"))


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def change_status(incoming: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """``incoming`` (source_path, checksum, ...) with status new, changed or unchanged.

    With ``force`` a stored file counts as changed even if it is the same.
    """
    known = stored.select("source_path", F.col("checksum").alias("stored_checksum"))
    same = F.col("stored_checksum") == F.col("checksum")
    status = F.when(F.col("stored_checksum").isNull(), "new").when(same & F.lit(not force), "unchanged")
    return incoming.join(known, "source_path", "left").withColumn("status", status.otherwise("changed"))
