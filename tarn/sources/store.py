"""A context: Parquet tables in one directory, laid out by buckets of documents, with upserts and cascading deletes.

Every row of a document, its chunks, postings, vectors and outgoing edges stands in the bucket that
the document's hash gives. A commit writes the buckets that it changes as a new version and then adds
a manifest that names each bucket's version; the manifests are numbered, and one is only ever
created, whole. So readers see the old state or the new one, and of two writers one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn import schemas
from tarn.operators.blocks import BlockIndex, blocks, bucket_of, statistics
from tarn.operators.lexical import with_lengths

MANIFEST = "MANIFEST-%09d.json"
#: The one manifest of layouts before the third.
OLD_MANIFEST = "CURRENT.json"
BUCKETS = 64
#: Tables whose rows have a bucket. Blocks and statistics come from a bucket's postings, whenever these change.
BUCKETED = ("documents", "chunks", "postings", "embeddings", "edges", "blocks", "statistics")
DERIVED: dict[str, Callable[[DataFrame], DataFrame]] = {"blocks": blocks, "statistics": statistics}


class Conflict(RuntimeError):
    """Another writer has committed since this store was opened."""


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """Open the store at ``path``; ``buckets`` counts for a new one."""
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest: dict | None = None
        self.refresh()
        if self.manifest is None:
            self.manifest = {"version": schemas.VERSION, "number": 0, "buckets": buckets, "tables": {}}
            old = self._read(OLD_MANIFEST)
            if old is not None:
                self._migrate(old)
        elif self.manifest["version"] != schemas.VERSION:
            raise ValueError(f"{self.path} has layout {self.manifest['version']}, this is {schemas.VERSION}")

    @property
    def buckets(self) -> int:
        return self.manifest["buckets"]

    def refresh(self) -> None:
        """See what other writers have committed: the complete manifest of the highest number."""
        _, path, fs = self._file("")
        found = fs.globStatus(self._file("MANIFEST-*.json")[1]) if fs.exists(path) else None
        for name in sorted((f.getPath().getName() for f in found or ()), reverse=True):
            if (whole := self._read(name)) is not None:
                self.manifest = whole
                break

    def _migrate(self, old: dict) -> None:
        """Bring a store without buckets up to this layout, all tables in one commit; a newer one raises."""
        if old["version"] not in (1, 2):
            raise ValueError(f"{self.path} has layout {old['version']}, this is {schemas.VERSION}")
        tables = {n: self.spark.read.parquet(f"{self.path}/{where}") for n, where in old["tables"].items()}
        if old["version"] == 1 and "postings" in tables:
            tables["postings"] = with_lengths(tables["postings"])
        for name, key in (("postings", "chunk_id"), ("embeddings", "chunk_id"), ("edges", "from_chunk_id")):
            if name in tables and "chunks" in tables:
                tables[name] = self.with_home(tables[name], tables["chunks"], key)
            elif name in tables:
                tables[name] = tables[name].withColumn("bucket", bucket_of(F.col(key), self.buckets))
        self.commit(**tables)

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        """A manifest; None for one that isn't there or whole."""
        _, path, fs = self._file(name)
        if not fs.exists(path):
            return None
        rows = self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()
        try:
            return json.loads(rows[0][0]) if rows else None
        except ValueError:
            return None

    def table(self, name: str, buckets: Iterable[int] | None = None, with_bucket: bool = False) -> DataFrame:
        """A table, or only some of its buckets; other buckets' files aren't listed."""
        schema = schemas.TABLES[name]
        found = self.manifest["tables"].get(name, {})
        if name in BUCKETED:
            wanted = None if buckets is None else {str(b) for b in buckets}
            found = {b: v for b, v in found.items() if wanted is None or b in wanted}
            if "bucket" not in schema.fieldNames():
                schema = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        if not found:
            rows = self.spark.createDataFrame([], schema)
        elif name in BUCKETED:
            paths = [f"{self.path}/{name}/version={v}/bucket={b}" for b, v in sorted(found.items())]
            rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths)
        else:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}/version={found['all']}")
        return rows.select(*[f.name for f in schema.fields if with_bucket or f.name != "bucket" or name in DERIVED])

    def bucket(self, document_id: str = "document_id") -> Column:
        return bucket_of(F.col(document_id), self.buckets)

    def with_home(self, rows: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
        """``rows`` with the bucket of their chunk's document."""
        return rows.join(chunks.select(F.col("chunk_id").alias(key), self.bucket().alias("bucket")).distinct(), key)

    def touched(self, documents: DataFrame) -> list[int]:
        """The buckets of some documents (document_id): as many numbers as the store has buckets at most."""
        return sorted(r[0] for r in documents.select(self.bucket()).distinct().collect())

    def commit(self, **tables: DataFrame | tuple[DataFrame, Iterable[int]]) -> None:
        """Write the given tables and switch to them at once.

        A table given with bucket numbers replaces those buckets only; without, all its rows. Rows
        have a bucket or the document_id that gives it. Blocks and statistics follow the postings.
        Fails, and changes nothing, where another writer has committed since this store was opened.
        """
        given = {k: v if isinstance(v, tuple) else (v, None) for k, v in tables.items() if v is not None}
        version = uuid.uuid4().hex[:12]
        new, staged = {k: dict(v) for k, v in self.manifest["tables"].items()}, {}
        for name in DERIVED if "postings" in given else ():
            given[name] = (None, given["postings"][1])
        for name, (rows, only) in given.items():
            replaced = None if only is None else {str(b) for b in only}
            if rows is None:
                rows = DERIVED[name](staged["postings"])
            fields = [f for f in schemas.TABLES[name].fields if f.name != "bucket"]
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]
            path = f"{self.path}/{name}/version={version}"
            if name not in BUCKETED:
                rows.select(*columns).write.parquet(path)
                new[name] = {"all": version}
                continue
            place = F.col("bucket") if "bucket" in rows.columns else self.bucket()
            rows = rows.select(*columns, place.cast("int").alias("bucket"))
            if replaced is not None:
                rows = rows.where(F.col("bucket").isin(*map(int, replaced)))
            # Sorted by term, so a search prunes row groups by their minima and maxima; a large bucket is several files.
            order = [c for c in ("term", "tier", "block", "chunk_id") if c in rows.columns]
            rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order)
            rows.write.partitionBy("bucket").parquet(path)
            _, _, fs = self._file(name)
            there = {f.getPath().getName().partition("=")[2] for f in fs.globStatus(self._file(f"{name}/version={version}/bucket=*")[1])}
            kept = {} if replaced is None else {b: v for b, v in new.get(name, {}).items() if b not in replaced}
            new[name] = kept | dict.fromkeys(there, version)
            if there:
                read = self.spark.read.schema(rows.schema).option("basePath", path)
                staged[name] = read.parquet(*[f"{path}/bucket={b}" for b in sorted(there)])
            else:
                staged[name] = self.spark.createDataFrame([], rows.schema)
        self._switch({"version": schemas.VERSION, "number": self.manifest["number"] + 1, "buckets": self.buckets, "tables": new})

    def _switch(self, manifest: dict) -> None:
        """Add the manifest of the next number: written aside, then renamed to a name that isn't taken."""
        jvm, path, fs = self._file(MANIFEST % manifest["number"])
        _, aside, _ = self._file(f".{uuid.uuid4().hex}.tmp")
        fs.mkdirs(path.getParent())
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._renamed(jvm, aside, path):
            fs.delete(aside, False)
            raise Conflict(f"{self.path} was changed by another writer")
        self.manifest = manifest

    def _renamed(self, jvm, aside, path) -> bool:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            context.rename(context.makeQualified(aside), context.makeQualified(path), options)
        except Exception as failure:  # the name is taken
            if "AlreadyExists" in str(failure):
                return False
            raise
        return True

    def index(self) -> BlockIndex:
        return BlockIndex(self.table("blocks"), self.table("statistics"))

    def size_bytes(self) -> int:
        """Bytes of the current versions' files."""
        total = 0
        for name, found in self.manifest["tables"].items():
            for bucket, version in found.items():
                _, path, fs = self._file(f"{name}/version={version}" + (f"/bucket={bucket}" if name in BUCKETED else ""))
                total += fs.getContentSummary(path).getLength()
        return total


def upserted(
    stored: DataFrame, incoming: DataFrame, key: str, kept: tuple[str, ...] = (), updated: tuple[str, ...] | None = None
) -> DataFrame:
    """``stored`` with ``incoming`` merged by ``key``, columns of ``stored``.

    A stored row keeps its ``kept`` columns, or all but ``updated`` if that is given; new rows are
    taken whole. Of incoming rows with one key, the one of least other columns counts.
    """
    columns = stored.columns
    once = incoming.groupBy(key).agg(F.min(F.struct(*[c for c in columns if c != key])).alias("row"))
    if updated is not None:
        kept = tuple(c for c in columns if c != key and c not in updated)

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(f"s.{key}"), F.col(f"i.{key}")).alias(c)
        old, new = F.col(f"s.{c}"), F.col(f"i.row.{c}")
        have, got = F.col(f"s.{key}").isNotNull(), F.col(f"i.{key}").isNotNull()
        return F.when(have & (~got | F.lit(c in kept)), old).otherwise(new).alias(c)

    return stored.alias("s").join(once.alias("i"), F.col(f"s.{key}") == F.col(f"i.{key}"), "full").select(
        *map(value, columns)
    )


def without_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables after deleting the documents ``gone`` (document_id), cascading as keys demand.

    Chunks, postings, embeddings and outgoing edges go; incoming edges stay without a target and
    become unresolved.
    """
    dead = tables["chunks"].join(gone, "document_id", "left_semi").select("chunk_id").distinct()
    out = dict(tables)
    out["documents"] = tables["documents"].join(gone, "document_id", "left_anti")
    out["chunks"] = tables["chunks"].join(gone, "document_id", "left_anti")
    for name in ("postings", "embeddings"):
        if name in tables:
            out[name] = tables[name].join(dead, "chunk_id", "left_anti")
    if "edges" in tables:
        left = tables["edges"].join(dead.withColumnRenamed("chunk_id", "from_chunk_id"), "from_chunk_id", "left_anti")
        mark = dead.select(F.col("chunk_id").alias("to_chunk_id"), F.lit(True).alias("dead"))
        left = left.join(mark, "to_chunk_id", "left")
        out["edges"] = left.select(
            *[
                F.when(F.col("dead"), None).otherwise(F.col(c)).alias(c)
                if c == "to_chunk_id"
                else (F.col(c) & F.col("dead").isNull()).alias(c)
                if c == "resolved"
                else F.col(c)
                for c in tables["edges"].columns
            ]
        )
    return out


def with_checksum(documents: DataFrame, document_id: str, checksum: str) -> DataFrame:
    hit = F.col("document_id") == document_id
    return documents.withColumns(
        {
            "checksum": F.when(hit, checksum).otherwise(F.col("checksum")),
            "updated_at": F.when(hit, F.current_timestamp()).otherwise(F.col("updated_at")),
        }
    )
