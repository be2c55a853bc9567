"""Tables in shared folders: lineage that is cut, and tables in parts of which only changed ones are written anew.

A table of `Parts` is a folder of data and a folder of manifests. A change writes the parts that it touches into a folder of
its own, and then names all parts in the next manifest, which is one small file put in place by a rename. Readers see the
last manifest, so they see all of a change or nothing of it: a job that dies before the name leaves the table as it was,
and a lost executor only has its tasks run again. A change has a token, and one whose token is named already is left out,
so a job may run twice. Two writers cannot take one number: the second fails.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def saved(rows: DataFrame) -> DataFrame:
    """The rows from the shared checkpoint folder, with their lineage cut.

    In local mode (tests) a temporary folder takes the place of one that is unset: executors elsewhere cannot see it.
    """
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="trails-"))
    return rows.checkpoint()


class Folder:
    """Small files of a folder in any file system that Spark has."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, name: str = "") -> list[str]:
        at, fs = self._at(name)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def exists(self, name: str) -> bool:
        at, fs = self._at(name)
        return fs.exists(at)

    def read(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.option("wholetext", True).text(f"{self.root}/{name}").collect())

    def put(self, name: str, text: str) -> None:
        """Write the file beside its place and rename it there; a file that is there already is an error."""
        at, fs = self._at(name)
        beside, _ = self._at(f"{name}.{uuid.uuid4().hex}.new")
        out = fs.create(beside, False)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(at) or not fs.rename(beside, at):
            fs.delete(beside, False)
            raise FileExistsError(f"{self.root}/{name}")

    def delete(self, name: str) -> None:
        at, fs = self._at(name)
        fs.delete(at, True)


#: Tokens of changes that a manifest remembers.
TOKENS = 1000


class Parts:
    """A table in parts below one folder, in versions: see the module.

    `part` is the column expression that deals rows to parts, whose number has a bound; by default a hash of the key to
    `count` buckets. `about` are aggregates of each part that the manifest keeps.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: tuple[str, ...], part: Column | None = None, count: int = 64, about: dict[str, Column] | None = None):
        self.spark, self.folder, self.schema, self.key = spark, Folder(spark, root), schema, key
        self.part = (F.pmod(F.xxhash64(*key), F.lit(count)) if part is None else part).cast("string")
        self.about = about or {}

    def version(self) -> int:
        return max((int(n.split(".")[0]) for n in self.folder.names("manifest") if re.fullmatch(r"\d+\.json", n)), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """Of a version: parts with their folders and what is said of them, and the tokens of changes."""
        version = self.version() if version is None else version
        return json.loads(self.folder.read(f"manifest/{version}.json")) if version else {"parts": {}, "tokens": []}

    def rows_of(self, parts: dict[str, dict], options: dict[str, str] | None = None) -> DataFrame:
        """Rows of some parts, from their files only."""
        paths = [f"{self.folder.root}/{p['folder']}" for p in parts.values()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).options(**(options or {})).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        return self.rows_of(self.manifest(version)["parts"])

    def replace(self, rows: DataFrame, gone: DataFrame | None = None, token: str | None = None) -> int:
        """Put rows in the place of those with their keys, and of those with the keys of `gone`; the version after that."""
        version = self.version()
        before = self.manifest(version)
        if token is not None and token in before["tokens"]:
            return version
        rows = saved(rows.select(*[c.split()[0] for c in self.schema.split(", ")]))
        keys = rows.select(*self.key)
        keys = saved((keys if gone is None else keys.unionByName(gone.select(*self.key))).distinct())
        changed = [r[0] for r in keys.select(self.part).distinct().collect()]  # at most the number of parts
        kept = self.rows_of({p: before["parts"][p] for p in changed if p in before["parts"]}).join(keys, list(self.key), "left_anti")
        after = {p: about for p, about in before["parts"].items() if p not in changed} | self._written(kept.unionByName(rows), version + 1)
        self._name(version + 1, after, before["tokens"], token)
        return version + 1

    def replace_parts(self, rows: DataFrame, token: str | None = None) -> int:
        """Put rows in the place of the whole parts that they belong to."""
        version = self.version()
        before = self.manifest(version)
        if token is not None and token in before["tokens"]:
            return version
        self._name(version + 1, before["parts"] | self._written(rows, version + 1), before["tokens"], token)
        return version + 1

    def _written(self, rows: DataFrame, version: int) -> dict[str, dict]:
        """Write rows by parts into a new folder, and say which parts they make."""
        folder = f"data/{version}-{uuid.uuid4().hex}"
        rows.withColumn("part", self.part).repartition("part").write.partitionBy("part").parquet(f"{self.folder.root}/{folder}")
        made = self.spark.read.schema(f"{self.schema}, part string").parquet(f"{self.folder.root}/{folder}")
        told = made.groupBy("part").agg(F.count("*").alias("rows"), *[c.alias(n) for n, c in self.about.items()]).collect()
        return {r["part"]: {"folder": f"{folder}/part={r['part']}", **{k: r[k] for k in ("rows", *self.about)}} for r in told}

    def _name(self, version: int, parts: dict[str, dict], tokens: list[str], token: str | None) -> None:
        tokens = [*tokens, token][-TOKENS:] if token is not None else tokens
        self.folder.put(f"manifest/{version}.json", json.dumps({"parts": parts, "tokens": tokens}))

    def vacuum(self, versions: int = 10) -> list[str]:
        """Delete the folders of data that none of the last versions names; what was deleted."""
        last = self.version()
        named = {p["folder"].split("/")[1] for v in range(max(1, last - versions + 1), last + 1) for p in self.manifest(v)["parts"].values()}
        gone = [n for n in self.folder.names("data") if n not in named]
        for name in gone:
            self.folder.delete(f"data/{name}")
        return gone
