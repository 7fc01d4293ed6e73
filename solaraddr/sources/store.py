"""A store of documents by key with versions: writes add tables, a manifest names those of a version, readers see one version or another."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Attempts of a commit against others that commit at the same time.
ATTEMPTS = 20


class ConflictError(RuntimeError):
    """Another writer took a version that this one depends on."""


@dataclass(frozen=True)
class Store:
    """Documents (columns of `schema`, a DDL text) by `key`, under `path` on any file system that Spark reaches.

    `data/<id>` holds the rows of one write as Parquet, and a mark on those that are deleted; `versions/<number>.json` names the tables of a version,
    in order. A version appears by a rename that fails if it is there, so writers that meet try again after each other, and a
    write that breaks off leaves nothing but a table that no version names (`vacuum` takes it away). Of a key the row of
    the latest write counts, and a null key is a key too. Earlier versions stay readable until `vacuum`.
    """

    spark: SparkSession
    path: str
    schema: str
    key: str

    def _fs(self):
        jvm = self.spark._jvm
        home = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(home.toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path.rstrip("/"), *parts)))

    def _listed(self, folder: str) -> list[str]:
        _, fs = self._fs()
        if not fs.util().exists(self._at(folder)):
            return []
        return [f.getPath().getName() for f in fs.util().listStatus(self._at(folder))]

    def versions(self) -> list[int]:
        return sorted(int(f.split(".")[0]) for f in self._listed("versions") if f.endswith(".json") and f[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        """What a version is made of: `tables`, in the order of their writes; of the latest one, or of an empty store."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if not version:
            return {"version": 0, "tables": []}
        if version not in known:
            raise KeyError(f"no version {version}")
        line = self.spark.read.text(f"{self.path}/versions/{version:012d}.json").first()[0]
        return json.loads(line)

    def _commit(self, base: dict, tables: list[str]) -> int:
        """Puts the next version in place, or raises ConflictError."""
        jvm, fs = self._fs()
        version = base["version"] + 1
        fs.mkdir(self._at("versions"), None, True)
        hidden = self._at("versions", f".{uuid.uuid4().hex}")
        flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
        out = fs.create(hidden, flags, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
        out.write(bytearray(json.dumps({"version": version, "tables": tables}).encode()))
        out.close()
        try:
            fs.rename(hidden, self._at("versions", f"{version:012d}.json"), self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as problem:
            fs.delete(hidden, False)
            if "FileAlreadyExists" in str(problem):
                raise ConflictError(f"version {version} is there") from problem
            raise
        return version

    def _add(self, rows: DataFrame) -> int:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        for _ in range(ATTEMPTS):
            base = self.manifest()
            try:
                return self._commit(base, [*base["tables"], name])
            except ConflictError:
                continue
        raise ConflictError(f"no version after {ATTEMPTS} attempts")

    def _shaped(self, docs: DataFrame) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema)
        return docs.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in empty.schema])

    def save(self, docs: DataFrame, order: str | None = None) -> int:
        """Adds documents or replaces those of their keys; returns the new version. Of several of one key in `docs` the last by `order` stays, by default any."""
        last = Window.partitionBy(self.key).orderBy(F.desc(order) if order else F.lit(0))
        once = docs.withColumn("_i", F.row_number().over(last)).where("_i = 1").drop("_i")
        return self._add(self._shaped(once).withColumn("_deleted", F.lit(False)))

    def delete(self, keys: DataFrame) -> int:
        """Takes the documents of these keys (column `key`) away, in a new version."""
        empty = self.spark.createDataFrame([], self.schema)
        gone = keys.select(self.key).distinct()
        return self._add(gone.select(*[(F.col(f.name) if f.name == self.key else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema], F.lit(True).alias("_deleted")))

    def _live(self, tables: list[str], where=None) -> DataFrame:
        fields = self.spark.createDataFrame([], self.schema).schema
        if not tables:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/{t}" for t in tables]
        rows = self.spark.read.schema(f"{self.schema}, _deleted boolean").parquet(*paths)
        if where is not None:
            rows = rows.where(where)
        if len(tables) > 1:
            order = F.array_position(F.array(*[F.lit(t) for t in tables]), F.element_at(F.split("_metadata.file_path", "/"), -2))
            newest = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc(order)))
            rows = rows.withColumn("_i", newest).where("_i = 1")
        return rows.where("NOT _deleted").select(fields.names)

    def load(self, version: int | None = None, key=None, order: str | None = None, descending: bool = False, where=None) -> DataFrame:
        """The documents of a version, the latest by default: that of one key, those that fit `where`, in the order of a column (texts by locale)."""
        docs = self._live(self.manifest(version)["tables"], None if key is None else F.col(self.key) == key)
        docs = docs if where is None else docs.where(where)
        if order is None:
            return docs
        by = F.collate(order, "UNICODE") if docs.schema[order].dataType.typeName() == "string" else F.col(order)
        return docs.orderBy(by.desc() if descending else by.asc())

    def compact(self) -> int:
        """A version whose documents are one table, without those that are replaced or deleted. Raises ConflictError if another write comes between."""
        base = self.manifest()
        if len(base["tables"]) == 1:
            rows = self.spark.read.parquet(f"{self.path}/data/{base['tables'][0]}").where("_deleted").limit(1).count()
            if not rows:
                return base["version"]
        name = uuid.uuid4().hex
        self._live(base["tables"]).withColumn("_deleted", F.lit(False)).write.parquet(f"{self.path}/data/{name}")
        return self._commit(base, [name])

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all versions but the latest `keep`, and tables that none of these names; returns how many tables went.

        Run it while nobody writes: a table whose version is not yet there would go too.
        """
        _, fs = self._fs()
        known = self.versions()
        kept = known[-keep:] if keep else known[-1:]
        named = {t for v in kept for t in self.manifest(v)["tables"]}
        for v in known:
            if v not in kept:
                fs.delete(self._at("versions", f"{v:012d}.json"), False)
        gone = [t for t in self._listed("data") if t not in named]
        for t in gone:
            fs.delete(self._at("data", t), True)
        return len(gone)
