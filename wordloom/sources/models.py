"""A store of models: tables of one iteration are published at once, or not at all."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ModelStore:
    """Versions of a model below a folder of any store that Spark reads.

    A version is written under a new name; only when all of it is there, a
    pointer file is put in place by a rename.  Readers follow the pointer, so a
    save that breaks off leaves the last model as it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _where(self, *parts: str):
        return self._fs.Path("/".join((self.path, *parts)))

    def _system(self):
        return self._where("x").getFileSystem(self._conf)

    def _write(self, text: str, *parts: str) -> None:
        out = self._system().create(self._where(*parts), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read(self, *parts: str) -> str | None:
        where = self._where(*parts)
        if not self._system().exists(where):
            return None
        return "\n".join(r[0] for r in self.spark.read.text(where.toString(), wholetext=True).collect())

    def publish(self, tables: dict[str, DataFrame], iteration: int, facts: dict | None = None) -> str:
        """Write a version and point to it; returns its name.  Undefined numbers are refused."""
        version = f"iter={iteration}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/versions/{version}/{name}")
            held = self.spark.read.schema(df.schema).parquet(f"{self.path}/versions/{version}/{name}")
            bad = [F.isnan(c) if t == "double" else F.exists(c, lambda x: F.isnan(x)) for c, t in df.dtypes if t in ("double", "array<double>")]
            if bad and not held.filter(reduce(lambda a, b: a | b, bad)).isEmpty():
                raise ValueError(f"{name} has undefined numbers")
        self._write(json.dumps({"iteration": iteration, "tables": [*tables], "facts": facts or {}}), "versions", version, "about.json")
        self._point(version)
        return version

    def _point(self, version: str) -> None:
        ahead = f"current-{uuid.uuid4().hex[:8]}"
        self._write(version, ahead)
        rename = getattr(self._fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self._fs.FileContext.getFileContext(self._system().getUri(), self._conf).rename(self._system().makeQualified(self._where(ahead)), self._system().makeQualified(self._where("current")), how)

    def versions(self) -> dict[str, int]:
        """All whole versions and their iterations, oldest iteration first."""
        if not self._system().exists(self._where("versions")):
            return {}
        names = [s.getPath().getName() for s in self._system().listStatus(self._where("versions"))]
        whole = [n for n in names if self._system().exists(self._where("versions", n, "about.json"))]
        return {n: int(n.split("=")[1].split("-")[0]) for n in sorted(whole, key=lambda n: int(n.split("=")[1].split("-")[0]))}

    def load(self, iteration: int | None = None) -> tuple[dict[str, DataFrame], int, dict] | None:
        """(tables, iteration, facts) of the version pointed to, or of the last one of an iteration; None if there is none."""
        if iteration is None:
            version = self._read("current")
        else:
            version = next((v for v, i in reversed(self.versions().items()) if i == iteration), None)
        if not version:
            return None
        about = json.loads(self._read("versions", version, "about.json"))
        return {n: self.spark.read.parquet(f"{self.path}/versions/{version}/{n}") for n in about["tables"]}, about["iteration"], about["facts"]

    def prune(self, keep: int = 2) -> None:
        """Delete all but the last versions; the one pointed to always stays, broken ones go."""
        current = self._read("current")
        kept = {*list(self.versions())[-keep:], current}
        if self._system().exists(self._where("versions")):
            for s in self._system().listStatus(self._where("versions")):
                if s.getPath().getName() not in kept:
                    self._system().delete(s.getPath(), True)
