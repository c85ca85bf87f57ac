"""Tables whose writes are whole or not at all: version folders, and one small pointer that is put in place last."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LAST_WRITE = "touched"


@dataclass(frozen=True)
class Versions:
    """A table in a folder. A write puts its rows in a new version folder; then a pointer file with the next number
    names the versions that make up the table. Readers follow the highest pointer, so they see the table before or
    after a write; a write that fails, at whatever point, leaves the table as it was. Two writers that start from the
    same pointer cannot both commit: the second raises FileExistsError.

    With keys in `by`, a write replaces the rows of the keys that it touches, and only those are rewritten: the version
    keeps its touched keys beside its rows, and a reader takes a key's rows from the last version that touched it. A
    touched key without rows is thus a delete. Rows may also be added, which touches nothing. Null is a key.
    After `most` versions a commit folds them into one. vacuum() deletes folders and pointers that are no longer
    named; a reader that is under way should have ended before."""

    spark: SparkSession
    path: str
    ddl: str
    by: tuple[str, ...] = ()
    most: int = 16
    seen: dict = field(default_factory=dict, compare=False)

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _pointers(self) -> list[str]:
        return [n for n in self._names("pointers") if n.isdigit()]

    def _state(self) -> dict:
        """The current pointer; read as text by Spark's own file access, wherever the table is."""
        names = self._pointers()
        if not names:
            return {"n": 0, "versions": [], "marks": {}}
        fs, path = self._fs(f"{self.path}/pointers/{names[-1]}")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def marks(self) -> dict[str, int]:
        """The marks that writes have left, by name: the highest of each."""
        return self._state()["marks"]

    def _commit(self, state: dict) -> None:
        """Write the next pointer under a name of its own, then rename it; the rename fails if another writer was first."""
        name = f"{state['n']:020d}"
        fs, temp = self._fs(f"{self.path}/pointers/_{uuid.uuid4().hex}")
        out = fs.create(temp)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm = self.spark._jvm
        final = jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers/{name}")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(temp, final, options)
        except Exception as error:
            fs.delete(temp, False)
            if "FileAlreadyExists" in str(error):
                raise FileExistsError(f"another writer has put version {state['n']} of {self.path} in place") from None
            raise

    def _read(self, state: dict) -> DataFrame:
        parts, touched = [], []
        for v in state["versions"]:
            at = f"{self.path}/{v['folder']}"
            parts.append(self.spark.read.schema(self.ddl).parquet(f"{at}/rows").withColumn("__v", F.lit(v["n"])))
            if v["kind"] == "keys":
                keys = self.spark.read.schema(self._empty().select(*self.by).schema).parquet(f"{at}/{_LAST_WRITE}")
                touched.append(keys.withColumn("__at", F.lit(v["n"])))
        if not parts:
            return self._empty()
        rows = reduce(DataFrame.unionByName, parts)
        columns = self._empty().columns
        if not touched:
            return rows.select(*columns)
        last = reduce(DataFrame.unionByName, touched).groupBy(*self.by).agg(F.max("__at").alias("__at"))
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in self.by]
        live = rows.alias("r").join(last.alias("t"), same, "left").where(F.col("__v") >= F.coalesce("__at", F.lit(0)))
        return live.select(*(F.col(f"r.{c}").alias(c) for c in columns))

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.ddl)

    def read(self) -> DataFrame:
        """The table as of now; empty before its first write. Writes that come later do not change it."""
        return self._read(self._state())

    def _write(self, rows: DataFrame, kind: str, touched: DataFrame | None, mark: tuple[str, int] | None) -> bool:
        state = self._state()
        if mark and state["marks"].get(mark[0], -1) >= mark[1]:
            return False
        n = state["n"] + 1
        folder = f"v{n:020d}-{uuid.uuid4().hex}"
        full = self._empty()
        rows = full.unionByName(rows.select(*(c for c in full.columns if c in rows.columns)), allowMissingColumns=True)
        rows.write.parquet(f"{self.path}/{folder}/rows")
        if kind == "keys":
            keys = self.spark.read.schema(self.ddl).parquet(f"{self.path}/{folder}/rows").select(*self.by)
            keys = keys.unionByName(touched.select(*self.by)) if touched is not None else keys
            keys.distinct().write.parquet(f"{self.path}/{folder}/{_LAST_WRITE}")
        versions = [] if kind == "whole" else state["versions"]
        marks = state["marks"] | ({mark[0]: mark[1]} if mark else {})
        new = {"n": n, "versions": [*versions, {"n": n, "folder": folder, "kind": kind}], "marks": marks}
        self._commit(new)
        if len(new["versions"]) > self.most:
            self.compact()
        return True

    def replace(self, rows: DataFrame, touched: DataFrame | None = None, mark: tuple[str, int] | None = None) -> bool:
        """Without `by`, rows are the table. With it, they replace those of their keys and of the touched keys. A mark
        (name, number) is put in place with the write; where it or a higher one of its name is there already, nothing
        is written and False is returned: a replay is seen."""
        return self._write(rows, "keys" if self.by else "whole", touched, mark)

    def add(self, rows: DataFrame, mark: tuple[str, int] | None = None) -> bool:
        """Adds rows to those that are there; marks as for replace."""
        return self._write(rows, "rows", None, mark)

    def compact(self) -> None:
        """Write the table as one version. Nothing changes for readers."""
        state = self._state()
        n = state["n"] + 1
        folder = f"v{n:020d}-{uuid.uuid4().hex}"
        self._read(state).write.parquet(f"{self.path}/{folder}/rows")
        self._commit({"n": n, "versions": [{"n": n, "folder": folder, "kind": "whole"}], "marks": state["marks"]})

    def vacuum(self) -> int:
        """Deletes what the current pointer does not name, failed writes too; returns how many folders went."""
        live = {v["folder"] for v in self._state()["versions"]}
        names = self._pointers()
        gone = [n for n in self._names("") if n.startswith("v") and n not in live]
        for at in [*gone, *(f"pointers/{n}" for n in names[:-1])]:
            fs, path = self._fs(f"{self.path}/{at}")
            fs.delete(path, True)
        return len(gone)
