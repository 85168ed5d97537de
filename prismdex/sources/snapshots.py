"""Catalogue snapshots as layers: a commit writes what changed, readers merge, and a claim on the next version keeps a second writer out.

A version is a manifest (``v7.json``) that names the layers of each table: a base and the deltas after it.  A delta has new rows and the keys that it replaces or
removes; reading drops the rows of earlier layers with these keys.  Deltas that have grown beyond a share of the base, or are many, are merged into a new base by the commit that finds them so.
Every commit writes to folders of its own, so two writers never write to one.  The next version is claimed by creating a file that must not exist (atomic where the
file system's is: HDFS and stores with conditional puts); a claim whose writer has died can be taken over after ``lease`` seconds.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismdex.schemas import EMPTY


class Busy(RuntimeError):
    """Another writer has claimed the next version."""


class Conflict(RuntimeError):
    """Another writer has committed, or taken the claim over, since this one began."""


@dataclass(frozen=True)
class Delta:
    """Rows to put into a table and keys to take out of it: ``rows`` replace all earlier rows of their key, and rows of the keys ``gone`` (a column named ``key``) go.

    key None: rows are only added.
    """

    rows: DataFrame
    key: str | None = None
    gone: DataFrame | None = None


@dataclass
class Claim:
    version: int
    owner: str
    began: float


class Snapshots:
    """Tables under ``root`` on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, lease: float = 6 * 3600, most_layers: int = 8, most_share: float = 0.25):
        self.spark, self.root, self.lease, self.most_layers, self.most_share = spark, root.rstrip("/"), lease, most_layers, most_share
        self._jvm = spark.sparkContext._jvm
        self._files = self._place("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ files
    def _place(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _put(self, name: str, text: str) -> bool:
        """Writes a file that must not exist; whether it did not."""
        try:
            out = self._files.create(self._place(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or self._files.exists(self._place(name)):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _text(self, name: str) -> str | None:
        if not self._files.exists(self._place(name)):
            return None
        stream = self._files.open(self._place(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _bytes(self, path: str) -> int:
        return self._files.getContentSummary(self._jvm.org.apache.hadoop.fs.Path(path)).getLength()

    # ------------------------------------------------------------ reading
    def versions(self) -> list[int]:
        """Committed versions: those with a manifest."""
        if not self._files.exists(self._place("")):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._place(""))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, list[dict]]:
        """Layers by table of a version (the newest)."""
        found = self.versions()
        return json.loads(self._text(f"v{found[-1] if version is None else version}.json")) if found else {}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version (the newest); an empty one if there is none yet."""
        layers = self.manifest(version).get(name)
        return self._merged(layers) if layers else self.spark.createDataFrame([], EMPTY[name])

    def _merged(self, layers: list[dict]) -> DataFrame:
        schema = self.spark.read.parquet(layers[0]["rows"]).schema
        rows = [self.spark.read.schema(schema).parquet(x["rows"]) for x in layers]
        keyed = [(k, x) for k, x in enumerate(layers) if x["gone"]]
        if not keyed:
            return reduce(DataFrame.union, rows)
        key = keyed[0][1]["key"]
        last = reduce(DataFrame.union, [self.spark.read.parquet(x["gone"]).withColumn("layer", F.lit(k)) for k, x in keyed]).groupBy("key").agg(F.max("layer").alias("upto"))
        every = reduce(DataFrame.union, [r.select(F.struct("*").alias("row"), F.lit(k).alias("layer")) for k, r in enumerate(rows)])
        kept = every.join(last, F.col(f"row.{key}") == F.col("key"), "left").where("upto IS NULL OR layer >= upto")
        return kept.select("row.*")

    # ------------------------------------------------------------ writing
    def claim(self) -> Claim:
        """A claim on the next version, held until it is committed or released; Busy if another writer holds it."""
        version = (self.versions() or [0])[-1] + 1
        mine = Claim(version, uuid.uuid4().hex, time.time())
        name = f"v{version}.claim"
        for _ in range(2):
            if self._put(name, json.dumps({"owner": mine.owner, "began": mine.began})):
                return mine
            if not self._files.exists(self._place(name)):
                continue
            age = time.time() - self._files.getFileStatus(self._place(name)).getModificationTime() / 1000
            if age < self.lease:
                raise Busy(f"another writer has claimed version {version}, {age:.0f} seconds ago")
            self._files.delete(self._place(name), False)
        raise Busy(f"another writer has claimed version {version}")

    def claimed(self) -> dict | None:
        """Owner and beginning of the claim on the next version."""
        text = self._text(f"v{(self.versions() or [0])[-1] + 1}.claim")
        return json.loads(text) if text else None

    def _mine(self, claim: Claim) -> bool:
        return json.loads(self._text(f"v{claim.version}.claim") or "{}").get("owner") == claim.owner

    def release(self, claim: Claim) -> None:
        if self._mine(claim):
            self._files.delete(self._place(f"v{claim.version}.claim"), False)

    def commit(self, changes: dict[str, DataFrame | Delta], keep: int = 3, claim: Claim | None = None, go_on: bool = False) -> Claim | int:
        """Writes the changes as the next version and returns its number, or with ``go_on`` a claim on the one after it.

        A DataFrame replaces its table, a Delta changes it; other tables stay.  Versions before the last ``keep`` are removed, with the layers that no other names.
        Conflict: another writer was faster; nothing is changed then.
        """
        held = claim or self.claim()
        before = self.manifest() if self.versions() else {}
        after, own = dict(before), f"{self.root}/data/{held.owner}-{held.version}"
        for name, change in changes.items():
            if isinstance(change, DataFrame):
                change.write.parquet(f"{own}/{name}")
                after[name] = [{"rows": f"{own}/{name}", "gone": None, "key": None, "bytes": self._bytes(f"{own}/{name}")}]
                continue
            change.rows.write.parquet(f"{own}/{name}")
            layer = {"rows": f"{own}/{name}", "gone": None, "key": change.key, "bytes": self._bytes(f"{own}/{name}")}
            if change.key and before.get(name):
                keys = self.spark.read.schema(change.rows.schema).parquet(layer["rows"]).select(F.col(change.key).alias("key"))
                keys = keys.union(change.gone.select("key")) if change.gone is not None else keys
                keys.distinct().write.parquet(f"{own}/{name}.gone")
                layer["gone"] = f"{own}/{name}.gone"
            layers = [*before.get(name, []), layer]
            if len(layers) > self.most_layers or sum(x["bytes"] for x in layers[1:]) > self.most_share * max(layers[0]["bytes"], 1) and len(layers) > 2:
                self._merged(layers).write.parquet(f"{own}/{name}.base")
                layers = [{"rows": f"{own}/{name}.base", "gone": None, "key": None, "bytes": self._bytes(f"{own}/{name}.base")}]
            after[name] = layers
        following = None
        if go_on:
            following = Claim(held.version + 1, uuid.uuid4().hex, held.began)
            if not self._put(f"v{following.version}.claim", json.dumps({"owner": following.owner, "began": following.began})):
                raise Conflict(f"version {following.version} is claimed already")
        if not self._mine(held) or not self._put(f"v{held.version}.json", json.dumps(after)):
            if following:
                self.release(following)
            self._files.delete(self._jvm.org.apache.hadoop.fs.Path(own), True)
            raise Conflict(f"another writer has committed version {held.version} or taken over its claim")
        self._files.delete(self._place(f"v{held.version}.claim"), False)
        self._clean(keep)
        return following or held.version

    def _clean(self, keep: int) -> None:
        found = self.versions()
        folders = lambda versions: {"/".join(p.split("/")[:-1]) for v in versions for layers in self.manifest(v).values() for x in layers for p in (x["rows"], x["gone"]) if p}
        old = found[:-keep]
        for path in (folders(old) - folders(found[-keep:])) if old else ():
            self._files.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)
        for v in old:
            self._files.delete(self._place(f"v{v}.json"), False)
