"""Versions of a table: content-addressed buckets of rows, manifests, branches, tags, differences and merges.

Rows are dealt into buckets by their key. A bucket's address is a digest of its
rows that doesn't depend on their order, so a version writes only buckets that
no version before it has, and two versions differ only in buckets whose
addresses differ; nothing else is read to compare or merge them. All files lie
below one folder that the cluster shares; references are appended last, so a
commit that breaks off leaves nothing but unused buckets.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import row_text

MANIFEST, LOG, REFS = "version string, bucket int, address string, rows long", "version string, parents array<string>, message string, schema string, rows long, number long", "name string, version string, number long"


def _digest(columns: list[str]) -> list[Column]:
    """Aggregates over rows that any change of them changes, whatever their order."""
    text = row_text(columns)
    one, two = F.xxhash64(text), F.xxhash64(F.lit(7), text)
    return [F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y"), F.sum(one.cast("decimal(38,0)")).alias("s")]


class Versions:
    """A store in ``folder`` for tables with the columns ``key``; ``buckets`` bounds what a manifest has."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], buckets: int = 256):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def _append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.folder}/{name}")

    def _entry(self, version: str) -> dict:
        return self._table("log", LOG).where(F.col("version") == version).first().asDict()

    def _count(self, name: str, schema: str) -> int:
        return self._table(name, schema).count()

    def version(self, ref: str) -> str:
        """The version that a branch, a tag, or the beginning of a version's own name stands for."""
        row = self._table("refs", REFS).where(F.col("name") == ref).orderBy(F.desc("number")).first()
        row = row or self._table("log", LOG).where(F.col("version").startswith(ref)).first()
        if row is None:
            raise KeyError(f"no version {ref!r}")
        return row["version"]

    def _record(self, manifest: DataFrame, parents: list[str], message: str, schema: str, branch: str) -> str:
        """Appends a manifest of (bucket, address, rows), a log entry and the branch's new head."""
        rows = sorted((r["bucket"], r["address"], r["rows"]) for r in manifest.collect())  # at most a row for each bucket
        number = self._count("log", LOG)
        version = hashlib.sha256(repr((rows, parents, message, schema, number)).encode()).hexdigest()
        self._append("manifests", self.spark.createDataFrame([(version, *r) for r in rows], MANIFEST))
        self._append("log", self.spark.createDataFrame([(version, parents, message, schema, sum(r[2] for r in rows), number)], LOG))
        self.point(branch, version)
        return version

    def point(self, name: str, ref: str) -> None:
        """A branch or tag set to a version."""
        known = self._table("refs", REFS).where(F.col("name") == ref).count() or len(ref) != 64
        version = self.version(ref) if known else ref
        self._append("refs", self.spark.createDataFrame([(name, version, self._count("refs", REFS))], REFS))

    def commit(self, df: DataFrame, message: str, branch: str = "main") -> str:
        """Writes the buckets of ``df`` that are new, and a version after the branch's head. Repeated rows count; an empty table has no buckets."""
        schema = df.schema.json()
        placed = df.withColumn("__bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))
        sums = placed.groupBy("__bucket").agg(*_digest(df.columns))
        address = F.sha2(F.concat_ws("|", F.lit(schema), F.col("__bucket").cast("string"), *[F.col(c).cast("string") for c in "nxys"]), 256)
        manifest = self.spark.createDataFrame(sums.select("__bucket", address, "n").collect(), "bucket int, address string, rows long")  # at most a row for each bucket
        new = manifest.join(self._table("manifests", MANIFEST).select("address"), "address", "left_anti")
        if new.limit(1).count():
            own = placed.join(F.broadcast(new.select(F.col("bucket").alias("__bucket"), "address")), "__bucket").drop("__bucket")
            own.hint("rebalance", "address").write.partitionBy("address").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/objects")
        heads = self._table("refs", REFS).where(F.col("name") == branch).limit(1).count()
        return self._record(manifest, [self.version(branch)] if heads else [], message, schema, branch)

    def _manifest(self, version: str) -> DataFrame:
        return self._table("manifests", MANIFEST).where(F.col("version") == version).select("bucket", "address", "rows")

    def _rows(self, addresses: list[str], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType
        import json

        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*[f"{self.folder}/objects/address={a}" for a in addresses]) if addresses else self.spark.createDataFrame([], kind)

    def read(self, ref: str) -> DataFrame:
        version = self.version(ref)
        return self._rows([r["address"] for r in self._manifest(version).collect()], self._entry(version)["schema"])

    def changed_buckets(self, a: str, b: str) -> list[tuple[int, str | None, str | None]]:
        """Buckets whose addresses differ, and both addresses; at most one for each bucket."""
        one, two = (self._manifest(self.version(r)).select("bucket", F.col("address").alias(n)) for r, n in ((a, "a"), (b, "b")))
        return [tuple(r) for r in one.join(two, "bucket", "full").where("a is distinct from b").orderBy("bucket").collect()]

    def diff(self, a: str, b: str) -> DataFrame:
        """The key and change (added, removed, changed) of rows that differ; of a repeated key, its rows together. Reads only buckets that differ."""
        changed = self.changed_buckets(a, b)
        sides = []
        for at, ref, name in ((1, a, "old"), (2, b, "new")):
            rows = self._rows([c[at] for c in changed if c[at]], self._entry(self.version(ref))["schema"])
            sides.append(rows.groupBy(*[F.col(k).alias(f"{name}_{i}") for i, k in enumerate(self.key)]).agg(F.struct(*_digest(rows.columns)).alias(name)))
        same = F.lit(True)
        for i in range(len(self.key)):
            same = same & F.col(f"old_{i}").eqNullSafe(F.col(f"new_{i}"))
        joined = sides[0].join(sides[1], same, "full").where("old is distinct from new")
        change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
        return joined.select(*[F.coalesce(f"new_{i}", f"old_{i}").alias(k) for i, k in enumerate(self.key)], change.alias("change"))

    def log(self, ref: str) -> DataFrame:
        """version, parents, message, rows, depth of a version and all before it, the newest first. The log has a row for each version."""
        entries = {r["version"]: r for r in self._table("log", LOG).collect()}
        depth, held = {self.version(ref): 0}, [self.version(ref)]
        for version in held:
            for parent in entries[version]["parents"]:
                if parent not in depth:
                    depth[parent] = depth[version] + 1
                    held.append(parent)
        rows = [(v, list(entries[v]["parents"]), entries[v]["message"], entries[v]["rows"], d) for v, d in depth.items()]
        return self.spark.createDataFrame(rows, "version string, parents array<string>, message string, rows long, depth int").orderBy("depth", "version")

    def base(self, a: str, b: str) -> str | None:
        """The nearest version before both."""
        one, two = ({r["version"]: r["depth"] for r in self.log(ref).collect()} for ref in (a, b))
        return min(one.keys() & two.keys(), key=lambda v: (one[v] + two[v], v), default=None)

    def merge(self, branch: str, other: str, message: str) -> tuple[str | None, DataFrame]:
        """A version of ``branch`` with the changes of ``other`` since they parted, and no conflicts; or None, and the keys that both changed differently.

        Buckets that only one side changed are taken by address. Of the others
        the rows are read: each key is taken from the side that changed it.
        """
        base = self.base(branch, other)
        if base is None:
            raise ValueError("the versions have no common one")
        ours, theirs = ({c[0]: c for c in self.changed_buckets(base, ref)} for ref in (branch, other))
        both = [k for k in ours.keys() & theirs.keys() if ours[k][2] != theirs[k][2]]
        mine = {r["bucket"]: (r["address"], r["rows"]) for r in self._manifest(self.version(branch)).collect()}
        taken = {r["bucket"]: (r["address"], r["rows"]) for r in self._manifest(self.version(other)).collect()}
        parents, schema = [self.version(branch), self.version(other)], self._entry(self.version(branch))["schema"]
        of_key = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).isin(both) if both else F.lit(False)
        left, right = self.diff(base, branch).where(of_key), self.diff(base, other).where(of_key)
        on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in self.key]
        met = left.alias("l").join(right.alias("r"), on)
        apart = self.diff(branch, other).where(of_key)
        clashes = met.select(*[F.col(f"l.{k}") for k in self.key]).alias("c").join(apart.alias("d"), [F.col(f"c.{k}").eqNullSafe(F.col(f"d.{k}")) for k in self.key], "left_semi")
        if both and clashes.limit(1).count():
            return None, clashes
        merged = {k: v for k, v in mine.items() if k not in theirs} | {k: taken[k] for k in theirs if k in taken}
        merged |= {k: mine[k] for k in ours if k in mine and k not in both and k in theirs}
        plain = [(k, *v) for k, v in merged.items() if k not in both]
        if both:
            pick = lambda refs: self._rows([refs[k][0] for k in both if k in refs], schema)
            same = lambda a, b: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.key]
            kept = pick(mine).alias("a").join(right.alias("b"), same("a", "b"), "left_anti")
            moved = pick(taken).alias("a").join(right.alias("b"), same("a", "b"), "left_semi")
            self.commit(kept.unionByName(moved), message, f"{branch} and {other}")
            plain += [tuple(r) for r in self._manifest(self.version(f"{branch} and {other}")).collect()]
        manifest = self.spark.createDataFrame(plain, "bucket int, address string, rows long")
        return self._record(manifest, parents, message, schema, branch), clashes.limit(0)
