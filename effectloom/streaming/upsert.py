"""Upsert sink: the latest row per key, in hash buckets of base and delta files.

A batch writes only its own rows, as a delta.  Readers merge a bucket's base with
the deltas written since.  A bucket is compacted, alone, when its deltas hold a
set share of its base's rows, so what a batch writes is in proportion to what it
changes.  A small manifest per batch names each bucket's base; it is written
last, so a reader sees all of a batch or nothing, and a retried batch overwrites
its own folders only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, BUCKET = "upsert_batch", "upsert_bucket"


class UpsertTable:
    """Folders delta/batch, base/batch and manifest/batch under one path.

    key: column that identifies a row (null is a key of its own).  order: the
    row of largest order stays; of equal ones the later batch, then the larger row.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, buckets: int = 64, share: float = 0.5):
        self.spark, self.path, self.key, self.order, self.buckets, self.share = spark, path.rstrip("/"), key, order, buckets, share

    def _folder(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _batches(self, name: str) -> list[int]:
        fs, p = self._folder(name)
        return sorted(int(s.getPath().getName().split("=")[1]) for s in (fs.listStatus(p) if fs.exists(p) else []) if "=" in s.getPath().getName())

    def manifest(self, before: int | None = None) -> dict:
        """State after the newest batch (or the newest one below `before`): per bucket its base and the deltas since."""
        done = [b for b in self._batches("manifest") if before is None or b < before]
        if not done:
            return {"batch": -1, "buckets": self.buckets, "base": {}, "base_rows": {}, "deltas": {}, "schema": None}
        text = self.spark.read.text(f"{self.path}/manifest/batch={done[-1]}", wholetext=True).select("value").first()
        return json.loads(text["value"])

    def _save(self, m: dict) -> None:
        self.spark.createDataFrame([(json.dumps(m),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/batch={m['batch']}")

    def _latest(self, df: DataFrame) -> DataFrame:
        """One row per key; df has all columns, the bucket and the batch."""
        cols = [c for c in df.columns if c not in (self.key, BATCH, BUCKET)]
        newest = F.max(F.struct(F.col(self.order).alias("by"), F.col(BATCH).alias("batch"), F.struct(*cols).alias("row")))
        return df.groupBy(BUCKET, self.key).agg(newest.alias("newest")).select(self.key, *[F.col("newest.row")[c].alias(c) for c in cols],
                                                                            F.col("newest.batch").alias(BATCH), BUCKET)

    def _merged(self, m: dict, only: list[str] | None = None) -> DataFrame:
        """Latest rows of the named buckets (all without names) as of a manifest."""
        from pyspark.sql.types import StructType
        wanted = [b for b in {**m["base"], **m["deltas"]} if only is None or b in only]
        bases = [f"{self.path}/base/batch={m['base'][b]}/{BUCKET}={b}" for b in wanted if b in m["base"]]
        deltas = [f"{self.path}/delta/batch={n}/{BUCKET}={b}" for b in wanted for n in m["deltas"].get(b, {})]
        schema = StructType.fromJson(m["schema"])
        out = self.spark.createDataFrame([], schema)
        # file paths name the bucket; all files hold their rows' batch
        for paths in (bases, deltas):
            if paths:
                out = out.unionByName(self.spark.read.schema(StructType([f for f in schema.fields if f.name != BUCKET])).parquet(*paths).withColumn(
                    BUCKET, F.pmod(F.xxhash64(self.key), F.lit(m["buckets"])).cast("int")))
        return self._latest(out)

    def upsert(self, batch: DataFrame, batch_id: int) -> dict:
        """Write one batch; returns the manifest.  A batch that was written before is written again over itself."""
        m = self.manifest(batch_id)
        self.buckets = m["buckets"]
        own = self._latest(batch.withColumns({BATCH: F.lit(batch_id).cast("long"), BUCKET: F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")}))
        m |= {"batch": batch_id, "schema": json.loads(own.schema.json())}
        at = f"{self.path}/delta/batch={batch_id}"
        own.repartition(F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(at)
        for row in self.spark.read.schema(own.schema).parquet(at).groupBy(BUCKET).count().collect():  # at most `buckets` rows
            m["deltas"].setdefault(str(row[BUCKET]), {})[str(batch_id)] = row["count"]
        full = [b for b, d in m["deltas"].items() if sum(d.values()) >= self.share * m["base_rows"].get(b, 0)]
        if full:
            self._compact(m, full)
        self._save(m)
        return m

    def _compact(self, m: dict, buckets: list[str]) -> None:
        at = f"{self.path}/base/batch={m['batch']}"
        whole = self._merged(m, buckets)
        whole.repartition(F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(at)
        rows = {str(r[BUCKET]): r["count"] for r in self.spark.read.schema(whole.schema).parquet(at).groupBy(BUCKET).count().collect()}
        for b in buckets:
            m["base"][b], m["base_rows"][b] = m["batch"], rows[b]
            del m["deltas"][b]

    def read(self) -> DataFrame:
        """The latest row per key as of the newest complete batch; an error if nothing was ever written."""
        m = self.manifest()
        if m["schema"] is None:
            raise FileNotFoundError(f"{self.path}: no batch has been written")
        return self._merged(m).drop(BATCH, BUCKET)

    def vacuum(self) -> int:
        """Delete base and delta folders that the newest manifest does not need, and older manifests; returns how many."""
        m = self.manifest()
        live = {"base": set(m["base"].values()), "delta": {int(n) for d in m["deltas"].values() for n in d}, "manifest": {m["batch"]}}
        gone = 0
        for name, keep in live.items():
            for n in [n for n in self._batches(name) if n not in keep and n <= m["batch"]]:
                fs, p = self._folder(f"{name}/batch={n}")
                gone += bool(fs.delete(p, True))
        return gone


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, output_mode: str = "update", buckets: int = 64, share: float = 0.5):
    """Drain the available input into an UpsertTable."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        UpsertTable(batch.sparkSession, path, key, order, buckets, share).upsert(batch, batch_id)

    return (stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(merge).start())
