"""Scratch tables in the shared folder named by ``spark.checkpoint.dir``.

Writing a table and reading it back cuts lineage, and what is read back survives the loss of any
executor.  Where the setting is missing, a session in one process (``local[n]``, as in tests) gets a
temporary folder; on a cluster, whose executors would not see one, that is an error.
"""

from __future__ import annotations

import tempfile
import uuid


class Scratch:
    def __init__(self, spark, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df, table: str, **options):
        """Write ``df`` as a Parquet table and return a frame that reads it."""
        df.write.mode("overwrite").options(**options).parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Delete tables that nothing reads any more; without names, all of them."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for p in [self.path(t) for t in tables] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
