"""Results that several later steps read, kept once where all executors can reach them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """``df`` checkpointed: what follows neither computes it anew nor depends on the executors that did.

    The folder is that of ``spark.checkpoint.dir``. Where none is set and all
    runs in one process, as in tests, a temporary one is; on a cluster that
    fails, as executors would not see each other's files.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-stage-"))
    return df.checkpoint()
