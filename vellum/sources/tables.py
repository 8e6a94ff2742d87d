"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def materialised(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, so that what follows reads the same rows again, whatever is lost or run anew.

    The folder is spark.checkpoint.dir; where that is unset, in local mode only, a temporary one.
    """
    context = df.sparkSession.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="vellum-"))
    return df.checkpoint()
