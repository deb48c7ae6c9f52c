"""Fixed dimensions (S5, S10): languages, models, readiness markers.

These hold a constant number of rows (8 languages, 2 models), so they are
broadcast without a size check; their size never grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom import constants as K


def languages(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(K.LANGUAGES, "code string, name_zh string, nllb_code string"))


# Readiness markers found on the model store (S5): both shipped models are
# downloaded; any other model id has no marker and is not ready.
def ready_markers(spark: SparkSession) -> DataFrame:
    from transloom.functions.text import safe_name
    df = spark.createDataFrame([(m[0],) for m in K.MODELS], "model string")
    return F.broadcast(df.select(F.concat(safe_name("model"), F.lit(".ready")).alias("marker")))


def ready_markers_from_files(spark: SparkSession, path: str) -> DataFrame:
    """S5 on a real model store: one ``<safe name>.ready`` file per ready model. The markers may be
    empty, which file readers skip, so the folder is listed (a row per model)."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*.ready")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return spark.createDataFrame([(f.getPath().getName(),) for f in found], "marker string")
