"""JSON-lines logs: a torn last line is skipped, a corrupt line inside the file is an error."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of each log; ``reason`` and ``intent`` may be missing.
SCHEMAS = {
    "decisions": "op string, ts string, assertion string, action string, via string, reason string",
    "vocabulary": "op string, ts string, kind string, proposed string, adopted string, action string, via string",
    "merges": "op string, ts string, duplicate string, canonical string, action string, via string, reason string",
    "retirements": "op string, ts string, slug string, action string, via string, reason string",
    "operations": "kind string, op string, ts string, intent string",
}
OPTIONAL = ("reason", "intent")


def read_log(spark: SparkSession, path: str, log: str) -> DataFrame:
    """The events of one or more log files with ``path`` and ``seq``, the byte-order place of the line in its file.

    A log file is read whole only to number its lines, as Spark keeps no order between splits; a vault's log is one
    small file. Blank lines are skipped. A line that isn't an object with all required keys raises, unless it is the file's
    last one.
    """
    schema = T.StructType.fromDDL(SCHEMAS[log])
    required = [f.name for f in schema if f.name not in OPTIONAL]
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", "\n")).alias("seq", "line")).filter(F.trim("line") != "")
    last = F.max("seq").over(Window.partitionBy("path")) == F.col("seq")
    parsed = lines.withColumn("_last", last).withColumn("_r", F.from_json("line", schema))
    good = F.col("_r").isNotNull()
    for c in required:
        good = good & F.col(f"_r.{c}").isNotNull()
    broken = F.raise_error(F.concat(F.lit("corrupt log line "), F.col("seq"), F.lit(" of "), F.col("path")))
    checked = parsed.withColumn("_ok", F.when(good, True).when(F.col("_last"), False).otherwise(broken.cast("boolean")))
    return checked.filter("_ok").select("path", F.col("seq").cast("long").alias("seq"), "_r.*")


def append_line(path: str, event: dict) -> None:
    """Append one event, flushed to disk (K3, K14): sorted keys, and the separators that other readers take for line ends escaped."""
    text = json.dumps(event, ensure_ascii=False, sort_keys=True)
    for c in ("\u0085", "\u2028", "\u2029"):
        text = text.replace(c, f"\\u{ord(c):04x}")
    with open(path, "a", encoding="utf-8") as f:
        f.write(text + "\n")
        f.flush()
        os.fsync(f.fileno())
