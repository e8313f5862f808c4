"""Notes, captures and pages on disk: front-matter and Markdown files (S1-S6, S9, S10), and their writers (K1, K2, K4-K6).

A file that cannot be read as a record doesn't stop a scan: it comes out as ``unparsed`` with its text and the error. Of records
that repeat an id the first path wins, the others are reported.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "path string, id string, record string, body string, error string"


class Conflict(Exception):
    """The file is not in the state that the writer saw."""


def parse_front_matter(text: str) -> tuple[dict, str]:
    """The mapping between the leading ``---`` lines and the body after them; without front-matter an empty mapping."""
    import yaml

    if not text.startswith("---\n"):
        return {}, text
    head, sep, body = text[4:].partition("\n---\n")
    if not sep:
        raise ValueError("front-matter is not closed")
    data = yaml.safe_load(head) or {}
    if not isinstance(data, dict):
        raise ValueError("front-matter is not a mapping")
    return data, body


def render_front_matter(data: dict, body: str) -> str:
    import yaml

    return "---\n" + yaml.safe_dump(data, sort_keys=False, allow_unicode=True) + "---\n" + body


def scan(spark: SparkSession, path: str, require: tuple[str, ...] = ("id",), mode: str = "degrade") -> DataFrame:
    """Records of all Markdown files under ``path``: path, id, record (JSON of the front-matter), body, error.

    mode: degrade (bad files are unparsed rows), drop (they are left out) or failfast (they raise).
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), "value")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for p, text in zip(pdf["path"], pdf["value"], strict=True):
                try:
                    data, body = parse_front_matter(text)
                    if missing := [k for k in require if data.get(k) in (None, "")]:
                        raise ValueError(f"missing {', '.join(missing)}")
                    out.append((p, str(data.get("id", "")) or None, json.dumps(data, ensure_ascii=False, default=str), body, None))
                except Exception as e:  # noqa: BLE001 - any text may come in
                    if mode == "failfast":
                        raise
                    out.append((p, None, None, text, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["path", "id", "record", "body", "error"])

    rows = files.mapInPandas(run, RECORD)
    return rows.filter("error is null") if mode == "drop" else rows


def typed(rows: DataFrame, schema: str) -> DataFrame:
    """Records as columns of ``schema`` (S6), with path and body; what a record lacks or says in another type is null. Unparsed rows are left out."""
    r = rows.filter("error is null").select("path", "body", F.from_json("record", schema).alias("_r"))
    return r.select("path", "_r.*", "body")


#: The version of the exported graph that is read, and the shape of its edges.
GRAPH_VERSION = 1
EDGES = "array<struct<key:string,source:string,target:string,type:string,weight:bigint,traversable:boolean,assertions:array<struct<id:string,status:string,note_id:string,strength:int>>>>"


def write_graph(edges: DataFrame, path: str) -> None:
    """The exported graph (K10, K12) as JSON lines, one edge a line with the version, so neither writing nor reading gathers it in one task."""
    edges.select(F.lit(GRAPH_VERSION).alias("version"), *(c for c in edges.columns)).write.mode("overwrite").json(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges of an exported graph (S25): of JSON lines, or of one document with an array of edges. Another version raises."""
    lines = spark.read.text(path, wholetext=False)
    one = F.from_json("value", f"version int, key string, edges {EDGES}")
    edge = F.from_json("value", "key string, source string, target string, type string, weight bigint, traversable boolean, assertions array<struct<id:string,status:string,note_id:string,strength:int>>")
    rows = lines.filter(F.trim("value") != "").select(one.alias("_g"), edge.alias("_e"))
    bad = F.raise_error(F.concat(F.lit("unsupported graph version "), F.coalesce(F.col("_g.version").cast("string"), F.lit("none"))))
    rows = rows.filter(F.when(F.col("_g.version") == GRAPH_VERSION, True).otherwise(bad.cast("boolean")))
    edges = F.when(F.col("_g.edges").isNotNull(), F.col("_g.edges")).otherwise(F.array("_e"))
    return rows.select(F.explode(edges).alias("_e")).select("_e.*")


def split_repeats(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with the first path of each id, and the repeats."""
    n = F.row_number().over(Window.partitionBy("id").orderBy("path"))
    ranked = rows.filter("id is not null").withColumn("_n", n)
    return ranked.filter("_n = 1").drop("_n"), ranked.filter("_n > 1").drop("_n")


def hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """path and h of every source file (S10): what drift is measured against."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("h"))


def content_hash(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def atomic_write(path: str | Path, text: str) -> None:
    """Replace a file as a whole: a temporary file beside it, flushed, then renamed (K1)."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise


def swap_write(path: str | Path, text: str, seen: str | None) -> None:
    """Write only if the file still has the content hash ``seen``; None: it must not exist (K2)."""
    path = Path(path)
    if seen is None:  # a finished file is linked into place, so no reader sees half of it
        if path.exists():
            raise Conflict(f"{path} exists")
        whole = path.with_name(f".{path.name}.{os.getpid()}.new")
        atomic_write(whole, text)
        try:
            os.link(whole, path)
        except FileExistsError:
            raise Conflict(f"{path} exists") from None
        finally:
            whole.unlink(missing_ok=True)
        return
    if not path.exists() or content_hash(path.read_text(encoding="utf-8")) != seen:
        raise Conflict(f"{path} has changed")
    atomic_write(path, text)


def write_page(path: str | Path, data: dict, body: str, keep: tuple[str, ...] = ("user",)) -> None:
    """Write a page, keeping the fields that belong to the user (K5, K6)."""
    path = Path(path)
    seen = None
    if path.exists():
        old = path.read_text(encoding="utf-8")
        seen = content_hash(old)
        kept, _ = parse_front_matter(old)
        data = data | {k: kept[k] for k in keep if k in kept}
    swap_write(path, render_front_matter(data, body), seen)


def upsert(current: DataFrame | None, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of the same key; the rest stays (K5, K8): an anti-join and a union. The last of repeated new rows by ``seq`` wins if there is such a column."""
    if "seq" in rows.columns:
        others = [c for c in rows.columns if c != key]
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*others), "seq").alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in others))
    return rows if current is None else current.join(rows.select(key), key, "left_anti").unionByName(rows)
