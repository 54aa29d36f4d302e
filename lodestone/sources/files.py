"""Lines with their numbers, JSON lines, hash lists, token files, gzip members and file hashes.

Paths must be reachable from all executors. A write is repeatable: each task
writes a file of its own name under a temporary one and renames it, so a task
that runs twice leaves one file.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

HEX = "^[0-9a-fA-F]{64}$"



def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    path = path.replace("file:///", "/") if path.startswith("file:///") else path[5:] if path.startswith("file:/") else path
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def write_bytes(path: str, data: bytes) -> None:
    """Write a file so that readers see the old one or the whole new one."""
    fs, at = _file_system(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, at)


def canonical_json(value) -> str:
    """JSON with sorted keys and no spaces, other letters than ASCII kept."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def self_hash(body: dict, field: str) -> str:
    """SHA-256 of a record without its own hash field."""
    return hashlib.sha256(canonical_json({k: v for k, v in body.items() if k != field}).encode()).hexdigest()


def write_json(path: str, value) -> None:
    write_bytes(path, (canonical_json(value) + "\n").encode())


def lines(spark: SparkSession, path: str, start_line: int = 1) -> DataFrame:
    """(file, line, value) of text files, plain or gzip (of several members too), from a line on (the first is 1).

    A line's number is its place within its part of the file, plus the lines of
    the parts before, so files of any size are read in parallel.
    """
    x = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("at"))
    first = x.groupBy("file", "block").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    before = first.select("file", "block", "first", (F.sum("c").over(Window.partitionBy("file").orderBy("block")) - F.col("c")).alias("before"))
    # Within a part ids are consecutive.
    out = x.join(F.broadcast(before), ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")
    return out.filter(F.col("line") >= start_line)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False, start_line: int = 1) -> DataFrame:
    """(file, line, record) of JSON lines; blank lines are skipped.

    A line that isn't an object of the schema gives a null record, or with
    strict an error that names the file and the line.
    """
    x = lines(spark, path, start_line).filter("trim(value) <> ''")
    raw = F.from_json("value", schema)
    ok = F.expr("try_parse_json(value) is not null and schema_of_variant(try_parse_json(value)) like 'OBJECT%'")
    record = F.when(ok, raw)
    if strict:
        record = F.when(ok, raw).otherwise(F.raise_error(F.concat(F.lit("malformed JSON in "), "file", F.lit(" line "), F.col("line").cast("string"))))
    return x.select("file", "line", record.alias("record"))


def write_run(df: DataFrame, path: str, run: str) -> None:
    """JSON lines of one run, in a folder of its own that is replaced if the run is repeated: rows are there once."""
    df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/run={run}")


def hash_list(spark: SparkSession, text: list[str] = (), jsonl: list[str] = (), sqlite: list[str] = (), field: str = "sha256") -> DataFrame:
    """(sha256): the different valid hashes, in lower case, of text, JSON line and SQLite files.

    In an SQLite file the first column of a table that holds a hash counts.
    """
    parts = [spark.read.text(list(text)).select(F.trim("value").alias("h"))] if text else []
    parts += [spark.read.text(list(jsonl)).select(F.get_json_object("value", f"$.{field}").alias("h"))] if jsonl else []
    if sqlite:
        def scan(batches):
            import re
            import sqlite3

            for b in batches:
                out = []
                for path in b.column(0).to_pylist():
                    fs, at = _file_system(path)
                    c = sqlite3.connect(":memory:")
                    with fs.open_input_stream(at) as f:
                        c.deserialize(f.read())
                    for (table,) in c.execute("select name from sqlite_master where type = 'table'").fetchall():
                        for column in [r[1] for r in c.execute(f'pragma table_info("{table}")')]:
                            one = c.execute(f'select "{column}" from "{table}" where "{column}" is not null limit 1').fetchone()
                            if one and re.match(HEX, str(one[0])):
                                out += [str(r[0]) for r in c.execute(f'select "{column}" from "{table}"')]
                                break
                    c.close()
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["h"])

        parts.append(spark.createDataFrame([(p,) for p in sqlite], "path string").repartition(len(sqlite)).mapInArrow(scan, "h string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("h").rlike(HEX)).select(F.lower("h").alias("sha256")).distinct()


def _write_parts(df: DataFrame, path: str, suffix: str, of_batch) -> DataFrame:
    """(part, n, bytes, sha256) of the files that df's partitions make, one each."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        data, n = [], 0
        for b in batches:
            raw, k = of_batch(b)
            data.append(raw), (n := n + k)
        whole = b"".join(data)
        if whole:
            write_bytes(f"{path}/part-{part:05d}.{suffix}", whole)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([len(whole)], pa.int64()), pa.array([hashlib.sha256(whole).hexdigest()])], ["part", "n", "bytes", "sha256"])

    return df.mapInArrow(run, "part int, n long, bytes long, sha256 string")


def write_tokens(df: DataFrame, tokens: str, path: str, dtype: str = "<u2") -> DataFrame:
    """Token ids of an array column as a flat binary file for each partition, in the partition's order; partitions must fit into memory."""

    def raw(b):
        flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
        if len(flat) and (flat.min() < 0 or flat.max() > np.iinfo(np.dtype(dtype)).max):
            raise ValueError("a token id does not fit the file's type")
        return flat.astype(dtype).tobytes(), len(flat)

    return _write_parts(df.select(tokens), path, "bin", raw)


def read_tokens(spark: SparkSession, path: str, dtype: str = "<u2", step: int = 1 << 20) -> DataFrame:
    """(file, at, tokens): token files in runs of ``step`` ids; only sizes are looked at first, so large files are read in parallel."""
    fs, at = _file_system(path)
    width = np.dtype(dtype).itemsize
    files = [f for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".bin")]
    rows = [(f.path, s) for f in files for s in range(0, f.size // width, step)]
    scheme = "" if path.startswith(("/", "file:")) else path.split("://")[0] + "://"

    def load(batches):
        for b in batches:
            out = []
            for name, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own, p = _file_system(scheme + name)
                with own.open_input_file(p) as f:
                    f.seek(s * width)
                    out.append(np.frombuffer(f.read(step * width), dtype).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], ["file", "at", "tokens"])

    return spark.createDataFrame(rows, "file string, at long").repartition(max(1, min(len(rows), 10_000))).mapInArrow(load, "file string, at long, tokens array<int>")


def write_gzip_members(df: DataFrame, column: str, path: str) -> DataFrame:
    """Text lines as gzip files of one member for each Arrow batch, without time stamps: the same rows give the same bytes."""

    def raw(b):
        rows = [x for x in b.column(0).to_pylist() if x is not None]
        return gzip.compress("".join(x + "\n" for x in rows).encode(), mtime=0), len(rows)

    return _write_parts(df.select(column), path, "gz", raw)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of all files of a folder and those below, each read in chunks by one task."""
    fs, at = _file_system(path)
    files = [(f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.is_file]
    scheme = "" if path.startswith(("/", "file:")) else path.split("://")[0] + "://"

    def digest(pdfs):
        for pdf in pdfs:
            out = []
            for name in pdf["file"]:
                own, p = _file_system(scheme + name)
                h = hashlib.sha256()
                with own.open_input_stream(p) as f:
                    while chunk := f.read(1 << 23):
                        h.update(chunk)
                out.append(h.hexdigest())
            yield pd.DataFrame({"file": pdf["file"], "bytes": pdf["bytes"], "sha256": out})

    return spark.createDataFrame(files, "file string, bytes long").repartition(max(1, min(len(files), 10_000))).mapInPandas(digest, "file string, bytes long, sha256 string")
