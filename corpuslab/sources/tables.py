"""Sources and sinks: line formats, key-value files, shards, archives, resumable plans."""

from __future__ import annotations

import hashlib
import io
import tarfile
import uuid
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import numbered


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines, plain or gzip, with the file of each row.

    A line that does not fit the schema is an error; without ``strict`` it is
    kept under ``_bad`` with null fields.  Blank lines are skipped.
    """
    reader = spark.read
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").json(path).withColumn("_file", F.col("_metadata.file_path"))
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    return reader.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("_file", F.col("_metadata.file_path"))


def dimension(spark: SparkSession, path: str, schema: str, key: str, label: str) -> DataFrame:
    """One row per key out of JSON catalogs; two labels for a key are an error."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    checked = F.when(F.count_distinct(label) > 1, F.raise_error(F.concat(F.lit("conflicting labels for "), F.first(key).cast("string"))).cast("string")).otherwise(F.first(label))
    return rows.groupBy(key).agg(checked.alias(label))


def word_track(text, keep_blank: bool = False, strip: bool = True, strict: bool = False):
    """array<struct<start,end,text>> of a tab-separated track in a string; bad lines are skipped.

    ``strict`` makes a line whose times are no numbers an error instead.
    """
    rows = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.split(x, "\t", 3)), lambda p: F.size(p) == 3)
    time = lambda x: x.cast("double") if strict else x.try_cast("double")
    parsed = F.transform(rows, lambda p: F.struct(time(p[0]).alias("start"), time(p[1]).alias("end"), (F.trim(p[2]) if strip else p[2]).alias("text")))
    return F.filter(parsed, lambda r: r["start"].isNotNull() & r["end"].isNotNull() & (F.lit(keep_blank) | (F.trim(r["text"]) != "")))


def read_key_values(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(key, value) of lines ``key value``; a repeated key is an error, or, if lenient, its last line counts.

    A missing value is an empty string.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n")).filter(F.trim("value") != "")
    parts = F.split("value", r"\s+", 2)
    rows = lines.select(parts[0].alias("key"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("value"), "n")
    if not strict:
        return rows.groupBy("key").agg(F.max_by("value", "n").alias("value"))
    once = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("key given twice: "), F.first("key"))).cast("string")).otherwise(F.first("value"))
    return rows.groupBy("key").agg(once.alias("value"))


def write_key_values(df: DataFrame, key: str, columns: dict[str, str], folder: str) -> None:
    """One text file set per map name, lines ``key value`` sorted by key; spk2utt-like inverses too."""
    for name, column in columns.items():
        df.select(F.concat_ws(" ", F.col(key), F.col(column).cast("string")).alias("value")).repartitionByRange(1, "value").sortWithinPartitions("value").write.mode("overwrite").text(f"{folder}/{name}")


def inverse_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """(value, keys): the keys of each value, in order."""
    return df.groupBy(value).agg(F.array_join(F.sort_array(F.collect_list(key)), " ").alias("keys"))


def refreshed_cache(cached: DataFrame, current: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows still wanted, keys still to compute) of a keyed cache."""
    return cached.join(current.select(key), key, "left_semi"), current.select(key).join(cached.select(key), key, "left_anti")


def write_sorted_jsonl(df: DataFrame, key: str, path: str) -> None:
    """JSON lines in the order of a key over all files; the commit protocol makes the write atomic."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, key).sortWithinPartitions(key).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, schema: T.StructType, path: str) -> None:
    """Parquet with a fixed schema; a missing column is an error, types are cast."""
    df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)).write.mode("overwrite").parquet(path)


def parent_shards(df: DataFrame, parent: str, per_shard: int) -> DataFrame:
    """Shard numbers so that all rows of a parent share one, with ``per_shard`` parents each."""
    parents = numbered(df.select(parent).distinct(), F.col(parent), "shard").withColumn("shard", F.floor(F.col("shard") / per_shard))
    return df.join(parents, parent)


def round_robin(df: DataFrame, order: str, shards: int, first: int = 0, first_rows: DataFrame | None = None) -> DataFrame:
    """Rows dealt to shards in turn; ``first_rows`` (of the same schema) all go to shard ``first``."""
    dealt = numbered(df, F.col(order), "shard").withColumn("shard", (F.col("shard") % shards).cast("int"))
    return dealt if first_rows is None else dealt.unionByName(first_rows.withColumn("shard", F.lit(first)))


def still_to_do(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a plan without a finished result: what a resumed run has to do."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; more rows than ``limit`` are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for a report")
    cells = [df.columns, ["---"] * len(df.columns), *([("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(c) + " |" for c in cells)


def latex(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a LaTeX table; more rows than ``limit`` are refused."""
    rows = [r[2:-2].split(" | ") for r in markdown(df, limit).split("\n")]
    escaped = [[c.translate({ord(x): "\\" + x for x in "&%$#_{}"}) for c in r] for r in [rows[0], *rows[2:]]]
    body = [" & ".join(r) + r" \\" for r in escaped]
    return "\n".join([r"\begin{tabular}{" + "l" * len(rows[0]) + "}", r"\toprule", body[0], r"\midrule", *body[1:], r"\bottomrule", r"\end{tabular}"])


def write_tar_shards(df: DataFrame, member: str, content: str, folder: str, shard_bytes: int = 1 << 26) -> DataFrame:
    """Write rows as members of tar shards of about ``shard_bytes``; returns (member, shard, size, sha256).

    Shards of an attempt that did not end well are in no returned row.
    """

    def pack(frames):
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        stem = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        held, size, shard = [], 0, 0

        def close():
            name = f"{stem}-{shard:05d}.tar"
            with store.open_output_stream(f"{path}/{name}", compression=None) as sink, tarfile.open(fileobj=sink, mode="w|") as tar:
                for own, data in held:
                    info = tarfile.TarInfo(own)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
            return pd.DataFrame([(own, f"{folder}/{name}", len(data), hashlib.sha256(data).hexdigest()) for own, data in held], columns=["member", "shard", "size", "sha256"])

        for frame in frames:
            for own, data in zip(frame["member"], frame["content"]):
                if held and size + len(data) > shard_bytes:
                    yield close()
                    held, size, shard = [], 0, shard + 1
                held.append((own, bytes(data)))
                size += len(data)
        if held:
            yield close()

    rows = df.select(F.col(member).alias("member"), F.col(content).cast("binary").alias("content"))
    return rows.mapInPandas(pack, "member string, shard string, size long, sha256 string")


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """(shard, member, size, content, sha256) of the members of tar shards, one task per shard."""

    def unpack(frames):
        for frame in frames:
            for shard, content in zip(frame["path"], frame["content"]):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile():
                            rows.append((shard, m.name, m.size, tar.extractfile(m).read()))
                yield pd.DataFrame(rows, columns=["shard", "member", "size", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, "shard string, member string, size long, content binary").withColumn("sha256", F.sha2("content", 256))


def unverified(members: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected members (member, sha256) that are missing or differ."""
    e = expected.select("member", F.col("sha256").alias("wanted"))
    return e.join(members.select("member", "sha256"), "member", "left").filter(~F.col("wanted").eqNullSafe(F.col("sha256")))


def listing_hash(spark: SparkSession, path: str) -> str:
    """A hash of names, sizes and times of files: equal before and after a read that nothing disturbed."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return rows.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string")))), "\n"), 256)).first()[0]


def stable(spark: SparkSession, path: str, action):
    """The result of ``action()`` over files; files that change meanwhile are an error."""
    before = listing_hash(spark, path)
    out = action()
    if listing_hash(spark, path) != before:
        raise RuntimeError(f"{path} changed while it was read")
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
