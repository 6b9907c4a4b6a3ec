"""Spark readers of library files, audio files and JSON stores."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUE = "struct<t:double,kind:string,num:int,name:string,color:string,end:double>"
TRACK = f"id string, path string, title string, artist string, album string, genre string, label string, comment string, year string, grouping string, duration double, bpm double, key string, rating double, plays double, added string, size double, cues array<{CUE}>, grid struct<bpm:double,beat0:double,bar:int>"
LIST = "id string, kind string, name string, parent string, items array<string>, ord int"
FILE = f"file string, app string, tracks array<struct<{TRACK.replace(' ', ':').replace(',:', ',')}>>, lists array<struct<{LIST.replace(' ', ':').replace(',:', ',')}>>, error string"
_CUE = pa.list_(pa.struct([("t", pa.float64()), ("kind", pa.string()), ("num", pa.int32()), ("name", pa.string()), ("color", pa.string()), ("end", pa.float64())]))
_GRID = pa.struct([("bpm", pa.float64()), ("beat0", pa.float64()), ("bar", pa.int32())])
_TEXT = ["id", "path", "title", "artist", "album", "genre", "label", "comment", "year", "grouping"]
_TRACK = pa.struct([*((c, pa.string()) for c in _TEXT), ("duration", pa.float64()), ("bpm", pa.float64()), ("key", pa.string()), ("rating", pa.float64()), ("plays", pa.float64()), ("added", pa.string()), ("size", pa.float64()), ("cues", _CUE), ("grid", _GRID)])
_LIST = pa.struct([("id", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("parent", pa.string()), ("items", pa.list_(pa.string())), ("ord", pa.int32())])
_FILE = pa.schema([("file", pa.string()), ("app", pa.string()), ("tracks", pa.list_(_TRACK)), ("lists", pa.list_(_LIST)), ("error", pa.string())])
AUDIO = ["wav", "wave", "aif", "aiff", "aifc", "flac", "mp3", "m4a", "mp4", "aac", "ogg", "oga", "opus", "webm"]


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """All files under a path: path, modificationTime, length, content. What isn't selected isn't read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def libraries(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: file, app, tracks, lists, error. Files that can't be read keep their reason."""
    from catalune.sources.importers import rows_of

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist(list(rows_of(zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True))), schema=_FILE)

    return files(spark, path).select("path", "content").mapInArrow(run, FILE)


def imported_tracks(libs: DataFrame) -> DataFrame:
    return libs.select("file", "app", F.posexplode("tracks").alias("ord", "t")).select("file", "app", "ord", "t.*")


def imported_lists(libs: DataFrame) -> DataFrame:
    return libs.select("file", "app", F.explode("lists").alias("l")).select("file", "app", "l.*")


def combined(libs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of all databases resolved together, and counts a file: entries, matched, of other libraries, gone."""
    tracks = imported_tracks(libs).select("id").distinct()
    known = tracks.select(F.substring_index("id", "/", 1).alias("lib")).distinct()
    e = imported_lists(libs).select("file", F.col("id").alias("list"), F.posexplode("items").alias("pos", "item"))
    e = e.join(tracks.select(F.col("id").alias("item"), F.lit(True).alias("there")), "item", "left").join(known.withColumnRenamed("lib", "__l"), F.substring_index("item", "/", 1) == F.col("__l"), "left")
    e = e.withColumns({"matched": F.coalesce("there", F.lit(False)), "own": F.col("__l").isNotNull()})
    counts = e.groupBy("file").agg(F.count("*").alias("entries"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched") & ~F.col("own")).alias("other"), F.count_if(~F.col("matched") & F.col("own")).alias("gone"))
    return e.where("matched").select("file", "list", "pos", "item"), counts


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Audio files under a root: rel_path, file_name, size, mtime; contents aren't read."""
    f = files(spark, root).select("path", "length", "modificationTime")
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    name = F.substring_index("path", "/", -1)
    return f.where(kind.isin(AUDIO) & ~F.startswith(name, F.lit("."))).select("path", name.alias("file_name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def audio_headers(spark: SparkSession, root: str) -> DataFrame:
    """path and what its header says: container, codec, rate, bits, channels, seconds, tags, clues."""
    from catalune.sources.audio import clues, header

    schema = pa.schema([("path", pa.string()), ("container", pa.string()), ("codec", pa.string()), ("rate", pa.int32()), ("bits", pa.int32()), ("channels", pa.int32()), ("seconds", pa.float64()), ("tags", pa.map_(pa.string(), pa.string())), ("clues", pa.list_(pa.struct([(k, pa.string()) for k in ("kind", "label", "match")])))])

    def run(batches):
        for b in batches:
            out = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                h = header(bytes(data))
                out.append({"path": path} | h | {"tags": list(h["tags"].items()), "clues": clues(bytes(data), h)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files(spark, root).select("path", "content").mapInArrow(run, "path string, container string, codec string, rate int, bits int, channels int, seconds double, tags map<string,string>, clues array<struct<kind:string,label:string,match:string>>")


def load_shards(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of JSON shards ({id: record} a file), and the files that couldn't be read, which are set aside."""
    text = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path).select(F.input_file_name().alias("file"), F.col("value"))
    parsed = text.withColumn("m", F.from_json("value", f"map<string,struct<{schema}>>"))
    good = parsed.where("m is not null").select("file", F.explode("m").alias("id", "r")).select("id", "r.*")
    return good, parsed.where("m is null").select("file", "value")


def flush(df: DataFrame, path: str, id_col: str = "id") -> None:
    """Writes only the shards (the id's first two characters) that df holds; others stay as they are."""
    df.withColumn("shard", F.substring(id_col, 1, 2)).repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def snapshots_kept(names: list[str], keep: int = 14) -> list[str]:
    """Of dated snapshot names the newest; of each day the last."""
    last = {n[:10]: n for n in sorted(names)}
    return sorted(last.values())[-keep:]


def backup(spark: SparkSession, root: str, target: str) -> DataFrame:
    """Copies all files under a root to ``target``, read and written file by file on executors, and then a manifest:
    path, length, digest. A backup without manifest isn't whole. Returns the manifest."""
    from catalune.operators.graphs import kept

    base = root.rstrip("/")
    rel = F.regexp_replace("path", r"^.*?" + re.escape(base.split("://")[-1].lstrip("/")) + "/", "")
    rows = files(spark, root).select(rel.alias("path"), "length", F.sha2("content", 256).alias("digest"), "content")
    rows.write.mode("errorifexists").parquet(f"{target}/files")
    manifest = kept(spark.read.parquet(f"{target}/files").select("path", "length", "digest"))
    manifest.write.parquet(f"{target}/manifest")
    return manifest


def restored(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """(files that are as the manifest says, paths that are missing or damaged) of a backup."""
    have = spark.read.parquet(f"{target}/files").withColumn("now", F.sha2("content", 256))
    said = spark.read.parquet(f"{target}/manifest")
    good = have.join(said, ["path", "digest"], "left_semi").where("now = digest").select("path", "content")
    return good, said.join(good.select("path"), "path", "left_anti").select("path")


def write_whole(path: str, data: bytes) -> None:
    """Writes a small file beside its place and moves it there, so that a reader sees the old or the new one, whole."""
    import uuid

    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    tmp = f"{at}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(tmp) as out:
        out.write(data)
    system.move(tmp, at)
