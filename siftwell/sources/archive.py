"""Archives of posts: JSON arrays behind a script assignment."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.fixed_values import ARCHIVE_GLOB, ARCHIVE_SUFFIX
from siftwell.functions.answers import MARK
from siftwell.sources import json_ranges

_NAMES = ("file", "block", "value")
#: Rows and bytes that a task hands on at a time.
_EMIT_ROWS, _EMIT_BYTES = 10_000, 4 << 20
#: Bytes that are joined and searched at a time, or one row.
_SLICE = 1 << 20
_POSTS = "array<array<struct<tweet: struct<id_str: string, id: string, full_text: string>, mark: string>>>"


def _files(spark: SparkSession, path: str, max_file_bytes: int | None) -> None:
    """Checks name, presence and size from the listing alone."""
    listing = spark.read.format("binaryFile")
    if not path.rstrip("/").lower().endswith(ARCHIVE_SUFFIX):
        listing = listing.option("pathGlobFilter", ARCHIVE_GLOB)
    try:
        files = listing.load(path).select("length")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Archive not found: {path}") from e
        raise
    count, largest, least = files.agg(F.count("*"), F.max("length"), F.min("length")).first()
    if not count:
        raise ValueError(f"{path} holds no file with a '{ARCHIVE_SUFFIX}' extension")
    if not least:
        raise ValueError(f"No array of posts begins in an empty file of {path}")
    if max_file_bytes is not None and largest > max_file_bytes:
        raise ValueError(f"{path} holds a file of {largest} bytes; export it in parts of at most {max_file_bytes}")


def _elements(text: Column, schema: str) -> Column:
    """The text and an array with a random mark as the elements of one array; a text can't supply the mark."""
    end = F.lit(f',[{{"mark":"{MARK}"}}]]')
    return F.from_json(F.concat(F.lit("["), text, end), schema, {"allowSingleQuotes": "false"})


def decode_posts(texts: DataFrame) -> DataFrame:
    """Adds posts, null unless found is one valid JSON array of objects.

    A damaged field can come back as null without spoiling the array. So if any
    field that is read here is null, the text is parsed again into maps, which
    take all or nothing. Parses are columns of their own, each is done once.
    """
    mark = lambda name: F.get(F.get(name, F.lit(1)), F.lit(0))["mark"]
    first = lambda name: F.when((F.size(name) == 2) & (mark(name) == MARK), F.get(name, F.lit(0)))
    full = F.forall(
        "posts",
        lambda p: p["tweet"]["id_str"].isNotNull() & p["tweet"]["id"].isNotNull() & p["tweet"]["full_text"].isNotNull(),
    )
    again = F.when(~F.col("full"), _elements(F.col("found"), "array<array<map<string, string>>>"))
    sound = F.col("full") | F.coalesce(F.forall("maps", lambda m: m.isNotNull()), F.lit(False))
    return (
        texts.withColumn("elements", _elements(F.col("found"), _POSTS))
        .withColumn("posts", first("elements"))
        .withColumn("full", F.coalesce(full, F.lit(False)))
        .withColumn("again", again)
        .withColumn("maps", first("again"))
        .withColumn("posts", F.when(sound, F.col("posts")))
        .drop("elements", "full", "again", "maps")
    )


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """The files' bytes, parted at closing braces: file, block, value, in order within a block."""
    reader = spark.read
    if not path.rstrip("/").lower().endswith(ARCHIVE_SUFFIX):
        reader = reader.option("pathGlobFilter", ARCHIVE_GLOB)
    lines = reader.text(path, lineSep="}")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut between rows so that what is worked on at a time stays small however many rows Spark sends at once."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column("value"))), dtype=np.int64) // _SLICE
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def _located(spark: SparkSession, ranges: DataFrame) -> tuple[dict, dict]:
    """States of all ranges and posts per file. One small row per range comes here, as its place did when the scan was planned."""
    schema = "file string, block long, whole string, begun string"
    fields = pa.schema([("file", pa.string()), ("block", pa.int64()), ("whole", pa.string()), ("begun", pa.string())])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, whole, begun in json_ranges.effects(_slices(batches), _NAMES):
            columns = [[file], [block], [json.dumps(whole)], [begun and json.dumps(begun)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    found = [(r["file"], r["block"], json.loads(r["whole"]), r["begun"] and json.loads(r["begun"])) for r in ranges.mapInArrow(tell, schema).collect()]
    return json_ranges.states(found)


def _posts_of(records: DataFrame) -> DataFrame:
    """src_file, pos, post of records, which hold what parts a post from the one before; raises where that or the post is not sound JSON."""
    blank = r"[ \t\n\r]*"
    first = F.regexp_extract("text", rf"(?s)^\[{blank}(\{{.*)$", 1)
    later = F.regexp_extract("text", rf"(?s)^{blank},{blank}(\{{.*)$", 1)
    own = F.when(F.col("closed"), F.when(F.col("pos") == 0, first).otherwise(later)).otherwise("")
    decoded = decode_posts(records.withColumn("own", own).withColumn("found", F.concat(F.lit("["), "own", F.lit("]"))))
    # What follows the last post closes the array, and no later bracket could be taken for its end.
    ends = F.col("text").rlike(rf"(?s)^{blank}\]") & ~F.col("text").rlike(r"(?sU)\}\s*\]")
    sound = (F.col("own") != "") & (F.size("posts") == 1)
    # The error sits in the generator itself: it decides the row count, so no
    # column pruning can take it away.
    wrong = F.raise_error(F.concat(F.lit("Damaged array of posts in "), "src_file")).cast(decoded.schema["posts"].dataType)
    posts = F.when(F.col("closed") & F.coalesce(sound, F.lit(False)), F.col("posts")).when(~F.col("closed") & ends, F.slice("posts", 1, 0)).otherwise(wrong)
    return decoded.select("src_file", "pos", F.explode(posts).alias("post"))


def scan_archive(spark: SparkSession, path: str, max_file_bytes: int | None = None) -> DataFrame:
    """Posts of an archive: src_file, pos, number, id_str, id, item_text.

    path is a ".js" file, a ".js" folder of part files as Spark writes them, or
    a folder or pattern of which the ".js" files are taken. A missing path, a wrong
    name or a file without the start of an array fails at once; one whose array is
    damaged fails the job that reads it. Parsing is strict: nothing may follow the array's end.

    Files are read in ranges of the session's split size, whatever lies at their borders
    (see json_ranges): once to find out how each range begins, then to decode posts in
    parallel, and of files of several ranges once more for posts that two ranges share.
    pos counts the posts of a file, number those of all files in order of their names.
    max_file_bytes refuses larger files beforehand when it is given.
    """
    _files(spark, path, max_file_bytes)
    ranges = _ranges(spark, path)
    known, posts = _located(spark, ranges)
    for file, n in sorted(posts.items()):
        if n is None:
            raise ValueError(f"No array of posts begins in {file}")
    shared = spark.sparkContext.broadcast(known)
    schema = "src_file string, pos long, block long, piece binary, closed boolean, whole boolean"
    fields = pa.schema([("src_file", pa.string()), ("pos", pa.int64()), ("block", pa.int64()), ("piece", pa.binary()), ("closed", pa.bool_()), ("whole", pa.bool_())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), fields, strict=True)], schema=fields)

        for row in json_ranges.pieces(_slices(batches), _NAMES, shared.value):
            held.append(row)
            size += len(row[3])
            if size > _EMIT_BYTES or len(held) == _EMIT_ROWS:
                yield emit()
                held, size = [], 0
        if held:
            yield emit()

    every = ranges.mapInArrow(cut, schema)
    records = every.filter("whole").select("src_file", "pos", F.col("piece").cast("string").alias("text"), "closed")
    if any(block > 0 for _, block in known):
        parts = every.filter("not whole").groupBy("src_file", "pos")
        joined = parts.agg(F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("parts"), F.bool_or("closed").alias("closed"))
        piece = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["piece"]))
        records = records.unionByName(joined.select("src_file", "pos", piece.cast("string").alias("text"), "closed"))
    starts, n = [], 0
    for file in sorted(posts):
        starts.append((file, n))
        n += posts[file]
    offsets = spark.createDataFrame(starts, "name string, before long")
    found = _posts_of(records).join(offsets, F.col("src_file") == F.col("name"))
    return found.select("src_file", F.col("pos").cast("int").alias("pos"), (F.col("before") + F.col("pos")).alias("number"), "post.tweet.id_str", "post.tweet.id", F.col("post.tweet.full_text").alias("item_text"))


def import_archive(spark: SparkSession, path: str, dest: str) -> DataFrame:
    """Decodes an archive once into Parquet, which everything else reads.

    Raises ValueError when a file holds no valid array.
    """
    try:
        scan_archive(spark, path).write.mode("overwrite").parquet(dest)
    except (ValueError, FileNotFoundError):
        raise
    except Exception as e:
        if "USER_RAISED_EXCEPTION" in str(e):
            raise ValueError(f"Archive {path} cannot be decoded: {e}") from e
        raise
    return spark.read.parquet(dest)
