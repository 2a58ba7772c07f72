"""Column layouts of the tables that an audit keeps."""

from pyspark.sql import types as T

ORD = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("row", T.LongType()),
    ]
)

# One row per answer line: a verdict where fail_reason is null, else a failure.
ANSWER_FIELDS = [
    T.StructField("item_id", T.StringType()),
    T.StructField("item_url", T.StringType()),
    T.StructField("explicit_words", T.ArrayType(T.StringType())),
    T.StructField("reason", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StringType())),
    T.StructField("deletion", T.StringType()),
    T.StructField("extras", T.MapType(T.StringType(), T.StringType())),
    T.StructField("raw", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("fail_reason", T.StringType()),
    T.StructField("line", T.StringType()),
    T.StructField("chunk_id", T.IntegerType()),
    T.StructField("criteria_hash", T.StringType()),
    T.StructField("ord", ORD),
]
ANSWERS = T.StructType(ANSWER_FIELDS)

# The answer log adds the join key, the run that wrote the row, the run that decided it
# (another one in a compaction) and the time it did; batch and outcome are folder levels.
LOG = T.StructType(
    ANSWER_FIELDS
    + [
        T.StructField("store_key", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("written_at", T.TimestampType()),
        T.StructField("batch", T.StringType()),
        T.StructField("outcome", T.StringType()),
    ]
)

VERDICT_COLUMNS = [
    "item_id",
    "item_url",
    "explicit_words",
    "reason",
    "topics",
    "deletion",
    "extras",
    "raw",
    "chunk_id",
    "criteria_hash",
    "ord",
]
FAILURE_COLUMNS = ["item_id", "stage", "fail_reason", "line", "chunk_id", "ord"]

# What happened to the log, one row per event. batch is the folder an event adds;
# drops names those it takes away, runs those whose rows a compaction holds.
COMMITS = T.StructType(
    [
        T.StructField("at", T.LongType()),
        T.StructField("commit", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("batch", T.StringType()),
        T.StructField("drops", T.ArrayType(T.StringType())),
        T.StructField("runs", T.ArrayType(T.StringType())),
    ]
)

SCORED = "chunk_id int, key string, line string, submit_error string"
# Rows of an answer ledger, see sources/ledger.py.
LEDGER = "kind string, request binary, chunk_id int, key string, line string, submit_error string, attempt int, again boolean, due double"
