"""Schemas of the intermediate tables."""

from pyspark.sql import types as T

METADATA = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
#: What a pickle stream holds. One of very many imports has several parts, the last of them with ``last``; ``first`` numbers a part's
#: first import.
STREAM = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("has_reduce", T.BooleanType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("stop_offset", T.LongType()),
        T.StructField("opcodes", T.ArrayType(T.IntegerType())),
        T.StructField("entropy_offset", T.LongType()),
        T.StructField("entropy", T.DoubleType()),
        T.StructField("first", T.LongType()),
        T.StructField("imports", T.ArrayType(T.StructType([T.StructField("module", T.StringType()), T.StructField("name", T.StringType()), T.StructField("offset", T.LongType())]))),
        T.StructField("last", T.BooleanType()),
    ]
)
STREAMS = T.StructType([T.StructField("path", T.StringType()), *STREAM])
HIT = T.StructType([T.StructField("rule", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("hit", T.StringType())])
#: Rows of a file: one with ``head``, which has its figures, or one with an error; more where there is much metadata, many imports or raw
#: bytes with credentials. ``first`` numbers a row's first pair of metadata.
DECODED = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("head", T.BooleanType()),
        T.StructField("format", T.StringType()),
        T.StructField("tensor_count", T.DecimalType(20, 0)),
        T.StructField("n_kv", T.LongType()),
        T.StructField("first", T.IntegerType()),
        T.StructField("metadata", METADATA),
        T.StructField("streams", T.ArrayType(STREAM)),
        T.StructField("hits", T.ArrayType(HIT)),
        T.StructField("error", T.StringType()),
    ]
)
#: Bytes of a pickle stream from ``offset`` on.
PIECES = T.StructType([T.StructField("path", T.StringType()), T.StructField("ord", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("bytes", T.BinaryType())])
#: Bytes from ``offset`` on; of what is found in them, what begins at ``begin`` or later and before ``end`` counts.
CHUNKS = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("bytes", T.BinaryType())]
)
LOCATION = T.StructType([T.StructField("component", T.StringType()), T.StructField("offset", T.LongType())])
FINDINGS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("scanner", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("sev_ord", T.ByteType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("title", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("location", LOCATION),
        T.StructField("references", T.ArrayType(T.StringType())),
        T.StructField("remediation", T.StringType()),
        T.StructField("evidence", T.StringType()),
    ]
)
