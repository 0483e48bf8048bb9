"""Column layout of every table the library reads or writes."""

from pyspark.sql import types as T

EDGES = T.StructType(
    [
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
    ]
)

PAGE_RANK = T.StructType(
    [
        T.StructField("account_id", T.LongType()),
        T.StructField("page_rank", T.DoubleType()),
    ]
)

WEB_LOG = T.StructType(
    [
        T.StructField("account_id", T.LongType()),
        T.StructField("ip", T.IntegerType()),
        T.StructField("ts", T.LongType()),
    ]
)

DEGREES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("followers", T.LongType()),
        T.StructField("pursuers", T.LongType()),
    ]
)

CENTROIDS = T.StructType(
    [
        T.StructField("cid", T.IntegerType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)
