"""Explicit schemas of the corpus inputs."""

from pyspark.sql import types as T

META = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("from", T.StringType()),
    T.StructField("to", T.ArrayType(T.StringType())),
    T.StructField("subject", T.StringType()),
])

VOCAB = T.StructType([
    T.StructField("word_id", T.LongType()),
    T.StructField("word", T.StringType()),
    T.StructField("count", T.LongType()),
])
