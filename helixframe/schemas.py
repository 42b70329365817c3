"""Schemas of the file formats. Files carry no types of their own, so readers state them."""

from pyspark.sql import types as T


def _s(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols])


STRING, LONG, DOUBLE = T.StringType(), T.LongType(), T.DoubleType()

RECORD = _s(("ord", LONG), ("record_id", STRING), ("description", STRING), ("seq", STRING))
SEQUENCE_TSV = _s(("record_id", STRING), ("seq", STRING))
SATC = _s(("sample", STRING), ("anchor", STRING), ("target", STRING), ("count", LONG))
CLUSTERS = _s(("cluster_id", LONG), ("anchor", STRING))
LOOKUP = _s(("query", STRING), ("stats", STRING))
ORDERING = _s(("sample_name", STRING), ("seq", STRING), ("kmer", STRING), ("start", LONG), ("end", LONG))
BED = _s(("sample_name", STRING), ("start", LONG), ("stop", LONG))
METADATA_PAIR = _s(("sample_name", STRING), ("metadata", STRING))
