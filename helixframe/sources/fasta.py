"""FASTA and FASTQ files: :func:`read_fasta` and :func:`read_fastq` on any file system, and a data
source, ``spark.read.format("fasta").load(path)``, for local files that those don't cover.

``read_fasta`` takes records apart by Spark's text reader, so that a large file is read by many
tasks and globs, folders and object stores work; ``read_fastq`` does so for records of four lines.
The data source reads FASTQ of broken lines and gzip without the name for it: one input partition
a file; gzip is recognised by its content. Option ``format`` is ``fasta`` or
``fastq``, else decided by the first byte. ``ord`` numbers records inside a file; the file's
place in the sorted list of paths stands in the high bits, so that ``ord`` is unique and ordered.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from helixframe.runtime import growing

FILE_BITS = 40


def read_records(path: str) -> Iterator[tuple[str, str, str]]:
    """(id, description, sequence) of a file; blank lines are skipped, ``\\r`` is taken off."""
    with open(path, "rb") as f:
        packed = f.read(2) == b"\x1f\x8b"
    with (gzip.open if packed else open)(path, "rt", encoding="utf-8") as f:
        head, parts, fastq = None, [], False
        lines = (x.rstrip("\r\n") for x in f)
        for line in lines:
            if head is None and not line:
                continue
            if line.startswith("@") and (head is None or fastq):
                if head is not None:
                    yield (*head, "".join(parts))
                fastq, head, parts = True, _head(line), []
                for body in lines:
                    if body.startswith("+"):
                        break
                    parts.append(body)
                need = sum(map(len, parts))
                while need > 0 and (quality := next(lines, None)) is not None:
                    need -= len(quality)
            elif line.startswith(">"):
                if head is not None:
                    yield (*head, "".join(parts))
                head, parts = _head(line), []
            elif head is not None:
                parts.append(line.strip())
        if head is not None:
            yield (*head, "".join(parts))


def _head(line: str) -> tuple[str, str]:
    text = line[1:].strip()
    return (text.split(None, 1) or [""])[0], text


class _File(InputPartition):
    def __init__(self, number: int, path: str) -> None:
        self.number, self.path = number, path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        p = Path(path.removeprefix("file://"))
        self.files = sorted(str(x) for x in p.iterdir() if not x.name.startswith(("_", "."))) if p.is_dir() else [str(p)]

    def partitions(self) -> list[_File]:
        return [_File(i, f) for i, f in enumerate(self.files)]

    def read(self, partition: _File):
        for i, (name, description, seq) in enumerate(read_records(partition.path)):
            yield (partition.number << FILE_BITS) + i, name, description, seq


class FastaDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "ord long, record_id string, description string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class FastqDataSource(FastaDataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaDataSource)
    spark.dataSource.register(FastqDataSource)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, record_id, description, seq)``; ``ord`` numbers records by path and place.

    Blank lines and blanks inside sequences are taken out, a record without letters has the empty
    sequence, and text before the first ``>`` of a file counts as a record. Files ending in
    ``.gz`` are unpacked, each by one task."""
    from helixframe.sources.tables import numbered, placed

    d = placed(spark.read.option("lineSep", "\n>").text(path)).where("trim(value) <> ''")
    text = F.regexp_replace("value", "^\\s*>|\r", "")
    head = F.trim(F.substring_index(text, "\n", 1))
    body = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(F.expr("substring(value, locate('\n', value))"), r"\s", "")).otherwise("")
    d = d.withColumn("record_id", F.split(head, r"\s")[0]).withColumn("description", head).withColumn("seq", body).drop("value")
    return numbered(d).select("ord", "record_id", "description", "seq")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, record_id, description, seq, quality)`` of files whose records have four lines each;
    a file with an odd number of lines is an error of its last record only."""
    from helixframe.sources.tables import numbered, placed

    d = numbered(placed(spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), "_metadata")).withColumn("name", F.col("_file")))
    first = d.groupBy("name").agg(F.min("ord").alias("first"))
    d = d.join(growing(first), "name").withColumn("line", F.col("ord") - F.col("first"))
    four = [F.max(F.when(F.col("line") % 4 == i, F.col("value"))).alias(f"l{i}") for i in range(4)]
    d = d.groupBy("name", F.expr("line div 4").alias("n")).agg(F.min("ord").alias("ord"), *four).where("l1 is not null")
    head = F.trim(F.substring(F.col("l0"), 2, 1 << 30))
    return d.select(F.expr("ord").alias("ord"), F.split(head, r"\s")[0].alias("record_id"), head.alias("description"), F.trim("l1").alias("seq"), F.col("l3").alias("quality"))


def fasta_lines(record_id: Column, seq: Column, wrap: int | None = None) -> Column:
    """Text of a record, the sequence in lines of ``wrap`` letters or in one."""
    body = seq if not wrap else F.regexp_replace(seq, f"(.{{{wrap}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), record_id, F.lit("\n"), F.coalesce(body, F.lit("")))


def write_fasta(df: DataFrame, path: str, wrap: int | None = None) -> None:
    """Writes ``(record_id, seq)``; each task writes its own file."""
    df.select(fasta_lines(F.col("record_id"), F.col("seq"), wrap).alias("value")).write.text(path)
