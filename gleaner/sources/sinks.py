"""Sinks: envelopes, their pages, and tables of events."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schema
from gleaner.functions.text import stem
from gleaner.sources.staging import staged

#: Folders that clips are dealt out to.
PARTS = 64

#: Fixed value: where a page's data goes.
BAKED = "window.__BAKED__ = "


def envelope_json(envelopes: DataFrame) -> DataFrame:
    """clip_id, name and the envelope as one JSON text."""
    fields = [c for c in envelopes.columns if c != "clip_id"]
    return envelopes.select("clip_id", stem(F.col("source")).alias("name"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def _parted(df: DataFrame, parts: int) -> DataFrame:
    """Rows dealt out by a hash of their clip; a part is a folder, so that many clips are few files."""
    return df.withColumn("part", F.pmod(F.xxhash64("clip_id"), F.lit(parts)).cast("int"))


def write_envelopes(envelopes: DataFrame, path: str, parts: int = PARTS) -> None:
    """Envelopes as JSON lines; those of clips written again are replaced, others of their part are kept."""
    _replace(envelopes, path, parts, "json", schema.ENVELOPE)


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """What write_envelopes wrote, with clip_id."""
    return spark.read.schema(f"clip_id string, {schema.ENVELOPE}, part int").json(path).drop("part")


def _replace(rows: DataFrame, path: str, parts: int, kind: str, kept: str) -> None:
    """Writes the parts that the rows fall into anew: what was there of other clips, and the rows."""
    spark = rows.sparkSession
    new = _parted(rows, parts)
    try:
        there = spark.read.schema(f"clip_id string, {kept}, part int").format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        touched = new.select("part").distinct()
        old = there.join(F.broadcast(touched), "part", "left_semi").join(new.select("clip_id").distinct(), "clip_id", "left_anti")  # touched: parts at most
        new = staged(old.select("clip_id", *[c for c in old.columns if c not in ("clip_id", "part")], "part").unionByName(new, allowMissingColumns=True))  # as what is read is written over
    # a clip's rows stay together and in order; a large part is as many files as Spark makes of it
    order = [c for c in ("t", "dir", "seq") if c in new.columns]
    dealt = new.repartitionByRange("part", "clip_id", *order).sortWithinPartitions("part", "clip_id", *order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("part").format(kind).save(path)


def page(template: Column, json: Column) -> Column:
    """The template with the data before the end of its body, closing tags in it escaped."""
    safe = F.replace(json, F.lit("</"), F.lit("<\\/"))
    script = F.concat(F.lit("<script>\n" + BAKED), safe, F.lit(";\n</script>\n"))
    at = F.instr(template, "</body>")
    return F.when(at > 0, F.concat(F.left(template, at - 1), script, F.substr(template, at))).otherwise(template)


def write_events(events: DataFrame, path: str, parts: int = PARTS) -> None:
    """Events as Parquet, sorted by clip, so that reading a clip prunes the rest; clips written again are replaced."""
    kept = ", ".join(f"`{n}` {t}" for n, t in events.dtypes if n != "clip_id")
    _replace(events, path, parts, "parquet", kept)
