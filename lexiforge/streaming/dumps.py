"""A dump, or a folder that dumps arrive in, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.wikitext import metas, parsed_pages
from ..sources.dumps import PAGE, REVISED, revised_pages
from ..sources.sinks import meta_lines

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.readStream.format("xml").option("rowTag", "page").schema(PAGE).load(folder)
    return rows.select("title", "ns", F.try_element_at("revision", F.lit(-1))["text"]["_VALUE"].alias("text"))


def stream_metas(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the metas of a page stream; takes what is there and ends. A restart goes on behind the last finished file."""
    return meta_lines(metas(pages)).writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_revisions(spark: SparkSession, folder: str) -> DataFrame:
    """title, revised, ns, text of every page of the dumps that arrive in a folder."""
    return revised_pages(spark.readStream.format("xml").option("rowTag", "page").schema(REVISED).load(folder))


def latest(pages: DataFrame) -> DataFrame:
    """title and its last revision's revised, ns, text of pages (title, revised, ns, text), in any order of arrival; of equal revisions the greatest text counts."""
    return pages.groupBy("title").agg(F.max(F.struct("revised", "text", "ns")).alias("p")).select("title", "p.revised", "p.ns", "p.text")


def stream_latest_metas(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of each title's meta, or of why it has none, for its last revision (read it with current_metas()).

    The last revision of a title is the stream's state (in RocksDB, beyond the heap); titles that a batch touches are emitted and written to a folder of the
    batch's number, which a repeated batch replaces. So a restart repeats nothing and loses nothing. Takes what is there and ends.
    """
    spark = pages.sparkSession

    def upsert(batch: DataFrame, number: int) -> None:
        rows = parsed_pages(batch.select("title", "text", "revised"))
        rows.select("title", "revised", "morfo", "template_name", "stems", "err").write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        return latest(pages).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def current_rows(spark: SparkSession, out: str) -> DataFrame:
    """title, revised, morfo, template_name, stems, err of each title after its last batch."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("title").agg(F.max_by(F.struct("revised", "morfo", "template_name", "stems", "err"), "batch").alias("r"))
    return last.select("title", "r.*")


def current_metas(spark: SparkSession, out: str) -> DataFrame:
    """morfo, template_name, stems of each title whose last revision gives a meta."""
    return current_rows(spark, out).where(F.col("err").isNull()).select("morfo", "template_name", "stems")
