"""Sinks. Tables go to folders, where a job's success marks the end of the output; what has one output per input goes to files of their own names (files.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import below, write_files


def safe_title(title):
    return F.translate(title, "/ ", "-_")


def write_pages(pages: DataFrame, folder: str) -> None:
    """page (the title as a file's name), title and text of each page, as Parquet: a folder per title would make a million of them. A rerun replaces what is there."""
    pages.select(safe_title(F.col("title")).alias("page"), "title", F.coalesce("text", F.lit("")).alias("text")).write.mode("overwrite").parquet(folder)


def write_titles(pages: DataFrame, folder: str) -> None:
    pages.select(F.col("title").alias("value")).write.mode("overwrite").text(folder)


def write_tables(texts: DataFrame, folder: str) -> None:
    """template_name, value: a folder per template; / in its name becomes %. The writer ends each value's last line itself."""
    texts.select(F.translate("template_name", "/", "%").alias("table"), F.regexp_replace("value", r"\n$", "").alias("value")).write.mode("overwrite").partitionBy("table").text(folder)


def write_html(pages: DataFrame, folder: str) -> None:
    pages.select("template_name", "html").write.mode("overwrite").parquet(folder)


def write_answers(found: DataFrame, folder: str) -> DataFrame:
    """Keep what a render source has answered; returns the kept rows."""
    found.write.mode("overwrite").parquet(folder)
    return found.sparkSession.read.parquet(folder)


def meta_lines(metas: DataFrame) -> DataFrame:
    return metas.select(F.concat_ws(";", "morfo", "template_name", "stems").alias("value"))


def write_metas(metas: DataFrame, folder: str) -> None:
    meta_lines(metas).write.mode("overwrite").text(folder)


def write_segmentations(rows: DataFrame, folder: str) -> None:
    rows.select("value").write.mode("overwrite").text(folder)


def write_page_files(pages: DataFrame, folder: str) -> None:
    """The text of each page (title, text) in a file of its own below folder. Of titles that make one name, the last in order of titles counts."""
    named = pages.groupBy(safe_title(F.col("title")).alias("name")).agg(F.max_by(F.struct("text"), "title")["text"].alias("value"))
    root, _ = below(folder, named.select(F.col("name").alias("doc")).limit(0))
    write_files(named.select(F.concat(F.lit(root + "/"), "name").alias("file"), "value"), folder)


def output_file(doc, name, folder: str | None, docs: DataFrame):
    """(the output's path for the input path doc, named by the function `name`, a folder of the outputs): below `folder` as the inputs lie below their common folder, or beside its input if that is None."""
    if folder is not None:
        root, n = below(folder, docs)
        return F.concat(F.lit(root + "/"), name(F.substring(doc, F.lit(n + 1), F.length(doc)))), folder
    # the temporary folder of files beside their inputs lies in the inputs' common folder
    first, n = docs.agg(F.min("doc")).first()[0], below("/", docs)[1]
    return name(doc), (first or "/")[:n] or "/"


def write_letters(lines: DataFrame, folder: str | None) -> None:
    """doc (the input's path), word_id, value: the letter rows of a word with its blank line. A file per input, .conll added to its name: below folder, or beside the input without one."""
    docs = lines.select("doc")
    file, where = output_file(F.col("doc"), lambda n: F.concat(n, F.lit(".conll")), folder, docs)
    write_files(lines.select(file.alias("file"), "word_id", F.concat("value", F.lit("\n")).alias("value")), where, "word_id")


def segmented_name(name):
    """a.conll: a.segmented.conll; any other name: .segmented added."""
    return F.when(name.endswith(".conll"), F.concat(F.substring(name, F.lit(1), F.length(name) - len(".conll")), F.lit(".segmented.conll"))).otherwise(F.concat(name, F.lit(".segmented")))


def write_sentences(lines: DataFrame, folder: str | None, docs: DataFrame | None = None) -> None:
    """doc (the input's path), sent_id, line_no, line: a file per input under its segmented_name(), sentences in order, each with the blank line that ends it; below folder, or beside the input without one.

    docs: all inputs (doc); those without sentences have an empty file.
    """
    per = lines.groupBy("doc", "sent_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    text = F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n\n"))
    rows = per.select("doc", "sent_id", text.alias("value"))
    all_ = docs.select("doc") if docs is not None else lines.select("doc")
    if docs is not None:
        rows = rows.unionByName(all_.distinct().select("doc", F.lit(-1).cast("long").alias("sent_id"), F.lit(None).cast("string").alias("value")))
    file, where = output_file(F.col("doc"), segmented_name, folder, all_)
    write_files(rows.select(file.alias("file"), "sent_id", "value"), where, "sent_id")


def write_rejects(rows: DataFrame, folder: str) -> None:
    rows.select("stage", "code", "detail", "key").write.mode("overwrite").parquet(folder)
