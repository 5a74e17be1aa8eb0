"""Inflexion tables in rendered HTML, and the source that renders them."""

from __future__ import annotations

import http
import http.client
import itertools
import re
import time
import urllib.parse
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import decoded

FLOAT_RIGHT = re.compile("float *: *right;")
ROWS = "template_name string, row_no int, cells array<string>, err string"


def closed_elements(html: str) -> Iterator[ET.Element]:
    """The elements that close inside the first table that floats right, in that order, up to the first close of a table, nested or not."""
    markup = ET.XMLPullParser(("start", "end"))
    markup.feed(f"<page>{html}</page>")
    events = markup.read_events()
    floats = (True for kind, x in events if kind == "start" and x.tag == "table" and FLOAT_RIGHT.match(x.get("style", "")))
    if next(floats, False):
        ends = (x for kind, x in events if kind == "end")
        yield from itertools.takewhile(lambda x: x.tag != "table", ends)


def cell_text(cell: ET.Element) -> str | None:
    """The text before a cell's first child, else that of its first link, else none."""
    texts = (x.text for x in (cell, *cell.findall("a")[:1]))
    return next((t.strip() for t in texts if t is not None), None)


def table_rows(html: str) -> Iterator[list[str]]:
    """Cells of the first table that floats right, row by row; cells without a text are left out, what follows the last row is a row if it has cells."""
    cells: list[str | None] = []
    for x in closed_elements(html):
        if x.tag in ("th", "td"):
            cells.append(cell_text(x))
        elif x.tag == "tr":
            yield [c for c in cells if c is not None]
            cells = []
    if rest := [c for c in cells if c is not None]:
        yield rest


def parse_tables(pages: DataFrame) -> DataFrame:
    """ROWS of rendered pages (template_name, html). Markup that is not well formed rejects its template: one row with err."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, html in zip(b["template_name"], b["html"], strict=True):
                try:
                    out += [(name, k, cells, None) for k, cells in enumerate(table_rows(html or ""))]
                except ET.ParseError as e:
                    out.append((name, None, None, str(e)))
            yield pd.DataFrame(out, columns=["template_name", "row_no", "cells", "err"]).astype({"row_no": "Int32"})

    return pages.select("template_name", "html").mapInPandas(run, ROWS)


def table_name(title):
    """A template's title without its name space."""
    return F.replace(title, F.lit("Шаблон:"), F.lit(""))


def table_text(rows: DataFrame) -> DataFrame:
    """template_name, value: the text form of the tables, cells each followed by a bar, a line per row."""
    line = F.array_join(F.transform("cells", lambda c: F.concat(c, F.lit(" |"))), " ")
    per = rows.where(F.col("err").isNull()).groupBy("template_name").agg(F.array_sort(F.collect_list(F.struct("row_no", line.alias("line")))).alias("l"))
    return per.select("template_name", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("value"))


#: What a fetcher gives for each title: title, html (null without one), the answer's status (null without an answer), tries, what failed.
ANSWERS = "title string, html string, status int, tries int, err string"
Fetch = Callable[[Iterable[str]], Iterator[tuple]]
#: What unrendered() and table_rejects() may say.
CODES = ("bad_markup", "no_answer", *(f"status_{int(s)}" for s in http.HTTPStatus))
#: Statuses that another try may change.
PASSING = frozenset((408, 425, 429, 500, 502, 503, 504))


def http_fetch(address: str, timeout: float = 60, tries: int = 5, wait: float = 1.0, secure: bool = True) -> Fetch:
    """A fetcher with one kept connection. Passing faults (no connection, a slow answer, PASSING) are tried again after wait, 2 wait, 4 wait ... seconds, or what the answer asks for, up to a minute; every answer is read to its end."""

    def run(titles: Iterable[str]) -> Iterator[tuple]:
        connect = http.client.HTTPSConnection if secure else http.client.HTTPConnection
        link = connect(address, timeout=timeout)
        try:
            for title in titles:
                for k in range(1, tries + 1):
                    html, status, err, pause = None, None, None, wait * 2 ** (k - 1)
                    try:
                        link.request("GET", "/w/index.php?" + urllib.parse.urlencode({"action": "render", "title": title}), headers={"Connection": "keep-alive"})
                        answer = link.getresponse()
                        body, status = answer.read(), answer.status
                        if status == 200:
                            html = body.decode("utf-8", "replace")
                        else:
                            err = f"{status} {answer.reason}"
                            asked = answer.getheader("Retry-After") or ""
                            pause = max(pause, float(asked)) if asked.isdigit() else pause
                    except (OSError, http.client.HTTPException) as e:
                        err = f"{type(e).__name__}: {e}"
                        link.close()  # the next request opens it anew
                    if err is None or status is not None and status not in PASSING:
                        break
                    if k < tries:
                        time.sleep(min(pause, 60.0))
                yield title, html, status, k, err
        finally:
            link.close()

    return run


def answers(titles: DataFrame, fetch: Fetch, connections: int = 1) -> DataFrame:
    """ANSWERS for each title: a range of titles and a fetcher per connection. No title is lost: what could not be had has its status and err."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = (t for b in batches for t in b["title"])
        found = iter(fetch(names))
        while out := list(itertools.islice(found, 100)):
            yield pd.DataFrame(out, columns=["title", "html", "status", "tries", "err"]).astype({"status": "Int32", "tries": "Int32"})

    return titles.select("title").repartitionByRange(connections, "title").mapInPandas(run, ANSWERS)


def rendered(found: DataFrame) -> DataFrame:
    """template_name, html of ANSWERS that have one."""
    return found.where(F.col("html").isNotNull()).select(table_name(F.col("title")).alias("template_name"), "html")


def unrendered(found: DataFrame) -> DataFrame:
    """Rejects: stage, code, detail, key of titles without html."""
    code = F.when(F.col("status").isNull(), "no_answer").otherwise(F.concat(F.lit("status_"), F.col("status").cast("string")))
    return found.where(F.col("html").isNull()).select(F.lit("tables").alias("stage"), code.alias("code"), F.col("err").alias("detail"), F.col("title").alias("key"))


def table_rejects(rows: DataFrame) -> DataFrame:
    """Rejects of parse_tables(): pages whose markup is not well formed."""
    return rows.where(F.col("err").isNotNull()).select(F.lit("tables").alias("stage"), F.lit("bad_markup").alias("code"), F.col("err").alias("detail"), F.col("template_name").alias("key"))


def saved_pages(spark: SparkSession, folder: str) -> DataFrame:
    """ANSWERS from rendered pages at hand: the Parquet folder that sinks.write_html() makes, or .html files named after their templates (% for /)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/*.html")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path):
        name = decoded(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.html$", ""))
        rows = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.html").load(folder)
        rows = rows.select(F.translate(name, "%", "/").alias("title"), F.col("value").alias("html"))
    else:
        rows = spark.read.parquet(folder).select(F.col("template_name").alias("title"), "html")
    return rows.select("title", "html", F.lit(200).alias("status"), F.lit(0).alias("tries"), F.lit(None).cast("string").alias("err"))
