"""Command line: pages, tables, metas, letters, model, fit, segment, or (without a command) the whole segmentation."""

from __future__ import annotations

import argparse
import contextlib
import logging
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import conllx, features, fitting, letters, segmentation, wikitext
from .operators.letters import BEGIN
from .plans import api
from .sources import dumps, html_tables, progress, sinks, texts
from .sources.progress import log


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexiforge", description=__doc__)
    p.add_argument("-D", "--dump", default="dump.xml", help="XML dump")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-L", "--log", help="log file")
    p.add_argument("-O", "--output", default="segmentations", help="output folder")
    p.add_argument("-A", "--address", default="ru.wiktionary.org", help="wiki that renders templates")
    p.add_argument("-T", "--tables", default="tables", help="folder of table texts")
    p.add_argument("-M", "--metas", help="file of metas; by default they come from the dump")
    p.add_argument("-I", "--inflexions", help="dictionary of inflexions")
    p.add_argument("-S", "--suffixes", help="dictionary of suffixes")
    p.add_argument("-d", "--debug", action="store_true", help="print rejects")
    p.add_argument("-R", "--rejects", help="folder for rejects (stage, code, detail, key)")
    p.add_argument("--compatible", action="store_true", help="keep known slips of the original rules")
    sub = p.add_subparsers(dest="command")
    one = sub.add_parser("pages", help="pages whose title begins with a match")
    one.add_argument("pattern")
    one.add_argument("-O", "--output", dest="folder", help="folder for their texts; titles are printed without it")
    one.add_argument("--files", action="store_true", help="a file for each page in place of Parquet")
    two = sub.add_parser("tables", help="render inflexion tables")
    two.add_argument("-H", "--html", action="store_true", help="keep the HTML")
    two.add_argument("--saved", metavar="FOLDER", help="read rendered pages that are at hand, and ask no wiki")
    two.add_argument("--connections", type=int, default=4, help="connections to the wiki")
    two.add_argument("--tries", type=int, default=5, help="tries for a page")
    two.add_argument("--timeout", type=float, default=60, help="seconds for an answer")
    sub.add_parser("metas", help="metas of the dump")
    four = sub.add_parser("letters", help="letter rows of segmentation files")
    four.add_argument("files", nargs="+")
    four.add_argument("--beside", action="store_true", help="write beside each input in place of -O")
    five = sub.add_parser("model", help="store a sequence model")
    five.add_argument("weights", help="lines: feature, previous label or nothing, label, weight, between tabs")
    five.add_argument("model", help="its folder")
    five.add_argument("--labels", required=True, help="all labels, between commas")
    five.add_argument("--lexicon", action="append", default=[], metavar="TYPE=FILE", help="morphemes of a type, one a line")
    seven = sub.add_parser("fit", help="fit a sequence model to letter rows")
    seven.add_argument("files", nargs="+", help="what `letters` writes")
    seven.add_argument("--model", required=True, help="its folder")
    seven.add_argument("--lexicon", action="append", default=[], metavar="TYPE=FILE", help="morphemes of a type, one a line")
    seven.add_argument("--features", metavar="MODULE:FUNCTION", help="feature factory")
    seven.add_argument("--rounds", type=int, default=50)
    seven.add_argument("--l2", type=float, default=0.1, help="penalty of large weights")
    seven.add_argument("--min-count", type=int, default=1, help="least number of words of a feature")
    six = sub.add_parser("segment", help="add morpheme columns to CoNLL-X files")
    six.add_argument("files", nargs="+")
    six.add_argument("--beside", action="store_true", help="write beside each input in place of -O")
    six.add_argument("--model", required=True, help="folder of a stored model")
    six.add_argument("--begin", default=BEGIN, help="mark of labels that begin a morpheme")
    six.add_argument("--partitions", type=int, help="tasks to decode in")
    six.add_argument("--features", metavar="MODULE:FUNCTION", help="feature factory: gives word_id, pos, feature for words (word_id, word) and a lexicon")
    six.add_argument("--strict", action="store_true", help="stop at a line without ten fields")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(filename=args.log, level=[logging.WARNING, logging.INFO, logging.DEBUG][min(args.verbose, 2)])
    spark = spark or SparkSession.builder.appName("lexiforge").getOrCreate()
    with progress.told(spark):
        run(args, spark)
    return 0


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    if args.command == "pages":
        found = api.pages(spark, args.dump, args.pattern)
        if args.folder:
            with counting(found, "pages") as found:
                (sinks.write_page_files if args.files else sinks.write_pages)(found, args.folder)
        else:
            for row in found.select("title").toLocalIterator():
                print(row["title"])
    elif args.command == "tables":
        if args.saved:
            found = html_tables.saved_pages(spark, args.saved)
        else:
            fetch = html_tables.http_fetch(args.address, args.timeout, args.tries)
            # kept, since every reading would ask again
            found = sinks.write_answers(api.table_answers(spark, args.dump, fetch, args.connections), args.tables + ".answers")
        rendered = html_tables.rendered(found)
        if args.html:
            sinks.write_html(rendered, args.tables + ".html")
        rows = html_tables.parse_tables(rendered)
        with counting(html_tables.table_text(rows), "tables") as tables:
            sinks.write_tables(tables, args.tables)
        tell_rejects(html_tables.unrendered(found).unionByName(html_tables.table_rejects(rows)), html_tables.CODES, args)
    elif args.command == "metas":
        pages = wikitext.parsed_pages(dumps.read_pages(spark, args.dump)).persist()
        with counting(wikitext.metas_of(pages), "metas") as found:
            sinks.write_metas(found, args.output)
        tell_rejects(wikitext.rejects_of(pages), wikitext.CODES, args)
        pages.unpersist()
    elif args.command == "letters":
        with counting(api.to_letters(spark, args.files), "words") as done:
            sinks.write_letters(done, None if args.beside else args.output)
        tell_rejects(letters.letter_rejects(texts.segmentations(spark, args.files)), ("bad_token",), args)
    elif args.command == "model":
        lexicon = features.load_lexicon(spark, dict(x.split("=", 1) for x in args.lexicon)) if args.lexicon else None
        features.save_model(features.read_weights(spark, args.weights), args.labels.split(","), args.model, lexicon)
    elif args.command == "fit":
        lexicon = features.load_lexicon(spark, dict(x.split("=", 1) for x in args.lexicon)) if args.lexicon else None
        rows = letters.letters_from_text(texts.whole_files(spark, args.files))
        weights, labels, values = fitting.fit(rows, lexicon, features.factory(args.features) or features.all_features, args.rounds, args.l2, args.min_count)
        log.info("objective: %s", ", ".join(f"{v:.6g}" for v in values))
        features.save_model(weights, labels, args.model, lexicon)
    elif args.command == "segment":
        weights, labels, lexicon = features.load_model(spark, args.model)
        whole = texts.whole_files(spark, args.files)
        lines = conllx.sentences(whole)
        done = api.segment_lines(lines, weights, labels, args.begin, args.compatible, lexicon, args.strict, features.factory(args.features), args.partitions)
        with counting(done.select("doc", "sent_id", "line_no", conllx.line().alias("line")), "tokens") as done:
            sinks.write_sentences(done, None if args.beside else args.output, whole)
        tell_rejects(conllx.rejects(lines), ("bad_columns",), args)
    else:
        found = texts.metas(spark, args.metas) if args.metas else api.metas(spark, args.dump)
        inflexions, suffixes = texts.dictionaries(spark, args.inflexions, args.suffixes)
        words = api.rendered_forms(found, read_tables(spark, args.tables), inflexions, suffixes, args.compatible).persist()
        with counting(segmentation.forms_of(words), "segmentations") as done:
            sinks.write_segmentations(done, args.output)
        tell_rejects(segmentation.rejects_of(words), segmentation.CODES, args)
        words.unpersist()


@contextlib.contextmanager
def counting(df: DataFrame, what: str) -> Iterator[DataFrame]:
    """df, whose rows are counted as it is written, and told afterwards."""
    df, seen = progress.observed(df, what)
    yield df
    log.info("%d %s", seen.get["rows"], what)


def tell_rejects(bad: DataFrame, codes: tuple[str, ...], args: argparse.Namespace) -> dict[str, int]:
    """Writes rejects where -R says, shows the first thousand with -d, and tells how many there are of each code. Without any of the three they are not made."""
    if not (args.rejects or args.debug or log.isEnabledFor(logging.INFO)):
        return {}
    bad, seen = progress.observed(bad, "rejects", codes)
    if args.rejects:
        sinks.write_rejects(bad, args.rejects)
    else:
        bad.write.format("noop").mode("overwrite").save()
    counts = {k: v for k, v in seen.get.items() if v and k != "rows"}
    log.info("%d rejects: %s", seen.get["rows"], ", ".join(f"{k} {v}" for k, v in sorted(counts.items())))
    if args.debug:
        bad.show(1000, truncate=False)
    return counts


def read_tables(spark: SparkSession, folder: str):
    """Table texts: the folders that `tables` writes, or .table files where there are none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/table=*")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path):
        rows = spark.read.format("text").option("wholetext", True).load(folder)
        return rows.select(F.translate(F.col("table").cast("string"), "%", "/").alias("template_name"), "value")
    return texts.tables(spark, folder)


if __name__ == "__main__":
    raise SystemExit(main())


