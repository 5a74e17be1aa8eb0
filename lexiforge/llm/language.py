"""Language identification by Bayesian evidence fusion.

Four pieces of evidence are combined in log space: the likelihood of the whole text under byte-trigram
models, the declared markup language, and the language shares of the address: the host's counts, smoothed
towards its suffix's, these towards all documents'. The counts are sums of the text-only posteriors by
(host, suffix), aggregated with partial sums, and a document's own share is taken out of its host's
before it serves as prior. One more class, undetermined, has a uniform text model, so text in an unknown language or
script falls to it.

The trigram models are fitted on about SAMPLE_DOCS distinct labelled texts, an equal number of each of the LANGUAGES commonest labels (at least one; those with the smallest digests);
everything else covers all rows. A text moves through no shuffle: only its scores do.

Edge cases: a null text, and one without letters, is rejected; a null or unknown declaration is no
evidence; a null host has the empty name, with no suffix; without any labelled row no language is known, `language` is null and
only texts without letters are rejected; rows that agree in id, text and evidence get the same result; an empty table gives none; texts of any length are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, tidy
from .vectors import batches_of

SAMPLE_DOCS, LANGUAGES, BUCKETS = 3000, 256, 1 << 16
UNDETERMINED = "und"
#: Share of a trigram's log likelihood that counts: neighbouring trigrams overlap.
TEMPER = 0.25
#: Probability that a declaration is right, and the weights (in documents) of the parent level in a host's and a suffix's shares.
DECLARED_RIGHT, HOST_WEIGHT, SUFFIX_WEIGHT, LEAST_POSTERIOR = 0.9, 10.0, 20.0, 0.5

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_OPENS = re.compile(r"<(?:(!--)|(script|style)\b)?|&\w+;", re.I)
_CLOSES = {len(name): re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}


def trigrams(data: bytes):
    """Hashed trigrams of letters and word ends, in slices of bounded size; all other bytes count as space."""
    for lo in range(0, len(data), 1 << 20):
        a = _FOLD[np.frombuffer(data[max(0, lo - 2) : lo + (1 << 20)], np.uint8)].astype(np.uint32)
        if len(a) < 3:
            continue
        space = a == 32
        code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
        code = (code * np.uint32(2654435761)) >> np.uint32(16)
        yield code[~space[1:-1] | ~(space[:-2] | space[2:])]


def visible(html: str) -> str:
    """html with a space for each comment, script, style, tag and entity, in linear time: an end mark that is found to be missing is not looked for again.

    Without its own end mark a comment, script or style ends like a tag; a tag without an end is text.
    """
    kept, at, look, missing = [], 0, 0, set()
    while m := _OPENS.search(html, look):
        start, end = m.start(), -1
        if html[start] == "&":
            end = m.end()
        elif m[1] and "-->" not in missing:
            end = html.find("-->", m.end()) + 3
            if end < 3:
                end = -1
                missing.add("-->")
        elif m[2] and len(m[2]) not in missing:
            if close := _CLOSES[len(m[2])].search(html, m.end()):
                end = close.end()
            else:
                missing.add(len(m[2]))
        if end < 0 and ">" not in missing:
            end = html.find(">", start) + 1 or -1
            if end < 0:
                missing.add(">")
        if end < 0:
            look = start + 1
        else:
            kept.append(html[at:start])
            at = look = end
    return " ".join([*kept, html[at:]])


def model_of(counts: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """(languages and UNDETERMINED, table of log likelihoods: trigram by language) from each language's counts of trigrams."""
    names = sorted(counts)
    table = np.full((len(names) + 1, BUCKETS), np.log(1 / BUCKETS), np.float32)
    for k, name in enumerate(names):
        table[k] = np.log((counts[name] + 0.01) / (counts[name].sum() + 0.01 * BUCKETS))
    return [*names, UNDETERMINED], np.ascontiguousarray(table.T)


def counted(texts: DataFrame) -> dict[str, np.ndarray]:
    """The trigrams of each language's texts (lang, text), counted in tasks; the driver gets one vector for each language."""

    def task(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for code in trigrams(text.encode()):
                    own += np.bincount(code, minlength=BUCKETS)
        for lang, own in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [own.astype("<i8").tobytes()]})

    def add(table):
        total = sum(np.frombuffer(c, "<i8") for c in table["counts"].to_pylist())
        return pa.Table.from_pydict({"lang": table["lang"].slice(0, 1), "counts": [total.astype("<i8").tobytes()]})

    schema = "lang string, counts binary"
    rows = texts.select("lang", "text").mapInArrow(tidy(task), schema).groupBy("lang").applyInArrow(add, schema)
    return {r["lang"]: np.frombuffer(r["counts"], "<i8") for r in rows.toLocalIterator()}


def least_digests(keys: DataFrame, langs: list[str], each: int) -> list[tuple[str, int]]:
    """(language, the each-th smallest digest, or the largest if there are fewer) of keys (lang, key), by counts of leading bits, six at a time."""
    spark = keys.sparkSession
    found = {lang: (0, each) for lang in langs}  # the leading bits of the digest looked for, and its rank among those that share them
    for shift in (58, 52, 46):
        table = F.broadcast(spark.createDataFrame([(lang, bits) for lang, (bits, _) in found.items()], "lang string, bits long"))
        part = F.shiftright("key", shift)
        inside = F.shiftright("key", min(shift + 6, 63)) == F.col("bits") if shift < 58 else F.lit(True)
        counts: dict[str, list] = {}
        for r in keys.join(table, "lang").where(inside).groupBy("lang", part.alias("part")).count().collect():
            counts.setdefault(r["lang"], []).append((r["part"], r["count"]))
        for lang, parts in counts.items():
            rank = found[lang][1]
            for bits, count in sorted(parts):
                if count >= rank:
                    break
                rank -= count
            else:
                rank += count  # fewer than asked for: all of the last part
            found[lang] = (bits, rank)
    table = F.broadcast(spark.createDataFrame([(lang, bits) for lang, (bits, _) in found.items()], "lang string, bits long"))
    last: dict[str, list[int]] = {}
    for r in keys.join(table, "lang").where(F.shiftright("key", 46) == F.col("bits")).select("lang", "key").collect():
        last.setdefault(r["lang"], []).append(r["key"])
    return [(lang, sorted(k)[: found[lang][1]][-1]) for lang, k in last.items()]


def fit_on(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, languages: int = LANGUAGES):
    """The models of a table with text and lang: of its `languages` commonest labels (by distinct texts, ties by name), max(1, sample_docs // their number) distinct texts each, or all if there are fewer.

    Only digests, counts and a vector for each language reach the driver. Texts with a rarer label are judged like unlabelled ones.
    """
    spark = docs.sparkSession
    some = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("key"))
    keys = materialize(some.select("lang", "key").distinct(), "text-digests")
    langs = [r["lang"] for r in keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    if not langs:
        return model_of({})
    most = F.broadcast(spark.createDataFrame(least_digests(keys, langs, max(1, sample_docs // len(langs))), "lang string, most long"))
    rows = some.join(most, "lang").where(F.col("key") <= F.col("most")).dropDuplicates(["key", "lang"])
    model = model_of(counted(rows))
    discard(keys)
    return model


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def identify(rows: DataFrame, model, html: bool = False) -> DataFrame:
    """id, tkey, declared, host, language, posterior, accepted for rows (id long, tkey long, text, declared, host, suffix).

    tkey tells rows with equal ids apart. html: the text is markup, of which only visible text is read.
    """
    names, table = model
    n, spark = len(names), rows.sparkSession
    shared = spark.sparkContext.broadcast(table)
    keep = ["id", "tkey", "declared", "host", "suffix"]

    def score(batches):
        likelihood = shared.value
        for b in batches:
            out, letters = np.zeros((b.num_rows, n)), np.zeros(b.num_rows, np.int64)
            for k, text in enumerate(b.column(5).to_pylist()):
                if text:
                    for code in trigrams((visible(text) if html else text).encode()):
                        letters[k] += len(code)
                        out[k] += likelihood[code].sum(axis=0, dtype=np.float64)
            shares = softmax(TEMPER * out)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(letters), pa.array(out.tolist(), pa.list_(pa.float64())), *(pa.array(shares[:, k]) for k in range(n))], [*keep, "letters", "scores", *(f"s{k}" for k in range(n))])

    shares = [f"s{k}" for k in range(n)]
    plain = rows.select(F.col("id").cast("long").alias("id"), F.col("tkey").cast("long").alias("tkey"), F.lower(F.col("declared").cast("string")).alias("declared"), F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host"), F.coalesce(F.col("suffix").cast("string"), F.lit("")).alias("suffix"), F.col("text").cast("string").alias("text"))
    with batches_of(spark, 1000):
        scored = materialize(plain.mapInArrow(tidy(score), "id long, tkey long, declared string, host string, suffix string, letters long, scores array<double>, " + ", ".join(f"{s} double" for s in shares)), "scores")
    sums = [F.sum(s).alias(s) for s in shares]
    hosts = materialize(scored.groupBy("host", "suffix").agg(F.count("*").alias("n"), *sums), "hosts")
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("suffix_n"), *(F.sum(s).alias(f"suffix_{s}") for s in shares))
    total = hosts.agg(F.sum("n"), *sums).first()
    everywhere = [((total[k + 1] or 0.0) + 1.0) / ((total[0] or 0) + n) for k in range(n)]
    smooth = [(F.col(f"suffix_s{k}") + SUFFIX_WEIGHT * everywhere[k]) / (F.col("suffix_n") + SUFFIX_WEIGHT) for k in range(n)]
    hosts = materialize(hosts.join(suffixes, "suffix").select("host", "suffix", F.col("n").alias("host_n"), F.array(*shares).alias("host_counts"), F.array(*smooth).alias("parent")), "host-priors")

    def fuse(batches):
        for b in batches:
            if not b.num_rows:
                continue
            score_, own, counts, parent = (np.asarray(b.column(k).flatten(), np.float64).reshape(-1, n) for k in (5, 6, 7, 8))
            hosts_n, letters = b.column(9).to_numpy()[:, None], b.column(4).to_numpy()
            prior = (np.maximum(counts - own, 0) + HOST_WEIGHT * parent) / (np.maximum(hosts_n - 1, 0) + HOST_WEIGHT)
            said = np.zeros_like(prior)
            for k, d in enumerate(b.column(2).to_pylist()):
                d = d and d.replace("_", "-").split("-")[0]
                if d in names[:-1]:
                    said[k] = np.log((1 - DECLARED_RIGHT) / max(1, n - 2))
                    said[k, names.index(d)] = np.log(DECLARED_RIGHT)
                    said[k, -1] = np.log(1 / (n - 1))
            post = softmax(TEMPER * score_ + said + np.log(np.maximum(prior, 1e-12)))
            best = post.argmax(axis=1)
            top = post.max(axis=1)
            known = n > 1
            fine = (letters > 0) & ((best < n - 1) & (top >= LEAST_POSTERIOR) if known else True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array([names[k] if known else None for k in best], pa.string()), pa.array(top), pa.array(fine)], ["id", "tkey", "declared", "host", "language", "posterior", "accepted"])

    joined = scored.select("id", "tkey", "declared", "host", "suffix", "letters", "scores", F.array(*shares).alias("own")).join(hosts, ["host", "suffix"])
    return joined.select("id", "tkey", "declared", "host", "letters", "scores", "own", "host_counts", "parent", "host_n").mapInArrow(fuse, "id long, tkey long, declared string, host string, language string, posterior double, accepted boolean")


def of_documents(docs: DataFrame, model) -> DataFrame:
    """Documents: the declared language is lang, the source stands for the host."""
    return identify(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text", "lang", "source").alias("tkey"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit("").alias("suffix")), model)


def of_pages(pages: DataFrame, model) -> DataFrame:
    """Pages: the declared language is that of the html element, host and suffix come from the address."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col("page_id").alias("id"), F.xxhash64("html", "url").alias("tkey"), F.col("html").alias("text"), F.nullif(F.regexp_extract("html", r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit("")).alias("declared"), host.alias("host"))
    return identify(rows.withColumn("suffix", F.substring_index("host", ".", -1)), model, html=True)


def keep_accepted(docs: DataFrame, model) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is accepted."""
    found = of_documents(docs, model)
    bad = materialize(found.where(~F.col("accepted")).select(F.col("id").alias("lexi_id"), F.col("tkey").alias("lexi_key")).distinct(), "rejected")
    key = F.xxhash64("text", "lang", "source")
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("lexi_id")) & (key == F.col("lexi_key")), "left_anti")
