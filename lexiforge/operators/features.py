"""Features of letter sequences for a linear-chain model, and its decoder."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.automaton import Automaton, automaton
from ..functions.text import let

SUFFIX = "|"
#: Up to so many rows a lexicon is an automaton and a model is a table on every executor; beyond it they are joined.
LEXICON_ROWS = MODEL_ROWS = 500_000
WEIGHTS = "feature string, label_prev string, label string, weight double"
FEATURES = "pos int, feature string"
#: A feature factory gives word_id, pos, feature for words (word_id, word) and a lexicon (morpheme, type) or none.
Factory = Callable[[DataFrame, "DataFrame | None"], DataFrame]


def split_letters(word: Column) -> Column:
    """array<struct<letter, pos>> of a word."""
    return F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c, k: F.struct(c.alias("letter"), k.alias("pos")))


def context_features(rows: DataFrame) -> DataFrame:
    """word_id, pos, feature of letter rows (word_id, pos, letter): the letter with its neighbours, its place from both ends; '' beyond the ends."""
    by = Window.partitionBy("word_id").orderBy("pos")
    size = F.count("*").over(Window.partitionBy("word_id"))
    seen = rows.select("word_id", "pos", "letter", F.coalesce(F.lag("letter").over(by), F.lit("")).alias("p"), F.coalesce(F.lead("letter").over(by), F.lit("")).alias("n"), size.alias("size"))
    # The names of the features, here and below.
    each = F.array(
        F.format_string("%s-%s-PWORD-WORD", "p", "letter"), F.format_string("%s-WORD", "letter"), F.format_string("%s-%s-WORD-NWORD", "letter", "n"),
        F.format_string("%d-POSITION", "pos"), F.format_string("%d-BACK-POSITION", F.col("size") - F.col("pos")),
    )
    return seen.select("word_id", "pos", F.explode(F.transform(F.array_distinct(each), lambda f: F.concat(f, F.lit(SUFFIX + "C")))).alias("feature"))


def word_context_features(words: DataFrame) -> DataFrame:
    """context_features() of whole words (word_id, word): a word's letters are at hand, so nothing is shuffled."""
    at = lambda letters, k: F.coalesce(F.get(letters, k), F.lit(""))

    def each(letters: Column) -> Column:
        names = lambda c, k: F.array(
            F.format_string("%s-%s-PWORD-WORD|C", at(letters, k - 1), c), F.format_string("%s-WORD|C", c), F.format_string("%s-%s-WORD-NWORD|C", c, at(letters, k + 1)),
            F.format_string("%d-POSITION|C", k), F.format_string("%d-BACK-POSITION|C", F.size(letters) - k),
        )
        return F.transform(letters, lambda c, k: F.struct(k.alias("pos"), names(c, k).alias("features")))

    letters = F.filter(F.split("word", ""), lambda c: c != "")
    seen = words.select("word_id", F.explode(let(letters, each)).alias("l"))
    return seen.select("word_id", "l.pos", F.explode("l.features").alias("feature"))


class Lexicon:
    """Morphemes and their types: an automaton, and for each morpheme the numbers of its types."""

    def __init__(self, rows: list[tuple[str, str]]):
        types: dict[str, set[str]] = {}
        for morpheme, kind in rows:
            types.setdefault(morpheme, set()).add(kind)
        self.empty = sorted(types.pop("", ()))
        morphemes = sorted(types)
        self.types = sorted({t for _, t in rows})
        number = {t: k for k, t in enumerate(self.types)}
        self.morphemes = pa.array(morphemes, pa.string())
        self.sizes = np.fromiter(map(len, morphemes), np.int64, len(morphemes))
        self.first = np.concatenate([[0], np.cumsum([len(types[m]) for m in morphemes])]).astype(np.int64)
        self.numbers = np.array([number[t] for m in morphemes for t in sorted(types[m])], np.int64)
        self.automaton: Automaton = automaton(morphemes)


def lexicon_of(lexicon: DataFrame | None) -> Lexicon | None:
    """A lexicon's tables; None if it is too large to be sent to executors."""
    rows = lexicon.select("morpheme", "type").limit(LEXICON_ROWS + 1).collect() if lexicon is not None else []
    return Lexicon([(r[0], r[1]) for r in rows]) if len(rows) <= LEXICON_ROWS else None


def flat_letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], list[str], list[str]]:
    """(word, place, letter, the one before, the one after) of all letters of words; '' beyond a word's ends."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    row, ends = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes)
    letters = list("".join(words))
    before, after = ["", *letters][: len(letters)], [*letters[1:], ""][: len(letters)]
    for k in ends[sizes > 0].tolist():
        after[k - 1] = ""
        if k < len(letters):
            before[k] = ""
    return row, np.arange(len(letters)) - (ends - sizes)[row], letters, before, after


def joined(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "-")


def pair_rows(words: list[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word, place, feature): letter pairs, and the morphemes that start or end at a place, in one pass over the words."""
    row, pos, letters, before, after = flat_letters(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    c, suffix = pa.array(letters, pa.string()), SUFFIX + "CpC"
    rows, places = [row, row], [pos, pos]
    names = [joined(pa.array(before, pa.string()), c, "PWORD", "WORD" + suffix), joined(c, pa.array(after, pa.string()), "WORD", "NWORD" + suffix)]
    text, end, morpheme = lexicon.automaton.matches(words)
    inside = end < sizes[text]
    for side, t, p, m in (("START", text, end - lexicon.sizes[morpheme], morpheme), ("END", text[inside], end[inside], morpheme[inside])):
        rows.append(t)
        places.append(p)
        names.append(joined(side, "OF", lexicon.morphemes.take(pa.array(m)), "MORPHEME" + suffix))
        many = np.diff(lexicon.first)[m]
        kind = lexicon.numbers[np.repeat(lexicon.first[m] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        # several morphemes of one type at a place give one feature
        key = np.unique(np.stack([np.repeat(t, many), np.repeat(p, many), kind]), axis=1)
        rows.append(key[0])
        places.append(key[1])
        names.append(joined(side, "OF", pa.array(lexicon.types, pa.string()).take(pa.array(key[2])), "TYPE", "MORPHEME" + suffix))
    for name in [f"END-OF--MORPHEME{suffix}", *(f"END-OF-{t}-TYPE-MORPHEME{suffix}" for t in lexicon.empty)] if lexicon.empty else []:
        # the empty morpheme ends everywhere and starts nowhere
        rows.append(row)
        places.append(pos)
        names.append(pa.array([name] * len(row), pa.string()))
    row, pos, name = np.concatenate(rows), np.concatenate(places), pa.concat_arrays(names)
    if lexicon.empty:  # its types may end there by themselves
        code = name.dictionary_encode()
        _, at = np.unique(np.stack([row, pos, code.indices.to_numpy()]), axis=1, return_index=True)
        row, pos, name = row[at], pos[at], name.take(pa.array(at))
    return row, pos, name


def context_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word, place, feature) of word_context_features()."""
    row, pos, letters, before, after = flat_letters(words)
    c, suffix = pa.array(letters, pa.string()), SUFFIX + "C"
    back = np.fromiter(map(len, words), np.int64, len(words))[row] - pos
    number = lambda x: pa.array(x).cast(pa.string())
    names = [
        joined(pa.array(before, pa.string()), c, "PWORD", "WORD" + suffix), joined(c, "WORD" + suffix), joined(c, pa.array(after, pa.string()), "WORD", "NWORD" + suffix),
        joined(number(pos), "POSITION" + suffix), joined(number(back), "BACK", "POSITION" + suffix),
    ]
    return np.tile(row, 5), np.tile(pos, 5), pa.concat_arrays(names)


def pair_features(words: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """word_id, pos, feature of words (word_id, word): letter pairs, and every lexicon morpheme (morpheme, type) that starts or ends at a place.

    An automaton of the lexicon goes over each word once, where the word is; a lexicon that is too large for executors is joined.
    An empty morpheme ends everywhere and starts nowhere. A word_id names one word.
    """
    table = lexicon_of(lexicon)
    if table is None:
        return pair_features_by_join(words, lexicon)
    shared = words.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                some = b.slice(lo, 2000)
                row, pos, name = pair_rows([w or "" for w in some.column(1).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row)), pa.array(pos.astype(np.int32)), name], ["word_id", "pos", "feature"])

    plain = words.select("word_id", F.col("word").cast("string").alias("word"))
    return plain.mapInArrow(run, f"word_id {plain.schema['word_id'].dataType.simpleString()}, {FEATURES}")


def pair_features_by_join(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """pair_features() for a lexicon of any size: the places are exploded to substrings, which meet it in an equality join; those longer than its longest morpheme are not made."""
    longest, shortest = lexicon.agg(F.max(F.length("morpheme")), F.min(F.length("morpheme"))).first()
    longest, first = longest or 0, 0 if shortest == 0 else 1
    n = F.length("word")
    at = words.where(n > 0).select("word_id", "word", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    letter = lambda k: F.substring("word", k, F.lit(1))
    p = F.when(F.col("pos") > 0, letter(F.col("pos"))).otherwise("")
    c, nxt = letter(F.col("pos") + 1), F.when(F.col("pos") + 1 < n, letter(F.col("pos") + 2)).otherwise("")
    pairs = at.select("word_id", "pos", F.explode(F.array(F.format_string("%s-%s-PWORD-WORD", p, c), F.format_string("%s-%s-WORD-NWORD", c, nxt))).alias("feature"))
    none = F.array().cast("array<int>")
    forward = F.when(n > F.col("pos"), F.sequence(F.lit(1), F.least(n - F.col("pos"), F.lit(max(longest, 1))))).otherwise(none)
    back = F.when(F.col("pos") >= first, F.sequence(F.lit(first), F.least(F.col("pos"), F.lit(max(longest, 1))))).otherwise(none)
    starts = at.select("word_id", "pos", F.lit("START").alias("side"), F.explode(F.transform(forward, lambda k: F.substring("word", F.col("pos") + 1, k))).alias("morpheme"))
    ends = at.select("word_id", "pos", F.lit("END").alias("side"), F.explode(F.transform(back, lambda k: F.substring("word", F.col("pos") - k + 1, k))).alias("morpheme"))
    hits = starts.unionByName(ends).join(lexicon.groupBy("morpheme").agg(F.collect_set("type").alias("types")), "morpheme")
    named = F.concat(F.array(F.format_string("%s-OF-%s-MORPHEME", "side", "morpheme")), F.transform("types", lambda t: F.format_string("%s-OF-%s-TYPE-MORPHEME", F.col("side"), t)))
    found = pairs.unionByName(hits.select("word_id", "pos", F.explode(named).alias("feature"))).dropDuplicates()
    return found.withColumn("feature", F.concat("feature", F.lit(SUFFIX + "CpC")))


def clique_features(words: DataFrame, lexicon: DataFrame | None, clique: str) -> DataFrame:
    """Features of one clique: C or CpC."""
    if clique == "C":
        return word_context_features(words)
    if clique == "CpC":
        return pair_features(words, lexicon)
    raise ValueError(f"unknown clique {clique}")


def all_features(words: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """The feature factory that is taken by default: both cliques."""
    return word_context_features(words).unionByName(pair_features(words, lexicon))


def factory(name: str | None) -> Factory | None:
    """The feature factory that `module:function` names."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function or "features")


def load_lexicon(spark, files: dict[str, str]) -> DataFrame:
    """morpheme, type from one file per type; lines that start with # are left out."""
    out = None
    for kind, path in files.items():
        one = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.col("value").alias("morpheme"), F.lit(kind).alias("type"))
        out = one if out is None else out.unionByName(one)
    return out.dropDuplicates()


def save_model(weights: DataFrame, labels: list[str], folder: str, lexicon: DataFrame | None = None) -> None:
    """A model's folder: weights (WEIGHTS), labels in their order, lexicon (morpheme, type)."""
    spark = weights.sparkSession
    weights.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in WEIGHTS.split(", "))).write.mode("overwrite").parquet(f"{folder}/weights")
    spark.createDataFrame(list(enumerate(labels)), "place int, label string").write.mode("overwrite").parquet(f"{folder}/labels")
    lexicon = spark.createDataFrame([], "morpheme string, type string") if lexicon is None else lexicon
    lexicon.select("morpheme", "type").write.mode("overwrite").parquet(f"{folder}/lexicon")


def load_model(spark, folder: str) -> tuple[DataFrame, list[str], DataFrame]:
    """(weights, labels, lexicon) of save_model()."""
    if not (folder or "").strip():
        raise ValueError("no model given")
    labels = [r["label"] for r in spark.read.parquet(f"{folder}/labels").orderBy("place").collect()]
    return spark.read.parquet(f"{folder}/weights"), labels, spark.read.parquet(f"{folder}/lexicon")


def read_weights(spark, path: str) -> DataFrame:
    """WEIGHTS from lines of text: feature, previous label (empty: none), label and weight between tabs."""
    return spark.read.csv(path, sep="\t", schema=WEIGHTS, quote="", mode="FAILFAST", emptyValue="", nullValue="")


class Model:
    """Weights as arrays: a row for each feature that weighs one label, another for each that weighs two."""

    def __init__(self, rows: list, labels: list[str]):
        m, place = len(labels), {name: k for k, name in enumerate(labels)}
        one = sorted({r["feature"] for r in rows if r["label_prev"] is None})
        two = sorted({r["feature"] for r in rows if r["label_prev"] is not None})
        at_one, at_two = ({f: k for k, f in enumerate(x)} for x in (one, two))
        self.labels, self.one, self.two = labels, pa.array(one, pa.string()), pa.array(two, pa.string())
        #: Features of a clique that no weight names need not be made.
        self.cliques = {SUFFIX + f.rpartition(SUFFIX)[2] for f in at_one | at_two}
        self.single, self.double = np.zeros((len(one), m)), np.zeros((len(two), m, m))
        for r in rows:
            if r["label_prev"] is None:
                self.single[at_one[r["feature"]], place[r["label"]]] += r["weight"]
            else:
                self.double[at_two[r["feature"]], place[r["label_prev"]], place[r["label"]]] += r["weight"]

    def scores(self, words: list[str], n: int, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray | None]:
        """(scores of labels, scores of label pairs) at each place of words of n letters."""
        m = len(self.labels)
        own, step = np.zeros((len(words), n, m)), np.zeros((len(words), n, m, m)) if len(self.two) else None
        makers = [make for suffix, make in ((SUFFIX + "C", context_rows), (SUFFIX + "CpC", lambda x: pair_rows(x, lexicon))) if suffix in self.cliques]
        for row, pos, name in (make(words) for make in makers):
            for known, weights, out in ((self.one, self.single, own), (self.two, self.double, step)):
                if len(known):
                    at = pc.index_in(name, value_set=known)
                    some = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                    np.add.at(out, (row[some], pos[some]), weights[at.drop_null().to_numpy()])
        return own, step


def best_paths(own: np.ndarray, step: np.ndarray | None) -> np.ndarray:
    """The best label sequence of each word (word, place) for scores (word, place, label) and (word, place, label before, label); the first of equals."""
    score, back = own[:, 0], []
    for k in range(1, own.shape[1]):
        all_ = score[:, :, None] + (step[:, k] if step is not None else 0.0) + own[:, k, None, :]
        back.append(all_.argmax(axis=1))
        score = all_.max(axis=1)
    path = [score.argmax(axis=1)]
    for b in reversed(back):
        path.append(np.take_along_axis(b, path[-1][:, None], 1)[:, 0])
    return np.stack(path[::-1], axis=1)


def by_length(words: list[str], labels: int) -> Iterator[tuple[int, list[int]]]:
    """(length, numbers of words of it), in blocks whose score arrays stay small."""
    places: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if w:
            places.setdefault(len(w), []).append(i)
    for n, all_ in places.items():
        most = max(1, 4_000_000 // (n * labels * labels))
        for lo in range(0, len(all_), most):
            yield n, all_[lo : lo + most]


def labelled(word: str, path: list[int], labels: list[str]) -> list[dict]:
    return [{"letter": c, "label": labels[k]} for c, k in zip(word, path, strict=True)]


LABELLED = "array<struct<letter: string, label: string>>"


def tables_of(weights: DataFrame, labels: list[str], lexicon: DataFrame | None) -> tuple[Model, Lexicon] | None:
    """A model's and a lexicon's arrays; None if they are too large to be sent to executors."""
    some = weights.limit(MODEL_ROWS + 1).collect()
    table = lexicon_of(lexicon) if len(some) <= MODEL_ROWS else None
    return None if table is None else (Model(some, labels), table)


def decode(words: DataFrame, weights: DataFrame, labels: list[str], lexicon: DataFrame | None = None, features: Factory | None = None) -> DataFrame:
    """words (word, ...) with labelled: the best label sequence of a linear-chain model; none for an empty or null word.

    weights: feature, label_prev (null for one-label features), label, weight; lexicon: morpheme, type. features: by default all_features().
    Models and lexicons of up to MODEL_ROWS and LEXICON_ROWS rows are sent to the executors, where whole batches of words are scored in arrays;
    larger ones, and features of one's own, go by joins (see scored()).
    """
    spark = words.sparkSession
    tables = tables_of(weights, labels, lexicon) if features is None else None
    if tables is None:
        return decode_by_join(words, weights, labels, lexicon, features or all_features)
    shared = spark.sparkContext.broadcast(tables)

    @F.pandas_udf(LABELLED)
    def best(column: pd.Series) -> pd.Series:
        model, morphemes = shared.value
        # words repeat: each spelling of a batch is decoded once
        codes, spelled = pd.factorize(column.fillna(""))
        found: list[list[dict]] = [[] for _ in spelled]
        for n, at in by_length(list(spelled), len(labels)):
            paths = best_paths(*model.scores([spelled[i] for i in at], n, morphemes))
            for i, path in zip(at, paths.tolist(), strict=True):
                found[i] = labelled(spelled[i], path, labels)
        return pd.Series([found[c] for c in codes], index=column.index, dtype=object)

    return words.withColumn("labelled", best("word"))


def scored(spelled: DataFrame, weights: DataFrame, labels: list[str], lexicon: DataFrame | None, features: Factory) -> DataFrame:
    """word, scores (pos, before: -1 for none, label, score) of distinct words (word): their features are joined with the weights, wherever these are, and summed by place and labels.

    A place's number is a feature of very many words: the join's skewed partitions can be split, since sums are taken after another shuffle.
    """
    place = F.create_map(*(x for k, name in enumerate(labels) for x in (F.lit(name), F.lit(k))))
    named = features(spelled.select(F.col("word").alias("word_id"), "word"), lexicon)
    known = weights.select("feature", F.when(F.col("label_prev").isNotNull(), place[F.col("label_prev")]).otherwise(-1).alias("before"), place[F.col("label")].alias("label"), "weight")
    sums = named.join(known, "feature").groupBy("word_id", "pos", "before", "label").agg(F.sum("weight").alias("score"))
    return sums.groupBy(F.col("word_id").alias("word")).agg(F.collect_list(F.struct("pos", "before", "label", "score")).alias("scores"))


def decode_by_join(words: DataFrame, weights: DataFrame, labels: list[str], lexicon: DataFrame | None, features: Factory) -> DataFrame:
    """decode() with weights of any number."""
    m = len(labels)

    @F.pandas_udf(LABELLED)
    def best(column: pd.Series, scores: pd.Series) -> pd.Series:
        spelled = list(column)
        found: list[list[dict]] = [[] for _ in spelled]
        for n, at in by_length(spelled, m):
            own, step = np.zeros((len(at), n, m)), np.zeros((len(at), n, m, m))
            for row, i in enumerate(at):
                for s in scores.iloc[i] if scores.iloc[i] is not None else ():
                    (own[row, s["pos"]] if s["before"] < 0 else step[row, s["pos"], s["before"]])[s["label"]] += s["score"]
            for i, path in zip(at, best_paths(own, step).tolist(), strict=True):
                found[i] = labelled(spelled[i], path, labels)
        return pd.Series(found, index=column.index, dtype=object)

    spelled = words.select("word").where(F.length("word") > 0).distinct()
    found = spelled.join(scored(spelled, weights, labels, lexicon, features), "word", "left").select("word", best("word", "scores").alias("labelled"))
    return words.join(found, "word", "left").select(*words.columns, F.coalesce("labelled", F.array().cast(LABELLED)).alias("labelled"))
