"""CoNLL-X texts in Arrow arrays: the steps of conllx for whole documents where they are, so that no row is made or shuffled for a line.

A document is a row (doc, values): its texts, mostly one. Sentences of the same number in several texts of a document count as one, as they do by conllx.sentences().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import conllx, features
from .letters import BEGIN

#: Bytes of text that are taken apart at once, and forms in each of the two generations of a worker's cache.
BLOCK_BYTES, KEPT_FORMS = 1 << 20, 200_000
#: Java's white space within a line; a line is left out if a last line terminator follows it, too.
BLANK, LEFT_OUT = r"^[ \t\x0b\f\r]*$", r"^[ \t\x0b\f\r]*[\x{85}\x{2028}\x{2029}]?$"
COUNTS = "struct<sentences: bigint, tokens: bigint, parts: bigint, bad: bigint>"
LINES = "array<struct<sent_id: bigint, line_no: int, line: string, segmented: boolean>>"


def flat(x) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def blocks(values: pa.ListArray) -> Iterator[pa.ListArray]:
    """values in slices of about BLOCK_BYTES of text, a document at least."""
    sizes = pc.fill_null(pc.binary_length(flat(pc.list_flatten(values))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.bincount(pc.list_parent_indices(values).to_numpy(), sizes, len(values)))
    lo, done = 0, 0.0
    while lo < len(values):
        hi = max(lo + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, "right")))
        yield values.slice(lo, hi - lo)
        lo, done = hi, ends[hi - 1]


def lines(values: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(document, sentence, place in it, line) of the lines of texts that are not blank, as conllx.sentences() numbers them."""
    split = pc.split_pattern(flat(pc.list_flatten(values)), "\n")
    text, line = pc.list_parent_indices(split).to_numpy(), flat(pc.list_flatten(split))
    breaks = pc.match_substring_regex(line, BLANK).to_numpy(zero_copy_only=False)
    inside = ~breaks
    follows = np.zeros(len(line), bool)  # the line before is of the same sentence
    follows[1:] = inside[1:] & inside[:-1] & (text[1:] == text[:-1])
    returns = pc.ends_with(line, "\r").to_numpy(zero_copy_only=False)
    if returns.any():  # a sentence is cut at line feeds with the return before them, so its last line keeps its own
        last = np.append(~follows[1:], True)[: len(line)]
        line = pc.if_else(pa.array(returns & ~last), pc.utf8_slice_codeunits(line, 0, -1), line)
    keep = ~pc.match_substring_regex(line, LEFT_OUT).to_numpy(zero_copy_only=False) & inside
    at = np.flatnonzero(keep)
    number = np.cumsum(inside & ~follows)[at]
    text, line = text[at], line.take(pa.array(at))
    opens = np.append(True, number[1:] != number[:-1])[: len(at)]
    first = np.flatnonzero(opens)
    block = np.cumsum(opens) - 1
    starts = np.append(True, text[1:] != text[:-1])[: len(at)]
    sent = block - np.repeat(block[starts], np.diff(np.append(np.flatnonzero(starts), len(at))))
    return pc.list_parent_indices(values).to_numpy()[text], sent, np.arange(len(at)) - first[block], line


def fields(line: pa.Array, names: tuple[str, ...] = conllx.FIELDS) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(whether each line has ten fields, the named fields of those that have); empty fields collapse."""
    split = pc.split_pattern(line, "\t")
    each = flat(pc.list_flatten(split))
    full = pc.not_equal(each, "").to_numpy(zero_copy_only=False)
    parent = pc.list_parent_indices(split).to_numpy()
    n = len(conllx.FIELDS)
    good = np.bincount(parent[full], minlength=len(line)) == n
    at = np.flatnonzero(full & good[parent])
    return good, {name: each.take(pa.array(at[conllx.FIELDS.index(name) :: n])) for name in names}


def is_word(found: dict[str, pa.Array]) -> np.ndarray:
    return ~pc.is_in(found["postag"], pa.array(conllx.IGNORED_POS)).to_numpy(zero_copy_only=False)


def count(values: pa.ListArray) -> pa.Array:
    n = len(values)
    doc, sent, _, line = lines(values)
    good, found = fields(line, ("form", "postag"))
    # a sentence counts if it has a token, and once if several texts of a document have it
    seen = np.unique((doc[good] << 32) + sent[good]) >> 32
    word = is_word(found)
    split = pc.split_pattern_regex(found["form"].filter(pa.array(word)), "[ -]")
    long = pc.utf8_length(flat(pc.list_flatten(split))).to_numpy() >= 2
    of = doc[good][word][pc.list_parent_indices(split).to_numpy()]
    sums = [np.bincount(x, minlength=n) for x in (seen, doc[good], of[long], doc[~good])]
    return pa.StructArray.from_arrays([pa.array(s.astype(np.int64)) for s in sums], ["sentences", "tokens", "parts", "bad"])


def counts(texts: DataFrame) -> DataFrame:
    """conllx.counts() of documents (doc, values)."""

    @F.arrow_udf(COUNTS)
    def run(values: pa.Array) -> pa.Array:
        return pa.concat_arrays([count(b) for b in blocks(values)] or [count(values)])

    return texts.select("doc", run("values").alias("c")).where("c.tokens > 0").select("doc", "c.*")


class Segmenter:
    """The morpheme columns of forms, by a model and a lexicon in arrays. Forms repeat: a worker keeps the commonest."""

    def __init__(self, model: features.Model, lexicon: features.Lexicon, begin: str = BEGIN, compatible: bool = False, kept: int = KEPT_FORMS):
        self.model, self.lexicon, self.begin, self.compatible, self.kept = model, lexicon, begin, compatible, kept
        self.cache: dict[str, tuple[str, ...]] = {}
        self.old: dict[str, tuple[str, ...]] = {}

    def morphemes(self, path: tuple[int, ...]) -> list[tuple[str, int, int]]:
        """(type, begin, end) of letters.reconstruct(): none if a label does not begin a morpheme where one must begin."""
        out: list[tuple[str, int, int]] = []
        kind = None
        for at, k in enumerate(path):
            label = self.model.labels[k]
            if label == kind:
                out[-1] = (kind, out[-1][1], at + 1)
            elif label.endswith(self.begin):
                kind = label[: len(label) - len(self.begin)]
                out.append((kind, at, at + 1))
            else:
                return []
        return out

    def column(self, parts: list[str]) -> str:
        """A cell of conllx.morpheme_columns()."""
        if not self.compatible:
            return "|".join(parts) if parts else "_"
        out = "_"
        for p in parts:
            out = p if out == "_" else f"|{out}{p}"
        return out

    def columns(self, forms: list[str]) -> list[tuple[str, ...]]:
        if len(self.cache) > self.kept:
            self.old, self.cache = self.cache, {}
        for f in forms:
            if f not in self.cache and f in self.old:
                self.cache[f] = self.old[f]
        new = [f for f in dict.fromkeys(forms) if f not in self.cache]
        parts = {f: [p for p in f.replace("-", " ").split(" ") if len(p) >= 2] for f in new}
        words = list(dict.fromkeys(p for x in parts.values() for p in x))
        found: dict[str, list[tuple[str, str]]] = {}
        for n, at in features.by_length(words, len(self.model.labels)):
            some = [words[i] for i in at]
            paths = list(map(tuple, features.best_paths(*self.model.scores(some, n, self.lexicon)).tolist()))
            # words are many, their label sequences few
            spans = {p: self.morphemes(p) for p in set(paths)}
            found.update((w, [(t, w[lo:hi]) for t, lo, hi in spans[p]]) for w, p in zip(some, paths, strict=True))
        for f, x in parts.items():
            all_ = [m for p in x for m in found[p]]
            self.cache[f] = tuple(self.column([p for t, p in all_ if t == name]) for name in conllx.COLUMNS)
        return [self.cache[f] for f in forms]


def segment(values: pa.ListArray, segmenter: Segmenter, fail_fast: bool = False) -> pa.Array:
    doc, sent, place, line = lines(values)
    good, found = fields(line)
    if fail_fast and not good.all():
        raise ValueError(f"expected {len(conllx.FIELDS)} fields: {line[int(np.argmin(good))].as_py()}")
    doc, sent, place = doc[good], sent[good], place[good]
    # tokens that are no words get the cells of a form without parts
    code = pc.if_else(pa.array(is_word(found)), found["form"], "").dictionary_encode()
    cells = segmenter.columns(code.dictionary.to_pylist())
    columns = [pa.array([c[k] for c in cells], pa.string()).take(code.indices) for k in range(len(conllx.COLUMNS))]
    out = pc.binary_join_element_wise(*(found[f] for f in conllx.FIELDS[:6]), *columns, "", *(found[f] for f in conllx.FIELDS[6:]), "\t")
    none = np.array([all(x == "_" for x in c) for c in cells] or [True])
    done = ~none[code.indices.to_numpy()]
    if len(values.flatten()) > len(values):  # several texts of a document are merged
        at = pc.sort_indices(pa.table({"d": doc, "s": sent, "p": place, "l": out}), sort_keys=[(c, "ascending") for c in "dspl"])
        i = at.to_numpy()
        doc, sent, place, out, done = doc[i], sent[i], place[i], out.take(at), done[i]
    rows = pa.StructArray.from_arrays([pa.array(sent.astype(np.int64)), pa.array(place.astype(np.int32)), out, pa.array(done)], ["sent_id", "line_no", "line", "segmented"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(values)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), rows)


def segmented(values: Column, segmenter, fail_fast: bool = False) -> Column:
    """LINES of a document's texts; segmenter: a broadcast Segmenter."""

    @F.arrow_udf(LINES)
    def run(x: pa.Array) -> pa.Array:
        return pa.concat_arrays([segment(b, segmenter.value, fail_fast) for b in blocks(x)] or [segment(x, segmenter.value, fail_fast)])

    return run(values)
