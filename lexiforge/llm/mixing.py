"""Mixing sources to target weights with a min-cost flow.

1. Documents are aggregated by membership pattern (the set of sources a document
   belongs to): one row of words per pattern. This table alone reaches the
   driver; with more than MAX_PATTERNS rows it stays in Spark (see plan_of_many()), where no document has several sources; else an error says so.
2. A min-cost flow routes words from patterns to the sources' quotas. The first copy of a
   pattern's words costs 0 a word, the second 1: convex costs, so nothing is repeated
   while an unused word of the same source is left.
3. Each pattern's flow is turned into documents in seeded order: a running sum of sizes, in three
   levels (sums of coarse and of fine hash buckets, then rows within a bucket), tells which documents lie within the
   flow. A task sees the rows of one bucket of one pattern at a time, or sums.

Documents are taken whole: the last one is taken if the flow ends nearer to its end than to its start. The
order is the MD5 of seed and doc_id (of the text for a null one), so reruns agree.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; repeated
ids, and null ones of one text, share an order key, ties are broken by size and text digest, and rows that agree in all are interchangeable; an empty table mixes
to an empty one; documents of size 0 take 0 words, so apply_mix() leaves them out.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, quoted

WEIGHTS = (3, 1, 2)
#: Rows of the pattern table that the driver accepts: about 50 MB.
MAX_PATTERNS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, weights: dict, share: float, most: float) -> dict:
    """share times all sizes dealt by weight; a source stops at most times its size and the others take up its excess."""
    total, left = share * sum(sizes.values()), dict(weights)
    out: dict = {}
    while left:
        rest, w = total - sum(out.values()), sum(left.values())
        full = [s for s in left if rest * left[s] / w > most * sizes[s]]
        if not full:
            return out | {s: rest * left[s] / w for s in left}
        for s in full:
            out[s] = float(most * sizes[s])
            del left[s]
    return out


class Flow:
    """Min-cost flow by successive shortest paths on a small graph."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, a: int, b: int) -> None:
        while True:
            dist, via, waiting, queued = {a: 0}, {}, deque([a]), {a}
            while waiting:
                x = waiting.popleft()
                queued.discard(x)
                for e in self.out[x]:
                    y = self.to[e]
                    if self.room[e] and (y not in dist or dist[x] + self.cost[e] < dist[y]):
                        dist[y], via[y] = dist[x] + self.cost[e], e
                        if y not in queued:
                            queued.add(y)
                            waiting.append(y)
            if b not in dist:
                return
            path, y = [], b
            while y != a:
                path.append(via[y])
                y = self.to[via[y] ^ 1]
            least = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= least
                self.room[e ^ 1] += least


def route(words: dict[tuple, int], quotas: dict, copies: int) -> dict[tuple, dict]:
    """For each pattern the words of each copy that each source takes: {pattern: {(copy, source): words}}.

    Patterns that share no source are separate problems, solved one at a time.
    """
    group: dict = {s: s for s in quotas}

    def top(s):
        while group[s] != s:
            group[s] = s = group[group[s]]
        return s

    for p in words:
        for s in p[1:]:
            group[top(s)] = top(p[0])
    parts: dict = {}
    for p in sorted(words, key=str):
        parts.setdefault(top(p[0]), []).append(p)
    out: dict = {p: {} for p in words}
    for patterns in parts.values():
        sources = sorted({s for p in patterns for s in p}, key=str)
        # a source passes its quota to one node per copy, so that the flow tells which copy it took
        flow, at = Flow(2 + len(sources) + copies * len(patterns)), {s: 2 + k for k, s in enumerate(sources)}
        edges = {}
        for s in sources:
            flow.edge(0, at[s], quotas[s], 0)
        for k, p in enumerate(patterns):
            for c in range(copies):
                node = 2 + len(sources) + copies * k + c
                flow.edge(node, 1, words[p], c)
                for s in p:
                    edges[p, c, s] = flow.edge(at[s], node, max(quotas[s], 1), 0)
        flow.run(0, 1)
        for (p, c, s), e in edges.items():
            if used := flow.room[e ^ 1]:
                out[p][c, s] = used
    return out


def pattern_of(docs: DataFrame, sources: str):
    """The sources of a document as a sorted array; one null where it has none."""
    if not dict(docs.dtypes)[sources].startswith("array"):
        return F.array(quoted(sources).cast("string"))
    own = F.array_sort(F.array_distinct(quoted(sources).cast("array<string>")))
    return F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(None).cast("string")))


def plan_of_many(slim: DataFrame, weights: tuple, share: float, copies: int, parts: int = 200) -> DataFrame:
    """pattern, source_size, target, per_copy of slim (pattern, size) whose patterns are single sources, however many: what targets() and route() give.

    Sources are ranked by a range partition and its counts. The level at which sources are filled is found by aggregates: those whose bound
    lies below it are full, which raises it for the others, until no more are. Without overlaps the flow is known: a source's first copy, then the next.
    """
    name = F.col("pattern")[0]
    sums = slim.groupBy(name.alias("s")).agg(F.sum("size").cast("long").alias("n"))
    ordered = sums.repartitionByRange(parts, F.col("s").isNull(), "s").sortWithinPartitions(F.col("s").isNull(), "s")
    place = F.monotonically_increasing_id()  # partition and place in it
    table = materialize(ordered.select("s", "n", place.alias("place")), "mix-sources")
    part = F.shiftright("place", 33)
    counts = sorted(tuple(r) for r in table.groupBy(part.alias("part")).count().collect())
    before, at = [], 0
    for k, n in counts:
        before.append((k, at))
        at += n
    offsets = F.broadcast(slim.sparkSession.createDataFrame(before, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)
    ranked = materialize(table.withColumn("part", part).join(offsets, "part").select("s", "n", F.get(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int")).cast("double").alias("w")), "mix-weights")
    total, level, full = share * (ranked.agg(F.sum("n")).first()[0] or 0), -1.0, F.lit(False)
    while True:
        r = ranked.agg(F.sum(F.when(full, copies * F.col("n")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("w"))), F.count_if(full)).first()
        if not r[1] or (total - r[0]) / r[1] <= level:
            break
        level = (total - r[0]) / r[1]
        full = F.col("w") * level > copies * F.col("n")
    target = F.when(full, copies * F.col("n")).otherwise(F.col("w") * level).cast("double")
    quota = F.floor(target + 0.5)
    per_copy = F.array(*(F.greatest(F.lit(0), F.least(F.col("n"), quota - k * F.col("n"))).cast("long") for k in range(copies)))
    plan = materialize(ranked.select(F.array("s").alias("pattern"), F.col("n").alias("source_size"), target.alias("target"), per_copy.alias("per_copy")), "mix-plan")
    discard(table, ranked)
    return plan


def mix(docs: DataFrame, sources: str = "source", weights: tuple = WEIGHTS, share: float = 1.5, copies: int = 2, seed: str = "mix", max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """Every document of docs with size, source_size, target and taken (words that the mix takes, repeats counted).

    sources: a column with the document's source, or with an array of sources that it belongs to; source_size and target are then those of its
    first source. Sources weigh as weights say, repeated in the order of their code points, null last.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), pattern_of(docs, sources).alias("pattern"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("n"), F.coalesce(F.md5("text"), F.lit("")))))).alias("hash"), F.xxhash64("text").alias("tie"),
    )
    slim = materialize(slim, "mix")
    rows = slim.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        if slim.where(F.size("pattern") > 1).limit(1).count():
            raise ValueError(f"more than {max_patterns} patterns of overlapping sources")
        plan, n_docs = plan_of_many(slim, weights, share, copies), slim.count()
    else:
        n_docs = sum(r["n"] for r in rows)
        words = {tuple(r["pattern"]): r["words"] for r in rows}
        names = sorted({s for p in words for s in p}, key=lambda s: (s is None, s or ""))
        sizes = {s: sum(n for p, n in words.items() if s in p) for s in names}
        target = targets(sizes, {s: weights[k % len(weights)] for k, s in enumerate(names)}, share, copies)
        routed = route(words, {s: int(t + 0.5) for s, t in target.items()}, copies)
        table = []
        for p, used in routed.items():
            per_copy = [sum(n for (c, _), n in used.items() if c == k) for k in range(copies)]
            table.append((list(p), sizes[p[0]], float(target[p[0]]), per_copy))
        # proven small: the driver has just checked its number of rows
        plan = F.broadcast(spark.createDataFrame(table, "pattern array<string>, source_size long, target double, per_copy array<long>"))

    # buckets of some hundred rows each, by leading digits of the hash
    digits = 1
    while n_docs > 256 * 16**digits and digits < 8:
        digits += 1
    slim = slim.withColumn("bucket", F.substring("hash", 1, digits))
    sums = slim.groupBy("pattern", "bucket").agg(F.sum("size").alias("in_bucket"))
    sums = materialize(sums.withColumn("coarse", F.substring("bucket", 1, (digits + 1) // 2)), "mix-sums")
    upto = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    top = sums.groupBy("pattern", "coarse").agg(F.sum("in_bucket").alias("in_coarse"))
    top = top.select("pattern", "coarse", upto(W.partitionBy("pattern").orderBy("coarse"), "in_coarse").alias("before"))
    sums_ = sums.withColumn("inside", upto(W.partitionBy("pattern", "coarse").orderBy("bucket"), "in_bucket")).join(top.hint("merge"), ["pattern", "coarse"])
    starts = materialize(sums_.select("pattern", "bucket", (F.col("before") + F.col("inside")).alias("start")), "mix-buckets")
    discard(sums)
    inside = W.partitionBy("pattern", "bucket").orderBy("hash", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = slim.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts.hint("merge"), ["pattern", "bucket"]).withColumn("place", F.col("start") + F.col("within"))
    placed = placed.join(plan.withColumnRenamed("pattern", "p"), F.col("pattern").eqNullSafe(F.col("p")))
    taken = sum((F.when(2 * F.col("place") + F.col("size") <= 2 * F.col("per_copy")[k], F.col("size")).otherwise(0) for k in range(copies)), F.lit(0).cast("long"))
    return placed.select("doc_id", "pattern", "size", "source_size", "target", taken.alias("taken"), "tie")


def apply_mix(docs: DataFrame, sources: str = "source", **options) -> DataFrame:
    """The rows of docs that the mix takes, all columns as they are, a row for each time that it is taken.

    Rows that agree in doc_id, sources and text share the times that they are taken together evenly; those with the least hashes of all columns are taken
    once more where the times do not divide. Rows that agree in all columns are interchangeable.
    """
    found = mix(docs, sources, **options).where(F.col("taken") > 0)
    times = found.groupBy("doc_id", "pattern", "tie").agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("lexi_times"))
    times = times.select(F.col("doc_id").alias("lexi_id"), F.xxhash64("pattern", "tie").alias("lexi_key"), "lexi_times")
    # how many rows share the times, those with times 0 included
    shared = docs.select(F.col("doc_id").cast("long").alias("n_id"), F.xxhash64(pattern_of(docs, sources), F.xxhash64("text")).alias("n_key")).groupBy("n_id", "n_key").agg(F.count("*").alias("lexi_rows"))
    times = materialize(times.join(shared, F.col("lexi_id").eqNullSafe(F.col("n_id")) & (F.col("lexi_key") == F.col("n_key"))).drop("n_id", "n_key"), "mix-times")
    columns = [quoted(c) for c in docs.columns]
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("lexi_id")) & (F.xxhash64(pattern_of(docs, sources), F.xxhash64("text")) == F.col("lexi_key"))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("lexi_times"))).alias("lexi_copy")
    once = docs.join(times.where(F.col("lexi_rows") == 1), match).select(*columns, copies).drop("lexi_copy")
    if times.where(F.col("lexi_rows") > 1).isEmpty():
        return once
    # few keys: those that repeat doc_id, sources and text. Equal rows become one with a number before they meet
    known = [quoted(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    again = docs.join(times.where(F.col("lexi_rows") > 1), match)
    again = again.groupBy("lexi_id", "lexi_key", "lexi_times", "lexi_rows", F.xxhash64(*known).alias("lexi_hash")).agg(F.count("*").alias("n"), F.first(F.struct(*columns)).alias("lexi_row"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("lexi_id", "lexi_key").orderBy("lexi_hash").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each, rest = F.floor(F.col("lexi_times") / F.col("lexi_rows")), F.col("lexi_times") % F.col("lexi_rows")
    again = again.withColumn("lexi_times", (F.col("n") * each + F.greatest(F.lit(0), F.least(F.col("n"), rest - before))).cast("int"))
    return once.unionByName(again.select("lexi_row", copies).select("lexi_row.*"))


SQL = r"""
WITH d AS (SELECT doc_id, source, text, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
s AS (SELECT source, sum(size) AS n FROM d GROUP BY source),
w AS (SELECT source, n, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
o AS (SELECT *, coalesce(sum(2 * n) OVER before, 0) AS full_before, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left, 1.5::DOUBLE * sum(n) OVER () AS total
  FROM w WINDOW before AS (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - full_before) * w / w_left > 2 * n AS capped FROM o),
r AS (SELECT source, n, CASE WHEN capped THEN (2 * n)::DOUBLE ELSE (total - coalesce(sum(2 * n) FILTER (capped) OVER (), 0)) * w / (sum(w) FILTER (NOT capped) OVER ()) END AS target FROM c),
q AS (SELECT source, n, target, floor(target + 0.5) AS quota FROM r),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(concat('mix:', coalesce(doc_id::VARCHAR, 'n' || coalesce(md5(text), '')))), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM d)
SELECT p.doc_id, p.size::BIGINT AS size, q.n::BIGINT AS source_size, q.target AS target,
  ((CASE WHEN 2 * place + size <= 2 * least(quota, n) THEN size ELSE 0 END) + (CASE WHEN 2 * place + size <= 2 * (quota - least(quota, n)) THEN size ELSE 0 END))::BIGINT AS taken
FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source
"""
