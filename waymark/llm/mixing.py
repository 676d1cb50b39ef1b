"""Mixing sources to target weights (problem 8).

A text may occur in several sources. Texts are aggregated by membership
pattern (the set of sources that have them), and a min-cost flow over this
small table routes token capacity to the sources' quotas: pattern -> use 1, 2,
... of its texts -> source, where the r-th use costs r - 1 (so texts are
repeated no sooner than needed, and evenly) and is open only to sources that
allow r uses. Then texts are chosen in a seeded order: a prefix sum of tokens
within each pattern says which use of which text goes to which source. The sum
is made in three levels (groups of hash buckets, buckets, texts of a bucket), so
no pattern has to be in one task.

A text is taken only where all of it fits into what its source still lacks. What
is left of the quotas is routed again, over the uses that are still free and the
texts that are short enough, until every source is within SLACK of its quota or
nothing fits; at last the text that overshoots least is taken where that comes
closer to the quota than leaving it out.

The total is a parameter. Without it, it is the largest at which every source
that has any text can meet its target; a total beyond that leaves some sources
short, which the shares report.

Defined results
* documents of sources outside the mix (also null) and texts without tokens (null, empty) take no part.
* copies of a text are one document, which a source knows by its smallest id there; so no copy can be used beyond the cap.
* null or non-positive shares or repeats give a quota of 0.
* a source without texts gets nothing and is reported as not met; an empty table gives an empty mix.
* a text counts for all of its sources, however many combinations of sources there are; their network comes to the driver, a row per pattern.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.bpe import TOKENIZERS, count_tokens
from waymark.tables import cut

TEXTS_OF_BUCKET = 2048
MOST_PATTERNS = 100_000  # rows by pattern, use and source that are broadcast
SLACK = 0.002  # of a quota, that may be left open without another round


class Network:
    """Uses of patterns on one side, sources on the other, as arrays: a few sources, however many patterns.

    A path goes from source to source, and carries at once what all uses can move along it. Shortest paths first, so
    their number follows from the sources alone (at most their cube for each number of uses).
    """

    def __init__(self, patterns: dict[str, tuple[list[str], int]], sources: list[str], repeats: dict[str, int], room: dict[tuple[str, int], int] | None = None):
        number = {s: i for i, s in enumerate(sources)}
        self.uses = [(p, r) for p, (names, _) in sorted(patterns.items()) for r in range(1, max([repeats[s] for s in names], default=0) + 1)]
        self.level = np.array([r for _, r in self.uses], np.int64)
        self.tokens = np.array([patterns[p][1] if room is None else room.get((p, r), 0) for p, r in self.uses], np.int64)
        self.open = np.zeros((len(sources), len(self.uses)), bool)  # a row for each source
        for i, (p, r) in enumerate(self.uses):
            for s in patterns[p][0]:
                self.open[number[s], i] = r <= repeats[s]

    def run(self, quotas: list[int], evenly: bool = True) -> np.ndarray:
        """Tokens by source and use: as many as the quotas take. evenly: no r-th use where an earlier one would do."""
        sent = np.zeros(self.open.shape, np.int64)
        everything = int(self.tokens.sum())
        gaps = [min(q, everything) for q in quotas]
        left = self.tokens.copy()
        # An augmenting path never gives back what an earlier use sends, so the uses may come one after the other.
        for r in sorted(set(self.level.tolist())) if evenly else [self.level.max(initial=0)]:
            within = self.level <= r
            while path := self._path(sent, np.where(within, left, 0), gaps):
                amounts = [np.where(within & self.open[path[0]], left, 0)] + [np.where(self.open[b], sent[a], 0) for a, b in zip(path, path[1:])]
                n = min(gaps[path[-1]], *[int(x.sum()) for x in amounts])
                for i, (s, x) in enumerate(zip(path, amounts)):
                    moved = np.clip(n - (np.cumsum(x) - x), 0, x)
                    sent[s] += moved
                    if i:
                        sent[path[i - 1]] -= moved
                    else:
                        left -= moved
                gaps[path[-1]] -= n
        return sent

    def _path(self, sent: np.ndarray, left: np.ndarray, gaps: list[int]) -> list[int]:
        """The shortest path from free tokens to a source that lacks some: each source gives the next one tokens."""
        free = left > 0
        via: dict[int, int] = {s: -1 for s in range(len(gaps)) if (self.open[s] & free).any()}
        queue = deque(via)
        while queue:
            s = queue.popleft()
            if gaps[s]:
                path = [s]
                while via[path[-1]] >= 0:
                    path.append(via[path[-1]])
                return path[::-1]
            uses = sent[s] > 0
            for t in range(len(gaps)):
                if t not in via and (self.open[t] & uses).any():
                    via[t] = s
                    queue.append(t)
        return []


def allocate(patterns: dict[str, tuple[list[str], int]], quotas: dict[str, int], repeats: dict[str, int], room: dict[tuple[str, int], int] | None = None) -> list[tuple[str, int, str, int, int]]:
    """(pattern, use, source, from, to): token ranges of each pattern's order, by use and source.

    room: tokens that are still free in each use of a pattern; all of them where it isn't given.
    """
    sources = sorted(quotas)
    net = Network(patterns, sources, repeats, room)
    sent = net.run([quotas[s] for s in sources]).T
    ends = np.cumsum(sent, axis=1)
    return [(*net.uses[i], sources[s], int(ends[i, s] - sent[i, s]), int(ends[i, s])) for i, s in zip(*(x.tolist() for x in np.nonzero(sent)))]


def best_total(patterns: dict[str, tuple[list[str], int]], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest total at which every source that has texts can get its share (by bisection of the flow)."""
    have = {s for names, _ in patterns.values() for s in names if repeats[s] > 0 and shares[s] > 0}
    if not have:
        return 0
    sources = sorted(shares)
    net = Network(patterns, sources, repeats)
    low, high = 0, int(sum(t * max(repeats[s] for s in n) for n, t in patterns.values()) / min(shares[s] for s in have)) + 1
    while high - low > 1:
        mid = (low + high) // 2
        quotas = [int(shares[s] * mid) if s in have else 0 for s in sources]
        low, high = (mid, high) if int(net.run(quotas, evenly=False).sum()) >= sum(quotas) else (low, mid)
    return low


def _units(documents: DataFrame, mix: DataFrame, folder: str, name: str, seed: int) -> DataFrame:
    """(h, len, n_tokens, o, pattern, members): distinct texts of the mix's sources; o is their place in the seeded order."""
    wanted = mix.select("source").filter("source is not null").distinct()
    inside = documents.join(wanted, "source", "left_semi").filter("length(text) > 0 and doc_id is not null")
    rows = inside.select("doc_id", "source", "text", F.xxhash64("text").alias("h"), F.length("text").alias("len"))
    counted = count_tokens(rows, ["doc_id", "source", "h", "len"], folder, name).filter("n_tokens > 0")
    by_source = counted.groupBy("h", "len", "n_tokens", "source").agg(F.min("doc_id").alias("doc_id"))
    whole = by_source.groupBy("h", "len", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("members"))
    return whole.select("h", "len", "n_tokens", F.shiftrightunsigned(F.xxhash64("h", "len", F.lit(seed)), 1).alias("o"), F.to_json("members.source").alias("pattern"), "members")


def _small(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    """A table of rows by pattern: broadcast up to MOST_PATTERNS rows, else for a shuffle join."""
    df = spark.createDataFrame(rows, kind)
    return F.broadcast(df) if len(rows) <= MOST_PATTERNS else df


def _inside(texts: DataFrame, ranges: list[tuple[str, int, str, int, int]], most: int) -> DataFrame:
    """(h, len, n_tokens, use, source): texts that lie wholly in a range of their slot's order.

    texts: h, len, n_tokens, o, slot; no slot has more than `most` of them. ranges: (slot, use, source, from, to).
    """
    bits = max(0, (max(1, most) // TEXTS_OF_BUCKET).bit_length())
    top = lambda b: F.expr(f"shiftrightunsigned(o, {63 - b})") if b else F.lit(0)
    placed = texts.withColumns({"bucket": top(bits), "many": top(bits // 2)})
    per = placed.groupBy("slot", "many", "bucket").agg(F.sum("n_tokens").alias("t"))
    upto = lambda *keys, by: F.sum("t").over(Window.partitionBy(*keys).orderBy(by)) - F.col("t")
    tops = per.groupBy("slot", "many").agg(F.sum("t").alias("t")).select("slot", "many", upto("slot", by="many").alias("first"))
    before = per.select("slot", "many", "bucket", upto("slot", "many", by="bucket").alias("next")).join(tops, ["slot", "many"]).select("slot", "bucket", (F.col("first") + F.col("next")).alias("before"))
    inner = Window.partitionBy("slot", "bucket").orderBy("o", "h", "len").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("within", F.sum("n_tokens").over(inner) - F.col("n_tokens"))
    table = _small(texts.sparkSession, ranges, "slot string, use int, source string, a bigint, b bigint")  # a row per pattern, use and source
    at = summed.join(before, ["slot", "bucket"]).withColumn("start", F.col("before") + F.col("within"))
    return at.join(table, "slot").filter("start >= a and start + n_tokens <= b").select("h", "len", "n_tokens", "use", "source")


def _choose(units: DataFrame, patterns: dict[str, tuple[list[str], int]], counts: dict[str, int], quotas: dict[str, int], repeats: dict[str, int]) -> DataFrame:
    """(h, len, n_tokens, use, source): uses of texts that fill the quotas."""
    spark, kind = units.sparkSession, "h bigint, len int, n_tokens bigint, use int, source string"
    ranges = allocate(patterns, quotas, repeats)
    chosen = cut(_inside(units.withColumn("slot", F.col("pattern")), ranges, max(counts.values(), default=0)))
    gaps = dict(quotas)
    have = {s for names, _ in patterns.values() for s in names if repeats[s] > 0}

    def fill(new: DataFrame) -> int:
        got = {r["source"]: r["t"] for r in new.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # a row per source
        for s, t in got.items():
            gaps[s] -= t
        return sum(got.values())

    def free(open_: dict[str, int]) -> DataFrame:
        """Uses that are left, of the texts that a source in need has: with `gap`, the most that one of them needs."""
        rows = [(p, r, max(open_[s] for s in names if s in open_ and r <= repeats[s])) for p, (names, _) in patterns.items() for r in range(1, max([repeats[s] for s in names if s in open_], default=0) + 1)]
        slots = _small(spark, rows, "pattern string, use int, gap bigint")
        return units.join(slots, "pattern").join(chosen, ["h", "len", "n_tokens", "use"], "left_anti")

    fill(chosen)
    while True:
        open_ = {s: g for s, g in gaps.items() if s in have and g > SLACK * quotas[s]}
        if not open_:
            return chosen
        short = cut(free(open_).filter("n_tokens <= gap").withColumn("slot", F.concat("use", F.lit(" "), "pattern")))
        sums = {(r["pattern"], r["use"]): r for r in short.groupBy("pattern", "use").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
        again = allocate(patterns, {s: open_.get(s, 0) for s in quotas}, repeats, {k: r["t"] for k, r in sums.items()})
        slots = [(f"{r} {p}", r, s, a, b) for p, r, s, a, b in again]
        new = cut(_inside(short.drop("use", "gap"), slots, max([r["n"] for r in sums.values()], default=0)))
        if not fill(new):
            break
        chosen = cut(chosen.unionByName(new))
    least = F.min(F.struct("n_tokens", "o", "h", "len")).alias("m")
    long = [(r["pattern"], r["use"], *r["m"]) for r in free(open_).filter("n_tokens <= 2 * gap").groupBy("pattern", "use").agg(least).collect()]  # a row per pattern and use
    over = []
    for s, gap in sorted(open_.items()):
        fits = sorted((n, r, o, h, size) for p, r, n, o, h, size in long if s in patterns[p][0] and r <= repeats[s] and n < 2 * gap and not any(x[:4] == (h, size, n, r) for x in over))
        if fits:
            n, r, _, h, size = fits[0]
            over.append((h, size, n, r, s))
    return chosen.unionByName(spark.createDataFrame(over, kind)) if over else chosen


def mix_sources(documents: DataFrame, mix: DataFrame, total_tokens: int | str | None = None, seed: int = 11, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> tuple[DataFrame, DataFrame]:
    """The chosen documents (doc_id, source, n_tokens, uses), and the shares by source.

    total_tokens: a number, "corpus" (the tokens of all distinct texts of the mix's sources), or None.
    """
    spark = documents.sparkSession
    rows = mix.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).collect()
    shares = {r["source"]: max(0.0, r["w"] or 0.0) for r in rows}
    repeats = {r["source"]: max(0, r["r"] or 0) for r in rows}
    units = cut(_units(documents, mix, folder, name, seed))
    sums = units.groupBy("pattern").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.first("members.source").alias("names")).collect()  # a row per pattern: at most 2^sources, and as many as there are texts
    patterns = {r["pattern"]: (list(r["names"]), int(r["t"])) for r in sums}
    if total_tokens is None:
        total = best_total(patterns, shares, repeats)
    else:
        total = sum(t for _, t in patterns.values()) if total_tokens == "corpus" else int(total_tokens)
    quotas = {s: int(shares[s] * total) for s in shares}
    uses = _choose(units, patterns, {r["pattern"]: r["n"] for r in sums}, quotas, repeats)
    per = uses.groupBy("h", "len", "n_tokens", "source").agg(F.count("*").cast("int").alias("uses"))
    chosen = per.join(units.select("h", "len", "n_tokens", "members"), ["h", "len", "n_tokens"]).select(
        F.expr("element_at(filter(members, m -> m.source = source), 1).doc_id").alias("doc_id"), "source", "n_tokens", "uses"
    )

    got = chosen.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    have: dict[str, int] = dict.fromkeys(shares, 0)
    for names, t in patterns.values():
        for s in names:
            have[s] += t
    goals = spark.createDataFrame([(s, float(shares[s]), repeats[s], have[s], quotas[s]) for s in sorted(shares)], "source string, target_share double, max_repeats int, available_tokens bigint, target_tokens bigint")
    zero = lambda c, t: F.coalesce(c, F.lit(0)).cast(t).alias(c)
    told = goals.join(got, "source", "left").select("source", "target_share", "max_repeats", "available_tokens", "target_tokens", zero("n_docs", "bigint"), zero("tokens", "bigint"), zero("most_uses", "int"))
    everything = F.sum("tokens").over(Window.partitionBy())  # a row per source
    told = told.withColumn("actual_share", F.round(F.try_divide(F.col("tokens").cast("double"), everything), 6))
    met = F.expr("available_tokens > 0 and abs(actual_share - target_share) <= 0.02 * target_share + 0.002")
    return chosen, told.withColumn("met", F.coalesce(met, F.lit(False)))


def checks(documents: DataFrame, mix: DataFrame, chosen: DataFrame, told: DataFrame) -> DataFrame:
    """(source, within_cap, sums_agree, own_documents, close): what must hold of every source of a mix.

    close: the source has no texts, or its tokens are within 2 % of the target or half of its longest chosen text.
    """
    of = documents.select("doc_id", F.col("source").alias("of"))
    per = (
        chosen.join(of, "doc_id", "left")
        .groupBy("source")
        .agg(F.max("uses").alias("u"), F.sum(F.col("n_tokens") * F.col("uses")).alias("t"), F.min(F.coalesce(F.col("of") == F.col("source"), F.lit(False))).alias("own"), F.max("n_tokens").alias("longest"))
    )
    caps = mix.filter("source is not null").groupBy("source").agg(F.max("max_repeats").alias("cap"))
    rows = caps.join(told.drop("max_repeats"), "source").join(per, "source", "left")
    return rows.selectExpr(
        "source",
        "coalesce(u, 0) <= cap as within_cap",
        "coalesce(t, 0) = tokens as sums_agree",
        "coalesce(own, true) as own_documents",
        "available_tokens = 0 or abs(tokens - target_tokens) <= greatest(0.02D * target_tokens, longest / 2D) as close",
    )
