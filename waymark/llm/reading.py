"""Reading level of each document (problem 9).

Gradient-boosted regression trees predict the grade from distributions: of word
lengths, of the difficulty of words and word pairs, of the lengths of sentences
and of clauses, of the clauses of a sentence, of how readily words open a clause,
and of what neighbouring sentences share. The difficulty of a word (or pair) is
the mean grade of the labelled documents that have it; for a labelled document it
is taken from the other folds only. How readily a word opens a clause is its share
of places right after a comma, in the same documents: so subordination is learned
from the text in whichever language. Folds are made of whole sources. The grades'
thresholds are calibrated on the predictions for the folds left out. The accuracy
by source is of these predictions too, each fold graded by thresholds that were
calibrated on the other folds only. The folds are fitted side by side, by tasks.

The model is fitted on at most MAX_LABELLED labelled documents (those of
smallest hash, of up to MAX_CHARS characters each and MAX_TOTAL together); every
document is scored over its whole text.

Defined results
* scored are documents whose kind is not `log` and whose n_chars is at least 200; a null kind counts as not `log`.
* null grades and grades outside 1 to 4 are no labels; several labels of a document count by their median.
* without labels every document gets grade 2; without documents the result is empty.
"""

from __future__ import annotations

import html
import itertools
import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm import boosting

MAX_LABELLED = 20_000  # bound of the labelled sample
FOLDS, LEAST_DOCS, SMOOTH = 5, 4, 2.0
KEPT_WORDS = 300_000  # tokens kept for reuse by a worker
CHUNK_CHARS = 2_000_000  # texts are measured together up to this size
TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[.!?;:]+(?=\s|$)|\n+|[,()](?!\d)")
TAG = re.compile(r"</?[A-Za-z!][^<>]*>|[\u00ad\u200b-\u200f\ufeff]")
TWICE = re.compile("[\u00c2\u00c3][^\x00-\x7f]|\u00e2[^\x00-\x7f]{2}")  # letters encoded twice
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
SPREAD = 2 + len(QUANTILES)
MIX = np.uint64(0x9E3779B97F4A7C15)
LENGTH = np.uint64(63)
SENTENCE, CLAUSE = 0, 64  # numbers of the marks between words: no word has a length of 0


def _once(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return m[0].encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m[0]


def clean(text: str) -> str:
    """Lower-case text without markup, entities and twice-encoded letters."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = TWICE.sub(_once, text)
        text = unicodedata.normalize("NFKC", text)
    return TAG.sub("", text).lower().replace("\r\n", "\n").replace("\r", "\n")


class Tokens:
    """Numbers of tokens, kept for reuse in a table of bounded size: a hash whose last six bits are the length; SENTENCE and CLAUSE for what ends them."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        except KeyError:
            if len(known) > KEPT_WORDS:
                known.clear()
            for w in tokens:
                if w not in known:
                    known[w] = (xxhash.xxh64_intdigest(w) & ~63) | min(len(w), 63) if w[0].isalpha() else CLAUSE if w[0] in ",()" else SENTENCE
            return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def kinds(h: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, documents) of words, of neighbouring words, and of words with the second one after."""
    two, three = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    return [(h, doc), (((h[:-1] * MIX) ^ h[1:])[two], doc[:-1][two]), (((h[:-2] * MIX * MIX) ^ h[2:])[three], doc[:-2][three])]


def spread(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Mean, deviation and quantiles of each document's values (all in [0, 4096)); zeros without values. doc is sorted."""
    count = np.bincount(doc, minlength=n)
    some = np.maximum(count, 1)
    mean = np.bincount(doc, values, minlength=n) / some
    var = np.bincount(doc, values * values, minlength=n) / some - mean * mean
    out = np.zeros((n, SPREAD))
    out[:, 0], out[:, 1] = mean, np.sqrt(np.maximum(var, 0))
    if len(values):
        ordered = np.sort(doc * 4096.0 + values) - doc * 4096.0  # the order inside each document
        start = np.cumsum(count) - count
        for i, q in enumerate(QUANTILES):
            at = np.minimum(start + np.minimum(some - 1, (q * count).astype(np.int64)), len(ordered) - 1)
            out[:, 2 + i] = np.where(count > 0, ordered[at], 0.0)
    return out


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]]


def read(texts: list[str], tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words, whether each opens a clause, their documents, fixed features): what doesn't depend on the labels - lengths, clauses, cohesion."""
    n = len(texts)
    cleaned = [clean(t) for t in texts]
    found = list(map(TOKEN.findall, cleaned))
    flat = tokens(list(itertools.chain.from_iterable(found)))
    doc = np.repeat(np.arange(n), [len(f) for f in found])
    word = (flat & LENGTH) != 0
    h, at = flat[word], doc[word]
    opens = np.concatenate([[False], flat[:-1] == CLAUSE])[: len(flat)][word]
    size = (h & LENGTH).astype(np.float64)
    count = np.maximum(np.bincount(at, minlength=n), 1)
    share = lambda x: np.bincount(at, x, minlength=n) / count

    starts = np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)]
    sentence = np.cumsum((flat == SENTENCE) | starts)[word]  # numbers of sentences, those without words skipped below
    clause = np.cumsum(~word | starts)[word]
    heads = np.flatnonzero(np.concatenate([[True], clause[1:] != clause[:-1]])) if len(clause) else np.zeros(0, np.int64)
    clauses = np.minimum(np.diff(np.append(heads, len(clause))), 4095).astype(np.float64)
    firsts = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(sentence) else np.zeros(0, np.int64)
    number = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(sentence))))
    lengths = np.minimum(np.diff(np.append(firsts, len(sentence))), 4095).astype(np.float64)
    of = at[firsts]
    per_sentence = np.minimum(np.bincount(number[heads], minlength=len(firsts)), 4095).astype(np.float64)

    shift, ones = np.uint64(36), np.uint64(1 << 36)
    long_ = size > 3
    seen = _distinct((number[long_].astype(np.uint64) << shift) | (h[long_] >> np.uint64(28)))  # (sentence, word)
    where = (seen >> shift).astype(np.int64)
    place = np.minimum(np.searchsorted(seen, seen - ones), max(0, len(seen) - 1))
    again = (where > 0) & (seen[place] == seen - ones) if len(seen) else np.zeros(0, bool)
    per = np.bincount(where, again, minlength=len(of)) / np.maximum(np.bincount(where, minlength=len(of)), 1)
    later = np.concatenate([[False], of[1:] == of[:-1]])[: len(of)]
    cohesion = np.bincount(of[later], per[later], minlength=n) / np.maximum(np.bincount(of[later], minlength=n), 1)

    different = _distinct((at.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))  # (document, word)
    variety = np.bincount((different >> np.uint64(40)).astype(np.int64), minlength=n) / np.sqrt(count)
    marks = np.array([[t.count(","), t.count("-"), t.count("?") + t.count("!"), t.count("\n")] for t in cleaned], dtype=np.float64).reshape(n, 4) / count[:, None]
    fixed = np.hstack([spread(size, at, n), np.stack([share(size >= 7), share(size >= 11), share(size >= 15)], axis=1), spread(lengths, of, n), spread(clauses, at[heads], n), spread(per_sentence, of, n), marks, cohesion[:, None], variety[:, None]])
    return h, opens, at, fixed


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of groups of whole texts of at most CHUNK_CHARS together, or of one longer text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK_CHARS:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


def measured(h: np.ndarray, doc: np.ndarray, n: int, tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Distributions of the difficulty of words, pairs and triples in each document, and of how readily words open a clause."""
    out, found = [], kinds(h, doc)
    for (keys, of), (known, grade) in zip([*found, found[0]], tables):
        if not len(known) or not len(keys):
            out.append(np.zeros((n, SPREAD + 1)))
            continue
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        there = known[at] == keys
        total = np.maximum(np.bincount(of, minlength=n), 1)
        out.append(np.hstack([spread(grade[at[there]], of[there], n), (np.bincount(of[there], minlength=n) / total)[:, None]]))
    return np.hstack(out)


def tables_of(docs: np.ndarray, keys: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys that enough documents have, and their smoothed mean grades."""
    known, where = np.unique(keys, return_inverse=True)
    n = np.bincount(where, minlength=len(known))
    total = np.bincount(where, grades[docs], minlength=len(known))
    mean = float(grades.mean()) if len(grades) else 0.0
    kept = n >= LEAST_DOCS
    return known[kept], ((total + SMOOTH * mean) / (n + SMOOTH))[kept]


def openers(h: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted words that occur often enough, and the smoothed share of their places that open a clause."""
    known, where = np.unique(h, return_inverse=True)
    n = np.bincount(where, minlength=len(known))
    share = float(opens.mean()) if len(opens) else 0.0
    kept = n >= LEAST_DOCS
    return known[kept], ((np.bincount(where, opens, minlength=len(known)) + SMOOTH * share) / (n + SMOOTH))[kept]


def _fitted(spark: SparkSession, x: np.ndarray, grades: np.ndarray, jobs: list[tuple[np.ndarray | None, np.ndarray | None]]) -> list:
    """One task for each job (rows to leave out, columns to use): predictions for the rows left out, or the trees fitted on all rows."""
    shared = spark.sparkContext.broadcast((x, grades, jobs))  # a bounded sample: at most MAX_LABELLED rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y, todo = shared.value
        for b in batches:
            for i in b.column("id").to_pylist():
                out, cols = todo[i]
                z = rows if cols is None else rows[:, cols]
                got = boosting.fit(z, y) if out is None else boosting.fit(z[~out], y[~out]).predict(z[out])
                yield pa.RecordBatch.from_pydict({"id": pa.array([i]), "made": pa.array([pickle.dumps(got)], pa.binary())})

    made = {r["id"]: pickle.loads(r["made"]) for r in spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "id bigint, made binary").collect()}
    return [made[i] for i in range(len(jobs))]


class Model:
    """Difficulty tables, trees and thresholds."""

    def __init__(self, spark: SparkSession, h: np.ndarray, opens: np.ndarray, doc: np.ndarray, fixed: np.ndarray, grades: np.ndarray, sources: list[str], plain: bool = False):
        """h, opens, doc: word hashes, whether they open a clause and the numbers of their documents, in order of the documents.

        plain: also predict the folds left out without the features learned from grades.
        """
        n = len(grades)
        self.folds = self._folds(sources)
        self.sources, self.grades = sources, grades
        once = []  # each key of a document once
        for keys, of in kinds(h, doc):
            order = np.lexsort((keys, of))
            keys, of = keys[order], of[order]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])[: len(keys)]
            once.append((keys[new], of[new]))

        def tables(use: np.ndarray):
            renumber = np.cumsum(use) - 1
            inside = use[doc]
            return [*(tables_of(renumber[of[use[of]]], keys[use[of]], grades[use]) for keys, of in once), openers(h[inside], opens[inside])]

        learned = np.zeros((n, 4 * (SPREAD + 1)))
        for f in np.unique(self.folds):
            mine = self.folds == f
            part = mine[doc]
            learned[mine] = measured(h[part], doc[part], n, tables(~mine))[mine]
        x = np.hstack([fixed, learned])
        ungraded = np.concatenate([np.arange(fixed.shape[1]), fixed.shape[1] + np.arange(3 * (SPREAD + 1), 4 * (SPREAD + 1))])
        outs = [self.folds == f for f in np.unique(self.folds) if (self.folds != f).any()]
        made = _fitted(spark, x, grades, [(None, None), *((out, None) for out in outs), *((out, ungraded) for out in outs if plain)])
        self.trees = made[0]
        self.out_of_fold, self.without = np.full(n, grades.mean()), np.full(n, grades.mean())
        for i, out in enumerate(outs):
            self.out_of_fold[out] = made[1 + i]
            if plain:
                self.without[out] = made[1 + len(outs) + i]
        self.cuts = boosting.cut_points(self.out_of_fold, grades)
        self.tables = tables(np.ones(n, bool))

    @staticmethod
    def _folds(sources: list[str]) -> np.ndarray:
        """Whole sources together, the largest dealt first; only where all documents have one source is that split."""
        names, where, counts = np.unique(np.array(sources), return_inverse=True, return_counts=True)
        if len(names) == 1:
            return np.arange(len(sources)) * FOLDS // len(sources)
        of, load = np.zeros(len(names), np.int64), np.zeros(FOLDS)
        for s in np.argsort(-counts, kind="stable"):
            of[s] = load.argmin()
            load[of[s]] += counts[s]
        return of[where]

    def grade(self, scores: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, scores, "right") + 1

    def left_out(self, scores: np.ndarray) -> np.ndarray:
        """Grades of the folds left out, by thresholds calibrated on the other folds."""
        out = np.zeros(len(scores), np.int64)
        for f in np.unique(self.folds):
            mine = self.folds == f
            rest = ~mine if (~mine).any() else mine
            out[mine] = np.searchsorted(boosting.cut_points(scores[rest], self.grades[rest]), scores[mine], "right") + 1
        return out

    def by_source(self) -> list[tuple[str, int, float, float, float]]:
        """(source, labelled documents, accuracy, mean absolute error, accuracy without graded words) of the folds left out."""
        got, plain = self.left_out(self.out_of_fold), self.left_out(self.without)
        out = []
        for s in sorted(set(self.sources)):
            at = np.array([x == s for x in self.sources])
            want = np.rint(self.grades[at])
            out.append((s, int(at.sum()), round(float((got[at] == want).mean()), 4), round(float(np.abs(self.out_of_fold[at] - self.grades[at]).mean()), 4), round(float((plain[at] == want).mean()), 4)))
        return out


MAX_CHARS = 2_000_000  # labelled documents longer than this are not fitted on
MAX_TOTAL = 32_000_000  # characters of all documents fitted on: at most 16 million words of 9 bytes come to the driver


def labels_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): the median of each document's distinct judgements."""
    once = labels.filter("doc_id is not null and reading_level between 1 and 4").select("doc_id", "reader", F.col("reading_level").cast("double").alias("g")).distinct()
    return once.groupBy("doc_id").agg(F.median("g").alias("grade"))


def train(documents: DataFrame, labels: DataFrame, plain: bool = False) -> Model | None:
    """The model, or None without labelled texts."""
    spark = documents.sparkSession
    sample = labels_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)  # bounded, so it may be broadcast
    usable = documents.filter(F.col("text").isNotNull() & (F.col("n_chars") <= MAX_CHARS))
    sizes = usable.select("doc_id", "n_chars").join(F.broadcast(sample), "doc_id")
    upto = F.sum("n_chars").over(Window.partitionBy().orderBy(F.xxhash64("doc_id"), "doc_id"))  # of the bounded sample
    sample = sizes.withColumn("upto", upto).filter(F.col("upto") <= MAX_TOTAL).select("doc_id", "grade")
    texts = usable.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            for start, part in chunks(b.column("text").to_pylist()):
                h, opens, doc, fixed = read(part, tokens)
                ends = np.cumsum(np.bincount(doc, minlength=len(part)))
                cols = {c: b.column(c).slice(start, len(part)) for c in ("doc_id", "source", "grade")}
                each = lambda v: pa.array([v[a:z].tobytes() for a, z in zip(np.append(0, ends[:-1]), ends)], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_pydict(cols | {"hashes": each(h), "opens": each(opens), "fixed": pa.array(list(fixed), pa.list_(pa.float64()))})

    ddl = "doc_id bigint, source string, grade double, hashes binary, opens binary, fixed array<double>"
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "source", "grade").mapInArrow(run, ddl).toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return None
    words = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
    opens = np.frombuffer(b"".join(rows.column("opens").to_pylist()), bool)
    doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return Model(spark, np.concatenate(words), opens, doc, np.array(rows.column("fixed").to_pylist()), rows.column("grade").to_numpy(), rows.column("source").to_pylist(), plain)


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, reading_level) of the documents of running prose."""
    prose = documents.filter("coalesce(doc_kind, '') <> 'log' and n_chars >= 200 and text is not null").select("doc_id", "text")
    if model is None:
        return prose.select("doc_id", F.lit(2).alias("reading_level"))
    shared = documents.sparkSession.sparkContext.broadcast((model.tables, model.trees, model.cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, trees, cuts = shared.value
        tokens = Tokens()
        for b in batches:
            for start, part in chunks(b.column("text").to_pylist()):
                h, _, doc, fixed = read(part, tokens)
                x = np.hstack([fixed, measured(h, doc, len(part), tables)])
                grade = np.searchsorted(cuts, trees.predict(x), "right") + 1
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(start, len(part)), "reading_level": pa.array(grade.astype(np.int32))})

    return prose.mapInArrow(run, "doc_id bigint, reading_level int")


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, train(documents, labels))


def validation(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, n_labelled, accuracy, mean_abs_error, accuracy_ungraded) of predictions for sources left out as a whole (parts of it, if there is only one).

    accuracy_ungraded: without the features that the grades of other documents give to words and pairs.
    """
    model = train(documents, labels, plain=True)
    rows = model.by_source() if model else []
    return documents.sparkSession.createDataFrame(rows, "source string, n_labelled bigint, accuracy double, mean_abs_error double, accuracy_ungraded double")


def profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, doc_kind, reading_level, n_docs): how demanding the corpus is."""
    levels = reading_levels(documents, labels)
    about = documents.select("doc_id", "source", "doc_kind")
    return levels.join(about, "doc_id").groupBy("source", "doc_kind", "reading_level").agg(F.count("*").alias("n_docs"))
