"""The reading level of documents, by smoothed unigram language models per grade."""

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.functions.characters import DIRTY_PY
from strophe.llm.fitting import smallest
from strophe.llm.lookalike import skeleton
from strophe.session import ship

GRADES = (1, 2, 3, 4, 5)
#: Weight of a grade's own words against those of all grades (Jelinek-Mercer smoothing).
OWN = 0.7
#: Most labelled documents that the models are fitted on, those with the smallest hashes; all of their words count.
FIT_DOCUMENTS = 20_000
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TAG = re.compile(r"\[\w+\]")


def words(text: str) -> list[str]:
    """The words of a text, without tags, case and look-alikes."""
    t = skeleton(text) if DIRTY_PY.search(text) else text
    return _WORD.findall(_TAG.sub(" ", t).lower().replace("’", "'"))


def _words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        counts = [Counter(words(t)) for t in b.column(1).to_pylist()]
        grade = [g for g, c in zip(b.column(0).to_pylist(), counts) for _ in c]
        yield pa.RecordBatch.from_arrays([pa.array(grade, pa.int32()), pa.array([w for c in counts for w in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())], ["g", "w", "n"])


class Models:
    """A log-likelihood per word and grade, and the grades' priors."""

    def __init__(self, counts: list[tuple[int, str, int]], priors: dict[int, int]):
        by = {g: Counter() for g in GRADES}
        for g, w, n in counts:
            by[g][w] += n
        total = Counter()
        for c in by.values():
            total.update(c)
        size, every = {g: sum(c.values()) for g, c in by.items()}, sum(total.values())
        self.prior = [math.log((priors.get(g, 0) + 0.5) / (sum(priors.values()) + 0.5 * len(GRADES))) for g in GRADES]
        self.like = {
            w: tuple(math.log(OWN * by[g][w] / size[g] + (1 - OWN) * n / every if size[g] else n / every) for g in GRADES) for w, n in total.items()
        }

    def grade(self, text: str) -> tuple[int, float]:
        """The grade with the highest posterior (of equal ones the lowest), and that posterior; words that no labelled text has don't count."""
        return self.judge(Counter(words(text)))

    def judge(self, counts: Counter) -> tuple[int, float]:
        """grade() of a text with so many of each word."""
        s = list(self.prior)
        for w, n in counts.items():
            if p := self.like.get(w):
                s = [a + n * b for a, b in zip(s, p)]
        top = max(s)
        return GRADES[s.index(top)], 1 / sum(math.exp(x - top) for x in s)


def fit(labelled: DataFrame, text: str = "text", grade: str = "grade", key: str = "doc_id") -> Models:
    """Models fitted on labelled texts (key, text, grade); null texts and keys, and grades outside GRADES, are left out.

    Words are counted where the texts are and added up over all tasks; the driver
    gets the counts of the words of at most FIT_DOCUMENTS documents.
    """
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(grade).cast("int").alias("g"), F.col(text).alias("t"), F.xxhash64(F.lit(5), key, text).alias("h")).where(F.col("g").isin(*GRADES))
    rows = smallest(rows, F.col("h"), FIT_DOCUMENTS).select("g", "t")
    counts = rows.mapInArrow(_words, "g int, w string, n bigint").groupBy("g", "w").agg(F.sum("n").alias("n")).collect()
    return Models(sorted((r.g, r.w, r.n) for r in counts), {r.g: r["count"] for r in rows.groupBy("g").count().collect()})


def _grade(it: Iterator[pa.RecordBatch], models: Broadcast) -> Iterator[pa.RecordBatch]:
    m = models.value
    for b in it:
        got = [m.grade(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g for g, _ in got], pa.int32()), pa.array([p for _, p in got], pa.float64())], ["k", "grade", "posterior"])


def _every(it: Iterator[pa.RecordBatch], models: Broadcast) -> Iterator[pa.RecordBatch]:
    m = models.value
    for b in it:
        counts = [Counter(words(t or "")) for t in b.column(1).to_pylist()]
        known = [sum(n for w, n in c.items() if w in m.like) for c in counts]
        got = [m.judge(c) if n else (None, None) for c, n in zip(counts, known)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([g for g, _ in got], pa.int32()), pa.array([p for _, p in got], pa.float64()), pa.array(known, pa.int64())], ["doc_id", "grade", "posterior", "known"]
        )


def levels(df: DataFrame, models: Models, key: str = "doc_id", text: str = "text", least: int = 0) -> DataFrame:
    """(key, grade, posterior) of every text of at least so many characters.

    Null texts, and shorter ones, have no row; texts are read whole; null keys and
    repeated rows are kept. A text without a known word gets the most frequent
    grade. One pass, no shuffle; the models (the words of at most FIT_DOCUMENTS
    documents, five numbers each) are broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(models)
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") >= least)
    kind = src.schema["k"].dataType.simpleString()
    return src.mapInArrow(partial(_grade, models=shared), f"k {kind}, grade int, posterior double").withColumnRenamed("k", key)


def every_level(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, grade, posterior, known) of every document, whatever its language and length; the models are fitted on the English ones.

    known is the number of words in the text that the models have. Grade and
    posterior are null where it is 0, as for null, empty and wordless texts; where
    it is small against the text, as in most other languages, the grade says little.
    """
    models = fit(documents.where("lang = 'en'").select("doc_id", "text").join(labels.select("doc_id", "grade"), "doc_id"))
    shared = documents.sparkSession.sparkContext.broadcast(models)
    return documents.select("doc_id", "text").mapInArrow(partial(_every, models=shared), "doc_id bigint, grade int, posterior double, known bigint")


def ungraded(documents: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """(doc_id, grade) of the English documents of at least so many characters without a label."""
    english = documents.where("lang = 'en'").select("doc_id", "text")
    models = fit(english.join(labels.select("doc_id", "grade"), "doc_id"))
    rest = english.join(labels.select("doc_id"), "doc_id", "left_anti")
    return levels(rest, models, least=least).select("doc_id", "grade")
