"""Language ID by unigram pieces: per-language piece probabilities, summed over all segmentations of a word.

The pieces are those of a fixed public vocabulary; a language is one probability per piece, fitted by
expectation-maximisation on labelled texts.  A word's likelihood is the sum over all ways to cut it into pieces
(forward algorithm), a text's the product over its words.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandfold.llm.common import append_arrow, materialise, register, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
# A longer run of letters is cut into words of this many letters, so that likelihoods stay above the least double.
LONGEST = 32
START = "▁"
CACHE = 400_000
BLOCK = 20_000
FLOOR = 1e-8
SMOOTH = 0.05


def vocabulary(path: str = VOCABULARY) -> dict[str, int]:
    """Piece numbers (from 1) of the lower-case letter pieces; 0 stands for a letter that no piece covers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(k) for k in range(model.get_piece_size()))
    letters = sorted({p for p in pieces if p.lower() == p and (p.replace(START, "", 1).isalpha() or p == START)})
    return {p: k for k, p in enumerate(letters, 1)}


def words(text: str | None) -> list[str]:
    """Lower-case words of letters, each with the mark that starts a word; very long runs are cut."""
    out = []
    for run in LETTERS.findall((text or "").lower()):
        if len(run) <= LONGEST:
            out.append(START + run)
        else:
            out += [START + run[k : k + LONGEST] for k in range(0, len(run), LONGEST)]
    return out


class Lattice:
    """Forward and backward sums over the segmentations of many words of one length at a time."""

    def __init__(self, pieces: dict[str, int]):
        self.pieces = pieces
        self.reach = max(map(len, pieces), default=1)

    def arcs(self, group: list[str]):
        """(start, end, piece numbers) of all arcs of words of equal length; -1: no such piece."""
        size, get = len(group[0]), self.pieces.get
        for end in range(1, size + 1):
            for start in range(max(0, end - self.reach), end):
                missing = 0 if end - start == 1 else -1
                ids = np.array([get(w[start:end], missing) for w in group])
                if (ids >= 0).any():
                    yield start, end, ids

    def forward(self, group: list[str], table: np.ndarray, arcs=None) -> np.ndarray:
        """Sums up to every position: (length + 1, words, languages); ``table`` has a zero row at -1."""
        sums = np.zeros((len(group[0]) + 1, len(group), table.shape[1]))
        sums[0] = 1.0
        for start, end, ids in arcs if arcs is not None else self.arcs(group):
            sums[end] += sums[start] * table[ids]
        return sums

    def expected(self, group: list[str], counts: np.ndarray, table: np.ndarray, into: np.ndarray) -> None:
        """Add the expected piece counts of the words under one language to ``into``."""
        arcs = list(self.arcs(group))
        ahead = self.forward(group, table, arcs)[:, :, 0]
        back = np.zeros_like(ahead)
        back[-1] = 1.0
        for start, end, ids in sorted(arcs, key=lambda a: -a[1]):
            back[start] += back[end] * table[ids, 0]
        for start, end, ids in arcs:
            share = counts * ahead[start] * table[ids, 0] * back[end] / ahead[-1]
            np.add.at(into, ids, share)


def by_length(items: list[str]) -> list[list[str]]:
    found = defaultdict(list)
    for w in items:
        found[len(w)].append(w)
    return list(found.values())


def padded(table: np.ndarray) -> np.ndarray:
    """The table with a last row of zeros, which index -1 reaches."""
    return np.vstack([table, np.zeros((1, table.shape[1]))])


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` labelled rows of each language, the first by a hash; label and text not null.

    Rows are picked by keys alone, and only the rows within the bound meet in a task.
    """
    some = docs.filter("lang is not null and text is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = some.select("doc_id", "lang").withColumn("place", F.row_number().over(order))
    ids = ids.filter(F.col("place") <= per_language).select("doc_id", "lang").distinct()
    return some.select("doc_id", "lang", "text").join(ids, ["doc_id", "lang"], "left_semi")


class Model:
    """Languages, pieces and the (pieces, languages) table of probabilities; its size is that of the vocabulary."""

    def __init__(self, languages: list[str], pieces: dict[str, int], table: np.ndarray):
        self.languages, self.pieces, self.table = languages, pieces, table


def train(labelled: DataFrame, path: str = VOCABULARY, per_language: int = 1500, rounds: int = 3) -> Model:
    """Fit piece probabilities per language on a bounded sample of ``labelled`` (doc_id, lang, text).

    ``per_language`` bounds the sampled documents of a language.  The word counts of the sample stay in Spark; every
    round sums expected piece counts there, and only languages x pieces numbers reach the driver.
    """
    pieces = vocabulary(path)
    chosen = sample(labelled, per_language)

    def count(batches):
        for texts in batches:
            rows = [Counter(words(t)) for t in texts]
            yield ([[{"word": w, "n": n} for w, n in c.items()] for c in rows],)

    each = append_arrow(chosen, {"counts": "array<struct<word:string,n:long>>"}, count, ["lang"])
    each = each.select("lang", F.inline("counts")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialise(each, "word-counts")
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    size = len(pieces) + 1
    place = {name: k for k, name in enumerate(languages)}
    fitted = np.full((size, len(languages)), 1.0 / size)
    context = counts.sparkSession.sparkContext
    for _ in range(rounds if languages else 0):
        shared = context.broadcast((pieces, fitted))

        def expect(batches, shared=shared):
            pieces, fitted = shared.value
            lattice, sums = Lattice(pieces), {}
            for batch in batches:
                found = defaultdict(list)
                for name, word, n in zip(*[c.to_pylist() for c in batch.columns]):
                    found[name, len(word)].append((word, n))
                for (name, _), rows in found.items():
                    column = padded(fitted[:, [place[name]]])
                    into = sums.setdefault(name, np.zeros(size + 1))
                    n = np.array([c for _, c in rows], dtype=float)
                    lattice.expected([w for w, _ in rows], n, column, into)
            for name, into in sums.items():
                used = np.flatnonzero(into[:size])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(used)), pa.array(used), pa.array(into[used])], names=["lang", "piece", "n"])

        parts = counts.select("lang", "word", "n").mapInArrow(expect, "lang string, piece long, n double")
        found = parts.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        fitted = np.zeros_like(fitted)
        fitted[found.piece.to_numpy(), found.lang.map(place).to_numpy()] = found.n.to_numpy()
        fitted = np.maximum((fitted + SMOOTH) / (fitted + SMOOTH).sum(0), FLOOR)
    return Model(languages, pieces, fitted)


class Scorer:
    """Log-likelihoods of texts under every language, with a bounded cache of words."""

    def __init__(self, model: Model):
        self.lattice, self.table = Lattice(model.pieces), padded(model.table)
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((CACHE, len(model.languages)))

    def learn(self, new: list[str]) -> None:
        """Likelihoods of many words at once, by length, in blocks of bounded size."""
        for group in by_length(new):
            for k in range(0, len(group), BLOCK):
                part = group[k : k + BLOCK]
                at = len(self.rows)
                self.logs[at : at + len(part)] = np.log(self.lattice.forward(part, self.table)[-1])
                self.rows.update(zip(part, range(at, at + len(part))))

    def ready(self, counts: list[Counter]) -> None:
        """Have the likelihoods of all words of a batch of texts at hand; starts over when the cache is full."""
        new = [w for w in set().union(*counts) if w not in self.rows]
        if len(self.rows) + len(new) > len(self.logs):
            self.rows.clear()
            new = list(set().union(*counts))
            self.logs = np.zeros((max(CACHE, len(new)), self.logs.shape[1]))
        self.learn(new)

    def score(self, counts: Counter) -> np.ndarray:
        rows = self.rows
        at = np.fromiter(map(rows.__getitem__, counts), dtype=np.int64, count=len(counts))
        return np.fromiter(counts.values(), dtype=float, count=len(counts)) @ self.logs[at]


_SCORERS: dict[str, Scorer] = {}


def scorer_of(name: str, model: Model) -> Scorer:
    """The scorer of a broadcast model, kept by the worker process over its tasks; only the last one is kept."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(model)
    return _SCORERS[name]


def judge(scorer: Scorer, languages: list[str], counts: Counter) -> tuple[str, float]:
    """(language, its probability among the learned ones, all equally likely beforehand)."""
    if not counts or not languages:
        return UNKNOWN, 0.0
    logs = scorer.score(counts)
    best = int(np.argmax(logs))
    return languages[best], float(1.0 / np.exp(logs - logs[best]).sum())


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) plus lang_pred and score for every whole text.

    Null texts, texts without a letter, and any text if nothing was learned get ``und`` and score 0.  Ties go to the
    language whose name sorts first.  Clashing columns of ``docs`` are replaced.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make(batches):
        model = shared.value
        scorer = scorer_of(name, model)
        for texts in batches:
            counts = [Counter(words(t)) for t in texts]
            scorer.ready(counts)
            rows = [judge(scorer, model.languages, c) for c in counts]
            yield [r[0] for r in rows], [r[1] for r in rows]

    return append_arrow(docs, {"lang_pred": "string", "score": "double"}, make, keep)


def held_out():
    """The documents that no model may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def learned(docs: DataFrame) -> Model:
    """A model of the labelled documents that are not held out."""
    return train(docs.filter(~F.coalesce(held_out(), F.lit(False))))


@register("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, and whether its id holds it out of training."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learned(docs), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
