"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and word prefixes, each at levels 1, 2, 4, 8 of how often a document has it.  From
the labelled examples Spark counts in how many toxic and clean ones each term occurs; the terms that
mark toxic ones beyond chance (G-test) span the vector space, so the length of ordinary prose does
not drown them.  The index over the examples has postings in aligned blocks with the largest weight
of each term per block.  A query bounds every block by its block maxima and reads blocks from the
best bound down until the k-th similarity found is no less than the next bound: the k nearest are
exact.  Their labels vote with weight 1 / (distance + eps) against a prior, which gives a calibrated
score; the ids of the nearest are the evidence.  Texts without any term stand next to all examples
without one, and score what those show.

The examples are a bounded sample (``MAX_EXAMPLES`` labelled rows, in the order of a hash of their
id), so the index has a size that is known before it is broadcast.  All documents are scored, whole.

Defined results: null text is empty; an unlabelled or empty label table gives the score 0 to all;
labels that are null are no examples, several labels of an id count once (the largest); a null id is
scored, not held out; an empty table gives an empty result; further columns are ignored (kept by
``drop_toxic``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._scratch import materialize, tidy

MAX_EXAMPLES = 16_000
MAX_TERMS = 20_000
MIN_TOXIC_EXAMPLES = 4
MIN_G = 15.0
NEIGHBOURS = 25
BLOCK = 64
EPSILON = 0.05
PRIOR_WEIGHT = 1.0
PREFIXES = (3, 4, 5, 6)
LEVELS = (1, 2, 4, 8)
THRESHOLD = 0.3
KEPT_WORDS = 150_000

_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def stems(word: str) -> list[str]:
    """The word and its prefixes, which are marked by a star."""
    return [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n]]


def term_counts(text: str) -> Counter:
    """How often the text has each word and prefix."""
    counts: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for stem in stems(word):
            counts[stem] += n
    return counts


def levelled(stem: str, n: int) -> list[str]:
    """The terms for a stem that occurs n times."""
    return [f"{stem}:{level}" for level in LEVELS if n >= level]


def _examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of at most MAX_EXAMPLES labelled rows that are not held out."""
    marked = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_EXAMPLES)
    )
    # rows that repeat an id are one example, so their number is bounded too
    return docs.join(F.broadcast(marked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def _term_table(examples: DataFrame) -> DataFrame:
    """(term, toxic_examples, clean_examples), counted per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        def flush():
            rows = [(term, toxic, n) for (term, toxic), n in seen.items()]
            seen.clear()
            columns = list(zip(*rows)) if rows else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()))], names=["term", "toxic", "n"])
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                for stem, n in term_counts(text.as_py() or "").items():
                    for term in levelled(stem, n):
                        seen[term, toxic] += 1
                if len(seen) > 100_000:
                    yield flush()
        yield flush()

    counted = examples.select("text", "toxic").mapInArrow(tidy(count), "term string, toxic int, n long")
    return counted.groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("in_toxic"),
        F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("in_clean"),
    )


def telling_terms(examples: DataFrame, toxic: int, clean: int) -> list[tuple[str, float]]:
    """[(term, idf)] of the terms that mark toxic examples beyond chance; MAX_TERMS at most."""
    seen = F.col("in_toxic") + F.col("in_clean")
    share = toxic / (toxic + clean)
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    g = 2 * (part(F.col("in_toxic"), seen * share) + part(F.col("in_clean"), seen * (1 - share)))
    chosen = (
        _term_table(examples)
        .where((F.col("in_toxic") >= MIN_TOXIC_EXAMPLES) & (F.col("in_toxic") > seen * share * 2))
        .select("term", g.alias("g"), F.log((toxic + clean + 1) / seen).alias("idf"))
        .where(F.col("g") >= MIN_G)
        .orderBy(F.desc("g"), "term")
        .limit(MAX_TERMS)
    )
    return [(r["term"], r["idf"]) for r in chosen.collect()]


class Vectoriser:
    """Texts to sparse unit vectors over the telling terms."""

    def __init__(self, terms: list[tuple[str, float]]) -> None:
        self.idf = np.array([idf for _, idf in terms], np.float64)
        self.ids: dict[str, list[tuple[int, int]]] = {}
        for k, (term, _) in enumerate(terms):
            stem, _, level = term.rpartition(":")
            self.ids.setdefault(stem, []).append((int(level), k))
        self.heads = {stem[:3].rstrip("*") for stem in self.ids}
        self.known: dict[str, tuple[str, ...]] = {}

    def _stems(self, word: str) -> tuple[str, ...]:
        """The telling stems of a white-space delimited word, once for each time they occur in it."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        found = self.known[word] = tuple(s for part in _WORD.findall(word) for s in stems(part) if s in self.ids)
        return found

    def terms(self, text: str) -> tuple[int, ...]:
        """The sorted term numbers of the text."""
        words = text.lower().split()
        known, heads, hits = self.known, self.heads, {}
        for word in [w for w in set(words) if w[:3] in heads or not w.isalpha()]:
            if found := known[word] if word in known else self._stems(word):
                hits[word] = found
        if not hits:
            return ()
        counts: Counter = Counter()
        for word in words:
            for stem in hits.get(word, ()):
                counts[stem] += 1
        return tuple(sorted(k for stem, n in counts.items() for level, k in self.ids[stem] if n >= level))


class BlockMaxIndex:
    """Exact k nearest examples by cosine, with postings in aligned blocks of example numbers."""

    def __init__(self, idf: np.ndarray, vectors: list[tuple[int, ...]], labels: list[int], names: list[int]) -> None:
        # alike examples next to each other make block maxima telling
        order = sorted(range(len(vectors)), key=lambda i: (sorted(vectors[i], key=lambda t: -idf[t])[:3], names[i]))
        self.idf = idf
        self.labels = np.array([labels[i] for i in order], np.float64)
        self.names = np.array([names[i] for i in order], np.int64)
        term = np.array([t for i in order for t in vectors[i]], np.int64)
        owner = np.array([k for k, i in enumerate(order) for _ in vectors[i]], np.int64)
        norm = np.sqrt(np.bincount(owner, idf[term] ** 2, minlength=len(order)))
        weight = idf[term] / norm[owner] if len(term) else np.empty(0)
        blocks = max(1, -(-len(order) // BLOCK))
        by = np.lexsort((owner, term))
        self.owner, self.weight = owner[by], weight[by]
        key = term[by] * blocks + owner[by] // BLOCK
        self.cuts = np.searchsorted(key, np.arange(len(idf) * blocks + 1)).astype(np.int64)
        self.most = np.zeros(len(idf) * blocks, np.float32)
        np.maximum.at(self.most, key, np.nextafter(self.weight.astype(np.float32), np.float32(2)))
        self.most = self.most.reshape(len(idf), blocks)
        self.blocks = blocks

    def _similar(self, t: np.ndarray, q: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, similarities) of the examples in ``blocks`` that share a term."""
        key = (t[:, None] * self.blocks + blocks).ravel()
        start, size = self.cuts[key], self.cuts[key + 1] - self.cuts[key]
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        weight = np.repeat(np.repeat(q, len(blocks)), size) * self.weight[at]
        shift = np.tile((np.arange(len(blocks)) - blocks) * BLOCK, len(t))
        total = np.bincount(self.owner[at] + np.repeat(shift, size), weight, len(blocks) * BLOCK)
        hit = np.flatnonzero(total)
        return blocks[hit // BLOCK] * BLOCK + hit % BLOCK, total[hit]

    def nearest(self, terms: tuple[int, ...], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, similarities), nearest first; ties by the smaller id."""
        t = np.array(terms)
        q = self.idf[t] / np.sqrt((self.idf[t] ** 2).sum())
        bound = q @ self.most[t] + 1e-6
        order = np.argsort(-bound, kind="stable")
        order = order[: np.searchsorted(-bound[order], -1e-6)]
        found, sims, kth, at, step = np.empty(0, np.int64), np.empty(0), -1.0, 0, 8
        while at < len(order) and bound[order[at]] >= kth:
            more, near = self._similar(t, q, order[at : at + step])
            at, step = at + step, 2 * step  # few reads where the bounds are loose
            found, sims = np.concatenate([found, more]), np.concatenate([sims, near])
            best = np.lexsort((self.names[found], -sims))[:k]
            found, sims = found[best], sims[best]
            if len(found) >= k:
                kth = sims[-1]
        return found, sims


class Judge:
    """Scores texts; built once per Python worker from the broadcast model."""

    def __init__(self, model: dict) -> None:
        self.vectoriser = Vectoriser(model["terms"])
        self.index = BlockMaxIndex(self.vectoriser.idf, model["vectors"], model["labels"], model["names"])
        self.blank, self.prior = model["blank"], model["prior"]
        self.votes = lru_cache(maxsize=20_000)(self._vote)

    def _vote(self, terms: tuple[int, ...]) -> tuple[float, list[int]]:
        found, sims = self.index.nearest(terms, NEIGHBOURS)
        weight = sims / (1 - np.minimum(sims, 1) + EPSILON)
        score = ((weight * self.index.labels[found]).sum() + PRIOR_WEIGHT * self.prior) / (weight.sum() + PRIOR_WEIGHT)
        return float(score), self.index.names[found[:3]].tolist()

    def score(self, text: str) -> tuple[float, list[int]]:
        """(score, ids of the nearest examples)."""
        terms = self.vectoriser.terms(text)
        return self.votes(terms) if terms else (self.blank, [])


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: telling terms and example vectors, bounded by MAX_EXAMPLES and MAX_TERMS."""
    examples = materialize(_examples(docs, labels), "examples")
    sizes = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, total = sizes.get(1, 0), sum(sizes.values())
    if not total:
        return {"terms": [], "vectors": [], "labels": [], "names": [], "blank": 0.0, "prior": 0.0}
    terms = telling_terms(examples, toxic, total - toxic) if toxic else []

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Vectoriser(terms)
        for batch in batches:
            made = [list(make.terms(text.as_py() or "")) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms"])

    # at most MAX_EXAMPLES short rows
    rows = examples.mapInArrow(tidy(vectors), "doc_id long, toxic int, terms array<int>").collect()
    blank = [r["toxic"] == 1 for r in rows if not r["terms"]]
    there = [r for r in rows if r["terms"]]
    prior = toxic / total
    return {
        "terms": terms,
        "vectors": [tuple(r["terms"]) for r in there],
        "labels": [int(r["toxic"] == 1) for r in there],
        "names": [r["doc_id"] for r in there],
        "blank": (sum(blank) + prior) / (len(blank) + 1),
        "prior": prior,
    }


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Judge(model.value)
        for batch in batches:
            out = [made.score(text.as_py() or "") for text in batch.column(1)]
            scores = pa.array([s for s, _ in out], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores, pa.array([e for _, e in out], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    return texts.mapInArrow(tidy(judge), "doc_id long, score double, evidence array<long>").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, all columns as they were; one pass, no shuffle of texts."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")))
    text_at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Judge(model.value)
        for batch in batches:
            keep = [made.score(text.as_py() or "")[0] < THRESHOLD for text in batch.column(text_at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(clean), docs.schema)
