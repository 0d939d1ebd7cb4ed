"""Language identification by multilingual mixture inference.

A document is a mixture of languages over its byte n-grams (Lui, Lau, Baldwin
2014): expectation-maximisation estimates the proportions; the language set is
the one whose likelihood, less a penalty for every further language, is best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..ship import ship
from .common import U64, filtered, pieces

#: Labelled documents to learn from for each language (expected number); n-gram buckets; n-grams kept; languages at most, beyond it is an error (their counts are 128 MB then).
SAMPLE, BUCKETS, KEPT, LANGUAGES = 4000, 1 << 14, 2048, 1024
#: Rounds of expectation-maximisation; penalty for a further language, in log likelihood per ln(n-grams).
ROUNDS, PENALTY = 15, 3.0


def grams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lowered text, runs of other than letters as one space."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    b = np.where((b < 97) | ((b > 122) & (b < 128)), np.uint8(32), b)
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))].astype(np.uint64)
    with np.errstate(over="ignore"):
        code = (b[:-2] << U64(16) | b[1:-1] << U64(8) | b[2:]) * U64(0x9E3779B97F4A7C15)
    return (code >> U64(50)).astype(np.int64)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo n; a null id: of 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % n


class Model:
    """Selected n-grams and their log probabilities by language."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray):
        self.languages = languages
        self.prior = documents / documents.sum()
        p = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        mean = p.mean(axis=0)
        gain = (p * np.log(p / mean)).sum(axis=0)  # what an n-gram tells about the language
        self.kept = np.sort(np.argsort(-gain, kind="stable")[:KEPT])
        p = p[:, self.kept]
        self.p = (p / p.sum(axis=1, keepdims=True)).T.copy()
        self.log_p = np.log(self.p)

    def mixture(self, n: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Proportions (docs, languages) of the allowed languages that fit the counts (docs, n-grams)."""
        pi = allowed / allowed.sum(axis=1, keepdims=True)
        total = np.maximum(n.sum(axis=1, keepdims=True), 1)
        for _ in range(ROUNDS):
            pi = pi * ((n / (pi @ self.p.T)) @ self.p) / total
        return pi / pi.sum(axis=1, keepdims=True)

    def likelihood(self, n: np.ndarray, pi: np.ndarray) -> np.ndarray:
        return (n * np.log(pi @ self.p.T)).sum(axis=1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[list[str]]]:
        """Language, its proportion and the language set of each text."""
        letters = [t is not None and any(map(str.isalpha, t)) for t in texts]
        at = np.flatnonzero(letters)
        lang, score, sets = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
        if not len(at) or not self.languages:
            return lang, score, sets
        n = np.stack([np.bincount(grams(texts[i]), minlength=BUCKETS)[self.kept] for i in at]).astype(float)
        some = n.sum(axis=1) > 0
        single = n @ self.log_p + np.log(self.prior)
        best = single.argmax(axis=1)
        pi = np.tile(self.prior, (len(at), 1))
        if some.any():
            pi[some] = self.mixture(n[some], np.ones((int(some.sum()), len(self.languages))))
        chosen = np.zeros_like(pi, bool)
        chosen[np.arange(len(at)), best] = True
        penalty = PENALTY * np.log(np.maximum(n.sum(axis=1), 2))
        open_ = some & (self.likelihood(n, np.maximum(pi, 1e-300)) - (n * self.log_p.T[best]).sum(axis=1) > penalty)
        fit = np.where(some, (n * self.log_p.T[best]).sum(axis=1), 0.0)
        final = pi.copy()
        while open_.any() and len(self.languages) > 1:
            # the language of the largest share that is not in the set yet joins if the likelihood pays for it
            i = np.flatnonzero(open_)
            share = np.where(chosen[i], -1, pi[i])
            more = chosen[i].copy()
            more[np.arange(len(i)), share.argmax(axis=1)] = True
            mixed = self.mixture(n[i], more.astype(float))
            value = self.likelihood(n[i], np.maximum(mixed, 1e-300))
            pays = (value - fit[i] > penalty[i]) & (share.max(axis=1) > 0)
            chosen[i[pays]], fit[i[pays]] = more[pays], value[pays]
            final[i[pays]] = mixed[pays]
            open_[i[~pays]] = False
            open_[chosen.all(axis=1)] = False
        one = chosen.sum(axis=1) == 1
        top = np.where(one, best, final.argmax(axis=1))
        for k, i in enumerate(at):
            lang[i], score[i] = self.languages[top[k]], min(1.0, max(0.0, float(final[k, top[k]])))
            sets[i] = [self.languages[j] for j in np.flatnonzero(chosen[k])]
        return lang, score, sets


def trained(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fold_n: int | None = None, held: int | None = None) -> Model:
    """A model of the languages of ``docs``: about ``sample`` labelled documents for each, chosen by a hash of the id.

    Of ``fold_n`` folds, ``held`` is left out. The counts are sums over the
    sample made by the executors; the driver gets LANGUAGES x BUCKETS numbers
    at most. All languages are learned; more than LANGUAGES raise a ValueError.
    """
    ship(docs.sparkSession)
    d = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang")).where("text is not null and lang is not null")
    if fold_n:
        d = d.where(fold(F.col("doc_id"), fold_n) != held)
    found = d.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of {lang}")
    if not found:
        return Model([], np.ones((1, BUCKETS)), np.ones(1))
    names = sorted(r["lang"] for r in found)
    n = {r["lang"]: r["n"] for r in found}
    share = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, sample / n[k]))])
    chance = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    d = d.where(chance < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums.setdefault(k, np.zeros(BUCKETS, np.int64))[:] += np.bincount(grams(t), minlength=BUCKETS)
        for k, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])

    counts = np.zeros((len(names), BUCKETS))
    rows = d.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    at = {k: i for i, k in enumerate(names)}
    which = np.array([at[k] for k in rows.column("lang").to_pylist()], int)
    counts[which, rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return Model(names, counts, np.array([n[k] for k in names], float))


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, languages of every row of ``docs``.

    lang_pred is the language of the largest estimated proportion within the
    language set ``languages``, score that proportion: in the mixture of the
    set where it has several languages, in that of all learned languages (how
    little the text needs the others) where it has one; 'und', 0 and an empty
    set where the text is null or has no letter, or nothing was learned. A text
    with letters but no known n-gram gets the most frequent language and its
    frequency. Whole texts are read; repeated rows each get a row, a null
    doc_id stays null, an empty table gives no rows, other columns take no
    part. One scan, no shuffle.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 128):
            lang, score, sets = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string()))], names=["doc_id", "lang_pred", "score", "languages"])

    slim = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>")


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``identify`` gives a language, with all columns: texts with a letter; none if nothing was learned. One scan, no shuffle."""
    return filtered(docs, text, lambda texts: [k != "und" for k in model.predict(texts)[0]], 128)
