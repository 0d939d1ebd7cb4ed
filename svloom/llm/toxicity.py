"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.
A window of a text is compressed with the ordinary dictionary alone and with
both; the difference of the two lengths is its distance towards toxic text. How
many windows of a text lie beyond a few distances, and the largest of them, are
turned into a probability by weights calibrated on labelled documents that had
no part in the dictionaries.

Most of a toxic document is ordinary text. So the toxic dictionary is trained in
rounds: first on all windows of the toxic texts, then on those of them whose
distance is beyond that of nearly all ordinary windows. Windows are judged by a
dictionary trained on the other half of the texts. A passage of three words that
several texts repeat is learned once, so copies do not pass for a manner of
speaking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..ship import ship
from .common import MIX_A, U64, filtered, mixed, pieces, word_hashes, written
from .language import fold

#: Labelled documents to learn from, by label, and the bytes they may have by label (expected numbers; each is taken whole).
TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_BYTES = 3000, 6000, 16 << 20
#: Bytes of the dictionaries, at most and at least; of the segments zstandard chooses for either.
TOXIC_DICT, ORDINARY_DICT, LEAST_DICT = 8192, 110_000, 256
TOXIC_SEGMENT, ORDINARY_SEGMENT = 20, 64
#: Bytes of a window and of its overlap with the next; of a sample of ordinary text.
WINDOW, OVERLAP, PIECE = 24, 10, 256
#: Words of a passage that is learned once; rounds of the toxic dictionary; share of ordinary windows beyond a round's limit, and how many of them find it.
PASSAGE, ROUNDS, BEYOND, JUDGED = 3, 2, 0.03, 20_000
#: Windows compressed in one call.
AT_ONCE = 1 << 15
#: Distances beyond which windows are counted; largest distances that are features of their own.
SHARES, COUNTS, LARGEST = (2, 4, 6), (2, 3, 4, 5, 6), 3
FEATURES = 1 + LARGEST + len(SHARES) + len(COUNTS)


def plain(text: str | None) -> bytes:
    """Lowered UTF-8 with runs of other than letters as one space, a space at both ends."""
    b = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    b = np.where((b < 97) | ((b > 122) & (b < 128)), np.uint8(32), b)
    return b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))].tobytes()


def windows(b: bytes) -> list[bytes]:
    return [b[i : i + WINDOW + OVERLAP] for i in range(0, max(1, len(b)), WINDOW)]


def once(texts: list[bytes]) -> list[bytes]:
    """The texts without the words of passages that stand in them before."""
    ws = [t.split() for t in texts]
    h = word_hashes([w for own in ws for w in own])
    ends = np.cumsum([len(own) for own in ws])
    g = np.zeros(max(0, len(h) - PASSAGE + 1), U64)
    with np.errstate(over="ignore"):
        for i in range(PASSAGE):
            g = mixed(g * MIX_A ^ h[i : i + len(g)])
    _, first = np.unique(g, return_index=True)
    again = np.ones(len(g), bool)
    again[first] = False
    # a passage lies within one text
    of = np.searchsorted(ends, np.arange(len(h)), side="right")
    again &= of[: len(g)] == of[PASSAGE - 1 :][: len(g)]
    drop = np.zeros(len(h), bool)
    for i in range(PASSAGE):
        drop[i : i + len(g)] |= again
    kept, at = [], 0
    for own in ws:
        kept.append(b" " + b" ".join(w for w, d in zip(own, drop[at : at + len(own)].tolist(), strict=True) if not d) + b" ")
        at += len(own)
    return kept


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary trained by zstandard, of ``size`` bytes or of a quarter of the samples' if these are fewer; empty where it can train none of LEAST_DICT."""
    n = min(size, sum(map(len, samples)) // 4)
    while n >= LEAST_DICT:
        try:
            return zstandard.train_dictionary(n, samples, k=segment, d=6).as_bytes()
        except zstandard.ZstdError:
            n //= 2
    return b""


class Dictionaries:
    """A trained ordinary and a trained toxic dictionary, and the distances they give."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic}

    def compressors(self) -> tuple:
        """With the ordinary dictionary alone, and with the toxic one after it. Zeros stand for the latter in the first: so the ordinary content is equally far, and the entropy tables (the ordinary ones) are the same."""
        if "_made" not in self.__dict__:
            p = zstandard.ZstdCompressionParameters(window_log=18, chain_log=16, hash_log=16, search_log=5, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
            made = []
            for after in (bytes(len(self.toxic)), self.toxic):
                d = zstandard.ZstdCompressionDict(self.ordinary + after, dict_type=zstandard.DICT_TYPE_FULLDICT)
                d.precompute_compress(compression_params=p)
                made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).multi_compress_to_buffer)
            self._made = tuple(made)
        return self._made

    def distances(self, ws: list[bytes]) -> np.ndarray:
        # one after the other: either's tables about fill a processor's cache; each window is a frame of its own
        one, both = (np.array([len(f) for s in range(0, len(ws), AT_ONCE) for f in c(ws[s : s + AT_ONCE], threads=1)], int) for c in self.compressors())
        return one - both

    def features(self, texts: list[bytes]) -> np.ndarray:
        """By text: the windows' logarithm, the largest distances, and shares and numbers of the windows beyond some distances."""
        out = np.empty((len(texts), FEATURES))
        i = 0
        while i < len(texts):
            # windows of several texts are compressed in one call
            own, ends, j = [], [], i
            while j < len(texts) and len(own) < AT_ONCE:
                own += windows(texts[j])
                ends.append(len(own))
                j += 1
            for k, s in enumerate(np.split(self.distances(own), ends[:-1]), i):
                top = np.pad(np.sort(s)[::-1][:LARGEST], (0, max(0, LARGEST - len(s))))
                out[k] = [np.log(len(s)), *top, *(20 * (s >= v).mean() for v in SHARES), *(np.log1p((s >= v).sum()) for v in COUNTS)]
            i = j
        return out


def learn(toxic: list[bytes], ordinary: list[bytes]) -> Dictionaries | None:
    """Dictionaries of the texts; None where there is too little text to train either."""
    toxic, ordinary = once(toxic), once(ordinary)
    plain_dict = dictionary([t[i : i + PIECE] for t in ordinary for i in range(0, len(t), PIECE)], ORDINARY_DICT, ORDINARY_SEGMENT)
    halves = [[w for t in toxic[k::2] for w in windows(t)] for k in (0, 1)]
    found = dictionary(halves[0] + halves[1], TOXIC_DICT, TOXIC_SEGMENT)
    if not plain_dict or not found:
        return None
    judged = [w for t in ordinary for w in windows(t)]
    judged = judged[:: -(-len(judged) // JUDGED)]
    chosen = halves
    for _ in range(ROUNDS):
        own = [dictionary(ws, TOXIC_DICT, TOXIC_SEGMENT) for ws in chosen]
        if not all(own):
            break
        chosen = []
        for ws, other in zip(halves, own[::-1], strict=True):
            d = Dictionaries(plain_dict, other)
            limit = max(1, np.quantile(d.distances(judged), 1 - BEYOND))
            chosen.append([w for w, s in zip(ws, d.distances(ws).tolist(), strict=True) if s > limit])
        # windows too few to train on leave the dictionary as it was
        found = dictionary(chosen[0] + chosen[1], TOXIC_DICT, TOXIC_SEGMENT) or found
    return Dictionaries(plain_dict, found)


class Model:
    """Dictionaries of all texts to learn from and the weights of their features; without weights (nothing learned) every score is 0."""

    def __init__(self, dictionaries: Dictionaries | None, weights: tuple | None = None):
        self.dictionaries, self.weights = dictionaries, weights if dictionaries else None

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        mean, spread, w = self.weights
        x = self.dictionaries.features([plain(t) for t in texts])
        z = np.c_[(x - mean) / spread, np.ones(len(x))] @ w
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> tuple | None:
    """Mean, spread and logistic weights by Newton steps, lightly held near zero; None for one class alone."""
    if not 0 < y.sum() < len(y):
        return None
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(h, z.T @ (y - p) - 1e-2 * w)
    return mean, spread, w


def sampled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", fold_n: int | None = None, held: int | None = None) -> DataFrame:
    """(half, toxic, text) of about TOXIC_SAMPLE and ORDINARY_SAMPLE labelled documents, fewer where these would have more than SAMPLE_BYTES, chosen by a hash of the id, each whole; equal texts of a label are one."""
    l = labels.select(labels[doc_id].cast("long").alias("doc_id"), labels[toxic].cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if fold_n:
        l = l.where(fold(F.col("doc_id"), fold_n) != held)
    d = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).where("text is not null")
    n = {r["toxic"]: r["n"] for r in l.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chance = F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = {k: most / max(1, n.get(k, 0)) for k, most in ((1, TOXIC_SAMPLE), (0, ORDINARY_SAMPLE))}
    part = lambda: F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    l = l.where(chance < part())
    sizes = d.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(l), "doc_id").groupBy("toxic").agg(F.sum("size").alias("size")).collect()
    for r in sizes:
        share[r["toxic"]] = min(1.0, share[r["toxic"]]) * min(1.0, SAMPLE_BYTES / max(1, r["size"]))
    l = l.where(chance < part())
    # the labelled sample is small by its parameters: its ids are broadcast
    rows = d.join(F.broadcast(l), "doc_id").select("toxic", "text").distinct()
    return rows.select(F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), "toxic", "text")


def trained(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", fold_n: int | None = None, held: int | None = None) -> Model:
    """A model from a sample of the labelled documents (see ``sampled``); of ``fold_n`` folds of the id, ``held`` is left out.

    Dictionaries of one half of the sample give the features on which the
    weights of the other half's documents are calibrated; those of all are kept.
    Dictionaries are trained and features made on the executors; only these
    come to the driver.
    """
    spark = ship(docs.sparkSession)
    sample = written(sampled(docs, labels, doc_id, text, toxic, fold_n, held), "toxic-sample")

    def learned(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["half"].tolist(), map(plain, pdf["text"]), pdf["toxic"].tolist(), strict=True))
        d = learn(*([t for _, t, y in rows if y == label] for label in (1, 0)))
        return pd.DataFrame({"part": pdf["part"][:1], "ordinary": [d.ordinary], "toxic": [d.toxic]} if d else {"part": [], "ordinary": [], "toxic": []})

    # each half, and both as part 2: a part is the sample at most, which its parameters bound
    parts = sample.withColumn("part", F.explode(F.array("half", F.lit(2))))
    found = parts.groupBy("part").applyInPandas(learned, "part int, ordinary binary, toxic binary").collect()
    by_part = {r["part"]: Dictionaries(bytes(r["ordinary"]), bytes(r["toxic"])) for r in found}
    if len(by_part) < 3:
        return Model(None)
    halves, whole = [by_part[0], by_part[1]], by_part[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            half, texts = b.column(0).to_numpy(), [plain(t) for t in b.column(2).to_pylist()]
            x = np.empty((len(texts), FEATURES))
            for k in (0, 1):
                at = np.flatnonzero(half == k)
                x[at] = halves[1 - k].features([texts[i] for i in at])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.repartition(spark.sparkContext.defaultParallelism, F.xxhash64("text")).mapInArrow(run, "toxic int, x array<double>").collect()
    rows.sort()
    return Model(whole, fit(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier toxic), predicted (1 if score >= 0.5, else 0) of every row of ``docs``.

    All windows of the whole text count. A null or empty text is scored as one
    empty window; with nothing learned (one label alone, or too little text to
    train dictionaries) every score is 0. Repeated rows each get
    a row, a null doc_id stays null, an empty table gives no rows, other
    columns take no part. One scan, no shuffle.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1).to_pylist()))], names=["doc_id", "score"])

    slim = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double").withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``score`` does not predict toxic, with all columns; all if nothing was learned. One scan, no shuffle."""
    return filtered(docs, text, lambda texts: model.score(texts) < 0.5)
