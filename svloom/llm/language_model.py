"""Hierarchical Pitman-Yor language model.

Every word has a restaurant for the words that follow it: each of the most
frequent words one of its own, all others one of a fixed number that their hash
shares out. All of them share one parent restaurant (the word alone), whose
parent is the uniform distribution over the vocabulary and one unknown word.
Seatings are sampled by Gibbs sweeps: each dish (a word in a restaurant) is
taken out, with what its tables add to the parent, and its number of tables is
drawn from its exact conditional (see ``seating``) given all other tables as the
last sweep left them; its tables are customers of the parent. Dishes are seated
side by side, not one after another. Predictive
probabilities, not table counts, are averaged over the sweeps after burn-in.

Distribution: documents are dealt into blocks. A block counts its distinct
words and (context, word) pairs and sends them, packed, to the parts of the
vocabulary. A part merges the counts of its words from all blocks, samples the
seatings of all its dishes, and answers each block with the numbers its texts
need. Words are dealt by hash, so no restaurant, however large, has to fit a
task. While it samples, a part knows the exact number of customers of every
restaurant, and takes its own tables per customer for those of all; the
probabilities use the exact sums over all parts. Texts are scored block by block
from the answers; the restaurants' totals, CONTEXTS rows, are the only thing
that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..ship import ship
from .common import MIX_B, MIX_C, U64, as_bytes, mixed, pieces, signed, word_hashes, words, written
from .seating import Base, Constant, seat

#: Words with a restaurant of their own (the most frequent); restaurants in all, 2 ** 16 at most; documents in a block (mean).
FREQUENT, CONTEXTS, BLOCK_DOCS = 4096, 1 << 16, 4000
#: Tasks that look for the frequent words; tasks that add up the parts' totals at last, and rows of totals for each of the tasks before.
TOP_TASKS, SUM_TASKS, SUM_ROWS = 32, 16, 64
#: Distinct words whose sums a task holds.
HELD_WORDS = 1 << 20
#: Discount and strength of the parent and of the context restaurants.
D1, THETA1, D2, THETA2 = 0.8, 10.0, 0.9, 1.0
#: Gibbs sweeps: burn-in, and those that are averaged.
BURN, SAMPLES = 2, 3
#: Hash of the end of a text (a fixed value no word is likely to have), and contexts: 0 begins a text.
END = U64(0x9D3C0FFEE15600D1)


def restaurants(h: np.ndarray, context_of: dict[int, int]) -> np.ndarray:
    """The restaurant of what follows each word: its own number for a frequent word, else one by its hash."""
    first = len(context_of) + 1
    out = first + (mixed(h ^ MIX_C) % U64(CONTEXTS - first)).astype(np.int64)
    keys = np.array(sorted(context_of), U64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        out = np.where(keys[at] == h, np.array([context_of[k] for k in keys.tolist()])[at], out)
    return out


class Block:
    """Distinct words and (word, context) entries of some texts, in a fixed order, and where each token has them."""

    def __init__(self, texts: list[bytes | None], context_of: dict[int, int], parts: int):
        hs = [np.append(word_hashes(words(t)), END) for t in texts]
        n = np.array([len(h) for h in hs])
        self.doc = np.repeat(np.arange(len(texts)), n)
        self.words, self.word = np.unique(np.concatenate(hs), return_inverse=True)
        self.ctx = np.empty(len(self.word), np.int64)
        self.ctx[1:] = restaurants(self.words, context_of)[self.word[:-1]]
        self.ctx[np.concatenate(([0], np.cumsum(n)[:-1]))] = 0  # the begin of a text
        keys, self.entry = np.unique(self.word * CONTEXTS + self.ctx, return_inverse=True)
        self.entry_word, self.entry_ctx = keys // CONTEXTS, keys % CONTEXTS
        part = (mixed(self.words ^ MIX_B) % U64(parts)).astype(np.int64)
        self.by_part = []
        for x in (part, part[self.entry_word]):
            order = np.argsort(x, kind="stable")
            self.by_part.append((order, np.searchsorted(x[order], np.arange(parts + 1))))

    def of_part(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the part's words, and of its entries, ascending."""
        return tuple(order[first[p] : first[p + 1]] for order, first in self.by_part)


def counted(context_of: dict[int, int], parts: int):
    """Per block (rows sorted by block): for each part the packed words, entries and their counts in training texts."""

    def pack(block: int, texts: list, train: list[bool]) -> Iterator[pa.RecordBatch]:
        b = Block(texts, context_of, parts)
        learn = np.array(train)[b.doc]
        c = np.bincount(b.word[learn], minlength=len(b.words)).astype(np.uint32)
        e = np.bincount(b.entry[learn], minlength=len(b.entry_word)).astype(np.uint32)
        for p in range(parts):
            w, x = b.of_part(p)
            if len(w):
                place = np.searchsorted(w, b.entry_word[x])
                yield pa.RecordBatch.from_pydict({"part": [p], "block": [block], "words": [b.words[w].tobytes()], "counts": [c[w].tobytes()], "entry_word": [place.astype(np.uint32).tobytes()], "entry_ctx": [b.entry_ctx[x].astype(np.uint16).tobytes()], "entry_counts": [e[x].tobytes()]}, schema=_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, texts, train = None, [], []
        for b in batches:
            for block, text, t in zip(b.column("block").to_pylist(), as_bytes(b.column("text")), b.column("train").to_pylist(), strict=True):
                if block != last:
                    if texts:
                        yield from pack(last, texts, train)
                    last, texts, train = block, [], []
                texts.append(text)
                train.append(t)
        if texts:
            yield from pack(last, texts, train)

    return run


_COUNTS = pa.schema([("part", pa.int64()), ("block", pa.int64()), *((n, pa.binary()) for n in ("words", "counts", "entry_word", "entry_ctx", "entry_counts"))])
_ANSWERS = pa.schema([("block", pa.int64()), ("part", pa.int64()), *((n, pa.binary()) for n in ("counts", "rest", "entry_rest", "totals"))])
ANSWERS = "block long, part long, counts binary, rest binary, entry_rest binary, totals binary"


class Sizes:
    """Exact sizes of the training text: customers of every restaurant, tokens, distinct words."""

    def __init__(self, customers: np.ndarray, tokens: int, vocabulary: int):
        self.customers, self.tokens, self.vocabulary = customers, tokens, vocabulary


def seated(sizes: Sizes):
    """Per part (rows sorted by part): merged counts, Gibbs seating, answers to the blocks and the part's share of the totals."""

    def sample(part: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        ws = [np.frombuffer(r["words"], U64) for r in rows]
        vocabulary, at = np.unique(np.concatenate(ws), return_inverse=True)
        size = len(vocabulary)
        c = np.bincount(at, np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows]), size)
        base = np.concatenate(([0], np.cumsum([len(w) for w in ws])))
        keys = np.concatenate([at[base[i] + np.frombuffer(r["entry_word"], np.uint32).astype(np.int64)] * CONTEXTS + np.frombuffer(r["entry_ctx"], np.uint16) for i, r in enumerate(rows)])
        ends = np.cumsum([0, *(len(r["entry_ctx"]) // 2 for r in rows)])
        entries, place = np.unique(keys, return_inverse=True)
        n = np.bincount(place, np.concatenate([np.frombuffer(r["entry_counts"], np.uint32) for r in rows]), len(entries))
        word, ctx = entries // CONTEXTS, entries % CONTEXTS
        rng = np.random.default_rng(part + 7)
        uniform = 1 / (sizes.vocabulary + 1)
        own, own_words = np.bincount(ctx, n, CONTEXTS), max(1, np.count_nonzero(c))
        more = np.flatnonzero(n > 1)  # a dish of one customer has one table
        t, t1 = (n > 0).astype(float), (c > 0).astype(float)
        rest, entry_rest, totals = np.empty((SAMPLES, size), np.float32), np.zeros(len(n)), np.empty((SAMPLES, CONTEXTS + 2))
        for sweep in range(BURN + SAMPLES):
            c1 = np.bincount(word, t, size)
            # tables of all parts: the own ones for each own customer, word or token, times those of all
            all_t1 = t1.sum() * sizes.vocabulary / own_words
            all_c1 = c1.sum() * sizes.tokens / max(1.0, c.sum())
            tables = np.bincount(ctx, t, CONTEXTS) / np.maximum(own, 1) * sizes.customers
            w, mine = word[more], t[more]
            others, start = c1[w] - mine, sweep == 0
            # the word's tables in the parent that are left without the dish's own customers
            t1_others = np.where(others > 0, np.maximum(1.0, t1[w] * others / np.maximum(c1[w], 1)), 0.0)
            share = (THETA1 + D1 * all_t1) * uniform
            parent = Base(others - D1 * t1_others + share, others - D1 * np.maximum(t1_others, 1) + share, THETA1 + np.maximum(1.0, all_c1 - mine))
            t[more] = seat(n[more], mine, THETA2 + D2 * np.maximum(0, tables[ctx[more]] - mine), parent, D2, rng, start)
            c1 = np.bincount(word, t, size)
            t1 = seat(c1, t1, THETA1 + D1 * np.maximum(0, all_t1 - t1), Constant(np.full(size, uniform)), D1, rng, start)
            if (k := sweep - BURN) >= 0:
                rest[k] = c1 - D1 * t1
                entry_rest += (n - D2 * t) / SAMPLES
                totals[k] = [*np.bincount(ctx, t, CONTEXTS), c1.sum(), t1.sum()]
        entry_rest = entry_rest.astype(np.float32)
        for i, r in enumerate(rows):
            own, mine = at[base[i] : base[i + 1]], place[ends[i] : ends[i + 1]]
            yield pa.RecordBatch.from_pydict({"block": [r["block"]], "part": [part], "counts": [c[own].astype(np.int64).tobytes()], "rest": [rest[:, own].tobytes()], "entry_rest": [entry_rest[mine].tobytes()], "totals": [None]}, schema=_ANSWERS)
        yield pa.RecordBatch.from_pydict({"block": [None], "part": [part], "counts": [None], "rest": [None], "entry_rest": [None], "totals": [totals.tobytes()]}, schema=_ANSWERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["part"] != last:
                    if rows:
                        yield from sample(last, rows)
                    last, rows = r["part"], []
                rows.append(r)
        if rows:
            yield from sample(last, rows)

    return run


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (totals): their sum, a row a task that has rows (empty tasks send nothing to the driver)."""
    total = None
    for b in batches:
        for x in b.column(0).to_pylist():
            total = np.frombuffer(x) + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["totals"])


def scored(context_of: dict[int, int], parts: int, sizes: Sizes, totals: np.ndarray):
    """(texts of a block, answers to it) -> scores. totals: by sample the tables of every restaurant, the customers and tables of the parent."""
    n1, t1 = totals[:, CONTEXTS], totals[:, CONTEXTS + 1]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = [t for chunk in left.column("text").chunks for t in as_bytes(chunk)]
        b = Block(texts, context_of, parts)
        c, rest, entry_rest = np.zeros(len(b.words)), np.zeros((SAMPLES, len(b.words))), np.zeros(len(b.entry_word))
        for r in right.to_pylist():
            w, x = b.of_part(r["part"])
            c[w], rest[:, w] = np.frombuffer(r["counts"], np.int64), np.frombuffer(r["rest"], np.float32).reshape(SAMPLES, -1)
            entry_rest[x] = np.frombuffer(r["entry_rest"], np.float32)
        u, p = b.entry_ctx, entry_rest
        for k in range(SAMPLES):
            p1 = (rest[k] + (THETA1 + D1 * t1[k]) / (sizes.vocabulary + 1)) / (THETA1 + n1[k])
            p += (THETA2 + D2 * totals[k, u]) * p1[b.entry_word] / SAMPLES
        p /= THETA2 + sizes.customers[u]
        plain = np.log10((c + 0.5) / (sizes.tokens + 0.5 * (sizes.vocabulary + 1)))[b.word]
        total = lambda x: np.bincount(b.doc, x, len(texts))
        n = total(np.ones(len(b.word))).astype(np.int64)
        return pa.table({"doc_id": left.column("doc_id"), "train": left.column("train"), "n_tokens": n, "n_known": total(c[b.word] > 0).astype(np.int64), "train_tokens": np.full(len(texts), sizes.tokens), "base_score": total(plain), "score": total(np.log10(p)[b.entry])})

    return run


def word_counts(train: DataFrame) -> DataFrame:
    """(h, n): how often each word (by its hash) and the end occur in the texts; a task sends sums of up to HELD_WORDS words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = np.empty(0, U64), np.empty(0, np.int64)
        for b in pieces(batches, 2048):
            u, c = np.unique(np.concatenate([np.full(b.num_rows, END), *(word_hashes(words(t)) for t in as_bytes(b.column(0)))]), return_counts=True)
            h, at = np.unique(np.concatenate([h, u]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, c]), len(h)).astype(np.int64)
            if len(h) > HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n)], names=["h", "n"])
                h, n = np.empty(0, U64), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n)], names=["h", "n"])

    return train.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> dict[int, int]:
    """Hash -> number (from 1) of the most frequent words."""
    end = int(signed(np.array([END]))[0])
    # few tasks, as each sends ``most`` rows to the driver
    top = counts.where(F.col("h") != end).coalesce(TOP_TASKS).orderBy(F.desc("n"), "h").limit(most).collect()
    return {r["h"] & 0xFFFFFFFFFFFFFFFF: i + 1 for i, r in enumerate(top)}


def sizes_of(counts: DataFrame, context_of: dict[int, int]) -> Sizes:
    """Every word but the end has what follows it as customer of its restaurant; what begins a text is a customer of restaurant 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, words_ = np.zeros(CONTEXTS, np.int64), 0
        for b in batches:
            h, n = b.column(0).to_numpy().view(U64), b.column(1).to_numpy()
            at = np.where(h == END, 0, restaurants(h, context_of))
            c += np.bincount(at, n, CONTEXTS).astype(np.int64)
            words_ += len(h)
        yield pa.RecordBatch.from_arrays([pa.array([*range(CONTEXTS), CONTEXTS]), pa.array([*c.tolist(), words_])], names=["ctx", "n"])

    got = np.zeros(CONTEXTS + 1, np.int64)
    for r in counts.coalesce(TOP_TASKS).mapInArrow(run, "ctx long, n long").groupBy("ctx").agg(F.sum("n").alias("n")).where("n > 0").collect():
        got[r["ctx"]] = r["n"]
    return Sizes(got[:-1].astype(float), int(got[:-1].sum()), int(got[-1]))


def score_texts(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    The model learns from the rows where ``train`` (a Column of ``docs``) holds.
    Tokens are the words ``[^\\x20\\x09-\\x0D]+``, A-Z lowered, and one end; a
    null text is empty and has the end alone. n_known tokens occur in training,
    which has train_tokens; base_score is the add-half unigram model, score the
    model's log10 probability of the text, where all words unseen in training
    are one. Without training rows both are uniform. Repeated rows each get a
    row, a null doc_id stays null, an empty table gives no rows; other columns
    take no part.
    """
    ship(docs.sparkSession)
    d = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    parts = max(1, d.count() // BLOCK_DOCS)
    occurring = written(word_counts(d.where("train")), "word-counts")
    context_of = frequent_words(occurring)
    sizes = sizes_of(occurring, context_of)
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)))
    sent = d.select("block", "text", "train").repartition("block").sortWithinPartitions("block", F.xxhash64("text"))
    counts = sent.mapInArrow(counted(context_of, parts), "part long, block long, words binary, counts binary, entry_word binary, entry_ctx binary, entry_counts binary")
    answers = written(counts.repartition("part").sortWithinPartitions("part", "block").mapInArrow(seated(sizes), ANSWERS), "answers")
    shares = answers.where("totals is not null").select("totals")
    for tasks in (max(SUM_TASKS, parts // SUM_ROWS), SUM_TASKS):
        shares = shares.repartition(tasks).mapInArrow(summed, "totals binary")
    totals = sum((np.frombuffer(r["totals"]) for r in shares.toLocalIterator()), np.zeros(SAMPLES * (CONTEXTS + 2))).reshape(SAMPLES, -1)
    replies = answers.where("block is not null").select("block", "part", "counts", "rest", "entry_rest")
    out = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return d.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(scored(context_of, parts, sizes, totals), out)
