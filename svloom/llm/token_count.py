"""Token counts by a compiled finite-state transducer.

A byte-pair encoding is the one token sequence whose neighbours all fit: two
tokens fit if the encoder leaves their joined text as these two. So the last
token of a prefix follows from the last tokens of a few shorter prefixes: those
that end where a piece of the vocabulary may still begin. These (and their
relative counts) are a finite state; reading a character leads to the next and
emits by how much the count of tokens changes. States and transitions are
compiled as texts reach them, within a bounded table, the same for every text.

Texts are cut into chunks of equal length, read side by side as lanes of array
operations. Each chunk is first run from the start state; the record of states
it passed makes it a map from entry state to (exit state, count): from the true
entry it is run only until it meets the record, which then holds for the rest.
The maps are composed in a scan over the chunks: all entries are set at once
from the recorded exits, and only chunks whose entry turns out different run
again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..ship import ship
from .common import pieces

SPACE = "▁"
#: Characters in a chunk; states kept before the table starts afresh; characters with a column of their own.
CHUNK, MAX_STATES, WIDTH = 512, 360_000, 128
_DELTA = 64  # a transition is packed as state * 2 * _DELTA + (delta + _DELTA)


class Transducer:
    """Counting transducer of a sentencepiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        kinds = [(sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i), sp.id_to_piece(i), i) for i in range(sp.get_piece_size())]
        self.rank = {p: (-sp.get_score(i), i) for special, p, i in kinds if not special}
        if any(a != SPACE and b == SPACE for p in self.rank for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("pieces that run over a word's end are not supported")
        if sp.encode("a  b ", out_type=str) != sp.encode("a  b ", out_type=str) or "".join(sp.encode("Aé  b ", out_type=str)) != f"{SPACE}Aé{SPACE}{SPACE}b{SPACE}":
            raise ValueError("models that normalise text are not supported")
        self.inner = {p[:k] for p in self.rank for k in range(1, len(p))}
        self.lut = np.full(0x110000, -1, np.int32)
        self.chars: list[str] = []
        # classes 0..3: characters outside the vocabulary, by the bytes they fall back to
        self.clear()

    def clear(self) -> None:
        start = ("", ((0, "", 0),))
        self.ids, self.states = {start: 1}, [None, start]
        self.table = np.zeros((MAX_STATES + 1) * WIDTH, np.int32)
        self.rare: dict[int, int] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def classes(self, text: str) -> np.ndarray:
        """Class of every character of the text, with the space put before it; empty text: none."""
        if not text:
            return np.empty(0, np.int32)
        points = np.frombuffer((SPACE + text.replace(" ", SPACE)).encode("utf-32-le"), np.uint32)
        out = self.lut[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]).tolist():
                if (c := chr(p)) in self.rank:
                    self.lut[p] = 4 + len(self.chars)
                    self.chars.append(c)
                else:
                    self.lut[p] = len(c.encode("utf-8", "surrogatepass")) - 1
            out = self.lut[points]
        return out

    def pieces_of(self, text: str) -> list[str]:
        """Plain encoding of a short text: join the best pair, leftmost first, until none is left."""
        t = list(text)
        while True:
            best = min(((self.rank[t[i] + t[i + 1]], i) for i in range(len(t) - 1) if t[i] + t[i + 1] in self.rank), default=None)
            if best is None:
                return t
            t[best[1] : best[1] + 2] = [t[best[1]] + t[best[1] + 1]]

    def fit(self, a: str, b: str) -> bool:
        r = self.fits.get((a, b))
        if r is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            r = self.fits[a, b] = self.pieces_of(a + b) == [a, b]
        return r

    def compiled(self, state: int, cls: int) -> int:
        """The packed transition; compiles it (and the state it leads to)."""
        if cls < 4:
            return 1 * 2 * _DELTA + (cls + 1) + _DELTA
        c = self.chars[cls - 4]
        suffix, items = self.states[state]
        if c == SPACE and not suffix.endswith(SPACE):
            suffix, items = self.states[1]
        back = lambda k: (suffix[len(suffix) - k :] if k else "") + c
        token, count = next((t, r + 1) for k, last, r in items for t in (back(k),) if t in self.rank and (not last or self.fit(last, t)))
        live = [(k + 1, last, r - count) for k, last, r in items if back(k) in self.inner]
        reach = max((k for k, _, _ in live), default=0)
        new = ((suffix + c)[len(suffix) + 1 - reach :] if reach else "", (*live, (0, token, 0)))
        at = self.ids.get(new)
        if at is None:
            at = self.ids[new] = len(self.states)
            self.states.append(new)
        return at * 2 * _DELTA + count + _DELTA

    def step(self, state: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Packed transitions of many lanes at once."""
        wide = cls >= WIDTH
        got = self.table[state * WIDTH + np.where(wide, 0, cls)]
        if wide.any():
            got[wide] = 0
        if not got.all():
            miss = np.flatnonzero(got == 0)
            key, where = np.unique(state[miss].astype(np.int64) << 21 | cls[miss], return_inverse=True)
            new = np.empty(len(key), np.int32)
            for n, k in enumerate(key.tolist()):
                s, c = k >> 21, k & 0x1FFFFF
                to = self.rare.get(k) if c >= WIDTH else None
                if to is None:
                    to = self.compiled(s, c)
                    if c >= WIDTH:
                        self.rare[k] = to
                    else:
                        self.table[s * WIDTH + c] = to
                new[n] = to
            got[miss] = new[where]
        return got

    @property
    def full(self) -> bool:
        """Whether the next slice might not find room; states appear at most once a character and lane."""
        return len(self.states) > MAX_STATES * 3 // 4 or len(self.rare) > MAX_STATES

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text (null: none)."""
        if self.full:
            self.clear()
        parts = [self.classes(t or "") for t in texts]
        lengths = np.array([len(p) for p in parts])
        flat = np.concatenate([*parts, np.empty(0, np.int32)])
        total = np.zeros(len(texts), np.int64)
        doc, start = [], []
        base = np.concatenate(([0], np.cumsum(lengths)))
        for d in np.flatnonzero(lengths):
            at = np.arange(base[d], base[d + 1], CHUNK)
            start.append(at)
            doc.append(np.full(len(at), d))
        if not doc:
            return total
        doc, start = np.concatenate(doc), np.concatenate(start)
        size = np.minimum(CHUNK, base[doc + 1] - start)
        first = np.concatenate(([True], doc[1:] != doc[:-1]))
        passed, emitted = np.empty(len(flat), np.int32), np.empty(len(flat), np.int32)
        # every chunk from the start state, recording the states it passes
        order = np.argsort(-size, kind="stable")
        by_size = size[order]
        state, count, at = np.ones(len(order), np.int32), np.zeros(len(order), np.int32), start[order]
        for k in range(int(by_size[0])):
            n = int(np.searchsorted(-by_size, -k))
            if n < len(state):
                state, count, at = state[:n], count[:n], at[:n]
            got = self.step(state, flat[at])
            state, count = got // (2 * _DELTA), count + (got % (2 * _DELTA) - _DELTA)
            passed[at], emitted[at] = state, count
            at = at + 1
            self._room()
        # the scan: entries from the recorded exits; a chunk whose run never meets its record changes the next entry
        exits, sums = passed[start + size - 1].copy(), emitted[start + size - 1].copy()
        entry = np.ones(len(start), np.int32)
        todo = np.flatnonzero(~first)
        while len(todo):
            entry[todo] = exits[todo - 1]
            lane, state, count, k = todo, entry[todo], np.zeros(len(todo), np.int32), 0
            changed = []
            while len(lane):
                at = start[lane] + k
                got = self.step(state, flat[at])
                state, count = got // (2 * _DELTA), count + (got % (2 * _DELTA) - _DELTA)
                met, last = state == passed[at], size[lane] == k + 1
                over = met | last
                done = lane[over]
                sums[done] = count[over] + np.where(met[over], emitted[start[done] + size[done] - 1] - emitted[at[over]], 0)
                out = np.where(met[over], passed[start[done] + size[done] - 1], state[over])
                changed.append(done[out != exits[done]])
                exits[done] = out
                lane, state, count, k = lane[~over], state[~over], count[~over], k + 1
                self._room()
            nxt = np.concatenate(changed) + 1
            nxt = nxt[nxt < len(start)]
            todo = np.sort(nxt[~first[nxt]])
        np.add.at(total, doc, sums)
        return total

    def _room(self) -> None:
        """Enlarges the table when one slice of texts brings more states than the bound; the next slice starts afresh."""
        if len(self.states) * WIDTH > len(self.table) - 8192 * WIDTH:
            self.table = np.concatenate((self.table, np.zeros(MAX_STATES * WIDTH, np.int32)))


_COMPILED: dict[str, Transducer] = {}


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``.

    n_bytes is the UTF-8 length, n_tokens what the library gives for the
    sentencepiece BPE ``model`` (a path; default: the public 32k piece model)
    without begin, end or other special tokens, over_limit n_tokens > limit. A
    null text counts as empty: 0 bytes, 0 tokens. Repeated rows each get a row,
    a null doc_id stays null, an empty table gives no rows; other columns take
    no part. One scan, no shuffle.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = model or public_tokenizers.path("piece_bpe_32k.model")
        machine = _COMPILED.get(path)
        if machine is None:
            machine = _COMPILED[path] = Transducer(path)
        for b in pieces(batches):
            n = machine.counts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    slim = slim.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    out = slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
