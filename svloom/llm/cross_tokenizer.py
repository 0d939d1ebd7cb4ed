"""Which tokens of one tokenizer stand for which tokens of another, counted over a corpus.

Both tokenizers cut the same bytes; where they both end a token, the text falls
into groups, and every token of A is linked with every token of B of its group.
A linked pair of ids is one packed 64-bit key. Each partition counts the
documents that hold a key with ``np.unique``; these partial counts are sorted by
key over the whole cluster (range partitions) and added up run by run. Every
range ends as a pair of sorted arrays in the shared folder, which the second pass
maps into memory and searches with ``searchsorted``. The table of all pairs can't
outgrow the product of both vocabularies, whatever the corpus.
Texts are encoded once; both passes read the ids. Most go to a faster library
with the same ranks; ``Tokenizers._fast`` tells when that is the same.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..ship import shared_dir, ship
from .common import pieces, written

SPACE = "▁"
#: Links expanded at a time; keys of a partial count; links of a group from which repeated ids are joined first.
LINKS, PARTIAL, LARGE = 1 << 22, 1 << 22, 256
#: Spaces in a row beyond which the faster library's pattern engine may give up.
LONG = re.compile(r"\s{10000}")


def byte_chars() -> dict[str, int]:
    """The character that byte-level vocabularies write for a byte -> the byte: itself if printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Steady(dict):
    """character -> whether its class (letter, number, space, other) was the same in the first and is in Python's edition of Unicode, so that libraries of any edition between cut alike."""

    def __missing__(self, x: str) -> bool:
        kind = lambda db: k if (k := db.category(x)[0]) in "LNZ" else ""
        # U+180E was a space for some editions between; what is not assigned yet may become a letter
        out = self[x] = x < "\u0100" or x != "\u180e" and unicodedata.category(x) != "Cn" and kind(unicodedata) == kind(unicodedata.ucd_3_2_0)
        return out


STEADY = Steady()


class Tokenizers:
    """A: a byte-level file of ``tokenizers``; B: a byte-fallback model of ``sentencepiece`` that puts a space before the text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a) as f:
            about = json.load(f)
        before = about["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or about["normalizer"]:
            raise ValueError("A must be a byte-level tokenizer that changes no text")
        chars, vocab = byte_chars(), self.a.get_vocab(with_added_tokens=True)
        self.added = [x["content"] for x in about["added_tokens"]]
        self.fast = self._fast(path_a, about, chars)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(chars[x] for x in token) if all(x in chars for x in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.lengths = tuple(np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.kinds = tuple(np.uint16 if len(t) <= 1 << 16 else np.uint32 for t in (self.bytes_a, self.bytes_b))
        self.bits = (len(self.bytes_b) - 1).bit_length()
        if self.bits + (len(self.bytes_a) - 1).bit_length() > 40:
            raise ValueError("a pair of ids must fit 40 bits")
        texts = [np.array([str(i) + end for end in ends for i in range(len(t))], object) for t, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;"))]
        self.texts = tuple(np.array([x.encode() for x in t], object) for t in texts)

    @staticmethod
    def _fast(path: str, about: dict, chars: dict[str, int]):
        """A faster encoder of A, from the ranks beside its file; None if they aren't there or aren't A's.

        It joins any two tokens whose bytes are a token, lowest rank first; A joins
        those of its list of merges, in the list's order. That is the same if ranks
        rise along the list and every token's own bytes are encoded as that token.
        """
        model = about["model"]
        if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or not about["pre_tokenizer"].get("use_regex", True):
            return None
        try:
            import public_tokenizers
            import tiktoken

            with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
                ranks = {base64.b64decode(x): int(n) for x, n in map(bytes.split, f)}
        except (ImportError, OSError):
            return None
        joined = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        added = {x["content"] for x in about["added_tokens"]}
        own = {bytes(chars[x] for x in t): i for t, i in model["vocab"].items() if t not in added}
        if own != ranks or None in joined or any(x >= y for x, y in zip(joined, joined[1:], strict=False)) or len(own) != 256 + len(joined):
            return None
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, text: str) -> np.ndarray:
        """Ids of A: by the faster library if all characters are steady, no stretch is long and no added token's string is in the text."""
        if self.fast is not None and (text.isascii() or all(map(STEADY.__getitem__, set(text)))) and not LONG.search(text) and not any(x in text for x in self.added):
            return np.array(self.fast.encode_ordinary(text), self.kinds[0])
        return np.array(self.a.encode(text, add_special_tokens=False).ids, self.kinds[0])

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Packed ids of A and of B; none if the text is null or empty or a tokenizer changes its bytes."""
        if not text:
            return b"", b""
        a, b = self.encode_a(" " + text), self.b.encode(text)
        want = (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return b"", b""
        return a.tobytes(), np.array(b, self.kinds[1]).tobytes()


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def loaded(paths: tuple[str | None, str | None]) -> Tokenizers:
    import public_tokenizers

    key = (paths[0] or public_tokenizers.path("byte_bpe_50k.json"), paths[1] or public_tokenizers.path("piece_bpe_32k.model"))
    if key not in _LOADED:
        _LOADED[key] = Tokenizers(*key)
    return _LOADED[key]


class Aligned:
    """The groups of a batch of documents, all in flat arrays."""

    def __init__(self, t: Tokenizers, column_a: list[bytes], column_b: list[bytes]):
        self.t, self.docs = t, len(column_a)
        (self.a, self.n_a), (self.b, self.n_b) = (self._flat(x, kind) for x, kind in zip((column_a, column_b), t.kinds, strict=True))
        end_a, end_b = np.cumsum(t.lengths[0][self.a]), np.cumsum(t.lengths[1][self.b])
        at = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, bool)
        at[end_b] = True
        self.last_a = at[end_a]  # tokens that end a group
        at[:] = False
        at[end_a] = True
        self.last_b = at[end_b]
        self.group_a, self.group_b = (np.cumsum(x) - x for x in (self.last_a, self.last_b))
        n = int(self.last_a.sum())
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        self.n_groups = np.bincount(np.repeat(np.arange(self.docs), self.n_a)[self.last_a], minlength=self.docs)
        upto = np.concatenate(([0], np.cumsum(self.size_a * self.size_b)))
        ends = np.cumsum(self.n_groups)
        self.n_links = upto[ends] - upto[ends - self.n_groups]

    @staticmethod
    def _flat(column: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in column], np.int64) // np.dtype(kind).itemsize
        return np.frombuffer(b"".join(column), kind).astype(np.int64), n

    def _joined(self, ids: np.ndarray, groups: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, groups, times: of large groups each id once."""
        of = large[groups]
        both, times = np.unique(groups[of] << 32 | ids[of], return_counts=True)
        ids, groups, times = np.concatenate((ids[~of], both & 0xFFFFFFFF)), np.concatenate((groups[~of], both >> 32)), np.concatenate((np.ones(int((~of).sum()), np.int64), times))
        order = np.argsort(groups, kind="stable")
        return ids[order], groups[order], times[order]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, key, links) arrays in order of (document, key); a document's key is in one of them alone."""
        if not len(self.a):
            return
        large = self.size_a * self.size_b > LARGE
        ids_a, group_a, times_a = self.a, self.group_a, None
        ids_b, group_b, times_b = self.b, self.group_b, None
        if large.any():
            ids_a, group_a, times_a = self._joined(ids_a, group_a, large)
            ids_b, group_b, times_b = self._joined(ids_b, group_b, large)
        sizes = np.bincount(group_b, minlength=len(large))
        starts = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(self.docs), self.n_groups)[group_a]
        times = sizes[group_a]  # links of each token of A
        total = np.bincount(doc, times, self.docs).astype(np.int64)
        shift = self.t.bits

        def expanded(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            r = times[at]
            i = np.repeat(at, r)
            j = starts[group_a[i]] + np.arange(len(i)) - np.repeat(np.cumsum(r) - r, r)
            # 40 bits of key at most: some 8 million documents fit above them
            both = (doc[i] << 40) | (ids_a[i] << shift) | ids_b[j]
            if times_a is None:
                both, n = np.unique(both, return_counts=True)
            else:
                both, where = np.unique(both, return_inverse=True)
                n = np.zeros(len(both), np.int64)
                np.add.at(n, where, times_a[i] * times_b[j])
            return both >> 40, both & ((1 << 40) - 1), n

        first = 0
        bounds = np.searchsorted(doc, np.arange(self.docs + 1))
        while first < self.docs:
            end, n = first + 1, int(total[first])
            while end < self.docs and n + total[end] <= LINKS:
                n += int(total[end])
                end += 1
            at = np.arange(bounds[first], bounds[end])
            if n <= 2 * LINKS:
                if n:
                    yield expanded(at)
            else:  # one very long document: by ranges of A's ids
                at = at[np.argsort(ids_a[at], kind="stable")]
                part = np.cumsum(times[at]) // LINKS
                # all occurrences of an id go to the part of its first
                same = np.concatenate(([True], np.diff(ids_a[at]) > 0))
                part = part[np.maximum.accumulate(np.where(same, np.arange(len(at)), 0))]
                for p in np.split(at, np.flatnonzero(np.diff(part)) + 1):
                    yield expanded(p)
            first = end

    def digests(self) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each document; empty without tokens."""
        before_a = np.cumsum(self.size_a)
        before_b = np.cumsum(self.size_b) - self.size_b
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + before_b[self.group_a]] = self.t.texts[0][self.a + len(self.t.bytes_a) * self.last_a]
        out[np.arange(len(self.b)) + before_a[self.group_b]] = self.t.texts[1][self.b + len(self.t.bytes_b) * self.last_b]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [hashlib.sha256(b"".join(out[i:j].tolist())[:-1]).hexdigest() if j > i else "" for i, j in zip([0, *ends], ends, strict=False)]


def runs(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys once each, their numbers added up."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def partial_counts(paths: tuple):
    """Rows (key, n): how many documents of the partition hold the pair; some keys more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, held, size = loaded(paths), [], 0
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def added() -> tuple[np.ndarray, np.ndarray]:
            more, m = np.unique(np.concatenate(held), return_counts=True)
            both, times = np.concatenate((keys, more)), np.concatenate((n, m))
            order = np.argsort(both, kind="stable")
            return runs(both[order], times[order])

        for b in pieces(batches):
            for _, k, _ in Aligned(t, b.column(0).to_pylist(), b.column(1).to_pylist()).links():
                held.append(k)
                size += len(k)
                if size >= PARTIAL:
                    keys, n = added()
                    held, size = [], 0
                    if len(keys) >= PARTIAL:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])
                        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
        if held:
            keys, n = added()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    return run


def store(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), os.path.abspath(path))


def count_shards(folder: str, bits: int):
    """Adds up sorted (key, n) rows run by run and writes the sums as two arrays; a row for each shard.

    Files have names of their own: what a lost task wrote is in no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path = None, f"{folder}/{uuid.uuid4().hex}"
        last_k, last_n = np.empty(0, np.int64), np.empty(0, np.int64)
        first, size, best = None, 0, []

        def put(k: np.ndarray, n: np.ndarray) -> None:
            nonlocal out, first, size
            if out is None:
                files, at = store(path)
                files.create_dir(at.rsplit("/", 1)[0], recursive=True)
                out, first = (files.open_output_stream(at + ".keys"), files.open_output_stream(at + ".counts")), int(k[0])
            out[0].write(k.tobytes())
            out[1].write(n.tobytes())
            size += len(k)
            a = k >> bits
            at = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            best.append((a[at], np.maximum.reduceat(n, at)))

        for b in batches:
            if not b.num_rows:
                continue
            k, n = runs(np.concatenate((last_k, b.column(0).to_numpy())), np.concatenate((last_n, b.column(1).to_numpy())))
            if len(k) > 1:
                put(k[:-1], n[:-1])
            last_k, last_n = k[-1:], n[-1:]
        if len(last_k):
            put(last_k, last_n)
            for o in out:
                o.close()
            a, n = (np.concatenate(x) for x in zip(*best, strict=True))
            at = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            yield pa.RecordBatch.from_pydict({"first": [first], "size": [size], "path": [path], "a": [a[at].tobytes()], "best": [np.maximum.reduceat(n, at).tobytes()]}, schema=pa.schema([("first", pa.int64()), ("size", pa.int64()), ("path", pa.string()), ("a", pa.binary()), ("best", pa.binary())]))

    return run


def mapped(path: str) -> np.ndarray:
    """An array of the shared folder in memory: mapped where it lies, or from a copy that goes with the map."""
    from pyarrow import fs

    files, at = store(path)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(at, np.int64, "r")
    with files.open_input_stream(at) as f, tempfile.NamedTemporaryFile() as own:
        while chunk := f.read(8 << 20):
            own.write(chunk)
        own.flush()
        return np.memmap(own.name, np.int64, "r")


class Counts:
    """Look-up in the sorted count shards: (first key, path) each."""

    def __init__(self, shards: list[tuple[int, str]]):
        self.shards, self.maps = sorted(shards), {}
        self.first = np.array([x[0] for x in self.shards], np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, all of which are in the table."""
        cuts = np.searchsorted(keys, self.first[1:])
        out = []
        for s, k in enumerate(np.split(keys, cuts)):
            if len(k):
                if s not in self.maps:
                    self.maps[s] = tuple(mapped(self.shards[s][1] + end) for end in (".keys", ".counts"))
                known, n = self.maps[s]
                at = np.searchsorted(known, k)
                if not np.array_equal(known[np.minimum(at, len(known) - 1)], k):
                    raise RuntimeError("a pair is in no shard")
                out.append(n[at])
        return np.concatenate(out)


def encoded(docs: DataFrame, paths: tuple[str | None, str | None] = (None, None), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a, b: ids of both tokenizers, packed; none where they do not cut the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(paths)
        for b in pieces(batches):
            a, c = zip(*map(t.encode, b.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a, pa.binary()), pa.array(c, pa.binary())], names=["doc_id", "a", "b"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, a binary, b binary")


def pair_counts(tokens: DataFrame, paths: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """The count shards of ``encoded`` documents: first, size, path, a, best (each A id's highest count in the shard)."""
    spark = tokens.sparkSession
    partial = written(tokens.select("a", "b").mapInArrow(partial_counts(paths), "key long, n long"), "pair-counts")
    folder = f"{shared_dir(spark)}/svloom/pair-shards-{uuid.uuid4().hex}"
    ordered = partial.repartitionByRange("key").sortWithinPartitions("key")
    return written(ordered.mapInArrow(count_shards(folder, loaded(paths).bits), "first long, size long, path string, a binary, best binary"), "pair-shards")


def cross_tokenizer_alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    A is ``tokenizers`` on a space and the text (``path_a``, default: the public
    byte-level file), B ``sentencepiece`` on the text (``path_b``, default: the
    public piece model), both without special tokens, whose strings in a text are
    plain text. A pair's count is the number of rows that hold it linked; n_best
    counts the links whose pair has its A id's highest count, count_sum adds up
    the counts over the links, and groups_sha256 is the hash of the groups
    written as ``a1,a2|b1;a3|b2,b3``.

    Texts that are null or empty, or whose bytes a tokenizer changes, have no
    tokens: zeros and an empty string. Repeated rows each count as a document and
    get a row, a null doc_id stays null, an empty table gives no rows; further
    columns take no part.
    """
    ship(docs.sparkSession)
    paths = (path_a, path_b)
    tokens = written(encoded(docs, paths, doc_id, text), "tokens")
    # a row for each range partition; of A's ids at most its vocabulary, and one more a shard
    shards = pair_counts(tokens, paths).collect()
    best = np.zeros(len(loaded(paths).bytes_a), np.int64)
    for r in shards:
        a = np.frombuffer(r["a"], np.int64)
        best[a] = np.maximum(best[a], np.frombuffer(r["best"], np.int64))
    places = [(r["first"], r["path"]) for r in shards]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, counts = loaded(paths), Counts(places)
        for b in pieces(batches):
            x = Aligned(t, b.column(1).to_pylist(), b.column(2).to_pylist())
            n_best, total = np.zeros(x.docs, np.int64), np.zeros(x.docs, np.int64)
            for doc, key, n in x.links():
                each, where = np.unique(key, return_inverse=True)
                count = counts.of(each)[where]
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                total[doc[first]] += np.add.reduceat(n * count, first)
                n_best[doc[first]] += np.add.reduceat(np.where(count == best[key >> t.bits], n, 0), first)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.int64()) for v in (x.n_a, x.n_b, x.n_groups, x.n_links, n_best, total)), pa.array(x.digests(), pa.string())], names=names)

    return tokens.mapInArrow(run, ", ".join(f"{n} long" for n in names[:-1]) + ", groups_sha256 string")
