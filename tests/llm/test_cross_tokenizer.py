"""Cross-tokenizer alignment: a plain count over all links, and its edge cases."""

import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from svloom.llm import cross_tokenizer, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(texts):
    """[(id, bytes)] of A and of B for each text, by the libraries alone; None where bytes differ."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = [x for x in range(256) if chr(x).isprintable() and x not in (32, 173) and not 127 <= x <= 160]
    char = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    for t in texts:
        if not t:
            yield None
            continue
        left = [(i, bytes(char[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
        right = []
        for i in sp.encode(t):
            p = sp.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
        same = b"".join(x for _, x in left) == (" " + t).encode() == b"".join(x for _, x in right)
        yield (left, right) if same else None


def groups(left, right):
    def ends(side):
        out, at = [], 0
        for _, x in side:
            at += len(x)
            out.append(at)
        return out

    ea, eb = ends(left), ends(right)
    cuts = sorted(set(ea) & set(eb))
    out = [([], []) for _ in cuts]
    for side, es, k in ((left, ea, 0), (right, eb, 1)):
        g = 0
        for (i, _), e in zip(side, es, strict=True):
            out[g][k].append(i)
            g += e == cuts[g]
    return out


def brute(rows):
    found = [(i, g and groups(*g)) for (i, _), g in zip(rows, tokens([t for _, t in rows]), strict=True)]
    held = Counter()
    for _, gs in found:
        held.update({(a, b) for x, y in gs or [] for a in x for b in y})
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for i, gs in found:
        links = [held[a, b] == best[a] for x, y in gs or [] for a in x for b in y]
        total = sum(held[a, b] for x, y in gs or [] for a in x for b in y)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs or [])
        out.append((i, sum(len(x) for x, _ in gs or []), sum(len(y) for _, y in gs or []), len(gs or []), len(links), sum(links), total, hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces \n\n and\ta tab "), (5, "x" * 5000), (6, "日本語 テキスト 😀👩‍👩‍👧"), (7, "<|endoftext|> <s> </s> <unk> <0x0A> it's"), (8, "a▁b is not kept"), (8, "same id"), (8, "same id"), (None, "no id"), (9, "the " * 3000), (10, "é́  nbsp ​ zero"), (11, "\x00 null"), (12, "12345 ++ 678.90"), (13, "abcdefghij" * 700),
]


def test_equal_to_a_plain_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("a", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("n", F.lit(2))
    got = sorted(map(tuple, cross_tokenizer.cross_tokenizer_alignment(df).collect()), key=str)
    assert got == brute(rows)


def test_small_limits_give_the_same(spark, monkeypatch):
    rows = [(i, t) for i, t in ODD if t is None or len(t) < 8000] + [(20, "word other thing " * 60), (21, "word thing")]
    want = brute(rows)
    t = cross_tokenizer.loaded((None, None))
    for links, large in ((7, 1), (50, 4), (1 << 22, 1), (3, 256)):
        monkeypatch.setattr(cross_tokenizer, "LINKS", links)
        monkeypatch.setattr(cross_tokenizer, "LARGE", large)
        monkeypatch.setattr(cross_tokenizer, "PARTIAL", 100)
        x = cross_tokenizer.Aligned(t, *map(list, zip(*[t.encode(y) for _, y in rows], strict=True)))
        sums, seen = np.zeros(len(rows), np.int64), set()
        for doc, key, n in x.links():
            np.add.at(sums, doc, n)
            assert not seen & set(zip(doc.tolist(), key.tolist(), strict=True))
            seen |= set(zip(doc.tolist(), key.tolist(), strict=True))
        assert sorted(zip([str(i) for i, _ in rows], sums.tolist(), strict=True)) == sorted((str(w[0]), w[4]) for w in want)
        partial = {}
        for b in cross_tokenizer.partial_counts((None, None))([one_batch(t, rows)]):
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                partial[k] = partial.get(k, 0) + n
        assert sum(partial.values()) == len(seen)


def one_batch(t, rows):
    import pyarrow as pa

    a, b = zip(*[t.encode(y) for _, y in rows], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def test_shards_hold_every_pair_once_in_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(6)
    tokens = cross_tokenizer.encoded(docs)
    shards = sorted(cross_tokenizer.pair_counts(tokens).collect(), key=lambda r: r["first"])
    keys = np.concatenate([cross_tokenizer.mapped(r["path"] + ".keys") for r in shards])
    assert (np.diff(keys) > 0).all() and len(keys) == sum(r["size"] for r in shards)
    counts = cross_tokenizer.Counts([(r["first"], r["path"]) for r in shards])
    some = keys[:: max(1, len(keys) // 50)]
    assert (counts.of(some) > 0).all()
    with pytest.raises(RuntimeError):
        counts.of(np.array([keys[-1] + 1]))


def test_empty_table_and_query(spark):
    assert cross_tokenizer.cross_tokenizer_alignment(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert "op12_cross_tokenizer" in queries.QUERIES


def test_ordinary_texts_go_to_the_faster_library(monkeypatch):
    t = cross_tokenizer.Tokenizers(A, B)
    want = t.a.encode(" It's naïve: 日本語 text", add_special_tokens=False).ids
    monkeypatch.setattr(t, "a", None)
    assert t.encode_a(" It's naïve: 日本語 text").tolist() == want


def test_faster_library_gives_the_same():
    t = cross_tokenizer.Tokenizers(A, B)
    odd = [x for _, x in ODD if x] + [" " * 1_200_000 + "x", "\n " * 20_000, "'" * 999 + "'S 's", "ᠠ᠎b​c d\x85e\x1cf", "²½Ⅷ٣ ǅʰ", "\U0001f9ffé\U00031350 ꟊ", "w" * 3000 + "é" * 3000]
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for x in [*odd, *filter(None, rows)]:
        assert t.encode_a(" " + x).tolist() == t.a.encode(" " + x, add_special_tokens=False).ids
    # characters whose class another edition of Unicode may not know go to the slow one
    assert not any(map(cross_tokenizer.STEADY.__getitem__, "\u180e\u200b\U00031350\ua7ca\u1c89"))


def test_joining_by_rank_is_joining_by_merges():
    """Every token's own bytes are encoded as that token: the premise on which the faster library is used."""
    with open(A) as f:
        model = json.load(f)["model"]
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order = {m: k for k, m in enumerate(merges)}
    for x in {a + b for a, b in merges}:
        parts = list(x)
        while len(parts) > 1:
            k, i = min((order.get(p, len(order)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if k == len(order):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [x]


def test_ranks_that_are_not_the_vocabulary_are_not_used(tmp_path):
    with open(A) as f:
        about = json.load(f)
    own = tmp_path / "own.json"
    own.write_text(json.dumps(about))
    assert cross_tokenizer.Tokenizers(str(own), B).fast is None
    with open(A.removesuffix(".json") + ".tiktoken", "rb") as f:
        lines = f.read().splitlines()
    (tmp_path / "own.tiktoken").write_bytes(b"\n".join(lines))
    assert cross_tokenizer.Tokenizers(str(own), B).fast is not None
    x, y = (line.split()[0] for line in lines[-2:])
    (tmp_path / "own.tiktoken").write_bytes(b"\n".join([*lines[:-2], x + b" " + lines[-1].split()[1], y + b" " + lines[-2].split()[1]]))
    assert cross_tokenizer.Tokenizers(str(own), B).fast is None
