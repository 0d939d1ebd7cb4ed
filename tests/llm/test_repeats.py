"""Removal of repeated strings: brute force over all strings; suffix arrays against plain sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from svloom.llm import queries, repeats, suffixes


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        begins = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(t), int(gone.sum()), begins, hashlib.sha256(bytes(x for x, g in zip(t, gone.tolist(), strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def found(df, length):
    rows = repeats.remove_repeats(df, length).collect()
    for r in rows:
        assert len(r["begins"]) == r["n_spans"] and sum(r["ends"]) - sum(r["begins"]) == r["n_removed"]
    return sorted((tuple(r)[:5] for r in rows), key=str)


def passages(rnd):
    """Texts that share passages at odd places, copies, near copies, self-repeats, runs and multi-byte characters."""
    word = lambda: "".join(rnd.choice("abcdeé 日") for _ in range(rnd.randrange(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    shared = [some(n) for n in (12, 20, 30, 60, 90)]
    rows = [(i, some(rnd.randrange(1, 40)) + rnd.choice(shared) + some(rnd.randrange(0, 30)) + rnd.choice(["", *shared])) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(9)] + [(220 + i, rows[6][1][:200] + str(i) + rows[6][1][200:]) for i in range(20)]
    rows += [(300, "x" * 900), (301, "x" * 199), (302, "ab" * 150), (303, None), (304, ""), (305, shared[3]), (305, shared[3]), (None, shared[4] + shared[4]), (306, some(3000)), (307, shared[2] + some(500) + shared[2])]
    return rows


@pytest.mark.parametrize("length", [64, 200])
def test_equal_to_brute_force(spark, length):
    rows = passages(random.Random(length))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("row", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("n_bytes", F.lit(0))
    assert found(df, length) == brute(rows, length)


def test_crowded_keys_small_shards_and_spans_give_the_same(spark, monkeypatch):
    rows = passages(random.Random(9))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 100)
    for crowd, shard, span in ((2, 400, 300), (512, 3000, 1000)):
        monkeypatch.setattr(repeats, "CROWD", crowd)
        monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
        monkeypatch.setattr(repeats, "SPAN", span)
        # the constants as the session's own process sees them: the pieces are called here
        assert found(df, 100) == want
        parts = [x for t in ("ab" * 400, rows[0][1]) for x in repeats.segments(t.encode(), 100)]
        assert sum(int(x[2].sum()) for x in parts) == 800 - 99 + max(0, len(rows[0][1].encode()) - 99)


def test_given_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op13_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(rows, 200) and sum(r[2] for r in got)


def test_empty_table_and_short_strings(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError, match="64 bytes"):
        repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 63)


def test_suffix_arrays(monkeypatch):
    rnd = random.Random(1)
    for small, short, deep in ((1024, 9, 0), (0, 10**9, 0), (6, 10, 3)):
        monkeypatch.setattr(suffixes, "SMALL", small)
        monkeypatch.setattr(suffixes, "SHORT", short)
        for _ in range(500):
            size = rnd.choice([1, 2, 3, 20])
            s = [rnd.randrange(1, size + 1) for _ in range(rnd.randrange(0, 70))] + [0]
            assert suffixes.suffix_array(np.array(s), size + 1, deep).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_permuted_prefixes():
    rnd = random.Random(2)
    for _ in range(300):
        parts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 50))) for _ in range(rnd.randrange(1, 6))]
        raw = b"".join(p + b"\xff" for p in parts)
        b = np.frombuffer(raw, np.uint8)
        room = np.concatenate([np.arange(len(p), -1, -1) for p in parts])
        sa = suffixes.suffix_array(np.concatenate((b.astype(np.int32) + 1, [0])), 257)[1:]
        shared, before = suffixes.permuted_prefixes(b, sa, room)
        for q, p in zip([-1, *sa[:-1].tolist()], sa.tolist(), strict=True):
            k = 0
            while q >= 0 and k < room[p] and q + k < len(raw) and raw[p + k] == raw[q + k]:
                k += 1
            assert before[p] == q and shared[p] == k
