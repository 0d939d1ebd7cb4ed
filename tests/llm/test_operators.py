"""The ten operators: brute force on small tables, and their edge cases."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from svloom.llm import embedding_dup, language, language_model, mixing, near_dup, packing, queries, sharding, token_count, topk, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def odd_docs(spark):
    """Nulls everywhere, empty, blank, very long, without spaces, repeated rows, a repeated id, a clashing extra column."""
    long_text = " ".join(f"w{i % 997} der die" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 3), (4, long_text, "de", "b", 9), (5, "x" * 20_000, None, "b", 9), (6, "one", "en", None, 3), (7, "One", "en", "a", 3),
        (8, "Hello there, general 😀 日本語 <|endoftext|>", "en", "c", 9), (8, "Hello there, general 😀 日本語 <|endoftext|>", "en", "c", 9), (None, "no id at all", "fr", "c", 3), (9, "12345 ++ 678", "en", "c", 3), (10, long_text, "de", "b", 9), (10, "another text of the same id", "en", "b", 2),
    ]
    d = spark.createDataFrame(rows, DOCS)
    return d.withColumn("component_id", F.lit("clash")).withColumn("score", F.lit(-1)).withColumn("size", F.lit("x"))


def word_sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    return out


def brute_components(ids, sets, num, den):
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(ids)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low[find(i)] for i in range(len(ids))]


# 1 sharding


def test_table_is_filled_in_turns():
    names = [f"n{i}" for i in range(7)]
    table = sharding.lookup_table(names, 211)
    # plain statement of the method: full preference lists, turns until no slot is free
    import hashlib

    prefs = []
    for n in names:
        d = hashlib.md5(n.encode()).hexdigest()
        off, skip = int(d[:15], 16) % 211, int(d[15:30], 16) % 210 + 1
        prefs.append([(off + j * skip) % 211 for j in range(211)])
    want = {}
    while len(want) < 211:
        for i, p in enumerate(prefs):
            free = next((s for s in p if s not in want), None)
            if free is not None:
                want[free] = i
    assert table == [want[s] for s in range(211)]
    share = [table.count(i) for i in range(7)]
    assert max(share) - min(share) <= 1
    fewer = sharding.lookup_table(names[:-1], 211)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 211 * 0.2
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement(spark):
    d = odd_docs(spark)
    out = sharding.place(d, ["doc_id"], ["a", "b", "c"], 101)
    assert out.count() == d.count() and out.columns == [*d.columns, "slot", "shard"]
    assert out.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        sharding.place(d.withColumn("slot", F.lit(1)), ["doc_id"], ["a"], 101)
    assert sharding.place(d.limit(0), ["doc_id"], ["a"], 101).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    clash = d.withColumn("_slot", F.lit("mine")).withColumn("_NO", F.lit("mine"))
    assert {(r["_slot"], r["_NO"]) for r in sharding.place(clash, ["doc_id"], ["a", "b"], 101).collect()} == {("mine", "mine")}
    long_keys = spark.createDataFrame([("k" * 3_000_000,), ("",), (None,), ("null",)], "doc_id string")
    got = {r["doc_id"]: r["slot"] for r in sharding.place(long_keys, ["doc_id"], ["a"], 101).collect()}
    assert len(got) == 4 and got[None] == got["null"]


# 2 token counts


def test_token_counts(spark, docs):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for d in (docs, odd_docs(spark)):
        want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in d.collect())
        got = token_count.token_counts(d).collect()
        assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert token_count.token_counts(docs.limit(0)).count() == 0


def test_transducer_on_random_texts(monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(token_count, "CHUNK", 7)  # maps of many short chunks, often without a word's end
    machine = token_count.Transducer(path)
    rng = random.Random(1)
    letters = " \t\n▁aébcdeithnsor0123.,<>/s日本語テ①😀\x00́ß"
    texts = ["", None, " ", "th" * 300, " " * 99] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    assert machine.counts(texts).tolist() == [len(sp.encode(t or "")) for t in texts]
    monkeypatch.setattr(token_count, "WIDTH", 8)
    narrow = token_count.Transducer(path)
    assert narrow.counts(texts[:60]).tolist() == [len(sp.encode(t or "")) for t in texts[:60]]


# 3 embeddings


def brute_links(ids, xs, labels, cosine):
    good = [x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(x) and labels[i] is not None for i, x in enumerate(xs)]
    links = []
    for i in range(len(ids)):
        for j in range(i):
            if good[i] and good[j] and labels[i] == labels[j] and len(xs[i]) == len(xs[j]):
                a, b = (np.array(x, float) / np.abs(x).max() for x in (xs[i], xs[j]))
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                    links.append((i, j))
    return links


def test_embedding_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(embedding_dup, "TILE", 40)  # buckets of copies span several tiles
    rng = np.random.default_rng(0)
    xs, labels = [], []
    for g in range(40):
        c = rng.normal(size=16)
        for k in range(90 if g == 0 else 4):
            xs.append((c + rng.normal(size=16) * 0.03 * np.linalg.norm(c) / 4).tolist())
            labels.append([0, 0, 0, 1][k % 4] if g % 5 else 0)
    xs += [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [1.0, 2.0], [2.0, 4.0], xs[0], xs[0], [1e300] * 16, [1e-300] * 16]
    labels += [0, 0, 0, 0, 0, 0, 0, 0, None, 2, 2]
    ids = rng.permutation(len(xs)).tolist()
    d = spark.createDataFrame(list(zip(ids, xs, labels, strict=True)), "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    links = brute_links(ids, xs, labels, 0.98)
    n = dict.fromkeys(ids, 0)
    comp = {i: i for i in ids}
    for i, j in links:
        n[ids[i]] += 1
        n[ids[j]] += 1
    for _ in range(50):
        for i, j in links:
            comp[ids[i]] = comp[ids[j]] = min(comp[ids[i]], comp[ids[j]])
    got = {r["vec_id"]: r for r in embedding_dup.embedding_near_duplicates(d, 0.98).collect()}
    found = sum(r["n_links"] for r in got.values()) / max(1, sum(n.values()))
    assert len(got) == len(ids) and found > 0.999 and all(got[i]["n_links"] <= n[i] for i in ids)
    assert sum(got[i]["component_id"] == comp[i] for i in ids) >= len(ids) - 1
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embedding_dup.embedding_near_duplicates(d.limit(0)).count() == 0


def test_planted_links_among_thousands(spark):
    # groups at cosines around the threshold, copies by the hundred, and a crowd that links with nothing
    rng = np.random.default_rng(9)
    xs, labels = rng.normal(size=(4000, 32)), rng.integers(0, 4, 4000).tolist()
    for g in range(150):
        a = xs[20 * g] / np.linalg.norm(xs[20 * g])
        for k in range(1, 5):
            o = rng.normal(size=32)
            o -= (o @ a) * a
            cos = [0.999, 0.985, 0.981, 0.979][k - 1]
            xs[20 * g + k] = (cos * a + math.sqrt(1 - cos**2) * o / np.linalg.norm(o)) * rng.uniform(0.1, 9)
            labels[20 * g + k] = labels[20 * g]
    xs[3200:3900], labels[3200:3900] = xs[0], [labels[0]] * 700
    u = xs / np.linalg.norm(xs, axis=1)[:, None]
    link = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(link, False)
    ids = rng.permutation(4000)
    comp = ids.copy()
    for _ in range(20):
        comp = np.minimum(comp, np.array([comp[link[i]].min() if link[i].any() else comp[i] for i in range(4000)]))
    d = spark.createDataFrame([(int(i), x, int(l)) for i, x, l in zip(ids, xs.tolist(), labels, strict=True)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dup.embedding_near_duplicates(d, 0.98).collect()}
    assert sum(r["n_links"] for r in got.values()) == link.sum() and all(got[int(i)]["n_links"] == n for i, n in zip(ids, link.sum(axis=1), strict=True))
    assert all(got[int(i)]["component_id"] == c for i, c in zip(ids, comp, strict=True))


def test_bands_of_large_plans_miss_as_seldom_as_promised():
    rng = np.random.default_rng(5)
    bits, bands = embedding_dup.band_plan(10_000_000, 0.98)
    missed = 0
    for _ in range(20):
        x, y = rng.normal(size=(2, 2000, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        y -= (x * y).sum(axis=1)[:, None] * x
        y = 0.98 * x + math.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1)[:, None]
        missed += (embedding_dup.band_keys(x, bits, bands) != embedding_dup.band_keys(y, bits, bands)).all(axis=1).sum()
    assert missed <= 15  # 4 expected of 40,000


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 64))
    x[200:] = x[:200] + rng.normal(size=(200, 64)) * 0.15
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = embedding_dup.rotations(64)
    a, b = (embedding_dup.Codes(v, *embedding_dup.codes_of(v, turn), turn) for v in (x[:200], x[200:]))
    true = x[:200] @ x[200:].T
    est = (a.signs @ b.turned.T) / (turn.shape[0] * a.factor)[:, None]
    assert abs((est - true).mean()) < 0.002
    assert (a.upper(b) >= true).mean() > 0.999


# 4 packing


def check_packing(rows, texts, window=1024):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for _, x in texts]
    want = sorted((i is None, i or 0, len(x)) for (i, _), x in zip(texts, ids, strict=True))
    total = {}
    for r in rows:
        total.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    assert {(d is None, d or 0, n) for d, n in total} == set(want)
    by = {}
    for (i, _), x in zip(texts, ids, strict=True):
        by.setdefault((i, len(x)), []).append(x)
    for key, parts in total.items():
        assert sorted((p["start"], p["length"]) for p in parts if p["start"] == 0)
        assert sum(p["length"] for p in parts) == key[1] * len(by[key])
        for p in parts:
            assert any(zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in by[key])
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == window or at & (at - 1) == 0 and at < window
    return sum(n for p in seqs.values() for _, n in p)


def test_packing(spark, docs):
    for d in (docs, odd_docs(spark)):
        check_packing(packing.pack_documents(d).collect(), [(r["doc_id"], r["text"]) for r in d.collect()])
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_neighbours_share_words():
    rng = np.random.default_rng(0)
    tails = [rng.integers(1000 * (i % 3), 1000 * (i % 3) + 60, 300).astype("<u4") for i in range(30)]
    windows = packing.fill(tails, 1024)
    mixed = sum(len({j % 3 for j, _, _ in w}) > 1 for w in windows)
    assert mixed <= 3 and sum(e - s for w in windows for _, s, e in w) == 9000
    index = packing.Index(tails)
    assert {int(j) % 3 for j in np.argsort(-index.scores(4))[:5]} == {1}


def test_packing_keeps_neighbours_in_a_shard(spark, docs, monkeypatch):
    # 60 topics of 10 texts of 400 to 600 tokens: in about 12 shards of 50 tails windows are as much alike as in one shard
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in ("table", "river", "stone", "cloud", "music") for b in range(120)]
    rows = [(i, " ".join(rng.choice(words[10 * (i % 60) : 10 * (i % 60) + 10], int(rng.integers(180, 250))))) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    enc = packing.encoder(None)
    index = packing.Index([np.append(enc.ids(t), 0) for _, t in rows])

    def retrieved(got):
        seqs = {}
        for r in sorted(got, key=lambda r: r["offset"]):
            seqs.setdefault(r["sequence_id"], []).append(r["doc_id"])
        return np.mean([index.scores(s[0])[j] for s in seqs.values() for j in s[1:] if j != s[0]])

    one = packing.pack_documents(d).collect()
    assert len({r["sequence_id"] for r in one if r["length"] < 1024}) > 100
    monkeypatch.setattr(packing, "SHARD_TAILS", 50)
    many = packing.pack_documents(d).collect()
    check_packing(many, rows)
    assert retrieved(many) > 0.8 * retrieved(one)
    check_packing(packing.pack_documents(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    copies = spark.createDataFrame([(None, "the same text again and again")] * 300, "doc_id long, text string")
    got = packing.pack_documents(copies).collect()
    check_packing(got, [(None, "the same text again and again")] * 300)


def test_scores_are_those_of_plain_bm25():
    rng = np.random.default_rng(3)
    tails = [(rng.zipf(1.4, int(rng.integers(1, 90))) % 300).astype("<u4") for _ in range(60)]
    index = packing.Index(tails)
    n, mean = len(tails), np.mean([len(t) for t in tails])
    for i in (0, 7, 33):
        want = []
        for t in tails:
            total = 0.0
            for w in set(tails[i].tolist()):
                df, tf = sum(w in u for u in tails), int((t == w).sum())
                total += max(0, math.log((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
            want.append(total)
        assert np.allclose(index.scores(i), want)


def test_fast_encoder_equals_the_tokenizer():
    enc = packing.encoder(None)
    rng = random.Random(2)
    chars = [chr(c) for c in range(256)]
    texts = [f"{a}{b}{a}x {b}" for a in chars for b in rng.sample(chars, 24)] + ["".join(rng.choices(chars, k=60)) for _ in range(300)]
    assert enc.fast is not None
    assert all(enc.ids(t).tolist() == enc.slow.encode(t, add_special_tokens=False).ids for t in texts)


# 5 top-k


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = np.random.default_rng(1)
    xs = rng.normal(size=(300, 8)).round(1).tolist()
    xs[20:60] = [xs[0]] * 40  # ties
    rows = [(i, x) for i, x in enumerate(xs)] + [(1000, None), (1050, [1.0, None]), (1100, [float("inf")] * 8), (1150, [5.0, 5.0]), (None, xs[3]), (7, xs[7])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    q = np.floor(256 * np.array(xs)).astype(int)
    want = []
    for i in range(0, 300, 50):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(300), -s)) if j != i][:5]
        want += [(i, k + 1, int(j), int(s[j])) for k, j in enumerate(order)]
    got = sorted(map(tuple, topk.exact_top_k(d).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == want
    few = d.where("vec_id in (50, 51, 52)")
    assert topk.exact_top_k(few).count() == 2 and topk.exact_top_k(d.limit(0)).count() == 0


# 6 mixing


def test_mixing(spark, docs):
    for d in (docs, odd_docs(spark)):
        rows = mixing.mix(d).collect()
        assert len(rows) == d.count()
        by = {}
        for r, s in ((r, r["source_size"]) for r in rows):
            by.setdefault((s, r["target"]), []).append(r)
        assert all(r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in rows)
        assert sorted(r["taken"] for r in rows) == sorted(r["taken"] for r in mixing.mix(d.repartition(3)).collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_targets_are_reshared_until_none_is_above(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 5), ("d", 700), (None, 3), ("e", 0)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long"), (5, 2, 1), 3).collect()}
    order = sorted((s for s, _ in sizes if s), key=str) + [None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    cap = {s: 3 * n for s, n in sizes}
    total, fixed = sum(n for _, n in sizes), set()
    while True:
        rest = total - sum(cap[s] for s in fixed)
        share = {s: cap[s] if s in fixed else rest * w[s] / sum(w[x] for x in order if x not in fixed) for s in order}
        over = {s for s in order if s not in fixed and share[s] > cap[s]}
        if not over:
            break
        fixed |= over
    assert all(abs(got[s] - share[s]) < 1e-9 * max(1, share[s]) for s in order)


# 7 language model


def test_language_model(spark, docs):
    import math
    from collections import Counter

    for d in (docs, odd_docs(spark)):
        rows = d.collect()
        texts = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), None]) for r in rows]
        train = lambda i: zlib.crc32(str("null" if i is None else i).encode()) % 5 != 1
        c = Counter(w for i, ws in texts if train(i) for w in ws)
        n, v = sum(c.values()), len(c)
        want = sorted((i or -1, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for i, ws in texts)
        got = language_model.score_texts(d, language.fold(d["doc_id"], 5) != 1).collect()
        assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
        assert all(r["train_tokens"] == n and r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    held = [r for r in language_model.score_texts(docs, language.fold(docs["doc_id"], 5) != 1).collect() if not r["train"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert language_model.score_texts(docs.limit(0), F.lit(True)).count() == 0
    assert language_model.score_texts(docs.limit(3), F.lit(False)).count() == 3


def test_parts_hardly_change_the_model(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    got = []
    for docs_each in (400, 40, 8):
        monkeypatch.setattr(language_model, "BLOCK_DOCS", docs_each)
        got.append({r["doc_id"]: r["score"] / r["n_tokens"] for r in language_model.score_texts(d, language.fold(d["doc_id"], 5) != 1).collect()})
    for g in got[1:]:
        apart = np.abs([g[i] - got[0][i] for i in g])
        assert apart.mean() < 0.02 and apart.max() < 0.3  # draws of other seeds


def test_probabilities_of_a_context_sum_to_one(spark, monkeypatch):
    # p(w | begin) p(end | w) is the probability of the text "w"; words that never end a text are followed by "stop"
    rng = np.random.default_rng(2)
    names = [f"w{i}" for i in range(12)]
    texts = [" ".join([*rng.choice(names, 5), "stop"]) for _ in range(150)]
    seen = sorted({w for t in texts for w in t.split()})
    asked = [*seen, "never-seen", ""]
    d = spark.createDataFrame([*((i, t) for i, t in enumerate(texts)), *((1000 + i, w) for i, w in enumerate(asked)), *((2000 + i, f"{w} {w}") for i, w in enumerate(asked) if w)], "doc_id long, text string")
    p = {r["doc_id"]: 10 ** r["score"] for r in language_model.score_texts(d, F.col("doc_id") < 1000).collect()}
    # mass of what begins a text: texts "w" over p(end | w); the latter from the mass after w, all pairs asked one context at a time
    pairs = [(u, v) for u in [*seen, "never-seen"] for v in [*seen, "never-seen"]]
    e = spark.createDataFrame([*((i, t) for i, t in enumerate(texts)), *((10_000 + k, f"{u} {v}") for k, (u, v) in enumerate(pairs))], "doc_id long, text string")
    q = {r["doc_id"]: 10 ** r["score"] for r in language_model.score_texts(e, F.col("doc_id") < 1000).collect()}
    one = {w: p[1000 + i] for i, w in enumerate(asked)}
    two = {uv: q[10_000 + k] for k, uv in enumerate(pairs)}
    # with x(u) = p(u | begin): sum over v of two(u, v) / p(end | v) + one(u) = x(u), and one(v) = x(v) p(end | v)
    words_ = [*seen, "never-seen"]
    x = np.full(len(words_), 1 / len(words_))
    for _ in range(2000):
        x = np.array([one[u] + sum(two[u, v] * x[j] / one[v] for j, v in enumerate(words_)) for u in words_])
        x *= (1 - one[""]) / x.sum()
    again = np.array([one[u] + sum(two[u, v] * x[j] / one[v] for j, v in enumerate(words_)) for u in words_])
    assert np.allclose(again, x, rtol=1e-3)


# 8 near-duplicates


@pytest.mark.parametrize("whole", [4, 512])
@pytest.mark.parametrize(("k", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_near_duplicates(spark, docs, monkeypatch, k, num, den, whole):
    monkeypatch.setattr(near_dup, "WHOLE_BUCKET", whole)
    monkeypatch.setattr(near_dup, "SPREAD", 2)
    rows = docs.select("doc_id", "text").collect()
    base = rows[3]["text"] + " " + rows[7]["text"]
    words = base.split()
    rng = random.Random(3)
    extra = []
    for i in range(60):  # a chain of near copies, some near the threshold
        w = list(words)
        for _ in range(rng.randint(0, max(1, len(w) // 60))):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
        extra.append((10_000 + i, " ".join(w)))
    extra += [(20_000, None), (20_001, " "), (20_002, "A b"), (20_003, "a  B"), (20_004, "a b c")]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = [(r["doc_id"], r["text"]) for r in d.collect()]
    sets = word_sets([t for _, t in texts], k)
    want = brute_components([i for i, _ in texts], sets, num, den)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(d, k, num, den).collect()}
    assert [got[i]["component_id"] for i, _ in texts] == want
    assert [got[i]["n_shingles"] for i, _ in texts] == [len(s) for s in sets]
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_duplicate_tiles_and_edges(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE_HASHES", 500)  # one group of near copies over many tiles
    rng = random.Random(0)
    base = [f"w{rng.randrange(999)}" for _ in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(120)] = f"q{i}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in near_dup.near_duplicates(d, 3, 85, 100).collect()} == {0}
    out = near_dup.near_duplicates(odd_docs(spark), 3, 85, 100)
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in out.collect())
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6), (8, 8), (8, 8), (-1, -1), (9, 9), (10, 4), (10, 10)])
    assert near_dup.near_duplicates(d.limit(0), 3, 85, 100).count() == 0


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(5)
    for share in (0.95, 0.85):
        x = rng.integers(0, 2**63, 2000).astype(np.uint64)
        y = x.copy()
        n = int(2000 * (1 - share) / (1 + share))
        y[:n] = rng.integers(0, 2**63, n).astype(np.uint64)
        s = near_dup.odd_sketch(near_dup.minhash(np.concatenate((np.unique(x), np.unique(y))), np.array([0, len(np.unique(x))]), near_dup.SAMPLES))
        z = int(np.bitwise_count(s[0] ^ s[1]).sum())
        est = 1 + near_dup.BITS * np.log(1 - 2 * z / near_dup.BITS) / (4 * near_dup.SAMPLES)
        assert abs(est - share) < 0.12 and z <= near_dup.sketch_limit(share)
    assert near_dup.bands_for(0.85) == (21, 6)


def test_bucket_limits_are_sound():
    # sketches of pairs at known distances: farther ones hardly follow, those within reach are hardly missed
    rng = np.random.default_rng(6)

    def counts(distance, n=4000):
        x = rng.integers(0, 2**63, (n, near_dup.SAMPLES)).astype(np.uint64)
        y = np.where(rng.random(x.shape) < distance, rng.integers(0, 2**63, x.shape).astype(np.uint64), x)
        return np.bitwise_count(near_dup.odd_sketch(x) ^ near_dup.odd_sketch(y)).sum(axis=1)

    near = near_dup.sure_limit(near_dup.FOLLOW, near_dup.BUCKET_SIGMAS)
    assert (counts(near_dup.FOLLOW) <= near).mean() < 0.004 and (counts(0.4) <= near).mean() == 0
    for threshold in (0.8, 0.85):
        for times in (1, 2):
            reach = 1 - threshold + times * near_dup.FOLLOW
            assert (counts(reach) > near_dup.sketch_limit(threshold, reach, near_dup.BUCKET_SIGMAS)).mean() < 0.004
        assert (counts(1 - threshold) > near_dup.sketch_limit(threshold)).mean() < 0.001


# 9 language ID, 10 toxicity


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(r) > 150 and np.mean([x["lang"] == x["lang_pred"] for x in r]) > 0.97 and all(0 <= x["score"] <= 1 for x in r)
    model = language.trained(d)
    got = {(x["doc_id"], x["lang_pred"]) for x in language.identify(odd_docs(spark), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (9, "und")} <= got and (4, "de") in got
    both = d.where("lang = 'de'").first()["text"] + " " + d.where("lang = 'es'").first()["text"]
    assert set(model.predict([both])[2][0]) >= {"de", "es"}
    assert language.identify(d.limit(0), model).count() == 0
    none = language.trained(d.limit(0))
    assert {x["lang_pred"] for x in language.identify(d.limit(5), none).collect()} == {"und"}


def plain_trigrams(text):
    """Counts of the hash buckets of a text's byte trigrams, byte by byte."""
    kept = [32]
    for c in text.lower().encode() + b" ":
        c = c if 97 <= c <= 122 or c >= 128 else 32
        if (c, kept[-1]) != (32, 32):
            kept.append(c)
    return Counter(((a << 16 | b << 8 | c) * 0x9E3779B97F4A7C15 % 2**64) >> 50 for a, b, c in zip(kept, kept[1:], kept[2:]))


def plain_model(rows):
    """Languages, their frequencies and the probability of each kept trigram by language."""
    names = sorted({l for _, l in rows})
    counts = {l: Counter() for l in names}
    for t, l in rows:
        counts[l].update(plain_trigrams(t))
    p = {l: {b: (counts[l][b] + 0.5) / (counts[l].total() + 0.5 * language.BUCKETS) for b in range(language.BUCKETS)} for l in names}
    gain = {b: sum(p[l][b] * math.log(p[l][b] / (sum(p[m][b] for m in names) / len(names))) for l in names) for b in range(language.BUCKETS)}
    best = sorted(gain, key=lambda b: -gain[b])[: language.KEPT]
    total = {l: sum(p[l][b] for b in best) for l in names}
    return {l: sum(m == l for _, m in rows) / len(rows) for l in names}, {l: {b: p[l][b] / total[l] for b in best} for l in names}


def plain_identify(text, prior, p):
    """(language, score, set) by expectation-maximisation in plain loops."""
    some = next(iter(p.values()))
    n = {b: c for b, c in plain_trigrams(text).items() if b in some}

    def mixture(langs):
        pi = {l: 1 / len(langs) for l in langs}
        for _ in range(language.ROUNDS):
            new = dict.fromkeys(langs, 0.0)
            for b, c in n.items():
                whole = sum(pi[l] * p[l][b] for l in langs)
                for l in langs:
                    new[l] += c * pi[l] * p[l][b] / whole
            pi = {l: x / sum(n.values()) for l, x in new.items()}
        return pi, sum(c * math.log(sum(pi[l] * p[l][b] for l in langs)) for b, c in n.items())

    alone = {l: sum(c * math.log(p[l][b]) for b, c in n.items()) for l in p}
    chosen = [max(p, key=lambda l: alone[l] + math.log(prior[l]))]
    every, _ = mixture(list(p))
    pi, fit, penalty = every, alone[chosen[0]], language.PENALTY * math.log(max(2, sum(n.values())))
    while len(chosen) < len(p):
        more = [*chosen, max((l for l in p if l not in chosen), key=every.get)]
        mixed, value = mixture(more)
        if value - fit <= penalty:
            break
        chosen, pi, fit = more, mixed, value
    top = chosen[0] if len(chosen) == 1 else max(pi, key=pi.get)
    return top, pi[top], set(chosen)


def test_mixtures_against_plain_loops(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    # rows without a language, a text or an id, and repeats, among those to learn from
    odd = [(9001, "no language", None), (9002, None, "de"), (None, "ein Text ohne Nummer", "de"), (9003, "dos veces lo mismo", "es"), (9003, "dos veces lo mismo", "es"), (9004, "", "en")]
    d = d.unionByName(spark.createDataFrame(odd, d.schema))
    rows = d.collect()
    model = language.trained(d)
    prior, p = plain_model([(r["text"], r["lang"]) for r in rows if r["text"] is not None and r["lang"] is not None])
    assert model.languages == list(p) and np.allclose(model.prior, list(prior.values()))
    assert len(set(model.kept.tolist()) & set(next(iter(p.values())))) > 0.99 * language.KEPT  # equal gains may be kept in another order
    p = {l: dict(zip(model.kept.tolist(), model.p[:, i].tolist(), strict=True)) for i, l in enumerate(p)}
    by = {l: [r["text"] for r in rows if r["lang"] == l and r["text"]] for l in p}
    texts = [t for ts in by.values() for t in ts[:6]] + [a[:400] + " " + b[:300] for a, b in itertools.pairwise(ts[0] for ts in by.values())]
    for t, lang, score, languages in zip(texts, *model.predict(texts), strict=True):
        want = plain_identify(t, prior, p)
        assert (lang, set(languages)) == (want[0], want[2]) and score == pytest.approx(want[1], abs=1e-9)
    assert any(len(s) > 1 for s in model.predict(texts)[2])


def test_all_languages_are_learned(spark, monkeypatch):
    rng = np.random.default_rng(1)
    own = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for _ in range(80)]
    rows = [(i, " ".join(rng.choice(own[i % 80], 60)), f"l{i % 80:02d}") for i in range(320)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.trained(d)
    assert len(model.languages) == 80 and np.mean([p == r[2] for p, r in zip(model.predict([r[1] for r in rows])[0], rows, strict=True)]) > 0.97
    monkeypatch.setattr(language, "LANGUAGES", 79)
    with pytest.raises(ValueError):
        language.trained(d)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    r = queries.op10_toxicity(spark, sf).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()

    def auc(rows):
        s, y = np.array([x["score"] for x in rows]), np.array([x["toxic"] for x in rows])
        order = s.argsort().argsort()
        return (order[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())

    # the toxic words of the other languages are put together from ordinary syllables, and some 30 documents each have them
    assert auc(r) > 0.75 and auc([x for x in r if x["lang"] == "en"]) > 0.9 and all(x["predicted"] == (x["score"] >= 0.5) for x in r)
    d = odd_docs(spark)
    model = toxicity.trained(d, labels.limit(0))
    assert {x["score"] for x in toxicity.score(d, model).collect()} == {0.0} and toxicity.score(d.limit(0), model).count() == 0


def test_toxicity_against_plain_statement(spark):
    import zstandard

    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.trained(d, labels, fold_n=5, held=0)
    both = model.dictionaries
    assert both.toxic[:4] == both.ordinary[:4] == b"\x37\xa4\x30\xec"  # a trained dictionary's magic number
    rows = [(r["doc_id"], r["text"]) for r in d.unionByName(odd_docs(spark).select(d.columns)).collect()]
    got = sorted((r["doc_id"] or -1, r["score"]) for r in toxicity.score(d.unionByName(odd_docs(spark).select(d.columns)), model).collect())
    p = zstandard.ZstdCompressionParameters(window_log=18, chain_log=16, hash_log=16, search_log=5, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
    size = [lambda w, c=zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_FULLDICT), compression_params=p): len(c.compress(w)) for x in (both.ordinary + bytes(len(both.toxic)), both.ordinary + both.toxic)]
    mean, spread, w = model.weights
    want = []
    for i, t in rows:
        b = (" " + "".join(c if c.isalpha() and c.isascii() or ord(c) > 127 else " " for c in (t or "").lower()) + " ").encode()
        while b"  " in b:
            b = b.replace(b"  ", b" ")
        s = sorted((size[0](b[k : k + 34]) - size[1](b[k : k + 34]) for k in range(0, max(1, len(b)), 24)), reverse=True)
        x = [math.log(len(s)), *(s + [0, 0])[:3], *(20 * sum(v >= k for v in s) / len(s) for k in (2, 4, 6)), *(math.log1p(sum(v >= k for v in s)) for k in (2, 3, 4, 5, 6))]
        want.append((i or -1, 1 / (1 + math.exp(-sum((a - m) / d * c for a, m, d, c in zip(x, mean, spread, w[:-1], strict=True)) - w[-1]))))
    assert [i for i, _ in got] == [i for i, _ in sorted(want)] and np.allclose([s for _, s in got], [s for _, s in sorted(want)])


def test_dictionaries_are_trained_at_every_size():
    words = [f" word{i:03d}{'xyz'[i % 3]} ".encode() for i in range(150)]
    samples = [b"".join(words[(7 * i + j) % 150] for j in range(8)) for i in range(140)]
    assert sum(map(len, samples)) < 4 * toxicity.TOXIC_DICT
    made = toxicity.dictionary(samples, toxicity.TOXIC_DICT, 20)
    assert made[:4] == b"\x37\xa4\x30\xec"
    assert toxicity.dictionary([b"ab "], toxicity.TOXIC_DICT, 20) == b"" and toxicity.learn([b" ab "], [b" cd "]) is None


def test_repeated_passages_are_learned_once():
    texts = [b" a b c d e ", b" x b c d y ", b" c d ", b" d e f ", b" a b c d e ", b""]
    assert [t.split() for t in toxicity.once(texts)] == [[*b"a b c d e".split()], [b"x", b"y"], [b"c", b"d"], [b"d", b"e", b"f"], [], []]
    assert toxicity.once([]) == []


def test_toxicity_learns_from_whole_texts(spark, monkeypatch):
    rows = [(i, f"{i} " + "plain words " * (3000 if i % 2 else 10) + "end") for i in range(40)]
    d = spark.createDataFrame([*rows, (0, rows[0][1]), (1, None), (None, "x")], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([*((i, int(i < 20)) for i in range(40)), (3, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    seen = [(r["toxic"], r["text"]) for r in toxicity.sampled(d, labels).collect()]
    assert sorted(seen) == sorted((int(i < 20), t) for i, t in rows)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 200_000)
    seen = [(r["toxic"], r["text"]) for r in toxicity.sampled(d, labels).collect()]
    texts = {t for _, t in rows}
    assert all(0 < sum(y == k for y, _ in seen) < 20 for k in (0, 1)) and texts.issuperset(t for _, t in seen)


def test_frequent_words_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HELD_WORDS", 3)
    d = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 9 + 1))) for i in range(90)], "doc_id long, text string").repartition(5)
    want = {language_model.word_hashes([f"w{j}".encode()])[0].item(): j + 1 for j in range(4)}
    counts = language_model.word_counts(d).cache()
    assert language_model.frequent_words(counts, 4) == want
    sizes = language_model.sizes_of(counts, want)
    assert (sizes.tokens, sizes.vocabulary) == (90 + 450, 10) and sizes.customers[:5].tolist() == [90, 90, 80, 70, 60]
    assert language_model.frequent_words(language_model.word_counts(d.limit(0)), 4) == {}


def test_components_with_a_hub(spark):
    from svloom.llm.components import components

    r = random.Random(3)
    edges = [(7, r.randrange(5000)) for _ in range(6000)] + [(r.randrange(9000, 12000), r.randrange(9000, 12000)) for _ in range(1400)] + [(20000 + i, 20001 + i) for i in range(300)] + [(50, 50), (60000, 60000), (None, 1), (2, None)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
