"""The pipeline stage by stage against brute force, and as a whole."""

from collections import Counter
from pathlib import Path

import corpus_pipeline as cp
from svloom.llm import language, mixing, toxicity
from svloom.llm.common import table, written
from svloom.ship import shared_dir

from test_operators import brute_components, check_packing, odd_docs, word_sets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    first = written(cp.keep_languages(spark, docs, SF), "t")
    found = language.identify(docs, language.trained(docs)).where("lang_pred <> 'und'").select("doc_id")
    assert sorted(r["doc_id"] for r in first.collect()) == sorted(r["doc_id"] for r in found.collect())
    assert first.columns == names and first.count() == docs.count()  # every document has letters
    second = written(cp.drop_toxic(spark, first, SF), "t")
    model = toxicity.trained(first, table(spark, SF, "labels"))
    bad = {r["doc_id"] for r in toxicity.score(first, model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in second.collect()} == {r["doc_id"] for r in first.collect()} - bad
    third = written(cp.drop_near_duplicates(spark, second, SF), "t")
    rows = second.collect()
    comp = brute_components([r["doc_id"] for r in rows], word_sets([r["text"] for r in rows], 5), 80, 100)
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(set(comp))
    fourth = written(cp.mix_sources(spark, third, SF), "t")
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(third).collect() if r["taken"]}
    assert fourth.columns == names and Counter(r["doc_id"] for r in fourth.collect()) == want
    check_packing(cp.pack(spark, fourth, SF).collect(), [(r["doc_id"], r["text"]) for r in fourth.collect()])


def test_run_and_odd_rows(spark):
    assert [n for n, _ in cp.STAGES] == ["language_id", "toxicity", "minhash_near_dup", "mixing", "packing"]
    left = lambda: {p.name for p in (Path(shared_dir(spark)) / "svloom").iterdir()}
    before = left()
    out = cp.run(spark, SF)
    assert out.count() > 0 and [n.split("-")[0] for n in left() - before] == ["packing"]
    for docs in (odd_docs(spark), odd_docs(spark).limit(0)):
        empty = docs.count() == 0
        for _, stage in cp.STAGES[:-1]:
            docs = written(stage(spark, docs, SF), "t")
        out = cp.pack(spark, docs, SF)
        assert (out.count() == 0) if empty else out.where("doc_id in (1, 2, 3, 9) or doc_id is null").count() == 0


def test_unlabelled_texts_are_kept(spark):
    rows = [(1, "some words", None), (2, "日本語", None), (3, "12 + 3", None), (4, None, None), (5, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in cp.keep_languages(spark, d, "").collect()) == [1, 2]


def test_columns_with_the_stages_own_names_stay(spark):
    docs = table(spark, SF, "documents")
    own = ("_copy", "_times", "row_key", "ROW_KEY_", "mix_id", "mix_source", "mix_times", "mix_copy", "mark", "group", "times", "label")
    for c in own:
        docs = docs.withColumn(c, docs["doc_id"] * 7)
    names = docs.columns
    for _, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "t")
        assert docs.columns == names and docs.where(" or ".join(f"`{c}` <> doc_id * 7 or `{c}` is null" for c in own)).count() == 0
    assert docs.count() > 0


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    base = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"else{i}" for i in range(60))
    rows = [(5, base, "a"), (10, other, "a"), (10, base + " end", "b"), (10, other, "a"), (12, "12 34", "a"), (12, "third text of its own", None), (13, "", "a"), (14, None, "a")]
    d = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    good = sorted((r["doc_id"], r["text"]) for r in cp.keep_languages(spark, d, SF).collect())
    assert good == sorted((i, t) for i, t, _ in rows if t not in ("12 34", "", None))
    kept = sorted((r["doc_id"], r["text"] or "") for r in cp.drop_near_duplicates(spark, d, SF).collect())
    assert kept == sorted([(5, base), (10, other), (12, "12 34"), (12, "third text of its own"), (13, ""), (14, "")])
    mixed = cp.mix_sources(spark, d, SF)
    times = {(r["doc_id"], r["source"]): r["times"] for r in mixing.mix(d).collect()}
    want = Counter()
    for i, t, s in rows:
        want[i, t] += times[i, s] if (t or "").split() else 0
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == +want
