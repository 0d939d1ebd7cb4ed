"""The set-based plan against a sequential walk over the reads, written from the definitions."""

import random
from collections import Counter, defaultdict

import pytest

from svloom.functions import flags as fl
from svloom.operators.filters import Library
from svloom.options import Options
from svloom.plans import queries as q
from svloom.plans.pipeline import Analysis
from svloom.sources.reads import READS, reads_from_orders

SF = "/root/testdata/sf0.001"
NEED = {"libA": 35, "libB": 30}


def cls_of(r, lib):
    up, low = (450, 200) if lib == "libA" else (440, 210)
    f = r["flag"]
    if f & 0x400 or not f & 1:
        return fl.NA
    if f & 4:
        return fl.UNMAPPED
    if f & 8:
        return fl.MATE_UNMAPPED
    if r["tid"] != r["mtid"]:
        return fl.CTX
    rev, mrev = bool(f & 16), bool(f & 32)
    if rev == mrev:
        return fl.RR if rev else fl.FF
    if (r["pos"] < r["mpos"]) == rev:
        return fl.RF
    size = abs(r["isize"])
    return fl.LARGE if size > up else fl.SMALL if size < low else fl.NORMAL_FR


def walk(rows, window, opts):
    """One pass: regions, batches, breadth-first linking with consumption of reads."""
    rows = [r for r in rows if not r["flag"] & 0x900 and r["tid"] >= 0]
    for r in rows:
        r["lib"] = "libB" if r["rg"] == "rgB" else "libA"
        r["rev"], r["q"] = int(bool(r["flag"] & 16)), r["am"] if r["am"] is not None else r["mapq"]
    rows.sort(key=lambda r: (r["tid"], r["pos"], r["rev"], r["qname"], r["mate"]))
    run, regions, names, out = Counter(), [], {}, []
    where, edge = defaultdict(list), Counter()
    cur, nuc, longest = [], 0, 0
    reads_of = {}

    def flush():
        near = defaultdict(dict)
        for (a, b), n in edge.items():
            near[a][b] = near[b][a] = n
        for root in sorted(near):
            level = [root]
            while level:
                nxt = []
                for v in level:
                    for w in sorted(near.get(v, {})):
                        n = near[v].pop(w)
                        if n < opts.min_read_pair:
                            continue
                        if w != v:
                            near[w].pop(v, None)
                        nxt.append(w)
                        call(min(v, w), max(v, w))
                    near.pop(v, None)
                level = nxt
        edge.clear()

    def call(a, b):
        seen, pairs = {}, []
        for x in [a] if a == b else [a, b]:
            for r in reads_of[x]:
                if r["qname"] in seen:
                    pairs.append(r)
                    del seen[r["qname"]]
                else:
                    seen[r["qname"]] = r
        for x in {a, b}:
            reads_of[x] = [r for r in reads_of[x] if r["qname"] in seen]
        votes = Counter(r["cls"] for r in pairs)
        if len(pairs) < opts.min_read_pair:
            return
        flag = max(sorted(votes), key=lambda k: votes[k])
        if votes[flag] < opts.min_read_pair:
            return
        sup = Counter(r["bam_file"] for r in pairs if r["cls"] == flag)
        btw = {k: n for k, n in (regions[b]["lo"] - regions[a]["hi"]).items() if n > 0} if a != b else {}
        out.append({"a": a, "b": b, "flag": flag, "n": votes[flag], "sup": dict(sup), "between": btw, "pad": longest, "span": sum(abs(r["isize"]) for r in pairs if r["cls"] == flag)})

    def close():
        start, end = cur[0]["pos"], cur[-1]["pos"]
        cov = nuc / (end - start + 1 + longest)
        if end - start > opts.min_len and cov < opts.coverage_limit:
            i = len(regions)
            regions.append({"lo": cur[0]["at"], "hi": cur[-1]["at"], "start": start, "end": end})
            reads_of[i] = list(cur) if len(cur) >= opts.min_read_pair else []
            for r in reads_of[i]:
                where[r["qname"]].append(i)
                if len(where[r["qname"]]) == 2:
                    x, y = where[r["qname"]]
                    edge[min(x, y), max(x, y)] += 1
            if (i + 1) % (opts.buffer + 1) == 0:
                flush()

    for r in rows:
        r["cls"] = cls_of(r, r["lib"])
        if r["cls"] == fl.NA or r["flag"] & 12 or r["q"] <= NEED[r["lib"]]:
            continue
        if r["flag"] & 0x40F == 3:
            run[r["bam_file"]] += 1
        r["at"] = Counter(run)
        if r["cls"] in (fl.NORMAL_FR, fl.NORMAL_RF):
            continue
        r["cls"] = fl.FF if r["cls"] == fl.RR else r["cls"]
        breaks = bool(cur) and (r["tid"] != cur[-1]["tid"] or r["pos"] - cur[-1]["pos"] > window)
        if cur:
            nuc, longest = nuc + r["qlen"], max(longest, r["qlen"])
        if breaks:
            close()
            cur, nuc, longest = [], 0, 0
        cur.append(r)
    if cur:
        close()
        flush()
    return out


@pytest.mark.parametrize(("odd", "opts"), [(False, Options(score_threshold=-1)), (True, Options(score_threshold=-1, buffer=4)), (False, Options(score_threshold=-1, min_len=40, coverage_limit=2, min_read_pair=3, buffer=20))])
def test_plan_equals_walk(spark, odd, opts):
    rows = [r.asDict() for r in reads_from_orders(spark, SF, odd).collect()]
    want = walk(rows, 250, opts)
    a = q.analysis(spark, SF, odd, opts=opts)
    got = a.calls.orderBy("flush", "rank").collect()
    assert len(want) > 20
    assert [(r["ea"], r["eb"], r["flag"], r["num_reads"]) for r in got] == [(w["a"], w["b"], w["flag"], w["n"]) for w in want]
    assert [{s["key"]: s["reads"] for s in r["support"]} for r in got] == [w["sup"] for w in want]
    pads = {(r["ea"], r["eb"]): r["pad"] for r in q.calls.pad_lengths(a.table, a.regions, opts).join(a.order.select("flush", q.c("a").alias("ea"), q.c("b").alias("eb")), "flush").collect()}
    assert [pads[w["a"], w["b"]] for w in want] == [w["pad"] for w in want]
    between = defaultdict(dict)
    for r in a.between.collect():
        between[r["a"], r["b"]][r["key"]] = r["reads"]
    assert [between.get((w["a"], w["b"]), {}) for w in want] == [w["between"] for w in want]


def test_order_of_input_and_partitions_do_not_matter(spark):
    d = reads_from_orders(spark, SF)
    a = Analysis(d, q.LIBS, q.RG_LIB, window=250).calls
    b = Analysis(d.repartition(7, "qname"), q.LIBS, q.RG_LIB, window=250).calls
    names = ["flush", "rank", "ea", "eb", "pos1", "pos2", "size", "score"]
    assert sorted(map(tuple, a.select(names).collect())) == sorted(map(tuple, b.select(names).collect()))


def row(**k):
    base = {"bam_file": "a.bam", "qname": "q", "flag": 1 | 32 | 64, "tid": 0, "pos": 100, "mapq": 60, "am": None, "rg": "rgA", "mtid": 0, "mpos": 400, "isize": 300, "qlen": 50, "mate": 1}
    return {**base, **k}


@pytest.mark.parametrize(
    ("change", "cls"),
    [({"flag": 0x400 | 1}, fl.NA), ({"flag": 0}, fl.NA), ({"flag": 1 | 4 | 8}, fl.UNMAPPED), ({"flag": 1 | 8}, fl.MATE_UNMAPPED), ({"mtid": 3}, fl.CTX), ({"flag": 1 | 48}, fl.RR), ({"flag": 1}, fl.FF),
     ({"flag": 1 | 16}, fl.RF), ({"mpos": 100}, fl.RF), ({"isize": 450}, fl.NORMAL_FR), ({"isize": 451}, fl.LARGE), ({"isize": -451}, fl.LARGE), ({"isize": 200}, fl.NORMAL_FR), ({"isize": 199}, fl.SMALL)],
)
def test_classes_at_their_edges(spark, change, cls):
    d = spark.createDataFrame([tuple(row(**change).values())], READS)
    assert Analysis(d, q.LIBS, q.RG_LIB).reads.first()["cls"] == cls


def test_admission_edges(spark):
    rows = [row(qname="eq", mapq=35), row(qname="over", mapq=36), row(qname="am", mapq=60, am=35), row(qname="am2", mapq=10, am=36), row(qname="sec", flag=1 | 32 | 256), row(qname="sup", flag=1 | 32 | 2048), row(qname="off", tid=-1), row(qname="norg", rg=None), row(qname="big", isize=2_000_000_000), row(qname="bigctx", mtid=2, isize=2_000_000_000)]
    d = spark.createDataFrame([tuple(r.values()) for r in rows], READS)
    a = Analysis(d, q.LIBS, q.RG_LIB)
    assert {r["qname"] for r in a.admitted.collect()} == {"over", "am2", "norg", "bigctx"}
    assert a.reads.where("qname = 'norg'").first()["lib"] == "libA"


def test_empty_input_gives_no_calls(spark):
    assert Analysis(spark.createDataFrame([], READS), q.LIBS, q.RG_LIB, window=250).calls.count() == 0


def test_gap_of_exactly_the_window_does_not_part(spark):
    rows = [row(qname=f"q{i}", pos=p, isize=900) for i, p in enumerate((100, 350, 601))]
    a = Analysis(spark.createDataFrame([tuple(r.values()) for r in rows], READS), q.LIBS, q.RG_LIB, window=250)
    assert [r["island"] for r in a.anomalous.orderBy("pos").collect()] == [1, 1, 2]


def test_buckets_do_not_change_islands(spark):
    from svloom.operators import regions

    a = q.analysis(spark, SF)
    from svloom.operators.filters import anomalous

    small = regions.islands(anomalous(a.admitted), a.window_row, bucket=97)
    assert sorted(map(tuple, small.select("qname", "mate", "island").collect())) == sorted(map(tuple, a.anomalous.select("qname", "mate", "island").collect()))


def test_majority_tie_goes_to_the_lowest_class(spark):
    d = spark.createDataFrame([(0, 1, 0, 0, k) for k in (4, 4, 2, 2, 8)], "ea long, eb long, flush long, rank long, cls int")
    r = q.calls.flag_votes(d).first()
    assert (r["flag"], r["flag_pairs"], r["pairs"]) == (2, 2, 5)


def test_walk_is_breadth_first_by_batch(spark):
    e = spark.createDataFrame([(1, 2, 2), (1, 5, 2), (2, 2, 3), (2, 9, 2), (3, 4, 1), (5, 9, 2)], "a long, b long, weight long")
    got = {(r["a"], r["b"]): (r["flush"], r["rank"]) for r in q.links.visit_order(e, Options(buffer=100)).collect()}
    assert got == {(1, 2): (0, 0), (1, 5): (0, 1), (2, 2): (0, 2), (2, 9): (0, 3), (5, 9): (0, 4)}


def test_random_reads_against_walk(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        tid, pos = rng.randrange(2), rng.randrange(0, 6000)
        size, kind = rng.choice([300, 300, 60, 900, 1500]), rng.choice([(0, 1), (0, 1), (0, 0), (1, 1), (1, 0)])
        mt, mp = (1 - tid, rng.randrange(6000)) if rng.random() < 0.1 else (tid, pos + size)
        for m, (t, p, ot, op, r, o) in enumerate(((tid, pos, mt, mp, *kind), (mt, mp, tid, pos, *kind[::-1])), 1):
            rows.append(row(qname=f"r{i}", flag=1 + 16 * r + 32 * o + (64 if m == 1 else 128) + (2 if size == 300 and kind == (0, 1) else 0), tid=t, pos=p, mtid=ot, mpos=op, isize=size, qlen=40 + i % 9, mate=m, bam_file="ab"[i % 2] + ".bam", rg="rg" + "AB"[i % 2]))
    opts = Options(buffer=3, score_threshold=-1)
    want = walk([dict(r) for r in rows], 30, opts)
    got = Analysis(spark.createDataFrame([tuple(r.values()) for r in rows], READS), q.LIBS, q.RG_LIB, opts, window=30).calls.orderBy("flush", "rank").collect()
    assert [(r["ea"], r["eb"], r["flag"], r["num_reads"]) for r in got] == [(w["a"], w["b"], w["flag"], w["n"]) for w in want]


LIBRARY = Library("x", "x.bam", 475.76, 28.67, 532.53, 311.36, 90.0)


def test_published_arithmetic(spark):
    """Worked figures of a deletion between two regions and of a library's coverage."""
    d = spark.createDataFrame([(fl.LARGE, 29185000, 29185376, 29186121, 29186500, 90)], "flag int, start1 long, end1 long, start2 long, end2 long, pad int")
    x = q.calls.breakpoints(d)
    r = x.select((q.calls.padded(q.c("pos1"), q.c("pos2")) + 1).alias("p1"), (q.c("pos2") + 1).alias("p2"), "pos1", "pos2").first()
    assert (r["p1"], r["p2"]) == (29185462, 29186122)
    assert round(30 / (2566 / 5626088 * (r["pos2"] - r["pos1"])) * 2, 1) == 176.6
    from svloom.operators import filters, stats

    libs = filters.library_table(d, [LIBRARY])
    hist = spark.createDataFrame([("x", 2566)], "lib string, reads long")
    covered = spark.createDataFrame([(5626088,)], "covered long")
    c = stats.coverage(hist, libs, covered).first()
    assert abs(c["sequence_coverage"] - 0.0410481) < 1e-6 and abs(c["physical_coverage"] - 0.108495) < 1e-6
