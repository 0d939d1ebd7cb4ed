"""DuckDB SQL for the queries, written from the operators' definitions and not from their code."""

from __future__ import annotations


def reads(odd: bool = False) -> str:
    extra = "".join(f" + CASE WHEN fid % {n} = m THEN {b} ELSE 0 END" for n, b in ((97, 256), (89, 2048), (83, 1024), (79, 4), (73, 8))) if odd else ""
    tid = "CASE WHEN fid % 71 = m THEN -1 ELSE t END" if odd else "t"
    am = "CASE WHEN fid % 7 = 0 THEN fid * 31 % 60 END" if odd else "NULL"
    rg = "CASE WHEN fid % 53 = 0 THEN NULL WHEN fid % 59 = 0 THEN 'rgX' ELSE 'rg' || lb END" if odd else "'rg' || lb"
    return f"""
o AS (SELECT o_custkey AS cust, o_orderkey AS fid, (o_orderkey * 7919) % 1000 AS r, o_orderpriority AS prio FROM orders),
k AS (SELECT *, cust % 5 AS tid, (cust // 5) * 3000 AS base, CASE WHEN r % 10 < 5 THEN 'N' WHEN r % 20 = 19 THEN 'INS2' WHEN r % 20 = 9 THEN 'INS' WHEN r % 10 = 8 THEN 'CTX'
      WHEN cust % 6 = 0 THEN 'DEL' WHEN cust % 6 = 1 THEN 'INS' WHEN cust % 6 = 2 THEN 'FF' WHEN cust % 6 = 3 THEN 'RF' WHEN cust % 6 = 4 THEN 'CTX' ELSE 'RR' END AS kind FROM o),
f AS (SELECT *, CASE kind WHEN 'N' THEN 300 + r % 100 WHEN 'INS' THEN 60 WHEN 'INS2' THEN 50 WHEN 'CTX' THEN 0 ELSE 800 + r % 40 END AS isz,
      base + r % 150 + CASE kind WHEN 'INS2' THEN 800 ELSE 0 END AS p1, CASE WHEN kind IN ('RR', 'RF') THEN 1 ELSE 0 END AS r1, CASE WHEN kind IN ('FF', 'RF') THEN 0 ELSE 1 END AS r2,
      CASE WHEN prio IN ('1-URGENT', '2-HIGH') THEN 'A' ELSE 'B' END AS lb FROM k),
g AS (SELECT *, CASE kind WHEN 'CTX' THEN (tid + 1) % 5 ELSE tid END AS t2, CASE kind WHEN 'CTX' THEN base + 1500 + r % 100 ELSE p1 + isz END AS p2 FROM f),
h AS (SELECT *, 1 AS m, tid AS t, p1 AS p, r1 AS a, t2 AS mt, p2 AS mp, r2 AS b FROM g UNION ALL SELECT *, 2, t2, p2, r2, tid, p1, r1 FROM g),
reads AS (SELECT lower(lb) || '.bam' AS bam_file, 'q' || fid AS qname, CAST(1 + CASE kind WHEN 'N' THEN 2 ELSE 0 END + 16 * a + 32 * b + CASE m WHEN 1 THEN 64 ELSE 128 END{extra} AS INTEGER) AS flag,
      CAST({tid} AS INTEGER) AS tid, CAST(p AS INTEGER) AS pos, CAST(20 + r % 41 AS INTEGER) AS mapq, CAST({am} AS INTEGER) AS am, {rg} AS rg, CAST(mt AS INTEGER) AS mtid, CAST(mp AS INTEGER) AS mpos,
      CAST(isz AS INTEGER) AS isize, CAST(50 + fid % 3 AS INTEGER) AS qlen, m AS mate FROM h)"""


#: Class of a pair and what admission needs; libraries A and B as in the queries.
ENRICHED = """
e0 AS (SELECT *, CASE WHEN rg = 'rgB' THEN 'libB' ELSE 'libA' END AS lib, coalesce(am, mapq) AS bdqual, CASE WHEN flag & 16 <> 0 THEN 1 ELSE 0 END AS rev FROM reads WHERE flag & 2304 = 0 AND tid >= 0),
e1 AS (SELECT *, CASE lib WHEN 'libA' THEN 450 ELSE 440 END AS upper_cut, CASE lib WHEN 'libA' THEN 200 ELSE 210 END AS lower_cut, CASE lib WHEN 'libA' THEN 35 ELSE 30 END AS need FROM e0),
enriched AS (SELECT *, CASE WHEN flag & 1024 <> 0 OR flag & 1 = 0 THEN 0 WHEN flag & 4 <> 0 THEN 10 WHEN flag & 8 <> 0 THEN 9 WHEN tid <> mtid THEN 8
      WHEN flag & 48 = 48 THEN 5 WHEN flag & 48 = 0 THEN 1 WHEN (pos < mpos) = (rev = 1) THEN 4 WHEN abs(isize) > upper_cut THEN 2 WHEN abs(isize) < lower_cut THEN 3 ELSE 6 END AS cls FROM e1)"""
PASS1 = ", pass1 AS (SELECT * FROM enriched WHERE bdqual > need)"
HIST = PASS1 + """, hist AS (SELECT lib, count(*) FILTER (flag & 1039 = 3) AS reads, """ + ", ".join(
    f"count(*) FILTER (cls = {k} AND cls NOT IN (0, 6, 7) AND flag & 12 = 0) AS n{k}" for k in range(11)
) + " FROM pass1 GROUP BY lib)"
COVERED = ", cov AS (SELECT max(s) AS covered FROM (SELECT bam_file, sum(w) AS s FROM (SELECT bam_file, tid, max(pos) - min(pos) AS w FROM enriched GROUP BY ALL) GROUP BY bam_file))"
ADMITTED = """, adm AS (SELECT * EXCLUDE (cls), CASE cls WHEN 5 THEN 1 ELSE cls END AS cls FROM enriched WHERE cls <> 0 AND flag & 12 = 0 AND bdqual > need AND (cls = 8 OR abs(isize) <= 1000000000)),
ano AS (SELECT * FROM adm WHERE cls NOT IN (6, 7))"""
ISLANDS = ADMITTED + """, brk AS (SELECT *, CASE WHEN lag(pos) OVER w IS NULL OR pos - lag(pos) OVER w > 250 THEN 1 ELSE 0 END AS br FROM ano WINDOW w AS (PARTITION BY tid ORDER BY pos, rev, qname, mate)),
isl AS (SELECT *, sum(br) OVER (ORDER BY tid, pos, rev, qname, mate ROWS UNBOUNDED PRECEDING) AS island, row_number() OVER (ORDER BY tid, pos, rev, qname, mate) AS ord FROM brk),
own AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY ord) AS k FROM isl),
cnt AS (SELECT qlen, CASE k WHEN 1 THEN island - 1 ELSE island END AS i FROM own),
ext AS (SELECT i, sum(qlen) AS nucleotides, max(qlen) AS max_len FROM cnt WHERE i > 0 GROUP BY i),
tab AS (SELECT tid, island, min(pos) AS s, max(pos) AS e, count(*) AS n, count(*) FILTER (rev = 0) AS fwd, count(*) FILTER (rev = 1) AS bwd FROM isl GROUP BY tid, island),
it AS (SELECT tab.*, coalesce(nucleotides, 0) AS nucleotides, coalesce(max_len, 0) AS max_len FROM tab LEFT JOIN ext ON i = island),
reg AS (SELECT *, row_number() OVER (ORDER BY island) - 1 AS region, CAST(nucleotides AS DOUBLE) / (e - s + 1 + max_len) AS coverage FROM it WHERE e - s > 7 AND CAST(nucleotides AS DOUBLE) / (e - s + 1 + max_len) < 1000)"""
PAIRS = ISLANDS + """, rr AS (SELECT isl.*, region FROM isl JOIN reg USING (island)), big AS (SELECT region FROM rr GROUP BY region HAVING count(*) >= 2),
two AS (SELECT rr.*, row_number() OVER (PARTITION BY qname ORDER BY tid, pos, rev, mate, region, cls, lib, bam_file, abs(isize), qlen, bdqual) AS k FROM rr JOIN big USING (region)),
pairs AS (SELECT x.qname, least(x.region, y.region) AS a, greatest(x.region, y.region) AS b, y.cls, y.lib, y.bam_file, abs(y.isize) AS size FROM two x JOIN two y ON x.qname = y.qname AND x.k = 1 AND y.k = 2),
edg AS (SELECT a, b, count(*) AS weight FROM pairs GROUP BY a, b)"""
#: The walk of each batch's edges: nodes by component, distance from its least node and least path of that length; an edge goes with its node that comes first.
WALK = PAIRS + """, sg AS (SELECT a, b, weight, b // 101 AS fl FROM edg WHERE weight >= 2),
nb AS (SELECT fl, a AS v, b AS w FROM sg UNION SELECT fl, b, a FROM sg),
rch AS (SELECT DISTINCT fl, v, v AS w FROM nb UNION SELECT rch.fl, rch.v, nb.w FROM rch JOIN nb ON nb.fl = rch.fl AND nb.v = rch.w),
rot AS (SELECT fl, v, min(w) AS root FROM rch GROUP BY fl, v),
stp AS (SELECT fl, v, 0 AS d FROM rot WHERE root = v UNION SELECT stp.fl, nb.w, d + 1 FROM stp JOIN nb ON nb.fl = stp.fl AND nb.v = stp.v WHERE d < 101),
dis AS (SELECT fl, v, min(d) AS d FROM stp GROUP BY fl, v),
pth AS (SELECT fl, v, 0 AS d, [v] AS path FROM rot WHERE root = v UNION ALL
  SELECT pth.fl, nb.w, any_value(pth.d) + 1, min(list_append(path, nb.w)) FROM pth JOIN nb ON nb.fl = pth.fl AND nb.v = pth.v JOIN dis ON dis.fl = nb.fl AND dis.v = nb.w AND dis.d = pth.d + 1 GROUP BY pth.fl, nb.w),
nod AS (SELECT pth.fl, pth.v, row_number() OVER (PARTITION BY pth.fl ORDER BY root, d, path) AS place FROM pth JOIN rot USING (fl, v)),
wlk AS (SELECT sg.fl AS flush, sg.a, sg.b, weight, row_number() OVER (PARTITION BY sg.fl ORDER BY least(x.place, y.place), CASE WHEN x.place <= y.place THEN sg.b ELSE sg.a END) - 1 AS rank
  FROM sg JOIN nod x ON x.fl = sg.fl AND x.v = sg.a JOIN nod y ON y.fl = sg.fl AND y.v = sg.b)"""
#: Pairs with the edge that consumes them: their own, or for a pair inside a region the first-visited one that touches it.
OWNED = WALK + """, fst AS (SELECT v, min(struct_pack(f := flush, r := rank, x := a, y := b)) AS e FROM (SELECT flush, rank, a, b, a AS v FROM wlk UNION SELECT flush, rank, a, b, b FROM wlk) GROUP BY v),
owned AS (SELECT pairs.*, flush, rank, pairs.a AS ea, pairs.b AS eb FROM pairs JOIN wlk ON wlk.a = pairs.a AND wlk.b = pairs.b AND pairs.a <> pairs.b
  UNION ALL SELECT pairs.*, e.f, e.r, e.x, e.y FROM pairs JOIN fst ON pairs.a = pairs.b AND v = pairs.a)"""
#: ln P(X > k) by a series over lgamma.
TAIL = "CASE WHEN k + 1 >= lam THEN -lam + (k + 1) * ln(lam) - lgamma(k + 2) + ln(1 + list_sum(list_transform(range(1, 200), lambda m: exp(m * ln(lam) + lgamma(k + 2) - lgamma(k + 2 + m))))) ELSE ln(1 - list_sum(list_transform(range(0, CAST(k + 1 AS BIGINT)), lambda j: exp(-lam + j * ln(lam) - lgamma(j + 1))))) END"
VOTES = OWNED + """, vote AS (SELECT ea AS a, eb AS b, cls, count(*) AS n FROM owned GROUP BY ea, eb, cls), ranked AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, cls) AS rk, sum(n) OVER (PARTITION BY a, b) AS total FROM vote),
win AS (SELECT a AS ea, b AS eb, cls AS flag, n AS flag_pairs, CAST(total AS BIGINT) AS pairs FROM ranked WHERE rk = 1 AND n >= 2),
sup AS (SELECT ea, eb, p.lib, p.bam_file, flag, count(*) AS n, sum(size) AS span FROM win JOIN owned p USING (ea, eb) WHERE p.cls = flag GROUP BY ALL)"""
PLACES = VOTES + """, pl AS (SELECT win.*, x.s AS s1, x.e AS e1, y.s AS s2, y.e AS e2, x.e - x.s + 1 + CASE WHEN ea = eb THEN 0 ELSE y.e - y.s + 1 END AS span_size FROM win JOIN reg x ON x.region = ea JOIN reg y ON y.region = eb),
bp AS (SELECT *, CASE WHEN ea = eb OR flag IN (4, 5) THEN s1 ELSE e1 END AS p1, CASE WHEN ea = eb THEN e1 WHEN flag IN (1, 4) THEN e2 + 46 ELSE s2 END AS p2 FROM pl)"""
BETWEEN = ADMITTED.replace(", adm", ", adm", 1)
