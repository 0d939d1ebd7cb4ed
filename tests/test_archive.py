"""Runs restored from an XML archive."""

import pytest

from svloom.options import Options
from svloom.plans import queries as q
from svloom.plans.pipeline import Analysis
from svloom.sources import archive
from svloom.sources.reads import reads_from_orders

SF = "/root/testdata/sf0.001"


def items(rows, tag="item"):
    return f"<count>{len(rows)}</count><item_version>0</item_version>" + "".join(f"<{tag}>{r}</{tag}>" for r in rows)


def xml(a: Analysis, opts: Options) -> str:
    given = {n: getattr(opts, own) for n, (own, _) in archive.OPTIONS.items()}
    text = "".join(f"<{n}>{'' if v is None else int(v) if isinstance(v, (bool, int)) else v}</{n}>" for n, v in given.items())
    libs = [f"<index>{i}</index><name>{x.name}</name><bam_file_index>{i}</bam_file_index><bam_file>{x.bam_file}</bam_file><mean_insertsize>{x.mean:.17e}</mean_insertsize><std_insertsize>{x.std:.17e}</std_insertsize><uppercutoff>{x.upper}</uppercutoff><lowercutoff>{x.lower}</lowercutoff><readlens>{x.readlen}</readlens><min_mapping_quality>{x.min_mapq}</min_mapping_quality>" for i, x in enumerate(a.libs)]
    pairs = lambda d: items([f"<first>{k}</first><second>{v}</second>" for k, v in d.items()])
    hist = {r["lib"]: r for r in a.hist.collect()}
    counts = [f"<readCount>{hist[x.name]['reads']}</readCount><readCountsByFlag>{items([hist[x.name][f'n{k}'] for k in range(11)])}</readCountsByFlag>" for x in a.libs]
    summary = f"<coveredReferenceLength>{a.covered.first()[0]}</coveredReferenceLength><readCountPerBam class_id='9'>{pairs({r['bam_file']: r['reads'] for r in a.files.collect()})}</readCountPerBam><libraryFlagDistributions>{items(counts)}</libraryFlagDistributions><librarySequenceCoverages>{items([0.5, 0.25])}</librarySequenceCoverages>"
    config = f"<bamLibrary>{pairs({})}</bamLibrary><libraryConfig>{items(libs)}</libraryConfig><readgroupToLibrary>{pairs(a.rg_lib)}</readgroupToLibrary><maxReadWindowSize>250</maxReadWindowSize>"
    return f"<?xml version='1.0' encoding='UTF-8' standalone='yes' ?>\n<!DOCTYPE boost_serialization>\n<boost_serialization signature='serialization::archive' version='10'>\n<options class_id='0' tracking_level='0' version='0'>{text}</options>\n<bamConfig class_id='3'>{config}</bamConfig>\n<bamSummaries class_id='7'>{summary}</bamSummaries>\n</boost_serialization>\n"


def test_a_restored_run_skips_the_counting_pass(spark, tmp_path):
    opts = Options(fisher=True, per_library=True, buffer=7, score_threshold=0, contig=None, bed_file="x.bed")
    reads = reads_from_orders(spark, SF, True)
    a = Analysis(reads, q.LIBS, q.RG_LIB, opts)
    (tmp_path / "run.xml").write_text(xml(a, opts))
    saved = archive.load(spark, str(tmp_path / "run.xml"))
    assert (saved.opts, saved.libs, saved.rg_lib) == (opts, q.LIBS, q.RG_LIB)
    b = Analysis.restored(reads, saved)
    assert b.hist is saved.hist and b.covered is saved.covered and b.window_row.first() == a.window_row.first()
    assert sorted(map(repr, b.calls.collect())) == sorted(map(repr, a.calls.collect()))
    assert "orders" not in b.hist._jdf.queryExecution().toString() + b.density._jdf.queryExecution().toString()


def test_broken_archives(spark, tmp_path):
    opts = Options()
    whole = xml(Analysis(reads_from_orders(spark, SF), q.LIBS, q.RG_LIB, opts), opts)
    for broken, message in ((whole.replace("boost_serialization", "other"), "not an archive"), (whole.replace("bamSummaries", "none"), "not an archive"), (whole.replace("<min_len>7</min_len>", ""), "no option min_len"), (whole.replace("<item>0</item>", "", 1), "do not fit"), (whole.replace("libraryConfig>", "l>"), "no libraries")):
        (tmp_path / "b.xml").write_text(broken)
        with pytest.raises(ValueError, match=message):
            archive.load(spark, str(tmp_path / "b.xml"))
