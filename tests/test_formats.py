"""Readers, writers, reads, signals, the command line and the stream."""

import gzip
import os
import struct
import zlib
from datetime import datetime

import pandas as pd
import pytest

from contactloom import commands, datasets, figures
from contactloom.operators import pets, profiles, reads, signals
from contactloom.sources import bigwig, formats, tracks
from contactloom.streaming import ingest


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    got = formats.read_bed(spark, put("a.bed", "#x\nc\t1\t9\tn\t0\t-\nc\tx\t9\nc\t2\t5\n")).collect()
    assert [(r.start, r.end, r.name, r.strand, r.region_id) for r in got] == [(1, 9, "n", "-", "c|1|9|n"), (2, 5, None, None, "c|2|5")]
    assert [tuple(r) for r in formats.read_bedgraph(spark, put("a.bdg", "c\t1\t9\t0.5\nc\t1\t2\tx\n")).collect()] == [("c", 1, 9, 0.5)]
    gtf = 'c\ts\texon\t{}\t{}\t.\t-\t.\tgene_id "G"; transcript_id "T"; gene_name "N";\n'
    genes = formats.read_gtf(spark, put("a.gtf", gtf.format(5, 9) + gtf.format(10, 20) + gtf.format(40, 50) + "c\ts\tgene\t1\t99\t.\t-\t.\tx\n")).collect()
    assert [(g.gene_id, g.gene_name, g.start, g.end, g.tss, len(g.exons)) for g in genes] == [("G", "N", 5, 50, 50, 3)]
    tid = formats.read_gtf(spark, str(tmp_path / "a.gtf"), transcripts=True).collect()
    assert [(g.gene_id, g.gene_name) for g in tid] == [("T", "N")]
    seen = formats.genes_in(formats.read_gtf(spark, str(tmp_path / "a.gtf")), "c", 0, 30).collect()
    assert [[(e.start, e.end) for e in g.exons] for g in seen] == [[(5, 20), (40, 50)]]
    loops = formats.read_loops(spark, put("l.txt", "loopId\ta\nl1\tc\t1.0\t5\tc\t10\t20\t12\nl2\tc\t1\t5\td\t10\t20\t-1\nbad\n")).collect()
    assert [(r.loop_id, r.chrom, r.start_a, r.cis) for r in loops] == [("l1", "c", 1, True)]
    doms = formats.read_domains(spark, put("d.txt", "domainId\tchr\nd\tc\t5\t25\n")).collect()
    assert [(r.domain_id, r.length, r.significant) for r in doms] == [("d", 20, None)]
    vp = formats.read_valid_pairs(spark, put("v.txt", "r\tc\t100\t+\tc\t300\t-\n"))
    assert [tuple(r)[:6] for r in formats.valid_pairs_to_bedpe(vp).collect()] == [("c", 100, 150, "c", 250, 300)]
    long = formats.read_juicer_long(spark, put("j.txt", "0 c 30 0 16 c 300 1 x\n"))
    assert [(r.start_a, r.end_b, r.strand_a, r.strand_b) for r in formats.juicer_long_to_bedpe(long).collect()] == [(0, 350, "+", "-")]
    with gzip.open(tmp_path / "g.bedpe.gz", "wt") as f:
        f.write("c\t100\t200\tc\t10\t20\tn\t.\t+\t-\n")
    assert formats.read_bedpe(spark, str(tmp_path / "g.bedpe.gz")).collect()[0].pos_a == 150


def _bigwig(path, blocks):
    """A small file: one chromosome, packed blocks of the three kinds."""
    data, places, at = b"", [], 64 + 32 + 4 + 4 + 8 + 8
    for kind, step, span, items in blocks:
        start = items[0][0]
        end = items[-1][0] + (items[-1][1] - items[-1][0] if kind == 1 else span)
        body = b"".join(struct.pack("<IIf", *i) if kind == 1 else struct.pack("<If", i[0], i[2]) if kind == 2 else struct.pack("<f", i[2]) for i in items)
        packed = zlib.compress(struct.pack("<IIIIIBBH", 0, start, end, step, span, kind, 0, len(items)) + body)
        places.append((start, end, at + 8 + len(data), len(packed)))
        data += packed
    tree = struct.pack("<IIIIQQ", bigwig.TREE, 1, 4, 8, 1, 0) + struct.pack("<BBH", 1, 0, 1) + b"chr1" + struct.pack("<II", 0, 10_000)
    index_at = 64 + len(tree) + 8 + len(data)
    index = struct.pack("<IIQIIIIQII", bigwig.INDEX, 256, len(places), 0, 0, 0, 10_000, 0, 512, 0) + struct.pack("<BBH", 1, 0, len(places))
    index += b"".join(struct.pack("<IIIIQQ", 0, s, 0, e, 64 + len(tree) + 8 + (o - at - 8), n) for s, e, o, n in places)
    head = struct.pack("<IHHQQQHHQQIQ", bigwig.FILE, 4, 0, 64, 64 + len(tree), index_at, 0, 0, 0, 0, 4096, 0)
    with open(path, "wb") as f:
        f.write(head + tree + struct.pack("<Q", len(places)) + data + index)


def test_bigwig(spark, tmp_path):
    _bigwig(tmp_path / "a.bw", [(1, 0, 0, [(10, 20, 1.5), (25, 30, 2.0)]), (2, 0, 5, [(40, 45, 3.0), (60, 65, 4.0)]), (3, 10, 5, [(100, 0, 5.0), (110, 0, 6.0)])])
    got = sorted(tuple(r) for r in bigwig.read_bigwig(spark, str(tmp_path / "a.bw")).collect())
    assert got == [("chr1", 10, 20, 1.5), ("chr1", 25, 30, 2.0), ("chr1", 40, 45, 3.0), ("chr1", 60, 65, 4.0), ("chr1", 100, 105, 5.0), ("chr1", 110, 115, 6.0)]
    with pytest.raises(ValueError):
        (tmp_path / "b.bw").write_bytes(b"0" * 100)
        bigwig.head(str(tmp_path / "b.bw"))


def test_signal_profile_with_spans_over_both_ends(spark):
    s = spark.createDataFrame([("c", 0, 15, 2.0), ("c", 15, 18, 4.0), ("c", 30, 100, 1.0)], "chrom string, start long, end long, value double")
    r = spark.createDataFrame([("r", "c", 10, 40)], "region_id string, chrom string, start long, end long")
    got = {x.bin: x.value for x in profiles.signal_profiles(s, r, 3).collect()}
    assert got == {0: (5 * 2 + 3 * 4) / 10, 2: 1.0}


def test_reads(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1 x\nACGTACGTTTCATTTTTTTTTTTTTTT\n+\n" + "@" * 27 + "\n@r2\nAAAA\n+\nFFFF\n")
    rows = reads.read_fastq(spark, str(tmp_path / "a.fastq")).collect()
    assert sorted((r.name, len(r.seq), r.qual) for r in rows) == [("r1 x", 27, "@" * 27), ("r2", 4, "FFFF")]
    pair = spark.createDataFrame([("n", "A" * 12 + reads.LINKER + "GG", "F" * 33, "C" * 9 + reads.LINKER, "F" * 28), ("m", "G" * 20, "F" * 20, "T" * 20, "F" * 20)], "name string, seq_a string, qual_a string, seq_b string, qual_b string")
    assert [(r.name, r.seq_a, len(r.qual_b)) for r in reads.cut_linkers(pair).collect()] == [("1_-1_-1", "G" * 20, 20)]
    assert [r.name for r in reads.cut_linkers(pair, least=9).orderBy("name").collect()] == ["1_-1_-1", "2_12_9"]
    bait = spark.createDataFrame([("a", "ACGTAAGATCC" + "T" * 13, "F" * 24), ("b", "TTTTAAGATCC" + "T" * 13, "F" * 24), ("c", "ACGTAAGATCCTT", "F" * 13)], "name string, seq string, qual string")
    # one base after the site goes with it; one of four bases of b fits the bait
    assert [(r.name, r.seq, len(r.qual)) for r in reads.baited(bait, "ACGT", "GATC").collect()] == [("a", "T" * 13, 13)]


def test_lines(spark, tmp_path):
    loops = spark.createDataFrame([("l", "chr1", 1, 5, 10, 20, 7, 0.5, 1), ("t", "chr1-chr2", 1, 5, 10, 20, 3, 0.5, 0)], "loop_id string, chrom string, start_a long, end_a long, start_b long, end_b long, rab long, density double, significant int")
    assert [tuple(r) for r in tracks.loop_link_lines(loops).collect()] == [("chr1:1-5", "chr1:10-20", "1")]
    assert {r.partner for r in tracks.loop_mirror_lines(loops, False).collect()} == {"chr1:10-20,7", "chr1:1-5,7", "chr2:10-20,3", "chr1:1-5,3"}
    assert tracks.loop_interact_lines(loops).columns[:3] == ["#chrom", "chromStart", "chromEnd"]
    tracks.write_text(loops.select("loop_id", "chrom", "start_a"), str(tmp_path / "out"), header=True)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert "loop_id\tchrom\tstart_a" in text and "l\tchr1\t1" in text
    rows = spark.range(1000).selectExpr("id % 7 AS a", "id AS b")
    got = [r.i for r in tracks.numbered(rows, "a", "b").orderBy("a", "b").collect()]
    assert got == list(range(1000))


def test_noise_regions_and_mixture(spark):
    a = spark.createDataFrame([("c", 1000, 1009), ("c", 3000, 3009)], "chrom string, start long, end long")
    b = spark.createDataFrame([("c", 1005, 1020), ("c", 8000, 8001)], "chrom string, start long, end long")
    assert sorted(tuple(r) for r in signals.shared_regions(a, b).collect()) == [("c", 1005, 1009)]
    got = sorted((r.start, r.end) for r in signals.shifted_regions(a, b, 10).collect())
    # the first region would begin below the extent, so neither of its copies shows
    assert got == [(2910, 2919), (3090, 3099), (7990, 7991)]
    m = signals.Mixture((5.0, 0.0), (1.0, 1.0), (0.5, 0.5))
    row = spark.createDataFrame([(64.0,), (1.0,)], "v double")
    assert [r[0] for r in row.select(m.is_signal(row.v)).collect()] == [True, False]


def test_ingest_stream(spark, tmp_path):
    schema = "chrom_a string, pos_a long, chrom_b string, pos_b long, mapq int, strand_a string, strand_b string, library string, ts timestamp"
    row = ("c", 50, "c", 10, 30, "+", "-", "l", datetime(2024, 1, 1))
    spark.createDataFrame([row, row, (*row[:4], 5, *row[5:]), ("c", 90, *row[2:])], schema).write.parquet(str(tmp_path / "in"))
    stream = ingest.unique_pairs(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", mapq=10)
    query = stream.writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.x, r.y) for r in spark.table("pairs").collect()) == [(10, 50), (10, 90)]


def test_figures(tmp_path):
    figures.heatmap([[1, 0], [0, 2]]).save(str(tmp_path / "a.svg"))
    assert (tmp_path / "a.svg").read_text().count("<rect") == 3
    c = figures.montage(pd.DataFrame({"name": ["a", "b"], "start": [0, 100], "end": [10, 120]}), pd.DataFrame({"id_a": ["a"], "id_b": ["b"], "per_million": [2.0]}))
    assert c.angle("b", 0) > c.angle("a", 0) and sum("<path" in p for p in c.parts) == 5
    assert figures.upper_triangle([[1, 2], [2, 3]])[0, 1] == 2
    assert commands.numbers("5,1") == (1, 5) and commands.numbers("5,1", True) == (5, 1) and commands.numbers("5,1", keep=True) == (5, 1)
    assert commands.limits("1,2;;3,4") == [(1.0, 2.0), None, (3.0, 4.0)] and not commands.has_tool("no-such-tool")


def test_commands(spark, tmp_path):
    lines = ["c\t{0}\t{1}\tc\t{2}\t{3}\tn\t30\t+\t-".format(*p) for p in [(1000 + 7 * i, 1050 + 7 * i, 9000 + 5 * i, 9050 + 5 * i) for i in range(40)] + [(20_000, 20_010, 30_000, 30_010)] * 3]
    (tmp_path / "a.bedpe").write_text("\n".join(lines) + "\nc\t1\t2\td\t3\t4\tn\t30\t+\t-\n")
    data, out = str(tmp_path / "lib"), str(tmp_path / "o")

    def run(*words):
        commands.main(list(words), spark)

    def text(name):
        return [line.split("\t") for p in sorted((tmp_path / name).glob("part*")) for line in p.read_text().splitlines()]

    run("qc", "-f", str(tmp_path / "a.bedpe"), "-o", out)
    assert len(text("o_bedpeQc")) == 2
    run("pre", "-f", str(tmp_path / "a.bedpe"), "-o", data)
    assert datasets.total(spark, data) == 41 and datasets.pairs(spark, data).where("dist IS NULL").count() == 0
    run("pre", "-f", str(tmp_path / "a.bedpe"), "-o", f"{data}2", "-trans")
    assert datasets.pairs(spark, f"{data}2").count() == 42
    run("combine", "-ds", f"{data},{data}2", "-keep", "2", "-o", f"{data}3")
    assert datasets.pairs(spark, f"{data}3").count() == 83 and datasets.pairs(spark, f"{data}3").where("chrom_b = 'd' AND dist IS NULL").count() == 1
    run("filterPETs", "-d", data, "-singleton", "-bs", "500", "-o", f"{data}4")
    assert 0 < datasets.pairs(spark, f"{data}4").count() < 41
    run("samplePETs", "-d", data, "-tot", "20", "-o", f"{data}5")
    run("dump", "-d", data, "-bed", "-bdg", "-mat", "-mat_chrom", "c-c", "-mat_res", "1000", "-o", out)
    assert len(text("o_reads.bed")) == 82 and os.path.exists(f"{out}_cmat.txt")
    run("estRes", "-d", data, "-bs", "1000,5000", "-o", out)
    (tmp_path / "loops.txt").write_text("loopId\tx\nl\tc\t1000\t1300\tc\t9000\t9300\t8000\n")
    (tmp_path / "r.bed").write_text("c\t1000\t1300\tone\nc\t9000\t9300\ttwo\n")
    run("quant", "-d", data, "-loops", str(tmp_path / "loops.txt"), "-peaks", str(tmp_path / "r.bed"), "-o", out)
    assert text("o_loops")[0][0] == "loopId" and text("o_loops")[1][13] == "40"
    run("montage", "-d", data, "-bed", str(tmp_path / "r.bed"), "-o", out)
    assert text("o_counts")[1] == ["one", "two", "40"]
    run("agg", "-d", data, "-loops", str(tmp_path / "loops.txt"), "-1D", "-o", out)
    run("plot", "-d", data, "-chrom", "c", "-bs", "1000", "-log", "-1D", "-loops", str(tmp_path / "loops.txt"), "-o", out)
    assert "<svg" in open(f"{out}_plot.svg").read()
    with pytest.raises(ValueError):
        run("callLoops", "-d", data, "-eps", "0", "-minPts", "5", "-o", out)
    with pytest.raises(ValueError):
        run("filterPETs", "-d", data, "-o", f"{data}6")
    with pytest.raises(FileNotFoundError):
        commands.run_tool("no-such-tool")


def test_sampling_up_and_down(spark):
    p = pets.unique(pets.canonical(spark.range(2000).selectExpr("'c' AS chrom_a", "id AS pos_a", "'c' AS chrom_b", "id * 3 AS pos_b", "'+' AS strand_a", "'-' AS strand_b")))
    assert abs(pets.sample_to(p, 500).count() - 500) < 80 and abs(pets.sample_to(p, 5000).count() - 5000) < 100
    assert pets.sample_to(p, 500).exceptAll(pets.sample_to(p, 500)).count() == 0 and pets.sample_to(p, 0).count() == 0
