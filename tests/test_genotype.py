import random
from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom import cli
from varloom.operators import annotate, cluster, haplotypes, intervals, pathsearch, pileup, variants
from varloom.operators.haplotypes import Haplotype
from varloom.params import GenotypeParams, PileupParams
from varloom.plans import genotype, table_queries
from varloom.sources import text

P = GenotypeParams(neighdist=100, sizemin=10)


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A contig with an insertion (het), a deletion (hom), an absent insertion and skipped records."""
    rng = random.Random(11)
    d = tmp_path_factory.mktemp("gt")
    ref = bases(rng, 6000)
    ins, absent = bases(rng, 60), bases(rng, 80)
    (d / "ref.fa").write_text(">chr1 test\n" + "\n".join(ref[i : i + 70] for i in range(0, len(ref), 70)) + "\n>chr2\nACGT\n")
    (d / "ref.fa.fai").write_text("chr1\t6000\t0\t70\t71\nchr2\t4\t0\t70\t71\n")
    rows = [
        f"chr1\t1500\tv1\t{ref[1499]}\t{ref[1499]}{ins}\t.\tPASS\t.", f"chr1\t3001\tv2\t{ref[3000:3101]}\t{ref[3000]}\t.\t.\t.",
        f"chr1\t4500\tv3\t{ref[4499]}\t{ref[4499]}{absent}\t50\tq10;x\tA=1", f"chr1\t4600\tv4\t{ref[4599]}\t<INS>\t.\tPASS\t.",
        "chr1\t4700\tv5\tA\tC\t.\tPASS\t.", "not a record",
    ]
    head = ["##fileformat=VCFv4.2", "##contig=<ID=chr1,length=6000>", "##contig=<ID=chr2,length=4>", '##FORMAT=<ID=XX,Number=1,Type=String,Description="x">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    (d / "in.vcf").write_text("\n".join(head + rows) + "\n")
    sam = ["@HD\tVN:1.6"]
    for i in range(20):
        has = i % 2 == 0
        seq, cigar = ref[:1500], "1500M"
        if has:
            seq, cigar = seq + ins, cigar + "60I"
        seq += ref[1500:3001] + ref[3101:]
        cigar += "1501M100D2899M"
        sam.append(f"r{i}\t0\tchr1\t1\t60\t{cigar}\t*\t0\t0\t{seq}\t*\tPS:i:7\tHP:i:{1 if has else 2}")
    sam.append(f"low\t0\tchr1\t1\t1\t6000M\t*\t0\t0\t{ref}\t*")
    sam.append(f"dup\t1024\tchr1\t1\t60\t6000M\t*\t0\t0\t{ref}\t*")
    (d / "reads.sam").write_text("\n".join(sam) + "\n")
    return d


def parse(folder):
    lines = folder.read_text().splitlines() if folder.is_file() else [x for f in sorted(folder.iterdir()) if f.suffix in (".vcf", ".txt") for x in f.read_text().splitlines()]
    assert "#" not in "".join(x[0] for x in lines).lstrip("#")  # the header comes first
    return {x.split("\t")[2]: dict(zip(x.split("\t")[8].split(":"), x.split("\t")[9].split(":"), strict=True)) for x in lines if not x.startswith("#")}, [x for x in lines if x.startswith("#")]


def test_command_line_end_to_end(spark, files, caplog):
    caplog.set_level("INFO", "varloom")
    base = ["--neighdist", "100", "--sizemin", "10"]
    cli.run(["gt", "--input", f"{files}/in.vcf", "--reads", f"{files}/reads.sam", "--reference", f"{files}/ref.fa", "--out", f"{files}/out", "--sample", "S", *base], spark)
    got, head = parse(files / "out")
    assert len(got) == 5
    assert {k: got[k]["GT"] for k in got} == {"v1": "0|1", "v2": "1|1", "v3": "0|0", "v4": "./.", "v5": "./."}
    assert (got["v1"]["AD"], got["v1"]["DP"], got["v1"]["PS"], got["v1"]["NE"]) == ("10,10", "20", "7", "1499")
    assert got["v2"]["AD"] == "0,20" and got["v3"]["AD"] == "20,0" and got["v3"]["KS"] == "."
    assert (got["v4"]["NE"], got["v4"]["DP"], got["v4"]["AD"]) == ("0", "0", ".")
    assert head[-1].endswith("FORMAT\tS") or any(h.endswith("FORMAT\tS") for h in head)
    assert not any("ID=XX" in h for h in head) and sum(h.startswith("##FORMAT") for h in head) == 9
    # the same from a pileup index
    cli.run(["plup", "--reads", f"{files}/reads.sam", "--out", f"{files}/x.plup", "--sizemin", "10"], spark)
    cli.run(["gt", "--input", f"{files}/in.vcf", "--reads", f"{files}/x.plup", "--reference", f"{files}/ref.fa", "--out", f"{files}/out2", "--sample", "S", *base], spark)
    assert parse(files / "out2")[0] == got
    assert "records 5, skipped 2, neighborhoods 3, Ref 1, Het 1, Hom 1, Non 2" in caplog.text
    # from an index by place, into one file
    cli.run(["plup", "--reads", f"{files}/reads.sam", "--out", f"{files}/x.plup.parquet", "--sizemin", "10"], spark)
    cli.run(["gt", "--input", f"{files}/in.vcf", "--reads", f"{files}/x.plup.parquet", "--reference", f"{files}/ref.fa", "--out", f"{files}/out3.vcf", "--sample", "S", *base], spark)
    assert parse(files / "out3.vcf") == parse(files / "out") and not (files / "out3.vcf.parts").exists()
    with pytest.raises(FileNotFoundError, match="none.fa"):
        cli.run(["gt", "--input", f"{files}/in.vcf", "--reads", f"{files}/x.plup", "--reference", f"{files}/none.fa", "--out", f"{files}/out4"], spark)


def test_regions_ploidy_and_modes(spark, files):
    records, contigs = text.read_vcf(spark, f"{files}/in.vcf"), text.read_contigs(spark, f"{files}/ref.fa.fai")
    reads = text.read_reads(spark, f"{files}/reads.sam", P)
    fasta = text.read_fasta(spark, f"{files}/ref.fa", 512)
    (files / "p.bed").write_text("chr1\t1000\t2000\t1\nchr1\t3000\t3500\t0\n")
    (files / "r.bed").write_text("chr1\t0\t4000\nchr9\t0\t10\n")
    regions = intervals.bed_regions(contigs, text.read_bed(spark, f"{files}/r.bed"))
    for p in (P, GenotypeParams(neighdist=100, sizemin=10, one_to_one=True)):
        done = genotype.genotype(records, reads, regions, p, text.read_ploidy(spark, f"{files}/p.bed"), fasta, 512)
        got = {r.id: (r.gt, r.dp) for r in done.collect()}
        assert got == {"v1": ("1", 20), "v2": ("./.", 0), "v3": ("./.", 0), "v4": ("./.", 0), "v5": ("./.", 0)}


def test_bad_inputs(spark, files):
    (files / "bad.bed").write_text("chr1\t5\t5\n")
    with pytest.raises(Exception, match="bad BED line"):
        text.read_bed(spark, f"{files}/bad.bed").collect()
    (files / "nop.bed").write_text("chr1\t5\t9\n")
    with pytest.raises(Exception, match="no ploidy"):
        text.read_ploidy(spark, f"{files}/nop.bed").collect()
    multi = spark.createDataFrame([("c", 1, "A", "C,G")], "chrom string, pos long, ref string, alt string")
    with pytest.raises(Exception, match="multi-allelic"):
        variants.derive(multi).collect()
    with pytest.raises(ValueError, match="sizemin"):
        GenotypeParams(kmer=5, sizemin=3).validate()
    with pytest.raises(ValueError, match="unsupported"):
        text.read_reads(spark, "x.doc", P)
    assert GenotypeParams().index_mismatches({"sizemin": 20, "mapq": 5}) == ["sizemin"]


def test_variant_columns(spark):
    df = spark.createDataFrame([("A", "ACC"), ("ACC", "A"), ("A", "C"), ("AC", "GT"), ("A", ""), ("A", "*"), ("A", "<DEL>"), ("A", "c:1")], "ref string, alt string")
    got = df.select(variants.record_size(F.col("ref"), F.col("alt")).alias("s"), variants.valid_alt(variants.single_alt(F.col("alt"))).alias("v")).collect()
    assert [r.s for r in got][:4] == [2, 2, 0, 2] and [r.v for r in got] == [True] * 4 + [False] * 4
    names = spark.createDataFrame([("INS",), ("del",), ("SNP",), ("bnd",), (None,)], "t string")
    assert [r[0] for r in names.select(variants.variant_type(F.col("t"))).collect()] == ["Ins", "Del", "Snp", "Unk", "Unk"]
    f = spark.createDataFrame([([],), (["PASS"],), (["q10"],), (["q10", "PASS"],)], "f array<string>")
    assert [r[0] for r in f.select(variants.is_pass(F.col("f"))).collect()] == [True, True, False, True]


def test_cigar_walk_and_index_round_trip(spark):
    rows = [("c", 100, "5S10M20I5=3D2X30D4N1M2H", "A" * 5 + "C" * 10 + "G" * 20 + "T" * 40, 9, 0, None, None, 0), ("c", 50, "20I10M", "G" * 20 + "C" * 10, 9, 0, "7", "3", 1), ("c", 60, "9M", "C" * 9, 9, 0, "x", "2", 2), ("c", 60, "9M", "C", 1, 0, None, None, 3), ("c", 60, "9M", "C", 9, 256, None, None, 4), ("c", 60, "9M", "", 9, 0, None, None, 5)]
    reads = spark.createDataFrame(rows, "chrom string, start long, cigar string, seq string, mapq int, flags int, ps string, hp string, read_ord long")
    p = PileupParams(sizemin=20)
    got = {r.read_ord: r for r in pileup.reads_to_pileups(reads, p).collect()}
    assert sorted(got) == [0, 1, 2]
    assert [(v.position, v.end, v.indel, v.size, v.sequence) for v in got[0].pileups] == [(109, 110, "Ins", 20, "G" * 20), (119, 149, "Del", -30, None)]
    assert got[0].end == 100 + 10 + 5 + 3 + 2 + 30 + 4 + 1
    assert (got[1].ps, got[1].hp) == (7, None) and (got[2].ps, got[2].hp, got[2].pileups) == (None, 2, [])
    lines = pileup.encode_reads(pileup.reads_to_pileups(reads, p)).select(F.col("line").alias("value")).withColumn("read_ord", F.monotonically_increasing_id())
    text_ = sorted(r.value for r in lines.collect())
    assert text_[0] == "c\t100\t155\t9:" + "G" * 20 + ",19:30\t.\t."
    back = {r.start: r for r in pileup.decode_reads(lines, 20, 100).collect()}
    assert back[100].pileups == got[0].pileups and back[60].pileups == []
    assert back[50].pileups == []  # an offset left of the read is written as -1 and dropped when read
    bad = spark.createDataFrame([("# {}", 0), ("c\tx\t5\t.\t.\t.", 1), ("c\t1\t5", 2), ("c\t1\t50\t3:x7,4:30,q,5:5\t1\t9", 3)], "value string, read_ord long")
    (one,) = pileup.decode_reads(bad, 20, 100).collect()
    assert [(v.position, v.size) for v in one.pileups] == [(5, -30)] and (one.ps, one.hp) == (1, None)


def hap(size, feature, coverage=1, parts=1, **kw):
    f = np.array(feature, np.float32)
    return Haplotype(size, parts, coverage, f, [(size, f)], **kw)


def test_two_medoids_is_the_best_pair():
    rng = np.random.default_rng(4)
    for n in (2, 3, 5, 9):
        d = rng.random((n, n)).astype(np.float32)
        d = (d + d.T) / 2
        np.fill_diagonal(d, 0)
        losses = {(i, j): np.minimum(d[:, i], d[:, j]).sum() for i in range(n) for j in range(i + 1, n)}
        pair, side, loss = cluster.two_medoids(d)
        assert loss == pytest.approx(min(losses.values()), rel=1e-5)
        assert all((d[k, pair[s]] <= d[k, pair[1 - s]]) for k, s in enumerate(side))


def test_diploid_and_haploid():
    a, b = [9, 0, 0, 0], [0, 0, 0, 9]
    haps = [hap(60, a, ps=3, hp=1) for _ in range(6)] + [hap(-80, b, ps=3, hp=2) for _ in range(7)]
    got = cluster.diploid(haps, 13, P)
    assert [(h.size, h.coverage, h.hp) for h in got] == [(60, 6, 1), (-80, 7, 2)]
    assert [(h.size, h.coverage) for h in cluster.diploid([hap(60, a) for _ in range(5)], 10, P)] == [(60, 5)]
    assert cluster.diploid([], 5, P) == [] and cluster.diploid(haps, 0, P) == []
    noisy = GenotypeParams(ab=0.3)
    few = [hap(60, a)] * 1 + [hap(-80, b) for _ in range(12)]
    assert [(h.size, h.coverage) for h in cluster.diploid(few, 13, noisy)] == [(-80, 12)]
    (one,) = cluster.haploid([hap(60, a), hap(60, a, ps=5), hap(-80, b)])
    assert (one.size, one.coverage, one.ps) == (60, 3, 5)
    assert cluster.majority_tag([1, 2]) == 1 and cluster.majority_tag([None, 2]) == 2 and cluster.majority_tag([None]) is None


def test_forms_of_a_haplotype():
    parts = [(10, np.ones(4, np.float32)), (20, np.ones(4, np.float32) * 2), (30, np.ones(4, np.float32) * 3)]
    h = Haplotype(60, 3, 5, np.ones(4, np.float32) * 6, parts)

    def forms(**kw):
        f = pathsearch.Forms(h, GenotypeParams(**kw))
        return sorted(zip(f.size.tolist(), f.n.tolist(), f.missing.tolist(), f.features(np.arange(len(f.size)))[:, 0].tolist(), strict=True))

    assert forms() == sorted([(60, 3, 0, 6.0), (30, 2, 1, 3.0), (40, 2, 1, 4.0), (50, 2, 1, 5.0), (10, 1, 2, 1.0), (20, 1, 2, 2.0), (30, 1, 2, 3.0)])
    assert forms(pileupmax=3) == [(60, 3, 0, 6.0)] and [f[1] for f in forms(fnmax=1)] == [2, 2, 2, 3]


def plain_score(variants, path, h, p):
    """The score of one path, form by form, from the definition."""
    best, m = 0.0, len(h.parts)
    size, feature = sum(variants[i - 1][2] for i in path), np.sum([variants[i - 1][3] for i in path], axis=0) if path else np.zeros(4)
    for left in range(0, min(p.fnmax, m - 1) + 1 if m < p.pileupmax else 1):
        for some in combinations(h.parts, m - left):
            s, f = sum(x for x, _ in some), np.sum([k for _, k in some], axis=0)
            if (s > 0) - (s < 0) != (size > 0) - (size < 0):
                continue
            ratio = 1 if abs(s) == abs(size) else max(min(abs(s), abs(size)), 1) / max(abs(s), abs(size), 1)
            use = np.abs(f) + np.abs(feature) >= p.minkfreq
            total = (np.abs(f) + np.abs(feature))[use].sum()
            alike = 1 - np.abs(f - feature)[use].sum() / total if total else 0
            if ratio >= p.sizesim and alike >= p.seqsim:
                best = max(best, (ratio + alike) / 2 - p.fpenalty * left - p.gpenalty * (len(path) - 1 if p.squish else abs(m - left - len(path))))
    return best


def test_path_search_against_all_paths():
    rng = np.random.default_rng(9)
    found = 0
    for trial in range(60):
        p = GenotypeParams(kmer=1, sizesim=0.1, seqsim=0.1, minkfreq=1, squish=trial % 3 == 0, fnmax=trial % 4, one_to_one=trial % 5 == 0)
        variants = sorted((s, s + int(rng.integers(1, 30)), int(rng.integers(-60, 60)), rng.integers(-9, 9, 4).astype(np.float32)) for s in rng.integers(0, 100, int(rng.integers(1, 6))).tolist())
        parts = [(int(rng.integers(-60, 60)), rng.integers(-9, 9, 4).astype(np.float32)) for _ in range(int(rng.integers(1, 4)))]
        h = Haplotype(sum(s for s, _ in parts), len(parts), 3, np.sum([k for _, k in parts], axis=0), parts, 5, 1)
        paths = [(i + 1,) for i in range(len(variants))]
        whole = h if not p.one_to_one else Haplotype(h.size, h.n, 3, h.kfeat, [(h.size, h.kfeat)])
        if not p.one_to_one:
            apart = lambda path: all(max(variants[i - 1][0], variants[j - 1][0]) >= min(variants[i - 1][1], variants[j - 1][1]) for i, j in zip(path[:-1], path[1:], strict=True))
            paths = [c for k in range(len(variants) + 1) for c in combinations(range(1, len(variants) + 1), k) if apart(c)]
        scores = {c: plain_score(variants, c, whole, p) if not p.one_to_one else plain_score(variants, c, whole, GenotypeParams(**{**p.__dict__, "gpenalty": 0.0})) - p.gpenalty * (0 if p.squish else abs(h.n - 1)) for c in paths}
        got = pathsearch.paths_of(pathsearch.Graph(*map(list, zip(*variants, strict=True))), [h], p)
        want = max(scores.values())
        if got:
            found += 1
            assert got[0]["score"] == pytest.approx(want, abs=1e-5) and scores[tuple(got[0]["path"])] == pytest.approx(want, abs=1e-5)
            assert (got[0]["coverage"], got[0]["ps"], got[0]["hp"]) == (3, 5, 1)
        else:
            assert want <= 0
    assert found > 20


def test_search_stops_and_later_paths_win_ties():
    one = np.ones(4, np.float32)
    graph = pathsearch.Graph([0, 5, 9], [1, 6, 10], [50, 50, 50], [one, one, one])
    h = Haplotype(50, 1, 2, one, [(50, one)])
    p = GenotypeParams(kmer=1)
    assert pathsearch.paths_of(graph, [h], p)[0]["path"] == [3]
    assert pathsearch.nearest_paths(graph, graph.after(), 50, 2) == [(), (1,)]
    few = GenotypeParams(kmer=1, maxpaths=2)
    assert pathsearch.paths_of(graph, [h], few)[0]["path"] == [2]
    tags = [Haplotype(50, 1, 2, one, [(50, one)], None, t) for t in (1, None, 2)]
    assert [f["hp"] for f in pathsearch.paths_of(graph, tags, p)] == [2, None, 1]


def test_swapped_medoids_agree_with_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(10):
        centre = rng.integers(0, 30, (2, 16))
        points = np.concatenate([rng.poisson(centre[k], (int(rng.integers(5, 40)), 16)) for k in (0, 1)]).astype(np.float32)
        d = cluster.distances(points, 1)
        np.fill_diagonal(d, 0)
        w = rng.integers(1, 4, len(points))
        exact, swapped = cluster.two_medoids(d, w), cluster.two_medoids(d, w, exact=0)
        assert exact[0] == swapped[0] and exact[2] == pytest.approx(swapped[2])


def test_medoids_of_many_rows_are_the_best_pair(spark, monkeypatch):
    """Above 256 rows as below; in one matrix, and in stripes of seven rows with repeated features."""
    rng = np.random.default_rng(11)
    for _ in range(4):
        points = rng.integers(-4, 5, (300, 6)).astype(np.float32)
        d, w = cluster.distances(points, 2), rng.integers(1, 4, 300)
        want = min((float(x.min()), i, i + 1 + int(x.argmin())) for i in range(299) for x in [w @ np.minimum(d[:, i : i + 1], d[:, i + 1 :]).astype(np.float64)])
        for first in (0, 5, 64):
            pair, _, loss = cluster.two_medoids(d, w, first)
            assert pair == want[1:] and loss == pytest.approx(want[0])
    monkeypatch.setattr(cluster, "_HELD", 7 * 300)
    order = [k for k, n in enumerate(w.tolist()) for _ in range(n)]
    rows = [(1, i, points[k].tolist()) for i, k in enumerate(order)] + [(2, -1, [1.0] * 6)]
    got = {r.i: r.medoid for r in cluster.cluster_two(spark.createDataFrame(rows, "g int, i long, k array<float>"), "g", "i", "k", 2).collect()}
    assert got.pop(-1) == -1 and {order[m] for m in got.values()} == set(want[1:]) and len(got) == len(order)
    assert sum(d[order[i], order[m]] for i, m in got.items()) == pytest.approx(want[0], rel=1e-5)


def test_subsets_carry_no_lists_of_parts(spark):
    """A subset is a sum less what is left out: no list is built or searched for each of them."""
    parts = spark.createDataFrame([(1, i, 10**i) for i in range(5)], "k int, i long, size long")
    got = haplotypes.partial_sizes(parts, ["k"], "size", "i", 3, 100)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_append" not in plan and "array_contains" not in plan
    want = [(len(x), 11111 - sum(10**i for i in x)) for k in range(4) for x in combinations(range(5), k)]
    assert sorted((r.partial, r.total) for r in got.collect()) == sorted(want)


def test_cigars_are_parsed_once(spark, tmp_path):
    """Their operations serve pileups and ends alike; indexes are written in the parts asked for, in order of place."""
    rows = [("c", i * 7 % 50, f"{i + 1}M60D5M2I{i}S", "ACGT", 60, 0, None, None, i) for i in range(50)]
    reads = spark.createDataFrame(rows, "chrom string, start long, cigar string, seq string, mapq int, flags int, ps string, hp string, read_ord long")
    made = pileup.reads_to_pileups(reads, PileupParams())
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted((r.start, r.end, r.pileups[0].position, r.pileups[0].size) for r in made.collect()) == sorted((s, s + i + 66, s + i, -60) for i in range(50) for s in [i * 7 % 50])
    for write, read, name in ((text.write_plup, text.read_plup, "a.plup"), (text.write_index, text.read_index, "b.plup.parquet")):
        write(made, f"{tmp_path}/{name}", PileupParams(), 5)
        files = [f for f in (tmp_path / name).rglob("*") if f.suffix in (".txt", ".parquet")]
        assert 5 <= len(files) <= 6
        got = read(spark, f"{tmp_path}/{name}", P).select("start", "end", "pileups").collect()
        assert sorted(map(str, got)) == sorted(map(str, made.select("start", "end", "pileups").collect()))


def test_annotation_without_paths_and_order(spark):
    v = spark.createDataFrame([("c", 0, 1, "A", "AC")], "chrom string, ne long, node int, ref string, alt string")
    found = spark.createDataFrame([("c", 0, "Unset", 0, [])], f"chrom string, ne long, ploidy string, coverage long, paths {annotate.PATHS}")
    (r,) = annotate.annotate(v, found).collect()
    assert (r.gt, r.ft, r.sq, r.gq, r.dp, r.ad, r.ks, r.alt) == ("./.", 30, 5, 0, 0, [0, 0], [], "AC")


def test_spanning_counts_equal_pairs(spark):
    rng = random.Random(5)
    spans = [(rng.choice("ab"), s, s + rng.randint(0, 30)) for s in (rng.randint(-20, 60) for _ in range(200))]
    points = [(i, rng.choice("abc"), rng.randint(-10, 60)) for i in range(80)]
    left, right = spark.createDataFrame(points, "i int, c string, p long"), spark.createDataFrame(spans, "c string, s long, e long")
    for length in (0, 7):
        got = {r.i: r.n for r in intervals.spanning_counts(left, right, "c", "p", length, "s", "e", 16).collect()}
        assert got == {i: sum(c == x and s < p and e > p + length for x, s, e in spans) for i, c, p in points}
    assert intervals.spanning_counts(left.limit(0), right, "c", "p", 1, "s", "e", 16).count() == 0
    assert [r.n for r in intervals.spanning_counts(left, right.limit(0), "c", "p", 1, "s", "e", 16).collect()] == [0] * 80


def test_dataframe_haplotypes(spark):
    rows = [("k", 0, 10, 1, 1, [1.0, 0.0], None), ("k", 1, 10, 1, 1, [1.0, 0.0], 4), ("k", 2, 30, 2, 1, [0.0, -1.0], 9)]
    df = spark.createDataFrame(rows, "g string, read_ord long, size long, n long, coverage long, kfeat array<double>, ps long")
    (m,) = haplotypes.haploid_mode(df, ["g"]).collect()
    assert (m["size"], m.coverage, m.ps) == (10, 3, 4)
    assert [r.read_ord for r in haplotypes.ordered(df, ["g"]).orderBy("rank").collect()] == [0, 1, 2]
    (s,) = haplotypes.sum_parts(df, ["g"], "size", "kfeat", 2).collect()
    assert (s["size"], s.n, s.kfeat) == (50, 3, [2.0, -1.0])


def test_alike_reads_count_as_weights():
    rng = np.random.default_rng(8)
    for _ in range(20):
        kinds = rng.integers(0, 9, (int(rng.integers(1, 5)), 4)).astype(np.float32)
        haps = [hap(int(k) + 1, kinds[k], hp=int(rng.integers(1, 3)) if k else None) for k in rng.integers(0, len(kinds), 12)]
        first, which = cluster.distinct(haps)
        assert all(haps[first[w]].hp == h.hp and (haps[first[w]].kfeat == h.kfeat).all() for w, h in zip(which, haps, strict=True))
        if len(first) > 1:
            whole = cluster.distances(np.stack([h.kfeat for h in haps]), 1)
            few = whole[np.ix_(first, first)]
            assert cluster.two_medoids(few, np.bincount(which))[2] == pytest.approx(cluster.two_medoids(whole)[2], abs=1e-4)


def test_partial_sizes_of_many_parts(spark):
    """Keys of 1 to 40 parts against brute force; 2**40 masks could not be made."""
    parts = {m: [(7 * i + m) % 11 for i in range(m)] for m in (1, 2, 3, 4, 5, 13, 24, 40)}
    df = spark.createDataFrame([(m, i, x) for m, xs in parts.items() for i, x in enumerate(xs)], "k int, i int, size long")
    got = sorted((r.k, r.partial, r.total) for r in haplotypes.partial_sizes(df, ["k"], "size", "i", 3, 100).collect())
    want = [(m, n, sum(xs) - sum(out)) for m, xs in parts.items() for n in range(4) if n < m for out in combinations(xs, n)]
    assert got == sorted(want)
    alone = haplotypes.partial_sizes(df, ["k"], "size", "i", 3, 24).where("k >= 24").collect()
    assert sorted((r.k, r.partial, r.total) for r in alone) == [(m, 0, sum(parts[m])) for m in (24, 40)]


def test_partial_haplotypes_of_every_customer(spark):
    sf = "/root/testdata/sf0.001"
    keys: dict = {}
    for r in spark.read.parquet(f"{sf}/orders.parquet").collect():
        keys.setdefault(r.o_custkey, []).append(r.o_orderkey % 50)
    want = {}
    for k, xs in keys.items():
        for n in range(4):
            if n < len(xs):
                want[k, n] = (comb(len(xs), n), sum(sum(xs) - sum(out) for out in combinations(xs, n)))
    got = {(r.o_custkey, r.partial): (r.n, r.total) for r in table_queries.partial_haplotypes(spark, sf).collect()}
    assert max(map(len, keys.values())) > 12 and got == want


def test_files_are_read_in_their_order(spark, tmp_path):
    """A folder of two parts, the second one larger, equals one file."""
    head = ["##fileformat=VCFv4.2", "##contig=<ID=c,length=100000>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    records = [f"c\t{i + 1}\tv{i}\tA\tC\t.\t.\t{'x' * (5 if i < 50 else 400)}" for i in range(4000)]
    (tmp_path / "one.vcf").write_text("\n".join(head + records) + "\n")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "part-0.vcf").write_text("\n".join(head + records[:50]) + "\n")
    (tmp_path / "two" / "part-1.vcf").write_text("\n".join(records[50:]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        for path in ("one.vcf", "two"):
            got = text.read_vcf(spark, f"{tmp_path}/{path}").select("id", "ordinal").orderBy("ordinal").collect()
            assert [r.id for r in got] == [f"v{i}" for i in range(4000)] and [r.ordinal for r in got] == list(range(3, 4003))
            assert text.read_vcf_header(spark, f"{tmp_path}/{path}") == head
        lines = text._ordered(spark, f"{tmp_path}/two").orderBy("ordinal").collect()
        assert [r.value for r in lines] == head + records
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("width", [7, 60, 100_000])
def test_fasta_over_many_splits(spark, tmp_path, width):
    rng = random.Random(3)
    contigs = {"a": bases(rng, 9000), "empty": "", "b>x": bases(rng, 150), "c": bases(rng, 20_011)}
    body = "".join(f">{name} of a > b\n" + "".join(seq[i : i + width] + "\n" for i in range(0, len(seq), width)) for name, seq in contigs.items())
    (tmp_path / "x.fa").write_text(body)
    (tmp_path / "parts").mkdir()
    lines = body.splitlines(keepends=True)
    for k in range(0, len(lines), 41):  # contigs cross the borders of files
        (tmp_path / "parts" / f"part-{k:06d}.fa").write_text("".join(lines[k : k + 41]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = text.read_fasta(spark, f"{tmp_path}/x.fa", 512).collect()
        assert sorted(got) == sorted(text.read_fasta(spark, f"{tmp_path}/parts", 512).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.chrom, r.chunk_start, r.seq) for r in got) == sorted((n, i, s[i : i + 512]) for n, s in contigs.items() for i in range(0, len(s), 512))
