"""Operators on hand-made genomic fixtures."""

from __future__ import annotations

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuslake.functions import regions as R
from locuslake.functions import sequences as Q
from locuslake.operators import checks, coverage, deviation, evaluate, genome, grouping, intervals, motif, pseudobulk, sampling, structure
from locuslake.plans import rows as P
from locuslake.sources import files


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


@pytest.fixture
def iv(spark):
    return lambda *x: spark.createDataFrame([(c, s, e, f"{c}:{s}-{e}") for c, s, e in x], "chrom string, start long, end long, name string")


def test_overlap_on_bin_edges(iv):
    a = iv(("c", 0, 20_000), ("c", 20_000, 40_000), ("c", 5, 5), ("d", 0, 1))
    b = iv(("c", 19_999, 20_001), ("c", 40_000, 50_000), ("c", 0, 100_000))
    assert rows(intervals.overlap(a, b), "start", "start_b") == [(0, 0), (0, 19_999), (20_000, 0), (20_000, 19_999)]
    assert rows(intervals.not_overlapping(a, b), "chrom", "start") == [("c", 5), ("d", 0)]
    assert rows(intervals.contained(a, b.filter("start = 0")), "start") == [(0,), (20_000,)]


def test_merge_across_segments(iv):
    s = intervals.SEGMENT
    a = iv(("c", s - 10, s + 10), ("c", s + 10, s + 20), ("c", s + 21, s + 30), ("c", 0, 3 * s))
    assert rows(intervals.merge(a.filter("start > 0")), "start", "end") == [(s - 10, s + 20), (s + 21, s + 30)]
    assert rows(intervals.merge(a), "start", "end") == [(0, 3 * s)]


def test_subtract_splits(iv):
    got = intervals.subtract(iv(("c", 0, 100), ("c", 200, 210), ("c", 300, 310)), iv(("c", 10, 20), ("c", 15, 30), ("c", 50, 60), ("c", 190, 220)), ["name"])
    assert rows(got, "start", "end") == [(0, 10), (30, 50), (60, 100), (300, 310)]


def test_minimum_cover_advances(iv):
    a = iv(("c", 0, 100), ("c", 10, 90), ("c", 50, 150), ("c", 140, 240), ("c", 500, 600))
    got = intervals.minimum_cover(a)
    assert rows(got, "start") == [(0,), (50,), (140,), (500,)]


def test_minimum_cover_against_a_walk_over_all_regions(spark):
    """Random regions, a third of them one region over and over: the greedy walk over the distinct ones."""
    import random

    r = random.Random(5)
    places = [(c, s, s + r.choice([5, 20, 20, 60])) for c in "cd" for s in (r.randrange(3000) for _ in range(150))] + [("c", 40, 90)] * 150
    got = intervals.minimum_cover(spark.createDataFrame([(c, s, e, i) for i, (c, s, e) in enumerate(places)], "chrom string, start long, end long, id long"))
    want = []
    for c in "cd":
        own, k = sorted({(s, e) for x, s, e in places if x == c}), 0
        while k < len(own):
            want.append((c, *own[k], places.index((c, *own[k]))))
            later = [j for j in range(k + 1, len(own)) if own[j][0] < own[k][1]]
            k = later[-1] if later else k + 1
    assert rows(got, "chrom", "start", "end", "id") == sorted(want)


def test_inner_windows(iv):
    a = iv(("c", 0, 10), ("c", 0, 10), ("c", 0, 20), ("c", 5, 15), ("c", 30, 40), ("d", 0, 9))
    assert rows(intervals.inner_windows(a), "chrom", "start", "end") == [("c", 0, 20), ("c", 5, 15)]


def test_bad_regions(spark, iv):
    sizes = spark.createDataFrame([("c", 100)], "chrom string, size long")
    with pytest.raises(ValueError, match="past_end"):
        R.require_valid(iv(("c", 50, 101)), sizes)
    with pytest.raises(Exception, match="malformed region"):
        spark.createDataFrame([("x",)], "r string").select(R.parse_region(F.col("r"))).collect()
    with pytest.raises(ValueError, match="even"):
        R.standardize(3, F.lit(0), F.lit(1))
    with pytest.raises(ValueError, match="no region"):
        P.standard_regions(iv(("c", 0, 2)), sizes, 200)
    with pytest.raises(ValueError, match="outside"):
        intervals.locate(iv(("c", 0, 10)), iv(("c", 5, 20)))


def test_rows_to_ids(spark):
    names = spark.createDataFrame([("a", 0)], "name string, row_id int")
    with pytest.raises(ValueError, match="not in the store"):
        coverage.row_ids(spark.createDataFrame([("g", "b")], "pid string, name string"), names)


def test_sequences(spark):
    df = spark.createDataFrame([("ACGTNa",)], "s string")
    got = df.select(Q.one_hot_decode(Q.one_hot_encode(F.col("s"))), Q.reverse_complement(Q.reverse_complement(F.col("s"))), Q.mutate(F.lit("ACGTACGT"), 3, F.lit("k")), Q.shuffle_window(F.lit("AACCGGTT"), 2, 6, F.lit("k")), Q.random_sequence(F.lit("k"), 50)).first()
    assert got[0] == "ACGTNA" and got[1] == "ACGTNa"
    assert sum(a != b for a, b in zip(got[2], "ACGTACGT", strict=True)) == 3
    assert got[3][:2] == "AA" and got[3][6:] == "TT" and sorted(got[3]) == sorted("AACCGGTT")
    assert len(got[4]) == 50 and set(got[4]) <= set("ACGT")
    indel = df.select(*[Q.substitute_indel(F.lit("AACCGGTT"), F.lit(3), F.lit("CG"), F.lit("T"), k) for k in ("left", "right", "center")]).first()
    assert indel[0][:7] == "AACTGTT" and indel[1][1:] == "AACTGTT" and all(len(x) == 8 for x in indel)
    assert Q.iupac_pattern("CHG") == "C[ACT]G"


def test_fetch_over_tiles(spark, iv):
    whole = spark.createDataFrame([("c", "ACGTACGTAC")], "chrom string, seq string")
    got = genome.fetch(iv(("c", 2, 9), ("c", 8, 12)), genome.tile_sequence(whole, 3), width=5)
    assert rows(got, "name", "seq") == [("c:2-9", "GTACGTA"), ("c:8-12", "ACNN")]


def test_fasta_gtf_and_motif_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">c1 first\nACGTA\nCGTAC\n>c2\nTTTT\n")
    got = rows(files.read_fasta(spark, str(tmp_path / "x.fa"), 4), "chrom", "tile_start", "seq")
    assert got == [("c1", 0, "ACGT"), ("c1", 4, "ACGT"), ("c1", 8, "AC"), ("c2", 0, "TTTT")]
    gtf = ['c\ts\texon\t11\t20\t.\t+\t.\tgene_id "g1.2"; transcript_id "t1"; gene_name "A";', 'c\ts\texon\t31\t40\t.\t+\t.\tgene_id "g1.2"; transcript_id "t1"; gene_name "A";']
    (tmp_path / "x.gtf").write_text("#!x\n" + "\n".join(gtf) + "\n")
    f = files.read_gtf(spark, str(tmp_path / "x.gtf"))
    assert rows(f, "start", "gene_id", "gene_name") == [(10, "g1.2", "A"), (30, "g1.2", "A")]
    assert rows(genome.introns(f), "start", "end", "transcript_id") == [(20, 30, "t1")]
    (tmp_path / "x.pfm").write_text(">M1 alpha\nA [ 1 2 ]\nC [ 3 4 ]\nG [ 5 6 ]\nT [ 7 8 ]\n")
    assert rows(files.read_motifs(spark, str(tmp_path / "x.pfm")), "motif_id", "name", "pos", "a", "t") == [("M1", "alpha", 0, 1.0, 7.0), ("M1", "alpha", 1, 2.0, 8.0)]


def test_region_and_track_files(spark, tmp_path, iv):
    (tmp_path / "sizes").write_text("chr2\t5\nchr10\t7\nchrUn_1\t9\n")
    assert [tuple(r) for r in files.read_chrom_sizes(spark, str(tmp_path / "sizes")).collect()] == [("chr10", 7), ("chr2", 5)]
    files.write_bed(iv(("c", 3, 9), ("c", 1, 4)), str(tmp_path / "bed"))
    assert rows(files.read_bed(spark, str(tmp_path / "bed")), "chrom", "start", "end", "name") == [("c", 1, 4, "c:1-4"), ("c", 3, 9, "c:3-9")]
    bins = spark.createDataFrame([("c", 1, 2.5), ("c", 2, 0.0)], "chrom string, bin long, value double")
    files.write_bedgraph(bins, str(tmp_path / "bg"), 10)
    assert rows(files.read_bedgraph(spark, str(tmp_path / "bg")), "start", "end", "value") == [(10, 20, 2.5)]
    with gzip.open(tmp_path / "f.tsv.gz", "wt") as f:
        f.write("# x\nc\t1\t5\tb1\t1\nc\t2\t6\tb1\t2\nc\t2\t6\tb2\t2\n")
    assert files.read_fragments(spark, str(tmp_path / "f.tsv.gz"), "s", 2).count() == 2
    (tmp_path / "m").write_text("c\t11\t+\tCGA\t1\t2\t1\nc\t12\t+\tCAT\t1\t5\t1\n")
    assert rows(files.read_methylation(spark, str(tmp_path / "m"), "CG", 10), "bin", "prefix", "value") == [(1, "CG_cov", 2), (1, "CG_mc", 1)]


def test_store_round_trip_and_pruning(spark, tmp_path):
    df = spark.createDataFrame([("d", "p", f"chr{c}", b, 1, 1.0) for c in (1, 2) for b in range(50)], "dataset string, prefix string, chrom string, bin long, row_id int, value float")
    coverage.write_store(df, str(tmp_path / "s"))
    got = coverage.read_store(spark, str(tmp_path / "s"), ["chr2"], (10, 20))
    assert got.count() == 10 and "PartitionFilters: [" in got._jdf.queryExecution().toString()
    assert coverage.manifest(spark, str(tmp_path / "s"), "bin").count() >= 50
    with pytest.raises(ValueError, match="no chromosome"):
        coverage.read_store(spark, str(tmp_path / "s"), ["chrX"])


def test_decode_blobs(spark):
    z = lambda x, t: bytearray(gzip.compress(np.array(x, t).tobytes()))
    sparse = spark.createDataFrame([("r", z([1, 0], "uint32"), z([0, 1, 2], "uint32"), z([2.0, 3.0], "float32"), z([2, 4], "uint32"))], "region string, `p:indices+uint32` binary, `p:indptr+uint32` binary, `p:data+float32` binary, `p:shape+uint32` binary")
    assert rows(files.decode_blobs(sparse, "p", 1), "row_id", "bin", "value") == [(0, 1, 2.0), (1, 0, 3.0)]
    dense = spark.createDataFrame([("r", z([[0, 5], [0, 0]], "float32"), z([2, 2], "uint32"))], "region string, `p:data+float32` binary, `p:shape+uint32` binary")
    assert rows(files.decode_blobs(dense, "p", 1), "row_id", "bin", "value") == [(0, 1, 5.0)]


def test_motif_scan_against_enumeration(spark):
    pwm = spark.createDataFrame([("m", k, *[8.0 if b == c else 1.0 for b in "ACGT"]) for k, c in enumerate("GAT")], "motif_id string, pos int, a double, c double, g double, t double")
    model = motif.models(pwm, 1 / 64 + 1e-9)["m"]
    scores = sorted((sum(model[0][k]["ACGT".index(c)] for k, c in enumerate(w)) for w in (a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT")), reverse=True)
    assert scores[1] < model[1] <= scores[0] + 1e-3
    seqs = spark.createDataFrame([("x", "GATNGATCaa")], "name string, seq string")
    hits = motif.scan(seqs, {"m": (model[0], scores[0] - 0.01)})
    assert rows(hits, "strand", "start", "end") == [("+", 0, 3), ("+", 4, 7), ("-", 5, 8)]
    tiles = genome.tile_sequence(spark.createDataFrame([("c", "AAGATCAAGAT")], "chrom string, seq string"), 4, 3)
    assert rows(motif.genome_scan(tiles, {"m": (model[0], scores[0] - 0.01)}), "strand", "start") == [("+", 2), ("+", 8), ("-", 3)]
    assert rows(motif.consensus(pwm), "consensus") == [("GAT",)]
    assert motif.best_hits(hits).count() == 1 and motif.masked_rounds(seqs, {"m": (model[0], scores[0] - 0.01)}, 0.0).count() == 2
    assert motif.trim(pwm, 2).count() == 2 and motif.sample_sequences(pwm.withColumns({c: F.col(c) / 11 for c in "acgt"}), 5).count() == 5


def test_paired_scores_and_conditions(spark):
    p = spark.createDataFrame([("a", None, {"k": "v"})], "pid string, sample_weight double, annotation map<string,string>")
    with pytest.raises(ValueError, match="unknown ids"):
        pseudobulk.annotate(p, spark.createDataFrame([("b", "x")], "pid string, value string"), "n")
    done = pseudobulk.annotate(p, spark.createDataFrame([("a", "x")], "pid string, value string"), "n")
    assert pseudobulk.attribute(done, "n").first()["value"] == "x"
    with pytest.raises(ValueError, match="repeated keys"):
        pseudobulk.with_conditions(p, spark.createDataFrame([("c", "a"), ("d", "a")], "condition string, pid string"), spark.createDataFrame([("c", "t", 1.0)], "condition string, term string, value double"))
    ids = spark.createDataFrame([("p", "a|b:a-0", 1.0), ("p", "a|b:b-0", 3.0)], "peak string, pid string, value double")
    assert rows(evaluate.condition_pairs(ids, ["peak"]), "delta") == [(2.0,)]
    with pytest.raises(Exception, match="malformed id"):
        evaluate.condition_pairs(ids.withColumn("pid", F.lit("x")), ["peak"]).collect()
    t = spark.createDataFrame([("s", "d", "i", "j", 0.0), ("s", "d", "i", "k", 1.0)], "src_cond string, dst_cond string, src_id string, dst_id string, p double")
    assert rows(sampling.transition_map(t), "dst_id") == [("k",)]


def test_checks(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, allele string")
    with pytest.raises(ValueError, match="repeated"):
        checks.require_unique(a, ["k"])
    assert checks.same_keys(a, a, "k")
    assert checks.unfinished(a.select("k").distinct(), a.filter("allele = 'x'"), ["k"], 2).count() == 1
    assert rows(checks.require_folds(a, "k"), "n", "few") == [(2, True)]


def test_structure(spark):
    atoms = spark.createDataFrame([("s", "A", 1, "CA", 0.0, 0.0, 0.0, 50.0), ("s", "A", 3, "CA", 3.0, 4.0, 0.0, 60.0), ("s", "B", 1, "CA", 20.0, 0.0, 0.0, 70.0)], "structure string, chain string, residue_id int, atom_name string, x double, y double, z double, plddt double")
    assert rows(structure.contacts(atoms, 5.1, 5.1, 2), "chain", "residue", "residue_b", "ca") == [("A", 1, 3, 5.0)]
    assert structure.contacts(atoms, 5.0, 5.1, 2).count() == 0
    assert structure.residue_means(atoms).count() == 3
    v = spark.createDataFrame([("k", i, float(i >= 10)) for i in range(20)], "key string, pos int, value double")
    assert rows(structure.threshold_runs(v, "key", 0.5, 1, 3), "start", "end", "above") == [(0, 10, False), (10, 20, True)]
    m = spark.createDataFrame([(i, j, float(i + j)) for i in range(4) for j in range(4)], "i int, j int, v double")
    s = spark.createDataFrame([("a", 0, 2), ("b", 2, 4)], "segment string, start int, end int")
    assert rows(structure.block_means(m, s), "segment", "segment_b", "mean")[1] == ("a", "b", 3.0)


def test_shift_detection(spark):
    profile = [("start", o, b, float((o * 7 + k * 3) % 11)) for o in range(-20, 20) for k, b in enumerate("ACGT")]
    reference = spark.createDataFrame(profile, "end string, offset int, base string, share double")
    moved = reference.withColumn("offset", F.pmod(F.col("offset") + 20 + 3, F.lit(40)) - 20)
    got = genome.detect_shift(moved, reference).first()
    assert (got["shift"], got["mse"]) == (-3, 0.0)


def test_bisect_and_terms(spark):
    cells = spark.createDataFrame([(i, [float(i % 2) * 10, float(i)]) for i in range(40)], "cell int, v array<double>")
    assert grouping.bisect(cells, "v", 10).count() == 40
    with pytest.raises(Exception, match="missing value"):
        grouping.aggregate_terms(spark.createDataFrame([("g", None)], "g string, t double"), "g", "t").collect()
    saved = spark.createDataFrame([(["a", "b"], "group0")], "level array<string>, group string")
    assert grouping.apply_groups(spark.createDataFrame([("b",), ("c",)], "level string"), saved, ["level"]).count() == 1


def test_training_rows(spark, iv):
    regions = iv(("c", 0, 40), ("c", 40, 80))
    store = spark.createDataFrame([("c", 1, 1, 4.0), ("c", 5, 2, 6.0)], "chrom string, bin long, row_id int, value double")
    members = spark.createDataFrame([(1, "g"), (2, "g")], "row_id int, pid string")
    depths = spark.createDataFrame([("g", 1.0)], "pid string, cov_scale double")
    tiles = genome.tile_sequence(spark.createDataFrame([("c", "ACGT" * 20)], "chrom string, seq string"), 16)
    offsets = intervals.chrom_offsets(spark.createDataFrame([("c", 80)], "chrom string, size long"))
    got = P.training_rows(regions, store, members, depths, tiles, offsets, 10)
    assert [(r["name"], [tuple(b) for b in r["bins"]], len(r["seq"]), r["gstart"]) for r in got.orderBy("name").collect()] == [("c:0-40", [(1, 2.0)], 40, 0), ("c:40-80", [(1, 3.0)], 40, 40)]


def test_deviation_without_spread(spark):
    counts = spark.createDataFrame([("a", 1, 2), ("b", 1, 2)], "cell string, feature int, n int")
    m = spark.createDataFrame([("m", 1)], "motif string, feature int")
    b = spark.createDataFrame([(1, 0, 1), (1, 1, 1)], "feature int, iter int, bg_feature int")
    assert rows(deviation.deviations(counts, m, b), "z") == [(0.0,), (0.0,)]


def test_mutation_runs_over_whole_sequences(spark):
    from locuslake.functions import sequences as Q

    rows = [(i, "ACGT" * n) for i, n in enumerate((0, 1, 15, 2000))] + [(9, "ACG")]
    df = spark.createDataFrame(rows, "k long, s string")
    for r in df.select("s", Q.mutate(F.col("s"), 5, F.col("k")).alias("m")).collect():
        changed = [i for i, (a, b) in enumerate(zip(r["s"], r["m"], strict=True)) if a != b]
        assert len(changed) == min(5, len(r["s"]))
    from locuslake.plans import more_queries, queries  # noqa: F401

    plan = queries.QUERIES["f10_mutated_positions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert ", 1, 60)" not in plan  # no prefix


def test_broadcast_only_below_a_size(spark):
    few = spark.range(10)
    hinted = lambda df: "broadcast" in spark.range(5).join(df, "id")._jdf.queryExecution().logical().toString()
    assert hinted(checks.small(few, most=10)) and not hinted(checks.small(few, most=9))
    assert hinted(checks.small(few, n=3, most=3)) and not hinted(checks.small(few, n=4, most=3))
    assert rows(spark.range(5).join(checks.small(few, most=9), "id"), "id") == [(k,) for k in range(5)]
