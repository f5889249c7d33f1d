"""More registered queries: stores and sinks read back, value functions, annotation joins, row assembly, seeded choices."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuslake.functions import regions as R
from locuslake.functions import sequences as Q
from locuslake.functions import values as V
from locuslake.operators import checks, coverage, evaluate, genome, grouping, intervals, motif, pseudobulk, sampling, structure
from locuslake.plans import rows as P
from locuslake.plans.queries import _SEQ, query, r6, seqs
from locuslake.sources import files
from locuslake.sources.store import shared_folder


def scratch(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


# --- stores, sinks and sources read back -----------------------------------------------------------------------------

@query("s5_region_lookup", "SELECT name, chrom, st, en FROM v_peak WHERE name IN (SELECT concat('p', l_partkey) FROM lineitem WHERE l_quantity >= 49)")
def s5(t):
    """Regions stored in buckets of their names, looked up by a table of names."""
    wanted = t.lineitem.filter("l_quantity >= 49").select(F.concat(F.lit("p"), "l_partkey").alias("name"))
    table = f"regions_{uuid.uuid4().hex}"
    coverage.write_lookup(t.v_peak, scratch(t, "regions"), table, "name", 8)
    return coverage.look_up(t.spark, table, wanted, "name").select("name", "chrom", "start", "end")


@query("s5_point_lookup", "SELECT name, chrom, st, en FROM v_peak WHERE name IN ('p7', 'p19', 'p150')")
def s5b(t):
    table = f"regions_{uuid.uuid4().hex}"
    coverage.write_lookup(t.v_peak, scratch(t, "regions"), table, "name", 8)
    return coverage.look_up(t.spark, table, ["p7", "p19", "p150", "none"], "name").select("name", "chrom", "start", "end")


@query("s6_store_round_trip", "SELECT chrom, bin, row_id, value FROM v_cov WHERE chrom IN ('chr1', 'chr4') AND bin >= 50")
def s6(t):
    path = scratch(t, "store")
    coverage.write_store(t.v_cov.select(F.lit("d").alias("dataset"), F.lit("p").alias("prefix"), "chrom", "bin", "row_id", "value"), path)
    return coverage.read_store(t.spark, path, ["chr1", "chr4"], (50, 1 << 40)).select("chrom", "bin", "row_id", "value")


@query("s10b_multi_track", "SELECT l_returnflag AS track, concat('chr', l_linenumber) AS chrom, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2")
def s10b(t):
    paths = {}
    for flag in ("A", "N", "R"):
        paths[flag] = scratch(t, f"track-{flag}")
        bins = t.lineitem.filter(F.col("l_returnflag") == flag).groupBy(F.concat(F.lit("chr"), "l_linenumber").alias("chrom"), F.col("l_suppkey").alias("bin")).agg(F.sum("l_quantity").alias("value"))
        files.write_bedgraph(bins, paths[flag], 10)
    return files.read_tracks(t.spark, paths).groupBy("track", "chrom").agg(F.sum("value").alias("value"))


@query("s17_motif_instances", "SELECT pk, gene_name FROM v_gene WHERE chrom = 'chr2' AND st >= 2000 AND en <= 90000 AND gene_name IN (SELECT p_name FROM part WHERE p_size < 30)")
def s17(t):
    h = t.v_gene.withColumnRenamed("gene_name", "gene").join(t.part.filter("p_size < 30").select(F.col("p_name").alias("gene")), "gene", "left_semi")
    return files.instances(h, "chr2", 2000, 90000).select("pk", F.col("gene").alias("gene_name"))


@query("s18_old_qtl_layout", "SELECT qtl_id, pos AS pos2start, st AS window_start FROM v_qtl")
def s18(t):
    old = t.v_qtl.select("qtl_id", F.col("chrom").alias("chr"), "start", "end", (F.col("pos") + 1).alias("pos2start"))
    return genome.rename_old_qtl(old).select("qtl_id", "pos2start", F.col("Start").alias("window_start"))


@query("s21_wide_results", "SELECT peak, sum(ytrue) FILTER (pid = 'g0') AS g0, sum(ytrue) FILTER (pid = 'g1') AS g1 FROM v_eval WHERE pid IN ('g0', 'g1') GROUP BY 1")
def s21(t):
    path = scratch(t, "wide")
    files.write_results(t.v_eval.filter("pid in ('g0', 'g1')"), path, "pid", "peak", "ytrue")
    return t.spark.read.parquet(path).select("peak", "g0", "g1")


@query("s23_region_partitions", "SELECT concat(chrom, '-', st // 50000) AS partition, count(*) AS n FROM v_peak GROUP BY 1")
def s23(t):
    path = scratch(t, "matrix")
    files.write_region_matrix(t.v_peak, path, 50000)
    return t.spark.read.parquet(path).groupBy("partition").agg(F.count("*").alias("n"))


@query("s24_bed_round_trip", "SELECT chrom, st, en, name FROM v_peak")
def s24(t):
    path = scratch(t, "bed")
    files.write_bed(t.v_peak, path)
    return files.read_bed(t.spark, path).select("chrom", "start", "end", "name")


@query("s25_global_slice", """WITH o AS (SELECT chrom, coalesce(sum(size) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM v_chrom)
SELECT cell, chrom, pos, n FROM v_ins JOIN o USING (chrom) WHERE pos + g >= 30000 AND pos + g < 60000""")
def s25(t):
    points = t.v_ins.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + 1)
    return intervals.to_global(points, intervals.chrom_offsets(t.v_chrom)).filter("gstart >= 30000 and gstart < 60000").select("cell", "chrom", "pos", "n")


# --- values ------------------------------------------------------------------------------------------------------------

@query("p15_recentre", "SELECT pid, CAST(floor((st + en) / 2) - 128 AS BIGINT) AS st, CAST(floor((st + en) / 2) + 128 AS BIGINT) AS en FROM v_peak")
def p15(t):
    s, e = R.standardize(256, F.col("start"), F.col("end"))
    return t.v_peak.select("pid", s.alias("start"), e.alias("end"))


@query("p13_minimum_coverage", "SELECT cell, feature FROM v_counts QUALIFY sum(n) OVER (PARTITION BY feature) > 700")
def p13(t):
    return P.apply_steps(t.v_counts, [("least_total", {"key": "feature", "value": "n", "least": 700})]).select("cell", "feature")


@query("p12_low_share", """WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_acctbal < 9000), l AS (SELECT c_custkey FROM customer WHERE c_acctbal <= 5000 ORDER BY md5(concat(c_custkey, '|', 0)), c_custkey LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) FROM g))
SELECT * FROM g UNION ALL SELECT * FROM l""")
def p12(t):
    return sampling.with_low_share(t.customer, "c_custkey", "c_acctbal", 5000, 9000, 0.1).select("c_custkey")


@query("p25_array_delta", "SELECT a.vec_id, list_transform(range(1, 65), lambda i: CAST(b.embedding[i] AS DOUBLE) - CAST(a.embedding[i] AS DOUBLE)) AS delta FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def p25(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return j.select("vec_id", pseudobulk.array_delta(F.col("x"), F.col("y")).alias("delta"))  # differences of single floats are exact


@query("p32_pad_or_cut", "SELECT cell, list_concat(v[1:3], list_transform(range(0, greatest(0, 3 - len(v))), lambda i: [0.0::DOUBLE, 0.0::DOUBLE])) AS v FROM (SELECT cell, list([CAST(feature AS DOUBLE), CAST(n AS DOUBLE)] ORDER BY feature) AS v FROM v_counts GROUP BY 1) x")
def p32(t):
    g = t.v_counts.groupBy("cell").agg(F.array_sort(F.collect_list(F.array(F.col("feature").cast("double"), F.col("n").cast("double")))).alias("v"))
    return g.select("cell", V.pad_or_cut(F.col("v"), 3, 2).alias("v"))


@query("p35_drop_and_intersect", "SELECT c_custkey FROM customer WHERE c_mktsegment IS NOT NULL AND c_custkey IN (SELECT o_custkey FROM orders)")
def p35(t):
    return t.customer.dropna(subset=["c_mktsegment"]).join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("p36_seqlet_flanks", """SELECT q.qtl_id, q.st + q.c - 20 AS st, q.st + q.c + 20 AS en FROM (SELECT DISTINCT qtl_id, st, en, pos - st AS c FROM v_qtl) q WHERE q.c - 20 >= 0 AND q.st + q.c + 20 <= q.en""")
def p36(t):
    q = t.v_qtl.select("qtl_id", "chrom", "start", "end", "pos").distinct()
    s = q.select(F.col("qtl_id").alias("parent"), (F.col("pos") - F.col("start") - 2).alias("start"), (F.col("pos") - F.col("start") + 2).alias("end"))
    return motif.seqlet_flanks(s, q.select(F.col("qtl_id").alias("parent"), "chrom", "start", "end"), 20).select(F.col("parent").alias("qtl_id"), "start", "end")


@query("p37_sparsify", "SELECT cell, feature, CASE WHEN abs(n) >= quantile_cont(abs(n), 0.9) OVER (PARTITION BY cell) THEN CAST(n AS DOUBLE) ELSE 0.0 END AS n FROM v_counts")
def p37(t):
    return evaluate.top_by_quantile(t.v_counts.withColumn("n", F.col("n").cast("double")), "cell", "n", 0.1)


@query("p38_variant_slice", "SELECT DISTINCT q.qtl_id, c.bin * 100 - q.pos // 100 * 100 AS offset FROM v_qtl q JOIN (SELECT DISTINCT chrom, bin FROM v_cov) c ON c.chrom = q.chrom AND c.bin >= q.pos // 100 - 3 AND c.bin < q.pos // 100 + 3")
def p38(t):
    q = t.v_qtl.select("qtl_id", "chrom", F.floor(F.col("pos") / 100).alias("centre")).distinct()
    s = t.v_cov.select("chrom", "bin").distinct().join(q.select("chrom", F.col("qtl_id").alias("region"), F.explode(F.sequence(F.col("centre") - 3, F.col("centre") + 2)).alias("bin")), ["chrom", "bin"])
    return evaluate.around(s, q.select(F.col("qtl_id").alias("region"), "centre"), 3).select(F.col("region").alias("qtl_id"), (F.col("offset") * 100).alias("offset")).distinct()


@query("p40_annotation", "SELECT concat('n', n_nationkey) AS pid, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def p40(t):
    p = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("pid"), F.create_map(F.lit("name"), F.col("n_name")).alias("annotation"), "n_regionkey")
    v = p.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("pid", F.col("r_name").alias("value"))
    return pseudobulk.attribute(pseudobulk.annotate(p, v, "class"), "class")


@query("n2_geometric_spacing", "SELECT p_partkey, list_transform(range(0, 5), lambda k: CAST(round_even(32 * pow(pow(2048 / 32.0, 1 / 4.0), k) / 16, 0) * 16 AS BIGINT) + p_size) AS widths FROM part")
def n2(t):
    return t.part.select("p_partkey", F.transform(V.geometric_spacing(32, 2048, 5, 16), lambda w: w + F.col("p_size")).alias("widths"))


@query("n4_missing_values", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE CAST(p_size AS DOUBLE) END AS x FROM part")
def n4(t):
    return t.part.select("p_partkey", V.no_nan(F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("double")).when(F.col("p_size") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p_size"))).alias("x"))


@query("n3_array_functions", "SELECT vec_id, round(CAST(embedding[64] AS DOUBLE), 6) AS first_reversed, round(list_sum(list_transform(range(1, 5), lambda i: CAST(embedding[i] AS DOUBLE) * (CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE)))), 6) AS outer_sum FROM embeddings")
def n3(t):
    e = F.col("embedding").cast("array<double>")
    total = F.aggregate(F.flatten(V.outer(F.slice(e, 1, 4), F.slice(e, 1, 2))), F.lit(0.0), lambda a, b: a + b)
    return t.embeddings.select("vec_id", r6(F.get(F.reverse(e), F.lit(0))).alias("first_reversed"), r6(total).alias("outer_sum"))


# --- annotation, conditions, gathering --------------------------------------------------------------------------------

@query("j13_conditions", "SELECT concat('n', n_nationkey) AS pid, r_name AS condition, CAST(r_regionkey * 2 AS DOUBLE) AS dose FROM nation JOIN region ON n_regionkey = r_regionkey")
def j13(t):
    p = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("pid"), "n_regionkey")
    c = p.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("pid", F.col("r_name").alias("condition"))
    terms = t.region.select(F.col("r_name").alias("condition"), F.lit("dose").alias("term"), (F.col("r_regionkey") * 2).cast("double").alias("value"))
    return pseudobulk.with_conditions(p, c, terms).select("pid", "condition", F.col("terms")["dose"].alias("dose"))


@query("j15_shared_scores", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS s0, round(CAST(embedding[64] AS DOUBLE), 6) AS s1 FROM embeddings WHERE vec_id % 3 = 0")
def j15(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("score"))
    both = pseudobulk.shared_scores([e, e.filter("vec_id % 3 = 0").withColumn("score", F.reverse("score"))], ["vec_id"])
    return both.select("vec_id", r6(F.get("s0", F.lit(0))).alias("s0"), r6(F.get("s1", F.lit(0))).alias("s1"))


@query("j16_hit_annotation", """WITH h AS (SELECT l_partkey AS peak_id, l_suppkey % 4 AS motif_id, l_suppkey % 30 AS hit_start, l_linestatus AS strand, l_quantity AS c FROM lineitem),
j AS (SELECT h.*, p.chrom, p.st + hit_start AS s, concat('m', motif_id) AS motif_name, c * (p_size % 3 + 1) AS scaled FROM h JOIN v_peak p ON p.pid = peak_id JOIN part ON p_partkey = peak_id)
SELECT chrom, s AS st, motif_name, strand, max(scaled) AS scaled FROM j GROUP BY 1, 2, 3, 4""")
def j16(t):
    h = t.lineitem.select(F.col("l_partkey").alias("peak_id"), (F.col("l_suppkey") % 4).alias("motif_id"), (F.col("l_suppkey") % 30).alias("hit_start"), F.col("l_linestatus").alias("strand"), F.col("l_quantity").alias("coefficient"))
    peaks = t.v_peak.select(F.col("pid").alias("peak_id"), "chrom", F.col("start").alias("peak_start"))
    motifs = t.spark.createDataFrame([(k, f"m{k}", 8) for k in range(4)], "motif_id long, motif_name string, motif_length int")
    qc = t.part.select(F.col("p_partkey").alias("peak_id"), (F.col("p_size") % 3 + 1).alias("global_scale"))
    return motif.annotate_hits(h, peaks, motifs, qc).select("chrom", "start", "motif_name", "strand", "scaled")


@query("j22_prefix_union", "SELECT prefix, chrom, bin, CAST(sum(value) AS BIGINT) AS value FROM (SELECT 'all' AS prefix, chrom, bin, value FROM v_cov UNION ALL SELECT 'even', chrom, bin, value FROM v_cov WHERE row_id % 2 = 0) x GROUP BY 1, 2, 3")
def j22(t):
    both = checks.union({"all": t.v_cov, "even": t.v_cov.filter("row_id % 2 = 0")}, "prefix")
    return coverage.by_expression(both, ["prefix", "chrom", "bin"], F.sum("value"))


@query("j23_contacts", """WITH a AS (SELECT s_suppkey AS r, s_suppkey * 37 % 101 / 10.0 AS x, s_suppkey * 53 % 97 / 10.0 AS y, s_suppkey * 71 % 89 / 10.0 AS z FROM supplier)
SELECT a.r AS residue, b.r AS residue_b, round(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2), 6) AS ca FROM a JOIN a b ON b.r - a.r >= 2 WHERE sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2) < 2.55""")
def j23(t):
    at = lambda m, n: (F.col("s_suppkey") * m % n / 10.0)
    atoms = t.supplier.select(F.lit("s").alias("structure"), F.lit("A").alias("chain"), F.col("s_suppkey").alias("residue_id"), F.lit("CA").alias("atom_name"), at(37, 101).alias("x"), at(53, 97).alias("y"), at(71, 89).alias("z"))
    return structure.contacts(atoms, 2.55, 2.55, 2).select("residue", "residue_b", r6("ca").alias("ca"))


@query("a29_insulation", """WITH m AS (SELECT l_suppkey % 20 AS i, l_partkey % 20 AS j, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2), l AS (SELECT unnest(range(4, 17)) AS locus)
SELECT locus, round(greatest(coalesce(avg(v) FILTER (i < locus AND j < locus), 0) + 1, coalesce(avg(v) FILTER (i >= locus AND j >= locus), 0) + 1) / (coalesce(avg(v) FILTER ((i < locus) <> (j < locus)), 0) + 1), 6) AS score
FROM m JOIN l ON i >= locus - 4 AND i < locus + 4 AND j >= locus - 4 AND j < locus + 4 GROUP BY 1""")
def a29(t):
    m = t.lineitem.groupBy((F.col("l_suppkey") % 20).alias("i"), (F.col("l_partkey") % 20).alias("j")).agg(F.sum("l_quantity").alias("v"))
    loci = t.spark.range(4, 17).withColumnRenamed("id", "locus")
    return evaluate.insulation(m, loci, 4).select("locus", r6("score").alias("score"))


@query("a34_condition_terms", "SELECT grp, round(avg(bal), 4) AS bal FROM v_cells GROUP BY 1")
def a34(t):
    return grouping.aggregate_terms(t.v_cells, "grp", "bal").withColumn("bal", F.round("bal", 4))


@query("a35_dominant_annotation", "SELECT pid, class FROM (SELECT concat('g', cell % 10) AS pid, class, count(*) AS n FROM v_cells GROUP BY 1, 2) x QUALIFY row_number() OVER (PARTITION BY pid ORDER BY n DESC, class) = 1")
def a35(t):
    return grouping.majority(t.v_cells.withColumn("pid", F.concat(F.lit("g"), F.col("cell") % 10)), "pid", "class")


@query("a37_gather", "WITH u AS (SELECT peak, pid, ytrue, 0 AS batch FROM v_eval WHERE peak % 2 = 0 UNION ALL SELECT peak, pid, ytrue + 1, 1 FROM v_eval) SELECT peak, CASE WHEN pid = 'g3' THEN 'three' ELSE pid END AS pid, ytrue FROM u QUALIFY row_number() OVER (PARTITION BY peak, pid ORDER BY batch) = 1")
def a37(t):
    a = t.v_eval.filter("peak % 2 = 0").select("peak", "pid", "ytrue", F.lit(0).alias("batch"))
    b = t.v_eval.select("peak", "pid", (F.col("ytrue") + 1).alias("ytrue"), F.lit(1).alias("batch"))
    names = t.spark.createDataFrame([("g3", "three")], "internal string, original string")
    return evaluate.gather([a, b], ["peak", "pid"], ["batch"], names).select("peak", "pid", "ytrue")


@query("a39_fold_counts", "SELECT p_size % 8 AS fold, count(*) AS n, count(*) < 10 AS few FROM part GROUP BY 1")
def a39(t):
    return checks.require_folds(t.part.withColumn("fold", F.col("p_size") % 8), "fold")


@query("a41_block_means", """WITH m AS (SELECT l_suppkey % 20 AS i, l_partkey % 20 AS j, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2) SELECT concat('s', i // 5) AS segment, concat('s', j // 5) AS segment_b, round(avg(v), 6) AS mean FROM m GROUP BY 1, 2""")
def a41(t):
    m = t.lineitem.groupBy((F.col("l_suppkey") % 20).alias("i"), (F.col("l_partkey") % 20).alias("j")).agg(F.sum("l_quantity").alias("v"))
    segments = t.spark.range(4).withColumnRenamed("id", "k").select(F.concat(F.lit("s"), "k").alias("segment"), (F.col("k") * 5).alias("start"), (F.col("k") * 5 + 5).alias("end"))
    return structure.block_means(m, segments).withColumn("mean", r6("mean"))


@query("w7_top_hit", "SELECT cell, feature FROM v_counts QUALIFY row_number() OVER (PARTITION BY cell ORDER BY n DESC, feature) = 1")
def w7(t):
    return sampling.keep_first(t.v_counts, ["cell"], [F.desc("n"), "feature"]).select("cell", "feature")


@query("u_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def u_distinct(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("l13_ensemble_background", "WITH m AS (SELECT vec_id, embedding, vec_id % 20 + 1 AS size FROM embeddings ORDER BY md5(concat(vec_id, '|', 0)), vec_id LIMIT 100) SELECT CAST(sum(size) AS BIGINT) AS depth, count(*) AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS m0 FROM m")
def l13(t):
    e = t.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>")).withColumn("size", F.col("vec_id") % 20 + 1)
    return pseudobulk.ensemble_background(e, "vec_id", "embedding", "size", 100).select("depth", "n", r6(F.get("mean", F.lit(0))).alias("m0"))


@query("a19b_top_features", "SELECT feature, CAST(sum(n) AS BIGINT) AS total FROM v_counts GROUP BY 1 HAVING sum(n) > 500 ORDER BY 2 DESC, 1 LIMIT 200")
def a19b(t):
    return grouping.top_features(t.v_counts, "feature", "n", 500, 200)


@query("c2_apply_groups", "SELECT cell, CASE WHEN class IN ('ASIA', 'AFRICA') THEN 'group0' ELSE 'group1' END AS \"group\" FROM v_cells WHERE class IN ('ASIA', 'AFRICA', 'EUROPE')")
def c2(t):
    saved = t.spark.createDataFrame([(["ASIA", "AFRICA"], "group0"), (["EUROPE"], "group1")], "class array<string>, group string")
    return grouping.apply_groups(t.v_cells, saved, ["class"]).select("cell", "group")


@query("c7_split_regions", """WITH f AS (SELECT chrom, size, unnest(range(0, 8)) AS fold FROM v_chrom), g AS (SELECT chrom, fold, fold * (size // 8) AS fs, (fold + 1) * (size // 8) AS fe FROM f),
m AS (SELECT DISTINCT chrom, CAST(floor((st + en) / 2) AS BIGINT) AS c, size FROM v_peak JOIN v_chrom USING (chrom)), a AS (SELECT chrom, size, greatest(c - 1000, 0) AS s FROM m), r AS (SELECT DISTINCT chrom, CASE WHEN s + 2000 > size THEN size - 2000 ELSE s END AS s FROM a)
SELECT r.chrom, r.s AS st, CASE g.fold WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS role FROM r JOIN g ON r.chrom = g.chrom AND r.s >= fs AND r.s + 2000 <= fe""")
def c7(t):
    ground = t.v_chrom.select("chrom", "size", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("fold")).select("chrom", (F.col("fold") * F.floor(F.col("size") / 8)).alias("start"), ((F.col("fold") + 1) * F.floor(F.col("size") / 8)).alias("end"), "fold")
    folds = t.spark.createDataFrame([(0, k, "test" if k == 0 else "valid" if k == 1 else "train") for k in range(8)], "split_id int, fold int, role string")
    return P.split_regions(t.v_peak, ground, folds, 0, t.v_chrom, 2000).select("chrom", "start", "role")


@query("c9_training_rows")
def c9(t):
    tiles, sizes = dealt_genome(seqs(t))
    regions = intervals.windows(sizes, 200, 200).withColumn("name", R.format_region(F.col("chrom"), F.col("start"), F.col("end")))
    merged = coverage.merge_rows(t.v_cov, t.v_members, ["chrom", "bin"])
    return P.training_rows(regions, t.v_cov, t.v_members, coverage.depth(merged, 1e6), tiles, intervals.chrom_offsets(sizes), 100)


def dealt_genome(docs):
    """Tiles of 512 bases and chromosome sizes: all documents' sequences, dealt to seven chromosomes by id and laid end to end.

    Places are running sums of lengths, over the sums of runs of 7000 ids first, so that no task orders a whole chromosome.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(0)).cast("long")
    s = docs.filter(F.length("seq") > 0).select("doc_id", "seq", F.concat(F.lit("chr"), F.pmod(key, F.lit(7)) + 1).alias("chrom"), F.floor(key / 7000).alias("run"), F.length("seq").cast("long").alias("n"))
    runs = s.groupBy("chrom", "run").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("chrom", "run", before(W.partitionBy("chrom").orderBy("run")).alias("start"))
    placed = s.withColumn("within", before(W.partitionBy("chrom", "run").orderBy("doc_id", "seq"))).join(starts, ["chrom", "run"])
    tiles = genome.tile_sequence(placed.select(F.struct("chrom", (F.col("start") + F.col("within")).alias("at")).alias("chrom"), "seq"), 512)
    moved = [(F.col(c) + F.col("chrom.at")).alias(c) for c in ("tile_start", "tile_end", "seq_start")]
    return tiles.select("chrom.chrom", *moved, "seq"), runs.groupBy("chrom").agg(F.sum("n").alias("size"))


@query("f8_genotype", f"SELECT doc_id, concat(substr(s, 1, 3), CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'G' END, substr(s, 5)) AS seq FROM (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') AS s FROM documents) x WHERE length(s) >= 10")
def f8(t):
    return seqs(t).filter(F.length("seq") >= 10).select("doc_id", Q.snv_by_genotype(F.col("seq"), F.lit(3), F.lit("A"), F.lit("G"), F.col("doc_id") % 2).alias("seq"))


@query("f10_mutated_positions", "SELECT doc_id, CAST(least(5, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS INT) AS changed FROM documents WHERE text IS NOT NULL")
def f10(t):
    s = seqs(t).filter("seq is not null")
    m = s.withColumn("m", Q.mutate(F.col("seq"), 5, F.col("doc_id")))
    return m.select("doc_id", F.size(F.filter(F.zip_with(F.split("seq", ""), F.split("m", ""), lambda a, b: a != b), lambda x: x)).alias("changed"))


@query("f11_shuffled_bases", f"""SELECT doc_id, substr(s, 1, 10) AS head, length(s) AS n, length(s) - length(replace(s, 'A', '')) AS n_a, length(s) - length(replace(s, 'C', '')) AS n_c, length(s) - length(replace(s, 'G', '')) AS n_g,
length(s) > 200 AS moved FROM (SELECT doc_id, {_SEQ} AS s FROM documents) x WHERE s IS NOT NULL""")
def f11(t):
    """All bases after the first ten are shuffled; a long sequence never comes out as it was."""
    s = seqs(t).filter("seq is not null").withColumn("m", Q.shuffle_window(F.col("seq"), 10, (1 << 31) - 2, F.col("doc_id")))
    held = lambda b: F.length("m") - F.length(F.replace("m", F.lit(b), F.lit("")))
    moved = F.when(F.length("seq") > 200, F.col("m") != F.col("seq")).otherwise(F.lit(False))
    return s.select("doc_id", F.substring("m", 1, 10).alias("head"), F.length("m").cast("long").alias("n"), *[held(b).cast("long").alias(f"n_{b.lower()}") for b in "ACG"], moved.alias("moved"))


@query("f13_iupac", "SELECT doc_id, len(regexp_extract_all(translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC'), 'C[ACT]G')) AS n FROM documents")
def f13(t):
    return seqs(t).select("doc_id", F.regexp_count("seq", F.lit(Q.iupac_pattern("CHG"))).cast("long").alias("n"))


@query("f17_strip_version", "SELECT gene_id, string_split(gene_id, '.')[1] AS gene FROM v_gene")
def f17(t):
    return t.v_gene.select("gene_id", Q.strip_version(F.col("gene_id")).alias("gene"))


@query("m8_top_match", """SELECT l_orderkey AS item, min(l_suppkey) AS motif_id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount + l_quantity / 1e4, l_suppkey) AS k FROM lineitem WHERE l_discount + l_quantity / 1e4 < 0.03 AND l_suppkey % 4 = l_orderkey % 4) x WHERE k = 1 GROUP BY 1""")
def m8(t):
    m = t.lineitem.select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("motif_id"), F.lit(-1).alias("offset"), (F.col("l_discount") + F.col("l_quantity") / 1e4).alias("p"), (F.col("l_orderkey") % 4).alias("item_cluster"), (F.col("l_suppkey") % 4).alias("motif_cluster"))
    return motif.top_matches(m, "item", 0.03).select("item", "motif_id")


@query("l10_with_replacement", """WITH u AS (SELECT cell, grp, (('0x' || substr(md5(concat(cell, '|', 7)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM v_cells),
k AS (SELECT unnest(range(0, 20)) AS k), c AS (SELECT k, sum(exp(-0.5) * pow(0.5, k) / factorial(CAST(k AS INT))) OVER (ORDER BY k) AS edge FROM k) SELECT cell, grp FROM u JOIN c ON c.edge <= u.u""")
def l10(t):
    return sampling.sample_with_replacement(t.v_cells, "cell", 0.5, 7).select("cell", "grp")


@query("j27_transition", """WITH tr AS (SELECT CAST(l_orderkey AS VARCHAR) AS src_id, CAST(l_suppkey AS VARCHAR) AS dst_id, sum(l_quantity) AS p FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER (PARTITION BY src_id ORDER BY dst_id ROWS UNBOUNDED PRECEDING) AS cdf, sum(p) OVER (PARTITION BY src_id) AS total, (('0x' || substr(md5(concat('a|b|', src_id, '|', 0)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM tr)
SELECT 'a' AS src_cond, 'b' AS dst_cond, src_id, min_by(dst_id, cdf) AS dst_id FROM c WHERE cdf > u * total GROUP BY src_id""")
def j27(t):
    tr = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("src_id"), F.col("l_suppkey").cast("string").alias("dst_id")).agg(F.sum("l_quantity").alias("p"))
    return sampling.transition_map(tr.select(F.lit("a").alias("src_cond"), F.lit("b").alias("dst_cond"), "src_id", "dst_id", "p"))
