"""Queries of operators that others only use: stores, matrices, motif models, covers, draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from locuslake.operators import checks, coverage, deviation, genome, grouping, intervals, motif, pseudobulk, structure
from locuslake.operators.ordered import ordinals
from locuslake.plans import rows as P
from locuslake.plans.more_queries import scratch
from locuslake.plans.queries import _ISLANDS, _SEQ, query, r6, seqs
from locuslake.sources import blob_source, files

# --- stores and matrices -----------------------------------------------------------------------------------------------

@query("s1_chrom_sizes", "SELECT chrom, size FROM v_chrom WHERE chrom <> 'chrUn_1'")
def s1(t):
    path = scratch(t, "sizes")
    t.v_chrom.unionByName(t.v_chrom.limit(1).withColumn("chrom", F.lit("chrUn_1"))).write.csv(path, sep="\t")
    return files.read_chrom_sizes(t.spark, path)


@query("s4_fold_scan", "SELECT chrom, bin, row_id, value FROM v_cov WHERE bin % 8 IN (0, 3)")
def s4(t):
    path = scratch(t, "folds")
    coverage.write_folds(t.v_cov.withColumn("fold", F.concat(F.lit("fold"), F.col("bin") % 8)), path)
    return coverage.read_folds(t.spark, path, ["fold0", "fold3"], []).select("chrom", "bin", "row_id", "value")


@query("s4_fold_fallback", "SELECT chrom, bin, row_id, value FROM v_cov WHERE chrom IN ('chr2', 'chr5')")
def s4b(t):
    path = scratch(t, "chroms")
    t.v_cov.write.partitionBy("chrom").parquet(path)
    return coverage.read_folds(t.spark, path, ["fold0"], ["chr2", "chr5"]).select("chrom", "bin", "row_id", "value")


@query("s7_manifest", "SELECT pid, name, chrom, st, en, 1 AS places FROM v_peak WHERE pid % 3 = 0")
def s7(t):
    """The rows read back at the places that the manifest names."""
    path = scratch(t, "peaks")
    t.v_peak.repartitionByRange(8, "chrom", "start").write.parquet(path)
    places = coverage.manifest(t.spark, path, "pid").filter("pid % 3 = 0")
    counted = places.groupBy("pid").agg(F.countDistinct("file", "row").cast("int").alias("places"))
    return coverage.rows_at(t.spark, path, places).join(counted, "pid").select("pid", "name", "chrom", "start", "end", "places")


@query("w12_row_order", "SELECT CAST(row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS BIGINT) AS k, name, n FROM (SELECT p_partkey, p_size, concat('p', p_partkey) AS name, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2, 3) x")
def w12(t):
    """Rows as they were stored, after a join has dealt them anew."""
    path = scratch(t, "ordered")
    t.part.select("p_partkey", "p_size").repartitionByRange(6, F.desc("p_size"), "p_partkey").sortWithinPartitions(F.desc("p_size"), "p_partkey").write.parquet(path)
    read = coverage.read_in_order(t.spark, path)
    counted = read.join(t.lineitem, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("row_order", "p_partkey").agg(F.count("l_partkey").alias("n"))
    # the order that the rows come in is part of the result
    return coverage.in_row_order(counted).select(F.monotonically_increasing_id().alias("id"), F.concat(F.lit("p"), "p_partkey").alias("name"), "n").transform(lambda x: ordinals(x, ["id"], "k")).select("k", "name", "n")


@query("s8_sidecars", "SELECT prefix, row_id, name, value AS resolution FROM (SELECT concat('p', s_suppkey % 2) AS prefix, s_suppkey AS row_id, s_name AS name FROM supplier) x, (SELECT '100' AS value) y WHERE prefix = 'p1'")
def s8(t):
    path = scratch(t, "sidecars")
    names = t.supplier.select(F.lit("d").alias("dataset"), F.concat(F.lit("p"), F.col("s_suppkey") % 2).alias("prefix"), F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("name"))
    files.write_sidecars(path, names, t.spark.createDataFrame([("d", "resolution", "100"), ("d", "genome", "g")], "dataset string, key string, value string"))
    config = files.read_config(t.spark, path).filter("key = 'resolution'").select("dataset", F.col("value").alias("resolution"))
    return files.read_row_names(t.spark, path, "p1").join(config, "dataset").select("prefix", "row_id", "name", "resolution")


@query("s11_methylation", """WITH m AS (SELECT concat('chr', l_linenumber) AS chrom, l_partkey * 10 + l_suppkey AS pos, CASE l_suppkey % 3 WHEN 0 THEN 'CGT' WHEN 1 THEN 'CAG' ELSE 'CTT' END AS context, l_suppkey % 5 AS mc, l_suppkey % 5 + 3 AS cov FROM lineitem)
SELECT chrom, (pos - 1) // 100 AS bin, 'CH_mc' AS prefix, CAST(sum(mc) AS BIGINT) AS value FROM m WHERE context <> 'CGT' GROUP BY 1, 2 UNION ALL SELECT chrom, (pos - 1) // 100, 'CH_cov', CAST(sum(cov) AS BIGINT) FROM m WHERE context <> 'CGT' GROUP BY 1, 2""")
def s11(t):
    path = scratch(t, "calls")
    s = F.col("l_suppkey")
    context = F.when(s % 3 == 0, "CGT").when(s % 3 == 1, "CAG").otherwise("CTT")
    t.lineitem.select(F.concat(F.lit("chr"), "l_linenumber").alias("chrom"), (F.col("l_partkey") * 10 + s).alias("pos"), F.lit("+").alias("strand"), context.alias("context"), s % 5, s % 5 + 3, F.lit(1)).toDF("chrom", "pos", "strand", "context", "mc", "cov", "flag").write.csv(path, sep="\t")
    return files.read_methylation(t.spark, path, "CH", 100).select("chrom", "bin", "prefix", "value")


@query("s12_cell_matrix", "SELECT cell, chrom, pos, CAST(n AS BIGINT) AS n FROM v_ins WHERE chrom IN ('chr1', 'chr3') AND cell % 2 = 0")
def s12(t):
    even = t.supplier.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("cell"))
    return coverage.cell_matrix(t.v_ins, even, ["chr1", "chr3", "chrUn_1"])


@query("s13_group_matrix", "SELECT pid, chrom, pos, CAST(sum(n) AS BIGINT) AS n FROM v_ins JOIN v_members ON row_id = cell WHERE pid IN ('g1', 'g7') AND chrom = 'chr2' GROUP BY 1, 2, 3")
def s13(t):
    merged = coverage.merge_rows(t.v_ins.withColumnsRenamed({"cell": "row_id", "n": "value"}), t.v_members, ["chrom", "pos"]).withColumnRenamed("value", "n")
    path = scratch(t, "merged")
    merged.write.partitionBy("chrom").parquet(path)
    return coverage.group_matrix(t.spark.read.parquet(path), ["g1", "g7"], ["chr2"]).select("pid", "chrom", "pos", "n")


@query("s19_gene_columns", "SELECT concat('g', cell % 10) AS pid, feature AS gene_id, CAST(sum(n) AS BIGINT) AS value FROM v_counts WHERE feature IN (3, 5, 8) GROUP BY 1, 2")
def s19(t):
    v = t.v_counts.groupBy(F.concat(F.lit("g"), F.col("cell") % 10).alias("pid"), F.col("feature").alias("gene_id")).agg(F.sum("n").alias("value"))
    return genome.gene_values(v.select("pid", "gene_id"), v, [3, 5, 8]).filter("value is not null")


@query("s22_binding_over", "SELECT vec_id FROM embeddings WHERE list_max(embedding) > 0.25")
def s22(t):
    return motif.bound_over(t.embeddings.withColumnRenamed("embedding", "scores"), 0.25).select("vec_id")


@query("s26_select_regions", """WITH o AS (SELECT *, row_number() OVER (ORDER BY chrom, st, pid) - 1 AS k, count(*) OVER () AS n FROM v_peak)
SELECT 'slice' AS how, name FROM o WHERE k >= 5 AND k < n - 10 AND (k - 5) % 3 = 0 UNION ALL SELECT 'last', name FROM o WHERE k = n - 1 UNION ALL SELECT 'names', name FROM o WHERE pid IN (2, 7)""")
def s26(t):
    store = coverage.numbered_regions(t.v_peak, ["chrom", "start", "pid"])
    got = {"slice": slice(5, -10, 3), "last": -1, "names": ["p2", "p7"]}
    return checks.union({k: coverage.select_regions(store, w).select("name") for k, w in got.items()}, "how")


@query("s15_fasta_tiles", f"""WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS chrom, {_SEQ} AS s FROM documents), t AS (SELECT chrom, s, unnest(range(0, length(s), 500)) AS tile_start FROM s WHERE length(s) > 0)
SELECT chrom, tile_start, least(tile_start + 500, length(s)) AS tile_end, greatest(tile_start - 20, 0) AS seq_start, substr(s, CAST(greatest(tile_start - 20, 0) + 1 AS INT), CAST(tile_start + 520 - greatest(tile_start - 20, 0) AS INT)) AS seq FROM t""")
def s15(t):
    """Every document a record, in several files, read back in splits."""
    path = scratch(t, "fasta")
    wrapped = F.regexp_replace("seq", "(.{60})", "$1\n")
    seqs(t).select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" a sequence\n"), wrapped)).repartition(6).write.text(path)
    return files.read_fasta(t.spark, path, 500, 20)


@query("p39_legal_columns", "SELECT p_partkey, p_size FROM part")
def p39(t):
    setting = checks.merge_config({"key": checks.REQUIRED, "size": "p_size"}, {"key": "p_partkey"})
    return checks.require_columns(t.part, {"p_partkey": "bigint", "p_size": "int"}).select(*setting.values())


@query("u4_functions", """WITH m AS (SELECT peak, pid, sqrt(CASE WHEN ypred > 5 THEN ytrue ELSE 0 END) AS value FROM v_eval) SELECT peak, pid, round(value, 6) AS value FROM m QUALIFY row_number() OVER (PARTITION BY pid ORDER BY value DESC, peak) <= 20""")
def u4(t):
    rows = t.v_eval.withColumn("value", F.col("ytrue"))
    out = P.shaped(rows, mask_fn=lambda r: r["ypred"] > 5, channel_fn=F.sqrt, rank_fn=lambda r: [r["value"].desc(), r["peak"]], keep=20)
    return out.select("peak", "pid", r6("value").alias("value"))


@query("u5_source", "SELECT 'p' AS prefix, chrom, bin, row_id, value FROM v_cov")
def u5(t):
    files.register_reader("prefixed", lambda spark, options: options["rows"].withColumn("prefix", F.lit(options["prefix"])))
    return files.read_source(t.spark, "prefixed", rows=t.v_cov, prefix="p")


@query("u5_blob_source", "SELECT 'cov' AS prefix, chrom, bin, row_id, CAST(value AS DOUBLE) AS value FROM v_cov")
def u5b(t):
    """All coverage written as blobs and read through the data source."""
    path = scratch(t, "blobs")
    blob_source.write_blobs(t.v_cov, path, "cov", 100, 500, 6)
    return blob_source.read_blobs(t.spark, path, "cov", 100).drop("region")


@query("s3b_blob_regions", "SELECT concat(chrom, ':', bin // 500 * 50000, '-', (bin // 500 + 1) * 50000) AS region, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM v_cov WHERE chrom = 'chr2' OR (chrom = 'chr5' AND bin < 500) GROUP BY 1")
def s3b(t):
    """Blobs of one chromosome and of one region alone."""
    path = scratch(t, "blobs")
    blob_source.write_blobs(t.v_cov, path, "cov", 100, 500, 6)
    wanted = blob_source.read_blobs(t.spark, path, "cov", 100).filter("chrom = 'chr2'").unionByName(blob_source.read_blobs(t.spark, path, "cov", 100).filter("region = 'chr5:0-50000'"))
    return wanted.groupBy("region").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


# --- covers, draws, features -----------------------------------------------------------------------------------------

_COVER = """, r AS (SELECT *, row_number() OVER (PARTITION BY chrom, cluster ORDER BY st, en) AS k FROM c),
nx AS (SELECT a.chrom, a.cluster, a.k, greatest(max(b.k), a.k + 1) AS nk FROM r a JOIN r b ON a.chrom = b.chrom AND a.cluster = b.cluster AND b.st < a.en GROUP BY 1, 2, 3),
walk AS (SELECT chrom, cluster, k FROM r WHERE k = 1 UNION ALL SELECT r.chrom, r.cluster, r.k FROM walk w JOIN nx ON nx.chrom = w.chrom AND nx.cluster = w.cluster AND nx.k = w.k JOIN r ON r.chrom = nx.chrom AND r.cluster = nx.cluster AND r.k = nx.nk)
SELECT r.pid, r.chrom, r.st, r.en FROM walk w JOIN r ON r.chrom = w.chrom AND r.cluster = w.cluster AND r.k = w.k"""


@query("g5_minimum_cover", _ISLANDS.replace("WITH o AS", "WITH RECURSIVE o AS", 1) + _COVER)
def g5(t):
    return intervals.minimum_cover(t.v_peak).select("pid", "chrom", "start", "end")


@query("g9_covered_positions", "SELECT DISTINCT chrom, pos, 1 AS value FROM v_ins i WHERE EXISTS (SELECT 1 FROM v_peak p WHERE p.chrom = i.chrom AND i.pos >= p.st AND i.pos < p.en)")
def g9(t):
    return intervals.covered_positions(t.v_ins, t.v_peak)


@query("c11_evaluation_regions", "SELECT name FROM v_peak WHERE pid % 3 = 0")
def c11(t):
    return P.evaluation_regions(t.v_peak.withColumn("role", F.when(F.col("pid") % 3 == 0, "test").otherwise("train")), "test", windows=False).select("name")


@query("c10_region_dataset", f"SELECT doc_id, chrom, st, en, substr({_SEQ}, 1, CAST(length({_SEQ}) // 2 AS INT)) AS seq FROM (SELECT *, CAST(doc_id AS VARCHAR) AS chrom, 0 AS st, length({_SEQ}) // 2 AS en FROM documents WHERE length({_SEQ}) > 0) x")
def c10(t):
    whole = seqs(t).filter(F.length("seq") > 0).withColumn("chrom", F.col("doc_id").cast("string"))
    regions = whole.select("chrom", F.lit(0).alias("start"), F.floor(F.length("seq") / 2).cast("int").alias("end"), F.col("doc_id").alias("name"))
    return P.region_dataset(regions, genome.tile_sequence(whole, 512)).select(F.col("name").alias("doc_id"), "chrom", "start", "end", "seq")


@query("j12_draws", """WITH u AS (SELECT name, m.pid, (('0x' || substr(md5(concat(name, '|', m.pid, '|', 0)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u, CAST(substr(m.pid, 2) AS INT) % 3 + 1.0 AS w FROM v_peak, (SELECT DISTINCT pid FROM v_members) m)
SELECT name, pid, CAST(row_number() OVER (PARTITION BY name ORDER BY -ln(u) / w, pid) AS INT) AS rank FROM u QUALIFY rank <= 3""")
def j12(t):
    p = t.v_members.select("pid").distinct().withColumn("sample_weight", F.substring("pid", 2, 9).cast("int") % 3 + F.lit(1.0))
    return pseudobulk.draw(t.v_peak, p, 3)


@query("j21_grid", "SELECT p_partkey, CAST(round((p_size - lo) / (hi - lo) * 6) * 7 + round((len - l0) / (l1 - l0) * 6) AS INT) AS bin FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, CAST(length(p_name) AS DOUBLE) AS len FROM part) p, (SELECT min(p_size) AS lo, max(p_size) AS hi, min(length(p_name)) AS l0, greatest(max(length(p_name)), min(length(p_name)) + 1) AS l1 FROM part) e")
def j21(t):
    return deviation.grid_bins(t.part.select("p_partkey", F.col("p_size").cast("double").alias("wx"), F.length("p_name").cast("double").alias("wy")), 7).select("p_partkey", "bin")


@query("j25_exons_and_introns", """WITH e AS (SELECT l_orderkey AS gene_id, l_linenumber AS transcript_id, min(l_partkey * 100) AS st, min(l_partkey * 100) + 50 AS en, l_suppkey AS s FROM lineitem GROUP BY 1, 2, 5),
n AS (SELECT *, lead(st) OVER (PARTITION BY gene_id, transcript_id ORDER BY st, en) AS nx, row_number() OVER (PARTITION BY gene_id, transcript_id ORDER BY st, en) AS number FROM e) SELECT gene_id, concat(gene_id, '-', transcript_id) AS transcript_id, en AS st, nx AS en, CAST(number AS INT) AS number FROM n WHERE nx > en""")
def j25(t):
    e = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.min(F.col("l_partkey") * 100).alias("start"))
    f = e.select(F.col("l_orderkey").alias("gene_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transcript_id"), F.lit("chr1").alias("chrom"), "start", (F.col("start") + 50).alias("end"), F.lit("+").alias("strand"), F.lit("exon").alias("feature_type"))
    return genome.introns(f.unionByName(f.withColumn("feature_type", F.lit("CDS")))).select("gene_id", "transcript_id", "start", "end", "number")


@query("a21_expected_counts", """WITH k AS (SELECT feature FROM v_counts GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 50), v AS (SELECT * FROM v_counts JOIN k USING (feature))
SELECT cell, feature, round(c * f / t, 6) AS expected FROM (SELECT cell, sum(n) AS c FROM v GROUP BY 1) a, (SELECT feature, sum(n) AS f FROM v GROUP BY 1) b, (SELECT CAST(sum(n) AS DOUBLE) AS t FROM v) x""")
def a21(t):
    top = grouping.top_features(t.v_counts, "feature", "n", 0, 50).select("feature")
    return deviation.expected_counts(t.v_counts.join(top, "feature")).select("cell", "feature", r6("expected").alias("expected"))


@query("n9_whitening", """WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 37 AS DOUBLE) AS y FROM part), m AS (SELECT avg(x) AS ax, avg(y) AS ay, sqrt(var_samp(x)) AS a, covar_samp(x, y) / sqrt(var_samp(x)) AS b, var_samp(y) AS v FROM p)
SELECT p_partkey, round((x - ax) / a, 6) AS wx, round((y - ay - b * (x - ax) / a) / sqrt(v - b * b), 6) AS wy FROM p, m""")
def n9(t):
    p = t.part.select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 37).cast("double").alias("y"))
    return deviation.whiten(p, "x", "y").select("p_partkey", r6("wx").alias("wx"), r6("wy").alias("wy"))


@query("a40_residue_means", "SELECT l_returnflag AS structure, l_linestatus AS chain, l_suppkey AS residue_id, round(avg(l_quantity), 6) AS mean, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS ca FROM lineitem GROUP BY 1, 2, 3")
def a40(t):
    atoms = t.lineitem.select(F.col("l_returnflag").alias("structure"), F.col("l_linestatus").alias("chain"), F.col("l_suppkey").alias("residue_id"), F.when(F.col("l_linenumber") == 1, "CA").otherwise("N").alias("atom_name"), F.col("l_quantity").alias("plddt"))
    return structure.residue_means(atoms).withColumn("mean", r6("mean"))


# --- motif models ----------------------------------------------------------------------------------------------------

_PWM = "w AS (SELECT l_orderkey AS motif_id, l_linenumber AS pos, max(l_suppkey) AS s, max(l_partkey) AS q FROM lineitem GROUP BY 1, 2), n AS (SELECT *, 1.0 + s % 5 + s % 3 + s % 7 + q % 4 AS t FROM w), pwm AS (SELECT motif_id, pos, (s % 5) / t AS a, (s % 3) / t AS c, (s % 7) / t AS g, (1.0 + q % 4) / t AS t FROM n)"


def pwm_rows(t):
    """A motif for each order, a position for each line number."""
    w = t.lineitem.groupBy(F.col("l_orderkey").alias("motif_id"), F.col("l_linenumber").alias("pos")).agg(F.max("l_suppkey").alias("s"), F.max("l_partkey").alias("q"))
    total = F.lit(1.0) + F.col("s") % 5 + F.col("s") % 3 + F.col("s") % 7 + F.col("q") % 4
    return w.select("motif_id", "pos", (F.col("s") % 5 / total).alias("a"), (F.col("s") % 3 / total).alias("c"), (F.col("s") % 7 / total).alias("g"), ((1 + F.col("q") % 4) / total).alias("t"))


@query("a43_information", f"WITH {_PWM}, e AS (SELECT motif_id, pos, list_sum(list_transform([a, c, g, t], lambda x: CASE WHEN x > 0 THEN -x * log2(x) ELSE 0 END)) AS e FROM pwm) SELECT motif_id, pos, round(e, 6) AS entropy, round(2 - e, 6) AS information FROM e")
def a43(t):
    return motif.information(pwm_rows(t)).select("motif_id", "pos", r6("entropy").alias("entropy"), r6("information").alias("information"))


@query("f14_consensus", f"WITH {_PWM} SELECT motif_id, string_agg(CASE WHEN a >= c AND a >= g AND a >= t THEN 'A' WHEN c >= g AND c >= t THEN 'C' WHEN g >= t THEN 'G' ELSE 'T' END, '' ORDER BY pos) AS consensus FROM pwm GROUP BY 1")
def f14(t):
    return motif.consensus(pwm_rows(t))


@query("f18_contribution_trim", f"WITH {_PWM}, k AS (SELECT motif_id, min(pos) AS lo, max(pos) AS hi FROM pwm WHERE a >= 0.1 AND abs(g - c) >= 0.2 GROUP BY 1) SELECT motif_id, pos FROM pwm JOIN k USING (motif_id) WHERE pos BETWEEN lo AND hi")
def f18(t):
    p = pwm_rows(t).select("motif_id", "pos", F.col("a").alias("information"), (F.col("g") - F.col("c")).alias("contribution"))
    return motif.trim_by_contribution(p, 0.1, 0.2).select("motif_id", "pos")


@query("m4_best_hits", "SELECT l_orderkey AS name, l_suppkey % 5 AS motif_id, l_quantity AS score, l_linestatus AS strand, l_partkey AS st, l_partkey + 8 AS en FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 5 ORDER BY l_quantity DESC, l_partkey, l_linestatus) = 1")
def m4(t):
    h = t.lineitem.select(F.col("l_orderkey").alias("name"), (F.col("l_suppkey") % 5).alias("motif_id"), F.col("l_quantity").alias("score"), F.col("l_linestatus").alias("strand"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 8).alias("end"))
    return motif.best_hits(h)


@query("m6_genome_scan", f"""WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS chrom, {_SEQ} AS s FROM documents), p AS (SELECT chrom, s, unnest(range(0, length(s) - 7)) AS i FROM s WHERE length(s) >= 8)
SELECT chrom, 'b' AS motif_id, CASE WHEN substr(s, CAST(i + 1 AS INT), 8) = 'GGCATTAC' THEN '+' ELSE '-' END AS strand, i AS st, i + 8 AS en FROM p WHERE substr(s, CAST(i + 1 AS INT), 8) IN ('GGCATTAC', 'GTAATGCC')""")
def m6(t):
    pwm = t.spark.createDataFrame([("b", k, *[10.0 if b == c else 0.0 for b in "ACGT"]) for k, c in enumerate("GGCATTAC")], "motif_id string, pos int, a double, c double, g double, t double")
    tiles = genome.tile_sequence(seqs(t).filter(F.length("seq") > 0).select(F.col("doc_id").cast("string").alias("chrom"), "seq"), 400, 7)
    return motif.genome_scan(tiles, motif.models(pwm, 1e-4)).drop("score")


@query("m9_clusters", "SELECT l_orderkey * 10 + l_linenumber AS item, l_suppkey % 4 AS cluster FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey % 4, sign(l_discount - 0.05) ORDER BY md5(concat(l_orderkey * 10 + l_linenumber, '|', 0)), l_orderkey * 10 + l_linenumber, l_suppkey) <= 40")
def m9(t):
    i = t.lineitem.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.col("l_suppkey").alias("motif_id"), (F.col("l_discount") - 0.05).alias("contribution")).agg(F.count("*").alias("n"))
    clusters = t.supplier.select(F.col("s_suppkey").alias("motif_id"), (F.col("s_suppkey") % 4).alias("cluster"))
    return motif.by_cluster_and_sign(i, clusters, 40).select("item", "cluster")
