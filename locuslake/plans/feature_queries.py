"""Queries of sources, motif models, masks and profiles that other queries only use in passing."""

from __future__ import annotations

from pyspark.sql import functions as F

from locuslake.operators import coverage, genome, intervals, masks, motif, sampling
from locuslake.operators.ordered import ordinals
from locuslake.plans import rows as P
from locuslake.plans.more_queries import dealt_genome, scratch
from locuslake.plans.operator_queries import _PWM, pwm_rows
from locuslake.plans.queries import _SEQ, query, r6, seqs
from locuslake.sources import files


@query("s2_regions", "SELECT chrom, st, en, CASE WHEN pid % 2 = 0 THEN name ELSE concat(chrom, ':', st, '-', en) END AS name FROM v_peak")
def s2(t):
    """Regions written as BED in the order of the genome, half of them without a name, and read back."""
    path = scratch(t, "bed")
    t.v_peak.select("chrom", "start", "end", F.when(F.col("pid") % 2 == 0, F.col("name")).alias("name")).write.csv(path, sep="\t")
    return files.read_bed(t.spark, path).select("chrom", "start", "end", "name")


@query("s14_gtf", "SELECT chrom, 'gene' AS feature_type, st, en, strand, gene_id, gene_name, concat('gene_id=', gene_id, '|gene_name=', gene_name, '|pk=', pk) AS attributes FROM v_gene")
def s14(t):
    """Genes written as GTF and read back with all their attributes."""
    path = scratch(t, "gtf")
    g = t.v_gene
    attribute = F.format_string('gene_id "%s"; gene_name "%s"; pk "%s";', "gene_id", "gene_name", F.col("pk").cast("string"))
    g.select("chrom", F.lit("x"), F.lit("gene"), F.col("start") + 1, "end", F.lit("."), "strand", F.lit("."), attribute).write.option("quote", "").csv(path, sep="\t")
    columns = ["chrom", "feature_type", "start", "end", "strand", "gene_id", "gene_name", F.array_join("attributes", "|").alias("attributes")]
    return files.read_gtf(t.spark, path).select(*columns)


@query("s16_motif_file", f"WITH {_PWM} SELECT concat('M', motif_id) AS motif_id, concat('name', motif_id) AS name, CAST(row_number() OVER (PARTITION BY motif_id ORDER BY pos) - 1 AS INT) AS pos, round(a, 6) AS a, round(c, 6) AS c, round(g, 6) AS g, round(t, 6) AS t FROM pwm")
def s16(t):
    """Every motif written as four rows of a text file, in several files, and read back."""
    path = scratch(t, "pfm")
    row = lambda b: F.concat(F.lit(f"{b.upper()} [ "), F.array_join(F.transform(F.col("x"), lambda p: p[b].cast("string")), " "), F.lit(" ]"))
    m = pwm_rows(t).groupBy("motif_id").agg(F.array_sort(F.collect_list(F.struct("pos", *"acgt"))).alias("x"))
    m.select(F.concat_ws("\n", F.format_string(">M%d name%d", "motif_id", "motif_id"), *[row(b) for b in "acgt"])).repartition(4).write.text(path)
    return files.read_motifs(t.spark, path).select("motif_id", "name", "pos", *[r6(b).alias(b) for b in "acgt"])


@query("m1_log_odds", f"WITH {_PWM} SELECT motif_id, pos, round(log2((a + 0.2) / (a + c + g + t + 0.8) / 0.25), 6) AS a, round(log2((c + 0.2) / (a + c + g + t + 0.8) / 0.25), 6) AS c, round(log2((g + 0.2) / (a + c + g + t + 0.8) / 0.25), 6) AS g, round(log2((t + 0.2) / (a + c + g + t + 0.8) / 0.25), 6) AS t FROM pwm")
def m1(t):
    return motif.log_odds_rows(pwm_rows(t)).select("motif_id", "pos", *[r6(b).alias(b) for b in "acgt"])


@query("m2_threshold")
def m2(t):
    """Tested against the scores of all words: a convolution of rounded scores has no SQL form."""
    return motif.thresholds(pwm_rows(t), 1e-3).select("motif_id", "length", r6("threshold").alias("threshold"))


@query("f15_trim", f"""WITH {_PWM}, e AS (SELECT *, 2 - list_sum(list_transform([a, c, g, t], lambda x: CASE WHEN x > 0 THEN -x * log2(x) ELSE 0 END)) AS i FROM pwm),
r AS (SELECT motif_id, pos, round(sum(i) OVER w, 9) AS s, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY motif_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
f AS (SELECT motif_id, arg_min(pos, (-s, pos)) AS first FROM (SELECT *, max(n) OVER (PARTITION BY motif_id) AS m FROM r) WHERE n = m GROUP BY 1)
SELECT motif_id, pos - first AS pos, round(a, 6) AS a FROM pwm JOIN f USING (motif_id) WHERE pos >= first AND pos < first + 3""")
def f15(t):
    return motif.trim(pwm_rows(t), 3).select("motif_id", "pos", r6("a").alias("a"))


@query("p17_bit_mask", """WITH b AS (SELECT DISTINCT chrom, strand, unnest(range(st // 20, (en - 1) // 20 + 1)) AS bin FROM v_gene WHERE en > st), u AS (SELECT DISTINCT chrom, bin FROM b)
SELECT chrom, strand, CAST(bin // 32768 + 1 AS BIGINT) AS bucket, count(*) AS n FROM b GROUP BY 1, 2, 3 UNION ALL SELECT chrom, 'any', CAST(bin // 32768 + 1 AS BIGINT), count(*) FROM u GROUP BY 1, 3""")
def p17(t):
    """Genes of each strand as bits of 20 bases, and those of either."""
    of_strand = masks.bit_masks(t.v_gene, ["chrom", "strand"], resolution=20)
    either = masks.united(of_strand, ["chrom"]).withColumn("strand", F.lit("any"))
    return of_strand.unionByName(either).select("chrom", "strand", "bucket", F.bitmap_count("mask").alias("n"))


@query("l7_shuffle", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY md5(concat(p_partkey, '|', 7)), p_partkey) AS INT) AS place FROM part")
def l7(t):
    shuffled = sampling.shuffle(t.part.select("p_partkey"), "p_partkey", 7).select("p_partkey", F.monotonically_increasing_id().alias("id"))
    return ordinals(shuffled, ["id"], "place").select("p_partkey", (F.col("place") + 1).cast("int").alias("place"))


@query("a30_end_profile", f"""WITH s AS (SELECT doc_id, {_SEQ} AS s FROM documents), r AS (SELECT doc_id, s, length(s) // 4 AS st, length(s) * 3 // 4 AS en FROM s WHERE length(s) >= 100),
e AS (SELECT s, 'start' AS "end", st AS p FROM r UNION ALL SELECT s, 'end', en FROM r), b AS (SELECT "end", k - 20 AS "offset", substr(s, CAST(p - 20 + k + 1 AS INT), 1) AS base FROM e, (SELECT unnest(range(0, 40)) AS k) WHERE p >= 20),
c AS (SELECT "end", "offset", base, count(*) AS n FROM b WHERE base <> '' GROUP BY 1, 2, 3) SELECT "end" AS side, CAST("offset" AS INT) AS "offset", base, round(n / sum(n) OVER (PARTITION BY "end", "offset"), 6) AS share FROM c""")
def a30(t):
    """The middle half of each sequence as a fragment."""
    whole = seqs(t).filter("length(seq) >= 100").withColumn("chrom", F.col("doc_id").cast("string"))
    n = F.length("seq").cast("long")
    fragments = whole.select("chrom", F.floor(n / 4).alias("start"), F.floor(n * 3 / 4).alias("end"))
    profile = genome.end_profile(fragments, genome.tile_sequence(whole, 512))
    return profile.select(F.col("end").alias("side"), F.col("offset").cast("int").alias("offset"), "base", r6("share").alias("share"))


@query("a46_hit_correlation", f"""WITH {_PWM}, z AS (SELECT motif_id, max(pos) AS last FROM pwm GROUP BY 1), h AS (SELECT motif_id, CASE WHEN motif_id % 2 = 0 THEN '-' ELSE '+' END AS strand FROM z),
v AS (SELECT motif_id, pos, s % 11 - 5.0 AS va, s % 7 - 3.0 AS vc, q % 5 - 2.0 AS vg, q % 3 - 1.0 AS vt FROM w),
j AS (SELECT p.motif_id, strand, p.a, p.c, p.g, p.t, v.* EXCLUDE (motif_id, pos) FROM pwm p JOIN z USING (motif_id) JOIN h USING (motif_id) LEFT JOIN v ON v.motif_id = p.motif_id AND v.pos = CASE WHEN strand = '-' THEN last - p.pos ELSE p.pos END),
x AS (SELECT motif_id, a AS m, coalesce(CASE WHEN strand = '-' THEN vt ELSE va END, 0) AS x FROM j UNION ALL SELECT motif_id, c, coalesce(CASE WHEN strand = '-' THEN vg ELSE vc END, 0) FROM j
  UNION ALL SELECT motif_id, g, coalesce(CASE WHEN strand = '-' THEN vc ELSE vg END, 0) FROM j UNION ALL SELECT motif_id, t, coalesce(CASE WHEN strand = '-' THEN va ELSE vt END, 0) FROM j)
SELECT motif_id AS hit, round(CASE WHEN var_pop(x) < 1e-12 OR var_pop(m) < 1e-12 THEN NULL ELSE corr(m, x) * sign(sum(x)) END, 5) AS r FROM x GROUP BY 1""")
def a46(t):
    """A hit of every motif, every second one on the minus strand."""
    w = t.lineitem.groupBy(F.col("l_orderkey").alias("hit"), F.col("l_linenumber").alias("pos")).agg(F.max("l_suppkey").alias("s"), F.max("l_partkey").alias("q"))
    s, q = F.col("s"), F.col("q")
    values = w.select("hit", "pos", (s % 11 - 5.0).alias("a"), (s % 7 - 3.0).alias("c"), (q % 5 - 2.0).alias("g"), (q % 3 - 1.0).alias("t"))
    hits = w.select("hit").distinct().select("hit", F.col("hit").alias("motif_id"), F.when(F.col("hit") % 2 == 0, "-").otherwise("+").alias("strand"))
    return motif.hit_correlation(hits, values, pwm_rows(t)).select("hit", F.round("r", 5).alias("r"))


@query("c8_multi_dataset_rows", """WITH d AS (SELECT * FROM (VALUES ('a', 0, 4), ('b', 1, 2)) x(dataset, ordinal, draws)),
g AS (SELECT CASE WHEN row_id % 2 = 0 THEN 'a' ELSE 'b' END AS dataset, pid, chrom, bin, sum(value) AS v FROM v_cov JOIN v_members USING (row_id) GROUP BY 1, 2, 3, 4),
n AS (SELECT dataset, pid, sum(v) AS n FROM g GROUP BY 1, 2),
u AS (SELECT n.dataset, v_peak.name, n.pid, (('0x' || substr(md5(concat(v_peak.name, '|', n.pid, '|', 0)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM v_peak, n),
w AS (SELECT *, row_number() OVER (PARTITION BY dataset, name ORDER BY -ln(u), pid) AS k FROM u),
r AS (SELECT g.dataset, p.name, g.pid, p.en - p.st AS size, g.v FROM g JOIN v_peak p ON p.chrom = g.chrom AND g.bin * 100 < p.en AND p.st < (g.bin + 1) * 100)
SELECT r.dataset, CAST(d.ordinal AS INT) AS ordinal, r.name, r.pid, CAST(max(size) AS INT) AS n_bases, count(*) AS n_bins, round(sum(v / (n / 1e6)), 4) AS total
FROM r JOIN n USING (dataset, pid) JOIN d USING (dataset) JOIN w ON w.dataset = r.dataset AND w.name = r.name AND w.pid = r.pid AND k <= draws GROUP BY 1, 2, 3, 4""")
def c8(t):
    """Cells of even and of odd number as two datasets, of which the first weighs twice the second."""
    tiles, sizes = dealt_genome(seqs(t))
    regions = t.v_peak.select("chrom", "start", "end", "name")
    offsets = intervals.chrom_offsets(t.v_chrom)

    def dataset(odd: int) -> dict:
        store = t.v_cov.filter(F.col("row_id") % 2 == odd)
        depths = coverage.depth(coverage.merge_rows(store, t.v_members, ["chrom", "bin"]), 1e6)
        return {"regions": regions, "store": store, "members": t.v_members, "depths": depths, "tiles": tiles, "offsets": offsets, "resolution": 100}

    weights = t.spark.createDataFrame([("a", 1.0), ("b", 0.5)], "key string, weight double")
    rows = P.multi_dataset_rows({"a": dataset(0), "b": dataset(1)}, weights, 4)
    total = F.aggregate("bins", F.lit(0.0), lambda s, x: s + x["value"])
    return rows.select("dataset", "ordinal", "name", "pid", F.length("seq").alias("n_bases"), F.size("bins").cast("long").alias("n_bins"), F.round(total, 4).alias("total"))


@query("g8_meta_regions", """WITH b AS (SELECT *, CASE WHEN st // 2000 = en // 2000 OR 2000 - st % 2000 >= en % 2000 THEN st // 2000 ELSE en // 2000 END AS mb FROM v_peak),
m AS (SELECT chrom, mb, min(st) AS ms, max(en) AS me FROM b GROUP BY 1, 2), i AS (SELECT chrom, pos, CAST(sum(n) AS BIGINT) AS value FROM v_ins GROUP BY 1, 2)
SELECT DISTINCT concat(m.chrom, ':', ms, '-', me) AS meta, i.pos - ms AS "offset", i.value FROM b JOIN m USING (chrom, mb) JOIN i ON i.chrom = b.chrom AND i.pos >= b.st AND i.pos < b.en""")
def g8(t):
    return coverage.meta_signal(t.v_peak, t.v_ins, 2000)


@query("g8_meta_places", """WITH b AS (SELECT *, CASE WHEN st // 2000 = en // 2000 OR 2000 - st % 2000 >= en % 2000 THEN st // 2000 ELSE en // 2000 END AS mb FROM v_peak), m AS (SELECT chrom, mb, min(st) AS ms, max(en) AS me FROM b GROUP BY 1, 2)
SELECT name, concat(chrom, ':', ms, '-', me) AS meta, st - ms AS rel_start, en - ms AS rel_end FROM b JOIN m USING (chrom, mb)""")
def g8b(t):
    return coverage.meta_regions(t.v_peak, 2000).select("name", "meta", "rel_start", "rel_end")


@query("u6_motif_names", "SELECT p_partkey, concat('MA', p_size) AS motif FROM part")
def u6(t):
    header = F.concat(F.lit("MA"), "p_size", F.when(F.col("p_partkey") % 2 == 0, "\t").otherwise(" "), "p_name")
    return t.part.select("p_partkey", motif.name_of(header).alias("motif"))
