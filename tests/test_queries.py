"""Every registered query that has DuckDB SQL gives the same rows; the others keep their invariants."""

from __future__ import annotations

import pytest
from compare import compare

from locuslake.plans import feature_queries, more_queries, operator_queries, queries, stream_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
QUERIES = {**queries.QUERIES, **stream_queries.QUERIES}
ORACLES = {**queries.ORACLES, **stream_queries.ORACLES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert compare(QUERIES[name](spark, SF), SF, ORACLES[name]) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_interval_joins_have_no_nested_loop(spark):
    for name in ("j1_overlap", "j2_containment", "j4_anti", "g2_merge", "a4_region_total"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_random_choices_do_not_depend_on_partitions(spark):
    from locuslake.operators import sampling

    rows = spark.range(500).selectExpr("id", "id % 3 AS g", "1.0 + id % 7 AS w")
    picks = [sorted(tuple(r) for r in sampling.weighted_sample(rows.repartition(n), "g", "id", "w", 20).select("g", "id").collect()) for n in (1, 7)]
    assert picks[0] == picks[1] and len(picks[0]) == 60


def test_background_peaks_are_alike(spark):
    got = QUERIES["a23_background"](spark, SF)
    assert got.groupBy("feature").count().filter("count <> 250").count() == 0


def test_metacells_and_groups_cover_all_cells(spark):
    cells = QUERIES["c4_metacells"](spark, SF)
    assert cells.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert cells.groupBy("metacell").count().filter("count >= 20").count() == 0
    groups = QUERIES["c1_categorical_groups"](spark, SF)
    assert groups.count() == spark.read.parquet(f"{SF}/customer.parquet").count()
    assert groups.groupBy("group").agg({"class": "count"}).count() >= 5


def test_copies_are_dealt_to_metacells(spark):
    """A third of all cells are equal; a cell is nearer to its metacell's than to others."""
    from pyspark.sql import functions as F

    from locuslake.operators import grouping

    cells = spark.range(600).selectExpr("id", "if(id % 3 = 0, 'hot', 'cold') AS g", "if(id % 3 = 0, array(1.0D, 2.0D), array(double(id % 20), double(id % 7))) AS v")
    got = grouping.metacells(cells, "g", "id", "v", 8)
    sizes = [r["count"] for r in got.groupBy("metacell").count().collect()]
    assert sum(sizes) == 600 and max(sizes) < 16 and min(sizes) >= 1
    spread = lambda x: x.agg((F.sum("a") + F.sum("b")).alias("s")).first()["s"]
    cold = got.filter("g = 'cold'").withColumns({"x": F.get("v", F.lit(0)), "y": F.get("v", F.lit(1))})
    within = spread(cold.groupBy("metacell").agg((F.var_pop("x") * F.count("*")).alias("a"), (F.var_pop("y") * F.count("*")).alias("b")))
    assert within < 0.25 * spread(cold.groupBy("g").agg((F.var_pop("x") * F.count("*")).alias("a"), (F.var_pop("y") * F.count("*")).alias("b")))
    assert grouping.metacells(cells.limit(0), "g", "id", "v", 8).count() == 0


def test_background_draws_against_weights(spark):
    """How often each bin is drawn against the Gaussian weights, on a small table."""
    import numpy as np

    from locuslake.operators import deviation

    r = np.random.default_rng(0)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.normal(0, 1, (60, 2)))]
    peaks = spark.createDataFrame(rows, "feature long, log_depth double, gc double")
    g = deviation.grid_bins(deviation.whiten(peaks, "log_depth", "gc"), 4).toPandas().set_index("feature")
    got = deviation.background_peaks(peaks, 3000, bins=4, width=0.8).toPandas()
    held = g.groupby("bin").agg(n=("wx", "size"), x=("wx", "mean"), y=("wy", "mean"))
    assert got.groupby("feature").size().eq(3000).all()
    for f in (0, 1, 2):
        me = held.loc[g.loc[f, "bin"]]
        w = np.exp(-((held["x"] - me["x"]) ** 2 + (held["y"] - me["y"]) ** 2) / (2 * 0.8**2)) * held["n"]
        found = got[got["feature"] == f]["bg_feature"].map(g["bin"]).value_counts(normalize=True).reindex(held.index, fill_value=0)
        assert np.abs(found - w / w.sum()).max() < 0.04


def test_regions_without_tiles_are_unknown(spark):
    from locuslake.operators import genome

    tiles = genome.tile_sequence(spark.createDataFrame([("c", "ACGTACGTAC")], "chrom string, seq string"), 4)
    regions = spark.createDataFrame([("a", "c", 2, 7), ("b", "c", 8, 13), ("d", "x", 0, 3), ("e", "c", 5, 5), ("f", "c", 40, 42)], "name string, chrom string, start int, end int")
    assert {x["name"]: x["seq"] for x in genome.fetch(regions, tiles, width=4).collect()} == {"a": "GTACG", "b": "ACNNN", "d": "NNN", "e": "", "f": "NN"}


def test_a_long_interval_does_not_change_semi_joins(spark):
    from locuslake.operators import intervals

    a = spark.range(400).selectExpr("'c' AS chrom", "id * 500 AS start", "id * 500 + 300 + if(id % 50 = 0, 900000, 0) AS end", "id")
    b = spark.range(30).selectExpr("'c' AS chrom", "id * 7000 + 250 AS start", "id * 7000 + 310 AS end")
    want = {x["id"] for x in a.collect() if any(x["start"] < y["end"] and y["start"] < x["end"] for y in b.collect())}
    assert {x["id"] for x in intervals.overlapping(a, b).collect()} == want
    assert {x["id"] for x in intervals.not_overlapping(a, b).collect()} == set(range(400)) - want


def test_training_rows_against_brute_force(spark):
    """The registered query over the genome of all documents: every bin, sequence and place."""
    from collections import defaultdict

    t = queries.Tables(spark, SF)
    genome = defaultdict(str)
    for d in sorted(queries.seqs(t).collect()):
        genome[f"chr{d['doc_id'] % 7 + 1}"] += d["seq"] or ""
    groups = defaultdict(list)
    for m in t.v_members.collect():
        groups[m["row_id"]].append(m["pid"])
    totals, bins = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for c in t.v_cov.collect():
        for pid in groups[c["row_id"]]:
            totals[pid] += c["value"]
            start = c["bin"] * 100 // 200 * 200
            if start + 200 <= len(genome[c["chrom"]]):
                bins[(c["chrom"], start, pid)][c["bin"] - start // 100] += c["value"]
    place, at = {}, 0
    for chrom in sorted(genome):
        place[chrom], at = at, at + len(genome[chrom])
    want = {}
    for (chrom, start, pid), found in bins.items():
        values = [(b, pytest.approx(v * 1e6 / totals[pid])) for b, v in sorted(found.items())]
        want[(f"{chrom}:{start}-{start + 200}", pid)] = (values, genome[chrom][start : start + 200], place[chrom] + start, place[chrom] + start + 200)
    got = {(r["name"], r["pid"]): ([tuple(b) for b in r["bins"]], r["seq"], r["gstart"], r["gend"]) for r in QUERIES["c9_training_rows"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[k] == want[k] for k in want)


@pytest.mark.parametrize("name", ["t1_running_corr", "t2_moving_state", "t5_tumbling", "t5_sliding", "t5_sessions"])
def test_streams_are_read_back_from_files(spark, name):
    """No result stands in a table of the driver's memory."""
    out = QUERIES[name](spark, SF)
    assert out.inputFiles() and out.count() > 0
