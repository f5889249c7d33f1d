"""Ordered tables: ordinals, running sums, as-of joins, quantiles, and the operators on top of them, at sizes at which one
task could not hold a group."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuslake.operators import coverage, grouping, intervals, ordered
from locuslake.sources import files


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.randrange(50), k) for k in range(400)] + [("hot", 7, k) for k in range(1000, 1300)]
    return rows, spark.createDataFrame(rows, "g string, x long, k long")


def test_ordinals_and_running_sums(table):
    rows, df = table
    got = ordered.ordinals(df, ["x", "k"]).orderBy("x", "k").collect()
    assert [r["ordinal"] for r in got] == list(range(len(rows)))
    for r in ordered.running(df, ["g"], ["x", "k"], "x").collect():
        own = [t for t in rows if t[0] == r["g"]]
        assert r["total"] == sum(t[1] for t in own) and r["before"] == sum(t[1] for t in own if (t[1], t[2]) < (r["x"], r["k"]))
    assert ordered.ordinals(df.limit(0), ["x"]).count() == 0 and ordered.running(df.limit(0), ["g"], ["x"], "x").count() == 0


@pytest.mark.parametrize("strict", [False, True])
def test_asof_against_every_mark(spark, table, strict):
    rows, df = table
    r = random.Random(2)
    marks = [(r.choice(["a", "b", "hot"]), r.randrange(50), f"m{k}") for k in range(12)]
    got = ordered.asof(df, spark.createDataFrame(marks, "g string, x long, name string"), ["g"], "x", ["name"], strict).collect()
    assert len(got) == len(rows)
    for row in got:
        before = [(x, n) for g, x, n in marks if g == row["g"] and (x < row["x"] or (not strict and x == row["x"]))]
        assert row["name"] == (max(before)[1] if before else None)
    assert ordered.asof(df.limit(0), df.select("g", "x", F.lit("n").alias("name")), ["g"], "x", ["name"]).count() == 0
    assert ordered.asof(df, df.limit(0).select("g", "x", F.lit("n").alias("name")), ["g"], "x", ["name"]).filter("name is null").count() == len(rows)


def test_exact_quantiles(table):
    rows, df = table
    for row in ordered.quantiles(df, ["g"], "x", [0.05, 0.5, 0.99, 1.0]).collect():
        own = [t[1] for t in rows if t[0] == row["g"]]
        assert np.allclose(row[1:], np.quantile(own, [0.05, 0.5, 0.99, 1.0]))
    assert ordered.quantiles(df.limit(0), [], "x", [0.5]).collect()[0][0] is None


def plans(spark, monkeypatch, run) -> list[str]:
    """The physical plans of all that is written while `run` runs, and of what it returns."""
    seen, inner = [], ordered.park

    def spy(frame, *args):
        seen.append(frame._jdf.queryExecution().executedPlan().toString())
        return inner(frame, *args)

    for module in (ordered, intervals, grouping):
        monkeypatch.setattr(module, "park", spy)
    seen.append(run()._jdf.queryExecution().executedPlan().toString())
    return seen


def test_no_plan_gathers_a_table_in_one_task(spark, table, monkeypatch):
    """Windows without keys are over one row for each part only; nothing is grouped in Python."""
    _, df = table
    regions = df.select(F.lit("c").alias("chrom"), (F.col("k") * 3).alias("start"), (F.col("k") * 3 + 10).alias("end"), F.col("k").cast("string").alias("name"))
    runs = {
        "cover": lambda: intervals.minimum_cover(regions), "nearby": lambda: intervals.nearby(regions, 30, "name"), "numbered": lambda: coverage.numbered_regions(regions, ["start", "name"]),
        "filter": lambda: grouping.feature_filter(df, "k", "x"), "outliers": lambda: grouping.without_outliers(df, ["x"]), "bulk": lambda: coverage.reference_bulk(
            df.select(F.lit("c").alias("chrom"), F.col("x").alias("bin"), F.col("k").alias("row_id"), F.col("x").alias("value")), df.select(F.col("k").alias("row_id")), 5, 10.0),
    }
    for name, run in runs.items():
        for plan in plans(spark, monkeypatch, run):
            assert "InPandas" not in plan and "percentile(" not in plan, name
            for line in plan.splitlines():
                if "Window [" in line and "], [" not in line:
                    assert "_part" in line or "sum(_n#" in line, (name, line)  # sums of parts


def test_many_chromosomes(spark):
    """100,000 contigs, some of them empty."""
    n = 100_000
    sizes = spark.range(n).select(F.format_string("c%06d", "id").alias("chrom"), F.when(F.col("id") % 10 == 3, 0).otherwise(F.col("id") % 7 + 1).cast("long").alias("size"))
    offsets = intervals.chrom_offsets(sizes)
    regions = sizes.filter("size > 1").select("chrom", F.lit(1).cast("long").alias("start"), F.col("size").alias("end"))
    back = intervals.from_global(intervals.to_global(regions, offsets).select(F.col("chrom").alias("was"), F.col("end").alias("to"), "gstart", "gend"), offsets)
    assert back.filter("was = chrom and start = 1 and end = to").count() == regions.count() == back.count()
    past = intervals.from_global(spark.createDataFrame([(10**9, 10**9 + 5)], "gstart long, gend long"), offsets).collect()[0]
    assert past["chrom"] is None and past["start"] is None
    with pytest.raises(Exception, match="negative global position"):
        intervals.from_global(spark.createDataFrame([(-1, 5)], "gstart long, gend long"), offsets).collect()


def test_cover_of_one_long_chain(spark):
    """Windows of 15 at every 10: a chain as long as the table; and windows of 1000, where jumps skip."""
    n = 100_000
    chain = spark.range(n).select(F.lit("c").alias("chrom"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 15).alias("end"))
    assert intervals.minimum_cover(chain).count() == n
    wide = chain.withColumn("end", F.col("start") + 1000)
    got = sorted(r["start"] for r in intervals.minimum_cover(wide).select("start").collect())
    want, at = [0], 0
    while at < (n - 1) * 10:
        at = min(at + 990, (n - 1) * 10)
        want.append(at)
    assert got == want


def test_nearby_of_a_dense_chromosome(spark, monkeypatch):
    """10,000 regions in reach of each: as many rows as regions are joined, and partners are even over the reach."""
    n = 20_000
    regions = spark.range(n).select(F.lit("c").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 100).alias("end"), F.col("id").alias("name"))
    got = intervals.nearby(regions, 5000, "name").collect()
    gaps = np.array([r["partner"] - r["name"] for r in got if 5000 <= r["name"] < n - 5000])
    assert len(got) == n and np.abs(gaps).max() < 5000 and abs(gaps.mean()) < 150 and abs(np.abs(gaps).mean() - 2500) < 100


def test_nearby_query_draws_from_all_in_reach(spark, tmp_path):
    """Regions of many lengths, empty ones and ones longer than a bin among them: the partner is the least by hash of all whose
    gap is under 5000, those that start further away included."""
    from locuslake.plans import queries

    r = random.Random(5)
    sizes = {k: r.choice([0, 1, 10, 50, 50, 300, 3000, None]) for k in r.sample(range(1, 3000), 400)}
    spark.createDataFrame(list(sizes.items()), "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {x["name"]: x["partner"] for x in queries.QUERIES["j8_nearby"](spark, str(tmp_path)).collect()}
    place = {f"p{k}": (k % 7, k * 100, k * 100 + n * 20) for k, n in sizes.items() if n is not None}
    want, far = {}, 0
    for a, (chrom, start, end) in place.items():
        reach = [b for b, (c, s, e) in place.items() if c == chrom and max(start - 5000, 0) < e and s < end + 5000]
        want[a] = min(reach, key=lambda b: (hashlib.md5(f"{a}|{b}|0".encode()).hexdigest(), b))  # noqa: B023
        far += abs(place[want[a]][1] - start) >= 5000
    assert got == want and far > 20


def test_fasta_in_several_files_and_splits(spark, tmp_path):
    r, want = random.Random(3), {}
    for f in range(3):
        with open(tmp_path / f"x{f}.fa", "w") as out:
            if f == 1:
                out.write("ACGT\n")  # no record's
            for c in range(3):
                name, seq = f"c{f}_{c}", "".join(r.choice("ACGT") for _ in range([9000, 0, 6600, 5][(f + c) % 4]))
                want[name] = seq
                width = r.choice([60, 61, 80])
                out.write(f">{name} description\n" + "".join(seq[k : k + width] + "\n" for k in range(0, len(seq), width)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, 4096 if "max" in k else 1024)
        for tile, slop in ((1000, 0), (700, 50), (100, 30)):
            got = [tuple(x) for x in files.read_fasta(spark, str(tmp_path), tile, slop).collect()]
            assert sorted(got) == sorted((n, k, min(k + tile, len(s)), max(0, k - slop), s[max(0, k - slop) : k + tile + slop]) for n, s in want.items() for k in range(0, len(s), tile))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
