"""What shows only in larger or odd tables: queries on copies of the driver's tables with some tables replaced."""

from __future__ import annotations

import os
import struct
from pathlib import Path

import pytest
from compare import TABLES, compare, duck

from locuslake.plans import feature_queries, more_queries, operator_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """A function that replaces tables by frames and gives the folder of all tables."""

    def put(**frames) -> str:
        for name in TABLES:
            if name in frames:
                frames[name].write.parquet(str(tmp_path / f"{name}.parquet"))
            elif not (tmp_path / f"{name}.parquet").exists():
                os.symlink(Path(SF, f"{name}.parquet"), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return put


def bits(x):
    """A value with its doubles as bytes, so that 0.0 and -0.0 differ."""
    if isinstance(x, (list, tuple)):
        return tuple(map(bits, x))
    return struct.pack(">d", x) if isinstance(x, float) and x == x else str(x)


def same_bits(frame, sf_dir: str, sql: str) -> bool:
    columns, rows = duck(sf_dir, sql)
    return sorted(map(bits, map(tuple, frame.select(*columns).collect())), key=repr) == sorted(map(bits, rows), key=repr)


def test_one_hot_keeps_nulls_and_the_sign_of_zero(spark, tables):
    rows = [(0, "BUILDING", -0.0), (1, "MACHINERY", -0.004), (2, None, 1.005), (3, "FURNITURE", 0.285), (4, "BUILDING", None), (5, None, -2.675), (6, "", 1e307), (7, "MACHINERY", float("nan"))]
    d = tables(customer=spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_acctbal double").selectExpr("c_custkey", "'n' AS c_name", "1 AS c_nationkey", "c_acctbal", "c_mktsegment"))
    assert same_bits(queries.QUERIES["p31_one_hot"](spark, d), d, queries.ORACLES["p31_one_hot"])


def test_centre_crop_keeps_the_sign_of_zero(spark, tables):
    rows = [(k, [(-1.0) ** i * x for i in range(64)]) for k, x in enumerate([3e-7, 5e-7, 0.1, 0.0078125, 0.0])] + [(9, None)]
    d = tables(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label"))
    assert same_bits(queries.QUERIES["p9_centre_crop"](spark, d), d, queries.ORACLES["p9_centre_crop"])


def test_fragments_past_the_end_of_a_chromosome_are_left_out(spark, tables):
    """More suppliers than the chromosomes' margin allows for; empty fragments and chromosomes without a size, too."""
    line = spark.createDataFrame([(p, s, c, q) for p in (0, 40, 199) for s in (0, 1, 1428, 1429, 5000) for c in (1, 7, 8) for q in (0.0, 1.0, 50.0)], "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    d = tables(lineitem=line.selectExpr("*", "'N' AS l_returnflag"))
    frame = queries.QUERIES["j3_locate"](spark, d)
    assert compare(frame, d, queries.ORACLES["j3_locate"]) == ""
    assert 0 < frame.count() < line.filter("l_linenumber < 8").count()


def test_thresholds_of_many_motifs_are_those_of_one():
    """Rows of words and the convolution agree to the step, with ties, flat positions and words of equal mass."""
    import numpy as np

    from locuslake.operators import motif

    r, done = np.random.default_rng(0), 0
    for background in ((0.25,) * 4, (0.5, 0.25, 0.125, 0.125)):
        for p_value in (1e-3, 1e-4, 0.02, 0.25, 0.999):
            for length in (n for n in range(1, 9) if motif._few_words(n, p_value, background)):
                m = motif.log_odds(r.integers(0, 8, (50 * length, 4)).astype(float), background).reshape(-1, length, 4)
                m[0], m[1, 0] = 0.0, 1.0
                assert np.allclose(motif.best_words(m, p_value, background), [motif.threshold(x, p_value, background) for x in m], atol=1e-9, rtol=0)
                done += 1
    assert done > 30 and not motif._few_words(4, 0.02, (0.3, 0.2, 0.2, 0.3)) and not motif._few_words(15, 1e-4, (0.25,) * 4)


def test_thresholds_start_no_group_in_python(spark):
    """A motif is a row of a batch; a Python group for each took a millisecond and more."""
    plan = queries.QUERIES["m2_threshold"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan


def test_slots_find_what_the_whole_sums_find():
    import numpy as np

    from locuslake.operators import deviation

    r = np.random.default_rng(3)
    for n in (1, 2, 7, 300):
        w = r.random(n) ** 8 + 1e-9
        cdf, to = np.cumsum(w / w.sum()), r.permutation(n)
        slots = {k: (np.array(c), t) for k, c, t in deviation._slots(cdf, to)}
        assert len(slots) == deviation.SLOTS and sum(len(c) for c, _ in slots.values()) <= n
        for u in [*r.random(3000), *(cdf[cdf < 1]), *(np.arange(64) / 64), 1 - 2.0**-53]:
            c, t = slots[int(u * deviation.SLOTS)]
            assert t[min(int((c <= u).sum()), len(t) - 1)] == to[min(int((cdf <= u).sum()), n - 1)]


def test_background_draws_are_dealt_out_and_not_sorted(spark):
    """Draws are made after the peaks have been dealt to tasks, and meet the peaks without a sort of all draws."""
    plan = queries.QUERIES["a23_background"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("kind", ["long", "string"])
def test_packed_sets_hold_all_entries_in_two_bytes_each(spark, kind):
    """Blocks that come in one row or in several, with repeated entries and a null motif."""
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from locuslake.operators import deviation

    r = random.Random(1)
    rows = [(r.randrange(300), r.choice([None, 1, 2, 2**40 + 1]), r.randrange(251)) for _ in range(25_000)] + [(5, 1, 7)] * 3
    entries = spark.createDataFrame(rows, "feature long, motif long, set int").select(F.col("feature").cast(kind).alias("feature"), "motif", "set")
    fb, mb = F.pmod(F.xxhash64("feature"), F.lit(4)).cast("int").alias("fb"), F.lit(0).alias("mb")
    for most in (1, 10**9):
        packed = deviation._packed(entries, fb, mb, 251, most).collect()
        got = []
        for p in packed:
            assert len(p["sets"]) == 2 * sum(p["times"]) and len(p["feature"]) == len(p["times"])
            features = np.repeat(np.array(p["feature"], dtype=object), p["times"])
            got += [(int(f), p["motif"], int(k)) for f, k in zip(features, np.frombuffer(p["sets"], np.uint16), strict=True)]
        assert sorted(got, key=repr) == sorted(rows, key=repr)
        assert (len(packed) == 16) == (most > 1)


@pytest.mark.parametrize(("ca_limit", "atom_limit", "min_gap"), [(3.0, 2.0, 1), (2.0, 3.0, 2), (2.5, 2.5, 0)])
def test_contacts_against_all_pairs(spark, ca_limit, atom_limit, min_gap):
    """Chains, several atoms of a residue, negative places; atoms are joined once, and pairs are not joined again."""
    import random

    from locuslake.operators import structure

    r = random.Random(2)
    atoms = [(s, c, k, n, *[r.uniform(-6, 6) for _ in "xyz"]) for s in "st" for c in "AB" for k in range(25) for n in ("CA", "CB", "CB2")]
    frame = structure.contacts(spark.createDataFrame(atoms, "structure string, chain string, residue_id int, atom_name string, x double, y double, z double"), ca_limit, atom_limit, min_gap)
    want: dict = {}
    for a in atoms:
        for b in atoms:
            if a[0] == b[0] and (a[1] < b[1] or (a[1] == b[1] and b[2] - a[2] >= min_gap)):
                gap = sum((p - q) * (p - q) for p, q in zip(a[4:], b[4:], strict=True)) ** 0.5
                ca, nearest = want.get((a[:3], b[1:3]), (9.0, 9.0))
                want[a[:3], b[1:3]] = (min(ca, gap) if a[3] == b[3] == "CA" else ca, min(nearest, gap))
    want = {(*a, *b): (pytest.approx(ca), pytest.approx(n)) for (a, b), (ca, n) in want.items() if ca < ca_limit and n < atom_limit}
    got = {tuple(x)[:5]: tuple(x)[5:] for x in frame.collect()}
    assert len(want) > 10 and got.keys() == want.keys() and all(got[k] == want[k] for k in want) and frame.count() == len(got)
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Join") == 1
