"""Motif thresholds against all words, bit masks against sets of positions, motif files that are wrong."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuslake.operators import masks, motif
from locuslake.sources import files


def test_thresholds_against_all_words(spark):
    """P(score >= threshold) by enumeration is at most p, and a step below the threshold it is more."""
    r = random.Random(4)
    counts = {f"m{k}": [[r.randrange(1, 30) for _ in "acgt"] for _ in range(3 + k)] for k in range(4)}
    pwm = spark.createDataFrame([(m, i, *map(float, row)) for m, rows in counts.items() for i, row in enumerate(rows)], "motif_id string, pos int, a double, c double, g double, t double")
    for background in ((0.25,) * 4, (0.3, 0.2, 0.2, 0.3)):
        for row in motif.thresholds(pwm.repartition(3), 0.02, background).collect():
            m = motif.log_odds(np.array(counts[row["motif_id"]], float), background)
            assert np.allclose(np.array(row["matrix"]).reshape(-1, 4), m) and row["length"] == len(m)
            words = list(itertools.product(range(4), repeat=len(m)))
            score = np.array([sum(m[i, b] for i, b in enumerate(w)) for w in words])
            p = np.array([np.prod([background[b] for b in w]) for w in words])
            slack = len(m) * float((m.max(1) - m.min(1)).max()) / motif.STEPS
            assert p[score >= row["threshold"] + slack].sum() <= 0.02 + 1e-12 and p[score >= row["threshold"] - slack].sum() > 0.02 - p.max()
    assert motif.thresholds(pwm.limit(0)).count() == 0
    rows = motif.log_odds_rows(pwm).filter("motif_id = 'm0'").orderBy("pos").collect()
    assert np.allclose([[x[b] for b in "acgt"] for x in rows], motif.log_odds(np.array(counts["m0"], float)))


def test_bit_masks_against_sets(spark):
    r = random.Random(9)
    spans = [(r.choice("ab"), s, s + r.choice([0, 1, 7, 90_000])) for s in (r.randrange(200_000) for _ in range(60))]
    got = masks.bit_masks(spark.createDataFrame(spans, "k string, start long, end long"), ["k"], resolution=10)
    want = {k: {b for c, s, e in spans if c == k for b in range(s // 10, (e - 1) // 10 + 1 if e > s else s // 10)} for k in "ab"}
    assert {x["k"]: x["n"] for x in masks.bits(got, ["k"]).collect()} == {k: len(v) for k, v in want.items()}
    both = masks.united(got.withColumn("one", F.lit(1)), ["one"])
    assert masks.bits(both, ["one"]).first()["n"] == len(want["a"] | want["b"])
    for x in got.collect():
        bits = {(x["bucket"] - 1) * 32768 + 8 * i + j for i, byte in enumerate(x["mask"]) for j in range(8) if byte >> j & 1}
        assert bits == {b for b in want[x["k"]] if b // 32768 == x["bucket"] - 1}


def test_motif_files(spark, tmp_path):
    (tmp_path / "a.pfm").write_text(">M1 alpha\nA [ 1 2 ]\nC [ 3 4 ]\nG [ 5 6 ]\nT [ 7 8 ]\n>M2\n1 2 3\n1.5 2 3\n0 0 1e2\n1 1 1\n")
    (tmp_path / "b.pfm").write_text(">M3 x\r\n1\r\n2\r\n3\r\n4\r\n")
    got = [tuple(r) for r in files.read_motifs(spark, str(tmp_path)).orderBy("motif_id", "pos").collect()]
    assert got[:2] == [("M1", "alpha", 0, 1, 3, 5, 7), ("M1", "alpha", 1, 2, 4, 6, 8)] and got[4] == ("M2", "M2", 2, 3.0, 3.0, 100.0, 1.0) and got[5] == ("M3", "x", 0, 1, 2, 3, 4)
    (tmp_path / "b.pfm").write_text(">M4 x\n1 2\n2\n3\n4\n")
    with pytest.raises(Exception, match="unequal length in motif M4"):
        files.read_motifs(spark, str(tmp_path)).collect()


def test_correlation_with_an_even_hit(spark):
    pwm = spark.createDataFrame([("m", k, *[1.0 if b == c else 0.0 for b in "ACGT"]) for k, c in enumerate("GAT")], "motif_id string, pos int, a double, c double, g double, t double")
    hits = spark.createDataFrame([("h", "m", "+"), ("even", "m", "+"), ("back", "m", "-")], "hit string, motif_id string, strand string")
    h = [("h", k, *[2.0 if b == c else 0.0 for b in "ACGT"]) for k, c in enumerate("GAT")]
    back = [("back", k, *[-2.0 if b == c else 0.0 for b in "ACGT"]) for k, c in enumerate("ATC")]  # the reverse complement
    got = motif.hit_correlation(hits, spark.createDataFrame(h + back, "hit string, pos int, a double, c double, g double, t double"), pwm).collect()
    assert {r["hit"]: None if r["r"] is None else round(r["r"], 6) for r in got} == {"h": 1.0, "even": None, "back": 1.0}
