"""Sharding, mixing, near-duplicates, WARC archives and the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from locuslake.llm import decontaminate, langid, mixing, sharding, simhash, warc
from locuslake.llm.shared import ranks

SF = "/root/testdata/sf0.001"


def test_ranks_over_ranges(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id", "pmod(xxhash64(id), 100) / 100.0D AS at")
    got = [(r["g"], r["k"], r["at"], r["id"]) for r in ranks(df, ["g"], "at", ["id"], "k", most=7).collect()]
    for g in range(3):
        mine = sorted(x[1:] for x in got if x[0] == g)
        assert [x[0] for x in mine] == list(range(1, len(mine) + 1)) and [x[1:] for x in mine] == sorted(x[1:] for x in mine)


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards(spark, docs, shards):
    got = sharding.interleave(docs.select("doc_id", "source"), "source", ["doc_id"], shards).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(shards))
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    n = Counter(r["source"] for r in order)
    for source, total in n.items():  # the k-th of n rows stands near (k - 1/2) / n of the whole order
        at = [i for i, r in enumerate(order) if r["source"] == source]
        assert all(abs(i / len(order) - (k + 0.5) / total) < (len(n) + 1) / len(order) for k, i in enumerate(at))


def test_shard_edge_cases(spark, odd, empty):
    got = sharding.interleave(odd, "source", ["doc_id", "text"], 4)
    assert got.count() == 11 and sorted(c for c in got.columns if c in ("shard", "slot")) == ["shard", "slot"] and "size" in got.columns
    assert sharding.interleave(empty, "source", ["doc_id"], 4).count() == 0
    assert sharding.mixture(got, "source").count() > 0


def test_small_sources_reach_all_shards(spark):
    """2000 sources of one row and 200 of two beside a large one: every shard holds its share of each kind."""
    rows = [(k, "large") for k in range(2000)] + [(2000 + k, f"s{k}") for k in range(2000)] + [(4000 + k, f"t{k // 2}") for k in range(400)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, source string"), "source", ["doc_id"], 40).collect()
    for kind, share in (("l", 50), ("s", 50), ("t", 10)):
        n = Counter(r["shard"] for r in got if r["source"][0] == kind)
        assert len(n) == 40 and max(abs(n[k] - share) for k in range(40)) <= 4.5 * share**0.5, kind
    assert sorted((r["shard"], r["slot"]) for r in got) == [(k, j) for k in range(40) for j in range(110)]


def test_shards_are_cuts_of_the_fractional_order(spark, docs):
    """The method over again in plain Python, from the hashes alone."""
    from locuslake.llm.shared import null_safe, unit_hash

    own = docs.select("doc_id", "source", unit_hash(3, F.col("doc_id")).alias("at"), unit_hash(4, null_safe(F.col("source"))).alias("phase")).collect()
    order = []
    for source in {r["source"] for r in own}:
        rows = sorted((r for r in own if r["source"] == source), key=lambda r: r["at"])
        order += [((k + r["phase"]) / len(rows), r["doc_id"]) for k, r in enumerate(rows)]
    order, n = [i for _, i in sorted(order)], len(own)
    sizes = [n // 7 + (k < n % 7) for k in range(7)]
    want = {i: (k, j) for k in range(7) for j, i in enumerate(order[sum(sizes[:k]) : sum(sizes[: k + 1])])}
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.interleave(docs.select("doc_id", "source"), "source", ["doc_id"], 7).collect()}
    assert got == want


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("doc-a", "what is the capital of the old northern kingdom on the river. it is the city of stone and glass by the sea."), ("doc-b", "nothing of it")], "doc_id string, text string")
    items = docs.filter("doc_id = 'doc-a'").select(F.lit(1).cast("long").alias("item_id"), "text")
    got = decontaminate.leaks(docs, items).collect()
    assert [r["doc_id"] for r in got] == ["doc-a"]


def test_targets_against_refilling(spark):
    sizes = [("a", 100), ("b", 10), ("c", 1000), (None, 50), ("d", 5)]
    df = spark.createDataFrame([("n" if s is None else f"s{s}", s, n) for s, n in sizes], "key string, source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    order = [*sorted(s for s, _ in sizes if s is not None), None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    cap = {s: 2.0 * n for s, n in sizes}
    rest, free, want = 1.5 * sum(n for _, n in sizes), set(order), {}
    while True:
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap[s]]
        if not over:
            want.update(share)
            break
        for s in over:
            want[s] = cap[s]
            rest -= cap[s]
            free.discard(s)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_dual_solution_meets_constraints(spark):
    rows = [("a", s, n) for s, n in ((1, 50), (10, 40), (100, 30), (3000, 2))] + [("b", 7, 1)]
    classes = spark.createDataFrame(rows, "key string, size long, n long")
    total = sum(s * n for k, s, n in rows if k == "a")
    for share in (0.05, 0.7, 1.0, 1.9, 2.0):
        goals = spark.createDataFrame([("a", share * total, total), ("b", 14.0, 7)], "key string, target double, source_size long")
        got = {r["key"]: r for r in mixing.solve(classes, goals).collect()}
        rate = lambda k, s: min(2.0, np.exp(got[k]["tilt"] * s / got[k]["scale"]))  # noqa: E731, B023
        assert abs(sum(n * s * rate("a", s) for k, s, n in rows if k == "a") / (share * total) - 1) < 1e-6
        assert abs(rate("b", 7) - 2) < 1e-6


def test_mix_takes_targets(spark, docs, odd, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["copies"] <= 2 for r in got)
    src = {r["doc_id"]: r["source"] for r in docs.collect()}
    for source in set(src.values()):
        mine = [r for r in got if src[r["doc_id"]] == source]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 0.5 * max(r["size"] for r in mine) + 1e-3
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)
    assert mixing.mix(odd).count() == 11 and mixing.mix(empty).count() == 0
    whole = mixing.mixed(odd)
    taken = mixing.mix(odd).agg(F.sum("copies")).first()[0]
    assert whole.columns == odd.columns and whole.count() == taken
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in got)


def brute_components(bits, ids):
    parent = list(range(len(bits)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(bits)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    low = {}
    for i in range(len(bits)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low[find(i)] for i in range(len(bits))]


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split() if text else []
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_against_brute_force(spark, docs):
    for block in (None, 16):
        got = sorted(simhash.near_duplicates(docs, block_rows=block).collect(), key=lambda r: r["doc_id"])
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        bits = [brute_fingerprint(texts[r["doc_id"]]) for r in got]
        assert [r["bits"] % (1 << 64) for r in got] == bits
        assert [r["component_id"] for r in got] == brute_components(bits, [r["doc_id"] for r in got])


@pytest.mark.parametrize("seed", [0, 1])
def test_close_pairs_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63 - 1, 700, dtype=np.int64)
    v = np.unique(np.concatenate([base, base[:300] ^ (np.int64(1) << rng.integers(0, 63, 300)), base[:50] ^ 31, np.array([0, -1, -(2**63)])]))
    rank = v.view(np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    v = v[np.argsort(rank)]
    want = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count((v[:, None] ^ v[None, :]).view(np.uint64)) <= 4), strict=True)}
    assert {(i, j) for a, b in simhash.close_pairs(v, v, 4, True) for i, j in zip(a.tolist(), b.tolist(), strict=True)} == {(i, j) for i, j in want if i < j}
    half = len(v) // 2
    assert {(i, j + half) for a, b in simhash.close_pairs(v[:half], v[half:], 4, False) for i, j in zip(a.tolist(), b.tolist(), strict=True)} == {(i, j) for i, j in want if i < half <= j}


def test_long_texts_in_pieces(monkeypatch):
    r = random.Random(2)
    texts = [" ".join(r.choice(["Alpha", "b", "ÄÖ", "x" * 40]) for _ in range(n)) for n in (1, 3, 4, 5, 200)] + [" \t ", "\n a  b\tc\x0bd \r e", "y" * 300]
    whole = [simhash.fingerprint(t) for t in texts]
    assert whole == [brute_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert [simhash.fingerprint(t) for t in texts] == whole


def test_fewer_pairs_of_blocks_survive_among_more(spark):
    """Blocks of 64 random fingerprints: with k shared leading bits at least the pairs that differ in over 4 of them go."""
    shares = []
    for count in (1 << 11, 1 << 13, 1 << 15):
        bits = spark.range(count).select(F.xxhash64("id").alias("bits"))
        shares.append(simhash.surviving_share(bits, block_rows=64))
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.6


def test_pairs_are_dealt_evenly(spark):
    bits = spark.range(4000).select(F.xxhash64("id").alias("bits"))
    n = simhash.links(bits, block_rows=256).rdd.getNumPartitions()
    assert n == simhash.indexed_pairs(bits, block_rows=256)[2] > 16


def test_gray_rank(spark):
    n = 64
    df = spark.range(n).select((F.col("id").bitwiseXOR(F.shiftright("id", 1))).alias("gray"), "id")
    assert all(r["r"] + (1 << 63) == r["id"] for r in df.select(simhash.gray_rank(F.col("gray")).alias("r"), "id").collect())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (301, 300)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "node long, to long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 140)) and got[301] == 300 and 200 not in got


def test_duplicate_edge_cases(spark, odd, empty):
    got = {(r["doc_id"], r["bits"]): r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert simhash.near_duplicates(odd).count() == 11 and simhash.near_duplicates(empty).count() == 0
    assert got[(1, 0)] == got[(2, 0)] == got[(3, 0)] == got[(None, 0)] == 1
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == {1: 1, 4: 1, 5: 1, 7: 1, 8: 1}
    assert simhash.representatives(empty).count() == 0


def test_loser_tree():
    r = random.Random(4)
    for k in (0, 1, 2, 3, 8, 13):
        runs = [sorted((r.randrange(20), i, j) for j in range(r.randrange(6))) for i in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x[0])) == sorted((x for run in runs for x in run), key=lambda x: (x[0], x[1], x[2])) if k else list(warc.LoserTree(runs, lambda x: x)) == []


def test_warc_round_trip(spark, tmp_path):
    tricky = "a\r\n\r\nWARC/1.1\r\n\r\nb\r\n\r\n"
    rows = [(1, "http://www.B.org/x?q=1", tricky), (2, "http://a.org/", tricky), (3, None, None), (None, "http://a.org/", ""), (4, "http://a.org/\r\nX: y", "é"), (5, "http://a.org/", tricky), (5, "http://a.org/", tricky), (2**60 + 1, "http://a.org/", "big")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("keeper", F.lit(1))
    got = sorted(warc.archive(pages).collect(), key=lambda r: r["position"])
    assert len(got) == 8 and all(r["intact"] for r in got) and [r["position"] for r in got] == list(range(8))
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == {(1, "revisit", 5): 1, (2, "revisit", 5): 1, (5, "response", None): 2, (3, "response", None): 1, (None, "revisit", 3): 1, (4, "response", None): 1, (2**60 + 1, "response", None): 1}
    keys = [(r["urlkey"], r["timestamp"], r["page_id"] is not None, r["page_id"] or 0) for r in got]
    assert keys == sorted(keys) and ("org,b)/x?q=1" in {k[0] for k in keys})
    assert {r["payload_bytes"] for r in got if r["page_id"] in (1, 2, 5)} == {len(tricky)}
    assert warc.archive(pages.limit(0)).count() == 0


def test_histories_merged_from_many_archives(spark, tmp_path, monkeypatch):
    """Many short runs, one URL with a third of all captures: the merged order is that of a plain sort."""
    monkeypatch.setattr(warc, "FILE_BYTES", 6000)
    pages = spark.range(300).selectExpr("id AS page_id", "concat('http://', if(id % 3 = 0, 'hot', concat('h', id % 17)), '.org/', if(id % 3 = 0, '', string(id % 5))) AS url", "concat('text ', id) AS html")
    warc.write(pages, str(tmp_path / "w"), captured=F.timestamp_seconds(F.lit(1_600_000_000) + F.pmod(F.col("page_id") * 7919, F.lit(50))))
    runs = warc.read(spark, str(tmp_path / "w"))
    assert runs.select("file").distinct().count() > 20
    got = sorted(warc.merge(runs, 40).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(300))
    assert [(r["urlkey"], r["timestamp"], r["page_id"]) for r in got] == sorted((r["urlkey"], r["timestamp"], r["page_id"]) for r in got)


def test_records_are_standard_warc(spark, tmp_path):
    folder = str(tmp_path / "w")
    warc.write(spark.createDataFrame([(1, "http://a/", "<p>x</p>")], "page_id long, url string, html string"), folder)
    data = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    (headers, block, offset, length), = warc.records(data)
    assert headers["warc-type"] == "response" and block.endswith(b"\r\n\r\n<p>x</p>") and (offset, length) == (0, len(data))


def test_pipeline_against_brute_force(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_dedup", "decontaminate", "mix_sources", "shard"]
    extra = spark.createDataFrame([(10_000, "123 456 !!", "en", "src0", 10), (10_001, None, "en", "src0", 0)], docs.schema)
    rows = docs.union(extra)
    profiles = langid.learn(rows.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1))
    one = corpus_pipeline.STAGES[0][1](spark, rows, SF)
    assert one.columns == docs.columns
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in rows.collect() if profiles.classify(r["text"])[0] != "und"}
    assert not {10_000, 10_001} & {r["doc_id"] for r in one.collect()}
    two = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    own = docs.orderBy("doc_id").collect()
    ids = [r["doc_id"] for r in own]
    assert {r["doc_id"] for r in two.collect()} == set(brute_components([brute_fingerprint(r["text"]) for r in own], ids)) and two.columns == docs.columns
    three = corpus_pipeline.STAGES[2][1](spark, docs, SF)
    leaks = {r["doc_id"] for r in decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in three.collect()} == set(ids) - leaks and three.columns == docs.columns
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows) > 0 and not leaks & {r["doc_id"] for r in rows}
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 2


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, empty):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing names, in each stage by itself."""
    ids = lambda x: Counter(r["doc_id"] for r in x.collect())
    everything = ids(odd)
    kept = {name: stage(spark, odd, SF) for name, stage in corpus_pipeline.STAGES}
    assert ids(kept["language_id"]) == Counter({4: 1, None: 1, 5: 1, 6: 2, 7: 1})
    assert ids(kept["simhash_dedup"]) == Counter([1, 4, 5, 7, 8])
    assert ids(kept["decontaminate"]) == everything
    taken = ids(kept["mix_sources"])
    assert all(n <= 2 * everything[k] for k, n in taken.items()) and {1, 2, 3} <= taken.keys()
    slots = kept["shard"].collect()
    assert Counter(r["doc_id"] for r in slots) == everything and len({(r["shard"], r["slot"]) for r in slots}) == len(slots)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, empty, SF)
        assert none.count() == 0 and (name == "shard" or none.columns == kept[name].columns == odd.columns), name
