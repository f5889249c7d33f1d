"""Token counts, filter audit and hard negatives against plain computations."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuslake.llm import filter_audit, hard_negatives, token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def counter():
    tokenizer, _ = token_counts.load("byte_bpe_50k.json")
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False))


def awkward_texts() -> list[str]:
    r = random.Random(5)
    pieces = ["the river", " it's", " they'll've", "'re", "    ", "\n\n\n", "\t \t", "<|endoftext|>", "<|endoftext", "|>", "é", " 語語語", "🦆🦆", "a" * 40, "x1y2z3", "!!!???", " 1234567890", " ", "　　", "'", " '", "Σίσυφος "]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(400))) for _ in range(60)]
    return texts + ["a" * 3000, " " * 3000, "語" * 2000, "<|endoftext|>" * 200, "'" * 1500, "ab" * 900 + " c" * 900, "\n" * 500 + "x" + " " * 700 + "y" * 800, "'re" * 700]


@pytest.mark.parametrize("chunk,overlap", [(64, 24), (200, 60), (37, 18), (1000, 10)])
def test_spliced_counts_are_whole_counts(spark, counter, chunk, overlap):
    texts = awkward_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, chunk=chunk, overlap=overlap).collect()}
    assert got == {k: counter(x) for k, x in enumerate(texts)}


def test_overlaps_are_widened_only_where_alignment_fails(spark, monkeypatch):
    widths = []
    inner = token_counts._chunks

    def spy(texts, chunk, overlap):
        widths.append((overlap, texts.count()))
        return inner(texts, chunk, overlap)

    monkeypatch.setattr(token_counts, "_chunks", spy)
    docs = spark.createDataFrame([(1, "plain words go on " * 100), (2, "a" * 5000), (3, "short")], "doc_id long, text string")
    assert token_counts.token_counts(docs, chunk=100, overlap=40).count() == 3
    assert widths[0] == (40, 2) and widths[1] == (320, 1) and widths[-1][1] == 1


def test_token_counts_of_a_table(spark, docs, counter):
    got = token_counts.token_counts(docs, chunk=2000, overlap=200)
    want = Counter((r["doc_id"], len(r["text"].encode()), counter(r["text"]), counter(r["text"]) > 1024) for r in docs.collect())
    assert Counter(tuple(r) for r in got.collect()) == want
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_token_counts_of_odd_tables(spark, odd, empty, counter):
    want = Counter((r["doc_id"], counter(r["text"])) for r in odd.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(odd).collect()) == want
    assert token_counts.token_counts(empty).count() == 0


def test_vocabularies_without_a_proof_are_not_cut(spark, docs):
    tokenizer, margin = token_counts.load("word_bpe_49k.json")
    assert margin is None
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs.limit(20), "word_bpe_49k.json", chunk=100, overlap=20).collect()}
    assert got == {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False)) for r in docs.limit(20).collect()}


def plain_audit(docs: list[tuple], labels: dict[int, tuple[int, int]]) -> Counter:
    """(doc_id, text, source): every order applied to every document."""
    first: dict[str, int] = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    found: Counter = Counter()
    rows: dict[str, list] = {}
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i}
        rows.setdefault(source or "", []).append((fails, *labels.get(i, (0, 0))))
    for part, members in rows.items():
        steps, shapley = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, letter in enumerate(order):
                gone = [any(f[x] for x in order[:k]) for f, _, _ in members]
                hit = [not g and f[letter] for g, (f, _, _) in zip(gone, members)]
                shapley[letter] += sum(hit)
                steps.append((letter, (part, order, k + 1, sum(not g and not f[letter] for g, (f, _, _) in zip(gone, members)), sum(hit), sum(g and f[letter] for g, (f, _, _) in zip(gone, members)),
                    sum(f[letter] and sum(f.values()) == 1 for f, _, _ in members), sum(h and q == 1 for h, (_, q, _) in zip(hit, members)), sum(h and t == 1 for h, (_, _, t) in zip(hit, members)))))
        found.update((*row, shapley[letter]) for letter, row in steps)
    return found


def test_audit_against_every_order(spark, odd, empty):
    r = random.Random(7)
    texts = ["word " * 60, " ".join(f"w{k}" for k in range(70)), "UPPER " * 20, "short # text", "", None, " ".join(f"A{k}" for k in range(55)) + " $"]
    rows = [(r.choice([None, *range(25)]), r.choice(texts), r.choice([None, "", "a", "b"])) for _ in range(150)] + [(3, "same row", "a")] * 3
    labels = {i: (r.randrange(2), r.randrange(2)) for i in range(0, 25, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("a.b", F.lit(2))
    told = spark.createDataFrame([(k, *v) for k, v in labels.items()] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = Counter(tuple(x) for x in filter_audit.audit(docs, told).collect())
    want = plain_audit(rows, labels)
    assert got == want and sum(got.values()) == 3 * 600
    assert Counter(tuple(x) for x in filter_audit.audit(odd, told).collect()) == plain_audit([(x["doc_id"], x["text"], x["source"]) for x in odd.collect()], labels)
    assert filter_audit.audit(empty, told).count() == 0
    assert filter_audit.audit(docs, told.limit(0)).count() == 3 * 600


def test_fields_do_not_overflow():
    """Counts near the largest long in every field at once."""
    n = 2**63 - 1
    steps = filter_audit.unpack(n * filter_audit.outcomes(0b00001, True, True))
    assert set(steps.ravel().tolist()) == {0, n} and filter_audit.unpack(0).sum() == 0
    assert steps[:, 3].tolist() == [n if letter == "A" else 0 for order in filter_audit.ORDERS for letter in order]


def plain_negatives(rows: list[tuple], every: int = 5, positives: int = 5, negatives: int = 3) -> Counter:
    """(vec_id, vector, label) of rows that take part: every anchor against every row."""
    found: Counter = Counter()
    q = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v, _ in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    by_score = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for k, (anchor, _, label) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        scored = [(dot(q[k], q[j]), rows[j][0], rows[j][2] == label) for j in range(len(rows)) if j != k]
        for score, positive, _ in sorted((x for x in scored if x[2]), key=by_score)[:positives]:
            window = sorted((x for x in scored if not x[2] and 50 * score <= 100 * x[0] <= 95 * score), key=by_score)
            found.update((anchor, positive, rank, x[1], score, x[0]) for rank, x in enumerate(window[:negatives], 1))
    return found


def vectors(seed: int, n: int, dims: int, spread: float) -> list[tuple]:
    """Rows around a few centres, with copies of one vector, repeated rows and null ids."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    rows = [(k, (centres[k % 6] + spread * r.normal(size=dims)).tolist(), int(r.choice([0, 0, 0, 1, 2, -3]))) for k in range(n)]
    same = rows[3][1]
    rows += [(n + k, same, k % 2) for k in range(40)] + [rows[5]] * 3 + [rows[7]] * 2 + [(None, rows[11][1], 1), (None, rows[11][1], 0), (n + 60, [1.0], 0)]
    return rows


@pytest.mark.parametrize("seed,spread,block", [(1, 1.0, 8), (2, 0.1, 16), (3, 0.02, 4)])
def test_negatives_against_all_pairs(spark, monkeypatch, seed, spread, block):
    for name, value in {"BLOCK": block, "SHELF": 2, "GROUP": 6, "BAND": 2, "PAGE": 3}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(seed, 260, 7, spread)
    bad = [(900, None, 1), (905, [1.0, None], 1), (910, [float("nan")], 1), (915, [float("inf")], 0), (920, [1.0], None)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("x")).withColumn("a.b", F.lit(1))
    got = Counter(tuple(r) for r in hard_negatives.mine(frame, every=5).collect())
    assert got == plain_negatives(rows)
    assert hard_negatives.mine(frame.limit(0)).count() == 0


def test_zones_keep_blocks_unread(spark, monkeypatch):
    """Tight clusters: most pairs of a group and a shelf are ruled out by their bounds."""
    for name, value in {"BLOCK": 8, "SHELF": 1, "GROUP": 4}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    seen, inner = [], hard_negatives.found_in

    def spy(pairs, groups, blocks, *rest):
        seen.append((pairs.count(), groups.count() * blocks.select("shelf").distinct().count()))
        return inner(pairs, groups, blocks, *rest)

    monkeypatch.setattr(hard_negatives, "found_in", spy)
    r = np.random.default_rng(4)
    centres = 3 * r.normal(size=(20, 6))
    rows = [(k, (centres[k % 20] + 0.05 * r.normal(size=6)).tolist(), k % 20 % 5) for k in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert Counter(tuple(x) for x in hard_negatives.mine(frame, every=5).collect()) == plain_negatives(rows)
    assert len(seen) == 4 and sum(n for n, _ in seen) < 0.35 * sum(n for _, n in seen[1::2])


def test_large_components(spark):
    """Scores beyond 2**53 are exact, those beyond 64 bits an error."""
    r = random.Random(8)
    rows = [(k, [r.uniform(-1e5, 1e5), r.uniform(0, 1e5), float(r.randrange(10**5))], k % 3) for k in range(80)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert Counter(tuple(x) for x in hard_negatives.mine(frame, every=5).collect()) == plain_negatives(rows)
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.mine(frame.withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(1e9).cast("float"))))


@pytest.mark.parametrize("axes,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = hard_negatives.hilbert(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()
