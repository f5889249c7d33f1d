"""Quality rules under weak supervision. DataFrame functions only.

Each rule votes good (1) or bad (-1) on a document or abstains (0). Expectation-maximisation over all
documents estimates, without labels, how many documents are good and how accurate every rule's votes are on
good and on bad documents; a document is kept if its posterior probability of being good is at least a half,
rather than if it passes every rule. Only the counts of vote patterns (3 to the number of rules at most) are
iterated over.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuslake.llm.shared import WORD, park, words

#: name: (measure, (bad below, bad above), (good from, good to)); a rule abstains where a text has no words.
#: Each kind of bad document should be seen by two rules at least: what one rule alone sees can't be told from
#: its errors without labels.
RULES: dict[str, tuple[str, tuple[float, float], tuple[float, float]]] = {
    "length": ("n_words", (50, 1e12), (80, 1e12)),
    "word_length": ("word_chars / n_words", (2.5, 12), (3, 10)),
    "symbols": ("n_symbols / n_words", (-1, 0.1), (0, 0.02)),
    "dup_lines": ("n_dup_lines / n_lines", (-1, 0.3), (0, 0.1)),
    "repeats": ("n_repeat_words / n_words", (-1, 0.3), (0, 0.15)),
    "capitals": ("n_capitals / word_chars", (-1, 0.3), (0, 0.1)),
    "shouts": ("n_shouts / n_words", (-1, 0.1), (0, 0.02)),
    "plain": ("n_plain / n_words", (0.7, 2), (0.85, 2)),
    "diversity": ("n_distinct / n_words", (0.6, 2), (0.7, 2)),
}
#: A word of letters, hyphens and apostrophes with at most one mark after it.
PLAIN = r"(?<![^\x20\x09-\x0D])\p{L}[\p{L}'-]*+[.,;:!?)]?(?![^\x20\x09-\x0D])"
#: Words repeat more the longer a text is: distinct ones are counted in each run of so many words and added up over
#: the whole text, so that n_distinct / n_words, 1 at most, means the same at every length.
RUN_WORDS = 100
#: Rounds of estimation after which it is an error not to have settled.
MAX_ROUNDS = 400
TOLERANCE = 1e-4
#: Where the estimate starts: share of good documents, and how often a vote is right on good and on bad ones.
#: A rule seldom speaks against a good document, but each kind of bad document is seen by few rules, so that a
#: good vote says little.
START = (0.85, 0.995, 0.25)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body or its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(found: Column, hashed: Callable[..., Column] = F.xxhash64) -> Column:
    """Words inside a 3-word window that occurs twice or more; each word counts once.

    The windows' hashes are sorted with their positions in the low bits, as few as the text needs (a text of
    20,000 words leaves 49 bits of hash). Neighbours with equal hashes are repeats, and their words are compared:
    should windows of other words share a hash anywhere in a text, its windows are sorted by their words instead.
    In the repeats' sorted positions each window covers three words, or fewer if the next one starts sooner.
    """
    shift = lambda name, x, n: F.call_function(name, x, n)

    def alike(x: Column, y: Column) -> Column:
        return F.coalesce(x == y, F.lit(False))

    def repeats(ordered: Column, value: Callable[[Column], Column], at: Callable[[Column], Column]) -> Column:
        """Sorted positions of the windows that are like a neighbour in a sorted array."""
        own = lambda k: value(F.get(ordered, k))
        like = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda k: alike(own(k), own(k - 1)) | alike(own(k), own(k + 1)))
        return F.sort_array(F.transform(like, lambda k: at(F.get(ordered, k))))

    def covered(at: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(at)), lambda k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, k) - F.get(at, k - 1), F.lit(3).cast("long"))))
        return F.when(F.size(at) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b))

    def count(w: Column) -> Column:
        windows = F.size(w) - 2
        word = lambda i, k: F.get(w, (i + k).cast("int"))

        def by_words() -> Column:
            # no word holds a space
            named = F.transform(F.sequence(F.lit(0), windows - 1), lambda i: F.struct(F.concat_ws(" ", word(i, 0), word(i, 1), word(i, 2)).alias("words"), i.cast("long").alias("at")))
            return let(let(F.sort_array(named), lambda x: repeats(x, lambda e: e["words"], lambda e: e["at"])), covered)

        def by_hash(bits: Column) -> Column:
            part = lambda x: shift("shiftright", x, bits)
            at = lambda x: x.bitwiseAND(shift("shiftleft", F.lit(1).cast("long"), bits) - 1)
            high = lambda i: shift("shiftleft", hashed(word(i, 0), word(i, 1), word(i, 2)), bits)
            packed = F.sort_array(F.transform(F.sequence(F.lit(0), windows - 1), lambda i: high(i).bitwiseOR(i.cast("long"))))

            def differ(x: Column, y: Column) -> Column:
                return (word(x, 0) != word(y, 0)) | (word(x, 1) != word(y, 1)) | (word(x, 2) != word(y, 2))

            def checked(p: Column) -> Column:
                clash = F.exists(F.sequence(F.lit(0), windows - 1), lambda k: alike(part(F.get(p, k)), part(F.get(p, k - 1))) & differ(at(F.get(p, k)), at(F.get(p, k - 1))))
                return F.when(clash, by_words()).otherwise(let(repeats(p, part, at), covered))

            return let(packed, checked)

        return F.when(windows < 2, F.lit(0).cast("long")).otherwise(let(F.length(F.bin(windows.cast("long"))), by_hash))

    return let(found, count)


def distinct_in_runs(found: Column, run: int = RUN_WORDS) -> Column:
    """The number of distinct words in each run of `run` words, added up over the text."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(run)), lambda k: k <= F.size(found))
    return F.aggregate(starts, F.lit(0).cast("long"), lambda n, k: n + F.size(F.array_distinct(F.slice(found, k, run))))


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the measures of every row, whole texts; a null text has no words and no lines."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda line: line.rlike(WORD))
    letters = F.array_join(F.col("_words"), "")
    found = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("_text"), words(F.col(text)).alias("_words"))
    return found.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), F.length(letters).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again"))).alias("_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"), F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("_text", F.lit(r"[!?]{2,}")).cast("long").alias("n_shouts"),
        F.regexp_count("_text", F.lit(PLAIN)).cast("long").alias("n_plain"), distinct_in_runs(F.col("_words")).alias("n_distinct"),
    ).select("*", F.col("_lines.n").alias("n_lines"), F.col("_lines.again").alias("n_dup_lines")).drop("_lines")


def votes() -> Column:
    """The rules' votes on a row of measures, in order, as an array of -1, 0 and 1."""
    out = []
    for measure, (below, above), (least, most) in RULES.values():
        top, _, bottom = measure.partition(" / ")
        x = F.try_divide(F.col(top), F.col(bottom)) if bottom else F.col(top).cast("double")
        vote = F.when((x < below) | (x > above), -1).when((x >= least) & (x <= most), 1).otherwise(0)
        out.append(F.coalesce(vote, F.lit(0)).cast("tinyint"))
    return F.array(*out)


def probability(cast: Column, good: float, right: list[tuple[float, float]]) -> Column:
    """Posterior probability of being good from an array of votes; right: each rule's accuracy on good and on bad documents.

    The votes' weights are one array literal, so that rounds of estimation share their compiled code.
    """
    table = [x for on_good, on_bad in right for x in (math.log((1 - on_good) / on_bad), 0.0, math.log(on_good / (1 - on_bad)))]
    weights = F.lit([*table, math.log(good / (1 - good))])
    total = F.aggregate(F.transform(cast, lambda v, k: F.get(weights, k * 3 + v + 1)), F.get(weights, F.lit(len(table))), lambda a, b: a + b)
    return 1 / (1 + F.exp(-total))


def estimate(patterns: DataFrame, rules: int) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents and the rules' accuracies, from vote patterns (votes, n).

    Each round is one aggregation, which returns a row for every rule and vote. A pseudo-count of one keeps
    accuracies inside (0, 1). No documents leave the start as it is. Estimates that still move by TOLERANCE after
    MAX_ROUNDS are an error.
    """
    good, right = START[0], [START[1:]] * rules
    for _ in range(MAX_ROUNDS):
        rows = patterns.select("n", (F.col("n") * probability(F.col("votes"), good, right)).alias("good"), F.posexplode("votes").alias("rule", "vote"))
        got = {(r["rule"], r["vote"]): (r["good"], r["n"] - r["good"]) for r in rows.groupBy("rule", "vote").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect()}
        if not got:
            break
        of = lambda k, vote, got=got: got.get((k, vote), (0.0, 0.0))
        total = [sum(of(0, vote)[side] for vote in (-1, 0, 1)) for side in (0, 1)]
        was = [good, *(x for pair in right for x in pair)]
        good = (total[0] + 1) / (sum(total) + 2)
        right = [((of(k, 1)[0] + 1) / (of(k, 1)[0] + of(k, -1)[0] + 2), (of(k, -1)[1] + 1) / (of(k, -1)[1] + of(k, 1)[1] + 2)) for k in range(rules)]
        if max(abs(a - b) for a, b in zip(was, [good, *(x for pair in right for x in pair)], strict=True)) < TOLERANCE:
            break
    else:
        raise RuntimeError(f"the rules' accuracies did not settle in {MAX_ROUNDS} rounds")
    return good, right


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measures, base_failed, p_good and kept of every row.

    base_failed: fewer than 50 words, or over half the words repeated; such documents are not kept whatever
    their posterior. Null and empty texts fail. Repeated rows get equal results; other columns are ignored;
    an empty table gives none. A text's words are held in one row, about 100 bytes for each word while its windows
    are sorted: a text of a million words takes 100 MB.
    """
    measured = park(measures(docs, doc_id, text).withColumn("votes", votes()))
    patterns = park(measured.groupBy("votes").agg(F.count("*").alias("n"))).coalesce(1).sortWithinPartitions("votes")
    good, right = estimate(patterns, len(RULES))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = measured.withColumn("p_good", probability(F.col("votes"), good, right)).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~failed & (F.col("p_good") >= 0.5)).drop("votes")
