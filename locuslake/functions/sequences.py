"""Column functions on DNA strings. Unknown bases stay unknown; positions are 0-based."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
#: IUPAC codes.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def one_hot_encode(seq: Column) -> Column:
    """Rows of A, C, G, T flags in either case; all zero for another letter."""
    return F.transform(F.split(F.upper(seq), ""), lambda c: F.array(*[(c == b).cast("tinyint") for b in BASES]))


def one_hot_decode(rows: Column) -> Column:
    """The base with the largest value, the first on ties; N for a row of zeros."""
    base = lambda r: F.when(F.array_max(r) <= 0, F.lit("N")).otherwise(F.substr(F.lit(BASES), F.array_position(r, F.array_max(r)).cast("int"), F.lit(1)))
    return F.array_join(F.transform(rows, base), "")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def swap_strand(strand: Column) -> Column:
    return F.translate(strand, "+-", "-+")


def by_strand(seq: Column, strand: Column) -> Column:
    """The sequence as read on its strand."""
    return F.when(strand == "-", reverse_complement(seq)).otherwise(seq)


def substitute(seq: Column, pos: Column, allele: Column) -> Column:
    """Writes an allele over the sequence from a position on."""
    return F.overlay(seq, allele, (pos + 1).cast("int"), F.length(allele))


def substitute_indel(seq: Column, pos: Column, ref: Column, alt: Column, keep: str = "left", seed: int = 0) -> Column:
    """Replaces ref by alt and restores the length: cut at (or, where short, filled up with seeded bases at) the far
    end, the near end, or both, for keep = left, right or center."""
    changed = F.concat(F.substr(seq, F.lit(1), pos.cast("int")), alt, F.substr(seq, (pos + 1 + F.length(ref)).cast("int"), F.length(seq)))
    size, got = F.length(seq), F.length(changed)
    fill = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(size - got, F.lit(1))), lambda k: F.substr(F.lit(BASES), (F.pmod(F.xxhash64(seq, pos, k, F.lit(seed)), F.lit(4)) + 1).cast("int"), F.lit(1))), "")
    fill = F.when(got < size, fill).otherwise(F.lit(""))
    if keep == "left":
        return F.substr(F.concat(changed, fill), F.lit(1), size)
    if keep == "right":
        both = F.concat(fill, changed)
        return F.substr(both, F.length(both) - size + 1, size)
    half = F.floor(F.length(fill) / 2).cast("int")
    both = F.concat(F.substr(fill, F.lit(1), half), changed, F.substr(fill, half + 1, F.length(fill)))
    return F.substr(both, F.floor((F.length(both) - size) / 2).cast("int") + 1, size)


def is_snv(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1)


def snv_by_genotype(seq: Column, pos: Column, ref: Column, alt: Column, genotype: Column) -> Column:
    """The sequence of one haplotype: genotype 0 has ref, 1 has alt."""
    return substitute(seq, pos, F.when(genotype == 0, ref).otherwise(alt))


def parse_mutation_name(name: Column) -> Column:
    """struct(region, pos, ref, alt, genome) of name__pos:ref:alt[:genome]; null parts where there are none."""
    part = F.split(F.get(F.split(name, "__"), F.lit(1)), ":")
    get = lambda k: F.get(part, F.lit(k))
    return F.struct(F.get(F.split(name, "__"), F.lit(0)).alias("region"), get(0).cast("long").alias("pos"), get(1).alias("ref"), get(2).alias("alt"), get(3).alias("genome"))


def iupac_pattern(code: str) -> str:
    """Regular expression of an IUPAC pattern."""
    return "".join(c if len(IUPAC[c]) == 1 else f"[{IUPAC[c]}]" for c in code.upper())


def base_counts(seq: Column) -> list[Column]:
    """Counts n_a, n_c, n_g, n_t in either case."""
    upper = F.upper(seq)
    return [(F.length(upper) - F.length(F.replace(upper, F.lit(b), F.lit("")))).cast("long").alias(f"n_{b.lower()}") for b in BASES]


def strip_version(name: Column) -> Column:
    return F.split_part(name, F.lit("."), F.lit(1))


def random_sequence(key: Column, length: int, weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25), seed: int = 0) -> Column:
    """A sequence of independent bases drawn by hashes of key, position and seed."""
    total, edges, run = sum(weights), [], 0.0
    for w in weights[:-1]:
        run += w / total
        edges.append(run)

    def base(k: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(key, k, F.lit(seed)), 11) / float(1 << 53)
        return F.when(u < edges[0], "A").when(u < edges[1], "C").when(u < edges[2], "G").otherwise("T")

    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), base), "")


def mutate(seq: Column, k: int, key: Column, seed: int = 0) -> Column:
    """k positions (all of a shorter sequence), chosen by hash rank, each set to another base than before."""

    def swap(seq: Column, i: Column) -> Column:
        old = F.array_position(F.array(*[F.lit(b) for b in BASES]), F.upper(F.substr(seq, i + 1, F.lit(1)))) - 1
        new = F.pmod(old + 1 + F.pmod(F.xxhash64(key, i, F.lit(seed + 1)), F.lit(3)), F.lit(4)) + 1
        return F.substr(F.lit(BASES), new.cast("int"), F.lit(1))

    def whole(seq: Column) -> Column:
        # the least hashes are among those under a bound, where k are; all are ranked otherwise
        places = F.sequence(F.lit(0), F.length(seq) - 1)
        bound = F.lit(-(2.0**63)) + F.lit(2.0**64) * (4 * k + 32) / F.length(seq)
        few = F.filter(places, lambda i: F.xxhash64(key, i, F.lit(seed)).cast("double") < bound)
        ranked = lambda at: F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(key, i, F.lit(seed)).alias("h"), i.alias("i"))))
        chosen = F.get(F.transform(F.array(few), lambda x: F.when(F.size(x) >= k, ranked(x)).otherwise(ranked(places))), F.lit(0))
        chosen = F.array_sort(F.transform(F.slice(chosen, 1, k), lambda x: x["i"]))
        # the text between two positions is taken as a whole
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("s"))
        step = lambda a, i: F.struct((i + 1).alias("at"), F.concat(a["s"], F.substr(seq, a["at"] + 1, i - a["at"]), swap(seq, i)).alias("s"))
        return F.when(F.length(seq) > 0, F.aggregate(chosen, start, step, lambda a: F.concat(a["s"], F.substr(seq, a["at"] + 1)))).otherwise(seq)

    return F.get(F.transform(F.array(seq), whole), F.lit(0))


def shuffle_window(seq: Column, start: int, end: int, key: Column, seed: int = 0) -> Column:
    """Shuffles the bases of seq[start:end] by hash order; the counts of bases stay."""
    window = F.transform(F.split(F.substr(seq, F.lit(start + 1), F.lit(end - start)), ""), lambda c, i: F.struct(F.xxhash64(key, i, F.lit(seed)).alias("h"), c.alias("c")))
    mixed = F.array_join(F.transform(F.sort_array(window), lambda x: x["c"]), "")
    return F.concat(F.substr(seq, F.lit(1), F.lit(start)), mixed, F.substr(seq, F.lit(end + 1), F.length(seq)))
