"""Functions on nucleotide strings and on proportions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BANDS


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_code(base: Column | str) -> Column:
    """0 to 3 for A, C, G, T in either case, else 4."""
    at = F.instr(F.lit("ACGT"), F.upper(_col(base)))
    return F.when((F.length(_col(base)) == 1) & (at > 0), at - 1).otherwise(4)


def reverse_kmer(kmer: Column | str) -> Column:
    """Reverse complement of a string of A, C, G, T."""
    return F.reverse(F.translate(_col(kmer), "ACGT", "TGCA"))


def reverse_complement(seq: Column | str) -> Column:
    """In capitals; anything but A, C, G, T becomes N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(_col(seq)), "[^ACGT]", "N"), "ACGT", "TGCA"))


def canonical(forward: Column, backward: Column) -> tuple[Column, Column]:
    """The smaller of two hashes and which one it is: 0 for the first, also when they are equal."""
    return F.least(forward, backward), F.when(forward <= backward, 0).otherwise(1)


def mismatches(pattern: Column | str, text: Column | str) -> Column:
    """Places where two strings of equal length differ, case aside; one more than the length if they don't
    have equal lengths."""
    p, t = F.upper(_col(pattern)), F.upper(_col(text))
    pairs = F.zip_with(F.split(p, ""), F.split(t, ""), lambda a, b: F.when(a == b, 0).otherwise(1))
    same = F.when(F.length(p) == 0, 0).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x))
    return F.when(F.length(p) == F.length(t), same).otherwise(F.length(p) + 1)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Places where two arrays differ; the largest integer if their sizes do."""
    differ = F.size(F.filter(F.zip_with(_col(a), _col(b), lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    return F.when(F.size(_col(a)) == F.size(_col(b)), differ).otherwise(F.lit(2147483647))


def gc_content(seq: Column | str) -> Column:
    """G and C among A, C, G, T, in either case; 0 where there are none."""
    s = _col(seq)
    known = F.length(F.regexp_replace(s, "[^ACGTacgt]", ""))
    gc = F.length(F.regexp_replace(s, "[^GCgc]", ""))
    return F.when(known > 0, gc / known).otherwise(F.lit(0.0))


def kmers(seq: Column | str, k: int) -> Column:
    """The set of substrings of k characters, case kept."""
    s = _col(seq)
    many = F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k)))
    return F.when(F.length(s) >= k, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def iqr(values: Column | str) -> Column:
    """Distance of the quartiles of an array, by linear interpolation; 0 for fewer than four values."""
    v, n = F.array_sort(_col(values)), F.size(_col(values))

    def quantile(q: float) -> Column:
        at = F.lit(q) * (n - 1)
        low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
        a, b = F.get(v, low).cast("double"), F.get(v, high).cast("double")
        return a + (b - a) * (at - low)

    return F.when(n >= 4, quantile(0.75) - quantile(0.25)).otherwise(F.lit(0.0))


def wilson(successes: Column | str, total: Column | str, z: float = 1.96) -> Column:
    """A struct of point, ci_low and ci_high: the Wilson interval of a proportion, (0.5, 0, 1) for none."""
    k, n = _col(successes).cast("double"), _col(total).cast("double")
    p, zz = k / F.nullif(n, F.lit(0.0)), z * z
    middle = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    some = n > 0
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.struct(
        F.when(some, p).otherwise(0.5).alias("point"),
        F.when(some, clamp(middle - half)).otherwise(0.0).alias("ci_low"),
        F.when(some, clamp(middle + half)).otherwise(1.0).alias("ci_high"),
    )


def logistic(x: Column, mid: Column | float, slope: float) -> Column:
    return 1 / (1 + F.exp(-slope * (x - mid)))


def band(vaf: Column | str) -> Column:
    """Number of the band of an allele fraction; null for none (0 and less, over 1, null, not a number)."""
    v = _col(vaf)
    out = F.lit(None).cast("int")
    for i, (_, low, high) in reversed(list(enumerate(BANDS))):
        out = F.when((v > low) & (v <= high), i).otherwise(out)
    return F.when(~F.isnan(v.cast("double")), out)


def mapq(matches: Column, length: Column) -> Column:
    """60 times the share of matches, at most 60, cut to an integer; 0 where the length is 0."""
    return F.when(length > 0, F.least(F.lit(60), F.floor(60 * matches / length).cast("int"))).otherwise(0)
