"""Scalar functions on DNA strings and indels, as Column expressions.

All of them give null for null inputs unless they say otherwise; empty strings are ordinary strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Half windows in bp: neighbourhood of a motif, and the context of the Markov model.
LARGE_WINDOW = 1000


def lit(x: Column | int | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def fetch(seq: Column, start: Column | int, end: Column | int, base: Column | int = 0) -> Column:
    """Bases [start, end) counted from 0, of a sequence whose first base has number `base`; starts below `base` are cut."""
    first = F.greatest(lit(start) - lit(base), F.lit(0))
    return F.substring(seq, (first + 1).cast("int"), F.greatest(lit(end) - lit(base) - first, F.lit(0)).cast("int"))


def reverse_complement(seq: Column) -> Column:
    """Other letters than ACGT stay as they are."""
    return F.reverse(F.translate(seq, "ACTG", "TGAC"))


def complement(seq: Column) -> Column:
    """Upper case; letters other than ACGT become N."""
    return F.regexp_replace(F.translate(F.upper(seq), "ACGT", "TGCA"), "[^ACGT]", "N")


def ancestral_allele(ref: Column, alt: Column, state: Column) -> Column:
    """State 0: REF is ancestral, 1: ALT; anything else has none."""
    return F.when(state == 0, ref).when(state == 1, alt)


def derived_allele(ref: Column, alt: Column, state: Column) -> Column:
    return F.when(state == 0, alt).when(state == 1, ref)


def ancestral_state(freq_ref: Column, freq_alt: Column) -> Column:
    """The more frequent allele is ancestral; 2 marks a tie."""
    return F.when(freq_ref > freq_alt, 0).when(freq_alt > freq_ref, 1).when(freq_ref == freq_alt, 2)


def frequency_value(text: Column) -> Column:
    """The number of `A:0.3`, or of a plain number."""
    return F.element_at(F.split(text, ":"), -1).try_cast("double")


def indel_type(anc: Column, der: Column) -> Column:
    return F.when(F.length(anc) > F.length(der), "DEL").when(F.length(anc) < F.length(der), "INS")


def indel_length(anc: Column, der: Column) -> Column:
    return F.abs(F.length(anc) - F.length(der))


def signed_length(kind: Column, length: Column) -> Column:
    """Negative for deletions."""
    return F.when(kind == "DEL", -length).otherwise(length)


def variant_id(chrom: Column, original_pos: Column) -> Column:
    return F.concat_ws("_", chrom, original_pos)


def anchored(allele: Column, anchor: Column) -> Column:
    """Alleles with the base before them; '', '.' and '-' stand for no bases."""
    return F.concat(anchor, F.when(allele.isin("", ".", "-"), "").otherwise(allele))


def unanchored(allele: Column) -> Column:
    """Alleles without their first base, '-' if nothing is left."""
    rest = F.substring(allele, 2, 1 << 30)
    return F.when(rest == "", "-").otherwise(rest)


def spliced(context: Column, window: Column | int, removed: Column, put: Column) -> Column:
    """The context with the bases from `window` (from 0) on, as many as `removed` has, replaced by `put`."""
    w = lit(window)
    tail = F.substring(context, (w + F.length(removed) + 1).cast("int"), F.lit(1 << 30))
    return F.concat(F.substring(context, F.lit(1), w.cast("int")), put, tail)


def _ends(text: bytes, letters: np.ndarray, motif: bytes) -> np.ndarray:
    """End offsets of all occurrences: the last two letters are looked for at once, longer motifs by their rare places."""
    k = len(motif)
    if k == 0 or k > len(text):
        return np.empty(0, np.int32)
    ends = np.flatnonzero(letters[k - 1 :] == motif[-1]) + k
    for back in range(2, k + 1):
        if not len(ends):
            break
        ends = ends[letters[ends - back] == motif[-back]]
    return ends.astype(np.int32)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def ends_udf(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The end offsets of each of a row's motifs in its sequence; null for null ones."""
    for seqs, lists in batches:
        cuts, offsets, ends, nulls = [0], [0], [np.empty(0, np.int32)], []
        at = 0
        for seq, motifs in zip(seqs.to_pylist(), lists.to_pylist(), strict=True):
            text = (seq or "").encode()
            letters = np.frombuffer(text, np.uint8)
            for motif in motifs or []:
                missing = seq is None or motif is None
                found = np.empty(0, np.int32) if missing else _ends(text, letters, motif.encode())
                at += len(found)
                ends.append(found)
                offsets.append(at)
                nulls.append(missing)
            cuts.append(len(nulls))
        mask = pa.array(nulls, pa.bool_()) if any(nulls) else None
        inner = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ends), pa.int32()), mask=mask)
        yield pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), inner)


def all_motif_ends(seq: Column, motifs: Column) -> Column:
    """For an array of motifs, the end offsets of all occurrences of each, in one pass over the batch."""
    return ends_udf(seq, motifs)


def motif_ends(seq: Column, motif: Column) -> Column:
    """End offsets of all occurrences, overlapping ones too; none for an empty motif. Motifs are letters."""
    return F.get(ends_udf(seq, F.array(motif)), F.lit(0))


def motif_count(seq: Column, motif: Column) -> Column:
    return F.size(motif_ends(seq, motif))


def motif_positions(ends: Column, small: Column) -> Column:
    """Positions from the break for a context of twice LARGE_WINDOW bases: the base after the break is 0."""
    centred = F.transform(ends, lambda e: e - LARGE_WINDOW)
    return F.transform(F.filter(centred, lambda p: (p > -small) & (p < small)), lambda p: p - 1)


def motif_frequency(count: Column, window: Column | int, motif: Column) -> Column:
    """Occurrences over window minus motif length, although both sides of the break are scanned."""
    return F.round(count / (lit(window) - F.length(motif)), 5)


def motif_gaps(ends: Column, motif: Column) -> Column:
    """From each occurrence's end to the start of the next one that does not overlap it."""
    k = F.length(motif)
    # Ends differ by one at least, so the next one that does not overlap is among the k after it.
    after = F.transform(ends, lambda e, i: F.get(F.filter(F.slice(ends, i + 2, k), lambda x: x >= e + k), F.lit(0)) - k - e)
    return F.filter(after, lambda g: g.isNotNull())


def motif_score(seq: Column, motif: Column, window: int, at: Column) -> Column:
    """How much likelier a homology than an end joining puts a break at `at` (from 0, after the middle of `seq`).

    Homology: all places of the motif in the window are alike. End joining: falls as one over the distance.
    """
    half = F.bround(F.length(seq) / 2).cast("int")
    places = F.transform(motif_ends(F.substring(seq, half + 1, F.lit(window)), motif), lambda e: e - F.length(motif))
    share = F.when(F.array_contains(places, at), 1 / F.size(places)).otherwise(0.0)
    decay = 1 / (at + 1) / window
    return share / (share + decay)


def accession_context(context: Column, window: int, kind: Column, ref: Column, alt: Column) -> Column:
    """The context with a deletion's REF taken out at window - 1, or an insertion's ALT put in at window + 1."""
    cut = spliced(context, window - 1, ref, F.lit(""))
    put = spliced(context, window + 1, F.lit(""), alt)
    return F.when(kind == "DEL", cut).when(kind == "INS", put)


def repeat_unit(seq: Column) -> Column:
    """The shortest string of which the sequence is a whole number of copies."""
    n = F.length(seq)
    fits = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (n % i == 0) & (F.repeat(F.substring(seq, F.lit(1), i), (n / i).cast("int")) == seq))
    return F.substring(seq, F.lit(1), F.get(fits, F.lit(0)))


def gc_content(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.length(F.regexp_replace(seq, "[^GC]", "")) / F.length(seq))


def length_bin(length: Column) -> Column:
    n = length
    return (
        F.when(n < 10, n.cast("string")).when(n < 15, "10<=Indel<15").when(n < 30, "15<=Indel<30").when(n >= 30, "30<=Indel")
    )


def signed_length_bin(length: Column) -> Column:
    return F.when(length > 10, "[11:inf]").when(length < -10, "[inf:-11]").otherwise(length.cast("string"))


def certain(probability: Column, relative: Column, least: float, least_relative: float) -> Column:
    return (probability >= least) & (relative >= least_relative)


def type_by_frequency(alt: Column, alt_frequency: Column, cutoff: float) -> Column:
    """Of the first alternative allele: frequent and longer than a base means that the reference lost bases."""
    return F.when((alt_frequency > cutoff) & (F.length(F.get(F.split(alt, ","), F.lit(0))) > 1), "DEL").otherwise("INS")


def context_key(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit(">"), chrom, F.lit(":"), start, F.lit("-"), end)


def longest_common_suffix(a: Column, b: Column) -> Column:
    """How many last bases agree: matches are nested, so it is the number of lengths that match. Most rows are done after one base."""
    most = F.least(F.length(a), F.length(b))
    longer = F.size(F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: (k <= most) & (F.right(a, k) == F.right(b, k))))
    return F.when((most == 0) | (F.right(a, F.lit(1)) != F.right(b, F.lit(1))), 0).otherwise(longer)


#: Nearest-neighbour enthalpy (kcal/mol) and entropy (cal/mol K) of DNA stacks, unified table of 1998.
STACKS = {
    "AA": (-7.9, -22.2),
    "AT": (-7.2, -20.4),
    "TA": (-7.2, -21.3),
    "CA": (-8.5, -22.7),
    "GT": (-8.4, -22.4),
    "CT": (-7.8, -21.0),
    "GA": (-8.2, -22.2),
    "CG": (-10.6, -27.2),
    "GC": (-9.8, -24.4),
    "GG": (-8.0, -19.9),
}


def melting_temperature(seq: Column, strand_nanomolar: float = 25.0, sodium_millimolar: float = 50.0) -> Column:
    """Nearest-neighbour melting temperature in degrees Celsius, with the salt correction of the entropy; null below 2 bases."""
    from math import log

    table = {}
    for pair, value in STACKS.items():
        other = pair[::-1].translate(str.maketrans("ACGT", "TGCA"))
        table[pair] = table[other] = value
    n = F.length(seq)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(seq, i, F.lit(2)))
    lookup = [F.create_map(*[x for p, v in sorted(table.items()) for x in (F.lit(p), F.lit(v[k]))]) for k in (0, 1)]
    ends = [F.left(seq, F.lit(1)), F.right(seq, F.lit(1))]
    h = sum(F.when(e.isin("A", "T"), 2.3).otherwise(0.1) for e in ends)
    s = sum(F.when(e.isin("A", "T"), 4.1).otherwise(-2.8) for e in ends)
    h = h + F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.coalesce(F.try_element_at(lookup[0], p), F.lit(0.0)))
    s = s + F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.coalesce(F.try_element_at(lookup[1], p), F.lit(0.0)))
    s = s + 0.368 * (n - 1) * log(sodium_millimolar / 1000)
    strands = (strand_nanomolar - strand_nanomolar / 2) * 1e-9
    return F.when(n > 1, 1000 * h / (s + 1.987 * log(strands)) - 273.15)
