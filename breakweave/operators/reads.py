"""Amplicon reads: CIGAR reports, corrections near the break, classes, reconstruction, and read errors.

All steps are column expressions. Reads carry read (bases) and cigar; the reference, and the distance of the break
from its left and right end, are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakweave.functions.sequence import longest_common_suffix


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len, op>>."""
    lens = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([A-Z])"), F.lit(1)), lambda x: x.cast("int"))
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+)([A-Z])"), F.lit(2))
    return F.zip_with(lens, ops, lambda n, o: F.struct(n.alias("len"), o.alias("op")))


def usable(reads: DataFrame) -> DataFrame:
    """Reads that are aligned and not clipped."""
    return reads.where(~F.col("cigar").rlike(r"[S*H]"))


def common_prefix(a: Column, b: Column) -> Column:
    return longest_common_suffix(F.reverse(a), F.reverse(b))


def report(rows: DataFrame, ref: str, left: int, right: int) -> DataFrame:
    """Adds deletions (0 or negative), insertion place and bases from the matched lengths m_left and m_right."""
    n = F.length("read")
    rows = rows.withColumn("del_left", F.least(F.col("m_left") - left, F.lit(0))).withColumn("del_right", F.least(F.col("m_right") - right, F.lit(0)))
    rows = rows.withColumn("del_total", F.col("del_left") + F.col("del_right"))
    rows = rows.withColumn("insert_start", F.least(F.col("m_left"), F.lit(left))).withColumn("insert_end", F.least(F.col("m_right"), F.lit(right)))
    size = F.greatest(n - F.col("insert_start") - F.col("insert_end"), F.lit(0))
    return rows.withColumn("insert_length", size).withColumn("insert_seq", F.substring("read", F.col("insert_start") + 1, F.col("insert_length")))


def extend_fake_insertions(rows: DataFrame, ref: str, left: int, right: int) -> DataFrame:
    """Inserted bases that equal the deleted ones next to a match are matches: m_left and m_right grow.

    With a deletion and an insertion side by side, the side that the CIGAR puts the deletion on grows.
    """
    seen = report(rows, ref, left, right)
    whole = F.lit(ref)
    start, stop = left + F.col("del_left"), F.length(whole) - (right + F.col("del_right"))
    lost = F.substring(whole, (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))
    seen = seen.withColumn("_lost", lost)
    ahead, behind = common_prefix(F.col("_lost"), F.col("insert_seq")), longest_common_suffix(F.col("_lost"), F.col("insert_seq"))
    first, last = F.get("ops", F.lit(0)), F.element_at("ops", -1)
    applies = (first["op"] == "M") & (last["op"] == "M") & (F.col("del_total") < 0) & (F.col("insert_length") > 0)
    four = F.size("ops") == 4
    at = lambda op: F.array_position(F.transform("ops", lambda o: o["op"]), op)
    grow_left = F.when(~four, F.col("del_left") < 0).otherwise(at("I") > at("D"))
    grow_right = F.when(~four, F.col("del_right") < 0).otherwise(at("I") < at("D"))
    return seen.withColumns(
        {
            "m_left": F.col("m_left") + F.when(applies & grow_left, ahead).otherwise(0),
            "m_right": F.col("m_right") + F.when(applies & grow_right, behind).otherwise(0),
        }
    ).drop("_lost")


def cut_near_mismatches(rows: DataFrame, ref: str, left: int, right: int, left_window: int, right_window: int) -> DataFrame:
    """A mismatch within the windows next to the break ends the match there; a read of one match is split at the break first."""
    whole, one = F.lit(ref), F.size("ops") == 1
    usable_ = ~(one & (F.length(whole) > F.length("read"))) & (F.get("ops", F.lit(0))["op"] == "M") & (F.element_at("ops", -1)["op"] == "M")
    a = F.when(one, F.lit(left)).otherwise(F.col("m_left"))
    b = F.when(one, F.lit(right)).otherwise(F.col("m_right"))
    base = lambda s, i: F.substring(s, i.cast("int"), F.lit(1))
    rows = rows.withColumn("_a", a).withColumn("_b", b)
    if left_window > 0:
        bad = F.filter(F.sequence(F.lit(1), F.lit(left_window)), lambda c: (c <= F.col("_a")) & (base(F.col("read"), F.col("_a") - c + 1) != base(whole, F.col("_a") - c + 1)))
        new_left = F.col("_a") - F.coalesce(F.array_max(bad), F.lit(0))
    else:
        new_left = F.col("_a")
    if right_window > 0:
        from_right = lambda s, i: base(s, F.length(s) - i + 1)
        bad = F.filter(F.sequence(F.lit(0), F.lit(right_window - 1)), lambda c: (c < F.col("_b")) & (from_right(F.col("read"), F.col("_b") - c) != from_right(whole, F.col("_b") - c)))
        new_right = F.when(F.size(bad) > 0, F.col("_b") - F.array_max(bad) - 1).otherwise(F.col("_b"))
    else:
        new_right = F.col("_b")
    rows = rows.withColumn("_l", new_left).withColumn("_r", new_right)
    unchanged = ~usable_ | (one & (F.col("_l") + F.col("_r") == F.length(whole)))
    return rows.withColumns(
        {"m_left": F.when(unchanged, F.col("m_left")).otherwise(F.col("_l")), "m_right": F.when(unchanged, F.col("m_right")).otherwise(F.col("_r"))}
    ).drop("_a", "_b", "_l", "_r")


def read_class(deleted: Column, inserted: Column) -> Column:
    return (
        F.when((deleted == 0) & (inserted == 0), "exact").when(deleted == 0, "insertion").when(inserted == 0, "deletion").otherwise("complex")
    )


def classify(reads: DataFrame, ref: str, left: int, right: int, left_window: int = 0, right_window: int = 0) -> DataFrame:
    """The whole chain of one read: matched lengths, corrections, report, class, reconstruction, working sequence.

    Reads whose working sequence has another length than the read go.
    """
    rows = usable(reads).withColumn("ops", cigar_ops(F.col("cigar"))).where(F.size("ops") > 0)
    rows = rows.withColumn("m_left", F.get("ops", F.lit(0))["len"]).withColumn("m_right", F.element_at("ops", -1)["len"])
    rows = extend_fake_insertions(rows, ref, left, right)
    rows = report(cut_near_mismatches(rows, ref, left, right, left_window, right_window), ref, left, right)
    rows = rows.withColumn("class", read_class(F.col("del_total"), F.col("insert_length")))
    whole = F.lit(ref)
    rebuilt = F.concat(F.left(whole, left + F.col("del_left")), "insert_seq", F.right(whole, right + F.col("del_right")))
    working = F.when(F.col("class") != "exact", rebuilt).when(F.length("read") == len(ref), whole).otherwise(F.col("read"))
    rows = rows.withColumn("working", working)
    # A plain filter would be pushed below the whole chain, with every step written out again and again.
    fits = F.when(F.length("working") == F.length("read"), F.array(F.struct(*rows.columns)))
    return rows.select(F.inline_outer(fits)).where("working is not null")


def junction_microhomology(rows: DataFrame, ref: str, left: int, right: int) -> DataFrame:
    """Adds mh: bases at the junction of a deletion that both sides of the reference share."""
    whole, work = F.lit(ref), F.col("working")
    before = F.when(F.col("m_right") < right, longest_common_suffix(F.left(work, F.col("m_left")), F.left(whole, F.greatest(F.length(whole) - F.col("m_right"), F.lit(0))))).otherwise(0)
    after = F.when(F.col("m_left") <= left - 1, common_prefix(F.right(work, F.col("m_right")), F.substring(whole, F.col("m_left") + 1, F.lit(1 << 30)))).otherwise(0)
    mh = F.concat(F.right(F.left(work, F.col("m_left")), before), F.left(F.right(work, F.col("m_right")), after))
    return rows.withColumn("mh", F.when(F.col("class") == "deletion", mh).otherwise(""))


def read_counts(rows: DataFrame) -> DataFrame:
    """working, reads, share_with_errors (percent)."""
    wrong = F.avg((F.col("read") != F.col("working")).cast("double")) * 100
    return rows.groupBy("working", "class").agg(F.count(F.lit(1)).alias("reads"), wrong.alias("error_percent"))


def read_errors(rows: DataFrame) -> DataFrame:
    """working, position (from 1), errors: where reads differ from their working sequence."""
    spots = F.filter(F.sequence(F.lit(1), F.greatest(F.length("read"), F.lit(1))), lambda i: F.substring("read", i, F.lit(1)) != F.substring("working", i, F.lit(1)))
    return rows.select("working", F.explode(spots).alias("position")).groupBy("working", "position").agg(F.count(F.lit(1)).alias("errors"))


def trim_and_pad(reads: DataFrame, five: str, three: str, left_pad: str = "", right_pad: str = "") -> DataFrame:
    """Cuts reads from the first 5' primer to the end of the last 3' primer and pads them; matched tells whether both were there in order."""
    a = F.instr("read", five)
    back = F.instr(F.reverse("read"), three[::-1])
    b = F.when(back > 0, F.length("read") - back - len(three) + 2).otherwise(0)
    ok = (a > 0) & (b > a)
    cut = lambda c: F.substring(c, a, b - a + len(three))
    padded = F.concat(F.lit(left_pad), cut(F.col("read")), F.lit(right_pad))
    scored = F.concat(F.lit("G" * len(left_pad)), cut(F.col("qual")), F.lit("G" * len(right_pad)))
    return reads.withColumn("matched", ok).withColumn("_r", F.when(ok, padded).otherwise(F.col("read"))).withColumn("_q", F.when(ok, scored).otherwise(F.col("qual"))).withColumn("read", F.col("_r")).withColumn("qual", F.col("_q")).drop("_r", "_q")


def sam_to_variants(reads: DataFrame, ref: str) -> DataFrame:
    """chr, pos, ref, alt of reads with exactly one insertion or deletion; others go."""
    rows = reads.withColumn("ops", cigar_ops(F.col("cigar")))
    edits = F.filter("ops", lambda o: o["op"].isin("I", "D"))
    rows = rows.withColumn("_e", edits).where(F.size("_e") == 1).withColumn("e", F.get("_e", F.lit(0)))
    at = F.array_position(F.transform("ops", lambda o: o["op"]), F.col("e.op")).cast("int")
    rows = rows.withColumn("pos", F.aggregate(F.filter(F.slice("ops", F.lit(1), at - 1), lambda o: o["op"] == "M"), F.lit(0), lambda acc, o: acc + o["len"]))
    whole, deleted = F.lit(ref), F.col("e.op") == "D"
    r = F.when(deleted, F.substring(whole, F.col("pos") + 1, F.col("e.len") + 1)).otherwise(F.substring(whole, F.col("pos"), F.lit(1)))
    a = F.when(deleted, F.substring("read", F.col("pos") + 1, F.lit(1))).otherwise(F.substring("read", F.col("pos"), F.col("e.len") + 1))
    return rows.select("chr", "pos", r.alias("ref"), a.alias("alt"))


def called_deletions(calls: DataFrame, ref: str, name: str, shift: int = 0) -> DataFrame:
    """Variants of another tool's deletion table (id, left, right: bases left + 1 to right are gone), a contig a call."""
    whole = F.lit(ref)
    lost = F.substring(whole, F.col("left"), F.col("right") - F.col("left") + 1)
    return calls.select(
        F.concat(F.lit(name), F.col("id").cast("string")).alias("chr"),
        (F.col("left") + shift).cast("long").alias("pos"),
        lost.alias("ref"),
        F.substring(whole, F.col("left"), F.lit(1)).alias("alt"),
    ).where(F.col("left") > 0)


def called_insertions(calls: DataFrame, name: str, shift: int = 0) -> DataFrame:
    """The same of its insertion table (id, left, right, reconstructed): the read's bases from left to right - 1."""
    return calls.select(
        F.concat(F.lit(name), F.col("id").cast("string")).alias("chr"),
        (F.col("left") + shift).cast("long").alias("pos"),
        F.substring("reconstructed", F.col("left"), F.lit(1)).alias("ref"),
        F.substring("reconstructed", F.col("left"), F.col("right") - F.col("left")).alias("alt"),
    ).where(F.col("left") > 0)


def call_genome(calls: DataFrame, body: str, before: str, after: str, trim: int = 79) -> DataFrame:
    """chr, seq: a contig for each call, its reference (a column or text) trimmed and set between two flanks."""
    inner = F.col(body) if body in calls.columns else F.lit(body)
    return calls.select("chr", F.concat(F.lit(before), F.substring(inner, F.lit(trim + 1), F.length(inner) - 2 * trim), F.lit(after)).alias("seq"))
