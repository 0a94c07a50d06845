"""Personal data by fixed patterns and bootstrapped contexts, in DataFrame operations only.

Spans of e-mail addresses, IP addresses, card and phone numbers, and a part of the keys (long hexadecimal strings), are
the seed entities. Every other token that holds a digit or an @ is an instance that may be one. The words around an
entity or instance are its lexical patterns: the word or two before it, the word after it, the words on both sides.
Patterns and instances form a graph that is scored in rounds. A pattern is as good for a kind as the share of trusted
instances among all tokens that stand in it anywhere in the corpus, so that words like `the`, before a few numbers and
much else, fall out; an instance is as good as its best pattern; instances that good patterns reach are trusted in the
next round and found patterns of their own. Tokens that stand in a high-confidence pattern in the end are the
identifiers that the contexts discover. Keys outside the seeds' part are only found that way, which measures recall.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakweave.llm.common import hot_join, materialise

KINDS = ("email", "ip", "card", "phone")
#: Kinds of discovered spans: those, and keys, which have seeds but no fixed pattern of their own.
FOUND_KINDS = (*KINDS, "secret")
SEED_SECRET = r"^(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}$"
LOCAL = r"[A-Za-z0-9._%+-]"
#: The patterns, with possessive repeats and a check that a match begins where a run begins (or where the match
#: before it ended): the same matches as the plain patterns', in linear time on long runs.
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A word with a digit or an @.
TOKEN = r"(?<!\S)(?=[^\s0-9@]*[0-9@])\S+"
SPAN = "array<struct<start:int,end:int,token:string>>"
INSTANCE = "array<struct<start:int,end:int,token:string,before:string,wide:string,after:string>>"
#: Matches that are put together before they join the list of a text, so that long lists are not copied match by match.
BLOCK = 256


def in_blocks(steps: Column, kind: str, one: Callable[[Column, Column, Column], Column]) -> Column:
    """The list that `one` (step, start, end) makes of steps (gap, token, ...), whose starts are sums of what stands before.

    Steps are taken in blocks of BLOCK: a block's list is short, and the whole list is put together once a block.
    """
    n = F.size(steps)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest((n - 1) / BLOCK, F.lit(0)).cast("int")), lambda k: F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["token"]), F.lit(0))
        return F.struct(end.alias("at"), F.when(x["token"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one(x, begin, end)))).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        made = F.aggregate(part, F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out")), step)
        return F.struct(made["at"].alias("at"), F.concat(acc["out"], made["out"]).alias("out"))

    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), block, lambda acc: acc["out"])


def located(text: Column, pattern: str) -> Column:
    """Start, end and text of all matches, in code points: what stands between the matches tells where they are."""
    between = F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece))
    steps = F.arrays_zip(between.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("token"))
    return in_blocks(steps, SPAN, lambda x, begin, end: F.struct(begin.alias("start"), end.alias("end"), x["token"].alias("token")))


def instances(text: Column) -> Column:
    """The identifier-like tokens with the word and the two words before them and the word after them, lower-cased."""
    pieces = F.split(text, TOKEN, -1)
    last = r"(?<!\S)(\S++)\s++$"
    gaps = F.transform(pieces, lambda p: F.length(p))
    before = F.transform(pieces, lambda p: F.lower(F.regexp_extract(p, last, 1)))
    wide = F.transform(pieces, lambda p: F.lower(F.regexp_extract(p, r"(?<!\S)\S++\s++\S++(?=\s++$)", 0)))
    after = F.slice(F.transform(pieces, lambda p: F.lower(F.regexp_extract(p, r"^\s++(\S++)", 1))), 2, 1 << 30)
    steps = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(TOKEN), 0).alias("token"), before.alias("before"), wide.alias("wide"), after.alias("after"))

    def one(x: Column, begin: Column, end: Column) -> Column:
        return F.struct(begin.alias("start"), end.alias("end"), x["token"].alias("token"), x["before"].alias("before"), x["wide"].alias("wide"), x["after"].alias("after"))

    return in_blocks(steps, INSTANCE, one)


def digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def luhn(token: Column) -> Column:
    """Whether the digits' check sum holds."""
    figures = F.transform(F.split(F.reverse(digits(token)), ""), lambda d: d.try_cast("int"))
    valued = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(valued, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0))) % 10 == 0


def passing(kind: str) -> Callable[[Column], Column]:
    """What a match of a kind has to be besides."""
    if kind == "ip":
        return lambda s: s["token"].rlike(rf"^{BYTE_PART}(?:\.{BYTE_PART}){{3}}$")
    if kind == "card":
        return lambda s: luhn(s["token"])
    if kind == "phone":
        return lambda s: F.length(digits(s["token"])).between(9, 15)
    return lambda s: F.lit(True)


def numbered(n: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(n).alias("k"), s["start"].alias("start"), s["end"].alias("end"))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, the spans of each kind, and the identifier-like tokens that no span touches or that are spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    none = F.array().cast(SPAN)
    hint = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+")), "ip": F.col("text").rlike(PATTERNS["ip"]), "card": F.col("text").rlike(PATTERNS["card"])}
    found = rows.select(
        "doc_id",
        *[F.when(hint[k], F.filter(located(F.col("text"), PATTERNS[k]), passing(k))).otherwise(none).alias(k) for k in KINDS],
        F.when(F.col("text").rlike("[0-9@]"), instances(F.col("text"))).otherwise(F.array().cast(INSTANCE)).alias("tokens"),
    )
    return found.withColumn("row", F.monotonically_increasing_id())


def could_be(token: Column) -> Column:
    """The kinds that an instance's characters allow; None of them for ordinary numbers."""
    n, letters = F.length(digits(token)), F.length(F.regexp_replace(token, r"[^\p{L}]", ""))
    marked = token.rlike(r"@|\[at\]|\(at\)")
    numeric = letters == 0
    tests = [
        ("email", marked & (letters > 0)),
        ("ip", numeric & token.rlike(r"^[0-9]+(?:[.:,][0-9]+){3,}$")),
        ("card", numeric & n.between(12, 19)),
        ("phone", numeric & n.between(6, 15) & ~token.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")),
        ("secret", ~marked & (letters > 0) & (n > 0) & (F.length(token) >= 12)),
    ]
    return F.filter(F.array(*[F.when(test, F.lit(kind)) for kind, test in tests]), lambda k: k.isNotNull())


def occurrences(rows: DataFrame, seed_share: float = 0.8) -> DataFrame:
    """A row for each instance and pattern: row, start, end, token, kind (of the seed that it is), kinds (it could be), pattern.

    A seed of several tokens is one instance, with the words before its first and after its last token. Around other
    tokens quotes and marks are cut off. Missing neighbours make no pattern. Of the keys, those whose hash falls into the
    first `seed_share` of its range are seeds.
    """
    each = rows.where(F.size("tokens") > 0).select("row", *KINDS, F.explode("tokens").alias("t"))
    hits = F.concat(*[F.transform(F.filter(k, lambda s: (s["start"] < F.col("t.end")) & (s["end"] > F.col("t.start"))), seeded(k)) for k in KINDS])
    each = each.select("row", "t", F.get(hits, F.lit(0)).alias("seed"))
    head = F.length(F.regexp_extract("t.token", r"^[^\p{L}\p{N}+(@]*", 0))
    bare = F.regexp_replace("t.token", r"^[^\p{L}\p{N}+(@]+|[^\p{L}\p{N})]+$", "")
    each = each.withColumn("bare", bare).withColumn("head", head).where("seed is not null or bare <> ''")
    sown = F.pmod(F.crc32(F.lower("bare")), F.lit(1000)) < int(1000 * seed_share)
    own = F.when(F.col("bare").rlike(SEED_SECRET) & sown, F.lit("secret"))
    first, final = F.col("seed").isNull() | (F.col("t.start") <= F.col("seed.start")), F.col("seed").isNull() | (F.col("t.end") >= F.col("seed.end"))
    pattern = lambda tag, *words: F.when(F.forall(F.array(*words), lambda w: w != ""), F.concat_ws(" ", F.lit(tag), *words))
    patterns = F.array(
        F.when(first, pattern("before", F.col("t.before"))),
        F.when(first, pattern("before2", F.col("t.wide"))),
        F.when(final, pattern("after", F.col("t.after"))),
        F.when(first & final, pattern("around", F.col("t.before"), F.col("t.after"))),
    )
    known = each.select(
        "row",
        F.coalesce(F.col("seed.start"), F.col("t.start") + F.col("head")).alias("start"),
        F.coalesce(F.col("seed.end"), F.col("t.start") + F.col("head") + F.length("bare")).alias("end"),
        F.lower(F.coalesce("seed.token", "bare")).alias("token"),
        F.coalesce("seed.kind", own).alias("kind"),
        F.col("seed").isNotNull().alias("base"),
        F.when(F.coalesce("seed.kind", own).isNull(), could_be(F.col("bare"))).alias("kinds"),
        F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"),
    )
    return known.where("kind is not null or size(kinds) > 0").select("*", F.explode_outer("patterns").alias("pattern")).drop("patterns")


def seeded(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token"))


def totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, total: how many tokens of any form stand in each of the `patterns` (a row each) in all texts."""
    words = docs.select(F.split(F.lower(F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\s+", " "))), " ").alias("w"))
    # A word with the two after it; at a text's end the missing ones are null, and concat() gives no pattern.
    three = words.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, 1 << 30).alias("b"), F.slice("w", 3, 1 << 30).alias("c"))).alias("t")).where("t.b is not null")
    a, b, c = F.col("t.a"), F.col("t.b"), F.col("t.c")
    each = three.select(F.explode(F.array(F.concat(F.lit("before "), a), F.concat(F.lit("before2 "), F.when(c.isNotNull(), a), F.lit(" "), b), F.concat(F.lit("after "), b), F.concat(F.lit("around "), a, F.lit(" "), c))).alias("pattern"))
    return hot_join(each.where("pattern is not null"), patterns, ["pattern"]).groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))


def good_patterns(seen: DataFrame, docs: DataFrame, rounds: int, least: float, support: int) -> DataFrame:
    """pattern, kind, score: patterns of high confidence, once for each kind that they are good for.

    Counts are over occurrences, aggregated before the shuffle. In a round a pattern's score for a kind is the sum of the
    trust in what stands in it over the number of all tokens that do, if at least `support` different ones are trusted.
    What it reaches has its score as trust from then on, so that instances found in one round found patterns in the next.
    """
    spark = seen.sparkSession
    kinds = F.when(F.col("kind").isNotNull(), F.array("kind")).otherwise(F.col("kinds"))
    each = seen.where("pattern is not null").select("pattern", "token", F.explode(kinds).alias("kind"), F.col("kind").isNotNull().cast("double").alias("seed"))
    edges = materialise(each.groupBy("pattern", "token", "kind").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")), spark, "pii-edges")
    # Without `support` instances, whatever their trust, a pattern is never good: it is not counted in the texts.
    wide = edges.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("tokens")).where(F.col("tokens") >= support).select("pattern").distinct()
    counted = materialise(totals(docs, materialise(wide, spark, "pii-wide")), spark, "pii-totals")
    edges = materialise(hot_join(edges, counted, ["pattern"]), spark, "pii-graph")
    trusted = edges.where("seed > 0").select("token", "kind", "seed").distinct().withColumnRenamed("seed", "trust")
    for k in range(rounds):
        scored = (
            edges.join(trusted, ["token", "kind"], "left")
            .withColumn("trust", F.coalesce("trust", F.lit(0.0)))
            .groupBy("pattern", "kind")
            .agg(F.max("total").alias("total"), F.sum(F.col("trust") * F.col("n")).alias("s"), F.count_if(F.col("trust") >= least).alias("sure"))
            # A seed of several tokens is one occurrence, its words are more: no score is above 1.
            .where((F.col("sure") >= support) & (F.col("s") >= least * F.col("total")))
            .select("pattern", "kind", F.least(F.col("s") / F.col("total"), F.lit(1.0)).alias("score"))
        )
        scored = materialise(scored, spark, "pii-patterns")
        if k + 1 < rounds:
            reached = hot_join(edges.select("pattern", "token", "kind"), scored, ["pattern", "kind"]).groupBy("token", "kind").agg(F.max("score").alias("trust"))
            seeds = edges.where("seed > 0").select("token", "kind", F.col("seed").alias("trust"))
            trusted = materialise(reached.unionByName(seeds).groupBy("token", "kind").agg(F.max("trust").alias("trust")), spark, "pii-trust")
    return scored


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_private(docs: DataFrame, rounds: int = 3, least: float = 0.4, support: int = 3, seed_share: float = 0.8) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found for every document.

    Base spans are the patterns' matches; discovered spans are added under the kind that their pattern is good for
    (keys as `secret`) and never overlap base ones. n_found counts them. Null and empty texts have no spans; rows with repeated or null ids stay apart; an
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = materialise(scanned(docs), spark, "pii-spans")
    seen = occurrences(rows, seed_share)
    good = good_patterns(seen, docs, rounds, least, support)
    order = F.array(*map(F.lit, FOUND_KINDS))
    may = seen.where("not base and pattern is not null").withColumn("kind", F.explode(F.when(F.col("kind").isNotNull(), F.array("kind")).otherwise(F.col("kinds"))))
    fresh = hot_join(may, good, ["pattern", "kind"])
    # A token's kind is that of its best pattern, the first by order if several are as good; a row's tokens bound the list.
    place = F.struct(F.col("score"), -F.array_position(order, F.col("kind")).cast("int"))
    fresh = fresh.groupBy("row", "start", "end").agg((-F.max(place)["col2"]).alias("k"))
    found = fresh.groupBy("row").agg(F.collect_list(F.struct("k", "start", "end")).alias("found"))
    base = F.concat(*[F.transform(k, numbered(n)) for n, k in enumerate(KINDS, 1)])
    named = lambda spans: joined_spans(F.transform(spans, lambda s: F.struct(F.get(order, s["k"] - 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    both = rows.select("row", "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base")).join(found, "row", "left")
    return both.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sha2(named(F.col("base")), 256).alias("base_sha256"),
        named(F.sort_array(F.when(F.col("found").isNull(), F.col("base")).otherwise(F.concat("base", "found")))).alias("spans"),
        F.when(F.col("found").isNull(), 0).otherwise(F.size("found")).cast("long").alias("n_found"),
    )
