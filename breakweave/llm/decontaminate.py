"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names and units become typed placeholders, so a question whose parameters were changed keeps its
template. Windows of template tokens are hashed and joined with the windows of the benchmark. Windows that line up
with an item, allowing for a few words put in or left out, make a candidate; the slots inside them are then
compared: an item's value must be replaced by one and the same value of the document throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakweave.llm.common import BROADCAST_ROWS, materialise

#: Units of measurement and money that stand after a number.
UNITS = (
    "km|m|cm|mm|mi|mile|miles|ft|feet|inch|inches|kg|g|mg|lb|lbs|t|l|ml|s|sec|second|seconds|min|minute|minutes|h|hour|hours|"
    "day|days|week|weeks|month|months|year|years|percent|dollar|dollars|euro|euros|usd|eur|kw|kwh|w|v|a|hz|mb|gb|tb|c|f"
)
MARK = "\u0001"
NUMBER, NAME, UNIT = "NUM", "NAME", "UNIT"
SLOTS = (NUMBER, NAME, UNIT)
#: Window widths, in tokens. An item of n tokens takes the first one that is at most a third of n, or at most n.
WIDTHS = (8, 4, 2, 1)
#: Items below this length must be found whole, word for word.
SHORT = 8
#: Words besides slots that a window needs, as a share of its width, to count whatever its slots hold.
LEAST_WORDS = 0.5
#: Windows in line that make a leak by themselves, of items for which `coverage` would ask for more.
LONG_RUN = 13
#: Tokens by which the windows of one leak may be out of step.
DRIFT = 8
#: Benchmark windows up to which they are broadcast (a hash and two numbers each: about 8 MB at most).
BROADCAST_WINDOWS = 250_000


def with_clean(frame: DataFrame, head: bool = False) -> DataFrame:
    """Adds clean (from `text`) and digits. Each step is a column of its own, so that no step is computed twice.

    clean has words and numbers with single spaces; a name (capitalised words inside a sentence) carries a mark and is
    one token, as is a unit written next to its number. With head=True a capitalised first word is a name as well.
    """
    some = F.col("digits")  # the steps on numbers are left out where there are none
    text = frame.withColumn("clean", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("digits", F.col("clean").rlike("[0-9]"))
    text = text.withColumn("clean", F.regexp_replace("clean", r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll}\p{N},;:]\s{1,8})", MARK))
    text = text.withColumn("clean", F.when(some, F.regexp_replace("clean", r"(?<=[0-9])[.,:/'](?=[0-9])", "")).otherwise(F.col("clean")))
    text = text.withColumn("clean", F.trim(F.regexp_replace("clean", rf"[^\p{{L}}\p{{N}}%$€£{MARK}]+", " ")))
    if head:
        text = text.withColumn("clean", F.regexp_replace("clean", r"^(?=\p{Lu}\p{Ll})", MARK))
    text = text.withColumn("clean", F.regexp_replace("clean", rf"(?<={MARK})([^ ]+) (?={MARK})", "$1_"))
    unit = rf"(?<=[0-9])(?<!\p{{L}}[0-9]{{1,9}})(?=(?i:{UNITS})(?![^ ]))"
    return text.withColumn("clean", F.when(some, F.regexp_replace("clean", unit, " ")).otherwise(F.col("clean")))


def words_of(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def with_template(frame: DataFrame, column: str, names: bool = True) -> DataFrame:
    """Adds the tokens with typed placeholders, one for each token of `raw`; with names=False names are ordinary words."""
    low = F.lower("clean")
    out = frame.withColumn("_low", F.regexp_replace(low, rf"{MARK}[^ ]+", NAME) if names else F.regexp_replace(low, MARK, ""))
    numbers = F.regexp_replace("_low", r"(?<![^ ])[$€£]?[0-9]+[%€£$]?(?![^ ])", NUMBER)
    units = F.regexp_replace(numbers, rf"(?<={NUMBER} )(?:{UNITS})(?![^ ])", UNIT)
    out = out.withColumn("_low", F.when(F.col("digits"), units).otherwise(F.col("_low")))
    return out.withColumn(column, words_of(F.col("_low"))).drop("_low")


def raw() -> Column:
    """The tokens of `clean` as they are, lower-cased, without marks."""
    return words_of(F.replace(F.lower("clean"), F.lit(MARK), F.lit("")))


def joined(a: Column, b: Column) -> Column:
    """A hash of two hashes in order."""
    return F.xxhash64(a, b)


def doubled(windows: str, width: int) -> Column:
    """The hashes of windows of twice the width from those of `width` in a column."""
    held = F.col(windows)
    return F.transform(F.slice(held, F.lit(1), F.greatest(F.size(held) - width, F.lit(0))), lambda h, i: joined(h, F.get(held, i + width)))


def with_windows(frame: DataFrame, widths: list[int]) -> DataFrame:
    """Adds w1, w2, ..., the hashes of all windows of each width from `tokens`, as far as the widest asked for.

    A window's hash comes from those of its halves; each step is a column of its own, so that none is computed twice.
    """
    out = frame.withColumn("w1", F.transform("tokens", lambda t: F.xxhash64(t)))
    width = 1
    while width < max(widths, default=1):
        out = out.withColumn(f"w{2 * width}", doubled(f"w{width}", width))
        width *= 2
    return out


def dealt_windows(frame: DataFrame, widths: list[int], *keep: str) -> DataFrame:
    """keep, pos, hash: a row a window; null hashes where a width has no window at a place.

    Windows of all widths that start at a token come from one row; their hashes don't tell the widths apart, nor need to.
    """
    held = with_windows(frame, widths).select(*keep, F.arrays_zip(*[f"w{w}" for w in widths]).alias("zipped"))
    # posexplode() would have its input tested for emptiness first, and so computed twice; empty texts' nulls meet nothing.
    each = held.select(*keep, F.posexplode_outer("zipped").alias("pos", "w"))
    hashes = [F.col(f"w.w{w}") for w in widths]
    return each.select(*keep, "pos", F.stack(F.lit(len(widths)), *hashes).alias("hash"))


def is_slot(token: Column) -> Column:
    return token.isin(*SLOTS)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item, item_id, raw, tokens, plain (tokens without names), n, width of each item text that holds any token.

    An item that begins with a capital has two rows: its first word may be a name.
    """
    known = benchmark.where("item_id is not null").select("item_id", "text").distinct()
    rows = with_clean(known).unionByName(with_clean(known, head=True)).select("item_id", "clean", "digits").distinct()
    made = with_template(with_template(rows.withColumn("raw", raw()), "tokens"), "plain", False).drop("clean", "digits")
    n = F.size("tokens")
    width = F.lit(1)
    for w in reversed(WIDTHS):
        width = F.when((n >= 3 * w) | ((n >= w) & (n < SHORT)), w).otherwise(width)
    made = made.where(n > 0).withColumn("n", n).withColumn("width", F.when(n < SHORT, width).otherwise(F.greatest(width, F.lit(4))))
    return made.withColumn("item", F.xxhash64("item_id", "raw", "tokens"))


def benchmark_windows(items: DataFrame, widths: list[int]) -> DataFrame:
    """item, item_pos, hash: the windows of both ways to read an item, with and without names."""
    readings = F.explode(F.array("tokens", "plain")).alias("tokens")
    parts = [dealt_windows(items.where(F.col("width") == w).select("item", readings), [w], "item") for w in widths]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.where("hash is not null").select("item", F.col("pos").alias("item_pos"), "hash").distinct()


def template_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, key: str = "doc_id") -> DataFrame:
    """A row for each document and benchmark item whose template the document holds.

    doc_id (or `key`), item_id, start (token of the document where the item would begin, from 0), windows (matched),
    n_windows, n_slots, n_changed, kind ('verbatim', or 'reparameterised' if a slot's value differs).

    An item counts if at least `coverage` of its windows, or LONG_RUN of them, are found in order and out of step by
    at most DRIFT tokens, and each slot value inside them stands for one value of the document. A window that is
    mostly slots must hold the item's own values. Items of under SHORT tokens must be found whole, word for word.
    Null and empty texts match nothing, and so do items without a letter or digit; documents and items without an
    id are passed over, since no row could name them; rows that repeat an id are judged together, one by one where
    their texts differ; an empty table on either side gives an empty result; other columns are not read.
    """
    # The benchmark's side is written once: it is small, and its steps would stand in the plan once a use.
    items = materialise(items_of(benchmark), docs.sparkSession, "benchmark-items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect()) or [max(WIDTHS)]  # four numbers at most
    windows = materialise(benchmark_windows(items, widths), docs.sparkSession, "benchmark-windows")
    if windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        windows = F.broadcast(windows)
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), "text")
    told = with_template(with_clean(rows), "tokens").select("id", F.xxhash64("text").alias("text_id"), "tokens")
    dealt = dealt_windows(told, widths, "id", "text_id").withColumnRenamed("pos", "doc_pos")
    hits = dealt.join(windows, "hash").select("id", "text_id", "item", "item_pos", "doc_pos")
    shifts = hits.groupBy("id", "text_id", "item", (F.col("doc_pos") - F.col("item_pos")).alias("start")).agg(F.collect_set("item_pos").alias("at"))
    # Two shifts at most DRIFT apart have a band of twice that width in common.
    bands = F.array(F.floor(F.col("start") / (2 * DRIFT)).cast("double"), F.floor((F.col("start") + DRIFT) / (2 * DRIFT)) + F.lit(0.5))
    banded = shifts.withColumn("band", F.explode(bands))
    found = banded.groupBy("id", "text_id", "item", "band").agg(F.collect_list(F.struct(F.size("at").alias("n"), (-F.col("start")).alias("back"), "at")).alias("shifts"))
    # Every window of the item counts once, at the shift that has most windows.
    start = F.struct(F.array().cast("array<int>").alias("seen"), F.array().cast("array<struct<item:int,doc:int>>").alias("met"))

    def one_shift(acc: Column, s: Column) -> Column:
        fresh = F.array_except(s["at"], acc["seen"])
        pairs = F.transform(fresh, lambda p: F.struct(p.alias("item"), (p - s["back"].cast("int")).alias("doc")))
        return F.struct(F.concat(acc["seen"], fresh).alias("seen"), F.concat(acc["met"], pairs).alias("met"))

    ranked = found.withColumn("met", F.aggregate(F.reverse(F.array_sort("shifts")), start, one_shift, lambda acc: acc["met"]))
    head = ranked.withColumn("start", -F.get(F.reverse(F.array_sort("shifts")), F.lit(0))["back"]).drop("shifts", "band")
    info = items.select("item", "item_id", F.col("n").alias("n_item"), "width", (F.col("n") - F.col("width") + 1).alias("n_windows"), F.struct("raw", "tokens", "plain").alias("i"))
    enough = F.when(F.col("n_item") < SHORT, F.col("n_windows")).otherwise(F.least(F.col("n_windows") * coverage, F.lit(float(LONG_RUN))))
    likely = materialise(head.join(info, "item").where(F.size("met") >= enough), docs.sparkSession, "likely-leaks")

    # Slots are compared for the candidates only: their texts are read again, and move only if there are very many.
    ids = likely.select("id").distinct()
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    named = rows.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    again = with_template(with_clean(named), "tokens").withColumn("raw", raw()).select("id", F.xxhash64("text").alias("text_id"), F.struct("raw", "tokens").alias("d"))
    again = again.dropDuplicates(["id", "text_id"])
    met = likely.join(again, ["id", "text_id"])
    cells = lambda p: F.transform(
        F.sequence(F.lit(0), F.col("width") - 1),
        lambda k: F.struct(
            F.get(F.col("d.tokens"), p["doc"] + k).alias("type"), F.get(F.col("i.raw"), p["item"] + k).alias("item"), F.get(F.col("d.raw"), p["doc"] + k).alias("doc")
        ),
    )
    # A window that is mostly slots says something only through its values, and so do short items.
    words = lambda c: F.size(F.filter(c, lambda x: ~is_slot(x["type"])))
    same = lambda c: F.forall(c, lambda x: x["item"] == x["doc"])
    sure = F.filter(F.transform("met", cells), lambda c: ((words(c) >= F.col("width") * LEAST_WORDS) & (F.col("n_item") >= SHORT)) | same(c))
    held = met.withColumn("cells", sure).where(F.size("cells") >= enough)
    slots = F.filter(F.flatten("cells"), lambda x: is_slot(x["type"]))
    filled = held.withColumn("slots", F.array_distinct(slots))
    values = F.array_distinct(F.transform("slots", lambda x: F.struct(x["type"], x["item"])))
    changed = F.size(F.filter("slots", lambda x: x["item"] != x["doc"]))
    out = filled.where(F.size(values) == F.size("slots")).select(
        "id", "item_id", F.col("start").cast("int").alias("start"), F.size("cells").cast("long").alias("windows"), F.col("n_windows").cast("long").alias("n_windows"), F.size("slots").alias("n_slots"), changed.alias("n_changed")
    )
    best = F.max_by(F.struct("start", "windows", "n_windows", "n_slots", "n_changed"), F.struct("windows", -F.col("n_changed"), -F.col("start")))
    return (
        out.groupBy("id", "item_id")
        .agg(best.alias("b"))
        .select(F.col("id").alias(key), "item_id", "b.*", F.when(F.col("b.n_changed") > 0, "reparameterised").otherwise("verbatim").alias("kind"))
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns. Each row is judged by its own text, with or without an id."""
    name = "_text_id"
    while name in docs.columns:
        name += "_"
    marked = docs.withColumn(name, F.xxhash64("text"))
    leaks = template_leaks(marked.select(name, "text"), benchmark, key=name).select(name).distinct()
    return marked.join(leaks, name, "left_anti").select(*docs.columns)
