"""Template decontamination against a brute-force matcher, and its recall on questions with other parameters."""

import random

import regex

from breakweave.llm import decontaminate as D

UNITS = D.UNITS
FILLER = "lorem sea wind blows under a grey hill while nobody counts the waves and gulls cry over empty boats".split()


def tokens(text, head=False):
    """Template, raw and nameless tokens by other means than the operator's: one walk over the words."""
    text = text or ""
    text = regex.sub(r"(?<=[\p{Ll}\p{N},;:]\s{1,8})(?=\p{Lu}\p{Ll})", "\x01", text)
    text = regex.sub(r"(?<=[0-9])[.,:/'](?=[0-9])", "", text)
    words = regex.sub(r"[^\p{L}\p{N}%$€£\x01]+", " ", text).split(" ")
    out, words = [], [w for w in words if w]
    if head and words and regex.match(r"\p{Lu}\p{Ll}", words[0]):
        words[0] = "\x01" + words[0]
    for w in words:
        if w.startswith("\x01") and out and out[-1].startswith("\x01"):
            out[-1] += "_" + w
        elif m := regex.fullmatch(rf"((?:.*[^\p{{L}}0-9])?[0-9]+)((?i:{UNITS}))", w):
            out += [m[1], m[2]]
        else:
            out.append(w)
    made = {"raw": [], "tokens": [], "plain": []}
    for kind, types in made.items():
        for w in out:
            low = w.lower().replace("\x01", "")
            if kind == "raw":
                types.append(low)
            elif kind == "tokens" and "\x01" in w:
                types.append(w[: w.index("\x01")].lower() + "NAME")
            elif regex.fullmatch(r"[$€£]?[0-9]+[%€£$]?", low):
                types.append("NUM")
            elif types and types[-1] == "NUM" and regex.fullmatch(UNITS, low):
                types.append("UNIT")
            else:
                types.append(low)
    return made


def plain_leaks(doc, item):
    """Whether the item's template is in the document, its first word being a name or not."""
    return any(reading_leaks(tokens(doc), tokens(item, head)) for head in (False, True))


def reading_leaks(d, i):
    """Every window against every window."""
    n = len(i["tokens"])
    if not n:
        return False
    width = next(w for w in (8, 4, 2, 1) if n >= w) if n < 8 else 8 if n >= 24 else 4
    need = n - width + 1 if n < 8 else min((n - width + 1) * 0.5, 13)
    hits = [
        (a, b)
        for a in range(n - width + 1)
        for b in range(len(d["tokens"]) - width + 1)
        if d["tokens"][b : b + width] in (i["tokens"][a : a + width], i["plain"][a : a + width])
    ]
    bands = {}
    for a, b in hits:
        for band in ((b - a) // 16, ("half", (b - a + 8) // 16)):
            bands.setdefault(band, {}).setdefault(b - a, set()).add(a)
    for shifts in bands.values():
        seen, cells = set(), []
        for shift in sorted(shifts, key=lambda s: (-len(shifts[s]), s)):
            for a in shifts[shift] - seen:
                cells.append([(d["tokens"][a + shift + k], i["raw"][a + k], d["raw"][a + shift + k]) for k in range(width)])
            seen |= shifts[shift]
        sure = [c for c in cells if (n >= 8 and sum(t not in D.SLOTS for t, _, _ in c) >= width / 2) or all(x == y for _, x, y in c)]
        slots = {x for c in sure for x in c if x[0] in D.SLOTS}
        if len(seen) >= need and len(sure) >= need and len({x[:2] for x in slots}) == len(slots):
            return True
    return False


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, width long").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in D.template_leaks(d, b).collect()}


SHAPES = [
    "On monday {0} sold {2} apples and then {1} bought {3} kg of them for {4} dollars, so how much did {0} earn in the end",
    "A train leaves {0} at {2} and reaches {1} after {3} hours; how many km does it cover if it goes {4} km in each hour of the trip",
    "If {0} reads {2} pages a day and {1} reads {3} pages a day, after how many days have they read {4} pages of that book together",
    "the pool holds {2} l and {0} fills it with {3} l per minute",
]


def filled(rng, shape):
    names = rng.sample(["Ada", "Bert", "Carla", "Dora", "Emil", "Fritz", "Gerda", "Hugo"], 2)
    return SHAPES[shape].format(*names, *rng.sample(range(2, 99), 3))


def prose(rng, n):
    return " ".join(rng.choice(FILLER) for _ in range(n))


def edited(rng, text):
    words = text.split()
    at = rng.randrange(3, len(words) - 3)
    return " ".join(rng.choice([words[:at] + words[at + 1 :], words[:at] + ["really"] + words[at:]]))


def test_against_brute_force(spark):
    rng = random.Random(9)
    items = [(k, filled(rng, k % 4)) for k in range(8)]
    items += [(20, "Alice pays 3 dollars for tea"), (21, "3 kg 4 kg 5 kg 6 kg"), (22, "Wow"), (23, None), (24, " .. "), (25, "10 20 30 40 50 60 70 80 90 100 110 120"), (None, "nobody")]
    docs = []
    for k in range(60):
        text = filled(rng, k % 4) if k % 3 else items[k % 8][1]
        text = edited(rng, text) if k % 5 == 0 else text
        text = text.lower() if k % 7 == 0 else text.replace(" ", "\n", 3) if k % 7 == 1 else text
        docs.append((k, prose(rng, rng.randint(0, 30)) + " so " + text + ". " + prose(rng, 12)))
    docs += [(100, "we saw that Alice pays 3 dollars for tea here"), (101, "we saw that Alice pays 4 dollars for tea here"), (102, "so 3kg 4 kg 5kg 6 kg")]
    docs += [(103, "1 2 3 4 5 6 7 8 9 10 11 12 13"), (104, "x 10 20 30 40 50 60 70 80 90 100 110 120 y"), (105, "and wow"), (106, None), (107, "")]
    docs += [(108, items[0][1].replace("a", "b")), (109, prose(rng, 2500) + " " + items[1][1]), (110, items[0][1]), (110, "twice"), (None, items[0][1])]
    rows = [(k, t, "clash", 5) for k, t in docs]
    want = {(k, i) for k, t in docs for i, x in items if k is not None and i is not None and plain_leaks(t, x)}
    assert found(spark, rows, items) == want
    assert {(100, 20), (102, 21), (104, 25), (105, 22), (109, 1), (110, 0)} <= want
    assert not want & {(101, 20), (103, 25)}


def test_recall_on_other_parameters(spark):
    rng = random.Random(3)
    items = [(k, filled(rng, k)) for k in range(4)]
    planted = [(k, prose(rng, 20) + " and " + (edited(rng, t) if k % 2 else t) + " " + prose(rng, 20), "", 0) for k in range(200) for t in [filled(rng, k % 4)]]
    clean = [(1000 + k, prose(rng, 80) + f" for {k} dollars and then Ada bought {k} kg", "", 0) for k in range(100)]
    got = found(spark, planted + clean, items)
    assert sum((k, k % 4) in got for k in range(200)) >= 0.9 * 200
    assert not any(k >= 1000 for k, _ in got)


def test_rows_are_judged_by_their_text(spark):
    item = filled(random.Random(1), 0)
    docs = spark.createDataFrame([(1, "fine", 0), (1, "so " + item, 1), (None, "so " + item, 2), (None, "fine too", 3), (None, None, 4)], "doc_id long, text string, _text_id int")
    kept = D.without_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(r["_text_id"] for r in kept.collect()) == [0, 3, 4]
