"""Benchmark decontamination against a brute force of the whole method, and its recall on re-parameterised items."""

import random

import regex
from pyspark.sql import functions as F

from kinloom.llm import decontamination as dc

SMALL = "/root/testdata/sf0.001"
RND = random.Random(4)
NUMBER, UNIT, NAME, MAYBE = dc.NUMBER, dc.UNIT, dc.NAME, dc.MAYBE


def template(text):
    """The template's words, each slot with its mark: the same patterns, one after the other."""
    unit = "|".join(dc.UNITS)
    out = regex.sub("[\x01-\x04]", " ", text)
    out = regex.sub(r"(\p{Lu}(?=\p{Ll})(?<=[\p{Ll}0-9,;:)] \p{Lu})[\p{L}']*+)", NAME + r"\1", out)
    out = regex.sub(rf"(\p{{Lu}}(?=\p{{Ll}})(?<![\p{{L}}\p{{M}}0-9{NAME}]\p{{Lu}})[\p{{L}}']*+)", MAYBE + r"\1", out)
    if not regex.search("[0-9]", text):
        return regex.sub(rf"[^\p{{L}}\p{{M}}{NAME}{MAYBE}]+", " ", out.lower()).strip(" ").split(" ")
    out = regex.sub(rf"(?<=[0-9])\x20?((?i:{unit}))(?![\p{{L}}0-9])", f" {UNIT}" + r"\1", out)
    out = regex.sub(r"(?<![\p{L}0-9\x03\x04])([0-9]++(?:[.,:/][0-9]++)*+)(?![\p{L}])", NUMBER + r"\1", out)
    out = regex.sub(rf"[^\p{{L}}\p{{M}}0-9{NUMBER}{UNIT}{NAME}{MAYBE}.,:/]+|(?<![0-9])[.,:/]|[.,:/](?![0-9])", " ", out.lower())
    return regex.sub(" +", " ", out).strip(" ").split(" ")


def readings(words):
    mark = lambda w: w[0] if w[:1] in (NUMBER, UNIT, NAME) and len(w) > 1 else w
    plain = [mark(w.replace(MAYBE, "")) for w in words]
    named = [mark(w.replace(MAYBE, NAME)) for w in words]
    return plain, named, [w.strip(NUMBER + UNIT + NAME + MAYBE) for w in words]


def brute(docs, items, n=dc.WORDS, share=dc.SHARE):
    """Every window of every document against every window of every item."""
    found = set()
    short = {len(w) for _, t in items if t is not None for w in [template(t)] if w != [""] and len(w) < n}
    by_id = {}
    for i, text in docs:
        if text is None or (words := template(text)) == [""]:
            continue
        rows = by_id.setdefault(i, {})
        for r, kinds in enumerate(readings(words)):
            for at in range(len(words)):
                if at + n <= len(words) or at == 0:
                    rows.setdefault(tuple(kinds[at : at + n]), set()).add((at, tuple(words[at : at + n])))
                for k in short if r == 2 else ():
                    if at + k <= len(words):
                        rows.setdefault(tuple(kinds[at : at + k]), set()).add((at, tuple(words[at : at + n])))
    bare = lambda w: w.strip(NUMBER + UNIT + NAME + MAYBE) if w[:1] in (NUMBER, UNIT, NAME, MAYBE) else w
    for item, text in items:
        if text is None or (words := template(text)) == [""]:
            continue
        places = range(max(1, len(words) - n + 1))
        worded = {at: 2 * sum(w >= dc.SLOTS for w in words[at : at + n]) >= len(words[at : at + n]) for at in places}
        every = not any(worded.values())
        total = len(places) if every else sum(worded.values())
        for i, rows in by_id.items():
            lines = {}
            for r, kinds in enumerate(readings(words)):
                for at in places:
                    own = words[at : at + n]
                    if not (worded[at] or every) or r < 2 and not worded[at] or r == 1 and not any(w >= dc.MARKS for w in own):
                        continue
                    for d, there in rows.get(tuple(kinds[at : at + n]), ()):
                        line = lines.setdefault(d - at, ([set(), set(), set()], [set(), set(), set()]))
                        line[0][r].add(at)
                        line[1][r] |= {(bare(w), bare(x)) for w, x in zip(own, there) if w < dc.SLOTS or r == 1 and w < dc.MARKS}
            matched = set()
            for ats, slots in lines.values():
                for r, of in enumerate((0, 1, 0)):
                    if len({a for a, _ in slots[of]}) == len(slots[of]):
                        matched |= ats[r]
            if round(len(matched) / total, 6) >= share:
                found.add((i, item, total, len(matched)))
    return found


def held(spark, docs, items):
    docs, bench = (spark.createDataFrame(x, f"{k} long, text string") for x, k in ((docs, "doc_id"), (items, "item_id")))
    return {(r.doc_id, r.item_id, r.n_windows, r.n_matched) for r in dc.decontaminate(docs, bench).collect()}


NAMES = ["Anna", "Bob", "Carla", "Dave", "Emma", "Fritz", "Gina", "Hugo"]


def parameterised(text, every, values):
    """The text with numbers, names and units at every so-many-th word, by values(k) of the k-th place."""
    words = text.split()
    for k, at in enumerate(range(2, len(words), every)):
        words[at] = values(k)
    return " ".join(words)


def prose(n):
    return " ".join(RND.choice(["lorem", "ipsum", "dolor", "sit", "amet", "The", "Cat", "12", "went.", "home,", "with", "Peter"]) for _ in range(n))


def varied(spark):
    """Benchmark items with slots, and documents that hold them with other values, or with values that contradict."""
    items, docs, want, never = [], [], set(), set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").collect():
        if len(r.text.split()) < 12:
            continue
        kinds = [lambda k, s: str(10 + (k % 3) * 7 + s), lambda k, s: NAMES[(k % 3 + s) % 8], lambda k, s: f"{5 + (k % 3) + s} {('km', 'hours', 'dollars')[k % 3]}"]
        kind = kinds[r.item_id % 3]
        items.append((r.item_id, parameterised(r.text, 4, lambda k: kind(k, 0))))
        for c in range(3):
            shift = RND.randint(1, 4)
            docs.append((1000 * c + r.item_id, prose(20) + ". " + parameterised(r.text, 4, lambda k: kind(k, shift)) + " " + prose(15)))
            want.add((docs[-1][0], r.item_id))
        docs.append((9000 + r.item_id, prose(10) + " " + parameterised(r.text, 4, lambda k: kind(RND.randint(0, 99), RND.randint(0, 99)))))
        if len(r.text.split()) > 40 and r.item_id % 3 == 0:
            never.add((docs[-1][0], r.item_id))
    return items, docs, want, never


def test_recall_on_other_parameters(spark):
    items, docs, want, never = varied(spark)
    got = {(d, i) for d, i, *_ in held(spark, docs, items)}
    assert len(got & want) >= 0.95 * len(want) and len(want) > 60
    assert not got & never and never


def test_against_brute_force(spark):
    items, docs, _, _ = varied(spark)
    extra = ["Compute 3 + 4 * 5 - 6 * 7", "Who wrote Ulysses?", "12 + 7 = 19", "banana", "Name the capital city", "", "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have?", "I see 3 pens and 5 books on the old table", "Tom met Tom 5 km from Rome"]
    items += [(500 + k, x) for k, x in enumerate(extra)] + [(600, None), (601, extra[1])]
    docs += [(20000 + k, f"{prose(4)} {x} {prose(6)}") for k, x in enumerate(extra)] + [(20100 + k, x) for k, x in enumerate(extra)]
    docs += [(20200, None), (20201, ""), (20202, "Anna has 6 apples. Anna buys 4 more. How many apples does Anna have?"), (20203, "I see 4 pens and 4 books on the old table"), (20203, "a second text of one document"), (20204, extra[6].lower()), (20205, extra[6].replace("Tom buys", "Eva buys"))]
    docs = [(i, t) for i, t in docs if i is not None]
    got, want = held(spark, docs, items), brute(docs, items)
    assert got == want
    ids = {(d, i) for d, i, *_ in got}
    assert {(20000, 500), (20001, 501), (20001, 601), (20002, 502), (20003, 503), (20004, 504), (20202, 506), (20203, 507), (20204, 506)} <= ids and (20205, 506) not in ids


def test_whole_tables_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id, r.n_windows, r.n_matched) for r in dc.decontaminate(docs, bench).collect()}
    assert got and got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])


def test_a_very_long_text(spark):
    item = "In the market Tom bought 12 apples for 3 dollars and sold them in the evening to Anna."
    docs = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.expr("repeat('some words of a long text, ', 60000)"), F.lit(item.replace("Tom", "Eva"))).alias("text"))
    assert {r.doc_id for r in dc.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()} == {1}
