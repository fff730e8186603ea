"""Benchmark decontamination by templates, in DataFrame functions only.

A text is brought to a template: numbers, names and units become typed slots, other words lose case and
punctuation. Windows of n template words of the documents are hash-joined with those of the benchmark items.
The matches of a document and an item are put together by alignment (the difference of their places), and an
alignment stands only if its slots are consistent: one value of the item is always one value of the document (two
values of the item may have become one). So a question with other numbers and names in it is caught, and a text
that has another value where the item repeats one is not. A document holds an item if the standing alignments have at least
`share` of the item's windows.

Whether a capitalised word is a name can't be told where a sentence, a line or a text may begin, and not at all
in a text that has lost its capitals. So a window has up to three readings, each with its own key and its own
alignments: capitals are names but where a sentence begins; all capitals are names; and no slots, each word and
number as it is. The last stands only where the first isn't inconsistent.

The benchmark's windows are broadcast if they are at most BROADCAST_WINDOWS (they are counted); beyond it the
documents' windows are shuffled to them, by hash. Windows of slots alone, or with fewer than half words, are
not looked up with slots, and don't count; but where an item has no others, all count and are looked up as they
are. An item with fewer than n words is one window, looked up as it is wherever a document has these words in a row
(with slots it would be found in texts that have nothing to do with it), and with slots as a whole text.

Null texts hold nothing; rows with a null id take part and give rows with a null id; rows that repeat an id
are one document; an empty table on either side gives no rows; columns besides those named are not looked at. Equal
items each have their own rows. Texts are taken whole; of a very long one a task holds its windows one at a time, and
the words of the text a few times over. A name of two words that was one before moves what follows, so that it counts as two
alignments, which are consistent each by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_WINDOWS = 200_000
WORDS = 5
SHARE = 0.8
# Units that follow a number.
UNITS = ("km", "m", "cm", "mm", "kg", "g", "mg", "l", "ml", "mph", "km/h", "miles", "mile", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar", "cents", "cent", "euros", "euro", "percent", "meters", "meter", "feet", "foot", "inches", "inch", "pounds", "pound", "liters", "liter", "degrees", "degree")
NUMBER, UNIT, NAME, MAYBE = "\x01", "\x02", "\x03", "\x04"  # what a slot begins with; MAYBE: a name or a sentence's begin
SLOTS, MARKS = "\x04", "\x05"  # what sorts below these is a slot, a slot or MAYBE


def slotted(text: Column) -> Column:
    """The text's template words, joined by single spaces; a slot is its type and its value."""
    unit = "|".join(UNITS)
    out = F.regexp_replace(text, "[\x01-\x04]", " ")
    # A name: a capital, then a small letter, where no sentence begins. The capital is looked for first.
    out = F.regexp_replace(out, r"(\p{Lu}(?=\p{Ll})(?<=[\p{Ll}0-9,;:)] \p{Lu})[\p{L}']*+)", f"{NAME}$1")
    out = F.regexp_replace(out, rf"(\p{{Lu}}(?=\p{{Ll}})(?<![\p{{L}}\p{{M}}0-9{NAME}]\p{{Lu}})[\p{{L}}']*+)", f"{MAYBE}$1")
    plain = F.regexp_replace(F.lower(out), rf"[^\p{{L}}\p{{M}}{NAME}{MAYBE}]+", " ")
    units = F.regexp_replace(out, rf"(?<=[0-9])\x20?((?i:{unit}))(?![\p{{L}}0-9])", f" {UNIT}$1")
    numbers = F.regexp_replace(units, r"(?<![\p{L}0-9\x03\x04])([0-9]++(?:[.,:/][0-9]++)*+)(?![\p{L}])", f"{NUMBER}$1")
    full = F.regexp_replace(F.lower(numbers), rf"[^\p{{L}}\p{{M}}0-9{NUMBER}{UNIT}{NAME}{MAYBE}.,:/]+|(?<![0-9])[.,:/]|[.,:/](?![0-9])", " ")
    return F.trim(F.when(text.rlike("[0-9]"), F.regexp_replace(full, " +", " ")).otherwise(plain))


def bare(w: Column) -> Column:
    """The word or value alone."""
    return F.when(w < MARKS, F.translate(w, f"{NUMBER}{UNIT}{NAME}{MAYBE}", "")).otherwise(w)


def windows(df: DataFrame, n: int, fewer: tuple[int, ...] = ()) -> DataFrame:
    """(id, at, reading, w0 .. w{n - 1}, key): a row for each reading of each window of n template words, or one
    of the whole text where it has fewer; and for each of k words (k in `fewer`), as they are. Shifted arrays
    are zipped, so that all of it is generated code."""
    kinds = lambda x: F.regexp_replace(x, f"([{NUMBER}-{NAME}])[^ ]+", "$1")
    t = F.col("t")
    read = [kinds(F.translate(t, MAYBE, "")), kinds(F.translate(t, MAYBE, NAME)), F.translate(t, f"{NUMBER}{UNIT}{NAME}{MAYBE}", "")]
    texts = df.select("id", slotted(F.col("text")).alias("t"))
    texts = texts.select("id", "t", F.inline(F.array(*[F.struct(F.lit(r).alias("reading"), x.alias("x")) for r, x in enumerate(read)])))
    words = texts.select("id", "reading", F.split("t", " ", -1).alias("words"), F.split("x", " ", -1).alias("kinds"))
    shifted = [(F.col(c) if i == 0 else F.slice(c, i + 1, F.size(c))).alias(f"{c[0]}{i}") for c in ("words", "kinds") for i in range(n)]
    rows = words.select("id", "reading", F.posexplode(F.arrays_zip(*shifted)).alias("at", "w"))
    rows = rows.select("id", "at", "reading", *[F.col(f"w.{c}{i}").alias(f"{c}{i}") for c in "wk" for i in range(n)]).where("w0 <> ''")
    whole = F.col(f"w{n - 1}").isNotNull() | (F.col("at") == 0)
    own = ["id", "at", "reading", *[f"w{i}" for i in range(n)]]
    full = F.xxhash64(*[f"k{i}" for i in range(n)])
    if not fewer:
        return rows.where(whole).select(*own, full.alias("key"))
    short = [F.when((F.col("reading") == 2) & F.col(f"w{k - 1}").isNotNull(), F.xxhash64(*[f"k{i}" for i in range(k)])) for k in fewer]
    return rows.select(*own, F.explode(F.array_compact(F.array(F.when(whole, full), *short))).alias("key"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds: id, item, n_windows (of the item), n_matched, share,
    n_slots (slot values that were checked)."""
    take = lambda df, i, t: df.select(F.col(f"`{i}`").alias("id"), F.col(f"`{t}`").cast("string").alias("text")).where("text IS NOT NULL")
    own = [F.col(f"w{i}") for i in range(n)]
    asked = windows(take(benchmark, item_col, item_text_col), n).select("key", "reading", F.col("id").alias("item"), F.col("at").alias("item_at"), F.array_compact(F.array(*own)).alias("own"))
    asked = asked.withColumn("worded", 2 * F.size(F.filter("own", lambda x: x >= SLOTS)) >= F.size("own"))
    counts = asked.groupBy("item").agg(F.countDistinct(F.when(F.col("worded"), F.col("item_at"))).alias("worded_windows"), F.countDistinct("item_at").alias("all_windows"))
    total = counts.select("item", F.when(F.col("worded_windows") > 0, F.col("worded_windows")).otherwise(F.col("all_windows")).alias("n_windows"))
    asked = asked.join(counts.select(F.col("item").alias("same"), "worded_windows"), F.col("item").eqNullSafe(F.col("same"))).where("worded OR worded_windows = 0")
    some = F.exists("own", lambda x: x >= MARKS)
    asked = asked.where((F.col("reading") == 2) | F.col("worded") & ((F.col("reading") == 0) | some))
    # Slots of a reading: the places of its values. Those of the last are as they are, so any are consistent.
    slot = lambda x: (x < SLOTS) | (F.col("reading") == 1) & (x < MARKS)
    short = [r[0] for r in asked.where(F.size("own") < n).select(F.size("own")).distinct().collect()]
    asked = asked.select("item", "item_at", "reading", "key", F.transform("own", lambda x: F.struct(bare(x).alias("v"), slot(x).alias("slot"))).alias("own"))
    small = asked.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    held = windows(take(docs, id_col, text_col), n, tuple(sorted(short)))
    held = held.drop("reading")
    met = held.join(F.broadcast(asked) if small else asked, "key")
    # A document's window can be longer than an item of few words; what is over has no place in the item.
    pairs = F.transform(F.filter(F.arrays_zip(F.col("own").alias("i"), F.array(*map(bare, own)).alias("d")), lambda x: x["i"]["slot"]), lambda x: F.struct(x["i"]["v"].alias("i"), x["d"].alias("d")))
    met = met.select("id", "item", "reading", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), pairs.alias("slots"))
    # At most a row for each window of the item and shift, before the slots are put together.
    of = lambda r, c: F.collect_set(F.when(F.col("reading") == r, F.col(c)))
    lined = met.groupBy("id", "item", "shift").agg(*[of(r, "item_at").alias(f"ats{r}") for r in range(3)], *[F.array_distinct(F.flatten(of(r, "slots"))).alias(f"slots{r}") for r in range(3)])
    values = lambda r, c: F.size(F.array_distinct(F.transform(f"slots{r}", lambda x: x[c])))
    # Words as they are stand where names, as far as they are known, don't contradict them.
    stands = [values(r, "i") == F.size(f"slots{r}") for r in (0, 1, 0)]
    standing = lined.select("id", "item", *[F.when(x, F.col(f"ats{r}")).otherwise(F.array().cast("array<int>")).alias(f"ats{r}") for r, x in enumerate(stands)], F.greatest(*[F.when(x, F.size(f"slots{r}")).otherwise(0) for r, x in enumerate(stands)]).alias("checked"))
    found = standing.groupBy("id", "item").agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.concat("ats0", "ats1", "ats2"))))).cast("long").alias("n_matched"), F.max("checked").cast("long").alias("n_slots"))
    out = found.join(F.broadcast(total) if small else total, "item").withColumn("share", F.round(F.col("n_matched") / F.col("n_windows"), 6)).where(F.col("share") >= share)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", "n_matched", "share", "n_slots")
