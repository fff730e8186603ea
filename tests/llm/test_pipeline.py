"""Each stage of the pipeline, and all of it, against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
from test_decontamination import brute
from tokenizers import Tokenizer

import corpus_pipeline
from kinloom.llm.pretokens import vocabulary_path

SMALL = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def good(text):
    w = words(text)
    n, chars = len(w), sum(map(len, w))
    if n < 20:
        return False
    for k in range(5, 11):
        seen, again = collections.Counter(tuple(w[i : i + k]) for i in range(n - k + 1)), set()
        first = set()
        for i in range(n - k + 1):
            gram = tuple(w[i : i + k])
            if gram in first:
                again |= set(range(i, i + k))
            first.add(gram)
        if k == 8 and 100 * len({j for i in range(n - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}) > 30 * n:
            return False
        repeated = sum(len(w[j]) for j in again)
        if repeated > 100 and repeated / chars > {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}[k]:
            return False
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if words(line):
            repeated += sum(map(len, words(line))) if line in seen else 0
            seen.add(line)
    return repeated <= 100 or repeated / chars <= 0.2


def slow_quality(docs, items):
    return {i: t for i, t in docs.items() if good(t or "")}


def slow_lines(docs, items):
    held = collections.defaultdict(set)
    for i, t in docs.items():
        for x in (t or "").split("\n"):
            if len(k := lower(x.strip(BLANK))) >= 40:
                held[k].add(i)
    drop = lambda x, i: len(h := held.get(lower(x.strip(BLANK)), ())) >= 5 and max(h) != i
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if not drop(x, i)) for i, t in docs.items()}


def slow_groups(docs, items):
    sets = {}
    for i, t in docs.items():
        w = words(lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in docs}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(c := sets[i] & sets[j]) >= 0.8 * (len(sets[i]) + len(sets[j]) - len(c)):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: t for i, t in docs.items() if top(i) == i}


def slow_benchmark(docs, items):
    held = {d for d, *_ in brute(list(docs.items()), items)}
    return {i: t for i, t in docs.items() if i not in held}


SLOW = {"quality": slow_quality, "lines": slow_lines, "near-duplicates": slow_groups, "decontamination": slow_benchmark}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    return docs, {r.doc_id: r.text for r in docs.collect()}, items


def test_stages_and_run(spark, tables):
    docs, kept, items = tables
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after, want = stage(spark, docs, SMALL).collect(), SLOW[name](kept, items)
        assert {r.doc_id: r.text for r in after} == want and len(after) == len(want) <= len(kept), name
        docs, kept = spark.createDataFrame(after, docs.schema), want
        assert docs.columns == list(corpus_pipeline.COLUMNS) and all(r.n_chars == len(r.text) for r in after if r.text is not None), name
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = set()
    for i, t in kept.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()} == want


def test_groups_of_near_copies(spark):
    """Groups of hundreds of edited copies, long ones among them: no link between any two is lost."""
    import random

    rnd, made = random.Random(8), []
    for size, n in ((80, 60), (300, 40), (2500, 25), (30, 120)):
        base = [f"w{rnd.randrange(5000)}" for _ in range(size)]
        for _ in range(n):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, size // 40))):
                w[rnd.randrange(size)] = f"x{rnd.random()}"
            made.append(" ".join(w))
    rnd.shuffle(made)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()}
    assert got == set(slow_groups(dict(enumerate(made)), None))
