"""The text operators against plain Python, the tokenizers' own library and DuckDB, odd rows included."""

import collections
import hashlib
import io
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from kinloom.llm import bpe_codec, components, decontamination, license_scan, line_dedup, perfect_hash, pii, quality_rules, queries, simhash, substring_dedup, token_count, warc
from kinloom.llm.pretokens import vocabulary_path

SMALL = "/root/testdata/sf0.001"
RND = random.Random(11)
WORDS = [f"w{i}" for i in range(400)]
PASSAGE = " ".join(RND.choices(WORDS, k=60))
LINE = "This line is long enough to count as boilerplate, and many share it."


def made_rows():
    rows = [(i, " ".join(RND.choices(WORDS, k=RND.randint(1, 120)))) for i in range(30)]
    rows += [(30 + i, rows[3][1]) for i in range(3)]  # copies
    rows += [(40 + i, " ".join(RND.choices(WORDS, k=20)) + " " + PASSAGE + " " + " ".join(RND.choices(WORDS, k=9))) for i in range(4)]
    rows += [(50 + i, f"own {i}\n  {LINE.upper() if i % 2 else LINE}\t\nend {i}\n{LINE}") for i in range(6)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, "\n\n"), (64, "short"), (None, "no id but text " + PASSAGE), (None, None)]
    rows += [(70, "twice " + PASSAGE), (70, "twice " + PASSAGE), (70, "another " + LINE)]
    rows += [(80, "a b c " * 30000), (81, "é" * 30000 + " x" * 2000), (82, "1 " * 20000), (83, "<|endoftext|>x<|endoftext|>'ll 日本 😀\x1c\x85  \n")]
    return rows


ROWS = made_rows()


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns carry the names that the operators use within."""
    extra = [(i, t, "x", None, 1, [1], "s", 2.0) for i, t in ROWS]
    return spark.createDataFrame(extra, "doc_id long, text string, id string, batch string, key int, w array<int>, kept string, n_words double")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


def test_token_counts(docs, none, library):
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in ROWS]
    assert rows(token_count.token_counts(docs)) == sorted(want, key=repr)
    assert token_count.token_counts(none).collect() == []


def test_codec(docs, none, library):
    want = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))))
    assert rows(bpe_codec.round_trip(docs)) == sorted(want, key=repr)
    assert rows(bpe_codec.decode(bpe_codec.encode(docs))) == sorted(((i, t or "") for i, t in ROWS), key=repr)
    assert bpe_codec.round_trip(none).collect() == []


def test_tokens_of_random_strings(library):
    code, count = bpe_codec.codec(vocabulary_path("byte_bpe_50k.json")), token_count.counter(vocabulary_path("byte_bpe_50k.json"))
    for k in range(1500):
        t = "".join(RND.choice("abAB 's\n\t.é😀0<|>endoftext" if k % 2 else [chr(RND.randint(32, 0xD7FF)), chr(RND.randint(0x10000, 0x1FFFF))]) for _ in range(RND.randint(1, 60)))
        ids = library.encode(t, add_special_tokens=False).ids
        assert code.encode(t) == np.array(ids, "<u4").tobytes() and count.of(t) == len(ids)
        assert code.decode(code.encode(t)) == library.decode(ids, skip_special_tokens=False)


def slow_print(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def least_reachable(nodes, pairs):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("bucket", [64, 1])
def test_simhash(docs, none, bucket):
    prints = [(i, slow_print(t)) for i, t in ROWS]
    known = [(i, p) for i, p in prints if i is not None]
    reach = least_reachable({i for i, _ in known}, [(a, b) for a, p in known for b, q in known if (p ^ q).bit_count() <= 2])
    by_print = {p: reach[i] for i, p in known}
    want = [(i, f"{p:016x}", reach[i] if i is not None else by_print.get(p)) for i, p in prints]
    assert rows(simhash.near_duplicates(docs, bucket=bucket)) == sorted(want, key=repr)
    assert simhash.near_duplicates(none).collect() == []


def test_simhash_links_in_full_buckets(spark):
    points = [(0, 100)] + [((1 << i) | (1 << j), 101 + 64 * i + j) for i in range(12) for j in range(i, 12)]
    want = least_reachable({i for _, i in points}, [(i, j) for p, i in points for q, j in points if (p ^ q).bit_count() <= 2])
    df = spark.createDataFrame(points, "fp long, rep long")
    for bucket in (1, 5, 1000):
        assert {r.rep: r.component_id for r in simhash.classes(df, distance=2, bucket=bucket).collect()} == want


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (7, 200), (300, 301), (301, 300), (5, 5)]
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == least_reachable(nodes, pairs[:-1])
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def five(t):
    w = words((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_similar_groups(spark, docs, none):
    base = [RND.choices(WORDS, k=n) for n in (30, 120, 700) for _ in range(4)]
    made = list(ROWS)
    for k, b in enumerate(base):
        made.append((1000 + 50 * k, " ".join(b)))
        for c in range(1, 8):  # near copies: some words changed
            w = list(b)
            for _ in range(max(1, len(w) * c // 200)):
                w[RND.randrange(len(w))] = "new"
            made.append((1000 + 50 * k + c, " ".join(w)))
    sets = collections.defaultdict(list)
    for i, t in made:
        if i is not None:
            sets[i].append(five(t))
    pairs = [(i, j) for i in sets for j in sets if i < j for a in sets[i] for b in sets[j] if len(a & b) >= 0.8 * len(a | b)]
    want = least_reachable(set(sets), pairs)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == want
    assert simhash.similar_groups(none).collect() == []


def test_similar_groups_around_an_original(spark):
    """Many edited copies that are similar to their original alone, which hasn't the least id."""
    base, made = [f"o{i}" for i in range(204)], []
    for i in range(300):
        w = list(base)
        for at in (x + RND.randrange(40) for x in (2, 52, 102, 152)) if i != 150 else ():
            w[at] = f"v{i}"
        made.append((i, " ".join(w)))
    sets = [five(t) for _, t in made]
    assert all(len(x & sets[150]) >= 0.8 * len(x | sets[150]) for x in sets) and len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
    got = simhash.similar_groups(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert len(got) == 300 and {r.component_id for r in got} == {0}


def test_similar_groups_by_brute_force(spark):
    """All components, with shingles that all documents hold and keys that are full."""
    made, shared = [], RND.choices(WORDS, k=40)
    for g in range(12):
        base = [f"g{g}x{i}" for i in range(RND.randint(20, 90))] + shared
        for _ in range(25):
            w = list(base)
            for _ in range(RND.randint(0, 4)):
                w[RND.randrange(len(w))] = f"n{RND.random()}"
            made.append((len(made), " ".join(w)))
    RND.shuffle(made)
    sets = {i: five(t) for i, t in made}
    want = least_reachable(set(sets), [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(made, "doc_id long, text string"), bucket=4).collect()} == want


def test_substring_dedup(docs, none):
    first = {}
    for i, t in ROWS:
        w = words(t) if i is not None else []
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    want = []
    for i, t in ROWS:
        w, gone = words(t), set()
        for k in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        want.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert rows(substring_dedup.substring_dedup(docs, with_text=False)) == sorted(want, key=repr)
    full = substring_dedup.substring_dedup(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, sha(r.kept_text)) for r in full), key=repr) == sorted(want, key=repr)
    text = {i: words(t) for i, t in ROWS if i != 70}
    for r in full:
        for s in r.spans if r.doc_id != 70 else ():
            if s.ref_id != 70:
                assert s.ref_id < r.doc_id and text[r.doc_id][s.start : s.start + s.length] == text[s.ref_id][s.ref_start : s.ref_start + s.length]
    assert substring_dedup.substring_dedup(none).collect() == []


def test_line_dedup(docs, none):
    blank, key = " \t\n\x0b\x0c\r", lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in ROWS:
        for x in (t or "").split("\n") if i is not None else ():
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    want = []
    for i, t in ROWS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < 5 or max(held[key(x)]) == i]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    assert blank and any(w[2] for w in want)
    for most in (1 << 20, 0):  # the arrays are read by all tasks, or asked where they are
        assert rows(line_dedup.line_dedup(docs, with_text=False, arrays_bytes=most)) == sorted(want, key=repr)
        carried = line_dedup.line_dedup(docs, carry=("key", "kept"), arrays_bytes=most)
        assert carried.columns == ["doc_id", "n_lines", "n_dropped", "kept_text", "key", "kept"]
        assert sorted(((r[0], r[1], r[2], sha(r[3])) for r in carried.collect()), key=repr) == sorted(want, key=repr)
    assert line_dedup.line_dedup(none).collect() == []


def test_arrays_with_clashing_keys():
    made = line_dedup.Arrays(np.array([5, 5, 9], np.uint64), np.array([1, 2, 7], np.uint64), np.array([5, 4, 1], np.uint32), np.array([11, 20, 30]))
    asked = np.array([5, 5, 9, 5, 9, 4], np.uint64), np.array([1, 2, 7, 3, 1, 1], np.uint64)
    for arrays in (made, line_dedup.Arrays.from_bytes(made.to_bytes())):
        assert [x.tolist() for x in arrays.probe(*asked)] == [[5, 4, 1, 0, 0, 0], [11, 20, 30, *[line_dedup.NOBODY] * 3]]


@pytest.mark.parametrize("n", [0, 1, 2, 65, 5000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    made = perfect_hash.PerfectHash(keys)
    assert sorted(made(keys).tolist()) == list(range(len(keys)))
    assert n < 1000 or made.bits() < 5 * n


def test_quality(docs, none):
    got = {}
    for r in quality_rules.quality(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in ROWS:
        w, t = words(t), t or ""
        count = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {j for k in range(len(w) - 7) if count[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = t.split("\n")
        dup = sum(1 for k, x in enumerate(lines) if words(x) and x in set(lines[:k])) if len(lines) < 1000 else 0
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert any((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want for r in got[i]), i
        assert all(not r.kept for r in got[i] if r.base_failed)
    assert quality_rules.quality(none).collect() == []
    twice = " ".join(WORDS[:60]) + "\n" + " ".join(WORDS[60:120])
    assert quality_rules.measured(twice, quality_rules.NGRAM_LIMITS, 0.2)[5]
    assert not quality_rules.measured(twice + "\n" + twice, quality_rules.NGRAM_LIMITS, 0.2)[5]
    # A six-gram found twice and its share, by hand
    text = "a b c d e f x a b c d e f y"
    assert quality_rules.measured(text, {6: 0.5}, 0.2)[7] == pytest.approx(6 / 14)


def slow_spans(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(p) < 9 and int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in reversed(re.sub("[^0-9]", "", m[0]))]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii(spark, docs, none):
    odd = ["a@b.c_d@e.f a@b.c.@x.y..z@q.w", "1.2.3.4.5.6.7.8 0000255.1.2.3 256.1.1.1", "😀 a@b.co 😀 4111 1111 1111 1111 +1 (415) 555-2671", "a" * 40000 + "@", "a@" + "b." * 9000 + "c", "+1" + "(" * 999]
    odd += ["".join(RND.choice("ab@.@..01 23-+()_%4:é") for _ in range(RND.randint(1, 60))) for _ in range(800)]
    odd += ["".join(RND.choice("0123456789 -+.") for _ in range(RND.randint(10, 60))) for _ in range(800)]
    made = ROWS + [(5000 + i, t) for i, t in enumerate(odd)]
    texts = collections.defaultdict(list)
    for i, t in made:
        texts[i].append(t or "")
    for r in pii.digest(spark.createDataFrame(made, "doc_id long, text string")).collect():
        want = [slow_spans(t) for t in texts[r.doc_id]]
        got = (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)
        assert got in [(*(sum(x[2] == k for x in s) for k in ("email", "ip", "card", "phone")), sha(",".join(f"{k}:{a}:{e}" for a, _, k, e in s))) for s in want], r.doc_id
    text = "IBAN GB82 WEST 1234 5698 7654 32, GB83 WEST 1234 5698 7654 32; call me: 415-555-2671; ssn 123-45-6789"
    more = spark.createDataFrame([(1, text), (2, "415-555-2671 and 123-45-6789")], "doc_id long, text string")
    want = ",".join(f"{k}:{(a := text.index(x))}:{a + len(x)}" for k, x in (("iban", "GB82 WEST 1234 5698 7654 32"), ("local_phone", "415-555-2671"), ("ssn", "123-45-6789")))
    assert rows(pii.digest(more).select("doc_id", "spans")) == [(1, want), (2, "")]
    assert pii.digest(none).collect() == [] and pii.digest(docs).count() == len(ROWS)


def test_pii_context_before_other_matches(spark):
    """The context of a span is the text before it, whatever else matches there."""
    texts = ["phone: 415-555-0100, 415-555-0101", "ssn 123-45-6789, 000-12-3456, 123-45-6780", "phone: 415-555-0100" + " " * 21 + "415-555-0101", "phone: 415-555-0100" + " " * 22 + "415-555-0101", "no word 415-555-0100 but call 415-555-0101, 415-555-0102"]
    want = ["local_phone:7:19,local_phone:21:33", "ssn:4:15,ssn:30:41", "local_phone:7:19,local_phone:40:52", "local_phone:7:19", "local_phone:30:42,local_phone:44:56"]
    got = pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert rows(got.select("doc_id", "spans")) == list(enumerate(want))


def test_licenses(spark, docs, none):
    sentence = license_scan.SENTENCES
    made = [(1, "Some words.\nReleased under the MIT License.\n"), (2, f"{sentence['mit-grant']}. {sentence['mit-asis']}. {sentence['mit-liability']}."), (3, re.sub(" the ", "\n the ", sentence["gpl-free"]) + "."), (4, "ALL RIGHTS RESERVED!  licensed under cc by-nc 4.0."), (5, "the license of this"), (6, f"{sentence['bsd-binary']}.\n{sentence['bsd-use']}:\n{sentence['bsd-source']}."), (7, f"{sentence['bsd-use']}:\n* {sentence['bsd-source']}.\nother text.\n* {sentence['bsd-binary']}.")]
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "GPL-3.0-or-later", 4: "CC-BY-NC-4.0,LicenseRef-all-rights-reserved", 5: "", 6: "", 7: "BSD-2-Clause"}
    known, rules = license_scan.compiled(license_scan.SENTENCES, license_scan.RULES)
    assert all(any(w in k for w in license_scan.triggers(known)) for k in known)
    assert all(r.licenses == "" for r in license_scan.license_scan(docs).collect()) and license_scan.license_scan(none).collect() == []


def test_decontamination(spark, docs, none):
    item = "In the market Tom bought 12 apples for 3 dollars and then Tom sold 5 apples to Anna who paid 4 dollars for them in the evening."
    other = item.replace("Tom", "Peter").replace("12", "99").replace("Anna", "Maria").replace("5", "7").replace("3 d", "2 d").replace("4 d", "8 d")
    made = [(1, "Some text before. " + other + " And after."), (2, item.replace("then Tom", "then Carl")), (3, "nothing"), (4, None), (5, ""), (6, item.upper()), (7, item), (7, item), (None, item), (8, "In the market there were apples for 3 dollars.")]
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "too short")], "item_id long, text string")
    corpus = spark.createDataFrame([(i, t, "x", 1, "s") for i, t in made], "doc_id long, text string, key string, at int, id string")
    got = {r.doc_id for r in decontamination.decontaminate(corpus, bench).collect()}
    assert {1, 7, None} <= got and not got & {2, 3, 4, 5, 8}
    assert decontamination.decontaminate(none, bench).collect() == [] and decontamination.decontaminate(docs, bench.where("false")).collect() == []


def leaks(spark, docs, items):
    docs, bench = (spark.createDataFrame(list(enumerate(x)), f"{k} long, text string") for x, k in ((docs, "doc_id"), (items, "item_id")))
    return {(r.doc_id, r.item_id) for r in decontamination.decontaminate(docs, bench).collect()}


def test_decontamination_of_numbers_and_short_items(spark):
    items = ["Compute 3 + 4 * 5 - 6 * 7", "Who wrote Ulysses?", "Anna, Bob, Carl, Dora, Emil, Fritz or Gerda?", "banana"]
    docs = ["Exercise two: compute 3 + 4 * 5 - 6 * 7 and write it down.", "Compute 3 + 4 * 5 - 6 * 8", "A quiz asks: Who wrote Ulysses? Nobody knew it.", "who wrote Hamlet, or who wrote", "It was Anna, Bob, Carl, Dora, Emil, Fritz or Gerda? Yes.", "Ada, Bea, Cid, Dan, Eve, Flo or Gus?", "bananas", "one banana", "Who wrote Ulysses"]
    assert leaks(spark, docs, items) == {(0, 0), (2, 1), (4, 2), (7, 3), (8, 1)}


def test_decontamination_finds_names_anywhere(spark):
    item = "Alice has 5 apples in a basket near the door. Bob gives her 3 more apples from the tree behind his house. Carol then takes 2 of these apples home for her old mother. How many apples are left?"
    short = "What is the capital of France?"
    new = item.replace("Alice", "Dora").replace("Bob", "Emil").replace("Carol", "Fritz").replace("5", "9").replace("3", "4").replace("2", "7")
    docs = [f"Text. {new} More.", "Question: " + short, item.lower(), "See this: " + item.replace(" Bob", "\nBob").replace(" the", "\nthe"), short.lower() + " nobody knows", "It asks,\n" + new.replace(" Emil", "\nEmil"), "Question: What is the capital city of France?", new.replace("apples", "pears")]
    assert leaks(spark, docs, [item, short]) == {(0, 0), (1, 1), (2, 0), (3, 0), (4, 1), (5, 0)}


def test_decontamination_finds_passages(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W\d_]+", t.lower())] for i in range(len(w) - 4)}
    items = {r.item_id: grams(r.text) for r in bench.collect()}
    texts = {r.doc_id: grams(r.text) for r in docs.collect()}
    want = {(d, i) for d, x in texts.items() for i, y in items.items() if len(x & y) >= 0.95 * len(y)}
    never = {(d, i) for d, x in texts.items() for i, y in items.items() if len(x & y) < 0.7 * len(y)}
    got = {(r.doc_id, r.item_id) for r in decontamination.decontaminate(docs, bench).collect()}
    assert want <= got and not got & never


@pytest.mark.parametrize("least,split", [(4096, 1 << 30), (4096, 777), (8192, 50_001)])
def test_warc_ranges(monkeypatch, least, split):
    monkeypatch.setattr(warc, "LEAST", least)
    monkeypatch.setattr(warc, "CHUNK", least)
    monkeypatch.setattr(warc, "SLICE", least)
    blob, starts = b"", []
    for i in range(600):
        starts.append(len(blob))
        blob += warc.member(i, f"http://x/é\n{i}", RND.randbytes(RND.choice([0, 10, 300, 5000])), 7 if i % 5 == 0 else None)
    got = [x for a in range(0, len(blob), split) for x in warc.records(io.BytesIO(blob), a, a + split)]
    assert [o for o, _ in got] == starts and [warc.parsed(r)[0] for _, r in got] == list(range(600))


def test_warc(spark):
    made = [(1, "http://a", "same"), (2, None, "same"), (3, "u\r\nWARC-Type: x", "same"), (4, "", None), (5, "x", ""), (None, "y", "same"), (6, "z", "é" * 3000), (7, "\x1f\x8b\x08", "\x1f\x8b\x08 WARC/1.0\r\n\r\n"), (3, "again", "same")]
    pages = spark.createDataFrame([(*r, 1, "c") for r in made], "page_id long, url string, html string, digest int, path string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages, split_bytes=100).collect()}
    assert got == {(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "revisit", 5), (5, "response", None), (None, "response", None), (6, "response", None), (7, "response", None)}
    full = warc.read_archives(warc.write_archives(pages, min_bytes=5), split_bytes=64).collect()
    assert len(full) == len(made) and all(r.record_type == "response" for r in full)
    assert {(r.page_id, bytes(r.payload).decode()) for r in full} == {(i, h or "") for i, _, h in made}
    assert warc.round_trip(pages.where("false")).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("k", range(4))
def test_stages_take_odd_rows(spark, k):
    odd = [(i, t, None, "s", None) for i, t in ROWS]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, SMALL)
    assert out.columns == list(corpus_pipeline.COLUMNS) and 0 < out.count() <= len(odd), name
    assert stage(spark, docs.where("false"), SMALL).count() == 0
