"""SimHash near-dedup with multi-index hashing.

A fingerprint is cut in segments, and each segment has a table. Two fingerprints that differ in few bits
differ in fewer in some segment: a fingerprint enumerates the small Hamming ball around each of its segments,
fetches what the tables hold there, and complete distances decide. Equal fingerprints are one entry, so exact
copies cost nothing; and where very many distinct ones share a segment, the pairs in that bucket aren't formed:
its fingerprints (and those that probe it) instead name all fingerprints within half the distance. Two that
name the same one are linked, and no two linked ones fail to, so a link to the least of each name is the same
graph in linear size.

A null text has no words (fingerprint zero). Ids are integers. A row with a null id gets the component of its
fingerprint, and links nothing; rows that repeat an id each give a row; an empty table gives no rows; columns
besides the two named are not looked at. Words of whole texts are taken, in blocks, so memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, islice, repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import counted_broadcasts
from .common import Written, by_batch, few_or_all, kept, settled, two_columns
from .components import components
from .perfect_hash import mixed
from .shards import BATCHES_PER_SHARD, MOST_DOCS, batch_of, by_shard, packed

BLOCK = 1 << 16
#: Distinct fingerprints with an equal segment beyond which they are linked by names.
BUCKET = 64


def blocks(hashes: Iterator[int]) -> Iterator[np.ndarray]:
    while len(h := np.fromiter(islice(hashes, BLOCK), np.uint64)):
        yield h


def majority(hashes: Iterable[np.ndarray]) -> int:
    """Signed 64 bits: a bit is set if over half the hashes have it."""
    total, n = np.zeros(64, np.int64), 0
    for h in hashes:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits((2 * total > n).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text, from the hashes of its shingles."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle))))
    return majority(blocks(map(xxhash.xxh64_intdigest, shingles, repeat(seed))))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, fp long) of each row."""
    named = two_columns(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))

    def made(many: list[str]) -> dict:
        import pyarrow as pa

        return {"fp": pa.array([fingerprint(t, shingle) for t in many], pa.int64())}

    return named.mapInArrow(by_batch(made), "id long, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """Masks with at most `radius` of so many bits."""
    return [sum(1 << i for i in chosen) for k in range(radius + 1) for chosen in combinations(range(bits), k)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def exploded(points: DataFrame, masks: list[tuple[int, int]], width: int) -> DataFrame:
    """A row for each (segment, mask) with the segment's bits as key, the mask's turned."""
    table = F.array(*[F.struct(F.lit(k).alias("s"), F.lit(signed(m)).alias("m")) for k, m in masks])
    key = f"(shiftrightunsigned(fp, s * {width}) & {signed((1 << width) - 1)}L) ^ m"
    return points.select("fp", "rep", F.inline(table)).select("fp", "rep", "s", F.expr(key).alias("key"))


def around(entries: DataFrame, balls: dict[int, list[int]]) -> DataFrame:
    """Each entry of a segment's table, and with it the keys of the ball around its own."""
    masks = F.lit(None).cast("array<bigint>")
    for k, ball_ in balls.items():
        masks = F.when(F.col("s") == k, F.array(*[F.lit(signed(m)).cast("long") for m in ball_])).otherwise(masks)
    return entries.select("fp", "rep", "s", "key", F.explode(masks).alias("m")).select("fp", "rep", "s", F.col("key").bitwiseXOR(F.col("m")).alias("key"))


def links(points: DataFrame, distance: int = 2, segments: int = 2, bucket: int = BUCKET) -> DataFrame:
    """points: (fp, rep), distinct fingerprints with their least ids. Returns (a, b), ids of linked ones:
    all pairs within the distance, but for full buckets a star for each name, which connects the same. Who is in a full
    bucket of a segment fetches nothing with it: whom it would find there fetches the full bucket, and both give names. So
    a bucket is fetched by no more than those of the small ones around it."""
    if distance % 2 or 64 % segments:
        raise ValueError("distance must be even and segments divide 64")
    width, (radius, more) = 64 // segments, divmod(distance, segments)
    radii = [radius if k <= more else radius - 1 for k in range(segments)]
    used = [k for k in range(segments) if radii[k] >= 0]
    balls = {k: ball(width, radii[k]) for k in used}
    entries = exploded(points, [(k, 0) for k in used], width)
    full = Written(entries.groupBy("s", "key").agg(F.count("*").alias("n")).where(f"n > {bucket}").select("s", "key"), "full-buckets", few=True).df
    some = not full.isEmpty()
    roomy = entries.join(few_or_all(full), ["s", "key"], "left_anti") if some else entries
    held = roomy.select("s", "key", F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    near = F.expr(f"bit_count(fp ^ fp2) <= {distance}")
    pairs = around(roomy, balls).join(held, ["s", "key"]).where((F.col("fp") != F.col("fp2")) & near).select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))
    if not some:
        return pairs.distinct()
    crowded = around(entries, balls).join(few_or_all(full), ["s", "key"], "left_semi").select("fp", "rep").distinct()
    names = exploded(crowded, [(0, m) for m in ball(64, distance // 2)], 64).select("rep", F.col("key").alias("name"))
    # A name is given by those within half the distance of it alone: a bounded group.
    star = names.join(names.groupBy("name").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1"), "name").where("a <> rep").select("a", F.col("rep").alias("b"))
    return pairs.union(star).distinct()


def classes(points: DataFrame, **how) -> DataFrame:
    """points: (fp, rep). Returns (fp, rep, component_id)."""
    of = components(links(points, **how))
    return points.join(of.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "rep", F.coalesce("root", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, segments: int = 2, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the least id reachable over links
    of at most `distance` differing bits)."""
    with counted_broadcasts(docs.sparkSession):
        return settled(docs.sparkSession, lambda: _near_duplicates(docs, shingle, distance, segments, bucket, id_col, text_col), "near-duplicates", few=True)


def _near_duplicates(docs: DataFrame, shingle: int, distance: int, segments: int, bucket: int, id_col: str, text_col: str) -> DataFrame:
    prints = Written(fingerprints(docs, shingle, id_col, text_col), "fingerprints").df
    points = Written(prints.groupBy("fp").agg(F.min("id").alias("rep")), "points").df
    of = classes(points.where("rep IS NOT NULL"), distance=distance, segments=segments, bucket=bucket)
    joined = prints.join(of.select("fp", "component_id"), "fp", "left")
    return joined.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Groups by similarity: fingerprints and shared rare shingles propose, the sets of shingles decide.
#
# Documents whose fingerprints (over the longer shingles) are linked are proposed first, by the same multi-index hashing. Similar
# documents whose fingerprints differ in more bits share rare shingles: of two sets of a similarity of t or more, the first
# n - ceil(t n) + 1 shingles of each, in any order that is common to all sets, share one. Each set names these as keys,
# the shingles that few documents hold first, and no pair is missed. Keys are told to shards by batches of documents
# (shards.py), and only those that several hold come back. A pair is compared unless its sizes or its bitmaps rule it out:
# a bit tells whether the set holds an odd number of the hashes that fall to it, so sets differ in at least as many
# shingles as bitmaps in bits. Each set has a bitmap of 512 bits, which is looked at before pairs are made, and a wide one of
# two bits a shingle or more, for the pairs. The holders of a key are first compared with the least of them; then, TURNS times,
# each with the nearest of the pivots of its keys in other groups, a pair for each document; then all pairs that are
# still in different groups are, in blocks where more than `bucket` documents hold the key.

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Documents whose shingles are counted to find the frequent ones, and how many of these are told apart. Both
#: only bear on the order.
SAMPLE, FREQUENT = 10_000, 1 << 16
BITS = 512
PART = 512  # documents in a block of a full key
TURNS = 2
#: Ids up to which those to compare are broadcast.
BROADCAST_IDS = 1 << 19
ASK_KEYS = "shard int, batch long, keys binary, counts binary"
KEYS = "batch long, keys binary, held binary"
SHARED = "key long, rep long, n int, held long"


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes."""
    kept("simhash", object)  # nothing; what other operators keep is let go
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    many = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, many, repeat(42)), np.uint64))


def sets_of(named: DataFrame, shingle: int) -> DataFrame:
    """(id, s): the set of shingles of each row."""

    def made(many: list[str]) -> dict:
        import pyarrow as pa

        return {"s": pa.array([shingle_hashes(t, shingle).view(np.int64) for t in many], pa.list_(pa.int64()))}

    return named.mapInArrow(by_batch(made), "id long, s array<long>")


def frequent(named: DataFrame, shingle: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample hold, sorted, and by how many."""
    every = max(1, -(-rows // SAMPLE))
    held = sets_of(named.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0), shingle).select(F.explode("s").alias("h")).groupBy("h").count()
    got = np.array(held.where("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT).collect(), np.int64).reshape(-1, 2)
    h = got[:, 0].copy().view(np.uint64)
    order = np.argsort(h)
    return h[order], got[order, 1]


def prefix(h: np.ndarray, similarity: float, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of a set (sorted) so many shingles, the rare ones first, that a similar set's share one of them."""
    k = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1 if len(h) else 0
    if len(h) and len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        held = np.where(known[at] == h, counts[at], 0)
        if held.any():
            return h[np.lexsort((h, held))[:k]]
    return h[:k]


def bitmap(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The places of a bitmap of half as many bits are these, modulo their number: the halves of this one XORed."""
    odd = np.bincount(((h * _SPREAD) >> np.uint64(24) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide(h: np.ndarray) -> np.ndarray:
    return bitmap(h, max(BITS, 1 << int(2 * len(h) - 1).bit_length()) if len(h) else BITS)


def sketches(named: DataFrame, shingle: int, similarity: float, rows: int) -> DataFrame:
    """(id, same, n, fp, keys, bits, wide): a hash of the set itself, its size, its fingerprint, its rare shingles (mixed, as
    they are the least of all), its bitmaps."""
    known, counts = frequent(named, shingle, rows)

    def made(many: list[str]) -> dict:
        import pyarrow as pa

        out: dict[str, list] = {c: [] for c in ("same", "n", "fp", "keys", "bits", "wide")}
        for t in many:
            h = shingle_hashes(t, shingle)
            for c, x in zip(out, (xxhash.xxh3_128_digest(h.tobytes()), len(h), majority((h[i : i + BLOCK] for i in range(0, len(h), BLOCK))), mixed(prefix(h, similarity, known, counts), 11).tobytes(), bitmap(h), wide(h))):
                out[c].append(x)
        kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return {c: pa.array(x, k) for (c, x), k in zip(out.items(), kinds)}

    return named.mapInArrow(by_batch(made), "id long, same binary, n int, fp long, keys binary, bits array<long>, wide array<long>")


def ask_keys(shards: int):
    """To each shard, the distinct keys of a batch, and how many of its documents name them."""

    def of_batch(table):
        keys, count = np.unique(np.frombuffer(b"".join(table.column("keys").to_pylist()), "<u8"), return_counts=True)
        batch = table.column("batch")[0].as_py()
        return packed([(s, batch, keys[p].tobytes(), count[p].astype(np.uint32).tobytes()) for s, p in by_shard(keys, shards)], "ilbb", ["shard", "batch", "keys", "counts"])

    return of_batch


def answer_keys(table):
    """To each batch, those of its keys that several documents name, and how many do."""
    keys, counts = ([np.frombuffer(x, k) for x in table.column(c).to_pylist()] for c, k in (("keys", "<u8"), ("counts", "<u4")))
    _, number = np.unique(np.concatenate(keys), return_inverse=True)
    total, rows, at = np.bincount(number, weights=np.concatenate(counts)).astype(np.int64), [], 0
    for batch, k in zip(table.column("batch").to_pylist(), keys):
        held = total[number[at : at + len(k)]]
        at += len(k)
        if (hit := held > 1).any():
            rows.append((batch, k[hit].tobytes(), held[hit].tobytes()))
    return packed(rows, "lbb", ["batch", "keys", "held"])


def told(points, answer):
    """A row for each document and key that several name."""
    import pyarrow as pa

    known, held = (np.frombuffer(b"".join(answer.column(c).to_pylist()), k) for c, k in (("keys", "<u8"), ("held", "<i8")))
    order = np.argsort(known)
    known, held = known[order], held[order]
    raw = points.column("keys").to_pylist()
    keys = np.frombuffer(b"".join(raw), "<u8")
    who = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
    at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    hit = np.flatnonzero(known[at] == keys) if len(known) else np.empty(0, np.int64)
    rep, n = (points.column(c).to_numpy() for c in ("rep", "n"))
    return pa.table([pa.array(keys[hit].view(np.int64)), pa.array(rep[who[hit]].astype(np.int64)), pa.array(n[who[hit]].astype(np.int32)), pa.array(held[at[hit]])], ["key", "rep", "n", "held"])


def shared_keys(points: DataFrame, rows: int) -> DataFrame:
    """(key, rep, n, held): the keys of each document that several name, and how many do."""
    batches = max(1, -(-rows // min(MOST_DOCS, max(256, rows // 1000))))
    shards = max(1, batches // BATCHES_PER_SHARD)
    dealt = points.select("rep", "n", "keys", batch_of(F.col("rep"), F.lit(""), batches).alias("batch")).groupBy("batch")
    answers = dealt.applyInArrow(ask_keys(shards), ASK_KEYS).groupBy("shard").applyInArrow(answer_keys, KEYS)
    return dealt.cogroup(answers.groupBy("batch")).applyInArrow(told, SHARED)


def apart_at_most(similarity: float) -> Column:
    """In how many shingles two similar sets of n and n2 can differ."""
    return (F.col("n") + F.col("n2")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def possible(similarity: float) -> Column:
    """Whether sizes n, n2 and bitmaps bits, bits2 allow a pair to be similar."""
    apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits2")[i])) for i in range(BITS // 64)), F.lit(0))
    return sized(similarity) & (apart <= apart_at_most(similarity))


def wide_apart() -> Column:
    """The bits in which wide bitmaps differ: those of similar sizes have as many, or one has twice as many."""
    xor = lambda x, y: x.bitwiseXOR(y)
    half = lambda c: F.zip_with(F.slice(c, 1, (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2).cast("int") + 1, (F.size(c) / 2).cast("int")), xor)
    a = F.when(F.size("wide") > F.size("wide2"), half("wide")).otherwise(F.col("wide"))
    b = F.when(F.size("wide2") > F.size("wide"), half("wide2")).otherwise(F.col("wide2"))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)


def sized(similarity: float) -> Column:
    return F.least("n", "n2") >= F.greatest("n", "n2") * similarity - 1e-6


def other(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}2" for c in df.columns if c not in ("key", "low", "high")})


def ruled_in(pairs: DataFrame, points: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) those that sizes and wide bitmaps allow, with the bits in which these differ (apart)."""
    known = points.select(F.col("rep").alias("a"), "n", "wide")
    met = pairs.join(known, "a").join(other(known).withColumnRenamed("a2", "b"), "b").where(sized(similarity))
    return met.withColumn("apart", wide_apart()).where(F.col("apart") <= apart_at_most(similarity)).select("a", "b", "apart")


def near_prints(points: DataFrame, distance: int, segments: int) -> DataFrame:
    """Pairs (a, b) whose fingerprints are linked: those of the least documents of two fingerprints, and each
    document with the least of its own."""
    least = Written(points.groupBy("fp").agg(F.min("rep").alias("rep")), "prints", few=True)
    equal = points.select("fp", F.col("rep").alias("b")).join(least.df.withColumnRenamed("rep", "a"), "fp").where("a <> b").select("a", "b")
    return links(least.df, distance, segments).union(equal)


def proposals(points: DataFrame, shared: DataFrame, similarity: float, distance: int, segments: int) -> DataFrame:
    """Pairs (a, b): linked fingerprints, and the least document of each key with the others."""
    least = shared.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("s")).select("key", F.col("s.rep").alias("rep2"), F.col("s.n").alias("n2"))
    star = shared.join(least, "key").where((F.col("rep") != F.col("rep2")) & sized(similarity)).select(F.col("rep2").alias("a"), F.col("rep").alias("b"))
    return ruled_in(star.union(near_prints(points, distance, segments)).distinct(), points, similarity).select("a", "b")


def still_open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of shared whose keys are in different groups so far, with the groups (root)."""
    rooted = shared.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return Written(rooted.join(open_, "key"), "open").df


def nearest(points: DataFrame, rooted: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Pairs (a, b): each key has one document for a pivot, another one each turn, and each document is paired with that
    pivot of another group to which it is nearest by bitmaps. So where many hold a key, few pairs put most together."""
    pivot = rooted.groupBy("key").agg(F.min_by(F.struct("rep", "root", "n"), F.xxhash64("key", "rep", F.lit(turn))).alias("p")).select("key", F.col("p.rep").alias("rep2"), F.col("p.root").alias("root2"), F.col("p.n").alias("n2"))
    met = rooted.join(pivot, "key").where((F.col("root") != F.col("root2")) & sized(similarity)).select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct()
    best = ruled_in(met, points, similarity).groupBy("a").agg(F.min(F.struct("apart", "b")).alias("x")).select("a", "x.b")
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def remaining(points: DataFrame, rooted: DataFrame, similarity: float, bucket: int) -> DataFrame:
    """Pairs (a, b) that share a key and are in different groups so far."""
    apart = (F.col("rep") < F.col("rep2")) & (F.col("root") != F.col("root2"))
    pair = [F.col("rep").alias("a"), F.col("rep2").alias("b")]
    few = rooted.where(f"held <= {bucket}").select("key", "rep", "root", "n")
    inner = few.join(other(few), "key").where(apart & sized(similarity)).select(*pair)
    # Where many hold a key, bitmaps are looked at before pairs are made.
    rows = rooted.where(f"held > {bucket}").join(points.select("rep", "bits"), "rep").select("key", "rep", "root", "n", "bits", F.ceil(F.col("held") / PART).cast("int").alias("parts"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "o").alias("low"), F.greatest("part", "o").alias("high"), "part", "rep", "root", "n", "bits")
    once = (F.col("low") == F.col("high")) | (F.col("part") != F.col("part2"))
    met = rows.join(other(rows), ["key", "low", "high"]).where(apart & once & possible(similarity))
    return ruled_in(inner.union(met.select(*pair)).distinct(), points, similarity).select("a", "b")


def alike(named: DataFrame, pairs: DataFrame, shingle: int, similarity: float, repeated: bool) -> DataFrame:
    """Of the pairs those whose sets are similar, or of an id in several rows any of its sets."""
    wanted = Written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted", few=True).df
    sets = sets_of(named.join(few_or_all(wanted, BROADCAST_IDS), "id", "left_semi"), shingle)
    sets = Written(sets.distinct() if repeated else sets, "sets").df
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    common = met.select("a", "b", F.size("x").alias("p"), F.size("y").alias("q"), F.size(F.array_intersect("x", "y")).alias("c"))
    return common.where(F.col("c") >= similarity * (F.col("p") + F.col("q") - F.col("c"))).select("a", "b")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 2, segments: int = 2, bucket: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id: id, component_id: the least id reachable over pairs whose sets of shingles have a
    Jaccard similarity of at least `similarity`. Texts without words are alike. Null ids give no row."""
    with counted_broadcasts(docs.sparkSession):
        return settled(docs.sparkSession, lambda: _similar_groups(docs, shingle, similarity, distance, segments, bucket, id_col, text_col), "groups", few=True)


def _similar_groups(docs: DataFrame, shingle: int, similarity: float, distance: int, segments: int, bucket: int, id_col: str, text_col: str) -> DataFrame:
    named = two_columns(docs, id_col, text_col).withColumn("id", F.col("id").cast("long")).where("id IS NOT NULL")
    n = named.count()
    sketch = Written(sketches(named, shingle, similarity, n), "sketches").df
    # Of equal sets only the row of the least id goes on.
    least = Written(sketch.groupBy("same").agg(F.min("id").alias("rep")), "least", few=True).df
    copies = sketch.select("id", "same").join(least, "same").where("id <> rep").select("id", "same")
    points = Written(sketch.join(copies, ["id", "same"], "left_anti").withColumnRenamed("id", "rep"), "points").df
    shared = Written(shared_keys(points, n), "shared").df
    repeated = not sketch.groupBy("id").count().where("count > 1").isEmpty()
    close = Written(alike(named, Written(proposals(points, shared, similarity, distance, segments), "proposals", few=True).df, shingle, similarity, repeated), "alike", few=True).df
    of = components(close)
    rooted = still_open(shared, of)
    for turn in range(TURNS):
        pairs = Written(nearest(points, rooted, similarity, turn), "nearest", few=True).df
        if pairs.isEmpty():
            break
        close = Written(close.union(alike(named, pairs, shingle, similarity, repeated)), "alike", few=True).df
        of = components(close)
        rooted = still_open(rooted.drop("root"), of)
    rest = Written(remaining(points, rooted, similarity, bucket), "remaining", few=True).df
    if not rest.isEmpty():
        of = components(close.union(alike(named, rest, shingle, similarity, repeated)))
    classes = least.join(of.select(F.col("node").alias("rep"), "root"), "rep", "left").select("same", F.coalesce("root", "rep").alias("component_id"))
    return sketch.select("id", "same").join(classes, "same").groupBy("id").agg(F.min("component_id").alias("component_id")).withColumnRenamed("id", id_col)
