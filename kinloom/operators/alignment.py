"""Differences between sequences: edit scripts, affine alignment, amplicons between primers.

What runs in Arrow batches here is sequential by nature; rows of a dynamic programme are numpy vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ship, spread
from ..functions.sequence import reverse_complement

DELTA = "array<struct<pos:int,op:string,base:string>>"
BAND, MAX_OPS = 64, 1000
FAR = 1 << 29


def edit_script(read: str, path: str, band: int = BAND, max_ops: int = MAX_OPS) -> list[tuple[int, str, str]] | None:
    """What turns path into read: S (another base), D (path's base left out), I (a base put in before the
    place). Equal lengths: substitutions alone. Else the least edits within a band around the diagonal, a
    diagonal step preferred to D, and D to I, from the end. None if there are too many, or the lengths differ by more
    than the band; empty for equal sequences."""
    if len(read) == len(path):
        a, b = np.frombuffer(read.encode("utf-32-le"), "<u4"), np.frombuffer(path.encode("utf-32-le"), "<u4")
        at = np.flatnonzero(a != b)
        return None if len(at) > max_ops else [(int(i), "S", read[i]) for i in at]
    n, m, width = len(path), len(read), 2 * band + 1
    if abs(n - m) > band:
        return None
    r, p = (np.frombuffer(x.encode("utf-32-le"), "<u4") for x in (read, path))
    o = np.arange(width)
    row = np.where((o - band >= 0) & (o - band <= m), o - band, FAR)
    rows = [row]
    for i in range(1, n + 1):  # column j of row i lies at j - i + band
        j = o + i - band
        inside = (j >= 1) & (j <= m)
        cost = np.where(inside, r[np.clip(j - 1, 0, max(m - 1, 0))] != p[i - 1], 0) if m else np.zeros(width, int)
        down = np.append(row[1:], FAR) + 1
        best = np.where(inside, np.minimum(row + cost, down), FAR)
        if i <= band:
            best[band - i] = i
        row = np.minimum(np.minimum.accumulate(best - o) + o, FAR)
        row[(j < 0) | (j > m)] = FAR
        rows.append(row)
    if rows[n][m - n + band] >= FAR:
        return None
    i, j, back = n, m, []
    while i or j:
        if len(back) > max_ops:
            return None
        here, at = rows[i][j - i + band], j - i + band
        differs = i > 0 and j > 0 and path[i - 1] != read[j - 1]
        if i and j and here == rows[i - 1][at] + differs:
            if differs:
                back.append((i - 1, "S", read[j - 1]))
            i, j = i - 1, j - 1
        elif i and at + 1 < width and here == rows[i - 1][at + 1] + 1:
            back.append((i - 1, "D", path[i - 1]))
            i -= 1
        else:
            back.append((i, "I", read[j - 1]))
            j -= 1
    return None if len(back) > max_ops else back[::-1]


def apply_script(path: str, script: list) -> str:
    """The read that a script makes of the path."""
    out, at = [], 0
    for pos, op, base in script:
        if pos > at:
            out.append(path[at:pos])
            at = min(pos, len(path))
        if op == "I":
            out.append(base)
        elif at < len(path):
            out.append(base if op == "S" else "")
            at += 1
    return "".join(out) + path[at:]


def affine_edits(query: str, target: str, match: int = 1, mismatch: int = -2, gap_open: int = 4, gap_extend: int = 2) -> tuple[int, int]:
    """(edits, score) of a global alignment with affine gaps, a gap of k costing open + k * extend; N (anything
    but A, C, G, T) scores 0. Of alignments of the best score the one of fewest edits: both are added up in
    one number, the score in large units and the edits in small ones. One empty: the other's length."""
    if not query or not target:
        return max(len(query), len(target)), 0
    if query == target:
        return 0, match * len(query)
    unit = 4 * (len(query) + len(target)) + 4
    known = np.zeros(256, bool)
    known[[ord(c) for c in "ACGTacgt"]] = True
    q, t = (np.frombuffer(x.encode("latin-1", "replace"), np.uint8) for x in (query, target))
    fold = lambda x: np.where((x >= 97) & (x <= 122), x - 32, x)
    open_, extend = gap_open * unit, gap_extend * unit + 1
    cols, low = np.arange(len(t) + 1), -(1 << 60)
    h = -(open_ + cols * extend)
    h[0] = 0
    f = np.full(len(t) + 1, low)
    for i in range(1, len(q) + 1):
        both = known[q[i - 1]] & known[t]
        score = np.where(both, np.where(fold(t) == fold(q[i - 1 : i])[0], match, mismatch), 0) * unit - (t != q[i - 1])
        f = np.maximum(f - extend, h - open_ - extend)
        best = f.copy()
        best[1:] = np.maximum(best[1:], h[:-1] + score)
        along = np.maximum.accumulate(best + cols * extend) - open_ - cols * extend
        h = best
        h[1:] = np.maximum(h[1:], along[:-1] - extend)
    value = int(h[-1])
    total = -((-value) // unit)
    return total * unit - value, total


def _mapped(df: DataFrame, columns: list[str], function, name: str, kind: str, arrow) -> DataFrame:
    """Adds a column that `function` makes of the values of `columns`, in Arrow batches."""
    ship(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {name} {kind}"
    at = [df.columns.index(c) for c in columns]

    def made(batches):
        import pyarrow as pa

        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([function(*r) for r in rows], arrow(pa))], [*b.schema.names, name])

    return spread(df).mapInArrow(made, schema)  # alignments cost far more than dealing out their sequences


def encode_deltas(df: DataFrame, read: str = "read_seq", path: str = "path_seq") -> DataFrame:
    """Adds deltas, null where the two are too far apart for a script; null sequences count as empty."""
    kind = lambda pa: pa.list_(pa.struct([("pos", pa.int32()), ("op", pa.string()), ("base", pa.string())]))
    make = lambda r, p: None if (s := edit_script(r or "", p or "")) is None else [dict(zip(("pos", "op", "base"), x)) for x in s]
    return _mapped(df, [read, path], make, "deltas", DELTA, kind)


def reconstruct(df: DataFrame, path: str = "path_seq", deltas: str = "deltas") -> DataFrame:
    """Adds rebuilt, the read of a path and its deltas; null where there is no script."""
    make = lambda p, d: None if d is None else apply_script(p or "", [(x["pos"], x["op"], x["base"]) for x in d])
    return _mapped(df, [path, deltas], make, "rebuilt", "string", lambda pa: pa.string())


def substitutions(df: DataFrame, read: str = "read_seq", path: str = "path_seq") -> DataFrame:
    """The deltas of rows whose sequences are equally long, in built-in functions: rows (..., pos, op, base)."""
    pairs = F.zip_with(F.split(read, ""), F.split(path, ""), lambda a, b: F.when(a != b, a))
    each = df.where(F.length(read) == F.length(path)).select("*", F.posexplode(pairs).alias("pos", "base"))
    return each.where("base IS NOT NULL").select(*df.columns, "pos", F.lit("S").alias("op"), "base")


#: Rows up to which a list given by hand is one; beyond it the caller has passed a table by mistake.
STATED = 10_000


def stated(df: DataFrame) -> DataFrame:
    """A list given by hand, broadcast once its length is known."""
    if df.limit(STATED + 1).count() > STATED:
        raise ValueError(f"a list of more than {STATED} rows")
    return F.broadcast(df)


def cigar_identity(cigar: Column | str, matches: Column | str | None = None, length: Column | str | None = None) -> Column:
    """The share of matches of an alignment: matches over block length where the aligner tells both, else that of = (or,
    where there is none, M) in all columns of the CIGAR but clipped and skipped ones; 0 for an empty one."""
    ops = F.regexp_extract_all(F.col(cigar) if isinstance(cigar, str) else cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    total = lambda kinds: F.aggregate(F.filter(ops, lambda x: F.right(x, F.lit(1)).isin(*kinds)), F.lit(0).cast("long"), lambda s, x: s + F.regexp_extract(x, "^[0-9]+", 0).cast("long"))
    same, columns = F.when(total("=X") > 0, total("=")).otherwise(total("M")), total("MID=X")
    walked = F.when(columns > 0, same / columns).otherwise(0.0)
    if matches is None or length is None:
        return walked
    m, n = (F.col(x) if isinstance(x, str) else x for x in (matches, length))
    return F.when(n > 0, m / n).otherwise(walked)


def somatic_deltas(contigs: DataFrame, refs: DataFrame, match: int = 1, mismatch: int = -2, gap_open: int = 4, gap_extend: int = 2) -> DataFrame:
    """contigs: (contig_id, seq); refs: (ref_name, ref_seq), the first sequence of each reference, a list
    given by hand. Rows (contig_id, ref_name, contig_bp, ref_bp, edits, identity). Equal sequences and empty
    ones are decided before the alignment."""
    pairs = contigs.select("contig_id", "seq").crossJoin(stated(refs.select("ref_name", "ref_seq")))  # the stated references against all rows
    longest = F.greatest(F.length("seq"), F.length("ref_seq"))
    sure = (F.col("seq") == F.col("ref_seq")) | (F.length("seq") == 0) | (F.length("ref_seq") == 0)
    plain = pairs.where(sure).withColumn("edits", F.when(F.col("seq") == F.col("ref_seq"), 0).otherwise(longest).cast("int"))
    rest = _mapped(pairs.where(~sure), ["seq", "ref_seq"], lambda q, t: affine_edits(q, t, match, mismatch, gap_open, gap_extend)[0], "edits", "int", lambda pa: pa.int32())
    both = plain.unionByName(rest)
    identity = F.when(longest > 0, 1 - F.col("edits") / longest).otherwise(1.0)
    return both.select("contig_id", "ref_name", F.length("seq").alias("contig_bp"), F.length("ref_seq").alias("ref_bp"), "edits", identity.alias("identity"))


def places(seq: str, pattern: str, most: int) -> np.ndarray:
    """Where the pattern is found with at most so many mismatches, case aside."""
    s, p = (np.frombuffer(x.upper().encode("latin-1", "replace"), np.uint8) for x in (seq, pattern))
    if not len(p) or len(p) > len(s):
        return np.empty(0, np.int64)
    n = len(s) - len(p) + 1
    wrong = np.zeros(n, np.int32)
    for i, c in enumerate(p):
        wrong += s[i : i + n] != c
    return np.flatnonzero(wrong <= most)


def scan_amplicons(reads: DataFrame, primers: list[tuple[str, str, str]], max_mismatches: int = 2, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """primers: (name, forward, reverse). Rows (read_id, primer, start, end, amplicon): from each place of the
    forward primer to the end of each place of the reverse primer's complement that begins after it."""
    ship(reads.sparkSession)
    turn = str.maketrans("ACGT", "TGCA")
    pairs = [(name, fwd, "".join(c if c in "ACGT" else "N" for c in rev.upper()).translate(turn)[::-1]) for name, fwd, rev in primers]
    named = reads.select(F.col(id_col).alias("read_id"), F.col(seq_col).alias("seq"))

    def found(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for i, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for name, fwd, rev in pairs:
                    ends = places(seq or "", rev, max_mismatches)
                    for a in places(seq or "", fwd, max_mismatches).tolist() if len(ends) else ():
                        rows += [(i, name, a, e + len(rev), seq[a : e + len(rev)]) for e in ends[np.searchsorted(ends, a + len(fwd), "right") :].tolist()]
            kinds = (b.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["read_id", "primer", "start", "end", "amplicon"])

    return named.mapInArrow(found, f"read_id {named.schema['read_id'].dataType.simpleString()}, primer string, start int, end int, amplicon string")


def scan_exact(reads: DataFrame, primers: DataFrame, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """The same without mismatches in built-in functions; primers is a small table (primer, fwd, rev)."""
    pairs = primers.select("primer", F.upper("fwd").alias("fwd"), reverse_complement("rev").alias("rev"))
    seq = F.upper("seq")

    def hits(p: str):
        """Every place of a pattern: the text cut before each, and the lengths of the pieces added up."""
        pieces = F.split(seq, F.concat(F.lit("(?="), F.col(p), F.lit(")")), -1)
        start = F.struct(F.lit(0).alias("at"), F.when(seq.startswith(F.col(p)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(x))).alias("out"))
        return F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, step, lambda acc: acc["out"])

    some = (F.instr(seq, F.col("fwd")) > 0) & (F.instr(seq, F.col("rev")) > 0)
    both = reads.select(F.col(id_col).alias("read_id"), F.col(seq_col).alias("seq")).crossJoin(stated(pairs)).where(some)  # the stated primers against all rows
    a = both.select("*", F.explode(hits("fwd")).alias("start")).select("*", F.explode(hits("rev")).alias("rev_at"))
    kept = a.where(F.col("rev_at") > F.col("start") + F.length("fwd")).withColumn("end", F.col("rev_at") + F.length("rev"))
    return kept.select("read_id", "primer", "start", "end", F.substring("seq", F.col("start") + 1, F.col("end") - F.col("start")).alias("amplicon"))
