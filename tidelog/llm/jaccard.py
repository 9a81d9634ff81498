"""N-gram Jaccard self-join through parity sketches.

A document's set holds its distinct five-word shingles. Documents with equal
sets form a class; the join works on classes. Two sets that link
(intersection over union of at least 3/4) differ in at most (a + b) / 7
shingles, a and b being their sizes.

For each size band, the shingles are dealt over p parts by hash, and each part
keeps the XOR of its shingles' hashes: a sketch of p symbols in which a
shingle touches one symbol, so that the Hamming distance of two sketches is at
most the sets' symmetric difference. With d differences at most, p - d parts
agree, and by the pigeonhole principle the first d + 1 symbols of both, in
any order that all documents share, have one in common. Symbols found often in
a sample come last in this order, which keeps common passages out of the
candidates without losing a link. Empty parts make no symbol; a set with too
few filled parts also gives its single shingles as keys, which meet only each
other's.

A key that is very common in the sample is hot: its classes are shuffled in
parts, never as one group. Classes that share a key are compared with the one of them that has the most
company; components of the verified links are formed. Groups that then still
hold several components are gone through twice: for the nearest pairs that
would connect them, and at last for every pair between components that is
left; large ones are dealt to tasks as blocks. Pairs are first tested by the Hamming distance of bit sketches, in
which a shingle flips one bit, then exactly.

Cases with a defined result: a null text or one without words has an empty
set, links with nothing and is its own component; a text of fewer than five
words has one shingle; repeated rows and equal sets link; a null doc_id is
kept and never the name of a component with other ids; other columns are
ignored; a text of any length is read whole; an empty table gives an empty
result. Sets are named by 64 bits of hash, and by 64 others where two different
sets share these. The similarity and the shingle
length are those stated above.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import arrow_map, text_bytes
from ._joins import join_counted
from ._words import grams, mix, words
from .components import components
from .storage import scratch, written

SHINGLE = 5
#: Size bands grow by this factor.
BAND = 3
#: Documents in the sample that shows which symbols are common, how often one occurs in it to be so, and the most that are told apart.
SAMPLE, COMMON, MOST_COMMON = 16_384, 2, 1 << 20
#: How often a symbol occurs in the sample for its classes to be spread over tasks, and classes that a task compares with as many others.
HOT, BLOCK = 64, 256
#: Keys a task gets in the join, about.
KEYS_PER_BUCKET = 1_000_000
#: Rows of candidates up to which they are broadcast instead of shuffling the texts.
BROADCAST_ROWS = 1_000_000
_U = np.uint64


def shingle_sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    body, offsets = text_bytes(batch)
    hashes, rows, _, _ = words(body, offsets, lower=True)
    found = []
    edge = np.searchsorted(rows, np.arange(batch.num_rows + 1))
    all_grams = grams(hashes, SHINGLE)
    for i in range(batch.num_rows):
        a, b = int(edge[i]), int(edge[i + 1])
        if b - a >= SHINGLE:
            found.append(np.unique(all_grams[a : b - SHINGLE + 1]))
        elif b > a:
            found.append(grams(hashes[a:b], b - a, salt=b - a))
        else:
            found.append(np.zeros(0, _U))
    return found


def fingerprints(s: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of the whole set; together they stand for it."""
    with np.errstate(over="ignore"):
        x, y = mix(s, 3), mix(s, 5)
        raw = np.array([x.sum() ^ (np.bitwise_xor.reduce(y) * _U(3)), y.sum() ^ (np.bitwise_xor.reduce(x) * _U(5))], _U) ^ _U(len(s))
    one, two = mix(raw, 9).view(np.int64).tolist()
    return one, two


def named(one: int, two: int, clashes: frozenset[int], bits: int) -> int:
    """The first hash (of so many bits), or the second where different sets have that first one."""
    one >>= 64 - bits
    return two if one in clashes else one


def signature(s: np.ndarray, clashes: frozenset[int] = frozenset(), bits: int = 64) -> int:
    """The name of a set."""
    return named(*fingerprints(s), clashes, bits)


def _scheme(a: int) -> list[tuple[int, int, int]]:
    """(scheme, parts, most differences) for a set of size a: its band, and the borders to the neighbouring ones."""
    found = []
    low = 1
    k = 0
    while low * BAND <= a:
        low *= BAND
        k += 1
    high = low * BAND
    parts = lambda most: -(-7 * most // 5) + 4
    d = (a + min(4 * a // 3, high - 1)) // 7
    if d:
        found.append((2 * k, parts((2 * (high - 1)) // 7), d))
    if 4 * a // 3 >= high and (d := (a + 4 * a // 3) // 7):  # with larger sets in the next band
        found.append((2 * k + 1, parts((high - 1) // 3), d))
    if low > 1 and 3 * a <= 4 * (low - 1) and (d := (a + low - 1) // 7):  # with smaller sets in the band before
        found.append((2 * k - 1, parts((low - 1) // 3), d))
    return found


def keys_of(sets: list[np.ndarray], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the positions of their sets."""
    jobs = [(i, *s) for i, x in enumerate(sets) for s in _scheme(len(x))]
    if not jobs:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    table = np.array(jobs, np.int64)
    lens = np.array([len(sets[i]) for i in table[:, 0]], np.int64)
    flat = np.concatenate([sets[i] for i in table[:, 0]])
    job = np.repeat(np.arange(len(jobs)), lens)
    # sorted by hash, so that the parts of a set are runs
    part = ((flat >> _U(32)) * table[job, 2].astype(_U)) >> _U(32)
    edge = np.flatnonzero(np.append(True, (job[1:] != job[:-1]) | (part[1:] != part[:-1])))
    symbol = np.bitwise_xor.reduceat(mix(flat, 7), edge)
    job_of, part_of = job[edge], part[edge]
    with np.errstate(over="ignore"):
        key = mix(symbol + part_of * _U(0x9FB21C651E98DF25) + table[job_of, 1].astype(_U) * _U(0xD6E8FEB86659FD93), 11)
    # rank of each symbol among its set's: rare ones first, then by part
    often = _among(key, common)
    first = np.flatnonzero(np.append(True, job_of[1:] != job_of[:-1]))
    filled = np.diff(np.append(first, len(key)))
    rare_n = np.add.reduceat((~often).astype(np.int64), first)
    run_rare, run_often = np.cumsum(~often), np.cumsum(often)
    base = np.repeat(first, filled)
    rare_rank = run_rare - (run_rare[base] - ~often[base]) - 1
    often_rank = run_often - (run_often[base] - often[base]) - 1 + np.repeat(rare_n, filled)
    rank = np.where(often, often_rank, rare_rank)
    keep = rank <= table[job_of, 3]
    keys, owner = [key[keep]], [table[job_of[keep], 0]]
    # sets with so many empty parts that a link need not leave a filled one equal
    missing = table[:, 2] - filled
    for j in np.flatnonzero(table[:, 2] - table[:, 3] - missing <= 0).tolist():
        i = int(table[j, 0])
        with np.errstate(over="ignore"):
            keys.append(mix(sets[i] + _U(int(table[j, 1]) + 1) * _U(0xA24BAED4963EE407), 13))
        owner.append(np.full(len(sets[i]), i, np.int64))
    return np.concatenate(keys), np.concatenate(owner)


def bits_of(n):
    """Bits of the sketch of a set of size n: the power of two from 4 n on, so that few shingles share a bit."""
    return 1 << np.maximum(9, np.ceil(np.log2(np.maximum(n, 1)) + 2)).astype(np.int64)


def parity(s: np.ndarray) -> bytes:
    """A bit sketch; each shingle flips one bit."""
    bits = int(bits_of(len(s)))
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(sketch: bytes, bits: int) -> np.ndarray:
    """A sketch with fewer bits: halves are XORed."""
    words = np.frombuffer(sketch, _U)
    while 64 * len(words) > bits:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _members(df: DataFrame, clashes: frozenset[int], bits: int) -> DataFrame:
    """(doc_id, t, n_shingles, sig, second, sketch) of every document, t being a hash of the text; the last three are null without shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch)
        sizes = pa.array([len(s) for s in sets], pa.int64())
        both = [fingerprints(s) if len(s) else (None, None) for s in sets]
        sigs = pa.array([named(*x, clashes, bits) if len(s) else None for s, x in zip(sets, both, strict=True)], pa.int64())
        seconds = pa.array([x[1] for x in both], pa.int64())
        sketches = pa.array([parity(s) if len(s) else None for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), sizes, sigs, seconds, sketches], ["doc_id", "t", "n_shingles", "sig", "second", "sketch"])

    keyed = df.withColumn("t", F.xxhash64("text"))
    return keyed.mapInArrow(arrow_map(run), "doc_id long, t long, n_shingles long, sig long, second long, sketch binary")


def _common_keys(df: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur often in a sample of documents, and those of them that occur very often; they set the order of keys and how these are shuffled."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, _ = keys_of(shingle_sets(batch), np.zeros(0, _U))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    every = max(1, rows // SAMPLE)
    sample = df.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)
    often = sample.mapInArrow(arrow_map(run), "key long").groupBy("key").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(MOST_COMMON)
    found = often.collect()
    as_keys = lambda keys: np.sort(np.array(keys, np.int64).view(_U))
    return as_keys([r["key"] for r in found]), as_keys([r["key"] for r in found if r["count"] >= HOT])


def _among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys if len(table) else np.zeros(len(keys), bool)


def _groups(df: DataFrame, buckets: int, common: np.ndarray, hot: np.ndarray, clashes: frozenset[int], bits: int) -> DataFrame:
    """(key, members): arrays of at least two classes that share a key, with a null key; for a hot key, parts of its classes with the key."""

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_sig = {signature(s, clashes, bits): s for s in shingle_sets(batch) if len(s)}
        sigs = np.array(list(by_sig), np.int64)
        keys, owner = keys_of(list(by_sig.values()), common)
        bucket = (mix(keys, 17) % _U(buckets)).astype(np.int64)
        spread = np.flatnonzero(_among(keys, hot))  # a hot key's classes are dealt over as many buckets again
        bucket[spread] = buckets + (mix(sigs[owner[spread]].view(_U), 19) % _U(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        keys, owner, bucket = keys[by], owner[by], bucket[by]
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        rows: list[tuple] = []
        for a, b in pairwise([*edge.tolist(), len(keys)]):
            used, index = np.unique(owner[a:b], return_inverse=True)
            k = keys[a:b]
            rows.append((int(bucket[a]), sigs[used].tobytes(), index.astype("<u2" if len(used) < 65536 else "<u4").tobytes(), (k >> _U(32)).astype("<u4").tobytes(), ((k >> _U(16)) & _U(0xFFFF)).astype("<u2").tobytes()))
        names = ["bucket", "sigs", "at", "high", "low"]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, sigs = [], []
        for s, at, high, low in zip(pdf["sigs"], pdf["at"], pdf["high"], pdf["low"], strict=True):
            h = np.frombuffer(high, "<u4").astype(_U)
            keys.append(h << _U(16) | np.frombuffer(low, "<u2").astype(_U))
            sigs.append(np.frombuffer(s, np.int64)[np.frombuffer(at, "<u2" if len(at) == 2 * len(h) else "<u4")])
        key, sig = np.concatenate(keys), np.concatenate(sigs)
        parted = int(pdf["bucket"].iloc[0]) >= buckets
        if not parted:
            by = np.argsort(key, kind="stable")
            key = key[by]
            twice = np.zeros(len(key), bool)
            twice[1:] = key[1:] == key[:-1]
            twice[:-1] |= twice[1:]
            key, sig = key[twice], sig[by][twice]
        by = np.lexsort((sig, key))
        key, sig = key[by], sig[by]
        new = np.append(True, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])) if len(key) else np.zeros(0, bool)
        key, sig = key[new], sig[new]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        seen: set[bytes] = set()
        found, names = [], []
        for a, b in pairwise([*edge.tolist(), len(key)]):
            if parted:
                found.append(sig[a:b])
                names.append(int(key[a]))
            elif b - a > 1 and (raw := sig[a:b].tobytes()) not in seen:
                seen.add(raw)
                found.append(sig[a:b])
                names.append(None)
        return pd.DataFrame({"key": pd.Series(names, dtype="Int64"), "members": pd.Series(found, dtype=object)})

    packed = df.mapInArrow(arrow_map(pack), "bucket int, sigs binary, at binary, high binary, low binary")
    return packed.groupBy("bucket").applyInPandas(meet, "key long, members array<long>")


def _may_link(n_a: int, n_b: int, sketch_a: bytes, sketch_b: bytes) -> bool:
    """What sizes and the Hamming distance of the sketches allow."""
    if 100 * min(n_a, n_b) < 75 * max(n_a, n_b):
        return False
    x, y = int.from_bytes(sketch_a, "little"), int.from_bytes(sketch_b, "little")
    if len(sketch_a) != len(sketch_b):
        half = 8 * min(len(sketch_a), len(sketch_b))
        x, y = (v >> half ^ v & (1 << half) - 1 if 8 * len(s) > half else v for v, s in ((x, sketch_a), (y, sketch_b)))
    return 7 * (x ^ y).bit_count() <= n_a + n_b


def _beside(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs (a, b) with the columns of both classes, named with _a and _b."""
    side = lambda x: table.select(*[F.col(c).alias(x if c == "sig" else f"{c}_{x}") for c in table.columns])
    # a merge join at every size: what is shuffled then follows the input
    return pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that sizes and sketches don't rule out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            good = [_may_link(*x) for x in zip(p["n_a"], p["n_b"], p["sketch_a"], p["sketch_b"], strict=True)]
            yield p.loc[np.array(good, bool), ["a", "b"]]

    return _beside(pairs, classes.select("sig", "n", "sketch")).mapInPandas(run, "a long, b long")


def _verified(df: DataFrame, pairs: DataFrame, classes: DataFrame, clashes: frozenset[int], bits: int) -> DataFrame:
    """The pairs (a, b) that link, from the shingles of both."""
    nodes = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    picked = written(classes.join(nodes, "sig", "left_semi").select("sig", F.col("least").alias("doc_id"), "t"))
    size = picked.agg(F.count("*").alias("rows"), F.count("doc_id").alias("named")).first()
    sent = (lambda x: F.broadcast(x)) if size["rows"] <= BROADCAST_ROWS else (lambda x: x)
    texts = df.join(sent(picked.select("sig", "doc_id")), "doc_id").select("sig", "text")
    if size["named"] < size["rows"]:  # classes whose ids are all null, by the hash of a text; its copies count once
        bare = df.filter("doc_id is null").groupBy(F.xxhash64("text").alias("t")).agg(F.first("text").alias("text"))
        texts = texts.union(bare.join(sent(picked.filter("doc_id is null").select("sig", "t")), "t").select("sig", "text"))

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(int(g), s.tobytes()) for g, s in zip(batch.column("sig").to_pylist(), shingle_sets(batch), strict=True) if len(s) and signature(s, clashes, bits) == g]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["sig", "shingles"])

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            good = []
            for x, y in zip(p["shingles_a"], p["shingles_b"], strict=True):
                s, t = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * both >= 75 * (len(s) + len(t) - both))
            yield p.loc[np.array(good, bool), ["a", "b"]]

    sets = written(texts.mapInArrow(arrow_map(shingles), "sig long, shingles binary"))
    return _beside(pairs, sets).select("a", "b", "shingles_a", "shingles_b").mapInPandas(exact, "a long, b long").distinct()


def _hubs(groups: DataFrame) -> DataFrame:
    """(g, k, hub, sig): the members of groups of more than two, with the group's size and its most connected class.

    The class with the most company over all groups stands nearest to the
    others, as an original does to its edited copies.
    """
    whole = groups.filter(F.col("key").isNull() & (F.size("members") > 2)).select(F.xxhash64("members").alias("g"), F.size("members").cast("long").alias("k"), F.explode("members").alias("sig"))
    parts = written(groups.filter("key is not null").select(F.xxhash64(F.lit("key"), "key").alias("g"), F.explode("members").alias("sig")).distinct())
    sizes = parts.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1")
    flat = written(whole.distinct().union(parts.join(sizes, "g").select("g", "k", "sig")))
    company = written(flat.groupBy("sig").agg(F.sum("k").alias("company")))
    hubs = flat.join(company, "sig").groupBy("g").agg(F.max(F.struct("company", "sig")).alias("hub")).select("g", F.col("hub.sig").alias("hub"))
    return flat.join(written(hubs), "g").select("g", "k", "hub", "sig")


def _stars(groups: DataFrame, flat: DataFrame) -> DataFrame:
    """Pairs (a, b) of each group's hub with the others."""
    two = groups.filter(F.col("key").isNull() & (F.size("members") == 2)).select(F.col("members")[0].alias("a"), F.col("members")[1].alias("b"))
    starred = flat.filter("sig <> hub").select(F.least("sig", "hub").alias("a"), F.greatest("sig", "hub").alias("b"))
    return two.union(starred).distinct()


def _units(flat: DataFrame) -> DataFrame:
    """(unit, sig): the groups of a hub as one unit where that makes fewer pairs, else each group.

    Every two members of a group are together in a unit.
    """
    sizes = flat.groupBy("hub").agg(F.count_distinct("sig").alias("u"), F.sum("k").alias("pairs"))
    whole = F.col("u") * F.col("u") <= F.col("pairs")
    unit = F.when(whole, F.xxhash64(F.lit("hub"), "hub")).otherwise(F.xxhash64(F.lit("group"), "g"))
    return flat.join(written(sizes), "hub").select(unit.alias("unit"), "sig").distinct()


def _forest(pairs: list[tuple[int, int, float]], root: list[int]) -> list[tuple[int, int, float]]:
    """The nearest pairs that connect all components which the pairs connect."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    kept = []
    for p in sorted(pairs, key=lambda p: p[2]):
        x, y = find(root[p[0]]), find(root[p[1]])
        if x != y:
            parent[x] = y
            kept.append(p)
    return kept


def _likely_between(n: list[int], root: list[int], sketches: list[bytes]) -> list[tuple[int, int, float]]:
    """(i, j, distance) of the likely pairs of different roots; n rises."""
    if len(n) <= 8:
        return [(i, j, 0.0) for j in range(len(n)) for i in range(j) if root[i] != root[j] and _may_link(n[i], n[j], sketches[i], sketches[j])]
    sizes, roots = np.array(n), np.array(root)
    bits = bits_of(sizes)
    found = []
    for m in np.unique(bits).tolist():  # partners of larger size have as many bits or twice as many
        low, own, high = np.searchsorted(bits, [m, m + 1, 2 * m + 1]).tolist()
        table = np.stack([_folded(x, m) for x in sketches[low:high]])
        for i in range(low, own):  # each with the larger sets that may link
            stop = min(high, int(np.searchsorted(sizes, n[i] * 100 // 75, side="right")))
            j = np.arange(i + 1, stop)
            j = j[roots[j] != root[i]]
            if len(j):
                apart = np.bitwise_count(table[j - low] ^ table[i - low]).sum(axis=1, dtype=np.int64)
                near = 7 * apart <= sizes[j] + n[i]
                found += zip([i] * int(near.sum()), j[near].tolist(), (apart[near] / (sizes[j] + n[i])[near]).tolist(), strict=True)
    return found


def _blocks(named: DataFrame) -> DataFrame:
    """(unit, r, c, sig, root): the members of units of several components, dealt to tasks.

    A small unit is one block. In a large one, the classes outside of its
    largest component, which are few where copies crowd, form rows of blocks
    and all classes form columns; every row meets every column.
    """
    sizes = named.groupBy("unit", "root").agg(F.count("*").alias("n"))
    units = sizes.groupBy("unit").agg(F.sum("n").alias("u"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main")).filter("most < u")
    rows_of, columns_of = F.ceil((F.col("u") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("u") / BLOCK).cast("int")
    large = F.col("u") > 2 * BLOCK
    shaped = units.select("unit", "main", F.when(large, rows_of).otherwise(1).alias("rows"), F.when(large, columns_of).otherwise(1).alias("columns"))
    full = written(named.join(written(shaped), "unit"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mark = lambda k, n: F.pmod(F.xxhash64("sig", F.lit(k)), F.col(n)).cast("int")
    columns = full.select("unit", F.explode(each("rows")).alias("r"), mark(1, "columns").alias("c"), "sig", "root")
    rows = full.filter("columns > 1 and root <> main").select("unit", mark(2, "rows").alias("r"), F.explode(each("columns")).alias("c"), "sig", "root")
    return columns.union(rows).distinct()


def _pairs_between(units: DataFrame, roots: DataFrame, classes: DataFrame, every: bool) -> DataFrame:
    """Likely pairs between components inside units.

    Unless ``every`` is set, blocks of units with many of them give the nearest
    ones that connect the components, and a row of nulls to say that others are
    left.
    """
    named = written(units.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")))
    full = _blocks(named).join(classes.select("sig", "n", "sketch").hint("merge"), "sig")

    place = ("unit", "r", "c")

    def of_unit(rows: list[tuple]) -> list[tuple]:
        sig, root, n, sketches = zip(*rows, strict=True)
        found = _likely_between(list(n), list(root), list(sketches))
        left = not every and len(found) > 16 + 4 * len(set(root))
        picked = _forest(found, list(root)) if left else found
        return [(min(sig[i], sig[j]), max(sig[i], sig[j])) for i, j, _ in picked] + [(None, None)] * left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        now, rows, pairs = None, [], []
        for batch in batches:
            for *block, sig, root, n, sketch in zip(*(batch.column(c).to_pylist() for c in (*place, "sig", "root", "n", "sketch")), strict=True):
                if block != now:
                    if len(rows) > 1:
                        pairs += of_unit(rows)
                    now, rows = block, []
                row = (sig, root, n, sketch)
                rows.append(row)
            if pairs:
                yield out(pairs)
                pairs = []
        if len(rows) > 1:
            yield out(of_unit(rows))

    dealt = full.select(*place, "sig", "root", "n", "sketch").repartition(*place).sortWithinPartitions(*place, "n")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _solved(df: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The documents' classes, and (sig, root, component) of each class; the root names a component even where all its ids are null."""
    with scratch(df.sparkSession) as keep:
        members, named = _solve(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bits)
        return keep(members), keep(named)


def _solve(texts: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    clashes: frozenset[int] = frozenset()
    while True:
        members = written(_members(texts, clashes, bits))
        known = members.filter("sig is not null")
        first = lambda c: F.first(c).alias(c)
        agg = known.groupBy("sig").agg(F.min("doc_id").alias("least"), F.min("t").alias("t"), F.first("n_shingles").alias("n"), first("sketch"), F.min("second").alias("x"), F.max("second").alias("y"))
        classes = written(agg)
        found = {r["sig"] for r in classes.filter("x <> y").select("sig").collect()}  # different sets of equal first hash: about one in 10^20 pairs
        if not found:
            break
        clashes |= found
    size = members.agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("n")).first()
    buckets = max(48, -(-int(size["n"] or 0) // (2 * KEYS_PER_BUCKET)))
    groups = written(_groups(texts, buckets, *_common_keys(texts, size["rows"]), clashes, bits))
    flat = written(_hubs(groups))
    pairs = written(_likely(_stars(groups, flat), classes))
    links = written(_verified(texts, pairs, classes, clashes, bits))
    roots = written(components(links))
    units = written(_units(flat))
    for every in (False, True):
        found = written(_pairs_between(units, roots, classes, every))
        again = written(found.filter("a is not null").join(pairs, ["a", "b"], "left_anti"))
        if not again.isEmpty():
            pairs, links = pairs.union(again), links.union(written(_verified(texts, again, classes, clashes, bits)))
            roots = written(components(links))
        if found.filter("a is null").isEmpty():
            break
    rooted = written(classes.select("sig", "least").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")))
    of_root = written(rooted.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("c")))
    named = written(join_counted(rooted, of_root, ["root"], ["sig"]).select("sig", "root", "component"))
    return members, named


def join(df: DataFrame, bits: int = 64) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the least doc_id reachable by links.

    ``bits`` is the size of a set's first hash; sets that share it get others, so
    that it never changes the result.
    """
    members, named = _solved(df, bits)
    found = members.select("doc_id", "n_shingles", "sig").join(named.select("sig", "component"), "sig", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(df: DataFrame) -> DataFrame:
    """One document of each component stays, that with the least doc_id (null last), and all documents without words."""
    members, named = _solved(df)
    rows = members.filter("sig is not null").groupBy("doc_id", "t", "sig").agg(F.count("*").alias("copies"))
    rows = written(rows.join(named.select("sig", "root"), "sig").select("doc_id", "t", "root", "copies"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")).select(F.col("first.doc_id").alias("_d"), F.col("first.t").alias("_t"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))
    dropped = written(rows.join(first, same, "left_anti").select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")))
    few = dropped.count() <= BROADCAST_ROWS
    keyed = df.withColumns({"_i": F.col("doc_id").cast("long"), "_h": F.xxhash64("text")})
    equal = F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t"))
    stays = keyed.join(F.broadcast(dropped) if few else dropped, equal, "left_anti")
    repeated = written(rows.filter("copies > 1").select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")))
    if not repeated.isEmpty():  # rows of equal id and text
        again = stays.join(repeated, equal, "left_semi").dropDuplicates(["_i", "_h"])
        stays = stays.join(repeated, equal, "left_anti").union(again)
    return stays.drop("_i", "_h")
