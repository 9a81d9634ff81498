"""Removal of word sequences that occur more than once in a corpus.

The documents are parsed relative to a reference made of all their own
phrases, as in relative Lempel-Ziv compression. A document is factored against
every block of the reference that can hold a match: each window of ``WINDOW``
words picks the ``GRAM``-word sequence of least hash inside it as its anchor,
the windows that pick the same anchor form one phrase, and anchors decide on
the block. Equal windows pick equal anchors, so that a phrase meets all its
matches of at least a window in the one block it is sent to.

Equal phrases are counted first: one that occurs twice as a whole makes all
its windows duplicates, and is a single entry of its block. A block is indexed
by a suffix array over the words of its phrases, with the longest match that
begins at each word and occurs elsewhere in the block. Every phrase is then
parsed greedily from left to right into such longest factors. A factor of at
least ``WINDOW`` words is a duplicate span; windows that reach over a factor's
end are in none and are checked at this boundary by the longest match from
their first word. A word is removed if a duplicate window covers it.

A block holds whole anchors. An anchor with more than ``HOT`` different
phrases (a common passage in ever new surroundings) would not fit in one task:
its windows are counted one by one in a shuffle with partial aggregation, which
finds the same duplicates.

Cases with a defined result: a null text has no words and stays null; texts
shorter than a window keep all words; a text of any length is parsed whole;
repeated rows and equal texts remove each other (no occurrence is spared, the
first neither), also those with null ids; a window may repeat inside one
document, also overlapping itself; an empty table gives an empty result; other
columns are kept, except those named like an output.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import arrow_map, text_bytes
from ._joins import join_counted
from ._words import grams, mix, words
from .storage import scratch, written

WINDOW = 35
GRAM = 11
#: Different phrases of an anchor up to which they are parsed in one block, and words that a block has, about.
HOT, BLOCK_WORDS = 4_096, 1_000_000
#: More words than a phrase has: all windows around an anchor.
LONGEST = 64
SPACES = r"[\x20\x09-\x0D]+"
_ROLL = 0xF1357AEA2E62A9C5
_ROLL_INVERSE = pow(_ROLL, -1, 1 << 64)
_rolls: dict[int, np.ndarray] = {}


def _roll(base: int, n: int) -> np.ndarray:
    if len(_rolls.get(base, ())) < n:
        with np.errstate(over="ignore"):
            grown = np.full(max(n, 1 << 20), base, np.uint64)
            grown[0] = 1
            _rolls[base] = np.multiply.accumulate(grown)
    return _rolls[base][:n]


class Parsed:
    """Words and factors of a batch of texts."""

    def __init__(self, batch: pa.RecordBatch):
        body, self.offsets = text_bytes(batch)
        self.body = body
        self.hashes, self.rows, self.starts, self.ends = words(body, self.offsets)
        n = len(self.hashes)
        self.edge = np.searchsorted(self.rows, np.arange(batch.num_rows + 1))
        with np.errstate(over="ignore"):
            self.prefix = np.append(np.zeros(1, np.uint64), np.cumsum(self.hashes * _roll(_ROLL, n)))

    def sequence(self, first: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Hash of the n words from each position on."""
        with np.errstate(over="ignore"):
            total = (self.prefix[first + n] - self.prefix[first]) * _roll(_ROLL_INVERSE, len(self.hashes) + 1)[first]
            return mix(total + np.asarray(n).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor hash, first window (position in the batch) and number of windows of each factor."""
        n = len(self.hashes)
        none = np.zeros(0, np.int64)
        if n < WINDOW:
            return none.astype(np.uint64), none, none
        gram = grams(self.hashes, GRAM)
        low = np.arange(len(gram))  # the place of the least hash, the first one of equals

        def lower(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.where(gram[y] < gram[x], y, x)

        span = WINDOW - GRAM + 1
        width = 1
        while 2 * width <= span:
            low = lower(low[:-width], low[width:])
            width *= 2
        if span > width:
            low = lower(low[: len(low) - (span - width)], low[span - width :])
        at = np.flatnonzero(self.rows[: n - WINDOW + 1] == self.rows[WINDOW - 1 :])
        anchor = low[at]
        new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(at) else none
        first = at[new]
        count = np.diff(np.append(new, len(at)))
        return gram[anchor[new]], first, count


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64())


def _anchors(df: DataFrame) -> DataFrame:
    """Anchors that occur more than once: the index of each reference block."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, n = np.unique(Parsed(batch).factors()[0], return_counts=True)
        return pa.RecordBatch.from_arrays([_long(h), _long(n)], ["h", "n"])

    return df.select("text").mapInArrow(arrow_map(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("c")).filter("c > 1")


def _factors(df: DataFrame) -> DataFrame:
    """(h, f, doc_id, t, first, n): all factors, f being the hash of a factor's words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parsed = Parsed(batch)
        h, first, n = parsed.factors()
        row = pa.array(parsed.rows[first])
        columns = [_long(h), _long(parsed.sequence(first, n + WINDOW - 1)), batch.column("doc_id").take(row), batch.column("t").take(row)]
        columns += [pa.array(first - parsed.edge[parsed.rows[first]], pa.int32()), pa.array(n, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["h", "f", "doc_id", "t", "first", "n"])

    return df.mapInArrow(arrow_map(run), "h long, f long, doc_id long, t long, first int, n int")


def _with_spans(df: DataFrame, spans: DataFrame, kind: str) -> DataFrame:
    """Texts with the array of their spans; a merge join at every size, as what is shuffled then follows the input."""
    side = spans.withColumnsRenamed({"doc_id": "_d", "t": "_t"}).hint("merge")
    return df.join(side, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")), kind).drop("_d", "_t")


def _phrases(df: DataFrame, factors: DataFrame) -> DataFrame:
    """The given factors (h, k, doc_id, t, first, n) with the hashes of their words."""
    spans = factors.groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "k", "first", "n")).alias("spans"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parsed = Parsed(batch)
        spans = batch.column("spans")
        h, k, first, n = (spans.flatten().field(j) for j in range(4))
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(spans).to_numpy(zero_copy_only=False))
        begin = parsed.edge[row] + first.to_numpy(zero_copy_only=False)
        end = begin + n.to_numpy(zero_copy_only=False) + WINDOW - 1
        raw = pa.array([parsed.hashes[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
        index = pa.array(row)
        columns = [h, k, batch.column("doc_id").take(index), batch.column("t").take(index), first, raw]
        return pa.RecordBatch.from_arrays(columns, ["h", "k", "doc_id", "t", "first", "words"])

    return _with_spans(df, spans, "inner").mapInArrow(arrow_map(run), "h long, k long, doc_id long, t long, first int, words binary")


class Block:
    """A block of the reference: phrases, each with its anchor, and the index of their words."""

    def __init__(self, anchors: np.ndarray, phrases: list[bytes]):
        sizes = np.array([len(p) // 8 for p in phrases], np.int64)
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        self.stop = np.repeat(self.end, sizes)
        words_ = np.frombuffer(b"".join(phrases), np.uint64)
        self.longest = self._longest(mix(words_ ^ mix(np.repeat(anchors.view(np.uint64), sizes), 3)))

    def _longest(self, words_: np.ndarray) -> np.ndarray:
        """Length of the longest sequence from each word that occurs elsewhere in the block, under the same anchor."""
        n = len(words_)
        ranks = [np.unique(words_, return_inverse=True)[1] + 1]  # of sequences of 1, 2, 4, ... words, cut at the phrase's end
        width = 1
        while width < LONGEST:
            after = np.zeros(n, np.int64)
            ahead = np.flatnonzero(np.arange(n) + width < self.stop)
            after[ahead] = ranks[-1][ahead + width]
            ranks.append(np.unique(ranks[-1] * (n + 1) + after, return_inverse=True)[1] + 1)
            width *= 2
        suffixes = np.argsort(ranks.pop(), kind="stable")
        a, b = suffixes[:-1], suffixes[1:]
        room = np.minimum(self.stop[a] - a, self.stop[b] - b)
        same = np.zeros(len(a), np.int64)
        for rank in reversed(ranks):
            width //= 2
            open_ = np.flatnonzero(same < room)
            equal = open_[rank[a[open_] + same[open_]] == rank[b[open_] + same[open_]]]
            same[equal] += width
        same = np.minimum(same, room)
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, a, same)
        np.maximum.at(longest, b, same)
        return longest

    def duplicates(self) -> np.ndarray:
        """Whether the window from each word on is a duplicate, by the greedy parse of all phrases."""
        n = len(self.longest)
        inside, border = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        at, end = self.begin.copy(), self.end
        while len(at):
            factor = np.minimum(at + np.maximum(self.longest[at], 1), end)
            long = factor - at >= WINDOW
            np.add.at(inside, at[long], 1)
            np.add.at(inside, factor[long] - WINDOW + 1, -1)
            low = np.maximum(at, factor - WINDOW + 1)
            high = np.maximum(low, np.minimum(factor, end - WINDOW + 1))
            np.add.at(border, low, 1)
            np.add.at(border, high, -1)
            more = factor <= end - WINDOW
            at, end = factor[more], end[more]
        return (np.cumsum(inside[:-1]) > 0) | ((np.cumsum(border[:-1]) > 0) & (self.longest >= WINDOW))


def _parsed(phrases: DataFrame) -> DataFrame:
    """(doc_id, t, first, n): runs of duplicate windows of the phrases, each block being parsed in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            h, doc_id, t, first, raw = zip(*rows, strict=True)
            block = Block(np.array(h, np.int64), list(raw))
            twice = block.duplicates()
            before = np.append(False, twice[:-1])
            before[block.begin] = False
            starts = np.flatnonzero(twice & ~before)
            after = np.append(twice[1:], False)
            after[block.end - 1] = False
            ends = np.flatnonzero(twice & ~after) + 1
            of = np.searchsorted(block.end, starts, side="right")
            columns = [pa.array([x[i] for i in of.tolist()], pa.int64()) for x in (doc_id, t)]
            columns += [pa.array(np.array(first)[of] + starts - block.begin[of], pa.int32()), pa.array(ends - starts, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "first", "n"])

        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "t", "first", "words")), strict=True):
                if size > BLOCK_WORDS and row[0] != rows[-1][0]:  # an anchor is never cut
                    yield out(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4]) // 8
        if rows:
            yield out(rows)

    dealt = phrases.select("h", "doc_id", "t", "first", "words").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "doc_id long, t long, first int, n int")


def _counted_windows(phrases: DataFrame) -> DataFrame:
    """The same by counting every window of the phrases."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column("words").to_pylist()
        each = np.array([len(p) // 8 - WINDOW + 1 for p in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint64)
        row = np.repeat(np.arange(len(raw)), each)
        local = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        w = grams(flat, WINDOW)[local + np.repeat(np.cumsum(each + WINDOW - 1) - each - WINDOW + 1, each)] if len(row) else np.zeros(0, np.uint64)
        at = pa.array(row)
        columns = [batch.column("h").take(at), _long(w), batch.column("doc_id").take(at), batch.column("t").take(at), pa.array(batch.column("first").to_numpy(zero_copy_only=False)[row] + local, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["h", "w", "doc_id", "t", "first"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                yield run(batch.slice(k, 4096))

    windows = written(phrases.select("h", "doc_id", "t", "first", "words").mapInArrow(slices, "h long, w long, doc_id long, t long, first int"))
    twice = windows.groupBy("h", "w").agg(F.count("*").alias("c")).filter("c > 1").select("h", "w")
    # a window that very many phrases hold makes a large partition of rows, which the adaptive join splits
    return windows.join(twice.hint("merge"), ["w", "h"], "left_semi").select("doc_id", "t", "first", F.lit(1).alias("n"))


def duplicate_spans(df: DataFrame) -> DataFrame:
    """(doc_id, t, spans): runs of duplicate windows of each document with any; t is a hash of its text.

    ``df`` has doc_id, text and t. Spans are (first word, number of windows),
    not merged.
    """
    index = written(_anchors(df))
    found = written(join_counted(_factors(df), index, ["h"], ["doc_id", "t", "first"]).drop("c"))
    classes = written(found.groupBy("h", "f").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "t", "first", "n")).alias("one")))
    mixed = written(classes.groupBy("h").agg(F.count("*").alias("k"), F.min("c").alias("least")).filter("k > 1 and least = 1").select("h", F.col("k").alias("c")))
    border = join_counted(classes.select("h", "f", "one"), mixed, ["h"], ["f"]).select("h", F.col("c").alias("k"), "one.*")
    phrases = written(_phrases(df, border))
    spans = _parsed(phrases.filter(F.col("k") <= HOT)).union(_counted_windows(phrases.filter(F.col("k") > HOT)))
    whole = written(classes.filter("c > 1").select("h", "f", "c"))
    repeated = join_counted(found, whole, ["h", "f"], ["doc_id", "t", "first"]).select("doc_id", "t", "first", "n")
    return repeated.union(spans).groupBy("doc_id", "t").agg(F.collect_list(F.struct("first", "n")).alias("spans"))


def remove_duplicates(df: DataFrame) -> DataFrame:
    """The documents with ``text`` cut to what stays, and n_words and n_removed (of the text before).

    A removed word goes with the space behind it. A null text stays null.
    """
    rest = [c for c in df.columns if c not in ("text", "n_words", "n_removed")]
    keyed = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"), F.struct(*map(F.col, rest)).alias("_row"))
    with scratch(df.sparkSession) as keep:
        found = keep(written(duplicate_spans(keyed.select("doc_id", "text", "t"))))
    spanned = _with_spans(keyed, found, "left").select("text", "spans", "_row")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parsed = Parsed(batch)
        spans = batch.column("spans")
        counts = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
        flat = spans.flatten()
        first, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
        first = first + parsed.edge[np.repeat(np.arange(batch.num_rows), counts)]
        total = len(parsed.hashes)
        step = np.zeros(total + 1, np.int64)
        np.add.at(step, first, 1)
        np.add.at(step, first + n + WINDOW - 1, -1)
        gone = np.cumsum(step[:-1]) > 0
        run_gone = np.append(0, np.cumsum(gone))
        n_words, n_removed = np.diff(parsed.edge), np.diff(run_gone[parsed.edge])
        texts = batch.column("text").to_pylist()
        for i in np.flatnonzero(n_removed).tolist():
            a, b = int(parsed.edge[i]), int(parsed.edge[i + 1])
            begin, end = int(parsed.offsets[i]), int(parsed.offsets[i + 1])
            away, starts = gone[a:b], parsed.starts[a:b] - begin
            change = np.flatnonzero(np.append(True, away[1:] != away[:-1]))
            cuts = [0, *starts[change][1:].tolist(), end - begin]
            raw = parsed.body[begin:end].tobytes()
            lead = int(starts[0]) if away[0] else 0  # the space before the first word stays
            parts = [raw[:lead]] + [raw[x:y] for (x, y), c in zip(pairwise(cuts), change.tolist(), strict=True) if not away[c]]
            texts[i] = b"".join(parts).decode()
        arrays = [batch.column("_row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["_row", "n_words", "n_removed", "text"])

    row = keyed.schema["_row"].dataType.simpleString()
    done = spanned.mapInArrow(arrow_map(run), f"_row {row}, n_words long, n_removed long, text string")
    return done.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in df.columns if c not in ("n_words", "n_removed")], "n_words", "n_removed")


def contract(df: DataFrame) -> DataFrame:
    kept = F.array_join(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACES), ""), " ")
    return remove_duplicates(df.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))
