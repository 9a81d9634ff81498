"""Best-fit packing of token pieces by length patterns.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.
Only the histogram of piece lengths, which has ``capacity`` entries however
large the corpus is, reaches the driver. There, patterns of one to three
documents that fill a sequence are enumerated over bins of lengths; repeat
counts for them are fitted to the histogram by non-negative least squares and
rounded down. Each repeated pattern takes its leading documents from its bins
and its last document by best fit to the room that is left; what remains is
packed by best fit in falling order of length. The outcome is a plan of
intervals: which ranks of a length go to which sequences. Every piece then
finds its place from its rank among the pieces of its length.

Cases with a defined result: a null or empty text is one piece with the end id
alone; repeated rows are packed as often as they occur; an empty table gives
an empty result; documents longer than the capacity are cut, others never; a
text of any length is tokenised whole; a null doc_id is a document like others;
only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._batches import arrow_map
from .storage import written

CAPACITY = 4096
#: The fit works on this many bins of lengths.
BINS = 128
#: Shares of the fitted repeats that are tried.
SHARES = (1.0, 0.9, 0.5, 0.0)
#: Ranks within a length are counted in this many groups of rows.
GROUPS = 256
#: Words whose ids a worker keeps, and bytes of the ids of recent whole texts.
CACHE_WORDS, CACHE_BYTES = 400_000, 16 << 20

# -- tokens -------------------------------------------------------------------

#: The vocabulary's own split of a lower-case text, for characters below U+0100.
_LETTERS = "a-zªµºß-öø-ÿ"
_DIGITS = "0-9²³¹¼-¾"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\t-\r \x85\xa0{_LETTERS}{_DIGITS}]+").findall
_SPACES = re.compile("[ \t\n\r]+").split


def _narrow(text: str) -> bool:
    """Whether all characters are below U+0100."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordTokens:
    """Ids of whole texts, word by word, with the library's ids of each word kept.

    The vocabulary splits at white space and between kinds of characters
    before it merges, so a text's ids are those of its words in turn.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.recent: dict[tuple[bytes, int], bytes] = {}
        self.recent_bytes = 0

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        known, split, seen = self.known, [], set()
        names = []
        for t in texts:
            t = t or ""
            names.append((blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest(), len(t)))
            if names[-1] in self.recent:
                split.append(self.recent[names[-1]])
                continue
            if any(map(t.__contains__, self.special)) or not (t.isascii() or _narrow(t)):
                words = _SPACES(t)
            else:
                words = _WORDS(t.lower())
            seen.update(words)
            split.append(words)
        new = list(seen.difference(known))
        known.update(zip(new, self._library(new), strict=True))
        out = [x if isinstance(x, bytes) else b"".join(map(known.__getitem__, x)) for x in split]
        for name, x in zip(names, out, strict=True):
            if name not in self.recent and len(x) <= CACHE_BYTES:
                if self.recent_bytes + len(x) > CACHE_BYTES:
                    self.recent, self.recent_bytes = {}, 0
                self.recent[name] = x
                self.recent_bytes += len(x)
        if len(known) > CACHE_WORDS:
            for w in new:
                del known[w]
        return out


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(df: DataFrame, tokenizer_path: str, *, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids on request."""
    end = array("I", [end_id]).tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[], [], [], [], []]
        ids: list[bytes] = []
        for doc, raw in zip(batch.column("doc_id").to_pylist(), word_tokens(tokenizer_path).encode(batch.column("text").to_pylist()), strict=True):
            raw += end
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                for column, value in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    column.append(value)
                ids.append(part)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(c, t) for c, t in zip(rows, kinds, strict=True)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(arrow_map(run), schema)


# -- plan ---------------------------------------------------------------------


def patterns(bins: int) -> np.ndarray:
    """Counts per bin (rows) of all patterns of one to three bins that add up to all of them."""
    found = [(bins,)]
    found += [(a, bins - a) for a in range((bins + 1) // 2, bins)]
    found += [(a, b, bins - a - b) for a in range((bins + 2) // 3, bins - 1) for b in range((bins - a + 1) // 2, min(a, bins - a - 1) + 1)]
    table = np.zeros((bins, len(found)))
    for k, p in enumerate(found):
        for b in p:
            table[b - 1, k] += 1
    return table


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram_b = a.T @ b
    limit = tolerance * max(1.0, float(np.abs(gram_b).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        gradient = gram_b - a.T @ (a[:, passive] @ x[passive])
        gradient[passive] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= limit:
            break
        passive[best] = True
        while True:
            index = np.flatnonzero(passive)
            sub = a[:, index]
            try:
                solved = np.linalg.solve(sub.T @ sub, gram_b[index])
            except np.linalg.LinAlgError:
                solved = np.linalg.lstsq(sub, b, rcond=None)[0]
            if solved.min() > 0:
                x[:] = 0
                x[index] = solved
                break
            old = x[index]
            falling = solved <= 0
            step = np.min(old[falling] / np.maximum(old[falling] - solved[falling], 1e-300))
            x[index] = old + step * (solved - old)
            out = index[falling & (x[index] <= 1e-12 * max(1.0, float(old.max(initial=0))))]
            if not len(out):
                out = index[[int(np.argmin(np.where(falling, x[index], np.inf)))]]
            x[out], passive[out] = 0, False
            if not passive.any():
                break
    return x


@dataclass
class Plan:
    """Intervals of ranks: ``count`` pieces of a length from rank ``first`` on go to sequences from ``sequence`` on, ``each`` in one, the first at ``offset``."""

    capacity: int
    counts: np.ndarray
    used: np.ndarray = field(init=False)
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0

    def __post_init__(self) -> None:
        self.used = np.zeros(self.capacity + 1, np.int64)
        self.present = [int(x) for x in np.flatnonzero(self.counts)]

    def left(self, length: int) -> int:
        return int(self.counts[length] - self.used[length])

    def put(self, length: int, sequence: int, n: int, offset: int, each: int = 1) -> None:
        """``each`` pieces of the length go to each of n sequences (the last may get fewer)."""
        count = min(n * each, self.left(length))
        self.rows.append((length, int(self.used[length]), count, sequence, each, offset))
        self.used[length] += count
        if not self.left(length):
            del self.present[bisect_left(self.present, length)]

    def longest(self, room: int) -> int:
        """The greatest length with pieces left that fits, or 0."""
        k = bisect_left(self.present, room + 1)
        return self.present[k - 1] if k else 0


def make_plan(counts: np.ndarray, capacity: int = CAPACITY, bins: int = BINS) -> Plan:
    """The plan for ``counts[i]`` pieces of length i.

    Where few patterns fill a sequence, as with many lengths of over half of
    it, best fit alone may do better than a full share of patterns: the fitted
    repeats are taken whole and scaled down, and the plan with the fewest
    sequences counts.
    """
    width = -(-capacity // bins)
    bins = capacity // width
    histogram = np.bincount(-(-np.arange(capacity + 1) // width), weights=counts, minlength=bins + 1)[1 : bins + 1]
    table = patterns(bins)
    fitted = nnls(table, histogram)
    plans = [_filled(counts, capacity, width, table, np.floor(fitted * share).astype(np.int64)) for share in SHARES]
    return min(plans, key=lambda p: p.sequences)


def _filled(counts: np.ndarray, capacity: int, width: int, table: np.ndarray, repeats: np.ndarray) -> Plan:
    """Patterns with their repeats, then the residual pieces."""
    plan = Plan(capacity, counts)
    rooms: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs of sequences (first, how many)
    sizes: list[int] = []

    def leave(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in rooms:
                rooms[room] = []
                insort(sizes, room)
            rooms[room].append((first, n))

    def fill_last(first: int, n: int, used: int) -> None:
        """The last document of n sequences, by best fit."""
        while n:
            length = plan.longest(capacity - used)
            if not length:
                return leave(capacity - used, first, n)
            k = min(n, plan.left(length))
            plan.put(length, first, k, used)
            leave(capacity - used - length, first, k)
            first, n = first + k, n - k

    def from_bin(b: int, longest_first: bool) -> int:
        """A length of the bin with pieces left, or 0."""
        low, high = bisect_left(plan.present, (b - 1) * width + 1), bisect_left(plan.present, b * width + 1)
        return 0 if low == high else plan.present[high - 1 if longest_first else low]

    for k in np.argsort(-repeats, kind="stable"):
        n = int(repeats[k])
        if not n:
            break
        parts = [b + 1 for b in np.flatnonzero(table[:, k]) for _ in range(int(table[b, k]))][::-1]
        while n:
            if len(parts) == 1:
                length = from_bin(parts[0], True)
                run = min(n, plan.left(length)) if length else 0
                lead = [length]
            else:
                lead = [from_bin(b, i % 2 == 0) for i, b in enumerate(parts[:-1])]
                run = 0 if 0 in lead else min([n, *(plan.left(x) // lead.count(x) for x in lead)])
            if not run:
                break
            first, used = plan.sequences, 0
            plan.sequences += run
            for x in lead:
                plan.put(x, first, run, used)
                used += x
            if len(parts) == 1:
                leave(capacity - used, first, run)
            else:
                fill_last(first, run, used)
            n -= run

    while plan.present:  # residual pieces, longest first
        length = plan.present[-1]
        n = plan.left(length)
        at = bisect_left(sizes, length)
        if at < len(sizes):
            room = sizes[at]
            first, many = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], sizes[at]
            k = min(n, many)
            plan.put(length, first, k, capacity - room)
            leave(room - length, first, k)
            leave(room, first + k, many - k)
        else:
            each = capacity // length
            whole = n // each
            first = plan.sequences
            if whole:
                plan.sequences += whole
                plan.put(length, first, whole, 0, each)
                leave(capacity - each * length, first, whole)
            if rest := n - whole * each:
                first = plan.sequences
                plan.sequences += 1
                plan.put(length, first, 1, 0, rest)
                leave(capacity - rest * length, first, 1)
    return plan


# -- placement ----------------------------------------------------------------


def place(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (doc_id, piece, length)."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in df.groupBy("length").count().collect():  # one row per length at most
        counts[r["length"]] = r["count"]
    plan = make_plan(counts, capacity)
    by = sorted(plan.rows)
    table = np.array(by, np.int64).reshape(-1, 6)
    # intervals of all lengths on one axis
    reach = int(table[:, 1].max() + table[:, 2].max() + 1) if len(table) else 1
    keys = table[:, 0] * reach + table[:, 1]

    grouped = df.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(GROUPS)).cast("int"))
    totals = grouped.groupBy("length", "_group").count()
    ahead = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("length", "_group", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "piece")) - 1
    ranked = grouped.withColumn("_local", local).join(starts, ["length", "_group"]).withColumn("rank", F.col("_start") + F.col("_local")).select(*df.columns, "rank")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.searchsorted(keys, pdf["length"].to_numpy() * reach + pdf["rank"].to_numpy(), side="right") - 1
            row = table[at]
            nth = pdf["rank"].to_numpy() - row[:, 1]
            pdf["sequence_id"] = row[:, 3] + nth // row[:, 4]
            pdf["offset"] = row[:, 5] + nth % row[:, 4] * row[:, 0]
            yield pdf.drop(columns="rank")

    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return ranked.mapInPandas(put, f"{kinds}, sequence_id long, offset long")


def pack(df: DataFrame, tokenizer_path: str, *, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document, with its sequence and its offset there."""
    return place(written(pieces(df, tokenizer_path, end_id=end_id, capacity=capacity)), capacity)
