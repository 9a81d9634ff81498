"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A batch of words becomes one flat array of symbols, cut between characters
that stand side by side in no piece, since no merge can reach over such a
place. In each round, every such part finds its best rank of adjacent pairs (a
segmented minimum) and merges all pairs of this rank at once, from the left
and without overlaps; the arrays are compacted, and only the pairs beside a
merge are looked up again. Parts without a pair leave the arrays, and the
rounds end when no pair remains.

This equals the library's queue, which merges one pair of best rank at a time,
the leftmost first, as long as a merge makes no pair of the same or a better
rank beside it. Where one would, its part merges only the leftmost pair in
this round.

Cases with a defined result: a null text is treated as an empty one; an empty
text has the end id only; characters without a piece become byte ids; a text
or a word of any length is merged in the same rounds; rows are independent, so
repeated rows and doc ids give repeated results; other columns are kept, and
an existing column named like an output is replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

import codecs
import re
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._batches import arrow_map, list_array

SPACE = "▁"
_NONE = np.iinfo(np.int64).max
#: Words whose ids a worker keeps.
CACHE_WORDS = 300_000

codecs.register_error("one_byte", lambda e: ("�", e.start + 1))


class Codec:
    """Encoder and decoder for one SentencePiece BPE model file."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and without normalisation are supported")
        kinds = pb.ModelProto.SentencePiece
        self.dummy_prefix = spec.add_dummy_prefix
        self.eos_id, self.unk_id = trainer.eos_id, trainer.unk_id
        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.byte_id = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        if any(inner.search(p) or "\n" in p for p in pieces):
            raise ValueError("a piece reaches over a word boundary")
        # equal scores get equal ranks, so that position decides between them
        order = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in pieces.values()}, reverse=True))}
        self.rank = np.zeros(len(model.pieces), np.int64)
        for p, i in pieces.items():
            self.rank[i] = order[model.pieces[i].score]
        self.size = len(model.pieces)
        keys, made = [], []
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = pieces.get(p[:k]), pieces.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    made.append(i)
        by = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_key = np.append(np.array(keys, np.int64)[by], _NONE)
        self.pair_made = np.append(np.array(made, np.int64)[by], 0)
        self.char_table = np.full(0x110000, -1, np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.char_table[ord(p)] = i
        self.beside = np.array(sorted({ord(a) << 21 | ord(b) for p in pieces for a, b in pairwise(p)}), np.int64)  # characters side by side in a piece
        shown = []
        for p in model.pieces:
            if p.type == kinds.BYTE:
                shown.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.CONTROL:
                shown.append(b"")
            elif p.type == kinds.UNKNOWN:
                shown.append((trainer.unk_surface or " ⁇ ").encode())
            else:
                shown.append(p.piece.replace(SPACE, " ").encode())
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_len = np.array([len(x) for x in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_len) - self.shown_len
        self.starts_with_space = np.array([p.type == kinds.NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        self.ids_of: dict[str, bytes] = {}
        self.words = re.compile(" *[^ \n]+|\n| +").findall

    # -- encoding ---------------------------------------------------------

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, self.pair_made[at], -1)

    def _all_of_best_rank(self, sym: np.ndarray, word: np.ndarray, made: np.ndarray, best: np.ndarray, start: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The places to merge in a round: all pairs of each part's best rank, or only the leftmost where a merge would make a pair as good."""
        n = len(sym)
        sizes = np.diff(np.append(start, n))
        at = np.flatnonzero(rank == np.repeat(best // n, sizes))
        # from the left without overlaps: every second one of a run
        fresh = np.append(True, (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]]))
        run = np.flatnonzero(fresh)
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        again = np.append(False, word[at[1:]] == word[at[:-1]])
        if not again.any():
            return at
        many = again | np.append(again[1:], False)
        t = at[many]
        merged = np.full(n, -1, np.int64)
        merged[at] = made[at]
        left = np.where((t > 1) & (merged[t - 2] >= 0), merged[t - 2], sym[t - 1])  # what stands there when it is this pair's turn
        with_left = np.where((t > 0) & (word[t - 1] == word[t]), self._pairs(left, made[t]), -1)
        end = np.minimum(t + 2, n - 1)
        with_right = np.where((t + 2 < n) & (word[end] == word[t]), self._pairs(made[t], sym[end]), -1)
        own = self.rank[made[t]]
        close = ((with_left >= 0) & (self.rank[with_left] <= own)) | ((with_right >= 0) & (self.rank[with_right] <= own))
        if not close.any():
            return at
        risky = np.isin(word[at], word[t[close]])
        return at[~risky | ~again]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian int32 ids of each word, merged without regard to the others."""
        if not words:
            return []
        text = "".join(words).replace(" ", SPACE)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lens = np.array([len(w) for w in words], np.int64)
        whole = np.repeat(np.arange(len(words)), lens)
        sym = self.char_table[points].astype(np.int64)
        sym = np.where(sym < 0, -1 - points, sym)  # a character without a piece, never merged
        beside = points[:-1] << 21 | points[1:]
        joined = self.beside[np.minimum(np.searchsorted(self.beside, beside), len(self.beside) - 1)] == beside
        word = np.append(0, np.cumsum((whole[1:] != whole[:-1]) | ~joined))  # the parts
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        of_part = whole[first]
        done_word, done_sym = [], []

        made = np.full(len(sym), -1, np.int64)
        made[:-1] = np.where(word[:-1] == word[1:], self._pairs(sym[:-1], sym[1:]), -1)
        while len(sym):
            n = len(sym)
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            rank = np.where(made >= 0, self.rank[made], -1)
            best = np.minimum.reduceat(np.where(made >= 0, rank * n + np.arange(n), _NONE), start)
            live = best != _NONE
            if not live.all():  # compaction: finished parts leave
                stays = np.repeat(live, np.diff(np.append(start, n)))
                done_word.append(word[~stays])
                done_sym.append(sym[~stays])
                sym, word, made = sym[stays], word[stays], made[stays]
                continue
            at = self._all_of_best_rank(sym, word, made, best, start, rank)
            sym[at] = made[at]
            keep = np.ones(n, bool)
            keep[at + 1] = False
            sym, word, made = sym[keep], word[keep], made[keep]
            at = at - np.arange(len(at))  # one symbol went at each merge before
            n = len(sym)
            again = np.unique(np.concatenate([at, at[at > 0] - 1]))
            inside = again + 1 < n
            made[again[~inside]] = -1
            again = again[inside]
            made[again] = np.where(word[again] == word[again + 1], self._pairs(sym[again], sym[again + 1]), -1)

        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        by = np.argsort(word, kind="stable")
        word, sym = of_part[word[by]], sym[by]
        if (sym < 0).any():
            word, sym = self._bytes_for_unknown(word, sym)
        ids = sym.astype("<i4").tobytes()
        ends = (np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()
        return [ids[a:b] for a, b in pairwise([0, *ends])]

    def _bytes_for_unknown(self, word: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        point = np.where(sym < 0, -1 - sym, 0)
        width = np.where(sym >= 0, 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))
        at = np.cumsum(width) - width
        flat = np.repeat(sym, width)
        for i in np.flatnonzero(sym < 0).tolist():
            raw = chr(int(point[i])).encode("utf-8", "surrogatepass")
            flat[at[i] : at[i] + len(raw)] = self.byte_id[list(raw)]
        return np.repeat(word, width), flat

    def encode(self, texts: list[str | None], end: bool = True) -> list[bytes]:
        """Little-endian int32 ids of whole texts; ``end`` adds the end id."""
        split = [self.words((" " if self.dummy_prefix else "") + t.replace(SPACE, " ")) if t else [] for t in texts]
        known, missing = self.ids_of, set()
        for words in split:
            missing.update(w for w in set(words) if w not in known)
        new = list(missing)
        known.update(zip(new, self.encode_words(new), strict=True))
        tail = np.array([self.eos_id] if end else [], "<i4").tobytes()
        out = [b"".join(map(known.__getitem__, words)) + tail for words in split]
        if len(known) > CACHE_WORDS:
            for w in new:
                del known[w]
        return out

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all rows' texts and their lengths; row i has ``counts[i]`` of the ids."""
        row_at = np.cumsum(counts) - counts
        lens = self.shown_len[ids]
        begin = self.shown_at[ids]
        if self.dummy_prefix and len(ids):  # the first space of a text is the prefix
            visible = np.flatnonzero(lens > 0)
            row = np.repeat(np.arange(len(counts)), counts)[visible]
            first = visible[np.append(True, row[1:] != row[:-1])] if len(visible) else visible
            first = first[self.starts_with_space[ids[first]]]
            lens, begin = lens.copy(), begin.copy()
            lens[first] -= 1
            begin[first] += 1
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.shown[np.repeat(begin - (ends - lens), lens) + np.arange(total)]
        edge = np.append(0, ends)
        sizes = edge[row_at + counts] - edge[row_at]
        return raw, sizes

    def decode_texts(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts; bytes that are no UTF-8 become U+FFFD one by one."""
        raw, sizes = self.decode(ids, counts)
        body, ends = raw.tobytes(), np.cumsum(sizes).tolist()
        return [body[e - s : e].decode("utf-8", "one_byte") for s, e in zip(sizes.tolist(), ends, strict=True)]


@lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def _with(df: DataFrame, batches, *fields: T.StructField) -> DataFrame:
    names = {f.name for f in fields}
    schema = T.StructType([f for f in df.schema.fields if f.name not in names] + list(fields))
    return df.mapInArrow(batches, schema)


def encode(df: DataFrame, model_path: str, *, text: str = "text", ids: str = "ids", end: bool = True) -> DataFrame:
    """Adds ``ids`` (array of int) with the ids of each whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = codec(model_path).encode(batch.column(text).to_pylist(), end)
        flat = pa.Array.from_buffers(pa.int32(), sum(map(len, parts)) // 4, [None, pa.py_buffer(b"".join(parts))])
        column = list_array(flat, np.array([len(p) // 4 for p in parts], np.int64))
        kept = [n for n in batch.schema.names if n != ids]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), column], [*kept, ids])

    return _with(df, arrow_map(run, text), T.StructField(ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, model_path: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded`` (string), the text of each row's ids (null ids: an empty text)."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                column = part.column(ids)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = pa.array(codec(model_path).decode_texts(flat, counts), pa.string())
                kept = [n for n in part.schema.names if n != decoded]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), texts], [*kept, decoded])

    return _with(df, run, T.StructField(decoded, T.StringType()))


def digests(df: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of its ids and of its decoded text."""
    coded = decode(encode(df.select("doc_id", "text"), model_path).select("doc_id", "ids"), model_path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
