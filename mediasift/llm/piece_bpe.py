"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is escaped as the library does it (a leading `▁`, spaces as `▁`) and cut before each run of `▁`,
across which no piece of the vocabulary reaches. Every new word becomes a stretch of one flat numpy
array of symbols. A round looks up the rank of each adjacent pair, takes the least rank of each word
(segmented minimum), merges its leftmost place in all words at once and compacts the array; rounds go
on until no pair is left. Words of over `LONG_WORD` symbols take the same steps with a heap, in
`n log n`. Words seen before in a task are looked up, so a text costs little more than its cut.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from mediasift.llm.common import parts_of, whole_text

MARK = "▁"
LONG_WORD = 200
#: Words that a task remembers; then it starts anew.
MOST_WORDS = 150_000
#: Characters of new words that are merged in one go.
ROUND_CHARS = 500_000


_ENCODED = [StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]


def _one_each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


class PieceModel:
    """Pieces of a BPE model file, the table of pairs that merge, and byte pieces for the rest.

    Symbols are pieces and, beyond them, characters that occur in pieces without being one.
    """

    def __init__(self, path: str):
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = file.vocab_size()
        everything = range(self.size)
        pieces = [file.id_to_piece(i) for i in everything]
        special = [file.is_control(i) or file.is_unknown(i) or file.is_unused(i) for i in everything]
        byte = [file.is_byte(i) for i in everything]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i] and not byte[i]}
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for i in everything:
            if byte[i]:
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        self.symbols = dict(self.ids)
        for piece in self.ids:
            for c in piece:
                self.symbols.setdefault(c, self.size + len(self.symbols))
        self.loose = {v: k for k, v in self.symbols.items() if v >= self.size}
        self.of_char = -1 - np.arange(0x110000, dtype=np.int64)
        for c, v in self.symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = v
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("pieces that go on past a word boundary are not supported")
        self._pairs([file.get_score(i) for i in everything])
        out = [b"" if special[i] else bytes([int(pieces[i][3:5], 16)]) if byte[i] else pieces[i].replace(MARK, " ").encode() for i in everything]
        out[file.unk_id()] = " ⁇ ".encode()
        self.opens = np.array([p.startswith(MARK) for p in pieces])
        self.piece_bytes = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.piece_len = np.array([len(b) for b in out], dtype=np.int64)
        self.piece_start = np.cumsum(self.piece_len) - self.piece_len

    def _pairs(self, scores: list[float]) -> None:
        """Keys (left, right) in order, with rank (equal scores share it) and the merged symbol."""
        rank_of = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.width = max(self.symbols.values()) + 1
        found = []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    found.append((left * self.width + right, rank_of[scores[i]], i))
        found.sort()
        self.pair_keys, self.pair_ranks, self.pair_merged = (np.array(c, dtype=np.int64) for c in zip(*found, strict=True))
        self.no_rank = len(rank_of)
        self.known: dict[tuple[int, int], tuple[int, int]] = {}  # ranks that long words have asked for

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.where((left >= 0) & (right >= 0), left * self.width + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == keys
        return np.where(hit, self.pair_ranks[at], self.no_rank), self.pair_merged[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each word has.

        A word is a run of `▁` and what follows up to the next `▁`.
        """
        if not words:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        long = np.flatnonzero(sizes > LONG_WORD)
        symbols, owners = [], []
        for part in parts_of(np.where(sizes > LONG_WORD, 0, sizes).tolist(), ROUND_CHARS):
            short = [w if len(w) <= LONG_WORD else "" for w in words[part]] if len(long) else words[part]
            flat, owner = self._rounds(self._symbols_of("".join(short)), np.array([len(w) for w in short], dtype=np.int64))
            symbols.append(flat)
            owners.append(owner + part.start)
        for i in long:
            symbols.append(self._heap(words[i]))
            owners.append(np.full(len(symbols[-1]), i, dtype=np.int64))
        flat, owner = np.concatenate(symbols), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return self._finish(flat[order], owner[order], len(words))

    def _symbols_of(self, text: str) -> np.ndarray:
        """Symbols of the characters; one without a symbol is minus its code point, less one."""
        return self.of_char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]

    def _rounds(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left when no pair merges any more, with the word that each symbol belongs to."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(len(flat), self.no_rank, dtype=np.int64)  # of the pair that begins here
        merged = np.zeros(len(flat), dtype=np.int64)
        asked = np.flatnonzero(owner[:-1] == owner[1:])
        done_symbols, done_owner = [flat[:0]], [owner[:0]]
        while len(flat):
            rank[asked], merged[asked] = self._ranks(flat[asked], flat[asked + 1])
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, first)
            counts = np.diff(np.r_[first, len(flat)])
            active = np.repeat(least < self.no_rank, counts)
            done_symbols.append(flat[~active])
            done_owner.append(owner[~active])
            places = np.flatnonzero(active & (rank == np.repeat(least, counts)))
            if not len(places):
                break
            places = places[np.r_[True, owner[places[1:]] != owner[places[:-1]]]]  # leftmost of each word
            flat[places] = merged[places]
            active[places + 1] = False
            places = (np.cumsum(active) - 1)[places]
            flat, owner, rank, merged = flat[active], owner[active], rank[active], merged[active]
            rank[places] = self.no_rank
            changed = np.zeros(len(flat), dtype=bool)
            changed[places] = True
            changed[places[places > 0] - 1] = True
            asked = np.flatnonzero(changed[:-1] & (owner[:-1] == owner[1:]))
        return np.concatenate(done_symbols), np.concatenate(done_owner)

    def _heap(self, word: str) -> np.ndarray:
        """The same merges for one long word: least rank first, then leftmost."""
        symbols = self._symbols_of(word)
        n = len(symbols)
        ranks, merged = self._ranks(symbols[:-1], symbols[1:])
        heap = [(int(ranks[i]), int(i), int(symbols[i]), int(symbols[i + 1]), int(merged[i])) for i in np.flatnonzero(ranks < self.no_rank)]
        heapq.heapify(heap)
        now, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        known = self.known
        while heap:
            _, i, left, right, to = heapq.heappop(heap)
            j = after[i]
            if now[i] != left or j >= n or now[j] != right:
                continue
            now[i], now[j], after[i] = to, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    pair = now[a], now[b]
                    if pair not in known:
                        rank, whole = self._ranks(np.array([pair[0]]), np.array([pair[1]]))
                        known[pair] = int(rank[0]), int(whole[0])
                    if known[pair][0] < self.no_rank:
                        heapq.heappush(heap, (known[pair][0], a, *pair, known[pair][1]))
        return np.array([s for s in now if s is not None], dtype=np.int64)

    def _finish(self, symbols: np.ndarray, owner: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids, those without a piece as the pieces of their bytes; how many each word has."""
        out = np.flatnonzero((symbols < 0) | (symbols >= self.size))
        if len(out):
            data = [(self.loose[x] if x >= 0 else chr(-1 - x)).encode() for x in symbols[out].tolist()]
            room = np.ones(len(symbols), dtype=np.int64)
            room[out] = [len(x) for x in data]
            ends = np.cumsum(room)
            symbols, owner = np.repeat(symbols, room), np.repeat(owner, room)
            at = np.repeat(ends[out] - np.cumsum(room[out]), room[out]) + np.arange(room[out].sum())
            symbols[at] = self.byte_ids[np.frombuffer(b"".join(data), dtype=np.uint8)]
        return symbols.astype(np.int32), np.bincount(owner, minlength=words)

    def decode_flat(self, flat: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of the id lists that lie end to end in `flat`. Bytes that are no UTF-8 give U+FFFD each."""
        codecs.register_error("one_each", _one_each)
        said = self.piece_len[flat] > 0
        if not said.all():  # control ids have no text
            lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[said], minlength=len(lengths))
            flat = flat[said]
        size = self.piece_len[flat]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.piece_start[flat] - (ends - size), size) + np.arange(total)
        data = self.piece_bytes[source].tobytes()
        bounds = np.r_[0, np.cumsum(lengths)]
        cuts = np.r_[0, ends][bounds]
        begin = cuts[:-1].copy()
        some = np.flatnonzero(lengths)
        begin[some] += self.opens[flat[bounds[:-1][some]]]  # the space before the first word is the encoder's
        return [data[a:b].decode("utf-8", "one_each") for a, b in zip(begin.tolist(), cuts[1:].tolist(), strict=True)]


class WordCache:
    """Ids of the words a task has met, end to end in one array."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = defaultdict(count().__next__)
        self.pool = np.zeros(0, dtype=np.int32)
        self.sizes = np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        if len(self.codes) > MOST_WORDS:
            self._clear()
        cut = re.compile(f"{MARK}+[^{MARK}]*").findall
        words = [cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = len(self.codes)
        at = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(words)), dtype=np.int64)
        ids, sizes = self.model.encode_words(list(islice(self.codes, known, None)))
        self.pool, self.sizes = np.concatenate([self.pool, ids]), np.concatenate([self.sizes, sizes])
        start = np.cumsum(self.sizes) - self.sizes
        size = self.sizes[at]
        ends = np.cumsum(size)
        flat = self.pool[np.repeat(start[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        per_text = np.array([len(ws) for ws in words], dtype=np.int64)
        return flat, np.diff(np.r_[0, ends][np.r_[0, np.cumsum(per_text)]])


#: Characters that are encoded or ids decoded in one go, so that long texts do not add up.
PART_CHARS = 1_000_000


def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        if len(self.codes) > MOST_WORDS:
            self._clear()
        cut = re.compile(f"{MARK}+[^{MARK}]*").findall
        words = [cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = len(self.codes)
        at = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(words)), dtype=np.int64)
        ids, sizes = self.model.encode_words(list(islice(self.codes, known, None)))
        self.pool, self.sizes = np.concatenate([self.pool, ids]), np.concatenate([self.sizes, sizes])
        start = np.cumsum(self.sizes) - self.sizes
        size = self.sizes[at]
        ends = np.cumsum(size)
        flat = self.pool[np.repeat(start[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        per_text = np.array([len(ws) for ws in words], dtype=np.int64)
        return flat, np.diff(np.r_[0, ends][np.r_[0, np.cumsum(per_text)]])


#: Characters that are encoded or ids decoded in one go, so that long texts do not add up.
PART_CHARS = 1_000_000


def parts_of(sizes: list[int], most: int) -> Iterator[slice]:
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def encode(text: Column, model_path: str) -> Column:
    """Ids of each text, null and empty texts as no ids; without begin or end ids, no sampling."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = WordCache(PieceModel(model_path))
        for batch in batches:
            texts = batch.fillna("").tolist()
            out = []
            for part in parts_of([len(t) for t in texts], PART_CHARS):
                flat, lengths = cache.encode(texts[part])
                out.extend(np.split(flat, np.cumsum(lengths)[:-1]))
            yield pd.Series(out, dtype=object)

    return ids(text)


def decode(ids: Column, model_path: str) -> Column:
    """Text of each id list; null and empty lists as the empty text."""

    @F.pandas_udf(StringType())
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = PieceModel(model_path)
        nothing = np.zeros(0, dtype=np.int32)
        for batch in batches:
            lists = [nothing if x is None else x for x in batch]
            out = []
            for part in parts_of([len(x) for x in lists], PART_CHARS):
                chosen = lists[part]
                out.extend(model.decode_flat(np.concatenate(chosen), np.array([len(x) for x in chosen], dtype=np.int64)))
            yield pd.Series(out, dtype=object)

    return texts(ids)


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """Of each row: doc_id, its ids and the text decoded from them.

    Null and empty texts have no ids and decode to the empty text; repeated rows are encoded each for
    itself; an empty table gives no rows. Other columns are not looked at. Both ways are gone in one pass
    over Arrow batches, which leave in parts of `PART_CHARS`, so that a task's memory does not follow its
    batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)
        cache = WordCache(model)
        for batch in batches:
            doc_id, text = batch.column(0), batch.column(1)
            for part in parts_of(pc.binary_length(text).to_pylist(), PART_CHARS):
                n = part.stop - part.start
                flat, lengths = cache.encode(text.slice(part.start, n).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(flat, pa.int32()))
                decoded = pa.array(model.decode_flat(flat, lengths), pa.string())
                yield pa.RecordBatch.from_arrays([doc_id.slice(part.start, n), ids, decoded], ["doc_id", "ids", "decoded"])

    rows = docs.select("doc_id", whole_text().alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], *_ENCODED]))


def token_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Digest columns of `encoded`: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded(docs, model_path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
