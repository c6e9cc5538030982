"""Documents packed into training sequences: dominance reduction, then best fit.

Piece lengths are whole numbers up to the sequence length, so the whole instance is a
histogram with at most that many entries; it is packed on the driver as groups of
equal sequences. Sets that provably dominate all alternatives for a piece (Martello and Toth)
are fixed first, and best-fit decreasing packs what is left. Pieces learn their place from
their rank among pieces of equal length; no row of a document is ever collected.

A null or empty text is one piece, the end id alone. Repeated rows are packed each; pieces of equal length take places in any order.
Very long texts are encoded whole and cut after that. An empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .scratch import id_text, ranked
from .words import SPACED, buffers, words

LENGTH, END = 2048, 0
#: Encoded words that a worker keeps, and bytes of texts that are encoded together.
KEPT_WORDS, RUN_BYTES = 1_500_000, 4_000_000

STOPS = ".,"
_CONTROLS = "\x1c\x1d\x1e\x1f"
_ODD_SPACE = re.compile(r"[^\S \t\n\r\f\v]")


_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_WORD_END = "\x01"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 ones themselves, then the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int] | None:
    """Byte strings of the tokens with their ids as ranks, if encoding by ranks gives what encoding by merges gives.

    That is so if every token's own letters merge to just that token: two neighbours whose union is a
    token are then always the pair that makes it. Words' ends are written as _WORD_END.
    None if that, or the layout (letters, letters that end words, then merges in order), doesn't hold.
    """
    model = json.loads(Path(path).read_text())["model"]
    suffix, vocab, letters = model.get("end_of_word_suffix"), model["vocab"], byte_letters()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = {pair: i for i, pair in enumerate(merges)}
    if not suffix or [vocab.get(a + b) for a, b in merges] != [512 + i for i in range(len(merges))]:
        return None
    if any(vocab.get(c, 512) >= 256 or not 256 <= vocab.get(c + suffix, 0) < 512 for c in letters):
        return None
    ranks = {}
    for c, byte in letters.items():
        ranks[bytes([byte])] = vocab[c]
        ranks[bytes([byte]) + _WORD_END.encode()] = vocab[c + suffix]
    for i, (a, b) in enumerate(merges):
        whole = a + b
        body, ending = (whole[: -len(suffix)], True) if whole.endswith(suffix) else (whole, False)
        parts = list(body)
        if ending:
            parts[-1] += suffix
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda j: order.get((parts[j], parts[j + 1]), len(order)))
            if (parts[best], parts[best + 1]) not in order:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        ranks[bytes(letters[c] for c in body) + (_WORD_END.encode() if ending else b"")] = 512 + i
    return ranks if len(ranks) == 512 + len(merges) else None


class Coder:
    """Token ids of texts; each word between white space is encoded once.

    That equals encoding the whole text where the tokenizer lower-cases, drops white space and never joins
    across it. Texts with white space beyond ASCII are encoded whole. Words of Latin letters are
    encoded by ranks where ``ranks_of`` shows that to be the same, as that is several times faster.
    Known words are kept by 64-bit hash in sorted arrays, which take some 40 bytes a word.
    """

    def __init__(self, path: str, ranks: dict[bytes, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        names = self.coder.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.stops = {p: self._whole(p) for p in STOPS}
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.ranked = None
        if ranks:
            import tiktoken

            self.ranked = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each word; a word with a stop or comma at its end is the word and then the sign."""
        out: list[np.ndarray] = [self.stops["."]] * len(parts)
        bare, rest = [], []
        for i, p in enumerate(parts):
            core = p[:-1] if p[-1] in STOPS else p
            if self.ranked and _PLAIN.fullmatch(core):
                bare.append((i, core))
            else:
                rest.append(i)
        for a in range(0, len(bare), 20_000):
            some = bare[a : a + 20_000]
            ids = np.array(self.ranked((_WORD_END + " ").join([w for _, w in some]).lower() + _WORD_END), np.uint32)
            for (i, core), part in zip(some, np.split(ids, np.flatnonzero(self.ends[ids])[:-1] + 1), strict=True):
                out[i] = part if len(core) == len(parts[i]) else np.concatenate([part, self.stops[parts[i][-1]]])
        for a in range(0, len(rest), 20_000):
            some = rest[a : a + 20_000]
            encoded = self.coder.encode(" ".join([parts[i] for i in some]), add_special_tokens=False)
            starts = np.fromiter((x for x, _ in encoded.offsets), np.int64, len(encoded.ids))
            after = np.cumsum(np.fromiter((len(parts[i]) for i in some), np.int64, len(some)) + 1)
            for i, part in zip(some, np.split(np.array(encoded.ids, np.uint32), np.searchsorted(starts, after)[:-1]), strict=True):
                out[i] = part
        return out

    def _places(self, keys: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of each of some distinct words, given by sorted hashes; text_of(i) is a word's text."""
        spot = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        found = self.keys[spot] == keys if len(self.keys) else np.zeros(len(keys), bool)
        missing = np.flatnonzero(~found)
        if len(missing):
            ids = self._learn([text_of(i) for i in missing.tolist()])
            if len(self.keys) + len(missing) > KEPT_WORDS:  # start anew with what is in use
                known = np.flatnonzero(found)
                ids = [self.pool[self.at[s] : self.at[s] + self.n[s]].copy() for s in spot[known].tolist()] + ids
                missing = np.concatenate([known, missing])
                self.keys, self.at, self.n, self.used = self.keys[:0], self.at[:0], self.n[:0], 0
            n = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            if self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + len(flat) + (1 << 16), np.uint32)])
            self.pool[self.used : self.used + len(flat)] = flat
            at = self.used + np.cumsum(n, dtype=np.int64) - n
            self.used += len(flat)
            order = np.argsort(merged := np.concatenate([self.keys, keys[missing]]), kind="stable")
            self.keys, self.at, self.n = merged[order], np.concatenate([self.at, at])[order], np.concatenate([self.n, n])[order]
            spot = np.searchsorted(self.keys, keys)
        return self.at[spot], self.n[spot].astype(np.int64)

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Of several texts together, so that each word in them is looked up once."""
        data, _ = buffers(texts)
        runs = list(words(texts, SPACED))
        join = lambda name, kind: np.concatenate([getattr(w, name) for w in runs] or [np.zeros(0, kind)])
        start, length = join("start", np.int64), join("length", np.int64)
        keys, first, each = np.unique(join("hash", np.uint64), return_index=True, return_inverse=True)
        at, n = self._places(keys, lambda i: data[start[first[i]] : start[first[i]] + length[first[i]]].tobytes().decode())
        counts = n[each]
        ends = np.cumsum(counts)
        flat = self.pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at[each] - ends + counts, counts)]
        bounds, before = [0], 0
        ends = np.concatenate([[0], ends])
        for w in runs:
            bounds += ends[w.bounds[1:] + before].tolist()
            before += len(w.hash)
        out = [flat[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        for i, text in enumerate(texts):
            text = text.as_py() or ""
            if (not text.isascii() or any(c in text for c in _CONTROLS)) and _ODD_SPACE.search(text):
                out[i] = self._whole(text)
        return out


_coders: dict[str, Coder] = {}


def _pieces(path: str, ranks: dict[bytes, int] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if path not in _coders:
        _coders[path] = Coder(path, ranks)
    coder = _coders[path]
    end = np.array([END], "<u4")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    for whole in batches:
        for b in _runs(whole, RUN_BYTES):
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), coder.ids(b.column(1).fill_null("")), strict=True):
                ids = np.concatenate([ids.astype("<u4"), end]).tobytes()
                for piece, at in enumerate(range(0, len(ids), 4 * LENGTH)):
                    part = ids[at : at + 4 * LENGTH]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def _runs(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about so many bytes."""
    ends = np.cumsum(pc.binary_length(batch.column(1).fill_null("")).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")) - at)
        yield batch.slice(at, n)
        at += n


def reduce(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets and take them out of ``left``; returns (sizes, how many such sequences).

    For a largest piece with room R beside it: nothing fits: it stays alone. A piece of exactly
    R is at hand: nothing can beat that pair. Only one more piece can fit: the largest that does.
    At most two fit: the largest single one, if no pair is longer; or the largest one with
    the largest beside it, if no pair has a larger lesser half.
    """
    fixed = []

    def take(sizes: tuple[int, ...], times: int) -> None:
        fixed.append((sizes, times))
        for s in sizes:
            left[s] -= times
            if not left[s]:
                del left[s]

    changed = True
    while changed:
        changed = False
        for s in sorted(left, reverse=True):
            while left.get(s, 0):
                room, n = capacity - s, left[s]
                if left.get(room, 0) and (room != s or n > 1):
                    take((s, room), n // 2 if room == s else min(n, left[room]))
                    changed = True
                    continue
                sizes = sorted(x for x in left if x <= room and (x != s or n > 1))
                if not sizes:
                    take((s,), n)
                    changed = True
                    continue
                free = lambda x, s=s: left[x] - (x == s)
                least = [x for x in sizes[:3] for _ in range(min(3, free(x)))][:3]
                big = sizes[-1]
                most = lambda x: n // 2 if x == s else min(n, left[x])
                if len(least) < 2 or least[0] + least[1] > room:
                    take((s, big), most(big))
                    changed = True
                    continue
                if len(least) > 2 and sum(least) <= room:
                    break
                best, lesser = 0, 0
                for x in sizes:
                    i = bisect.bisect_right(sizes, room - x) - 1
                    if i >= 0 and sizes[i] == x and free(x) < 2:
                        i -= 1
                    if i >= 0:
                        best = max(best, x + sizes[i])
                        lesser = max(lesser, min(x, sizes[i]))
                if big >= best:
                    take((s, big), most(big))
                    changed = True
                    continue
                beside = [x for x in sizes if x <= room - big and (x != big or free(x) > 1)]
                if beside and beside[-1] >= lesser:
                    take((s, big, beside[-1]), 1)
                    changed = True
                    continue
                break
    return fixed


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal sequences move together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, sizes: tuple[int, ...], times: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((sizes, times))

    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                each = capacity // s
                for held, times in ((each, n // each), (n % each, 1)):
                    if held and times:
                        put(capacity - held * s, (s,) * held, times)
                break
            room = rooms[i]
            sizes, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            used = min(n, times)
            if used < times:
                put(room, sizes, times - used)
            put(room - s, (*sizes, s), used)
            n -= used
    return [group for held in open_.values() for group in held]


def plan(histogram: dict[int, int], capacity: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Groups (sizes, how many sequences hold just these) for all pieces of a histogram of lengths."""
    left = {s: n for s, n in histogram.items() if n}
    return reduce(left, capacity) + best_fit(left, capacity)


def places(groups: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length and first rank), and for each the first sequence and the offset of its run of ranks."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for sizes, times in groups:
        offset = 0
        for s in sizes:
            rank = used.get(s, 0)
            rows.append(((s << 44) + rank, sequence, offset))
            used[s] = rank + times
            offset += s
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()


def _placed(where: tuple[np.ndarray, np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, sequences, offsets = where
    for b in batches:
        key = (b.column(3).to_numpy() << 44) + b.column(5).to_numpy()
        at = np.searchsorted(keys, key, "right") - 1
        yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])], names=[*b.schema.names[:5], "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only the histogram of lengths, at most LENGTH rows, reaches the driver.
    """
    ranks = ranks_of(tokenizer)
    held = ranked(id_text(docs), "length", "_rank", "pieces", lambda it: _pieces(tokenizer, ranks, it), "doc_id long, piece int, start long, length long, ids_crc32 long")
    counted = held.groupBy("length").count().collect()
    where = places(plan({r["length"]: r["count"] for r in counted}))
    columns = held.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    return columns.mapInArrow(lambda it: _placed(where, it), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
