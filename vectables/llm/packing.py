"""Best-fit packing of token sequences by hierarchical residual packing.

Documents are tokenised and cut into pieces once; from then on only piece lengths travel. Every
partition packs its pieces by best fit, largest first, and emits the bins that are nearly full. Underfull bins
move up a tree as items: the groups of a round merge into fewer, a bin first joins another as a whole where
both fit, and bins that are still underfull give back their pieces for another best fit (the packing
with fewer bins is kept). A group gets about ``GROUP_ITEMS`` pieces, so the tree ends in as many
roots as the underfull bins need, not in one task; a round that frees less than 1 bin in 100 is the last.

Best fit on integer lengths keeps a list of open bins per residual and finds the tightest with a bit mask, so a
round is linear in its items.

Defined cases: a null or empty text is one piece holding only the end token; only documents longer than
``size`` are cut, and the first piece takes the remainder; null ids are kept; repeated rows are packed one by one.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vectables.llm.store import Workspace
from vectables.llm.text import SLICE_BYTES, Texts, hash_ranges, lean, slices

GROUP_ITEMS = 100_000
FAN_IN = 8
NEARLY_FULL = 0.995
CACHE_UNITS = 1_000_000       # distinct text units whose ids a task keeps

_BLANK = 0x20
_OTHER_SPACE = np.zeros(256, dtype=bool)
_OTHER_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True


def wide_spaces(data: np.ndarray) -> np.ndarray:
    """Positions where UTF-8 bytes start a Unicode space beyond ASCII (or a byte-order mark)."""
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3) | (data == 0xEF))
    if not len(lead):
        return lead
    pad = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = pad[lead], pad[lead + 1], pad[lead + 2]
    found = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    found |= (a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))
    found |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8F) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & ((c == 0x9F) | (c == 0xA0))))
    found |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    found |= (a == 0xEF) & (b == 0xBB) & (c == 0xBF)
    return lead[found]


class ByteBpe:
    """Ids of whole texts under a public byte-level BPE vocabulary.

    Its pre-tokenizer starts a new token at a single blank between two visible characters, so a
    text is the concatenation of units cut there, and so are its ids. A batch's distinct units are encoded once, all in
    one string, by the same vocabulary as ranks. Texts in which a blank touches other white space or
    an end of the text, that hold a space beyond ASCII, or that could hold a special token, are encoded whole.
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.units = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)        # sorted
        self.first = np.zeros(0, np.int64)          # of each unit in self.ids
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Encode units, blank-led ones in one string, the others (starts of texts) one by one."""
        led = np.array([p[:1] == b" " for p in pieces], dtype=bool)
        ids, counts = [], np.zeros(len(pieces), np.int64)
        if led.any():
            joined = [p for p, x in zip(pieces, led) if x]
            got = np.array(self.units.encode_ordinary(b"".join(joined).decode()), dtype=np.uint32)
            ends = np.searchsorted(np.cumsum(self.width[got]), np.cumsum([len(p) for p in joined])) + 1
            counts[led] = np.diff(ends, prepend=0)
            ids.append(got)
        for i in np.flatnonzero(~led):
            got = np.array(self.units.encode_ordinary(pieces[i].decode()), dtype=np.uint32)
            counts[i] = len(got)
            ids.append(got)
        order = np.concatenate([np.flatnonzero(led), np.flatnonzero(~led)])
        first = np.empty(len(pieces), np.int64)
        first[order] = len(self.ids) + np.cumsum(counts[order]) - counts[order]
        self.ids = np.concatenate([self.ids, *ids])
        at = np.searchsorted(self.hashes, hashes)       # both ascend
        self.hashes = np.insert(self.hashes, at, hashes)
        self.first = np.insert(self.first, at, first)
        self.count = np.insert(self.count, at, counts)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, flat, and the bounds of each text's part."""
        texts = Texts(column)
        data, offsets, n = texts.data, texts.offsets, len(texts)
        odd = np.zeros(n, dtype=bool)

        def mark(places: np.ndarray) -> None:
            odd[np.searchsorted(offsets, places, side="right") - 1] = True

        blank = data == _BLANK
        edge = np.zeros(len(data) + 1, dtype=bool)      # a text starts or ends here
        edge[offsets] = True
        other = blank | _OTHER_SPACE[data]
        beside = np.zeros(len(data), dtype=bool)
        beside[1:] |= other[:-1]
        beside[:-1] |= other[1:]
        mark(np.flatnonzero(blank & (beside | edge[:-1] | edge[1:])))
        mark(wide_spaces(data))
        mark(np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))))

        plain = ~odd & (np.diff(offsets) > 0)
        cut = blank | edge[:-1]
        start = np.flatnonzero(cut)
        text = np.searchsorted(offsets, start, side="right") - 1
        start, text = start[plain[text]], text[plain[text]]
        end = np.empty_like(start)
        end[:-1] = start[1:]
        if len(start):
            end[-1] = offsets[text[-1] + 1]
            last = np.flatnonzero(np.diff(text))
            end[last] = offsets[text[last] + 1]
        hashes = hash_ranges(data, start, end)
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_UNITS:
            self._forget()
        place = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = place < len(self.hashes)
        new[inside] = self.hashes[place[inside]] != distinct[inside]
        if new.any():
            raw = data.tobytes()
            self._learn(distinct[new], [raw[s:e] for s, e in zip(start[at[new]].tolist(), end[at[new]].tolist())])
            place = np.searchsorted(self.hashes, distinct)
        first, count = self.first[place][inverse], self.count[place][inverse]
        total = np.cumsum(count)
        ids = self.ids[np.repeat(first - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        sizes = np.bincount(text, count, n).astype(np.int64)
        if odd.any():
            encoded = {i: self.whole.encode(column[i].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(odd).tolist()}
            parts, upto = [], np.cumsum(sizes)
            for i, a in enumerate(upto - sizes):
                parts.append(encoded[i] if i in encoded else ids[a: a + sizes[i]])
            ids = np.concatenate([np.asarray(p, dtype=np.uint32) for p in parts])
            sizes = np.array([len(p) for p in parts])
        return ids, np.concatenate([[0], np.cumsum(sizes)])


_PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def _cut(size: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES // 2):
                ids, bounds = bpe.encode(batch.column(1))
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                n = np.diff(bounds)
                pieces = -(-n // size)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (n - size * (pieces - 1))[row]
                start = np.where(piece == 0, 0, head + size * (piece - 1))
                length = np.where(piece == 0, head, size)
                a = bounds[row] + start
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(a.tolist(), (a + length).tolist())]
                cols = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cuts = np.append(a, len(ids))
                    cols.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def pieces(docs: DataFrame, id_col: str, text_col: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])``: each document's ids and the end id, cut to ``size``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_cut(size, end_id, with_ids)), _PIECES + (", ids array<long>" if with_ids else ""))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Best fit, largest first: the bin of each item and the number of bins."""
    out = np.empty(len(sizes), dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]     # bins by residual
    mask = bins = 0                                                # bit r: a bin with residual r is open
    order = np.argsort(-sizes, kind="stable")
    for i, n in zip(order.tolist(), sizes[order].tolist()):
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            bin_ = open_[left].pop()
            if not open_[left]:
                mask ^= 1 << left
        else:
            bin_, left, bins = bins, capacity, bins + 1
        out[i] = bin_
        left -= n
        if left:
            if not open_[left]:
                mask |= 1 << left
            open_[left].append(bin_)
    return out, bins


def repack(length: np.ndarray, bin_: np.ndarray | None, capacity: int) -> np.ndarray:
    """New bins for pieces that come in bins (or single, without): the better of joining whole bins
    and of packing the pieces of underfull bins anew."""
    if bin_ is None:
        return best_fit(length, capacity)[0]
    _, bin_ = np.unique(bin_, return_inverse=True)
    used = np.bincount(bin_, length).astype(np.int64)
    joined, n_joined = best_fit(used, capacity)
    apart, n_apart = best_fit(length, capacity)
    return apart if n_apart < n_joined else joined[bin_]


def _place(frame: pd.DataFrame, capacity: int, first_bin: int) -> pd.DataFrame:
    """Numbers bins from ``first_bin``, lays their pieces out without gaps and marks nearly full bins."""
    frame = frame.sort_values(["bin", "id", "piece", "start"], kind="stable", ignore_index=True)
    length = frame["length"].to_numpy()
    change = np.concatenate([[True], np.diff(frame["bin"].to_numpy()) != 0])
    number = np.cumsum(change) - 1
    before = np.cumsum(length) - length
    frame["offset"] = before - before[change][number]
    used = np.bincount(number, length)
    frame["full"] = (used >= NEARLY_FULL * capacity)[number]
    frame["bin"] = first_bin + number
    return frame


_PACKED = _PIECES + ", grp long, bin long, offset long, full boolean"
_COLUMNS = ["id", "piece", "start", "length", "ids_crc32", "grp", "bin", "offset", "full"]


def _first_round(capacity: int):
    """Packs a partition's pieces, ``GROUP_ITEMS`` at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = TaskContext.get().partitionId()
        bins = 0

        def packed(parts: list[pd.DataFrame]) -> pd.DataFrame:
            nonlocal bins
            frame = pd.concat(parts, ignore_index=True)
            frame["bin"] = repack(frame["length"].to_numpy(), None, capacity)
            frame = _place(frame, capacity, (group << 32) + bins).assign(grp=group)
            bins += frame["bin"].nunique()
            return frame[_COLUMNS]

        held, rows = [], 0
        for frame in frames:
            for lo in range(0, len(frame), GROUP_ITEMS):
                held.append(frame.iloc[lo: lo + GROUP_ITEMS])
                rows += len(held[-1])
                if rows >= GROUP_ITEMS:
                    yield packed(held)
                    held, rows = [], 0
        if rows:
            yield packed(held)

    return run


def _next_round(capacity: int, level: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bin", "offset"], ignore_index=True)
        frame["bin"] = repack(frame["length"].to_numpy(), frame["bin"].to_numpy(), capacity)
        first = (level << 58) + (int(key[0]) << 32)
        return _place(frame, capacity, first).assign(grp=int(key[0]))[_COLUMNS]

    return run


def pack(cut: DataFrame, size: int = 2048) -> DataFrame:
    """Pieces ``(id, piece, start, length, ids_crc32)`` -> the same with ``sequence_id, offset``."""
    spark = cut.sparkSession
    space = Workspace(spark, "packing")
    cut = space.save(cut, "pieces")
    at = space.save(cut.mapInPandas(lean(_first_round(size)), _PACKED), "round-0")
    groups, level, before, done = None, 0, None, []
    while True:
        done.append(at.where("full"))
        rest = at.where("not full")
        left = rest.agg(F.count("*").alias("n"), F.countDistinct("bin").alias("bins"), F.max("grp").alias("g")).first()
        groups = groups if groups is not None else (left["g"] or 0) + 1
        better = before is None or left["bins"] < 0.99 * before or groups > 1
        if not left["n"] or not better or (level and groups == 1):
            return _united([*done, rest])
        level += 1
        fewer = max(1, -(-groups // FAN_IN), -(-left["n"] // GROUP_ITEMS))
        if fewer >= groups and level > 1:
            return _united([*done, rest])
        fewer, before = min(fewer, groups), left["bins"]
        parent = F.floor(F.col("grp") * fewer / groups).cast("long")
        at = space.save(rest.withColumn("grp", parent).groupBy("grp").applyInPandas(
            _next_round(size, level), _PACKED), f"round-{level}")
        groups = fewer


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select("id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
