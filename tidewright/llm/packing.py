"""Packing token sequences shortest pack first, over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, alone, arrow_rows, blocks, gapless_rank, settle
from .tokens import MEMORY_PIECES, codec

#: The id that ends every document.
END_ID = 2


def pack_patterns(lengths: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences look so) for a histogram length -> count.

    Lengths are placed longest first, each into the packs that then have most room left
    (the shortest), if they hold it; whole pattern counts move at once, so the work follows the number
    of distinct lengths, not of documents. Lengths must be 1 to ``size``.
    """
    open_packs: list[Counter] = [Counter() for _ in range(size + 1)]  # by room left
    for length in sorted(lengths, reverse=True):
        left, room = lengths[length], size
        while left:
            while room >= length and not open_packs[room]:
                room -= 1
            if room < length:
                break
            pattern = min(open_packs[room])
            taken = min(left, open_packs[room][pattern])
            open_packs[room][pattern] -= taken
            if not open_packs[room][pattern]:
                del open_packs[room][pattern]
            open_packs[room - length][(*pattern, length)] += taken
            left -= taken
        while left:  # new packs, as full of this length as it goes
            each = min(size // length, left)
            open_packs[size - each * length][(length,) * each] += left // each
            left %= each
    return sorted((p, n) for packs in open_packs for p, n in packs.items())


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, step, offset), sorted by first rank.

    The rank r of a length falls into the last row with first rank <= r; it is in
    sequence first + (r - first rank). A pattern holding a length twice has two rows.
    """
    rows, ranks, sequence = defaultdict(list), Counter(), 0
    for lengths, count in patterns:
        offset = 0
        for n in lengths:
            rows[n].append((ranks[n], sequence, offset))
            ranks[n] += count
            offset += n
        sequence += count
    return {n: np.array(x, dtype=np.int64) for n, x in rows.items()}


def token_pieces(docs: DataFrame, vocabulary: str, size: int, remembered: int = MEMORY_PIECES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of the pieces of every document.

    A document is its ids (null text: none) and END_ID, cut into pieces of ``size`` and a rest.
    """
    arrow_rows(docs.sparkSession)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches):
        alone("codec")
        for batch, texts in blocks(batches):
            encode = codec(vocabulary, ids=True, remembered=remembered).encode
            keys, out = batch.column("doc_id").to_pylist(), []
            for key, ids in zip(keys, map(encode, texts), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    out.append((key, start, len(part) // 4, zlib.crc32(part), total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", size: int = 4096, remembered: int = MEMORY_PIECES) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Texts are encoded once; the pieces, 40 bytes each, go to the checkpoint folder. The
    driver sees the histogram, ``size`` rows at most, and plans on it; pieces find their
    place by their rank among those of their length (ranked without sorting a whole
    length). ``remembered`` bounds what a worker remembers of the vocabulary's work: memory against time, for equal ids. Repeated rows and null ids are packed like any other row; null text is
    END_ID alone; an empty table gives no rows.
    """
    pieces = settle(token_pieces(docs, vocabulary, size, remembered))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = places(pack_patterns(histogram, size))
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)).cast("int")
    ranked = gapless_rank(pieces, "length", salt, ["doc_id", "start", "ids_crc32"], "rank")

    def placed(batches):
        alone("packing")
        for batch in batches:
            lengths, ranks = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for n in np.unique(lengths):
                rows, at = table[int(n)], np.flatnonzero(lengths == n)
                row = rows[np.searchsorted(rows[:, 0], ranks[at], side="right") - 1]
                sequence[at], offset[at] = row[:, 1] + ranks[at] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays(
                [batch.column(x) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    names = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(placed, f"{names}, sequence_id long, offset long")
