"""Exact token counts of whole texts in batches, and their ids by pieces between safe boundaries."""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import alone, arrow_rows, blocks, remember, trim

#: Texts of more characters are cut at safe boundaries into parts of about as many.
PART_CHARS = 65_536
#: Pieces that a worker remembers in each of two generations, the longest that it remembers,
#: and the longest that the small merger takes (its time is quadratic).
MEMORY_PIECES, MEMORY_CHARS, MERGER_CHARS = 250_000, 48, 400

#: The patterns at which byte-level vocabularies and the lower-casing word vocabulary split.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Ends a word for the merger, in place of the vocabulary's own mark; pieces that hold it go to the library.
END = "\x01"


def vocabulary_path(name: str) -> str:
    """An absolute path as it is; else the file of that name among the public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, then from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}


def cut_of(plan: dict) -> str:
    """Where a tokenizer's texts can be cut: "space" (before a word), "white" (white space is in no token), "whole" (nowhere)."""
    pre = plan.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not plan.get("normalizer"):
        return "space"  # every token begins at or before the space that precedes a word
    parts = pre.get("pretokenizers") or [{}]
    norms = [x["type"] for x in (plan.get("normalizer") or {}).get("normalizers", [])]
    if parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0]["pattern"].get("Regex") == WORD_PATTERN and norms == ["NFC", "Replace", "Lowercase"]:
        return "white"
    return "whole"


def merger_of(model: dict, cut: str, specials: list[str]):
    """The vocabulary as a tiktoken encoding (equal ids, several times as fast), if ids rise with merges as it needs; else None."""
    end, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
    made = ["".join(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
    order = [vocab[x] for x in made]
    if cut == "whole" or order != sorted(set(order)) or bool(end) != (cut == "white"):
        return None
    letters = byte_letters()
    ranks = {}
    for token, i in vocab.items():
        if token not in specials:
            body = token.removesuffix(end) if end else token
            if all(c in letters for c in body):
                ranks[bytes(letters[c] for c in body) + (END.encode() if body != token else b"")] = i
    if any(bytes([b]) not in ranks for b in range(256)) or len(ranks) != len(vocab.keys() - set(specials)):
        return None
    import tiktoken

    return tiktoken.Encoding("pieces", pat_str=BYTE_PATTERN if not end else f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})


class BatchCounter:
    """Numbers of a tokenizer's ids of whole texts, a batch at a time.

    Where the vocabulary allows, a batch is encoded at once by tiktoken over the same ranks (equal ids). Long texts
    are cut before spaces between two words, where no token of byte-level vocabularies can cross. Parts that hold a special
    token's string, or a run that the merger is slow on, and vocabularies of another build go to the library's own batches.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        plan = json.loads(self.tokenizer.to_str())
        added = plan.get("added_tokens") or []
        self.specials = [x["content"] for x in added]
        self.cut = cut_of(plan)
        self.splits = self.cut == "space" and not any(x["lstrip"] or x["rstrip"] or re.search(r"\s", x["content"]) for x in added)
        self.merger = merger_of(plan["model"], self.cut, self.specials) if self.cut == "space" else None

    def parts(self, text: str) -> list[str]:
        """The text, cut before spaces between words about every PART_CHARS characters."""
        if not self.splits or len(text) <= PART_CHARS:
            return [text]
        out, at = [], 0
        while m := _BETWEEN.search(text, at + PART_CHARS):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def lengths(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text; null counts as empty."""
        own, parts = [], []
        for i, text in enumerate(texts):
            for part in self.parts(text) if text else ():
                own.append(i)
                parts.append(part)
        plain, other = [], []
        for k, part in enumerate(parts):
            slow = self.merger is None or any(s in part for s in self.specials) or _LONG.search(part)
            (other if slow else plain).append(k)
        out = [0] * len(texts)
        if plain:
            for k, ids in zip(plain, self.merger.encode_ordinary_batch([parts[k] for k in plain], num_threads=1), strict=True):
                out[own[k]] += len(ids)
        if other:
            for k, found in zip(other, self.tokenizer.encode_batch_fast([parts[k] for k in other], add_special_tokens=False), strict=True):
                out[own[k]] += len(found.ids)
        return out


class PieceCodec(dict):
    """A tokenizer over texts that are cut where no token can cross: piece -> what it stands for.

    Where the vocabulary splits at white space, a text's pieces are encoded apart and
    remembered; texts that hold a special token's string, and vocabularies of another
    build, are encoded whole by the library. A piece stands for the number of its ids, or
    for the ids as little-endian unsigned 32-bit bytes.

    New pieces of usual length go to tiktoken's merger over the same vocabulary (equal ids
    by rank; four times as fast), all others to the library.
    """

    def __init__(self, path: str, ids: bool, remembered: int = MEMORY_PIECES):
        super().__init__()
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plan = json.loads(self.tokenizer.to_str())
        self.specials = [x["content"] for x in plan.get("added_tokens") or []]
        self.cut, self.ids = cut_of(plan), ids
        self.prefix = " " if self.cut == "space" else ""
        self.old: dict = {}
        merger = merger_of(plan["model"], self.cut, self.specials)
        self.merger = merger.encode_ordinary if merger else None
        self.words = regex.compile(WORD_PATTERN)
        self.marks = {c: self._fresh(c) for c in ".,;:!?"} if self.merger else {}

    def _fresh(self, piece: str):
        if self.merger and len(piece) < MERGER_CHARS and END not in piece:
            if self.cut == "white":
                if not piece.isascii():
                    # letters one by one: the library knows no final sigma
                    piece = "".join(map(str.lower, unicodedata.normalize("NFC", piece)))
                else:
                    piece = piece.lower()
                piece = piece + END if piece.isalpha() else self.words.sub(rf"\g<0>{END}", piece)
            ids = self.merger(piece)
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids) if self.ids else len(ids)

    def __missing__(self, piece: str):
        if self.prefix and (not piece or piece[0].isspace()):
            raise KeyError(piece)  # the space before it isn't a safe place to cut
        value = self.old.get(piece)
        if value is None:
            mark = self.marks.get(piece[-1:])
            if mark is not None and piece[:-1].isalpha():  # letters, then a mark: apart in both patterns
                value = self[piece[:-1]] + mark
            else:
                value = self._fresh(self.prefix + piece)
        if len(piece) <= MEMORY_CHARS:
            if len(self) >= self.remembered:
                self.old = {}  # goes before the next one is made
                self.old = dict(self)
                self.clear()
                trim()
            self[piece] = value
        return value

    def encode(self, text: str | None):
        """The count of a whole text's ids, or their bytes; null counts as empty."""
        join = b"".join if self.ids else sum
        if not text:
            return join([])
        if self.cut == "whole" or any(s in text for s in self.specials):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids) if self.ids else len(ids)
        if self.cut == "white":
            return join(map(self.__getitem__, _WHITE.split(text) if _CONTROL.search(text) else text.split()))
        head, *rest = text.split(" ")
        try:
            return join([self._fresh(head), *map(self.__getitem__, rest)])
        except KeyError:
            head, *rest = _SPACE.split(text)
            return join([self._fresh(head), *map(self.__getitem__, rest)])


#: A space before a word; separators that str.split() knows and the vocabulary doesn't; white space without them.
_SPACE, _CONTROL, _WHITE = re.compile(r" (?=\S)"), re.compile("[\x1c-\x1f]"), re.compile(r"[^\S\x1c-\x1f]+")

#: A space between words, and runs too long for the small merger.
_BETWEEN, _LONG = re.compile(r"(?<=\S) (?=\S)"), re.compile(rf"\S{{{MERGER_CHARS},}}|\s{{{MERGER_CHARS},}}")

_CODECS: dict[tuple[str, bool, int], PieceCodec] = {}
_COUNTERS: dict[str, BatchCounter] = {}
remember("codec", _CODECS.clear)
remember("counter", _COUNTERS.clear)


def counter(vocabulary: str) -> BatchCounter:
    """The worker's counter of a vocabulary file."""
    if vocabulary not in _COUNTERS:
        _COUNTERS[vocabulary] = BatchCounter(vocabulary_path(vocabulary))
    return _COUNTERS[vocabulary]


def codec(vocabulary: str, ids: bool = False, remembered: int = MEMORY_PIECES) -> PieceCodec:
    """The worker's codec of a vocabulary file; ``remembered``: pieces in each generation, which tell only how fast it is."""
    key = (vocabulary, ids, remembered)
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(vocabulary_path(vocabulary), ids, remembered)
        trim()  # what reading the vocabulary took
    return _CODECS[key]


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text.

    Counts are the library's own, without added special tokens; a special token's string
    inside a text is that token. Null counts as empty: 0 and 0. Rows are kept as they come,
    repeats and null ids included; other columns are not read; an empty table gives no rows; no shuffle. Texts are
    encoded in batches of about as many bytes each, long ones in parts; only lengths leave the Arrow function.
    """
    arrow_rows(docs.sparkSession)

    def counted(batches):
        alone("counter")
        for batch, texts in blocks(batches):
            lengths = counter(vocabulary).lengths(texts)
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64()), pa.array([n > limit for n in lengths], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
