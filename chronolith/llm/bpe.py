"""BPE encoding and decoding by batched numpy merge rounds over a public tokenizer file.

A text is cut at its added tokens, normalised and split into words. The symbols of all words not met before lie in
one flat array. A round takes each word's lowest rank, merges that pair from the left and looks the pairs next to it
up in the sorted pair keys by binary search, until no word has a pair left. Words then give their ids by offset, so
the ids of a batch of texts are one gather.

Defined cases: a null text is an empty one, with no ids; a text of any length is one row, handled whole; each of
several equal rows, or rows of one or no doc_id, gives a row of its own; an empty table gives none; columns but doc_id and
text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, rows_out, slices

#: Distinct words kept by one Python worker before its cache starts anew.
CACHE = 250_000
BEYOND = re.compile("[^\x00-\u017f]").search


def byte_letters() -> list[str]:
    """The letter that byte-level BPE files write for each byte: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, more = {}, 0x100
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], more = chr(more), more + 1
    return [letters[b] for b in range(256)]


class Words(dict):
    """Numbers words as they are looked up; fresh holds those that have no ids yet."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Bpe:
    """A tokenizers JSON file of a word-end BPE (NFC, white space to one space, lower case; split by pattern, byte level)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("a tokenizer of another kind")
        vocab = model["vocab"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.path, self.library = path, None
        # Up to U+017F, where lower case stays within these classes and no character composes, re does the splitting.
        low = [chr(c) for c in range(0x180)]
        some = lambda kind: "".join(regex.escape(c) for c in low if unicodedata.category(c)[0] == kind)
        letters, numbers, spaces = some("L"), some("N"), "\t-\r \x85\xa0"
        near = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{spaces}{letters}{numbers}]").replace("\\p{L}", letters).replace("\\p{N}", numbers)
        self.fast = re.compile(near).findall
        #: White space as the file's pattern means it: not the separators U+001C-001F, which str.split() also cuts at.
        self.spaces = re.compile("[" + spaces + "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens = [""] * self.size
        for text, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = text
        self.texts = np.array(self.tokens, object)
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        first = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[first], first.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.forget()

    def forget(self) -> None:
        """An empty cache of words."""
        self.index = Words()
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def words(self, raw: bytes) -> list[str]:
        """The normalised, split words of a text; an added token is a word of its own, marked by a leading space."""
        text = raw.decode("utf-8", "replace")
        if self.cut and "<|" in text:
            found: list[str] = []
            for k, x in enumerate(self.cut.split(text)):
                found += [" " + x] if k & 1 else self.plain_words(x)
            return found
        return self.plain_words(text)

    def plain_words(self, text: str) -> list[str]:
        if text.isascii() or not BEYOND(text):
            return self.fast(text.lower())
        found: list[str] = []
        for piece in self.spaces.split(text):  # no word and no composition spans white space
            if BEYOND(piece):
                found += self.library_words(piece)
            elif piece:
                found += self.fast(piece.lower())
        return found

    def library_words(self, piece: str) -> list[str]:
        """Where Unicode versions may differ, the library's own normaliser and splitter decide."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.byte_of = {x: b for b, x in enumerate(byte_letters())}
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in split]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], len(self.made))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many non-empty words in one flat array, and each word's number of ids."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        none = len(self.made)
        rank = np.full(len(symbols), none)  # of each symbol with the next one of its word
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.rank_of(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbols)]))
            over = least == none
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
            take = (rank == least) & ~over
            after = np.r_[False, take[:-1]]
            if (twin := take & after).any():
                # Of overlapping pairs (a a a) the leftmost goes first: every other one in a run of taken neighbours.
                place = np.arange(len(take))
                run = np.maximum.accumulate(np.where(take & ~twin, place, -1))
                take &= ((place - run) & 1) == 0
                after = np.r_[False, take[:-1]]
            symbols[take] = self.made[rank[take]]
            keep = ~over & ~after
            touched = (take | np.r_[take[1:], False] | np.r_[take[2:], False, False][: len(take)])[keep]
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            # Only pairs next to a merge have a new rank.
            at = np.flatnonzero(touched)
            rank[at] = none
            at = at[at + 1 < len(word)]
            at = at[word[at] == word[at + 1]]
            rank[at] = self.rank_of(symbols[at], symbols[at + 1])
        if not done_words:
            return np.zeros(0, np.uint32), lengths
        word, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        return symbols[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(words))

    def learn(self) -> None:
        """Merges the words that have no ids yet."""
        fresh, self.index.fresh = self.index.fresh, []
        plain = [w for w in fresh if w[0] != " "]
        flat, sizes = self.merge([w.encode() for w in plain])
        if len(plain) < len(fresh):  # added tokens have their ids from the file
            owned = [self.added[w[1:]] if w[0] == " " else -1 for w in fresh]
            at, whole = np.flatnonzero(np.array(owned) >= 0), np.zeros(len(fresh), np.int64)
            whole[np.array(owned) < 0] = sizes
            flat = np.insert(flat, np.cumsum(whole)[at], np.array(owned)[at]).astype(np.uint32)
            whole[at] = 1
            sizes = whole
        self.start = np.concatenate([self.start, np.cumsum(sizes) - sizes + len(self.flat)])
        self.length = np.concatenate([self.length, sizes])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[bytes | str | None]) -> list[np.ndarray]:
        """Each text's ids, uint32."""
        if len(self.index) > CACHE:
            self.forget()
        words = [self.words(t.encode() if isinstance(t, str) else t or b"") for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        if self.index.fresh:
            self.learn()
        n = self.length[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[at] - (ends - n), n) + np.arange(total)]
        return np.split(ids, np.r_[0, ends][np.cumsum(counts)[:-1]]) if len(texts) else []

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' texts joined by one space: the file names no decoder."""
        return " ".join(self.texts[ids])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(2)
def loaded(path: str) -> Bpe:
    """One model per Python worker: its cache of words serves all tasks that the worker runs."""
    return Bpe(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[tuple[Bpe, pa.RecordBatch, list[np.ndarray]]]:
    """Batches of (doc_id, text bytes) with their ids."""
    model = loaded(path or default_path())
    for b in slices(batches):
        yield model, b, model.encode(b.column("text").to_pylist())


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<long>, decoded string) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for model, b, ids in encoded(batches, path):
            yield rows_out(schema, (b.column("doc_id"), [x.astype(np.int64).tolist() for x in ids], [model.decode(x) for x in ids]))

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<long>, decoded string")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Number of tokens and SHA-256 of the ids and of the decoded text of every row, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for model, b, ids in encoded(batches, path):
            yield rows_out(DIGESTS, (b.column("doc_id"), [len(x) for x in ids], [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], [hashlib.sha256(model.decode(x).encode()).hexdigest() for x in ids]))

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, size: int, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Every row's ids and end_id, cut into pieces of at most size ids: place, length and CRC-32 of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b, ids in encoded(batches, path):
            rows = []
            for doc, x in zip(b.column("doc_id").to_pylist(), ids, strict=True):
                x = np.append(x, end_id).astype("<u4")
                rows += [(doc, k, at, len(p := x[at : at + size]), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(x), size))]
            yield rows_out(PIECES, zip(*rows, strict=True))

    return id_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
