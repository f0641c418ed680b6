"""Byte-pair encoding and decoding in batched numpy merge rounds.

The vocabulary file (JSON, word-end suffix, byte alphabet) is read on the driver and its tables, of
fixed size, go to the executors with the function. Per batch of rows:

* texts are normalised and split into words; only words not seen before are encoded;
* the symbols of all those words lie in one flat array. In each round the rank of every adjacent
  pair is found by binary search over the sorted pair keys, each word merges all places of its
  lowest-rank pair, and words without a mergeable pair leave the array.

Merging all places of a word's lowest-rank pair at once equals merging them one by one because a
pair's parts always come from earlier merges; the loader checks that.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Words kept in a worker's cache; rows and bytes of text handled at once.
CACHE_WORDS = 200_000
ROWS_AT_ONCE = 256
BYTES_AT_ONCE = 1 << 20
_NONE = np.int64(1) << 40


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte, by the byte-level rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return [table[b] for b in range(256)]


class WordBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in alphabet], dtype=np.int64)
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        pieces = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pieces)
        self.size = len(self.tokens)
        made = {i: -1 for i in [*self.inner.tolist(), *self.final.tolist()]}
        keys, ranks, into = [], [], []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if made.get(x, rank) >= rank or made.get(y, rank) >= rank:
                raise ValueError("a merge uses a symbol of a later merge; rounds would not be exact")
            made.setdefault(z, rank)
            keys.append(x * self.size + y)
            ranks.append(rank)
            into.append(z)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks = np.array(ranks, dtype=np.int64)[order]
        self.into = np.array(into, dtype=np.int64)[order]
        self.reset()

    def reset(self) -> None:
        """Forget the cached words. Their ids lie one after the other in ``flat``, word i at ``start[i]``."""
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.start = np.zeros(1 << 14, dtype=np.int64)

    def remember(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, end = len(self.index), int(self.start[len(self.index)])
        while end + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + len(words) >= len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
        self.flat[end : end + len(ids)] = ids
        self.start[n + 1 : n + 1 + len(words)] = end + np.cumsum(lengths)
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "flat", "start", "words", "split_special")} | {"patterns": (self.words.pattern, self.split_special.pattern if self.split_special else None)}

    def __setstate__(self, state):
        words, split = state.pop("patterns")
        self.__dict__ |= state
        self.words, self.split_special = regex.compile(words), regex.compile(split) if split else None
        self.reset()

    def normalise(self, text: str) -> str:
        """NFC, then lower case character by character (no final-sigma rule). White space needs no
        collapsing here: no word pattern spans it."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """The words of ``text``; special tokens come back as themselves."""
        if self.split_special is None or "<|" not in text:
            return self.words.findall(self.normalise(text))
        out: list[str] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append("\0" + part)
            else:
                out += self.words.findall(self.normalise(part))
        return out

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and each word's number of ids (no special tokens
        among them)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols, owner = self.inner[flat], np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[flat[ends]]
        done_symbols, done_owner = [], []
        while len(symbols):
            inside = owner[1:] == owner[:-1]
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = inside & (self.keys[at] == pair)
            rank = np.append(np.where(known, self.ranks[at], _NONE), _NONE)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, starts)
            span = np.diff(np.append(starts, len(symbols)))
            best_here = np.repeat(best, span)
            alive = best_here < _NONE
            done_symbols.append(symbols[~alive])
            done_owner.append(owner[~alive])
            symbols, owner, rank, best_here, into = symbols[alive], owner[alive], rank[alive], best_here[alive], np.append(at, 0)[alive]
            if not len(symbols):
                break
            hit = rank == best_here
            place = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
            take = hit & ((place - run_start) % 2 == 0)  # of overlapping places every other, from the left
            symbols = np.where(take, self.into[into], symbols)
            keep = ~np.append(False, take[:-1])
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate(done_symbols or [symbols]), np.concatenate(done_owner or [owner])
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(words))
        return symbols[order].astype(np.int32), counts

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the offset of each text (one more at the end)."""
        if len(self.index) > CACHE_WORDS:
            self.reset()
        split = [self.split(t) for t in texts]
        words = [w for own in split for w in own]
        fresh = dict.fromkeys(w for w in words if w not in self.index)
        special = [w for w in fresh if w[0] == "\0" and w[1:] in self.special]
        ordinary = [w for w in fresh if w[0] != "\0" or w[1:] not in self.special]
        if special:
            self.remember(special, np.array([self.special[w[1:]] for w in special], dtype=np.int32), np.ones(len(special), dtype=np.int64))
        if ordinary:
            self.remember(ordinary, *self.merge_rounds(ordinary))
        at = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        lengths = self.start[at + 1] - self.start[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.flat[np.repeat(self.start[at] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[np.concatenate(([0], np.cumsum([len(own) for own in split], dtype=np.int64)))]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the vocabulary's own library gives them without special tokens added."""
        ids, offsets = self.encode_flat(texts)
        return [ids[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]

    def decode_batch(self, ids: list[np.ndarray]) -> list[str]:
        """Tokens joined by one space: the vocabulary names no decoder, so word ends stay visible."""
        tokens = self.tokens
        return [" ".join([tokens[i] for i in one.tolist()]) for one in ids]


def load(path: str) -> WordBPE:
    """Read a vocabulary file on the driver."""
    with open(path, encoding="utf-8") as f:
        return WordBPE(json.load(f))


def portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``ROWS_AT_ONCE`` rows and, but for a longer single value, ``BYTES_AT_ONCE`` bytes
    in ``column``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            total = np.cumsum(sizes[at : at + ROWS_AT_ONCE])
            n = max(1, int(np.searchsorted(total, BYTES_AT_ONCE, side="right")))
            yield batch.slice(at, n)
            at += n


def _encoded(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, row_col: str | None, with_decoded: bool) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model.value
        for batch in portions(batches, 2):
            ids, offsets = bpe.encode_flat([t or "" for t in batch.column(2).to_pylist()])
            out = {"id": batch.column(0), "row": batch.column(1), "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))}
            if with_decoded:
                out["decoded"] = pa.array(bpe.decode_batch([ids[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]), pa.string())
            yield pa.RecordBatch.from_pydict(out)

    slim = docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, row long, ids array<int>" + ", decoded string" * with_decoded)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, row, ids): the token ids of every row's whole text; a null text counts as empty."""
    return _encoded(docs, vocabulary, id_col, text_col, row_col, False)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``; null ids give an empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(load(vocabulary))
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    at_col = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                ids = [v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.zeros(0, np.int32) for v in batch.column(at_col)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bpe.decode_batch(ids), pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, row, ids, decoded) of every row: encode, then decode what was encoded, in one Arrow stage."""
    return _encoded(docs, vocabulary, id_col, text_col, row_col, True)
