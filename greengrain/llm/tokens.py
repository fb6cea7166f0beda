"""Token ids of public tokenizers for many texts at once, as flat arrays with row pointers."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from greengrain.llm.merge_queue import MergeQueue, pointers

SLICE_BYTES, FEW = 1 << 22, 256
# The pattern of the ByteLevel pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_PIECES, MEMO_IDS = 400_000, 4_000_000


def read_bytes(path: str) -> bytes:
    """A vocabulary file, read once by the driver; it travels inside the tasks (1 to 2 MB, fixed by the vocabulary)."""
    with open(path, "rb") as f:
        return f.read()


def gather(ptr: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positions of all entries of the given rows, row after row."""
    sizes = ptr[rows + 1] - ptr[rows]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - sizes - ptr[rows], sizes)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text; a longer text is a part of its own."""
    text = batch.column("text")
    size = np.array(pc.binary_length(text).fill_null(0), np.int64)
    part = (np.cumsum(size) - size) // limit
    bounds = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else []
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield batch.slice(a, b - a)


class Numbers(dict):
    """Numbers for keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


# White space other than single blanks and line breaks, and the byte that cuts.
UNEVEN = "[\\x00\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n][ \n]"


def numbered(texts: pa.Array, known: Numbers, cut: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers in `known` of the parts of all texts, row pointers): words with the blank before them, and line breaks.

    Patterns of the byte-level family never join a word with the blank or the line break after it, nor a line break with the word
    after it, where no other white space is next to it. Texts with such white space are left to `cut`.
    """
    texts = texts.cast(pa.large_string())
    uneven = pc.match_substring_regex(texts, UNEVEN)
    parted = pc.replace_substring(pc.replace_substring(texts.filter(pc.invert(uneven)), " ", "\0 "), "\n", "\0\n\0")
    lists = pc.split_pattern(parted, "\0")
    each = lists.flatten().dictionary_encode()
    numbers = np.fromiter(map(known.__getitem__, each.dictionary.to_pylist()), np.int64)
    rows, sizes = numbers[np.asarray(each.indices)], np.zeros(len(texts), np.int64)
    kind = np.asarray(uneven.cast(pa.int8()).fill_null(2))
    sizes[kind == 0] = np.asarray(pc.list_value_length(lists))
    if not (kind == 1).any():
        return rows, pointers(sizes)
    other = [cut(t) for t in texts.filter(uneven).to_pylist()]
    sizes[kind == 1] = list(map(len, other))
    ptr = pointers(sizes)
    out = np.empty(int(ptr[-1]), np.int64)
    out[gather(ptr, np.flatnonzero(kind == 0))] = rows
    out[gather(ptr, np.flatnonzero(kind == 1))] = np.fromiter(map(known.__getitem__, chain.from_iterable(other)), np.int64)
    return out, ptr


def byte_signs() -> dict[str, int]:
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


def merges_of(model: bytes) -> MergeQueue | None:
    """The merges of a byte-level model; None if it has other rules, lacks a byte or makes a token by two merges."""
    told = json.loads(model)
    bpe, before = told["model"], told.get("pre_tokenizer") or {}
    rules = (bpe.get("type"), before.get("type"), before.get("use_regex", True), before.get("add_prefix_space"), told.get("normalizer"))
    more = [bpe.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")]
    if rules != ("BPE", "ByteLevel", True, False, None) or any(more) or not all(t["special"] for t in told.get("added_tokens", ())):
        return None
    vocab, sign = bpe["vocab"], {b: c for c, b in byte_signs().items()}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe["merges"]]
    made = [vocab.get(a + b) for a, b in merges]
    one = [vocab.get(sign[b]) for b in range(256)]
    if None in one or None in made or len(set(made)) < len(made):
        return None
    return MergeQueue(one, [(vocab[a], vocab[b], r) for r, (a, b) in enumerate(merges)], made, max(vocab.values()) + 1)


class ByteLevelTokens:
    """Byte-level BPE of the tokenizers library.

    The pattern of these vocabularies never joins a word with the single blank after it, nor ASCII letters with the
    punctuation or single line break after them, whatever else the text holds: a text is cut there, and each distinct
    part is encoded once for many texts. With `plain`, strings of special tokens inside a text are ordinary text.

    New parts of Latin letters share one merge queue, which gives the ids of the library in a part of its time; the library
    encodes all others, and all parts of a model with more than merges and the usual pattern.
    """

    def __init__(self, model: bytes, plain: bool = True, memo: int = MEMO_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_str(model.decode("utf-8"))
        self.model.encode_special_tokens = plain
        self.memo, self.queue = memo, merges_of(model) if plain else None
        if self.queue:
            import regex
            self.split, self.latin = regex.compile(PATTERN).findall, re.compile("[\0-\u024f]*").fullmatch
        self.cut = re.compile(r" ?[A-Za-z]+(?=[ \n]\S|[,.;:!?)])|[,.;:!?)](?=[ \n]\S)|.+?(?<=\S)(?= \S)|.+", re.DOTALL).findall
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.ids, self.ptr = np.empty(0, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, row pointers)."""
        if len(self.known) > self.memo or len(self.ids) > MEMO_IDS:  # only a memo: a fresh one costs time, not results
            self.forget()
        had = len(self.known)
        rows, at = numbered(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), self.known, self.cut)
        new = list(islice(reversed(self.known), len(self.known) - had))[::-1]
        if new:
            ids, ptr = self.merged(new) if self.queue and len(new) > FEW else self.by_library(new)
            self.ids = np.concatenate([self.ids, ids])
            self.ptr = np.concatenate([self.ptr, self.ptr[-1] + ptr[1:]])
        ends = pointers((self.ptr[1:] - self.ptr[:-1])[rows])
        return self.ids[gather(self.ptr, rows)], ends[at]

    def by_library(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.model.encode_batch_fast(parts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int64), pointers([len(f) for f in found])

    def merged(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row pointers) of parts: each distinct pre-token of the Latin ones goes through the queue once."""
        latin = np.fromiter((self.latin(p) is not None for p in parts), bool, len(parts))
        own, pieces = [self.split(p) for p in compress(parts, latin)], Numbers()
        held = np.fromiter(map(pieces.__getitem__, chain.from_iterable(own)), np.int64)
        flat, counts, odd = self.queue.run([p.encode("utf-8") for p in pieces]) if pieces else (np.empty(0, np.int32), np.empty(0, np.int64), [])
        every = np.zeros(len(pieces), bool)
        every[odd] = True
        few_ids, few_ptr = self.by_library([p for p, k in zip(pieces, every.tolist()) if k])
        counts[every] = np.diff(few_ptr)
        at = pointers(counts)
        ids = np.empty(int(at[-1]), np.int64)
        ids[gather(at, np.flatnonzero(~every))], ids[gather(at, np.flatnonzero(every))] = flat, few_ids
        other_ids, other_ptr = self.by_library(list(compress(parts, ~latin)))
        sizes = np.empty(len(parts), np.int64)
        sizes[latin] = np.diff(pointers(counts[held])[pointers(list(map(len, own)))])
        sizes[~latin] = np.diff(other_ptr)
        ptr = pointers(sizes)
        out = np.empty(int(ptr[-1]), np.int64)
        out[gather(ptr, np.flatnonzero(latin))], out[gather(ptr, np.flatnonzero(~latin))] = ids[gather(at, held)], other_ids
        return out, ptr

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id: printable Latin-1 characters stand for themselves, the others for U+0100 onwards."""
        byte = byte_signs()
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode("utf-8")
        return out


class PieceTokens:
    """BPE with byte fallback of the sentencepiece library; it puts a blank before each text."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, row pointers)."""
        found = self.model.encode(texts, num_threads=1) if texts else []
        return np.fromiter(chain.from_iterable(found), np.int64), pointers([len(f) for f in found])

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id: U+2581 is a blank, <0xHH> the byte HH."""
        return [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode("utf-8")
                for i, p in enumerate(map(self.model.id_to_piece, range(self.model.get_piece_size())))]
