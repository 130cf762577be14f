"""Token ids of whole texts, from the installed tokenizers library.

A text is cut at places where the tokenizer always starts a new pre-token, and each
distinct chunk is encoded once and kept. The ids are those of encoding the whole text
in one call; the tests compare both.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

from .spelling import U, code_points, random_bits, spelled, table_size

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Distinct chunks kept per worker. Once full the cache stays as it is: frequent chunks
#: come early, and others are then encoded again in each batch.
CACHE_CHUNKS = 600_000
#: Longer chunks are not kept.
LONG_CHUNK = 64

#: Behind a letter these start a pre-token of their own; an apostrophe may not.
MARKS = ".,;:!?#$%&*|()\"-"
#: One word of letters that no normalization joins or divides.
WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: Words that are encoded as one text and told apart by their first or last tokens.
WORDS_AT_ONCE = 2_000


def tokenizer_path(name: str) -> str:
    """Path of one of the public vocabularies of the machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer; the strings of special tokens are ordinary text in it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


@lru_cache(2)
def tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point under n, whether it is white space, and twice 64 bits."""
    numbers = np.arange(n, dtype=U)
    return np.array([chr(i).isspace() for i in range(n)]), random_bits(numbers), random_bits(numbers + U(1 << 32))


@lru_cache(1)
def marks_and_letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point under U+0250, whether it is one of MARKS and whether a plain letter; another is neither."""
    chars = [chr(i) for i in range(0x250)]
    mark, letter = np.array([c in MARKS for c in chars]), np.array([plain_letter(c) for c in chars])
    mark[-1] = letter[-1] = False
    return mark, letter


def spaced_cuts(codes: np.ndarray, space: np.ndarray, cuts: np.ndarray) -> None:
    """Marks where chunks for a byte-level tokenizer begin: a space belongs to the word behind it.

    A single space or line break between two other characters is always a boundary.
    """
    blank = np.ones(len(codes) + 2, bool)
    blank[1:-1] = space[codes]
    alone = np.flatnonzero(blank[1:-1] & ~blank[:-2] & ~blank[2:])
    cuts[alone[(codes[alone] == 32) | (codes[alone] == 10)]] = True
    cuts[alone[codes[alone] == 10] + 1] = True


def chunks_of(texts: list[str], codes: np.ndarray, space: np.ndarray, keeps_space: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the chunks of texts begin and end, and how many each text has.

    codes are those of all texts with a line break after each. Without keeps_space white space is dropped: chunks
    are what stands between spaces and line breaks. Marks at the end of a chunk that ends with a plain letter
    are a chunk of their own.
    """
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    if keeps_space:
        cuts = np.zeros(len(codes) + 1, bool)
        spaced_cuts(codes, space, cuts)
        cuts[0] = cuts[stops] = cuts[stops + 1] = True
        begins = np.flatnonzero(cuts)
        begins, ends = begins[:-1], begins[1:]
        inside = np.ones(len(codes), bool)
        inside[stops] = False
        kept = inside[begins]
        begins, ends = begins[kept], ends[kept]
    else:
        inside = np.zeros(len(codes) + 2, bool)
        inside[1:-1] = (codes != 32) & (codes != 10)
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = edges[::2], edges[1::2]
    mark, letter = marks_and_letters()
    last = np.flatnonzero(mark[np.minimum(codes[ends - 1], len(mark) - 1)])
    marked = np.zeros(len(codes) + 1, bool)
    marked[1:] = mark[np.minimum(codes, len(mark) - 1)]
    runs = np.flatnonzero(marked[1:] & ~marked[:-1])
    at = runs[np.searchsorted(runs, ends[last] - 1, "right") - 1] if len(last) else last
    good = at > begins[last]
    good &= letter[np.minimum(codes[np.maximum(at - 1, 0)], len(letter) - 1)]
    last, at = last[good], at[good]
    begins, ends = np.insert(begins, last + 1, at), np.insert(ends, last, at)
    return begins, ends, np.diff(np.searchsorted(begins, stops), prepend=0)


def plain_letter(char: str) -> bool:
    """A letter that no normalization turns into more than one character."""
    return char < "\u0250" and char.isalpha() and char != "\u0130"


class ChunkEncoder:
    """Encodes batches of texts to the bytes of their ids (unsigned 32 bits, little-endian)."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        with open(path, encoding="utf-8") as f:
            self.keeps_space = json.load(f)["pre_tokenizer"]["type"] == "ByteLevel"
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Tokens that a word with its space begins with, or that a word ends with.
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith("\u0120") if self.keeps_space else token.endswith("</w>")
        #: Of known chunks, 128 bits in ascending order of the first 64, and where their ids are.
        self.keys, self.checks = np.zeros(0, U), np.zeros(0, U)
        self.begins, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        texts = list(texts)
        if not texts:
            return []
        whole = "".join([t + "\n" for t in texts])
        codes = code_points(whole)
        space, bits, other_bits = tables(table_size(codes))
        begins, ends, counts = chunks_of(texts, codes, space, self.keeps_space)
        keys, first, chunks = np.unique(spelled(codes, bits, begins, ends), return_index=True, return_inverse=True)
        checks = spelled(codes, other_bits, begins, ends)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            near = np.minimum(at, len(self.keys) - 1)
            known = self.keys[near] == keys
        if (checks != checks[first][chunks]).any() or known.any() and (self.checks[at[known]] != checks[first[known]]).any():
            # two chunks with one key
            return [as_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        place, length = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        place[known], length[known] = self.begins[at[known]], self.lengths[at[known]]
        new = np.flatnonzero(~known)
        # those that stay come first
        stays = (ends - begins)[first[new]] <= LONG_CHUNK
        stays &= np.cumsum(stays) <= CACHE_CHUNKS - len(self.keys)
        new = new[np.argsort(~stays, kind="stable")]
        spans = zip(begins[first[new]].tolist(), ends[first[new]].tolist())
        fresh = [whole[a:b] for a, b in spans]
        found = self.encode_chunks(fresh)
        raw = [found[c] for c in fresh]
        ids = np.frombuffer(b"".join(raw), "<u4")
        length[new] = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        place[new] = self.used + np.cumsum(length[new]) - length[new]
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(self.used + 2 * len(ids), "<u4")])
        self.ids[self.used:self.used + len(ids)] = ids
        n = length[chunks]
        edges = np.concatenate([[0], np.cumsum(n)])
        places = np.repeat(place[chunks] - edges[:-1], n)
        places += np.arange(len(places))
        out = self.ids[places].tobytes()
        kept = new[:int(stays.sum())]
        self.used += int(length[kept].sum())
        self.keys, self.checks = np.insert(self.keys, at[kept], keys[kept]), np.insert(self.checks, at[kept], checks[first[kept]])
        self.begins, self.lengths = np.insert(self.begins, at[kept], place[kept]), np.insert(self.lengths, at[kept], length[kept])
        edges = (4 * edges[np.cumsum([0, *counts.tolist()])]).tolist()
        return [out[a:b] for a, b in zip(edges, edges[1:])]

    def encode_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Bytes of the ids of each chunk. Plain words are encoded many at a time."""
        at = int(self.keeps_space)
        words = [c for c in chunks if c[:at].isspace() == self.keeps_space and WORD.fullmatch(c, at)]
        groups = [words[i:i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        texts = [("" if self.keeps_space else " ").join(g) for g in groups]
        out: dict[str, bytes] = {}
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(encoded.ids, "<u4")
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) == len(group):  # else they are encoded one by one below
                cuts = [*(edges * 4).tolist(), len(ids) * 4] if self.keeps_space else [0, *((edges + 1) * 4).tolist()]
                raw = ids.tobytes()
                out.update((w, raw[a:b]) for w, a, b in zip(group, cuts, cuts[1:]))
        rest = [c for c in chunks if c not in out]
        for chunk, encoded in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            out[chunk] = as_bytes(encoded.ids)
        return out


def worker_encoder(path: str) -> ChunkEncoder:
    """The encoder of this worker process. Its cache serves all tasks that the process runs."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_chunk_encoders", {})
    if path not in kept:
        kept[path] = ChunkEncoder(path)
    return kept[path]


def encode_in_slices(encoder: ChunkEncoder, texts: list[str], chars: int = 1 << 20):
    """Ids of texts one by one, a bounded number of characters at a time."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars or i + 1 == len(texts):
            yield from encoder.encode(texts[begin:i + 1])
            begin, size = i + 1, 0
