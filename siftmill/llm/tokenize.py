"""Exact, fast encoding of whole texts by a public tokenizer.

A text is cut at spaces (and line ends), where both supported pre-tokenizers
always start a new token, and punctuation is cut off a piece's end, where they
do so too. What remains is encoded once per task and remembered; a memory that
fills up keeps what was used again since it last did, so that a long task does not
start cold. Words of Latin letters are one pre-token and go straight to the
library's BPE model; everything else goes through the library's whole encoder.
Texts whose white space runs together or that hold a special token's string,
where such cuts would not be exact, are encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siftmill.llm.shared import hold

#: Distinct pieces that a worker remembers at most, between two blocks of texts.
MEMORY = 250_000
#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that are one code point in every normal form and have a plain lower case.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

_LOADED: dict[tuple, "PieceEncoder"] = {}


def encoder(path: str, keeps_space: bool) -> "PieceEncoder":
    """The worker's encoder for a tokenizer file, kept between tasks."""
    hold("tokenize", _LOADED.clear)
    if (path, keeps_space) not in _LOADED:
        _LOADED[path, keeps_space] = PieceEncoder(path, keeps_space)
    return _LOADED[path, keeps_space]


def byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: printable
    ones for themselves, the others in order from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


class PieceEncoder:
    """``keeps_space``: a token may begin with the space before it (byte-level
    BPE); otherwise the tokenizer drops white space and case."""

    def __init__(self, path: str, keeps_space: bool, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keeps_space, self.memory = keeps_space, memory
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self._forget()
        self.direct = self._agrees()

    def _agrees(self) -> bool:
        """Whether words of letters may go straight to the model: tried on words of all of them."""
        pool = [chr(c) for c in range(256) if _LETTERS.fullmatch(chr(c))]
        tried = ["".join(pool[k::step][:9]) for step in (1, 3, 7) for k in range(0, len(pool), 4)]
        tried += ["the", "Word", "élan", "STRASSE", "ünder", "ning"]
        leads = ["", " "] if self.keeps_space else [""]
        return all([t.id for t in self.model.tokenize(self._spelled(lead + w))] == self.tokenizer.encode(lead + w, add_special_tokens=False).ids for w in tried for lead in leads)

    def _spelled(self, word: str) -> str:
        """A word of letters as the model reads it."""
        if not self.keeps_space:
            word = word.lower()
        return word.encode().decode("latin-1").translate(self.letters)

    def _forget(self) -> None:
        # pieces at a line's start and pieces after a space go by separate numbers; 0 is no piece
        self.known: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)  # -1: encode the whole text
        self.again = np.zeros(1 << 16, bool)  # used after the block that taught it
        self.count = 1

    def rest(self) -> None:
        """At a task's end: an idle worker keeps the tokenizer, not the pieces."""
        self._forget()
        hold("tokenize", _LOADED.clear)

    def _tidy(self) -> None:
        """Keep what was used again since the memory was last full."""
        keep = np.flatnonzero(self.again[: self.count])
        keep = keep[keep > 0]
        if 4 * len(keep) > 3 * self.memory:
            keep = keep[:0]
        number = np.full(self.count, -1, np.int64)
        number[0], number[keep] = 0, np.arange(1, len(keep) + 1)
        known, ids, start, length = self.known, self.ids, self.start[keep], self.length[keep]
        self._forget()
        sizes = np.maximum(length, 0)
        self._grow(int(sizes.sum()), len(keep))
        here = slice(1, 1 + len(keep))
        self.start[here] = np.cumsum(sizes) - sizes
        self.length[here] = length
        self.used, self.count = int(sizes.sum()), 1 + len(keep)
        self.ids[: self.used] = ids[_spans(start, sizes)]
        for old, new in zip(known, self.known):
            new.update((p, int(number[k])) for p, k in old.items() if number[k] >= 0)

    def _grow(self, ids: int, pieces: int) -> None:
        while self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + pieces > len(self.start):
            self.start, self.length, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.again))

    def _learn(self, pieces: list[str], after_space: bool) -> None:
        known = self.known[after_space]
        lead = " " if after_space else ""
        mark, tokenize = self.letters[32] if after_space else "", self.model.tokenize
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            letters = [self.direct and _LETTERS.fullmatch(p) is not None for p in part]
            rest = iter([e.ids for e in self.tokenizer.encode_batch_fast([lead + p for p, plain in zip(part, letters) if not plain], add_special_tokens=False)])
            # ASCII letters stand for themselves
            got = [[t.id for t in tokenize(mark + p if p.isascii() else self._spelled(lead + p))] if plain else next(rest) for p, plain in zip(part, letters)]
            lens = np.fromiter(map(len, got), np.int64, len(got))
            odd = np.fromiter((not plain and self._odd(p) for p, plain in zip(part, letters)), bool, len(part))
            flat = np.fromiter(chain.from_iterable(got), np.uint32, lens.sum())
            self._grow(len(flat), len(part))
            here = slice(self.count, self.count + len(part))
            self.ids[self.used : self.used + len(flat)] = flat
            self.start[here] = self.used + np.cumsum(lens) - lens
            self.length[here] = np.where(odd, -1, lens)
            self.again[here] = False
            known.update(zip(part, range(self.count, self.count + len(part))))
            self.count += len(part)
            self.used += len(flat)

    def _odd(self, piece: str) -> bool:
        return self.keeps_space and piece != "\n" and (not piece or piece[0].isspace() or piece[-1].isspace())

    def _cut(self, words: pa.Array) -> tuple[pa.Array, pa.DictionaryArray | None]:
        """Pieces without the punctuation that ends them, and that punctuation: null
        where there is none or the piece is more than a word of letters."""
        cores = pc.utf8_rtrim(words, characters=PUNCTUATION)
        plain = pc.match_substring_regex(cores, f"^{_LETTERS.pattern}$")
        cores = pc.if_else(plain, cores if self.keeps_space else pc.utf8_lower(cores), words)
        tails = pc.replace_substring_regex(pc.if_else(plain, words, ""), f"^{_LETTERS.pattern}", "")
        tails = pc.if_else(pc.equal(tails, ""), pa.scalar(None, tails.type), tails).dictionary_encode()
        return cores, tails if len(tails.dictionary) else None

    def _numbers(self, pieces: pa.Array, after_space: bool) -> np.ndarray:
        """The numbers of distinct pieces, learnt where new."""
        get = self.known[after_space].get
        pieces = pieces.to_numpy(zero_copy_only=False).tolist()
        out = np.fromiter([get(p, -1) for p in pieces], np.int64, len(pieces))
        self.again[out[out >= 0]] = True
        new = np.flatnonzero(out < 0)
        out[new] = np.arange(self.count, self.count + len(new))
        self._learn([pieces[k] for k in new], after_space)
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in one array, ``end_id`` after each text, and where
        each text begins (one entry more than texts). Null is an empty text."""
        if self.count > self.memory:
            self._tidy()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n " if self.keeps_space else " "), " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = parts.flatten().dictionary_encode()
        idx, words = coded.indices.to_numpy(), coded.dictionary
        cores, tails = self._cut(words)
        head = np.full(len(idx), not self.keeps_space)
        if self.keeps_space and len(idx):
            line_end = pc.index(words, "\n").as_py()
            if line_end >= 0:
                ends = idx == line_end
                head[ends] = True
                head[1:] |= ends[:-1]
            head[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        # the distinct pieces of this block, first those at a line's start, with their ids
        slot = np.empty(len(idx), np.int32)
        front, back = [], []
        for after_space in (False, True):
            mask = head != after_space
            used = np.zeros(len(words), bool)
            used[idx[mask]] = True
            used = np.flatnonzero(used)
            place = np.empty(len(words), np.int32)
            place[used] = sum(map(len, front)) + np.arange(len(used))
            slot[mask] = place[idx[mask]]
            here = cores.take(pa.array(used)).dictionary_encode()
            front.append(self._numbers(here.dictionary, after_space)[here.indices.to_numpy()])
            back.append(used)
        back = np.concatenate(back)
        ended = np.zeros(len(words), np.int64)
        if tails is not None:
            ended = np.concatenate([self._numbers(tails.dictionary, False), [0]])[pc.fill_null(tails.indices, len(tails.dictionary)).to_numpy()]
        both = np.stack([np.concatenate(front), ended[back]], 1)
        lens = self.length[both]
        # texts that are encoded whole: by a piece that is odd, or by a special token's string
        special = np.zeros(n, bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        odd = np.concatenate([[0], np.cumsum((lens < 0).any(1)[slot])])[bounds]
        whole = np.flatnonzero(special | (np.diff(odd) > 0))
        lens = np.maximum(lens, 0)
        pieces = [self.ids[_spans(self.start[both].ravel(), lens.ravel())], np.array([end_id], np.uint32)]
        sizes = [*lens.sum(1).tolist(), 1, 0]
        end, empty = len(both), len(both) + 1
        # every text ends with a piece of its own, the end id
        order = np.full(len(slot) + n, end, np.int32)
        order[np.arange(len(slot)) + np.repeat(np.arange(n), np.diff(bounds))] = slot
        for i in whole:
            at = int(bounds[i] + i), int(bounds[i + 1] + i)
            order[at[0] : at[1]] = empty
            order[at[1]] = len(sizes)
            got = self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids
            pieces.append(np.array([*got, end_id], np.uint32))
            sizes.append(len(got) + 1)
        ids = np.concatenate(pieces)
        offsets = np.concatenate([[0], np.cumsum(sizes)]) * 4
        spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
        taken = spelled.take(pa.array(order))
        _, ends, data = taken.buffers()
        places = np.frombuffer(ends, np.int64, len(order) + 1) // 4
        starts = places[np.concatenate([[0], bounds[1:] + np.arange(1, n + 1)])]
        return np.frombuffer(data, np.uint32, starts[-1]) if starts[-1] else np.zeros(0, np.uint32), starts


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one after another."""
    end = np.cumsum(length)
    return np.repeat(start - (end - length), length) + np.arange(end[-1] if len(end) else 0)
