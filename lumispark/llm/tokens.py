"""Token ids of whole texts with a public tokenizer, a distinct word at a time where the tokenizer allows it.

A tokenizer that drops white space and never joins what white space parts gives a text the ids of its words, one after the
other. Words repeat: Arrow cuts texts into words and tells them apart, and each distinct word is encoded once in a worker.
A tokenizer of another kind encodes whole texts.
"""

from __future__ import annotations

import json
import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumispark.llm.common import split_words

#: Distinct words that a worker remembers. Beyond it starts anew: time, not results, depends on it.
REMEMBER = 200_000
#: Pieces that are encoded at once: the tokenizer's own objects are far larger than ids.
LEARN = 1 << 14
#: Words of Latin letters (to U+00FF) alone.
SIMPLE = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+$"


def by_words(tokenizer) -> bool:
    """Whether a tokenizer's ids of a text are surely those of its words: white space becomes single blanks, pieces are what
    a pattern without blanks finds, and every piece is encoded apart, with a mark at its end. Anything else counts as no."""
    parts = json.loads(tokenizer.to_str())
    listed = lambda x, names: (x or {}).get(names) or ([x] if x else [])
    kinds = [(x["type"], x) for x in listed(parts["normalizer"], "normalizers")]
    cutters = listed(parts["pre_tokenizer"], "pretokenizers")
    return (
        [k for k, _ in kinds] == ["NFC", "Replace", "Lowercase"]
        and (kinds[1][1]["pattern"], kinds[1][1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [x["type"] for x in cutters] == ["Split", "ByteLevel"]
        and cutters[0]["behavior"] == "Removed"
        and cutters[0]["invert"]
        and cutters[0]["pattern"]["Regex"].endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and not cutters[1]["add_prefix_space"]
        and not cutters[1]["use_regex"]
        and bool(parts["model"].get("end_of_word_suffix"))
        and not any(" " in x["content"] for x in parts["added_tokens"])
    )


class WordEncoder:
    """ids of texts; ``encode`` takes any number of texts and gives their ids end to end, and the number of ids of each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = by_words(self.tokenizer)
        # bytes as the byte-level vocabulary writes them: printable ones as they are, the others from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = dict(zip(sorted({*range(256)} - {*plain}), range(256, 512), strict=False))
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.pool = np.empty(1 << 16, dtype=np.uint32)
        self.used = 0
        self.start = np.empty(1 << 14, dtype=np.int64)
        self.size = np.empty(1 << 14, dtype=np.int64)

    def _learn(self, pieces: list[str], simple: list[bool]) -> None:
        """Remember the ids of new pieces; a simple one is what the model itself is given for it."""
        model, letters = self.tokenizer.model.tokenize, self.letters
        others = iter(self.tokenizer.encode_batch_fast([p for p, s in zip(pieces, simple, strict=True) if not s], add_special_tokens=False))
        made = []
        for p, s in zip(pieces, simple, strict=True):
            if not s:
                made.append(next(others).ids)
            elif p.isascii():
                made.append([t.id for t in model(p)])
            else:
                made.append([t.id for t in model(p.encode("utf-8").decode("latin-1").translate(letters))])
        n, m = len(self.place), len(pieces)
        self.place.update(zip(pieces, range(n, n + m), strict=True))
        if n + m > len(self.start):
            grown = max(2 * len(self.start), n + m)
            self.start, self.size = (np.resize(x, grown) for x in (self.start, self.size))
        self.size[n : n + m] = sizes = np.fromiter(map(len, made), dtype=np.int64, count=m)
        ends = self.used + np.cumsum(sizes)
        self.start[n : n + m] = ends - sizes
        if ends[-1] > len(self.pool):
            self.pool = np.resize(self.pool, max(2 * len(self.pool), int(ends[-1])))
        self.pool[self.used : ends[-1]] = np.fromiter(chain.from_iterable(made), dtype=np.uint32, count=int(sizes.sum()))
        self.used = int(ends[-1])

    def _places(self, pieces: pa.Array, simple: np.ndarray) -> np.ndarray:
        """Where the ids of each piece are; new ones are learnt."""
        coded = pieces.dictionary_encode()
        at, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.place.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        new = np.flatnonzero(known < 0)
        if len(new):
            is_simple = np.zeros(len(names), dtype=bool)
            is_simple[at] = simple  # the same piece is simple wherever it stands
            for at_once in np.split(new, range(LEARN, len(new), LEARN)):
                self._learn([names[i] for i in at_once.tolist()], is_simple[at_once].tolist())
            known[new] = np.arange(len(self.place) - len(new), len(self.place))
        return known[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Latin letters followed by points and commas are two pieces: the tokenizer separates letters from marks and lowers
        the case. Any other word is one piece."""
        if not self.by_words:
            found = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            counts = np.array([len(e.ids) for e in found], dtype=np.int64)
            return np.fromiter((i for e in found for i in e.ids), dtype=np.uint32, count=int(counts.sum())), counts
        if len(self.place) > REMEMBER:
            self._forget()
        names, at, counts = split_words(texts)
        base = pc.utf8_rtrim(names, characters=".,")
        simple = pc.match_substring_regex(base, SIMPLE)
        tails = pc.if_else(simple, pc.replace_substring_regex(names, r"^.*[^.,]", ""), "")
        base = pc.if_else(simple, pc.utf8_lower(base), names)
        simple = simple.to_numpy(zero_copy_only=False)
        both = np.stack((self._places(base, simple), self._places(tails, np.zeros(len(names), dtype=bool))), axis=1)
        own = both[at].ravel()
        size = self.size[own]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.start[own] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        total = np.concatenate(([0], ends[1::2]))
        edge = np.concatenate(([0], np.cumsum(counts)))
        return ids, total[edge[1:]] - total[edge[:-1]]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each file in a worker; it stays for the worker's later tasks, its words until ``forget``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Empty the encoders' words: a task learns most of its words anew anyway, and an idle worker would only hold them."""
    for enc in _ENCODERS.values():
        enc._forget()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
