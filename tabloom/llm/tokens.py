"""Token ids of whole texts by a public tokenizer file, many texts at a time.

The tokenizer cuts a text at white space and between letters, digits and other signs, and encodes each cut by itself.
So equal cuts have equal ids: Arrow cuts the texts, each distinct cut is encoded once, and NumPy puts the ids together.
Texts with characters outside the plain set below, for which Arrow's and the tokenizer's classes might differ, are
encoded whole by the tokenizer.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tab, line ends, ASCII without the apostrophe (contractions) and Latin-1 letters.
PLAIN = r"^[\t\n\r -&(-~À-ÖØ-öø-ÿ]*$"
CUT = r"([^\sa-zß-öø-ÿ0-9]+|[0-9])"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """ids of texts; keeps the ids of at most `bound` cuts."""

    bound = 600_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts, self.used = [0], 0

    def _add(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self, cuts: list[str]) -> None:
        for lo in range(0, len(cuts), 500):
            part = cuts[lo : lo + 500]
            ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):  # each cut ends in one word end
                self.starts += (self.used + stops).tolist()
                self._add(ids)
            else:
                for c in part:
                    self._add(np.array(self.tok.encode(c, add_special_tokens=False).ids, np.uint32))
                    self.starts.append(self.used)
            for c in part:
                self.known[c] = len(self.known)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cuts = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), CUT, r" \1 "))
        offsets = np.asarray(cuts.offsets)
        coded = cuts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > self.bound:
            self._forget()
        self._learn([c for c in distinct if c and c not in self.known])
        starts = np.array(self.starts)
        word = np.array([self.known[c] if c else -1 for c in distinct], np.int64)[np.asarray(coded.indices)]
        begin = np.where(word < 0, 0, starts[word])
        size = np.where(word < 0, 0, starts[word + 1] - begin)
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)
        return self.flat[at], ends[offsets - offsets[0]]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        col = pa.array([t or "" for t in texts], pa.string())
        plain = np.asarray(pc.match_substring_regex(col, PLAIN))
        if any("|" in (t or "") for t in texts):
            plain &= ~np.array([any(s in (t or "") for s in self.special) for t in texts])
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        rows = np.flatnonzero(plain)
        if len(rows):
            ids, ends = self._plain(col.take(pa.array(rows)))
            for k, r in enumerate(rows):
                out[r] = ids[ends[k] : ends[k + 1]]
        for r in np.flatnonzero(~plain):
            out[r] = np.array(self.tok.encode(texts[r], add_special_tokens=False).ids, np.uint32)
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)
