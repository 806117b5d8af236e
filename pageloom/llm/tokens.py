"""Token ids of whole texts with a public tokenizer file, looked up run by run.

The tokenizer normalises a text, splits it into runs of letters, digits and symbols, drops white space, and
encodes each run by itself. So the ids of a text are those of its runs one after the other. Runs are looked
up in a bounded per-process table; only those not seen before are handed to the tokenizer. Texts that
hold its special tokens, or that its normal form would change once more, go to the tokenizer whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: how the tokenizer file named word_bpe_49k.json splits a normalised text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bounds of the table: bytes (an entry counts its text, its ids and what Python adds), and characters of a run kept.
TABLE_BYTES, LONGEST_RUN = 64 << 20, 64
_ENTRY = 170
_END = "</w>"


class RunIds:
    """``ids(text)``: little-endian unsigned 32-bit ids, without special tokens added."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.runs: dict[str, bytes] = {}
        self.room = TABLE_BYTES
        self.split = regex.compile(SPLIT).findall
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith(_END)

    def ids(self, text: str) -> bytes:
        normal = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if any(s in text for s in self.special) or not unicodedata.is_normalized("NFC", normal):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        runs = self.split(normal)
        found = list(map(self.runs.get, runs))
        if None in found:
            if self.room <= 0:
                self.runs, self.room = {}, TABLE_BYTES
            new = list({r for r, x in zip(runs, found) if x is None})
            own = dict(zip(new, self._encode(new)))
            kept = {r: ids for r, ids in own.items() if len(r) <= LONGEST_RUN}
            self.runs.update(kept)
            self.room -= sum(_ENTRY + len(r) + len(ids) for r, ids in kept.items())
            found = [own[r] if x is None else x for r, x in zip(runs, found)]
        return b"".join(found)

    def _encode(self, runs: list[str]) -> list[bytes]:
        """Ids of each run: all in one call, cut behind the tokens that end a word."""
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, "<u4")
        cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        if len(cuts) != len(runs) + 1:  # a run that is no word of its own
            each = self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)
            return [np.asarray(e.ids, "<u4").tobytes() for e in each]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def run_ids(path: str) -> RunIds:
    return RunIds(path)
