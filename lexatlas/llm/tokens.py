"""Exact token ids of whole texts, with repeated pieces encoded once per worker.

Pre-tokens of the byte-level tokenizer never run from a character that is not
white space into white space, nor from a letter or digit into a stop or comma
or back. So a text may be cut there, and its ids are those of the pieces one
after another. Most pieces repeat; each worker keeps the ids of those it has met.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator, Sequence

from lexatlas.llm.common import worker_state

#: Pieces a worker remembers: two generations of half as many, the older of which is dropped when the newer is full.
REMEMBERED = 1_200_000
#: Bytes of text that are encoded in one call.
BATCH_BYTES = 1 << 20
#: Texts of these characters and no double white space fall into words, stops and line ends.
UNUSUAL = re.compile(r"[^A-Za-z0-9À-ÖØ-öø-ɏ .,\n]")
WORDS = re.compile(r" ?[^ \n.,]+| ?[.,]+|\n| \Z")
#: Runs of white space, white space before a blank, or characters whose class differs between Unicode
#: versions and libraries: such texts are cut by the slower rule or not at all.
IRREGULAR = re.compile(r"\s |[\x1c-\x1f\x85\u180e\u200b\ufeff]")
DOUBTFUL = re.compile(r"[\x1c-\x1f\x85\u180e\u200b\ufeff]")
PIECES = re.compile(r"\s*\S+|\s+")


def pack(ids: list[int]) -> bytes:
    """Unsigned 32-bit ids in little-endian order."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class TokenIds:
    """Little-endian unsigned 32-bit ids per text, as bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, texts: list[list[str]]) -> None:
        """Make sure that the pieces of ``texts`` are known."""
        if len(self.known) > self.remembered // 2:
            self.known, self.older = {}, self.known
        missing = set().union(*(set(pieces).difference(self.known) for pieces in texts))
        kept = {piece: self.older[piece] for piece in missing if piece in self.older}
        self.known.update(kept)
        new = list(missing.difference(kept))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update(zip(part, [pack(piece.ids) for piece in found], strict=True))

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Consecutive pieces of a text that can be encoded apart."""
        if not UNUSUAL.search(text) and not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text):
            return WORDS.findall(text)
        if not IRREGULAR.search(text):
            first, *rest = text.split(" ")
            return ([first] if first else []) + [" " + piece for piece in rest]
        return [text] if DOUBTFUL.search(text) else PIECES.findall(text)

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        """Ids of each text, in order; texts are taken together up to a bound of bytes."""
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= BATCH_BYTES):
                size += len(texts[stop])
                stop += 1
            cut = [self.pieces(text) for text in texts[start:stop]]
            self._learn(cut)
            for pieces in cut:
                yield b"".join(map(self.known.__getitem__, pieces))
            start = stop


def loaded(path: str) -> TokenIds:
    """The worker's tokenizer with what it remembers, kept between batches and tasks."""
    kept = worker_state()
    if path not in kept:
        kept[path] = TokenIds(path)
    return kept[path]
