"""Token ids of whole texts with a public tokenizer file, inside tasks."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

from tokenizers import Tokenizer

GENERATION = 800_000
# A single mark behind an ASCII letter or digit is a token run of its own.
MARKED = re.compile(rb".*[a-z0-9][.,;:!?]", re.DOTALL)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Spelled:
    """Ids of the words met so far, as bytes. Words not met for a generation are forgotten."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text of a list, whose new words are
        looked up at once.

        Holds for tokenizers that ignore case and never join characters across ASCII
        white space, nor letters with marks. ASCII letters are lower-cased before, but in
        texts that may hold special tokens.
        """
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        split = [(r if b"<|" in r else r.lower()).split() for r in raw]
        if len(self.known) > GENERATION:
            self.older, self.known = self.known, {}
        met = set().union(*split).difference(self.known)
        again = met.intersection(self.older)
        self.known.update((w, self.older[w]) for w in again)
        new = met - again
        marked = [w for w in new if MARKED.fullmatch(w) and b"<|" not in w]
        whole = list((new.difference(marked) | {w[:-1] for w in marked} | {w[-1:] for w in marked}).difference(self.known))
        found = self.tokenizer.encode_batch_fast([w.decode() for w in whole], add_special_tokens=False)
        self.known.update((w, struct.pack(f"<{len(e.ids)}I", *e.ids)) for w, e in zip(whole, found))
        self.known.update((w, self.known[w[:-1]] + self.known[w[-1:]]) for w in marked)
        known = self.known
        for words in split:
            yield b"".join([known[w] for w in words])


@lru_cache(2)
def spelled(path: str) -> Spelled:
    """One per worker process, which serves many tasks. Spark has a task for each core, so
    the tokenizer starts no threads of its own, unless the environment asks for them.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Spelled(path)
