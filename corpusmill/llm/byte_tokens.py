"""Ids of whole texts with a byte-level tokenizer file, inside tasks."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

GENERATION = 800_000
# White space as Unicode has it, which the tokenizers split at.
WHITE = "\t-\r \x85\xa0  -     　"
# Runs that byte-level tokenizers never join across: what stands between white space with
# one space before it, and white space less the space that goes with the run behind it.
RUN = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
# Texts cut by these runs; others are cut at spaces and newlines alone.
ODD = "[ \n]{3}|[ \n]{2}\\z|[" + re.sub("[ \n]", "", "".join(re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001)))))) + "]"
SPACED = re.compile(f"[ \n][^{WHITE}]")
MARKS = ".,;:!?"
# Runs tokenised as one text.
TOGETHER = 1000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _marked(key: str) -> bool:
    """Whether the run ends in a mark behind a Latin letter or digit, a token run of its own."""
    before = key[-2:-1]
    return key[-1:] in MARKS and before < "\u0250" and before.isalnum()


def _key(run: str) -> str:
    return run[1:] if run[0] == " " and SPACED.match(run) else "\t" + run


def _run(key: str) -> str:
    """A key is a run less the space before it, a run with a newline before it, or a tab and
    a run as it stands.
    """
    return key[1:] if key[:1] == "\t" else key if key[:1] == "\n" else " " + key


class ByteSpelled:
    """Ids of the runs met so far. Runs not met for a generation are forgotten."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.odd = "|".join([ODD, *map(re.escape, self.special)])
        # A byte-level token has a character for each of its bytes.
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        self.widths = np.zeros(max(tokens.values(), default=0) + 1, np.int64)
        self.widths[list(tokens.values())] = [len(t) for t in tokens]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _spell(self, keys: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast([_run(k) for k in keys], add_special_tokens=False)
        for k, e in zip(keys, found):
            self.known[k] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _spell_together(self, keys: list[str]) -> None:
        """Runs that begin with a space or newline, as one text, whose ids are cut where the
        next run begins; run by run if a token should reach across or bytes have no token.
        """
        text = "".join(map(_run, keys))
        ids = np.array(self._whole(text), "<u4")
        if len(ids) == 0 or ids.max() >= len(self.widths):
            return self._spell(keys)
        token_ends = np.cumsum(self.widths[ids])
        data = np.frombuffer(text.encode(), "u1")
        run_ends = np.append(np.flatnonzero((data == 0x20) | (data == 0x0A))[1:], len(data))
        last = np.searchsorted(token_ends, run_ends)
        if token_ends[-1] != run_ends[-1] or (token_ends[last] != run_ends).any():
            return self._spell(keys)
        ends, packed = (4 * last + 4).tolist(), ids.tobytes()
        self.known.update(zip(keys, map(packed.__getitem__, map(slice, [0, *ends], ends))))

    def _look_up(self, met: list[str]) -> None:
        """Makes keys known that are not."""
        known, older = self.known, self.older
        again = [k for k in met if k in older]
        for k in again:
            known[k] = older[k]
        new = set(met).difference(again)
        marked = [k for k in new if k[-1:] in MARKS and _marked(k)]
        new.difference_update(marked)
        new.update({k[:-1] for k in marked}.union("\t" + k[-1] for k in marked).difference(known))
        spaced = [k for k in new if SPACED.match(_run(k))]
        for at in range(0, len(spaced), TOGETHER):
            self._spell_together(spaced[at:at + TOGETHER])
        self._spell(list(new.difference(spaced)))
        for k in marked:
            known[k] = known[k[:-1]] + known["\t" + k[-1]]

    def _joined(self, keys: pa.Array, ends: list[int]) -> Iterator[bytes]:
        """Ids of texts whose keys end at ``ends``; each distinct key is looked up once."""
        distinct = keys.dictionary_encode()
        names = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, names))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        self._look_up([names[k] for k in gaps])
        for k in gaps:
            found[k] = self.known[names[k]]
        spelled, at, start = np.array(found, object), distinct.indices.to_numpy(), 0
        for end in ends:
            yield b"".join(spelled[at[start:end]].tolist())
            start = end

    def _plain(self, texts: pa.Array) -> Iterator[bytes]:
        """Tokens never join across a space or newline with no white space behind it. Texts
        have no tab, so one stands before the first run, which has no space.
        """
        tab, between = pa.scalar("\t", texts.type), pa.scalar("", texts.type)
        cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(tab, texts, between), "\n", " \n"), " ")
        return self._joined(cut.values, cut.offsets.to_pylist()[1:])

    def _odd(self, texts: list[str]) -> Iterator[bytes]:
        cut = [None if any(s in t for s in self.special) else [_key(r) for r in RUN.findall(t)] for t in texts]
        keys = pa.array([k for c in cut for k in c or ()], pa.large_string())
        spelled = self._joined(keys, list(accumulate(len(c) for c in cut if c is not None)))
        for text, c in zip(texts, cut):
            yield np.array(self._whole(text), "<u4").tobytes() if c is None else next(spelled)

    def texts(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; new runs of all are looked up at
        once. Holds for byte-level tokenizers with the usual split pattern. A text that holds
        a special token's string goes to the tokenizer whole.
        """
        if len(self.known) > GENERATION:
            self.older, self.known = self.known, {}
        array = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        odd = pc.match_substring_regex(array, self.odd)
        plain, others = self._plain(array.filter(pc.invert(odd))), self._odd(array.filter(odd).to_pylist())
        for is_odd in odd.to_pylist():
            yield next(others) if is_odd else next(plain)


@lru_cache(2)
def byte_spelled(path: str) -> ByteSpelled:
    """One per worker process; Spark has a task for each core, so the tokenizer starts no
    threads of its own unless the environment asks for them.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteSpelled(path)
