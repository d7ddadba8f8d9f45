"""Token counts of whole texts by overlap resynchronisation.

A text over CHUNK characters is encoded in overlapping chunks with offsets, and two neighbours are spliced in their
overlap at a place that is proven stable and a token boundary in both. Where a letter or digit meets a space,
it is stable: a byte-level vocabulary's pre-tokens never cross such a place, what is left of it does not depend on
what follows and the other way round, and no special string has white space in it. In a run of letters without
spaces a place is stable if both encodings end the same tokens there and those, before the first ones of what
follows, are what the library makes of the two together: a sequence of merged tokens is the library's exactly if
every two neighbours are. If an overlap has no such place, it is widened, to the end of the text at last. So counts
equal those of the whole text, and one chunk is held at a time.

Shorter texts fall apart at places of the first kind, and where a letter or digit of ASCII meets a mark that is in
no special string, or such a mark a space. Of these units (mostly words) a worker remembers the counts, up to UNITS.

Defined cases: null and empty texts have 0 tokens; special strings inside a text are single tokens, as the
library's default has it; repeated rows come back each; empty tables give none; extra columns are ignored.
Vocabularies that are not byte-level, or normalise, are counted text by text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame

from refrain.llm.common import by_pandas, only

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
CHUNK = 1 << 14
OVERLAP = 256
#: Texts that are counted at once, and units whose counts a worker remembers.
TEXTS = 64
UNITS = 1 << 20
#: Characters of the longest unit that is remembered.
LONGEST = 64
#: Splices inside a run of letters that are tried before the overlap is widened.
TRIES = 4

_MEET = re.compile(r"(?<=\w)(?= )")
_UNITS = re.compile(r"(?<=\w)(?= )|(?<=[A-Za-z0-9])(?=[,.;:!?)\"'])|(?<=[,.;:!?)])(?= )")
#: Letters of long standing, which every version of the character tables has: Latin, Greek, Cyrillic, Thai, kana, Han and Hangul.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-яก-ะぁ-ゖァ-ヺ一-龥가-힣]+")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The library's encoder of a vocabulary file, once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def vocabulary_path(name_or_path: str) -> str:
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def _encode(t, text: str):
    return t.encode(text, add_special_tokens=False)


def _groups(e) -> list[tuple[int, int, tuple[int, ...]]]:
    """(from, to, ids) of the tokens between neighbouring places that lie between characters: a rare character has several."""
    o, ids = e.offsets, e.ids
    at = [0, *(i for i in range(1, len(o)) if o[i - 1][1] <= o[i][0]), len(o)]
    return [(o[a][0], o[b - 1][1], tuple(ids[a:b])) for a, b in zip(at, at[1:], strict=False) if b > a]


def _inside(text: str, at: int, middle: int, left, right) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """(place, start and ids of the group before it) inside a run of letters, where both encodings end the same group."""
    # The run must hold the second chunk's start, so that both see the same run from there; contractions have apostrophes.
    if "'" in text[max(0, middle - 4) : middle + 1] or not _LETTERS.fullmatch(text, max(0, middle - 1), middle + 1):
        return
    end = _LETTERS.match(text, middle).end()
    seen = {(b + middle, ids) for _, b, ids in _groups(right)[:-1]}
    for a, b, ids in _groups(left)[:-1]:
        if middle < a + at and b + at < end and (b + at, ids) in seen:
            yield b + at, a + at, ids


def _agree(t, text: str, start: int, place: int, before: tuple[int, ...], after) -> bool:
    """Is the group from ``start`` to ``place`` before the first of what follows as the library has the two?"""
    _, end, ids = _groups(after)[0]
    return tuple(_encode(t, text[start : place + end]).ids) == before + ids


def least_overlap(t) -> int:
    """An overlap that holds any special string whole, so that none is taken for a run of letters where a chunk begins."""
    return 1 + max((len(x.content) for x in t.get_added_tokens_decoder().values()), default=0)


def count_long(t, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, letters: bool = True) -> int:
    """Tokens of one text, chunk by chunk; overlaps under the default are raised to ``least_overlap``."""
    total, at, n = 0, 0, len(text)
    if overlap < OVERLAP:
        overlap = max(overlap, least_overlap(t))
    chunk, ready, joint = max(chunk, 1), None, None
    while at < n:
        width = overlap
        while True:
            middle, stop = at + chunk, at + chunk + width
            left = ready or _encode(t, text[at:stop])
            if joint and not ready and not _agree(t, text, *joint, left):
                return len(_encode(t, text).ids)  # a wider chunk begins otherwise than the one the splice was proven with
            if stop >= n:
                return total + len(left.ids)
            ready, cut, found = None, None, None
            right = _encode(t, text[middle:stop])
            ours, theirs = {a + at for a, _ in left.offsets}, {a + middle for a, _ in right.offsets}
            # The overlap's last character is left out: what follows it is not in the chunk.
            cut = next((m.start() for m in _MEET.finditer(text, middle, stop - 1) if m.start() in ours and m.start() in theirs), None)
            if cut is None and letters:
                for place, start, ids in islice(_inside(text, at, middle, left, right), TRIES):
                    after = _encode(t, text[place : place + chunk + overlap])
                    if _agree(t, text, start, place, ids, after):
                        cut, ready, found = place, after, (start, place, ids)
                        break
            if cut is not None:
                break
            width *= 2
        total += sum(a + at < cut for a, _ in left.offsets)
        at, joint = cut, found
    return total


def _plain(t) -> bool:
    """Do pre-tokens end where words do? So for a byte-level vocabulary without normaliser, whose special strings have no white space and begin with no letter."""
    made = json.loads(t.to_str())
    own = made["pre_tokenizer"] or {}
    special = all(not re.search(r"[\s,.;:!?)\"']", x["content"]) and not _LETTERS.match(x["content"]) and not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in made["added_tokens"])
    return own.get("type") == "ByteLevel" and own.get("use_regex", True) and not own.get("add_prefix_space") and made["normalizer"] is None and special and not made["model"].get("dropout")


class Counter:
    """Counts of texts, with the units that a worker remembers."""

    def __init__(self, t):
        self.t, self.plain, self.known = t, _plain(t), {}
        self.overlap = max(OVERLAP, least_overlap(t))

    def counts(self, texts: list[str]) -> list[int]:
        if not self.plain:
            return [len(e.ids) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]
        out = [0] * len(texts)
        for k in range(0, len(texts), TEXTS):
            own = [_UNITS.split(x) if len(x) <= CHUNK else () for x in texts[k : k + TEXTS]]
            if len(self.known) > UNITS:
                self.known.clear()
            known = self.known
            new = list({u for units in own for u in units if u not in known})
            known.update(zip(new, map(len, self.t.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            for i, units in enumerate(own, k):
                out[i] = sum(map(known.__getitem__, units)) if len(texts[i]) <= CHUNK else count_long(self.t, texts[i], overlap=self.overlap)
            for u in new:
                if len(u) > LONGEST:
                    del known[u]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(tokenizer(path))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per document."""
    path = vocabulary_path(vocabulary)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for b in batches:
            texts = [x or "" for x in b["text"]]
            counts = c.counts(texts)
            size = [len(x.encode()) for x in texts]
            yield pd.DataFrame(
                {"doc_id": b["doc_id"], "n_bytes": size, "n_tokens": counts, "over_limit": [n > limit for n in counts]}
            )

    return by_pandas(only(docs, doc_id="long", text="string"), counted, "n_bytes long, n_tokens long, over_limit boolean")
