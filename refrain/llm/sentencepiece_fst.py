"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (rules as a trie: the model's character map, white
space to its mark; states for the start, where a mark may come in front, and for white space that is squeezed), the
pieces (an automaton whose arcs are piece ids) and byte fallback (a character that is no piece goes to its bytes). A
text is composed with them, place by place, and the shortest path in the tropical semiring gives the ids. For
unigram models an arc weighs the negative score. For BPE models scores are merge ranks, not weights, so a pair
acceptor is composed as well: it lets a piece follow another only if merging their joined text gives back just
these two, and weighs all else as infinite. Merging is a function of a text, so one path at most is finite up to
any place, and the shortest path is the one that merging makes.

Where two neighbouring characters stand together in no piece, no arc crosses, so a text falls apart there and
each part is a problem of its own; common parts are remembered, up to a bound. White space is such a place,
and in scripts without spaces most places are. A normaliser whose only rule is that of white space, without
squeezing, has one state behind the start, so such parts are composed with it as they stand in the text.

Models with marks as suffixes, unescaped white space or symbols of a user's own are refused. Defined cases: null and
empty texts have no ids; repeated rows come back each; empty tables give none; extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain, compress, pairwise
from operator import add, itemgetter, not_

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from refrain.llm.common import by_pandas, only
from refrain.llm.token_counts import vocabulary_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words remembered by a worker.
WORDS = 400_000
#: Characters of the longest word remembered.
LONGEST = 64
#: Pairs of pieces whose acceptance is remembered by a worker.
PAIRS = 1_000_000
#: Units whose paths are found at once, and characters of texts that are encoded at once, about.
AT_ONCE, CHARACTERS = 1 << 14, 1 << 20
#: Ids of an output batch, about.
BATCH_IDS = 1 << 20

_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
INFINITE = float("inf")


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array trie over bytes, then the texts that its values point at."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    rules, labels = {}, np.arange(1, 256)

    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    open_ = [(b"", 0)]
    while open_:
        key, at = open_.pop()
        base = at ^ offset(int(units[at]))
        if key and units[at] >> 8 & 1:
            value = int(units[base]) & 0x7FFFFFFF
            rules[key.decode()] = texts[value : texts.index(0, value)].decode()
        to = base ^ labels
        inside = to < len(units)
        for c in labels[inside][(units[to[inside]] & 0x800000FF) == labels[inside]].tolist():
            open_.append((key + bytes([c]), base ^ c))
    return rules


class Normaliser:
    """The compiled rules of a model's normaliser; longest rules first, other characters as they are."""

    def __init__(self, spec):
        own = character_map(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        #: Is what a part goes to the same wherever it stands behind the start?
        self.local = not own and not self.squeeze
        self.rules = _trie(own)

    def _read(self, text: str) -> Iterator[str]:
        """Outputs of rules and characters; a machine without states and rules reads a text as one."""
        if self.local:
            yield text
            return
        at = 0
        while at < len(text):
            node, k, end, out = self.rules, at, at + 1, text[at]
            while k < len(text) and (node := node.get(text[k])) is not None:
                k += 1
                if None in node:
                    end, out = k, node[None]
            yield out
            at = end

    def run(self, text: str, begun: bool = False) -> str:
        """What the machine puts out from its start, or from the state behind it."""
        out, space = [], self.squeeze
        for s in self._read(text):
            if space:
                s = s.lstrip(" ")
            if s or not self.squeeze:
                if self.prefix and not begun:
                    out.append(MARK)
                begun = True
                out.append(s.replace(" ", MARK))
                space = self.squeeze and s.endswith(" ")
        made = "".join(out)
        return made.rstrip(MARK) if self.squeeze else made


def _trie(ends: dict) -> dict:
    root: dict = {}
    for key, value in ends.items():
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[None] = value
    return root


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        kind = pb.ModelProto.SentencePiece
        own = any(p.type == kind.USER_DEFINED for p in m.pieces)
        if m.trainer_spec.treat_whitespace_as_suffix or not m.normalizer_spec.escape_whitespaces or own:
            raise ValueError("models with marks as suffixes, unescaped white space or symbols of their own are not supported")
        self.normaliser = Normaliser(m.normalizer_spec)
        self.prefix = self.normaliser.prefix
        self.text = [p.piece for p in m.pieces]
        self.byte = {i: int(p.piece[1:-1], 16) for i, p in enumerate(m.pieces) if p.type == kind.BYTE}
        self.of_byte = {b: i for i, b in self.byte.items()}
        self.hidden = {i for i, p in enumerate(m.pieces) if p.type in (kind.CONTROL,)}
        self.unknown = next((i for i, p in enumerate(m.pieces) if p.type == kind.UNKNOWN), 0)
        self.unknown_text = m.trainer_spec.unk_surface
        #: What an id says by itself: a byte below 128 is its character, whatever stands beside it. The other bytes are apart.
        self.said = [chr(self.byte[i]) if self.byte.get(i, 128) < 128 else p for i, p in enumerate(self.text)]
        self.apart = {*(i for i, b in self.byte.items() if b >= 128), *self.hidden, self.unknown}
        self.pieces = {p.piece: i for i, p in enumerate(m.pieces) if p.type == kind.NORMAL}
        self.weight = {p: -m.pieces[i].score for p, i in self.pieces.items()}
        self.bpe = m.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.joined = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.by_words = not any(pair[0] != MARK and pair[1] == MARK for pair in self.joined)
        #: What a character that is no piece weighs: ten more than any piece.
        self.heavy = max((-p.score for p in m.pieces), default=0.0) + 10.0
        #: Ids of units and parts, 4 bytes each.
        self.words: dict[str, bytes] = {}
        #: How many verdicts of the acceptor are remembered; arcs of characters that are no piece.
        self.verdicts, self.bare = 0, {}
        self.sides: dict[str, tuple | None] = {}
        self.single = {p for p in self.pieces if len(p) == 1}
        self.machine = ahocorasick.Automaton()
        #: Arcs: what is read, its length, piece (none for byte fallback), weight, verdicts on the arcs behind it by what they read.
        self.arcs = [(p, len(p), i, self.weight[p], {}) for p, i in self.pieces.items()]
        for arc in self.arcs:
            self.machine.add_word(arc[0], arc)
        self.machine.make_automaton()
        self.start = ("", 0, None, 0.0, {})
        #: A character that no piece holds.
        letters = set().union(*self.pieces)
        self.gap = next((c for c in map(chr, (0, 1, 0xE000, 0x10FFFD)) if c not in letters), None)

    def _merged(self, text: str, upto: int = 1) -> list[str]:
        """Merging pairs, best score first and leftmost of equals, until ``upto`` parts are left."""
        parts, weight = list(text), self.weight.get
        pairs = [weight(a + b, INFINITE) for a, b in pairwise(parts)]
        while len(parts) > upto and (least := min(pairs)) < INFINITE:
            k = pairs.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = weight(parts[k - 1] + parts[k], INFINITE)
            if k < len(pairs):
                pairs[k] = weight(parts[k] + parts[k + 1], INFINITE)
        return parts

    def _sides(self, piece: str) -> tuple[list, list] | None:
        """What stands at a piece's right and left end while it is merged, each with the times it is there; None if merging does not make it.

        All pairs up to a score are merged before the next score's, so a time is the worst score of the merges so far.
        """
        if piece in self.sides:
            return self.sides[piece]
        out = None
        if len(piece) == 1:
            out = [(piece, -INFINITE, INFINITE)], [(piece, -INFINITE, INFINITE)]
        elif self._merged(piece) == [piece]:
            a, b = self._merged(piece, 2)
            (right, own), (begun, left) = self._sides(b), self._sides(a)
            made = max(self.weight[piece], own[-1][1], begun[-1][1])
            whole = (piece, made, INFINITE)
            out = tuple([*side[:-1], (*side[-1][:2], made), whole] for side in (right, left))
        self.sides[piece] = out
        return out

    def _follows(self, a: str, b: str) -> bool:
        """Does the acceptor let b stand behind a, or at the start if a is empty?"""
        behind, before = self._sides(b), self._sides(a) if a else ([], [])
        if behind is None or before is None:
            return False
        i, j, weight = 0, 0, self.weight.get
        # Either side is merged by itself, unless what stands at the border joins sooner.
        while a:
            (x, since, p), (y, begun, q) = before[0][i], behind[1][j]
            t = max(weight(x + y, INFINITE), since, begun)
            if t < p and t < q:
                return False
            if p == q == INFINITE:
                return True
            if p == q or t < INFINITE and (t == p or t == q):
                # Merges of one time: which comes first decides.
                return self._merged(a + b) == [a, b]
            if p < q:
                i += 1
            else:
                j += 1
        return True

    def _judged(self, before: tuple, arc: tuple) -> bool:
        """A verdict of the acceptor, to be remembered."""
        if self.verdicts >= PAIRS:
            for known in (self.start, *self.arcs):
                known[4].clear()
            self.bare.clear()
            self.sides.clear()
            self.verdicts = 0
        self.verdicts += 1
        found = before[4][arc[0]] = self._follows(before[0], arc[0])
        return found

    def _fallback(self, char: str) -> tuple:
        arc = self.bare.get(char)
        if arc is None:
            arc = self.bare[char] = (char, 1, None, self.heavy, {})
        return arc

    def _arcs(self, text: str) -> Iterable[tuple[int, tuple]]:
        """(last place, arc) of the arcs of pieces and byte fallback, by place, longest first."""
        arcs = self.machine.iter(text)
        if self.single.issuperset(text):
            return arcs
        return sorted([*arcs, *((k, self._fallback(c)) for k, c in enumerate(text) if c not in self.single)], key=itemgetter(0))

    def _bytes(self, char: str) -> tuple[int, ...]:
        raw = char.encode("utf-8", "surrogatepass")
        return tuple(self.of_byte[b] for b in raw) if self.of_byte else (self.unknown,)

    def _paths(self, texts: list[str], arcs: Iterable[tuple[int, tuple]], gap: int = 0) -> list[bytes]:
        """The ids of each text's shortest path, 4 bytes each. arcs: those of all texts in a row, with ``gap`` places between, which no arc reads."""
        ends = list(accumulate(map(len, texts), lambda at, n: at + gap + n))
        #: By the last character read; the place before the first text is the list's last.
        best: list[tuple | None] = [None] * (ends[-1] + 1)
        for end, text in zip(ends, texts, strict=True):
            best[end - len(text) - 1] = self.start
        if self.bpe:
            # A place has one accepted path at most, so once it is reached all other arcs to it weigh infinitely much.
            for end, arc in arcs:
                if best[end] is None and (before := best[end - arc[1]]) is not None:
                    accepted = before[4].get(arc[0])
                    if accepted or accepted is None and self._judged(before, arc):
                        best[end] = arc
        else:
            cost = [INFINITE if arc is None else 0.0 for arc in best]
            for end, arc in arcs:
                total = cost[end - arc[1]] + arc[3]
                if total < cost[end]:
                    cost[end], best[end] = total, arc
        paths = []
        for at in ends:
            at, out = at - 1, []
            while size := (arc := best[at])[1]:
                if arc[2] is None:
                    out += self._bytes(arc[0])[::-1]
                else:
                    out.append(arc[2])
                at -= size
            out.reverse()
            paths.append(array("i", out).tobytes())
        return paths

    def shortest(self, text: str) -> bytes:
        """The ids of the shortest path over places, all arcs relaxed."""
        return self._paths([text], self._arcs(text))[0]

    def _learn(self, units: list[str]) -> None:
        """Remember the ids of units: new parts of many units are composed and relaxed at once, where their characters are pieces.

        Units stand in a row with gaps between, and are cut where no piece joins two neighbours, so beside gaps too.
        """
        row = self.gap.join(units)
        cuts = compress(range(1, len(row)), map(not_, map(self.joined.__contains__, map(add, row, row[1:]))))
        parts = [row[a:b] for a, b in pairwise([0, *cuts, len(row)])]
        known, single = self.words, self.single
        new = []
        for p in set(parts).difference(known, (self.gap,)):
            if single.issuperset(p):
                new.append(p)
            else:
                known[p] = self.shortest(p)
        for at in range(0, len(new), AT_ONCE):
            some = new[at : at + AT_ONCE]
            known.update(zip(some, self._paths(some, self.machine.iter(self.gap.join(some)), 1), strict=True))
        each, ids = iter(units), b""
        for p in parts:
            if p == self.gap:
                known[next(each)], ids = ids, b""
            else:
                ids += known[p]
        known[next(each)] = ids

    def _known(self, part: str) -> bytes:
        """The ids of a part, remembered if it is short and there is room."""
        ids = self.words.get(part)
        if ids is None:
            ids = self.shortest(part)
            if len(part) <= LONGEST and len(self.words) < WORDS:
                self.words[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Cut where no piece joins two neighbours."""
        cuts = compress(range(1, len(word)), map(not_, map(self.joined.__contains__, map(add, word, word[1:]))))
        return b"".join(self._known(word[a:b]) for a, b in pairwise([0, *cuts, len(word)]))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of several texts; the units that they have in common are met once."""
        texts = [self.normaliser.run(t) if t else "" for t in texts]
        cut = [_WORD.findall(t) if self.by_words else [t] * bool(t) for t in texts]
        met = set(chain.from_iterable(cut))
        if len(self.words) + len(met) > WORDS:
            # What these texts need stays.
            self.words = {u: self.words[u] for u in met if u in self.words}
        new = met.difference(self.words)
        if self.gap is not None and (short := [u for u in new if len(u) <= LONGEST and self.gap not in u]):
            self._learn(short)
            new.difference_update(short)
        self.words.update({u: self._word(u) for u in new})
        out = [np.frombuffer(b"".join(map(self.words.__getitem__, c)), np.int32) for c in cut]
        for u in new:
            if len(u) > LONGEST:
                del self.words[u]
        return out

    def decode(self, ids: list[int]) -> str:
        if self.apart.isdisjoint(ids):
            text = "".join(map(self.said.__getitem__, ids))
        else:
            text = self._decode(ids)
        text = text.replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _decode(self, ids: list[int]) -> str:
        """Ids of which some are bytes, without a text or unknown."""
        parts: list[str] = []
        raw = bytearray()
        for i in ids:
            b = self.byte.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i not in self.hidden:
                parts.append(self.unknown_text if i == self.unknown else self.text[i])
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        return "".join(parts)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids (array of int), round_trip (decoding gives the text back): one row per document."""
    path = vocabulary_path(model)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(path)
        for b in batches:
            texts = [text or "" for text in b["text"]]
            upto = np.cumsum([len(text) + 1 for text in texts]) // CHARACTERS
            edges = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(texts)]
            rows, size = [], 0
            for start, end in pairwise(edges):
                for doc_id, text, ids in zip(b["doc_id"].iloc[start:end], texts[start:end], t.encode_all(texts[start:end]), strict=True):
                    rows.append((doc_id, len(ids), ids, t.decode(ids.tolist()) == text))
                    size += len(ids) + 1
                    if size > BATCH_IDS:
                        yield pd.DataFrame(rows, columns=["doc_id", "n_ids", "ids", "round_trip"])
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "n_ids", "ids", "round_trip"])

    return by_pandas(only(docs, doc_id="long", text="string"), each, "n_ids long, ids array<int>, round_trip boolean")
