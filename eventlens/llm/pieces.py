"""SentencePiece BPE encoding in vectorised merge rounds, and decoding.

All words of a batch lie one after another in flat numpy arrays of symbols. A word is a stretch of symbols that a merge can
still cross: two neighbours whose strings, put together, occur in no piece are never merged, whatever happens around them.
Each round finds the smallest pair rank of every word (a segmented minimum), merges its occurrences from the left, all at
once, and compacts the arrays; words without a ranked pair leave. The rounds end when no word is left.

One merge at a time, best rank first and leftmost first, is the rule of the format. All occurrences may go at once unless a
pair that one of them makes ranks no later than the present minimum; such a word merges only its first occurrence in this round.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import whole_text
from eventlens.llm.words import LONG_WORD

#: What stands for a blank in pieces (a fixed value of the format).
BLANK = "▁"
#: States of a pair besides its rank: it may become part of a merge later; it never will.
LATER, NEVER = (1 << 31) - 2, (1 << 31) - 1
#: Code points of a window, and of the windows encoded together.
WINDOW, TOGETHER = 1 << 16, 1 << 21
#: Segments remembered in a generation; longer ones than LONG_WORD are not.
REMEMBERED = 250_000


class PieceFile:
    """Pieces of a model file, their scores and the table of pairs.

    Only for the kind of model that needs no normaliser: BPE, identity normalisation, blanks kept, a blank put in front,
    bytes for unknown characters. Other files raise ValueError.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.encode("a  ½ b ", out_type=str)[0][0] != BLANK or model.decode(model.encode("a  ½ b ")) != "a  ½ b ":
            raise ValueError(f"{path}: expected a model that keeps blanks and characters as they are and puts a blank in front")
        self.size, self.end = model.get_piece_size(), model.eos_id()
        self.byte_ids, self.silent, self.strings = {}, set(), {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif model.is_control(i):
                self.silent.add(i)
            elif not model.is_unknown(i) and not model.is_unused(i):
                self.strings[i] = piece
        if len(self.byte_ids) != 256:
            raise ValueError(f"{path}: expected a piece for every byte")
        self.unknown = {i: model.decode([self.end, i]) for i in range(self.size) if model.is_unknown(i)}
        self.ids = {s: i for i, s in self.strings.items()}
        self.joined = {s[k:k + 2] for s in self.ids for k in range(len(s) - 1)}
        self._pairs({s: model.get_score(i) for s, i in self.ids.items()})
        self._cut()

    def _pairs(self, score: dict[str, float]) -> None:
        """Sorted pair keys with their state and what they make; equal scores have one rank."""
        rank = {x: r for r, x in enumerate(sorted(set(score.values()), reverse=True))}
        ids = self.ids
        parts = {s[a:b] for s in ids for a in range(len(s)) for b in range(a + 2, len(s) + 1)}
        found = [(left, right, x) for x in parts for k in range(1, len(x)) if (left := ids.get(x[:k])) is not None and (right := ids.get(x[k:])) is not None]
        keys = np.array([left * self.size + right for left, right, _ in found], np.int64)
        state = np.array([rank[score[x]] if x in score else LATER for *_, x in found], np.int64)
        made = np.array([ids.get(x, 0) for *_, x in found], np.int64)
        order = np.argsort(keys)
        self.keys, self.state, self.made = keys[order], state[order], made[order]

    def _cut(self) -> None:
        """The pattern of segments: blanks and what follows them. No merge crosses their borders, so each is encoded by itself.

        Long runs of blanks are cut at multiples of the longest blank piece, if pieces of blanks only rank behind all others and
        equal among themselves and so many blanks become one piece: from the left, each grows to it before the next begins.
        """
        blanks = [s for s in self.ids if set(s) == {BLANK}]
        plain = all(BLANK not in s[1:] for s in self.ids if set(s) != {BLANK})
        letters = {c for s in self.ids if len(s) > 1 for c in s}
        alone = "".join(re.escape(c) for c in map(chr, range(32)) if c not in letters)  # control characters are in no longer piece
        other = f"[^{BLANK}{alone}]+"
        alone = f"[{alone}]|" if alone else ""
        n = max(map(len, blanks), default=0)
        if plain and self._tied(blanks) and len(merge_rounds(self, np.full(n, self.ids[BLANK]), np.zeros(n, int))[0]) == 1:
            self.segment = re.compile(f"{alone}{BLANK}{{{n}}}(?={BLANK})|{BLANK}{{0,{n}}}{other}|{BLANK}+")
        elif plain:
            self.segment = re.compile(f"{alone}{BLANK}*{other}|{BLANK}+")
        else:
            self.segment = re.compile("(?s:.+)")

    def _tied(self, blanks: list[str]) -> bool:
        """Do all longer pieces of blanks only share the last rank?"""
        made = np.isin(self.made, [self.ids[s] for s in blanks]) & (self.state < LATER)
        return BLANK in self.ids and bool(made.any()) and bool((self.state[made] == self.state[self.state < LATER].max()).all())

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State of each pair and what it makes. Symbols from ``size`` on are unknown characters, in no pair."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left < self.size) & (right < self.size)
        return np.where(known, self.state[at], NEVER), self.made[at]


def merge_rounds(pieces: PieceFile, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols and their owners, in order. ``owner`` ascends; nothing is merged across owners."""
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    place = np.arange(len(symbols))
    state = np.full(len(symbols), NEVER, np.int64)  # of each symbol with the next one
    if len(symbols) > 1:
        state[:-1] = np.where(owner[:-1] == owner[1:], pieces.lookup(symbols[:-1], symbols[1:])[0], NEVER)
    while len(symbols):
        ends = state == NEVER
        word = np.cumsum(ends) - ends
        least = np.minimum.reduceat(state, np.flatnonzero(np.r_[True, ends[:-1]]))[word]
        going = least < LATER
        if not going.all():  # compaction: words without a ranked pair leave
            done.append((place[~going], symbols[~going], owner[~going]))
            symbols, owner, place, state, word, least = (x[going] for x in (symbols, owner, place, state, word, least))
            if not len(symbols):
                break
        at = np.flatnonzero(state == least)
        run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]  # of overlapping ones every other, from the left
        made = pieces.lookup(symbols[at], symbols[at + 1])[1]
        after, before = np.full(len(at), NEVER), np.full(len(at), NEVER)
        r = np.flatnonzero(state[at + 1] != NEVER)
        after[r] = pieces.lookup(made[r], symbols[at[r] + 2])[0]
        r = np.flatnonzero((at > 0) & (state[at - 1] != NEVER))
        merged = np.r_[False, np.diff(at) == 2] & (np.r_[-1, word[at[:-1]]] == word[at])  # the neighbour before is merged as well
        near = np.where(merged, np.r_[0, made[:-1]], symbols[at - 1])
        before[r] = pieces.lookup(near[r], made[r])[0]
        rash = np.unique(word[at[(after <= least[at]) | (before <= least[at])]])
        if len(rash):
            first = np.r_[True, word[at[1:]] != word[at[:-1]]]
            chosen = first | ~np.isin(word[at], rash)
            at, made, merged = at[chosen], made[chosen], merged[chosen] & np.r_[False, chosen[:-1]][chosen]
        symbols[at] = made
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        closed = state[at + 1] == NEVER
        state[at] = np.where(closed, NEVER, LATER)
        symbols, owner, place, state = symbols[keep], owner[keep], place[keep], state[keep]
        now = at - np.arange(len(at))  # where the merged symbols are now
        for left in (now, now[now > 0] - 1):
            left = left[state[left] != NEVER]
            state[left] = pieces.lookup(symbols[left], symbols[left + 1])[0]
    if not done:
        return symbols, owner
    place, symbols, owner = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(place, kind="stable")
    return symbols[order], owner[order]


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        self.file = PieceFile(path)
        self.texts = {i: s.replace(BLANK, " ").encode() for i, s in self.file.strings.items()} | {i: s.encode() for i, s in self.file.unknown.items()}
        self.byte_of = {i: bytes([b]) for b, i in self.file.byte_ids.items()}
        self.numbers = [str(i).encode() for i in range(self.file.size)]
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def ids(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment, all merged together."""
        text = "".join(segments)
        letters = sorted(set(text))
        known = [self.file.ids.get(c) for c in letters]
        strange = [c for c, i in zip(letters, known) if i is None]
        code = {c: self.file.size + k for k, c in enumerate(strange)}
        table = np.array([code[c] if i is None else i for c, i in zip(letters, known)], np.int64)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = table[np.searchsorted(np.array([ord(c) for c in letters], np.uint32), points)]
        owner = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        symbols, owner = merge_rounds(self.file, symbols, owner)
        if strange:  # bytes for unknown characters
            as_bytes = [[self.file.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] for c in strange]
            size = np.array([len(x) for x in as_bytes])
            flat, first = np.concatenate(as_bytes), np.cumsum(size) - size
            odd = symbols >= self.file.size
            which = symbols[odd] - self.file.size
            count = np.ones(len(symbols), np.int64)
            count[odd] = size[which]
            start = np.cumsum(count) - count
            out, owner = np.repeat(symbols, count), np.repeat(owner, count)
            step = np.arange(len(out)) - np.repeat(start, count)
            fill = np.repeat(odd, count)
            out[fill] = flat[np.repeat(first[which], size[which]) + step[fill]]
            symbols = out
        cut = np.searchsorted(owner, np.arange(len(segments) + 1)).tolist()
        flat = symbols.tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def decoded(self, ids: list[int]) -> bytes:
        """The text of ids, its blanks all kept. Byte pieces are read as UTF-8; bytes that are none become U+FFFD, one each."""
        try:
            return b"".join([self.texts[i] for i in ids])
        except KeyError:
            pass
        out, held = [], b""
        for i in ids:
            if i in self.byte_of:
                held += self.byte_of[i]
                continue
            if held:
                out.append(whole_characters(held))
                held = b""
            out.append(self.texts.get(i, b""))
        return b"".join(out) + whole_characters(held)

    def decode(self, ids: Iterable[int]) -> str:
        """As the library decodes: without the blank put in front."""
        ids = [i for i in ids if i not in self.file.silent]
        text = self.decoded(ids).decode()
        return text[1:] if ids and self.file.strings.get(ids[0], "").startswith(BLANK) else text

    def windows(self, text: str) -> Iterator[str]:
        """The text with its blanks replaced and one in front, cut where no piece joins the two sides."""
        start, at, n = 0, WINDOW, len(text)
        front = BLANK if text else ""
        while at < n:
            if text[at - 1:at + 1].replace(" ", BLANK) in self.file.joined:
                at += 1
                continue
            yield front + text[start:at].replace(" ", BLANK)
            front, start, at = "", at, at + WINDOW
        yield front + text[start:].replace(" ", BLANK)

    def runs(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of the text, its next ids in decimal, their decoded bytes), the windows of several texts encoded together.

        Every text comes at least once. Short segments are remembered, two generations of ``REMEMBERED`` at most.
        """
        held, size = [], 0
        for k, text in enumerate(texts):
            for window in self.windows(text):
                held.append((k, self.file.segment.findall(window)))
                size += len(window)
                if size >= TOGETHER:
                    yield from self._together(held)
                    held, size = [], 0
        yield from self._together(held)

    def _together(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, bytes, bytes]]:
        known, older, numbers = self.known, self.older, self.numbers
        wanted = set().union(*[found for _, found in held])
        values = {s: v for s in wanted if (v := known.get(s) or older.get(s))}
        new = list(wanted.difference(values))
        if new:
            values.update((s, (b" ".join([numbers[i] for i in ids]), self.decoded(ids))) for s, ids in zip(new, self.ids(new)))
        number, text = {s: v[0] for s, v in values.items()}.__getitem__, {s: v[1] for s, v in values.items()}.__getitem__
        for k, found in held:
            yield k, b" ".join(map(number, found)), b"".join(map(text, found))
        known.update(values if len(max(new, key=len, default="")) <= LONG_WORD else {s: v for s, v in values.items() if len(s) <= LONG_WORD})
        if len(known) > REMEMBERED:
            self.known, self.older = {}, known

    def encode(self, text: str) -> list[int]:
        """All ids of a text, with the end id."""
        return [int(i) for _, ids, _ in self.runs([text]) for i in ids.split()] + [self.file.end]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded text, as running digests."""
        state = []
        for k, ids, out in self.runs(texts):
            if k == len(state):
                state.append([0, hashlib.sha256(), hashlib.sha256()])
                out = out[1:]  # the blank put in front is not text
            if ids:
                s = state[k]
                s[1].update(b" " + ids if s[0] else ids)
                s[2].update(out)
                s[0] += ids.count(b" ") + 1
        end = str(self.file.end).encode()
        for s in state:
            s[1].update(b" " + end if s[0] else end)
        return [(n + 1, ids.hexdigest(), out.hexdigest()) for n, ids, out in state]


def whole_characters(data: bytes) -> bytes:
    """UTF-8 as it is, every byte that belongs to no character as U+FFFD."""
    out = []
    while data:
        try:
            data.decode()
            out.append(data)
            break
        except UnicodeDecodeError as e:
            out.append(data[:e.start] + "�".encode())
            data = data[e.start + 1:]
    return b"".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One per Python worker and file."""
    return PieceCodec(path)


def token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text: the operator's real outputs. Null text: empty."""

    def run(batches):
        pieces = codec(path)
        for b in batches:
            ids = [pieces.encode(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(pieces.decode, ids), pa.string())], ["id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("id"), whole_text(text_col)).mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text.

    One pass without a shuffle, so a lost task is just run again. Null text counts as empty (the end id alone); repeated
    rows give repeated rows, a null id stays null; an empty table gives an empty one; other columns are not read. Memory
    follows a window of text, or the longest stretch in which every pair of neighbours could be merged.
    """

    def run(batches):
        pieces = codec(path)
        for b in batches:
            n, ids, out = zip(*pieces.digests([x.as_py() for x in b.column(1)])) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())],
                                             ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col(id_col).alias("id"), whole_text(text_col))
            .mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col))
