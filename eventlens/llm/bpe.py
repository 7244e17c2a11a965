"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as an incremental byte-to-text state machine.

A token of a merge list is final once enough symbols behind it are known. The number needed follows from the list: a
merge (a, b) can only be stopped by an earlier-ranked merge that takes the end of b, that one by a still earlier one,
and so on; the longest such chain of ever smaller ranks, counted in symbols, is the sufficient lookahead for any prefix.
``Stream`` finds for each prefix what is settled, which is mostly far sooner. Every word goes through it; the tokens of
usual words are remembered.
"""

from __future__ import annotations

import codecs
import hashlib
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import whole_text
from eventlens.llm.words import LONG_WORD, Cache, WordFile, windows


def byte_letters() -> dict[int, str]:
    """Byte -> printable letter: visible Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(seen))
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


LETTER_OF = byte_letters()
BYTE_OF = {x: bytes([b]) for b, x in LETTER_OF.items()}


class Merges:
    """A merge list with its sufficient lookahead."""

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.ids, self.end = vocabulary, end
        self.ranks = {p: r for r, p in enumerate(pairs)}
        self.longest = max(map(self.width, vocabulary), default=1)
        self.lookahead = self._lookahead(pairs)
        #: Beginnings of tokens that more letters can complete.
        self.open = frozenset(t[:k] for t in vocabulary for k in range(1, self.width(t)))
        self.follows = Cache(lambda pair: self._follows(*pair), 400_000)
        #: Last three letters -> letters of the longest token that ends in them, within a word and at its end.
        self.reach, self.reach_end = self._reach(vocabulary), self._reach(t.removesuffix(self.end) for t in vocabulary if t.endswith(self.end))

    def width(self, token: str) -> int:
        """Letters of a token, its end mark apart."""
        n = len(token)
        return (n - len(self.end) or 1) if self.end and token.endswith(self.end) else n or 1

    def _reach(self, tokens: Iterable[str]) -> dict[str, int]:
        found: dict[str, int] = {}
        for t in tokens:
            if len(t) > 2:
                found[t[-3:]] = max(found.get(t[-3:], 0), min(len(t), self.longest))
        return found

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """Symbols behind a token that settle it. ``need[t]``: the longest chain that starts by taking t from its owner."""
        made: dict[str, tuple[str, str]] = {}
        need: dict[str, int] = {}
        most = 0
        for left, right in pairs:  # in the order of rank: every chain of smaller ranks is known
            spine, more = right, 0
            while True:
                more = max(more, need.get(spine, 0))
                if spine not in made:
                    break
                spine = made[spine][1]
            chain = self.width(right) + more
            need[left] = max(need.get(left, 0), chain)
            most = max(most, chain)
            made.setdefault(left + right, (left, right))
        return most + 1

    @staticmethod
    def letters(word: str) -> str:
        return "".join([LETTER_OF[b] for b in word.encode("utf-8", "surrogatepass")])

    def symbols(self, token: str) -> list[str]:
        """A token's letters, the end mark with the last one."""
        n = self.width(token)
        return [*token[:n - 1], token[n - 1:]]

    def _follows(self, before: str, token: str) -> bool:
        """May ``token`` stand behind ``before`` ('': at the beginning)? So if their letters give these two tokens again."""
        if not before:
            return self.merge(self.symbols(token)) == [token]
        if (before, token) in self.ranks:  # neighbours that merge are never left side by side
            return False
        return self.merge(self.symbols(before) + self.symbols(token)) == [before, token]

    def merge(self, symbols: list[str]) -> list[str]:
        """Apply the merges of smallest rank first, leftmost first."""
        ranks = self.ranks
        if len(symbols) < 150:
            none = 1 << 60
            found = [ranks.get(p, none) for p in zip(symbols, symbols[1:])]
            while found and (best := min(found)) != none:
                k = found.index(best)
                symbols[k] += symbols.pop(k + 1)
                found.pop(k)
                if k < len(found):
                    found[k] = ranks.get((symbols[k], symbols[k + 1]), none)
                if k:
                    found[k - 1] = ranks.get((symbols[k - 1], symbols[k]), none)
            return symbols
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, p) for k, p in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(p)) is not None]
        heapify(heap)
        live: list[str | None] = list(symbols)
        while heap:
            _, k, (left, right) = heappop(heap)
            j = after[k]
            if live[k] != left or j >= n or live[j] != right:
                continue
            live[k], live[j], after[k] = left + right, None, after[j]
            if after[j] < n:
                before[after[j]] = k
            for at in (before[k], k):
                if at >= 0 and after[at] < n and (r := ranks.get(p := (live[at], live[after[at]]))) is not None:
                    heappush(heap, (r, at, p))
        return [x for x in live if x is not None]


class Stream:
    """The transducer for one word: ``feed`` symbols, get the tokens that no later symbol can change.

    Every prefix of a word has a last token: the one suffix of it that is a token and can stand behind the last token of
    what precedes it. Whatever follows, the final cut passes through one of the places where a token that is still open
    may begin, so the tokens that the cuts up to all these places share are settled. Places further back than the merge
    list's lookahead always agree, so the symbols held stay bounded.
    """

    def __init__(self, merges: Merges):
        self.merges, self.held, self.lasts = merges, "", [""]  # lasts[k]: last token of the first k letters held

    def _read(self, first: int, n: int) -> None:
        """Last tokens of the prefixes of ``first`` to ``n`` letters held."""
        held, lasts, reach, ids, follows = self.held, self.lasts, self.merges.reach, self.merges.ids, self.merges.follows
        for at in range(first, n + 1):
            longest = reach.get(held[at - 3:at], 2) if at > 2 else at
            for start in range(at - longest if at > longest else 0, at):
                token = held[start:at]
                if token in ids and follows[lasts[start], token]:
                    lasts.append(token)
                    break
            else:
                raise ValueError(f"the vocabulary has no token for {held[at - 1]!r}")

    def _close(self, n: int) -> None:
        """Last token of the word: its last letter bears the end mark."""
        held, lasts, merges = self.held, self.lasts, self.merges
        longest = merges.reach_end.get(held[n - 3:n], 2) if n > 2 else n
        for start in range(max(0, n - longest), n):
            token = held[start:n] + merges.end
            if token in merges.ids and merges.follows[lasts[start], token]:
                lasts.append(token)
                return
        raise ValueError(f"the vocabulary has no token for {held[n - 1] + merges.end!r}")

    def _settled(self) -> int:
        """Letters held whose tokens are settled."""
        n, open_, width = len(self.held), self.merges.open, self.merges.width
        places = {n} | {k for k in range(max(0, n - self.merges.longest), n) if self.held[k:] in open_}
        while len(places) > 1:
            most = max(places)
            places.remove(most)
            places.add(most - width(self.lasts[most]))
        return places.pop()

    def _cut(self, end: int) -> list[str]:
        """Tokens of the first ``end`` letters held."""
        out = []
        while end:
            out.append(self.lasts[end])
            end -= self.merges.width(self.lasts[end])
        return out[::-1]

    def feed(self, letters: str, last: bool = False) -> list[str]:
        """Tokens settled by ``letters``. The word's last letter comes with ``last``, since the end mark makes it another symbol."""
        if last and self.held and not letters:
            raise ValueError("the last letter of a word has to come with last=True")
        before, self.held = len(self.held), self.held + letters
        n = len(self.held)
        if last:
            if n:
                self._read(before + 1, n - 1)
                self._close(n)
            out = self._cut(n)
            self.held, self.lasts = "", [""]
            return out
        self._read(before + 1, n)
        settled = self._settled()
        out = self._cut(settled)
        # The token before what is held still decides which may follow.
        self.held, self.lasts = self.held[settled:], self.lasts[settled:]
        return out


class Decoder:
    """Ids to text, step by step. Bytes wait until they complete a code point.

    ``plain`` is what the library does for a file without a decoder: vocabulary strings with spaces between. Otherwise
    letters become bytes again and a word's end becomes a space.
    """

    def __init__(self, strings: dict[int, str], end: str, plain: bool = True, added: frozenset[int] = frozenset()):
        self.strings, self.end, self.plain, self.added = strings, end, plain, added
        self.state, self.first = codecs.getincrementaldecoder("utf-8")("replace"), True
        self.bytes = {i: self.token_bytes(i) for i in strings}

    def restart(self) -> None:
        self.state.reset()
        self.first = True

    def token_bytes(self, i: int) -> bytes:
        token = self.strings[i]
        if self.plain:
            return token.encode()
        if i in self.added:
            return token.encode()
        ends = bool(self.end) and token.endswith(self.end)
        return b"".join(BYTE_OF[x] for x in (token.removesuffix(self.end) if ends else token)) + b" " * ends

    def feed(self, ids: Iterable[int]) -> str:
        data = (b" " if self.plain else b"").join([self.bytes[i] for i in ids])
        if data and self.plain and not self.first:
            data = b" " + data
        self.first = self.first and not data
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


class StreamingBpe:
    """Encoder and decoder of one tokenizer file, in memory that does not grow with the text."""

    def __init__(self, path: str):
        self.file = WordFile(path)
        model = self.file.file["model"]
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.strings = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.file.added.items()}
        self.added = frozenset(self.file.added.values())
        self.plain = self.file.file["decoder"] is None
        self._stream = Stream(self.merges)
        self._words = Cache(self._word)
        self._digests = Cache(self._digest)
        self._decoder = self.decoder()

    def _word(self, word: str) -> list[int]:
        return [self.merges.ids[t] for t in self._stream.feed(self.merges.letters(word), True)]

    def decoder(self, plain: bool | None = None) -> Decoder:
        return Decoder(self.strings, self.merges.end, self.plain if plain is None else plain, self.added)

    def word_ids(self, word: str) -> Iterator[list[int]]:
        """Runs of final ids. Words of usual length are remembered; a long one goes through the transducer in pieces."""
        if len(word) <= LONG_WORD:
            yield self._words[word]
            return
        stream = Stream(self.merges)
        for k in range(0, len(word), LONG_WORD):
            run = stream.feed(self.merges.letters(word[k:k + LONG_WORD]), k + LONG_WORD >= len(word))
            if run:
                yield [self.merges.ids[t] for t in run]

    def encode(self, text: str) -> Iterator[list[int]]:
        """Runs of final ids, in order."""
        for window in windows(text):
            for is_added, part in self.file.segments(window):
                if is_added:
                    yield [self.file.added[part]]
                else:
                    for word in self.file.words(self.file.normal(part)):
                        yield from self.word_ids(word)

    def _digest(self, word: str) -> tuple[int, bytes, bytes]:
        """Of a word: number of ids, ids as little-endian bytes, decoded bytes without the space before."""
        return self._digested(self._word(word))

    def _digested(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        return len(ids), _little(ids), self._text(ids)

    def _text(self, ids: list[int]) -> bytes:
        self._decoder.restart()
        return self._decoder.feed(ids).encode()

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the decoded text, kept as running digests.

        Only for a file without a decoder, whose words decode independently of each other.
        """
        if not self.plain:
            raise ValueError("digest() needs a file whose tokens are joined by spaces")
        n, ids, out = 0, hashlib.sha256(), hashlib.sha256()

        def add(found: list[tuple[int, bytes, bytes]]) -> None:
            nonlocal n
            if found:
                if n:
                    out.update(b" ")
                counts, data, texts = zip(*found)
                n += sum(counts)
                ids.update(b"".join(data))
                out.update(b" ".join(texts))

        get = self._digests.__getitem__
        for window in windows(text):
            for is_added, part in self.file.segments(window):
                if is_added:
                    add([(1, _little([self.file.added[part]]), part.encode())])
                    continue
                words = self.file.words(self.file.normal(part))
                if len(max(words, key=len, default="")) <= LONG_WORD:
                    add(list(map(get, words)))
                    continue
                found = []
                for word in words:
                    if len(word) <= LONG_WORD:
                        found.append(get(word))
                        continue
                    add(found)
                    found = []
                    for run in self.word_ids(word):
                        add([self._digested(run)])
                add(found)
        return n, ids.hexdigest(), out.hexdigest()


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> StreamingBpe:
    """One per Python worker and file."""
    return StreamingBpe(path)


def token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every text: the operator's real outputs. Null text: empty."""

    def run(batches):
        bpe = codec(path)
        for b in batches:
            ids = [[i for run in bpe.encode(x.as_py()) for i in run] for x in b.column(1)]
            out = []
            for x in ids:
                decoder = bpe.decoder()
                out.append(decoder.feed(x) + decoder.finish())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(out, pa.string())], ["id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("id"), whole_text(text_col)).mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text.

    One pass without a shuffle; repeated rows give repeated rows; null text counts as empty (0 tokens, digests of
    nothing); an empty table gives an empty one; other columns are not read.
    """

    def run(batches):
        bpe = codec(path)
        for b in batches:
            n, ids, out = zip(*(bpe.digest(x.as_py()) for x in b.column(1))) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())],
                                             ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col(id_col).alias("id"), whole_text(text_col))
            .mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col))
