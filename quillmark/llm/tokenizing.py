"""Problem 8: encode a corpus with a public byte-pair vocabulary.

Method: a bounded-lookahead streaming transducer. For a byte-pair vocabulary a token sequence is the one that the merge
list gives if and only if every two neighbours are: merging the bytes of the two gives the two back. So each prefix of the
input has one last token, and the state needed for going on is the last token of the prefixes that end within the longest
token's length. As soon as all of these trace back to one common prefix, the tokens up to there can't change any more and
are emitted; memory stays constant however long the input is. Decoding is a state machine over UTF-8 bytes that gives out
text as soon as a character is whole.

Cases: null and empty texts have no ids (an empty list); text that looks like a special token is plain text; lone
surrogates can't occur in a Spark string. Very long runs without a break stream through the transducer in blocks.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The fixed pattern of the public vocabulary: texts are cut into these pieces before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: How many bytes are read between two tests for stable tokens, and how many pieces a worker remembers.
BLOCK, REMEMBERED = 512, 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id; ids are ranks of the merges."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Streams the bytes of one piece to token ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick

        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.machine = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.machine.add_word(token.decode("latin-1"), (rank, len(token)))
        self.machine.make_automaton()
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[bytes, list[int]] = {}

    def lookahead(self) -> int:
        """A sufficient lookahead in bytes: one longest token for every merge that could still apply.

        No later byte can change a token that ends further back; the test for stability is exact and far sooner.
        """
        return len(self.ranks) * self.longest

    def merged(self, data: bytes) -> list[bytes]:
        """The merge list applied by the book: the lowest rank first, leftmost among equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges keep the two tokens apart when they stand side by side."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 4 * REMEMBERED:
                self._fits.clear()
            a, b = self.bytes_of[left], self.bytes_of[right]
            known = self._fits[key] = self.merged(a + b) == [a, b]
        return known

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece whose bytes come in chunks; at most a few blocks of state are held."""
        last: list[tuple[int, int] | None] = []  # by prefix end, counted from base: (id, length)
        text, base = "", 0  # bytes that a token yet to end may start in; place of last[0]'s token end, less one
        tail_id = -1  # the token before base
        for chunk in chunks:
            text += chunk.decode("latin-1")
            done = len(last)
            last.extend([None] * (len(text) - done))
            # tokens that end in the new bytes start at most one token length before them
            lo = max(0, done - self.longest)
            for end, (rank, n) in self.machine.iter(text, lo):
                if end < done or last[end] is not None:
                    continue
                start = end + 1 - n
                before = tail_id if start == 0 else (last[start - 1] or (-2, 0))[0]
                if before == -1 or before >= 0 and self.fits(before, rank):
                    last[end] = (rank, n)
            if len(text) > 2 * self.longest + BLOCK:
                stable = self._common(last)
                if stable > 0:
                    out = self._trace(last, stable)
                    yield from out
                    tail_id, text, last = out[-1], text[stable:], last[stable:]
        yield from self._trace(last, len(last))

    def _common(self, last: list) -> int:
        """The longest prefix through which the tokens of every live prefix go; 0 if there is none yet."""
        live = {i for i in range(max(0, len(last) - self.longest), len(last) + 1) if i == 0 or last[i - 1] is not None}
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(top - last[top - 1][1])
        return live.pop() if live else 0

    def _trace(self, last: list, end: int) -> list[int]:
        out = []
        while end > 0:
            rank, n = last[end - 1]
            out.append(rank)
            end -= n
        out.reverse()
        return out

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece. Short pieces are remembered, since few of them make up most of a corpus."""
        if len(data) > 4 * BLOCK:
            return list(self.stream(data[i : i + BLOCK] for i in range(0, len(data), BLOCK)))
        known = self._whole.get(data)
        if known is None:
            rank = self.ranks.get(data)
            known = [rank] if rank is not None and len(data) < 2 else list(self.stream([data]))
            if len(self._whole) > REMEMBERED:
                self._whole.clear()
            self._whole[data] = known
        return known


class Decoder:
    """Ids to text, a character as soon as its last byte is there."""

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        import codecs

        self.bytes_of, self._state = bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token: int) -> str:
        return self._state.decode(self.bytes_of[token])

    def end(self) -> str:
        return self._state.decode(b"", True)


@lru_cache(maxsize=4)
def worker(path: str) -> tuple[Transducer, object]:
    """One transducer for each Python worker and vocabulary."""
    import regex

    return Transducer(read_ranks(path)), regex.compile(PATTERN)


def encode_text(text: str | None, path: str = VOCABULARY) -> list[int]:
    transducer, pattern = worker(path)
    out: list[int] = []
    for m in pattern.finditer(text or ""):
        out += transducer.piece(m.group().encode("utf-8"))
    return out


def decode_ids(ids: Iterable[int], path: str = VOCABULARY) -> str:
    d = Decoder(worker(path)[0].bytes_of)
    return "".join(map(d.feed, ids)) + d.end()


def token_ids(text: Column | str, path: str = VOCABULARY) -> Column:
    """A column of token ids, ``array<int>``. ``path`` is a rank file that every executor can read."""
    if not os.path.isabs(path):
        raise ValueError("the vocabulary's path must be absolute")

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encode_text(t, path))

    return ids(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")))
