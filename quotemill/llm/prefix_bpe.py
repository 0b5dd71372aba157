"""Byte-level BPE by prefix dynamic programming.

Two tokens are compatible if merging the bytes of both gives back exactly these two. A list of tokens is the encoding
of its bytes if and only if all neighbours are compatible, and the encoding of a prefix of a pre-token therefore has
one valid last token. The table of last tokens, one per byte, is the whole state: appending a byte adds one entry, an
edit keeps the entries before it and rejoins the old ones once as many agree as the longest token has bytes, and the
ids are read off backwards.

Defined cases: null and empty texts give no ids; no special string is recognised; repeated rows give repeated results;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from .pieces import KEPT_WORDS, Remembered, cut
from .tasks import map_rows, texts

CODES = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
KEPT_PAIRS = 400_000
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """token -> rank, from lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, ranks))
        # a scan for the last token goes backwards and stops where no token ends like that
        self.endings = {token[i:] for token in ranks for i in range(len(token))}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})

    def _halves(self, token: bytes) -> list[bytes]:
        """The two parts that the last merge of a token joins: the lowest-ranked pair first, leftmost first."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = zip(parts, parts[1:], strict=False)
            _, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(pairs))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """What stands at one edge of a token while its bytes merge: (bytes, rank it is made at, rank it goes at)."""
        known = self._edges[side].get(token)
        if known is None:
            known, data, gone = [], self.bytes_of[token], NEVER
            while len(data) > 1:
                made = self.ranks[data]
                known.append((data, made, gone))
                data, gone = self._halves(data)[side], made
            known.append((data, -1, gone))
            self._edges[side][token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of the two tokens, up to both being whole.

        A crossing merge needs two edge parts that stand side by side at some time, and a rank lower than the merge
        that takes the left part, and not higher than the one that takes the right part (ties go to the leftmost)."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= KEPT_PAIRS:
                self._pairs.clear()
            known = self._pairs[left, right] = not self._crossed(left, right)
        return known

    def _crossed(self, left: int, right: int) -> bool:
        rank_of, facing = self.ranks.get, self._edge(right, 0)
        for a, a_made, a_gone in self._edge(left, 1):
            for b, b_made, b_gone in facing:
                if a_made < b_gone and b_made < a_gone:
                    rank = rank_of(a + b)
                    if rank is not None and rank < a_gone and rank <= b_gone:
                        return True
        return False

    def _last(self, data: bytes, last: list[int], end: int) -> int:
        """The valid last token of ``data[:end]``; ``last[i]`` is that of ``data[: i + 1]``."""
        for start in range(end - 1, -1, -1):
            candidate = data[start:end]
            if candidate not in self.endings:
                break
            token = self.ranks.get(candidate)
            if token is not None and (not start or self.compatible(last[start - 1], token)):
                return token
        raise ValueError(f"no token ends at byte {end}")

    def append(self, data: bytes, last: list[int], more: bytes) -> bytes:
        """Extend the table by ``more``; earlier entries stay as they are."""
        whole = data + more
        for end in range(len(data) + 1, len(whole) + 1):
            last.append(self._last(whole, last, end))
        return whole

    def edit(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int], int]:
        """Replace ``data[start:end]``: the new bytes, their table and the number of entries computed anew."""
        whole = data[:start] + new + data[end:]
        table, moved, agreed = last[:start], len(new) - (end - start), 0
        for i in range(start, len(whole)):
            table.append(self._last(whole, table, i + 1))
            behind = i - (start + len(new))
            agreed = agreed + 1 if behind >= 0 and table[i] == last[i - moved] else 0
            # an entry depends on the entries and bytes up to one longest token back, all equal from here on
            if agreed >= self.longest:
                return whole, table + last[i + 1 - moved :], i + 1 - start
        return whole, table, len(whole) - start

    def ids(self, last: list[int]) -> list[int]:
        """Token ids of the whole table, read backwards from the last entry."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pre-token. One that is itself a token is that token."""
        if data in self.ranks:
            return [self.ranks[data]]
        last: list[int] = []
        self.append(b"", last, data)
        return self.ids(last)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class TextBpe:
    """Whole texts: pre-tokens by the vocabulary's pattern, ids by ``PrefixBpe``, pieces seen before remembered."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        # the pattern means Unicode white space, which this module's own \\s is not
        named = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.bpe = PrefixBpe(read_ranks(ranks_path))
        self.find = regex.compile(named).findall
        self.first = Remembered(self._encode, KEPT_WORDS)
        self.rest = Remembered(lambda piece: self._encode(" " + piece))
        self.words = Remembered(lambda word: array("I", self.bpe.encode(word.encode())).tobytes(), KEPT_WORDS)

    def _encode(self, piece: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.find(piece)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = cut(text)
        head = self.first[pieces[0]] if pieces[0] else b""
        return head + b"".join(map(self.rest.__getitem__, pieces[1:]))

    def decode(self, packed: bytes) -> bytes:
        return self.bpe.decode(np.frombuffer(packed, "<u4").tolist())


_coders: dict[tuple[str, str], TextBpe] = {}


def coder(ranks_path: str, pattern: str) -> TextBpe:
    if (ranks_path, pattern) not in _coders:
        _coders[ranks_path, pattern] = TextBpe(ranks_path, pattern)
    return _coders[ranks_path, pattern]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) with ids as little-endian 32-bit numbers."""

    def make():
        encode = coder(ranks_path, pattern).encode
        return lambda columns: {"doc_id": columns["doc_id"], "ids": [encode(t) for t in columns["text"]]}

    return map_rows(texts(docs), "doc_id long, ids binary", make)


def decode_ids(coded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) from the ids alone."""

    def make():
        decode = coder(ranks_path, pattern).decode
        return lambda columns: {"doc_id": columns["doc_id"], "bytes": [decode(x) for x in columns["ids"]]}

    return map_rows(coded.select("doc_id", "ids"), "doc_id long, bytes binary", make)


def check_codes(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass over the texts."""

    def make():
        text_bpe = coder(ranks_path, pattern)

        def work(columns):
            ids = [text_bpe.encode(t) for t in columns["text"]]
            return {
                "doc_id": columns["doc_id"], "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(text_bpe.decode(x)).hexdigest() for x in ids],
            }

        return work

    return map_rows(texts(docs), CODES, make)
