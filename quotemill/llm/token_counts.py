"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is tried once: if the library's pre-tokenizer leaves it whole and its merges end in
that one id, a pre-token that equals it counts one without any merging. Pre-tokens are merged independently, so the
proof holds in every text. Only other pre-tokens are merged.

Defined cases: null and empty texts have 0 bytes and tokens; special strings inside a text are recognised as the
library does by default; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .pieces import BYTE_LEVEL, KEPT_WORDS, SIMPLE, Remembered, byte_letters, cut, simple_pattern
from .tasks import map_rows, texts

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings, in the vocabulary's byte letters, that are one pre-token and one token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    byte_of = {letter: byte for byte, letter in byte_letters().items()}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    proven = []
    for token, number in tokenizer.get_vocab().items():
        if token in special or any(c not in byte_of for c in token):
            continue
        try:
            text = bytes(byte_of[c] for c in token).decode()
        except UnicodeDecodeError:
            continue  # a part of a character is no pre-token of any text
        alone = [word for word, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        if alone == [token] and [t.id for t in tokenizer.model.tokenize(token)] == [number]:
            proven.append(token)
    return frozenset(proven)


class PieceCounter:
    """Number of tokens of whole texts."""

    def __init__(self, path: str, proven: frozenset[str]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.proven = proven
        self.letters = byte_letters()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = simple_pattern(self.tokenizer)
        self.first = Remembered(self._count, KEPT_WORDS)
        self.rest = Remembered(lambda piece: self._count(" " + piece))
        self.words = Remembered(self._merged, KEPT_WORDS)

    def _merged(self, word: str) -> int:
        """One for a whole token; merging for the rest. ``word``: a pre-token in the vocabulary's byte letters."""
        return 1 if word in self.proven else len(self.tokenizer.model.tokenize(word))

    def _count(self, piece: str) -> int:
        if self.pattern is BYTE_LEVEL and SIMPLE.fullmatch(piece):
            mapped = (w.encode().decode("latin-1").translate(self.letters) for w in BYTE_LEVEL.findall(piece))
        else:
            mapped = (word for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece))
        return sum(map(self.words.__getitem__, mapped))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if any(s in text for s in self.specials):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        pieces = cut(text)
        head = self.first[pieces[0]] if pieces[0] else 0
        return head + sum(map(self.rest.__getitem__, pieces[1:]))


_counters: dict[str, PieceCounter] = {}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every document."""
    spark = docs.sparkSession
    # bounded by the vocabulary
    proven = spark.sparkContext.broadcast(whole_tokens(vocabulary))

    def make():
        if vocabulary not in _counters:
            _counters[vocabulary] = PieceCounter(vocabulary, proven.value)
        count = _counters[vocabulary].count

        def work(columns):
            tokens = [count(t) for t in columns["text"]]
            return {
                "doc_id": columns["doc_id"], "n_bytes": [len(t.encode()) for t in columns["text"]], "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens],
            }

        return work

    return map_rows(texts(docs), COUNTS, make)
