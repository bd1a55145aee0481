"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at each character; dynamic
programming carries the best score and the piece count, never the pieces. Ties follow the tokenizer:
scores add in double precision and only a strictly better path replaces one from an earlier start,
so of equal paths the one with the longest last piece stays. An unknown character scores the lowest
piece score less 10 and, with byte fallback, counts one token a UTF-8 byte.

No piece of such vocabularies holds a space mark after another character, so every best path breaks
there: a text is the sum of its marked words, and each distinct word is worked out once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

import ahocorasick
from pyspark.sql import DataFrame, types as T

from .common import annotate

SPACE = "▁"
_MARKED = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass
class Unigram:
    scores: dict[str, float]
    byte_fallback: bool = True
    _machine: object = field(default=None, repr=False)
    _memo: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.unknown = min(self.scores.values(), default=0.0) - 10.0
        self._single = {p for p in self.scores if len(p) == 1}
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.scores)

    def __getstate__(self):
        return {"scores": self.scores, "byte_fallback": self.byte_fallback}

    def __setstate__(self, state):
        self.__init__(**state)

    def machine(self):
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for piece, score in self.scores.items():
                self._machine.add_word(piece, (len(piece), score))
            self._machine.make_automaton()
        return self._machine

    def count_marked(self, word: str) -> int:
        """Tokens of a string whose spaces are already marks."""
        if not word:
            return 0
        if not self._single.issuperset(word):
            return self._count_unknown(word)
        # every character is a piece: the automaton lists for each end the longest piece first
        best, tokens = [0.0], [0]
        at = 0
        for last, (size, score) in self.machine().iter(word):
            start = last + 1 - size
            path = best[start] + score
            if last == at:
                best.append(path)
                tokens.append(tokens[start] + 1)
                at += 1
            elif path > best[at]:
                best[at], tokens[at] = path, tokens[start] + 1
        return tokens[-1]

    def _count_unknown(self, word: str) -> int:
        n = len(word)
        ends: list[list] = [[] for _ in range(n + 1)]
        if self.scores:
            for last, found in self.machine().iter(word):
                ends[last + 1].append(found)
        best, tokens, unknown = [0.0], [0], [False]
        for end in range(1, n + 1):
            paths = [(best[end - size] + score, size) for size, score in ends[end]]
            if word[end - 1] not in self._single:
                paths.append((best[end - 1] + self.unknown, 0))
            path, size = max(paths, key=lambda x: x[0])  # the first of equal ones: the earliest start
            more = 1 if size else len(word[end - 1].encode()) if self.byte_fallback else int(not unknown[-1])
            best.append(path)
            tokens.append(tokens[end - (size or 1)] + more)
            unknown.append(not size)
        return tokens[n]

    def count(self, text: str) -> int:
        """Tokens of a text; one space mark is put before it, none if it is empty."""
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.splits:
            return self.count_marked(marked)
        memo, total = self._memo, 0
        if len(memo) > 500_000:
            memo.clear()
        for word in _MARKED.findall(marked):
            k = memo.get(word)
            if k is None:
                k = self.count_marked(word)
                if len(word) < 64:
                    memo[word] = k
            total += k
        return total


def load(path: str | Path) -> Unigram:
    """The pieces and scores of a SentencePiece model file; control, unknown and byte pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    pieces = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not special(i)}
    return Unigram(pieces, any(model.is_byte(i) for i in range(model.get_piece_size())))


def count_tokens(docs: DataFrame, model: Unigram, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``n_tokens``; null and empty texts have none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = T.StructType([T.StructField("n_tokens", T.LongType())])
    return annotate(docs, text_col, added, lambda texts: [[shared.value.count(t.decode()) for t in texts]], keep)


def query(docs: DataFrame, vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    return count_tokens(docs.select("doc_id", "text"), load(vocabulary), keep=["doc_id"])
