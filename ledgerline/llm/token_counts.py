"""Token counts without tokens: a count-only Viterbi over a unigram vocabulary.

The tokenizer is the unigram model whose vocabulary and scores are those of a
public vocabulary file (a parameter), with byte fallback, behind a word-start
marker: a space starts a new piece sequence. An Aho-Corasick automaton lists all
vocabulary matches of a segment by their end; dynamic programming keeps, for each
end, the best score and the number of pieces on its path, never the pieces.

Tie rule: candidates for one end come from the earliest start on, and only a
strictly better score replaces one, so of equal paths the longest last piece
wins. A character that is no piece costs the lowest score less 10, and as many
pieces as it has UTF-8 bytes.

Defined results: null and empty texts have 0 tokens; rows are independent, so
ties, repeated rows and extra columns (passed on) change nothing; an empty table
gives an empty result; texts are counted whole. Segments are remembered up to a
bounded number and length for each worker, which changes speed alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trim_memory

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 400_000
REMEMBERED_CHARS = 64


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece model file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Segment -> number of pieces; computes and remembers what is missing."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        #: A line end that no piece holds is on every path: segments can be cut there.
        self.cut_lines = not any("\n" in piece for piece, _ in pieces)

    def __missing__(self, segment: str) -> int:
        n = self.viterbi(segment)[1]
        if len(segment) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[segment] = n
        return n

    def viterbi(self, segment: str) -> tuple[float, int]:
        """Best score and number of pieces."""
        n = len(segment)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        unknown, done, single = self.unknown, 0, False

        def settle(end: int) -> None:
            """Add the candidate of a lone unknown character that ends at ``end``."""
            score = best[end - 1] + unknown
            if best[end] is None or score > best[end]:
                best[end], count[end] = score, count[end - 1] + len(segment[end - 1].encode("utf-8", "surrogatepass"))

        for last, (size, score) in self.matches.iter(segment):
            end = last + 1
            while done < last:  # ends before this one are complete
                done += 1
                if not single:
                    settle(done)
                single = False
            start = end - size
            score += best[start]
            if best[end] is None or score > best[end]:
                best[end], count[end] = score, count[start] + 1
            if size == 1:
                single = True
        while done < n:
            done += 1
            if not single:
                settle(done)
            single = False
        return best[n], count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        if marked[0] != MARK:
            marked = MARK + marked
        segments = marked.split(MARK)[1:]
        if not self.cut_lines or "\n" not in text:
            return sum(map(self.__getitem__, [MARK + s for s in segments]))
        total = marked.count("\n")
        for line in marked.split("\n"):
            if not line:
                continue
            head, *rest = line.split(MARK)
            if head:  # follows a line end: no marker before it
                total += self[head]
            total += sum(map(self.__getitem__, [MARK + s for s in rest]))
        return total


_COUNTERS: dict[str, Counter] = {}


def with_counts(docs: DataFrame, pieces: list[tuple[str, float]], text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with the token count of ``text`` under the unigram vocabulary ``pieces``; a column named ``into`` is replaced.

    The vocabulary is broadcast: its size is the vocabulary file's, whatever the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    key = hashlib.sha256(repr(pieces).encode("utf-8", "surrogatepass")).hexdigest()

    @F.arrow_udf(T.LongType())
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _COUNTERS.get(key)
        if counter is None:
            counter = _COUNTERS.setdefault(key, Counter(shared.value))
        for texts in batches:
            yield pa.array([counter.count(x or "") for x in texts.to_pylist()], pa.int64())
        trim_memory()

    return docs.withColumn(into, counted(F.col(text)))
