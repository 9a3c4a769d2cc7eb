"""Operator 6: token counts of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each place of a chunk. The
Viterbi pass carries only the best score and its number of pieces. Ties follow the public
``tokenizers`` Unigram model: candidates for a place are taken by start from left to right, and a later
one must be strictly better. A character that is no piece costs the least score less 10 and counts one
piece a UTF-8 byte (byte fallback).

The text becomes chunks as its Metaspace pre-tokenizer does: blanks become U+2581, one is put in front,
and each starts a chunk. Chunks repeat as words do, so a worker keeps the counts of a bounded number.

The vocabulary file is a public sentencepiece model. Its own scores are merge ranks, not
log-probabilities, so a piece's score here is ``-log(rank + 10)`` of its place in the file.

Null and empty texts have 0 tokens. One output row a row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from spanloom.llm.grams import text_slices

#: Chunks that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 500_000, 64
MARK = chr(0x2581)
#: Places of a chunk that are held; more than the longest piece has characters.
HELD = 1 << 16
_CHUNK = re.compile(f"{MARK}[^{MARK}]*")
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of every id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), -math.log(i + 10)) for i in range(model.get_piece_size())]


class Counter:
    """Piece counts of chunks by one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(len(piece) for piece, _ in pieces)
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def pieces(self, chunk: str) -> int:
        """Pieces on the best path through one chunk; of a long chunk only the last places are held."""
        score, count, base = [0.0], [0], 0
        matches = self.automaton.iter(chunk)
        last, match = next(matches, (-1, None))
        for end, character in enumerate(chunk):
            found = []
            while last == end:
                found.append(match)
                last, match = next(matches, (-1, None))
            best, pieces, single = None, 0, False
            for size, own in sorted(found, reverse=True):
                start = end + 1 - size - base
                through = own + score[start]
                if best is None or through > best:
                    best, pieces = through, count[start] + 1
                single = single or size == 1
            if not single:
                through = self.unknown + score[-1]
                if best is None or through > best:
                    best, pieces = through, count[-1] + len(character.encode())
            score.append(best)
            count.append(pieces)
            if len(score) > HELD:
                gone = len(score) - self.longest
                base += gone
                del score[:gone], count[:gone]
        return count[-1]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.known) > REMEMBERED:
            self.known.clear()
        text = text.replace(" ", MARK)
        if text[0] != MARK:
            text = MARK + text
        known, total = self.known, 0
        if len(text) < 1 << 20:
            parts = iter(text.split(MARK)[1:])
        else:
            parts = (m.group()[1:] for m in _CHUNK.finditer(text))  # a list of all chunks would be large
        for part in parts:
            n = known.get(part)
            if n is None:
                n = self.pieces(MARK + part)
                if len(part) <= LONGEST:
                    known[part] = n
            total += n
        return total


@cache
def counter(path: str) -> Counter:
    """One counter a worker process."""
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens; ``model`` is a sentencepiece file that all executors can open."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in text_slices(batch["text"]):
                numbers = np.array([counter(model).count(x.as_py()) for x in part], np.int64)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pc.utf8_length(part).cast(pa.int64()), pa.array(numbers)], ["doc_id", "n_chars", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_chars bigint, n_tokens bigint")
