"""Token ids of whole texts inside Arrow batches, with a bounded memory of chunks already encoded.

Byte-level pre-tokenizers of this family never join a blank to the character before it when a
non-blank follows, so a text can be cut before each such blank and its chunks encoded apart with the
same ids. Arrow cuts the texts and numbers their distinct chunks, each distinct chunk is looked up
once a slice, and numpy lays the ids out. Chunks repeat as words do, so a worker encodes a distinct
chunk once while it remembers it; long chunks are not remembered. A blank followed by more white space
is never a cut. A newline between two characters that are no white space is a token of its own.

Added tokens of the tokenizer file (``<|endoftext|>``) are found in texts as the library finds them:
the text is cut around them first.
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from spanloom.llm.grams import text_slices

#: Chunks that a worker remembers in each of two generations, and the longest of them.
REMEMBERED, LONGEST = 500_000, 64
#: Chunks that an idle worker keeps from task to task, those that came first: common ones come early.
KEPT = 50_000
#: Text that is cut and laid out at once; a chunk is looked up once in each, so a larger slice looks up fewer.
SLICE_BYTES = 4 << 20

#: White space that may follow a blank: what ASCII texts can hold, and the rest.
_ASCII_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
_OTHER_WHITE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_UNEVEN = f" [{_ASCII_WHITE}{_OTHER_WHITE}]| $"
#: Letters below this are letters in every Unicode version a tokenizer may know.
_SETTLED = "\u0530"
_LINE = "\n"


def chunks(text: str) -> list[str]:
    """The text cut at each blank that a non-blank follows; each chunk but the first follows a blank."""
    parts = text.split(" ")
    if text.endswith(" ") or any(f" {c}" in text for c in _ASCII_WHITE) or not text.isascii() and any(f" {c}" in text for c in _OTHER_WHITE):
        out = [parts[0]]
        for part in parts[1:]:
            if part and not part[0].isspace():
                out.append(part)
            else:
                out[-1] += " " + part
        return out
    return parts


class Encoder:
    """Little-endian unsigned 32-bit ids of texts by one tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = self.tokenizer.model.tokenize
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.tails: dict[str, bytes] = {}
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {x.content: np.array([i], "<u4").tobytes() for i, x in added.items()}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        # tokens that take blanks beside them or need word edges are left to the library, with their texts
        self.plain = not any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in added.values())
        self.line = self._whole(_LINE)
        self.direct = True
        probe = ["Ma\u00dfe", "na\u00efve.", "w\u0142asna?!", "x)\"", "2024", "Ende$$\nNeu"]
        self.direct = all(self._chunk(x) == self._whole(" " + x) for x in probe)
        self.young = {}  # what the probe left may not be so

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, lead: str, word: str) -> bytes | None:
        """Ids of letters or digits, with or without a blank before and marks behind: one or two pre-tokens; else nothing."""
        core = word.rstrip(string.punctuation)
        if core.isascii():
            if not (core.isalpha() or core.isdigit()):
                return None
            shown = "\u0120" + core if lead else core
        elif core.isalpha() and max(core) < _SETTLED:
            shown = (lead + core).encode().decode("latin-1").translate(self.letters)
        else:
            return None
        if len(core) == len(word):
            return array("I", [x.id for x in self.pieces(shown)]).tobytes()
        own = self._core(lead, core, shown)
        tail = word[len(core) :]
        ids = self.tails.get(tail)
        if ids is None:
            ids = self._whole(tail)
            if len(tail) <= 8:
                self.tails[tail] = ids
        return own + ids

    def _core(self, lead: str, core: str, shown: str) -> bytes:
        """Ids of a word that marks follow; without them it is a chunk of its own, so it may be remembered, and is remembered, as one."""
        key = core if lead else _LINE + core
        ids = self.young.get(key)
        if ids is None:
            ids = self.old.get(key)
            if ids is None:
                ids = array("I", [x.id for x in self.pieces(shown)]).tobytes()
                ids = ids if lead else self.line + ids
            if len(key) <= LONGEST:
                self.young[key] = ids
        return ids if lead else ids[len(self.line) :]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a blank and the chunk after it."""
        if _LINE in chunk:
            first, *lines = chunk.split(_LINE)
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in (first, *lines)):
                return b"".join([self._known(first), *[self._known(_LINE + x) for x in lines]])
        ids = self._word(" ", chunk)
        return self._whole(" " + chunk) if ids is None else ids

    def _known(self, key: str) -> bytes:
        """Ids of a remembered chunk; one that starts with a newline follows no blank."""
        ids = self.young.get(key)
        if ids is not None:
            return ids
        ids = self.old.get(key)
        if ids is None:
            if not self.direct:
                ids = self._whole(key if key[:1] == _LINE else " " + key)
            elif key[:1] == _LINE:
                word = self._word("", key[1:])
                ids = self._whole(key) if word is None else self.line + word
            else:
                ids = self._chunk(key)
        if len(key) <= LONGEST:
            self.young[key] = ids
        return ids

    def _head(self, chunk: str) -> bytes:
        """Ids of a text's first chunk, which follows nothing."""
        if not chunk:
            return b""
        if chunk[0].isspace() or not self.direct:
            return self._whole(chunk)
        return self._known(_LINE + chunk)[len(self.line) :]  # what follows a single newline follows nothing either

    def text(self, text: str) -> bytes:
        """Ids of one text."""
        if self.marks and self.marks.search(text):
            if not self.plain:
                return self._whole(text)
            ends = [m.span() for m in self.marks.finditer(text)]
            starts = [0, *[b for _, b in ends]]
            return b"".join(self._section(text[s:a]) + self.added.get(text[a:b], b"") for s, (a, b) in zip(starts, [*ends, (len(text), len(text))], strict=True))
        return self._section(text)

    def _section(self, text: str) -> bytes:
        first, *rest = chunks(text)
        return b"".join([self._head(first), *map(self._known, rest)])

    def rest(self) -> None:
        """Forget all chunks but those that came first."""
        self.old, self.young = {}, dict(islice(self.young.items(), KEPT))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (no nulls), each with the end id, one after another; and how many each has."""
        n = len(texts)
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        for mark in self.added:
            uneven = pc.or_(uneven, pc.match_substring(texts, mark))
        apart = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
        even = pc.if_else(uneven, "", texts) if len(apart) else texts
        cut = pc.split_pattern(even, " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        values = cut.flatten()
        later = np.ones(len(values), bool)
        later[offsets[:-1]] = False
        coded = values.filter(pa.array(later)).dictionary_encode()
        first = list(map(self._head, values.take(pa.array(offsets[:-1])).to_pylist()))
        for i in apart.tolist():
            first[i] = self.text(texts[i].as_py())
        distinct = _listed(coded.dictionary)
        ids = list(map(self.young.get, distinct))
        young, old, pieces = self.young, self.old, self.pieces
        for i, known in enumerate(ids):
            if known is None:
                chunk = distinct[i]
                known = old.get(chunk)
                if known is not None:
                    young[chunk] = known
                elif chunk.isascii() and chunk.isalpha() and len(chunk) <= LONGEST and self.direct:
                    known = young[chunk] = array("I", [x.id for x in pieces("\u0120" + chunk)]).tobytes()  # as ``_known``, for most
                else:
                    known = self._known(chunk)
                ids[i] = known
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        # chunk numbers: distinct chunks, then first chunks, then the end
        number = np.empty(len(values) + n, np.int32)
        own = np.ones(len(number), bool)
        at = offsets + np.arange(n + 1)
        own[at[:-1]] = own[at[1:] - 1] = False
        number[own] = coded.indices.to_numpy()
        number[at[:-1]] = len(distinct) + np.arange(n)
        number[at[1:] - 1] = len(distinct) + n
        every = [*ids, *first, np.array([end_id], "<u4").tobytes()]
        lengths = np.fromiter(map(len, every), np.int64, len(every)) >> 2
        starts = np.cumsum(lengths) - lengths
        size = lengths[number]
        ends = np.cumsum(size)
        flat = np.frombuffer(b"".join(every), "<u4")
        return flat[np.arange(ends[-1] if n else 0) + np.repeat(starts[number] - (ends - size), size)], np.diff(np.concatenate([[0], ends[at[1:] - 1]])) if n else np.zeros(0, np.int64)


def _listed(chunks: pa.Array) -> list[str]:
    """Strings without blanks as a list: joined by blanks and split again, which is faster than one by one."""
    n = len(chunks)
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, n], pa.int64()), chunks), " ")[0].as_py().split(" ") if n else []


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, from row, to row, ids, sizes) of slices of the column ``text`` of a task's batches; null reads as empty.

    After the last batch most chunks are forgotten, as idle workers would hold them while other stages run.
    """
    own = encoder(path)
    try:
        for batch in batches:
            for i, j, part in text_slices(batch["text"], SLICE_BYTES):
                yield batch, i, j, *own.encode(part, end_id)
    finally:
        own.rest()


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


@cache
def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path)


def vocabulary_path(path: str | None) -> str:
    """The tokenizer file; the public byte-level BPE vocabulary unless named."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
