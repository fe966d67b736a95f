"""Token ids of whole texts, piece by piece, for the Python tasks of the token operators.

Both tokenizers cut a text into pre-tokens before they merge.  No pre-token crosses a
place where a single space or newline stands between two characters that are not white
space, so a text may be cut there: the ids of the pieces, joined, are the ids of the text.
Each distinct piece is encoded once per task and kept in a memo of bounded size.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Entries of a memo before it is emptied, and characters of a text handled at a time.
MEMO, SLICE = 1_000_000, 1 << 20
#: Pieces whose pre-tokens are plain under any version of the character tables: letters of
#: Latin-1 after a space or not, then marks of ASCII.
LATIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut only where it may be cut."""
    at = 0
    while len(text) - at > 2 * size:
        cut = CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Pieces:
    """Values of pieces (their ids, or how many) by memo.

    ``encode`` maps a list of pieces to the list of their values.  ``spaces`` says whether
    a piece keeps the white space before it (byte-level vocabularies) or loses it.
    """

    def __init__(self, encode: Callable[[list[str]], list], spaces: bool):
        self.encode, self.spaces = encode, spaces
        self.after: dict[str, object] = {}  # by the piece without the space before it
        self.own: dict[str, object] = {}  # by the exact piece

    def _learn(self, memo: dict, keys: list[str], texts: list[str]) -> dict:
        """The values of new pieces, which the memo, emptied if it is full, takes up."""
        learned = dict(zip(keys, self.encode(texts)))
        if len(memo) + len(keys) > MEMO:
            memo.clear()
        memo.update(learned)
        return learned

    def _exact(self, pieces: list[str]) -> list:
        out = list(map(self.own.get, pieces))
        if None in out:
            new = list({p for p, v in zip(pieces, out) if v is None})
            learned = self._learn(self.own, new, new)
            out = [learned[p] if v is None else v for p, v in zip(pieces, out)]
        return out

    def _regular(self, piece: str) -> bool:
        body = piece[1:] if piece[:1] == "\n" else piece
        return bool(body) and not body[0].isspace() and not body[-1].isspace()

    def values(self, text: str) -> list:
        """The values of the pieces of a text, in order."""
        if not text:
            return []
        if not self.spaces:
            pieces, head = text.replace("\n", " ").split(" "), []
        else:
            pieces = text.replace("\n", " \n").split(" ")
            if pieces[0] == "":
                pieces, head = pieces[1:], []
            else:
                head = self._exact(pieces[:1]) if self._regular(pieces[0]) and text[0] != "\n" else None
                pieces = pieces[1:]
        get = self.after.get
        out = list(map(get, pieces))
        if None in out:
            new = list({p for p, v in zip(pieces, out) if v is None})
            if self.spaces:
                new = [p for p in new if self._regular(p)]
                learned = self._learn(self.after, new, [p if p[0] == "\n" else " " + p for p in new])
            else:
                learned = self._learn(self.after, new, new)
            out = [learned.get(p) if v is None else v for p, v in zip(pieces, out)]  # the memo may have been emptied
        if head is None or None in out:  # runs of white space: cut where that is allowed
            return self._exact(CUT.split(text))
        return head + out


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow
    from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


@lru_cache(maxsize=2)  # kept by a worker from task to task
def id_pieces(path: str, spaces: bool) -> Pieces:
    """Pieces whose values are their ids as little-endian 32-bit bytes.

    The pre-tokens of plain pieces (LATIN) are known, so the model's merges run on them
    at once; all other pieces take the whole way through the library.
    """
    tok = load(path)
    table, merge, marks = byte_alphabet(), tok.model.tokenize, {}

    def merged(pre: str) -> list[int]:
        if pre.isascii():
            return [t.id for t in merge("Ġ" + pre[1:] if pre[0] == " " else pre)]
        return [t.id for t in merge(pre.encode().decode("latin-1").translate(table))]

    def encode(texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        slow = []
        for i, t in enumerate(texts):
            plain = LATIN.fullmatch(t)
            if plain is None:
                slow.append(i)
                continue
            word, end = plain.groups()
            ids = merged(word if spaces else word.lower().lstrip(" "))
            if end:
                if end not in marks:
                    if len(marks) > 10_000:
                        marks.clear()
                    marks[end] = merged(end)
                ids = ids + marks[end]
            out[i] = packed(ids)
        for i, e in zip(slow, tok.encode_batch([texts[i] for i in slow], add_special_tokens=False)):
            out[i] = packed(e.ids)
        return out

    return Pieces(encode, spaces)


def ids_of(pieces: Pieces, text: str) -> bytes:
    """All ids of a text, as little-endian 32-bit bytes."""
    return b"".join(v for part in slices(text) for v in pieces.values(part))
