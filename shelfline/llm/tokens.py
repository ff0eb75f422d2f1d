"""Token ids of whole texts by the ``tokenizers`` library, each distinct chunk encoded once a worker and stage.

Both public vocabularies split texts at white space before anything else, so a text's ids
are the ids of its chunks in a row. A worker keeps the ids of chunks that it has met (at most
CACHE_CHUNKS and CACHE_NEWER, about 200 bytes each) and gives the library only new ones, all
in one call. Strings of special tokens in a text are what the library makes of them: slices
that hold one go to it as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from .common import kept_for_stage

#: Chunks whose ids a worker keeps unless told otherwise, and newer ones that it keeps besides until there are so many.
CACHE_CHUNKS, CACHE_NEWER = 250_000, 50_000
#: Characters of texts handled at once.
SLICE = 1 << 20

#: Unicode white space, which Python's own classes extend by four control characters.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: White space beyond single spaces, single line feeds and pairs of these, which is left to the expression below.
_RARE_ASCII = [c for c in WHITE if c.isascii() and c not in " \n"]
_RARE = [c for c in WHITE if c not in " \n"]
_UNEVEN = ("  ", " \n", "\n ", "\n\n\n")
_BYTE_CHUNKS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_CUT = re.compile(f"[^{WHITE}] [^{WHITE}]")
#: Chunks of lower-case letters that neither composition nor lower-casing changes, and punctuation without apostrophes after them:
#: the word vocabulary's own pattern splits these between letters and punctuation, and nowhere else.
_LETTERS = re.compile("([a-zß-öø-ÿа-џ一-龥]+)([!-&(-/:-@\\[-`{-~]*)")
#: Stands between chunks that the word vocabulary encodes in one call; it has a token of its own.
_BAR = b"\x01"


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, byte_level: bool, chunks: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level, self.known, self.newer = byte_level, {}, []
        self.most, self.most_newer = chunks or CACHE_CHUNKS, chunks // 4 if chunks else CACHE_NEWER
        self.chunks = _byte_chunks if byte_level else _word_chunks
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)))
        self.marks = {s[:2] for s in specials}
        if byte_level:
            #: By id: does the token begin a chunk?
            self.edges = np.array([(self.tokenizer.id_to_token(i) or "").startswith(("Ġ", "Ċ")) for i in range(self.tokenizer.get_vocab_size())])
        else:
            (self.bar,) = self._ids(_BAR.decode())
            #: The same merges without the patterns, for words that are split already; and by id: does the token end a word?
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.edges = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])

    def _ids(self, text: str, by=None) -> np.ndarray:
        return np.array((by or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn_words(self, new: set) -> list[bytes]:
        """Ids of new chunks that are letters with punctuation after them, in one call; the others are handed back."""
        plain, others, words, per = [], [], [], []
        for c, m in zip(new, map(_LETTERS.fullmatch, b" ".join(new).decode().split(" "))):
            if m is None:
                others.append(c)
                continue
            word, mark = m.groups()
            plain.append(c)
            words.append(f"{word} {mark}" if mark else word)
            per.append(2 if mark else 1)
        ids = self._ids(" ".join(words), self.words)
        at = np.append(0, np.flatnonzero(self.edges[ids]) + 1)
        if len(at) != sum(per) + 1:
            raise AssertionError("chunks encoded together came apart otherwise")
        at, raw = at[np.append(0, np.cumsum(per, dtype=np.int64))].tolist(), ids.tobytes()
        self.known.update((c, raw[4 * x : 4 * y]) for c, x, y in zip(plain, at, at[1:]))
        if len(self.known) > self.most:
            self.newer += plain
        return others

    def _learn(self, new: set) -> None:
        """Ids of new chunks, in one call for all but odd ones, whose ids could not be told from their neighbours'."""
        known = self.known
        if self.byte_level:
            odd = [c for c in new if c[:1] == "\0" or c == "\n" or c == ""]
            plain = list(new.difference(odd)) if odd else list(new)
            ids = self._ids("".join([c if c[0] == "\n" else " " + c for c in plain]))
            cuts = [*np.flatnonzero(self.edges[ids]).tolist(), len(ids)]
            ends = cuts[1:]
        else:
            left = self._learn_words(new)
            odd = [c for c in left if _BAR in c]
            plain = [c for c in left if _BAR not in c] if odd else left
            ids = self._ids((b" " + _BAR + b" ").join([*plain, b""]).decode())
            ends = np.flatnonzero(ids == self.bar).tolist()
            cuts = [0, *(e + 1 for e in ends)]
        if len(cuts) != len(plain) + 1:
            raise AssertionError("chunks encoded together came apart otherwise")
        raw = ids.tobytes()
        known.update((c, raw[4 * x : 4 * y]) for c, x, y in zip(plain, cuts, ends))
        for c in odd:
            known[c] = self._ids(c[1:] if c[:1] == "\0" else c if self.byte_level else c.decode()).tobytes()
        if len(known) > self.most:
            self.newer += [*plain, *odd]

    def _forget(self) -> None:
        """Past the most that are kept the first chunks met, which the frequent ones are among, stay, and newer ones go in turns."""
        if len(self.newer) > self.most_newer:
            for c in self.newer:
                self.known.pop(c, None)
            self.newer = []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of some texts, handled together: for a megabyte or so, cut longer texts first."""
        self._forget()
        parts = [self.chunks(t) for t in texts]
        found = [list(map(self.known.get, p)) for p in parts]
        gaps = [[i for i, x in enumerate(ids) if x is None] if None in ids else () for ids in found]
        new = {p[i] for p, gap in zip(parts, gaps) for i in gap}
        if new:
            self._learn(new)
        for p, ids, gap in zip(parts, found, gaps):
            for i in gap:
                ids[i] = self.known[p[i]]
        return [b"".join(ids) for ids in found]

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE:
            cut = next(_CUT.finditer(text, at + SLICE), None)
            if cut is None:
                break
            yield text[at : cut.start() + 1]
            at = cut.start() + 1
        yield text[at:]

    def _plain(self, text: str) -> bool:
        return not any(m in text for m in self.marks) or not self.special.search(text)

    def documents(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each whole text, null as the empty text."""
        held: list[str] = []
        size = 0
        for t in texts:
            t = t or ""
            if len(t) > SLICE or not self._plain(t):
                yield from self.encode(held)
                yield b"".join(self.encode([s])[0] if self._plain(s) else self._ids(s).tobytes() for s in self._slices(t))
                held, size = [], 0
                continue
            held.append(t)
            size += len(t)
            if size > SLICE:
                yield from self.encode(held)
                held, size = [], 0
        yield from self.encode(held)


def _byte_chunks(text: str) -> list[str]:
    """Chunks as keys: a word stands for itself after a space, one after a line feed or NUL for itself without one."""
    even = "\0" not in text and text[:1] not in ("", " ", "\n") and text[-1] not in " \n"
    if even and not any(c in text for c in _UNEVEN) and not any(c in text for c in (_RARE_ASCII if text.isascii() else _RARE)):
        out = text.replace("\n", " \n").split(" ")
        out[0] = "\0" + out[0]
        return out
    # White space chunks keep their leading space: only a word's is left out of its key.
    return [c[1:] if c[0] == " " and len(c) > 1 and c[1] not in WHITE and "\0" not in c else "\0" + c for c in _BYTE_CHUNKS.findall(text)]


def _word_chunks(text: str) -> list[bytes]:
    # The white space of bytes.split() is a part of what the vocabulary drops; other white space stays in its chunk.
    # The vocabulary is lower-case, so A-Z are lowered here already, and a chunk has one spelling.
    return text.encode().lower().split()


def encoder(path: str, byte_level: bool, chunks: int | None = None) -> Encoder:
    """The encoder of a stage's tasks: later tasks of the stage in the same worker find the chunks of earlier ones."""
    return kept_for_stage(lambda: Encoder(path, byte_level, chunks))
