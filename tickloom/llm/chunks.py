"""Texts cut into chunks that a tokenizer may take one by one, each looked up once per worker."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse

import numpy as np

from tickloom.llm.shared import hold

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per task

#: Unicode's White_Space, which all the libraries' \s agree on.
WHITE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Latin letters, of which every Unicode table says that they are letters, as are their small ones (so not U+0130); ASCII that is no letter, apostrophe or white space.
LATIN = "A-Za-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x12F), (0x131, 0x24F)))
MARKS = "!-&(-@\\[-`{-~"
#: A chunk is never part of a pre-token: a run of Latin letters or of ASCII marks stands alone only if what follows surely begins another, which
#: an apostrophe doesn't, as contractions are pre-tokens; all else goes up to white space.
_WORDS = rf"[{LATIN}]+(?=[{MARKS}{WHITE}]|\Z)|[{MARKS}]+(?=[{LATIN}{WHITE}]|\Z)|[^{WHITE}]+"
WORD = re.compile(_WORDS)
#: With the one space before it; a run of white space less that space; a lone separator.
CHUNK = re.compile(rf" ?(?:{_WORDS})|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Chunks that every vocabulary's pattern takes as one pre-token.
LATIN_WORD = re.compile(f" ?[{LATIN}]+")
#: Characters of text that are worked on at once, and of chunks in either half of a cache.
GROUP_CHARS, HALF_CHARS = 1 << 20, 3_000_000


def groups(texts: Iterable[str], most: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about so many characters."""
    own: list[str] = []
    size = 0
    for text in texts:
        own.append(text)
        size += len(text)
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


class ChunkCache:
    """What a function makes of each chunk, kept between batches and tasks of a worker: a young half, and an old one whose chunks move up when met.

    """

    def __init__(self, make: Callable[[list[str]], Iterable], half: int = HALF_CHARS, part: int = 20_000):
        self.make, self.half, self.size, self.part = make, half, 0, part
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def lookup(self, lists: list[list[str]]) -> dict[str, object]:
        """A dict that holds every chunk of the lists until the next call."""
        young = self.young
        wanted = set().union(*lists)
        new = set(filterfalse(young.__contains__, wanted))  # a set less a dict's keys goes through all the keys
        if self.size > self.half:
            self.old, self.young, self.size, new = young, {}, 0, wanted
            young = self.young
        met = new & self.old.keys()
        young.update(zip(met, map(self.old.__getitem__, met), strict=True))
        todo = list(new - met)
        for a in range(0, len(todo), self.part):
            part = todo[a : a + self.part]
            young.update(zip(part, self.make(part), strict=True))
        self.size += sum(map(len, new))
        return young


def added_strings(path: str) -> list[str]:
    """The special strings that the library takes out of a text before anything else, longest first."""
    with open(path, encoding="utf-8") as f:
        return sorted((x["content"] for x in json.load(f)["added_tokens"]), key=len, reverse=True)


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if visible, else the next free one from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


LETTERS = byte_letters()
SPACE = LETTERS[0x20]


def byte_level(path: str) -> bool:
    """Whether the file's model takes pre-tokens as byte letters and nothing is put before a text's first word."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    steps = own["pre_tokenizer"] or {}
    last = (steps.get("pretokenizers") or [steps])[-1]
    return own["model"]["type"] == "BPE" and last.get("type") == "ByteLevel" and not last["add_prefix_space"]


def encoder(path: str, between: str) -> Callable[[list[str]], Iterable[bytes]]:
    """Of chunks their ids by the tokenizers library, packed as little-endian unsigned 32-bit integers.

    Latin words go to the library's model at once where they are sure to be one pre-token. Of the rest many chunks go in one call, with
    `between` between them: a string that is one token and a pre-token of its own. Chunks that hold it, white space and what holds a special string go alone.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    strings = added_strings(path)
    (mark,) = library.encode(f"a{between}a", add_special_tokens=False).ids[1:-1]
    bytewise = byte_level(path)
    # The library's own attributes are made anew at each access.
    model, normalizer = library.model, library.normalizer

    def latin(chunk: str) -> bytes:
        word = normalizer.normalize_str(chunk) if normalizer else chunk
        letters = word.replace(" ", SPACE) if word.isascii() else word.encode().decode("latin-1").translate(LETTERS)
        return array("I", [x.id for x in model.tokenize(letters)]).tobytes()

    def direct(chunk: str) -> bool:
        if chunk.isascii():  # most are, and a string's own tests are faster than the pattern
            return chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha()
        return LATIN_WORD.fullmatch(chunk) is not None

    def alone(chunk: str) -> bytes:
        return array("I", library.encode(chunk, add_special_tokens=False).ids).tobytes()

    def make(chunks: list[str]) -> Iterable[bytes]:
        out: list[bytes | None] = [latin(c) if bytewise and direct(c) else None for c in chunks]
        plain = [k for k, c in enumerate(chunks) if out[k] is None and between.strip(" ") not in c and not c.isspace() and not ("<" in c and any(s in c for s in strings))]
        for a in range(0, len(plain), 2_000):
            own = plain[a : a + 2_000]
            ids = np.array(library.encode_batch_fast([between.join([chunks[k] for k in own])], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == mark)
            if len(cuts) == len(own) - 1:
                packed = ids.tobytes()
                for k, begin, end in zip(own, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                    out[k] = packed[4 * begin : 4 * end]
        return [alone(c) if x is None else x for c, x in zip(chunks, out, strict=True)]

    return make


def splitter(strings: list[str]) -> Callable[[str], list[str]]:
    """Chunks of a text; the special strings are chunks of their own, and white space before them belongs to no word."""
    special = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None

    def split(text: str) -> list[str]:
        if special is None or not special.search(text):
            return CHUNK.findall(text)
        out: list[str] = []
        for k, part in enumerate(special.split(text)):
            out += [part] if k % 2 else CHUNK.findall(part)
        return out

    return split


#: Beyond Latin letters.
_FAR = re.compile("[^\x00-\u024f]")


def lowered(strings: list[str]) -> Callable[[str], list[str]]:
    """Words of a text for a vocabulary that drops white space and folds case; Latin text is folded first, so that fewer words differ.

    Special strings keep their case and end the word before them.
    """
    special = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None

    def words(text: str) -> list[str]:
        return WORD.findall(text.lower() if text.isascii() or not _FAR.search(text) else text)

    def split(text: str) -> list[str]:
        if special is None or not special.search(text):
            return words(text)
        out: list[str] = []
        for k, part in enumerate(special.split(text)):
            out += [part] if k % 2 else words(part)
        return out

    return split


class Ids:
    """Whole texts to packed ids, as the tokenizers library gives them for the file at path."""

    def __init__(self, path: str, drop_white: bool = False, half: int = HALF_CHARS):
        strings = added_strings(path)
        self.split = lowered(strings) if drop_white else splitter(strings)
        # Words alone are shorter and more of them differ than chunks with their white space.
        self.cache = ChunkCache(encoder(path, " | " if drop_white else "\n"), 2 * half if drop_white else half)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        for own in groups(texts):
            lists = [self.split(x) for x in own]
            found = self.cache.lookup(lists)
            for chunks in lists:
                yield b"".join(map(found.__getitem__, chunks))


def ids_of(path: str, drop_white: bool = False, half: int = HALF_CHARS) -> Ids:
    """One per worker and file; workers are used again, so its cache serves later tasks."""
    return hold(("ids", path, drop_white, half), lambda: Ids(path, drop_white, half))
