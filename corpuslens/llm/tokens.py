"""Ids of whole texts with public BPE tokenizers, a word at a time.

Both vocabularies cut texts at white space before merging, so ids of a text are
the ids of its blank- or line-separated words, one after the other. A word's ids
are kept in a table of bounded size; only words that it lacks are merged.
Single line ends and blanks between visible characters are all that is cut
here; texts with anything else around them (runs of blanks, blank edges) are
encoded whole. So are texts that hold the string of an added token: as in the
library's plain call, it then becomes that token's id.

Many texts go at once (`each`) where the vocabulary cuts by the rules of
`cut_pieces`: plain characters are lowered and cut into its own pieces as arrays
of bytes, each distinct piece of a group is looked up once, and only pieces that
no group of the task had are merged. Words with any other character are encoded
by themselves, each in its place; texts with an added token, very long ones and
those with many other characters go one by one, as above.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from corpuslens.llm.common import refilled

#: Words that a worker's table holds at most; beyond that, and with each task, it starts anew.
TABLE = 600_000
#: Letters whose lower case and composed form don't depend on what is near.
PLAIN = regex.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: A word that may be cut off: nothing but at most one line end before what is visible at both edges.
EDGED = regex.compile(r"\n?\S(?:.*\S)?", regex.DOTALL)
#: Bytes of texts that are cut at once; longer texts go one by one.
GROUP = 1 << 21
#: Texts in which one of so many characters is not plain go one by one.
DENSE = 8
#: Latin-1 characters whose case, composed form and kind are the same by any rule: letters, visible ASCII and white space.
LETTERS = bytes(b for b in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)] if b not in b"\xd7\xf7")
BLANKS = b"\t\n\r "
PLAIN_BYTES = bytes({*BLANKS, *range(33, 127), *LETTERS})
IS_PLAIN, IS_BLANK = np.isin(np.arange(257), list(PLAIN_BYTES)), np.isin(np.arange(257), list(BLANKS))
LOWER = bytes(ord(chr(b).lower()) if b in LETTERS else b for b in range(256))
BLANK, LETTER, DIGIT, MARK = range(4)
KIND = np.array([LETTER if b in LETTERS else DIGIT if b in b"0123456789" else BLANK if b in BLANKS else MARK for b in range(256)], np.uint8)
#: The rules of a vocabulary that `cut_pieces` follows.
NORMALIZER = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
SPLIT = pre_tokenizers.Split(Regex(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), "removed", invert=True)
PIECES = pre_tokenizers.Sequence([SPLIT, pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])


def cut_pieces(data: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each byte of data: plain ones in lower case, the last two blanks."""
    kind = KIND[data]
    starts = kind == DIGIT
    starts[0] |= kind[0] != BLANK
    starts[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != BLANK)
    at = np.flatnonzero(starts & (data == ord("'")))
    if len(at):  # an apostrophe that starts a piece takes 's, 't, 'm, 'd, 're, 've or 'll with it
        one, two = data[at + 1], data[at + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        starts[at[short | long] + 1] = False
        after = np.concatenate([at[short] + 2, at[long] + 3])
        starts[after] |= kind[after] == LETTER
    return starts


class Ragged(Exception):
    """White space at a word's edge: the text has to be encoded whole."""


class Table(dict):
    """A dict that can be referred to weakly."""


class Words(dict):
    """Ids of words, found when first asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        if len(self) > TABLE:
            self.clear()
        ids = self[word] = self.encoder.cut(word)
        return ids


class Encoder:
    """ids(text) as little-endian bytes of the given width, each(texts) of many."""

    def __init__(self, path: str, width: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.dtype = f"<u{width}"
        self.id_bytes = [k.to_bytes(width, "little") for k in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        self.table = refilled(Words(self))
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {chr(i): level.pre_tokenize_str(chr(i))[0][0] for i in range(32, 256) if chr(i).isprintable() or i == 32}
        self.marks = {x: self.whole(x) for x in (".", ",", "\n")}
        self.pieces = refilled(Table())
        rules = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.pieced = all(rules) and [x.__getstate__() for x in rules] == [NORMALIZER.__getstate__(), PIECES.__getstate__()]
        self.names = np.arange(256, dtype="<u2")  # the vocabulary's character for each byte of UTF-8
        for x in LETTERS.decode("latin-1"):
            self.names[list(x.encode())] = [ord(y) for y in self.bytes_of[x]]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def word(self, word: str, blank: bool) -> bytes:
        """Ids of a word without white space around it, after a blank or not."""
        tail = word[-1:]
        core = word[:-1] if tail == "." or tail == "," else word
        if core.isascii() and core.isalpha():
            own = core.lower() if self.lower else self.bytes_of[" "] + core if blank else core
        elif PLAIN.fullmatch(core):
            own = "".join(map(self.bytes_of.__getitem__, core.lower() if self.lower else " " + core if blank else core))
        else:
            return self.whole(" " * blank + word)
        ids = b"".join([self.id_bytes[t.id] for t in self.tokenize(own)])
        return ids if core is word else ids + self.marks[tail]

    def cut(self, word: str) -> bytes:
        """Ids of what stood between two blanks."""
        if self.lower:
            return self.word(word.strip(" \n"), False) if word else b""
        if not (word.isascii() and word.isalpha() or EDGED.fullmatch(word)):
            raise Ragged
        return self.marks["\n"] + self.word(word[1:], False) if word[0] == "\n" else self.word(word, True)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.added):
            return self.whole(text)
        if self.lower:
            return b"".join(map(self.table.__getitem__, text.replace("\n", " ").split(" ")))
        first, *words = text.replace("\n", " \n").split(" ")
        if not words or first[:1] in ("", "\n") or not EDGED.fullmatch(first):
            return self.whole(text)
        try:
            return self.word(first, False) + b"".join(map(self.table.__getitem__, words))
        except Ragged:
            return self.whole(text)

    def plain(self, text: str) -> tuple[bytes, list[str]] | None:
        """The text in lower case, a byte for each character, and its words with other than plain ones, each a byte 0 there; None if it can't be cut as an array."""
        if not self.pieced or len(text) > GROUP or any(x in text for x in self.added):
            return None
        try:
            row = text.encode("latin-1")
        except UnicodeEncodeError:
            row = b"\0"
        if not row.translate(None, PLAIN_BYTES):
            return row.translate(LOWER), []
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 256)
        other = np.flatnonzero(~IS_PLAIN[codes])
        if len(other) > len(text) // DENSE:
            return None
        blanks = np.flatnonzero(IS_BLANK[codes])
        odd = np.unique(np.searchsorted(blanks, other))
        first, end = np.append(0, blanks + 1)[odd], np.append(blanks, len(codes))[odd]
        codes[first] = 0
        edges = np.zeros(len(codes) + 1, np.int8)
        edges[first + 1] += 1
        edges[end] -= 1
        row = codes[np.cumsum(edges[:-1], dtype=np.int8) == 0].astype(np.uint8).tobytes()
        return row.translate(LOWER), [text[i:j] for i, j in zip(first.tolist(), end.tolist())]

    def merged(self, pieces: list[bytes]) -> Iterator[bytes]:
        """Ids of pieces."""
        if pieces:
            chars = np.frombuffer(b"\n".join(pieces).decode("latin-1").encode(), np.uint8)
            for piece in self.names[chars].tobytes().decode("utf-16-le").split("\n"):
                yield b"".join([self.id_bytes[t.id] for t in self.tokenize(piece)])

    def known(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces; those that the table lacks are merged."""
        own = list(map(self.pieces.get, pieces))
        new = [x for x, ids in zip(pieces, own) if ids is None]
        if len(self.pieces) + len(new) > TABLE:
            self.pieces.clear()
        found = list(self.merged(new))
        self.pieces.update(zip(new, found))
        rest = iter(found)
        return [next(rest) if ids is None else ids for ids in own]

    def group(self, rows: list[bytes], odd: list[str]) -> list[bytes]:
        """Ids of rows: their distinct pieces', put where the pieces are, and those of odd words where a 0 is."""
        whole = b"\n".join([*rows, b"\n"])
        data = np.frombuffer(whole, np.uint8)
        starts, visible = cut_pieces(data), whole.translate(None, BLANKS)
        if not visible:
            return [b""] * len(rows)
        offsets = np.append(np.flatnonzero(starts[KIND[data] != BLANK]), len(visible)).astype("<i8")
        words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(visible)]).dictionary_encode()
        own, which = self.known(words.dictionary.to_numpy(zero_copy_only=False).tolist()), words.indices.to_numpy()
        if odd:
            which = which.copy()
            which[np.frombuffer(visible, np.uint8)[offsets[:-1]] == 0] = len(own) + np.arange(len(odd))
            own += map(self.table.__getitem__, odd)
        pool = np.frombuffer(b"".join(own), self.dtype)
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // pool.itemsize
        n, before = sizes[which], np.cumsum(sizes) - sizes
        ends = np.append(0, np.cumsum(n))
        ids = pool[np.repeat(before[which] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        row_ends = np.cumsum([len(x) + 1 for x in rows])
        cuts = (ends[np.searchsorted(np.flatnonzero(starts), row_ends)] * pool.itemsize).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]

    def each(self, texts: list[str]) -> Iterator[bytes]:
        """ids of every text, in order."""
        rows, odd, size, wait = [], [], 0, []  # wait: what goes out with the rows, None for a row

        def out() -> Iterator[bytes]:
            ids = iter(self.group(rows, odd) if rows else ())
            return (next(ids) if x is None else x for x in wait)

        for text in texts:
            found = self.plain(text)
            wait.append(self.ids(text) if found is None else None)
            if found:
                rows.append(found[0])
                odd += found[1]
                size += len(text)
            if size >= GROUP:
                yield from out()
                rows, odd, size, wait = [], [], 0, []
        yield from out()


@functools.cache
def encoder(name: str = "byte_bpe_50k.json", width: int = 4, path: str | None = None) -> Encoder:
    """One encoder for each worker; path overrides the installed vocabulary of that name."""
    return Encoder(path or public_tokenizers.path(name), width)
