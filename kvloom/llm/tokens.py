"""Token ids of whole texts from memoised segments that the pre-tokenisers can never join.

A single space between two characters that aren't white space always starts a new piece in a byte-level
pattern, and white space always ends one in the lower-casing word vocabulary. So a text's ids are those of its
segments in turn, and a segment seen before costs one dictionary lookup. Ids are kept as little-endian uint16.
"""

from __future__ import annotations

import codecs
import json
import re
import string
import sys
import unicodedata
from array import array

import numpy as np

from kvloom.llm.common import blocks, once  # noqa: F401  used by the operators

#: White space of Python or of the tokenisers besides space and newline; fixed values.
OTHER_SPACE = "".join(map(chr, [0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WIDE_SPACE = [c for c in OTHER_SPACE if not "\x09" <= c <= "\x0d"]
#: Characters of texts whose words are numbered together; longer texts are taken word by word.
TOGETHER = 1 << 21
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: What may stand after a word's letters and is a piece of its own, or several; the underscore belongs to words in some patterns.
STOPS = string.punctuation.replace("_", "")


class Memo(dict):
    """work(key) for any key, kept for the last `most` to 2 * `most` keys used.

    A word and the stops after it are put together from both each time and not kept, so that words stay once. stops: ids
    of stops; words: work for a list of words of letters; kept: whether such a word stays letters when it is normalised.
    """

    def __init__(self, work, most: int = 350_000, stops: Memo | None = None, *, words, kept=str.isalpha):
        super().__init__()
        self.work, self.most, self.old = work, most, {}
        self.stops = self if stops is None else stops
        self.words, self.kept = words, kept

    def __missing__(self, key):
        word = key.rstrip(STOPS)
        if len(word) < len(key) and word.isalpha() and self.kept(word):
            return self[word] + self.stops[key[len(word) :]]
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def many(self, keys: list[str]) -> list[bytes]:
        """work(key) of each key; new words of letters, with stops or without, are worked on together."""
        got = list(map(self.get, keys))
        late = [i for i, value in enumerate(got) if value is None]
        words, new = [keys[i].rstrip(STOPS) for i in late], {}
        for word in words:
            if word.isalpha() and word not in self:
                new[word] = self.old.get(word)
        unknown = [word for word, value in new.items() if value is None]
        new.update(zip(unknown, self.words(unknown)))
        for i, word in zip(late, words):
            if word.isalpha() and (len(word) == len(keys[i]) or self.kept(word)):
                value = new[word] if word in new else self[word]
                got[i] = value + self.stops[keys[i][len(word) :]] if len(word) < len(keys[i]) else value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self.update(new)
        for i in late:
            if got[i] is None:
                got[i] = self[keys[i]]
        return got


def plain(text: str) -> bool:
    """Whether each space stands alone and newline is the only other white space."""
    return not ("  " in text or " \n" in text or "\n " in text or any(c in text for c in OTHER_SPACE))


def stays_letters(word: str) -> bool:
    """Whether a word of letters holds nothing else after NFC and lower-casing; a mark at its end would join a stop."""
    return word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha()


def looked_up(lists, memo: Memo) -> list[bytes]:
    """Ids of an Arrow array of lists of words: Arrow numbers the words, and each different one is looked up once."""
    words = lists.values.dictionary_encode()
    got = memo.many(words.dictionary.to_numpy(zero_copy_only=False).tolist())
    size = np.fromiter(map(len, got), np.int64, len(got)) >> 1
    pool, start, number = np.frombuffer(b"".join(got), "<u2"), np.cumsum(size) - size, words.indices.to_numpy()
    count = size[number]
    ends = np.append(0, np.cumsum(count))
    flat = pool[np.repeat(start[number] - ends[:-1], count) + np.arange(ends[-1])]
    bounds = ends[lists.offsets.to_numpy()].tolist()
    return [flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


class SpacedSegments:
    """Ids by a byte-level vocabulary; encode(segment) -> uint16 bytes is asked once for each new segment."""

    def __init__(self, encode, most: int = 350_000):
        self.encode, self.added = encode, getattr(encode, "added", lambda text: None)
        self.bare = Memo(lambda part: self.divided(part, ""), most // 4, words=lambda words: list(map(encode, words)))
        self.after_space = Memo(lambda part: self.divided(part, " "), most, self.bare, words=lambda words: [encode(" " + word) for word in words])

    def divided(self, part: str, lead: str) -> bytes:
        """Ids of lead + part; a newline amid the part is a piece of its own, as is the stop at a word's end."""
        if "\n" in part:
            lines = part.split("\n")
            if all(lines) and not any(c.isspace() for x in lines for c in (x[0], x[-1])):
                first = (self.after_space if lead else self.bare)[lines[0]]
                return first + b"".join(self.bare["\n"] + self.bare[x] for x in lines[1:]) if part != "\n" else self.encode(lead + part)
        return self.encode(lead + part)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.added(text):
            return self.encode.all_of(text)
        parts = text.split(" ") if plain(text) else LONE_SPACE.split(text)
        first = self.bare[parts[0]] if parts[0] else b""
        return first + b"".join(map(self.after_space.__getitem__, parts[1:]))

    def many(self, texts: list[str]) -> list[bytes]:
        """ids() of each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out = [b""] * len(texts)
        for first, part in blocks(texts, TOGETHER):
            some, counts, heads, rests = [], [], [], []
            for i, text in enumerate(part, first):
                if not text or len(text) >= TOGETHER or not plain(text) or self.added(text):
                    out[i] = self.ids(text)
                    continue
                lines = text.split("\n")
                lines = lines if all(lines) else [text]
                some.append(i)
                counts.append(len(lines))
                for line in lines:
                    head, space, rest = line.partition(" ")
                    heads.append(head)
                    rests.append(rest if space else None)
            start = iter(self.bare.many([head for head in heads if head]))
            tails = looked_up(pc.split_pattern(pa.array([rest for rest in rests if rest is not None], pa.large_string()), " "), self.after_space)
            tail, newline, at = iter(tails), b"", 0
            whole = [(next(start) if head else b"") + (b"" if rest is None else next(tail)) for head, rest in zip(heads, rests)]
            for i, count in zip(some, counts):
                if count > 1:
                    newline = newline or self.bare["\n"]
                out[i] = newline.join(whole[at : at + count])
                at += count
        return out


class WordSegments:
    """Ids by a vocabulary that drops white space; encode(word) -> uint16 bytes is asked once for each new word."""

    def __init__(self, encode, most: int = 350_000):
        self.encode = encode
        self.memo = Memo(lambda word: encode(word) if word else b"", most, words=lambda words: list(map(encode, words)), kept=stays_letters)

    def ids(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f") or self.encode.added(text):  # white space to Python alone; added tokens
            return self.encode.all_of(text)
        return b"".join(map(self.memo.__getitem__, text.split()))

    def many(self, texts: list[str]) -> list[bytes]:
        """ids() of each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out = [b""] * len(texts)
        for first, part in blocks(texts, TOGETHER):
            some = []
            for i, text in enumerate(part, first):
                if len(text) >= TOGETHER or any(c in text for c in WIDE_SPACE) or self.encode.added(text):
                    out[i] = self.ids(text)
                else:
                    some.append(i)
            words = pc.ascii_split_whitespace(pa.array([texts[i] for i in some], pa.large_string()))
            for i, ids in zip(some, looked_up(words, self.memo)):
                out[i] = ids
        return out


def pack_ids(ids: list[int]) -> bytes:
    """Ids as little-endian uint16."""
    packed = array("H", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class LibraryEncoder:
    """Segments by the tokenizers library: its BPE model for plain words, its whole pipeline for all else.

    The library takes the vocabulary's added tokens for themselves wherever they stand in a text, some of them with
    the space around them; `added()` finds texts that may hold one, which have to be encoded as a whole.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(content)
        self.model, self.normalizer = self.whole.model, self.whole.normalizer
        self.tokenize = self.model.tokenize
        letters = byte_letters()
        self.table, self.packed = "".join(letters[b] for b in range(256)), [i.to_bytes(2, "little") for i in range(1 << 16)]
        steps = json.loads(self.normalizer.__getstate__()) if self.normalizer else {"normalizers": []}
        kinds = {x["type"] for x in steps.get("normalizers", [steps]) if x.get("pattern") != {"Regex": r"\s+"}}
        #: What the normalizer makes of ASCII letters, None where it isn't known to keep or lower-case them.
        self.ascii = None if kinds - {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"} else str.lower if "Lowercase" in kinds else str
        tokens = [t for t in self.whole.get_added_tokens_decoder().values() if t.content]
        self.exact = [t.content for t in tokens if not t.normalized]
        self.folded = [t.content.lower() for t in tokens if t.normalized]

    def added(self, text: str) -> bool:
        """Whether an added token may stand in the text."""
        return any(x in text for x in self.exact) or (bool(self.folded) and any(x in text.lower() for x in self.folded))

    def all_of(self, text: str) -> bytes:
        return pack_ids(self.whole.encode(text, add_special_tokens=False).ids)

    def __call__(self, segment: str) -> bytes:
        if not self.normalizer:
            if (segment[1:] if segment[:1] == " " else segment).isalpha():
                return self.ids_of(codecs.charmap_decode(segment.encode(), "strict", self.table)[0])
            return self.all_of(segment)
        if self.ascii and segment.isascii() and segment.isalpha():  # letters stand for themselves
            return self.ids_of(self.ascii(segment))
        word = self.normalizer.normalize_str(segment)
        if word.isalpha():
            return self.ids_of(codecs.charmap_decode(word.encode(), "strict", self.table)[0])
        return self.all_of(segment)

    def ids_of(self, spelt: str) -> bytes:
        """Ids of a piece in the letters of its bytes, by the library's model."""
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(spelt)])


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
