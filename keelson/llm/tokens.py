"""Token ids by the public tokenizers, with the repeated work done once for each distinct string.

A vocabulary's path is a parameter. Texts are split into words in Arrow and the words of a group of texts become a dictionary,
so what follows costs by distinct words: they are split into the pieces that the library would merge one by one, also in
Arrow, and those not known from the groups before go through the library, many by one call. The ids are those of the library:
every string with a character for which the split here isn't known to agree with the library's goes through it whole.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters for which normalisation is lower-casing only and the classes of all libraries agree: ASCII, the Latin
#: letters before U+0180 (without U+0130, whose lower case is two characters) and general punctuation.
SAFE = [chr(c) for r in ((9, 11), (13, 14), (0x20, 0x7F), (0xA1, 0x130), (0x131, 0x180), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0)) for c in range(*r)]
#: Pieces whose ids are kept from one group of texts to the next, those of the last groups first, and the bytes of the longest.
CACHE, LONGEST = 300_000, 64
#: Pieces that the library merges at once.
MERGED = 1 << 15
#: Bytes of text split into words at once.
AT_ONCE = 4 << 20
#: Marks the end of a piece while words are split; not a safe character.
_END = "\x1f"


def _class(chars: list[str]) -> str:
    return "".join(re.escape(c) for c in chars)


_BLANK = re.compile(rb"[\t-\r ]")
_LETTERS = _class([c for c in SAFE if unicodedata.category(c)[0] == "L"])
_NUMBERS = _class([c for c in SAFE if unicodedata.category(c)[0] == "N"])
_UNSAFE = f"[^{_class(SAFE)}]"
#: The split of the vocabulary with word ends (fixed value), and the same for safe characters within a word.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_PIECES = rf"('s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+)"

#: The split of the byte-level vocabulary (fixed value), and the same for safe characters of a word and one blank before it.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE_PIECES = rf"('s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+)"
#: A piece of letters with a blank in front.
_WORD = rf"^ [{_LETTERS}]+$"
#: A blank within other white space.
_WIDE = r"[\s\x0b\x85\p{Z}] [\s\x0b\x85\p{Z}]"


class Ids:
    """Lists of ids, one after the other: list i is flat[edges[i] : edges[i + 1]]."""

    def __init__(self, flat: np.ndarray, edges: np.ndarray):
        self.flat, self.edges = flat, edges

    @classmethod
    def of(cls, lists: list[bytes], dtype: np.dtype) -> Ids:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // dtype.itemsize
        return cls(np.frombuffer(b"".join(lists), dtype=dtype), np.concatenate(([0], np.cumsum(sizes))))

    def take(self, index: np.ndarray) -> Ids:
        """The lists at index, in that order."""
        first = self.edges[:-1][index]
        sizes = self.edges[1:][index] - first
        edges = np.concatenate(([0], np.cumsum(sizes)))
        return Ids(self.flat[np.repeat(first - edges[:-1], sizes) + np.arange(edges[-1])], edges)

    def merged(self, edges: np.ndarray) -> Ids:
        """Lists joined: the new list i is the old ones from edges[i] to edges[i + 1]."""
        return Ids(self.flat, self.edges[edges])

    def replaced(self, mine: pa.BooleanArray, others: Ids, every: bool = True) -> Ids:
        """These lists where mine holds, and the others, in order, where it doesn't. every: these have lists for all places."""
        own = mine.to_numpy(zero_copy_only=False)
        index = np.arange(len(own)) if every else np.cumsum(own) - 1
        index[~own] = len(self.edges) - 1 + np.arange(len(own) - own.sum())
        return self.then(others).take(index)

    def then(self, others: Ids) -> Ids:
        return Ids(np.concatenate((self.flat, others.flat)), np.concatenate((self.edges, self.edges[-1] + others.edges[1:])))

    def bytes(self) -> list[bytes]:
        data, step = self.flat.tobytes(), self.flat.dtype.itemsize
        edges = (self.edges * step).tolist()
        return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


class _Known:
    """Ids of the CACHE pieces that were asked for last."""

    def __init__(self, dtype: np.dtype):
        self.pieces, self.ids = pa.array([], pa.string()), Ids.of([], dtype)

    def get(self, pieces: pa.StringArray, make) -> Ids:
        """make: the ids of pieces that aren't known."""
        at = pc.index_in(pieces, value_set=self.pieces)
        there = at.is_valid()
        found = self.ids.take(at.drop_null().to_numpy()).replaced(there, make(pieces.filter(pc.invert(there))), every=False)
        others = np.nonzero(~pc.is_in(self.pieces, value_set=pieces).to_numpy(zero_copy_only=False))[0][: max(0, CACHE - len(pieces))]
        short = pc.less_equal(pc.binary_length(pieces), LONGEST)
        self.pieces = pa.concat_arrays([pieces.filter(short), self.pieces.take(pa.array(others))])
        self.ids = found.take(np.nonzero(short.to_numpy(zero_copy_only=False))[0]).then(self.ids.take(others))
        return found


def _distinct(found: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """A list array's edges, its values as places in a dictionary, and the dictionary."""
    edges = found.offsets.to_numpy().astype(np.int64)
    coded = found.flatten().dictionary_encode()
    return edges - edges[0], coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _split(words: pa.StringArray, pattern: str) -> pa.ListArray:
    """The pieces of safe words. The list of each ends with an empty piece."""
    return pc.split_pattern(pc.replace_substring_regex(words, pattern, rf"\1{_END}"), _END)


def row_slices(texts: pa.BinaryArray):
    """Neighbouring rows (first, end) of AT_ONCE bytes of text or little more, a longer text with those before it."""
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(total):
        end = min(int(np.searchsorted(total, (total[first - 1] if first else 0) + AT_ONCE)) + 1, len(total))
        yield first, end
        first = end


def _groups(texts: list[bytes]):
    """(texts, whether they are parts of one) of at most AT_ONCE bytes; a longer text is cut before white space."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > AT_ONCE:
            yield group, False
            group, size = [], 0
        if len(text) > AT_ONCE:
            yield list(_parts(text)), True
            continue
        group.append(text)
        size += len(text)
    if group:
        yield group, False


def _parts(text: bytes):
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + AT_ONCE)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


def _strings(texts: list[bytes]) -> pa.StringArray:
    """texts as strings; bytes that aren't UTF-8 become U+FFFD."""
    try:
        return pa.array(texts, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode(errors="replace") for t in texts], pa.string())


class WordEncoder:
    """Ids of a `tokenizers` file as little-endian unsigned 32-bit integers, as its encode(text, add_special_tokens=False)
    gives them: special tokens that stand in a text are themselves.

    Its normaliser and split treat what stands between white space alone, so the ids of a text are those of its words.
    """

    dtype = np.dtype("<u4")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        kind = json.loads(self.library.to_str())
        norms = [x["type"] for x in (kind.get("normalizer") or {}).get("normalizers", [])]
        splits = (kind.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        added = kind.get("added_tokens") or []
        plain = all(not x["normalized"] and _BLANK.search(x["content"].encode()) is None for x in added)
        self.fast = norms == ["NFC", "Replace", "Lowercase"] and splits[0].get("pattern") == {"Regex": WORD_SPLIT} and plain
        if self.fast:  # the same merges for pieces that are normalised and split already, with blanks between them
            self.unsafe = "|".join([_UNSAFE, *[re.escape(x["content"]) for x in added]])
            kind["normalizer"] = kind["post_processor"] = None
            kind["added_tokens"] = []
            splits[0] = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
            self.merger = Tokenizer.from_str(json.dumps(kind))
            self.known = _Known(self.dtype)

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, dtype=self.dtype).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, pieces: pa.StringArray) -> Ids:
        """The ids of pieces that aren't empty, MERGED by one call, as the library keeps much beside an id."""
        flat, edges, total = [], [np.zeros(1, dtype=np.int64)], 0
        for at in range(0, len(pieces), MERGED):
            part = pieces.slice(at, MERGED)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")[0].as_py()
            made = self.merger.encode(text, add_special_tokens=False)
            flat.append(np.asarray(made.ids, dtype=self.dtype))
            edges.append(total + np.searchsorted(np.asarray(made.word_ids, dtype=np.int64), np.arange(1, len(part) + 1)))
            total += len(flat[-1])
        return Ids(np.concatenate(flat) if flat else np.zeros(0, dtype=self.dtype), np.concatenate(edges))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8), as bytes."""
        if not self.fast:
            return self._plain([t.decode(errors="replace") for t in texts])
        out: list[bytes] = []
        for group, parts in _groups(texts):
            edges, places, words = _distinct(pc.ascii_split_whitespace(_strings(group)))
            made = self._of_words(words).take(places).merged(edges).bytes()
            out += [b"".join(made)] if parts else made
        return out

    def _of_words(self, words: pa.StringArray) -> Ids:
        odd = pc.match_substring_regex(words, self.unsafe)
        edges, places, pieces = _distinct(_split(pc.utf8_lower(pc.if_else(odd, "", words)), _WORD_PIECES))
        some = pc.not_equal(pieces, "")
        none = Ids.of([b""] * pc.sum(pc.invert(some)).as_py(), self.dtype) if len(pieces) else Ids.of([], self.dtype)
        found = self.known.get(pieces.filter(some), self._merged).replaced(some, none, every=False).take(places).merged(edges)
        return found.replaced(pc.invert(odd), Ids.of(self._plain(words.filter(odd).to_pylist()), self.dtype)) if pc.any(odd).as_py() else found


class ByteEncoder:
    """Ids of a byte-level vocabulary file of ranks (`tiktoken`), as little-endian unsigned 16-bit integers if they fit.

    A text is cut before every blank, and what stands between is split for itself: the split joins nothing across such a place
    but where white space stands on both sides of the blank. Texts with such a place go through the library.
    """

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = pattern or public_tokenizers.PATTERN
        self.size = len(ranks)
        self.dtype = np.dtype("<u2" if len(ranks) < 2**16 else "<u4")
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.fast = pattern == public_tokenizers.PATTERN == BYTE_SPLIT
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]

    def _plain(self, texts: list[str]) -> list[bytes]:
        one, dtype = self.library.encode_ordinary, self.dtype
        return [np.asarray(one(t), dtype=dtype).tobytes() for t in texts]

    def _of_pieces(self, pieces: pa.StringArray) -> Ids:
        """Words with a blank in front are one text for the library, as each blank begins a piece; where its ids part is known
        from the lengths of their bytes."""
        simple = pc.match_substring_regex(pieces, _WORD)
        words, rest = pieces.filter(simple), pieces.filter(pc.invert(simple))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_py()
        ids = np.asarray(self.library.encode_ordinary(text), dtype=self.dtype)
        ends = np.cumsum(pc.binary_length(words).to_numpy())
        found = Ids(ids, np.concatenate(([0], np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1)))
        return found.replaced(simple, Ids.of(self._plain(rest.to_pylist()), self.dtype), every=False)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8), as bytes."""
        if not self.fast:
            return self._plain([t.decode(errors="replace") for t in texts])
        out: list[bytes] = []
        for group, parts in _groups(texts):
            if parts:  # cut before white space of any kind: only the library knows what it joins there
                out += self._plain([b"".join(group).decode(errors="replace")])
                continue
            strings = _strings(group)
            wide = pc.match_substring_regex(strings, _WIDE)
            # a blank in front stands for the one that splitting takes away; the first word of a text has none
            edges, places, words = _distinct(pc.split_pattern(pc.if_else(wide, "", strings), " "))
            first = edges[:-1]
            starts, which = np.unique(places[first], return_inverse=True)
            ids = self._of_words(pc.binary_join_element_wise("", words, " "))
            bare = self._of_words(words.take(pa.array(starts)))
            places[first] = len(words) + which
            made = ids.then(bare).take(places).merged(edges).bytes()
            for i in np.nonzero(wide.to_numpy(zero_copy_only=False))[0].tolist():
                made[i] = self._plain([strings[i].as_py()])[0]
            out += made
        return out

    def _of_words(self, words: pa.StringArray) -> Ids:
        odd = pc.match_substring_regex(words, rf"{_UNSAFE}|[\t-\r]|^ $|^$")
        edges, places, pieces = _distinct(_split(pc.if_else(odd, "", words), _BYTE_PIECES))
        found = self._of_pieces(pieces).take(places).merged(edges)
        return found.replaced(pc.invert(odd), Ids.of(self._plain(words.filter(odd).to_pylist()), self.dtype))

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_ENCODERS: dict = {}


def encoder(kind: type, path: str):
    """One encoder per process and file."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]


def public_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
