"""Whole-text encoding with a fixed public tokenizer file.

Between two white-space runs the pre-tokenizers of the supported files never
look across a boundary, so a text is encoded chunk by chunk and every chunk's
ids are kept as little-endian bytes in a per-process cache.  A cache miss is
encoded by the ``tokenizers`` library.  Arrow cuts a group of texts into
chunks, numbers the different ones and puts their ids together, so Python
looks a chunk up once a group.  Texts whose white space is not made of
single spaces and line feeds, or that hold the string of a special token, are
given to the library whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .base import take_over

#: entries of a process-wide cache
CACHE_ENTRIES = 700_000

#: texts, and characters, that are encoded together
GROUP_TEXTS, GROUP_CHARS = 128, 2_000_000
#: the same where Arrow cuts them
ARROW_TEXTS, ARROW_CHARS = 8192, 8_000_000

#: words of one call of the library, which takes far more memory than their ids
CALL_WORDS = 8_000

#: white space other than the space and the line feed, as ``str.isspace`` has it
OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]


def irregular(text: str) -> bool:
    """Whether some white space is not a single space or line feed between
    two other characters."""
    return ("  " in text or "\n\n" in text or " \n" in text or "\n " in text
            or text[0] in " \n" or text[-1] in " \n" or any(c in text for c in OTHER_SPACE))


class SeenTwice:
    """A bounded cache that keeps what came up in two groups of texts; most
    different words come up once.  ``known`` is read directly: put what
    :meth:`missing` names in it, use it, then :meth:`settle`.  With ``twice``
    false everything is kept at once, for what is dear to compute."""

    SLOTS = 1 << 22

    def __init__(self, entries: int = CACHE_ENTRIES, twice: bool = True):
        self.entries, self.twice, self.known = entries, twice, {}
        self.seen, self.marks = np.zeros(self.SLOTS if twice else 0, np.uint8), 0

    def missing(self, keys: set) -> list:
        return list(keys.difference(self.known))

    def settle(self, added: list) -> None:
        known = self.known
        if self.twice and added:
            slots = np.fromiter(map(hash, added), np.int64, len(added)) & (self.SLOTS - 1)
            new = self.seen[slots] == 0
            self.seen[slots] = 1
            for k in compress(added, new.tolist()):
                del known[k]
            self.marks += int(new.sum())
            if self.marks > self.SLOTS // 4:
                self.seen, self.marks = np.zeros(self.SLOTS, np.uint8), 0
        if len(known) > self.entries:
            known.clear()


def grouped(texts: list[str | None], most_texts: int = GROUP_TEXTS,
            most_chars: int = GROUP_CHARS) -> Iterator[list[str]]:
    """The texts (null: empty) in groups that are encoded together."""
    group, chars = [], 0
    for t in texts:
        group.append(t or "")
        chars += len(t or "")
        if len(group) == most_texts or chars > most_chars:
            yield group
            group, chars = [], 0
    if group:
        yield group


def cut_words(lines: list[str | None]) -> tuple[np.ndarray, pa.Array, list[str]]:
    """Lines (null: no words) cut at their spaces: where the words of each line
    end (from 0), the number of each word, the different words by number."""
    parts = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
    words = parts.values.dictionary_encode()
    return (parts.offsets.to_numpy(), words.indices,
            words.dictionary.to_numpy(zero_copy_only=False).tolist())


def put_together(known: dict[str, bytes], ends: np.ndarray, places: pa.Array, keys: list[str]) -> list[bytes]:
    """The ids of each line out of those of its words."""
    ids = pa.array(map(known.__getitem__, keys), pa.large_binary(), size=len(keys))
    _, at, data = ids.take(places).buffers()
    if not data:                           # no words, or none with ids
        return [b""] * (len(ends) - 1)
    data, cuts = memoryview(data), np.frombuffer(at, np.int64)[ends].tolist()
    return [bytes(data[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


#: marks that end a word without joining it
_TAIL = ".,;:!?*#%&$|"


def _pack(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


class ChunkEncoder:
    """ids of whole texts as ``<u4`` bytes.

    ``spaces_matter`` is true for byte-level vocabularies (a word owns the
    space before it) and false where the file drops white space.  Strings of
    special tokens become those tokens, as the library has it, unless
    ``plain_special``.
    """

    def __init__(self, path: str, spaces_matter: bool, plain_special: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain_special
        self.special = [] if plain_special else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.spaces_matter = spaces_matter
        self.chunks = SeenTwice()
        self.stems = SeenTwice(500_000)
        self.tails: dict[str, bytes] = {}
        self.lowered = None
        if not spaces_matter:              # for words that the file's normaliser leaves as they are
            self.lowered = Tokenizer(self.tok.model)
            self.lowered.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(False, use_regex=False)])
        self.line = self.whole("\n")
        vocab = self.tok.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)  # ids that open (close) a word
        for token, i in vocab.items():
            self.edge[i] = token.startswith("\u0120") if spaces_matter else token.endswith("</w>")

    def whole(self, text: str) -> bytes:
        return _pack(self.tok.encode(text, add_special_tokens=False).ids)

    def _stem_ids(self, stems: list[str]) -> dict[str, bytes]:
        """Many words of letters only in one call; each is one pre-token, and
        its first (last) id tells where it begins (ends).  A stem that opens a
        line has a line feed before it and no space."""
        out, lowered, spaced, opening = {}, [], [], []
        for s in stems:
            (opening if s[0] == "\n" else lowered if self.lowered and (
                s.islower() if s.isascii() else s == s.lower() and _latin1(s)) else spaced).append(s)
        for tok, words in ((self.lowered, lowered), (self.tok, spaced)):
            for at in range(0, len(words), CALL_WORDS):
                out.update(self._word_ids(tok, words[at:at + CALL_WORDS]))
        if opening:
            data = self.whole("".join(opening))
            at = np.flatnonzero(np.frombuffer(data, "<u4") == np.frombuffer(self.line, "<u4")[0])
            cuts = (np.append(at, len(data) // 4) * 4).tolist()
            for s, lo, hi in zip(opening, cuts, cuts[1:]):
                out[s] = data[lo:hi]
        return out

    def _word_ids(self, tok, words: list[str]) -> dict[str, bytes]:
        """Words that open no line."""
        out = {}
        ids = np.asarray(tok.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.edge[ids])
        if len(at) == len(words):
            data = ids.tobytes()
            cuts = ((np.append(at, len(ids)) if self.spaces_matter else np.append(0, at + 1)) * 4).tolist()
            for s, lo, hi in zip(words, cuts, cuts[1:]):
                out[s] = data[lo:hi]
        else:                              # a letter that the file's normaliser splits or drops
            for s in words:
                out[s] = self.whole(" " + s)
        return out

    def _learn(self, missing: list[str]) -> None:
        """Put the ids of chunks into the cache."""
        tails, known, odd, matter = self.tails, self.chunks.known, [], self.spaces_matter
        stems = [p.rstrip(_TAIL) for p in missing]
        plain = [s.isalpha() and (matter or s.isascii() or normalize("NFC", s).lower().isalpha())
                 or s[:1] == "\n" and s[1:].isalpha() for s in stems]
        new = self.stems.missing(set(compress(stems, plain)))
        ids = self.stems.known
        if new:
            ids.update(self._stem_ids(new))
        for p, stem, ok in zip(missing, stems, plain):
            if not ok:
                odd.append(p)
            elif p is stem:
                known[p] = ids[stem]
            else:
                tail = p[len(stem):]
                if tail not in tails:
                    if len(tails) > 10_000:
                        tails.clear()
                    tails[tail] = self.whole(tail) if tail else b""
                known[p] = ids[stem] + tails[tail]
        self.stems.settle(new)
        if odd:
            texts = ([p if p[:1] == "\n" else " " + p for p in odd] if self.spaces_matter else odd)
            for p, e in zip(odd, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
                known[p] = _pack(e.ids)

    def encode_group(self, texts: list[str], spaced: bool = False) -> list[bytes]:
        """ids of each text or, with ``spaced``, of a space and the text."""
        heads, lines = [], []
        for t in texts:
            low = t.lower() if not self.spaces_matter and _latin1(t) else t
            if any(s in t or s in low for s in self.special) or (self.spaces_matter and (not t or irregular(t))):
                heads.append(self.whole(" " + t if spaced else t))
                lines.append(None)
                continue
            heads.append(None)
            if not self.spaces_matter:
                lines.append(low.replace("\n", " "))
            elif spaced:
                lines.append(t.replace("\n", " \n"))
            else:                          # a line feed before the first word, taken off again below
                lines.append("\n" + t.replace("\n", " \n"))
        found = self.words(*cut_words(lines))
        cut = 0 if spaced or not self.spaces_matter else len(self.line)
        return [d[cut:] if h is None else h for h, d in zip(heads, found)]

    def words(self, ends: np.ndarray, places: pa.Array, keys: list[str]) -> list[bytes]:
        """ids of each line of words that :func:`cut_words` found; a space
        stands before each word, also before the first."""
        known = self.chunks.known
        missing = [k for k in keys if k not in known]
        if missing:
            self._learn(missing)
        out = put_together(known, ends, places, keys)
        if missing:
            self.chunks.settle(missing)
        return out

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """ids of each text in turn."""
        for group in grouped(texts, ARROW_TEXTS, ARROW_CHARS):
            yield from self.encode_group(group)

    def encode(self, text: str | None) -> bytes:
        return self.encode_group([text or ""])[0]


def _latin1(text: str) -> bool:
    """Whether lower case is a matter of single characters here: the file's
    normaliser composes and lowers, so doing the latter first changes nothing
    and fewer different words come up."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_ENCODERS: dict[tuple[str, bool, bool], ChunkEncoder] = {}


def encoder(path: str, spaces_matter: bool, plain_special: bool = False) -> ChunkEncoder:
    """The process-wide encoder of a file (kept over the tasks of a worker)."""
    key = (path, spaces_matter, plain_special)
    take_over("tokenizing", _ENCODERS.clear)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(path, spaces_matter, plain_special)
    return _ENCODERS[key]


def public_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
