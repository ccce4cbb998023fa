"""Exact sub-word encoding through a table of distinct chunks.

Both public BPE files encode a text as the concatenation of what they give for its chunks between single spaces and
line feeds, provided that no run of white space is cut where the pattern would take it whole. So each distinct chunk
is encoded once per worker and then costs one look-up. Chunks of unusual characters go through the library whole, and
texts with odd white space are encoded without the table, so that ids always equal the library's.

A chunk that the table lacks is merged by tiktoken with the file's own vocabulary as ranks, at a fifth of the time that
a call of the library takes. Merging by the rank of the merged string equals merging by the file's list of pairs where
every merged string comes from one pair and ids follow the order of the list: then, whenever two pieces that spell a
merged string are neighbours at its rank, they are that pair. by_rank checks this for the file (and each string's own
pair); a file for which it does not hold is merged by the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken

#: Entries that a worker's table of chunks keeps at most in each of its two generations.
CHUNK_LIMIT = 100_000

_GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The usual one-letter spelling of each byte in byte-level BPE: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


#: Stands for the end of a word in a file that marks it; texts that hold it are left to the library.
_WORD_END = b"\0"


def by_rank(path: str, pattern: str) -> tiktoken.Encoding | None:
    """The file's merges by rank, or None where ranks do not do. A word's end, where the file marks it, is _WORD_END."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte = {c: bytes([b]) for b, c in _byte_letters().items()}
    suffix = model.get("end_of_word_suffix") or ""

    def raw(token: str) -> bytes:
        end = suffix and token.endswith(suffix)
        return b"".join(map(byte.__getitem__, token[: -len(suffix)] if end else token)) + (_WORD_END if end else b"")

    vocabulary, pairs = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merged = [vocabulary.get(a + b if not suffix else a.removesuffix(suffix) + b) for a, b in pairs]
    if model.get("dropout") or model.get("ignore_merges") or None in merged or any(a >= b for a, b in zip(merged, merged[1:])):
        return None
    nul = _byte_letters()[0] if suffix else "\0"
    ids = {raw(t): i for t, i in vocabulary.items() if nul not in t}
    spare = max(vocabulary.values()) + 1
    ids |= {bytes([b]): spare + b for b in range(256) if bytes([b]) not in ids}
    return tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ids, special_tokens={})


#: Distinct chunks whose ids one call gives.
_AT_ONCE = 50_000
_WORD_CHARS = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+")


class _Table(dict):
    """Chunk to packed ids; two generations bound its size, so that frequent chunks stay."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if value is None:
                return b""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _is_word(chunk: str) -> bool:
    """Letters below U+0180 alone, whose lower case is letters too (that of U+0130 holds a mark)."""
    return _WORD_CHARS.fullmatch(chunk) is not None


class Encoder:
    """ids(text) gives the library's ids as packed unsigned 32-bit little-endian integers, without special tokens added."""

    def __init__(self, path: str, limit: int = CHUNK_LIMIT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.words = self.lib.normalizer is not None  # white space is dropped and letters are lowered
        self.pattern = regex.compile(_WORD if self.words else _GPT2)
        self.letters = _byte_letters()
        self.spell = {c: "".join(map(self.letters.__getitem__, chr(c).encode())) for c in range(128, 384)}  # ASCII letters spell themselves
        self.tokenize = self.lib.model.tokenize
        self.ranked = by_rank(path, r"[^\x00]+\x00" if self.words else _GPT2)
        self.merge = self.ranked and self.ranked._encode_single_piece
        if self.ranked:  # whether an id begins a chunk after a space, or closes a word
            known = self.ranked._mergeable_ranks
            self.bound = np.zeros(max(known.values()) + 1, bool)
            self.bound[[i for t, i in known.items() if (t.endswith(_WORD_END) if self.words else t.startswith(b" "))]] = True
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.odd = False
        self.chunks = _Table(self._chunk, limit)
        self.pieces = _Table(self._piece, limit // 4)
        self.marks = {m: self._piece(m) for m in (",", ".")}

    def _pack(self, ids) -> bytes:
        return array("I", ids).tobytes()

    def whole(self, text: str) -> bytes:
        """By the library alone."""
        return self._pack(self.lib.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        if self.merge:
            return array("I", self.merge(piece.encode() + _WORD_END if self.words else piece.encode())).tobytes()
        spelt = "".join(map(self.letters.__getitem__, piece.encode()))
        return self._pack([t.id for t in self.lib.model.tokenize(spelt)])

    def _plain(self, chunk: str) -> bool:
        return (chunk.isascii() or max(chunk) < "ƀ") and chunk.isprintable() and "<|" not in chunk

    def _letters(self, word: str) -> list[int]:
        """A word of plain letters alone: one piece, spelt without a pattern."""
        if self.merge:
            return self.merge(word.lower().encode() + _WORD_END if self.words else b" " + word.encode())
        spelt = word.lower() if self.words else "Ġ" + word
        return [t.id for t in self.tokenize(spelt if word.isascii() else spelt.translate(self.spell))]

    def _chunk(self, chunk: str) -> bytes | None:
        mark = self.marks.get(chunk[-1:])  # a letter run ends before a mark, under either pattern
        word = chunk[:-1] if mark else chunk
        if word.isalpha() and (word.isascii() or _is_word(word)):
            ids = array("I", self._letters(word)).tobytes()
            return ids + mark if mark else ids
        if self.words:
            if self._plain(chunk):
                return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk.lower())))
            return self.whole(chunk)
        # byte-level: "x" stands for " x" and "\n\0x" for "\nx" at a line's start
        if chunk[:2] == "\n\0":
            rest = chunk[2:]
            if not rest or rest[0].isspace():
                self.odd = True
                return None
            return self.pieces["\n"] + self._spaced(rest)
        if not chunk or chunk[0].isspace():
            self.odd = True
            return None
        return self._spaced(" " + chunk)

    def spaced(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of each chunk after a space, for callers that ask for each chunk once."""
        ids, sizes, odd = self._distinct(pa.array(chunks, pa.large_string()))
        ends = np.cumsum(sizes).tolist()
        return [self.whole(" " + c) if o or "\0" in c else ids[e - n : e].tobytes() for c, n, e, o in zip(chunks, sizes.tolist(), ends, odd.tolist())]

    def _spaced(self, text: str) -> bytes:
        if self._plain(text):
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        return self.whole(text)

    def split(self, text: str) -> list[str]:
        """The chunks of a text for the lower-casing file, which drops white space: any cut at white space is exact."""
        return text.replace("\n", " ").split(" ")

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.words:
            return b"".join(map(self.chunks.__getitem__, self.split(text)))
        if "\0" in text or text[0].isspace() or text[-1].isspace():
            return self._unsplit(text)
        first, *rest = text.replace("\n", " \n\0").split(" ")
        self.odd = False
        out = self._spaced(first) + b"".join(map(self.chunks.__getitem__, rest))
        return self._unsplit(text) if self.odd else out

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts (null: empty) laid end to end, and where each text's begin (one place more than texts).

        The texts' distinct chunks are found by Arrow and encoded once, and their ids laid out by the chunks' places.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.words:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:  # "\0x" for the text's first chunk, and "\n\0x" as in ids()
            lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), pc.replace_substring(texts, "\n", " \n\0"), pa.scalar("", pa.large_string())), " ")
        coded = pc.dictionary_encode(lists.flatten())
        at, per = coded.indices.to_numpy(), np.diff(lists.offsets.to_numpy())
        own, sizes, odd = self._distinct(coded.dictionary)
        begins = np.cumsum(sizes) - sizes
        lone = {}
        if odd.any() or not self.words:
            first = np.cumsum(per) - per
            strange = np.add.reduceat(odd[at], first) > 0 if len(first) else np.zeros(0, bool)
            if not self.words:
                strange |= pc.or_(pc.match_substring(texts, "\0"), pc.match_substring_regex(texts, r"^[\s\x1c-\x1f]|[\s\x1c-\x1f]\z")).to_numpy(zero_copy_only=False)
            lone = {int(k): np.frombuffer(self.ids(texts[int(k)].as_py()), "<u4") for k in np.flatnonzero(strange)}
            if lone:
                keep = ~np.repeat(strange, per)
                at, per = at[keep], np.where(strange, 0, per)
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        ids = own[np.repeat(begins[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(per)]]).astype(np.int64)
        if lone:
            parts = [lone.get(k, ids[offsets[k] : offsets[k + 1]]) for k in range(len(per))]
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return ids, offsets

    def _merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of words with a mark at most laid end to end, and where each word's end."""
        if self.words:
            joined = "\0".join(words.to_pylist()).lower() + "\0"
            for mark in ",.":
                joined = joined.replace(mark, "\0" + mark)
            ids = np.asarray(self.ranked.encode_ordinary(joined), np.uint32)
            pieces = 1 + pc.match_substring_regex(words, "[,.]$").to_numpy(zero_copy_only=False)
            return ids, np.flatnonzero(self.bound[ids])[np.cumsum(pieces) - 1] + 1
        ids = np.asarray(self.ranked.encode_ordinary(" " + " ".join(words.to_pylist())), np.uint32)
        return ids, np.append(np.flatnonzero(self.bound[ids])[1:], len(ids))

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of distinct chunks laid end to end, the number of each chunk's, and the chunks that need their surroundings."""
        sizes, odd = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), bool)
        plain = np.zeros(len(chunks), bool)
        if self.ranked:
            plain = pc.match_substring_regex(chunks, f"^{_WORD_CHARS.pattern}[,.]?$").to_numpy(zero_copy_only=False)
        some, parts, counts = chunks.filter(pa.array(plain)), [np.empty(0, np.uint32)], []
        for a in range(0, len(some), _AT_ONCE):  # a call's ids are a list of numbers
            found, ends = self._merged(some.slice(a, _AT_ONCE))
            parts.append(found)
            counts.append(np.diff(ends, prepend=0))
        ids = np.concatenate(parts)
        if counts:
            sizes[plain] = np.concatenate(counts)
        rest = []
        for k in np.flatnonzero(~plain).tolist():
            chunk = chunks[k].as_py()
            if not self.words and chunk[:1] == "\0":
                found = self._spaced(chunk[1:])
            else:
                found = self._chunk(chunk) if chunk or not self.words else b""
            if found is None:
                found, odd[k] = b"", True
            rest.append(found)
            sizes[k] = len(found) // 4
        if not rest:
            return ids, sizes, odd
        order = np.argsort(~plain, kind="stable")  # plain chunks' ids come first, in order, then the others'
        laid = np.concatenate([ids, np.frombuffer(b"".join(rest), "<u4")])
        begins = np.empty(len(sizes), np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        ends = np.cumsum(sizes)
        return laid[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1])], sizes, odd

    def _unsplit(self, text: str) -> bytes:
        if any(s in text for s in self.special) or not self._plain(text.translate(_NO_WHITE)):
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))


def runs(batches: Iterable[pa.RecordBatch], size: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of batches in runs of about so many bytes, for many(); a longer row is a run of its own."""
    held, room = [], size
    for batch in batches:
        n = 0
        while n < batch.num_rows:
            # a batch of long rows is cut, so that a run's texts and ids stay small
            take = max(1, min(batch.num_rows - n, int((batch.num_rows - n) * room / max(1, batch.slice(n).nbytes))))
            part = batch.slice(n, take)
            n, room = n + take, room - part.nbytes
            held.append(part)
            if room <= size // 8:
                yield _joined(held)
                held, room = [], size
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


_NO_WHITE = {ord(c): "x" for c in " \t\n\r\x0b\x0c"}

_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    """One encoder for each file in a worker, kept between tasks; plain: names of special tokens are ordinary text."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = made = Encoder(path)
        made.lib.encode_special_tokens = plain
    return _encoders[path, plain]
