"""Token ids of whole texts by the tokenizers library, called once for each distinct chunk instead of each occurrence.

Texts are cut at spaces, the distinct chunks of a slice are found by Arrow, and their ids are gathered by numpy. A cut at
a space is a place where the pre-tokenizers of both supported kinds of file cut, and no normalisation or merge looks
across, so joined chunk ids equal the ids of the whole text (tested against the library). Texts for which that argument
has exceptions (some runs of white space, white space beyond ASCII) are encoded whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.batches import PIECE_BYTES, Recent, pieces

#: Entries of a worker's cache; forgetting changes time only.
CACHE = 900_000
#: Bytes of texts that are worth encoding together: the longer a slice, the fewer of its chunks are distinct.
SLICE_BYTES = 12 << 20
#: White space outside ASCII, control characters that only some libraries count as white space, and the marks below: bytes
#: that begin them, and the last bytes of those that begin with e2 80.
_ODD_LEADS, _ODD_ENDS = b"\x00\x01\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3", bytes([*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF])
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_IS_STOP, _IS_WHITE, _IS_LETTER, _IS_ODD_LEAD, _IS_ODD_END = (
    np.isin(np.arange(256), list(x)) for x in (b".,", b" \t\n\r\v\f", bytes(range(65, 91)) + bytes(range(97, 123)), _ODD_LEADS, _ODD_ENDS)
)
_MARK = b"\x01"
_TO_SPACE = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The printable character that byte-level vocabularies use for each byte, and the one of a space.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SYMBOLS = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_SYMBOLS_BUT_NEWLINE = {b: s for b, s in SYMBOLS.items() if b != 10}


def distinct_chunks(data: list[bytes] | pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct chunks between spaces, the number of each chunk's occurrence in order, and where each text's begin."""
    split = pc.split_pattern(data if isinstance(data, pa.Array) else pa.array(data, pa.binary()), b" ")
    coded = split.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), split.offsets.to_numpy()


def with_cuts(data: list[bytes], cut: bytes, lines: bool) -> pa.Array:
    """The texts with `cut` put before a stop or comma between a letter and white space, and, if asked for, before a line
    break that follows other than white space. Pre-tokenizers cut at these places too, so fewer chunks are distinct.

    All texts are looked at as one array of bytes. That a text's first byte may be judged by the end of the text before
    does no harm: a cut before the first byte only puts an empty chunk there.
    """
    flat = np.frombuffer(b"".join(data), np.uint8)
    ends = np.cumsum([0, *map(len, data)])
    at = np.flatnonzero(_IS_STOP[flat])
    at = at[(at > 1) & (at < len(flat) - 1)]
    at = at[_IS_WHITE[flat[at + 1]]]
    last, second = flat[at - 1], flat[at - 2]
    at = at[_IS_LETTER[last] | (last >= 0x80) & (second == 0xC3) & (last != 0x97) & (last != 0xB7)]
    if lines:
        breaks = np.flatnonzero(flat == 10)
        breaks = breaks[breaks > 0]
        at = np.sort(np.r_[at, breaks[~_IS_WHITE[flat[breaks - 1]]]])
    new = np.insert(flat, np.repeat(at, len(cut)), np.tile(np.frombuffer(cut, np.uint8), len(at)))
    ends = (ends + len(cut) * np.searchsorted(at, ends)).astype(np.int32)
    ends[-1] = len(new)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(new)])


def bare_texts(data: list[bytes]) -> list[bytes]:
    """Texts for a file whose words carry no leading space: ASCII white space as spaces, A-Z lower-cased where that is safe.

    Lower-casing early changes nothing, unless a special string could arise or a letter could meet a combining mark with
    which it has a composed form in one case only.
    """
    out = []
    for text in data:
        safe = b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text
        text = text.translate(_TO_SPACE)
        out.append(text.translate(_LOWER) if safe else text)
    return out


def _packed(ids: list[list[int]]) -> list[bytes]:
    """Lists of ids as little-endian unsigned 32-bit integers."""
    ends = np.cumsum([0, *map(len, ids)]) * 4
    raw = np.fromiter(chain.from_iterable(ids), "<u4", ends[-1] // 4).tobytes()
    ends = ends.tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


#: Pre-tokens of a byte-level file (fixed value), but that a zero byte is one, and bounds white space as an end of text does.
_PATTERN = r"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x00]+|\s+(?![^\s\x00])|\s+"
#: Characters up to U+02BF are letters, or not, in every version of Unicode; their UTF-8 has only smaller bytes than this.
_LATER = 0xCB


def _by_concatenation(source: str, library):
    """A faster merger of the same file (tiktoken), and the id of the zero byte, or None where equality is not certain.

    It merges neighbours whose concatenation is in the vocabulary, lowest id first; the library merges listed pairs, lowest
    rank first. Up to the moment a token t arises, nothing merged across its ends, so what lies between them is what merges
    of lower rank make of t alone. Hence both give the same ids if ids ascend with ranks and every token, alone, becomes
    itself; tokens that don't never arise and are left out.
    """
    model = json.loads(source)["model"]
    vocab, byte = model["vocab"], {ord(SYMBOLS.get(b, chr(b))): b for b in range(256)}
    if json.loads(source)["normalizer"] or "ByteLevel" not in str(json.loads(source)["pre_tokenizer"]) or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("unk_token"):
        return None
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [vocab[t] for t in made]
    if any(a >= b for a, b in zip(ids, ids[1:])) or any(chr(c) not in vocab for c in byte) or max(vocab[chr(c)] for c in byte) > min(ids, default=0):
        return None
    tokens = [chr(c) for c in byte] + [t for t in made if [x.id for x in library.model.tokenize(t)] == [vocab[t]]]
    import tiktoken

    ranks = {bytes(byte[ord(c)] for c in t): vocab[t] for t in tokens}
    return tiktoken.Encoding("chunks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}), vocab[SYMBOLS[0]]


class Encoder:
    """ids(texts): for each text the bytes of its ids as little-endian unsigned 32-bit integers, no special tokens added."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        self.library = Tokenizer.from_str(source)
        model = json.loads(source)["model"]
        self.bare = bool(model.get("end_of_word_suffix"))
        if self.bare:  # the same model without a cache, as each word is asked for once
            merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
            others = {k: v for k in ("unk_token", "end_of_word_suffix", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if (v := model.get(k)) is not None}
            self.library.model = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **others)
        self.fast = None if self.bare else _by_concatenation(source, self.library)
        self.known = Recent(CACHE)

    def _letters(self, chunk: bytes) -> bool:
        """Whether a chunk beyond ASCII is one pre-token for certain: letters that no normalisation changes."""
        try:
            text = (chunk[1:] if chunk[:1] == b" " else chunk).decode()
        except UnicodeDecodeError:
            return False
        # Of the sigma and the dotted I the lower case depends on more than the letter.
        return text.isalpha() and is_normalized("NFC", text) and not (self.bare and ("\u03a3" in text or "\u0130" in text))

    def _encode_words(self, chunks: list[bytes]) -> list[bytes]:
        """Like _encode, with one call of the library's model where nothing is left to normalise or to cut."""
        word, rest = [], []
        for i, c in enumerate(chunks):
            plain = (c[1:] if c[:1] == b" " else c).isalpha() or not c.isascii() and self._letters(c)
            (word if plain else rest).append(i)
        joined = b"\n".join([chunks[i] for i in word])
        if self.bare:
            joined = joined.decode().lower().encode()
        symbols = joined.decode("latin-1").translate(_SYMBOLS_BUT_NEWLINE).split("\n") if word else []
        tokenize = self.library.model.tokenize
        out: list = [None] * len(chunks)
        for i, ids in zip(word, _packed([[t.id for t in tokenize(w)] for w in symbols])):
            out[i] = ids
        for i, ids in zip(rest, self._encode([chunks[i] for i in rest])):
            out[i] = ids
        return out

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        out = []
        for lo in range(0, len(chunks), 20_000):
            strings = [c.decode("utf-8", "replace") for c in chunks[lo : lo + 20_000]]
            out += _packed([e.ids for e in self.library.encode_batch_fast(strings, add_special_tokens=False)])
        return out

    def _learn(self, chunks: set[bytes]) -> None:
        """Encode chunks that the cache lacks. Punctuation that ends a chunk after a letter is a pre-token of its own, so a
        word needs no entry with it."""
        known, old = self.known, self.known.old
        cuts = []
        for c in chunks:
            at = len(c.rstrip(_PUNCTUATION))
            if c[:1] == b"\n" and c[1:2] > b" ":  # a line break before a word, likewise
                cuts.append((c, 1))
            elif 0 < at < len(c) and (c[at - 1 : at].isalpha() or at > 1 and c[at - 2] == 0xC3 and c[at - 1] not in (0x97, 0xB7)) and b"<|" not in c:
                cuts.append((c, at))
        parts = {p for c, at in cuts for p in (c[:at], c[at:])}
        fresh = list(chunks.difference([c for c, _ in cuts]).union(p for p in parts if p not in known and p not in old))
        known.update(zip(fresh, self._encode_words(fresh)))
        for c, at in cuts:
            known[c] = (known.get(c[:at]) or old[c[:at]]) + (known.get(c[at:]) or old[c[at:]])

    def _safe(self, texts: list[bytes]) -> np.ndarray:
        """Whether each text may be cut into chunks: it holds neither odd white space nor a run that a cut would divide."""
        if self.bare:
            return np.ones(len(texts), bool)
        flat = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n\n", np.uint8)
        odd = np.flatnonzero(_IS_ODD_LEAD[flat[:-2]])
        lead, after, third = flat[odd], flat[odd + 1], flat[odd + 2]
        two = (lead == 0xC2) & ((after == 0x85) | (after == 0xA0))
        three = (lead == 0xE1) & (after == 0x9A) | (lead == 0xE3) & (after == 0x80) | (lead == 0xE2) & ((after == 0x81) | (after == 0x80) & _IS_ODD_END[third])
        odd = odd[(lead < 0x20) | two | three]
        space = np.flatnonzero(flat[1:-1] == 32) + 1  # a space at an end of a text lies beside a line break here
        run = space[_IS_WHITE[flat[space - 1]] & _IS_WHITE[flat[space + 1]]]
        starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
        out = np.ones(len(texts), bool)
        out[np.searchsorted(starts, np.r_[odd, run], side="right") - 1] = False
        return out

    def ids(self, data: list[bytes]) -> list[bytes]:
        if len(data) == 1 and len(data[0]) > PIECE_BYTES and self._safe(data).all():
            parts = list(pieces(data[0]))
            return [b"".join(self._some([p])[0] for p in parts)] if self._safe(parts).all() else self._encode(data)
        return self._some(data)

    def _some(self, data: list[bytes]) -> list[bytes]:
        whole = np.flatnonzero(~self._safe(data)).tolist()
        texts = list(data)
        for i in whole:
            texts[i] = b""
        table, at, size, index, starts = (self._fast_table if self.fast else self._table)(texts)
        sizes = size[index]
        ends = np.cumsum(sizes, dtype=np.int32)
        spots = np.repeat(at[index] - (ends - sizes), sizes)
        spots += np.arange(len(spots), dtype=np.int32)
        bounds = np.r_[0, ends][starts].astype(np.int64) * 4
        del index, sizes, ends
        raw = memoryview(table[spots]).cast("B")
        out = [bytes(raw[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
        for i, ids in zip(whole, self._encode([data[i] for i in whole])):
            out[i] = ids
        return out

    def _table(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Ids of distinct chunks one after another, place and number of each chunk's, the chunks in order, and each text's first."""
        # The mark of a cut says that no space precedes what follows.
        texts = with_cuts(bare_texts(texts), b" ", False) if self.bare else with_cuts([_MARK + t for t in texts], b" " + _MARK, True)
        chunks, index, starts = distinct_chunks(texts)
        if not self.bare:  # every other chunk follows a space, which belongs to it
            chunks = [c[1:] if c[:1] == _MARK else b" " + c for c in chunks]
        self._learn(self.known.missing(set(chunks)))
        found = list(map(self.known.__getitem__, chunks))
        size = np.fromiter(map(len, found), np.int32, len(found)) // np.int32(4)
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum(size, dtype=np.int32) - size, size, index, starts

    def _fast_table(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """The same; the distinct chunks stay one array of bytes, which the faster merger encodes in one go."""
        split = pc.split_pattern(with_cuts([_MARK + t for t in texts], b" " + _MARK, True), b" ")
        coded = split.flatten().dictionary_encode()
        chunks, index, starts = coded.dictionary, coded.indices.to_numpy(), split.offsets.to_numpy()
        ends = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1]
        flat = np.frombuffer(chunks.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy()
        first, length = ends[:-1] - ends[0], np.diff(ends)
        some = np.flatnonzero(length)
        slow = np.zeros(len(length), bool)
        slow[some] = np.maximum.reduceat(flat, first[some]) >= _LATER
        special = np.flatnonzero((flat[:-1] == ord("<")) & (flat[1:] == ord("|")))
        slow[np.searchsorted(first, special, side="right") - 1] = True
        others = [c[1:] if c[:1] == _MARK else b" " + c for c in chunks.filter(pa.array(slow)).to_pylist()]
        if others:
            flat, length = flat[np.repeat(~slow, length)], np.where(slow, 0, length)
            first = (np.cumsum(length) - length).astype(np.int32)
            some = np.flatnonzero(length)
        # A zero byte before each chunk, in the place of its mark or together with its space.
        marked = np.zeros(len(length), bool)
        marked[some] = flat[first[some]] == _MARK[0]
        flat[first[marked]] = 0
        bare = first[~marked]
        joined = np.insert(flat, np.repeat(bare, 2), np.tile(np.array([0, 32], np.uint8), len(bare))).tobytes()
        merger, zero = self.fast
        table = merger.encode_to_numpy(joined.decode("utf-8", "replace"), disallowed_special=()).astype("<u4", copy=False)
        cut = np.flatnonzero(table == zero).astype(np.int32)
        at, size = cut + np.int32(1), np.diff(np.r_[cut, np.int32(len(table))]) - np.int32(1)
        if others:
            self._learn(self.known.missing(set(others)))
            found = [self.known[c] for c in others]
            size[slow] = np.fromiter(map(len, found), np.int32, len(found)) // np.int32(4)
            at[slow] = len(table) + np.cumsum(size[slow], dtype=np.int32) - size[slow]
            table = np.concatenate([table, np.frombuffer(b"".join(found), "<u4")])
        return table, at, size, index, starts


@lru_cache(maxsize=2)
def encoder(source: str) -> Encoder:
    return Encoder(source)
