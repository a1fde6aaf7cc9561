"""Token counts by rank-synchronous array merging of byte-pair encodings with word ends.

Pre-tokens are held as ragged numpy arrays of symbols. In each round every sequence applies its own lowest-rank pair, all
sequences at once; a sequence without a known pair is finished and its surviving symbols are counted. Long sequences
merge one rank a round at all its places. The tokenizer file
supplies the vocabulary, merges and special strings; nothing is trained and the tokenizer library is not called.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from heapq import heappop, heappush
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.batches import PIECE_BYTES, Recent, pieces, slices, texts
from tessera.llm.encoder import SYMBOLS, bare_texts, distinct_chunks, with_cuts
from tessera.session import ship

#: Entries of each cache of a worker; forgetting changes time only.
CACHE = 400_000
#: White space of the tokenizer file's regular expressions (the Unicode property), which those of Python widen.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Code points that hold no letters, though the regular expressions here take some of them for letters.
BEYOND = "\U00032400-\U0010ffff"
#: Bytes of a pre-token beyond which only the places of a rank are looked at in its round. Changes time only.
LONG = 512
_NONE = np.iinfo(np.int64).max


class RaggedMerger:
    """Counts of one tokenizer file (BPE, lower case, byte symbols, a suffix that marks word ends)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = len(vocab)
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made
        # A pair's occurrences merge together unless what it makes takes part in a pair of lower rank.
        first = np.full(max(vocab.values()) + 1, _NONE)
        np.minimum.at(first, left, np.arange(len(pairs)))
        np.minimum.at(first, right, np.arange(len(pairs)))
        self.together = first[made] > np.arange(len(pairs))
        symbols = [SYMBOLS.get(b, chr(b)) for b in range(256)]
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int64)
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.mark = commonprefix(specials).encode()
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|(?:(?![{BEYOND}])\p{{L}})+|\p{{N}}|(?:[{BEYOND}]|[^{SPACE}\p{{L}}\p{{N}}])+")
        self.chunks, self.tokens = Recent(CACHE), Recent(CACHE)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each non-empty pre-token."""
        out = np.ones(len(words), np.int64)
        for few, run in ((True, self._merge_short), (False, self._merge_long)):
            some = [i for i, w in enumerate(words) if (len(w) <= LONG) is few]
            if some:
                out[some] = run([words[i] for i in some])
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.width + right
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, self.rank[at], _NONE)

    def _merge_long(self, words: list[bytes]) -> np.ndarray:
        """The same for long pre-tokens, whose many ranks would each cost a round over all symbols.

        A round takes the least rank that is left and merges all its occurrences, wherever they are; symbols are chained, and
        places are kept by rank, so a round costs as much as it merges. Words share rounds as nothing crosses their ends.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        n, ends = int(lengths.sum()), np.cumsum(lengths)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = np.r_[self.inner[flat], 0]
        sym[ends - 1] = self.final[flat[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # place n stands for none
        after[ends - 1], before[ends - lengths] = n, n
        rank = np.full(n + 1, _NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def look(places: np.ndarray) -> None:
            """File places under the rank of the pair that begins there."""
            right = after[places]
            rank[places] = found = np.where(right < n, self._ranks(sym[places], sym[right]), _NONE)
            places, found = places[found != _NONE], found[found != _NONE]
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            edges = np.flatnonzero(np.diff(found, prepend=-1))
            for r, part in zip(found[edges].tolist(), np.split(places, edges[1:])):
                if r not in waiting:
                    waiting[r] = []
                    heappush(queue, r)
                waiting[r].append(part)

        look(np.arange(n))
        while queue:
            r = heappop(queue)
            spots = np.unique(np.concatenate(waiting.pop(r)))
            spots = spots[rank[spots] == r]
            if not len(spots):
                continue
            if self.together[r]:  # of overlapping occurrences every second one, from the left
                run = np.r_[True, after[spots[:-1]] != spots[1:]]
                start = np.maximum.accumulate(np.where(run, np.arange(len(spots)), 0))
                spots = spots[(np.arange(len(spots)) - start) % 2 == 0]
            else:  # order matters, so only the first of each word, and the others again
                first = np.r_[True, np.diff(owner[spots]) != 0]
                if not first.all():
                    waiting[r] = [spots[~first]]
                    heappush(queue, r)
                spots = spots[first]
            gone = after[spots]
            sym[spots], rank[gone] = self.made[r], _NONE
            after[spots] = after[gone]
            before[after[spots]] = spots
            lengths -= np.bincount(owner[spots], minlength=len(words))
            near = before[spots]
            look(np.unique(np.r_[spots, near[near < n]]))
        return lengths

    def _merge_short(self, words: list[bytes]) -> np.ndarray:
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        sym[ends] = self.final[flat[ends]]
        seq = np.repeat(np.arange(len(words)), lengths)
        out = np.ones(len(words), np.int64)
        while len(sym):
            inside = seq[:-1] == seq[1:]
            rank = np.where(inside, self._ranks(sym[:-1], sym[1:]), _NONE)
            starts = np.flatnonzero(np.r_[True, ~inside])
            size = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(np.r_[rank, _NONE], starts)
            over = least == _NONE
            out[seq[starts[over]]] = size[over]
            if over.all():
                break
            chosen = (rank == np.repeat(least, size)[:-1]) & (rank != _NONE)
            spots = np.flatnonzero(chosen)
            r = rank[spots]
            # Of overlapping occurrences every second one merges, from the left; where order matters only the first.
            run = np.r_[True, np.diff(spots) != 1]
            run_start = np.maximum.accumulate(np.where(run, np.arange(len(spots)), 0))
            first = np.r_[True, seq[spots][1:] != seq[spots][:-1]]
            use = np.where(self.together[r], (np.arange(len(spots)) - run_start) % 2 == 0, first)
            spots, r = spots[use], r[use]
            sym[spots] = self.made[r]
            keep = np.repeat(~over, size)
            keep[spots + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out

    def _split(self, chunk: bytes) -> tuple[list[str], int]:
        """Pre-tokens of a text without ASCII white space, and its special strings."""
        raw, found = chunk.decode("utf-8", "replace"), 0
        parts = [raw]
        if self.special and self.mark in chunk:
            parts = self.special.split(raw)
            found = len(parts) - 1
        words = []
        for part in parts:
            if not part.isascii():
                part = "".join(map(str.lower, unicodedata.normalize("NFC", part)))  # by character: no final sigma
            else:
                part = part.lower()
            words += self.words.findall(part)
        return words, found

    def learn(self, chunks: set[bytes]) -> None:
        """Count chunks that the cache lacks."""
        split = {c: self._split(c) for c in chunks}
        fresh = list(self.tokens.missing({w for words, _ in split.values() for w in words}))
        if fresh:
            self.tokens.update(zip(fresh, self.merge([w.encode() for w in fresh]).tolist()))
        for chunk, (words, found) in split.items():
            self.chunks[chunk] = found + sum(map(self.tokens.__getitem__, words))

    def counts(self, data: list[bytes]) -> list[int]:
        """Token counts of texts that fit in memory together with their words; longer texts go piece by piece."""
        if len(data) == 1 and len(data[0]) > PIECE_BYTES:
            return [sum(self._some([piece])[0] for piece in pieces(data[0]))]
        return self._some(data)

    def _some(self, data: list[bytes]) -> list[int]:
        """Counts of texts of any length, all at once."""
        chunks, index, starts = distinct_chunks(with_cuts(bare_texts(data), b" ", False))
        self.learn(self.chunks.missing(set(chunks)))
        size = np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks))
        return np.diff(np.r_[0, np.cumsum(size[index])][starts]).tolist()


@lru_cache(maxsize=2)
def merger(source: str) -> RaggedMerger:
    return RaggedMerger(source)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    `vocabulary` is the path of a tokenizer file with byte symbols and word ends; the driver reads it and broadcasts its
    text, whose size does not depend on the data. Counts are those of the tokenizer library without begin or end tokens,
    truncation or padding; special strings inside a text count as one token. A null text counts as empty (0 tokens).
    Rows are independent: null doc_ids, repeats and other columns pass or are ignored without effect; an empty table
    gives an empty result. No shuffle: one Arrow pass over whole texts.
    """
    ship(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        own = merger(source.value)
        for batch in slices(batches):
            data = texts(batch)
            counts = np.array(own.counts(data), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in data], pa.int64()), pa.array(counts), pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
