"""Sampled piece segmentations: forward filtering and backward sampling over the lattice, and lossless decoding."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.llm.common import map_texts

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
CHANCES = 1 << 36  # parts that a node's pieces share


class Vocabulary:
    """Pieces of a SentencePiece model for the lattice: those that hold the space mark at their beginning only.

    A piece's probability falls with its rank in the model (Zipf's law) to the power theta; a character goes as bytes
    with the last rank for each, so that every text has a segmentation, and one that decodes to just that text."""

    def __init__(self, path: str | None = None, theta: float = 1.0):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        by_length: dict[int, list[tuple[int, int, float, list[int]]]] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                if SPACE not in piece[1:]:
                    rank = max(0.0, -model.get_score(i))
                    code = np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(np.uint64)
                    heads = self._rolled(code)
                    by_length.setdefault(len(piece), []).append((heads[-1], i, -theta * float(np.log(rank + 2)), heads))
        self.byte_weight = -theta * float(np.log(n))
        # by length the hashes of all beginnings of pieces, and which of them are pieces themselves
        self.tables = []
        for length in range(1, max(by_length, default=0) + 1):
            rows = {h: (i, w) for h, i, w, _ in by_length.get(length, [])}
            begun = {h[length - 1] for longer, group in by_length.items() if longer > length for *_, h in group}
            every = sorted(begun | rows.keys())
            found = [rows.get(h, (-1, 0.0)) for h in every]
            self.tables.append((np.array(every, np.uint64), np.array([i for i, _ in found], np.int64), np.array([w for _, w in found])))

    @staticmethod
    def _rolled(code: np.ndarray) -> list[int]:
        """The hashes of all beginnings, the shortest first."""
        power, total, out = 1, 0, []
        for c in code.tolist():
            total = (total + (c + 1) * power) % 2**64
            power = power * int(_BASE) % 2**64
            out.append(total)
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


class Lattice:
    """The lattices of many words, and for each node the chances of the pieces that may end there.

    Forward filtering: a node's weight is the sum over all segmentations up to it, for all words by their length at a
    time. key rises within a node from its number to the next, by the chances of its arcs, so one search draws many."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        text = "".join(SPACE + w for w in words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        n = len(code)
        begin = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        left = (begin + size)[word] - np.arange(n)  # characters from here to the word's end
        mark = np.zeros(n, bool)
        mark[begin] = True
        plain = (code != ord(SPACE)) | mark  # a space mark within the text itself goes as bytes
        starts, ends, ids, weights = [], [], [], []
        single = np.zeros(n, bool)
        at, rolled, power = np.flatnonzero(plain), np.zeros(int(plain.sum()), np.uint64), 1
        for length, (hashes, piece, weight) in enumerate(vocabulary.tables, 1):
            if not len(at):
                break
            # only windows that begin some piece are carried on
            rolled = rolled + (code[at + length - 1] + np.uint64(1)) * np.uint64(power)
            power = power * int(_BASE) % 2**64
            place = np.searchsorted(hashes, rolled)
            place[place == len(hashes)] = 0
            alive = hashes[place] == rolled
            at, rolled, place = at[alive], rolled[alive], place[alive]
            whole = piece[place] >= 0
            starts.append(at[whole])
            ends.append(at[whole] + length)
            ids.append(piece[place[whole]])
            weights.append(weight[place[whole]])
            if length == 1:
                single[at[whole]] = True
            on = left[at] > length
            on[on] = plain[at[on] + length]
            at, rolled = at[on], rolled[on]
        odd = np.flatnonzero(~single)
        raw = [chr(int(c)).encode("utf-8", "surrogatepass") for c in code[odd]]
        starts.append(odd)
        ends.append(odd + 1)
        ids.append(-1 - np.arange(len(odd)))
        weights.append(np.array([len(b) for b in raw]) * vocabulary.byte_weight)
        self.odd_ids = vocabulary.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        self.odd_size = np.array([len(b) for b in raw], np.int64)
        self.odd_at = np.cumsum(self.odd_size) - self.odd_size
        start, end, self.piece, weight = (np.concatenate(x) for x in (starts, ends, ids, weights))
        own = word[start]
        start, end = start + own, end + own  # a word of k characters has k + 1 nodes
        first = begin + np.arange(len(words))
        depth = end - first[own]
        order = np.argsort(depth * (n + len(words) + 1) + end, kind="stable")
        start, end, depth, weight, self.piece = start[order], end[order], depth[order], weight[order], self.piece[order]
        alpha = np.zeros(n + len(words))
        chance = np.zeros(len(start), np.int64)
        cuts = np.searchsorted(depth, np.arange(1, (size.max() if len(words) else 0) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            value = alpha[start[a:b]] + weight[a:b]
            head = np.flatnonzero(np.append(True, end[a + 1 : b] != end[a : b - 1]))
            count = np.diff(np.append(head, b - a))
            top = np.maximum.reduceat(value, head)
            share = np.exp(value - np.repeat(top, count))
            total = np.add.reduceat(share, head)
            alpha[end[a:b][head]] = top + np.log(total)
            part = np.rint(share / np.repeat(total, count) * CHANCES).astype(np.int64)
            run = np.cumsum(part)  # whole numbers: a node's sums don't depend on what stands before them
            chance[a:b] = np.minimum(run - np.repeat(run[head] - part[head], count), CHANCES)  # rounded up, they may exceed the whole
        order = np.argsort(end, kind="stable")
        self.start, self.end, self.piece = start[order], end[order], self.piece[order]
        self.key = self.end * CHANCES + chance[order]
        self.last_arc = np.searchsorted(self.end, np.arange(n + len(words)), side="right") - 1
        self.first = first
        self.goal = first + size

    def sample(self, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One segmentation of each of the words in turn, drawn from its last piece back to its first.

        seeds: a 64-bit number for each word. Returns the arcs of all words, and how many each has."""
        node, of = self.goal[words], np.arange(len(words))
        arcs, places, turns = [], [], []
        while len(node):
            draw = (uniform(seeds[of] + np.uint64(len(turns) * int(_BASE) % 2**64)) * CHANCES).astype(np.int64)
            arc = np.minimum(np.searchsorted(self.key, node * CHANCES + draw, side="right"), self.last_arc[node])
            arcs.append(arc)
            places.append(of)
            turns.append(np.full(len(of), -len(turns)))
            node = self.start[arc]
            on = node != self.first[words[of]]
            node, of = node[on], of[on]
        if not arcs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of, turn = np.concatenate(places), np.concatenate(turns)
        order = np.argsort(of * (len(turns) + 1) + turn, kind="stable")
        return np.concatenate(arcs)[order], np.bincount(of, minlength=len(words))

    def ids(self, arcs: np.ndarray) -> np.ndarray:
        piece = self.piece[arcs]
        odd = -1 - piece[piece < 0]
        if not len(odd):
            return piece
        size = np.ones(len(piece), np.int64)
        size[piece < 0] = self.odd_size[odd]
        out = np.repeat(piece, size)
        place = np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size)
        raw = out < 0
        out[raw] = self.odd_ids[self.odd_at[-1 - out[raw]] + place[raw]]
        return out


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 to below 1 by the SplitMix64 finish of 64-bit ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


@lru_cache(2)
def vocabulary_of(path: str | None = None, theta: float = 1.0) -> Vocabulary:
    """Read once in a worker, whatever the number of its tasks."""
    return Vocabulary(path, theta)


def sampler(path: str | None = None, theta: float = 1.0, seed: int = 0) -> tuple[Vocabulary, Callable]:
    vocabulary = vocabulary_of(path, theta)

    def encode(keys: list, texts: list) -> list[np.ndarray | None]:
        """One sampled segmentation for each text, whatever texts come with it: key and seed alone rule the draws."""
        split = [None if t is None else t.split(" ") for t in texts]
        number: dict[str, int] = {}
        coded = [None if s is None else [number.setdefault(w, len(number)) for w in s] for s in split]
        lattice = Lattice(vocabulary, list(number))
        sizes = [0 if c is None else len(c) for c in coded]
        words = np.array([w for c in coded if c is not None for w in c], np.int64)
        own = np.array([xxhash.xxh3_64_intdigest(f"{seed}:{k}".encode()) for k in keys], np.uint64)
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seeds = np.repeat(own, sizes) ^ (place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        arcs, counts = lattice.sample(words, seeds)
        ends = np.cumsum(np.append(0, counts))[np.cumsum([0, *sizes])]
        return [None if c is None else lattice.ids(arcs[a:b]) for c, a, b in zip(coded, ends[:-1], ends[1:])]

    return vocabulary, encode


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode_documents(docs: DataFrame, path: str | None = None, theta: float = 1.0, seed: int = 0) -> DataFrame:
    """(doc_id, ids): a sampled segmentation of each whole text; a null text has none. Rows of one id and text draw alike."""
    return map_texts(
        _columns(docs), "doc_id long, ids array<int>", lambda c, s: [(k, None if i is None else i.tolist()) for k, i in zip(c[0], s[1](*c))],
        rows=512, setup=lambda: sampler(path, theta, seed),
    )


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    return map_texts(
        encoded.select("doc_id", "ids"), "doc_id long, text string",
        lambda c, v: [(k, None if i is None else v.decode(np.array(i, np.int64))) for k, i in zip(*c)], rows=512, setup=lambda: vocabulary_of(path),
    )


def encode_and_check(docs: DataFrame, path: str | None = None, theta: float = 1.0, seed: int = 0) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, lossless) of each row's sampled segmentation, which is decoded again and compared.

    ids_crc32 is over little-endian unsigned 32-bit ids. A null text has no ids, checksum 0 and counts as lossless; an
    empty one is the space mark alone; a null key draws under the key None; repeated rows draw alike; other columns
    are not read. No shuffle."""

    def work(columns: list[list], state) -> list[tuple]:
        vocabulary, encode = state
        out = []
        for key, text, ids in zip(*columns, encode(*columns)):
            if ids is None:
                out.append((key, 0, 0, True))
            else:
                out.append((key, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), vocabulary.decode(ids) == text))
        return out

    return map_texts(_columns(docs), "doc_id long, n_ids long, ids_crc32 long, lossless boolean", work, rows=512, setup=lambda: sampler(path, theta, seed))
