"""Byte-level BPE, speculate and verify.

Greedy longest match proposes the tokens of every distinct word, one vectorised check tests all
adjacent pairs, and only words with a failing pair are merged exactly.

Why a pair test is enough: merges run in rank order, and a token's rank is above its parts'. Two
neighbours ``a b`` stay apart unless some piece on the right edge of ``a`` and some piece on the left
edge of ``b`` merge before either is absorbed. The first merge across any boundary of a word would be
such a merge, so a word whose adjacent pairs all hold is what exact merging gives.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
CACHED_WORDS = 200_000
LONG_WORD = 200
SHORT_WORD = 32

#: The split of the byte-level scheme. The second form is the same over the characters that FAST_ONLY
#: allows, where every letter, digit and space is known; Python's re runs it three times as fast.
SPLIT = regex.compile(public_tokenizers.PATTERN)
_L = "A-Za-zÀ-ÖØ-öø-ƿ"
_W = "\t-\r "
FAST_SPLIT = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[0-9]+| ?[^{_W}{_L}0-9]+|[{_W}]+(?![^{_W}])|[{_W}]+")
FAST_ONLY = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ƿ]")


def _alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in a byte-level vocabulary: printable bytes stand for
    themselves, the others follow from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """One vocabulary, with its pair tables, its matcher and a bounded cache of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        byte_of = _alphabet()
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for t, i in model["vocab"].items():
            self.token[i] = bytes(byte_of[c] for c in t)
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.size = size
        self.left = np.full(size, -1)
        self.right = np.full(size, -1)
        self.rank = np.full(size, -1)
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.merge[x * size + y] = (rank, z)
            self.left[z], self.right[z], self.rank[z] = x, y, rank
        self.of_byte = [0] * 256
        for i, t in enumerate(self.token):
            if len(t) == 1 and self.left[i] < 0 and i not in self.special.values():
                self.of_byte[t[0]] = i
        self.keys = np.array(sorted(self.merge), dtype=np.int64)
        self.key_rank = np.array([self.merge[k][0] for k in self.keys.tolist()], dtype=np.int64)
        made = np.flatnonzero(self.left >= 0)
        self.made = np.array([z for _, z in sorted(self.merge.values())], dtype=np.int64)
        self.ordered = bool((self.rank[made] > np.maximum(self.rank[self.left[made]], self.rank[self.right[made]])).all()) and len(made) == len(self.merge)
        self.length = np.array([len(t) for t in self.token], dtype=np.int64)
        self.known_pair = np.full(1 << 20, -1, dtype=np.int64)
        self.known_verdict = np.zeros(1 << 20, dtype=bool)
        self.matcher = ahocorasick.Automaton()
        for i in self._reachable(made):
            self.matcher.add_word(self.token[i].decode("latin-1"), i)
        self.matcher.make_automaton()
        self.cache: dict[str, bytes] = {}
        self.proposed = self.failed = 0

    def _reachable(self, made: np.ndarray) -> list[int]:
        """Tokens that merging their own bytes gives; the others are never proposed."""
        good = np.zeros(self.size, dtype=bool)
        good[self.of_byte] = True
        apart = np.zeros(self.size, dtype=bool)
        apart[made] = self._apart(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])].tolist():
            good[i] = apart[i] and good[self.left[i]] and good[self.right[i]]
        return np.flatnonzero(good).tolist()

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], 1 << 40)

    def _apart(self, a: np.ndarray, b: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
        """Of each pair: does no merge cross its boundary? Walks the two edges back in time together.
        ``end``: the rank at which both are absorbed; never, if not given."""
        ok = np.ones(len(a), dtype=bool)
        at, x, y = np.arange(len(a)), a, b
        end_x = end_y = np.full(len(a), 1 << 41) if end is None else end
        while len(at):
            rank = self._pair_rank(x, y)
            crossed = (rank < (1 << 40)) & (rank < end_x) & (rank <= end_y)
            ok[at[crossed]] = False
            go = ~crossed & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            at, x, y, end_x, end_y = (v[go] for v in (at, x, y, end_x, end_y))
            rx, ry = self.rank[x], self.rank[y]
            down = rx > ry
            x, end_x, y, end_y = np.where(down, self.right[x], x), np.where(down, rx, end_x), np.where(down, y, self.left[y]), np.where(down, end_y, ry)
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_apart`` with a table of verdicts already found."""
        key = a * self.size + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        verdict = self.known_verdict[slot]
        new = np.flatnonzero(self.known_pair[slot] != key)
        if len(new):
            first, back = np.unique(key[new], return_inverse=True)
            found = self._apart(first // self.size, first % self.size)[back]
            verdict[new] = found
            self.known_pair[slot[new]] = key[new]
            self.known_verdict[slot[new]] = found
            # several keys can share a slot; the one that stayed must be the one whose verdict stayed
            clash = self.known_pair[slot[new]] != key[new]
            self.known_pair[slot[new][clash]] = -1
        return verdict

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost first."""
        ids = [self.of_byte[c] for c in word]
        n, size, find = len(ids), self.size, self.merge.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := find(ids[i] * size + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i] if ids[i] == x else n
            if j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := find(z * size + ids[k]):
                    heapq.heappush(heap, (m[0], i, z, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := find(ids[h] * size + z)):
                heapq.heappush(heap, (m[0], h, ids[h], z, m[1]))
        return [x for x in ids if x >= 0]

    def merged_together(self, words: list[bytes]) -> list[bytes]:
        """``merged`` of many short words at once, a merge of each in every round."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in (8, 12, 20, SHORT_WORD):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if not len(rows):
                continue
            flat = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in rows.tolist()]), np.uint8).reshape(-1, width)
            left = sizes[rows].copy()
            ids = np.where(np.arange(width) < left[:, None], np.array(self.of_byte)[flat], -1)
            rank = np.full(ids.shape, 1 << 40)
            both = ids[:, 1:] >= 0
            rank[:, :-1][both] = self._pair_rank(ids[:, :-1][both], ids[:, 1:][both])
            live, places = np.arange(len(rows)), np.arange(width)
            while len(live):
                i = rank[live].argmin(1)
                go = rank[live, i] < (1 << 40)
                live, i = live[go], i[go]
                if not len(live):
                    break
                made = self.made[rank[live, i]]
                take = np.minimum(places + (places > i[:, None]), width - 1)
                own, own_rank = np.take_along_axis(ids[live], take, 1), np.take_along_axis(rank[live], take, 1)
                own[:, -1], own_rank[:, -1] = -1, 1 << 40
                at = np.arange(len(live))
                own[at, i] = made
                right = own[at, np.minimum(i + 1, width - 1)]
                own_rank[at, i] = np.where(right >= 0, self._pair_rank(made, right), 1 << 40)
                h = np.flatnonzero(i > 0)
                own_rank[h, i[h] - 1] = self._pair_rank(own[h, i[h] - 1], made[h])
                ids[live], rank[live] = own, own_rank
            kept = ids >= 0
            ends = np.cumsum(kept.sum(1)) * 4
            packed = ids[kept].astype("<u4").tobytes()
            for r, a, b in zip(rows.tolist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                out[r] = packed[a:b]
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        if not self.ordered:
            return [np.array(self.merged(w), "<u4").tobytes() for w in raw]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # one separator after each word
        found = self.matcher.iter_long("Ā".join([w.decode("latin-1") for w in raw]))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int64)
        end, ids = flat[0::2], flat[1::2]
        of = np.searchsorted(starts, end, "right") - 1
        covered = np.bincount(of, self.length[ids], len(raw))
        failed = covered != sizes
        same = np.flatnonzero(of[1:] == of[:-1])
        apart = self.compatible(ids[same], ids[same + 1])
        failed[of[same[~apart]]] = True
        first = (np.searchsorted(of, np.arange(len(raw) + 1)) * 4).tolist()
        packed = ids.astype("<u4").tobytes()
        out = [packed[a:b] for a, b in itertools.pairwise(first)]
        short = np.flatnonzero(failed & (sizes <= SHORT_WORD)).tolist()
        for i, ids_of in zip(short, self.merged_together([raw[i] for i in short]), strict=True):
            out[i] = ids_of
        for i in np.flatnonzero(failed & (sizes > SHORT_WORD)).tolist():
            out[i] = np.array(self.merged(raw[i]), "<u4").tobytes()
        self.proposed += len(raw)
        self.failed += int(failed.sum())
        return out

    def words(self, text: str) -> list[str]:
        return (SPLIT if FAST_ONLY.search(text) else FAST_SPLIT).findall(text)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, null as empty. Special tokens' strings become their ids, as the library does."""
        split: list[list[str]] = []
        for text in texts:
            text = text or ""
            if self.special_split is not None and self.special_split.search(text):
                own: list[str] = []
                for i, part in enumerate(self.special_split.split(text)):
                    own += [part] if i % 2 else self.words(part)
                split.append(own)
            else:
                split.append(self.words(text))
        cache = self.cache
        every = set().union(*split)
        new = every.difference(cache)
        if len(cache) + len(new) > CACHED_WORDS:
            cache.clear()
            new = every
        special = new & self.special.keys()
        cache.update((w, np.array([self.special[w]], "<u4").tobytes()) for w in special)
        todo = list(new - special)
        for at in range(0, len(todo), 50_000):
            part = todo[at : at + 50_000]
            cache.update(zip(part, self.encode_words(part), strict=True))
        out = [b"".join(map(cache.__getitem__, own)) for own in split]
        for w in todo:
            if len(w) > LONG_WORD:
                del cache[w]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def bpe(path: str | None = None) -> Bpe:
    """The vocabulary at ``path``, loaded once in a worker."""
    return Bpe(path or public_tokenizers.path(DEFAULT_TOKENIZER))


def encode_decode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded`` of every whole text: ids as little-endian unsigned 32-bit integers, and
    the text that decoding them gives.

    A null text counts as empty; empty gives no ids and an empty text. Texts of any length are encoded
    whole. Repeated rows and null ids stay, one row out for each row in. Other columns are ignored. An
    empty table gives an empty result. No shuffle: one pass over the scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(tokenizer)
        for batch in batches:
            for part in common.slices(batch, "text"):
                ids = coder.encode_batch(part.column(1).to_pylist())
                yield pa.record_batch(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"]
                )

    return common.plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")
