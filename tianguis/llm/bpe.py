"""Byte-pair encoding by speculation and verification.

For every distinct word of a batch greedy longest match proposes tokens. A proposal is the
encoding exactly when each adjacent pair of tokens is one that merging would leave alone
inside the two tokens' joint string; that test runs over all distinct pairs at once, by
undoing merges from the later one back. Only words with a failing pair are merged one merge
at a time. The vocabulary file is a parameter.

Text is taken apart by the file's own normaliser and split pattern, as the tokenizers
library does it; special tokens standing in a text become their own ids, as there.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tianguis.llm.tables import table

#: Distinct words and pairs that a worker keeps between batches.
KEPT = 250_000
_PATTERN = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# ASCII and the Latin letters below U+0180 are their own composed form, lower-case alike
# everywhere and have plain classes, so the split pattern can be spelled out for them. Any
# other text goes through the library's own normaliser and splitter.
_OTHER = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ſ]")
_ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d a-z0-9]+")
_PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\x09-\x0d a-z0-9ß-öø-ſ]+")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable in Latin-1, else from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Codec:
    """A word-level BPE vocabulary with an end-of-word suffix, from the text of a tokenizers JSON file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("not a plain word-level BPE file")
        if spec["decoder"] or spec["pre_tokenizer"] is None or _PATTERN not in json.dumps(spec["pre_tokenizer"]):
            raise ValueError("another decoder or split pattern than this codec knows")
        self.library = Tokenizer.from_str(text)
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        size = max(self.vocab.values()) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        #: order of a merge, by its pair and by its product; single symbols come before all merges
        self.rank: dict[tuple[int, int], int] = {}
        left, right, order = np.arange(size), np.arange(size), np.full(size, -1, dtype=np.int64)
        pairs = []
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[x, y] = r
            pairs.append((x, y, r, z))
            if order[z] < 0:
                left[z], right[z], order[z] = x, y, r
        self.made = {(x, y): z for x, y, _, z in pairs}
        self.left, self.right, self.order = left, right, order
        keys = np.array([x << 32 | y for x, y, _, _ in pairs], dtype=np.int64)
        at = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[at], np.array([r for _, _, r, _ in pairs], dtype=np.int64)[at]
        self.alphabet = byte_alphabet()
        self.to_bytes = {c: b for b, c in enumerate(self.alphabet)}
        # a token can be proposed if merging its own string gives it back
        self.inner, self.final = {}, {}
        self.longest = 1
        for text, i in self.vocab.items():
            ends = text.endswith(self.suffix)
            own = text[: -len(self.suffix)] if ends else text
            if order[i] < 0 or self._whole(i):
                (self.final if ends else self.inner)[own] = i
                self.longest = max(self.longest, len(own))
        self.strings = [self.library.id_to_token(i).encode() for i in range(size)]
        self.words: dict[str, int] = {}
        self.tables()

    def _whole(self, token: int) -> bool:
        text = self.library.id_to_token(token)
        ends = text.endswith(self.suffix)
        own = text[: -len(self.suffix)] if ends else text
        return self.merge(self.symbols(own, ends)) == [token]

    def symbols(self, word: str, ends: bool = True) -> list[int]:
        return [self.vocab[c + self.suffix if ends and i == len(word) - 1 else c] for i, c in enumerate(word)]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the earliest merge that applies, leftmost first, until none does."""
        n = len(ids)
        following, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(ids)
        heap = [(self.rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = following[i] if alive[i] >= 0 else n
            if j >= n or alive[i] != a or alive[j] != b:
                continue
            alive[i], alive[j] = self.made[a, b], -1
            following[i] = following[j]
            if following[i] < n:
                before[following[i]] = i
                p = alive[i], alive[following[i]]
                if p in self.rank:
                    heapq.heappush(heap, (self.rank[p], i, *p))
            if before[i] >= 0:
                p = alive[before[i]], alive[i]
                if p in self.rank:
                    heapq.heappush(heap, (self.rank[p], before[i], *p))
        return [x for x in alive if x >= 0]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; the last token carries the end of the word."""
        out, at, n = [], 0, len(word)
        inner, final, longest = self.inner, self.final, self.longest
        while at < n:
            rest = n - at
            if rest <= longest:
                whole = final.get(word[at:])
                if whole is not None:
                    out.append(whole)
                    return out
            for k in range(min(longest, rest - 1), 0, -1):
                token = inner.get(word[at : at + k])
                if token is not None:
                    out.append(token)
                    at += k
                    break
        return out

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The order of merging each pair; past all merges where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], len(self.pair_keys))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging leaves them two.

        Undoes the later of the two tokens' last merges, step by step, and asks at each step
        whether the halves that then touch would have merged before that. Of two merges of
        one order the left one runs first.
        """
        n = len(a)
        a, b = a.astype(np.int64), b.astype(np.int64)
        good, live = np.ones(n, dtype=bool), np.arange(n)
        never = len(self.pair_keys)
        # 2 * order, and one more where the limit itself may not be reached from the left
        limit = np.full(n, 2 * never, dtype=np.int64)
        while len(live):
            x, y = a[live], b[live]
            crossing = 2 * self.rank_of(x, y)
            bad = crossing < limit[live]
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            ox, oy = self.order[x], self.order[y]
            live, x, y, ox, oy = (v[(ox >= 0) | (oy >= 0)] for v in (live, x, y, ox, oy))
            from_left = ox > oy
            # a merge inside the left token runs before a crossing one of the same order,
            # one inside the right token after it
            limit[live] = np.where(from_left, 2 * ox, 2 * oy + 1)
            a[live] = np.where(from_left, self.right[x], x)
            b[live] = np.where(from_left, y, self.left[y])
        return good

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of words in the byte alphabet."""
        proposed = [self.propose(w) for w in words]
        widths = np.array([len(p) for p in proposed], dtype=np.int64)
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(widths.sum()))
        owner = np.repeat(np.arange(len(words)), widths)
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.empty(0, np.int64)
        pairs, which = np.unique(flat[inside] << 32 | flat[inside + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failing = np.unique(owner[inside[~good[which]]])
        self.failed = len(failing)
        for i in failing.tolist():
            proposed[i] = self.merge(self.symbols(words[i]))
        if len(failing):
            widths = np.array([len(p) for p in proposed], dtype=np.int64)
            flat = np.fromiter((t for p in proposed for t in p), np.int64, int(widths.sum()))
        return flat, np.concatenate([[0], np.cumsum(widths)])

    def tables(self) -> None:
        self.words.clear()
        self.ids, self.bounds = np.empty(0, np.int64), np.zeros(1, np.int64)
        self.texts: list[bytes] = []

    def learn(self, new: list[str]) -> None:
        """Encodes words not seen yet and keeps them."""
        spelled = ["".join([self.alphabet[b] for b in w.encode()]) for w in new]
        flat, bounds = self.encode_words(spelled)
        first = len(self.words)
        for k, w in enumerate(new):
            self.words[w] = first + k
        self.ids = np.concatenate([self.ids, flat])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
        listed = flat.tolist()
        ends = bounds.tolist()
        self.texts += [b" ".join([self.strings[t] for t in listed[ends[k] : ends[k + 1]]]) for k in range(len(new))]

    def split(self, text: str) -> list[str]:
        """The words of one stretch of text without special tokens."""
        if text.isascii():
            return _ASCII_SPLIT.findall(text.lower())
        if not _OTHER.search(text):
            text = text.lower()
            if not _OTHER.search(text):
                return _PLAIN_SPLIT.findall(text)
        text = self.library.normalizer.normalize_str(text)
        return ["".join(bytes(self.to_bytes[c] for c in w).decode()) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """For each text its ids, and in UTF-8 what the library's decode gives for them."""
        taken = []
        for text in texts:
            parts = self.special_split.split(text) if any(t in text for t in self.special) else [text]
            taken.append([part if k % 2 else self.split(part) for k, part in enumerate(parts)])
        known = self.words
        all_words = dict.fromkeys(w for parts in taken for p in parts[::2] for w in p)
        new = [w for w in all_words if w not in known]
        if len(known) + len(new) > KEPT:
            self.tables()
            new = list(all_words)
        if new:
            self.learn(new)
        for parts in taken:
            ids, decoded = [], []
            for k, part in enumerate(parts):
                if k % 2:
                    ids.append(np.array([self.special[part]]))
                    decoded.append(part.encode())
                elif part:
                    at = np.fromiter(map(known.__getitem__, part), np.int64, len(part))
                    start, width = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
                    skip = np.cumsum(width) - width
                    ids.append(self.ids[np.repeat(start - skip, width) + np.arange(int(width.sum()))])
                    decoded.append(b" ".join(map(self.texts.__getitem__, at.tolist())))
            yield (np.concatenate(ids) if ids else np.empty(0, np.int64)), b" ".join(decoded)


_open: dict[str, Codec] = {}


def _codec(text: str) -> Codec:
    """One codec a worker and vocabulary."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _open:
        _open[key] = Codec(text)
    return _open[key]


def _encoded(vocabulary, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(keys):
                begin, held, some = at, 0, []
                while at < len(keys) and held < 500_000:  # characters
                    some.append(texts[at].as_py() or "")
                    held += len(some[-1])
                    at += 1
                counts, a, b = [], [], []
                for ids, decoded in codec.encode(some):
                    counts.append(len(ids))
                    a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() if digests else ids.astype(np.int32))
                    b.append(hashlib.sha256(decoded).hexdigest() if digests else decoded.decode())
                kind = pa.string() if digests else pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([keys[begin:at], pa.array(counts, pa.int64()), pa.array(a, kind), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "a", "b"])
        codec.tables()  # the worker may live on without encoding again

    return run


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``, or with ``digests`` their ``ids_sha256, decoded_sha256``.

    ``path`` is a tokenizers JSON file with word-level BPE. Ids are those of the library's
    encode without added special tokens, truncation or padding; ``decoded`` is what its
    decode, keeping special tokens, gives for them. Digests are lowercase hex of the ids as
    little-endian unsigned 32-bit integers and of the decoded text in UTF-8.

    Null and empty texts have no tokens and decode to the empty text. Repeated ids, null ids
    and repeated texts are separate rows. An empty table gives an empty table; other columns
    are neither read nor returned. Texts of any length are encoded whole.
    """
    with open(path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    kind = "string" if digests else "array<int>"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = slim.mapInArrow(_encoded(vocabulary, digests), f"doc_id long, n_tokens long, a {kind}, b string")
    return out.select("doc_id", "n_tokens", F.col("a").alias(names[0]), F.col("b").alias(names[1]))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), path or default_vocabulary(), digests=True)
