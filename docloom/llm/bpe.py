"""Byte-level BPE encoding and decoding.

Each word is held as contiguous arrays: its parts and the merge rank of every
adjacent pair.  The smallest rank is found by scanning, its boundary deleted and
the two neighbouring ranks refreshed.  Scanning is quadratic, so words longer
than ``SHORT_WORD`` bytes take a heap over linked parts, with the same result.
Words repeat, so a bounded cache maps white-space-delimited chunks to their ids, as
tuples that share one integer object for each id.

Null and empty texts encode to no ids and decode to "".  Row order, repeated
rows and additional columns do not matter.  The special string of the vocabulary
becomes its own id.  Nothing is truncated or padded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from itertools import chain

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import common

SHORT_WORD = 128
CACHE_ENTRIES = 150_000
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1
NO_RANK = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class PairMerger:
    """Merges a word's parts by pair rank; parts are token ids.

    Pairs are keyed by ``left << ID_BITS | right`` and ranks held as
    ``rank << ID_BITS | merged id``, so that plain integers are compared.
    """

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.pair_rank: dict[int, int] = {}
        for at, (left, right, new) in enumerate(merges):
            self.pair_rank.setdefault(left << ID_BITS | right, at << ID_BITS | new)

    def merge(self, parts: list[int]) -> list[int]:
        return self._scan(parts) if len(parts) <= SHORT_WORD else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank_of = self.pair_rank.get
        return self.merge_ranked(parts, [rank_of(a << ID_BITS | b, NO_RANK) for a, b in zip(parts, parts[1:])])

    def merge_ranked(self, parts: list[int], ranks: list[int]) -> list[int]:
        """parts with the ranks of their adjacent pairs, merged in place."""
        rank_of = self.pair_rank.get
        while ranks and (best := min(ranks)) != NO_RANK:
            at = ranks.index(best)
            new = parts[at] = best & ID_MASK
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of(new << ID_BITS | parts[at + 1], NO_RANK)
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] << ID_BITS | new, NO_RANK)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        rank_of, n = self.pair_rank.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (rank := rank_of(a << ID_BITS | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = rank & ID_MASK, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (rank := rank_of(parts[left] << ID_BITS | parts[right])) is not None:
                    heapq.heappush(heap, (rank, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]


class Uneven(Exception):
    """A text with more than single spaces between chunks."""


class ByteBpe:
    """Encoder and decoder for one byte-level vocabulary file, given as its JSON text."""

    #: The public pattern that splits text before the merges; white space as Unicode defines it.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})")

    #: Marks that never join a letter.
    STOPS = frozenset(",.!?;:")

    def __init__(self, source: str):
        import regex

        spec = json.loads(source)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        as_byte = {c: b for b, c in enumerate(letters)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merger = PairMerger([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.byte_id = [vocab[c] for c in letters]
        rank_of = self.merger.pair_rank.get
        self.byte_ranks = [[rank_of(a << ID_BITS | b, NO_RANK) for b in self.byte_id] for a in self.byte_id]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(as_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.shared = tuple(range(len(self.bytes_of))).__getitem__
        self.words = regex.compile(self.PATTERN).findall
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.word_ids = common.Remembered(self._word, CACHE_ENTRIES // 5)
        self.chunk_ids = common.Remembered(self._chunk, CACHE_ENTRIES)

    def _word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8")
        if len(raw) > SHORT_WORD:
            return tuple(map(self.shared, self.merger.merge([self.byte_id[b] for b in raw])))
        byte_id, byte_ranks = self.byte_id, self.byte_ranks
        merged = self.merger.merge_ranked([byte_id[b] for b in raw], [byte_ranks[a][b] for a, b in zip(raw, raw[1:])])
        return tuple(map(self.shared, merged))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk that stands after one space; Uneven, not remembered, if white space at its ends meets that of others."""
        if chunk.isalpha():  # one word, likely a rare one
            return self._word(" " + chunk)
        if chunk[-1:] in self.STOPS and chunk[:-1].isalpha():
            return self._word(" " + chunk[:-1]) + self.word_ids[chunk[-1]]
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Uneven
        return tuple(chain.from_iterable(map(self.word_ids.__getitem__, self.words(" " + chunk))))

    def _plain(self, text: str) -> list[int]:
        # Between single spaces a chunk is split alike wherever it stands, so its ids can be kept.
        if not text:
            return []
        chunks = iter(text.split(" "))
        first = next(chunks)
        if first and not first[0].isspace() and not first[-1].isspace():
            try:
                ids = list(chain.from_iterable(map(self.word_ids.__getitem__, self.words(first))))
                ids.extend(chain.from_iterable(map(self.chunk_ids.__getitem__, chunks)))
                return ids
            except Uneven:
                pass
        return list(chain.from_iterable(map(self.word_ids.__getitem__, self.words(text))))

    def encode(self, text: str) -> list[int]:
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return list(chain.from_iterable([self.special[p]] if p in self.special else self._plain(p) for p in self.split_special.split(text)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


def _shared(spark: SparkSession, vocabulary: str | None):
    """The vocabulary's text for all tasks; its size is fixed by the file, about 1.5 MB."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        source = f.read()
    sent = spark.sparkContext.broadcast(source)
    return lambda: common.per_process(("bpe", hash(sent.value)), lambda: ByteBpe(sent.value))


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs (doc_id, text)."""
    codec = _shared(docs.sparkSession, vocabulary)

    def start():
        bpe = codec()
        return lambda keys, texts: [keys[0], [bpe.encode(t) for t in texts]]

    return common.map_texts(docs, ["doc_id"], "doc_id long, ids array<int>", start)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) for every row of encoded (doc_id, ids); null ids give ""."""
    codec = _shared(encoded.sparkSession, vocabulary)

    def run(batches):
        import pyarrow as pa

        bpe = codec()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [bpe.decode(ids or []) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_checked(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trips): encode, decode again and compare with the text."""
    codec = _shared(docs.sparkSession, vocabulary)

    def start():
        bpe = codec()

        def fn(keys, texts):
            ids = [bpe.encode(t) for t in texts]
            return [keys[0], list(map(len, ids)), ids, [bpe.decode(i) == t for i, t in zip(ids, texts)]]

        return fn

    return common.map_texts(docs, ["doc_id"], "doc_id long, n_tokens long, ids array<int>, round_trips boolean", start)


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode and decode in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    codec = _shared(docs.sparkSession, vocabulary)

    def start():
        bpe = codec()
        decimal = list(map(str, range(len(bpe.bytes_of))))
        sha = hashlib.sha256

        def digest(keys, texts):
            counts, of_ids, of_texts = [], [], []
            for text in texts:
                ids = bpe.encode(text)
                counts.append(len(ids))
                of_ids.append(sha(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                of_texts.append(sha(bpe.decode(ids).encode("utf-8")).hexdigest())
            return [keys[0], counts, of_ids, of_texts]

        return digest

    return common.map_texts(docs, ["doc_id"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", start)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))
