"""Token counts with a whole-token shortcut.

Before any text is read, every vocabulary string is encoded alone; those that give
exactly one token form the proven set.  A pre-token in that set counts 1 without
merging, the rest are merged by rank.  Counts per white-space-free chunk are kept
in a bounded cache.

Null and empty texts have 0 bytes and 0 tokens.  Special strings inside a text
count as one token each.  Texts are never truncated.
"""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import common
from docloom.llm.bpe import CACHE_ENTRIES, PairMerger, byte_letters

TOKEN_LIMIT = 2048

# Capital letters of Unicode 16, which Python's own tables may lack, and their small letters.
NEW_CAPITALS = {
    0x1C89: 0x1C8A,
    0xA7CB: 0x0264,
    0xA7CC: 0xA7CD,
    0xA7DA: 0xA7DB,
    0xA7DC: 0x019B,
    **{0x10D50 + i: 0x10D70 + i for i in range(22)},  # Garay
}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCounter:
    """Counts the tokens of a word-end BPE vocabulary, given as its JSON text."""

    #: The public pattern of pre-tokens.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"

    def __init__(self, source: str):
        import regex

        spec = json.loads(source)
        vocab = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merger = PairMerger([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.letters = byte_letters()
        self.id_of = vocab
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.split_special = re.compile("|".join(map(re.escape, self.special)))
        self.pieces = regex.compile(self.PATTERN).findall
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.odd_space = re.compile("[\x1c-\x1f]").search  # white space to str.split only
        self.new_capital = re.compile("[" + "".join(map(chr, NEW_CAPITALS)) + "]").search
        self.cache = common.Remembered(self._chunk, 2 * CACHE_ENTRIES)
        self.single = self.proven()

    def merged(self, piece: str) -> int:
        """Tokens of one pre-token by merging."""
        letters, id_of = self.letters, self.id_of
        shown = [letters[b] for b in piece.encode("utf-8")]
        shown[-1] += self.end
        return len(self.merger.merge([i for c in shown if (i := id_of.get(c)) is not None]))

    def proven(self) -> frozenset[str]:
        """The pre-tokens that are vocabulary strings and encode alone as one token."""
        as_byte = {c: b for b, c in enumerate(self.letters)}
        found = set()
        for token in self.id_of:
            if not token.endswith(self.end) or token == self.end:
                continue
            try:
                piece = bytes(as_byte[c] for c in token.removesuffix(self.end)).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if self.merged(piece) == 1:
                found.add(piece)
        return frozenset(found)

    def _chunk(self, chunk: str) -> int:
        single, merged = self.single, self.merged
        if chunk in single and chunk.isalpha():
            return 1
        return sum(1 if p in single else merged(p) for p in self.pieces(chunk))

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letter by letter: no final sigma
            if self.new_capital(text):
                text = text.translate(NEW_CAPITALS)
        text = text.lower()
        chunks = self.spaces.split(text) if self.odd_space(text) else text.split()
        return sum(map(self.cache.__getitem__, chunks))

    def count(self, text: str) -> int:
        if not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.split_special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text)."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # the file's size, about 1.7 MB

    def start():
        counter = common.per_process(("words", hash(sent.value)), lambda: WordCounter(sent.value))

        def count(keys, texts):
            n = [counter.count(t) for t in texts]
            return [keys[0], [len(t.encode("utf-8")) for t in texts], n, [x > limit for x in n]]

        return count

    return common.map_texts(docs, ["doc_id"], "doc_id long, n_bytes long, n_tokens long, over_limit boolean", start)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
