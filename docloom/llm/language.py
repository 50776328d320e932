"""Language identification by rank-order n-gram profiles.

A profile is the ``PROFILE`` most frequent letter n-grams (1 to 3 letters, word
boundaries included) in order of frequency.  A document's profile is compared with
each language's by out-of-place distance: the sum of rank differences, with the
largest one for n-grams that the language's profile lacks.

Profiles are fitted on about ``ROWS_PER_LANGUAGE`` rows a language outside the
held-out fold, chosen by a hash of doc_id, so a language with most of the rows costs
no more; predictions read every row's whole text without a shuffle.

Texts that are null or have no letter are ``und`` with score 0.0, as is everything
if no row has a lang to learn from.  Ties go to the language that sorts first.  lang,
source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import common

PROFILE = 300
#: Expected number of training rows for each language.
ROWS_PER_LANGUAGE = 1500
#: Training ids, 8 bytes each, are broadcast up to this count and joined by shuffle beyond.
BROADCAST_IDS = 1_000_000
UNKNOWN = "und"


def letter_table():
    """True for code points that are letters."""
    import sys

    import numpy as np

    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def gram_counts(text: str, is_letter):
    """Distinct n-gram codes in ascending order, with counts.  A code has 21 bits a letter, 0 at word boundaries."""
    import numpy as np

    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(is_letter[points], points, 0)
    padded = np.concatenate([[0], points, [0]])
    kept = padded[(padded != 0) | np.concatenate([[True], padded[:-1] != 0])]  # one boundary between words
    if len(kept) < 3:
        return None
    left, mid, right = kept[:-2] << 42, kept[1:-1] << 21, kept[2:]
    inner = kept[1:-1] != 0
    codes = np.concatenate([kept[1:-1][inner], (left >> 21) + (mid >> 21), mid[-1:] + right[-1:], (left + mid + right)[inner]])
    return np.unique(codes, return_counts=True)


def ranked(codes, counts):
    """The most frequent codes, by count and then code."""
    import numpy as np

    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


class Profiles:
    """Profiles of all languages over the union of their n-grams."""

    def __init__(self, profiles: dict[str, list[int]]):
        import numpy as np

        self.names = sorted(profiles)
        self.grams = np.unique(np.concatenate([np.array(profiles[n], np.int64) for n in self.names])) if self.names else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for row, n in zip(self.ranks, self.names):
            row[np.searchsorted(self.grams, profiles[n])] = np.arange(len(profiles[n]))
        self.is_letter = common.per_process("letters", letter_table)

    def predict(self, text: str | None) -> tuple[str, float]:
        import numpy as np

        found = gram_counts(text or "", self.is_letter)
        if found is None or not self.names:
            return UNKNOWN, 0.0
        top = ranked(*found)
        at = np.searchsorted(self.grams, top)
        at = np.where((at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == top), at, len(self.grams))
        theirs = self.ranks[:, at]
        away = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(away))
        rest = np.delete(away, best)
        # How much nearer the best is than the next; the only language is as sure as it is near.
        sure = 1 - away[best] / max(1, rest.min()) if len(rest) else 1 - away[best] / (PROFILE * len(top))
        return self.names[best], float(min(1.0, max(0.0, sure)))


def training_rows(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """(lang, text) of the training rows; ids are chosen before texts are read."""
    known = docs.where(docs["lang"].isNotNull() & docs["doc_id"].isNotNull() & ~common.fold_is_held_out(docs["doc_id"])).select("doc_id", "lang")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    scale = F.lit(1 << 30)
    picked = known.join(sizes, "lang").where(F.pmod(F.xxhash64("doc_id"), scale) < scale * (F.lit(per_language) / F.col("n"))).select("doc_id", "lang")
    picked = common.settled(picked)
    few = picked.count() <= BROADCAST_IDS
    return docs.select("doc_id", common.text_of(docs).alias("text")).join(F.broadcast(picked) if few else picked, "doc_id").select("lang", "text")


def fit(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> dict[str, list[int]]:
    """Each language's n-gram codes in rank order.  Rows are counted where they are read;
    counts are summed by language and code; PROFILE codes a language come to the driver,
    300 for each value of lang that there is."""

    def count(batches):
        from collections import defaultdict

        import numpy as np
        import pyarrow as pa

        is_letter = common.per_process("letters", letter_table)
        sums = defaultdict(dict)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, mine = gram_counts(text, is_letter), sums[lang]
                if found is not None:
                    for code, n in zip(found[0].tolist(), found[1].tolist()):
                        mine[code] = mine.get(code, 0) + n
        for lang, mine in sums.items():
            codes, counts = np.fromiter(mine, np.int64, len(mine)), np.fromiter(mine.values(), np.int64, len(mine))
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(mine), "code": codes, "n": counts})

    def top(batches):
        from collections import defaultdict

        import numpy as np
        import pyarrow as pa

        held = defaultdict(list)
        for batch in batches:
            for lang, code, n in zip(*(c.to_pylist() for c in batch.columns)):
                held[lang].append((-n, code))
        for lang, grams in held.items():
            grams = sorted(grams)[:PROFILE]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(grams), "code": np.array([c for _, c in grams], np.int64), "n": np.array([-n for n, _ in grams], np.int64)})

    kind = "lang string, code long, n long"
    sums = training_rows(docs, per_language).mapInArrow(count, kind).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # Each task keeps its PROFILE best of every language; a second exchange by language leaves PROFILE of each.
    best: dict[str, list] = {}
    for r in sums.mapInArrow(top, kind).repartition("lang").mapInArrow(top, kind).collect():
        best.setdefault(r["lang"], []).append((-r["n"], r["code"]))
    return {lang: [code for _, code in sorted(grams)] for lang, grams in best.items()}


def predict(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def start():
        known = Profiles(sent.value)

        def fn(keys, texts):
            found = [known.predict(t) for t in texts]
            return [keys[0], [x for x, _ in found], [s for _, s in found]]

        return fn

    return common.map_texts(docs, ["doc_id"], "doc_id long, lang_pred string, score double", start)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs))
    return found.select("doc_id", common.fold_is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
