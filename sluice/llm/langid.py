"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of its
documents. A text is cut into pieces of at most ``piece_bytes``; each piece is compressed on
its own with every dictionary, and the language whose dictionary gives the smallest total wins.
(Without the pieces a long text would serve as its own dictionary.) Dictionaries and texts are
lower-cased, and runs of ASCII characters that are no letters count as one space. Short texts
are compressed at a higher level, which finds matches of three bytes. When the two smallest
totals differ by less than ``min_margin`` of the second, the verdict is marked as not accepted.

The sample is the only bounded part: at most ``sample_docs`` distinct training texts per language, those with the
smallest hash, each with one passage from a place that a hash of the text chooses, cut at ``dict_bytes`` bytes
of dictionary. So neither copies nor a shared opening fill a dictionary. Every language has a dictionary, and every text is
scored whole with all of them: compressors are made for ``group`` languages at a time, and each text keeps its
two smallest totals from group to group. The driver and each Python task hold all dictionaries.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the
language with more training rows, then to the first by code point; repeated rows get equal results; no training row at
all gives ``und`` for every text; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, slices

LETTER = re.compile(r"[^\W\d_]")
#: ASCII characters that are not letters, mapped to a space.
TO_SPACE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def letters(text: str) -> bytes:
    """Lower-case letters with single spaces between, as UTF-8."""
    return b" ".join(text.lower().encode().translate(TO_SPACE).split())


def train_dictionaries(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 128, dict_bytes: int = 64 << 10) -> list[tuple[str, bytes]]:
    """(language, dictionary content) of every language, the most frequent first."""
    rows = train.select(col(train, lang_col).alias("lang"), col(train, text_col).alias("text")).where("lang IS NOT NULL AND length(text) > 0")
    # an equal share of each sampled text, so that one long text does not fill the dictionary
    share = max(512, dict_bytes // sample_docs)
    place = F.pmod(F.xxhash64("text", F.lit("place")), F.greatest(F.char_length("text") - share + 1, F.lit(1))).cast("int") + 1
    hashed = rows.select("lang", F.xxhash64("text").alias("h"), F.substring(F.col("text"), place, F.lit(share)).alias("text")).distinct()
    names = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    best = Window.partitionBy("lang").orderBy("h", "text")
    found: dict[str, list[bytes]] = {n: [] for n in names}
    for r in hashed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= sample_docs).orderBy("lang", "rank").collect():
        found[r["lang"]].append(letters(r["text"])[:share])
    return [(n, b" ".join(found[n])[:dict_bytes]) for n in names]


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]], level: int = 5, short_level: int = 19, short_bytes: int = 256, piece_bytes: int = 2048, group: int = 200):
        self.names, self.piece, self.short, self.levels = [n for n, _ in dictionaries], piece_bytes, short_bytes, (level, short_level)
        self.groups = [dictionaries[i : i + group] for i in range(0, len(dictionaries), group)]
        self.kept = self._coders(self.groups[0]) if len(self.groups) == 1 else None

    def _coders(self, dictionaries: list[tuple[str, bytes]]) -> list[list[zstandard.ZstdCompressor]]:
        """The compressors of a group, for texts and for short texts."""
        return [[self._coder(d, level) for _, d in dictionaries] for level in self.levels]

    @staticmethod
    def _coder(content: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def classify_all(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score and margin of each text. Score: 0.5 at a tie, 1 at a margin of 20 % or more."""
        data = [letters(t) if t and LETTER.search(t) else None for t in texts]
        # smallest total, its language, second smallest total
        least: list[tuple[int, int, int] | None] = [None] * len(texts)
        first = 0
        for dictionaries in self.groups:
            long_coders, short_coders = self.kept or self._coders(dictionaries)
            for k, d in enumerate(data):
                if d is None:
                    continue
                pieces = [d[i : i + self.piece] for i in range(0, len(d), self.piece)]
                for i, c in enumerate(short_coders if len(d) <= self.short else long_coders, first):
                    size = sum(len(c.compress(p)) for p in pieces)
                    was = least[k]
                    if was is None:
                        least[k] = (size, i, -1)
                    elif size < was[0]:
                        least[k] = (size, i, was[0])
                    elif was[2] < 0 or size < was[2]:
                        least[k] = (was[0], was[1], size)
            first += len(dictionaries)
        return [self._verdict(x) for x in least]

    def _verdict(self, least: tuple[int, int, int] | None) -> tuple[str, float, float]:
        if least is None:
            return "und", 0.0, 0.0
        size, best, second = least
        if second < 0:
            return self.names[best], 1.0, 1.0
        margin = (second - size) / max(1, second)
        return self.names[best], min(1.0, 0.5 + margin * 2.5), margin

    def classify(self, text: str | None) -> tuple[str, float, float]:
        return self.classify_all([text])[0]


def predict_language(docs: DataFrame, dictionaries: list[tuple[str, bytes]], *, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.01, level: int = 5, piece_bytes: int = 2048) -> DataFrame:
    """Per row: id, ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``accepted``."""

    def predict(batches):
        classifier = Classifier(dictionaries, level, piece_bytes=piece_bytes)
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                got = classifier.classify_all(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64()), pa.array([g[0] != "und" and g[2] >= min_margin for g in got], pa.bool_())],
                    names=["doc_id", "lang_pred", "score", "margin", "accepted"],
                )

    two = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text"))
    return two.mapInArrow(predict, "doc_id long, lang_pred string, score double, margin double, accepted boolean")


def identify_languages(docs: DataFrame, train_where: Column, **options) -> DataFrame:
    """Train on the rows where ``train_where`` holds, predict all rows."""
    return predict_language(docs, train_dictionaries(docs.where(train_where)), **options)
