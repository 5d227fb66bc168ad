"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio per document.

Words and pairs of adjacent words are hashed to slots, a power of two that follows the corpus (``slot_bytes`` bytes of text
for each, up to ``2**max_slot_bits``). Two multinomials over the slots are counted, one over the trusted documents (label 1)
and one over the whole corpus. A document's score is the mean over its n-grams of log(p trusted / p corpus), so
length does not matter. It is kept if it passes the base rules and its score reaches ``threshold``.

Two things make scores alike at every size of the corpus. An n-gram is scored without its own occurrence: one is
taken from its slot's corpus count, and from the trusted count if the document is trusted; otherwise every rare n-gram of a
trusted document would speak for it, and every one of another document against it. And each count is smoothed by a share
``smoothing`` of the mean count of a slot, so a slot without other occurrences says nothing, whatever the totals are.

Everything is a DataFrame expression; nothing runs in Python. The model is two whole numbers per slot (sixteenths, from -127 to
127, for trusted and for other documents), which reach the tasks as constants; the bound of the slots bounds them. Spark
keeps the numbers of a constant array as objects, of which there are only so few when the numbers are small, so look-ups
stay in the processor's cache; rounding cancels out in a mean. Above the bound a slot holds more n-grams, and the
ratio follows the more frequent ones.

Defined cases: a null text has no words and is not kept (n_words < 20); labels that are null
or of unknown ids do not count, and an id labelled twice is trusted only if all its labels are 1; without
trusted documents every ratio is 0, and the base rules decide; repeated rows get equal results;
an empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, array_literal, col, let, staged, words_of

#: Fixed set of symbol characters.
SYMBOLS = "#*$%&|<>"
#: Steps of a log ratio.
UNIT = 16


def _pairs(a: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` later; shorter by ``step``."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y))


def repeated_words(windows: Column, width: int) -> Column:
    """Words covered by windows (given as hashes by position) that occur twice or more.

    Positions and hashes are sorted by hash; a position is marked when a neighbour has the same hash.
    The marked positions, in order, each add the words not covered by the one before.
    """
    none = F.lit(None).cast("bigint")

    def positions(pairs):
        n = F.size(pairs)
        before = F.concat(F.array(none), F.slice(pairs["h"], F.lit(1), n - 1))
        after = F.concat(F.slice(pairs["h"], F.lit(2), n - 1), F.array(none))
        marked = F.transform(
            F.arrays_zip(pairs.alias("p"), before.alias("b"), after.alias("a")),
            lambda z: F.when(z["p"]["h"].eqNullSafe(z["b"]) | z["p"]["h"].eqNullSafe(z["a"]), z["p"]["i"]),
        )
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    at = let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), positions)
    start = F.struct(F.lit(0).alias("covered"), F.lit(-width).alias("last"))
    got = F.aggregate(at, start, lambda acc, i: F.struct((acc["covered"] + F.least(F.lit(width), i - acc["last"])).alias("covered"), i.alias("last")))
    return got["covered"]


def base_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the base counts, ``h1`` (word hashes) and ``h2`` (hashes of adjacent words)."""
    rows = docs.select(col(docs, id_col).alias("doc_id"), F.coalesce(col(docs, text_col), F.lit("")).alias("text")).withColumn("words", words_of(F.col("text")))
    bare = F.col("text")
    for s in SYMBOLS:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(bare)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )
    rows = rows.select("*", _pairs(F.col("h1"), 1).alias("h2"))
    rows = rows.select("*", _pairs(_pairs(F.col("h2"), 2), 4).alias("h8"))
    repeats = F.when(F.size(F.array_distinct("h8")) < F.size("h8"), repeated_words(F.col("h8"), 8)).otherwise(F.lit(0))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"), "h1", "h2",
    )


def slot_bits_for(docs: DataFrame, text_col: str, slot_bytes: int, max_slot_bits: int) -> int:
    """The power of two of the slots: one for each ``slot_bytes`` bytes of text."""
    total = docs.agg(F.sum(F.octet_length(col(docs, text_col))).alias("b")).first()["b"] or 0
    return max(8, min(max_slot_bits, (total // slot_bytes).bit_length()))


def ratio_model(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slot_bits: int = 12, smoothing: float = 0.5, group_slots: int = 1 << 14) -> DataFrame:
    """Rows ``part, own, other``, by part the sixteenths of log(p trusted / p corpus) of ``group_slots`` slots each:
    for the n-grams of trusted documents and of others. ``trusted`` has the column ``doc_id``."""
    slots = 2**slot_bits
    rows = docs.select(col(docs, id_col).alias("doc_id"), col(docs, text_col).alias("text"))
    ids = trusted.select(F.col("doc_id").alias("t_id")).where("t_id IS NOT NULL").distinct().hint("shuffle_hash")

    def counted(some: DataFrame, name: str) -> DataFrame:
        h = some.select(F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h1"))
        each = h.select(F.explode(F.concat("h1", _pairs(F.col("h1"), 1))).alias("h"))
        return each.groupBy(F.pmod("h", F.lit(slots)).alias("slot")).agg(F.count("*").alias(name))

    near = counted(rows.join(ids, F.col("doc_id") == F.col("t_id"), "left_semi"), "trusted")
    every = docs.sparkSession.range(slots).withColumnRenamed("id", "slot").join(counted(rows, "raw"), "slot", "left").join(near, "slot", "left")
    every = staged(every.select("slot", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("trusted", F.lit(0)).alias("trusted")), "quality-slots")
    sums = every.agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).first()
    if not sums["trusted"]:
        return docs.sparkSession.createDataFrame([], "part long, own array<int>, other array<int>")
    per_raw, per_trusted = smoothing * sums["raw"] / slots, smoothing * sums["trusted"] / slots
    scale = F.log(F.lit(sums["raw"] / sums["trusted"]))

    def ratio(trusted_count: Column) -> Column:
        near_, all_ = F.log(trusted_count + per_trusted), F.log(F.greatest(F.col("raw") - 1, F.lit(0)) + per_raw)
        return F.least(F.lit(127), F.greatest(F.lit(-127), F.round(UNIT * (near_ - all_ + scale)).cast("int")))

    both = F.struct("slot", ratio(F.greatest(F.col("trusted") - 1, F.lit(0))).alias("own"), ratio(F.col("trusted")).alias("other"))
    grouped = every.groupBy(F.floor(F.col("slot") / group_slots).alias("part")).agg(F.sort_array(F.collect_list(both)).alias("cells"))
    return grouped.select("part", F.col("cells.own").alias("own"), F.col("cells.other").alias("other"))


def apply_quality_rules(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", slot_bytes: int = 256, max_slot_bits: int = 17, threshold: float = -0.15, smoothing: float = 0.5,
) -> DataFrame:
    """Per row: id, base counts, ``base_failed``, ``score`` (mean log ratio) and ``kept``."""
    marks = staged(labels.groupBy(col(labels, id_col).alias("doc_id")).agg(F.min(col(labels, label_col)).alias("mark")).where("mark = 1 AND doc_id IS NOT NULL").select("doc_id"), "quality-trusted")
    bits = slot_bits_for(docs, text_col, slot_bytes, max_slot_bits)
    model = sorted(ratio_model(docs, marks, id_col=id_col, text_col=text_col, slot_bits=bits, smoothing=smoothing).collect(), key=lambda r: r["part"])
    own, other = ([x for r in model for x in r[name]] or [0] * 2**bits for name in ("own", "other"))
    rows = base_counts(docs, id_col=id_col, text_col=text_col).select("*", F.concat("h1", "h2").alias("grams")).drop("h1", "h2")

    def total(table: list[int]) -> Column:
        values = array_literal(table)
        return F.aggregate("grams", F.lit(0).cast("long"), lambda acc, h: acc + F.get(values, F.pmod(h, F.lit(2**bits)).cast("int")))

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    n = float(UNIT) * F.greatest(F.size("grams"), F.lit(1))
    scored = rows.select("*", (total(own) / n).alias("_own"), (total(other) / n).alias("_other"), failed.alias("base_failed")).drop("grams")
    ids = marks.select(F.col("doc_id").alias("t_id"))
    return (
        scored.join(ids, F.col("doc_id") == F.col("t_id"), "left")
        .withColumn("score", F.when(F.col("t_id").isNotNull(), F.col("_own")).otherwise(F.col("_other"))).drop("_own", "_other", "t_id")
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    )
