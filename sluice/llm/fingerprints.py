"""Document fingerprints by I-Match: hashes of a document's sorted distinct terms, for several lexicon subsets.

The lexicon holds the terms whose document frequency lies in a band, ``low`` to ``high`` as
shares of the distinct texts (that is a band of inverse document frequency; copies count once). It is split at
random, by a hash of the term, into G subsets; a document's signature for a subset is the hash of its sorted
distinct terms there. G follows the document's number of terms (the powers of two at and above it,
32 at least), so that a subset holds about one term of the document; 32 subsets
are kept for each of two adjacent G, so that texts of similar size have one G in common.

A document has few lexicon terms when they are under ``FEW`` or under ``FEW_SHARE`` of its distinct terms, as in a large
group of near copies, whose terms are all above the band, or in a rare language, whose terms are all
below it. Such a document has the signatures of all its distinct terms instead. A document with up to twice as many
has both, so that two texts on the two sides of the limit still have one kind in common.

Likeness of two fingerprints: the share of equal signatures among the subsets, at a common kind and G, in
which either document has a term; 0 without a common G (their numbers of terms then differ by a factor of over 2)
or without a common kind.

The band bounds the lexicon: a document has some D distinct terms on average, so at most D / ``low`` terms
reach the lower end. It is held in two tables of at least four slots per term (a power of two, ``2**max_slot_bits`` at most), each with
a tag of the slot's term, a byte each, which reach the tasks as the result of a subquery: never as literals, whose text
would stand in every description of the plan. Of two terms in one slot, the one with the higher frequency is in the lexicon; another term passes for a lexicon term by chance once
in 65,025 look-ups of taken slots. All is DataFrame expressions; nothing runs in Python.

Defined cases: a null text is an empty text; a text without a word has a hash of the whole
text as its fingerprint, likeness 1 to an equal one and 0 to others; equal texts have equal
fingerprints; null ids come after all others; rows with one id are in the order of their texts;
the document after the last is the first, and a single document follows itself; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, let, staged, words_of

SUBSETS = 32
#: Under so many lexicon terms, or under this share of all distinct terms, all terms are signed.
FEW, FEW_SHARE = 8, 0.1
EMPTY = -128


def lexicon_table(docs: DataFrame, *, text_col: str = "text", low: float = 0.0005, high: float = 0.02, least: int = 2, slot_bits: int | None = None, max_slot_bits: int = 20) -> DataFrame:
    """One row with two arrays: by slot, the tags (-127 to 127) of the lexicon term there, or ``EMPTY``."""
    texts = docs.select(F.coalesce(col(docs, text_col), F.lit("")).alias("text")).distinct()
    n = texts.agg(F.count("*").alias("n")).scalar()
    terms = texts.select(F.explode(term_hashes(F.col("text"))).alias("term"))
    kept = terms.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= F.greatest(F.lit(least), n * low)) & (F.col("df") <= F.greatest(F.lit(least), n * high)))
    kept = staged(kept, "fingerprint-lexicon")
    slots = 2 ** (slot_bits if slot_bits is not None else min(max_slot_bits, (4 * kept.count()).bit_length()))
    slot = F.pmod("term", F.lit(slots)).alias("slot")
    won = kept.groupBy(slot).agg(F.max(F.struct("df", "term"))["term"].alias("term"))
    cells = docs.sparkSession.range(slots).withColumnRenamed("id", "slot").join(won, "slot", "left")
    one, two = (F.coalesce(tag, F.lit(EMPTY)) for tag in _tags(F.col("term")))
    return cells.agg(F.sort_array(F.collect_list(F.struct("slot", one.alias("one"), two.alias("two")))).alias("cells")).select(F.col("cells.one").cast("array<tinyint>").alias("tags"), F.col("cells.two").cast("array<tinyint>").alias("more"))


def _tags(term: Column) -> list[Column]:
    return [(F.pmod(F.shiftright(term, bits), F.lit(255)) - 127).cast("int") for bits in (40, 52)]


def term_hashes(text: Column) -> Column:
    """Distinct hashes of the lower-case words."""
    return F.array_distinct(F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w)))


def _level(n: Column) -> Column:
    """5 or more: the power of two at or above the number of terms, of which there is one at least."""
    return F.greatest(F.lit(5), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int"))


def _signatures(terms: Column, groups: Column) -> Column:
    """For each of the subsets: four hexadecimal digits, or '----' without a term there."""
    def of_subset(near, r):
        own = F.filter(near, lambda t: t["subset"] == r)["term"]
        return F.when(F.size(own) == 0, "----").otherwise(F.substring(F.lpad(F.hex(F.xxhash64(own)), 16, "0"), 13, 4))

    placed = F.transform(terms, lambda t: F.struct(F.pmod(F.shiftright(t, 20), groups).alias("subset"), t.alias("term")))
    near = F.sort_array(F.filter(placed, lambda t: t["subset"] < SUBSETS))
    return let(near, lambda few: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda r: of_subset(few, r)))


def with_fingerprint(rows: DataFrame, tables: Column, text: str, name: str, slot_bits: int) -> DataFrame:
    """Add the struct ``name``: ``banded`` for the lexicon terms and ``every`` for all terms, each with its level and signatures at two levels, and ``whole`` for texts without terms."""
    slots = 2**slot_bits

    def signed(terms):
        level = _level(F.size(terms))
        return F.struct(
            level.alias("level"),
            let(F.pow(F.lit(2.0), level).cast("long"), lambda g: _signatures(terms, g)).alias("first"),
            let(F.pow(F.lit(2.0), level + 1).cast("long"), lambda g: _signatures(terms, g)).alias("second"),
        )

    def made(terms, known):
        few = F.greatest(F.lit(FEW), F.size(terms) * FEW_SHARE)
        return F.struct(
            F.when(F.size(known) >= few, signed(known)).alias("banded"),
            F.when((F.size(known) < 2 * few) & (F.size(terms) > 0), signed(terms)).alias("every"),
            F.when(F.size(terms) == 0, F.substring(F.sha2(F.col(text), 256), 1, 32)).alias("whole"),
        )

    def known(x):
        def holds(t, table, tag):
            return F.get(table, F.pmod(t, F.lit(slots)).cast("int")) == tag

        return F.filter(x["terms"], lambda t: holds(t, x["tables"]["tags"], _tags(t)[0]) & holds(t, x["tables"]["more"], _tags(t)[1]))

    # As it is written, a subquery may not stand in a function that takes lambdas. It is a column used once, beside plain columns only
    # (the explode ends what is computed before), so the optimizer moves it there and no row holds the tables.
    rows = rows.withColumn(text, F.explode(F.array(text)))
    both = F.struct(term_hashes(F.col(text)).alias("terms"), F.col("_tables").alias("tables"))
    return rows.withColumn("_tables", tables).withColumn(name, let(both, lambda x: let(known(x), lambda few: made(x["terms"], few)))).drop("_tables")


def as_text(f: Column) -> Column:
    def of(kind, mark):
        return F.when(kind.isNotNull(), F.concat_ws(":", F.concat(F.lit(mark), kind["level"].cast("string")), F.array_join(kind["first"], ""), F.array_join(kind["second"], "")))

    return F.when(f["whole"].isNotNull(), F.concat(F.lit("0:"), f["whole"])).otherwise(F.concat_ws(":", of(f["banded"], ""), of(f["every"], "all")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1."""

    def share(x, y):
        both = F.zip_with(x, y, lambda p, q: F.struct(((p != "----") | (q != "----")).cast("int").alias("any"), ((p == q) & (p != "----")).cast("int").alias("same")))
        sums = F.aggregate(both, F.struct(F.lit(0).alias("any"), F.lit(0).alias("same")), lambda s, z: F.struct((s["any"] + z["any"]).alias("any"), (s["same"] + z["same"]).alias("same")))
        return F.when(sums["any"] == 0, 0.0).otherwise(sums["same"] / F.greatest(sums["any"], F.lit(1)))

    def near(x, y):
        return (
            F.when((x["level"] == y["level"]) & (x["first"] == y["first"]) & (x["second"] == y["second"]), 1.0)
            .when(x["level"] == y["level"], share(x["first"], y["first"]))
            .when(x["level"] + 1 == y["level"], share(x["second"], y["first"]))
            .when(x["level"] == y["level"] + 1, share(x["first"], y["second"]))
            .otherwise(0.0)
        )

    return (
        F.when(a["whole"].isNotNull() | b["whole"].isNotNull(), (a["whole"].eqNullSafe(b["whole"])).cast("double"))
        .when(a["banded"].isNotNull() & b["banded"].isNotNull(), near(a["banded"], b["banded"]))
        .when(a["every"].isNotNull() & b["every"].isNotNull(), near(a["every"], b["every"]))
        .otherwise(0.0)
    )


def with_next(rows: DataFrame, carried: list[str], *, slot_rows: int = 4096, max_slots: int = 2000) -> DataFrame:
    """Add ``next_<c>`` for each carried column: its value in the following row by id, in a circle.

    Rows are dealt by ranges of the id. The first row of a range is also sent, marked, to the range
    before, where it closes the last pair; the bounds are ids that occur.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    rows = rows.withColumn("_key", key)
    n = rows.count()
    slots = max(1, min(max_slots, -(-n // slot_rows)))
    shares = [i / slots for i in range(slots)]
    got = rows.agg(F.min("_key").alias("least"), F.percentile_approx("_key", shares, max(10_000, 20 * slots)).alias("at")).first()
    bounds = sorted({got["least"], *(got["at"] or [])} - {None}) or [0]
    limits = F.lit(bounds).cast("array<bigint>")
    own = F.greatest(F.size(F.filter(limits, lambda b: b <= F.col("_key"))) - 1, F.lit(0))
    rows = rows.withColumn("_slot", own)
    ends = F.when(F.array_contains(limits, F.col("_key")), F.array(F.struct(F.col("_slot").alias("s"), F.lit(0).alias("e")), F.struct(F.pmod(F.col("_slot") - 1, F.lit(len(bounds))).alias("s"), F.lit(1).alias("e"))))
    dealt = rows.withColumn("_to", F.explode(F.coalesce(ends, F.array(F.struct(F.col("_slot").alias("s"), F.lit(0).alias("e")))))).withColumns({"_slot": F.col("_to.s"), "_end": F.col("_to.e")}).drop("_to")
    order = Window.partitionBy("_slot").orderBy("_end", "_key", "text")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where("_end = 0").drop("_key", "_slot", "_end")


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slot_bits: int | None = None, **band) -> tuple[DataFrame, Column, int]:
    """Per row: id, ``text``, ``fp`` and, for the document after it, ``next_text`` and ``next_fp``; the lexicon's tables (a subquery) and their slot bits."""
    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), F.coalesce(col(docs, text_col), F.lit("")).alias("text"))
    found = staged(lexicon_table(docs, text_col=text_col, slot_bits=slot_bits, **band), "fingerprint-tables")
    bits = found.select(F.size("tags").alias("n")).first()["n"].bit_length() - 1
    tables = found.select(F.struct("tags", "more").alias("tables")).scalar()
    return with_next(with_fingerprint(rows, tables, "text", "fp", bits), ["text", "fp"]), tables, bits


def compare_fingerprints(docs: DataFrame, **options) -> DataFrame:
    """Per row: the fingerprint of the text, of its edited text, and their likeness; likeness to the next."""
    rows, tables, bits = fingerprint_documents(docs, **options)
    n = F.char_length("text")
    k = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k)))
    rows = with_fingerprint(rows.drop("next_text"), tables, "edited", "edited_fp", bits)
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
