"""Conversation structure repair: the cheapest edits to an optional system turn and user/assistant pairs.

The edits of one row are Keep (free, if its role fits), Rerole to the role that fits (3), Delete (4; the only one
for a blank row and for one whose role and text came earlier); a row with an empty text may be inserted anywhere (3);
a truncated row that stays adds 3. Four states say what fits next: nothing yet, after system, after user, after assistant.

A row is a symbol (its role's initial and its fault), and a symbol is a 4 x 4 transition matrix of costs. Equal
consecutive symbols are one run. The costs to go before a run come from those after it by the binary powers of its
symbol's min-plus matrix, which are made once and cached; then the runs are unrolled forward, each row taking the
smallest letter (D, I, K, R) that keeps the cost. So the audit is the smallest string among the cheapest.

Conversations are dealt by their id and stream through the tasks in order, one in memory at a time. Those over ``max_rows``
rows or ``max_bytes`` bytes of text go another way: equal rows become one row with a number, rows are cut into range slots, a
chunk (the rows of one conversation in one slot) becomes one matrix, the matrices compose to the costs after each chunk,
each chunk is unrolled from all four states, and the states chain. No task holds such a conversation; only its
audit, one string by contract, and its digest, which SHA-256 computes in order, are built by one task, as streams.

Defined cases: a null role or text is one space; rows go by turn, null turns first, then role, then the MD5 of the text
(so equal rows are adjacent); a null conversation id is an ordinary id; an initial other than s, u, a
never fits; an empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, col, staged

REROLE, INSERT, DELETE, TRUNCATED = 3, 3, 4, 3
FAR = 1 << 60
EMPTY = hashlib.sha256(b"").hexdigest()
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. What an inserted or reroled row leads to.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: Costs to go at the end: nothing or a closed pair is complete, else rows are inserted.
END = (0, 2 * INSERT, INSERT, 0)
#: Initials by number; any other is the last. Symbols: 0 must be deleted, else 1 + 2 * initial + truncated.
INITIALS = "sua"
LEGAL = {(0, 1), (1, 2), (2, 1)}
Vector = tuple[int, ...]
Run = tuple[int, int]


def keeps(initial: int, state: int) -> int | None:
    """The state after a kept row, if it fits."""
    if initial == 0:
        return 1 if state == 0 else None
    return NEXT[state] if initial == (2 if state == 2 else 1) else None


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, next state, cost) of the edits of a row, letters ascending."""
    out = [("D", state, DELETE)]
    if symbol:
        initial, extra = (symbol - 1) // 2, TRUNCATED * ((symbol - 1) % 2)
        to = keeps(initial, state)
        out += [] if to is None else [("K", to, extra)]
        out.append(("R", NEXT[state], REROLE + extra))
    return out


def product(m: tuple[Vector, ...], v: Vector) -> Vector:
    """Min-plus product of a matrix and a vector of costs to go."""
    return tuple(min(FAR, *(a + b for a, b in zip(row, v, strict=True))) for row in m)


class Steps:
    """Transition matrices of the symbols and their binary powers, each made once."""

    def __init__(self):
        self.powers: dict[tuple[int, int], tuple[Vector, ...]] = {}
        self.edits = [[edits(s, p) for p in range(4)] for s in range(9)]

    def power(self, symbol: int, k: int) -> tuple[Vector, ...]:
        """The matrix of 2**k rows of a symbol, insertions before each included."""
        m = self.powers.get((symbol, k))
        if m is None:
            if k:
                half = self.power(symbol, k - 1)
                columns = [product(half, column) for column in zip(*half, strict=True)]
            else:
                columns = []
                for q in range(4):
                    own = [min((c for _, to, c in self.edits[symbol][p] if to == q), default=FAR) for p in range(4)]
                    for _ in range(3):  # an insertion leads on; three in a row never pay
                        own = [min(own[p], INSERT + own[NEXT[p]]) for p in range(4)]
                    columns.append(tuple(own))
            m = self.powers[symbol, k] = tuple(zip(*columns, strict=True))
        return m

    def before(self, symbol: int, n: int, v: Vector) -> Vector:
        """Costs to go before a run, from those after it."""
        k = 0
        while n >> k:
            if n >> k & 1:
                v = product(self.power(symbol, k), v)
            k += 1
        return v

    def within(self, symbol: int, n: int, v: Vector) -> list[Vector]:
        """Costs to go with 0, 1, ... n rows of the run left; each power doubles what is known."""
        out, k = [v], 0
        while len(out) <= n:
            out += [product(self.power(symbol, k), x) for x in out[: n + 1 - len(out)]]
            k += 1
        return out

    def after(self, runs: list[Run], v: Vector = END) -> tuple[Vector, list[Vector]]:
        """Costs to go before all runs, and after each."""
        out = []
        for symbol, n in reversed(runs):
            out.append(v)
            v = self.before(symbol, n, v)
        return v, out[::-1]

    def matrix(self, runs: list[Run]) -> tuple[Vector, ...]:
        """The transition matrix of all runs."""
        columns = [self.after(runs, tuple(0 if p == q else FAR for p in range(4)))[0] for q in range(4)]
        return tuple(zip(*columns, strict=True))

    def unroll(self, runs: list[Run], after: list[Vector], state: int) -> tuple[str, int]:
        """The smallest cheapest letters from a state, and the state they end in."""
        letters: list[str] = []
        for (symbol, n), v in zip(runs, after, strict=True):
            if symbol == 0:  # an insertion can always wait until after a deletion
                letters.append("D" * n)
                continue
            left = self.within(symbol, n, v)
            for k in range(n, 0, -1):
                while True:
                    cost = left[k][state]
                    if DELETE + left[k - 1][state] == cost:
                        letters.append("D")
                        break
                    if INSERT + left[k][NEXT[state]] == cost:
                        letters.append("I")
                        state = NEXT[state]
                        continue
                    letter, state = next((x, to) for x, to, c in self.edits[symbol][state][1:] if c + left[k - 1][to] == cost)
                    letters.append(letter)
                    break
        return "".join(letters), state


def closing(state: int) -> str:
    """The insertions that complete a conversation."""
    return "I" * (END[state] // INSERT)


def runs_of(symbols) -> list[Run]:
    """Runs of (symbol, times), equal neighbours joined."""
    out: list[Run] = []
    for symbol, n in symbols:
        if out and out[-1][0] == symbol:
            out[-1] = (symbol, out[-1][1] + n)
        elif n:
            out.append((symbol, n))
    return out


def turns_of(letters, rows, state: int = 0):
    """(edit, role, text) of what the letters leave; ``rows`` yields (role, text, initial)."""
    rows = iter(rows)
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            yield "I", ROLE[state], ""
            continue
        role, text, initial = next(rows)
        if letter == "D":
            continue
        state = NEXT[state] if letter == "R" else keeps(initial, state)
        yield letter, ROLE[state] if letter == "R" else role, text


def damage(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows after reproducible damage, chosen by the CRC-32 of ``conversation:turn`` modulo 20 (nulls: one space):
    0 drops a row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats it, 4 makes its role user."""
    space = F.lit(" ")
    conv, turn, role, text = (col(rows, c) for c in (conv_col, turn_col, role_col, text_col))
    four = rows.select(conv.alias("conv"), turn.cast("long").alias("turn"), F.coalesce(role, space).alias("role"), F.coalesce(text, space).alias("text"))
    kind = F.crc32(F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    four = four.withColumn("_kind", kind).where("_kind <> 0")
    worse = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    four = four.withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))).withColumn("text", worse)
    return four.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col)
    )


# ---------------------------------------------------------------- conversations that fit into memory


def _prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text, key (of the text), initial (number), blank, truncated."""
    space = F.lit(" ")
    four = rows.select(
        col(rows, conv_col).alias("conv"), col(rows, turn_col).cast("long").alias("turn"),
        F.coalesce(col(rows, role_col), space).alias("role"), F.coalesce(col(rows, text_col), space).alias("text"),
    )
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    first = F.substring("role", 1, 1)
    initial: Column = F.when(first == INITIALS[0], 0)
    for k, letter in enumerate(INITIALS[1:], 1):
        initial = initial.when(first == letter, k)
    return four.select(
        "*", F.md5(F.col("text").cast("binary")).alias("key"), initial.otherwise(len(INITIALS)).alias("initial"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _whole(rows: DataFrame, with_turns: bool) -> DataFrame:
    """Report rows, or turns, of conversations that are each solved in memory, one after the other."""
    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, seq long, edit string, role string, text string" if with_turns else f"conv {kind}, {REPORT}, audit string, repaired_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches):
        steps, arrow = Steps(), None

        def solve(conv, own):
            seen, symbols, counts, illegal = set(), [], [0, 0, 0], 0
            for r in own:
                fault = 0 if r["blank"] else 1 if (r["role"], r["key"]) in seen else 2 if r["truncated"] else 3
                seen.add((r["role"], r["key"]))
                if fault < 3:
                    counts[fault] += 1
                symbols.append((0, 1) if fault < 2 else (1 + 2 * r["initial"] + (fault == 2), 1))
            illegal = sum((a["initial"], b["initial"]) not in LEGAL for a, b in zip(own, own[1:]))
            turns = {r["turn"] for r in own} - {None}
            runs = runs_of(symbols)
            cost, after = steps.after(runs)
            letters, state = steps.unroll(runs, after, 0)
            letters += closing(state)
            done = turns_of(letters, ((r["role"], r["text"], r["initial"]) for r in own))
            if with_turns:
                return [(conv, i, *x) for i, x in enumerate(done)]
            digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in done).encode()).hexdigest()
            return [(conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost[0], letters, digest)]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), arrow, strict=True)], names)

        own, out, size = [], [], 0
        for batch in batches:
            arrow = arrow or [batch.schema.field("conv").type, *([pa.int64()] + [pa.string()] * 3 if with_turns else [pa.int64()] * 6 + [pa.string()] * 2)]
            for r in batch.to_pylist():
                if own and own[0]["conv"] != r["conv"]:
                    out += solve(own[0]["conv"], own)
                    size, own = size + len(own), []
                    if size >= 4096:
                        yield batch_of(out)
                        out, size = [], 0
                own.append(r)
        if own:
            yield batch_of(out + solve(own[0]["conv"], own))

    order = ("conv", F.col("turn").asc_nulls_first(), "role", "key")
    return rows.repartition("conv").sortWithinPartitions(*order).mapInArrow(work, schema)


# ---------------------------------------------------------------- conversations of any length


def _long(rows: DataFrame, slot_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(report without the digest, turns) of conversations that no task holds."""
    kind = rows.schema["conv"].dataType.simpleString()
    same = ["conv", "turn", "role", "key", "initial", "blank", "truncated"]
    once = staged(rows.groupBy(*same).agg(F.count("*").alias("n"), F.min("text").alias("text")), "turns-once")
    first = once.groupBy(F.col("conv").alias("f_conv"), F.col("role").alias("f_role"), F.col("key").alias("f_key")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("there"), "turn")).alias("f"))
    on = once["conv"].eqNullSafe(F.col("f_conv")) & (once["role"] == F.col("f_role")) & (once["key"] == F.col("f_key"))
    marked = once.join(first, on).select(*same, "n", "text", once["turn"].eqNullSafe(F.col("f.turn")).alias("fresh"))
    slots = max(1, -(-int(once.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("b")).first()["b"]) // slot_bytes))
    order = (F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("key").asc())
    slotted = staged(marked.repartitionByRange(slots, *order).withColumn("slot", F.spark_partition_id()), "turns-slots")
    bare = slotted.drop("text")

    def ordered(table: pa.Table) -> list[dict]:
        return sorted(table.to_pylist(), key=lambda r: (r["turn"] is not None, r["turn"], r["role"], r["key"]))

    def chunk_runs(own: list[dict]) -> list[Run]:
        return runs_of(s for r in own for s in (((0, r["n"]),) if r["blank"] or not r["fresh"] else ((1 + 2 * r["initial"] + r["truncated"], 1), (0, r["n"] - 1))))

    def frame(out: list[tuple], types: list, names: list[str]) -> pa.Table:
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    many = pa.list_(pa.int64())
    chunk_names = ["conv", "slot", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "head", "tail", "matrix"]

    def measure(table: pa.Table) -> pa.Table:
        own = ordered(table)
        turns = [r["turn"] for r in own if r["turn"] is not None]
        blank = sum(r["n"] for r in own if r["blank"])
        duplicate = sum(r["n"] - r["fresh"] for r in own if not r["blank"])
        truncated = sum(r["fresh"] and r["truncated"] for r in own if not r["blank"])
        illegal = sum(r["n"] - 1 for r in own) + sum((a["initial"], b["initial"]) not in LEGAL for a, b in zip(own, own[1:]))
        matrix = [x for row in Steps().matrix(chunk_runs(own)) for x in row]
        row = (own[0]["conv"], own[0]["slot"], blank, duplicate, truncated, illegal, turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), own[0]["initial"], own[-1]["initial"], matrix)
        return frame([row], [table.schema.field("conv").type, pa.int32(), *[pa.int64()] * 9, many], chunk_names)

    chunks = staged(
        bare.groupBy("conv", "slot").applyInArrow(measure, f"conv {kind}, slot int, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, head long, tail long, matrix array<long>"),
        "turns-chunks",
    )

    def compose(table: pa.Table) -> pa.Table:
        """From the last chunk to the first: costs after each; the counts stand in the first."""
        own, v, out = sorted(table.to_pylist(), key=lambda r: r["slot"]), END, []
        for r in reversed(own):
            out.append([r["conv"], r["slot"], list(v)])
            v = product(tuple(tuple(r["matrix"][4 * p : 4 * p + 4]) for p in range(4)), v)
        gone, there = 0, [r for r in own if r["low"] is not None]
        gone = sum(a["high"] == b["low"] for a, b in zip(there, there[1:]))
        gaps = there[-1]["high"] - there[0]["low"] + 1 - sum(r["turns"] for r in there) + gone if there else 0
        illegal = sum(r["illegal"] for r in own) + sum((a["tail"], b["head"]) not in LEGAL for a, b in zip(own, own[1:]))
        counts = (gaps, *(sum(r[c] for r in own) for c in ("blank", "duplicate", "truncated")), illegal, v[0])
        rows = [(*r, *(counts if i == len(out) - 1 else (None,) * 6)) for i, r in enumerate(out)]
        return frame(rows, [table.schema.field("conv").type, pa.int32(), many, *[pa.int64()] * 6], ["conv", "slot", "after", *COUNTS])

    composed = staged(chunks.groupBy("conv").applyInArrow(compose, f"conv {kind}, slot int, after array<long>, {REPORT}"), "turns-composed")

    def choices(left: pa.Table, right: pa.Table) -> pa.Table:
        """The letters of a chunk from each state, and where they end."""
        own, steps = ordered(left), Steps()
        runs = chunk_runs(own)
        after = steps.after(runs, tuple(right.column("after")[0].as_py()))[1]
        found = [steps.unroll(runs, after, p) for p in range(4)]
        return frame([(own[0]["conv"], own[0]["slot"], [x for x, _ in found], [p for _, p in found])], [left.schema.field("conv").type, pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())], ["conv", "slot", "letters", "ends"])

    chosen = staged(
        bare.groupBy("conv", "slot").cogroup(composed.select("conv", "slot", "after").groupBy("conv", "slot")).applyInArrow(choices, f"conv {kind}, slot int, letters array<string>, ends array<int>"),
        "turns-choices",
    )

    def chain(table: pa.Table) -> pa.Table:
        state, out = 0, []
        own = sorted(table.to_pylist(), key=lambda r: r["slot"])
        for r in own:
            out.append((r["conv"], r["slot"], state, closing(r["ends"][state]) if r is own[-1] else ""))
            state = r["ends"][state]
        return frame(out, [table.schema.field("conv").type, pa.int32(), pa.int32(), pa.string()], ["conv", "slot", "state", "closing"])

    states = chosen.select("conv", "slot", "ends").groupBy("conv").applyInArrow(chain, f"conv {kind}, slot int, state int, closing string").select(F.col("conv").alias("t_conv"), F.col("slot").alias("t_slot"), "state", "closing")
    parts = chosen.join(states, F.col("conv").eqNullSafe(F.col("t_conv")) & (F.col("slot") == F.col("t_slot")))
    parts = staged(parts.select("conv", "slot", "state", F.concat(F.get("letters", F.col("state")), "closing").alias("letters")), "turns-letters")
    audits = parts.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "letters"))), lambda x: x["letters"]), "").alias("audit"))
    report = composed.where("cost IS NOT NULL").select(F.col("conv").alias("r_conv"), *COUNTS).join(audits, F.col("r_conv").eqNullSafe(F.col("conv"))).select("conv", *COUNTS, "audit")

    def turns(left: pa.Table, right: pa.Table) -> pa.Table:
        own, how = ordered(left), right.to_pylist()[0]
        rows = ((r["role"], r["text"], r["initial"]) for r in own for _ in range(r["n"]))
        out = [(how["conv"], (how["slot"] << 40) + i, *x) for i, x in enumerate(turns_of(how["letters"], rows, how["state"]))]
        return frame(out, [left.schema.field("conv").type, pa.int64(), pa.string(), pa.string(), pa.string()], ["conv", "seq", "edit", "role", "text"])

    done = slotted.groupBy("conv", "slot").cogroup(parts.groupBy("conv", "slot")).applyInArrow(turns, f"conv {kind}, seq long, edit string, role string, text string")
    return report, done


def _digests(turns: DataFrame) -> DataFrame:
    """conv and the SHA-256 of its ``role:text`` lines; the rows stream through in order."""
    kind = turns.schema["conv"].dataType.simpleString()

    def work(batches):
        conv, hasher, first, arrow = None, None, True, None
        out: list[tuple] = []
        for batch in batches:
            arrow = batch.schema.field("conv").type
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "role", "text")), strict=True):
                if hasher is None or c != conv:
                    if hasher is not None:
                        out.append((conv, hasher.hexdigest()))
                    conv, hasher, first = c, hashlib.sha256(), True
                hasher.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if hasher is not None:
            out.append((conv, hasher.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], arrow), pa.array([h for _, h in out])], ["conv", "repaired_sha256"])

    return turns.repartition("conv").sortWithinPartitions("conv", "seq").mapInArrow(work, f"conv {kind}, repaired_sha256 string")


def _split(rows: DataFrame, max_rows: int, max_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of conversations that fit into memory, rows of the others)."""
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    large = staged(sizes.where((F.col("n") > max_rows) | (F.col("b") > max_bytes)).select(F.col("conv").alias("l_conv")), "turns-large")
    if large.isEmpty():
        return rows, None
    own = rows["conv"].eqNullSafe(large["l_conv"])
    return rows.join(large, own, "left_anti"), rows.join(large, own, "left_semi")


def repair_conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", max_rows: int = 20_000, max_bytes: int = 16 << 20, slot_bytes: int = 16 << 20) -> DataFrame:
    """Turns after repair: the conversation, ``seq`` (rising in its order), edit (K, R or I), role, text; deleted rows are gone."""
    small, large = _split(_prepared(rows, conv_col, turn_col, role_col, text_col), max_rows, max_bytes)
    out = _whole(small, True)
    out = out if large is None else out.unionByName(_long(large, slot_bytes)[1])
    return out.withColumnRenamed("conv", conv_col)


def audit_conversations(rows: DataFrame, ids: DataFrame | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", max_rows: int = 20_000, max_bytes: int = 16 << 20, slot_bytes: int = 16 << 20) -> DataFrame:
    """Per conversation: gaps in its turns, rows by first fault (blank, duplicate, truncated), illegal neighbours, cost, audit
    (the letters of the edits) and ``repaired_sha256`` of the repaired lines. Conversations of ``ids`` without rows count as empty."""
    small, large = _split(_prepared(rows, conv_col, turn_col, role_col, text_col), max_rows, max_bytes)
    out = _whole(small, False)
    if large is not None:
        report, turns = _long(large, slot_bytes)
        digests = _digests(turns).withColumnRenamed("conv", "d_conv")
        out = out.unionByName(report.join(digests, F.col("conv").eqNullSafe(F.col("d_conv")), "left").drop("d_conv").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(EMPTY))))
    if ids is not None:
        every = ids.select(col(ids, conv_col).alias("e_conv")).distinct()
        out = every.join(out, F.col("e_conv").eqNullSafe(F.col("conv")), "left").select(
            F.col("e_conv").alias("conv"), *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS],
            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"),
        )
    return out.withColumnRenamed("conv", conv_col)
