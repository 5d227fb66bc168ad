"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from itertools import product

import brute
import pytest
from test_operators import same, tuples

from sluice.llm import conversations as c
from sluice.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
REPORT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SHAPE = re.compile(r"(s?(ua)+)?")
SCHEMA = "n string, text string, role string, conv_id bigint, turn bigint, slot int, conv string, key string"


def damaged(rows):
    """(conv, turn, role, text) after damage."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    """0 blank, 1 duplicate, 2 truncated, 3 none, of one conversation's rows (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append(0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3)
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, lines): forward over (roles so far), all edits tried."""
    # what came before matters only by its last initial and whether it is empty; of equal cost the smaller audit wins
    step = lambda state, r: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, r))
    best = {"": (0, "", ())}

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    to = step(state, role[0])
                    if to is not None and (to not in best or (cost + 3, audit + "I") < best[to][:2]):
                        best[to] = (cost + 3, audit + "I", (*lines, f"{role}:"))
        return best

    for (role, text), mark in zip(rows, marks, strict=True):
        new = {}
        for state, (cost, audit, lines) in inserted(best).items():
            extra = 3 if mark == 2 else 0
            options = [("D", state, 4, lines)]
            if mark >= 2:
                options += [("K", step(state, role[:1]), extra, (*lines, f"{role}:{text}"))]
                options += [("R", step(state, r[0]), 3 + extra, (*lines, f"{r}:{text}")) for r in ("user", "assistant")]
            for letter, to, price, after in options:
                if to is not None and (to not in new or (cost + price, audit + letter) < new[to][:2]):
                    new[to] = (cost + price, audit + letter, after)
        best = new
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def audited(rows, every=None):
    """Report of each conversation."""
    by = {conv: [] for conv in every or []}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn, " " if role is None else role, hashlib.md5((" " if text is None else text).encode()).hexdigest(), " " if text is None else text))
    out = []
    for conv, own in by.items():
        own.sort()
        turns = {r[1] for r in own} - {None}
        lines = [(r[2], r[4]) for r in own]
        marks = faults(lines)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        cost, audit, repaired = cheapest(lines, marks)
        assert SHAPE.fullmatch("".join(x[:1] for x in repaired))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(k) for k in range(3)), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return out


def talk():
    """Nulls, ties, repeated rows, blanks, odd roles, gaps, and one conversation that holds a third of the rows."""
    rng = random.Random(8)
    texts = ["Well.", "no end", "Why? \t", "", " \n", None, "é!", "one. two", "Well. ", "a:b\nuser:c."]
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
    rows = [(conv, turn, role(), rng.choice(texts) if rng.random() < 0.3 else f"Text {rng.randrange(10**6)}.") for conv in range(60) for turn in range(rng.randint(0, 9))]
    rows += [(conv, rng.choice([0, 1, 5, None]), role(), rng.choice(texts)) for conv in (100, 101, None) for _ in range(12)]
    rows += [(7000, rng.choice([t, t, None]), role(), rng.choice(texts) if rng.random() < 0.1 else f"Long {t}.") for t in range(170)]
    rows += [(7000, 3, "user", "Long copy.")] * 25 + [(7000, None, "assistant", "no end")] * 5
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return talk()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([("n", t, r, c, k, 1, "c", "k") for c, k, r, t in rows], SCHEMA).repartition(3)


def test_damage(frame, rows):
    same(tuples(c.damage(frame), "conv_id", "turn", "role", "text"), damaged(rows))


@pytest.mark.parametrize("options", [{}, {"max_rows": 3, "slot_bytes": 500}, {"max_rows": 0, "slot_bytes": 1 << 20}, {"max_rows": 50, "slot_bytes": 2000}])
def test_audit(frame, rows, options):
    same(tuples(c.audit_conversations(frame, **options), *REPORT), audited(rows))


@pytest.mark.parametrize("options", [{}, {"max_rows": 3, "slot_bytes": 500}])
def test_repaired_turns_give_the_digest(frame, rows, options):
    lines = {}
    for r in sorted(c.repair_conversations(frame, **options).collect(), key=lambda r: r["seq"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert r["edit"] in "KRI"
    assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in lines.items()} == {r[0]: r[-1] for r in audited(rows) if r[-1] != c.EMPTY}


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], SCHEMA)
    assert c.audit_conversations(none).count() == 0 and c.audit_conversations(c.damage(none), none).count() == 0
    assert c.repair_conversations(none).count() == 0
    ids = spark.createDataFrame([(1,), (1,), (None,)], "conv_id bigint")
    same(tuples(c.audit_conversations(none, ids), *REPORT), [(i, 0, 0, 0, 0, 0, 0, "", c.EMPTY) for i in (1, None)])


def test_powers_equal_steps_one_by_one():
    steps = c.Steps()
    for symbol in range(9):
        v = c.END
        for n, here in enumerate(steps.within(symbol, 40, c.END)):
            assert here == v == steps.before(symbol, n, c.END)
            v = c.product(steps.power(symbol, 0), v)
        assert c.product(steps.matrix([(symbol, 21), (3, 2)]), c.END) == steps.after([(symbol, 21), (3, 2)])[0]


def test_every_short_conversation():
    """All sequences of up to four symbols: the cost and the letters of the plain search."""
    steps, roles = c.Steps(), ["system", "user", "assistant", "x"]
    for n in range(5):
        for symbols in product(range(9), repeat=n) if n < 4 else random.Random(1).sample(list(product(range(9), repeat=4)), 800):
            rows = [("x", "t") if s == 0 else (roles[(s - 1) // 2], "t") for s in symbols]
            runs = c.runs_of((s, 1) for s in symbols)
            cost, after = steps.after(runs)
            letters, state = steps.unroll(runs, after, 0)
            want = cheapest(rows, [0 if s == 0 else 3 - (s - 1) % 2 for s in symbols])
            assert (cost[0], letters + c.closing(state)) == want[:2]
            assert tuple(f"{r}:{t}" for _, r, t in c.turns_of(letters + c.closing(state), ((r, t, 3 if r == "x" else "sua".index(r[0])) for r, t in rows))) == want[2]


def test_query_matches_the_plain_version(spark):
    table = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    out = QUERIES["op13_conversations"](spark, SF)
    assert {k for n, k in out.dtypes if n in REPORT[:7]} == {"bigint"}
    same(tuples(out, *REPORT), audited(damaged(table), {r[0] for r in table}))
