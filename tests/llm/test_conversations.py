import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from loadwarden.llm import conversations as c

SF = "/root/testdata/sf0.001"
FORM = re.compile("(s?(ua)+)?")


def all_repairs(rows):
    """(cost, audit, repaired) of the best of all repairs with up to two insertions in each gap, by trying every one."""
    n, best = len(rows), None
    for gaps in product(range(3), repeat=n + 1):
        if sum(gaps) > n + 2:
            continue
        inserts = ["I" * g for g in gaps]
        for edits in product("KRD", repeat=n):
            if any(f in (c.BLANK, c.DUPLICATE) and e != "D" for e, (_, _, f) in zip(edits, rows)):
                continue
            audit = "".join(i + e for i, e in zip(inserts, edits)) + inserts[-1]
            cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[e] for e in audit)
            cost += sum(f == c.TRUNCATED and e != "D" for e, (_, _, f) in zip(edits, rows))
            if best and (cost, audit) >= best[:2]:
                continue
            free = [(e, row) for e, row in zip(re.sub("I", "", audit), rows)]
            kept, at = [], 0
            for e in audit:
                if e == "I":
                    kept.append((None, ""))
                else:
                    e, (role, text, _) = free[at]
                    at += 1
                    if e != "D":
                        kept.append((role if e == "K" else None, text))
            for lead in ([], ["s"]):
                body = len(kept) - len(lead)
                if body < 0 or body % 2 or (lead and not body):
                    continue
                roles = lead + ["u", "a"] * (body // 2)
                if all(r[:1] == want if r is not None else want != "s" for (r, _), want in zip(kept, roles)):
                    names = [r if r is not None else {"u": "user", "a": "assistant"}[w] for (r, _), w in zip(kept, roles)]
                    best = cost, audit, [(r, t) for r, (_, t) in zip(names, kept)]
    return best


def test_lightest_derivation_is_the_best_of_all_repairs():
    rng = random.Random(7)
    for _ in range(250):
        rows = [(rng.choice(["user", "assistant", "system", "tool", " "]), f"t{k}", rng.choice([None, None, None, c.TRUNCATED, c.BLANK, c.DUPLICATE]))
                for k in range(rng.randint(0, 4))]
        want = all_repairs(rows)
        cost, audit = c.lightest([(r[:1], f) for r, _, f in rows], c.FINAL)[c.START]
        assert (cost, audit) == want[:2], rows
        assert c.apply_audit([(r, t) for r, t, _ in rows], audit) == want[2]


def test_segments_compose_to_the_whole():
    rng = random.Random(8)
    for _ in range(300):
        rows = [(rng.choice("uasx"), rng.choice([None, None, c.TRUNCATED, c.BLANK, c.DUPLICATE])) for _ in range(rng.randint(0, 14))]
        cuts = sorted(rng.choices(range(len(rows) + 1), k=rng.randint(0, 4)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        tables = [{(before, after): way for after in c.STATES for before, way in c.lightest(p, (after,), c.STATES).items()} for p in parts]
        cost, steps = c.compose(tables)
        assert (cost, "".join(a for _, a in steps)) == c.lightest(rows, c.FINAL)[c.START]


def by_the_rule(given, modulus=20):
    """Results from plain loops over the damaged rows; the repair itself is `lightest`, which the test above holds against all repairs."""
    after = defaultdict(list)
    for conv, turn, role, text in given:
        rows = after[conv]
        text, role = " " if text is None else text, " " if role is None else role
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % modulus
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        rows += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, rows in after.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        faults = []
        for k, (_, role, text) in enumerate(rows):
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append(c.BLANK if not body else c.DUPLICATE if (role, text) in [r[1:] for r in rows[:k]] else None if body[-1] in ".!?" else c.TRUNCATED)
        initials = [r[:1] for _, r, _ in rows]
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit = c.lightest(list(zip(initials, faults)), c.FINAL)[c.START]
        repaired = c.apply_audit([r[1:] for r in rows], audit)
        assert FORM.fullmatch("".join(r[:1] for r, _ in repaired))
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in (c.BLANK, c.DUPLICATE, c.TRUNCATED)),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def digests(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
                        hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in r.repaired).encode()).hexdigest()) for r in frame.collect()}


def test_query_on_whole_table(spark):
    from loadwarden.llm.catalog import QUERIES
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_conversations"](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    want = by_the_rule(given)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert len(rows) == len(want) and {r[0]: r[1:] for r in rows} == want


@pytest.mark.parametrize("most_rows", [1, 3, 4096])
def test_long_and_open_conversations(spark, most_rows):
    rng = random.Random(most_rows)
    given = [(conv, turn, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Same.", "Open", f"Text {turn}.", f"Text {turn}", " "]))
             for conv, n in ((1, 5), (2, 300), (3, 1), (4, 40), (5, 2)) for turn in rng.sample(range(2 * n), n)]
    frame = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").repartition(5)
    assert digests(c.repair(c.damage(frame), most_rows)) == by_the_rule(given)


def test_edge_rows(spark):
    rows = [(None, 1, "user", "Null id."), (None, 2, None, "No role."), (1, None, "user", None), (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi!"),
            (2, None, None, None), (3, 5, "user", "Long text. " * 50_000), (3, 6, "assistant", ""), (4, 9, "system", "Only."), (5, 1, "user", "a\t\n"), (5, 7, "", "No name.")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, sig string, part int")
    assert digests(c.repair(c.damage(frame))) == by_the_rule(rows)
    # a modulus of one drops every row, and the conversations stay
    none = digests(c.repair(c.damage(frame, 1)))
    assert set(none) == {r[0] for r in rows} and set(none.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert c.repair(c.damage(frame.limit(0))).count() == 0


def test_repeated_rows_are_duplicates_but_one(spark):
    rows = [(1, 1, "user", "Again.")] * 50 + [(1, 2, "assistant", "Yes.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = c.repair(frame, 8).first()
    assert got.duplicate == 49 and got.cost == 3 * 49 and got.audit == "K" + "D" * 49 + "K"
