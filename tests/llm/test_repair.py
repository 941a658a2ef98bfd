"""Repair of conversations against a search over all edits."""

import itertools
import random
from hashlib import sha256
from zlib import crc32

from thicket.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, place long, block long, audit string"
BLANKS = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, "x") for r in rows], SCHEMA).repartition(4)


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, kind = " " if role is None else role, " " if text is None else text, crc32(name.encode()) % 20
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults_by_hand(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        ink = text.strip(BLANKS)
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest_by_hand(rows, faults):
    """The least (cost, audit, lines) to each state, row after row."""
    nxt = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    names = {2: "user", 3: "assistant"}

    def closed(found):
        for _ in range(3):
            for i, (cost, audit, lines) in list(found.items()):
                for r in "ua":
                    if i in nxt[r]:
                        k = nxt[r][i]
                        new = (cost + 5, audit + "I", (*lines, f"{names[k]}:"))
                        found[k] = min(found.get(k, new), new)
        return found

    found = closed({0: (0, "", ())})
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for i, (cost, audit, lines) in found.items():
            options = [(i, cost + 2, "D", ())]
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                options += [(nxt[r][i], cost + more, "K", (f"{role}:{text}",)) for r in "sua" if role[:1] == r and i in nxt[r]]
                options += [(nxt[r][i], cost + 1 + more, "R", (f"{names[nxt[r][i]]}:{text}",)) for r in "ua" if i in nxt[r]]
            for k, c, letter, line in options:
                entry = (c, audit + letter, lines + line)
                new[k] = min(new.get(k, entry), entry)
        found = closed(new)
    return min(found[k] for k in (0, 3) if k in found)


def by_hand(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(([" " if x is None and n > 1 else x for n, x in enumerate(r)] for r in rows if r[0] == conv), key=key)
        faults, turns = faults_by_hand(own), {r[1] for r in own if r[1] is not None}
        cost, audit, lines = cheapest_by_hand(own, faults)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows, **options):
    summary, edits = repair.repair(rows, **options)
    texts = {r.conv_id: r.repaired_sha256 for r in repair.digests(edits).collect()}
    empty = sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, texts.get(r.conv_id, empty)) for r in summary.collect()}


def drawn(rng, convs, most):
    rows = []
    for conv in convs:
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Über", "understudy"])
            text = rng.choice(["Hello there.", "No end", "Yes!", "", None, " \n", "Really? \t", "日本。", "same.", f"text {turn}.", f"t {turn}", "a:b\nuser:c."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


def test_against_a_search(spark):
    rng = random.Random(11)
    rows = drawn(rng, [*range(60), None, -5], 9)
    rows += rows[:3] + [(777, None, None, None), (778, -(1 << 63), "user", "x."), (778, (1 << 63) - 1, "assistant", "y.")]
    want = by_hand(rows)
    want[778] = ((1 << 63) - 1, *want[778][1:])
    assert repaired(spark, frame(spark, rows)) == want


def test_damage(spark):
    rows = drawn(random.Random(12), [*range(50), None], 8)
    got = [tuple(r) for r in repair.damaged(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(damaged_by_hand(rows), key=repr)


def test_a_long_conversation_in_blocks(spark):
    rng = random.Random(13)
    rows = [(1, n, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice([f"line {n}.", f"line {n}.", f"cut {n}", "again."])) for n in range(700)]
    rows += drawn(rng, range(2, 12), 20)
    assert repaired(spark, frame(spark, rows), block=8, fan=3) == by_hand(rows)


def test_cells_of_spans():
    """Every cut of a span gives the same cell."""
    rng = random.Random(14)
    for _ in range(60):
        code = "".join(rng.choice(list(repair.CODES)) for _ in range(rng.randint(2, 9)))
        for cut in range(len(code) + 1):
            assert repair.combine(repair.span_cell(code[:cut]), repair.span_cell(code[cut:])) == repair.span_cell(code)


def test_no_rows(spark):
    summary, edits = repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA)))
    assert summary.count() == 0 and repair.digests(edits).count() == 0


def test_query_returns_conversations_without_rows(spark, tmp_path):
    from thicket.llm.catalog import QUERIES

    gone = next(n for n in range(1000) if crc32(f"{n}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "dropped."), *drawn(random.Random(15), [None], 5)]
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())} | by_hand(damaged_by_hand(rows[1:]))
