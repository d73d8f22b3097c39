import hashlib
import itertools
import random
import re
import zlib

import pytest

import labelwright.llm.repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, DIGEST int, is_row string"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        part = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{part(conv)}:{part(turn)}".encode()) % 20
        role, text = part(role), part(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        stripped = text.strip(BLANKS)
        out.append("b" if not stripped else "d" if (role, text) in seen else "t" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """All ways, one row after another: the cheapest per state, then the least edits."""
    def inserts(ways):
        grown = dict(ways)
        for _ in range(2):
            for (state, has_s), way in list(grown.items()):
                after = ("a" if state == "u" else "u", has_s)
                new = (way[0] + 2, way[1] + "I", way[2] + [("assistant" if state == "u" else "user", "")])
                grown[after] = min(grown.get(after, new), new)
        return grown

    ways = {("", False): (0, "", [])}
    for (_, _, role, text), kind in zip(rows, kinds):
        new = {}

        def offer(state, way):
            new[state] = min(new.get(state, way), way)

        for (state, has_s), (cost, edits, lines) in inserts(ways).items():
            offer((state, has_s), (cost + 3, edits + "D", lines))
            if kind in "bd" and kind:
                continue
            cut = kind == "t"
            turn = "a" if state == "u" else "u"
            if role[:1] == turn or (role[:1] == "s" and state == ""):
                offer((role[:1], has_s or role[:1] == "s"), (cost + cut, edits + "K", lines + [(role, text)]))
            offer((turn, has_s), (cost + 2 + cut, edits + "R", lines + [({"u": "user", "a": "assistant"}[turn], text)]))
        ways = new
    return min(way for (state, _), way in inserts(ways).items() if state in ("", "a"))


def expected(rows):
    out = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in rows}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest())
    left = damage(rows)
    for conv in {row[0] for row in left}:
        mine = sorted((r for r in left if r[0] == conv), key=order)
        kinds = faults(mine)
        cost, edits, lines = cheapest(mine, kinds)
        turns = {r[1] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, *(kinds.count(k) for k in "bdt"), illegal, cost, edits, sha)
    return out


def conversations(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "é ist 🙂!\n", " \t", None, "", f"say {rng.randint(0, 9)}?"])
            out.append((conv, rng.choice([turn, turn, turn, None, turn // 2]), role, text, 1, "x"))
    return out


def reported(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = repair.report(df, repair.damaged(df)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_equals_brute_force(spark):
    rows = conversations(1, 300, 7)
    rows += [(None, 1, "user", "Hi.", 1, "x"), (None, None, "assistant", "Hello.", 1, "x"), (None, 1, "user", "Hi.", 1, "x")]
    rows += rows[:40] + [(10**6, 5, "user", "long! " * 200_000, 1, "x")]
    assert reported(spark, rows) == expected(rows)


@pytest.mark.parametrize("block, chunk", [(1, 1), (3, 100), (7, 1 << 20)])
def test_blocks_and_tasks_change_nothing(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "CHUNK_BYTES", chunk)
    rows = conversations(2, 6, 60) + [(7, 3, "user", "Same.", 1, "x")] * 50
    assert reported(spark, rows) == expected(rows)


def test_a_hot_conversation_is_divided(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 64)
    rows = conversations(3, 40, 6) + [(99, i, ["user", "assistant"][i % 3 == 0], f"t{i}.", 1, "x") for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    blocks = repair._blocks(repair.damaged(df)).where("conv = 99").select("part", "at").collect()
    assert len({b.part for b in blocks}) >= 4 and len(blocks) >= 60
    assert reported(spark, rows) == expected(rows)


def test_crossings_take_the_least_of_all_edits():
    codes = range(12)
    for word in itertools.chain(itertools.product(codes, repeat=3), [(0, 3, 3, 6, 8, 5, 4, 9, 0, 7)]):
        role = lambda code: "sua-"[code // 3]
        rows = [(0, 0, role(c), "") for c in word]
        cost, edits, _ = cheapest(rows, [["", "t", "d"][c % 3] for c in word])
        _, found, paid = repair._solved(bytes(word), repair.EMPTY, -1)
        assert ("".join(found), paid) == (edits, cost)


def test_composed_tables_equal_rows():
    rng = random.Random(4)
    for _ in range(200):
        tables = [repair.ROWS[rng.randrange(12)] for _ in range(rng.randint(2, 9))]
        cut = rng.randrange(1, len(tables))
        whole = repair.compose([repair.compose(tables[:cut]), repair.compose(tables[cut:])])
        assert whole[0] == repair.compose(tables)[0]
        states = repair.crossings(tables, 0, repair.END_COSTS)
        joined = repair.crossings([repair.compose(tables[:cut]), repair.compose(tables[cut:])], 0, repair.END_COSTS)
        assert joined == [states[0], states[cut], states[-1]]


def test_empty_table(spark):
    assert reported(spark, []) == {}
