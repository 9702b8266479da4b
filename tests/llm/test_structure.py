"""Conversation repair: costs, audits and repaired turns against a plain recursion over whole conversations."""

import hashlib
import random
import zlib
from functools import lru_cache

from epochalis.llm import structure
from epochalis.llm.common import read_table

SPACES = " \t\n\x0b\x0c\r"
WORDS = {2: "user", 3: "assistant"}


def hurt(rows):
    """Rows (conv, turn, role, text) of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else text.translate({ord(c): None for c in ".!?"}) if h == 2 else text
        out += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def plainly(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of rows (turn, role, text) in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        said = text.strip(SPACES)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    @lru_cache(None)
    def best(i, last, inserts):
        """Least (cost, audit, turns) from row i on, after the role ``last``; no two inserts pay more than once round."""
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        say = "assistant" if last == "u" else "user"
        if inserts < 3:
            c, a, t = best(i, say[0], inserts + 1)
            found.append((c + 3, "I" + a, (f"{say}:", *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, last, 0)
            found.append((c + 4, "D" + a, t))
            if faults[i] in ("", "truncated"):
                more, first = 3 * (faults[i] == "truncated"), role[:1]
                if first == "s" and last == "" or first == "u" and last != "u" or first == "a" and last == "u":
                    c, a, t = best(i + 1, first, 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *t)))
                c, a, t = best(i + 1, say[0], 0)
                found.append((c + 3 + more, "R" + a, (f"{say}:{text}", *t)))
        return min(found, default=(10**9, "", ()))

    cost, audit, said = best(0, "", 0)
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def reported(frame):
    return {r["conv_id"]: tuple(r)[1:] for r in frame.collect()}


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 14)):
            rows.append((conv, rng.choice((turn, turn, turn, turn + 5, 0, None)), rng.choice(("user", "user", "assistant", "assistant", "system", "tool", "", None, "Unknown")), rng.choice(("Hi.", "Yes!", "cut off", " \n", "", None, "a.b?", f"{rng.random()}."))))
    return rows


def test_made_conversations_in_chunks_of_any_size(spark):
    rows = made(150, 5)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = {c: plainly(hurt([r for r in rows if r[0] == c])) for c in {r[0] for r in rows}}
    assert len({w[5] for w in want.values()}) > 10
    for chunk in (1, 3, 4096):
        assert reported(structure.repair_report(structure.damage(frame), frame, chunk_rows=chunk)) == want


def test_whole_table(spark, data):
    frame = read_table(spark, data, "conversations").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in frame.collect()]
    assert reported(structure.op12_conversation_repair(spark, data)) == {c: plainly(hurt([r for r in rows if r[0] == c])) for c in {r[0] for r in rows}}


def test_one_conversation_over_many_tasks(spark):
    """One id holds most rows, some of them equal: its chunks lie in several partitions, and its turns are one order."""
    rng = random.Random(8)
    rows = [(1, k, rng.choice(("user", "assistant", "assistant", "tool")), rng.choice(("Same.", f"text {k}.", "cut"))) for k in range(1500)] + [(1, 700, "user", "Equal.")] * 40 + [(2, 0, "user", "Hi.")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    order = sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3]))
    out = structure.repaired(frame.selectExpr("*", "1L AS copies"), chunk_rows=16).collect()
    own = [r for r in out if r["conv_id"] == 1]
    assert len({r["section"] for r in own}) > 1 and len({(r["section"], r["chunk"]) for r in own}) > 50
    own.sort(key=lambda r: (r["section"], r["chunk"], r["place"]))
    got = reported(structure.repair_report(frame.selectExpr("*", "1L AS copies"), frame, chunk_rows=16))
    cost, audit, said = run_down([r[1:] for r in order if r[0] == 1])
    assert (got[1][5], got[1][6], got[1][7]) == (cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    assert [f"{r['role']}:{r['text']}" for r in own] == said


def run_down(rows):
    """As ``plainly``, from the last row to the first, for conversations too long for a recursion."""
    seen, gone, cut = set(), [], []
    for _, role, text in rows:
        said = text.strip(SPACES)
        gone.append(not said or (role, text) in seen)
        cut.append(bool(said) and said[-1] not in ".!?")
        seen.add((role, text))
    after = {"": "u", "s": "u", "a": "u", "u": "a"}

    def inserts(table):
        for _ in range(3):
            table = {p: min(table[p], (table[q][0] + 3, "I" + table[q][1])) for p, q in after.items()}
        return table

    far = (10**9, "")
    table = inserts({"": (0, ""), "s": far, "u": far, "a": (0, "")})
    for k in range(len(rows) - 1, -1, -1):
        first, new = rows[k][1][:1], {}
        for p, q in after.items():
            options = [(table[p][0] + 4, "D" + table[p][1])]
            if not gone[k]:
                if first == "s" and p == "" or first == q:
                    options.append((table[first][0] + 3 * cut[k], "K" + table[first][1]))
                options.append((table[q][0] + 3 + 3 * cut[k], "R" + table[q][1]))
            new[p] = min(options)
        table = inserts(new)
    cost, audit = table[""]
    said, k, last = [], 0, ""
    names = {"u": "user", "a": "assistant"}
    for letter in audit:
        if letter == "I":
            last = after[last]
            said.append(names[last] + ":")
            continue
        _, role, text = rows[k]
        k += 1
        if letter != "D":
            last = role[:1] if letter == "K" else after[last]
            said.append(f"{role if letter == 'K' else names[last]}:{text}")
    return cost, audit, said


def test_odd_conversations(spark):
    """No rows after damage, no id, extreme turns, an empty table."""
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (7, -(1 << 63), "user", "Hi."), (7, (1 << 63) - 1, "assistant", "Yes."), (8, 3, "system", "Only.")]
    gone = next(c for c in range(10, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Dropped."))
    frame = spark.createDataFrame(rows, SCHEMA)
    got = reported(structure.repair_report(structure.damage(frame), frame))
    assert set(got) == {None, 7, 8, gone}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for conv in (None, 8):
        assert got[conv] == plainly(hurt([r for r in rows if r[0] == conv]))
    assert got[7][0] == (1 << 63) - 1
    none = frame.limit(0)
    assert structure.repair_report(structure.damage(none), none).count() == 0
