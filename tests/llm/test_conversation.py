"""Repaired conversations against a plain search over all edits."""
import hashlib
import heapq
import random
import re
import zlib

import pytest

from topicloom.llm import conversation
from topicloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]")
SF = "/root/testdata/sf0.01"


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(key.encode()) % 20
        if draw == 0:
            continue
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if draw == 3 else 1)
    return out


def order(row):
    return row[1] is not None, row[1] or 0, row[2], hashlib.sha256(row[3].encode()).digest()


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        kept = text.strip(" \t\n\x0b\x0c\r")
        if not kept:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("none" if kept[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Best-first search over (cost, letters): each entry is a place, a state and the lines so far."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, lines
        state = (i, roles[-1:])
        if state in done:
            continue
        done.add(state)
        opened = {"": "u", "s": "u", "u": "a", "a": "u"}[roles[-1:]]
        name = {"u": "user", "a": "assistant"}[opened]
        heapq.heappush(heap, (cost + 5, letters + "I", i, roles + opened, (*lines, f"{name}:")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, roles, lines))
            if found[i] in ("none", "truncated"):
                extra = 5 if found[i] == "truncated" else 0
                heapq.heappush(heap, (cost + 1 + extra, letters + "R", i + 1, roles + opened, (*lines, f"{name}:{text}")))
                if role[:1] == opened or (role[:1] == "s" and not roles):
                    heapq.heappush(heap, (cost + extra, letters + "K", i + 1, roles + role[:1], (*lines, f"{role}:{text}")))


def plain(original):
    groups = {r[0]: [] for r in original}
    for r in hurt(original):
        groups[r[0]].append(r)
    out = []
    for conv, rows in groups.items():
        rows.sort(key=order)
        found = faults(rows)
        cost, letters, lines = cheapest(rows, found)
        turns = {r[1] for r in rows if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
        out.append((conv, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "why", "well.\n", " ", "", None, "a longer answer?", "unended,"]
    rows = []
    for conv in [*range(n), None]:
        for k in range(rng.randint(1, most)):
            turn = rng.choice([k, k, k, k + 2, None, 7])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"{k} text {conv}."))
    return rows


def table(spark, rows):
    extra = [(*r, 5, "clash", True) for r in rows]
    return spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, pos long, mark string, blank boolean").repartition(4)


def asked(spark, rows, block):
    df = table(spark, rows)
    return sorted((tuple(r) for r in conversation.report(conversation.damage(df), df, block).collect()), key=str)


@pytest.mark.parametrize("block", [512, 3, 1])
def test_awkward_conversations(spark, block):
    rows = made(block, 60, 14)
    assert asked(spark, rows, block) == plain(rows)


def test_long_conversation_in_blocks(spark):
    rows = made(5, 1, 3) + [(9, k, ["user", "assistant", "system"][k % 7 % 3], f"{k % 90} text{'.' if k % 5 else ''}") for k in range(400)]
    assert asked(spark, rows, 8) == plain(rows)


def test_repaired_rows_fit(spark):
    rows = made(3, 40, 12)
    out = conversation.repair(conversation.damage(table(spark, rows)), 4).orderBy("rank", "block", "place").collect()
    roles = {}
    for r in out:
        roles[r.conv_id] = roles.get(r.conv_id, "") + r.role[0]
        assert r.edit in "IKR" and (r.edit == "I") == (r.text == "")
    assert len(roles) > 30 and all(re.fullmatch("s?(ua)+", v) for v in roles.values())


def test_empty_table(spark):
    df = table(spark, made(1, 1, 2)).where("false")
    assert conversation.report(conversation.damage(df), df).count() == 0


def test_query_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_conversation_repair"](spark, SF).collect()), key=str)
    assert got == plain(rows)
