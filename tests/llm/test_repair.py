"""Conversation repair against a search over all edits, whole conversations and blocks of any size."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fiscus.llm.conversation_repair import damaged, repair_conversations
from fiscus.llm.repair_grammar import FIRST_RULE, GONE, TAILS, Grammar, best_path


def search(symbols):
    """Cost and ASCII-least audit among the cheapest edits, by trying all in order of cost."""
    heap, bound, audits = [(0, "", 0, "")], None, []
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        if bound is not None and cost > bound:
            break
        if at == len(symbols) and re.fullmatch("(s?(ua)+)?", out):
            bound = cost
            audits.append(audit)
        if not re.fullmatch("s?(ua)*u?", out):
            continue
        for role in "ua":
            heapq.heappush(heap, (cost + 5, audit + "I", at, out + role))
        if at < len(symbols):
            own = symbols[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, out))
            if own != GONE:
                more = 5 * own.isupper()
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, out + own.lower()))
                for role in "ua":
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, out + role))
    return bound, min(audits)


def test_grammar_and_blocks_equal_the_search():
    draw = random.Random(1)
    grammar = Grammar(["ua", "uu", chr(FIRST_RULE) * 2]).evaluate()
    for _ in range(600):
        symbols = "".join(draw.choice("suaxSUAX-uaua") for _ in range(draw.randint(0, 5)))
        assert grammar.repair(symbols) == search(symbols)
        whole = symbols * 3
        cuts = sorted(draw.randrange(len(whole) + 1) for _ in range(3))
        parts = [p for p in (whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)])) if p]
        matrices = [Grammar().transfer(p) for p in parts]
        steps = []
        for matrix in matrices:
            ways = [way for row in matrix for way in row]
            audits = sorted({way[1] for way in ways if way})
            steps.append(([w and w[0] for w in ways], [w and audits.index(w[1]) for w in ways]))
        end, path = best_path(steps)
        assert "".join(m[a][b][1] for m, (a, b) in zip(matrices, path)) + TAILS[end] == grammar.repair(whole)[1]


def expected(rows):
    """The result of one conversation, from its rows after damage as (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, symbols, faults = set(), "", []
    for _, role, text in rows:
        left = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""
        seen.add((role, text))
        own = role[:1] if role[:1] in ("s", "u", "a") else "x"
        symbols += "-" if fault in ("blank", "duplicate") else own.upper() if fault else own
        faults.append(fault)
    cost, audit = search(symbols) if len(rows) <= 7 else Grammar().repair(symbols)
    lines, at = [], 0
    for edit in audit:
        if edit != "I":
            _, role, text = rows[at]
            at += 1
        if edit == "D":
            continue
        led = bool(lines) and lines[0].startswith("s")
        due = "assistant" if (len(lines) - led) % 2 else "user"
        lines.append({"K": f"{role}:{text}" if edit == "K" else "", "R": f"{due}:{text}" if edit == "R" else "", "I": f"{due}:"}[edit])
    turns = [t for t, *_ in rows if t is not None]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def damage(rows):
    """Plain damage of (conv, turn, role, text) rows, grouped by conversation."""
    left = {}
    for conv, turn, role, text in rows:
        kept = left.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return left


def conversations(count, seed, longest):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and then", "", None, " \n", "é.", "Yes. \t"] + [f"text {n}." for n in range(30)]
    rows = []
    for conv in range(count):
        turns = draw.sample(range(12), draw.randint(1, longest)) + ([None] if draw.random() < 0.2 else [])
        for turn in turns:
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            rows += [(conv if conv else None, turn, role, draw.choice(texts))] * draw.choice([1, 1, 1, 2])
    return rows


COLUMNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [4096, 3, 1])
def test_results_equal_the_search(spark, block):
    rows = conversations(150, 3, 5)
    frame = spark.createDataFrame(rows, COLUMNS).withColumn("symbols", F.lit("clash")).repartition(3)
    found = {r.conv_id: tuple(r)[1:] for r in repair_conversations(damaged(frame), times_col="times", block=block).collect()}
    wanted = damage(rows)
    assert set(found) == set(wanted)
    for conv, left in wanted.items():
        assert found[conv] == expected(left), conv


def test_a_conversation_of_many_rows_and_copies(spark):
    draw = random.Random(5)
    rows = [(7, n, draw.choice(["user", "assistant", "system"]), draw.choice(["a.", "b", f"{n}."])) for n in range(3000)]
    rows += [(7, 1500, "user", "again.")] * 2000 + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Yes. " * 100_000)]
    found = {r.conv_id: r for r in repair_conversations(spark.createDataFrame(rows, COLUMNS), block=64).collect()}
    for conv in (7, 8):
        assert tuple(found[conv])[1:] == expected([r[1:] for r in rows if r[0] == conv])
    assert found[8].audit == "KK"


def test_nothing_left_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi.", 0), (1, 1, None, None, 0)], COLUMNS + ", times long")
    empty = hashlib.sha256(b"").hexdigest()
    assert list(map(tuple, repair_conversations(frame, times_col="times").collect())) == [(1, 0, 0, 0, 0, 0, 0, "", empty)]
    assert repair_conversations(frame.limit(0), times_col="times").count() == 0
