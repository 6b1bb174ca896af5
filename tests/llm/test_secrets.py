"""The secret scan against plain searches over code points and entropies counted anew for each window."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter

from pyspark.sql import functions as F

from fiscus.llm.secret_scan import CLASSES, SCALE, EntropyClass, Scanner, digest_secrets, scan_secrets


def plain_base(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, low) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(found)


def plain_entropy(text, own):
    """Merged windows of one class, each counted from nothing."""
    spans = []
    for run in re.finditer(f"[{own.characters}]+", text):
        for at in range(run.start(), run.end() - own.window + 1):
            window = text[at : at + own.window]
            total = sum(round(c * math.log2(c) * SCALE) for c in Counter(window).values())
            mixed = any(c in string.digits for c in window) and any(c in string.ascii_letters for c in window)
            if mixed and total <= math.floor(own.window * (math.log2(own.window) - own.bits) * SCALE):
                if spans and at <= spans[-1][1]:
                    spans[-1][1] = at + own.window
                else:
                    spans.append([at, at + own.window])
    return [tuple(s) for s in spans]


def random_texts(count, seed):
    draw = random.Random(seed)
    letters = string.ascii_letters + string.digits + "+/_=-"
    parts = [
        lambda: draw.choice(["token", "PassWord", "api_key", "APIKEY", "secret", "passwd"]) + draw.choice(['": "', " = ", ":", "='", "  =  "])
        + "".join(draw.choices(letters + ".", k=draw.randint(1, 14))),
        lambda: "AKIA" + "".join(draw.choices(string.ascii_uppercase + string.digits, k=draw.randint(0, 20))),
        lambda: "".join(draw.choices("0123456789abcdef", k=draw.randint(20, 50))),
        lambda: "".join(draw.choices(letters, k=draw.randint(10, 60))),
        lambda: "".join(draw.choices("0123456789abcdefABCDEF", k=draw.randint(20, 40))),
        lambda: draw.choice(["é", "日本語", "some words ", "\n", "x" * 40, "ab" * 15, "1" * 30, "ſecret=abcdefgh1", "🦊"]),
    ]
    return ["".join(draw.choice(parts)() + draw.choice([" ", "", "é", ","]) for _ in range(draw.randint(0, 12))) for _ in range(count)]


def test_base_forms_and_windows_equal_plain_searches():
    bare = Scanner((), (), ())
    for text in random_texts(400, 1):
        assert [(s, k, e) for s, e, k in bare.spans(text.encode())] == plain_base(text)
        for own in CLASSES:
            found = Scanner((own,), (), ())
            added = [(s, e) for s, e, k in found.spans(text.encode()) if k == 3]
            base = [(s, e) for s, _, e in plain_base(text)]
            wanted = [(s, e) for s, e in plain_entropy(text, own) if not any(a <= s and e <= b for a, b in base)]
            assert added == wanted, text


def test_class_by_class_entropy_of_small_windows():
    own = EntropyClass("entropy_small", "a-z0-9", window=4, bits=1.5)
    assert list(own.spans(b"aaaa a1b2 aa11 abcd 1234 ab1ab1")) == [(5, 9), (25, 31)]


def test_allow_list_suppresses_entropy_and_never_base():
    secret = "kJ8s0Qz3Lw9Xv2Bn5Rt7"
    scan = Scanner(CLASSES, *[(r"https?://[^\x00-\x20]+",), ("EXAMPLE",)])
    assert [k for *_, k in scan.spans(secret.encode())] == [4]
    assert scan.spans(f"see https://host/{secret} there".encode()) == []
    assert scan.spans(f"{secret}EXAMPLE".encode()) == []
    url = f"https://host/?token={secret}"
    assert [(k, url[s:e]) for s, e, k in scan.spans(url.encode())] == [(0, f"token={secret}")]


def test_odd_rows_and_digests(spark):
    secret = "kJ8s0Qz3Lw9Xv2Bn5Rt7"
    long = "é word " * 100_000 + f"token: {secret} " + "Z" * 300_000
    rows = [(1, None), (1, ""), (2, "é token=abcdefgh"), (2, "é token=abcdefgh"), (None, f"x {secret}"), (3, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumn("secrets", F.lit(1)).withColumn("id", F.lit(2)).withColumn("data", F.lit(3))
    found = digest_secrets(scan_secrets(docs)).collect()
    empty, base = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"assign:2:16").hexdigest()
    at = len("é word " * 100_000)
    assert sorted(map(tuple, found), key=repr) == sorted([
        (1, 0, 0, 0, empty, ""), (1, 0, 0, 0, empty, ""), (2, 1, 0, 0, base, "assign:2:16"), (2, 1, 0, 0, base, "assign:2:16"),
        (None, 0, 0, 0, empty, "entropy_base64:2:22"),
        (3, 1, 0, 0, hashlib.sha256(f"assign:{at}:{at + 27}".encode()).hexdigest(), f"assign:{at}:{at + 27}"),
    ], key=repr)
    assert digest_secrets(scan_secrets(docs.limit(0))).count() == 0
