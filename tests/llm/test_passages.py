"""Repeated word runs that are no lines of their own, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiscus.llm.doc_numbers import numbered
from fiscus.llm.paragraph_dedup import remove_repeats
from fiscus.llm.passages import WINDOW, SpanHashes, Stretches, cut, joined_spans
from tests.llm import reference_results


def own(name, count):
    return [f"{name}x{n}" for n in range(count)]


def left(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: r for r in remove_repeats(frame).collect()}


def repeated_words(texts):
    """For each id the words that a window covers which occurs before, by comparing all windows."""
    seen, gone = set(), {}
    for i in sorted(texts):
        words = texts[i].lower().split()
        gone[i] = set()
        for n in range(len(words) - WINDOW + 1):
            window = tuple(words[n : n + WINDOW])
            if window in seen:
                gone[i].update(range(n, n + WINDOW))
            seen.add(window)
    return gone


def test_passage_inside_long_lines_and_across_line_breaks(spark):
    passage = own("p", 60)
    whole = " ".join(passage)
    rows = [
        (1, " ".join(own("a", 200)) + " " + whole + " " + " ".join(own("b", 200))),
        (2, " ".join(own("c", 150)) + " " + whole + " " + " ".join(own("d", 90))),
        (3, " ".join(own("e", 80) + passage[:25]) + "\n" + " ".join(passage[25:] + own("f", 70))),
    ]
    found = left(spark, rows)
    assert found[1].text == rows[0][1] and found[1].removed_spans == []
    assert found[2].text == " ".join(own("c", 150) + own("d", 90))
    assert found[3].text == " ".join(own("e", 80) + own("f", 70))
    assert [tuple(s) for s in found[3].removed_spans] == [(80, 140)] and found[3].keep_doc_ids == [1]


def test_near_passage_inside_long_lines_goes_whole(spark):
    passage = own("p", 60)
    changed = [*passage[:30], "other", *passage[31:]]
    found = left(spark, [(1, " ".join(own("a", 90) + passage + own("b", 90))), (2, " ".join(own("c", 90) + changed + own("d", 90)))])
    assert found[2].text == " ".join(own("c", 90) + own("d", 90))


def test_random_runs_equal_brute_force(spark):
    draw = random.Random(3)
    pool = [[f"r{k}y{draw.randrange(40)}" for _ in range(draw.randint(5, 70))] for k in range(12)]
    texts = {}
    for i in range(60):
        words = []
        for _ in range(draw.randint(0, 6)):
            words += own(f"o{i}z{len(words)}", draw.randint(0, 15))
            run = draw.choice(pool)
            start = draw.randrange(len(run))
            words += run[start : start + draw.randint(5, 70)]
        texts[i] = "".join(w + draw.choice(["\n", " ", "  "]) for w in words)
    texts[70] = "again " * 3000
    lines_too_short = {i: "\n".join(t.split()) for i, t in texts.items()}  # no line is a paragraph
    gone = repeated_words(lines_too_short)
    for i, row in left(spark, list(lines_too_short.items())).items():
        words = lines_too_short[i].split()
        spans = {n for s in row.removed_spans for n in range(s.start, s.end)}
        assert gone[i] <= spans
        assert row.text.split() == [w for n, w in enumerate(words) if n not in spans]
        # Beyond those, only words between two spans that make one similar passage.
        assert len(spans - gone[i]) <= WINDOW * len(row.removed_spans)
    assert sum(map(len, gone.values())) > 3000


def test_periodic_texts_equal_brute_force(spark):
    """Stretches in which an anchor occurs again and again, alone and in copies that begin elsewhere in the period."""
    draw = random.Random(8)
    periods = [own(f"z{k}", k) for k in (1, 2, 3, 7, 12, 13, 14, 19, 20, 21, 25)]
    texts = {}
    for i in range(40):
        period = draw.choice(periods)
        turned = draw.randrange(len(period))
        words = (period[turned:] + period[:turned]) * 60
        texts[i] = "\n".join(own(f"o{i}", draw.randint(0, 15)) + words[: draw.randint(18, 110)] + own(f"e{i}", draw.randint(0, 15)))
    gone = repeated_words(texts)
    for i, row in left(spark, list(texts.items())).items():
        spans = {n for s in row.removed_spans for n in range(s.start, s.end)}
        assert gone[i] <= spans and len(spans - gone[i]) <= WINDOW * len(row.removed_spans)
    assert sum(map(len, gone.values())) > 1000


def test_stretches_cover_every_window_once():
    draw = random.Random(4)
    texts = [[b"w%d" % draw.randrange(draw.choice([2, 30, 10**6])) for _ in range(draw.choice([0, 5, 19, 20, 21, 300]))] for _ in range(40)]
    found = Stretches(texts)
    starts, counts = found.chosen(np.arange(len(found.starts)), np.ones(len(found.starts), bool))
    text, word = found.places(starts)
    windows = [(t, n) for t, words in enumerate(texts) for n in range(len(words) - WINDOW + 1)]
    assert list(zip(text.tolist(), word.tolist())) == windows and set(counts.tolist()) == {1}
    same: dict[tuple, set] = {}
    for (t, n), *hashed in zip(windows, *found.hashes(starts, counts)):
        same.setdefault(tuple(hashed), set()).add(tuple(texts[t][n : n + WINDOW]))
    assert all(len(x) == 1 for x in same.values()) and len(same) == len({tuple(texts[t][n : n + WINDOW]) for t, n in windows})


def test_span_hashes_depend_on_the_words_only():
    words = np.arange(1, 250_000, dtype=np.uint64) % np.uint64(40)  # longer than the powers that are kept
    hashes = SpanHashes(words, np.uint64(0x9E3779B97F4A7C15))
    starts = np.array([3, 43, 200_003, 4])
    assert len(set(hashes.of(starts, starts + 25).tolist())) == 2
    assert (hashes.of_width(25)[starts] == hashes.of(starts, starts + 25)).all()
    assert hashes.of(starts[:1], starts[:1] + 26) != hashes.of(starts[:1], starts[:1] + 25)


def test_cut_keeps_line_breaks_around():
    assert cut("a b\nc d", [(1, 2)]) == "a\nc d" and cut("a b\nc d", [(2, 3)]) == "a b\nd"
    assert cut("a b c d", [(1, 3)]) == "a d" and cut(" a b ", [(0, 2)]) == "" and cut("a b\n", [(1, 2)]) == "a\n"
    assert cut("a b c d e", [(0, 1), (2, 3)]) == "b d e"


def test_spans_far_apart_or_from_other_documents_stay_apart():
    starts = np.array([0, 1, 30, 31])
    assert joined_spans(starts, (1 << 24) + np.array([5, 6, 35, 36]), 80) == [(0, 21), (30, 51)]
    starts = np.array([0, 20, 41, 61])
    assert joined_spans(starts, (1 << 24) + np.array([5, 25, 46, 66]), 80) == [(0, 81)]
    assert joined_spans(starts, (1 << 24) + np.array([5, 25, 46 + (1 << 24), 66 + (1 << 24)]), 80) == [(0, 40), (41, 81)]


def test_hard_wrapped_passage_goes(spark):
    """No line has the 20 words of a paragraph."""

    def wrapped(words):
        return "\n".join(" ".join(words[n : n + 11]) for n in range(0, len(words), 11))

    licence = own("l", 25)
    rows = [(1, wrapped(own("a", 40) + licence + own("b", 33))), (2, wrapped(own("c", 47) + licence + own("d", 30)))]
    found = left(spark, rows)
    assert found[1].text == rows[0][1]
    assert found[2].text.split() == own("c", 47) + own("d", 30)
    assert found[2].n_removed == 0 and [tuple(s) for s in found[2].removed_spans] == [(47, 72)]


def test_removed_words_equal_brute_force(spark):
    """Texts of many words with whole and changed passages inside long lines; what goes is exactly what comparing all windows gives."""
    draw = random.Random(11)
    passages = [own(f"p{k}", draw.randint(25, 120)) for k in range(14)]
    texts = {}
    for i in range(50):
        words = []
        for _ in range(draw.randint(1, 5)):
            passage = list(draw.choice(passages))
            start = draw.randrange(len(passage) // 2)
            passage = passage[start : start + draw.randint(15, 120)]
            for _ in range(draw.choice([0, 0, 1, 2])):
                passage[draw.randrange(len(passage))] = f"new{draw.randrange(10**9)}"
            words += [f"own{draw.randrange(10**9)}" for _ in range(draw.randint(0, 40))] + passage
        texts[i * 3] = " ".join(words)
    found = left(spark, list(texts.items()))
    # Texts are single lines; some are similar as a whole and have gone as such.
    gone = reference_results.removed_words({i: t for i, t in texts.items() if not found[i].n_removed})
    for i, row in found.items():
        if row.n_removed:
            assert row.text == ""
            continue
        assert {n for s in row.removed_spans for n in range(s.start, s.end)} == gone[i]
    assert sum(map(len, gone.values())) > 2000


def test_ids_of_any_size_and_clashing_columns(spark):
    passage = " ".join(own("p", 60))
    line = " ".join(own("l", 30))
    rows = [
        (-(2**63), f"{' '.join(own('a', 30))} {passage}"), (2**63 - 1, f"{line}\n{passage} {' '.join(own('b', 30))}"), (0, line),
        (5, "short"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = ("spans", "holders", "changed_doc", "cut_doc", "doc", "number", "position", "id", "Key", "place", "first")
    found = {r.doc_id: r for r in remove_repeats(frame.withColumns({c: F.lit(f"own {c}") for c in clashing})).collect()}
    assert found[2**63 - 1].text == " ".join(own("b", 30))
    assert (found[2**63 - 1].removed, found[2**63 - 1].keep_doc_ids) == ([0], [-(2**63), 0])
    assert all(found[i].text == t for i, t in rows if i != 2**63 - 1)
    assert all(r[c] == f"own {c}" for r in found.values() for c in clashing)


@pytest.mark.parametrize("ids", [[3, 4, 9], [-(2**63), 7, 2**63 - 1]])
def test_places_keep_the_order_of_ids(spark, ids):
    frame = spark.createDataFrame([(i, "x" * 1000) for i in ids], "doc long, text string")
    texts, places = numbered(frame)
    at = texts.select(places.place(F.col("number"), F.lit(999)).alias("place"), "number")
    back = places.with_ids(at.select("place", "number", places.position(F.col("place")).alias("at")), "number").orderBy("place").collect()
    assert [(r.number, r["at"]) for r in back] == [(i, 999) for i in ids]
