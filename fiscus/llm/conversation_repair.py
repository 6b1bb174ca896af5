"""Conversations made to follow ``(s?(ua)+)?`` with the cheapest edits, and what was wrong with them.

1. *Symbols.* Equal rows of a conversation are one row with a number, counted on the map side; the first of equal
   role and text is told apart by a grouping. Rows become symbols (``repair_grammar``) in an order that is dealt out
   by ranges, so a conversation with any share of all rows lies in many tasks, as blocks of bounded size.
2. *Grammar.* Frequent pairs of symbols over all blocks become rules, in rounds; only pair counts reach the driver.
3. *Repair.* A block that holds a whole conversation is solved at once. A conversation in several blocks has one
   transfer matrix for each; the best way through them needs the costs and the order of their audits only.
4. *Reading.* Edits and rows meet in one sorted stream. A conversation passes through one task row by row, as the digest
   of its text demands; memory holds its edits, which are the ``audit`` cell of its result row, not its rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.llm.pretokens import Memo
from fiscus.llm.repair_grammar import (
    COSTS, GONE, INSERT, KEEP, DELETE, REPLY, START, STATES, SYSTEM, TAILS, TRUNCATED, USER, Grammar, best_path,
)
from fiscus.shared import stored

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
BLOCK = 4096  # symbols of a block at most, and copies of a row that are dealt out together
ROUNDS, RULES_A_ROUND = 5, 24
KEY = ["conv", "turn", "role", "digest"]
KEY_SCHEMA = "conv long, turn long, role string, digest binary"
LEGAL = {"su", "ua", "au"}
ROLES = {START: "user", SYSTEM: "user", USER: "assistant", REPLY: "user"}  # what an inserted or changed row becomes
RESULT = (
    "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with the damage that the checksum of ``conv_id:turn`` deals them, and ``times``, 0 for a dropped row."""

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    damage = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(damage == 1, "").when(damage == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    return turns.select(
        "conv_id",
        "turn",
        F.when(damage == 4, "user").otherwise(plain("role")).alias("role"),
        text.alias("text"),
        F.when(damage == 0, 0).when(damage == 3, 2).otherwise(1).alias("times"),
    )


def _symbol(role: Column, text: Column) -> Column:
    left = F.rtrim(text, F.lit(WHITE))
    initial = F.substring(role, 1, 1)
    sound = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(left == "", GONE).when(F.right(left, F.lit(1)).isin(".", "!", "?"), sound).otherwise(F.upper(sound))


def marked(said: DataFrame, block: int) -> DataFrame:
    """``KEY``, ``part`` and ``symbols`` of all rows: equal ones as runs of at most ``block`` symbols."""
    rows = said.filter("times > 0").groupBy(*KEY, "symbol").agg(F.sum("times").alias("n"))
    firsts = stored(
        rows.groupBy("conv", "role", "digest")
        .agg(F.max(F.col("turn").isNull()).alias("no_turn"), F.min("turn").alias("least"), F.count("*").alias("turns"))
        .filter("turns > 1")
        .select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "no_turn", "least"),
        "first-said",
    )
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    is_first = F.when(F.col("c").isNull() & F.col("no_turn").isNull(), True).when(
        F.col("no_turn"), F.col("turn").isNull()
    ).otherwise(F.col("turn") == F.col("least"))
    return (
        rows.join(firsts, same, "left")
        .withColumn("lead", F.when(is_first, F.col("symbol")).otherwise(GONE))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {block}"))))
        .withColumn("size", F.least(F.lit(block), F.col("n") - F.col("part") * block).cast("int"))
        .select(
            *KEY, "part",
            F.concat(F.when(F.col("part") == 0, F.col("lead")).otherwise(GONE), F.expr(f"repeat('{GONE}', size - 1)"))
            .alias("symbols"),
        )
    )


def blocks(runs: DataFrame, block: int) -> DataFrame:
    """Blocks of symbols in order: ``KEY`` of their first row, ``at``, ``symbols`` and ``edge``.

    ``at`` orders blocks. ``edge`` is false only if the block surely holds its whole conversation.
    """
    order = [F.col(name).asc_nulls_first() for name in (*KEY, "part")]
    dealt = runs.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_at = TaskContext.get().partitionId() << 33
        ready: list[dict] = []
        now: dict | None = None
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                row.pop("part")
                if now and now["conv"] == row["conv"] and len(now["symbols"]) + len(row["symbols"]) <= block:
                    now["symbols"] += row["symbols"]
                    continue
                more = now is not None and now["conv"] == row["conv"]
                if now:
                    now["edge"] |= more
                    ready.append(now)
                now = row | {"at": first_at + n, "edge": more or not n}
                n += 1
            if len(ready) >= 1000:
                yield table(ready)
                ready = []
        if now:
            yield table([*ready, now | {"edge": True}])

    schema = pa.schema([
        ("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()),
        ("symbols", pa.string()), ("at", pa.int64()), ("edge", pa.bool_()),
    ])

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    return dealt.mapInArrow(cut, f"{KEY_SCHEMA}, symbols string, at long, edge boolean")


def learn_grammar(sequences: DataFrame, rounds: int = ROUNDS, rules: int = RULES_A_ROUND) -> Grammar:
    """Rules for the pairs that occur most often in ``symbols``, in rounds; each takes pairs as the rules before leave them."""
    weighed = stored(sequences.groupBy("symbols").count(), "symbol-sequences")
    grammar = Grammar()
    for _ in range(rounds):
        packed = grammar.packed

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in batches:
                for symbols, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    short = packed(symbols)
                    for pair, times in Counter(map("".join, zip(short, short[1:]))).items():
                        found[pair] += n * times
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["pair", "n"]
            )

        pairs = weighed.mapInArrow(counted, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        best = pairs.filter("n > 1").orderBy(F.desc("n"), "pair").limit(rules).collect()
        if not best:
            break
        grammar.rules += [row.pair for row in best]
    return grammar.evaluate()


def solved(whole: DataFrame, grammar: Grammar) -> DataFrame:
    """Edits of blocks that hold whole conversations."""

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(grammar.repair, 100_000)
        for batch in batches:
            ways = [known[symbols] for symbols in batch.column("symbols").to_pylist()]
            yield batch.select([*KEY, "at", "symbols"]).append_column(
                "cost", pa.array([cost for cost, _ in ways], pa.int64())
            ).append_column("edits", pa.array([audit for _, audit in ways], pa.string()))

    return whole.mapInArrow(repaired, f"{KEY_SCHEMA}, at long, symbols string, cost long, edits string")


def joined_up(parts: DataFrame, grammar: Grammar) -> DataFrame:
    """Edits of blocks that may hold parts of conversations only."""

    def transferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, ranks, audits = [], [], []
            for symbols in batch.column("symbols").to_pylist():
                ways = [way for row in grammar.transfer(symbols) for way in row]
                order = {audit: n for n, audit in enumerate(sorted({way[1] for way in ways if way}))}
                costs.append([way and way[0] for way in ways])
                ranks.append([way and order[way[1]] for way in ways])
                audits.append([way and way[1] for way in ways])
            out = batch.select([*KEY, "at", "symbols"])
            for name, values, kind in (("costs", costs, pa.int64()), ("ranks", ranks, pa.int64()), ("audits", audits, pa.string())):
                out = out.append_column(name, pa.array(values, pa.list_(kind)))
            yield out

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ways, tails = [], [], []
            for steps in batch.column(0).to_pylist():
                end, path = best_path([(s["costs"], s["ranks"]) for s in steps])
                at += [s["at"] for s in steps]
                ways += [start * len(STATES) + to for start, to in path]
                tails += [""] * (len(path) - 1) + [TAILS[end]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array(ways, pa.int32()), pa.array(tails, pa.string())], names=["at", "way", "tail"]
            )

    matrices = stored(
        parts.mapInArrow(
            transferred, f"{KEY_SCHEMA}, at long, symbols string, costs array<long>, ranks array<long>, audits array<string>"
        ),
        "transfer-matrices",
    )
    steps = matrices.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "costs", "ranks"))).alias("steps"))
    choice = stored(steps.select("steps").mapInArrow(chosen, "at long, way int, tail string"), "chosen-ways")
    return matrices.join(choice, "at").select(
        *KEY, "at", "symbols",
        (F.element_at("costs", F.col("way") + 1) + COSTS[INSERT] * F.length("tail")).alias("cost"),
        F.concat(F.element_at("audits", F.col("way") + 1), "tail").alias("edits"),
    )


class _Reading:
    """One conversation as its edits and rows come in, in order."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.edits: deque[str] = deque()
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.state, self.lines = START, 0
        self.low = self.high = self.last = None
        self.turns = self.blank = self.gone = self.truncated = self.illegal = self.cost = 0
        self.place = 0

    def add_edits(self, edits: str, symbols: str, cost: int) -> None:
        self.edits.append(edits)
        self.audit.append(edits)
        self.cost += cost
        self.gone += symbols.count(GONE)
        self.truncated += sum(symbols.count(s) for s in TRUNCATED)

    def _next_edit(self) -> str:
        while self.place == len(self.edits[0]):
            self.edits.popleft()
            self.place = 0
        self.place += 1
        return self.edits[0][self.place - 1]

    def _write(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1
        self.state = SYSTEM if role[:1] == "s" else USER if role[:1] == "u" else REPLY

    def add_row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        self.blank += not text.strip(WHITE)
        self.illegal += self.last is not None and self.last + role[:1] not in LEGAL
        self.last = role[:1]
        while (edit := self._next_edit()) == INSERT:
            self._write(ROLES[self.state], "")
        if edit != DELETE:
            self._write(role if edit == KEEP else ROLES[self.state], text)

    def result(self) -> tuple:
        left = "".join(self.edits)[self.place :]
        for _ in left:  # inserts after the last row
            self._write(ROLES[self.state], "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (
            self.conv, gaps, self.blank, self.gone - self.blank, self.truncated, self.illegal, self.cost,
            "".join(self.audit), self.digest.hexdigest(),
        )


def read_repairs(said: DataFrame, edits: DataFrame) -> DataFrame:
    """One result row per conversation from its rows and the edits of its blocks."""
    nothing = F.lit(None)
    stream = said.select(
        *KEY, F.lit(1).alias("kind"), nothing.cast("long").alias("at"), "text", "times", nothing.cast("string").alias("symbols")
    ).union(
        edits.select(*KEY, F.lit(0), "at", "edits", "cost", "symbols")
    )
    order = [F.col(name).asc_nulls_first() for name in (*KEY, "kind", "at")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reading | None = None
        done: list[tuple] = []
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("conv", "turn", "role", "kind", "text", "times", "symbols"))
            for conv, turn, role, kind, text, times, symbols in zip(*columns):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.result())
                    now = _Reading(conv)
                if kind == 0:
                    now.add_edits(text, symbols, times)
                else:
                    for _ in range(times):
                        now.add_row(turn, role, text)
            if done:
                yield table(done)
                done = []
        if now:
            yield table([now.result()])

    types = [*[pa.int64()] * 7, pa.string(), pa.string()]
    names = [field.split()[0] for field in RESULT.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return stream.repartition("conv").sortWithinPartitions(*order).mapInArrow(read, RESULT)


def repair_conversations(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    times_col: str | None = None, block: int = BLOCK,
) -> DataFrame:
    """One row per conversation: counts of faults, cost and audit of the cheapest repair, digest of the repaired text.

    ``times_col`` says how often a row occurs; a conversation whose rows all occur 0 times has zeros and empty texts. Null
    roles and texts count as one space. Null ids are one conversation, null turns come first. Rows with equal
    turns are ordered by role, then by the SHA-256 of the text; repeated rows are duplicates. An empty table gives an empty result. Further
    columns are ignored. Texts pass row by row and may be of any length. ``audit`` is one cell, so it ends at 2^31 edits of
    one conversation, which then stops the query.
    """
    text = F.coalesce(F.col(text_col), F.lit(" "))
    role = F.coalesce(F.col(role_col), F.lit(" "))
    said = turns.select(
        F.col(id_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        _symbol(role, text).alias("symbol"),
        text.alias("text"),
        (F.col(times_col) if times_col else F.lit(1)).cast("long").alias("times"),
    )
    found = stored(blocks(marked(said.drop("text"), block), block), "symbol-blocks")
    grammar = learn_grammar(found)
    edits = solved(found.filter("not edge"), grammar).unionByName(joined_up(found.filter("edge"), grammar))
    return read_repairs(said, edits).withColumnRenamed("conv", id_col)
