"""Cheapest repairs of row sequences: a Re-Pair grammar with one transfer matrix per rule.

A row is one symbol: what its role starts with, and whether it must go or is truncated. An output of roles
is read by an automaton of four states. A *transfer matrix* holds, for each pair of states, the cheapest way to
get from one to the other over some rows, and among the cheapest the ASCII-least *audit* of edits. Matrices
multiply in the min-plus sense: costs add, audits are strung together.

Audits of the same rows that end in the edit of a row hold as many row edits each, so none is a proper prefix of another.
That keeps their order when more is put behind them, and the product associative: a sequence may be
cut anywhere.

*Grammar.* Frequent pairs of symbols become symbols of their own, in rounds over the whole corpus. The matrix of a
rule is the product of its two halves, worked out once, bottom-up, and shared by all conversations.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

START, SYSTEM, USER, REPLY = range(4)
STATES = range(4)
# Where the automaton of (s?(ua)+)? goes; what is left out is not allowed.
NEXT = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): REPLY, (REPLY, "u"): USER,
}
TAILS = {START: "", REPLY: "", SYSTEM: "II", USER: "I"}  # inserts after the last row
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5

# Symbols: role initials of sound rows, the same in upper case if truncated, and rows that must go.
SOUND, TRUNCATED, GONE = "suax", "SUAX", "-"
FIRST_RULE = 0x4E00  # rules are named by code points from here on

# One way from state to state: its cost and its audit; None if there is none.
Way = tuple[int, str]
Matrix = tuple[tuple[Way | None, ...], ...]


def _insert_ways() -> dict[int, dict[int, int]]:
    """How many inserts lead from each state to each other one."""
    ways = {}
    for start in STATES:
        reached, frontier, n = {start: 0}, [start], 0
        while frontier:
            n += 1
            frontier = [NEXT[s, r] for s in frontier for r in "ua" if (s, r) in NEXT and NEXT[s, r] not in reached]
            reached.update(dict.fromkeys(frontier, n))
        ways[start] = reached
    return ways


_INSERTS = _insert_ways()


def _edits(symbol: str, state: int) -> Iterable[tuple[str, int, int]]:
    """Edit, cost and next state for a row met in a state."""
    yield DELETE, COSTS[DELETE], state
    if symbol == GONE:
        return
    more = TRUNCATED_COST if symbol in TRUNCATED else 0
    if (state, symbol.lower()) in NEXT:
        yield KEEP, COSTS[KEEP] + more, NEXT[state, symbol.lower()]
    for role in "ua":
        if (state, role) in NEXT:
            yield REROLE, COSTS[REROLE] + more, NEXT[state, role]


@lru_cache(maxsize=None)  # nine symbols
def terminal(symbol: str) -> Matrix:
    """Inserts before a row, then the row's own edit."""
    best: list[list[Way | None]] = [[None] * len(STATES) for _ in STATES]
    for start in STATES:
        for state, inserts in _INSERTS[start].items():
            for edit, cost, end in _edits(symbol, state):
                way = (cost + inserts * COSTS[INSERT], INSERT * inserts + edit)
                if best[start][end] is None or way < best[start][end]:
                    best[start][end] = way
    return tuple(map(tuple, best))


def product(a: Matrix, b: Matrix) -> Matrix:
    """The cheapest ways through both; the ASCII-least of equally cheap ones."""
    rows = []
    for left in a:
        row: list[Way | None] = []
        for end in STATES:
            cheapest = min((x[0] + b[k][end][0] for k, x in enumerate(left) if x and b[k][end]), default=None)
            row.append(
                None if cheapest is None
                else (cheapest, min(
                    x[1] + b[k][end][1] for k, x in enumerate(left) if x and b[k][end] and x[0] + b[k][end][0] == cheapest
                ))
            )
        rows.append(tuple(row))
    return tuple(rows)


@dataclass
class Grammar:
    """Rules in the order in which they were found; each stands for a pair of earlier symbols."""

    rules: list[str] = field(default_factory=list)
    _matrices: dict[str, Matrix] = field(default_factory=dict, repr=False)

    def name(self, number: int) -> str:
        return chr(FIRST_RULE + number)

    def packed(self, symbols: str) -> str:
        """The sequence with all rules applied."""
        for number, pair in enumerate(self.rules):
            symbols = symbols.replace(pair, self.name(number))
        return symbols

    def matrix(self, symbol: str) -> Matrix:
        """The transfer matrix of a symbol; those of rules are built bottom-up, once."""
        if symbol < self.name(0):
            return terminal(symbol)
        if symbol not in self._matrices:
            left, right = self.rules[ord(symbol) - FIRST_RULE]
            self._matrices[symbol] = product(self.matrix(left), self.matrix(right))
        return self._matrices[symbol]

    def evaluate(self) -> Grammar:
        """Build the matrices of all rules, from the first to the last."""
        for number in range(len(self.rules)):
            self.matrix(self.name(number))
        return self

    def transfer(self, symbols: str) -> Matrix | None:
        """The matrix of a whole sequence: halves are multiplied, so audits are copied few times. None without rows."""
        parts = [self.matrix(s) for s in self.packed(symbols)]
        while len(parts) > 1:
            pairs = [product(parts[n], parts[n + 1]) for n in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[2 * len(pairs) :]
        return parts[0] if parts else None

    def repair(self, symbols: str) -> Way:
        """Cost and audit of the cheapest repair of a whole conversation."""
        matrix = self.transfer(symbols)
        if matrix is None:
            return 0, ""
        ways = (
            (way[0] + COSTS[INSERT] * len(TAILS[end]), way[1] + TAILS[end])
            for end, way in enumerate(matrix[START]) if way
        )
        return min(ways)


def best_path(blocks: list[tuple[list[int | None], list[int | None]]]) -> tuple[int, list[tuple[int, int]]]:
    """The end state and the pair of states of each block on the best way through blocks of one conversation.

    A block is given by the costs of its sixteen ways and by the ranks of their audits in ASCII order, so
    a block of any length counts for two short lists. Costs to go are worked out backwards. Going forwards, the
    least audit is followed from all states in which the audits so far are equal.
    """
    width = len(STATES)
    to_go: list[list[int | None]] = [[COSTS[INSERT] * len(TAILS[s]) for s in STATES]]
    for costs, _ in reversed(blocks):
        after = to_go[-1]
        to_go.append([
            min((costs[s * width + e] + after[e] for e in STATES if costs[s * width + e] is not None and after[e] is not None),
                default=None)
            for s in STATES
        ])
    to_go.reverse()
    here, steps = {START}, []
    for n, (costs, ranks) in enumerate(blocks):
        ways = [
            (ranks[s * width + e], s, e)
            for s in here for e in STATES
            if costs[s * width + e] is not None and to_go[n + 1][e] is not None
            and costs[s * width + e] + to_go[n + 1][e] == to_go[n][s]
        ]
        least = min(ways)[0]
        steps.append({e: s for rank, s, e in ways if rank == least})
        here = set(steps[-1])
    end = min(here, key=lambda s: TAILS[s])
    path, state = [], end
    for step in reversed(steps):
        path.append((step[state], state))
        state = step[state]
    return end, path[::-1]
