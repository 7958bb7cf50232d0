"""Repair of conversation structure: the cheapest edits, of equally cheap ones those of the ASCII-least audit.

A conversation's rows are the layers of a graph whose nodes are (rows done, state); the states are those of the pattern
`(s?(ua)+)?` over role initials. Keep, Rerole and Delete take a row, Insert takes none. An audit letter determines the state
it leads to, so a node has at most one arc for each letter.

Rows are ordered by one range sort and numbered; blocks of BLOCK consecutive rows are the units of work, so a conversation of
any length is spread over many tasks:

1. Each block gives, for each conversation in it, the least costs between entry and exit states (a min-plus matrix).
2. A conversation's matrices, one for each block, are folded from its end: the cost to go at the end of every block.
3. In a block, costs to go fix the optimal arcs. Their nodes are ranked by the least audit of the next 1, 2, 4, ... letters:
   a pair of ranks, of the node and of the node its pointer leads to, sorts strings of twice the length, and pointers double.
   The arc of the least letter and rank is a node's own, and the doubled pointers give all steps of the path from an entry
   state at once. Each block so gives the audit and exit state for every entry state.
4. Exit states are followed from block to block, which picks each block's audit.
5. Texts, read again and sorted by conversation, stream past the audit: only the hash of a repaired conversation, which can't
   be split, takes its rows in turn in one task, and holds one letter for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm._common import save

BLOCK = 4096
#: The edits' costs (fixed values of the contract) and letters in ASCII order; END marks a node without a further letter.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
END, D, I, K, R = range(5)
LETTERS = np.array([0, *b"DIKR"], np.uint8)
#: States: nothing yet, after s, after u, after a; nothing and a are complete. NEXT: state after an initial (0 s, 1 u, 2 a, 3 other), -1 for none.
STATES, COMPLETE = 4, np.array([True, False, False, True])
NEXT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The one initial (u or a) that an inserted or reroled row can have in a state, and where it leads.
WANTED = np.array([1, 1, 2, 1])
AFTER = NEXT[np.arange(STATES), WANTED]
FAR = np.int64(1) << 60

WORD = r"[^\x20\x09-\x0D]"


def text_or_blank(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def is_open(c: str) -> Column:
    """The last character that is no blank is not one of . ! and ?"""
    return ~F.col(c).rlike(r"[.!?][\x20\x09-\x0D]*\z")


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damaged: bool = True) -> DataFrame:
    """conv, conv_null, turn, role, text, copies and order (role and digest before damage) of the rows that stay; nulls are one blank. Not damaged: the rows as they are."""
    rows = rows.select(*(F.col(c).alias(n) for c, n in ((conv_col, "conv"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))))
    kind = F.crc32(F.concat_ws(":", text_or_blank("conv"), text_or_blank("turn")).cast("binary")) % 20 if damaged else F.lit(5)
    rows = rows.select(
        F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("conv"), F.col("conv").isNull().alias("conv_null"), F.col("turn").cast("long").alias("turn"), text_or_blank("role").alias("role"), text_or_blank("text").alias("text"), kind.alias("kind")
    ).filter("kind <> 0")
    mended = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv", "conv_null", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), mended.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"), F.col("role").alias("old_role"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("old_digest")
    )


#: Order of a conversation's rows: null turns first, ties by role, then by a digest of the text, both before damage.
ORDER = ("conv", "conv_null", "has_turn", "turn", "old_role", "old_digest")


def marked(rows: DataFrame) -> DataFrame:
    """Damaged rows as small ones, equal ones as one: conv, conv_null, turn, pos, block, initial, blank, truncated, first, n.

    pos follows ORDER; first: no earlier row of the conversation has its role and text.
    """
    small = rows.select(
        "conv", "conv_null", F.col("turn").isNotNull().alias("has_turn"), "turn", "old_role", "old_digest", "copies",
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).alias("digest"),
        F.coalesce(F.array_position(F.array(F.lit("s"), F.lit("u"), F.lit("a")), F.substring("role", 1, 1)), F.lit(0)).cast("int").alias("initial"),
        (~F.col("text").rlike(WORD)).alias("blank"), is_open("text").alias("open"),
    )
    one = small.groupBy(*ORDER).agg(F.sum("copies").cast("long").alias("n"), *(F.first(c).alias(c) for c in ("digest", "initial", "blank", "open")))
    ordered = one.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("pos", F.monotonically_increasing_id()).drop("old_role", "old_digest", "has_turn")
    ordered = save(ordered, "ordered")
    key = ["conv", "conv_null", "digest"]
    earliest = ordered.groupBy(*key).agg(F.min("pos").alias("earliest"))
    out = ordered.join(earliest, key)
    return out.select("conv", "conv_null", "turn", "pos", F.shiftright("pos", BLOCK.bit_length() - 1).alias("block"), "initial", "blank", (F.col("open") & ~F.col("blank")).alias("truncated"), (F.col("pos") == F.col("earliest")).alias("first"), "n")


@dataclass
class Parts:
    """The items of some parts of conversations, one after the other. An item is a row, or a run of rows that must go."""

    begin: np.ndarray  # of each part, and the end
    run: np.ndarray  # rows of a run; 0 for a row that may stay
    initial: np.ndarray
    truncated: np.ndarray

    def __len__(self) -> int:
        return len(self.begin) - 1

    @staticmethod
    def of(begin: np.ndarray, initial: np.ndarray, blank: np.ndarray, truncated: np.ndarray, first: np.ndarray, n: np.ndarray) -> "Parts":
        """From rows that stand for n equal ones: of those only the first can stay."""
        stays = first & ~blank
        more = np.where(stays, n - 1, n)
        many = stays.astype(np.int64) + (more > 0)
        ends = np.concatenate([[0], np.cumsum(many)])
        run, code, cut = np.zeros(ends[-1], np.int64), np.full(ends[-1], 3), np.zeros(ends[-1], bool)
        at = ends[:-1][stays]
        code[at], cut[at] = np.where(initial[stays] > 0, initial[stays] - 1, 3), truncated[stays]
        run[ends[1:][more > 0] - 1] = more[more > 0]
        return Parts(ends[begin], run, code, cut)

    def arcs(self, to_go: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Costs of Delete, Keep and Rerole of items from each state, given the costs to go after them (items x states): items x states x 3."""
        run, extra = self.run[item], np.where(self.truncated[item], TRUNCATED, 0)
        goal = NEXT[:, self.initial[item]].T
        free = (run == 0)[:, None]
        stay = np.where(free & (goal >= 0), np.take_along_axis(to_go, np.maximum(goal, 0), 1) + extra[:, None] + KEEP, FAR)
        other = np.where(free, to_go[:, AFTER] + extra[:, None] + REROLE, FAR)
        return np.minimum(np.stack([to_go + DELETE * np.maximum(run, 1)[:, None], stay, other], axis=2), FAR)

    def costs(self, end: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Costs to go before each item, and after the last of each part, from end (parts x states): (items + parts) x states.

        last: the part ends its conversation, so that rows can still be inserted after its last item.
        """
        size = np.diff(self.begin)
        out = np.full((len(self.run) + len(self), STATES), FAR)
        base = self.begin[:-1] + np.arange(len(self))
        out[base + size] = np.where(last[:, None], inserted(end), end)
        order = np.argsort(-size, kind="stable")
        for back in range(1, int(size.max(initial=0)) + 1):
            some = order[: int(np.searchsorted(-size[order], -back, "right"))]
            at = base[some] + size[some] - back
            out[at] = inserted(self.arcs(out[at + 1], self.begin[some] + size[some] - back).min(axis=2))
        return out


def inserted(cost: np.ndarray) -> np.ndarray:
    """Costs to go, rows inserted first where that is cheaper; a chain of inserts visits no state twice."""
    for _ in range(STATES - 1):
        cost = np.minimum(cost, np.minimum(cost[:, AFTER] + INSERT, FAR))
    return cost


def paths(parts: Parts, end: np.ndarray, last: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The least audit from each entry state of each part (parts x states, one after the other; a run of forced deletes as its
    letters) and the state it ends in."""
    to_go = parts.costs(end, last)
    size, n = np.diff(parts.begin), len(to_go)
    base = parts.begin[:-1] + np.arange(len(parts))
    layer_end = np.zeros(n, bool)
    layer_end[base + size] = True
    item = np.arange(n) - np.repeat(np.arange(len(parts)), size + 1)  # of a layer that is no part's end
    may_insert = np.where(layer_end, np.repeat(last, size + 1), True)
    after = np.where(layer_end, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    node = lambda layer, state: layer * STATES + state
    state = np.tile(np.arange(STATES), n)
    layer = np.repeat(np.arange(n), STATES)
    # optimal arcs, each letter's target or -1
    target = np.full((n * STATES, 5), -1)
    inner = np.flatnonzero(~layer_end)
    if len(inner):
        found = parts.arcs(to_go[after[inner]], item[inner]) == to_go[inner][:, :, None]
        found &= to_go[inner][:, :, None] < FAR
        goal = np.stack([np.tile(np.arange(STATES), (len(inner), 1)), NEXT[:, parts.initial[item[inner]]].T, np.tile(AFTER, (len(inner), 1))], axis=2)
        for k, letter in enumerate((D, K, R)):
            i, s = np.nonzero(found[:, :, k])
            target[node(inner[i], s), letter] = node(after[inner[i]], goal[i, s, k])
    flat = to_go.ravel()
    better = may_insert[layer] & (flat < FAR) & (to_go[layer, AFTER[state]] + INSERT == flat)
    target[better, I] = node(layer, AFTER[state])[better]
    stop = layer_end[layer] & (np.where(last, 0, 1)[np.repeat(np.arange(len(parts)), size + 1)][layer].astype(bool) | (flat == 0))
    target[stop] = -1
    # ranks and pointers of 1, 2, 4, ... letters
    has = target >= 0
    own = np.where(has.any(axis=1), has.argmax(axis=1), END)
    pointer = np.where(own == END, np.arange(len(target)), np.take_along_axis(target, own[:, None], 1)[:, 0])
    rank, pointers = own.astype(np.int64), [pointer]
    for _ in range(int(STATES * (size.max(initial=0) + 1)).bit_length()):
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[pointers[-1]], return_inverse=True)
        pointers.append(pointers[-1][pointers[-1]])
    # each node's arc: the least letter, then the least rank of what follows
    value = np.where(has, np.arange(5)[None, :] * (int(rank.max(initial=0)) + 1) + rank[np.maximum(target, 0)], np.iinfo(np.int64).max)
    own = np.where(has.any(axis=1), value.argmin(axis=1), END)
    entry = node(np.repeat(base, STATES), np.tile(np.arange(STATES), len(parts)))
    final, steps = pointers[-1][entry], np.zeros(len(entry), np.int64)
    for k in range(len(pointers) - 1, -1, -1):  # the length of each path: the largest number of steps that doesn't reach its end
        hop = pointers[k][_follow(pointers, entry, steps)]
        steps += np.where(hop != final, 1 << k, 0)
    steps += entry != final
    who = np.repeat(np.arange(len(entry)), steps)
    at = _follow(pointers, entry[who], np.arange(len(who)) - np.repeat(np.cumsum(steps) - steps, steps))
    letter, many = LETTERS[own[at]], np.ones(len(at), np.int64)
    gone = (own[at] == D) & ~layer_end[layer[at]]
    many[gone] = np.maximum(parts.run[item[layer[at[gone]]]], 1)
    ends = np.concatenate([[0], np.cumsum(np.bincount(who, many, minlength=len(entry)))]).astype(np.int64)
    text = np.repeat(letter, many).tobytes()
    return [text[a:b] for a, b in zip(ends[:-1], ends[1:])], state[final].reshape(-1, STATES)


def _follow(pointers: list[np.ndarray], nodes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The nodes so many steps on, by the doubled pointers."""
    for k, p in enumerate(pointers):
        nodes = np.where(steps >> k & 1, p[nodes], nodes)
    return nodes


def _columns(t: pa.Table, order: bool = True) -> dict[str, np.ndarray]:
    t = t.sort_by("pos") if order else t
    return {c: t.column(c).to_numpy() for c in ("initial", "blank", "truncated", "first", "n")} | {"t": t}


def _cut(t: pa.Table) -> np.ndarray:
    """Where the parts of conversations begin in sorted rows, and the end."""
    conv, null = t.column("conv").combine_chunks(), t.column("conv_null").to_numpy()
    new = np.ones(len(t), bool)
    if len(t) > 1:
        new[1:] = (null[1:] != null[:-1]) | pa.compute.not_equal(conv.slice(1), conv.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(new), len(t))


LEGAL = np.zeros((4, 4), bool)
LEGAL[[1, 2, 3], [2, 3, 2]] = True  # su, ua, au; initials are 1 s, 2 u, 3 a, 0 other
STATS = ("rows", "blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "turns")


def summaries(t: pa.Table) -> pa.Table:
    """A block's parts: conv, conv_null, block, matrix (costs from entry to exit states), stats in order of STATS."""
    c = _columns(t)
    t, begin = c["t"], _cut(c["t"])
    n, stays = c["n"], c["first"] & ~c["blank"]
    parts = Parts.of(begin, c["initial"], c["blank"], c["truncated"], c["first"], n)
    no = np.zeros(len(parts), bool)
    base = parts.begin[:-1] + np.arange(len(parts))
    matrix = np.stack([parts.costs(np.where(np.arange(STATES) == s, 0, FAR) + np.zeros((len(parts), 1), np.int64), no)[base] for s in range(STATES)], axis=2).reshape(len(parts), -1)
    part = np.repeat(np.arange(len(parts)), np.diff(begin))
    add = lambda v: np.bincount(part, v, minlength=len(parts)).astype(np.int64)
    pairs = n - 1  # equal rows beside each other are never legal
    inside = np.ones(len(n), bool)
    inside[begin[:-1]] = False
    pairs[1:] += inside[1:] & ~LEGAL[c["initial"][:-1], c["initial"][1:]]
    turn = t.column("turn").combine_chunks()
    known = turn.is_valid().to_numpy(zero_copy_only=False)
    turn = turn.fill_null(0).to_numpy()
    new = known.copy()
    new[1:] &= ~inside[1:] | ~known[:-1] | (turn[1:] != turn[:-1])
    some = add(known) > 0
    low, high = np.full(len(parts), None, object), turn[begin[1:] - 1].astype(object)
    first = np.flatnonzero(known & (~inside | ~np.concatenate([[False], known[:-1]])))
    low[part[first]] = turn[first]
    high[~some] = None
    dup = n - stays
    stats = [add(n), add(np.where(c["blank"], n, 0)), add(np.where(c["blank"], 0, dup)), add(stays & c["truncated"]), add(pairs), c["initial"][begin[:-1]], c["initial"][begin[1:] - 1], low, high, add(new)]
    own = t.take(pa.array(begin[:-1]))
    rows = [[None if x is None else int(x) for x in r] for r in zip(*stats)]
    return pa.table([own.column("conv"), own.column("conv_null"), own.column("block"), pa.array(matrix.tolist(), pa.list_(pa.int64())), pa.array(rows, pa.list_(pa.int64()))], names=["conv", "conv_null", "block", "matrix", "stats"])


def audits(t: pa.Table, ends: pa.Table) -> pa.Table:
    """A block's parts: conv, conv_null, block, audits and exits by entry state (of parts that begin a conversation, entry 0 counts), cost.

    ends: the costs to go after parts of conversations that go on in other blocks; all other parts are whole conversations.
    """
    c = _columns(t)
    t, begin = c["t"], _cut(c["t"])
    parts = Parts.of(begin, c["initial"], c["blank"], c["truncated"], c["first"], c["n"])
    own = t.take(pa.array(begin[:-1]))
    end, last = np.tile(np.where(COMPLETE, 0, FAR), (len(parts), 1)), np.ones(len(parts), bool)
    given = {(r["conv"], r["conv_null"]): r for r in ends.to_pylist()}
    if given:
        for k, key in enumerate(zip(own.column("conv").to_pylist(), own.column("conv_null").to_pylist())):
            if key in given and not given[key]["last"]:
                end[k], last[k] = given[key]["to_go"], False
    found, exits = paths(parts, end, last)
    cost = parts.costs(end, last)[parts.begin[:-1] + np.arange(len(parts)), 0]
    texts = [found[STATES * k : STATES * (k + 1)] for k in range(len(parts))]
    return pa.table([own.column("conv"), own.column("conv_null"), own.column("block"), pa.array(texts, pa.list_(pa.binary())), pa.array(exits.tolist(), pa.list_(pa.int32())), pa.array(cost)], names=["conv", "conv_null", "block", "audits", "exits", "cost"])


def _fold(pdf):
    """Costs to go after each part of one conversation, from its last part on."""
    pdf = pdf.sort_values("block")
    to_go, out = inserted(np.where(COMPLETE, 0, FAR)[None])[0], []
    for m in reversed(pdf["matrix"].tolist()):
        out.append(to_go.tolist())
        to_go = np.minimum((np.array(m).reshape(STATES, STATES) + to_go[None, :]).min(axis=1), FAR)
    out = pdf[["conv", "conv_null", "block"]].assign(to_go=out[::-1], last=False)
    out.iloc[-1, out.columns.get_loc("last")] = True
    return out


def _chain(pdf):
    """The entry state of each part of one conversation."""
    pdf, state, out = pdf.sort_values("block"), 0, []
    for exits in pdf["exits"]:
        out.append(state)
        state = int(exits[state])
    return pdf[["conv", "conv_null", "block"]].assign(entry=out)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation (its name, its parts, its texts): a result for each conversation. Texts pass by."""
    names = ["conv", "conv_null", "rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.string(), pa.bool_(), *[pa.int64()] * 7, pa.string(), pa.string()]
    done: list[tuple] = []
    c = None
    for b in batches:
        for conv, null, kind, stats, cost, audit, role, text, copies in zip(*(b.column(k).to_pylist() for k in ("conv", "conv_null", "kind", "stats", "cost", "audit", "role", "text", "copies"))):
            if c is None or c.key != (conv, null):
                if c is not None:
                    done.append(c.result())
                c = _Conversation((conv, null))
            if kind == 1:
                c.part(stats, cost, audit)
            elif kind == 2:
                for _ in range(copies):
                    c.row(role, text)
        if len(done) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), kinds)], names=names)
            done = []
    if c is not None:
        done.append(c.result())
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), kinds)], names=names)


class _Conversation:
    """One conversation on its way: sums of its parts, then the hash of its repaired rows."""

    def __init__(self, key: tuple[str, bool]):
        self.key, self.sums, self.cost, self.audit = key, [0] * 5, 0, bytearray()
        self.tail = self.low = self.high = None
        self.turns = self.at = self.state = 0
        self.hash, self.lines = hashlib.sha256(), 0

    def part(self, stats: list, cost: int, audit: bytes) -> None:
        if self.tail is None:
            self.cost = cost
        self.sums = [a + b for a, b in zip(self.sums, stats)]
        head, tail, low, high, turns = stats[5:]
        self.sums[4] += self.tail is not None and not LEGAL[self.tail, head]
        self.turns += turns - (low is not None and low == self.high)
        self.low, self.high, self.tail = low if self.low is None else self.low, high if high is not None else self.high, tail
        self.audit += audit

    def _line(self, role: str, text: str) -> None:
        self.hash.update(("\n" * (self.lines > 0) + role + ":" + text).encode())
        self.lines += 1

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == LETTERS[I]:
            self.at += 1
            self._line("user" if WANTED[self.state] == 1 else "assistant", "")
            self.state = AFTER[self.state]

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == LETTERS[K]:
            self._line(role, text)
            self.state = NEXT[self.state, "sua".index(role[0])]
        elif letter == LETTERS[R]:
            self._line("user" if WANTED[self.state] == 1 else "assistant", text)
            self.state = AFTER[self.state]

    def result(self) -> tuple:
        self._inserts()
        rows, blank, duplicate, truncated, illegal = self.sums
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (*self.key, rows, gaps, blank, duplicate, truncated, illegal, self.cost, self.audit.decode(), self.hash.hexdigest())


KEY = ["conv", "conv_null"]


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damaged: bool = True) -> DataFrame:
    """conv_id, rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation; damaged: damage() comes first.

    A null conversation id is a conversation of its own; null turns come first; a null role or text is one blank, so a null
    role can only be deleted or reroled and a null text is deleted. Rows of one turn are ordered by role, then by a digest of the text, both as
    given. Repeated rows count each. A conversation without rows after damage has zeros, an empty audit and the hash of an
    empty text; an empty table gives no rows; other columns are ignored. Turns whose span is beyond a long stop the job.
    """
    rows = damage(conversations, conv_col, turn_col, role_col, text_col, damaged)
    marks = save(marked(rows), "marks")
    parts = save(marks.groupBy("block").applyInArrow(summaries, "conv string, conv_null boolean, block long, matrix array<long>, stats array<long>"), "parts")
    spans = parts.groupBy(*KEY).agg(F.min("block").alias("lo"), F.max("block").alias("hi")).filter("lo < hi")
    several = parts.join(spans.select(*KEY), KEY, "left_semi")  # at most two in a block
    ends = several.select(*KEY, "block", "matrix").groupBy(*KEY).applyInPandas(_fold, "conv string, conv_null boolean, block long, to_go array<long>, last boolean")
    found = marks.groupBy("block").cogroup(ends.groupBy("block")).applyInArrow(audits, "conv string, conv_null boolean, block long, audits array<binary>, exits array<int>, cost long")
    found = save(found, "audits")
    entries = found.join(spans.select(*KEY), KEY, "left_semi").select(*KEY, "block", "exits").groupBy(*KEY).applyInPandas(_chain, "conv string, conv_null boolean, block long, entry int")
    picked = found.join(entries, [*KEY, "block"], "left").withColumn("audit", F.element_at("audits", F.coalesce("entry", F.lit(0)) + 1))
    picked = picked.join(parts.select(*KEY, "block", "stats"), [*KEY, "block"])
    none = lambda t: F.lit(None).cast(t)
    order = ("block", *ORDER[2:])
    every = conversations.select(F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("conv"), F.col(conv_col).isNull().alias("conv_null")).distinct()
    names = every.select(*KEY, F.lit(0).alias("kind"), none("array<long>").alias("stats"), none("long").alias("cost"), none("binary").alias("audit"), none("string").alias("role"), none("string").alias("text"), F.lit(0).alias("copies"), none("long").alias("block"), none("boolean").alias("has_turn"), none("long").alias("turn"), none("string").alias("old_role"), none("binary").alias("old_digest"))
    pieces = picked.select(*KEY, F.lit(1).alias("kind"), "stats", "cost", "audit", none("string").alias("role"), none("string").alias("text"), F.lit(0).alias("copies"), "block", none("boolean").alias("has_turn"), none("long").alias("turn"), none("string").alias("old_role"), none("binary").alias("old_digest"))
    texts = rows.select(*KEY, F.lit(2).alias("kind"), none("array<long>").alias("stats"), none("long").alias("cost"), none("binary").alias("audit"), "role", "text", "copies", none("long").alias("block"), F.col("turn").isNotNull().alias("has_turn"), "turn", "old_role", "old_digest")
    together = names.unionByName(pieces).unionByName(texts).repartition(*KEY).sortWithinPartitions(*KEY, "kind", *order)
    out = together.mapInArrow(_texts, "conv string, conv_null boolean, rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    conv = F.when(~F.col("conv_null"), F.col("conv")).cast(conversations.schema[conv_col].dataType).alias(conv_col)
    return out.select(conv, "rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
