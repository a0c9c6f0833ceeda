"""Conversation structure repair by the auction shortest-path algorithm
(operator 12).

A conversation's turns, in order, are edited at least cost so that its roles
read ``(system? (user assistant)+)?``.  The lattice has a node for every
number of turns read and every state of that grammar (nothing yet, after a
system, user or assistant turn); arcs keep, re-role or delete the next turn or
insert an empty one, and all costs are integers.

The auction keeps one path from the origin and a price per node.  Where the
path's last node costs less than its best arc, its price rises to that and
the path contracts by a node; otherwise it extends along the best arc.  Prices
stay dual feasible throughout and start from what every turn costs in any
case, so only conflicts of roles are bid for.  When the path has reached the
sink, the origin's price is the shortest distance and every arc of every
shortest path is tight (cost = difference of prices).  Among tight arcs that
lead on to the sink the trace takes the smallest letter (D, I, K, R), which
gives the smallest string of edits among the cheapest.

A conversation is cut into blocks of at most ``BLOCK`` turns, so one that
holds a large part of all rows is spread over tasks: blocks are priced apart
(for every state at their ends), a backward pass over the blocks' prices,
four integers each, gives the cost to go behind every block, and the blocks
are traced apart against that.  Only the last pass, which writes the edited
turns of a conversation in order, is one stream per conversation, in memory
that does not grow with it; a digest of the whole repaired text needs that.

Defined results: a null role or text is one space; turns without a number
come first; ties go by role and digest of the text; repeated rows are turns
like any other; a null conv_id is a conversation; a turn that is blank, or
whose role and text stood earlier, has to go; a conversation without turns
needs no edits; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, column, exchange_width

BLOCK = 64
INSERT, REROLE, DELETE, UNFINISHED = 3, 3, 4, 3
SPACE = " \t\n\x0b\x0c\r"
#: States of the grammar, also the classes of role initials (0: any other).
START, SYSTEM, USER, ASSISTANT = range(4)
#: What an inserted or re-roled turn becomes after each state.
NEXT = (USER, USER, ASSISTANT, USER)
FOLLOWS = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
ROLES = {USER: "user", ASSISTANT: "assistant"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
NEVER = float("inf")
#: Cost to go behind the last turn, before closing inserts.
ACCEPT = (0, NEVER, NEVER, 0)


# Kernel -----------------------------------------------------------------------
def lattice(turns: tuple, goal: tuple, closing: bool) -> list[list[tuple]]:
    """Arcs ``(letter, cost, head)`` of every node; ``turns`` are numbers
    4 * initial + fault, ``goal`` what it costs to go on from each state
    behind them.  Inserts behind the last turn belong to what follows, except
    in the closing lattice.  Node 4 * turns read + state; the sink is last."""
    n = len(turns)
    arcs: list[list[tuple]] = [[] for _ in range(4 * n + 5)]
    for i in range(n + 1):
        for state in range(4):
            out = arcs[4 * i + state]
            if i < n or closing:
                out.append(("I", INSERT, 4 * i + NEXT[state]))
            if i == n:
                if goal[state] < NEVER:
                    out.append(("", goal[state], 4 * n + 4))
                continue
            initial, fault = divmod(turns[i], 4)
            out.append(("D", DELETE, 4 * i + 4 + state))
            if fault in (FINE, TRUNCATED):
                more = UNFINISHED if fault == TRUNCATED else 0
                if state in FOLLOWS.get(initial, ()):
                    out.append(("K", more, 4 * i + 4 + initial))
                out.append(("R", REROLE + more, 4 * i + 4 + NEXT[state]))
    return arcs


def can_reach(arcs: list[list[tuple]], use) -> bytearray:
    """Nodes from which arcs that ``use`` accepts lead to the sink."""
    back: list[list[int]] = [[] for _ in arcs]
    for tail, out in enumerate(arcs):
        for arc in out:
            if use(tail, arc):
                back[arc[2]].append(tail)
    seen = bytearray(len(arcs))
    todo = [len(arcs) - 1]
    seen[-1] = 1
    while todo:
        for tail in back[todo.pop()]:
            if not seen[tail]:
                seen[tail] = 1
                todo.append(tail)
    return seen


def first_prices(turns: tuple, goal: tuple, arcs: list[list[tuple]]) -> list[float]:
    """Feasible prices: what the turns ahead cost whatever is done with them;
    without end where nothing leads to the sink."""
    least = min(goal)
    price: list[float] = [0.0] * len(arcs)
    for i in range(len(turns), -1, -1):
        if i < len(turns):
            fault = turns[i] % 4
            least += 0 if fault == FINE else UNFINISHED if fault == TRUNCATED else DELETE
        price[4 * i:4 * i + 4] = [least] * 4
    reach = can_reach(arcs, lambda tail, arc: True)
    return [p if r else NEVER for p, r in zip(price, reach)]


def auction(arcs: list[list[tuple]], price: list[float], origin: int) -> None:
    """Raise prices until the path from ``origin`` has reached the sink; the
    origin's price is its shortest distance then."""
    sink = len(arcs) - 1
    if price[origin] == NEVER:
        return
    path = [origin]
    while path[-1] != sink:
        node = path[-1]
        best, head = min((cost + price[to], to) for _, cost, to in arcs[node])
        if price[node] < best:
            price[node] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(head)


@lru_cache(maxsize=4096)
def solved(turns: tuple, goal: tuple, closing: bool) -> tuple[list, list]:
    arcs = lattice(turns, goal, closing)
    price = first_prices(turns, goal, arcs)
    for state in range(4):
        auction(arcs, price, state)
    return arcs, price


@lru_cache(maxsize=4096)
def crossing_costs(turns: tuple) -> tuple:
    """Cost from every state before a block to every state behind it, row by
    row, -1 where there is no way."""
    ends = [solved(turns, tuple(0 if s == end else NEVER for s in range(4)), False)[1][:4] for end in range(4)]
    return tuple(-1 if ends[e][s] == NEVER else int(ends[e][s]) for s in range(4) for e in range(4))


@lru_cache(maxsize=4096)
def traces(turns: tuple, goal: tuple, closing: bool = False) -> tuple:
    """For each state before the block: the letters of the smallest cheapest
    edits and the state behind (None where there is no way)."""
    arcs, price = solved(turns, goal, closing)

    def tight(tail, arc):
        return price[tail] < NEVER and price[tail] == arc[1] + price[arc[2]]

    leads = can_reach(arcs, tight)
    found = []
    for node in range(4):
        if price[node] == NEVER:
            found.append((None, None))
            continue
        letters = []
        while True:
            letter, _, head = min(a for a in arcs[node] if leads[a[2]] and tight(node, a))
            if head == len(arcs) - 1:
                break
            letters.append(letter)
            node = head
        found.append(("".join(letters), node % 4))
    return tuple(found)


def closing_costs() -> tuple:
    return tuple(int(p) for p in solved((), ACCEPT, True)[1][:4])


def normal(goal) -> tuple:
    """Costs to go less the smallest, which changes no choice."""
    least = min(goal)
    return tuple(g - least for g in goal)


# Rows -------------------------------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's faults, put in by a checksum of ``conv_id:turn``."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    named = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    fate = (F.crc32(named) % 20).cast("int")
    said = conversations.select(
        conv.alias("conv_id"), turn.alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), fate.alias("fate")).where("fate <> 0")
    return said.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.struct("role", F.sha2("text", 256).alias("digest")).alias("tie"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def in_order(turns: DataFrame) -> DataFrame:
    """Turns with ``pos``, a number that grows along each conversation: range
    partitions of the whole order, so that a large conversation takes several.
    Written once, so positions hold whatever is computed again."""
    if "tie" not in turns.columns:
        turns = turns.withColumn("tie", F.struct("role", F.sha2("text", 256).alias("digest"))).withColumn("copy", F.lit(0))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "tie", "copy")]
    return (turns.repartitionByRange(exchange_width(turns.sparkSession), *order).sortWithinPartitions(*order)
            .select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")).checkpoint())


def with_faults(rows: DataFrame) -> DataFrame:
    """``initial`` and the first ``fault`` of every turn."""
    firsts = rows.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    blank = bare == ""
    fault = (F.when(blank, BLANK).when(F.col("first").isNull(), DUPLICATE)
             .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE))
    return rows.join(firsts, "pos", "left").withColumn("fault", fault).withColumn("initial", initial_class(F.col("role"))).drop("first")


def initial_class(role: Column) -> Column:
    c = F.substring(role, 1, 1)
    return F.when(c == "s", SYSTEM).when(c == "u", USER).when(c == "a", ASSISTANT).otherwise(START)


def planned(flagged: DataFrame) -> DataFrame:
    """``(pos, letters, ends)`` for the first turn of every block: the edits
    of the block and the state behind it, for each state before it."""
    blocks = (flagged.groupBy("conv_id", F.shiftright("pos", BLOCK.bit_length() - 1).alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("initial") * 4 + F.col("fault")).alias("code")))).alias("t"))
              .select("conv_id", F.col("t")[0]["pos"].alias("pos"), F.col("t.code").alias("turns")))

    def price(batches):
        for batch in batches:
            costs = [list(crossing_costs(tuple(t))) for t in column(batch, "turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["pos"], batch["turns"], pa.array(costs, pa.list_(pa.int64()))],
                                             ["conv_id", "pos", "turns", "costs"])

    def backward(batches):
        open_, ahead = object(), ()
        for batch in batches:
            goals = []
            for conv, costs in zip(batch["conv_id"].to_pylist(), batch["costs"].to_pylist()):
                if conv != open_:
                    open_, ahead = conv, closing_costs()
                goals.append(list(normal(ahead)))
                ahead = [min(c + g for c, g in zip(costs[4 * s:4 * s + 4], ahead) if c >= 0) for s in range(4)]
            yield pa.RecordBatch.from_arrays([batch["pos"], batch["turns"], pa.array(goals, pa.list_(pa.int64()))], ["pos", "turns", "goal"])

    def trace(batches):
        for batch in batches:
            each = [traces(tuple(t), tuple(g)) for t, g in zip(batch["turns"].to_pylist(), batch["goal"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch["pos"], pa.array([[x[0] for x in e] for e in each], pa.list_(pa.string())),
                 pa.array([[x[1] for x in e] for e in each], pa.list_(pa.int32()))], ["pos", "letters", "ends"])

    width = exchange_width(flagged.sparkSession)
    priced = blocks.mapInArrow(price, "conv_id long, pos long, turns array<int>, costs array<long>")
    ahead = (priced.repartition(width, "conv_id").sortWithinPartitions("conv_id", F.desc("pos"))
             .mapInArrow(backward, "pos long, turns array<int>, goal array<long>"))
    return ahead.repartition(width, "pos").mapInArrow(trace, "pos long, letters array<string>, ends array<int>")


TURNS = "conv_id long, place long, edit string, was string, role string, text string, cost int"


def repaired(flagged: DataFrame) -> DataFrame:
    """Every edit of every conversation: ``place`` (from 0), ``edit`` (D, I,
    K, R), ``was`` (the role before, null if inserted), ``role`` (null if
    deleted), ``text`` and ``cost``.  A conversation's rows stand together and
    in order."""
    spark = flagged.sparkSession
    bounded_batches(spark)
    rows = (flagged.join(planned(flagged), "pos", "left").select("conv_id", "pos", "role", "text", "fault", "letters", "ends")
            .repartition(exchange_width(spark), "conv_id").sortWithinPartitions("conv_id", "pos"))

    def edits(batches):
        conv, state, queue, place, out = None, None, iter(()), 0, []

        def write(edit, was, role, text, cost):
            nonlocal place
            out.append((conv, place, edit, was, role, text, cost))
            place += 1

        def insert():
            nonlocal state
            state = NEXT[state]
            write("I", None, ROLES[state], "", INSERT)

        def close():
            if state is not None:
                for _ in traces((), ACCEPT, True)[state][0]:
                    insert()

        def emit():
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in TURNS.split(", ")])
            out.clear()
            return made

        for batch in batches:
            for c, role, text, fault, letters, ends in zip(*(batch[n].to_pylist() for n in ("conv_id", "role", "text", "fault", "letters", "ends"))):
                if state is None or c != conv:
                    close()
                    conv, state, place, queue = c, START, 0, iter(())
                if letters is not None:  # a block begins; inserts come before the turn they precede
                    queue = iter(letters[state])
                for edit in queue:
                    if edit == "I":
                        insert()
                        continue
                    more = UNFINISHED if fault == TRUNCATED else 0
                    if edit == "D":
                        write("D", role, None, text, DELETE)
                    elif edit == "K":
                        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
                        write("K", role, role, text, more)
                    else:
                        state = NEXT[state]
                        write("R", role, ROLES[state], text, REROLE + more)
                    break
            yield emit()
        close()
        yield emit()

    return rows.mapInArrow(edits, TURNS)


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation of :func:`repaired`, read along its order: ``illegal``
    neighbours before, total ``cost``, ``audit`` and the repaired text's
    digest."""
    def fold(batches):
        conv, sha, audit, cost, illegal, last, begun = None, None, [], 0, 0, None, False
        out = []
        for batch in batches:
            for c, place, edit, was, role, text, price in zip(*(batch[f.split()[0]].to_pylist() for f in TURNS.split(", "))):
                if place == 0:
                    if sha is not None:
                        out.append((conv, illegal, cost, "".join(audit), sha.hexdigest()))
                    conv, sha, audit, cost, illegal, last, begun = c, hashlib.sha256(), [], 0, 0, None, False
                audit.append(edit)
                cost += price
                if was is not None:
                    illegal += last is not None and last + was[:1] not in ("su", "ua", "au")
                    last = was[:1]
                if role is not None:
                    sha.update((("\n" if begun else "") + role + ":" + text).encode())
                    begun = True
            yield report(out)
            out = []
        if sha is not None:
            out.append((conv, illegal, cost, "".join(audit), sha.hexdigest()))
        yield report(out)

    def report(out):
        cols = list(zip(*out)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "illegal", "cost", "audit", "repaired_sha256"])

    return turns.mapInArrow(fold, "conv_id long, illegal long, cost long, audit string, repaired_sha256 string")


def structure_report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Faults and cheapest repair of ``turns`` for every conv_id of
    ``conversations``."""
    flagged = with_faults(in_order(turns))
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    faults = flagged.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).alias("gaps"),
        *[F.sum((F.col("fault") == code).cast("long")).alias(name) for name, code in
          (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))])
    every = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    edited = digests(repaired(flagged)).withColumnRenamed("conv_id", "c")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (every.join(faults, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(edited, F.col("id").eqNullSafe(F.col("c")), "left")
            .select(F.col("id").alias("conv_id"), *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
