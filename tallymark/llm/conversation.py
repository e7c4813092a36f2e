"""Structure faults of conversations and their cheapest repair, solved once for each suffix of role/fault signatures.

1. A row becomes one symbol: its role's class and its first fault.  A conversation is the string of its symbols, its
   signature; long ones are cut into segments of SEGMENT rows, so no conversation is one task's memory.
2. What a repair costs from some row on depends on the symbols from there on alone, and on the grammar state that the rows
   before have led to.  So signatures share suffixes: sorted by their reversal, they are walked like the words of an
   incrementally built automaton, and a node (a suffix) is solved when it is first met, for each of the four
   states: cost to go, state at the end, and the best audit suffix.  All conversations with that suffix use it.
   Equal nodes of different suffixes (symbol, costs behind it) are solved by one step, which is kept.
3. Segments of one conversation meet by min-plus products: a segment's costs from each state to each state, folded from the
   end, give the costs that stand behind each segment; distinct pairs of these and a signature are solved as in 2.
4. The repaired rows of a conversation are hashed in a sorted stream.  A hash is one after the other by nature; memory is
   one segment's audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize, ship_code, valid_text
from .ranking import positions

#: Rows of a segment.
SEGMENT = 4096
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: 0 nothing yet, 1 behind system, 2 behind user, 3 behind assistant; 0 and 3 may end.
#: State behind an inserted or rerolled row, whose role follows from it.
FILLED = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: State behind a kept row, by its role's initial.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Inserts that end a conversation in each state.
CLOSING = ("", "II", "I", "")
FINAL = tuple(INSERT * len(x) for x in CLOSING)
NEVER = 1 << 28
#: Symbols: role class s, u, a or o (any other); capitals: truncated; digits: blank (1 to 4) or duplicate (5 to 8).
PLAIN, CUT, BLANK, AGAIN = "suao", "SUAO", "1234", "5678"
_ROLE_OF = {c: PLAIN[i] for row in (PLAIN, CUT, BLANK, AGAIN) for i, c in enumerate(row)}


@lru_cache(maxsize=1 << 16)
def solve_step(symbol: str, behind: tuple[int, ...]) -> tuple[tuple[int, str, int], ...]:
    """For each state before the row: (cost to go, edits up to and with the row's, state behind it), given the costs behind.

    Each edit has its own letter and one successor, so the least audit among equal costs is told by the first letters.
    """
    role, must_go, extra = _ROLE_OF[symbol], symbol in BLANK + AGAIN, TRUNCATED * (symbol in CUT)
    best = []
    for state in range(4):
        ways = [(behind[state] + DELETE, "D", state)]
        if not must_go:
            ways.append((behind[FILLED[state]] + REROLE + extra, "R", FILLED[state]))
            if role in KEPT[state]:
                ways.append((behind[KEPT[state][role]] + extra, "K", KEPT[state][role]))
        best.append(min((min(cost, NEVER), edit, to) for cost, edit, to in ways))
    for _ in range(2):  # no more than two inserts in a row can be of use
        best = [min(best[s], (min(best[FILLED[s]][0] + INSERT, NEVER), "I" + best[FILLED[s]][1], best[FILLED[s]][2])) for s in range(4)]
    return tuple(best)


class Suffixes:
    """The automaton's nodes along the last signature, nearest the end first; the next signature keeps what it shares."""

    def __init__(self) -> None:
        self.end: tuple[int, ...] | None = None
        self.signature = ""
        self.nodes: list[tuple[tuple[int, ...], list[tuple[int, str]]]] = []

    def solve(self, end: tuple[int, ...], signature: str) -> tuple[list[int], list[int], list[str]]:
        """(cost to go, state at the end, audit) for each state before the signature."""
        if end != self.end:
            self.end, self.signature, self.nodes = end, "", [(end, [(s, "") for s in range(4)])]
        shared, most = 0, min(len(signature), len(self.signature))
        while shared < most and signature[-1 - shared] == self.signature[-1 - shared]:
            shared += 1
        del self.nodes[shared + 1 :]
        for k in range(shared, len(signature)):
            costs, rest = self.nodes[-1]
            least = min(costs)
            step = solve_step(signature[-1 - k], tuple(min(c - least, NEVER) for c in costs))
            self.nodes.append((tuple(min(c + least, NEVER) for c, _, _ in step), [(rest[to][0], edits + rest[to][1]) for _, edits, to in step]))
        self.signature = signature
        costs, rest = self.nodes[-1]
        return list(costs), [x for x, _ in rest], [a for _, a in rest]


_SOLVED = "end string, sig string, costs array<int>, exits array<int>, audits array<string>"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes = Suffixes()
    for batch in batches:
        ends, sigs = batch.column("end").to_pylist(), batch.column("sig").to_pylist()
        for at in range(0, len(sigs), 256):
            found = [nodes.solve(tuple(map(int, e.split(","))), s) for e, s in zip(ends[at : at + 256], sigs[at : at + 256], strict=True)]
            ints, texts = pa.list_(pa.int32()), pa.list_(pa.string())
            cols = [pa.array([f[0] for f in found], ints), pa.array([f[1] for f in found], ints), pa.array([f[2] for f in found], texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ends[at : at + 256]), pa.array(sigs[at : at + 256]), *cols], names=["end", "sig", "costs", "exits", "audits"])


def _solved(wanted: DataFrame, name: str) -> DataFrame:
    """``wanted`` (end, sig), each pair once, solved along the automaton."""
    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("end"), F.reverse("sig")]
    distinct = materialize(wanted.distinct(), f"{name}-signatures")
    return materialize(distinct.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_solve, _SOLVED), name)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs behind each segment of conversations with several."""
    for batch in batches:
        for conv, segments in zip(batch.column("conv").to_pylist(), batch.column("segments").to_pylist(), strict=True):
            behind, out = FINAL, []
            for s in reversed(segments):
                out.append((s["seg"], s["sig"], ",".join(map(str, behind))))
                columns = {m["exit"]: m["costs"] for m in s["matrix"]}
                costs = [min(min(columns[x][e] + behind[x], NEVER) for x in range(4)) for e in range(4)]
                behind = tuple(min(c - min(costs), NEVER) for c in costs)
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(out), pa.string()), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out]), pa.array([x[2] for x in out])], names=["conv", "seg", "sig", "end"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's own edits: conv, seg, state before it, its cost, audit, whether its first pair of roles is illegal."""
    for batch in batches:
        for conv, segments in zip(batch.column("conv").to_pylist(), batch.column("segments").to_pylist(), strict=True):
            state, rows, before = 0, [], ""
            for s in segments:
                to = s["exits"][state]
                cost = s["costs"][state] - int(s["end"].split(",")[to])
                audit = s["audits"][state]
                if s is segments[-1]:
                    cost, audit = cost + FINAL[to], audit + CLOSING[to]
                rows.append((conv, s["seg"], state, cost, audit, int(bool(before) and before + _ROLE_OF[s["sig"][0]] not in ("su", "ua", "au"))))
                state, before = to, _ROLE_OF[s["sig"][-1]]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv", "seg", "state", "cost", "audit", "joint"])


class _Repaired:
    """Hash of a conversation's repaired rows, fed in order."""

    def __init__(self) -> None:
        self.hash, self.first, self.state, self.audit, self.at = hashlib.sha256(), True, 0, "", 0

    def segment(self, audit: str) -> None:
        self.audit, self.at = audit, 0

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("" if self.first else "\n") + role + ":" + text).encode())
        self.first = False

    def _fill(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state, self.at = FILLED[self.state], self.at + 1
            self._put(ROLE[self.state], "")

    def row(self, role: str, text: str) -> None:
        self._fill()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            self.state = FILLED[self.state] if edit == "R" else KEPT[self.state][role[0]]
            self._put(ROLE[self.state] if edit == "R" else role, text)

    def digest(self) -> str:
        self._fill()
        return self.hash.hexdigest()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, _Repaired()
    for batch in batches:
        done = []
        for at in range(0, batch.num_rows, 1024):
            cut = batch.slice(at, 1024).to_pydict()
            for conv, pos, role, text in zip(cut["conv"], cut["pos"], cut["role"], cut["text"], strict=True):
                if conv != now:
                    if now is not None:
                        done.append((now, state.digest()))
                    now, state = conv, _Repaired()
                if pos < 0:
                    state.segment(text)
                else:
                    state.row(role, text)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.string())], names=["conv", "repaired_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.digest()])], names=["conv", "repaired_sha256"])


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults set in by the hash of `conv_id:turn`: conv, turn, role, text.

    Hash modulo 20: 0 drops the row, 1 empties its text, 2 takes out its `.`, `!` and `?`, 3 repeats it, 4 makes its role user.
    """
    n = F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.when(n == 1, "").when(n == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(n == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(n == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(n != 0).select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def plain(conversations: DataFrame) -> DataFrame:
    """conv (conv_id as text), turn, role, text; a null conv_id, role or text is one space."""
    blank = F.lit(" ")
    return conversations.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), blank).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(valid_text("role"), blank).alias("role"), F.coalesce(valid_text(), blank).alias("text"))


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """For each conversation of ``rows`` (conv: no nulls, turn, role, text: no nulls): its faults and its cheapest repair.

    Returns conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.  Rows are taken by turn, null
    first; rows of one turn by role, then by digest of role and text.  Result doesn't depend on ``segment``.
    """
    ship_code(rows.sparkSession)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    kind = F.when(blank, 2).when(cut, 1).otherwise(0)
    initial = F.substring("role", 1, 1)
    role_class = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    known = rows.withColumns({"kind": kind, "class": role_class, "digest": digest})
    ranked, _ = positions(known, "conv", [F.asc_nulls_first("turn"), F.col("role"), F.col("digest")], "turns")
    ranked = materialize(ranked, "ranked")

    told = ranked.where("kind <> 2").select("conv", "pos", "digest")
    repeated = told.groupBy("conv", "digest").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n > 1")
    late = join_counted(told, materialize(repeated, "repeated"), ["conv", "digest"]).where(F.col("pos") > F.col("first")).select("conv", "pos", F.lit(True).alias("again"))
    row = F.when(F.col("kind") == 2, F.lit(BLANK)).when(F.col("again"), F.lit(AGAIN)).when(F.col("kind") == 1, F.lit(CUT)).otherwise(F.lit(PLAIN))
    symbols = ranked.select("conv", "pos", "class", "kind").join(late, ["conv", "pos"], "left").select("conv", "pos", F.substring(row, F.instr(F.lit(PLAIN), F.col("class")), F.lit(1)).alias("symbol"))
    seg = F.floor(F.col("pos") / segment).alias("seg")
    spelt = symbols.groupBy("conv", seg).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "").alias("sig"))
    segments = materialize(spelt, "segments")

    many = segments.where("seg > 0").select("conv").distinct()
    long = materialize(segments.join(many, "conv", "left_semi"), "long")
    final = F.lit(",".join(map(str, FINAL)))
    placed = segments.join(many, "conv", "left_anti").select("conv", "seg", "sig", final.alias("end"))
    if not long.isEmpty():
        units = F.explode(F.array(*(F.struct(F.lit(x).alias("exit"), F.lit(",".join(str(NEVER * (k != x)) for k in range(4))).alias("end")) for x in range(4)))).alias("unit")
        columns = _solved(long.select("sig", units).select("unit.end", "sig"), "columns").withColumn("exit", F.array_position(F.split("end", ","), "0").cast("int") - 1)
        matrices = columns.groupBy("sig").agg(F.collect_list(F.struct("exit", "costs")).alias("matrix"))
        chains = long.join(matrices, "sig").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("seg", "sig", "matrix"))).alias("segments"))
        placed = placed.unionByName(chains.mapInArrow(_between, "conv string, seg long, sig string, end string"))
    placed = materialize(placed, "placed")
    answers = _solved(placed.select("end", "sig"), "answers")
    counts = placed.groupBy("end", "sig").agg(F.count("*").alias("n"))
    joined = join_counted(placed, materialize(answers.join(counts, ["end", "sig"]), "counted"), ["end", "sig"])
    chains = joined.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("seg", "sig", "end", "costs", "exits", "audits"))).alias("segments"))
    edits = materialize(chains.mapInArrow(_forward, "conv string, seg long, state int, cost long, audit string, joint long"), "edits")

    heads = edits.select("conv", "seg", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = heads.unionByName(ranked.select("conv", seg, "pos", "role", "text")).repartition("conv").sortWithinPartitions("conv", "seg", "pos")
    hashes = stream.mapInArrow(_hashes, "conv string, repaired_sha256 string")

    having = lambda letters: (F.length("sig") - F.length(F.translate("sig", letters, ""))).cast("long")
    roles = F.translate("sig", CUT + BLANK + AGAIN, PLAIN * 3)
    wrong = F.length("sig") - 1 - F.size(F.regexp_extract_all(roles, F.lit("(?=(su|ua|au))"), F.lit(0)))
    faults = segments.select("conv", having(BLANK).alias("blank"), having(AGAIN).alias("duplicate"), having(CUT).alias("truncated"), wrong.alias("illegal"))
    faults = faults.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    totals = edits.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sum("joint").alias("joint"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    turns = ranked.groupBy("conv").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("n_turns"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    gaps = F.coalesce((wide("hi") - wide("lo") + 1 - wide("n_turns")).try_cast("long"), F.lit(0).cast("long"))
    out = faults.join(totals, "conv").join(turns, "conv").join(hashes, "conv")
    return out.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.col("joint")).cast("long").alias("illegal"), "cost", "audit", "repaired_sha256")


def damage_and_repair(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """For every conv_id of ``conversations`` (conv_id, turn, role, text): faults and repair after ``damaged``.

    Returns conv_id, gaps (turns missing between the least and the greatest), blank, duplicate, truncated (rows by their
    first fault), illegal (neighbouring rows whose roles do not follow each other), cost, audit (one letter an edit), and
    repaired_sha256 (of the repaired rows as role:text lines).  Nulls in conv_id, role and text read as one space,
    in the hash of `conv_id:turn`, too; an empty role has no initial, so its row is never kept as it is; a null turn comes first and is no turn to ``gaps``; all rows without conv_id are one
    conversation, conv_id null.  Rows of one turn are ordered by role, then by digest, so repeated rows are neighbours.
    A conversation without rows has zeros, an empty audit and the hash of nothing.  Bytes that are no UTF-8 read as U+FFFD;
    texts and conversations may be of any length.  Empty tables give no rows; other columns are ignored.
    """
    rows = plain(conversations)
    found = repair(damaged(rows), segment)
    every = rows.select("conv").distinct().join(found, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    shown = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(F.col("conv").try_cast("long").alias("conv_id"), *shown, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
