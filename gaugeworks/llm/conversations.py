"""Conversation structure repair: cheapest edits by one integer minimum per node of a DAG."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from gaugeworks.llm.common import long_id, partitions_for, ship_package, slices, table, text_bytes
from gaugeworks.operators.joins import sized_join
from gaugeworks.session import settle, settle_measured

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Rows whose edits one table of partial results holds: 2**CELL_BITS.
CELL_BITS = 12
#: Characters of a text that order rows of one turn and role, before a digest of all of it.
TIE_CHARS = 64

# Where a repaired conversation can stand: nothing yet, after its system row, after a user
# row, after an assistant row. It may end in _NOTHING or _ANSWERED.
_NOTHING, _SYSTEM, _ASKED, _ANSWERED = range(4)
_PLACES = range(4)
_NEXT = {
    _NOTHING: {"s": _SYSTEM, "u": _ASKED}, _SYSTEM: {"u": _ASKED},
    _ASKED: {"a": _ANSWERED}, _ANSWERED: {"u": _ASKED},
}
_ENDS = (_NOTHING, _ANSWERED)
_ROLES = {"u": "user", "a": "assistant"}
_CODES = {letter: code for code, letter in enumerate("DIKR", 1)}  # in ASCII order, 0 is padding
_LETTERS = {code: letter for letter, code in _CODES.items()}
_BITS = 3


@dataclass(frozen=True)
class Costs:
    """Cost of the edits; an undeleted truncated row adds `truncated`."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self) -> None:
        if self.insert <= 0 or min(self.rerole, self.delete, self.truncated) < 0:
            raise ValueError("an insert must cost something, other edits nothing at least")


@dataclass(frozen=True)
class _Step:
    """Edits that take one row (and inserts before it) from a place to another."""

    start: int
    end: int
    cost: int
    code: int
    letters: int


def _inserts(start: int) -> Iterator[tuple[str, int]]:
    """No, one or two inserts and the place they lead to.

    Three would pass a place twice, and what lies between could be left out at less cost.
    """
    yield "", start
    once = _inserted(start)
    yield INSERT, once
    yield INSERT * 2, _inserted(once)


def _inserted(place: int) -> int:
    return _NEXT[place]["a" if place == _ASKED else "u"]


def _code(letters: str) -> int:
    code = 0
    for letter in letters:
        code = code << _BITS | _CODES[letter]
    return code


@cache
def _steps(initial: str, fault: str, costs: Costs) -> tuple[_Step, ...]:
    """All ways a row of this role initial and fault can be edited, after any inserts."""
    found = []
    extra = costs.truncated if fault == "truncated" else 0
    for start in _PLACES:
        for before, place in _inserts(start):
            paid = costs.insert * len(before)
            ways = [(DELETE, place, costs.delete)]
            if fault not in ("blank", "duplicate"):
                if initial in _NEXT[place]:
                    ways.append((KEEP, _NEXT[place][initial], extra))
                ways.append((REROLE, _inserted(place), costs.rerole + extra))
            found += [
                _Step(start, end, paid + cost, _code(before + letter), len(before) + 1)
                for letter, end, cost in ways
            ]
    return tuple(found)


# A weight is one integer: the cost in the high digits, then `width` digits of _BITS bits with
# the audit letters from the left, padded with zeros. Less is cheaper, then ASCII-least.


def _put_before(step: _Step, weight: int, width: int) -> int:
    """Weight of a step and what follows it, both of `width` digits."""
    bits = _BITS * width
    cost, audit = weight >> bits, weight & ((1 << bits) - 1)
    audit = step.code << (bits - _BITS * step.letters) | audit >> (_BITS * step.letters)
    return (cost + step.cost) << bits | audit


def _letters_of(weight: int, width: int) -> int:
    """Number of letters: digits before the padding."""
    audit = weight & ((1 << (_BITS * width)) - 1)
    if not audit:
        return 0
    return width - ((audit & -audit).bit_length() - 1) // _BITS


def _append(left: int, left_width: int, right: int, right_width: int) -> int:
    """Weight of one run of edits and the next, of both widths' digits."""
    left_bits, right_bits = _BITS * left_width, _BITS * right_width
    audit = (left & ((1 << left_bits) - 1)) << right_bits
    follows = right & ((1 << right_bits) - 1)
    audit |= follows << (left_bits - _BITS * _letters_of(left, left_width))
    return ((left >> left_bits) + (right >> right_bits)) << (left_bits + right_bits) | audit


def audit_of(weight: int, width: int) -> str:
    """The letters of a weight."""
    digits = weight >> (_BITS * (width - _letters_of(weight, width)))
    return "".join(
        _LETTERS[digits >> (_BITS * k) & 7] for k in reversed(range(_letters_of(weight, width)))
    )


Weights = list[list[int | None]]


def run_weights(rows: Sequence[tuple[str, str]], costs: Costs = Costs()) -> tuple[Weights, int]:
    """Least weight of editing a run of (role initial, fault) rows between any two places.

    The nodes of the DAG are (row, place), its arcs the steps. The pass goes from the last
    row back, so a step is put before what follows it: equal costs are decided by the
    letters from the left, and the least weight behind a node is right whatever precedes it.
    """
    width = 3 * len(rows)
    behind: Weights = [[0 if a == b else None for b in _PLACES] for a in _PLACES]
    for initial, fault in reversed(rows):
        before: Weights = [[None] * 4 for _ in _PLACES]
        for step in _steps(initial, fault, costs):
            own = before[step.start]
            for end, weight in enumerate(behind[step.end]):
                if weight is not None:
                    found = _put_before(step, weight, width)
                    if own[end] is None or found < own[end]:
                        own[end] = found
        behind = before
    return behind, width


def join_runs(reached: list[int | None], width: int, run: Weights, run_width: int) -> list[int | None]:
    """Least weight from the start of the conversation to each place behind the next run.

    Of two ways to a place that cost the same neither's letters begin the other's (it would
    have further inserts, which cost), so their order stays whatever follows.
    """
    out: list[int | None] = [None] * 4
    for start, weight in enumerate(reached):
        for end, further in enumerate(run[start]):
            if weight is not None and further is not None:
                found = _append(weight, width, further, run_width)
                if out[end] is None or found < out[end]:
                    out[end] = found
    return out


def close(reached: list[int | None], width: int, costs: Costs = Costs()) -> tuple[int, int]:
    """Least weight of the whole conversation, and its width."""
    found = []
    for start, weight in enumerate(reached):
        for letters, end in _inserts(start):
            if weight is not None and end in _ENDS:
                step = _Step(start, end, costs.insert * len(letters), _code(letters), len(letters))
                found.append(_append(weight, width, _put_before(step, 0, 2), 2))
    return min(found), width + 2


def _to_bytes(weight: int | None) -> bytes | None:
    return None if weight is None else weight.to_bytes((weight.bit_length() + 7) // 8, "big")


def _runs(batches: Iterable[pa.RecordBatch], *key: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Consecutive rows of equal key; batches are read one at a time."""
    rows = (row for batch in slices(batches, 4096) for row in batch.to_pylist())
    return groupby(rows, key=lambda row: tuple(row[name] for name in key))


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


_FAULTS = ("blank", "duplicate", "truncated")
_SUMMED = ("n", *_FAULTS, "illegal")
_RUN = pa.schema([
    *((name, pa.int64()) for name in ("conv", "start", *_SUMMED, "least", "most", "turns")),
    ("first", pa.string()), ("last", pa.string()), ("weights", pa.list_(pa.binary())),
])
_EDIT = pa.struct([("at", pa.int64()), ("place", pa.int32()), ("edit", pa.string()), ("new_role", pa.string())])
_TOTAL = pa.struct([*((name, pa.int64()) for name in ("gaps", *_FAULTS, "illegal", "cost")), ("audit", pa.string())])
_SOLVED = pa.schema([("conv", pa.int64()), ("edits", pa.list_(_EDIT)), ("total", _TOTAL)])


def _summed_runs(batches: Iterable[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    """One row per conversation of each cell: counts, both ends, and the run's least weights."""
    out = []
    for (_, conv), group in _runs(batches, "cell", "conv"):
        rows = list(group)  # a cell's rows at most
        initials = [r["initial"] for r in rows]
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        weights, _ = run_weights([(r["initial"], r["fault"]) for r in rows], costs)
        out.append({
            "conv": conv, "start": rows[0]["at"], "n": len(rows),
            **{name: sum(r["fault"] == name for r in rows) for name in _FAULTS},
            "illegal": sum(not _legal(a, b) for a, b in pairwise(initials)),
            "least": min(turns, default=None), "most": max(turns, default=None), "turns": len(set(turns)),
            "first": initials[0], "last": initials[-1],
            "weights": [_to_bytes(w) for row in weights for w in row],
        })
        if len(out) >= 256:
            yield pa.RecordBatch.from_pylist(out, _RUN)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _RUN)


def _edits_of_run(audit: str, at: int, start: int, n: int, closes: bool, made: int, odd: int) -> tuple[list[dict], int, int]:
    """Edits of a run's rows from position `at` of the audit; the next position, and rows made.

    Inserts stand before their row, those at the very end behind the last one. A row made
    is user's or assistant's by its number, since only a kept system row can precede them.
    """
    edits, row, place = [], 0, 0
    while at < len(audit) and (row < n or closes):
        letter = audit[at]
        role = None if letter in (KEEP, DELETE) else _ROLES["ua"[(made - odd) % 2]]
        edits.append({"at": start + min(row, n - 1), "place": place, "edit": letter, "new_role": role})
        made += letter != DELETE
        place += 1
        if letter != INSERT:
            row += 1
            place = 0 if row < n else place
        at += 1
    return edits, at, made


def _solutions(batches: Iterable[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    """Chain each conversation's runs: the edits of each, and with the last one the totals.

    Of a conversation one run at a time is read; what grows with it are four weights, the
    audit and three numbers per run.
    """
    out: list[dict] = []
    held = 0
    for (conv,), group in _runs(batches, "conv"):
        reached: list[int | None] = [0, None, None, None]
        width, runs = 0, []
        total, turns, least, most, last = Counter(), 0, None, None, None
        for run in group:
            weights = [None if w is None else int.from_bytes(w, "big") for w in run["weights"]]
            reached = join_runs(reached, width, [weights[i : i + 4] for i in range(0, 16, 4)], 3 * run["n"])
            width += 3 * run["n"]
            runs.append((run["start"], run["n"]))
            total.update({name: run[name] for name in _SUMMED})
            total["illegal"] += last is not None and not _legal(last, run["first"])
            turns += run["turns"] - (most is not None and most == run["least"])
            least = run["least"] if least is None else least
            most = most if run["most"] is None else run["most"]
            last = run["last"]
        weight, width = close(reached, width, costs)
        audit = audit_of(weight, width)
        at = made = 0
        odd = (len(audit) - audit.count(DELETE)) % 2
        for number, (start, n) in enumerate(runs, 1):
            edits, at, made = _edits_of_run(audit, at, start, n, number == len(runs), made, odd)
            out.append({"conv": conv, "edits": edits, "total": None})
            held += len(edits)
            if number == len(runs):
                gaps = 0 if least is None else most - least + 1 - turns
                cost = weight >> (_BITS * width)
                out[-1]["total"] = {"gaps": gaps, **{k: total[k] for k in (*_FAULTS, "illegal")}, "cost": cost, "audit": audit}
            if held >= 8192:
                yield pa.RecordBatch.from_pylist(out, _SOLVED)
                out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, _SOLVED)


@dataclass(frozen=True)
class Repair:
    """Edited rows, and one row of figures per conversation."""

    rows: DataFrame
    conversations: DataFrame


def repair_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    costs: Costs = Costs(),
) -> Repair:
    """Cheapest repair of every conversation to an optional system row and user-assistant pairs.

    Rows are taken by turn, nulls first, then role, the text's first TIE_CHARS characters and
    a digest of the rest. Faults are blank (nothing but
    ASCII white space), duplicate (role and text seen earlier) and truncated (the last
    character is none of `.!?`), the first that holds. Edits are keep, rerole to user or
    assistant, delete (a must for blank and duplicate rows) and insert; of equal costs the
    audit, the edits' letters in order, that is least in ASCII. A role counts by its first
    letter; rows whose role begins otherwise cannot be kept.

    `rows` has conv, at and place (their order), edit, role and text after it; deleted rows
    are listed with their old role and text, inserted ones have an empty text.
    `conversations` has conv, gaps, blank, duplicate, truncated, illegal, cost and audit.

    Equal rows are counted before they move and numbered afterwards; a sort by range deals
    the rows out, so a conversation may span many tasks. Cells of 2**CELL_BITS consecutive
    rows are solved apart, between every two places a conversation can stand at, and these
    tables are chained per conversation. The audit of a conversation is one string and as
    long as the conversation, so this last step is one task's for each of them.

    Null roles and texts count as one space, so such a text is blank; null turns come first
    and count neither for gaps nor as a turn; rows without a conversation id form one
    conversation. An empty table gives empty ones. Other columns, whatever their names, are
    left out.
    """
    spark = df.sparkSession
    ship_package(spark)
    own = df.select(
        long_id(df, conv).alias("conv"), long_id(df, turn).alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"),
    )
    own = own.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    name = F.concat_ws(":", F.col("conv").cast("string"), F.col("conv").isNull().cast("string"), F.length("role"))
    own = own.withColumn("key", F.sha2(F.concat(name, F.lit(":"), "role", "text"), 256))
    body = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    own = settle(own.withColumn("is_blank", body == "").withColumn("is_ended", F.right(body, F.lit(1)).isin(".", "!", "?")))
    met = own.where(~F.col("is_blank")).groupBy("key").agg(F.min(when).alias("met"), F.count(F.lit(1)).alias("times"))
    own = sized_join(own, settle(met.where("times > 1").select("key", "met")), ["key"], "left")
    own = own.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    again = (F.col("copy") > 1) | F.coalesce(when > F.col("met"), F.lit(False))
    fault = F.when(F.col("is_blank"), "blank").when(again, "duplicate").when(~F.col("is_ended"), "truncated").otherwise("")
    own = own.select(
        "conv", "turn", "role", "text", F.left("text", F.lit(TIE_CHARS)).alias("head"), "key", "copy", fault.alias("fault")
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "head", "key", "copy"]
    parts = partitions_for(spark, text_bytes(own))
    own, seen = settle_measured(
        own.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()).drop("head", "key", "copy"),
        n=F.count(F.lit(1)),
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), seen["n"] >> 17)
    cells = own.select(
        F.shiftright("at", CELL_BITS).alias("cell"), "at", "conv", "turn", F.left("role", F.lit(1)).alias("initial"), "fault"
    ).repartition(tasks, "cell").sortWithinPartitions("cell", "at")
    runs = cells.mapInArrow(lambda batches: _summed_runs(batches, costs), from_arrow_schema(_RUN))
    runs = runs.repartition(tasks, "conv").sortWithinPartitions("conv", "start")
    solved = settle(runs.mapInArrow(lambda batches: _solutions(batches, costs), from_arrow_schema(_SOLVED)))
    edits = solved.select("conv", F.inline("edits"))
    edited = edits.join(own.select("at", "role", "text"), "at", "left").select(
        "conv", "at", "place", "edit",
        F.coalesce("new_role", "role").alias("role"),
        F.when(F.col("edit") == INSERT, "").otherwise(F.col("text")).alias("text"),
    )
    return Repair(edited, solved.where("total is not null").select("conv", "total.*"))


def conversation_digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's `role:text` lines that are not deleted: conv, sha256.

    A digest goes over a conversation from its first byte to the last; the rows stream past
    it in order, whatever their number.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), group in _runs(batches, "conv"):
            digest, between = hashlib.sha256(), b""
            for row in group:
                digest.update(between + row["role"].encode("utf-8", "replace") + b":")
                digest.update(row["text"].encode("utf-8", "replace"))
                between = b"\n"
            yield pa.RecordBatch.from_pydict({"conv": pa.array([conv], pa.int64()), "sha256": [digest.hexdigest()]})

    kept = rows.where(F.col("edit") != DELETE)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept.repartition(tasks, "conv").sortWithinPartitions("conv", "at", "place").mapInArrow(run, "conv long, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated or given to the user, by crc32."""
    shown = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.withColumn("kind", kind).where("kind <> 0").select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repair = repair_conversations(damaged(rows))
    named = rows.select(long_id(rows, "conv_id").alias("conv_id")).distinct()
    found = named.join(repair.conversations, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    digests = conversation_digests(repair.rows)
    found = found.join(digests, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    zero = [F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in ("gaps", *_FAULTS, "illegal", "cost")]
    return found.select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLE: dict[str, str] = {}
