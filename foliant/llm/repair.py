"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

A conversation is well formed if its roles' initials read `(s?(ua)+)?`: nothing, or an optional system turn and then pairs of user and assistant.
Edits are Delete, Insert (an empty turn), Keep and Rerole. The cheapest sequence of edits comes from two walks over the sorted turns.
The first goes backward and holds, for each state of the grammar, the least cost from there to the end; for each row it leaves which edit
to take in each state (the ASCII-least of those that keep the total least). The second goes forward, follows these choices from the start,
and writes the edits. Either walk holds four numbers and one row, whatever the length of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_slices, table

#: Costs of the edits, and of keeping or reroling a turn that was cut off.
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: States of the grammar are the last initial written: none, s, u, a. What may follow, and what an inserted or reroled turn becomes.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_FORCED = (2, 2, 3, 2)
_ROLE = ("", "system", "user", "assistant")
_LEGAL = frozenset(("su", "ua", "au"))
_WHITE = r"\x20\x09-\x0D"

EDITS = "conv_id long, position long, edit string, cost int, turn long, was string, fault string, role string, text string"


def _relaxed(values: list[int]) -> list[int]:
    """Values of the states once turns may be inserted first."""
    user, assistant = min(values[2], INSERT + values[3]), min(values[3], INSERT + values[2])
    return [min(values[0], INSERT + user), min(values[1], INSERT + user), user, assistant]


#: Cost from each state after the last row: only the first and the last may end.
END = tuple(_relaxed([0, 1 << 30, 1 << 30, 0]))


def step(initial: str, fault: str | None, ahead: tuple[int, ...]) -> tuple[str, tuple[int, ...]]:
    """(edit to take in each state, least cost from each state) at a row, given the costs after it. Costs count from the least of them, so that few
    different ones occur."""
    cut = CUT if fault == "truncated" else 0
    costs: list[dict[str, int]] = []
    for q in range(4):
        own = {"D": DELETE + ahead[q]}
        if fault in (None, "truncated"):
            if initial in _NEXT[q]:
                own["K"] = cut + ahead[_NEXT[q][initial]]
            own["R"] = REROLE + cut + ahead[_FORCED[q]]
        costs.append(own)
    values = _relaxed([min(c.values()) for c in costs])
    for q, own in enumerate(costs):
        own["I"] = INSERT + values[_FORCED[q]]
    plan = "".join(min(e for e, cost in own.items() if cost == values[q]) for q, own in enumerate(costs))
    least = min(values)
    return plan, tuple(v - least for v in values)


def faults(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text, ..) with the first fault of each row, or null: blank (no character but white space), duplicate (the role and
    text of an earlier row), truncated (the last character that is not white space is none of `.!?`). Null roles and texts count as one space;
    rows stand by turn, null first, then role and text."""
    own = turns.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))}).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(~F.col("text").rlike(f"[^{_WHITE}]"), "blank").when(F.col("again") > 1, "duplicate").when(~F.col("text").rlike(rf"[.!?][{_WHITE}]*\z"), "truncated")
    return own.withColumn("again", again).withColumn("fault", fault)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of the batches, some at a time."""
    for whole in batches:
        for b in row_slices(whole, 2000):
            yield list(zip(*(c.to_pylist() for c in b.columns)))


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])


_ROW = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("again", pa.int32()), ("fault", pa.string())]
_EDIT = [("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("cost", pa.int32()), ("turn", pa.int64()), ("was", pa.string()), ("fault", pa.string()), ("role", pa.string()), ("text", pa.string())]


def repaired(turns: DataFrame) -> DataFrame:
    """The edits that repair each conversation of turns(conv_id, turn, role, text, ..), cheapest in all and ASCII-least among those.

    One row an edit: conv_id, position (from 0), edit (D, I, K, R), cost, turn, was (the role before), fault, role and text (after). Rows
    whose edit is not D are, in order, the repaired conversation. Null ids are one conversation; repeated rows are duplicates; an empty table
    gives no row; other columns are left behind. Conversations are dealt by conv_id and sorted twice there, last turn first for the walk
    backward and first turn first for the walk forward; both sorts spill. A conversation is one task's stream, never its list.
    """
    own = faults(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    order = ["turn", "role", "text", "again"]

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ahead = object(), END
        known: dict[tuple, tuple[str, tuple[int, ...]]] = {}
        for rows in _groups(batches):
            out = []
            for row in rows:
                if row[0] != current:
                    current, ahead = row[0], END
                case = (row[2][:1], row[5], ahead)
                if case not in known:
                    known = known if len(known) < 1 << 14 else {}
                    known[case] = step(*case)
                plan, ahead = known[case]
                out.append((*row, plan))
            yield _batch(out, [*_ROW, ("plan", pa.string())])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, q, at = object(), 0, 0
        for rows in _groups(batches):
            out = []

            def put(edit: str, cost: int, turn, was, fault, role, text) -> None:
                nonlocal at
                out.append((current, at, edit, cost, turn, was, fault, role, text))
                at += 1

            def inserted() -> None:
                nonlocal q
                q = _FORCED[q]
                put("I", INSERT, None, None, None, _ROLE[q], "")

            for conv_id, turn, role, text, _, fault, plan in rows:
                if conv_id != current:
                    while q in (1, 2):
                        inserted()
                    current, q, at = conv_id, 0, 0
                while plan[q] == "I":
                    inserted()
                edit, cut = plan[q], CUT * (fault == "truncated")
                if edit == "D":
                    put("D", DELETE, turn, role, fault, role, text)
                elif edit == "K":
                    q = _NEXT[q][role[:1]]
                    put("K", cut, turn, role, fault, role, text)
                else:
                    q = _FORCED[q]
                    put("R", REROLE + cut, turn, role, fault, _ROLE[q], text)
            yield _batch(out, _EDIT)
        out = []
        while q in (1, 2):
            q = _FORCED[q]
            out.append((current, at, "I", INSERT, None, None, None, _ROLE[q], ""))
            at += 1
        yield _batch(out, _EDIT)

    planned = own.sortWithinPartitions("conv_id", *(F.desc_nulls_last(c) for c in order)).mapInArrow(backward, "conv_id long, turn long, role string, text string, again int, fault string, plan string")
    return planned.sortWithinPartitions("conv_id", *(F.asc_nulls_first(c) for c in order)).mapInArrow(forward, EDITS)


def summary(edits: DataFrame, ordered: bool = True) -> DataFrame:
    """One row a conversation: faults before the repair, its cost and audit, and the hash of the repaired turns, `role:text` joined by line feeds.

    ordered: the edits stand as repaired() returns them, a conversation's together and by position; others are dealt and sorted first. Turns are
    read one by one into the hash."""
    if not ordered:
        edits = edits.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    kinds = [("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = object(), None

        def ended() -> list[tuple]:
            if held is None:
                return []
            gaps = held["last"] - held["first"] + 1 - held["turns"] if held["turns"] else 0
            return [(current, gaps, held["blank"], held["duplicate"], held["truncated"], held["illegal"], held["cost"], held["audit"].decode(), held["hash"].hexdigest())]

        for rows in _groups(batches):
            out = []
            for conv_id, _, edit, cost, turn, was, fault, role, text in rows:
                if conv_id != current:
                    out += ended()
                    current, held = conv_id, {"first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": bytearray(), "hash": hashlib.sha256(), "was": None, "any": False}
                held["audit"] += edit.encode()
                held["cost"] += cost
                if edit != "I":
                    if turn is not None and turn != held["last"]:
                        held["turns"] += 1
                        held["first"], held["last"] = turn if held["first"] is None else held["first"], turn
                    if fault:
                        held[fault] += 1
                    if held["was"] is not None and held["was"] + was[:1] not in _LEGAL:
                        held["illegal"] += 1
                    held["was"] = was[:1]
                if edit != "D":
                    held["hash"].update(f"{chr(10) if held['any'] else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    held["any"] = True
            yield _batch(out, kinds)
        yield _batch(ended(), kinds)

    return edits.mapInArrow(work, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with the damage that the CRC-32 of `conv_id:turn` picks for each row, null being one space: out of twenty,
    0 drops it, 1 empties its text, 2 removes the text's `.!?`, 3 repeats it, 4 makes its role user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    own = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text: Column = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return own.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = summary(repaired(damaged(turns)))
    ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    nothing = {n: F.coalesce(n, F.lit(0).cast("long")) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}
    out = ids.join(found.withColumnRenamed("conv_id", "own_id"), F.col("conv_id").eqNullSafe(F.col("own_id")), "left").drop("own_id")
    return out.withColumns(nothing)


ORACLE_SQL = r"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
bits AS (SELECT *, list_prepend(4294967295, list_transform(range(0, 8 * length(k)), lambda i: CAST((ascii(k[CAST(i // 8 + 1 AS INT):CAST(i // 8 + 1 AS INT)]) >> CAST(i % 8 AS INT)) & 1 AS BIGINT))) AS b FROM source),
kinds AS (
  SELECT *, xor(list_reduce(b, lambda x, y: CASE WHEN xor(x, y) & 1 = 1 THEN xor(xor(x, y) >> 1, 3988292384) ELSE xor(x, y) >> 1 END), 4294967295) % 20 AS kind FROM bits),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, c
  FROM kinds, (VALUES (1), (2)) copies(c) WHERE kind <> 0 AND (c = 1 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, c) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, c) AS again FROM damaged),
turns AS (
  SELECT *, left(role, 1) AS r, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    regexp_matches(text, '[^\x20\x09-\x0D]') AND again > 1 AS dup,
    regexp_matches(text, '[^\x20\x09-\x0D]') AND again = 1 AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM placed),
costs AS (SELECT *, CASE WHEN blank OR dup THEN 1000000 ELSE 0 END + CASE WHEN cut THEN 5 ELSE 0 END AS held FROM turns),
back AS (
  SELECT DISTINCT conv_id, n + 1 AS i, 0 AS c0, 10 AS cs, 5 AS cu, 0 AS ca, '' AS p0, '' AS ps, '' AS pu, '' AS pa FROM costs
  UNION ALL
  SELECT conv_id, i, v0, vs, vu, va,
    CASE WHEN 2 + c0 = v0 THEN 'D' WHEN 5 + vu = v0 THEN 'I' WHEN k0 = v0 THEN 'K' ELSE 'R' END, CASE WHEN 2 + cs = vs THEN 'D' WHEN 5 + vu = vs THEN 'I' WHEN ks = vs THEN 'K' ELSE 'R' END,
    CASE WHEN 2 + cu = vu THEN 'D' WHEN 5 + va = vu THEN 'I' WHEN ku = vu THEN 'K' ELSE 'R' END, CASE WHEN 2 + ca = va THEN 'D' WHEN 5 + vu = va THEN 'I' WHEN ka = va THEN 'K' ELSE 'R' END
  FROM (SELECT *, least(b0, 5 + vu) AS v0, least(bs, 5 + vu) AS vs FROM (SELECT *, least(bu, 5 + ba) AS vu, least(ba, 5 + bu) AS va FROM (
    SELECT *, least(2 + c0, k0, 1 + held + cu) AS b0, least(2 + cs, ks, 1 + held + cu) AS bs, least(2 + cu, ku, 1 + held + ca) AS bu, least(2 + ca, ka, 1 + held + cu) AS ba FROM (
      SELECT t.conv_id, t.i, t.held, c0, cs, cu, ca,
        held + CASE t.r WHEN 's' THEN cs WHEN 'u' THEN cu ELSE 2000000 END AS k0, held + CASE t.r WHEN 'u' THEN cu ELSE 2000000 END AS ks,
        held + CASE t.r WHEN 'a' THEN ca ELSE 2000000 END AS ku, held + CASE t.r WHEN 'u' THEN cu ELSE 2000000 END AS ka
      FROM back JOIN costs t ON t.conv_id IS NOT DISTINCT FROM back.conv_id AND t.i = back.i - 1))))),
walk AS (
  SELECT DISTINCT conv_id, CAST(1 AS BIGINT) AS i, '0' AS q, '' AS audit, CAST([] AS VARCHAR[]) AS told, 0 AS cost, n FROM costs
  UNION ALL
  SELECT conv_id, i + CASE WHEN e = 'I' THEN 0 ELSE 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN r ELSE f END, audit || e,
    CASE e WHEN 'D' THEN told WHEN 'I' THEN list_append(told, fr || ':') WHEN 'K' THEN list_append(told, role || ':' || text) ELSE list_append(told, fr || ':' || text) END,
    cost + CASE e WHEN 'D' THEN 2 WHEN 'I' THEN 5 WHEN 'K' THEN held ELSE 1 + held END, n
  FROM (
    SELECT w.*, t.role, t.text, t.r, t.held, CASE WHEN q = 'u' THEN 'a' ELSE 'u' END AS f, CASE WHEN q = 'u' THEN 'assistant' ELSE 'user' END AS fr,
      CASE WHEN w.i > w.n THEN CASE WHEN q IN ('s', 'u') THEN 'I' END ELSE CASE q WHEN '0' THEN p0 WHEN 's' THEN ps WHEN 'u' THEN pu ELSE pa END END AS e
    FROM walk w LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i LEFT JOIN costs t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i) WHERE e IS NOT NULL),
done AS (SELECT conv_id, audit, told, cost FROM walk WHERE i > n AND q IN ('0', 'a')),
pairs AS (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM turns),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
    count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(told, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
