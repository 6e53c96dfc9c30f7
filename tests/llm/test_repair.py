"""Conversation repair against a search over all sequences of edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from compare import spark_rows, sql_rows
from foliant.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def after_damage(rows):
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k:
            out += [(c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    return out


def direct(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of one conversation's rows, (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        last = WORD.findall(text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None)
        seen.add((role, text))
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, state, inserts):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        forced = "a" if state == "u" else "u"
        if inserts < 3:
            c, s = best(i, forced, inserts + 1)
            found.append((c + 5, "I" + s))
        if i < len(rows):
            c, s = best(i + 1, state, 0)
            found.append((c + 2, "D" + s))
            if faults[i] in (None, "truncated"):
                cut = 5 * (faults[i] == "truncated")
                if (state, rows[i][1][:1]) in follows:
                    c, s = best(i + 1, follows[state, rows[i][1][:1]], 0)
                    found.append((c + cut, "K" + s))
                c, s = best(i + 1, forced, 0)
                found.append((c + cut + 1, "R" + s))
        return min(found, default=(10**6, ""))

    cost, audit = best(0, "", 0)
    i, state, told = 0, "", []
    for e in audit:
        forced = "a" if state == "u" else "u"
        if e == "K":
            told.append(f"{rows[i][1]}:{rows[i][2]}")
            state = rows[i][1][:1]
        elif e in "IR":
            state = forced
            told.append({"u": "user:", "a": "assistant:"}[forced] + (rows[i][2] if e == "R" else ""))
        i += e != "I"
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in told))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest()


def found(spark, rows, parts=3):
    d = spark.createDataFrame(rows, SCHEMA).withColumns({"edit": F.lit("x"), "plan": F.lit(1), "again": F.lit("q")}).repartition(parts)
    return {r.conv_id: tuple(r[1:]) for r in repair.summary(repair.repaired(d)).collect()}


def test_against_sql(spark, sf_dir):
    df = repair.op12_repair(spark, sf_dir)
    columns, want = sql_rows(repair.ORACLE_SQL, sf_dir)
    assert sorted(df.columns) == columns and spark_rows(df) == want


@pytest.mark.parametrize("seed", range(4))
def test_random_conversations(spark, seed):
    r = random.Random(seed)
    text = lambda: r.choice(["Hello.", "Yes!", "cut off", "", " \n", "again.", "why?  ", "日本", "a. b", f"t{r.randrange(9)}."])
    rows = [(c if c else None, r.choice([None, *range(8)]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "unknown"]), text()) for c in range(150) for _ in range(r.randrange(1, 9))]
    want = {}
    for c, *row in rows:
        want.setdefault(c, []).append(tuple(row))
    assert found(spark, rows) == {c: direct(x) for c, x in want.items()}


def test_query_edges(spark, tmp_path):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "assistant", "x."), (2, 5, None, "y"), (3, 0, "user", "One."), (3, 0, "user", "One."), (3, 9, "assistant", None)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"Text {t}.") for c in range(10, 60) for t in range(c % 4)]
    spark.createDataFrame(rows, SCHEMA).withColumns({"gaps": F.lit(7), "own_id": F.lit(1)}).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r[n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in repair.op12_repair(spark, str(tmp_path)).collect()}
    want = {c: [] for c, *_ in rows}
    for c, *row in after_damage(rows):
        want[c].append(tuple(row))
    assert got == {c: direct(x) for c, x in want.items()}
    assert any(not x for x in want.values())


def test_empty_table_and_order(spark):
    assert found(spark, []) == {}
    edits = repair.repaired(spark.createDataFrame([(1, t, "user", f"{t}.") for t in range(50)], SCHEMA))
    assert spark_rows(repair.summary(edits)) == spark_rows(repair.summary(edits.repartition(7, "text"), ordered=False))


def test_one_very_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], "same." if t % 97 == 5 else f"Turn {t}" + "." * (t % 11 != 3)) for t in range(60_000)]
    gaps, blank, duplicate, truncated, illegal, cost, audit, _ = found(spark, rows)[1]
    assert (gaps, blank, duplicate, illegal) == (0, 0, sum(t % 97 == 5 for t in range(60_000)) - 2, 0)
    assert len(audit.replace("I", "")) == 60_000 and cost == sum({"D": 2, "I": 5, "R": 1}.get(e, 0) for e in audit) + 5 * sum(e != "D" and t % 97 != 5 and t % 11 == 3 for t, e in enumerate(audit.replace("I", "")))
    huge = found(spark, [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", " " * 3_000_000)])[1]
    assert huge[:6] == (0, 1, 0, 0, 0, 4) and huge[6] == "DD"
