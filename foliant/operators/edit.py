"""Edits against a frozen original: which paragraphs correspond, and what the edited text takes over from the original."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

_HIDDEN = re.compile("[\\s\ufffc]")


def _shown(text: str) -> str:
    return _HIDDEN.sub("", text)


def _names(frozen: str) -> set[str]:
    """What an edit may show of a paragraph that it leaves as it is: all of it or, of several lines, the first."""
    return {_shown(frozen), _shown(frozen.split("\n")[0])} - {""}


def anchors(frozen: list[str], typed: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of visible paragraphs that an edit left as they are. Of each original the matching places are taken from
    the last to the first, and a longest rising run of places is kept, as tails that can't be lower and links back from them."""
    places: dict[str, list[int]] = defaultdict(list)
    for j, text in enumerate(typed):
        places[_shown(text)].append(j)
    tails: list[int] = []
    chains: list[tuple[int, int, tuple | None]] = []
    for i, text in enumerate(frozen):
        for j in sorted({j for name in _names(text) for j in places.get(name, ())}, reverse=True):
            rank = bisect_left(tails, j)
            chain = (i, j, chains[rank - 1] if rank else None)
            tails[rank : rank + 1], chains[rank : rank + 1] = [j], [chain]
    out, chain = [], chains[-1] if chains else None
    while chain:
        out.append(chain[:2])
        chain = chain[2]
    return out[::-1]


def _stretches(texts: list[str], start: int, stop: int) -> tuple[list[int], list[list[int]]]:
    """Places of the visible paragraphs of a stretch, and of the blank ones before each of them and after the last."""
    visible: list[int] = []
    blank: list[list[int]] = [[]]
    for i in range(start, stop):
        if _shown(texts[i]):
            visible.append(i)
            blank.append([])
        else:
            blank[-1].append(i)
    return visible, blank


def align(frozen: list[str], typed: list[str]) -> list[tuple[int | None, int | None]]:
    """Pairs (frozen, typed) in the edited order.

    What the edit left as it is stands in anchors(). Between two anchors the visible paragraphs are rewritten one for one, in order:
    further originals were deleted and aren't listed, further typed ones are new (frozen None). A blank original goes with a blank at
    the same place, or is put back (typed None); a deleted original takes a blank left there. Nothing is put back after the last of
    the typed text once originals are deleted."""
    out: list[tuple[int | None, int | None]] = []
    ends = [(-1, -1), *anchors(frozen, typed), (len(frozen), len(typed))]
    for (i0, j0), (i1, j1) in zip(ends, ends[1:]):
        old, old_blank = _stretches(frozen, i0 + 1, i1)
        new, new_blank = _stretches(typed, j0 + 1, j1)
        for k in range(max(len(old_blank), len(new_blank))):
            was, now = (x[k] if k < len(x) else [] for x in (old_blank, new_blank))
            out += zip(was, now)
            out += [(i, None) for i in was[len(now) :]]
            spare = now[len(was) :]
            if k < len(old) and k >= len(new) and spare:
                out.append((old[k], spare.pop(0)))
            out += [(None, j) for j in spare]
            if k < len(new):
                out.append((old[k] if k < len(old) else None, new[k]))
            elif k < len(old) and i1 == len(frozen) and not any(new_blank[k:]):
                return out
        if i1 < len(frozen):
            out.append((i1, j1))
    return out


def merged(frozen: DataFrame, typed: DataFrame) -> DataFrame:
    """(section, seq, text, style_id, page_break, origin) of frozen and typed(section, seq, text, style_id, page_break).

    A pair keeps the typed text, or the whole original if that was cut at a line break, and takes over the original's style where it has
    none of its own, and its page break. A longest common subsequence needs both sides whole, so a section is one task; sections are independent."""

    def work(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        f, t = (sorted(x.to_pylist(), key=lambda r: r["seq"]) for x in (a, b))
        section = key[0].as_py()
        rows = []
        for n, (i, j) in enumerate(align([r["text"] or "" for r in f], [r["text"] or "" for r in t])):
            old, new = f[i] if i is not None else None, t[j] if j is not None else None
            one = dict(new or old)
            if old and new:
                if "\n" in (old["text"] or "") and _shown(new["text"] or "") == _shown(old["text"].split("\n")[0]):
                    one["text"] = old["text"]
                one["style_id"] = new["style_id"] or old["style_id"]
                one["page_break"] = bool(new["page_break"] or old["page_break"])
            rows.append((section, n, one["text"], one["style_id"], one["page_break"], None if old is None else old["seq"]))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.int32())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=["section", "seq", "text", "style_id", "page_break", "origin"])

    return frozen.groupBy("section").cogroup(typed.groupBy("section")).applyInArrow(work, "section string, seq int, text string, style_id int, page_break boolean, origin int")
