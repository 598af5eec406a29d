"""Merging of roles: an ordered fold over each entity's roles.

The fold is neither associative nor commutative (a merged role has other fields
than those it came from), so it runs over whole entities, in order, in Python.
``fold`` says what it does; ``merge_roles`` does the same for many entities at a time.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import AS_OF, COMPANY_WORDS, MERGE_BONUS, PRESENT

_SUFFIX = re.compile(r"\b(" + "|".join(COMPANY_WORDS) + r")\b", re.IGNORECASE)
ROLE_COLUMNS = "entity_id string, ord bigint, company string, title string, start string, end string, summary string, concurrent boolean, sources array<string>, confidence double"


def months(date: str | None, as_of: str = AS_OF) -> int:
    """The month index of a role's date; as_of for the present and for what cannot be read."""
    now = int(as_of[:4]) * 12 + int(as_of[5:7])
    if not date or date.lower() in PRESENT:
        return now
    year, _, month = date.partition("-")
    try:
        return int(year) * 12 + (int(month.split("-")[0]) if month else 1)
    except ValueError:
        return now


def _bare(company: str) -> str:
    return _SUFFIX.sub("", company).strip().lower()


def same_role(a: dict, b: dict, as_of: str = AS_OF) -> bool:
    """Companies that contain one another, and date ranges at most one month apart."""
    if not (a["company"] and b["company"]):
        return False
    x, y = _bare(a["company"]), _bare(b["company"])
    near = months(a["start"], as_of) <= months(b["end"], as_of) + 1 and months(b["start"], as_of) <= months(a["end"], as_of) + 1
    return near and (x in y or y in x)


def merged(old: dict, new: dict) -> dict:
    """One role from two: the longer names, the first dates, both summaries, all sources, a bonus."""
    longer = {k: max((old[k] or "", new[k] or ""), key=len) or None for k in ("company", "title")}
    texts = list(dict.fromkeys(s for s in (old["summary"], new["summary"]) if s))
    return longer | {
        "start": old["start"] or new["start"], "end": old["end"] or new["end"], "summary": " | ".join(texts) or None, "concurrent": bool(old["concurrent"] or new["concurrent"]),
        "sources": sorted({*old["sources"], *new["sources"]}), "confidence": min(1.0, max(old["confidence"], new["confidence"]) + MERGE_BONUS),
    }


def fold(roles: list[dict], as_of: str = AS_OF) -> list[dict]:
    """Merge each role into the first that it matches; mark overlaps; latest start first."""
    out: list[dict] = []
    for role in roles:
        at = next((i for i, r in enumerate(out) if same_role(role, r, as_of)), None)
        if at is None:
            out.append(dict(role))
        else:
            out[at] = merged(out[at], role)
    spans = [(months(r["start"], as_of), months(r["end"], as_of)) for r in out]
    for i, (s, e) in enumerate(spans):
        out[i]["concurrent"] = bool(out[i]["concurrent"]) or any(i != j and s <= f and t <= e for j, (t, f) in enumerate(spans))
    return [out[i] for i in sorted(range(len(out)), key=lambda i: (-spans[i][0], i))]


def _per_value(column: pa.ChunkedArray, of) -> tuple[list, np.ndarray]:
    """A function of each distinct value, and each row's number among them."""
    values = column.combine_chunks().dictionary_encode("encode")
    return [of(v) for v in values.dictionary.to_pylist()], values.indices.to_numpy()


def _groups(rows: pa.Table, ends: list[int], as_of: str) -> tuple[list[list[int]], list[int]]:
    """The rows that become one role, for each role in the order of ``fold``'s list, and where each entity's roles end.

    Companies and months are read once for each distinct value; only a merge looks at the texts again.
    """
    names, name = _per_value(rows["company"], lambda c: c or "")
    bares = [_bare(c) for c in names]
    firsts, first = _per_value(rows["start"], lambda d: (months(d, as_of), bool(d)))
    lasts, last = _per_value(rows["end"], lambda d: (months(d, as_of), bool(d)))
    name, first, last = name.tolist(), first.tolist(), last.tolist()
    out: list[list[int]] = []
    cuts, lo = [], 0
    for hi in ends:
        # Of each kept role: company, its bare name, months and whether they were given, rows.
        company, bare, start, end, opened, closed, members = [], [], [], [], [], [], []
        for i in range(lo, hi):
            c, (s, some), (e, over) = name[i], firsts[first[i]], lasts[last[i]]
            x, soon, late = bares[c], s - 1, e + 1
            found = -1
            if names[c]:
                for k, t in enumerate(start):
                    if t <= late and soon <= end[k] and names[company[k]] and (x in bare[k] or bare[k] in x):
                        found = k
                        break
            if found < 0:
                company.append(c)
                bare.append(x)
                start.append(s)
                end.append(e)
                opened.append(some)
                closed.append(over)
                members.append([i])
                continue
            members[found].append(i)
            if len(names[c]) > len(names[company[found]]):
                company[found], bare[found] = c, x
            if not opened[found]:
                start[found], opened[found] = s, some
            if not closed[found]:
                end[found], closed[found] = e, over
        out += members
        cuts.append(len(out))
        lo = hi
    return out, cuts


def _overlapping(entity: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether each span (of numbers from 0) meets another of its entity; ``entity`` ascends.

    Of the spans that start by a span's end, in order of their starts, the largest
    end but its own must reach its start.
    """
    at = entity * (max(s.max(), e.max()) + 1)
    order = np.argsort(at + s, kind="stable")
    starts, ends = (at + s)[order], (at + e)[order]
    # Sums with the entity's number ascend from entity to entity, so running maxima need no reset.
    best = np.maximum.accumulate(ends)
    second = np.maximum.accumulate(np.append(-1, np.minimum(best[:-1], ends[1:])))
    upto = np.searchsorted(starts, at + e, "right") - 1
    none = upto < 0
    upto[none] = 0
    reach = np.where((s <= e) & (at + e == best[upto]), second[upto], best[upto])
    return (reach >= at + s) & ~none


def _folded(rows: pa.Table, ends: list[int], as_of: str) -> pa.RecordBatch:
    """``fold`` of each of many whole entities, whose rows end at ``ends``."""
    groups, cuts = _groups(rows, ends, as_of)
    many = [g for g in groups if len(g) > 1]
    row = np.array([g[0] for g in groups])
    if many:
        # Merged roles stand after all others.
        dicts = iter(rows.take([i for g in many for i in g]).to_pylist())
        made = [functools.reduce(merged, [next(dicts) for _ in g]) | {"entity_id": None, "ord": None} for g in many]
        row[[k for k, g in enumerate(groups) if len(g) > 1]] = np.arange(len(rows), len(rows) + len(many))
        firsts = rows.take([g[0] for g in many])
        made = pa.Table.from_pylist(made, rows.schema).set_column(0, rows.schema.field(0), firsts["entity_id"])
        rows = pa.concat_tables([rows, made])
    rows = rows.take(row)
    sizes = np.diff([0, *cuts])
    entity = np.repeat(np.arange(len(cuts)), sizes)
    firsts, first = _per_value(rows["start"], lambda d: months(d, as_of))
    lasts, last = _per_value(rows["end"], lambda d: months(d, as_of))
    # Months by their order, as a year may be any number.
    order = {m: i for i, m in enumerate(sorted({*firsts, *lasts}))}
    start, end = np.array([order[m] for m in firsts])[first], np.array([order[m] for m in lasts])[last]
    both = rows["concurrent"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool) | _overlapping(entity, start, end)
    rows = rows.set_column(rows.schema.get_field_index("concurrent"), "concurrent", pa.array(both))
    number = np.arange(len(entity)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows = rows.set_column(1, "ord", pa.array(number))
    return rows.take(np.lexsort((number, -start, entity))).set_column(1, "ord", pa.array(number)).combine_chunks().to_batches()[0]


def merge_roles(roles: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Merged roles of every entity; ``ord`` is their new order from 0.  One entity's roles must fit one task.

    Entities come in order, many at a time; one that goes on in the next batch waits for it.
    """
    names = [f.split()[0] for f in ROLE_COLUMNS.split(", ")]

    def run(batches):
        waiting: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            codes = table["entity_id"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            ends = (np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()
            if waiting and waiting[0]["entity_id"][0] != table["entity_id"][0]:
                whole = pa.concat_tables(waiting).combine_chunks()
                yield _folded(whole, [len(whole)], as_of)
                waiting = []
            if not ends:
                waiting.append(table)
                continue
            held = sum(map(len, waiting))
            whole = pa.concat_tables([*waiting, table.slice(0, ends[-1])]).combine_chunks()
            yield _folded(whole, [held + x for x in ends], as_of)
            waiting = [table.slice(ends[-1])]
        if waiting:
            whole = pa.concat_tables(waiting).combine_chunks()
            yield _folded(whole, [len(whole)], as_of)

    filled = {"concurrent": F.coalesce("concurrent", F.lit(False)), "sources": F.coalesce("sources", F.array().cast("array<string>"))}
    dealt = roles.select(*names).withColumns(filled).repartition("entity_id").sortWithinPartitions("entity_id", F.col("ord").asc_nulls_last())
    return dealt.mapInArrow(run, ROLE_COLUMNS)


def experience_provenance(merged_roles: DataFrame) -> DataFrame:
    """``entity_id, winning_source, winning_confidence, merged_count``."""
    return merged_roles.groupBy("entity_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))), ", ").alias("winning_source"), F.max("confidence").alias("winning_confidence"), F.count("*").alias("merged_count"))


