"""Repair of conversations: the cheapest edits that let user and assistant take turns.

A conversation is cut into blocks of rows. Each block is searched by iterative deepening A*: depth first in the order of the
edits' letters, under a cost bound that rises until a path is accepted. A table of failed states (row, state, cost left) keeps a
search from entering a state again with no more to spend. Blocks are searched for every state they may begin and end in, so the
conversations with many blocks are searched block by block side by side; two passes over one short row per block put them together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.plans.session import ship_package, written

#: Rows of one block at most; blocks are cut by 2**BLOCK_BITS rows of a sorted task.
BLOCK_BITS = 6

#: Costs of the edits, in the order of their letters: delete, insert, keep, rerole; and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

#: States: nothing yet, after the system's row, after a user's, after an assistant's. NEEDS is the role that goes on from each.
NEEDS = "uuau"
AFTER = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
FAR = 1 << 40
ROLES = {"u": "user", "a": "assistant"}

#: What is left to do after the last row, by state: insert an assistant's row, or a user's and an assistant's.
END = (0, 6, 3, 0)
TAIL = ("", "II", "I", "")


def least(codes: str) -> list[int]:
    """For each row: what it and the rows after it cost at least, whatever comes before.

    Blank and repeated rows have to go. Truncated rows cost 3 at least. Of the rows that may stay, two neighbours
    that can't follow each other need an edit at one of them or between them; neighbours taken apart from one another
    need one each, of 3, or of 1 more if deleting a truncated row does it.
    """
    out, nxt, free = [0] * (len(codes) + 1), None, None
    for i in range(len(codes) - 1, -1, -1):
        c = codes[i]
        if c == "x":
            out[i] = out[i + 1] + DELETE
            continue
        role, cut = c.lower(), c.isupper()
        own = TRUNCATED if cut else 0
        if nxt is not None and role + nxt[0] not in ("su", "ua", "au"):
            own += 1 if cut or nxt[1] else INSERT
            nxt = None
        else:
            nxt = (role, cut)
        out[i] = out[i + 1] + own
    return out


@lru_cache(maxsize=50_000)
def search(codes: str, state: int, finish: tuple[int, ...]) -> tuple[int, str, int]:
    """(cost, edits, last state) of the cheapest way through ``codes`` from ``state``; of equal cost, the first by letters.

    A code tells a row: s, u, a by its role, o for another one, capital if truncated, x if it has to go. ``finish`` is
    what each last state costs from there on; at FAR it can't be last. The last edit takes the last row.
    """
    n, rest = len(codes), least(codes)
    floor = min(finish)
    if floor >= FAR:
        return FAR, "", state
    bound, most = rest[0] + floor, DELETE * n + 2 * INSERT + max(f for f in finish if f < FAR)
    while bound <= most:
        # The table is made anew for each bound, so that what lies above the bound is known exactly.
        above, failed = FAR, {}
        # A frame: (row, state, cost so far, edits left to try).
        stack = [(0, state, 0, _edits(codes, 0, state))]
        path: list[str] = []
        while stack:
            i, q, spent, edits = stack[-1]
            if i == n:
                total = spent + finish[q]
                if total <= bound:
                    return total, "".join(path), q
                above = min(above, total)
                edits = iter(())
            for letter, j, r, cost in edits:
                new = spent + cost
                need = new + rest[j] + floor
                if need > bound:
                    above = min(above, need)
                    continue
                if failed.get((j, r), -1) >= bound - new:
                    continue
                path.append(letter)
                stack.append((j, r, new, _edits(codes, j, r)))
                break
            else:
                failed[i, q] = max(failed.get((i, q), -1), bound - spent)
                stack.pop()
                if path:
                    path.pop()
        bound = above
    return FAR, "", state


def _edits(codes: str, i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
    """The edits possible at row ``i`` in state ``q``, in the order of their letters: (letter, next row, next state, cost)."""
    if i == len(codes):
        return
    c = codes[i]
    yield "D", i + 1, q, DELETE
    yield "I", i, AFTER[NEEDS[q], q], INSERT
    if c != "x":
        role, more = c.lower(), TRUNCATED if c.isupper() else 0
        if (role, q) in AFTER:
            yield "K", i + 1, AFTER[role, q], more
        if role != NEEDS[q]:
            yield "R", i + 1, AFTER[NEEDS[q], q], REROLE + more


def shortest_costs(codes: str) -> list[int]:
    """Sixteen costs: the cheapest way through the block from each state to each state."""
    ends = [tuple(0 if x == y else FAR for y in range(4)) for x in range(4)]
    return [_cost(codes, q, x, ends[x]) for q in range(4) for x in range(4)]


def _cost(codes: str, q: int, x: int, finish: tuple[int, ...]) -> int:
    if x == 0:
        return DELETE * len(codes) if q == 0 else FAR
    if x == 1:
        if q == 1:
            return DELETE * len(codes)
        kept = [TRUNCATED if c == "S" else 0 for c in codes if c in "sS"]
        return DELETE * (len(codes) - 1) + min(kept) if q == 0 and kept else FAR
    return search(codes, q, finish)[0]


def damage(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copy): rows with the faults that the checksum of "conv_id:turn" modulo 20 gives them.

    Nulls of any column count as one space; a null turn stays null for its order. 0 drops a row, 1 empties its text, 2
    removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    conv, turn = F.col("row.conv_id").cast("string"), F.col("row.turn")
    fault = F.crc32(F.concat(F.coalesce(conv, space), F.lit(":"), F.coalesce(turn.cast("string"), space)).cast("binary")) % 20
    text, role = F.coalesce(F.col("row.text"), space), F.coalesce(F.col("row.role"), space)
    rows = conversations.select(F.struct(*[F.col(f"`{c}`") for c in ("conv_id", "turn", "role", "text")]).alias("row"))
    rows = rows.select(
        F.coalesce(conv, space).alias("conv"), turn.alias("turn"), fault.alias("fault"),
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    )
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("fault != 0").select("conv", "turn", "role", "text", F.explode(copies).alias("copy"))


def _order() -> list[Column]:
    return [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]


def _codes(rows: DataFrame) -> DataFrame:
    """(conv, turn, at, initial, blank, truncated, digest) of every row; ``at`` rises along each conversation.

    Rows are cut by range along the order, so a long conversation spans many tasks. The texts end here.
    """
    start = F.substring("text", 1, 64)
    cut = rows.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "role", start).sortWithinPartitions(*_order())
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    blank = last == ""
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return cut.select(
        "conv", "turn", F.monotonically_increasing_id().alias("at"), F.substring("role", 1, 1).alias("initial"),
        blank.alias("blank"), (~blank & ~last.isin(".", "!", "?")).alias("truncated"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
    )


def _faults(rows: DataFrame) -> DataFrame:
    """Adds ``repeated``: not blank, and an earlier row of the conversation has its role and text."""
    firsts = rows.groupBy("conv", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    again = firsts.filter("n > 1").drop("n")
    found = rows.join(again, ["conv", "digest"], "left")
    return found.withColumn("repeated", ~F.col("blank") & F.coalesce(F.col("at") != F.col("first"), F.lit(False)))


def _blocks(rows: DataFrame) -> DataFrame:
    """(conv, block, codes, initials) with the faults counted; the codes of at most 2**BLOCK_BITS rows in order."""
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("o"))
    stays = ~F.col("blank") & ~F.col("repeated")
    code = F.when(~stays, F.lit("x")).when(F.col("truncated"), F.upper(known)).otherwise(known)
    one = F.struct("at", code.alias("code"), known.alias("known"))
    return rows.groupBy("conv", F.shiftright("at", BLOCK_BITS).alias("block")).agg(
        F.array_sort(F.collect_list(one)).alias("rows"), F.count_if("blank").alias("blank"),
        F.count_if("repeated").alias("duplicate"), F.count_if(stays & F.col("truncated")).alias("truncated"),
    ).select("conv", "block", "blank", "duplicate", "truncated", F.concat_ws("", "rows.code").alias("codes"),
             F.concat_ws("", "rows.known").alias("initials"))


def _matrix(codes: pd.Series) -> pd.Series:
    made = {c: shortest_costs(c) for c in codes.unique()}
    return codes.map(made)


def _paths(codes: pd.Series, finish: pd.Series, first: pd.Series) -> pd.DataFrame:
    """For each state a block may begin in: its cheapest cost to the end of the conversation, its edits, its last state.

    The first block of a conversation begins in the first state.
    """
    rows = []
    for c, f, one in zip(codes, finish, first):
        cost, edits, last = zip(*[search(c, q, tuple(int(x) for x in f)) for q in range(1 if one else 4)])
        rows.append((list(cost), list(edits), list(last)))
    return pd.DataFrame(rows, columns=["cost", "edits", "last"])


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks from the last to the first of each conversation: what is left to pay after each, by its last state."""
    conv, left = None, END
    for batch in batches:
        out = []
        for c, costs in zip(batch["conv"], batch["costs"]):
            if c != conv:
                conv, left = c, END
            out.append(list(left))
            if costs is not None:
                left = tuple(min(FAR, *(int(costs[4 * q + x]) + left[x] for x in range(4))) for q in range(4))
        yield pd.DataFrame({"conv": batch["conv"], "block": batch["block"], "finish": out})


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks from the first to the last of each conversation: follows the states; one row per conversation."""
    names = ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    conv, state, edits, last, sums, cost = None, 0, [], "", [0] * 4, 0

    def done() -> tuple:
        return (conv, *sums, cost, "".join(edits) + TAIL[state])

    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.conv != conv:
                if conv is not None:
                    out.append(done())
                conv, state, edits, last, sums, cost = r.conv, 0, [], "", [0] * 4, int(r.cost[0])
            both = last + r.initials
            wrong = sum(both[i : i + 2] not in ("su", "ua", "au") for i in range(len(both) - 1))
            sums = [a + b for a, b in zip(sums, (r.blank, r.duplicate, r.truncated, wrong))]
            last = both[-1]
            edits.append(r.edits[state])
            state = r.last[state]
        yield pd.DataFrame(out, columns=names)
    if conv is not None:
        yield pd.DataFrame([done()], columns=names)


_WALKED = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A conversation's edits, then its rows in order: the digest of what the edits make of them, row by row."""
    conv, edits, at, state, first, digest = None, "", 0, 0, True, hashlib.sha256()

    def add(role: str, text: str) -> None:
        nonlocal first, state
        digest.update((("" if first else "\n") + f"{role}:{text}").encode("utf-8", "replace"))
        first, state = False, AFTER[role[0], state]

    def inserts() -> None:
        nonlocal at
        while at < len(edits) and edits[at] == "I":
            add(ROLES[NEEDS[state]], "")
            at += 1

    def done() -> tuple:
        inserts()
        return conv, digest.hexdigest()

    for batch in batches:
        out = []
        for c, audit, role, text in zip(batch["conv"], batch["audit"], batch["role"], batch["text"]):
            if audit is not None:
                if conv is not None:
                    out.append(done())
                conv, edits, at, state, first, digest = c, audit, 0, 0, True, hashlib.sha256()
                continue
            inserts()
            if edits[at] != "D":
                add(role if edits[at] == "K" else ROLES[NEEDS[state]], text)
            at += 1
        yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
    if conv is not None:
        yield pd.DataFrame([done()], columns=["conv", "repaired_sha256"])


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conv_id.

    Rows are taken by turn, nulls first; equal turns by role, then text. Null ids are one conversation. A conversation without
    rows after the damage has zeros, no edits and the digest of no bytes. Another column is ignored. No conversations: no rows.
    The digest of a whole conversation is worked out in one task by its nature, row by row in bounded memory.
    """
    ship_package(conversations.sparkSession)
    kind = dict(conversations.select("conv_id").dtypes)["conv_id"]
    matrix = F.pandas_udf(_matrix, "array<long>")
    ways = F.pandas_udf(_paths, "cost array<long>, edits array<string>, last array<int>")
    space = F.lit(" ")
    rows = damage(conversations)
    slim = written(_codes(rows), "conversation-rows")
    blocks = written(_blocks(_faults(slim)), "conversation-blocks")
    spans = blocks.groupBy("conv").agg(F.min("block").alias("first"), F.max("block").alias("final"))
    blocks = blocks.join(spans, "conv")
    many = blocks.filter("first < final").withColumn("costs", F.when(F.col("block") > F.col("first"), matrix("codes")))
    costs = written(many.select("conv", "block", "costs"), "conversation-costs")
    ordered = costs.repartition("conv").sortWithinPartitions("conv", F.col("block").desc())
    ends = ordered.mapInPandas(_ends, "conv string, block long, finish array<long>")
    finish = F.coalesce("finish", F.array(*[F.lit(x).cast("long") for x in END]))
    paths = blocks.join(ends, ["conv", "block"], "left").withColumn(
        "found", ways("codes", finish, F.col("block") == F.col("first")))
    walk = paths.select("conv", "block", "blank", "duplicate", "truncated", "initials", "found.*")
    walked = written(
        walk.repartition("conv").sortWithinPartitions("conv", "block").mapInPandas(_walk, _WALKED), "conversation-edits")

    columns = ["conv", "turn", "role", "text", "copy"]
    header = walked.select("conv", *[F.lit(None).alias(c) for c in columns[1:]], "audit")
    every = rows.select(*columns, F.lit(None).cast("string").alias("audit")).unionByName(header)
    lines = every.repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), *_order()[1:])
    digests = lines.select("conv", "audit", "role", "text").mapInPandas(_repaired, "conv string, repaired_sha256 string")

    turns = slim.select("conv", "turn").distinct().groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    ids = conversations.select(F.col("conv_id").alias("id")).distinct().withColumn("conv", F.coalesce(F.col("id").cast("string"), space))
    all_of = ids.join(walked.join(digests, "conv").join(turns, "conv"), "conv", "left")
    none = hashlib.sha256().hexdigest()
    return all_of.select(
        F.col("id").cast(kind).alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"),
    )


#: The checksum's table is made by its rule. One step takes one row of every conversation, with at most two inserts before it.
REPAIR_SQL = r"""
with recursive crc_step(i, k, v) as (
  select i, 0, i::ubigint from range(256) r(i)
  union all
  select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end from crc_step where k < 8
), rule as (select list(v order by i) as tab from crc_step where k = 8),
keyed as (
  select coalesce(conv_id::varchar, ' ') as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as h from conversations
), faulty as (
  select *, xor(list_reduce([4294967295::ubigint] || [('0x' || h[2 * i + 1 : 2 * i + 2])::ubigint for i in range(len(h) // 2)],
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::int + 1])), 4294967295::ubigint) % 20 as fault from keyed, rule
), damaged as (
  select conv, turn, case when fault = 4 then 'user' else role end as role,
    case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when fault = 3 then [0, 1] else [0] end) as copy from faulty where fault <> 0
), placed as (
  select *, row_number() over (partition by conv order by turn nulls first, role, text, copy) as i from damaged
), seen as (
  select *, row_number() over (partition by conv, role, text order by i) > 1 as again,
    not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$') as open,
    lead(left(role, 1)) over (partition by conv order by i) as next_initial from placed
), lines as (
  select conv, turn, i, role, text, left(role, 1) as initial, blank, again and not blank as duplicate,
    open and not blank and not again as truncated, blank or again as gone, next_initial from seen
), moves(q, w, r) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
needs(q, w) as (values (0, 'u'), (1, 'u'), (2, 'a'), (3, 'u')),
inserted(q, k, r) as (values (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2),
  (3, 0, 3), (3, 1, 2), (3, 2, 3)),
edits as (
  select l.conv, l.i, f.q, f.k, 'D' as letter, f.r, 4 as cost from lines l, inserted f
  union all
  select l.conv, l.i, f.q, f.k, 'K', m.r, case when l.truncated then 3 else 0 end
  from lines l, inserted f join moves m on f.r = m.q where not l.gone and l.initial = m.w
  union all
  select l.conv, l.i, f.q, f.k, 'R', m.r, case when l.truncated then 6 else 3 end
  from lines l, inserted f join needs n on f.r = n.q join moves m on m.q = n.q and m.w = n.w where not l.gone
), best_edits as (
  select conv, i, q, r, min({'cost': cost + 3 * k, 'path': repeat('I', k) || letter}) as e from edits group by all
), ways(conv, i, q, cost, path) as (
  select distinct conv, 0::bigint, 0, 0::bigint, '' from lines
  union all
  select conv, i, q, best.cost, best.path from (
    select w.conv, e.i, e.r as q, min({'cost': w.cost + e.e.cost, 'path': w.path || e.e.path}) as best
    from ways w join best_edits e on w.conv = e.conv and e.i = w.i + 1 and e.q = w.q group by w.conv, e.i, e.r)
), ends(q, cost, tail) as (values (0, 0, ''), (1, 6, 'II'), (2, 3, 'I'), (3, 0, '')),
lengths as (
  select conv, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(blank) as blank,
    count_if(duplicate) as duplicate, count_if(truncated) as truncated,
    count_if(next_initial is not null and initial || next_initial not in ('su', 'ua', 'au')) as illegal from lines group by 1
), done as (
  select w.conv, min({'cost': w.cost + e.cost, 'path': w.path || e.tail}) as best
  from ways w join lengths l on w.conv = l.conv and w.i = l.n join ends e using (q) group by 1
), letters as (
  select conv, best.path as path, unnest(range(1, len(best.path) + 1)) as p from done
), stepped as (
  select conv, p, path[p] as letter, sum((path[p] <> 'I')::int) over (partition by conv order by p) as i from letters
), made as (
  select s.conv, s.p, s.letter, l.role, l.text, row_number() over (partition by s.conv order by s.p) as o,
    first_value(s.letter = 'K' and l.initial = 's') over (partition by s.conv order by s.p) as system
  from stepped s left join lines l on s.conv = l.conv and s.i = l.i where s.letter <> 'D'
), repaired as (
  select conv, sha256(string_agg(case when letter = 'K' then role when (o - system::int) % 2 = 1 then 'user' else 'assistant' end
    || ':' || case when letter = 'I' then '' else text end, chr(10) order by p)) as sha from made group by 1
), ids as (select distinct conv_id, coalesce(conv_id::varchar, ' ') as conv from conversations)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost,
  coalesce(best.path, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from ids left join lengths using (conv) left join done using (conv) left join repaired using (conv)
"""
