"""Conversation structure repair: weighted interval parsing of turns (CYK) with a repair grammar in Chomsky normal form.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles. The grammar's nonterminals are pairs [p, q] of states of that
language: [p, q] derives the turns of a span whose edits lead from p to q. Its binary rules are [p, q] -> [p, r] [r, q], its
terminal rules the edits of one turn (Keep 0, Rerole 1, Delete 2, and 5 for a truncated turn that stays), and insertions
(5 each) are unary steps, closed once over each cell. A cell of the chart holds, for each nonterminal, the least (cost, audit) of
its span. Two audits of one span, nonterminal and cost are never one the start of the other, since the longer would have paid for
more insertions; so least parts make least wholes. As any derivation of [p, q] passes some state r at whatever place a span is cut, one cut of
a span is enough: the chart is filled by span length 1, 2, 4, ... and a conversation of n turns takes n - 1 combinations
instead of the cube of n.

Only marks of 30 bytes a turn (order, hash, initial, fault) are gathered by conversation; the audit that is returned takes a
character a turn itself. Texts move once, beside the audit of their conversation, in order, and are hashed while they stream by.

Rows: in ``conv_id``, ``turn`` (for the damage), ``role`` and ``text`` a null counts as one space; rows of a null id are one conversation. Turns of
equal number stand by the hash of role and text as damaged, nulls first. Empty tables give no rows; a conversation that
loses all rows has zeros. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, arrow_map, batch_of, table, written
from .op12_trie import token

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn; a conversation may end in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
_STEPS = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
_SPACE = " \t\n\x0b\x0c\r"

Cell = dict[tuple[int, int], tuple[int, str]]


def combined(left: Cell, right: Cell) -> Cell:
    """The binary rules: the cell of two spans that stand side by side."""
    out: Cell = {}
    for (p, r), (c1, a1) in left.items():
        for q in range(4):
            other = right.get((r, q))
            if other is not None:
                new = (c1 + other[0], a1 + other[1])
                if (p, q) not in out or new < out[p, q]:
                    out[p, q] = new
    return out


def _inserted() -> Cell:
    """The closure over insertions: the least way from state to state without a turn."""
    out: Cell = {(p, p): (0, "") for p in range(4)}
    one = out | {step: (INSERT, "I") for x in "ua" for step in _STEPS[x]}
    for _ in range(3):
        out = combined(out, one)
    return out


EMPTY = _inserted()


def turn_cell(initial: str, fault: str) -> Cell:
    """The cell of one turn: its edits, with insertions before and after it."""
    out: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        edits = [(x, REROLE, "R") for x in "ua"] + ([(initial, 0, "K")] if initial in _STEPS else [])
        for x, cost, letter in edits:
            for step in _STEPS[x]:
                out[step] = min(out.get(step, (cost + extra, letter)), (cost + extra, letter))
    return combined(combined(EMPTY, out), EMPTY)


def parse(marks: list[tuple[str, str]], known: dict) -> tuple[int, str]:
    """Least (cost, audit) of turns (initial, fault), bottom-up by span length; ``known`` remembers cells of single turns."""
    chart = []
    for mark in marks:
        if mark not in known:
            known[mark] = turn_cell(*mark)
        chart.append(known[mark])
    while len(chart) > 1:
        chart = [combined(*chart[i : i + 2]) if i + 1 < len(chart) else chart[i] for i in range(0, len(chart), 2)]
    cell = chart[0] if chart else EMPTY
    return min(cell[START, q] for q in (START, ASSISTANT) if (START, q) in cell)


class Repaired:
    """Follows an audit over the turns of a conversation and gives the repaired ones as ``role:text``."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _role(self) -> str:
        self.state = ASSISTANT if self.state == USER else USER
        return "assistant" if self.state == ASSISTANT else "user"

    def inserted(self) -> Iterator[str]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield f"{self._role()}:"

    def turn(self, role: str, text: str) -> Iterator[str]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield f"{self._role()}:{text}"
        elif edit == "K":
            if role[:1] == "s":
                self.state = SYSTEM
            else:
                self._role()
            yield f"{role}:{text}"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by the remainder of crc32(``conv_id:turn``); a dropped row stays with a null
    ``text``, so that its conversation is known."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).when(F.col("kind") != 0, F.col("text"))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


_STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audits(rows: DataFrame) -> DataFrame:
    """Counts, cost and audit of each conversation of damaged rows (conv_id, turn, role, text, token)."""
    bare = F.rtrim("text", F.lit(_SPACE))
    fault = F.when(bare == "", "b").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    mark = F.struct("turn", "token", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), mark))).alias("marks"))
    names = ["conv_id", *_STATS, "audit"]

    def make():
        known: dict = {}

        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            lists = b.column(1)
            flat = lists.flatten()
            turns, tokens, initials, faults = (flat.field(i).to_pylist() for i in range(4))
            at = 0
            for n in lists.value_lengths().to_pylist():
                here = slice(at, at := at + n)
                seen: set[str] = set()
                found = []
                for x, f in zip(tokens[here], faults[here]):
                    found.append("blank" if f == "b" else "duplicate" if x in seen else "truncated" if f else "")
                    seen.add(x)
                first = initials[here]
                numbers = {t for t in turns[here] if t is not None}
                gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
                cost, audit = parse(list(zip(first, found)), known)
                illegal = sum(x + y not in LEGAL for x, y in zip(first, first[1:]))
                out.append((gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit))
            cols = list(zip(*out)) or [()] * 7
            return batch_of(names, [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.string())])

        return fn

    kind = dict(rows.dtypes)["conv_id"]
    return arrow_map(whole, make, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _STATS) + ", audit string")


def repaired(rows: DataFrame) -> DataFrame:
    """The columns of ``audits`` and ``repaired_sha256`` of damaged rows (conv_id, turn, role, text)."""
    rows = rows.withColumn("token", token(F.col("role"), F.col("text")))
    known = written(audits(rows), "audits")
    texts = rows.where("text is not null").select("conv_id", F.lit(1).alias("late"), "turn", "token", "role", "text")
    both = known.withColumn("late", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    names = ["conv_id", *_STATS, "audit"]
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "late", "turn", "token").select(*names, "late", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _STATS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, walk, h, some = None, None, None, False
        done: list[tuple] = []

        def put(pieces: Iterator[str]) -> None:
            nonlocal some
            for piece in pieces:
                if some:
                    h.update(b"\n")
                some = True
                h.update(piece.encode("utf-8", "surrogatepass"))

        def end() -> None:
            if head is not None:
                put(walk.inserted())
                done.append((*head, h.hexdigest()))

        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE).to_pylist()
                for r in part:
                    if r["late"] == 0:
                        end()
                        head, walk, h, some = tuple(r[c] for c in names), Repaired(r["audit"]), hashlib.sha256(), False
                    else:
                        put(walk.turn(r["role"], r["text"]))
                if done:
                    yield batch_of(schema.names, [pa.array(c, k) for c, k in zip(zip(*done), schema.types)])
                    done.clear()
        end()
        if done:
            yield batch_of(schema.names, [pa.array(c, k) for c, k in zip(zip(*done), schema.types)])

    return dealt.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in _STATS) + ", audit string, repaired_sha256 string")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return repaired(damaged(c.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")))


#: A cell of the fold is a cost of nine digits followed by its audit, so that the least text is the least (cost, audit); the four
#: states are folded over the turns in order, insertions closed after each.
OP13_SQL = r"""
with crc as materialized (select list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end), x::bigint)) as tab),
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda d: ascii(d)::bigint),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 20 as kind
  from conversations, crc),
hurt as (
  select conv_id, turn, case kind when 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case kind when 3 then 2 else 1 end)) as copy
  from keyed where kind <> 0),
marked as (
  select *, left(sha256(length(role) || ':' || role || text), 32) as token, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from hurt),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, token, copy) as i from marked),
faulty as materialized (
  select conv_id, turn, role, text, i, left(role, 1) as x, lead(left(role, 1)) over (partition by conv_id order by i) as y,
    case when bare = '' then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd' when right(bare, 1) not in ('.', '!', '?') then 't' else '' end as fault
  from placed),
folded as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (where fault = 'b') as blank,
    count(*) filter (where fault = 'd') as duplicate, count(*) filter (where fault = 't') as truncated,
    count(*) filter (where y is not null and x || y not in ('su', 'ua', 'au')) as illegal,
    list_reduce(list(struct_pack(x := x, f := fault) order by i), lambda v, t: list_transform([list_transform([
        [v[1] || '2D'],
        [v[2] || '2D'] || case when t.f in ('b', 'd') or t.x <> 's' then [] else [v[1] || case t.f when 't' then '5K' else '0K' end] end,
        [v[3] || '2D'] || case when t.f in ('b', 'd') then [] else list_transform([v[1], v[2], v[4]], lambda w: w || case when t.x = 'u' then case t.f when 't' then '5K' else '0K' end else case t.f when 't' then '6R' else '1R' end end) end,
        [v[4] || '2D'] || case when t.f in ('b', 'd') then [] else [v[3] || case when t.x = 'a' then case t.f when 't' then '5K' else '0K' end else case t.f when 't' then '6R' else '1R' end end] end
      ], lambda ways: list_min(list_transform(list_filter(ways, lambda w: w[1] <> '~'), lambda w: lpad((w[1:9]::bigint + w[-2:-2]::bigint)::varchar, 9, '0') || w[10:-3] || w[-1:])))],
      lambda z: [z[1], coalesce(z[2], '~'),
        list_min(list_filter([z[3], lpad((z[1][1:9]::bigint + 5)::varchar, 9, '0') || z[1][10:] || 'I', lpad((z[2][1:9]::bigint + 5)::varchar, 9, '0') || z[2][10:] || 'I', lpad((z[4][1:9]::bigint + 5)::varchar, 9, '0') || z[4][10:] || 'I'], lambda w: w is not null)),
        list_min(list_filter([z[4], lpad((z[1][1:9]::bigint + 10)::varchar, 9, '0') || z[1][10:] || 'II', lpad((z[2][1:9]::bigint + 10)::varchar, 9, '0') || z[2][10:] || 'II', lpad((z[3][1:9]::bigint + 5)::varchar, 9, '0') || z[3][10:] || 'I'], lambda w: w is not null))])[1],
      ['000000000', '~', '000000005I', '000000010II']) as v
  from faulty group by conv_id),
found as materialized (select * exclude (v), least(v[1], v[4]) as best from folded),
edits as (
  select conv_id, edit, k, count(*) filter (where edit <> 'I') over (partition by conv_id order by k) as i
  from (select conv_id, unnest(string_split(best[10:], '')) as edit, generate_subscripts(string_split(best[10:], ''), 1) as k from found where length(best) > 9)),
kept as (
  select e.conv_id, e.k, e.edit, f.role, case e.edit when 'I' then '' else f.text end as text, row_number() over (partition by e.conv_id order by e.k) as m,
    first_value(e.edit = 'K' and f.x = 's') over (partition by e.conv_id order by e.k) as has_s
  from edits e left join faulty f on f.conv_id is not distinct from e.conv_id and f.i = e.i where e.edit <> 'D'),
said as (
  select conv_id, sha256(string_agg(case edit when 'K' then role else case when (m - has_s::int) % 2 = 1 then 'user' else 'assistant' end end || ':' || text, chr(10) order by k)) as hash
  from kept group by conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(best[1:9]::bigint, 0) as cost, coalesce(best[10:], '') as audit, coalesce(s.hash, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join found f on f.conv_id is not distinct from c.conv_id left join said s on s.conv_id is not distinct from c.conv_id
"""
