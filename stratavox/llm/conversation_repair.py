"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and then pairs of user and assistant.

Each row with the turns inserted before it is one macro edit: a code of zero to two I (insert) and then D (delete), K (keep) or R (change the role). As each code
ends with its only letter that isn't I, none begins another, so audits of the same rows compare as their lists of codes do. The dynamic programme over four
states (nothing yet, after system, after user, after assistant) therefore never holds an audit: a layer has each state's least cost and the rank of its
audit among the layer's, and new ranks come from pairs of an old rank and a code. Parent pointers give the edits afterwards.

Rows are sorted by ranges of conversation and turn and cut into chunks of at most ``CHUNK`` rows of a conversation, one byte a row. A chunk's effect is a table of four
by four costs and ranks, so a conversation of any length is solved in three steps: all chunks for themselves, their tables in order, and all chunks again
between the states that they got. Texts don't take part; they meet their edits by a shuffle on a digest of the row. What is in one task is a chunk,
or a conversation's tables, or one text.

Defined results: a null text, role, conv_id or turn is one space where a string is needed; null turns come first. Rows of the same turn are ordered by role and then by a digest
of the text; equal rows are adjacent, and all but the first are duplicates. Rows with other roles than system, user and assistant go by their first letter. Ties of cost go to the audit that
is least as a string. A conversation without rows has zeros, an empty audit and the digest of the empty string. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.plans.checkpoints import cut, drop

from .checksums import crc32_sql

#: Rows of a conversation in a chunk.
CHUNK = 8192
BLANKS = " \t\n\x0b\x0c\r"
#: Costs of an insertion, a deletion, a change of role, and what a truncated row adds unless it is deleted.
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
CODES = sorted("I" * k + c for k in range(3) for c in "DKR")
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that comes next if it is put there, and the insertions that end a conversation well.
_NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
_TAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
ROLE = {"u": "user", "a": "assistant"}
#: A row's type is four times the place of its initial in this string, or of the end, and then its fault.
INITIALS = "sua"
FINE, CUT_SHORT, BLANK, DUPLICATE = range(4)

Layer = tuple[tuple[int, int] | None, ...]


@lru_cache(maxsize=None)
def _moves(kind: int) -> list[list[tuple[int, int, int]]]:
    """For a row's type and each state after it: (state before, cost, code), the best code for each state before."""
    initial, fault = (INITIALS + "?")[kind // 4], kind % 4
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for before in range(4):
        at = before
        for k in range(3):
            ways = [("D", at, DELETE)]
            if fault < BLANK:
                more = TRUNCATED if fault == CUT_SHORT else 0
                ways += [("R", _AFTER[at, _NEXT[at]], REROLE + more)]
                ways += [("K", _AFTER[at, initial], more)] if (at, initial) in _AFTER else []
            for letter, to, cost in ways:
                found = (INSERT * k + cost, CODES.index("I" * k + letter))
                best[before, to] = min(found, best.get((before, to), found))
            at = _AFTER[at, _NEXT[at]]
    return [[(before, *best[before, to]) for before in range(4) if (before, to) in best] for to in range(4)]


@lru_cache(maxsize=1 << 16)
def _step(layer: Layer, kind: int) -> tuple[int, Layer, tuple[tuple[int, int] | None, ...]]:
    """(cost that all states have more, next layer, (state before, code) by state). Layers hold costs above their least one."""
    found = []
    for to in range(4):
        ways = [(layer[b][0] + cost, layer[b][1], code, b) for b, cost, code in _moves(kind)[to] if layer[b] is not None]
        found.append(min(ways) if ways else None)
    low = min(w[0] for w in found if w)
    order = sorted({w[1:3] for w in found if w})
    return low, tuple((w[0] - low, order.index(w[1:3])) if w else None for w in found), tuple((w[3], w[2]) if w else None for w in found)


def _enter(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in range(4))


def table(kinds: bytes) -> list[int]:
    """Least cost and rank from each state before the rows to each after them, -1 where there is no way: 32 numbers."""
    out = []
    for state in range(4):
        layer, cost = _enter(state), 0
        for kind in kinds:
            more, layer, _ = _step(layer, kind)
            cost += more
        for s in layer:
            out += [-1, -1] if s is None else [s[0] + cost, s[1]]
    return out


def through(tables: list[list[int]]) -> tuple[int, list[tuple[int, int]], int]:
    """(cost, (state before, state after) of each chunk, insertions at the end) of the best way through chunks with these tables."""
    at: list[tuple[int, int] | None] = list(_enter(START))
    back = []
    for t in tables:
        ways = []
        for to in range(4):
            own = [(at[b][0] + t[8 * b + 2 * to], at[b][1], t[8 * b + 2 * to + 1], b) for b in range(4) if at[b] is not None and t[8 * b + 2 * to] >= 0]
            ways.append(min(own) if own else None)
        order = sorted({w[1:3] for w in ways if w})
        at = [(w[0], order.index(w[1:3])) if w else None for w in ways]
        back.append([w[3] if w else None for w in ways])
    cost, _, tail, state = min((at[s][0] + INSERT * _TAIL[s], at[s][1], _TAIL[s], s) for s in range(4) if at[s] is not None)
    states = []
    for b in reversed(back):
        states.append((b[state], state))
        state = b[state]
    return cost, states[::-1], tail


def edits(kinds: bytes, before: int, after: int) -> tuple[list[int], list[int]]:
    """(code, state before) for each row of a chunk, on the best way between two states."""
    layer, backs = _enter(before), []
    for kind in kinds:
        _, layer, back = _step(layer, kind)
        backs.append(back)
    codes, states, state = [], [], after
    for back in reversed(backs):
        state, code = back[state]
        codes.append(code)
        states.append(state)
    return codes[::-1], states[::-1]


def roles(state: int, n: int) -> list[str]:
    """The roles of n turns put in after a state."""
    out = []
    for _ in range(n):
        out.append(_NEXT[state])
        state = _AFTER[state, out[-1]]
    return [ROLE[r] for r in out]


def written(state: int, code: str) -> tuple[list[str], bool, str | None]:
    """A macro edit's roles of inserted turns, whether the row stays, and its new role if it gets one."""
    n = len(code) - 1
    return roles(state, n), code[-1] != "D", roles(state, n + 1)[-1] if code[-1] == "R" else None


# Spark


def _string(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def plain(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) without null texts and roles."""
    return turns.select("conv_id", "turn", _string("role").alias("role"), _string("text").alias("text"))


def keyed(turns: DataFrame) -> DataFrame:
    """plain rows with same, a digest of conversation, role and text, and key, a digest of the whole row."""
    same = F.unhex(F.md5(F.concat(_string("conv_id"), F.lit(":"), F.length("role"), F.lit(":"), "role", "text").cast("binary")))
    return turns.withColumn("same", same).withColumn("key", F.unhex(F.md5(F.concat(F.hex("same"), F.lit(":"), _string("turn")).cast("binary"))))


def distinct_rows(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, same, key, n, blank, short), a cut: each different row without its text."""
    end = F.rtrim("text", F.lit(BLANKS))
    light = turns.withColumns({"blank": end == "", "short": ~F.substring(end, -1, 1).isin(".", "!", "?")})
    return cut(light.groupBy("conv_id", "turn", "role", "same", "key").agg(F.count("*").alias("n"), F.max("blank").alias("blank"), F.max("short").alias("short")))


def chunks(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, chunk, kinds, keys), a cut: the types and keys of up to CHUNK rows in order; chunk numbers grow along a conversation."""
    first = rows.groupBy("same").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    own = rows.join(first, "same").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    again = (F.struct(F.col("turn").isNotNull().alias("known"), "turn") > F.col("first")) | (F.col("copy") > 1)
    fault = F.when(F.col("blank"), BLANK).when(again, DUPLICATE).when(F.col("short"), CUT_SHORT).otherwise(FINE)
    letter = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    initial = F.when((F.length("role") == 0) | (letter == 0), len(INITIALS)).otherwise(letter - 1)
    order = ["conv_id", "turn", "role", "same", "copy"]
    kinds = own.select(*order, "key", (initial * 4 + fault).cast("int").alias("kind")).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "kind")
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches):
        from pyspark import TaskContext

        number, conv, held, schema = TaskContext.get().partitionId() << 40, None, None, None

        def made(full):
            return pa.RecordBatch.from_arrays([pa.array([c[0] for c in full], schema), pa.array([c[1] for c in full]), pa.array([bytes(c[2]) for c in full]), pa.array([c[3] for c in full], pa.list_(pa.binary()))], names=["conv_id", "chunk", "kinds", "keys"])

        for batch in batches:
            schema, full = batch.schema.field("conv_id").type, []
            for c, key, k in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "key", "kind")), strict=True):
                if held is None or c != conv or len(held[2]) == CHUNK:
                    if held is not None:
                        full.append(held)
                    conv, held, number = c, (c, number, bytearray(), []), number + 1
                held[2].append(k)
                held[3].append(key)
            if full:
                yield made(full)
        if held is not None:
            yield made([held])

    return cut(kinds.mapInArrow(run, f"conv_id {kind}, chunk long, kinds binary, keys array<binary>"))


def plan(pieces: DataFrame) -> DataFrame:
    """Rows (conv_id, chunk, before, after, tail, cost, blank, duplicate, truncated, illegal): how each chunk goes; the conversation's numbers stand in its last chunk."""
    kind = dict(pieces.dtypes)["conv_id"]

    def tables(batches):
        for batch in batches:
            out = []
            for kinds in batch.column("kinds").to_pylist():
                k = np.frombuffer(kinds, np.uint8)
                fault, initial = np.bincount(k % 4, minlength=4), k // 4
                pair = initial[:-1] * 4 + initial[1:]
                legal = np.isin(pair, [1, 6, 9]).sum()  # su, ua, au
                out.append(([*table(kinds), int(fault[BLANK]), int(fault[DUPLICATE]), int(fault[CUT_SHORT]), len(pair) - int(legal), int(initial[0]), int(initial[-1])],))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array([o[0] for o in out], pa.list_(pa.int64()))], names=["conv_id", "chunk", "about"])

    def compose(batches):
        conv, rows, schema = None, None, None

        def solved():
            cost, states, tail = through([a[:32] for _, a in rows])
            ends = sum(4 * p[1][37] + q[1][36] not in (1, 6, 9) for p, q in zip(rows, rows[1:]))
            total = [cost, *(sum(a[k] for _, a in rows) for k in (32, 33, 34)), ends + sum(a[35] for _, a in rows)]
            for i, ((chunk, _), (before, after)) in enumerate(zip(rows, states, strict=True)):
                yield (conv, chunk, before, after, tail, *total) if i == len(rows) - 1 else (conv, chunk, before, after, 0, *[None] * 5)

        def made(out):
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], schema if k == 0 else pa.int64()) for k in range(10)], names=["conv_id", "chunk", "before", "after", "tail", "cost", "blank", "duplicate", "truncated", "illegal"])

        for batch in batches:
            schema, out = batch.schema.field("conv_id").type, []
            for c, chunk, about in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "chunk", "about")), strict=True):
                if rows is None or c != conv:
                    out += solved() if rows else []
                    conv, rows = c, []
                rows.append((chunk, about))
            if out:
                yield made(out)
        if rows:
            yield made(list(solved()))

    about = pieces.select("conv_id", "chunk", "kinds").mapInArrow(tables, f"conv_id {kind}, chunk long, about array<long>")
    return about.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(compose, f"conv_id {kind}, chunk long, before long, after long, tail long, cost long, blank long, duplicate long, truncated long, illegal long")


def edit_rows(pieces: DataFrame, ways: DataFrame) -> DataFrame:
    """Rows (conv_id, chunk, at, key, code, inserted, stays, role), a cut: the macro edit of each row in order; a last one without a key has what is inserted at the end."""
    kind = dict(pieces.dtypes)["conv_id"]

    def run(batches):
        for batch in batches:
            schema = batch.schema.field("conv_id").type
            for conv, chunk, kinds, keys, before, after, tail in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "chunk", "kinds", "keys", "before", "after", "tail")), strict=True):
                codes, states = edits(kinds, before, after)
                done = [(key, CODES[code], *written(state, CODES[code])) for key, code, state in zip(keys, codes, states, strict=True)]
                if tail:
                    done.append((None, "I" * tail, roles(after, tail), False, None))
                n = len(done)
                columns = [pa.array(list(c), t) for c, t in zip(zip(*done), (pa.binary(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([conv] * n, schema), pa.array([chunk] * n), pa.array(range(n), pa.int64()), *columns], names=["conv_id", "chunk", "at", "key", "code", "inserted", "stays", "role"])

    joined = pieces.join(ways.select("chunk", "before", "after", "tail"), "chunk")
    return cut(joined.mapInArrow(run, f"conv_id {kind}, chunk long, at long, key binary, code string, inserted array<string>, stays boolean, role string"))


def repaired(turns: DataFrame, done: DataFrame) -> DataFrame:
    """Rows (conv_id, chunk, at, k, role, text): the turns after repair, ordered by chunk, at and k. turns: keyed rows."""
    stay = done.where("stays").select("key", "chunk", "at", F.size("inserted").alias("k"), F.col("role").alias("new"))
    # a row that stays has no equal before it; its copies meet the same edit and fall together again where they are
    kept = turns.select("conv_id", "key", "role", "text").join(stay, "key").dropDuplicates(["key"])
    kept = kept.select("conv_id", "chunk", "at", "k", F.coalesce("new", "role").alias("role"), "text")
    put = done.select("conv_id", "chunk", "at", F.posexplode("inserted").alias("k", "role")).withColumn("text", F.lit(""))
    return kept.unionByName(put)


def digests(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, repaired_sha256): the digest of role:text of the turns in order, joined by line breaks; one turn is in memory at a time."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches):
        conv, digest, schema = None, None, None

        def made(out):
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], schema), pa.array([o[1] for o in out])], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            schema, out = batch.schema.field("conv_id").type, []
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if out:
                yield made(out)
        if digest is not None:
            yield made([(conv, digest.hexdigest())])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "at", "k")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reports, edits, repaired turns) of rows (conv_id, turn, role, text).

    reports: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation that has rows. The others are those of edit_rows and repaired.
    """
    own = keyed(plain(turns))
    rows = distinct_rows(own)
    pieces = chunks(rows)
    ways = cut(plan(pieces))
    done = edit_rows(pieces, ways)
    drop(pieces)
    seen = rows.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    audits = done.groupBy("conv_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda e: e.code), "").alias("part"))
    audits = audits.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda e: e.part), "").alias("audit"))
    numbers = ways.where("cost is not null").select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")
    return by_conversation([seen, numbers, audits]), done, repaired(own, done)


def by_conversation(parts: list[DataFrame]) -> DataFrame:
    """Parts with a row for each conversation, null conv_id among them, put side by side."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in out.columns if c != "conv_id"))


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by a checksum of conversation and turn: dropped, emptied, without stops, repeated, or said by the user."""
    fault = F.crc32(F.concat(_string("conv_id"), F.lit(":"), _string("turn")).cast("binary")) % 20
    rows = plain(turns).withColumn("fault", fault).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("one"))
    return rows.drop("one")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    reports, _, after = repair(damage(turns))
    found = by_conversation([turns.select("conv_id").distinct(), reports, digests(after)])
    empty = hashlib.sha256().hexdigest()
    return found.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}

# The same in SQL, with audits as strings.
ORACLE_SQL = {
    "op13_conversation_repair": r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
f AS (SELECT *, """
    + crc32_sql("s")
    + r""" % 20 AS f FROM c),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) FROM f WHERE f <> 0),
r AS (SELECT *, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stem,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || length(role) || ':' || role || text)) AS i FROM d),
k AS (SELECT *, CASE WHEN stem = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(stem, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault,
  coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM r),
ins(state, n, reached, put) AS (VALUES ('n', 0, 'n', ''), ('n', 1, 'u', 'U'), ('n', 2, 'a', 'UA'), ('s', 0, 's', ''), ('s', 1, 'u', 'U'), ('s', 2, 'a', 'UA'),
  ('u', 0, 'u', ''), ('u', 1, 'a', 'A'), ('u', 2, 'u', 'AU'), ('a', 0, 'a', ''), ('a', 1, 'u', 'U'), ('a', 2, 'a', 'UA')),
put AS (SELECT state, n, reached, replace(replace(put, 'U', 'user:' || chr(10)), 'A', 'assistant:' || chr(10)) AS put FROM ins),
edit(letter, here, initial, after, role, cost) AS (VALUES ('D', 'n', NULL, 'n', NULL, 2), ('D', 's', NULL, 's', NULL, 2), ('D', 'u', NULL, 'u', NULL, 2), ('D', 'a', NULL, 'a', NULL, 2),
  ('R', 'n', NULL, 'u', 'user', 1), ('R', 's', NULL, 'u', 'user', 1), ('R', 'u', NULL, 'a', 'assistant', 1), ('R', 'a', NULL, 'u', 'user', 1),
  ('K', 'n', 's', 's', NULL, 0), ('K', 'n', 'u', 'u', NULL, 0), ('K', 's', 'u', 'u', NULL, 0), ('K', 'u', 'a', 'a', NULL, 0), ('K', 'a', 'u', 'u', NULL, 0)),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 'n' AS state, struct_pack(cost := CAST(0 AS BIGINT), audit := '', done := '') AS best FROM (SELECT DISTINCT conv_id FROM k)
  UNION ALL SELECT conv_id, i, after, min(way) FROM (
    SELECT k.conv_id, k.i, e.after, struct_pack(cost := dp.best.cost + 5 * p.n + e.cost + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END, audit := dp.best.audit || repeat('I', p.n) || letter,
      done := dp.best.done || p.put || CASE WHEN letter = 'D' THEN '' ELSE coalesce(e.role, k.role) || ':' || k.text || chr(10) END) AS way
    FROM dp JOIN k ON k.conv_id IS NOT DISTINCT FROM dp.conv_id AND k.i = dp.i + 1 JOIN put p ON p.state = dp.state JOIN edit e ON e.here = p.reached AND (letter <> 'K' OR e.initial = k.initial) AND (letter = 'D' OR fault IN ('fine', 'truncated'))
  ) GROUP BY conv_id, i, after),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE illegal) AS illegal FROM k GROUP BY conv_id),
ended AS (SELECT n.conv_id, min(struct_pack(cost := best.cost + 5 * p.n, audit := best.audit || repeat('I', p.n), done := best.done || p.put)) AS best
  FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i JOIN put p ON p.state = dp.state AND p.reached IN ('n', 'a') GROUP BY n.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(left(best.done, length(best.done) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM o.conv_id
"""
}
