"""Repair of conversations whose turns are out of order, by the cheapest edits.

A good conversation has an optional system row and then user and assistant in turn, one pair at
least, or no row at all.  Each row's first fault counts: *blank*, *duplicate* (role and text seen
earlier in the conversation) or *truncated* (it doesn't end a sentence).  Edits: keep a row,
give it the role of user or assistant, delete it (a must for blank and duplicate ones), insert an
empty row.

What the edits of a conversation are depends on the sequence of its roles and faults alone.  So
that sequence is written as a compact string, a character a row: its *signature*.  Each
different signature is solved once, by memoised recursion over (row, state of the good
form); the answers are joined back, signatures that a large part of the conversations share
by a broadcast (``hotjoin``), and the edits are replayed on the rows.

Rows of a conversation go through one task in order, as a stream: what is held is a batch, a
byte a row for the signature and the edits of the conversation at hand, and while it is
solved a hundred bytes a row.  Order and a digest of a whole conversation are sequential by nature.

Defined results: a null role or text is one space, so the row is blank or of no known
role; null turns come first; rows of one conversation and turn are in the order of role,
text and copy; a null conversation id is a conversation; repeated rows are duplicates;
columns besides those named are ignored, so their names can't clash; an empty table gives
no rows; conversations and texts are taken whole.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from coppice.llm.hotjoin import joined_back
from coppice.llm.storage import mapped, stored

#: Fixed values of the contract: white space, sentence ends, what edits cost, good neighbours, and out of how many damage is drawn.
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
REROLE, DELETE, INSERT, UNDONE = 3, 4, 3, 3
GOOD_PAIRS = ("su", "ua", "au")
DRAWS = 20

#: Signatures up to this length may be broadcast.
SHORT = 1000

#: States of the good form: nothing yet, after the system row, after a user, after an assistant.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that an edit gives in a state.
GIVES = ("u", "u", "a", "u")
DONE = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Inserts in a row that can pay: any state that can be reached by inserts is reached by two.
_RUN = 2
_NEVER = 1 << 60
#: Rows that the recursion goes down before it meets what is known.
_STRETCH = 64

SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def solve(signature: str) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair, the ASCII-least of equals.

    A character is a row: s, u, a or x for its role's initial, upper case if it is
    truncated, d if it must go.  From one (row, state) no two edits have the same
    initial, so the least string among equals is told by the next initial alone.
    """
    n = len(signature)
    wide = 4 * (_RUN + 1)
    costs, taken = array("q", [-1]) * ((n + 1) * wide), bytearray((n + 1) * wide)

    def least(i: int, q: int, room: int) -> int:
        at = i * wide + q * (_RUN + 1) + room
        if costs[at] >= 0:
            return costs[at]
        best = (0, "") if i == n and q in DONE else (_NEVER, "~")
        given = MOVES[q][GIVES[q]]
        if i < n:
            c = signature[i]
            best = min(best, (DELETE + least(i + 1, q, _RUN), "D"))
            if c != "d":
                undone = UNDONE if c.isupper() else 0
                if c.lower() in MOVES[q]:
                    best = min(best, (undone + least(i + 1, MOVES[q][c.lower()], _RUN), "K"))
                best = min(best, (undone + REROLE + least(i + 1, given, _RUN), "R"))
        if room and best[1]:
            best = min(best, (INSERT + least(i, given, room - 1), "I"))
        costs[at], taken[at] = best[0], ord(best[1] or ".")
        return costs[at]

    for i in range(n, 0, -_STRETCH):  # from the end, so that the recursion never goes deep
        for q in range(4):
            least(i, q, _RUN)
    total = least(0, 0, _RUN)
    edits, i, q, room = [], 0, 0, _RUN
    while (edit := chr(taken[i * wide + q * (_RUN + 1) + room])) != ".":
        edits.append(edit)
        if edit == "K":
            q = MOVES[q][signature[i].lower()]
        elif edit != "D":
            q = MOVES[q][GIVES[q]]
        i, room = (i, room - 1) if edit == "I" else (i + 1, _RUN)
    return total, "".join(edits)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, live): rows as the draw crc32(conv_id:turn) % 20 damages them; a dropped one isn't live."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.encode(F.concat(shown("conv_id"), F.lit(":"), shown("turn")), "utf-8")) % DRAWS
    role = F.when(F.col("draw") == 4, F.lit("user")).otherwise(shown("role"))
    text = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.withColumn("draw", draw).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies, (F.col("draw") != 0).alias("live"))


def faulty(rows: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, turn, role, text, code, gaps, blank, duplicate, truncated, illegal) of each row, in the order of its conversation.

    rows: (conv_id, turn, role, text), and live, false for rows that don't count, which come last and have no code;
    their conversations are there all the same.  code: the row's character of the signature.
    """
    have = rows.columns
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text"), F.col("copy") if "copy" in have else F.lit(0).alias("copy"), F.col("live") if "live" in have else F.lit(True).alias("live"))
    order = [F.col("live").desc(), F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    of_conversation = Window.partitionBy("conv_id").orderBy(*order)
    alike = Window.partitionBy("conv_id", "live", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns({"pos": F.row_number().over(of_conversation), "pair": F.concat(F.lag(initial).over(of_conversation), initial), "step": F.col("turn") - F.lag("turn").over(of_conversation)})
    rows = rows.withColumn("nth", F.row_number().over(alike))
    stripped = F.rtrim(F.col("text"), F.lit(SPACE))
    blank = stripped == ""
    duplicate = ~blank & (F.col("nth") > 1)
    truncated = ~blank & ~duplicate & ~F.substring(stripped, -1, 1).isin(*ENDS)
    live = F.col("live")
    one = lambda c: F.when(live & F.coalesce(c, F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("long")
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    code = F.when(live, F.when(blank | duplicate, F.lit("d")).when(truncated, F.upper(kind)).otherwise(kind))
    return rows.select("conv_id", "pos", "turn", "role", "text", code.alias("code"), F.when(live & (F.col("step") > 1), F.col("step") - 1).otherwise(F.lit(0)).cast("long").alias("gaps"), one(blank).alias("blank"), one(duplicate).alias("duplicate"), one(truncated).alias("truncated"), one(~F.col("pair").isin(*GOOD_PAIRS)).alias("illegal"))


def _in_order(rows: DataFrame, place: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", place)


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def _stretches(column: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
    """Value, begin and end of each stretch of equal values; null is a value."""
    found = pc.run_end_encode(column)
    ends = found.run_ends.to_numpy()
    return found.values.to_pylist(), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, sums of the faults) of each conversation, from ``faulty`` rows."""
    own = _in_order(rows.select("conv_id", "pos", "code", *SUMS), "pos")
    schema = T.StructType([own.schema["conv_id"], T.StructField("signature", T.StringType()), *[T.StructField(s, T.LongType()) for s in SUMS]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, codes, sums, kind = None, None, None, None

        def batch(done: list) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1]), *[pa.array([int(x[k]) for x in columns[2]], pa.int64()) for k in range(len(SUMS))]], names=schema.names)

        for b in batches:
            if not b.num_rows:
                continue
            kind, done = b.column(0).type, []
            values, begins, ends = _stretches(b.column(0))
            code = b.column(2).fill_null("").to_pylist()
            added = np.add.reduceat(np.stack([b.column(3 + k).to_numpy() for k in range(len(SUMS))]), begins, axis=1)
            for k, (value, begin, end) in enumerate(zip(values, begins, ends, strict=True)):
                own_codes = "".join(code[begin:end])
                if codes is not None and _same(value, held):
                    codes.append(own_codes)
                    sums = sums + added[:, k]
                    continue
                if codes is not None:
                    done.append((held, "".join(codes), sums))
                held, codes, sums = value, [own_codes], added[:, k]
            if done:
                yield batch(done)
        if codes is not None:
            yield batch([(held, "".join(codes), sums)])

    return mapped(own, scan, schema)


def solved(conversations: DataFrame) -> DataFrame:
    """(signature, n: conversations with it, audit, cost), each different signature solved once."""
    distinct = conversations.groupBy("signature").agg(F.count("*").alias("n"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [solve(s) for s in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a for _, a in found], pa.string()), pa.array([c for c, _ in found], pa.int64())], names=["signature", "n", "audit", "cost"])

    return mapped(distinct, scan, "signature string, n long, audit string, cost long")


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, faults, cost, audit) of each conversation, from ``faulty`` rows."""
    found = stored(signatures(rows), "signatures")
    answers = stored(solved(found), "solved")
    total = answers.agg(F.sum("n").alias("n")).first().n or 0
    return joined_back(found, answers, "signature", total, F.length("signature") <= SHORT).select("conv_id", *SUMS, "cost", "audit")


def replayed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, edit, turn, role, text): the rows of the repaired conversations; those that were inserted have no turn.

    rows: ``faulty`` ones.  found: (conv_id, audit).  A conversation's edits come before its first row in one stream.
    """
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    first = found.select("conv_id", F.lit(0).alias("pos"), none("turn"), none("role"), none("text"), "audit")
    own = _in_order(first.unionByName(rows.where("code is not null").select("conv_id", "pos", "turn", "role", "text", F.lit(None).cast("string").alias("audit"))), "pos")
    schema = T.StructType([own.schema["conv_id"], T.StructField("position", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, q, place, out, conv = "", 0, 0, 0, [], None

        def put(edit: str, turn, role: str, text: str) -> None:
            nonlocal q, place
            q, place = MOVES[q][role[0]], place + 1
            out.append((conv, place, edit, turn, role, text))

        def inserts() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                put("I", None, ROLES[GIVES[q]], "")
                at += 1

        def batch(kind: pa.DataType) -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()], strict=True)], names=schema.names)
            out.clear()
            return made

        kind = None
        for b in batches:
            kind = b.column(0).type
            for value, pos, turn, role, text, edits in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if pos == 0:
                    inserts()  # those at the end of the conversation before
                    audit, at, q, place, conv = edits, 0, 0, 0, value
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    put(edit, turn, role, text)
                elif edit == "R":
                    put(edit, turn, ROLES[GIVES[q]], text)
            if out:
                yield batch(kind)
        inserts()
        if out:
            yield batch(kind)

    return mapped(own, scan, schema)


def repaired(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired rows (``replayed``) and the audits of all conversations."""
    rows = stored(faulty(conversations), "rows")
    found = stored(audits(rows), "audits")
    return replayed(rows, found), found


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of each conversation's ``role:text``, newline-joined, from (conv_id, position, role, text)."""
    own = _in_order(rows.select("conv_id", "position", "role", "text"), "position")
    schema = T.StructType([own.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, kind = None, None, None
        batch = lambda done: pa.RecordBatch.from_arrays([pa.array([v for v, _ in done], kind), pa.array([h for _, h in done])], names=schema.names)
        for b in batches:
            if not b.num_rows:
                continue
            kind, done = b.column(0).type, []
            lines = [f"{r}:{t}" for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            for value, begin, end in zip(*_stretches(b.column(0)), strict=True):
                more = "\n".join(lines[begin:end])
                if digest is not None and _same(value, held):
                    digest.update(f"\n{more}".encode())
                    continue
                if digest is not None:
                    done.append((held, digest.hexdigest()))
                held, digest = value, hashlib.sha256(more.encode())
            if done:
                yield batch(done)
        if digest is not None:
            yield batch([(held, digest.hexdigest())])

    return mapped(own, scan, schema)


def _null_safe(column: str, a: DataFrame, b: DataFrame) -> Column:
    return a[column].eqNullSafe(b[column])


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """conv_id, faults, cost, audit and the digest of the repaired rows of all conversations, damaged before."""
    rows, found = repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    hashed = digests(rows)
    done = found.join(hashed, _null_safe("conv_id", found, hashed), "left")
    return done.select(found["conv_id"], *SUMS, "cost", "audit", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """The same for DuckDB: crc32 by its table, and the edits row by row from the left, with the best cost and edits of each state."""
    far = 1 << 40
    plus = lambda s, cost, edit: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}'}}"
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    best = lambda xs: f"least({', '.join(xs)})"
    none = f"{{'c': {far}::BIGINT, 'a': ''}}"
    undone = f"CASE WHEN code <> lower(code) THEN {UNDONE} ELSE 0 END"
    keep = lambda s, letter: f"CASE WHEN lower(code) = '{letter}' THEN {plus(s, undone, 'K')} ELSE {none} END"
    give = lambda s: f"CASE WHEN code <> 'd' THEN {plus(s, f'{REROLE} + {undone}', 'R')} ELSE {none} END"
    # After inserts, the states are z0 to z3.
    z = {"z0": "s0", "z1": "s1", "z2": best(["s2", *[plus(s, INSERT, "I") for s in ("s0", "s1", "s3")]]), "z3": best(["s3", plus("s2", INSERT, "I"), plus("s0", 2 * INSERT, "II"), plus("s1", 2 * INSERT, "II")])}
    into = {0: [], 1: [keep("z0", "s")], 2: [f(x) for x in ("z0", "z1", "z3") for f in (lambda s: keep(s, "u"), give)], 3: [keep("z2", "a"), give("z2")]}
    step = ", ".join(f"{best([plus(f'z{q}', DELETE, 'D'), *into[q]])} AS s{q}" for q in range(4))
    return f"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS n))),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT o.*, xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(x)::BIGINT FOR x IN string_split(k, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {DRAWS} AS d FROM o, tab),
r AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE d WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE d <> 0),
p AS (SELECT *, row_number() OVER w AS pos, lag(role[1]) OVER w || role[1] AS pair, turn - lag(turn) OVER w AS step, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, {space}) AS bare
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, bare = '' AS blank, bare <> '' AND nth > 1 AS duplicate, bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS kind FROM p),
c AS (SELECT conv_id, pos, role, text, CASE WHEN blank OR duplicate THEN 'd' WHEN truncated THEN upper(kind) ELSE kind END AS code, CASE WHEN step > 1 THEN step - 1 ELSE 0 END AS gap, blank, duplicate, truncated, coalesce(pair NOT IN ('su', 'ua', 'au'), false) AS illegal FROM f),
g AS (SELECT conv_id, string_agg(code, '' ORDER BY pos) AS sig, sum(gap)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM c GROUP BY conv_id),
dp AS (SELECT DISTINCT sig, 0 AS i, {{'c': 0::BIGINT, 'a': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM g
  UNION ALL SELECT sig, i + 1, {step} FROM (SELECT sig, i, sig[i + 1] AS code, {', '.join(f'{v} AS {k}' for k, v in z.items())} FROM dp WHERE i < length(sig))),
best AS (SELECT sig, least(s0, {z['z3']}) AS b FROM dp WHERE i = length(sig)),
a AS (SELECT g.*, b.c AS cost, b.a AS audit FROM g JOIN best USING (sig)),
e AS (SELECT conv_id, j, audit[j] AS ed, length(replace(audit[1:j], 'I', '')) AS pos FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM a)),
kept AS (SELECT e.conv_id, j, ed, CASE WHEN ed <> 'I' THEN c.role END AS role, CASE WHEN ed <> 'I' THEN c.text ELSE '' END AS text, row_number() OVER (PARTITION BY e.conv_id ORDER BY j) AS place
  FROM e LEFT JOIN c ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.pos = c.pos AND ed <> 'I' WHERE ed <> 'D'),
lead AS (SELECT conv_id, count(*) FILTER (place = 1 AND ed = 'K' AND role[1] = 's') AS head FROM kept GROUP BY conv_id),
lines AS (SELECT kept.conv_id, j, CASE WHEN ed = 'K' THEN role WHEN (place - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text AS line FROM kept JOIN lead ON kept.conv_id IS NOT DISTINCT FROM lead.conv_id),
s AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY j)) AS sha FROM lines GROUP BY conv_id)
SELECT n.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) n LEFT JOIN a ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id
"""


OP13_SQL = _sql()
