"""Repair of conversation structure by lightest derivations in Knuth's order.

A conversation, its rows in the order of their turns (nulls first; equal turns by role, then by a hash of
the row), is edited so that the initials of its roles read ``(s?(ua)+)?``.  Keep costs 0, Rerole (to user or assistant) 2,
Delete 3, Insert (an empty user or assistant turn, anywhere) 2; blank and duplicate rows must be
deleted; a truncated row that stays adds 1.

As a weighted deduction system: the item (i, q) says that the first i rows are repaired and the role
before state q was written (0 nothing, 1 system, 2 user, 3 assistant).  The edits of a row are axioms
whose value is (cost, letter); a rule joins the item (i, q) with an edit of row i that q allows into
(i + 1, q'), or with an Insert into (i, q'); stretches of rows are items of their own, (q, q') with a
value, and a rule joins (i, q) with the stretch that begins at i.  A rule's value is
(sum of costs, joined audits): never less than that of an antecedent and monotone in each, as two audits
of one item with equal cost are never beginnings of each other.  So Knuth's agenda pops items in the
order of (cost, audit), the first pop of an item is its lightest derivation, and it ends when a goal item,
(n, 0) or (n, 3), is popped.  Ties fall to the least audit in ASCII order.

On Spark: rows become narrow (role's initial, fault, hashes of role and text), equal rows one with a count;
duplicates are told by the first turn of each (conversation, hash).  The narrow rows are sorted by
ranges of (conversation, turn), so that a conversation of any size spreads over tasks.  Conversations inside a
range are solved there (their kinds of rows, as a short string, in a cache); the stretch of one that may
cross a border gives its table (q, q') -> (cost, audit), and the tables of a conversation are joined by
the same agenda.  Long stretches are deduced in chunks, and the beginning that all live audits share
is set aside, so a chunk's strings stay short.  Texts are shuffled once, to be written out by
audit; each conversation is streamed through one task, row by row, because its digest (SHA-256) can
only be taken in order.  The audit of a conversation is one value of a row and so bounds it (2 GB).

Defined results: a null role, text, id or turn counts as one space where text is asked for (so a
null text is blank); null ids form one conversation; repeated rows are rows of their own (the later
ones duplicates); roles with other initials must be reroled or deleted; a conversation without rows
has cost 0 and an empty audit; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm.common import join_keys, read, stored

CHUNK = 256             # rows deduced at once
CACHE = 100_000         # kinds of conversations whose repair a Python worker remembers
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
AFTER = {"s": 1, "u": 2, "a": 3}
BEFORE = {"s": (0,), "u": (0, 1, 3), "a": (2,)}     # states that allow the initial next

Value = tuple[int, str]
Rules = dict[int, list[tuple[int, int, str]]]       # state -> (state, cost, audit)


def edits(kind: str) -> Rules:
    """The edits of a row: d must go; s, u, a, x an initial (x: another), in upper case if truncated."""
    out: Rules = {q: [(q, 3, "D")] for q in range(4)}
    if kind == "d":
        return out
    more, initial = int(kind.isupper()), kind.lower()
    for q in BEFORE.get(initial, ()):
        out[q].append((AFTER[initial], more, "K"))
    for role in "ua":
        if role != initial:
            for q in BEFORE[role]:
                out[q].append((AFTER[role], 2 + more, "R"))
    return out


EDITS = {k: edits(k) for k in "dsuaxSUAX"}
INSERTS: Rules = {0: [(2, 2, "I")], 1: [(2, 2, "I")], 3: [(2, 2, "I")], 2: [(3, 2, "I")]}
GOALS = (0, 3)


def agenda(layers: list[Rules], values: dict[int, Value], inserts: Rules, goals: tuple[int, ...] = ()) -> dict[int, Value]:
    """Lightest derivations of the items after the last layer (only the first goal, if goals are given),
    from the values of the items before the first."""
    heap = [(c, a, 0, q) for q, (c, a) in values.items()]
    heapq.heapify(heap)
    final: set[tuple[int, int]] = set()
    out: dict[int, Value] = {}
    n = len(layers)
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == n:
            out[q] = cost, audit
            if q in goals:
                return {q: out[q]}
        else:
            for r, c, a in layers[i].get(q, ()):
                if (i + 1, r) not in final:
                    heapq.heappush(heap, (cost + c, audit + a, i + 1, r))
        for r, c, a in inserts.get(q, ()):
            if (i, r) not in final:
                heapq.heappush(heap, (cost + c, audit + a, i, r))
    return out


def table(kinds: str, state: int) -> dict[int, Value]:
    """The lightest derivations of a stretch of rows from one state to each."""
    values, settled = {state: (0, "")}, []
    for k in range(0, max(1, len(kinds)), CHUNK):
        values = agenda([EDITS[c] for c in kinds[k: k + CHUNK]], values, INSERTS)
        # after (ua)+ all goes on that could go on before it, but for a kept system row (at most 3 more)
        if 0 in values and values[0][0] > values[3][0] + 3:
            del values[0]
        if 1 in values and values[1][0] > values[3][0]:
            del values[1]
        same = os.path.commonprefix([a for _, a in values.values()])
        settled.append(same)
        values = {q: (c, a[len(same):]) for q, (c, a) in values.items()}
    begin = "".join(settled)
    return {q: (c, begin + a) for q, (c, a) in values.items()}


_KEPT: dict[str, Value] = {}


def whole(kinds: str) -> Value:
    """(cost, audit) of a whole conversation."""
    if kinds not in _KEPT:
        if len(_KEPT) >= CACHE:
            _KEPT.clear()
        if len(kinds) <= CHUNK:
            got = agenda([EDITS[c] for c in kinds], {0: (0, "")}, INSERTS, GOALS)
        else:
            got = table(kinds, 0)
        value = min(got[q] for q in GOALS if q in got)
        if len(kinds) > CHUNK:
            return value
        _KEPT[kinds] = value
    return _KEPT[kinds]


def join_tables(tables: list[list[dict]]) -> Value:
    """(cost, audit) of a conversation from the tables of its stretches."""
    values: dict[int, Value] = {0: (0, "")}
    for t in tables:
        rules: Rules = {}
        for x in t:
            rules.setdefault(x["q"], []).append((x["r"], x["cost"], x["audit"]))
        values = agenda([rules], values, {})
    return min(values[q] for q in GOALS if q in values)


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of the conversations of one sorted range.  Columns in: conv, initial, fault (o, b, d, t), n."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    conv_type = None
    rows: list[tuple] = []
    live: dict | None = None
    first = True

    def close(edge: bool) -> None:
        kinds, counts = "".join(live["kinds"]), live["counts"]
        cost, audit, stretch = None, None, None
        if edge:
            stretch = [{"q": q, "r": r, "cost": c, "audit": a} for q in range(4) for r, (c, a) in table(kinds, q).items()]
        else:
            cost, audit = whole(kinds)
        rows.append((live["conv"], part, counts["b"], counts["d"], counts["t"], live["illegal"], live["first"], live["last"],
                     cost, audit, stretch))

    def made() -> pa.RecordBatch:
        cols = list(zip(*rows))
        kinds = [conv_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                 pa.string(), TABLE]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=list(SEGMENT))

    for b in batches:
        conv_type = b.column(0).type
        for conv, initial, fault, n in zip(*(b.column(i).to_pylist() for i in range(4))):
            if live is None or conv != live["conv"]:
                if live is not None:
                    close(first)
                    first = False
                live = {"conv": conv, "kinds": [], "counts": dict.fromkeys("obdt", 0), "illegal": 0, "first": initial, "last": None}
            if live["last"] is not None and live["last"] + initial not in LEGAL:
                live["illegal"] += 1
            live["illegal"] += (n - 1) * (initial * 2 not in LEGAL)
            live["last"] = initial
            kind = initial if initial in AFTER else "x"
            live["kinds"].append("d" if fault in "bd" else kind.upper() if fault == "t" else kind)
            live["counts"][fault] += 1
            if n > 1:                                   # its copies: blank as well, or duplicates
                live["kinds"].append("d" * (n - 1))
                live["counts"]["b" if fault == "b" else "d"] += n - 1
        if len(rows) >= 1000:
            yield made()
    if live is not None:
        close(True)
    if rows:
        yield made()


TABLE = pa.list_(pa.struct([("q", pa.int32()), ("r", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
SEGMENT = {"conv": "", "part": "int", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "first": "string",
           "last": "string", "cost": "long", "audit": "string", "stretch": "array<struct<q:int,r:int,cost:long,audit:string>>"}
FOUND = ("blank", "duplicate", "truncated", "illegal", "cost", "audit")


def joined(t: pa.Table) -> pa.Table:
    """One conversation from its stretches in the order of their ranges (as many as the ranges it crosses)."""
    rows = sorted(t.to_pylist(), key=lambda r: r["part"])
    cost, audit = join_tables([r["stretch"] for r in rows])
    illegal = sum(r["illegal"] for r in rows) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows, rows[1:]))
    out = {"conv": [rows[0]["conv"]], **{c: [sum(r[c] for r in rows)] for c in FOUND[:3]},
           "illegal": [illegal], "cost": [cost], "audit": [audit]}
    return pa.table({c: pa.array(v, t.schema.field("conv").type if c == "conv" else pa.string() if c == "audit" else pa.int64())
                     for c, v in out.items()})


def clean(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with a space for a null role or text."""
    one = F.lit(" ")
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, one).alias("role"), F.coalesce(text, one).alias("text"))


ORDER = ["turn", "role", "h1", "h2"]        # of the rows of a conversation


def hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64("text", "role", F.lit(7)))


def faults(rows: DataFrame) -> DataFrame:
    """For each conversation: blank, duplicate, truncated, illegal, cost, audit.  ``rows`` as :func:`clean` gives them."""
    kind = rows.schema["conv"].dataType.simpleString()
    body = F.rtrim("text", F.lit(SPACE))
    few = hashed(rows.withColumn("blank", body == "").withColumn("cut", ~F.right(body, F.lit(1)).isin(".", "!", "?")))
    few = few.groupBy("conv", "turn", "role", "h1", "h2", "blank", "cut").agg(F.count("*").alias("n"))
    few = stored(few, "turns")
    again = few.groupBy("conv", "h1", "h2").agg(F.count("*").alias("turns"), F.min("turn").alias("first"),
                                                F.bool_or(F.col("turn").isNull()).alias("none"))
    again = again.where("turns > 1").select("h1", "h2", "conv", "first", "none")
    few = join_keys(few, again, ["h1", "h2", "conv"])
    late = F.coalesce(F.col("turn").isNotNull() & (F.col("none") | (F.col("turn") > F.col("first"))), F.lit(False))
    fault = F.when(F.col("blank"), "b").when(late, "d").when(F.col("cut"), "t").otherwise("o")
    few = few.select("conv", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "n", *ORDER)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = few.repartitionByRange(parts, "conv", *ORDER).sortWithinPartitions("conv", *ORDER).select("conv", "initial", "fault", "n")
    found = stored(few.mapInArrow(segments, ", ".join(f"{c} {t or kind}" for c, t in SEGMENT.items())), "stretches")
    inside = found.where("stretch is null").select("conv", *FOUND)
    across = found.where("stretch is not null").groupBy("conv").applyInArrow(
        joined, f"conv {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    return inside.unionByName(across)


def write_out(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From (conv, audit or None, role, text) in order, a conversation's audit before its rows: for each
    conversation (conv, None, None) and then (conv, role, text) of its repaired rows."""
    conv, audit, at, state = None, None, 0, 0

    def inserts() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, at = (3 if state == 2 else 2), at + 1
            yield conv, "assistant" if state == 3 else "user", ""

    for this, given, role, text in rows:
        if given is not None:
            if audit is not None:
                yield from inserts()
                if at != len(audit):
                    raise ValueError(f"conversation {conv!r}: {len(audit) - at} edits without a row")
            conv, audit, at, state = this, given, 0, 0
            yield conv, None, None
            continue
        yield from inserts()
        if this != conv or at >= len(audit):
            raise ValueError(f"conversation {this!r}: a row without an edit")
        edit, at = audit[at], at + 1
        if edit == "D":
            continue
        if edit == "R":
            role = "assistant" if state == 2 else "user"
        state = AFTER[role[0]]
        yield conv, role, text
    if audit is not None:
        yield from inserts()
        if at != len(audit):
            raise ValueError(f"conversation {conv!r}: {len(audit) - at} edits without a row")


def with_audits(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows and, before each conversation's, its row of ``heads`` (conv, head struct), dealt out by conversation."""
    kind = heads.schema["head"].dataType
    left = heads.select("conv", F.lit(0).alias("kind"), "head", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text")],
                        F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
    right = hashed(rows).select("conv", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("head"), "turn", "role", "text", "h1", "h2")
    return (left.unionByName(right).repartition("conv").sortWithinPartitions("conv", "kind", *ORDER)
            .select("conv", "head", "role", "text"))


def _tuples(batches: Iterator[pa.RecordBatch], seen: list) -> Iterator[tuple]:
    """(conv, audit, role, text); heads go to ``seen`` as they pass."""
    for b in batches:
        for conv, head, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            if head is not None:
                seen.append((conv, head))
            yield conv, head and head["audit"], role, text


def repaired(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The repaired conversations: (conv, place, role, text)."""
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, conv_type = [], 0, None

        def typed(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal conv_type
            for b in bs:
                conv_type = b.column(0).type
                yield b

        def made() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (conv_type, pa.int64(), pa.string(), pa.string()))],
                                              names=["conv", "place", "role", "text"])

        for conv, role, text in write_out(_tuples(typed(batches), [])):
            if role is None:
                place = 0
                continue
            out.append((conv, place, role, text))
            place += 1
            if len(out) >= 500:
                yield made()
        if out:
            yield made()

    return with_audits(rows, heads).mapInArrow(run, f"conv {kind}, place long, role string, text string")


def digests(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The heads' fields and the SHA-256 of each repaired conversation's ``role:text`` lines."""
    kind = rows.schema["conv"].dataType.simpleString()
    fields = heads.schema["head"].dataType
    names = fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen, types = [], [], None
        sha, lines = None, 0

        def typed(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal types
            for b in bs:
                types = [b.column(0).type, *(b.column(1).type.field(c).type for c in names), pa.string()]
                yield b

        def close() -> None:
            conv, head = seen.pop(0)
            out.append((conv, *(head[c] for c in names), sha.hexdigest()))

        def made() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["conv", *names, "sha256"])

        for _conv, role, text in write_out(_tuples(typed(batches), seen)):
            if role is None:
                if sha is not None:
                    close()
                    if len(out) >= 1000:
                        yield made()
                sha, lines = hashlib.sha256(), 0
                continue
            sha.update(f"{chr(10) * (lines > 0)}{role}:{text}".encode())
            lines += 1
        if sha is not None:
            close()
        if out:
            yield made()

    cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return with_audits(rows, heads).mapInArrow(run, f"conv {kind}, {cols}, sha256 string")


def summary(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv, head) for every conversation in ``ids``; head: gaps, faults, cost and audit of its ``rows``."""
    span = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    known = faults(rows).unionByName(ids.select("conv").distinct(), allowMissingColumns=True).unionByName(span, allowMissingColumns=True)
    got = known.groupBy("conv").agg(F.max("gaps").alias("gaps"), *[F.max(c).alias(c) for c in FOUND])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return got.select("conv", F.struct(*[zero(c) for c in ("gaps", *FOUND[:5])], F.coalesce("audit", F.lit("")).alias("audit")).alias("head"))


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to rows (conv, turn, role, text), by crc32 of ``conv:turn`` mod 20."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = (F.crc32(F.concat_ws(":", word("conv"), word("turn")).cast("binary")) % 20).alias("code")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (rows.select("*", code).where("code <> 0").withColumn("text", text)
            .withColumn("role", F.when(F.col("code") == 4, "user").otherwise(F.col("role")))
            .withColumn("_time", F.explode(times)).drop("code", "_time"))


def q_op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean(read(spark, sf_dir, "conversations"))
    hurt = damaged(rows)
    heads = stored(summary(rows, hurt), "heads")
    return digests(hurt, heads).withColumnsRenamed({"conv": "conv_id", "sha256": "repaired_sha256"})


def sql_op12() -> str:
    """The same by a plain recursion over rows: the least (cost, audit, text) of each state."""
    step = "(SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) FROM range(256) t(i))"
    word = "'[^\\x20\\x09-\\x0D]'"
    nl = "CASE WHEN {v}.n = 0 THEN '' ELSE chr(10) END"

    def put(v: str, cost: str, letter: str, line: str | None) -> str:
        text = f"{v}.t" if line is None else f"{v}.t || {nl.format(v=v)} || {line}"
        return f"{{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}', 't': {text}, 'n': {v}.n + {0 if line is None else 1}}}"

    def least(*xs: str) -> str:
        return f"list_min([{', '.join(xs)}])"

    ins = lambda v, role: put(v, "2", "I", f"'{role}:'")
    # states before the row, with inserts
    e2 = least("s2", ins("s0", "user"), ins("s1", "user"), ins("s3", "user"))
    closed = f"SELECT *, {least('s3', ins('e2', 'assistant'))} AS e3 FROM (SELECT *, {e2} AS e2 FROM %s)"
    big = "{'c': 1000000000, 'a': '', 't': '', 'n': 0}"
    keep = lambda v, initial: f"CASE WHEN must OR i <> '{initial}' THEN {big} ELSE {put(v, 'tr', 'K', 'line')} END"
    rerole = lambda v, role: f"CASE WHEN must THEN {big} ELSE " + put(v, "2 + tr", "R", f"('{role}:' || text)") + " END"
    to = lambda v, role: [keep(v, role[0]), rerole(v, role)]
    n0, n1 = put("s0", "3", "D", None), least(put("s1", "3", "D", None), keep("s0", "s"))
    n2 = least(put("e2", "3", "D", None), *to("s0", "user"), *to("s1", "user"), *to("e3", "user"))
    n3 = least(put("e3", "3", "D", None), *to("e2", "assistant"))
    return f"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT {step} AS ct),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..') AS hx FROM conversations),
k AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(hx, lambda b: ('0x' || b)::BIGINT)),
  lambda c, b: xor(c >> 8, ct[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS code FROM c, tab),
h AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
  CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, range(2) r(again) WHERE code <> 0 AND (again = 0 OR code = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM h),
f AS (SELECT *, left(role, 1) AS i, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS nx,
  CASE WHEN NOT regexp_matches(text, {word}) THEN 'b'
       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'd'
       WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE 'o' END AS fault FROM o),
r AS MATERIALIZED (SELECT conv_id, p, i, role || ':' || text AS line, text, fault IN ('b', 'd') AS must, (fault = 't')::INT AS tr FROM f),
x AS (
  SELECT conv_id, 0::BIGINT AS p, {{'c': 0, 'a': '', 't': '', 'n': 0}} AS s0, {big} AS s1, {big} AS s2, {big} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, p, {n0}, {n1}, {n2}, {n3} FROM ({closed % "(SELECT x.conv_id, r.p, s0, s1, s2, s3, i, line, text, must, tr FROM x JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.p = x.p + 1)"})),
z AS (SELECT conv_id, {least("s0", "e3")} AS v FROM ({closed % "(SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) = 1)"})),
g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (nx IS NOT NULL AND i || nx NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, v.c::BIGINT AS cost, v.a AS audit,
  sha256(v.t) AS repaired_sha256
FROM z LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id"""
