"""Conversation structure repair: rank-convergence parallel Viterbi over turns.

A conversation is a chain of rows; edits (keep, re-role, delete, insert) turn its
roles into ``(s?(ua)+)?`` at the least cost. The cost to finish from each automaton
state is a min-plus product of one small matrix per row, so it can be computed in
chunks: rows are range-sorted over the cluster and cut into chunks of bounded size,
each chunk sweeps backwards from a speculative cost vector, and fix-up passes sweep
those chunks again whose following vector turns out to differ from the speculated
one by more than a constant. Vectors converge after a few rows, so a pass or two
suffice however long a conversation is. The stitched backward costs then drive a
forward trace that takes the least edit in ASCII order among the cheapest; chunks
trace from all four states at once and the true one is picked by composing maps.

Only conversations that cross a chunk's end take part in the passes. Identical rows
of a conversation are counted before they are sorted, so copies do not pile up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from .shared import join_skewed, materialize, parts, small_batches

#: Rows (of different content) and characters of text of a chunk at most; one longer row is a chunk of its own.
CHUNK_ROWS, CHUNK_CHARS = 1024, 1 << 17
#: Costs of edits: keep, re-role, delete, insert, and an undeleted truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Automaton states: start, after system, after user, after assistant; the first and last accept.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that must come next, and so the one that an insertion or re-role gives, by state.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
FAR = 1 << 60
FINAL = (0, FAR, FAR, 0)
BLANK, DUPLICATE, CUT = 1, 2, 3  # faults of a row; 0: none
LEGAL = {"su", "ua", "au"}


def settled(cost: Iterable[int]) -> tuple[int, ...]:
    """Costs to finish where insertions are allowed, too (two insertions lead from any state to any other that follows)."""
    c = list(cost)
    for _ in range(3):
        c = [min(c[q], c[NEXT[q][1]] + INSERT) for q in range(4)]
    return tuple(min(x, FAR) for x in c)


@cache
def edits(initial: str, fault: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the edits of a row without insertions, in ASCII order: (letter, cost, next state)."""
    out = []
    for q in range(4):
        options = [("D", DELETE, q)]
        if fault in (0, CUT):
            more = TRUNCATED * (fault == CUT)
            if (q, initial) in STEPS:
                options.append(("K", more, STEPS[q, initial]))
            options.append(("R", REROLE + more, NEXT[q][1]))
        out.append(tuple(options))
    return tuple(out)


@cache
def before(initial: str, fault: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row from those after it."""
    return settled(min(cost + after[to] for _, cost, to in edits(initial, fault)[q]) for q in range(4))


def sweep(rows: list[tuple[str, int]], after: tuple[int, ...]) -> tuple[list[tuple[int, ...]], list[int]]:
    """Cost vectors at every place between rows, from the first to the last, each less its least entry, and those least
    entries: the vector at place k counts from sum(least[k:]) beyond ``after``."""
    vectors, least = [after], [0]
    for initial, fault in reversed(rows):
        v = before(initial, fault, vectors[-1])
        low = min(v)
        vectors.append(tuple(min(x - low, FAR) if x < FAR else FAR for x in v))
        least.append(low)
    return vectors[::-1], least[::-1]


def trace(rows: list[tuple[str, int]], vectors: list[tuple[int, ...]], least: list[int], state: int, last: bool) -> tuple[str, int]:
    """The least audit among the cheapest edits from ``state``, and the state after it."""
    audit = []
    for k in range(len(rows) + 1):
        if k == len(rows) and not last:  # insertions there belong to the next chunk
            break
        while True:
            here, step = vectors[k][state], None
            if k < len(rows):
                step = next(((letter, to) for letter, cost, to in edits(*rows[k])[state] if cost + vectors[k + 1][to] - least[k] == here), None)
                if step and step[0] == "D":
                    break
            elif state in (START, ASSISTANT) and here == FINAL[state]:
                break
            to = NEXT[state][1]
            if vectors[k][to] < FAR and INSERT + vectors[k][to] == here:
                audit.append("I")
                state = to
                continue
            break
        if k < len(rows):
            audit.append(step[0])
            state = step[1]
    return "".join(audit), state


def repaired(roles: list[str], texts: list[str], audit: str, state: int) -> Iterator[str]:
    """``role:text`` of the rows that remain, insertions included."""
    k = 0
    for letter in audit:
        role, text = NEXT[state][0], ""
        if letter != "I":
            text = texts[k]
            if letter == "K":
                role = roles[k]
            k += 1
        if letter != "D":
            state = STEPS[state, role[:1]]
            yield f"{role}:{text}"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, _conv, turn, role, text, n): rows dropped, emptied, cut, repeated or re-roled by a hash of their place;
    identical rows of a conversation are counted. Null roles and texts are one space; so is a null in the hashed place."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spelled("conv_id"), spelled("turn")).cast("binary")) % 20
    text, role = spelled("text"), spelled("role")
    out = rows.select(
        "conv_id", spelled("conv_id").alias("_conv"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(kind == 3, 2).otherwise(1).alias("_n"), kind.alias("_kind"),
    )
    return out.where("_kind > 0").groupBy("conv_id", "_conv", "turn", "role", "text").agg(F.sum("_n").alias("n"))


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with the first fault of each row's first copy: blank, duplicate of an earlier row, truncated, or none."""
    spaces = r"[\x20\x09-\x0D]"
    keyed = materialize(rows.withColumn("_same", F.unhex(F.sha2(F.to_json(F.array("_conv", "role", "text")), 256))), "turns")
    place = F.coalesce(F.col("turn"), F.lit(-(2**63)))  # nulls come first
    # texts that a conversation repeats, hot ones by broadcast
    again = materialize(keyed.groupBy("_same").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1"), "repeated-turns")
    once = keyed.join(again.select("_same"), "_same", "left_anti").withColumn("_later", F.lit(False)) if not again.isEmpty() else keyed.withColumn("_later", F.lit(False))
    if not again.isEmpty():
        once = once.unionByName(join_skewed(keyed, again, "_same", "_rows").withColumn("_later", place > F.col("_first")).drop("_first"))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("_later"), DUPLICATE).when(~F.col("text").rlike(rf"[.!?]{spaces}*\z"), CUT).otherwise(0)
    return once.withColumn("fault", fault).drop("_same", "_later")


def _chunks(chunk_rows: int, schema: pa.Schema):
    """Cuts sorted rows into chunks: runs of one conversation inside a task, bounded in rows and characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, chars, now, own = TaskContext.get().partitionId(), 0, [], 0, None, None

        def chunk() -> pa.RecordBatch:
            turns, roles, texts, faults, copies = (list(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([v], schema.field(k).type) for k, v in enumerate((own, now, part, seq, turns, roles, texts, faults, copies))], schema=schema)

        for batch in batches:
            for conv_id, conv, turn, role, text, n, fault in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "_conv", "turn", "role", "text", "n", "fault")], strict=True):
                if held and (conv != now or len(held) >= chunk_rows or chars + len(text) > CHUNK_CHARS):
                    yield chunk()
                    held, chars, seq = [], 0, seq + 1
                now, own = conv, conv_id
                held.append((turn, role, text, fault, n))
                chars += len(text)
        if held:
            yield chunk()

    return run


def opened(roles: list[str], texts: list[str], faults: list[int], copies: list[int]) -> tuple[list[str], list[str], list[tuple[str, int]]]:
    """A chunk's rows one by one: copies after the first are blank or duplicates."""
    out_roles, out_texts, rows = [], [], []
    for role, text, fault, n in zip(roles, texts, faults, copies, strict=True):
        out_roles += [role] * n
        out_texts += [text] * n
        rows += [(role[:1], fault), *[(role[:1], BLANK if fault == BLANK else DUPLICATE)] * (n - 1)]
    return out_roles, out_texts, rows


SUMMARY = (
    "_conv string, part int, seq int, blank long, duplicate long, truncated long, illegal long, low long, high long, n_turns long, first_initial string, last_initial string, "
    "start_vector array<long>, spent long, audit string, repaired_sha256 string, first_turn long, last_turn long"
)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk its counts and, as if it were a whole conversation, its answer; the sweep starts from the final costs."""
    schema = pa.schema([(f.split()[0], _KIND[f.split()[1]]) for f in SUMMARY.split(", ")])
    for batch in batches:
        out = []
        for conv, part, seq, turns, roles, texts, faults, copies in zip(*[batch.column(c).to_pylist() for c in ("_conv", "part", "seq", "turns", "roles", "texts", "faults", "copies")], strict=True):
            roles, texts, rows = opened(roles, texts, faults, copies)
            pairs = sum(a[0] + b[0] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
            known = sorted({t for t in turns if t is not None})
            vectors, least = sweep(rows, settled(FINAL))
            audit, _ = trace(rows, vectors, least, START, True)
            digest = hashlib.sha256("\n".join(repaired(roles, texts, audit, START)).encode("utf-8", "surrogatepass")).hexdigest()
            count = [sum(f == kind for _, f in rows) for kind in (BLANK, DUPLICATE, CUT)]
            ends = (known[0], known[-1]) if known else (None, None)
            out.append((conv, part, seq, *count, pairs, *ends, len(known), rows[0][0], rows[-1][0], list(vectors[0]), sum(least), audit, digest, *ends))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)


_KIND = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}

SWEPT = "_conv string, part int, seq int, used array<long>, start_vector array<long>, spent long"


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps chunks again from the vectors that follow them."""
    for batch in batches:
        out = []
        for conv, part, seq, after, roles, texts, faults, copies in zip(*[batch.column(c).to_pylist() for c in ("_conv", "part", "seq", "used", "roles", "texts", "faults", "copies")], strict=True):
            vectors, least = sweep(opened(roles, texts, faults, copies)[2], tuple(after))
            out.append((conv, part, seq, after, list(vectors[0]), sum(least)))
        schema = pa.schema([(f.split()[0], _KIND[f.split()[1]]) for f in SWEPT.split(", ")])
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each chunk's trace leads from each state (-1 where it cannot start)."""
    for batch in batches:
        out = []
        for conv, part, seq, after, last, roles, texts, faults, copies in zip(*[batch.column(c).to_pylist() for c in ("_conv", "part", "seq", "used", "last", "roles", "texts", "faults", "copies")], strict=True):
            rows = opened(roles, texts, faults, copies)[2]
            vectors, least = sweep(rows, tuple(after))
            out.append((conv, part, seq, [trace(rows, vectors, least, q, last)[1] if vectors[0][q] < FAR else -1 for q in range(4)]))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out]), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.list_(pa.int32()))], ["_conv", "part", "seq", "leads"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and repaired lines of each chunk from its true state."""
    for batch in batches:
        out = []
        for conv, part, seq, after, last, state, roles, texts, faults, copies in zip(*[batch.column(c).to_pylist() for c in ("_conv", "part", "seq", "used", "last", "state", "roles", "texts", "faults", "copies")], strict=True):
            roles, texts, rows = opened(roles, texts, faults, copies)
            vectors, least = sweep(rows, tuple(after))
            audit, _ = trace(rows, vectors, least, state, last)
            lines = list(repaired(roles, texts, audit, state))
            out.append((conv, part, seq, audit, "\n".join(lines), len(lines)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out]), *[pa.array([r[k] for r in out], pa.int32()) for k in (1, 2)], pa.array([r[3] for r in out]), pa.array([r[4] for r in out]), pa.array([r[5] for r in out], pa.int64())], ["_conv", "part", "seq", "audit", "block", "lines"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's blocks, which come in order; one block is in memory at a time."""
    now, digest, any_yet = None, None, False
    for batch in batches:
        for conv, block, lines in zip(*[batch.column(c).to_pylist() for c in ("_conv", "block", "lines")], strict=True):
            if conv != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["_conv", "repaired_sha256"])
                now, digest, any_yet = conv, hashlib.sha256(), False
            if lines:
                digest.update((("\n" if any_yet else "") + block).encode("utf-8", "surrogatepass"))
                any_yet = True
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["_conv", "repaired_sha256"])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each chunk of a conversation starts; chunks come in order, four numbers each."""
    now, state = None, START
    for batch in batches:
        rows = list(zip(*[batch.column(c).to_pylist() for c in ("_conv", "part", "seq", "leads")], strict=True))
        out = []
        for conv, part, seq, leads in rows:
            if conv != now:
                now, state = conv, START
            out.append((conv, part, seq, state))
            state = leads[state]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out]), *[pa.array([r[k] for r in out], pa.int32()) for k in (1, 2, 3)]], ["_conv", "part", "seq", "state"])


def chunked(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row for each chunk: (conv_id, _conv, part, seq, turns, roles, texts, faults, copies), sorted by (part, seq)."""
    kind = rows.schema["conv_id"].dataType
    schema = StructType.fromDDL("conv_id long, _conv string, part int, seq int, turns array<long>, roles array<string>, texts array<string>, faults array<int>, copies array<long>")
    schema = StructType([StructField("conv_id", kind), *schema.fields[1:]])
    from pyspark.sql.pandas.types import to_arrow_schema

    order = ["_conv", F.col("turn").asc_nulls_first(), "role", "text"]
    spread = materialize(rows, "faulty-turns").repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(small_batches(spread.select("conv_id", "_conv", "turn", "role", "text", "n", "fault")).mapInArrow(_chunks(chunk_rows, to_arrow_schema(schema)), schema), "turn-chunks")


def converged(chunks: DataFrame, summary: DataFrame, counts: list[int] | None = None) -> DataFrame:
    """(_conv, part, seq, used, last, start_vector, spent) of chunks whose conversations have several, when every vector
    equals, but for a constant, the one that its follower gives. ``counts`` gets the chunks each pass swept again."""
    order = Window.partitionBy("_conv").orderBy("part", "seq")  # a row for each chunk
    final = F.array(*[F.lit(x) for x in settled(FINAL)]).cast("array<long>")
    now = summary.select("_conv", "part", "seq", "start_vector", "spent", final.alias("used"))
    while True:
        follows = now.withColumn("_next", F.lead("start_vector").over(order))
        told = materialize(follows.select("*", F.coalesce("_next", final).alias("after"), F.col("_next").isNull().alias("last")).drop("_next"), "chunk-vectors")
        stale = told.where("after != used")
        n = stale.count()
        if counts is not None:
            counts.append(n)
        if not n:
            return told.drop("after")
        again = chunks.join(stale.select("_conv", "part", "seq", F.col("after").alias("used")), ["_conv", "part", "seq"]).mapInArrow(_swept, SWEPT)
        now = told.where("after = used").select("_conv", "part", "seq", "start_vector", "spent", "used").unionByName(again)


def several(chunks: DataFrame, summary: DataFrame, counts: list[int] | None = None) -> DataFrame:
    """(_conv, cost, audit, repaired_sha256) of conversations that have several chunks."""
    at = ["_conv", "part", "seq"]
    told = materialize(converged(chunks, summary, counts), "chunk-costs")
    n = parts(chunks.sparkSession)
    swept = chunks.join(told.select(*at, "used", "last"), at)
    leads = materialize(swept.mapInArrow(_maps, "_conv string, part int, seq int, leads array<int>"), "chunk-maps")
    states = materialize(leads.repartition(n, "_conv").sortWithinPartitions(*at).mapInArrow(_composed, "_conv string, part int, seq int, state int"), "chunk-states")
    traced = materialize(swept.join(states, at).mapInArrow(_traced, "_conv string, part int, seq int, audit string, block string, lines long"), "chunk-audits")
    digests = traced.select(*at, "block", "lines").repartition(n, "_conv").sortWithinPartitions(*at).mapInArrow(_hashed, "_conv string, repaired_sha256 string")
    audits = traced.groupBy("_conv").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "audit"))), lambda x: x["audit"])).alias("audit"))
    # the first chunk's cost from the start state, and what all chunks count from
    costs = told.groupBy("_conv").agg((F.min_by(F.get("start_vector", F.lit(START)), F.struct("part", "seq")) + F.sum("spent")).alias("cost"))
    return costs.join(audits, "_conv").join(digests, "_conv")


def repair(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS, passes: list[int] | None = None, damage: bool = True) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation.

    Rows of one turn are ordered by role and text. A row whose role is empty cannot be kept. A null conv_id is a
    conversation like any other; an empty table gives no rows. ``passes`` gets the number of chunks that each fix-up pass
    swept again; ``damage=False`` takes the rows as they are. The audit and the digest of one conversation are one string
    and one hash: whatever its length, both are made from chunks in order, a chunk in memory at a time but for the audit.
    """
    source = conversations.select("conv_id", "turn", "role", "text")
    if damage:
        rows = damaged(source)
    else:
        spelled = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
        rows = source.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("_conv"), F.col("turn").cast("long").alias("turn"), *spelled).groupBy("conv_id", "_conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    chunks = chunked(with_faults(rows), chunk_rows)
    summary = materialize(chunks.mapInArrow(_summary, SUMMARY), "chunk-summaries")
    counts = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    order = Window.partitionBy("_conv").orderBy("part", "seq")
    edge = summary.withColumns({"_initial": F.lag("last_initial").over(order), "_turn": F.last("last_turn", True).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    met = F.when(F.col("_initial").isNull() | F.concat("_initial", "first_initial").isin(*sorted(LEGAL)), 0).otherwise(1)
    told = edge.groupBy("_conv").agg(
        *counts, (F.sum("illegal") + F.sum(met)).alias("illegal"), F.count(F.lit(1)).alias("_chunks"),
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("n_turns") - F.when(F.col("_turn") == F.col("first_turn"), 1).otherwise(0)), F.lit(0)).alias("gaps"),
        F.any_value("audit").alias("audit"), F.any_value("repaired_sha256").alias("repaired_sha256"), F.any_value(F.get("start_vector", F.lit(START)) + F.col("spent")).alias("cost"),
    )
    told = materialize(told, "conversation-counts")
    done = told.where("_chunks = 1")
    many = told.where("_chunks > 1").drop("audit", "repaired_sha256", "cost")
    if not many.isEmpty():
        keys = many.select("_conv")
        # few: chunks are cut at their bounds and at the ends of range partitions alone
        own = materialize(chunks.join(F.broadcast(keys) if many.count() <= 10_000 else keys, "_conv", "left_semi"), "long-chunks")
        done = done.unionByName(many.join(several(own, summary.join(keys, "_conv", "left_semi"), passes), "_conv"), allowMissingColumns=True)
    original = source.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("_conv")).distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return original.join(done, "_conv", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
