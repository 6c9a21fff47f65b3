"""Conversation structure repair: cheapest edits by a chunked Viterbi whose speculative cost vectors are fixed up until they converge."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.taskcontext import TaskContext

from dossier.llm.common import checkpointed, slices, table

#: Rows of one chunk; passes of fix-ups before the chunks that are still not settled are stitched by doubling.
CHUNK, PASSES = 4096, 3
#: States by the initial of the last turn: none yet, system, user, assistant; the state after the one turn that may follow.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, RENAME, TRUNCATED = 4, 3, 3, 3
#: What completes a conversation that ends in each state.
FINAL = [0, 2 * INSERT, INSERT, 0]
FAR = 1 << 30
SPACES = " \t\n\x0b\x0c\r"


def _keep(code: int, state: int) -> int | None:
    """The state after keeping a row of this code; None if it may not stand there. Codes: 1 + 2 * initial (s, u, a, other) + truncated."""
    initial = (code - 1) >> 1
    if initial == 0:
        return SYSTEM if state == START else None
    return NEXT[state] if initial < 3 and NEXT[state] == initial + 1 else None


def _options() -> list[list[list[tuple[int, int]]]]:
    """Of each code and state: cost and next state of what may be done with the row, without insertions. Code 0 must go."""
    out = [[[(DELETE, q)] for q in range(4)]]
    for code in range(1, 9):
        late = TRUNCATED * ((code - 1) & 1)
        kept = [_keep(code, q) for q in range(4)]
        out.append([[(DELETE, q), (RENAME + late, NEXT[q])] + [(late, kept[q])] * (kept[q] is not None) for q in range(4)])
    return out


OPTIONS = _options()


def _back(code: int, count: int, after: list[int]) -> list[int]:
    """Costs to go before `count` rows of a code, from those after them."""
    if not code:
        return [v + DELETE * count for v in after]
    x = [min(c + after[q] for c, q in ways) for ways in OPTIONS[code]]
    u, a = min(x[USER], INSERT + x[ASSISTANT]), min(x[ASSISTANT], INSERT + x[USER])
    return [min(x[START], INSERT + u), min(x[SYSTEM], INSERT + u), u, a]


def _shape(v: list[int]) -> list[int]:
    """Vectors that differ by a constant have one shape."""
    return [min(x, FAR) - v[0] if v[0] < FAR else x for x in v]


def _run(codes: bytes, counts: list[int], v: list[int]) -> list[int]:
    for code, count in zip(reversed(codes), reversed(counts), strict=True):
        v = _back(code, count, v)
    return v


def _rerun(codes: bytes, counts: list[int], old: list[int], new: list[int], out: list[int]) -> list[int]:
    """The shape before a chunk for a new vector after it: what the old one gave, once both differ by a constant only."""
    for code, count in zip(reversed(codes), reversed(counts), strict=True):
        if len({a - b for a, b in zip(old, new, strict=True)}) == 1:
            return out
        old, new = _back(code, count, old), _back(code, count, new)
    return _shape(new)


def _trace(codes: bytes, counts: list[int], after: list[int], state: int, last: bool) -> tuple[str, int, int]:
    """The least audit of a chunk entered in a state, the state it is left in, and its cost."""
    ahead = [after]
    for code, count in zip(reversed(codes), reversed(counts), strict=True):
        ahead.append(_back(code, count, ahead[-1]))
    ahead.reverse()
    said, cost = [], 0
    for k, (code, count) in enumerate(zip(codes, counts, strict=True)):
        now, then = ahead[k], ahead[k + 1]
        if not code:
            said.append("D" * count)
            cost += DELETE * count
            continue
        late = TRUNCATED * ((code - 1) & 1)
        while True:
            kept = _keep(code, state)
            if now[state] == DELETE + then[state]:
                step, price = "D", DELETE
            elif now[state] == INSERT + now[NEXT[state]]:
                step, price = "I", INSERT
            elif kept is not None and now[state] == late + then[kept]:
                step, price = "K", late
            else:
                step, price = "R", RENAME + late
            said.append(step)
            cost += price
            state = {"D": state, "K": kept}.get(step, NEXT[state])
            if step != "I":
                break
    while last and FINAL[state]:
        said.append("I")
        cost, state = cost + INSERT, NEXT[state]
    return "".join(said), state, cost


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties it, 2 removes its
    marks, 3 repeats it, 4 makes it the user's. Nulls are one space there and in role and text; other columns are ignored."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1).cast("int"))).alias("copy")
    return rows.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), copies).drop("copy")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & a[k].eqNullSafe(b[k])
    return condition


def _facts(rows: DataFrame) -> DataFrame:
    """Rows without their texts, equal ones once with their number n: key columns, code, and the first faults of all n."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    mark = F.substring(trimmed, -1, 1)
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    every = rows.select("conv_id", "turn", "role", "hash", (trimmed == "").alias("blank"), (~mark.isin(".", "!", "?")).alias("cut"), number.alias("initial"))
    once = every.groupBy("conv_id", "turn", "role", "hash").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.first("initial").alias("initial"))
    once = checkpointed(once)
    place = lambda c: F.struct(F.col(c).isNotNull(), F.col(c))
    repeats = once.where("not blank").groupBy("conv_id", "role", "hash").agg(F.min(place("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1").drop("turns")
    repeats = repeats.select(*[F.col(c).alias(f"r_{c}") for c in ("conv_id", "role", "hash")], "first")
    joined = once.join(repeats, F.col("conv_id").eqNullSafe(F.col("r_conv_id")) & (F.col("role") == F.col("r_role")) & (F.col("hash") == F.col("r_hash")), "left")
    again = F.coalesce(place("turn") > F.col("first"), F.lit(False))
    gone = F.col("blank") | again
    code = F.when(gone, 0).otherwise(1 + 2 * F.col("initial") + F.col("cut").cast("int"))
    zero = F.lit(0).cast("long")
    return joined.select(
        "conv_id", "turn", "role", "hash", "n", code.alias("code"),
        F.when(F.col("blank"), F.col("n")).otherwise(zero).alias("blank"),
        F.when(F.col("blank"), zero).when(again, F.col("n")).otherwise(F.col("n") - 1).alias("duplicate"),
        F.when(gone | ~F.col("cut"), zero).otherwise(F.lit(1)).cast("long").alias("truncated"),
    )


CHUNKS = "conv_id long, turn long, role string, hash string, part int, seq long, codes binary, counts array<long>, out array<int>, blank long, duplicate long, truncated long"


def _arrow(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def _cut(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows into chunks of one conversation, each with the shape before it for a speculative vector after it."""
    kinds = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("hash", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("codes", pa.binary()), ("counts", pa.list_(pa.int64())), ("out", pa.list_(pa.int32()))]
    kinds += [(n, pa.int64()) for n in ("blank", "duplicate", "truncated")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, done = TaskContext.get().partitionId(), 0, []
        key, codes, counts, faults, held = None, bytearray(), [], [0, 0, 0], 0

        def close() -> None:
            nonlocal seq
            if key is not None:
                done.append((*key, part, seq, bytes(codes), list(counts), _shape(_run(codes, counts, FINAL)), *faults))
                seq += 1

        for batch in batches:
            for conv, turn, role, digest, n, code, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is None or conv != key[0] or held == size:
                    close()
                    key, codes, counts, faults, held = (conv, turn, role, digest), bytearray(), [], [0, 0, 0], 0
                held += 1
                faults = [a + b for a, b in zip(faults, own, strict=True)]
                if code:
                    codes.append(code)
                    counts.append(1)
                gone = n - (code > 0)
                if gone and codes and not codes[-1]:
                    counts[-1] += gone
                elif gone:
                    codes.append(0)
                    counts.append(gone)
            if len(done) >= 1000:
                yield _arrow(done, kinds)
                done.clear()
        close()
        yield _arrow(done, kinds)

    return run


def _each(batches: Iterator[pa.RecordBatch], work: Callable[[dict], tuple], schema: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _arrow([work(r) for r in batch.to_pylist()], schema)


STATE = [("conv_id", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("inp", pa.list_(pa.int32())), ("out", pa.list_(pa.int32()))]
MATRIX = [("conv_id", pa.int64()), ("place", pa.int64()), ("m", pa.list_(pa.int32()))]


def _fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(r: dict) -> tuple:
        out = r["out"] if r["need"] == r["inp"] else _rerun(r["codes"], r["counts"], r["inp"], r["need"], r["out"])
        return r["conv_id"], r["place"], r["n"], r["part"], r["seq"], r["need"], out

    return _each(batches, one, STATE)


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a chunk makes of any vector: row q of the matrix holds the costs of going from state q to each state."""

    def one(r: dict) -> tuple:
        columns = [_run(r["codes"], r["counts"], [0 if k == q else FAR for k in range(4)]) for q in range(4)]
        return r["conv_id"], r["place"], [min(columns[q][k], FAR) for k in range(4) for q in range(4)]

    return _each(batches, one, MATRIX)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which a chunk is left for each that it is entered in, as a matrix of 0 and far."""

    def one(r: dict) -> tuple:
        left = [_trace(r["codes"], r["counts"], r["inp"], q, False)[1] for q in range(4)]
        return r["conv_id"], r["place"], [0 if left[k] == q else FAR for k in range(4) for q in range(4)]

    return _each(batches, one, MATRIX)


def _product(ahead: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def one(r: dict) -> tuple:
        m = r["m"]
        if r["other"] is not None:
            a, b = (np.array(x, np.int64).reshape(4, 4) for x in ((m, r["other"]) if ahead else (r["other"], m)))
            m = np.minimum((a[:, :, None] + b[None]).min(1), FAR)
            least = int(m.min())
            m = np.where(m < FAR, m - least, FAR).ravel().tolist()
        return r["conv_id"], r["place"], m

    return lambda batches: _each(batches, one, MATRIX)


def _scan(mats: DataFrame, longest: int, ahead: bool) -> DataFrame:
    """Each chunk's product with all after it (before it), by doubling."""
    step = 1
    while step < longest:
        other = mats.select(F.col("conv_id").alias("c"), (F.col("place") + (-step if ahead else step)).alias("p"), F.col("m").alias("other"))
        joined = mats.join(other, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")), "left").select("conv_id", "place", "m", "other")
        mats = checkpointed(joined.mapInArrow(_product(ahead), "conv_id long, place long, m array<int>"))
        step *= 2
    return mats


def _vectors(chunks: DataFrame, passes: int) -> DataFrame | None:
    """part, seq, inp, entry, last of the chunks of conversations with more than one: true vectors after them (but for constants), states they are entered in."""
    order = W.partitionBy("conv_id").orderBy("part", "seq")
    placed = chunks.select("conv_id", F.row_number().over(order).cast("long").alias("place"), F.count("*").over(W.partitionBy("conv_id")).alias("n"), "part", "seq", "out")
    final = F.lit(FINAL).cast("array<int>")
    state = checkpointed(placed.where("n > 1").withColumn("inp", final).select("conv_id", "place", "n", "part", "seq", "inp", "out"))
    longest = state.agg(F.max("n")).first()[0]
    if not longest:
        return None
    held = chunks.select("part", "seq", "codes", "counts")
    schema = "conv_id long, place long, n long, part int, seq long, inp array<int>, out array<int>"
    after = F.coalesce(F.lead("out").over(W.partitionBy("conv_id").orderBy("place")), final)
    for _ in range(passes):
        need = state.withColumn("need", after)
        if need.where("need <> inp").isEmpty():
            break
        state = checkpointed(need.join(held, ["part", "seq"]).mapInArrow(_fix, schema))
    if not state.withColumn("need", after).where("need <> inp").isEmpty():
        products = _scan(checkpointed(state.join(held, ["part", "seq"]).mapInArrow(_transfers, "conv_id long, place long, m array<int>")), longest, True)
        ends = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get("m", q * 4 + k) + F.get(final, k))))
        shaped = products.withColumn("v", ends).select(F.col("conv_id").alias("c"), (F.col("place") - 1).alias("p"), F.transform("v", lambda x: x - F.get("v", F.lit(0))).alias("true"))
        state = state.join(shaped, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")), "left").withColumn("inp", F.coalesce("true", final)).select("conv_id", "place", "n", "part", "seq", "inp", "out")
        state = checkpointed(state)
    lefts = _scan(checkpointed(state.join(held, ["part", "seq"]).mapInArrow(_exits, "conv_id long, place long, m array<int>")), longest, False)
    entry = lefts.select(F.col("conv_id").alias("c"), (F.col("place") + 1).alias("p"), (F.array_position(F.slice("m", 1, 4), 0) - 1).cast("int").alias("entry"))
    joined = state.join(entry, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")), "left")
    return joined.select("part", "seq", "inp", F.coalesce("entry", F.lit(START)).alias("entry"), (F.col("place") == F.col("n")).alias("last"))


AUDITS = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("hash", pa.string()), ("audit", pa.string())] + [(n, pa.int64()) for n in ("cost", "blank", "duplicate", "truncated")]


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(r: dict) -> tuple:
        said, _, cost = _trace(r["codes"], r["counts"], r["inp"], r["entry"], r["last"])
        return r["conv_id"], r["turn"], r["role"], r["hash"], said, cost, r["blank"], r["duplicate"], r["truncated"]

    return _each(batches, one, AUDITS)


REPORT = [("conv_id", pa.int64())] + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
TURNS = [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]
LEGAL = {"su", "ua", "au"}


class _Conversation:
    """What is known of one conversation while its rows stream by."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.sums, self.said, self.digest, self.state, self.place = conv, [0, 0, 0, 0], [], hashlib.sha256(), START, 0
        self.low = self.high = self.turn = self.before = None
        self.turns = self.illegal = 0
        self.letters: Iterator[str] = iter(())

    def put(self, role: str, text: str, edit: str) -> tuple:
        self.digest.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
        self.place += 1
        return self.conv, self.place - 1, role, text, edit

    def inserted(self) -> tuple:
        self.state = NEXT[self.state]
        return self.put(ROLES[self.state], "", "I")

    def chunk(self, audit: str, sums: list[int]) -> Iterator[tuple]:
        yield from self.rest()
        self.said.append(audit)
        self.letters = iter(audit)
        self.sums = [a + b for a, b in zip(self.sums, sums, strict=True)]

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        for step in self.letters:
            if step == "I":
                yield self.inserted()
                continue
            if step == "K":
                self.state = SYSTEM if initial == "s" else NEXT[self.state]
                yield self.put(role, text, step)
            elif step == "R":
                self.state = NEXT[self.state]
                yield self.put(ROLES[self.state], text, step)
            return

    def rest(self) -> Iterator[tuple]:
        """Insertions after the last row."""
        for _ in self.letters:
            yield self.inserted()

    def report(self) -> tuple:
        cost, blank, duplicate, truncated = self.sums
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, blank, duplicate, truncated, self.illegal, cost, "".join(self.said), self.digest.hexdigest()


def _replay(turns: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Apply the audits to the rows behind them: repaired turns, or a report of each conversation."""
    schema = TURNS if turns else REPORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        out: list[tuple] = []
        held = 0

        def keep(made: Iterator[tuple]) -> None:
            nonlocal held
            for r in made:
                if turns:
                    out.append(r)
                    held += len(r[3])

        def close() -> None:
            if now is not None:
                keep(now.rest())
                if not turns:
                    out.append(now.report())

        for batch in (part for whole in batches for part in slices(whole, "text")):
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != now.conv:
                    close()
                    now = _Conversation(r["conv_id"])
                if r["kind"] == 1:
                    keep(now.chunk(r["audit"], [r["cost"], r["blank"], r["duplicate"], r["truncated"]]))
                elif r["kind"] == 2:
                    keep(now.row(r["turn"], r["role"], r["text"]))
                if held > 4 << 20 or len(out) > 10_000:
                    yield _arrow(out, schema)
                    out.clear()
                    held = 0
        close()
        yield _arrow(out, schema)

    return run


def _applied(conversations: DataFrame, known: DataFrame, turns: bool, chunk: int, passes: int) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    rows = rows.withColumn("hash", F.sha2("text", 256))
    keys = ["conv_id", "turn", "role", "hash"]
    facts = checkpointed(_facts(rows))
    ordered = facts.repartitionByRange(*keys).sortWithinPartitions(*keys)
    chunks = checkpointed(ordered.select(*keys, "n", "code", "blank", "duplicate", "truncated").mapInArrow(_cut(chunk), CHUNKS))
    vectors = _vectors(chunks, passes)
    final = F.lit(FINAL).cast("array<int>")
    if vectors is None:
        ready = chunks.withColumns({"inp": final, "entry": F.lit(START), "last": F.lit(True)})
    else:
        ready = chunks.join(vectors, ["part", "seq"], "left").withColumns({"inp": F.coalesce("inp", final), "entry": F.coalesce("entry", F.lit(START)), "last": F.coalesce("last", F.lit(True))})
    audits = ready.select(*keys, "codes", "counts", "inp", "entry", "last", "blank", "duplicate", "truncated").mapInArrow(_audits, "conv_id long, turn long, role string, hash string, audit string, cost long, blank long, duplicate long, truncated long")
    marks = known.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("kind", F.lit(0))
    events = marks.unionByName(audits.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(rows.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    dealt = events.repartition("conv_id").sortWithinPartitions("conv_id", F.col("kind") > 0, "turn", "role", "hash", "kind")
    schema = "conv_id long, place long, role string, text string, edit string" if turns else "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return dealt.mapInArrow(_replay(turns), schema)


def repair_report(conversations: DataFrame, *, known: DataFrame | None = None, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the cheapest repair of each conversation.

    Rows are taken by turn (nulls first), those of one turn by role and then by the hash of their texts. Texts stay where they are until the end:
    what decides is a code for each row, and equal rows are one with a number. Codes are range-partitioned in
    order and cut into chunks of at most `chunk` rows of one conversation, so a conversation of any length is the work
    of many tasks. Every chunk first runs backwards from a speculative cost vector, that of the conversation's end. In
    each pass, chunks whose vector proved wrong rerun beside the old one until the two differ by a constant
    only; when no shape changes, all are true but for constants, which the choices do not need. Chunks that shapes
    pass through unsettled for `passes` passes are stitched by doubling over their transfer matrices instead. The states
    that chunks are entered in are stitched alike, and each chunk then traces the least audit from the costs to go. Only
    applying the edits, whose digest is sequential, reads a conversation in one task, one row at a time.

    `known` adds conversations (conv_id) that have no rows: zeros, an empty audit, the hash of an empty string. A null role or text is one
    space, a null conv_id is a conversation of its own; other columns are ignored; no rows and none known give no rows.
    """
    return _applied(conversations, conversations if known is None else known, False, chunk, passes)


def repaired_turns(conversations: DataFrame, *, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """conv_id, place from 0, role, text, edit (K, R or I) of the repaired conversations; see repair_report."""
    return _applied(conversations, conversations, True, chunk, passes)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(damaged(conversations), known=conversations)


ORACLE = r"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(s, ''), lambda ch: [(-1 - ascii(ch))::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, x: CASE WHEN x < 0 THEN xor(c, -1 - x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 20 AS kind FROM keyed),
rows_ AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM kinds, (VALUES (1), (2)) v(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
seen AS (SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS mark FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
nth AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM seen),
f AS (SELECT *, mark = '' AS blank, mark <> '' AND nth > 1 AS dup, mark <> '' AND nth = 1 AND mark NOT IN ('.', '!', '?') AS trunc, left(role, 1) AS o, count(*) OVER (PARTITION BY conv_id) AS n FROM nth),
v AS (
  SELECT DISTINCT conv_id, n + 1 AS i, {c: 0, a: '', t: []::VARCHAR[]} AS q, {c: 6, a: 'II', t: ['user:', 'assistant:']} AS s, {c: 3, a: 'I', t: ['assistant:']} AS u, {c: 0, a: '', t: []::VARCHAR[]} AS a FROM f
  UNION ALL
  SELECT conv_id, i, list_min([q, {c: u.c + 3, a: 'I' || u.a, t: list_prepend('user:', u.t)}, {c: a.c + 6, a: 'II' || a.a, t: list_prepend('user:', list_prepend('assistant:', a.t))}]),
    list_min([s, {c: u.c + 3, a: 'I' || u.a, t: list_prepend('user:', u.t)}, {c: a.c + 6, a: 'II' || a.a, t: list_prepend('user:', list_prepend('assistant:', a.t))}]),
    list_min([u, {c: a.c + 3, a: 'I' || a.a, t: list_prepend('assistant:', a.t)}]), list_min([a, {c: u.c + 3, a: 'I' || u.a, t: list_prepend('user:', u.t)}])
  FROM (SELECT v.conv_id, f.i,
    list_min([{c: q.c + 4, a: 'D' || q.a, t: q.t}, {c: CASE WHEN go THEN 9999 ELSE 3 + late END + u.c, a: 'R' || u.a, t: list_prepend('user:' || text, u.t)}, {c: CASE WHEN go OR o <> 's' THEN 9999 ELSE late END + s.c, a: 'K' || s.a, t: list_prepend(role || ':' || text, s.t)}, {c: CASE WHEN go OR o <> 'u' THEN 9999 ELSE late END + u.c, a: 'K' || u.a, t: list_prepend(role || ':' || text, u.t)}]) AS q,
    list_min([{c: s.c + 4, a: 'D' || s.a, t: s.t}, {c: CASE WHEN go THEN 9999 ELSE 3 + late END + u.c, a: 'R' || u.a, t: list_prepend('user:' || text, u.t)}, {c: CASE WHEN go OR o <> 'u' THEN 9999 ELSE late END + u.c, a: 'K' || u.a, t: list_prepend(role || ':' || text, u.t)}]) AS s,
    list_min([{c: u.c + 4, a: 'D' || u.a, t: u.t}, {c: CASE WHEN go THEN 9999 ELSE 3 + late END + a.c, a: 'R' || a.a, t: list_prepend('assistant:' || text, a.t)}, {c: CASE WHEN go OR o <> 'a' THEN 9999 ELSE late END + a.c, a: 'K' || a.a, t: list_prepend(role || ':' || text, a.t)}]) AS u,
    list_min([{c: a.c + 4, a: 'D' || a.a, t: a.t}, {c: CASE WHEN go THEN 9999 ELSE 3 + late END + u.c, a: 'R' || u.a, t: list_prepend('user:' || text, u.t)}, {c: CASE WHEN go OR o <> 'u' THEN 9999 ELSE late END + u.c, a: 'K' || u.a, t: list_prepend(role || ':' || text, u.t)}]) AS a
    FROM v JOIN (SELECT *, blank OR dup AS go, CASE WHEN trunc THEN 3 ELSE 0 END AS late FROM f) f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i - 1) x),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v.q.c, 0)::BIGINT AS cost, coalesce(v.q.a, '') AS audit, sha256(coalesce(array_to_string(v.q.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM k.conv_id AND v.i = 1
"""
