"""Chat formatting by prefix-target expansion: one example for each assistant turn, and its reading back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import slices, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"
#: Characters of examples, and digests, that a task hands on at once.
FLUSH, ROWS = 4 << 20, 10_000
EXAMPLES = "conv_id long, example long, target boolean, text string, loss_start long, loss_end long"


def escape(text: str) -> str:
    """No `<|` is left: a backslash more goes between `<` and `|`."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """As escape, and on one line."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "example", "target", "text", "loss_start", "loss_end"]
    out: list[tuple] = []
    held, conv, number, fresh, prefix = 0, object(), 0, False, ""

    def close() -> None:
        """Turns after the last reply are an example without a target, so that none is lost."""
        if fresh:
            out.append((conv, number, False, prefix, len(prefix), len(prefix)))

    def flush() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=names)
        out.clear()
        return got

    for batch in batches:
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
            if c != conv:
                close()
                conv, number, fresh, prefix = c, 0, False, ""
            head = prefix + OPEN + escape_role(role or "") + "\n"
            body = escape(text or "")
            prefix, fresh = head + body + CLOSE, role != ASSISTANT
            if not fresh:
                out.append((c, number, True, prefix, len(head), len(head) + len(body)))
                number += 1
                held += len(prefix)
            if held >= FLUSH:
                yield flush()
                held = 0
    close()
    if out:
        yield flush()


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, target, text, loss_start, loss_end: the training examples of conversations (conv_id, turn, role, text).

    Every assistant turn becomes one example: all turns up to it, formatted and escaped, with the span of its
    reply's text as the only trainable part. Turns after a conversation's last reply, or of one without a reply, make one more
    example with target false and an empty span. Rows are dealt by conversation and read in order of turn (then
    role and text), one row at a time. Null text and role are empty, a null turn comes first, a null conv_id is a
    conversation of its own, repeated rows are repeated turns, other columns are ignored.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_expand, EXAMPLES)


def _turns(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted example."""
    out = []
    for part in text.split(OPEN)[1:]:
        role, _, body = part.partition("\n")
        out.append((unescape_role(role), unescape(body.removesuffix(CLOSE))))
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each example, what the ones before it lack: the turns after the last reply before its target, and its loss text."""
    mark = OPEN + ASSISTANT + "\n"
    for batch in (part for whole in batches for part in slices(whole, "text")):
        out = []
        for c, number, target, text, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            before = text.rfind(mark, 0, a - len(mark) if target else len(text))
            begin = text.index(CLOSE, before) + len(CLOSE) if before >= 0 else 0
            turns = _turns(text[begin:])
            out.append((c, number, [r for r, _ in turns], [t for _, t in turns], unescape(text[a:b]), len(text)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.int64()), strict=True)], names=["conv_id", "example", "roles", "texts", "loss", "chars"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    out: list[tuple] = []
    conv: object = object()
    state: list = []

    def close() -> None:
        if state:
            n, turns, chars, loss, total = state
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    made = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=names)
    for batch in (part for whole in batches for part in slices(whole, "loss")):
        for c, roles, texts, loss, chars in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "roles", "texts", "loss", "chars")), strict=True):
            if c != conv:
                close()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if len(out) >= ROWS:
                    yield made()
                    out.clear()
            for role, text in zip(roles, texts, strict=True):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += chars
    close()
    yield made()


def read_back(expanded: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what `examples` returned.

    Each example is parsed where it lies and only gives what is new in it, so what is shuffled grows with the
    conversations and not with their prefixes.
    """
    parts = expanded.mapInArrow(_parse, "conv_id long, example long, roles array<string>, texts array<string>, loss string, chars long")
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "example").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = CLOSE.strip() + OPEN + "assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, ASSISTANT, text)], "conv_id long, turn long, role string, text string")
    return read_back(examples(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)))


_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, k, who, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) p(k, who)),
f AS (SELECT *, length('<|im_start|>' || {_ESCAPED.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")} || chr(10) || {_ESCAPED.format("text")} || '<|im_end|>' || chr(10)) AS chars FROM c),
g AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS so_far, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(CASE WHEN role = 'assistant' OR back = 1 THEN so_far ELSE 0 END)::BIGINT AS formatted_chars
FROM g GROUP BY conv_id
"""
