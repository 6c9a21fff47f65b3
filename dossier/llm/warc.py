"""WARC archives with a two-level capture index: sorted compressed blocks, and a sparse directory that is searched first."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from dossier.llm.common import checkpointed, shared_dir, table

#: Bytes of an archive's part, captures of an index block, entries of a directory page, entries of the directory's root.
PART, LINES, FANOUT, ROOT = 4 << 20, 1000, 256, 4096
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "struct<key:string,page_id:long,at:long,length:long>"


def surt(url: str | None) -> str:
    """Reversed host labels, `)`, path and query; the fragment goes, control characters are escaped; null is empty."""
    if url is None:
        return ""
    rest = url.partition("://")[2] if "://" in url else url
    host, tail = re.match(r"(?s)([^/?#]*)([^#]*)", rest).groups()
    key = ",".join(reversed(host.lower().split("."))) + ")" + tail
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", key)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One WARC/1.1 record in a gzip member of its own; a revisit (payload None) has the HTTP head alone."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {SAME}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, the length that the HTTP head states, and payload of a record."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = lambda raw: dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])
    headers = fields(head)
    http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    return headers, int(fields(http)["Content-Length"]), payload


def _write(part_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, part = f"archive-{TaskContext.get().partitionId():06d}.warc.gz", 0
        entry = pa.list_(pa.struct([("key", pa.string()), ("page_id", pa.int64()), ("at", pa.int64()), ("length", pa.int64())]))
        members: list[bytes] = []
        entries: list[dict] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal part, size
            got = pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([part], pa.int64()), pa.array([b"".join(members)], pa.binary()), pa.array([entries], entry)], names=["archive", "part", "content", "entries"])
            part, size = part + 1, 0
            members.clear()
            entries.clear()
            return got

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "digest", "size", "html", "refers_to")), strict=True):
                page, url, digest, length, html, refers = (x.as_py() for x in row)
                member = record(page, url, base64.b32encode(digest).decode(), length, None if html is None else html.encode(), refers)
                entries.append({"key": surt(url), "page_id": page, "at": size, "length": len(member)})
                members.append(member)
                size += len(member)
                if size >= part_bytes:
                    yield flush()
        if members:
            yield flush()

    return run


def archives(pages: DataFrame, *, least: int = 0, part_bytes: int = PART) -> DataFrame:
    """archive, part, content, entries: gzip members that, joined by part, are the files archive; entries tell their places.

    Of pages with equal html in UTF-8 (null: empty) of at least `least` bytes, the one with the largest page_id (then
    url; nulls are the smallest) is a response and the others revisit it, rows that repeat it included; shorter ones
    are responses. Only responses carry html into the shuffle, one for each payload and task; revisits are found by digest.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumns({"digest": F.unhex(F.sha1(F.col("html").cast("binary"))), "size": F.octet_length("html").cast("long")})
    shared, none = pages.where(F.col("size") >= least), F.lit(None).cast("long").alias("refers_to")
    first = shared.groupBy("digest").agg(F.max(F.struct("page_id", "url", "html", "size")).alias("r"))
    responses = first.select("r.page_id", "r.url", "digest", "r.size", "r.html", none).unionByName(pages.where(F.col("size") < least).select("page_id", "url", "digest", "size", "html", none))
    thin = shared.groupBy("digest", "page_id", "url", "size").agg(F.count("*").alias("n"))
    top = thin.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.sum("n").alias("all")).where(F.col("all") > 1)
    own = F.struct("page_id", "url").eqNullSafe(F.col("top")).cast("int")
    again = thin.join(top, "digest").select("page_id", "url", "digest", "size", F.lit(None).cast("string").alias("html"), F.col("top.page_id").alias("refers_to"), (F.col("n") - own).alias("n"))
    revisits = again.where("n > 0").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n", "_")
    return responses.unionByName(revisits).mapInArrow(_write(part_bytes), f"archive string, part long, content binary, entries array<{ENTRY}>")


def _blocks(lines_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        lines: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, lines
            text = "\n".join("\t".join(map(str, x)) for x in lines)
            got = pa.RecordBatch.from_arrays([pa.array([base + number]), pa.array([lines[0][0]]), pa.array([lines[-1][0]]), pa.array([zlib.compress(text.encode(), 6)], pa.binary())], names=["node", "first", "last", "content"])
            number, lines = number + 1, []
            return got

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(row)
                if len(lines) >= lines_each:
                    yield flush()
        if lines:
            yield flush()

    return run


def capture_index(written: DataFrame, *, lines_each: int = LINES) -> DataFrame:
    """node, first, last, content: blocks of at most lines_each captures, sorted by key over all blocks."""
    captures = written.select("archive", "part", F.explode("entries").alias("e")).select("e.key", "e.page_id", "archive", "part", "e.at", "e.length")
    order = ["key", "page_id", "archive", "part", "at"]
    return captures.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "archive", "part", "at", "length").mapInArrow(_blocks(lines_each), "node long, first string, last string, content binary")


def _pages(fanout: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            nodes, firsts, lasts = zip(*held, strict=True)
            got = pa.RecordBatch.from_arrays([pa.array([base + number]), pa.array([firsts[0]]), pa.array([lasts[-1]]), pa.array([nodes]), pa.array([firsts]), pa.array([lasts])], names=["node", "first", "last", "nodes", "firsts", "lasts"])
            number, held = number + 1, []
            return got

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("node", "first", "last")), strict=True):
                held.append(row)
                if len(held) >= fanout:
                    yield flush()
        if held:
            yield flush()

    return run


def directory(blocks: DataFrame, *, fanout: int = FANOUT, root: int = ROOT) -> tuple[list[tuple], list[DataFrame]]:
    """The sparse directory over the blocks: a root of at most `root` entries, and the levels of pages below it, lowest first.

    Each level has about a fanout-th of the entries of the one below, so the root stays small whatever the number of blocks.
    """
    level, levels = blocks.select("node", "first", "last"), []
    while (n := level.count()) > root:
        level = checkpointed(level.select("node", "first", "last").repartitionByRange(1 + n // (64 * fanout), "first", "node").sortWithinPartitions("first", "node").mapInArrow(_pages(fanout), "node long, first string, last string, nodes array<long>, firsts array<string>, lasts array<string>"))
        levels.append(level)
    return sorted((r["first"], r["last"], r["node"]) for r in level.collect()), levels


def _search(keys, firsts: list[str], lasts: list[str], nodes: list[int]) -> Iterator[tuple[str, int]]:
    """The nodes whose range holds each key, by binary search; one key may fill several."""
    for key in keys:
        for k in range(bisect_left(lasts, key), bisect_right(firsts, key)):
            yield key, nodes[k]


def _fetch(keys: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    out = []
    for content in block["content"]:
        lines = [x.split("\t") for x in zlib.decompress(content).decode().split("\n")]
        names = [x[0] for x in lines]
        for key in keys["key"]:
            out += lines[bisect_left(names, key) : bisect_right(names, key)]
    got = pd.DataFrame(out, columns=["key", "archive", "part", "at", "length"])
    return got.astype({"part": "int64", "at": "int64", "length": "int64"})


def lookup(keys: DataFrame, blocks: DataFrame, *, fanout: int = FANOUT, root: int = ROOT) -> DataFrame:
    """key, archive, part, at, length of all captures of the distinct keys of `keys` (key)."""
    top, levels = directory(blocks, fanout=fanout, root=root)
    firsts, lasts, nodes = [r[0] for r in top], [r[1] for r in top], [r[2] for r in top]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_search(batch.column("key").to_pylist(), firsts, lasts, nodes))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], names=["key", "node"])

    def down(some: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
        found = [x for _, p in page.iterrows() for x in _search(some["key"], list(p["firsts"]), list(p["lasts"]), list(p["nodes"]))]
        return pd.DataFrame(found, columns=["key", "node"]).astype({"key": "object", "node": "int64"})

    at = keys.select("key").where("key is not null").distinct().mapInArrow(start, "key string, node long")
    for level in reversed(levels):
        at = at.groupBy("node").cogroup(level.select("node", "nodes", "firsts", "lasts").groupBy("node")).applyInPandas(down, "key string, node long")
    return at.groupBy("node").cogroup(blocks.select("node", "content").groupBy("node")).applyInPandas(_fetch, "key string, archive string, part long, at long, length long")


def _read(places: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
    columns = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    out = []
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    for content in parts["content"]:
        for a, n in zip(places["at"], places["length"], strict=True):
            headers, stated, payload = parse(content[a : a + n])
            full = headers["WARC-Type"] == "response"
            out.append((number(headers["WARC-Record-ID"]), headers["WARC-Type"], number(headers.get("WARC-Refers-To")), len(payload) if full else stated, base32_sha1(payload) if full else headers["WARC-Payload-Digest"].removeprefix("sha1:")))
    return pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def read_captures(places: DataFrame, written: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest of captures, one row each.

    The last two are worked out from a response's payload; a revisit takes them from the response of its digest to
    which it refers where that is among the places, else from its own headers.
    """
    kind = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"
    got = checkpointed(places.groupBy("archive", "part").cogroup(written.select("archive", "part", "content").groupBy("archive", "part")).applyInPandas(_read, kind))
    full = got.where("record_type = 'response'").groupBy(F.col("page_id").alias("id"), F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("b"))
    again = got.where("record_type = 'revisit'").join(full, F.col("refers_to").eqNullSafe(F.col("id")) & (F.col("payload_digest") == F.col("d")), "left")
    again = again.select("page_id", F.coalesce("b", "payload_bytes").alias("payload_bytes"), F.coalesce("d", "payload_digest").alias("payload_digest"), "record_type", "refers_to")
    return got.where("record_type = 'response'").select(again.columns).unionByName(again)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def keys_of(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column("url").to_pylist()], pa.string())], names=["key"])

    return pages.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(run, "key string").distinct()


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is archived, indexed, looked up by its url and read back.

    Null html is an empty payload, a null url has the empty key, repeated rows are archived as often as they
    stand, other columns are ignored, an empty table gives no rows.
    """
    pages = table(spark, sf_dir, "pages")
    written = save(archives(pages), "archives")
    blocks = save(capture_index(written), "captures")
    return read_captures(lookup(keys_of(pages), blocks), written)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex, top FROM t),
b AS (SELECT *, list_transform(range(0, 32), lambda i: (
  (strpos('0123456789abcdef', substr(hex, (5 * i // 4 + 1)::BIGINT, 1)) - 1) * 16 + coalesce(nullif(strpos('0123456789abcdef', substr(hex, (5 * i // 4 + 2)::BIGINT, 1)), 0), 1) - 1)) AS two FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(1, 33), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((two[i] >> (3 - (5 * (i - 1)) % 4)) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
"""
