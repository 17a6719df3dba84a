"""WARC records: reading and writing, and resolution of not-modified revisits.

A revisit after a 304 answer has no body. It is resolved to the latest full response
that was captured earlier under the same canonical URL, if their validators agree; the
stored headers are then updated with those that a 304 may carry.

The as-of join never gathers a URL in one task: captures are summed up per (URL, range of
time) to the last full response, running maxima go over these summaries, and rows meet
them only within their own range. Bodies take no part; they follow by record id.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowlint.runtime import ship

#: What a 304 answer may update (RFC 9110, 15.4.5, and RFC 9111, 3.2).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
RANGE_S = 4096
RECORDS = "record_id string, kind string, uri string, ts long, headers map<string,string>, digest string"


def canonical_url(uri: Column) -> Column:
    """Lower-case host without scheme, www., m. or default port; no fragment, no utm_ parameters, no final slash; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(uri), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^(www|m)\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _etag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, url, kind, outcome, resolved_id, merged (headers) of every record.

    records has record_id, kind (response or revisit), uri, ts (seconds), headers (lower-case
    names) and digest (of the payload, may be null). A response resolves to itself. For a
    revisit, the candidate is the response with the greatest (ts, record_id) whose ts is
    strictly smaller. Validators: entity tags decide by weak comparison if both have one,
    else Last-Modified dates if both have one, else payload digests. Outcomes: full,
    resolved, changed (validators differ), unverified (none to compare), missing (no earlier
    response, or a null or empty uri, ts or record_id). Only resolved rows have resolved_id and the
    response's headers, overwritten with the permitted ones of the revisit. Repeated rows
    are resolved each, and rows that share nothing but their record_id each for itself; of
    responses alike but for their headers the least headers, as text, count. Empty tables
    give no rows; other columns are dropped.
    """
    r = records.select("record_id", "kind", "uri", "ts", "headers", "digest").withColumn("url", canonical_url(F.col("uri")))
    usable = F.col("record_id").isNotNull() & F.col("ts").isNotNull() & F.col("url").isNotNull() & (F.col("url") != "")
    key = F.struct("ts", "record_id", _etag(F.col("headers")).alias("etag"), F.col("headers")["last-modified"].alias("modified"), "digest")
    full = r.where((F.col("kind") == "response") & usable).select("url", "ts", F.floor(F.col("ts") / RANGE_S).alias("r"), key.alias("full"))
    asked = r.where((F.col("kind") == "revisit") & usable)
    # The last response of each range, then the last of all ranges before it.
    points = full.groupBy("url", "r").agg(F.max("full").alias("last")).unionByName(asked.select("url", F.floor(F.col("ts") / RANGE_S).alias("r"), F.lit(None).cast(full.schema["full"].dataType).alias("last")).distinct())
    before = Window.partitionBy("url").orderBy("r").rangeBetween(Window.unboundedPreceding, -1)
    carried = points.groupBy("url", "r").agg(F.max("last").alias("last")).withColumn("carried", F.max("last").over(before)).select("url", "r", "carried")
    rows = full.select("url", "r", "ts", "full", *(F.lit(None).cast(t).alias(c) for c, t in (("record_id", "string"), ("etag", "string"), ("modified", "string"), ("digest", "string"))))
    rows = rows.unionByName(asked.select("url", F.floor(F.col("ts") / RANGE_S).alias("r"), "ts", F.lit(None).cast(full.schema["full"].dataType).alias("full"), "record_id", _etag(F.col("headers")).alias("etag"), F.col("headers")["last-modified"].alias("modified"), "digest"))
    inside = Window.partitionBy("url", "r").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("near", F.max("full").over(inside)).where("full is null").join(carried, ["url", "r"], "left").withColumn("c", F.coalesce("near", "carried"))
    agree = F.when(F.col("c").isNull(), "missing")
    for mine, theirs in (("etag", "c.etag"), ("modified", "c.modified"), ("digest", "c.digest")):
        both = F.col(mine).isNotNull() & F.col(theirs).isNotNull()
        agree = agree.when(both & (F.col(mine) == F.col(theirs)), "resolved").when(both, "changed")
    # A record id may stand for several records: all that decides is part of the key.
    same = ("record_id", "url", "ts", "etag", "modified", "digest")
    judged = met.select(*(F.col(c).alias("_" + c) for c in same), agree.otherwise("unverified").alias("outcome"), "c").distinct()
    revisits = r.where(F.col("kind") == "revisit").withColumn("etag", _etag(F.col("headers"))).withColumn("modified", F.col("headers")["last-modified"])
    equal = (F.col("record_id") == F.col("_record_id")) & (F.col("url") == F.col("_url")) & (F.col("ts") == F.col("_ts"))
    for c in same[3:]:
        equal = equal & F.col(c).eqNullSafe(F.col("_" + c))
    mine = revisits.join(judged, equal, "left").withColumn("outcome", F.coalesce("outcome", F.lit("missing"))).withColumn("resolved_id", F.when(F.col("outcome") == "resolved", F.col("c.record_id")))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), "\n")
    stored = r.where((F.col("kind") == "response") & usable).groupBy(F.col("url").alias("_u"), key.alias("_c")).agg(F.min_by("headers", listed).alias("stored"))
    sent = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(sent), k)), sent)
    # Unresolved rows have no partner and skip the join, so that no null key gathers them.
    done = mine.where("resolved_id is not null").join(stored, (F.col("url") == F.col("_u")) & F.col("c").eqNullSafe(F.col("_c")), "left").select("record_id", "url", "kind", "outcome", "resolved_id", merged.alias("merged"))
    none = F.lit(None).cast("map<string,string>")
    rest = mine.where("resolved_id is null").select("record_id", "url", "kind", "outcome", "resolved_id", none.alias("merged"))
    own = r.where(F.col("kind") == "response").select("record_id", "url", "kind", F.lit("full").alias("outcome"), F.col("record_id").alias("resolved_id"), F.col("headers").alias("merged"))
    return own.unionByName(done).unionByName(rest)


def write_record(kind: str, record_id: str, uri: str, date: str, http: bytes, extra: dict[str, str] | None = None) -> bytes:
    """One gzip member with one WARC/1.1 record."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Target-URI": uri, "WARC-Date": date, "Content-Type": "application/http; msgtype=response", **(extra or {}), "Content-Length": str(len(http))}
    return gzip.compress(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + http + b"\r\n\r\n", mtime=0)


STEP, LINE = 1 << 16, 1 << 20


class _Source:
    """Bytes of a WARC file from a stream: of all its gzip members, or as they are. A broken member ends them."""

    def __init__(self, raw):
        head = raw.read(2)
        whole = _Joined(head, raw)
        self.stream = gzip.GzipFile(fileobj=whole) if head == b"\x1f\x8b" else whole
        self.ahead = b""

    def more(self) -> bool:
        try:
            part = self.stream.read(STEP)
        except (EOFError, OSError, zlib.error):
            part = b""
        self.ahead += part
        return bool(part)

    def until(self, mark: bytes, most: int) -> int:
        """Where the mark begins in what lies ahead, or -1 at the end or beyond ``most`` bytes."""
        begin = 0
        while (at := self.ahead.find(mark, begin)) < 0:
            begin = max(0, len(self.ahead) - len(mark) + 1)
            if len(self.ahead) > most or not self.more():
                return -1
        return at

    def take(self, n: int) -> bytes | None:
        """The next n bytes, or None if there are fewer."""
        parts, left = [self.ahead[:n]], n - len(self.ahead)
        self.ahead = self.ahead[n:]
        while left > 0:
            try:
                part = self.stream.read(min(left, 16 * STEP))
            except (EOFError, OSError, zlib.error):
                part = b""
            if not part:
                return None
            parts.append(part)
            left -= len(part)
        return b"".join(parts)


class _Joined(io.RawIOBase):
    """A stream with its first bytes put back."""

    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        if self.head:
            out, self.head = (self.head, b"") if n < 0 else (self.head[:n], self.head[n:])
            return out
        return self.rest.read(n if n >= 0 else STEP)


def records(raw) -> Iterator[dict]:
    """The response and revisit records of a stream, compressed per record or plain, one at a time. Broken tails end the stream; what stands between records is skipped."""
    src = _Source(raw)
    while True:
        while (begin := src.ahead.find(b"WARC/1.")) < 0:
            src.ahead = src.ahead[-6:]
            if not src.more():
                return
        src.ahead = src.ahead[begin:]
        end = src.until(b"\r\n\r\n", LINE)
        if end < 0:
            return
        head = _headers(src.take(end + 4)[:end])
        size = head.get("content-length", "0")
        body = src.take(int(size) if size.isdigit() else 0)
        if body is None:
            return
        if head.get("warc-type") in ("response", "revisit"):
            http, _, payload = body.partition(b"\r\n\r\n")
            yield {"record_id": head.get("warc-record-id", "").strip("<>"), "kind": head["warc-type"], "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "status": http.split(b" ")[1].decode("latin-1") if http.count(b" ") else None, "headers": list(_headers(http).items()), "digest": head.get("warc-payload-digest"), "payload": payload if head["warc-type"] == "response" else None}


def parse(data: bytes) -> list[dict]:
    return list(records(io.BytesIO(data)))


def _headers(block: bytes) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in block.split(b"\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, sep, v in pairs if sep}


PARSED = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("status", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("digest", pa.string()), ("payload", pa.binary())])


BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of the files at ``path``; ts is the date in seconds.

    A task streams its files, so that neither a file nor its records are in memory at once,
    only one record and a batch of bounded size. A file that breaks off gives the records
    before the break; an empty or foreign file gives none; a date that is none gives a null
    ts, and records without a payload a null payload.
    """
    ship(spark)

    def run(it):
        for b in it:
            for place in b.column("path").to_pylist():
                fs, name = pf.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", place))
                rows, size = [], 0
                with fs.open_input_stream(name, compression=None) as raw:
                    for r in records(raw):
                        rows.append(r)
                        size += len(r["payload"] or b"")
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, PARSED)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, PARSED)

    schema = "record_id string, kind string, uri string, date string, status string, headers map<string,string>, digest string, payload binary"
    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, schema).withColumn("ts", F.unix_timestamp(F.try_to_timestamp("date")))


def captures(pages: DataFrame) -> DataFrame:
    """Two captures per row of ``pages``: a full response, and a revisit of another spelling of its URL.

    Tags, dates and times follow from page_id, so that some revisits match, some come
    first, some have no validator and some find another one.
    """
    p = F.col("page_id")
    digest = F.md5(F.coalesce("html", F.lit("")))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 12), F.lit('"'))
    base = pages.select("page_id", "url", digest.alias("digest"), tag.alias("tag"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    text = lambda c: c.cast("string")
    full = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), text(F.col("size")), F.lit("etag"), F.col("tag"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("last-modified"), F.concat(F.lit("day "), text(p % 5)))
    sent = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=120"), F.lit("date"), text(p), F.lit("x-cache"), F.lit("hit"))
    validators = F.when(p % 7 == 0, F.create_map(F.lit("etag"), F.lit('"changed"'))).when(p % 11 == 0, F.create_map(F.lit("last-modified"), F.concat(F.lit("day "), text(p % 5)))).when(p % 17 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("etag"), F.concat(F.lit("W/"), F.col("tag"))))
    a = base.select(F.concat(F.lit("r"), text(p)).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("uri"), (p * 10).alias("ts"), full.alias("headers"), "digest")
    b = base.select(F.concat(F.lit("n"), text(p)).alias("record_id"), F.lit("revisit").alias("kind"), F.concat(F.col("url"), F.lit("#top")).alias("uri"), (p * 10 + F.when(p % 13 == 0, -5).otherwise(3)).alias("ts"), F.map_concat(sent, validators).alias("headers"), F.lit(None).cast("string").alias("digest"))
    return a.unionByName(b)


def page_revisits(pages: DataFrame) -> DataFrame:
    """record_id, url, outcome, resolved_id and the merged headers as sorted text, for the captures of ``pages``."""
    out = resolve_revisits(captures(pages))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")
    return out.select("record_id", "url", "outcome", "resolved_id", lines.alias("merged"))


REVISITS_SQL = r"""
with bare as (
  select page_id, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') b, md5(coalesce(html, '')) d, strlen(coalesce(html, '')) size from pages),
canon as (
  select page_id, d, size,
    regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^(www|m)\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') as stem,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda x: x <> '' and not starts_with(x, 'utm_'))), '&') as q
  from bare),
pg as (select page_id, d, size, '"' || substr(d, 1, 12) || '"' tag, stem || case when q <> '' then '?' || q else '' end as url, 'day ' || (page_id % 5) as modified from canon),
asked as (
  select page_id, url, page_id * 10 + case when page_id % 13 = 0 then -5 else 3 end ts,
    case when page_id % 7 = 0 then '"changed"' when page_id % 11 = 0 or page_id % 17 = 0 then null else tag end etag,
    case when page_id % 7 = 0 then null when page_id % 11 = 0 then modified else null end modified from pg),
ranked as (
  select a.page_id, a.url, a.etag, a.modified, p.page_id found, p.tag, p.size, p.modified pm,
    row_number() over (partition by a.page_id order by p.page_id * 10 desc, 'r' || p.page_id desc) k
  from asked a left join pg p on p.url = a.url and p.page_id * 10 < a.ts),
judged as (
  select *, case when found is null then 'missing' when etag is not null then case when etag = tag then 'resolved' else 'changed' end
    when modified is not null then case when modified = pm then 'resolved' else 'changed' end else 'unverified' end outcome
  from ranked where k = 1)
select 'r' || page_id record_id, url, 'full' outcome, 'r' || page_id resolved_id,
  'cache-control=max-age=60; content-length=' || size || '; content-type=text/html; etag=' || tag || '; last-modified=' || modified merged from pg
union all
select 'n' || page_id, url, outcome, case when outcome = 'resolved' then 'r' || found end,
  case when outcome = 'resolved' then 'cache-control=max-age=120; content-length=' || size || '; content-type=text/html; date=' || page_id
    || '; etag=' || case when etag is null then tag else 'W/' || tag end || '; last-modified=' || pm end
from judged
"""
