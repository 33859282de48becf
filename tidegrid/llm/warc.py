"""WARC archives of captured pages, and capture histories merged from their locally sorted indexes."""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.shared import cut, give_back, prepare, rekeyed, shared_folder

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: Compressed bytes after which an archive file ends; a file is parsed by one task, record by record.
FILE_BYTES = 16 << 20
#: Entries in a page of a sorted run, and bytes of entries in one key range of the merge.
PAGE_ROWS, RANGE_BYTES = 1000, 16 << 20
#: A record whose length needs the fourth byte of a gzip trailer.
_LONG = 1 << 24
RUN = "url_key string, captured timestamp, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are eight groups of four letters."""
    digest = F.sha1(payload)
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def url_key(url: Column) -> Column:
    """Sort-friendly form of a URL: host labels reversed, then port, path and query as they are."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#:]*)", 1))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.substring(rest, F.length(host) + 1, F.length(rest)))


def with_roles(captures: DataFrame, smallest: int) -> DataFrame:
    """captures(page_id, url, captured, html) with payload_bytes, payload_digest, record_type, refers_to.

    Of records with equal payloads of `smallest` bytes or more the one with the smallest page_id is the
    response, the others revisit it. Digests meet in one row each before the join.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    keyed = captures.withColumn("html", body).withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": sha1_base32(body)})
    firsts = rekeyed(keyed.where(F.col("payload_bytes") >= smallest).groupBy("payload_digest").agg(F.min("page_id").alias("first_id")), "payload_digest")
    joined = keyed.join(firsts, "payload_digest", "left")
    again = (F.col("payload_bytes") >= smallest) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "captured", "html", "payload_bytes", "payload_digest",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"),
    )


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(roles: DataFrame) -> DataFrame:
    """One WARC/1.1 record per row as text, without the blank lines that end it."""
    safe_url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")),
        F.lit("\r\nWARC-Date: "), F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\r\nWARC-Target-URI: "), safe_url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    ]
    return roles.select(F.concat(*head).alias("record"))


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own, which ends with a zero byte: the high byte of the length. Records of
    16 MiB and more get an empty member after theirs for that."""
    pack = zlib.compressobj(5, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.flush()
    if len(record) >= _LONG:
        empty = zlib.compressobj(5, zlib.DEFLATED, 31)
        out += empty.compress(b"") + empty.flush()
    return out


def _info(name: str) -> bytes:
    """The record that opens an archive."""
    fields = b"software: tidegrid\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:{name}>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(fields)}\r\n\r\n"
    return head.encode() + fields + END.encode()


def _members(file_bytes: int):
    schema = pa.schema([("file", pa.int32()), ("at", pa.int64()), ("member", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, file, at = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            rows = []
            for record in batch.column(0):
                if at >= file_bytes:
                    file, at = file + 1, 0
                packed = member(record.as_buffer().to_pybytes() + END.encode())
                if not at:
                    packed = member(_info(f"{task}-{file}")) + packed
                rows.append((file, at, packed[:-1]))  # the line separator is the last byte
                at += len(packed)
            yield pa.RecordBatch.from_pydict({k: list(c) for k, c in zip(schema.names, zip(*rows, strict=True), strict=True)} if rows else {k: [] for k in schema.names}, schema=schema)
        give_back()

    return run


def write_archives(captures: DataFrame, path: str, smallest: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write captures(page_id, url, captured, html) as WARC files under path: a gzip member for each record, so
    that one can be read by its offset and length; a file ends once it has file_bytes.

    Spark's text writer lays the members end to end, and its commit protocol applies: a lost executor's files
    never show up. Nulls: html is an empty payload, url is about:blank, page_id has no number. Equal ids with
    equal payloads are all responses. An empty table writes no archive.
    """
    prepare(captures.sparkSession)
    packed = records(with_roles(captures, smallest)).select(F.col("record").cast("binary")).mapInArrow(_members(file_bytes), "file int, at long, member binary")
    rows = packed.sortWithinPartitions("file", "at").select("file", F.col("member").cast("string").alias("member"))
    rows.write.partitionBy("file").option("lineSep", "\0").option("compression", "none").text(path)


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record bytes) of each gzip member of an archive; of a plain file, all of it at 0."""
    view, at = memoryview(content), 0
    if bytes(view[:2]) != b"\x1f\x8b":
        yield 0, len(view), bytes(view)
        return
    while at < len(view):
        unzip, parts, begin = zlib.decompressobj(31), [], at
        while not unzip.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut short")
            parts.append(unzip.decompress(view[at : at + (1 << 20)]))
            at = min(at + (1 << 20), len(view))
        at -= len(unzip.unused_data)
        if data := b"".join(parts):
            yield begin, at - begin, data


def read_record(content: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """(headers, block) of the record that an index entry points to."""
    return next(_in_member(next(members(content[offset : offset + length]))[2]))[1:]


def _in_member(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, headers, block) of the records in the bytes of a member."""
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            if at < len(data):
                raise ValueError("a record is cut short")
            return
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        if end + 4 + size > len(data):
            raise ValueError("a record is cut short")
        yield at, headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of every record of an archive file. Offset and length are those of the
    gzip member that holds it."""
    for offset, length, data in members(content):
        for _, headers, block in _in_member(data):
            yield offset, length, headers, block


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


_ENTRY = pa.schema([("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
ENTRY_DDL = "url string, date string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"


def _entry(headers: dict[str, str], block: bytes, name: str, offset: int, length: int) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = headers["warc-payload-digest"].partition(":")[2]
    if headers["warc-type"] == "response":
        real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if real != digest or len(payload) != size:
            raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest {digest}: {real}")
    return headers["warc-target-uri"], headers["warc-date"], _number(headers["warc-record-id"]), headers["warc-type"], _number(headers.get("warc-refers-to")), size, digest, name, offset, length


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An index entry per response and revisit of each archive; a response's payload is held against its digest."""
    for batch in batches:
        for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows = []
            for offset, length, headers, block in parse(content.as_buffer()):
                if headers["warc-type"] in ("response", "revisit"):
                    rows.append(_entry(headers, block, name, offset, length))
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_pydict(dict(zip(_ENTRY.names, zip(*rows, strict=True), strict=True)), schema=_ENTRY)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(_ENTRY.names, zip(*rows, strict=True), strict=True)), schema=_ENTRY)
    give_back()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Every archive under path as a sorted run of index entries (RUN), one archive after another."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    keyed = files.mapInArrow(_index, ENTRY_DDL).select(
        url_key(F.col("url")).alias("url_key"), F.to_timestamp("date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
        "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "archive", "offset", "length",
    )
    return keyed.sortWithinPartitions("archive", "url_key", "captured", F.col("page_id").asc_nulls_last())


# ---- the merge --------------------------------------------------------------------------------

class LoserTree:
    """Merges k sorted iterators: an inner node keeps the loser of its match, so the next winner takes
    one comparison a level. Ties go to the earlier iterator."""

    _DONE = object()

    def __init__(self, runs: list[Iterator], key):
        self.key, self.runs, self.k = key, runs, len(runs)
        self.heads = [self._pull(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _pull(self, i):
        row = next(self.runs[i], self._DONE)
        return (self._DONE, None) if row is self._DONE else (row, self.key(row))

    def _before(self, a: int, b: int) -> bool:
        (x, kx), (y, ky) = self.heads[a], self.heads[b]
        if x is self._DONE or y is self._DONE:
            return y is self._DONE and (x is not self._DONE or a < b)
        return (kx, a) < (ky, b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to come waits here for its opponent
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def below(self, bound=None) -> Iterator:
        """The rows whose key is under a bound (None: all), in order."""
        while self.k and (top := self.heads[(w := self.losers[0])])[0] is not self._DONE and (bound is None or top[1] < bound):
            yield top[0]
            self.heads[w] = self._pull(w)
            self._play(w)

    def rest(self) -> list["_Cursor"]:
        """The cursors that are not at their end, each with its head put back."""
        out = []
        for (row, _), run in zip(self.heads, self.runs, strict=True):
            if row is not self._DONE:
                run.put_back(row)
                out.append(run)
        return out


_RUN = pa.schema([("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
#: A page, or the piece of one that lies in a range: its first key, and its entries as an Arrow stream.
PAGE_DDL = "range int, url_key string, captured long, page_id long, n int, entries binary"
_PAGE = pa.schema([("range", pa.int32()), ("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("n", pa.int32()), ("entries", pa.binary())])
_LEAST, _MOST = -(2**63), 2**63 - 1


def _key(url_key: str | None, captured: int | None, page_id: int | None) -> tuple:
    return url_key or "", _LEAST if captured is None else captured, page_id is None, page_id or 0


def _keys(entries: pa.RecordBatch) -> list[tuple]:
    return [_key(*x) for x in zip(*(entries.column(c).to_pylist() for c in ("url_key", "captured", "page_id")), strict=True)]


def _page(entries: pa.RecordBatch, of: int = 0) -> dict:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _RUN, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(entries)
    first = entries.slice(0, 1).to_pylist()[0]
    return {"range": of, "url_key": first["url_key"], "captured": first["captured"], "page_id": first["page_id"], "n": entries.num_rows, "entries": sink.getvalue().to_pybytes()}


def _entries(page: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(page) as got:
        return got.read_next_batch()


def _pages(rows_in_page: int):
    """Sorted runs, one after another, as pages; a page holds entries of one archive."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("archive").to_pylist()
            at = 0
            while at < len(names):
                end = min(bisect.bisect_right(names, names[at], at), at + rows_in_page)
                yield pa.RecordBatch.from_pylist([_page(pa.RecordBatch.from_arrays(batch.slice(at, end - at).columns, schema=_RUN))], schema=_PAGE)
                at = end

    return run


def _into_ranges(bounds: list[tuple]):
    """Pages cut at the bounds of the ranges."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                entries = _entries(row["entries"])
                keys, at = _keys(entries), 0
                while at < len(keys):
                    of = bisect.bisect_right(bounds, keys[at])
                    end = bisect.bisect_left(keys, bounds[of], at) if of < len(bounds) else len(keys)
                    out.append(row | {"range": of} if end - at == len(keys) else _page(entries.slice(at, end - at), of))
                    at = end
            yield pa.RecordBatch.from_pylist(out, schema=_PAGE)

    return run


class _Cursor:
    """The rows of a piece, (key, piece, number) each; keys are made a stretch at a time."""

    def __init__(self, page: bytes):
        self.entries, self.ready, self.at = _entries(page), [], 0

    def __next__(self):
        if not self.ready:
            if self.at >= self.entries.num_rows:
                raise StopIteration
            keys = _keys(self.entries.slice(self.at, 128))
            self.ready = [(key, self.entries, i) for i, key in enumerate(keys, self.at)][::-1]
            self.at += len(keys)
        return self.ready.pop()

    def put_back(self, row) -> None:
        self.ready.append(row)


def _out(rows: list[tuple]) -> pa.RecordBatch:
    pieces = {id(p): p for _, p, _ in rows}
    begin, at = {}, 0
    for name, p in pieces.items():
        begin[name], at = at, at + p.num_rows
    table = pa.Table.from_batches(list(pieces.values())).combine_chunks()
    taken = table.take(pa.array([begin[id(p)] + i for _, p, i in rows], pa.int64())).combine_chunks()
    return taken.to_batches()[0]


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a range, by their first key, merged into one order as they come: what lies under the first
    key of the pieces still to come can go out. Pieces are taken in lots as large as the tree, so that a
    piece is played into it a few times at most."""
    coming = ((r["range"], _key(r["url_key"], r["captured"], r["page_id"]), r["entries"]) for b in batches for r in b.to_pylist())
    held, ready, nxt = [], [], next(coming, None)
    while nxt is not None:
        of, lot = nxt[0], []
        while nxt is not None and nxt[0] == of and len(lot) < max(64, len(held)):
            lot.append(_Cursor(nxt[2]))
            nxt = next(coming, None)
        tree = LoserTree(held + lot, lambda row: row[0])
        for row in tree.below(nxt[1] if nxt is not None and nxt[0] == of else None):
            ready.append(row)
            if len(ready) == 4096:
                yield _out(ready)
                ready = []
        held = tree.rest()
    if ready:
        yield _out(ready)
    give_back()


def paged(runs: DataFrame, rows_in_page: int = PAGE_ROWS) -> DataFrame:
    """Sorted runs as a stored table of pages: the external index. Archives are parsed once, for this."""
    flat = runs.withColumn("captured", F.unix_micros("captured"))
    return cut(flat.mapInArrow(_pages(rows_in_page), PAGE_DDL), "none")


def merge_pages(pages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pages of sorted runs as one table (RUN), globally ordered by url_key, captured and page_id (null last)
    over its partitions.

    Key ranges hold about range_bytes of entries each; their bounds come from a sample of pages, eight a range
    at most, by whole keys, so that one host or URL may have a third of all captures. Pages are cut at the
    bounds. A range's pieces come to its task in order of their first key and leave it as a stream.
    """
    size, n = pages.agg(F.sum(F.octet_length("entries")), F.count("*")).first()
    ranges = -(-int(size or 0) // range_bytes)
    bounds = []
    if ranges > 1:
        some = pages.select("url_key", "captured", "page_id").orderBy(F.xxhash64("url_key", "captured", "page_id")).limit(8 * ranges).collect()
        keys = sorted({_key(*r) for r in some})
        bounds = [keys[i * len(keys) // ranges] for i in range(1, ranges)]
        bounds = sorted({b for b in bounds if b > keys[0]})
    pieces = pages.mapInArrow(_into_ranges(bounds), PAGE_DDL) if bounds else pages
    dealt = pieces.repartitionById(len(bounds) + 1, F.col("range"))
    ordered = dealt.sortWithinPartitions("range", "url_key", "captured", F.col("page_id").asc_nulls_last())
    flat = ordered.mapInArrow(_merge, RUN.replace("captured timestamp", "captured long"))
    return flat.withColumn("captured", F.timestamp_micros("captured"))


def archive_and_merge(captures: DataFrame, smallest: int = 0, path: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write captures as archives, read them back, and merge their indexes into capture histories.

    captures(page_id, url, captured, html) with html of any length; more columns are ignored. Returns RUN's
    columns, one row per capture, repeated rows and equal keys included; an empty table gives none.
    """
    spark = captures.sparkSession
    path = path or f"{shared_folder(spark)}/tidegrid/warc-{uuid.uuid4().hex}"
    write_archives(captures, path, smallest, file_bytes)
    return merge_pages(paged(read_index(spark, path)))
