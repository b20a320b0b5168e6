"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

A response becomes two records. Both name the response in WARC-Refers-To, keep its target URI and
date, and carry the digest of the payload that they were made from; the metadata record repeats
the headers of the source. Identifiers are name-based (the first 128 bits of a SHA-256), so a
second run, or a task that runs again, gives the same records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Date of the responses made from a table of pages, which has none.
EPOCH = "1970-01-01T00:00:00Z"
VERSION = "WARC/1.1"
#: What is no text: comments, the contents of scripts and the like, and tags. What isn't closed goes to
#: the end of the page, so that no part of it is looked at twice.
MARKUP = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<template\b.*?(?:</template\s*>|\z)|<noscript\b.*?(?:</noscript\s*>|\z)|<[a-z/!?][^>]*(?:>|\z)"
#: Named character references, besides numeric ones. Those of Latin-1 in order of their code
#: points from 160, then others as name and code point.
LATIN = (
    "nbsp iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr deg plusmn sup2 sup3 acute micro para middot cedil sup1 ordm raquo frac14 frac12 frac34 iquest "
    "Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil Egrave Eacute Ecirc Euml Igrave Iacute Icirc Iuml ETH Ntilde Ograve Oacute Ocirc Otilde Ouml times Oslash Ugrave Uacute Ucirc Uuml Yacute THORN szlig "
    "agrave aacute acirc atilde auml aring aelig ccedil egrave eacute ecirc euml igrave iacute icirc iuml eth ntilde ograve oacute ocirc otilde ouml divide oslash ugrave uacute ucirc uuml yacute thorn yuml"
)
OTHERS = "amp 38 lt 60 gt 62 quot 34 apos 39 OElig 338 oelig 339 Scaron 352 scaron 353 fnof 402 circ 710 tilde 732 ensp 8194 emsp 8195 thinsp 8201 ndash 8211 mdash 8212 lsquo 8216 rsquo 8217 sbquo 8218 ldquo 8220 rdquo 8221 bdquo 8222 dagger 8224 bull 8226 hellip 8230 prime 8242 euro 8364 trade 8482 larr 8592 rarr 8594 minus 8722 infin 8734 asymp 8776 ne 8800 le 8804 ge 8805"
REFERENCES = {name: chr(160 + i) for i, name in enumerate(LATIN.split())} | {n: chr(int(c)) for n, c in zip(OTHERS.split()[::2], OTHERS.split()[1::2])}
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"
TITLE = r"(?is)<title[^>]*>(.*?)(?:</title\s*>|\z)"


def character(code: Column) -> Column:
    """The character of a code point; U+FFFD for what is none."""
    hexed = F.lpad(F.hex(code), 8, "0")
    fine = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(fine, F.decode(F.unhex(hexed), "UTF-32")).otherwise("\ufffd")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decoded(text: Column) -> Column:
    """Character references replaced, each once; unknown names stay."""
    named = F.create_map(*[F.lit(x) for pair in REFERENCES.items() for x in pair])

    def one(ref: Column) -> Column:
        body = F.substring(ref, F.lit(2), F.length(ref) - 2)
        sixteen = F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10).cast("long")
        ten = F.substring(body, F.lit(2), F.length(body)).try_cast("long")
        return F.when(body.rlike("^#[xX]"), character(sixteen)).when(F.substring(body, 1, 1) == "#", character(ten)).otherwise(F.coalesce(F.try_element_at(named, body), ref))

    def replaced(text: Column) -> Column:
        found, gaps = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), F.split(text, REFERENCE)
        return once(F.struct(found.alias("found"), gaps.alias("gaps")), lambda s: F.concat(F.get(s["gaps"], F.lit(0)), F.array_join(F.zip_with(F.transform(s["found"], one), F.slice(s["gaps"], F.lit(2), F.size(s["found"])), lambda c, g: F.concat(c, g)), "")))

    return once(text, lambda t: F.when(t.contains("&"), replaced(t)).otherwise(t))


def squeezed(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.btrim(F.regexp_replace(text, r"[ \t\n\r\f]{2,}|[\t\n\r\f]", " "), F.lit(" "))  # single blanks stay as they are


def plain_text(html: Column) -> Column:
    return squeezed(decoded(F.regexp_replace(html, MARKUP, " ")))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def record_id(name: Column) -> Column:
    h = F.sha2(name, 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of a table of pages: page_id, response_id, target_uri, date, http_headers, payload.

    Null urls and pages count as empty.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"))
    name = F.concat(F.lit("response:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), url)
    return pages.select("page_id", record_id(name).alias("response_id"), url.alias("target_uri"), F.lit(EPOCH).alias("date"), headers.alias("http_headers"), html.alias("payload"))


def derivatives(source: DataFrame) -> DataFrame:
    """Two rows for each response: page_id, record_type, record_id, refers_to, target_uri, date,
    content_type, content_length, block_digest, source_digest, block.

    A response without payload gives records all the same, with an empty text. Repeated responses
    give repeated records with the same identifiers. One pass, no shuffle; columns beyond those of
    :func:`responses` aren't read.
    """
    made = source.select("page_id", "response_id", "target_uri", "date", "http_headers", "payload", digest(F.col("payload")).alias("source_digest"), plain_text(F.col("payload")).alias("text"), squeezed(decoded(F.regexp_extract("payload", TITLE, 1))).alias("title"))
    lines = F.concat(
        F.lit("source-payload-digest: "), F.col("source_digest"), F.lit("\r\nsource-payload-length: "), F.octet_length("payload").cast("string"), F.lit("\r\ntitle: "), F.col("title"),
        F.lit("\r\ntext-digest: "), digest(F.col("text")), F.lit("\r\nsource-headers: "), F.replace(F.col("http_headers"), F.lit("\r\n"), F.lit(" | ")), F.lit("\r\n"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), lines.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    rows = made.select("page_id", "response_id", "target_uri", "date", "source_digest", F.inline(kinds))
    return rows.select(
        "page_id", "record_type", record_id(F.concat("record_type", F.lit(":"), "response_id")).alias("record_id"), F.col("response_id").alias("refers_to"), "target_uri", "date",
        "content_type", F.octet_length("block").cast("long").alias("content_length"), digest(F.col("block")).alias("block_digest"), "source_digest", "block",
    )


def write_records(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as WARC files, one a task, each one stream of the codec."""
    fields = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("X-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    head = F.concat(F.lit(VERSION + "\r\n"), *[F.concat(F.lit(name + ": "), F.col(c).cast("string"), F.lit("\r\n")) for name, c in fields], F.lit("\r\n"))
    records.select(F.concat(head, "block", F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").option("compression", compression).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Read WARC files of version 1.1: headers (a map with lower-case names), raw (the block's bytes) and block (as text, with U+FFFD for what is no UTF-8).

    Blocks have the bytes that Content-Length says, whatever they hold, also the line that begins a
    record. Pieces between such lines come in order of the file and are put together again while a
    block is short of its length; a compressed file is read by one task, piece by piece. A record cut
    off by the end of its file has what there is.
    """
    lines = spark.read.option("lineSep", VERSION + "\r\n").text(path).select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("piece"))
    mark = (VERSION + "\r\n").encode()

    def parsed(data: bytes) -> tuple[list[tuple[str, str]], bytes, int]:
        head, _, rest = data.partition(b"\r\n\r\n")
        pairs = [line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")]
        named = list({k.strip().lower(): v.strip() for k, _, v in pairs if k.strip()}.items())
        length = dict(named).get("content-length", "")
        return named, rest, int(length) if length.isdigit() else len(rest)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, named, rest, length = None, None, [], 0

        def done() -> list[tuple]:
            return [] if named is None else [(named, b"".join(rest)[:length])]

        for batch in batches:
            out: list[tuple] = []
            for where, piece in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist()):
                held = sum(map(len, rest))
                if where == file and named is not None and held < length:  # the line stood inside a block
                    rest += [mark, piece]
                    continue
                out += done()
                file, named, rest, length = where, None, [], 0
                if piece.strip(b"\r\n"):
                    named, first, length = parsed(piece)
                    rest = [first]
            yield made(out)
        yield made(done())

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.map_(pa.string(), pa.string())), pa.array([b for _, b in out], pa.binary()), pa.array([b.decode("utf-8", "replace") for _, b in out], pa.string())], names=["headers", "raw", "block"])

    return lines.mapInArrow(join, "headers map<string,string>, raw binary, block string")


def responses_of(records: DataFrame) -> DataFrame:
    """What :func:`derivatives` takes, of the response records among those that :func:`read_records` gives; page_id is null."""
    h = lambda name: F.coalesce(F.col("headers")[name], F.lit(""))
    cut = F.instr("block", "\r\n\r\n")
    head = F.when(cut > 0, F.substring("block", F.lit(1), cut - 1)).otherwise(F.lit(""))
    payload = F.when(cut > 0, F.substring("block", cut + 4, F.length("block"))).otherwise(F.col("block"))
    rows = records.filter(F.col("headers")["warc-type"] == "response")
    return rows.select(F.lit(None).cast("long").alias("page_id"), h("warc-record-id").alias("response_id"), h("warc-target-uri").alias("target_uri"), h("warc-date").alias("date"), head.alias("http_headers"), payload.alias("payload"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))
