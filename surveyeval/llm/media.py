"""Media columns: store bytes as 8-bit media, and sniff what a binary column really holds.

Sniffing: an Aho-Corasick automaton finds the magic bytes of all formats in one pass, validators confirm structure and lengths
at each place, the declared type is corrected to what the whole value is, and further confirmed media inside are carved.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices
from .shared import positional

BLOCK = 64
# Magic bytes by kind of container, and how many bytes before them the medium starts.
MAGIC = {"riff": b"RIFF", "bmp": b"BM", "pgm": b"P5", "au": b".snd", "png": b"\x89PNG\r\n\x1a\n", "gif": b"GIF8", "zip": b"PK\x03\x04", "pdf": b"%PDF-", "jpeg": b"\xff\xd8\xff", "ogg": b"OggS", "mp4": b"ftyp"}
BEFORE = {"mp4": 4}
STORED = ("audio/wav", "image/bmp", "image/x-portable-graymap", "audio/basic")


def encode_media(payload: bytes, kind: str) -> bytes:
    """Store a payload (a positive multiple of 64 bytes) losslessly as 8-bit samples or pixels, 64 to a row."""
    n = len(payload)
    if kind == "audio/wav":
        return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + payload
    if kind == "audio/basic":
        return b".snd" + struct.pack(">IIIII", 24, n, 2, 8000, 1) + payload
    if kind == "image/x-portable-graymap":
        return b"P5\n%d %d\n255\n" % (BLOCK, n // BLOCK) + payload
    if kind == "image/bmp":
        palette = bytes(x for v in range(256) for x in (v, v, v, 0))
        head = struct.pack("<IiiHHIIiiII", 40, BLOCK, -(n // BLOCK), 1, 8, 0, n, 2835, 2835, 256, 0)
        return b"BM" + struct.pack("<IHHI", 1078 + n, 0, 0, 1078) + head + palette + payload
    raise ValueError(f"no encoder for {kind}")


class Parser:
    """Validators of the media that may start in one value: structure and lengths, each part of the value walked once.

    A validator takes the place where a medium may start and gives (type, length, payload start, payload length), or None.
    Walks over blocks remember where they failed, and ends of archives and documents are found once for the whole value, so
    the work grows with the value and not with the number of magic bytes in it.
    """

    def __init__(self, data: bytes) -> None:
        self.data, self.failed, self._ends = data, {}, {}

    def at(self, kind: str, at: int) -> tuple[str, int, int, int] | None:
        try:
            return getattr(self, kind)(at) if at >= 0 else None
        except (struct.error, ValueError, IndexError, OverflowError):
            return None

    def walk(self, kind: str, at: int, step) -> int | None:
        """Follow `step` from block to block until it gives (end, True); None where it gives None."""
        failed, seen = self.failed.setdefault(kind, set()), []
        while at not in failed:
            seen.append(at)
            got = step(at)
            if got is None:
                break
            at, done = got
            if done:
                return at
        failed.update(seen)
        return None

    def riff(self, at: int):
        size, form = struct.unpack_from("<I4s", self.data, at + 4)
        end = at + 8 + size
        if end > len(self.data) or form not in (b"WAVE", b"WEBP"):
            return None
        pos, head, body = at + 12, None, None
        while pos < end:
            name, n = struct.unpack_from("<4sI", self.data, pos)
            if pos + 8 + n > end:
                return None
            head = struct.unpack_from("<HHIIHH", self.data, pos + 8) if name == b"fmt " and n >= 16 else head
            body = (pos + 8 - at, n) if name in (b"data", b"VP8 ", b"VP8L") and body is None else body
            pos += 8 + n + n % 2
        if form == b"WEBP":
            return ("image/webp", 8 + size, *body) if body else None
        return ("audio/wav", 8 + size, *body) if body and head and head[1] > 0 and head[2] > 0 else None

    def au(self, at: int):
        head, n, code, rate, channels = struct.unpack_from(">IIIII", self.data, at + 4)
        if head >= 24 and 1 <= code <= 27 and rate and channels and head + n <= len(self.data) - at:
            return "audio/basic", head + n, head, n

    def pgm(self, at: int):
        found = re.compile(rb"P5(?:\s+#[^\n]*\n\s*|\s+)(\d{1,9})\s+(?:#[^\n]*\n\s*)?(\d{1,9})\s+(?:#[^\n]*\n\s*)?(\d{1,5})\s").match(self.data, at, at + 1024)
        if found:
            wide, high, most = map(int, found.groups())
            head, n = found.end() - at, wide * high * (1 if most < 256 else 2)
            if n and 0 < most < 65536 and head + n <= len(self.data) - at:
                return "image/x-portable-graymap", head + n, head, n

    def bmp(self, at: int):
        total, zero, start, size, wide, high, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", self.data, at + 2)
        n = (bits * wide + 31) // 32 * 4 * abs(high)
        if zero == 0 and size in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and packed in (0, 3) and wide > 0 and high and start >= 14 + size and start + n <= total <= len(self.data) - at:
            return "image/bmp", total, start, n

    def png(self, at: int):
        def chunk(pos):
            n, name = struct.unpack_from(">I4s", self.data, pos)
            if pos + 12 + n > len(self.data) or not name.isalpha() or zlib.crc32(memoryview(self.data)[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", self.data, pos + 8 + n)[0]:
                return None
            return pos + 12 + n, name == b"IEND"

        if self.data[at + 12 : at + 16] == b"IHDR" and (end := self.walk("png", at + 8, chunk)):
            return "image/png", end - at, 0, end - at

    def gif(self, at: int):
        def subblocks(pos):
            while n := self.data[pos]:
                pos += 1 + n
            return pos + 1

        def block(pos):
            mark = self.data[pos]
            if mark == 0x3B:
                return pos + 1, True
            if mark == 0x21:
                return subblocks(pos + 2), False
            if mark == 0x2C:
                flags = self.data[pos + 9]
                return subblocks(pos + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)), False
            return None

        def safe(pos):
            try:
                return block(pos)
            except IndexError:
                return None

        flags = self.data[at + 10]
        if self.data[at + 4 : at + 6] in (b"7a", b"9a") and (end := self.walk("gif", at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), safe)):
            return "image/gif", end - at, 0, end - at

    def jpeg(self, at: int):
        def segment(pos):
            if pos + 2 > len(self.data) or self.data[pos] != 0xFF:
                return None
            mark = self.data[pos + 1]
            if mark == 0xD9:
                return pos + 2, True
            if pos + 4 > len(self.data) or mark in (0x00, 0xD8, 0xFF):
                return None
            pos += 2 + struct.unpack_from(">H", self.data, pos + 2)[0]
            if mark == 0xDA:  # coded data goes on to the next marker that is no restart
                marks = self.ends("jpeg")
                i = bisect_left(marks, pos)
                pos = marks[i] if i < len(marks) else len(self.data)
            return pos, False

        if end := self.walk("jpeg", at + 2, segment):
            return "image/jpeg", end - at, 0, end - at

    def ogg(self, at: int):
        def page(pos):
            if self.data[pos : pos + 5] != b"OggS\0" or pos + 27 > len(self.data):
                return None
            n = self.data[pos + 26]
            end = pos + 27 + n + sum(self.data[pos + 27 : pos + 27 + n])
            return None if end > len(self.data) or pos + 27 + n > len(self.data) else (end, bool(self.data[pos + 5] & 4))

        if self.data[at + 4 : at + 5] == b"\0" and self.data[at + 5] & 2 and (end := self.walk("ogg", at, page)):
            return "application/ogg", end - at, 0, end - at

    def mp4(self, at: int):
        pos, size, media = at, len(self.data), False
        names = (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"sidx", b"styp", b"uuid", b"meta", b"udta")
        while pos + 8 <= size:
            n, name = struct.unpack_from(">I4s", self.data, pos)
            n = struct.unpack_from(">Q", self.data, pos + 8)[0] if n == 1 else n
            if name not in names or n < 8 or pos + n > size or (name == b"ftyp" and pos > at):
                break
            media |= name in (b"moov", b"mdat")
            pos += n
        if media:
            return "video/mp4", pos - at, 0, pos - at

    def zip(self, at: int):
        if end := self.ends("zip").get(at):
            return "application/zip", end - at, 0, end - at

    def pdf(self, at: int):
        if self.data[at + 5 : at + 6].isdigit() and (end := self.ends("pdf").get(at)):
            return "application/pdf", end - at, 0, end - at

    def ends(self, kind: str):
        if kind not in self._ends:
            self._ends[kind] = getattr(self, f"_{kind}_ends")()
        return self._ends[kind]

    def _jpeg_ends(self) -> list[int]:
        return [m.start() for m in re.finditer(rb"\xff[^\x00\xd0-\xd7\xff]", self.data, re.DOTALL)]

    def _zip_ends(self) -> dict[int, int]:
        """Start to end of archives: the end record gives the size and place of the directory, whose entries must fill it."""
        out, seen = {}, 0
        for m in re.finditer(rb"PK\x05\x06", self.data):
            if m.start() < seen or m.start() + 22 > len(self.data):
                continue
            count, size, place, note = struct.unpack_from("<HIIH", self.data, m.start() + 10)
            pos, first = m.start() - size, m.start() - size - place
            end = m.start() + 22 + note
            if first < 0 or end > len(self.data) or not count:
                continue
            for _ in range(count):
                if self.data[pos : pos + 4] != b"PK\x01\x02" or pos + 46 > m.start():
                    break
                pos += 46 + sum(struct.unpack_from("<HHH", self.data, pos + 28))
            else:
                if pos == m.start():
                    out[first], seen = end, m.start()
        return out

    def _pdf_ends(self) -> dict[int, int]:
        """Start to end of documents: every trailer gives the place of the last cross reference, which stands before it; the last trailer holds."""
        refs = [m.start() for m in re.finditer(rb"(?<![a-z])xref|\d{1,9} \d{1,5} obj", self.data)]
        out = {}
        for m in re.finditer(rb"startxref\s{1,4}(\d{1,12})\s{1,4}%%EOF", self.data):
            i = bisect_left(refs, m.start())
            if i and (first := refs[i - 1] - int(m[1])) >= 0:
                out[first] = m.end()
        return out


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, magic in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def sniff(data: bytes, machine) -> list[tuple[str, int, int, int, int]]:
    """Confirmed media as (type, start, length, payload start, payload length) in order of their start; one that is not the whole value is not looked into."""
    out, past, parser = [], 0, Parser(data)
    for end, (kind, n) in machine.iter(data.decode("latin-1")):
        at = end + 1 - n - BEFORE.get(kind, 0)
        if at >= past and (got := parser.at(kind, at)):
            out.append((got[0], at, got[1], at + got[2], got[3]))
            past = at + (got[2] or 1 if at == 0 else got[1])  # look inside the outer medium, not inside carved ones
    return out


def store_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", kinds=STORED) -> DataFrame:
    """(doc_id, n_bytes, declared, media): each text's UTF-8 bytes (null: none), zero-padded to a positive multiple of 64, as 8-bit media.

    The format follows the payload's CRC, so equal texts are stored alike.  `declared` is what the sender says: each `source`
    declares one type whatever it sends (a hash of its name; without that column, or where it is null, nothing is declared).  Repeated rows are stored each; a very
    long text is one value in memory; other columns, of whatever names, are ignored; an empty table gives an empty result.
    """
    said = F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(F.xxhash64(source), F.lit(len(kinds))) + 1).cast("int")) if source in docs.columns else F.lit(None).cast("string")
    said = F.when(F.col(source).isNotNull(), said) if source in docs.columns else said

    def local(batches):
        for batch in slices(batches, "body"):
            n, media = [], []
            for body in batch.column("body").to_pylist():
                raw = body.encode()
                payload = raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))
                code = zlib.crc32(payload)
                n.append(len(raw))
                media.append(encode_media(payload, kinds[code % len(kinds)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("declared"), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), said.alias("declared"), F.coalesce(F.col(text), F.lit("")).alias("body")).mapInArrow(local, f"doc_id {kind}, n_bytes long, declared string, media binary")


MEDIA = "type string, corrected boolean, payload binary, carved array<struct<type:string,start:long,length:long>>"


def sniff_media(df: DataFrame, media: str = "media", declared: str = "declared") -> DataFrame:
    """All columns of df plus type, corrected, payload and carved (input columns of those names are replaced).

    type is what the whole value is (null if nothing valid starts at byte 0), corrected tells whether that differs from `declared`, payload
    holds its samples, carved lists confirmed media inside.  Null and empty values have no type, payload or carved media.
    Repeated rows are sniffed each; a very long value is one value in memory; an empty table gives an empty result.
    """
    own, names = positional(df, ("type", "corrected", "payload", "carved"))
    columns, value_at, said_at = own.columns, f"c{names.index(media)}", f"c{names.index(declared)}"

    def local(batches):
        machine = automaton()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                types, fixed, payloads, carved = [], [], [], []
                for value, said in zip(part.column(value_at), part.column(said_at).to_pylist(), strict=True):
                    data = value.as_py() or b""
                    found = sniff(data, machine) if data else []
                    whole = found[0] if found and found[0][1] == 0 else None
                    types.append(whole[0] if whole else None)
                    fixed.append(bool(whole) and whole[0] != said)
                    payloads.append(data[whole[3] : whole[3] + whole[4]] if whole else None)
                    carved.append([{"type": k, "start": a, "length": n} for k, a, n, _, _ in found if a > 0])
                kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
                more = [pa.array(types, pa.string()), pa.array(fixed, pa.bool_()), pa.array(payloads, pa.binary()), pa.array(carved, kind)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*columns, "type", "corrected", "payload", "carved"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(local, f"{schema}, {MEDIA}").toDF(*names, "type", "corrected", "payload", "carved")


def sample_feature(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with `samples`: mean and deviation of the 8-bit samples and the entropy of their histogram in bits; null for no samples."""

    @F.pandas_udf("string")
    def described(values: pd.Series) -> pd.Series:
        out = []
        for value in values:
            x = np.frombuffer(value or b"", np.uint8)
            share = np.bincount(x, minlength=256) / max(1, len(x))
            held = share[share > 0]
            out.append(f"mean={x.mean():.2f} sd={x.std():.2f} bits={abs(-(held * np.log2(held)).sum()):.2f}" if len(x) else None)
        return pd.Series(out, dtype=object)

    return df.withColumn("samples", described(payload))


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    seen = sample_feature(sniff_media(store_text(docs)))
    return seen.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(" ", "type", F.concat(F.lit("carved="), F.size("carved").cast("string")), F.concat(F.lit("rows="), (F.octet_length("payload") / BLOCK).cast("long").cast("string")), "samples").alias("feature"),
        F.col("declared"), F.col("corrected"),
    )
