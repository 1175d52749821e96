"""ARC and WARC records as bytes: written, and read by their declared lengths."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

#: The fields of an ARC record's header line by version, and the profile of a revisit record.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER = "X-Page-Id"


@dataclass
class Record:
    """A record of an archive. `head` is the HTTP head with its blank line (empty where the block is no HTTP message), `payload` what follows it."""

    place: int
    uri: str
    date: str
    mime: str
    address: str
    head: bytes
    payload: bytes
    kind: str = "response"
    named: dict[str, str] = field(default_factory=dict)


def unpacked(raw: bytes) -> bytes:
    """The bytes of a file that may be gzipped, in one member or many."""
    parts = []
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(raw))
        raw = member.unused_data
    return b"".join([*parts, raw])


def split_block(block: bytes) -> tuple[bytes, bytes]:
    """(HTTP head, payload); old servers end the head with bare newlines."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(m.start(), m.end()) for m in [re.search(rb"\r\n\r\n|\n\n", block)] if m]
    return (block[: ends[0][1]], block[ends[0][1] :]) if ends else (block, b"")


def head_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", head)
    return found[1].decode("utf-8", "replace") if found else None


# --- ARC


def arc_uri(url: str | None) -> str:
    """A url as a field of a header line: blanks and controls are escaped, a missing one is `-`."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "-"


def arc_version_block(version: str, name: str, date: str) -> bytes:
    body = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    first = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    if version == "2":
        first += ["200", "-", "-", "0", name]
    return f"{' '.join(first)} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: str, name: str, offset: int, url: str | None, date: str, block: bytes) -> bytes:
    fields = [arc_uri(url), "0.0.0.0", date, "text/html"]
    if version == "2":
        fields += ["200", "-", "-", str(offset), name]
    return f"{' '.join(fields)} {len(block)}\n".encode("utf-8", "surrogatepass") + block + b"\n"


def iso_date(arc_date: str) -> str:
    """14 digits (12 in the oldest archives) as a WARC date."""
    d = (arc_date if arc_date.isdigit() else "").ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def read_arc(raw: bytes) -> Iterator[Record]:
    """The records of an ARC file after its version block. Which fields a header line has is what the block's version and its own list of
    fields say; a block is as long as its line declares. A block that the file ends in is marked as truncated; a line that is no header raises ValueError."""
    raw, at, names = unpacked(raw), 0, None
    while True:
        while raw[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(raw):
            return
        end = raw.find(b"\n", at)
        line = raw[at : end if end >= 0 else len(raw)].decode("utf-8", "surrogatepass").rstrip("\r")
        start = end + 1 if end >= 0 else len(raw)
        count = len(names) if names else len(ARC_FIELDS["2"] if len(line.split(" ")) > 5 else ARC_FIELDS["1"])
        fields = line.rsplit(" ", count - 1)
        if len(fields) != count or not fields[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}: {line[:80]!r}")
        length = int(fields[-1])
        block = raw[start : start + length]
        if names is None:
            said = block.decode("utf-8", "replace").split("\n")
            version = said[0].split(" ")[0]
            names = said[1].split() if len(said) > 1 and said[1].strip() else ARC_FIELDS.get(version)
            if not fields[0].startswith("filedesc:") or not names:
                raise ValueError("an ARC file begins with its version block")
        else:
            row = dict(zip(names, fields))
            head, payload = split_block(block)
            named = {"WARC-Truncated": "length"} if len(block) < length else {}
            kind = "response" if head else "resource"
            yield Record(at, fields[0], iso_date(row.get("Archive-date", "")), row.get("Content-type", "application/octet-stream"), row.get("IP-address", ""), head, payload, kind, named)
        at = start + length


# --- WARC


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def sha1_label(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def hex_of_label(label: str) -> str:
    return base64.b32decode(label.partition(":")[2]).hex()


def warc_record(kind: str, identifier: str, date: str, block: bytes, content_type: str, named: dict[str, str]) -> bytes:
    """One record without the two line ends that follow it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in named.items())]
    lines += [f"WARC-Block-Digest: {sha1_label(hashlib.sha1(block).hexdigest())}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block


def read_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields with lower-case names, block) of every record, by declared lengths."""
    raw, at = unpacked(raw), 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        lines = raw[at : max(end, at)].decode("utf-8", "surrogatepass").split("\r\n")
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not lines[0].startswith("WARC/") or not named.get("content-length", "").isdigit():
            raise ValueError(f"no WARC record at byte {at}")
        start = end + 4
        stop = start + int(named["content-length"])
        if stop > len(raw):
            raise ValueError(f"the record at byte {at} ends after the file")
        yield named, raw[start:stop]
        at = stop + 4
