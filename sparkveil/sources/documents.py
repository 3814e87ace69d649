"""Word and e-mail files, with the standard library: units of text for the engine, and the same file with replacements written in.

A file's parser runs twice, to read units and to write them, over the same numbering; so that the work in between is a plain
join of replacements by (doc_seq, unit_seq). Parts are patched in place, character data only; no markup is generated anew."""

from __future__ import annotations

import difflib
import email
import email.encoders
import email.header
import email.policy
import html as html_lib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from email.header import decode_header, make_header
from html.parser import HTMLParser
from xml.sax.saxutils import escape, unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import FORMATS, LEGACY, BackendUnavailable, format_of

#: Gives the new text of a unit (where, segments, joiners) as new segments.
Plan = Callable[[str, list[str], list[str]], list[str]]

# fixed values: parts, marks and attributes of the formats
WORD_PARTS = re.compile(r"^word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml$")
WORD_LINKS = re.compile(r"^word/_rels/.*\.rels$")
FIXED_MARKS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
PERSONAL_HEADERS = ("Subject", "From", "To", "Cc", "Bcc", "Reply-To", "Sender", "Return-Path", "Delivered-To", "X-Original-To", "Disposition-Notification-To", "Thread-Topic")
ROUTING_HEADERS = ("received", "x-received", "x-originating-ip", "x-sender-ip", "authentication-results", "received-spf", "dkim-signature", "x-google-dkim-signature", "arc-", "x-ms-exchange-", "x-microsoft-antispam", "x-forefront-", "x-ms-", "x-gm-", "x-google-smtp-source", "x-mailgun-", "x-ses-")
INLINE = frozenset("a b i u em strong span font small big sub sup mark abbr code s strike label q cite".split())
#: Further headers that identify a sender, left unread by the rules above.
TRACING_HEADERS = ("message-id", "in-reply-to", "references", "user-agent")
SILENT = frozenset("script style head meta".split())
ANONYMOUS = "Anonym"


def _xml_text(raw: str) -> str:
    return unescape(raw, {"&quot;": '"', "&apos;": "'"})


_PARAGRAPH = re.compile(r"<w:p(?:\s[^>]*)?>|</w:p>")
_RUN = re.compile(r"(<w:(t|delText)(?:\s[^>]*)?(?<!/)>)(.*?)</w:\2>|<w:(tab|br|cr|noBreakHyphen)(?:\s[^>]*)?/>", re.S)


def _word_paragraphs(xml: str) -> list[list[tuple[int, int, str, bool]]]:
    """For each paragraph its text nodes (from, to, text, writable) by position in the part; nested paragraphs are their own."""
    events = sorted([(m.start(), 0, m) for m in _PARAGRAPH.finditer(xml)] + [(m.start(), 1, m) for m in _RUN.finditer(xml)], key=lambda e: e[:2])
    out: list[list[tuple[int, int, str, bool]]] = []
    open_: list[list[tuple[int, int, str, bool]]] = []
    for _, kind, m in events:
        if kind == 0 and not m.group().startswith("</"):
            if m.group().endswith("/>"):
                continue
            open_.append([])
            out.append(open_[-1])
        elif kind == 0:
            if open_:
                open_.pop()
        elif open_:
            open_[-1].append((m.start(3), m.end(3), _xml_text(m.group(3)), True) if m.group(2) else (m.start(), m.end(), FIXED_MARKS[m.group(4)], False))
    return out


def _spread(nodes: list[tuple[int, int, str, bool]], old: str, new: str) -> list[tuple[int, int, str]]:
    """Changes of a paragraph's text nodes: what differs goes to the first node that it touches, and leaves the others."""
    texts = [n[2] for n in nodes]
    bounds, at = [], 0
    for t in texts:
        bounds.append((at, at + len(t)))
        at += len(t)
    for tag, a, b, c, d in reversed(difflib.SequenceMatcher(None, old, new, False).get_opcodes()):
        if tag == "equal":
            continue
        first = True
        for k, (x, y) in enumerate(bounds):
            if nodes[k][3] and (x < b and a < y or a == b and x <= a <= y and first):
                t = texts[k]
                texts[k] = t[: max(0, a - x)] + (new[c:d] if first else "") + t[max(0, min(b, y) - x) :]
                first = False
    return [(n[0], n[1], escape(t)) for n, t in zip(nodes, texts, strict=True) if n[3] and t != n[2]]


def _patched(xml: str, changes: list[tuple[int, int, str]]) -> str:
    for a, b, t in sorted(changes, reverse=True):
        xml = xml[:a] + t + xml[b:]
    return xml


def docx(data: bytes, plan: Plan, scrub: bool, warn: list[str]) -> bytes:
    src = zipfile.ZipFile(io.BytesIO(data))
    parts = {i.filename: src.read(i) for i in src.infolist()}
    texts = {n: parts[n].decode("utf-8") for n in parts if WORD_PARTS.match(n) or WORD_LINKS.match(n) or n in ("docProps/core.xml", "docProps/app.xml")}
    paragraphs = [(n, p) for n in parts if WORD_PARTS.match(n) for p in _word_paragraphs(texts[n])]
    old = ["".join(x[2] for x in p) for _, p in paragraphs]
    changes: dict[str, list[tuple[int, int, str]]] = {}
    if old:
        for (n, p), a, b in zip(paragraphs, old, plan("odsek", old, ["\n"] * len(old)), strict=True):
            if a != b:
                runs = _spread(p, a, b)
                # blanks at the edges of a rewritten run count
                tags = {x: texts[n][texts[n].rfind("<", 0, x) : x] for x, _, _ in runs}
                changes.setdefault(n, []).extend(runs + [(x - 1, x - 1, ' xml:space="preserve"') for x, tag in tags.items() if "xml:space" not in tag])
    single = [(n, r"<w:instrText(?:\s[^>]*)?>(.*?)</w:instrText>", "pole") for n in texts if WORD_PARTS.match(n)]
    single += [(n, r'<Relationship\b(?=[^>]*TargetMode="External")[^>]*\bTarget="([^"]*)"', "odkaz") for n in texts if WORD_LINKS.match(n)]
    single += [("docProps/core.xml", rf"<(?:dc:{k}|cp:{k})(?:\s[^>]*)?>(.*?)</", "metadata") for k in ("title", "subject", "description", "keywords") if "docProps/core.xml" in texts]
    for n, pattern, where in single:
        for m in re.finditer(pattern, texts[n], re.S):
            a = _xml_text(m.group(1))
            b = plan(where, [a], ["\n"])[0]
            if a != b:
                changes.setdefault(n, []).append((m.start(1), m.end(1), escape(b, {'"': "&quot;"})))
    for n, c in changes.items():
        texts[n] = _patched(texts[n], c)
    if scrub:
        for n in texts:
            if WORD_PARTS.match(n):
                texts[n] = re.sub(r'(w:author=")[^"]*"', rf'\g<1>{ANONYMOUS}"', re.sub(r'(w:initials=")[^"]*"', r'\g<1>A"', texts[n]))
        for n, tags, value in (("docProps/core.xml", "dc:creator|cp:lastModifiedBy", ANONYMOUS), ("docProps/app.xml", "Company|Manager", "")):
            if n in texts:
                texts[n] = re.sub(rf"(<({tags})(?:\s[^>]*)?>)[^<]*(</\2>)", rf"\g<1>{value}\g<3>", texts[n])
        if any(n.startswith("word/media/") for n in parts):
            warn.append("images are kept as they are")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i in src.infolist():
            z.writestr(i, texts[i.filename].encode("utf-8") if i.filename in texts else parts[i.filename])
    return out.getvalue()


class _Slots(HTMLParser):
    """Text of an HTML document with its places, and mailto: and tel: targets. Text after a comment, and the title, count too."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=False)
        self.html, self.lines = html, [0]
        for line in html.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.slots: list[list] = []  # from, to, block number
        self.links: list[tuple[int, int]] = []
        self.block, self.silent = 0, 0
        self.feed(html)
        self.close()

    def _at(self) -> int:
        row, col = self.getpos()
        return self.lines[row - 1] + col

    def handle_starttag(self, tag, attrs):
        self.block += tag not in INLINE
        self.silent += tag in SILENT and tag != "meta" and tag != "head"
        raw, at = self.get_starttag_text() or "", self._at()
        if m := re.search(r"""href\s*=\s*["']?((?:mailto|tel):[^"'\s>]*)""", raw, re.I):
            self.links.append((at + m.start(1), at + m.end(1)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.block += tag not in INLINE
        if tag in SILENT and tag not in ("meta", "head"):
            self.silent = max(0, self.silent - 1)

    def _text(self, size: int) -> None:
        at = self._at()
        if self.silent or not size:
            return
        if self.slots and self.slots[-1][2] == self.block and self.slots[-1][1] == at:
            self.slots[-1][1] = at + size
        else:
            self.slots.append([at, at + size, self.block])

    def handle_data(self, data):
        self._text(len(data))

    def handle_entityref(self, name):
        at = self._at()
        self._text(len(name) + 1 + (self.html[at + len(name) + 1 : at + len(name) + 2] == ";"))

    def handle_charref(self, name):
        at = self._at()
        self._text(len(name) + 2 + (self.html[at + len(name) + 2 : at + len(name) + 3] == ";"))


def html_text(html: str, plan: Plan) -> str:
    quote, unquote = html_lib.escape, html_lib.unescape
    s = _Slots(html)
    old = [unquote(html[a:b]) for a, b, _ in s.slots]
    joiners = ["" if n + 1 < len(s.slots) and s.slots[n + 1][2] == s.slots[n][2] else "\n" for n in range(len(s.slots))]
    changes = []
    if old:
        changes = [(x[0], x[1], quote(b, quote=False)) for x, a, b in zip(s.slots, old, plan("html", old, joiners), strict=True) if a != b]
    for a, b in s.links:
        kind, _, target = unquote(html[a:b]).partition(":")
        new = plan("odkaz", [target], ["\n"])[0]
        if new != target:
            changes.append((a, b, quote(f"{kind}:{new}")))
    return _patched(html, changes)


def eml(data: bytes, plan: Plan, scrub: bool, warn: list[str]) -> bytes:
    msg = email.message_from_bytes(data, policy=email.policy.compat32)
    _message(msg, plan, scrub, warn)
    return msg.as_bytes(policy=email.policy.SMTP if b"\r\n" in data[:2000] else email.policy.compat32)


def _message(msg, plan: Plan, scrub: bool, warn: list[str]) -> None:
    if scrub:
        for k in {k for k in msg.keys() if k.lower().startswith(ROUTING_HEADERS + TRACING_HEADERS)}:
            del msg[k]
    for k in PERSONAL_HEADERS:
        if msg.get_all(k):
            values = [str(make_header(decode_header(str(v)))) for v in msg.get_all(k)]
            new = [plan(f"hlavicka:{k}", [v], ["\n"])[0] for v in values]
            if new != values:
                del msg[k]
                for v in new:
                    msg[k] = v if v.isascii() else email.header.Header(v, "utf-8").encode()
    _part(msg, plan, scrub, warn, None)


def _part(part, plan: Plan, scrub: bool, warn: list[str], parent) -> None:
    if part.get_content_type() == "message/rfc822" and isinstance(part.get_payload(), list):
        for inner in part.get_payload():
            _message(inner, plan, scrub, warn)
        return
    if part.is_multipart():
        for p in list(part.get_payload()):
            _part(p, plan, scrub, warn, part)
        return
    name = part.get_filename()
    body = part.get_payload(decode=True) or b""
    if part.get_content_maintype() == "text" and not name and part.get_content_disposition() != "attachment":
        charset = part.get_content_charset() or "utf-8"
        try:
            text = body.decode(charset)
        except (LookupError, UnicodeDecodeError):
            text = body.decode("utf-8", "replace")
        new = html_text(text, plan) if part.get_content_subtype() == "html" else "\n".join(plan("riadok", lines := text.split("\n"), ["\n"] * len(lines)))
        if new != text:
            del part["Content-Transfer-Encoding"]
            part.set_payload(new, "utf-8")
        return
    kind = FORMATS.get("." + name.rpartition(".")[2].lower()) if name and "." in name else None
    if kind in (None, "pdf"):
        if scrub and parent is not None:
            warn.append("an attachment of an unsupported format was removed")
            parent.get_payload().remove(part)
        return
    new = CONVERT[kind](body, plan, scrub, warn)
    probe = re.sub(r"[_\-.]", " ", name)
    called = plan("nazov_suboru", [probe], ["\n"])[0]
    if new != body:
        del part["Content-Transfer-Encoding"]
        part.set_payload(new)
        email.encoders.encode_base64(part)
    if called != probe:
        stem, dot, ext = name.rpartition(".")
        part.set_param("filename", called.removesuffix(f" {ext}") + dot + ext, "Content-Disposition")
        if part.get_param("name"):
            part.set_param("name", called.removesuffix(f" {ext}") + dot + ext)


def text(data: bytes, plan: Plan, scrub: bool, warn: list[str]) -> bytes:
    for encoding in ("utf-8-sig", *LEGACY):
        try:
            t = data.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    else:
        t = data.decode("utf-8", "replace")
    lines = t.split("\n")
    return "\n".join(plan("riadok", lines, ["\n"] * len(lines))).encode()


def pdf(data: bytes, plan: Plan, scrub: bool, warn: list[str]) -> bytes:
    raise BackendUnavailable("PDF needs a word extractor and a page renderer; see sparkveil.sources.pages")


CONVERT = {"text": text, "docx": docx, "eml": eml, "pdf": pdf}
_UNIT = "doc_seq long, unit_seq int, where string, text string, lengths array<int>, joiners array<string>, error string"


def units(files: DataFrame) -> DataFrame:
    """doc_seq, unit_seq, where, text, lengths, joiners, error: the units of each file in reading order; text holds the segments, each with its joiner behind.
    A file that cannot be read is one row with the error and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for seq, kind, content in zip(b.column("doc_seq"), b.column("kind"), b.column("content"), strict=True):
                rows: list[tuple] = []

                def note(where: str, segs: list[str], joiners: list[str], rows=rows) -> list[str]:
                    rows.append((where, "".join(s + j for s, j in zip(segs, joiners, strict=True)), [len(s) for s in segs], joiners, None))
                    return segs

                try:
                    CONVERT[kind.as_py()](content.as_py(), note, False, [])
                except Exception as e:  # one bad file does not end the run; it is reported
                    rows = [("", None, [], [], f"{type(e).__name__}: {e}")]
                cols = [pa.array([seq.as_py()] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string())))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_seq", "unit_seq", "where", "text", "lengths", "joiners", "error"])

    return files.withColumn("kind", format_of(F.col("name"))).where("kind IS NOT NULL").select("doc_seq", "kind", "content").mapInArrow(run, _UNIT)


def replaced(lengths: list[int], segs: list[str], joiners: list[str], reps: list[dict]) -> list[str]:
    """Segments with unit-wide replacements: the first piece of a span gets the token, pieces in other segments go."""
    out, at = [], 0
    lost: set[int] = set()  # spans that begin in a joiner have their first piece in the next segment
    for n, (s, j) in enumerate(zip(segs, joiners, strict=True)):
        new, pos = [], 0
        for r in reps:
            a, b = max(r["start"], at) - at, min(r["end"], at + lengths[n]) - at
            if a < b:
                new += [s[pos:a], r["token"] if r["start"] >= at or r["start"] in lost else ""]
                pos = b
                lost.discard(r["start"])
            elif at + lengths[n] <= r["start"] < at + lengths[n] + len(j):
                lost.add(r["start"])
        out.append("".join(new) + s[pos:])
        at += lengths[n] + len(j)
    return out


def write(files: DataFrame, reps: DataFrame, scrub: bool = True) -> DataFrame:
    """doc_seq, name, content, warnings, error: the files with the replacements (doc_seq, unit_seq, reps: start, end, token) written in.

    scrub: routing headers, authors and unsupported attachments go, as they do when a file is anonymised but not when it is restored."""
    per = reps.groupBy("doc_seq").agg(F.map_from_entries(F.collect_list(F.struct("unit_seq", "reps"))).alias("plan"))  # of one file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for kind, content, plan_ in zip(b.column("kind"), b.column("content"), b.column("plan").to_pylist(), strict=True):
                todo, warn, n = dict(plan_ or ()), [], [0]

                def put(where: str, segs: list[str], joiners: list[str], todo=todo, n=n) -> list[str]:
                    mine = todo.get(n[0], ())
                    n[0] += 1
                    return replaced([len(s) for s in segs], segs, joiners, mine) if mine else segs

                try:
                    rows.append((CONVERT[kind.as_py()](content.as_py(), put, scrub, warn), warn, None))
                except Exception as e:
                    rows.append((None, warn, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([b.column("doc_seq"), b.column("name"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.string())], ["doc_seq", "name", "content", "warnings", "error"])

    short = per.select("doc_seq", F.expr("transform_values(plan, (k, v) -> transform(v, r -> struct(r.start AS start, r.end AS end, r.token AS token)))").alias("plan"))
    return files.withColumn("kind", format_of(F.col("name"))).where("kind IS NOT NULL").join(short, "doc_seq", "left").select("doc_seq", "name", "kind", "content", "plan").mapInArrow(run, "doc_seq long, name string, content binary, warnings array<string>, error string")
