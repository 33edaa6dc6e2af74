"""Problem 8: sentence boundaries in any language, amid markup and damage.

A text is parsed into blocks (paragraphs and list lines; headings, tables, rules and
the like end a block and hold no sentence). Within a block every end mark outside of
quotations, brackets, links, templates, tags, comments, addresses and titles is a
candidate, and so is the end of a quotation and, in Thai, a space. A maximum-entropy
model decides each: it weighs the tokens on both sides, their case, length, digits and
script, how often over all documents they stand at the end and at the start of a block,
and the form of the place as a whole. Only a block's own end needs no decision.

The model is trained on boundaries that are reliable without it: the end of a block
followed by the start of the next one (positive), and marks followed by a small letter,
after tokens that never end a block, or before tokens that never start one (negative);
places whose form leaves no doubt, such as a Chinese full stop, are examples of both.
Words that end blocks as often as words do on average are reliable within one, too.
Weights start from what the form alone would say, so that little text is enough.

Texts are analysed once: equal passages of documents that lie together are remembered,
and what is found is kept in the shared folder, from which counts, examples and decisions
are taken.
"""

from __future__ import annotations

import hashlib
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize
from .encode import together

BUCKETS = 1 << 17
#: Features of tokens and their habits, hashed; those of whole forms have indexes of their own after them.
DIMS, FORMS = 1 << 16, 1 << 12
#: Weight that a form without doubt begins with.
PRIOR = 4.0
#: Decisions that a worker keeps for equal contexts.
MOST_KNOWN = 200_000
#: Characters of distinct blocks that a worker keeps with what it found in them.
MOST_KEPT = 3_000_000
#: Blocks that a worker keeps as lists, ready to be written.
MOST_LISTED = 20_000
#: Different surroundings from which on a token's habits count as known.
MANY = 8
#: Different surroundings, left and right of a mark, from which on :func:`features` and :func:`label` tell a token from one never met.
LEAST_LEFT, LEAST_RIGHT = 2, 3
#: Training examples for each document of the sample, on average, at most.
EXAMPLES = 40
#: White space, zero-width space and byte-order mark included.
SPACE = r"\s​﻿"

# Fixed values of the markup: namespaces of file and category lines, redirect words, maintenance templates.
NAMESPACES = (
    "file|image|media|category|datei|bild|kategorie|fichier|catégorie|archivo|imagen|categoría|файл|изображение|категория|"
    "文件|分类|分類|ファイル|画像|カテゴリ|αρχείο|εικόνα|κατηγορία|चित्र|श्रेणी|ملف|صورة|تصنيف|ไฟล์|ภาพ|หมวดหมู่"
)
REDIRECTS = "redirect|weiterleitung|redirection|redirección|redireccion|перенаправление|перенапр|重定向|転送|リダイレクト|ανακατευθυνση|ανακατεύθυνση|अनुप्रेषित|تحويل|เปลี่ยนทาง"
MAINTENANCE = "citation needed|cn|fact|clarify|when|who|which|by whom|where|dubious|failed verification|dead link|page needed|full citation needed|verify source|update after|as of?|better source needed|vague|sic|quelle|refnec|cita requerida"

_OPAQUE = regex.compile(r"<!--|\{\{|(?m:^)[^\S\n]*\{\||<ref\b[^<>]*?/\s*>|<ref\b[^<>]*>|</?[A-Za-z][^<>\n]*>")
_BRACES = regex.compile(r"\{\{+|\}\}+")
_BLANK = regex.compile(r"\n[^\S\n]*\r?\n")
_TABLE_END = regex.compile(r"\n[^\S\n]*\|\}")
_HEAD = regex.compile(r"[^\S\n]*(?:=+.*=+[^\S\n]*$|==|-{4,}|__\p{Lu}+__[^\S\n]*$|#\s*(?:" + REDIRECTS + r")\s*:?\s*\[\[)", regex.I)
_NAMED = regex.compile(r"[^\S\n]*(?:\[\[\s*(?:" + NAMESPACES + r")\s*:(?:[^\[\]]|\[\[[^\[\]]*\]\]|\[[^\[\]]*\])*(?:\]\]|$)[^\S\n]*)+$", regex.I)
_CUT_NAMED = regex.compile(r"[^\S\n]*\[\[(\p{L}*)$")
_NAMES = NAMESPACES.split("|")
_LIST = regex.compile(r"[^\S\n]*[*#:]+")
_TABLE_ROW = regex.compile(r"[^\S\n]*(?:\|[-}+]?|!)")
_VISIBLE = regex.compile(rf"[^{SPACE}]")
_MARKS = ".!?。！？｡．؟۔।॥…;;"
_SCAN = regex.compile(
    r"(?P<url>(?i:https?|ftp)://[^\s<>\[\]|{}\"”»]+|(?i:www)\.[^\s<>\[\]|{}\"”»]+)|(?P<note>\[(?:\d{1,3}|[a-z]|note \d+|nb \d+)\])|(?P<link>\[\[|\]\])|(?P<tick>'{2,5})"
    r"|(?P<open>[(（\[「『《〈“„«‹【])|(?P<close>[)）\]」』》〉”»›】])|(?P<plain>\")|(?P<mark>[.!?。！？｡．؟۔।॥…;;]+)"
)
_PAIR = {")": "(", "）": "（", "]": "[", "」": "「", "』": "『", "》": "《", "〉": "〈", "”": "“", "»": "«", "›": "‹", "】": "【"}
_QUOTES = "“„«‹「\""
_LEFT = regex.compile(r"(?r)[\p{L}\p{M}\p{N}\p{Cf}'’.\-–,/]*")  # matched backwards from the mark
_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}­]*")
_SKIP = regex.compile(rf"(?:[{SPACE}'\"“”„«»‹›「」『』《》()（）\[¿¡—–-]|<!--.*?-->)+", regex.S)
_LINKED = regex.compile(r"\[\[(?:[^\[\]|]*\|)?")
_THAI = regex.compile(r"\p{Thai}")
_GAP = regex.compile(rf"[{SPACE}]+")
_MAINT = regex.compile(r"\{\{\s*(?:" + MAINTENANCE + r")\s*(?:[|}]|$)", regex.I)
_CJK_ENDS = "。！？｡．।॥"
_GREEK = regex.compile(r"\p{Greek}")


@dataclass(slots=True)
class Opaque:
    start: int
    end: int
    kind: str  # comment, template, table, ref, tag


def opaque_spans(text: str) -> list[Opaque]:
    """Outermost comments, templates, tables, references and tags; one that isn't closed ends at a blank line or the end."""
    out, at, n = [], 0, len(text)
    if not ("<" in text or "{" in text):
        return out

    def unclosed(start: int) -> int:
        m = _BLANK.search(text, start)
        return m.start() if m else n

    while m := _OPAQUE.search(text, at):
        s, tok = m.start(), m.group().lstrip()
        if tok == "<!--":
            e = text.find("-->", s)
            span = Opaque(s, e + 3 if e >= 0 else unclosed(s), "comment")
        elif tok == "{{":
            depth, end = 0, 0
            for b in _BRACES.finditer(text, s):
                width = b.end() - b.start()
                depth += width if b.group()[0] == "{" else -width
                if depth <= 0:
                    end = b.end()
                    break
            span = Opaque(s, end or unclosed(s), "template")
        elif tok == "{|":
            e = _TABLE_END.search(text, s)
            span = Opaque(s, e.end() if e else unclosed(s), "table")
        elif tok[:4].lower() == "<ref":
            if tok.endswith("/>") or "/" in tok[-3:]:
                span = Opaque(s, m.end(), "ref")
            else:
                e = text.find("</ref>", m.end())
                line = text.find("\n", s)
                span = Opaque(s, e + 6 if e >= 0 else line if line >= 0 else n, "ref")
        else:
            span = Opaque(s, m.end(), "tag")
        out.append(span)
        at = max(span.end, s + 1)
    return out


def blocks(text: str, spans: list[Opaque]) -> list[tuple[int, int, bool]]:
    """Blocks of running text: start, end, whether it is a list line (its marks left out)."""
    out: list[tuple[int, int, bool]] = []
    n, at, k, start, stop = len(text), 0, 0, -1, -1
    while at <= n:
        # The line's end is the first line feed outside of spans.
        first = k
        e = text.find("\n", at)
        e = n if e < 0 else e
        while k < len(spans) and spans[k].start < e:
            if spans[k].end > e:
                e = text.find("\n", spans[k].end)
                e = n if e < 0 else e
            k += 1
        own = spans[first:k]
        stop_here, listed, begin = True, False, at
        end = e - 1 if e > at and text[e - 1] == "\r" else e
        if _VISIBLE.search(text, at, end):
            c = _VISIBLE.search(text, at, end).group()
            void = False
            if c in "=-_#" and _HEAD.match(text, at, end):
                void = True
            elif c == "[" and (_NAMED.match(text, at, end) or _cut_named(text, at, end)):
                void = True
            elif own:
                void = not _uncovered(text, at, end, own)
            elif c in "|!" and start < 0 and _TABLE_ROW.match(text, at, end) and c == "|":
                void = True
            if not void:
                if c in "*#:" and (m := _LIST.match(text, at, end)):
                    listed, begin = True, m.end()
                else:
                    stop_here = False
        if stop_here and start >= 0:
            out.append((start, stop, False))
            start = -1
        if listed:
            out.append((begin, end, True))
        elif not stop_here:
            if start < 0:
                start = at
            stop = end
        at = e + 1
    if start >= 0:
        out.append((start, stop, False))
    return out


def _uncovered(text: str, at: int, end: int, own: list[Opaque]) -> bool:
    """Whether a line has visible text beside templates, comments and tables."""
    for s in own:
        if s.kind in ("template", "comment", "table"):
            if _VISIBLE.search(text, at, s.start):
                return True
            at = max(at, s.end)
    return bool(_VISIBLE.search(text, at, end)) if at < end else False


def _cut_named(text: str, at: int, end: int) -> bool:
    """A file or category line of which the end of the text left only the beginning."""
    if end < len(text):
        return False
    m = _CUT_NAMED.match(text, at, end)
    return bool(m) and (not m[1] or any(x.startswith(m[1].lower()) for x in _NAMES) or m[1].lower() in _NAMES)


@dataclass(slots=True)
class Candidate:
    """A place where a sentence may end, with what stands around it."""

    end: int  # where the sentence would end
    next: int  # where the next one would start; the block's end if nothing follows
    kind: str  # dot, strong (! ?), full (marks of scripts without case), dots (ellipsis), quote, space (Thai)
    left: str = ""
    before: str = ""
    right: str = ""
    form: str = ""  # of what follows
    gap: bool = True
    run: int = 1
    lead: int = -1  # of a quotation: where the last word before it ends, -1 if its block has none
    flags: str = ""  # of the form: a mark that goes on (a), a full stop without a space between words (k), a Japanese quoting word (t), Latin or a number on the left (x)
    final: bool = False
    tongue: str = ""
    around: int = 0  # hash of the text on both sides


@dataclass(slots=True)
class Block:
    start: int
    end: int
    listed: bool
    thai: bool
    tongue: str = ""
    first: str = ""  # its first token
    head: tuple[str, str] | None = None  # token and form of its start, if it is no list line
    candidates: list[Candidate] = field(default_factory=list)
    inside: list[tuple[int, int]] = field(default_factory=list)


#: Common function words that tell Latin-script languages apart.
_TONGUES = {
    w: k
    for k, words in {
        "en": "the of and was were it its by at from which with is that what who for an to",
        "de": "der die das und wurde war im am um dem den des wer ist sie es zu von mit nach",
        "fr": "le les et est une du dans fut par qui elle au où était on selon jusqu",
        "es": "el los y fue una del por qué está dónde según había nació quién preguntó dijo",
    }.items()
    for w in words.split()
}
_SCRIPTS = regex.compile(r"(?P<el>\p{Greek})|(?P<ru>\p{Cyrillic})|(?P<ar>\p{Arabic})|(?P<hi>\p{Devanagari})|(?P<ja>[\p{Hiragana}\p{Katakana}])|(?P<zh>\p{Han})|(?P<th>\p{Thai})")
#: Script of each character met so far, but for ASCII.
_SCRIPT_OF: dict[str, str | None] = {}


def _script_of(ch: str) -> str | None:
    m = _SCRIPTS.match(ch)
    found = _SCRIPT_OF[ch] = m.lastgroup if m else None
    return found


def tongue(text: str) -> str:
    """A rough language of a passage, by function words or script; the declared one may be missing or wrong."""
    votes: dict[str, int] = {}
    for w in text.lower().split():
        if k := _TONGUES.get(w):
            votes[k] = votes.get(k, 0) + 2
    if not text.isascii():
        for ch in text[:: max(1, len(text) // 16)]:
            if ch > "\x7f" and (k := _SCRIPT_OF[ch] if ch in _SCRIPT_OF else _script_of(ch)):
                votes[k] = votes.get(k, 0) + 1
    return max(votes, key=lambda k: (votes[k], k)) if votes else ""


@lru_cache(100_000)
def _norm(token: str) -> str:
    token = token.replace("­", "")
    if len(token) < 3 and token.isalpha():
        return token  # M. and m. are different things
    if any(ch.isdigit() for ch in token):
        token = "".join("0" if ch.isdigit() else ch for ch in token)
    return token.casefold()


def _follow(text: str, at: int, end: int, by_start: dict[int, Opaque]) -> tuple[str, str]:
    """Token and form of what begins at ``at``."""
    if at >= end:
        return "", "none"
    if (o := by_start.get(at)) and o.kind == "template":
        return "{{", "template"
    lead = ""
    m = None if text[at].isalnum() else _SKIP.match(text, at, end)
    if m:
        lead = "q" if any(c in "¿¡" for c in m.group()) else "d" if m.group().strip()[:1] in "—–-" else "o"
        link = m.group().rfind("[[")
        at2 = m.end()
        if link >= 0:
            at2 = _LINKED.match(text, m.start() + link, end).end()
        at = at2
    elif text.startswith("[[", at):
        at = _LINKED.match(text, at, end).end()
    if (o := by_start.get(at)) and o.kind == "template":
        return "{{", lead + "template"
    w = _WORD.match(text, at, end)
    if not w:
        return text[at : at + 1], lead + "other"
    t = w.group()
    c = t[0]
    if c.isdigit():
        form = "digit"
    elif c.islower():
        form = "camel" if len(t) > 2 and t[1].isupper() and t[2].islower() else "lower"
    elif c.isupper():
        form = "caps" if len(t) > 1 and t.isupper() else "upper"
    else:
        form = "uncased"
    return t, lead + form


#: What was found in the blocks met so far, by their text, place on the line and markup; positions from the block's start.
_FOUND: dict[tuple, Block] = {}
_FILLED = [0]


def _block(text: str, s: int, e: int, listed: bool, own: list[Opaque]) -> Block:
    """The block at ``s`` to ``e``, positions from its start; remembered, as it depends on nothing outside."""
    piece = text[s:e]
    key = (piece, listed, *[(o.start - s, o.end - s, o.kind) for o in own])
    b = _FOUND.get(key)
    if b is None:
        spans = [Opaque(o.start - s, o.end - s, o.kind) for o in own]
        by_start = {o.start: o for o in spans}
        n = len(piece)
        b = Block(0, n, listed, bool(_THAI.search(piece)), tongue(piece))
        b.first = _follow(piece, 0, n, by_start)[0]
        b.head = None if listed else _follow(piece, 0, n, {})
        _scan(piece, b, spans, by_start)
        if b.thai:
            b.candidates = sorted([*b.candidates, *_thai_spaces(piece, b)], key=lambda c: (c.end, c.next))
        if _FILLED[0] + n > MOST_KEPT:
            _FOUND.clear()
            _FILLED[0] = 0
        _FOUND[key] = b
        _FILLED[0] += n
    return b


def passages(text: str) -> list[tuple[int, Block]]:
    """The blocks of a text in order: where each starts, and what is in it."""
    spans = opaque_spans(text)
    out = []
    k = 0
    for s, e, listed in blocks(text, spans):
        m = _VISIBLE.search(text, s, e)
        if not m:
            continue
        s = m.start()
        while e > s and (text[e - 1].isspace() or text[e - 1] in "\u200b\ufeff"):
            e -= 1
        while k < len(spans) and spans[k].end <= s:
            k += 1
        i = k
        while i < len(spans) and spans[i].start < e:
            i += 1
        out.append((s, _block(text, s, e, listed, spans[k:i])))
    return out


def tongues(text: str, found: list[tuple[int, Block]]) -> list[str]:
    """The language of each block; where a block shows none, the whole text's."""
    main: str | None = None
    out = []
    for _, b in found:
        if not b.tongue and main is None:
            main = tongue(text)
        out.append(b.tongue or main)
    return out


def _scan(text: str, b: Block, own: list[Opaque], by_start: dict[int, Opaque]) -> None:
    toks: list[tuple[int, int, str]] = []
    s, e = b.start, b.end
    nexts = iter(own)
    o = next(nexts, None)
    notes: dict[int, int] = {}
    for m in _SCAN.finditer(text, s, e):
        p = m.start()
        while o is not None and o.end <= p:
            o = next(nexts, None)
        if o is not None and o.start <= p:
            continue
        kind = m.lastgroup
        if kind == "note":
            notes[p] = m.end()
        toks.append((p, m.end(), kind))
    inside = [(x.start, x.end) for x in own]
    quotes: dict[int, int] = {}  # place after the closing mark: where it was opened
    stack: list[tuple[str, int]] = []
    ticks: dict[int, int] = {}
    for p, q, kind in toks:
        if kind in ("url", "note"):
            if kind == "url":
                while q > p and text[q - 1] in ".,;:!?)'":
                    q -= 1
            inside.append((p, q))
        elif kind == "tick":
            width = q - p
            if width in ticks:
                inside.append((ticks.pop(width), q))
            else:
                ticks[width] = p
        elif kind == "link":
            if text[p] == "[":
                stack.append(("[[", p))
            else:
                _shut(stack, "[[", q, inside, quotes, text)
        elif kind == "plain":
            if any(c == '"' for c, _ in stack):
                if p > s and not text[p - 1].isspace():
                    _shut(stack, '"', q, inside, quotes, text)
            elif q < e and not text[q].isspace():
                stack.append(('"', p))
        elif kind == "open":
            c = text[p]
            if c == "“" and any(x == "„" for x, _ in stack):
                _shut(stack, "„", q, inside, quotes, text)
            else:
                stack.append((c, p))
        elif kind == "close":
            c = text[p]
            if c == "”" and any(x == "„" for x, _ in stack) and not any(x == "“" for x, _ in stack):
                _shut(stack, "„", q, inside, quotes, text)
            else:
                _shut(stack, _PAIR[c], q, inside, quotes, text)
    inside.sort()
    merged: list[tuple[int, int]] = []
    for x, y in inside:
        if merged and x < merged[-1][1]:
            if y > merged[-1][1]:
                merged[-1] = (merged[-1][0], y)
        else:
            merged.append((x, y))
    b.inside = merged
    found: list[Candidate] = []
    j = 0
    last_end = -1
    marks = [(p, q, "mark") for p, q, kind in toks if kind == "mark"]
    for q, p in quotes.items():
        marks.append((q, q, "quote"))
    marks.sort()
    for p, q, kind in marks:
        while j < len(merged) and merged[j][1] <= p:
            j += 1
        if kind == "mark":
            if p < last_end or (j < len(merged) and merged[j][0] <= p):
                continue
            c = _mark(text, b, p, q, notes, by_start)
        else:
            if j < len(merged) and merged[j][0] < p < merged[j][1]:
                continue
            c = _quote(text, b, quotes[q], q, notes, by_start)
        if c is not None:
            last_end = c.end
            found.append(c)
    b.candidates = found


def _shut(stack: list[tuple[str, int]], opening: str, q: int, inside: list[tuple[int, int]], quotes: dict[int, int], text: str) -> None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == opening:
            p = stack[i][1]
            del stack[i:]
            inside.append((p, q))
            if opening in _QUOTES:
                inner = q - 2
                while inner > p and (text[inner].isspace() or text[inner] == "​"):
                    inner -= 1
                if text[inner] in _MARKS:
                    quotes[q] = p
            return


def _gap_end(text: str, at: int, end: int) -> int:
    """Where the white space at ``at`` ends."""
    if at >= end or text[at].isalnum():
        return at
    if text[at] == " " and at + 1 < end and text[at + 1].isalnum():
        return at + 1
    m = _GAP.match(text, at, end)
    return m.end() if m else at


def _absorb(text: str, at: int, end: int, notes: dict[int, int], by_start: dict[int, Opaque]) -> int:
    """The end of the references, note numbers and maintenance templates that follow an end mark."""
    while True:
        p = _gap_end(text, at, end)
        o = by_start.get(p)
        if o is not None and (o.kind == "ref" or (o.kind == "template" and _MAINT.match(text, p))):
            at = min(o.end, end)
        elif p in notes:
            at = notes[p]
        else:
            return at


def _around(text: str, b: Block, c: Candidate, p: int, by_start: dict[int, Opaque]) -> Candidate:
    c.next = _gap_end(text, c.end, b.end)
    c.gap = c.next > c.end
    c.final = c.next >= b.end
    c.right, c.form = _follow(text, c.next, b.end, by_start)
    if c.right and _ASIDE.match(c.right):
        c.flags = "a"
    elif c.kind == "quote" and c.right[:1] in ("と", "っ"):
        c.flags = "t"
    if c.kind in ("dot", "strong"):
        c.around = zlib.crc32((text[max(b.start, p - 24) : p] + "|" + text[c.next : c.next + 16]).encode("utf8", "surrogatepass"))
    lo = max(b.start, p - 40)
    c.left = _LEFT.match(text, lo, p).group().lstrip("'’.-–,/")
    at = p - len(c.left)
    while at > lo and (text[at - 1].isspace() or text.endswith("&nbsp;", lo, at)):
        at -= 1 if text[at - 1] != ";" else 6
    c.before = _LEFT.match(text, max(b.start, at - 20), at).group()
    if c.kind == "dot" and not c.gap and _glued(c):
        c.flags += "k"
    return c


def _mark(text: str, b: Block, p: int, q: int, notes: dict[int, int], by_start: dict[int, Opaque]) -> Candidate | None:
    run = text[p:q]
    if run == ";" * len(run) or run == ";":
        if run[0] == ";" and not (p > b.start and _GREEK.match(text, _letter_before(text, p, b.start))):
            return None
        kind = "strong"
    elif run.strip(".…") == "" and (run[0] == "…" or len(run) >= 3):
        kind = "dots"
    elif run[0] == ".":
        kind = "dot"
        if len(run) == 1 and q < len(text) and text[q].isdigit():
            return None
    elif run[0] in _CJK_ENDS:
        kind = "full"
    else:
        kind = "strong"
    c = Candidate(_absorb(text, q, b.end, notes, by_start), 0, kind)
    c.run = q - p
    return _around(text, b, c, p, by_start)


def _letter_before(text: str, p: int, least: int) -> int:
    p -= 1
    while p > least and unicodedata.category(text[p])[0] not in "LN":
        p -= 1
    return p


def _quote(text: str, b: Block, opened: int, q: int, notes: dict[int, int], by_start: dict[int, Opaque]) -> Candidate:
    at = opened
    while at > b.start and not text[at - 1].isalnum():
        at -= 1
    c = Candidate(_absorb(text, q, b.end, notes, by_start), 0, "quote", lead=at if at > b.start else -1)
    return _around(text, b, c, q - 1, by_start)


_ASIDE = regex.compile(r"[,;:，；：、،؛·)\]）]")
_LATIN_OR_NUMBER = regex.compile(r"[\p{Latin}\p{N}ๆ]")


def _glued(c: Candidate) -> bool:
    """Whether a full stop without a space after it stands between a word or number and a capitalised word."""
    core = c.left.rsplit(".", 1)[-1]
    if c.form not in ("upper", "camel", "oupper", "qupper", "uncased", "ouncased", "template", "otemplate") or (c.form == "upper" and len(c.right) < 2):
        return c.form in ("digit", "caps") and len(core) > 2 and core.isalpha()
    if c.form in ("uncased", "ouncased"):
        return len(core) > 2
    return core.isdigit() or (len(core) > 2 and not core.isupper()) or (len(core) > 1 and core.islower()) or not core


def _thai_spaces(text: str, b: Block) -> Iterator[Candidate]:
    """The spaces of a block outside of quotations and the like; ``form`` and ``flags`` say whether Latin, a number or markup stands beside."""
    j = 0
    for m in _GAP.finditer(text, b.start, b.end):
        p, q = m.span()
        while j < len(b.inside) and b.inside[j][1] <= p:
            j += 1
        if j < len(b.inside) and b.inside[j][0] <= p:
            continue
        left, right = p - 1, q
        while left > b.start and text[left] in "]'\"”)":
            left -= 1
        r = text[right : right + 1]
        if text.startswith("[[", right):
            at = _LINKED.match(text, right, b.end).end()
            r = text[at : at + 1]
        else:
            while r and r in "'\"“(" and right < b.end - 1:
                right += 1
                r = text[right : right + 1]
        c = Candidate(p, q, "space", gap=True, final=q >= b.end)
        c.form = "x" if r and (_LATIN_OR_NUMBER.match(r) or r in "{}<") else "thai"
        c.flags = "x" if _LATIN_OR_NUMBER.match(text[left]) or text[left] == "}" else ""
        yield c


# ---------------------------------------------------------------- features


def key_of(token: str, tongue_: str) -> str:
    return f"{tongue_}|{_norm(token)}"


def bucket(key: str) -> int:
    return zlib.crc32(key.encode("utf8", "surrogatepass")) % BUCKETS


def _place(h: int) -> int:
    return (h ^ (h >> 16)) & 63


def _bit(h: int) -> int:
    h = _place(h)
    return (1 << h) - (1 << 64 if h == 63 else 0)


def habits(text: str) -> Iterator[tuple[int, str, int]]:
    """What a text adds to the counts: row, key of the token, and 1 or (rows 4 and 5) a bit.

    Rows: left of a mark; of these at a block's end; right of a mark; at a block's
    start; and 64-bit sketches of the different surroundings of tokens left and right of
    a mark (a page's many revisions repeat one, they don't add any).
    """
    found = passages(text)
    for (_, b), t in zip(found, tongues(text, found), strict=True):
        if not b.listed and b.first:
            yield 3, key_of(b.first, t), 1
        for c in b.candidates:
            if c.kind == "dot" and c.run == 1 and c.left:
                k = key_of(c.left, t)
                yield 0, k, 1
                if c.final:
                    yield 1, k, 1
                else:
                    yield 4, k, _bit(c.around)
            if not c.final and c.right and c.kind in ("dot", "strong"):
                k = key_of(c.right, t)
                yield 2, k, 1
                yield 5, k, _bit(c.around)


def count(text: str, sums: np.ndarray) -> None:
    """Adds a text's tokens to a table of hashed cells, for a few texts without Spark; :func:`corpus_counts` is exact."""
    for row, key, n in habits(text):
        if row < 4:
            sums[row, bucket(key)] += n
        else:
            sums[row, bucket(key)] |= n


@dataclass
class Counts:
    """Statistics over all documents: a column of ``sums`` for each key in ``index``, or, without one, for each hashed cell."""

    sums: np.ndarray
    index: dict[str, int] | None = None
    totals: list[int] | None = None  # of rows 0 to 3, over all keys

    def __post_init__(self) -> None:
        left, final, right, start = (int(n) for n in (self.sums[:4].sum(1) if self.totals is None else self.totals))
        self.rate = final / left if left else 0.5
        self.start_rate = start / (right + start) if right + start else 0.5

    def _column(self, token: str, tongue_: str) -> int | None:
        key = key_of(token, tongue_)
        return bucket(key) if self.index is None else self.index.get(key)

    def left(self, token: str, tongue_: str) -> tuple[int, float]:
        """In how many different surroundings it stands within blocks (as far as the sketch tells), and how often it ends a block, against all."""
        if (k := self._column(token, tongue_)) is None:
            return 0, 1.0
        n = int(self.sums[0, k])
        return (int(self.sums[4, k]) & (1 << 64) - 1).bit_count(), float(self.sums[1, k] / n / max(self.rate, 1e-9)) if n else 1.0

    def right(self, token: str, tongue_: str) -> tuple[int, float]:
        """In how many different surroundings it follows a mark, and how often it starts a block, against all."""
        if (k := self._column(token, tongue_)) is None:
            return 0, 1.0
        n = int(self.sums[2, k] + self.sums[3, k])
        return (int(self.sums[5, k]) & (1 << 64) - 1).bit_count(), float(self.sums[3, k] / n / max(self.start_rate, 1e-9)) if n else 1.0


def _level(n: int, share: float) -> str:
    if n < LEAST_RIGHT:  # too few different surroundings to tell its habits
        return "a"
    return ("b" if n < MANY else "c") + ("0" if share < 0.02 else "1" if share < 0.1 else "2" if share < 0.3 else "3" if share < 0.7 else "4")


def _shape(token: str) -> str:
    if not token:
        return "none"
    core = token.replace("­", "")
    letters = sum(ch.isalpha() for ch in core)
    if not letters:
        return f"digits{min(len(core), 5)}"
    kind = "U" if core[0].isupper() else "l" if core[0].islower() else "x"
    return f"{kind}{min(letters, 5)}{'.' if '.' in core else ''}{'u' if letters > 1 and core.isupper() else ''}{'0' if any(ch.isdigit() for ch in core) else ''}"


def _script(token: str) -> str:
    for ch in token:
        if ch.isalpha():
            return unicodedata.name(ch, "?").split(" ")[0]
    return "-"


def form_of(kind: str, run: int, gap: bool, form: str, flags: str, lead: bool) -> str:
    """The form of a place as a whole; ``lead``: words stand between the sentence's start and a quotation."""
    return f"{kind}|{'g' if gap else 'n'}|{form}|{flags}{'l' if lead and kind == 'quote' else ''}{'r' if run > 1 and kind == 'dot' else ''}"


def verdict(kind: str, run: int, gap: bool, form: str, flags: str, lead: bool) -> int | None:
    """What the form alone says of a place within a block: 1 an end, 0 none, None if it doesn't tell."""
    if kind == "space":
        return int(form != "x" and "x" not in flags)
    if "a" in flags:
        return 0
    lower = form in ("lower", "olower", "dlower")
    if kind == "quote":  # without words before it, those that name the speaker follow
        return int(lead and not lower and form[:1] != "d" and "t" not in flags)
    if kind == "full":
        return 1
    if lower:
        return 0
    if kind == "dots":
        return int(gap and form not in ("uncased", "ouncased"))
    if kind == "strong":
        return int(gap or form in ("upper", "uncased", "ouncased", "oupper", "camel", "qupper", "digit", "template", "caps", "oother"))
    if not gap and "k" not in flags:
        return 0
    return 1 if run > 1 else None  # an abbreviation's full stop, and one of its own


def _all_forms() -> Iterator[tuple[str, int | None]]:
    plain = ["other", "digit", "camel", "lower", "caps", "upper", "uncased", "template"]
    forms = ["none", *[lead + f for lead in ("", "o", "d", "q") for f in plain]]
    for kind in ("dot", "strong", "full", "dots", "quote"):
        for gap in (True, False):
            for form in forms:
                for flags in ("", "a", *(["k", "ak"] if kind == "dot" and not gap else ["t"] if kind == "quote" else [])):
                    for run in (1, 2) if kind == "dot" else (1,):
                        for lead in (False, True) if kind == "quote" else (False,):
                            yield form_of(kind, run, gap, form, flags, lead), verdict(kind, run, gap, form, flags, lead)
    for form in ("x", "thai"):
        for flags in ("", "x"):
            yield form_of("space", 1, True, form, flags, False), verdict("space", 1, True, form, flags, False)


_VERDICTS = dict(_all_forms())
_FORM_INDEX = {f: DIMS + i for i, f in enumerate(_VERDICTS)}


def prior() -> np.ndarray:
    """Weights before any training: what the form alone says."""
    w = np.zeros(DIMS + FORMS)
    for f, v in _VERDICTS.items():
        if v is not None:
            w[_FORM_INDEX[f]] = PRIOR if v else -PRIOR
    return w


def _index(feature: str) -> int:
    return zlib.crc32(feature.encode("utf8", "surrogatepass")) % DIMS


# The features of a place in four groups, by what they depend on.


def _left_features(left: str, tongue_: str, counts: Counts) -> tuple[str, str, list[int]]:
    """Level of its habits, its shape, and features."""
    n, share = counts.left(left, tongue_)
    ll, sh = _level(n, share), _shape(left)
    return ll, sh, [_index(x) for x in (f"left={tongue_}|{_norm(left)}" if n >= LEAST_LEFT else "left=?", f"ll={ll}", f"sh={sh}", f"script={_script(left)}|ll={ll}", f"ll={ll}|sh={sh}")]


def _right_features(right: str, tongue_: str, counts: Counts) -> tuple[str, list[int]]:
    lr = _level(*counts.right(right, tongue_))
    return lr, [_index(f"lr={lr}")]


def _before_features(before: str, sh: str) -> list[int]:
    return [_index(f"before={_shape(before)}|sh={sh}"), _index(f"before={_norm(before)[-8:]}|sh={sh}")]


def _place_features(kind: str, run: int, gap: bool, form: str, flags: str, lead: bool, ll: str, sh: str, lr: str) -> list[int]:
    whole = form_of(kind, run, gap, form, flags, lead)
    # Where the form tells, habits of tokens have features of their own, so that what is learned of full stops stays with them.
    open_ = "" if _VERDICTS.get(whole) is None else "~"
    return [
        _FORM_INDEX.get(whole, DIMS + len(_FORM_INDEX) + zlib.crc32(whole.encode()) % (FORMS - len(_FORM_INDEX))),
        *[_index(open_ + x) for x in ("bias", f"kind={kind}{min(run, 2)}", f"form={form}", f"ll={ll}|form={form}", f"sh={sh}|form={form}", f"ll={ll}|lr={lr}", f"sh={sh}|lr={lr}", f"gap={gap}|form={form}", f"run={min(run, 2)}|form={form}")],
    ]


def features(c: Candidate, tongue_: str, counts: Counts, lead: bool = False) -> list[int]:
    """Indexes of the features that hold."""
    ll, sh, a = _left_features(c.left, tongue_, counts)
    lr, b = _right_features(c.right, tongue_, counts)
    return [*a, *b, *_before_features(c.before, sh), *_place_features(c.kind, c.run, c.gap, c.form, c.flags, lead, ll, sh, lr)]


def label(c: Candidate, tongue_: str, counts: Counts, start: tuple[str, str] | None, lead: bool) -> tuple[int, Candidate] | None:
    """A reliable label, and the candidate as it is to be learned; ``start``: first token and form of a block near by."""
    if c.final:
        if start is None or c.kind not in ("dot", "strong"):
            return None
        token, form = start
        n, share = counts.left(c.left, tongue_)
        if n >= MANY and share < 0.02:
            return None
        return 1, Candidate(c.end, c.next, c.kind, c.left, c.before, token, form, True, c.run)
    known = verdict(c.kind, c.run, c.gap, c.form, c.flags, lead)
    if known is not None:
        return known, c
    n, share = counts.left(c.left, tongue_)
    if n >= MANY and share < 0.02:
        return 0, c
    if share >= 0.5 and n >= MANY and len(c.left) > 2 and c.left.isalpha():
        return 1, c  # a word that ends blocks as often as words do
    n, share = counts.right(c.right, tongue_)
    if share >= 0.5 and n >= MANY and len(c.left) > 3 and c.left.isalpha():
        return 1, c  # and before one that starts them as often
    if n >= MANY and share < 0.02 and c.form not in ("template", "digit") and not (len(c.left) > 3 and c.left.isalpha()):
        return 0, c
    return None


def labelled_blocks(found: list[tuple[list[Candidate], str, tuple[str, str] | None]], counts: Counts) -> list[tuple[int, list[int]]]:
    """Training examples of a text's blocks (candidates, language, head): label and features."""
    out = []
    heads = [h if h and h[1] != "lower" else None for _, _, h in found]
    after: list[tuple[str, str] | None] = [None] * len(heads)
    for i in range(len(heads) - 2, -1, -1):
        after[i] = heads[i + 1] or after[i + 1]
    first = next((h for h in heads if h), None)
    for i, (candidates, t, _) in enumerate(found):
        start = after[i] or (first if any(heads[:i]) else None)
        at = 0
        for c in candidates:
            lead = c.lead > at
            if got := label(c, t, counts, start, lead):
                out.append((got[0], features(got[1], t, counts, lead)))
                if got[0]:
                    at = c.next
    return out


def labelled(text: str, counts: Counts) -> list[tuple[int, list[int]]]:
    """Training examples of a text: label and features."""
    found = passages(text)
    return labelled_blocks([(b.candidates, t, b.head) for (_, b), t in zip(found, tongues(text, found), strict=True)], counts)


def fit(examples: list[tuple[int, list[int]]], **options) -> np.ndarray:  # noqa: ANN003
    """:func:`fit_arrays` of labels and features in a list."""
    if not examples:
        return prior()
    return fit_arrays(np.array([e[0] for e in examples]), np.array([e[1] for e in examples]), **options)


def fit_arrays(y: np.ndarray, x: np.ndarray, rounds: int = 12, rate: float = 0.3, decay: float = 1e-5, batch: int = 256) -> np.ndarray:
    """Weights of the maximum-entropy (logistic) model, by AdaGrad; ``x``: the indexes of each example's features.

    Weights start from :func:`prior` and decay towards it. The examples are put in an
    order that depends on their content only.
    """
    w0 = prior()
    w, g = w0.copy(), np.full(DIMS + FORMS, 1e-8)
    if not len(y):
        return w
    mix = np.random.default_rng(3).integers(1, 1 << 40, x.shape[1])
    first = np.argsort((x.astype(np.int64) * mix).sum(1) * 2 + y, kind="stable")
    x, y = x[first], y[first].astype(float)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for part in np.array_split(order.permutation(len(y)), max(1, len(y) // batch)):
            p = 1 / (1 + np.exp(-np.clip(w[x[part]].sum(1), -30, 30)))
            d = np.bincount(x[part].ravel(), np.repeat((p - y[part]) / len(part), x.shape[1]), DIMS + FORMS)
            d += decay * (w - w0)
            g += d * d
            w -= rate * d / np.sqrt(g)
    return w


# ---------------------------------------------------------------- decisions


@dataclass
class Model:
    counts: Counts
    weights: np.ndarray
    known: dict[tuple, tuple[bool, bool]] = field(default_factory=dict, repr=False)  # decisions made before, without and with words before a quotation
    parts: dict[tuple, tuple] = field(default_factory=dict, repr=False)  # sums of weights of parts of contexts

    def _part(self, key: tuple, make) -> tuple:  # noqa: ANN001
        found = self.parts.get(key)
        if found is None:
            if len(self.parts) >= MOST_KNOWN:
                self.parts.clear()
            *out, indexes = make()
            found = self.parts[key] = (*out, float(self.weights[indexes].sum()))
        return found

    def decide(self, c: Candidate, tongue_: str) -> tuple[bool, bool]:
        """Whether a sentence ends at a candidate within its block: if no words, and if some, stand before a quotation."""
        key = (tongue_, c.kind, c.left, c.before, c.right, c.form, c.flags, c.gap, c.run)
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= MOST_KNOWN:
                self.known.clear()
            ll, sh, a = self._part((0, tongue_, c.left), lambda: _left_features(c.left, tongue_, self.counts))
            lr, b = self._part((1, tongue_, c.right), lambda: _right_features(c.right, tongue_, self.counts))
            (d,) = self._part((2, c.before, sh), lambda: (_before_features(c.before, sh),))
            place = lambda lead: self._part((3, c.kind, min(c.run, 2), c.gap, c.form, c.flags, lead, ll, sh, lr), lambda: (_place_features(c.kind, c.run, c.gap, c.form, c.flags, lead, ll, sh, lr),))[0]
            no = a + b + d + place(False) > 0
            found = self.known[key] = (no, a + b + d + place(True) > 0 if c.kind == "quote" else no)
        return found

    def sentences(self, text: str | None) -> list[tuple[int, int]]:
        """Each sentence's start and end, in code points."""
        out: list[tuple[int, int]] = []
        found = passages(text) if text else []
        for (at, b), t in zip(found, tongues(text, found) if text else [], strict=True):
            start = 0
            for c in b.candidates:
                if c.end > start and c.next < b.end and self.decide(c, t)[c.kind == "quote" and c.lead > start]:
                    out.append((at + start, at + c.end))
                    start = c.next
            if b.end > start:
                out.append((at + start, at + b.end))
        return out


# ---------------------------------------------------------------- on Spark

_US = "\x1f"
_I, _T = pa.list_(pa.int32()), pa.list_(pa.string())
_ANALYSIS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("b_start", _I), ("b_end", _I), ("b_n", _I), ("b_tongue", _T), ("b_first", _T), ("b_head", _T), ("c_block", _I), ("c_end", _I), ("c_next", _I), ("c_lead", _I), ("c_place", _I), ("c_left", _T), ("c_right", _T), ("c_context", _T)])
ANALYSIS = "doc_id bigint, h bigint, b_start array<int>, b_end array<int>, b_n array<int>, b_tongue array<string>, b_first array<string>, b_head array<string>, c_block array<int>, c_end array<int>, c_next array<int>, c_lead array<int>, c_place array<int>, c_left array<string>, c_right array<string>, c_context array<string>"
#: Rows of one batch of results.
_ROWS = 500


def context(c: Candidate) -> str:
    """A candidate without its position, as text."""
    return _US.join((c.kind, "2" if c.run > 1 else "1", "g" if c.gap else "n", "f" if c.final else "", c.form, c.flags, c.left, c.before, c.right))


def candidate(text: str, end: int = 0, next_: int = 0, lead: int = -1) -> Candidate:
    """The candidate of a :func:`context`."""
    kind, run, gap, final, form, flags, left, before, right = text.split(_US)
    return Candidate(end, next_, kind, left, before, right, form, gap == "g", int(run), lead, flags, final == "f")


def _lists(rows: list[list[list]], schema: pa.Schema, first: int) -> list[pa.Array]:
    """Columns of lists, from rows of lists."""
    out = []
    for i, f in enumerate(schema):
        if i < first:
            continue
        column = [r[i] for r in rows]
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(x) for x in column], out=offsets[1:])
        flat = pa.array([v for x in column for v in x], f.type.value_type)
        out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat))
    return out


def analysis(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What is found in each text (:data:`ANALYSIS`): its blocks, and their candidates with positions from the block's start.

    Texts that share passages are brought together first, so that these are gone through once.
    """
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}

        def listed(b: Block) -> tuple:
            # Blocks live as long as this: an id is never another's.
            found = kept.get(id(b))
            if found is None:
                if len(kept) >= MOST_LISTED:
                    kept.clear()
                cs = b.candidates
                lefts = [_norm(c.left) if c.left and c.kind == "dot" and c.run == 1 else None for c in cs]
                rights = [_norm(c.right) if c.right and not c.final and c.kind in ("dot", "strong") else None for c in cs]
                found = kept[id(b)] = b, [c.end for c in cs], [c.next for c in cs], [c.lead for c in cs], [-1 if c.final else _place(c.around) for c in cs], lefts, rights, [context(c) for c in cs]
            return found

        for batch in it:
            rows: list[list] = []
            for d, t, h in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if not t:
                    continue
                r: list[list] = [d, h, *([] for _ in range(14))]
                found = passages(t)
                for i, ((at, b), tongue_) in enumerate(zip(found, tongues(t, found), strict=True)):
                    _, ends, nexts, leads, places, lefts, rights, contexts = listed(b)
                    r[2].append(at)
                    r[3].append(b.end)
                    r[4].append(len(ends))
                    r[5].append(tongue_)
                    r[6].append(_norm(b.first) if b.first and not b.listed else None)
                    r[7].append(None if b.head is None or b.thai else _US.join(b.head))
                    r[8] += [i] * len(ends)
                    r[9] += ends
                    r[10] += nexts
                    r[11] += leads
                    r[12] += places
                    r[13] += lefts
                    r[14] += rights
                    r[15] += contexts
                rows.append(r)
                if len(rows) >= _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), *_lists(rows, _ANALYSIS, 2)], schema=_ANALYSIS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), *_lists(rows, _ANALYSIS, 2)], schema=_ANALYSIS)

    return together(slim).withColumn("h", F.xxhash64("doc_id", "text")).mapInArrow(scan, ANALYSIS)


def corpus_counts(found: DataFrame) -> Counts:
    """Exact counts over all documents of an :func:`analysis`, by language and token.

    Only tokens with as many different surroundings as make a difference (:data:`LEAST_LEFT`,
    :data:`LEAST_RIGHT`) come to the driver; the totals are of all.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    final = F.col("z.c_place") < 0
    bit = F.when(final, none).otherwise(F.call_function("shiftleft", one, F.col("z.c_place")))
    tongue_ = F.element_at("b_tongue", F.col("z.c_block") + 1)
    row = lambda key, *v: F.when(F.col(key).isNotNull(), F.struct(F.concat(tongue_, F.lit("|"), F.col(key)).alias("key"), *[x.alias(n) for x, n in zip(v, "abcdef", strict=True)]))
    cs = found.select("b_tongue", F.explode(F.arrays_zip("c_block", "c_place", "c_left", "c_right")).alias("z")).where("z.c_left is not null or z.c_right is not null")
    lefts, rights = row("z.c_left", one, F.when(final, one).otherwise(none), none, none, bit, none), row("z.c_right", none, none, one, none, none, bit)
    marks = cs.select(F.explode(F.array_compact(F.array(lefts, rights))).alias("r")).select("r.*")
    starts = found.select(F.explode(F.arrays_zip("b_tongue", "b_first")).alias("z")).where("z.b_first is not null").select(
        F.concat(F.col("z.b_tongue"), F.lit("|"), F.col("z.b_first")).alias("key"), none.alias("a"), none.alias("b"), none.alias("c"), one.alias("d"), none.alias("e"), none.alias("f")
    )
    by = materialize(marks.unionByName(starts).groupBy("key").agg(*[F.sum(x).alias(x) for x in "abcd"], *[F.bit_or(x).alias(x) for x in "ef"]), "counts")
    totals = [int(x or 0) for x in by.agg(*[F.sum(x) for x in "abcd"]).first()]
    t = by.where((F.bit_count("e") >= LEAST_LEFT) | (F.bit_count("f") >= LEAST_RIGHT)).toArrow()
    sums = np.array([np.asarray(t[x]) for x in "abcdef"], np.int64).reshape(6, -1)
    return Counts(sums, {k: i for i, k in enumerate(t["key"].to_pylist())}, totals)


def _stored_blocks(b_n: list[int], b_tongue: list[str], b_head: list[str | None], ends: list[int], nexts: list[int], leads: list[int], contexts: list[str]) -> list[tuple[list[Candidate], str, tuple[str, str] | None]]:
    out, k = [], 0
    for n, t, head in zip(b_n, b_tongue, b_head, strict=True):
        out.append(([candidate(contexts[i], ends[i], nexts[i], leads[i]) for i in range(k, k + n)], t, tuple(head.split(_US)) if head else None))
        k += n
    return out


def place_hashes(h: int, n: int) -> list[int]:
    """Numbers that deal out ``n`` examples of a text (by its hash), one after the other, at random but always alike."""
    return [int.from_bytes(hashlib.blake2b(struct.pack("<qq", h, i), digest_size=8).digest(), "big", signed=True) for i in range(n)]


def train(found: DataFrame, counts: Counts, documents: int, sample: int = 8_000) -> Model:
    """The model, trained on the reliable boundaries of about ``sample`` documents (of ``documents``), chosen by the hash of id and text.

    Of more than ``EXAMPLES * sample`` examples so many are taken, by a hash of their text and place in it.
    """

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows: list[tuple] = []
            for h, *stored in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
                examples = labelled_blocks(_stored_blocks(*stored), counts)
                rows += [(p, *x) for x, p in zip(examples, place_hashes(h, len(examples)), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int8()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["h", "y", "x"])

    few = found.select("h", "b_n", "b_tongue", "b_head", "c_end", "c_next", "c_lead", "c_context")
    if sample < documents:
        # The hash's whole range, so that a share of any size has its threshold.
        few = few.where(F.col("h") < -(1 << 63) + (1 << 64) * sample // documents)
    few = few.repartition(2 * found.sparkSession.sparkContext.defaultParallelism)
    t = few.mapInArrow(scan, "h bigint, y byte, x array<int>").orderBy("h").limit(EXAMPLES * sample).toArrow()
    y = np.asarray(t["y"]).astype(np.int64)
    x = np.asarray(t["x"].combine_chunks().flatten()).reshape(len(y), -1) if len(y) else np.zeros((0, 1), np.int64)
    return Model(counts, fit_arrays(y, x).astype(np.float32))


def split(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 8_000) -> DataFrame:
    """``doc_id, start_pos, end_pos`` of every sentence of every row, in code points, end exclusive.

    Null, empty and blank texts have none; texts of any length are read whole; a row that
    occurs twice gives its sentences twice; null ids are kept; other columns are not read.
    Counts cover all rows; ``sample`` bounds the documents that the model is trained on.
    """
    found = materialize(analysis(docs, doc_id, text), "analysis")
    counts = corpus_counts(found)
    model = train(found, counts, found.count(), sample)
    schema = pa.schema([("doc_id", pa.int64()), ("start_pos", pa.int64()), ("end_pos", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = ["doc_id", "b_start", "b_end", "b_n", "b_tongue", "c_end", "c_next", "c_lead", "c_context"]

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in it:
            # Flat columns: every context of the batch is decided once, and no list becomes a list of objects.
            flat = lambda n: batch.column(n).flatten()  # noqa: E731, B023
            numbers = lambda n: flat(n).to_numpy(zero_copy_only=False).tolist()  # noqa: E731, B023
            coded = flat("c_context").dictionary_encode()
            which, contexts = coded.indices.to_numpy(zero_copy_only=False).tolist(), coded.dictionary.to_pylist()
            b_start, b_end, b_n, b_tongue = numbers("b_start"), numbers("b_end"), numbers("b_n"), flat("b_tongue").to_pylist()
            c_end, c_next, c_lead = numbers("c_end"), numbers("c_next"), numbers("c_lead")
            decided: dict[str, list[tuple[bool, bool] | None]] = {}
            ids: list[int | None] = []
            starts: list[int] = []
            stops: list[int] = []
            j = k = 0
            for d, blocks_ in zip(batch.column("doc_id").to_pylist(), batch.column("b_start").value_lengths().to_pylist(), strict=True):
                before = len(starts)
                for j in range(j, j + blocks_):  # noqa: B020, PLW2901
                    at, end, tongue_ = b_start[j], b_end[j], b_tongue[j]
                    start = 0
                    known = decided.get(tongue_)
                    if known is None:
                        known = decided[tongue_] = [None] * len(contexts)
                    for i in range(k, k + b_n[j]):
                        if c_end[i] > start and c_next[i] < end:
                            x = which[i]
                            yes = known[x]
                            if yes is None:
                                yes = known[x] = m.decide(candidate(contexts[x]), tongue_)
                            if yes[c_lead[i] > start]:
                                starts.append(at + start)
                                stops.append(at + c_end[i])
                                start = c_next[i]
                    k += b_n[j]
                    if end > start:
                        starts.append(at + start)
                        stops.append(at + end)
                j += 1 if blocks_ else 0
                ids += [d] * (len(starts) - before)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, stops)], schema=schema)

    return found.select(*columns).mapInArrow(emit, "doc_id bigint, start_pos bigint, end_pos bigint")
