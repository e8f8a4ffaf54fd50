"""The sequential part of chunking: packing sentences and tables of one document into chunks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

# Patterns and limits.
SENTENCE = re.compile("[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$")
HEADING = re.compile(r"#{1,6}\s")
HEADING_MARK = re.compile(r"^#{1,6}\s*")
CHAPTER = re.compile("第[一二三四五六七八九十百零〇两]+章")
CAPTION = re.compile(r"表\s*\d")
TABLE_START = ("[表格]", "|")
LEAST_ROOM, CAPTION_CHARS, FRAGMENT, FRAGMENT_SHARE = 60, 40, 250, 3
GAP = "\n\n"


@dataclass
class Section:
    heading: str
    chapter: str | None
    section: str | None
    body: list[tuple[bool, str]] = field(default_factory=list)  # (is a table, text)


@dataclass
class Chunk:
    text: str
    chapter: str | None
    section: str | None

    @property
    def opens_chapter(self) -> bool:
        return self.chapter is not None and self.section is None


def kind(block: str) -> str:
    if block.lstrip().startswith(TABLE_START):
        return "table"
    line = block.strip()
    return "heading" if "\n" not in line and HEADING.match(line) else "para"


def blocks(text: str) -> list[tuple[str, str]]:
    """(kind, block) of the stretches between blank lines."""
    stripped = (raw.strip("\n") for raw in re.split(r"\n\s*\n", text))
    return [(kind(b), b) for b in stripped if b.strip()]


def captioned(found: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Blocks with each short caption moved into the table right after it."""
    caption = ""
    for (this, text), (following, _) in pairwise([*found, ("end", "")]):
        line = text.strip()
        if this == "para" and following == "table" and len(line) < CAPTION_CHARS and CAPTION.match(line):
            caption = line + GAP
            continue
        yield this, caption + text
        caption = ""


def title_of(heading: str) -> str:
    return HEADING_MARK.sub("", heading.strip())


def sections(found: Iterable[tuple[str, str]]) -> list[Section]:
    """Stretches under one heading, each with its chapter and section; stretches without a body are left out."""
    out = [Section("", None, None)]
    for this, text in found:
        if this != "heading":
            out[-1].body.append((this == "table", text))
        elif CHAPTER.match(title := title_of(text)):
            out.append(Section(text.strip(), title, None))
        else:
            out.append(Section(text.strip(), out[-1].chapter, title))
    return [s for s in out if s.body]


def sentences(text: str) -> list[str]:
    return [s for s in (m.strip() for m in SENTENCE.findall(text)) if s]


def table_parts(table: str, room: int) -> list[str]:
    """A table whole if it fits, else groups of its rows under its caption and header."""
    lines = table.split("\n")
    top = next((i for i, line in enumerate(lines) if line.lstrip().startswith("|")), None)
    if len(table) <= room or top is None:
        return [table]
    ruled = len(lines) > top + 1 and not lines[top + 1].replace("|", "").replace("-", "").strip()
    rows_at = top + 1 + ruled
    head, parts, group, size = "\n".join(lines[:rows_at]), [], [], 0
    least = rows_at  # rows that the first group holds at least, however long they are
    for row in lines[rows_at:]:
        if len(head) + size + len(row) + 1 > room and len(group) >= least:
            parts.append("\n".join([head, *group]))
            group, size = [], 0
        group.append(row)
        size += len(row) + 1
    return [*parts, "\n".join([head, *group])] if group else parts


def units(body: list[tuple[bool, str]], room: int) -> Iterator[tuple[bool, str]]:
    for is_table, text in body:
        if is_table:
            yield from ((True, part) for part in table_parts(text, room))
        else:
            for s in sentences(text):
                yield from ((False, s[i : i + room]) for i in range(0, len(s), room))


def join(parts: list[tuple[bool, str]]) -> str:
    """Sentences side by side, tables apart by blank lines."""
    out: list[str] = []
    prose = False
    for is_table, text in parts:
        if prose and not is_table:
            out[-1] += text
        else:
            out.append(text)
        prose = not is_table
    return GAP.join(out)


def tail(parts: list[tuple[bool, str]], overlap: int) -> list[tuple[bool, str]]:
    """The last sentences, as many as have ``overlap`` characters together, none from before a table."""
    start, size = len(parts), 0
    while start and not parts[start - 1][0] and size + len(parts[start - 1][1]) <= overlap:
        start -= 1
        size += len(parts[start][1])
    return parts[start:]


def packed(section: Section, chunk_size: int, overlap: int) -> Iterator[str]:
    prefix = section.heading + GAP if section.heading else ""
    room = max(LEAST_ROOM, chunk_size - len(prefix))
    held: list[tuple[bool, str]] = []
    for unit in units(section.body, room):
        if held and sum(len(t) for _, t in held) + len(unit[1]) > room:
            yield prefix + join(held)
            held = tail(held, overlap)
        held.append(unit)
    if held:
        yield prefix + join(held)


def crumb(section: Section) -> str:
    """The chapter's name, unless the heading begins with it."""
    return f"【{section.chapter}】\n" if section.chapter and not title_of(section.heading).startswith(section.chapter) else ""


def merged(chunks: Iterable[Chunk], chunk_size: int) -> list[Chunk]:
    """Fragments joined to the chunk before them, within one chapter and never to or from a chapter's opening."""
    out: list[Chunk] = []
    small = min(FRAGMENT, chunk_size // FRAGMENT_SHARE)
    for c in chunks:
        last = out[-1] if out else None
        fits = last and len(c.text) < small and last.chapter == c.chapter and len(last.text) + len(GAP) + len(c.text) <= chunk_size
        if last and fits and not c.opens_chapter and not last.opens_chapter:
            last.text += GAP + c.text
        else:
            out.append(c)
    return out


def chunks(text: str | None, chunk_size: int, overlap: int) -> list[Chunk]:
    text = (text or "").strip()
    if len(text) <= chunk_size and "\n" not in text:
        return [Chunk(text, None, None)] if text else []
    return chunks_of(captioned(blocks(text)), chunk_size, overlap)


def chunks_of(found: Iterable[tuple[str, str]], chunk_size: int, overlap: int) -> list[Chunk]:
    """Chunks of blocks whose captions are in their tables."""

    def all_of() -> Iterator[Chunk]:
        for s in sections(found):
            lead = crumb(s)
            for piece in packed(s, chunk_size - len(lead), overlap):
                if piece.strip():
                    yield Chunk(lead + piece.strip(), s.chapter, s.section)

    return merged(all_of(), chunk_size)
