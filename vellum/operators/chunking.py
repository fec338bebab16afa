"""Documents to chunks: markdown sections, segments and packing; HTML to markdown; hashed embeddings.

These are order-dependent folds over one document, so they run as Arrow-batched Python over whole
rows; every document is its own unit, and no shuffle takes place."""

from __future__ import annotations

import html
import math
import re
import zlib
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, OVERLAP, LEAST = 800, 2, 3
_HEADING = re.compile(r"(#{1,3})\s+(.*\S)\s*")
_BOLD = re.compile(r"\*\*([^*\n]{1,80})\*\*\s*")
_BREAK = re.compile(r"(?<=[.!?])\s+|\n\s*\n|\n(?=\s*(?:[-*•]|\d+[.)])\s)")


def n_tokens(text: str) -> int:
    return max(1, len(text) // 4)


def sections(text: str) -> list[tuple[str | None, str]]:
    """(heading, body) split at H1-H3 outside fences; a bold line of its own is a heading unless it ends in a colon."""
    out, heading, body, fenced = [], None, [], False
    for line in text.split("\n"):
        fenced ^= line.lstrip().startswith("```")
        m = None if fenced else _HEADING.fullmatch(line)
        title = m[2] if m else None
        if title is None and not fenced and (b := _BOLD.fullmatch(line)) and not b[1].rstrip().endswith(":"):
            title = b[1].strip()
        if title is None:
            body.append(line)
            continue
        out.append((heading, "\n".join(body).strip()))
        heading, body = title, []
    out.append((heading, "\n".join(body).strip()))
    return [(h, b) for h, b in out if b]


def segments(body: str) -> list[tuple[str, str]]:
    """(kind, text): fences whole, table rows one by one (with the header when they start a chunk), prose by sentence."""
    out, prose, code, header = [], [], None, ""
    lines = body.split("\n")

    def flush():
        out.extend(("prose", s.strip()) for s in _BREAK.split("\n".join(prose)) if s and s.strip())
        prose.clear()

    for k, line in enumerate(lines):
        if line.lstrip().startswith("```"):
            if code is None:
                flush()
                code = [line]
            else:
                out.append(("code", "\n".join([*code, line])))
                code = None
        elif code is not None:
            code.append(line)
        elif line.lstrip().startswith("|"):
            flush()
            if re.fullmatch(r"\s*\|[\s:|-]+\|?\s*", line):
                continue
            if k + 1 < len(lines) and re.fullmatch(r"\s*\|[\s:|-]*-[\s:|-]*\|?\s*", lines[k + 1]):
                header = f"{line}\n{lines[k + 1]}"
            else:
                out.append(("table", f"{header}\x00{line}"))
        else:
            prose.append(line)
    flush()
    if code is not None:
        out.append(("code", "\n".join(code)))
    return out


def split_long(kind: str, text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` tokens; code is fenced again, prose overlaps by a tenth."""
    if n_tokens(text) <= most:
        return [text]
    size = most * 4
    if kind == "code":
        inner = text.strip().strip("`").strip("\n")
        return [f"```\n{inner[a : a + size - 8]}\n```" for a in range(0, len(inner), size - 8)]
    step = size - size // 10
    return [text[a : a + size] for a in range(0, max(1, len(text) - size // 10), step)]


def chunks(text: str, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[dict]:
    """Ordered chunks of a markdown document: ``section_heading, chunk_text, chunk_type``."""
    out = []
    for heading, body in sections(text):
        packed: list[tuple[str, str]] = []

        def close(heading=heading):
            if not packed:
                return
            shown, last = [], None
            for kind, s in packed:
                head, _, row = s.partition("\x00") if kind == "table" else ("", "", s)
                shown.append(f"{head}\n{row}" if head and head != last else row)
                last = head if kind == "table" else None
            kinds = {k for k, _ in packed}
            joined = "".join(s if not k else (" " if packed[k][0] == packed[k - 1][0] == "prose" else "\n") + s for k, s in enumerate(shown))
            if n_tokens(joined) >= LEAST:
                out.append({"section_heading": heading, "chunk_text": joined, "chunk_type": kinds.pop() if len(kinds) == 1 else "mixed"})

        fresh = 0
        for kind, segment in segments(body):
            for piece in split_long(kind, segment, most):
                if packed and sum(n_tokens(s) for _, s in packed) + n_tokens(piece) > most:
                    close()
                    packed, fresh = [x for x in packed[-overlap:] if x[0] == "prose"] if overlap else [], 0
                    if sum(n_tokens(s) for _, s in packed) + n_tokens(piece) > most:
                        packed = []
                packed.append((kind, piece))
                fresh += 1
        if fresh:
            close()
    return out


def chunk_table(docs: DataFrame, id_column: str, text: str = "text", most: int = MAX_TOKENS) -> DataFrame:
    """One row a chunk: ``<id>, chunk_index, section_heading, chunk_text, chunk_type``."""

    def run(batches):
        for pdf in batches:
            rows = [(i, k, c["section_heading"], c["chunk_text"], c["chunk_type"]) for i, t in zip(pdf["id"], pdf["t"], strict=True) for k, c in enumerate(chunks(t or "", most))]
            yield pd.DataFrame(rows, columns=[id_column, "chunk_index", "section_heading", "chunk_text", "chunk_type"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")).mapInPandas(run, f"{id_column} {kind}, chunk_index int, section_heading string, chunk_text string, chunk_type string")


class _Markdown(HTMLParser):
    _SKIP = {"script", "style", "nav", "head", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.lists, self.row, self.rows, self.cell, self.pre = [], 0, [], None, None, None, 0

    def put(self, text):
        (self.cell if self.cell is not None else self.out).append(text)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self._SKIP:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "article", "section", "table"):
            self.put("\n\n")
            if tag == "table" and self.rows is None:
                self.rows = []
        elif tag == "br":
            self.put(" " if self.cell is not None else "\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            at = self.lists[-1] if self.lists else ["ul", 0]
            at[1] += 1
            self.put("\n" + "  " * max(0, len(self.lists) - 1) + (f"{at[1]}. " if at[0] == "ol" else "- "))
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag == "pre":
            self.put("\n\n```\n")
            self.pre += 1
        elif tag == "img":
            self.put(f"[Image: {a.get('alt') or ''} ({(a.get('src') or '').rpartition('/')[2]})]")
        elif tag == "tr" and self.rows is not None:
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []
            self.span = int(a["colspan"]) if a.get("colspan", "").isdigit() else 1

    def handle_endtag(self, tag):
        if tag in self._SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag == "pre":
            self.put("\n```\n\n")
            self.pre = max(0, self.pre - 1)
        elif tag in ("td", "th") and self.cell is not None:
            text = re.sub(r"\s+", " ", "".join(self.cell)).strip().replace("|", "\\|")
            self.row += [text] * min(self.span, 50)
            self.cell = None
        elif tag == "tr" and self.row is not None:
            if any(self.row):
                self.rows.append(self.row)
            self.row = None
        elif tag == "table" and self.rows is not None:
            self.out.append("\n\n" + markdown_table(self.rows) + "\n\n")
            self.rows = None

    def handle_data(self, data):
        if not self.skip:
            self.put(data if self.pre else re.sub(r"\s+", " ", data))


def markdown_table(rows: list[list[str]]) -> str:
    """Rows padded to one width, a delimiter below the first."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def html_to_markdown(page: str | None) -> str:
    page = re.sub(r"(?s)<!--.*?-->", "", page or "")
    page = re.sub(r"(?s)<!\[CDATA\[(.*?)\]\]>", lambda m: html.escape(m[1]), page)
    parser = _Markdown()
    parser.feed(page)
    parser.close()
    lines = [x.rstrip() for x in "".join(parser.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_table(pages: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "markdown": [html_to_markdown(x) for x in pdf["html"]]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, markdown string")


def hashed_embedding(text: str, size: int = 64) -> list[float]:
    """Signed hashed bag of words of unit length; zero for an empty text."""
    v = [0.0] * size
    for w in re.findall(r"\w+", (text or "").lower()):
        h = zlib.crc32(w.encode())
        v[h % size] += 1 if h >> 16 & 1 else -1
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n > 1e-8 else v


def embedded(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({id_column: pdf[id_column], "embedding": [hashed_embedding(t) for t in pdf["t"]]})

    return docs.select(id_column, F.col(text).alias("t")).mapInPandas(run, f"{id_column} {docs.schema[id_column].dataType.simpleString()}, embedding array<double>")


def hashed_vector(text: Column) -> Column:
    """``hashed_embedding`` as a column, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(hashed_embedding)

    return embed(text)
