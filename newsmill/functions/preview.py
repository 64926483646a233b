"""Chat previews: Markdown to the HTML that chats take, cut to their limits with tags kept whole.

Cleaning the review is done by column expressions; the scanner of inline marks and the search for a text that fits are
one small vectorised function.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

from . import text as T
from .batches import parts

#: Visible characters of a caption and of a message.
WITH_IMAGE, WITHOUT_IMAGE = 1024, 4096
PROMO_TEXT, PROMO_URL = "Підпишись на канал", "https://t.me/channel"
_VOID = frozenset(("br", "img", "hr", "input", "meta", "link"))
_PAIRS = (("**", "b"), ("__", "b"), ("*", "i"), ("_", "i"), ("`", "code"))
_LINK = re.compile(r"\[([^\]]*)\]\(([^)]*)\)")
_MARKED = re.compile(r"[*_`\[]")
_PIECE = re.compile(r"<[^>]*>|&[^;]*;|.", re.S)


def _mark(s: str, i: int) -> tuple[str, int] | None:
    """The HTML of a marked run that starts at i, and the place behind it."""
    for mark, tag in _PAIRS:
        if not s.startswith(mark, i):
            continue
        start = i + len(mark)
        if mark in "*_" and (start >= len(s) or s[start] == " "):
            continue
        end = s.find(mark, start)
        if end < 0:
            continue
        if mark == "_" and (s[i - 1 : i].isalnum() or s[end + 1 : end + 2].isalnum()):
            return None  # a part of a word
        inner = s[start:end]
        return f"<{tag}>{html.escape(inner, quote=False) if tag == 'code' else inline(inner)}</{tag}>", end + len(mark)
    if s[i] == "[" and (m := _LINK.match(s, i)):
        return f'<a href="{html.escape(m[2])}">{inline(m[1])}</a>', m.end()
    return None


def inline(s: str) -> str:
    """Bold, italic, code and links; a mark that nothing closes stays as it is, and so do underscores inside words."""
    out, plain, i = [], 0, 0
    while m := _MARKED.search(s, i):
        i = m.start()
        if found := _mark(s, i):
            out += [html.escape(s[plain:i], quote=False), found[0]]
            i = plain = found[1]
        else:
            i += 1
    return "".join([*out, html.escape(s[plain:], quote=False)])


def line_html(line: str) -> str:
    """Bullets become dots, numbers stay, headings are bold."""
    if line[:2] in ("- ", "* "):
        return f"• {inline(line[2:].strip())}"
    if m := re.match(r"(\d+)[.)]\s+(.*)", line):
        return f"{m[1]}. {inline(m[2].strip())}"
    if m := re.match(r"#{1,6}\s+(.*)", line):
        return f"<b>{inline(m[1].strip())}</b>"
    return inline(line)


def to_html(markdown: str) -> str:
    """Line by line; blank lines are squeezed."""
    out: list[str] = []
    for line in map(str.strip, markdown.splitlines()):
        if line or (out and out[-1]):
            out.append(line_html(line))
    return "\n".join(out).strip()


def visible(s: str) -> int:
    return len(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"(?i)<br\s*/?>", "\n", s))))


def cut(s: str, limit: int) -> str:
    """At most `limit` visible characters with an ellipsis for the last; open tags are closed, an entity counts as one."""
    if limit <= 0:
        return ""
    if visible(s) <= limit:
        return s
    out, opened, seen = [], [], 0
    for m in _PIECE.finditer(s):
        piece = m[0]
        if seen >= limit - 1:
            break
        if piece[0] == "<" and len(piece) > 1:
            name = (piece[1:-1].strip("/ ").split() or [""])[0].lower()
            if piece[1] == "/":
                if opened[-1:] == [name]:
                    opened.pop()
            elif name and name not in _VOID and not piece.endswith("/>"):
                opened.append(name)
        else:
            seen += 1
        out.append(piece)
    kept = "".join(out).rstrip()
    return kept + ("" if kept.endswith("…") else "…") + "".join(f"</{t}>" for t in reversed(opened))


def trim(s: str, limit: int) -> str:
    """As text.smart_trim."""
    return "".join(_trimmed(s.strip(), limit))


def _trimmed(s: str, limit: int) -> tuple[str, str]:
    """What stays of a text without outer spaces, and the ellipsis or nothing."""
    if limit <= 0:
        return "", ""
    if len(s) <= limit:
        return s, ""
    head = s[:limit].rstrip()
    ends = [(head.rfind(e), 1, 0.4) for e in T.SENTENCE_ENDS] + [(head.rfind("\n"), 0, 0.3), (head.rfind(" "), 0, 0)]
    best = next((b for at, more, least in ends if at >= int(limit * least) and at >= 0 and (b := head[: at + more].strip())), head).rstrip("-•")
    return best, "" if not best or best.endswith(T.SENTENCE_ENDS) else "…"


class Rendered:
    """The lines of a text, each rendered once, with running sums of what is visible: the HTML and visible length of any
    beginning of the text cost only the line that the cut falls in."""

    def __init__(self, text: str) -> None:
        self.said = text.splitlines(keepends=True)
        self.starts = [0, *accumulate(map(len, self.said))]
        self.html: list[str] = []
        self.seen = [0]  # visible characters of html[:i], a line break behind each
        self.upto = [0]  # how many of html are of said[:i]

    def _line(self, at: int) -> int:
        """The line that the place is in, with all before it rendered."""
        found = max(min(bisect_right(self.starts, at) - 1, len(self.said) - 1), 0)
        for line in map(str.strip, self.said[len(self.upto) - 1 : found]):
            if line or (self.html and self.html[-1]):
                self.html.append(line_html(line))
                self.seen.append(self.seen[-1] + visible(self.html[-1]) + 1)
            self.upto.append(len(self.html))
        return found

    def _parts(self, kept: str, end: str) -> tuple[int, str]:
        line = self._line(len(kept))
        return self.upto[line], to_html(kept[self.starts[line] :] + end)

    def visible(self, kept: str, end: str) -> int:
        n, last = self._parts(kept, end)
        return self.seen[n] + visible(last)

    def shown(self, kept: str, end: str) -> str:
        n, last = self._parts(kept, end)
        return "\n".join([*self.html[:n], last]).strip()


def blocks(*found: str) -> str:
    return "\n\n".join(b.strip() for b in found if b and b.strip())


def fitted(header: str, review: Rendered, text: str, link: str, tags: str, promo: str, most: int) -> str:
    """Header, review, link, tags and promo within `most` visible characters: the review shrinks by what is over, then tags
    go from the right, then the text before the promo is cut, at last the promo alone. `review` are the lines of `text`."""
    around = blocks(header, link, tags, promo)
    least = visible(around)
    limit = max(most - least - 2, 0)
    while True:
        kept, end = _trimmed(text, limit)
        own = review.visible(kept, end) + (2 if around else 0) if kept + end else 0
        over = least + own - most
        if over <= 0 or limit <= 0:
            break
        limit = max(limit - over, 0)
    shown = review.shown(kept, end)
    if over <= 0:
        return blocks(header, shown, link, tags, promo)
    words = tags.split()
    for n in range(len(words) - 1, -1, -1):
        whole = blocks(header, shown, link, " ".join(words[:n]), promo)
        if visible(whole) <= most:
            return whole
    main, room = blocks(header, shown, link), most - visible(promo) - 2
    if room >= 0:
        for _ in range(2):
            whole = blocks(cut(main, room), promo)
            if visible(whole) <= most:
                return whole
            room = max(room - (visible(whole) - most), 0)
    return cut(promo, most)


def variants(header: str, review: str, link: str, tags: str, promo: str, kinds: tuple[int, ...]) -> list[str]:
    # a longer review is known to go on behind the last of the characters given
    text = review.strip() if len(review) <= max(kinds) else review
    lines = Rendered(text)
    return [fitted(header, lines, text, link, tags, promo, most) for most in kinds]


@pandas_udf(StringType())
def markdown_html(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else to_html(s))


def with_both(batches: Iterator[pa.RecordBatch], promo: str, kinds: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The last column, the parts of a post, gives way to with_image and without_image."""
    for b in (part for whole in batches for part in parts(whole)):
        n = b.num_columns - 1
        rows = list(zip(*(c.to_pylist() for c in b.column(n).flatten()), strict=True))
        made = [pa.array(own, pa.string()) for own in zip(*[variants(*row, promo, kinds) for row in rows])] or [pa.array([], pa.string())] * 2
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *made], [*b.schema.names[:n], "with_image", "without_image"])


def with_variants(posts: DataFrame, title: Column, review_md: Column, link_url: Column, tags: Column, promo_text: str = PROMO_TEXT, promo_url: str = PROMO_URL) -> DataFrame:
    """posts with with_image and without_image. Nulls are empty."""
    title, review_md, link_url, tags = (F.coalesce(x, F.lit("")) for x in (title, review_md, link_url, tags))
    review = T.drop_leading_title(T.strip_preamble(T.clean_review(review_md), title), title)
    header = F.concat(F.lit("<b>"), T.escape_html(T.strip(title)), F.lit("</b>"))
    link = F.concat(F.lit('<a href="'), T.escape_attribute(link_url), F.lit('">читати далі>></a>'))
    promo = f'<a href="{html.escape(promo_url)}"><b>{html.escape(promo_text, quote=False)}</b></a>'
    kept = posts.schema
    kinds = (WITH_IMAGE, WITHOUT_IMAGE)

    # named by place, so that the posts' own columns may have any names
    given = F.struct(header.alias("header"), F.substring(F.coalesce(review, F.lit("")), 1, max(kinds) + 1).alias("review"), link.alias("link"), T.escape_html(T.strip(tags)).alias("tags"))
    taken = {c.lower() for c in posts.columns}
    name = next(x for x in ("parts" + "_" * i for i in range(len(taken) + 1)) if x not in taken)
    return posts.select("*", given.alias(name)).mapInArrow(lambda batches: with_both(batches, promo, kinds), StructType([*kept.fields, StructField("with_image", StringType()), StructField("without_image", StringType())]))
