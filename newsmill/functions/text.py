"""Text rules as column expressions.

All patterns carry (?U): letters, digits and spaces are Unicode's. Arguments are columns; null texts stay null unless a
docstring says otherwise.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that do not count when lines are compared, months, section labels, default tags.
MARKERS = "*_`~'\"“”„”’«»‹›（）()[]{}"
MONTHS_GENITIVE = ("січня", "лютого", "березня", "квітня", "травня", "червня", "липня", "серпня", "вересня", "жовтня", "листопада", "грудня")
SECTION_LABELS = {"довгий пост": "long", "довгий допис": "long", "короткий пост": "short", "короткий допис": "short"}
SECTION_SEPARATORS = (":", "—", "-", "–")
BASE_TAGS = "#PillarTwo #CFC #CRS #BO #WHT #IPBox #TP #DiiaCity #NBU #UkraineTax #IT"
#: The publisher's own line under a post; pass another where it differs.
PROMO_MD = "[**Підпишись на канал**](https://t.me/channel)"
DISCLAIMER = "Матеріал має інформативний характер і не є податковою/юридичною консультацією."
MOST_REWRITE, MOST_ARTICLE = 3800, 4000
SENTENCE_ENDS = (".", "!", "?", "…")
#: Unicode's white space, which \s finds under (?U).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: A reference behind its ampersand: a number or what may be a name.
_REFERENCE = r"^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_OLD_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_OLD = f"^({'|'.join(_OLD_NAMES)})"
#: Numbers that stand for others: the bytes of Windows' Latin alphabet, those without a character for themselves as are the
#: carriage return and the byte order mark, which decoding would drop.
_CODES = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)} | {0xD: "\r", 0xFEFF: "\ufeff"}

_UA_DATE = rf"(?U)\b\d{{1,2}}\s+({'|'.join(MONTHS_GENITIVE)})\s+\d{{4}}\b"
_LABEL_WORDS = sorted({label.split()[0] for label in SECTION_LABELS})
_CLASS = "".join("\\" + c if c in "[]\\^-&" else c for c in MARKERS)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def strip_end(x: Column) -> Column:
    return F.rtrim(x, F.lit(SPACES))


def blank(x: Column) -> Column:
    """Null or of spaces only."""
    return F.coalesce(strip(x), F.lit("")) == ""


def non_blank(x: Column) -> Column:
    """The stripped text, null where nothing is left."""
    return let(strip(x), lambda own: F.when(own != "", own))


def collapse(x: Column) -> Column:
    # single spaces, most of all runs, are not matched
    return strip(F.regexp_replace(x, r"(?U)[^\S ]\s*| \s+", " "))


def lines(x: Column) -> Column:
    """An array of lines, without the empty one that a last line break leaves."""
    found = F.split(x, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    return let(found, lambda own: F.when(F.try_element_at(own, F.lit(-1)) == "", F.slice(own, 1, F.size(own) - 1)).otherwise(own))


def join_lines(x: Column) -> Column:
    return F.array_join(x, "\n")


def contains_any(x: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds any of the phrases."""
    return F.rlike(F.lower(x), F.lit("|".join(re.escape(p.lower()) for p in phrases)))


def normalize_paragraphs(x: Column) -> Column:
    """Blank lines part paragraphs; a paragraph's lines are joined by spaces; null where nothing is left."""
    parts = F.transform(F.split(x, r"(?U)(?:\r\n|\n|\r)\s*(?:\r\n|\n|\r)"), collapse)
    return let(F.array_join(F.filter(parts, lambda p: p != ""), "\n\n"), lambda own: F.when(own != "", own))


def title_key(x: Column) -> Column:
    """What titles are compared by: spaces collapsed, markers and leading dashes stripped, lower case."""
    bare = F.btrim(collapse(x), F.lit(MARKERS))
    return F.lower(F.regexp_replace(bare, r"(?U)^[\-–—•:*]+\s*", ""))


def has_ua_date(x: Column) -> Column:
    """A day, a month's name in the genitive and a year anywhere in the compared form."""
    return F.rlike(title_key(x), F.lit(_UA_DATE))


def is_person_intro(x: Column) -> Column:
    """`Name: what was said`: a colon after 3 to 100 characters, the first of them a capital."""
    return F.rlike(x, F.lit(r"(?Us)^\s*(?=\p{Lu})[^:]{3,100}:"))


def strip_preamble(x: Column, title: Column) -> Column:
    """Leading lines that are blank, repeat the title, hold a date or introduce a person go; the others are stripped."""

    def skipped(line: Column, key: Column) -> Column:
        def repeats(mine: Column) -> Column:
            return (key != "") & F.startswith(mine, key) & F.rlike(F.substr(mine, F.length(key) + 1), F.lit(r"^[ .,:;!?\-–—]*$")) | F.rlike(mine, F.lit(_UA_DATE))

        return (line == "") | is_person_intro(line) | let(title_key(line), repeats)

    def kept(both: Column) -> Column:
        own = both["lines"]
        # once a line is kept the others are not looked at
        step = lambda acc, line: F.when(acc["at"] > 0, acc).otherwise(F.struct((acc["n"] + 1).alias("n"), F.when(skipped(line, both["key"]), 0).otherwise(acc["n"] + 1).alias("at")))
        first = F.aggregate(own, F.struct(F.lit(0).alias("n"), F.lit(0).alias("at")), step)["at"]
        return let(first, lambda at: F.when(at > 0, strip(join_lines(F.slice(own, at, F.greatest(F.size(own), F.lit(1)))))).otherwise(""))

    given = lambda own: F.struct(F.transform(lines(own), strip).alias("lines"), F.coalesce(title_key(title), F.lit("")).alias("key"))
    return let(x, lambda own: F.when(own.isNotNull(), let(given(own), kept)))


def rebuild_body(body: Column, title: Column, promo: str = PROMO_MD) -> Column:
    """The body with one bold title line at its head, no repeated heading lines, and the promo at its end if it was there."""
    own = promo.strip()
    name = strip(F.coalesce(title, F.lit("")))
    head = let(name, lambda n: F.when(n == "", "").otherwise(F.concat(F.lit("**"), n, F.lit("**"))))
    given = F.struct(strip(F.coalesce(body, F.lit(""))).alias("text"), head.alias("head"))

    def beheaded(g: Column) -> Column:
        repeats = (g["head"] != "") & F.startswith(g["text"], g["head"])
        return F.when(repeats, F.regexp_replace(F.substr(g["text"], F.length(g["head"]) + 1), r"^[\n ]+", "")).otherwise(g["text"])

    def whole(g: Column, rest: Column) -> Column:
        has = F.endswith(rest, F.lit(own)) if own else F.lit(False)
        return let(has, lambda h: joined(g, h, F.when(h, strip_end(F.substr(rest, F.lit(1), F.length(rest) - len(own)))).otherwise(rest)))

    def joined(g: Column, has: Column, rest: Column) -> Column:
        core = F.coalesce(strip_preamble(rest, F.coalesce(title, F.lit(""))), F.lit(""))
        parts = F.filter(F.array(g["head"], core, F.when(has, F.lit(own)).otherwise("")), lambda p: p != "")
        return strip(F.array_join(parts, "\n\n"))

    return let(given, lambda g: F.when(g["text"] == "", "").otherwise(let(beheaded(g), lambda rest: whole(g, rest))))


def clean_lines(found: Column) -> Column:
    """Stripped lines with runs of blank ones squeezed to one and none at the ends."""
    own = strip(join_lines(F.transform(found, strip)))
    return F.regexp_replace(own, r"\n{3,}", "\n\n")


def clean_review(x: Column) -> Column:
    return clean_lines(lines(x))


def post_sections(x: Column) -> Column:
    """struct(long, short) of a generated post. A label ends at the first separator in SECTION_SEPARATORS' own order;
    a repeated label overwrites; without a long part the lines before any label serve, then the short part."""
    none = "cast(array() as array<string>)"

    def parsed(line: Column) -> Column:
        def named(bare: Column) -> Column:
            sep = F.lit(None).cast("string")
            for own in reversed(SECTION_SEPARATORS):
                sep = F.when(F.contains(bare, F.lit(own)), own).otherwise(sep)
            return let(F.coalesce(F.position(sep, bare), F.lit(0)), lambda at: split_at(bare, at))

        def split_at(bare: Column, at: Column) -> Column:
            label = F.lower(collapse(F.when(at > 0, F.substr(bare, F.lit(1), at - 1)).otherwise(bare)))
            known = F.create_map(*[F.lit(v) for kv in SECTION_LABELS.items() for v in kv])
            rest = F.when(at > 0, strip(F.substr(bare, at + 1))).otherwise("")
            return F.struct(F.try_element_at(known, label).alias("kind"), rest.alias("rest"))

        return F.struct(let(strip(line), named).alias("head"), line.alias("line"))

    # parts: what stands under each label, in order; the last of a kind that holds anything counts
    zero = F.expr(f"cast(array(named_struct('kind', cast(null as string), 'lines', {none})) as array<struct<kind:string,lines:array<string>>>)")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        starts = x["head"]["kind"].isNotNull()
        fresh = F.struct(x["head"]["kind"].alias("kind"), F.when(x["head"]["rest"] != "", F.array(x["head"]["rest"])).otherwise(F.expr(none)).alias("lines"))
        grown = F.struct(last["kind"].alias("kind"), F.array_append(last["lines"], x["line"]).alias("lines"))
        return F.when(starts, F.array_append(acc, fresh)).otherwise(F.array_append(F.slice(acc, 1, F.size(acc) - 1), grown))

    def chosen(parts: Column) -> Column:
        def under(kind: str) -> Column:
            return F.try_element_at(F.filter(parts, lambda p: (p["kind"] == kind) & (F.size(p["lines"]) > 0)), F.lit(-1))["lines"]

        before = F.get(parts, F.lit(0))["lines"]
        both = F.struct(clean_lines(F.coalesce(under("long"), before)).alias("long"), clean_lines(under("short")).alias("short"))
        return let(both, lambda b: F.struct(F.when((b["long"] == "") & (F.coalesce(b["short"], F.lit("")) != ""), b["short"]).otherwise(b["long"]).alias("long"), b["short"].alias("short")))

    labelled = lambda own: let(F.lower(own), lambda low: reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in _LABEL_WORDS]))
    nothing = F.struct(F.lit(None).cast("string").alias("kind"), F.lit("").alias("rest"))
    line_of = lambda line: F.struct(F.when(labelled(line), parsed(line)["head"]).otherwise(nothing).alias("head"), line.alias("line"))
    sections = lambda own: let(F.aggregate(F.transform(lines(own), line_of), zero, step), chosen)
    # a text without a label is its own long part
    plain = lambda own: F.struct(clean_lines(lines(own)).alias("long"), F.lit(None).cast("string").alias("short"))
    return let(F.coalesce(x, F.lit("")), lambda own: F.when(labelled(own), sections(own)).otherwise(plain(own)))


def tags_of(x: Column, default: str = BASE_TAGS) -> Column:
    """The first `Теги:` line's hashtags, each once; its words if it has none; the default list without such a line."""
    line = strip(F.regexp_extract(x, r"(?Um)^Теги:\s*(.+)$", 1))
    words = F.filter(F.split(F.replace(line, F.lit(","), F.lit(" ")), r"(?U)\s+"), lambda t: F.startswith(t, F.lit("#")))
    return F.when(F.coalesce(line, F.lit("")) == "", default).when(F.size(words) > 0, F.array_join(F.array_distinct(words), " ")).otherwise(collapse(line))


def draft_body(raw: Column, title: Column, promo: str = PROMO_MD) -> Column:
    """A draft's body: the long section or the whole text without its tag lines, no repeated heading, and the promo."""

    def body(both: Column) -> Column:
        core = strip_preamble(F.coalesce(both["long"], both["untagged"]), F.coalesce(title, F.lit("")))
        return strip(F.concat(F.coalesce(non_blank(core), both["untagged"]), F.lit("\n\n" + promo)))

    untagged = strip(F.when(F.contains(raw, F.lit("Теги:")), F.regexp_replace(raw, r"(?Um)^Теги:.*$", "")).otherwise(raw))
    return let(F.struct(untagged.alias("untagged"), non_blank(post_sections(raw)["long"]).alias("long")), body)


def sources_line(domain: Column, link: Column) -> Column:
    return F.concat(F.lit("Читати далі: ["), domain, F.lit("]("), link, F.lit(f")\n\n_{DISCLAIMER}_"))


def rewrite_fallback(payload: Column) -> Column:
    """What stands for a rewrite where no model answers."""
    return F.substring(payload, 1, MOST_REWRITE)


def prompt(template: str, tags: Column, title: Column) -> Column:
    """The template with {base_tags} and {article_title} filled in; braces in the title are doubled."""
    safe = F.replace(F.replace(title, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    return F.replace(F.replace(F.lit(template), F.lit("{base_tags}"), tags), F.lit("{article_title}"), safe)


def escape_html(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(x: Column) -> Column:
    return F.replace(F.replace(escape_html(x), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def unescape(x: Column) -> Column:
    """HTML's named and numeric references undone in one pass, as browsers do: old names without a semicolon count too, the
    longest that begins what stands there; numbers of no character vanish or become U+FFFD."""
    names = F.from_json(F.lit(json.dumps({k: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")

    def number(digits: Column, base: int) -> Column:
        # eight digits hold every code point and some that are too large
        bare = F.ltrim(digits, F.lit("0"))
        code = F.when(F.length(bare) > 8, 0x110000).otherwise(F.coalesce(F.conv(bare, base, 10).cast("int"), F.lit(0)))
        return let(code, character)

    def character(code: Column) -> Column:
        odd = F.create_map(*[F.lit(v) for kv in _CODES.items() for v in kv])
        none = code.between(0x1, 0x8) | (code == 0xB) | code.between(0xE, 0x1F) | code.between(0x7F, 0x9F) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(odd, code), F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF) | (code == 0), "\ufffd").when(none, "").otherwise(plain))

    def undone(part: Column) -> Column:
        """A stretch that starts with an ampersand, but for the first of a text."""
        found = F.regexp_extract(part, _REFERENCE, 1)
        return let(found, lambda r: F.when(r == "", part).otherwise(F.concat(meant(r), F.substr(part, F.length(r) + 2))))

    def meant(r: Column) -> Column:
        digits = F.rtrim(r, F.lit(";"))
        old = let(F.regexp_extract(r, _OLD, 1), lambda n: F.when(n != "", F.concat(F.try_element_at(F.from_json(F.lit(json.dumps({k: html5[k] for k in _OLD_NAMES})), "map<string,string>"), n), F.substr(r, F.length(n) + 1))))
        named = F.coalesce(F.try_element_at(names, r), old, F.concat(F.lit("&"), r))
        return F.when(F.rlike(r, F.lit("^#[xX]")), number(F.substr(digits, F.lit(3)), 16)).when(F.startswith(r, F.lit("#")), number(F.substr(digits, F.lit(2)), 10)).otherwise(named)

    whole = F.array_join(F.transform(F.split(x, "(?=&)"), undone), "")
    return F.when(F.contains(x, F.lit("&")), whole).otherwise(x)


def visible_text(html: Column) -> Column:
    """Line breaks for <br>, no tags, and no references."""
    return unescape(F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", ""))


def visible_length(html: Column) -> Column:
    return F.length(visible_text(html))


def last_index(x: Column, what: str) -> Column:
    """Zero-based place of the last occurrence, -1 if there is none."""
    at = F.locate(what[::-1], F.reverse(x))
    return F.when(at > 0, F.length(x) - at - len(what) + 1).otherwise(-1)


def smart_trim(x: Column, limit: Column | int) -> Column:
    """At most `limit` characters (and an ellipsis): up to the last full stop in the latter 60 %, else the last `!`, `?`, `…`
    in that order, else the last line break in the latter 70 %, else the last space."""
    limit = F.lit(limit) if isinstance(limit, int) else limit

    def ended(best: Column) -> Column:
        return F.when((best == "") | F.rlike(best, F.lit("[.!?…]$")), best).otherwise(F.concat(best, F.lit("…")))

    def best(cut: Column) -> Column:
        found = []
        for end, more, least in (*((e, 1, 0.4) for e in SENTENCE_ENDS), ("\n", 0, 0.3), (" ", 0, 0.0)):
            found.append(_upto(cut, end, more, limit * least))
        return let(F.rtrim(F.coalesce(*found, strip(cut)), F.lit("-•")), ended)

    trimmed = lambda own: F.when(F.length(own) <= limit, own).otherwise(let(strip_end(F.substr(own, F.lit(1), limit)), best))
    return F.when(limit <= 0, F.when(x.isNotNull(), F.lit(""))).otherwise(let(strip(x), trimmed))


def _upto(cut: Column, end: str, more: int, least: Column) -> Column:
    """The text to the last `end` (with it if `more` is 1), null where that stands before `least`."""
    return let(last_index(cut, end), lambda at: F.nullif(F.when((at >= 0) & (at >= F.floor(least)), strip(F.substr(cut, F.lit(1), at + more))), F.lit("")))


def plain_heading(x: Column) -> Column:
    """A line without heading marks and one pair of emphasis around it."""

    def bare(own: Column, *marks: str) -> Column:
        """Without the first of the marks that stands at both ends with something between."""
        around = [(m, F.startswith(own, F.lit(m)) & F.endswith(own, F.lit(m)) & (F.length(own) > 2 * len(m))) for m in marks]
        return reduce(lambda rest, a: F.when(a[1], F.substr(own, F.lit(len(a[0]) + 1), F.length(own) - 2 * len(a[0]))).otherwise(rest), around[::-1], own)

    single = lambda own: let(bare(own, "*"), lambda x: bare(x, "_"))
    return strip(let(let(F.regexp_replace(strip(x), r"(?U)^#+\s*", ""), lambda own: bare(own, "**", "__")), single))


def drop_leading_title(x: Column, title: Column) -> Column:
    """Everything up to the first line that is the title goes, and repeats of it right after; without one the text is only stripped."""

    def told(line: Column, key: Column) -> Column:
        """0 for a blank line, 1 for the title, 2 for any other."""
        near = F.contains(F.lower(line), F.substring_index(key, " ", 1))
        return F.when(line == "", 0).when(near & (F.lower(collapse(plain_heading(line))) == key), 1).otherwise(2)

    def kept(both: Column) -> Column:
        own, kinds = both["lines"], both["kinds"]
        first = F.array_position(kinds, F.lit(1)).cast("int")
        rest = lambda at: F.array_position(F.slice(kinds, at + 1, F.size(kinds)), F.lit(2)).cast("int")
        start = lambda at: let(rest(at), lambda n: F.when(n > 0, strip(join_lines(F.slice(own, at + n, F.greatest(F.size(own), F.lit(1)))))).otherwise(""))
        return let(first, lambda at: F.when(at > 0, start(at)).otherwise(strip(join_lines(own))))

    kinds = lambda found, key: F.struct(found.alias("lines"), F.transform(found, lambda line: told(strip(line), key)).alias("kinds"))
    marked = lambda own: let(F.lower(collapse(F.coalesce(title, F.lit("")))), lambda key: let(lines(own), lambda found: kinds(found, key)))
    return let(x, lambda own: F.when(own.isNotNull(), let(marked(own), kept)))


def join_blocks(*blocks: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.array(*[F.coalesce(b, F.lit("")) for b in blocks]), strip), lambda b: b != ""), "\n\n")


def cap_blocks(blocks: Column, most: int = MOST_ARTICLE, at_break: int | None = 2000) -> Column:
    """Blocks joined by blank lines; past `most` characters cut at the last blank line behind `at_break`, else the last space."""

    def shortened(cut: Column) -> Column:
        space = let(last_index(cut, " "), lambda at: F.when(at >= 0, F.substr(cut, F.lit(1), at)).otherwise(cut))
        return strip(space if at_break is None else let(last_index(cut, "\n\n"), lambda at: F.when(at > at_break, F.substr(cut, F.lit(1), at)).otherwise(space)))

    whole = lambda x: F.when(F.length(x) > most, let(F.substring(x, 1, most), shortened)).otherwise(x)
    return F.nullif(let(strip(F.array_join(blocks, "\n\n")), whole), F.lit(""))


def ellipsis(x: Column, most: int = 80) -> Column:
    return F.concat(F.substring(x, 1, most), F.when(F.length(x) > most, "…").otherwise(""))


def pack_lines(found: Column, most: int = 4000) -> Column:
    """Lines packed greedily into messages of at most `most` characters, line breaks counted; a longer line stands alone."""
    step = lambda acc, line: F.when(
        (F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + 1 + F.length(line) <= most),
        F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.concat(F.element_at(acc, -1), F.lit("\n"), line)),
    ).otherwise(F.array_append(acc, line))
    return F.aggregate(found, F.expr("cast(array() as array<string>)"), step)


def choose_summary(title: Column, provided: Column, meta: Column, body: Column) -> Column:
    """The given summary or the page's description unless it is the title, else the body."""
    same = lambda x: F.lower(x) == F.lower(F.coalesce(normalize_paragraphs(title), F.lit("")))
    given, described = normalize_paragraphs(provided), normalize_paragraphs(meta)
    return F.coalesce(F.when(~same(given), given), F.when(~same(described), described), body)


def initial_summary(domain: Column, kind: Column, provided: Column) -> Column:
    """No teaser where the tax service's print page was read."""
    return F.when(F.coalesce(F.endswith(domain, F.lit("tax.gov.ua")) & (kind == "print"), F.lit(False)), None).otherwise(provided)
