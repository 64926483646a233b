"""URL rules as column expressions."""

from __future__ import annotations

from urllib.parse import quote_plus

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Trusted hosts, the tax service's paths, tracking parameters, topic queries and seed feeds.
TRUSTED = (
    "oecd.org", "europa.eu", "eur-lex.europa.eu", "zakon.rada.gov.ua", "bank.gov.ua", "diia.gov.ua", "tax.gov.ua", "minfin.gov.ua", "minjust.gov.ua", "reyestr.court.gov.ua",
    "curia.europa.eu", "irs.gov", "gov.uk", "hmrc.gov.uk", "bundesfinanzministerium.de", "agenziaentrate.gov.it", "tax.gov.ae", "cbu.ae", "ec.europa.eu",
)
TAX_HOST, TAX_NEWS = "tax.gov.ua", "/media-tsentr/novini/"
UTM = {"utm_source": "tg_channel", "utm_medium": "post", "utm_campaign": "tax_watch"}
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty where there is none."""
    return F.regexp_extract(url, "(?s)" + _PARTS, group)


def host(url: Column) -> Column:
    """The authority in lower case, with any user and port; empty without one."""
    return F.lower(part(url, 2))


def trusted(own_host: Column, domains: tuple[str, ...] = TRUSTED) -> Column:
    """A host that ends with a listed domain; no dot need stand before it."""
    return F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: F.endswith(own_host, d))


def parameter(url: Column, name: str) -> Column:
    """The first non-empty value of a query parameter, decoded."""
    raw = F.nullif(F.regexp_extract(part(url, 4), rf"(?:^|&){name}=([^&]+)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(raw), raw)


def unwrap(url: Column) -> Column:
    """The target of a news aggregator's redirect."""
    return F.when(F.endswith(host(url), F.lit("news.google.com")), F.coalesce(parameter(url, "url"), parameter(url, "u"), url)).otherwise(url)


def _tax_path(url: Column) -> tuple[Column, Column, Column]:
    path = part(url, 3)
    own = F.regexp_replace(path, "/+$", "")
    ours = F.contains(host(url), F.lit(TAX_HOST)) & F.startswith(path, F.lit(TAX_NEWS))
    number = F.regexp_extract(F.regexp_extract(own, "([^/]*)$", 1), r"(\d{4,})", 1)
    return ours, own, number


def _with_path(url: Column, path: Column) -> Column:
    scheme, authority = part(url, 1), part(url, 2)
    return F.concat(F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""), F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""), path)


def tax_print(url: Column) -> Column:
    """The print page of a tax service's news item; null for other URLs and where no number is found."""
    ours, path, number = _tax_path(url)
    printed = F.when(F.endswith(path, F.lit(".html")), path).otherwise(F.concat(path, F.lit(".html")))
    made = F.when(F.contains(path, F.lit("print-")), printed).when(number != "", F.concat(F.lit(f"{TAX_NEWS}print-"), number, F.lit(".html")))
    return F.when(ours, _with_path(url, made))


def tax_canonical(url: Column) -> Column:
    """The page itself of a tax service's news item or of its print page; null for other URLs."""
    ours, path, number = _tax_path(url)
    own = F.when(F.contains(path, F.lit("print-")), F.when(number != "", F.concat(F.lit(TAX_NEWS), number, F.lit(".html")))).when(F.endswith(path, F.lit(".html")), path)
    return F.when(ours, _with_path(url, own))


def canonical(url: Column) -> Column:
    own = unwrap(url)
    return F.coalesce(tax_canonical(own), own)


def with_utm(url: Column, utm: dict[str, str] = UTM) -> Column:
    """Tracking parameters at the very end, after any fragment."""
    tail = "&".join(f"{k}={quote_plus(v)}" for k, v in utm.items())
    return F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit(tail))


def first_markdown_link(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"\((https?://[^)\s]+)\)", 1), F.lit(""))


def fetch_address(url: Column) -> Column:
    """Tax service pages are asked of one host, path and query kept, fragment dropped."""
    query = part(url, 4)
    forced = F.concat(F.lit("https://www.tax.gov.ua"), part(url, 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.endswith(host(url), F.lit(TAX_HOST)), forced).otherwise(url)


def _split(url: Column) -> Column:
    return F.struct(*[part(url, i).alias(n) for i, n in enumerate(("scheme", "authority", "path", "query", "fragment"), 1)])


def _steps(link: Column, base: Column) -> Column:
    """The segments of a link's path as seen from the base's; empty ones between go where the link does not start at the root."""
    own, under = F.split(link, "/"), F.split(base, "/")
    folder = F.when(F.element_at(under, -1) == "", under).otherwise(F.slice(under, F.lit(1), F.size(under) - 1))

    def joined(x: Column) -> Column:
        between = F.filter(F.slice(x, F.lit(2), F.greatest(F.size(x) - 2, F.lit(0))), lambda s: s != "")
        return F.when(F.size(x) < 2, x).otherwise(F.concat(F.slice(x, 1, 1), between, F.slice(x, -1, 1)))

    return F.when(F.startswith(link, F.lit("/")), own).otherwise(let(F.concat(folder, own), joined))


def _walked(steps: Column) -> Column:
    """The path that the segments lead to: `..` takes the last one off what has been walked, as often as it comes."""
    step = lambda way, s: F.when(s == "..", F.slice(way, F.lit(1), F.greatest(F.size(way) - 1, F.lit(0)))).when(s == ".", way).otherwise(F.array_append(way, s))
    way = F.aggregate(steps, F.array().cast("array<string>"), step)
    open_end = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(way, open_end)


def absolute(link: Column, base: Column) -> Column:
    """A link as seen from an http(s) page (RFC 3986): absolute, scheme-relative, root-relative, a query, a fragment or a path."""

    def of(own: Column, page: Column) -> Column:
        behind = lambda mark, x: F.when(x != "", F.concat(F.lit(mark), x)).otherwise("")
        walked = let(_steps(own["path"], page["path"]), lambda steps: F.array_join(_walked(steps), "/"))
        path = F.when(own["authority"] != "", own["path"]).when(own["path"] == "", page["path"]).otherwise(let(walked, lambda w: F.when(F.startswith(w, F.lit("/")), w).otherwise(F.concat(F.lit("/"), w))))
        query = F.when((own["authority"] == "") & (own["path"] == "") & (own["query"] == ""), page["query"]).otherwise(own["query"])
        authority = F.when(own["authority"] != "", own["authority"]).otherwise(page["authority"])
        return F.concat(F.lower(page["scheme"]), F.lit("://"), authority, path, behind("?", query), behind("#", own["fragment"]))

    foreign = lambda own, page: (own["scheme"] != "") & (F.lower(own["scheme"]) != F.lower(page["scheme"]))
    return F.when(link == "", base).otherwise(let(_split(link), lambda own: let(_split(base), lambda page: F.when(foreign(own, page), link).otherwise(of(own, page)))))


def listing_link(link: Column, base: Column, site: str) -> Column:
    """An http(s) link to the site, null for any other."""
    own = absolute(strip_spaces(link), base)
    return F.when(part(own, 1).isin("http", "https") & F.contains(host(own), F.lit(site)), own)


def strip_spaces(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def resource(source: Column, label: Column) -> Column:
    """struct(key, label) of a source in reports: a label given wins, else the host, else the source as it is."""
    own = F.nullif(host(source), F.lit(""))
    return F.struct(F.when(label.isNotNull(), source).otherwise(F.coalesce(own, source)).alias("key"), F.coalesce(label, own, source).alias("label"))
