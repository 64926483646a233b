"""Python workers give results in small parts, however many rows Spark sends at once, and every row's in its place."""

import pyarrow as pa

from newsmill.functions import batches
from newsmill.functions import html as H
from newsmill.functions import preview as P
from newsmill.sources import listing


def test_parts_hold_every_row_once():
    for n, size in ((0, 1), (1, 1), (1000, 1), (100, 200_000)):
        own = pa.array(["x" * size + str(i) for i in range(n)], pa.string())
        found = list(batches.parts(own))
        assert [x for p in found for x in p.to_pylist()] == own.to_pylist()
        assert found and all(len(p) <= batches.ROWS and p.nbytes <= 2 * batches.BYTES for p in found)


def test_pages_are_handed_on_in_parts():
    pages = [f"<p>page {i}</p>" if i % 7 else None for i in range(1000)]
    found = list(H.parse_page.func(iter([pa.array(pages[:900], pa.string()), pa.array(pages[900:], pa.string()), pa.array([], pa.string())])))
    assert max(map(len, found)) <= batches.ROWS
    assert [x for p in found for x in p.field("text").to_pylist()] == [(p or "").replace("<p>", "").replace("</p>", "").encode() for p in pages]


def test_scripts_are_handed_on_in_parts():
    scripts = [[f'{{"@type": "NewsArticle", "url": "u{i}", "headline": "h"}}'] * (i % 3) for i in range(1000)]
    for f in (listing.ld_all, listing.ld_top):
        found = list(f.func(iter([pa.array(scripts, pa.list_(pa.string()))])))
        assert max(map(len, found)) <= batches.ROWS
        assert [[x["url"] for x in own] for p in found for own in p.to_pylist()] == [[f"u{i}"] * (i % 3) for i in range(1000)]


def test_previews_are_handed_on_in_parts():
    rows = [{"header": f"<b>{i}</b>", "review": "text " * 50, "link": "l", "tags": "#a"} for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(rows)], ["id", "parts"])
    found = list(P.with_both(iter([batch, batch.slice(0, 0)]), "promo", (100, 200)))
    assert max(b.num_rows for b in found) <= batches.ROWS
    assert [x for b in found for x in b.column("id").to_pylist()] == list(range(1000))
    assert all(x.startswith(f"<b>{i}</b>") for i, x in enumerate(x for b in found for x in b.column("with_image").to_pylist()))
