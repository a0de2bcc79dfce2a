"""Site templates wherever they stand, on mixed hosts and between copies."""

import random

import pytest

from lexmesh.llm import html


def pages(n, host, tail, rng, first=0):
    own = lambda: "".join(f"<p>{' '.join(f'w{rng.randrange(10**6)}' for _ in range(8))}</p>" for _ in range(3))
    return [(first + i, f"http://{host}/{i}", f"<article><h1>T{first + i}</h1>{own()}{tail}</article>") for i in range(n)]


def texts(spark, rows):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_template_of_blocks_at_the_end(spark):
    tail = "<div><p>Follow us</p><p>About this site</p></div><div><p>More here</p><p>Even more</p></div>"
    got = texts(spark, pages(40, "a.example", tail, random.Random(1)))
    assert all(t.startswith(f"T{i}\n\nw") and t.count("\n\n") == 3 for i, t in got.items()), got[0]


@pytest.mark.parametrize("listed", [5000, 0])
def test_copies_and_other_sections_do_not_hide_templates(spark, monkeypatch, listed):
    monkeypatch.setattr(html, "HOST_TEMPLATES", listed)
    rng, tail = random.Random(2), "<div><p>Read this too</p></div>"
    copied = "<article><h1>Copy</h1><p>Same text</p></article>"
    rows = pages(20, "a.example", tail, rng) + [(1000 + i, f"http://a.example/c{i}", copied) for i in range(200)]
    rows += pages(12, "b.example", "<div><p>Section news</p></div>", rng, 2000) + pages(120, "b.example", "", rng, 3000)
    got = texts(spark, rows)
    assert not any("Read this" in t or "Section news" in t for t in got.values())
    assert all(got[1000 + i] == "Copy\n\nSame text" for i in range(200))
    assert len(got) == len(rows) and all(t.startswith(f"T{i}\n\nw") for i, t in got.items() if i < 1000 or i >= 2000)


@pytest.mark.parametrize(
    "page,want",
    [
        ('<div class="layout has-sidebar"><article><p>Text</p></article></div>', ["Text"]),
        ('<div class="sidebar"><article><p>Text</p></article></div>', ["Text"]),
        ('<div id="social-science"><p>Text</p></div>', ["Text"]),
        ('<article><p class="job-search">Text</p><p class="search">No</p></article>', ["Text"]),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>Text</p><div class="share-buttons">No</div></article>', ["Title", "Text"]),
        ('<article><p>Text</p></article><div class="comments"><article><p>No</p></article></div><div class="site-footer">No</div>', ["Text"]),
        ('<div class="cookie-notice top">No</div><div class="ad_slot_2">No</div><p>Text</p><div id="left-sidebar">No</div><div role="search">No</div>', ["Text"]),
        ('<nav><article>No</article></nav><main class="menu"><p>Text</p></main>', ["Text"]),
    ],
)
def test_what_is_named_as_no_main_text(page, want):
    assert [s for s, _ in html.blocks(f"<html><body>{page}</body></html>")[0]] == want


def test_against_a_plain_count(spark):
    """A small site: templates are what a count of subtrees by page says, and every page keeps just its other blocks."""
    rng = random.Random(7)
    lines = [f"<p>line {k}</p>" for k in range(12)]
    rows = []
    for i in range(60):
        some = [x for k, x in enumerate(lines) if rng.random() < k / 30]
        own = [f"<p>own {i} {k}</p>" for k in range(rng.randint(1, 3))]
        parts = some + own
        rng.shuffle(parts)
        rows.append((i, f"https://s{i % 3}.example/x", "<article>" + "".join(parts) + "</article>"))
    rows += [(100 + i, "https://s0.example/y", rows[0][2]) for i in range(20)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html.extract(frame.selectExpr("*", "'x' as text", "'y' as _h", "1 as n_chars")).collect()}
    held = {}
    for _, u, h in rows:
        for b in set(h[9:-10].split("</p>")) - {""}:
            held.setdefault((u.split("/")[2], b), set()).add(h)
    for i, u, h in rows:
        want = [b[3:] for b in h[9:-10].split("</p>") if b and len(held[u.split("/")[2], b]) < html.MIN_PAGES]
        assert got[i] == "\n\n".join(want), i
