import random
import re
import textwrap
import time

import duckdb
import numpy as np

from lakescout.llm import html_extraction as H
from lakescout.llm import license_scan, registry

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[a-z0-9]+")


def windows(pairs: list, known: frozenset, t: int):
    """(shared, n, first, last): the windows of at most m (2 - t) / t bigrams that begin and end at one of the
    template's and reach the threshold of t hundredths."""
    m, hits = len(known), [i for i, pair in enumerate(pairs) if pair in known]
    longest, least = m * (200 - t) // t, -(-m * t // (200 - t))
    for at, first in enumerate(hits):
        if at + least > len(hits) or hits[at + least - 1] - first >= longest:
            continue
        seen, shared, done = set(), 0, first
        for last in hits[at:]:
            if last - first >= longest:
                break
            seen.update(pairs[done : last + 1])
            done, n = last + 1, len(seen)
            shared = len(seen & known)
            if shared * 200 >= t * (n + m):
                yield shared, n, first, last


def matches(text: str | None, known: list[tuple[int, frozenset]], every: frozenset, threshold: float) -> list[tuple[int, int, float, int]]:
    """(line_no, template_no, dice, n) of a text, for templates given as (number, bigrams) and the bigrams of them all.

    A line of its own that reaches the threshold is one match. Of windows, the best that don't overlap count, each at
    the line that it begins in: those within a line only where the line itself has no match, and those across line
    ends unless a line that they touch matches as well or better; they stand for the lines they touch.
    """
    t = round(threshold * 100)
    words = WORD.findall((text or "").encode().lower())
    here = every.intersection(zip(words, words[1:], strict=False))
    near = [(number, bigrams) for number, bigrams in known if len(here & bigrams) * (200 - t) >= len(bigrams) * t] if here else []
    if not near:
        return []
    lines: dict[int, tuple[float, int, int]] = {}
    words, at = [], []
    for line_no, line in enumerate(text.encode().lower().split(b"\n")):
        own = WORD.findall(line)
        words += own
        at += [line_no] * len(own)
        bigrams = set(zip(own, own[1:], strict=False))
        n = len(bigrams)
        for number, template in near:
            m = len(template)
            if n and m * t <= n * (200 - t) and n * t <= m * (200 - t) and (dice := 2.0 * len(bigrams & template) / (n + m)) >= threshold:
                lines[line_no] = max(lines.get(line_no, (0.0, 0, 0)), (dice, -number, n))
    pairs = list(zip(words, words[1:], strict=False))
    # Of equal windows the larger template tells more.
    found = sorted((-2.0 * shared / (n + len(template)), -len(template), number, first, last, n) for number, template in near for shared, n, first, last in windows(pairs, template, t))
    taken, rows, replaced = set(), [], set()
    for less, _, number, first, last, n in found:
        touched = range(at[first], at[last + 1] + 1)
        matched = [lines[i][0] for i in touched if i in lines]
        if matched and (len(touched) == 1 or max(matched) >= -less) or any(i in taken for i in range(first, last + 2)):
            continue
        taken.update(range(first, last + 2))
        replaced.update(touched)
        rows.append((at[first], number, -less, n))
    return sorted(rows + [(i, -less, dice, n) for i, (dice, less, n) in lines.items() if i not in replaced])


def test_article_without_what_surrounds_it(spark):
    page = '<html><head><title>t</title></head><body><nav><a>m</a></nav><div class="ad">Buy this now <article><h1>T &amp; x</h1><p>a&nbsp;b <i>c</i>\n d<br>e</p><script>var x="</p>";</script><p>f</p><section id="comments"><p>said a reader</p></section><aside>x</aside><form>y</form><p>end.</article><footer>c</footer>'
    assert H.main_text(page) == "T & x\na b c d e\nf\nend."


def test_page_without_article():
    page = "<html><body><div id=menu><ul><li><a href=x>m</a><li>n</ul></div><div><p>" + "long text here. " * 20 + "</p><p>short</p><p>" + "more text again. " * 20 + "</p></div><div class=footer>copy</div>"
    lines = H.main_text(page).split("\n")
    assert len(lines) == 3 and lines[1] == "short" and lines[0].startswith("long text")


def test_empty_pages(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "", "y"), (2, "u", "<p>" * 5000, "z"), (3, "u", "<article><p>a</p></article>", "t"), (3, "u", "<article><p>a</p></article>", "t")], "page_id bigint, url string, html string, text string")
    rows = H.extract(df).collect()
    assert len(rows) == 5 and sum(r["text"] == "" and r["n_chars"] == 0 for r in rows) == 3 and sum(r["text"] == "a" for r in rows) == 2
    assert H.extract(df.limit(0)).count() == 0


def test_license_scan_equals_duckdb(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = registry.QUERIES["op4_license_scan"](spark, SF)
    columns = sorted(found.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES['op4_license_scan']})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(want) and want


def test_license_edges(documents):
    rows = [(1, None), (2, ""), (3, "word"), (4, "x\nRELEASED under the MIT-license!\ny"), (None, "Released under the MIT License."), (5, "lorem " * 5000)]
    found = license_scan.scan(documents(rows)).collect()
    assert sorted((str(r["doc_id"]), r["line_no"], r["licence"], r["dice"]) for r in found) == [("4", 1, "MIT", 1.0), ("None", 0, "MIT", 1.0)]
    assert license_scan.scan(documents([])).count() == 0


def test_wrapped_and_embedded_licenses(documents):
    mit, gpl = license_scan.TEMPLATES[2][1], license_scan.TEMPLATES[6][1]
    wrapped = "\n".join(textwrap.wrap(mit, 72))
    commented = "\n".join(f" * {line}" for line in textwrap.wrap(gpl, 60))
    rows = [(1, f"Some title\n\n{wrapped}\n\nThe end."), (2, f"first\n{' '.join(f'before{i}' for i in range(30))} {mit} {' '.join(f'after{i}' for i in range(30))}"), (3, commented), (4, "a b c\nThis text was released\nunder the MIT License. So it is."), (5, "the software and the use of this file\n" * 40)]
    found = license_scan.scan(documents(rows)).collect()
    assert sorted((r["doc_id"], r["line_no"], r["licence"], r["template_no"], r["dice"]) for r in found) == [(1, 2, "MIT", 2, 1.0), (2, 1, "MIT", 2, 1.0), (3, 0, "GPL-3.0", 6, 1.0), (4, 1, "MIT", 0, 1.0)]


def test_licenses_equal_brute_force(documents):
    """Wrapped, embedded, cut, repeated and mixed notices against plain Python over every window."""
    rng = random.Random(4)
    known = [(number, frozenset(tuple(b.encode().split()) for b in license_scan.bigrams_of(text))) for number, (_, text) in enumerate(license_scan.TEMPLATES)]
    every = frozenset().union(*(bigrams for _, bigrams in known))
    rows = [(-1, None), (-2, ""), (-3, "\n\n \n"), (-4, "license"), (-5, "the license\n" * 300)]
    for i in range(120):
        parts = []
        for _ in range(rng.randint(1, 3)):
            words = rng.choice(license_scan.TEMPLATES)[1].split()
            words = [w if rng.random() > 0.08 else rng.choice(["x", "the", "License", "\u212a"]) for w in words if rng.random() > 0.05]
            text = "\n".join(textwrap.wrap(" ".join(words), rng.choice([30, 60, 200])))
            parts.append(rng.choice(["", "before \u00e9 ", "Title\n\n"]) + text + rng.choice(["", " after", "\nThe end"]))
        rows.append((i, rng.choice(["\n", " ", "\n\n"]).join(parts)))
    want = sorted((i, line, number, dice, n) for i, text in rows for line, number, dice, n in matches(text, known, every, license_scan.THRESHOLD))
    found = license_scan.scan(documents(rows)).collect()
    assert sorted((r["doc_id"], r["line_no"], r["template_no"], r["dice"], r["n_bigrams"]) for r in found) == want and len(want) > 100


def test_implied_ends_and_containers():
    long = "This is the text of the page, in sentences. " * 6
    assert H.main_text("<head><title>t</title><body><article><p>a text</p></article>") == "a text"
    assert H.main_text(f"<title>t</title><p>{long}") == long.strip()
    assert H.main_text(f'<body><p class="ad">Buy<p>{long}<p>{long}') == "\n".join([long.strip()] * 2)
    assert H.main_text(f'<body><ul><li class="share">Share this<li>{long}<li>{long}</ul>') == "\n".join([long.strip()] * 2)
    for name in ("layout has-sidebar", "page-with-comments", "widget"):
        assert H.main_text(f'<body><div class="{name}"><p>{long}</p><p>{long}</p><div class="sidebar">x y z</div></div><div class="ad">Buy</div>') == "\n".join([long.strip()] * 2)


def test_hints_that_spare_content():
    long = "This is the text of the page, in sentences. " * 6
    for name in ("related-work", "search-results", "notice-of-meeting"):
        assert H.main_text(f'<article><h1>T</h1><section class="{name}"><p>{long}<p>{long}</section></article>') == "\n".join(["T", long.strip(), long.strip()])
    assert H.main_text('<article><p class="search-results">real text</p></article>') == "real text"
    assert H.main_text(f'<article><p>{long}<div class="related-posts"><p>{long}</div><div class="comment-list"><p>{long}</div></article>') == long.strip()
    assert H.main_text('<article><p>real one<p class="share">x<p>real two<p>real three</article>') == "real one\nreal two\nreal three"


def test_regions_are_chosen_by_their_content(monkeypatch):
    long = "This is the text of the page, in sentences. " * 6
    links = "".join(f"<li><a href=x><b>link {i}</b></a></li>" for i in range(9))
    teaser = f"<body><article><p><a href=x>related teaser</a></p></article><ul>{links}</ul><div><p>{long}</p><p>Short.</p><p>{long}</p></div><ul>{links}</ul>"
    assert H.main_text(teaser) == "\n".join([long.strip(), "Short.", long.strip()])
    both = f"<article><p>{long}</article><article><p>{long}{long}</article><article><a href=x>see also</a></article>"
    assert H.main_text(both) == "\n".join([long.strip(), (long + long).strip()])
    doubtful = f"<article><p>{long}<p>{long}<p>{long}<ul class='related-things'>{links}</ul><p>{long}</article>"
    assert H.main_text(doubtful) == "\n".join([long.strip()] * 4)
    real = [H.main_text(page) for page in (teaser, both, doubtful)]
    for constant in (np.ones, np.zeros):  # neither all lines nor none give these texts
        monkeypatch.setattr(H, "content", lambda lines, constant=constant: constant(len(lines), bool))
        assert all(H.main_text(page) != text for page, text in zip((teaser, doubtful), (real[0], real[2]), strict=True))


def test_smoothing_equals_brute_force():
    rng = random.Random(3)
    for n in range(1, 40):
        ratios = [rng.random() * 100 for _ in range(n)]
        want = [sum(ratios[min(max(i + d, 0), n - 1)] * float(H.KERNEL[d + H.RADIUS]) for d in range(-H.RADIUS, H.RADIUS + 1)) for i in range(n)]
        assert np.allclose(H.smoothed(np.array(ratios)), want)


def test_long_pages_take_time_in_proportion():
    def seconds(page):
        began = time.process_time()
        H.main_text(page)
        return time.process_time() - began

    for part in ("<p>", "<b>", "<p>x", "<li><a>y", "</i>", "<table><tr><td>z", "<header>h"):
        assert seconds(part * 40_000) < 12 * seconds(part * 8_000) + 0.2
    for part in ("<p><button>" + "<b>" * 20_000 + "<div>" * 20_000, "<h1>" * 30_000 + "x<i>" * 30_000):
        assert seconds(part) < 3
