"""Licences, packing, media, HTML, language, quality: edge cases and brute force."""

import hashlib
import io
import math
import random
import time
import wave
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from normlens.llm import html_text, langid, licences, media, packing, quality
from normlens.llm.common import WORD, segments, word_hashes
from normlens.llm.queries import OP1_SQL, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Word, another  word!\n" * 20_000
TEXTS = [None, "", "   ", "one", "Ünï côde ẞ Σίσυφος 中文 \U0001f600", "a b c d e", "a b c d e", LONG, "\x1c\x1f odd \x85 spaces　here <|endoftext|>"]


def documents(spark, texts=TEXTS, extra=False):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)] + [(5, "a b c d e", "en", None, 9), (None, "no id", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        df = df.withColumns({c: F.lit(c) for c in ("size", "score", "part", "node", "digest", "shard", "at", "place", "ids", "region", "license_id", "quality")})
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_licence_forms(spark):
    mit = licences.KNOWN["MIT"]
    texts = [
        mit,
        "MIT License\n".replace("MIT License\n", "") + "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + mit.upper().replace(",", " ,\n"),
        mit.replace("sublicense", "sub-licence").replace('"', "'"),
        mit + " And one more clause.",
        "Licensed under the Apache Licence, version 2.0",
        None,
        "© 2020 nobody",
        "",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.matched) for r in licences.scan(rows).collect()}
    assert [got[i][0] for i in range(8)] == ["MIT", "MIT", "MIT", None, "Apache-2.0", None, None, None]
    assert all(m == (x is not None) for x, m in got.values())
    own = spark.createDataFrame([("b", "My  Terms."), ("a", "my terms"), ("z", None), ("y", "...")], "license_id string, text string")
    assert [r.license_id for r in licences.scan(spark.createDataFrame([(1, "MY TERMS!", 3)], "doc_id long, text string, license_id int"), own).collect()] == ["a"]
    assert licences.scan(documents(spark, extra=True)).count() == len(TEXTS) + 2
    assert licences.scan(empty(spark)).count() == 0


def wrapped(text, width):
    import textwrap

    return textwrap.fill(text, width)


def test_licence_files(spark):
    """Files as they are shipped: a title, holders, hard-wrapped terms of which lines begin with copyright."""
    heads = {"MIT": "MIT License\n\nCopyright (c) 2020 A. Person\n\n", "ISC": "ISC License (ISC)\nCopyright 2004-2010 by X, Inc. (\"X\")\nCopyright (c) 1995 Y\n\n", "BSD-3-Clause": "BSD 3-Clause License\r\n\r\nCopyright Jane Doe\nAll rights reserved.\n\n"}
    cases = [(k, head + wrapped(licences.KNOWN[k], w)) for k, head in heads.items() for w in range(40, 100)]
    isc = licences.KNOWN["ISC"].replace("the above copyright", "the above\ncopyright").replace(" and this permission", "\nand this permission")
    cases += [("ISC", isc), ("MIT", "The MIT License (MIT)\n\nCopyright The X Authors\n" + licences.KNOWN["MIT"])]
    cases += [(None, "MIT License without commercial use\n" + licences.KNOWN["MIT"]), (None, "MIT License"), (None, isc.replace("copyright notice", "copyright owner"))]
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licences.scan(rows).collect()}
    assert [(i, k, got[i]) for i, (k, _) in enumerate(cases) if got[i] != k] == []
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (_, t) in enumerate(cases)])
    assert dict(con.execute(f"SELECT doc_id, license_id FROM ({OP1_SQL})").fetchall()) == got


def test_licence_signs_and_lists(spark):
    """Curly quotes, long dashes, odd spaces and list marks of any kind are form, not terms."""
    bsd, mit = licences.KNOWN["BSD-3-Clause"], licences.KNOWN["MIT"]
    curly = mit.replace('(the "', "(the \u201c").replace('Software")', "Software\u201d)").replace('"AS IS"', "\u201cAS\u00a0IS\u201d").replace(", FITNESS", " \u2014 FITNESS")
    marks = [("\n\n* ", "\n* ", "\n* "), ("\n\u2022 ", "\n\u2022 ", "\n\u2022 "), ("\n  (a) ", "\n  (b) ", "\n  (c) "), ("\n1)\t", "\n2)\t", "\n3)\t"), ("\n", "\n", "\n")]
    cases = [("MIT", curly)]
    for one, two, three in marks:
        cases.append(("BSD-3-Clause", bsd.replace(" 1. ", one).replace(" 2. ", two).replace(" 3. ", three)))
    cases += [(None, licences.KNOWN["GPL-3.0-only"].replace("3.", "2.")), ("GPL-3.0-only", licences.KNOWN["GPL-3.0-only"] + "\n"), (None, bsd.replace("Neither", "Either"))]
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.digest) for r in licences.scan(rows).collect()}
    assert [got[i][0] for i in range(len(cases))] == [k for k, _ in cases]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (_, t) in enumerate(cases)])
    assert {i: (k, d) for i, k, d in con.execute(f"SELECT doc_id, license_id, digest FROM ({OP1_SQL})").fetchall()} == got


def test_licence_variants(spark):
    """Usual files that differ in holders, tags and addresses match; changed terms do not. Spark and DuckDB agree."""
    k = licences.KNOWN
    holder = lambda name: k["BSD-3-Clause"].replace("the name of the copyright holder", f"the name of {name}")
    apache = k["Apache-2.0-text"]
    cases = [
        ("BSD-3-Clause", holder("Acme Inc.")),
        ("BSD-3-Clause", holder("the University of California, Berkeley")),
        ("BSD-3-Clause", holder("the <organization>")),
        (None, holder(" ".join(["word"] * 13))),
        (None, holder("Acme Inc.").replace("may be used", "may always be used")),
        ("MIT", "MIT License\n\nCopyright (c) 2020 Foo, Bar and\nBaz, Inc.\n\n" + wrapped(k["MIT"], 78)),
        ("MIT", "Copyright (c) 2020 Foo Bar,\n   Inc. <foo@example.org>\n" + k["MIT"]),
        ("MIT", k["MIT"] + "\n\nhttps://opensource.org/licenses/MIT\n"),
        ("MIT", k["MIT"] + "\n// See <http://a.example/x>\nhttps://b.example"),
        (None, k["MIT"] + "\nhttps://a.example and more"),
        ("MIT", "SPDX-License-Identifier: MIT\n" + k["MIT"]),
        ("ISC", "// SPDX-License-Identifier: ISC\r\n// Copyright 2020 X\r\n" + k["ISC"]),
        ("Apache-2.0-text-terms", apache.split("END OF TERMS")[0]),
        ("Apache-2.0-text-terms-end", apache.split("   APPENDIX:")[0]),
        ("Apache-2.0-text", apache),
        (None, "SPDX-License-Identifier: MIT"),
        (None, "x\nhttps://only.example"),
    ]
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.digest) for r in licences.scan(rows).collect()}
    assert [(i, got[i][0]) for i in range(len(cases))] == [(i, want) for i, (want, _) in enumerate(cases)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (_, t) in enumerate(cases)])
    assert {i: (n, d) for i, n, d in con.execute(f"SELECT doc_id, license_id, digest FROM ({OP1_SQL})").fetchall()} == got


def test_licence_full_texts(spark):
    names = ["Apache-2.0-text", "CC0-1.0-text", "GPL-2.0-text", "GPL-3.0-text", "LGPL-2.1-text", "LGPL-3.0-text", "MPL-2.0-text"]
    texts = [licences.KNOWN[n] for n in names]
    assert all(len(t) > 5_000 for t in texts)
    reflowed = ["\n\n".join(wrapped(" ".join(p.split()), 100) for p in t.split("\n\n")) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts + [texts[0].replace("Licensor", "licensor").upper()] + reflowed[:1])), "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licences.scan(rows).collect()}
    assert [got[i] for i in range(9)] == [*names, names[0], names[0]]


def test_tokenizer_cache_gives_the_same_ids():
    coder = packing.WordTokenizer(tokenizer_path(), cache_limit=50)
    rng = random.Random(1)
    letters = list("ab'sS \tΣσéÉé̸ \x1c　中1٣-!\x85ª²ſİ\n") + ["<|startoftext|>", "'ll", "the "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + [t for t in TEXTS if t]
    whole = coder.tokenizer
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(got, coder.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("window", [7, 64, 2048])
def test_packing_is_a_gapless_partition(spark, window):
    docs = documents(spark, extra=True).repartition(3)
    pieces = packing.pack(docs, tokenizer_path(), window=window).collect()
    coder = packing.WordTokenizer(tokenizer_path())
    want = sorted((-1 if r.doc_id is None else r.doc_id, tuple([*coder.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in docs.collect())
    stream = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    at, got, run = 0, [], []
    for p in stream:
        assert p.sequence_id * window + p.offset == at and p.length > 0
        ids = np.frombuffer(p.ids, "<u4")
        assert p.start == len(run) and len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32
        run += ids.tolist()
        at += p.length
        if len(run) == p.doc_tokens:
            got.append((-1 if p.doc_id is None else p.doc_id, tuple(run)))
            run = []
    assert not run and sorted(got) == want
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0


def test_media_round_trip(spark):
    blobs = media.encode_wav(documents(spark, extra=True))
    rows = blobs.collect()
    texts = sorted((r.text or "").encode() for r in documents(spark).collect())
    assert sorted(media.read_wav(r.media)[: r.n_bytes] for r in rows) == texts
    by_text = {}
    for r in media.fingerprint(blobs).collect():
        assert r.payload_bytes % 192 == 0 and r.payload_bytes >= max(192, r.n_bytes) and r.payload_bytes - r.n_bytes <= 192
        assert len(r.fp_time) == len(r.fp_hash) and list(r.fp_time) == sorted(r.fp_time)
        by_text.setdefault(r.payload_sha256, set()).add((r.feature, r.media_sha256, r.tail_crc32))
    assert all(len(v) == 1 for v in by_text.values())
    one = next(r for r in media.fingerprint(blobs.where("doc_id = 3")).collect())
    payload = b"one".ljust(192)
    assert one.payload_sha256 == hashlib.sha256(payload).hexdigest() and one.tail_crc32 == zlib.crc32(payload[-16:])
    with wave.open(io.BytesIO(blobs.where("doc_id = 3").first().media)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getnframes()) == (1, 1, 192)
    assert media.fingerprint(media.encode_wav(empty(spark))).count() == 0


def test_landmarks_against_loops():
    rng = np.random.default_rng(4)
    payloads = [bytes(rng.integers(0, 256, 192 * n, dtype=np.uint8)) for n in (1, 5, 2, 30)]
    tables = media.transform_tables()
    for payload, (frames, times, hashes) in zip(payloads, media.landmarks(payloads, tables), strict=True):
        x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
        whole = tables.astype(np.int64)
        n = len(x) // 96 - 1
        power = np.array([[(x[96 * t : 96 * t + 192] @ whole[:, k]) ** 2 + (x[96 * t : 96 * t + 192] @ whole[:, 96 + k]) ** 2 for k in range(96)] for t in range(n)])
        power = power.astype(np.float32)
        peaks = []
        best = power.reshape(n, 4, 24)
        for t in range(n):
            for b in range(4):
                p = best[t, b].max()
                if (t == 0 or p >= best[t - 1, b].max()) and (t == n - 1 or p > best[t + 1, b].max()):
                    peaks.append((t, 24 * b + int(best[t, b].argmax()) + 1))
        want = sorted((t1, f1 << 13 | f2 << 6 | (t2 - t1)) for i, (t1, f1) in enumerate(peaks) for t2, f2 in peaks[i + 1 : i + 4] if t2 - t1 <= 63)
        assert frames == n and list(zip(times.tolist(), hashes.tolist(), strict=True)) == want
        assert media.landmarks([payload], tables)[0][2].tolist() == hashes.tolist()


ARTICLE = "<article><header><h1>A &amp; B</h1><p class=byline>by C</p></header><p>First   para\ngraph.<p>Sec&#111;nd <b>bold</b><br>line</article>"
PAGE = f"""<html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p {{}}</style></head><body class="no-sidebar">
<header><h1>Site</h1></header><nav><a href=x>Home</a></nav><!-- <p>gone</p> --><div class="cookie-notice">We use cookies</div>{ARTICLE}
<aside>Side</aside><div id=comments><article class=comment><p>Nice!</p></article></div><form><p>Sign up</form><footer>&copy; x</footer></body></html>"""


def test_html_article():
    assert html_text.main_text(PAGE)[0] == "A & B\nFirst para graph.\nSecond bold\nline"
    long_a, long_b = "This is the first paragraph of a story. " * 5, "And the second one, which also goes on. " * 5
    plain = f"<body><div class=menu><a href=a>One</a></div><ul><li><a href=b>Two</a><li><a href=c>Three</a></ul><div><p>{long_a}<p>{long_b}<p>End.</div><div class='ad-box'>Buy</div></body>"
    assert html_text.main_text(plain)[0] == f"{long_a.strip()}\n{long_b.strip()}\nEnd."
    for page, text in [(None, ""), ("", ""), ("no markup < here", "no markup < here"), ("<script>x", ""), ("<!-- open <p>x", ""), ("<p>a&nbsp; b", "a b"), ("<article></article>", "")]:
        assert html_text.main_text(page)[0] == text


def test_html_body_beside_an_article_card():
    body = [("A body in plain divs that goes on for a while. " * 4 + f"Part {i}.") for i in range(4)]
    divs = "".join(f"<div>{t}</div>" for t in body)
    card = "<article><h3>Card</h3><p>Another story of the day</p></article>"
    for before, after in [("<aside>", "</aside>"), ("<nav>", "</nav>"), ("<div class=sidebar>", "</div>")]:
        assert html_text.main_text(f"<body>{divs}{before}{card}{after}</body>")[0] == "\n".join(body)
    assert html_text.main_text(f"<body>{divs}{card}</body>")[0] == "\n".join([*body, "Card", "Another story of the day"])
    assert html_text.main_text(f"<body><p>Home<p>News{card}<p>End</body>")[0] == "Card\nAnother story of the day"


def test_html_names_do_not_take_the_text():
    text = [("The text of the page goes on for a while here. " * 4 + f"Part {i}.") for i in range(3)]
    inner = f'<h2 id="privacy">Privacy</h2><section id="search-algorithms"><p>{text[0]}</section><div class="legal-history"><p>{text[1]}</div><section id=notice><p>{text[2]}</section>'
    assert html_text.main_text(f"<article>{inner}<div class=related><p>Read also</div></article>")[0] == "\n".join(["Privacy", *text])
    body = "".join(f"<p>{t}" for t in text)
    for attrs in ("class='page-with-sidebar'", "class='header-fixed search'", "id=form role=search", "class=reviews"):
        page = f"<body><div {attrs}><nav>Menu</nav><div class=sidebar>Side</div><div>{body}</div></div></body>"
        assert html_text.main_text(page)[0] == "\n".join(text)
    assert html_text.main_text(f"<form><article>{body}</article><div class=cookie-notice>We use</div></form>")[0] == "\n".join(text)
    comments = f"<div class=comments>{body * 3}</div>"
    assert html_text.main_text(f"<body><div>{body}</div>{comments}</body>")[0] == "\n".join(text)


def test_surge_and_dive():
    weight = np.array([0, 3, 0, 0, 0, 50, 60, 0, 0, 70, 0, 0, 0, 4])
    assert html_text.regions(weight) == [(5, 10)]
    assert html_text.regions(np.zeros(0)) == [] and html_text.regions(np.zeros(3)) == []


def slow_main_text(lines):
    """The distribution line by line, over (text, linked characters, in the article, void) of each line."""
    n = len(lines)
    length = [0 if void else len(t) if len(t) >= 40 and t[-1] in ".!?" else max(0, len(t) - 2 * linked) for t, linked, _, void in lines]
    has_article = any(inside and not void for _, _, inside, void in lines)

    def after(weights, i):
        return sum(weights[j] for j in (i, i + 1, i + 2) if j < n)

    def in_text(weights, i, surge):
        """Whether line i lies between lines with weight of one stretch that has no dive but a surge."""
        left, right = i, i
        if not after(weights, i):
            return False
        while left > 0 and after(weights, left - 1):
            left -= 1
        while right < n - 1 and after(weights, right + 1):
            right += 1
        heavy = [j for j in range(left, right + 1) if weights[j]]
        return heavy[0] <= i <= heavy[-1] and any(after(weights, j) >= surge for j in range(left, right + 1))

    if has_article:
        beside = [0 if inside else w for w, (_, _, inside, _) in zip(length, lines, strict=True)]
        length = [w if inside or in_text(beside, i, 80) else 0 for i, (w, (_, _, inside, _)) in enumerate(zip(length, lines, strict=True))]
    most = max((after(length, i) for i in range(n)), default=0)
    keep = [i for i in range(n) if most and in_text(length, i, min(80, most / 2)) and not lines[i][3]]
    return "\n".join(lines[i][0] for i in keep if length[i] or lines[i][2] or not has_article)


def test_html_against_loops():
    """Random pages, of which every other has no article or main element, against a slow version."""
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(n))
    shown = dived = 0
    for number in range(400):
        html, lines = ["<html><head><title>no</title><style>p > a { }</style></head><body>"], []
        boxes = [(rng.choice(["div", "section"]) if number % 2 else rng.choice(["article", "main", "div"]), rng.randint(0, 7)) for _ in range(rng.randint(1, 6))]
        article = any(box in ("article", "main") and n for box, n in boxes)
        for part, (box, n) in enumerate(boxes):
            inside = box in ("article", "main")
            html.append(f"<{box}>")
            for _ in range(n):
                kind, text = rng.choice(["p", "p", "h2", "link", "links", "short", "nav", "li", "script", "said"]), words(rng.randint(1, 25))
                if kind in ("link", "links", "said"):
                    for _ in range(4 if kind == "links" else 1):
                        text = words(rng.randint(1, 25)) + ("." if kind == "said" else "")
                        html.append(f"<p><a href='/x?a=1>2'>{text}</a></p>")
                        lines.append((text, len(text), inside, False))
                elif kind == "nav":
                    html.append(f"<nav><a>{text[:20]}</a><p>{text}</p></nav>")
                    if not inside and not (lines and lines[-1][3]):
                        lines.append(("", 0, inside, True))
                elif kind == "script":
                    html.append(f"<script>if (a < b) {{ '{text}' }}</script>")
                else:
                    text = text.split()[0] if kind == "short" else text
                    tag = {"short": "p"}.get(kind, kind)
                    html.append(f"<{tag} class=\"c{part}\">{text.replace(' ', ' &nbsp;', 1)}</{tag}>")
                    lines.append((text, 0, inside, False))
            html.append(f"</{box}>")
        if article and not any(inside for _, _, inside, _ in lines):
            continue  # what holds nothing but boilerplate is no article
        want = slow_main_text(lines)
        assert html_text.main_text("".join(html))[0] == want, number
        shown += want != "\n".join(t for t, _, _, void in lines if not void)
        dived += article and want != "\n".join(t for t, _, inside, void in lines if inside and not void)
    assert shown > 150 and dived > 60


def test_windows_decide_inside_articles():
    body = [f"A paragraph of the story that goes on for a while, and then a little more of it {i}." for i in range(4)]
    links = "".join(f"<p><a href=/{i}>Other story you may like {i}</a></p>" for i in range(12))
    said = [f"This whole sentence of the body is a link to its source, as number {i} of some." for i in range(4)]
    linked = "".join(f"<p><a href=/{i}>{t}</a></p>" for i, t in enumerate(said))
    paragraphs = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
    for box in ("article", "main", "div"):
        page = lambda inner: html_text.main_text(f"<body><nav><a>Home</a></nav><{box}>{inner}</{box}></body>")[0]  # noqa: B023,E731
        assert page(paragraphs(body) + links) == "\n".join(body)
        assert page(links + paragraphs(body)) == "\n".join(body)
        assert page(paragraphs(body[:2]) + links + paragraphs(body[2:])) == "\n".join(body)
        assert page(paragraphs(body[:2]) + linked + paragraphs(body[2:])) == "\n".join([*body[:2], *said, *body[2:]])
        assert page(paragraphs(body[:2]) + "<h3>Why</h3><h4>So</h4><p>Yes.</p><p>No.</p>" + paragraphs(body[2:])) == "\n".join([*body[:2], "Why", "So", "Yes.", "No.", *body[2:]])
        assert page("<h1><a href=/>The title</a></h1>" + paragraphs(body) + "<p>End.</p>") == "\n".join(["The title", *body, "End."])
        assert page(paragraphs(body[:2]) + "<p><a>See this</a></p>" + paragraphs(body[2:])) == "\n".join([*body[:2], "See this", *body[2:]])
        assert page("<p>Short.</p><p>Page.</p>") == "Short.\nPage."
        assert page(paragraphs(body[:2]) + "<div class=ad><p>Buy<p>now<p>or never<p>ever</div><p>End.</p>") == "\n".join([*body[:2], "End."])
    assert html_text.main_text(f"<p><a>one</a></p>{links}")[0] == ""


@pytest.mark.parametrize("bad", ["<a b=\"x\" c='", "<script ", "<select>", "<span></b>", "<div class=ad>", "<", "<!--", "<a b=", "<td><tr>", "<svg>", "<article><header><p>"])
def test_html_time_grows_with_the_length(bad):
    def seconds(n):
        began = time.process_time()
        html_text.main_text("<p>x</p>" + bad * (n // len(bad)))
        return time.process_time() - began

    assert seconds(1_000_000) < 6  # a scan for each mark would take hours


def test_html_broken_marks():
    for page, want in {
        "<p>one</p><p class=it's>two</p><p>don't</p>": "one\ntwo\ndon't",
        "<p>1 < 2</p><p title='a > b'>x</p>": "1 < 2\nx",
        "<p>a</p><p title=\"open>b</p>": "a\nb",
        "<p>a</p><svg viewBox='0 0 1 1'/><p>b</p>": "a\nb",
        "<p>a</p><!-- <p>gone</p>": "a",
        "<p>a</p><script>gone": "a",
        "<p>a</p><select><option>gone</option>": "a",
    }.items():
        assert html_text.main_text(page)[0] == want, page


def test_html_rows(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "<p>" + "z" * 300_000, "t")], "page_id long, url string, html string, text string")
    got = sorted(html_text.extract(rows).collect(), key=lambda r: (r.page_id or 0, r.n_chars))
    assert [r.n_chars for r in got] == [300_000, len(html_text.main_text(PAGE)[0]), len(html_text.main_text(PAGE)[0]), 0]
    assert html_text.extract(rows.where("page_id = 99")).count() == 0


def labelled(n=240):
    rng = random.Random(2)
    words = {"en": "the and that with from this have which".split(), "de": "der und nicht mit auch eine über schön".split()}
    rows = []
    for i in range(n):
        lang = "en" if i % 2 else "de"
        body = [rng.choice(words[lang]) for _ in range(rng.randint(20, 60))]
        bad = i % 5 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in body), lang, "s", None, int(not bad)))
    return rows


def test_language(spark):
    rows = [r[:5] for r in labelled()] + [(1000, None, "en", None, 1), (1001, "12 !?", "de", None, 1), (1002, "", None, None, None), (None, "the and that with", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit(1), "held_out": F.lit(2)})
    got = langid.identify(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by[None].lang_pred == "en"
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert np.mean([by[r.doc_id].lang_pred == rows[r.doc_id][2] for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    nothing = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert langid.identify(empty(spark)).count() == 0


def test_language_tables_equal_the_network():
    model = langid.train([(r[1], r[2]) for r in labelled(60)], steps=10)
    x = np.concatenate([langid.windows(langid.as_bytes(r[1] * 4), model.classes) for r in labelled(6)])
    seen, pooled = model.vectors[x], []
    for w, f, o in zip(langid.WIDTHS, model.filters, model.offsets, strict=True):
        patches = np.lib.stride_tricks.sliding_window_view(seen, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), langid.WINDOW - w + 1, -1)
        pooled.append((patches @ f + o).max(axis=1))
    logits = np.maximum(np.hstack(pooled), 0) @ model.out + model.out_offset
    want = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(langid.Scorer(model).windows(x), want, atol=1e-4)


def test_language_gradients():
    """Each gradient against differences of the loss."""
    rng = np.random.default_rng(4)
    p = langid.initial(3, rng)
    x, y = rng.integers(0, langid.CLASSES, (5, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, grad = langid.gradients(p, x, y)
    for name, g in grad.items():
        for at in zip(*np.unravel_index(np.argsort(-np.abs(g), axis=None)[:6], g.shape), strict=True):
            up, down = ({**p, name: p[name] + d * (np.indices(g.shape).T == at).all(-1).T} for d in (1e-5, -1e-5))
            assert np.isclose(g[at], (langid.gradients(up, x, y)[0] - langid.gradients(down, x, y)[0]) / 2e-5, rtol=1e-3, atol=1e-6), name


def test_classifiers_see_whole_texts_and_one_row_of_an_id(spark):
    rows = [r[:5] for r in labelled(60)]
    tail = [(2000 + i, "1 " * 640 + ("und nicht der die " if i % 2 else "the and that with ") * 30, "de" if i % 2 else "en", "s", None) for i in range(40)]
    many = [(rows[1][0], f"{rows[1][1]} {i}", rows[1][2], "s", None) for i in range(300)]
    docs = spark.createDataFrame(rows + tail + many, DOCS).withColumns({c: F.lit(1) for c in ("sample_id", "n", "quality", "row", "index", "value")})
    labels = spark.createDataFrame([(r[0], int(r[2] == "en")) for r in rows + tail + many], "doc_id long, quality int").withColumn("text", F.lit("x"))
    model = quality.fit(docs, labels)
    want = quality.train([(*quality.examples([t.encode()])[0], int(lang == "en")) for i, t, lang in quality_sample(rows + tail + many)], None)
    assert np.allclose(model[0], want[0], atol=1e-5) and np.isclose(model[1], want[1], atol=1e-5)
    assert quality.fit(docs, labels, sample_features=10)[1] == 0.0
    assert langid.fit(docs).languages == sorted({r[2] for r in rows + tail}) and langid.fit(docs, sample_bytes=1).languages == []
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert all(got[i] == lang for i, _, lang, *_ in tail)


def quality_sample(rows):
    """One text of each id outside the held-out fold, in the order of the fit."""
    one = {}
    for i, text, lang, *_ in rows:
        if zlib.crc32(str(i).encode()) % 5:
            one[i] = min(one.get(i, (text, lang)), (text, lang))
    return [(i, *one[i]) for i in sorted(one, key=lambda i: (zlib.crc32(str(i).encode()), i))]


def quality_rows(rows):
    return [(*e, r[5]) for e, r in zip(quality.examples([r[1].encode() for r in rows]), rows, strict=True)]


def test_quality_training_against_loops():
    """Leader-following by dictionaries, coordinate by coordinate."""
    data = quality_rows(labelled(40))
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1 and i != 1 << quality.BITS:
            return 0.0
        return (math.copysign(quality.L1, z.get(i, 0.0)) * (z.get(i, 0.0) != 0) - z.get(i, 0.0)) / ((quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    for _ in range(2):
        for index, value, label in data:
            w = {int(i): weight(int(i)) for i in index}
            p = 1 / (1 + math.exp(-sum(w[int(i)] * float(v) for i, v in zip(index, value, strict=True))))
            for i, v in zip(index.tolist(), value.tolist(), strict=True):
                g = (p - label) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    weights, bias = quality.train(data, epochs=2)
    assert np.isclose(bias, weight(1 << quality.BITS), atol=1e-6)
    assert all(np.isclose(weights[i], weight(i), atol=1e-6) for i in z if i != 1 << quality.BITS) and np.count_nonzero(weights) == sum(weight(i) != 0 for i in z if i != 1 << quality.BITS)
    index, value, _ = data[0]
    logit = bias + sum(float(weights[i]) * float(v) for i, v in zip(index[:-1], value[:-1], strict=True))
    assert np.isclose(quality.score_texts([labelled(40)[0][1].encode()], weights, bias)[0], 1 / (1 + math.exp(-logit)), atol=1e-6)


def test_quality(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:5] for r in rows] + [(1000, None, None, None, None), (1001, "", None, None, None), (None, "x", None, None, None)], DOCS).withColumn("quality", F.lit(9))
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows] + [(0, 0, 0), (7777, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows) + 3
    assert all(got[r[0]].predicted == r[5] for r in rows if got[r[0]].held_out)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    kept = quality.filter_rows(docs, quality.fit(docs, labels), 0.3, ("doc_id", "text", "lang", "source", "n_chars"))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 1}
    assert quality.classify(empty(spark), labels).count() == 0
    assert quality.classify(docs, labels.where("doc_id < 0")).where("score = 0.5").count() == len(rows) + 3


def test_quality_scores_do_not_depend_on_the_batch():
    raws = [(r[1]).encode() for r in labelled(30)] + [b"", b"word " * 900_000]
    model = quality.train(quality_rows(labelled(60)))
    together = quality.score_texts(raws, *model)
    assert np.allclose(together, [quality.score_texts([r], *model)[0] for r in raws])


def test_quality_pairs_reach_across_segments(monkeypatch):
    """A text has the same features however it is cut into segments."""
    from normlens.llm import common

    rng = random.Random(4)
    texts = [rng.choice(["", " "]).join(rng.choice(["Go", "go", "NOW", "12", "!!", "é", " ", "\n"]) + rng.choice(["", " ", "  "]) for _ in range(n)).encode() for n in (0, 3, 40, 400)]
    whole = quality.weighted(texts)
    for size in (5, 17, 90):
        monkeypatch.setattr(quality, "SEGMENT", size)
        monkeypatch.setattr(quality, "segments", lambda raw, size=size: common.segments(raw, size))
        assert all(np.array_equal(a, b) for a, b in zip(quality.weighted(texts), whole, strict=True))


def test_only_letters_have_a_language(spark):
    assert not any(map(langid.has_letter, ["", "½ ² 3", "①②", "12 !?", "_", "\u0301", "٣٤"])) and all(map(langid.has_letter, ["a", "½ x", "ª", "日本", "é1"]))
    docs = documents(spark, [f"der und nicht mit {i}" for i in range(20)] + ["½ ² 3", "①"])
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert got[20].lang_pred == got[21].lang_pred == "und" and got[20].score == 0


def test_word_hashes_against_split():
    import re

    rng = random.Random(3)
    raws = ["".join(rng.choice("ab \t\n\x0b\x0c\r\x00\x1f é") for _ in range(rng.randint(0, 60))).encode() for _ in range(300)] + [LONG.encode() * 6, b""]
    hashes, counts = word_hashes(raws)
    words = [re.findall(WORD.encode(), r) for r in raws]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    seen = {}
    for w, h in zip(flat, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert b"".join(segments(raws[-2], 1000)) == raws[-2]


def test_workers_give_back_what_other_operators_kept():
    import pyarrow as pa

    from normlens.llm import common

    dropped = []
    common.keep_between_tasks("packing", lambda: dropped.append("packing"))
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c" * 100])], names=["text"])
    assert sum(b.num_rows for b in common.row_batches([batch], 50, owner="packing")) == 3 and not dropped
    assert [b.num_rows for b in common.row_batches([batch, batch.slice(0, 0)], 50)] == [1, 1, 1] and dropped == ["packing"]
    common.give_back()
    assert dropped == ["packing"]
