import hashlib
import struct
import zlib

import numpy as np
import pytest

from velora.llm import html_text, media, url_filter

# HTML


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("no markup at all, but the words of a text that is long enough to be one", "no markup at all, but the words of a text that is long enough to be one"),
        ("<article><h1>Title</h1><p>One &amp; two&nbsp;\n three</p><p>Be.</p></article><footer>f</footer>", "Title\nOne & two three\nBe."),
        ("<body><nav><a href=x>Home</a></nav><main><p>Text<b>bold</b>er</p><aside>side</aside><ul><li>a<li>b</ul></main></body>", "Textbolder\na\nb"),
        ("<article><script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes<p>again", "yes\nagain"),
        ("<article><p title='a>b'>in</p><form><p>out</p></form><div class='comments'><p>out</p></div><div class=\"adBox\">out</div></article>", "in"),
        ("<article><header><h1>Kept</h1></header><p>x</p><footer>out</footer></article><header>out</header>", "Kept\nx"),
        ("<div class='cookie-notice'>We use cookies</div><div><p>This is the first of the long paragraphs that we have in the text and it is good.</p><p>Short one.</p></div><div><a href=1>One link that is long enough to count as</a> <a href=2>another link</a></div>", "This is the first of the long paragraphs that we have in the text and it is good.\nShort one."),
        ("<article>a<br>b<br><br>c</article>", "a b\nc"),
        ("<article><p>cut off <b", "cut off"),
        ("<article><p>1 < 2 &lt; 3 &#x41;</p>", "1 < 2 < 3 A"),
        ("<article><p>Buy <span class='advert'>AD <b>now</b></span> now <span hidden>no</span><i class=x>yes</i></p></article>", "Buy now yes"),
        ("<article><p>First of all.</p><p><a href=x>A paragraph that is one link and long enough to be decided</a></p><p>Last.</p></article>", "First of all.\nA paragraph that is one link and long enough to be decided\nLast."),
        ("<article><div class='post-header'><h1>Title</h1></div><p class='foot-note'>Note</p><div class='search-results'><p>Found</p></div><div class='related-posts'><p>out</p></div></article>", "Title\nNote\nFound"),
        ("<span class=ad><div>out</div>out</span><article>in<span class=ads><p>out</p></span></article>", "in"),
        ("<ul><li><div><p>a<li>b</ul>", ""),
        ("<div hidden>x</div><article><div style='display: none'>x</div><p>y</p></article>", "y"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_extract_defined_cases(spark):
    rows = [(1, "u", "<article><p>É x</p></article>", "t"), (1, "u", "<article><p>É x</p></article>", "t"), (2, None, None, None), (None, "v", "<p", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "É x", 3), (1, "u", "É x", 3), (2, None, "", 0), (None, "v", "", 0)], key=str)
    assert html_text.extract(pages.limit(0)).count() == 0
    long = "<article>" + "<p>word of the text</p>" * 20_000
    assert html_text.main_text(long).count("\n") == 19_999


PROSE = "the house that was by the river and all of it is in the old town as they have said to us when we were there with you".split()


def generated(rng):
    """A page and its main text."""
    sentence = lambda n: " ".join(rng.choice(PROSE) for _ in range(n)).capitalize() + "."
    boiler = lambda: rng.choice(["<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>", "<div class='sidebar'><p>" + sentence(20) + "</p></div>", "<aside>" + sentence(9) + "</aside>", "<footer><p>" + sentence(12) + "</p></footer>", "<div id='cookie-banner'>" + sentence(15) + "</div>", "<form><label>Name</label><input></form>", "<script>if (1 < 2) { x('<p>no</p>') }</script>", "<!-- <p>no</p> -->", "<section class=comments><article><p>" + sentence(20) + "</p></article></section>", "<div class='ad-slot'>" + sentence(8) + "</div>"])
    text, body = [], []
    for _ in range(rng.randint(1, 9)):
        kind = rng.randrange(6)
        words = sentence(rng.randint(1, 60))
        if kind == 0:
            text.append(words)
            body.append(f"<h2 class='{rng.choice(['post-header', 'title', 'x'])}'>{words}</h2>")
        elif kind == 1:
            items = [sentence(rng.randint(1, 5)) for _ in range(3)]
            text += items
            body.append("<ul>" + "".join(f"<li>{x}" + rng.choice(["", "</li>"]) for x in items) + "</ul>")
        elif kind == 2:
            text.append(words + " & ü")
            body.append(f"<p>{words} <b>&amp;</b>\n <i class='foot'>&uuml;</i></p>")
        elif kind == 3:
            text.append(words)
            body.append(f"<p><a href='x'>{words}</a>")
        elif kind == 4:
            text.append(words)
            body.append(f"<div class='{rng.choice(['foot-note', 'search-results', 'reply-to', 'y'])}'><p>{words}<span class='advert'>Buy!</span></p></div>")
        else:
            body.append(boiler())
    page = "<html><body>" + "".join(boiler() for _ in range(3)) + f"<{(root := rng.choice(['article', 'main']))}>" + "".join(body) + f"</{root}>" + "".join(boiler() for _ in range(3)) + "</body></html>"
    return page, "\n".join(text)


def test_generated_pages_give_their_text():
    import random

    for seed in range(400):
        page, text = generated(random.Random(seed))
        assert html_text.main_text(page) == text, page


def test_ties_between_neighbours_and_hostile_pages():
    import time

    good = "<p>This is the first of the long paragraphs that we have in the text and it is good.</p>"
    bad = "<p><a href=1>One link that is long enough to count as one</a></p>"
    # equally near: good wins; else the nearer one
    assert html_text.main_text(good + "<p>Tie.</p>" + bad).endswith("Tie.")
    assert not html_text.main_text(good + "<p>a</p><p>b</p><p>Far.</p>" + bad).endswith("Far.")
    began = time.process_time()
    n = 30_000
    assert html_text.main_text("<div>" * n + "x") == ""
    assert html_text.main_text("<article>" + "<span>" * n + "</b>" * n + "x" + "<li>" * 10) == "x"
    assert html_text.main_text("<article>" + "<div><li>" * n + "x") == "x"
    assert len(html_text.main_text("<article>" + "<p>" + "w" * 3_000_000)) == 3_000_000
    assert html_text.main_text("<article>" + "<a href='" * n) in ("", "<a href='" * n)
    assert time.process_time() - began < 30


# Media


def test_decoders():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(b"P5 # note\n4 3\n# more\n255\n" + grey.tobytes()) == grey).all()
    rgb = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    assert (media.decode(b"P6\n3 2\n255\n" + rgb.tobytes()) == rgb).all()
    wide = np.array([[1, 500], [65535, 3]], ">u2")
    assert (media.decode(b"P5 2 2 65535\n" + wide.tobytes()) == wide).all()
    assert (media.decode(b"P4\n10 1\n" + bytes([0b10000000, 0b01000000])) == [[0, *[255] * 8, 0]]).all()
    row = lambda x: b"".join(bytes(p[::-1]) for p in x) + b"\0" * (-len(x) * 3 % 4)
    body = b"".join(row(r) for r in rgb[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 24, 0, len(body), 0, 0, 0, 0) + body
    assert (media.decode(bmp) == rgb).all()
    palette = bytes(x for k in range(4) for x in (k, 10 * k, 20 * k, 0))
    small = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + 16) + struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, 8, 0, 0, 0, 0, 4, 0) + palette + bytes([3, 1, 0, 0])
    assert (media.decode(small) == [[[60, 30, 3], [20, 10, 1]]]).all()
    # ASCII forms, and samples that don't use the whole range
    assert (media.decode(b"P1 # c\n3 2\n1 0 1\n010") == [[0, 255, 0], [255, 0, 255]]).all()
    assert (media.decode(b"P2\n2 1\n# c\n15\n0 15") == [[0, 255]]).all() and media.decode(b"P2\n2 1\n15\n0") is None
    assert (media.decode(b"P3\n1 1\n1\n1 0 1") == [[[255, 0, 255]]]).all()
    assert (media.decode(b"P5\n2 1\n100\n" + bytes([50, 100])) == [[128, 255]]).all()
    assert (media.decode(b"P5\n2 1\n1000\n" + struct.pack(">HH", 0, 1000)) == [[0, 65535]]).all()
    # masks, 16 bits, and small palettes
    bmp = lambda w, h, bits, packing, extra, body: b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(extra)) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, packing, 0, 0, 0, len(extra) // 4 * (bits < 16), 0) + extra + body
    assert (media.decode(bmp(1, -1, 32, 3, struct.pack("<III", 0xFF, 0xFF00, 0xFF0000), bytes([9, 8, 7, 0]))) == [[[9, 8, 7]]]).all()
    assert (media.decode(bmp(1, -1, 16, 3, struct.pack("<III", 0xF800, 0x7E0, 0x1F), struct.pack("<HH", 0xF81F, 0))) == [[[255, 0, 255]]]).all()
    assert (media.decode(bmp(2, -1, 16, 0, b"", struct.pack("<HH", 0x7FFF, 0x3E0))) == [[[255] * 3, [0, 255, 0]]]).all()
    assert (media.decode(bmp(3, -1, 1, 0, bytes([0, 0, 0, 0, 3, 2, 1, 0]), bytes([0b01000000, 0, 0, 0]))) == [[[0] * 3, [1, 2, 3], [0] * 3]]).all()
    assert (media.decode(bmp(3, -1, 4, 0, palette, bytes([0x31, 0x20, 0, 0])))[:, :, 2] == [[3, 1, 2]]).all()
    assert media.decode(bmp(1, 1, 8, 1, palette, bytes(4))) is None
    assert all(media.decode(x) is None for x in (None, b"", b"P5\n9 9\n255\nx", b"BM", b"GIF89a", b"P5\nx"))


@pytest.mark.parametrize("shape,to", [((7, 5), (3, 4)), ((8, 9), (8, 9)), ((3, 2), (8, 9)), ((24, 24), (8, 9))])
def test_area_resize_is_the_mean_of_areas(shape, to):
    x = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    fine = np.repeat(np.repeat(x.astype(float), to[0], 0), to[1], 1)
    want = fine.reshape(to[0], shape[0], to[1], shape[1]).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(x, *to), want)


def test_tiles_are_npy_files_and_come_back():
    import io

    x = np.random.default_rng(2).integers(0, 256, (50, 37)).astype(np.uint8)
    raw = media.tiles(x, 24)
    assert (media.untile(raw, 37) == x).all()
    assert (np.load(io.BytesIO(raw)) == x[:24, :24]).all()
    payload = bytes(range(256)) * 9
    assert media.payload_tiles(payload) == media.tiles(np.frombuffer(payload, np.uint8).reshape(-1, 24), 24)
    assert media.untile(media.payload_tiles(payload), 24).tobytes() == payload


def test_store_and_features(spark):
    rows = [(1, "abc", 1), (1, "abc", 1), (2, None, 1), (3, "", 1), (None, "é" * 288, 1), (5, "x" * 200_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media int")
    got = media.features(media.store_texts(docs)).collect()
    for r in got:
        text = next((t or "").encode() for i, t, _ in rows if i == r.doc_id)
        payload = text + b"\xff" * (576 if not text else -len(text) % 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes == len(payload) // 576 * 704 and len(r.feature) == 16
    assert len(got) == 6 and media.features(media.store_texts(docs.limit(0))).count() == 0


def test_image_column(spark):
    files = spark.createDataFrame([(1, bytearray(media.encode_pgm(np.eye(30, dtype=np.uint8)))), (2, bytearray(b"none")), (3, None)], "id long, file binary")
    got = {r.id: r for r in media.decode_images(files, "file", "id", side=16).collect()}
    assert (got[1].height, got[1].width, got[1].channels) == (30, 30, 1) and got[2].height is None and got[3].tiles is None
    assert (media.untile(bytes(got[1].tiles), 30) == np.eye(30)).all()


# URLs


def test_url_parts_rules_and_reputation(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://example.com/de/", "https://notexample.com/de/", "http://x.org/fr/1", "http://x.org/es/1", "x.net/", None, "http://net", "http://net/", "ftp://b.net?x=/en/", "://h#p/a", "http://É.NET/en/"]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, none).collect()}
    assert got == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        1: ("example.com", "/de/", "example.com/de/", "block"),
        2: ("notexample.com", "/de/", None, "allow"),
        3: ("x.org", "/fr/1", "org/fr/", "allow"),
        4: ("x.org", "/es/1", None, "allow"),
        5: ("", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("net", "", None, "allow"),
        8: ("net", "/", "net/", "block"),
        9: ("b.net", "", None, "allow"),
        10: ("h", "", None, "allow"),
        11: ("É.net", "/en/", "net/", "block"),
    }
    assert url_filter.judge(pages.limit(0), none).count() == 0


def test_levels_of_hosts(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.com:80": ("y.com", "com"), "me@x.org": ("x.org", "org"), "10.0.0.1:8": ("10.0.0.1", "ip"), "[::1]": ("[::1]", "ip"), "net": ("net", "net"), "": ("", ""), "w.discom.de": ("discom.de", "de"), "l" * 100_000 + ".a.b": ("a.b", "b")}
    frame = spark.createDataFrame([(h,) for h in hosts], "host string").withColumns(url_filter.levels(url_filter.F.col("host")))
    assert {r.host: (r.domain, r.suffix) for r in frame.collect()} == hosts


def test_bad_hosts_are_blocked_only_with_evidence(spark):
    rows = [(k, f"http://bad.spam.com/{k}") for k in range(60)] + [(100 + k, f"http://good.fine.com/{k}") for k in range(60)] + [(200, "http://few.odd.com/1"), (201, "http://bad.spam.com/new"), (201, "http://bad.spam.com/new")]
    outcomes = [(k, 0) for k in range(60)] + [(100 + k, 1) for k in range(60)] + [(200, 0), (999, 0), (100, None), (101, 7)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good int")).collect()
    verdicts = {(r.host, r.verdict) for r in got}
    assert verdicts == {("bad.spam.com", "block"), ("good.fine.com", "allow"), ("few.odd.com", "allow")}
    assert len(got) == len(rows)
