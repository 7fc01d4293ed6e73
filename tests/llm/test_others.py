"""Mixing, chats, pages, urls, leaks and neighbours on small cases: brute force, hand-marked pages, and odd tables."""

import hashlib

import numpy as np
import pytest

from solaraddr.llm import ann, html, leaks, urls
from solaraddr.llm.ann import HELD, LEAF_ROWS, nearest
from solaraddr.llm.chat import format_chats
from solaraddr.llm.html import extract_text, main_text
from solaraddr.llm.leaks import index_items, leaks_in, mark_leaks
from solaraddr.llm.mixing import mix, mixed_documents
from solaraddr.llm.urls import filter_urls


def words(begin, end):
    return " ".join(hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(begin, end))


def test_mix(corpus):
    df, texts = corpus
    rows = mix(df).collect()
    assert len(rows) == len(texts) + 1
    assert all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in rows)
    assert mix(df.where("doc_id < 0")).count() == 0


def test_mix_carries_clashing_columns(corpus):
    df, _ = corpus
    odd = df.selectExpr("*", "1 AS whole", "2 AS cut", "3 AS _s", "4 AS copies")
    rows = mixed_documents(odd).collect()
    assert rows and all(r.whole == 1 and r.cut == 2 and r._s == 3 and r.copies > 0 for r in rows)


def test_chats(spark):
    turns = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (None, 0, None, None), (2, 1, "assistant", "b")]
    turns += [(4, 0, "user", "long " * 50_000), (4, 1, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS k", "2 AS n_turns")
    rows = {r.conv_id: r for r in format_chats(df).collect()}
    assert set(rows) == {2, 4, None}
    assert rows[2].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert format_chats(df.where("conv_id < 0")).count() == 0


PROSE = "It was not the first time that they had been there, and it would not be the last of the days on which all of them came to see what was left of it. "
PAGES = {
    "A & B\nOne two\nThree": "<html><nav><a href='/'>Home</a></nav><div class='cookie-notice'>Take it</div><article><h1>A &amp; B</h1><p>One<br>two<p>Three</article><div id=comments><p>No</div><footer>c</footer>",
    "News\nShort.\nSee the full report of the day": "<article><h2>News</h2><p>Short.</p><p>See <a href=x>the full report of the day</a></p></article>",
    "Title\nUp by 3 %": "<article><div class='entry-header'><h1>Title</h1></div><p class='share-price'>Up by 3 %</p></article>",
    f"T\n{PROSE.strip()}": f"<article><h1>T</h1><p>{PROSE}</p><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><p class=advert>Buy now</p></article>",
    (PROSE * 2).strip(): f"<div><a>Home</a> <a>News</a></div><p>{PROSE * 2}</p><div class='related-posts'><p>{PROSE}</p></div><form>Find <input></form>",
    "a < b\nsecond": "<main>a &lt; b<script>var x = '<p>no</p>'</script><style>p{}</style><p>second</main>",
    f"{PROSE.strip()}\nkept": f"<article><p>{PROSE}<div hidden>secret</div><p>kept<aside>side</aside><section class='reader-comments'><p>{PROSE}</section>",
}


@pytest.mark.parametrize("text", PAGES)
def test_pages(text):
    assert main_text(PAGES[text]) == text


def test_no_page_is_no_text():
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("<article>" + "<p>x " * 20_000) == "\n".join(["x"] * 20_000)
    assert main_text(f"<p>{PROSE * 2}" + "<p><a>x</a>" * 20_000) == (PROSE * 2).strip()


def plain_labels(blocks):
    """Both passes as they are stated: densities of each block, runs of links, then the nearest decided block."""
    words = lambda b: b.text.lower().split()
    stops = lambda w: sum(x in html._STOP for x in w) / max(1, len(w))
    linky = lambda b: b.linked > 0.33 * max(1, len(b.text))
    listed = stops([w for b in blocks if len(b.text) >= 70 and not linky(b) for w in words(b)]) >= 0.12 or not any(len(b.text) >= 70 and not linky(b) and words(b) for b in blocks)
    first = []
    for i, b in enumerate(blocks):
        low = high = i
        menu = lambda c: linky(c) and len(c.text) < 70
        if menu(b):
            while low and menu(blocks[low - 1]):
                low -= 1
            while high + 1 < len(blocks) and menu(blocks[high + 1]):
                high += 1
        n, foreign = len(b.text), 2 * sum(c > "\u024f" for c in b.text if c.isalpha()) > sum(c.isalpha() for c in b.text)
        if menu(b) and high - low >= 2 or b.marked and (linky(b) or n < 70 or stops(words(b)) < 0.16):
            first.append(0)
        elif b.inside:
            first.append(1 if n >= 70 and not linky(b) else None)
        elif linky(b) or n < 200 and "©" in b.text or n < 70 and b.linked:
            first.append(0)
        elif n < 70:
            first.append(None)
        elif foreign or not listed:
            first.append(1 if n >= 200 else None)
        else:
            first.append(1 if stops(words(b)) >= 0.16 and n >= 200 else None if stops(words(b)) >= 0.08 else 0)
    votes = [j for j, x in enumerate(first) if x is not None and not (x == 0 and not blocks[j].inside and len(blocks[j].text) < 200 and "©" in blocks[j].text)]
    out = []
    for i, x in enumerate(first):
        if x is None:
            part = max([j for j in range(i + 1) if blocks[j].heading], default=0)
            before, after = max([j for j in votes if j < i], default=None), min([j for j in votes if j > i], default=None)
            if before is not None and before < part and after is not None:
                before = None
            near = sorted((abs(i - j), -first[j]) for j in (before, after) if j is not None)
            x = 1 if 1 not in first or not near else -near[0][1]
        out.append(bool(x))
    return out


def test_both_passes_against_brute_force():
    rng = np.random.default_rng(3)
    texts = ("the of ", "zz yy ", "это слово ", "© 2026 ", "la de que ")
    for _ in range(600):
        blocks = [
            html.Block((texts[rng.integers(len(texts))] * int(rng.integers(1, 60))).strip(), int(rng.integers(0, 2)) * int(rng.integers(0, 300)), bool(rng.random() < 0.2), rng.random() < 0.1, rng.random() < 0.2)
            for _ in range(int(rng.integers(1, 12)))
        ]
        assert html.labels_of(blocks) == plain_labels(blocks)


JAPANESE, RUSSIAN = "これは記事の本文であり、長い段落なので残すべきものです。" * 8, "Это длинный абзац, который должен остаться на странице целиком. " * 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div><a href=x>ホーム</a></div><h1>題</h1><p>{JAPANESE}</p><p>終わり。</p>", f"題\n{JAPANESE}\n終わり。"),
        (f"<ul><li><a>Раз</a><li><a>Два</a><li><a>Три</a></ul><p>{RUSSIAN}</p><p>Конец.</p>", f"{RUSSIAN.strip()}\nКонец."),
        ("<div><aside><p>ad</div><div><p>prose</p></div>", "prose"),
        ("<article><p>one</p><div>x<nav>menu</div><p>two</p></article>", "one\nx\ntwo"),
        ('<article><p>a</p><script src="a.js"/>var leak=1;</script><p>b</p></article>', "a\nb"),
        ("<ul><li hidden>no<li>yes</ul>", "yes"),
        ("<div><nav><ul><li>menu</ul></nav></div></div></p><p>after stray ends</p>", "after stray ends"),
        (f"<div><a>A</a></div><div><a>B</a></div><div><a>C</a></div><h1>Title</h1><p>Short.</p><p>{PROSE * 2}</p><div>© 2026 Site</div>", f"Title\nShort.\n{(PROSE * 2).strip()}"),
    ],
)
def test_pages_by_densities(page, text):
    """Other languages, elements that are not closed, slashes that mean nothing, and pages without article, nav and footer."""
    assert main_text(page) == text


def test_extract_keeps_columns(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", "own"), (1, "<p>x</p>", "own"), (None, None, None)], "page_id long, html string, marked string")
    assert sorted(((r.page_id or 0, r.text, r.marked or "") for r in extract_text(df).collect())) == [(0, "", ""), (1, "x", "own"), (1, "x", "own")]
    assert extract_text(df.where("page_id > 5")).count() == 0


def test_urls(spark):
    given = ["http://A.net/x?q", "http://b.example.net/en/1", "https://org/fr/", "nothing", None, "http://x.example.com/de/1#t", "http://y.com", "", "http://z.org/" + "long/" * 20_000]
    rows = filter_urls(spark.createDataFrame([*enumerate(given), (0, given[0])], "page_id long, url string").selectExpr("*", "1 AS score", "2 AS rule")).collect()
    assert len(rows) == len(given) + 1
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1][2:] == ("example.net/en/", "allow")
    assert got[2][2:] == ("org/fr/", "allow") and got[5][2:] == ("example.com/de/", "block")
    assert got[3][:3] == got[4][:3] == got[7][:3] == ("", "", None)
    assert filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_against_brute_force(spark):
    good, bad = [f"http://site{i}.com/news/{i}" for i in range(30)], [f"http://spam{i}.biz/win?c={i}" for i in range(30)]
    model = urls.as_model(urls.fit_counts(spark.createDataFrame([(u, False) for u in good] + [(u, True) for u in bad], "url string, rejected boolean")).toPandas())

    def log_p(url, known):
        t, total = url.encode() + b"\0", 0.0
        padded = [(b"\0" * 0 + u.encode() + b"\0") for u in known]
        for i in range(len(t)):
            p = 1 / 256
            for k in range(urls.ORDER + 1):
                context, whole = t[max(0, i - k) : i], i < k
                at = [(u, j) for u in padded for j in range(len(u)) if (j < k) == whole and u[max(0, j - k) : j] == context and (not whole or j == i)]
                p = (sum(u[j] == t[i] for u, j in at) + 2 * p) / (len(at) + 2)
            total += np.log(p)
        return total / len(t)

    for url in ("http://site77.com/news/77", "http://spam77.biz/win?c=77"):
        assert urls.log_ratio(model, [url])[0] == pytest.approx(log_p(url, bad) - log_p(url, good), abs=1e-9)
    # held-out urls of both kinds are told apart
    scores = urls.log_ratio(model, [f"http://site{i}.com/news/{i}" for i in range(50, 60)] + [f"http://spam{i}.biz/win?c={i}" for i in range(50, 60)])
    assert (scores[:10] < 0).all() and (scores[10:] > 0).all()


def test_url_verdicts_do_not_depend_on_the_size_of_the_model(spark):
    given = [f"http://site{i}.org/fr/{i}" for i in range(40)] + [f"https://ads{i}.net/win?c={i}" for i in range(40)] + [f"ftp://other{i}.com/p{i}/" for i in range(60)]
    given += ["http://a.com/" + "x" * 30_000, "", None, "no scheme", "http://\u00fc.de/\u65e5\u672c", *(["http://hot.com/"] * 50)]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    sent, joined = (sorted(map(tuple, filter_urls(pages, most=most).collect())) for most in (urls.MODEL_GRAMS, 0))
    assert len(sent) == len(given) and sent == joined


def test_urls_of_no_rule_leave_verdicts_alone(spark):
    given = [f"http://site{i}.org/fr/{i}" for i in range(40)] + [f"https://ads{i}.net/win?c={i}" for i in range(40)] + [f"ftp://other{i}.com/p{i}/" for i in range(20)]
    few = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    many = spark.createDataFrame(list(enumerate(given + [f"http://unrelated{i}.io/{i * 7919}" for i in range(3000)])), "page_id long, url string")
    assert sorted(map(tuple, filter_urls(few).collect())) == sorted(map(tuple, filter_urls(many).where(f"page_id < {len(given)}").collect()))


def test_url_verdicts_against_brute_force(spark):
    """Counts by dictionaries, every threshold between the bins tried, host, path and rule by hand."""
    given = [f"http://Site{i % 23}.ORG/fr/{i}" for i in range(90)] + [f"https://ads{i % 17}.net/win{i}?c={i}" for i in range(90)] + [f"http://x{i}.com/news/{i}" for i in range(30)]
    given += [f"http://x{i}.com/win{i}?c=1" for i in range(30)] + ["http://example.net/en/x", "http://example.net/de/x", "http://sub.example.com/de/?q", "a.net/", "http://notnet/", None]
    rows = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    folds = {r.url: r.fold for r in rows.selectExpr("url", "pmod(xxhash64(url), 5) = 0 AS fold").distinct().collect()}

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].lower(), rest[cut:]
        return host, rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]

    def rule(host, path):
        fitting = [r for _, r in urls.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return max(fitting, key=len, default=None)

    verdict = {r: v for v, r in urls.RULES}
    known = [(u, verdict[rule(*parts(u))] == "block") for u in given if rule(*parts(u))]
    counts = {}
    for u, bad in known:
        if not folds[u]:
            t = u.encode() + b"\0"
            for i in range(len(t)):
                for k in range(urls.ORDER + 1):
                    context = (k, tuple(t[j] if j >= 0 else None for j in range(i - k, i)))
                    for key in (context, (context, t[i])):
                        counts[key, bad] = counts.get((key, bad), 0) + 1

    def score(u):
        t, total = (u or "").encode() + b"\0", 0.0
        for i in range(len(t)):
            logs = []
            for bad in (True, False):
                p = 1 / 256
                for k in range(urls.ORDER + 1):
                    context = (k, tuple(t[j] if j >= 0 else None for j in range(i - k, i)))
                    p = (counts.get(((context, t[i]), bad), 0) + 2 * p) / (counts.get((context, bad), 0) + 2)
                logs.append(np.log(p))
            total += logs[0] - logs[1]
        return total / len(t)

    held = [(score(u), bad) for u, bad in known if folds[u]]
    steps = [i * 2 * urls.SPAN / urls.BINS - urls.SPAN for i in range(urls.BINS + 1)]
    good, bad = [s for s, b in held if not b], [s for s, b in held if b]
    assert good and bad
    # a score falls short of a step if its bin does; the first and the last bin take what lies beyond them
    errors = [sum(s < x for s in bad) / len(bad) + sum(s >= x for s in good) / len(good) for x in steps]
    errors[0], errors[-1] = 1.0, 1.0
    best = [x for x, e in zip(steps, errors, strict=True) if e <= min(errors) + 1e-12]
    limit = best[len(best) // 2]
    found = {r.page_id: r for r in filter_urls(rows).collect()}
    for i, u in enumerate(given):
        host, path = parts(u)
        own = rule(host, path)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, own)
        assert found[i].score == pytest.approx(score(u), abs=1e-9)
        assert found[i].verdict == (verdict[own] if own else "block" if score(u) > limit else "allow")


def test_leaks():
    item = words(0, 30)
    index = index_items([7, 8], [item.encode(), b"too short"])
    found = leaks_in([f"before, {item.upper()} after".encode(), b"nothing here", b"", words(0, 27).encode(), words(0, 20).encode()], index)
    assert found[0] == [(7, 1, 30, 1.0)] and found[1] == found[2] == found[4] == []
    assert [(x[0], x[1], x[2]) for x in found[3]] == [(7, 0, 27)]


def test_leaks_against_brute_force():
    """Items with some words changed, planted in other text: all windows of similarity 0.8 or more are found."""
    rng = np.random.default_rng(11)
    items = [words(1000 * k, 1000 * k + int(n)) for k, n in enumerate(rng.integers(6, 60, 120))]
    index = index_items(list(range(len(items))), [t.encode() for t in items])
    texts = []
    for k in range(400):
        w = items[k % len(items)].split()
        for at in rng.integers(0, len(w), int(rng.integers(0, 3))):
            w[at] = f"other{k}"
        texts.append(f"{words(900_000 + 50 * k, 900_000 + 50 * k + 20)} {' '.join(w)} {words(990_000, 990_010)}")
    found = leaks_in([t.encode() for t in texts], index)
    wanted = got = 0
    for k, t in enumerate(texts):
        i = k % len(items)
        own, (grams,) = leaks.item_grams([items[i].encode()])[0], leaks.item_grams([t.encode()])
        best = max(leaks.similarity(grams[s : s + len(own)], own, index) for s in range(len(grams) - len(own) + 1))
        if best >= leaks.SIMILAR:
            wanted += 1
            got += any(x[0] == i and x[3] == pytest.approx(best) for x in found[k])
        assert all(x[3] >= leaks.SIMILAR - 1e-9 for x in found[k])
    assert wanted > 150 and got >= 0.995 * wanted


def test_the_index_finds_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(2)
    index = index_items(list(range(200)), [words(50 * k, 50 * k + 20).encode() for k in range(200)])
    (own,) = index.indexes
    prints = own.prints[rng.integers(0, 200, 500)].copy()
    for row in prints:
        for bit in rng.choice(128, int(rng.integers(0, 45)), replace=False):
            row[bit // 16] ^= np.uint16(1 << int(bit % 16))
    apart = np.array([[sum(int(x).bit_count() for x in p ^ q) for q in own.prints] for p in prints])
    row, item = own.near(prints)
    assert sorted(zip(row.tolist(), item.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(apart <= leaks.RADIUS)), strict=True))


def test_slices_do_not_change_leaks(spark, monkeypatch):
    items = spark.createDataFrame([(k, words(40 * k, 40 * k + 25)) for k in range(30)] + [(None, "x"), (99, None), (98, "")], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{words(7000, 7020)} {words(40 * k, 40 * k + 25)}", "kept") for k in range(0, 30, 3)] + [(50, None, ""), (51, "", "")], "doc_id long, text string, leaks string")
    plain = lambda df: sorted((r.doc_id, [(x.item_id, x.start, round(x.similarity, 6)) for x in sorted(r.leaks)]) for r in df.collect())
    whole = plain(mark_leaks(docs, items))
    monkeypatch.setattr(leaks, "SLICE", 7)
    assert plain(mark_leaks(docs, items)) == whole and sum(len(x) for _, x in whole) == 10
    assert mark_leaks(docs.where("doc_id < 0"), items).count() == 0
    assert all(not r.leaks for r in mark_leaks(docs, items.where("item_id < 0")).collect())


def exact(x, ids, q, k):
    s = x @ x[q]
    return [ids[j] for j in np.lexsort((ids, -s)) if j != q][:k]


@pytest.mark.parametrize("n", [1, 5, 21, 40])
def test_small_tables_are_answered_exactly(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(q, int(j)) for q in range(0, n, 20) for j in exact(x, np.arange(n), q, 20)]


def test_neighbours_at_the_registered_settings(spark):
    """Clustered vectors over several leaves: the recall holds, and a query reads a part of the rows."""
    rng = np.random.default_rng(5)
    n = 4 * LEAF_ROWS
    centres = rng.standard_normal((40, 32)) * 2
    x = centres[rng.integers(0, 40, n)] + rng.standard_normal((n, 32)) * 0.5
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [0.0] * 32), (n + 2, [float("nan")] * 32), (n + 3, [1.0]), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS leaf", "2 AS score")
    got = nearest(df, df.where("vec_id % 20 = 0")).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-9)
    hits = sum(len(found[q] & set(exact(x, np.arange(n), q, 20))) for q in range(0, n, 20))
    assert hits >= (HELD - 0.04) * 20 * len(range(0, n, 20))
    assert all(r.vec_id < n for r in got) and all(len(v) == 20 for v in found.values())
    assert nearest(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0


def test_a_query_is_sent_once_to_a_block(spark):
    """Leaves side by side share a block, so what a task makes of its queries doesn't grow with the leaves that they visit."""
    n = 4 * LEAF_ROWS
    x = np.random.default_rng(8).standard_normal((n, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id % 20 = 0"))
    assert got.count() == n

    def made(node):
        """Rows of each call of mapInPandas below a node of the plan that ran."""
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return made(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return made(node.plan())
        own = [node.metrics().apply("pythonNumRowsReceived").value()] if kind == "MapInPandasExec" else []
        return own + [r for i in range(node.children().size()) for r in made(node.children().apply(i))]

    got.collect()
    rows = made(got._jdf.queryExecution().executedPlan())
    assert 4 * n in rows  # the rows, at a leaf of each of four trees
    assert all(r <= 4 * n // 20 for r in rows if r != 4 * n), rows  # a block a tree here


@pytest.mark.parametrize("kind", ["float", "double"])
def test_small_blocks_and_ties_change_nothing(spark, monkeypatch, kind):
    """A leaf in eight blocks, queries in eight shares, and many equal products."""
    x = np.random.default_rng(2).integers(-1, 2, (400, 8)).astype(float)
    x[~x.any(axis=1)] = 1
    df = spark.createDataFrame([(i - 200, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    monkeypatch.setattr(ann, "BLOCK_BYTES", 50 * 8 * 8)
    got = nearest(df, df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(q - 200, j - 200, x[q] @ x[j]) for q in range(400) for j in exact(x, np.arange(400), q, 20)]
