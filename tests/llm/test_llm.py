"""The ten operators against brute force, round trips and held-out accuracy; edge cases of each."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import decontamination, html_extract, language_id, license_scan, line_dedup, packing, rans_io, simhash, tokens, topk, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, q string, rank int, n int"
EDGE = [(1, None, None), (2, "", "en"), (3, "the cat sat on the mat", "en"), (3, "the cat sat on the mat", "en"), (None, "le chat noir", "fr"), (4, "x " * 6000, None), (5, "1234 5678 ***", "de")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, "q", 1, 2) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_license_scan(spark, documents):
    got = {(r.doc_id, r.license) for r in license_scan.scan(documents).collect()}
    want = {(r.doc_id, k) for r in documents.collect() for k, t in license_scan.TEMPLATES.items() if t in (r.text or "")}
    assert want <= got and license_scan.collision_probability(0.5) > 0.999999
    text = "so\n" + license_scan.TEMPLATES["MIT-grant"].replace("free of charge", "free of any charge").upper() + "\nend"
    edge = license_scan.scan(docs(spark, [*EDGE, (9, text, None)])).collect()
    assert [(r.doc_id, r.license) for r in edge] == [(9, "MIT-grant")] and 0.8 <= edge[0].containment < 1
    assert license_scan.scan(docs(spark, [])).count() == 0


def _shares(text, template, shingle=3, window=6):
    """The largest share of a template's distinct shingles that any stretch of a text has, by brute force."""
    import regex

    a, b = ([tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] for w in ((regex.sub(r"[^\p{L}\p{N}]+", " ", x.lower()).strip().split(" ")) for x in (text, template)))
    size, want = len(b) + 2 * window - 2, set(b)
    return max((len(want & set(a[i : i + size])) / len(want) for i in range(max(1, len(a) - len(b)))), default=0.0)


def test_license_scan_against_brute_force(spark, documents):
    rng = np.random.default_rng(1)
    rows = [(r.doc_id, r.text, None) for r in documents.collect()[:60]]
    for k, (name, template) in enumerate(license_scan.TEMPLATES.items()):
        words = template.split()
        for i, drop in enumerate((0, 1, 3, 8)):
            own = [w for j, w in enumerate(words) if j not in set(rng.choice(len(words), min(drop, len(words) // 3), replace=False))]
            rows.append((1000 + 10 * k + i, " ".join(["some", "words", "before", *own, "and", "after"]), None))
    rows += [(None, "Released under the MIT License. Here", None), (None, "This work is licensed under a Creative Commons Attribution 4.0 International License.", None)]
    made, want = docs(spark, rows).withColumn("license", F.lit("x")), set()
    for i, t, _ in rows:
        want |= {(i, n) for n, template in license_scan.TEMPLATES.items() if _shares(t or "", template) >= 0.8}
    for limit in (200_000, 0):
        got = license_scan.scan(made, max_index=limit).collect()
        assert {(r.doc_id, r.license) for r in got} == want and len(got) == len(want) and any(r.doc_id is None for r in got)
        for r in got:
            text = next(t for i, t, _ in rows if i == r.doc_id and r.containment <= round(_shares(t or "", license_scan.TEMPLATES[r.license]), 6))
            assert r.first_word < len(text.split())


def test_language_id(spark, documents):
    got = language_id.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    model = language_id.fit([("en", "the cat sat on the mat and the dog") for _ in range(20)] + [("fr", "le chat noir est dans la maison") for _ in range(20)])
    out = {r.doc_id: r for r in language_id.predict(docs(spark, EDGE), model).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[5].lang_pred == "und" and out[3].lang_pred == "en" and out[None].lang_pred == "fr"
    runs = language_id.segments(docs(spark, [(1, "the cat and the dog le chat noir est dans", None)]), model).collect()
    assert [r.lang for r in runs] == ["en", "fr"]
    assert {r.lang_pred for r in language_id.identify(docs(spark, [(1, "abc", None)])).collect()} == {"und"}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    crf = language_id.Crf(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    pot, types, lengths = rng.normal(size=(5, 3)), np.asarray([0, 1, 2, 3, 4, 1]), np.asarray([4, 0, 2])
    got, at = crf.marginals(pot, types, lengths), 0
    for n in lengths:
        want, paths = np.zeros((n, 3)), np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n) if n else []
        for p in paths:
            s = crf.start[p[0]] + sum(pot[types[at + i], p[i]] for i in range(n)) + sum(crf.trans[p[i], p[i + 1]] for i in range(n - 1))
            want[np.arange(n), p] += np.exp(s)
        assert n == 0 or np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def test_decontamination(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(documents, bench).collect()}
    want = {(r.doc_id, b.item_id) for b in bench.collect() for r in documents.collect() if b.text in (r.text or "")}
    assert want <= got and len(got - want) <= 0.1 * len(want) + 1
    item = spark.createDataFrame([(7, "Anna buys 12 apples for 3 dollars and then gives 12 apples away to a friend"), (8, None), (9, "two words")], "item_id long, text string")
    made = docs(spark, [*EDGE, (20, "Well: Maria buys 95 apples for 7 dollars and then gives 95 apples away to a friend. Yes.", None), (21, "Maria buys 95 apples for 7 dollars and then gives 11 apples away to a friend", None), (22, "only two words here", None)])
    out = {(r.doc_id, r.item_id): r.slot_consistency for r in decontamination.contaminated(made, item, consistency=0.0).collect()}
    assert out[(20, 7)] == 1.0 and out[(21, 7)] < 1.0 and (22, 9) in out and len(out) == 3
    assert decontamination.contaminated(docs(spark, []), item).count() == 0


def _brute_similarity(item, doc, window=5):
    """Share of the item's windows on any alignment with a window that has a literal; names in a row are one token."""
    a, b = ([("<number>" if x[0].isdigit() else "<name>" if x[0].isupper() else x) for x in t.split()] for t in (item, doc))
    a, b = ([x for x, y in zip(t, [None, *t]) if not x == y == "<name>"] for t in (a, b))
    windows = range(len(a) - window + 1)
    found = set()
    for d in range(-len(a), len(b)):
        on = [q for q in windows if q + d >= 0 and b[q + d : q + d + window] == a[q : q + window]]
        if any(x[0] != "<" for q in on for x in a[q : q + window]):
            found.update(on)
    return round(len(found) / len(windows), 6)


def test_decontamination_of_inserted_and_deleted_words(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("bcdfglmnst"), 6))
    bench, made, want = [], [], {}
    for k, size in enumerate((38, 59, 200, 400)):
        item = [f"N{word()}" if j % 10 == 3 else str(1000 + j) if j % 10 == 6 else word() for j in range(size)]
        bench.append((k, " ".join(item)))
        places = [[7], [8], [9], [29], [30], [31], [12], [size // 2], list(range(33, size, 66)), list(range(20, size, 31))]
        for i, at in enumerate(places):
            for drop in (False, True):
                doc = list(item)
                for p in reversed([p for p in at if p < size]):
                    doc[p : p + drop] = [] if drop else ["extra"]
                # elsewhere the document has one window of the item with other slots
                doc = [word() for _ in range(30)] + doc + [word()] + [f"N{word()}" if j % 10 == 3 else "77" if j % 10 == 6 else x for j, x in enumerate(item)][2:7]
                made.append((1000 * k + 10 * i + drop, " ".join(doc), None))
                s = _brute_similarity(bench[k][1], made[-1][1])
                if s >= 0.8:
                    want[made[-1][0], k] = s
    got = decontamination.contaminated(docs(spark, made), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == want and len(want) > 40
    assert all(r.slot_consistency == 1.0 for r in got)


def test_decontamination_of_leading_placeholders(spark):
    tail = "then the baker counts every loaf on the long table before noon"
    texts = [f"Dr Anna Maria Lopez Smith Jones 12 15 {tail}", f"1 2 3 4 5 6 {tail}", f"first the cook weighs all flour and Ann Bea Cid Dan Eve Flo Gus {tail}"]
    item = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    made = docs(spark, [(k, f"well {t} indeed", None) for k, t in enumerate(texts)] + [(10, texts[2].replace("weighs", "holds"), None), (11, texts[2].replace("flour and Ann", "flour or Ann"), None)])
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(made, item, similarity=0.6).collect()}
    want = {(r.doc_id, k): s for r in made.collect() for k, t in enumerate(texts) if (s := _brute_similarity(t, r.text)) >= 0.6}
    assert got == want and all(got[k, k] == 1.0 for k in range(3)) and (11, 2) in got


def test_decontamination_of_other_numbers_and_names(spark):
    text = "A baker named {} sells {} loaves for {} dollars each and wants to know how much {} earns in a week of work"
    item = spark.createDataFrame([(7, text.format("Anna", "12", "3", "Anna")), (8, "Anna Maria Lopez buys some bread and then walks home alone")], "item_id long, text string")
    made = [(1, text.format("Jean Paul Sartre", "1,200", "3.50", "Jean Paul Sartre")), (2, text.format("Bo", "1.5", "1,234,567.89", "Bo")), (3, text.format("Bo", "5", "6", "Li"))]
    made += [(4, "Yes. Well: Anna Maria Lopez buys some bread and then walks home alone. The End"), (5, "Anna, Maria and Lopez buys some bread")]
    got = {(r.doc_id, r.item_id): (r.similarity, r.slot_consistency) for r in decontamination.contaminated(docs(spark, [(*m, None) for m in made]), item, consistency=0.5).collect()}
    assert got == {(1, 7): (1.0, 1.0), (2, 7): (1.0, 1.0), (3, 7): (1.0, 0.833333), (4, 8): (1.0, 1.0)}


def test_decontamination_by_shuffle_and_by_row(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one, two = (sorted(decontamination.contaminated(documents, bench, max_broadcast=m).collect()) for m in (500_000, 0))
    assert one == two and one
    item = spark.createDataFrame([(1, "first they mix the flour with the water and then they bake the bread until it is brown", "x", 5)] * 2 + [(2, "short", None, None)], "item_id long, text string, doc_id string, d int")
    full = item.first().text
    half, rest = full[:46], full[30:]
    made = docs(spark, [(None, half, None), (None, rest, None), (None, full, None), (4, half, None), (4, rest, None), (5, full, None), (5, full, None), (6, None, None), (7, "", None)])
    for m in (500_000, 0):
        got = decontamination.contaminated(made.withColumnRenamed("q", "item_id").withColumnRenamed("n", "iid"), item, max_broadcast=m).collect()
        assert sorted((r.doc_id, r.item_id) for r in got if r.doc_id) == [(5, 1)] and sum(r.doc_id is None for r in got) == 1
        assert decontamination.contaminated(docs(spark, []), item, max_broadcast=m).count() == decontamination.contaminated(made, item.limit(0), max_broadcast=m).count() == 0


def test_packing(spark, documents):
    got = packing.pack(documents).toPandas()
    enc = tokens.encoder(tokens.default_tokenizer())
    assert got.length.sum() == sum(len(enc.whole(r.text or "")) // 4 + 1 for r in documents.collect())
    placed = got.sort_values(["sequence_id", "offset"])
    ends = placed.groupby("sequence_id").length.cumsum()
    assert ((ends - placed.length) == placed.offset).all() and ends.max() <= 1024
    assert got.sequence_id.nunique() <= 1.05 * got.length.sum() / 1024 + 1
    edge = packing.pack(docs(spark, EDGE), 16).toPandas()
    assert (edge[edge.doc_id == 1].length == 1).all() and edge.groupby("sequence_id").length.sum().max() <= 16
    assert packing.pack(docs(spark, [])).count() == 0


def test_encoder_equals_library():
    enc, rng = tokens.Encoder(tokens.default_tokenizer(), 50), np.random.default_rng(5)
    parts = ["a", " ", " ", "  ", "\n", "\n", "\n\n", "'s", "12", "_", "é", "²", "\t", "The", "<|endoftext|>", "你好", "\u00a0", "\u200b", "…", "\r\n", "\0", "e\u0301", "\x1c", "\x85", "Straße", "don't", "l'été", "'", "...", "<|", "_x", "x²", "ªº", "ĸŉ", "µ", "×", "¿qué?", "\u0130"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(9000)]
    assert enc.many(texts) == [enc.whole(t) for t in texts]


def test_topk(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(700, 5)), 2)
    x[300:420] = x[0]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(700)] + [(900, None, 1), (1000, [1.0, None, 1.0, 1.0, 1.0], 1), (1100, [float("nan")] * 5, 1), (None, [1.0] * 5, 1), (1200, [], 1)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), block=50, pivots=8).toPandas()
    m = np.floor(1024 * x)
    for q in range(0, 700, 100):
        s = m @ m[q]
        ids = np.asarray([i for i in np.lexsort((np.arange(700), -s)) if i != q][:10])
        own = got[got.query_id == q].sort_values("rank")
        assert own.vec_id.tolist() == ids.tolist() and own.score.tolist() == s[ids].astype(int).tolist()
    assert set(got.query_id) == set(range(0, 700, 100))
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def _top(made, ids, q, k=10):
    """Brute force by unbounded integers: rows of the query's dimension and other ids."""
    own = [int(v) for v in np.floor(1024 * np.asarray(made[q]))]
    scores = [(-max(-(2**63), min(2**63 - 1, sum(a * int(b) for a, b in zip(own, np.floor(1024 * np.asarray(x)))))), i) for i, x in zip(ids, made.values()) if i != q and len(x) == len(own)]
    return [(i, -s) for s, i in sorted(scores)[:k]]


def test_topk_of_clusters_large_values_and_other_dimensions(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    made = {i: list((centres[i % 20] + rng.normal(size=16) * 0.03) * (1 + i % 3)) for i in range(1500)}
    made |= {2000: [1e7] * 16, 2001: [-1e7] * 16, 2002: [1e300] * 16, 2003: [0.0] * 16, 2100: [3e9, 1.0], 2101: [1.0, 2.0], 2200: [0.5, 0.25], 2300: [0.0] * 16, 2400: [1e7] * 16, 2500: [1e200] * 16}
    rows = spark.createDataFrame([(i, [float(v) for v in x], 0, 1, "s") for i, x in made.items()] + [(2600, [1.7e308] * 16, 0, 1, "s")], "vec_id long, embedding array<double>, cell int, dim int, v string")
    got, work = topk.search(rows, 10, 100, "vec_id", "embedding", 24, 16, 4096, 64, None, None)
    got = got.toPandas()
    for q in [i for i in made if i % 100 == 0]:
        own = got[got.query_id == q].sort_values("rank")
        assert list(zip(own.vec_id, own.score)) == _top(made, made, q), q
    assert set(got.query_id) == {i for i in made if i % 100 == 0}
    met = work.where("vec_id < 1500").groupBy("vec_id").agg(F.sum("rows").alias("n")).agg(F.avg("n")).first()[0]
    assert met < 0.5 * len(made)  # the bounds stop the search


def _name(i):
    return "".join("bcdfghjklm"[int(c)] for c in f"{i:05d}")


def test_html_layouts_beyond_one_wrapper(spark):
    def layout(k, divs, body):
        return "".join(f'<div class="{_name(10000 * k + i)}">t{i}</div>' for i in range(divs)) + body

    def texts(divs):
        made = [(i, "http://a.com/x", layout(1, divs, "<article>the article</article>")) for i in range(3)]
        made += [(10 + k, "http://a.com/x", "<div>loose</div>" + layout(k, divs, "")) for k in range(2, 5)]
        return {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}

    # the host has an article element, whichever wrapper a page belongs to
    assert texts(1500) == {0: "the article", 1: "the article", 2: "the article", 12: "", 13: "", 14: ""}


def test_html_omitted_end_tags():
    def content(page):
        symbols, texts = html_extract.tokens(page)
        return [t for t, keep in zip(texts, html_extract.slots(symbols), strict=True) if keep]

    pairs = "".join(f'<dt class="{_name(i)}">a<dd>b' for i in range(30))
    cells = "".join(f'<tr class="{_name(i)}"><td>a<th>b' for i in range(30))
    deep = "".join(f'<div class="{_name(i)}">' for i in range(60))
    for block in (f"<dl>{pairs}</dl>", f"<table>{cells}</table>", deep):
        assert content(f"<aside>{block}</aside><div>the text</div>") == ["the text"]
        assert content(f'<div class="ad">{block}</div></section>' + "</div>" * 60 * (block == deep) + "<p>the text") == ["the text"]
        assert content(f"<article>the text{block}</article><div>later</div>")[-1] != "later"


def test_html(spark):
    page = '<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul>{m}</ul></nav><div class="ad-box">buy</div><article><h1>Head {i}</h1>{p}</article><aside>side</aside><div id="comments"><p>me too</p></div><form>go</form><footer>&copy; x</footer></body>'
    rows, want = [], {}
    for i in range(12):
        paras = [f"Text {i} {k} a &lt; b\n  c <b>bold</b>" for k in range(1 + i % 4)]
        rows.append((i, "http://h.example/x", page.format(i=i, m="<li><a href=/>m</a></li>" * (2 + i % 3), p="".join(f"<p>{p}" + ("</p>" if k % 2 else "<br>") for k, p in enumerate(paras)))))
        want[i] = "\n".join([f"Head {i}", *(f"Text {i} {k} a < b c bold" for k in range(len(paras)))])
    rows += [(50, None, None), (51, "http://k.example/", "<p>one<script>if(a<b){}</script><p>two"), (52, "http://k.example/", "")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")).collect()}
    assert {i: got[i].text for i in want} == want
    assert got[50].text == "" and got[51].text == "one\ntwo" and got[51].n_chars == 7 and got[52].text == ""
    wrapper = html_extract.numbered(html_extract.infer([html_extract.fold(html_extract.tokens(r[2])[0]) for r in rows[:12]]))
    assert all(html_extract.match(wrapper, html_extract.tokens(r[2])[0]) is not None for r in rows[:12])
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_every_stream_matches_its_wrapper():
    rng = np.random.default_rng(3)
    follow = 0
    for _ in range(150):
        streams = [rng.choice(["<p", "/p", "<b", "#", "<li", "/li"], rng.integers(0, 40)).tolist() for _ in range(5)]
        wrapper = html_extract.numbered(html_extract.infer([html_extract.fold(x) for x in streams]))
        steps, places = html_extract.program(wrapper), sum(x == "#" for x in html_extract._flat(html_extract.infer([html_extract.fold(x) for x in streams])))
        for x in streams:
            for got in (html_extract.match(wrapper, x), html_extract._follow(steps, x)):
                assert got is not None and len(got) == x.count("#") and all(0 <= p < places for p in got)
            follow += html_extract._greedy(wrapper, x) is None
    assert follow  # some are matched only by following all ways
    long = ["<p", "#", "/p"] * 50_000 + [f"<h{i}" for i in range(30)] * 2
    assert len(html_extract.fold(long)) <= 3


def _hosts(n, end, host="a.com"):
    word = lambda i: " ".join(f"{'abcdefghij'[int(c)]}{k}" for k, c in enumerate(str(1000 + i)))
    return [(i, f"http://{host}/{i}", f"<article><h1>{word(i)}</h1>" + "".join(f"<p>{word(i)} {k}</p>" for k in range(1 + i % 4)) + end + "</article>") for i in range(n)]


def test_html_template_texts_are_found_by_the_wrapper_alone(spark, monkeypatch):
    end = "<p>Share the word with all your friends today</p>"
    made = _hosts(20, end) + [(100 + i, f"http://few.com/{i}", h) for i, _, h in _hosts(2, end)]
    same = _hosts(1, end)[0][2]
    made += [(200 + i, "http://copies.com/x", same) for i in range(20)] + [(300 + i, "http://copies.com/y", h) for i, _, h in _hosts(3, "<p>z</p>")[1:]]
    pages = spark.createDataFrame([(*m, "x", 1, "y") for m in made], "page_id long, url string, html string, host string, n int, wrapper string")
    for fan in (64, 2):
        monkeypatch.setattr(html_extract, "FAN", fan)
        got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
        assert len(got) == len(made) and not any("Share" in got[i] for i in range(20)) and all(got[i].count("\n") == 1 + i % 4 for i in range(20))
        assert all(got[100 + i].endswith("friends today") for i in range(2)) and all(got[200 + i].endswith("friends today") for i in range(20))
        assert all(html_extract.placed(h, html_extract.ready_for([html_extract.infer([html_extract.fold(html_extract.tokens(x[2])[0]) for x in made[:20]])]))[1] != [-1] for _, _, h in made[:20])


def brute_components(fps, ids, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(fps)):
        low[find(i)] = min(low.get(find(i), 1 << 62), ids[i])
    return [low[find(i)] for i in range(len(fps))]


def test_simhash(spark, documents):
    got = simhash.near_duplicates(documents).collect()
    assert brute_components([int(r.fingerprint, 16) for r in got], [r.doc_id for r in got], 4) == [r.component_id for r in got]
    edge = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, EDGE)).collect()}
    assert edge[1].fingerprint == "0" * 16 and edge[2].component_id == 1
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_links_of_dense_groups(spark):
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = {int(c) for c in centre}
    for c in centre.tolist():
        for _ in range(40):
            fps.add(c ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 4))))
    fps = sorted(fps)
    reps = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    from latticework.llm.common import components

    got = {r.node: r.component for r in components(simhash.links(reps)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == brute_components(fps, list(range(len(fps))), 4)


def test_simhash_forest_of_large_buckets():
    rng = np.random.default_rng(9)
    fps = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, (12, 400)).astype(np.uint64)))
    fps = np.unique(fps.ravel()).view(np.int64)
    a, b = simhash.forest(fps, 4, small=100)
    ids = [int(x) for x in fps.view(np.uint64)]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, q in zip(a.tolist(), b.tolist()):
        assert bin(ids[p] ^ ids[q]).count("1") <= 4
        p, q = find(p), find(q)
        root[max(p, q)] = min(p, q)
    assert [find(i) for i in range(len(ids))] == brute_components(ids, list(range(len(ids))), 4)


@pytest.mark.parametrize("partitions", [2, 3, 4])
def test_simhash_partition_plans(spark, partitions):
    rng = np.random.default_rng(partitions)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64).tolist()
    fps = sorted({c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in base for _ in range(6)})
    reps = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    from latticework.llm.common import components

    got = {r.node: r.component for r in components(simhash.links(reps, partitions=partitions)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == brute_components(fps, list(range(len(fps))), 4)


def test_simhash_links_through_rows_without_id(spark, monkeypatch):
    prints = [(1, 1, 0x00), (None, 2, 0x0F), (2, 3, 0xFF), (None, 4, -1)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle=4: spark.createDataFrame(prints, "doc_id long, th long, fp long"))
    got = {r.fingerprint: r.component_id for r in simhash.near_duplicates(docs(spark, [])).collect()}
    assert got == {"0" * 16: 1, "0" * 14 + "0f": 1, "0" * 14 + "ff": 1, "f" * 16: None}


def test_simhash_first_of_each(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (None, text, "c"), (None, "lone words of a row without id", "d"), (None, "lone words of a row without id", "d"), (9, None, None)]
    made = docs(spark, rows).withColumnRenamed("rank", "k")
    assert sorted(((r.doc_id, r.lang) for r in simhash.first_of_each(made).collect()), key=str) == sorted([(3, "b"), (None, "d"), (9, None)], key=str)


def test_thresholds_are_enough():
    t = simhash.thresholds([np.random.default_rng(i).random((50, 4)) for i in range(4)], 4)
    assert (t.sum(1) == 5).all()


def test_toxicity(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(rng.choice(["river", "stone", "cloud", "green", "walk"], 30).tolist() + (["idiot", "moron"] if i % 5 == 0 else [])), None) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs(spark, [*rows, (500, None, None), (501, "", None)]), labels).collect()
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert held and all(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 402
    assert {r.score for r in toxicity.score(docs(spark, EDGE), labels.limit(0)).collect()} == {toxicity.score(docs(spark, [(1, "a", None)]), labels.limit(0)).first().score}


def test_toxicity_against_brute_force(spark):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(rng.choice(["river", "stone", "idiotic", "green", "walk", "", "fool"], rng.integers(0, 6))), None) for i in range(90)]
    labels = spark.createDataFrame([(i, int(rng.random() < (0.9 if "idiotic" in t else 0.2))) for i, t, _ in rows if i % 7], "doc_id long, toxic int")
    y = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    sets = {i: {(" " + w + " ")[a : a + n] for w in t.split() for n in (3, 4, 5, 6) for a in range(len(w) + 3 - n)} for i, t, _ in rows}
    names = sorted(set().union(*sets.values()))
    n = np.asarray([sum(v == c for v in y.values()) for c in (0, 1)])
    x = np.asarray([[g in sets[i] for g in names] for i in y], float)
    t = np.asarray(list(y.values()))
    counts = np.asarray([x[t == c].sum(0) for c in (0, 1)])
    extra = 4.0 * n / n.sum()
    r = np.log((counts[1] + extra[1]) / n[1] / ((counts[0] + extra[0]) / n[0]))
    share = counts.sum(0) / n.sum()
    z = (counts[1] - n[1] * share) / np.sqrt(share * (1 - share) * n[0] * n[1] / n.sum() + 1)
    r = np.where(z**2 > 4, r * (1 - 4 / np.maximum(z**2, 1e-9)), 0)
    assert 0 < (r != 0).sum() < len(r)
    shared = (x * r).sum(1)
    a = np.hstack([x * r, (shared / np.sqrt((shared**2).mean()))[:, None], np.ones((len(t), 1))])
    w, l2 = np.zeros(a.shape[1]), np.append(np.full(len(names), 1e-4), [0, 0])
    for _ in range(60):  # Newton
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.lstsq(a.T @ (a * (p * (1 - p) / len(t))[:, None]) + np.diag(l2 + 1e-12), a.T @ (p - t) / len(t) + l2 * w, rcond=None)[0]
    made = docs(spark, rows)
    known = toxicity.labelled(labels)
    got_n, got = toxicity.class_counts(made.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), known)
    assert got_n.tolist() == n.tolist() and got.sum() == counts.sum()
    full = np.asarray([[g in sets[i] for g in names] for i, _, _ in rows], float)
    weight = (w[:-2] + w[-2] / np.sqrt((shared**2).mean())) * r
    want = 1 / (1 + np.exp(-(full @ weight + w[-1])))
    score = {q.doc_id: q.score for q in toxicity.score(made, labels).collect()}
    assert max(abs(score[i] - want[k]) for k, (i, _, _) in enumerate(rows)) < 0.02


def test_toxicity_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1, "x", None), (1, 0, "y", 3), (3, 0, "z", 4), (4, 0, "z", 4), (99, 1, "z", 4)], "doc_id long, toxic int, text string, k int")
    got = toxicity.score(docs(spark, EDGE).withColumnsRenamed({"q": "score", "rank": "y", "n": "k"}), labels).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.score(docs(spark, []), labels).count() == 0


def test_rans_round_trip(spark, documents):
    for n in (0, 1, 40, 70_000):
        ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_000).astype("<u4")
        image = rans_io.encode_image(np.asarray([5]), np.asarray([False]), np.asarray([n]), ids, 1024)
        assert (rans_io.decode_image(image)[3] == ids).all()
        with pytest.raises(ValueError):
            rans_io.decode_image(image[:-9] + bytes([image[-9] ^ 1]) + image[-8:])
    got = rans_io.token_output(documents).toPandas().sort_values("doc_id")
    enc, start = tokens.encoder(tokens.default_tokenizer()), 0
    for r, d in zip(got.itertuples(), sorted(documents.collect()), strict=True):
        raw = enc.whole(d.text or "") + (2).to_bytes(4, "little")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    assert rans_io.token_output(docs(spark, EDGE)).count() == len(EDGE) and rans_io.token_output(docs(spark, [])).count() == 0


def test_rans_files_are_images(spark, documents, tmp_path):
    path = str(tmp_path / "images")
    rans_io.write(documents.withColumn("th", F.lit("x")), path, image_tokens=20_000)
    files = sorted(tmp_path.glob("images/part-*"))
    enc, want = tokens.encoder(tokens.default_tokenizer()), {r.doc_id: r.text or "" for r in documents.collect()}
    got = {}
    for f in files:
        doc_ids, nulls, lengths, ids = rans_io.decode_image(f.read_bytes()[:-1])
        assert not nulls.any()
        for d, part in zip(doc_ids.tolist(), np.split(ids, np.cumsum(lengths)[:-1])):
            got[d] = part.astype("<u4").tobytes()
    assert len(files) > 4 and got == {d: enc.whole(t) + (2).to_bytes(4, "little") for d, t in want.items()}


def test_rans_of_one_id_for_all(spark):
    made = docs(spark, [(None, f"text {i % 50}", None) for i in range(300)] + [(7, "the same text", None)] * 300).repartition(4).cache()
    got = rans_io.token_output(made).toPandas().sort_values("start")
    assert len(got) == 600 and (got.start.to_numpy() == np.cumsum(got.n_tokens) - got.n_tokens).all() and got.doc_id.isna()[:300].all()


def test_line_dedup(spark):
    rng = np.random.default_rng(8)
    pool = [" ".join(rng.choice(list("abcdefgh"), n)) for n in rng.integers(1, 9, 12)] + [""]
    rows = [(i, "\n".join(rng.choice(pool, rng.integers(1, 25))), None) for i in range(60)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows), 10).collect()}
    seen, runs = set(), []
    for i, t, _ in rows:
        lines, c = t.split("\n"), np.concatenate([[0], np.cumsum([len(x.split()) for x in t.split("\n")])])
        spans = set()
        for a in range(len(lines)):
            spans |= {(a, e) for e in [next((e for e in range(a + 1, len(lines) + 1) if c[e] - c[a] >= 10), None)] if e}
            spans |= {(s, a + 1) for s in [next((s for s in range(a, -1, -1) if c[a + 1] - c[s] >= 10), None)] if s is not None}
        gone = set()
        for a, e in sorted(spans):
            run = "\n".join(lines[a:e])
            gone |= set(range(a, e)) if run in seen else set()
            seen.add(run)
        assert got[i].text == "\n".join(x for k, x in enumerate(lines) if k not in gone) and got[i].n_removed == len(gone)
        runs += gone
    assert runs
    edge = line_dedup.dedup_lines(docs(spark, EDGE)).collect()
    assert len(edge) == len(EDGE) and all(r.n_removed == 0 for r in edge)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    got = corpus_pipeline.run(spark, SF).toPandas()
    sizes = got.groupby("sequence_id").length.sum()
    assert len(got) and sizes.max() <= 1024 and got.doc_id.notna().all()


def _edge_tables(spark, at, rows):
    made = docs(spark, rows).withColumnsRenamed({"q": "lang_pred", "rank": "th", "n": "d"})
    made.write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").withColumn("doc_id", F.lit("x")).write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_pipeline_edge_cases(spark, tmp_path):
    import corpus_pipeline

    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "and", "dog", "ran", "far"], n))
    rows = [(i, prose(30), "en") for i in range(12)] + [(20, None, "en"), (21, "", "en"), (22, "½ ²", None), (23, "12 !", None)]
    own, lone, clean, dirty = prose(40), prose(40), prose(40), prose(8) + " " + item + " " + prose(8)
    rows += [(None, own, "en"), (None, own, "en"), (30, lone, "en"), (30, clean, "en"), (30, dirty, None), (None, dirty + " x", "en")]
    sf = _edge_tables(spark, tmp_path / "some", rows)
    out, at = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{sf}/{name}")
        out = spark.read.parquet(f"{sf}/{name}")
        at.append([(r.doc_id, r.text) for r in out.collect()])
    assert {20, 21, 22, 23}.isdisjoint(i for i, _ in at[0]) and len(at[0]) == len(rows) - 4
    assert at[2].count((None, own)) == 1 and (30, lone) in at[2] and (30, clean) in at[2]
    assert (30, dirty) not in at[3] and all(item not in t for _, t in at[3]) and {(30, lone), (30, clean), (None, own)} <= set(at[3])
    packed = corpus_pipeline.run(spark, sf).toPandas()
    assert len(packed) == len(at[3]) and packed.doc_id.isna().sum() == 1
    empty = _edge_tables(spark, tmp_path / "none", [])
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_keeps_the_scratch_of_other_queries(spark):
    import corpus_pipeline

    made = docs(spark, EDGE)
    found = simhash.near_duplicates(made)
    corpus_pipeline.language(spark, made, SF)
    corpus_pipeline.pack(spark, made, SF)
    assert found.count() == len(EDGE)


def test_very_long_text(spark):
    text = "\n".join(f"line {i} holds the words of a very long text {i * 7919}" for i in range(400_000))
    assert len(text) > 18_000_000
    made = docs(spark, [(1, text, "en"), (2, "a short text", "en"), (3, text, "en")])
    model = language_id.fit([("en", "the cat sat on the mat") for _ in range(5)] + [("fr", "le chat noir est dans la maison") for _ in range(5)])
    assert {r.doc_id for r in language_id.predict(made, model).collect()} == {1, 2, 3}
    assert [r.n_removed for r in line_dedup.dedup_lines(made).orderBy("doc_id").select("n_removed").collect()] == [0, 0, 400_000]
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(made).collect()} == {1: 1, 2: 2, 3: 1}
    packed = packing.pack(made).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert len({r.n for r in packed if r.doc_id != 2}) == 1
    bench = spark.createDataFrame([(1, "holds the words of a very long text")], "item_id long, text string")
    assert {r.doc_id for r in decontamination.contaminated(made, bench).collect()} == {1, 3}


def test_held_out_matches_crc32(spark):
    from latticework.llm.common import held_out

    got = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
