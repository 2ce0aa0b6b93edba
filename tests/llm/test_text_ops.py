"""op3, op4, op5, op8 and op9 against brute force, hand-made cases and held-out accuracy."""

import hashlib
import random
import re

import pytest

from provenant.llm import op3_pii, op4_langid, op5_decontam, op8_tokens, op9_html

# -- op3

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and op3_pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], list(BASE).index(x[0])))


def luhn_card(rnd, n):
    d = [rnd.randrange(10) for _ in range(n - 1)]
    s = next(c for c in "0123456789" if op3_pii.luhn("".join(map(str, d)) + c))
    return "".join(map(str, d)) + s


def test_pii_base_spans_match_the_patterns():
    rnd = random.Random(2)
    bits = ["a@b.c", "x.y@d-e.fr", "@", "é@é.é", "a@b", "a@b@c.de", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "007.1.1.1", " ", "  ", "-", "+1 (443) 555-5793", "+12", "+", "((((", "word", "é", "9", "12", "4.", ".", "%", "\n"]
    for _ in range(3000):
        text = "".join(rnd.choice([*bits, luhn_card(rnd, rnd.choice([13, 14, 16, 19, 20]))]) for _ in range(rnd.randint(0, 14)))
        assert [s[:3] for s in op3_pii.find_spans(text) if s[0] in op3_pii.BASE] == base_spans(text), text


def test_pii_added_spans_need_checksum_or_context():
    kinds = lambda t: [s[0] for s in op3_pii.find_spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 please") == ["iban"]
    assert kinds("IBAN DE89 3704 0044 0532 0130 01 please") == []
    assert [op3_pii.find_spans(t)[0][:3] for t in ("DE89 3704 0044 0532 0130 00 BIC COBADEFF", "GB82WEST12345698765432 NOW")] == [("iban", 0, 27), ("iban", 0, 22)]
    assert kinds("XDE89 3704 0044 0532 0130 00") == kinds("ZZ89 3704 0044 0532 0130 00") == []
    assert kinds("phone: 030 1234 5678.") == ["tel"] and kinds("order 030 1234 5678.") == []
    assert kinds("card 4222222222222") == ["card13"] and kinds("part 4222222222222") == []
    assert op3_pii.redact("a@b.cd, é", op3_pii.find_spans("a@b.cd, é")) == "[EMAIL], é"


def test_pii_runs_in_linear_time():
    for text in ("9" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 200_000, "@a" * 100_000, "A" * 200_000, "1 " * 100_000, "tel " + "1-" * 100_000, "AB12" + "C" * 200_000, "DE89" * 50_000, "a@b.cd tel 030 1234 567 " * 20_000):
        assert isinstance(op3_pii.find_spans(text), list)


def test_pii_query_rows(docs, rows, odd, none):
    got = {r.doc_id: r for r in op3_pii.digest(docs).collect()}
    assert len(got) == len(rows)
    for i, t, _, _ in rows:
        base = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert got[i].n_email == sum(k == "email" for k, _, _ in base)
    assert op3_pii.digest(odd).count() == odd.count() and op3_pii.digest(none).count() == 0
    assert op3_pii.redact_documents(none).columns == none.columns and op3_pii.redact_documents(odd).count() == odd.count()


def test_pii_redaction_recounts(spark):
    df = spark.createDataFrame([(1, "mail é a@b.cd", 13), (2, None, None)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in op3_pii.redact_documents(df).orderBy("doc_id").collect()] == [(1, "mail é [EMAIL]", 14), (2, None, None)]


# -- op4


def test_language_held_out_accuracy(spark, sf_dir):
    got = op4_langid.query(spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 40 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_ignores_the_label_of_what_it_predicts(spark, docs, odd, none):
    model = op4_langid.fit(docs.select("doc_id", "text", "lang"))
    a = {r.doc_id: r.lang_pred for r in op4_langid.predict(docs, model).collect()}
    b = {r.doc_id: r.lang_pred for r in op4_langid.predict(docs.drop("lang", "source"), model).collect()}
    assert a == b
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all((a[i] == "und") == (not t or not re.search(r"[^\W\d_]", t)) for i, t in texts.items())
    assert op4_langid.predict(odd, model).count() == odd.count() and op4_langid.predict(none, model).count() == 0
    empty = op4_langid.fit(none.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in op4_langid.predict(docs, empty).collect()} == {"und"}
    assert op4_langid.keep_identified(odd, model).columns == odd.columns


def test_language_labels_are_bounded_and_null_ids_are_not_held_out(spark, docs, monkeypatch):
    monkeypatch.setattr(op4_langid, "MAX_LANGS", 1)
    many = docs.selectExpr("doc_id", "text", "CASE WHEN doc_id < 20 THEN 'aa' ELSE concat('x', doc_id) END AS lang")
    assert op4_langid.fit(many).langs == ["aa"]
    rows = spark.createDataFrame([(None, "some text")], "doc_id long, text string").select(op4_langid.held_out().alias("h")).collect()
    assert rows[0].h is False


def test_language_prediction_is_the_sum_over_its_ngrams():
    import numpy as np

    rng = np.random.default_rng(0)
    model = op4_langid.Model(["aa", "bb"], rng.normal(size=(op4_langid.DIM, 2)).astype(np.float32), np.zeros(2))
    texts = ["short text", None, "x" * 700_000, "Ünï çode", "1234"]
    alone = [op4_langid.predict_texts(model, [t]) for t in texts]
    names, scores = op4_langid.predict_texts(model, texts)
    assert names == [a[0][0] for a in alone] and names[1] == names[4] == "und"
    assert np.allclose(scores, [a[1][0] for a in alone])


def test_ngrams_in_pieces_are_those_of_the_whole():
    import numpy as np

    code, row = op4_langid._codes(["some words here", "", "x", "more words, and more"])
    for step in (1, 2, 3, 7, 1000):
        parts = [*zip(*((b.tolist(), r.tolist()) for b, r in op4_langid._grams(code, row, step)))]
        got = sorted((b, r) for bs, rs in zip(*parts) for b, r in zip(bs, rs))
        if step == 1:
            want = got
        assert got == want and len(got) == sum(max(0, (row == k).sum() - n + 1) for k in range(4) for n in op4_langid.ORDERS)
    assert code.dtype == np.uint32


# -- op5


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute5(docs, items):
    windows = {}
    for i, t in items:
        w = words_of(t)
        n = min(10, len(w))
        if i is not None and n:
            for p in range(len(w) - n + 1):
                windows.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w = words_of(t)
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[p : p + n]))) is not None:
                    hit |= {*range(p, p + n)}
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("share", [op5_decontam.SHARE_WORDS, 0])
@pytest.mark.parametrize("short", [True, False])
def test_decontamination(spark, docs, rows, share, short):
    longest = max((r[1] or "" for r in rows), key=len)
    w = longest.split()
    items = [(1, " ".join(w[40:75])), (2, " ".join(w[60:70])), (2, " ".join(w[900:915]).upper()), (10, "; ".join(w[70:79]) + " other words"), (3, None), (4, ""), (None, " ".join(w[:30]))]
    items += [(5, "One!"), (6, "never seen"), (7, " ".join(w[5:8]))] if short else []
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, op5_decontam.decontaminate(docs, bench, share).collect()))
    assert got == sorted(brute5([r[:2] for r in rows], items))
    clean = {r.doc_id for r in op5_decontam.remove_contaminated(docs, bench, share).collect()}
    assert clean == {g[0] for g in got if not g[5]}


@pytest.mark.parametrize("share", [op5_decontam.SHARE_WORDS, 0])
def test_decontamination_of_empty_tables(spark, docs, odd, none, share):
    no = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in op5_decontam.decontaminate(docs, no, share).collect()} == {False}
    some = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert op5_decontam.decontaminate(none, some, share).count() == 0
    assert op5_decontam.remove_contaminated(odd, some, share).columns == odd.columns


@pytest.mark.parametrize("share", [op5_decontam.SHARE_WORDS, 0])
def test_decontamination_judges_rows(spark, odd, rows, share):
    """Repeated and null ids, the same on both sides of the switch."""
    w = max((r[1] or "" for r in rows), key=len).split()
    items = [(1, " ".join(w[40:75])), (2, " ".join(rows[12][1].split()[:12])), (3, "one"), (4, "one"), (5, " ".join(w[41:52]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    given = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = brute5(given, items)
    assert sorted(map(str, map(tuple, op5_decontam.decontaminate(odd, bench, share).collect()))) == sorted(map(str, want))
    kept = [(r.doc_id, r.text) for r in op5_decontam.remove_contaminated(odd, bench, share).collect()]
    assert sorted(map(str, kept)) == sorted(str(g) for g, x in zip(given, want) if not x[5])
    ids = spark.createDataFrame([(7, items[0][1]), (7, "clean text"), ((1 << 60) + 1, "one")], "doc_id long, text string")
    assert sorted(map(tuple, op5_decontam.decontaminate(ids, bench, share).collect())) == sorted(brute5([tuple(r) for r in ids.collect()], items))


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("share", [op5_decontam.SHARE_WORDS, 0])
def test_words_made_to_collide_stay_different(spark, share):
    rows = [(i, f"x {thue_morse(n, 'b', 'a')} y") for i, n in enumerate((1024, 2048, 16, 32))]
    items = [(i, thue_morse(n)) for i, n in enumerate((1024, 2048, 16, 32))] + [(9, " ".join(thue_morse(2048)))]
    rows += [(8, " ".join(thue_morse(2048, "b", "a")))]
    got = op5_decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), share)
    assert sorted(map(tuple, got.collect())) == sorted(brute5(rows, items))


# -- op8


@pytest.mark.parametrize("leaf", [4, 20, 512])
def test_edited_counts_equal_full_counts(leaf, monkeypatch):
    monkeypatch.setattr(op8_tokens, "LEAF_CHARS", leaf)
    monkeypatch.setattr(op8_tokens.cut, "__defaults__", (leaf,))
    enc, rnd = op8_tokens.encoding(op8_tokens.RANKS), random.Random(leaf)
    bits = ["a", " the", " word", "'s", "  ", "\n", "\n\n", " 12", "!?", " É", " x y z", "'ll ", "don't ", " \t", "7", ".", " don", "'", "t s", "日本", " 語", "語。", "，本", "x=1", "'9", "'t9", "_", "e\u0301", "\u00a0"]
    for _ in range(600):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60)))
        tree = op8_tokens.TokenTree(text)
        for _ in range(6):
            assert tree.text() == text and tree.n_tokens == len(enc.encode_ordinary(text)) and tree.n_chars == len(text)
            s = rnd.randint(-2, len(text) + 2)
            e, new = s + rnd.choice([-1, 0, 1, 2, 5, 30]), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 4)))
            tree.edit(s, e, new)
            s = min(max(s, 0), len(text))
            text = text[:s] + new + text[min(max(e, s), len(text)) :]


def test_edits_reencode_little_of_a_long_text():
    text = "word and more " * 20_000
    tree = op8_tokens.TokenTree(text)
    tree.encoded_chars = 0
    tree.edit(140_000, 140_005, "other")
    assert 0 < tree.encoded_chars < 4 * op8_tokens.LEAF_CHARS


@pytest.mark.parametrize("text", ["中文，没有空格。" * 2500, "x=f(a[1],b.c);" * 1500, "日本語" * 400 + "。" + "語。" * 4000])
def test_edits_reencode_little_without_blanks(text):
    tree = op8_tokens.TokenTree(text)
    tree.encoded_chars = 0
    tree.edit(9_000, 9_003, "新x")
    assert 0 < tree.encoded_chars < 4 * op8_tokens.LEAF_CHARS
    assert tree.n_tokens == len(tree.encoding.encode_ordinary(text[:9_000] + "新x" + text[9_003:]))


def test_a_kept_tree_is_used_for_its_own_text_only():
    text = "some words and more " * 200
    full = op8_tokens.TokenTree(text)
    used = [i for i in range(full.base) if full.leaves[i]]
    chars, tokens = [full.chars[full.base + i] for i in used], [full.tokens[full.base + i] for i in used]
    kept = op8_tokens.kept_tree(text, chars, tokens, op8_tokens.text_hash(text))
    assert kept.encoded_chars == 0 and kept.n_tokens == full.n_tokens
    other = text[::-1]
    again = op8_tokens.kept_tree(other, chars, tokens, op8_tokens.text_hash(text))
    assert again.encoded_chars == len(other) and again.n_tokens == len(again.encoding.encode_ordinary(other))
    assert op8_tokens.kept_tree("", [], [], op8_tokens.text_hash("")).n_tokens == 0


def test_token_query(spark, docs, rows, odd, none, sf_dir):
    enc = op8_tokens.encoding(op8_tokens.RANKS)
    edited = op8_tokens.standard_edits(docs)
    got = {r.doc_id: r for r in op8_tokens.count_edited(edited).collect()}
    for r in edited.collect():
        text = r.text or ""
        assert got[r.doc_id].n_tokens == len(enc.encode_ordinary(text))
        for e in r.edits:
            s = min(max(e.start, 0), len(text))
            text = text[:s] + (e.new or "") + text[min(max(e.stop, s), len(text)) :]
        assert (got[r.doc_id].n_tokens_edited, got[r.doc_id].n_chars_edited) == (len(enc.encode_ordinary(text)), len(text))
    kept = op8_tokens.trees(docs.select("doc_id", "text"))
    assert {r.doc_id: r for r in op8_tokens.count_edited(op8_tokens.standard_edits(kept)).collect()} == got
    assert {*op8_tokens.trees(odd).columns} == {*odd.columns, *op8_tokens.TREE}
    assert op8_tokens.count_edited(op8_tokens.standard_edits(odd)).count() == odd.count()
    assert op8_tokens.count_edited(op8_tokens.standard_edits(none)).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = {r.doc_id: r for r in op8_tokens.query(spark, sf_dir).collect()}
    assert {i: r.n_tokens for i, r in out.items()} == {i: len(enc.encode_ordinary(t or "")) for i, t in texts.items()}
    long = [r for i, r in out.items() if len(texts[i] or "") > 16 * op8_tokens.LEAF_CHARS]
    assert long and all(r.n_chars_encoded < 4 * op8_tokens.LEAF_CHARS * op8_tokens.N_EDITS for r in long)


# -- op9

PAGES = [
    ("<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>one\n two<br>three<p>four</article><footer>f</footer>", "A & B one two three four"),
    ("<body><div class='cookie-notice'>We use cookies</div><main><p>Text <b>bold<i>x</b> end.</p><form><p>mail</p></form><section id=comments><p>nice</p></section></main>", "Text boldx end."),
    ("<div id=header>H</div><div id=sidebar>S</div><div class='post-content'><p>a</p><div class=ad>buy</div><ul><li>b<li>c</ul></div><div class=footer>F</div>", "a b c"),
    ("<div class='layout has-sidebar'><div class='entry-content'><script>var a='<p>no</p>';</script><!-- no --><style>p{}</style><p title='a>b'>yes</p></div></div>", "yes"),
    ("<article><header><h1>Head</h1></header><p>x &lt;b&gt; &eacute;&#233;&nbsp;y</p><aside>no</aside><footer>no</footer></article>", "Head x <b> éé y"),
    ("<nav>never closed <article><p>text</p></article>", "text"),
    ("plain text only", "plain text only"),
    ("", ""),
    (None, ""),
    ("<nav>menu</nav>", ""),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><pre>d\n\ne</pre><p>3 < 4 & 5 > 2</p></article>", "a b c d e 3 < 4 & 5 > 2"),
    ("<div>" * 3000 + "deep", "deep"),
    ("<article><p>a</p></article><article class='comment'><p>c</p></article>", "a"),
    ("<body><div role=banner>x</div><div role=main><h2>t</h2>u</div><div hidden>z</div></body>", "t u"),
]


@pytest.mark.parametrize("source,want", PAGES)
def test_page_texts(source, want):
    assert op9_html.main_text(source) == want


def test_wrapper_of_a_host_without_landmarks(spark):
    page = lambda i: f"<div class=top><span>Shop of things</span></div><ul><li><a href=1>Go home now</a></li></ul><div class=box><h1>Title {i}</h1><p>Body {i} of {i * i}</p></div><div><p>All rights kept</p></div>"
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(8)] + [(8, "http://other.org/", page(8)), (9, None, None), (10, "http://h.org/x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for share in (op9_html.SHARE_BYTES, -1):
        got = {r.page_id: r for r in op9_html.extract(df, share).collect()}
        assert {i: got[i].text for i in range(8)} == {i: f"Title {i} Body {i} of {i * i}" for i in range(8)}
        assert got[8].text == "Shop of things Title 8 Body 8 of 64 All rights kept" and got[8].n_chars == len(got[8].text)
        assert got[9].text == got[10].text == "" and len(got) == 11
    assert op9_html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["<section id='discussion'><h2 id='related-work'>x</h2></section>", "<h2 id='how-to-search'>x</h2>", "<h2 id='comments'>x</h2>", "<p class='legal'>x</p>", "<div class='reviews'>x</div>", "<div class='side menu-item'>x</div>"])
def test_topics_of_an_article_are_no_boilerplate(part):
    assert op9_html.main_text(f"<article><p>a</p>{part}<div class='share-buttons'>s</div><div class='post related-posts'>r</div><div id='comments'>c</div><p>b</p></article>") == "a x b"


@pytest.mark.parametrize(
    "source,want",
    [
        ("<div class='entry-content'><p>first</p></div><div class=ad>buy</div><div class='entry-content'><p>second part</p></div>", "first second part"),
        ("<section class=content><p>a</p></section><section class=content><p>longer b</p></section><div class=footer>f</div>", "a longer b"),
        ("<div class='post-header'><h1>Title</h1></div><div class='post-text'><p>text</p></div>", "Title text"),
        ("<main><header><h1>Title</h1></header><div class='article-body'><p>text</p></div></main>", "Title text"),
        ("<main><h1>Title</h1><p>Lead.</p><div class='sidebar'>s</div><div class='widget'>w</div><div class='article-body'><p>text</p></div></main>", "Title Lead. text"),
    ],
)
def test_all_parts_of_a_split_article(source, want):
    assert op9_html.main_text(source) == want


def test_copies_of_a_page_are_no_template(spark):
    marked = "<nav>menu</nav><article><h1>Head</h1><p>Plain paragraph.</p></article><div>stamp {}</div>"
    plain = "<div class=top>Shop</div><div class=box><p>Body {}</p></div>"
    rows = [(i, "http://copies.org/", marked.format(i)) for i in range(30)] + [(40 + i, "http://four.org/", plain.format(max(i, 1))) for i in range(4)]
    got = {r.page_id: r.text for r in op9_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert {got[i] for i in range(30)} == {"Head Plain paragraph."}
    assert all(f"Body {max(i, 1)}" in got[40 + i] for i in range(4))


@pytest.mark.parametrize("least", [None, "", "<div class=home><p>Welcome to the shop</p></div>", "<p>404"])
def test_the_wrapper_is_not_the_first_page(spark, least):
    page = lambda i: f"<body class=postid-{i}><div class=top>Shop of things</div><div class=box><h1>Title {i}</h1><p>Shop of things</p></div></body>"
    rows = [(None, "http://h.org/", least), (0, "http://h.org/", least)] + [(i, "http://h.org/", page(i)) for i in range(1, 9)]
    rows += [(9, "http://h.org/", "<div class=other>Shop of things</div>")]
    got = {r.page_id: r.text for r in op9_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert {i: got[i] for i in range(1, 9)} == {i: f"Title {i}" for i in range(1, 9)}
    assert got[9] == "Shop of things"  # constant elsewhere, in another slot


def test_tree_matching():
    t = lambda label, *kids: (label, tuple(kids))
    a = t("b", t("x", t("p"), t("q")), t("y"), t("z"))
    b = t("b", t("w"), t("x", t("q")), t("z"))
    assert op9_html.align(a, b)[0] == 4
    assert op9_html.slots(a, b) == ["", None, "0.", "0.1.", "2."]
    assert op9_html.align(a, a)[0] == 6 and op9_html.align(a, t("c"))[0] == 0
    assert op9_html.load(op9_html.dump(a)) == a
    both = op9_html.merge(a, b)
    assert both == t("b", t("w"), t("x", t("p"), t("q")), t("y"), t("z"))
    assert None not in op9_html.slots(both, a) + op9_html.slots(both, b) and op9_html.merge(both, a) == both


def brute_matching(a, b):
    """Weight of the best order-preserving matching, by trying all."""
    if a[0] != b[0]:
        return 0

    def best(xs, ys):
        return max((best(xs[1:], ys), best(xs, ys[1:]), brute_matching(xs[0], ys[0]) + best(xs[1:], ys[1:]))) if xs and ys else 0

    return 1 + best(a[1], b[1])


def random_tree(rnd, depth=3):
    return rnd.choice("ab") if depth < 3 else "r", tuple(random_tree(rnd, depth - 1) for _ in range(rnd.randint(0, 4) if depth else 0))


def test_tree_matching_is_the_best_one_and_wrappers_hold_their_trees():
    rnd = random.Random(4)
    for _ in range(150):
        a, b = random_tree(rnd), random_tree(rnd)
        assert op9_html.align(a, b)[0] == brute_matching(a, b)
        both = op9_html.merge(a, b)
        assert None not in op9_html.slots(both, a) and None not in op9_html.slots(both, b)


def test_wide_pages_take_seconds():
    import time

    t0 = time.monotonic()
    rows = "".join(f"<tr class=r{'abcdefghij'[i % 10] * (i % 7)}><td>a{i}<td><p>b</p></tr>" for i in range(16_000))
    plain = f"<table>{rows}</table>" + "".join(f"<{x}>t</{x}>" for x in ("div", "p", "section") * 4000)
    trees = [op9_html.shape(op9_html.parse(f"<div class=x>{k}</div>" * k + plain))[0] for k in (1, 2)]
    wrapper = op9_html.merge(*trees)
    assert op9_html.main_text(plain).startswith("a0 b") and op9_html.slots(wrapper, trees[0])
    assert time.monotonic() - t0 < 20


def test_the_region_decides_without_markup_and_over_misleading_markup(spark):
    words = lambda i, n: " ".join(f"w{i * 37 + k}" for k in range(n))
    bare = lambda i: f"<div><span>Shop</span></div><div><ul><li><a href=1>{words(i, 3)}</a></li></ul></div><section><h2>T{i}</h2><p>{words(i, 60)}</p></section><table><tr><td>{words(i + 9, 4)}</td></tr></table>"
    lying = lambda i: f"<div class=content><p>{words(i, 3)}</p></div><div class=zone><h1>T{i}</h1><p>{words(i, 60)}</p></div>"
    rows = [(i, "http://bare.org/", bare(i)) for i in range(8)] + [(20 + i, "http://lying.org/", lying(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: (r.text, r.told_by) for r in op9_html.extract(df).collect()}
    assert {i: got[i] for i in range(8)} == {i: (f"T{i} {words(i, 60)}", "region") for i in range(8)}
    assert {i: got[20 + i] for i in range(8)} == {i: (f"T{i} {words(i, 60)}", "region") for i in range(8)}
    again = {r.page_id: (r.text, r.told_by) for r in op9_html.extract(df.repartition(7), -1).collect()}
    assert again == got


def test_page_texts_of_the_sample(spark, sf_dir):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in op9_html.query(spark, sf_dir).collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer)", pages[r.page_id], re.S).group(1).replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", re.sub("<!--.*?-->", "", body)))
        assert r.text == " ".join(p for p in parts if p)
