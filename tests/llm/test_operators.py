"""Each operator against a brute-force version on a small fixture, with nulls, empties, repeats, ties and clashing names."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ordertape.llm import chat, decontam, embed_dedup, html_text, langid, packing, simhash, substring_dedup, toxicity, url_filter
from ordertape.llm.queries import RULES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, fp string, k1 string, score string"


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(k, t, lang, "x", "x", "x") for k, t in enumerate(texts)], DOCS)


def prose(seed, n, stem="w"):
    rng = np.random.default_rng(seed)
    return " ".join(f"{stem}{k}" for k in rng.integers(0, 5000, n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 400)
    words = base.split()
    near = " ".join(words[:200] + ["changed"] + words[201:])
    passage = prose(2, 60)
    return [
        base, near, base, None, "", "  \n", "one", "one two", "One two", prose(3, 20), f"{prose(4, 30)} {passage} {prose(5, 40)}",
        f"{passage}\n{prose(6, 10)}", " ".join(["ha"] * 90), prose(7, 34), prose(7, 34), prose(8, 35), prose(8, 35), prose(9, 30_000), "\u00e9t\u00e9 \u00c9T\u00c9 na\u00efve",
    ]


def test_simhash_equals_brute_force(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.classes(docs(spark, texts)).collect()}

    def brute(text):
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 3]), 42) for k in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    prints = [brute(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    assert got == {k: (f"{p:016x}", label[k]) for k, p in enumerate(prints)}


def test_simhash_tiles_of_a_crowded_key(spark):
    rng = np.random.default_rng(0)
    base = int(rng.integers(1 << 62))
    values = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 40, (120, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 40)})
    nodes = spark.createDataFrame([(v,) for v in values], "fp bigint")
    from ordertape.operators.components import connected_components

    for tile in (7, 2048):
        found = {r.node: r.component for r in connected_components(simhash.linked_fingerprints(nodes, tile=tile), "a", "b").collect()}
        label = {v: v for v in values}
        for _ in range(8):
            for x in values:
                for y in values:
                    if (x ^ y).bit_count() <= 3:
                        label[x] = label[y] = min(label[x], label[y])
        assert found == {v: c for v, c in label.items() if Counter(label.values())[c] > 1}


def test_keep_one_leaves_one_of_each_class(spark, texts):
    frame = docs(spark, texts)
    kept = simhash.keep_one(frame.unionByName(frame.where("doc_id = 9")))
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({r.component_id for r in simhash.classes(frame).collect()}) and kept.columns == frame.columns


def test_substring_dedup_equals_brute_force(spark, texts):
    rows = {r.doc_id: r for r in substring_dedup.digest(docs(spark, texts)).collect()}
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[p:p + 35]) for w in words for p in range(len(w) - 34))
    cleaned = {r.doc_id: r.text for r in substring_dedup.clean(docs(spark, texts)).collect()}
    for k, w in enumerate(words):
        cut = np.zeros(len(w), bool)
        for p in range(len(w) - 34):
            if seen[tuple(w[p:p + 35])] > 1:
                cut[p:p + 35] = True
        left = b" ".join(x for x, c in zip(w, cut) if not c)
        assert (rows[k].n_words, rows[k].n_removed, rows[k].kept_sha256) == (len(w), int(cut.sum()), hashlib.sha256(left).hexdigest())
        assert cleaned[k] == texts[k] if not cut.any() else " ".join(cleaned[k].split()).encode() == left
    assert substring_dedup.digest(docs(spark, []).where("false")).count() == 0


def test_html_text():
    page = (
        "<!DOCTYPE html><html><head><title>x</title><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies"
        "</div><article><h1>A &amp; B</h1><p><b>First  part<br>of it.<p>Second &lt;part&gt;&nbsp;here.</article><div id=comments><p>I disagree a lot, says a reader</p>"
        "</div><form><p>Send</p></form><footer>&copy; x</footer>"
    )
    assert html_text.main_text(page) == "A & B\nFirst part of it.\nSecond <part> here."
    assert [html_text.main_text(x) for x in (None, "", "just text", "<p>")] == ["", "", "just text", ""]
    assert html_text.main_text("<body><p>" + "word " * 50_000 + "</p></body>") == ("word " * 50_000).strip()


def test_html_wrappers_with_boilerplate_words():
    """Class words take out boilerplate beside the text, never the text that they wrap."""
    body = "<h1>Head</h1><p>First part of a text.</p><p>Second part of it.</p>"
    want = "Head\nFirst part of a text.\nSecond part of it."
    aside = "<div class='sidebar'><p>Elsewhere</p></div><div id=comments><article class=comment-body><p>" + "I disagree. " * 30 + "</p></article></div>"
    for mark in ("class='layout has-sidebar'", "class=no-sidebar", "class='page page--with-banner'", "class='news-alert'", "id='search-results'", "role=search"):
        assert html_text.main_text(f"<body><div {mark}><article>{body}</article></div></body>") == want
        assert html_text.main_text(f"<body><div {mark}>{body}</div></body>") == want
        assert html_text.main_text(f"<body><main><section {mark}>{body}</section></main></body>") == want
        assert html_text.main_text(f"<body><div {mark}><article>{body}</article>{aside}</div></body>") == want
        assert html_text.main_text(f"<body><div {mark}><article>{body}</article></div>{aside}</body>") == want
        assert html_text.main_text(f"<body><main><article>{body}</article>{aside}</main></body>") == want
    two = f"<section class=news-alert><article>{body}</article></section>" * 2
    assert html_text.main_text(f"<body>{two}</body>") == f"{want}\n{want}"
    share = "<div class='share social'><p>Tell others</p></div>"
    assert html_text.main_text(f"<body><article>{body}{share}</article></body>") == want
    teasers = "<div class=related>" + "<article><p>See this</p></article>" * 3 + "</div>"
    assert html_text.main_text(f"<body><main>{body}</main>{teasers}</body>") == want


def test_html_stray_quotes():
    """A quote opens a string only where a value begins, so a tag with stray quotes ends at its first '>'."""
    one = "<article><p>one</p><p title=Bob's>two</p><p>three</p></article>"
    two = '<article><p>one <a href="/x"">two</a> three</p><p>four <a href="/y">five</a></p></article>'
    assert html_text.main_text(one) == "one\ntwo\nthree"
    assert html_text.main_text(two) == "one two three\nfour five"
    assert html_text.main_text("<article><p 'a \"b>x</p><p title = 'a > b'>y</p><p title=a=\"b>z</p><p title= >q</p></article>") == "x\ny\nz\nq"
    assert html_text.main_text("<article><p>x</p><p title=it's class='ad'>y</p><p title='\" class=ad'>z</p></article>") == "x\nz"


def test_html_pages(spark):
    pages = spark.createDataFrame([(1, None, None, 3), (2, "u", "<p>a</p>", 3)], "page_id bigint, url string, html string, text int")
    assert [tuple(r) for r in html_text.extract(pages).orderBy("page_id").collect()] == [(1, None, "", 0), (2, "u", "a", 1)]
    assert html_text.extract(pages.where("false")).count() == 0


def test_chat_round_trip(spark):
    rows = [
        (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<|\\end|> <|\\\\turn|> <|turn|"),
        (1, 0, "user", "<|end|>\n<|turn|>assistant\nhi<|end|>\n"), (1, 2, "a\\n\nx<|end|>", None), (2, 0, None, ""), (2, 1, "assistant", "<"), (2, 2, "user", "|turn|>"),
        (None, None, None, None), (3, 1, "assistant", "<|<|end|>end|>\u00e9\U0001F600"), (3, 1, "assistant", "<|<|end|>end|>\u00e9\U0001F600"), (4, 0, "assistant", "\\s\\n" * 3),
    ]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_turns(frame)
    source = {}
    for c, t, role, text in rows:
        source.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for r in formatted.collect():
        turns = [(a, b) for _, a, b in sorted(source[r.conv_id])]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert len(r.loss_spans) == sum(role == "assistant" for role, _ in turns)
        for span in r.loss_spans:
            assert r.formatted[span.stop:].startswith("<|end|>\n") and r.formatted[:span.start].endswith("assistant\n")
    for r in chat.digest(formatted).collect():
        turns = [(a, b) for _, a, b in sorted(source[r.conv_id])]
        loss = "".join(b for a, b in turns if a == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    plan = chat.digest(formatted)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_loss_is_read_through_its_mask(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b\U0001F600<|end|>c"), (1, 2, "assistant", "d")], "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_turns(frame)
    row = chat.digest(formatted).first()
    assert (row.loss_chars, row.loss_sha256) == (11, hashlib.sha256("b\U0001F600<|end|>cd".encode()).hexdigest())
    moved = formatted.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct(s["start"].alias("start"), (s["stop"] - 1).alias("stop"))))
    row = chat.digest(moved).first()
    assert (row.loss_chars, row.loss_sha256) == (9, hashlib.sha256("b\U0001F600<|end|>".encode()).hexdigest())


def test_packing_equals_the_tokenizer(spark, texts):
    from tokenizers import Tokenizer

    texts = [*texts, "don't <|endoftext|> \ufb01 \u0130x 123abc \u00a0 y"]
    packed = packing.pack(packing.pieces(docs(spark, texts), tokenizer_path()), shard=8).collect()
    full = Tokenizer.from_file(tokenizer_path())
    expected = set()
    for k, t in enumerate(texts):
        ids = np.array(full.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for n, a in enumerate(range(0, len(ids), 2048)):
            expected.add((k, n, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed} == expected and len(packed) == len(expected)
    by_sequence = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert by_sequence.get(r.sequence_id, 0) == r.offset
        by_sequence[r.sequence_id] = r.offset + r.length
    assert max(by_sequence.values()) <= 2048


def test_packing_reads_new_words_without_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng, full = np.random.default_rng(11), Tokenizer.from_file(tokenizer_path())
    letters = np.array([*"abcdeinorstTHEXz\u00e9\u00c9\u00df\u00fc0179,.&!-(\"@"])
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 49))) for _ in range(300)) for _ in range(10)]
    tok = packing.ChunkTokenizer(tokenizer_path())
    tok.full = tok.model = None
    ids, bounds = tok.texts(pa.array([*texts, None]))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in full.encode_batch([*texts, ""], add_special_tokens=False)]


@pytest.mark.parametrize("kind", ["string", "large_string"])
def test_packing_of_odd_chunks_equals_the_tokenizer(kind):
    import pyarrow as pa

    rng, tok = np.random.default_rng(12), packing.ChunkTokenizer(tokenizer_path())
    letters = np.array([*"abcdefTHEing  019'<|>&.\t", *"\u00c0\u00de\u00df\u00ff\u00d7\u00f7\u00aa\u00b5\u0130\u01c5\u03a3\ufb01\u0301\u2028\u00a0\u4e2d\x01\x1c\x7f"])
    texts = ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(4000)]
    texts += ["a" * n for n in (47, 48, 49, 3000)] + ["<|endoftext|>", "x<|EndOfText|>y", "x<|endoftext|>y,", "don't we'LL", None, ""]
    ids, bounds = tok.texts(pa.array(texts, getattr(pa, kind)()).slice(2))
    wanted = tok.full.encode_batch([t or "" for t in texts[2:]], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in wanted]


def test_packing_improves_on_random_order():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 1400, 300).tolist()
    best = packing.evolve(sizes, 2048, 1, [], 10)
    load = np.bincount(best, sizes)
    assert load.max() <= 2048 and len(load) <= -(-sum(sizes) // 2048) + 2


def test_language(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    profiles = langid.train(table)
    odd = langid.predict(docs(spark, [None, "", "12 34 !?", "The and of"]).drop("score"), profiles).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd][:3] == ["und"] * 3 and odd[0].score == 0.0
    # the lookup equals the cosine with a bundled text vector
    text = "letters and more letters"
    codes = langid._codes(text, langid.symbol_table())
    c = langid.letter_vectors()
    vector = sum(np.roll(c[g // 4096], 2) * np.roll(c[g // 64 % 64], 1) * c[g % 64] for g in codes)
    grams, n = np.unique(codes, return_counts=True)
    assert np.argmax(n @ profiles.dots[grams]) == profiles.languages.index(langid._score(text, langid.symbol_table(), profiles)[0])
    one = langid.prototypes(["x"], np.bincount(codes, minlength=64**3)[None])
    assert n @ one.dots[grams][:, 0] == pytest.approx(np.linalg.norm(vector) / np.sqrt(langid.DIM), rel=1e-3)
    assert langid.predict(docs(spark, ["abc"]).drop("score"), langid.train(docs(spark, [None]))).first().lang_pred == "und"


def test_toxicity_and_identity_terms(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        words = prose(k, 30).split()
        words.insert(3, "women" if rng.random() < (0.5 if toxic else 0.1) else "people")
        if toxic:
            words.insert(5, ["idiot", "moronic", "scum"][k % 3])
        rows.append((k, " ".join(words)))
        labels.append((k, 0, int(toxic)))
    frame = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels, (None, 0, 1), (5, 0, None)], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.judge(frame, marks).collect()}
    held = [k for k in range(600) if found[k].held_out]
    assert all(found[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(600))
    assert sum(found[k].predicted == labels[k][2] for k in held) >= 0.95 * len(held)
    assert 0 <= found[9000].score <= 1 and found[9000].score == found[9001].score
    model = toxicity.train(frame, marks)
    score = lambda t: model.score(toxicity.buckets_of(toxicity.words_of(t), {}))
    assert abs(score("the women came home") - score("the men came home")) < 0.1 and score("the women came home") < 0.5
    assert toxicity.fit([], [], []).weights.any() == False  # noqa: E712


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "HTTPS://WWW.Example.COM/en/1", "http://example.com/en/7?x=1", "http://a.example.com/en/71#t", "http://x.net/de/1",
        "http://example.net/de/8", "http://example.net/fr", "http://badcom/en/", "http://com/en/", "a://b.org/es/x://y",
    ]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls * 3)], "page_id bigint, url string, host string")
    found = {r.page_id: r for r in url_filter.judge(pages, RULES).collect()}

    def brute(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fit = [r.split(" ")[1] for r in RULES]
        fit = [t for t in fit if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/"):])]
        return host, path, max(fit, key=len, default=None)

    verdict = {r.split(" ")[1]: r.split(" ")[0] for r in RULES}
    for k, r in found.items():
        assert (r.host, r.path, r.rule) == brute(urls[k % len(urls)])
        assert r.verdict == (verdict[r.rule] if r.rule else "block" if r.score >= 0.5 else "allow")
    assert url_filter.judge(pages.where("false"), RULES).count() == 0
    model = url_filter.fit([f"http://h{k}.example.com/{'ads' if k % 2 else 'news'}/{k}" for k in range(400)], [k % 2 for k in range(400)])
    assert (model.block_score(["http://q.example.com/ads/9", "http://q.example.com/news/9"]) > 0.5).tolist() == [True, False]


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    near = base[:20] + 0.05 * rng.normal(size=(20, 16))
    rows = [x.astype(np.float32).tolist() for x in np.concatenate((base, near, base[:5], base[5:8] * 3))]
    rows += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15]
    frame = spark.createDataFrame([(k, r, 1) for k, r in enumerate(rows)], "vec_id bigint, embedding array<float>, links int")
    found = {r.vec_id: r for r in embed_dedup.near_duplicates(frame).collect()}
    good = [k for k, r in enumerate(rows) if r and all(x is not None and np.isfinite(x) for x in r) and any(r)]
    x = np.array([rows[k] for k in good], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= 0.9
    label = {k: k for k in range(len(rows))}
    for _ in range(6):
        for a, b in zip(*np.nonzero(close)):
            label[good[a]] = label[good[b]] = min(label[good[a]], label[good[b]])
    links = {k: 0 for k in range(len(rows))} | {good[a]: int(close[a].sum()) - 1 for a in range(len(good))}
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in found.items()} == {k: (links[k], label[k], label[k] == k) for k in range(len(rows))}
    assert embed_dedup.near_duplicates(frame.where("false")).count() == 0


@pytest.mark.parametrize("rank", [6, 64])
def test_embedding_recall_with_hundreds_of_lists(spark, monkeypatch, rank):
    """No link is lost at the lists' borders, also where the vectors vary in few of their dimensions."""
    rng = np.random.default_rng(rank)
    x = rng.normal(size=(1200, rank)) @ np.linalg.qr(rng.normal(size=(64, rank)))[0].T
    x /= np.linalg.norm(x, axis=1)[:, None]
    step = rng.normal(size=(1200, rank)) @ np.linalg.qr(x.T @ rng.normal(size=(1200, rank)))[0].T
    step -= (step * x).sum(axis=1)[:, None] * x
    step /= np.linalg.norm(step, axis=1)[:, None]
    x = np.concatenate((x, 0.905 * x + np.sqrt(1 - 0.905**2) * step)).astype(np.float32)
    monkeypatch.setattr(embed_dedup, "LIST_SIZE", 12)
    monkeypatch.setattr(embed_dedup, "TILE", 10)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(frame).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    assert found == dict(enumerate(((u @ u.T >= 0.9).sum(axis=1) - 1).tolist()))


def test_decontamination(spark):
    item = "What is the tallest mountain of the northern valley called by its first settlers? It is called the grey old watchman of the pass."
    other = prose(11, 40)
    bench = spark.createDataFrame([(1, item, 0), (2, other, 0), (3, None, 0), (4, "", 0), (2, other, 0)], "item_id bigint, text string, doc_id int")
    texts = [
        f"{prose(20, 300)} {item.upper()} {prose(21, 500)}", prose(22, 900), None, "", f"{prose(23, 58)} {other}", " ".join(item.split()[:8]) + " " + prose(24, 100), other, item,
    ]
    hits = {(r.doc_id, r.item_id) for r in decontam.find(docs(spark, texts), bench).collect()}
    assert hits == {(0, 1), (4, 2), (6, 2), (7, 1)}
    assert sorted(r.doc_id for r in decontam.keep_clean(docs(spark, texts), bench).collect()) == [1, 2, 3, 5]
    assert decontam.find(docs(spark, texts), bench.where("false")).count() == 0


def test_decontamination_of_items_with_a_detached_last_quote(spark):
    """A last part of punctuation only is no answer; such an item is found like any other."""
    items = [f"Quelle est la capitale de la grande vall\u00e9e du nord ? C'est la vieille ville de Paris. {end}" for end in ("\u00bb", "\u2026", "\u201d\n\u201d")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    hits = {(r.doc_id, r.item_id) for r in decontam.find(docs(spark, [f"{prose(30, 90)} {items[0]} {prose(31, 50)}", prose(32, 80)]), bench).collect()}
    assert hits == {(0, 0), (0, 1), (0, 2)}
    assert decontam.question_and_answer(items[0].encode())[1] == "c est la vieille ville de paris".encode().split()


def test_decontamination_of_a_copy_with_inserted_words():
    """A near copy of the longest item is seen whole, wherever it begins."""
    item = prose(40, 60).split()
    index = decontam.build([1, 2], [" ".join(item).encode(), prose(41, 20).encode()])
    copy = " ".join(item[:30] + prose(42, 20, "v").split() + item[30:])
    for before in range(0, 130, 5):
        texts = [None, b"", f"{prose(43, before, 'u')} {copy} {prose(44, 100, 'u')}".encode(), b"", prose(45, 70).encode(), copy.encode()]
        hits = decontam.search_all(index, texts)
        assert [[h.item for h in x] for x in hits] == [[], [], [0], [], [], [0]] and hits[2][0].overlap > 0.9


def test_wand_equals_scoring_everything():
    items = [prose(k, 30, "t").encode() for k in range(60)]
    items = [b" ".join(w.replace(b"t", b"") [:2] + b"q" for w in t.split()) for t in items]
    index = decontam.build(list(range(60)), items)
    for k in range(20):
        terms = sorted({index.vocab[w] for w in decontam.words_of(items[k] + b" " + items[k + 1])})
        scores = {}
        for t in terms:
            for i, x in zip(index.items[t], index.impacts[t]):
                scores[i] = scores.get(i, 0) + x
        for threshold in (0.3, 0.6, 0.9):
            assert {i for i, _ in decontam.wand(index, terms, threshold)} == {i for i, s in scores.items() if s >= threshold - 1e-9}
