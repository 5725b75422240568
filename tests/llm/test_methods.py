"""The methods themselves: indexes, models and searches against brute force, and the defined cases of every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordertape.llm import chat, decontam, embed_dedup, html_text, langid, packing, simhash, substring_dedup, toxicity, url_filter
from ordertape.llm.common import settings
from ordertape.llm.queries import RULES, tokenizer_path
from tests.llm.test_operators import docs, prose


def test_fingerprint_index_grows_batch_by_batch(spark, tmp_path):
    """Runs are merged bucket by bucket without moving or sorting the history, and a later session continues them."""
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 3000)), 1, int(rng.integers(0, 1 << 40)), k, k % 7) for k in range(9000)]
    batch = spark.createDataFrame(rows, "hash bigint, weight bigint, k1 bigint, k2 bigint, at int")
    part = lambda k: batch.where(F.pmod("k2", F.lit(3)) == k)
    folder = f"file://{tmp_path}/index"
    index = substring_dedup.FingerprintIndex(spark, folder)
    index.add(part(0))
    index.add(part(1))
    again = substring_dedup.FingerprintIndex(spark, folder)
    assert (again.number, again.buckets) == (2, index.buckets)
    with settings(spark, **again.settings()):
        merged = again.merged(part(2))
        merged.write.format("noop").mode("overwrite").save()
        plan = merged._jdf.queryExecution().executedPlan().toString()
    history = plan[plan.index("SortMergeJoin"):plan.index("HashAggregate")]
    assert "Bucketed: true" in history and "Exchange" not in history.split("FileScan")[0]
    again.add(part(2))
    counts: dict[int, int] = {}
    for h, *_ in rows:
        counts[h] = counts.get(h, 0) + 1
    assert {r.hash: r.n for r in again.run.collect()} == counts
    once = {(r.k1, r.k2, r.at) for r in again.single().collect()}
    assert once == {(a, b, c) for h, _, a, b, c in rows if counts[h] == 1}
    again.drop()


def test_windows_are_compared_by_their_words():
    text = "a b  c\td ".encode() * 20
    words = text.split()
    found = substring_dedup.window_digests(text, np.arange(len(words) - 34))
    content = [b" ".join(words[k:k + 35]) for k in range(len(words) - 34)]
    for a in range(len(content)):
        for b in range(len(content)):
            assert (found[a].tolist() == found[b].tolist()) == (content[a] == content[b])


def _links(x, cosine=0.9):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    return u @ u.T >= cosine


@pytest.mark.parametrize(("sure", "least"), [(1.0, 0.999), (0.99, 0.95)])
def test_embedding_search_over_many_lists_and_parts(spark, sure, least):
    """A third of the vectors in one tight group, cut into parts on both sides; no link is made up and few or none are lost."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(900, 32))
    x = np.concatenate((base, base[0] + 0.02 * rng.normal(size=(500, 32)), base[:100] + 0.05 * rng.normal(size=(100, 32)))).astype(np.float32)
    close = _links(x)
    rows = [(k, v.tolist(), 1, 2) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, list int, vector int")
    found = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(frame, list_size=16, tile=100, visitors=150, sure=sure).collect()}
    got, wanted = np.array([found[k] for k in range(len(x))]), close.sum(axis=1) - 1
    assert (got <= wanted).all() and got.sum() >= least * wanted.sum()


def test_embedding_of_doubles_and_null_ids(spark):
    # two vectors whose cosine is below the limit in double precision, and above it once rounded to single precision
    close = [1.0, 0.0], [0.9 - 1e-12, float(np.sqrt(1 - 0.9**2))]
    rows = [(1, close[0]), (2, close[1]), (None, [-5.0, 5.0]), (None, [-5.0, 5.0]), (7, [1.0, 2.0, 3.0]), (8, [2.0, 4.0, 6.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embed_dedup.near_duplicates(frame).collect())
    assert found == [(0, 1, 0), (0, 1, 0), (1, 0, 1), (2, 0, 2), (7, 1, 7), (8, 1, 7)]


def test_genetic_search_beats_best_fit():
    for seed in range(3):
        rng, sizes = np.random.default_rng(seed), []
        for _ in range(60):  # triples that fill a sequence exactly
            a = int(rng.integers(520, 900))
            b = int(rng.integers(520, 2048 - a - 510))
            sizes += [a, b, 2048 - a - b]
        plain = len(packing.Packing(sizes, 2048).fill(list(range(180))).bins)
        found = packing.evolve(sizes, 2048, 1, [], packing.GENERATIONS)
        assert max(np.bincount(found, sizes)) <= 2048 and 60 <= max(found) + 1 <= 62 < plain


def test_html_defects_of_the_first_round():
    article = "<article><p>Hello there, this is the text.</p>{}</article><div class=ad>buy</div>"
    assert html_text.main_text(article.format("<p class=a hidden>secret</p>")) == "Hello there, this is the text."
    assert html_text.main_text(article.format("<div class='legal'>law</div><p id='search'>how to search</p>")).endswith("law\nhow to search")
    assert html_text.main_text(article.format("<div class='share'>tweet</div><form><p>Sign up</p></form>")) == "Hello there, this is the text."
    assert html_text.main_text("<body><form action=x><h1>Title</h1><p>All of this page is in a form.</p><button>go</button></form></body>") == "Title\nAll of this page is in a form."


@pytest.mark.parametrize("tag", ["<b>", "<div>", "<a href=x>y", "<u><div><i>", "<p class=a>x</u></section>"])
def test_html_of_hostile_nesting_takes_linear_time(tag):
    import time

    began = time.process_time()
    assert html_text.main_text("<body>" + tag * 20_000 + "text").endswith("text")
    assert time.process_time() - began < 5


def test_url_statistics_are_out_of_fold():
    """Hosts that occur once say nothing about other urls: their own label must not reach the trees through the statistics."""
    rng = np.random.default_rng(2)
    urls = [f"http://h{k}.x{k}.org/p{k}" for k in range(600)]
    label = rng.integers(0, 2, 600).tolist()
    model = url_filter.fit(urls, label)
    fresh = model.block_score([f"http://g{k}.y{k}.org/q{k}" for k in range(300)])
    seen = model.block_score(urls)
    assert abs(fresh.mean() - np.mean(label)) < 0.25 and np.mean((seen > 0.5) == label) < 0.9


def test_url_trees_equal_a_walk(spark):
    rng = np.random.default_rng(3)
    urls = [f"http://{'ads' if k % 3 else 'www'}.site{k % 17}.com/{'x' * int(rng.integers(1, 30))}?a={k}" for k in range(400)]
    model = url_filter.fit(urls, [int(k % 3 > 0) for k in range(400)])
    x = model.features(urls[:50])
    for row, z in zip(x, model.raw(x)):
        total = url_filter._logit(model.prior)
        for feature, threshold, left, right, value in model.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] if row[feature[at]] <= threshold[at] else right[at]
            total += value[at]
        assert total == pytest.approx(z)
    long = "http://a.com/" + "y" * 3_000_000
    found = url_filter.judge(spark.createDataFrame([(1, long), (None, None)], "page_id bigint, url string"), RULES, model=model).collect()
    assert len(found) == 2 and {r.host for r in found} == {"a.com", ""}


def test_decontamination_equals_brute_force(spark):
    """Items and passages of few words, so that the bounds have something to do; compared without any index."""
    rng = np.random.default_rng(4)
    vocabulary = [f"v{k}" for k in range(120)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [f"{say(12)}? {say(6)}." for _ in range(90)]
    texts = []
    for k in range(60):
        parts = [say(int(rng.integers(5, 60)))]
        if k % 2:
            words = items[int(rng.integers(90))].split()
            if k % 4 == 1:
                words[int(rng.integers(len(words)))] = "changed"
            parts += [" ".join(words), say(int(rng.integers(5, 60)))]
        texts.append(" ".join(parts))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find(docs(spark, texts), bench).collect()}
    index = decontam.build(list(range(90)), [t.encode() for t in items])
    stride = index.longest
    expected = set()
    for d, text in enumerate(texts):
        words = decontam.words_of(text.encode())
        for start in range(0, len(words) // stride * stride + 1, stride):
            passage = words[start:start + decontam.SPAN * stride]
            for i, item in enumerate(items):
                own = {w: index.impacts[t][index.items[t].index(i)] for w, t in index.vocab.items() if i in index.items[t]}
                score = sum(x for w, x in own.items() if w in passage)
                question, answer = decontam.question_and_answer(item.encode())
                share = lambda part: (lambda s: len(s & decontam.shingles(passage, len(next(iter(s))))) / len(s))(decontam.shingles(part))  # noqa: B023, E731
                if score >= decontam.THRESHOLD - 1e-9 and share(decontam.words_of(item.encode())) >= decontam.OVERLAP and share(question) >= 0.5 and share(answer) >= 0.5:
                    expected.add((d, i))
    assert found == expected and len(expected) > 15


def test_language_scores_equal_bundled_vectors(spark):
    """Prototypes and texts bundled as vectors, without the table of dot products."""
    texts = [(k, f"{word} " * 20, lang) for k, (word, lang) in enumerate([("hello world", "en"), ("guten tag welt", "de"), ("bonjour monde", "fr"), ("the quick fox", "en")])]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    profiles = langid.train(frame)
    letters, table = langid.letter_vectors().astype(np.float64), langid.symbol_table()

    def bundle(text):
        out = np.zeros(langid.DIM)
        for code in langid._codes(text, table):
            a, b, c = code // langid.SYMBOLS**2, code // langid.SYMBOLS % langid.SYMBOLS, code % langid.SYMBOLS
            out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return out

    protos = {lang: sum(bundle(t) for _, t, g in texts if g == lang) for lang in profiles.languages}
    for probe in ("hello fox", "guten morgen welt", "le monde", "zzz qqq"):
        v = bundle(probe)
        dots = {lang: float(v @ p / np.linalg.norm(p)) for lang, p in protos.items()}
        name, score = langid._score(probe, table, profiles)
        assert name == max(sorted(dots), key=dots.__getitem__)
        grams = np.unique(langid._codes(probe, table), return_counts=True)[1]
        assert score == pytest.approx(min(1.0, max(0.0, max(dots.values()) / np.sqrt(langid.DIM * (grams**2.0).sum()))), abs=1e-3)


def test_counterfactual_penalty_lowers_false_positives():
    """Half of the toxic training texts mention a group; with the penalty a neutral mention no longer counts against a text."""
    rng = np.random.default_rng(6)
    memo: dict = {}
    feats, labels, swaps = [], [], []
    for k in range(600):
        toxic = k % 2
        words = {f"w{j}" for j in rng.integers(0, 300, 12)} | ({f"bad{int(rng.integers(6))}"} if toxic and rng.random() < 0.7 else set())
        if rng.random() < (0.6 if toxic else 0.05):
            words.add("muslims")
        feats.append(toxicity.buckets_of(words, memo))
        labels.append(toxic)
        swaps += toxicity.swaps_of(words, memo)
    neutral = [toxicity.buckets_of({f"w{j}" for j in rng.integers(0, 300, 12)} | {"muslims"}, memo) for _ in range(300)]
    toxic = [toxicity.buckets_of({f"w{j}" for j in rng.integers(0, 300, 12)} | {"bad1"}, memo) for _ in range(300)]
    wrong, caught = {}, {}
    for swap in (0.0, 1.0):
        model = toxicity.fit(feats, labels, swaps, swap=swap)
        wrong[swap] = np.mean([model.score(f) >= 0.5 for f in neutral])
        caught[swap] = np.mean([model.score(f) >= 0.5 for f in toxic])
    assert wrong[1.0] < 0.5 * wrong[0.0] and caught[1.0] >= 0.9


NAMES = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, k1 string, score string, lang_pred string, key string"


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with the operators' own names."""
    long = prose(50, 60_000)
    rows = [(None,) * 10, (1, None, None, None, None, "x", "x", "x", "x", "x"), (2, "", "en", "s", 0, *"xxxxx"), (3, long, "en", "s", len(long), *"xxxxx"),
            (3, long, "en", "s", len(long), *"xxxxx"), (4, "short text", "de", "s", 10, *"xxxxx"), (None, "short text", None, None, None, *"yyyyy")]
    return spark.createDataFrame(rows, NAMES)


def test_every_operator_takes_odd_rows(spark, odd):
    n = odd.count()
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (None, 1, 1), (2, None, None)], "doc_id bigint, toxic int, text int")
    bench = spark.createDataFrame([(1, "what is it ? it is this here and now"), (None, None)], "item_id bigint, text string")
    for frame, rows in ((odd, n), (odd.where("false"), 0)):
        assert toxicity.judge(frame, labels).count() == rows
        assert toxicity.judge(frame, labels.where("false")).count() == rows
        assert substring_dedup.digest(frame).count() == rows
        assert simhash.classes(frame).count() == rows
        assert langid.identify(frame).count() == rows
        assert decontam.find(frame, bench).count() == 0
        packed = packing.pack(packing.pieces(frame, tokenizer_path()))
        assert packed.select("copy").distinct().count() == rows
        turns = frame.select(F.col("doc_id").alias("conv_id"), "doc_id", F.col("n_chars").alias("turn"), F.col("lang").alias("role"), "text", F.lit("x").alias("formatted"))
        assert chat.digest(chat.format_turns(turns)).select(F.coalesce(F.sum("n_turns"), F.lit(0)).alias("n")).first().n == rows
        pages = frame.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.col("text").alias("url"), F.lit("x").alias("host"))
        assert html_text.extract(pages).count() == rows
        assert url_filter.judge(pages, RULES).count() == rows


def test_filters_keep_columns_of_any_name(spark, odd):
    bench = spark.createDataFrame([(1, "short text", "x")], "item_id bigint, text string, doc_id string")
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 5  # copies of 3 are one row; 1 and 2 are one class, rows without an id stay
    cut = substring_dedup.clean(odd, chars_col="n_chars")
    assert cut.columns == odd.columns and cut.count() == odd.count() and cut.where("doc_id = 3 and text = '' and n_chars = 0").count() == 2
    clean = decontam.keep_clean(odd, bench)
    assert clean.columns == odd.columns and clean.where("text = 'short text'").count() == 0
    judged = langid.predict(odd, langid.train(odd))
    assert judged.count() == odd.count() and sorted(judged.columns) == sorted(odd.columns)
    for f in (simhash.keep_one, substring_dedup.clean, lambda d: decontam.keep_clean(d, bench)):
        assert f(odd.where("false")).count() == 0


def test_pipeline_stages_take_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline
    from ordertape.plans import stage

    bench = spark.createDataFrame([(1, "short text")], "item_id bigint, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    counts = []
    for name, apply in corpus_pipeline.STAGES:
        empty = apply(spark, docs.where("false"), str(tmp_path))
        assert empty.count() == 0
        docs = stage.save(apply(spark, docs, str(tmp_path)), name)
        counts.append(docs.count())
    # without text or letter: three rows go; then the copy of 3 and, by its text, nothing else
    assert counts[0] == 4 and counts[1] == 3 and counts[2] == 3 and counts[3] == 1
