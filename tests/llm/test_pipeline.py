import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
SMALL = "/root/testdata/sf0.001"


def test_stages_keep_their_contracts(spark):
    import corpus_pipeline
    from ordertape.llm import simhash
    from ordertape.plans import stage

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, apply in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage.save(apply(spark, docs, SMALL), name)
        counts.append(docs.count())
        assert docs.columns == columns
        if name == "near_dedup":
            assert counts[-1] == simhash.classes(before).select("component_id").distinct().count()
        if name == "passage_dedup":
            assert counts[-1] == counts[-2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == counts[-1]
    assert counts == sorted(counts, reverse=True)


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{k}" for k in range(1, 11)] and "pipeline" in names
    with pytest.raises(KeyError):
        __spark_entry__.oracle_sql()["pipeline"]


def _fingerprint(text):
    import xxhash

    words = text.lower().encode().split()
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_run_equals_a_plain_pipeline(spark, tmp_path):
    """All five stages against a version without keys, indexes or searches."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from ordertape.llm.queries import tokenizer_path

    syllables = "ka to mi re su na lo pe vi da".split()

    def prose(seed, n):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices(syllables, k=rng.randint(2, 5))) for _ in range(n))

    item = "Which of the seven old bridges over the river was the last to be closed to carts ? It was the narrow bridge below the mill ."
    passage, base = prose(70, 60), prose(71, 300)
    near = " ".join(base.split()[:150] + ["other"] + base.split()[151:])
    texts = {
        1: base, 2: base, 3: near, 4: f"{prose(72, 80)} {passage} {prose(73, 50)}", 5: f"{passage} {prose(74, 90)}", 6: None, 7: "12 34 !?",
        8: f"{prose(75, 100)} {item} {prose(76, 100)}", 9: prose(77, 3000), 10: "one two", 11: f"{prose(78, 40)}\n{passage}", 12: "zozo " * 900,
    }
    rows = [(k, t, None if k == 12 else "en" if k % 3 else "de", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(79, 30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # a repeated word is like no language; letters must occur
    kept = {k: t for k, t in texts.items() if t and any(c.isalpha() for c in t) and k != 12}
    prints = {k: _fingerprint(t) for k, t in kept.items()}
    label = {k: k for k in kept}
    for _ in kept:
        for a in kept:
            for b in kept:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    kept = {k: t for k, t in kept.items() if label[k] == k}
    windows = {}
    for k, t in kept.items():
        words = t.split()
        for a in range(len(words) - 34):
            windows.setdefault(tuple(words[a:a + 35]), []).append((k, a))
    gone = {k: set() for k in kept}
    for places in windows.values():
        for k, a in places if len(places) > 1 else ():
            gone[k].update(range(a, a + 35))
    kept = {k: " ".join(w for n, w in enumerate(t.split()) if n not in gone[k]) for k, t in kept.items()}
    assert any(gone.values()) and len(kept) < 10
    kept = {k: t for k, t in kept.items() if item not in t}
    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected = {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in kept.items()}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes, bins = {}, {}
    for r in found:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sizes == expected and 8 not in sizes and 12 not in sizes
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(expected.values()) // 2048)
