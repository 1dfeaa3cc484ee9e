"""Joins, repeats, media, language, toxicity and the pipeline against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import language_id, media_avi, ngram_join, repeated_bytes, toxicity
from marlstone.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, rep string, d string, draws string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, lang="en"):
    rows = [(i, t, lang[i] if isinstance(lang, list) else lang, f"s{i % 3}", len(t or ""), "x", "r", "d", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def linked(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def near_copies(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))] for _ in range(12)]
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    out = []
    for _ in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        if rnd.random() < 0.3:
            words += passage
        out.append((rnd.choice([" ", "\n", " \t"])).join(w.upper() if rnd.random() < 0.1 else w for w in words))
    return out + [None, "", "  ", "one two", "ONE two", out[0], out[0], "é É a b c", "É é a b c"]


def test_similarity_components(spark):
    texts = near_copies(1, 260)
    rows = ngram_join.similar_groups(frame(spark, texts)).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in rows} == linked(texts)
    assert len(rows) == len(texts)


def test_similarity_of_repeated_ids_and_rows(spark):
    own = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    half = " ".join([*(f"a{i}" for i in range(20)), *(f"x{i}" for i in range(10))])  # below 0.8 of the first
    near = own[1] + " more"
    given = [(3, own[0]), (5, own[0]), (5, own[1]), (9, own[1]), (11, near), (12, half), (3, own[0]), (12, half), (5, None), (20, own[2]), (20, own[3]), (1, own[3])]
    rows = ngram_join.similar_groups(spark.createDataFrame(given, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in rows) == [
        (1, 26, 1), (3, 26, 3), (3, 26, 3), (5, 0, 5), (5, 26, 3), (5, 26, 5), (9, 26, 5), (11, 27, 5), (12, 26, 12), (12, 26, 12), (20, 26, 1), (20, 26, 20)
    ]
    # repeated rows alone: their overlaps count once, and each is a row of the result
    rows = ngram_join.similar_groups(spark.createDataFrame([(3, own[0]), (3, own[0]), (12, half), (12, half)], "doc_id long, text string")).collect()
    assert sorted((r.id, r.component_id) for r in rows) == [(3, 3), (3, 3), (12, 12), (12, 12)]


def test_near_duplicates_of_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as pipeline

    own = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    given = [(3, own[0]), (5, own[0]), (5, own[1]), (9, own[1] + " more"), (None, own[2]), (None, own[2]), (None, own[3]), (4, own[3]), (7, None), (7, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in given], "doc_id long, text string, __group string")
    got = pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in got.collect()) == sorted([(3, own[0]), (5, own[1]), (0, own[2]), (4, own[3]), (7, ""), (7, ""), (7, "")])


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (99, 101)], "x long, y long")
    got = {r.id: r.label for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99, 101: 99}


def without_repeats(texts):
    first, out = {}, {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k + 1 : k + 51] = True
        kept = bytes(x for x, g in zip(b, gone[1:-1], strict=True) if not g)
        out[i] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_bytes(spark):
    rnd = random.Random(5)
    parts = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(10, 200))) for _ in range(30)]
    texts = ["".join(rnd.choice(parts) if rnd.random() < 0.6 else "".join(rnd.choice("xyz ñ") for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(0, 8))) for _ in range(200)]
    texts += ["a" * 200, "a" * 49, "a" * 50, "a" * 51, "ab" * 100, "ba" * 60, None, "", texts[3], texts[3]]
    rows = repeated_bytes.remove_repeats(frame(spark, texts).repartition(5)).collect()
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == without_repeats(texts)


def test_a_passage_of_most_documents(spark):
    rnd = random.Random(6)
    own = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passage = own(140)
    texts = [own(rnd.randint(0, 60)) + passage + own(rnd.randint(0, 60)) for _ in range(260)] + [own(90) for _ in range(20)] + [passage + "z" * 400 + passage]
    docs = frame(spark, texts).repartition(3).select(F.col("doc_id").alias("id"), "text")
    keys = {}
    records = repeated_bytes.records(np.arange(len(texts)), [t.encode() for t in texts], None)
    for r in repeated_bytes.first_of_context(records)[0]:
        keys.setdefault(int(r["key"]), set()).add(int(r["id"]))
    assert max(map(len, keys.values())) >= repeated_bytes.FREQUENT  # such keys take the way by windows
    rows = repeated_bytes.remove_repeats(docs, "id").collect()
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == without_repeats(texts)


def test_windows_of_frequent_keys(spark, monkeypatch):
    w = np.array([(7, 3, 10), (7, 5, 0), (7, 3, 10), (7, 3, 40), (8, 5, 1)], repeated_bytes.WINDOW)
    firsts, spans = repeated_bytes.first_of_window(w)
    assert firsts.tolist() == [(7, 3, 10), (7, 3, 40), (8, 5, 1)] and spans.tolist() == [(5, 0, 50)]
    # all keys of two or more documents take the way of frequent ones
    monkeypatch.setattr(repeated_bytes, "FREQUENT", 2)
    test_repeated_bytes(spark)


def test_media_round_trip(spark):
    texts = ["é" * 700, "x", None, "", "abc " * 9000, "a" * 64, "a" * 65, "a" * 1024, "a" * 1025]
    for r in media_avi.store(frame(spark, texts)).collect():
        raw = (texts[r.id] or "").encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert media_avi.read_back(bytes(r.media))[0] == payload
        assert r.clips[0].start_s == 0 and all(a.end_s == b.start_s for a, b in zip(r.clips, r.clips[1:]))


def test_any_baseline_scan_decodes_alike():
    rnd = np.random.default_rng(3)
    frames, _, _ = media_avi.parse_avi(media_avi.write_avi(rnd.integers(0, 256, 64 * 40, np.uint8).tobytes()))
    fast = media_avi.decode_frames(frames)
    for f, want in zip(frames, fast, strict=True):
        head, at = media_avi._read_head(f)
        assert (media_avi._decode_any(f[at:-2].replace(b"\xff\0", b"\xff"), head, media_avi.BLOCKS) == want).all()


def test_shots_are_cut_at_jumps():
    shares = np.zeros((30, 32))
    shares[:12, 3], shares[12:20, 9], shares[20:, 30] = 1, 1, 1
    assert media_avi.shots(shares) == [(0, 12), (12, 20), (20, 30)]
    assert media_avi.shots(shares[:1]) == [(0, 1)]


def test_context_trees_are_distributions():
    texts = {"a": [b"the cat sat on the mat "] * 30, "b": [b"der hund sass auf der matte "] * 30}
    trees = language_id.ContextTrees({k: language_id.gram_counts(v) for k, v in texts.items()})
    p = np.exp2(-trees.bits.astype(float)).reshape(-1, trees.size, 2).sum(1)
    assert np.allclose(p, 1, atol=1e-4)
    one = trees.code_lengths([b"the mat ", b"", b"der matte "])
    assert (one[1] == 0).all() and one[0].argmin() == 0 and one[2].argmin() == 1
    assert np.allclose(one, np.vstack([trees.code_lengths([t]) for t in (b"the mat ", b"", b"der matte ")]))


def test_code_lengths_are_those_of_a_plain_model(monkeypatch):
    """Two scripts, all their bytes told apart, against escape method C written out in full; long texts in parts cost the same."""
    rnd = random.Random(3)
    texts = {"aa": [" ".join(rnd.choice(["sol", "luna", "mar"]) for _ in range(30)).encode() + b" "], "bb": [" ".join(rnd.choice(["мир", "дом", "лес", "sol"]) for _ in range(30)).encode() + b" "]}
    trees = language_id.ContextTrees({k: language_id.gram_counts(v) for k, v in texts.items()})
    counts, seen = {}, {}
    for lang, own in texts.items():
        for t in own:
            padded = b"   " + t
            for i in range(3, len(padded)):
                for k in range(4):
                    counts.setdefault((lang, padded[i - k : i]), {}).setdefault(padded[i], 0)
                    counts[lang, padded[i - k : i]][padded[i]] += 1
                    seen[padded[i - k : i]] = seen.get(padded[i - k : i], 0) + 1
    known = sorted({b for v in texts.values() for t in v for b in t})
    assert trees.size == len(known) + 1

    def share(lang, context, byte):
        if context is None:
            return 1 / trees.size
        shorter = context[1:] if context else None
        own = counts.get((lang, context), {})
        if seen.get(context, 0) < language_id.LEAST and context or not own:
            return share(lang, shorter, byte)
        n, d = sum(own.values()), len(own)
        free = sum(share(lang, shorter, b) for b in [*known, -1] if b not in own)
        if byte in own:
            return own[byte] / (n + (d if free > 0 else 0))
        return d / (n + d) * share(lang, shorter, byte) / free

    text = "sol мир лесх luna".encode()
    padded = b"   " + text
    symbol = lambda b: b if b in known else -1
    want = [-sum(np.log2(share(lang, padded[i - 3 : i], symbol(padded[i]))) for i in range(3, len(padded))) for lang in ("aa", "bb")]
    assert np.allclose(trees.code_lengths([text, b""]), [want, [0, 0]], rtol=1e-4)
    monkeypatch.setattr(language_id, "PART", 5)
    assert np.allclose(trees.code_lengths([b"", text, b"sol "])[1], want, rtol=1e-4)


def test_language_of_held_out_documents(spark):
    rnd = random.Random(8)
    words = {"en": "the and of to in that house water", "de": "der und von zu das haus wasser nicht", "fr": "le et de à que maison eau été"}
    lang = [rnd.choice(list(words)) for _ in range(400)]
    texts = [" ".join(rnd.choice(words[x].split()) for _ in range(rnd.randint(3, 40))) for x in lang]
    texts += [None, "", "123 !?", "² 5"]
    docs = frame(spark, texts, lang + [None, "en", "de", "fr"])
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = language_id.identify(docs, held).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0)
        want = lang[r.id] if r.id < 400 else "und"
        assert r.lang_pred == want and 0 <= r.score <= 1
    nothing = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), held).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def toxic_corpus(n):
    rnd = random.Random(9)
    clean = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ran", "sol", "tem", "vud", "wix")]
    bad = ["grumf", "snark", "blerg"]
    texts, labels = [], []
    for i in range(n):
        words = [rnd.choice(clean) for _ in range(rnd.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(bad) + rnd.choice(["", "en", "ish"])
        texts.append(" ".join(words).capitalize() + ".")
        labels.append((i, int(i % 5 != 0), int(toxic)))
    return texts, labels


def test_toxic_documents_are_found(spark):
    texts, labels = toxic_corpus(900)
    docs = frame(spark, [*texts, None, ""])
    rows = toxicity.judge(docs, spark.createDataFrame(labels[:700], "doc_id long, quality int, toxic int")).collect()
    found = {r.doc_id: r.toxic for r in rows}
    assert sum(found[i] != bool(labels[i][2]) for i in range(700, 900)) <= 2
    assert not found[900] and not found[901]


def test_later_models_learn_from_out_of_fold_probabilities():
    rnd = np.random.default_rng(2)
    y = (rnd.random(300) < 0.4).astype(int)
    found = [np.array([0] if v and rnd.random() < 0.9 else [1]) for v in y]
    models = toxicity.fit_chain(found, 2, np.c_[y, y], np.arange(300) % 3)
    assert models[0]["earlier"] == [] and models[1]["earlier"][0] > 0


def test_the_last_link_decides(spark):
    """The verdict comes through the chain: other weights of an earlier link change it, and the scores are those of a plain loop."""
    texts, labels = toxic_corpus(300)
    docs, table = frame(spark, [*texts, None, ""]), spark.createDataFrame([*labels, (0, None, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    names = list(toxicity.label_categories())
    assert names[-1] == "toxic"
    chain = toxicity.train(toxicity.labelled_sample(docs, table, "doc_id", "text", toxicity.label_categories()), names)
    assert len(chain["models"][-1]["earlier"]) == len(names) - 1 and any(abs(x) > 0.1 for x in chain["models"][-1]["earlier"])
    rows = {r.doc_id: r for r in toxicity.scored(docs.select("doc_id", "text"), chain, names).collect()}
    for i, t in enumerate(texts):
        own, before = toxicity.features(t), []
        for k, m in enumerate(chain["models"]):
            z = m["bias"] + sum(w for f, w in zip(chain["words"], m["words"], strict=True) if f in own) + sum(a * b for a, b in zip(m["earlier"], before, strict=True))
            before.append(1 / (1 + np.exp(-z)))
            assert abs(rows[i][f"p_{names[k]}"] - before[-1]) < 1e-9
    for m in chain["models"][:2]:
        m |= {"bias": 30.0, "words": [0.0] * len(chain["words"])}
    other = {r.doc_id: r for r in toxicity.scored(docs.select("doc_id", "text"), chain, names).collect()}
    assert any((rows[i].p_toxic >= 0.5) != (other[i].p_toxic >= 0.5) for i in range(300))
    assert rows[300].p_toxic == rows[301].p_toxic == 0


def test_held_out_probabilities_are_those_of_models_without_the_document():
    rnd = np.random.default_rng(6)
    y, fold = np.c_[rnd.random(60) < 0.5, rnd.random(60) < 0.5].astype(int), np.arange(60) % toxicity.FOLDS
    found = [np.flatnonzero(rnd.random(5) < 0.4) for _ in y]
    before = np.zeros((60, 1))
    for f in range(toxicity.FOLDS):
        own = [found[i] for i in np.flatnonzero(fold != f)]
        model = toxicity.Linear.fit(np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own), np.zeros((len(own), 0)), y[fold != f, 0].astype(float), 5)
        before[fold == f, 0] = [1 / (1 + np.exp(-(model.weights[found[i]].sum() + model.bias))) for i in np.flatnonzero(fold == f)]
    last = toxicity.Linear.fit(np.repeat(np.arange(60), [len(x) for x in found]), np.concatenate(found), before, y[:, 1].astype(float), 5)
    models = toxicity.fit_chain(found, 5, y, fold)
    assert np.allclose(models[1]["earlier"], last.extra) and np.allclose(models[1]["words"], last.weights)


def test_empty_tables(spark):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.judge(docs, labels).count() == 0
    assert toxicity.judge(frame(spark, ["a b"]), labels).first().toxic is False
    assert ngram_join.similar_groups(docs).count() == 0
    assert repeated_bytes.remove_repeats(docs).count() == 0
    assert language_id.identify(docs, F.lit(False)).count() == 0
    assert media_avi.store(docs).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (1, "a b c d e f g"), (None, None)], "doc_id long, text string")
    assert sorted((r.id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.similar_groups(docs).collect()) == [(0, 0, 0), (0, 3, 0), (1, 3, 1)]
    assert repeated_bytes.remove_repeats(docs).count() == 3


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    texts, labels = toxic_corpus(400)
    rnd = random.Random(4)
    texts = [t + f" {rnd.randrange(10**6)}" + (" mail a.b@site.org" if i % 7 == 0 else "") for i, t in enumerate(texts)]
    texts += [texts[1], texts[2] + " x", None, ""]
    folder = str(tmp_path_factory.mktemp("corpus"))
    frame(spark, texts).union(frame(spark, [texts[0]])).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts, labels


def test_pipeline(spark, corpus):
    import corpus_pipeline as pipeline

    folder, texts, labels = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES[:4]:
        docs = pipeline.written(stage(spark, docs, folder))
        assert docs.columns == columns
        kept[name] = docs.select("doc_id", "text", "source", "n_chars").collect()
    clean = {i for i, _, toxic in labels if not toxic} | {400, 401, 402, 403}
    left = {r.doc_id for r in kept["toxicity"]}
    assert len(left ^ clean) <= 2
    group = {i: c for i, (_, c) in linked(texts).items()}
    single = {r.doc_id for r in kept["near_duplicates"]}
    assert len(single) == len(kept["near_duplicates"]) == len({group[i] for i in left})
    for r in kept["pii"]:
        want = None if texts[r.doc_id] is None else texts[r.doc_id].replace("a.b@site.org", "[email]")
        assert r.text == want and r.n_chars == (None if want is None else len(want))
    size = lambda t: len(WORD.findall(t or ""))
    whole, own = {}, {r.doc_id: r for r in kept["pii"]}
    for r in kept["source_mixing"]:
        assert own[r.doc_id].text.startswith(r.text)
        whole[r.source] = whole.get(r.source, 0) + size(r.text)
    per = {}
    for r in kept["pii"]:
        per[r.source] = per.get(r.source, 0) + size(r.text)
    total = sum(per.values())
    assert all(abs(whole[s] - min(3 * per[s], total * w / 8)) <= 1 for s, w in zip(sorted(per), (5, 2, 1), strict=True))
    packed = pipeline.pack_sequences(spark, docs, folder).collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    assert len({r.doc_id for r in packed}) == len({r.doc_id for r in kept["source_mixing"]})


def test_mix_keeps_rows_of_null_and_repeated_ids(spark):
    import corpus_pipeline as pipeline

    rows = [(None if i % 3 == 0 else i // 4, f"t{i} " + "w " * (i % 7), None, "s", 1, "x", "r", "d", "w") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns  # one source, so its target is each row once
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    assert sorted(key(r) for r in mixed.select("doc_id", "text").collect()) == sorted(key(r) for r in rows)
