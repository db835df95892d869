import zlib

import resource

import numpy as np

from plain import plain_language, plain_toxicity
from quern.llm import langid, queries, toxicity

SAMPLES = {
    "en": "the cat and the dog are in the house with that man who was here for the day",
    "de": "der hund und die katze sind nicht im haus das ist eine gute sache für den mann",
    "fr": "le chat et les chiens sont dans la maison avec une femme qui est ici pour le jour",
}


def test_nearest_centroid():
    words = {k: v.split() for k, v in SAMPLES.items()}
    rng = np.random.default_rng(1)
    texts, langs = [], []
    for k, ws in words.items():
        for _ in range(40):
            texts.append(" ".join(rng.choice(ws, 12)))
            langs.append(k)
    model = langid.fit(texts, langs)
    assert len(model.of) == 12
    got, score, rejected = model.predict([SAMPLES["de"].upper(), SAMPLES["fr"], "", "123 !!", "漢字仮名交じり文"])
    assert got[:4] == ["de", "fr", "und", "und"] and not rejected[:2].any() and rejected[2:].all()
    assert (score >= 0).all() and (score <= 1).all() and score[2] == 0


def test_prediction_is_the_plain_one_in_any_batch_and_block():
    rng = np.random.default_rng(4)
    texts = [SAMPLES[k][i:] + tail for k in SAMPLES for i in range(0, 40, 3) for tail in ("", " 12!", "...")] + ["", "7", "é", "x" * 50]
    model = langid.fit([t for t in texts if any(map(str.isalpha, t))], [k for k in SAMPLES for _ in range(42)] + ["fr", "de"])
    for order in (np.arange(len(texts)), rng.permutation(len(texts))):
        got = model.predict([texts[i] for i in order])
        for i, lang, score, rejected in zip(order, *got, strict=True):
            want = plain_language(model, texts[i])
            assert (lang, rejected) == (want[0], want[2]) and abs(score - want[1]) < 3e-6
    assert (langid.counts(texts, 40) == langid.counts(texts)).all() == (max(map(len, " ".join(texts).split())) < 40)
    assert (langid.counts([" ".join(texts[:100])], 60) == langid.counts([" ".join(texts[:100])])).all()


def test_very_long_texts_take_little_memory():
    long = "the cat and the dog " * 1_000_000  # 20 MB
    model = langid.fit(list(SAMPLES.values()) * 10, list(SAMPLES) * 10)
    tox = toxicity.fit(["bad word here", "all fine now"] * 20, [1, 0] * 20)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert model.predict([long])[0] == ["en"] and 0 <= tox.scores([long])[0] <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 << 10


def test_language_query(spark, sf_dir):
    rows = queries.op7_language(spark, sf_dir).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.97


def test_language_odd_rows(odd, nothing):
    model = langid.learn(odd)
    got = langid.identify(odd, model)
    rows = got.collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(got.columns)
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert langid.identify(nothing, model).count() == 0
    blank = langid.learn(nothing)
    assert {r["lang_pred"] for r in langid.identify(odd, blank).collect()} == {"und"}


def test_classifier_learns_words_and_stems():
    rng = np.random.default_rng(2)
    plain = ["lorem", "ipsum", "dolor", "amet", "sed", "the", "of", "and", "le", "les"]
    bad = ["grumbo", "zarkfoo", "zarkbar", "zarklum"]
    texts, y = [], []
    for i in range(400):
        ws = list(rng.choice(plain, 30))
        if i % 4 == 0:
            ws[int(rng.integers(30))] = str(rng.choice(bad))
        texts.append(" ".join(ws))
        y.append(int(i % 4 == 0))
    model = toxicity.fit(texts[:300], y[:300], 1.0)
    score = model.scores(texts[300:])
    assert ((score >= 0.7) == np.array(y[300:], bool)).mean() >= 0.97
    assert model.scores(["", "  ,"]).tolist() == [0.0, 0.0]
    assert (model.scores(["grumbo " + "lorem " * 200_000]) >= 0.7).all()


def test_scores_are_those_of_a_plain_forward_pass():
    rng = np.random.default_rng(6)
    vocabulary = ["bad", "word", "zarkfoo", "le", "les", "und", "the", "straße", "x", "a1", "und"]
    texts = [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(0, 30, 60)] + ["", "...", "Bad, WORD!"]
    model = toxicity.fit(texts, [int("bad" in t) for t in texts])
    want = [plain_toxicity(model, t) for t in texts]
    assert np.allclose(model.scores(texts), want, atol=2e-5)
    whole = model.logits([" ".join(texts)])
    for block in (20, 50, 333):
        cut = model.logits([" ".join(texts)], block)
        assert np.allclose(cut[0], whole[0], atol=1e-5) and cut[1:][0] == whole[1]


def test_scoring_is_the_same_in_any_batch():
    texts = ["one two three", "", "four five six seven", "x"] * 5
    model = toxicity.fit(["bad word here", "all fine now"] * 20, [1, 0] * 20)
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts], atol=1e-5)


def test_toxicity_query(spark, sf_dir):
    rows = queries.op2_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1


def test_toxicity_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.op2_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in toxic]
    right = [r["predicted"] == toxic[r["doc_id"]] for r in rows]
    caught = [r["predicted"] for r in rows if toxic[r["doc_id"]] == 1]
    assert np.mean(right) >= 0.95 and np.mean(caught) >= 0.85


def test_toxicity_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 0), (7, 0), (9, 1), (11, 1), (12, None)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels)
    got = toxicity.score(odd, model)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    assert toxicity.score(nothing, model).count() == 0
    blank = toxicity.learn(odd, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd, blank).collect()} == {0.0}


FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
]


def test_languages_not_learned_and_random_letters_are_rejected(spark):
    from quern.llm import production

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = production.language_model(docs)
    rng = np.random.default_rng(3)
    noise = [" ".join("".join(rng.choice(list(letters), rng.integers(2, 10))) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz") for n in (20, 100, 500, 2000)]
    assert model.predict(FOREIGN + noise)[2].all()
    held = [r["text"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and sum(map(str.isalpha, r["text"] or "")) >= 32]
    assert len(held) > 2000 and model.predict(held)[2].mean() <= 0.002
