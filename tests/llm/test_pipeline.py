from collections import Counter
from itertools import groupby
from zlib import crc32

import brute
import numpy as np
import public_tokenizers

corpus_pipeline = __import__("pytest").importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    lang, near, clean, _ = (f for _, f in corpus_pipeline.STAGES)
    one = lang(spark, docs, brute.SF)
    assert one.columns == docs.columns
    kept = {r["doc_id"] for r in one.collect()}
    assert {i for i, t in rows if any(c.isalpha() for c in t or "")} == kept
    rows = [(i, t) for i, t in rows if i in kept]
    root = brute.components(rows, 5, 80, 100)
    two = near(spark, one, brute.SF)
    assert two.columns == docs.columns and {r["doc_id"] for r in two.collect()} == {i for i, r in root.items() if i == r}
    rows = [(i, t) for i, t in rows if root[i] == i]
    leaked = {d for d, _ in brute.leaks(rows, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{brute.SF}/benchmark.parquet").collect()])}
    three = clean(spark, two, brute.SF)
    assert three.columns == docs.columns and {r["doc_id"] for r in three.collect()} == {i for i, _ in rows} - leaked
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: len(model.encode(t or "")) for i, t in rows if i not in leaked}
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, brute.SF).collect()} == want


def test_nothing_passes_through(spark):
    none = spark.read.parquet(f"{brute.SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, brute.SF)
    assert none.count() == 0


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "".join(np.random.default_rng(1).choice(list("abcdefghijklmnopqrstuvwxyz "), 400)),
    "qxz jjkq wvvx zzqk xkcd qqwz vbxq jzxw kkqj xzvq wqjx zkvj",
]


def trigrams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    line = " " + "".join(" " if k else "".join(g) for k, g in groupby(letters, lambda c: c == " ")).strip() + " "
    return Counter(line[i : i + 3] for i in range(len(line) - 2)) if line.strip() else Counter()


def likeness(text, learned):
    """Exact likeness to the language of the largest exact cosine; ``learned`` has every language's n-gram shares."""
    grams = trigrams(text)
    product = {k: sum(n * shares.get(g, 0.0) for g, n in grams.items()) / sum(grams.values()) for k, (shares, _) in learned.items()}
    best = max(product, key=lambda k: product[k] / learned[k][1] ** 0.5)
    return product[best] / learned[best][1]


def test_language_stage_rejects_what_was_not_learned(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    short = [{**rows[0], "text": t, "doc_id": 2_000_000 + i, "lang": None} for i, t in enumerate(["Thtion.", "This.", "Ating. " * 50, "De la, que."])]
    planted = [{**rows[0], "text": t, "doc_id": 1_000_000 + i, "lang": None} for i, t in enumerate(FOREIGN)]
    learned = {}
    for lang in sorted({r["lang"] for r in rows if r["lang"]}):
        total = sum((trigrams(r["text"] or "") for r in rows if r["lang"] == lang), Counter())
        shares = {g: n / total.total() for g, n in total.items()}
        learned[lang] = shares, sum(p * p for p in shares.values())
    exact = {r["doc_id"]: likeness(r["text"], learned) for r in rows + planted + short if trigrams(r["text"] or "")}
    assert all(exact[r["doc_id"]] < corpus_pipeline.LEAST_LIKENESS for r in planted)
    assert all(exact[r["doc_id"]] > corpus_pipeline.LEAST_LIKENESS for r in short)
    got = corpus_pipeline.known_language(spark, spark.createDataFrame(rows + planted + short, docs.schema), brute.SF)
    assert {r["doc_id"] for r in got.collect()} == {i for i, a in exact.items() if a >= corpus_pipeline.LEAST_LIKENESS}


def test_profiles_learn_from_every_labelled_row(spark):
    """All ids are of the share that was held out from the fit."""
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet").limit(0)
    row = {c: None for c in docs.columns}
    rows = [{**row, "doc_id": i, "text": FOREIGN[6], "lang": "ru"} for i in range(24) if crc32(str(i).encode()) % 4 == 2]
    kept = corpus_pipeline.known_language(spark, spark.createDataFrame(rows, docs.schema), brute.SF).collect()
    assert rows and len(kept) == len(rows)
