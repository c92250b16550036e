import hashlib
import math

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from frameline.llm import queries
from frameline.llm.ann_index import nearest
from frameline.llm.common import doc_mod, scratch_path
from frameline.llm.html_extract import extract_main_text, main_text
from frameline.llm.language_id import fit_profiles, predict_language
from frameline.llm.lm_mixing import score_texts
from frameline.llm.piece_codec import encode_pieces
from frameline.llm.preference_format import clean_turns, format_preferences, pairs_by_opening, whole_pairs
from frameline.llm.token_counts import count_tokens
from frameline.llm.warc import archive_pages, read_archives

ODD = [None, "", " ", "a", "ÀÉ ß", "x" * 5000, "word " * 3000, "<|endoftext|> </s> ▁ \U0001f600", "a\x00b", "tab\tnew\nline"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{brute.SF}/documents.parquet").collect()]
    rows += [(7000 + k, t, "en") for k, t in enumerate(ODD)] + [(7000, None, "en"), (7003, "a", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{brute.SF}/pages.parquet")


def test_sql_of_the_subpackage(spark):
    import oracle

    con = oracle.connect(brute.SF)
    for name, sql in queries.ORACLE_SQL.items():
        assert oracle.difference(queries.QUERIES[name](spark, brute.SF), con, sql) == ""


def test_scores(spark, docs):
    given = docs.withColumn("learn", doc_mod("doc_id", 5) != 1)
    got = score_texts(given, "text", "learn", ["doc_id"]).collect()
    assert len(got) == docs.count()
    seen, rows = {}, [(r["doc_id"], r["text"], r["learn"]) for r in given.collect()]
    for _, text, learn in rows:
        for w in [*brute.words(text), None] if learn else []:
            seen[w] = seen.get(w, 0) + 1
    total = sum(seen.values())
    base = {}
    for i, text, _ in rows:
        base[i] = sum(math.log10((seen.get(w, 0) + 0.5) / (total + 0.5 * (len(seen) + 1))) for w in [*brute.words(text), None])
    for r in got:
        assert r["base_score"] == pytest.approx(base[r["doc_id"]], rel=1e-9) and r["train_tokens"] == total
        assert r["score"] < 0 and r["n_tokens"] >= 1
    assert {r["doc_id"]: r["n_known"] for r in got} == {i: sum(w in seen for w in [*brute.words(t), None]) for i, t, _ in rows}
    held = [r for r in got if not r["train"]]
    # A few hundred documents are little to learn contexts from; the unigram model counts one unseen word only.
    assert sum(r["score"] for r in held) > 1.25 * sum(r["base_score"] for r in held)
    assert sum(r["bits_per_byte"] * r["n_bytes"] for r in held) < 3.5 * sum(r["n_bytes"] for r in held)
    assert score_texts(given.limit(0), "text", "learn", ["doc_id"]).count() == 0


def test_held_out_scores_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("learn", doc_mod("doc_id", 5) != 1)
    held = [r for r in score_texts(docs, "text", "learn", ["doc_id"]).collect() if not r["train"]]
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held)


def test_scores_do_not_depend_on_partitions(spark, docs):
    given = docs.withColumn("learn", doc_mod("doc_id", 5) != 1)
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted([r["doc_id"], r["score"]] for r in score_texts(given.repartition(parts), "text", "learn", ["doc_id"]).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert np.allclose(results[0], results[1], rtol=1e-9)


def test_phrases_against_plain_python():
    """Counts of what follows what, without a text's own, by walking each text."""
    from collections import Counter

    from frameline.llm import lm_mixing as M

    r = np.random.default_rng(3)
    line = " ".join(f"w{k}" for k in r.integers(0, 40, 900))
    texts = [line, line, "x " + line, "", "a", *(" ".join(f"w{k}" for k in r.integers(0, 40, 300)) for _ in range(5)), line + " " + line]
    train = np.array([k % 3 != 1 for k in range(len(texts))])
    body = "".join(texts).encode()
    _, _, sequence, per_text, coded, phrases = M.block_units(np.frombuffer(body, np.uint8), np.cumsum([len(t) for t in texts]), train, np.zeros((8, 128)))
    assert per_text.tolist() == [len(t.split()) + 1 for t in texts] and coded.tolist() == [sum(len(w) + 1 for w in t.split()) + 1 for t in texts]
    packed, keys, seen = M.pack_phrases(phrases, train)
    units, owner, _, _, n_context, n_both = M.phrase_state(packed, len(texts), seen)
    every, at = [], 0
    for t, text in enumerate(texts):
        words, mine = [*text.split(), None], []
        for size in units[owner == t]:
            mine.append(tuple(words[:size]))
            words = words[size:]
        assert not words
        every.append(list(zip([None, *mine[:-1]], mine, strict=True)))
    counts = [Counter(every[t]) if train[t] else Counter() for t in range(len(texts))]
    both = sum(counts, Counter())
    context = sum((Counter(c for c, _ in x.elements()) for x in counts), Counter())
    for t, pairs in enumerate(every):
        own = Counter(c for c, _ in counts[t].elements())
        for c, p in pairs:
            assert (n_context[at], n_both[at]) == (context[c] - own[c], both[c, p] - counts[t][c, p])
            at += 1
    assert at == units.size and max(n_both) >= 2


def test_extraction(spark, pages):
    page = "<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>Head &amp; line</h1><p>The  first\nparagraph of the text is here and it has a lot of words in it.</p><p>Short.</p></article><footer>Copyright and the rest</footer><!-- no --><script>var a;</script></body>"
    assert main_text(page) == "Head & line\nThe first paragraph of the text is here and it has a lot of words in it.\nShort."
    odd = [None, "", "no tags", "<p>open", "</p></div>", "<!-- never closed", "<" * 50, "&#0;&#x110000;&bogus;"]
    rows = spark.createDataFrame(list(enumerate(odd)), "page_id int, html string")
    assert len(extract_main_text(rows, "html", ["page_id"]).collect()) == len(odd)
    got = queries.op2_html_extract(spark, brute.SF).collect()
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) and "  " not in r["text"] for r in got)


@pytest.mark.parametrize("names", ['class="content with-sidebar"', 'class="post has-header"', 'class="row no-side"', 'class="layout-right-rail"', 'class="entry share-enabled"', 'class="post comments-open"', 'id="page-discussion-of-art"', 'title="the hidden truth"', 'class="sidebar"'])
def test_names_are_evidence_only(names):
    article = "The article of the day is about the way in which it was written by them and what they had to say. " * 4
    assert main_text(f"<body><div {names}><p>{article}</p></div></body>") == article.strip()
    if names == 'class="sidebar"':  # evidence holds where the page has other text
        assert main_text(f"<body><div {names}><p>{article}</p></div><div><p>Other. {article}</p></div></body>") == f"Other. {article}".strip()


@pytest.mark.parametrize("part", ["<a ", '<a "', "<div>", "</x>", "<b><p></p>", "<!--", "<script ", "<a href='", "<p>", "<div></x>"])
def test_hostile_pages_take_linear_time(part):
    import time

    began = time.time()
    main_text(part * (1_000_000 // len(part)))
    assert time.time() - began < 20


def test_labels_by_nearest_decided_blocks():
    """The second pass against a search of every decided block."""
    import random

    from frameline.llm.html_extract import Block, label_blocks

    r = random.Random(4)
    good, bad, short, near = "the of and to in a is that it for was on with as be " * 4, "link " * 20, "Short one.", "the way of the world is as it was and so it will be for all the men"
    for _ in range(300):
        kinds = [r.choice("gbsn") for _ in range(r.randrange(1, 12))]
        blocks = [Block({"g": good, "b": bad, "s": short, "n": near + " in the end."}[k], 90 if k == "b" else 0, False, False) for k in kinds]
        label_blocks(blocks)
        for k, b in enumerate(blocks):
            left = next((kinds[j] for j in range(k - 1, -1, -1) if kinds[j] in "gb"), None)
            right = next((kinds[j] for j in range(k + 1, len(kinds)) if kinds[j] in "gb"), None)
            far = [next((d for d in range(1, 12) if 0 <= k + s * d < len(kinds) and kinds[k + s * d] in "gb"), 99) for s in (-1, 1)]
            if kinds[k] in "gb":
                want = kinds[k]
            elif left is None and right is None:
                want = "g"
            elif left is None or right is None or left == right:
                want = left or right
            elif kinds[k] == "n":
                want = "g"
            else:
                want = "b" if far[0] == far[1] else left if far[0] < far[1] else right
            assert b.label == {"g": "good", "b": "bad"}[want], (kinds, k)


def test_archives_have_dictionaries_whatever_the_records_sizes():
    import random

    from frameline.llm.warc import SKIPPABLE, build_archive

    r = random.Random(2)
    words = [f"word{k}" for k in range(400)]
    for count, size in ((2, 300_000), (5, 150_000), (300, 2_000), (1, 5_000), (20, 100)):
        body = build_archive([" ".join(r.choice(words) for _ in range(size // 7)).encode() for _ in range(count)])
        assert int.from_bytes(body[:4], "little") == SKIPPABLE
    assert int.from_bytes(build_archive([r.randbytes(5_000)])[:4], "little") == SKIPPABLE
    assert build_archive([b"x"])[:4] != SKIPPABLE.to_bytes(4, "little")


def test_clashing_names_and_repeated_rows(spark):
    rows = [(1, "The text of the page is here.", "en"), (1, "The text of the page is here.", "en"), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(7) for c in ("content", "body", "n_tokens", "lang_pred", "score", "ids", "n_chars", "learn_", "train")}).withColumn("learn", F.lit(True))
    count_path, piece_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    made = [
        count_tokens(df, "text", count_path, None, ["doc_id", "content", "body", "n_tokens", "text"]),
        extract_main_text(df, "text", ["doc_id", "text", "n_chars"]),
        predict_language(df, "text", fit_profiles(df, "text", "lang"), ["doc_id", "lang_pred", "score", "text"]),
        encode_pieces(df, "text", piece_path, ["doc_id", "ids", "text"]),
        score_texts(df, "text", "learn", ["doc_id", "text", "train", "score"]),
    ]
    for out in made:
        assert len(set(out.columns)) == len(out.columns) and sorted(r["doc_id"] for r in out.collect()) == [1, 1, 2]
    assert made[0].first()["n_tokens_kept"] == 7


def test_languages_against_plain_python(spark):
    """Long texts, whole and in slices, against n-gram vectors summed one by one."""
    from frameline.llm import language_id as L

    r = np.random.default_rng(5)
    rows = [(k, "".join(r.choice(list("abcdefgh ij."), 200 if k else 300_000)), "xy"[k % 2]) for k in range(8)] + [(8, "abc" * 100_000, None), (9, "", "x"), (10, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profile = fit_profiles(df, "text", "lang")
    space = L.Space(3, 1024, 17)

    def vector(text):
        line, out = [0], np.zeros(1024)
        for c in (text or "").lower():
            if c.isalpha() or line[-1]:
                line.append(ord(c) if c.isalpha() else 0)
        if line[-1]:
            line.append(0)
        if len(line) > 1:
            seen = {}
            for g in zip(line, line[1:], line[2:], strict=False):
                seen[g] = seen.get(g, 0) + 1
            for g, n in seen.items():
                out += n * np.roll(space.letter(g[0]), 2).astype(float) * np.roll(space.letter(g[1]), 1) * space.letter(g[2])
        return out

    vectors = {i: vector(t) for i, t, _ in rows}
    want = np.array([sum(vectors[i] for i, _, k in rows if k == lang) for lang in "xy"])
    assert profile.languages == ("x", "y") and np.array_equal(profile.prototypes, want)
    for got in predict_language(df, "text", profile, ["doc_id"]).collect():
        v = vectors[got["doc_id"]]
        if not v.any():
            assert got["lang_pred"] == "und" and got["score"] == 0
            continue
        near = want @ v / np.linalg.norm(want, axis=1) / np.linalg.norm(v)
        assert got["lang_pred"] == "xy"[near.argmax()] and got["score"] == pytest.approx(max(0, near.max()), abs=1e-6)


def test_preferences(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "good"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"), (2, 3, "assistant", "bad"), (2, 3, "assistant", "bad"),
        (3, 0, "user", "hi"), (4, 0, "user", "alone"), (5, 0, None, None), (5, 1, "assistant", "é\U0001f600"), (None, 0, "user", "x"), (6, None, "user", "x"),
    ]
    turns = clean_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["chosen_id"], r["rejected_id"]): r for r in format_preferences(turns, pairs_by_opening(turns)).collect()}
    assert set(got) == {(1, 2), (1, 3), (4, None), (5, None)}
    pair = got[1, 2]
    assert pair["prompt_turns"] == 3 and pair["prompt"].count("<|end|>") == 3
    assert pair["chosen"] == "<|assistant|>\ngood<|end|>\n" and pair["rejected"] == "<|assistant|>\nbad<|end|>\n"
    (span,) = pair["chosen_spans"]
    assert pair["chosen"][span["start"] : span["stop"]] == "good<|end|>\n"
    assert got[1, 3]["rejected"] == "" and got[1, 3]["prompt_turns"] == 1
    (span,) = got[5, None]["chosen_spans"]
    assert got[5, None]["chosen"][span["start"] : span["stop"]] == "é\U0001f600<|end|>\n" and got[4, None]["rejected"] is None
    long = spark.range(0, 200).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    blocks = format_preferences(clean_turns(long), pairs_by_opening(clean_turns(long))).orderBy("block").collect()
    assert [r["block"] for r in blocks] == [0, 1, 2, 3] and "".join(r["chosen"] for r in blocks).count("<|end|>") == 200
    turned = clean_turns(spark.createDataFrame([(c, t, "assistant" if t % 2 else "user", f"é{c if t > 150 else 0}.{t}") for c in (1, 2) for t in range(200)], "conv_id long, turn long, role string, text string").withColumn("conv_id", F.col("conv_id") + 20))
    turned = turned.union(clean_turns(spark.createDataFrame([(c, -1, "user", "same") for c in (21, 22)], "conv_id long, turn long, role string, text string")))
    (whole,) = whole_pairs(format_preferences(turned, pairs_by_opening(turned))).collect()
    assert (whole["chosen_id"], whole["rejected_id"], whole["prompt_turns"]) == (21, 22, 152) and whole["prompt"].count("<|end|>") == 152
    for side, c in (("chosen", 1), ("rejected", 2)):
        assert [whole[side][x["start"] : x["stop"]] for x in whole[f"{side}_spans"]] == [f"é{c}.{t}<|end|>\n" for t in range(151, 200, 2)]
    assert format_preferences(turns.limit(0), pairs_by_opening(turns.limit(0))).count() == 0


def test_token_counts_and_cache(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, cache = Tokenizer.from_file(path), scratch_path(spark, "cache")
    want = {r["doc_id"]: len(tok.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    first = count_tokens(docs.filter("doc_id < 7003"), "text", path, cache, ["doc_id"]).collect()
    stored = spark.read.parquet(cache).count()
    second = count_tokens(docs, "text", path, cache, ["doc_id"]).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in second} == want and len(second) == docs.count()
    assert {r["doc_id"]: r["n_tokens"] for r in first}.items() <= want.items()
    assert spark.read.parquet(cache).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count() > stored
    assert count_tokens(docs.limit(0), "text", path, None, ["doc_id"]).count() == 0


def test_archives_there_and_back(spark, pages):
    odd = spark.createDataFrame([(90001, None, None), (90002, "http://ä/ b", ""), (90003, "u", "x" * 1000), (90004, "u", "x" * 1000), (90005, "u", "x" * 999), (90006, "u", "x" * 999)], "page_id long, url string, html string")
    given = pages.select("page_id", "url", "html").union(odd)
    folder = scratch_path(spark, "warc")
    got = {r["page_id"]: r for r in archive_pages(given, folder).collect()}
    payload = {r["page_id"]: r["payload"] for r in read_archives(spark, folder, True).collect()}
    assert len(got) == given.count()
    for r in given.collect():
        body, own = (r["html"] or "").encode(), got[r["page_id"]]
        assert own["payload_digest"] == hashlib.sha1(body).hexdigest() and own["payload_bytes"] == len(body) and own["url"] == r["url"]
        target = r["page_id"] if own["record_type"] == "response" else own["refers_to"]
        assert bytes(payload[target]) == body
    assert got[90003]["refers_to"] == 90004 and got[90005]["record_type"] == got[90006]["record_type"] == "response"
    assert archive_pages(given.limit(0), scratch_path(spark, "warc")).count() == 0


def test_languages(spark, docs):
    held = doc_mod("doc_id", 4) == 2
    profile = fit_profiles(docs.filter(~held), "text", "lang")
    got = predict_language(docs, "text", profile, ["doc_id", "lang", "text"]).collect()
    judged = [r for r in got if r["doc_id"] < 7000]
    assert sum(r["lang"] == r["lang_pred"] for r in judged) > 0.95 * len(judged) and len(got) == docs.count()
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1
    empty = fit_profiles(docs.limit(0), "text", "lang")
    assert {r["lang_pred"] for r in predict_language(docs, "text", empty, ["doc_id"]).collect()} == {"und"}


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {r["doc_id"]: model.encode(r["text"] or "") for r in docs.collect()}
    got = encode_pieces(docs, "text", path, ["doc_id"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["ids"] == want[r["doc_id"]] and r["decoded"] == model.decode(want[r["doc_id"]]) and r["agrees"]


def test_neighbours(spark):
    rows = spark.read.parquet(f"{brute.SF}/embeddings.parquet")
    got = {}
    for r in nearest(rows, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, x = zip(*[(r["vec_id"], r["embedding"]) for r in rows.collect()], strict=True)
    ids, x = np.array(ids), np.array(x, float)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -9
        best = ids[np.lexsort((ids, -s))[:20]]
        mine = sorted(got[ids[q]])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        hits += len({v for _, v, _ in mine} & set(best.tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_recall_through_the_index_on_many_vectors(spark):
    from pathlib import Path

    path = "/root/testdata/check_s/embeddings.parquet"
    rows = spark.read.parquet(path if Path(path).exists() else "/root/testdata/sf0.1/embeddings.parquet")
    fine = [(r["vec_id"], r["embedding"]) for r in rows.collect() if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"]) and any(r["embedding"])]
    ids, x = np.array([i for i, _ in fine]), np.array([v for _, v in fine], float)
    got = {}
    for r in nearest(rows, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[ids == ids[q]] = -9
        hits += len(got[ids[q]] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [1.0, None]), (8, [inf, 1.0]), (9, []), (1, [1.0, 0.0]), (None, [1.0, 1.0]), (40, [0.0, -0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {0: [(3, 2.0), (1, 1.0), (2, 1.0)], 20: [(3, 1.0), (0, 0.5), (1, 0.5)]}
    assert nearest(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0).count() == 0


def test_counts_without_one_are_looked_up(spark):
    """The table that learning reads holds what ``without_one`` says of every log-odds, count and bit."""
    from frameline.llm import lm_mixing

    x, n, bit = (np.arange(1 << 17) >> 9) - 128, np.arange(1 << 17) >> 1 & 255, np.arange(1 << 17) & 1
    odds, left = lm_mixing.without_one(x.astype(np.int8), n, bit)
    assert (lm_mixing.WITHOUT_ONE == odds).all() and (lm_mixing.LEVEL_LEFT == lm_mixing.LEVEL[left]).all()
    assert (lm_mixing.WITHOUT_ONE.nbytes, lm_mixing.LEVEL_LEFT.nbytes) == (1 << 17, 1 << 17)


def test_pieces_take_bounded_memory(spark, docs, monkeypatch):
    """Words that come once are not remembered, lists of texts are short and batches small; ids stay the library's."""
    from frameline.llm import piece_codec as P

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        own = P.Codec(f.read())
    r = np.random.default_rng(3)
    for k in range(6):
        texts = ["common words stay " + " ".join("".join(r.choice(list("abcdefgh"), 9)) for _ in range(400)) for _ in range(5)]
        ids, agrees = own.encode(texts)
        assert [a.tolist() for a in ids] == own.model.encode(texts) and all(agrees)
        assert len(own.words) < 100 and ("▁common" in own.words) == (k > 0)
    own.remembered = 10
    assert [a.tolist() for a in own.encode(texts)[0]] == own.model.encode(texts)
    lists = list(P.slices(P.pa.array(["x" * 50_000, None] * 40)))
    assert sum(lists, []) == ["x" * 50_000, ""] * 40 and max(sum(map(len, p)) for p in lists) < 320_000

    rows, conf = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(P, "written", lambda df, label, f=P.written: rows.append(int(spark.conf.get(conf))) or f(df, label))
    before = spark.conf.get(conf)
    got = {r["doc_id"]: r["n_tokens"] for r in P.text_digests(docs, "text", path, ["doc_id"]).collect()}
    assert got == {r["doc_id"]: len(own.model.encode(r["text"] or "")) for r in docs.collect()}
    assert rows == [512] and spark.conf.get(conf) == before


def test_words_merge_together_as_one_by_one():
    """Agendas of many words at once: ties, characters in no piece, characters in pieces that are none themselves, marks and long words."""
    import random
    from array import array

    from frameline.llm import piece_codec as P

    class Model:
        pieces = ["<unk>", "a", "b", "ab", "ba", "aba", "bq", "bqa", "aa", "▁", "▁a", "▁▁", "▁▁▁"]
        scores = [0, -9, -9, -1, -1, -2, -3, -0.5, -1, -9, -4, -5, -5]

        get_piece_size = lambda self: len(self.pieces)
        id_to_piece = lambda self, i: self.pieces[i]
        get_score = lambda self, i: self.scores[i]
        is_unknown = lambda self, i: i == 0
        is_control = is_byte = is_unused = lambda self, i: False
        unk_id = lambda self: 0

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        real = P.Codec(f.read()).vocabulary
    r = random.Random(2)
    for own, letters in ((P.MergeVocabulary(Model()), "aaabbbqz▁"), (real, "theinarous▁▁.é\n\U0001f9ff")):
        words = ["".join(r.choice(letters) for _ in range(r.randrange(1, 40))) for _ in range(3000)] + ["▁" * k for k in range(1, 30)]
        one_by_one = []
        own.merge_all(words)
        short = own._merge_short
        own._merge_short = lambda w, f=short: one_by_one.append(w) or f(w)
        assert own.merge_all(words) == [array("i", own._pieces(short(w)) if len(w) <= P.SHORT else own.merge(w)).tobytes() for w in words]
        assert all("q" in w for w in one_by_one)  # the others are merged together
    assert real.merge_all([]) == []
