"""Tokens, leaks and text figures."""

import json
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom.llm import bpe, fmindex, leaks, textstats
from motionloom.runtime import cut

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def pairs():
    with open(bpe.DEFAULT_PATH, "rb") as f:
        return bpe.BytePairs(f.read())


def reference(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_PATH)
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def odd_texts():
    rng = random.Random(2)
    pool = list("'s't're abcdefgéßü the ing  \n\t") * 20 + list("0123456789,.;|§°") + ["<|endoftext|>", "😀", "中", "あ", "​", " ", "́", "и", "Ж"]
    out = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    return [None, "", " ", "\n\n", "a" * 20000, " " * 3000 + "x", "ab" * 9000, "don't'll", *out]


def test_tokens_equal_the_library(pairs):
    texts = odd_texts()
    ends, ids = pairs.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == reference(texts)


def test_verification_finds_every_wrong_proposal(pairs):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeinorst ") for _ in range(rng.randint(2, 12))).encode() for _ in range(4000)]
    wrong = 0
    for w in words:
        p, exact = np.array(pairs.propose(w)), pairs.merge(w)
        assert bool(pairs.compatible(p[:-1], p[1:]).all()) == (p.tolist() == exact)
        wrong += p.tolist() != exact
    assert wrong > 100


def test_round_trip(pairs):
    back = {i: b for b, i in pairs.ids.items()}
    texts = [t for t in odd_texts() if t]
    ends, ids = pairs.encode(texts)
    for t, a, b in zip(texts, ends, ends[1:]):
        assert b"".join(back[i] for i in ids[a:b].tolist()).decode() == t


def test_token_query_shape(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (3, "one two")], DOCS).withColumn("ids", F.lit("clash"))
    out = bpe.token_ids(df)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((r.doc_id, len(r.ids)) for r in out.collect()) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert bpe.token_ids(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("n, alphabet", [(0, 3), (1, 3), (300, 2), (500, 7), (400, 600)])
def test_index_finds_what_a_scan_finds(n, alphabet):
    rng = np.random.default_rng(n + alphabet)
    text = rng.integers(0, alphabet, n)
    if n > 200:
        text[150:250] = text[:100]  # long repeats
    assert fmindex.suffix_order(text, 10).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
    index = fmindex.FMIndex(text, alphabet)
    for size in (1, 2, 3):
        phrases = rng.integers(0, alphabet, (40, size))
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - size + 1) if text[i : i + size].tolist() == p.tolist()]


def item(seed, n=90):
    rng = random.Random(seed)
    return [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdfgklmnprst')}{rng.randint(0, 40)}x" for _ in range(n)]


def test_leaks(spark):
    lead = "Read the clip and answer in one short sentence please".split()
    items = {k: lead + item(k) for k in range(6)}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(90, None), (91, ""), (None, "x y z")], "item_id long, text string")
    w = items[1]
    half = w[40:80]
    changed = list(half)
    for k in (5, 17, 30):
        changed[k] = "other"
    shuffled = list(w)
    random.Random(9).shuffle(shuffled)
    docs = [
        (1, " ".join(w)), (2, "before " * 50 + " ".join(half) + " after" * 50), (3, " ".join(changed).upper().replace(" ", "  \n")),
        (4, " ".join(w[12:32]) + " quite other words " * 30 + " ".join(w[60:80])), (5, "<p>" + "</b> <b>".join(half) + "</p>"), (6, " ".join(x[:2] + "​" + x[2:] for x in half)),
        (7, " ".join(lead)), (8, " ".join(w[50:62])), (9, " ".join(shuffled)), (10, None), (11, ""), (12, " "), (None, " ".join(w)), (13, "word " * 30000 + " ".join(half)),
        (14, " ".join(items[2]) + " " + " ".join(items[3])), (15, " ".join(lead) + " filler" * 40 + " " + " ".join(w[20:46])),
    ]
    df = spark.createDataFrame(docs, DOCS).withColumns({"item_id": F.lit(1), "doc": F.lit("c")})
    found = leaks.leaks(leaks.leaked_spans(df, bench))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(k, 1) for k in (1, 2, 3, 4, 5, 6, 13)] + [(14, 2), (14, 3)]
    assert leaks.leaks(leaks.leaked_spans(spark.createDataFrame([], DOCS), bench)).count() == 0
    assert leaks.leaks(leaks.leaked_spans(df, spark.createDataFrame([], "item_id long, text string"))).count() == 0


def test_repeated_quotes_count_once(spark):
    w = item(1)
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    far = " " + "quite other words " * 300
    quotes = {1: [(30, 45), (30, 44)], 2: [(30, 45), (60, 75)], 3: [(10, 30), (20, 40)], 4: [(10, 24), (18, 30), (11, 23)], 5: [(0, 10), (0, 9), (50, 60), (51, 60)]}
    docs = spark.createDataFrame([(k, far.join(" ".join(w[a:b]) for a, b in q)) for k, q in quotes.items()], DOCS)
    spans = cut(leaks.leaked_spans(docs, bench))
    assert {r.doc_id: r.words_found for r in leaks.leaks(spans).collect()} == {2: 30, 3: 30}
    assert {r.doc_id: r.words_found for r in leaks.leaks(spans, share=0.1).collect()} == {1: 15, 2: 30, 3: 30, 4: 20, 5: 20}


def test_leak_across_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 2)
    items = {k: item(k) for k in range(5)}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    docs = spark.createDataFrame([(k, "filler " * (k * 199_970) + " ".join(items[k][20:70])) for k in (1, 3)], DOCS)
    assert sorted((r.doc_id, r.item_id) for r in leaks.leaks(leaks.leaked_spans(docs, bench)).collect()) == [(1, 1), (3, 3)]


def test_blocks_change_nothing(spark, monkeypatch):
    """Standing text and rare phrases are counted over all items, so blocks and scans give the same spans."""
    lead = "Read the clip and answer in one short sentence please".split()
    items = {k: (lead if k % 2 else []) + item(k % 9, 50) + item(100 + k, 20) for k in range(24)}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string").repartition(3)
    docs = spark.createDataFrame([(k, " ".join(items[k][k % 5 : 45 + k])) for k in items] + [(99, " ".join(lead))], DOCS)
    got = []
    for size, blocks in ((2_000, 8), (5, 2), (1, 3)):
        monkeypatch.setattr(leaks, "ITEM_BLOCK", size)
        monkeypatch.setattr(leaks, "PASS_BLOCKS", blocks)
        got.append(sorted(map(tuple, leaks.leaked_spans(docs, bench).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) > 24


def test_passages_that_many_items_share(spark):
    """Six items have 50 of their 90 words in common, and six documents hold only words that all of them have."""
    common = item(50, 50)
    items = {k: item(k, 15) + common + item(20 + k, 25) for k in range(6)} | {6: item(6)}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")

    def changed(words):
        return ["other" if k % 6 == 5 else w for k, w in enumerate(words)]

    far = ["quite", "other", "words"] * 300
    docs = {
        1: common[5:45], 2: changed(common[4:40]), 3: far + changed(common[:18]) + far + changed(common[30:48]) + far, 4: common[:12] + far, 5: common[::-1],
        6: [w for k, w in enumerate(common[:36]) if k % 6 != 3], 7: far[:300] + [x for k, w in enumerate(common[10:40]) for x in ([w, "added"] if k % 6 == 4 else [w])], 8: changed(items[6][20:56]),
    }
    found = leaks.leaks(leaks.leaked_spans(spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], DOCS), bench))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(d, k) for d in (1, 2, 3, 6, 7) for k in range(6)] + [(8, 6)]


def test_whole_phrases_is_a_lower_bound():
    """No passages with a sixth of their words changed leave fewer phrases whole than what is asked for."""
    rng = random.Random(5)
    for _ in range(3000):
        size = rng.randint(17, 150)
        held = max(5, -(-3 * size // 10))
        first = rng.choice([held, *range(5, held - 4)])
        left = []
        for p in (first, held - first):
            changed = {rng.randint(0, 2) + 3 * k for k in rng.sample(range(p // 3), p // 6)}
            left.append(sum(changed.isdisjoint(range(a, a + 3)) for a in range(p - 2)))
        more, both = leaks.whole_phrases(size)
        assert max(left) >= more and sum(left) >= both and (first == held or min(left) >= leaks.other_passage(size, max(left)))


def test_prepared_items(spark):
    lead, end = "a b c d e".split(), "what do you see there".split()
    words = {k: lead + item(k, 12) + end for k in range(5)} | {9: "one two".split(), 10: [], 11: lead + end}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in words.items()] * 2, "item_id long, text string")
    got = {r.item: r for r in leaks.prepared_items(bench).collect()}
    assert {k: r.words for k, r in got.items()} == words
    assert {(r.own_from, r.own_to) for k, r in got.items() if k < 5} == {(5, 16)}
    assert (got[9].own_from, got[9].own_to, got[9].phrases, got[10].phrases) == (0, 1, [0], [])
    assert (got[11].own_from, got[11].own_to) == (0, 9)
    assert got[0].phrases == list(range(3, 17))  # the phrases of the instruction and of the question aren't rare


def test_removal_spans(spark):
    w, v = item(1), item(2)
    bench = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(v))], "item_id long, text string")
    texts = {
        1: "Before it, " + " ".join(w[10:60]) + ", and after.",
        2: "<p>One</p> " + " ".join(w[:45]).replace(" ", "  \n") + " between them " + " ".join(v[20:70]) + "!",
        3: " ".join(w[30:60]) + " " + " ".join(w[30:60]) + " end",
        4: "Nothing at all here.",
        5: None,
    }
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    found = leaks.removal_spans(docs, cut(leaks.leaked_spans(docs, bench))).collect()
    told = sorted((r.doc_id, leaks.words_of(texts[r.doc_id][r.from_char : r.to_char]), list(r["items"])) for r in found)
    assert told == [(1, w[10:60], [1]), (2, w[:45], [1]), (2, v[20:70], [2]), (3, w[30:60] * 2, [1])]
    assert all(texts[r.doc_id][r.to_char - 1].isalnum() and texts[r.doc_id][r.from_char].isalnum() for r in found)


def test_words_of():
    assert leaks.words_of("Caf&eacute; <b>one</b> partner’s x­yz Ｗide нope isnâ€™t") == ["cafe", "one", "partners", "xyz", "wide", "hope", "isnt"]


PROSE = "The left hand moves in front of the body and stays there for about two seconds, which was more than we had expected. After that it rests on the table again.\n"
LIST = "".join(f"- {a} {b}\n" for a, b in zip(["quick", "slow", "steep", "faint"] * 6, ["wave", "pinch", "stroke", "shrug", "beat", "clap"] * 4))


SUBJECTS = "The left hand|Her right elbow|The speaker|A second listener|My thumb|Nobody in the room|The older of the two coders|This gesture".split("|")
VERBS = "moves in front of|was held above|had returned to|points at|stays close to|did not touch|comes down on|will soon leave".split("|")
PLACES = "the body|the table, which was cold|a chair that nobody used|the other hand|her knee, as before|the edge of the picture".split("|")
ENDS = "and stays there for about two seconds.|because we had not expected it.|, as it did in the clip before.|when the others began to laugh.|but only for a moment.".split("|")
NOUNS = "wave pinch stroke shrug beat clap point flick nod tap".split()
KINDS = "doc_id long, coder string, kind string"


def prose_text(rng):
    return " ".join(" ".join(rng.choice(x) for x in (SUBJECTS, VERBS, PLACES, ENDS)) for _ in range(rng.randint(2, 8))) + "\n"


def other_text(rng, kind):
    if kind == "list":
        mark = rng.choice(["- ", "* ", "", "#"])
        return "".join(f"{mark}{rng.choice(['quick', 'slow', 'steep', 'faint'])} {rng.choice(NOUNS)}\n" for _ in range(rng.randint(5, 20)))
    if kind == "table":
        gap = rng.choice(["\t", " | ", ";"])
        return "".join(gap.join([rng.choice(NOUNS), *[f"{rng.random() * 90:.2f}" for _ in range(4)]]) + "\n" for _ in range(rng.randint(3, 15)))
    return rng.choice(
        [
            "".join(rng.choice("bcdfghjklmnpqrstvwxz;/#+= ") for _ in range(300)),
            f"{rng.choice(NOUNS)} {rng.choice(NOUNS)}! " * 40,
            "".join(rng.choice("abcdefXYZ0123456789+/") for _ in range(400)),
            " ".join(rng.choice("the a of and on to is was with my her".split() + NOUNS) for _ in range(80)),
        ]
    )


def corpus(seed, n=400):
    rng = random.Random(seed)
    kinds = [rng.choice(["prose", "prose", "list", "table", "junk"]) for _ in range(n)]
    return [(i, prose_text(rng) if k == "prose" else other_text(rng, k)) for i, k in enumerate(kinds)], kinds


@pytest.fixture(scope="module")
def model(spark):
    docs, kinds = corpus(1)
    rng = random.Random(2)
    told = [(i, "a", rng.choice([k, k.upper(), f" {k.title()} "])) for i, k in enumerate(kinds)]
    told += [(i, c, "prose") for i in range(0, 40, 2) for c in ("b", "c") if kinds[i] == "prose"] + [(1, "b", "other"), (None, "a", "list"), (3, "a", None), (99_999, "a", "list")]
    df = spark.createDataFrame([*docs, (None, "x"), (500, None)], DOCS).withColumns({"kind": F.lit(1), "prose": F.lit(2)})
    return textstats.fit_running_language(df, spark.createDataFrame(told, KINDS))


def test_labels_by_majority(spark):
    rows = [(1, "a", "Prose"), (1, "b", "prose "), (1, "c", "list"), (2, "a", "PROSE"), (2, "b", "junk"), (3, "a", "table"), (4, "a", None), (5, "a", " "), (None, "a", "prose")]
    assert {r.doc: r.prose for r in textstats.labelled(spark.createDataFrame(rows, KINDS)).collect()} == {1: True, 3: False}


def test_running_language_of_texts_not_seen(spark, model):
    docs, kinds = corpus(7)
    rng = random.Random(8)
    mixed = [(1000, prose_text(rng) + "\n" + other_text(rng, "table") * 6), (1001, "".join(prose_text(rng) for _ in range(5)) + "\n" + "- quick wave\n- slow nod\n"), (1002, None), (1003, ""), (1004, " \n\t ")]
    out = {r.doc_id: r for r in textstats.text_statistics(spark.createDataFrame(docs + mixed, DOCS), model).collect()}
    assert sum(out[i].not_prose == (k != "prose") for i, k in enumerate(kinds)) >= 0.96 * len(kinds)
    assert out[1000].not_prose and not out[1001].not_prose and 0.8 < out[1001].running_share < 1
    assert not any(out[k].not_prose for k in (1002, 1003, 1004)) and out[1002].running_share is None


def test_no_model_without_both_kinds(spark):
    docs = spark.createDataFrame([(1, PROSE), (2, LIST)], DOCS)
    assert textstats.fit_running_language(docs, spark.createDataFrame([(1, "a", "prose")], KINDS)) is None
    assert textstats.fit_running_language(docs, spark.createDataFrame([], KINDS)) is None
    assert [(r.running_share, r.not_prose) for r in textstats.text_statistics(docs).collect()] == [(None, False)] * 2


def test_statistics(spark, model):
    docs = [(1, PROSE), (2, LIST), (3, None), (4, ""), (5, "  \n "), (6, PROSE * 3000), (7, "x" * 700_000), (8, "".join(LIST.splitlines(True)[:8]) + PROSE * 2), (9, PROSE + LIST * 3), (None, LIST)]
    df = spark.createDataFrame(docs, DOCS).withColumns({"n_chars": F.lit(-1), "doc": F.lit(0), "part": F.lit(0)})
    out = {r.doc_id: r for r in textstats.text_statistics(df, model).collect()}
    assert {k for k, r in out.items() if r.not_prose} == {2, 6, 7, 9}  # endless repetition is no prose either
    assert out[3].n_words == out[4].n_words == out[5].n_words == 0 and out[3].mean_word_length is None
    one, many = out[1], out[6]
    assert many.n_words == 3000 * one.n_words and many.n_chars == 3000 * one.n_chars and many.n_lines == 3000 and many.ended_line_share == 1.0
    assert many.mean_word_length == pytest.approx(one.mean_word_length) and many.common_word_share == pytest.approx(one.common_word_share)
    assert out[7].n_words == 1 and out[7].n_lines == 1
    assert textstats.text_statistics(spark.createDataFrame([], DOCS), model).count() == 0


def test_chunks_add_up():
    rng = random.Random(8)
    text = "".join(rng.choice(["word ", "Other", "thing. ", "\n", "12 ", "\n\n", "end.\n", "é"]) for _ in range(4000))
    whole = textstats.chunk_counts(text)
    for size in (50, 333, 1000):
        bounds = textstats.split_points(text, size)
        assert "".join(text[a:b] for a, b in bounds) == text
        parts = [textstats.chunk_counts(text[a:b], text[max(0, a - 200) : a], text[b : b + 200]) for a, b in bounds]
        summed = np.array(parts).sum(axis=0)
        for name in ("n_dense", "word_chars", "n_symbols", "n_digits", "n_words", "n_lines", "n_ended"):
            k = textstats._COUNTS.index(name)
            assert summed[k] == whole[k], (size, name)


def test_chunks_of_long_texts_give_what_the_whole_gives(spark, model):
    rng = random.Random(1)
    pool = [PROSE, LIST, "\n\n", "q9X/+aZ " * 30, "The same line once more.\n" * 5, PROSE.strip() + " ", "word " * 40]
    texts = {1: "".join(rng.choice(pool) for _ in range(2500)), 2: PROSE.replace("\n", " ") * 2600, 3: "one line that comes again\n" * 16_000, 4: "x" * 400_000, 5: ("ab " * 11_000 + "\n") * 12, 6: "e\u0301t" * 90_000, 7: PROSE}
    composed = {k: unicodedata.normalize("NFC", t) for k, t in texts.items()}
    whole = {k: [*textstats.chunk_counts(t), *textstats.running_chars([t], [""], model)] for k, t in composed.items()}
    out = {r.doc_id: r for r in textstats.text_statistics(spark.createDataFrame(list(texts.items()), DOCS), model).collect()}
    for k, t in texts.items():
        c = dict(zip(textstats._COUNTS, whole[k]))
        got = (out[k].n_chars, out[k].n_words, out[k].n_lines, out[k].running_share, out[k].ended_line_share, out[k].bullet_line_share, out[k].common_word_share, out[k].symbol_ratio, out[k].mean_word_length)
        share = lambda a, b: c[a] / c[b] if c[b] else None
        assert got == (len(t), c["n_words"], c["n_lines"], share("n_running", "n_dense"), share("n_ended", "n_lines"), share("n_bullets", "n_lines"), share("n_common", "n_words"), share("n_symbols", "n_dense"), share("word_chars", "n_words")), k
    assert out[3].not_prose and out[4].not_prose and not out[7].not_prose


def test_vocabulary_letters_cover_all_bytes():
    assert sorted(bpe.byte_letters().values()) == list(range(256))
    assert json.dumps(bpe.PATTERN)
