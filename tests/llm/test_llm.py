"""Training-data operators against brute force, and on awkward input."""

import base64
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from dashgrid.llm import bpe, mixing, quantiles, sentences, survivor

VOCABULARY = os.path.join(bpe.TOKENIZER_DIR, bpe.VOCABULARY)
GOOD = "ab" * 32


# percentiles

def test_sketch_error_and_merge():
    rng = np.random.default_rng(1)
    x = np.floor(rng.lognormal(6, 2, 300_000))
    whole, parts = quantiles.Sketch(), quantiles.Sketch()
    for chunk in np.array_split(x, 40):
        s = quantiles.Sketch()
        for piece in np.array_split(chunk, 7):
            s.add(piece)
        parts.merge(quantiles.Sketch.from_bytes(s.to_bytes()))
        whole.add(chunk)
    x = np.sort(x)
    for s in (whole, parts):
        levels = int(np.log2(len(x) / quantiles.exact_up_to())) + 2  # each level holds at most its sections
        assert s.n == len(x) and s.size() <= 2 * s.k * sum(quantiles.SECTIONS + j for j in range(levels))
        assert sum(len(v) << h for h, v in enumerate(s.levels)) == len(x)
        for q in (0.5, 0.9, 0.99, 0.999, 0.9999):
            got = s.quantiles([q])[0]
            lo, hi = np.searchsorted(x, got, "left"), np.searchsorted(x, got, "right")
            off = max(0, lo - q * len(x), q * len(x) - hi)
            assert off <= quantiles.rank_error() * (1 - q) * len(x) + 1, (q, off)


def test_sketch_is_exact_when_small(spark):
    rows = [(m, v) for m in ("a", None) for v in (5, 1, -3, 0, 0, 9, None)] + [("b", None)]
    d = spark.createDataFrame(rows, "mode string, ms bigint").repartition(3)
    s = quantiles.sketch_groups(d.selectExpr("*", "1 AS sketch_", "'x' AS n"), ["mode"], ["ms"])
    got = {r.mode: (r.n, r.p50, r.top) for r in quantiles.read_sketches(s, {"p50": 0.5, "top": 1.0}).collect()}
    assert got == {"a": (6, 0.0, 9.0), None: (6, 0.0, 9.0)}
    whole = quantiles.read_sketches(quantiles.merge_sketches(s, []), {"p50": 0.5}).first()
    assert (whole.metric, whole.n, whole.p50) == ("ms", 12, 0.0)
    assert quantiles.sketch_groups(d.where("ms > 99"), ["mode"], ["ms"]).count() == 0


def test_each_group_gives_one_row_beyond_the_flush(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FLUSH_ITEMS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = spark.range(4000).selectExpr("id % 40 AS g", "CASE WHEN id % 3 > 0 THEN id % 2 END AS h", "id AS ms").repartition(8)
        s = quantiles.sketch_groups(d, ["g", "h"], ["ms"])
        got = {(r.g, r.h): (r.n, r.top) for r in quantiles.read_sketches(s, {"top": 1.0}).collect()}
        whole = [(r.h, r.n) for r in quantiles.read_sketches(quantiles.merge_sketches(s, ["h"]), {"top": 1.0}).collect()]
        assert s.count() == len(got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(r.g, r.h): (r.n, float(r.top)) for r in d.groupBy("g", "h").agg(F.count("ms").alias("n"), F.max("ms").alias("top")).collect()}
    assert got == want
    assert sorted(whole, key=str) == sorted(((r.h, r.n) for r in d.groupBy("h").agg(F.count("ms").alias("n")).collect()), key=str)


# survivors

def canonical(spark, h):
    return survivor.with_canonical_sha256(spark.createDataFrame([(h,)], "h string"), "h", "k").first().k


def test_canonical_hash(spark):
    raw = bytes.fromhex(GOOD)
    b64 = base64.b64encode(raw).decode()
    for h in (GOOD, GOOD.upper(), f" {GOOD}\n", f"sha256:{GOOD}", f"SHA-256={GOOD}", f"0x{GOOD}", ":".join(GOOD[i:i + 2] for i in range(0, 64, 2)), b64, b64.rstrip("="), f"sha256-{b64}"):
        assert canonical(spark, h) == GOOD, h
    tricky = base64.b64decode("0xNEhKYFa4RuNiVAa1/md1TizP/T8SY99sLpj9oSQTo=")
    assert canonical(spark, base64.b64encode(tricky).decode()) == tricky.hex()
    for h in (None, "", "N/A", "sha256:", "0" * 64, "F" * 64, survivor.EMPTY_SHA256.upper(), GOOD[:-1], GOOD + "0", "g" * 64, base64.b64encode(bytes(32)).decode()):
        assert canonical(spark, h) is None, h


def test_survivors(spark):
    rows = [(1, "h", True, 50, 5, None), (2, "h", False, 90, 6, None), (3, "h", True, 70, None, 1), (4, "h", True, 70, 8, 1), (5, "h", None, None, 9, 2), (5, "h", None, None, 9, 2),
            (6, "once", True, 1, 1, 1), (7, "twice", None, None, None, None), (7, "twice", None, None, None, None), (8, None, True, 1, 1, 1), (9, None, True, 1, 1, 1)]
    d = spark.createDataFrame(rows, "id bigint, k string, e boolean, t bigint, a int, b int").selectExpr("*", "1 AS key", "2 AS trust", "3 AS time")
    s = survivor.survivors(d, "k", "id", ["a", "b"], F.col("e"), F.col("t"))
    r, = s.collect()
    assert (r.key, r.n_members, r.a, r.a_source, r.b, r.b_source) == ("h", 6, 8, 4, 1, 4)
    assert sorted(map(tuple, survivor.survivor_sources(s, ["a", "b"]).collect())) == [("h", "a", 4), ("h", "b", 4)]
    assert survivor.survivors(d.where("id > 99"), "k", "id", ["a"], F.col("e"), F.col("t")).count() == 0


# encoding

@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(VOCABULARY)


def reference(enc):
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=enc.ranks, special_tokens={})


def test_greedy_proposals_are_longest_matches(enc):
    rng = random.Random(1)
    for _ in range(300):
        w = bytes(rng.choice(b"abcdefgtheinr aeiou\xe6\x97\xa5") for _ in range(rng.randrange(1, 30)))
        want, at = [], 0
        while at < len(w):
            n = next(n for n in range(min(128, len(w) - at), 0, -1) if w[at:at + n] in enc.ranks)
            want.append(enc.ranks[w[at:at + n]])
            at += n
        assert [t for _, t in enc.auto.iter_long(w.decode("latin-1"))] == want


def test_encoding_equals_the_library(enc):
    ref, rng = reference(enc), random.Random(2)
    parts = ["the ", "  ", "\n", " \n ", "don't", "DON'T", " it's", "12345", "３", "½", "日本語", "टेस्ट", "😀", " ", "　", "\x1c", "a" * 70, "éá", "<|endoftext|>", "...", "_", "\t\t", "ʼn", "﻿", "​"]
    texts = [None, "", " ", "   ", "\n", "a  b", "a   b", "a \n b", " a", "a "] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    texts.append("antidisestablishment" * 20_000)
    flat, offsets = enc.encode_batch(texts)
    for i, t in enumerate(texts):
        assert flat[offsets[i]:offsets[i + 1]].tolist() == ref.encode_ordinary(t or ""), repr(t)[:80]
    assert all(enc.merge(piece) == [rank] for piece, rank in list(enc.ranks.items())[::97])


def test_encoded_frame(spark):
    d = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (3, "", None), (1, "Hello world", "x")], "doc_id bigint, text string, ids string")
    rows = bpe.encode_corpus(d, "text", ["doc_id"]).collect()
    assert sorted((r.doc_id, r.ids) for r in rows) == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert {(r.doc_id, r.n_tokens) for r in bpe.encode_corpus(d, "text", ["doc_id"], ids=False).collect()} == {(1, 2), (2, 0), (3, 0)}
    assert bpe.encode_corpus(d.where("doc_id > 9"), "text", ["doc_id"]).count() == 0


# mixing

def corpus(spark):
    rng = random.Random(4)
    rows = [(i, s, rng.randrange(1, 200), rng.choice([1.0, 0.5])) for s, n in (("big", 3000), ("mid", 400), ("small", 40)) for i in range(n)]
    return spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id bigint, source string, n_tokens int, quality double")


TARGETS = "mix string, source string, weight double, max_repeats int"


def test_mix_reaches_its_shares(spark):
    docs = corpus(spark)
    t = spark.createDataFrame([("m", "big", 5.0, 1), ("m", "MID ", 3.0, 2), ("m", "small", 2.0, 4), ("m", "none", 9.0, None), ("m", "mid", None, None), (None, "big", 1.0, 1), ("zero", "big", 0.0, 1), ("open", "small", 1.0, None)], TARGETS)
    drawn = mixing.draw_mixes(docs, t)
    report = {(r.mix, r.source): r for r in mixing.mix_report(drawn, mixing.plan_mixes(docs, t)).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(report["m", s].actual_share - share) < 0.01
    assert report["m", "small"].most_copies == 4 and report["m", "none"].tokens == 0 and report["zero", "big"].tokens == 0
    assert report["open", "small"].tokens == docs.where("source = 'small'").agg(F.sum("n_tokens")).first()[0]
    caps = drawn.where("mix = 'm'").groupBy("source").agg(F.max("copies").alias("c"), F.min("copies").alias("lo")).collect()
    assert all(r.c <= {"big": 1, "mid": 2, "small": 4}[r.source] for r in caps)
    assert drawn.groupBy("mix", "doc_id").count().where("count > 1").count() == 0


def test_drawing_is_by_keys(spark):
    docs = corpus(spark)
    t = spark.createDataFrame([("m", "big", 1.0, 1)], TARGETS)
    whole = {r.doc_id for r in mixing.draw_mixes(docs, t, budget=50_000).collect()}
    few_buckets = {r.doc_id for r in mixing.draw_mixes(docs, t, budget=50_000, buckets=1).collect()}
    assert whole == few_buckets  # buckets are a way to sort, not part of the sample
    q = {r.doc_id: r.quality for r in docs.where("source = 'big'").collect()}
    better = sum(q[i] == 1.0 for i in whole) / sum(v == 1.0 for v in q.values())
    worse = sum(q[i] == 0.5 for i in whole) / sum(v == 0.5 for v in q.values())
    assert better > 1.2 * worse
    assert mixing.draw_mixes(docs.where("doc_id < 0"), t).count() == 0 and mixing.draw_mixes(docs, t.where("mix = 'x'")).count() == 0


def test_quality_is_measured(spark):
    rows = [(i, "EN-us" if i % 2 else "en", 400 + i % 7, 100) for i in range(200)] + [(900, "en", 400, 300), (901, "en", 4000, 100)] + [(1000 + i, None, 300, 90 + i % 5) for i in range(50)]
    q = {r.doc_id: r.quality for r in mixing.with_quality(spark.createDataFrame(rows, "doc_id int, lang string, n_bytes int, n_tokens int")).collect()}
    assert len(q) == len(rows) and min(q[i] for i in range(200)) > 0.9 and q[900] < 0.1 and q[901] < 0.1 and q[1000] > 0.2
    assert mixing.with_quality(spark.createDataFrame([(1, "en", 4, 1)], "doc_id int, lang string, n_bytes int, n_tokens int")).first().quality == 1.0


# sentences

CASES = {
    "en": ["The display shows \"HOLD. STOP.\" and the trip memory halts.", "See FIG. 3, i.e. approx. 2.5 mm.", "Surprisingly, it is!", "(Compare Example 4.)", "It says \"HOLD.\"", "A pin, two dowels etc. being omitted, is read at 6 a.m. or later.", "Is it dry?"],
    "de": ["Wie in Abb. 12 gezeigt, umgreift sie z. B. drei Seiten (s. Nr. 8).", "Die Fa. Talvex u. Brume (Nr. 103) misst ca. 7,80 %."],
    "fr": ["Pourquoi une pile inclinée ?", "Cf. l'ex. 140 : la pile est omise à env. 0,6 % près.", "Conviennent aussi le zinc, etc.", "En service, elle est omise !"],
    "es": ["La pantalla muestra «ALTO.» antes de que pare, p. ej. cada 65,2 s.", "Véase la fig. 5."],
    "hi": ["पटल पर \"तैयार।\" दिखता है।", "चौड़ाई 41.8 मि.मी. है।"],
    "ar": ["تعرض الشاشة «أعد القراءة.» ثم تتوقف.", "هل هي جافة؟"],
}
WIDE = {"zh": ["屏幕显示“就绪。”，随后停止工作。", "电池组是否干燥？", "（参见实施例1的电池组。）", "宽度为3.53 mm，即a·b?c = 31.8！"], "ja": ["操作者は「信号なし！」という表示を見る。", "冷却板は乾いているか？"]}


def cut(spark, text):
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = sorted(sentences.sentence_units(d, "text", ["doc_id"], with_text=True).collect(), key=lambda r: r.start_char)
    for r in rows:
        assert text[r.start_char:r.end_char] == r.sentence and r.sentence == r.sentence.strip()
    covered = "".join(r.sentence for r in rows)
    assert "".join(covered.split()) == "".join(text.split())
    return [r.sentence for r in rows]


@pytest.mark.parametrize("lang", [*CASES])
def test_sentences_between_spaces(spark, lang):
    assert cut(spark, " ".join(CASES[lang])) == CASES[lang]


@pytest.mark.parametrize("lang", [*WIDE])
def test_sentences_without_spaces(spark, lang):
    assert cut(spark, "".join(WIDE[lang])) == WIDE[lang]


@pytest.mark.parametrize("units", [
    ["It shows \"Warning! Do not open the housing while the motor runs.\" until it stops.", "Then it is safe."],
    ["It says “One. Two of them are open? Three more of the doors remain open.”", "“Stop.”", "It stops."],
    ["Er zeigt „Achtung! Das Gehäuse nie bei laufendem Motor öffnen. Warten.“ und hält.", "Danach ruht er."],
    ["Elle affiche «Attention ! Ne pas ouvrir le boîtier pendant la marche. Attendre.» avant l'arrêt.", "Puis rien."],
    ["A 5\" pipe is used.", "Another \"long\" pipe is not.", "An open \"quotation here.", "It \"ends\" never."],
])
def test_long_quotations(spark, units):
    assert cut(spark, " ".join(units)) == units


def test_wide_quotations(spark):
    units = ["表示部は「警告！運転中は開けるな。停止を待て。」と示す。", "次に停止する。", "屏幕显示“注意！请勿在电机运转时打开外壳。请等待。”，随后停止。", "结束。"]
    assert cut(spark, "".join(units)) == units


@pytest.mark.parametrize("stop, word", [("۔", "یہ خشک ہے"), ("።", "ደረቅ ነው"), ("။", "ခြောက်သွေ့သည်"), ("។", "វាស្ងួត"), ("։", "Այն չոր է"), ("།", "སྐམ་པོ་རེད")])
def test_terminators_of_other_scripts(spark, stop, word):
    units = [f"{word}{stop}", f"{word} {word}{stop}", f"{word} 3.5{stop}"]
    assert cut(spark, " ".join(units)) == units


def test_very_long_documents(spark):
    units = ["The pin, i.e. \"HOLD. STOP.\", is read at 3.5 mm no. 7.", "Is it dry?", "「警告！待て。」と示す。"]
    text = " ".join(units * 60_000)   # over 5 MB
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    took = time.time()
    rows = sentences.sentence_units(d, "text", ["doc_id"], with_text=True).groupBy("sentence").count().collect()
    assert {r.sentence: r["count"] for r in rows} == dict.fromkeys(units, 60_000) and time.time() - took < 30


def test_thai_clauses(spark):
    want = ["ช่องว่างมีค่า 26.7 มม. ถึง 6.23 มม.", "ดังแสดงในรูปที่ 163 หน่วยความจำล้อมรอบสามด้าน", "อาจละแผ่นนำแสงได้ (ดูรูปที่ 9)", "หน้าจอแสดง \"พร้อม\" ก่อนที่หัวอ่านจะหยุด"]
    assert cut(spark, " ".join(want)) == want


def test_structure(spark):
    units = ["ABSTRACT", "[0001] First one.", "Second one.", "[0002] Third 𝛼 one.", "CLAIMS", "1. A device, comprising:\n- a pin;\n- a wheel.", "2. The device of claim 1, wherein k = 6.29 e−4.", "3. The unfinished"]
    assert cut(spark, "\n".join([units[0], units[1] + " " + units[2], *units[3:]])) == units
    wrapped = "TITLE\n\nA line that\nis wrapped. Another\none.\n\n(1) A device,\nwith parts.\n\n(2) The device of\nclaim 1."
    assert cut(spark, wrapped) == ["TITLE", "A line that\nis wrapped.", "Another\none.", "(1) A device,\nwith parts.", "(2) The device of\nclaim 1."]


def test_sentences_on_awkward_texts(spark):
    for blank in ("", " \n\t　 ", "\r\n"):
        assert cut(spark, blank) == []
    assert cut(spark, "no end") == ["no end"] and cut(spark, "x. Y.") == ["x. Y."]
    many = "Ab cd. " * 30_000
    assert len(cut(spark, many)) == 30_000
    d = spark.createDataFrame([(1, None, "a"), (2, "A b. C d.", "b"), (2, "A b. C d.", "b")], "doc_id bigint, text string, start_char string")
    assert sentences.sentence_units(d, "text", ["doc_id"]).count() == 4
    assert sentences.sentence_units(d.where("doc_id > 9"), "text", ["doc_id"]).count() == 0
