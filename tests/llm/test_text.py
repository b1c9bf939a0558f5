"""Visual forms, tokenizer, packing and sentences against brute force."""

import random
import re
import unicodedata

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import bpe, packing, sentences, visual

LATIN = st.text(alphabet="ab '.\n\t 12中é́　<|>😀sl!", max_size=60)


def looks(s):
    return unicodedata.normalize("NFC", "".join(map(visual.looks_like, s)))


def test_visual_forms_brute(spark):
    rnd = random.Random(1)
    pool = "aÁạ́́̈ё＊Ａ１ﬁ㎜²Ⅲ－‑­​ 　ｶﾞパ한글가각⽶螺ΑоС漢"
    texts = ["", " ", "́a", "ᾇ", "q̣̇́", "한"] + ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    got = {r.text: r.form for r in visual.visual_forms(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")).collect()}
    assert got == {t: looks(t) for t in texts}
    assert looks("Ａ１­-é") == "A1-é" and looks("²") != "2" and looks("ВА") == "BA" and looks("a b") == "a b"


def test_same_to_the_eye(spark):
    rows = [("1", "螺栓", "M8"), ("2", "螺栓", "Ｍ8"), ("3", "螺栓", "m8"), ("4", "螺​栓", "M8"), ("4", "螺​栓", "M8"), ("5", None, None), ("6", "", " "), ("7", "螺栓", "M8"), (None, "螺栓", "M8"), ("8", None, "M9"), ("9", "", "Μ9")]
    df = spark.createDataFrame(rows, "code string, name string, mat_desc string").withColumns({"look": F.lit(1), "k": F.lit(2)})
    got = {tuple(r) for r in visual.same_to_the_eye(df, key="code", fields=("name", "mat_desc")).collect()}
    assert got == {("1", "2"), ("1", "4"), ("2", "4"), ("2", "7"), ("4", "7"), ("8", "9")}
    assert visual.same_to_the_eye(df.limit(0), key="code", fields=("name", "mat_desc")).count() == 0


def test_twins_of_more_scripts():
    assert "".join(map(visual.looks_like, "ꓐꓑꓔⲀⲞⲢԌᎡᏒ")) == "BPTAOPGRR"
    assert all(len(a) == 1 and a not in visual.TWINS.values() for a in visual.TWINS)


def test_pieces_of_long_plain_texts(spark):
    texts = ["a" * 5000 + "́" + "b" * 5000 + "é" + "中" * 3000, "x" * 10_000 + "\u200b", "́" + "y" * 9000, "Ａ" * 4000]
    got = {r.text: r.form for r in visual.visual_forms(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {t: looks(t) for t in texts}


def test_look_links(spark):
    rows = [(str(i), "螺栓" if i % 3 else "螺​栓", "M8") for i in range(300)] + [("x", "螺栓", "M9")]
    seen = visual.looks(spark.createDataFrame(rows, "code string, name string, mat_desc string"), key="code", fields=("name", "mat_desc"))
    assert seen.count() == 301 and visual.look_links(seen).count() == 1  # one link of two classes for 20,000 pairs


@pytest.fixture(scope="module")
def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.encoder().ranks, special_tokens={})


def test_minimal_perfect_hash():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    mph = bpe.MinimalPerfectHash(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    other = np.setdiff1d(np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64), keys)
    assert (mph.slots(other) == -1).all()
    assert bpe.MinimalPerfectHash(keys[:0]).slots(other).tolist() == [-1] * len(other)


def test_every_token_is_reached_by_merging():
    e = bpe.encoder()
    assert all(e.merge(w) == (i,) for w, i in e.ranks.items())


@settings(max_examples=300, deadline=None)
@given(LATIN)
def test_encoding_equals_the_library(tiktoken_encoding, text):
    assert bpe.encoder().encode_batch([text])[0] == tiktoken_encoding.encode_ordinary(text)


def test_every_code_point_is_cut_alike(tiktoken_encoding):
    texts = [f"a{chr(c)}1 {chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    got = bpe.encoder().encode_batch(texts)
    assert all(g == tiktoken_encoding.encode_ordinary(t) for g, t in zip(got, texts))


def test_encode_documents(spark, tiktoken_encoding):
    texts = ["", None, "<|endoftext|>", "hello  world", "好" * 50_000, " ", "a\r\nb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string").withColumn("ids", F.lit(0))
    got = bpe.encode_documents(df).collect()
    assert len(got) == 8 and all(r.ids == (tiktoken_encoding.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else []) for r in got)
    assert bpe.encode_documents(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 70))
def test_pack(sizes, capacity):
    out = packing.pack(sizes, capacity)
    fill = {}
    for s, b in zip(sizes, out):
        fill[b] = fill.get(b, 0) + s
    assert sorted(fill) == list(range(len(fill))) and all(f <= capacity for f in fill.values())
    # No two containers could be one.
    least = sorted(fill.values())[:2]
    assert len(least) < 2 or sum(least) > capacity or 0 in least


def test_local_search_improves():
    rnd = random.Random(4)
    sizes = [rnd.randint(400, 1500) for _ in range(3000)]
    first = len(packing._first_placement(sizes, 2048)[1])
    assert max(packing.pack(sizes)) + 1 < first


def test_containers(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (2, None), (3, ""), (4, "word " * 3000), (None, "x y z")] + [(i, "tok " * (i % 700)) for i in range(10, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"d": F.lit(1), "n": F.lit(1), "container": F.lit("x")})
    got = packing.containers(df).collect()
    sizes = {(d, t): len(bpe.encoder().encode_batch([t])[0]) for d, t in rows}
    whole = {}
    fill = {}
    for r in got:
        whole.setdefault((r.doc_id, r.text_key), []).append(r)
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    assert sorted(sum(p.n_tokens for p in ps) for ps in whole.values()) == sorted(sizes.values())
    assert max(fill.values()) <= 2048 and sum(fill.values()) == sum(sizes.values())
    for ps in whole.values():
        ps.sort(key=lambda p: p.piece)
        assert [p.piece for p in ps] == list(range(len(ps))) and [p.first_token for p in ps] == [2048 * p.piece for p in ps]
        assert all(p.n_tokens == 2048 for p in ps[:-1])
    assert len(fill) <= -(-sum(fill.values()) // 2048) + 1
    assert packing.containers(df.limit(0)).count() == 0


def test_blocks_are_repacked(spark):
    items = spark.range(3000).selectExpr("id d", "0L k", "0L piece", "0L first", "pmod(id * 7919, 900) + 1 n")
    got = packing.pack_items(items, 3000, 2048, block_items=500).collect()
    fill = {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.n
    assert len(got) == 3000 and max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 2


def split(text):
    """Sentences by the same rules, step by step in Python."""
    def run(t, steps):
        for p, r in steps:
            t = regex.sub(p, re.sub(r"\$(\d)", r"\\\1", r), t)
        return t

    t = run(text, sentences._steps() + [x[1:] for x in sentences._pair_steps()] + [sentences._RUN])
    for o, c, m in sentences._inside():
        if c in t:
            t = "".join(regex.sub(m, sentences._MASK, x) if x.startswith(o) else x for x in regex.split(f"(?V1)(?=[{o}{c}])", t))
    out, at = [], 0
    for x in run(t, sentences._separators()).split(sentences._SEP):
        y = regex.sub(f"^{sentences._BLANK}+", "", x)
        start = at + len(x) - len(y)
        y = regex.sub(f"{sentences._BLANK}+$", "", y)
        if y:
            out.append((start, start + len(y)))
        at += len(x)
    return out


SENTENCES = [
    ["对方问“含不含运费？含不含税？”，我们答复含税不含运费。", "“价格太高！”，采购部只回了这一句。", "【A已冻结。】", "下一句。"],
    ["《导轨技术协议》（第3版。含附件）已归档。", "标题为《关于铜排涨价的说明。》的文件未盖章。", "（以上数据截至2月3日。）", "退回补充.", "KM-F3N4在P100和P300各有一条编码？！"],
    ["该批次由Ostavia Inc.代工，e.g.型号HC-U88Q就缺少颜色……", "详见附件PO1.v5.5.xlsx第11页."],
    ["Mr. Varnholt asked for 36.8 percent, cf. No. 257. ", "Dr. Imre Q. Falkovar signed at 6 a.m. ", 'He wrote "stop the order." and left. ', "Bring gloves, labels, ties, etc. ", "The price may change ... but only after notice... ", "The rule (checked twice. No change.) still holds."],
    ["Tamcore Co., Ltd. confirmed the U.S. variant v2.6. ", "It measures 9.9 m by 9.9 m. ", "(See the annex.) ", '"Please wait. We are checking." ', "Why?"],
    ["Der 2. Liefertermin ist der 19. Mai. ", "Der Preis beträgt 9,9 € zzgl. MwSt. und Fracht. ", "„Wann kommt die Ware?“, fragte der Einkauf. ", "„Die Ware fehlt noch.“ ", "Vgl. dazu die Tabelle auf S. 9. ", "Es fehlen Muttern usw. ", "Wir brauchen z. B. Muttern."],
    ["Завод им. Орлина отгружен со склада № 9. ", "Нужны гайки и т. д. по списку. ", "«Когда отгрузка?» — спросил отдел. ", "Срок истёк в 2025 г. ", "Цена 9.9 руб. за шт. без НДС."],
    ["「在庫はありますか？」と聞かれました。", "担当者の回答は「確認中。」でした。", "価格はNo.7の表をご覧ください！"],
    ['"언제 출하됩니까?"라고 물었습니다. ', "도면 Ver. 9.9을 확인해 주세요. ", "(주)오스타비아에서 확인했습니다."],
    ["“माल कब आएगा?”, यह प्रश्न है। ", "कुल भार 9.9 कि.ग्रा. है। ", "रु. 9.9 प्रति नग!"],
    ["น้ำหนักรวม 18.1 กก. เกินกว่าที่ตกลงไว้ ", "โปรดยืนยันวันส่งของ ", "ตรวจสอบฉบับที่ 28 ก่อนสั่งซื้อ"],
    ["待办事项\n\n", "1、交期5天\n", "2、确认交期。", "如无答复则改投他家。\n", "3、数量9套\n \n", "2.1 Scope\n\n", "1. Confirm the date. ", "Then close\nthe order.\n", "2. Qty. 9"],
    ["We know\nit wraps (see p.\n25) here. ", "See https://a.example/b?c=1.5&d=2 now!"],
]


@pytest.mark.parametrize("parts", SENTENCES)
def test_sentences(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in split(text)] == [p.strip() for p in parts]


def test_sentence_spans_are_those_of_the_steps(spark):
    texts = ["".join(p) for p in SENTENCES] + ["", " \n\n ", "。", "😀好。😀" * 300, "（" * 50 + "。" * 50 + "）", "a。\r\n\r\n b", "x", "", '"' * 31 + ". A", "A. " * 700]
    rnd = random.Random(2)
    texts += ["".join(rnd.choice('aB .。！？"“”（）\n19、）«»ก ') for _ in range(60)) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string").withColumns({"t": F.lit(1), "p": F.lit(2)})
    got = {}
    for r in sentences.sentence_spans(df).collect():
        got.setdefault(r.doc_id, []).append((r.sent_start, r.sent_end))
    assert {i: sorted(v) for i, v in got.items()} == {i: s for i, t in enumerate(texts) if (s := split(t))}
    assert sentences.sentence_spans(df.limit(0)).count() == 0


def test_sentences_cover_the_text(spark):
    text = "".join("".join(p) for p in SENTENCES)
    covered = {i for a, b in split(text) for i in range(a, b)}
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


def test_sentences_beyond_any_window(spark):
    address = "See https://a.example/" + "x" * 3000 + "?c=1&d=2!e now. Next."
    wide = "Parts:" + "\n" + " " * 300 + "1. One." + "\n" + " " * 300 + "2. Two."
    gap = "One" + "\n" + " " * 500 + "\n\n" + "\t" * 500 + "\nTwo"
    dash = "He said “Stop!”" + " " * 50 + "- and went. Then."
    texts = [address, wide, gap, dash]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in sentences.sentence_spans(df, sentence="s").orderBy("doc_id", "sent_start").collect():
        assert texts[r.doc_id][r.sent_start : r.sent_end] == r.s
        got.setdefault(r.doc_id, []).append(r.s)
    assert got[0] == [address[: address.index(" Next")], "Next."]
    assert got[1] == ["Parts:", "1. One.", "2. Two."]
    assert got[2] == ["One", "Two"]
    assert got[3] == [dash[: dash.index(" Then")], "Then."]


def test_places_in_long_texts(spark):
    """Texts of many times the slices in which lengths are added up; every place is where plain addition puts it."""
    lengths = [1, 31, 32, 33, 1025, 40_000]
    texts = ["  " + " ".join(f"Word{i % 7} ends." for i in range(n)) + "\n" for n in lengths]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in sentences.sentence_spans(df).orderBy("doc_id", "sent_start").collect():
        got.setdefault(r.doc_id, []).append((r.sent_start, r.sent_end))
    for i, n in enumerate(lengths):
        assert got[i] == [(2 + 12 * k, 13 + 12 * k) for k in range(n)]


def test_vocabulary_goes_along(spark, tmp_path):
    """The file is added to the job, so a worker without it at that path finds it among the job's files."""
    import shutil

    path = str(tmp_path / "own_copy.tiktoken")
    shutil.copy(bpe.DEFAULT_RANKS, path)
    df = spark.createDataFrame([(1, "hello"), (2, None)], "doc_id long, text string")
    want = {r.doc_id: r.ids for r in bpe.encode_documents(df).collect()}
    encoded = bpe.encode_documents(df, path=path)
    shutil.move(path, path + ".away")
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
