"""Garbled text: found in every way of garbling, not in clean text, and restored."""

from __future__ import annotations

import html

import pytest

from pyspark.sql import functions as F

from framelens.llm import encoding as N
from framelens.llm import garble as G

CLEAN = [
    "L'ÂGE MOYEN des cadres à São Paulo, SÃO TAMPOLGAR: 25 ans — “déjà vu” … €5",
    "Führungskräfte über Löhne; „Wir warten“, sagte Frau Zök.",
    "¿Por qué no? ¡Ya! Señor Núñez, 8 %",
    "Доля мужчин в «ПАО» упала с 80 % до 7 %. В 1989 г. проф. Иванов — «Отдел В»…",
    "米托布卡从4名候选人中选了纳卢佐，奥欣表示。",
    "ゾヒンドゥによると、「なぜ動かないのか？」と問う。",
    "ทอร์บรีนาเฟโลกับดุนเวบรีดราเรียกร้อง",
    "पेनदुनता में महिलाओं के पास केवल 9.4% पद हैं।",
    "تشغل النساء 48.8% فقط من مناصب",
    "በ1992 ሴቶች የያዙት 86.5% ብቻ ነው።",
    "Acme® and Foo© with Bar™, 5² m, 👩🏽‍💼 🟣 café",
    "AT&T & Sons &c; a < b",
    "",
    None,
    "plain ASCII",
    "DRAEMQUEL ELLÅ’S RISE AT IFEOS",
    "PAY GAP AT ELVÃ© HOLDINGS",
]
LATIN = "The court in Zürich — “not ready” — fined Pénzo €5 million; Ångström’s señor çed"
CYRILLIC = "Доля мужчин упала с восьмидесяти до семи процентов. Совет отклонил заявки."


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_is_no_case(text):
    assert G.suspects(text) == [] and G.restore(text) == text


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1250", "cp1251"])
def test_utf8_read_with_a_single_byte_codec(codec):
    table = {b: ch for ch, b in G._TABLES[codec].items()}
    bad = "".join(chr(b) if b < 128 else table[b] for b in LATIN.encode())
    assert G.suspects(bad)
    assert G.restore(bad) == LATIN


def test_twice_and_as_entities():
    once = LATIN.encode().decode("latin-1")
    twice = once.encode().decode("latin-1")
    assert G.suspects(twice) and G.restore(twice) == LATIN
    table = {b: ch for ch, b in G._TABLES["cp1252"].items()}
    bad = "".join(chr(b) if b < 128 else table[b] for b in LATIN.encode())
    escaped = html.escape(bad, quote=False).encode("ascii", "xmlcharrefreplace").decode()
    assert G.suspects(escaped) and G.restore(escaped) == LATIN


@pytest.mark.parametrize(("true", "wrong"), [("cp1251", "cp1252"), ("cp1251", "koi8-r")])
def test_cyrillic_codecs(true, wrong):
    bad = CYRILLIC.encode(true).decode(wrong)
    assert G.suspects(bad) and G.restore(bad) == CYRILLIC


def test_chinese_and_japanese():
    zh = "布奥准备好了吗？他们的女性高管只有百分之十，这是一个问题。"
    bad = zh.encode("gb18030").decode("latin-1")
    assert G.suspects(bad) and G.restore(bad) == zh
    ja = "日本の女性管理職はマルケで四人に達した。ドゥナの調査で壁を感じていた。"
    bad = "".join({b: c for c, b in G._TABLES["cp1252"].items()}.get(x, chr(x)) for x in ja.encode("cp932"))
    assert G.suspects(bad) and G.restore(bad) == ja


def test_a_garbled_name_after_an_initial_is_a_case():
    assert G.suspects("according to CÃ©rfelin Ulem") and G.suspects("M. A. Ã©")


def test_lost_bytes_are_a_case():
    assert [k for k, _, _ in G.suspects("l’ann�e")] == ["lost"]
    assert G.suspects("the listâ€ was")


SCHEMA = "article_id string, title string, content string, source string, kinds string, field int"


def test_twins_teach_and_restore(spark):
    clean = "The committee in Zürich fined Pénzo, the daughter of a worker, for its plan.\nSecond line without anything odd in it at all."
    lost = clean.encode("latin-1").decode("utf-8", "replace")
    weak = "Corgu Fovin took over the hiring freeze at GÃ¶ul Labs"
    rows = [("a", "t", clean, "s", "x", 1), ("b", None, lost, "s", "x", 1), ("b", None, lost, "s", "x", 2), ("c", weak, None, None, None, None), ("d", clean, "", "s", "x", 1), ("e", "t", clean.encode().decode("latin-1"), "s", "", 0), (None, weak, weak, "", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, N.found(df).collect())) == [("b", "content"), ("c", "title"), ("e", "content")]
    back = {(r["article_id"], r["field"]): (r["restored"], r["complete"]) for r in N.restored(df).collect()}
    assert back["b", "content"] == (clean, True)
    assert back["e", "content"] == (clean, True)
    assert back["c", "title"] == (weak.replace("Ã¶", "ö"), True)
    pairs = {(r["run"], r["clean"]): r["explained"] for r in N.aligned(N.scan(df)).collect()}
    assert pairs["Ã¼", "ü"] is True and pairs["�", "ü"] is False


def test_every_learned_run_restores(spark, monkeypatch):
    monkeypatch.setattr(N, "LEARNED_RUNS", 1, raising=False)  # a place below which no run may fall
    one, two = "The committee fined the old daughter of a worker in Z{}rich", "Nobody of the board was asked about the plan of C{}line"
    rows = [("a", one.format("ü")), ("b", two.format("éà"))] + [(f"c{i}", one.format("�")) for i in range(2)] + [(f"d{i}", two.format("��")) for i in range(2)]
    rows += [("x", "A line that no other article has, about M{}nster".format("�")), ("y", "Another line that stands here only, about H{}las".format("��"))]
    df = spark.createDataFrame(rows, "article_id string, content string")
    back = {r["article_id"]: (r["restored"], r["complete"]) for r in N.restored(df, fields=("content",)).collect()}
    assert back["x"] == ("A line that no other article has, about Münster", True)
    assert back["y"] == ("Another line that stands here only, about Héàlas", True)


def test_empty_and_long(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.found(df).count() == 0 and N.restored(df).count() == 0
    long = spark.createDataFrame([("a", None, "x" * 300_000 + " Zürich — end".encode().decode("latin-1"), None, None, None)], SCHEMA)
    assert N.found(long).count() == 1


def test_ways_of_finding(spark):
    one = "The committee fined the old daughter of a worker in Z{}rich for nothing"
    rows = [("a", one.format("ü")), ("b", one.format("Ã¼")), ("c", one.format("Ã¼") + " again"), ("d", "She said so in GÃ¶ul"), ("e", "No twin of it anywhere: ΓÇÖ and ΓÇö")]
    df = spark.createDataFrame(rows, "article_id string, content string")
    got = {r["way"]: r["n"] for r in N.ways(df, fields=("content",)).groupBy("way").agg(F.sum("n").alias("n")).collect()}
    assert got == {"twin": 2, "mapping": 1, "codec": 1}
    # without twins a single run of two characters proves nothing
    assert N.found(df.where("article_id = 'd'"), fields=("content",)).count() == 0


def test_the_latest_garbled_row_is_restored(spark):
    text = "A longer text that was delivered first, about Zürich and so on – twice".encode().decode("latin-1")
    rows = [("a", text, 1), ("a", "Shorter now, about Zürich – once".encode().decode("latin-1"), 2), ("a", "x", None)]
    df = spark.createDataFrame(rows, "article_id string, content string, ingested_at int")
    assert [tuple(r) for r in N.restored(df, fields=("content",)).collect()] == [("a", "content", "Shorter now, about Zürich – once", True)]


def test_letters_that_russian_could_write_prove_nothing_but_in_a_latin_word():
    assert G.suspects("SeГ±ora Ricriclin") == [("cp1251>utf-8", "Г±", "ñ")] and G.restore("SeГ±ora ElpГ®n") == "Señora Elpîn"
    assert not G.suspects("Газета Г± и том Г§ё") and not G.suspects("§ 5 Г± x")


def test_a_stretch_in_a_legacy_codec_inside_another_script():
    zh = "布塞米玛终于成功了，这是第一次！"
    bad = zh.encode("gb18030").decode("cp1252", "replace")
    text = f"成功了！{zh.encode('gb18030').decode('latin-1')}据里介绍"
    assert "�" not in bad or text
    assert G.suspects(text) and G.restore(text) == f"成功了！{zh}据里介绍"
    assert not G.suspects("他说——“……”——成功了！")


def test_a_lone_lead_byte_inside_a_word():
    assert [k for k, *_ in G.suspects("THE FILM BUSINESS IN SĂO OSLUEL")] == ["cp1250>utf-8"]
    assert not G.suspects("Ă la carte") and not G.suspects("√2")
