"""Encodings are told apart, wherever the bytes are cut."""

import pytest

from loomwork.functions.encodings import detect, encoding, text_of

TEXTS = {
    "zh-tw": "這個程式會讀取每一個檔案，並且把結果寫到資料庫裡面。如果檔案的編碼不正確，就會出現亂碼，所以我們需要先判斷它的編碼。",
    "zh-cn": "这个程序会读取每一个文件，并且把结果写到数据库里面。如果文件的编码不正确，就会出现乱码，所以我们需要先判断它的编码。",
    "ja": "このプログラムはすべてのファイルを読み込み、結果をデータベースに書き込みます。文字コードが正しくない場合は文字化けします。",
    "de": "Die Prüfung läuft über alle Dateien; größere Abweichungen führen zu einer Rückfrage. Straße, Äpfel und Öl gehören dazu.",
    "fr": "Le résultat dépend de la qualité des données ; où qu'elles soient, il faut vérifier l'encodage déclaré à l'entrée.",
}
CASES = [("zh-tw", "cp950"), ("zh-cn", "gbk"), ("ja", "shift_jis"), ("de", "latin-1"), ("fr", "latin-1"), *[(k, e) for k in TEXTS for e in ("utf-8", "utf-16-le", "utf-16-be")]]


@pytest.mark.parametrize(("language", "name"), CASES)
def test_cut_at_any_byte(language, name):
    data = TEXTS[language].encode(name)
    least = {"utf-16-le": 24, "utf-16-be": 24}.get(name, 40)
    wrong = [n for n in range(least, len(data) + 1) if detect(data[:n]) != name]
    plain = [n for n in wrong if name in ("latin-1", "utf-8") and data[:n].isascii()]
    assert wrong == plain
    assert detect(data * 300) == name


def test_marks_and_plain_text():
    assert detect(b"") == detect(b"plain, 123\n") == "utf-8"
    assert detect("x".encode("utf-16")) == "utf-16-le" and detect(b"\xef\xbb\xbfabc") == "utf-8"


def test_columns(spark):
    rows = [(k, TEXTS[k].encode(e)) for k, e in CASES[:6]] + [("none", None), ("mark", b"\xef\xbb\xbfabc")]
    got = spark.createDataFrame(rows, "k string, data binary").select("k", encoding("data").alias("e"), text_of("data").alias("t")).collect()
    assert [(r.k, r.e) for r in got] == [*CASES[:6], ("none", None), ("mark", "utf-8")]
    assert all(r.t == TEXTS[r.k] for r in got[:6]) and got[7].t == "abc"


def test_words_of_accents_and_figures():
    words = ["Éèçier, vequmo les vequcon et euxan, aiçè menton oupale.", "Èéèaux éêvi enpaierre eauelle.", "Ééêle, " * 40, "aééèç et Ééêèle", "« oui » et non"]
    assert {detect(w.encode("latin-1")) for w in words} == {"latin-1"}
    assert {detect(w.encode("utf-8")) for w in words} == {"utf-8"}
    assert detect(b"10203040 a0b0") == detect(b"0000") == "utf-8"
