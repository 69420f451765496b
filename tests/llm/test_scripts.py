import numpy as np

from tallyspan.llm import languages, toxicity
from tallyspan.llm._arrays import words


def test_scripts_by_code_point():
    names = {"straße": "latin", "λόγος": "greek", "мир": "cyrillic", "ไทย": "thai", "नमस्ते": "devanagari", "தமிழ்": "tamil", "ქართული": "georgian", "ሰላም": "ethiopic", "ខ្មែរ": "khmer", "かな": "kana", "漢字": "han", "한글": "hangul", "ⵣ": "other", "𐐷": "other", "𠀀": "han", "—…": "none"}
    for word, name in names.items():
        raw = np.frombuffer(f" {word} ".encode(), np.uint8)
        assert languages.SCRIPTS[languages.script_of(raw, np.array([0, len(raw)]))[0]] == name, word
        begins, code = languages.code_points(raw)
        assert [chr(c) for c in code] == list(f" {word} ") and len(begins) == len(code)


def test_a_script_that_no_language_uses_scores_nothing(docs):
    german, english = "der schnelle braune fuchs springt über den faulen hund und", "the quick brown fox jumps over the lazy dog and"
    table = docs([german] * 30, lang="de").unionByName(docs([english] * 30, lang="en"))
    model = languages.train(table)
    asked = docs([english, "ไทย ภาษา", "日本語 の 文章", "русский текст", "the quick русский текст здесь", "12 — 3", None])
    found = {r["doc_id"]: (r["lang_pred"], round(r["score"], 2)) for r in languages.label(asked, model).collect()}
    assert found[0] == ("en", 1.0) and [found[i][1] for i in (1, 2, 3)] == [0.0] * 3
    assert all(found[i][0] in ("de", "en") for i in (1, 2, 3)) and found[4][0] == "en" and 0 < found[4][1] < 0.5
    assert found[5] == found[6] == ("und", 0.0)
    assert [r["doc_id"] for r in languages.accepted(asked, model).collect()] == [0]


def test_no_label_is_left_out_in_silence(docs):
    import pytest

    with pytest.raises(ValueError, match="more than 1 languages"):
        languages.train(docs(["a b"], lang="x").unionByName(docs(["c d"], lang="y")), max_languages=1)


def test_rows_without_an_id_are_held_out(spark, tmp_path):
    rows = [(None, "plain words here", "en", "s", 16), (1, "plain words there", "en", "s", 17), (2, "other words", "en", "s", 11)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (languages.query, toxicity.query):
        assert [r["held_out"] for r in query(spark, str(tmp_path)).collect() if r["doc_id"] is None] == [True]


def test_excuses_in_one_sweep():
    lexicon = toxicity.Lexicon({" trash": 1.0, " clown": 2.0, " scum ": 3.0})
    assert lexicon.density("trash can trash") == 1 / 3
    assert lexicon.density("class clown fish scum line clown") == 2 / 6
    assert lexicon.density("trash " * 50 + "trash can " * 50) == 50 / 150
    assert len(words(np.empty(0, np.uint8), np.zeros(1, np.int64))[0]) == 0
