import numpy as np
import pytest

from claimweave.llm import langid as L

EN = ["We repeated every experiment with new cells.", "The dose response was flat in every batch.", "Only some of the tested lines responded.", "The authors had used a different dose before."]
DE = ["Wir haben jeden Versuch zweimal durchgeführt.", "Die Wirkung hing nicht von der Dosis ab.", "Nur wenige der Linien haben reagiert.", "Eine Wiederholung ergab das umgekehrte Vorzeichen."]
ZH = ["由于抗体不够可靠，每个实验我们都做了两次。", "影响的强弱取决于细胞的批次，而不是剂量。"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, " ".join(t), lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "German"), (ZH, "zh-CN"), (EN[:2], "en_US"), (EN[1:], "english"), (EN[2:] + EN[:1], "en"), (EN[1:], "de")])]
    return L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_label_notations(spark):
    given = ["EN", " en-GB", "Deutsch", "zh_TW", "mul", "", None, "Русский", "xx", "pt-BR"]
    out = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, lang string").select("i", L.label_code("lang").alias("c")).orderBy("i").collect()
    assert [r["c"] for r in out] == ["en", "en", "de", "zh", None, None, None, "ru", None, "pt"]


def test_sentences_skip_lists_and_give_code_points():
    text = "  ABC1 0.3; DEF2 0.5.\nWe saw 3 co-\nlours there. 🧬🔬 由于抗体不够可靠。"
    found = L.sentences(text)
    assert [text[a:b].strip()[:6] for a, b, _ in found] == ["We saw", "🧬🔬 由于抗"[:6]]
    assert found[0][2] == " we saw colours there "
    assert L.sentences(None) == L.sentences("") == L.sentences(" \n ") == []


def test_segments_and_labels(spark, model):
    mixed = EN[0] + " " + DE[0] + " " + DE[1] + " " + DE[2]
    rows = [(1, mixed, "de", 0), (2, EN[3].upper(), "en", 0), (3, DE[1], "en", 0), (4, None, "en", 0), (5, "", None, 0), (6, "A1 B2; C3.", None, 0), (7, EN[0], "  ", 0), (8, " ".join(EN * 3000), "eng", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, segments int")
    out = {r["doc_id"]: r for r in L.detect(df, model).collect()}
    assert [(s["seg_start"], s["lang"]) for s in out[1]["segments"]] == [(0, "en"), (len(EN[0]) + 1, "de")]
    assert out[1]["main_lang"] == "de" and not out[1]["label_wrong"]
    assert out[2]["main_lang"] == "en" and not out[2]["label_wrong"]
    assert out[3]["label_wrong"] and out[7]["label_wrong"] and not out[8]["label_wrong"]
    for i in (4, 5, 6):
        assert out[i]["main_lang"] is None and out[i]["segments"] == [] and not out[i]["label_wrong"]
    assert all(0 < out[i]["main_confidence"] <= 1 for i in (1, 2, 3))
    assert L.detect(df.limit(0), model).count() == 0


def test_batch_scores_equal_a_plain_loop(model):
    plain = [L.normalise(s) for s in EN + DE + ZH]
    total, grams = L.score(plain, model)
    for i, s in enumerate(plain):
        one, n = L.score([s], model)
        assert np.allclose(total[i], one[0]) and grams[i] == n[0] == sum(len(s) - g + 1 for g in L.GRAMS)


def test_no_labels_gives_no_language(spark):
    df = spark.createDataFrame([(1, EN[0], None)], "doc_id long, text string, lang string")
    assert L.detect(df, L.fit(df)).first()["main_lang"] is None
    assert L.detect(df, L.fit(df.limit(0))).first()["main_lang"] is None


def test_markup_of_any_length_is_no_text():
    tag = '<a href="https://x.org/' + "q" * 90 + '" class="external link">'
    assert L.normalise(f"We saw {tag}two</a> of [REDACTED] them&thetasym; here") == " we saw two of them here "
    assert L.normalise("p < 0.05 and q > 0.1 hold") == " p and q hold "


def test_short_pieces_count_for_their_neighbour():
    text = "Yes indeed. We repeated every experiment with new cells. Very well. ABC1 0.3."
    (one,) = L.sized_sentences(text)
    assert one[:2] == (12, 56) and one[3] == 44 + 11 + 10


def test_an_eleventh_language_by_its_label_and_without_one(spark):
    import random
    rng = random.Random(1)
    def words(syllables, n):
        return " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(n)).capitalize() + "."
    pl, fi, xx = ["wsz", "ie", "prz", "ow", "cz"], ["kk", "aa", "ll", "uu", "nen"], ["qh", "xo", "zj", "vyq"]
    rows = [(i, " ".join(words(s, 8) for _ in range(6)), lab) for i in range(700) for s, lab in ((pl, ["pl", "Polish", "pl-PL", "pol"][i % 4]), (fi, ["fi", "suomi"][i % 2]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df)
    assert set(model.codes) == {"pl", "fi"} and np.isfinite(model.floor).all()
    new = spark.createDataFrame([(1, words(pl, 9) + " " + words(pl, 7), "fi"), (2, words(fi, 9), "suomi"), (3, " ".join(words(xx, 9) for _ in range(6)), "pl")], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in L.detect(new, model).collect()}
    assert out[1]["main_lang"] == "pl" and out[1]["label_wrong"] and out[2]["main_lang"] == "fi" and not out[2]["label_wrong"]
    assert out[3]["main_lang"] == L.UNKNOWN and out[3]["main_confidence"] == 0 and not out[3]["label_wrong"]


def test_a_label_that_is_always_wrong_is_no_language(spark):
    rows = [(i, " ".join(EN), "en") for i in range(40)] + [(50 + i, " ".join(DE), "de") for i in range(40)] + [(100 + i, " ".join(EN), "la") for i in range(5)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert L.analyse([" ".join(EN)], model)[0].to_pylist() == ["en"]
