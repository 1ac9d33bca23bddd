from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarryline.llm import language_id
from tests.llm.helpers import LONG, by_id, documents

WORDS = {"en": "the river and stone with bridge water night", "de": "der fluss und stein mit brücke wasser nacht", "fr": "le fleuve et pierre avec pont eau nuit"}


def corpus():
    rows = []
    for i in range(240):
        lang = list(WORDS)[i % 3]
        words = WORDS[lang].split()
        rows.append((i, " ".join(words[(i + k * k) % len(words)] for k in range(30)), lang))
    return rows


def test_held_out_accuracy(spark):
    from __spark_entry__ import queries
    from quarryline.session import table

    sf = "/root/testdata/sf0.01"
    found = queries()["op1_language_id"](spark, sf)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    judged = [r.lang == r.lang_pred for r in rows if r.held_out and r.lang]
    assert len(judged) > 100 and sum(judged) / len(judged) > 0.98


def test_awkward_rows(spark):
    rows = corpus() + [(900, None, "en"), (901, "", "en"), (902, "123 - 45", "en"), (903, "fluss " * 3, None), (904, LONG, None),
                       (905, "nacht", None), (905, "nacht", None), (None, "pierre", "fr"), (906, "brückenwasser", None)]
    found = language_id.language_id(documents(spark, rows, "place n_lang word gram size"))
    assert found.count() == len(rows)
    by = by_id(found)
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[902].score == 0
    assert [by[i].lang_pred for i in (903, 904, 905, 906, None)] == ["de", "en", "de", "de", "fr"]


def test_held_out_rows_teach_nothing(spark):
    rows = corpus()
    held = [i for i in range(5000, 5100) if zlib.crc32(str(i).encode()) % 5 == 0]
    more = rows + [(i, "klingon qapla", "tlh") for i in held]
    assert language_id.train(documents(spark, more)).langs == ["de", "en", "fr"]
    one, other = language_id.train(documents(spark, rows)), language_id.train(documents(spark, more))
    assert one.words == other.words and (one.word_rows == other.word_rows).all()


def test_longest_known_gram_decides(spark):
    model = language_id.Model(["a", "b"], {}, None, {"ston": 1, "sto": 2, "s": 3}, None)
    assert model.backoff_rows("stone") == [0, 1, 0, 0, 0, 0, 0]
    assert model.backoff_rows("stob")[1] == 2 and model.backoff_rows("sx")[1] == 3


def test_the_sample_is_bounded_and_whole_when_small(spark):
    rows = [(i, f"text {i}", "en" if i % 10 else "de") for i in range(2000)]
    counts = {r.lang: r["count"] for r in language_id.training_sample(documents(spark, rows), 100).groupBy("lang").count().collect()}
    usable = [i for i in range(0, 2000, 10) if zlib.crc32(str(i).encode()) % 5]
    assert counts["en"] == 100 and counts["de"] == 100 and len(usable) > 100
    few = {r.lang: r["count"] for r in language_id.training_sample(documents(spark, rows), 1000).groupBy("lang").count().collect()}
    assert few["de"] == len(usable)


def test_empty_table_and_no_labels(spark):
    assert language_id.language_id(documents(spark, [])).count() == 0
    assert [r.lang_pred for r in language_id.language_id(documents(spark, [(1, "a text")])).collect()] == ["und"]


def test_dropping(spark):
    docs = documents(spark, corpus() + [(900, None, "en"), (901, "12 34", "en")], "whole place score")
    kept = language_id.drop_unidentified(docs, language_id.train(docs))
    assert kept.columns == docs.columns and kept.count() == 240
    assert kept.exceptAll(docs.filter(F.col("doc_id") < 900)).count() == 0


def words_of(text):
    """Letters with their marks, by the Unicode categories."""
    words, current = [], ""
    for char in text.lower() + " ":
        kind = unicodedata.category(char)[0]
        if kind == "L" or kind == "M" and current:
            current += char
        elif current:
            words.append(current)
            current = ""
    return words


def brute(rows):
    """All predictions by plain counting and one text at a time."""
    taught = [(text, lang) for i, text, lang in rows if lang and text is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 5]
    langs = sorted({lang for _, lang in taught})
    words, grams = {lang: Counter() for lang in langs}, {lang: Counter() for lang in langs}
    for text, lang in taught:
        words[lang].update(words_of(text))
    for lang in langs:
        for word, n in words[lang].items():
            padded = f"<{word}>"
            for size in (1, 2, 3, 4):
                for at in range(len(padded) - size + 1):
                    grams[lang][padded[at : at + size]] += n

    def logs(tables, smooth):
        tables = {lang: {k: n for k, n in t.items() if n > 1} for lang, t in tables.items()}
        keys = {k for t in tables.values() for k in t}
        total = {lang: sum(t.values()) + smooth * len(keys) for lang, t in tables.items()}
        return {k: [math.log((tables[lang].get(k, 0) + smooth) / total[lang]) for lang in langs] for k in keys}

    word_logs, gram_logs = logs(words, 0.1), {}
    for size in (1, 2, 3, 4):
        for k, row in logs({lang: {g: n for g, n in t.items() if len(g) == size} for lang, t in grams.items()}, 0.5).items():
            gram_logs[k] = [x + (4 - size) * math.log(0.4) for x in row]

    def scored(word):
        if word in word_logs:
            return word_logs[word]
        padded, rows = f"<{word}>", []
        for at in range(len(padded)):
            rows.append(next((gram_logs[padded[at : at + n]] for n in (4, 3, 2, 1) if padded[at : at + n] in gram_logs), [0] * len(langs)))
        return [sum(r[i] for r in rows) / len(rows) for i in range(len(langs))]

    found = []
    for i, text, _ in rows:
        found_words = words_of(text or "")
        if not found_words:
            found.append((i, "und", 0.0))
            continue
        total = [sum(column) for column in zip(*map(scored, found_words), strict=True)]
        likely = [math.exp((t - max(total)) / math.sqrt(len(found_words))) for t in total]
        best = max(range(len(langs)), key=lambda j: (likely[j], -j))
        found.append((i, langs[best], likely[best] / sum(likely)))
    return found


def test_matches_brute_force(spark):
    hindi = "नदी और पत्थर के साथ पुल पानी रात हिन्दी भाषा"
    marathi = "नदी आणि दगड पूल पाणी रात्र मराठी भाषेत आहे"
    vowelled = "كِتَابٌ عَلَى الطَّاوِلَةِ"
    rows = [(i, text, lang) for i, (text, lang, _) in enumerate([(hindi, "hi", 0), (marathi, "mr", 0), (vowelled, "ar", 0)] * 30)]
    rows += [(1000 + i, text, lang) for i, text, lang in corpus()]
    fresh = ["पाणी आणि पुलावर", "पत्थरों की भाषाएँ", unicodedata.normalize("NFD", "brückenwässer über fleuve"), "الكِتَابِ", "x9y8 stone2stone", "\u0301\u0302", "!?", None, "qqq zzz"]
    rows += [(5000 + i, text, None) for i, text in enumerate(fresh)]
    found = by_id(language_id.language_id(documents(spark, rows)))
    assert len(found) == len(rows)
    for i, lang, score in brute(rows):
        assert found[i].lang_pred == lang and found[i].score == pytest.approx(score, abs=1e-9)
    assert [found[5000 + i].lang_pred for i in (0, 1, 5, 6)] == ["mr", "hi", "und", "und"]


def test_a_repeated_id_teaches_one_text(spark):
    rows = [(1, f"text {i}", "en") for i in range(500)] + [(2, "other", "en")]
    sample = language_id.training_sample(documents(spark, rows)).collect()
    assert sorted(r.text for r in sample) == ["other", "text 0"]


def test_many_languages_can_be_told(spark):
    rows = [(10 * i + k, f"word{chr(0x4E00 + i)} {chr(0x4E00 + i) * 2}", f"l{i:03}") for i in range(300) for k in range(4)]
    model = language_id.train(documents(spark, rows))
    assert len(model.langs) >= 299 and "l299" in model.langs
