import random

import numpy as np

from stratalith.llm import reading as R

EASY = ["The cat sat on a mat.", "We got a red box.", "Put the pen in the cup.", "It is a good day.", "Look at the big dog and then feed it."]
HARD = [
    "The epistemological reconsideration of institutional methodology presupposes an intersubjective commitment which, although contested, remains authoritative.",
    "Consequently, the documentation considerably separates materialization from the provenance upon which the specification was originally designed.",
]


def _text(level, rnd, n=12):
    pool = HARD if level >= 4 else EASY
    return "# Title here\n\n" + " ".join(rnd.choice(pool) for _ in range(n))


def test_prose_leaves_out_code_tables_headings_and_front_matter():
    text = "---\ntitle: x\n---\n# Head\n\nFirst line\ncontinues here.\n\nShort heading\n\n- an item\n1. a step\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\ncode = 1\n```\n\n    indented = 2\n\nMabel: She said so.\n"
    assert R.prose_of(text) == ["First line continues here.", "an item", "a step", "She said so."]
    assert R.prose_of(None) == R.prose_of("") == R.prose_of(" \n ") == []


def test_front_matter_is_left_out_whole_and_only_if_it_is_any():
    long = "---\n" + "".join(f"key{i}: value {i}.\n" for i in range(500)) + "---\nThe text begins here.\n"
    assert R.prose_of(long) == ["The text begins here."]
    assert R.prose_of("---\nThis is a sentence, no setting.\n\n---\nAnother one.\n") == ["This is a sentence, no setting.", "Another one."]


def test_language():
    texts = {
        "de": "Der Ordner wird vor dem nächsten Speicher von uns geprüft und die Prüfer sind nicht da.",
        "en": "The folder is checked by us before the next release and it was not there.",
        "zh": "这个文件夹在下次发布之前由我们检查。",
    }
    spoken = R.Languages.learn({k: R.language_words(t) for k, t in texts.items()})
    assert R.features_of("Die Prüfer sind vor dem Ordner und der Speicher ist nicht da.", None, spoken).english is False
    assert R.features_of("It was not the release that is there before us.", None, spoken).english is True
    assert R.features_of("发布之前检查文件夹。", None, spoken).english is False
    assert R.features_of("Qwxz vbnm.", None, spoken).english is False and R.features_of("The folder is there.", None).english is False
    assert R.features_of("The folder is here.", "de", spoken).english is False


def test_isotonic():
    x, y = np.array([1.0, 2, 3, 4, 4, 5]), np.array([1.0, 3, 2, 4, 6, 5])
    knots, values = R.isotonic(x, y)
    assert np.all(np.diff(values) >= 0) and abs(np.interp(2.5, knots, values) - 2.5) < 1e-9


def test_held_out_levels(spark):
    rnd = random.Random(1)
    docs = [(i, _text(1 + i % 5, rnd), "en" if i % 7 else None, 0.0) for i in range(120)]
    docs += [(500, None, "en", 0.0), (501, "", None, 0.0), (502, "```\nx\n```", "en", 0.0), (503, "Der Plan ist neu.", "de", 0.0)]
    labels = [(i, 4 if (1 + i % 5) >= 4 else 2) for i in range(60)] + [(0, 2), (None, 3), (9999, 1)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, score double")
    graded = spark.createDataFrame(labels, "doc_id bigint, reading_level int")
    got = {r.doc_id: r for r in R.reading_levels(documents, graded).collect()}
    assert len(got) == len(docs)
    right = [(got[i].level >= 4) == ((1 + i % 5) >= 4) for i in range(60, 120)]
    assert sum(right) / len(right) > 0.95
    assert all(got[i].level is None for i in (500, 501, 502, 503)) and got[500].words == 0


def test_without_labels(spark):
    documents = spark.createDataFrame([(1, "The plan is here and it is good.", "en")], "doc_id bigint, text string, lang string")
    none = spark.createDataFrame([], "doc_id bigint, reading_level int")
    assert R.reading_levels(documents, none).first().level is None
    one = spark.createDataFrame([(1, 3)], "doc_id bigint, reading_level int")
    assert R.reading_levels(documents, one).first().level == 3
    assert R.reading_levels(documents.where("false"), one).count() == 0


def test_the_fit_sees_three_thousand_labels(spark):
    documents = spark.range(3_100).selectExpr("id AS doc_id", "'The text is short.' AS text", "'en' AS lang")
    labels = documents.selectExpr("doc_id", "1 AS reading_level")
    assert len(R.learned(documents, labels)[1]) == 3_000


def test_cross_validation():
    rnd = random.Random(4)
    graded = [(R.features_of(_text(level, rnd), "en"), level) for level in [2, 4] * 30]
    levels, hard = R.cross_validated(graded)
    assert levels > 0.95 and hard > 0.95
