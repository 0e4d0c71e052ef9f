import numpy as np
from pyspark.sql import functions as F

from millrace.llm import lang_id
from millrace.llm.text import fold_remainder
from tests.llm.helpers import by_id, docs


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn = fold_remainder(F.col("doc_id"), 3) != 1
    got = lang_id.identify(d, learn).join(d.select("doc_id", "lang", "text"), "doc_id").where(~learn).collect()
    right = [r["lang"] == r["lang_pred"] for r in got if len(r["text"]) >= 40]
    assert len(right) > 200 and np.mean(right) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def grams(text):
    """Brute force: the set of n-grams of a text whose non-letters are blanks."""
    padded = " ".join(["", *"".join(c if c.isalpha() else " " for c in text.lower()).split(), ""])
    return {padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)} - {" "}


def test_n_grams_equal_brute_force():
    for text in ["a", "A.", "Das ist, ein Haus", "x1y2z3", "\U0001d4d0 \U0010ffff 字 字字字", "  é--É  ", "日本語のテキスト 한국어 텍스트"]:
        name = lambda g: sum((ord(c) if c != " " else 0x110000 * (i == 0)) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
        assert lang_id.grams(text).tolist() == sorted(map(name, grams(text)))


def test_values_equal_an_independent_fit():
    texts = ["Das ist ein Haus", "the house is big", "la casa es", "der kleine Hund", "a small dog", "un perro", "und nun noch mehr", "and now even more", "y ahora"]
    sample = [(t, "dex"[i % 3]) for i, t in enumerate(texts)]
    model = lang_id.fit(sample, landmarks_per_lang=2, ridge=0.05)
    probes = ["das haus is casa qq", "zzz", "perro und dog " * 40]
    got, evidence = lang_id.Scorer(model).values(probes)
    langs = sorted({y for _, y in sample})
    marks = [t for lang in langs for t in [t for t, y in sample if y == lang][:2]]
    kernel = lambda a, b: np.array([[len(grams(x) & grams(y)) / np.sqrt(len(grams(x)) * len(grams(y))) for y in b] for x in a])
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    assert values.min() > 1e-6
    root = vectors / np.sqrt(values)
    x = np.hstack((kernel(texts, marks) @ root, np.ones((9, 1))))
    y = np.array([[1.0 if lang == of else -1.0 for lang in langs] for _, of in sample])
    penalty = np.diag([0.05 * 9] * (x.shape[1] - 1) + [1e-9])
    w = np.linalg.inv(x.T @ x + penalty) @ x.T @ y
    assert np.allclose(got, np.hstack((kernel(probes, marks) @ root, np.ones((3, 1)))) @ w, atol=1e-6)
    known = set().union(*map(grams, marks))
    assert np.allclose(evidence, [len(grams(p) & known) / len(grams(p)) for p in probes])


def test_large_scripts_are_told_apart(spark):
    zh = ["今天天气很好我们去公园散步吧", "这本书讲述了中国古代的历史", "他在北京大学学习计算机科学", "请问附近有没有好吃的餐厅"]
    ja = ["今日は天気がいいので公園を散歩しましょう", "この本は日本の古い歴史について書かれています", "彼は東京大学でコンピュータを勉強しています", "近くに美味しいレストランはありますか"]
    ko = ["오늘은 날씨가 좋으니 공원을 산책합시다", "이 책은 한국의 오래된 역사에 대해 쓰여 있습니다", "그는 서울대학교에서 컴퓨터를 공부하고 있습니다", "근처에 맛있는 식당이 있습니까"]
    d = docs(spark, [*zh, *ja, *ko, "我们在学习中国的历史", "公園でコンピュータの本を読んでいます", "서울에서 한국의 책을 공부합시다"], ["zh"] * 4 + ["ja"] * 4 + ["ko"] * 4 + [None] * 3)
    got = by_id(lang_id.identify(d, F.lit(True)))
    assert [got[i]["lang_pred"] for i in (12, 13, 14)] == ["zh", "ja", "ko"]


def test_short_texts_keep_their_score_and_repeats_agree(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    more = docs(spark, ["A.", "The", "A.", "Ω."], [None] * 4, first=90_000)
    got = by_id(lang_id.identify(d.unionByName(more).unionByName(more), F.lit(True)))
    assert min(got[i]["score"] for i in (90_000, 90_001)) > 0.2 and got[90_000]["lang_pred"] == got[90_002]["lang_pred"] and got[90_003]["score"] == 0


def test_ids_that_repeat_and_null_ids(spark):
    d = docs(spark, ["the cat and the dog"] * 3 + ["der hund und die katze"] * 2, ["en"] * 3 + ["de"] * 2).selectExpr("if(doc_id = 4, null, 7) as doc_id", "text", "lang")
    got = [(r["doc_id"], r["lang_pred"]) for r in lang_id.identify(d, F.lit(True)).collect()]
    assert sorted(got, key=str) == [(7, "de")] + [(7, "en")] * 3 + [(None, "de")]


def test_edges(spark):
    learn = F.lit(True)
    d = docs(spark, ["the cat and the dog of that", None, "", "123 !?", "der hund und die katze", "é" * 50, "the " * 50_000], ["en", "en", None, "en", "de", "fr", None])
    got = by_id(lang_id.identify(d, learn))
    assert [got[i]["lang_pred"] for i in range(7)] == ["en", "und", "und", "und", "de", "fr", "en"]
    assert got[1]["score"] == got[3]["score"] == 0
    assert by_id(lang_id.identify(d, F.lit(False)))[0]["lang_pred"] == "und"
    assert lang_id.identify(docs(spark, []), learn).count() == 0
    odd = d.selectExpr("*", "1 as score", "2 as _text", "3 as lang_pred")
    assert by_id(lang_id.identify(odd, learn, keep=("text", "score")))[0]["_row"]["score"] == 1
