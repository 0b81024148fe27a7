"""Encoding repair, pair defects, main bodies and languages."""

import random
import time

import pytest

from lorespan.llm import garble, language, mainbody, pairs

EN = ["The meeting planner naïve archives the café notes – it’s “done” at 21 °C.", "When the queue is long, the résumé of the naïve client isn’t kept.", "Customers may keep drafts for 21 days at 21 °C – the café is “open”."]
FR = ["Après la mise à jour, l’opérateur vérifie les étiquettes déjà imprimées.", "La révision précédente a été archivée à côté du reçu, comme prévu."]
RU = ["После обновления панель поиска публикует ответы клиентов и отправляет сводку.", "Откройте настройки и введите число во втором поле, затем сохраните форму."]
ZH = ["请把阈值设为三，然后保存表单。搜索面板会发布客户答复，并通过邮件发送摘要。", "评审小组会重建会议纪要，随后等待审批。打开设置，选择高级选项。"]
CLEAN = ["ATENÇÃO: NÃO DESLIGUE DURANTE A GRAVAÇÃO", "Größe Ø 94 mm, Länge ½ Maß, Gehäuse ÄÖÜ, § 8", "СХЕМА: ┌──┐ └──┘ — см. № 59 «Раздел».", "НОРМАЛЬНО ЛИ, ЧТО ПАНЕЛЬ ПОИСКА ПУБЛИКУЕТ ОТВЕТЫ", "型号：【A】Ø49㎜，±23℃，鋼製外殼、繁體標籤。"]


@pytest.fixture(scope="module")
def restorer():
    random.seed(1)
    return garble.Restorer(*garble.fit((EN + FR + RU + ZH) * 60 + CLEAN * 12))


@pytest.mark.parametrize(
    ("text", "true", "wrong"),
    [(EN[0], "utf-8", "cp1252"), (EN[1], "utf-8", "mac_roman"), (FR[0], "utf-8", "latin-1"), (FR[1], "utf-8", "cp437"), (RU[0], "utf-8", "cp1251"), (RU[1], "cp1251", "latin-1"), (RU[1], "koi8-r", "cp1251"), (ZH[0], "utf-8", "cp1252"), (ZH[1], "gbk", "latin-1"), (ZH[0], "gbk", "cp437")],
)
def test_garbled_text_is_found_and_restored(restorer, text, true, wrong):
    bad = garble.garbled(text, true, wrong)
    assert bad and bad != text
    out, spans, hit = restorer.restore(bad)
    assert hit and spans
    same = sum(a == b for a, b in zip(out, text, strict=False)) / max(len(out), len(text))
    assert same > 0.9, out


def test_only_the_garbled_part_is_replaced(restorer):
    out, spans, hit = restorer.restore("Größe Ø 94 mm. " + garble.garbled(FR[0], "utf-8", "cp1252"))
    assert hit and out == "Größe Ø 94 mm. " + FR[0]


def test_rare_groups_have_forms():
    common = "".join(chr(0x4E00 + i) for i in range(3500))
    rare = "".join(chr(0x4E00 + i) for i in range(5000, 5020))
    forms, _ = garble.fit([common] * 9 + [rare] * 2)
    bad = garble.garbled(rare[4:14], "utf-8", "gbk")
    assert garble.LOST not in bad and any(f in bad for f in forms)


def test_fit_counts_every_row(spark):
    texts = FR + RU + ZH + ["é" * 20_001]
    rows = spark.createDataFrame([("paragraph", f"{n}-{i}", t) for n in range(3) for i, t in enumerate(texts)] + [("document", "x", None), ("document", "y", "")], "item_table string, item_id string, text string")
    forms, model = garble.fit_rows(rows)
    want, of = garble.fit(texts * 3)
    assert forms == want and model.pairs == of.pairs and model.singles == of.singles and model.singles["é"] > 60_000


OTHER = {
    "el": ("Ο εκτυπωτής ελέγχει την ημερήσια αναφορά και περιμένει την έγκριση.", "cp1253"),
    "cs": ("Tiskárna zkontroluje denní hlášení a čeká na schválení příštího týdne.", "cp1250"),
    "ko": ("프린터는 일일 보고서를 확인하고 승인을 기다립니다.", "cp949"),
    "ar": ("تفحص الطابعة التقرير اليومي ثم تنتظر الموافقة.", "cp1256"),
    "he": ("המדפסת בודקת את הדוח היומי וממתינה לאישור.", "cp1255"),
    "tr": ("Yazıcı günlük raporu denetler ve onayı bekler, şimdi çalışıyor.", "cp1254"),
}


@pytest.fixture(scope="module")
def of_many_scripts():
    return garble.Restorer(*garble.fit((EN + FR + RU + ZH) * 60 + CLEAN * 12 + [t for t, _ in OTHER.values()] * 20))


def test_quotation_marks_are_no_letters():
    rare = EN[0].replace("“done”", "done")
    r = garble.Restorer(*garble.fit([rare, EN[1], "Der Größe nach: höher, schöner, Größe ö ö ö, dôme côte hôte tôt."] * 60 + ["It is “open” now, “for some” too."]))
    for text in ("It is “open” now.", "We wait “for some” time."):
        assert r.restore(text) == (text, [], False)


@pytest.mark.parametrize(
    ("common", "word", "rare"),
    [("Sí, la guía decía que había un índice todavía. La batería seguía fría y Sí lo sabía María.", "S’abonner", "S’abonner à la lettre."), ("Après le trèfle, la règle très près de la siège ège ègre ènt ntre entrège.", "Einträge", "Neue Einträge und Absätze.")],
)
def test_words_of_a_rare_language_are_no_garbled_words(common, word, rare):
    r = garble.Restorer(*garble.fit([common] * 2000 + [rare] * 20))
    assert r.model.words[word] == 20
    assert r.restore(rare) == (rare, [], False)


def test_a_word_that_is_only_seen_garbled_is_restored():
    text, ways = "Anleitung Prüfgerät", [("utf-8", "cp1252"), ("utf-8", "cp437"), ("cp1252", "cp437"), ("cp1252", "mac_roman")]
    bad = [garble.garbled(text, *way) for way in ways]
    r = garble.Restorer(*garble.fit(["Die Geräte für über müssen früh wählen, fünf Käufer. Läuft prüfen."] * 300 + bad * 8))
    assert [r.restore(b)[0] for b in bad] == [text] * 4


@pytest.mark.parametrize("lang", OTHER)
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252"])
def test_any_script_of_the_corpus_is_restored(of_many_scripts, lang, wrong):
    text, own = OTHER[lang]
    for true in ("utf-8", own):
        bad = garble.garbled(text, true, wrong)
        assert of_many_scripts.restore(bad)[0] == text, (true, bad)
    assert of_many_scripts.restore(text) == (text, [], False)


def test_a_long_garbled_run_takes_time_in_proportion(restorer):
    text = (ZH[0] + ZH[1]) * 500
    bad = garble.garbled(text, "utf-8", "latin-1")
    assert len(bad) > 100_000
    began = time.time()
    assert restorer.restore(bad)[0] == text
    assert time.time() - began < 5


@pytest.mark.parametrize("text", CLEAN + EN + FR + RU + ZH + [None, "", "plain ascii"])
def test_correct_text_is_unaffected(restorer, text):
    assert restorer.restore(text) == (text, [], False)


def test_twice_garbled_and_lost(restorer):
    twice = garble.garbled(garble.garbled(FR[0], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert restorer.restore(twice)[2]
    assert restorer.restore("caf� au lait")[2]


def test_garble_on_spark_with_redelivery_nulls_and_empty_tables(spark):
    rows = [("a", garble.garbled(FR[0], "utf-8", "cp1252"), 1), ("a", garble.garbled(FR[0], "utf-8", "cp1252"), 2), ("b", None, 3), ("c", "", 4), (None, FR[0], 5)]
    par = spark.createDataFrame(rows, "id string, content string, text int")
    doc = spark.createDataFrame([], "id string, name string")
    fields = garble.fields({"paragraph": par, "document": doc})
    got = garble.restore(fields, garble.fit((EN + FR) * 30)).collect()
    assert [(r.item_table, r.item_id, r.restored) for r in got] == [("paragraph", "a", FR[0])]
    none = garble.fields({"document": doc})
    assert garble.restore(none, garble.fit_rows(none)).count() == 0


Q = "How long does it take until the label printer checks the daily report?"


@pytest.mark.parametrize(
    ("question", "answer", "expected"),
    [
        (Q, None, "empty"), (Q, "", "empty"), (Q, " ​\n", "empty"), (Q, "<p>&nbsp;</p>", "empty"), (Q, "**\n**", "empty"),
        (Q, "**" + Q.upper() + "**", "copy"), (Q, "Question: " + Q, "copy"), (Q, Q + "\n" + Q, "copy"), ("为什么屏幕上提示归档读取器会重新加载知识条目？", "您问的是：为什么屏幕上提示归档读取器会重新加载知识条目。", "copy"),
        (Q, Q + " The label printer needs about four minutes for it, and the audit script sends a mail.", None),
        (Q, "I'm sorry, but I can't help with that.", "refusal"), (Q, "Thank you for asking about the daily report. Unfortunately I must decline this request.", "refusal"),
        (Q, "Sorry for the delay! The label printer checks the daily report at noon.", None), (Q, "No. The label printer never touches those items without permission.", None),
        (Q, "El panel de búsqueda publica los resultados y después espera la aprobación del jefe.", "language"), (Q, "搜索面板会发布客户答复，并通过邮件发送摘要。", "language"),
        ("Please translate the following note into Spanish. The report is ready.", "El informe está listo y se publica en la página.", None),
        (Q, "The label printer checks the daily report in the order it arr", "truncated"), (Q, "Set the threshold to 0.", "truncated"), (Q, "Run this:\n```\nsync --batch 3", "truncated"),
        (Q, "Follow these 3 steps:\n1. Open the form.\n2. Save the form.", "truncated"), (Q, "The list:\n| A | B |\n| C | ", "truncated"), (Q, "1. Open the form.\n2. Save the form.\n3.", "truncated"),
        (Q, "Follow these 2 steps:\n1. Open the form.\n2. Save the form.", None), (Q, "It takes long.\n- the daily report\n- the draft policy", None), (Q, "See https://help.example/kb/1", None), (Q, "Run this:\n```\nsync --batch 3\n```", None), (Q, "Port 18.", None), (Q, "Yes.", None),
        (None, None, None), ("  ", "", None),
    ],
)
def test_defects(question, answer, expected):
    assert pairs.defect([question], answer) == expected


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("(first part\nA finished line.", [")"]), ("He said “no (never)” and left.", []), ("„Nein“, sagte er («ja»).", []), ("„Nein (", ["“", ")"]), ('A 5" pipe, then "open', ['"']), ('"All" of it.', []), ("a) one\nb) two", []), ("`(` and ```\n[ {\n``` end.", []), ("「一（二」", ["」", "）"]), ("“One paragraph.\n\nAnother.", []), ("f(x[1)", []), ("", [])],
)
def test_delimiters_of_the_whole_answer(text, wanted):
    assert pairs.open_delimiters(text) == wanted


def test_answer_open_on_an_earlier_line_is_truncated():
    assert pairs.defect([Q], "The label printer (first part of the list\nchecks the daily report at noon.") == "truncated"
    assert pairs.defect([Q], "It takes (about) four minutes.\nThe label printer “checks” the daily report.") is None


def test_suffix_automaton_against_brute_force():
    random.seed(3)
    for _ in range(40):
        a, b = ("".join(random.choices("abc", k=random.randint(0, 12))) for _ in range(2))
        want = [max((n for n in range(i + 2) if b[i + 1 - n : i + 1] in a), default=0) for i in range(len(b))]
        assert pairs.SuffixAutomaton(a).run(b) == want


def test_pairs_on_spark(spark):
    rec = spark.createDataFrame([("r1", Q, ""), ("r1", Q, ""), ("r2", None, ""), ("r3", Q, "Yes.")], "id string, message string, answer_text string")
    par = spark.createDataFrame([("p1", None, None), ("p2", [("x", Q)], None), ("p3", [], ""), ("p4", [("x", None)], "")], "id string, problem_list array<struct<id string, content string>>, content string")
    got = pairs.defects(pairs.pairs_of(rec, par)).collect()
    assert sorted(map(tuple, got)) == [("application_chat_record", "r1", "empty"), ("paragraph", "p2", "empty")]
    assert pairs.defects(pairs.pairs_of(rec.limit(0), par.limit(0))).count() == 0


PAGE = """We use cookies to improve your visit. Accept all / Reject / Settings
Home | Pricing | Blog | Contact
Home > the draft policy > Setting up the printer
# Setting up the printer
The printer checks the daily report, and then it waits for approval.
The console stores its session in one cookie; delete the cookie to sign out everywhere.
Related articles
* Handling the access tokens
Overview of the daily report

| Printer | AB-12345 | 12 |
  * the draft policy AB-1234
Menu path: Settings > Privacy > Printer
```
sync --batch 3
```
Back to top ↑
© 2025 Printer Group. All rights reserved."""


def _pages(n, rng):
    """Pages with links and notices around an article, and pages that are only one."""
    name = lambda: rng.choice("BDFGKLM") + rng.choice(["or", "al", "en", "um"]) + rng.choice(["ix", "ara", "dek"])
    says = lambda: f"The {rng.choice(['printer', 'console', 'scanner', 'gateway'])} {name()} {rng.choice(['checks', 'stores', 'merges', 'renames'])} the {rng.choice(['daily report', 'draft policy', 'access tokens'])}, and then it waits for approval."
    out = []
    for i in range(n):
        title = f"Setting up {name()}"
        body = [f"# {title}", " ".join(says() for _ in range(3)), "The console stores its session in one cookie; delete the cookie to sign out everywhere.", f"- {says()}", f"  * the draft policy AB-{rng.randrange(9999)}", "", says(), f"| {name()} | AB-{rng.randrange(9999)} | 12 |"]
        side = ["Related articles", f"* Handling {name()}", f"Overview of {name()}"]
        head = ["We use cookies to improve your visit. Accept all / Reject / Settings", "Home | Pricing | Blog | Contact", f"Home > {name()} > {title}"]
        out.append("\n".join(body if i % 2 else [*head, *body[:4], *side, *body[4:], "Back to top ↑", f"© {rng.randrange(2015, 2026)} {name()} Group. All rights reserved."]))
    return out


@pytest.fixture(scope="module")
def links():
    return mainbody.fit(_pages(200, random.Random(9)))


BODY = [3, 4, 5, 10, 11, 12, 13, 14, 15]


def test_main_body(links):
    assert mainbody.article_lines(PAGE, links) == BODY
    assert mainbody.article_lines("Only text.\n\nNothing else here.", links) == [0, 2]
    for empty in (None, "", "\n \n"):
        assert mainbody.article_lines(empty, links) == []
    long = "\n".join([*PAGE.split("\n")[:4], *("The printer checks the daily report, and then it waits for approval. " * 3 for _ in range(20_000))])
    assert len(mainbody.article_lines(long, links)) == 20_001


def test_main_body_of_held_out_pages(links):
    pages = _pages(100, random.Random(10))
    for i, page in enumerate(pages):
        lines = page.split("\n")
        own = set(range(len(lines))) if i % 2 else {3, 4, 5, 6, 10, 11, 12, 13}
        assert mainbody.article_lines(page, links) == sorted(n for n in own if lines[n].strip())


def test_scores_decide(links, monkeypatch):
    monkeypatch.setattr(mainbody.Line, "points", 1.0)
    monkeypatch.setattr(mainbody.Node, "density", lambda self: 0.0)
    for name in ("score", "per_line", "typical"):
        monkeypatch.setattr(mainbody.Node, name, lambda self: 1.0)
    assert mainbody.article_lines(PAGE, links) != BODY


def test_points_pass_to_ancestors_discounted_by_links():
    line = lambda text, links: mainbody.Line(0, text, "text", "text", len(text), links)
    few, many = mainbody.Node([line("a, b, c" * 40, 0.0)]), mainbody.Node([line("a, b, c" * 40, 0.9)])
    assert few.score() > 50 * many.score() > 0
    assert mainbody.Node([line("one, two, three.", 0.0)]).score() > mainbody.Node([line("one two three.", 0.0)]).score()
    assert mainbody.Node(few.lines, 0.5).score() == few.score() / 2


def test_main_body_on_spark(spark):
    pages = _pages(120, random.Random(11))
    par = spark.createDataFrame([("p1", "d1", PAGE), ("p1", "d1", PAGE), ("p2", "d2", PAGE), ("p3", "d1", None)] + [(f"x{i}", "d1", p) for i, p in enumerate(pages)], "id string, document_id string, content string")
    doc = spark.createDataFrame([("d1", 1, "x"), ("d1", 1, "x"), ("d2", 0, "x")], "id string, doc_type int, content string")
    web = mainbody.web_pages(par, doc)
    fitted = mainbody.fit_pages(web)
    want = mainbody.fit([*pages, PAGE, PAGE])
    assert (fitted.words, fitted.contexts) == (want.words, want.contexts)
    got = mainbody.main_lines(web, fitted)
    assert sorted((r.paragraph_id, r.line_no) for r in got.where("paragraph_id < 'q'").collect()) == [("p1", n) for n in BODY]
    none = mainbody.web_pages(par.limit(0), doc)
    assert mainbody.main_lines(none, mainbody.fit_pages(none)).count() == 0


WORDS = {
    "en": "the planner restores the daily report and keeps the previous version while the panel stays green for the whole department",
    "de": "der planer stellt den bericht wieder her und behält die vorige fassung während die anzeige für die ganze abteilung grün bleibt",
    "fr": "le planificateur rétablit le rapport quotidien et garde la version précédente pendant que le voyant reste vert pour tout le service",
    "zh": "会议助手恢复每日报表同时保留上一个版本面板一直保持绿色对整个部门生效",
}


def _texts(lang, n, rng):
    words = WORDS[lang] if lang == "zh" else WORDS[lang].split()
    out = []
    for _ in range(n):
        if lang == "zh":
            out.append("".join("".join(words[(k := rng.randrange(20)) : k + 12]) + "。" for _ in range(4)))
        else:
            out.append(" ".join(" ".join(rng.choices(words, k=10)).capitalize() + "." for _ in range(4)))
    return out


@pytest.fixture(scope="module")
def judge():
    rng = random.Random(5)
    rows = [(l, t) for l in WORDS for t in _texts(l, 60, rng)]
    noisy = [(rng.choice(list(WORDS)) if rng.random() < 0.1 else l, t) for l, t in rows]
    return language.Judge(language.fit(noisy, sorted(WORDS)))


def test_languages_of_held_out_texts(judge):
    rng = random.Random(6)
    held = [(l, t) for l in WORDS for t in _texts(l, 40, rng)]
    assert sum(judge.text(t)[0] == l for l, t in held) / len(held) > 0.99


def test_mixed_text_has_segments(judge):
    rng = random.Random(7)
    text = _texts("de", 1, rng)[0] + "\n" + _texts("zh", 1, rng)[0] + " the daily report"
    main, confidence, segments, languages = judge.text(text)
    assert languages == ["de", "zh"] and [s[2] for s in segments] == ["de", "zh", "en"] and main in languages and 0 < confidence < 1
    assert judge.text("12345 67890 !!!") == (None, 0.0, [], [])


def test_letters_of_all_scripts_have_n_grams():
    for text in ("프린터는 일일 보고서", "ⲁⲃⲅⲇ ⲉⲋ", "ꙀꙁꙂꙃ", "ﬁﬂﬃﬄﬅ", "𐌰𐌱𐌲𐌳"):
        assert len(language.grams(text)[0]), text
    rows = [("ko", t) for t in ["프린터는 일일 보고서를 확인하고 승인을 기다립니다.", "검색 화면은 이전 버전을 유지하고 답변을 게시합니다."] * 20] + [("zh", t) for t in ZH * 20]
    assert language.Judge(language.fit(rows, ["ko", "zh"])).text("프린터는 승인을 기다립니다.")[0] == "ko"


def test_wrong_labels_on_spark(spark):
    rng = random.Random(8)
    rows = [(l, t, l) for l in WORDS for t in _texts(l, 30, rng)]
    rows = [(i, t, l) for i, (l, t, _) in enumerate(rows)]
    odd = [(900, rows[0][1], "eng"), (901, rows[0][1], "de-DE"), (902, rows[0][1], None), (903, rows[0][1], " "), (904, None, "en"), (905, "", "en"), (906, "short", "fr"), (907, rows[0][1] + " " + rows[40][1], "en")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("language", language.F.lit("clash"))
    codes = {"en": "English", "de": "German", "fr": "French", "zh": "Chinese"}
    got = language.wrong_labels(language.judge(docs, language.fit_on(docs, codes)), codes).collect()
    assert sorted(map(tuple, got)) == [(901, "en"), (902, "en"), (903, "en"), (907, "de"), (907, "en")]
    none = docs.limit(0)
    assert language.wrong_labels(language.judge(none, language.fit_on(none, codes)), codes).count() == 0
