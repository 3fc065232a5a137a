from __future__ import annotations

import pytest

from lorequarry.llm.conversations import dropped_threads, sound_turns
from lorequarry.llm.defects import defect, defective_pairs
from lorequarry.llm.language import language, requested_language
from lorequarry.llm.markup import Scan, clean_markup, content_node, markup_found, parse, _measure
from lorequarry.llm.truncation import examine, truncated_documents, truncation_report


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("plain text, 5 < 6 and b > 3", ""),
        ("A <b>bold</b> word &amp; more", "html"),
        ("Map<String> and List<Chunk> stay; C# & F# too; #12 is a ticket", ""),
        ("# Title\n\ntext", "markdown"),
        ("```\n<b>x</b> $a^2$ [[b]]\n```", "markdown"),
        ("use `<b>x</b>` here", "markdown"),
        ("[[Page|shown]] and '''bold'''", "wiki"),
        ("== Heading ==\ntext", "wiki"),
        ("# One\n\n== Two ==\ntext", "markdown,wiki"),
        ("costs $5 per month and $7 per year", ""),
        ("the mass $m_0$ and \\(x\\)", "latex"),
        ("\\section{One}\n\\begin{equation}\nx = 1\n\\end{equation}", "latex"),
        ("C:\\section\\item_path is a path", ""),
        ("arrays [[1, 2], [3, 4]] and {slot}; a == b, c != d", ""),
        ('{"a": "<b>x</b>", "b": "# t"}', ""),
        ("key: <b>x</b>\nother: [a](http://b.c)", ""),
        ("Title\n=====\ntext", "markdown"),
        ("| a | b |\n| --- | --- |\n| 1 | 2 |", "markdown"),
        ("factor is 6 * 7 * 60 so __name stays", ""),
        ("", ""),
        ("\x00 <b>x</b>", ""),
    ],
)
def test_markup_kinds(text, kinds):
    assert ",".join(sorted(Scan(text).kinds)) == kinds


def test_clean_text_keeps_structure():
    text = (
        "<h2>Head</h2><ul><li>one</li><li>two</li></ul><pre><code>x = 1\ny &lt; 2</code></pre>"
        "<p>Some <a href='u'>link</a> text &amp; more.</p> $x_1$ [[Page|shown]] **bold**"
    )
    clean = Scan(text).text
    for part in ("## Head", "- one", "- two", "```\nx = 1\ny < 2\n```", "Some link text & more.", "$x_1$", "shown", "bold"):
        assert part in clean
    assert "<" not in clean.replace("y < 2", "") and "**" not in clean and "[[" not in clean


def test_density_drops_navigation_but_not_content():
    links = "".join(f"<a href='/{i}'>Menu {i}</a> " for i in range(8))
    body = "A long paragraph of real prose that says something of note. " * 8
    page = f"<div>{links}</div><div><p>{body}</p><p>{body}</p></div>"
    clean = Scan(page).text
    assert "Menu 3" not in clean and "real prose" in clean
    root = parse(page)
    _measure(root)
    content, threshold = content_node(root)
    assert content.chars >= 2 * len(body.strip()) and threshold > 0


def test_markup_frame(spark):
    rows = [(1, "<b>x</b>", "m"), (2, None, "m"), (3, "", "m"), (1, "<b>x</b>", "m"), (4, "# " + "x" * 200_000, "m")]
    cleaned = clean_markup(spark.createDataFrame(rows, "row_id long, page_content string, markups string"))
    assert {(r.row_id, r.markup) for r in markup_found(cleaned).collect()} == {(1, "html"), (4, "markdown")}
    assert cleaned.count() == 5 and cleaned.where("row_id = 2").first().clean_text is None
    assert clean_markup(spark.createDataFrame([], "row_id long, page_content string")).count() == 0


@pytest.mark.parametrize(
    "question, answer, proper, want",
    [
        ("Who?", None, None, "empty"), ("Who?", " ​\n", None, "empty"), ("Who?", "N/A", None, "empty"), ("Who?", "...", None, "empty"),
        ("How do I fold a paper boat?", "How do I fold a paper boat?", None, "copy"),
        ("How do I fold a paper boat?", "You asked: how do I fold a paper boat", None, "copy"),
        ("怎样给盆栽浇水？", "您问的是：怎样给盆栽浇水？", None, "copy"),
        ("How do I fold a paper boat?", "How do I fold a paper boat? Crease the sheet twice and pull the ends apart.", None, None),
        ("Who won?", "Sorry, I can't help with that question.", None, "refusal"), ("Who won?", "Sorry, I can't help with that question.", True, None),
        ("谁赢了？", "谁赢了？根据现有资料无法回答。", False, "refusal"), ("Who won?", "No relevant passages were found; please rephrase.", False, "refusal"),
        ("Who won?", "The notes cannot answer every detail, but this much is clear: the blue team won the match.", False, None),
        ("Who won?", "The blue team won the match and then went home with the", False, "truncated"),
        ("Who won?", "The team won.\n```python\nfor x in", False, "truncated"), ("Who won?", "`blue_team`", False, None), ("Where?", "the_path = 7", False, None),
        ("Who won the match?", "Das blaue Team hat das Spiel gewonnen und ist nach Hause gegangen.", False, "other_language"),
        ("Who won the match? Please answer in German.", "Das blaue Team hat das Spiel gewonnen.", False, None),
        ("谁赢了比赛？（请用英文回答）", "The blue team won the match.", False, None), ("谁赢了比赛？", "The blue team won the match.[1]", False, "other_language"),
        (None, "The blue team won the match.", False, None), ("", "Das ist so.", False, None),
        ("Who won?", "word " * 50_000 + "end.", False, None),
    ],
)
def test_pair_defects(question, answer, proper, want):
    assert defect(question, answer, proper) == want


def test_languages():
    assert [language(t) for t in ("the cat is on the mat", "der Hund ist nicht da", "el perro no está", "le chien est dans la cour", "猫在这里", "12 + x_1")] == [
        "en", "de", "es", "fr", "zh", None,
    ]
    assert requested_language("谁？（请用英文回答）")[0] == "en" and requested_language("Who speaks in German?")[0] is None


def test_defect_frame(spark):
    schema = "row_id long, question string, answer string, judge struct<refusal_appropriate boolean>, defect string"
    rows = [(1, "Who?", None, None, "x"), (1, "Who?", None, None, "x"), (2, "Who won?", "The blue team won.", (None,), "x"), (3, "Who won?", "I cannot answer this.", (True,), "x")]
    assert [tuple(r) for r in defective_pairs(spark.createDataFrame(rows, schema)).collect()] == [(1, "empty"), (1, "empty")]
    assert defective_pairs(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize(
    "text, cut",
    [
        ("A sentence. Another one.", False), ("A sentence. Another on", True), ("句子。另一个句", True), ("He said \"yes.\"", False),
        ("Text.\n\n```\ncode", True), ("Text.\n\n```\ncode\n```", False), ("| a | b |\n|---|---|\n| 1 | 2 |", False), ("| a | b |\n|---|---|\n| 1 |", True),
        ("A sentence. Anoth\n\n-- Docs group, 2024-01-02", True), ("A sentence.\n\n-- Docs group, 2024-01-02", False),
        ("Done.\nTags: a_b, c_d", False), ("Not do\nTags: a_b, c_d", True), ("Done.\n\nhttps://x.invalid/a.html", False), ("A sentence. And so…", True),
        ("A sentence. (see the", True), ("A sentence &am", True), ("A sentence �", True), ("Done.\n\n🙂", False), ("x <!-- open. ", True),
        ("\\begin{itemize}\n\\item One.", True), ("one\ntwo\nthree\nfour", False), ("w" * 100_000 + ".", False),
    ],
)
def test_truncation(text, cut):
    assert (examine(text).reason is not None) == cut


def test_truncation_baseline_and_report(spark):
    prose = "One line here.\n\nTwo lines there.\n\nAnd a third one"
    loose = "one line here\n\ntwo lines there\n\nand a third one"
    rows = [(1, prose, "a", "x"), (2, prose + ".", "a", "x"), (3, loose, "b", "x"), (4, loose, None, "x"), (5, None, "a", "x"), (6, " 　\n", "a", "x"), (1, prose, "a", "x")]
    judged = truncated_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, cut string"))
    assert sorted((r.doc_id, r.cut) for r in judged.collect()) == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    assert {(r.source, r.texts, r.cut_texts) for r in truncation_report(judged).collect()} == {("a", 3, 2), ("b", 1, 0), (None, 1, 0)}
    assert truncated_documents(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


SCHEMA = "id long, owner string, thread_id string, role string, content string, created_at timestamp"


def test_conversations(spark, tmp_path):
    import datetime as dt

    at = lambda h: dt.datetime(2024, 5, 1) + dt.timedelta(hours=h)
    rows = [
        (1, "o", "ok", "User", "hi", at(0)), (2, "o", "ok", " AI", "hello", at(1)), (3, "o", "ok", "human", "more", at(60)), (4, "o", "ok", "assistant", "yes", at(61)),
        (9, "o", "ok", "User", "hi", at(0)), (5, "o", "ok", "tool", "t", at(2)), (6, "o", "ok", "user", "​", at(3)),
        (10, "p", "ok", "assistant", "alone", at(0)),                                   # same thread id, another owner
        (11, "o", "wait", "user", "a", at(0)), (12, "o", "wait", "user", "b", at(50)), (13, "o", "wait", "assistant", "c", at(51)),
        (14, "o", "end", "user", "a", at(0)), (15, "o", "twice", "user", "a", at(0)), (16, "o", "twice", "assistant", "b", at(0)), (17, "o", "twice", "ai", "c", at(99)),
        (18, "o", "void", "system", "s", at(0)), (19, "o", "void", "user", None, at(1)), (20, "o", "odd", "user", "a", at(0)), (21, "o", "odd", "usr", "b", at(1)),
        (22, "o", "timeless", "user", "a", None), (23, None, None, "user", "a", at(1)), (24, "o", "x" * 5000, "user", "y" * 100_000, at(0)),
    ]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    got = {(r.owner, r.thread_id, r.defect) for r in dropped_threads(spark, path).collect()}
    assert got == {
        ("p", "ok", "broken"), ("o", "wait", "no_reply"), ("o", "end", "no_reply"), ("o", "twice", "broken"), ("o", "void", "empty"),
        ("o", "odd", "broken"), ("o", "timeless", "broken"), (None, None, "no_reply"), ("o", "x" * 5000, "no_reply"),
    }
    turns = sound_turns(spark, path).orderBy("turn").collect()
    assert [(r.turn, r.role, r.content, r.id) for r in turns] == [(0, "user", "hi", 1), (1, "assistant", "hello", 2), (2, "user", "more", 3), (3, "assistant", "yes", 4)]
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    assert dropped_threads(spark, str(tmp_path / "none")).count() == 0
