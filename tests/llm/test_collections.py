from __future__ import annotations

import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from lorequarry.llm.dressed import distinct_contents, dressed_copies, same_content
from lorequarry.llm.leakage import leaked_passages
from lorequarry.llm.neardup import near_duplicate_classes, near_duplicate_pairs, near_duplicate_rows
from lorequarry.llm.packing import container_fill, pack_documents, pack_histogram, slot_table
from lorequarry.llm.splitting import oversized_rows, split_oversized, split_text

WORDS = "gate window rank 召回 检索 fuse merge 片段 budget policy depth、 offset。 token. batch\n".split(" ")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(n))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab c.,\n#`-。，\tx", max_size=2500))
def test_pieces_tile_the_text(text):
    pieces = split_text(text, 60, 5)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= 60 for a, b, _ in pieces)
    for (_, end, kind), (start, _, _) in zip(pieces, pieces[1:]):
        assert 0 <= end - start <= 5 and kind in ("natural", "hard")


def test_splitting(spark):
    run = "x" * 900
    rows = [(1, "s", "word " * 300, 1), (2, None, run, 2), (3, "s", None, 3), (4, "s", "", 4), (5, "s", "short", 5), (6, "", "y" * 580 + ". " + "z" * 590, 6), (5, "s", "short", 5)]
    pieces = split_oversized(spark.createDataFrame(rows, "row_id long, section_path string, page_content string, piece_no long"))
    assert {tuple(r) for r in oversized_rows(pieces).collect()} == {(1, "natural"), (2, "hard"), (6, "natural")}
    assert pieces.where("length(piece) > 600").count() == 0
    assert pieces.where("row_id = 4").count() == 1 and pieces.where("row_id = 3").count() == 0 and pieces.where("row_id = 5").count() == 2
    text = "# One\n\n" + "A sentence here. " * 20 + "\n\n```\n" + "code line\n" * 20 + "```\n\n# Two\n\n" + "B sentence there. " * 20
    parts = split_text(text)
    assert not any("code line" in text[a:b] and "```\n" not in text[a:b] for a, b, _ in parts)
    with pytest.raises(ValueError):
        split_text("x" * 700, 50, 50)


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Hello, World!", "hello   world", True), ("a b", "ac b", False), ('{"a": 1, "b": [2, 3]}', '{"b":[2,3],"a":"1"}', True), ('{"a": 1, "b": 2}', '{"a": 2, "b": 1}', False),
        ("k=v; x=Y", "X: y\nk: V", True), ('{"k": "v", "x": "y"}', "x=y; k=v", True), ("a=b; c=d", "a b c d", True), ("one two", "two one", False),
        ('{"a": [1, 2], "b": 0}', '{"a": [2, 1], "b": 0}', False), ('{"a": {"x": 1, "y": 2}, "b": 0}', '{"b": 0, "a": {"y": 2, "x": 1}}', True),
    ],
)
def test_same_content(a, b, same):
    assert same_content(a, b) == same


def test_dressed_copies(spark):
    rows = [(9, "A b!"), (3, "a  B"), (7, "ab"), (4, None), (5, "…"), (6, ""), (8, "k=v; x=y"), (2, "x: Y\nk: v"), (1, "K V, X Y"), (10, "z" * 300_000), (11, "Z" * 300_000)]
    rows += [(100 + i, "hot TEXT" if i % 2 else "Hot, text") for i in range(200)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "row_id long, page_content string, copies string")
    want = {(3, 7), (3, 9), (1, 2), (1, 8), (10, 11)} | {(100, 100 + i) for i in range(1, 200)}
    got = [tuple(r) for r in dressed_copies(df).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {(r.keep_id, r.copies) for r in distinct_contents(df).collect()} == {(3, 3), (1, 3), (10, 2), (100, 200)}
    empty = spark.createDataFrame([], "row_id long, page_content string")
    assert dressed_copies(empty).count() == 0 and distinct_contents(empty).count() == 0


def _grams(text):
    bare = "".join(text.split())
    return {bare[i : i + 3] for i in range(len(bare) - 2)}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = prose(rng, rng.randrange(4, 60))
        texts.append(base)
        for _ in range(rng.randrange(5)):
            words = base.split(" ")
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    texts += ["same"] * 30 + ["ab", "ab", "a b", "!!", "!!", "", None, "。", "x" * 50_000, "x" * 50_000 + "y", "tiny", "tin"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "row_id long, page_content string, id string")
    want = set()
    for j, b in enumerate(texts):
        for i, a in enumerate(texts[:j]):
            if a and b and any(c.isalnum() for c in a) and any(c.isalnum() for c in b):
                x, y = _grams(a), _grams(b)
                if "".join(a.split()) == "".join(b.split()) or (x | y and len(x & y) * 5 >= len(x | y) * 4):
                    want.add((i, j))
    got = [tuple(r) for r in near_duplicate_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want)
    by_bands, by_prefixes = ({tuple(r) for r in near_duplicate_classes(df, exact=e)[1].collect()} for e in (False, True))
    assert by_bands == by_prefixes and by_bands
    members, links = near_duplicate_classes(df)
    assert members.groupBy("class_id").count().agg({"count": "max"}).first()[0] == 30
    assert links.where("a >= b").count() == 0
    assert near_duplicate_rows(df).count() == members.count()
    assert near_duplicate_pairs(spark.createDataFrame([], "row_id long, page_content string")).count() == 0


def test_packing(spark):
    rng = random.Random(2)
    histogram = Counter(min(2048, int(rng.lognormvariate(5, 1)) + 1) for _ in range(5000))
    patterns = pack_histogram(dict(histogram), 2048)
    placed = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 2048
        for length in pattern:
            placed[length] += count
    assert placed == histogram
    used = sum(k * v for k, v in histogram.items())
    assert used / (2048 * sum(c for _, c in patterns)) > 0.98
    assert set(slot_table(patterns)) == set(histogram)
    assert pack_histogram({}, 10) == []
    with pytest.raises(ValueError):
        pack_histogram({11: 1}, 10)

    texts = [None, "", " "] + ["word " * rng.randrange(1, 400) for _ in range(120)] + ["same words here"] * 80 + ["long text " * 3000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, container_id int")
    rows = pack_documents(df, salts=4).collect()
    fill, parts = Counter(), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append((r.piece_no, r.start_token, r.n_tokens))
        if r.container_id is not None:
            fill[r.container_id] += r.n_tokens
    assert set(parts) == set(range(len(texts))) and max(fill.values()) <= 2048
    assert sorted(fill) == list(range(len(fill)))
    for pieces in parts.values():
        at = 0
        for n, (number, start, size) in enumerate(sorted(pieces)):
            assert (number, start) == (n, at)
            at += size
    assert all(len(p) == 1 for d, p in parts.items() if d != len(texts) - 1) and len(parts[len(texts) - 1]) > 1
    assert {r.doc_id for r in rows if r.container_id is None} == {0, 1}
    assert sorted(tuple(r) for r in pack_documents(df.repartition(7), salts=4).collect() if r.container_id is not None) == sorted(
        tuple(r) for r in rows if r.container_id is not None
    )
    summary = container_fill(pack_documents(df)).first()
    assert summary.tokens == sum(fill.values()) and summary.containers == len(fill)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(none).count() == 0 and container_fill(pack_documents(none)).first().containers == 0


def _bare(text):
    return "".join(c for c in text.lower() if unicodedata.category(c)[0] in "LN")


def test_leaks_match_brute_force(spark):
    rng = random.Random(8)
    held = [(i, prose(rng, 12).replace("\n", " "), "en") for i in range(12)]
    held += [(100, "参考解答先加上八盏灯再减去遗失的九盏灯请在开春之前归还地图并且解释其中的原因", "zh"), (101, None, "en"), (102, "short", "en"), (103, held[0][1], "en")]
    docs = [None, "", "İstanbul ẞ"]
    for i in range(60):
        text = prose(rng, rng.randrange(3, 80))
        _, passage, _ = held[rng.randrange(12)]
        if i % 3 == 0:
            cut = rng.randrange(0, len(passage) // 2)
            text += " " + passage[cut : cut + rng.randrange(40, 120)].upper() + " " + prose(rng, 5)
        if i % 7 == 0:
            text = text.replace(" ", " \n* ") + held[12][1][3 : 3 + rng.randrange(20, 30)]
        docs.append(text)
    docs += [docs[-1], held[0][1] * 500]
    want = set()
    for d, text in enumerate(docs):
        bare = _bare(text or "")
        for i, passage, lang in held:
            item, run = _bare(passage or ""), 24 if lang == "zh" else 60
            if any(item[k : k + run] in bare for k in range(len(item) - run + 1)):
                want.add((d, i))
    documents = spark.createDataFrame([(d, t, 1) for d, t in enumerate(docs)], "doc_id long, text string, item_id int")
    heldout = spark.createDataFrame(held, "item_id long, passage string, lang string")
    for bits in (16, 1):  # a crowded bit table loses nothing
        assert {(r.doc_id, r.item_id) for r in leaked_passages(documents, heldout, bits_each=bits).collect()} == want
    assert leaked_passages(documents.where("false"), heldout).count() == 0
    assert leaked_passages(documents, heldout.where("false")).count() == 0
    with pytest.raises(ValueError):
        leaked_passages(documents, heldout, min_run=8)
