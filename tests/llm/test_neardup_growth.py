"""Near duplicates on tables where fixed bands would bring together ever more unlike texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from lorequarry.llm import neardup
from lorequarry.llm.codepoints import code_points, mix
from lorequarry.llm.neardup import band_keys, bands_needed, gram_sets, minima, near_duplicate_classes, plan_bands, shared_grams


def _sets(rng, texts, size, words):
    """Gram sets drawn from a small vocabulary, so that unlike ones share many grams."""
    rows = np.argsort(rng.random((texts, words)), axis=1)[:, :size].astype(np.uint64)
    return mix(np.sort(rows, axis=1).reshape(-1)) >> np.uint64(1), np.arange(texts + 1) * size


def _meetings(keys):
    return sum(int((c * (c - 1) // 2).sum()) for c in (np.unique(k, return_counts=True)[1] for k in keys.T))


def test_pairs_that_meet_do_not_grow_with_the_square_of_the_texts():
    rng = np.random.default_rng(4)
    a_text = []
    for texts in (1000, 8000):
        grams, offsets = _sets(rng, texts, 60, 110)  # similarity of unlike texts: 0.37
        sketch = minima(mix(grams[: 60 * 500]), offsets[:501], 0, 64)
        same = (sketch[:, None] == sketch[None]).sum(axis=2)[np.triu_indices(500, 1)]
        rows, bands = plan_bands(np.bincount(same, minlength=65), texts, 0.8)
        a_text.append(_meetings(band_keys(grams, offsets, rows, bands)) / texts)
    fixed = _meetings(band_keys(grams, offsets, 5, 33)) / texts
    assert a_text[1] < 2 * a_text[0] + 100 and fixed > 4 * a_text[1]


@pytest.mark.parametrize("union", [5, 40, 400])
def test_values_agree_with_the_chance_of_the_similarity(union):
    rng = np.random.default_rng(union)
    grams = mix(rng.integers(0, 1 << 62, (1500, union)).astype(np.uint64))
    one, other = grams[:, : union - union // 10], grams[:, union // 5 - union // 10 :]  # 0.8 of the union in both
    tables = [minima(x.reshape(-1), np.arange(1501) * x.shape[1], 3, 128) for x in (one, other)]
    assert abs((tables[0] == tables[1]).mean() - 0.8) < 0.03
    for rows in (1, 5, 8, 12):
        assert (1 - 0.8**rows) ** bands_needed(rows, 0.8) <= neardup.MISS
    assert bands_needed(3, 1.0) == 1


def test_rounds_give_the_same_links(spark, monkeypatch):
    base = ["".join(chr(97 + (i * k * k + k) % 23) for k in range(90)) + "😀🙂"[i % 2] for i in range(1, 40)]
    texts = base + [t[:40] + "#" + t[41:] for t in base] + ["ab", "", None, base[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, page_content string")
    want = {tuple(r)[:2] for r in near_duplicate_classes(df, exact=True)[1].collect()}
    monkeypatch.setattr(neardup, "plan_bands", lambda *_: (8, bands_needed(8, 0.8)))
    monkeypatch.setattr(neardup, "_ROUND_ROWS", 1)
    monkeypatch.setattr(neardup, "_ROUND_BANDS", 30)
    got = [tuple(r)[:2] for r in near_duplicate_classes(df)[1].collect()]
    assert want and set(got) == want and len(got) == len(want)


def test_grams_beyond_16_bits():
    texts = ["a😀b🙂c", "😀b🙂", "plain", "", "𝔸𝔹ℂ𝔻"]
    grams, offsets = gram_sets(*code_points(pa.array(texts)))
    as_text = lambda g: "".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0))
    for i, text in enumerate(texts):
        assert {as_text(g) for g in grams[offsets[i] : offsets[i + 1]]} == {text[k : k + 3] for k in range(len(text) - 2)}
    assert [list(x) for x in shared_grams(pa.array(texts[:2]), pa.array(["a😀b", "😀b🙂"]))] == [[3, 1], [1, 1], [1, 1]]
