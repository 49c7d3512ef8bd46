"""Chains of any length, texts that only begin like commits, and models that are kept."""

import numpy as np
import pytest
from test_text_operators import CODES, TEXTS, labelled

from boughline.llm import language
from boughline.llm.language import _chains, document_languages, fit, label_texts, load_model, save_model, sentences, untrained


@pytest.mark.parametrize("pairs", [False, True])
def test_long_chains_equal_short_ones(monkeypatch, pairs):
    rng = np.random.default_rng(1)
    model = untrained(["a", "b", "c"])
    model.steps, model.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    emissions = rng.normal(size=(20, 3)) * 2
    chains = [rng.integers(0, 20, n) for n in (1, 2, 7, 50, 333)]
    whole = _chains(chains, emissions, model, pairs)
    monkeypatch.setattr(language, "STRETCH", 6)
    parts = _chains(chains, emissions, model, pairs)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(whole[0], parts[0], strict=True))
    assert np.allclose(whole[1], parts[1], atol=1e-4) and np.allclose(whole[2], parts[2], atol=1e-4)


def test_blocks_hold_each_chain_once(monkeypatch):
    monkeypatch.setattr(language, "BLOCK_WORDS", 30)
    sizes = np.array([5, 1, 29, 31, 2, 2, 40, 1])
    blocks = list(language._blocks(sizes))
    assert sorted(np.concatenate(blocks)) == list(range(8)) and all(len(b) == 1 or sizes[b].max() * len(b) <= 30 for b in blocks)


def test_a_paragraph_is_one_chain_whatever_its_length():
    model = fit(CODES, [(body, given) for _, _, given, body in labelled(200)])
    text = " ".join(TEXTS["de"] * 1500)
    found = label_texts([text], model, {}, [])[0]
    assert sum(n for _, n, _, _ in found) > language.STRETCH and {lang for _, _, lang, _ in found} == {"de"}
    assert len(sentences("word " * 20_000)[0][0][1]) == 20_000


def test_prose_that_begins_like_a_commit():
    assert [[ws for _, ws in p] for p in sentences("commit to the plan before friday.\nIt is late.")] == [[["commit", "to", "the", "plan", "before", "friday"], ["it", "is", "late"]]]
    assert sentences("commit 12ab\nAuthor: X\n\n    Read it.\n") == [[("Read it.", ["read", "it"])]]


def test_model_saved_and_loaded(spark, tmp_path):
    rows = [(i, body, given) for i, _, given, body in labelled(150)]
    model = fit(CODES, [(body, given) for _, body, given in rows])
    save_model(spark, model, str(tmp_path / "model"))
    again = load_model(spark, str(tmp_path / "model"))
    assert again.labels == model.labels and np.array_equal(again.weights, model.weights) and np.array_equal(again.steps, model.steps) and np.array_equal(again.start, model.start)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    read = lambda m: sorted((r["doc_id"], r["lang"]) for r in document_languages(df, CODES, model=m).collect())
    assert read(again) == read(model)


def test_sample_is_bounded_in_bytes(spark):
    rows = [(i, body, given) for i, _, given, body in labelled(60)] + [(1000, "word " * 50_000, "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    seen = []
    real = language.fit
    try:
        language.fit = lambda codes, documents: seen.extend(documents) or real(codes, documents)
        language.fit_languages(df, CODES, train_bytes=2000)
    finally:
        language.fit = real
    assert 10 < len(seen) and sum(len(t.encode()) for t, _ in seen) <= 2000
