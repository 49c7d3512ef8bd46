"""Languages most of whose sentences bear another's label."""

import random

import numpy as np
from test_text_operators import TEXTS

from boughline.llm.language import clean_labels, sentences


def cleaned(wrong, seed=1):
    """Sentences' true languages, and those found where ``wrong`` gives (language, label): share."""
    rng, labels, ids = random.Random(seed), ["de", "en", "fr", "uk"], {}
    words, given, true = [], [], []
    for _ in range(600):
        lang = rng.choice(["de", "de", "en", "en", "en", "fr"])
        text = rng.choice(TEXTS[lang])
        label = next((b for (a, b), share in wrong.items() if a == lang and rng.random() < share), lang)
        for _, ws in sentences(text)[0]:
            words.append(np.array([ids.setdefault(w, len(ids)) for w in ws]))
            given.append(labels.index(label))
            true.append(labels.index(lang))
    return np.array(true), clean_labels(labels, words, np.array(given), list(ids))


def test_mostly_mislabelled_language_is_kept():
    true, found = cleaned({("fr", "en"): 0.85})
    assert (found[true == 2] == 2).mean() > 0.95 and (found == true).mean() > 0.95


def test_label_of_other_languages_sentences_is_dropped():
    true, found = cleaned({("en", "uk"): 0.1})
    assert (found == true).mean() > 0.98
