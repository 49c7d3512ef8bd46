"""Languages of documents and of the segments of mixed ones.

A linear-chain conditional random field labels every word of a message with a
language: affixes, character n-grams and lexicons give the emissions,
transitions between the languages of neighbouring words are learned, and
forward-backward gives each word its probabilities. A sentence has the
language of its words on average, a document those of its sentences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boughline.operators.common import discard, settle

#: Labelled documents the model is fitted on: those of the smallest key hashes, whatever the size of the input.
TRAIN_DOCS = 6000
#: Bytes of messages that the sample has at most; documents that exceed what is left of it are passed over.
TRAIN_BYTES = 32 << 20
#: Sentences of one language that the chain is fitted on.
TRAIN_SENTENCES = 1500
#: Steps of the optimiser.
STEPS = 45
#: Rounds that clean labels, and how many times likelier a document's label makes its language.
CLEAN_ROUNDS = 6
LABEL_ODDS = 4.0
#: Part of a language's sentences that must bear its label, else its words are compared with the other languages'.
RELIABLE_AT = 0.25
#: Overlap of word distributions (Bhattacharyya) from which two languages can't be told apart.
ALIKE_AT = 0.8
#: Words that a sentence's evidence counts as at most, since its words aren't independent.
EVIDENCE_WORDS = 4
#: Hash buckets of word, affix and n-gram features.
BUCKETS = 1 << 15
#: Words whose states are held at a time; longer chains are labelled as one all the same, in stretches.
STRETCH = 4096
#: Words of one block of chains that are labelled together.
BLOCK_WORDS = 200_000

# Frequent function words of each language, the prior of the lexicon features.
LEXICON = {
    "ca": "amb els perquè però també això aquest una dels sense",
    "cs": "že jsem není jako nebo při pro byl který jen",
    "de": "der die das und nicht ist mit den auf wird ein",
    "en": "the and of to is was were with this for when",
    "es": "el los las que para con una por ya pero sin",
    "fr": "le les des une est dans pour pas avec ce cette",
    "it": "il gli della che per non con una alla ogni senza",
    "nl": "het een van niet met voor naar wordt deze maar ook",
    "pl": "nie się jest przez tylko oraz bez przy jako więc już",
    "pt": "não uma para com dos sem ou mais pela quando isso",
    "ru": "не на что для был только уже при это если мы",
    "sv": "och att det inte för som är med utan när vi",
    "uk": "не що для був тільки вже при це якщо ми та",
}
# Letters that tell a language from its neighbours.
LETTERS = {"ca": "ŀ", "cs": "ěřůťď", "de": "ßäöü", "es": "ñ¿¡", "fr": "œêèâîû", "it": "ìò", "pl": "łżźąęśćń", "pt": "ãõ", "ru": "ыэёъ", "sv": "åäö", "uk": "іїєґ"}

_IDENT = r"[!-~]*[0-9_/\\@=<>{}#$%^*+|~][!-~]*"
_DROPPED = re.compile(r'`[^`]*`|"[^"]*"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|『[^』]*』|' + _IDENT)
_WORD = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]+|[^\W\d_぀-ヿ㐀-鿿豈-﫿]+")
_PREFIX = re.compile(r"^(?:\[[^\]]*\]\s*|WIP:?\s+|[A-Za-z][\w./-]*(?:\([^)]*\))?!?:\s+)+")
_TRAILER = re.compile(r"^(?:[A-Z][A-Za-z]*(?:-[A-Za-z]+)+|Cc|Fixes|Closes|Refs|Bug|Link|See):|^\(cherry picked from|^Conflicts:\s*$")
_CODE_END = re.compile(r"[;{}]$")
_PROSE_END = re.compile(r"[.!?…,:]$")
_SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
#: First line of a commit.
_COMMIT = "^commit [0-9a-f]+"


def _listed(line: str) -> bool:
    """Whether an indented line is a path or code: a single token that ends no clause, or half of it identifiers at least."""
    body = line.strip()
    if line[:1] not in ("\t", " ") or _CJK.search(body):
        return False
    tokens = body.split()
    if len(tokens) == 1 and not _PROSE_END.search(body) or _CODE_END.search(body):
        return True
    return 2 * len(_WORD.findall(_DROPPED.sub(" ", body))) <= len(tokens)


def sentences(text: str) -> list[list[tuple[str, list[str]]]]:
    """Paragraphs of a message's natural language, each a list of (sentence, words).

    Of a commit only the indented lines are its message. Quote marks of
    replies are removed; trailers, file lists and code (``_listed``),
    identifiers and quoted phrases are no words. Whole texts are read.
    """
    lines = text.replace("\r", "").split("\n")
    if re.match(_COMMIT + r"\b", lines[0]):
        lines = [x[4:] if x.startswith("    ") else "" for x in lines]
    paragraphs, held, level = [], [], ""
    for line in [*lines, ""]:
        body = line.lstrip("> ") if line.startswith(">") else line
        mark = ">" if line.startswith(">") else ""
        skip = not body.strip() or _TRAILER.match(body) or _listed(body)
        if held and (skip or mark != level):
            paragraphs.append(" ".join(held))
            held = []
        if not skip:
            held.append(body.strip())
            level = mark
    out = []
    for i, p in enumerate(paragraphs):
        found = []
        for s in _SENTENCE_END.split(p):
            words: list[str] = []
            for w in _WORD.findall(_DROPPED.sub(" ", _PREFIX.sub("", s) if i == 0 else s).lower()):
                words += [w[k : k + 2] for k in range(len(w))] if _CJK.match(w) else [w]
            if words:
                found.append((s, words))
        if found:
            out.append(found)
    return out


@dataclass
class Model:
    """Fitted weights; ``labels`` are the languages in the order of the columns."""

    labels: list[str]
    weights: np.ndarray
    steps: np.ndarray
    start: np.ndarray

    def features(self, word: str) -> list[int]:
        n, size = len(self.labels), BUCKETS
        h = lambda kind, s: zlib.crc32(f"{kind}{s}".encode()) % size
        out = [h("w", word)]
        if _CJK.match(word):
            out += [h("c", word[0]), h("s", "kana" if word[0] < "㐀" else "han")]
        else:
            out += [h("p", word[:k]) for k in (1, 2, 3) if len(word) >= k] + [h("x", word[-k:]) for k in (1, 2, 3, 4) if len(word) >= k]
            framed = f"^{word}$"
            out += [h("n", framed[k : k + g]) for g in (2, 3) for k in range(len(framed) - g + 1)]
        for i, lang in enumerate(self.labels):
            if word in _WORDS.get(lang, ()):
                out.append(size + i)
            if _CHARS.get(lang, frozenset()) & set(word):
                out.append(size + n + i)
        if _CJK.match(word):
            out.append(size + 2 * n + (0 if "぀" <= word[0] <= "ヿ" else 1))
        return out

    def emissions(self, words: list[str]) -> np.ndarray:
        flat, counts = [], []
        for w in words:
            f = self.features(w)
            flat += f
            counts.append(len(f))
        if not words:
            return np.zeros((0, len(self.labels)))
        return np.add.reduceat(self.weights[np.array(flat)], np.concatenate([[0], np.cumsum(counts)[:-1]]))


_WORDS = {k: frozenset(v.split()) for k, v in LEXICON.items()}
_CHARS = {k: frozenset(v) for k, v in LETTERS.items()}


def untrained(labels: list[str]) -> Model:
    """A model that knows the lexicons, letters and scripts alone."""
    n = len(labels)
    weights = np.zeros((BUCKETS + 2 * n + 2, n))
    for i, lang in enumerate(labels):
        weights[BUCKETS + i, i] = 2.0
        weights[BUCKETS + n + i, i] = 1.0
        if lang == "ja":
            weights[BUCKETS + 2 * n, i] = 4.0
        if lang in ("ja", "zh"):
            weights[BUCKETS + 2 * n + 1, i] = 3.0
    return Model(labels, weights, np.eye(n) * 1.0, np.zeros(n))


def _blocks(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of chains of up to ``STRETCH`` words, of similar lengths, in blocks of about ``BLOCK_WORDS`` words."""
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] <= STRETCH]
    at = 0
    while at < len(order):
        # The longest of a block is its last: as many chains as fit, were all of them that long.
        widths = sizes[order[at:]] * np.arange(1, len(order) - at + 1)
        n = max(1, int(np.searchsorted(widths, BLOCK_WORDS, side="right")))
        yield order[at : at + n]
        at += n


def _long_chain(ids: np.ndarray, potential: np.ndarray, exp_steps: np.ndarray, exp_start: np.ndarray, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over one chain of any length: states are held per stretch and made again, stretch by stretch, from the end."""
    n, starts = len(exp_start), range(0, len(ids), STRETCH)

    def forward(low: int, state: np.ndarray | None) -> np.ndarray:
        rows = np.empty((min(STRETCH, len(ids) - low), n))
        for t in range(len(rows)):
            state = (exp_start if state is None else state @ exp_steps) * potential[ids[low + t]]
            state = state / state.sum()
            rows[t] = state
        return rows

    entering: list[np.ndarray | None] = [None]
    for low in starts:
        entering.append(forward(low, entering[-1])[-1])
    out, expected, back = np.empty((len(ids), n), np.float32), np.zeros((n, n)), np.ones(n)
    for k in range(len(starts) - 1, -1, -1):
        rows = forward(starts[k], entering[k])
        for t in range(len(rows) - 1, -1, -1):
            both = rows[t] * back
            out[starts[k] + t] = both / both.sum()
            ahead = potential[ids[starts[k] + t]] * back
            before = rows[t - 1] if t else entering[k]
            if pairs and before is not None:
                expected += exp_steps * np.outer(before, ahead) / ((before @ exp_steps) * ahead).sum()
            back = exp_steps @ ahead
            back /= back.sum()
    return out, expected


def _chains(chains: list[np.ndarray], emissions: np.ndarray, model: Model, pairs: bool = False) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Forward-backward over chains of word ids: word probabilities, expected transitions and starts."""
    n = len(model.labels)
    exp_steps, exp_start = np.exp(model.steps), np.exp(model.start)
    potential = np.exp(emissions - emissions.max(axis=1, keepdims=True)) + 1e-12
    sizes = np.array([len(c) for c in chains], np.int64)
    out: list[np.ndarray | None] = [None] * len(chains)
    expected, starts = np.zeros((n, n)), np.zeros(n)
    for i in np.flatnonzero(sizes > STRETCH):
        out[i], more = _long_chain(chains[i], potential, exp_steps, exp_start, pairs)
        expected += more
        starts += out[i][0]
    for ids in _blocks(sizes):
        size = sizes[ids]
        longest = int(size[-1])
        grid = np.zeros((len(ids), longest), np.int64)
        for row, i in enumerate(ids):
            grid[row, : size[row]] = chains[i]
        forward = np.empty((longest, len(ids), n))
        backward = np.ones((longest, len(ids), n))
        state = exp_start * potential[grid[:, 0]]
        forward[0] = state / state.sum(axis=1, keepdims=True)
        for t in range(1, longest):
            state = (forward[t - 1] @ exp_steps) * potential[grid[:, t]]
            forward[t] = state / state.sum(axis=1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            ahead = potential[grid[:, t + 1]] * backward[t + 1]
            state = ahead @ exp_steps.T
            live = size > t + 1
            state /= state.sum(axis=1, keepdims=True)
            backward[t] = np.where(live[:, None], state, 1.0)
            if pairs and live.any():
                f, a = forward[t][live], ahead[live]
                norm = ((f @ exp_steps) * a).sum(axis=1, keepdims=True)
                expected += exp_steps * ((f / norm).T @ a)
        both = forward * backward
        both /= both.sum(axis=2, keepdims=True)
        starts += both[0].sum(axis=0)
        for row, i in enumerate(ids):
            out[i] = both[: size[row], row]
    return out, expected, starts


def clean_labels(labels: list[str], words: list[np.ndarray], given: np.ndarray, vocabulary: list[str], rounds: int = CLEAN_ROUNDS) -> np.ndarray:
    """The language of each sentence where documents' labels are wrong or true of a part only.

    Expectation maximisation over a mixture of word distributions, one per
    language, started from the labels: a sentence goes where its words go, and
    the label of its document counts ``LABEL_ODDS`` times only. A sentence is no
    evidence of its own (it is left out of the counts it is judged by). A
    language few of whose sentences bear its label (``RELIABLE_AT``) is none that
    occurs if its words are another's (``ALIKE_AT``) or none is of its lexicon:
    its labels were given to other languages' sentences, to which they return.
    """
    n = len(labels)
    flat, size = np.concatenate(words), np.array([len(w) for w in words])
    first, owner = np.concatenate([[0], np.cumsum(size)[:-1]]), np.repeat(np.arange(len(words)), size)
    known = np.array([[2.0 if w in _WORDS.get(lang, ()) else 0.0 for lang in labels] for w in vocabulary])
    bonus = np.zeros((len(words), n))
    bonus[np.arange(len(words)), given] = np.log(LABEL_ODDS)
    belief = np.full((len(words), n), 0.1 / n)
    belief[np.arange(len(words)), given] += 0.9
    gone = np.zeros(n, bool)
    for round_no in range(rounds):
        if round_no > 1:
            held = belief.sum(axis=0)
            true = np.array([belief[given == j, j].sum() for j in range(n)])
            doubted = (true < RELIABLE_AT * held) & ~gone
            if doubted.any():
                used = np.array([np.bincount(flat, weights=belief[owner, j], minlength=len(vocabulary)) for j in range(n)])
                roots = np.sqrt(used / np.maximum(used.sum(axis=1, keepdims=True), 1e-9))
                for j in np.flatnonzero(doubted):
                    alike = np.delete(roots @ roots[j], j).max(initial=0.0)
                    unknown = labels[j] in _WORDS and used[j, known[:, j] > 0].sum() < 0.5
                    gone[j] = alike >= ALIKE_AT or unknown
        counts = known.copy()
        for j in range(n):
            counts[:, j] += np.bincount(flat, weights=belief[owner, j], minlength=len(vocabulary))
        own = belief[owner]
        rest = np.maximum(counts[flat] - own, 0) + 0.05
        total = counts.sum(axis=0) + 0.05 * len(vocabulary) - own * size[owner][:, None]
        score = np.add.reduceat(np.log(rest / np.maximum(total, 0.05)), first)
        score *= np.minimum(1, EVIDENCE_WORDS / size)[:, None]
        score += np.log(belief.sum(axis=0) + 1e-9) + bonus
        score[:, gone] = -1e9
        belief = np.exp(score - score.max(axis=1, keepdims=True))
        belief /= belief.sum(axis=1, keepdims=True)
    return belief.argmax(axis=1)


def fit(labels: list[str], documents: list[tuple[str, str]], steps: int = STEPS) -> Model:
    """Fits the model on ``(text, label)`` pairs, some of whose labels are wrong or true of a part only.

    Labels are cleaned per sentence first (``clean_labels``); the chain is then
    fitted to the likelihood of paragraphs whose words bear their sentence's
    language, at most about ``TRAIN_SENTENCES`` of a language.
    """
    model = untrained(labels)
    known = {lang: i for i, lang in enumerate(labels)}
    ids: dict[str, int] = {}
    bags, given, paragraphs = [], [], []
    for text, label in documents:
        for paragraph in sentences(text):
            members = []
            for _, ws in paragraph:
                members.append(len(bags))
                bags.append(np.array([ids.setdefault(w, len(ids)) for w in ws]))
                given.append(known[label])
            paragraphs.append(members)
    if not bags:
        return model
    words = list(ids)
    n = len(labels)
    truth = clean_labels(labels, bags, np.array(given), words)
    room = np.full(n, TRAIN_SENTENCES)
    chains, seen = [], []
    for members in paragraphs:
        own = truth[members]
        if (room[own] > 0).any():
            np.subtract.at(room, own, 1)
            chains.append(np.concatenate([bags[i] for i in members]))
            seen.append(np.repeat(own, [len(bags[i]) for i in members]))
    parts = [model.features(w) for w in words]
    flat = np.concatenate([np.array(p) for p in parts])
    owner = np.repeat(np.arange(len(words)), [len(p) for p in parts])
    firsts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
    by_feature = np.argsort(flat, kind="stable")
    used, used_at = np.unique(flat[by_feature], return_index=True)
    column = np.searchsorted(used, flat)
    occurrences, labelled = np.concatenate(chains), np.concatenate(seen)
    by_word = np.zeros((len(words), n))
    np.add.at(by_word, (occurrences, labelled), 1.0)
    observed, first_seen = np.zeros((n, n)), np.zeros(n)
    for g in seen:
        np.add.at(observed, (g[:-1], g[1:]), 1.0)
        first_seen[g[0]] += 1
    prior = model.weights[used].copy()
    weights, transitions, start = prior.copy(), model.steps.copy(), model.start.copy()
    moments = [np.zeros_like(x) for x in (weights, weights, transitions, transitions, start, start)]
    total = len(occurrences)
    for step in range(1, steps + 1):
        model.steps, model.start = transitions, start
        marginals, expected, starts = _chains(chains, np.add.reduceat(weights[column], firsts), model, pairs=True)
        mean = np.zeros((len(words), n))
        stacked = np.concatenate(marginals)
        for j in range(n):
            mean[:, j] = np.bincount(occurrences, weights=stacked[:, j], minlength=len(words))
        gradient = np.add.reduceat((by_word - mean)[owner[by_feature]], used_at)
        grads = (gradient / total - 1e-6 * (weights - prior), (observed - expected) / total - 1e-6 * transitions, (first_seen - starts) / total)
        for j, (x, g) in enumerate(zip((weights, transitions, start), grads, strict=True)):
            moments[2 * j] = 0.8 * moments[2 * j] + 0.2 * g
            moments[2 * j + 1] = 0.95 * moments[2 * j + 1] + 0.05 * g * g
            x += 0.15 / (1 - 0.8**step) * moments[2 * j] / (np.sqrt(moments[2 * j + 1] / (1 - 0.95**step)) + 1e-7)
    model.weights[used] = weights
    model.steps, model.start = transitions, start
    return model


def label_texts(texts: list[str | None], model: Model, cache: dict[str, int], emissions: list[np.ndarray]) -> list[list[tuple[str, int, str, float]]]:
    """For each text its sentences as (sentence, words, language, confidence); ``cache`` and ``emissions`` keep word types."""
    parsed = [sentences(t) if t else [] for t in texts]
    fresh = list(dict.fromkeys(w for doc in parsed for p in doc for _, ws in p for w in ws if w not in cache))
    if fresh:
        for w in fresh:
            cache[w] = len(cache)
        emissions.append(model.emissions(fresh).astype(np.float32))
    table = np.concatenate(emissions) if emissions else np.zeros((0, len(model.labels)), np.float32)
    emissions[:] = [table]
    chains = []
    for doc in parsed:
        for p in doc:
            chains.append(np.array([cache[w] for _, ws in p for w in ws]))
    marginals, _, _ = _chains(chains, table, model) if chains else ([], None, None)
    at, out = 0, []
    for doc in parsed:
        found = []
        for p in doc:
            probabilities, begin = marginals[at], 0
            at += 1
            for s, ws in p:
                mean = probabilities[begin : begin + len(ws)].mean(axis=0)
                begin += len(ws)
                best = int(mean.argmax())
                found.append((s, len(ws), model.labels[best], float(mean[best])))
        out.append(found)
    return out


#: Word types that a task keeps emissions of; beyond it the memory of them starts afresh.
WORD_TYPES = 500_000

SCHEMA = (
    "doc_id bigint, given string, lang string, confidence double, langs array<string>, "
    "segments array<struct<segment_no: int, lang: string, confidence: double, n_sentences: int, n_words: int, text: string>>"
)


def _document(found: list[tuple[str, int, str, float]]) -> tuple[str | None, float | None, list[str], list[dict]]:
    weight: dict[str, float] = {}
    segments: list[dict] = []
    for s, n, lang, p in found:
        weight[lang] = weight.get(lang, 0.0) + n * p
        if segments and segments[-1]["lang"] == lang:
            g = segments[-1]
            g["confidence"] = (g["confidence"] * g["n_words"] + p * n) / (g["n_words"] + n)
            g["n_sentences"] += 1
            g["n_words"] += n
            g["text"] += " " + s
        else:
            segments.append({"segment_no": len(segments) + 1, "lang": lang, "confidence": p, "n_sentences": 1, "n_words": n, "text": s})
    if not weight:
        return None, None, [], []
    best = max(sorted(weight), key=weight.__getitem__)
    return best, weight[best] / sum(n for _, n, _, _ in found), sorted(weight), segments


def _labeller(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache, emissions = shared.value, {}, []
        types = None
        for batch in batches:
            if len(cache) > WORD_TYPES:
                cache, emissions = {}, []
            found = label_texts(batch.column("message").to_pylist(), model, cache, emissions)
            rows = [_document(f) for f in found]
            types = types or _arrow_schema()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("given"),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.float64()),
                    pa.array([r[2] for r in rows], types[0]),
                    pa.array([r[3] for r in rows], types[1]),
                ],
                names=["doc_id", "given", "lang", "confidence", "langs", "segments"],
            )

    return run


def _arrow_schema() -> tuple[pa.DataType, pa.DataType]:
    segment = pa.struct([("segment_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_sentences", pa.int32()), ("n_words", pa.int32()), ("text", pa.string())])
    return pa.list_(pa.string()), pa.list_(segment)


def _messages(documents: DataFrame) -> DataFrame:
    """``doc_id, given, message``: a commit's text up to its diff, cut in the JVM; other texts whole."""
    text = F.col("text")
    message = F.when(text.rlike(_COMMIT + r"\b"), F.substring_index(text, "\ndiff --", 1)).otherwise(text)
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").alias("given"), message.alias("message"))


def fit_languages(documents: DataFrame, codes: list[str], train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Fits the model on at most ``train_docs`` documents of ``train_bytes`` bytes in all whose label is one of ``codes``.

    The sample is the documents with the smallest key hashes, so it has the
    shares of the whole; the driver sees their sizes first and then only what
    fits. Rows with NULL texts or unknown labels don't count; repeated rows count once.
    """
    labelled = _messages(documents).where(F.col("given").isin(codes) & F.col("message").isNotNull())
    total = documents.where(F.col("lang").isin(codes) & F.col("text").isNotNull()).count()
    hash_ = F.xxhash64("doc_id")
    if total > 4 * train_docs:
        # Twice the sample by hash range, so that no task sends a whole sample to the driver.
        labelled = labelled.where(hash_ < F.lit(int(-(2**63) + 2**64 * min(1.0, 2 * train_docs / total))))
    sample = settle(labelled.distinct().withColumns({"_h": hash_, "_m": F.xxhash64("message", "given"), "_n": F.octet_length("message")}))
    order = ["_h", "doc_id", "_m"]
    room, chosen = train_bytes, []
    for r in sample.select(*order, "_n").orderBy(*order).limit(train_docs).collect():
        if r["_n"] <= room:
            room -= r["_n"]
            chosen.append((r["doc_id"], r["_m"]))
    picked = F.broadcast(documents.sparkSession.createDataFrame(chosen, "doc_id bigint, _m bigint"))  # train_docs rows at most
    rows = sample.join(picked, ["doc_id", "_m"], "left_semi").orderBy(*order).collect()
    discard(sample)
    return fit(codes, [(r["message"], r["given"]) for r in rows])


def save_model(spark: SparkSession, model: Model, folder: str) -> None:
    """Writes a fitted model as a table, to be labelled with later or elsewhere."""
    parts = {"weights": model.weights, "steps": model.steps, "start": model.start[None, :]}
    rows = [(part, int(i), model.labels, [float(x) for x in table[i]]) for part, table in parts.items() for i in np.flatnonzero(table.any(axis=1) | (part != "weights"))]
    spark.createDataFrame(rows, "part string, place int, labels array<string>, row array<double>").coalesce(1).write.mode("overwrite").parquet(folder)


def load_model(spark: SparkSession, folder: str) -> Model:
    """A model that ``save_model`` wrote."""
    rows = spark.read.parquet(folder).collect()  # BUCKETS rows and a few more at most
    model = untrained(list(rows[0]["labels"]))
    model.weights[:] = 0
    for r in rows:
        {"weights": model.weights, "steps": model.steps, "start": model.start[None, :]}[r["part"]][r["place"]] = r["row"]
    return model


def document_languages(documents: DataFrame, codes: list[str], train_docs: int = TRAIN_DOCS, model: Model | None = None) -> DataFrame:
    """For each document its main language, all languages of its sentences, and its segments, with confidences.

    ``documents`` has ``doc_id``, ``text`` and ``lang`` (returned as ``given``);
    ``codes`` are the languages to tell apart. ``model`` is a fitted one;
    without it one is fitted. A document without any sentence
    (NULL or empty text too) has NULL ``lang`` and no segments. Neighbouring
    sentences of one language are one segment; confidences are means of word
    probabilities. Every document is labelled whole; each row is labelled by
    itself, so there is no shuffle and repeated rows give repeated results.
    An input without labels is labelled by the lexicons alone.
    """
    model = fit_languages(documents, codes, train_docs) if model is None else model
    light = Model(model.labels, model.weights.astype(np.float32), model.steps, model.start)
    shared = documents.sparkSession.sparkContext.broadcast(light)  # BUCKETS * len(codes) weights
    return _messages(documents).mapInArrow(_labeller(shared), SCHEMA)


def mislabelled(labelled: DataFrame) -> DataFrame:
    """``doc_id, lang``, one row per language, of documents whose label is missing or not among their languages, or that have several."""
    wrong = F.col("given").isNull() | F.col("given").isin("", "und") | ~F.array_contains("langs", F.col("given")) | (F.size("langs") > 1)
    return labelled.where(wrong).select("doc_id", F.explode("langs").alias("lang")).distinct()
