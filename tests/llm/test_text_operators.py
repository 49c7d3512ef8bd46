import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boughline.llm.frequent import Sketch, heavy_candidates, top_values
from boughline.llm.language import document_languages, fit, label_texts, mislabelled, sentences
from boughline.llm.mixing import Target, curriculum, mix, shares, sized_documents
from boughline.llm.packing import pack, pack_documents, plan_containers
from boughline.llm.tokens import token_counts
from boughline.llm.visual import look_alikes, rules, visual_form, visual_forms
from boughline.schema import ENTRY, build

# Frequent values


def values(rng, n):
    out = []
    for _ in range(n):
        r = rng.random()
        out.append(None if r < 0.03 else b"hot" if r < 0.35 else b"w%d" % int(rng.paretovariate(0.7)) if r < 0.8 else b"u%d" % rng.randrange(10**6))
    return out


def test_sketch_never_underestimates():
    rng = random.Random(1)
    drawn = [v for v in values(rng, 20_000) if v]
    sketch, true = Sketch(width=1 << 10, depth=3, heap=50), Counter(drawn)
    for k in range(0, len(drawn), 1000):
        part = drawn[k : k + 1000]
        hashes = np.array([hash(v) & (2**64 - 1) for v in part], np.uint64)
        sketch.update(pa.array(part), hashes, np.ones(len(part), np.int64))
    kept = dict(zip(sketch.values.to_pylist(), sketch.estimates.tolist(), strict=True))
    assert all(e >= true[v] for v, e in kept.items())
    assert all(n <= sketch.floor for v, n in true.items() if v not in kept)
    assert b"hot" in kept and len(kept) == 50


@pytest.mark.parametrize("k", [1, 20])
def test_top_values_are_exact(spark, k):
    drawn = values(random.Random(2), 30_000)
    df = spark.createDataFrame([(v, "x") for v in drawn], "v binary, n string").repartition(5)
    want = sorted(Counter(v for v in drawn if v is not None).items(), key=lambda x: (-x[1], x[0]))[:k]
    assert [(bytes(r["value"]), r["n_rows"]) for r in top_values(df, "v", k, width=1 << 12, heap=200).collect()] == want


def test_top_values_of_few_and_none(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("",)], "v string")
    assert [(r["value"], r["n_rows"]) for r in top_values(df, "v", 5).collect()] == [("", 1), ("a", 1), ("b", 1)]
    assert top_values(df.limit(0), "v", 5).count() == 0 and heavy_candidates(df.where("v IS NULL"), "v").count() == 0


# Visual forms

ALIKE = [
    ("café", "café"), ("한글", unicodedata.normalize("NFD", "한글")), ("Ａｂ１", "Ab1"), ("a​b", "ab"), ("a­b﻿", "ab"), ("a b c", "a b c"), ("a‑b", "a-b"),
    ("ﬁle", "file"), ("сосо", "coco"), ("ΑΒΕ", "ABE"), ("ё", "ë"), ("ｶﾞ", "ガ"), ("Å", "Å"), ("ậ", "ậ"), ("ậ", "ậ"), ("µ", "μ"), ("ӏ", "l"), ("…", "..."), ("Ⅳ", "IV"),
]
APART = [("a", "A"), ("e", "é"), ("l", "1"), ("l", "I"), ("a b", "a_b"), ("a-b", "a_b"), ("a b", "ab"), ("ı", "i"), ("ł", "l"), ("o", "0"), ("я", "r")]


def forms(texts):
    return visual_forms(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_same_looking(a, b):
    assert forms([a]) == forms([b])


@pytest.mark.parametrize(("a", "b"), APART)
def test_different_looking(a, b):
    assert forms([a]) != forms([b])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(max_size=12), max_size=8))
def test_forms_agree_with_the_rules_and_are_stable(texts):
    one, many, gone = rules()

    def plain(t):
        return None if t is None else unicodedata.normalize("NFC", "".join(many.get(c, one.get(c, c)) for c in t if c not in gone))

    texts = [None if t is None else t.replace("\x00", "") for t in texts]
    got = forms(texts)
    # Characters that this Python's tables don't know may be composed by newer ones.
    known = [i for i, t in enumerate(texts) if t is None or all(unicodedata.category(c) != "Cn" for c in t)]
    assert [got[i] for i in known] == [plain(texts[i]) for i in known]
    assert [forms([got[i]])[0] for i in known] == [plain(got[i]) for i in known]


def test_forms_of_all_mapped_characters():
    one, many, _ = rules()
    chars = sorted({*one, *many})
    assert forms(["".join(chars)]) == [unicodedata.normalize("NFC", "".join(many.get(c, one.get(c, c)) for c in chars))]


def test_visual_form_column(spark):
    df = spark.createDataFrame([(None,), ("",), ("plain",), ("сat",), ("x" * 50_000 + "é",)], "t string")
    got = [r["f"] for r in df.select(visual_form(F.col("t")).alias("f")).collect()]
    assert got == [None, "", "plain", "cat", "x" * 50_000 + "é"]


def brute_pairs(rows):
    got = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a["manifest_id"] != b["manifest_id"] or a["seq"] == b["seq"]:
                continue
            hit = a["parent_path"] == b["parent_path"] and a["name"] != b["name"] and forms([a["name"]]) == forms([b["name"]])
            for x, y in ((a, b), (b, a)):
                t = x.get("link_target")
                hit = hit or (t is not None and t != y["path"] and forms([t]) == forms([y["path"]]))
            if hit:
                got.add((a["manifest_id"], *sorted((a["seq"], b["seq"]))))
    return got


def test_look_alike_pairs(spark):
    rng = random.Random(4)
    names = ["cat", "сat", "c​at", "ｃat", "Cat", "dog", "dоg", "cät", "cät"]
    rows, seq = [], 0
    for m in ("m1", "m2"):
        for d in ("", "d/", "ԁ/"):
            for n in rng.sample(names, 6):
                rows.append({"manifest_id": m, "seq": seq, "path": d + n, "parent_path": d, "name": n})
                seq += 1
        rows.append({"manifest_id": m, "seq": seq, "path": "ln", "parent_path": "", "name": "ln", "file_type": "l", "link_target": "d/cat"})
        rows.append({"manifest_id": m, "seq": seq + 1, "path": "lo", "parent_path": "", "name": "lo", "file_type": "l", "link_target": "lо"})
        seq += 2
    df = build(spark, rows)
    got = [tuple(r) for r in look_alikes(df.unionByName(df).withColumn("h", F.lit(1))).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)
    assert look_alikes(spark.createDataFrame([], ENTRY)).count() == 0


# Packing


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_places_every_item_without_overlap(capacity, counts):
    counts = {k: n for k, n in counts.items() if k <= capacity}
    plan, used = plan_containers(capacity, counts)
    bins, seen = defaultdict(list), Counter()
    for length, a, b, each, first, offset in plan:
        for rank in range(a, b):
            seen[length] += 1
            bins[first + (rank - a) // each].append((offset + (rank - a) % each * length, length))
    assert seen == Counter(counts) and set(bins) == set(range(used))
    for items in bins.values():
        at = 0
        for start, length in sorted(items):
            assert start == at
            at += length
        assert at <= capacity
    # No worse than first-fit decreasing's bound.
    total = sum(k * n for k, n in counts.items())
    assert used <= 11 / 9 * max(-(-total // capacity), sum(n for k, n in counts.items() if k > capacity / 2)) + 6 / 9 + 1 or used <= 2 * -(-total // capacity)


@pytest.mark.parametrize("range_rows", [10**6, 7])
def test_pack(spark, monkeypatch, range_rows):
    monkeypatch.setattr("boughline.operators.common.RANGE_ROWS", range_rows)
    rng = random.Random(5)
    sizes = {i: rng.choice([0, 1, 7, 7, 7, rng.randrange(1, 60), 100, 250]) for i in range(400)}
    df = spark.createDataFrame([(i, s, "x") for i, s in sizes.items()] + [(9999, None, "x")], "item bigint, size bigint, kind string")
    rows = pack(df, {"a": 50, "b": 128}).collect()
    for kind, capacity in (("a", 50), ("b", 128)):
        own = [r for r in rows if r["bin_kind"] == kind]
        per_item, per_bin = defaultdict(int), defaultdict(list)
        for r in own:
            per_item[r["item"]] += r["size"]
            per_bin[r["container"]].append((r["start"], r["size"]))
        assert per_item == {i: s for i, s in sizes.items() if s}
        assert all(sizes[i] > capacity for i, n in Counter(r["item"] for r in own).items() if n > 1)
        for items in per_bin.values():
            assert sum(s for _, s in items) <= capacity
            assert all(a + s <= b for (a, s), (b, _) in zip(sorted(items), sorted(items)[1:], strict=False))
        assert len(per_bin) <= 1.05 * sum(sizes.values()) / capacity + 2 and sorted(per_bin) == list(range(len(per_bin)))


def test_pack_documents_edges(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", "x"), (None, "q", "x"), (4, "word " * 3000, "x")], "doc_id bigint, text string, size string")
    rows = pack_documents(df, {"k": 64}).collect()
    assert {r["doc_id"] for r in rows} == {1, 4} and max(r["size"] for r in rows) == 64
    assert pack_documents(df.limit(0), {"k": 64}).count() == 0
    with pytest.raises(ValueError):
        pack(df.select(F.col("doc_id").alias("item"), F.lit(1).alias("size")), {"k": 0})


def test_token_counts_of_special_texts(spark):
    df = spark.createDataFrame([(1, "<|endoftext|>"), (2, None), (3, ""), (4, "hello world"), (5, "漢" * 1000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, ["doc_id"]).collect()}
    assert got[2] == got[3] == 0 and got[4] == 2 and got[1] > 1 and got[5] > 100


# Mixing


def test_curriculum_integrates_to_the_targets():
    targets = curriculum({"a": (0.5, 1), "b": (0.3, 4), "c": (0.2, 2)})
    for at in (0, 1):
        assert abs(sum(t.schedule[at][1] for t in targets) - 1) < 1e-9
    for t in targets:
        assert abs((t.schedule[0][1] + t.schedule[1][1]) / 2 - t.weight) < 1e-9


def test_mix_shares_positions_and_repeats(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a"] * 8 + ["b", None]), rng.randrange(1, 50), "x") for i in range(4000)]
    sized = spark.createDataFrame(rows + [(9000, "a", 0, "x")], "doc_id bigint, source string, size bigint, demand string")
    targets = [Target("a", 0.7, 1, ((0.0, 0.9), (0.5, 0.7), (1.0, 0.5))), Target("b", 0.3, 3, ((0.0, 0.1), (0.5, 0.3), (1.0, 0.5))), Target("none", 0.1, 2, ((0.0, 0.1), (1.0, 0.1)))]
    uses = mix(sized, targets).collect()
    assert [r["position"] for r in uses] == sorted(r["position"] for r in uses) and 0 <= uses[0]["position"] and uses[-1]["position"] <= 1
    used = Counter((r["source"], r["doc_id"]) for r in uses)
    assert max(used.values()) <= 3 and max(n for (s, _), n in used.items() if s == "a") == 1
    total = sum(r["size"] for r in uses)
    share = lambda rows: sum(r["size"] for r in rows if r["source"] == "b") / sum(r["size"] for r in rows)
    assert abs(share(uses) - 0.3) < 0.01
    # The mix moves along the schedule.
    early, late = [r for r in uses if r["position"] < 0.25], [r for r in uses if r["position"] > 0.75]
    assert abs(share(early) - 0.15) < 0.05 and abs(share(late) - 0.45) < 0.06
    report = {r["source"]: r for r in shares(mix(sized, targets), sized, targets).collect()}
    assert report["none"]["tokens"] == 0 and abs(report["a"]["actual_share"] - 0.7) < 0.01 and report["b"]["most_uses"] == 3 and total == report["a"]["tokens"] + report["b"]["tokens"]
    assert sum(r["size"] for r in mix(sized, targets, total=1000).collect()) == pytest.approx(1000, abs=60)
    assert mix(sized.limit(0), targets).count() == 0 and mix(sized, []).count() == 0
    again = [tuple(r) for r in mix(sized.repartition(7), targets).collect()]
    assert again == [tuple(r) for r in uses]


def test_sized_documents_count_repeats_once(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, None, None), (None, "x", "s")], "doc_id bigint, text string, source string")
    assert {(r["doc_id"], r["source"], r["size"] > 0) for r in sized_documents(df).collect()} == {(1, "s", True), (2, None, False)}


# Languages

TEXTS = {
    "en": ["The old cache was removed before the next release.", "Please look at the table first and tell me what you saw.", "We talked about this path last week and agreed.", "This change makes the reader faster on large inputs."],
    "de": ["Der alte Speicher wurde vor der nächsten Ausgabe entfernt.", "Bitte zuerst die Tabelle ansehen und mir Bescheid geben.", "Wir haben letzte Woche über den Pfad gesprochen.", "Diese Änderung macht das Lesen großer Daten schneller."],
    "fr": ["L'ancien cache a été supprimé avant la prochaine version.", "Regardez d'abord la table et dites-moi ce que vous voyez.", "Nous avons parlé de ce chemin la semaine dernière.", "Ce changement accélère la lecture des grandes données."],
    "ja": ["古いキャッシュは次の版の前に削除しました。", "まず表を見てから知らせてください。", "先週この道について話しました。", "この変更で読み込みが速くなります。"],
    "zh": ["旧的缓存在下一版之前删除。", "请先查看表格然后告诉我。", "我们上周讨论了这个路径。", "这次改动让读取更快。"],
    "ru": ["Старый кэш удалён перед следующим выпуском.", "Сначала посмотрите на таблицу и напишите мне.", "На прошлой неделе мы обсудили этот путь.", "Эта правка ускоряет чтение больших данных."],
}
CODES = ["ca", "de", "en", "fr", "ja", "ru", "uk", "zh"]


def labelled(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(TEXTS))
        body = " ".join(rng.sample(TEXTS[lang], 2))
        wrong = "uk" if lang == "ru" and rng.random() < 0.2 else "ca" if lang == "en" and rng.random() < 0.05 else None
        out.append((i, lang, wrong or lang, body))
    return out


def test_sentences_leave_out_what_is_no_language():
    text = (
        "commit 12ab\nAuthor: X <x@y>\n\n    fix(core): Rework the table\n\n    It uses `the_cache` and \"le chat noir\" in src/a_b.c now. Second one.\n\n    > Quoted reply here.\n\n"
        "    Signed-off-by: X <x@y>\n    Conflicts:\n            src/x.c\n"
    )
    got = [[ws for _, ws in p] for p in sentences(text.replace("    > ", "    > "))]
    assert got == [[["rework", "the", "table"]], [["it", "uses", "and", "in", "now"], ["second", "one"]], [["quoted", "reply", "here"]]]
    assert sentences("") == [] and sentences("\n\n12 34\n") == [] and len(sentences("word " * 20_000)[0][0][1]) == 20_000


def test_held_out_accuracy_despite_wrong_labels():
    data = labelled()
    model = fit(CODES, [(body, given) for _, _, given, body in data[:300]])
    held = [(body, lang) for _, lang, _, body in data[300:]]
    found = label_texts([b for b, _ in held], model, {}, [])
    right = sum(g == lang for (_, lang), f in zip(held, found, strict=True) for _, _, g, _ in f)
    assert right / sum(map(len, found)) > 0.98
    mixed = label_texts([f"{TEXTS['de'][0]} {TEXTS['en'][1]}", TEXTS["zh"][2] + TEXTS["ja"][1], None, ""], model, {}, [])
    assert [[g for _, _, g, _ in f] for f in mixed] == [["de", "en"], ["zh", "ja"], [], []]


def test_documents_and_segments(spark):
    data = labelled(200)
    rows = [(i, body, given, "x") for i, _, given, body in data]
    rows += [(1000, f"{TEXTS['de'][0]} {TEXTS['en'][1]}\n\n> {TEXTS['fr'][2]}", None, "x"), (1001, None, "en", "x"), (1002, "", "und", "x"), (1003, TEXTS["fr"][0], "de", "x"), (1003, TEXTS["fr"][0], "de", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, langs string")
    got = document_languages(df, CODES)
    by = {r["doc_id"]: r for r in got.collect()}
    assert sum(by[i]["lang"] == lang for i, lang, _, _ in data) / len(data) > 0.97
    assert by[1001]["lang"] is None and by[1002]["segments"] == [] and by[1000]["langs"] == ["de", "en", "fr"]
    assert [(s["segment_no"], s["lang"]) for s in by[1000]["segments"]] == [(1, "de"), (2, "en"), (3, "fr")] and all(0.5 < s["confidence"] <= 1 for s in by[1000]["segments"])
    found = Counter((r["doc_id"], r["lang"]) for r in mislabelled(got).collect())
    assert found[1003, "fr"] == 1 and {k for k in found if k[0] == 1000} == {(1000, "de"), (1000, "en"), (1000, "fr")}
    assert document_languages(df.limit(0), CODES).count() == 0
