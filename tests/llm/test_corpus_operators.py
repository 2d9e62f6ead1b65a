"""Operators that compare rows with each other, and the pipeline, against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import components, crowds, decontaminate, near_duplicates, paragraphs, registry, substrings, words
from tests.llm.test_text_operators import EDGES, docs

SF = "/root/testdata/sf0.001"


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute_components(texts, percent=75):
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {k: find(k) for k in texts}, sets


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (None, 3), (5, 4)]
    found = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 120)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    expected, sets = brute_components(texts)
    rows = registry.op10_minhash_forest(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {
        k: (len(sets[k]), expected[k], expected[k] == k) for k in texts
    }


def test_crowded_regions_descend(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "CROWD", 3)
    r = random.Random(8)
    base = [f"w{r.randint(0, 500)}" for _ in range(120)]
    texts = {}
    for i in range(60):
        copy = list(base)
        for _ in range(r.randint(0, 4)):
            copy[r.randrange(120)] = f"x{r.randint(0, 10**6)}"
        texts[i] = " ".join(copy)
    for i in range(60, 80):
        texts[i] = " ".join(f"w{r.randint(0, 500)}" for _ in range(100))
    rows = near_duplicates.near_duplicates(docs(spark, texts.items())).collect()
    assert {x.doc_id: x.component_id for x in rows} == brute_components(texts)[0]


def crowd_of(r, size, common, own, pairs, changed):
    """Texts of pieces that many share and own ones, a few with a partner that differs in ``changed`` pieces more."""
    piece = lambda: " ".join(f"v{r.randint(0, 10**9)}" for _ in range(5))
    base = [piece() for _ in range(common)]
    texts = {}
    for i in range(size):
        texts[i] = base + [piece() for _ in range(own)]
    for i in range(pairs):
        texts[size + i] = texts[3 * i][: common + own - changed] + [piece() for _ in range(changed)]
    return {k: " ".join(v) for k, v in texts.items()}


def test_crowd_below_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "CROWD", 2)
    monkeypatch.setattr(near_duplicates, "DEPTHS", (3,))
    texts = crowd_of(random.Random(12), 300, 40, 9, 60, 6)
    expected, sets = brute_components(texts)
    pairs = [len(sets[3 * i] & sets[300 + i]) / len(sets[3 * i] | sets[300 + i]) for i in range(60)]
    assert 0.75 <= min(pairs) and max(pairs) < 0.8 and len(set(expected.values())) == 300
    rows = near_duplicates.near_duplicates(docs(spark, texts.items())).collect()
    assert {x.doc_id: x.component_id for x in rows} == expected


def test_close_pairs_equal_brute_force(spark):
    r = random.Random(3)
    sets = {i: set(r.sample(range(30), r.randint(1, 25))) for i in range(150)}
    rows = [(i, i % 7, np.array(sorted(s), np.uint64).tobytes()) for i, s in sets.items()]
    found = {tuple(x) for x in crowds.close_pairs(spark.createDataFrame(rows, "id long, part long, hashes binary"), 60).collect()}
    expected = {
        (a, b) for a, b in itertools.combinations(range(150), 2)
        if a % 7 != b % 7 and 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])
    }
    assert expected and expected <= found and all(a < b and a % 7 != b % 7 for a, b in found)


def test_near_duplicates_edges(spark):
    rows = near_duplicates.near_duplicates(docs(spark, EDGES + [(8, "A"), (10, None)])).collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == len(EDGES) + 2 and found[8].component_id == 4 and found[10].component_id == 10
    assert found[1].n_shingles == 0 and found[1].kept and found[None].kept and found[None].component_id is None
    assert found[5].n_shingles == 1
    kept = near_duplicates.first_of_each(docs(spark, EDGES + [(8, "A")]))
    assert kept.columns == ["doc_id", "text", "tokens", "rank"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert near_duplicates.near_duplicates(docs(spark, [])).count() == 0


def test_forest_recall():
    assert words.copies_needed(0.75, 1, 0.25) == 1
    for depth in near_duplicates.DEPTHS:
        trees = words.copies_needed(0.75, depth, near_duplicates.MISS)
        assert (1 - 0.75**depth) ** trees <= near_duplicates.MISS < (1 - 0.75**depth) ** (trees - 1)


def brute_paragraphs(texts):
    """Clusters by all pairs of paragraphs, then runs, in plain Python."""
    cut = {}
    for key, text in texts.items():
        found, bounds = paragraphs.paragraph_bounds(text or "")
        spans = [(int(a), int(b)) for a, b in zip(bounds, bounds[1:]) if b - a >= paragraphs.LEAST_WORDS]
        cut[key] = [(a, b, shingles(b" ".join(found[a:b]).decode())) for a, b in spans]
    items = [(key, i) for key in sorted(cut) for i in range(len(cut[key]))]
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(items, 2):
        a, b = cut[x[0]][x[1]][2], cut[y[0]][y[1]][2]
        if 100 * len(a & b) >= 75 * len(a | b):
            p, q = sorted((find(x), find(y)))
            root[q] = p
    out = {}
    for key, spans in cut.items():
        again = [i for i in range(len(spans)) if find((key, i)) != (key, i)]
        runs = []
        for i in again:
            if runs and runs[-1][0] + 1 == i:
                runs[-1] = (i, runs[-1][1], spans[i][1])
            else:
                runs.append((i, *spans[i][:2]))
        out[key] = (len(spans), len(again), [(a, b) for _, a, b in runs if b - a >= paragraphs.LEAST_RUN])
    return out


def test_paragraphs_equal_brute_force(spark):
    r = random.Random(5)
    sentence = lambda n: " ".join(f"w{r.randint(0, 3000)}" for _ in range(n)).capitalize() + "."
    shared = [sentence(12), sentence(4), sentence(14), sentence(11)]
    texts = {i: " ".join([sentence(9), sentence(10)]) + r.choice([" ", "\n"]) + sentence(15) for i in range(30)}
    for i in (3, 9, 17, 25):
        texts[i] = f"{sentence(9)} {' '.join(shared)} {sentence(3)} {sentence(9)}"
    texts[26] = shared[2].replace("w", "W", 1) + " " + sentence(9)
    texts |= {40: None, 41: "", 42: texts[4], 43: " ".join(texts[5].split()[:-1] + ["changed."])}
    rows = paragraphs.repeated_paragraphs(docs(spark, [*texts.items(), (None, texts[4])])).collect()
    found = {x.doc_id: (x.n_paragraphs, x.n_repeated, [(s.start, s.end) for s in x.removed]) for x in rows}
    assert found == brute_paragraphs(texts)
    assert found[9][2] and found[42][2] and not found[0][2] and found[26][1] == 1 and not found[26][2]
    assert paragraphs.repeated_paragraphs(docs(spark, [])).count() == 0


def test_templated_paragraphs_in_crowded_bands(spark):
    r = random.Random(21)
    word = lambda: f"w{r.randint(0, 10**9)}"
    template = [word() for _ in range(22)]
    lines = [[word() for _ in range(6)] + template + [word() for _ in range(6)] for _ in range(400)]
    lines += [lines[i][:-4] + [word() for _ in range(4)] for i in range(0, 160, 2)]
    r.shuffle(lines)
    texts = {i: " ".join(line) for i, line in enumerate(lines)}
    expected = brute_paragraphs(texts)
    assert sum(x[1] for x in expected.values()) == 80
    rows = paragraphs.repeated_paragraphs(docs(spark, texts.items())).collect()
    found = {x.doc_id: x.n_repeated for x in rows}
    assert sum(found[k] != expected[k][1] for k in texts) <= 1  # pairs that share no band


def test_repeated_short_lines(spark):
    r = random.Random(9)
    line = lambda n: " ".join(f"w{r.randint(0, 10**9)}" for _ in range(n))
    passage = "\n".join(line(n) for n in (4, 7, 5, 6, 4, 7, 5, 6, 4, 7, 5))
    texts = {1: f"{passage}\n{line(12)}", 2: f"{line(12)}\n{passage}", 3: f"{line(3)}\n{line(5)}\n{passage}\n{line(6)}\n{line(2)}", 4: line(4)}
    rows = {x.doc_id: x for x in paragraphs.repeated_paragraphs(docs(spark, texts.items())).collect()}
    assert len(passage.split()) == 60 and not rows[1].removed and not rows[1].n_repeated
    assert [tuple(s) for s in rows[2].removed] == [(12, 72)] and [tuple(s) for s in rows[3].removed] == [(8, 68)]
    assert rows[4].n_paragraphs == 0
    # one long line ends two rows: only the shorter one counts
    starts, ends = paragraphs.paragraph_spans(np.array([0, 1, 7, 14, 30, 33]))
    assert (starts.tolist(), ends.tolist()) == ([1, 14], [14, 30])


def test_edit_distance_inside():
    r = random.Random(2)
    for _ in range(200):
        a = "".join(r.choice("abc") for _ in range(r.randint(1, 20)))
        b = "".join(r.choice("abc") for _ in range(r.randint(0, 30)))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            fresh = [i]
            for j, y in enumerate(b, 1):
                fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != y)))
            row = fresh
        assert decontaminate.edit_distance_inside(a, b) == min(row)


def test_decontamination_recall_and_edges(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(r.randint(12, 40)))) for i in range(40)] + [(50, None), (51, ""), (52, "too few words")]
    texts = []
    for i in range(120):
        body, item = [word() for _ in range(80)], items[i % 40][1]
        if i < 80:
            letters = list(item.upper() if i % 3 else item)
            for _ in range(int(len(letters) * (0, 0.03, 0.08)[i % 3])):
                letters[r.randrange(len(letters))] = r.choice("xyz")
            body[40:40] = ["".join(letters).replace(" ", "\n ")]
        texts.append((i, " ".join(body)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(docs(spark, texts + [(None, None), (200, "too few words")]), benchmark).collect()
    hits = {(x.doc_id, x.item_id) for x in found}
    assert hits <= {(i, i % 40) for i in range(80)} and len(hits) >= 78
    assert all(x.distance == 0 for x in found if x.doc_id % 3 == 0)
    kept = decontaminate.without_benchmark(docs(spark, texts + [(None, None)]), benchmark)
    assert {x.doc_id for x in kept.collect()} == {i for i in range(120)} - {d for d, _ in hits} | {None}
    assert decontaminate.contaminated(docs(spark, texts), benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(docs(spark, []), benchmark).count() == 0


def test_items_of_few_words():
    r = random.Random(17)
    letters = lambda n: "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(n))
    items = [(0, letters(200)), (1, letters(25)), (2, letters(24)), (3, letters(61) + " " + letters(60)), (4, "x" * 40), (5, None), (6, " ")]
    index = decontaminate.Items(items)
    for key in (0, 1, 3):
        text = list(items[key][1])
        for edits in (0, int(0.15 * len(text)) // 2, int(0.15 * len(text))):
            copy = list(text)
            for i in range(edits):  # evenly spread
                copy[i * len(copy) // edits] = letters(1)
            [hits] = index.find([f"{letters(70)} {''.join(copy)}{letters(9)}"])
            assert [h[0] for h in hits] == [key] and hits[0][1] <= edits and hits[0][2] == len(text)
    assert index.find([items[2][1], letters(300), "", None, "ab " * 9]) == [[]] * 5
    assert index.find(["x" * 34, "x" * 33]) == [[(4, 6, 40)], []]


@pytest.mark.parametrize("kind", ["spread", "random", "inserted", "blanks", "deleted"])
def test_no_edited_copy_is_missed(kind):
    r = random.Random(kind)
    word = lambda: "".join(r.choice("aeinorst") for _ in range(r.randint(1, 8)))
    items = [(i, " ".join(word() for _ in range(r.randint(5, 90)))) for i in range(60)]
    index = decontaminate.Items(items)
    texts = []
    for key, item in items:
        edits, letters = int(0.15 * len(item)), list(item)
        at = {r.randrange(len(item)) if kind == "random" else i * len(item) // edits for i in range(edits)}
        for place in sorted(at, reverse=True):
            if kind == "deleted":
                del letters[place]
            elif kind in ("inserted", "blanks"):
                letters.insert(place, " " if kind == "blanks" else "x")
            else:
                letters[place] = "x"
        texts.append(" ".join([word() for _ in range(40)] + ["".join(letters)] + [word() for _ in range(40)]))
    found = index.find(texts)
    plain = [" ".join(text.split()) for text in texts]
    for hits, text in zip(found, plain):
        near = {key: decontaminate.edit_distance_inside(item, text) for key, item in items if len(item) >= 20}
        expected = {key for key, distance in near.items() if distance <= int(0.15 * len(items[key][1]))}
        assert {h[0] for h in hits if len(items[h[0]][1]) >= 20} == expected
        assert all(h[1] >= near[h[0]] for h in hits if h[0] in near)


def test_repetitive_texts_in_parts(monkeypatch):
    monkeypatch.setattr(decontaminate, "TOGETHER", 100)
    index = decontaminate.Items([(0, "ab " * 30), (1, "the same words in another order of things")])
    text = "ab " * 3000 + "THE same words in another\norder of thinks"
    assert index.find([text, "", None, "ab"]) == [[(0, 0, 89), (1, 1, 41)], [], [], []]


def test_benchmark_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 2000)
    rows = registry.op6_cgk_decontamination(spark, SF).collect()
    monkeypatch.undo()
    assert len(rows) and sorted(rows) == sorted(registry.op6_cgk_decontamination(spark, SF).collect())


def brute_substrings(texts):
    seen, out = set(), {}
    for key in sorted(texts):
        data = (texts[key] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - substrings.LENGTH + 1):
            window = data[i : i + substrings.LENGTH]
            if window in seen:
                gone[i : i + substrings.LENGTH] = b"\1" * substrings.LENGTH
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[key] = (len(data), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


def repeated_texts():
    r = random.Random(9)
    line = lambda n: "".join(r.choice("abcde é\n") for _ in range(n))
    passage = line(160)
    texts = {i: line(r.randint(0, 200)) + r.choice(["", passage, passage[20:130], passage[:99]]) + line(r.randint(0, 150)) for i in range(60)}
    texts |= {70: "a" * 400, 71: "ab" * 130, 72: None, 73: "", 74: texts[3], 75: passage * 3, 76: "a" * 100, 77: "\0" * 250}
    return texts


@pytest.mark.parametrize("together", [50_000, 4])
def test_substrings_equal_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(substrings, "TOGETHER", together)
    texts = repeated_texts()
    rows = substrings.kept_bytes(substrings.repeated_bytes(docs(spark, [*texts.items(), (None, "a" * 300)]))).collect()
    found = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows}
    assert found.pop(None)[:3] == (300, 0, 0)
    assert found == brute_substrings(texts)


def test_segments_over_stretches(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    whole = substrings.segments(data)
    monkeypatch.setattr(substrings, "STRETCH", 700)
    parts = substrings.segments(data)
    places = lambda s: {(w, int(a)) for a, f, t in zip(s[1], s[2], s[3]) for w in range(f, t + 1)}
    assert places(whole) == places(parts) and len(places(whole)) == 5000 - substrings.LENGTH + 1


def test_column_sort_gives_order_and_common_prefixes():
    r = np.random.default_rng(3)
    columns = r.integers(0, 3, (60, 12)).astype(np.uint8)
    for column, order, common in substrings.column_sort(columns, np.zeros(60, int), np.full(60, 12)):
        rows = [tuple(columns[i, column:]) for i in order]
        assert rows == sorted(rows)
        for k in range(1, 60):
            assert common[k] == next((i for i, (a, b) in enumerate(zip(rows[k - 1], rows[k])) if a != b), len(rows[k]))


def test_pipeline_stages(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in frame.collect()}
    good = {r.doc_id for r in registry.op1_rule_ensemble(spark, SF).filter("predicted = 1").collect()}
    groups, _ = brute_components({k: texts[k] for k in good})
    firsts = {k for k, v in groups.items() if k == v}
    leaks = {r.doc_id for r in registry.op6_cgk_decontamination(spark, SF).collect()}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(rows) == firsts - leaks and 0 < len(rows) < len(texts)
    from plumbline.llm.secrets import redact

    for r in redact(frame).filter("doc_id % 20 = 0").collect():
        if r.doc_id in rows:
            assert rows[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    stage = corpus_pipeline.STAGES[3][1](spark, frame, SF)
    assert stage.schema.names == frame.schema.names and stage.count() == frame.count()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
