"""Jaccard classes and repeated passages against brute force on invented texts."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from tidemark.llm import jaccard_join, shared, substring_dedup
from tidemark.llm.shared import WordHashes, block_shingles


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    line = [rng.choice(words) for _ in range(60)]
    out = [None, "", " \n", "one two", "One TWO", "one two three"]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 and len(out) > 10:
            base = (out[rng.randrange(6, len(out))] or "").split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
            out.append("  ".join(base))
        elif kind < 0.7:
            out.append(" ".join([*[rng.choice(words) for _ in range(rng.randint(0, 40))], *line, *[rng.choice(words) for _ in range(rng.randint(0, 40))]]))
        else:
            out.append("\n".join(rng.choice(words) for _ in range(rng.randint(5, 150))))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, component_id int").repartition(5)


def sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def classes(texts, percent=75):
    s, parent = sets(texts), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {i: (len(s[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_like_brute_force(spark, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(frame(spark, texts)).collect()}
    assert got == classes(texts)


def test_chains_and_borderline_pairs_in_small_tiles(spark, monkeypatch):
    # Windows sliding over one text: neighbours link, distant ones do not, and pairs just below the threshold share all candidates.
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    words = [f"v{i}" for i in range(130)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, 64, 4)] + [" ".join(words[70 - i : 130 - i : 1]) for i in (0, 9)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(frame(spark, texts)).collect()}
    assert got == classes(texts)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    text = "a b c d e f g h"
    rows = [(3, text), (None, text), (3, text), (7, text.upper()), (None, None), (None, "x y")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 0, -1), (-1, 1, -1), (-1, 4, 3), (3, 4, 3), (3, 4, 3), (7, 4, 3)]
    assert jaccard_join.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for n, m, common in ((200, 220, 150), (900, 300, 280), (40, 40, 0)):
        a, b = np.sort(pool[:n]), np.sort(pool[n - common : n - common + m])
        x, y = (np.frombuffer(jaccard_join.bitmap(s, 2), np.uint64) for s in (a, b))
        words = min(len(x), len(y))
        bound = jaccard_join.overlap_bounds(jaccard_join.folded(x, words)[None], np.array([n]), jaccard_join.folded(y, words)[None], np.array([m]))
        assert common <= bound[0, 0] <= min(n, m)


def test_block_shingles_keep_texts_apart():
    n, found = block_shingles([b"a b c d e f", b"", b"a b", b"b c d e f g"], WordHashes(), 5)
    assert n.tolist() == [2, 0, 1, 2]
    assert len(set(found[:2].tolist()) & set(found[3:].tolist())) == 1


def exact_cover(texts, least=50):
    words = [(t or "").encode().lower().split() for t in texts]
    owners = {}
    for i, w in enumerate(words):
        for k in range(len(w) - least + 1):
            owners.setdefault(tuple(w[k : k + least]), set()).add(i)
    return {i: c for i, w in enumerate(words) if (c := {p for k in range(len(w) - least + 1) if len(owners[tuple(w[k : k + least])]) > 1 for p in range(k, k + least)})}


def test_exact_passages_like_brute_force(spark):
    texts = corpus(3)
    rows = substring_dedup.repeated_passages(frame(spark, texts)).collect()
    got = {r.doc_id: {p for s in r.spans if s.exact for p in range(s.start, s.end)} for r in rows}
    want = exact_cover(texts)
    assert len(rows) == len(texts) and {i: c for i, c in got.items() if c} == want
    assert all(s.first_id <= r.doc_id for r in rows for s in r.spans)


def test_near_passages_and_clean_texts(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(80)]
    changed = [*passage[:40], "other", *passage[41:]]
    fresh = lambda k: [f"{k}-{rng.random()}" for _ in range(70)]
    texts = [" ".join(fresh(1) + passage), " ".join(changed + fresh(2)), " ".join(fresh(3))]
    got = {r.doc_id: r.spans for r in substring_dedup.repeated_passages(frame(spark, texts)).collect()}
    assert got[0] and got[1] and not got[2]
    assert not any(s.exact for s in got[0]) and got[0][0].start >= 70 and got[1][0].end <= 80


def test_cutting_keeps_the_first_and_the_columns(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"Start {passage}  end", f"Other\n{passage} tail  here", passage, None, "short"]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(docs, cut=True).collect()}
    assert set(docs.columns) < set(got[0].asDict())
    assert got[0].text == texts[0] and got[1].text == "Other\ntail  here" and got[2].text == "" and got[3].text == "" and got[4].text == "short"
    assert rng and substring_dedup.repeated_passages(docs.limit(0), cut=True).count() == 0


def test_compact_windows_hold_every_run():
    rng = np.random.default_rng(1)
    text = b" ".join(b"w%d" % k for k in rng.integers(0, 9, 120))
    s = substring_dedup.Sequences([text, b"a b", text[:200]], WordHashes(), 10)
    lo, centre, hi = s.windows(substring_dedup.SEEDS[0])
    value = substring_dedup.mix(s.seq ^ np.uint64(substring_dedup.SEEDS[0]))
    for start in range(len(s.seq) - 9):
        if s.owner[start] != s.owner[start + 9]:
            continue
        c = start + int(value[start : start + 10].argmin())
        k = int(np.flatnonzero(centre == c)[0])
        assert lo[k] <= start and start + 9 <= hi[k] and value[lo[k] : hi[k] + 1].min() == value[c]


def near_starts(x, y, t, percent=75):
    """By brute force, starts of the runs of x that are similar to a run of y; None stands outside the text."""
    cut = lambda v: {s: set(v[s : s + t]) for s in range(len(v) - t + 1) if None not in v[s : s + t]}
    a, b = cut(x), cut(y)
    return {s for s, p in a.items() if any(100 * len(p & q) >= percent * len(p | q) for q in b.values())}


@pytest.mark.parametrize("seed", range(3))
def test_similar_runs_like_brute_force(seed):
    rng, t = random.Random(seed), 12
    xs, ys = [], []
    for k in range(60):
        x = [rng.randrange(1, 10**6 if k % 3 else 40) for _ in range(2 * t - 1)]
        y = list(x)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(y))
            y[at:at] = [rng.randrange(1, 10**6)] * rng.randrange(3)
            del y[at + 1 : at + 1 + rng.randrange(3)]
        y = (y + [0] * len(x))[: len(x)]
        xs.append(x)
        ys.append(y)
    got = substring_dedup._similar(np.array(xs, np.uint64), np.array(ys, np.uint64), t, 75)
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        x, y = ([v or None for v in z] for z in (x, y))
        for found, p, q in ((got[0][k], x, y), (got[1][k], y, x)):
            want, found = near_starts(p, q, t), set(np.flatnonzero(found).tolist())
            reach = {i for s in want for i in range(s, s + t) if p[i] in q}
            assert found <= want and bool(found) == bool(want)
            assert len(reach) < t or max(reach) - min(reach) + 1 < t or reach <= {i for s in found for i in range(s, s + t)}


@pytest.mark.parametrize("edit", ["insert", "delete"])
def test_near_passages_with_one_word_more_or_less(spark, edit):
    rng = random.Random(8)
    texts, cores = [], []
    for k in range(30):
        passage = [f"{k}-{i}" for i in range(60)]
        changed = [*passage[:30], "other", *passage[30:]] if edit == "insert" else [*passage[:30], *passage[31:]]
        fresh = lambda: [f"f{rng.random()}" for _ in range(60)]
        texts += [" ".join(fresh() + passage + fresh()), " ".join(fresh() + changed + fresh())]
        cores += [60, len(changed)]
    got = {r.doc_id: {p for s in r.spans for p in range(s.start, s.end)} for r in substring_dedup.repeated_passages(frame(spark, texts)).collect()}
    covered = [got[i] == set(range(60, 60 + n)) for i, n in enumerate(cores)]
    assert sum(covered) >= 50  # by min-hashes


@pytest.mark.parametrize("most", [7, 100_000])
def test_every_pair_of_a_centre_is_tried(monkeypatch, most):
    pairs = substring_dedup._pairs
    monkeypatch.setattr(substring_dedup, "_pairs", lambda sizes: pairs(sizes, most))
    rng, t = random.Random(4), 20
    size = 2 * t + substring_dedup.WIDTH - 2
    keys, ids, contexts = [], [], []
    for key in range(2):
        base = [rng.randrange(1, 2**16) for _ in range(size)]
        for k in range(60):
            x = [rng.randrange(1, 2**16) if abs(i - size // 2) > 16 else w for i, w in enumerate(base)]
            if k % 10:
                x[rng.randrange(size // 2 - 16, size // 2 + 17)] = rng.randrange(1, 2**16)
            if k % 12 == 5:
                x = ([1, 1, 2] * size)[:8] + x[8:]
            contexts.append(x if k % 7 else [0] * 6 + x[6:])
            keys.append(key)
            ids.append(k // 2 + 100)
    docs = np.arange(len(ids))
    order = list(range(len(ids)))
    rng.shuffle(order)
    pick = lambda v, kind: np.array([v[i] for i in order], kind)
    keys, ids, contexts = pick(keys, np.uint64), pick(ids, np.int64), pick(contexts, np.uint16)
    got = substring_dedup._near(keys, ids, docs, contexts, t, 75)
    shingles = [[v or None for v in row] for row in substring_dedup._shingles(contexts).tolist()]
    never = np.iinfo(np.int64).max
    for i, x in enumerate(shingles):
        want = {}
        for j, y in enumerate(shingles):
            if i != j and keys[i] == keys[j]:
                for s in near_starts(x, y, t):
                    want[s] = min(want.get(s, ids[i]), ids[j])
        found = {s: v for s, v in enumerate(got[i].tolist()) if v < never}
        assert bool(found) == bool(want) and all(s in want and v >= want[s] for s, v in found.items())
        assert not found or min(found.values()) == min(want.values())


def test_a_stretch_that_repeats_itself_is_compared_by_sets():
    """Texts of two words in turn, with a few words of their own before or after: every window holds shingles twice."""
    rng, t = random.Random(9), 20
    size, contexts, docs = 2 * t + substring_dedup.WIDTH - 2, [], []
    for doc in range(12):
        own = [rng.randrange(1000, 2**16) if doc % 3 else 500 + k for k in range(10)]
        text = own[: doc % 11] + [7, 8] * 40 + own[: (doc * 5) % 11]
        for at in range(0, len(text) - size, 2):
            contexts.append(text[at : at + size])
            docs.append(doc)
    docs, contexts = np.array(docs), np.array(contexts, np.uint16)
    keys, never = np.zeros(len(docs), np.uint64), np.iinfo(np.int64).max
    got = substring_dedup._near(keys, docs + 100, docs, contexts, t, 75)
    shingles = [[v or None for v in row] for row in substring_dedup._shingles(contexts).tolist()]
    sets = [[frozenset(x[s : s + t]) if None not in x[s : s + t] else None for s in range(t)] for x in shingles]
    of: dict = {}
    for d, row in zip(docs.tolist(), sets, strict=True):
        for x in row:
            of.setdefault(x, set()).add(d)
    for i, row in enumerate(sets):
        want = {s for s, x in enumerate(row) if x and any(y and ds - {docs[i]} and 100 * len(x & y) >= 75 * len(x | y) for y, ds in of.items())}
        exact = {s for s, x in enumerate(row) if x and len(of[x]) > 1}
        found = {s for s, v in enumerate(got[i].tolist()) if v < never}
        assert exact <= found <= want and bool(found) == bool(want)


def test_copies_of_a_near_passage_name_the_earliest_document(spark):
    """Each passage says one phrase twice; its first document has one word changed, the two after it have it word for word."""
    rng = random.Random(12)
    word = lambda: f"v{rng.randrange(20000)}"
    texts, groups = [], 40
    for _ in range(groups):
        phrase = [word() for _ in range(8)]
        passage = [*[word() for _ in range(18)], *phrase, *[word() for _ in range(20)], *phrase, *[word() for _ in range(16)]]
        first = list(passage)
        first[rng.choice([5, 34, 60])] = word()
        texts += [" ".join([*[word() for _ in range(20)], *p, *[word() for _ in range(20)]]) for p in (first, passage, passage)]
    found = {r.doc_id: {s.first_id for s in r.spans} for r in substring_dedup.repeated_passages(frame(spark, texts)).collect()}
    assert sum(3 * k in found.get(3 * k + 1, ()) and 3 * k in found.get(3 * k + 2, ()) for k in range(groups)) >= 38


def test_cutting_leaves_other_columns_exact_and_names_apart(spark):
    """Microseconds, nested and odd values, columns named like the operator's; null, empty and very long texts; no rows."""
    rng = random.Random(8)
    words = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage, long = words(60), words(120_000)
    texts = [f"{words(20)} {passage} {words(5)}", f"{passage} {words(30)}", None, "", long, f"{words(3)} {long}"]
    rows = [(i, t, "mine", f"1893-04-0{i + 1} 10:20:30.12345{i}", f"2024-05-06 07:08:09.00000{i}", [1.5, None], float("nan"), i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, a string, b string, c array<double>, d double, `e.f` int")
    docs = docs.withColumns({"a": docs.a.cast("timestamp_ntz"), "b": docs.b.cast("timestamp"), "g": docs.text.cast("binary"), "h": docs.d.cast("float")})
    cut = substring_dedup.repeated_passages(docs, cut=True)
    assert sorted(cut.columns) == sorted([*docs.columns, "spans"])
    got = {r.doc_id: r for r in cut.collect()}
    for r in docs.collect():
        mine = got[r.doc_id]
        assert all(str(mine[c]) == str(r[c]) for c in ("a", "b", "c", "d", "e.f", "g", "h"))
        assert mine.n_words == len((r.text or "").split())
    assert got[0].text == texts[0] and passage not in got[1].text and got[4].text == long and len(got[5].text.split()) == 3
    assert substring_dedup.repeated_passages(docs.limit(0), cut=True).count() == 0


def test_sets_are_made_for_verified_nodes_only(spark, monkeypatch):
    """Before, the shingles of every text that shares a group were written, more than the texts themselves."""
    written, cut = {}, jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda df, name: written.setdefault(name, []).append(out := cut(df, name)) or out)
    counts, verified = [], jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda edges, nodes, percent: counts.append(edges.count()) or verified(edges, nodes, percent))
    head = [f"h{i}" for i in range(30)]
    texts = [" ".join([*head, *[f"w{k}_{i}" for i in range(90)]]) for k in range(20)]
    texts += [texts[0] + " more", "x " + texts[0], texts[0] + " more"]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(frame(spark, texts)).collect()}
    assert found == classes(texts)
    assert all("hashes" not in df.columns for df in written["jaccard-sets"]) and sum(counts) < 20


def test_texts_are_cut_and_hashed_as_their_words_one_by_one():
    texts = [b"", b" \x0b ", "A b\x1cC \u00c4 \x85x\u3000y\t\n".encode(), b"  a\r\nb\x0cA", "É É é".encode()]
    n, found = WordHashes().of_texts(texts)
    words = [t.lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in words]
    assert found.tolist() == WordHashes().of([x for w in words for x in w]).tolist()
    assert [len(x) for x in WordHashes().of_texts([])] == [0, 0]


def test_windows_are_searched_once_for_each_block(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(400)).encode()
    monkeypatch.setattr(substring_dedup.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "rest": pa.array([None] * 3, pa.string()), "text": [text.decode(), None, "x " + text.decode()]})
    blocks = pa.Table.from_batches(list(substring_dedup._blobs(10, 4)([batch])))
    s = substring_dedup.Sequences([text, b"", b"x " + text], WordHashes(), 10)
    for f, seed in enumerate(substring_dedup.SEEDS):
        assert [x.tolist() for x in substring_dedup._windows(blocks["windows"][0].as_py(), f)] == [x.tolist() for x in s.windows(seed)]
    monkeypatch.setattr(substring_dedup.Sequences, "windows", None)
    shared = [(3 << 32, x["bucket"], zstandard.compress(b"\xff" * len(x["docs"]) * 8)) for x in blocks["asks"][0].as_py()]
    shared = pa.table([pa.array(c) for c in zip(*shared, strict=True)], names=["block", "bucket", "shared"])
    asked = substring_dedup._ask_runs(10, 4)(blocks, shared)
    assert asked.num_rows and set(asked["bucket"].to_pylist()) <= set(range(12))


def test_tasks_give_back_what_arrow_holds(monkeypatch):
    calls = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: calls.append(1)})())
    batch = pa.RecordBatch.from_pydict({"k": [1, 1, 2], "text": ["a", None, "b"]})
    assert [t.num_rows for t in shared.runs([batch], "k")] == [2, 1]
    assert list(shared.split_blocks([batch], ["k", "text"])) == [[[1, 1, 2], [b"a", b"", b"b"]]]
    assert len(calls) == 2


def test_runs_are_asked_for_only_if_their_centres_are_shared_under_every_function(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(400))
    monkeypatch.setattr(substring_dedup.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "rest": pa.array([None] * 2, pa.string()), "text": [text, "x " + text]})
    blocks = pa.Table.from_batches(list(substring_dedup._blobs(10, 4)([batch])))
    for marks, some in ((b"\xff\xff", True), (b"\xff\x00", False), (b"\x00\xff", False)):
        shared = [(3 << 32, x["bucket"], zstandard.compress(marks[x["bucket"] // 4 : x["bucket"] // 4 + 1] * len(x["docs"]) * 8)) for x in blocks["asks"][0].as_py()]
        shared = pa.table([pa.array(c) for c in zip(*shared, strict=True)], names=["block", "bucket", "shared"])
        asked = substring_dedup._ask_runs(10, 4)(blocks, shared)
        assert any(b < 4 for b in asked["bucket"].to_pylist()) == some and any(b >= 4 for b in asked["bucket"].to_pylist())


def test_windows_with_equal_shingles_like_one_by_one():
    rng = np.random.default_rng(2)
    texts = [b" ".join(b"w%d" % k for k in rng.integers(0, kinds, n)) for kinds, n in ((1, 60), (2, 90), (50, 300), (3, 14), (2, 200), (5, 13))]
    s = substring_dedup.Sequences([*texts, b"a b"], WordHashes(), 10)
    lo, centre, hi = s.windows(substring_dedup.SEEDS[1])
    value = substring_dedup.mix(s.seq ^ np.uint64(substring_dedup.SEEDS[1]))
    want = set()
    for begin, end in zip(s.begins.tolist(), s.ends.tolist(), strict=True):
        want |= {k + int(value[k : k + 10].argmin()) for k in range(begin, end - 9)}
    assert centre.tolist() == sorted(want)
    for x, c, y in zip(lo.tolist(), centre.tolist(), hi.tolist(), strict=True):
        begin, end = s.begins[s.owner[c]], s.ends[s.owner[c]]
        assert (value[x:c] > value[c]).all() and (value[c + 1 : y + 1] >= value[c]).all()
        assert x == begin or value[x - 1] <= value[c]
        assert y == end - 1 or value[y + 1] < value[c]


def test_shingles_meet_within_their_pair_only():
    x, y = np.array([[0, 5, 6, 9], [9, 8, 7, 5], [1, 1, 3, 4]], np.int32), np.array([[9, 0, 7, 5], [9, 9, 9, 9], [2, 4, 2, 3]], np.int32)
    x[1], y[1] = 9, 0
    place, held = substring_dedup._meetings(x, y)
    assert place.tolist() == [[3, 255, 255, 1], [255] * 4, [255, 3, 255, 2]]
    assert held.tolist() == [[False, True, False, True], [False] * 4, [False, False, True, True]]
    wide = [v.astype(np.uint64) << np.uint64(59) for v in (x, y)]
    assert substring_dedup._meetings(*wide)[0].tolist() == place.tolist()


def test_words_of_every_length_are_hashed_as_xxhash_does():
    words = [bytes(97 + (k * k + i) % 26 for i in range(k)) for k in range(1, 80)]
    n, found = WordHashes().of_texts([b"\t".join(words), b" ".join(words[::-1])])
    assert n.tolist() == [79, 79] and found.tolist() == WordHashes().of(words + words[::-1]).tolist()


def test_pairs_that_can_give_no_wanted_run_a_partner_are_left_out(monkeypatch):
    rng, t = random.Random(10), 12
    base = [rng.randrange(1, 10**6) for _ in range(2 * t - 1)]
    other = [*base[:13], *(rng.randrange(10**6, 10**7) for _ in range(10))]
    x, y = np.array([base] * 3, np.int32), np.array([other, [5, *other[:-1]], other], np.int32)
    whole = substring_dedup._similar(x, y, t, 75)
    assert whole[0].any(1).all() and not whole[0][:, -1].any()
    on, off = np.ones((3, t), bool), np.zeros((3, t), bool)
    last = off.copy()
    last[:, -1] = True
    never = np.zeros(3, bool)
    assert all((a == b).all() for a, b in zip(whole, substring_dedup._similar(x, y, t, 75, never, (on, off)), strict=True))
    monkeypatch.setattr(substring_dedup, "_best_common", None)  # nothing is left to compare
    for wanted in ((off, off), (last, last)):
        assert not any(v.any() for v in substring_dedup._similar(x, y, t, 75, never, wanted))


def test_centres_with_equal_surroundings_are_not_compared(monkeypatch):
    rng, t = random.Random(11), 12
    size = 2 * t + substring_dedup.WIDTH - 2
    rows = []
    for key in range(30):
        context = [rng.randrange(1, 2**16) for _ in range(size)]
        if key % 3 == 1:
            context = [7, 8] * size
        context = ([0] * (key % 5) + context)[:size]
        rows += [(key, 100 + rng.randrange(50), doc, context) for doc in range(1 if key % 7 == 6 else rng.randrange(2, 5)) for _ in range(1 + key % 2)]
    rng.shuffle(rows)
    keys, ids, docs, contexts = (np.array(c, k) for c, k in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int64, np.uint16), strict=True))
    want = substring_dedup._near(keys, ids, docs, contexts, t, 75)
    assert (want < np.iinfo(np.int64).max).any(1).sum() > 40
    monkeypatch.setattr(substring_dedup, "_near", None)
    assert substring_dedup._near_by_centre(keys, ids, docs, contexts, t, 75).tolist() == want.tolist()
    assert substring_dedup._near_by_centre(keys[:0], ids[:0], docs[:0], contexts[:0], t, 75).shape == (0, t)
