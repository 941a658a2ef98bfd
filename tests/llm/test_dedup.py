"""Substring dedup and near duplicates against brute force."""

from collections import defaultdict

import numpy as np
from odd import ids_and_texts, lower, no_docs, odd_docs, words

from thicket.llm import jaccard, substring
from thicket.llm.components import components
from thicket.llm.words import Words

LAST = float("inf")


def spans_by_hand(rows, width):
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, LAST), LAST if i is None else i)
    out = []
    for i, text in rows:
        w, gone = words(text), set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (LAST if i is None else i):
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone), sorted(gone)))
    return out


def test_repeated_spans(spark):
    docs = odd_docs(spark)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept, [k for s in r.spans for k in range(s.start, s.end)]) for r in substring.repeated_spans(docs).collect()]
    assert sorted(got, key=key) == sorted(spans_by_hand(ids_and_texts(docs), 13), key=key)


def test_without_repeats(spark):
    docs = odd_docs(spark)
    by_hand = {(i, n): (kept if n_gone else None) for i, n, n_gone, kept, _ in spans_by_hand(ids_and_texts(docs), 13)}
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {(r.doc_id, len(words(r.text))): r.text for r in docs.collect()}
    for r in out.collect():
        matches = [k for k in by_hand if k[0] == r.doc_id and (by_hand[k] if by_hand[k] is not None else texts[k] or "") == r.text]
        assert matches, r


def test_empty_table(spark):
    assert substring.repeated_spans(no_docs(spark)).count() == 0
    assert jaccard.near_duplicates(no_docs(spark)).count() == 0


def groups_by_hand(rows, width=5, percent=75):
    sets = []
    for _, text in rows:
        w = words(lower(text))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(lambda: LAST)
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], LAST if doc is None else doc)
    return [(doc, len(sets[i]), None if least[find(i)] == LAST else least[find(i)]) for i, (doc, _) in enumerate(rows)], len({find(i) for i in range(len(rows))})


def test_near_duplicates(spark):
    docs = odd_docs(spark)
    expected, groups = groups_by_hand(ids_and_texts(docs))
    got = jaccard.near_duplicates(docs).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == sorted(expected, key=repr)
    assert sum(r.stays for r in got) == groups


def test_large_group_of_near_copies(spark):
    """Leaders connect the core; what they leave is paired, and no link is lost."""
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 9), replace=False):
            w[k] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected, _ = groups_by_hand(rows)
    got = jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_prefixes_grow_where_it_is_cheaper():
    rare = np.array([1] * 20 + [2] * 80)
    assert jaccard.choose_prefix(rare, 75) >= 1
    costly = np.array([500] * 26 + [501] * 74)
    assert jaccard.choose_prefix(costly, 75) > 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


def test_words_are_those_of_the_pattern():
    for text in ("", " a", "a\x0bb\x0c c\r\n", "日本 x y z", "a\x1cb"):
        data = text.encode()
        w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert [data[a:b].decode() for a, b in zip(w.starts, w.ends, strict=True)] == words(text)


def test_components_by_rounds(spark, monkeypatch):
    from thicket.llm import components as way

    monkeypatch.setattr(way, "IN_ONE_TASK", 0)
    test_components(spark)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    """Lists longer than two, blocks of three sets, no leaders' round but the first: the same groups."""
    for name, value in (("LONG_LIST", 2), ("BLOCK_SETS", 3), ("PAIRS_PER_POSTING", 0), ("LEFT_BY_ROUND", 0.0), ("TOKENS_AT_ONCE", 5)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(40):  # copies with edits, some near enough and some not
        text = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            text[at] = f"x{k}-{at}"
        rows.append((k, " ".join(text)))
    rows += [(100 + k, f"other text number {k} of some more words here {k}") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected, _ = groups_by_hand(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()} == set(expected)


def test_overlaps():
    rng = np.random.default_rng(10)
    sets = [np.unique(rng.integers(0, 40, n).astype(np.uint64)) for n in (0, 1, 9, 30, 30, 200)]
    got = jaccard.overlaps(sets, np.arange(6), np.array([1, 3, 5]))
    for k, b in enumerate((1, 3, 5)):  # a set's overlap with itself isn't asked for
        assert [got[a, k] for a in range(6) if a != b] == [len(np.intersect1d(sets[a], sets[b])) for a in range(6) if a != b]
    assert jaccard.overlaps([np.zeros(0, np.uint64)], np.arange(1), np.arange(1)).tolist() == [[0]]


def test_components_meet_sets_and_not_each_posting(spark, monkeypatch):
    """The join of a round has a row per set, however many postings the set has."""
    text = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(k, f"{text} end{k}") for k in range(6)], "doc_id long, text string")
    kept, plain = [], jaccard.materialize

    def noted(df, name="step", **more):
        out = plain(df, name, **more)
        return kept.append(out.select("key").collect()) or out if name == "postings" else out

    monkeypatch.setattr(jaccard, "materialize", noted)
    found = jaccard.near_duplicates(docs).collect()
    assert {r["component_id"] for r in found} == {0}
    assert len(kept[-1]) == len(set(kept[-1])) == 6


def test_written_links_are_not_written_again(spark, monkeypatch):
    """A round's few links are followed where they lie."""
    from thicket.llm import components as way

    monkeypatch.setattr(way, "materialize", None)
    links = spark.createDataFrame([(3, 1), (2, 3), (3, 1), (5, 5), (9, 7)], "a long, b long")
    assert {tuple(r) for r in components(links, written=True).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}


def test_blocks_cover_all_pairs_of_components(spark):
    """Each two members of a group and of different components meet once, those of a large component nowhere."""
    from thicket.llm.blocks import dealt_to_blocks

    rows = [(k, g, 1000 + k % 2 if k < 30 else k) for g, n in ((1, 60), (2, 3), (3, 20)) for k in range(n)]
    rows = [(100 * g + k, g, 100 * g + r) for k, g, r in rows]
    out = dealt_to_blocks(spark.createDataFrame(rows, "key long, home long, root long"), "home", 8).collect()
    met = defaultdict(int)
    for x in out:
        for y in out:
            if x.key < y.key and (x.home, x.pair) == (y.home, y.pair) and (x.side != y.side if x.two else True):
                met[x.key, y.key] += 1
    root = {k: (g, r) for k, g, r in rows}
    large = {r for r in root.values() if list(root.values()).count(r) > 2}
    wanted = {(a, b) for a in root for b in root if a < b and root[a][0] == root[b][0] and root[a] != root[b]}
    assert wanted <= set(met) and set(met.values()) == {1}
    assert all(root[a] != root[b] or root[a] not in large for a, b in met if root[a][0] == 1)
