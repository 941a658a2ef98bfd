"""Quality rules and packing."""

from collections import Counter

import numpy as np
from odd import no_docs, odd_docs, words

from thicket.llm import packing, quality_rules


def counts_by_hand(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    times = Counter(grams)
    repeated = {p for k, g in enumerate(grams) if times[g] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), len(lines) - len(set(lines)), len(repeated)


def test_counts(spark):
    docs = odd_docs(spark)
    out = quality_rules.quality_rules(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and set(out.select("row.*").columns) == set(docs.columns)
    for r in rows:
        n, chars, symbols, dup, repeats = counts_by_hand(r.row.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.base_failed and r.kept)


def test_rules_on_no_rows(spark):
    assert quality_rules.quality_rules(no_docs(spark)).count() == 0


def test_limits_follow_the_source(spark):
    """What is usual for one source is an outlier in another; a small source takes the limits of its language."""
    plain, marked = " ".join(f"word{k}" for k in range(60)), " ".join(f"#w{k}#" for k in range(60))
    rows = [(i, plain + f" u{i}", "en", "a", 0) for i in range(300)] + [(1000 + i, marked + f" u{i}", "en", "b", 0) for i in range(300)]
    rows += [(2000, marked, "en", "a", 0), (2001, plain, "en", "a", 0), (3000, marked, "fr", "c", 0)]
    got = {r.row.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(got[i] for i in range(300)) and all(got[1000 + i] for i in range(300))
    assert not got[2000] and got[2001]


def test_packing_invariants(spark):
    docs = odd_docs(spark)
    rows = packing.pack(docs, capacities=(16, 64, 256), shard_pieces=10).collect()
    assert sum(r.n_tokens for r in rows) == sum(len(words(r.text)) for r in docs.collect())
    bins = {}
    for r in rows:
        assert (r.bin_id is None) == (r.n_tokens == 0) and r.n_tokens <= 256
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        ends = [r.offset + r.n_tokens for r in held]
        assert [r.offset for r in held] == [0, *ends[:-1]]
        assert len({r.capacity for r in held}) == 1 and held[0].capacity == min(c for c in (16, 64, 256) if c >= ends[-1])


def test_sequences_hold_all_words(spark):
    docs = odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    out = packing.sequences(docs, packing.pack(docs, capacities=(16, 64))).collect()
    texts = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        texts.setdefault(r.doc_id, []).append(r.text)
    assert {k: " ".join(v) for k, v in texts.items()} == {r.doc_id: " ".join(words(r.text)) for r in docs.collect() if words(r.text)}


def test_sequences_of_rows_without_an_id_of_their_own(spark):
    """Null ids, and an id that rows with different or equal texts share, keep each row's exact words."""
    texts = [f"row{k} " * (k % 40 + 1) for k in range(60)]
    rows = [(None, t) for t in texts] + [(7, t + "seven") for t in texts] + [(None, "same text"), (None, "same text"), (7, "same text"), (8, "same text"), ((1 << 60) + 1, "large id"), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed = packing.pack(docs, capacities=(16,), shard_pieces=10)
    out = packing.sequences(docs, packed).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.row_key, r.piece)):
        got.setdefault((r.row_key, r.doc_id), []).append(r.text)
    assert Counter((i, " ".join(t)) for (_, i), t in got.items()) == Counter((i, " ".join(words(t))) for i, t in rows if words(t))
    assert max(Counter(r.bin_id >> 32 for r in out).values()) <= 30


def test_pieces_of_one_id_go_to_many_shards(spark):
    docs = spark.createDataFrame([(7, "one same text")] * 400, "doc_id long, text string").repartition(3)
    assert max(Counter(r.bin_id >> 32 for r in packing.pack(docs, shard_pieces=20).collect()).values()) <= 60


def best_fit_by_hand(lengths, capacities, overhead):
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    queue = [lengths[i] for i in order]
    sizes, used, since, out = [], [], [], [0] * len(lengths)
    for k, i in enumerate(order):
        fitting = [(sizes[b] - used[b], since[b], b) for b in range(len(sizes)) if sizes[b] - used[b] >= lengths[i]]
        if fitting:
            b = min(fitting)[2]
        else:
            costs = []
            for c in sorted(capacities):
                if c >= lengths[i]:
                    room = c - lengths[i]
                    for x in queue[k + 1 :]:
                        room -= x if x <= room else 0
                    costs.append(((c + overhead) / (c - room), c))
            sizes.append(min(costs)[1])
            used.append(0)
            since.append(0)
            b = len(sizes) - 1
        used[b] += lengths[i]
        since[b] = k + 1
        out[i] = b
    return out, [min(c for c in capacities if c >= u) for u in used]


def test_best_fit_against_a_plain_one():
    for seed in range(12):
        lengths = np.random.default_rng(seed).integers(1, 65, 50)
        bins, _, sizes = packing.best_fit(lengths, (16, 32, 64), 4)
        assert (list(bins), list(sizes)) == best_fit_by_hand(list(lengths), (16, 32, 64), 4)


def test_packing_no_rows(spark):
    assert packing.pack(no_docs(spark)).count() == 0
