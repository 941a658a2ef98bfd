"""Fingerprints, the language model and SentencePiece against plain versions."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd import ids_and_texts, lower, no_docs, odd_docs, words
from pyspark.sql import functions as F

from thicket.llm import chunks, context_tree, digests, pieces


def test_entropy_classes():
    data = np.random.default_rng(3).integers(97, 110, 400).astype(np.uint8)
    got = digests.entropy_classes(data)
    for i in range(len(got)):
        h = -sum(c / 64 * math.log2(c / 64) for c in Counter(data[i : i + 64].tolist()).values())
        assert abs(got[i] - h / 6 * 1000) <= 1.001


def test_selection_by_hand():
    data = np.random.default_rng(5).integers(97, 120, 700).astype(np.uint8)
    ranks = digests.rarity_ranks(digests.class_counts(data, np.array([0, 700])))
    rank = ranks[digests.entropy_classes(data)]
    wins = Counter(min(range(i, i + 64), key=lambda k: (rank[k], k)) for i in range(len(rank) - 63))
    chosen = sum(n >= digests.LEAST_WINS for n in wins.values())
    doc, h = digests._features(data, np.array([0, 700]), ranks)
    assert len(h) == chosen > 0
    # neighbours in a batch don't change a text's features
    both = np.concatenate([data, data[::-1], data])
    doc, h2 = digests._features(both, np.array([0, 700, 1400, 2100]), ranks)
    assert (h2[doc == 0] == h).all() and (h2[doc == 2] == h).all()


def test_edited_neighbours(spark):
    docs = odd_docs(spark)
    ranks = digests.corpus_ranks(docs)
    rows = sorted(((i is None, i or 0, t or "") for i, t in ids_and_texts(docs)))
    expected = []
    for k, (_, i, text) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][2], len(text) // 2
        expected.append((i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    got = digests.edited_neighbours(docs, ranks).collect()
    assert sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == sorted(expected)
    prints = defaultdict(set)
    for r in got:
        prints[r.n_chars, r.doc_id].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    alone = {(r.row.n_chars, r.row.doc_id): r.fingerprint for r in digests.fingerprints(docs, ranks).collect() if r.row.n_chars}
    assert all(prints[k] == {v} for k, v in alone.items())
    assert digests.edited_neighbours(no_docs(spark), digests.corpus_ranks(no_docs(spark))).count() == 0


def test_likeness():
    text = b"the quick brown fox jumps over the lazy dog and then some more words follow here " * 3
    other = bytes(np.random.default_rng(1).integers(97, 122, 300).astype(np.uint8))
    ranks = digests.rarity_ranks(np.zeros(1001, np.int64))
    a, b, c, empty = digests.digests([text, text, other, b""], ranks)
    assert a.text() == b.text() and digests.likeness(a, b) == 1 and digests.likeness(a, c) < 0.3
    assert digests.likeness(empty, empty) == 1 and digests.likeness(a, empty) == 0
    assert digests.likeness(digests.Digest.parse(a.text()), c) == digests.likeness(a, c)


def ctw_by_hand(train, depth):
    """Plain context-tree weighting over bits with byte contexts."""
    counts = defaultdict(lambda: [0, 0])
    for text in train:
        padded = b"\n" * depth + text
        for i in range(depth, len(padded)):
            for d in range(depth + 1):
                known = 1
                for j in range(8):
                    bit = padded[i] >> (7 - j) & 1
                    counts[padded[i - d : i], known][bit] += 1
                    known = known << 1 | bit
    children = defaultdict(list)
    for context, known in counts:
        if context:
            children[context[1:], known].append((context, known))
    log_kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    log_w, weight = {}, {}
    for node in sorted(counts, key=lambda n: -len(n[0])):
        own = log_kt(*counts[node])
        if len(node[0]) == depth:
            log_w[node], weight[node] = own, 1.0
        else:
            below = sum(log_w[c] for c in children[node])
            top = max(own, below)
            both = top + math.log(math.exp(own - top) + math.exp(below - top))
            log_w[node], weight[node] = both - math.log(2), math.exp(own - both)

    def score(text):
        padded, total = b"\n" * depth + text, 0.0
        for i in range(depth, len(padded)):
            known = 1
            for j in range(8):
                bit, p, seen = padded[i] >> (7 - j) & 1, 0.5, False
                for d in range(depth, -1, -1):
                    node = (padded[i - d : i], known)
                    if node in counts:
                        q = (counts[node][bit] + 0.5) / (sum(counts[node]) + 1)
                        p, seen = (weight[node] * q + (1 - weight[node]) * p if seen else q), True
                total += math.log10(p)
                known = known << 1 | bit
        return total

    return score


def test_context_trees(spark):
    docs = odd_docs(spark).where("coalesce(length(text), 0) < 3000")
    rows = [(i, " ".join(words(lower(t)))) for i, t in ids_and_texts(docs)]
    train = [t for i, t in rows if i is not None and i % 2 == 1]
    score = ctw_by_hand([t.encode() + b"\n" for t in train], context_tree.DEPTH)
    tokens = Counter(w for t in train for w in [*t.split(), None]) if train else Counter()
    n, v = sum(tokens.values()), len(tokens)
    base = lambda t: sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t.split(), None])
    expected = sorted((i or 0, len(t.split()) + 1, sum(tokens[w] > 0 for w in [*t.split(), None]), n, base(t), score(t.encode() + b"\n")) for i, t in rows)
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in context_tree.ctw_scores(docs, F.col("id") % 2 == 1).collect())
    for a, b in zip(got, expected, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-5, abs=1e-4)


def test_grams_of_a_frequent_context_are_sent_once(spark):
    """Contexts get each distinct gram once, however many chunks hold it; on the way, grams of one pair of bytes are spread."""
    g = (np.arange(50_000, dtype=np.uint64) << np.uint64(24)) + np.uint64(0x652061)
    assert len(set(chunks.bucket_of(context_tree.deal_of(g), 16))) == 1
    assert max(Counter(chunks.bucket_of(context_tree.spread_of(g), 16)).values()) < 2 * len(g) / 16
    docs = spark.createDataFrame([(i, "we see the same here") for i in range(12)], "id long, text string").repartition(12, "id")
    table = chunks.chunk_documents(docs, "id", "text", lambda texts: 1)
    assert table.count() > 3
    distinct = g[:500]
    asked = chunks.ask(table, 4, lambda batch: {"deal": context_tree.spread_of(distinct), "gram": distinct, "n": np.full(len(distinct), len(batch))})
    first_held_out = table.agg(F.max("chunk")).head()[0]
    sums = [chunks.unpack(r.counts) for r in context_tree.gram_sums(asked, 4, first_held_out).collect()]
    assert sorted(x for p in sums for x in p["gram"].to_pylist()) == distinct.tolist()
    learning = sum(len(chunks.unpack(r.docs)) for r in table.collect() if r.chunk < first_held_out)
    assert {x for p in sums for x in p["n"].to_pylist()} == {learning}


def test_context_trees_without_training(spark):
    docs = odd_docs(spark).where("coalesce(length(text), 0) < 100")
    for r in context_tree.ctw_scores(docs, F.lit(False)).collect():
        assert r.bits_per_byte == pytest.approx(8, rel=1e-5) and r.n_known == 0
    assert context_tree.ctw_scores(no_docs(spark), F.lit(True)).count() == 0


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The vocabulary as a lattice model of the library, with scores that 32-bit sums can hold."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.MODEL, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        piece.score = max(piece.score, -40_000)
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    return str(path), SentencePieceProcessor(model_file=str(path))


def test_ids_are_those_of_the_library(unigram):
    path, library = unigram
    v = pieces.Vocabulary(path)
    texts = ["", " ", "the", "a  b", "  two   blanks ", "Ünd日本 \n\tx", "thereath, theatiti of the", "x\U0001f600y", "nul\x00"]
    for text in texts:
        assert v.encode(text) == library.encode(text), text
        assert v.decode(v.encode(text)) == text


def test_chunks_give_the_same_ids(spark, unigram):
    path, _ = unigram
    docs = odd_docs(spark).where("coalesce(length(text), 0) < 6000")
    whole = sorted((r.doc_id or 0, bytes(r.tokens)) for r in pieces.encode(docs, model=path).collect())
    for chunk in (1, 5, 37, 1000):
        assert sorted((r.doc_id or 0, bytes(r.tokens)) for r in pieces.encode(docs, model=path, giant=20, chunk=chunk).collect()) == whole


def test_round_trip(spark):
    docs = odd_docs(spark)
    back = pieces.decode(pieces.encode(docs)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in ids_and_texts(docs))
    assert pieces.encode(no_docs(spark)).count() == 0


def test_chunk_numbers_of_many_partitions():
    """Numbers of training and held-out chunks never meet, and leave room for a row number."""
    from thicket.llm import chunks as C

    last = C.chunk_number(C.PARTS - 1, C.CHUNKS_PER_PART - 1)
    assert last < C.CHUNK_NUMBERS and (last + C.CHUNK_NUMBERS + 1) * C.CHUNK_ROWS < 1 << 63
    assert len({C.chunk_number(p, k) for p in (0, 262_144, 300_000, 524_288) for k in (0, 1, 9999)}) == 12
    for bad in ((0, C.CHUNKS_PER_PART), (C.PARTS, 0)):
        with pytest.raises(ValueError, match="repartition"):
            C.chunk_number(*bad)


def test_words_are_looked_up_once_per_batch(monkeypatch):
    """A batch gives the ids and texts of its rows one by one, and asks for a word's ids once."""
    import pyarrow as pa

    v = pieces.Vocabulary(pieces.MODEL)
    texts = ["", " ", "a", "the cat the cat", " led", "tail ", "two  blanks", "\u2581mark", "x\u2581y z", "line\nnext the\tcat", "\u65e5\u672c \U0001f600 \u00e9", "the cat"]
    want = [v.encoded(t) for t in texts]
    for rows, ids in ((texts, want), (["the cat"], want[-1:]), (["", " "], want[:2]), ([], [])):
        assert v.encoded_all(pa.array(rows, pa.string())).to_pylist() == ids
    assert v.encoded_all(pa.array(texts, pa.string()).slice(2, 5)).to_pylist() == want[2:7]
    rows = pa.array([*want, None, v.encoded("\U0001f600")[:-4]], pa.binary())
    for part in (rows, rows.slice(3, 6), rows.slice(0, 0), rows.slice(0, 1)):
        n, got = v.decoded_all(part)
        ids = [np.frombuffer(t or b"", "<i4").tolist() for t in part.to_pylist()]
        assert n.tolist() == [len(i) for i in ids] and got.to_pylist() == [v.decode(i) for i in ids]
    asked = []
    monkeypatch.setattr(v, "known", {})
    monkeypatch.setattr(v, "segment", lambda w, f=v.segment: asked.append(w) or f(w))
    v.encoded_all(pa.array(["the cat the cat", "cat the"]))
    assert sorted(asked) == ["\u2581cat", "\u2581the"]
