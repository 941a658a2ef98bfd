"""Self join of documents on the Jaccard similarity of their word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import chunks as C
from thicket.llm.blocks import dealt_to_blocks, same_component
from thicket.llm.components import components
from thicket.llm.words import U, WORD_BASE, Words, mix, polynomial, random_words, steps
from thicket.session import Scratch, materialize

WIDTH = 5
PERCENT = 75
#: Prefixes grow by up to this many tokens where that is estimated to be cheaper.
MOST_SHARED = 8
#: Cost of verifying a candidate, in postings read.
VERIFY_COST = 20
#: Rounds against one leader per list go on while all pairs would be more than this many times
#: the postings, and a round has left less than this share of the pairs before it.
PAIRS_PER_POSTING, LEFT_BY_ROUND = 5, 0.3
#: Longer lists than this are compared as wholes where leaders leave much, in blocks of so many sets.
LONG_LIST, BLOCK_SETS = 64, 512
#: Rounds of that at most; what they leave is enumerated.
MOST_HOMES = 5
#: Columns of the matrices that sets are compared by.
TOKENS_AT_ONCE = 4096
SET_SCHEMA = "key long, id long, n long, h1 long, h2 long, shared int, postings array<struct<t:long,pos:int>>, tokens binary"


def _shingles(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, hash) of each distinct shingle of each document, ascending, and the rows."""
    rows, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=U)]
    for row, _, data, offsets in steps(batch["text"]):
        words = Words(data, offsets, lower=True)
        h, at = words.windows(width)
        count = np.diff(words.bounds)
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            whole = polynomial(words.hashes(), words.bounds[short], words.bounds[short + 1], WORD_BASE)
            h, doc = np.concatenate([h, mix(whole + U(1) + count[short].astype(U))]), np.concatenate([words.doc[at], short])
        else:
            doc = words.doc[at]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        rows.append(doc[new] + row)
        hashes.append(h[new])
    return np.concatenate(rows), np.concatenate(hashes), len(batch)


def _least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n shares with any set it is linked to."""
    return -(-percent * n // 100)


def choose_prefix(df: np.ndarray, alpha: int) -> int:
    """Shared prefix tokens to require, given document frequencies in the global order.

    Requiring k shared tokens needs a prefix of n - alpha + k tokens. The cost is the
    postings read plus the candidates left, of which each has been met k times or more.
    """
    n = len(df)
    most = min(MOST_SHARED, alpha)
    met = np.cumsum(df[: n - alpha + most] - 1)[n - alpha :]
    return int(np.argmin(met * (1 + VERIFY_COST / np.arange(1, most + 1)))) + 1


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, keep: list[str] | None = None) -> DataFrame:
    """A row per document: its set's size and digest, its prefix postings, and the whole set where it has any.

    Tokens are ordered by document frequency over all documents, then by hash; those of a
    single document can't be shared, so they fill prefixes without becoming postings. A
    frequency may come out too high where two hashes meet in a bucket, but the same for all
    documents, so the order stays one for all.
    """

    def count(texts: pa.Array) -> int:
        return sum(len(Words(data, offsets).starts) for _, _, data, offsets in steps(texts))

    def ask(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        h, times = np.unique(_shingles(batch, width)[1], return_counts=True)
        # half of the hash will do: a chance meeting in a bucket raises the frequency for all that ask
        return {"deal": h, "low": h.astype(np.uint32), "df": times.astype(np.uint32)}

    def frequency(sent: dict[str, np.ndarray], _chunk: np.ndarray) -> np.ndarray:
        order = np.argsort(sent["low"], kind="stable")
        h = sent["low"][order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.repeat(np.add.reduceat(sent["df"][order].astype(np.int64), new), np.diff(np.append(new, len(h))))
        out = np.empty(len(h), dtype=np.int64)
        out[order] = total
        return out

    def prefixes(batch: pa.RecordBatch, key: int, lookup) -> Iterator[pa.RecordBatch]:
        rows, h, n_docs = _shingles(batch, width)
        known = np.unique(h)
        df = lookup(known).astype(np.int64)[np.searchsorted(known, h)] if len(h) else np.zeros(0, dtype=np.int64)
        bounds = np.searchsorted(rows, np.arange(n_docs + 1))
        size = np.diff(bounds)
        with np.errstate(over="ignore"):
            totals = [np.concatenate([np.zeros(1, dtype=U), np.cumsum(mix(h + random_words(2, 7)[k]), dtype=U)]) for k in (0, 1)]
            digests = [(t[bounds[1:]] - t[bounds[:-1]]).view(np.int64) for t in totals]
        alpha = -(-percent * size // 100)
        order = np.lexsort((h, df, rows))
        h_sorted, df_sorted = h[order], df[order]
        place = np.arange(len(h)) - bounds[rows]
        maybe = np.unique(rows[(df_sorted > 1) & (place < (size - alpha + MOST_SHARED)[rows])])
        shared, tokens = np.ones(n_docs, dtype=np.int32), [None] * n_docs
        t, pos, n_postings = [], [], np.zeros(n_docs, dtype=np.int64)
        for d in maybe:
            own = slice(bounds[d], bounds[d + 1])
            k = choose_prefix(df_sorted[own], int(alpha[d]))
            at = np.flatnonzero(df_sorted[own][: size[d] - alpha[d] + k] > 1)
            if len(at):
                shared[d], n_postings[d], tokens[d] = k, len(at), h[own].tobytes()
                t.append(h_sorted[own][at])
                pos.append(at)
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(t).view(np.int64) if t else np.zeros(0, np.int64)), pa.array(np.concatenate(pos) if pos else [], pa.int32())], ["t", "pos"])
        postings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_postings)]), pa.int32()), flat)
        ids = np.asarray(batch["id"])
        row = {"row": batch["row"]} if keep else {}
        whole = pa.RecordBatch.from_arrays(
            [pa.array(key + np.arange(n_docs)), pa.array(ids, pa.int64(), mask=ids == C.NO_ID), pa.array(size, pa.int64()), pa.array(digests[0]), pa.array(digests[1]), pa.array(shared), postings, pa.array(tokens, pa.binary()), *row.values()],
            names=["key", "id", "n", "h1", "h2", "shared", "postings", "tokens", *row],
        )
        for row in range(0, n_docs, 2000):
            yield whole.slice(row, 2000)

    chunks = C.chunk_documents(docs, id_col, text_col, count, keep)
    n = C.buckets_for(chunks)
    schema = SET_SCHEMA + (f", row {docs.select(F.struct(*keep)).dtypes[0][1]}" if keep else "")
    return materialize(C.answered(chunks, [C.answer(C.ask(chunks, n, ask), frequency)], n, prefixes, schema), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough, with the size of the intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = np.zeros(len(batch), dtype=np.int64)
            size = np.zeros(len(batch), dtype=np.int64)
            for row, (x, y) in enumerate(zip(batch["x"], batch["y"], strict=True)):
                x, y = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common[row] = np.count_nonzero(both[1:] == both[:-1])
                size[row] = len(both) - common[row]
            linked = 100 * common >= percent * size
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(common)], names=["a", "b", "common"]).filter(pa.array(linked))

    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, common long")


def _similar_sizes(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def overlaps(tokens: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets a with other sets b, by products of 0/1 matrices over the tokens that several hold."""
    out = np.zeros((len(a), len(b)))
    row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    _, column, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    row, column = row[times[column] > 1], number[column[times[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, TOKENS_AT_ONCE):
        part = slice(*np.searchsorted(column, [start, start + TOKENS_AT_ONCE]))
        held = np.zeros((len(tokens), TOKENS_AT_ONCE), dtype=np.float32)
        held[row[part], column[part] - start] = 1
        out += held[a] @ held[b].T
    return out


def _compared(percent: int):
    """(a, b): links that connect what is linked among the sets of a group, or between two blocks of it."""

    def run(table: pa.Table) -> pa.Table:
        keys, root, n, side = (np.asarray(table[c]) for c in ("key", "root", "n", "side"))
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if table["two"][0].as_py() else a
        common = overlaps([np.frombuffer(x.as_buffer(), dtype=U) for x in table["tokens"]], a, b)
        linked = (100 * common >= percent * (n[a][:, None] + n[b][None, :] - common)) & (root[a][:, None] != root[b][None, :])
        i, j = np.nonzero(linked)
        least = same_component(len(keys), a[i], b[j])
        moved = np.flatnonzero(least != np.arange(len(keys)))
        return pa.table({"a": keys[moved], "b": keys[least[moved]]})

    return run


def _postings(held: DataFrame, roots: DataFrame | None, homes: dict[str, DataFrame]) -> DataFrame:
    """A row per posting of the sets, with the component and the homes of its set."""
    out = held.withColumn("root", F.col("key")) if roots is None else held.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    for chosen in homes.values():
        out = out.join(chosen, "key", "left")
    return out.select("key", "n", "shared", "rest", "most", "root", *homes, F.explode("p").alias("p")).select("*", "p.t", "p.pos", "p.level").drop("p")


def _merged(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(node, root), written, when new links, written, join the components found so far."""
    if roots is not None:
        links = links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return materialize(components(links, written=True), "roots")


def _open_pairs(here: DataFrame, homes: list[str]) -> DataFrame:
    """(t, m, open): each list's length and its pairs that are neither of one component nor have a home in common.

    What is closed is counted by inclusion and exclusion over the component and the homes.
    """
    groups = ["root", *homes]
    cells = here.select("t", "root", *[F.coalesce(h, -F.col("key")).alias(h) for h in homes]).groupBy("t", *groups).agg(F.count("*").alias("m"))
    masks = F.explode(F.array(*[F.lit(mask) for mask in range(1 << len(groups))])).alias("mask")
    masked = cells.select("t", "m", masks, *groups).select("t", "m", "mask", *[F.when(F.col("mask").bitwiseAND(1 << n) != 0, F.col(g)).alias(g) for n, g in enumerate(groups)])
    sums = masked.groupBy("t", "mask", *groups).agg(F.sum("m").alias("m"))
    sign = F.when(F.bit_count("mask") % 2 == 0, 1).otherwise(-1)
    return sums.groupBy("t").agg(F.max(F.when(F.col("mask") == 0, F.col("m"))).alias("m"), (F.sum(sign * F.col("m") * F.col("m")) / 2).alias("open"))


def settled(held: DataFrame, lists: DataFrame, sets: DataFrame, roots: DataFrame | None, percent: int) -> tuple[DataFrame, DataFrame | None, dict[str, DataFrame]]:
    """Compares the sets of long lists list by list, until the pairs left to enumerate are few.

    In each round a set goes to that of its long lists in which most pairs are open, its home
    of the round; the sets of a home are compared with each other in blocks, those of one
    component aside. Two sets with a home in common needn't meet again. ``lists`` holds (t, m,
    open) of each list. Returns those (t) still open, the components and the homes of sets by name.
    """
    short, long = (lists.where(F.col("m") <= LONG_LIST).select("t"), lists.where(F.col("m") > LONG_LIST))
    homes, last, postings = {}, float("inf"), lists.agg(F.sum("m")).head()[0] or 0
    while True:
        total = float(long.agg(F.sum("open")).head()[0] or 0)
        if total <= PAIRS_PER_POSTING * postings or total > LEFT_BY_ROUND * last or len(homes) == MOST_HOMES:
            return short.union(long.select("t")), roots, homes
        last, home = total, f"home{len(homes)}"
        here = _postings(held, roots, homes).join(long.select("t", "open"), "t")
        chosen = materialize(here.groupBy("key").agg(F.max_by("t", F.struct("open", "t")).alias(home), F.first("root").alias("root"), F.first("n").alias("n")), "homes")
        pairs = dealt_to_blocks(chosen, home, BLOCK_SETS).join(sets.select("key", "tokens"), "key")
        roots = _merged(materialize(pairs.groupBy(home, "pair").applyInArrow(_compared(percent), "a long, b long"), "links"), roots)
        homes[home] = chosen.select("key", home)
        here = _postings(held, roots, homes).join(long.select("t"), "t")
        long = materialize(_open_pairs(here, list(homes)).where("open > 0"), "open")


def connected(sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) for each representative that is similar to another: root is the smallest that links reach.

    First each list of a token's documents is held against one leader, which finds the
    linear core of a large group; where that leaves much, the sets of long lists are compared
    in blocks, list by list; then only pairs of different components are left. Those
    must share as many tokens as the shorter of their two prefixes asks for; and the tokens
    shared within both prefixes, with all that may follow in the longer rest, must reach the
    overlap that their sizes ask for. Rounds keep components, and read postings from the sets,
    a row each.
    """
    postings = sets.select("key", "n", "shared", (F.ceil(F.col("n") * percent / F.lit(100)).cast("long")).alias("alpha"), F.explode("postings").alias("p")).select("key", "n", "shared", "alpha", (F.col("alpha") - F.col("shared")).alias("rest"), F.col("p.t").alias("t"), F.col("p.pos").alias("pos"))
    # needed for a posting to count when k tokens are asked for
    postings = postings.withColumn("level", F.greatest(F.lit(1), F.col("pos") - (F.col("n") - F.col("alpha")) + 1))
    lists = postings.groupBy("t").agg(F.count("*").alias("m"), F.min("n").alias("n0")).where("m > 1").select("t", "n0")
    held = postings.join(lists, "t").groupBy("key", "n", "shared", "rest").agg(F.min("pos").alias("first"), F.collect_list(F.struct("t", "pos", "level", "n0")).alias("p"))
    # what stands before a set's first shared token can't be common, which bounds its partners' sizes
    held = held.withColumn("most", F.floor(((F.col("n") - F.col("first")) * (100 + percent)) / F.lit(percent)) - F.col("n")).where("100 * most >= n * " + str(percent)).drop("first")
    held = materialize(held.withColumn("p", F.expr("transform(filter(p, x -> x.n0 <= most), x -> struct(x.t AS t, x.pos AS pos, x.level AS level))")), "postings")

    roots, lists, last, before = None, None, float("inf"), None
    while True:
        here = _postings(held, roots, {})
        by_root = here.groupBy("t", "root").agg(F.count("*").alias("m"), F.min(F.struct("key", "n")).alias("first"))
        # the leaders go up from component to component
        by_root = by_root.withColumn("last", F.lit(None).cast("long")) if lists is None else by_root.join(lists.select("t", F.coalesce("leader.root", "last").alias("last")), "t")
        leader = F.min(F.when(F.col("last").isNull() | (F.col("root") > F.col("last")), F.struct("root", "first"))).alias("leader")
        own = F.sum(F.col("m") * F.col("m"))
        with Scratch() as of_round:
            lists = materialize(by_root.groupBy("t").agg(F.sum("m").alias("m"), own.alias("own"), F.first("last").alias("last"), leader).withColumn("open", (F.col("m") * F.col("m") - F.col("own")) / 2).where("open > 0"), "lists")
        if before is not None:
            before.drop()
        before = of_round
        m = lists.agg(F.sum("m"), F.sum("open")).head()
        if not m[0] or m[1] <= PAIRS_PER_POSTING * m[0] or float(m[1]) > LEFT_BY_ROUND * last:
            break
        last = float(m[1])
        leaders = lists.where("leader IS NOT NULL").select("t", F.col("leader.root").alias("last"), F.col("leader.first.key").alias("b"), F.col("leader.first.n").alias("nb"))
        if leaders.isEmpty():
            break
        pairs = here.join(leaders, "t").where((F.col("root") != F.col("last")) & _similar_sizes("n", "nb", percent)).select(F.col("key").alias("a"), "b").distinct()
        roots = _merged(materialize(verified(pairs, sets, percent).select("a", "b"), "links"), roots)

    still, roots, homes = settled(held, lists, sets, roots, percent)
    here = _postings(held, roots, homes).join(still, "t")
    columns = ["key", "n", "shared", "rest", "pos", "level", "most", "root", *homes]
    x, y = (here.select("t", *[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in "ab")
    k = F.least("shared_a", "shared_b")
    apart = (F.col("key_a") < F.col("key_b")) & (F.col("root_a") != F.col("root_b"))
    for home in homes:
        apart &= F.coalesce(F.col(f"{home}_a") != F.col(f"{home}_b"), F.lit(True))
    overlap = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    # beside a common token two sets share at most what stands before and behind it in both
    reach = F.least("pos_a", "pos_b") + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    near = apart & _similar_sizes("n_a", "n_b", percent) & (F.col("n_b") <= F.col("most_a")) & (F.col("n_a") <= F.col("most_b")) & (reach >= overlap)
    met = x.join(y, "t").where(near)
    counted = F.count_if((F.col("level_a") <= k) & (F.col("level_b") <= k)).alias("met")
    pairs = met.groupBy(F.col("key_a").alias("a"), F.col("key_b").alias("b")).agg(
        counted, F.count("*").alias("all"), F.min(k).alias("k"), F.min(overlap - F.greatest("rest_a", "rest_b")).alias("least")
    ).where("met >= k AND all >= least").select("a", "b")
    return _merged(materialize(verified(pairs, sets, percent).select("a", "b"), "links"), roots)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, keep: list[str] | None = None) -> DataFrame:
    """Groups documents that links of similar shingle sets connect.

    Words are runs outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; a document's set holds its
    distinct ``width``-word shingles, or its whole word sequence when it has fewer words. Two
    documents link when 100 * intersection >= ``percent`` * union.

    Returns a row per row of the input: the id, ``n_shingles``, ``component_id`` (the smallest
    id reachable by links, its own included; null if no row of the group has an id) and
    ``stays`` (true for one row of each group, one with that id). Null, empty and blank texts
    have no shingles, link with nothing and stay. Equal sets form one class and are joined
    once, so copies aren't paired. Repeated rows are rows of one group. Other columns are not
    carried but those named in ``keep``, as a struct ``row``.
    """
    own = Scratch()
    with own:
        with Scratch() as whole:
            sets = shingle_sets(docs, id_col, text_col, width, percent, keep)
        row = ["row"] if keep else []
        slim = materialize(sets.select("key", "id", "n", "h1", "h2", *row), "slim")
        classes = slim.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("key").alias("rep"))
        reps = materialize(sets.where("tokens IS NOT NULL").join(classes.select(F.col("rep").alias("key")), "key", "left_semi"), "classes")
        whole.drop()
        roots = connected(reps, percent)
        classes = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("n", "h1", "h2", F.coalesce("root", "rep").alias("root"))
        rows = slim.join(classes, ["n", "h1", "h2"], "left").select("key", "id", "n", F.coalesce("root", "key").alias("root"), *row)
        rows = materialize(rows, "rows", outlives=True)
    own.drop()
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("f")).select("root", F.col("f.id").alias("component_id"), F.col("f.key").alias("first"))
    return rows.join(first, "root").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("key") == F.col("first")).alias("stays"), *row)
