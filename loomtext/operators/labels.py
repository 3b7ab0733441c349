"""Cluster labelling by normalised mutual information and centroid distance (AG15-AG17, LB1-LB5).

The reference loops term x question x cluster; here the 2x2 contingency table of every
(cluster, term) comes from one count of n11 plus three marginal counts, the rest by
subtraction, and NMI is pure column arithmetic.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.session import broadcast_if_small, cut_lineage, cut_round

TOP_LABELS = 5


def lemma_lists(questions: DataFrame, stop: DataFrame | None = None, id_col: str = "id",
                text_col: str = "question", keep: tuple[str, ...] = ()) -> DataFrame:
    """TXT14: (`keep`..., id, lems) upper-case keyword lemmas per question, stop words and punctuation
    removed, order kept (part-of-speech filter off: no tagger is available)."""
    toks = T.tokens(F.col(text_col))
    out = questions.select(*keep, F.col(id_col).alias("id"), F.transform(toks, lambda t: F.lower(t)).alias("l"))
    if stop is not None:
        out = T.without_words(out, "l", stop.select("lemma"))
    return out.select(*keep, "id", F.transform("l", lambda t: F.upper(t)).alias("lems"))


def gram_sets(lists: DataFrame, n: int) -> DataFrame:
    """TXT15 per question: distinct (id, gram)."""
    return lists.select("id", F.explode(T.ngrams(F.col("lems"), n)).alias("gram")).distinct()


def global_keywords(grams: DataFrame) -> DataFrame:
    """AG15: distinct upper-case n-grams of the corpus."""
    return grams.select("gram").distinct()


def global_keywords_of_lists(lists: DataFrame, *lengths: int) -> DataFrame:
    """AG15 of lists (.., lems) for all `lengths`: partial sets of grams are shuffled, no gram sets of single questions."""
    return global_keywords(lists.select(F.explode(F.concat(*(T.ngrams(F.col("lems"), n) for n in lengths))).alias("gram")))


def contingency(grams: DataFrame, membership: DataFrame) -> DataFrame:
    """AG17: (cluster_id, gram, n11, n1, nc, N) for every gram present in the cluster.
    membership is (id, cluster_id)."""
    N = membership.count()
    n11 = grams.join(membership, "id").groupBy("cluster_id", "gram").agg(F.count(F.lit(1)).alias("n11"))
    n1 = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n1"))
    nc = membership.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("nc"))
    return n11.join(n1, "gram").join(broadcast_if_small(nc), "cluster_id").withColumn("N", F.lit(N).cast("long"))


def contingency_of_rows(rows: DataFrame, *lengths: int) -> DataFrame:
    """AG17 of rows (id, cluster_id, lems), each a question and its cluster: (cluster_id, gram, n11, n1, nc, N) for the
    grams of all `lengths`, as `contingency` gives for their gram sets.

    A question whose id occurs once is counted where it is read, so that partial counts by cluster and gram are
    shuffled and no (id, gram) rows, and n1 is the sum of a gram's n11; only the rows of repeated ids are made distinct
    and joined by id."""
    N = rows.count()
    count = F.count(F.lit(1))
    grams = F.explode(F.concat(*(T.ngrams(F.col("lems"), n) for n in lengths))).alias("gram")  # words hold no space, so lengths do not mix
    nc = rows.groupBy("cluster_id").agg(count.alias("nc"))
    repeated = cut_lineage(rows.groupBy("id").agg(count.alias("n")).where((F.col("n") > 1) | F.col("id").isNull()).select(F.col("id").alias("_id")))
    if not repeated.limit(1).count():
        n11 = rows.select("cluster_id", grams).groupBy("cluster_id", "gram").agg(count.alias("n11")).withColumn("r", F.col("n11"))
    else:
        again, same = broadcast_if_small(repeated), F.col("id").eqNullSafe(F.col("_id"))
        once = rows.join(again, same, "left_anti").select("cluster_id", grams, F.lit(1).alias("n11"), F.lit(1).alias("r"))
        more = cut_lineage(rows.join(again, same, "left_semi").select("id", "cluster_id", "lems"))
        sets = cut_lineage(more.select("id", grams).distinct())
        inside = sets.join(more.select("id", "cluster_id"), "id").select("cluster_id", "gram", F.lit(1).alias("n11"), F.lit(0).alias("r"))
        # an id counts once for n1, whatever its clusters: rows beside the clusters' own, told apart by n11 = 0
        each = sets.select(F.lit(None).cast(rows.schema["cluster_id"].dataType).alias("cluster_id"), "gram", F.lit(0).alias("n11"), F.lit(1).alias("r"))
        n11 = once.unionByName(inside).unionByName(each).groupBy("cluster_id", "gram").agg(
            F.sum("n11").cast("long").alias("n11"), F.sum("r").cast("long").alias("r"))
    both = n11.withColumn("n1", F.sum("r").over(Window.partitionBy("gram"))).drop("r")  # a row a cluster
    return both.join(broadcast_if_small(nc), "cluster_id").where("n11 > 0").select(
        "cluster_id", "gram", "n11", "n1", "nc", F.lit(N).cast("long").alias("N"))


def _plogp(p):
    return F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))


def nmi(cont: DataFrame) -> DataFrame:
    """LB1 (A-11): adds `nmi`; negative when the term is rarer in the cluster than expected."""
    N = F.col("N").cast("double")
    p11 = F.col("n11") / N
    p10 = (F.col("n1") - F.col("n11")) / N
    p01 = (F.col("nc") - F.col("n11")) / N
    p00 = (F.col("N") - F.col("n1") - F.col("nc") + F.col("n11")) / N
    pt1, pt0 = F.col("n1") / N, 1 - F.col("n1") / N
    pu1, pu0 = F.col("nc") / N, 1 - F.col("nc") / N

    def term(pxy, px, py):
        return F.when(pxy > 0, pxy * F.log2(pxy / (px * py))).otherwise(F.lit(0.0))

    info = term(p00, pt0, pu0) + term(p01, pt0, pu1) + term(p10, pt1, pu0) + term(p11, pt1, pu1)
    h = -(_plogp(pt0) + _plogp(pt1)) - (_plogp(pu0) + _plogp(pu1))
    v = F.when((info != 0) & (h != 0), 2 * info / h).otherwise(F.lit(0.0))
    size = F.col("nc_true") if "nc_true" in cont.columns else F.col("nc")
    sign = F.when(F.col("n11") / F.col("n1") < size / N, F.lit(-1.0)).otherwise(F.lit(1.0))
    return cont.withColumn("nmi", F.when(F.col("n11") > 0, v * sign).otherwise(F.lit(0.0)))


# ---------------------------------------------------------------- sentence encoder (SRC7 default)

def mean_word_vector(words_col, dims: int = 16):
    """Default encoder: mean of deterministic md5 word vectors (lower-case words); a narrow
    per-row expression (array aggregate), zero vector for an empty text."""
    zero = F.array_repeat(F.lit(0.0), dims)
    # one md5 per word as 16 characters, then the code of each (the characters are a lambda argument, so the hash is
    # not recomputed per dimension)
    chars = F.transform(words_col, lambda w: F.decode(F.unhex(F.md5(w)), "ISO-8859-1"))
    vecs = F.transform(chars, lambda s: F.array(*[F.ascii(F.substring(s, 1 + i, 1)) / 255.0 - 0.5 for i in range(dims)]))
    summed = F.aggregate(vecs, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    n = F.greatest(F.size(words_col), F.lit(1)).cast("double")
    return F.zip_with(summed, F.array_repeat(n, dims), lambda a, m: a / m)


def _word_vectors(texts: pa.Array, dims: int) -> np.ndarray:
    """`mean_word_vector` of the blank-separated words of every text, for functions over Arrow batches."""
    lists = pc.split_pattern(texts, " ")
    coded, at = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
    table = np.full((max(len(coded.dictionary), 1), max(dims, 16)), np.nan)
    for i, w in enumerate(coded.dictionary.to_pylist()):
        table[i, :16] = np.frombuffer(hashlib.md5(w.encode()).digest(), np.uint8) / 255.0 - 0.5
    codes, n = coded.indices.to_numpy(), np.diff(at)
    out = np.zeros((len(texts), dims))
    for k in range(int(n.max(initial=0))):  # in order of the words, as the expression adds them
        more = np.flatnonzero(n > k)
        out[more] += table[codes[at[more] + k], :dims]
    return out / np.maximum(n, 1)[:, None]


def centroids(points: DataFrame, key: str = "cluster_id", vec: str = "vec") -> DataFrame:
    """AG10: mean vector per key (partial/final aggregation per (key, dim))."""
    d = points.select(key, F.posexplode(vec).alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("x"))
    return d.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("s")) \
        .select(key, F.transform("s", lambda e: e["x"]).alias("centroid"))


def best_label_combination(scores: DataFrame) -> DataFrame:
    """LB4 (A-12): (cluster_id, labels ARRAY<STRING>) from the four best labels per cluster
    (`rank` 1..4); missing labels are dropped from the result."""
    p = scores.groupBy("cluster_id").agg(*[
        F.max(F.when(F.col("rank") == i, F.col("label"))).alias(f"L{i}") for i in range(1, 5)])
    L = [F.col(f"L{i}") for i in range(1, 5)]
    g = [T.label_type(x) for x in L]

    def inn(a, b):  # substring test "a in b"
        return F.instr(b, a) > 0

    def arr(*xs):
        return F.array(*xs)

    def minus(base, drop):
        return F.filter(base, lambda x: ~F.array_contains(drop, x))

    in4 = F.filter(arr(L[0], L[1], L[2]), lambda x: F.instr(L[3], x) > 0)
    in3 = F.filter(arr(L[0], L[1]), lambda x: F.instr(L[2], x) > 0)
    case1 = (F.when(~inn(L[0], L[1]), arr(L[0], L[1]))
             .when(g[2] == 2, arr(L[1], L[2]))
             .when(~inn(L[2], L[1]), arr(L[1], L[2]))
             .otherwise(arr(L[1], L[3])))
    case2 = (F.when((g[2] == 1) & (g[3] == 1), arr(L[0], L[1]))
             .when((g[2] == 1) & (F.size(in4) == 0), arr(L[0], L[1]))
             .when(g[2] == 1, minus(arr(L[0], L[1], L[2], L[3]), in4))
             .when(F.size(in3) == 0, arr(L[0], L[1]))
             .when(F.size(in3) == 1, minus(arr(L[0], L[1], L[2]), in3))
             .otherwise(arr(L[2], L[3])))
    case3 = (F.when(~inn(L[1], L[0]), arr(L[0], L[1]))
             .when(g[2] == 2, arr(L[0], L[2]))
             .when(~inn(L[2], L[0]), arr(L[0], L[2]))
             .otherwise(arr(L[0], L[3])))
    res = (F.when((g[0] == 1) & (g[1] == 2), case1)
           .when((g[0] == 1) & (g[1] == 1), case2)
           .when((g[0] == 2) & (g[1] == 1), case3)
           .otherwise(arr(L[0], L[1])))
    return p.select("cluster_id", F.filter(res, lambda x: x.isNotNull()).alias("labels"))


# ---------------------------------------------------------------- many corpora at once (LB5)

def gramset_membership(grams: DataFrame, membership: DataFrame) -> DataFrame:
    """SO6 (Appendix B-14): a question counts as inside a cluster when its n-gram set equals the
    set of any member of that cluster (so equal, also empty, sets elsewhere count as inside).
    Returns the many-to-many (corpus, id, cluster_id)."""
    keys = membership.select("corpus", "id").join(
        grams.groupBy("corpus", "id").agg(F.array_sort(F.collect_set("gram")).alias("k")), ["corpus", "id"], "left") \
        .select("corpus", "id", F.coalesce("k", F.array().cast("array<string>")).alias("k"))
    ckeys = membership.join(keys, ["corpus", "id"]).select("corpus", "cluster_id", "k").distinct()
    return keys.join(ckeys, ["corpus", "k"]).select("corpus", "id", "cluster_id")


def contingency_by_corpus(grams: DataFrame, membership: DataFrame, match_by_gramset: bool = False) -> DataFrame:
    """AG17 per corpus: grams (corpus, id, gram), membership (corpus, id, cluster_id) ->
    (corpus, cluster_id, gram, n11, n1, nc, nc_true, N).  With `match_by_gramset` the
    cluster indicator follows SO6; the sign rule keeps the true cluster size (nc_true)."""
    N = membership.groupBy("corpus").agg(F.count(F.lit(1)).alias("N"))
    inside = gramset_membership(grams, membership) if match_by_gramset else membership
    n11 = grams.join(inside, ["corpus", "id"]).groupBy("corpus", "cluster_id", "gram").agg(
        F.count(F.lit(1)).alias("n11"))
    n1 = grams.groupBy("corpus", "gram").agg(F.count(F.lit(1)).alias("n1"))
    nc = inside.groupBy("corpus", "cluster_id").agg(F.count(F.lit(1)).alias("nc"))
    nct = membership.groupBy("corpus", "cluster_id").agg(F.count(F.lit(1)).alias("nc_true"))
    # the sizes are joined first: a row a cluster, so that the rows of all grams are shuffled for them once
    sizes = nc.join(nct, ["corpus", "cluster_id"]).join(N, "corpus")
    return n11.join(n1, ["corpus", "gram"]).join(sizes, ["corpus", "cluster_id"])


#: Words whose n-grams a task counts at once; a longer text is taken whole.
COUNTED_WORDS = 1 << 18


def _grams_counted(clusters: pa.Array, words: pa.Array, lengths: tuple[int, ...]) -> list[pa.Array]:
    """Columns cluster (index into `clusters`' rows, the first row of that cluster), gram, n: how many rows of a
    cluster have the gram."""
    lists = pc.split_pattern(words, " ")
    at, flat = lists.offsets.to_numpy(), lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(at))
    grams, rows = [], []
    for n in lengths:
        many = max(len(flat) - n + 1, 0)
        inside = row[:many] == row[len(row) - many:]  # the last word is of the same row
        g = pc.binary_join_element_wise(*(flat.slice(k, many) for k in range(n)), " ") if n > 1 else flat
        grams.append(g.filter(pa.array(inside)))
        rows.append(row[:many][inside])
    coded = pa.concat_arrays(grams).dictionary_encode()
    size = max(len(coded.dictionary), 1)
    each = np.unique(np.concatenate(rows) * size + coded.indices.to_numpy())  # a gram counts once in a row
    codes = clusters.dictionary_encode(null_encoding="encode").indices.to_numpy()
    _, first = np.unique(codes, return_index=True)
    key, n = np.unique(first[codes[each // size]] * size + each % size, return_counts=True)
    return [pa.array(key // size), coded.dictionary.take(pa.array(key % size)), pa.array(n, pa.int64())]


def contingency_of_lists(lists: DataFrame, membership: DataFrame, *lengths: int) -> DataFrame:
    """`contingency_by_corpus` of the gram sets of lists (corpus, id, lems) for all `lengths`, without (id, gram) rows:
    (corpus, cluster_id, gram, n11, n1, nc, nc_true, N), and a row with a null cluster for grams that no cluster has.

    Grams of a question are counted in the task that reads it and its cluster, and only counts by corpus, gram and
    cluster are shuffled; questions or memberships whose key occurs more than once are made distinct first."""
    key = ["corpus", "id"]
    count = F.count(F.lit(1))
    rows = lists.select(*key, F.array_join("lems", " ").alias("words"))  # no word holds a blank
    members = membership.select(*key, "cluster_id")
    repeated = rows.select(*key, F.lit(1).alias("q"), F.lit(0).alias("m")).unionByName(
        members.select(*key, F.lit(0).alias("q"), F.lit(1).alias("m"))).groupBy(*key).agg(F.sum("q").alias("q"), F.sum("m").alias("m"))
    repeated = cut_lineage(repeated.where("q > 1 or (q = 1 and m > 1)").select(F.col("corpus").alias("_c"), F.col("id").alias("_i")))
    types = {**{f.name: f.dataType.simpleString() for f in membership.schema.fields}, "corpus": lists.schema["corpus"].dataType.simpleString()}

    def counted(batches):
        for batch in batches:
            name, cluster, words = batch.column("corpus"), batch.column("cluster_id"), batch.column("words")
            owner = name.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
            kind = cluster.dictionary_encode(null_encoding="encode").indices.to_numpy()
            pair = pa.array(owner * (kind.max(initial=0) + 1) + kind)
            total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.count_substring(words, " "), 0).to_numpy(zero_copy_only=False) + 1)])
            lo = 0
            while lo < len(words):
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + COUNTED_WORDS, "right")) - 1)
                at, gram, n = _grams_counted(pair.slice(lo, hi - lo), words.slice(lo, hi - lo), lengths)
                yield pa.RecordBatch.from_arrays([name.slice(lo).take(at), cluster.slice(lo).take(at), gram, n, n], names=["corpus", "cluster_id", "gram", "n11", "r"])
                lo = hi

    shape = f"corpus {types['corpus']}, cluster_id {types['cluster_id']}, gram string, n11 long, r long"
    some, once, alone = bool(repeated.limit(1).count()), rows, members
    if some:
        again, same = broadcast_if_small(repeated), F.col("corpus").eqNullSafe(F.col("_c")) & F.col("id").eqNullSafe(F.col("_i"))
        once, alone = rows.join(again, same, "left_anti"), members.join(again, same, "left_anti")
    words = F.when(F.length("words") > 0, F.col("words"))  # a question without a word has no gram
    parts = once.join(alone, key, "left").withColumn("words", words).where("words is not null").select(
        "corpus", "cluster_id", "words").mapInArrow(counted, shape)
    if some:
        more = lists.join(again, same, "left_semi")
        sets = cut_round(more.select(*key, F.explode(F.concat(*(T.ngrams(F.col("lems"), n) for n in lengths))).alias("gram")).distinct())
        many = members.join(again, same, "left_semi").groupBy(*key, "cluster_id").agg(count.alias("n11"))
        inside = sets.join(many, key).select("corpus", "cluster_id", "gram", "n11", F.lit(0).cast("long").alias("r"))
        # an id counts once for n1, whatever its clusters: rows beside the clusters' own
        each = sets.select("corpus", F.lit(None).cast(types["cluster_id"]).alias("cluster_id"), "gram",
                           F.lit(0).cast("long").alias("n11"), F.lit(1).cast("long").alias("r"))
        parts = parts.unionByName(inside).unionByName(each)
    counts = parts.repartition("corpus", "gram").groupBy("corpus", "cluster_id", "gram").agg(F.sum("n11").alias("n11"), F.sum("r").alias("r"))
    both = counts.withColumn("n1", F.sum("r").over(Window.partitionBy("corpus", "gram"))).drop("r")
    nc = members.groupBy("corpus", "cluster_id").agg(count.alias("nc"))
    sizes = broadcast_if_small(cut_lineage(nc.withColumn("N", F.sum("nc").over(Window.partitionBy("corpus")))))
    return both.join(sizes, ["corpus", "cluster_id"], "left").select(
        "corpus", "cluster_id", "gram", "n11", "n1", "nc", F.col("nc").alias("nc_true"), "N")


TERM_BLOCK, CLUSTER_BLOCK = 4096, 512


def _groups(batches, keys: int):
    """Whole groups of sorted Arrow batches: lists of columns with the rows of one value of the first `keys` columns."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        t = t.combine_chunks()
        new = np.zeros(max(len(t) - 1, 0), bool)
        for k in range(keys):
            code = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
            new |= code[1:] != code[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1)]
        for lo, hi in zip(cuts, cuts[1:]):
            yield t.slice(lo, hi - lo)
        rest = t.slice(cuts[-1])
    if rest is not None:
        yield rest


def label_scores_by_corpus(nmi_table: DataFrame, terms: DataFrame | None, cents: DataFrame, top: int = TOP_LABELS,
                           dims: int = 16) -> DataFrame:
    """LB2 + LB3 per corpus: terms (corpus, gram, vec), cents (corpus, cluster_id, centroid),
    nmi_table (corpus, cluster_id, gram, nmi) -> (corpus, gram_type, cluster_id, label, score, rank).
    Grams of one word and of more are scored each on their own (WN3).  Without `terms` they are all grams of
    `nmi_table`, also those of a null cluster, with their default word vectors in `dims` dimensions.

    Blocks of about TERM_BLOCK rows of terms and CLUSTER_BLOCK centroids of a corpus meet in one task each (rows sorted
    by block, a block at a time), so neither the driver nor a task holds a corpus's centroids or terms.  Where a
    corpus has several blocks of terms, a first pass finds each cluster's nearest term and largest nmi; the scores
    need these.  Only the best `top` of a block leave it, ties by gram."""
    hashed = lambda key, rows: F.pmod(F.xxhash64(key), rows).cast("int")
    kinds, cid_type = ["corpus", "gram_type"], cents.schema["cluster_id"].dataType.simpleString()
    low = F.when(F.col("gram").rlike("[^\\x00-\\x7f]"), F.lower("gram"))  # ASCII is put in lower case where it is used
    plain = terms is None
    entries = nmi_table.select("corpus", "gram", low.alias("low") if plain else F.lit(None).cast("string").alias("low"),
                               F.lit(None).cast("array<double>").alias("vec"), "cluster_id", "nmi")
    if not plain:
        entries = entries.unionByName(terms.select("corpus", "gram", F.col("vec").cast("array<double>").alias("vec")), allowMissingColumns=True)
    entries = entries.withColumn("gram_type", T.label_type(F.col("gram")))
    blocks = lambda n, size: F.ceil(F.col(n) / F.lit(size)).cast("int")
    held = cents.groupBy("corpus").agg(F.count(F.lit(1)).alias("cs"))
    n = cut_lineage(entries.groupBy(*kinds).agg(F.count(F.lit(1)).alias("ts")).join(held, "corpus").select(
        *kinds, blocks("ts", TERM_BLOCK).alias("tbs"), blocks("cs", CLUSTER_BLOCK).alias("cbs")))
    known = broadcast_if_small(n)
    to_all = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    keys = [*kinds, "tb", "cb"]
    ours = entries.join(known, kinds).withColumn("tb", hashed("gram", F.col("tbs"))).withColumn("cb", to_all("cbs"))
    clusters = cents.where(F.col("cluster_id").isNotNull()).join(known, "corpus").withColumn(
        "cb", hashed("cluster_id", F.col("cbs"))).withColumn("tb", to_all("tbs"))
    cor_type = cents.schema["corpus"].dataType.simpleString()

    def matrix(column, width: int) -> np.ndarray:
        out = column.combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0)
        return out.reshape(len(column), width).astype(float)

    def read(batches):
        """Blocks as (key, clusters, distances, terms, term and cluster and nmi of the entries, stated dmin and mx)."""
        for t in _groups(batches, len(keys)):
            first = int(pc.sum(pc.is_valid(t.column("centroid"))).as_py())  # the centroids come first
            c, t = t.slice(0, first), t.slice(first)
            if not first or not len(t):
                continue
            gram = t.column("gram").combine_chunks().dictionary_encode()
            order = pc.array_sort_indices(gram.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            term = place[gram.indices.to_numpy()]
            labels = gram.dictionary.take(pa.array(order))
            at = np.empty(len(labels), np.int64)
            if plain:
                at[term] = np.arange(len(t))
                given = t.column("low").combine_chunks().take(pa.array(at))
                vecs = _word_vectors(pc.if_else(pc.is_valid(given), given, pc.ascii_lower(labels)), dims)
                width = dims
            else:
                own = np.flatnonzero(t.column("vec").is_valid().to_numpy())
                if not len(own):
                    continue
                vec = t.column("vec").take(pa.array(own))
                width = len(vec[0].as_py())
                scored = np.unique(term[own])  # grams that are terms
                place = np.full(len(labels), -1)
                place[scored] = np.arange(len(scored))
                vecs = np.empty((len(scored), width))
                vecs[place[term[own]]] = matrix(vec, width)
                labels, term = labels.take(pa.array(scored)), place[term]
            cids = c.column("cluster_id").combine_chunks()
            mine = pc.index_in(t.column("cluster_id").combine_chunks(), value_set=cids)
            mine = pc.fill_null(mine, -1).to_numpy(zero_copy_only=False)
            nmi_ = pc.fill_null(t.column("nmi").combine_chunks(), 0.0).to_numpy(zero_copy_only=False)
            D = _distances(matrix(c.column("centroid"), width), vecs)
            # entries of the clusters of this block; one whose gram is no term counts for the largest nmi alone
            inside = (mine >= 0) & t.column("nmi").is_valid().to_numpy()
            mx = np.full(first, -np.inf)
            np.maximum.at(mx, mine[inside], nmi_[inside])
            inside &= term >= 0
            yield c, cids, D, labels, (term[inside], mine[inside], nmi_[inside]), mx

    def nearest(batches):
        for c, cids, D, _, _, mx in read(batches):
            yield pa.RecordBatch.from_arrays([*(c.column(k).combine_chunks() for k in kinds), cids, pa.array(D.min(axis=1)),
                                              pa.array(mx, mask=~np.isfinite(mx))], names=[*kinds, "cluster_id", "dmin", "mx"])

    def scores(batches):
        for c, cids, D, labels, (term, mine, value), mx in read(batches):
            dmin = D.min(axis=1)
            if c.column("tbs")[0].as_py() > 1:
                dmin, mx = (c.column(k).to_numpy().astype(float) for k in ("dmin", "mx"))
            sc = 0.5 * np.maximum(np.where(np.isfinite(mx), mx, 0.0), 0.0) * dmin
            S = np.where(D > 0, sc[:, None] / np.where(D > 0, D, 1.0), sc[:, None])
            np.add.at(S, (mine, term), value)
            best = np.argsort(-np.round(S, 12), axis=1, kind="stable")[:, :top]  # columns are in order of gram
            rows = pa.array(np.repeat(np.arange(len(cids)), best.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [*(c.column(k).combine_chunks().take(rows) for k in kinds), cids.take(rows), labels.take(pa.array(best.ravel())),
                 pa.array(S[rows.to_numpy(), best.ravel()])], names=[*kinds, "cluster_id", "label", "score"])

    def met(t, c):
        both = c.select(*keys, "tbs", "cluster_id", "centroid", "dmin", "mx").unionByName(
            t.select(*keys, "gram", "low", "vec", "cluster_id", "nmi"), allowMissingColumns=True)
        return both.repartition(*keys).sortWithinPartitions(*keys, F.col("centroid").isNull()).select(
            *keys, "tbs", "cluster_id", "centroid", "dmin", "mx", "gram", "low", "vec", "nmi")

    none = clusters.withColumn("dmin", F.lit(None).cast("double")).withColumn("mx", F.lit(None).cast("double"))
    shape = f"corpus {cor_type}, gram_type int, cluster_id {cid_type}"
    if n.where("tbs > 1").limit(1).count():
        found = met(ours.where("tbs > 1"), none.where("tbs > 1")).mapInArrow(nearest, f"{shape}, dmin double, mx double")
        found = cut_lineage(found.groupBy(*kinds, "cluster_id").agg(F.min("dmin").alias("dmin"), F.max("mx").alias("mx")))
        none = clusters.join(broadcast_if_small(found), [*kinds, "cluster_id"], "left")
    cand = met(ours, none).mapInArrow(scores, f"{shape}, label string, score double")
    w = Window.partitionBy("corpus", "gram_type", "cluster_id").orderBy(F.round("score", 12).desc(), F.col("label"))
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _distances(C: np.ndarray, V: np.ndarray) -> np.ndarray:
    """Euclidean distances clusters x terms, a dimension at a time (exact zeros for equal vectors)."""
    d2 = np.zeros((len(C), len(V)))
    for i in range(C.shape[1]):
        d2 += (C[:, i, None] - V[None, :, i]) ** 2
    return np.sqrt(d2)


def label_scores(questions: DataFrame, membership: DataFrame, qvec: DataFrame, stop: DataFrame | None = None,
                 dims: int = 16, encoder=None, top: int = TOP_LABELS) -> DataFrame:
    """LB2 + LB3 for 1-grams and 2-grams, each length on its own (WN3): (corpus, cluster_id, gram_type, label, score,
    rank up to `top`).  Arguments as `cluster_labels`."""
    ll = lemma_lists(questions, stop, keep=("corpus",))
    cents = cut_round(centroids(membership.join(qvec, ["corpus", "id"]).withColumn(
        "ck", F.struct("corpus", "cluster_id")), key="ck", vec="vec")
        .select(F.col("ck.corpus").alias("corpus"), F.col("ck.cluster_id").alias("cluster_id"), "centroid"))
    nm = cut_round(nmi(contingency_of_lists(ll, membership, 1, 2)).select("corpus", "cluster_id", "gram", "nmi"))
    terms = None
    if encoder is not None:
        terms = nm.select("corpus", "gram").distinct().withColumn("vec", encoder(F.lower("gram")))
    return label_scores_by_corpus(nm, terms, cents, top, dims).select("corpus", "cluster_id", "gram_type", "label", "score", "rank")


def cluster_labels(questions: DataFrame, membership: DataFrame, qvec: DataFrame, stop: DataFrame | None = None,
                   dims: int = 16, encoder=None) -> DataFrame:
    """LB5: (corpus, cluster_id, labels ARRAY<STRING>) from 1-gram and 2-gram label scores
    (top 5 each), merged and re-sorted (WN4), then the label rule (LB4) on the best four.
    questions (corpus, id, question); membership (corpus, id, cluster_id); qvec (corpus, id, vec).
    An id belongs to its corpus: the same id may occur in several.  Terms are embedded by `encoder` (a
    Column function over text) or by the default word vectors in `dims` dimensions."""
    w = Window.partitionBy("corpus", "cluster_id").orderBy(F.round("score", 12).desc(), F.col("label"))
    top4 = label_scores(questions, membership, qvec, stop, dims, encoder).withColumn("rank", F.row_number().over(w)) \
        .where(F.col("rank") <= 4).withColumn("cluster_id", F.struct("corpus", "cluster_id"))
    lab = best_label_combination(top4)
    return lab.select(F.col("cluster_id.corpus").alias("corpus"), F.col("cluster_id.cluster_id").alias("cluster_id"), "labels")
