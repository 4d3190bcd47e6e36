"""Operator 1: near-duplicates by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lading.llm.chunks import binary_rows, lists, mixed, n_parts, pack, stage_tokens, unpack
from lading.llm.common import components, fresh, joined, release, scratch, ship, staged

#: Of a shingle's hash, these bits tell it apart within a part; parts multiply with the input and so do the pairs of them.
PART_BITS = 40
#: Up to so many texts of a bucket are compared with each other; in larger ones each is compared with a hub, then within
#: parts of the bucket, and what that does not join is finished over rare shingles.
SMALL_BUCKET = 6
#: A sketch holds 4 bits of each sample in words of 64. Where fewer than this share of samples agree in them, two texts are
#: not alike: at a similarity of 0.8, of 48 samples 39 agree on average with a deviation of 2.7.
LEAST_AGREEING = 7 / 12
NIBBLES = 0x1111111111111111


def shingles(tokens: np.ndarray, lens: np.ndarray, vocab: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words and the document of each; a text of fewer words, but not none, is one shingle."""
    word = mixed(vocab.view(np.uint64))[tokens]
    n = len(word)
    ends = np.cumsum(lens)
    begins = ends - lens
    doc = np.repeat(np.arange(len(lens)), lens)
    hashes = np.zeros(n, np.uint64)
    for j in range(width):
        # words beyond the end of a text count as none
        at = np.arange(n) + j
        inside = at < ends[doc]
        hashes = mixed(hashes * np.uint64(3) + np.where(inside, word[np.minimum(at, max(0, n - 1))], np.uint64(1)) + np.uint64(j))
    whole = (np.arange(n) + width <= ends[doc]) | (np.arange(n) == begins[doc])
    return hashes[whole], doc[whole]


def _unique(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document with how often it has them, by document, then hash."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    return h[first], d[first], np.diff(np.append(first, len(h)))


def _keys(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and key of shingles, made one number: part << PART_BITS | key."""
    return (hashes >> np.uint64(PART_BITS)) % np.uint64(parts), hashes & np.uint64((1 << PART_BITS) - 1)


def _asked(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a chunk in the order in which they are asked for, where each shingle is among them, and where
    parts begin."""
    part, key = _keys(hashes, parts)
    both, where = np.unique(part << np.uint64(PART_BITS) | key, return_inverse=True)
    return both, where, np.searchsorted(both >> np.uint64(PART_BITS), np.arange(parts + 1))


def _document_counts(chunks: DataFrame, width: int, parts: int) -> DataFrame:
    """How many documents have each shingle of a chunk: ``chunk, level, part, blob``."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h, _, _ = _unique(*shingles(lists(b.column("tokens"), i), lists(b.column("lens"), i), lists(b.column("vocab"), i), width))
                both, where, ends = _asked(h, parts)
                n = np.bincount(where, minlength=len(both))
                key = both & np.uint64((1 << PART_BITS) - 1)
                chunk, rows = b.column("chunk")[i].as_py(), ([], [])
                for p in np.flatnonzero(np.diff(ends)):
                    at = slice(ends[p], ends[p + 1])
                    rows[0].append(p)
                    rows[1].append(pack(np.diff(key[at], prepend=np.uint64(0)), n[at]))  # rising keys as their steps
                yield binary_rows(part=rows[0], chunk=[chunk] * len(rows[0]), blob=rows[1])

    def answer(t: pa.Table) -> pa.Table:
        blobs = [unpack(x.as_py()) for x in t.column("blob")]
        keys = [np.cumsum(b[0].astype(np.uint64)) for b in blobs]
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, np.concatenate([b[1] for b in blobs]), len(every)).astype(np.int64)
        ends = np.cumsum([0, *map(len, keys)])
        replies = [pack(total[where[a:z]]) for a, z in zip(ends, ends[1:], strict=False)]
        return pa.table({"chunk": t.column("chunk"), "level": pa.array([1] * len(replies), pa.int32()), "part": t.column("part"), "blob": pa.array(replies, pa.binary())})

    asked = chunks.select("chunk", "lens", "vocab", "tokens").mapInArrow(ask, "part int, chunk long, blob binary")
    return staged(asked.groupBy("part").applyInArrow(answer, "chunk long, level int, part int, blob binary"), "shingle-counts")


def _weighted(chunk: pa.Table, replies: dict[int, bytes], width: int, parts: int, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, document, TF-IDF weight and number of documents. Weights are tf * (1 + log(N / df) / log(N + 1)): from one for a shingle that
    all documents have to two for one of a single document, so that many near copies don't make each other unlike."""
    h, d, tf = _unique(*shingles(lists(chunk.column("tokens"), 0), lists(chunk.column("lens"), 0), lists(chunk.column("vocab"), 0), width))
    both, where, ends = _asked(h, parts)
    df = np.zeros(len(both))
    for p in np.flatnonzero(np.diff(ends)):
        df[ends[p] : ends[p + 1]] = unpack(replies[int(p)])[0]
    return h, d, tf * (1 + np.log(documents / df[where]) / np.log(documents + 1)), df[where]


def rare_shingles(h: np.ndarray, w: np.ndarray, df: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A text's shingles from the rarest on, down to where those left weigh less than ``similarity`` of the text, and the
    weight from each on. What two texts share weighs ``similarity`` of either at least if they are alike, so that the
    shingles left cannot hold it all: alike texts share one of these. Those of a single document are left out."""
    order = np.lexsort((h, df))
    rest = np.cumsum(w[order][::-1], dtype=np.float64)[::-1]
    taken = (rest >= (similarity - 1e-4) * rest[0]) & (df[order] > 1) if len(h) else np.zeros(0, bool)
    return h[order][taken], rest[taken]


@lru_cache(1)
def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at 65536 even quantiles, and its logarithm: the r and log c of the sampling, drawn by 16 hash bits."""
    u = (np.arange(65536) + 0.5) / 65536
    x = np.linspace(0.0, 40.0, 400_001)
    quantile = np.interp(u, 1 - np.exp(-x) * (1 + x), x)
    quantile[u < 1e-4] = np.sqrt(2 * u[u < 1e-4])
    return quantile.astype(np.float32), np.log(quantile).astype(np.float32)


def _draw(short: np.ndarray, log_w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """t and log a of sample ``k`` for shingles given by 32 bits of their hash."""
    r_of, c_of = _gamma()
    x = short ^ np.uint32((0x9E3779B9 * (k + 1)) % (1 << 32))
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    r, log_c = r_of[x & np.uint32(0xFFFF)], c_of[x >> np.uint32(16)]
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    b = (x >> np.uint32(8)).astype(np.float32)
    b *= np.float32(1 / (1 << 24))
    t = np.floor(log_w / r + b)
    return t, log_c - r * (t - b + np.float32(1))


def samples(h: np.ndarray, starts: np.ndarray, weight: np.ndarray, count: int) -> np.ndarray:
    """``count`` consistent weighted samples of each document (its shingles from ``starts`` on): 32 bits of the pair of
    shingle and rounded log-weight whose a is least.

    t = floor(log w / r + b) and log a = log c - r (t - b + 1), with r, c ~ Gamma(2, 1) and b ~ U(0, 1) from the hash of
    shingle and sample number, so equal weights of a shingle always give an equal pair.
    """
    out = np.empty((count, len(starts)), np.uint32)
    if not len(starts):
        return out
    log_w = np.log(weight).astype(np.float32)
    short = ((h >> np.uint64(32)) ^ h).astype(np.uint32)
    lens = np.diff(starts, append=len(h))
    doc = np.repeat(np.arange(len(starts)), lens)
    log_a = np.empty(len(h), np.float32)
    step = 1 << 15  # what a step makes stays in a core's cache
    for k in range(count):
        for a in range(0, len(h), step):
            log_a[a : a + step] = _draw(short[a : a + step], log_w[a : a + step], k)[1]
        at = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, starts), lens))
        at = at[np.diff(doc[at], prepend=-1) > 0]  # of ties the first in the order of hashes
        t, _ = _draw(short[at], log_w[at], k)
        out[k] = (h[at] >> np.uint64(32)).astype(np.uint32) ^ (t.astype(np.int32).view(np.uint32) * np.uint32(2654435761))
    return out


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, bands: int = 12, rows: int = 4, id_col: str = "doc_id", text_col: str = "text", per_part: int = 1_500_000) -> DataFrame:
    """``doc_id, class_id, class_size, kept, row, mark`` per row of ``docs``: connected groups of texts whose TF-IDF shingle weights
    have a weighted Jaccard similarity of ``similarity`` or more; ``class_id`` is the least id of the group and its first
    row is kept.

    Texts of equal words are one text from the start. Texts that agree in the samples of a band meet in a bucket: those of
    a small bucket are all compared; in larger ones each is compared with a hub of the band, then, where groups are still
    apart, within parts of the bucket by further samples. Texts of larger buckets that are in different groups after that
    are compared wherever one of their rare shingles agrees, which holds for every pair at ``similarity`` (see
    ``rare_shingles``), so a large bucket loses no pair but those whose sketches differ (see ``LEAST_AGREEING``; a chance
    of 1e-4 at 0.8). With 12 bands of 4, a pair at 0.8 meets with a chance of 0.998. Similarities are then computed over all shingles.

    Nulls: null, empty and wordless texts are alike; a null id comes first and gives a null class. Repeated rows are copies.
    An empty table gives an empty result. Words are runs of letters, digits and non-ASCII, in lower case (A-Z).
    """
    with scratch(docs.sparkSession) as block:
        return block.result(_near_duplicates(docs, similarity, width, bands, rows, id_col, text_col, per_part), "near-duplicates")


def _near_duplicates(docs: DataFrame, similarity: float, width: int, bands: int, rows: int, id_col: str, text_col: str, per_part: int) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    chunks = stage_tokens(docs, id_col, text_col, alnum=True)
    tokens = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
    size, n_docs = chunks.agg(F.coalesce(F.sum(tokens), F.lit(0)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    parts = min(1 << (63 - PART_BITS), n_parts(int(size), per_part))
    replies = _document_counts(chunks, width, parts)
    release(spark)

    def sign(key: tuple, chunk: pa.Table, got: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("row", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("copy", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())))})
        by = dict(zip(got.column("part").to_pylist(), got.column("blob").to_pylist(), strict=True))
        h, d, w, _ = _weighted(chunk, by, width, parts, int(n_docs))
        ids, lens = chunk.column("ids")[0].as_py(), lists(chunk.column("lens"), 0)
        words = lists(chunk.column("vocab"), 0)[lists(chunk.column("tokens"), 0)]
        ends = np.cumsum(lens)
        copy = [xxhash.xxh3_128_digest(words[e - n : e].tobytes()) for e, n in zip(ends, lens, strict=True)]
        like: dict[bytes, int] = {}
        first_of = np.array([like.setdefault(c, i) for i, c in enumerate(copy)])
        once = (first_of == np.arange(len(copy)))[d]  # copies within a chunk are sampled once
        h, d, w = h[once], d[once], w[once]
        starts = np.flatnonzero(np.diff(d, prepend=-1))
        got_samples = samples(h, starts, w, bands * rows)
        keys: list[list[int]] = [[] for _ in ids]
        for b in range(bands):
            of = np.full(len(starts), b, np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                of = mixed(of * np.uint64(31) + got_samples[k])
            for doc, x in zip(d[starts], of.view(np.int64), strict=True):
                keys[doc].append(int(x))
        keys = [keys[i] for i in first_of]
        drawn = sketches(got_samples)
        sketch: list[list[int]] = [[] for _ in ids]
        for doc, x in zip(d[starts], drawn, strict=True):
            sketch[doc] = x
        sketch = [sketch[i] for i in first_of]
        row = (key[0].as_py() << 20) + np.arange(len(ids))
        return pa.table({"row": pa.array(row, pa.int64()), "id": pa.array(ids, pa.int64()), "mark": chunk.column("marks")[0].values, "copy": pa.array(copy, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64())), "sketch": pa.array(sketch, pa.list_(pa.int64()))})

    signed = staged(chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(sign, "row long, id long, mark long, copy binary, bands array<long>, sketch array<long>"), "signed")
    release(spark)
    copies = staged(signed.groupBy("copy").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("n")), "copies")
    texts = signed.select("row", "bands").join(copies.select(F.col("first.row").alias("row")), "row", "left_semi")
    left = texts.select("row", F.posexplode("bands").alias("i", "key")).select("key", "row", "i", F.struct(F.xxhash64("row", "i").alias("turn"), "row").alias("turn"))
    buckets = left.groupBy("key").agg(F.count("*").alias("n"), F.min("turn").alias("least")).filter("n > 1")
    members = staged(left.join(buckets, "key").select("key", "row", "i", "n", F.col("least.row").alias("hub")), "members")
    roots: DataFrame | None = None
    if members.limit(1).count():
        features = _features(chunks, replies, members, width, parts, int(n_docs), similarity)
        release(spark)
        small = members.filter(F.col("n") <= SMALL_BUCKET).select("key", F.col("row").alias("a"))
        pairs = small.join(small.withColumnRenamed("a", "b"), "key").filter("a < b").select("a", "b")
        large = members.filter(F.col("n") > SMALL_BUCKET)
        pairs = pairs.union(large.filter("row <> hub").select(F.least("hub", "row").alias("a"), F.greatest("hub", "row").alias("b"))).distinct()
        roots = components(staged(_compared(pairs, features, similarity), "compared").filter("near").select("a", "b"))
        sketched = signed.select("row", "sketch")
        for more in (lambda r: _within(large, sketched, r, bands * rows), lambda r: _across(features, sketched, r, similarity, bands * rows)):
            found = staged(_compared(more(roots), features, similarity), "compared").filter("near")
            if found.limit(1).count():
                roots = joined(roots, found.select("a", "b"))
    first = copies.select("copy", F.col("first.id").alias("id"), F.col("first.row").alias("row"), "n")
    if roots is None:
        classes = first.select("copy", F.col("id").alias("class_id"), F.col("row").alias("keeper"), F.col("n").alias("class_size"))
    else:
        grouped = first.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
        heads = grouped.groupBy("root").agg(F.min(F.struct("id", "row")).alias("head"), F.sum("n").alias("class_size"))
        classes = grouped.join(heads, "root").select("copy", F.col("head.id").alias("class_id"), F.col("head.row").alias("keeper"), "class_size")
    return signed.join(classes, "copy").select(F.col("id").alias("doc_id"), "class_id", "class_size", (F.col("row") == F.col("keeper")).alias("kept"), "row", "mark")


def sketches(drawn: np.ndarray) -> list[list[int]]:
    """4 bits of each sample (rows of ``drawn``) for every text, 16 to a number."""
    bits = mixed(drawn.ravel()).reshape(drawn.shape) >> np.uint64(60)
    out = np.zeros((-(-len(drawn) // 16), drawn.shape[1]), np.uint64)
    for k, b in enumerate(bits):
        out[k // 16] |= b << np.uint64(4 * (k % 16))
    return out.view(np.int64).T.tolist()


def _agree(a: str, b: str, count: int) -> Column:
    """Whether enough of the 4-bit samples of two sketches are equal."""
    unlike = F.lit(0)
    for k in range(-(-count // 16)):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        any_bit = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
        unlike = unlike + F.bit_count(any_bit.bitwiseAND(F.lit(NIBBLES)))
    return unlike <= int(count * (1 - LEAST_AGREEING))


def _within(large: DataFrame, sketched: DataFrame, roots: DataFrame, count: int) -> DataFrame:
    """Pairs ``a, b`` of texts of a large bucket that are in different groups: in each of eight parts of the bucket by two
    further samples, all with each other or, where a part is large too, with one of them. At most eight rows a member."""
    words = -(-count // 16)
    of = large.join(roots.withColumnRenamed("node", "row"), "row", "left").select("key", "row", "i", F.coalesce("root", "row").alias("root"))
    open_ = of.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    of = of.join(open_, "key").join(sketched, "row")
    own = F.get("sketch", ((F.col("i") / 4).cast("int") + 1) % words)  # samples of other bands than the bucket's
    split = F.array(*[F.xxhash64("key", F.lit(j), F.shiftright(own, 8 * j).bitwiseAND(F.lit(255))) for j in range(8)])
    of = staged(of.select("row", "root", "sketch", F.explode(split).alias("part")), "bucket-parts")
    sizes = of.groupBy("part").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("row", "part").alias("turn"), "row", "root", "sketch")).alias("hub")).filter("n > 1")
    of = staged(of.join(sizes, "part"), "bucket-part-members")
    small = of.filter(F.col("n") <= 2 * SMALL_BUCKET)
    one = small.select("part", F.col("row").alias("a"), F.col("root").alias("ra"), F.col("sketch").alias("sa"))
    two = small.select("part", F.col("row").alias("b"), F.col("root").alias("rb"), F.col("sketch").alias("sb"))
    pairs = one.join(two, "part").filter((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _agree("sa", "sb", count)).select("a", "b")
    hubs = of.filter(F.col("n") > 2 * SMALL_BUCKET).filter("root <> hub.root").withColumn("hs", F.col("hub.sketch")).filter(_agree("sketch", "hs", count))
    return pairs.union(hubs.select(F.least("row", "hub.row").alias("a"), F.greatest("row", "hub.row").alias("b"))).distinct()


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with one row of each group. Rows of equal doc_id and text are copies of which any one stays.

    Nulls: null, empty and wordless texts are one group; a null doc_id is an id like others and comes first. An empty table
    stays empty; other columns pass through whatever they are called. The verdicts grow with the documents, so they are
    never broadcast: both sides are sorted by id and text hash, and copies are then dropped without another shuffle.
    """
    found = near_duplicates(docs, **kw)
    id_, mark = fresh(docs, "_id", "_mark")
    none = F.lit(-(1 << 63))
    kept = found.filter("kept").select(F.coalesce("doc_id", none).alias(id_), F.col("mark").alias(mark))
    marked = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string"))).withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), none))
    return marked.join(kept.hint("merge"), [id_, mark], "left_semi").dropDuplicates([id_, mark]).select(*docs.columns)


def _features(chunks: DataFrame, replies: DataFrame, members: DataFrame, width: int, parts: int, documents: int, similarity: float) -> DataFrame:
    """Shingles and weights of the texts in buckets, as ``row, blob``; those of large buckets also have their ``weight``,
    their ``rare`` shingles and the weight ``rest`` from each on."""
    wanted = members.groupBy("row").agg((F.max("n") > SMALL_BUCKET).cast("int").alias("large"))
    wanted = wanted.groupBy(F.shiftright("row", 20).alias("chunk")).agg(F.collect_list(((F.col("row") % (1 << 20)) * 2 + F.col("large")).cast("int")).alias("docs"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, docs in zip(b.column("chunk"), b.column("docs"), strict=True):
                yield binary_rows(chunk=[chunk.as_py()], level=[2], part=[0], blob=[pack(np.sort(docs.values.to_numpy()))])

    asked = wanted.mapInArrow(rows, "chunk long, level int, part int, blob binary")

    def take(key: tuple, chunk: pa.Table, got: pa.Table) -> pa.Table:
        by, docs = {}, None
        for level, part, blob in zip(got.column("level").to_pylist(), got.column("part").to_pylist(), got.column("blob").to_pylist(), strict=True):
            if level == 2:
                docs = unpack(blob)[0].astype(np.int64)
            else:
                by[part] = blob
        out_rows, out, total, rare, rest = [], [], [], [], []
        if docs is not None:
            h, d, w, df = _weighted(chunk, by, width, parts, documents)
            low, high = np.searchsorted(d, docs >> 1), np.searchsorted(d, docs >> 1, "right")
            for doc, a, z in zip(docs, low, high, strict=True):
                out_rows.append((key[0].as_py() << 20) + int(doc >> 1))
                out.append(pack(np.diff(h[a:z], prepend=np.uint64(0)), w[a:z].astype(np.float32)))
                first, left = rare_shingles(h[a:z], w[a:z], df[a:z], similarity) if doc & 1 else (None, None)
                total.append(float(w[a:z].sum()) if doc & 1 else None)
                rare.append(None if first is None else first.view(np.int64))
                rest.append(left)
        return pa.table({"row": pa.array(out_rows, pa.int64()), "blob": pa.array(out, pa.binary()), "weight": pa.array(total, pa.float64()), "rare": pa.array(rare, pa.list_(pa.int64())), "rest": pa.array(rest, pa.list_(pa.float64()))})

    return staged(chunks.groupBy("chunk").cogroup(replies.union(asked).groupBy("chunk")).applyInArrow(take, "row long, blob binary, weight double, rare array<long>, rest array<double>"), "features")


def _across(features: DataFrame, sketched: DataFrame, roots: DataFrame, similarity: float, count: int) -> DataFrame:
    """Pairs ``a, b`` of texts of large buckets that are in different groups and may be alike: they agree in a rare shingle,
    what they have from there on weighs enough, their weights are near each other and so are their sketches."""
    of = features.filter("weight is not null").join(sketched, "row").select("row", "weight", "sketch", F.explode(F.arrays_zip("rare", "rest")).alias("x"))
    of = of.join(roots.withColumnRenamed("node", "row"), "row", "left").select(F.col("x.rare").alias("shingle"), "row", F.coalesce("root", "row").alias("root"), "weight", F.col("x.rest").alias("rest"), "sketch")
    of = staged(of, "rare-shingles")
    mixed_groups = of.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle")
    of = staged(of.join(mixed_groups, "shingle"), "shared-shingles")
    one = of.select("shingle", F.col("row").alias("a"), F.col("root").alias("ra"), F.col("weight").alias("wa"), F.col("rest").alias("la"), F.col("sketch").alias("sa"))
    two = of.select("shingle", F.col("row").alias("b"), F.col("root").alias("rb"), F.col("weight").alias("wb"), F.col("rest").alias("lb"), F.col("sketch").alias("sb"))
    enough = F.least("la", "lb") >= (similarity / (1 + similarity) - 1e-4) * (F.col("wa") + F.col("wb"))
    near = F.least("wa", "wb") >= (similarity - 1e-4) * F.greatest("wa", "wb")
    return one.join(two, "shingle").filter((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & enough & near & _agree("sa", "sb", count)).select("a", "b").distinct()


def _compared(pairs: DataFrame, features: DataFrame, similarity: float) -> DataFrame:
    """``a, b, near`` for pairs of texts, by weighted Jaccard similarity: the sum of lesser weights over that of greater."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("fa"), batch.column("fb"), strict=True):
                (ha, wa), (hb, wb) = unpack(x.as_py()), unpack(y.as_py())
                ha, hb = np.cumsum(ha.astype(np.uint64)), np.cumsum(hb.astype(np.uint64))
                _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
                both = np.minimum(wa[i], wb[j]).sum(dtype=np.float64)
                near.append(bool(both >= (similarity - 1e-6) * (wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - both)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())], ["a", "b", "near"])

    with_a = pairs.join(features.select(F.col("row").alias("a"), F.col("blob").alias("fa")), "a")
    with_b = with_a.join(features.select(F.col("row").alias("b"), F.col("blob").alias("fb")), "b")
    return with_b.select("a", "b", "fa", "fb").mapInArrow(weigh, "a long, b long, near boolean")


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row", "mark")
