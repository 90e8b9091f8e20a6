"""Near duplicates by ProbMinHash.

A document is its five-word shingles weighted by their frequency. Each shingle's Poisson process of rate
equal to its weight deals arrivals to the signature's components; a component keeps the shingle that came
first, and a shingle stops once its next arrival is later than every component's first. Two documents
agree in a component with the probability Jaccard similarity of their weights. Bands of components give
candidates, whose similarity is then computed exactly from their texts.

Exact copies (equal word sequences) are one class from the start. In a bucket candidates are not paired
with each other but with a hub, the member with the most company; two such rounds join almost all of a
group, and only members of a bucket that are still in different components are paired in the last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import textkit as K
from thicket.llm.shared import components, drop, fresh, written
from thicket.operators.groups import join_groups

SHINGLE, THRESHOLD = 5, 0.8
#: 32 bands of 5 components; pairs must share 2 bands: at similarity 0.8 all but 1 in 20,000 do.
BANDS, ROWS, SHARED = 32, 5, 2
STAR_ROUNDS = 2
#: Members of a bucket, and bytes of their texts, that are compared in one place at most, against as many.
TILE, TILE_BYTES = 512, 8 << 20
#: Members that a hub's text is sent to at once.
BLOCK = 64
#: Document ids, of 64 bytes at most, up to which a side is broadcast; beyond it Spark joins by a shuffle.
MOST_BROADCAST = 500_000


def word_hashes(chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of a chunk's lower-cased words, and each document's first and end index in them."""
    points, starts, ends = K.words(chunk)
    return K.hash_spans(points, starts, ends), np.searchsorted(starts, chunk.starts), np.searchsorted(starts, chunk.ends)


def shingles(words: np.ndarray, first: np.ndarray, end: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document: (document, hash, frequency), sorted. A document of fewer words
    than a shingle has, but not none, is one shingle."""
    n = end - first
    counts = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), counts)
    at = K.ragged(first, counts)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total += np.where(at + k < end[doc], padded[at + k], np.uint64(0)) * K.powers(size)[k]
    total = K.mix64(total)
    order = np.lexsort((total, doc))
    doc, total = doc[order], total[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])
    at = np.flatnonzero(new)
    return doc[at], total[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash: for each document and component the shingle whose arrival came first (0: no shingle)."""
    best, winner = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    time, active, arrivals, block = np.zeros(len(doc)), np.arange(len(doc)), 0, 1
    while len(active):
        seeds = shingle[active][:, None] + (np.arange(arrivals + 1, arrivals + block + 1, dtype=np.uint64) * np.uint64(K._STEP))[None, :]
        draw = K.mix64(seeds)
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        times = time[active][:, None] + np.cumsum(-np.log(uniform) / weight[active][:, None], axis=1)
        slot = doc[active][:, None] * m + (K.mix64(draw ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64)
        early = times < best[slot]
        t, s = times[early], slot[early]
        np.minimum.at(best, s, t)
        won = t == best[s]
        winner[s[won]] = np.broadcast_to(shingle[active][:, None], times.shape)[early][won]
        time[active] = times[:, -1]
        latest = best.reshape(docs, m).max(axis=1)
        active = active[time[active] < latest[doc[active]]]
        arrivals += block
        # Most shingles of long documents end with their first arrival; the few of short ones need many.
        block = min(2 * block, max(1, (1 << 20) // max(1, len(active))))
    return winner.reshape(docs, m)


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    seed = K.mix64(np.arange(1, bands + 1, dtype=np.uint64))[None, :]
    for k in range(rows):
        seed = K.mix64(seed * K.powers(8)[k] + parts[:, :, k])
    return seed


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two sorted (shingle, weight) vectors, exactly."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio = x / y
    if ratio[0] == 1 and (ratio == 1).all():
        return float((1 / ((x.sum() + only_x + only_y) / x)).sum())
    # Of the sum over all j of max(x_j/x_i, y_j/y_i) the first is the larger where x_j/y_j >= x_i/y_i.
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    first = np.searchsorted(ratio, ratio, "left")
    above = np.concatenate([np.cumsum(x[::-1])[::-1], [0]])[first] + only_x
    under = np.concatenate([[0], np.cumsum(y)])[first] + only_y
    return float((1 / (above / x + under / y)).sum())


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, copy_a, copy_b, bands) of each document with words: the class of equal word sequences as a
    128-bit hash, and the bands' hashes."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for chunk in K.chunks(batch.column(1)):
                words, first, end = word_hashes(chunk)
                has = np.flatnonzero(end > first)
                if not len(has):
                    continue
                first, end = first[has], end[has]
                place = K.ragged(np.zeros_like(first), end - first)
                own = words[K.ragged(first, end - first)]
                cuts = np.cumsum(end - first) - (end - first)
                copy = [np.add.reduceat(K.mix64(own * K.powers(int((end - first).max()))[place] + np.uint64(seed)), cuts) for seed in (1, 2)]
                doc, shingle, weight = shingles(words, first, end)
                bands = band_hashes(signatures(doc, shingle, weight, len(has))).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
                ids = batch.column(0).take(pa.array(has + chunk.lo))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c.astype(np.int64)) for c in copy), lists], ["doc", "copy_a", "copy_b", "bands"])

    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc {kind}, copy_a long, copy_b long, bands array<long>")


def vectors(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sorted (shingle, weight) vector of each text."""
    out = []
    for chunk in K.chunks(column):
        words, first, end = word_hashes(chunk)
        doc, shingle, weight = shingles(words, first, end)
        cuts = np.searchsorted(doc, np.arange(chunk.hi - chunk.lo + 1))
        out += [(shingle[i:j], weight[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return out


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those pairs (a, b, hub) whose texts (doc, text) have the similarity or more, with ``similarity``; ``hub`` is
    one of the two. A hub's text goes once to each BLOCK of the others; a worker holds a batch and one hub."""
    kind = pairs.schema["a"].dataType.simpleString()
    sizes, at = written(pairs.groupBy("hub").agg(F.count("*").alias("n")), "hub-sizes")
    member = pairs.select("hub", F.when(F.col("a") == F.col("hub"), F.col("b")).otherwise(F.col("a")).alias("doc"))
    block = F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / BLOCK))
    member = join_groups(member, sizes, ["hub"], "n").select("hub", block.alias("block"), "doc", F.lit(1).alias("turn"))
    hub = member.select("hub", "block").distinct().select("hub", "block", F.col("hub").alias("doc"), F.lit(0).alias("turn"))
    rows = member.unionByName(hub).join(texts.select("doc", "text"), "doc")
    rows = rows.repartition("hub", "block").sortWithinPartitions("hub", "block", "turn").select("hub", "doc", "turn", "text")

    def run(batches):
        own = None
        for batch in batches:
            found = []
            for turn, vector in zip(batch.column(2).to_pylist(), vectors(batch.column(3)), strict=True):
                if turn == 0:
                    own = vector
                found.append(0.0 if turn == 0 else similarity(own, vector))
            found = np.array(found, float)
            yield batch.select(["hub", "doc"]).append_column("similarity", pa.array(found)).filter(pa.array((found >= threshold) & (batch.column(2).to_numpy() == 1)))

    near = rows.mapInArrow(run, f"hub {kind}, doc {kind}, similarity double")
    return near.select(F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b"), "similarity")


def bucket_links(rows: DataFrame, bands: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) that join what of a bucket's members (band, hash, doc, component) is still apart.

    A bucket over TILE or TILE_BYTES is dealt into tiles, each pair of which is compared as a whole in one
    place; small buckets share tasks. Of two members in different components that share SHARED bands or more, and this
    one as their first, the texts are compared exactly; no row is made for a pair but a link that joins.
    """
    kind = rows.schema["doc"].dataType.simpleString()
    rows = rows.select("band", "hash", "doc", "component").join(texts.select("doc", "size"), "doc")
    tiles = F.ceil(F.greatest(F.col("n") / TILE, F.col("bytes") / TILE_BYTES)).cast("int")
    sizes = rows.groupBy("band", "hash").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).withColumn("tiles", F.greatest(tiles, F.lit(1)))
    sizes, _ = written(sizes, "bucket-sizes")
    n, size = sizes.agg(F.sum(F.col("n") * F.col("tiles")), F.sum(F.col("bytes") * F.col("tiles"))).first()
    placed = join_groups(rows, sizes, ["band", "hash"], "n").withColumn("tile", F.expr("cast(pmod(xxhash64(doc), tiles) as int)"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tasks = max(1, (n or 0) // TILE, (size or 0) // TILE_BYTES)
    dealt = dealt.select("band", "hash", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "doc", "component")
    dealt = dealt.withColumn("task", F.expr(f"pmod(xxhash64(band, hash, i, j), {tasks})")).join(bands, "doc").join(texts.select("doc", "text"), "doc")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("band", "hash", "i", "j", "tile")]).combine_chunks()
        band, hash_, i, j, tile = (table.column(c).to_numpy() for c in ("band", "hash", "i", "j", "tile"))
        ids, parts = table.column("doc").to_pylist(), table.column("component").to_pylist()
        all_bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        known: dict = {}
        a, b = [], []
        new = (band[1:] != band[:-1]) | (hash_[1:] != hash_[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(ids)]
        for lo, hi in zip(cuts, cuts[1:]):
            root: dict = {}

            def find(x):
                while root.setdefault(x, x) != x:  # noqa: B023
                    root[x] = root[root[x]]  # noqa: B023
                    x = root[x]  # noqa: B023
                return x

            own = all_bands[lo:hi]
            shared = np.zeros((hi - lo, hi - lo), np.uint8)
            first = np.ones((hi - lo, hi - lo), bool)
            for k in range(BANDS):
                same = own[:, k, None] == own[None, :, k]
                shared += same
                if k < band[lo]:
                    first &= ~same
            label = np.unique(np.array(parts[lo:hi]), return_inverse=True)[1]
            wanted = np.triu((shared >= SHARED) & first & (label[:, None] != label[None, :]), 1)
            if i[lo] < j[lo]:
                wanted &= tile[lo:hi, None] != tile[None, lo:hi]
            x, y = np.nonzero(wanted)
            likely = np.argsort(-shared[x, y].astype(np.int64), kind="stable")  # the sooner parts join, the fewer texts are compared
            for p, q in zip((x[likely] + lo).tolist(), (y[likely] + lo).tolist()):
                if (r := find(parts[p])) == (t := find(parts[q])):
                    continue
                for z in (p, q):
                    if ids[z] not in known:
                        known[ids[z]] = vectors(table.column("text").slice(z, 1))[0]
                if similarity(known[ids[p]], known[ids[q]]) >= threshold:
                    root[r] = t
                    a.append(ids[p])
                    b.append(ids[q])
        of = table.schema.field("doc").type
        return pa.table([pa.array(a, of), pa.array(b, of)], names=["a", "b"])

    return dealt.groupBy("task").applyInArrow(compare, f"a {kind}, b {kind}")


def _light(df: DataFrame, column: str) -> bool:
    """Whether a table of one column may be broadcast: by its rows, and by its bytes where it is text."""
    n, size = df.agg(F.count("*"), F.sum(F.octet_length(F.col(column).cast("string")))).first()
    return max(n, (size or 0) // 64) <= MOST_BROADCAST


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, list[str]]:
    """One row for each row of ``docs``: doc_id, class_id (smallest doc_id of the same words),
    component_id (smallest doc_id reachable by links) and kept (doc_id = component_id); and the folders in use.

    Links join documents whose five-word shingles have probability Jaccard ``threshold`` or more. Words are
    runs of letters, numbers and marks, lower-cased. Null or empty texts and texts without words link with
    nothing; neither do rows with a null doc_id, which are kept. Rows that repeat a doc_id get its result.
    """
    spark = docs.sparkSession
    drawn, at_drawn = written(sketch(docs, doc_id, text), "sketch")
    classes, at_classes = written(drawn.groupBy("copy_a", "copy_b").agg(F.min("doc").alias("class_id"), F.first("bands").alias("bands")), "classes")
    members = classes.select(F.col("class_id").alias("doc"), F.posexplode("bands").alias("band", "hash"))
    company, at_company = written(members.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1"), "company")
    buckets, at_buckets = written(join_groups(members, company, ["band", "hash"], "n"), "buckets")
    degree = buckets.groupBy("doc").agg(F.sum("n").alias("degree"))
    rows, at_rows = written(buckets.join(degree, "doc").select("band", "hash", "doc", "degree", F.col("doc").alias("component"), F.lit(False).alias("was_hub")), "members")
    ids = rows.select("doc").distinct()
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    texts = texts.join(F.broadcast(ids) if _light(ids, "doc") else ids, "doc", "left_semi").dropDuplicates(["doc"])
    texts, at_texts = written(texts.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), "texts")
    drop(spark, at_buckets, at_company)
    tested: DataFrame | None = None
    links: DataFrame | None = None
    old: list[str] = []
    root, root_at = None, []
    for _ in range(STAR_ROUNDS):
        lead = F.max_by(F.struct("doc", "component"), F.struct("degree", "doc"))
        hubs = rows.where("not was_hub").groupBy("band", "hash").agg(lead.alias("lead"), F.count("*").alias("n"))
        hubs, at_hubs = written(hubs.select("band", "hash", F.col("lead.doc").alias("hub"), F.col("lead.component").alias("hub_part"), "n"), "hubs")
        spoken, at_spoken = written(join_groups(rows.drop("n"), hubs, ["band", "hash"], "n").drop("n"), "spoken")
        pairs = spoken.where("component <> hub_part").groupBy(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).agg(F.min("hub").alias("hub"))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs, at_pairs = written(pairs, "pairs")
        found, at_found = written(verified(pairs, texts, threshold).select("a", "b"), "links")
        old += [at_pairs, at_found]
        tested = pairs.select("a", "b") if tested is None else tested.unionAll(pairs.select("a", "b"))
        links = found if links is None else links.unionAll(found)
        drop(spark, *root_at)
        root, root_at = components(links, "near")
        part = root.withColumnRenamed("node", "doc").withColumnRenamed("component", "part")
        again = spoken.drop("component", "hub_part").join(part, "doc", "left").select("band", "hash", "doc", "degree", F.coalesce("part", "doc").alias("component"), (F.col("was_hub") | (F.col("doc") == F.col("hub"))).alias("was_hub"))
        again, at_again = written(again, "again")
        spread = again.groupBy("band", "hash").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"))
        open_, at_open = written(spread.where("x <> y").select("band", "hash", "n"), "open")
        drop(spark, at_rows, at_spoken, at_hubs)
        rows, at_rows = written(join_groups(again, open_, ["band", "hash"], "n").drop("n"), "members")
        drop(spark, at_again, at_open)
    found, at_found = written(bucket_links(rows, classes.select(F.col("class_id").alias("doc"), "bands"), texts, threshold), "links")
    drop(spark, *root_at)
    root, root_at = components(links.unionAll(found), "near")
    old.append(at_found)
    whole = classes.select("copy_a", "copy_b", "class_id").join(root.withColumnRenamed("node", "class_id"), "class_id", "left").select("copy_a", "copy_b", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    placed, at_placed = written(drawn.select("doc", "copy_a", "copy_b").join(whole, ["copy_a", "copy_b"]).select("doc", "class_id", "component_id"), "placed")
    drop(spark, at_drawn, at_classes, at_rows, at_texts, *old, *root_at)
    out = docs.select(doc_id).join(placed.dropDuplicates(["doc"]), F.col(doc_id) == F.col("doc"), "left")
    out = out.select(doc_id, F.coalesce("class_id", doc_id).alias("class_id"), F.coalesce("component_id", doc_id).alias("component_id"))
    return out.withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id"))), [at_placed]


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) but for near duplicates of a row with a smaller doc_id, null being the
    largest. Each row is judged by its own text, so different texts that share a doc_id stay. Of rows that
    repeat doc_id and text one stays, but all that have neither a doc_id nor words.

    A row's key is a 64-bit hash of its doc_id and text.
    """
    own = F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text).cast("string"))
    name = fresh(docs, "_key")
    found, _ = near_duplicates(docs.select(own.alias("key"), F.col(text).alias("text")), "key", "text", threshold)
    ids = docs.select(own.alias("key"), F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), own.alias("key")).alias("order"))
    members = found.select("key", "component_id").distinct().join(ids.distinct(), "key")
    first = members.groupBy("component_id").agg(F.min("order").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone, _ = written(members.join(first, "component_id").where("key <> first.key").select(F.col("key").alias(name)), "gone")
    if _light(gone, name):
        gone = F.broadcast(gone)
    left = docs.join(gone, own == F.col(name), "left_anti")
    if docs.groupBy(own).count().where("count > 1").isEmpty():
        return left
    once = F.col(doc_id).isNotNull() | F.coalesce(F.col(text).cast("string").rlike(r"[\p{L}\p{N}\p{M}]"), F.lit(False))
    return left.where(once).withColumn(name, own).dropDuplicates([name]).drop(name).unionAll(left.where(~once))
