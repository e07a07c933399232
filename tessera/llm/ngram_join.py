"""Operator 8: documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more.

Exact, without all pairs:

1. Each Arrow batch (a window of documents) is hashed once.  Equal sets of a window collapse;
   shingles that many of its documents share are counted there.  Everything else goes, packed,
   to the task that owns its hash range, which counts in how many documents each shingle is and
   answers each window with the shingles that are in two or more.
2. A window then knows each document's set size, its shared shingles and their counts.  Shingles
   are ordered rarest first.  Two sets that link share one of the first ``n - ceil(3n/4) + 1``
   (prefix filter); if the shingles that no other document has fill this prefix, the document
   links with nothing.  All other documents are candidates, equal sets taken once.
3. Candidates that share a prefix shingle are in one block (connected components).  All links
   are within blocks; each block is a group of signature trees (signature_tree.py).  A block over
   ``part_tokens`` is cut into parts by set size, and by hash within a size: trees over single
   parts, then over neighbouring parts, then over the other pairs of parts that are not yet one
   component.  Only parts whose sizes admit 3/4 meet, and only their sets of such sizes are sent.
4. Components of the links, and of equal sets, give ``component_id``.

Rarest-first order keeps a passage that a third of all documents share out of the prefixes of
documents that only share this passage.

Null text counts as empty.  Documents without words have no shingles and are linked with
nothing; so are rows with a null ``doc_id``'s component: it is the smallest other doc_id, if
any.  Rows that repeat a doc_id are documents of their own.  Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, components, give_back, table
from tessera.llm.signature_tree import spanning_links
from tessera.llm.words import mix, shingles_of, words_of
from tessera.session import materialize, release

RANGE_BYTES = 8 << 20      # text bytes for each hash range: bounds what an owner task holds
RANGE_BITS = 20
COMMON = 64                # documents of a window that share a shingle before the window counts it itself
PART_TOKENS = 1 << 21      # shared shingles that one part of a block holds, about
SET_TOKENS = 32            # what a set counts beside its shingles, so that a part has a bounded number of sets
HIGH = np.uint64(64 - RANGE_BITS)
LOW = np.uint64((1 << 64 - RANGE_BITS) - 1)

PACKED = ("win string, rng int, doc array<long>, row array<long>, n array<long>, k1 array<long>, k2 array<long>, first array<int>, "
          "cdoc binary, ctok binary, tok binary, owner binary, freq binary")
FOUND = "doc_id long, row long, n_shingles long, k1 long, k2 long, tokens binary, prefix array<long>"


def six(x: np.ndarray) -> bytes:
    """The low bits of each name, in six bytes."""
    return np.ascontiguousarray((x & LOW).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsix(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _one(values, kind) -> pa.Array:
    return pa.array([values], pa.list_(kind))


def pack(ranges: int):
    """Batches of (doc_id, text, row) -> a head row for each window and a row for each of its hash ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(b for b in batches if b.num_rows):
            hashes, borders = shingles_of(*words_of(batch.column(1)))
            sets = [np.unique(hashes[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)]
            keys = [(int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(mix(~s).sum(dtype=np.uint64).view(np.int64)))
                    for s in sets]
            seen: dict = {}
            first = [seen.setdefault(k, i) for i, k in enumerate(keys)]
            distinct = sorted(set(first))
            token = np.concatenate([sets[i] for i in distinct] or [np.zeros(0, dtype=np.uint64)])
            owner = np.repeat(np.array(distinct, dtype=np.uint16), [len(sets[i]) for i in distinct])
            # a shingle's name: its range, and the low bits of its hash
            rng = ((token >> HIGH) * np.uint64(ranges) >> np.uint64(RANGE_BITS)).astype(np.int64)
            token = (rng.astype(np.uint64) << HIGH) | (token & LOW)
            values, inverse, count = np.unique(token, return_inverse=True, return_counts=True)
            common = count.take(inverse) > COMMON
            cval, ccount = values[count > COMMON], count[count > COMMON]
            win = f"{task}-{number}"
            empty = pa.array([b""], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([win]), pa.array([hash(keys[0]) % ranges], pa.int32()), _one(batch.column(0).to_pylist(), pa.int64()),
                 _one(batch.column(2).to_pylist(), pa.int64()),
                 _one([len(s) for s in sets], pa.int64()), _one([k[0] for k in keys], pa.int64()),
                 _one([k[1] for k in keys], pa.int64()), _one(first, pa.int32()),
                 pa.array([owner[common].tobytes()]), pa.array([token[common].tobytes()]), empty, empty, empty],
                schema=_packed_schema())
            token, owner, rng = token[~common], owner[~common], rng[~common]
            order = np.argsort(rng, kind="stable")
            token, owner, rng = token[order], owner[order], rng[order]
            crng = (cval >> HIGH).astype(np.int64)
            rows = []
            for r in np.union1d(rng, crng).tolist():
                a, b = np.searchsorted(rng, [r, r + 1])
                c, d = np.searchsorted(crng, [r, r + 1])
                # a shingle that the window counted itself has no owner; its count stands instead
                rows.append((win, r, None, None, None, None, None, None, ccount[c:d].astype("<u4").tobytes(), six(cval[c:d]),
                             six(token[a:b]), owner[a:b].astype("<u2").tobytes(), b""))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True), _packed_schema(), strict=True)],
                                                 schema=_packed_schema())
    return run


def _packed_schema() -> pa.Schema:
    ids = pa.list_(pa.int64())
    return pa.schema([("win", pa.string()), ("rng", pa.int32()), ("doc", ids), ("row", ids), ("n", ids), ("k1", ids), ("k2", ids),
                      ("first", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("cdoc", "ctok", "tok", "owner", "freq"))])


def count_range(rows: pa.Table) -> pa.Table:
    """One hash range: answer each window with its shingles that are in two or more documents."""
    give_back()
    heads = rows.filter(rows["doc"].is_valid())
    body = rows.filter(rows["doc"].is_null())
    if not body.num_rows:
        return heads
    r = body["rng"][0].as_py()
    toks = [unsix(x) for x in body["tok"].to_pylist()]
    ctoks = [unsix(x) for x in body["ctok"].to_pylist()]
    weight = [np.ones(len(t), dtype=np.int64) for t in toks] + [np.frombuffer(x, "<u4").astype(np.int64) for x in body["cdoc"].to_pylist()]
    parts = toks + ctoks
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    token = np.concatenate(parts)
    order = np.argsort(token, kind="stable")
    ranked = token[order]
    new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, dtype=np.int64)
    total = np.add.reduceat(np.concatenate(weight)[order], new) if len(new) else np.zeros(0, dtype=np.int64)
    freq = np.empty(len(token), dtype=np.int64)
    freq[order] = np.repeat(total, np.diff(np.concatenate([new, [len(token)]])))
    freq = np.split(np.minimum(freq, 65535).astype("<u2"), cuts)
    n, out = len(toks), []
    for i, (win, owner) in enumerate(zip(body["win"].to_pylist(), body["owner"].to_pylist(), strict=True)):
        many = freq[i] >= 2
        if not many.any() and not len(ctoks[i]):
            continue
        out.append((win, r, None, None, None, None, None, None, freq[n + i].tobytes(), six(ctoks[i]),
                    six(toks[i][many]), np.frombuffer(owner, "<u2")[many].tobytes(), freq[i][many].tobytes()))
    if not out:
        return heads
    back = pa.table([pa.array(col, f.type) for col, f in zip(zip(*out, strict=True), _packed_schema(), strict=True)], schema=_packed_schema())
    return pa.concat_tables([heads, back])


def finish_window(rows: pa.Table) -> pa.Table:
    """One window: its documents, and for candidates their shared shingles and prefixes."""
    head = rows.filter(rows["doc"].is_valid())
    body = rows.filter(rows["doc"].is_null())
    ranges = body["rng"].to_pylist()
    high = lambda x, r: unsix(x) | np.uint64(r) << HIGH
    zero = [np.zeros(0, dtype=np.uint64)]
    token = np.concatenate(zero + [high(x, r) for x, r in zip(body["tok"].to_pylist(), ranges, strict=True)])
    owner = np.frombuffer(b"".join(body["owner"].to_pylist()), "<u2")
    freq = np.frombuffer(b"".join(body["freq"].to_pylist()), "<u2")
    ctok = np.concatenate(zero + [high(x, r) for x, r in zip(body["ctok"].to_pylist(), ranges, strict=True)])
    cfreq = np.frombuffer(b"".join(body["cdoc"].to_pylist()), "<u2")
    order = np.argsort(ctok)
    ctok, cfreq = ctok[order], cfreq[order]
    own = np.frombuffer(head["ctok"][0].as_py(), dtype=np.uint64)     # the shingles the window counted itself
    token = np.concatenate([token, own])
    owner = np.concatenate([owner, np.frombuffer(head["cdoc"][0].as_py(), dtype="<u2")])
    freq = np.concatenate([freq, cfreq[np.searchsorted(ctok, own)]])
    order = np.lexsort((token, freq, owner))
    token, owner = token[order], owner[order]
    ids, row, sizes, k1, k2, first = (head[c][0].as_py() for c in ("doc", "row", "n", "k1", "k2", "first"))
    starts = np.searchsorted(owner, np.arange(len(ids) + 1))
    tokens: list[bytes | None] = [None] * len(ids)
    prefix: list[list[int] | None] = [None] * len(ids)
    for i, n in enumerate(sizes):
        mine = token[starts[i]: starts[i + 1]]
        free = n + (-3 * n // 4) + 1 - (n - len(mine))     # prefix places that shared shingles take
        if first[i] == i and n and free > 0:
            tokens[i] = np.sort(mine).tobytes()
            prefix[i] = mine[:free].view(np.int64).tolist()
    return pa.table([pa.array(ids, pa.int64()), pa.array(row, pa.int64()), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                     pa.array(tokens, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                    names=["doc_id", "row", "n_shingles", "k1", "k2", "tokens", "prefix"])


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every document (set size, 128-bit key of the set), with the tokens and prefix of candidates."""
    spark = docs.sparkSession
    arrow_limits(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("row", F.xxhash64("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(1 << RANGE_BITS, max(4, -(-volume // RANGE_BYTES)))
    packed = rows.mapInArrow(pack(ranges), PACKED)
    counted = packed.groupBy("rng").applyInArrow(count_range, PACKED)
    return materialize(counted.groupBy("win").applyInArrow(finish_window, FOUND), "shingle-sets")


def blocks_of(sets: DataFrame) -> DataFrame:
    """Candidates (each set once) by block: (block, k, n, tokens)."""
    cand = sets.filter("prefix IS NOT NULL").withColumn("k", F.concat(F.hex("k1"), F.lit("-"), F.hex("k2")))
    once = materialize(cand.select("k", "prefix").dropDuplicates(["k"]), "candidates")      # shingles stay where they are
    posts = once.select(F.explode("prefix").alias("token"), "k")
    lead = posts.groupBy("token").agg(F.min("k").alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    edges = posts.join(lead, "token").filter("k <> lead").select(F.col("k").alias("a"), F.col("lead").alias("b"))
    block = components(edges).withColumnRenamed("node", "k").withColumnRenamed("root", "block")
    rows = cand.select("k", F.col("n_shingles").alias("n"), "tokens").dropDuplicates(["k"]).join(block, "k")
    rows = materialize(rows.select("block", "k", "n", "tokens"), "blocks")
    release(once)
    return rows


def tree_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, i, j, k, n, tokens, label) sorted by (block, i, j): links of each group's tree."""
    held, key = [], None

    def links() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            found = spanning_links([np.frombuffer(x["tokens"], dtype=np.uint64) for x in held], np.array([x["n"] for x in held]),
                                   [x["label"] for x in held])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([held[a]["k"] for a, _ in found]), pa.array([held[b]["k"] for _, b in found])],
                                                 names=["a", "b"])

    for batch in batches:
        for x in batch.to_pylist():
            if (at := (x["block"], x["i"], x["j"])) != key:
                yield from links()
                held, key = [], at
            held.append(x)
    yield from links()


def _trees(rows: DataFrame) -> DataFrame:
    rows = rows.select("block", "i", "j", "k", "n", "tokens", "label")
    return (rows.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
            .mapInArrow(tree_links, "a string, b string"))


def part_cuts(blocks: DataFrame, part_tokens: int) -> DataFrame:
    """(block, n, w, at): weight of each set size in the blocks over ``part_tokens``, and of all smaller sizes.

    A block has no more of these rows than its longest set has shingles.
    """
    weight = F.sum(F.octet_length("tokens") / 8 + SET_TOKENS).cast("long")
    sizes = blocks.groupBy("block", "n").agg(weight.alias("w"))
    large = sizes.groupBy("block").agg(F.sum("w").alias("total")).filter(F.col("total") > part_tokens)
    before = Window.partitionBy("block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    cuts = sizes.join(large, "block").select("block", "n", "w", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("at"))
    return materialize(cuts, "part-cuts")


def parted(blocks: DataFrame, cuts: DataFrame, part_tokens: int, how: str) -> DataFrame:
    """``blocks`` with ``part``: 0 in small blocks, else the place in the order of sizes, counted in ``part_tokens``."""
    place = (F.col("at") + F.pmod(F.xxhash64("k"), F.lit(1 << 40)) / (1 << 40) * F.col("w")) / part_tokens
    rows = blocks.join(cuts, ["block", "n"], how).withColumn("part", F.coalesce(F.floor(place).cast("int"), F.lit(0)))
    return rows.select("block", "part", "k", "n", "tokens")


def part_pairs(now: DataFrame, near: bool) -> DataFrame:
    """Pairs of parts i < j that may hold a link between components: neighbours, or all others.

    Rows (block, i, j, part, least, most): which part's sets of which sizes go to the pair's task.
    """
    state = now.groupBy("block", "part").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    first = state.select("block", *[F.col(c).alias(f"i_{c}") for c in ("part", "lo", "hi", "least", "most")])
    step = F.col("part") - F.col("i_part")
    pair = first.join(state, "block").filter(step == 1 if near else step > 1).filter("3 * least <= 4 * i_most")
    pair = pair.filter("NOT (i_lo = i_hi AND lo = hi AND i_lo = lo)")
    ends = F.array(F.struct(F.col("i_part").alias("part"), F.ceil(3 * F.col("least") / 4).alias("least"), F.col("i_most").alias("most")),
                   F.struct(F.col("part"), F.col("least"), F.floor(4 * F.col("i_most") / 3).alias("most")))
    return pair.select("block", F.col("i_part").alias("i"), F.col("part").alias("j"), F.explode(ends).alias("e")).select("block", "i", "j", "e.*")


def find_links(blocks: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Links (a, b) that span every component of every block."""
    cuts = part_cuts(blocks, part_tokens)
    part = F.col("part")
    rows = parted(blocks, cuts, part_tokens, "left")
    links = materialize(_trees(rows.withColumns({"i": part, "j": part, "label": F.lit(None).cast("string")})), "links-own")
    if cuts.isEmpty():
        return links
    for near in (True, False):
        label = components(links).select(F.col("node").alias("k"), F.col("root").alias("label"))
        now = parted(blocks, cuts, part_tokens, "inner").join(label, "k", "left").withColumn("label", F.coalesce("label", "k"))
        sent = now.join(part_pairs(now, near), ["block", "part"]).filter("n >= least AND n <= most")
        links = links.union(materialize(_trees(sent), "links-pairs"))
    return links


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     part_tokens: int = PART_TOKENS) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, component) for every row of ``docs``.

    ``row`` is the text's xxhash64; ``component`` names the component even where rows repeat a doc_id.
    """
    sets = shingle_sets(docs, id_col, text_col)
    blocks = blocks_of(sets)
    links = find_links(blocks, part_tokens)
    release(blocks)
    root = components(links)
    key = F.concat(F.hex("k1"), F.lit("-"), F.hex("k2")).alias("k")
    rows = sets.select("doc_id", "row", "n_shingles", key)
    classes = rows.filter("n_shingles > 0").groupBy("k").agg(F.min("doc_id").alias("least"))
    classes = classes.join(root.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    label = classes.join(least, "root").select("k", "component_id", F.col("root").alias("component"))
    own = rows.filter("n_shingles = 0").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"),
                                               F.lit(None).cast("string").alias("component"))
    linked = rows.filter("n_shingles > 0").join(label, "k")
    return linked.select("doc_id", "row", "n_shingles", "component_id", "component").union(own)


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the smallest doc_id stays.

    Documents without words all stay.  Of rows with the same doc_id in one component, the one with
    the smallest text hash stays, and of rows that repeat both, one.  A null doc_id is the largest.
    """
    found = materialize(ngram_components(docs, id_col, text_col), "near-duplicates")
    worded = found.filter("n_shingles > 0").select("component", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("at"))
    stay = worded.groupBy("component").agg(F.min("at").alias("first"))
    lost = worded.join(stay, "component").filter(~F.col("at").eqNullSafe(F.col("first")))
    lost = lost.select(F.col("at.doc_id").alias("lost_id"), F.col("at.row").alias("lost_row")).distinct()
    # references by frame: the documents may have columns of any name
    row = F.xxhash64(docs[text_col].cast("string"))
    kept = docs.join(lost, docs[id_col].cast("long").eqNullSafe(lost["lost_id"]) & (row == lost["lost_row"]), "left_anti")
    if not worded.groupBy("at").count().filter("count > 1").isEmpty():
        name = "_" + max(docs.columns, key=len)
        # rows without words get a number of their own
        words = F.coalesce(docs[text_col].cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        kept = kept.withColumns({name: row, "_" + name: F.when(~words, F.monotonically_increasing_id())})
        kept = kept.dropDuplicates([id_col, name, "_" + name]).drop(name, "_" + name)
    return kept


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i:
    array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS shingle FROM words),
size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT s.a, s.b FROM shared s JOIN size x ON x.doc_id = s.a JOIN size y ON y.doc_id = s.b
    WHERE 100 * s.c >= 75 * (x.n + y.n - s.c)),
reach AS (SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT r.root, l.b FROM reach r JOIN links l ON l.a = r.node),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, least.component_id
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN least ON least.node = d.doc_id
"""
