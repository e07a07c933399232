"""Similar-incident retrieval with TF-IDF and cosine (Q1-Q5).

Scale plan: an incident's pseudo-document is a function of six labels and three
bands, so incidents collapse to distinct documents with a multiplicity first; term
statistics (document frequency, corpus frequency) are sums of multiplicities and all
weighting and scoring runs on distinct documents.  The index holds posting lists in blocks of alike
documents with each list's highest weight; a query opens the blocks whose bound reaches its
k-th best score so far.  The top k incidents
of a query lie in its k best documents (ranked by score, then the document's largest
incident id), so only those expand back to incidents; per-document and per-query
top-k are salted two-stage windows, never one task per hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions.expr import round_even
from tessera.functions.position import top_k
from tessera.session import materialize

TOKEN_PATTERN = r"(?U)\b\w\w+\b"


def pseudo_document(df: DataFrame) -> Column:
    """Q1: labels twice each (skipping empty / nan / unknown), fatality, injury and outcome tokens."""
    parts = []
    for c in R.DOC_COLUMNS:
        v = F.trim(F.col(c).cast("string"))
        keep = v.isNotNull() & ~F.lower(v).isin(R.DOC_SKIP)
        parts.append(F.when(keep, F.concat_ws(" ", v, v)))
    kill = F.greatest(F.coalesce(F.col("nkill").cast("double"), F.lit(0.0)), F.lit(0.0))
    wound = F.greatest(F.coalesce(F.col("nwound").cast("double"), F.lit(0.0)), F.lit(0.0))

    def band(x, bands, top):
        e = None
        for cut, tok in bands:
            e = F.when(x <= cut, tok) if e is None else e.when(x <= cut, tok)
        return e.otherwise(top)
    parts.append(band(kill, R.FATALITY_BANDS, "high_fatalities"))
    parts.append(band(wound, R.INJURY_BANDS, "high_injuries"))
    # quirk fixed: the outcome token follows the value (NULL counts as success)
    parts.append(F.when(F.coalesce(F.col("success").cast("int"), F.lit(1)) == 1, "attack_successful")
                 .otherwise("attack_failed"))
    return F.concat_ws(" ", *parts)


def tokens(doc: Column) -> Column:
    """Q2 tokens: lower-cased ``\\w\\w+`` matches."""
    return F.regexp_extract_all(F.lower(doc), F.lit(TOKEN_PATTERN), 0)


def with_bigrams(toks: Column) -> Column:
    """Unigrams followed by bigrams; ``toks`` must be a column reference (evaluated once)."""
    bigrams = F.when(F.size(toks) >= 2, F.transform(
        F.sequence(F.lit(1), F.size(toks) - 1),
        lambda i: F.concat(F.element_at(toks, i), F.lit(" "), F.element_at(toks, i + 1)))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(toks, bigrams)


def doc_key(doc: Column) -> Column:
    """128-bit document key (two independent 64-bit hashes): shuffles carry 16 bytes
    instead of the document text."""
    return F.struct(F.xxhash64(doc).alias("h1"), F.xxhash64(F.concat(doc, F.lit("\u0001"))).alias("h2"))


def distinct_documents(incidents: DataFrame) -> DataFrame:
    """(doc_id, doc, multiplicity, top_id) — top_id is the largest incident id with that document."""
    d = incidents.select("incident_id", pseudo_document(incidents).alias("doc"))
    return (d.groupBy(doc_key(F.col("doc")).alias("doc_id"))
            .agg(F.first("doc").alias("doc"), F.count(F.lit(1)).alias("mult"), F.max("incident_id").alias("top_id")))


def term_counts(docs: DataFrame, doc_col: str = "doc", keys: tuple[str, ...] = ("doc_id", "mult")) -> DataFrame:
    """(keys, term, tf) for every distinct document.

    Each document is one row, so tf is counted inside the row's own term array
    (higher-order functions, no shuffle); ``mult`` rides along for the vocabulary.
    """
    terms = (docs.select(*keys, tokens(F.col(doc_col)).alias("_toks"))
             .select(*keys, with_bigrams(F.col("_toks")).alias("_terms")))
    counted = F.transform(F.array_distinct(F.col("_terms")), lambda t: F.struct(
        t.alias("term"), F.size(F.filter(F.col("_terms"), lambda x: x == t)).cast("long").alias("tf")))
    return terms.select(*keys, F.inline(counted))


def vocabulary(docs: DataFrame, tc: DataFrame, min_df: int = R.VOCAB_MIN_DF,
               max_features: int | None = R.VOCAB_MAX_FEATURES) -> DataFrame:
    """Q3: df >= min_df, then the top ``max_features`` terms by corpus frequency (term asc on ties).

    ``max_features=None`` keeps all terms.  Returns (term, df, idf) with the smoothed idf ln((1+n)/(1+df)) + 1.
    """
    n = docs.select(F.sum("mult")).scalar()
    stats = tc.groupBy("term").agg(F.sum("mult").alias("df"), F.sum(F.col("tf") * F.col("mult")).alias("cf"))
    top = stats.filter(F.col("df") >= min_df)
    top = top if max_features is None else top.orderBy(F.desc("cf"), F.asc("term")).limit(max_features)
    return top.select("term", "df", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf(tc: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """Q4: (1 + ln tf) * idf on vocabulary terms, L2-normalised per document
    (the norm is a window over one document's terms).  A vocabulary of checked size is broadcast."""
    small = vocab.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    terms = vocab.drop("df")
    w = (tc.join(F.broadcast(terms) if small else terms, "term")
         .withColumn("w", (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    kept = ["no"] if "no" in vocab.columns else ["term"]
    return w.select(key, *kept, (F.col("w") / norm).alias("w"))


def numbered(vocab: DataFrame) -> DataFrame:
    """The vocabulary with a number for each term (its own hash, so that no order over all terms is needed)."""
    return vocab.withColumn("no", F.xxhash64("term"))


BLOCK = 256          # documents of a block
SUPER = 256          # blocks whose highest weights are kept in one row
CHUNK = 512          # queries that meet a block or its highest weights together
FIRST = 8            # blocks that each query opens before it has a threshold
SLACK = 2e-9         # scores are ranked at 1e-9; bounds give way by more
BLOCK_SCHEMA = ("block long, h1 array<long>, h2 array<long>, top array<long>, term array<long>, high array<double>, "
                "first array<int>, doc array<int>, w array<double>")


def document_vectors(docs: DataFrame, tc: DataFrame, vocab: DataFrame) -> tuple[DataFrame, Callable]:
    """(documents in the order of their texts, a function of their batches that gives (doc_id, top_id, v)).

    With a vocabulary of checked size the function weighs a document's own terms, so that only the documents'
    rows are moved; else weights come from joins and the function has nothing to do.
    """
    few = vocab.limit(MAX_BROADCAST + 1).toPandas()
    if len(few) > MAX_BROADCAST:
        weights = tfidf(tc, numbered(vocab)).groupBy("doc_id").agg(F.collect_list(F.struct("no", "w")).alias("v"))
        rows = materialize(weights.join(docs.select("doc_id", "top_id", "doc"), "doc_id"), "simindex-vectors")
        return rows.repartitionByRange("doc").sortWithinPartitions("doc").select("doc_id", "top_id", "v"), iter
    number = numbered(vocab).select("term", "no").toPandas().set_index("term")["no"]
    shared = docs.sparkSession.sparkContext.broadcast((few["term"].tolist(), few["idf"].to_numpy(), number.loc[few["term"]].to_numpy()))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, idf, no = shared.value
        known = pa.array(term, pa.string())
        for b in batches:
            lists = b.column(2)
            at = pc.index_in(lists.flatten(), value_set=known)
            doc = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
            held = np.asarray(at.is_valid())
            pair, tf = np.unique(doc[held] * len(term) + np.asarray(at.drop_null()), return_counts=True)
            doc, at = pair // max(len(term), 1), pair % max(len(term), 1)
            w = (1 + np.log(tf)) * idf[at]
            w /= np.sqrt(np.bincount(doc, weights=w * w, minlength=b.num_rows))[doc]
            v = pa.StructArray.from_arrays([pa.array(no[at]), pa.array(w)], names=["no", "w"])
            cuts = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(cuts, v)], names=["doc_id", "top_id", "v"])

    rows = (docs.select("doc_id", "top_id", "doc").repartitionByRange("doc").sortWithinPartitions("doc")
            .select("doc_id", "top_id", tokens(F.col("doc")).alias("_toks")).select("doc_id", "top_id", with_bigrams(F.col("_toks")).alias("terms")))
    return rows, weigh


def posting_blocks(laid: DataFrame, weigh: Callable) -> DataFrame:
    """Blocks of up to ``BLOCK`` documents with their posting lists.

    Documents come in the order of their texts (``document_vectors``), so that
    alike documents share a block and the highest weights of its lists say much about it.
    A row holds the documents' keys, the block's terms, each term's highest weight, and its list (documents'
    places in the block and weights) between ``first`` and the next one.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, []
        for b in weigh(batches):
            held.append(b)
            while sum(x.num_rows for x in held) >= BLOCK:
                rows = pa.Table.from_batches(held).combine_chunks()
                yield block(rows.slice(0, BLOCK), (part << 32) + made)
                made += 1
                held = rows.slice(BLOCK).to_batches()
        if sum(x.num_rows for x in held):
            yield block(pa.Table.from_batches(held).combine_chunks(), (part << 32) + made)

    def block(rows: pa.Table, number: int) -> pa.RecordBatch:
        key, lists = rows.column("doc_id").combine_chunks(), rows.column("v").combine_chunks()
        if isinstance(key, pa.ChunkedArray):
            key, lists = pa.concat_arrays(key.chunks), pa.concat_arrays(lists.chunks)
        flat = lists.flatten()
        doc = np.repeat(np.arange(rows.num_rows), np.asarray(lists.value_lengths()))
        term, w = np.asarray(flat.field("no")), np.asarray(flat.field("w"))
        order = np.lexsort((doc, term))
        doc, term, w = doc[order], term[order], w[order]
        first = np.flatnonzero(np.diff(term, prepend=term[:1] - 1)) if len(term) else np.zeros(0, dtype=np.int64)
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), one(key.field("h1").to_numpy(), pa.int64()), one(key.field("h2").to_numpy(), pa.int64()),
             one(rows.column("top_id").to_numpy(), pa.int64()), one(term[first], pa.int64()),
             one(np.maximum.reduceat(w, first) if len(first) else w, pa.float64()), one(first.astype(np.int32), pa.int32()),
             one(doc.astype(np.int32), pa.int32()), one(w, pa.float64())], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    return laid.mapInArrow(pack, BLOCK_SCHEMA)


def block_bounds(blocks: DataFrame) -> DataFrame:
    """(super, block[], first[], term[], high[]): the highest weights of up to ``SUPER`` blocks in one row."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, []

        def row() -> pa.RecordBatch:
            start = np.cumsum([0, *[len(t) for _, t, _ in held]])[:-1]
            one = lambda x, kind: pa.array([x], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made]), one([n for n, _, _ in held], pa.int64()), one(start, pa.int32()),
                 one(np.concatenate([t for _, t, _ in held]), pa.int64()), one(np.concatenate([h for _, _, h in held]), pa.float64())],
                names=["super", "block", "first", "term", "high"])

        for b in batches:
            for n, t, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if len(t):
                    held.append((n, t.values.to_numpy(), h.values.to_numpy()))
                if len(held) == SUPER:
                    yield row()
                    made, held = made + 1, []
        if held:
            yield row()

    return blocks.select("block", "term", "high").mapInArrow(
        pack, "super long, block array<long>, first array<int>, term array<long>, high array<double>")


def build_index(incidents: DataFrame) -> dict[str, DataFrame]:
    """The search index, built once and written to the shared folder: distinct documents (with
    multiplicity and largest id), the vocabulary, blocks of posting lists, and the blocks' highest weights."""
    docs = materialize(distinct_documents(incidents), "simindex-docs")
    tc = term_counts(docs)
    vocab = materialize(vocabulary(docs, tc), "simindex-vocab")
    blocks = materialize(posting_blocks(*document_vectors(docs, tc, vocab)), "simindex-blocks")
    return {"docs": docs, "vocab": vocab, "blocks": blocks, "bounds": materialize(block_bounds(blocks), "simindex-bounds")}


class Chunk:
    """Some queries as one matrix over a list of terms."""

    def __init__(self, queries: list[dict]) -> None:
        self.no = np.array([q["q"] for q in queries], dtype=np.int64)
        self.least = np.array([q["least"] for q in queries])
        self.term = np.concatenate([np.array([x["no"] for x in q["v"]], dtype=np.int64) for q in queries])
        self.w = np.concatenate([np.array([x["w"] for x in q["v"]]) for q in queries])
        self.at = np.repeat(np.arange(len(queries)), [len(q["v"]) for q in queries])

    def matrix(self, terms: np.ndarray) -> np.ndarray:
        """Weights (term, query) for the given sorted terms."""
        out = np.zeros((len(terms), len(self.no)))
        if len(terms):
            at = np.minimum(np.searchsorted(terms, self.term), len(terms) - 1)
            same = terms[at] == self.term
            out[at[same], self.at[same]] = self.w[same]
        return out


def bounded_blocks(bounds: DataFrame, chunks: DataFrame, number: int, most: int | None) -> DataFrame:
    """(q, block, bound) of the blocks that may hold a score of at least each query's ``least``; with ``most``, only that many
    of each row of ``bounds``, the highest ones.  Each chunk of queries meets each row of highest weights once."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                chunk, term = Chunk(r["queries"]), np.array(r["term"], dtype=np.int64)
                every, place = np.unique(term, return_inverse=True)
                per_list = chunk.matrix(every)[place] * np.array(r["high"])[:, None]
                bound = np.add.reduceat(per_list, np.array(r["first"]), axis=0)          # (block, query)
                good = (bound > 0) & (bound >= chunk.least - SLACK)
                if most is not None and len(bound) > most:
                    cut = -np.partition(-bound, most - 1, axis=0)[most - 1]
                    good &= bound >= cut
                at, q = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array(chunk.no[q]), pa.array(np.array(r["block"], dtype=np.int64)[at]), pa.array(bound[at, q])],
                                                 names=["q", "block", "bound"])

    rows = bounds.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    return rows.join(chunks, "chunk").select("block", "first", "term", "high", "queries").mapInArrow(judge, "q long, block long, bound double")


def opened(blocks: DataFrame, pairs: DataFrame, queries: DataFrame, number: int, k: int) -> DataFrame:
    """(q, h1, h2, top_id, score): of every (q, block) pair, the block's ``k`` best documents with a score of at least ``least``."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in b.schema.names}
                of = lambda c, r=r: r[c].values.to_numpy(zero_copy_only=False)
                chunk, doc, first = Chunk(r["queries"].as_py()), of("doc"), of("first")
                dense = np.zeros((len(of("top")), len(first)))
                dense[doc, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))] = of("w")
                scores, top = dense @ chunk.matrix(of("term")), of("top")
                for j, q in enumerate(chunk.no):
                    some = np.flatnonzero((scores[:, j] > 0) & (scores[:, j] >= chunk.least[j] - SLACK))
                    some = some[np.lexsort((-top[some], -np.rint(scores[some, j] * 1e9)))][:k]
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), q)), pa.array(of("h1")[some]), pa.array(of("h2")[some]),
                                                          pa.array(top[some]), pa.array(scores[some, j])], names=["q", "h1", "h2", "top_id", "score"])

    asked = (pairs.select("q", "block").join(queries, "q").groupBy("block", F.pmod("q", F.lit(number)).alias("_some"))
             .agg(F.collect_list(F.struct("q", "least", "v")).alias("queries")).drop("_some"))          # about CHUNK queries a row
    return blocks.join(asked, "block").drop("high").mapInArrow(score, "q long, h1 long, h2 long, top_id long, score double")


def best_documents(blocks: DataFrame, bounds: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best documents of each query: (query_doc, doc_id, top_id, score, skey), exact.

    ``queries`` is (query_doc, no, w).  The sum of a query's weights times a block's highest ones bounds all scores in
    the block.  First each query opens its ``FIRST`` highest blocks; its k-th best score there is its
    threshold, and the second round opens every other block whose bound reaches that.  All
    queries go together, as rows.  Ranks go by the score at 1e-9, then the larger top_id.
    """
    rows = queries.groupBy("query_doc").agg(F.collect_list(F.struct("no", "w")).alias("v"))
    rows = materialize(rows.withColumn("q", F.monotonically_increasing_id()), "simquery-rows")
    number = max(1, -(-rows.count() // CHUNK))
    order = [F.desc("skey"), F.desc("top_id")]

    def together(q: DataFrame) -> DataFrame:
        return q.groupBy(F.pmod(F.xxhash64("q"), F.lit(number)).cast("int").alias("chunk")).agg(F.collect_list(F.struct("q", "least", "v")).alias("queries"))

    start = rows.select("q", F.lit(0.0).alias("least"), "v")
    highest = top_k(bounded_blocks(bounds, together(start), number, FIRST), ["q"], [F.desc("bound"), F.asc("block")], FIRST, "block")
    first = materialize(highest.select("q", "block"), "simquery-first-blocks")
    seen = opened(blocks, first, start, number, k).withColumn("skey", round_even("score", 9))
    seen = materialize(top_k(seen, ["q"], order, k, "top_id"), "simquery-first")
    least = seen.filter(F.col("rank") == k).select("q", F.col("skey").alias("least"))
    asked = materialize(rows.select("q", "v").join(least, "q", "left").withColumn("least", F.coalesce("least", F.lit(0.0))), "simquery-asked")
    more = bounded_blocks(bounds, together(asked), number, None).join(first, ["q", "block"], "left_anti")
    more = opened(blocks, more, asked, number, k).withColumn("skey", round_even("score", 9))
    best = top_k(seen.drop("rank").unionByName(more), ["q"], order, k, "top_id").drop("rank")
    return (best.join(rows.select("q", "query_doc"), "q")
            .select("query_doc", F.struct("h1", "h2").alias("doc_id"), "top_id", "score", "skey"))


def similar_incidents(incidents: DataFrame, queries: DataFrame, k: int = 10,
                      index: dict[str, DataFrame] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Q5: for every distinct query document, the ``k`` most similar incidents.

    ``queries`` has the incident columns of Q1 (one row per query; duplicates collapse).
    Output: query_doc, rank, incident_id, similarity_score, similarity_pct and the incidents' ``columns``.
    """
    index = index or build_index(incidents)
    vocab = numbered(index["vocab"])
    qdocs = queries.select(pseudo_document(queries).alias("query_doc")).distinct()
    qvec = materialize(tfidf(term_counts(qdocs, "query_doc", ("query_doc",)), vocab, key="query_doc"), "simquery-vectors")
    best_docs = materialize(best_documents(index["blocks"], index["bounds"], qvec, k), "simquery-best-docs")
    rows = incidents.select(*dict.fromkeys(["incident_id", *(columns or [])]), doc_key(pseudo_document(incidents)).alias("doc_id"))
    # k documents of each query: their number is checked before they go to every task
    wanted = best_docs.select("doc_id").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST else wanted
    ids = rows.join(wanted, "doc_id", "left_semi")
    doc_ids = top_k(ids, ["doc_id"], [F.desc("incident_id")], k, "incident_id").drop("rank")
    expanded = best_docs.join(doc_ids, "doc_id")
    out = top_k(expanded, ["query_doc"], [F.desc("skey"), F.desc("incident_id")], k, "incident_id")
    return out.select("query_doc", "rank", "incident_id", round_even("score", 6).alias("similarity_score"),
                      round_even(F.col("score") * 100, 1).alias("similarity_pct"), *(columns or []))


MAX_BROADCAST = 100_000  # document keys
