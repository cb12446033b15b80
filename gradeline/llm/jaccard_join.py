"""N-gram Jaccard join by token-combination prefixes.

Tokens are a document's distinct 5-word shingles. With a threshold of 3/4, two similar sets share a
token among the first n - ceil(3n/4) + 1 tokens of each in any common order, and k tokens if these
prefixes are longer by k - 1.

1. Frequencies: texts are dealt to partitions; each task counts, for a few million tokens at a time, the
   different sets that have each token, and sends one entry for a token to the partition of the hash
   space that adds up. That answers which tokens several sets have, and how many; copies of one set in
   different tasks count again, so the sums are upper bounds, the same everywhere. Equal sets (by a
   128-bit signature) are one class.
2. Index: texts meet the counts of their tokens. A set of which less than 3/4 of the tokens occur
   elsewhere has no link. In the others tokens are ordered by their counts, rare ones first. Rare
   tokens of the prefix are indexed one by one. Where a prefix reaches frequent tokens (more than
   FREQUENT sets) it is longer by one, and pairs of its frequent tokens are indexed; sets with more
   than COMBINED frequent tokens there index them singly. Each index entry with several classes
   names its smallest as pivot (sizes that can't be similar part it), so any two similar sets have
   a pivot in common.
3. Verification: texts go to their pivots' groups. There a local index, ordered by the frequency in
   the group, finds the candidates, and exact intersections decide. A group is searched component
   by component, each document against those not yet reached, so copies don't meet pairwise. Groups
   of more than GROUP documents or GROUP_TOKENS tokens are cut into chunks with the pivot in each; members that don't
   reach their pivot then meet all other chunks.
4. The links' connected components, and each document's class.

The counts only steer which entries are made; similarities are those of the sets of 64-bit token hashes. Defined results: letters A-Z
are lower-cased; null and empty texts have no tokens and link with nothing; texts of fewer than five
words have one token, the whole sequence; null ids link with nothing and have no component; rows
that repeat an id are one document for links; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.llm import buckets as B
from gradeline.llm.components import components
from gradeline.llm.shared import TIDY, Tables, delete, join_by_key, new_dir, prepare, settings, write
from gradeline.llm.textops import SpanHash, blocks, column_bytes, lower_ascii, mixed, ranges, windows, word_spans

SHINGLE = 5
#: Similar if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A token of more sets than this (at most 199) is frequent.
FREQUENT = 128
COMBINED = 16
#: Documents, and tokens of all of them, that one group or chunk holds; the pivot is in each chunk.
GROUP = 300
GROUP_TOKENS = 2_000_000

_WORD, _SHINGLE = SpanHash(51), SpanHash(52)
_LOW47 = np.uint64((1 << 47) - 1)
_LOW48 = np.uint64((1 << 48) - 1)
#: Frequencies are kept by the low 48 bits of a token; two tokens with the same ones share a frequency.
_TOKENS = {"key": 6, "to": -4, "n": -4}
_COMMON = {"key": 6, "classes": 1, "to": -4}
_ENTRIES = {"key": 6, "id": -8, "size": -8, "sign": -8}
_ENTRIES_SQL = ", ".join(f"{c} binary" for c in _ENTRIES)


def token_sets(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of each row (flat) and the bounds of each row."""
    data, offsets = column_bytes(block.column("text"))
    starts, ends, first = word_spans(data, offsets)
    hashes = _WORD.words(lower_ascii(data), starts, ends)
    at, row = windows(first, SHINGLE)
    token = _SHINGLE.runs(hashes, at, SHINGLE)
    count = np.diff(first)
    for size in range(1, SHINGLE):
        short = np.flatnonzero(count == size)
        row = np.concatenate([row, short])
        token = np.concatenate([token, _SHINGLE.runs(hashes, first[short], size)])
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    if len(token):
        once = np.append(True, (token[1:] != token[:-1]) | (row[1:] != row[:-1]))
        token, row = token[once], row[once]
    return token, np.searchsorted(row, np.arange(block.num_rows + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(values.dtype.type(0), np.cumsum(values))
    return total[bounds[1:]] - total[bounds[:-1]]


def signatures(token: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit signatures of each set."""
    return tuple(_sums(mixed(token ^ np.uint64(c)), bounds) for c in (0x51ED270B, 0xA5A5F00D1234567))


def needed(n: np.ndarray) -> np.ndarray:
    """The smallest intersection of a set of n tokens with a similar one."""
    return (PERCENT * n + 99) // 100


def _common_tokens(texts: DataFrame, parts: int) -> DataFrame:
    """(part, key, classes, to): tokens of several sets and how frequent they are, for each partition of documents that has them."""

    def merged(keys: list, signs: list, part: int) -> B.Entries:
        key, sign = np.concatenate(keys), np.concatenate(signs)
        keys.clear()
        signs.clear()
        order = np.lexsort((sign, key))
        key = key[order]
        key = key[B.heads(key, sign[order])]
        at = B.heads(key)
        return {"key": key[at], "to": np.full(len(at), part, np.uint64), "n": np.diff(np.append(at, len(key))).astype(np.uint64)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[B.Entries]:
        keys, signs, held, part = [], [], 0, -1
        for block in blocks(batches, "text"):
            here = int(block.column("part")[0].as_py())
            if held and (here != part or held >= B.FLUSH):
                yield merged(keys, signs, part)
                held = 0
            part = here
            token, bounds = token_sets(block)
            keys.append(token & _LOW48)
            signs.append(np.repeat(signatures(token, bounds)[0], np.diff(bounds)))
            held += len(token)
        if held:
            yield merged(keys, signs, part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[B.Entries]:
        for e in B.gathered(batches, _TOKENS):
            order = np.argsort(e["key"], kind="stable")
            key, to, n = (e[c][order] for c in _TOKENS)
            at = B.heads(key)
            total = np.repeat(np.add.reduceat(n, at), np.diff(np.append(at, len(key))))
            common = total > 1
            key, to, cls = key[common], to[common], frequency_class(total[common].astype(np.int64))
            order = np.lexsort((key, to))
            key, to, cls = key[order], to[order], cls[order]
            once = B.heads(to, key)
            yield {"key": key[once], "classes": cls[once], "to": to[once]}

    sent = B.exchange(texts.repartitionById(parts, "part"), scan, _TOKENS, lambda e: B.hash_bucket(e["key"], parts), parts)
    return B.exchange(sent, count, _COMMON, lambda e: e["to"].astype(np.int64), parts)


def frequency_class(sets: np.ndarray) -> np.ndarray:
    """The number of sets up to 199, then steps of powers of two; one byte."""
    return np.where(sets < 200, sets, 192 + np.log2(np.maximum(sets, 1)).astype(np.int64)).clip(0, 255).astype(np.uint8)


def index_entries(
    token: np.ndarray, bounds: np.ndarray, cls: np.ndarray, frequent: int = FREQUENT, combined: int = COMBINED
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index keys of the sets of a block (48 bits), the row of each, and which rows index frequent tokens singly.

    ``cls`` is the frequency class of each token. Sets without enough tokens that others have get no key.
    """
    rows = len(bounds) - 1
    n = np.diff(bounds)
    row = np.repeat(np.arange(rows), n)
    shared = np.bincount(row, cls > 1, rows) if len(row) else np.zeros(rows)
    can = (shared >= needed(n)) & (n > 0)
    kept = can[row]
    token, row, cls = token[kept], row[kept], cls[kept]
    order = np.lexsort((token, cls, row))
    token, cls = token[order], cls[order]
    often = cls > frequent
    rare = np.bincount(row, ~often, rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
    begin = np.searchsorted(row, np.arange(rows))
    place = np.arange(len(token)) - begin[row]
    prefix = n - needed(n) + 1
    longer = np.minimum(prefix + 1, n)
    length = np.where(longer > rare, longer, prefix)
    taken = place < length[row]
    single = taken & ~often & (cls > 1)
    keys, of = [token[single] & _LOW47], [row[single]]
    some = taken & often
    many = np.bincount(row[some], minlength=rows) if some.any() else np.zeros(rows, np.int64)
    if some.any():
        # Singly for all, so that a set with many frequent tokens finds one with few.
        keys.append(mixed(token[some] + np.uint64(1)) & _LOW47 | np.uint64(1 << 47))
        of.append(row[some])
        t, r = token[some], row[some]
        few = many[r] <= combined
        t, r = t[few], r[few]
        t = t[np.lexsort((t, r))]
        for gap in range(1, combined):
            a, b = slice(None, -gap), slice(gap, None)
            both = r[a] == r[b] if len(r) > gap else np.zeros(0, bool)
            if not both.any():
                break
            keys.append(mixed(mixed(t[a][both]) + t[b][both] * np.uint64(3)) & _LOW47)
            of.append(r[a][both])
    return np.concatenate(keys), np.concatenate(of), many > combined


def _indexed(texts: DataFrame, common: DataFrame, parts: int, frequent: int, combined: int) -> str:
    """Write, in folders of their own: the size and signature of every set, index entries, and the texts that can have a link."""
    schema = pa.schema([
        ("kind", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sign_a", pa.int64()), ("sign_b", pa.int64()), ("text", pa.string()),
        *((c, pa.binary()) for c in _ENTRIES),
    ])

    def filled(kind: str, **columns) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        arrays = {"kind": pa.array([kind] * rows), **columns}
        return pa.RecordBatch.from_arrays([arrays[f.name] if f.name in arrays else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def packs_of(found: list[B.Entries]) -> pa.RecordBatch:
        packed = {c: pa.array([B.packed(np.concatenate([f[c] for f in found]), w)]) for c, w in _ENTRIES.items()}
        found.clear()
        return filled("entry", **packed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: list[tuple[np.ndarray, np.ndarray]] = []
        known, found, held = None, [], 0
        for block in blocks(B.split_met(batches, lambda r: packs.append((B.unpacked(r["key"], _COMMON["key"]), np.frombuffer(r["classes"], np.uint8)))), "text"):
            if known is None:
                known = np.concatenate([k for k, _ in packs]) if packs else np.zeros(0, np.uint64)
                classes = np.concatenate([c for _, c in packs]) if packs else np.zeros(0, np.uint8)
                packs.clear()
                order = np.argsort(known)
                known, classes = known[order], classes[order]
            token, bounds = token_sets(block)
            ids = np.asarray(block.column("doc_id"))
            one, two = signatures(token, bounds)
            yield filled("set", doc_id=block.column("doc_id"), n=pa.array(np.diff(bounds)), sign_a=pa.array(one.view(np.int64)), sign_b=pa.array(two.view(np.int64)))
            cls = np.ones(len(token), np.uint8)
            if len(known) and len(token):
                low = token & _LOW48
                at = np.minimum(np.searchsorted(known, low), len(known) - 1)
                cls = np.where(known[at] == low, classes[at], 1)
            keys, row, big = index_entries(token, bounds, cls, frequent, combined)
            if not len(keys):
                continue
            some = np.zeros(block.num_rows, bool)
            some[row] = True
            chosen = block.filter(pa.array(some))
            yield filled("text", doc_id=chosen.column("doc_id"), text=chosen.column("text"))
            found.append({"key": keys, "id": ids[row], "size": (np.diff(bounds) * 2 + big)[row], "sign": one[row]})
            held += len(keys)
            if held >= B.FLUSH:
                yield packs_of(found)
                held = 0
        if found:
            yield packs_of(found)

    path = new_dir(texts.sparkSession, "jaccard-index")
    columns = "kind string, doc_id long, n long, sign_a long, sign_b long, text string, " + _ENTRIES_SQL
    write(B.met(texts, common, ["key", "classes"], parts).mapInArrow(scan, columns), path, "kind")
    return path


def _pivots(entries: DataFrame, parts: int) -> DataFrame:
    """Distinct (pivot, member) of all index entries with several classes, and the member's tokens ``n``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in B.gathered(batches, _ENTRIES):
            order = np.argsort(e["key"], kind="stable")
            key = e["key"][order]
            same = key[1:] == key[:-1]
            several = np.append(False, same) | np.append(same, False)
            order = order[several]
            key, member, size, sign = (e[c][order] for c in _ENTRIES)
            member, size = member.view(np.int64), size.view(np.int64)
            # Of equal sets the smallest id stands for all.
            order = np.lexsort((member, sign, key))
            order = order[B.heads(key[order], sign[order])]
            order = order[np.lexsort((size[order] >> 1, key[order]))]
            key, member, size = key[order], member[order], size[order]
            n = size >> 1
            if not len(key):
                continue
            new = np.append(True, (key[1:] != key[:-1]) | (100 * n[:-1] < PERCENT * n[1:]))
            head = np.flatnonzero(new)
            length = np.diff(np.append(head, len(key)))
            listed = (key >> np.uint64(47)) == 1  # frequent tokens, singly: a pair has one set with many of them
            can = ~listed | ((size & 1) == 1)
            top = np.iinfo(np.int64).max
            pivot = np.minimum.reduceat(np.where(can, member, top), head)
            good = np.repeat((length > 1) & (pivot != top), length)
            pivot, member, n = np.repeat(pivot, length)[good], member[good], n[good]
            order = np.lexsort((member, pivot))
            pivot, member, n = pivot[order], member[order], n[order]
            once = B.heads(pivot, member)
            yield pa.RecordBatch.from_arrays([pa.array(pivot[once]), pa.array(member[once]), pa.array(n[once])], names=["pivot", "member", "n"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[B.Entries]:
        return B.gathered(batches, _ENTRIES, B.FLUSH)

    sent = B.exchange(entries, dealt, _ENTRIES, lambda e: B.hash_bucket(mixed(e["key"]), parts), parts)
    return sent.mapInArrow(gather, "pivot long, member long, n long").groupBy("pivot", "member").agg(F.max("n").alias("n"))


def linked(sets: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """For each set of a group the smallest id of its component, by exact similarities."""
    m = len(sets)
    n = np.array([len(s) for s in sets])
    if m == 2:
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.full(2, ids.min()) if 100 * inter >= PERCENT * (n.sum() - inter) and inter else ids.copy()
    of = np.repeat(np.arange(m), n)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(count, kind="stable")
    rank_of = np.empty(len(count), np.int64)
    rank_of[order] = np.arange(len(count))
    rank = rank_of[place]
    often = count[place] > 1
    by = np.lexsort((rank, of))
    rank, often = rank[by], often[by]  # rows are in order as before
    begin = np.cumsum(n) - n
    inside = np.arange(len(rank)) - np.repeat(begin, n)
    entry = np.flatnonzero((inside < np.repeat(n - needed(n) + 1, n)) & often)
    entry_row, entry_rank = of[entry], rank[entry]
    by = np.argsort(entry_rank, kind="stable")
    post_rank, post_row = entry_rank[by], entry_row[by]
    own = np.searchsorted(entry_row, np.arange(m + 1))
    root = np.full(m, -1)
    marked = np.zeros(len(count), bool)
    waiting = np.ones(m, bool)
    for seed in np.argsort(ids, kind="stable"):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        root[seed] = ids[seed]
        queue = [seed]
        while queue:
            a = queue.pop()
            mine = entry_rank[own[a] : own[a + 1]]
            lo = np.searchsorted(post_rank, mine)
            size = np.searchsorted(post_rank, mine, side="right") - lo
            near = post_row[ranges(lo, size)]
            near = near[waiting[near]]
            if not len(near):
                continue
            near = np.unique(near)
            near = near[(100 * n[near] >= PERCENT * n[a]) & (100 * n[a] >= PERCENT * n[near])]
            if not len(near):
                continue
            tokens = rank[begin[a] : begin[a] + n[a]]
            marked[tokens] = True
            flat = marked[rank[ranges(begin[near], n[near])]]
            marked[tokens] = False
            inter = np.add.reduceat(flat.astype(np.int64), np.cumsum(n[near]) - n[near])
            hit = near[100 * inter >= PERCENT * (n[near] + n[a] - inter)]
            waiting[hit] = False
            root[hit] = ids[seed]
            queue.extend(hit.tolist())
    # Ids may repeat: the same id in two components joins them.
    return root


def _verified(docs: DataFrame, jobs: DataFrame, parts: int) -> DataFrame:
    """(job, member, root) for ``jobs`` (job, member): components of each job's texts."""
    texts = docs.select("doc_id", "text").join(jobs.hint("merge"), F.col("doc_id") == F.col("member")).select("job", "doc_id", "text")
    together = texts.repartition(parts, "job").sortWithinPartitions("job")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, sets, ids = None, [], []
        out: list[list] = [[], [], []]

        def close() -> None:
            if not sets:
                return
            at = np.array(ids)
            root = linked(sets, at) if len(sets) > 1 else at
            out[0].append(np.full(len(at), job))
            out[1].append(at)
            out[2].append(root)

        def ready() -> pa.RecordBatch:
            arrays = [pa.array(np.concatenate(c)) for c in out]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["job", "member", "root"])

        for block in blocks(batches, "text"):
            token, bounds = token_sets(block)
            for k, (j, d) in enumerate(zip(block.column("job").to_pylist(), block.column("doc_id").to_pylist(), strict=True)):
                if j != job:
                    close()
                    job, sets, ids = j, [], []
                sets.append(token[bounds[k] : bounds[k + 1]].copy())
                ids.append(d)
            if len(out[0]) > 2000:
                yield ready()
        close()
        if out[0]:
            yield ready()

    return together.mapInArrow(link, "job long, member long, root long")


def _links(docs: DataFrame, pivots: DataFrame, parts: int, group: int, group_tokens: int, tables: Tables) -> DataFrame:
    """Edges (a, b) that span the components of all links between classes."""
    count = F.count(F.lit(1))
    share = F.greatest(F.ceil(count / group), F.ceil(F.sum("n") / group_tokens))  # long texts make smaller chunks
    sizes = pivots.groupBy("pivot").agg(F.least(share, F.greatest(count - 1, F.lit(1))).cast("int").alias("chunks"))
    large = sizes.where("chunks > 1")
    small = tables.keep(
        _verified(docs, pivots.join(large, "pivot", "left_anti").select(F.col("pivot").alias("job"), "member"), parts).where("member <> root").select(F.col("member").alias("a"), F.col("root").alias("b")),
        "jaccard-links",
    )
    if large.isEmpty():
        return small
    chunked = pivots.join(large, "pivot")
    chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int"))
    job = F.xxhash64("pivot", "chunk", "other")
    # The pivot is in every chunk.
    first = chunked.where("member <> pivot").select("pivot", "chunk", F.lit(-1).alias("other"), "member", "n").unionByName(
        chunked.where("member = pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(-1).alias("other"), "member", "n")
    )
    first = first.withColumn("job", job)
    done = tables.keep(_verified(docs, first.select("job", "member"), parts), "jaccard-chunks")
    at = tables.keep(first.select("job", "pivot", "chunk", "member", "n"), "jaccard-jobs")
    done = done.join(at, ["job", "member"])
    pivot_root = done.where("member = pivot").select("job", F.col("root").alias("pivot_root"))
    left = tables.keep(
        done.join(pivot_root, "job").where("root <> pivot_root").select("pivot", "chunk", "member", "n"), "jaccard-left"
    )
    edges = small.unionByName(done.where("member <> root").select(F.col("member").alias("a"), F.col("root").alias("b")))
    if left.isEmpty():
        return tables.keep(edges, "jaccard-edges")
    # Members that did not reach their pivot meet every chunk.
    others = left.groupBy("pivot").agg(F.least(share, count).cast("int").alias("others"))
    left = left.join(others, "pivot").withColumn("other", F.pmod(F.xxhash64("member", F.lit(1)), F.col("others")).cast("int"))
    chunks = chunked.select("pivot", "chunks").distinct()
    second = (
        chunked.join(others, "pivot").select("pivot", "chunk", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"), "member")
        .unionByName(left.join(chunks, "pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "other", "member"))
        .withColumn("job", job).select("job", "member").distinct()
    )
    more = _verified(docs, second, parts).where("member <> root").select(F.col("member").alias("a"), F.col("root").alias("b"))
    return tables.keep(edges.unionByName(more), "jaccard-edges")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, frequent: int = FREQUENT, combined: int = COMBINED, group_tokens: int = GROUP_TOKENS
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    parts = B.partitions(docs)
    named = B.with_part(docs.where("doc_id is not null"), parts)
    tables = Tables(spark)
    common = tables.keep(_common_tokens(named, parts), "jaccard-common")
    path = _indexed(named, common, parts, frequent, combined)
    tables.drop(common)
    read = lambda kind, columns: spark.read.schema(columns + ", kind string").parquet(path).where(F.col("kind") == kind).drop("kind")
    sets = tables.keep(read("set", "doc_id long, n long, sign_a long, sign_b long"), "jaccard-sets")
    pivots = tables.keep(_pivots(read("entry", _ENTRIES_SQL), parts), "jaccard-pivots")
    edges = _links(read("text", "doc_id long, text string"), pivots, parts, group, group_tokens, tables)
    delete(spark, path)

    filled = sets.where("n > 0").select("doc_id", "n", F.struct("sign_a", "sign_b").alias("sign"))
    classes = filled.groupBy("sign").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("group_size"))
    classes = tables.keep(classes, "jaccard-classes")
    rows = filled.count()
    member = tables.keep(join_by_key(filled, classes.select("sign", "first"), "sign", classes.select("sign", "group_size"), rows).drop("sign"), "jaccard-members")
    # Rows that repeat an id are in several classes, which it joins.
    repeated = member.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a <> b")
    twice = member.join(repeated.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    with settings(spark, TIDY):
        found = components(edges.unionByName(twice))
    sizes = classes.groupBy("first").agg(F.sum("group_size").alias("group_size"))
    known = sizes.join(found.withColumnRenamed("node", "first"), "first", "left").select("first", F.coalesce("component", "first").alias("component_id"))
    named_rows = join_by_key(member, known, "first", sizes, rows).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named_rows.unionByName(alone).unionByName(_nameless(docs))


def _nameless(docs: DataFrame) -> DataFrame:
    """The rows without an id: their sizes, and no component."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            n = np.diff(token_sets(block)[1])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(n), pa.nulls(len(n), pa.int64())], names=["doc_id", "n_shingles", "component_id"])

    return docs.where("doc_id is null").mapInArrow(size, "doc_id long, n_shingles long, component_id long")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, with all their columns."""
    gone = jaccard_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
