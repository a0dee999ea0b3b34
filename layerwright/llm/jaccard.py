"""Near-duplicate documents: a Jaccard join of shingle sets by parity sketches, and its connected components.

Sets link when ``100 * |A & B| >= 75 * |A | B|``, which is the same as ``7 * |A ^ B| <= |A| + |B|``: few shingles
differ. The steps:

1. Equal sets form a class, and one document stands for it.
2. Sizes fall into bands of ratio 4 to 3, so linked sets lie in one band or in neighbours; a document takes part in its own
   band's join and in the next one's. There its shingles are spread over half as many cells as the band's largest set has
   shingles, and a cell's key is the XOR of its shingles' hashes. Only cells that hold a differing shingle get another key, so by the
   pigeonhole principle linked sets agree on a cell that is not empty. Of many cells the first ``CELLS`` are used: a
   cell agrees with a chance of 0.43 at least, so all of them miss a link with one below 1e-15, over the choice of
   hashes, whatever the data. Sets of up to ``SMALL`` shingles have too few cells for that; their keys are the quarter of their
   shingles with the smallest hashes and one more, of which linked sets always share one.
3. Keys go through ``exchange``; a document keeps those that occur in other documents.
4. Documents that share a key compare parity sketches: bit vectors in which each shingle flips one bit. Two sketches differ
   in at most as many bits as the sets in shingles, so a pair beyond the bound is no link. What is left is sent on as a spanning
   forest, never as all pairs. Keys of more than ``TILE`` documents are dealt to pairs of tiles.
5. The forest's components are small groups that hold every link. In each, the sets themselves are compared, but for
   pairs that verified links connect already; groups beyond ``VERIFIED`` documents are dealt to pairs of tiles. The
   components of the verified links are the answer.

Defined cases: null and empty texts and texts without words have the empty set and link with nothing, not even each other; with fewer words than a
shingle, the words are one shingle; rows that repeat an id are documents of their own; null ids are never the
smallest; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from .components import components
from .exchange import by_block, dealt, in_order, raw_texts
from .hashing import grouped, mixed, words_of
from .shared import written

SHINGLE = 5
CELLS, SMALL, TILE = 64, 128, 8192
#: Documents of a group, and text bytes, that one verifying task takes.
VERIFIED, VERIFIED_BYTES = 1024, 1 << 20
_BOUNDS = [1]
while _BOUNDS[-1] < 1 << 40:
    _BOUNDS.append(_BOUNDS[-1] * 4 // 3 + 1)
BOUNDS = np.array(_BOUNDS, "int64")
QUESTION = "block int, batch int, keys binary, extra binary"
ANSWER = "batch int, block int, hits binary, times binary"


def sets_of(texts: list[bytes | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles in ascending order, and where each text's begin."""
    all_tokens, sizes = [], []
    for some in grouped(texts):
        words = words_of(texts[some], lower=True)
        at, tokens = words.windows(shingle)
        owner = words.owner[at]
        count = np.diff(words.first)
        short = np.flatnonzero((count > 0) & (count < shingle))
        tokens = np.concatenate([tokens, words.ranges(words.first[short], words.first[short + 1])])
        owner = np.concatenate([owner, short])
        order = np.lexsort((tokens, owner))
        tokens, owner = tokens[order], owner[order]
        fresh = (np.diff(tokens, prepend=~tokens[:1]) != 0) | (np.diff(owner, prepend=-1) != 0)
        all_tokens.append(tokens[fresh])
        sizes.append(np.bincount(owner[fresh], minlength=len(count)))
    first = np.zeros(len(texts) + 1, "int64")
    np.cumsum(np.concatenate(sizes) if sizes else [], out=first[1:])
    return np.concatenate(all_tokens) if all_tokens else np.zeros(0, "uint64"), first


def band_of(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(BOUNDS, sizes, "right") - 1


def largest_in(band: np.ndarray) -> np.ndarray:
    return BOUNDS[band + 1] - 1


def keys_of(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, band and key of each key of each set, for both bands that a set takes part in."""
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    found = []
    for step in (0, 1):
        band = band_of(np.maximum(sizes, 1)) + step
        largest = largest_in(band)
        salt = mixed(band.astype("uint64") + np.uint64(1 << 40))
        small = (largest <= SMALL)[owner]
        rank = np.arange(len(tokens)) - first[:-1][owner]
        at = np.flatnonzero(small & (rank <= sizes[owner] // 4))
        found.append((owner[at], band[owner[at]], mixed(tokens[at] ^ salt[owner[at]])))
        at = np.flatnonzero(~small)
        cells = ((largest + 1) // 2).astype("uint64")
        cell = ((mixed(tokens[at] + salt[owner[at]]) >> np.uint64(32)) * cells[owner[at]]) >> np.uint64(32)
        used = cell < CELLS
        at, cell = at[used], cell[used].astype("int64")
        place = owner[at] * CELLS + cell
        order = np.argsort(place, kind="stable")
        place = place[order]
        begin = np.flatnonzero(np.diff(place, prepend=-1))
        if len(begin):
            folded = np.bitwise_xor.reduceat(tokens[at[order]], begin)
            of, cell = place[begin] // CELLS, place[begin] % CELLS
            found.append((of, band[of], mixed(folded ^ mixed(salt[of] + cell.astype("uint64") + np.uint64(1)))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def sketch_words(band: int) -> int:
    """64-bit words of a sketch: three bits for every two shingles of the band's largest set."""
    return -(-int(largest_in(np.array(band))) * 3 // 128)


def sketch(tokens: np.ndarray, band: int) -> np.ndarray:
    bits = 64 * sketch_words(band)
    flipped = np.bincount((mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(bits)).astype("int64"), minlength=bits) & 1
    return np.packbits(flipped.astype("uint8")).view("uint64")


def most_differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The greatest symmetric difference that linked sets of these sizes can have."""
    return (a + b) // 7


class _Batch:
    def __init__(self, docs: pa.Table):
        self.docs = in_order(docs)
        self.texts = raw_texts(self.docs)
        self.batch = docs.column("batch")[0].as_py() if docs.num_rows else -1
        self.tokens, self.first = sets_of(self.texts)
        sizes = np.diff(self.first)
        # Sums of two mixes of the shingles name a set.
        total = lambda x: np.where(sizes > 0, np.add.reduceat(np.append(x, np.uint64(0)), np.minimum(self.first[:-1], len(x))), np.uint64(0))
        self.sizes = sizes
        self.name = np.stack([mixed(total(mixed(self.tokens)) + sizes.astype("uint64")), total(mixed(self.tokens ^ np.uint64(0xA0761D6478BD642F)))], 1) if len(sizes) else np.zeros((0, 2), "uint64")
        # The first document of each set in the batch speaks for it.
        filled = np.flatnonzero(sizes > 0)
        _, at = np.unique(self.name[filled], axis=0, return_index=True) if len(filled) else (None, filled)
        self.speakers = np.sort(filled[at])
        owner, band, key = keys_of(self.tokens, self.first)
        spoken = np.isin(owner, self.speakers)
        self.owner, self.band, self.key = owner[spoken], band[spoken], key[spoken]
        self.keys, self.key_at, self.times = np.unique(self.key, return_inverse=True, return_counts=True)

    def questions(self, blocks: int) -> pa.Table:
        """Keys with their numbers of sets go to block 0 and up, names of sets to block -1 and down."""
        asked = [(b, self.keys[p].astype("<u8").tobytes(), np.minimum(self.times[p], 65535).astype("<u2").tobytes()) for b, p in by_block(self.keys, blocks)]
        low, high = self.name[self.speakers, 0], self.name[self.speakers, 1]
        asked += [(-1 - b, low[p].astype("<u8").tobytes(), high[p].astype("<u8").tobytes()) for b, p in by_block(low, blocks)]
        columns = list(zip(*asked, strict=True)) or [[], [], []]
        return pa.table(
            {
                "block": pa.array(columns[0], pa.int32()),
                "batch": pa.array([self.batch] * len(asked), pa.int32()),
                "keys": pa.array(columns[1], pa.binary()),
                "extra": pa.array(columns[2], pa.binary()),
            }
        )


def _tally(block: pa.Table) -> pa.Table:
    """For a list of keys: which occur in two sets or more, and in how many; for a list of names: which are this batch's to stand for."""
    block = block.take(pa.array(np.argsort(block.column("batch").to_numpy(), kind="stable")))
    number = block.column("block")[0].as_py()
    lists = [np.frombuffer(k, "<u8") for k in block.column("keys").to_pylist()]
    extra = np.concatenate([np.frombuffer(k, "<u8" if number < 0 else "<u2") for k in block.column("extra").to_pylist()])
    keys, sizes = np.concatenate(lists), [len(k) for k in lists]
    if number < 0:
        order = np.lexsort((np.arange(len(keys)), extra, keys))
        k, e = keys[order], extra[order]
        hit = np.zeros(len(keys), bool)
        hit[order] = (np.diff(k, prepend=~k[:1]) != 0) | (np.diff(e, prepend=~e[:1]) != 0)
        times = np.ones(len(keys), "int64")
    else:
        _, back = np.unique(keys, return_inverse=True)
        times = np.bincount(back, weights=extra).astype("int64")[back]
        hit = times > 1
    out, at = [], 0
    for n in sizes:
        hits = np.flatnonzero(hit[at : at + n])
        out.append((hits.astype("<u4").tobytes(), times[at + hits].astype("<u8").tobytes()))
        at += n
    return pa.table(
        {
            "batch": block.column("batch"),
            "block": block.column("block"),
            "hits": pa.array([h for h, _ in out], pa.binary()),
            "times": pa.array([t for _, t in out], pa.binary()),
        }
    )


def _signed(dealt_docs: DataFrame, blocks: int, all_texts: bool) -> DataFrame:
    """A row for each document: the other columns, the set's size and name; for a class's document its number; and if that shares
    keys with others its text, and the keys' bands, hashes and numbers of sets. ``all_texts`` adds the text of each row."""
    schema = StructType(
        [
            StructField("row", dealt_docs.schema["row"].dataType),
            *(StructField(n, LongType()) for n in ("size", "low", "high", "ref")),
            StructField("raw", BinaryType()),
            *(StructField(n, BinaryType()) for n in ("bands", "keys", "times")),
            StructField("stands", BooleanType()),
        ]
    )

    def ask(docs: pa.Table) -> pa.Table:
        return _Batch(docs).questions(blocks)

    def sign(docs: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Batch(docs)
        key_places, name_places = dict(by_block(b.keys, blocks)), dict(by_block(b.name[b.speakers, 0], blocks))
        times, stands = np.zeros(len(b.keys), "int64"), np.zeros(len(b.texts), bool)
        for r in replies.to_pylist():
            hits = np.frombuffer(r["hits"], "<u4")
            if r["block"] < 0:
                stands[b.speakers[name_places[-1 - r["block"]][hits]]] = True
            else:
                times[key_places[r["block"]][hits]] = np.frombuffer(r["times"], "<u8")
        shared = np.flatnonzero((times[b.key_at] > 1) & stands[b.owner])
        shared = shared[np.argsort(b.owner[shared], kind="stable")]
        cut = np.searchsorted(b.owner[shared], np.arange(len(b.texts) + 1))
        part = lambda x, kind: [x[shared[i:j]].astype(kind).tobytes() if j > i else None for i, j in zip(cut, cut[1:], strict=False)]
        meets = np.diff(cut) > 0
        refs = (np.int64(max(b.batch, 0)) << np.int64(32)) | np.arange(len(b.texts))
        return pa.table(
            {
                "row": b.docs.column("row"),
                "size": pa.array(b.sizes, pa.int64()),
                "low": pa.array(b.name[:, 0].astype("int64"), mask=b.sizes == 0),
                "high": pa.array(b.name[:, 1].astype("int64"), mask=b.sizes == 0),
                "ref": pa.array(refs, pa.int64(), mask=~stands),
                "raw": b.docs.column("raw") if all_texts else pa.array([t if m else None for t, m in zip(b.texts, meets, strict=True)], pa.binary()),
                "bands": pa.array(part(b.band, "<u2"), pa.binary()),
                "keys": pa.array(part(b.key, "<u8"), pa.binary()),
                "times": pa.array(part(times[b.key_at], "<u8"), pa.binary()),
                "stands": pa.array(stands),
            }
        )

    batches = dealt_docs.groupBy("batch")
    replies = batches.applyInArrow(ask, QUESTION).groupBy("block").applyInArrow(_tally, ANSWER)
    return batches.cogroup(replies.groupBy("batch")).applyInArrow(sign, schema)


def tiled(key: int, times: int, ref: int, tile: int) -> list[int]:
    """The key itself, or for a key of many documents a key for each pair of tiles that the document's tile is in."""
    tiles = -(-times // tile)
    if tiles <= 1:
        return [key]
    own = int(mixed(np.array([ref], "uint64"))[0]) % tiles
    pairs = [min(own, i) * tiles + max(own, i) + 1 for i in range(tiles)]
    return [int(mixed(np.array([(key + p * 0x9E3779B97F4A7C15) % (1 << 64)], "uint64"))[0]) for p in pairs]


def _entries(signed: DataFrame, blocks: int, tile: int) -> DataFrame:
    """Packed lists of key, document, size, band and sketch for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            tokens, first = sets_of(rows["raw"])
            keys, refs, sizes, bands, sketches = [], [], [], [], []
            for i, ref in enumerate(rows["ref"]):
                mine = tokens[first[i] : first[i + 1]]
                own_bands = np.frombuffer(rows["bands"][i], "<u2").tolist()
                drawn = {b: sketch(mine, b).tobytes() for b in set(own_bands)}
                own_keys, own_times = np.frombuffer(rows["keys"][i], "<u8"), np.frombuffer(rows["times"][i], "<u8")
                dealt_keys = [[k] for k in own_keys.tolist()] if own_times.max() <= tile else [tiled(k, t, ref, tile) for k, t in zip(own_keys.tolist(), own_times.tolist(), strict=True)]
                for b, some in zip(own_bands, dealt_keys, strict=True):
                    keys += some
                    bands += [b] * len(some)
                    sketches += [drawn[b]] * len(some)
                    refs += [ref] * len(some)
                    sizes += [len(mine)] * len(some)
            parts = by_block(np.array(keys, "uint64"), blocks)
            pick = lambda x, kind: [np.asarray(x, kind)[p].tobytes() for _, p in parts]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _ in parts], pa.int32()),
                    pa.array(pick(keys, "<u8"), pa.binary()),
                    pa.array(pick(refs, "<i8"), pa.binary()),
                    pa.array(pick(sizes, "<i8"), pa.binary()),
                    pa.array(pick(bands, "<u2"), pa.binary()),
                    pa.array([b"".join([sketches[i] for i in p]) for _, p in parts], pa.binary()),
                ],
                names=["block", "keys", "refs", "sizes", "bands", "sketches"],
            )

    schema = "block int, keys binary, refs binary, sizes binary, bands binary, sketches binary"
    return signed.where("keys IS NOT NULL").select("ref", "raw", "bands", "keys", "times").mapInArrow(run, schema)


class Forest:
    """Disjoint sets of documents; remembers the pairs that joined two."""

    def __init__(self):
        self.above: dict[int, int] = {}
        self.pairs: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        above = self.above
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> None:
        one, two = self.root(a), self.root(b)
        if one != two:
            self.above[max(one, two)] = min(one, two)
            self.pairs.append((a, b))

    def table(self) -> pa.Table:
        return pa.table({"a": pa.array([a for a, _ in self.pairs], pa.int64()), "b": pa.array([b for _, b in self.pairs], pa.int64())})


def grown(n: int, labels: np.ndarray, linked) -> Iterator[tuple[int, int]]:
    """Pairs that join all linked members of a group. ``linked(i, others)`` tells which of ``others`` member i is linked to; asked
    only about members that are not joined with i yet."""
    labels = labels.copy()
    for i in range(n - 1):
        others = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
        if not len(others):
            if (labels == labels[i]).all():
                return
            continue
        met = others[linked(i, others)]
        if len(met):
            groups, at = np.unique(labels[met], return_index=True)
            for j in met[at].tolist():
                yield i, j
            labels[np.isin(labels, groups)] = labels[i]


def _survivors(block: pa.Table) -> pa.Table:
    """A spanning forest of the pairs that share a key and whose sketches allow a link."""
    table = block.to_pydict()
    joined = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table[name]])
    keys, refs, sizes, bands = joined("keys", "<u8"), joined("refs", "<i8"), joined("sizes", "<i8"), joined("bands", "<u2")
    raw = np.frombuffer(b"".join(table["sketches"]), "<u8")
    width = np.array([sketch_words(b) for b in range(int(bands.max()) + 1)])[bands]
    at = np.cumsum(width) - width
    order = np.lexsort((refs, keys))
    begin = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
    forest = Forest()
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
        if hi - lo < 2:
            continue
        members = order[lo:hi]
        if hi - lo == 2 and refs[members[0]] == refs[members[1]]:
            continue
        labels = np.array([forest.root(r) for r in refs[members].tolist()])
        if (labels == labels[0]).all():
            continue
        w = int(width[members[0]])
        sketches = raw[at[members][:, None] + np.arange(w)]
        size = sizes[members]

        def near(i: int, others: np.ndarray, sketches=sketches, size=size) -> np.ndarray:
            differing = np.bitwise_count(sketches[others] ^ sketches[i]).sum(1, dtype="int64")
            return differing <= most_differing(size[others], size[i])

        for i, j in grown(hi - lo, labels, near):
            forest.join(int(refs[members[i]]), int(refs[members[j]]))
    return forest.table()


def _verified(bucket: pa.Table) -> pa.Table:
    """A spanning forest of the true links inside each group of a bucket."""
    table = bucket.to_pydict()
    tokens, first = sets_of(table["raw"])
    refs, groups = np.array(table["ref"], "int64"), np.array(table["part"], "int64")
    order = np.lexsort((refs, groups))
    begin = np.flatnonzero(np.diff(groups[order], prepend=~groups[order[:1]]))
    forest = Forest()
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
        members = order[lo:hi]
        size = first[members + 1] - first[members]
        flat = np.concatenate([tokens[first[m] : first[m + 1]] for m in members])
        _, flat = np.unique(flat, return_inverse=True)
        cut = np.concatenate([[0], np.cumsum(size)])
        mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)

        def linked(i: int, others: np.ndarray, flat=flat, cut=cut, size=size, mark=mark) -> np.ndarray:
            mine = flat[cut[i] : cut[i + 1]]
            mark[mine] = True
            lengths = size[others]
            ends = np.cumsum(lengths)
            at = np.repeat(cut[others] - (ends - lengths), lengths) + np.arange(ends[-1])
            both = np.add.reduceat(mark[flat[at]], ends - lengths, dtype="int64")
            mark[mine] = False
            return 100 * both >= 75 * (lengths + size[i] - both)

        for i, j in grown(len(members), np.arange(len(members)), linked):
            forest.join(int(refs[members[i]]), int(refs[members[j]]))
    return forest.table()


def _linked(signed: DataFrame, blocks: int, tile: int) -> DataFrame:
    """``node`` and ``component`` of the numbers of all documents that verified links join with others."""
    forest = _entries(signed, blocks, tile).groupBy("block").applyInArrow(_survivors, "a bigint, b bigint")
    groups = components(forest, "a", "b")
    texts = signed.where("keys IS NOT NULL").select("ref", "raw")
    held = texts.join(groups, F.col("ref") == F.col("node"))
    counts = groups.groupBy(F.col("component").alias("of")).agg(F.ceil(F.count("node") / min(tile, VERIFIED)).cast("bigint").alias("tiles"))
    held = held.join(counts, F.col("component") == F.col("of"))
    own = F.pmod(F.xxhash64("ref"), F.col("tiles"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda i: F.struct(F.least(own, i).alias("i"), F.greatest(own, i).alias("j")))
    held = held.select("ref", "raw", "component", F.explode(pair).alias("pair")).select("ref", "raw", F.xxhash64("component", "pair.i", "pair.j").alias("part"))
    total = texts.agg(F.sum(F.octet_length("raw").cast("bigint"))).first()[0] or 0
    buckets = max(1, -(-total // VERIFIED_BYTES))
    held = held.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(buckets)))
    return components(held.groupBy("bucket").applyInArrow(_verified, "a bigint, b bigint"), "a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """The columns of ``docs`` but ``text`` as ``row``, with ``n_shingles``, ``class_low`` and ``class_high`` (the name of the set, null if
    empty) and ``component_id``: the smallest id that links reach."""
    dealt_docs, _, blocks = dealt(docs, id_col, text)
    signed = written(_signed(dealt_docs, blocks, False), "signed")
    joined = _linked(signed, blocks, tile)
    # The name of a class is enough to find its component; the smallest ids are summed up before they are spread.
    classes = signed.where("low IS NOT NULL").groupBy("low", "high").agg(F.min(F.col("row").getField(id_col)).alias("least"), F.max("ref").alias("ref"))
    classes = classes.join(joined, F.col("ref") == F.col("node"), "left").withColumn("of", F.coalesce("component", "ref"))
    classes = written(classes.select(F.col("low").alias("class_low"), F.col("high").alias("class_high"), "least", "of"), "classes")
    least = classes.groupBy("of").agg(F.min("least").alias("component_id"))
    named = written(classes.join(least, "of").select("class_low", "class_high", "component_id"), "named")
    same = (F.col("low") == F.col("class_low")) & (F.col("high") == F.col("class_high"))
    component = F.when(F.col("low").isNull(), F.col("row").getField(id_col)).otherwise(F.col("component_id"))
    found = signed.select("row", "size", "low", "high").join(named, same, "left")
    return found.select("row", F.col("size").alias("n_shingles"), F.col("low").alias("class_low"), F.col("high").alias("class_high"), component.alias("component_id"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """``docs`` with one document of each group of equal or linked sets; all documents of the empty set stay.

    A class's own document is known when the rows are written, so only documents that share keys with others meet the links.
    """
    dealt_docs, _, blocks = dealt(docs, id_col, text)
    signed = written(_signed(dealt_docs, blocks, True), "signed")
    joined = _linked(signed, blocks, tile)
    alone = signed.where("low IS NULL OR (stands AND keys IS NULL)").select("row", "raw")
    met = signed.where("keys IS NOT NULL").select("row", "raw", "ref").join(joined.where("node != component"), F.col("ref") == F.col("node"), "left_anti")
    kept = alone.unionByName(met.select("row", "raw"))
    return kept.select(*[F.col("raw").cast("string").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
