"""Repeated paragraphs and passages: MinHash banding, exact verification, components, removal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnkit.llm import _words, superminhash
from cairnkit.llm._util import bounded, by_key, cut, fresh, int64s, linked, mix, signed, small
from cairnkit.llm.components import components
from cairnkit.llm.near_dedup import collided, collisions

MIN_WORDS = 50
PARAGRAPH_WORDS = 20
THRESHOLD = 0.7
BANDS, ROWS, SHINGLE = 12, 3, 3
RUN = 8  # words of the shingles of a sliding sub-paragraph
PERIOD = 8  # a shingle that comes again within so many words isn't drawn twice
ASK = 24  # words beyond a match that are compared at once
HOT_ENDS = 10_000


def paragraphs(docs: DataFrame, min_words: int = PARAGRAPH_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, end, words, cluster, keep_doc_id, keep_start) of the paragraphs to remove.

    A paragraph is a line of at least min_words words and, in a text with lines that hold no
    word, also a run of several lines between such lines, so that hard-wrapped paragraphs are
    compared as wholes. start and end are the character offsets of its first and last word.
    Paragraphs whose 3-word runs collide in one of 12 bands of 3 SuperMinHash slots (found
    with probability 0.993 at similarity 0.7) are joined, their exact Jaccard similarity is
    compared with the threshold, and the components of what passes are clusters. All of a
    cluster but its first, by doc_id and start, is to be removed; what overlaps the first (a
    line of a paragraph that is kept) isn't.
    """
    slots = BANDS * ROWS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for w in _words.blocks(batch.column(1), spans=True):
                opens, ends = _paragraphs(w, min_words)
                if not len(opens):
                    continue
                sizes = ends - opens
                starts = np.concatenate(([0], np.cumsum(sizes)))
                hashes = w.hashes[np.repeat(opens - starts[:-1], sizes) + np.arange(starts[-1])]
                items, at = _words.shingles(hashes, starts, SHINGLE)
                keys = superminhash.band_keys(superminhash.signatures(items, at, slots), BANDS)
                one, two = _words.sequence_hashes(hashes, starts)
                short = (items >> np.uint64(32)).astype(np.uint32)
                packed = [np.unique(short[at[i] : at[i + 1]]).tobytes() for i in range(len(sizes))]
                row = np.searchsorted(w.starts, opens, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[w.first + row]), pa.array(w.begin[opens]), pa.array(w.end[ends - 1]), pa.array(sizes), pa.array(signed(one)), pa.array(signed(two)), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(packed, pa.binary())],
                    ["doc_id", "start", "end", "words", "h1", "h2", "keys", "items"],
                )

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h1, at = np.unique(int64s(batch.column(0)), return_index=True)
                keys = np.frombuffer(b"".join(batch.column(1).take(pa.array(at)).to_pylist()), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(h1, BANDS))], ["key", "item"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    table = cut(bounded(named).mapInArrow(scan, "doc_id long, start long, end long, words long, h1 long, h2 long, keys binary, items binary"))
    pairs = cut(collisions(table.select("h1", "keys").mapInArrow(band, "key long, item long")))
    known = table.join(collided(pairs), "h1", "left_semi").groupBy("h1").agg(F.first("items").alias("items"))
    shipped = pairs.join(known, pairs["item"] == known["h1"]).select("bucket", "item", "items").repartition("bucket").sortWithinPartitions("bucket", "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in by_key(batches, "bucket"):
            item = t.column("item").to_numpy()
            sets = [np.frombuffer(x, dtype=np.uint32) for x in t.column("items").to_pylist()]
            forest = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                forest += [(a + s, b + s) for a, b in linked(e - s, lambda i, rest, part=sets[s:e]: jaccard(part[i], [part[r] for r in rest]) >= threshold)]
            if forest:
                x = np.array(forest)
                yield pa.RecordBatch.from_arrays([pa.array(item[x[:, 0]]), pa.array(item[x[:, 1]])], ["a", "b"])

    roots = small(cut(components(shipped.mapInArrow(verify, "a long, b long"))))
    slim = table.select("doc_id", "start", "end", "words", "h1")
    placed = slim.join(roots, slim["h1"] == roots["node"], "left").withColumn("cluster", F.coalesce("root", "h1"))
    first = placed.groupBy("cluster").agg(F.min(F.struct("doc_id", "start", "end")).alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = placed.join(first, "cluster").where("first.doc_id <> doc_id or start >= first.end or end <= first.start")
    return marked.select("doc_id", "start", "end", "words", "cluster", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.start").alias("keep_start"))


def _paragraphs(w: _words.Words, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First words, and words after the last, of the paragraphs."""
    n = len(w.hashes)
    opens = np.flatnonzero(w.newline)
    ends = np.append(opens[1:], n)
    if w.gap.any():
        heads = w.gap.copy()
        heads[w.starts[:-1][w.starts[:-1] < n]] = True
        first = np.flatnonzero(heads)
        last = np.append(first[1:], n)
        row = np.searchsorted(w.starts, first, side="right") - 1
        upto = np.concatenate(([0], np.cumsum(w.gap)))
        gaps = upto[w.starts[row + 1]] - upto[w.starts[row]]
        lines = np.add.reduceat(w.newline.astype(np.int64), first)
        whole = (lines > 1) & (gaps > 0)
        opens, ends = np.concatenate([opens, first[whole]]), np.concatenate([ends, last[whole]])
    long = ends - opens >= min_words
    return opens[long], ends[long]


def jaccard(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Exact similarities of a sorted set to other non-empty sorted sets."""
    sizes = np.array([len(x) for x in others])
    at = np.concatenate(([0], np.cumsum(sizes[:-1])))
    every = np.concatenate(others)
    spot = np.minimum(np.searchsorted(one, every), len(one) - 1)
    shared = np.add.reduceat((one[spot] == every).astype(np.int64), at)
    return shared / (len(one) + sizes - shared)


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, end, kind, words, cluster, keep_doc_id, keep_start) of repeated passages to remove.

    Finds passages that repeat inside longer paragraphs, which a paragraph's own similarity
    is too low to show. Here every run of min_words words is a sub-paragraph, and one band of
    one slot its signature: the least hash of its 8-word shingles. Equal runs have the same
    one, so that no passage of min_words or more is missed. As a minimum lasts over many
    overlapping runs, about one word in 22 is drawn. Each shingle drawn is keyed with the
    half of the run's other words that follow it, and with the half that go before, one of
    which lies inside the passage wherever in it the shingle is. Sub-paragraphs of equal keys
    match the first of them by doc_id and place, and from the third instance in one text on
    the one before it, so that a text of equal lines gives few runs. One shuffle of a hash and
    three numbers for each key.

    Matches are verified and extended word by word against that instance, to the left and to
    the right, until the words differ or a text ends: what is to be removed is the longest
    equal run, whatever line breaks it holds. A run may so have fewer than min_words words,
    but at least those of a key: (min_words + 8) / 2. The instance that keep_doc_id and
    keep_start name may be removed in turn for a still earlier one; the first of all stays.
    A shingle that comes again within 8 words is drawn once: text that repeats itself at so
    short a distance is left to the quality rules.
    """
    if min_words < 2:
        raise ValueError("min_words must be 2 or more")
    run = min(RUN, max(1, min_words // 2))
    size = run + (min_words - run) // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for w in _words.blocks(batch.column(1), spans=True):
                key, a = _windows(w, min_words, run)
                if len(key):
                    row = np.searchsorted(w.starts, a, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[w.first + row]), pa.array(_tags(w)[row]), pa.array((a - w.starts[row]).astype(np.int32))], ["key", "doc_id", "tag", "at"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in by_key(batches, "key"):
            first = np.repeat(starts[:-1], np.diff(starts))
            key, doc, tag, at = (t.column(c).to_numpy() for c in ("key", "doc_id", "tag", "at"))
            rest = np.flatnonzero((doc != doc[first]) | (tag != tag[first]) | (at != at[first]))
            if len(rest):
                # rows of equal doc_id and text give the same window again and again
                new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] != at[:-1]))
                rest = rest[new[rest]]
                two = np.maximum(rest - 2, first[rest])
                head = np.where((doc[two] == doc[rest]) & (tag[two] == tag[rest]) & (rest - 2 >= first[rest]), rest - 1, first[rest])
                columns = {"doc_id": doc[rest], "tag": tag[rest], "at": at[rest], "cluster": key[rest], "keep_doc_id": doc[head], "keep_tag": tag[head], "keep_at": at[head]}
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found = bounded(named).mapInArrow(scan, "key long, doc_id long, tag int, at int")
    ordered = found.repartition("key").sortWithinPartitions("key", "doc_id", "tag", "at")
    matched = ordered.mapInArrow(mark, "doc_id long, tag int, at int, cluster long, keep_doc_id long, keep_tag int, keep_at int")
    return _extended(named, _runs(matched, size))


def _tags(w: _words.Words) -> np.ndarray:
    """32 bits of the words of each row, which tell texts apart that share a doc_id."""
    return (_words.sequence_hashes(w.hashes, w.starts)[0] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _runs(matched: DataFrame, size: int) -> DataFrame:
    """Matches of `size` words that overlap at the same distance from their first instance, joined to runs of words at .. to - 1."""
    place = ("doc_id", "tag", "keep_doc_id", "keep_tag", "shift")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in by_key(batches, "doc_id"):
            flat = {c: t.column(c).to_numpy() for c in (*place, "at", "cluster")}
            new = np.ones(t.num_rows, dtype=bool)
            new[1:] = np.any([flat[c][1:] != flat[c][:-1] for c in place], axis=0)
            lane = np.cumsum(new) << 33
            at = flat["at"] + lane
            upto = np.maximum.accumulate(at + size)
            new[1:] |= at[1:] > upto[:-1]
            opens = np.flatnonzero(new)
            last = np.append(opens[1:], t.num_rows) - 1
            columns = {c: flat[c][opens] for c in (*place, "at", "cluster")} | {"to": upto[last] - lane[last]}
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))

    far = matched.withColumn("shift", F.col("at").cast("long") - F.col("keep_at"))
    ordered = far.select(*place, F.col("at").cast("long").alias("at"), "cluster").repartition("doc_id").sortWithinPartitions(*place, "at")
    merged = ordered.mapInArrow(merge, "doc_id long, tag int, keep_doc_id long, keep_tag int, shift long, at long, cluster long, to long")
    return cut(merged.withColumn("run", F.monotonically_increasing_id()))


PLACE, KEPT = ("doc_id", "tag", "spot"), ("keep_doc_id", "keep_tag", "keep_spot")


def _extended(named: DataFrame, runs: DataFrame) -> DataFrame:
    """Spans of the runs, each made as long as its words and those of the first instance are equal.

    Each end of a run asks both texts for the words beyond it, 24 at first; ends that are
    equal so far ask for 16 times as many from where they have come, and so on.
    """
    ends = [runs.select("run", F.lit(side).alias("side"), "doc_id", "tag", F.expr(spot).alias("spot"), "keep_doc_id", "keep_tag", F.expr(f"{spot} - shift").alias("keep_spot")) for side, spot in ((0, "at"), (1, "to - 1"))]
    todo, ready, ask = ends[0].union(ends[1]), [], ASK
    while True:
        met = cut(_met(named, todo, ask))
        ready.append(met.where("not more"))
        todo = met.where("more").select("run", "side", *PLACE, *KEPT)
        if todo.isEmpty():
            break
        ask *= 16
    settled = ready[0]
    for more in ready[1:]:
        settled = settled.union(more)
    side = [F.max(F.when(F.col("side") == k, F.col(c))).alias(name) for k, c, name in ((0, "spot", "first"), (0, "offset", "start"), (0, "keep_offset", "keep_start"), (1, "spot", "last"), (1, "offset", "end"))]
    both = settled.groupBy("run", "doc_id", "tag", "keep_doc_id", "keep_tag").agg(*side)
    whole = both.join(runs.select("run", "cluster"), "run").where("start is not null and end is not null").withColumn("words", F.col("last") - F.col("first") + 1)
    # runs of one passage parted by a stretch without keys have grown to the same span
    once = whole.groupBy("doc_id", "tag", "start", "end", "words", "keep_doc_id", "keep_tag", "keep_start").agg(F.min("cluster").alias("cluster"))
    return once.select("doc_id", "start", "end", F.lit("passage").alias("kind"), "words", "cluster", "keep_doc_id", "keep_start")


def _met(named: DataFrame, ends: DataFrame, ask: int) -> DataFrame:
    """ends moved outward over at most `ask` equal words, with their character offsets; more tells that all were equal.

    The words of both texts meet in one shuffle by the kept place, which gives its words once,
    or once for each 10,000 ends that ask for them, so that a much repeated text is no
    task's alone. What a text is asked for is bounded by its own words.
    """
    hot = ends.groupBy(*KEPT, "side").agg(F.ceil(F.count("*") / HOT_ENDS).cast("int").alias("salts"))
    own = ends.join(hot, [*KEPT, "side"]).withColumn("salt", F.pmod(F.xxhash64("run"), F.col("salts")).cast("int"))
    kept = hot.select(*KEPT, "side", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rest = ["side", "salt", *KEPT]
    asks = own.select(F.col("doc_id").alias("id"), F.struct("tag", "spot", "run", *rest).alias("ask"))
    asks = asks.union(kept.select(F.col("keep_doc_id").alias("id"), F.struct(F.col("keep_tag").alias("tag"), F.col("keep_spot").alias("spot"), F.lit(-1).cast("long").alias("run"), *rest).alias("ask")))
    asks = small(cut(asks.groupBy("id").agg(F.collect_list("ask").alias("asks"))))

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = batch.column(0).to_numpy(), batch.column(2)
            flat, bounds = asked.flatten(), np.concatenate(([0], np.cumsum(asked.value_lengths().to_numpy())))
            tag, spot, side = (flat.field(c).to_numpy() for c in ("tag", "spot", "side"))
            for w in _words.blocks(batch.column(1), spans=True):
                tags, short = _tags(w), (w.hashes >> np.uint64(32)).astype(np.uint32)
                begin, end = w.begin.astype(np.int32), w.end.astype(np.int32)
                low, high = int(bounds[w.first]), int(bounds[w.first + w.rows])
                row = np.repeat(np.arange(w.rows), np.diff(bounds[w.first : w.first + w.rows + 1]))
                at = w.starts[row] + spot[low:high]
                pick = np.flatnonzero((tag[low:high] == tags[row]) & (at < w.starts[row + 1]))
                hashes, offsets = [], []
                for r, k, s in zip(row[pick].tolist(), at[pick].tolist(), side[low:high][pick].tolist(), strict=True):
                    if s:
                        upto = min(int(w.starts[r + 1]), k + ask + 1)
                        hashes.append(short[k:upto].tobytes())
                        offsets.append(end[k:upto].tobytes())
                    else:
                        since = max(int(w.starts[r]), k - ask)
                        hashes.append(short[since : k + 1][::-1].tobytes())
                        offsets.append(begin[since : k + 1][::-1].tobytes())
                if len(pick):
                    mine = flat.take(pa.array(low + pick))
                    columns = {"doc_id": pa.array(ids[w.first + row[pick]])} | {c: mine.field(c) for c in ("tag", "spot", "run", *rest)}
                    yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(hashes, pa.binary()), pa.array(offsets, pa.binary())], [*columns, "hashes", "offsets"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashes, offsets = None, b"", b""
        for batch in batches:
            numbers = {c: batch.column(c).to_numpy() for c in ("run", "side", *PLACE, *KEPT)}
            place = list(zip(*(batch.column(c).to_pylist() for c in rest), strict=True))
            moved, offset, keep_offset = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, (run, mine, at) in enumerate(zip(numbers["run"].tolist(), batch.column("hashes").to_pylist(), batch.column("offsets").to_pylist(), strict=True)):
                if run < 0:
                    now, hashes, offsets = place[i], mine, at
                elif place[i] == now:
                    n = min(len(mine), len(hashes)) // 4
                    apart = np.flatnonzero(np.frombuffer(mine, np.uint32, n) != np.frombuffer(hashes, np.uint32, n))
                    moved[i] = n = int(apart[0]) if len(apart) else n
                    if n:
                        offset[i], keep_offset[i] = (int.from_bytes(x[4 * n - 4 : 4 * n], "little") for x in (at, offsets))
            out = np.where(numbers["side"] == 1, 1, -1) * (moved - 1)
            columns = numbers | {"spot": numbers["spot"] + out, "keep_spot": numbers["keep_spot"] + out, "offset": offset, "keep_offset": keep_offset, "more": moved > ask}
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns)).filter(pa.array(moved > 0))

    texts = named.join(asks, named["doc_id"] == asks["id"]).select("doc_id", "text", "asks")
    numbers = "doc_id long, tag int, spot long, run long, side int, salt int, keep_doc_id long, keep_tag int, keep_spot long"
    given = bounded(texts).mapInArrow(beyond, f"{numbers}, hashes binary, offsets binary").repartition(*rest).sortWithinPartitions(*rest, "run")
    found = given.mapInArrow(compare, "run long, side int, doc_id long, tag int, spot long, keep_doc_id long, keep_tag int, keep_spot long, offset long, keep_offset long, more boolean")
    return found.dropDuplicates(["run", "side"])  # rows of equal doc_id and text answer alike


def _windows(w: _words.Words, min_words: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, first word) of the keys of the shingles drawn: the least of each run of min_words words."""
    n = len(w.hashes)
    none = np.zeros(0, np.int64)
    m, wide, half = n - run + 1, min_words - run + 1, (min_words - run) // 2
    if n < min_words:
        return none, none
    shingle = np.zeros(m, dtype=np.uint64)
    for k in range(run):
        shingle += w.hashes[k : m + k] * np.uint64((0x9FB21C651E98DF25 * (2 * k + 1)) % 2**64 | 1)
    mix(shingle)
    # the place in the low bits: a minimum tells where it is, and no two are equal
    place = np.uint64((1 << int(m).bit_length()) - 1)
    value = (shingle & ~place) | np.arange(m, dtype=np.uint64)
    most = np.uint64(2**64 - 1)
    for k in range(1, min(PERIOD, m - 1) + 1):
        value[k:][shingle[k:] == shingle[:-k]] = most
    least = _sliding_least(value, wide)
    row = w.row_of_word()
    whole = row[: m - wide + 1] == row[min_words - 1 :]
    least = least[whole & (least != most)]
    if not len(least):
        return none, none
    at = (least[np.append(True, least[1:] != least[:-1])] & place).astype(np.int64)
    low, high = w.starts[row[at]], w.starts[row[at] + 1]
    power, inverse = _words._power(n + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w.hashes * power[:n], dtype=np.uint64)))
    keys, begins = [], []
    for salt, left in enumerate((0, half)):
        a = at - left
        z = a + run + half
        inside = (a >= low) & (z <= high)
        a, z = a[inside], z[inside]
        keys.append(mix((total[z] - total[a]) * inverse[a] + np.uint64(salt)))
        begins.append(a)
    return signed(np.concatenate(keys)), np.concatenate(begins)


def _sliding_least(value: np.ndarray, wide: int) -> np.ndarray:
    """The least of each `wide` values in a row: of what is left of one cell and what has come of the next."""
    cells = -(-len(value) // wide)
    padded = np.full(cells * wide, 2**64 - 1, dtype=np.uint64)
    padded[: len(value)] = value
    grid = padded.reshape(cells, wide)
    come = np.minimum.accumulate(grid, axis=1).ravel()
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(value) - wide + 1
    return np.minimum(left[:count], come[wide - 1 : wide - 1 + count])


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, paragraph_words: int = PARAGRAPH_WORDS) -> DataFrame:
    """(doc_id, start, end, kind, words, cluster, keep_doc_id, keep_start): all spans to remove.

    The union of paragraphs() and passages(), told apart by kind; start and end are
    character offsets, spans of a document may overlap, and the kept first instance of a
    cluster is named by keep_doc_id and keep_start. Paragraphs have at least paragraph_words
    words, passages are sought by runs of min_words. A passage repeated within one document
    counts as well. Repeated rows of one doc_id are one document: equal spans are told once
    and the first row's are kept.

    Rows with null doc_ids or texts, and texts of fewer words, have no spans. Only doc_id
    and text are read.
    """
    one = paragraphs(docs, paragraph_words, threshold).withColumn("kind", F.lit("paragraph"))
    two = passages(docs, min_words)
    columns = ("doc_id", "start", "end", "kind", "words", "cluster", "keep_doc_id", "keep_start")
    return one.select(*columns).unionByName(two.select(*columns)).where("doc_id <> keep_doc_id or start <> keep_start")


def strip(docs: DataFrame, **options) -> DataFrame:
    """docs with the spans of repeats() cut out of the texts, columns as they were.

    What is cut takes the punctuation that clings to it along, and its line break where a
    whole line goes. A document of which no word is left is dropped; others without spans,
    null doc_ids, null and empty texts come back as they were. n_chars, where there is such a
    column, is set to the new length of a text that was cut.
    """
    name, found = fresh(docs, "id"), fresh(docs, "spans")
    spans = small(cut(repeats(docs, **options).groupBy(F.col("doc_id").alias(name)).agg(F.collect_set(F.struct("start", "end")).alias(found))))
    joined = docs.join(spans, docs["doc_id"].cast("long") == spans[name], "left").select(*[docs[c] for c in docs.columns], spans[found])
    names = docs.columns
    at, last = names.index("text"), len(names)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.flatnonzero(batch.column(last).is_valid().to_numpy(zero_copy_only=False))
            keep = np.ones(batch.num_rows, dtype=bool)
            columns = batch.columns[:last]
            if len(hit):
                new = {}
                pick = pa.array(hit)
                for i, text, cuts in zip(hit.tolist(), batch.column(at).take(pick).to_pylist(), batch.column(last).take(pick).to_pylist(), strict=True):
                    new[i] = text if text is None else cut_spans(text, [(c["start"], c["end"]) for c in cuts])
                    keep[i] = text is None or any(map(str.isalnum, new[i]))
                texts = columns[at].to_pylist()
                for i, text in new.items():
                    texts[i] = text
                columns[at] = pa.array(texts, columns[at].type)
                if "n_chars" in names:
                    c = names.index("n_chars")
                    lengths = columns[c].to_pylist()
                    for i, text in new.items():
                        lengths[i] = None if text is None else len(text)
                    columns[c] = pa.array(lengths, columns[c].type)
            out = pa.RecordBatch.from_arrays(columns, names)
            yield out if keep.all() else out.filter(pa.array(keep))

    return bounded(joined).mapInArrow(remove, docs.schema)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans, the punctuation next to them and the line breaks of lines that go whole."""
    merged: list[list[int]] = []
    for a, z in sorted(spans):
        a, z = max(0, a), min(len(text), z)
        while z < len(text) and not text[z].isalnum() and not text[z].isspace():
            z += 1
        while a > 0 and not text[a - 1].isalnum() and not text[a - 1].isspace():
            a -= 1
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], z)
        elif z > a:
            merged.append([a, z])
    parts, at = [], 0
    for a, z in merged:
        whole = (a == 0 or text[a - 1] == "\n") and (z == len(text) or text[z] == "\n")
        parts.append(text[at:a])
        at = z + 1 if whole and z < len(text) else z
    return "".join([*parts, text[at:]])
