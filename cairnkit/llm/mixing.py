"""Mixing sources to target weights by a low-discrepancy schedule of token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnkit.llm._util import cut, fresh, small

BLOCK_TOKENS = 8192
ALPHA = 0.7
SEED = 17
RANGE_ROWS = 1 << 16
_TURN = 2654435769  # 2**32 / golden ratio
_UNIT = 1 << 32
_CELLS = 4096


def word_count(text: Column) -> Column:
    """Words between ASCII blanks, the token measure where no token column is named; null for a null text."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")).cast("long")


def golden_point(i: str) -> str:
    """SQL for the i-th golden-ratio point as an integer of 0 .. 2**32 - 1, exact for i below 2**51.

    The fractional part of i / phi in 32-bit fixed point; the product is taken in two halves
    so that no bigint overflows.
    """
    return f"(((({i}) div 1048576) * {_TURN} % {_UNIT}) * 1048576 + (({i}) % 1048576) * {_TURN}) % {_UNIT}"


def plan(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, alpha: float = ALPHA, weights: dict[str, float] | None = None, max_epochs: float | None = None, seed: int = SEED, tokens_col: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mixed order: (slot, source, epoch, block, piece, doc_id, doc_tokens, from_token, to_token).

    Each source's documents are shuffled by a hash of seed and doc_id, laid end to end and
    cut into blocks of exactly block_tokens tokens (the last of a source may be shorter); a
    document that crosses a cut gives a piece to each block. Slot i of the mix belongs to the
    source in whose share of [0, 1) the i-th golden-ratio point falls, and takes that
    source's next block. The points are so even that every stretch of the mix, not only the
    whole, holds each source at its weight to within a few blocks. There are as many slots as
    let every block of every source come at least once; a source that runs out starts its
    next epoch.

    Target weights are proportional to tokens ** alpha, or to `weights` by source (others
    have none and are left out), and hold however often that makes a small source come. Only
    if max_epochs is given, no source gets more weight than that many times its blocks. A
    source whose share is below 2 ** -32 can't be scheduled and raises ValueError.

    Null sources form one source of their own. Null texts and texts without tokens have
    nothing to mix and aren't in the plan; null doc_ids and repeated rows are, as rows of
    their own. An empty table gives an empty plan. Tokens are words, unless tokens_col names
    a column of counts. Only doc_id, source and text (or tokens_col) are read; texts aren't
    shuffled.
    """
    measure = F.col(tokens_col).cast("long") if tokens_col else word_count(F.col("text"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), measure.alias("n")).where("n > 0")
    slim = slim.withColumn("h", F.expr(f"cast(conv(substring(md5(concat('{seed}:', coalesce(cast(doc_id as string), ''))), 1, 15), 16, 10) as bigint)"))
    if weights is not None:
        slim = slim.where(F.col("source").isin(list(weights)))
    slim = cut(slim)
    # ranges of the hash: prefix sums in two steps, so that no task has a whole source to sort
    total = slim.count()
    ranges = max(1, -(-total // range_rows))
    slim = slim.withColumn("r", F.expr(f"h div {-(-(1 << 60) // ranges)}"))
    parts = slim.groupBy("source", "r").agg(F.sum("n").alias("part"))
    before = Window.partitionBy("source").orderBy("r")
    parts = cut(parts.select("source", "r", "part", (F.sum("part").over(before) - F.col("part")).alias("base")))
    inside = Window.partitionBy("source", "r").orderBy("h", "doc_id", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = slim.withColumn("run", F.sum("n").over(inside))
    placed = running.join(parts.withColumnRenamed("source", "s2"), running["source"].eqNullSafe(F.col("s2")) & (running["r"] == parts["r"]))
    start = F.col("base") + F.col("run") - F.col("n")
    placed = placed.select(running["source"], "doc_id", "n", running["h"], start.alias("at"))
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_tokens), F.floor((F.col("at") + F.col("n") - 1) / block_tokens))))
    first = F.greatest(F.lit(0), F.col("block") * block_tokens - F.col("at"))
    last = F.least(F.col("n"), (F.col("block") + 1) * block_tokens - F.col("at"))
    pieces = pieces.select("source", "block", "doc_id", F.col("n").alias("doc_tokens"), (F.col("at") + first - F.col("block") * block_tokens).alias("piece"), first.alias("from_token"), last.alias("to_token"))
    shares = _shares(parts, block_tokens, alpha, weights, max_epochs)
    taken = _schedule(shares)
    both = taken.join(pieces.withColumnRenamed("source", "s2").withColumnRenamed("block", "b2"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
    return both.select("slot", "source", "epoch", "block", "piece", "doc_id", "doc_tokens", "from_token", "to_token")


def _shares(parts: DataFrame, block_tokens: int, alpha: float, weights: dict[str, float] | None, max_epochs: float | None) -> DataFrame:
    """(source, blocks, lo, hi, slots): each source's part of 0 .. 2**32 and the number of slots."""
    by_source = parts.groupBy("source").agg(F.sum("part").alias("tokens")).withColumn("blocks", F.ceil(F.col("tokens") / block_tokens))
    if weights is None:
        want = F.pow(F.col("tokens").cast("double"), F.lit(float(alpha)))
    else:
        want = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.col("source")), F.lit(0.0))
    everything = Window.partitionBy(F.lit(0))
    raw = by_source.withColumn("want", want).where("want > 0").withColumn("need", F.max(F.col("blocks") / F.col("want")).over(everything))
    given = F.col("want") * F.col("need")
    raw = raw.withColumn("given", given if max_epochs is None else F.least(given, F.col("blocks") * F.lit(float(max_epochs))))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_first())
    raw = raw.withColumn("upto", F.sum("given").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("all", F.max("upto").over(everything))
    raw = raw.withColumn("hi", F.when(F.col("upto") == F.col("all"), F.lit(_UNIT)).otherwise(F.floor(F.col("upto") / F.col("all") * _UNIT)).cast("long"))
    raw = raw.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0)).cast("long"))
    # by then the points must have come to each source often enough; _schedule cuts off the rest
    slots = F.max(F.ceil((F.col("blocks") + 4 + 2 * F.log2(F.col("blocks") + 1)) * F.lit(float(_UNIT)) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))).over(everything)
    lost = (F.col("given") * _UNIT < F.col("all")) | (F.col("hi") <= F.col("lo"))
    shares = cut(raw.select("source", "blocks", "lo", "hi", slots.cast("long").alias("slots"), lost.alias("lost")))
    if none := shares.where("lost").first():
        raise ValueError(f"the weight of source {none.source!r} is below 2 ** -32 of all")
    return shares.drop("lost")


def _schedule(shares: DataFrame) -> DataFrame:
    """(slot, source, epoch, block): the points joined to the sources by cells of the unit, then ranked."""
    spark = shares.sparkSession
    slots = shares.agg(F.max("slots")).first()[0] or 0
    width = _UNIT // _CELLS
    points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(golden_point("id")).alias("u")).withColumn("cell", F.floor(F.col("u") / width))
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    hit = points.join(cells, "cell").where("u >= lo and u < hi").select("slot", "source", "blocks", F.floor(F.col("slot") / RANGE_ROWS).alias("r"))
    hit = cut(hit)
    counts = hit.groupBy("source", "r").count()
    counts = counts.select(F.col("source").alias("s2"), F.col("r").alias("r2"), (F.sum("count").over(Window.partitionBy("source").orderBy("r")) - F.col("count")).alias("base"))
    ranked = hit.withColumn("k", F.row_number().over(Window.partitionBy("source", "r").orderBy("slot")))
    turn = ranked.join(counts, ranked["source"].eqNullSafe(counts["s2"]) & (ranked["r"] == counts["r2"])).withColumn("k", F.col("base") + F.col("k") - 1)
    turn = cut(turn.select("slot", "source", "blocks", "k"))
    end = turn.where("k = blocks - 1").agg(F.max("slot")).first()[0]
    turn = turn.where(F.col("slot") <= F.lit(-1 if end is None else end))
    return turn.select("slot", "source", F.floor(F.col("k") / F.col("blocks")).alias("epoch"), (F.col("k") % F.col("blocks")).alias("block"))


def mix(docs: DataFrame, counted: DataFrame | None = None, **options) -> DataFrame:
    """docs in the proportions of plan(), whole documents with their columns as they were.

    The plan is made from docs, or from `counted`: its doc_id, source and tokens_col.

    A document comes once for every time that the block where it begins is scheduled: at
    least once, more often where its source is repeated. Rows without tokens (null or blank
    texts) come once, unless `weights` leaves their source out. Rows that share a doc_id and
    source, null ones too, come as often as those rows do on average, rounded up. An empty
    table stays empty. Rows come where they are read: the plan's slots decide how often, and
    a trainer that wants their order too takes it from plan().
    """
    order = plan(docs if counted is None else counted, **options)
    name, source, count, turn = (fresh(docs, c) for c in ("id", "from_source", "times", "turn"))
    times = order.where("from_token = 0").groupBy(F.col("doc_id").alias(name), F.col("source").alias(source)).agg(F.ceil(F.count("*") / F.count_if(F.col("epoch") == 0)).cast("int").alias(count))
    if options.get("weights") is not None:
        docs = docs.where(docs["source"].isin(list(options["weights"])))
    times = small(cut(times))
    joined = docs.join(times, docs["doc_id"].cast("long").eqNullSafe(times[name]) & docs["source"].cast("string").eqNullSafe(times[source]), "left")
    again = F.explode(F.sequence(F.lit(1), F.coalesce(times[count], F.lit(1)))).alias(turn)
    return joined.select(*[docs[c] for c in docs.columns], again).drop(turn)


def plan_sql(counted: str, block_tokens: int = BLOCK_TOKENS, alpha: float = ALPHA, seed: int = SEED) -> str:
    """plan() for DuckDB; `counted` is SQL for CTEs that end in counted (doc_id, source, n)."""
    point = golden_point("i").replace(" div ", " // ")
    return rf"""WITH RECURSIVE {counted}, d AS (SELECT doc_id, source, n,
      CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM counted),
    p AS (SELECT source, doc_id, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY h, doc_id, n ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS pos FROM d WHERE n > 0),
    e AS (SELECT source, doc_id, n, pos, unnest(range(pos // {block_tokens}, (pos + n - 1) // {block_tokens} + 1)) AS block FROM p),
    t AS (SELECT source, sum(n) AS tokens, CAST(ceil(sum(n) / {block_tokens}) AS BIGINT) AS blocks, pow(CAST(sum(n) AS DOUBLE), {float(alpha)}) AS want FROM p GROUP BY source),
    g AS (SELECT *, want * max(blocks / want) OVER () AS given FROM t),
    u AS (SELECT *, sum(given) OVER (ORDER BY source NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto FROM g),
    v AS (SELECT source, blocks, CASE WHEN upto = max(upto) OVER () THEN {_UNIT} ELSE CAST(floor(upto / max(upto) OVER () * {_UNIT}) AS BIGINT) END AS hi, upto FROM u),
    w AS (SELECT source, blocks, hi, coalesce(lag(hi) OVER (ORDER BY upto), 0) AS lo FROM v),
    m AS (SELECT CAST(max(ceil((blocks + 4 + 2 * log2(blocks + 1)) * {float(_UNIT)} / (hi - lo))) AS BIGINT) AS slots FROM w),
    s AS (SELECT i AS slot, {point} AS u FROM (SELECT unnest(range(slots)) AS i FROM m)),
    k AS (SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM s JOIN w ON u >= lo AND u < hi),
    c AS (SELECT slot, source, k // blocks AS epoch, k % blocks AS block FROM k WHERE slot <= (SELECT max(slot) FROM k WHERE k = blocks - 1))
    SELECT slot, c.source, epoch, c.block, pos + greatest(0, c.block * {block_tokens} - pos) - c.block * {block_tokens} AS piece, doc_id, n AS doc_tokens,
      greatest(0, c.block * {block_tokens} - pos) AS from_token, least(n, (c.block + 1) * {block_tokens} - pos) AS to_token
    FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source AND c.block = e.block"""
