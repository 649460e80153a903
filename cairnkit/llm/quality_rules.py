"""Quality rules as a bitmask ledger.

Every rule is evaluated once on each document and leaves one bit; the measurements that it
used are kept beside it. Policies are versioned bit sets that are applied to the ledger
afterwards, so that a new policy, or what a rule alone changes, never reads the texts again.
All rules compare integers, so that any SQL engine gives the same bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnkit.llm import _words
from cairnkit.llm._util import bounded, cut, signed

BLANKS = " \t\n\r\f"
SYMBOLS = "#$%&*~^|<>{}[]\\/@=+_"
MEASURES = ("m_chars", "m_solid", "m_lone", "m_words", "m_distinct_words", "m_lines", "m_distinct_lines", "m_symbols", "m_capitals", "m_digits", "m_bangs", "m_flagged")
SEGMENT = 100
LABELLED, LEAST, RATIO, LEXICON = 100_000, 4, 15, 10_000


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails`, SQL over the measurements, is true; bit is the rule's place."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "empty", "m_words < 1"),
    Rule(1, "short_words", "m_solid + m_lone < 2 * m_words"),
    Rule(2, "long_words", "m_solid > 14 * m_words"),
    Rule(3, "symbols", "m_symbols * 100 > 6 * m_solid"),
    Rule(4, "capitals", "m_capitals * 100 > 45 * m_solid"),
    Rule(5, "digits", "m_digits * 100 > 50 * m_solid"),
    Rule(6, "exclamations", "m_bangs * 10 > 3 * m_words"),
    Rule(7, "repeated_words", "m_words >= 50 and m_distinct_words * 10 < 3 * m_words"),
    Rule(8, "repeated_lines", "m_lines >= 6 and m_distinct_lines * 2 < m_lines"),
    Rule(9, "flagged_words", "m_flagged >= 2 and m_flagged * 200 > m_words"),
    Rule(10, "few_words", "m_words < 50"),
)


@dataclass(frozen=True)
class Policy:
    """A document is rejected if it fails more than `allowed` of the rules."""

    version: str
    rules: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        bits = {r.name: 1 << r.bit for r in RULES}
        return sum(bits[name] for name in self.rules)


POLICIES = (
    Policy("v1", tuple(r.name for r in RULES if r.name not in ("flagged_words", "few_words"))),
    Policy("v2", tuple(r.name for r in RULES if r.name != "few_words")),
    Policy("strict", tuple(r.name for r in RULES)),
)
CURRENT = POLICIES[1]


def flagged_words(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, least: int = LEAST, ratio: int = RATIO, most: int = LEXICON) -> list[int]:
    """Hashes of the words that mark toxic documents, whatever their language, fitted on labels (doc_id, toxic).

    Of at most `labelled` labels, the first by the md5 of their doc_id, the documents are
    read. A word is flagged if at least `least` toxic documents hold it, and its share of the
    toxic ones is at least `ratio` times that of the others, one added to their number; the
    `most` most frequent such words are kept. Labels without an id or a mark, and documents
    without a text, don't count. No labels, or none of them toxic, give no words.
    """
    name, mark = "_id", "_toxic"
    chosen = labels.select(F.col("doc_id").cast("long").alias(name), F.col("toxic").cast("int").alias(mark)).dropna()
    chosen = chosen.orderBy(F.md5(F.col(name).cast("string")), name, mark).limit(labelled)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col(name)).select("text", mark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for w in _words.blocks(batch.column(0)):
                mine = toxic[w.first : w.first + w.rows]
                row = w.row_of_word()
                order = np.lexsort((w.hashes, row))
                row, word = row[order], w.hashes[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
                words = np.append(signed(word[new]), np.zeros(w.rows, np.int64))
                total = np.arange(len(words)) >= int(new.sum())  # a row a document too, for their number
                yield pa.RecordBatch.from_arrays([pa.array(words, mask=total), pa.array(np.append(mine[row[new]], mine))], ["word", "toxic"])

    counts = cut(bounded(read).mapInArrow(count, "word long, toxic int").groupBy("word").agg(F.count_if(F.col("toxic") != 0).alias("t"), F.count_if(F.col("toxic") == 0).alias("n")))
    total = counts.where("word is null").first()
    if total is None:
        return []
    marks = counts.where(f"word is not null and t >= {least} and t * {total.n} >= {ratio} * {total.t} * (n + 1)")
    return [r.word for r in marks.orderBy(F.desc("t"), "word").limit(most).collect()]


_OF = {c: np.isin(np.arange(256), [ord(x) for x in chars]) for c, chars in (("m_blank", BLANKS), ("m_symbols", SYMBOLS), ("m_capitals", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("m_digits", "0123456789"), ("m_bangs", "!?"))}


def measure(texts: pa.Array, flagged: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of some texts by their bytes, a column each."""
    found: dict[str, list[np.ndarray]] = {m: [] for m in MEASURES}
    for w in _words.blocks(texts):
        raw, low, high = w.raw, w.offsets[:-1], w.offsets[1:]

        def upto(flags: np.ndarray) -> np.ndarray:
            return np.concatenate((np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)))

        def of(flags: np.ndarray, low=low, high=high) -> np.ndarray:
            total = upto(flags)
            return total[high] - total[low]

        kinds = {c: of(table[raw]) for c, table in _OF.items()}
        found["m_chars"].append(of((raw & 0xC0) != 0x80))
        found["m_solid"].append(found["m_chars"][-1] - kinds["m_blank"])
        found["m_lone"].append(of((raw >= 0xE3) & (raw <= 0xED)))
        for c in ("m_symbols", "m_capitals", "m_digits", "m_bangs"):
            found[c].append(kinds[c])
        counts = np.diff(w.starts)
        found["m_words"].append(counts)
        row = w.row_of_word()
        found["m_distinct_words"].append(_distinct(w, row, counts))
        ends = np.flatnonzero(raw == 10)
        begins = np.unique(np.concatenate([low, ends + 1]))
        begins = begins[begins < len(raw)]
        ends = np.append(begins[1:], len(raw)) if len(begins) else begins
        ends = ends - (raw[ends - 1] == 10)
        solid = upto(~_OF["m_blank"][raw])
        full = solid[ends] > solid[begins]
        begins, ends = begins[full], ends[full]
        of_line = np.searchsorted(w.offsets, begins, side="right") - 1
        found["m_lines"].append(np.bincount(of_line, minlength=w.rows))
        line = _words.runs(raw, begins, ends)
        order = np.lexsort((line, of_line))
        told, line = of_line[order], line[order]
        new = np.ones(len(told), dtype=bool)
        new[1:] = (told[1:] != told[:-1]) | (line[1:] != line[:-1])
        told = told[new]
        found["m_distinct_lines"].append(np.bincount(told, minlength=w.rows))
        hit = np.isin(w.hashes, flagged) if len(flagged) else np.zeros(len(row), bool)
        found["m_flagged"].append(np.bincount(row[hit], minlength=w.rows))
    return {m: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for m, x in found.items()}


def _distinct(w: _words.Words, row: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The distinct words of each SEGMENT words in turn, added up over a row."""
    parts = -(-counts // SEGMENT)
    first = np.cumsum(parts) - parts
    place = np.arange(len(row)) - w.starts[:-1][row]
    grid = np.full((int(parts.sum()), SEGMENT), 2**64 - 1, dtype=np.uint64)
    grid[first[row] + place // SEGMENT, place % SEGMENT] = w.hashes
    grid.sort(axis=1)
    most = grid == np.uint64(2**64 - 1)
    new = np.ones(grid.shape, dtype=bool)
    new[:, 1:] = grid[:, 1:] != grid[:, :-1]
    return np.bincount(np.repeat(np.arange(len(counts)), parts), weights=(new & ~most).sum(axis=1), minlength=len(counts)).astype(np.int64)


def measurements(text: Column, flagged: Sequence[int] = ()) -> Column:
    """A struct of counts over the whole text, in one pass over its bytes; a null text counts as an empty one.

    Words are runs of letters and digits, without case, and each character of a script without
    blanks (m_lone of them) is a word. m_distinct_words adds up the distinct words of each 100 words in turn,
    so that it doesn't fall behind m_words as a text grows; lines are those that aren't blank.
    m_flagged counts the words whose hashes are flagged.
    """
    marks = np.sort(np.array(flagged, dtype=np.int64).view(np.uint64))

    @F.arrow_udf("struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">")
    def run(texts: pa.Array) -> pa.Array:
        found = measure(texts, marks)
        return pa.StructArray.from_arrays([pa.array(found[m]) for m in MEASURES], list(MEASURES))

    return run(F.coalesce(text, F.lit("")))


def mask_sql(prefix: str = "") -> str:
    terms = []
    for r in RULES:
        fails = r.fails
        for m in sorted(MEASURES, key=len, reverse=True):
            fails = fails.replace(m, f"@{MEASURES.index(m)}@")
        for k, m in enumerate(MEASURES):
            fails = fails.replace(f"@{k}@", prefix + m)
        terms.append(f"CASE WHEN {fails} THEN {1 << r.bit} ELSE 0 END")
    return " + ".join(terms)


def rejected_sql(policy: Policy, mask: str) -> str:
    return f"bit_count({mask} & {policy.mask}) > {policy.allowed}"


def ledger(docs: DataFrame, flagged: Sequence[int] = ()) -> DataFrame:
    """(doc_id, mask, the measurements), a row for each row of docs, repeated rows and null ids too.

    mask has bit r.bit set where rule r fails. A null or empty text fails the rules `empty`
    and `few_words` and no ratio rule; an empty table gives no rows. One pass over Arrow
    batches, no shuffle; columns other than doc_id and text aren't read.
    """
    measured = docs.select("doc_id", measurements(docs["text"], flagged).alias("m")).select("doc_id", "m.*")
    return measured.select("doc_id", F.expr(mask_sql()).cast("long").alias("mask"), *MEASURES)


def write(docs: DataFrame, path: str, flagged: Sequence[int] = ()) -> None:
    """Store ledger(docs, flagged) as Parquet at path, which must not exist yet; this alone reads the texts."""
    ledger(docs, flagged).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The ledger that write() stored, for policies and ablations of any time."""
    return spark.read.schema("doc_id long, " + ", ".join(f"{m} long" for m in ("mask", *MEASURES))).parquet(path)


def decide(ledger_rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The ledger with a boolean column rejected_<version> for each policy."""
    return ledger_rows.select("*", *[F.expr(rejected_sql(p, "mask")).alias(f"rejected_{p.version}") for p in policies])


def ablations(ledger_rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each rule of each policy: documents that fail it, that it alone rejects, and that stay rejected without it.

    One aggregation of bit tests over the ledger, whatever the number of policies; an empty
    ledger gives zeros.
    """
    tests, rows = [], []
    for k, p in enumerate(policies):
        over, rejected = F.lit(p.allowed), F.expr(rejected_sql(p, "mask"))
        for r in (r for r in RULES if r.name in p.rules):
            without = F.bit_count(F.col("mask").bitwiseAND(F.lit(p.mask & ~(1 << r.bit)))) > over
            counts = {"fails": F.col("mask").bitwiseAND(F.lit(1 << r.bit)) != 0, "rejected_alone": rejected & ~without, "rejected_without": without}
            tests += [F.count_if(test).alias(f"{name}_{k}_{r.bit}") for name, test in counts.items()]
            rows.append(F.struct(F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"), *[F.col(f"{name}_{k}_{r.bit}").alias(name) for name in counts]))
    return ledger_rows.agg(*tests).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def ablation(ledger_rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """ablations() of one policy."""
    return ablations(ledger_rows, (policy,))


def keep(docs: DataFrame, policy: Policy = CURRENT, flagged: Sequence[int] = ()) -> DataFrame:
    """The rows of docs that the policy doesn't reject, columns as they were.

    The texts pass through the rules where they lie: a filter, no join and no shuffle. Null
    and empty texts are rejected by the rule `empty`, if the policy has it. Repeated rows and
    null ids are judged by their texts like any other; an empty table stays empty.
    """
    prefix = "__"
    while any(c.lower().startswith(prefix + "m_") for c in docs.columns):
        prefix += "_"
    name = prefix + "m_all"
    measured = docs.select("*", measurements(docs["text"], flagged).alias(name))
    return measured.where(f"not ({rejected_sql(policy, '(' + mask_sql(name + '.') + ')')})").select(*[measured[c] for c in docs.columns])


def ledger_sql(policies: tuple[Policy, ...] = POLICIES) -> str:
    """The ledger of documents, with words flagged by labels, and the policies' decisions, for DuckDB."""
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    symbols = SYMBOLS.replace("'", "''")
    folded = f"translate(t, '{_words.CAPITALS}', '{_words.CAPITALS.lower()}')"

    def of(characters: str) -> str:
        return f"length(t) - length(translate(t, '{characters}', ''))"

    found = {
        "m_chars": "length(t)",
        "m_solid": f"length(translate(t, {blanks}, ''))",
        "m_lone": r"len(regexp_extract_all(t, '[\x{3000}-\x{D7FF}]'))",
        "m_words": "len(w)",
        "m_distinct_words": f"coalesce(list_sum(list_transform(range(CAST(ceil(len(w) / {SEGMENT}.0) AS BIGINT)), lambda i: len(list_distinct(w[{SEGMENT} * i + 1 : {SEGMENT} * i + {SEGMENT}])))), 0)",
        "m_lines": "len(l)",
        "m_distinct_lines": "len(list_distinct(l))",
        "m_symbols": of(symbols),
        "m_capitals": of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "m_digits": of("0123456789"),
        "m_bangs": of("!?"),
        "m_flagged": "coalesce(f, 0)",
    }
    measured = ", ".join(f"CAST({found[m]} AS BIGINT) AS {m}" for m in MEASURES)
    decided = ", ".join(f"{rejected_sql(p, 'mask')} AS rejected_{p.version}" for p in policies)
    return rf"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, text IS NULL AS void, coalesce(text, '') AS t FROM documents),
    s AS (SELECT k, doc_id, void, t, regexp_extract_all({folded}, '{_words.WORD_SQL}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	
]')) AS l FROM d),
    c AS (SELECT doc_id, CAST(toxic AS INTEGER) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, toxic LIMIT {LABELLED}),
    b AS (SELECT toxic, w FROM s JOIN c ON s.doc_id = c.doc_id WHERE NOT void),
    z AS (SELECT count(*) FILTER (toxic <> 0) AS t, count(*) FILTER (toxic = 0) AS n FROM b),
    x AS (SELECT word, count(*) FILTER (toxic <> 0) AS t, count(*) FILTER (toxic = 0) AS n FROM (SELECT toxic, unnest(list_distinct(w)) AS word FROM b) GROUP BY word),
    f AS (SELECT word FROM x, z WHERE x.t >= {LEAST} AND x.t * z.n >= {RATIO} * z.t * (x.n + 1) ORDER BY x.t DESC LIMIT {LEXICON}),
    h AS (SELECT k, count(*) AS f FROM (SELECT k, unnest(w) AS word FROM s) JOIN f USING (word) GROUP BY k),
    m AS (SELECT doc_id, {measured} FROM s LEFT JOIN h USING (k)),
    k AS (SELECT doc_id, CAST({mask_sql()} AS BIGINT) AS mask, {", ".join(MEASURES)} FROM m)
    SELECT *, {decided} FROM k"""



def ablation_sql(policies: tuple[Policy, ...] = POLICIES) -> str:
    """The policies' ablations for DuckDB, by counting the rules that a document fails instead of by bits."""
    asked = []
    for p in policies:
        rules = [r for r in RULES if r.name in p.rules]
        for r in rules:
            rest = " + ".join(f"CAST({x.fails} AS INTEGER)" for x in rules if x is not r) or "0"
            rejected = f"{rest} + CAST({r.fails} AS INTEGER) > {p.allowed}"
            asked.append(f"SELECT '{p.version}' AS version, '{r.name}' AS rule, count(*) FILTER ({r.fails}) AS fails, count(*) FILTER ({rejected} AND NOT {rest} > {p.allowed}) AS rejected_alone, count(*) FILTER ({rest} > {p.allowed}) AS rejected_without FROM measured")
    return f"WITH measured AS MATERIALIZED ({ledger_sql(policies)})\n    " + "\n    UNION ALL ".join(asked)
