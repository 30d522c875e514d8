"""Quality rules as a ledger: each rule is evaluated once and its failure kept as a bit.

Policies are named, versioned sets of rules. Applying one, comparing two and asking what
each rule alone costs are bit operations on the ledger; no text is read again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineforge.llm.arrow import SpanHashes, by_bytes, equal_spans, text_bytes, words
from lineforge.llm.names import narrowed
from lineforge.session import run_dir

WINDOW = 5
MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_letters",
)


@dataclass(frozen=True)
class Rule:
    """A text fails if ``weight`` times ``measure`` exceeds ``limit`` times ``against``, or a plain number."""

    bit: int
    name: str
    measure: str
    weight: int
    limit: int
    against: str | None = None
    below: bool = False

    def fails(self) -> Column:
        left = F.col(self.measure) * self.weight
        right = F.lit(self.limit) if self.against is None else F.col(self.against) * self.limit
        return left < right if self.below else left > right


# Bits never change their meaning: a new limit is a new rule with a new bit.
RULES = (
    Rule(0, "few_words", "n_words", 1, 10, below=True),
    Rule(1, "repeated_windows", "n_repeat_words", 100, 20, "n_words"),
    Rule(2, "symbols", "n_symbols", 100, 10, "n_words"),
    Rule(3, "repeated_lines", "n_dup_lines", 100, 50, "n_lines"),
    Rule(4, "short_words", "word_chars", 100, 200, "n_words", below=True),
    Rule(5, "long_words", "word_chars", 100, 1400, "n_words"),
    Rule(6, "shouting", "n_upper", 100, 40, "n_letters"),
    Rule(7, "many_words", "n_words", 1, 1_000_000),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STRICT = Policy(
    "strict",
    2,
    ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "shouting"),
)


def _numbered_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, the same exactly for equal pairs; numbers are below 2**32."""
    return np.unique((a.astype(np.int64) << 32) | b, return_inverse=True)[1]


def _measure(column: pa.Array) -> list[np.ndarray]:
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    found = words(data, offsets)
    n_words = np.diff(found.first)
    code_points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    word_chars = np.bincount(
        found.row, weights=code_points[found.ends] - code_points[found.starts], minlength=n
    )
    hashes = SpanHashes(data)

    # Words inside windows of five that come twice or more in their text.
    row = found.row
    last = len(row) - WINDOW + 1
    repeated = np.zeros(len(row) + 1, dtype=np.int64)
    if last > 0:
        # Numbers of equal words, of equal pairs, of equal runs of four, of equal windows.
        word = equal_spans(data, found.starts, found.ends, hashes.of(found.starts, found.ends))
        pair = _numbered_pairs(word[:-1], word[1:])
        four = _numbered_pairs(pair[:-2], pair[2:])
        window = _numbered_pairs(four[:-1], word[4:])
        at = np.flatnonzero(row[:last] == row[WINDOW - 1 :])
        key = (row[at].astype(np.int64) << 32) | window[at]
        _, group, count = np.unique(key, return_inverse=True, return_counts=True)
        again = at[count[group] > 1]
        np.add.at(repeated, again, 1)
        np.add.at(repeated, again + WINDOW, -1)
    covered = np.cumsum(repeated)[: len(row)] > 0

    # Lines: spans between line feeds, row ends being ends too.
    feeds = np.flatnonzero(data == 0x0A)
    begins = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
    line_row = np.searchsorted(offsets[:-1], np.concatenate((offsets[:-1], feeds)), side="right") - 1
    order = np.argsort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
    line_row = line_row[order]
    # An empty row or a feed at a row's end shares its place with the next row's begin.
    line_row = np.sort(line_row, kind="stable")
    ends = np.empty_like(begins)
    ends[:-1] = begins[1:] - 1
    same = np.zeros(len(begins), dtype=bool)
    same[:-1] = line_row[1:] == line_row[:-1]
    ends = np.where(same, ends, offsets[1:][line_row])
    worded = np.searchsorted(found.starts, ends) > np.searchsorted(found.starts, begins)
    begins, ends, line_row = begins[worded], ends[worded], line_row[worded]
    line = equal_spans(data, begins, ends, hashes.of(begins, ends))
    _, first_line = np.unique((line_row.astype(np.int64) << 32) | line, return_index=True)
    duplicate = np.ones(len(begins), dtype=bool)
    duplicate[first_line] = False

    def per_row(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    symbols = np.isin(data, np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
    by_line = np.bincount(line_row, minlength=n)
    return [
        n_words,
        word_chars.astype(np.int64),
        per_row(symbols),
        np.bincount(line_row[duplicate], minlength=n),
        np.bincount(row[covered], minlength=n),
        by_line,
        per_row(upper),
        per_row(upper | lower),
    ]


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document with the measurements that rules refer to.

    n_words, word_chars (code points in words), n_symbols (``#*$%&|<>``), n_lines (split
    at line feeds, with a word), n_dup_lines (of them equal to an earlier one),
    n_repeat_words (words in windows of five that come twice or more in the text),
    n_upper and n_letters (A-Z, a-z). Null and empty texts measure 0 throughout.
    Windows and lines are equal where their bytes are.
    """
    narrow, kept, body, schema = narrowed(docs, keep, text, ", ".join(f"{m} long" for m in MEASURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, body):
                found = [pa.array(np.asarray(m, dtype=np.int64)) for m in _measure(part.column(body))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + found, names=schema.names)

    return narrow.mapInArrow(run, schema)


def ledger(measured: DataFrame, rules: Sequence[Rule] = RULES, bits: str = "fail_bits") -> DataFrame:
    """The measurements with one bit for each failed rule."""
    mask = F.lit(0).cast("long")
    for rule in rules:
        mask = mask.bitwiseOR(F.when(rule.fails(), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn(bits, mask)


def passes(policy: Policy, rules: Sequence[Rule] = RULES, bits: str = "fail_bits") -> Column:
    """Whether no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask(rules))) == 0


def ablations(rows: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES, bits: str = "fail_bits") -> DataFrame:
    """For each rule of a policy: documents it fails, and those that only it fails.

    Documents are counted by their failure bits first, so what follows has at most one row
    for each combination of rules that occurs. An empty ledger gives zeros.
    """
    mask = policy.mask(rules)
    counted = rows.groupBy(F.col(bits).bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count("*").alias("n"))
    chosen = [r for r in rules if r.name in policy.rules]
    sums = counted.agg(
        *[
            F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(f"{kind}_{r.bit}")
            for r in chosen
            for kind, test in (
                ("all", F.col("failed").bitwiseAND(F.lit(1 << r.bit)) != 0),
                ("only", F.col("failed") == (1 << r.bit)),
            )
        ]
    )
    rows_out = F.array(
        *[
            F.struct(
                F.lit(policy.name).alias("policy"),
                F.lit(policy.version).alias("version"),
                F.lit(r.name).alias("rule"),
                F.col(f"all_{r.bit}").alias("n_failed"),
                F.col(f"only_{r.bit}").alias("n_only_this"),
            )
            for r in chosen
        ]
    )
    return sums.select(F.inline(rows_out))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(measure(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = passes(BASE)
    return rows.withColumn("base_failed", ~base).withColumn("kept", base & passes(STRICT))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of both policies costs over all documents, from one ledger."""
    path = run_dir(spark, "quality-ledger")
    ledger(measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("fail_bits").write.parquet(path)
    rows = spark.read.parquet(path)
    return ablations(rows, BASE).unionByName(ablations(rows, STRICT))


# Measurements and rules written out for the check engine; limits are those of the contract
# and of the first versions of the policies.
_MEASURED = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, [x FOR x IN regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ls
  FROM d
), pos AS (
  SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM pos) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid
), m AS (
  SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid)
), f AS (
  SELECT *, n_words < 10 AS few_words, 100 * n_repeat_words > 20 * n_words AS repeated_windows,
         100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 50 * n_lines AS repeated_lines,
         100 * word_chars < 200 * n_words AS short_words, 100 * word_chars > 1400 * n_words AS long_words,
         100 * n_upper > 40 * n_letters AS shouting, n_words > 1000000 AS many_words
  FROM m
)"""

OP10_SQL = f"""{_MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letters,
       CAST(few_words::INT + 2 * repeated_windows::INT + 4 * symbols::INT + 8 * repeated_lines::INT
            + 16 * short_words::INT + 32 * long_words::INT + 64 * shouting::INT + 128 * many_words::INT AS BIGINT)
         AS fail_bits,
       few_words OR repeated_windows AS base_failed,
       NOT (few_words OR repeated_windows OR symbols OR repeated_lines OR short_words OR long_words OR shouting)
         AS kept
FROM f
"""


def _ablations_sql() -> str:
    policies = {
        ("base", 1): "few_words repeated_windows".split(),
        ("strict", 2): "few_words repeated_windows symbols repeated_lines short_words long_words shouting".split(),
    }
    rows = []
    for (policy, version), names in policies.items():
        for name in names:
            alone = " AND ".join([name, *(f"NOT {other}" for other in names if other != name)])
            rows.append(
                f"SELECT '{policy}' AS policy, {version} AS version, '{name}' AS rule, "
                f"count(*) FILTER (WHERE {name}) AS n_failed, count(*) FILTER (WHERE {alone}) AS n_only_this FROM f"
            )
    return _MEASURED + "\n" + " UNION ALL ".join(rows)


ABLATIONS_SQL = _ablations_sql()
