"""Quality rules judged per document and per host.

Each document is measured and checked against fixed rules: base rules, which alone reject a document, and further ones,
which only a host in doubt is held to. A document that breaks any rule counts as a failure of its host (column
`source`). Each host's failure rate is shrunk with a beta prior fitted to the hosts themselves (method of moments), and
the shrunk rate is the host's verdict, joined back to its documents:

  passed   not above the prior's mean: the base rules decide
  strict   above the mean: the host is likelier worse than better than its like, and any broken rule rejects a document
  failed   above `host_limit`: most of the host is rubbish, and all its documents go

Defined cases: a null or empty text has no words and fails the base rules; a very long text is measured whole; a
document without a source has no host and is judged by the base rules only; repeated rows are measured and counted
each; hosts with equal counts tie in rate and verdict; an empty table gives an empty result; further columns of the
input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_join, map_batches, stored, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
_NOT_SYMBOLS = str.maketrans("", "", SYMBOLS)


@dataclass(frozen=True)
class Rules:
    """Production limits: of the base rules, the further rules, and the shrunk rate at which a host falls."""

    least_words: int = 10
    repeat_percent: int = 20
    symbol_percent: int = 5
    line_percent: int = 50
    word_length: tuple[int, int] = (2, 12)
    host_limit: float = 0.5


def repeated_words(ids: np.ndarray, n: int = WINDOW) -> int:
    """Words that lie in an n-word window found at least twice. ids: the words as numbers."""
    if len(ids) <= n:
        return 0
    codes = ids
    for k in range(1, n):  # number the windows of k + 1 words exactly: pairs of (window of k words, next word)
        codes = np.unique(codes[:-1] * np.int64(len(ids) + 1) + ids[k:], return_inverse=True)[1].astype(np.int64)
        if k < n - 1 and int(codes.max()) + 1 == len(codes):
            return 0  # all windows differ already
    twice = np.bincount(codes)[codes] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of a whole text; n_lines counts lines with a word."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return len(words), len(text) - spaces, len(text) - len(text.translate(_NOT_SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids), len(lines)


def measured(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, source, the measures, base_failed and rule_failed (any rule, the base ones included)."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

    def of(ids: list, texts: list, sources: list) -> dict:
        return {"doc_id": ids, "source": sources} | dict(zip(names, zip(*map(measure, texts), strict=True), strict=True))

    out = map_batches(documents.select("doc_id", "text", "source"), of, "doc_id long, source string, " + ", ".join(f"{n} long" for n in names))
    low, high = rules.word_length
    base = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    symbols = 100 * F.col("n_symbols") > rules.symbol_percent * F.col("word_chars")
    lines = 100 * F.col("n_dup_lines") > rules.line_percent * F.col("n_lines")
    length = (F.col("word_chars") < low * F.col("n_words")) | (F.col("word_chars") > high * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("rule_failed", F.col("base_failed") | symbols | lines | length)


def host_verdicts(measures: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """source, n_docs, n_failed, shrunk_rate and host (the verdict): one row per host.

    The prior is one row of sums over the hosts; its strength lies between 1 document (hosts that differ as much as
    they can) and 10,000 (hosts that differ by chance only).
    """
    hosts = measures.where("source is not null").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("rule_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    row = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("n_docs"))).first()
    mean, spread, noise = (float(x or 0.0) for x in row)
    between = spread - mean * (1 - mean) * noise  # what the hosts differ by beyond chance
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e4) if between > 0 else 1e4
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    verdict = F.when(F.col("shrunk_rate") > rules.host_limit, "failed").when(F.col("shrunk_rate") > mean * (1 + 1e-9), "strict").otherwise("passed")
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host", verdict)


def quality_rules(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every document with its measures, base_failed, kept, and its host's shrunk_rate and verdict (null without a host)."""
    measures = stored(measured(documents, rules))
    hosts = host_verdicts(measures, rules).select("source", "shrunk_rate", "host")
    out = lookup_join(measures, hosts, "source", salt=F.col("doc_id"))
    host = F.coalesce("host", F.lit("passed"))
    kept = ~F.col("base_failed") & F.when(host == "failed", F.lit(False)).when(host == "strict", ~F.col("rule_failed")).otherwise(F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rule_failed", F.round("shrunk_rate", 6).alias("shrunk_rate"), "host")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\x0C\r]+') AS ws FROM t),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
marked AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS j FROM marked WHERE k > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, sum(n - 1) AS n, sum(n) AS n_lines FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^ \t\n\x0B\x0C\r]') GROUP BY doc_id, line) GROUP BY doc_id),
m AS (SELECT t.doc_id, t.source, len(w.ws) AS n_words, length(regexp_replace(t.text, '[ \t\n\x0B\x0C\r]+', '', 'g')) AS word_chars,
  length(regexp_replace(t.text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(lines.n_lines, 0) AS n_lines
  FROM t JOIN w USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > 5 * word_chars OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 12 * n_words AS rule_failed FROM b),
h AS (SELECT source, count(*) AS n_docs, sum(rule_failed::INT) AS n_failed FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(n_failed / n_docs) AS mu, var_pop(n_failed / n_docs) - avg(n_failed / n_docs) * (1 - avg(n_failed / n_docs)) * avg(1 / n_docs) AS between_hosts FROM h),
s AS (SELECT mu, CASE WHEN between_hosts > 0 THEN least(greatest(mu * (1 - mu) / between_hosts - 1, 1.0), 1e4) ELSE 1e4 END AS strength FROM p),
r AS (SELECT source, mu, (n_failed + mu * strength) / (n_docs + strength) AS shrunk FROM h, s),
v AS (SELECT source, shrunk, CASE WHEN shrunk > 0.5 THEN 'failed' WHEN shrunk > mu * (1 + 1e-9) THEN 'strict' ELSE 'passed' END AS host FROM r)
SELECT f.doc_id, f.n_words::BIGINT AS n_words, f.word_chars::BIGINT AS word_chars, f.n_symbols::BIGINT AS n_symbols, f.n_dup_lines::BIGINT AS n_dup_lines,
  f.n_repeat_words::BIGINT AS n_repeat_words, f.base_failed,
  NOT f.base_failed AND CASE coalesce(v.host, 'passed') WHEN 'failed' THEN FALSE WHEN 'strict' THEN NOT f.rule_failed ELSE TRUE END AS kept,
  f.rule_failed, round(v.shrunk, 6) AS shrunk_rate, v.host
FROM f LEFT JOIN v USING (source)
"""
