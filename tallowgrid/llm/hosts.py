"""Quality rules of documents and verdicts on their hosts, shrunk by an empirical beta prior."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowgrid.llm.common import join_unique, map_texts, materialise

_WHITE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: Rules: name and the condition, in SQL, under which a document fails it.
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 50 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "lines": "n_dup_lines >= 5 AND 20 * n_dup_lines > n_words",
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The five measures of a whole text, in the order of MEASURES; zeros for null."""
    if not text:
        return 0, 0, 0, 0, 0
    content = text.encode("utf-8", "surrogatepass")
    words = content.split()
    n = len(words)
    white = len(content) - len(content.translate(None, _WHITE))
    symbols = len(content) - len(content.translate(None, _SYMBOLS))
    lines = [x for x in content.split(b"\n") if x.strip(_WHITE)]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        end = 0  # words before this are counted already
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, len(text) - white, symbols, len(lines) - len(set(lines)), repeated


def measure_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source and the five measures of every row."""

    def make():
        def find(texts):
            return list(np.array([measure(t) for t in texts], dtype=np.int64).reshape(len(texts), 5).T)

        return find

    return map_texts(docs, ["doc_id", "source"], "text", make, ", ".join(f"{m} long" for m in MEASURES))


#: A host is bad if a rule's failure rate is surely above EXCESS times the pooled rate, and above LEAST;
#: surely: by SURENESS standard deviations of the posterior.
EXCESS, LEAST, SURENESS = 1.5, 0.05, 2.0


def host_verdicts(measured: DataFrame, excess: float = EXCESS, least: float = LEAST, sureness: float = SURENESS) -> DataFrame:
    """One row a host: source, documents, the shrunk failure rate of each rule and its lower bound, host_ok.

    For each rule the beta prior has the pooled rate p as its mean and a strength s by the method of
    moments: p(1-p)/v - 1, within 1 and 10,000, where v is the variance of the hosts' rates, weighted by
    documents, less what sampling alone gives. A host of n documents, f of which fail, has the posterior
    rate m = (p s + f) / (s + n) with the variance m(1-m) / (s + n + 1). It is bad if for any rule m less
    ``sureness`` standard deviations is above ``excess`` * p and above ``least``: a host of few documents
    is near p and unsure, so it isn't judged by what little is known. Rows without a source are one host.
    The table has a row a host; sums over it are the only global step.
    """
    # A hot host's rows are summed within each task first.
    fails = [F.sum(F.expr(f"CAST({rule} AS INT)").cast("long")).alias(f"f_{name}") for name, rule in RULES.items()]
    hosts = measured.groupBy("source").agg(F.count("*").alias("documents"), *fails)
    totals = hosts.agg(F.sum("documents").alias("n"), F.count("*").alias("h"), *[F.sum(f"f_{r}").alias(f"t_{r}") for r in RULES]).first()
    n, h = totals["n"] or 1, totals["h"] or 1
    mean = {r: (totals[f"t_{r}"] or 0) / n for r in RULES}
    spread = hosts.agg(*[F.sum(F.col("documents") * F.pow(F.col(f"f_{r}") / F.col("documents") - F.lit(mean[r]), F.lit(2.0))).alias(r) for r in RULES]).first()
    rates, bounds = {}, {}
    for r in RULES:
        p = mean[r]
        v = (spread[r] or 0.0) / n - p * (1 - p) * h / n
        strength = min(max(p * (1 - p) / v - 1, 1.0), 10_000.0) if v > 0 else 10_000.0
        rates[f"rate_{r}"] = (F.lit(p * strength) + F.col(f"f_{r}")) / (F.lit(strength) + F.col("documents"))
        m = F.col(f"rate_{r}")
        bounds[f"surely_{r}"] = m - F.lit(sureness) * F.sqrt(m * (1 - m) / (F.lit(strength + 1) + F.col("documents")))
    judged = hosts.withColumns(rates).withColumns(bounds).select("source", "documents", *rates, *bounds)
    fine = [F.col(f"surely_{r}") <= F.lit(max(excess * mean[r], least)) for r in RULES]
    return judged.withColumn("host_ok", reduce(lambda a, b: a & b, fine))


def judge_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the measures, base_failed, kept for every row; ``options`` are those of ``host_verdicts``.

    Null and empty texts have no words and fail the base; whole texts are measured, however long. Repeated
    rows are judged each; no rows give none; further columns, whatever their names, are not read. The
    measures are written once, narrow, and read for the hosts' sums and for the result.
    """
    measured = materialise(measure_documents(docs), "host-measures")
    # A host with a third of all documents is the normal case: such keys are split off.
    joined = join_unique(measured, host_verdicts(measured, **options).select("source", "host_ok"), "source")
    base = F.expr(f"({RULES['short']}) OR ({RULES['repetitive']})")
    return joined.select("doc_id", *MEASURES, base.alias("base_failed"), (~base & F.coalesce("host_ok", F.lit(True))).alias("kept"))


_REPEATED = """
 SELECT doc, count(DISTINCT pos) AS n_repeat_words FROM (
  SELECT doc, unnest([i, i + 1, i + 2]) AS pos FROM (
   SELECT doc, i, count(*) OVER (PARTITION BY doc, a, b, c) AS often FROM (
    SELECT doc, unnest(range(len(w) - 2)) AS i, unnest(w[:-3]) AS a, unnest(w[2:-2]) AS b, unnest(w[3:]) AS c FROM words WHERE len(w) > 2))
  WHERE often > 1) GROUP BY doc
"""

#: DuckDB SQL of ``judge_documents`` on documents.
ORACLE_SQL = f"""
WITH words AS (
 SELECT row_number() OVER () AS doc, doc_id, source, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
 FROM documents),
repeated AS ({_REPEATED}),
measured AS (
 SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
 FROM words LEFT JOIN repeated USING (doc)),
hosts AS (
 SELECT source, count(*)::DOUBLE AS n, {", ".join(f"sum(CASE WHEN {rule} THEN 1 ELSE 0 END)::DOUBLE AS f_{r}" for r, rule in RULES.items())}
 FROM measured GROUP BY source),
pooled AS (SELECT sum(n) AS tn, count(*)::DOUBLE AS th, {", ".join(f"sum(f_{r}) / sum(n) AS p_{r}" for r in RULES)} FROM hosts),
spread AS (
 SELECT {", ".join(f"sum(n * pow(f_{r} / n - p_{r}, 2)) / max(tn) - max(p_{r} * (1 - p_{r}) * th / tn) AS v_{r}" for r in RULES)}
 FROM hosts, pooled),
strength AS (
 SELECT {", ".join(f"CASE WHEN v_{r} > 0 THEN least(greatest(p_{r} * (1 - p_{r}) / v_{r} - 1, 1), 10000) ELSE 10000 END AS m_{r}" for r in RULES)}
 FROM spread, pooled),
shrunk AS (SELECT source, n, {", ".join(f"p_{r}, m_{r}, (p_{r} * m_{r} + f_{r}) / (m_{r} + n) AS r_{r}" for r in RULES)} FROM hosts, pooled, strength),
verdicts AS (
 SELECT source, {" AND ".join(f"r_{r} - {SURENESS} * sqrt(r_{r} * (1 - r_{r}) / (m_{r} + n + 1)) <= greatest({EXCESS} * p_{r}, {LEAST})" for r in RULES)} AS host_ok
 FROM shrunk)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
 ({RULES["short"]}) OR ({RULES["repetitive"]}) AS base_failed,
 NOT (({RULES["short"]}) OR ({RULES["repetitive"]})) AND host_ok AS kept
FROM measured JOIN verdicts ON measured.source IS NOT DISTINCT FROM verdicts.source
"""
